"""Spark-native document analytics: clean, cut, link, search, cite and measure large corpora."""
