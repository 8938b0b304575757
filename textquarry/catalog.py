"""Every registered query and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textquarry.plans import answering, log_queries, more_queries, retrieval_queries, source_queries, text_queries  # noqa: F401
from textquarry.plans.registry import ORACLES, QUERIES, query  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut the corpus, search it for every benchmark item, cite the hits."""
    return answering.answered(spark, sf_dir)


@query()
def answered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answering.answered(spark, sf_dir)
