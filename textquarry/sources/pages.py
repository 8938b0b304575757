"""Fetched pages, links, transcripts, figures and batch plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEAST_ARTICLE = 200


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: path, kind and text of the txt, md and csv files under a path; others are returned as rejected, without text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    known = kind.isin("txt", "md", "csv")
    from textquarry.sources.tabular import decoded

    return files.select("path", F.when(known, kind).otherwise("rejected").alias("kind"), F.when(known, decoded(F.col("content"))["text"]).alias("text"))


def main_text(html: Column) -> Column:
    """SRC8: title and main text: furniture is dropped, and an article is taken alone if it is long enough."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer|aside|form|noscript)\b[^>]*>.*?</\1\s*>", " ")
    article = F.regexp_extract(bare, r"(?is)<(article|main)\b[^>]*>(.*?)</\1\s*>", 2)
    clean = lambda x: F.trim(F.regexp_replace(_unescaped(F.regexp_replace(x, r"(?s)<[^>]*>", " ")), r"(?U)\s+", " "))
    body = clean(F.regexp_replace(bare, r"(?is)<head\b[^>]*>.*?</head\s*>", " "))
    return F.struct(clean(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), F.when(F.length(clean(article)) >= LEAST_ARTICLE, clean(article)).otherwise(body).alias("text"))


def _unescaped(x: Column) -> Column:
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(sign))
    return x


def link_parts(url: Column) -> Column:
    """SRC9: video id, sheet id and tab, and a file name from a link."""
    host = F.coalesce(F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^(www|m)\.", ""), F.lit(""))
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    video = F.when(host == "youtu.be", F.regexp_extract(path, r"^/([\w-]{11})", 1)).when(
        host.endswith("youtube.com"), F.coalesce(F.nullif(F.try_parse_url(url, F.lit("QUERY"), F.lit("v")), F.lit("")), F.regexp_extract(path, r"/(?:shorts|embed|live)/([\w-]{11})", 1)))
    sheet = F.regexp_extract(url, r"docs\.google\.com/spreadsheets/d/([\w-]+)", 1)
    name = F.regexp_extract(path, r"([^/]+)/?$", 1)
    return F.struct(F.nullif(video, F.lit("")).alias("video_id"), F.nullif(sheet, F.lit("")).alias("sheet_id"), F.nullif(F.regexp_extract(url, r"[#&?]gid=(\d+)", 1), F.lit("")).alias("gid"),
                    F.coalesce(F.nullif(name, F.lit("")), host).alias("file_name"))


def timeline(segments: DataFrame, key: str) -> DataFrame:
    """SRC7: each transcript line with its place in the joined text."""
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("char_offset", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)))


def kept_figures(figures: DataFrame, side: int = 96, share: float = 0.02, pages: int = 3) -> DataFrame:
    """SRC10: distinct figures that are large on their page and not repeated over many pages."""
    large = figures.where((F.col("width_px") >= side) & (F.col("height_px") >= side) & (F.col("area") >= share * F.col("page_area")))
    spread = large.groupBy("asset_id", "xref").agg(F.count_distinct("page").alias("on_pages")).where(F.col("on_pages") <= pages)
    return large.join(spread, ["asset_id", "xref"]).dropDuplicates(["asset_id", "page", "xref", "bbox"])


def page_batches(assets: DataFrame, size: int) -> DataFrame:
    """SRC11: [first, last) page ranges of an asset."""
    first = F.explode(F.sequence(F.lit(0), F.col("pages") - 1, F.lit(size))).alias("first")
    return assets.where("pages > 0").select("asset_id", "pages", first).select("asset_id", "first", F.least(F.col("first") + size, F.col("pages")).alias("stop"))


def to_process(assets: DataFrame, chunks: DataFrame, reset: bool = False) -> DataFrame:
    """SRC12: assets without chunks, or all of them after a reset."""
    return assets if reset else assets.join(chunks.select("asset_id").distinct(), "asset_id", "left_anti")
