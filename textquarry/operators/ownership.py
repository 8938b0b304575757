"""Who owns what, what is a copy, and what goes when an owner goes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def duplicates(assets: DataFrame) -> DataFrame:
    """JOIN13: assets whose content an earlier one of the project has; no content is never a copy."""
    known = assets.where("content_hash <> ''")
    first = known.groupBy("project_id", "content_hash").agg(F.min("asset_id").alias("first_id"))
    return known.join(first, ["project_id", "content_hash"]).where("asset_id <> first_id")


def failed_husks(assets: DataFrame, chunks: DataFrame, tasks: DataFrame) -> DataFrame:
    """JOIN14: assets with a failed task, no active one, and no passage."""
    ids = lambda rows: rows.select("asset_id").distinct()
    active, failed = tasks.where("status in ('QUEUED', 'STARTED')"), tasks.where("status in ('FAILURE', 'DEAD')")
    return assets.join(ids(chunks), "asset_id", "left_anti").join(ids(active), "asset_id", "left_anti").join(ids(failed), "asset_id", "left_semi")


def access(chain: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """JOIN15: owner and owned along a chain of tables (rows, key, parent key)."""
    rows, key, parent = chain[0]
    out = rows.select(F.col(parent).alias("owner"), F.col(key).alias("id"))
    for rows, key, parent in chain[1:]:
        out = out.join(rows.select(F.col(parent).alias("id"), F.col(key).alias("_next")), "id").select("owner", F.col("_next").alias("id"))
    return out


def index_drift(chunks: DataFrame, points: DataFrame) -> DataFrame:
    """AGG2: passages and index points of each collection, and whether they agree."""
    a = chunks.groupBy("collection").agg(F.count("*").alias("chunks"))
    b = points.groupBy("collection").agg(F.count("*").alias("points"), F.max(F.size("embedding")).alias("dimension"))
    both = a.join(b, "collection", "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select("collection", zero("chunks").alias("chunks"), zero("points").alias("points"), "dimension", (zero("chunks") == zero("points")).alias("in_step"))


def complete_assets(batches: DataFrame) -> DataFrame:
    """AGG3, STR5: assets all of whose distinct batches are corrected; a repeated delivery counts once."""
    done = batches.groupBy("asset_id").agg(F.count_distinct(F.when(F.col("status") == "corrected", F.col("batch_index"))).alias("corrected"), F.max("total_batches").alias("total"))
    return done.where("corrected = total")


def page_of(rows: DataFrame, key: str, order: str, page: int, size: int) -> DataFrame:
    """WIN11: one page of each key's rows in order."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_n", n).where(F.col("_n").between((page - 1) * size + 1, page * size)).drop("_n")


def micro_batches(rows: DataFrame, key: str, order: str, size: int, first: int | None = None) -> DataFrame:
    """WIN6: batch numbers of so many rows each, the first of its own size."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    number = F.floor((n - 1) / size) if first is None else F.when(n <= first, 0).otherwise(F.floor((n - 1 - first) / size) + 1)
    return rows.withColumn("batch", number.cast("bigint"))
