"""Keyed writes as set operations: what a table looks like after an upsert, a delete or an update."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def append_chunks(chunks: DataFrame, path: str) -> None:
    """SNK1: add chunks, one folder an asset."""
    chunks.write.mode("append").partitionBy("asset_id").parquet(path)


def replace_assets(chunks: DataFrame, path: str) -> None:
    """SNK1: replace the chunks of the assets at hand and no others."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("asset_id").parquet(path)


def upserted(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """SNK2: changes win over rows of the same key."""
    both = table.withColumn("_rank", F.lit(0)).unionByName(changes.withColumn("_rank", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_rank")))
    return both.withColumn("_n", last).where("_n = 1").drop("_n", "_rank")


def without(table: DataFrame, condition: Column, counted: str = "kept") -> DataFrame:
    """SNK3: rows that don't match; a null condition keeps the row. The kept rows are counted as they are written."""
    from pyspark.sql import Observation

    return table.where(~F.coalesce(condition, F.lit(False))).observe(Observation(counted), F.count(F.lit(1)).alias("rows"))


def collection_name(name: Column, prefix: str = "collection_", pictures: bool = False) -> Column:
    """SNK4: a safe name for a collection's folder."""
    return F.concat(F.lit(prefix), F.regexp_replace(name, r"[^A-Za-z0-9_]", "_"), F.lit("_images" if pictures else ""))


def conversation_json(turns: DataFrame, key: str) -> DataFrame:
    """SNK5: one JSON line of a conversation's messages in order."""
    messages = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    return turns.groupBy(key).agg(F.to_json(F.struct(messages.alias("messages"))).alias("line"), F.count(F.lit(1)).alias("messages"))


def updated(table: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """SNK7: a column's new value where one is given."""
    new = changes.select(key, F.col(column).alias("_new"))
    return table.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def array_changed(values: Column, add: Column, remove: Column) -> Column:
    """SNK7: ids appended once, others removed."""
    return F.array_except(F.array_union(values, add), remove)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
