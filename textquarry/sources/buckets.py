"""SNK2, SNK3, VEC4: keyed tables in hash buckets, changed in place of what they touch.

A table is a Parquet folder partitioned by bucket, a hash of the key. An upsert compares digests first, reading of the table
only keys and digests of the buckets that the changes fall into; what is as it was is dropped, only the rest is built (embedded),
and only buckets that have a new or changed row are written anew, by dynamic partition overwrite. So the work follows the
changes, not the table, and an upsert that was broken off can be run again. Whole rows are dealt out by bucket, once where they
are found among the changes and once where they are written; what is decided on keys and digests moves only those.

Of changes with one key the last by order wins, or without an order the one with the greatest digest. Null keys are a key.
A table has as many buckets as it was made with; their number is kept beside it, and bounds what goes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.workspace import written


def content_digest(*columns: str) -> Column:
    """A digest of the columns that tells null from empty and keeps columns apart."""
    return F.sha2(F.to_json(F.array(*(F.col(c).cast("string") for c in columns))), 256)


def _spec(spark: SparkSession, path: str) -> tuple[list[str], int, str]:
    row = spark.read.parquet(f"{path}/spec").first()
    return list(row["key"]), row["buckets"], row["digest"]


def _bucketed(rows: DataFrame, key: list[str], buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))


def _latest(rows: DataFrame, key: list[str], digest: str, order: str | None) -> DataFrame:
    last = Window.partitionBy("bucket", *key).orderBy(*([F.desc(order)] if order else []), F.desc(digest))
    return rows.withColumn("_last", F.row_number().over(last)).where("_last = 1").drop("_last")


def _dealt(rows: DataFrame, key: list[str], buckets: int) -> DataFrame:
    """Rows with their bucket, a bucket in one task; a window over bucket and key needs no further shuffle."""
    return _bucketed(rows, key, buckets).repartition("bucket")


def _write(rows: DataFrame, path: str) -> None:
    """Write rows, which are dealt out by bucket or lie in the table's own files."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/data")


def create(rows: DataFrame, path: str, key: list[str], digest: str, buckets: int = 256, build: Callable[[DataFrame], DataFrame] = lambda rows: rows, order: str | None = None) -> None:
    """A new table of rows, that have a digest column; build adds what is made from a row (its vector)."""
    spark = rows.sparkSession
    spark.createDataFrame([(key, buckets, digest)], "key array<string>, buckets int, digest string").coalesce(1).write.parquet(f"{path}/spec")
    _write(build(_latest(_dealt(rows, key, buckets), key, digest, order)), path)


def table(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    """The rows of a table, of these buckets only: other folders are not read."""
    rows = spark.read.parquet(f"{path}/data")
    return rows if buckets is None else rows.where(F.col("bucket").isin(*buckets) if buckets else F.lit(False))


def _numbers(rows: DataFrame) -> list[int]:
    return [r[0] for r in rows.select("bucket").distinct().collect()]  # at most the number of buckets


def _matched(left: DataFrame, right: DataFrame, key: list[str], how: str) -> DataFrame:
    same = left["bucket"] == right["bucket"]
    for k in key:
        same = same & left[k].eqNullSafe(right[k])
    return left.join(right, same, how)


def upsert(spark: SparkSession, path: str, changes: DataFrame, build: Callable[[DataFrame], DataFrame] = lambda rows: rows, order: str | None = None) -> dict[str, int]:
    """Bring changes, with their digests, into the table; how many rows were new, changed and same, and how many buckets were written."""
    key, buckets, digest = _spec(spark, path)
    told = list(dict.fromkeys([*key, digest, *([order] if order else [])]))
    # Keys and digests decide; the rows themselves are fetched only for what is new or changed.
    asked = written(_latest(_bucketed(changes.select(*told), key, buckets), key, digest, order), "changes")
    held = table(spark, path, _numbers(asked)).select("bucket", *key, digest)
    known = held.select(F.col("bucket"), *key, F.col(digest).alias("_held"))
    state = F.when(F.col("_held").isNull(), "new").when(F.col("_held") != F.col(digest), "changed").otherwise("same")
    states = _matched(asked, known, key, "left").select(*(asked[c] for c in asked.columns), state.alias("_state"))
    other = written(states.where("_state <> 'same'"), "other")
    counts = {r["_state"]: r["count"] for r in other.groupBy("_state").count().collect()}
    touched = _numbers(other)
    if touched:
        whole = _bucketed(changes, key, buckets)
        found = _matched(whole, other, ["bucket", *told], "left_semi")
        new = written(build(_latest(found, key, digest, order)), "fresh")  # built once, whatever follows
        both = table(spark, path, touched).withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)), allowMissingColumns=True)
        newest = Window.partitionBy("bucket", *key).orderBy(F.desc("_new"))
        _write(both.repartition("bucket").withColumn("_place", F.row_number().over(newest)).where("_place = 1").drop("_place", "_new"), path)
    total = asked.count()
    return {"new": counts.get("new", 0), "changed": counts.get("changed", 0), "same": total - sum(counts.values()), "buckets": len(touched)}


def delete(spark: SparkSession, path: str, condition: Column) -> int:
    """Remove the rows that match, writing only their buckets anew; how many there were. A null condition keeps a row."""
    gone = F.coalesce(condition, F.lit(False))
    rows = table(spark, path)
    counts = rows.groupBy("bucket").agg(F.count_if(gone).alias("gone"), F.count_if(~gone).alias("left")).where("gone > 0").collect()  # a row a bucket
    if left := [r.bucket for r in counts if r.left]:
        _write(table(spark, path, left).where(~gone), path)  # each file's rows go to files of the same bucket
    for bucket in (r.bucket for r in counts if not r.left):  # an overwrite does not touch a folder without rows
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data/bucket={bucket}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return sum(r.gone for r in counts)
