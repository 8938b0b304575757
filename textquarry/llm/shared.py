"""Helpers that the operators share: the cluster's shared folder, written tables, and batch plumbing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir.

    Only where that setting is absent and the master is local is a temporary folder set instead.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        context.setCheckpointDir(base)
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id) -> "F.Column":
    """True for rows kept for evaluation: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many, so that Python holds few texts at once; nothing is copied."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: A set of ids is sent to tasks as a table of at most 2**(ID_BITS - 6) words of 64 bits (some 20 MB), whatever its size.
ID_BITS = 25


def _place(column: str):
    return F.pmod(F.xxhash64(F.col(f"`{column}`").cast("bigint")), F.lit(1 << ID_BITS))


def id_bits(ids: DataFrame, column: str) -> DataFrame:
    """word, bits: a bit for each hash of column's values, as bigint (null is a value too)."""
    places = ids.select(_place(column).alias("place"))
    return places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))


def with_bit(df: DataFrame, column: str, bits: DataFrame, name: str) -> DataFrame:
    """df with a boolean column name: whether the bit of column's value is set.

    It is for every value of the set, and for few others while the set has far fewer values than there are bits: a filter
    that leaves most rows where they are, ahead of an exact join of the others. The plan is the same at every size.
    """
    word, own = fresh(df, "word"), fresh(df, "bits")
    sent = F.broadcast(bits.select(F.col("word").alias(word), F.col("bits").alias(own)))
    place = _place(column)
    hit = F.expr(f"shiftrightunsigned(`{own}`, cast(pmod(xxhash64(cast(`{column}` as bigint)), {1 << ID_BITS}L) & 63 as int)) & 1L = 1L")
    return df.join(sent, F.shiftright(place, 6) == F.col(word), "left").select(*(F.col(f"`{c}`") for c in df.columns), F.coalesce(hit, F.lit(False)).alias(name))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
