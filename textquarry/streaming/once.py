"""STR13: a stream written exactly once, and a stream run over a table that is there.

A micro-batch is written to a folder of its own, named by the query and the batch's number, and counts only when its commit
is there, which is written last. A batch that is replayed after a crash replaces what was left of it if it was not committed,
and changes nothing if it was; readers see committed batches alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from textquarry.workspace import shared_path

COMMIT = "query string, batch bigint, rows bigint"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """query, batch and rows of the committed batches."""
    return spark.read.schema(COMMIT).option("recursiveFileLookup", True).parquet(f"{path}/commits") if exists(spark, f"{path}/commits") else spark.createDataFrame([], COMMIT)


def write_batch(batch: DataFrame, number: int, path: str, query: str) -> bool:
    """Write one batch and commit it; False if it was committed before."""
    spark = batch.sparkSession
    if not commits(spark, path).where((F.col("query") == query) & (F.col("batch") == number)).isEmpty():
        return False
    batch.write.mode("overwrite").parquet(f"{path}/data/query={query}/batch={number}")
    rows = spark.read.schema(batch.schema).parquet(f"{path}/data/query={query}/batch={number}").count()
    spark.createDataFrame([(query, number, rows)], COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/{query}-{number}")
    return True


def committed(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all committed batches, with query and batch."""
    done = [(r["query"], r.batch) for r in commits(spark, path).select("query", "batch").collect()]  # a row a batch
    folders = [f"{path}/data/query={q}/batch={n}" for q, n in sorted(done)]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*folders).drop("query", "batch")


def written_once(stream: DataFrame, path: str, query: str) -> DataStreamWriter:
    """The writer of a stream; give it a checkpoint and a trigger, and start it."""
    return stream.writeStream.queryName(query).foreachBatch(lambda batch, number: write_batch(batch, number, path, query) and None)


def streamed(spark: SparkSession, table: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream over a Parquet table gives once it has read all of it, written to the shared folder and read again.

    For streams on event time: one on the wall clock has no end.
    """
    out, before = shared_path(spark, "stream"), spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)  # state with timers and lists is kept there
    try:
        result = build(spark.readStream.schema(spark.read.parquet(table).schema).parquet(f"{table[:-1]}[{table[-1]}]"))  # a pattern for just this path, which may be a file
        run = result.writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{out}/rows")
        run.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(result.schema).parquet(f"{out}/rows")
