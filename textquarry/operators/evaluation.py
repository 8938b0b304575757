"""Comparing text engines and judging answers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.functions.scoring import agreement, word_overlap
from textquarry.operators.quantiles import exact


def extracted(pages: DataFrame, extractors: dict[str, Callable[[bytes], str]], key: str = "page", content: str = "content") -> DataFrame:
    """UDF8: every extractor on every page: key, extractor, text, seconds and error; one that fails leaves the error and no text.

    A task holds one batch of pages, and runs each extractor on it in turn; the result goes into AGG4 to AGG6.
    """
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(1).to_pylist()
            for name, extract in extractors.items():
                texts, seconds, errors = [], [], []
                for body in bodies:
                    began, text, error = time.perf_counter(), None, None
                    try:
                        text = extract(body)
                    except Exception as e:  # the page carries the failure, the comparison goes on
                        error = f"{type(e).__name__}: {e}"
                    texts.append(text)
                    errors.append(error)
                    seconds.append(time.perf_counter() - began)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * len(bodies)), pa.array(texts, pa.string()), pa.array(seconds, pa.float64()), pa.array(errors, pa.string())],
                                                 names=[key, "extractor", "text", "seconds", "error"])

    return pages.select(key, content).mapInArrow(run, f"`{key}` {kind}, extractor string, text string, seconds double, error string")


def engine_summary(rows: DataFrame, measures: list[str]) -> DataFrame:
    """AGG4: pages, successes and exact medians of each engine."""
    ok = F.col("error").isNull()
    out = rows.groupBy("extractor").agg(F.count("*").alias("pages"), F.count_if(ok).alias("ok"), F.min("error").alias("first_error"))
    for m in measures:
        median = exact(rows, ["extractor"], m, {f"median_{m}": 0.5}).withColumnRenamed("extractor", "_extractor")
        out = out.join(median, F.col("extractor").eqNullSafe(F.col("_extractor"))).drop("_extractor")
    return out.select("extractor", "pages", "ok", *(f"median_{m}" for m in measures), "first_error")


def consensus(rows: DataFrame) -> DataFrame:
    """AGG5: an engine's mean over other engines of the better of agreement and word overlap, page by page."""
    other = rows.select("source", "page", F.col("extractor").alias("other"), F.col("text").alias("other_text"))
    pairs = rows.join(other, ["source", "page"]).where("extractor <> other")
    return pairs.groupBy("extractor").agg(F.avg(F.greatest(agreement(F.col("text"), F.col("other_text")), word_overlap(F.col("text"), F.col("other_text")))).alias("consensus"))


def merged_runs(runs: DataFrame) -> DataFrame:
    """AGG6: for each engine its newest run with a success, else its oldest failed one."""
    good = F.col("ok") > 0
    order = [F.desc(good), F.when(good, F.unix_micros("mtime")).desc_nulls_last(), F.when(~good, F.unix_micros("mtime")).asc_nulls_last(), "run"]
    rank = F.row_number().over(Window.partitionBy("extractor").orderBy(*order))
    return runs.withColumn("_n", rank).where("_n = 1").drop("_n")


def evaluation_summary(records: DataFrame, metrics: list[str]) -> DataFrame:
    """AGG7: one row a metric with its mean and how many records have it."""
    long = records.select(F.explode(F.col("scores")).alias("metric", "score"))
    wanted = records.sparkSession.createDataFrame([(m,) for m in metrics], "metric string")
    means = long.groupBy("metric").agg(F.avg("score").alias("mean"), F.count("score").alias("scored"))
    return F.broadcast(wanted).join(means, "metric", "left").select("metric", "mean", F.coalesce("scored", F.lit(0)).alias("scored"))


def gated(means: DataFrame, floors: DataFrame) -> DataFrame:
    """AGG8: a metric without a mean, or below its floor, fails."""
    return floors.join(means, "metric", "left").select("metric", "floor", "mean", F.coalesce(F.col("mean") >= F.col("floor"), F.lit(False)).alias("passed"))


def applicable(records: DataFrame, needs_reference: dict[str, bool]) -> DataFrame:
    """AGG9: records by the metrics that they can be judged by; the metrics are a short list in every row."""
    specs = F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(r).alias("needs")) for m, r in sorted(needs_reference.items())))
    sound = (F.length("answer") > 0) & (F.size("contexts") > 0) & F.col("error").isNull()
    rows = records.where(sound).select("*", F.explode(specs).alias("m"))
    return rows.where(~F.col("m.needs") | (F.length(F.coalesce("reference", F.lit(""))) > 0)).select(*records.columns, F.col("m.metric").alias("metric"))


def majority(value: Column, name: str) -> Column:
    """AGG16: whether more than half of a group's rows have a value."""
    return (F.count_if(value) * 2 > F.count(F.lit(1))).alias(name)


def report_lines(means: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK6: the summary and the records of an evaluation as JSON lines, to be written side by side."""
    return means.select(F.to_json(F.struct(*means.columns)).alias("line")), records.select(F.to_json(F.struct(*records.columns)).alias("line"))


def write_report(means: DataFrame, records: DataFrame, path: str) -> None:
    """SNK6: both as text files under a path."""
    for name, lines in zip(("summary", "records"), report_lines(means, records)):
        lines.write.mode("overwrite").text(f"{path}/{name}")
