"""Task logs, request logs, counters and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ACTIVE = ("QUEUED", "STARTED")
FINAL = ("SUCCESS", "FAILURE", "DEAD")
FAST_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
COUNT_BUCKETS = (1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0)


def first_of(rows: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n rows of each key in an order (WIN1, WIN2, WIN3, WIN7, WIN10); the limit is applied before the shuffle too."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", rank).where(F.col("_n") <= n).drop("_n")


def in_flight(tasks: DataFrame) -> DataFrame:
    """WIN1: the newest active run of each task and argument print."""
    return first_of(tasks.where(F.col("status").isin(*ACTIVE)), ["task_name", "args_hash"], [F.desc("created_at"), F.desc("task_id")])


def active_task(tasks: DataFrame) -> DataFrame:
    """WIN2: a project's running task, else its queued one, oldest first."""
    started = F.when(F.col("status") == "STARTED", 0).otherwise(1)
    return first_of(tasks.where(F.col("status").isin(*ACTIVE)), ["project_id"], [started, "created_at", "task_id"])


def buckets(samples: DataFrame, keys: list[str], value: str, ladder: tuple = FAST_BUCKETS) -> DataFrame:
    """AGG10: cumulative counts by upper bound, the last without one. One aggregation, then the ladder is unpivoted."""
    counts = [F.count_if(F.col(value) <= b).alias(f"b{k}") for k, b in enumerate(ladder)]
    wide = samples.groupBy(*keys).agg(*counts, F.count(value).alias("all"))
    steps = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(ladder)]
    return wide.select(*keys, F.inline(F.array(*steps, F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("n")))))


def histogram_quantile(rows: DataFrame, keys: list[str], q: float) -> DataFrame:
    """AGG11: the quantile of cumulative buckets(le, n), linear inside a bucket; beyond the last bound it is that bound."""
    by = Window.partitionBy(*keys).orderBy("le")
    marked = rows.withColumns({"low": F.coalesce(F.lag("le").over(by), F.lit(0.0)), "before": F.coalesce(F.lag("n").over(by), F.lit(0)), "total": F.max("n").over(Window.partitionBy(*keys))})
    hit = first_of(marked.where((F.col("total") > 0) & (F.col("n") >= q * F.col("total"))), keys, ["le"])
    inside = F.col("low") + (F.col("le") - F.col("low")) * (q * F.col("total") - F.col("before")) / F.nullif(F.col("n") - F.col("before"), F.lit(0))
    return hit.select(*keys, F.when(F.col("le") == float("inf"), F.col("low")).otherwise(F.coalesce(inside, F.col("le"))).alias("value"))


def counter_rate(samples: DataFrame, keys: list[str], width: str, seconds: int) -> DataFrame:
    """AGG13: increase a second by window of a counter's samples(ts, value); a fall is a restart from zero."""
    before = F.lag("value").over(Window.partitionBy(*keys).orderBy("ts", "value"))
    grown = F.when(before.isNull(), 0.0).when(F.col("value") >= before, F.col("value") - before).otherwise(F.col("value"))
    return samples.withColumn("grown", grown).groupBy(*keys, F.window("ts", width).start.alias("start")).agg((F.sum("grown") / seconds).alias("rate"))


def share(part: Column, whole: Column, least: float = 1e-9) -> Column:
    """AGG14: a ratio whose denominator is kept from zero."""
    return part / F.greatest(whole, F.lit(least))


def stage_durations(events: DataFrame, key: str) -> DataFrame:
    """AGG19: mean seconds in each stage, from each stage's start to the next."""
    nxt = F.lead("ts").over(Window.partitionBy(key).orderBy("ts", "event_id"))
    rows = events.withColumn("seconds", F.unix_micros(nxt) / 1e6 - F.unix_micros("ts") / 1e6)
    return rows.where("seconds is not null").groupBy("stage").agg(F.count("*").alias("n"), F.avg("seconds").alias("mean_seconds"))


def task_state(events: DataFrame) -> DataFrame:
    """STR6: each task's status, stage and counts from its last event, and when it began and ended."""
    last = lambda c: F.max_by(c, F.struct("ts", "event_id")).alias(c)
    return events.groupBy("task_id").agg(last("status"), last("stage"), last("done"), F.min(F.when(F.col("status") == "STARTED", F.col("ts"))).alias("started_at"), F.max(F.when(F.col("status").isin(*FINAL), F.col("ts"))).alias("completed_at"))


def swept(tasks: DataFrame, now: Column, limit_s: int, retention_s: int) -> DataFrame:
    """STR7: stale running and queued tasks are dead; finished ones past retention are gone."""
    age = F.unix_timestamp(now) - F.unix_timestamp("ts")
    stale = ((F.col("status") == "STARTED") & (age > 2 * limit_s)) | ((F.col("status") == "QUEUED") & (age > retention_s))
    kept = tasks.where(~(F.col("status").isin(*FINAL) & (age > retention_s)))
    return kept.withColumn("status", F.when(stale, "DEAD").otherwise(F.col("status")))


def abandoned(chain: DataFrame) -> DataFrame:
    """STR8: tasks after the first failed one of their chain are dead."""
    failed = F.min(F.when(F.col("status") == "FAILURE", F.col("pos"))).over(Window.partitionBy("chain_id"))
    return chain.withColumn("_f", failed).withColumn("status", F.when(F.col("pos") > F.col("_f"), "DEAD").otherwise(F.col("status"))).drop("_f")


def locked_logins(events: DataFrame, window_s: int, limit: int = 5) -> DataFrame:
    """STR9: failures that reach the limit inside the window; a success clears what was before."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    runs = events.withColumn("run", F.sum(F.col("ok").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.unix_micros("ts")
    near = Window.partitionBy("user_id", "run").orderBy(at).rangeBetween(-window_s * 1_000_000, 0)
    counted = runs.withColumn("failures", F.sum((~F.col("ok")).cast("int")).over(near))
    return counted.where(~F.col("ok") & (F.col("failures") >= limit)).select("user_id", "event_id", "failures")


def rolling(events: DataFrame, width: str, slide: str) -> DataFrame:
    """STR10: count and mean by sliding window; the same expression serves a stream with a watermark."""
    by = events.groupBy(F.window("ts", width, slide).alias("w"), "event_type")  # the whole window, whose end a watermark closes
    return by.agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("start"), "event_type", "n", "mean_value")


def answer_times(events: DataFrame) -> DataFrame:
    """STR12: seconds to the first token and to the end of each answer, and what happened in it."""
    t0 = F.min(F.unix_micros("ts"))
    first = F.min(F.when(F.col("type") == "delta", F.unix_micros("ts")))
    return events.groupBy("answer_id").agg(((first - t0) / 1e6).alias("first_token_s"), ((F.max(F.unix_micros("ts")) - t0) / 1e6).alias("total_s"),
                                           F.count_if(F.col("type") == "delta").alias("deltas"), F.bool_or(F.col("type") == "error").alias("error"))
