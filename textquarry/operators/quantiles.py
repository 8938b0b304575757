"""AGG4, AGG18: quantiles from sketches that are kept and merged, and exact ones that hold only what lies near them.

A KLL sketch of a group's values has a fixed size and merges with others: sketches by hour are written once, and any span of
hours is a merge of them. A sketch's quantile is off by a rank error of about 2.3 / k**0.9 of the group at most.

Exact quantiles take a sketch first. It brackets every quantile by two values; values below are only counted, and only those
between, a few thousandths of a group, are put in order. So no task holds a group's values, and partial sums go before each shuffle.
Should a bracket miss its quantile, which the sketch's bound makes all but impossible, the query fails.

Null values don't count; a group without any has null quantiles; null group keys are a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Size of sketches; and half the width of a bracket, as a share of a group: three times such a sketch's rank error.
SIZE, SIDE = 1600, 0.01


def sketched(rows: DataFrame, by: list[str], value: str, size: int = SIZE) -> DataFrame:
    """by..., sketch: one of the values of each group, to be kept."""
    return rows.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(size)).alias("sketch"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """by..., sketch: those of finer groups put together."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def estimated(sketches: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """The sketches' groups with their number of values, n, and a column for each quantile."""
    n = F.kll_sketch_get_n_double("sketch")
    values = [F.when(n > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(p))).alias(name) for name, p in quantiles.items()]
    return sketches.select(*(c for c in sketches.columns if c != "sketch"), n.alias("n"), *values)


def exact(rows: DataFrame, by: list[str], value: str, quantiles: dict[str, float], size: int = SIZE, side: float = SIDE) -> DataFrame:
    """by... and a column for each quantile, interpolated between the two values next to it."""
    own = rows.select(F.struct(*by).alias("group"), F.col(value).cast("double").alias("v"))
    sketch = sketched(own.where("v is not null"), ["group"], "v", size).withColumn("n", F.kll_sketch_get_n_double("sketch"))
    at = lambda rank: F.kll_sketch_get_quantile_double("sketch", F.lit(min(1.0, max(0.0, rank))))
    # A bracket has to hold the values next to the place; of a few hundred values it is the whole group.
    few = F.col("n") * side < 4
    asked = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p"), F.when(few, at(0.0)).otherwise(at(p - side)).alias("low"), F.when(few, at(1.0)).otherwise(at(p + side)).alias("high")) for name, p in quantiles.items())))
    brackets = sketch.select("group", "n", asked.alias("q")).select("group", "n", "q.*").withColumn("place", F.col("p") * (F.col("n") - 1))
    below = F.col("v") < F.col("low")
    met = own.join(brackets, "group").where("v <= high")
    counted = met.groupBy("group", "name", "place", below.alias("below"), F.when(~below, F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("times"))
    upto = F.sum("times").over(Window.partitionBy("group", "name").orderBy(F.desc("below"), "v"))
    placed = counted.withColumn("upto", upto)
    first = lambda rank: F.min(F.when(F.col("upto") > rank, F.struct("upto", "v", "below")))
    ends = placed.groupBy("group", "name", "place").agg(first(F.floor("place")).alias("a"), first(F.ceil("place")).alias("b"))
    share = F.col("place") - F.floor("place")
    between = F.when(share == 0, F.col("a.v")).otherwise((1 - share) * F.col("a.v") + share * F.col("b.v"))
    missed = F.col("a").isNull() | F.col("b").isNull() | F.col("a.below") | F.col("b.below")
    found = ends.withColumn("value", F.when(missed, F.raise_error(F.lit("a bracket missed its quantile: take a larger sketch"))).otherwise(between))
    wide = found.groupBy("group").agg(*(F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in quantiles))
    groups = own.groupBy("group").agg(F.lit(1).alias("_one"))
    return groups.join(wide, "group", "left").select("group.*", *quantiles)
