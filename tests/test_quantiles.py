"""Quantiles: exact against numpy, sketches within their bound, merged equal to direct in what they promise."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textquarry.operators import quantiles

ASKED = {"least": 0.0, "low": 0.01, "median": 0.5, "p95": 0.95, "greatest": 1.0}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    kinds = {"even": rng.uniform(0, 100, 60_000), "ties": rng.integers(0, 5, 40_000).astype(float), "tail": rng.lognormal(0, 3, 50_000), "one": np.array([7.0]), "two": np.array([1.0, 2.0]), "same": np.full(10_000, -3.0)}
    names = np.concatenate([[k] * len(v) for k, v in kinds.items()])
    values = np.concatenate(list(kinds.values()))
    order = rng.permutation(len(names))
    table = pa.table({"kind": pa.array(names[order]), "day": pa.array(rng.integers(0, 30, len(names))), "value": pa.array(values[order])})
    return kinds, spark.createDataFrame(table).repartition(8)


def test_exact_quantiles_equal_numpy(spark, rows):
    kinds, table = rows
    odd = spark.createDataFrame([("none", 0, None), (None, 0, 1.0), (None, 0, 3.0), (None, 0, None)], "kind string, day bigint, value double")
    got = {r.kind: r for r in quantiles.exact(table.unionByName(odd), ["kind"], "value", ASKED).collect()}
    for kind, values in [*kinds.items(), (None, np.array([1.0, 3.0]))]:
        assert [got[kind][n] for n in ASKED] == pytest.approx(np.quantile(values, list(ASKED.values())).tolist(), rel=1e-12), kind
    assert all(got["none"][n] is None for n in ASKED) and len(got) == len(kinds) + 2


def test_few_values_are_put_in_order(spark, rows):
    kinds, table = rows
    plan = quantiles.exact(table.where("kind = 'even'"), ["kind"], "value", {"median": 0.5})
    assert abs(plan.first()["median"] - np.median(kinds["even"])) < 1e-9
    bounds = quantiles.estimated(quantiles.sketched(table.where("kind = 'even'"), ["kind"], "value"), {"low": 0.5 - quantiles.SIDE, "high": 0.5 + quantiles.SIDE}).first()
    assert table.where((F.col("kind") == "even") & F.col("value").between(bounds.low, bounds.high)).count() < 0.03 * len(kinds["even"])


def test_sketches_by_day_merge_within_the_bound(spark, rows):
    kinds, table = rows
    days = quantiles.sketched(table, ["kind", "day"], "value", 400)
    got = {r.kind: r for r in quantiles.estimated(quantiles.merged(days, ["kind"]), ASKED).collect()}
    direct = {r.kind: r for r in quantiles.estimated(quantiles.sketched(table, ["kind"], "value", 400), ASKED).collect()}
    for kind, values in kinds.items():
        assert got[kind].n == direct[kind].n == len(values)
        for name, p in ASKED.items():
            for found in (got[kind][name], direct[kind][name]):
                assert (values < found).mean() - 0.02 <= p <= (values <= found).mean() + 0.02, (kind, name)


def test_no_rows_give_no_groups(spark):
    none = spark.createDataFrame([], "kind string, value double")
    assert quantiles.exact(none, ["kind"], "value", ASKED).count() == 0 and quantiles.estimated(quantiles.sketched(none, ["kind"], "value"), ASKED).count() == 0
