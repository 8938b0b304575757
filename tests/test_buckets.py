"""Bucketed tables: what an upsert embeds, what it writes anew, and what the table then holds."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from textquarry.operators.vectors import hashed_embedding
from textquarry.sources import buckets, sinks

SCHEMA = "id bigint, content string, source string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("digest", buckets.content_digest("content", "source"))


def files(path):
    return {f"{d}/{f}" for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


def counted(spark):
    """A build step, and how many rows it has built."""
    seen = spark.sparkContext.accumulator(0)

    def build(rows):
        @F.pandas_udf("string")
        def count(texts: pd.Series) -> pd.Series:
            seen.add(len(texts))
            return texts

        return rows.withColumn("embedding", hashed_embedding(count("content"), 8))

    return build, seen


def test_a_small_change_embeds_and_writes_little(spark, tmp_path):
    path, rows = str(tmp_path / "t"), [(k, f"text {k}", "s") for k in range(3000)]
    build, seen = counted(spark)
    buckets.create(frame(spark, rows), path, ["id"], "digest", 64, build)
    assert seen.value == 3000 and buckets.table(spark, path).count() == 3000
    before, held = files(path), {r.id: r.embedding for r in buckets.table(spark, path).collect()}
    # Everything is sent again; 10 texts are others and 2 are new.
    again = [(k, "other" if k % 300 == 7 else f"text {k}", "s") for k in range(3000)] + [(9001, "new", "s"), (9002, "new", "s")]
    got = buckets.upsert(spark, path, frame(spark, again), build)
    assert got == {"new": 2, "changed": 10, "same": 2990, "buckets": got["buckets"]} and got["buckets"] <= 12
    assert seen.value == 3012
    after = files(path)
    assert len({os.path.dirname(f) for f in before - after}) == got["buckets"] and len(before & after) >= 64 - 12
    now = buckets.table(spark, path)
    want = sinks.upserted(frame(spark, rows), frame(spark, again), ["id"])
    key = lambda r: (r.id, r.content, r.source)
    assert sorted(map(key, now.collect())) == sorted(map(key, want.collect()))
    assert all(r.embedding == held[r.id] for r in now.where("content like 'text%'").collect()) and all(len(r.embedding) == 8 for r in now.collect())
    assert buckets.upsert(spark, path, frame(spark, again), build) == {"new": 0, "changed": 0, "same": 3002, "buckets": 0} and seen.value == 3012 and files(path) == after
    assert "IN (1,2)" in buckets.table(spark, path, [1, 2])._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]


def test_ties_nulls_and_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    buckets.create(frame(spark, [(1, "a", "x"), (None, "null key", None), (2, None, "x")]), path, ["id"], "digest", 4)
    rows = frame(spark, [(1, "b", "1"), (1, "c", "2"), (None, "changed", None), (2, None, "x"), (3, "", None), (3, None, None)])
    got = buckets.upsert(spark, path, rows, order="source")
    assert (got["new"], got["changed"], got["same"]) == (1, 2, 1)
    held = {r.id: r.content for r in buckets.table(spark, path).collect()}
    assert held[1] == "c" and held[None] == "changed" and held[2] is None and len(held) == 4
    assert buckets.upsert(spark, path, rows.limit(0))["buckets"] == 0 and buckets.table(spark, path).count() == 4


def test_delete_writes_only_the_buckets_it_touches(spark, tmp_path):
    path = str(tmp_path / "t")
    buckets.create(frame(spark, [(k, f"t{k}", "a" if k == 5 else "b") for k in range(40)]), path, ["id"], "digest", 32)
    before = files(path)
    assert buckets.delete(spark, path, F.col("source") == "a") == 1 and len(before - files(path)) == 1
    assert sorted(r.id for r in buckets.table(spark, path).collect()) == [k for k in range(40) if k != 5]
    assert buckets.delete(spark, path, F.col("source") == "none") == 0 and buckets.delete(spark, path, F.col("id") >= 0) == 39 and not files(path)


@pytest.mark.parametrize("n", [1, 7])
def test_several_columns_make_a_key(spark, tmp_path, n):
    path = str(tmp_path / "t")
    rows = [(k, f"c{k}", f"s{k % n}") for k in range(20)]
    buckets.create(frame(spark, rows), path, ["source", "id"], "digest", 8)
    got = buckets.upsert(spark, path, frame(spark, [(k, "new", f"s{k % n}") for k in range(15, 25)]))
    assert (got["new"], got["changed"], got["same"]) == (5, 5, 0) and buckets.table(spark, path).count() == 25


def test_whole_rows_are_moved_once_a_step(spark, tmp_path, monkeypatch):
    """Keys and digests decide what is new or changed; whole rows are dealt out once for what is written, and not at all to delete."""
    path, aside, dealt = str(tmp_path / "t"), [], []
    written, write = buckets.written, buckets._write
    monkeypatch.setattr(buckets, "written", lambda df, name: (aside.append((name, df.columns)), written(df, name))[1])
    monkeypatch.setattr(buckets, "_write", lambda rows, path: (dealt.append(rows._jdf.queryExecution().executedPlan().toString().count("Exchange ")), write(rows, path))[1])
    rows = [(k, f"text {k}", "s") for k in range(200)]
    buckets.create(frame(spark, rows + [(3, "twice", "s")]), path, ["id"], "digest", 8)
    got = buckets.upsert(spark, path, frame(spark, [(k, "other" if k < 5 else t, s) for k, t, s in rows] + [(900, "new", "s"), (900, "new", "s")]))
    assert (got["new"], got["changed"], got["same"]) == (1, 5, 195) and [name for name, columns in aside if "content" in columns] == ["fresh"]
    aside.clear()
    assert buckets.delete(spark, path, F.col("id") < 2) == 2 and not aside and dealt == [1, 1, 0]
    assert sorted((r.id, r.content) for r in buckets.table(spark, path).collect()) == [(k, "other" if k < 5 else f"text {k}") for k in range(2, 200)] + [(900, "new")]
