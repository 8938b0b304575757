"""Exact deduplication against brute force: nulls, ties, repeats, long texts, clashing columns, clashing identifiers."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.llm import copies

DOCS = "doc_id bigint, text string, row string, recipe string, size string, digest string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], DOCS)


def texts():
    long = "".join(f"Sentence {k} of a long text{'.' if k % 3 else ','} " for k in range(9000))
    return [
        (1, "same"), (7, "same"), (3, "same"), (4, None), (9, ""), (5, " "), (None, "same"), (11, "same "), (12, long), (13, long), (14, long[:-1]), (15, "x" + long),
        (16, "a" * 20_000), (17, "a" * 20_000), (18, "a" * 19_999), (19, "\U0001f600" * 9000), (20, "\U0001f600" * 9000), (21, "Unique text."), (None, "alone"), (22, "tie"), (22, "tie"), (22, "tie"), (21, "tie"), (23, "é"), (24, "é"),
    ]


def test_classes_equal_brute_force(spark):
    rows = texts()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    got = copies.classes(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = defaultdict(list)
    for r in got:
        ids = by_digest[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
        if r.kept:
            kept[r.text_sha256].append(r.doc_id)
    assert {k: len(v) for k, v in kept.items()} == dict.fromkeys(by_digest, 1)  # one row of each text stays, also among ties
    assert all(v[0] == max((i for i in by_digest[k] if i is not None), default=None) for k, v in kept.items())


def test_rows_that_stay_keep_their_columns(spark):
    docs = docs_of(spark, texts())
    out = copies.one_of_each(docs)
    assert out.columns == docs.columns and out.count() == len({t or "" for _, t in texts()})


def test_nothing(spark):
    assert copies.classes(docs_of(spark, [])).count() == 0
    only_null = copies.classes(docs_of(spark, [(None, None), (None, "")])).collect()
    assert [r.group_size for r in only_null] == [2, 2] and sum(r.kept for r in only_null) == 1


@pytest.mark.parametrize("text", ["", "a", "no end at all " * 900, "Short. Ends! Here?\n" * 900, "日本語。" * 3000])
def test_chunks_tile_the_text(spark, text):
    chunks = spark.createDataFrame([(text,)], "text string").select(copies.chunk_list(F.col("text"))).first()[0]
    assert "".join(chunks) == text and all(len(c) <= copies.MOST for c in chunks) and all(len(c) >= copies.LEAST for c in chunks[:-1])


def test_equal_passages_are_cut_alike(spark):
    rng = np.random.default_rng(5)
    body = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(20_000))
    a, b = (set(r[0]) for r in spark.createDataFrame([("Head. " + body,), ("Another, longer head of the page. " * 20 + body,)], "text string").select(copies.chunk_list(F.col("text"))).collect())
    assert len(a & b) > 0.8 * len(a)


def test_identifiers_are_drawn_anew_when_two_chunks_share_one(spark, monkeypatch):
    real = copies.identifier
    monkeypatch.setattr(copies, "identifier", lambda chunk, salt: F.md5(F.substring(chunk, 1, 1)) if salt == 0 else real(chunk, salt))
    docs = docs_of(spark, [(1, "alpha"), (2, "apple"), (3, "alpha")])
    assert copies.clashes(docs, 0).count() == 1 and copies.verified_salt(docs) == 1
    assert {r.doc_id: r.keep_id for r in copies.classes(docs).collect()} == {1: 3, 2: 2, 3: 3}


def test_the_plan_has_no_python(spark):
    plan = copies.classes(docs_of(spark, texts()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
