"""Periodic runs against brute force over all periods: real and made texts, nulls, long texts, nested and neighbouring runs."""

import hashlib
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from textquarry.llm import periods, queries


def brute(words):
    """All runs as (start, length, period), by start and period: every lag in full, multiples dropped."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        k = 0
        while k < n - q:
            if words[k] != words[k + q]:
                k += 1
                continue
            e = k
            while e < n - q and words[e] == words[e + q]:
                e += 1
            if e - k + q >= max(24, 3 * q):
                found.setdefault((k, e - k + q), q)
            k = e
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_arrays(words):
    """The same, lag by lag over an array: for longer texts."""
    ids = np.unique(np.array(words, object), return_inverse=True)[1] if len(words) else np.zeros(0, int)
    found = {}
    for q in range(1, len(ids) // 3 + 1):
        equal = np.r_[False, ids[:-q] == ids[q:], False]
        turns = np.flatnonzero(equal[1:] != equal[:-1])
        for s, e in zip(turns[::2].tolist(), turns[1::2].tolist()):
            if e - s + q >= max(24, 3 * q):
                found.setdefault((s, e - s + q), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def expected(doc_id, text, planted, runs_of=brute):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if planted and doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = runs_of(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, n, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def made(seed, n, alphabet, pieces=6):
    """Words drawn from an alphabet, with stretches repeated."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(pieces):
        out += [f"w{x}" for x in rng.integers(0, alphabet, rng.integers(0, n))]
        block = [f"w{x}" for x in rng.integers(0, alphabet, rng.integers(1, n))]
        repeated = block * int(rng.integers(1, 9))
        out += repeated[: len(repeated) - int(rng.integers(0, len(block)))]
    return " ".join(out)


def as_tuple(r):
    return (r.doc_id, r.n_words, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)


def runs_of_texts(texts):
    flat, sizes = periods.words_of(pa.array(texts, pa.string()))
    ids = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(flat) else np.zeros(0, np.int64)
    return periods.batch_runs(ids, sizes)


@pytest.mark.parametrize("alphabet", [1, 2, 3, 20, 5000])
@pytest.mark.parametrize("n", [4, 20, 90])
def test_runs_equal_brute_force(alphabet, n):
    texts = [made(seed, n, alphabet) for seed in range(12)]
    assert runs_of_texts(texts) == [brute(t.split()) for t in texts]  # all in one array, so runs could meet across texts


def test_runs_of_words_of_a_small_alphabet_and_nested_runs():
    a, b = ["a", "b"]
    x, y = [a], [a, b]
    while len(y) < 3000:
        x, y = y, y + x  # the Fibonacci word: as many repetitions as a word can have
    inner = ["p"] * 30 + ["q"]
    texts = [" ".join(y), " ".join(inner * 5), " ".join((inner * 4 + ["r"]) * 4), "z " * 2000, " ".join(["a", "b"] * 12), " ".join(["a", "b"] * 11 + ["a"]), " ".join(f"k{i % 40}" for i in range(119)), " ".join(f"k{i % 40}" for i in range(120))]
    assert runs_of_texts(texts) == [brute_arrays(t.split()) for t in texts]


def test_query_equals_brute_force_on_the_table(spark, sf_dir):
    got = {r.doc_id: as_tuple(r) for r in queries.op12_periodic_runs(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert got == {r.doc_id: expected(r.doc_id, r.text, True, brute_arrays) for r in docs}
    assert sum(t[2] > 0 for t in got.values()) >= 15


def test_odd_rows(spark):
    planted = [k for k in range(400) if zlib.crc32(str(k).encode()) % 10 == 0][:8]
    rows = [(1, None), (2, ""), (3, " \t\n\r\x0b\x0c "), (4, "one"), (None, "a " * 30), (None, None), (5, "a " * 24), (5, "a " * 24), (6, "a " * 23), (7, "a a " * 40), (8, "x x\x1cx\x85" * 30)]
    rows += [(k, t) for k in planted for t in (None, "", "single", " ".join(f"v{i}" for i in range(100 + k)), "a b c")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id bigint, text string, n_runs string, planted string")
    from pyspark.sql import functions as F

    got = sorted(map(repr, map(as_tuple, periods.run_summaries(docs, planted=periods.planted_runs(F.col("doc_id"), F.col("text"))).collect())))
    assert got == sorted(repr(expected(i, t, True)) for i, t in rows)
    assert sorted(map(repr, map(as_tuple, periods.run_summaries(docs).collect()))) == sorted(repr(expected(i, t, False)) for i, t in rows)
    assert periods.run_summaries(docs.limit(0)).count() == 0


def test_collapsed_texts_have_each_period_once(spark):
    docs = spark.createDataFrame([(1, "start " + "one two three " * 20 + "end"), (2, "plain text"), (3, None)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in periods.collapsed_texts(docs).collect()}
    assert got[1].collapsed == "start one two three end" and [tuple(r) for r in got[1].runs] == [(1, 60, 3)]
    assert got[2].collapsed == "plain text" and got[3].collapsed == "" and got[3].n_runs == 0


def test_long_texts_take_time_in_proportion():
    rng = np.random.default_rng(1)
    block = [f"w{x}" for x in rng.integers(0, 300, 60_000)]
    text = " ".join([f"w{x}" for x in rng.integers(0, 300, 200_000)] + block * 4 + ["same"] * 100_000)
    began = time.time()
    got = runs_of_texts([text])[0]
    assert (200_000, 240_000, 60_000) in [(s, m, q) for s, m, q in got if q > 32] and got[-1][1:] == (100_000, 1) and time.time() - began < 20
