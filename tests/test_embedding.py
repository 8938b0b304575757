"""Embedders as functions: batches of a fixed size across frames, order, modes, what is not sent, and answers that are wrong."""

import numpy as np
import pyarrow as pa
import pytest

from textquarry.operators import embedding


letters = lambda texts, mode: [[t.count("a"), len(t), 1.0 if mode == "query" else 0.0] for t in texts]  # noqa: E731  goes to workers by value


def test_calls_have_a_fixed_size_whatever_the_frames():
    texts = [None if k % 7 == 3 else "" if k % 11 == 5 else " " if k % 13 == 6 else f"t{k}" for k in range(997)]
    sizes = [1, 30, 2, 300, 0, 64, 500, 100]
    batches, at = [], 0
    for n in sizes:
        batches.append(pa.RecordBatch.from_arrays([pa.array(range(at, min(997, at + n)), pa.int64()), pa.array(texts[at : at + n], pa.string())], names=["id", "text"]))
        at += n
    tables = list(embedding.full_batches(iter(batches), 1, 50))
    sent = [sum(bool(t and t.strip()) for t in table.column("text").to_pylist()) for table in tables]
    assert set(sent[:-1]) == {50} and 0 < sent[-1] <= 50 or sent[-1] == 0
    assert [i for table in tables for i in table.column("id").to_pylist()] == list(range(997))


@pytest.mark.parametrize("mode", embedding.MODES)
def test_vectors_stay_with_their_rows(spark, mode):
    rows = spark.createDataFrame([(k, None if k % 5 == 0 else "  " if k % 5 == 1 else "a" * k, "x") for k in range(300)], "id int, text string, embedding_ string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = embedding.embedded(rows, "text", letters, 3, mode, batch=8).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 300 and all(r.embedding == (None if r.id % 5 < 2 else [r.id, r.id, float(mode == "query")]) for r in got)


@pytest.mark.parametrize("answer, said", [(lambda t, m: [[1.0, 2.0]], "vectors for"), (lambda t, m: [[1.0]] * len(t), "components"), (lambda t, m: np.full((len(t), 2), np.nan), "finite"), (lambda t, m: 1 / 0, "ZeroDivisionError")])
def test_wrong_answers_fail(spark, answer, said):
    rows = spark.createDataFrame([(k, "some text") for k in range(3)], "id int, text string").coalesce(1)
    with pytest.raises(Exception, match=said):
        embedding.embedded(rows, "text", answer, 2).collect()


def test_modes_and_nothing(spark):
    none = spark.createDataFrame([], "id int, text string")
    assert embedding.embedded(none, "text", letters, 3).count() == 0 and embedding.indexed_passages(none.withColumnRenamed("id", "doc"), "doc", [], letters, 3).count() == 0
    with pytest.raises(ValueError, match="names of its own"):
        embedding.indexed_passages(none, "id", [], letters, 3)
    with pytest.raises(ValueError, match="mode"):
        embedding.embedded(none, "text", letters, 3, "passage")
