"""Packing and merging of made pages against the recursive SQL: headings, short paragraphs, long words, blank runs, other scripts."""

import random

import duckdb
import pyarrow as pa

from textquarry import catalog
from textquarry.operators import chunking


def page(seed):
    rng, out = random.Random(seed), []
    words = ["word", "a", "sentence.", "été", "日本語", "x" * rng.choice([5, 1300]), "# note", "\t", "end. "]
    for _ in range(rng.randrange(1, 14)):
        kind = rng.random()
        if kind < 0.25:
            out.append("#" * rng.randrange(1, 4) + " Heading " + rng.choice(["", "of it"]))
        elif kind < 0.4:
            out.append(rng.choice(["tiny", "   ", "# ", "."]))
        else:
            out.append(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 260))))
    return rng.choice(["\n\n", "\n", "\n\n\n", ". "]).join(out)


def test_passages_equal_the_recursive_sql(spark):
    texts = [page(seed) for seed in range(150)] + ["a", " ", "\n", "x" * 5000, "y " * 3000, "# only", "\n\n" * 800, "s. " * 1000]
    rows = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})
    db = duckdb.connect()
    db.register("documents", rows)
    want = sorted(db.execute(catalog.ORACLES["chk3_passages"]).fetchall())
    got = sorted(map(tuple, chunking.passages(spark.createDataFrame(rows), ["doc_id"]).collect()))
    assert got == want
    sizes = [len(t) for *_, t in got]
    assert max(sizes) <= 1100 and sum(s < 100 for s in sizes) < len(sizes) / 4


def test_a_worker_takes_up_a_bounded_part_of_a_batch(monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["x" * 40, None, "", "y" * 500, "z" * 60, "é" * 20, "w"])], names=["k", "text"])
    monkeypatch.setattr(chunking, "HELD", 100)
    parts = list(chunking._slices(batch, 1))
    assert [p.num_rows for p in parts] == [3, 1, 2, 1] and pa.Table.from_batches(parts).to_pydict() == pa.Table.from_batches([batch]).to_pydict()
    assert not list(chunking._slices(batch.slice(0, 0), 1))
