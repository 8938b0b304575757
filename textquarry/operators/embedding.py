"""UDF1, VEC4: an embedder plugged in as a function, called with batches of a fixed size, and passages indexed with its vectors.

An embedder takes a list of texts and a mode, document or query, and gives a vector for each, in order. It is called with
BATCH texts at a time whatever the size of the frames that rows arrive in; a task's last call may be smaller. Null and blank
texts are not sent and have no vector. An answer of another number or width, or a component that is no finite number, fails the query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.operators.chunking import passages

BATCH = 512
MODES = ("document", "query")

Embedder = Callable[[list[str], str], "np.ndarray | list[list[float]]"]


def checked(vectors, count: int, dimension: int) -> np.ndarray:
    """The vectors as a matrix, if they are as many and as wide as asked for."""
    rows = np.asarray([np.asarray(v, np.float64).ravel() for v in vectors], dtype=object) if not isinstance(vectors, np.ndarray) else vectors
    if len(rows) != count:
        raise ValueError(f"the embedder gave {len(rows)} vectors for {count} texts")
    wrong = {len(v) for v in rows} - {dimension}
    if wrong:
        raise ValueError(f"the embedder gave vectors of {sorted(wrong)} components instead of {dimension}")
    matrix = np.array([np.asarray(v, np.float64) for v in rows]).reshape(count, dimension)
    if not np.isfinite(matrix).all():
        raise ValueError("the embedder gave a component that is no finite number")
    return matrix


def full_batches(batches: Iterator[pa.RecordBatch], at: int, size: int) -> Iterator[pa.Table]:
    """The rows in order, in tables with size texts to be sent each, but for the last."""
    held: list[pa.RecordBatch] = []
    have = 0
    for batch in batches:
        sent = np.cumsum([bool(t and t.strip()) for t in batch.column(at).to_pylist()])
        begin = taken = 0
        while batch.num_rows and have + int(sent[-1]) - taken >= size:
            end = int(np.searchsorted(sent, taken + size - have)) + 1
            yield pa.Table.from_batches([*held, batch.slice(begin, end - begin)])
            begin, taken, held, have = end, int(sent[end - 1]), [], 0
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
            have += int(sent[-1]) - taken
    if held:
        yield pa.Table.from_batches(held)


def embedded(rows: DataFrame, column: str, embed: Embedder, dimension: int, mode: str = "document", batch: int = BATCH, output: str = "embedding") -> DataFrame:
    """rows with the vector of a text column, null for null and blank texts."""
    if mode not in MODES:
        raise ValueError(f"the mode is one of {MODES}, not {mode!r}")
    at = rows.columns.index(column)
    names = [*rows.columns, output]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in full_batches(batches, at, batch):
            texts = table.column(at).to_pylist()
            sent = [k for k, t in enumerate(texts) if t and t.strip()]
            vectors = checked(embed([texts[k] for k in sent], mode), len(sent), dimension) if sent else np.zeros((0, dimension))
            own: list = [None] * len(texts)
            for k, v in zip(sent, vectors.astype(np.float32)):
                own[k] = v
            columns = [*(c.combine_chunks() for c in table.columns), pa.array(own, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], names=names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(output, T.ArrayType(T.FloatType()))]))


def indexed_passages(docs: DataFrame, key: str, metadata: list[str], embed: Embedder, dimension: int, batch: int = BATCH) -> DataFrame:
    """VEC4: id (key:chunk_no), the key, chunk_no, start, content, metadata columns and embedding of every passage of docs(key, text, metadata...)."""
    if clash := {key, *metadata} & {"id", "chunk_no", "start", "content", "embedding"}:
        raise ValueError(f"an index has columns with names of its own: {sorted(clash)}")
    chunks = passages(docs.where(F.length("text") > 0).select(key, "text"), [key])
    chunks = chunks.select(F.concat_ws(":", key, "chunk_no").alias("id"), key, "chunk_no", "start", "content")
    told = chunks.join(docs.select(key, *metadata), key) if metadata else chunks
    return embedded(told, "content", embed, dimension, batch=batch)
