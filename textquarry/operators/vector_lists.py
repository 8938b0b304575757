"""VEC2: an inverted-file store of vectors, written once partitioned by list, and searched with pruning.

A list holds the vectors that are nearest to its centre. The store is a Parquet folder partitioned by list, long lists in
several files dealt by id, so that no list is one task's work; the centres lie beside it. A search finds each question's
nearest lists, reads those lists alone (a partition filter), and scores a file's vectors only against the questions that
probe their list, in blocks of Arrow batches. Every task keeps the k best of a question, so vectors are never shuffled.

Defined cases: vectors null, or of another width than the centres, are not stored; questions without a vector, or of
another width, have no hits; ties go to the smaller id; an empty store or no questions give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.operators.vectors import QUESTION_BLOCK, as_matrix, best, fit_lists, grouped_tasks, keep_best, scored

#: Vectors of one file of a list.
FILE_ROWS = 250_000
#: Centres go to every task; more bytes than this are refused.
CENTRE_BYTES = 512 << 20
#: Rows, and centres or vectors, that are compared at once: a tile of distances is bounded, however many centres there are.
ROWS, COLUMNS = 1024, 2048


def kmeans_centres(vectors: DataFrame, lists: int | None = None, sample_rows: int = 50_000, seed: int = 3) -> np.ndarray:
    """Centres from a bounded sample; as many lists as the rule for the table's size says, unless given."""
    return np.array(fit_lists(vectors, sample_rows, seed, lists).clusterCenters(), np.float64)


def sampled_centres(vectors: DataFrame, chosen) -> np.ndarray:
    """Centres that are vectors themselves: those where chosen holds, in the order of their ids."""
    return _matrix(vectors.where(chosen).where("embedding is not null").orderBy("id").select(F.col("embedding").cast("array<double>")))


def _matrix(rows: DataFrame) -> np.ndarray:
    """The only column's vectors, which are of one width, through Arrow."""
    column = rows.toArrow().column(0)
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0,))


def nearest_centres(x: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """The places of the nearest centres of each row, nearest first, ties to the earlier one; in tiles of bounded size.

    Tiles propose what may be among the nearest within the rounding of products; those distances alone are taken from the differences.
    """
    k = min(probes, len(centres))
    out, size = np.tile(np.arange(k), (len(x), 1)), (centres**2).sum(axis=1)
    for low in range(0, len(x), ROWS):
        own = x[low : low + ROWS]
        slack = 1e-12 * ((own**2).sum(axis=1) + np.nanmax(size, initial=0.0))
        bound, held = np.full(len(own), np.inf), []
        for first in range(0, len(centres), COLUMNS):
            d = size[None, first : first + COLUMNS] - 2 * own @ centres[first : first + COLUMNS].T
            if d.shape[1] >= k:
                bound = np.fmin(bound, np.partition(d, k - 1, axis=1)[:, k - 1])
            r, c = np.nonzero(d <= (bound + slack)[:, None])
            held.append((r, c + first, d[r, c]))
        r, c, d = (np.concatenate([h[n] for h in held]) for n in range(3))
        near = d <= (bound + slack)[r]
        r, c = r[near], c[near]
        exact = np.concatenate([np.zeros(0), *(((own[r[at : at + 32 * ROWS]] - centres[c[at : at + 32 * ROWS]]) ** 2).sum(axis=1) for at in range(0, len(r), 32 * ROWS))])
        order = np.lexsort((c, exact, r))
        r, c = r[order], c[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        out[low + r[place < k], place[place < k]] = c[place < k]
        for row in np.flatnonzero(np.bincount(r, minlength=len(own)) < k):  # distances that are no numbers
            out[low + row] = np.argsort(size - 2 * centres @ own[row], kind="stable")[:k]
    return out


def first_copies(centres: np.ndarray, most: int) -> np.ndarray:
    """The numbers of the centres, without those that equal so many before them: they are never among so many nearest."""
    _, group = np.unique(centres, axis=0, return_inverse=True)
    order = np.argsort(group, kind="stable")
    place = np.arange(len(order)) - np.searchsorted(group[order], group[order])
    return np.sort(order[place < most])


def matrix_of(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a vector of the width, and their vectors."""
    fits = np.flatnonzero(np.array([x.is_valid and len(x) == width and None not in x.as_py() for x in lists], bool)) if lists.null_count or not regular(lists, width) else np.arange(len(lists))
    return fits, lists.take(pa.array(fits, pa.int64())).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fits), width)


def regular(lists: pa.Array, width: int) -> bool:
    return bool((np.diff(lists.offsets.to_numpy()) == width).all()) and not lists.flatten().null_count


def with_lists(rows: DataFrame, centres: np.ndarray, probes: int, column: str = "embedding") -> DataFrame:
    """rows with lists: the numbers of the nearest centres; rows without a fitting vector are left out."""
    if centres.nbytes > CENTRE_BYTES:
        raise ValueError(f"{len(centres)} centres of {centres.shape[1]} components are too many to send to every task; take fewer lists")
    numbers = first_copies(centres, probes) if len(centres) else np.zeros(0, np.int64)
    shipped = rows.sparkSession.sparkContext.broadcast((centres[numbers], numbers))
    at = rows.columns.index(column)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, numbers = shipped.value
        for batch in batches:
            fits, x = matrix_of(batch.column(at), centres.shape[1])
            near = numbers[nearest_centres(x, centres, probes)] if len(fits) else np.zeros((0, 1), np.int64)
            own = batch.take(pa.array(fits, pa.int64()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(fits) + 1) * near.shape[1], pa.int32()), pa.array(near.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([*own.columns, lists], names=[*batch.schema.names, "lists"])

    return rows.mapInArrow(assign, T.StructType([*rows.schema.fields, T.StructField("lists", T.ArrayType(T.IntegerType()))]))


def write_lists(vectors: DataFrame, centres: np.ndarray, path: str) -> None:
    """Store vectors(id, embedding, ...) under path: vectors by list, and the centres."""
    spark = vectors.sparkSession
    own = with_lists(vectors.where("id is not null and embedding is not null"), centres, 1)
    own = own.withColumn("list_id", F.col("lists")[0]).drop("lists")
    sizes = own.groupBy("list_id").agg(F.ceil(F.count(F.lit(1)) / FILE_ROWS).cast("int").alias("files"))
    dealt = own.join(F.broadcast(sizes), "list_id")  # a row a list, of which there are as many as centres
    dealt = dealt.withColumn("file", F.pmod(F.xxhash64("id"), F.col("files"))).repartition("list_id", "file").drop("file", "files")
    dealt.sortWithinPartitions("list_id", "id").write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("list_id").parquet(f"{path}/vectors")
    own = pa.ListArray.from_arrays(pa.array(np.arange(len(centres) + 1) * centres.shape[-1], pa.int32()), pa.array(centres.ravel()))
    rows = pa.table({"list_id": pa.array(np.arange(len(centres)), pa.int32()), "centre": own})
    spark.createDataFrame(rows, "list_id int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")


def read_centres(spark: SparkSession, path: str) -> np.ndarray:
    return _matrix(spark.read.parquet(f"{path}/centres").orderBy("list_id").select("centre"))


def stored_vectors(spark: SparkSession, path: str, lists: list[int] | None = None) -> DataFrame:
    """The stored vectors, of these lists only: other folders are not read."""
    rows = spark.read.parquet(f"{path}/vectors")
    return rows if lists is None else rows.where(F.col("list_id").isin(*lists) if lists else F.lit(False))


def search(questions: DataFrame, path: str, k: int, probes: int, metric: str = "cosine", sources: list | None = None) -> DataFrame:
    """query_id, id, score, rank: the k best of each of questions(query_id, embedding) among its nearest lists.

    Questions go to the tasks in blocks of bounded size, neighbours in the order of lists together, so that a block reads few of them.
    """
    spark = questions.sparkSession
    centres = read_centres(spark, path)
    asked = with_lists(questions.select(F.col("query_id").cast("bigint"), F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null"), centres, probes)
    total = questions.count()
    parts = []
    for block in range(max(1, math.ceil(2 * total / QUESTION_BLOCK)) if total > QUESTION_BLOCK else 1):
        own = asked if total <= QUESTION_BLOCK else asked.where(F.floor(F.col("lists")[0] * F.lit(math.ceil(2 * total / QUESTION_BLOCK)) / len(centres)) == block)
        parts.append(_searched(spark, own, path, k, metric, sources))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return best(out, k)


def _searched(spark: SparkSession, asked: DataFrame, path: str, k: int, metric: str, sources: list | None) -> DataFrame:
    held = asked.collect()  # a block
    ids = np.array([r.query_id for r in held], np.int64)
    q = as_matrix([r.embedding for r in held])
    lists = as_matrix([r.lists for r in held]).astype(np.int64)
    order = np.argsort(lists.ravel(), kind="stable")
    names, first = np.unique(lists.ravel()[order], return_index=True)
    askers = dict(zip(names.tolist(), np.split(order // max(1, lists.shape[1]), first[1:])))
    shipped = spark.sparkContext.broadcast((ids, q, askers))
    rows = stored_vectors(spark, path, sorted(askers))
    if sources is not None:
        rows = rows.where(F.col("source").isin(*sources) if sources else F.lit(False))
    rows = rows.select(F.col("id").cast("bigint").alias("id"), F.col("embedding"), F.col("list_id").cast("int").alias("list_id"))
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, askers = shipped.value
        kept_s, kept_i = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        for batch in batches:
            fits, x = matrix_of(batch.column(1), q.shape[1])
            own, lists = batch.column(0).to_numpy()[fits], batch.column(2).to_numpy()[fits]
            for name in np.unique(lists).tolist():
                at, asking = np.flatnonzero(lists == name), askers[name]
                for tile in range(0, len(asking), ROWS):
                    some = asking[tile : tile + ROWS]
                    s, i = kept_s[some], kept_i[some]
                    for first in range(0, len(at), COLUMNS):
                        part = at[first : first + COLUMNS]
                        keep_best(s, i, scored(q[some], x[part], metric), own[part])
                    kept_s[some], kept_i[some] = s, i
        r, c = np.nonzero(np.isfinite(kept_s))
        yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(kept_i[r, c]), pa.array(kept_s[r, c])], schema=schema)

    return grouped_tasks(rows).mapInArrow(run, "query_id bigint, id bigint, score double")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact hits (query_id, id) that are found."""
    both = exact.select("query_id", "id").join(found.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi").count()
    return both / max(1, exact.count())
