"""Approximate nearest neighbours by cross-polytope hashing, largest inner product first.

A hash multiplies a unit vector by three rounds of random signs and a fast Hadamard transform, and takes
the two signed axes nearest to the result, or the nearest one where that alone makes as many buckets. TABLES such hashes
are made; a query probes its best buckets in each, in the order of its own coordinates along their axes. Candidates are
the vectors in a probed bucket, each once however many tables it is met in; they are reranked by the inner product of the
original vectors in double precision.

How many buckets are probed is fitted to the table, by one rule at every size and width. FITTED of the queries, those with
the least hashes of their ids, are searched exactly, in one scan. For each of their k nearest it is known at which probe its
bucket comes up first in any table, and the number of probes is that within which RECALL of them come up. Large inner products
need not be small angles where norms differ, so it is fitted to each range of norms with a ratio of RATIO in which as many as
RANGE of those neighbours lie, over all of them for the others, and is one where none lies. Where even all probes would miss
more than a tenth (a few vectors in one direction can do that), all buckets are open.

The queries are the stated set and go to the tasks in blocks of at most QUERY_BLOCK; vectors are never
shuffled or replicated. Every task keeps each query's k best, and those are merged. A query with fewer
than k found is searched exactly in the same way with every bucket open, so it gets all it can have.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do
those of another length than the most frequent one (the longer at a tie) or rows with a null id; a row
with the query's own id is no candidate; rows that repeat an id count once, with their best score; ties go
to the smaller id; empty tables give no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.llm.shared import stored

TABLES = 96
#: Queries that the number of probes is fitted to, the share of their neighbours that it has to reach, and of a range's own fit at least so many.
FITTED, RECALL, RANGE = 96, 0.95, 64
#: Buckets that one axis should make for it to be a key alone.
BUCKETS = 512
#: Queries that go to the tasks at once, and bytes of their probes.
QUERY_BLOCK, PROBE_BYTES = 4096, 32 << 20
#: Queries and vectors whose scores are held at once, and vectors that are hashed at once.
TILE_QUERIES, TILE_VECTORS, HASHED = 256, 16_384, 1024
#: Sizes up to which a rotation is applied as one matrix, which is the same map.
DENSE = 256
#: Ratio of a range's norms.
RATIO = 1.1
RESULT = "query_id bigint, vec_id bigint, score double"


class Hashes:
    """The tables' rotations and bucket keys, and how many of its buckets a query probes for vectors of each range of norms."""

    def __init__(self, dimension: int, tables: int = TABLES, seed: int = 11):
        self.size = 1 << max(1, (dimension - 1).bit_length()) if dimension > 1 else 2
        self.signs = np.random.default_rng(seed).choice(np.float32([-1, 1]), (tables, 3, self.size))
        self.two = 2 * self.size < BUCKETS
        #: Buckets that a query has an order for: those on its own side of each axis.
        self.most = self.size * (self.size - 1) // 2 if self.two else self.size
        self.dense = [self._turned(np.eye(self.size, dtype=np.float32), t) for t in range(tables)] if self.size <= DENSE else None
        self.ranges, self.limits, self.probes = np.zeros(0, np.int64), np.zeros(0, np.int64), 1

    def first_probes(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """For pairs of unit vectors, at which probe of q (from 1) x comes up first in any table; beyond the last if in none."""
        first = np.full(len(x), self.most + 1)
        asking, pair = np.unique(q, axis=0, return_inverse=True)
        for t in range(len(self.signs)):
            order = self.probed(self.rotated(asking, t), self.most)
            key = self._key(self.rotated(x, t))
            for at in range(0, len(x), HASHED):
                same = order[pair[at : at + HASHED]] == key[at : at + HASHED, None]
                found = np.where(same.any(axis=1), same.argmax(axis=1) + 1, self.most + 1)
                first[at : at + HASHED] = np.minimum(first[at : at + HASHED], found)
        return first

    def fit(self, q: np.ndarray, x: np.ndarray) -> float:
        """Set the number of probes from queries and their true neighbours; the share of these that is reached."""
        first, place = self.first_probes(unit(q), unit(x)), norm_range(x)
        reach = lambda own: int(min(self.most, np.quantile(own, RECALL, method="higher")))
        self.ranges = np.unique(place)
        self.limits = np.array([reach(first[place == g]) if (place == g).sum() >= RANGE else reach(first) for g in self.ranges], np.int64)
        self.probes = int(self.limits.max())
        return float((first <= self.limits[np.searchsorted(self.ranges, place)]).mean())

    def limit(self, x: np.ndarray) -> np.ndarray:
        """Of each vector, within how many of a query's probes it counts."""
        place = norm_range(x)
        at = np.minimum(np.searchsorted(self.ranges, place), max(0, len(self.ranges) - 1))
        return np.where(self.ranges[at] == place, self.limits[at], 1) if len(self.ranges) else np.ones(len(x), np.int64)

    def _turned(self, y: np.ndarray, table: int) -> np.ndarray:
        for signs in self.signs[table]:
            y = hadamard(y * signs)
        return y

    def rotated(self, x: np.ndarray, table: int) -> np.ndarray:
        """A table's rotation of unit vectors."""
        y = np.zeros((len(x), self.size), np.float32)
        y[:, : x.shape[1]] = x
        return self._turned(y, table) if self.dense is None else y @ self.dense[table]

    def keys(self, units: np.ndarray) -> np.ndarray:
        """The buckets of unit vectors, tables x rows; few rows at a time, whose rotations stay in the processor's cache."""
        parts = [units[at : at + HASHED] for at in range(0, len(units), HASHED)]
        return np.stack([np.concatenate([self._key(self.rotated(part, t)) for part in parts]) for t in range(len(self.signs))])

    def _key(self, y: np.ndarray) -> np.ndarray:
        size, rows = np.abs(y), np.arange(len(y))
        a = size.argmax(axis=1)
        first = 2 * a + (y[rows, a] > 0)
        if not self.two:
            return first
        size[rows, a] = -1
        b = size.argmax(axis=1)
        second = 2 * b + (y[rows, b] > 0)
        return np.minimum(first, second) * (2 * self.size) + np.maximum(first, second)

    def probed(self, y: np.ndarray, n: int) -> np.ndarray:
        """The n buckets of each rotated row with the largest coordinates along their axes, largest first."""
        size = np.abs(y)
        wide = min(self.size, n if not self.two else n + 1)  # a pair with the j-th axis comes after j - 1 others
        best = np.argpartition(-size, wide - 1, axis=1)[:, :wide] if wide < self.size else np.broadcast_to(np.arange(self.size), y.shape)
        found = np.take_along_axis(size, best, 1)
        order = np.argsort(-found, axis=1, kind="stable")
        best, found = np.take_along_axis(best, order, 1), np.take_along_axis(found, order, 1)
        axes = best * 2 + (np.take_along_axis(y, best, 1) > 0)
        if not self.two:
            return axes[:, :n]
        i, j = np.triu_indices(wide, 1)
        both = np.argsort(-(found[:, i] + found[:, j]), axis=1, kind="stable")[:, :n]
        a, b = np.take_along_axis(axes, i[both], 1), np.take_along_axis(axes, j[both], 1)
        return np.minimum(a, b) * (2 * self.size) + np.maximum(a, b)


def norm_range(x: np.ndarray) -> np.ndarray:
    """The number of each row's range of norms; components are scaled first, so that no square overflows or vanishes."""
    most = np.abs(x).max(axis=1)
    log_norm = np.log(most) + np.log(np.square(x / most[:, None]).sum(axis=1)) / 2
    return np.floor(log_norm / math.log(RATIO) + 0.5).astype(np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    """The rows at length 1; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


def hadamard(y: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep their length."""
    n, step = y.shape[1], 1
    while step < n:
        y = y.reshape(len(y), -1, 2, step)
        y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2)
        y = y.reshape(len(y), n)
        step *= 2
    return y * np.float32(n**-0.5)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array<double>) of the rows that take part in any search."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("embedding")).where("vec_id is not null and embedding is not null")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(finite & F.exists("embedding", lambda x: x != 0))


def nearest(vectors: DataFrame, is_query, k: int = 20, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of every row that fulfils is_query."""
    rows = usable(vectors)
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = rows.where(F.size("embedding") == sizes[0].d)
    queries = rows.where(is_query)
    if exact:
        return stored(_merged(_searched(rows, queries, None, k), k), "nearest")
    hashes = _fitted(rows, queries, sizes[0].d, k)
    found = stored(_merged(_searched(rows, queries, hashes, k), k), "nearest")
    # Too few found: all candidates are looked at for those queries, whose number falls with recall.
    enough = found.groupBy("query_id").count().where(F.col("count") >= min(k, max(0, rows.select("vec_id").distinct().count() - 1)))
    short = queries.join(enough, queries.vec_id == enough.query_id, "left_anti")
    if short.isEmpty():
        return found
    again = _merged(_searched(rows, short, None, k), k)
    return found.join(enough, "query_id", "left_semi").unionByName(again)


def _fitted(rows: DataFrame, queries: DataFrame, dimension: int, k: int) -> Hashes | None:
    """Hashes with the number of probes that the table needs; None where all buckets have to be open."""
    some = queries.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(FITTED)  # a fixed number
    asked = {r.vec_id: r.embedding for r in some.collect()}
    chosen = queries.where(F.col("vec_id").isin(*asked)) if asked else queries
    true = _merged(_searched(rows, chosen, None, k), k).select("query_id", "vec_id").collect()  # k for each
    hashes = Hashes(dimension)
    if not true:
        return hashes
    ids = rows.sparkSession.createDataFrame([(v,) for v in {r.vec_id for r in true}], "near bigint")
    near = {r.vec_id: r.embedding for r in rows.join(F.broadcast(ids), F.col("vec_id") == F.col("near"), "left_semi").groupBy("vec_id").agg(F.min("embedding").alias("embedding")).collect()}
    reached = hashes.fit(np.array([asked[r.query_id] for r in true]), np.array([near[r.vec_id] for r in true]))
    return hashes if reached >= 0.9 else None


def _merged(found: DataFrame, k: int) -> DataFrame:
    best = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _searched(rows: DataFrame, queries: DataFrame, hashes: Hashes | None, k: int) -> DataFrame:
    """Each task's k best for each query, one query block after the other; every bucket is open without hashes."""
    total = queries.count()
    block = QUERY_BLOCK if hashes is None else max(TILE_QUERIES, min(QUERY_BLOCK, PROBE_BYTES // (4 * TABLES * hashes.probes)))
    blocks = 1 if total <= block else math.ceil(2 * total / block)
    parts = []
    for block in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block)
        parts.append(_one_block(rows, part, hashes, k))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _one_block(rows: DataFrame, queries: DataFrame, hashes: Hashes | None, k: int) -> DataFrame:
    # At most a block; of rows that repeat an id the least vector asks.
    held = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).orderBy("vec_id").collect()
    ids = np.array([r[0] for r in held], np.int64)
    matrix = np.array([r[1] for r in held], np.float64).reshape(len(held), -1)
    units = None if hashes is None or not len(ids) else unit(matrix)
    probes = None if units is None else np.stack([hashes.probed(hashes.rotated(units, t), hashes.probes).astype(np.int32) for t in range(TABLES)])
    shipped = rows.sparkSession.sparkContext.broadcast((ids, matrix, probes, hashes))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        ids, matrix, probes, hashes = shipped.value
        best = Best(len(ids), k)
        for batch in batches:
            if not len(ids) or not batch.num_rows:
                continue
            own = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy().reshape(len(own), -1)
            for at in range(0, len(own), TILE_VECTORS):
                tile(own[at : at + TILE_VECTORS], x[at : at + TILE_VECTORS], ids, matrix, probes, hashes, best)
        q, v, s = best.rows()
        for at in range(0, len(q), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(ids[q[at : at + 100_000]]), pa.array(v[at : at + 100_000]), pa.array(s[at : at + 100_000])], schema=schema)

    return rows.mapInArrow(run, RESULT)


def met(probes: np.ndarray, keys: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) pairs of one table: probes is queries x probes, keys the vectors' buckets, limit the probes that count for them."""
    order = np.argsort(keys, kind="stable")
    wanted = probes.ravel()
    own = keys[order]
    low = np.searchsorted(own, wanted, "left")
    n = np.searchsorted(own, wanted, "right") - low
    past = np.cumsum(n)
    at = np.repeat(low - (past - n), n) + np.arange(past[-1] if len(past) else 0)
    query, probe = np.divmod(np.repeat(np.arange(len(wanted)), n), probes.shape[1])
    vector = order[at]
    counts = probe < limit[vector]
    return query[counts], vector[counts]


def tile(own, x, ids, matrix, probes, hashes, best) -> None:
    units = None if probes is None else unit(x)
    keys = None if probes is None else hashes.keys(units)
    limit = None if probes is None else hashes.limit(x)
    for start in range(0, len(ids), TILE_QUERIES):
        q = matrix[start : start + TILE_QUERIES]
        if keys is None:
            scores = q @ x.T
        else:
            candidate = np.zeros((len(q), len(x)), bool)
            for t, bucket in enumerate(keys):
                candidate[met(probes[t, start : start + TILE_QUERIES], bucket, limit)] = True
            scores = np.full(candidate.shape, -np.inf)
            for k, row in enumerate(candidate):
                at = np.flatnonzero(row)
                scores[k, at] = x[at] @ q[k]
        scores[ids[start : start + TILE_QUERIES, None] == own[None, :]] = -np.inf
        best.offer(start, scores, own)


class Best:
    """The k best of each query so far: higher score first, then the smaller id; an id counts once."""

    def __init__(self, n: int, k: int):
        self.k, self.ids, self.scores = k, np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -np.inf)

    def offer(self, start: int, scores: np.ndarray, own: np.ndarray) -> None:
        n, k = len(scores), self.k
        before_s, before_i = self.scores[start : start + n], self.ids[start : start + n]
        # Only scores that reach a query's k-th best so far matter; ties are kept for the smaller id.
        rows, columns = np.nonzero((scores >= before_s[:, -1:]) & (scores > -np.inf))
        if not len(rows):
            return
        some = np.unique(rows)
        at = np.concatenate([np.repeat(some, k), rows])
        s = np.concatenate([before_s[some].ravel(), scores[rows, columns]])
        i = np.concatenate([before_i[some].ravel(), own[columns]])
        real = s > -np.inf
        at, s, i = at[real], s[real], i[real]
        order = np.lexsort((-s, i, at))  # one row for each query and id, its best score
        at, s, i = at[order], s[order], i[order]
        once = np.r_[True, (at[1:] != at[:-1]) | (i[1:] != i[:-1])]
        at, s, i = at[once], s[once], i[once]
        order = np.lexsort((i, -s, at))
        at, s, i = at[order], s[order], i[order]
        first = np.searchsorted(at, at)
        place = np.arange(len(at)) - first
        keep = place < k
        self.scores[start + some], self.ids[start + some] = -np.inf, np.iinfo(np.int64).max
        self.scores[start + at[keep], place[keep]], self.ids[start + at[keep], place[keep]] = s[keep], i[keep]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, p = np.nonzero(self.scores > -np.inf)
        return q, self.ids[q, p], self.scores[q, p]
