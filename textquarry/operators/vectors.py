"""Vector collections: exact and partitioned search for many questions at once, validation and indexing."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Questions whose vectors go to the tasks at once.
QUESTION_BLOCK = 8192
#: Tasks of a search for each core of the cluster: each reads many files and gives a question's k best of them all.
TASKS_A_CORE = 4


def best(hits: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """The k hits of each question with the highest score, ties to the smaller id; rank from 1."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def within(vectors: DataFrame, sources: list | None) -> DataFrame:
    """VEC17: no filter for null, nothing for an empty list; pushed to the scan."""
    return vectors if sources is None else vectors.where(F.col("source").isin(*sources) if sources else F.lit(False))


def grouped_tasks(rows: DataFrame) -> DataFrame:
    """rows in at most TASKS_A_CORE partitions a core, without a shuffle.

    A task of a search gives k rows a question whatever it reads; so they grow with the cores, not with the files.
    """
    return rows.coalesce(max(1, TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism))


def knn(questions: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", sources: list | None = None) -> DataFrame:
    """VEC1: query_id, id, score and rank of the k nearest vectors(id, embedding) of each of questions(query_id, embedding).

    The questions go to the tasks in blocks; a task keeps each question's k best of the files it reads and those are merged,
    so vectors are never shuffled, and what is shuffled is at most tasks x questions x k, the tasks being some a core.
    """
    total = questions.count()
    blocks = 1 if total <= QUESTION_BLOCK else math.ceil(2 * total / QUESTION_BLOCK)
    rows = within(vectors, sources).select(F.col("id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).where("id is not null and embedding is not null")
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
    parts = []
    for block in range(blocks):
        own = questions if blocks == 1 else questions.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        held = own.select(F.col("query_id").cast("bigint"), F.col("embedding").cast("array<double>")).where("embedding is not null").collect()  # at most a block
        ids, matrix = np.array([r[0] for r in held], np.int64), as_matrix([r[1] for r in held])
        shipped = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

        def run(batches, shipped=shipped):
            ids, q = shipped.value
            kept_s, kept_i = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
            for batch in batches:
                own, lists = batch.column(0).to_numpy(), batch.column(1)
                fits = np.array([len(x) == q.shape[1] for x in lists], bool) if len(ids) else np.zeros(len(own), bool)
                for at in range(0, len(own), 2048):
                    rows = np.flatnonzero(fits[at : at + 2048]) + at
                    if not len(rows):
                        continue
                    x = lists.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), -1)
                    keep_best(kept_s, kept_i, scored(q, x, metric), own[rows])
            r, c = np.nonzero(np.isfinite(kept_s))
            yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(kept_i[r, c]), pa.array(kept_s[r, c])], schema=schema)

        parts.append(grouped_tasks(rows).mapInArrow(run, "query_id bigint, id bigint, score double"))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return best(out, k)


def as_matrix(rows: list) -> np.ndarray:
    return np.array(rows, np.float64) if rows else np.zeros((0, 1))


def keep_best(kept_s: np.ndarray, kept_i: np.ndarray, scores: np.ndarray, own: np.ndarray) -> None:
    """Merge a tile's scores (questions x vectors with ids own) into each question's best, in place; ties to the smaller id."""
    k = kept_s.shape[1]
    least = kept_s[:, -1:]
    if not np.isfinite(least).all() and scores.shape[1] > k:  # at first, the tile's own k-th best is a bound
        least = np.maximum(least, -np.partition(-np.nan_to_num(scores, nan=-np.inf), k - 1, axis=1)[:, k - 1 : k])
    r, c = np.nonzero((scores >= least) & (scores > -np.inf))
    if not len(r):
        return
    some = np.unique(r)
    at = np.concatenate([np.repeat(some, k), r])
    s = np.concatenate([kept_s[some].ravel(), scores[r, c]])
    i = np.concatenate([kept_i[some].ravel(), own[c]])
    order = np.lexsort((i, -s, at))
    at, s, i = at[order], s[order], i[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    kept = place < k
    kept_s[at[kept], place[kept]], kept_i[at[kept], place[kept]] = s[kept], i[kept]


def scored(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "euclid":
        return -np.sqrt(np.maximum(0, (q**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * q @ x.T))
    if metric == "dot":
        return q @ x.T
    with np.errstate(divide="ignore", invalid="ignore"):
        return (q @ x.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None])


def list_count(rows: int) -> int:
    """VEC2: inverted lists of an index: a list a thousand rows up to a million, then the square root."""
    return max(1, rows // 1000) if rows <= 1_000_000 else int(math.sqrt(rows))


def fit_lists(vectors: DataFrame, sample_rows: int = 50_000, seed: int = 3, lists: int | None = None) -> KMeansModel:
    """VEC2: centroids from a bounded sample."""
    total = vectors.count()
    sample = vectors if total <= sample_rows else vectors.sample(sample_rows / total, seed)
    return KMeans(k=max(2, lists or list_count(total)), seed=seed, maxIter=10, featuresCol="features").fit(sample.where("embedding is not null").select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")))


def hashed_embedding(text: Column, dimension: int = 64) -> Column:
    """UDF1: a stand-in embedder, not a model: signed counts of hashed words, of unit length; null text gives null."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        places: dict[str, int] = {}  # of this batch's words: the component, and its sign in the high half

        def place(w):
            h = hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest()
            places[w] = p = h[0] % dimension + (0 if h[1] & 1 else dimension)
            return p

        def one(t):
            if t is None:
                return None
            found = [places[w] if w in places else place(w) for w in re.findall(r"\w+", t.lower())]
            counts = np.bincount(np.array(found, np.int64), minlength=2 * dimension)
            v = (counts[:dimension] - counts[dimension:]).astype(np.float32)
            n = float(np.linalg.norm(v))
            return (v / n if n else v).tolist()

        return texts.map(one)

    return embed(text)


def badly_embedded(chunks: DataFrame, vectors: DataFrame, dimension: int) -> DataFrame:
    """VEC5: passages without a vector, or with one of another length."""
    both = chunks.select("id").join(vectors.select("id", F.size("embedding").alias("size")), "id", "left")
    return both.where(F.col("size").isNull() | (F.col("size") != dimension)).select("id", F.when(F.col("size").isNull(), "missing").otherwise("width").alias("reason"))


def reindexed(chunks: DataFrame, collection: str, path: str, dimension: int = 64) -> None:
    """VEC6: a collection's folder rewritten with vectors of all its passages; other collections stay."""
    rows = chunks.select(F.lit(collection).alias("collection"), "id", hashed_embedding(F.col("content"), dimension).alias("embedding"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(path)


def picture_index(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """VEC13: pictures with the vectors supplied for them; those without one are left out."""
    return chunks.where("kind = 'image'").join(vectors.select("id", "embedding"), "id")
