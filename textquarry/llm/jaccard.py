"""N-gram Jaccard join: links between documents whose word 5-gram sets have a similarity of at least 0.8.

Chosen-path join. Documents with equal shingle sets are one representative with a weight. Each
representative's set is embedded as TOKENS min-hash tokens. In every run, a path starts at the root and
grows by a token whose position is drawn from the path's own hash: 1/similarity tokens a node on average,
so a pair at the threshold keeps about one common branch at any depth. Representatives that share a path
share a bucket; buckets of up to SMALL are compared pairwise on their tokens, larger ones are split
further, to DEPTH levels. Runs repeat until a pair at the threshold meets with probability RECALL. What
is still large after DEPTH levels agrees on that many sampled tokens, and is linked to its least member
as a whole, so no size is cut off.

Buckets only give candidate edges (a spanning set, not pairs). The candidates' components are then
compared exactly: all pairs inside a component, on their full shingle sets, in blocks of bounded size,
counting links and keeping spanning edges. Exact classes are the components of those.

Texts are never shuffled as a table: a bit table of bounded size marks the ids of suspects, the marked rows'
shingle sets are joined with the suspects on the sets' hashes, and all other rows stay where they are.

Defined cases: a text of one to four words is one shingle of all of them; a text without words, or null,
has no link and is its own class, and so is each of several; texts are read whole, however long; rows that
repeat a doc_id count as one document and give one row, and if their texts differ it has the least class and
the largest counts among them; every row with a null doc_id is a document of its own, returned with its
class, which is null where no member has an id; empty tables give no rows. Extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.llm import words as W
from textquarry.llm.components import connected_components
from textquarry.llm.shared import fresh, id_bits, small, stored, with_bit

SIMILARITY = 0.8
TOKENS = 64
RECALL = 0.99
DEPTH = 6
#: Buckets up to this size are compared pairwise.
SMALL = 96
#: A pair whose share of equal tokens is below this is no candidate: four standard deviations under the threshold.
LEAST_SHARE = SIMILARITY - 4 * math.sqrt(SIMILARITY * (1 - SIMILARITY) / TOKENS)
#: Documents and shingles of one block of the exact comparison.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 2_000_000

_MAPS = W.permutations(TOKENS, 20240808)
_U = np.uint64


def runs_needed(similarity: float = SIMILARITY, recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met with the given probability, however deep its buckets."""
    meet = 1.0
    more = 1 / similarity - 1
    for _ in range(depth):
        meet = (1 - more) * similarity * meet + more * (1 - (1 - similarity * meet) ** 2)
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


def chosen(paths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First token position of each path, second one, and whether the second is used."""
    h = W.mixed(paths ^ _U(0xC2B2AE3D27D4EB4F))
    first = (h % _U(TOKENS)).astype(np.int64)
    second = ((first + 1 + ((h >> _U(20)) % _U(TOKENS - 1)).astype(np.int64)) % TOKENS)
    used = (h >> _U(40)).astype(np.float64) / 2**24 < 1 / SIMILARITY - 1
    return first, second, used


def extended(paths: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path) of every child of rows' paths; tokens is rows x TOKENS."""
    first, second, used = chosen(paths)
    at = np.arange(len(paths))
    grown = lambda pos, rows: W.mixed(W.mixed(paths[rows] * _U(3) + pos[rows].astype(_U)) ^ tokens[rows, pos[rows]].astype(_U))
    return np.concatenate([at, at[used]]), np.concatenate([grown(first, at), grown(second, at[used])])


def _sets(texts: list) -> list[np.ndarray]:
    return [np.unique(x) for x in W.shingle_lists(texts, short=True)]


def _shape(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def _signatures(docs: DataFrame) -> DataFrame:
    """doc_id, shape (a hash of the whole shingle set; null without words) and tokens of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("shape", pa.binary()), ("tokens", pa.binary())])

    def run(batches):
        for batch in small(batches):
            texts = batch.column(1).to_pylist()
            for start, end in W.pieces_of(texts):
                sets = _sets(texts[start:end])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, end - start), pa.array([_shape(x) for x in sets], pa.binary()),
                    pa.array([(W.minhashes(x, _MAPS) >> np.uint32(16)).astype(np.uint16).tobytes() if len(x) else None for x in sets], pa.binary()),
                ], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, shape binary, tokens binary")


_FIRST = pa.schema([("path", pa.int64()), ("node", pa.int64())])
_PATHS = pa.schema([*_FIRST, ("tokens", pa.binary())])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, TOKENS)


def _first_paths(rows: DataFrame, runs: int) -> DataFrame:
    """(path, node): the first level's paths of rows(node, tokens) in each run."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                tokens = _matrix(part.column(1))
                each = [extended(np.full(len(tokens), W.mixed(np.array([r + 1], _U))[0]), tokens) for r in range(runs)]
                at, paths = np.concatenate([a for a, _ in each]), np.concatenate([p for _, p in each])
                yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), part.column(0).take(pa.array(at))], schema=_FIRST)

    return rows.select("node", "tokens").mapInArrow(run, "path bigint, node bigint")


def _next_paths(rows: DataFrame) -> DataFrame:
    """Child paths of rows(path, node, tokens)."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                at, paths = extended(part.column(0).to_numpy().view(np.uint64), _matrix(part.column(2)))
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), part.column(1).take(at), part.column(2).take(at)], schema=_PATHS)

    return rows.select("path", "node", "tokens").mapInArrow(run, "path bigint, node bigint, tokens binary")


def _spanning(near: np.ndarray) -> np.ndarray:
    """Component of each row of a symmetric adjacency matrix, named by its least row."""
    labels = np.arange(len(near))
    linked = near | np.eye(len(near), dtype=bool)
    while True:
        new = np.where(linked, labels[None, :], len(near)).min(axis=1)
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


def _bucket_edges(rows: DataFrame) -> DataFrame:
    """Candidate edges inside buckets of rows(path, node, tokens), none of which is large."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        held: tuple | None = None
        seen: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            path, docs, tokens = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
            if held is not None:
                path, docs, tokens = np.concatenate([held[0], path]), np.concatenate([held[1], docs]), np.concatenate([held[2], tokens])
            cut = int(np.searchsorted(path, path[-1]))
            yield edges_of(path[:cut], docs[:cut], tokens[:cut])
            held = path[cut:], docs[cut:], tokens[cut:]
        if held is not None:
            yield edges_of(*held)

    def edges_of(path, docs, tokens):
        a, b = [], []
        starts = np.flatnonzero(np.diff(path, prepend=path[:1] - 1)) if len(path) else np.empty(0, np.int64)
        sizes = np.diff(np.append(starts, len(path)))
        pairs = starts[sizes == 2]
        if len(pairs):
            near = (tokens[pairs] == tokens[pairs + 1]).mean(axis=1) >= LEAST_SHARE
            a.append(docs[pairs[near]])
            b.append(docs[pairs[near] + 1])
        for start, size in zip(starts[sizes > 2], sizes[sizes > 2]):
            own, ids = tokens[start : start + size], docs[start : start + size]
            near = np.stack([(own == row).mean(axis=1) >= LEAST_SHARE for row in own])
            root = _spanning(near)
            moved = root != np.arange(size)
            a.append(ids[moved])
            b.append(ids[root[moved]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a) if a else [], pa.int64()), pa.array(np.concatenate(b) if b else [], pa.int64())], schema=schema)

    return rows.repartition("path").sortWithinPartitions("path").mapInArrow(run, "a bigint, b bigint")


def candidate_edges(signatures: DataFrame) -> DataFrame:
    """A spanning set of edges between representatives that met in some bucket."""
    found = None
    level = _first_paths(signatures, runs_needed())
    for depth in range(1, DEPTH + 1):
        # Paths are cheap to grow again, so they are counted and joined without being written.
        sizes = level.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("least")).where("size > 1")
        shared = level.join(sizes, "path")
        level = stored(shared.join(signatures, "node") if depth == 1 else shared, f"paths-{depth}")
        edges = _bucket_edges(level.where(F.col("size") <= SMALL).select("path", "node", "tokens"))
        found = edges if found is None else found.union(edges)
        large = level.where(F.col("size") > SMALL)
        if large.isEmpty():
            break
        if depth == DEPTH:
            found = found.union(large.select(F.col("node").alias("a"), F.col("least").alias("b")))
        else:
            level = _next_paths(large)
    return stored(found.where("a <> b").distinct(), "candidates")


def _compare(sets: list[np.ndarray], other: list[np.ndarray] | None) -> np.ndarray:
    """Which pairs of two lists of sets (or of one with itself) have the similarity."""
    everything = sets + (other or [])
    flat = np.concatenate(everything)
    values, code, uses = np.unique(flat, return_inverse=True, return_counts=True)
    own = np.repeat(np.arange(len(everything)), [len(x) for x in everything])
    place = np.cumsum(uses > 1) - 1  # shingles of one set alone can't be shared
    keep = uses[code] > 1
    code, own = place[code[keep]], own[keep]
    order = np.argsort(code, kind="stable")
    code, own = code[order], own[order]
    n, m = len(sets), len(everything)
    shared = np.zeros((n, m if other is None else m - n), np.float32)
    total = int(code[-1]) + 1 if len(code) else 0
    width = 8192
    for at in range(0, total, width):
        lo, hi = np.searchsorted(code, [at, at + width])
        part = np.zeros((m, min(width, total - at)), np.float32)
        part[own[lo:hi], code[lo:hi] - at] = 1
        shared += part[:n] @ (part if other is None else part[n:]).T
    sizes = np.array([len(x) for x in everything], np.float64)
    union = sizes[:n, None] + (sizes if other is None else sizes[n:])[None, :] - shared
    return shared >= SIMILARITY * union - 1e-6


_LINKS = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("texts", pa.int64()), ("other", pa.int64())])


def _verified(rows: DataFrame) -> DataFrame:
    """Partial link counts and spanning edges of blocks: rows(component, i, j, side, node, weight, shingles)."""

    def run(batches):
        key, left, right = None, [], []
        for batch in batches:
            columns = [batch.column(k) for k in range(batch.num_columns)]
            head = list(zip(*(c.to_pylist() for c in columns[:6])))
            for at, (component, i, j, side, node, weight) in enumerate(head):
                if (component, i, j) != key:
                    if key is not None:
                        yield block(i0 == j0, left, right)
                    key, left, right = (component, i, j), [], []
                    i0, j0 = i, j
                own, shingles = left if side == 0 else right, np.frombuffer(columns[6][at].as_buffer(), np.uint64).copy()
                own.append((node, weight, shingles))
        if key is not None:
            yield block(i0 == j0, left, right)

    def block(alone, left, right):
        docs, links, texts, other = [], [], [], []
        if left and (len(left) > 1 if alone else right):
            ids = np.array([d for d, *_ in left])
            weights = np.array([w for _, w, _ in left])
            near = _compare([s for *_, s in left], [s for *_, s in right] or None)
            if right:
                ids2, weights2 = np.array([d for d, *_ in right]), np.array([w for _, w, _ in right])
                for own, count, text in ((ids, near @ weights2, near.sum(axis=1)), (ids2, weights @ near, near.sum(axis=0))):
                    some = text > 0
                    docs += own[some].tolist()
                    links += count[some].tolist()
                    texts += text[some].tolist()
                    other += [None] * int(some.sum())
                whole = np.zeros((len(ids) + len(ids2),) * 2, bool)
                whole[: len(ids), len(ids) :] = near
                whole |= whole.T
                every = np.concatenate([ids, ids2])
            else:
                np.fill_diagonal(near, False)
                some = near.any(axis=1)
                docs, links, texts = ids[some].tolist(), (near @ weights)[some].tolist(), near.sum(axis=1)[some].tolist()
                other = [None] * len(docs)
                whole, every = near, ids
            root = _spanning(whole)
            moved = np.flatnonzero(root != np.arange(len(root)))
            docs += every[moved].tolist()
            links += [0] * len(moved)
            texts += [0] * len(moved)
            other += every[root[moved]].tolist()
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(links, pa.int64()), pa.array(texts, pa.int64()), pa.array(other, pa.int64())], schema=_LINKS)

    # The last sort column makes the order, and so the result of a repeated task, the same each time.
    ordered = rows.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "side", "node")
    return ordered.mapInArrow(run, "node bigint, links bigint, texts bigint, other bigint")


def _shingle_sets(docs: DataFrame) -> DataFrame:
    """shape, n and shingles (sorted 64-bit hashes) of docs(text)."""
    schema = pa.schema([("shape", pa.binary()), ("n", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        for batch in small(batches):
            texts = batch.column(0).to_pylist()
            for start, end in W.pieces_of(texts):
                sets = [x for x in _sets(texts[start:end]) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([_shape(x) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], schema=schema)

    return docs.select("text").mapInArrow(run, "shape binary, n bigint, shingles binary")


def _linked_shapes(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """shape, least (doc_id or null), class_node, n_links and n_texts of each different set of rows, the stored signatures of docs.

    n_links of a row with that set: its copies, and the documents of linked sets.
    """
    worded = rows.where("shape is not null")
    # Copies are merged before the shuffle, so a set that very many rows share is no hot key.
    named = worded.where("doc_id is not null").groupBy("shape", "doc_id").agg(F.count(F.lit(1))).groupBy("shape").agg(F.count(F.lit(1)).alias("named"))
    shapes = worded.groupBy("shape").agg(F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("nameless"), F.first("tokens").alias("tokens"))
    weight = (F.coalesce("named", F.lit(0)) + F.col("nameless")).alias("weight")
    shapes = stored(shapes.join(named, "shape", "left").select(F.monotonically_increasing_id().alias("node"), "shape", "least", weight, "tokens"), "shapes")
    components = stored(connected_components(candidate_edges(shapes.select("node", "tokens"))), "components")

    suspects = stored(shapes.select("node", "shape", "least", "weight").join(components, "node"), "suspects")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    texts = with_bit(texts, "doc_id", id_bits(suspects, "least"), "hit").where("hit")
    sets = _shingle_sets(texts).groupBy("shape").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))
    sets = stored(sets.join(suspects, "shape").select("component", "node", "weight", "n", "shingles"), "sets")
    sizes = sets.groupBy("component").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("total"))
    blocks = sizes.select("component", F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = sets.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("node", "n"), F.col("blocks")).cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(
        F.least("block", k).alias("i"), F.greatest("block", k).alias("j"), F.when(F.col("block") <= k, 0).otherwise(1).alias("side")))).alias("pair")
    spread = placed.select("component", "node", "weight", "shingles", pair).select("component", "pair.i", "pair.j", "pair.side", "node", "weight", "shingles")
    found = stored(_verified(spread), "links")

    linked = found.groupBy("node").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    exact = connected_components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    return (
        shapes.select("node", "shape", "least", "weight").join(exact, "node", "left").join(linked, "node", "left")
        .select("shape", "least", F.coalesce("component", "node").alias("class_node"),
                (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_texts"))
    )


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (least doc_id of its class), n_links (other documents it is linked to), n_texts (different linked texts)."""
    rows = stored(_signatures(docs), "signatures")
    linked = stored(_linked_shapes(docs, rows), "linked")
    names = linked.groupBy("class_node").agg(F.min("least").alias("class_id"))
    by_shape = linked.join(names, "class_node").select("shape", "class_id", "n_links", "n_texts")
    worded = rows.where("shape is not null").join(by_shape, "shape").select("doc_id", "class_id", "n_links", "n_texts")
    wordless = rows.where("shape is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).alias("n_links"), F.lit(0).alias("n_texts"))
    each = worded.union(wordless).withColumns({c: F.col(c).cast("bigint") for c in ("n_links", "n_texts")})
    named = each.where("doc_id is not null").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"), F.max("n_texts").alias("n_texts"))
    return named.unionByName(each.where("doc_id is null"))


def _shaped(docs: DataFrame, name: str) -> DataFrame:
    """docs with their sets' hashes in a further column."""
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())])

    def run(batches):
        for batch in small(batches):
            texts = batch.column(at).to_pylist()
            shapes = [_shape(x) for a, b in W.pieces_of(texts) for x in _sets(texts[a:b])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shapes, pa.binary())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of every class of docs, columns as they are: of the least doc_id, a null one being greatest.

    Rows are decided on by id and set. Of rows that repeat both, any one stays; rows without words all stay.
    """
    rows = stored(_signatures(docs), "signatures")
    linked = stored(_linked_shapes(docs, rows), "linked")
    kept = linked.groupBy("class_node").agg(F.min(F.struct(F.col("least").isNull(), "least", "shape")).alias("kept"), F.count(F.lit(1)).alias("sets"))
    kept = linked.join(kept, "class_node").where("sets > 1 or n_links > 0").select("shape", "least", (F.col("shape") == F.col("kept.shape")).alias("is_kept"))
    copies = rows.where("shape is not null").groupBy("shape", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    # Rows that go, and rows of which one stays though they are more.
    stays = F.col("is_kept").isNull() | (F.col("is_kept") & F.col("doc_id").eqNullSafe(F.col("least")))
    touched = copies.join(kept, "shape", "left").select("doc_id", "shape", "copies", stays.alias("stays"))
    touched = stored(touched.where("not stays or copies > 1"), "touched")

    hit, shape = fresh(docs, "hit"), fresh(docs, "shape")
    marked = with_bit(docs, "doc_id", id_bits(touched, "doc_id"), hit)
    looked_at = _shaped(marked.where(F.col(hit)).drop(hit), shape)
    # Copies are merged before the shuffle; rows without words are kept apart.
    key = [F.col("doc_id").cast("bigint").alias("doc_id"), F.col(shape).alias("shape"), F.when(F.col(shape).isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0)).alias("once")]
    merged = looked_at.groupBy(*key).agg(F.first(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias("row"))
    gone = touched.where("not stays").select(F.col("doc_id").alias("gone_id"), F.col("shape").alias("gone_shape"))
    left = merged.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("shape") == F.col("gone_shape")), "left_anti").select("row.*")
    return marked.where(~F.col(hit)).select(docs.columns).union(left)
