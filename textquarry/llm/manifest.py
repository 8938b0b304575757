"""A Merkle manifest of a dataset: a leaf a row, an eight-ary tree a language, a tree over these, and proofs of all rows.

A leaf is the SHA-256 of the row's fields, each "-" if null, else its length in UTF-8, ":" and its value. Leaves stand in
their tree in the order of doc_id. Runs of FAN consecutive nodes become the SHA-256 of their digests, level by level,
until one is left, the tree's subroot; subroots, by language, are the leaves of the upper tree, which ends in the root.

Leaves are dealt out by ranges of (language, doc_id) and numbered there; sums of counts over the ranges, in order, give
every leaf its place. A leaf partition is a stretch of consecutive leaves of a tree, 2**LEAF_BITS at most. Two passes follow.

* Up: a partition derives all nodes whose leaves are its own and publishes only those whose run reaches beyond it, at
  most 2 (FAN - 1) a level. From them the few nodes that cross partitions are put together, level by level.
* Down, the octopus multiproof: a partition works out the least set of nodes that the proofs of all of its leaves need and
  that it can't derive, again at most 2 (FAN - 1) a level; these are fetched in one join. It derives the interior nodes that
  its proofs share once, and expands the single proofs from them, without anything more being read.

So texts never leave the scan, the leaves are shuffled at 32 bytes a digest, and what is published and fetched grows with
the number of partitions. Trees of any size are split over partitions; a language is no group of anything but sums.

Defined cases: a null doc_id stands first in its tree and is never tampered with; rows that tie in doc_id stand in the order of
their leaves, and equal ones are interchangeable; a null language is a tree of its own, before all others; an empty table gives no
rows; a null or empty text, and texts of any length, are hashed whole; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.llm.shared import stored

#: Nodes that become one.
FAN = 8
#: Leaves of a partition are at most two to this power.
LEAF_BITS = 16

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROVEN = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """The digest of a row, 32 bytes; changed: fields to be taken from elsewhere."""
    return F.unhex(F.sha2(F.concat(*(field(changed.get(c, F.col(c))) for c in FIELDS)), 256))


def tampered() -> Column:
    """Whether a row is one of the third whose text is altered to show that its proof then fails."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))


def lower_ascii(text: Column) -> Column:
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, capitals, capitals.lower())


def tree_key(lang: Column) -> Column:
    """Never null, and in the order of the trees: null first, then by the bytes of the name."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


# --- places


def placed(leaves: DataFrame, order: list[str], bits: int = LEAF_BITS) -> tuple[DataFrame, DataFrame]:
    """Leaves(tree, ...) with part and at, and the partitions (tree, part, first, size, at_first, n) of 2**bits leaves at most.

    Written between the two steps, so that a leaf's number never changes. Of a tree, a row a range is summed in order.
    """
    dealt = leaves.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    number = F.monotonically_increasing_id()  # the range's number, then 33 bits for the row's in it
    rows = stored(dealt.select("*", F.shiftright(number, bits).alias("part"), number.alias("at")), "leaves")
    parts = rows.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("size"), F.min("at").alias("at_first")).withColumn("dealt", F.shiftright("at_first", 33))
    ranges = parts.groupBy("tree", "dealt").agg(F.sum("size").alias("own"), F.min("at_first").alias("least"))
    ordered = Window.partitionBy("tree").orderBy("dealt")
    before = F.sum("own").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("tree", "dealt", "least", F.coalesce(before, F.lit(0)).alias("before"), F.sum("own").over(Window.partitionBy("tree")).alias("n"))
    first = F.col("before") + F.col("at_first") - F.col("least")
    return rows, stored(parts.join(ranges, ["tree", "dealt"]).select("tree", "part", first.alias("first"), "size", "at_first", "n"), "partitions")


# --- nodes


def digest_of(run: list[bytes]) -> bytes:
    """The node over a run; digests are hashed as hexadecimal text."""
    return hashlib.sha256(b"".join(x.hex().encode() for x in run)).digest()


def widths(n: int) -> list[int]:
    """Nodes on each level of a tree of n leaves, the root's last."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // FAN))
    return out


def missing(first: int, end: int, n: int) -> list[tuple[int, int]]:
    """The least set of nodes (level, index) beside those derived from leaves first..end-1 that all their proofs need."""
    out = []
    for level, width in enumerate(widths(n)[:-1]):
        low, high = first // FAN * FAN, min(width, -(-end // FAN) * FAN)
        out += [(level, k) for k in (*range(low, first), *range(end, high))]
        first, end = low // FAN, -(-high // FAN)
    return out


def published(first: int, digests: list[bytes], n: int) -> Iterator[tuple[int, int, bytes]]:
    """The nodes (level, index, digest) over these leaves alone whose run reaches beyond them, and the root if it is theirs."""
    for level, width in enumerate(widths(n)):
        end = first + len(digests)
        if width == 1 and digests:
            yield level, 0, digests[0]
            return
        low, high = -(-first // FAN), end // FAN if end < width else -(-width // FAN)  # runs that are whole here
        high = max(low, high)
        for k, d in enumerate(digests, first):
            if not low * FAN <= k < high * FAN:
                yield level, k, d
        digests = [digest_of(digests[k * FAN - first : (k + 1) * FAN - first]) for k in range(low, high)]
        first = low


def _up(table: pa.Table) -> pa.Table:
    tree, n = table["tree"][0].as_py(), table["n"][0].as_py()
    order = np.argsort(table["at"].to_numpy(), kind="stable")
    digests = table["leaf"].take(pa.array(order)).to_pylist()
    rows = list(published(table["first"][0].as_py(), digests, n))
    return pa.table({"tree": pa.array([tree] * len(rows)), "level": pa.array([r[0] for r in rows], pa.int32()), "place": pa.array([r[1] for r in rows], pa.int64()), "digest": pa.array([r[2] for r in rows], pa.binary())})


def node_table(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """tree, level, place and digest of all nodes that partitions need of each other, and every tree's root."""
    own = parts.select("tree", "part", "first", "n")
    given = stored(rows.select("tree", "part", "at", "leaf").join(own, ["tree", "part"]).groupBy("tree", "part").applyInArrow(_up, "tree string, level int, place bigint, digest binary"), "nodes")
    most = parts.agg(F.max("n")).first()[0] or 0  # one number
    levels = len(widths(most)) if most else 0
    out, border = [given], None
    for level in range(levels - 1):
        nodes = given.where(F.col("level") == level).select("tree", "place", "digest")
        nodes = nodes if border is None else nodes.unionByName(border)
        run = F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: F.lower(F.hex(x["digest"])))
        width = parts.groupBy("tree").agg(F.max("n").alias("n")).select("tree", F.ceil(F.col("n") / float(FAN**level)).alias("width"))
        open_ = nodes.join(width.where("width > 1").select("tree"), "tree")  # trees of one node at this level have ended
        border = open_.groupBy("tree", F.expr(f"place div {FAN}").alias("place")).agg(F.unhex(F.sha2(F.array_join(run, ""), 256)).alias("digest"))
        border = stored(border, f"level-{level + 1}")
        out.append(border.select("tree", F.lit(level + 1).alias("level"), "place", "digest"))
    nodes = out[0]
    for more in out[1:]:
        nodes = nodes.unionByName(more)
    return nodes


def roots(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """tree, root of every tree: its node of the highest level."""
    return nodes.groupBy("tree").agg(F.max_by("digest", "level").alias("root"))


# --- proofs


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, level, place = [], [], []
        for k, (first, size, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("first", "size", "n")))):
            for own in missing(first, first + size, n):
                at.append(k)
                level.append(own[0])
                place.append(own[1])
        picked = batch.select(["tree", "part"]).take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(level, pa.int32()), pa.array(place, pa.int64())], names=["tree", "part", "level", "place"])


def fetched(parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """tree, part and the nodes (level, place, digest) that the part's proofs need and that its leaves don't give."""
    wanted = parts.select("tree", "part", "first", "size", "n").mapInArrow(_wanted, "tree string, part bigint, level int, place bigint")
    return wanted.join(nodes, ["tree", "level", "place"]).select("tree", "part", "level", "place", "digest")


class Proofs:
    """The proofs of consecutive leaves: own digests and fetched nodes, level by level, in one contiguous stretch each."""

    def __init__(self, first: int, digests: list[bytes], n: int, others: dict[tuple[int, int], bytes]):
        self.levels: list[tuple[int, list[bytes]]] = []  # first place and digests (as text), whole runs
        own = [d.hex().encode() for d in digests]
        for level, width in enumerate(widths(n)[:-1]):
            end = first + len(own)
            low, high = first // FAN * FAN, min(width, -(-end // FAN) * FAN)
            row = [others[level, k].hex().encode() for k in range(low, first)] + own + [others[level, k].hex().encode() for k in range(end, high)]
            self.levels.append((low, row))
            own = [hashlib.sha256(b"".join(row[k : k + FAN])).hexdigest().encode() for k in range(0, len(row), FAN)]
            first = low // FAN
        self.root = own[0] if own else b""
        self.above: dict[tuple[int, int], bytes] = {}

    def siblings(self, level: int, place: int) -> bytes:
        """The digests of all levels from this one on, as text: siblings of the node and of those above it."""
        if level == len(self.levels):
            return b""
        if (level, place) in self.above:
            return self.above[level, place]
        low, row = self.levels[level]
        at = place // FAN * FAN - low
        found = b"".join(row[at : place - low]) + b"".join(row[place - low + 1 : at + FAN]) + self.siblings(level + 1, place // FAN)
        if level:  # shared by the leaves below
            self.above[level, place] = found
        return found

    def fold(self, place: int, digest: bytes) -> bytes:
        """The root that a leaf's digest (as text) and its siblings give."""
        for low, row in self.levels:
            at = place // FAN * FAN - low
            digest = hashlib.sha256(b"".join(row[at : place - low]) + digest + b"".join(row[place - low + 1 : at + FAN])).hexdigest().encode()
            place //= FAN
        return digest


def _proven(names: list[str]):
    def run(own: pa.Table, others: pa.Table) -> pa.Table:
        if not own.num_rows:
            return pa.table({c: [] for c in names})
        own = own.take(pa.array(np.argsort(own["at"].to_numpy(), kind="stable")))
        first, n, rank, trees = (own[c][0].as_py() for c in ("first", "n", "rank", "trees"))
        known = {(l, p): d for u, l, p, d in zip(*(others[c].to_pylist() for c in ("upper", "level", "place", "digest"))) if not u}
        upper = {(l, p): d for u, l, p, d in zip(*(others[c].to_pylist() for c in ("upper", "level", "place", "digest"))) if u}
        leaves = own["leaf"].to_pylist()
        inner = Proofs(first, leaves, n, known)
        outer = Proofs(rank, [bytes.fromhex(inner.root.decode())], trees, upper)
        tail = outer.siblings(0, rank)
        root = outer.root.decode()
        proof = [hashlib.sha256(inner.siblings(0, first + k) + tail).hexdigest() for k in range(len(leaves))]
        folded = [outer.fold(rank, inner.fold(first + k, (changed or d).hex().encode())).decode() for k, (d, changed) in enumerate(zip(leaves, own["changed"].to_pylist()))]
        return pa.table({
            "doc_id": own["doc_id"], "leaf": pa.array([d.hex() for d in leaves]), "subroot": pa.array([inner.root.decode()] * len(leaves)), "root": pa.array([root] * len(leaves)),
            "proof_sha256": pa.array(proof), "folded_root": pa.array(folded), "verified": pa.array([x == root for x in folded]),
        })

    return run


def proven(docs: DataFrame) -> DataFrame:
    """Of every row of docs: leaf, subroot, root, its proof's digest, and the root that its (perhaps tampered) leaf folds to."""
    changed = F.when(tampered() & (F.col("text") != lower_ascii(F.col("text"))), leaf(text=lower_ascii(F.col("text"))))
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "lang", "n_chars", "text")
    leaves = read.select(tree_key(F.col("lang")).alias("tree"), "doc_id", leaf().alias("leaf"), changed.alias("changed"), F.monotonically_increasing_id().alias("tie"))
    rows, parts = placed(stored(leaves, "digests"), ["doc_id", "leaf", "tie"])
    nodes = node_table(rows, parts)

    top = roots(nodes, parts).select(F.lit("top").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("leaf"))
    top_rows, top_parts = placed(stored(top, "subroots"), ["name"], bits=0)  # every subroot is a partition
    top_nodes = node_table(top_rows, top_parts)
    ranks = top_rows.join(top_parts.select("part", "first", "at_first", F.col("n").alias("trees")), "part")
    ranks = ranks.select(F.col("name").alias("tree"), (F.col("first") + F.col("at") - F.col("at_first")).alias("rank"), "trees")

    beside = ranks.select("tree", F.lit("top").alias("of"), F.col("rank").alias("first"), F.lit(1).cast("bigint").alias("size"), F.col("trees").alias("n"))
    upper = beside.select(F.col("tree"), F.lit(0).cast("bigint").alias("part"), "first", "size", "n").mapInArrow(_wanted, "tree string, part bigint, level int, place bigint")
    upper = upper.join(top_nodes.select("level", "place", "digest"), ["level", "place"])
    upper = parts.select("tree", "part").join(upper.select("tree", "level", "place", "digest"), "tree")
    others = fetched(parts, nodes).select("tree", "part", F.lit(False).alias("upper"), "level", "place", "digest").unionByName(
        upper.select("tree", "part", F.lit(True).alias("upper"), "level", "place", "digest")
    )
    own = rows.join(parts.join(ranks, "tree").select("tree", "part", "first", "n", "rank", "trees"), ["tree", "part"])
    names = [f.split()[0] for f in PROVEN.split(", ")]
    return own.groupBy("tree", "part").cogroup(others.groupBy("tree", "part")).applyInArrow(_proven(names), PROVEN)
