"""Benchmark decontamination: which documents contain which test items.

Size-partitioned MinHash containment search. Test items are partitioned by their number of word
5-grams into powers of two. For partition size B, every document is seen as overlapping windows of
two adjacent blocks of B shingles, so an item's whole passage lies in one window and window and item
have a bounded size ratio: a passage that holds 0.8 of the item's shingles then has a Jaccard
similarity of at least 0.19 with its window, however long the document is. With MAPS min-hashes per
window, such a passage is missed with a probability below 0.81**48 = 4e-5. Block minima of larger
partitions are minima of smaller ones, so each shingle is hashed once per map. Every retrieved pair
is verified by exact containment of the item's distinct shingles in the document's.

The item table is the stated query set: it is read in blocks of at most ITEM_BLOCK items, and only
one block's signatures go to the tasks at a time. Documents are never shuffled.

Defined cases: items or documents with fewer than five words (or null text) have no shingle and match
nothing; a null id is carried as it is; repeated rows give repeated matches; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm import words as W
from textquarry.llm.shared import small

MAPS = 48
THRESHOLD = 0.8
#: Items whose signatures are sent to the tasks at once (about 20 MB).
ITEM_BLOCK = 20_000
RESULT = "doc_id bigint, item_id bigint, item_shingles int, shared_shingles int, containment double"


class Items:
    """Signatures and exact shingle sets of one block of items."""

    def __init__(self, ids: list, texts: list):
        self.maps = W.permutations(MAPS, 20240501)
        self.ids, self.sets, blocks, signs = [], [], [], []
        for i, text in zip(ids, texts):
            found = np.unique(W.shingle_lists([text])[0])
            if len(found):
                self.ids.append(i)
                self.sets.append(found)
                blocks.append(1 << int(len(found) - 1).bit_length())
                signs.append(W.minhashes(found, self.maps))
        blocks = np.array(blocks, np.int64)
        self.partitions = {}
        for size in np.unique(blocks):
            at = np.flatnonzero(blocks == size)
            values = np.stack([signs[k] for k in at])  # items of this size x maps
            order = np.argsort(values, axis=0, kind="stable")
            bits = max(16, int(len(at) * 256 - 1).bit_length())
            seen = np.zeros((MAPS, 1 << bits), bool)
            for m in range(MAPS):
                seen[m, values[:, m] & np.uint32((1 << bits) - 1)] = True
            self.partitions[int(size)] = (np.take_along_axis(values, order, axis=0), at[order], seen, np.uint32((1 << bits) - 1))

    def candidates(self, docs: list[np.ndarray]) -> set[tuple[int, int]]:
        """(position of the document, position of the item) of every pair that shares a window min-hash."""
        found: set[tuple[int, int]] = set()
        if not self.partitions or not docs:
            return found
        base = min(self.partitions)
        counts = np.array([-(-len(x) // base) for x in docs])
        firsts = np.concatenate([[0], np.cumsum(counts)])
        if not firsts[-1]:
            return found
        flat = np.zeros(firsts[-1] * base, np.uint32)
        for k, x in enumerate(docs):
            at = firsts[k] * base
            flat[at : at + len(x)] = W.folded(x)
        # A document's last block is filled up with its own last shingle, which changes no minimum.
        for k, x in enumerate(docs):
            if len(x) % base:
                flat[firsts[k] * base + len(x) : firsts[k + 1] * base] = W.folded(x[-1:])[0]
        columns = np.ascontiguousarray(flat.reshape(-1, base).T)
        owner = np.repeat(np.arange(len(docs)), counts)
        for m in range(MAPS):
            a, b = self.maps[0][m], self.maps[1][m]
            least = columns[0] * a + b
            for row in columns[1:]:
                np.minimum(least, row * a + b, out=least)
            size, minima, own, left = base, least, owner, counts
            for want in sorted(self.partitions):
                while size < want:
                    minima, own, left = halved(minima, own, left)
                    size *= 2
                self.matched(want, m, minima, own, found)
        return found

    def matched(self, size: int, m: int, minima: np.ndarray, own: np.ndarray, found: set) -> None:
        values, items, seen, mask = self.partitions[size]
        # A window's minimum is that of one of its two blocks, so block minima that equal an item's
        # value are the only places to look; the window's other block must not be smaller.
        hits = np.flatnonzero(seen[m][minima & mask])
        if not len(hits):
            return
        column = values[:, m]
        lo, hi = np.searchsorted(column, minima[hits], "left"), np.searchsorted(column, minima[hits], "right")
        for k, x, y in zip(hits[hi > lo], lo[hi > lo], hi[hi > lo]):
            value, smallest = minima[k], True
            before = k > 0 and own[k - 1] == own[k]
            after = k + 1 < len(own) and own[k + 1] == own[k]
            if before or after:
                smallest = (before and minima[k - 1] >= value) or (after and minima[k + 1] >= value)
            if smallest:
                found.update((int(own[k]), int(i)) for i in items[x:y, m])

    def matches(self, texts: list) -> list[tuple[int, int, int, int]]:
        """(document, item, item's shingles, shared shingles) for every verified pair."""
        out = []
        for start, end in W.pieces_of(texts):
            docs = W.shingle_lists(texts[start:end])
            by: dict[int, list[int]] = {}
            for d, i in self.candidates(docs):
                by.setdefault(d, []).append(i)
            for d, found in sorted(by.items()):
                have = np.unique(docs[d])
                for i in sorted(found):
                    want = self.sets[i]
                    at = np.minimum(np.searchsorted(have, want), len(have) - 1)
                    shared = int((have[at] == want).sum())
                    if shared >= THRESHOLD * len(want) - 1e-9:
                        out.append((start + d, i, len(want), shared))
        return out


def halved(minima: np.ndarray, own: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block minima of twice the block size; blocks never run over two documents."""
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    within = np.arange(len(minima)) - np.repeat(firsts, counts)
    starts = np.flatnonzero(within % 2 == 0)
    if not len(starts):
        return minima, own, counts
    return np.minimum.reduceat(minima, starts), own[starts], -(-counts // 2)


def item_blocks(items: DataFrame, block: int = ITEM_BLOCK):
    """The items as bounded blocks: Python holds one block of id and text at a time."""
    spark, total = items.sparkSession, items.count()
    parts = max(1, -(-2 * total // block)) if total > block else 1
    keyed = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text"))
    for k in range(parts):
        part = keyed if parts == 1 else keyed.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        rows = part.collect()
        yield spark.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows]))


def contained_items(docs: DataFrame, items: DataFrame, block: int = ITEM_BLOCK) -> DataFrame:
    """A row per document and test item it contains: RESULT's columns."""
    parts = []
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_shingles", pa.int32()), ("shared_shingles", pa.int32()), ("containment", pa.float64())])
    for shipped in item_blocks(items, block):

        def run(batches, shipped=shipped):
            held = shipped.value
            for batch in small(batches):
                ids = batch.column(0).to_pylist()
                found = held.matches(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[d] for d, *_ in found], pa.int64()),
                    pa.array([held.ids[i] for _, i, *_ in found], pa.int64()),
                    pa.array([n for *_, n, _ in found], pa.int32()),
                    pa.array([s for *_, s in found], pa.int32()),
                    pa.array([s / n for *_, n, s in found], pa.float64()),
                ], schema=schema)

        parts.append(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, RESULT))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def without_contaminated(docs: DataFrame, items: DataFrame, block: int = ITEM_BLOCK) -> DataFrame:
    """docs, all columns as they are, without the rows that contain a test item."""
    at = docs.columns.index("text")
    for shipped in item_blocks(items, block):

        def run(batches, shipped=shipped):
            held = shipped.value
            for batch in small(batches):
                keep = np.ones(batch.num_rows, bool)
                keep[[d for d, *_ in held.matches(batch.column(at).to_pylist())]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
