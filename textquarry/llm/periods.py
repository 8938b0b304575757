"""Periodic runs of words: stretches of a text that repeat with a period, found exactly, and the text without the repeats.

A run is a stretch of consecutive words with smallest period q, at least max(SHORTEST, 3 q) words long, that no
neighbouring word extends. Its words each occur three times in it at least. So a word that occurs less often within its
segment (at first the document) can't be in a run and splits the segment; the parts, in which words are rarer again, are
split in turn until nothing changes, and parts under SHORTEST words go. Of plain prose nothing is left at that point.

What survives is scanned for lags, all segments of a batch in one array with a word of its own between two. Lags under
FEW are compared in full. A longer one is compared only where it can matter: a run of period q, B <= q < 2 B, holds one of
the places 0, B, 2B, ... among its first q words, and the B words there stand again q words later. So of each scale B = FEW,
2 FEW, ... the hashes of the B words at those places are compared with those at the B next distances, and where they are equal
the stretch is grown word by word to both sides. Hashes only propose: growing decides, and equal words have equal hashes,
so the runs are exact. A scale takes time in proportion to the surviving words, and there are logarithmically many.

Texts are read in place: no row is shuffled. A task holds the words of some texts at a time (BATCH bytes, or one longer text).

Defined cases: a null text has no words; a null id is carried; repeated rows are each reported; an empty table gives no rows;
texts of any length are read whole; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a run at least, and periods that it has at least.
SHORTEST, TIMES = 24, 3
#: Lags under this are compared in full.
FEW = 32
#: Bytes of text whose words are held at once, unless one text is longer.
BATCH = 1 << 20

SCHEMA = (
    "doc_id bigint, n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
)
TEXTS = "doc_id bigint, n_runs bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def frequent_parts(words: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in words that may be in a run, ascending, and the number of the part that each is in.

    segment: what each word belongs to at first; parts are consecutive places of one segment.
    """
    places, part = np.arange(len(words)), segment
    while len(places):
        order = np.lexsort((words[places], part))
        w, p = words[places][order], part[order]
        first = np.r_[True, (w[1:] != w[:-1]) | (p[1:] != p[:-1])]
        group = np.cumsum(first) - 1
        often = np.zeros(len(places), bool)
        often[order] = np.bincount(group)[group] >= TIMES
        kept, own = places[often], part[often]
        if not len(kept):
            return kept, own
        part = np.cumsum(np.r_[True, (kept[1:] != kept[:-1] + 1) | (own[1:] != own[:-1])]) - 1
        long = np.bincount(part)[part] >= SHORTEST
        if often.all() and long.all():
            return kept, part
        places, part = kept[long], part[long]
    return places, part


def stretches(equal: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of True of at least so many."""
    turns = np.flatnonzero(np.diff(np.r_[np.int8(0), equal.view(np.int8), np.int8(0)]))
    starts, ends = turns[::2], turns[1::2]
    long = ends - starts >= least
    return starts[long], ends[long]


def grown(w: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The maximal stretch [start, end) around at in which each word equals the one lag words later."""

    def reach(a: np.ndarray, b: np.ndarray) -> int:
        done, step = 0, 64
        while done < len(a):
            same = a[done : done + step] == b[done : done + step]
            if not same.all():
                return done + int(np.argmin(same))
            done, step = done + len(same), 2 * step
        return done

    end = at + reach(w[at : len(w) - lag], w[at + lag :])
    start = at - reach(w[:at][::-1], w[lag : at + lag][::-1])
    return start, end


def runs_in(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of every run of w; w has words that occur once wherever a run must not pass."""
    found: dict[tuple[int, int], int] = {}
    for lag in range(1, min(FEW, len(w) // TIMES + 1)):
        starts, ends = stretches(w[:-lag] == w[lag:], max(SHORTEST, TIMES * lag) - lag)
        for start, end in zip(starts.tolist(), ends.tolist()):
            found.setdefault((start, end + lag), lag)  # a multiple of a run's period finds the same stretch again
    longest = longest_part(w)
    scale, grams = FEW, doubled(w, FEW)
    while TIMES * scale <= longest:
        cover = np.zeros(len(w) + 1, np.int64)  # at each place, the furthest end of the shorter-period runs that start there or before
        for start, end in found:
            cover[start] = max(cover[start], end)
        np.maximum.accumulate(cover, out=cover)
        rows = len(grams) // scale - 1
        if rows < 1:
            break
        anchors = grams[: rows * scale : scale]
        row, ahead = np.nonzero(grams[scale : (rows + 1) * scale].reshape(rows, scale) == anchors[:, None])
        tail = grams[(rows + 1) * scale :]  # the last anchor's distances stop at the end of the words
        last = np.flatnonzero(tail[:scale] == grams[rows * scale])
        at, lag = np.r_[row * scale, np.full(len(last), rows * scale)], np.r_[ahead, last] + scale
        new = cover[at] < at + 2 * lag  # else the stretch repeats with a shorter period, of which the lag is a multiple
        at, lag = at[new], lag[new]
        order = np.lexsort((at, lag))
        before, passed = 0, 0
        for p, q in zip(at[order].tolist(), lag[order].tolist()):
            if q == before and p < passed:
                continue
            start, end = grown(w, p, q)
            before, passed = q, end
            if end - start + q >= TIMES * q:
                found.setdefault((start, end + q), q)
        grams = mixed(grams[:-scale], grams[scale:]) if len(grams) > scale else grams[:0]
        scale *= 2
    return [(start, end, q) for (start, end), q in found.items()]


def longest_part(w: np.ndarray) -> int:
    """Words of the longest part of w; parts are closed by negative words."""
    ends = np.flatnonzero(w < 0)
    return int(np.diff(np.r_[-1, ends]).max()) - 1 if len(ends) else len(w)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, of 64 bits."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def doubled(w: np.ndarray, size: int) -> np.ndarray:
    """A hash of the size words, a power of two, from each place on."""
    grams, have = mixed(w.astype(np.uint64), w.astype(np.uint64) >> np.uint64(7)), 1
    while have < size and len(grams) > have:
        grams, have = mixed(grams[:-have], grams[have:]), 2 * have
    return grams if have == size else grams[:0]


def batch_runs(words: np.ndarray, sizes: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Of each document, its runs as (start, length, period), by start and period. words: of all, sizes: of each."""
    offsets = np.r_[0, np.cumsum(sizes)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    places, part = frequent_parts(words, np.repeat(np.arange(len(sizes)), sizes))
    if not len(places):
        return out
    slots = np.arange(len(places)) + part  # one free slot after each part
    w = -1 - np.arange(slots[-1] + 2, dtype=np.int64)  # words that occur once
    w[slots] = words[places]
    for start, end, q in runs_in(w):
        first = int(places[np.searchsorted(slots, start)])
        doc = int(np.searchsorted(offsets, first, "right")) - 1
        out[doc].append((first - int(offsets[doc]), end - start, q))
    for own in out:
        own.sort(key=lambda r: (r[0], r[2]))
    return out


def greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run with the greatest length / period, exactly; ties to the smaller start, then period. runs are in that order."""
    best = runs[0]
    for r in runs[1:]:
        if r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words, in order, and the number of words of each text; a null text has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    before = np.r_[0, np.cumsum(full)]
    bounds = before[offsets - offsets[0]]
    return flat.filter(pa.array(full)), np.diff(bounds)


def held(batches: Iterator[pa.RecordBatch], most: int = BATCH) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, ...) in slices of some bytes of text, one row at least; nothing is copied."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def read(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, list, pa.Array]:
    """Words, their number a document, runs a document, and the documents' collapsed texts.

    A third column, if there is one, holds (from, period) where a document's words from that one on are to be read as
    repetitions of the period words there, else null.
    """
    flat, sizes = words_of(batch.column(1))
    offsets = np.r_[0, np.cumsum(sizes)]
    index = np.arange(len(flat))
    if batch.num_columns > 2:
        for doc in np.flatnonzero(pc.is_valid(batch.column(2)).to_numpy(zero_copy_only=False)).tolist():
            spec = batch.column(2)[doc].as_py()
            a, p, base = spec["from"], spec["period"], int(offsets[doc])
            index[base + a : base + sizes[doc]] = base + a + np.arange(sizes[doc] - a) % p
        flat = flat.take(pa.array(index))
    words = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(flat) else index
    runs = batch_runs(words, sizes)
    kept = np.ones(len(flat), bool)
    for doc, own in enumerate(runs):
        for start, length, q in own:
            base = int(offsets[doc]) + start
            kept[base + q : base + length] = False
    left = pa.array(np.r_[0, np.cumsum(kept)][offsets], pa.int32())
    collapsed = pc.binary_join(pa.ListArray.from_arrays(left, flat.filter(pa.array(kept))), pa.scalar(" ", flat.type))
    return flat, sizes, runs, collapsed


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in held(batches):
        _, sizes, runs, collapsed = read(batch)
        best = [greatest(own) if own else (None,) * 3 for own in runs]
        columns = [
            batch.column(0), pa.array(sizes, pa.int64()), pa.array(map(len, runs), pa.int64()), *(pa.array([b[k] for b in best], pa.int64()) for k in range(3)),
            pa.array([None if b[0] is None else 1000 * b[1] // b[2] for b in best], pa.int64()),
            pa.array([digest("".join(f"{s},{n},{q}\n" for s, n, q in own).encode()) for own in runs]),
            pa.array([digest(x.as_buffer()) for x in collapsed]),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])


def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in held(batches):
        _, _, runs, collapsed = read(batch)
        rows = [[{"start": s, "length": n, "period": q} for s, n, q in own] for own in runs]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, runs), pa.int64()), pa.array(rows, kind), collapsed.cast(pa.string())], names=["doc_id", "n_runs", "runs", "collapsed"])


def _read(docs: DataFrame, planted) -> DataFrame:
    own = [F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")]
    return docs.select(*own, *([] if planted is None else [planted.alias("planted")]))


def run_summaries(docs: DataFrame, planted=None) -> DataFrame:
    """Of every row of docs(doc_id, text): number of words and runs, the run with the most periods, digests of runs and collapsed text.

    planted: a column struct<from, period>, or null, of words to be read as repetitions: a self-test on real texts.
    """
    return _read(docs, planted).mapInArrow(summaries, SCHEMA)


def collapsed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, runs and the text in which of every run only the first period is left, words joined by one blank."""
    return _read(docs, None).mapInArrow(collapse, TEXTS)


def planted_runs(doc_id, text):
    """A tenth of the documents, by the crc32 of the id: their words from some place on are to repeat with some period."""
    h = F.crc32(doc_id.cast("bigint").cast("string").cast("binary"))
    n = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("bigint")
    g = F.floor(h / 10)
    start = F.pmod(g, F.nullif(n, F.lit(0)))
    period = 1 + F.floor((n - start) / (3 + F.pmod(g, F.lit(8))))
    return F.when((h % 10 == 0) & (n > 0), F.struct(start.alias("from"), period.cast("bigint").alias("period")))
