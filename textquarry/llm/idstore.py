"""Token ids in a content-addressed store.

Every document's ids are cut where a rolling hash of the last GEAR ids ends in zero bits, so equal
passages give equal chunks wherever they stand. A chunk is addressed by the SHA-256 of its bytes and
stored once; a document's recipe lists its chunks; recipes are written in ascending doc_id order, and a
Merkle manifest has, for each part of the recipes, the numbers of its documents and ids and the root over
its recipes, and one root over all parts. Readers check every chunk against its address, every recipe's
chunks against what is stored, and every part against its root: a chunk, recipe or part that is missing,
repeated or changed fails the query.

The encoder library is run on distinct pre-tokens where the definition's rules allow it: white space and
changes between letters, digits and signs part them, so a text's ids are those of its pre-tokens. Texts
with characters beyond Latin letters are encoded whole. Which copy of a chunk is kept is decided on
addresses alone, then each kept chunk's bytes are moved once.

Defined cases: a null text is empty and has the end id only; documents with equal or null doc_id are
each stored, nulls first; texts are never cut short; an empty table gives an empty store; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textquarry.llm.shared import shared_dir
from textquarry.llm.words import mixed

END_ID = 2
#: Ids that the rolling hash sees; bits that are zero at a cut; least and most ids of a chunk.
GEAR, CUT_BITS, LEAST_IDS, MOST_IDS = 16, 8, 64, 2048
#: Words and signs that a worker remembers, and the longest that it does.
CACHE_WORDS, CACHE_CHARS = 500_000, 64
#: Bytes of text that are encoded together, and words whose ids are gathered at once.
PIECE_BYTES, GATHER_WORDS = 1 << 23, 1 << 18
#: Fixed value: the pre-tokenizer's pattern for which white space and changes between letters, digits and signs part pre-tokens.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters whose lower case may depend on others, or that marks may compose with: beyond Latin letters, and the dotted capital I.
_NOT_PLAIN = r"[^\x{0}-\x{12f}\x{131}-\x{24f}]"
#: Words of plain letters, digits and signs (but the apostrophe), and their pre-tokens.
_PARTED = re.compile("[!-&(-~\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
_PARTS = re.compile(r"[^\W\d_]+|[0-9]|(?:\W|_)+")
#: Recipes of one part, about.
PART_RECIPES = 100_000


def parts_of(word: str) -> tuple[str, ...] | list[str] | None:
    """The pre-tokens of a plain word; None if it has other characters."""
    if word.isalpha():
        return (word,)
    if word[-1] in ",." and word[:-1].isalpha():
        return word[:-1], word[-1]
    return _PARTS.findall(word) if _PARTED.fullmatch(word) else None


class WordEncoder:
    """Ids of whole texts from a tokenizer that lower-cases, drops white space and marks word ends.

    Where the definition's rules allow it, the distinct words of a piece of the table are found by Arrow, those that are new
    are parted into pre-tokens and encoded by the library once each, and all words' ids are gathered with numpy.
    """

    def __init__(self, definition: str):
        self.library = Tokenizer.from_str(definition)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.width = np.dtype("<u2" if len(self.ends) <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {"": b""}
        rules = json.loads(definition)
        steps = [x["type"] for x in (rules.get("normalizer") or {}).get("normalizers", [])]
        split, *rest = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_word = (
            steps == ["NFC", "Replace", "Lowercase"] and rules["model"].get("end_of_word_suffix") == "</w>"
            and (split.get("behavior"), split.get("invert"), (split.get("pattern") or {}).get("Regex")) == ("Removed", True, SPLIT_PATTERN)
        )
        #: Texts with one of these, in any case, are left to the library.
        self.added = sorted({t["content"].lower() for t in rules.get("added_tokens", [])})
        #: The same vocabulary and merges, without the steps that leave a lower-case pre-token as it is.
        bare = {**rules, "normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *rest]}}
        self.bare = Tokenizer.from_str(json.dumps(bare)) if self.by_word else None

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.width).tobytes()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [self._packed(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _pre_tokens(self, found: list[str]) -> list[bytes]:
        """Ids of pre-tokens: one run of them is encoded and parted at word ends."""
        out = []
        for at in range(0, len(found), 1024):
            part = found[at : at + 1024]
            ids = np.array(self.bare.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.width)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part) or ends[-1] != len(ids):
                out += self._whole(part)
                continue
            data, bounds = ids.tobytes(), [0, *(self.width.itemsize * ends).tolist()]
            out += [data[a:b] for a, b in zip(bounds, bounds[1:])]
        return out

    def _ids_of(self, found: list[str]) -> list[bytes]:
        """Ids of distinct plain words, in lower case; new pre-tokens are remembered while there is room."""
        out = list(map(self.known.get, found))
        new = [k for k, x in enumerate(out) if x is None]
        parts = {k: parts_of(found[k]) for k in new}
        unknown = list({p: None for own in parts.values() if own for p in own if p not in self.known})
        here = dict(zip(unknown, self._pre_tokens(unknown)))
        for p, ids in here.items():
            if len(self.known) >= CACHE_WORDS:
                break
            if len(p) <= CACHE_CHARS:
                self.known[p] = ids
        odd = [k for k in new if parts[k] is None]
        for k, ids in zip(odd, self._whole([found[k] for k in odd]) if odd else ()):
            out[k] = ids
        for k in new:
            if parts[k] is not None:
                out[k] = b"".join([here[p] if p in here else self.known[p] for p in parts[k]])
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text's end)."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not len(texts):
            return np.empty(0, self.width), np.empty(0, np.int64)
        lower = pc.utf8_lower(texts)
        odd = pc.match_substring_regex(texts, _NOT_PLAIN) if self.by_word else pa.array(np.ones(len(texts), bool))
        for token in self.added if self.by_word else ():
            odd = pc.or_(odd, pc.match_substring(lower, token))
        lists = pc.ascii_split_whitespace(pc.if_else(odd, "", lower))
        words = lists.values.dictionary_encode()
        distinct = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words.dictionary)], pa.int32()), words.dictionary), "\n")[0].as_py().split("\n")
        each = self._ids_of(distinct)
        place = words.indices.to_numpy()
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // self.width.itemsize
        flat, begins = np.frombuffer(b"".join(each), self.width), np.cumsum(sizes) - sizes
        ids = []
        for at in range(0, len(place), GATHER_WORDS):
            own = place[at : at + GATHER_WORDS]
            n = sizes[own]
            past = np.cumsum(n)
            ids.append(flat[np.repeat(begins[own] - (past - n), n) + np.arange(past[-1])])
        ids = np.concatenate(ids) if ids else np.empty(0, self.width)
        ends = np.concatenate([[0], np.cumsum(sizes[place])])[lists.offsets.to_numpy()[1:]]
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if not len(whole):
            return ids, ends
        lengths = np.diff(ends, prepend=0)
        own = [np.frombuffer(x, self.width) for x in self._whole(texts.take(pa.array(whole)).to_pylist())]
        ids = np.insert(ids, np.repeat(ends[whole], [len(x) for x in own]), np.concatenate(own))
        lengths[whole] = [len(x) for x in own]
        return ids, np.cumsum(lengths)


_ENCODERS: dict[int, WordEncoder] = {}


def worker_encoder(definition: str) -> WordEncoder:
    key = hash(definition)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(definition)
    return _ENCODERS[key]


_BASE, _SPREAD = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_BLOCK = 1 << 16


def _powers(base: int) -> np.ndarray:
    out = np.full(_BLOCK + GEAR, np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS, _INVERSES = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


_SMALL_IDS = mixed(np.arange(1, (1 << 16) + 1, dtype=np.uint64))


def spread(ids: np.ndarray) -> np.ndarray:
    """A hash of each id; looked up for ids of 16 bits."""
    return _SMALL_IDS[ids] if ids.dtype.itemsize == 2 else mixed(ids.astype(np.uint64) + np.uint64(1))


def marks(ids: np.ndarray) -> np.ndarray:
    """Places after each run of GEAR ids whose hash, a polynomial taken from prefix sums, ends a chunk."""
    found = []
    for at in range(0, len(ids) - GEAR + 1, _BLOCK):
        part = spread(ids[at : at + _BLOCK + GEAR - 1])
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _POWERS[: len(part)], out=sums[1:])
        rolled = (sums[GEAR:] - sums[:-GEAR]) * _INVERSES[: len(part) - GEAR + 1]
        found.append(np.flatnonzero((rolled * _SPREAD) >> np.uint64(64 - CUT_BITS) == 0) + (at + GEAR))
    return np.concatenate(found) if found else np.empty(0, np.int64)


def cuts(ids: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """For each text of ids (which end at ends) the ends of its chunks, by content.

    Chunks have LEAST_IDS to MOST_IDS ids, a text's last may have fewer. A run that reaches back into another text ends
    within the first LEAST_IDS of its own, where no chunk does.
    """
    places, out, start = marks(ids), [], 0
    bounds = [0, *np.searchsorted(places, ends).tolist()]
    places = places.tolist()
    for a, b, end in zip(bounds, bounds[1:], ends.tolist()):
        chunks = []
        for stop in [*places[a:b], end]:
            while stop - start > MOST_IDS:
                start += MOST_IDS
                chunks.append(start)
            if stop - start >= LEAST_IDS or stop == end and stop > start:
                chunks.append(stop)
                start = stop
        out.append(chunks)
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up as it is, no leaf gives the hash of nothing."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[k : k + 2])).digest() if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


class MerkleFold:
    """The same root from leaves that come one by one, holding one node a level."""

    def __init__(self):
        self.levels: list[bytes | None] = []

    def add(self, leaf: bytes) -> None:
        node, k = hashlib.sha256(b"\0" + leaf).digest(), 0
        while k < len(self.levels) and self.levels[k] is not None:
            node, self.levels[k] = hashlib.sha256(b"\1" + self.levels[k] + node).digest(), None
            k += 1
        if k == len(self.levels):
            self.levels.append(None)
        self.levels[k] = node

    def root(self) -> bytes:
        node = None
        for other in self.levels:
            if other is not None:
                node = other if node is None else hashlib.sha256(b"\1" + other + node).digest()
        return node or hashlib.sha256(b"").digest()


def byte_pieces(texts: pa.Array):
    """Ranges of texts of about PIECE_BYTES together."""
    past = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(past):
        before = past[start - 1] if start else 0
        end = min(len(past), int(np.searchsorted(past, before + PIECE_BYTES)) + 1)
        yield start, end
        start = end


def _spooled(docs: DataFrame, definition: str) -> DataFrame:
    """row, doc_id, no, address, n, data (unsigned 16- or 32-bit ids) of every chunk, copies and all."""
    shipped = docs.sparkSession.sparkContext.broadcast(definition)
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("no", pa.int32()), ("address", pa.binary()), ("n", pa.int32()), ("data", pa.binary())])

    def run(batches):
        encoder = worker_encoder(shipped.value)
        for batch in batches:
            for start, end in byte_pieces(batch.column(2)):
                ids, ends = encoder.encode(batch.column(2).slice(start, end - start))
                ids = np.insert(ids, ends, END_ID)
                stops = cuts(ids, ends + np.arange(1, len(ends) + 1))
                at = np.repeat(np.arange(start, end), [len(x) for x in stops])
                bounds = np.array([0, *itertools.chain.from_iterable(stops)], np.int64)
                raw = memoryview(ids.tobytes())
                byte = (bounds * ids.itemsize).tolist()
                address = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(byte, byte[1:])]
                data = pa.Array.from_buffers(pa.binary(), len(address), [None, pa.py_buffer(np.array(byte, np.int32)), pa.py_buffer(raw)])
                rows = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.concatenate([np.arange(len(x)) for x in stops]), pa.int32()),
                    pa.array(address, pa.binary()), pa.array(np.diff(bounds), pa.int32()), data,
                ], schema=schema)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "row bigint, doc_id bigint, no int, address binary, n int, data binary")


def _leaf(doc_id, n: int, addresses: list[bytes]) -> bytes:
    return f"{doc_id}:{n}:".encode() + b"".join(addresses)


def _part_leaf(part: int, documents: int, tokens: int, root: bytes) -> bytes:
    return f"{part}:{documents}:{tokens}:".encode() + root


def _numbered(recipes: DataFrame) -> DataFrame:
    """recipes(row, doc_id, n_tokens, chunks), sorted in each part, with their place in the part and its Merkle fold so far."""
    schema = "part int, row bigint, doc_id bigint, n_tokens bigint, start_in_part bigint, chunks array<struct<no:int,address:binary,n:int>>, root_so_far binary"

    def run(batches):
        fold, done = MerkleFold(), 0
        for batch in batches:
            starts, roots = [], []
            docs, tokens = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            lists = batch.column(4)
            for k in range(batch.num_rows):
                starts.append(done)
                done += tokens[k]
                fold.add(_leaf(docs[k], tokens[k], lists[k].values.field("address").to_pylist()))
                roots.append(fold.root())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(starts, pa.int64()), lists, pa.array(roots, pa.binary())],
                                             names=["part", "row", "doc_id", "n_tokens", "start_in_part", "chunks", "root_so_far"])

    return recipes.select(F.spark_partition_id().alias("part"), "row", "doc_id", "n_tokens", "chunks").mapInArrow(run, schema)


def write_store(docs: DataFrame, definition: str, path: str | None = None) -> str:
    """Encode docs and write the store; returns its path."""
    spark = docs.sparkSession
    path = path or shared_dir(spark, "idstore")
    spool = f"{path}/spool"
    _spooled(docs, definition).write.option("compression", "zstd").parquet(spool)
    spooled = spark.read.parquet(spool)
    kept = spooled.groupBy("address").agg(F.min(F.struct("row", "no")).alias("k")).select("k.row", "k.no")
    spooled.join(kept, ["row", "no"], "left_semi").select("address", "n", "data").write.option("compression", "zstd").parquet(f"{path}/chunks")
    lists = spooled.groupBy("row", "doc_id").agg(
        F.sum("n").cast("bigint").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("no", "address", "n"))).alias("chunks"))
    count = docs.count()
    parts = max(1, -(-count // PART_RECIPES), min(spark.sparkContext.defaultParallelism, -(-count // 1000)))
    ordered = lists.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "row").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row")
    _numbered(ordered).write.option("compression", "zstd").parquet(f"{path}/recipes")
    # A row a part: the last fold of a part is its root. The number of parts bounds what reaches the driver.
    ends = spark.read.parquet(f"{path}/recipes").groupBy("part").agg(
        F.max_by(F.struct((F.col("start_in_part") + F.col("n_tokens")).alias("tokens"), "root_so_far"), F.struct("start_in_part", "row")).alias("e"), F.count(F.lit(1)).alias("documents")
    ).select("part", "documents", "e.*").orderBy("part").collect()
    rows, before = [], 0
    for r in ends:
        rows.append((r.part, r.documents, before, r.tokens, bytes(r.root_so_far)))
        before += r.tokens
    root = merkle([_part_leaf(x[0], x[1], x[3], x[4]) for x in rows])
    spark.createDataFrame([(*x, root) for x in rows], "part int, documents bigint, tokens_before bigint, tokens bigint, root binary, store_root binary").coalesce(1).write.parquet(f"{path}/manifest")
    # What was spooled holds copies; the store keeps each chunk once.
    place = spark._jvm.org.apache.hadoop.fs.Path(spool)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return path


_CRC_POLY = np.uint32(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo the CRC's, bits reflected."""
    out, b = np.zeros(np.broadcast(a, b).shape, np.uint32), np.broadcast_to(b, np.broadcast(a, b).shape).copy()
    for k in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(k) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), (b >> np.uint32(1)) ^ _CRC_POLY, b >> np.uint32(1))
    return out


def shifted_crc(crc: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """What a block's CRC-32 adds to that of a text in which tail bytes follow it; the additions are xored."""
    crc, left = crc.astype(np.uint32), tail.astype(np.uint64)
    power = np.full(1, np.uint32(1 << 23))  # x to the 8th, reflected
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        crc[odd] = _times(crc[odd], power)
        power, left = _times(power, power), left >> np.uint64(1)
    return crc


def _stored_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("address binary, n int, data binary").parquet(f"{path}/chunks")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """address, bytes and crc (of the ids as 32-bit) of every stored chunk; fails if one does not match its address."""
    schema = pa.schema([("address", pa.binary()), ("bytes", pa.int64()), ("crc", pa.int64())])

    def run(batches):
        for batch in batches:
            address, n, data = (batch.column(k).to_pylist() for k in range(3))
            wide = [_checked_ids(a, k, d).astype("<u4").tobytes() for a, k, d in zip(address, n, data)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in wide], pa.int64()), pa.array([zlib.crc32(w) for w in wide], pa.int64())], schema=schema)

    return _stored_chunks(spark, path).mapInArrow(run, "address binary, bytes bigint, crc bigint")


def _checked_ids(address: bytes, n: int, data: bytes) -> np.ndarray:
    if hashlib.sha256(data).digest() != address or len(data) not in (2 * n, 4 * n):
        raise ValueError("a chunk does not match its address")
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4")


def _checked_manifest(spark: SparkSession, path: str) -> list:
    """A row a part, in order, after its roots have been checked, and the recipes' numbers against it."""
    manifest = sorted(spark.read.parquet(f"{path}/manifest").collect(), key=lambda r: r.part)
    before = 0
    for r in manifest:
        if r.tokens_before != before or bytes(r.store_root) != bytes(manifest[0].store_root):
            raise ValueError("the manifest is not whole")
        before += r.tokens
    if manifest and merkle([_part_leaf(r.part, r.documents, r.tokens, bytes(r.root)) for r in manifest]) != bytes(manifest[0].store_root):
        raise ValueError("the manifest does not match its root")
    recipes = spark.read.schema("part int, n_tokens bigint").parquet(f"{path}/recipes")
    found = recipes.groupBy("part").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens")).collect()
    if sorted((r.part, r.documents, r.tokens) for r in found) != [(r.part, r.documents, r.tokens) for r in manifest]:
        raise ValueError("recipes are missing, or there are too many")
    return manifest


def _checked_uses(spark: SparkSession, path: str) -> DataFrame:
    """row, doc_id, start, n_tokens, n_chunks, no, address, n, tail: a row for each chunk of each recipe, tail being the ids after it.

    Every part's recipes are put in order and folded again; a part that does not match its root fails.
    """
    manifest = _checked_manifest(spark, path)
    parts = {r.part: (r.tokens_before, bytes(r.root)) for r in manifest}
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("n_chunks", pa.int32()), ("no", pa.int32()),
                        ("address", pa.binary()), ("n", pa.int64()), ("tail", pa.int64())])

    def run(batches):
        fold, part, done = MerkleFold(), None, 0
        for batch in batches:
            lists = batch.column(5)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            chunks = lists.flatten()
            addresses, n = chunks.field("address"), chunks.field("n").to_numpy().astype(np.int64)
            ends = np.cumsum(sizes)
            names = addresses.to_pylist()
            starts = np.empty(batch.num_rows, np.int64)
            for k, (p, doc, tokens, at) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4)))):
                if p != part:
                    if part is not None and fold.root() != parts[part][1]:
                        raise ValueError(f"part {part} does not match its root")
                    fold, part, done = MerkleFold(), p, 0
                own = names[ends[k] - sizes[k] : ends[k]]
                fold.add(_leaf(doc, tokens, own))
                if at != done or n[ends[k] - sizes[k] : ends[k]].sum() != tokens:
                    raise ValueError(f"a recipe of part {part} does not add up")
                starts[k] = parts[p][0] + done
                done += tokens
            past = np.cumsum(n)
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            of = pa.array(owner)
            yield pa.RecordBatch.from_arrays([
                batch.column(1).take(of), batch.column(2).take(of), pa.array(starts[owner]), batch.column(3).take(of), pa.array(sizes[owner], pa.int32()),
                chunks.field("no"), addresses, pa.array(n), pa.array(past[ends[owner] - 1] - past),
            ], schema=schema)
        if part is not None and fold.root() != parts[part][1]:
            raise ValueError(f"part {part} does not match its root")

    # A part is one sorted file of about PART_RECIPES recipes; here it is put together again in its order.
    recipes = spark.read.parquet(f"{path}/recipes").select("part", "row", "doc_id", "n_tokens", "start_in_part", "chunks")
    rows = recipes.repartition("part").sortWithinPartitions("part", "start_in_part", "row")
    return rows.mapInArrow(run, "row bigint, doc_id bigint, start bigint, n_tokens bigint, n_chunks int, no int, address binary, n bigint, tail bigint")


def _whole(condition, value, what: str):
    """value where condition holds; else the query fails."""
    return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(F.raise_error(F.lit(what)))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the store's files.

    Each stored chunk is read and checked once; a document's checksum is put together from its chunks'. A chunk that is
    missing, changed, stored twice or of another length than the recipe says fails the query.
    """
    joined = _checked_uses(spark, path).join(read_chunks(spark, path), "address", "left")
    crc = _whole(F.col("bytes") == F.col("n") * 4, F.col("crc"), "a chunk is missing or of another length")
    joined = joined.select("row", "doc_id", "start", "n_tokens", "n_chunks", crc.alias("crc"), (F.col("tail") * 4).alias("tail"))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("n_chunks", pa.int32()), ("crc", pa.int64())])

    def run(batches):
        for batch in batches:
            crc = shifted_crc(batch.column(5).to_numpy(), batch.column(6).to_numpy()).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(crc)], schema=schema)

    parts = joined.mapInArrow(run, "row bigint, doc_id bigint, start bigint, n_tokens bigint, n_chunks int, crc bigint")
    merged = parts.groupBy("row", "doc_id", "start", "n_tokens", "n_chunks").agg(F.bit_xor("crc").alias("crc"), F.count(F.lit(1)).alias("found"))
    return merged.select("doc_id", "start", "n_tokens", _whole(F.col("found") == F.col("n_chunks"), F.col("crc"), "a chunk is stored twice").alias("ids_crc32"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and ids (array of int) of every document, put together again; fails on the same faults as read_digests."""
    joined = _checked_uses(spark, path).join(_stored_chunks(spark, path).withColumnRenamed("n", "stored"), "address", "left")
    piece = F.struct("no", "n", "address", _whole(F.col("stored") == F.col("n"), F.col("data"), "a chunk is missing or of another length").alias("data"))
    lists = joined.groupBy("row", "doc_id", "start", "n_chunks").agg(F.array_sort(F.collect_list(piece)).alias("d"))
    lists = lists.select("doc_id", "start", _whole(F.size("d") == F.col("n_chunks"), F.col("d"), "a chunk is stored twice").alias("d"))

    def run(batches):
        for batch in batches:
            ids = [np.concatenate([_checked_ids(x["address"], x["n"], x["data"]).astype(np.int32) for x in d]) for d in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([i.tolist() for i in ids], pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    return lists.mapInArrow(run, "doc_id bigint, start bigint, ids array<int>")
