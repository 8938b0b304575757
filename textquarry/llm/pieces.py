"""SentencePiece encoding and decoding that keeps each piece's place in the original bytes.

The model's normaliser is read from its compiled character map: a double-array trie of source prefixes
and their replacements. Normalisation takes the longest prefix at each place and records, for every
normalised byte, the source byte it came from. The library encodes; each piece's normalised bytes are
projected through that alignment to a span of original bytes. Byte-fallback pieces cover their own byte.

Where the model allows it - byte-pair pieces, an empty character map, no whitespace removal, and no piece
with a word start after its first letter - merges never cross from one word to the next, so a text's
pieces are those of its space-led words: the words of a worker's texts are encoded and normalised once
each, and their pieces' source widths, taken through the alignment, are put together to the text's spans.
Otherwise each text is encoded and normalised as a whole. Both ways give the library's ids.

Defined cases: a null text is empty and has the begin and end ids only; texts are never cut; null ids and
repeated rows are carried as they are; empty tables give no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from textquarry.llm.shared import small
from textquarry.llm.words import pieces_of

SPACE = "▁"
#: Words a worker remembers, and the longest that it does.
CACHE_WORDS, CACHE_CHARS = 120_000, 64
#: Characters that are encoded at once: their words, ids and spans are what a worker holds.
AT_ONCE = 1 << 19
_UNITS = re.compile(r" +[^ ]+| +")


class CharMap:
    """Longest-prefix rules of a compiled character map (a Darts-clone double array and a string pool)."""

    def __init__(self, blob: bytes):
        self.units, self.pool = np.empty(0, np.uint32), b""
        if blob:
            size = int.from_bytes(blob[:4], "little")
            self.units, self.pool = np.frombuffer(blob[4 : 4 + size], "<u4"), blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(source bytes, replacement) of the longest rule that matches at a place."""
        if not len(self.units):
            return None
        found, units = None, self.units
        node = self._offset(int(units[0]))
        for k in range(at, len(data)):
            node ^= data[k]
            unit = int(units[node]) if node < len(units) else 0
            if unit & 0x800000FF != data[k]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (k + 1 - at, int(units[node]) & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.pool[found[1] : self.pool.index(b"\0", found[1])]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


class Normaliser:
    """Normalised bytes by the longest rule at each place, with the source byte of each; prefix: whether a space is put before a text."""

    def __init__(self, spec, prefix: bool | None = None):
        self.map = CharMap(bytes(spec.precompiled_charsmap))
        self.prefix, self.squeeze = spec.add_dummy_prefix if prefix is None else prefix, spec.remove_extra_whitespaces

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """(normalised bytes with visible spaces, source byte of each and the end)."""
        out, source = self.aligned(text)
        return out, np.array(source, np.int64)

    def aligned(self, text: str) -> tuple[bytes, list[int]]:
        data = text.encode("utf-8")
        if not len(self.map.units) and not self.prefix and not self.squeeze and data.rfind(b" ") == 0:
            # No rule can match, and the one space leads: each byte is its own source.
            return SPACE.encode() + data[1:], [0, 0, *range(len(data) + 1)]
        chunks: list[tuple[int, bytes, int]] = []
        at = 0
        while at < len(data):
            rule = self.map.longest(data, at)
            if rule is None:
                n = 1 + sum(data[at] >= x for x in (0xC0, 0xE0, 0xF0))
                rule = (n, data[at : at + n])
            chunks.append((at, rule[1], at + rule[0]))
            at += rule[0]
        out, source, last_space = bytearray(), [], self.squeeze
        end = len(data)
        if self.squeeze:
            while chunks and chunks[-1][1].strip(b" ") == b"" :
                end = chunks.pop()[0]
            while chunks and chunks[0][1].strip(b" ") == b"":
                chunks.pop(0)
        if chunks and self.prefix:
            out += SPACE.encode()
            source += [chunks[0][0]] * 3
        for start, new, stop in chunks:
            same = data[start:stop] == new  # bytes that no rule has changed are their own sources
            if self.squeeze and last_space:
                new = new.lstrip(b" ")
            for k, byte in enumerate(new):
                piece = SPACE.encode() if byte == 32 else bytes([byte])
                out += piece
                source += [start + k if same else start] * len(piece)
            if new:
                last_space = new.endswith(b" ")
        return bytes(out), [*source, end]


class Encoder:
    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        self.normalise = Normaliser(spec.normalizer_spec)
        self.bos, self.eos = self.library.bos_id(), self.library.eos_id()
        kinds = np.array([p.type for p in spec.pieces])
        self.is_byte = kinds == 6
        self.by_word = (
            spec.trainer_spec.model_type == 2 and not spec.normalizer_spec.precompiled_charsmap
            and not spec.normalizer_spec.remove_extra_whitespaces and spec.normalizer_spec.add_dummy_prefix
            and not spec.trainer_spec.treat_whitespace_as_suffix and not (kinds == 4).any()
            and not any(SPACE in p.piece.lstrip(SPACE) for p in spec.pieces)
        )
        #: Normalised bytes of each piece, and the normaliser of words that have their space.
        self.sizes = [1 if b else len(p.piece.encode()) for p, b in zip(spec.pieces, self.is_byte)]
        self.led = Normaliser(spec.normalizer_spec, prefix=False)
        #: Of each known word, pairs of an id and the source bytes that its piece covers.
        self.pairs: dict[str, bytes] = {"": np.uint32([self.library.piece_to_id(SPACE), 1]).tobytes()}

    def _learn(self, found: set[str]) -> dict[str, bytes]:
        """Encode the words of found that are not known yet; the result has those that are not kept."""
        new, rest = [w for w in found if w not in self.pairs], {}
        for w, own in zip(new, self.library.encode(new, num_threads=1)):
            normal, source = self.led.aligned(" " + w)
            pairs, at, before = array("I"), 0, 0
            for i in own:
                at += self.sizes[i]
                pairs.extend((i, source[at] - before))
                before = source[at]
            if at != len(normal):
                raise ValueError("the pieces do not cover the normalised word")
            (self.pairs if len(self.pairs) < CACHE_WORDS and len(w) <= CACHE_CHARS else rest)[w] = pairs.tobytes()
        return rest

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids with begin and end, spans as an array of begin and end byte for each id) of each text."""
        if not self.by_word:
            return [self._whole(t) for t in texts]
        split = [None if SPACE in t else self._split(t) for t in texts]
        rest = self._learn(set().union(*(x for x in split if x)))
        of = (lambda w: self.pairs.get(w) or rest[w]) if rest else self.pairs.__getitem__
        out = []
        for text, found in zip(texts, split):
            if found is None:
                out.append(self._whole(text))
                continue
            own, widths = np.frombuffer(b"".join(map(of, found)), np.uint32).reshape(-1, 2).T
            ends = np.cumsum(widths, dtype=np.uint32)
            if len(ends):
                ends -= np.uint32(1)  # the first word's leading space is not in the text
            out.append(self._framed(own, np.concatenate([np.zeros(1, np.uint32), ends[:-1]]) if len(ends) else ends, ends))
        return out

    @staticmethod
    def _split(text: str) -> list[str]:
        """Space-led words without their first space."""
        if not text:
            return []
        if text[0] == " " or "  " in text:
            return [u[1:] for u in _UNITS.findall(" " + text)]
        return text.split(" ")

    def _framed(self, ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        last = ends[-1] if len(ends) else 0
        spans = np.zeros((len(ids) + 2, 2), np.uint32)
        spans[1:-1, 0], spans[1:-1, 1], spans[-1] = begins, ends, last
        return np.concatenate([[self.bos], ids, [self.eos]]).astype(np.uint32), spans

    def _whole(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Encode a whole text; project pieces through the normaliser's alignment."""
        normal, source = self.normalise(text)
        ids = np.array(self.library.encode(text), np.int64)
        pieces = self.library.encode(text, out_type=str)
        sizes = [1 if self.is_byte[i] else len(p.encode()) for i, p in zip(ids, pieces)]
        cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        if cuts[-1] != len(normal):
            raise ValueError("the pieces do not cover the normalised text")
        return self._framed(ids, source[cuts[:-1]], source[cuts[1:]])

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


def encoded(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), spans (begin and end byte of each id, alike), decoded."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("spans", pa.binary()), ("decoded", pa.string())])

    def run(batches):
        encoder = worker_encoder(shipped.value)
        for batch in small(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for start, end in pieces_of(texts, AT_ONCE):
                found = encoder.encode(texts[start:end])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, end - start), pa.array([len(i) for i, _ in found], pa.int64()),
                    pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([s.tobytes() for _, s in found], pa.binary()),
                    pa.array([encoder.decode(i) for i, _ in found], pa.string()),
                ], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, spans binary, decoded string")


_ENCODERS: dict[int, Encoder] = {}


def worker_encoder(model: bytes) -> Encoder:
    """One encoder for each model and worker, so that its words stay known from task to task."""
    key = hash(model)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(model)
    return _ENCODERS[key]
