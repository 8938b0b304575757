"""Word and shingle hashing in numpy, shared by the operators that compare texts by word n-grams."""

from __future__ import annotations

import re

import numpy as np

#: Words a shingle has, unless a caller says otherwise.
SHINGLE_WORDS = 5
#: Bytes of text that are hashed together; longer texts are cut between words.
PIECE_BYTES = 1 << 19

_OTHER = re.compile(r"[^\w\x00-\x7f]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BREAK = re.compile(rb"[^0-9A-Za-z_\x80-\xff]")

_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS, _INVERSES = _powers(_BASE, PIECE_BYTES), _powers(_BASE_INVERSE, PIECE_BYTES)


def plain(text: str | None) -> bytes:
    """Lower case in UTF-8; characters outside ASCII that no word has become spaces."""
    if not text:
        return b""
    text = text.lower()
    return (text if text.isascii() else _OTHER.sub(" ", text)).encode("utf-8", "surrogatepass")


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_runs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, 64-bit hash) of every word of data: a polynomial in the word's bytes, by prefix sums."""
    global _POWERS, _INVERSES
    raw = np.frombuffer(data, np.uint8)
    if len(raw) + 1 > len(_POWERS):
        _POWERS, _INVERSES = _powers(_BASE, 2 * len(raw)), _powers(_BASE_INVERSE, 2 * len(raw))
    edges = np.flatnonzero(np.diff(_IN_WORD[raw].view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(raw)], out=sums[1:])
    return starts, mixed((sums[ends] - sums[starts]) * _INVERSES[starts])


def _cut(data: bytes, start: int) -> int:
    """Where a piece that begins at start ends: at a byte that no word has, or at the end."""
    if len(data) - start <= PIECE_BYTES:
        return len(data)
    found = _BREAK.search(data, start + PIECE_BYTES - 1)
    return found.start() + 1 if found else len(data)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text).

    A word is a maximal run of letters, digits and underscores in lower case.
    """
    counts, out = np.zeros(len(texts), np.int64), []
    pending: list[tuple[int, bytes]] = []
    held = 0

    def flush() -> None:
        nonlocal pending, held
        if pending:
            starts, hashes = _hash_runs(b"\n".join(d for _, d in pending))
            bounds = np.cumsum([len(d) + 1 for _, d in pending])
            each = np.diff(np.searchsorted(starts, bounds), prepend=0)
            for (k, _), n in zip(pending, each):
                counts[k] += n
            out.append(hashes)
        pending, held = [], 0

    for k, text in enumerate(texts):
        data, at = plain(text), 0
        while at < len(data):
            end = _cut(data, at)
            if held + end - at + 1 > PIECE_BYTES:
                flush()
            pending.append((k, data if at == 0 and end == len(data) else data[at:end]))
            held += end - at + 1
            at = end
    flush()
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), counts


def shingle_lists(texts: list[str | None], n: int = SHINGLE_WORDS, short: bool = False) -> list[np.ndarray]:
    """For each text the hashes of its word n-grams in order, repeats kept.

    A text of fewer than n words has none, or with short=True one over all its words.
    """
    hashes, counts = word_hashes(texts)
    out, at = [], 0
    ends = np.cumsum(counts)
    if len(hashes) >= n:
        grams = np.full(len(hashes) - n + 1, np.uint64(n))
        for k in range(n):
            grams = grams * _ODD + hashes[k : k + len(grams)]
        grams = mixed(grams)
    else:
        grams = np.empty(0, np.uint64)
    for count, end in zip(counts.tolist(), ends.tolist()):
        if count >= n:
            out.append(grams[at : end - n + 1])
        elif count and short:
            one = np.full(1, np.uint64(count))
            for h in hashes[at:end]:
                one = one * _ODD + h
            out.append(mixed(one))
        else:
            out.append(np.empty(0, np.uint64))
        at = end
    return out


def pieces_of(texts: list, most: int = 1 << 22):
    """Ranges of texts that hold about most characters together, so that arrays over them stay small."""
    start, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text or "")
        if held >= most:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def permutations(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """k random affine maps of 32-bit words; the multipliers are odd, so each map is a permutation."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**32, k, np.uint32) | np.uint32(1), rng.integers(0, 2**32, k, np.uint32)


def folded(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(32)).astype(np.uint32)


def minhashes(x: np.ndarray, maps: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least value of each map over a non-empty array of 64-bit shingle hashes."""
    a, b = maps
    low = folded(x)
    out = np.full(len(a), np.uint32(0xFFFFFFFF))
    for at in range(0, len(low), 4096):
        np.minimum(out, (a[:, None] * low[None, at : at + 4096] + b[:, None]).min(axis=1), out=out)
    return out
