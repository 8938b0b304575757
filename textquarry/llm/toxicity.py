"""Toxicity: a support vector machine over a subsequence string kernel, with Nystrom landmarks.

The kernel of two strings is the subsequence kernel of length 3: every way to pick three characters in
order counts, weighted by DECAY for each character that the pick spans, and the value is divided by both
strings' norms. A gap or an inserted sign costs a factor and no more, so 'id-iot' stays near 'idiot'.

Training: a bounded sample of labelled documents gives bags of units, the words of their sentences with
spaced-out letters joined. Landmarks are chosen among the units; the Nystrom map takes a unit's kernel
values with them through the inverse root of their kernel matrix, and a linear machine with squared hinge
loss is trained on it by Newton steps. A toxic document's bag only says that some unit in it is toxic, so
the machine is retrained on the unit of each toxic bag that scores highest, among those that toxic documents have
LIKELIER times as often as clean ones: labels err, and the words of a wrongly labelled document are no insults. A logistic curve on held-back
bags turns a document's highest unit score into a probability. Kernel and machine see single words, and letters
that stand apart; a phrase of words that are each clean is not learned.

Scoring: the kernel has explicit features, so landmarks, map and machine fold into one weight for each
triple of characters; a unit then costs one look-up a triple. All units of the whole text are scored.

Labels are learned only from rows that are not held out. Defined cases: texts that are null or have no
unit score as the least toxic unit; long texts are scored whole, long units in overlapping pieces; documents without a
label are not learned from, and one with both labels counts as toxic; if no label, or one kind only, can be
learned from, every score is that kind's rate; repeated rows and null ids are scored row by row, the latter never
held out; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.shared import held_out, small
from textquarry.llm.words import pieces_of

DECAY = 0.5
#: Characters of a piece of a unit; longer units are cut with half a piece of overlap.
PIECE = 20
ALPHABET = 64
LANDMARKS = 384
#: Times the machine is trained, each time on harder units.
TURNS = 5
#: Evidence that makes a unit a first positive; least output for a toxic document's top unit to stay one, and
#: for a further unit of the document, with nearly that evidence, to become one.
EVIDENCE, DOUBT, FURTHER = 2.5, -0.3, 0.3
#: A unit can only be what makes a document toxic if toxic documents have it this many times as often as clean ones.
LIKELIER = 4
#: Fewer toxic documents than these say little about the curve; it is then fitted to the documents of the machine, none kept back.
KEPT_BACK = 20
#: Bounds of the training sample: documents of each label; characters of one, at a place drawn by its id, for the counts of
#: units that both labels are compared by; and distinct units of the whole of a longer toxic one (more are drawn by hash),
#: in which the machine looks for the unit that makes it toxic. A part seldom has that unit, and one of so many units is easily
#: mistaken, so longer toxic documents are learned from only where the sample has fewer than SHORT_ENOUGH others.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_UNITS, SHORT_ENOUGH = 1500, 6000, 20_000, 100
THRESHOLD = 0.3
CACHE_UNITS = 500_000

_SPACED = re.compile(r"(?<!\S)\S(?:[ .*_-]+\S(?![^\s.*_-])){3,}")
_STRIP = ".,;:!?\"'()[]{}<>«»“”„…"
#: Signs that stand for letters.
LOOKALIKES = str.maketrans("013457@$!", "oieastasi")


def letters(text: str) -> np.ndarray:
    """Character classes between two marks of the ends: a to z, digits and signs by kind, other letters spread over the rest."""
    if len(text) < 3:  # too short for any triple of its own
        return np.empty(0, np.int32)
    codes = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    out = 28 + codes % (ALPHABET - 30)
    out[(codes >= 97) & (codes <= 122)] = codes[(codes >= 97) & (codes <= 122)] - 97
    out[codes < 97] = 26
    out[(codes >= 48) & (codes <= 57)] = 27
    out[0], out[-1] = ALPHABET - 2, ALPHABET - 1
    return out.astype(np.int32)


def normal(unit: str) -> str:
    """A unit without signs around or inside it, look-alike signs read as letters."""
    unit = unit.strip(_STRIP).translate(LOOKALIKES)
    return unit if unit.isalnum() else "".join(c for c in unit if c.isalnum())


def units(text: str | None) -> set[str]:
    """Words of a text in lower case, and runs of single letters joined."""
    if not text:
        return set()
    low = text.lower()
    found = set(low.split())
    if any(len(w) == 1 for w in found) or any(c in low for c in "*_-."):
        found.update("".join(c for c in run if c.isalnum()) for run in _SPACED.findall(low))
    return found


def cut(text: str) -> list[str]:
    if len(text) <= PIECE:
        return [text]
    return [text[k : k + PIECE] for k in range(0, len(text) - PIECE // 2, PIECE // 2)]


_PICKS: dict[int, tuple] = {}


def picks(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, weights) of the triples of a string of n characters."""
    if n not in _PICKS:
        at = np.array(list(itertools.combinations(range(n), 3)), np.int64).reshape(-1, 3)
        _PICKS[n] = at, (DECAY ** (at[:, 2] - at[:, 0] + 1)).astype(np.float64)
    return _PICKS[n]


def features(strings: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(triple codes, values) of each string's normalised feature vector; strings under three characters have none."""
    out = []
    for s in strings:
        x = letters(s)
        at, weight = picks(len(x))
        if not len(at):
            out.append((np.empty(0, np.int64), np.empty(0)))
            continue
        code = (x[at[:, 0]] * ALPHABET + x[at[:, 1]]) * ALPHABET + x[at[:, 2]]
        codes, place = np.unique(code, return_inverse=True)
        values = np.bincount(place, weight)
        out.append((codes, values / np.sqrt((values**2).sum())))
    return out


def squared_norms(x: np.ndarray) -> np.ndarray:
    """The kernel of each row's string with itself, by the kernel's recursion over both prefixes."""
    rows, n = x.shape
    equal = (x[:, :, None] == x[:, None, :]).astype(np.float64) * DECAY**2
    inner = np.ones((rows, n, n))  # for prefixes that end before i and j
    for _ in range(2):
        grown = equal * inner
        for j in range(1, n):
            grown[:, :, j] += DECAY * grown[:, :, j - 1]
        for i in range(1, n):
            grown[:, i] += DECAY * grown[:, i - 1]
        inner = np.zeros((rows, n, n))
        inner[:, 1:, 1:] = grown[:, :-1, :-1]
    return (equal * inner).sum(axis=(1, 2))


class Scorer:
    """One weight a triple, an intercept, and the logistic curve."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset
        self.known: dict[str, float] = {}

    def raw(self, strings: list[str]) -> np.ndarray:
        """Machine output of strings of at most PIECE characters, in groups of one length."""
        out = np.full(len(strings), self.bias)
        codes = [letters(s) for s in strings]
        sizes = np.array([len(c) for c in codes], np.int64)
        for n in np.unique(sizes[sizes >= 3]):
            group = np.flatnonzero(sizes == n)
            at, weight = picks(int(n))
            for start in range(0, len(group), max(1, 400_000 // len(at))):
                rows = group[start : start + max(1, 400_000 // len(at))]
                x = np.stack([codes[k] for k in rows])
                code = (x[:, at[:, 0]] * np.int32(ALPHABET) + x[:, at[:, 1]]) * np.int32(ALPHABET) + x[:, at[:, 2]]
                dot = (self.weights[code] * weight).sum(axis=1)
                out[rows] += dot / np.sqrt(squared_norms(x))
        return out

    def _learn(self, found: set[str]) -> dict[str, float]:
        new, rest = [u for u in found if u not in self.known], {}
        parts = [cut(normal(u)) for u in new]
        flat = self.raw([p for own in parts for p in own])
        at = 0
        for u, own in zip(new, parts):
            (self.known if len(self.known) < CACHE_UNITS else rest)[u] = float(flat[at : at + len(own)].max())
            at += len(own)
        return rest

    def scores(self, texts: list[str | None]) -> np.ndarray:
        found = [units(t) for t in texts]
        rest = self._learn(set().union(*found) if found else set())
        of = (lambda u: self.known[u] if u in self.known else rest[u]) if rest else self.known.__getitem__
        best = np.array([max(map(of, f)) if f else -np.inf for f in found])
        return self.probability(best)

    def probability(self, best: np.ndarray) -> np.ndarray:
        # Beyond six units on either side the curve is flat for every use; no unit at all is the far end.
        return 1 / (1 + np.exp(-np.clip(self.slope * np.clip(best, -6, 6) + self.offset, -30, 30)))


def constant(rate: float) -> Scorer:
    rate = min(max(rate, 0.0), 1.0)
    offset = np.clip(np.log(max(rate, 1e-9) / max(1 - rate, 1e-9)), -30, 30)
    return Scorer(np.zeros(ALPHABET**3, np.float32), 0.0, 0.0, float(offset))


class Landmarks:
    """Landmark strings and the whitening map of their kernel matrix."""

    def __init__(self, strings: list[str]):
        each = features(strings)
        self.codes = np.unique(np.concatenate([c for c, _ in each]))
        self.place = np.full(ALPHABET**3, -1, np.int64)
        self.place[self.codes] = np.arange(len(self.codes))
        self.marks = np.zeros((len(self.codes), len(strings)), np.float32)
        for k, (code, value) in enumerate(each):
            self.marks[self.place[code], k] = value
        values, vectors = np.linalg.eigh((self.marks.T @ self.marks).astype(np.float64))
        keep = values > 1e-6 * values.max()
        self.root = vectors[:, keep] * values[keep] ** -0.5

    def mapped(self, strings: list[str]) -> np.ndarray:
        """Nystrom features of units: their kernel with the landmarks, whitened."""
        kernel = np.zeros((len(strings), self.marks.shape[1]), np.float32)
        for k, (code, value) in enumerate(features(strings)):
            at = self.place[code]
            some = at >= 0
            kernel[k] = value[some].astype(np.float32) @ self.marks[at[some]]
        return kernel @ self.root

    def folded(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(ALPHABET**3, np.float32)
        out[self.codes] = self.marks @ (self.root @ weights)
        return out


def bag_of(text: str | None) -> list[str]:
    """The different units of a text that have a triple, cut into pieces."""
    return sorted({p for u in units(text) for p in cut(normal(u)) if len(p) >= 3})


def train(bags: list[list[str]], labels: list[int], rate: float | None = None, wholes: dict[int, list[str]] | None = None, seed: int = 5) -> Scorer:
    """Fit landmarks, map, machine and curve to bags of units; rate is the share of toxic documents where the scorer is used.

    wholes has, for the places of bags that are of a part of a toxic document, the bags of the whole.
    """
    wholes = wholes or {}
    labels = np.array(labels)
    if not len(labels) or not labels.any() or labels.all():
        return constant(float(labels.mean()) if len(labels) else 0.0)
    rate = float(labels.mean()) if rate is None else rate
    rng = np.random.default_rng(seed)
    kept_back = rng.random(len(bags)) < 0.2  # for the curve alone
    if labels[kept_back].sum() < KEPT_BACK or labels[kept_back].all() or not labels[~kept_back].any() or labels[~kept_back].all():
        kept_back[:] = False
    used = [(own, y) for own, y, back in zip(bags, labels, kept_back) if not back]
    long_bags = [own for k, own in wholes.items() if own and labels[k] and not kept_back[k]]
    seen: dict[str, list[int]] = {}
    for own, y in used:
        for u in own:
            seen.setdefault(u, [0, 0])[int(y)] += 1
    n_bad, n_good = sum(y for _, y in used), sum(1 - y for _, y in used)
    # Common words that toxic documents have somewhat more often, and clean words of a document without any insult (labels err), are no insults.
    possible = {u for u, (g, b) in seen.items() if b * n_good > LIKELIER * g * n_bad}
    odds = {u: evidence(b, g, n_bad / (n_bad + n_good)) if u in possible else 0.0 for u, (g, b) in seen.items()}
    suspicious = sorted(seen, key=lambda u: (-odds[u], u))
    clean = sorted(u for u, (g, b) in seen.items() if g)
    common = sorted(clean, key=lambda u: (-seen[u][0], u))
    drawn = [clean[k] for k in rng.choice(len(clean), min(len(clean), LANDMARKS // 8), replace=False)]
    marks = Landmarks(sorted({*suspicious[: LANDMARKS // 2], *common[: LANDMARKS // 8], *drawn}) or ["aaa"])

    # Bags of toxic documents; a part of one need not have the toxic unit, so it serves for the first guess alone.
    bad_bags = [own for k, own in enumerate(bags) if labels[k] and own and not kept_back[k] and k not in wholes]
    parts = [own for k, own in enumerate(bags) if labels[k] and own and not kept_back[k] and k in wholes]
    # The first guess at toxic units: the one of each toxic document that toxic documents have beyond chance.
    tops = {max(own, key=lambda u: (odds[u], u)) for own in bad_bags or parts}
    positives = {u for own in bad_bags + parts for u in [max(own, key=lambda u: (odds[u], u))] if odds[u] > EVIDENCE} or tops
    negatives = {*common[:2000], *(clean[k] for k in rng.choice(len(clean), min(len(clean), 4000), replace=False))}
    scorer = constant(rate)
    for turn in range(TURNS):
        good, bad = sorted(negatives - positives), sorted(positives)
        if not good or not bad:
            break
        x = marks.mapped(bad + good)
        often = np.r_[np.ones(len(bad)), [1 + seen.get(u, (0, 0))[0] for u in good]]  # a clean unit counts by its documents
        weights, bias = machine(x, np.r_[np.ones(len(bad)), -np.ones(len(good))], np.sqrt(often))
        scorer = Scorer(marks.folded(weights), bias, 1.0, 0.0)
        if turn == TURNS - 1:
            break
        # The clean units that look most toxic are the next turn's negatives; some become landmarks.
        every = sorted(seen.keys() | set().union(*long_bags))
        value = dict(zip(every, scorer.raw(every).tolist()))
        hard = sorted(clean, key=lambda u: (-value[u], u))[:2500]
        negatives.update(hard)
        if turn == 0:
            marks = Landmarks(sorted({*suspicious[: LANDMARKS // 2], *common[: LANDMARKS // 8], *hard[: LANDMARKS // 4], *drawn}))
        # A toxic document's most toxic unit, and others of its that look toxic and have evidence of their own.
        tops = {max(some, key=lambda u: (value[u], u)) for own in bad_bags if (some := possible.intersection(own))}
        positives = {u for u in tops if value[u] > DOUBT or odds[u] > EVIDENCE}
        # A long document has so many units that its highest counts only if it looks toxic without doubt, and other documents agree.
        positives |= {u for u in (max(own, key=lambda u: (value[u], u)) for own in long_bags) if value[u] > FURTHER and odds.get(u, 0) > 0.9 * EVIDENCE}
        positives |= {u for own in bad_bags + parts for u in own if value[u] > FURTHER and odds[u] > 0.9 * EVIDENCE}
    own = [(wholes.get(k, bag), y) for k, (bag, y, back) in enumerate(zip(bags, labels, kept_back)) if back or not kept_back.any()]
    every = sorted(set().union(*(bag for bag, _ in own)))
    value = dict(zip(every, scorer.raw(every).tolist()))
    best = np.array([max(map(value.__getitem__, bag)) if bag else scorer.bias for bag, _ in own])
    scorer.slope, scorer.offset = curve(best, np.array([y for _, y in own]), rate)
    return scorer


def evidence(bad: int, good: int, rate: float) -> float:
    """Signed log-likelihood ratio of a unit's split over toxic and clean bags against the bags' own rate."""
    n = bad + good
    share = bad / n
    gain = sum(k * np.log(k / n / r) for k, r in ((bad, rate), (good, 1 - rate)) if k)
    return float(gain if share > rate else -gain)


def machine(x: np.ndarray, y: np.ndarray, often: np.ndarray, penalty: float = 3e-6) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, weighted examples, by Newton steps in the primal."""
    share = np.where(y > 0, 0.25 * often / often[y > 0].sum(), 0.75 * often / often[y < 0].sum())
    x1 = np.c_[x, np.ones(len(x))]
    w = np.zeros(x1.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-8
    for _ in range(30):
        active = y * (x1 @ w) < 1
        a = x1[active] * share[active, None]
        new = np.linalg.solve(x1[active].T @ a + np.diag(ridge), a.T @ y[active])
        done = np.abs(new - w).max() < 1e-8
        w = new if done else w + 0.9 * (new - w)
        if done:
            break
    return w[:-1], float(w[-1])


def curve(best: np.ndarray, labels: np.ndarray, rate: float) -> tuple[float, float]:
    """Slope and offset of the logistic curve with the least log loss at the given rate of toxic documents; by Newton steps."""
    slope, offset = 1.0, 0.0
    x, n = np.clip(best, -6, 6), max(1, int(labels.sum()))
    target = np.where(labels == 1, 1 - 1 / (n + 2), 1 / (len(labels) - n + 2))
    share = np.where(labels == 1, rate / n, (1 - rate) / max(1, len(labels) - n))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        g, h = share * (p - target), share * p * (1 - p) + 1e-9
        a, b, c = (h * x * x).sum() + 1e-4, (h * x).sum(), h.sum() + 1e-6
        d = a * c - b * b
        move = np.clip([(c * (g * x).sum() - b * g.sum()) / d, (a * g.sum() - b * (g * x).sum()) / d], -1, 1)
        slope, offset = slope - move[0], offset - move[1]
    return float(max(slope, 0.1)), float(offset)


def fitted(docs: DataFrame, labels: DataFrame) -> Scorer:
    """Train on labelled rows that are not held out; the sample is bounded for each label, by a hash of the id."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not sizes:
        return constant(0.0)
    cut_at = F.lit(None).cast("bigint")
    for y, n in sizes.items():
        cut_at = F.when(F.col("toxic") == y, F.lit(int(min(1.0, SAMPLE_DOCS / n) * (1 << 30)))).otherwise(cut_at)
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < cut_at).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy("doc_id").limit(4 * SAMPLE_DOCS)
    rows = {r.doc_id: r.toxic for r in sample.collect()}  # bounded by the sample
    # The sample's ids are a bounded list; the documents are read once, and only bags reach the driver.
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.col("doc_id").isin(list(rows)) & (F.length("text") > 0))
    start = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1))) + 1
    is_long = (F.length("text") > SAMPLE_CHARS) & F.col("doc_id").isin([d for d, y in rows.items() if y])
    schema = pa.schema([("doc_id", pa.int64()), ("bag", pa.list_(pa.string())), ("whole", pa.list_(pa.string()))])

    def run(batches):
        for batch in small(batches, 64):
            ids, parts, texts = (batch.column(k).to_pylist() for k in range(3))
            wholes = [None if t is None else sorted(sorted(bag_of(t), key=lambda u: (zlib.crc32(u.encode("utf-8", "surrogatepass")), u))[:SAMPLE_UNITS]) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(map(bag_of, parts)), schema.field(1).type), pa.array(wholes, schema.field(2).type)], schema=schema)

    texts = chosen.select("doc_id", F.col("text").substr(start.cast("int"), F.lit(SAMPLE_CHARS)).alias("part"), F.when(is_long, F.col("text")).alias("text"))
    got = sorted(((r.doc_id, r.bag, r.whole) for r in texts.mapInArrow(run, "doc_id bigint, bag array<string>, whole array<string>").limit(8 * SAMPLE_DOCS).collect()), key=lambda r: r[:2])
    if sum(rows[d] == 1 and w is None for d, _, w in got) >= SHORT_ENOUGH:
        got = [r for r in got if r[2] is None]
    wholes = {k: w for k, (_, _, w) in enumerate(got) if w is not None}
    return train([b for _, b, _ in got], [rows[d] for d, _, _ in got], sizes.get(1, 0) / sum(sizes.values()), wholes)


def scored(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(scorer)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        model = shipped.value
        for batch in small(batches):
            texts = batch.column(2).to_pylist()
            parts = [model.scores(texts[a:b]) for a, b in pieces_of(texts)]
            score = np.concatenate(parts) if parts else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], schema=schema)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
