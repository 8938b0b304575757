"""Language identification with a byte convolutional network.

Text is read as UTF-8 bytes in windows of fixed length. Bytes are embedded, filters of several widths
run over each window, each filter's largest response is pooled, and a softmax layer gives language
probabilities; a document's are the mean of its windows', weighted by their bytes. The network is
trained in numpy on a bounded sample of labelled text (SAMPLE_DOCS documents a language, SAMPLE_CHARS
characters at a random place of each). For prediction embedding and filters are folded into one table
per filter offset, so a window costs a few table look-ups a byte. Every byte of every text is used.

Defined cases: a null text, or one without any letter, is 'und' with score 0; with no labelled row at
all every text is 'und'; null languages are not learned from; rows with a null id are never held out; repeated rows
are predicted row by row, long texts whole; an empty table gives no rows; extra columns are ignored, whatever their names.
As a bound of the fit, the MOST_LANGUAGES most frequent languages are learned; texts of others get the nearest of those.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.shared import held_out, small

UNKNOWN = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 16
#: Bounds of the training sample.
SAMPLE_DOCS, SAMPLE_CHARS = 250, 1200
#: Most languages that are learned: the most frequent ones.
MOST_LANGUAGES = 500
STEPS, BATCH = 900, 64
#: Below this mean probability a document counts as rejected in without_unknown().
LEAST_SCORE = 0.4

_LETTER = re.compile(r"[^\W\d_]")


def _classes() -> np.ndarray:
    """Byte classes: folded ASCII letters, digits, blanks, other ASCII, and each byte beyond ASCII; 0 is padding."""
    out = np.full(256, 30, np.uint8)
    for k in range(26):
        out[65 + k] = out[97 + k] = 1 + k
    out[48:58] = 27
    out[[9, 10, 13, 32]] = 28
    out[[39, 44, 45, 46]] = 29
    out[128:] = 31 + np.arange(128)
    return out


CLASSES = _classes()
N_CLASSES = int(CLASSES.max()) + 1


class Net:
    """The trained network, folded for prediction."""

    def __init__(self, labels: list[str], tables: np.ndarray, bias: np.ndarray, dense: np.ndarray, dense_bias: np.ndarray):
        self.labels, self.tables, self.bias, self.dense, self.dense_bias = labels, tables, bias, dense, dense_bias

    def windows(self, codes: np.ndarray) -> np.ndarray:
        """Class probabilities of windows, an array of windows x WINDOW codes."""
        out = np.empty((len(codes), len(self.labels)), np.float32)
        reach = len(self.tables)
        padded = np.zeros((16, WINDOW + reach - 1), np.uint8)
        for at in range(0, len(codes), 16):
            part = codes[at : at + 16]
            n = len(part)
            padded[:n, :WINDOW] = part
            seen = np.take(self.tables[0], padded[:n, :WINDOW], axis=0, mode="clip")
            for k in range(1, reach):
                seen += np.take(self.tables[k], padded[:n, k : k + WINDOW], axis=0, mode="clip")
            pooled = np.maximum(seen.max(axis=1) + self.bias, 0)
            out[at : at + n] = softmax(pooled @ self.dense + self.dense_bias)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for start in range(0, len(texts), 512):
            part = texts[start : start + 512]
            real = [k for k, t in enumerate(part) if t and self.labels and _LETTER.search(t)]
            sums = np.zeros((len(part), max(1, len(self.labels))))
            weights = np.zeros(len(part))
            for k_at, probabilities, sizes in self._batches(part, real):
                np.add.at(sums, k_at, probabilities * sizes[:, None])
                np.add.at(weights, k_at, sizes)
            known = set(real)
            for k in range(len(part)):
                if k in known:
                    best = int(sums[k].argmax())
                    names.append(self.labels[best])
                    scores.append(float(min(1.0, sums[k, best] / weights[k])))
                else:
                    names.append(UNKNOWN)
                    scores.append(0.0)
        return names, scores

    def _batches(self, part: list, real: list[int]):
        """(document, probabilities, bytes) of windows, a bounded number of windows at a time."""
        rows, own, sizes = [], [], []
        for k in real:
            data = part[k].encode("utf-8", "surrogatepass")
            for at in range(0, len(data), WINDOW << 10):
                codes = CLASSES[np.frombuffer(data, np.uint8, min(WINDOW << 10, len(data) - at), at)]
                n = -(-len(codes) // WINDOW)
                filled = np.zeros(n * WINDOW, np.uint8)
                filled[: len(codes)] = codes
                rows.append(filled.reshape(n, WINDOW))
                own.append(np.full(n, k))
                size = np.full(n, float(WINDOW))
                size[-1] = len(codes) - (n - 1) * WINDOW
                sizes.append(size)
                if sum(map(len, rows)) > 4096:
                    yield np.concatenate(own), self.windows(np.concatenate(rows)), np.concatenate(sizes)
                    rows, own, sizes = [], [], []
        if rows:
            yield np.concatenate(own), self.windows(np.concatenate(rows)), np.concatenate(sizes)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], langs: list[str], seed: int = 7) -> Net:
    """Fit the network by Adam on random crops of the texts; classes are drawn equally often."""
    labels = sorted(set(langs))
    rng = np.random.default_rng(seed)
    data = [CLASSES[np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)] for t in texts]
    by = [[k for k, x in enumerate(langs) if x == label and len(data[k])] for label in labels]
    labels, by = [x for x, own in zip(labels, by) if own], [own for own in by if own]
    n = len(labels)
    if not n:
        return Net([], np.zeros((max(WIDTHS), N_CLASSES, FILTERS * len(WIDTHS)), np.float32), np.zeros(FILTERS * len(WIDTHS), np.float32), np.zeros((FILTERS * len(WIDTHS), 1), np.float32), np.zeros(1, np.float32))
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    weights = {"e": draw(N_CLASSES, EMBEDDING, scale=0.3), "d": draw(FILTERS * len(WIDTHS), n, scale=0.15), "db": np.zeros(n, np.float32)}
    for w in WIDTHS:
        weights[f"w{w}"], weights[f"b{w}"] = draw(w * EMBEDDING, FILTERS, scale=(w * EMBEDDING) ** -0.5), np.zeros(FILTERS, np.float32)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items()}
    for step in range(1, STEPS + 1):
        y = rng.integers(0, n, BATCH)
        codes = np.zeros((BATCH, WINDOW), np.uint8)
        for r, label in enumerate(y):
            x = data[by[label][rng.integers(len(by[label]))]]
            size = WINDOW if rng.random() < 0.6 else int(rng.integers(12, WINDOW))
            at = int(rng.integers(0, max(1, len(x) - size + 1)))
            crop = x[at : at + size]
            codes[r, : len(crop)] = crop
        grads = _gradients(weights, codes, y)
        rate = 0.006 * (1 - step / (STEPS + 1))
        for k, g in grads.items():
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            weights[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    reach = max(WIDTHS)
    tables = np.zeros((reach, N_CLASSES, FILTERS * len(WIDTHS)), np.float32)
    for i, w in enumerate(WIDTHS):
        for k in range(w):
            tables[k, :, i * FILTERS : (i + 1) * FILTERS] = weights["e"] @ weights[f"w{w}"][k * EMBEDDING : (k + 1) * EMBEDDING]
    return Net(labels, tables, np.concatenate([weights[f"b{w}"] for w in WIDTHS]), weights["d"], weights["db"])


def _gradients(weights: dict, codes: np.ndarray, y: np.ndarray) -> dict:
    """Cross-entropy gradients; through max pooling only each filter's best position counts."""
    batch = len(codes)
    padded = np.zeros((batch, WINDOW + max(WIDTHS) - 1), np.uint8)
    padded[:, :WINDOW] = codes
    x = weights["e"][padded]
    pooled, kept = [], []
    for w in WIDTHS:
        patches = np.lib.stride_tricks.sliding_window_view(x, (w, EMBEDDING), axis=(1, 2))[:, :WINDOW, 0].reshape(batch, WINDOW, w * EMBEDDING)
        seen = patches @ weights[f"w{w}"]
        best = seen.argmax(axis=1)
        value = np.take_along_axis(seen, best[:, None], 1)[:, 0] + weights[f"b{w}"]
        pooled.append(np.maximum(value, 0))
        kept.append((w, best, patches[np.arange(batch)[:, None], best], value > 0))
    h = np.concatenate(pooled, axis=1)
    p = softmax(h @ weights["d"] + weights["db"])
    p[np.arange(batch), y] -= 1
    p /= batch
    grads = {"d": h.T @ p, "db": p.sum(axis=0), "e": np.zeros_like(weights["e"])}
    back = p @ weights["d"].T
    for i, (w, best, patches, alive) in enumerate(kept):
        g = back[:, i * FILTERS : (i + 1) * FILTERS] * alive
        grads[f"w{w}"], grads[f"b{w}"] = np.einsum("bf,bfp->pf", g, patches), g.sum(axis=0)
        to_patch = (g[:, :, None] * weights[f"w{w}"].T[None]).reshape(batch, FILTERS, w, EMBEDDING)
        for k in range(w):
            np.add.at(grads["e"], padded[np.arange(batch)[:, None], best + k], to_patch[:, :, k])
    return grads


def fitted(docs: DataFrame) -> Net:
    """Train on rows that are not held out and have a language; the sample's size is bounded by language."""
    usable = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    chosen = None
    for lang, n in counts:
        # The share is of a hash's range, so about SAMPLE_DOCS rows are read whatever the table's size.
        share = min(1.0, SAMPLE_DOCS / n)
        cut = (F.col("lang") == lang) & (F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) < int(share * (1 << 30)))
        chosen = cut if chosen is None else chosen | cut
    if chosen is None:
        return train([], [])
    start = F.pmod(F.xxhash64("doc_id", F.lit(10)), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1))) + 1
    rows = usable.where(chosen).select("lang", "doc_id", F.expr("text").substr(start.cast("int"), F.lit(SAMPLE_CHARS)).alias("piece")).orderBy("doc_id", "piece").limit(2 * SAMPLE_DOCS * len(counts)).collect()
    return train([r.piece for r in rows], [r.lang for r in rows])


def predictions(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(net)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        for batch in small(batches):
            names, scores = shipped.value.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def without_unknown(docs: DataFrame, net: Net) -> DataFrame:
    """docs, columns as they are, without texts of no language: 'und', or a mean probability below LEAST_SCORE."""
    shipped, at = docs.sparkSession.sparkContext.broadcast(net), docs.columns.index("text")

    def run(batches):
        for batch in small(batches):
            names, scores = shipped.value.predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array([n != UNKNOWN and s >= LEAST_SCORE for n, s in zip(names, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
