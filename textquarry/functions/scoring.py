"""Distances, similarities and small arithmetic, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textquarry.functions.text import squeezed


def error_rate(reference: Column, read: Column) -> Column:
    """MTH2: edits a reference character; an empty reference is 0 if nothing was read, else 1."""
    a, b = squeezed(reference), squeezed(read)
    return F.when(F.length(a) == 0, F.when(F.length(b) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(a, b) / F.length(a))


def word_error_rate(reference: Column, read: Column) -> Column:
    """MTH3: the same over words; each distinct word of the pair becomes one private character."""
    a, b = F.split(squeezed(reference), " "), F.split(squeezed(read), " ")
    alphabet = F.array_distinct(F.concat(a, b))
    # Code points past the surrogates, two bytes an odd unit at a time: U+E000 on.
    coded = lambda words: F.array_join(F.transform(words, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(alphabet, w) + 0xE000), 4, "0")), "UTF-16BE")), "")
    empty_a, empty_b = squeezed(reference) == "", squeezed(read) == ""
    return F.when(empty_a, F.when(empty_b, 0.0).otherwise(1.0)).when(empty_b, 1.0).otherwise(F.levenshtein(coded(a), coded(b)) / F.size(a))


def agreement(a: Column, b: Column) -> Column:
    """MTH4: 1 less the edits a character of the longer text; 1 for two empty ones."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def word_overlap(a: Column, b: Column) -> Column:
    """MTH5: the share of a's distinct words that b has."""
    words = lambda x: F.array_distinct(F.filter(F.split(F.lower(squeezed(x)), " "), lambda w: w != ""))
    own = words(a)
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_intersect(own, words(b))) / F.size(own))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """MTH6: cosine, dot product or negative Euclidean distance; higher is nearer; a zero vector has no cosine."""
    if metric == "dot":
        return dot(a, b)
    if metric == "euclid":
        return 0 - F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def sigmoid(x: Column) -> Column:
    """MTH7: without overflow on either side."""
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def progress(done: Column, total: Column) -> Column:
    """MTH8: percent, null without a total; halves go to the even number."""
    return F.when(total > 0, F.bround(100 * done / total))


def token_cost(tokens: Column, price: Column) -> Column:
    """MTH9: price of a million tokens by tokens; null where the price is unknown."""
    return tokens * price / F.lit(1_000_000.0)


def nearness(rects: Column, box: Column, most: float = 250.0, side: float = 20.0) -> Column:
    """MTH10: 1 for a rectangle that touches the box's rows down to 0 at the greatest gap; other columns don't count."""
    x0, y0, x1, y1 = (box[k] for k in range(4))
    gaps = F.transform(F.filter(rects, lambda r: (r[2] >= x0 - side) & (r[0] <= x1 + side)),
                       lambda r: F.when(r[1] >= y1, r[1] - y1).when(r[3] <= y0, y0 - r[3]).otherwise(F.lit(0.0)))
    best = F.array_min(gaps)
    return F.when(best <= most, 1 - best / most).otherwise(F.lit(0.0))
