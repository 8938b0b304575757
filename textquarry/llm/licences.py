"""Licence scans: which licence notices stand in which documents, with DataFrame functions alone.

Every template is a notice's words. A document is read as word 5-gram shingles in overlapping windows of
twice a block; block sizes are powers of two, each for the templates of up to that many shingles, so a
notice lies whole in one window and window and notice have a bounded size ratio. Windows and templates
are min-hashed with MAPS maps and banded one value a band: at the least ratio a matching window has a
Jaccard similarity of 0.19 or more, so no band agrees with a probability below 0.81**32 = 0.0012, and at
an equal size below 1e-22. Matching bands retrieve (document, template) pairs, and exact containment of the
template's shingles in the whole document's (at least THRESHOLD) decides: damaged copies far apart count together.
A document whose parts of a notice are so scattered that no window has a fifth of it may still not be retrieved.

Two lossless steps keep the work small. Anchor words are chosen from the templates such that more than a fifth of
every template's shingles have one, so a document without any can't reach THRESHOLD. And a window without a single
anchor shares no more than that, so only blocks next to an anchor's place are min-hashed; their length is bounded by
the template, not by the document. All block sizes are taken from one scan.

The templates are a bounded list and are broadcast; any list will do. Defined cases: null and empty texts match nothing,
long ones are read whole; templates of fewer than five words are one shingle of all their words, as are such texts (so they match whole texts), those without words are
never found; every place of a repeated notice counts once a document; a null id is carried; repeated rows are scanned
separately; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.shared import stored

THRESHOLD = 0.8
N_WORDS = 5
MAPS = 32

#: Short licence notices by SPDX identifier, as they are commonly worded.
NOTICES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "Apache-2.0-text": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
_PRIME = (1 << 31) - 1


def word_list(text):
    """Lower-case runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(text), r"(?U)[^\w]+"), lambda w: w != "")


def shingle_list(words):
    """64-bit hashes of the word 5-grams, or of all words of a shorter list.

    The list is zipped with itself at five places, so the work stays linear even where the optimizer puts the whole
    expression of words in place of its column.
    """
    n = F.size(words)
    shifted = F.arrays_zip(*(F.slice(words, k, F.greatest(n - N_WORDS + 1, F.lit(0))).alias(f"w{k}") for k in range(1, N_WORDS + 1)))
    grams = F.transform(shifted, lambda z: F.xxhash64(F.concat_ws(" ", *(z[f"w{k}"] for k in range(1, N_WORDS + 1)))))
    return F.when(n >= N_WORDS, grams).when(n > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))


def maps(count: int = MAPS) -> list[tuple[int, int]]:
    """Multipliers and additions below 2**31 of a fixed linear sequence; products stay within 62 bits."""
    out, x = [], 20240606
    for _ in range(count):
        x = (x * 1103515245 + 12345) % (1 << 31)
        a = x % (_PRIME - 1) + 1
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append((a, x % _PRIME))
    return out


def folded(shingles):
    """Shingles as 31-bit numbers, which the maps take."""
    return F.transform(shingles, lambda s: F.pmod(s, F.lit(_PRIME)))


def signature(numbers):
    """One band a map: the least value of each map over an array of folded shingles."""
    def least(a: int, b: int):
        return F.array_min(F.transform(numbers, lambda s: (s * F.lit(a) + F.lit(b)) % F.lit(_PRIME)))

    return F.array(*(least(a, b) for a, b in maps()))


def templates(spark: SparkSession, notices: dict[str, str] | None = None) -> DataFrame:
    """licence, shingles (distinct), n, block and bands of each notice."""
    rows = spark.createDataFrame(sorted((notices or NOTICES).items()), "licence string, notice string")
    found = rows.select("licence", F.array_distinct(shingle_list(word_list("notice"))).alias("shingles"), word_list("notice").alias("words")).where(F.size("words") > 0)
    n = F.size("shingles")
    return found.select(
        "licence", "shingles", "words", n.alias("n"), F.pow(F.lit(2), F.ceil(F.log2(n.cast("double")))).cast("int").alias("block"), signature(folded(F.col("shingles"))).alias("bands"))


def anchors_of(lists: list[list[str]]) -> list[str]:
    """Words of which every list has one in more than 1 - THRESHOLD of its shingles: its longest, as they are the rarest, until it has."""
    found: set[str] = set()
    for words in lists:
        grams = [set(words[k : k + N_WORDS]) for k in range(max(1, len(words) - N_WORDS + 1))]
        rest = sorted(set(words) - found, key=lambda w: (len(w), w))
        while sum(not g.isdisjoint(found) for g in grams) <= (1 - THRESHOLD) * len(grams):
            found.add(rest.pop())
    return sorted(found)


def licences_in(docs: DataFrame, notices: dict[str, str] | None = None) -> DataFrame:
    """doc_id, licence, shared_shingles, template_shingles and containment of every notice a document has."""
    spark = docs.sparkSession
    known = templates(spark, notices)
    sizes = known.collect()  # the bounded list of notices
    bands = F.broadcast(known.select("licence", "block", F.posexplode("bands").alias("band", "value")))
    exact = F.broadcast(known.select("licence", "shingles", "n"))
    anchor_words = anchors_of([list(r.words) for r in sizes])
    anchors = F.array(*map(F.lit, anchor_words)).cast("array<string>")

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.lower("text").alias("text"))
    rows = rows.where(F.col("text").rlike("|".join(anchor_words) or "(?!)"))
    rows = rows.select("row", "doc_id", word_list("text").alias("words"))
    # Places of anchor words, then the shingles of the blocks about them; a long text gives one row a block.
    places = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(anchors, w), i)), lambda i: i.isNotNull())
    # Written once, for the windows and for the decision: only documents with an anchor, some of all.
    rows = stored(rows.withColumn("places", places).where(F.size("places") > 0), "anchored")

    def starts(block: int):
        """A window of 2 * block shingles starts at a multiple of block; those that a shingle with an anchor may lie in, with their words."""
        each = F.flatten(F.transform("places", lambda p: F.sequence(F.greatest(F.floor((p - (N_WORDS - 1)) / block) - 1, F.lit(0)), F.floor(p / block))))
        own = lambda at: F.slice("words", (at * block + 1).cast("int"), 2 * block + N_WORDS - 1)
        return F.transform(F.array_distinct(each), lambda at: F.struct(F.lit(block).alias("block"), own(at).alias("own")))

    blocks = sorted({r.block for r in sizes})
    windows = rows.select("row", F.inline(F.concat(*map(starts, blocks)) if blocks else F.expr("cast(array() as array<struct<block:int,own:array<string>>>)"))).where(F.size("own") > 0)
    # Each step is a column of its own, so that none is computed again for each of its uses.
    hashed = windows.select("row", "block", shingle_list(F.col("own")).alias("shingles")).select("row", "block", folded(F.col("shingles")).alias("numbers"))
    hashed = hashed.select("row", "block", F.posexplode(signature(F.col("numbers"))).alias("band", "value"))
    # The bands retrieve documents and templates; only then are a document's shingles made, once, and those of its templates fetched.
    met = hashed.join(bands, ["block", "band", "value"]).select("row", "licence").distinct()
    asked = met.groupBy("row").agg(F.collect_list("licence").alias("licences"))  # at most as many as there are notices
    whole = rows.select("row", "doc_id", "words").join(asked, "row").select("doc_id", "licences", shingle_list(F.col("words")).alias("own"))
    both = whole.select("doc_id", F.explode("licences").alias("licence"), F.array_distinct("own").alias("own")).join(exact, "licence")
    best = both.select("doc_id", "licence", "n", F.size(F.array_intersect("own", "shingles")).alias("shared_shingles")).where(F.col("shared_shingles") >= THRESHOLD * F.col("n"))
    return best.select("doc_id", "licence", F.col("shared_shingles").cast("int").alias("shared_shingles"), F.col("n").cast("int").alias("template_shingles"),
                       (F.col("shared_shingles") / F.col("n")).alias("containment"))
