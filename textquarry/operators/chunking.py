"""Cutting pages into passages that keep their exact place.

Segments are lossless pieces of a page: each separator level cuts only what is still too long. Packing
fills passages up to a size with some carried overlap; passages below a floor are merged with a neighbour.
A passage is always page[start : start + length], so highlights and citations can be found again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

SIZE, OVERLAP, LEAST = 1000, 200, 100
#: Bytes of pages that a worker turns into passages at once.
HELD = 1 << 20
#: Where a page may be cut, best first; each pattern matches just before what opens the next piece.
PROSE = (r"(?=\n\n)", r"(?=\n)", r"(?<=\. )", r"(?= )")
MARKDOWN = (r"(?=\n#{1,6} )", r"(?=\n```)", *PROSE)


def segments_of(text: Column, size: int = SIZE, separators: tuple = PROSE) -> Column:
    """CHK1, CHK2: pieces of at most size characters that concatenate to the text."""
    pieces = F.array(F.coalesce(text, F.lit("")))
    for pattern in separators:
        pieces = _recut(pieces, size, lambda p, pattern=pattern: F.split(p, pattern))
    hard = _recut(pieces, size, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / size)), lambda k: p.substr((k * size + 1).cast("int"), F.lit(size))))
    return F.filter(hard, lambda p: F.length(p) > 0)


def _recut(pieces: Column, size: int, cut) -> Column:
    return F.flatten(F.transform(pieces, lambda p: F.when(F.length(p) > size, cut(p)).otherwise(F.array(p))))


def segments(pages: DataFrame, key: list[str], size: int = SIZE, separators: tuple = PROSE) -> DataFrame:
    """key, pos, start and text of every segment."""
    rows = pages.select(*key, F.posexplode(segments_of(F.col("text"), size, separators)).alias("pos", "text"))
    before = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(*key, "pos", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).alias("start"), "text")


def pack_ranges(lengths: list[int], heads: list[bool], size: int, overlap: int, least: int) -> list[tuple[int, int]]:
    """CHK3, CHK4: begin and end of the passages of one page from its segments' lengths; heads mark section openings."""
    starts, at = [], 0
    for n in lengths:
        starts.append(at)
        at += n
    ranges, own, held = [], [], 0
    for k, n in enumerate(lengths):
        if own and held + n > size:
            ranges.append((own[0], own[-1]))
            while own and (held > overlap or held + n > size):
                held -= lengths[own.pop(0)]
        own.append(k)
        held += n
    if own:
        ranges.append((own[0], own[-1]))
    spans = [(starts[a], starts[b] + lengths[b], heads[a]) for a, b in ranges]
    floor = min(least, size // 4)
    out: list[tuple[int, int, bool]] = []
    pending: tuple[int, int, bool] | None = None
    for k, span in enumerate(spans):
        if pending is not None:
            span, pending = (pending[0], span[1], pending[2]), None
        last = k + 1 == len(spans)
        if span[1] - span[0] >= floor or len(spans) == 1:
            out.append(span)
            continue
        forward = not last and spans[k + 1][1] - span[0] <= size + floor
        backward = bool(out) and span[1] - out[-1][0] <= size + floor
        if forward and (not out or span[2] or not backward):
            pending = span
        elif backward:
            out[-1] = (out[-1][0], span[1], out[-1][2])
        else:
            out.append(span)
    return [(a, b) for a, b, _ in out]


def passages(pages: DataFrame, key: list[str], size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST, separators: tuple = PROSE) -> DataFrame:
    """key, chunk_no, start and content of every passage; a page never shares a passage with another.

    Pages are cut once; a worker takes up HELD characters of pages at a time from what it is sent, and gives them back before the next.
    """
    cut = pages.select(*key, "text", segments_of(F.col("text"), size, separators).alias("_pieces"))
    rows = cut.select(*key, "text", F.transform("_pieces", F.length).alias("lengths"), F.transform("_pieces", lambda p: F.regexp_replace(p, r"^\s+", "").startswith("#")).alias("heads"))
    schema = T.StructType([*(pages.schema[k] for k in key), T.StructField("chunk_no", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("content", T.StringType())])

    def run(batches):
        for batch in (own for batch in batches for own in _slices(batch, len(key))):
            at, number, start, content = [], [], [], []
            text, lengths, heads = (batch.column(len(key) + k).to_pylist() for k in range(3))
            for row in range(batch.num_rows):
                for k, (a, b) in enumerate(pack_ranges(lengths[row], heads[row], size, overlap, least)):
                    at.append(row)
                    number.append(k)
                    start.append(a)
                    content.append(text[row][a:b])
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in range(len(key))), pa.array(number, pa.int32()), pa.array(start, pa.int32()), pa.array(content, pa.string())],
                                             names=[*key, "chunk_no", "start", "content"])

    return rows.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """A batch's rows in turn, with HELD bytes of a text column, or one row, at a time."""
    offsets = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(offsets, (offsets[begin - 1] if begin else 0) + HELD, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def broken_passages(chunks: DataFrame, pages: DataFrame, key: list[str], size: int = SIZE, least: int = LEAST) -> DataFrame:
    """CHK9: passages that are not their page's text at their place, or exceed the ceiling."""
    both = chunks.join(pages.select(*key, "text"), key)
    same = F.col("text").substr(F.col("start") + 1, F.length("content")) == F.col("content")
    return both.where(~same | (F.length("content") > size + min(least, size // 4))).drop("text")


def identity(cells: Column, most_cell: int = 80, most: int = 300) -> Column:
    """CHK5: whole 'column: value' lines of a row's short cells, up to a length; the first that does not fit ends it."""
    lines = F.transform(F.filter(cells, lambda c: F.length(c["value"]) <= most_cell), lambda c: F.concat(c["column"], F.lit(": "), c["value"]))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"), F.lit(False).alias("full"))

    def add(s, line):
        fits = ~s["full"] & (s["used"] + F.length(line) + 1 <= most)
        return F.struct(F.when(fits, F.array_append(s["kept"], line)).otherwise(s["kept"]).alias("kept"), F.when(fits, s["used"] + F.length(line) + 1).otherwise(s["used"]).alias("used"), (~fits).alias("full"))

    return F.aggregate(lines, start, add, lambda s: F.array_join(s["kept"], "\n"))


def continued(content: Column, start: Column, sheet: Column, row: Column, own: Column, limit: int = SIZE // 4) -> Column:
    """CHK5: later pieces of a long row are headed by the row's number and identity."""
    where = F.concat(F.when(F.coalesce(sheet, F.lit("")) != "", F.concat(sheet, F.lit(" · "))).otherwise(F.lit("")), F.lit("row "), row.cast("string"), F.lit(" (continued)"))
    prefix = F.when(own != "", F.concat(where, F.lit("\n"), own)).otherwise(where)
    short = F.when(F.length(prefix) > limit, F.rtrim(prefix.substr(F.lit(1), F.greatest(F.lit(limit), F.length(where))))).otherwise(prefix)
    return F.when(start > 0, F.concat(short, F.lit("\n"), content)).otherwise(content)


def ordered_chunks(texts: DataFrame, images: DataFrame) -> DataFrame:
    """CHK6: one order an asset: text passages by page and place, then pictures."""
    both = texts.withColumn("is_image", F.lit(False)).unionByName(images.withColumn("is_image", F.lit(True)))
    order = F.row_number().over(Window.partitionBy("asset_id").orderBy("is_image", "page", "start")) - 1
    return both.withColumn("chunk_order", order)


def image_content(caption: Column, label: Column) -> Column:
    """CHK7: a picture's caption, or a place-holder that names its page."""
    return F.coalesce(F.nullif(F.trim(caption), F.lit("")), F.concat(F.lit("[image, page "), label, F.lit("]")))


def assembled(batches: DataFrame) -> DataFrame:
    """CHK8: pages of all batches with the corrected text where there is one, and the asset's number of pages."""
    total = F.count(F.lit(1)).over(Window.partitionBy("asset_id"))
    return batches.select("asset_id", "page", F.coalesce(F.nullif("corrected_text", F.lit("")), "text").alias("text"), total.alias("total_pages"))


def grouped_pages(pairs: DataFrame, least: int) -> DataFrame:
    """CHK10: runs of pages of a document, each of at least so many characters but for the last; pages blank on either side are skipped."""
    full = pairs.where((F.trim("damaged") != "") & (F.trim("corrected") != ""))
    pages = full.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "damaged", "corrected"))).alias("pages"))
    start = F.struct(F.lit(0).alias("group"), F.lit(0).alias("held"), F.array().cast("array<int>").alias("groups"))

    def step(s, p):
        held = s["held"] + F.length(p["damaged"])
        done = held >= least
        return F.struct((s["group"] + done.cast("int")).alias("group"), F.when(done, 0).otherwise(held).alias("held"), F.array_append(s["groups"], s["group"]).alias("groups"))

    numbered = pages.withColumn("groups", F.aggregate("pages", start, step, lambda s: s["groups"]))
    rows = numbered.select("doc_id", F.explode(F.arrays_zip(F.col("pages").alias("p"), F.col("groups").alias("g"))).alias("z"))
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("z.p.page", f"z.p.{c}"))), lambda x: x[c]), "\n")
    return rows.groupBy("doc_id", F.col("z.g").alias("group")).agg(F.count("*").alias("pages"), ordered("damaged").alias("damaged"), ordered("corrected").alias("corrected"))
