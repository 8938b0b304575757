"""SRC2, SRC3: delimited files of any size as records, though quoted cells hold line breaks.

A file is read as lines, in the blocks that Spark splits it into. Whether a line begins inside a quoted cell depends on all
lines before it, but only through one bit; what a block does to that bit is found for both values at once, without knowing the
one before it. A file's blocks are then put in a row, which gives each its first bit and line number, and every block is parsed by
itself. A record that goes over a block's end is left in parts, which are joined afterwards; so no file is ever one task's work.

The delimiter of a file is that of its first line with text. A file that is not valid UTF-8 as a whole is Latin-1. A quote opens a
quoted cell at a cell's start only; there it is doubled for itself. Lines end with a line feed, or a carriage return and one.
Defined cases: records without text are left out; a quote that is never closed takes the rest of its file, but for its last line's end; an empty folder or
empty files give no rows.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.sources.tabular import delimiter_of

#: Characters of records that a batch holds.
HELD = 1 << 22
PARSED = "path string, delimiter string, line bigint, cells array<string>, block bigint, kind int, part string"
#: Of rows that are parsed: a record, the beginning of one that goes on in the next block, and what goes on from the last block.
RECORD, OPEN, REST = 0, 1, 2


def closing(line: str, at: int) -> int:
    """The place after the quote that closes a cell, or -1."""
    while (k := line.find('"', at)) >= 0:
        if not line.startswith('"', k + 1):
            return k + 1
        at = k + 2
    return -1


def after(line: str, delimiter: str, inside: bool) -> bool:
    """Whether a quoted cell is open at the end of a line that begins so."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if inside or line.startswith('"', at):
            at = closing(line, at if inside else at + 1)
            if at < 0:
                return True
        inside, at = False, line.find(delimiter, at) + 1
        if not at:
            return False


def rows_of(text: str, delimiter: str, line: int) -> list[tuple[int, list[str]]]:
    """The records of a text, trimmed, without empty cells at the end; one, but where carriage returns alone end lines."""
    reader, begins, out = csv.reader(io.StringIO(text, newline=""), delimiter=delimiter), line, []
    for cells in reader:
        cells = [c.strip(" ") for c in cells]
        while cells and not cells[-1]:
            cells.pop()
        if any(c.strip() for c in cells):
            out.append((begins, cells))
        begins = line + reader.line_num
    return out


def _by_block(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Rows of sorted batches, with None where a block ends."""
    last = None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns)):
            if last is not None and row[:2] != last:
                yield None
            last = row[:2]
            yield row
    if last is not None:
        yield None


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block its number of lines, and what the bit is after it for either value before."""
    out, lines, ends = [], 0, (False, True)
    for row in _by_block(batches, "path", "block", "delimiter", "text"):
        if row is None:
            out.append((*at, lines, *ends))
            lines, ends = 0, (False, True)
            continue
        at, lines = row[:2], lines + 1
        ends = tuple(after(row[3], row[2], e) for e in ends) if '"' in row[3] else ends
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()))], names=["path", "block", "lines", "from_outside", "from_inside"])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    csv.field_size_limit(1 << 31)
    out, size = [], 0

    def frame():
        kinds = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["path", "delimiter", "line", "cells", "block", "kind", "part"])

    held, began, inside, rest, path = [], 0, None, False, None
    for row in _by_block(batches, "path", "block", "delimiter", "text", "inside", "first"):
        if row is None:
            if held:  # what is open at the block's end
                out.append((path, delimiter, began, None, block, REST if rest else OPEN, "\n".join(held)))
            held, inside = [], None
            continue
        path, block, delimiter, text, before, first = row
        if inside is None:
            inside, rest, line = before, before, first
        if not held:
            began = line
        held.append(text)
        inside, line = after(text, delimiter, inside), line + 1
        if not inside:
            if rest:
                out.append((path, delimiter, began, None, block, REST, "\n".join(held)))
            else:
                out += [(path, delimiter, at, cells, block, RECORD, None) for at, cells in rows_of("\n".join(held), delimiter, began)]
            size += sum(map(len, held)) + 64
            held, rest = [], False
            if size > HELD:
                yield frame()
                out, size = [], 0
    yield frame()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    csv.field_size_limit(1 << 31)
    for batch in batches:
        found = [(p, d, at, cells) for p, d, n, t in zip(*(batch.column(k).to_pylist() for k in range(4))) for at, cells in rows_of(t, d, n)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64(), pa.list_(pa.string())))], names=["path", "delimiter", "line", "cells"])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """path, delimiter, line (where it begins, from 1) and cells of every record with text of the files in a folder."""
    place = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")]
    raw = spark.read.option("lineSep", "\n").text(path).select(*place, F.monotonically_increasing_id().alias("at"), "value")
    order = F.struct("block", "at")
    known = raw.groupBy("path").agg(  # a row a file
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.min(order).alias("top"), F.min_by(F.col("value"), F.when(F.col("value").rlike(r"\S"), order)).alias("head")
    )
    plain = F.when(F.col("utf8"), F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    marked = F.when(F.col("utf8") & (order == F.col("top")), F.regexp_replace(plain, r"^\uFEFF", "")).otherwise(plain)
    sign = F.coalesce(delimiter_of(F.regexp_replace("head", r"^\uFEFF", "")), F.lit(","))
    lines = raw.join(known, "path").select("path", "block", "at", sign.alias("delimiter"), marked.alias("text"))
    dealt = lines.repartition("path", "block").sortWithinPartitions("path", "block", "at")
    blocks = dealt.mapInArrow(_summaries, "path string, block bigint, lines bigint, from_outside boolean, from_inside boolean")
    # A file's blocks in a row: some thousands for a terabyte.
    rows = F.array_sort(F.collect_list(F.struct("block", "lines", "from_outside", "from_inside")))
    start = F.struct(F.array().cast("array<struct<block: bigint, inside: boolean, first: bigint>>").alias("out"), F.lit(False).alias("inside"), F.lit(1).cast("bigint").alias("first"))
    step = lambda s, b: F.struct(
        F.array_append(s["out"], F.struct(b["block"].alias("block"), s["inside"].alias("inside"), s["first"].alias("first"))).alias("out"),
        F.when(s["inside"], b["from_inside"]).otherwise(b["from_outside"]).alias("inside"), (s["first"] + b["lines"]).alias("first"),
    )
    states = blocks.groupBy("path").agg(rows.alias("rows")).select("path", F.inline(F.aggregate("rows", start, step, lambda s: s["out"])))
    parsed = dealt.join(states, ["path", "block"]).repartition("path", "block").sortWithinPartitions("path", "block", "at").mapInArrow(_parsed, PARSED)
    whole = parsed.where(F.col("kind") == RECORD).select("path", "delimiter", "line", "cells")
    # A block's rest comes before what it leaves open; an open record and the rests after it are one.
    number = F.sum((F.col("kind") == OPEN).cast("int")).over(Window.partitionBy("path").orderBy("block", F.desc("kind")))
    pieces = parsed.where(F.col("kind") != RECORD).withColumn("number", number)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part"))), lambda x: x["part"]), "\n")
    broken = pieces.groupBy("path", "number").agg(F.max("delimiter").alias("delimiter"), F.min("line").alias("line"), text.alias("text"))
    return whole.unionByName(broken.select("path", "delimiter", "line", "text").mapInArrow(_joined, "path string, delimiter string, line bigint, cells array<string>"))
