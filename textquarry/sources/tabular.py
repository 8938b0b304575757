"""Tables as text: delimiters, encodings, headers, cells and rows."""

from __future__ import annotations

import csv
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

DELIMITERS = (",", ";", "\t", "|")


def delimiter_of(text: Column) -> Column:
    """SRC2: the most frequent delimiter of the first line with text; the earlier one wins a tie."""
    first = F.regexp_extract(text, r"(?m)^[^\S\n]*\S[^\n]*", 0)
    counts = F.array(*(F.struct((F.length(first) - F.length(F.replace(first, F.lit(d), F.lit("")))).alias("n"), F.lit(-k).alias("rank"), F.lit(d).alias("d")) for k, d in enumerate(DELIMITERS)))
    return F.array_max(counts)["d"]


def decoded(content: Column) -> Column:
    """SRC3: UTF-8 without its mark where it is valid, else Latin-1; with the name of the encoding."""
    valid = F.is_valid_utf8(content.cast("string"))
    text = F.when(valid, F.regexp_replace(F.decode(content, "UTF-8"), r"^\uFEFF", "")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.struct(text.alias("text"), F.when(valid, "utf-8").otherwise("latin-1").alias("encoding"))


def records(texts: DataFrame, key: str) -> DataFrame:
    """SRC2: key, delimiter, line and cells of every record with text of texts(key, text), tables that are columns already; files are read by delimited.read_records.

    Quoted cells may hold delimiters, doubled quotes and line breaks; line is where the record begins. Records have any
    number of cells, trimmed, up to the last one that is filled.
    """
    kind = dict(texts.dtypes)[key]

    def run(batches):
        csv.field_size_limit(1 << 31)
        for batch in batches:
            for name, text, delimiter in zip(*(batch.column(k).to_pylist() for k in range(3))):
                reader, begins, rows, held = csv.reader(io.StringIO(text, newline=""), delimiter=delimiter), 1, [], 0
                for cells in reader:
                    cells = [c.strip(" ") for c in cells]
                    while cells and not cells[-1]:
                        cells.pop()
                    if any(c.strip() for c in cells):
                        rows.append((begins, cells))
                        held += sum(map(len, cells)) + 64
                    begins = reader.line_num + 1
                    if held > 1 << 22:
                        yield frame(batch.schema.field(0).type, name, delimiter, rows)
                        rows, held = [], 0
                if rows:
                    yield frame(batch.schema.field(0).type, name, delimiter, rows)

    def frame(kind, name, delimiter, rows):
        return pa.RecordBatch.from_arrays([pa.array([name] * len(rows), kind), pa.array([delimiter] * len(rows)), pa.array([n for n, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.list_(pa.string()))],
                                          names=[key, "delimiter", "line", "cells"])

    found = texts.where(F.col("text").isNotNull()).select(key, "text", delimiter_of(F.col("text")).alias("delimiter"))
    return found.mapInArrow(run, f"`{key}` {kind}, delimiter string, line int, cells array<string>")


def header_names(cells: DataFrame, key: str) -> DataFrame:
    """SRC4: a blank header is column_N; the n-th repeat of a name gets _n. Rows are (key, pos from 1, name)."""
    named = cells.withColumn("base", F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("column_"), F.col("pos").cast("string"))))
    nth = F.row_number().over(Window.partitionBy(key, "base").orderBy("pos"))
    return named.select(key, "pos", F.when(nth == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), nth.cast("string"))).alias("name"))


def cell_text(column: Column, kind: T.DataType) -> Column:
    """SRC6: a cell as text by its type: midnight is a date, truth in capitals, whole floats without a point, 15 digits."""
    if isinstance(kind, T.BooleanType):
        return F.when(column, "TRUE").when(~column, "FALSE")
    if isinstance(kind, T.TimestampType):
        return F.when(F.date_format(column, "HH:mm:ss") == "00:00:00", F.date_format(column, "yyyy-MM-dd")).otherwise(F.date_format(column, "yyyy-MM-dd HH:mm:ss"))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (column == F.floor(column)) & (F.abs(column) < 1e15)
        short = F.regexp_replace(F.format_string("%.15g", column), r"(\.\d*?)0+$", "$1")
        return F.when(whole, column.cast("bigint").cast("string")).otherwise(F.regexp_replace(short, r"\.$", ""))
    return F.trim(column.cast("string"))


def row_text(df: DataFrame, sheet: str | None = None) -> Column:
    """SRC5: a row as 'column: value' lines without its empty cells, headed by the sheet."""
    lines = [F.when(F.coalesce(cell_text(F.col(f.name), f.dataType), F.lit("")) != "", F.concat(F.lit(f"{f.name}: "), cell_text(F.col(f.name), f.dataType))) for f in df.schema]
    head = [F.lit(f"sheet: {sheet}")] if sheet else []
    return F.concat_ws("\n", *head, *lines)


def row_preview(df: DataFrame, sheet: str, row: Column) -> Column:
    """SRC5: the same, headed by the sheet and the row's number."""
    return F.concat(F.lit(f"{sheet} · row "), row.cast("string"), F.lit("\n"), row_text(df))
