"""JSON, map and fingerprint columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Media types and the asset type they stand for.
ASSET_TYPES = {
    "application/pdf": "pdf", "text/plain": "txt", "text/markdown": "md", "text/csv": "csv", "text/html": "url",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx", "image/png": "image", "image/jpeg": "image",
}


def json_object(raw: Column, schema: str) -> Column:
    """JSN1: the outermost JSON object in noisy output, parsed; null where there is none."""
    return F.from_json(F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit("")), schema, {"mode": "PERMISSIVE"})


def salvaged(raw: Column, item: str, valid) -> Column:
    """JSN2: the closed flat objects of a list, cut off or not, that parse and are valid; and how many are not."""
    closed = F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(r"\{[^{}]*\}"), 0)
    parsed = F.transform(closed, lambda x: F.from_json(x, item))
    good = F.filter(parsed, valid)
    return F.struct(good.alias("items"), (F.size(closed) - F.size(good)).alias("dropped"))


def path_is(column: Column, key: str, value: Column | str) -> Column:
    """JSN3: whether a JSON column's key has a value."""
    return F.get_json_object(column, f"$.{key}") == value


def fingerprint(task: Column, args: Column) -> Column:
    """JSN5: SHA-256 of the task and its arguments in the order of their names."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(args)))
    return F.sha2(F.to_json(F.struct(task.alias("task"), ordered.alias("args"))), 256)


def content_hash(value: Column) -> Column:
    """JSN6: SHA-256 of the bytes; the empty string stands for no content."""
    return F.coalesce(F.sha2(value.cast("binary"), 256), F.lit(""))


def event_payloads(body: Column, schema: str) -> Column:
    """JSN7: payloads of the data lines of a server-sent event body."""
    lines = F.filter(F.split(body, "\n"), lambda x: x.startswith("data:"))
    return F.transform(lines, lambda x: F.from_json(F.trim(F.substring(x, 6, 1 << 20)), schema))


def asset_type(mime: Column) -> Column:
    """JSN9: the asset type of a media type, 'other' where unknown."""
    table = F.create_map(*(F.lit(x) for pair in ASSET_TYPES.items() for x in pair))
    return F.coalesce(table[F.lower(mime)], F.lit("other"))
