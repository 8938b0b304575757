"""WARC archives: written from pages, and read back as a chunked record table.

Writing: a payload's SHA-1 decides its record. Of equal payloads the smallest page_id is a response
record, the others are revisit records that refer to it (identical-payload-digest profile) and keep the
HTTP header with its Content-Length. Which page is first is found by an aggregation over digests that
carries no payload. Each task then writes one archive of gzip members, one per record, in the shared
folder, under a name of its own; the table of finished archives is what counts, so a repeated task's
leftover file is never read.

Reading: archives are streamed. Each record becomes rows of record identifier and chunk number, with at
most CHUNK_BYTES of payload and the digest up to there; no record is ever held whole, whatever its size.
A record's last chunk has its full digest and size.

Defined cases: null html is an empty payload; equal payloads include empty ones; rows that repeat a
page_id are records of their own, the first of them the response; a null page_id is written with an empty
identifier, sorts before all others and reads back as null; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.llm.shared import shared_dir, stored

CHUNK_BYTES = 1 << 18
READ_BYTES = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: No page_id is smaller; stands for a null one.
NO_ID = -(1 << 63)

_CHUNKS = "record_id string, chunk_no bigint, record_type string, target_uri string, page_id bigint, refers_to_page bigint, declared_bytes bigint, header_digest string, payload binary, bytes_so_far bigint, digest_so_far string, is_last boolean"


def open_path(path: str, write: bool = False):
    """A stream on a path of the shared folder: a plain folder, or a store that pyarrow knows by its scheme."""
    if "://" in path or path.startswith("file:"):
        store, inner = pyarrow.fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    else:
        store, inner = pyarrow.fs.LocalFileSystem(), path
    if write:
        store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        return store.open_output_stream(inner)
    return store.open_input_stream(inner)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_name(page: int | None, digest: str, nth: int) -> str:
    """The same name for the same record however often a task runs."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}:{nth}')}>"


def record_parts(page, url, payload: bytes, digest: str, first: int | None, nth: int, date: str) -> Iterator[bytes]:
    """Header and block of one record, the payload in chunks; first is the response's page for a revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = first is not None
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_name(page, digest, nth)), ("WARC-Date", date),
        ("WARC-Target-URI", "".join((url or "").split())), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http;msgtype=response"), ("X-Page-ID", "" if page is None else str(page)),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_name(None if first == NO_ID else first, digest, 0)), ("X-Refers-To-Page", "" if first == NO_ID else str(first))]
    fields.append(("Content-Length", str(len(http) + (0 if revisit else len(payload)))))
    yield b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + http
    if not revisit:
        for at in range(0, len(payload), CHUNK_BYTES):
            yield payload[at : at + CHUNK_BYTES]
    yield b"\r\n\r\n"


def write_archives(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write the pages; the result is the stored table of finished archives (path, records)."""
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    key = F.coalesce("page_id", F.lit(NO_ID))
    # Digest and id alone decide; equal (digest, id) rows are merged before anything is joined.
    marks = rows.select(key.alias("key"), F.sha1("payload").alias("digest")).groupBy("digest", "key").agg(F.count(F.lit(1)).alias("n"))
    marks = stored(marks, "digests")
    firsts = marks.groupBy("digest").agg(F.min("key").alias("first"), F.sum("n").alias("all")).where("all > 1")
    later = marks.join(firsts.select("digest", "first"), "digest").select("key", F.col("digest").alias("marked"), "first")
    marked = rows.withColumns({"key": key, "digest": F.sha1("payload")})
    laid = marked.hint("merge").join(later.withColumnRenamed("key", "of"), (F.col("of") == F.col("key")) & (F.col("marked") == F.col("digest")), "left")
    # Repeated rows are numbered in the partitions that the join has made; a payload is shuffled once.
    nth = F.row_number().over(Window.partitionBy("key", "digest").orderBy("url")) - 1
    laid = laid.select("key", "page_id", "url", "payload", "digest", "first", nth.alias("nth"))
    schema = pa.schema([("path", pa.string()), ("records", pa.int64())])

    def run(batches):
        name, stream, n = f"{folder}/part-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            columns = [batch.column(k) for k in range(batch.num_columns)]
            for at in range(batch.num_rows):
                key, page, url, payload, digest, first, nth = (c[at].as_py() for c in columns)
                if stream is None:
                    stream = open_path(name, write=True)
                revisit = first if first is not None and (first != key or nth) else None
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                for part in record_parts(page, url, payload, base32(bytes.fromhex(digest)), revisit, nth, date):
                    stream.write(packer.compress(part))
                stream.write(packer.flush())
                n += 1
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], schema=schema)

    return stored(laid.mapInArrow(run, "path string, records bigint"), "archives")


class Inflated(io.RawIOBase):
    """The bytes of concatenated gzip members, a bounded piece at a time."""

    def __init__(self, stream):
        self.stream, self.inflater, self.raw, self.plain = stream, zlib.decompressobj(31), b"", b""

    def some(self) -> bytes:
        while True:
            if self.inflater.eof:
                self.raw, self.inflater = self.inflater.unused_data or self.raw, zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.stream.read(READ_BYTES)
                if not self.raw:
                    return b""
            out = self.inflater.decompress(self.raw, READ_BYTES)
            self.raw = b"" if self.inflater.eof else self.inflater.unconsumed_tail
            if out:
                return out

    def take(self, n: int) -> bytes:
        """n bytes, fewer at the end of the archive; n is bounded by the callers."""
        while len(self.plain) < n and (more := self.some()):
            self.plain += more
        out, self.plain = self.plain[:n], self.plain[n:]
        return out

    def head(self) -> bytes | None:
        """Up to and with the next empty line; None at the end."""
        while (at := self.plain.find(b"\r\n\r\n")) < 0:
            more = self.some()
            if not more:
                return None
            self.plain += more
        out, self.plain = self.plain[: at + 4], self.plain[at + 4 :]
        return out


def fields_of(head: bytes) -> dict[str, str]:
    pairs = (line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {p[0].lower(): p[1] if len(p) > 1 else "" for p in ((x if len(x) > 1 else [x[0].rstrip(":"), ""]) for x in pairs)}


def record_chunks(stream) -> Iterator[tuple]:
    """Rows of _CHUNKS of one archive, in order."""
    source = Inflated(stream)
    while (head := source.head()) is not None:
        fields = fields_of(head)
        number = lambda k: int(fields[k]) if fields.get(k) else None
        http = source.head() or b""
        left = int(fields["content-length"]) - len(http)
        declared = int(fields_of(http).get("content-length", 0))
        common = (fields["warc-type"], fields["warc-target-uri"], number("x-page-id"), number("x-refers-to-page"), declared, fields["warc-payload-digest"].removeprefix("sha1:"))
        digest, done, chunk = hashlib.sha1(), 0, 0
        while True:
            part = source.take(min(CHUNK_BYTES, left)) if left else b""
            if left and not part:
                raise ValueError(f"record {fields['warc-record-id']} is cut short")
            left -= len(part)
            done += len(part)
            digest.update(part)
            yield (fields["warc-record-id"], chunk, *common, part, done, base32(digest.copy().digest()), left == 0)
            chunk += 1
            if left == 0:
                break
        source.take(4)


def read_chunks(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """The chunked record table of archives(path, ...)."""
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(p.split()[0], kinds[p.split()[1]]) for p in _CHUNKS.split(",")])

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                for row in record_chunks(open_path(path)):
                    rows.append(row)
                    held += len(row[8]) + 500
                    if held > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    # One archive a task; the table of archives itself is small and comes in any number of files.
    spread = archives.select("path").repartition(max(1, archives.count()), "path")
    return spread.mapInArrow(run, _CHUNKS)


def payload_summary(chunks: DataFrame) -> DataFrame:
    """A row per record, from its last chunk; a revisit's payload is known by its header alone."""
    revisit = F.col("record_type") == "revisit"
    return chunks.where("is_last").select(
        "page_id", F.when(revisit, F.col("declared_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.when(revisit, F.col("header_digest")).otherwise(F.col("digest_so_far")).alias("payload_digest"),
        "record_type", F.col("refers_to_page").alias("refers_to"), "record_id", (F.col("chunk_no") + 1).alias("n_chunks"),
    )
