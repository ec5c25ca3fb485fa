"""WARC archives: a writer with revisit records and a splittable reader.

The reader deals byte ranges of the archives out to tasks. A task scans its range for the gzip magic, takes a candidate as a
record's member only if its first bytes inflate to a WARC version line and the whole member inflates with a right checksum, and
then follows members one after another; a record belongs to the range in which its member starts, so none is read twice or missed.

A task's rows are sorted before they are written, so that a task that runs again writes the same bytes.

Cases: a null payload is an empty one; a null key or url is read back as null, an empty one as empty; equal payloads of at least
min_bytes have the record with the smallest key as response (null keys last; rows that repeat that key are responses, too), the
others are revisits; an empty table writes no archive; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from itertools import chain

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covary.llm.store import place_file, shared_dir

SPLIT_BYTES = 8 << 20
_MAGIC = b"\x1f\x8b\x08"
_CHUNK = 1 << 18
_READ = "key string, url string, record_type string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"


def _line(value: str) -> str:
    """A header's value on one line; a percent sign is escaped too, so that _value undoes it."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _value(line: str) -> str:
    return line.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(key: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit holds the HTTP headers only, which give the payload's length.

    A null key or url has no header of its own. The target URI stands as it is but for line breaks.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key} {url} {digest}')}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    lines += [f"{name}: {_line(x)}" for name, x in (("X-Row-Key", key), ("X-Row-URL", url)) if x is not None]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Key: {_line(refers_to)}"]
    lines.append(f"Content-Length: {len(block)}")
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse(data: bytes) -> tuple:
    """A row of _READ from an inflated record."""
    head, _, body = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    block = body[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = int(http.rpartition(b"Content-Length: ")[2])
    kind = fields["WARC-Type"]
    key, url, refers_to = (_value(x) if (x := fields.get(name)) is not None else None for name in ("X-Row-Key", "X-Row-URL", "X-Refers-To-Key"))
    return key, url, kind, refers_to, fields["WARC-Payload-Digest"].removeprefix("sha1:"), said, payload if kind == "response" else None


def _write(uri: str):
    def run(batches):
        from pyspark import TaskContext

        first = next(batches, None)
        if first is None:
            return
        name, n, size = f"part-{TaskContext.get().partitionId():06d}.warc.gz", 0, 0

        def records(sink):
            nonlocal n, size
            for batch in chain([first], batches):
                for key, url, html, refers in zip(*(batch.column(c) for c in ("key", "url", "payload", "refers_to")), strict=True):
                    payload = (html.as_py() or "").encode()
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    made = record(key.as_py(), url.as_py(), payload, digest, refers.as_py())
                    sink.write(made)
                    n, size = n + 1, size + len(made)

        place_file(uri, name, records)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["file", "bytes", "records"])

    return run


def write_warc(df: DataFrame, uri: str, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes an archive per partition under uri; returns the manifest (file, bytes, records).

    Only groups of two rows and more are looked up by their digest; the rows' keys meet the payloads again by key.
    """
    text = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = df.select(F.col(key_col).alias("key"), F.col(url_col).cast("string").alias("url"), text.alias("payload"))
    digests = rows.select("key", F.sha2(F.col("payload").cast("binary"), 256).alias("digest"), F.octet_length("payload").alias("size")).filter(F.col("size") >= min_bytes)
    groups = digests.groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null").select("digest", "first")
    # a row's group is told by its key and digest: rows that repeat a key with other payloads stay apart
    twins = digests.join(groups, "digest").filter(~F.col("key").eqNullSafe(F.col("first"))).select("key", "digest", "first").distinct()
    keyed = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    marked = keyed.join(twins.select(F.col("key").alias("k"), F.col("digest").alias("d"), "first"), F.col("key").eqNullSafe(F.col("k")) & (F.col("digest") == F.col("d")), "left")
    out = marked.select(F.col("key").cast("string").alias("key"), "url", "payload", F.col("first").cast("string").alias("refers_to"))
    manifest = out.sortWithinPartitions("key", F.xxhash64("url", "payload")).mapInArrow(_write(uri), "file string, bytes bigint, records bigint")
    return df.sparkSession.createDataFrame(manifest.toArrow())  # a row per archive


def members(stream, start: int, end: int):
    """Inflated records whose gzip members start in [start, end)."""
    stream.seek(start)
    held, base = bytearray(), start  # bytes of the file from base on; grows and sheds its front in place

    def fill() -> bool:
        more = stream.read(_CHUNK)
        held.extend(more)
        return bool(more)

    def inflate(at: int) -> tuple[bytes, int] | None:
        """The record of the member at held[at:] and where the member ends, or None if there is none."""
        unpack, out, seen, pos = zlib.decompressobj(31), [], 0, at
        try:
            while not unpack.eof:
                if pos >= len(held) and not fill():
                    return None
                block = held[pos : pos + _CHUNK]
                got = unpack.decompress(block)
                out.append(got)
                seen += len(got)
                pos += len(block) - len(unpack.unused_data)
                if seen >= 7 and not b"".join(out[:3])[:7].startswith(b"WARC/1."):
                    return None
        except zlib.error:
            return None
        data = b"".join(out)
        return (data, pos) if data.startswith(b"WARC/1.") else None

    at, following = 0, False
    while True:
        if not following:
            at = held.find(_MAGIC, at)
            while at < 0 and base + len(held) < end + 2:
                keep = max(0, len(held) - 2)
                base += keep
                del held[:keep]
                if not fill():
                    return
                at = held.find(_MAGIC)
            if at < 0:
                return
        if base + at >= end:
            return
        got = inflate(at)
        if got is None:
            if following and at >= len(held) and not fill():
                return
            at, following = at + 1, False
            continue
        yield got[0]
        base, at, following = base + got[1], 0, True
        del held[: got[1]]
        if not held and not fill():
            return


def read_warc(manifest: DataFrame, uri: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A row per record; payload is null for a revisit, whose payload_bytes and payload_digest are those of the full payload."""
    spark = manifest.sparkSession
    starts = F.sequence(F.lit(0), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes))
    ranges = manifest.filter("bytes > 0").select("file", F.explode(starts).alias("start"), "bytes").select("file", "start", F.least(F.col("start") + split_bytes, "bytes").alias("end"))
    schema = pa.schema([("key", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for file, start, end in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "end")), strict=True):
                rows, size = [], 0
                with fs.open_input_file(f"{root}/{file}") as stream:
                    for data in members(stream, start, end):
                        rows.append(parse(data))
                        size += len(data)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return ranges.repartition(n, "file", "start").mapInArrow(run, _READ)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """Writes the pages as WARC records and reads them back: what each record says of its page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    uri = shared_dir(spark, "warc")
    kind = pages.schema["page_id"].dataType
    return read_warc(write_warc(pages, uri), uri).select(
        F.col("key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex, sha256(html) AS k, min(page_id) OVER (PARTITION BY sha256(html)) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (i * 5 + 1)::INT, 5))::BIGINT >> s) & 31)::INT + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM h
"""
