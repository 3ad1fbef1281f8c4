"""WARC archives that are written with an index and read back by coalesced byte ranges.

A task writes the records of its rows to one archive in the shared folder, each record compressed by itself, and returns
one index row per record: file, offset, length, URL and digest. Only the index rows of successful tasks are committed,
so files of lost or repeated attempts are never read. A reader selects index rows, sorts them by file and offset, and
reads neighbouring records in one range.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import blobs, lean, scratch, sized, slices, table, written

INDEX = "page_id long, file string, offset long, length long, url string, payload_digest string, record_type string, refers_to long"

#: Bytes of payload and head that are worth a task that writes, and of records one that reads. Fewer are few tasks, however many partitions a shuffle has, as each file that a task returns rows in costs its JVM three children on a local file system.
WORTH, HEAD = 4 << 20, 512


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder that driver and executors share. Hadoop's names for S3 are understood; a scheme that Arrow has no file system for is an error."""
    if not re.match("[a-zA-Z][a-zA-Z0-9+.-]*:", path):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


def _uri(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page))}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, size: int | None = None) -> bytes:
    """One WARC/1.1 record, as its own gzip member. A revisit carries no payload, but its digest and ``size`` and the record it refers to. A header of our own has the URL as it is, which the target URI can't have if it holds blanks or control characters."""
    kind = "response" if refers_to is None else "revisit"
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if refers_to is None else b"")
    target = "".join(c if " " < c else f"%{ord(c):02X}" for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_uri(page)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"X-Page-ID: {'' if page is None else page}",
        f"X-Page-URL: {json.dumps(url)}",
        f"X-Payload-Length: {len(payload) if size is None else size}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([] if refers_to is None else [f"WARC-Refers-To: {_uri(refers_to)}", f"X-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + pack.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def mark_revisits(pages: DataFrame, least: int = 1000, id_col: str = "page_id", text_col: str = "html") -> DataFrame:
    """``page_id, digest, size, refers_to``: of pages with equal payloads of at least ``least`` bytes all but that with the largest id refer to it. A null id is smaller than any other, and refers to the largest.

    Only ids and digests are shuffled. Pages with a shared payload are found by a grouping with map-side combination and
    joined by two plain scans, so adaptive execution can split the hot ones.
    """
    return _decided(_payloads(pages, id_col, text_col), least)


def _payloads(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``page_id, digest, size`` of each page, written."""
    payload = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    kind = pages.schema[id_col].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{id_col} must be a whole number, not {kind.simpleString()}")
    return written(pages.select(F.col(id_col).cast("long").alias("page_id"), F.unhex(F.sha1(payload)).alias("digest"), F.octet_length(payload).cast("long").alias("size")), "payloads")


def _decided(narrow: DataFrame, least: int) -> DataFrame:
    shared = narrow.filter(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "size", "first_id")
    shared = written(sized(shared, narrow.count()), "shared")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return narrow.hint("merge").join(shared, ["digest", "size"], "left").select("page_id", "digest", "size", refers.alias("refers_to"))


def write(pages: DataFrame, folder: str, least: int = 1000, date: str | None = None, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """Writes one record per page and returns the committed index.

    Null html is an empty payload, a null url an empty target. Ids are whole numbers; pages that repeat one are told apart
    by their payloads, and those that repeat both become a record each and refer to nothing in their own id. An empty
    table gives an empty index. Extra columns are ignored.

    A page's record is made and compressed where the page is read, so what meets its decision is the compressed record.
    """
    when = date or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    narrow = _payloads(pages, id_col, text_col)
    revisits = _decided(narrow, least).filter("refers_to IS NOT NULL").select(F.col("page_id").alias("id"), F.col("digest").alias("of"), "size", "refers_to").dropDuplicates(["id", "of"])

    @lean
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            digests, records = [], []
            for page, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), blobs(batch.column(2)), strict=True):
                digest = hashlib.sha1(html)
                digests.append(digest.digest())
                records.append(record(page, url, html, digest.hexdigest(), None, when))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(records, pa.binary())], ["page_id", "url", "digest", "record"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(text_col).alias("html"))
    rows = rows.mapInArrow(pack, "page_id long, url string, digest binary, record binary")
    rows = rows.join(revisits, rows.page_id.eqNullSafe(revisits.id) & (rows.digest == revisits.of), "left").select("page_id", "url", "digest", "size", "refers_to", "record")
    rows = sized(rows, narrow.agg(F.sum(F.col("size") + HEAD)).first()[0] or 0, WORTH)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(folder)
        fs.create_dir(base, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        at, out = 0, None
        try:
            for batch in slices(batches, 5):
                made = []
                for page, url, digest, size, ref, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if out is None:
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    if ref is not None:
                        data = record(page, url, b"", digest.hex(), ref, when, size)
                    out.write(data)
                    made.append({"page_id": page, "file": f"{folder}/{name}", "offset": at, "length": len(data), "url": url, "payload_digest": digest.hex(), "record_type": "response" if ref is None else "revisit", "refers_to": ref})
                    at += len(data)
                yield pa.RecordBatch.from_pylist(made, schema=_arrow_index())
        finally:
            if out is not None:
                out.close()

    return written(rows.mapInArrow(run, INDEX), "warc-index")


def _arrow_index() -> pa.Schema:
    return pa.schema([("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def ranges(spots: list[tuple[int, int]], gap: int = 64 << 10, most: int = 8 << 20) -> list[list[int]]:
    """Indexes of (offset, length) spots, sorted by offset, grouped where they lie within ``gap`` and the range stays under ``most``."""
    out: list[list[int]] = []
    start = end = 0
    for i in sorted(range(len(spots)), key=lambda i: spots[i]):
        at, n = spots[i]
        if out and at - end <= gap and at + n - start <= most:
            out[-1].append(i)
        else:
            out.append([i])
            start = at
        end = max(end, at + n) if len(out[-1]) > 1 else at + n
    return out


def read(selected: DataFrame, partitions: int | None = None, payload: bool = True) -> DataFrame:
    """Reads the records of the selected index rows: ``page_id, url, record_type, refers_to, payload_bytes, payload_digest`` and ``payload`` (null for a revisit).

    All is taken from the archive's records, the digest of a response computed anew from its payload. Rows are range
    partitioned and sorted by file and offset, so that a task reads few archives forwards, in coalesced ranges. ``url`` is
    the page's, null if it had none. ``partitions`` are taken as given; else they are the session's, fewer for few bytes.
    """
    fields = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payload
    schema = T._parse_datatype_string(fields)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, name, fs = None, None, None
        for batch in batches:
            files, offset, length = (batch.column(i).to_pylist() for i in range(3))
            groups: list[tuple[str, int, int]] = []
            for i, f in enumerate(files):
                if not groups or groups[-1][0] != f:
                    groups.append((f, i, i + 1))
                else:
                    groups[-1] = (f, groups[-1][1], i + 1)
            for f, lo, hi in groups:
                if f != name:
                    if file is not None:
                        file.close()
                    fs, path = _fs(f)
                    file, name = fs.open_input_file(path), f
                spots = list(zip(offset[lo:hi], length[lo:hi], strict=True))
                for group in ranges(spots):
                    start = spots[group[0]][0]
                    data = file.read_at(max(sum(spots[i]) for i in group) - start, start)
                    out = []
                    for i in group:
                        head, body = parse(data[spots[i][0] - start : sum(spots[i]) - start])
                        ref = head.get("X-Refers-To-Page")
                        digest = hashlib.sha1(body).hexdigest() if ref is None else head["WARC-Payload-Digest"].removeprefix("sha1:")
                        out.append({"page_id": int(head["X-Page-ID"]) if head["X-Page-ID"] else None, "url": json.loads(head["X-Page-URL"]), "record_type": head["WARC-Type"], "refers_to": None if ref is None else int(ref), "payload_bytes": len(body) if ref is None else int(head["X-Payload-Length"]), "payload_digest": digest} | ({"payload": body if ref is None else None} if payload else {}))
                    yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), *([("payload", pa.binary())] if payload else [])]))
        if file is not None:
            file.close()

    n = partitions or int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spots = selected.select("file", "offset", "length").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    if partitions is None:
        spots = sized(spots, selected.agg(F.sum("length")).first()[0] or 0, WORTH)
    return spots.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every page written to an archive and read back."""
    index = write(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return read(index, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH t AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
m AS (SELECT page_id, payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS top FROM t)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM m
"""
