"""WARC archives with an index first: write records, index them, read selected ones by coalesced byte ranges.

``write_archive`` writes gzip members, one per record, to files in a shared folder and returns the index: file, offset,
length, URL and digest of each record.  A file's name carries the attempt that wrote it and the index holds the names of
the attempts whose rows Spark kept, so tasks may fail, be repeated or run twice.  ``read_records`` sorts the selected
index rows by file and offset, joins ranges that lie close together into one read of bounded size, and parses them.

A payload that equals one of a smaller id becomes a ``revisit`` without body (WARC 1.1, identical-payload-digest); its
HTTP header still tells the length of the full payload and its record header the digest.

Defined cases: a null payload is empty; a null URL is written as an empty target; control characters in URLs are
percent-encoded; rows without id are archived under no number, stay responses and never are referred to; rows that
repeat an id are records of their own, of which equal payloads refer to the smallest id, so that a repeat of that id is
a response again; a payload of any length that fits a batch (2 GB) is one record, read in one piece; other columns are
ignored; an empty table gives no files and an empty index.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, scratch_path, stored, tidy

MIN_BYTES = 0
GAP = 64 << 10  # ranges closer than this are read together
READ = 2 << 20  # bytes of one read, if a record isn't longer
TASK = 64 << 20  # bytes of archive that a task reads; less where the cluster has tasks to spare
LEAST = 1 << 20
ROLL = 256 << 20  # bytes after which a task begins another file
INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string"
RECORD = "file string, offset long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
SCHEME = "urn:page:"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> tuple[bytes, str]:
    """The record's bytes and digest; ``first``: the id of the response that it revisits."""
    digest = digest32(payload)
    target = re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", url or "").encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if first is not None else http + payload
    own = f"{SCHEME}{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, (url or '') + digest)}"
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"response" if first is None else b"revisit"),
        f"WARC-Record-ID: <{own}>".encode(),
        b"WARC-Date: 1970-01-01T00:00:00Z",
        b"WARC-Target-URI: " + target,
        b"WARC-Payload-Digest: sha1:" + digest.encode(),
        b"WARC-Block-Digest: sha1:" + digest32(block).encode(),
        b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % len(block),
    ]
    if first is not None:
        head[2:2] = [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{SCHEME}{first}>".encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def parse(raw: bytes) -> dict:
    """Fields of one uncompressed record; checks lengths and the digests of what it holds."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.decode().lower(): v.decode() for k, _, v in (x.partition(b": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n" or "sha1:" + digest32(block) != fields["warc-block-digest"]:
        raise ValueError(f"damaged record {fields['warc-record-id']}")
    http, _, body = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\nContent-Length: *(\d+)", http)[1])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    response = fields["warc-type"] == "response"
    if response and (len(body) != size or digest32(body) != digest):
        raise ValueError(f"damaged payload of {fields['warc-record-id']}")

    def number(x: str) -> int | None:
        return int(x[1:-1].removeprefix(SCHEME)) if x.startswith(f"<{SCHEME}") else None

    return {
        "page_id": number(fields["warc-record-id"]), "url": fields["warc-target-uri"], "record_type": fields["warc-type"], "payload_bytes": size,
        "payload_digest": digest, "refers_to": number(fields.get("warc-refers-to", "")), "payload": body if response else None,
    }


def filesystem(uri: str):
    """The store of a URI or path: local and shared folders, or whatever pyarrow reaches (HDFS, S3, GCS)."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def writer(folder: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = filesystem(folder)
        out, name, at = None, "", 0
        try:
            for batch in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):
                rows = []
                for page_id, url, payload, first in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "payload", "first_id")), strict=True):
                    if out is None or at >= ROLL:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        store.create_dir(path, recursive=True)
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    raw, digest = record(page_id, url, payload, first)
                    member = gzip.compress(raw, 6, mtime=0)
                    out.write(member)
                    rows.append((f"{folder}/{name}", at, len(member), page_id, url, digest, "response" if first is None else "revisit"))
                    at += len(member)
                if rows:
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "offset", "length", "page_id", "url", "digest", "record_type"])
        finally:
            if out is not None:
                out.close()

    return tidy(run)


def write_archive(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Archives ``pages`` (page_id, url, html) under ``folder``; returns the stored index, a row per record."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    same = rows.where((F.length("payload") >= min_bytes) & F.col("page_id").isNotNull()).groupBy(F.sha1("payload").alias("_d"), F.length("payload").alias("_n")).agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("_c"))
    same = same.where("_c > 1").drop("_c")
    keyed = rows.withColumn("_d", F.sha1("payload")).withColumn("_n", F.length("payload"))
    typed = keyed.join(same, ["_d", "_n"], "left").select("page_id", "url", "payload", F.when(F.col("first_id") < F.col("page_id"), F.col("first_id")).alias("first_id"))
    return stored(typed.mapInArrow(writer(folder), INDEX), "index")


def ranges(index: DataFrame) -> DataFrame:
    """Index rows of a file that lie close together as one read: file, begin, stop, records (array of (offset, length))."""
    from pyspark.sql import Window

    # a file is bounded (ROLL and a record), and so is what one of these windows holds
    by = Window.partitionBy("file").orderBy("offset")
    apart = F.coalesce(F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(by), F.lit(0)) > GAP
    rows = index.select("file", "offset", "length", F.sum(apart.cast("int")).over(by).alias("island"))
    within = F.col("offset") - F.min("offset").over(Window.partitionBy("file", "island"))
    return rows.withColumn("piece", F.floor(within / READ)).groupBy("file", "island", "piece").agg(
        F.min("offset").alias("begin"), F.max(F.col("offset") + F.col("length")).alias("stop"), F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("records")
    )


def reader(with_payload: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            for file, begin, stop, records in zip(*(batch[c].to_pylist() for c in ("file", "begin", "stop", "records")), strict=True):
                if file != name:
                    store, path = filesystem(file)
                    name, source = file, store.open_input_file(path)
                data = source.read_at(stop - begin, begin)
                rows = []
                for r in records:
                    member = data[r["offset"] - begin : r["offset"] - begin + r["length"]]
                    row = {"file": file, "offset": r["offset"]} | parse(zlib.decompress(member, 31))
                    if not with_payload:
                        row["payload"] = None
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("file", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]))

    return tidy(run)


def dealt(reads: DataFrame, size: int) -> DataFrame:
    """Reads of ``size`` bytes in all, dealt out by stretches of the files.

    An index row is a thousandth of what it stands for, so the number of tasks comes from the bytes to be read; as a
    given number, it is not coalesced.
    """
    spare = min(reads.sparkSession.sparkContext.defaultParallelism, size // LEAST)
    tasks = max(1, spare, -(-size // TASK))
    stretch = F.floor(F.col("begin") / max(READ, size // tasks))
    return reads.repartition(tasks, "file", stretch).sortWithinPartitions("file", "begin")


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that the ``index`` rows name; revisits carry no payload but the length and digest of the full one."""
    size = index.agg(F.sum("length")).first()[0] or 0
    return dealt(ranges(index), size).mapInArrow(reader(with_payload), RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """Records whose revisits carry the payload of the response that they refer to."""
    bodies = records.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to")).agg(F.first("payload").alias("_body"))
    return records.join(bodies, "refers_to", "left").withColumn("payload", F.coalesce("payload", "_body")).drop("_body").select(*records.columns)


def archive_round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Archive ``pages`` in the shared folder and read every record back through the index."""
    index = write_archive(pages, scratch_path(pages.sparkSession, "warc"), min_bytes)
    return read_records(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "offset")
