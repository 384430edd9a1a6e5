"""Deterministic sharded WARC files: writer and reader."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maploom.llm.shards import MANIFEST, File, commit, cuts, manifest, shard_of
from maploom.llm.shared import open_fs, written

#: Payload bytes of a shard, compressed bytes at which a file is closed, payload bytes from which copies become revisits.
SHARD_BYTES, FILE_BYTES, LEAST_BYTES = 32 << 20, 16 << 20, 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ROLE_MARK, _ROLE_PAGE = 0, 1


def _b32(hexed: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexed)).decode()


def _urn(page_id: int | None, digest: str, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{nth}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, nth: int) -> bytes:
    """One record; a revisit has the HTTP header but no payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id, digest, nth)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to, digest, 0)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: {_b32(digest)}", f"WARC-Block-Digest: {_b32(hashlib.sha1(block).hexdigest())}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warcinfo(name: str) -> bytes:
    """The record that opens a file."""
    block = b"software: maploom\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'file:{name}')}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}"]
    head += [f"WARC-Block-Digest: {_b32(hashlib.sha1(block).hexdigest())}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(record) + pack.flush()


def write_warc(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes one record for each row of pages (page_id, url, html) and returns the manifest.

    Records are in ascending page_id, null first, then by digest and url; a shard is a range of page ids, so
    the same rows give the same files byte for byte, whatever the partitioning. Each record is a gzip member of its own;
    a warcinfo record opens each file, which is closed once it holds file_bytes. A payload is the html in UTF-8, empty for null. Of equal payloads of at least
    least_bytes the one with the largest page_id is a response and the others revisit it; among repeated rows with
    that page_id one is the response. Payloads that only rows without a page_id have are all responses. Null urls
    give no target line. No pages give an empty manifest. Other columns are not read.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("payload"))
    slim = written(rows.select("page_id", F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("digest")), "pages")
    at = cuts(slim.select(F.col("page_id").alias("k"), F.xxhash64("digest").alias("h"), (F.col("n") + 400).alias("w")), shard_bytes)
    large = slim.where(F.col("n") >= least_bytes)
    same = large.groupBy("digest").agg(F.max("page_id").alias("rep"), F.count("*").alias("c")).where("c > 1 and rep is not null").select("digest", "rep")
    marks = large.join(same, "digest").select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "rep", F.lit(_ROLE_MARK).alias("role"))
    full = rows.select("*", F.sha1("payload").alias("digest"), F.lit(None).cast("long").alias("rep"), F.lit(_ROLE_PAGE).alias("role"))
    every = full.unionByName(marks).withColumn("shard", shard_of(spark, F.col("page_id"), F.xxhash64("digest"), at))
    order = ["shard", F.col("page_id").asc_nulls_first(), "digest", "role", F.col("url").asc_nulls_first()]
    every = every.repartitionById(len(at) + 1, "shard").sortWithinPartitions(*order).select("shard", "page_id", "url", "payload", "digest", "rep", "role")

    def run(batches):
        file, key, nth, rep = None, None, 0, None
        for batch in batches:
            for shard, page_id, url, payload, digest, mark, role in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if (page_id, digest) != key:
                    key, nth, rep = (page_id, digest), 0, None
                if role == _ROLE_MARK:
                    rep = mark
                    continue
                if file is None or file.shard != shard or file.bytes >= file_bytes:
                    seq = file.seq + 1 if file is not None and file.shard == shard else 0
                    if file is not None:
                        yield file.row()
                    file = File(folder, shard, seq, "warc.gz")
                    file.write(_member(warcinfo(file.name)))
                revisit = rep is not None and (page_id != rep or nth > 0)
                file.write(_member(record(page_id, url, payload, digest, rep, revisit, nth)))
                file.records += 1
                nth += 1
        if file is not None:
            yield file.row()

    return commit(every.mapInArrow(run, MANIFEST), folder)


def records(stream) -> "list":
    """(headers, block) of each record of a decompressed WARC stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            head[name.lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        if len(block) != int(head["content-length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record is cut short")
        yield head, block


def read_warc(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """One row for each record of the files that the manifest names, digests checked.

    page_id, url, payload_bytes, payload_digest (hex), record_type, refers_to (a page_id), and payload on demand (null
    for revisits). An empty manifest gives no rows.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payload
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payload

    def rows(path):
        fs, base = open_fs(folder)
        with fs.open_input_stream(f"{base}/{path}", compression=None) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 18) as stream:
            for head, block in records(stream):
                if _b32(hashlib.sha1(block).hexdigest()) != head["warc-block-digest"]:
                    raise ValueError(f"{path}: a block digest is wrong")
                if head["warc-type"] == "warcinfo":
                    continue
                top, _, body = block.partition(b"\r\n\r\n")
                digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                if head["warc-type"] == "response" and hashlib.sha1(body).hexdigest() != digest:
                    raise ValueError(f"{path}: a payload digest is wrong")
                size = int(top.lower().partition(b"content-length:")[2].split(b"\r\n")[0])
                number = lambda name: int(head[name]) if name in head else None
                row = (number("x-page-id"), head.get("warc-target-uri"), size, digest, head["warc-type"], number("x-refers-to-page-id"))
                yield (*row, body if head["warc-type"] == "response" else None) if payload else row

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                part, held = [], 0
                for row in rows(path):
                    part.append(row)
                    held += row[2]
                    if len(part) >= 4096 or payload and held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names)
                        part, held = [], 0
                if part:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    files = manifest(spark, folder).select("file")
    return files.repartition(max(1, files.count())).mapInArrow(run, schema)
