"""WARC archives: one gzip member per record, written by tasks and read back sequentially.

The writer keeps one copy of payloads that occur more than once: the row with the
largest page_id is a response, the others are revisit records that refer to it and
hold HTTP headers only. Each task streams its records into files of its own in the
shared folder; the table of files that committed tasks reported is the archive, so a
lost or repeated task leaves nothing but an unlisted file. The reader walks a file
through an incremental decompressor, frames each record by Content-Length and checks
its digests, holding one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.llm.common import materialize, shared_path

VERSION = b"WARC/1.1"
DATE = "2000-01-01T00:00:00Z"
SALTS = 16
STEP = 1 << 20

FILES = "path string, n_records long, n_bytes long"
RECORDS = (
    "path string, offset long, record_type string, record_id string, target_uri string, refers_to string, "
    "payload_bytes long, payload_digest string, payload binary, problem string"
)


def _b32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _hex(field: str) -> str:
    """sha1:BASE32 of a header as bare lower-case hex."""
    return base64.b32decode(field.partition(":")[2]).hex()


def record(kind: str, record_id: str, uri: str, payload: bytes, digest: bytes, length: int, refers_to: str | None, date: str = DATE) -> bytes:
    """One record as a gzip member. length and digest are those of the full payload, also where a revisit leaves it out."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length + payload
    head = [
        f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: {_b32(digest)}",
        f"WARC-Block-Digest: {_b32(hashlib.sha1(block).digest())}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def members(stream: BinaryIO, step: int = STEP) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member of a file, decompressed as it is read."""
    at, rest = 0, b""
    while True:
        data = rest or stream.read(step)
        if not data:
            return
        start, unpack, out = at, zlib.decompressobj(31), []
        while True:
            out.append(unpack.decompress(data))
            if unpack.eof:
                at += len(data) - len(unpack.unused_data)
                rest = unpack.unused_data
                break
            at += len(data)
            data = stream.read(step)
            if not data:
                raise ValueError(f"the member at {start} ends early")
        yield start, b"".join(out)


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record, framed by Content-Length."""
    head, mark, rest = content.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"WARC/"):
        raise ValueError("no WARC header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"the block has {len(rest) - 4} bytes, Content-Length says {length}")
    return fields, rest[:length]


def examine(content: bytes) -> dict:
    """One record's figures; problem tells which digest or length doesn't hold (null: all hold)."""
    fields, block = parse(content)
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, problem = _hex(fields["warc-payload-digest"]), None
    said = re.search(rb"(?i)\r\nContent-Length:\s*(\d+)", http)
    length = int(said[1]) if said else len(payload)
    if hashlib.sha1(block).hexdigest() != _hex(fields["warc-block-digest"]):
        problem = "block digest"
    elif fields["warc-type"] == "response":
        if hashlib.sha1(payload).hexdigest() != digest:
            problem = "payload digest"
        elif len(payload) != length:
            problem = "payload length"
    strip = lambda name: fields[name].strip("<>") if name in fields else None
    return {
        "record_type": fields["warc-type"], "record_id": strip("warc-record-id"), "target_uri": fields.get("warc-target-uri"),
        "refers_to": strip("warc-refers-to"), "payload_bytes": length, "payload_digest": digest, "payload": payload, "problem": problem,
    }


def _name(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def _writer(folder: str, max_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows, done = None, [], []
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)

        def close() -> None:
            out.close()
            done.append(tuple(rows))

        for batch in batches:
            for page_id, url, body, digest, size, keep in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, rows = store.open_output_stream(f"{base}/{name}", compression=None), [f"{folder}/{name}", 0, 0]
                again = keep is not None and page_id != keep
                uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
                data = record(
                    "revisit" if again else "response", _name(page_id), uri, b"" if again else body.encode(),
                    bytes.fromhex(digest), size, _name(keep) if again else None,
                )
                out.write(data)
                rows[1] += 1
                rows[2] += len(data)
                if rows[2] >= max_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done]) for i in range(3)], names=["path", "n_records", "n_bytes"])

    return write


def write_warc(pages: DataFrame, *, folder: str | None = None, dedup_bytes: int = 1000, max_bytes: int = 256 << 20) -> DataFrame:
    """Writes every row of pages (page_id, url, html) as a WARC record; the table of the files.

    Null html is an empty payload, null url an empty URI. Of rows with equal payloads of at
    least dedup_bytes bytes the one with the largest page_id is the response. Rows that share
    that page_id are all responses; rows with a null page_id revisit it, unless all ids of the
    group are null, when all are responses. An empty table gives no files. Equal payloads are
    found by digest on a salted key, so a hot payload is spread over many tasks.
    """
    folder = folder or shared_path(pages.sparkSession, "warc")
    body = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("body"))
    p = p.select("page_id", "url", "body", F.sha1(F.col("body").cast("binary")).alias("digest"), F.octet_length("body").cast("long").alias("size"))
    keep = p.where(F.col("size") >= dedup_bytes).groupBy("digest").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n"))
    keep = keep.where("n > 1 AND keep IS NOT NULL").select("digest", "keep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    rows = salted.join(keep, ["digest", "salt"], "left")
    again = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    rows = rows.select("page_id", "url", F.when(again, F.lit("")).otherwise(F.col("body")).alias("body"), "digest", "size", "keep")
    return materialize(rows.mapInArrow(_writer(folder, max_bytes), FILES), "warc-files")


def _reader(payloads: bool, strict: bool, rows: int = 2000, held: int = 16 << 20):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
        names = [x.split()[0] for x in RECORDS.split(", ")]
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                out, size = [], 0
                with store.open_input_stream(name, compression=None) as stream:
                    for offset, content in members(stream):
                        row = {"path": path, "offset": offset} | examine(content)
                        if strict and row["problem"]:
                            raise ValueError(f"{path}, record at {offset}: {row['problem']}")
                        size += len(row["payload"])
                        if not payloads:
                            row["payload"] = None
                        out.append(row)
                        if len(out) >= rows or payloads and size >= held:
                            yield pa.RecordBatch.from_pylist(out, schema=schema)
                            out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    return read


def read_warc(files: DataFrame, *, payloads: bool = True, strict: bool = True) -> DataFrame:
    """All records of the archives named in files.path, a task for each file.

    A digest or length that doesn't hold stops the job if strict, else it is told in
    `problem`. Framing that is broken (a member cut short, a wrong Content-Length) always stops it.
    """
    n = max(1, files.count())
    return files.select("path").repartition(n).mapInArrow(_reader(payloads, strict), RECORDS)


def page_records(pages: DataFrame, **options) -> DataFrame:
    """Writes pages and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    records = read_warc(write_warc(pages, **options), payloads=False)
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1)
    long = lambda c: F.when(number(c) != "", number(c).cast("long"))
    return records.select(long("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", long("refers_to").alias("refers_to"))
