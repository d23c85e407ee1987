"""Small files that queries over sources and sinks read and write, in the folder that the session shares."""

from __future__ import annotations

import struct
import tempfile
import uuid
import zlib

from pyspark.sql import SparkSession


def folder(spark: SparkSession, kind: str) -> str:
    """A new path under spark.checkpoint.dir; in local mode without one, under a temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="docfields-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/docfields/{kind}-{uuid.uuid4().hex}"


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """Writes one file through Spark's file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(content))
    out.close()


def png(width: int, height: int, gray: int) -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = (b"\0" + bytes([gray]) * width) * height
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def bmp(width: int, height: int, rgb: tuple[int, int, int]) -> bytes:
    row = bytes(rgb[::-1]) * width
    body = (row + b"\0" * (-len(row) % 4)) * height
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 0, 0, 0, 0) + body


def tiff(frames: list[tuple[int, int, int]]) -> bytes:
    """Frames of (width, height, gray), uncompressed."""
    out = b"II*\0" + struct.pack("<I", 8)
    for k, (width, height, gray) in enumerate(frames):
        tags = [(256, 4, width), (257, 4, height), (258, 3, 8), (259, 3, 1), (262, 3, 1), (273, 4, 0), (277, 3, 1), (278, 4, height), (279, 4, width * height)]
        data_at = len(out) + 2 + 12 * len(tags) + 4
        after = data_at + width * height
        entries = b"".join(struct.pack("<HHII", t, kind, 1, data_at if t == 273 else v) for t, kind, v in tags)
        out += struct.pack("<H", len(tags)) + entries + struct.pack("<I", after if k + 1 < len(frames) else 0) + bytes([gray]) * (width * height)
    return out
