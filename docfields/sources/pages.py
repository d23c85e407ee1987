"""Files to pages to recognised lines: decoders, recognisers, and error rows for what can't be read.

Decoding and recognising are the only places that run Python on executors, one batch of
files at a time; recognisers are made once in each worker. PNG, BMP and TIFF (uncompressed) are
decoded here, other kinds by a decoder that the caller names (for PDF one that
draws pages at 300 dots an inch).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.functions.geometry import envelope
from docfields.sources.ocr_json import CONTENT_TYPES, payload_lines

#: Fixed value: white border around a page before it is recognised; boxes include it.
BORDER = 30
PAGES = "path string, page_index int, width int, height int, pixels binary, error string"
Decoder = Callable[[bytes], list[np.ndarray]]


def kind_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def picked(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The files picked one by one, in order of path: path, name, kind, length, content. Spark doesn't read
    empty files, so they are added (a pick is a short list)."""
    files = spark.read.format("binaryFile").load(sorted(paths)).select("path", "length", "content")
    places = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    empty = [str(at) for at in places if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getLen() == 0]
    if empty:
        files = files.union(spark.createDataFrame([(p, 0, b"") for p in empty], "path string, length long, content binary"))
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), kind_of(F.col("path")).alias("kind"), "length", "content").orderBy("path")


def dropped_folder(spark: SparkSession, paths: list[str]) -> str | None:
    """Of the paths dropped, the first that is a folder; files are ignored."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if system.exists(at) and system.getFileStatus(at).isDirectory():
            return path
    return None


def guarded(files: DataFrame) -> DataFrame:
    """Adds error: why a file isn't read, null for documents. An unsupported kind is told before the content is looked at."""
    supported = F.col("kind").isin(*CONTENT_TYPES)
    return files.withColumn("error", F.when(~supported, F.concat(F.lit("unsupported file type: ."), "kind")).when(F.col("length") == 0, F.lit("empty file")))


def _png(data: bytes) -> list[np.ndarray]:
    at, idat, head = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        head = struct.unpack(">IIBBBBB", body) if kind == b"IHDR" else head
        idat += body if kind == b"IDAT" else b""
        at += 12 + size
    width, height, depth, colour, _, _, interlaced = head
    if depth != 8 or interlaced or colour not in (0, 2, 4, 6):
        raise ValueError("kind of PNG not supported")
    bands = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(idat), np.uint8).reshape(height, 1 + width * bands)
    out = np.zeros((height, width * bands), np.uint8)
    above = np.zeros(width * bands, np.int64)
    for y in range(height):
        row, how = raw[y, 1:].astype(np.int64), raw[y, 0]
        if how == 2:
            row = row + above
        elif how in (1, 3, 4):
            for x in range(len(row)):
                left, up, corner = (row[x - bands], above[x], above[x - bands]) if x >= bands else (0, above[x], 0)
                near = min((left, up, corner), key=lambda v: abs(left + up - corner - v))
                row[x] = (row[x] + (left if how == 1 else (left + up) // 2 if how == 3 else near)) & 255
        above = row & 255
        out[y] = above
    image = out.reshape(height, width, bands)
    return [np.repeat(image[:, :, :1], 3, axis=2) if bands < 3 else image[:, :, :3]]


def _bmp(data: bytes) -> list[np.ndarray]:
    start, _, width, height, _, bits, packed = struct.unpack("<IIiiHHI", data[10:34])
    if bits not in (24, 32) or packed:
        raise ValueError("kind of BMP not supported")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:, : width * bits // 8]
    image = rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    return [image[::-1] if height > 0 else image]


def _tiff(data: bytes) -> list[np.ndarray]:
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    frames, (at,) = [], struct.unpack(order + "I", data[4:8])
    while at:
        (n,) = struct.unpack(order + "H", data[at : at + 2])
        tags = {}
        for i in range(n):
            tag, kind, count, raw = struct.unpack(order + "HHI4s", data[at + 2 + 12 * i : at + 14 + 12 * i])
            form = {1: "B", 3: "H", 4: "I"}.get(kind)
            if form:
                size = struct.calcsize(form) * count
                held = raw[:size] if size <= 4 else data[struct.unpack(order + "I", raw)[0] :][:size]
                tags[tag] = struct.unpack(f"{order}{count}{form}", held)
        if tags.get(259, (1,))[0] != 1 or set(tags.get(258, (1,))) != {8}:
            raise ValueError("kind of TIFF not supported")
        width, height, bands = tags[256][0], tags[257][0], tags.get(277, (1,))[0]
        flat = b"".join(data[a : a + b] for a, b in zip(tags[273], tags[279], strict=True))
        image = np.frombuffer(flat, np.uint8).reshape(height, width, bands)
        frames.append(np.repeat(image[:, :, :1], 3, axis=2) if bands < 3 else image[:, :, :3])
        (at,) = struct.unpack(order + "I", data[at + 2 + 12 * n : at + 6 + 12 * n])
    return frames


DECODERS: dict[str, Decoder] = {"png": _png, "bmp": _bmp, "tif": _tiff, "tiff": _tiff}


def pages_of(files: DataFrame, decoders: dict[str, Decoder] | None = None) -> DataFrame:
    """PAGES of files (path, kind, length, content): a row for each page or frame, pixels as RGB bytes; a
    file that can't be read is one row with its error, and the job goes on."""
    known = DECODERS | (decoders or {})

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                error, frames = r.error, []
                if error is None:
                    try:
                        frames = known[r.kind](bytes(r.content)) if r.kind in known else []
                        error = None if frames else f"no decoder for .{r.kind}" if r.kind not in known else "no pages"
                    except Exception as problem:  # a corrupt file is a row, whatever the decoder makes of it
                        error = f"corrupt file: {type(problem).__name__}"
                out += [(r.path, i, f.shape[1], f.shape[0], np.ascontiguousarray(f).tobytes(), None) for i, f in enumerate(frames)] or [(r.path, None, None, None, None, error)]
            yield pd.DataFrame(out, columns=["path", "page_index", "width", "height", "pixels", "error"]).astype({"page_index": "Int32", "width": "Int32", "height": "Int32"})

    return guarded(files).select("path", "kind", "content", "error").mapInPandas(decode, PAGES)


class InkBoxes:
    """A stand-in for a recogniser, for tests: one detection, the box around all that isn't white."""

    def recognise(self, image: np.ndarray) -> dict:
        ys, xs = np.nonzero((image < 255).any(axis=2))
        if not len(ys):
            return {"rec_texts": [], "rec_scores": [], "rec_polys": []}
        x1, y1, x2, y2 = (int(v) for v in (xs.min(), ys.min(), xs.max() + 1, ys.max() + 1))
        return {"rec_texts": ["ink"], "rec_scores": [0.9], "rec_polys": [[[x1, y1], [x2, y1], [x2, y2], [x1, y2]]]}


def recognised(pages: DataFrame, make: Callable[[], object] = InkBoxes) -> DataFrame:
    """Lines of pages: path, page_index and pos, text, box, confidence. make gives a recogniser, an object with
    recognise(image) that replies as recognition engines do; each worker makes one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        engine = make()
        for batch in batches:
            replies = []
            for r in batch.itertuples():
                image = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, 3)
                replies.append(json.dumps(engine.recognise(np.pad(image, ((BORDER, BORDER), (BORDER, BORDER), (0, 0)), constant_values=255))))
            yield pd.DataFrame({"path": batch["path"], "page_index": batch["page_index"], "payload": replies})

    replies = pages.where("error IS NULL").select("path", "page_index", "width", "height", "pixels").mapInPandas(run, "path string, page_index int, payload string")
    return replies.select("path", "page_index", F.posexplode(payload_lines(F.col("payload"))).alias("pos", "l")).select("path", "page_index", "pos", "l.text", "l.box", "l.confidence")


def older_payload_lines(payload: Column) -> Column:
    """The same as payload_lines for the older reply, [[polygon, [text, score]], ...], with or without another list around it. In place
    of [text, score] there may be the text alone, whose score is 0."""
    outer = F.from_json(payload, "array<array<string>>")
    nested = F.from_json(payload, "array<array<array<string>>>")
    single = F.when(F.size(outer) == 1, F.get(nested, F.lit(0)))
    is_wrapped = single.isNotNull() & F.get(F.get(single, F.lit(0)), F.lit(0)).startswith("[[")
    found = F.when(is_wrapped, single).otherwise(outer)

    def line(d: Column) -> Column:
        told = F.when(d[1].startswith("["), F.from_json(d[1], "array<string>")).otherwise(F.array(d[1]))
        return F.struct(told[0].alias("text"), F.coalesce(F.get(told, F.lit(1)).try_cast("double"), F.lit(0.0)).alias("confidence"), envelope(F.from_json(d[0], "array<array<double>>")).alias("box"))

    return F.transform(found, line)
