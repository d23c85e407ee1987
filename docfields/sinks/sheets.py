"""Workbooks (.xlsx) of result rows, written with the standard library: all rows and the incomplete ones.

Rows are dealt by their file_name to the books of a folder that driver and executors share. Each book is
written, appended to and read by one task, which streams its rows; none pass through the driver. A sheet
that is full goes on in another one.
"""

from __future__ import annotations

import contextlib
import io
import re
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice
from xml.sax.saxutils import escape, unescape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfields.functions import lexicon as lx
from docfields.operators import results

#: Names of the sheets; rows that a sheet can hold.
RESULTS_SHEET, INCOMPLETE_SHEET = "Résultats", "Extractions Incomplètes"
SHEET_ROWS = 1_048_576
#: Rows that a new book is meant for.
BOOK_ROWS = 50_000
COLUMNS = (*lx.FIELDS, "confidence_text", "file_name", "engine")

_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{}</Types>'
_SHEET_TYPE = '<Override PartName="/xl/worksheets/sheet{}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
_REL = '<Relationship Id="rId{}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{}" Target="{}"/>'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def _cells(mark_missing: bool) -> list:
    """COLUMNS of result rows as text."""
    made = {"file_name": F.col("file_name")} | dict(zip((c for c in COLUMNS if c != "file_name"), results.export_cells(mark_missing), strict=True))
    return [made[c].alias(c) for c in COLUMNS]


def _row(n: int, values: Iterable[str | None]) -> bytes:
    texts = "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v or "")}</t></is></c>' for v in values)
    return f'<row r="{n}">{texts}</row>'.encode()


def write(file, sheets: Iterable[tuple[str, Iterable[tuple]]]) -> None:
    """A workbook with a sheet of rows for each name; rows are taken one by one."""
    names: list[str] = []
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as book:
        for name, rows in sheets:
            source, n, part = iter(rows), 0, 0
            pending = next(source, None)
            while part == 0 or pending is not None:
                part += 1
                names.append(name if part == 1 else f"{name} ({part})")
                with book.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True) as out:
                    out.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetData>'.encode())
                    n = 0
                    while pending is not None and n < SHEET_ROWS:
                        n += 1
                        out.write(_row(n, pending))
                        pending = next(source, None)
                    out.write(b"</sheetData></worksheet>")
        ids = range(1, len(names) + 1)
        listed = "".join(f'<sheet name="{escape(s, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, s in zip(ids, names, strict=True))
        book.writestr("[Content_Types].xml", _TYPES.format("".join(map(_SHEET_TYPE.format, ids))))
        book.writestr("_rels/.rels", _RELS.format(_REL.format(1, "officeDocument", "xl/workbook.xml")))
        book.writestr("xl/_rels/workbook.xml.rels", _RELS.format("".join(_REL.format(i, "worksheet", f"worksheets/sheet{i}.xml") for i in ids)))
        book.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_MAIN}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{listed}</sheets></workbook>')


def books(folder: str) -> list[str]:
    """The paths of a folder's workbooks, in order."""
    store, base = fs.FileSystem.from_uri(folder)
    return sorted(f"{folder}/{f.base_name}" for f in store.get_file_info(fs.FileSelector(base)) if f.extension == "xlsx")


@contextlib.contextmanager
def _opened(path: str) -> Iterator[zipfile.ZipFile]:
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as file, zipfile.ZipFile(file) as book:
        yield book


def sheet_names(path: str) -> list[str]:
    """Names of a workbook's sheets, in order."""
    with _opened(path) as book:
        return [unescape(n, {"&quot;": '"'}) for n in re.findall(r'<sheet name="([^"]*)"', book.read("xl/workbook.xml").decode())]


def find_sheet(path: str, name: str) -> str | None:
    """The first sheet of that name, whatever its letters' case."""
    return next((n for n in sheet_names(path) if n.casefold() == name.casefold()), None)


def _places(names: list[str]) -> dict[str, list[int]]:
    """The places (from 1) of each sheet and of those that it goes on in."""
    found: dict[str, list[int]] = {}
    for i, name in enumerate(names, 1):
        first = re.sub(r" \(\d+\)$", "", name)
        goes_on = first in found and name == f"{first} ({len(found[first]) + 1})"
        found.setdefault(first if goes_on else name, []).append(i)
    return found


def read(path: str, name: str) -> Iterator[tuple[str, ...]]:
    """Rows of a sheet as text, header included, and of those that it goes on in, read as they are needed."""
    with _opened(path) as book:
        for place in _places(sheet_names(path))[name]:
            with book.open(f"xl/worksheets/sheet{place}.xml") as raw:
                text, held = io.TextIOWrapper(raw, "utf-8"), ""
                while piece := text.read(1 << 16):
                    held += piece
                    *rows, held = held.split("</row>")
                    for row in rows:
                        yield tuple(unescape(v) for v in re.findall(r"<t[^>]*>(.*?)</t>", row, re.S))


def _kept(path: str, make: Callable) -> None:
    """The file that make writes, at path once it is whole, so that a task that is run again does no harm."""
    store, at = fs.FileSystem.from_uri(path)
    folder, _, name = at.rpartition("/")
    store.create_dir(folder, recursive=True)
    whole = f"{folder}/_{uuid.uuid4().hex}"
    with store.open_output_stream(whole, compression=None) as out:
        make(out)
    with contextlib.suppress(FileNotFoundError):
        store.delete_file(at)
    store.move(whole, at)


def _by_book(batches: Iterable[pa.RecordBatch], make: Callable[[int, Callable[[int], Iterator[tuple]]], None]) -> Iterator[int]:
    """Calls make for each book of rows in order of (book, sheet), with a function that gives the rows of one of its sheets."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    head = next(rows, None)
    while head is not None:
        n, held = head[0], {}

        def own(sheet: int) -> Iterator[tuple]:
            nonlocal head
            yield from held.pop(sheet, ())
            while head is not None and head[0] == n and head[1] <= sheet:
                at, row = head[1], head[2:]
                head = next(rows, None)
                if at == sheet:
                    yield row
                else:
                    held.setdefault(at, []).append(row)  # only where a book has its sheets in another order

        make(n, own)
        yield n


def _dealt(rows: DataFrame, n: int, mark_missing: bool) -> DataFrame:
    """book, sheet (0: all rows, 1: the incomplete ones), COLUMNS: the rows of n books, each in one partition, in order. Sheet -1
    has a row for each book, so that those without rows are made too."""
    every = rows.select("is_incomplete", F.struct(*_cells(mark_missing)).alias("a"), F.struct(*_cells(False)).alias("b"))
    book = F.pmod(F.xxhash64("a.file_name"), F.lit(n)).cast("int")
    parts = F.array(F.struct(F.lit(0).alias("sheet"), F.col("a").alias("c")), F.when(F.col("is_incomplete"), F.struct(F.lit(1).alias("sheet"), F.col("b").alias("c"))))
    own = every.select(book.alias("book"), F.explode(F.array_compact(parts)).alias("p")).select("book", "p.sheet", *[f"p.c.{c}" for c in COLUMNS])
    each = rows.sparkSession.range(n).select(F.col("id").cast("int").alias("book"), F.lit(-1).alias("sheet"), *[F.lit(None).cast("string").alias(c) for c in COLUMNS])
    return own.unionByName(each).repartitionById(n, F.col("book")).sortWithinPartitions("book", "sheet", "file_name")


def _make(rows: DataFrame, n: int, mark_missing: bool, make: Callable[[int, Callable[[int], Iterator[tuple]]], None]) -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(list(_by_book(batches, make)), pa.int32())], names=["book"])

    made = _dealt(rows, n, mark_missing).mapInArrow(run, "book int").count()
    if made != n:
        raise ValueError(f"{made} of {n} books were made")


def export(rows: DataFrame, folder: str, *, mark_missing: bool = False, n: int | None = None) -> None:
    """New workbooks of result rows (the fields, confidence, file_name, engine_used, has_error, is_incomplete) in a new folder:
    all of them, and the incomplete ones again in a sheet of their own. n: how many, else one for each BOOK_ROWS rows."""
    n = n or max(1, -(-rows.count() // BOOK_ROWS))

    def make(book: int, own: Callable[[int], Iterator[tuple]]) -> None:
        _kept(f"{folder}/book-{book:06d}.xlsx", lambda out: write(out, ((name, chain([COLUMNS], own(i))) for i, name in enumerate((RESULTS_SHEET, INCOMPLETE_SHEET)))))

    _make(rows, n, mark_missing, make)


def append(rows: DataFrame, folder: str, target: str, *, sheet: str | None = None, mark_missing: bool = False) -> None:
    """The workbooks of a folder with rows added behind the last row of their sheets, as new files in target. Rows go to the
    books that export would give them. Sheets are found whatever their letters' case and made where they are missing; others stay."""
    paths = books(folder)

    def make(book: int, own: Callable[[int], Iterator[tuple]]) -> None:
        path = paths[book]
        more = {(sheet or RESULTS_SHEET).casefold(): (sheet or RESULTS_SHEET, 0), INCOMPLETE_SHEET.casefold(): (INCOMPLETE_SHEET, 1)}

        def sheets() -> Iterator[tuple[str, Iterable[tuple]]]:
            for name in _places(sheet_names(path)):
                found = more.pop(name.casefold(), None)
                yield name, chain(read(path, name), own(found[1]) if found else ())
            for name, i in more.values():
                yield name, chain([COLUMNS], own(i))

        _kept(f"{target}/{path.rpartition('/')[2]}", lambda out: write(out, sheets()))

    _make(rows, len(paths), mark_missing, make)


def frame(spark: SparkSession, folder: str, name: str, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """Columns, as text, of the rows below the header of that sheet, whatever its letters' case, of all workbooks in the folder."""
    schema = pa.schema([(c, pa.string()) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in chain.from_iterable(b.column(0).to_pylist() for b in batches):
            if (own := find_sheet(path, name)) is None:
                continue
            rows = read(path, own)
            header = next(rows)
            places = [header.index(c) for c in columns]
            while some := list(islice(rows, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], pa.string()) for i in places], schema=schema)

    paths = books(folder)
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return listed.mapInArrow(run, ", ".join(f"`{c}` string" for c in columns))
