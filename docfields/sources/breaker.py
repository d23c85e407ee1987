"""Routing as a machine over a batch's files: a provider that fails for good is closed, and isn't called for later files.

Files of a batch are taken in their order, each batch in one task and as a stream of rows, whatever its number of
files; that order is what the rule is about, so a batch can't be split. Providers are called only while open, so a task that
is run again calls again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docfields.sources.providers import OK, PERMANENT

#: A function of a file's row that gives a status and a text (fields, or what went wrong).
Ask = Callable[[dict], tuple[int, str]]
OUT = "answered_by string, has_error boolean, reply string, primary_called boolean, secondary_called boolean"
STATE = "primary_closed string, secondary_closed string"


@dataclass
class Breaker:
    """The two providers of one batch, and why each is closed (None while it is open)."""

    primary: Ask
    secondary: Ask
    primary_closed: str | None = None
    secondary_closed: str | None = None

    def _ask(self, ask: Ask, row: dict) -> tuple[int, str]:
        try:
            return ask(row)
        except Exception as problem:  # a file's failure is its row's
            return 0, f"{type(problem).__name__}: {problem}"

    def route(self, row: dict) -> tuple[str, bool, str | None, bool, bool]:
        """answered_by, has_error, reply, and whether either provider was called. The engine asked for is auto, primary,
        secondary or ocr (any other counts as that); flags that are null count as false."""
        engine, first, second = row["engine"], row["has_primary"] is True, row["has_secondary"] is True
        if engine == "secondary" and second:
            if self.secondary_closed is not None:
                return "secondary", True, self.secondary_closed, False, False
            code, reply = self._ask(self.secondary, row)
            if code in PERMANENT:
                self.secondary_closed = reply
            return "secondary", code != OK, reply, False, True
        if first and engine in ("auto", "primary") and self.primary_closed is None:
            code, reply = self._ask(self.primary, row)
            if code == OK or code not in PERMANENT:
                return "primary", code != OK, reply, True, False
            self.primary_closed = reply
            if engine == "primary":
                return "primary", True, reply, True, False
            called = second and self.secondary_closed is None
            if called:
                code, reply = self._ask(self.secondary, row)
                if code == OK:
                    return "secondary", False, reply, True, True
                if code in PERMANENT:
                    self.secondary_closed = reply
            return "ocr", False, None, True, called
        if engine == "auto" and second and self.secondary_closed is None:
            # a failure of the second provider in first place leads to the recogniser, and doesn't close it
            code, reply = self._ask(self.secondary, row)
            return ("secondary", False, reply, False, True) if code == OK else ("ocr", False, None, False, True)
        return "ocr", False, None, False, False


def _schema(files: DataFrame, keep: tuple[str, ...]) -> T.StructType:
    return T.StructType([*[files.schema[c] for c in keep], *T._parse_datatype_string(OUT).fields])


def _routed(rows: pd.DataFrame, breaker: Breaker, keep: tuple[str, ...]) -> list[tuple]:
    plain = rows.astype(object).where(rows.notna(), None)
    return [(*[row[c] for c in keep], *breaker.route(row)) for row in plain.to_dict("records")]


def route_in_order(files: DataFrame, primary: Ask, secondary: Ask, keep: tuple[str, ...] = ("batch", "place")) -> DataFrame:
    """Routes files (batch, place, engine, has_primary, has_secondary and what providers read) batch by batch, in order of place (of
    files that share one, in any order; null first). Returns the columns keep and OUT, a row per file. Null is a batch."""
    dealt = files.repartition("batch").sortWithinPartitions("batch", "place")
    schema = _schema(files, keep)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, breaker = object(), Breaker(primary, secondary)
        for frame in frames:
            out = []
            for batch, rows in frame.groupby("batch", sort=False, dropna=False):
                batch = None if pd.isna(batch) else batch
                if batch != now:
                    now, breaker = batch, Breaker(primary, secondary)
                out += _routed(rows, breaker, keep)
            yield pd.DataFrame(out, columns=schema.names)

    return dealt.mapInPandas(run, schema)


def route_stream(files: DataFrame, primary: Ask, secondary: Ask, keep: tuple[str, ...] = ("batch", "place")) -> DataFrame:
    """The same for a streaming DataFrame: files are taken in order of place within what arrives at a time, and what is closed stays
    closed for files of the batch that arrive later, also after a restart. Files of one batch that arrive together are held by a task."""

    schema = _schema(files, keep)

    def run(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        breaker = Breaker(primary, secondary, *(state.get if state.exists else (None, None)))
        rows = pd.concat(list(frames)).sort_values("place", kind="stable", na_position="first")
        out = _routed(rows, breaker, keep)
        state.update((breaker.primary_closed, breaker.secondary_closed))
        yield pd.DataFrame(out, columns=schema.names)

    return files.groupBy("batch").applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.NoTimeout)
