"""Count windows and running aggregates of a stream's keys, in the state store.

Both are made from the same parts as on batches (COUNT, SUM, MIN and MAX, and
AVG from two of them): each row brings its own value of every part, made by
Spark, and the processors add them up; missing values add nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessorHandle

from ..operators import EVENT_TIME
from ..operators.aggregates import Part
from ..operators.windows import WINDOW_ID
from ..time import Duration, Window
from .ordered import Ordered, apply_ordered
from .typed import decode, encode, stored

#: A row's own values of the parts, in this struct.
LIFTED = "__lifted"


def combine(kind: str, a: object, b: object) -> object:
    """SUM, MIN or MAX of two values, either of which may be missing; NaN is the largest."""
    if a is None or b is None:
        return b if a is None else a
    if kind == "sum":
        return a + b
    if a != a or b != b:
        rest = b if a != a else a
        return rest if kind == "min" else float("nan")
    return min(a, b) if kind == "min" else max(a, b)


class _Parts(Ordered):
    def __init__(self, parts: list[Part], kinds: list[T.DataType], order: list[str] | None, adaptive: bool, time: str | None):
        super().__init__(order, adaptive)
        self.combines, self.parts, self.time = [p.combine for p in parts], [p.name for p in parts], time
        fields = [T.StructField(n, t) for n, t in zip(self.parts, kinds)]
        self.total = T.StructType([*fields, T.StructField(EVENT_TIME, T.TimestampType())])

    def lifted(self, row: dict) -> list:
        """The parts of one row, and its time."""
        own = row[LIFTED]
        return [own[n] for n in self.parts] + [row[self.time] if self.time else None]

    def added(self, a: list, b: list) -> list:
        out = [combine(c, x, y) for c, x, y in zip(self.combines, a, b)]
        return [*out, combine("max", a[-1], b[-1])]

    def shown(self, key: dict, total: list) -> dict:
        return {**key, **dict(zip(self.total.names, total))}


class _Running(_Parts):
    """The parts after each row."""

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("total", stored(self.total))

    def taken(self, key: dict, rows: list[dict]) -> Iterator[dict]:
        got = self.state.get()
        total = list(decode(got, self.total).values()) if got else None
        for row in rows:
            own = self.lifted(row)
            total = own if total is None else [*self.added(total, own)[:-1], own[-1]]
            yield self.shown(key, total)
        if total is not None:
            self.state.update(encode(tuple(total), self.total))


class _CountParts(_Parts):
    """Full count windows from panes of gcd(size, slide) rows; the rest at the stream's end.

    The state is a number and the panes of the windows that are open, however
    many rows they hold; a batch writes the panes that it changes.
    """

    has_end = True

    def __init__(self, window: Window, *a):
        super().__init__(*a)
        self.size, self.slide = window.size, window.slide
        self.pane = gcd(self.size, self.slide)

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.n = handle.getValueState("n", "n bigint")
        self.panes = handle.getMapState("panes", "pane bigint", stored(self.total))

    def _open(self) -> dict[int, list]:
        return {k[0]: list(decode(v, self.total).values()) for k, v in self.panes.iterator()}

    def _window(self, k: int, panes: dict[int, list]) -> list | None:
        total = None
        for pane in range(k * self.slide // self.pane, (k * self.slide + self.size) // self.pane):
            if pane in panes:
                total = panes[pane] if total is None else self.added(total, panes[pane])
        return total

    def taken(self, key: dict, rows: list[dict]) -> Iterator[dict]:
        got = self.n.get()
        n, panes = got[0] if got else 0, self._open()
        before, changed = set(panes), set()
        for row in rows:
            pane = n // self.pane
            panes[pane] = self.added(panes[pane], self.lifted(row)) if pane in panes else self.lifted(row)
            changed.add(pane)
            n += 1
            if n >= self.size and (n - self.size) % self.slide == 0:
                k = (n - self.size) // self.slide
                yield self.shown(key, self._window(k, panes)) | {WINDOW_ID: k}
                for pane in [p for p in panes if p < (k + 1) * self.slide // self.pane]:
                    del panes[pane]
        for pane in before - panes.keys():
            self.panes.removeKey((pane,))
        for pane in changed & panes.keys():
            self.panes.updateValue((pane,), encode(tuple(panes[pane]), self.total))
        self.n.update((n,))

    def ended(self, key: dict) -> Iterator[dict]:
        got = self.n.get()
        n, panes = got[0] if got else 0, self._open()
        for k in range(max(0, (n - self.size) // self.slide + 1), (n - 1) // self.slide + 1):
            total = self._window(k, panes)
            if total is not None and n > k * self.slide:
                yield self.shown(key, total) | {WINDOW_ID: k}
        self.panes.clear()


def _applied(df: DataFrame, keys: list[str], parts: list[Part], processor, order, time_col, lateness, adaptive, *more: str) -> DataFrame:
    """Keys, parts, event time, and further whole numbers that the processor gives."""
    if missing := [p.name for p in parts if p.row is None]:
        raise ValueError(f"parts {missing} don't say what a single row's value is")
    by = [f"`{k}`" for k in keys]
    # sums widen as Spark's own do
    kinds = [f.dataType for f in df.sparkSession.createDataFrame([], df.schema).agg(*(p.from_rows.alias(p.name) for p in parts)).schema.fields] if parts else []
    own = F.struct(*(p.row.cast(t).alias(p.name) for p, t in zip(parts, kinds))) if parts else F.struct(F.lit(1).alias("none"))
    time = time_col or (EVENT_TIME if EVENT_TIME in df.columns else None)
    sources = dict.fromkeys([*keys, *order, *([time] if time else [])])
    rows = df.select(*(f"`{c}`" for c in sources), own.alias(LIFTED))
    made = processor(parts, kinds, order, adaptive, time)
    schema = T.StructType([*(T.StructField(k, df.schema[k].dataType) for k in keys), *made.total.fields, *(T.StructField(c, T.LongType()) for c in more)])
    return apply_ordered(rows, keys, made, schema, time_col=time_col, lateness=lateness).select(*by, *(f"`{p.name}`" for p in parts), EVENT_TIME, *more)


def stream_count_windows(
    df: DataFrame, keys: list[str], window: Window, parts: list[Part], order: list[str], time_col: str | None = None, lateness: Duration | None = None, adaptive: bool = False,
) -> DataFrame:
    """Parts by key and full count window, with its number and latest time; rows count by time and `order`, or as they come.

    The end of a stream that waits for times gives the windows that are not full, as on batches.
    """
    return _applied(df, keys, parts, lambda *a: _CountParts(window, *a), order, time_col, lateness, adaptive, WINDOW_ID)


def stream_running(
    df: DataFrame, keys: list[str], parts: list[Part], order: list[str], time_col: str | None = None, lateness: Duration | None = None, adaptive: bool = False,
) -> DataFrame:
    """Parts over the rows of the key so far, for every row."""
    return _applied(df, keys, parts, _Running, order, time_col, lateness, adaptive)


class CountWindows:
    """Full count windows of a stream by key, over one numeric column; null values count as rows only.

    Table.group_by(window=...) takes any aggregates and columns.
    """

    @staticmethod
    def of(df: DataFrame, keys: list[str], value: str, size: int, slide: int | None = None, order: list[str] | None = None, time_col: str | None = None, lateness: Duration | None = None) -> DataFrame:
        x = F.col(f"`{value}`")
        parts = [
            Part("count", F.count(F.lit(1)), "sum", F.lit(1)), Part("sum", F.sum(x), "sum", x),
            Part("min", F.min(x), "min", x), Part("max", F.max(x), "max", x),
        ]
        return stream_count_windows(df, keys, Window.createCBWindow(size, slide), parts, order or [], time_col, lateness).drop(EVENT_TIME).withColumnRenamed(WINDOW_ID, "window_id")
