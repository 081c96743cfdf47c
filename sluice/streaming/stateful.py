"""Keyed state on streams by transformWithState (RocksDB state store).

A processor's state is typed and survives restarts with the query's checkpoint.
The same fold serves the persistent filter, map, flat-map, reduce and sink
operators: they differ only in what a step returns.  With `time_col` they take
a key's rows in the order of their times (see ordered.py).
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Callable, Iterator
from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessorHandle

from ..time import Duration, Window, WindowType
from .ordered import AT, END_MS, OWN, ROCKSDB, Ordered, apply_ordered, sort_key, slot_of
from .typed import Chunks, decode, encode, stored


def as_type(t: str | T.DataType | None) -> T.DataType | None:
    return T._parse_datatype_string(t) if isinstance(t, str) else t


NTH = "__nth"


def own(row: dict) -> dict:
    """A row's columns, without those that stand beside them."""
    return {c: v for c, v in row.items() if c not in OWN and c != NTH}


class KeyedFold(Ordered):
    """step(row, state) -> (new state, rows to emit).

    Rows and struct states are dicts, times are UTC datetimes.  `state` is the
    state's Spark type; without one it may be any value that can be pickled.
    A key not seen before begins with `initial`.  With ttl_ms a key's state
    goes when it hasn't changed for so long.
    """

    def __init__(
        self, step: Callable[[dict, object], tuple[object, list[dict]]], initial: object, order: list[str] | None = None, ttl_ms: int | None = None,
        state: str | T.DataType | None = None, adaptive: bool = False,
    ):
        super().__init__(order, adaptive, ttl_ms)
        self.step, self.initial, self.state = step, initial, as_type(state)

    def begin(self, handle: StatefulProcessorHandle) -> None:
        kind = T.BinaryType() if self.state is None else stored(self.state)
        self.value = handle.getValueState("value", T.StructType([T.StructField("value", kind)]), self.ttl_ms)

    def load(self) -> object:
        got = self.value.get()
        if got is None:  # each key its own copy of a state that steps may change in place
            return pickle.loads(pickle.dumps(self.initial))
        return pickle.loads(got[0]) if self.state is None else decode(got[0], self.state)

    def store(self, state: object) -> None:
        self.value.update((pickle.dumps(state) if self.state is None else encode(state, self.state),))

    def taken(self, key: dict, rows: list[dict]) -> Iterator[dict]:
        state = self.load()
        for row in rows:
            state, emitted = self.step(own(row), state)
            yield from emitted
        self.store(state)


def apply_keyed(
    df: DataFrame, keys: list[str], processor: Ordered, schema: str | T.StructType, mode: str = "append", time_col: str | None = None, lateness: Duration | None = None,
) -> DataFrame:
    """The processor over a stream's keys."""
    return apply_ordered(df, keys, processor, schema, mode, time_col, lateness)


class _IntersectStep:
    """Emits a row when both sides have it: once, or as often as the rarer side."""

    def __init__(self, columns: list[str], all_copies: bool):
        self.columns, self.all_copies = columns, all_copies

    def __call__(self, row: dict, state: dict) -> tuple[dict, list[dict]]:
        left, right = state["left"] + (row["__side"] == 0), state["right"] + (row["__side"] == 1)
        due = min(left, right) if self.all_copies else min(left, right, 1)
        return {"left": left, "right": right, "sent": max(state["sent"], due)}, [{c: row[c] for c in self.columns}] * (due - state["sent"])


class Intersect:
    """Intersection of two streams with the same columns.

    `keys` are the columns that make rows equal, by default all; a row that is
    emitted is the one that completed the pair.  State stays for ever unless a
    ttl is given.
    """

    @staticmethod
    def of(left: DataFrame, right: DataFrame, all_copies: bool = False, keys: list[str] | None = None, ttl_ms: int | None = None) -> DataFrame:
        columns = left.columns
        both = left.withColumn("__side", F.lit(0)).unionByName(right.select(*columns).withColumn("__side", F.lit(1)))
        fold = KeyedFold(_IntersectStep(columns, all_copies), {"left": 0, "right": 0, "sent": 0}, columns, ttl_ms, "left bigint, right bigint, sent bigint")
        return apply_keyed(both, keys or columns, fold, _plain_schema(left))


def _plain_schema(df: DataFrame) -> T.StructType:
    """The columns' names and types, nullable, without metadata such as a watermark."""
    return T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])


# -- persistent operators: per-key state, restored after a restart -----------
# Options of all: `state`, the state's Spark type; `time_col`, `lateness`, `order`
# and `adaptive`, the order of rows; `ttl_ms`.
def _fold(df, keys, step, initial, schema, *, state=None, time_col=None, lateness=None, order=None, adaptive=False, ttl_ms=None) -> DataFrame:
    return apply_keyed(df, keys, KeyedFold(step, initial, order, ttl_ms, state, adaptive), schema, time_col=time_col, lateness=lateness)


def p_filter(df: DataFrame, keys: list[str], keep: Callable[[dict, object], tuple[bool, object]], initial: object, **options) -> DataFrame:
    """Rows for which keep(row, state) -> (keep it?, new state) is true."""
    def step(row: dict, state: object) -> tuple[object, list[dict]]:
        ok, state = keep(row, state)
        return state, [row] if ok else []

    return _fold(df, keys, step, initial, _plain_schema(df), **options)


def p_map(df: DataFrame, keys: list[str], func: Callable[[dict, object], tuple[dict, object]], initial: object, schema: str, **options) -> DataFrame:
    """func(row, state) -> (one row, new state)."""
    def step(row: dict, state: object) -> tuple[object, list[dict]]:
        out, state = func(row, state)
        return state, [out]

    return _fold(df, keys, step, initial, schema, **options)


def p_flat_map(df: DataFrame, keys: list[str], func: Callable[[dict, object], tuple[list[dict], object]], initial: object, schema: str, **options) -> DataFrame:
    """func(row, state) -> (any rows, new state)."""
    def step(row: dict, state: object) -> tuple[object, list[dict]]:
        out, state = func(row, state)
        return state, out

    return _fold(df, keys, step, initial, schema, **options)


def p_reduce(df: DataFrame, keys: list[str], func: Callable[[dict, dict], dict], initial: dict, schema: str, **options) -> DataFrame:
    """The state after each row, with the keys; the schema's other fields are the state."""
    def step(row: dict, state: dict) -> tuple[dict, list[dict]]:
        state = func(row, state)
        return state, [{**{k: row[k] for k in keys}, **state}]

    fields = [f for f in T.StructType.fromDDL(schema).fields if f.name not in keys]
    return _fold(df, keys, step, initial, schema, **{"state": T.StructType(fields)} | options)


def p_sink(df: DataFrame, keys: list[str], func: Callable[[dict, object], object], initial: object, checkpoint: str, name: str | None = None, **options):
    """Runs func(row, state) -> new state for its effects; the query emits nothing."""
    def step(row: dict, state: object) -> tuple[object, list[dict]]:
        return func(row, state), []

    out = _fold(df, keys, step, initial, _plain_schema(df.select(*(f"`{k}`" for k in keys))), **options)
    writer = out.writeStream.format("noop").option("checkpointLocation", checkpoint)
    return (writer.queryName(name) if name else writer).start()


# -- windows with logic of the user's ------------------------------------------
class _Windows(Ordered):
    """Either whole windows, whose rows are kept by pane, each once; or a state for each open window.

    `passed_by` is the position up to which windows have been given.
    """

    def __init__(self, window: Window, func, step, initial: dict, state: T.StructType, order: list[str] | None, adaptive: bool):
        super().__init__(order, adaptive)
        self.size, self.slide = window.size, window.slide
        self.func, self.step, self.initial, self.state = func, step, initial, state
        self.pane = gcd(self.size, self.slide)

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.passed_by = handle.getValueState("passed", "n bigint")
        if self.func is not None:
            self.panes = Chunks(handle, "panes", T.StructType([*self.row.fields, T.StructField(NTH, T.LongType())]))
        else:
            self.open = handle.getMapState("open", "window bigint", T.StructType([T.StructField("state", stored(self.state))]))

    def windows_of(self, position: int) -> range:
        """Windows that hold a position; none in a gap."""
        return range(max(0, (position - self.size) // self.slide + 1), position // self.slide + 1)

    def end(self, window: int) -> int:
        return window * self.slide + self.size

    def first_after(self, position: int) -> int:
        """The first window that ends beyond a position."""
        return max(0, (position - self.size) // self.slide + 1)

    def so_far(self) -> int:
        got = self.passed_by.get()
        return got[0] if got else 0

    def given(self, key: dict, window: int, rows: list[dict]) -> dict:
        return {**key, "window_id": window, **self.func([own(r) for r in rows])}

    def keep(self, rows: list[dict], passed: int) -> set[int]:
        """Adds rows to their panes, but for those that no window beyond `passed` holds."""
        panes: dict[int, list[dict]] = {}
        for row in rows:
            of = self.windows_of(row[NTH])
            if of and self.end(of[-1]) > passed:
                panes.setdefault(row[NTH] // self.pane, []).append(row)
        for pane, some in panes.items():
            self.panes.add(pane, some)
        return set(panes)

    def forget(self, passed: int) -> list[int]:
        """Drops the panes that no window beyond `passed` holds; the others."""
        left = []
        for pane in self.panes.slots():
            if self.end(self.windows_of(pane * self.pane)[-1]) <= passed:
                self.panes.remove(pane)
            else:
                left.append(pane)
        return left

    def step_all(self, rows: list[dict], states: dict[int, dict], passed: int) -> None:
        """Takes rows into the states of their windows beyond `passed`."""
        for row in rows:
            nth = row[NTH]
            row = own(row)
            for k in self.windows_of(nth):
                if self.end(k) > passed:
                    states[k] = self.step(row, states[k] if k in states else dict(self.initial))


class _CountWindows(_Windows):
    """By a row's number within its key."""

    def taken(self, key: dict, rows: list[dict]) -> Iterator[dict]:
        n = self.so_far()
        for i, row in enumerate(rows):
            row[NTH] = n + i
        done = n + len(rows)
        due = range(self.first_after(n), self.first_after(done))
        if self.func is not None:
            if due:
                held = [r for pane in self.panes.slots() for r in self.panes.get(pane)] + rows
                numbers = [r[NTH] for r in held]
                for k in due:
                    yield self.given(key, k, held[bisect_left(numbers, k * self.slide) : bisect_left(numbers, self.end(k))])
            self.keep(rows, done)
            if due:
                self.forget(done)
        else:
            states = {k[0]: decode(v[0], self.state) for k, v in self.open.iterator()}
            before = set(states)
            self.step_all(rows, states, 0)
            for k in due:
                yield {**key, "window_id": k, **states.pop(k)}
            for k in before - states.keys():
                self.open.removeKey((k,))
            for k, state in states.items():
                self.open.updateValue((k,), (encode(state, self.state),))
        self.passed_by.update((done,))


class _TimeWindows(_Windows):
    """By time: windows are given when the watermark has passed their ends.

    Whole windows need no order before they close, so their rows go to their
    panes at once; states take rows in order.
    """

    def __init__(self, *a, baseline: int):
        super().__init__(*a)
        self.baseline = baseline

    def numbered(self, rows: list[dict]) -> list[dict]:
        for row in rows:
            row[NTH] = max((row[AT] or 0) - self.baseline, 0)
        return rows

    def watch(self, window: int) -> None:
        if not self.adaptive:
            self.handle.registerTimer(slot_of(self.end(window) + self.baseline))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        if self.func is None or self.adaptive:
            yield from super().handleInputRows(key, rows, timerValues)
            return
        passed = self.so_far()
        for pane in self.keep(self.numbered(self._rows(rows)), passed):
            self.watch(max(self.windows_of(pane * self.pane)[0], self.first_after(passed)))

    def taken(self, key: dict, rows: list[dict]) -> Iterator[dict]:
        passed = self.so_far()
        self.numbered(rows)
        if self.func is not None:
            self.keep(rows, passed)
        else:
            wanted = {k for r in rows for k in self.windows_of(r[NTH]) if self.end(k) > passed}
            states = {k: decode(got[0], self.state) for k in wanted if (got := self.open.getValue((k,)))}
            for k in wanted - states.keys():
                self.watch(k)
            self.step_all(rows, states, passed)
            for k, state in states.items():
                self.open.updateValue((k,), (encode(state, self.state),))
        return iter(())

    def passed(self, key: dict, watermark: int) -> Iterator[dict]:
        before, now = self.so_far(), watermark * 1000 - self.baseline
        if now <= before:
            return
        if self.func is None:
            for k in sorted(k[0] for k in self.open.keys()):
                if self.end(k) <= now:
                    yield {**key, "window_id": k, **decode(self.open.getValue((k,))[0], self.state)}
                    self.open.removeKey((k,))
        else:
            last, slots = self.first_after(now), self.panes.slots()
            due = sorted({k for pane in slots for k in self.windows_of(pane * self.pane) if self.first_after(before) <= k < last})
            held = {pane: sorted(self.panes.get(pane), key=lambda r: (r[AT] or 0, sort_key(r, self.order))) for pane in slots} if due else {}
            for k in due:
                lo, hi = k * self.slide // self.pane, self.end(k) // self.pane
                yield self.given(key, k, [r for pane in slots[bisect_left(slots, lo) : bisect_left(slots, hi)] for r in held[pane]])
            left = self.forget(now)
            if left:
                self.watch(max(self.windows_of(left[0] * self.pane)[0], self.first_after(now)))
        self.passed_by.update((now,))


def p_keyed_windows(
    df: DataFrame, keys: list[str], window: Window, schema: str, *, func: Callable[[list[dict]], dict] | None = None,
    step: Callable[[dict, dict], dict] | None = None, initial: dict | None = None, time_col: str | None = None, baseline: int = 0,
    order: list[str] | None = None, lateness: Duration | None = None, adaptive: bool = False,
) -> DataFrame:
    """Windows of a stream's keys with logic of the user's, kept in the state store.

    Either func(rows) -> fields on a window's rows, each of which the state
    keeps once until its last window has been given, or step(row, state) ->
    state, of which it keeps one a window.  Rows are dicts.  `schema` has the
    keys, window_id long, and the fields, which are the state's too.  Count
    windows are given when they are full, and count rows by time and `order` if
    there is a time column, else as they come.  Time windows are given when the
    watermark, `lateness` behind the stream's latest time, has passed their end:
    a key without further rows is closed by the others', and the end of a
    stream (run_available) closes all.  Rows behind the watermark are late.
    """
    if (func is None) == (step is None):
        raise ValueError("give either func or step")
    if window.kind is WindowType.TIME and time_col is None:
        raise ValueError("time windows need a time column")
    state = T.StructType([f for f in T.StructType.fromDDL(schema).fields if f.name not in (*keys, "window_id")])
    parts = (window, func, step, initial or {}, state, order, adaptive)
    processor = _TimeWindows(*parts, baseline=baseline) if window.kind is WindowType.TIME else _CountWindows(*parts)
    return apply_keyed(df, keys, processor, schema, time_col=time_col, lateness=lateness)


__all__ = ["END_MS", "ROCKSDB", "Intersect", "KeyedFold", "apply_keyed", "p_filter", "p_flat_map", "p_keyed_windows", "p_map", "p_reduce", "p_sink"]
