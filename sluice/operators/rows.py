"""Building blocks below the relational API, on plain DataFrames.

Functions on rows run as Arrow-batched pandas code; whatever can be said as
columns should be, and most of these take columns as well.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce as _fold
from math import gcd

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..time import Window
from . import EVENT_TIME
from .aggregates import Part
from .ranks import planned_bytes, with_index
from .windows import POSITION, WINDOW_ID, assign, each, windows_from_panes, with_position

Frame = pd.DataFrame


def map_rows(df: DataFrame, func: Callable[[Frame], Frame] | dict[str, Column], schema: str | None = None) -> DataFrame:
    """One row for each row: named columns, or a function on pandas batches."""
    if isinstance(func, dict):
        return df.select(*(c.alias(n) for n, c in func.items()))

    def run(batches: Iterator[Frame]) -> Iterator[Frame]:
        for batch in batches:
            out = func(batch)
            if len(out) != len(batch):
                raise ValueError("a map gives one row for each row; use flat_map")
            yield out

    return df.mapInPandas(run, schema)


def filter_rows(df: DataFrame, func: Callable[[Frame], pd.Series] | Column) -> DataFrame:
    """Rows where a column, or a function on pandas batches, is true."""
    if isinstance(func, Column):
        return df.where(func)

    def run(batches: Iterator[Frame]) -> Iterator[Frame]:
        for batch in batches:
            yield batch[func(batch).astype(bool)]

    return df.mapInPandas(run, df.schema)


def flat_map(df: DataFrame, func: Callable[[Frame], Frame] | Column, schema: str | None = None, name: str = "value") -> DataFrame:
    """Any number of rows for each row: an array column's elements, or a function on batches."""
    if isinstance(func, Column):
        return df.select("*", F.explode(func).alias(name))
    return df.mapInPandas(lambda batches: (func(b) for b in batches), schema)


def _folded(df: DataFrame, keys: list[str], step: Callable[[dict, dict], dict], initial: dict, schema: str, every: bool) -> DataFrame:
    """Folds rows that are sorted by key: the state after each row, or after the last of each key."""
    names, columns = T.StructType.fromDDL(schema).names, df.columns

    def run(batches: Iterator[Frame]) -> Iterator[Frame]:
        last, state, row = None, dict(initial), None
        for batch in batches:
            out = []
            for values in batch[columns].itertuples(index=False, name=None):
                before, row = row, dict(zip(columns, values))
                # a null key arrives as a value that isn't equal to itself
                key = tuple(None if pd.isna(row[k]) else row[k] for k in keys)
                if key != last:
                    if not every and last is not None:
                        out.append({**{k: before[k] for k in keys}, **state})
                    last, state = key, dict(initial)
                state = step(row, state)
                if every:
                    out.append({**{k: row[k] for k in keys}, **state})
            yield pd.DataFrame(out, columns=names)
        if not every and row is not None:
            yield pd.DataFrame([{**{k: row[k] for k in keys}, **state}], columns=names)

    return df.mapInPandas(run, schema)


def reduce_rows(df: DataFrame, keys: list[str], order: list[str], step: Callable[[dict, dict], dict], initial: dict, schema: str) -> DataFrame:
    """Rolling fold by key: the state after each row, which begins as `initial`.

    `step(row, state)` returns the new state.  Null keys are one key.  Rows of a
    key are folded in order by one task, batch after batch (without keys: all
    rows, as each state needs the one before), so a fold that can be said as
    COUNT, SUM, MIN or MAX should use ranks.with_running, which splits keys.
    """
    # sorted within partitions that hold whole keys: state never spans tasks
    dealt = df.repartition(*keys) if keys else df.coalesce(1)
    return _folded(dealt.sortWithinPartitions(*keys, *order), keys, step, initial, schema, True)


def split(df: DataFrame, route: Column, n: int, keep: bool = False) -> list[DataFrame]:
    """n branches: `route` is a branch number or an array of them (empty: no branch).

    A number outside 0..n-1 is an error of the query that meets it.  Each
    branch runs what stands before it; with `keep` that is done once, and its
    rows stay in the executors' memory and disks (lost ones are made again).
    """
    kind = df.select(route.alias("r")).schema["r"].dataType.typeName()
    routes = route if kind == "array" else F.array(route)
    outside = F.exists(routes, lambda i: (i < 0) | (i >= n))
    checked = df.withColumn("__route", F.when(outside, F.raise_error(F.lit(f"branch outside 0..{n - 1}"))).otherwise(routes))
    if keep and not df.isStreaming:
        checked = checked.persist(StorageLevel.MEMORY_AND_DISK)
    return [checked.where(F.array_contains("__route", i)).drop("__route") for i in range(n)]


def merge(*branches: DataFrame) -> DataFrame:
    """All rows of branches with the same columns."""
    return _fold(lambda a, b: a.unionByName(b), branches)


def route_forward(df: DataFrame, n: int) -> DataFrame:
    """Any of n partitions, without moving more rows than needed."""
    return df.coalesce(n)


def route_by_key(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(*keys)


def route_rebalance(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n)


#: Bytes up to which a side is sent whole to every task.
BROADCAST_BYTES = 32 << 20


def route_broadcast(df: DataFrame, largest: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a side for all tasks if its planned size is at most `largest`, else leaves it."""
    return F.broadcast(df) if planned_bytes(df) <= largest else df


def with_storage(df: DataFrame, func: Callable[[Frame, dict, dict], Frame], schema: str) -> DataFrame:
    """func(batch, storage, context) on pandas batches.

    `storage` is a dict that lives as long as the task, `context` tells its
    partition and attempt and, where df has event times, the latest one so far
    (`timestamp`) and that of the batches before (`watermark`).  A task that is repeated begins with an empty
    storage, so results must not depend on what other tasks stored.
    """

    def run(batches: Iterator[Frame]) -> Iterator[Frame]:
        from pyspark import TaskContext

        task = TaskContext.get()
        context = {"partition": task.partitionId(), "attempt": task.attemptNumber()}
        storage: dict = {}
        context["timestamp"] = context["watermark"] = None
        for batch in batches:
            context["watermark"] = context["timestamp"]
            latest = batch[EVENT_TIME].max() if EVENT_TIME in batch and len(batch) else None
            if latest is not None and not pd.isna(latest) and (context["timestamp"] is None or latest > context["timestamp"]):
                context["timestamp"] = latest
            yield func(batch, storage, context)

    return df.mapInPandas(run, schema)


# -- windows -----------------------------------------------------------------
# Time windows count microseconds from the baseline, count windows the rows of a
# key in the order of time and `order` (default: all columns).
def _in_windows(df: DataFrame, keys: list[str], window: Window, baseline: int, order: list[str] | None) -> DataFrame:
    return assign(with_position(df, keys, window, baseline, order), window, baseline, position=POSITION)


_NTH, _NULLS = "__nth", "__nulls"
_SORTED = (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _column(values: list) -> pd.Series:
    """Values as a column; beside a missing one whole numbers stay whole."""
    missing = any(v is None or isinstance(v, float) and v != v for v in values)
    return pd.Series(values, dtype=object if missing and any(isinstance(v, (int, np.integer)) for v in values) else None)


def keyed_windows(
    df: DataFrame, keys: list[str], window: Window, baseline: int, func: Callable[[Frame], dict] | Callable[[dict[str, np.ndarray]], dict], schema: str,
    order: list[str] | None = None, arrays: bool = False,
) -> DataFrame:
    """A function on each whole window of a key, which it gets as a pandas frame in order.

    `schema` has the keys, window_id long, and the function's fields.  One
    window's rows meet in one task; fold_windows takes them one by one, and
    sums and the like belong into paned_windows or two_phase_windows.  Rows go
    to Python sorted and in batches of many windows, which are cut there.  With
    `arrays` the function gets the columns as numpy arrays by name, which for
    small windows costs far less than frames.
    """
    names = T.StructType.fromDDL(schema).names
    placed = _in_windows(df, keys, window, baseline, order)
    ties = [f.name for f in df.schema.fields if isinstance(f.dataType, _SORTED) and f.name not in (*keys, EVENT_TIME)] if order is None else order
    inside = Over.partitionBy(*(f"`{k}`" for k in keys), WINDOW_ID).orderBy(POSITION, F.asc_nulls_last(EVENT_TIME), *(f"`{c}`" for c in ties))
    # in pandas one null makes doubles of a batch's whole numbers, so they go filled; bits tell where, and only a window with nulls sees doubles
    filled = {f.name: f.dataType for f in df.schema.fields if isinstance(f.dataType, (T.IntegralType, T.BooleanType))}
    if len(filled) > 63:
        raise ValueError("windows take at most 63 columns of whole numbers and booleans")
    null_bits = [F.when(F.isnull(f"`{c}`"), F.lit(1 << i)).otherwise(0).cast("long") for i, c in enumerate(filled)]
    dealt = placed.withColumn(_NTH, F.row_number().over(inside)).withColumn(_NULLS, _fold(Column.bitwiseOR, null_bits, F.lit(0).cast("long")))
    dealt = dealt.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(0).cast(t)) for c, t in filled.items()})

    def emptied(part: Frame | dict, bits: np.ndarray, whole: type) -> Frame | dict:
        for i, c in enumerate(filled):
            null = (bits >> i & 1).astype(bool)
            if c in part and null.any():
                values = np.array(part[c], dtype=object if filled[c] == T.BooleanType() else whole)
                values[null] = None
                part[c] = values
        return part

    def results(frame: Frame) -> Frame:
        starts, bits = np.flatnonzero(frame[_NTH].to_numpy() == 1), frame[_NULLS].to_numpy()
        groups = emptied(frame[[*keys, WINDOW_ID]].iloc[starts].reset_index(drop=True), bits[starts], object)
        given = frame.drop(columns=[WINDOW_ID, POSITION, _NTH, _NULLS])
        columns, found = {c: given[c].to_numpy() for c in given} if arrays else {}, []
        bounds = zip(starts.tolist(), [*starts[1:].tolist(), len(frame)], np.logical_or.reduceat(bits != 0, starts).tolist())
        for (*values, k), (a, b, holed) in zip(groups.itertuples(index=False, name=None), bounds):
            part = {c: v[a:b] for c, v in columns.items()} if arrays else given.iloc[a:b].reset_index(drop=True)
            got = func(emptied(part, bits[a:b], float) if holed else part)
            found.append(dict(zip(keys, values)) | {"window_id": k} | got)
        return pd.DataFrame({n: _column([f[n] for f in found]) for n in names})

    def run(batches: Iterator[Frame]) -> Iterator[Frame]:
        held: list[Frame] = []  # the window that the next batch may go on with
        for batch in batches:
            starts = np.flatnonzero(batch[_NTH].to_numpy() == 1)
            if len(starts) and (held or starts[-1]):
                yield results(pd.concat([*held, batch.iloc[: starts[-1]]], ignore_index=True))
                held = []
            held.append(batch.iloc[starts[-1] :] if len(starts) else batch)
        if held:
            yield results(pd.concat(held, ignore_index=True))

    return dealt.mapInPandas(run, schema)


#: The same windows of one key in parallel: Spark deals by (key, window) anyway.
parallel_windows = keyed_windows


def fold_windows(df: DataFrame, keys: list[str], window: Window, baseline: int, step: Callable[[dict, dict], dict], initial: dict, schema: str, order: list[str] | None = None) -> DataFrame:
    """Incremental windows: step(row, state) -> state over the rows of each window, in order.

    `schema` has the keys, window_id long, and the state's fields.  A window of
    any size needs the memory of its state only.
    """
    rows = _in_windows(df, keys, window, baseline, order).withColumnRenamed(WINDOW_ID, "window_id")
    ties = [c for c in df.columns if c not in (*keys, EVENT_TIME)] if order is None else order
    sorted_rows = rows.repartition(*keys, "window_id").sortWithinPartitions(*keys, "window_id", POSITION, *ties)
    return _folded(sorted_rows, [*keys, "window_id"], step, initial, schema, False)


def paned_windows(df: DataFrame, keys: list[str], window: Window, baseline: int, parts: list[Part], order: list[str] | None = None) -> DataFrame:
    """Panes of gcd(size, slide) first, windows from panes; size above slide only."""
    if window.size <= window.slide:
        raise ValueError("panes are for windows that overlap")
    pane = gcd(window.size, window.slide)
    placed = with_position(df, keys, window, baseline, order).withColumn("__pane", F.floor(F.col(POSITION) / F.lit(pane)).cast("long"))
    totals = placed.groupBy(*keys, "__pane").agg(*(p.from_rows.alias(p.name) for p in parts))
    return windows_from_panes(totals, keys, window, pane, parts, "window_id")


def two_phase_windows(df: DataFrame, keys: list[str], window: Window, baseline: int, parts: list[Part], pieces: int = 16, order: list[str] | None = None) -> DataFrame:
    """Each window in `pieces` parts by position, then the parts together: for windows too large for one task."""
    salted = _in_windows(df, keys, window, baseline, order).withColumn("__piece", F.pmod(F.col(POSITION), F.lit(pieces)))
    first = salted.groupBy(*keys, WINDOW_ID, "__piece").agg(*(p.from_rows.alias(p.name) for p in parts))
    return first.groupBy(*keys, WINDOW_ID).agg(*(p.combined() for p in parts)).withColumnRenamed(WINDOW_ID, "window_id")


#: Rows or parts that tree_windows folds in one array, and nodes under one node of the tree over quanta.
TREE_ROWS, FAN_IN = 1024, 8


def tree_windows(
    df: DataFrame, keys: list[str], window: Window, baseline: int, lift: Column, combine: Callable[[Column, Column], Column], quantum: int | None = None,
    order: list[str] | None = None,
) -> DataFrame:
    """Windows of any associative `combine` over lifted rows, in order.

    Rows of one quantum (by default gcd(size, slide), else a divisor of both)
    are folded TREE_ROWS at a time, then those results, and then what those
    make: an array holds more than TREE_ROWS values only beyond TREE_ROWS ** 3
    rows.  Over the quanta stands a tree of FAN_IN: a node goes to the windows
    that hold it whole and its parent not, so a window is folded from at most
    2 * FAN_IN nodes a level.  Result: keys, window_id, value.
    """
    q = quantum or gcd(window.size, window.slide)
    if window.size % q or window.slide % q:
        raise ValueError("a quantum divides size and slide")
    ties = [c for c in df.columns if c not in (*keys, EVENT_TIME)] if order is None else order
    placed = with_position(df, keys, window, baseline, order).withColumn("__q", F.floor(F.col(POSITION) / F.lit(q)).cast("long"))
    nth = with_index(placed, [*keys, "__q"], [POSITION, *ties], "__nth")

    def fold(items: Column) -> Column:
        values = F.transform(F.array_sort(items), lambda x: x["v"])
        return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.element_at(values, 1), combine)

    def folded(rows: DataFrame, place: str, *by: str) -> DataFrame:
        return rows.groupBy(*keys, *by).agg(fold(F.collect_list(F.struct(F.col(place).alias("t"), F.col("v")))).alias("v"))

    part = lambda n: F.floor(F.col("__nth") / n).alias(f"__part_{n}")
    few, many = f"__part_{TREE_ROWS}", f"__part_{TREE_ROWS * TREE_ROWS}"
    rows = nth.select(*keys, "__q", part(TREE_ROWS), part(TREE_ROWS * TREE_ROWS), "__nth", lift.alias("v"))
    rows = rows.repartition(*keys, "__q", many)  # the first two folds of a quantum's part stay in one task
    nodes = folded(folded(folded(rows, "__nth", "__q", many, few), few, "__q", many), many, "__q").withColumnRenamed("__q", "__node")
    wide, step, width, pieces = window.size // q, window.slide // q, 1, None

    def windows_with(node: Column, width: int) -> tuple[Column, Column]:
        """The first and last window that hold all of a node."""
        return F.greatest(F.ceil(((node + 1) * width - wide) / step), F.lit(0)).cast("long"), F.floor(node * width / step).cast("long")

    while width <= wide:
        (first, last), (inner, outer) = windows_with(F.col("__node"), width), windows_with(F.floor(F.col("__node") / FAN_IN), width * FAN_IN)
        span = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
        spans = F.when(inner > outer, F.array(span(first, last))).otherwise(F.array(span(first, inner - 1), span(outer + 1, last)))
        used = nodes.select(*keys, (F.col("__node") * width).alias("t"), "v", F.explode(spans).alias("s"))
        used = each(used, F.col("s.a"), F.col("s.b"), "window_id").drop("s")
        pieces = used if pieces is None else pieces.union(used)
        nodes = folded(nodes.withColumn("__up", F.floor(F.col("__node") / FAN_IN)), "__node", "__up").withColumnRenamed("__up", "__node")
        width *= FAN_IN
    return folded(pieces, "t", "window_id").withColumnRenamed("v", "value")


# -- pipes -------------------------------------------------------------------
class Pipe:
    """A chain of operators on one DataFrame; every step is DataFrame -> DataFrame."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.branches: list[Pipe] = []
        self.sinks: list[tuple[DataFrame, Callable[[DataFrame], object]]] = []

    def add(self, step: Callable[..., DataFrame], *args, **options) -> Pipe:
        self.df = step(self.df, *args, **options)
        return self

    chain = add  # whole-stage code generation fuses what can be fused

    def split(self, route: Column, n: int) -> Pipe:
        self.branches = [Pipe(b) for b in split(self.df, route, n)]
        return self

    def select(self, i: int) -> Pipe:
        return self.branches[i]

    def merge(self, *others: Pipe) -> Pipe:
        return Pipe(merge(self.df, *(p.df for p in others)))

    def add_sink(self, sink: Callable[[DataFrame], object]) -> Pipe:
        self.sinks.append((self.df, sink))
        return self

    chain_sink = add_sink


class PipeGraph:
    """Pipes that run together: their sinks work side by side, at most SINKS at a time.

    A sink that starts a stream returns its query, and the graph runs until all
    queries have ended; stop() ends them.  run() returns what the sinks return.
    """

    SINKS = 32

    def __init__(self) -> None:
        self.pipes: list[Pipe] = []
        self._results: list[object] | None = None
        self._thread: threading.Thread | None = None
        self._error: BaseException | None = None
        self._queries: list[StreamingQuery] = []
        self._stopped = False

    def add_source(self, df: DataFrame) -> Pipe:
        self.pipes.append(Pipe(df))
        return self.pipes[-1]

    def _all(self, pipes: Iterable[Pipe]) -> Iterator[Pipe]:
        for p in pipes:
            yield p
            yield from self._all(p.branches)

    def merged(self, pipe: Pipe) -> Pipe:
        self.pipes.append(pipe)
        return pipe

    def start(self) -> None:
        """Begins to work off the sinks, in a thread of its own, and returns at once."""
        if self._thread is not None:
            raise RuntimeError("the graph has been started")

        def work() -> None:
            try:
                jobs = [(df, sink) for p in self._all(self.pipes) for df, sink in p.sinks]
                with ThreadPoolExecutor(max(1, min(self.SINKS, len(jobs)))) as pool:
                    begun = [pool.submit(self._begin, sink, df) for df, sink in jobs]
                self._results = [b.result() for b in begun]
                for query in self._queries:
                    query.awaitTermination()
            except BaseException as e:  # noqa: BLE001  raised by wait_end()
                self._error = e
                self.stop()

        self._thread = threading.Thread(target=work, daemon=True)
        self._thread.start()

    def _begin(self, sink: Callable[[DataFrame], object], df: DataFrame) -> object:
        got = sink(df)
        if isinstance(got, StreamingQuery):
            self._queries.append(got)
            if self._stopped:
                got.stop()
        return got

    def stop(self) -> None:
        """Ends the graph's streams, those too that are about to start."""
        self._stopped = True
        for query in self._queries:
            query.stop()

    def is_running(self) -> bool:
        return self._thread is not None and self._thread.is_alive()

    def wait_end(self) -> list[object]:
        """What the sinks returned, once all are done; raises what one raised."""
        if self._thread is not None:
            self._thread.join()
        if self._error is not None:
            raise self._error
        return self._results or []

    def run(self) -> list[object]:
        self.start()
        return self.wait_end()
