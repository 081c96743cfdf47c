"""Assignment of rows to windows, and aggregation by window.

Time windows count from a baseline: window k holds the times t (microseconds
since the baseline, earlier times count as 0) with k * slide <= t < k * slide +
size.  Count windows use a row's position within its key in place of t.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Frame
from pyspark.sql import functions as F

from ..expr import Aggregate
from ..schema import Schema
from ..time import Window, WindowType
from . import EVENT_TIME
from .aggregates import Part, parts_of, result
from .ranks import with_index

WINDOW_ID = "__window"


def micros_since(baseline: int) -> Column:
    return F.greatest(F.unix_micros(EVENT_TIME) - F.lit(baseline), F.lit(0))


def window_ids(position: Column, size: int, slide: int, negative: bool = False) -> Column:
    """Array of the windows that hold a position; negative also those before 0."""
    last = F.floor(position / F.lit(slide)).cast("long")
    first = (F.floor((position - F.lit(size)) / F.lit(slide)) + 1).cast("long")
    if not negative:
        first = F.greatest(first, F.lit(0).cast("long"))
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


POSITION = "__position"


def with_position(df: DataFrame, keys: list[str], window: Window, baseline: int, order: list[str] | None = None) -> DataFrame:
    """df with what windows count in POSITION: microseconds since the baseline (a row without a
    time is at 0), or for count windows the row's number within its key, by time and `order`
    (default: all columns)."""
    if window.kind is WindowType.TIME:
        return df.withColumn(POSITION, F.coalesce(micros_since(baseline), F.lit(0)))
    ties = [c for c in df.columns if c not in (*keys, EVENT_TIME)] if order is None else order
    return with_index(df, keys, ties, POSITION)


def assign(df: DataFrame, window: Window, baseline: int, negative: bool = False, position: str | None = None) -> DataFrame:
    """df with one row per row and window, the window's number in WINDOW_ID; by time, or by the column `position`."""
    t = F.col(position) if position else micros_since(baseline)
    if window.size == window.slide:
        return df.withColumn(WINDOW_ID, F.floor(t / F.lit(window.slide)).cast("long"))
    if window.slide > window.size:  # at most one window, none in the gaps
        k = F.floor(t / F.lit(window.slide)).cast("long")
        return df.withColumn(WINDOW_ID, k).where(t < F.col(WINDOW_ID) * window.slide + window.size)
    return df.withColumn(WINDOW_ID, F.explode(window_ids(t, window.size, window.slide, negative)))


def window_end(window: Window, baseline: int) -> Column:
    """Event time of a window's result: its last microsecond."""
    return F.timestamp_micros(F.col(WINDOW_ID) * window.slide + F.lit(window.size + baseline - 1))


def _aggregated(df: DataFrame, by: list[str], parts: list[Part]) -> DataFrame:
    return df.groupBy(*by).agg(*(p.from_rows.alias(p.name) for p in parts))


#: Windows that a pane's total is copied to; where more hold it, they are put together from two halves.
COPIES = 16
#: Windows that are made in one array.
DENSE_BLOCK = 10_000


def each(df: DataFrame, first: Column, last: Column, name: str) -> DataFrame:
    """One row for every whole number from first to last, in arrays of at most DENSE_BLOCK."""
    blocks = df.withColumns({"__first": first.cast("long"), "__last": last.cast("long")}).where("__first <= __last")
    blocks = blocks.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__last") - F.col("__first")) / DENSE_BLOCK))))
    begin = F.col("__first") + F.col("__block") * DENSE_BLOCK
    return blocks.withColumn(name, F.explode(F.sequence(begin, F.least(F.col("__last"), begin + (DENSE_BLOCK - 1))))).drop("__first", "__last", "__block")


def windows_from_panes(totals: DataFrame, keys: list[str], window: Window, pane: int, parts: list[Part], name: str = WINDOW_ID) -> DataFrame:
    """Windows from totals by key and `__pane`, the panes being `pane` wide, a divisor of size and slide.

    A pane that few windows hold is copied to them.  Else the panes are dealt
    in blocks as wide as a window, within which totals run from the block's
    begin and from its end: a window reaches over the end of one block and the
    begin of the next, so it is made from two values, however many panes it
    has.  Only windows that hold a pane appear.
    """
    by = [f"`{k}`" for k in keys]
    wide, step = window.size // pane, window.slide // pane
    if wide <= COPIES * step:
        spread = totals.withColumn(name, F.explode(window_ids(F.col("__pane") * pane, window.size, window.slide)))
        return spread.groupBy(*by, name).agg(*(p.combined() for p in parts))
    at, block = F.col("__pane"), F.floor(F.col("__pane") / wide)
    group = Frame.partitionBy(*by, block)
    up, down = group.orderBy(at), group.orderBy(at.desc())
    so_far = lambda frame, p: getattr(F, p.combine)(F.col(f"`{p.name}`")).over(frame.rowsBetween(Frame.unboundedPreceding, 0))
    scanned = totals.select(
        *by, at.alias("__at"), (block * wide).alias("__begin"), F.lag(at).over(up).alias("__before"), F.lead(at).over(up).alias("__next"),
        *(so_far(up, p).alias(f"{p.name}__head") for p in parts), *(so_far(down, p).alias(f"{p.name}__tail") for p in parts),
    )
    at, begin = F.col("__at"), F.col("__begin")
    up_to = lambda x: F.floor(x / step)
    at_least = lambda x: F.greatest(F.ceil(x / step), F.lit(0))
    # windows whose first pane is this one, or an empty one before it
    tails = each(scanned, at_least(F.coalesce(F.col("__before") + 1, begin)), up_to(at), name)
    # windows whose last pane is this one, or an empty one behind it; a window that is the whole block is a tail already
    heads = each(scanned, at_least(at - (wide - 1)), up_to(F.coalesce(F.col("__next") - 1, begin + (wide - 2)) - (wide - 1)), name)
    halves = [df.select(*by, name, *(F.col(f"`{p.name}__{half}`").alias(p.name) for p in parts)) for df, half in ((tails, "tail"), (heads, "head"))]
    return halves[0].union(halves[1]).groupBy(*by, name).agg(*(p.combined() for p in parts))


def time_window_parts(df: DataFrame, keys: list[str], window: Window, baseline: int, parts: list[Part], panes: bool = True) -> DataFrame:
    """Parts by key and window.

    Sliding windows that overlap are put together from panes of gcd(size,
    slide): each row is aggregated once.
    """
    by = [f"`{k}`" for k in keys]
    if not panes or window.slide >= window.size:
        return _aggregated(assign(df, window, baseline), [*by, WINDOW_ID], parts)
    pane = gcd(window.size, window.slide)
    totals = _aggregated(
        df.withColumn("__pane", F.floor(micros_since(baseline) / F.lit(pane)).cast("long")), [*by, "__pane"], parts
    )
    return windows_from_panes(totals, keys, window, pane, parts)


def count_window_parts(df: DataFrame, keys: list[str], window: Window, order: list[str], parts: list[Part]) -> DataFrame:
    """Parts by key and count window, with the latest event time of each window."""
    by = [f"`{k}`" for k in keys]
    indexed = with_index(df, keys, order, "__index")
    timed = [*parts, Part(EVENT_TIME, F.max(EVENT_TIME), "max", F.col(EVENT_TIME))]
    if window.size > COPIES * window.slide:
        pane = gcd(window.size, window.slide)
        totals = _aggregated(indexed.withColumn("__pane", F.floor(F.col("__index") / F.lit(pane)).cast("long")), [*by, "__pane"], timed)
        return windows_from_panes(totals, keys, window, pane, timed)
    rows = indexed.withColumn(WINDOW_ID, F.explode(window_ids(F.col("__index"), window.size, window.slide)))
    return _aggregated(rows, [*by, WINDOW_ID], timed)


def densify(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds a row for every window from 0 to a key's last that has none."""
    by = [f"`{k}`" for k in keys]
    span = df.groupBy(*by).agg(F.max(WINDOW_ID).alias("__last"))
    every = each(span.where("__last is not null").withColumnRenamed("__last", "__until"), F.lit(0), F.col("__until"), WINDOW_ID).drop("__until")
    match = F.col(WINDOW_ID) == F.col("__own")
    for i, k in enumerate(keys):
        match = match & F.col(f"`{k}`").eqNullSafe(F.col(f"__key_{i}"))
    found = df.withColumnsRenamed({**{k: f"__key_{i}" for i, k in enumerate(keys)}, WINDOW_ID: "__own"})
    return every.join(found, match, "left").drop("__own", *(f"__key_{i}" for i in range(len(keys))))


def window_aggregate(
    df: DataFrame, schema: Schema, keys: list[str], window: Window, baseline: int, aggregates: list[Aggregate], *,
    order: list[str], emit_empty: bool = False, truncate_avg: bool = False, panes: bool = True,
) -> DataFrame:
    """Keys, each aggregate under its default name, WINDOW_ID and event time.

    With emit_empty, windows without rows appear with COUNT 0, SUM 0 and no
    other values.  Incomplete windows count.
    """
    parts = parts_of(aggregates, schema)
    if window.kind is WindowType.COUNT:
        found = count_window_parts(df, keys, window, order, parts)
    else:
        found = time_window_parts(df, keys, window, baseline, parts, panes)
        if emit_empty:
            found = densify(found, keys)
            found = found.withColumns({p.name: F.coalesce(F.col(f"`{p.name}`"), F.lit(0)) for p in parts if p.combine == "sum"})
        found = found.withColumn(EVENT_TIME, window_end(window, baseline))
    return found.select(*(f"`{k}`" for k in keys), *(result(a, schema, truncate_avg) for a in aggregates), WINDOW_ID, EVENT_TIME)


def stream_window_aggregate(df: DataFrame, schema: Schema, keys: list[str], window: Window, baseline: int, aggregates: list[Aggregate], truncate_avg: bool = False) -> DataFrame:
    """The same on a stream: Spark's own window function, which keeps the watermark.

    Spark keeps no watermark through a change of the time, so rows before the
    baseline can't be moved to it: windows that begin before it are left out.
    """
    if window.slide > window.size:
        # Spark has no gaps between windows: the rows in gaps go first, the rest tumbles by slide
        t = micros_since(baseline)
        df = df.where(t < F.floor(t / F.lit(window.slide)) * window.slide + window.size)
    spark_window = F.window(EVENT_TIME, f"{max(window.slide, window.size) if window.slide > window.size else window.size} microseconds", f"{window.slide} microseconds", f"{baseline % window.slide} microseconds")
    parts = parts_of(aggregates, schema)
    found = df.groupBy(spark_window.alias("__w"), *(f"`{k}`" for k in keys)).agg(*(p.from_rows.alias(p.name) for p in parts))
    found = found.where(F.col("__w.start") >= F.timestamp_micros(F.lit(baseline)))
    early = f" - interval {window.slide - window.size} microseconds" if window.slide > window.size else ""
    found = found.withColumn(EVENT_TIME, F.expr(f"window_time(__w){early}"))
    return found.select(*(f"`{k}`" for k in keys), *(result(a, schema, truncate_avg) for a in aggregates), EVENT_TIME)
