"""Interval joins and window joins.

Both sides have the same key names (null keys never match).  Keys come first in the result, then
the left side's other columns, then the right side's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..time import Interval, Window
from . import EVENT_TIME
from .ranks import BOUNDS, KEY, PART, bounds_below, fixed, key_struct, planned_bytes, sampled_cuts
from .windows import WINDOW_ID, assign, window_end

_LEFT, _RIGHT, _FROM, _UNTIL = "__left_time", "__right_time", "__from", "__until"
#: Widest interval for which keyed joins meet by time bucket too: a key's rows then spread over
#: its times.  In wider ones only keys with many rows are cut, at quantiles of their own times.
BUCKETED_US = 2 * 86_400_000_000
#: Buckets to an interval in joins without keys: a left row is copied to one more than these, and
#: is compared with so many buckets' right rows instead of two intervals' worth.
PIECES = 4


def _sides(left: DataFrame, right: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame, Column | None]:
    l = left.withColumnRenamed(EVENT_TIME, _LEFT)  # noqa: E741
    r = right.withColumnRenamed(EVENT_TIME, _RIGHT).withColumnsRenamed({k: f"__right_{k}" for k in on})
    same = None
    for k in on:
        one = F.col(f"`{k}`") == F.col(f"`__right_{k}`")
        same = one if same is None else same & one
    return l, r, same


def broadcast_bytes(df: DataFrame) -> int:
    """Up to which size the session lets Spark broadcast a side by itself; -1 where it may not."""
    return int(df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def interval_join(left: DataFrame, right: DataFrame, on: list[str], interval: Interval) -> DataFrame:
    """Pairs of equal keys with right time in [left time + lower, left time + upper].

    The times are bucketed by the interval's width: a left row meets the at most
    two buckets that its interval touches.  Without keys that makes a hash or
    merge join, by buckets of a PIECES-th of that width and in as many tasks as
    a shuffle has, as pairs are many beside rows; with keys (and an interval up
    to BUCKETED_US) it keeps the rows of a hot key apart by time, so that they
    are neither all in one task nor all paired before their times are compared.  In a wider interval the keys that a
    sample finds hot are cut at quantiles of their times (see cut_by_time).
    The result's event time is the later one.  On streams Spark keeps a
    watermark only for a column of one side; where the interval lies on both
    sides of the left time, the later time gets one of its own (restamp.py).
    """
    l, r, same = _sides(left, right, on)
    lo, up = interval.lower.us, interval.upper.us
    shift = lambda us: f"{_LEFT} + make_dt_interval(0, 0, 0, cast({us} / 1e6 as decimal(18, 6)))"
    streaming = left.isStreaming or right.isStreaming
    if streaming:  # Spark finds in such a condition how long it keeps its state
        within = F.expr(f"{_RIGHT} >= {shift(lo)} AND {_RIGHT} <= {shift(up)}")
    else:  # sums of times and intervals go by the calendar and are slow: once a row, not once a pair
        l = l.withColumns({_FROM: F.unix_micros(_LEFT) + F.lit(lo), _UNTIL: F.unix_micros(_LEFT) + F.lit(up)})  # noqa: E741
        within = (F.unix_micros(_RIGHT) >= F.col(_FROM)) & (F.unix_micros(_RIGHT) <= F.col(_UNTIL))
    if streaming and same is not None:
        joined = l.join(r, same & within)
    elif same is not None and up - lo > BUCKETED_US and min(planned_bytes(l), planned_bytes(r)) <= broadcast_bytes(l):
        joined = l.join(r, same & within)  # Spark sends one side to all tasks, so no key meets in one
    elif same is not None and up - lo > BUCKETED_US:
        l, r = cut_by_time(l, r, on, lo, up)  # noqa: E741
        joined = l.join(r, same & (F.col(PART) == F.col("__right_part"))).where(within).drop(PART, "__right_part")
    else:
        alone = same is None and not streaming
        width = max(-((lo - up) // PIECES) if alone else up - lo, 1)
        bucket = lambda time, us: F.floor((F.unix_micros(time) + F.lit(us)) / F.lit(width)).cast("long")
        l = l.withColumn("__bucket", F.explode(F.sequence(bucket(_LEFT, lo), bucket(_LEFT, up))))  # noqa: E741
        meet = F.col("__bucket") == F.col("__right_bucket")
        r = r.withColumn("__right_bucket", bucket(_RIGHT, 0))
        if alone:  # a fixed number: small sides would be put into few tasks, whatever they have to pair
            r = r.repartition(int(r.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__right_bucket")
        # on streams the times stand in the join's condition, by which Spark lets its state go
        joined = l.join(r, meet & within) if streaming else l.join(r, meet if same is None else same & meet).where(within)
        joined = joined.drop("__bucket", "__right_bucket")
    if joined.isStreaming and lo >= 0:  # the right time is the later one, and keeps its watermark
        joined = joined.withColumn(EVENT_TIME, F.col(_RIGHT))
    elif joined.isStreaming and up <= 0:
        joined = joined.withColumn(EVENT_TIME, F.col(_LEFT))
    else:
        joined = joined.withColumn(EVENT_TIME, F.greatest(_LEFT, _RIGHT))
    out = joined.drop(_LEFT, _RIGHT, _FROM, _UNTIL, *(f"__right_{k}" for k in on))
    if out.isStreaming and lo < 0 < up:
        from ..streaming.restamp import restamped

        out = restamped(out, EVENT_TIME, on)
    return out


def cut_by_time(l: DataFrame, r: DataFrame, on: list[str], lo: int, up: int) -> tuple[DataFrame, DataFrame]:  # noqa: E741
    """Both sides with the part in which they meet, PART and __right_part.

    A key with more rows on the right than a task's share is cut at quantiles of
    its right times, and a left row goes to the parts that its interval touches;
    so does a key with many rows on the left only, the other way round.  A row
    that goes to many parts meets a part's worth of rows in each but two, so the
    copies are few beside the pairs.  All other keys are one part.
    """
    keys = [f"__right_{k}" for k in on]
    right, left = sampled_cuts(r, keys, [_RIGHT]), sampled_cuts(l, on, [_LEFT])
    both = right.withColumn("__left", F.lit(False)).union(left.withColumn("__left", F.lit(True)))
    cuts = fixed(both.groupBy(KEY).agg(F.min_by(F.struct("__left", BOUNDS), "__left").alias("c")).select(
        KEY, "c.__left", F.transform(f"c.{BOUNDS}", lambda b: b["c0"]).alias(BOUNDS)
    ))
    if cuts is None:
        return l.withColumn(PART, F.lit(0)), r.withColumn("__right_part", F.lit(0))

    def dealt(df: DataFrame, names: list[str], time: str, before: int, after: int, own: bool, part: str) -> DataFrame:
        at = F.unix_micros(time)
        alone = F.array(bounds_below(at))
        touched = F.sequence(bounds_below(at + F.lit(before)), bounds_below(at + F.lit(after)))
        parts = F.when(F.col(BOUNDS).isNull(), F.array(F.lit(0))).when(F.col("__left") == own, alone).otherwise(touched)
        # a row without a time meets none
        placed = df.where(F.col(time).isNotNull()).withColumn(KEY, key_struct(df, names)).join(F.broadcast(cuts), KEY, "left")
        return placed.withColumn(part, F.explode(parts)).drop(KEY, BOUNDS, "__left")

    return dealt(l, on, _LEFT, lo, up, True, PART), dealt(r, keys, _RIGHT, -up, -lo, False, "__right_part")


def window_join(left: DataFrame, right: DataFrame, on: list[str], window: Window, baseline: int) -> DataFrame:
    """Pairs of equal keys that share a time window, one for each shared window.

    Windows that begin before the baseline count here.  The result's event time
    is the window's last microsecond.
    """
    streaming = left.isStreaming or right.isStreaming
    if streaming:
        if window.slide > window.size:
            raise TypeError("a window join on streams needs windows without gaps")
        spark_window = F.window(EVENT_TIME, f"{window.size} microseconds", f"{window.slide} microseconds", f"{baseline % window.slide} microseconds")
        a, b = (x.withColumn(WINDOW_ID, spark_window) for x in (left, right))
    else:
        a, b = (assign(x, window, baseline, negative=True) for x in (left, right))
    l, r, same = _sides(a, b.withColumnRenamed(WINDOW_ID, "__right_window"), on)
    share = F.col(WINDOW_ID) == F.col("__right_window")
    joined = l.join(r, share if same is None else same & share)
    time = F.window_time(WINDOW_ID) if streaming else window_end(window, baseline)
    return joined.withColumn(EVENT_TIME, time).drop(_LEFT, _RIGHT, WINDOW_ID, "__right_window", *(f"__right_{k}" for k in on))


def mapped(joined: DataFrame, func: Callable[[dict], dict | None], schema: str) -> DataFrame:
    """func on every joined row, in Arrow batches; rows for which it gives None go."""
    names = T.StructType.fromDDL(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [x for x in map(func, batch.to_dict("records")) if x is not None]
            yield pd.DataFrame(out, columns=names)

    return joined.mapInPandas(run, schema)


def interval_join_with(left: DataFrame, right: DataFrame, on: list[str], interval: Interval, func: Callable[[dict], dict | None], schema: str) -> DataFrame:
    """interval_join, with a function that makes a row of each pair, or none."""
    return mapped(interval_join(left, right, on, interval), func, schema)


def window_join_with(left: DataFrame, right: DataFrame, on: list[str], window: Window, baseline: int, func: Callable[[dict], dict | None], schema: str) -> DataFrame:
    """window_join, with a function that makes a row of each pair, or none."""
    return mapped(window_join(left, right, on, window, baseline), func, schema)


def equi_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Plain inner join without a time bound (an extension)."""
    l, r, same = _sides(left, right, on)
    if same is None:
        raise ValueError("a join without a time bound needs keys")
    joined = l.join(r, same)
    if _LEFT in joined.columns and _RIGHT in joined.columns:
        joined = joined.withColumn(EVENT_TIME, F.greatest(_LEFT, _RIGHT))
    return joined.drop(_LEFT, _RIGHT, *(f"__right_{k}" for k in on))
