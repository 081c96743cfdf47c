"""Distinct rows and intersections of streams whose state expires.

A row's state goes `within` after it last changed: when the watermark has
passed that where the stream has a time, else by the clock.  Later copies count
as new rows.  What comes out keeps the stream's watermark, so windows may follow.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..time import Duration
from .ordered import ROCKSDB, has_watermark, slot_of

#: A row's side and its time in microseconds, beside its columns.
SIDE, AT = "__side", "__at"


class _Forgetful(StatefulProcessor):
    """Counts a row's copies on both sides and gives those that are due.

    Without all_copies a side counts once, so that further copies write nothing.
    """

    def __init__(self, columns: list[str], sides: int, all_copies: bool, within: Duration, timed: bool):
        self.columns, self.sides, self.all_copies, self.within, self.timed = columns, sides, all_copies, within.us, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = None if self.timed else max(1, self.within // 1000)
        self.seen = handle.getValueState("seen", "copies0 bigint, copies1 bigint, sent bigint, until bigint", ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        got = self.seen.get()
        copies, sent, until = ([got[0], got[1]], got[2], got[3]) if got else ([0, 0], 0, 0)
        watermark = timerValues.getCurrentWatermarkInMs() * 1000 if self.timed else -1
        made, changed, latest = Row(*self.columns), False, 0
        for row in rows:
            at = row[AT] or 0
            if at <= watermark:
                continue
            if self.all_copies or not copies[row[SIDE]]:
                copies[row[SIDE]] += 1
                changed, latest = True, max(latest, at)
            due = min(copies[: self.sides])
            if due > sent:
                sent = due
                yield made(*(row[c] for c in self.columns))
        if not changed:
            return
        if self.timed:
            before, until = until, max(until, slot_of(latest + self.within))
            if until != before:
                if before:
                    self.handle.deleteTimer(before)
                self.handle.registerTimer(until)
        self.seen.update((*copies, sent, until))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def _forgetful(df: DataFrame, sides: int, all_copies: bool, keys: list[str], within: Duration, time_col: str | None) -> DataFrame:
    if within.us <= 0:
        raise ValueError("state is kept for a positive time")
    spark = df.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = time_col is not None and has_watermark(df, time_col)
    at = F.unix_micros(F.col(f"`{time_col}`").cast("timestamp")) if timed else F.lit(0).cast("long")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields if f.name != SIDE])
    processor = _Forgetful(schema.names, sides, all_copies, within, timed)
    groups = df.withColumn(AT, at).groupBy(*(f"`{k}`" for k in keys))
    if timed:
        return groups.transformWithState(processor, schema, "append", "EventTime", eventTimeColumnName=time_col)
    return groups.transformWithState(processor, schema, "append", "ProcessingTime")


def distinct_within(df: DataFrame, keys: list[str], within: Duration, time_col: str | None = None) -> DataFrame:
    """The first of the rows that are equal in `keys`; its state goes `within` later.

    Rows behind the watermark, and those without a time or at the epoch, are
    late and left out.  Null keys equal each other.
    """
    return _forgetful(df.withColumn(SIDE, F.lit(0)), 1, False, keys, within, time_col)


def intersect_within(left: DataFrame, right: DataFrame, keys: list[str], within: Duration, time_col: str | None = None, all_copies: bool = False) -> DataFrame:
    """Rows that both sides have: the one that completes a pair, once, or as often as the rarer side has it.

    State goes `within` after a row's latest copy (after each side's first one
    without all_copies); late rows and nulls as above.
    """
    both = left.withColumn(SIDE, F.lit(0)).unionByName(right.select(*(f"`{c}`" for c in left.columns)).withColumn(SIDE, F.lit(1)))
    return _forgetful(both, 2, all_copies, keys, within, time_col)
