"""Rows of a stream's keys in the order of their times, however they are cut into batches.

With a time column, a key's rows wait in the state store until the watermark
has passed them, and are then handed on by time and `order`: any cut into
batches gives one result, and rows that come after that are late (Spark drops
and counts them).  Without one, rows are taken as they come, in `order` within
a batch.  With an adaptive slack there is no fixed delay: a key's rows wait as
long as the largest delay that the key has seen.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..time import Duration
from .typed import Chunks, plain

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Microseconds of a row's time, beside its columns; the time that the watermark follows; the key of streams without keys.
AT, LATE, ALL = "__at", "__late", "__all"
OWN = (AT, LATE, ALL)
#: Rows wait in slots of so many milliseconds.
SLOT_MS = 1000
#: A watermark that only the end of a stream reaches (year 9000), and the times of the rows that move it there,
#: two as an operator behind a join learns of the watermark a batch later.
END_MS = 221_845_392_000_000
LAST_TIMES = ("9900-01-01 00:00:00", "9901-01-01 00:00:00")
#: Delay of the watermark where an adaptive slack decides: never passed but at the end.
UNBOUNDED = Duration(0).us + 200 * 366 * 86_400_000_000


def sort_key(row: dict, columns: list[str]) -> tuple:
    """Ascending, nulls first, NaN last, as Spark sorts."""
    out = []
    for c in columns:
        v = row[c]
        out.append((0,) if v is None else (2,) if v != v else (1, v))
    return tuple(out)


def slot_of(us: int) -> int:
    """The slot of a time, named by the millisecond at which it is complete."""
    return -(-us // (SLOT_MS * 1000)) * SLOT_MS


class Ordered(StatefulProcessor):
    """Hands rows to taken(key, rows), in order; a stream's end calls ended(key)."""

    #: Whether ended() has something to do.
    has_end = False

    def __init__(self, order: list[str] | None = None, adaptive: bool = False, ttl_ms: int | None = None):
        self.order, self.adaptive, self.ttl_ms = order or [], adaptive, ttl_ms
        self.timed = False
        self.row: T.StructType = T.StructType([])
        self.keys: list[str] = []
        self.names: list[str] = []

    # -- what the kinds of processors define -----------------------------------
    def begin(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def taken(self, key: dict, rows: list[dict]) -> Iterator[dict]:
        raise NotImplementedError

    def passed(self, key: dict, watermark: int) -> Iterator[dict]:
        """After the rows up to the watermark (milliseconds, a slot's end) have been taken."""
        return iter(())

    def ended(self, key: dict) -> Iterator[dict]:
        return iter(())

    # -- Spark's side ----------------------------------------------------------
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        if self.timed:
            self.waiting = Chunks(handle, "waiting", self.row)
            self.known = handle.getValueState("known", "yes boolean")
        if self.adaptive:
            self.slack = handle.getValueState("slack", "latest bigint, delay bigint, gone bigint, late bigint")
        self.begin(handle)

    def _key(self, key: tuple) -> dict:
        return dict(zip(self.keys, key))

    def _out(self, rows: Iterator[dict]) -> Iterator[Row]:
        made = Row(*self.names)
        for r in rows:
            yield made(*(x.item() if hasattr(x, "item") else x for x in map(r.get, self.names)))

    def _rows(self, rows: Iterator[Row]) -> list[dict]:
        return [{f.name: plain(v, f.dataType) for f, v in zip(self.row.fields, r)} for r in rows]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        got = self._rows(rows)
        if not self.timed:
            if self.order:
                got.sort(key=lambda r: sort_key(r, self.order))
            yield from self._out(self.taken(self._key(key), got))
            return
        if self.has_end and not self.known.exists():
            self.known.update((True,))
            self.handle.registerTimer(END_MS)
        if self.adaptive:
            got = self._in_time(got)
        slots = defaultdict(list)
        for r in got:
            slots[slot_of(r[AT] or 0)].append(r)
        for slot, some in slots.items():
            if self.waiting.add(slot, some) and not self.adaptive:
                self.handle.registerTimer(slot)
        if self.adaptive:
            latest, delay, gone, late = self.slack.get()
            horizon = (latest - delay) // (SLOT_MS * 1000) * SLOT_MS
            if horizon > gone:
                yield from self._out(self._released(self._key(key), horizon))
                self.slack.update((latest, delay, horizon, late))
            self.handle.registerTimer(END_MS)

    def _in_time(self, rows: list[dict]) -> list[dict]:
        """Rows that are not behind what has been handed on; the key's delay grows with what it sees."""
        latest, delay, gone, late = self.slack.get() if self.slack.exists() else (0, 0, 0, 0)
        out = []
        for r in rows:
            at = r[AT] or 0
            latest = max(latest, at)
            delay = max(delay, latest - at)
            if slot_of(at) <= gone:
                late += 1
            else:
                out.append(r)
        self.slack.update((latest, delay, gone, late))
        return out

    def _released(self, key: dict, watermark: int) -> Iterator[dict]:
        rows: list[dict] = []
        for slot in self.waiting.slots():
            if slot <= watermark:
                rows.extend(self.waiting.get(slot))
                self.waiting.remove(slot)
        rows.sort(key=lambda r: (r[AT] or 0, sort_key(r, self.order)))
        if rows:
            yield from self.taken(key, rows)
        yield from self.passed(key, watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        at, named = expiredTimerInfo.getExpiryTimeInMs(), self._key(key)
        watermark = timerValues.getCurrentWatermarkInMs() // SLOT_MS * SLOT_MS
        yield from self._out(self._released(named, watermark))
        if at >= END_MS:
            yield from self._out(self.ended(named))
            self.known.clear()

    def close(self) -> None:
        pass


def has_watermark(df: DataFrame, column: str) -> bool:
    return "spark.watermarkDelayMs" in df.schema[column].metadata


def apply_ordered(
    df: DataFrame, keys: list[str], processor: Ordered, schema: str | T.StructType, mode: str = "append", time_col: str | None = None,
    lateness: Duration | None = None,
) -> DataFrame:
    """The processor over a stream's keys, by `time_col` if there is one.

    Rows may be `lateness` late; the time column's own watermark stays if it
    has one (then a row at the epoch or before it is late from the start).  A
    row without a time comes before those that are still waiting.  Without keys
    all rows are one key.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    processor.timed = time_col is not None
    if processor.timed:
        if processor.ttl_ms:
            raise ValueError("state expires by processing time, so not where rows wait for their time")
        if has_watermark(df, time_col):
            if processor.adaptive:
                raise ValueError("an adaptive slack decides by itself how long rows wait: give a column without a watermark")
        else:
            # a watermark begins at the epoch, and what isn't beyond it is late
            df = df.withColumn(LATE, F.greatest(F.col(f"`{time_col}`").cast("timestamp"), F.timestamp_micros(F.lit(1))))
            df = df.withWatermark(LATE, f"{UNBOUNDED if processor.adaptive else lateness.us if lateness else 0} microseconds")
        df = df.withColumn(AT, F.unix_micros(F.col(f"`{time_col}`").cast("timestamp")))
    elif processor.adaptive:
        raise ValueError("an adaptive slack needs a time column")
    processor.row, processor.keys = df.schema, keys
    out = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    processor.names = out.names
    by: list[Column] = [F.col(f"`{k}`") for k in keys]
    if not keys:
        df = df.withColumn(ALL, F.lit(0))
        processor.row, by = df.schema, [F.col(ALL)]
    time_mode = "EventTime" if processor.timed else "ProcessingTime" if processor.ttl_ms else "None"
    return df.groupBy(*by).transformWithState(processor, out, mode, time_mode)
