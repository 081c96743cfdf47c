"""A source that runs user code: numbered rows, made by any executor.

`make(i)` returns row i as a tuple (None: no row), so a lost task makes the
same rows again.  As a stream, `per_batch` more numbers are offered in each
micro-batch until `total` is reached, or without end.  A source registered with
marks sets its stream's watermark itself: make(i) may return Watermark(time),
which says that all rows after number i are later than `time`.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor

from ..time import Duration

#: The column of a source's own watermarks; rows that have one are no rows of the source's.
MARK = "__mark"


@dataclass(frozen=True)
class Watermark:
    """All rows that follow are later than this time (in UTC, if it has no zone)."""

    time: dt.datetime


class _Range(InputPartition):
    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


def _split(first: int, end: int, parts: int) -> list[_Range]:
    size = max(1, -(-(end - first) // max(parts, 1)))
    return [_Range(i, min(i + size, end)) for i in range(first, end, size)] or [_Range(first, first)]


def register(spark: SparkSession, name: str, make: Callable[[int], tuple | Watermark | None], schema: str, marks: bool = False) -> None:
    """Makes `name` a format for spark.read and spark.readStream.

    Options: total (streams: -1, without end), parts (tasks), per_batch (streams).
    With marks, rows have the column MARK too.
    """
    width = len(T.StructType.fromDDL(schema))

    def rows(p: _Range) -> Iterator[tuple]:
        for i in range(p.first, p.end):
            row = make(i)
            if isinstance(row, Watermark):
                if not marks:
                    raise ValueError(f"{name!r} isn't registered as a source with marks")
                time = row.time if row.time.tzinfo else row.time.replace(tzinfo=dt.timezone.utc)
                yield (*[None] * width, time)
            elif row is not None:
                yield (*row, None) if marks else row

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.total, self.parts = int(options.get("total", 0)), int(options.get("parts", 4))

        def partitions(self):
            return _split(0, self.total, self.parts)

        def read(self, partition):
            return rows(partition)

    class StreamReader(DataSourceStreamReader):
        def __init__(self, options):
            self.total, self.parts = int(options.get("total", 0)), int(options.get("parts", 4))
            self.step = int(options.get("per_batch", self.total))
            self.at = 0

        def initialOffset(self):  # noqa: N802
            return {"at": 0}

        def latestOffset(self):  # noqa: N802
            self.at = self.at + self.step if self.total < 0 else min(self.at + self.step, self.total)
            return {"at": self.at}

        def partitions(self, start, end):
            # Spark asks for the last batch again after a restart: from it the source knows where it stands
            if end["at"] < start["at"]:
                raise RuntimeError(f"the stream stood at {start['at']}, and its source offers no more than {end['at']} rows")
            self.at = max(self.at, end["at"])
            return _split(start["at"], end["at"], self.parts)

        def read(self, partition):
            return rows(partition)

        def commit(self, end):
            pass

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return f"{schema}, {MARK} timestamp" if marks else schema

        def reader(self, schema):
            return Reader(self.options)

        def streamReader(self, schema):  # noqa: N802
            return StreamReader(self.options)

    spark.dataSource.register(Source)


class _ByMarks(StatefulProcessor):
    """Rows that are later than the source's watermark; no state."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        passed, made = timerValues.getCurrentWatermarkInMs() * 1000, Row(*self.columns)
        for row in rows:
            if row[MARK] is None and (row["__at"] or 0) > passed:
                yield made(*(row[c] for c in self.columns))

    def close(self) -> None:
        pass


def _marked(rows: DataFrame, time_col: str) -> DataFrame:
    """The stream with the marks as the watermark of its time; a row behind them is late and left out."""
    from ..streaming.ordered import ROCKSDB

    spark = rows.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields if f.name != MARK])
    if not isinstance(schema[time_col].dataType, T.TimestampType):
        raise TypeError("the time of a source with marks has type timestamp")
    deal = F.pmod(F.xxhash64(*(f"`{c}`" for c in schema.names)), F.lit(1024))
    rows = rows.withWatermark(MARK, "0 seconds").withColumns({"__at": F.unix_micros(f"`{time_col}`"), "__deal": deal})
    return rows.groupBy("__deal").transformWithState(_ByMarks(schema.names), schema, "append", "EventTime", eventTimeColumnName=time_col)


def generated(
    spark: SparkSession, name: str, total: int | None, streaming: bool = False, parts: int = 4, per_batch: int | None = None,
    time_col: str | None = None, delay: Duration | None = None,
) -> DataFrame:
    """Rows 0 .. total - 1 of a registered source, as a stream also without end (total=None, with per_batch).

    With time_col, a stream's watermark follows the latest time of that column,
    `delay` behind it, or, if the source has marks, the latest Watermark that
    it gave; a last one far off closes all windows.  On batches, marks are
    left out.  A restarted query goes on at its checkpoint.
    """
    if total is None and not (streaming and per_batch):
        raise ValueError("a source without end is a stream, with per_batch")
    reader = (spark.readStream if streaming else spark.read).format(name).option("total", -1 if total is None else total).option("parts", parts)
    rows = (reader.option("per_batch", per_batch) if per_batch else reader).load()
    marks = MARK in rows.columns
    if streaming and time_col is not None:
        if marks and delay is not None:
            raise ValueError("a source with marks has no delay besides")
        return _marked(rows, time_col) if marks else rows.withWatermark(time_col, f"{delay.us if delay else 0} microseconds")
    return rows.where(F.col(MARK).isNull()).drop(MARK) if marks else rows
