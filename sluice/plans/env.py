"""The environment: session, catalog, time policy and execution."""

from __future__ import annotations

import threading
import time
import traceback
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import EVENT_TIME
from ..schema import Schema
from ..sources.files import InputFileConfiguration, read_files
from ..sources.kafka import KafkaSource
from ..streaming.ordered import has_watermark
from ..time import Duration, TimePolicy, baseline_micros
from ..types import DataType
from .table import Query, Table


def instant(spark: SparkSession, name: str, kind: T.DataType) -> Column:
    """The column; a time without zone becomes the instant that it is in UTC."""
    c = F.col(f"`{name}`")
    if not isinstance(kind, T.TimestampNTZType):
        return c
    c = c.cast("timestamp")
    if spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "GMT", "Z"):
        c = F.from_utc_timestamp(c, F.current_timezone())
    return c.alias(name)


class JobHandle:
    """A running query: a batch job in a thread, or a streaming query."""

    def __init__(self, name: str, work=None, stream=None, context=None, df=None):
        self.name, self._stream, self._context, self._df = name, stream, context, df
        self._out: list[str] = []
        self._err: list[str] = []
        self.metrics: dict[str, float] = {}
        self._tag = f"sluice-{name}-{id(self)}"
        self._thread = None
        if work is not None:
            self._thread = threading.Thread(target=self._run, args=(work,), daemon=True)
            self._thread.start()

    def _run(self, work) -> None:
        began = time.time()
        try:
            self._context.addJobTag(self._tag)
            rows = work()
            self.metrics = {"rows_out": rows, "seconds": time.time() - began}
            self._out.append(f"[SINK_METRICS] rows={rows} seconds={time.time() - began:.3f}")
        except Exception:  # noqa: BLE001  reported by wait()
            self._err.append(traceback.format_exc())

    def is_running(self) -> bool:
        return self._stream.isActive if self._stream is not None else self._thread.is_alive()

    def wait(self, timeout: float | None = None) -> bool:
        """True when it ended; raises what the job raised."""
        if self._stream is not None:
            ended = self._stream.awaitTermination(timeout) if timeout is not None else (self._stream.awaitTermination() or True)
            return bool(ended)
        self._thread.join(timeout)
        if self._err:
            raise RuntimeError(self._err[-1])
        return not self._thread.is_alive()

    def process_available(self) -> None:
        """Streams: work off what has arrived."""
        if self._stream is not None:
            self._stream.processAllAvailable()

    def finish(self) -> None:
        """Batches: wait for the end.  Streams: work off what has arrived, give what is open (bounded sources) and stop."""
        if self._stream is None:
            self.wait()
            return
        from ..streaming.run import finish

        finish(self._stream, self._df)
        self._stream.stop()

    def stop(self) -> None:
        if self._stream is not None:
            self._stream.stop()
        else:
            self._context.cancelJobsWithTag(self._tag)

    def get_out_logs(self) -> str:
        if self._stream is not None:
            return "\n".join(str(p.json if hasattr(p, "json") else p) for p in self._stream.recentProgress)
        return "\n".join(self._out)

    def get_err_logs(self) -> str:
        if self._stream is not None:
            return str(self._stream.exception() or "")
        return "\n".join(self._err)


class TableEnvironment:
    """Registers sources and queries, checks them and runs them.

    par                partitions of shuffles (None: Spark's setting)
    policy             EVENT_TIME needs time_baseline and sources with a time
                       column; INGRESS_TIME stamps rows as they are read;
                       NO_POLICY knows no time windows or joins in time
    aggregates         "final": one row a group; "running": one updated row for
                       every row, in order of event time and then the columns
    emit_empty         time windows without rows, from window 0, appear too
    truncate_avg       AVG of whole numbers divides towards zero
    streaming          sources are read as streams
    allowed_lateness   streams: how much longer than a source's delay windows
                       and joins wait for late rows
    bounded            streams end: run_available() and JobHandle.finish() give
                       what is open then
    state_ttl          streams: how long distinct, union and intersections
                       remember a row (None: for ever)
    """

    def __init__(
        self, spark: SparkSession | None = None, par: int | None = None, policy: TimePolicy = TimePolicy.NO_POLICY,
        time_baseline: tuple[str, DataType] | None = None, *, aggregates: str = "final", emit_empty: bool = False,
        truncate_avg: bool = False, streaming: bool = False, allowed_lateness: Duration | None = None, bounded: bool = False,
        state_ttl: Duration | None = None, include_dir: object = None,
    ):
        if par is not None and par < 1:
            raise ValueError("par is positive")
        if aggregates not in ("final", "running"):
            raise ValueError("aggregates are final or running")
        if policy is TimePolicy.EVENT_TIME and time_baseline is None:
            raise ValueError("event time needs a time_baseline")
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.policy, self.aggregates, self.emit_empty = policy, aggregates, emit_empty
        self.truncate_avg, self.streaming, self.bounded = truncate_avg, streaming, bounded
        self.lateness, self.state_ttl = allowed_lateness or Duration(0), state_ttl
        self.baseline = baseline_micros(time_baseline) if time_baseline else 0
        if par is not None:
            self.spark.conf.set("spark.sql.shuffle.partitions", par)
        self._tables: dict[str, Table] = {}
        self._sources: dict[str, object] = {}
        self._numbers: dict[str, int] = {}

    def need_time(self, what: str) -> None:
        if self.policy is TimePolicy.NO_POLICY:
            raise ValueError(f"{what} needs a time policy")

    def _new_id(self, kind: str) -> str:
        self._numbers[kind] = self._numbers.get(kind, 0) + 1
        return f"{kind}_{self._numbers[kind]}"

    def _register(self, table: Table, named: bool) -> Table:
        """Tables with a name of their own are SQL views too."""
        if table.table_id in self._tables:
            raise ValueError(f"the name {table.table_id!r} is taken")
        self._tables[table.table_id] = table
        if named and not table.df.isStreaming:
            table.dataframe().createOrReplaceTempView(table.table_id.replace(" ", "_").replace("-", "_"))
        return table

    def _stamped(self, df: DataFrame, time_col: str | None, delay: Duration | None) -> DataFrame:
        if self.policy is TimePolicy.EVENT_TIME:
            if time_col is None:
                raise ValueError("under event time a source names its time column")
            if df.isStreaming and has_watermark(df, time_col):
                # the source sets its watermark itself; the hidden time takes it over
                if self.bounded or delay or self.lateness.us:
                    raise ValueError("a source that sets its watermark says itself how long it waits and when it ends")
                return df.withColumn(EVENT_TIME, F.col(f"`{time_col}`")).withMetadata(time_col, {"watermark": EVENT_TIME})
            df = df.withColumn(EVENT_TIME, F.col(f"`{time_col}`").cast("timestamp"))
        elif time_col is not None:
            raise ValueError("a time column is for event time only")
        elif self.policy is TimePolicy.INGRESS_TIME:
            df = df.withColumn(EVENT_TIME, F.current_timestamp())
        else:
            df = df.withColumn(EVENT_TIME, F.timestamp_micros(F.lit(0)))
        if not df.isStreaming or self.policy is TimePolicy.NO_POLICY:
            return df
        wait = Duration((delay.us if delay else 0) + self.lateness.us)
        if self.bounded:
            from ..streaming.run import bounded

            return bounded(df, EVENT_TIME, wait)
        return df.withWatermark(EVENT_TIME, f"{wait.us} microseconds")

    def table_from_file(self, config: InputFileConfiguration, name: str | None = None) -> Table:
        table_id = name or self._new_id("source_stream_file")
        df = self._stamped(read_files(self.spark, config, self.streaming), config.time_col, config.delay)
        self._sources[table_id] = config
        return self._register(Table(self, table_id, config.schema, df), name is not None)

    def table_from_kafka(self, source: KafkaSource, name: str | None = None, time_col: str | None = None, delay: Duration | None = None) -> Table:
        table_id = name or self._new_id("source_stream_kafka")
        df = source.read(self.spark, self.streaming)
        self._sources[table_id] = source
        return self._register(Table(self, table_id, Schema.from_spark(df.schema), self._stamped(df, time_col, delay)), name is not None)

    def table_from_dataframe(self, df: DataFrame, name: str | None = None, time_col: str | None = None, delay: Duration | None = None) -> Table:
        """Any DataFrame whose column types have a logical type."""
        table_id = name or self._new_id("source_dataframe")
        df = df.select(*(instant(self.spark, f.name, f.dataType) for f in df.schema.fields))
        schema = Schema.from_spark(df.schema)
        return self._register(Table(self, table_id, schema, self._stamped(df, time_col, delay)), name is not None)

    def get_table(self, name: str) -> Table:
        if name not in self._tables:
            raise KeyError(f"no table {name!r}")
        return self._tables[name]

    def get_source_config(self, table_id: str) -> object:
        if table_id not in self._sources:
            raise KeyError(f"no source {table_id!r}")
        return self._sources[table_id]

    def create_query(self, query: Query, name: str | None, kind: str = "query") -> Query:
        query = Query(self, name or self._new_id(kind), query.schema, query.df)
        return self._register(query, name is not None)  # type: ignore[return-value]

    def execute(self, query: Table, output_dir: str | Path = ".", sync: bool = False, output_mode: str = "append", checkpoint: str | None = None) -> JobHandle:
        """Writes the query's rows as CSV with a header to <output_dir>/<name>_output.

        Times appear as YYYY-MM-DDTHH:MM:SS.mmmZ.  A batch query runs in the
        background, or to its end with sync; a stream runs until it is stopped.
        """
        if not isinstance(query, Table):
            raise TypeError("execute takes a table or query")
        if query.env is not self:
            raise ValueError("the query belongs to another environment")
        target = f"{output_dir}/{query.table_id}_output"
        rows = formatted(query)
        if query.df.isStreaming:
            place = checkpoint or f"{output_dir}/.{query.table_id}_checkpoint"
            writer = rows.writeStream.outputMode(output_mode).option("checkpointLocation", place)
            if output_mode == "append":
                stream = writer.format("csv").option("header", True).option("path", target).start()
            else:
                stream = writer.foreachBatch(
                    lambda df, n: df.write.mode("overwrite").option("header", True).csv(f"{target}/batch={n}")
                ).start()
            handle = JobHandle(query.table_id, stream=stream, df=query.df)
        else:
            def work() -> int:
                from pyspark.sql import Observation

                seen = Observation()
                rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("header", True).csv(target)
                return int(seen.get["rows"])

            handle = JobHandle(query.table_id, work=work, context=self.spark.sparkContext)
        if sync:
            handle.wait()
        return handle


def formatted(table: Table) -> DataFrame:
    """The visible rows with times as UTC text in milliseconds, whatever the session's zone."""

    def text(name: str) -> Column:
        micros = F.unix_micros(f"`{name}`")
        # a time without zone, counted from the epoch, prints as it is
        whole = F.expr(f"cast(timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(floor(unix_micros(`{name}`) / 1000000) as decimal(18, 6))) as string)")
        milli = F.lpad(F.pmod(F.floor(micros / 1000), F.lit(1000)).cast("string"), 3, "0")
        return F.concat(F.translate(F.substring(whole, 1, 19), " ", "T"), F.lit("."), milli, F.lit("Z"))

    return table.dataframe().select(*(
        text(n).alias(n) if t is DataType.ISO8601 else F.col(f"`{n}`") for n, t in table.schema.items()
    ))
