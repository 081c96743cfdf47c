"""State that expires, sources that set their watermark, restarts midway, graphs of streams, late pairs."""

import ast
import datetime as dt
import time
import uuid

import pytest
from pyspark.sql import functions as F

from sluice import Duration, Interval, TableEnvironment, TimeFormats, TimePolicy, Window, count, sum
from sluice.operators.rows import PipeGraph
from sluice.sources import Watermark, generated, register
from sluice.streaming import Monitor, run_available

BASE = ("1970-01-01T00:00:00.000Z", TimeFormats.ISO8601)
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
BEGAN = int(START.timestamp())


def put(spark, folder, rows):
    """One file of a stream: key, value and second of each row."""
    df = spark.createDataFrame(rows, "k string, v long, s long").select("k", "v", F.timestamp_seconds(F.col("s") + BEGAN).alias("t"))
    df.coalesce(1).write.mode("append").parquet(str(folder))


def table(spark, env, folder, name, columns=("k", "v", "t"), per_batch=None):
    reader = spark.readStream.schema("k string, v long, t timestamp")
    df = (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(str(folder)).toDF(*columns)
    return env.table_from_dataframe(df, name, time_col=columns[-1] if env.policy is TimePolicy.EVENT_TIME else None)


def timed(spark, **options):
    return TableEnvironment(spark, policy=TimePolicy.EVENT_TIME, time_baseline=BASE, streaming=True, **options)


def begin(df, folder, mode="append"):
    name = "s" + uuid.uuid4().hex[:8]
    return df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder)).start(), name


def feed(spark, query, batches):
    """Hands in files one after the other; the state rows after each, as Monitor has them."""
    monitor, held = Monitor().start(spark), []
    try:
        for folder, rows in batches:
            put(spark, folder, rows)
            query.processAllAvailable()
            time.sleep(0.5)  # the listener hears of a batch a moment later
            held.append(monitor.figures[str(query.id)]["state_rows"])
    finally:
        monitor.stop(spark)
    return held


def rows_of(spark, name):
    return sorted((tuple(r) for r in spark.table(name).collect()), key=str)


# -- T8: state that expires --------------------------------------------------------
def test_distinct_forgets_by_the_watermark(spark, tmp_path):
    put(spark, tmp_path / "in", [(None, 0, 1)])
    t = table(spark, timed(spark, state_ttl=Duration.seconds(60)), tmp_path / "in", "in").select("k", "v").distinct()
    query, name = begin(t.dataframe(), tmp_path / "c")
    query.processAllAvailable()
    keys = [(f"k{i}", i, 10) for i in range(20)]
    held = feed(spark, query, [(tmp_path / "in", keys + keys + [(None, 0, 11)]), (tmp_path / "in", [("k3", 3, 40)]), (tmp_path / "in", [("k9", 9, 500), ("k4", 4, 20)]), (tmp_path / "in", [("k3", 3, 501)])])
    query.stop()
    # 20 keys and the null one once; k3 is new once the watermark is past its minute, k9 comes before that; k4 at 20 is late
    assert rows_of(spark, name) == sorted([(k, v) for k, v, _ in keys] + [(None, 0), ("k3", 3)], key=str)
    assert held[0] == 21 and held[-1] <= 2


def test_union_and_select_forget_and_windows_may_follow(spark, tmp_path):
    for side in "lr":
        put(spark, tmp_path / side, [("a", 1, 1), ("a", 1, 2), (side, 2, 3)])
    env = timed(spark)
    l, r = (table(spark, env, tmp_path / side, side).select("k", "v") for side in "lr")  # noqa: E741
    both = l.union(r, within=Duration.minutes(1)).group_by("k", window=Window.createTBWindow(Duration.seconds(10))).select("k", count().alias("n"))
    query, name = begin(both.dataframe(), tmp_path / "c")
    query.processAllAvailable()
    feed(spark, query, [(tmp_path / side, [("end", 0, 1000)]) for side in "lr"] + [(tmp_path / side, [("end", 1, 2000)]) for side in "lr"])
    query.stop()
    assert [x for x in rows_of(spark, name) if x[0] != "end"] == [("a", 1), ("l", 1), ("r", 1)]
    named = timed(spark, state_ttl=Duration.minutes(1))
    assert "TransformWithState" in table(spark, named, tmp_path / "l", "n").select("k", distinct=True).dataframe()._jdf.queryExecution().analyzed().toString()


def test_windows_after_a_stream_join_without_keys(spark, tmp_path):
    for side in "lr":
        put(spark, tmp_path / side, [("a", 1, 1), ("b", 2, 8), ("end", 0, 1000)])
    env = timed(spark)
    l, r = table(spark, env, tmp_path / "l", "l", ("k", "v", "t")), table(spark, env, tmp_path / "r", "r", ("j", "w", "u"))
    joined = l.join(r, [], Interval(Duration.seconds(-3), Duration.seconds(3))).group_by("k", window=Window.createTBWindow(Duration.seconds(10))).select("k", sum("w").alias("s"))
    query, name = begin(joined.dataframe(), tmp_path / "c")
    query.processAllAvailable()
    feed(spark, query, [(tmp_path / side, [("end", 1, 3000)]) for side in "lr"])
    query.stop()
    assert [x for x in rows_of(spark, name) if x[0] != "end"] == [("a", 1), ("b", 2)]


@pytest.mark.parametrize("all_copies, expected", [(False, [("a", 1), ("d", 4)]), (True, [("a", 1), ("a", 1), ("d", 4)])])
def test_intersections_forget(spark, tmp_path, all_copies, expected):
    put(spark, tmp_path / "l", [("a", 1, 1)] * 3 + [("b", 2, 2), ("c", 3, 5)])
    put(spark, tmp_path / "r", [("a", 1, 4)] * 2)
    env = timed(spark)
    l, r = (table(spark, env, tmp_path / side, side).select("k", "v") for side in "lr")  # noqa: E741
    found = (l.intersect_all if all_copies else l.intersect)(r, within=Duration.seconds(30))
    query, name = begin(found.dataframe(), tmp_path / "c")
    query.processAllAvailable()
    held = feed(spark, query, [(tmp_path / "l", [("d", 4, 100)]), (tmp_path / "r", [("d", 4, 101)]), (tmp_path / "r", [("b", 2, 110)]), (tmp_path / "l", [("x", 0, 1000)]), (tmp_path / "r", [("x", 1, 1000)])])
    query.stop()
    # b of the left side was forgotten when its partner came
    assert rows_of(spark, name) == expected
    assert held[-1] < held[0]


def test_without_times_the_clock_decides(spark, tmp_path):
    put(spark, tmp_path / "in", [("a", 1, 1), ("a", 1, 1), ("b", 2, 1)])
    env = TableEnvironment(spark, streaming=True, state_ttl=Duration.seconds(3))
    t = table(spark, env, tmp_path / "in", "in").select("k", "v").distinct()
    query, name = begin(t.dataframe(), tmp_path / "c")

    def wait_for(rows):  # batches follow each other without end, as the clock goes on
        for _ in range(200):
            if rows_of(spark, name) == rows:
                return
            time.sleep(0.1)
        raise AssertionError(rows_of(spark, name))

    try:
        wait_for([("a", 1), ("b", 2)])
        time.sleep(4)
        put(spark, tmp_path / "in", [("a", 1, 1), ("c", 3, 1)])
        wait_for([("a", 1), ("a", 1), ("b", 2), ("c", 3)])
    finally:
        query.stop()
    with pytest.raises(ValueError):
        t.distinct(within=Duration(-1))
    with pytest.raises(RuntimeError, match="clock"):
        run_available(t.dataframe(), "never")


def test_batches_keep_all(spark):
    env = TableEnvironment(spark, state_ttl=Duration.seconds(1))
    t = env.table_from_dataframe(spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v long"))
    assert t.distinct().dataframe().count() == 2 and t.union(t).dataframe().count() == 2 and t.intersect(t, within=Duration.seconds(1)).dataframe().count() == 2


def test_many_copies_come_in_blocks(spark):
    env = TableEnvironment(spark)
    l, r = (env.table_from_dataframe(spark.range(n).select((F.col("id") * 0).alias("x"))) for n in (25_001, 30_000))  # noqa: E741
    assert l.intersect_all(r).dataframe().count() == 25_001


# -- J1 and windows: pairs between two watermarks -----------------------------------
def test_pairs_that_come_right_after_the_watermark(spark, tmp_path):
    """Batches without a pause: rows that were late a batch ago meet in a join and are no error."""
    for side in "lr":
        for i, s in enumerate((1, 1000, 500, 2000, 1500, 3000, 4000)):
            put(spark, tmp_path / side, [("a", i, s)])
            time.sleep(0.02)
    env = timed(spark)
    l, r = table(spark, env, tmp_path / "l", "l", per_batch=1), table(spark, env, tmp_path / "r", "r", ("k", "w", "u"), per_batch=1)
    joined = l.join(r, ["k"], Interval(Duration.seconds(-5), Duration.seconds(5)))
    query, name = begin(joined.group_by("k", window=Window.createTBWindow(Duration.seconds(10))).select("k", count().alias("n"), sum("v").alias("s")).dataframe(), tmp_path / "c")
    query.processAllAvailable()
    query.stop()
    got = rows_of(spark, name)
    assert {("a", 1, 0), ("a", 1, 1), ("a", 1, 3), ("a", 1, 5)} <= set(got) and len(got) == len(set(got))


# -- B2: sources that set their watermark -------------------------------------------
def _held_back(i):
    """A row a second; the source says only at number 40 that the first half minute is over."""
    if i == 40:
        return Watermark(START + dt.timedelta(seconds=30))
    if i == 80:
        return Watermark(START + dt.timedelta(days=9000))
    return "ab"[i % 2], i, START + dt.timedelta(seconds=(i * 7) % 30 if i < 40 else i)


def test_a_source_holds_back_its_watermark(spark, tmp_path):
    register(spark, "held_back", _held_back, "k string, v long, t timestamp", marks=True)
    window = Window.createTBWindow(Duration.seconds(10))
    found = []
    for streaming in (True, False):
        env = TableEnvironment(spark, policy=TimePolicy.EVENT_TIME, time_baseline=BASE, streaming=streaming)
        t = env.table_from_dataframe(generated(spark, "held_back", 81, streaming, per_batch=10, time_col="t"), "in", time_col="t")
        totals = t.group_by("k", window=window).select("k", count().alias("n"), sum("v").alias("s")).dataframe(event_time=streaming)
        if not streaming:
            assert {tuple(r)[:3] for r in totals.collect()} == found[0] and generated(spark, "held_back", 81).count() == 79
            continue
        query, name = begin(totals, tmp_path / "c")
        seen = []
        while not seen or seen[-1][0] < 81:
            query.processAllAvailable()
            done = [p for p in query.recentProgress if p.sources[0].endOffset]
            seen.append((ast.literal_eval(done[-1].sources[0].endOffset)["at"] if done else 0, spark.table(name).count()))
        time.sleep(1)
        query.processAllAvailable()
        rows = spark.table(name).collect()
        progress = [(ast.literal_eval(p.sources[0].endOffset)["at"], p.sink.numOutputRows) for p in query.recentProgress]
        query.stop()
        # nothing before the mark at number 40, though times had reached 30 long before
        assert all(n <= 0 for at, n in progress if at <= 40) and len(rows) == len({tuple(r)[:1] + tuple(r)[-1:] for r in rows}) == 14
        found.append({tuple(r)[:3] for r in rows})
    with pytest.raises(ValueError):
        generated(spark, "held_back", 81, True, time_col="t", delay=Duration.seconds(1))
    env = timed(spark, bounded=True)
    with pytest.raises(ValueError):
        env.table_from_dataframe(generated(spark, "held_back", 81, True, time_col="t"), "b", time_col="t")


def _late(i):
    return Watermark(START + dt.timedelta(seconds=100)) if i == 1 else (i, START + dt.timedelta(seconds=(50, 0, 200, 60, 300, 90)[i]))


def test_rows_behind_the_mark_are_late(spark, tmp_path):
    register(spark, "behind", _late, "i long, t timestamp", marks=True)
    query, name = begin(generated(spark, "behind", 6, True, per_batch=1, time_col="t"), tmp_path / "c")
    for _ in range(8):
        query.processAllAvailable()
    query.stop()
    assert [r[0] for r in rows_of(spark, name)] == [0, 2, 4]
    register(spark, "unmarked", _late, "i long, t timestamp")
    with pytest.raises(Exception, match="marks"):
        generated(spark, "unmarked", 6).collect()


def _number(i):
    return (i,)


def test_an_endless_source_goes_on_after_a_restart(spark, tmp_path):
    register(spark, "numbers", _number, "i long")
    with pytest.raises(ValueError):
        generated(spark, "numbers", None, True)
    reached = 0
    for _ in range(3):
        df = generated(spark, "numbers", None, True, per_batch=7)
        query = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
        for _ in range(300):
            if query.lastProgress and spark.read.schema("i long").parquet(str(tmp_path / "out")).count() > reached + 14:
                break
            time.sleep(0.1)
        query.stop()
        got = sorted(r["i"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
        assert len(got) > reached and got == list(range(len(got)))
        reached = len(got)


def test_a_source_that_has_shrunk_is_an_error(spark, tmp_path):
    register(spark, "numbers", _number, "i long")
    for total in (100, 60):
        query = generated(spark, "numbers", total, True, per_batch=20).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).start()
        if total == 60:
            with pytest.raises(Exception, match="offers no more"):
                for _ in range(8):
                    query.processAllAvailable()
        else:
            for _ in range(8):
                query.processAllAvailable()
        query.stop()


# -- S4 and B25 ----------------------------------------------------------------------
def test_a_source_with_splits_keeps_the_callers_settings(spark, tmp_path):
    from sluice import FileFormat, InputFileConfiguration, SchemaBuilder, SplitSize

    schema = SchemaBuilder().add_column("k", "STRING").add_column("v", "BIGINT").build()
    spark.createDataFrame([("a", 1)], "k string, v long").coalesce(1).write.parquet(str(tmp_path / "in"))
    (tmp_path / "in" / "broken.parquet").write_bytes(b"no parquet at all")
    config = InputFileConfiguration(str(tmp_path / "in"), FileFormat.PARQUET, schema, order=True, split_size=SplitSize.megabytes(1))
    spark.conf.set("spark.sql.files.ignoreCorruptFiles", "true")
    try:
        assert TableEnvironment(spark).table_from_file(config).dataframe().count() == 1
    finally:
        spark.conf.unset("spark.sql.files.ignoreCorruptFiles")


def test_sinks_work_side_by_side_and_streams_are_awaited(spark, tmp_path):
    import threading

    meet, graph = threading.Barrier(3), PipeGraph()
    for i in range(3):
        graph.add_source(spark.range(i)).add_sink(lambda df: (meet.wait(30), df.count())[1])
    assert graph.run() == [0, 1, 2]

    put(spark, tmp_path / "in", [("a", 1, 1), ("b", 2, 2)])
    stream = spark.readStream.schema("k string, v long, t timestamp").parquet(str(tmp_path / "in"))
    name = "g" + uuid.uuid4().hex[:8]
    graph = PipeGraph()
    graph.add_source(stream).add_sink(lambda df: df.writeStream.format("memory").queryName(name).start())
    graph.add_source(spark.range(4)).add_sink(lambda df: df.count())
    graph.start()
    for _ in range(200):
        if name in [t.name for t in spark.catalog.listTables()] and spark.table(name).count() == 2:
            break
        time.sleep(0.1)
    assert graph.is_running()
    graph.stop()
    query, n = graph.wait_end()
    assert n == 4 and not query.isActive and spark.table(name).count() == 2 and not graph.is_running()

    ends = PipeGraph()
    ends.add_source(stream).add_sink(lambda df: df.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "e")).trigger(availableNow=True).start())
    assert not ends.run()[0].isActive
