"""Streams end where batch runs end, once a late row has moved the watermark."""

import datetime as dt
import uuid

import pytest

from sluice import Duration, FileFormat, InputFileConfiguration, Interval, SchemaBuilder, TableEnvironment, TimeFormats, TimePolicy, Window, count, sum
from sluice.operators import rows as blocks
from sluice.streaming import CountWindows, Intersect, run_available, sink_metrics
from sluice.streaming.stateful import p_filter, p_flat_map, p_map, p_reduce, p_sink
from pyspark.sql import functions as F

BASE = ("2024-01-01T00:00:00.000Z", TimeFormats.ISO8601)
SCHEMA = SchemaBuilder().add_column("k", "STRING").add_column("v", "BIGINT").add_column("t", TimeFormats.ISO8601).build()


def at(seconds):
    return (dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%S.000Z")


def csv(folder, rows):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{uuid.uuid4().hex}.csv").write_text("k,v,t\n" + "".join(f"{k},{v},{at(t)}\n" for k, v, t in rows))
    return folder


def name():
    return "q" + uuid.uuid4().hex[:8]


def make(spark, folder, streaming, delay=None):
    env = TableEnvironment(spark, policy=TimePolicy.EVENT_TIME, time_baseline=BASE, streaming=streaming)
    config = InputFileConfiguration(folder, FileFormat.CSV, SCHEMA, order=delay is None, time_col="t", delay=delay)
    return env, env.table_from_file(config)


ROWS = [("a", i, i * 3) for i in range(20)] + [("b", i, i * 5) for i in range(12)]
SENTINEL = ("end", 0, 100_000)


def drop_end(rows):
    return sorted(tuple(r) for r in rows if r[0] != "end")


@pytest.mark.parametrize("window", [
    Window.createTBWindow(Duration.seconds(10)),
    Window.createTBWindow(Duration.seconds(12), Duration.seconds(4)),
    Window.createTBWindow(Duration.seconds(4), Duration.seconds(10)),
])
def test_windows(spark, tmp_path, window):
    ask = lambda t: t.group_by("k", window=window).select("k", count().alias("n"), sum("v").alias("s"))
    folder = csv(tmp_path / "in", [*ROWS, SENTINEL])
    _, batch = make(spark, folder, False)
    _, stream = make(spark, folder, True)
    assert drop_end(run_available(ask(stream).dataframe(), name()).collect()) == drop_end(ask(batch).dataframe().collect())


def test_interval_join(spark, tmp_path):
    folder, other = csv(tmp_path / "l", ROWS), csv(tmp_path / "r", [(k, v + 100, t + 2) for k, v, t in ROWS])
    found = []
    for streaming in (False, True):
        env, left = make(spark, folder, streaming)
        right = env.table_from_file(InputFileConfiguration(other, FileFormat.CSV, SCHEMA, order=True, time_col="t"), "right")
        joined = left.join(right.rename_columns({"v": "w", "t": "u"}), ["k"], Interval(Duration.seconds(0), Duration.seconds(4))).select("k", "v", "w")
        df = joined.dataframe()
        found.append(sorted(tuple(r) for r in (run_available(df, name()) if streaming else df).collect()))
    assert found[0] == found[1] and found[0]


def test_window_join(spark, tmp_path):
    folder, other = csv(tmp_path / "l", ROWS), csv(tmp_path / "r", [(k, v + 100, t + 2) for k, v, t in ROWS])
    found = []
    for streaming in (False, True):
        env, left = make(spark, folder, streaming)
        right = env.table_from_file(InputFileConfiguration(other, FileFormat.CSV, SCHEMA, order=True, time_col="t"), "right")
        joined = left.join(right.rename_columns({"v": "w", "t": "u"}), ["k"], Window.createTBWindow(Duration.seconds(10), Duration.seconds(5))).select("k", "v", "w")
        df = joined.dataframe()
        found.append(sorted(tuple(r) for r in (run_available(df, name()) if streaming else df).collect()))
    assert found[0] == found[1] and found[0]


def test_late_rows_are_dropped_beyond_the_delay(spark, tmp_path):
    folder = csv(tmp_path / "in", [("a", 1, 100)])
    env, t = make(spark, folder, True, Duration.seconds(10))
    df = t.group_by("k", window=Window.createTBWindow(Duration.seconds(10))).select("k", sum("v").alias("s")).dataframe()
    table = name()
    q = df.writeStream.format("memory").queryName(table).outputMode("append").start()
    q.processAllAvailable()
    csv(folder, [("a", 2, 95), ("a", 4, 50), ("a", 0, 200)])  # within the delay; beyond it
    q.processAllAvailable()
    csv(folder, [("end", 0, 10_000)])
    q.processAllAvailable()
    metrics = sink_metrics(q)
    q.stop()
    assert sorted(r["s"] for r in spark.table(table).collect() if r) [:3] == [0, 1, 2]
    assert metrics["late_rows"] >= 1 and metrics["rows_in"] == 5


def test_distinct_and_running_totals(spark, tmp_path):
    folder = csv(tmp_path / "in", [("a", 1, 1), ("a", 1, 1), ("b", 2, 2)])
    _, t = make(spark, folder, True)
    assert len(run_available(t.distinct().dataframe(), name()).collect()) == 2
    _, t = make(spark, folder, True)
    totals = t.group_by("k").select("k", sum("v").alias("s")).dataframe()
    assert sorted(tuple(r) for r in run_available(totals, name(), "update").collect()) == [("a", 2), ("b", 2)]


def test_execute_writes_files_and_stops(spark, tmp_path):
    folder = csv(tmp_path / "in", ROWS)
    env, t = make(spark, folder, True)
    handle = env.execute(t.name_query("copied").select("k", "v"), tmp_path / "out")
    handle.process_available()
    assert handle.is_running() and "numInputRows" in handle.get_out_logs()
    handle.stop()
    assert not handle.is_running() and handle.get_err_logs() == ""
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "copied_output")).count() == len(ROWS)


def raw(spark, folder):
    return spark.readStream.schema("k string, v long, t string").option("header", True).csv(str(folder))


@pytest.mark.parametrize("all_copies, expected", [(False, [("a", 1)]), (True, [("a", 1), ("a", 1)])])
def test_stateful_intersect(spark, tmp_path, all_copies, expected):
    left = raw(spark, csv(tmp_path / "l", [("a", 1, 0)] * 3 + [("b", 1, 0)])).select("k", "v")
    right = raw(spark, csv(tmp_path / "r", [("a", 1, 5)] * 2 + [("c", 1, 0)])).select("k", "v")
    found = run_available(Intersect.of(left, right, all_copies), name(), checkpoint=str(tmp_path / "c"))
    assert sorted(tuple(r) for r in found.collect()) == expected


def test_count_windows_on_a_stream(spark, tmp_path):
    df = raw(spark, csv(tmp_path / "in", [("a", i, i) for i in range(7)])).select("k", "v")
    found = run_available(CountWindows.of(df, ["k"], "v", 4, 2, ["v"]), name(), checkpoint=str(tmp_path / "c"))
    assert sorted((r["window_id"], r["count"], r["sum"], r["min"], r["max"]) for r in found.collect()) == [(0, 4, 6, 0, 3), (1, 4, 14, 2, 5)]


def _keep_new(row, state):
    return row["v"] > state, max(state, row["v"])


def _numbered(row, state):
    return {"k": row["k"], "n": state}, state + 1


def _twice(row, state):
    return [{"k": row["k"], "n": state}] * 2, state + 1


def _total(row, state):
    return {"total": state["total"] + row["v"]}


def _nothing(row, state):
    return state + 1


def test_persistent_operators(spark, tmp_path):
    df = raw(spark, csv(tmp_path / "in", [("a", 1, 0), ("a", 1, 0), ("b", 5, 0)])).select("k", "v")
    get = lambda out, i: sorted(tuple(r) for r in run_available(out, name(), checkpoint=str(tmp_path / f"c{i}")).collect())
    assert get(p_filter(df, ["k"], _keep_new, 0), 1) == [("a", 1), ("b", 5)]
    assert get(p_map(df, ["k"], _numbered, 10, "k string, n long"), 2) == [("a", 10), ("a", 11), ("b", 10)]
    assert len(get(p_flat_map(df, ["k"], _twice, 0, "k string, n long"), 3)) == 6
    assert get(p_reduce(df, ["k"], _total, {"total": 100}, "k string, total long"), 4) == [("a", 101), ("a", 102), ("b", 105)]
    q = p_sink(df, ["k"], _nothing, 0, str(tmp_path / "c5"))
    q.processAllAvailable()
    q.stop()


def test_state_survives_a_restart(spark, tmp_path):
    folder = csv(tmp_path / "in", [("a", 1, 0)])
    for expected in ([("a", 1)], [("a", 1), ("a", 3)]):
        out = p_reduce(raw(spark, folder).select("k", "v"), ["k"], _total, {"total": 0}, "k string, total long")
        q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == expected
        csv(folder, [("a", 2, 0)])


def test_pipes(spark):
    graph = blocks.PipeGraph()
    source = graph.add_source(spark.range(10)).add(blocks.filter_rows, F.col("id") > 1).chain(blocks.map_rows, {"id": F.col("id") * 2})
    source.split(F.when(F.col("id") % 4 == 0, 0).otherwise(1), 2)
    source.select(0).add_sink(lambda df: df.count())
    graph.merged(source.select(0).merge(source.select(1))).add_sink(lambda df: df.count())
    assert sorted(graph.run()) == [4, 8]


def _numbered_rows(batch, storage, context):
    first = storage.get("n", 0)
    storage["n"] = first + len(batch)
    return batch.assign(n=range(first, first + len(batch)), part=context["partition"])


def test_storage_lives_with_the_task(spark):
    found = blocks.with_storage(spark.range(0, 40, 1, 2), _numbered_rows, "id long, n long, part int").collect()
    assert {r["part"] for r in found} == {0, 1} and sorted(r["n"] for r in found if r["part"] == 1) == list(range(20))


def test_wrong_branch_is_an_error(spark):
    a, b = blocks.split(spark.range(3), F.col("id").cast("int"), 2)
    with pytest.raises(Exception, match="branch outside"):
        a.count() + b.collect().__len__()


def _thirds(i):
    return (i, "abc"[i % 3]) if i % 5 else None


def test_generated_rows(spark):
    from sluice.sources import generated, register

    register(spark, "thirds", _thirds, "i long, letter string")
    expected = sorted(_thirds(i) for i in range(50) if i % 5)
    assert sorted(tuple(r) for r in generated(spark, "thirds", 50).collect()) == expected
    table = name()
    q = generated(spark, "thirds", 50, streaming=True, per_batch=20).writeStream.format("memory").queryName(table).start()
    for _ in range(4):
        q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table(table).collect()) == expected


def test_sinks_and_monitor(spark, tmp_path):
    from sluice.sinks import to_batches, to_function
    from sluice.streaming import Monitor

    seen = []
    to_batches(spark.range(5), lambda df, n: seen.append((n, df.count())))
    assert seen == [(0, 5)]
    to_function(spark.range(5), lambda frame: None)
    monitor = Monitor().start(spark)
    q = to_batches(raw(spark, csv(tmp_path / "in", ROWS)), lambda df, n: seen.append((n, df.count())), str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    import time

    for _ in range(50):
        if str(q.id) in monitor.ended:
            break
        time.sleep(0.1)
    monitor.stop(spark)
    assert seen[-1] == (0, len(ROWS)) and monitor.figures[str(q.id)]["rows_in"] == len(ROWS)


def test_allowed_lateness_keeps_rows(spark, tmp_path):
    folder = csv(tmp_path / "in", [("a", 1, 100)])
    env = TableEnvironment(spark, policy=TimePolicy.EVENT_TIME, time_baseline=BASE, streaming=True, allowed_lateness=Duration.seconds(60))
    t = env.table_from_file(InputFileConfiguration(folder, FileFormat.CSV, SCHEMA, order=True, time_col="t"))
    table = name()
    q = t.group_by("k", window=Window.createTBWindow(Duration.seconds(10))).select("k", sum("v").alias("s")).dataframe().writeStream.format("memory").queryName(table).start()
    q.processAllAvailable()
    csv(folder, [("a", 4, 50)])
    q.processAllAvailable()
    csv(folder, [("end", 0, 10_000)])
    q.processAllAvailable()
    q.stop()
    assert sorted(r["s"] for r in spark.table(table).collect()) == [1, 4]


def test_intersect_of_streaming_tables(spark, tmp_path):
    folder, other = csv(tmp_path / "l", [("a", 1, 1), ("b", 2, 2)]), csv(tmp_path / "r", [("a", 1, 9), ("c", 2, 2)])
    env, left = make(spark, folder, True)
    right = env.table_from_file(InputFileConfiguration(other, FileFormat.CSV, SCHEMA, order=True, time_col="t"), "right")
    found = left.select("k", "v").intersect(right.select("k", "v")).dataframe()
    assert [tuple(r) for r in run_available(found, name(), checkpoint=str(tmp_path / "c")).collect()] == [("a", 1)]


def test_distinct_within_a_time(spark, tmp_path):
    env, t = make(spark, csv(tmp_path / "in", [("a", 1, 1), ("a", 1, 1), ("b", 2, 2)]), True, Duration.seconds(5))
    assert len(run_available(t.distinct(within=Duration.seconds(5)).dataframe(), name()).collect()) == 2


def test_windows_with_user_logic_on_the_state_store(spark, tmp_path):
    """Count and time windows of a stream, by whole windows and by steps, against the batch forms."""
    import pandas as pd
    from pyspark.sql import functions as F

    from sluice.streaming import p_keyed_windows
    from sluice.time import Duration, Window

    data = [(i, i % 3 if i % 11 else None, i * 7 % 50, 1_000_000 * i) for i in range(120)]
    df = spark.createDataFrame(data, "id long, k long, v long, us long").withColumn("at", F.timestamp_micros("us"))
    df.repartition(1).sortWithinPartitions("id").write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    total = lambda rows: {"n": len(rows), "total": int(pd.Series([r["v"] for r in rows]).sum()), "first": rows[0]["id"]}
    step = lambda r, s: {"n": s["n"] + 1, "total": s["total"] + r["v"], "first": s["first"] if s["n"] else r["id"]}
    begin = {"n": 0, "total": 0, "first": -1}
    schema = "k long, window_id long, n long, total long, first long"

    def plain(window, by_time):
        out, state = [], {}
        for i, k, v, us in data:
            state.setdefault(k, []).append((i, v, us))
        for k, rows in state.items():
            last = rows[-1][2] if by_time else len(rows)
            for w in range(200):
                lo, hi = w * window.slide, w * window.slide + window.size
                inside = [r for n, r in enumerate(rows) if lo <= (r[2] if by_time else n) < hi]
                if inside and hi <= last:
                    out.append((k, w, len(inside), int(pd.Series([r[1] for r in inside]).sum()), inside[0][0]))
        return sorted(out, key=str)

    for n, (window, time) in enumerate([(Window.createCBWindow(5), None), (Window.createCBWindow(6, 2), None), (Window.createTBWindow(Duration.seconds(20), Duration.seconds(10)), "at")]):
        for form in ({"func": total}, {"step": step, "initial": begin}):
            found = p_keyed_windows(stream(), ["k"], window, schema, time_col=time, order=["id"], **form)
            name = f"pkw_{n}_{'func' in form}"
            query = found.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
            query.awaitTermination()
            got = [(None if pd.isna(r["k"]) else r["k"], r["window_id"], r["n"], int(r["total"]), r["first"]) for r in spark.table(name).collect()]
            assert sorted(got, key=str) == plain(window, time is not None)
    with pytest.raises(ValueError):
        p_keyed_windows(stream(), ["k"], Window.createCBWindow(5), schema)


def test_streams_refuse_what_they_would_ignore(spark, tmp_path):
    from sluice import DataTypes, Duration, FileFormat, InputFileConfiguration, Schema, TableEnvironment, TimeFormats, TimePolicy, Window, avg, count, sum

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("k,v,at\n" + "".join(f"a,{v},2024-01-01T00:00:0{v}.000Z\n" for v in (1, 2, 4)) + "a,0,2024-01-02T00:00:00.000Z\n")
    schema = Schema({"k": DataTypes.STRING, "v": DataTypes.INT, "at": TimeFormats.ISO8601})
    config = InputFileConfiguration(str(tmp_path / "in"), FileFormat.CSV, schema, order=True, time_col="at")

    def table(**options):
        env = TableEnvironment(spark, policy=TimePolicy.EVENT_TIME, time_baseline=("2024-01-01T00:00:00.000Z", TimeFormats.ISO8601), streaming=True, **options)
        return env.table_from_file(config)

    minute = Window.createTBWindow(Duration.minutes(1))
    with pytest.raises(TypeError):
        table(emit_empty=True).group_by("k", window=minute).select("k", count().alias("n"))
    for truncate, mean in ((True, 2), (False, 7 / 3)):
        found = table(truncate_avg=truncate).group_by("k", window=minute).select("k", avg("v").alias("mean"), sum("v").alias("total"))
        name = f"truncated_{truncate}"
        found.dataframe().writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        assert [(r["k"], r["total"]) for r in spark.table(name).collect()] == [("a", 7)]
        assert spark.table(name).first()["mean"] == pytest.approx(mean)
