"""Typed state, order by event time, firing by the watermark, and the end of streams."""

import datetime as dt
import json
import random
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sluice import Duration, TableEnvironment, TimeFormats, TimePolicy, Window, avg, count, max, min, sum
from sluice.streaming import CountWindows, bounded, finish, p_filter, p_flat_map, p_keyed_windows, p_map, p_reduce, run_available

BASE = ("2024-01-01T00:00:00.000Z", TimeFormats.ISO8601)
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
ROW = "k string, v long, d decimal(10,2), t timestamp, b binary, a array<int>, s struct<x:int,at:timestamp>, m map<string,timestamp>"


@pytest.fixture(autouse=True, scope="module")
def few_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def name():
    return "s" + uuid.uuid4().hex[:10]


def row(k, v, seconds):
    t = START + dt.timedelta(seconds=seconds)
    return k, v, None if v is None else Decimal(v) / 4, t, None if v is None else bytes([v % 256]), [v, None], (v, t), {"at": t}


def put(spark, folder, rows, schema=ROW):
    """One file of a stream, so that a stream that reads a file a batch sees it as one batch."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, folder, schema=ROW, per_batch=None):
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(str(folder))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# -- typed state ---------------------------------------------------------------
def _largest(r, s):
    best = r["d"] if s["best"] is None or (r["d"] is not None and r["d"] > s["best"]) else s["best"]
    return {"best": best, "n": s["n"] + 1, "last": r["t"], "seen": [*s["seen"], r["t"]], "raw": r["b"], "deep": {"x": r["s"]["x"], "at": r["m"]["at"]}}


def test_states_of_every_type(spark, tmp_path):
    """Decimals, times, binaries, arrays and structs, in rows and in states, over a restart, with nulls."""
    schema = "k string, best decimal(10,2), n long, last timestamp, seen array<timestamp>, raw binary, deep struct<x:int,at:timestamp>"
    begin = {"best": None, "n": 0, "last": None, "seen": [], "raw": None, "deep": None}
    data = [row("a", 3, 1), row("a", None, 2), row("b", 9, 3), row("a", 7, 4), row(None, 1, 5)]
    for i, r in enumerate(data):
        put(spark, tmp_path / "in", [r])
        out = p_reduce(stream(spark, tmp_path / "in"), ["k"], _largest, begin, schema)
        q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == i + 1
    got = spark.read.parquet(str(tmp_path / "out")).where("k = 'a'").orderBy("n").collect()
    assert [r["best"] for r in got] == [Decimal("0.75"), Decimal("0.75"), Decimal("1.75")]
    times = [START + dt.timedelta(seconds=s) for s in (1, 2, 4)]
    assert [x.replace(tzinfo=dt.timezone.utc) for x in got[2]["seen"]] == times and got[2]["deep"]["at"].replace(tzinfo=dt.timezone.utc) == times[2]
    assert got[1]["raw"] is None and got[1]["deep"]["x"] is None and got[2]["raw"] == b"\x07"


def _gap(r, last):
    return {"k": r["k"], "gap": None if last is None else (r["t"] - last).total_seconds()}, r["t"]


def _first(r, state):
    return state is None, r["t"]


@pytest.mark.parametrize("state", [None, "timestamp"])
def test_a_time_as_state(spark, tmp_path, state):
    """With a type of its own, or as any value."""
    put(spark, tmp_path / "in", [row("a", 1, 1), row("a", 2, 4), row("b", 3, 5)])
    got = p_map(stream(spark, tmp_path / "in"), ["k"], _gap, None, "k string, gap double", state=state, order=["v"])
    assert rows_of(run_available(got, name(), checkpoint=str(tmp_path / "c"))) == rows_of(spark.createDataFrame([("a", None), ("a", 3.0), ("b", None)], "k string, gap double"))
    kept = p_filter(stream(spark, tmp_path / "in"), ["k"], _first, None, state=state, order=["v"])
    assert sorted(r["v"] for r in run_available(kept, name(), checkpoint=str(tmp_path / "d")).collect()) == [1, 3]


# -- order -----------------------------------------------------------------------
def _listed(r, s):
    return {"seen": [*s["seen"], r["v"]]}


def _each(r, n):
    return [{"k": r["k"], "v": r["v"], "n": n}], n + 1


def batches_of(rows, cuts, rng):
    rows = list(rows)
    rng.shuffle(rows)
    at = sorted(rng.sample(range(1, len(rows)), cuts)) if cuts else []
    return [rows[a:b] for a, b in zip([0, *at], [*at, len(rows)])]


@pytest.mark.parametrize("cuts", [0, 3])
def test_any_cut_into_batches_gives_one_result(spark, tmp_path, cuts):
    """Shuffled rows in any batches fold as in the order of their times, ties by `order`."""
    rng = random.Random(cuts)
    data = [row("ab"[i % 2], i, (i * 7 % 40) // 2) for i in range(40)]
    for some in batches_of(data, cuts, rng):
        put(spark, tmp_path / "in", some)
    source = lambda: bounded(stream(spark, tmp_path / "in", per_batch=1), "t", Duration.seconds(60))
    options = {"time_col": "t", "order": ["v"]}
    ordered = {k: [r[1] for r in sorted((x for x in data if x[0] == k), key=lambda x: (x[3], x[1]))] for k in "ab"}
    folded = run_available(p_reduce(source(), ["k"], _listed, {"seen": []}, "k string, seen array<long>", **options), name(), checkpoint=str(tmp_path / "c1"))
    assert rows_of(folded) == sorted(((k, seen[: i + 1]) for k, seen in ordered.items() for i in range(len(seen))), key=str)
    numbered = run_available(p_flat_map(source(), ["k"], _each, 0, "k string, v long, n long", **options), name(), checkpoint=str(tmp_path / "c2"))
    assert {(r["k"], r["n"]): r["v"] for r in numbered.collect()} == {(k, i): v for k, seen in ordered.items() for i, v in enumerate(seen)}


def test_an_early_row_that_comes_a_batch_late(spark, tmp_path):
    """It is waited for within the delay, and dropped and counted beyond it."""
    for some in ([row("a", 1, 100)], [row("a", 2, 95), row("b", 0, 200)], [row("a", 3, 50)], [row("a", 4, 201)]):
        put(spark, tmp_path / "in", some)
    df = bounded(stream(spark, tmp_path / "in", per_batch=1), "t", Duration.seconds(10))
    out = p_reduce(df, ["k"], _listed, {"seen": []}, "k string, seen array<long>", time_col="t")
    q = out.writeStream.format("memory").queryName("early").option("checkpointLocation", str(tmp_path / "c")).start()
    assert finish(q, out) == 1
    progress = [json.loads(p.json) if hasattr(p, "json") else p for p in q.recentProgress]
    q.stop()
    assert [r["seen"] for r in spark.table("early").where("k = 'a'").collect()][-1] == [2, 1, 4]
    late = [s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"]]
    assert sorted(late)[-1] == 1


def test_adaptive_slack(spark, tmp_path):
    """A key waits as long as the largest delay it has seen; what comes behind is left out; the end gives the rest."""
    for some in ([row("a", 1, 10), row("a", 2, 5)], [row("a", 3, 30)], [row("a", 4, 26)], [row("a", 5, 60)], [row("a", 6, 3)]):
        put(spark, tmp_path / "in", some)
    # the watermark of an adaptive stream is its own, and only its end moves it
    source = stream(spark, tmp_path / "in", per_batch=1)
    out = p_reduce(source, ["k"], _listed, {"seen": []}, "k string, seen array<long>", time_col="t", adaptive=True)
    got = [r["seen"] for r in run_available(out, name(), checkpoint=str(tmp_path / "c")).collect()]
    assert got[-1] == [2, 1, 4, 3]  # 60 still waits: 5 seconds of slack
    with pytest.raises(ValueError):
        p_reduce(source.withWatermark("t", "1 second"), ["k"], _listed, {"seen": []}, "k string, seen array<long>", time_col="t", adaptive=True)


# -- windows with logic of the user's ----------------------------------------------
def _summary(rows):
    return {"n": len(rows), "seen": [r["v"] for r in rows]}


def _grow(r, s):
    return {"n": s["n"] + 1, "seen": [*s["seen"], r["v"]]}


def plain_windows(data, window, by_time):
    """(key, window, values in order) of every window, open ones too."""
    out = []
    for k in {r[0] for r in data}:
        rows = sorted((r for r in data if r[0] == k), key=lambda r: (r[3], r[1]))
        at = [(r[3] - START) // dt.timedelta(microseconds=1) if by_time else i for i, r in enumerate(rows)]
        for w in range(at[-1] // window.slide + 1):
            inside = [r[1] for r, p in zip(rows, at) if w * window.slide <= p < w * window.slide + window.size]
            if inside and (by_time or w * window.slide + window.size <= len(rows)):
                out.append((k, w, len(inside), inside))
    return sorted(out, key=str)


@pytest.mark.parametrize("form", [{"func": _summary}, {"step": _grow, "initial": {"n": 0, "seen": []}}])
@pytest.mark.parametrize("window", [
    Window.createTBWindow(Duration.milliseconds(7500), Duration.milliseconds(2500)), Window.createTBWindow(Duration.seconds(3), Duration.seconds(8)),
    Window.createCBWindow(6, 4), Window.createCBWindow(2, 5),
])
def test_windows_close_by_the_watermark_and_at_the_end(spark, tmp_path, form, window):
    """All windows come out without a late row, in any cut, decimals and times in the rows; idle keys close too."""
    rng = random.Random(7)
    data = [row("abc"[i * i % 3], i, (i * 13 % 60) / 2) for i in range(60)]
    for some in batches_of(data, 2, rng):
        put(spark, tmp_path / "in", some)
    by_time = window.kind.name == "TIME"
    df = bounded(stream(spark, tmp_path / "in", per_batch=1), "t", Duration.seconds(40))
    base = int(START.timestamp() * 1e6)
    out = p_keyed_windows(df, ["k"], window, "k string, window_id long, n long, seen array<long>", time_col="t", order=["v"], baseline=base if by_time else 0, **form)
    assert rows_of(run_available(out, name(), checkpoint=str(tmp_path / "c"))) == plain_windows(data, window, by_time)


def test_an_idle_key_closes_by_the_others_time(spark, tmp_path):
    for some in ([row("idle", 1, 1)], [row("busy", 2, 100)], [row("busy", 3, 200)]):
        put(spark, tmp_path / "in", some)
    df = stream(spark, tmp_path / "in", per_batch=1)
    out = p_keyed_windows(df, ["k"], Window.createTBWindow(Duration.seconds(10)), "k string, window_id long, n long, seen array<long>", func=_summary, time_col="t", baseline=int(START.timestamp() * 1e6))
    assert rows_of(run_available(out, name(), checkpoint=str(tmp_path / "c"))) == [("busy", 10, 1, [2]), ("idle", 0, 1, [1])]


def test_a_batch_writes_what_it_brings(spark, tmp_path):
    """The bytes that a batch writes don't grow with the rows that a key holds open."""
    for b in range(7):
        put(spark, tmp_path / "in", [row("a", b * 200 + i, b * 200 + i) for i in range(200)])
    df = stream(spark, tmp_path / "in", per_batch=1)
    out = p_keyed_windows(df, ["k"], Window.createTBWindow(Duration.hours(10), Duration.minutes(1)), "k string, window_id long, n long, seen array<long>", func=_summary, time_col="t", baseline=int(START.timestamp() * 1e6))
    q = out.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    progress = [json.loads(p.json) if hasattr(p, "json") else p for p in q.recentProgress]
    q.stop()
    written = [p["stateOperators"][0]["customMetrics"]["rocksdbTotalBytesWritten"] for p in progress if p["numInputRows"]]
    assert len(written) == 7 and written[-1] < 1.5 * written[1]


# -- aggregates of tables ------------------------------------------------------------
TABLE = "k string, v long, w double, t timestamp"


def table(spark, folder, streaming, policy=TimePolicy.EVENT_TIME, **options):
    env = TableEnvironment(spark, policy=policy, time_baseline=BASE if policy is TimePolicy.EVENT_TIME else None, streaming=streaming, bounded=streaming, **options)
    df = stream(spark, folder, TABLE, 1) if streaming else spark.read.schema(TABLE).parquet(str(folder))
    timed = {"time_col": "t", "delay": Duration.seconds(90)} if policy is TimePolicy.EVENT_TIME else {}
    return env.table_from_dataframe(df, **timed)


def table_rows(n=50):
    return [("ab"[i % 2] if i % 9 else None, None if i % 4 == 0 else i * 3 % 17, None if i % 5 == 0 else i / 8, START + dt.timedelta(seconds=i * 11 % 45)) for i in range(n)]


ALL = lambda: (count().alias("n"), sum("v").alias("total"), min("v").alias("low"), max("w").alias("high"), avg("w").alias("mean"))


@pytest.mark.parametrize("window", [Window.createCBWindow(6, 4), Window.createCBWindow(2, 5)])
def test_count_windows_of_a_stream_equal_those_of_a_batch(spark, tmp_path, window):
    """Nulls, several columns and keys, shuffled batches; those that are not full come at the end, as on batches."""
    for some in batches_of(table_rows(), 3, random.Random(5)):
        put(spark, tmp_path / "in", some, TABLE)
    ask = lambda t: t.group_by("k", window=window).select("k", *ALL())
    expected = rows_of(ask(table(spark, tmp_path / "in", False)).dataframe())
    got = run_available(ask(table(spark, tmp_path / "in", True)).dataframe(), name(), checkpoint=str(tmp_path / "c"))
    assert rows_of(got) == expected and len(expected) > 5


@pytest.mark.parametrize("keys", [["k"], []])
def test_running_aggregates_of_a_stream_equal_those_of_a_batch(spark, tmp_path, keys):
    for some in batches_of(table_rows(), 3, random.Random(6)):
        put(spark, tmp_path / "in", some, TABLE)
    ask = lambda t: t.group_by(*keys).select(*keys, *ALL())
    expected = rows_of(ask(table(spark, tmp_path / "in", False, aggregates="running")).dataframe())
    got = run_available(ask(table(spark, tmp_path / "in", True, aggregates="running")).dataframe(), name(), checkpoint=str(tmp_path / "c"))
    assert rows_of(got) == expected and len(expected) == 50


def test_running_aggregates_without_times_and_over_a_restart(spark, tmp_path):
    for expected in ([("a", 1), ("a", 3)], [("a", 1), ("a", 3), ("a", 6)]):
        put(spark, tmp_path / "in", [("a", v, 0.0, START) for v in ((1, 2) if len(expected) == 2 else (3,))], TABLE)
        t = table(spark, tmp_path / "in", True, TimePolicy.NO_POLICY, aggregates="running")
        out = t.group_by("k").select("k", sum("v").alias("total")).dataframe()
        q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert rows_of(spark.read.parquet(str(tmp_path / "out"))) == expected


def test_count_windows_skip_nulls(spark, tmp_path):
    put(spark, tmp_path / "in", [("a", 1, 0.0, START), ("a", None, float("nan"), START)], TABLE)
    got = CountWindows.of(stream(spark, tmp_path / "in", TABLE), ["k"], "v", 2, order=["v"])
    assert rows_of(run_available(got, name(), checkpoint=str(tmp_path / "c"))) == [("a", 2, 1, 1, 1, 0)]


def test_the_end_of_a_stream_closes_sparks_own_windows(spark, tmp_path):
    """Time windows and executed jobs, without a late row in the data."""
    for some in batches_of(table_rows(), 2, random.Random(8)):
        put(spark, tmp_path / "in", some, TABLE)
    window = Window.createTBWindow(Duration.seconds(10), Duration.seconds(5))
    ask = lambda t: t.name_query("closed").group_by("k", window=window).select("k", *ALL())
    batch = ask(table(spark, tmp_path / "in", False)).dataframe()
    expected = rows_of(batch)
    t = table(spark, tmp_path / "in", True)
    assert rows_of(run_available(ask(t).dataframe(), name())) == expected
    t = table(spark, tmp_path / "in", True)
    handle = t.env.execute(ask(t), tmp_path / "out")
    handle.finish()
    assert not handle.is_running()
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "closed_output")).count() == len(expected)


