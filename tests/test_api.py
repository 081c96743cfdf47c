"""Validation and edge cases of the relational API."""

import datetime as dt

import pytest

from sluice import (
    DataTypes, Duration, FileFormat, InputFileConfiguration, Interval, KafkaSink, KafkaSource, Schema, SchemaBuilder, SplitSize,
    TableEnvironment, TimeFormats, TimePolicy, Window, avg, col, count, current_timestamp, lit, max, min, neg, sum,
)

BASE = ("2024-01-01T00:00:00.000Z", TimeFormats.ISO8601)


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


@pytest.fixture
def env(spark):
    return TableEnvironment(spark, policy=TimePolicy.EVENT_TIME, time_baseline=BASE)


def points(env, rows, name=None):
    df = env.spark.createDataFrame([(k, v, at(t)) for k, v, t in rows], "k string, v int, t timestamp")
    return env.table_from_dataframe(df, name, time_col="t")


def result(table):
    return sorted((tuple(r) for r in table.dataframe().collect()), key=str)


def test_types_and_names(env):
    t = points(env, [("a", 1, 0)])
    assert (col("v") + 1).type(t.schema) is DataTypes.INT
    assert (col("v") * 1.5).type(t.schema) is DataTypes.DOUBLE
    assert (col("v") + 1).default_name == "v_plus_1"
    assert neg(col("v") > 1).default_name == "not_(v_gt_1)"
    assert sum("v").default_name == "SUM_v" and count().default_name == "COUNT"
    assert current_timestamp().default_name == "CURRENT_TIMESTAMP"
    assert result(t.select((2 * col("v")).alias("x"), lit(3, "bigint").alias("y"))) == [(2, 3)]


@pytest.mark.parametrize("bad, error", [
    (lambda t: t.where(col("k") > 1), TypeError),
    (lambda t: t.where(col("k") + 1 > 1), TypeError),
    (lambda t: t.where(col("v") + 1), TypeError),
    (lambda t: t.where((col("v") > 1) & col("v")), TypeError),
    (lambda t: t.where(~col("v")), TypeError),
    (lambda t: t.where("v > 1"), TypeError),
    (lambda t: t.where(sum("v") > 1), ValueError),
    (lambda t: t.select(), ValueError),
    (lambda t: t.select(3), TypeError),
    (lambda t: t.select("missing"), KeyError),
    (lambda t: t.select("v", col("k").alias("v")), ValueError),
    (lambda t: t.select(min("k")), TypeError),
    (lambda t: t.select(max("t")), TypeError),
    (lambda t: t.select(sum(sum("v"))), TypeError),
    (lambda t: t.group_by("missing"), RuntimeError),
    (lambda t: t.group_by("k").where(col("v") > 1), RuntimeError),
    (lambda t: t.group_by("k").select("k", "v"), ValueError),
    (lambda t: t.drop_columns("missing"), KeyError),
    (lambda t: t.drop_columns("k", "v", "t"), RuntimeError),
    (lambda t: t.rename_columns(["k"]), TypeError),
    (lambda t: t.rename_columns({}), ValueError),
    (lambda t: t.rename_columns({"missing": "x"}), KeyError),
    (lambda t: t.join(t, ["k"], Window.createCBWindow(3)), TypeError),
    (lambda t: t.join(t, ["k"], Interval(Duration.days(0), Duration.days(1))), ValueError),
    (lambda t: t.join(t.rename_columns({"v": "w", "t": "u"}), ["missing"], Interval(Duration.days(0), Duration.days(1))), ValueError),
    (lambda t: t.union(t.rename_columns({"v": "w"})), ValueError),
    (lambda t: t.name_query(""), ValueError),
])
def test_refused(env, bad, error):
    with pytest.raises(error):
        bad(points(env, [("a", 1, 0)]))


def test_refused_declarations(spark, tmp_path):
    with pytest.raises(ValueError):
        SchemaBuilder().add_column("a", "INT").add_column("a", "INT")
    with pytest.raises(ValueError):
        SchemaBuilder().build()
    with pytest.raises(TypeError):
        lit([1])
    with pytest.raises(TypeError):
        lit("2024", TimeFormats.ISO8601)
    with pytest.raises(TypeError):
        Duration.seconds(1.5)
    with pytest.raises(ValueError):
        Window.createTBWindow(Duration.seconds(0))
    with pytest.raises(TypeError):
        Window.createTBWindow(Duration.seconds(1), 3)
    with pytest.raises(ValueError):
        Interval(Duration.seconds(1), Duration.seconds(0))
    with pytest.raises(ValueError):
        TableEnvironment(spark, policy=TimePolicy.EVENT_TIME)
    schema = SchemaBuilder().add_column("a", DataTypes.INT).build()
    file = tmp_path / "a.csv"
    file.write_text("a\n1\n")
    good = dict(path=file, format=FileFormat.CSV, schema=schema)
    with pytest.raises(FileNotFoundError):
        InputFileConfiguration(**{**good, "path": tmp_path / "none.csv"}, order=True)
    with pytest.raises(ValueError):
        InputFileConfiguration(**good)
    with pytest.raises(ValueError):
        InputFileConfiguration(**good, order=True, delay=Duration.seconds(1))
    with pytest.raises(ValueError):
        InputFileConfiguration(**good, order=True, time_col="b")
    none = TableEnvironment(spark)
    t = none.table_from_dataframe(spark.createDataFrame([(1,)], "a int"))
    with pytest.raises(ValueError):
        t.group_by("a", window=Window.createTBWindow(Duration.seconds(1)))
    with pytest.raises(ValueError):
        none.table_from_dataframe(spark.createDataFrame([(1,)], "a int"), t.table_id)


def test_types_by_name():
    s = SchemaBuilder().add_column("a", "bool").add_column("b", "Ubigint").build()
    assert s == Schema({"b": DataTypes.UBIGINT, "a": DataTypes.BOOLEAN})
    assert Duration.seconds(60) == Duration.minutes(1) and -Duration.hours(1) < Duration.seconds(0)
    assert SplitSize.kilobytes(2).bytes == 2048


def test_division_and_truncated_average(env):
    t = points(env, [("a", -7, 0), ("a", -6, 1)])
    assert result(t.select((col("v") / 2).alias("h"))) == [(-3,), (-3,)]
    assert result(t.group_by("k").select(avg("v").alias("m"))) == [(-6.5,)]
    old = TableEnvironment(env.spark, truncate_avg=True)
    u = old.table_from_dataframe(t.dataframe())
    assert result(u.group_by("k").select(avg("v").alias("m"))) == [(-6.0,)]


def test_overflow_raises(env):
    t = points(env, [("a", 2**31 - 1, 0), ("a", 1, 1)])
    with pytest.raises(Exception, match="(?i)overflow|out of range"):
        result(t.select(sum("v").alias("s")))


def test_interval_bounds_are_closed_and_null_keys_do_not_match(env):
    left = points(env, [("a", 1, 100), (None, 2, 100)])
    right = points(env, [("a", 10, 90), ("a", 11, 110), ("a", 12, 89), ("a", 13, 111), (None, 14, 100)]).rename_columns({"v": "w", "t": "u"})
    ten = Interval(Duration.seconds(-10), Duration.seconds(10))
    assert [r[2] for r in result(left.join(right, ["k"], ten).select("k", "v", "w"))] == [10, 11]
    assert len(result(left.join(right.rename_columns({"k": "k2"}), [], ten))) == 6


def test_window_edges(env):
    t = points(env, [("a", 1, 0), ("a", 1, 10), ("a", 1, -5), ("b", 1, 25)])
    ten = Window.createTBWindow(Duration.seconds(10))
    # the end belongs to the next window, times before the baseline to the first
    assert result(t.group_by("k", window=ten).select("k", count().alias("n"))) == [("a", 1), ("a", 2), ("b", 1)]
    dense = TableEnvironment(env.spark, policy=TimePolicy.EVENT_TIME, time_baseline=BASE, emit_empty=True)
    u = dense.table_from_dataframe(t.dataframe(), time_col="t")
    found = u.group_by("k", window=ten).select("k", count().alias("n"), max("v").alias("m"))
    assert sorted(map(str, (tuple(r) for r in found.dataframe().collect()))) == sorted(map(str, [("a", 2, 1), ("a", 1, 1), ("b", 0, None), ("b", 0, None), ("b", 1, 1)]))


def test_shared_sliding_windows_give_a_row_each(env):
    left, right = points(env, [("a", 1, 20)]), points(env, [("a", 2, 21)]).rename_columns({"v": "w", "t": "u"})
    slide = Window.createTBWindow(Duration.seconds(10), Duration.seconds(5))
    assert len(result(left.join(right, ["k"], slide))) == 2
    # a pair near the baseline shares the window that began before it
    left, right = points(env, [("a", 1, 1)]), points(env, [("a", 2, 2)]).rename_columns({"v": "w", "t": "u"})
    assert len(result(left.join(right, ["k"], slide))) == 2


def test_count_windows_with_partial_tail(env):
    t = points(env, [("a", i, i) for i in range(5)])
    assert result(t.group_by("k", window=Window.createCBWindow(2)).select(sum("v").alias("s"), count().alias("n"))) == [(1, 2), (4, 1), (5, 2)]


def test_multisets_and_permuted_columns(env):
    a = points(env, [("x", 1, 0)] * 3 + [("y", 1, 0)])
    b = points(env, [("x", 1, 5)] * 2)
    b = b.select("t", "v", "k")
    same = lambda t: t.select("v", "k")
    assert result(same(a).intersect_all(same(b))) == [(1, "x")] * 2
    assert result(same(a).intersect(same(b))) == [(1, "x")]
    assert len(result(same(a).union_all(same(b)))) == 6 and len(result(same(a).union(same(b)))) == 2


def test_event_time_outlives_projection(env):
    t = points(env, [("a", 1, 5), ("a", 2, 15)]).select("v")
    assert result(t.group_by(window=Window.createTBWindow(Duration.seconds(10))).select(sum("v").alias("s"))) == [(1,), (2,)]


def test_csv_source_and_sink(spark, tmp_path):
    file = tmp_path / "in.csv"
    file.write_text('id,name,ok,at\n1,"a",true,2024-01-01T00:00:01.250Z\n\n2,,false,bad\n')
    schema = SchemaBuilder().add_column("id", DataTypes.BIGINT).add_column("name", DataTypes.STRING).add_column("ok", DataTypes.BOOLEAN).add_column("at", TimeFormats.ISO8601).build()
    env = TableEnvironment(spark, policy=TimePolicy.EVENT_TIME, time_baseline=BASE)
    t = env.table_from_file(InputFileConfiguration(file, FileFormat.CSV, schema, order=True, time_col="at", split_size=SplitSize.megabytes(64)), "in_csv")
    assert env.get_table("in_csv") is t and env.get_source_config("in_csv").has_header
    q = t.name_query("copy").where(col("id") > 0).select("id", "name", "ok", "at")
    assert q.table_id == "copy"
    handle = env.execute(q, tmp_path / "out", sync=True)
    assert not handle.is_running() and handle.metrics["rows_out"] == 2 and "SINK_METRICS" in handle.get_out_logs() and not handle.get_err_logs()
    lines = sorted(line for p in (tmp_path / "out" / "copy_output").glob("*.csv") for line in p.read_text().splitlines() if not line.startswith("id,"))
    assert lines == ['1,"\\"a\\"",true,2024-01-01T00:00:01.250Z', '2,"",false,1970-01-01T00:00:00.000Z']
    assert spark.table("copy").count() == 2


def test_kafka_options():
    s = KafkaSource(["b1:9092", "b2:9092"], ["t1", "t2"], group_id="g", offsets={"t1": {0: 5}}, idle_timeout=Duration.seconds(2))
    o = s.options()
    assert o["subscribe"] == "t1,t2" and o["kafka.group.id"] == "g" and o["startingOffsets"] == '{"t1": {"0": 5}}' and o["kafkaConsumer.pollTimeoutMs"] == "2000"
    assert KafkaSink("b:9092", "t").options() == {"kafka.bootstrap.servers": "b:9092", "topic": "t"}
    with pytest.raises(ValueError):
        KafkaSource("b", []).options()


def test_output_times_are_utc_in_any_zone(spark, tmp_path):
    """The sink writes UTC, also in a zone whose clocks jump."""
    import glob

    before = spark.conf.get("spark.sql.session.timeZone")
    times = ["1970-01-01T00:00:00.000Z", "2024-03-31T01:30:00.250Z", "2024-10-27T00:30:00.001Z", "2024-10-27T01:30:00.999Z", "2024-07-01T12:00:00.000Z"]
    (tmp_path / "t.csv").write_text("id,at\n" + "".join(f"{i},{t}\n" for i, t in enumerate(times)))
    try:
        for zone in ("UTC", "Europe/Rome", "America/St_Johns"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            env = TableEnvironment(spark, policy=TimePolicy.EVENT_TIME, time_baseline=("1970-01-01T00:00:00.000Z", TimeFormats.ISO8601))
            schema = Schema({"id": DataTypes.INT, "at": TimeFormats.ISO8601})
            t = env.table_from_file(InputFileConfiguration(str(tmp_path / "t.csv"), FileFormat.CSV, schema, order=True, time_col="at"))
            q = t.select("id", "at")
            out = tmp_path / zone.replace("/", "-")
            env.execute(q, str(out), sync=True)
            lines = [x for f in glob.glob(f"{out}/{q.table_id}_output/*.csv") for x in open(f).read().split()[1:]]
            assert sorted(lines) == [f"{i},{t}" for i, t in enumerate(times)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_hot_key_of_an_interval_join_spreads(spark):
    """One key with all rows: pairs meet by time, and no partition has most of them."""
    from pyspark.sql import functions as F

    from sluice.operators import EVENT_TIME, joins

    left = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("a"), F.timestamp_micros(F.col("id") * 1_000_000).alias(EVENT_TIME))
    right = left.withColumnRenamed("a", "b")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = joins.interval_join(left, right, ["k"], Interval(Duration.seconds(0), Duration.seconds(2)))
        assert "__right_bucket" in joined._jdf.queryExecution().optimizedPlan().toString()
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        total = sizes[0] + sizes[1] + sizes[2] + sizes[3] + sizes[4] + sizes[5] + sizes[6] + sizes[7]
        assert total == 3 * 20_000 - 3 and len(sizes) == 8 and sorted(sizes)[-1] < 0.25 * total
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_graph_starts_without_waiting(spark):
    import threading

    from sluice.operators.rows import PipeGraph

    gate, graph = threading.Event(), PipeGraph()
    graph.add_source(spark.range(5)).add_sink(lambda df: (gate.wait(20), df.count())[1])
    graph.start()
    assert graph.is_running()
    gate.set()
    assert graph.wait_end() == [5] and not graph.is_running()
    with pytest.raises(RuntimeError):
        graph.start()
    broken = PipeGraph()
    broken.add_source(spark.range(1)).add_sink(lambda df: 1 / 0)
    broken.start()
    with pytest.raises(ZeroDivisionError):
        broken.wait_end()


def test_batches_of_kafka_begin_at_the_earliest():
    from sluice.sources import KafkaSource

    source = KafkaSource("b:9092", ["t"])
    assert source.options()["startingOffsets"] == "latest" and source.options(streaming=False)["startingOffsets"] == "earliest"


def test_distant_baselines_are_filled_in_blocks(spark):
    """emit_empty makes every window, however many, also for a null key."""
    from pyspark.sql import functions as F

    env = TableEnvironment(spark, policy=TimePolicy.EVENT_TIME, time_baseline=("1970-01-01T00:00:00.000Z", TimeFormats.ISO8601), emit_empty=True)
    df = spark.createDataFrame([("a", 25_000), (None, 10_000)], "k string, s long").select("k", F.timestamp_seconds("s").alias("at"))
    t = env.table_from_dataframe(df, time_col="at")
    got = t.group_by("k", window=Window.createTBWindow(Duration.seconds(1))).select("k", count().alias("n")).dataframe()
    assert {(r["k"], r["count"], r["sum"]) for r in got.groupBy("k").agg(F.count("*").alias("count"), F.sum("n").alias("sum")).collect()} == {("a", 25_001, 1), (None, 10_001, 1)}


def test_split_keeps_its_input_once(spark):
    from pyspark.sql import functions as F

    from sluice.operators import rows

    seen = spark.sparkContext.accumulator(0)

    def count(batch):
        seen.add(len(batch))
        return batch

    df = rows.map_rows(spark.range(10), count, "id long")
    a, b = rows.split(df, F.col("id") % 2, 2, keep=True)
    assert a.count() + b.count() == 10 and seen.value == 10


def test_split_size_belongs_to_its_source(spark, tmp_path):
    """Two sources with different splits in one query; the session's setting stays."""
    (tmp_path / "a.csv").write_text("id\n" + "1\n" * 200_000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    schema = Schema({"id": DataTypes.INT})
    env = TableEnvironment(spark)
    sizes = []
    for split in (SplitSize.kilobytes(64), SplitSize.megabytes(8)):
        t = env.table_from_file(InputFileConfiguration(str(tmp_path / "a.csv"), FileFormat.CSV, schema, order=True, split_size=split))
        sizes.append((t, t.dataframe().rdd.getNumPartitions()))
    assert sizes[0][1] >= 6 and sizes[1][1] == 1
    assert sizes[0][0].union_all(sizes[1][0]).dataframe().count() == 400_000
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
