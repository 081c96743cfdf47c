"""Windows that follow joins on streams, against the same queries as batches."""

import uuid

import pytest
from pyspark.sql import functions as F

from sluice import Duration, Interval, TableEnvironment, TimeFormats, TimePolicy, Window, count, max, sum
from sluice.queries import TABLES
from sluice.streaming import run_available

BASE = ("2024-01-01T00:00:00.000Z", TimeFormats.ISO8601)


@pytest.fixture(autouse=True, scope="module")
def few_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def both(spark, tmp_path, ask, base=BASE):
    """Rows of ask(env, read) as a batch and as streams that end."""
    found = []
    for streaming in (False, True):
        env = TableEnvironment(spark, policy=TimePolicy.EVENT_TIME, time_baseline=base, streaming=streaming, bounded=streaming)

        def table(folder, name, schema, time_col, *columns):
            df = (spark.readStream if streaming else spark.read).schema(schema).parquet(folder)
            return env.table_from_dataframe(df.select(*columns) if columns else df, name, time_col=time_col)

        df = ask(table).dataframe()
        rows = run_available(df, "j" + uuid.uuid4().hex[:8], checkpoint=str(tmp_path / f"c{uuid.uuid4().hex}")) if streaming else df
        found.append(sorted((tuple(r) for r in rows.collect()), key=str))
    return found


def folder(spark, tmp_path, sf_dir, name):
    """A table as a folder, as streams read one."""
    if not (tmp_path / name).exists():
        spark.read.parquet(f"{sf_dir}/{name}.parquet").coalesce(1).write.parquet(str(tmp_path / name))
    return str(tmp_path / name)


def sides(spark, tmp_path):
    for name, step, shift in (("l", 7, 0), ("r", 5, 3)):
        rows = spark.range(60).select(F.concat(F.lit("k"), F.col("id") % 3).alias("k"), F.col("id").alias(name), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * step % 97 + shift).alias(f"{name}t"))
        rows.coalesce(2).write.parquet(str(tmp_path / name))
    return [(str(tmp_path / n), n, f"k string, {n} long, {n}t timestamp", f"{n}t") for n in "lr"]


@pytest.mark.parametrize("attachment", [Interval(Duration.seconds(-6), Duration.seconds(9)), Window.createTBWindow(Duration.seconds(20), Duration.seconds(10)), Window.createTBWindow(Duration.seconds(12))])
def test_windows_after_joins_on_both_sides(spark, tmp_path, attachment):
    """Two-sided intervals and hopping window joins keep a watermark for what follows."""
    l, r = sides(spark, tmp_path)  # noqa: E741

    def ask(table):
        joined = table(*l).join(table(*r), ["k"], attachment)
        return joined.group_by("k", window=Window.createTBWindow(Duration.seconds(10))).select("k", count().alias("n"), sum("l").alias("sl"), max("r").alias("mr"))

    batch, stream = both(spark, tmp_path, ask)
    assert len(batch) > 10 and (len(batch), set(batch) - set(stream), set(stream) - set(batch)) == (len(stream), set(), set())


def test_the_auctions_hot_items_as_a_stream(spark, tmp_path, sf_dir):
    """nx_q5: two levels of windows and a join of both."""
    window = Window.createTBWindow(Duration.hours(12))

    def ask(table):
        events = table(folder(spark, tmp_path, sf_dir, "events"), "events", TABLES["events"], "ts", "ts", "user_id")
        counts = events.group_by("user_id", window=window).select("user_id", count().alias("hits"))
        return counts.join(counts.group_by(window=window).select(max("hits").alias("hits")), ["hits"], Interval(Duration.hours(0), Duration.hours(0))).select("user_id", "hits")

    batch, stream = both(spark, tmp_path, ask)
    assert batch == stream and batch


def test_the_auctions_winning_bids_as_a_stream(spark, tmp_path, sf_dir):
    """nx_q9: a window over a join in time."""
    def ask(table):
        o = table(folder(spark, tmp_path, sf_dir, "orders"), "orders", TABLES["orders"], "o_orderdate", F.col("o_orderkey").alias("orderkey"), "o_orderdate")
        l = table(folder(spark, tmp_path, sf_dir, "lineitem"), "lineitem", TABLES["lineitem"], "l_shipdate", F.col("l_orderkey").alias("orderkey"), "l_extendedprice", "l_shipdate")  # noqa: E741
        joined = o.join(l, ["orderkey"], Interval(Duration.days(0), Duration.days(730)))
        return joined.group_by("orderkey", window=Window.createTBWindow(Duration.days(180))).select("orderkey", max("l_extendedprice").alias("best"))

    batch, stream = both(spark, tmp_path, ask, ("1992-01-01T00:00:00.000Z", TimeFormats.ISO8601))
    assert batch == stream and batch
