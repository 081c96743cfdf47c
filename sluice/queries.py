"""Queries over the driver's tables, each with its SQL twin.

Sums of doubles are cast to cents, or rounded, before they are compared, and
times are given as microseconds since the epoch.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import avg, col, count, lit, max, min, neg, sum
from .operators import EVENT_TIME, joins, ranks, rows
from .operators.aggregates import Part
from .plans import Table, TableEnvironment
from .plans.env import instant
from .time import Duration, Interval, TimePolicy, Window
from .types import DataTypes, TimeFormats

EVENTS_BASE = "2024-01-01T00:00:00.000Z"
ORDERS_BASE = "1995-01-01T00:00:00.000Z"
H = 3_600_000_000

#: Declared schemas of the driver's tables: sources declare what they hold, so nothing is inferred.
TABLES = {
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


_RUNS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        _RUNS[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def plain(spark: SparkSession, **options) -> TableEnvironment:
    return TableEnvironment(spark, **options)


def timed(spark: SparkSession, base: str = EVENTS_BASE, **options) -> TableEnvironment:
    return TableEnvironment(spark, policy=TimePolicy.EVENT_TIME, time_baseline=(base, TimeFormats.ISO8601), **options)


def table(env: TableEnvironment, sf_dir: str, name: str, *columns: str, time_col: str | None = None) -> Table:
    df = read(env.spark, sf_dir, name)
    return env.table_from_dataframe(df.select(*columns) if columns else df, time_col=time_col)


def with_time(t: Table) -> DataFrame:
    """Visible columns and the event time in microseconds as t_us."""
    return t.dataframe(event_time=True).withColumn("t_us", F.unix_micros(EVENT_TIME)).drop(EVENT_TIME)


def cents(name: str) -> object:
    return F.round(F.col(name) * 100).cast("long")


def events(env: TableEnvironment, sf_dir: str, *columns: str) -> Table:
    """events with the value in whole cents."""
    df = read(env.spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", cents("value").alias("cents")
    )
    return env.table_from_dataframe(df.select(*columns) if columns else df, time_col="ts" if env.policy is TimePolicy.EVENT_TIME else None)


EV = "(select event_id, ts, user_id, event_type, cast(round(value * 100) as bigint) as cents from events)"
US = "(epoch_us(ts) - epoch_us(timestamp '2024-01-01'))"


# -- projection, filter, schema edits ----------------------------------------
@query("select l_orderkey, l_linenumber, l_quantity * 2.0 as double_qty, l_linenumber + 10 as line_plus, l_extendedprice - l_discount as diff from lineitem")
def project_arith(spark, sf_dir):
    t = table(plain(spark), sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    return t.select(
        "l_orderkey", "l_linenumber", (col("l_quantity") * 2.0).alias("double_qty"), (col("l_linenumber") + 10).alias("line_plus"),
        (col("l_extendedprice") - col("l_discount")).alias("diff"),
    ).dataframe()


@query("select o_orderkey, o_totalprice from orders where o_orderkey = 1 or o_orderkey = 7 or o_orderkey = 20 or o_orderkey = 101 or o_orderkey = 207")
def filter_or(spark, sf_dir):
    t = table(plain(spark), sf_dir, "orders", "o_orderkey", "o_totalprice")
    keys = [1, 7, 20, 101, 207]
    condition = col("o_orderkey") == keys[0]
    for k in keys[1:]:
        condition = condition | (col("o_orderkey") == k)
    return t.where(condition).select("o_orderkey", "o_totalprice").dataframe()


@query("select o_orderkey, o_custkey, o_totalprice * 0.87 as price_eur from orders")
def dollar_to_euro(spark, sf_dir):
    return table(plain(spark), sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice").select("o_orderkey", "o_custkey", (col("o_totalprice") * 0.87).alias("price_eur")).dataframe()


@query("select p_partkey, cast(p_size // 7 as integer) as size_div, cast(-(p_size // 7) as integer) as neg_div, p_partkey // 3 as key_div from part")
def int_division(spark, sf_dir):
    t = table(plain(spark), sf_dir, "part", "p_partkey", "p_size")
    return t.select("p_partkey", (col("p_size") / 7).alias("size_div"), ((0 - col("p_size")) / 7).alias("neg_div"), (col("p_partkey") / 3).alias("key_div")).dataframe()


@query("select o_orderkey, not (o_orderstatus = 'O') as not_open, (o_orderstatus = 'O' and o_totalprice > 1000.0) as big_open from orders where not (o_orderstatus = 'F') and (o_totalprice < 200000.0 or o_custkey <> 3)")
def not_and_or(spark, sf_dir):
    t = table(plain(spark), sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    is_open = col("o_orderstatus") == "O"
    return t.where(neg(col("o_orderstatus") == "F") & ((col("o_totalprice") < 200000.0) | (col("o_custkey") != 3))).select(
        "o_orderkey", (~is_open).alias("not_open"), (is_open & (col("o_totalprice") > 1000.0)).alias("big_open")
    ).dataframe()


@query("select p_partkey as id, p_brand, p_retailprice, p_retailprice * 2.0 as twice from part where p_size >= 10")
def rename_drop_add(spark, sf_dir):
    t = table(plain(spark), sf_dir, "part", "p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    kept = t.where(col("p_size") >= 10).drop_columns("p_type", "p_size")
    return kept.rename_columns({"p_partkey": "id"}).add_columns((col("p_retailprice") * 2.0).alias("twice")).dataframe()


# -- aggregation -------------------------------------------------------------
@query(f"select count(*) as n, cast(sum(cents) as bigint) as total, min(cents) as lowest, max(cents) as highest from {EV}")
def agg_all(spark, sf_dir):
    return events(plain(spark), sf_dir).select(count().alias("n"), sum("cents").alias("total"), min("cents").alias("lowest"), max("cents").alias("highest")).dataframe()


@query("select l_returnflag, l_linestatus, count(*) as n, min(l_quantity) as lo, max(l_extendedprice) as hi, cast(sum(cast(l_quantity as bigint)) as bigint) as qty from lineitem group by all")
def agg_keyed(spark, sf_dir):
    env = plain(spark)
    df = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", F.col("l_quantity").cast("long").alias("q"))
    return env.table_from_dataframe(df).group_by("l_returnflag", "l_linestatus").select(
        "l_returnflag", "l_linestatus", count().alias("n"), min("l_quantity").alias("lo"), max("l_extendedprice").alias("hi"), sum("q").alias("qty")
    ).dataframe()


@query(f"select user_id, cast(sum(cents * 3 + user_id) as bigint) as weighted, max(cents - user_id) as top from {EV} group by user_id")
def agg_expr(spark, sf_dir):
    return events(plain(spark), sf_dir).group_by("user_id").select("user_id", sum(col("cents") * 3 + col("user_id")).alias("weighted"), max(col("cents") - col("user_id")).alias("top")).dataframe()


@query("select p_brand, avg(p_size) as mean_size from part group by p_brand")
def avg_int(spark, sf_dir):
    return table(plain(spark), sf_dir, "part", "p_brand", "p_size").group_by("p_brand").select("p_brand", avg("p_size").alias("mean_size")).dataframe()


@query(f"select event_type, max(cents) - min(cents) as spread, cast(sum(cents) // count(*) as bigint) as mean_cents, count(*) + 1 as n1 from {EV} group by event_type")
def agg_arith(spark, sf_dir):
    return events(plain(spark), sf_dir).group_by("event_type").select(
        "event_type", (max("cents") - min("cents")).alias("spread"), (sum("cents") / count()).alias("mean_cents"), (count() + 1).alias("n1")
    ).dataframe()


@query("select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12")
def having(spark, sf_dir):
    counts = table(plain(spark), sf_dir, "orders", "o_custkey").group_by("o_custkey").select("o_custkey", count().alias("n"))
    return counts.where(col("n") > 12).dataframe()


@query("select distinct o_custkey, o_orderstatus from orders")
def group_without_aggregates(spark, sf_dir):
    return table(plain(spark), sf_dir, "orders", "o_custkey", "o_orderstatus").group_by("o_custkey", "o_orderstatus").select("o_custkey", "o_orderstatus").dataframe()


# -- distinct and sets -------------------------------------------------------
@query("select distinct o_orderstatus, o_orderpriority from orders")
def distinct_rows(spark, sf_dir):
    return table(plain(spark), sf_dir, "orders", "o_orderstatus", "o_orderpriority").distinct().dataframe()


@query("select distinct l_linenumber * 2 as twice, l_returnflag from lineitem")
def select_distinct(spark, sf_dir):
    return table(plain(spark), sf_dir, "lineitem", "l_linenumber", "l_returnflag").select((col("l_linenumber") * 2).alias("twice"), "l_returnflag", distinct=True).dataframe()


def _nations(env, sf_dir):
    c = table(env, sf_dir, "customer", "c_nationkey", "c_custkey").select(col("c_nationkey").alias("nation"), col("c_custkey").alias("key"))
    s = table(env, sf_dir, "supplier", "s_nationkey", "s_suppkey").select(col("s_suppkey").alias("key"), col("s_nationkey").alias("nation"))
    return c, s


C, S = "select c_nationkey as nation, c_custkey as key from customer", "select s_nationkey as nation, s_suppkey as key from supplier"


@query(f"{C} union all {S}")
def union_all(spark, sf_dir):
    c, s = _nations(plain(spark), sf_dir)
    return c.union_all(s).dataframe()


@query(f"select nation from ({C}) union select nation from ({S})")
def union(spark, sf_dir):
    c, s = _nations(plain(spark), sf_dir)
    return c.select("nation").union(s.select("nation")).dataframe()


@query(f"select nation from ({C}) intersect select nation from ({S})")
def intersect(spark, sf_dir):
    c, s = _nations(plain(spark), sf_dir)
    return c.select("nation").intersect(s.select("nation")).dataframe()


@query(f"select nation from ({C}) intersect all select nation from ({S})")
def intersect_all(spark, sf_dir):
    c, s = _nations(plain(spark), sf_dir)
    return c.select("nation").intersect_all(s.select("nation")).dataframe()


@query(f"{C} intersect {S}")
def setop_reordered_cols(spark, sf_dir):
    c, s = _nations(plain(spark), sf_dir)
    return c.intersect(s).dataframe()


# -- time windows ------------------------------------------------------------
def _slide_sql(keys: str, values: str, size: int, slide: int) -> str:
    by = f"{keys}, " if keys else ""
    return f"""select {by}{values}, k * {slide} + {size} - 1 + epoch_us(timestamp '2024-01-01') as t_us
      from (select *, {US} as t from {EV}) e, lateral (select unnest(generate_series(
        greatest(0, cast(floor((t - {size}) / {slide}.0) + 1 as bigint)), cast(floor(t / {slide}.0) as bigint))) as k) g
      group by {by}k"""


@query(_slide_sql("user_id", "count(*) as n", 12 * H, 12 * H))
def tumble_count(spark, sf_dir):
    return with_time(events(timed(spark), sf_dir).group_by("user_id", window=Window.createTBWindow(Duration.hours(12))).select("user_id", count().alias("n")))


@query(_slide_sql("event_type", "cast(sum(cents) as bigint) as total, min(cents) as lo, max(cents) as hi", 24 * H, 6 * H))
def slide_sum(spark, sf_dir):
    w = Window.createTBWindow(Duration.hours(24), Duration.hours(6))
    return with_time(events(timed(spark), sf_dir).group_by("event_type", window=w).select("event_type", sum("cents").alias("total"), min("cents").alias("lo"), max("cents").alias("hi")))


#: Windows of a day that begin every second, over a grid of seconds; summed up by the hour they begin in.
_WIDE_SQL = f"""with p as (select {US} // 1000000 as s, count(*) as n, sum(cents) as total, min(cents) as lo, max(cents) as hi from {EV} group by all),
  g as (select unnest(range(greatest((select min(s) from p) - 86399, 0), (select max(s) from p) + 1)) as k),
  w as (select k, sum(n) over o as n, sum(total) over o as total, min(lo) over o as lo, max(hi) over o as hi from g left join p on s = k
        window o as (order by k range between current row and 86399 following))
  select k // 3600 as hour, count(*) as windows, cast(sum(n) as bigint) as n, cast(sum(total) as bigint) as total, min(lo) as lo, max(lo) as top_lo, max(hi) as hi, min(hi) as low_hi
  from w where n > 0 group by all"""


@query(_WIDE_SQL)
def wide_slide(spark, sf_dir):
    window = Window.createTBWindow(Duration.hours(24), Duration.seconds(1))
    w = events(timed(spark), sf_dir).group_by(window=window).select(count().alias("n"), sum("cents").alias("total"), min("cents").alias("lo"), max("cents").alias("hi"))
    first = (F.unix_micros(EVENT_TIME) + 1 - 24 * H - 1_704_067_200_000_000) / 1_000_000
    hours = w.dataframe(event_time=True).withColumn("hour", F.floor(first / 3600)).groupBy("hour")
    return hours.agg(F.count(F.lit(1)).alias("windows"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("lo").alias("lo"), F.max("lo").alias("top_lo"), F.max("hi").alias("hi"), F.min("hi").alias("low_hi"))


@query(_slide_sql("", "count(*) as n", 10 * H, 4 * H))
def slide_uneven(spark, sf_dir):
    return with_time(events(timed(spark), sf_dir).group_by(window=Window.createTBWindow(Duration.hours(10), Duration.hours(4))).select(count().alias("n")))


@query(f"""select user_id, count(*) as n, round(avg(cents), 6) as mean, (t // {24 * H}) * {24 * H} + {6 * H} - 1 + epoch_us(timestamp '2024-01-01') as t_us
  from (select *, {US} as t from {EV}) where t % {24 * H} < {6 * H} group by user_id, t // {24 * H}""")
def hop_avg(spark, sf_dir):
    w = Window.createTBWindow(Duration.hours(6), Duration.hours(24))
    found = events(timed(spark), sf_dir).group_by("user_id", window=w).select("user_id", count().alias("n"), avg("cents").alias("mean"))
    return with_time(found).withColumn("mean", F.round("mean", 6))


@query(_slide_sql("", "count(*) as n, cast(sum(cents) as bigint) as total", 24 * H, 24 * H))
def tumble_keyless(spark, sf_dir):
    return with_time(events(timed(spark), sf_dir).group_by(window=Window.createTBWindow(Duration.days(1))).select(count().alias("n"), sum("cents").alias("total")))


@query(f"""with w as (select user_id, {US} // {6 * H} as k, count(*) as n, cast(sum(cents) as bigint) as total, max(cents) as hi from {EV} group by all),
  d as (select user_id, unnest(generate_series(0, max(k))) as k from w group by user_id)
  select d.user_id, coalesce(n, 0) as n, coalesce(total, 0) as total, coalesce(hi, -1) as hi, d.k * {6 * H} + {6 * H} - 1 + epoch_us(timestamp '2024-01-01') as t_us
  from d left join w on d.user_id = w.user_id and d.k = w.k""")
def tumble_dense(spark, sf_dir):
    env = timed(spark, emit_empty=True)
    return with_time(events(env, sf_dir).group_by("user_id", window=Window.createTBWindow(Duration.hours(6))).select("user_id", count().alias("n"), sum("cents").alias("total"), max("cents").alias("hi"))).fillna(-1, ["hi"])


@query(f"""select event_type, count(*) as n, epoch_us(time_bucket(interval 12 hour, ts, timestamp '2024-01-01 03:00:00')) + {12 * H} - 1 as t_us
  from (select event_type, greatest(ts, timestamp '2024-01-01 03:00:00') as ts from events) group by all""")
def tumble_offset_baseline(spark, sf_dir):
    env = timed(spark, "2024-01-01T03:00:00.000Z")
    return with_time(events(env, sf_dir).group_by("event_type", window=Window.createTBWindow(Duration.hours(12))).select("event_type", count().alias("n")))


# -- count windows -----------------------------------------------------------
def _count_sql(size: int, slide: int) -> str:
    return f"""select user_id, count(*) as n, cast(sum(cents) as bigint) as total, max(epoch_us(ts)) as t_us
      from (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as i from {EV}) e,
      lateral (select unnest(generate_series(greatest(0, cast(floor((i - {size}) / {slide}.0) + 1 as bigint)), i // {slide})) as k) g
      group by user_id, k"""


def _count_windows(spark, sf_dir, size, slide):
    w = Window.createCBWindow(size, slide)
    return with_time(events(timed(spark), sf_dir).group_by("user_id", window=w).select("user_id", count().alias("n"), sum("cents").alias("total")))


@query(_count_sql(10, 10))
def cb_tumble(spark, sf_dir):
    return _count_windows(spark, sf_dir, 10, 10)


@query(_count_sql(12, 5))
def cb_slide(spark, sf_dir):
    return _count_windows(spark, sf_dir, 12, 5)


@query(_count_sql(4, 9))
def cb_hop(spark, sf_dir):
    return _count_windows(spark, sf_dir, 4, 9)


# -- joins -------------------------------------------------------------------
def _orders_lines(env, sf_dir):
    o = table(env, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", time_col="o_orderdate")
    l = table(env, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate", time_col="l_shipdate")  # noqa: E741
    return o.rename_columns({"o_orderkey": "orderkey"}), l.rename_columns({"l_orderkey": "orderkey"})


OL = "from orders join lineitem on o_orderkey = l_orderkey and l_shipdate between o_orderdate - interval '{0} days' and o_orderdate + interval '{1} days'"


@query("select o_orderkey as orderkey, o_custkey, l_linenumber, l_extendedprice, greatest(epoch_us(o_orderdate), epoch_us(l_shipdate)) as t_us " + OL.format(0, 730))
def interval_join(spark, sf_dir):
    o, l = _orders_lines(timed(spark, ORDERS_BASE), sf_dir)  # noqa: E741
    return with_time(o.join(l, ["orderkey"], Interval(Duration.days(0), Duration.days(730))).select("orderkey", "o_custkey", "l_linenumber", "l_extendedprice"))


@query("select o_orderkey as orderkey, l_linenumber, o_totalprice " + OL.format(365, 365) + " where l_extendedprice * 3.0 > o_totalprice")
def interval_theta(spark, sf_dir):
    o, l = _orders_lines(timed(spark, ORDERS_BASE), sf_dir)  # noqa: E741
    joined = o.join(l, ["orderkey"], Interval(Duration.days(-365), Duration.days(365)), where=col("l_extendedprice") * 3.0 > col("o_totalprice"))
    return joined.select("orderkey", "l_linenumber", "o_totalprice").dataframe()


def _two_kinds(env, sf_dir, left: str, right: str):
    e = events(env, sf_dir, "event_id", "ts", "user_id", "event_type", "cents")
    a = e.where(col("event_type") == left).select(col("event_id").alias("a_id"), "user_id", col("cents").alias("a_cents"))
    b = e.where(col("event_type") == right).select(col("event_id").alias("b_id"), "user_id", col("cents").alias("b_cents"))
    return a, b


PAIR = f"from {EV} a, {EV} b where a.event_type = '{{0}}' and b.event_type = '{{1}}'"


@query(f"select a.event_id as a_id, b.event_id as b_id, a.user_id as user_id, b.user_id as other {PAIR.format('click', 'purchase')} and b.ts between a.ts - interval 10 minute and a.ts + interval 20 minute and b.cents > a.cents")
def theta_only_band(spark, sf_dir):
    a, b = _two_kinds(timed(spark), sf_dir, "click", "purchase")
    joined = a.join(b.rename_columns({"user_id": "other"}), [], Interval(Duration.minutes(-10), Duration.minutes(20)), where=col("b_cents") > col("a_cents"))
    return joined.select("a_id", "b_id", "user_id", "other").dataframe()


@query(f"select a.event_id as a_id, b.event_id as b_id, a.user_id as user_id, a.event_type as event_type from {EV} a join {EV} b on a.user_id = b.user_id and a.event_type = b.event_type and b.ts between a.ts + interval 1 hour and a.ts + interval 30 hour")
def interval_multikey(spark, sf_dir):
    e = events(timed(spark), sf_dir)
    a = e.select(col("event_id").alias("a_id"), "user_id", "event_type")
    b = e.select(col("event_id").alias("b_id"), "event_type", "user_id")
    return a.join(b, ["user_id", "event_type"], Interval(Duration.hours(1), Duration.hours(30))).select("a_id", "b_id", "user_id", "event_type").dataframe()


def _window_join_sql(size: int, slide: int) -> str:
    ks = f"lateral (select unnest(generate_series(cast(floor((t - {size}) / {slide}.0) + 1 as bigint), cast(floor(t / {slide}.0) as bigint))) as k)"
    side = f"(select *, {US} as t from {EV} where event_type = '{{0}}') {{1}}, {ks} {{1}}k"
    return f"""select x.user_id as user_id, x.event_id as a_id, y.event_id as b_id, x.k * {slide} + {size} - 1 + epoch_us(timestamp '2024-01-01') as t_us
      from (select * from {side.format('click', 'a')}) x join (select * from {side.format('purchase', 'b')}) y on x.user_id = y.user_id and x.k = y.k"""


def _window_join(spark, sf_dir, window):
    a, b = _two_kinds(timed(spark), sf_dir, "click", "purchase")
    return with_time(a.join(b, ["user_id"], window).select("user_id", "a_id", "b_id"))


@query(_window_join_sql(12 * H, 12 * H))
def window_join_tumble(spark, sf_dir):
    return _window_join(spark, sf_dir, Window.createTBWindow(Duration.hours(12)))


@query(_window_join_sql(12 * H, 4 * H))
def window_join_slide(spark, sf_dir):
    return _window_join(spark, sf_dir, Window.createTBWindow(Duration.hours(12), Duration.hours(4)))


# -- running aggregates ------------------------------------------------------
@query(f"select user_id, cast(sum(cents) over w as bigint) as total, count(*) over w as n, max(cents) over w as hi, epoch_us(ts) as t_us from {EV} window w as (partition by user_id order by ts, event_id rows unbounded preceding)")
def running_sum(spark, sf_dir):
    return with_time(events(timed(spark, aggregates="running"), sf_dir).group_by("user_id").select("user_id", sum("cents").alias("total"), count().alias("n"), max("cents").alias("hi")))


@query(f"select cast(sum(cents) over w as bigint) as total, min(cents) over w as lo, epoch_us(ts) as t_us from {EV} window w as (order by ts, event_id rows unbounded preceding)")
def running_keyless(spark, sf_dir):
    return with_time(events(timed(spark, aggregates="running"), sf_dir).select(sum("cents").alias("total"), min("cents").alias("lo")))


# -- the auction benchmark's shapes ------------------------------------------
@query(f"""with n as (select user_id, {US} // {12 * H} as k, count(*) as hits from {EV} group by all), m as (select k, max(hits) as hits from n group by k)
  select n.user_id as user_id, n.hits as hits from n join m on n.k = m.k and n.hits = m.hits""")
def nx_q5(spark, sf_dir):
    window = Window.createTBWindow(Duration.hours(12))
    counts = events(timed(spark), sf_dir).group_by("user_id", window=window).select("user_id", count().alias("hits"))
    most = counts.group_by(window=window).select(max("hits").alias("hits"))
    return counts.join(most, ["hits"], Interval(Duration.hours(0), Duration.hours(0))).select("user_id", "hits").dataframe()


@query("select l_orderkey, l_extendedprice * 0.87 as price_eur, l_suppkey, epoch_us(l_shipdate) as shipped from lineitem")
def nx_q1(spark, sf_dir):
    t = table(timed(spark, ORDERS_BASE), sf_dir, "lineitem", "l_orderkey", "l_extendedprice", "l_suppkey", "l_shipdate", time_col="l_shipdate")
    q = t.select("l_orderkey", (col("l_extendedprice") * 0.87).alias("price_eur"), "l_suppkey", "l_shipdate")
    return q.dataframe().withColumn("shipped", F.unix_micros("l_shipdate")).drop("l_shipdate")


@query("select l_partkey, l_extendedprice from lineitem where l_partkey in (7, 20, 101, 119, 187)")
def nx_q2(spark, sf_dir):
    t = table(plain(spark), sf_dir, "lineitem", "l_partkey", "l_extendedprice")
    condition = col("l_partkey") == 7
    for k in (20, 101, 119, 187):
        condition = condition | (col("l_partkey") == k)
    return t.where(condition).select("l_partkey", "l_extendedprice").dataframe()


@query("select c_name, c_mktsegment, o_orderkey from customer join orders on c_custkey = o_custkey where (c_mktsegment = 'BUILDING' or c_mktsegment = 'MACHINERY') and o_orderstatus = 'O'")
def nx_q3(spark, sf_dir):
    env = plain(spark)
    c = table(env, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment")
    o = table(env, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    chosen = c.where((col("c_mktsegment") == "BUILDING") | (col("c_mktsegment") == "MACHINERY"))
    opened = o.where(col("o_orderstatus") == "O").rename_columns({"o_custkey": "c_custkey"})
    return chosen.join(opened, ["c_custkey"]).select("c_name", "c_mktsegment", "o_orderkey").dataframe()


@query(f"select a.user_id as user_id, a.event_id as a_id, b.event_id as b_id, b.cents as b_cents from {EV} a join {EV} b on a.user_id = b.user_id where a.event_type = 'signup' and b.event_type = 'purchase' and b.ts between a.ts - interval 1 minute and a.ts + interval 12 hour")
def nx_q8(spark, sf_dir):
    a, b = _two_kinds(timed(spark), sf_dir, "signup", "purchase")
    return a.join(b, ["user_id"], Interval(Duration.minutes(-1), Duration.hours(12))).select("user_id", "a_id", "b_id", "b_cents").dataframe()


def _q9(days: int) -> str:
    return f"""select o_orderkey as orderkey, max(l_extendedprice) as best, k * 15552000000000 + 15552000000000 - 1 + epoch_us(timestamp '1995-01-01') as t_us from (
      select o_orderkey, l_extendedprice, (greatest(epoch_us(o_orderdate), epoch_us(l_shipdate)) - epoch_us(timestamp '1995-01-01')) // 15552000000000 as k {OL.format(0, days)}
      and l_extendedprice > 0) group by o_orderkey, k"""


@query(_q9(730))
def nx_q9(spark, sf_dir):
    o, l = _orders_lines(timed(spark, ORDERS_BASE), sf_dir)  # noqa: E741
    joined = o.join(l, ["orderkey"], Interval(Duration.days(0), Duration.days(730)), where=col("l_extendedprice") > 0)
    return with_time(joined.group_by("orderkey", window=Window.createTBWindow(Duration.days(180))).select("orderkey", max("l_extendedprice").alias("best")))


# one ingress time for a batch, so one window
@query("select user_id, count(*) as processed from events group by user_id")
def nx_q12(spark, sf_dir):
    env = TableEnvironment(spark, policy=TimePolicy.INGRESS_TIME)
    return events(env, sf_dir, "user_id", "cents").group_by("user_id", window=Window.createTBWindow(Duration.seconds(1))).select("user_id", count().alias("processed")).dataframe()


@query("select o_orderkey as orderkey, o_custkey, o_totalprice, epoch_us(o_orderdate) as ordered, l_linenumber, l_extendedprice, epoch_us(l_shipdate) as shipped " + OL.format(1, 365) + " where o_orderstatus = 'O'")
def nx_q20(spark, sf_dir):
    env = timed(spark, ORDERS_BASE)
    o = table(env, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus", time_col="o_orderdate")
    l = table(env, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate", time_col="l_shipdate")  # noqa: E741
    opened = o.where(col("o_orderstatus") == "O").drop_columns("o_orderstatus").rename_columns({"o_orderkey": "orderkey"})
    joined = opened.join(l.rename_columns({"l_orderkey": "orderkey"}), ["orderkey"], Interval(Duration.days(-1), Duration.days(365)))
    return joined.dataframe().withColumn("ordered", F.unix_micros("o_orderdate")).withColumn("shipped", F.unix_micros("l_shipdate")).drop("o_orderdate", "l_shipdate")


# -- building blocks ---------------------------------------------------------
def _event_rows(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", cents("value").alias("cents"), "ts"
    ).withColumn(EVENT_TIME, instant(spark, "ts", T.TimestampNTZType())).drop("ts")


@query(f"select event_id, cents * 3 as tripled from {EV} where cents % 2 = 0")
def map_filter(spark, sf_dir):
    kept = rows.filter_rows(_event_rows(spark, sf_dir), F.col("cents") % 2 == 0)
    return rows.map_rows(kept, {"event_id": F.col("event_id"), "tripled": F.col("cents") * 3})


@query("select doc_id, unnest(string_split(lang || ' ' || source || ' ' || cast(n_chars as varchar), ' ')) as piece from documents")
def flat_map(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return rows.flat_map(docs, F.split(F.concat_ws(" ", "lang", "source", "n_chars"), " "), name="piece").select("doc_id", "piece")


def _fold_step(row: dict, state: dict) -> dict:
    return {"event_id": row["event_id"], "balance": max_of(state["balance"] + row["cents"] - 5000, 0)}


def max_of(a: int, b: int) -> int:
    return a if a > b else b


@query(f"""with recursive o as (select *, row_number() over (partition by user_id order by ts, event_id) as i from {EV}),
  f as (select user_id, event_id, i, greatest(100 + cents - 5000, 0) as balance from o where i = 1
  union all select o.user_id, o.event_id, o.i, greatest(f.balance + o.cents - 5000, 0) from f join o on o.user_id = f.user_id and o.i = f.i + 1)
  select user_id, event_id, balance from f""")
def fold_init(spark, sf_dir):
    return rows.reduce_rows(_event_rows(spark, sf_dir), ["user_id"], [EVENT_TIME, "event_id"], _fold_step, {"event_id": 0, "balance": 100}, "user_id long, event_id long, balance long")


def _first_last(of: dict[str, np.ndarray]) -> dict:
    values = np.sort(of["cents"])  # nulls are NaN and the last
    n = len(values) if values.dtype.kind == "i" else int((values == values).sum())
    middle = (float(values[(n - 1) // 2]) + float(values[n // 2])) / 2 if n else None
    return {"first_id": int(of["event_id"][0]), "last_id": int(of["event_id"][-1]), "median": middle}


@query(f"""select user_id, {US} // {48 * H} as window_id, arg_min(event_id, ts) as first_id, arg_max(event_id, ts) as last_id, median(cents) as "median" from {EV} group by user_id, {US} // {48 * H}""")
def window_iterable(spark, sf_dir):
    base = 1_704_067_200_000_000
    return rows.keyed_windows(_event_rows(spark, sf_dir), ["user_id"], Window.createTBWindow(Duration.hours(48)), base, _first_last, "user_id long, window_id long, first_id long, last_id long, median double", arrays=True)


_PARTS = lambda: [Part("n", F.count(F.lit(1)), "sum"), Part("total", F.sum("cents"), "sum"), Part("hi", F.max("cents"), "max")]


def _window_parts_sql(size: int, slide: int) -> str:
    return f"""select user_id, k as window_id, count(*) as n, cast(sum(cents) as bigint) as total, max(cents) as hi from (select *, {US} as t from {EV}) e,
      lateral (select unnest(generate_series(greatest(0, cast(floor((t - {size}) / {slide}.0) + 1 as bigint)), cast(floor(t / {slide}.0) as bigint))) as k) g group by user_id, k"""


@query(_window_parts_sql(24 * H, 2 * H))
def pane_slide(spark, sf_dir):
    return rows.paned_windows(_event_rows(spark, sf_dir), ["user_id"], Window.createTBWindow(Duration.hours(24), Duration.hours(2)), 1_704_067_200_000_000, _PARTS())


@query(_window_parts_sql(24 * H, 24 * H))
def two_phase_window(spark, sf_dir):
    return rows.two_phase_windows(_event_rows(spark, sf_dir), ["user_id"], Window.createTBWindow(Duration.hours(24)), 1_704_067_200_000_000, _PARTS())


@query(f"select user_id, window_id, total - n as value from ({_window_parts_sql(24 * H, 6 * H)})")
def tree_window(spark, sf_dir):
    return rows.tree_windows(_event_rows(spark, sf_dir), ["user_id"], Window.createTBWindow(Duration.hours(24), Duration.hours(6)), 1_704_067_200_000_000, F.col("cents") - 1, lambda a, b: a + b)


# -- count windows of the building blocks; rows without a time or a key ----------
def _cb_rows_sql(size: int, slide: int, values: str, source: str = EV, by: str = "ts, event_id") -> str:
    return f"""select user_id, k as window_id, {values} from (select *, row_number() over (partition by user_id order by {by}) - 1 as i from {source}) e,
      lateral (select unnest(generate_series(greatest(0, cast(floor((i - {size}) / {slide}.0) + 1 as bigint)), i // {slide})) as k) g group by user_id, k"""


@query(_cb_rows_sql(10, 10, 'arg_min(event_id, i) as first_id, arg_max(event_id, i) as last_id, median(cents) as "median"'))
def kw_cb(spark, sf_dir):
    return rows.keyed_windows(_event_rows(spark, sf_dir), ["user_id"], Window.createCBWindow(10), 0, _first_last, "user_id long, window_id long, first_id long, last_id long, median decimal(20,1)", ["event_id"], arrays=True).withColumn("median", F.col("median").cast("double"))


def _sum_step(row: dict, state: dict) -> dict:
    return {"n": state["n"] + 1, "total": state["total"] + row["cents"], "last_id": row["event_id"]}


@query(_cb_rows_sql(12, 5, "count(*) as n, cast(sum(cents) as bigint) as total, arg_max(event_id, i) as last_id"))
def kw_cb_incremental(spark, sf_dir):
    w = Window.createCBWindow(12, 5)
    return rows.fold_windows(_event_rows(spark, sf_dir), ["user_id"], w, 0, _sum_step, {"n": 0, "total": 0, "last_id": -1}, "user_id long, window_id long, n long, total long, last_id long", ["event_id"])


@query(f"""select user_id, k as window_id, count(*) as n, cast(sum(cents) as bigint) as total, arg_max(event_id, ts) as last_id from (select *, {US} as t from {EV}) e,
  lateral (select unnest(generate_series(greatest(0, cast(floor((t - {48 * H}) / {24 * H}.0) + 1 as bigint)), cast(floor(t / {24 * H}.0) as bigint))) as k) g group by user_id, k""")
def kw_tb_incremental(spark, sf_dir):
    w = Window.createTBWindow(Duration.hours(48), Duration.hours(24))
    return rows.fold_windows(_event_rows(spark, sf_dir), ["user_id"], w, 1_704_067_200_000_000, _sum_step, {"n": 0, "total": 0, "last_id": -1}, "user_id long, window_id long, n long, total long, last_id long", ["event_id"])


_PART_VALUES = "count(*) as n, cast(sum(cents) as bigint) as total, max(cents) as hi"


@query(_cb_rows_sql(12, 4, _PART_VALUES))
def paw_cb(spark, sf_dir):
    return rows.paned_windows(_event_rows(spark, sf_dir), ["user_id"], Window.createCBWindow(12, 4), 0, _PARTS(), ["event_id"])


@query(_cb_rows_sql(20, 20, _PART_VALUES))
def mrw_cb(spark, sf_dir):
    return rows.two_phase_windows(_event_rows(spark, sf_dir), ["user_id"], Window.createCBWindow(20), 0, _PARTS(), order=["event_id"])


@query(_cb_rows_sql(12, 3, "string_agg(cast(event_id as varchar), '-' order by i) as value"))
def fat_cb(spark, sf_dir):
    w = Window.createCBWindow(12, 3)
    return rows.tree_windows(_event_rows(spark, sf_dir), ["user_id"], w, 0, F.col("event_id").cast("string"), lambda a, b: F.concat(a, F.lit("-"), b), order=["event_id"])


def _gaps(spark, sf_dir) -> DataFrame:
    """Events of which some have no time and some no user."""
    df = _event_rows(spark, sf_dir)
    return df.withColumn(EVENT_TIME, F.when(F.col("event_id") % 7 != 0, F.col(EVENT_TIME))).withColumn("user_id", F.when(F.col("event_id") % 5 != 0, F.col("user_id")))


GAPS = f"(select event_id, event_type, cents, case when event_id % 7 <> 0 then ts end as ts, case when event_id % 5 <> 0 then user_id end as user_id from {EV})"


@query(f"select event_id, user_id, cast(sum(cents) over w as bigint) as total, count(*) over w as n from {GAPS} window w as (partition by user_id order by ts nulls first, event_id rows unbounded preceding)")
def running_nulls(spark, sf_dir):
    parts = [Part("total", F.sum("cents"), "sum"), Part("n", F.count(F.lit(1)), "sum")]
    return ranks.with_running(_gaps(spark, sf_dir), ["user_id"], ["event_id"], parts).select("event_id", "user_id", "total", "n")


@query(_cb_rows_sql(12, 5, _PART_VALUES, GAPS, "ts nulls first, event_id"))
def cb_nulls(spark, sf_dir):
    return rows.paned_windows(_gaps(spark, sf_dir), ["user_id"], Window.createCBWindow(12, 5), 0, _PARTS(), ["event_id"])


@query(f"select user_id, event_id, sum(cents) over (partition by user_id order by ts nulls first, event_id rows unbounded preceding) % 100000 as balance from {GAPS}")
def fold_nulls(spark, sf_dir):
    step = lambda row, state: {"event_id": row["event_id"], "balance": (state["balance"] + row["cents"]) % 100_000}
    return rows.reduce_rows(_gaps(spark, sf_dir), ["user_id"], [EVENT_TIME, "event_id"], step, {"event_id": 0, "balance": 0}, "user_id long, event_id long, balance decimal(20,0)").withColumn("balance", F.col("balance").cast("long"))


@query(f"select a.event_id as a_id, b.event_id as b_id, b.cents - a.cents as gain {PAIR.format('click', 'purchase')} and a.user_id = b.user_id and b.ts between a.ts - interval 2 hour and a.ts + interval 6 hour and b.cents > a.cents")
def join_with_function(spark, sf_dir):
    pick = lambda r: {"a_id": r["a_id"], "b_id": r["b_id"], "gain": r["b_cents"] - r["a_cents"]} if r["b_cents"] > r["a_cents"] else None
    df = _event_rows(spark, sf_dir)
    a = df.where("event_type = 'click'").select("user_id", F.col("event_id").alias("a_id"), F.col("cents").alias("a_cents"), EVENT_TIME)
    b = df.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("b_id"), F.col("cents").alias("b_cents"), EVENT_TIME)
    return joins.interval_join_with(a, b, ["user_id"], Interval(Duration.hours(-2), Duration.hours(6)), pick, "a_id long, b_id long, gain long")


@query(f"select event_id, 0 as branch from {EV} where cents % 3 in (0, 2) union all select event_id, 1 as branch from {EV} where cents % 3 = 2")
def split_merge(spark, sf_dir):
    df = _event_rows(spark, sf_dir)
    route = F.when(F.col("cents") % 3 == 0, F.array(F.lit(0))).when(F.col("cents") % 3 == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array().cast("array<int>"))
    a, b = rows.split(df, route, 2)
    return rows.merge(a.select("event_id", F.lit(0).alias("branch")), b.select("event_id", F.lit(1).alias("branch")))


@query("select cast(c_custkey as varchar) as id, cast(c_nationkey as bigint) as nation, true as flag from customer")
def typed_literals(spark, sf_dir):
    env = plain(spark)
    df = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("decimal(20,0)").alias("id"), F.col("c_nationkey").alias("n"))
    return env.table_from_dataframe(df).select("id", (col("n") + lit(0, DataTypes.BIGINT)).alias("nation"), lit(True).alias("flag")).dataframe().withColumn("id", F.col("id").cast("string"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nx_q9(spark, sf_dir)


QUERIES = _RUNS
ORACLE_SQL = _SQL
