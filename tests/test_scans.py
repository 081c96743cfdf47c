"""Running values, positions, trees and wide windows: plans, and hot keys without useful times."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sluice.operators import EVENT_TIME, ranks
from sluice.operators.aggregates import Part


@pytest.fixture(autouse=True)
def sample_always(monkeypatch):
    """Small tables are cut too."""
    monkeypatch.setattr(ranks, "SMALL_BYTES", -1)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def parts():
    v = F.col("v")
    return [Part("total", F.sum(v), "sum", v), Part("n", F.count(F.lit(1)), "sum", F.lit(1)), Part("low", F.min(v), "min", v), Part("high", F.max(F.col("s")), "max", F.col("s"))]


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """20,000 rows of which one key has most, all within a second, and some keys and times are null."""
    rng = random.Random(6)
    start = dt.datetime(2024, 1, 1)
    rows = [
        (i, "hot" if i % 10 else (None if i % 20 else f"k{i % 7}"), None if i % 9 == 0 else rng.randrange(100), f"s{rng.randrange(1000)}",
         None if i % 50 == 0 else start + dt.timedelta(microseconds=rng.randrange(1000)))
        for i in range(20_000)
    ]
    place = str(tmp_path_factory.mktemp("hot") / "t")
    spark.createDataFrame(rows, f"id long, k string, v long, s string, `{EVENT_TIME}` timestamp").repartition(6).write.parquet(place)
    return rows, spark.read.parquet(place)


def plain(rows, keyed):
    out, state = [], {}
    for i, k, v, s, t in sorted(rows, key=lambda r: (r[4] is not None, r[4] or 0, r[0])):
        total, n, low, high = state.get(k if keyed else 0, (None, 0, None, None))
        total = total if v is None else (total or 0) + v
        low = low if v is None else v if low is None else min(low, v)
        state[k if keyed else 0] = total, n + 1, low, s if high is None else max(high, s)
        out.append((i, *state[k if keyed else 0]))
    return sorted(out)


@pytest.mark.parametrize("keys", [["k"], []])
def test_a_hot_key_is_cut_whatever_its_times(spark, hot, keys):
    rows, df = hot
    got = ranks.with_running(df, keys, ["id"], parts())
    assert sorted(tuple(r) for r in got.select("id", "total", "n", "low", "high").collect()) == plain(rows, bool(keys))
    cuts = ranks._cuts(df, keys, [EVENT_TIME, "id"]).collect()
    assert len(cuts) == 1 and len(cuts[0][ranks.BOUNDS]) >= 8
    # its rows are groups of a few thousand at most
    plan = final_plan(got)
    assert plan.count("Scan parquet") == 1 and "ReusedExchange" in plan


def test_positions_without_times(spark):
    """Rows that all have one time, as without a time policy."""
    df = spark.range(5000).select("id", (F.col("id") % 3).alias("k"), F.timestamp_micros(F.lit(0)).alias(EVENT_TIME)).repartition(5)
    got = ranks.with_index(df, ["k"], ["id"], "n").collect()
    assert all(r["n"] == r["id"] // 3 for r in got) and len(got) == 5000


def test_keys_of_ordinary_size_need_one_exchange(spark, hot):
    df = hot[1].withColumn("k", F.col("id") % 500)
    plan = final_plan(ranks.with_running(df, ["k"], ["id"], parts()))
    assert plan.count("Scan parquet") == 1 and plan.count("Exchange ") == 1


def test_small_tables_are_not_sampled(spark, hot, monkeypatch):
    rows, df = hot
    monkeypatch.setattr(ranks, "SMALL_BYTES", 32 << 20)
    assert ranks._cuts(df, ["k"], [EVENT_TIME, "id"]) is None
    got = ranks.with_running(df, ["k"], ["id"], parts())
    assert sorted(tuple(r) for r in got.select("id", "total", "n", "low", "high").collect()) == plain(rows, True)


def test_an_empty_table(spark, hot):
    assert ranks.with_running(hot[1].limit(0), ["k"], ["id"], parts()).collect() == []


@pytest.mark.parametrize("size, slide", [(86_400, 60), (100, 3), (999, 37), (64, 1), (50, 49)])
def test_windows_from_halves_equal_those_from_copies(spark, monkeypatch, size, slide):
    """Sparse and dense panes, gaps longer than a window, several keys, floats without cancellation."""
    from sluice.operators import windows
    from sluice.time import Duration, Window

    rng = random.Random(size)
    at = [rng.randrange(400_000) for _ in range(150)] + list(range(1000, 1300)) + [0, 86_399, 86_400]
    df = spark.createDataFrame([(i % 3 if i % 11 else None, t, 1e16 if i % 7 == 0 else i / 8, f"s{i % 50}") for i, t in enumerate(at)], "k long, s long, x double, y string")
    df = df.withColumn(EVENT_TIME, F.timestamp_micros(F.col("s") * 1_000_000))
    x, y = F.col("x"), F.col("y")
    of = [Part("n", F.count(F.lit(1)), "sum", F.lit(1)), Part("low", F.min(x), "min", x), Part("top", F.max(y), "max", y)]
    ask = lambda: sorted((tuple(r) for r in windows.time_window_parts(df, ["k"], Window.createTBWindow(Duration.seconds(size), Duration.seconds(slide)), 0, of).collect()), key=str)
    monkeypatch.setattr(windows, "COPIES", 0)
    monkeypatch.setattr(windows, "DENSE_BLOCK", 100)
    halves = ask()
    monkeypatch.setattr(windows, "COPIES", 1 << 30)
    assert halves == ask() and len(halves) > 100


def test_a_wide_window_copies_no_pane(spark, sf_dir):
    """A day by a second: two rows a window travel, not a pane's 86,400 copies of its total."""
    from sluice.queries import QUERIES

    df = QUERIES["wide_slide"](spark, sf_dir)
    windows_made = sum(r["windows"] for r in df.collect())
    plan = df._jdf.queryExecution().executedPlan()
    rows = []

    def walk(node):
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            node = node.executedPlan()
        if node.nodeName() in ("Generate",):
            rows.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))
        if node.nodeName().endswith("QueryStage"):
            walk(node.plan())

    walk(plan)
    assert rows and sum(rows) < 2.2 * windows_made


def test_trees_fold_in_order_at_any_width(spark, monkeypatch):
    """Strings joined in order: gaps, windows of one to hundreds of quanta, quanta of many rows."""
    from sluice.operators import rows
    from sluice.time import Duration, Window

    rng = random.Random(9)
    data = [(i, i % 2 if i % 7 else None, rng.randrange(3000)) for i in range(400)]
    df = spark.createDataFrame(data, "id long, k long, s long").withColumn(EVENT_TIME, F.timestamp_micros(F.col("s") * 1_000_000))
    monkeypatch.setattr(rows, "TREE_ROWS", 4)
    monkeypatch.setattr(rows, "FAN_IN", 3)
    for size, slide in ((700, 10), (1000, 700), (50, 50), (30, 40), (2500, 100)):
        got = rows.tree_windows(df, ["k"], Window.createTBWindow(Duration.seconds(size), Duration.seconds(slide)), 0, F.col("id").cast("string"), lambda a, b: F.concat(a, F.lit("-"), b), order=["id"])
        expected = []
        for k in (0, 1, None):
            mine = sorted((s, i) for i, key, s in data if key == k)
            for w in range(3000 // slide + 1):
                inside = [str(i) for s, i in mine if w * slide <= s < w * slide + size]
                if inside:
                    expected.append((k, w, "-".join(inside)))
        assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(expected, key=str)


def test_a_tree_of_a_million_rows_in_a_quantum(spark):
    """And windows of 86,400 slides: arrays stay small, each node goes to the windows that need it."""
    from sluice.operators import rows
    from sluice.time import Duration, Window

    df = spark.range(1_000_000).select("id", F.timestamp_micros(F.when(F.col("id") < 999_000, F.col("id") % 1000).otherwise(F.col("id") * 1000)).alias(EVENT_TIME))
    window = Window.createTBWindow(Duration.seconds(86_400), Duration.seconds(1))
    got = rows.tree_windows(df, [], window, 0, F.col("id"), lambda a, b: a + b, order=["id"])
    found = got.agg(F.count(F.lit(1)), F.max("value"), F.min("window_id"), F.max("window_id")).head()
    assert tuple(found) == (1000, sum(range(1_000_000)), 0, 999)


def _sides(spark, n_left, n_right, hot_left, hot_right):
    """Rows of keys over 200 days, of which one key has a share."""
    rng = random.Random(n_left)
    make = lambda n, hot, name: [(i if rng.random() > 0.02 else None, "hot" if rng.random() < hot else f"k{i % 40}", rng.randrange(200 * 86_400)) for i in range(n)]
    out = []
    for n, hot, name in ((n_left, hot_left, "a"), (n_right, hot_right, "b")):
        rows = make(n, hot, name)
        df = spark.createDataFrame(rows, f"{name} long, k string, s long").withColumn(EVENT_TIME, F.when(F.col(name) % 50 != 3, F.timestamp_micros(F.col("s") * 1_000_000)))
        out.append((rows, df.drop("s")))
    return out


@pytest.mark.parametrize("n_left, n_right, hot_left, hot_right", [(900, 1500, 0.6, 0.6), (2500, 400, 0.8, 0.02), (400, 2500, 0.02, 0.8), (300, 300, 0.0, 0.0)])
@pytest.mark.parametrize("lo, up", [(0, 62), (-100, -5), (-300, 300)])
def test_wide_intervals_cut_hot_keys(spark, n_left, n_right, hot_left, hot_right, lo, up):
    """Every pair once, whichever side is hot; a hot key's rows are spread."""
    from sluice.operators import joins
    from sluice.time import Duration, Interval

    (ra, a), (rb, b) = _sides(spark, n_left, n_right, hot_left, hot_right)
    got = joins.interval_join(a, b, ["k"], Interval(Duration.days(lo), Duration.days(up))).select("a", "b")
    expected = sorted((x, y) for x, k, s in ra for y, j, t in rb if k == j and x is not None and y is not None and x % 50 != 3 and y % 50 != 3 and lo * 86_400 <= t - s <= up * 86_400)
    assert sorted(tuple(r) for r in got.collect()) == expected
    if max(hot_left, hot_right) > 0.5:
        day = 86_400_000_000
        left, right = joins.cut_by_time(*joins._sides(a, b, ["k"])[:2], ["k"], lo * day, up * day)
        side, part = (right, "__right_part") if hot_right > 0.5 else (left, ranks.PART)
        most = side.groupBy("__right_k" if hot_right > 0.5 else "k", part).count().agg(F.max("count")).head()[0]
        assert most < 0.25 * max(n_left, n_right)


@pytest.mark.parametrize("lo, up", [(0, 0), (-1, 0), (0, 3), (-5, 2), (2, 13), (-40, -7)])
def test_band_joins_have_closed_bounds_at_any_width(spark, lo, up):
    """Microseconds on both sides of the epoch, intervals of no width and of widths that four don't divide."""
    from sluice.operators import joins
    from sluice.time import Duration, Interval

    times = lambda step, name: spark.range(-60, 60, step).select(F.col("id").alias(name), F.timestamp_micros("id").alias(EVENT_TIME))
    found = joins.interval_join(times(3, "a"), times(2, "b"), [], Interval(Duration(lo), Duration(up)))
    assert found.columns == ["a", "b", EVENT_TIME]
    expected = [(a, b) for a in range(-60, 60, 3) for b in range(-60, 60, 2) if a + lo <= b <= a + up]
    assert sorted((r["a"], r["b"]) for r in found.collect()) == sorted(expected)


def test_a_band_join_compares_whole_numbers_in_all_tasks(spark, sf_dir):
    """No sum of a time and an interval for each pair, and no fewer tasks because the sides are small."""
    from sluice.queries import QUERIES

    plan = QUERIES["theta_only_band"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "INTERVAL '" not in plan and "REPARTITION_BY_NUM" in plan
