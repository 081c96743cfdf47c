"""Functions on whole windows: rows go to Python in batches of many windows, whatever the batches' size."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sluice.operators import EVENT_TIME, rows
from sluice.queries import QUERIES
from sluice.time import Duration, Window

BIG = 2**60 + 1


@pytest.fixture(params=[3, 10_000])
def batch(spark, request):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, request.param)
    yield request.param
    spark.conf.set(name, before)


@pytest.fixture(scope="module")
def table(spark):
    """Keys with one row, some and many, a null one; numbers and booleans with nulls, and numbers that no double holds."""
    df = spark.range(400).select(
        F.when(F.col("id") % 9 == 0, None).when(F.col("id") % 2 == 0, BIG).otherwise(F.col("id") % 50 + BIG).alias("k"),
        F.when(F.col("id") % 11 != 0, F.col("id") + BIG).alias("v"), F.when(F.col("id") % 13 != 0, F.col("id") % 2 == 0).alias("flag"),
        F.when(F.col("id") % 17 != 0, F.timestamp_seconds(F.col("id") * 7919 % 1000)).alias(EVENT_TIME), F.col("id"),
    )
    return df.repartition(3).persist()


def _frame(frame: pd.DataFrame) -> dict:
    assert list(frame.index) == list(range(len(frame)))
    whole = frame["v"].dtype.kind == "i"
    assert whole != frame["v"].isna().any()
    return {"ids": frame["id"].tolist(), "most": int(frame["v"].max()) if whole else None, "flags": [None if f is None else bool(f) for f in frame["flag"]]}


def _arrays(of: dict[str, np.ndarray]) -> dict:
    whole = of["v"].dtype.kind == "i"
    return {"ids": of["id"].tolist(), "most": int(of["v"].max()) if whole else None, "flags": [None if f is None else bool(f) for f in of["flag"]]}


@pytest.mark.parametrize("window", [Window.createTBWindow(Duration.seconds(200)), Window.createTBWindow(Duration.seconds(300), Duration.seconds(100)), Window.createCBWindow(10), Window.createCBWindow(7, 3)])
@pytest.mark.parametrize("arrays", [False, True])
def test_each_window_is_whole_and_in_order(table, batch, window, arrays):
    schema = "k long, window_id long, ids array<long>, most long, flags array<boolean>"
    found = rows.keyed_windows(table, ["k"], window, 0, _arrays if arrays else _frame, schema, ["id"], arrays=arrays).collect()
    by_count, expected = window.size < 100, {}
    keyed = {}
    for r in table.collect():
        keyed.setdefault(r["k"], []).append(r)
    for k, members in keyed.items():
        seconds = lambda r: 0 if r[EVENT_TIME] is None else int(r[EVENT_TIME].timestamp())
        # rows without a time come first where rows are counted, and last at the baseline of windows in time
        members.sort(key=lambda r: ((r[EVENT_TIME] is None) != by_count, seconds(r), r["id"]) if by_count else (seconds(r), r[EVENT_TIME] is None, r["id"]))
        for i, r in enumerate(members):
            at = i if by_count else seconds(r) * 1_000_000
            first = max(0, (at - window.size) // window.slide + 1)
            for w in range(first, at // window.slide + 1):
                expected.setdefault((k, w), []).append(r)
    assert {(r["k"], r["window_id"]): r["ids"] for r in found} == {g: [m["id"] for m in ms] for g, ms in expected.items()}
    assert len(found) == len(expected)
    assert {(r["k"], r["window_id"]): r["flags"] for r in found} == {g: [m["flag"] for m in ms] for g, ms in expected.items()}
    most = {g: None if any(m["v"] is None for m in ms) else max(m["v"] for m in ms) for g, ms in expected.items()}
    assert {(r["k"], r["window_id"]): r["most"] for r in found} == most


def test_windows_without_keys_and_without_rows(table):
    def size(of):
        return {"n": len(of["id"])}

    window = Window.createCBWindow(150)
    found = rows.keyed_windows(table, [], window, 0, size, "window_id long, n long", ["id"], arrays=True)
    assert sorted(map(tuple, found.collect())) == [(0, 150), (1, 150), (2, 100)]
    assert rows.keyed_windows(table.where("id < 0"), ["k"], window, 0, size, "k long, window_id long, n long", ["id"], arrays=True).collect() == []


@pytest.mark.parametrize("name", ["kw_cb", "window_iterable"])
def test_no_window_is_a_batch_of_its_own(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroups" not in plan
