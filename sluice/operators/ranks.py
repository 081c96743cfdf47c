"""Positions and running totals that no single task has to work through.

A plain window function sends all rows of a key (or, without a key, all rows)
through one task.  Here a sample of the rows shows which keys have more rows
than a task's share, and their quantiles in the order that is asked for: such a
key is cut there into parts, each of which is a group of its own.  The parts'
totals, one row a part, are cumulated and added to the rows' values.  Nothing
depends on how times are spread, or on there being times.  A table without such
a key is one exchange and one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import EVENT_TIME
from .aggregates import Part

#: Sampled rows for each task of a shuffle; a key with more of them is cut, into parts of so many sampled rows.
PER_TASK, PER_PART = 64, 16
SEED = 20240101
#: A table planned to have at most so many bytes is no more than one task's work, and isn't sampled.
SMALL_BYTES = 32 << 20
PART, KEY, BOUNDS = "__part", "__key", "__bounds"


def planned_bytes(df: DataFrame) -> int:
    """Spark's estimate of a table's size, which is very large where it knows nothing."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _comparable(df: DataFrame, name: str) -> Column:
    """A column as it can leave Spark and come back: times as microseconds."""
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        c = c.cast("timestamp")
    return F.unix_micros(c) if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else c


def key_struct(df: DataFrame, names: list[str]) -> Column:
    """The columns as one value, which orders them nulls first and knows null as a value."""
    return F.struct(F.lit(0).alias("c"), *(_comparable(df, n).alias(f"c{i}") for i, n in enumerate(names)))


def sampled_cuts(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(KEY, BOUNDS) of the keys to be cut, at most one row a task: a sample of the rows, on which they are decided."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = dict.fromkeys([*keys, *order])
    drawn = df.select(*(f"`{c}`" for c in columns), F.rand(SEED).alias("__draw")).orderBy("__draw").limit(PER_TASK * tasks)
    groups = drawn.select(key_struct(df, keys).alias(KEY), key_struct(df, order).alias("place")).groupBy(KEY).agg(F.array_sort(F.collect_list("place")).alias("places"))
    every = F.sequence(F.lit(PER_PART), F.size("places") - 1, F.lit(PER_PART))
    return groups.where(F.size("places") > PER_TASK).select(KEY, F.transform(every, lambda i: F.element_at("places", i)).alias(BOUNDS))


def _cuts(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame | None:
    """The cuts, fixed: no later run draws others.  None if there is none."""
    return None if planned_bytes(df) <= SMALL_BYTES else fixed(sampled_cuts(df, keys, order))


def fixed(few: DataFrame) -> DataFrame | None:
    """A small table as it is now; None if it has no row."""
    found = few.collect()
    return few.sparkSession.createDataFrame(found, few.schema) if found else None


def bounds_below(at: Column) -> Column:
    """How many of the sorted BOUNDS lie below a place, by halving; the place is made once."""
    return F.element_at(F.transform(F.array(at), _bounds_below), 1)


def _bounds_below(at: Column) -> Column:
    half = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    state = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    def step(s: Column, _: Column) -> Column:
        go_up = F.element_at(BOUNDS, half(s) + 1) < at
        return F.when(s["lo"] >= s["hi"], s).when(go_up, state(half(s) + 1, s["hi"])).otherwise(state(s["lo"], half(s)))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(BOUNDS) + 1)).cast("int"))
    return F.aggregate(steps, state(F.lit(0), F.size(BOUNDS)), step, lambda s: s["lo"])


def with_running(df: DataFrame, keys: list[str], order: list[str], parts: list[Part]) -> DataFrame:
    """df with each part's running value over (event time, order), the row included.

    Rows before in time come first, those without a time at the very first; ties
    follow `order`, so give columns that make it total.  Null keys form one
    group.  A sample of the rows is taken at once, the rest when asked for.
    """
    by, place = [f"`{k}`" for k in keys], [EVENT_TIME, *order]
    running = lambda *of: Window.partitionBy(*of).orderBy(*(f"`{c}`" for c in place)).rowsBetween(Window.unboundedPreceding, 0)
    cuts = _cuts(df, keys, place)
    if cuts is None:
        inside = running(*(by or [F.lit(0)]))
        return df.select("*", *(p.from_rows.over(inside).alias(p.name) for p in parts))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    below = bounds_below(key_struct(df, place))
    if keys:
        placed = df.withColumn(KEY, key_struct(df, keys)).join(F.broadcast(cuts), KEY, "left")
    else:
        placed = df.join(F.broadcast(cuts.drop(KEY)), how="left")
    group = [KEY, PART] if keys else [PART]
    dealt = placed.withColumn(PART, F.when(F.col(BOUNDS).isNull(), -1).otherwise(below)).drop(BOUNDS).repartition(tasks, *group)
    # the totals ask for all columns and are filtered by an aggregate, so that both read one exchange
    columns = [f"`{f.name}`" for f in dealt.schema.fields if not isinstance(f.dataType, T.MapType)]
    totals = dealt.groupBy(*group).agg(*(p.from_rows.alias(p.name) for p in parts), F.max(PART).alias("__top"), F.max(F.xxhash64(*columns)).alias("__all"))
    earlier = Window.partitionBy(*group[:-1]).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.where((F.col("__top") > -1) & F.col("__all").isNotNull()).select(
        *([F.col(KEY).alias("__k")] if keys else []), F.col(PART).alias("__p"),
        *(getattr(F, p.combine)(F.col(f"`{p.name}`")).over(earlier).alias(f"{p.name}__before") for p in parts),
    )
    near = dealt.select("*", *(p.from_rows.over(running(*group)).alias(p.name) for p in parts))
    match = F.col(PART) == F.col("__p")
    joined = near.join(F.broadcast(before), (F.col(KEY) == F.col("__k")) & match if keys else match, "left")
    for p in parts:
        a, b = F.col(f"`{p.name}`"), F.col(f"`{p.name}__before`")
        if p.combine == "sum":
            both = F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
        else:
            both = (F.least if p.combine == "min" else F.greatest)(a, b)
        joined = joined.withColumn(p.name, both)
    return joined.drop(KEY, PART, "__k", "__p", *(f"{p.name}__before" for p in parts))


def with_index(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """df with each row's position within its key, from 0, by (event time, order)."""
    part = Part(name, F.count(F.lit(1)), "sum")
    return with_running(df, keys, order, [part]).withColumn(name, F.col(name) - 1)
