"""Distinct rows and set operations; the hidden event time is no part of a row.

Equal rows become one with the earliest event time.  Nulls equal each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import EVENT_TIME
from .windows import each


def _visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != EVENT_TIME]


def _time(df: DataFrame) -> list:
    return [F.min(EVENT_TIME).alias(EVENT_TIME)] if EVENT_TIME in df.columns else []


def distinct(df: DataFrame) -> DataFrame:
    if EVENT_TIME not in df.columns:
        return df.distinct()
    if df.isStreaming:
        return df.dropDuplicates(_visible(df))
    return df.groupBy(*(f"`{c}`" for c in _visible(df))).agg(*_time(df))


def union_all(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right.select(*(f"`{c}`" for c in left.columns)))


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    return distinct(union_all(left, right))


def _counted(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each distinct row with its number on both sides: one shuffle, with partial counts."""
    both = left.withColumn("__l", F.lit(1)).withColumn("__r", F.lit(0)).unionByName(
        right.select(*(f"`{c}`" for c in left.columns)).withColumn("__l", F.lit(0)).withColumn("__r", F.lit(1))
    )
    return both.groupBy(*(f"`{c}`" for c in _visible(left))).agg(F.sum("__l").alias("__l"), F.sum("__r").alias("__r"), *_time(left))


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    return _counted(left, right).where("__l > 0 AND __r > 0").drop("__l", "__r")


def intersect_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """As many copies of a row as the side that has fewer."""
    common = _counted(left, right).withColumn("__n", F.least("__l", "__r")).where("__n > 0")
    return each(common.drop("__l", "__r"), F.lit(1), F.col("__n"), "__copy").drop("__n", "__copy")
