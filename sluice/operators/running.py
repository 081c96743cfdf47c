"""Running aggregates: one updated row for every row."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..expr import Aggregate
from ..schema import Schema
from . import EVENT_TIME
from .aggregates import parts_of, result
from .ranks import with_running


def running_aggregate(df: DataFrame, schema: Schema, keys: list[str], aggregates: list[Aggregate], order: list[str], truncate_avg: bool = False) -> DataFrame:
    """Keys and the aggregates over all rows of the key so far, this one included."""
    by = [f"`{k}`" for k in keys]
    if not aggregates:
        return df.select(*by, EVENT_TIME)
    found = with_running(df, keys, order, parts_of(aggregates, schema))
    return found.select(*by, *(result(a, schema, truncate_avg) for a in aggregates), EVENT_TIME)
