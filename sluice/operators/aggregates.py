"""Aggregates in parts: built-in partials, and how parts combine.

COUNT, SUM, MIN and MAX combine directly and AVG by a sum and a count, so one
description serves final, pane-wise, salted and running aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..expr import Aggregate
from ..schema import Schema
from ..types import DataType


@dataclass(frozen=True)
class Part:
    """A partial column: how rows and how parts make it, and its value for a single row."""

    name: str
    from_rows: Column
    combine: str  # "sum", "min" or "max"
    row: Column | None = None

    def combined(self) -> Column:
        return getattr(F, self.combine)(F.col(f"`{self.name}`")).alias(self.name)


def parts_of(aggregates: list[Aggregate], schema: Schema) -> list[Part]:
    """The distinct partial columns that the aggregates need."""
    out: dict[str, Part] = {}
    for a in aggregates:
        if a.target is None:
            out["__n"] = Part("__n", F.count(F.lit(1)), "sum", F.lit(1))
            continue
        a.type(schema)
        x = a.target.column(schema)
        key = a.target.name
        if a.func in ("SUM", "AVG"):
            out[f"__sum_{key}"] = Part(f"__sum_{key}", F.sum(x), "sum", x)
        if a.func == "AVG":
            out[f"__cnt_{key}"] = Part(f"__cnt_{key}", F.count(x), "sum", F.when(x.isNotNull(), 1).otherwise(0))
        if a.func in ("MIN", "MAX"):
            out[f"__{a.func.lower()}_{key}"] = Part(f"__{a.func.lower()}_{key}", getattr(F, a.func.lower())(x), a.func.lower(), x)
    return list(out.values())


def result(a: Aggregate, schema: Schema, truncate_avg: bool = False) -> Column:
    """The aggregate's value from its parts, under its default name."""
    t = a.type(schema).spark
    if a.target is None:
        value = F.col("__n")
    elif a.func == "AVG":
        total, n = F.col(f"`__sum_{a.target.name}`"), F.col(f"`__cnt_{a.target.name}`")
        whole = a.target.type(schema) in (DataType.INT, DataType.BIGINT)
        value = F.when(n > 0, F.call_function("div", total, n) if truncate_avg and whole else total.cast("double") / n)
    else:
        value = F.col(f"`__{a.func.lower()}_{a.target.name}`")
    return value.cast(t).alias(a.default_name)


def distinct_aggregates(found: list[Aggregate]) -> list[Aggregate]:
    return list({a.default_name: a for a in found}.values())
