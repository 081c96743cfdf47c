"""The functions of the relational API.

For anything beyond them use pyspark.sql.functions on Table.dataframe().
"""

from __future__ import annotations

from ..expr import Aggregate, ColumnRef, CurrentTimestamp, Expression, Literal, Not
from ..types import DataType


def col(name: str) -> Expression:
    return ColumnRef(name)


def lit(value: object, data_type: DataType | str | None = None) -> Expression:
    return Literal(value, data_type)


def neg(condition: Expression) -> Expression:
    """Logical not (not the arithmetic sign)."""
    return Not(condition)


def current_timestamp() -> Expression:
    return CurrentTimestamp()


def count() -> Expression:
    return Aggregate("COUNT")


def sum(target: Expression | str) -> Expression:  # noqa: A001
    return Aggregate("SUM", target)


def avg(target: Expression | str) -> Expression:
    return Aggregate("AVG", target)


def min(target: Expression | str) -> Expression:  # noqa: A001
    return Aggregate("MIN", target)


def max(target: Expression | str) -> Expression:  # noqa: A001
    return Aggregate("MAX", target)


__all__ = ["avg", "col", "count", "current_timestamp", "lit", "max", "min", "neg", "sum"]
