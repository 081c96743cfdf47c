"""Logical column types and the rules that bind them.

The rules are checked before Catalyst sees a plan, because Catalyst would cast
implicitly (a string compared with a number, say) where this engine refuses.
"""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T


class DataType(Enum):
    STRING = "STRING"
    INT = "INT"
    BIGINT = "BIGINT"
    FLOAT = "FLOAT"
    DOUBLE = "DOUBLE"
    BOOLEAN = "BOOL"
    UBIGINT = "UBIGINT"
    ISO8601 = "ISO8601"

    @property
    def spark(self) -> T.DataType:
        return _SPARK[self]

    @property
    def numeric(self) -> bool:
        """UBIGINT is a carrier for ids and takes no part in arithmetic."""
        return self in _RANK

    @classmethod
    def of(cls, name: DataType | str) -> DataType:
        """A type by itself, by value or by member name, in any case."""
        if isinstance(name, cls):
            return name
        for t in cls:
            if str(name).upper() in (t.name, t.value):
                return t
        raise ValueError(f"unknown type {name!r}")

    @classmethod
    def from_spark(cls, t: T.DataType) -> DataType:
        for own, spark in _SPARK.items():
            if spark == t:
                return own
        if isinstance(t, (T.ByteType, T.ShortType)):
            return cls.INT
        if isinstance(t, T.TimestampNTZType):
            return cls.ISO8601
        raise TypeError(f"no logical type for {t.simpleString()}")


class DataTypes:
    """The types as plain names, for schema declarations."""

    STRING, INT, BIGINT, FLOAT = DataType.STRING, DataType.INT, DataType.BIGINT, DataType.FLOAT
    DOUBLE, BOOLEAN, UBIGINT = DataType.DOUBLE, DataType.BOOLEAN, DataType.UBIGINT


class TimeFormats:
    """Formats of time columns and of the time baseline."""

    ISO8601 = DataType.ISO8601


_SPARK = {
    DataType.STRING: T.StringType(),
    DataType.INT: T.IntegerType(),
    DataType.BIGINT: T.LongType(),
    DataType.FLOAT: T.FloatType(),
    DataType.DOUBLE: T.DoubleType(),
    DataType.BOOLEAN: T.BooleanType(),
    DataType.UBIGINT: T.DecimalType(20, 0),
    DataType.ISO8601: T.TimestampType(),
}
_RANK = {DataType.INT: 0, DataType.BIGINT: 1, DataType.FLOAT: 2, DataType.DOUBLE: 3}


def promote(a: DataType, b: DataType) -> DataType:
    """Result type of arithmetic on two numeric types."""
    if not (a.numeric and b.numeric):
        raise TypeError(f"arithmetic needs numbers, not {a.name} and {b.name}")
    return max(a, b, key=_RANK.__getitem__)


def comparable(a: DataType, b: DataType) -> bool:
    return a == b or (a.numeric and b.numeric)


def type_of_value(value: object) -> DataType:
    for kind, t in ((bool, DataType.BOOLEAN), (int, DataType.INT), (float, DataType.DOUBLE), (str, DataType.STRING)):
        if isinstance(value, kind):
            return t
    raise TypeError(f"no column type for a value of type {type(value).__name__}")
