"""Declared schemas: ordered, immutable, without duplicate names."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import types as T

from .types import DataType


class Schema(Mapping[str, DataType]):
    """Column names to types.  Equality ignores the order of columns."""

    def __init__(self, fields: Mapping[str, DataType | str]):
        self._fields = {name: DataType.of(t) for name, t in fields.items()}

    def __getitem__(self, name: str) -> DataType:
        return self._fields[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._fields)

    def __len__(self) -> int:
        return len(self._fields)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Schema) and self._fields == other._fields

    def __hash__(self) -> int:
        return hash(frozenset(self._fields.items()))

    def __repr__(self) -> str:
        return f"Schema({', '.join(f'{n} {t.name}' for n, t in self._fields.items())})"

    @property
    def names(self) -> list[str]:
        return list(self._fields)

    @property
    def spark(self) -> T.StructType:
        return T.StructType([T.StructField(n, t.spark) for n, t in self._fields.items()])

    @classmethod
    def from_spark(cls, schema: T.StructType) -> Schema:
        return cls({f.name: DataType.from_spark(f.dataType) for f in schema.fields})


class SchemaBuilder:
    def __init__(self) -> None:
        self._fields: dict[str, DataType] = {}

    def add_column(self, name: str, data_type: DataType | str) -> SchemaBuilder:
        if name in self._fields:
            raise ValueError(f"column {name!r} is declared twice")
        self._fields[name] = DataType.of(data_type)
        return self

    def build(self) -> Schema:
        if not self._fields:
            raise ValueError("a schema needs a column")
        return Schema(self._fields)
