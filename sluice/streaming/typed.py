"""Values and rows in the state store, by their Spark types.

Times are kept as microseconds and come back as UTC datetimes, structs as
dicts; all else is kept as it is, nulls too.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessorHandle

_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
_MICRO = dt.timedelta(microseconds=1)


def micros(t: dt.datetime) -> int:
    """Microseconds since the epoch; a time without zone is in UTC."""
    return ((t if t.tzinfo else t.replace(tzinfo=dt.timezone.utc)) - _EPOCH) // _MICRO


def stored(t: T.DataType) -> T.DataType:
    """The type that keeps values of type t."""
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return T.LongType()
    if isinstance(t, T.ArrayType):
        return T.ArrayType(stored(t.elementType), True)
    if isinstance(t, T.MapType):
        return T.MapType(stored(t.keyType), stored(t.valueType), True)
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, stored(f.dataType), True) for f in t.fields])
    return t


def encode(v: object, t: T.DataType) -> object:
    """A Python value of type t as the state store takes it."""
    if v is None:
        return None
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return micros(v)
    if isinstance(t, T.ArrayType):
        return [encode(x, t.elementType) for x in v]
    if isinstance(t, T.MapType):
        return {encode(k, t.keyType): encode(x, t.valueType) for k, x in dict(v).items()}  # input rows have pairs
    if isinstance(t, T.StructType):
        if isinstance(v, dict):
            if unknown := v.keys() - set(t.names):
                raise ValueError(f"fields {sorted(unknown)} aren't in the schema")
            return tuple(encode(v.get(f.name), f.dataType) for f in t.fields)
        return tuple(encode(x, f.dataType) for x, f in zip(v, t.fields))
    v = v.item() if hasattr(v, "item") else v
    return float(v) if isinstance(t, T.FractionalType) and isinstance(v, int) and not isinstance(t, T.DecimalType) else v


def decode(v: object, t: T.DataType) -> object:
    """What encode() was given."""
    if v is None:
        return None
    if isinstance(t, T.TimestampType):
        return _EPOCH + v * _MICRO
    if isinstance(t, T.TimestampNTZType):
        return (_EPOCH + v * _MICRO).replace(tzinfo=None)
    if isinstance(t, T.ArrayType):
        return [decode(x, t.elementType) for x in v]
    if isinstance(t, T.MapType):
        return {decode(k, t.keyType): decode(x, t.valueType) for k, x in dict(v).items()}
    if isinstance(t, T.StructType):
        return {f.name: decode(x, f.dataType) for x, f in zip(v, t.fields)}
    return bytes(v) if isinstance(t, T.BinaryType) else v


def is_plain(t: T.DataType) -> bool:
    """Whether values of an input row are what decode() gives already."""
    return not isinstance(t, (T.TimestampType, T.TimestampNTZType, T.ArrayType, T.MapType, T.StructType, T.BinaryType))


def plain(v: object, t: T.DataType) -> object:
    """A value of an input row: structs as dicts, times in UTC."""
    return v if is_plain(t) else decode(encode(v, t), t)


class Chunks:
    """Rows of a key by slot, a number.  Adding rows writes those rows and a counter, whatever the slot holds."""

    #: Rows in one value of the store.
    ROWS = 1000

    def __init__(self, handle: StatefulProcessorHandle, name: str, row: T.StructType):
        self.row = row
        self.counts = handle.getMapState(f"{name}_parts", "slot bigint", "n int")
        self.parts = handle.getMapState(name, "slot bigint, part int", T.StructType([T.StructField("rows", T.ArrayType(stored(row)))]))

    def add(self, slot: int, rows: list[dict]) -> bool:
        """True if the slot had no rows before."""
        got = self.counts.getValue((slot,))
        n = got[0] if got else 0
        for i in range(0, len(rows), self.ROWS):
            self.parts.updateValue((slot, n), ([encode(r, self.row) for r in rows[i : i + self.ROWS]],))
            n += 1
        self.counts.updateValue((slot,), (n,))
        return not got

    def holds(self, slot: int) -> bool:
        return self.counts.containsKey((slot,))

    def slots(self) -> list[int]:
        return sorted(k[0] for k in self.counts.keys())

    def get(self, slot: int) -> Iterable[dict]:
        got = self.counts.getValue((slot,))
        for part in range(got[0] if got else 0):
            for r in self.parts.getValue((slot, part))[0]:
                yield decode(r, self.row)

    def remove(self, slot: int) -> None:
        got = self.counts.getValue((slot,))
        for part in range(got[0] if got else 0):
            self.parts.removeKey((slot, part))
        self.counts.removeKey((slot,))
