"""Declarative stream and table analytics on Spark."""

from .functions import avg, col, count, current_timestamp, lit, max, min, neg, sum
from .plans import JobHandle, Query, Table, TableEnvironment
from .schema import Schema, SchemaBuilder
from .sources import FileFormat, InputFileConfiguration, KafkaSink, KafkaSource, SplitSize
from .time import Duration, Interval, TimePolicy, Window, WindowType
from .types import DataType, DataTypes, TimeFormats

__all__ = [
    "DataType", "DataTypes", "Duration", "FileFormat", "InputFileConfiguration", "Interval", "JobHandle", "KafkaSink",
    "KafkaSource", "Query", "Schema", "SchemaBuilder", "SplitSize", "Table", "TableEnvironment", "TimeFormats", "TimePolicy",
    "Window", "WindowType", "avg", "col", "count", "current_timestamp", "lit", "max", "min", "neg", "sum",
]
