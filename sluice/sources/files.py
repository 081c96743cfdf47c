"""File sources with declared schemas."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import Schema
from ..time import Duration
from ..types import DataType


class FileFormat(Enum):
    CSV = "csv"
    PARQUET = "parquet"
    JSON = "json"


@dataclass(frozen=True)
class SplitSize:
    """Bytes of a file that one task reads, for this source alone; 0 leaves it to Spark."""

    bytes: int = 0

    def __post_init__(self) -> None:
        if self.bytes < 0:
            raise ValueError("a split has no negative size")

    @classmethod
    def kilobytes(cls, n: int) -> SplitSize:
        return cls(n << 10)

    @classmethod
    def megabytes(cls, n: int) -> SplitSize:
        return cls(n << 20)

    @classmethod
    def gigabytes(cls, n: int) -> SplitSize:
        return cls(n << 30)


@dataclass(frozen=True)
class InputFileConfiguration:
    """A file or folder, its format and schema, and how its time behaves.

    order=True says that rows come in the order of time_col (the watermark
    follows the latest time); else `delay` bounds how late a row may be.
    Exactly one of the two is given.
    """

    path: str | Path
    format: FileFormat
    schema: Schema
    has_header: bool = True
    order: bool = False
    split_size: SplitSize = field(default_factory=SplitSize)
    time_col: str | None = None
    delay: Duration | None = None

    def __post_init__(self) -> None:
        if not isinstance(self.schema, Schema):
            raise TypeError("a source needs a declared schema")
        if not isinstance(self.format, FileFormat):
            raise TypeError("unknown file format")
        local = str(self.path)
        if "://" not in local and not any(c in local for c in "*?[{") and not Path(local).exists():
            raise FileNotFoundError(local)
        if self.order == (self.delay is not None):
            raise ValueError("give either order=True or a delay")
        if self.delay is not None and self.delay.us < 0:
            raise ValueError("a delay isn't negative")
        if self.time_col is not None:
            if self.time_col not in self.schema:
                raise ValueError(f"time column {self.time_col!r} isn't in the schema")
            if self.schema[self.time_col] is not DataType.ISO8601:
                raise TypeError("a time column has type ISO8601")


def _moved(df: DataFrame, spark: SparkSession) -> DataFrame:
    """The same plan as a DataFrame of another session."""
    if df.sparkSession is spark:
        return df
    rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, df._jdf.logicalPlan())
    return DataFrame(rows, spark)


def read_files(spark: SparkSession, config: InputFileConfiguration, streaming: bool = False) -> DataFrame:
    """The source's rows in its schema's types.

    CSV is split at every comma, without quotes or escapes; empty lines are
    skipped.  A time text that isn't `YYYY-MM-DDTHH:MM:SS.mmmZ`, or is before
    1970, reads as the epoch, a value that its type can't hold as null.
    """
    own = spark
    if config.split_size.bytes:
        # the size of splits is a setting of the session that reads: a source with one has a session of its own
        # that is otherwise like the caller's
        own = spark.newSession()
        for k, v in spark.conf.getAll.items():
            if own.conf.isModifiable(k):
                own.conf.set(k, v)
        own.conf.set("spark.sql.files.maxPartitionBytes", config.split_size.bytes)
    reader = own.readStream if streaming else own.read
    path = str(config.path)
    if config.format is FileFormat.PARQUET:
        return _moved(reader.schema(config.schema.spark).parquet(path), spark)
    text_types = T.StructType([
        T.StructField(n, T.StringType() if t is DataType.ISO8601 else t.spark) for n, t in config.schema.items()
    ])
    if config.format is FileFormat.JSON:
        raw = reader.schema(text_types).json(path)
    else:
        raw = reader.schema(text_types).option("header", config.has_header).option("quote", "").option("escape", "").option(
            "enforceSchema", True
        ).option("mode", "PERMISSIVE").option("emptyValue", "").csv(path)
    raw = _moved(raw, spark)
    epoch = F.timestamp_micros(F.lit(0))
    columns = []
    for n, t in config.schema.items():
        c = F.col(f"`{n}`")
        if t is DataType.ISO8601:
            c = F.greatest(F.coalesce(F.when(F.length(c) >= 23, F.try_to_timestamp(c)), epoch), epoch).alias(n)
        elif t is DataType.STRING and config.format is FileFormat.CSV:
            c = F.coalesce(c, F.lit("")).alias(n)
        columns.append(c)
    return raw.select(*columns)
