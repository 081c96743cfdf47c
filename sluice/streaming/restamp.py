"""A watermark for a time that was made from several.

Spark keeps a watermark only with a column that passes unchanged, so the later
of two times, the time of a joined pair, has none and no window could follow.
A pair is made when its second row comes, and its time isn't before that row's,
so it isn't behind the watermark: a stateful operator without state says so.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from .ordered import ROCKSDB


class _Through(StatefulProcessor):
    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        made = Row(*self.columns)
        for row in rows:
            yield made(*(row[c] for c in self.columns))

    def close(self) -> None:
        pass


def restamped(df: DataFrame, time_col: str, keys: list[str]) -> DataFrame:
    """The stream with its watermark on `time_col`, none of whose rows may be behind it; rows are dealt by `keys`."""
    spark = df.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
    if not keys:  # all of a row's values deal it
        df, keys = df.withColumn("__deal", F.pmod(F.xxhash64(*(f"`{c}`" for c in df.columns)), F.lit(1024))), ["__deal"]
    return df.groupBy(*(f"`{k}`" for k in keys)).transformWithState(_Through(schema.names), schema, "append", "None", eventTimeColumnName=time_col)
