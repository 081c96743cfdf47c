"""Sinks besides files: a function per batch, or per row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def to_batches(df: DataFrame, func: Callable[[DataFrame, int], None], checkpoint: str | None = None, name: str | None = None):
    """func(rows, number) on each micro-batch of a stream; on bounded rows once, with number 0.

    A batch may come again after a failure, under the same number.
    """
    if not df.isStreaming:
        return func(df, 0)
    writer = df.writeStream.foreachBatch(func)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return (writer.queryName(name) if name else writer).start()


def to_function(df: DataFrame, func: Callable[[pd.DataFrame], None], checkpoint: str | None = None):
    """func on pandas batches, on the executors, for its effects."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            func(b)
        return iter(())

    done = df.mapInPandas(run, df.schema)
    if not df.isStreaming:
        return done.write.format("noop").mode("overwrite").save()
    writer = done.writeStream.format("noop")
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
