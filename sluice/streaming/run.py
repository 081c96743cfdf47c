"""Streams with an end: what there is now is worked off, and all that is open is given.

A stream that has been made `bounded` reads, beside its source, a folder of its
own in the shared checkpoint folder.  finish() puts one row there whose time is
past all others: it moves the watermark, closes windows, ends joins and lets
waiting rows go, and is itself left out before any operator sees it.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..time import Duration
from .ordered import END_MS, LAST_TIMES

_MARK = "sluice-end-"


def _shared_folder(df: DataFrame) -> str:
    """The folder that the cluster shares; one of this machine only where all runs in one process."""
    spark = df.sparkSession
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="sluice-")


def bounded(df: DataFrame, time_col: str, delay: Duration | None = None) -> DataFrame:
    """The stream with a watermark on `time_col`, `delay` behind its latest time, that finish() can bring to an end."""
    folder = f"{_shared_folder(df)}/{_MARK}{uuid.uuid4().hex}"
    spark = df.sparkSession
    # the folder's first file has no row and says which column is the time
    none = spark.createDataFrame([], df.schema)
    none.select(*(F.col(f"`{c}`").alias(c, metadata={_MARK: True}) if c == time_col else F.col(f"`{c}`") for c in df.columns)).write.parquet(folder)
    ends = spark.readStream.schema(df.schema).parquet(folder)
    marked = df.unionByName(ends).withWatermark(time_col, f"{delay.us if delay else 0} microseconds")
    # the end itself is none of the rows.  Spark would move later conditions below the watermark, where they would take the
    # end away; it moves none past one whose result it can't foresee
    time = F.col(f"`{time_col}`")
    return marked.where((time.isNull() | (time < F.timestamp_millis(F.lit(END_MS)))) & (F.rand(0) * 2 < 3))


def endless(df: DataFrame) -> None:
    """Refuses streams whose state expires by the clock: Spark makes batches for it for ever."""
    if re.search(r"TransformWithState[^\n]*\bProcessingTime\b", df._jdf.queryExecution().analyzed().toString()):
        raise RuntimeError("state that expires by the clock has no last batch: stop the query yourself")


def finish(query, df: DataFrame) -> int:
    """Works off what a started query of df has, and then its end; the number of sources that ended.

    The query goes on until it is stopped, but later rows are all late.
    """
    endless(df)
    query.processAllAvailable()
    spark = df.sparkSession
    folders = sorted(set(re.findall(rf"[^\s,\[\]()]*{_MARK}[0-9a-f]{{32}}", df._jdf.queryExecution().analyzed().toString())))
    for last in LAST_TIMES if folders else ():
        for folder in folders:
            fields = spark.read.parquet(folder).schema.fields
            spark.range(1).select(*(
                F.lit(last if f.metadata.get(_MARK) else None).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in fields
            )).write.mode("append").parquet(folder)
        query.processAllAvailable()
    return len(folders)


def run_available(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """All that a stream yields from the data there is now, as an in-memory table.

    Streams that are `bounded` come to their end, so that nothing stays open;
    of others, windows that the watermark has not passed do.
    """
    endless(df)
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    try:
        finish(query, df)
    finally:
        query.stop()
    return df.sparkSession.table(name)


def sink_metrics(query) -> dict[str, float]:
    """Rows read and dropped as late, and seconds, over a query's recent progress."""
    progress = [p if isinstance(p, dict) else __import__("json").loads(p.json) for p in query.recentProgress]
    states = [s for p in progress for s in p.get("stateOperators", [])]
    return {
        "rows_in": float(sum(p.get("numInputRows", 0) for p in progress)),
        "late_rows": float(sum(s.get("numRowsDroppedByWatermark", 0) for s in states)),
        "seconds": sum(p.get("durationMs", {}).get("triggerExecution", 0) for p in progress) / 1000,
    }
