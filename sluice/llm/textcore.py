"""Vectorised text primitives over Arrow string columns.

Everything here works on the UTF-8 bytes of a whole Arrow batch at once, cut
into slices of bounded size, so the per-word cost is a few array operations
and memory does not depend on the batch.  A text is never cut: a slice holds
whole texts, at least one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text handled at once (a longer text is a slice of its own).
SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)

#: White space as the word rules of these operators define it: 0x20, 0x09-0x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: ASCII lower-casing of bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: a bijection that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Spans up to this many bytes are hashed together, longer ones by BLAKE2.
LONG_SPAN = 96
_LANE, _SEED = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x2545F4914F6CDD1D)
#: The bytes of an 8-byte chunk that belong to a span of 0 to 8 more bytes.
_PART = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.string(), pa.binary()):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("" if column.type == pa.string() else b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together hold at most `limit` bytes, or one row."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


class Words:
    """Words of some texts: byte spans, 64-bit hashes, ranges by text.

    first[i] .. first[i + 1] are the words of text i; start and end are byte
    positions in `buf`; code is a hash of the word's bytes.
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, space: np.ndarray = IS_SPACE):
        self.buf, self.offsets = buf, offsets
        n = len(buf)
        inside = ~space[buf]
        begins, ends = inside.copy(), inside.copy()
        if n:
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            edge = offsets[:-1][(offsets[:-1] < offsets[1:])]
            begins[edge] = inside[edge]
            last = offsets[1:][(offsets[:-1] < offsets[1:])] - 1
            ends[last] = inside[last]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self._chunks: np.ndarray | None = None

    @property
    def chunks(self) -> np.ndarray:
        """The 8 bytes from each position on, as a number (a view; zeros follow the end)."""
        if self._chunks is None:
            padded = np.concatenate([self.buf, np.zeros(8, np.uint8)])
            self._chunks = np.ndarray((len(self.buf) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
        return self._chunks

    def span_code(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes start..end, the same wherever they stand.

        Chunks of 8 bytes go one after the other into two lanes that are no
        linear function of them, so equal hashes can't be put together from
        parts; a span of at most 8 bytes shares its hash with none of its length.
        """
        size = end - start
        out = mix(size.astype(np.uint64) * _BASE + _SEED)
        left = np.flatnonzero(size <= LONG_SPAN)
        chunk = self.chunks[start[left]] & _PART[np.minimum(size[left], 8)]
        out[left] = mix(out[left] ^ chunk)
        several = size[left] > 8
        left, lane = left[several], chunk[several] * _LANE
        for at in range(8, LONG_SPAN, 8):
            if not len(left):
                break
            chunk = self.chunks[start[left] + at] & _PART[np.minimum(size[left] - at, 8)]
            out[left] = mix(out[left] ^ chunk)
            lane = (lane ^ (lane >> np.uint64(29)) ^ chunk) * _LANE
            done = size[left] <= at + 8
            out[left[done]] = mix(out[left[done]] + (lane[done] ^ (lane[done] >> np.uint64(32))))
            left, lane = left[~done], lane[~done]
        long = np.flatnonzero(size > LONG_SPAN)
        if len(long):
            raw = memoryview(np.ascontiguousarray(self.buf))
            digests = [blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(start[long].tolist(), end[long].tolist())]
            out[long] = np.frombuffer(b"".join(digests), dtype="<u8")
        return out

    @property
    def code(self) -> np.ndarray:
        return self.span_code(self.start, self.end)

    def same(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether words i and j have the same bytes."""
        out = self.end[i] - self.start[i] == self.end[j] - self.start[j]
        left = np.flatnonzero(out & (i != j))
        out[left] = same_spans(self, self.start[i[left]], self, self.start[j[left]], (self.end[i] - self.start[i])[left])
        return out

    def forget(self) -> None:
        """Drops what is kept for hashing; it comes back when a hash is asked for."""
        self._chunks = None

    def text_of(self) -> np.ndarray:
        """Index of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))


def same_spans(x: Words, a: np.ndarray, y: Words, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes of x from a on are those of y from b on, `size` of them."""
    out = np.ones(len(a), dtype=bool)
    left = np.arange(len(a))
    for at in range(0, LONG_SPAN, 8):
        if not len(left):
            return out
        part = _PART[np.clip(size[left] - at, 0, 8)]
        equal = ((x.chunks[a[left] + at] ^ y.chunks[b[left] + at]) & part) == 0
        out[left[~equal]] = False
        left = left[equal & (size[left] > at + 8)]
    for k in left.tolist():
        out[k] = np.array_equal(x.buf[a[k] : a[k] + size[k]], y.buf[b[k] : b[k] + size[k]])
    return out


def word_slices(column: pa.Array, lower: bool) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) for slices of a text column."""
    buf, offsets = byte_view(column)
    for lo, hi in slices(offsets):
        part = buf[offsets[lo] : offsets[hi]]
        yield lo, hi, Words(LOWER[part] if lower else part, offsets[lo : hi + 1] - offsets[lo])


def windows(code: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words inside one text, and each text's range.

    Returns (hash by run, first run of each text plus the end).
    """
    counts = np.maximum(np.diff(first) - size + 1, 0)
    begin = np.r_[0, np.cumsum(counts)]
    at = np.repeat(first[:-1] - begin[:-1], counts) + np.arange(begin[-1])
    out = np.zeros(len(at), dtype=np.uint64)
    for i in range(size):
        out = out * _BASE + code[at + i] if len(at) else out
    return mix(out), begin


def split_code(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text (null id: of the empty text), for held-out splits."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


#: Arrow batches that Spark hands to Python, in bytes.
BATCH_BYTES, _BATCH_KEY = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def give_back() -> None:
    """Returns free memory to the system: workers are kept for later tasks, beside all others of their executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _tidy(run):
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def map_batches(df: DataFrame, run, schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow with batches bounded by bytes, in workers that give their memory back.

    Texts differ in length by orders of magnitude, so rows don't bound memory.
    The limit is a setting of the session: it is made where the session has
    none, and one that is there stays, whatever its value.
    """
    spark = df.sparkSession
    if not spark._jsparkSession.conf().contains(_BATCH_KEY) and not spark.sparkContext.getConf().contains(_BATCH_KEY):
        spark.conf.set(_BATCH_KEY, f"{BATCH_BYTES}b")
    return df.mapInArrow(_tidy(run), schema)


def ensure_checkpoint_dir(df: DataFrame) -> None:
    """Keep the cluster's checkpoint folder; set one only where none is set.

    Without a setting, Spark in one process takes a folder of its own machine;
    a cluster shares no such folder, so there the setting is missed.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if context.master != "local" and not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="sluice-checkpoint-")
        context.setCheckpointDir(folder)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns to add that df has not, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there.

    The rows come back without the size that was estimated for them: estimates
    of joins multiply, and in a loop they grow to numbers of millions of digits.
    """
    ensure_checkpoint_dir(df)
    kept, spark = df.checkpoint(eager=True)._jdf, df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)


def sweep(df: DataFrame) -> None:
    """Asks the driver's collector, so that Spark removes the shuffle files that no plan can reach any more.

    They stay until a collection, however large they are; after a large step it is worth one.
    """
    df.sparkSession._jvm.System.gc()


#: A key with at least 1 / HOT of all rows is joined apart from the others.
HOT = 64


def spread_join(rows: DataFrame, side: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """rows with side's columns, nulls where it has no row of the key; side has each key once.

    counts has (key, n), the rows of each key.  The at most HOT keys that have
    a share of 1 / HOT or more never meet in one task: their rows of side, as
    few, are sent to all.  Null keys stay where they are.
    """
    total = counts.agg(F.sum("n")).head()[0] or 0
    hot = [r[0] for r in counts.where(F.col("n") * HOT >= total).select(key).collect()] if total else []
    cold = rows.where(F.col(key).isNotNull() & ~F.col(key).isin(hot)) if hot else rows.where(F.col(key).isNotNull())
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in side.schema.fields if f.name != key]
    out = cold.join(side, key, "left").select(*rows.columns, *(c for c in side.columns if c != key))
    out = out.union(rows.where(F.col(key).isNull()).select(*rows.columns, *none))
    if hot:
        few = rows.where(F.col(key).isin(hot)).join(F.broadcast(side.where(F.col(key).isin(hot))), key, "left")
        out = out.union(few.select(*out.columns))
    return out


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of complete key groups from batches sorted by `keys`.

    A group that continues in the next batch is carried over, so each yielded
    table holds whole groups only.
    """
    kept: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        changed = np.zeros(table.num_rows, dtype=bool)
        for k in keys:
            x = table.column(k).to_numpy()
            changed[1:] |= x[1:] != x[:-1]
        same = bool(kept) and all(kept[-1].column(k)[-1].as_py() == table.column(k)[0].as_py() for k in keys)
        breaks = np.flatnonzero(changed)
        if not len(breaks):
            if kept and not same:
                yield pa.concat_tables(kept).combine_chunks()
                kept = []
            kept.append(table)
            continue
        if kept and not same:
            yield pa.concat_tables(kept).combine_chunks()
            kept = []
        cut_at = int(breaks[-1])
        yield pa.concat_tables([*kept, table.slice(0, cut_at)]).combine_chunks()
        kept = [table.slice(cut_at)]
    if kept:
        yield pa.concat_tables(kept).combine_chunks()
