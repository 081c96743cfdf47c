"""Importance resampling towards a target distribution by external sort-count.

Features of a text (runs of words) fall into buckets by crc32.  Each task
writes the buckets of its documents as packed uint16 streams with document
offsets; the streams are the only thing that later passes read.  The first
sorts each stream and encodes its runs, so that counts of a task are at most
one row a bucket; the second gathers each bucket's gain along the stream and
adds it up between the offsets.  Documents are then drawn without replacement
by weight plus Gumbel noise, the highest scores first.

Ranks come from a table sorted by ranges of the score, and the number of rows
in each of its partitions: no task or driver sees more than a partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textcore import LOWER, Words, byte_view, cut, map_batches, slices

BUCKETS, SHORTEST, LONGEST = 10_000, 1, 1
#: Documents with fewer words are never drawn; percent of the others to draw; seed of the noise.
LEAST_WORDS, PERCENT, SEED = 20, 10, "2024"

#: Bytes that end a word once A-Z are lower-cased: all ASCII but digits and letters.
APART = np.ones(256, dtype=bool)
APART[48:58] = APART[97:123] = APART[128:] = False

#: Words beyond this many bytes are summed one by one.
LONG_WORD = 64


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> 1), c >> 1)
    return c


_CRC = _crc_table()


def _fed(state: np.ndarray, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Registers of crc32 after the bytes from start on, `size` of them each."""
    small = np.minimum(size, LONG_WORD + 1).astype(np.uint8)
    order = np.argsort(small, kind="stable")
    small = small[order]
    n_long = len(small) - int(np.searchsorted(small, LONG_WORD, side="right"))
    out, at = state[order], start[order]
    end = len(out) - n_long
    for k in range(int(small[end - 1]) if end else 0):
        lo = int(np.searchsorted(small, k, side="right"))
        part = out[lo:end]
        out[lo:end] = _CRC[(part ^ buf[at[lo:end] + k]) & 0xFF] ^ (part >> np.uint32(8))
    for i in range(end, len(out)):
        a = int(at[i])
        out[i] = zlib.crc32(buf[a : a + int(size[order[i]])].tobytes(), int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    back = np.empty_like(out)
    back[order] = out
    return back


def bucket_stream(w: Words, shortest: int, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every run of shortest..longest words, text by text; where each text's begin, and the end)."""
    n_words = np.diff(w.first)
    text = w.text_of()
    left = np.repeat(w.first[1:], n_words) - np.arange(len(text))  # words from each one to its text's end
    at, state = np.arange(len(text)), np.full(len(text), 0xFFFFFFFF, dtype=np.uint32)
    found, of = [], []
    for k in range(longest):
        at, state = (x[left[at] > k] for x in (at, state))
        if k:
            state = _CRC[(state ^ np.uint32(0x20)) & 0xFF] ^ (state >> np.uint32(8))
        state = _fed(state, w.buf, w.start[at + k], w.end[at + k] - w.start[at + k])
        if k + 1 >= shortest:
            found.append(((state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.uint16))
            of.append(text[at])
    stream, owner = np.concatenate(found), np.concatenate(of)
    if len(found) > 1:
        order = np.argsort(owner, kind="stable")
        stream, owner = stream[order], owner[order]
    return stream, np.searchsorted(owner, np.arange(len(n_words) + 1))


def _streams(shortest: int, longest: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            buf, offsets = byte_view(batch.column(1))
            for lo, hi in slices(offsets):
                w = Words(LOWER[buf[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo], APART)
                stream, begin = bucket_stream(w, shortest, longest, buckets)
                yield pa.record_batch(
                    [
                        pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), ids.slice(lo, hi - lo)),
                        *(pa.array([x.tobytes()], pa.binary()) for x in (np.diff(w.first), begin, stream)),
                    ],
                    names=["ids", "n_words", "begin", "stream"],
                )

    return run


def streams(docs: DataFrame, text: str, key: str, shortest: int = SHORTEST, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """Blocks of documents: ids, words of each, offsets, and the packed buckets of their features; written, to be read again."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket is packed into 16 bits")
    if not 0 < shortest <= longest:
        raise ValueError("runs have a word at least")
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(kind)), *(T.StructField(n, T.BinaryType()) for n in ("n_words", "begin", "stream"))])
    return cut(map_batches(docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")), _streams(shortest, longest, buckets), schema))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted streams as runs, added up over the task: at most one row a bucket."""
    total = np.zeros(1 << 16, dtype=np.int64)
    for batch in batches:
        for block in batch.column(0):
            x = np.sort(np.frombuffer(block.as_buffer(), dtype=np.uint16))
            edge = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, dtype=np.int64)
            total[x[edge]] += np.diff(np.r_[edge, len(x)])
    bucket = np.flatnonzero(total)
    yield pa.record_batch([pa.array(bucket, pa.int64()), pa.array(total[bucket], pa.int64())], names=["bucket", "n"])


def bucket_counts(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket, over all blocks; at most `buckets` rows come to the driver."""
    out = np.zeros(buckets, dtype=np.int64)
    for r in map_batches(blocks.select("stream"), _runs, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of log(target share / source share) by bucket, both smoothed by one, rounded down."""
    b = len(source)
    ratio = (target + 1.0) * (float(source.sum()) + b) / ((source + 1.0) * (float(target.sum()) + b))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weighed(gain: np.ndarray, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column(0)[i].values
                words, begin = (np.frombuffer(batch.column(k)[i].as_buffer(), dtype=np.int64) for k in (1, 2))
                got = gain[np.frombuffer(batch.column(3)[i].as_buffer(), dtype=np.uint16)]
                size, weight = np.diff(begin), np.zeros(len(begin) - 1, dtype=np.int64)
                full = size > 0
                if len(got):
                    weight[full] = np.add.reduceat(got, begin[:-1][full])
                yield pa.record_batch([ids.cast(kind), *(pa.array(x, pa.int64()) for x in (words, size, weight))], names=["id", "n_words", "n_features", "weight"])

    return run


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight) of every document: the sum of its features' gains."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = blocks.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight"))])
    return map_batches(blocks, _weighed(gain, to_arrow_type(kind)), schema)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with each row's number from 1 in a global order, by ranges of that order."""
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("__m", F.monotonically_increasing_id())
    part, nth = F.shiftright("__m", 33), F.col("__m").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r[0], r[1]) for r in placed.groupBy(part.alias("p")).count().collect())  # one row a partition
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    starts = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "__p long, __b long")
    return placed.join(F.broadcast(starts), part == F.col("__p"), "left").withColumn(name, F.col("__b") + nth + 1).drop("__m", "__p", "__b")


def importance_ranks(
    docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", target_text: str = "text", *, shortest: int = SHORTEST,
    longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED,
) -> DataFrame:
    """Key, n_features, n_words, weight, score and rank of every row of docs.

    A feature is a run of `shortest` to `longest` words (letters and digits,
    A-Z in lower case) joined by a space.  Of the rows with at least
    `least_words` words, `percent` in a hundred (rounded down) with the highest
    scores are drawn and ranked from 1; all others have a null rank.  Equal
    scores rank by key, null keys last.  A null or empty text has no feature
    and weight 0; a null key counts as an empty one in the noise; repeated rows
    and keys are rows of their own.  An empty table gives an empty result, an
    empty target a flat distribution.
    """
    blocks = streams(docs, text, key, shortest, longest, buckets)
    wanted = streams(target.withColumn("__id", F.lit(0).cast("long")), target_text, "__id", shortest, longest, buckets)
    gain = gains(bucket_counts(blocks, buckets), bucket_counts(wanted, buckets))
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(draw, 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    fit = F.col("n_words") >= least_words
    scored = cut(weights(blocks, gain).withColumn("score", F.col("weight") + noise))
    n = scored.where(fit).count()
    order = [F.when(fit, 0).otherwise(1), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc()]
    ranked = numbered(scored, order, "rank")
    drawn = F.when(F.col("rank") <= n * percent // 100, F.col("rank"))
    return ranked.select(F.col("id").alias(key), "n_features", "n_words", "weight", "score", drawn.alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The drawn rows of docs, all columns; keys are those of one row each, null keys are not drawn."""
    drawn = importance_ranks(docs, target, key=key, **options).where("rank is not null").select(key)
    return docs.join(drawn, key, "left_semi")


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return importance_ranks(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
