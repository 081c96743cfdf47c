"""Quality classifier: hashed word n-grams, logistic regression, FTRL updates.

Tokens are runs of word symbols and runs of other marks, case kept.  Features
are hashed tokens and token pairs, and the shapes of tokens (capitals, digits,
marks, repetition of the token before) and of token pairs; each weighs
count / sqrt(features).  Training is follow-the-regularised-leader
(proximal, with L1 and L2) over a bounded sample of labelled rows, one text at
a time.  The rows' whole texts are turned into sparse features where they are
and written; the driver reads them one partition after the other, so no text
is too long to learn from.  Scoring is a sparse dot product: weights gathered
by hash and summed by text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textcore import IS_SPACE, Words, cut, map_batches, mix, split_code, windows, word_slices

#: Labelled rows that training reads at most, drawn by a hash of the id; whole texts.
TRAIN_ROWS = 4000
#: Partitions of their features; one at a time is in the driver.
TRAIN_PARTS = 16
BUCKETS = 1 << 18
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.001, 0.01


#: 0 space, 1 word symbol, 2 mark.
_TYPE = np.where(IS_SPACE, 0, 2)
_TYPE[48:58] = _TYPE[65:91] = _TYPE[97:123] = _TYPE[128:] = 1
_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True


def tokens(w: Words) -> Words:
    """The words cut where word symbols and marks meet."""
    kind = _TYPE[w.buf]
    begins = np.zeros(len(kind), dtype=bool)
    begins[w.start] = True
    begins[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0)
    ends = np.zeros(len(kind) + 1, dtype=bool)
    ends[w.end] = True
    ends[1:-1] |= (kind[1:] != kind[:-1]) & (kind[:-1] > 0)
    w.start, w.end = np.flatnonzero(begins), np.flatnonzero(ends)
    w.first = np.searchsorted(w.start, w.offsets)
    return w


def hashed(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every feature occurrence."""
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    w = tokens(words)
    code, text = w.code, w.text_of()
    again = np.zeros(len(code), dtype=bool)
    if len(code):
        again[1:] = (code[1:] == code[:-1]) & (text[1:] == text[:-1])
        head, tail = w.buf[w.start], w.buf[w.end - 1]
        shape = _CAPITAL[head] + 2 * _CAPITAL[tail] + 4 * _DIGIT[head] + 8 * (_TYPE[head] == 2) + 16 * again
        shape = mix(shape.astype(np.uint64) + np.uint64(0x5A5A))
    else:
        shape = code
    pairs, begin = windows(code, w.first, 2)
    shapes, _ = windows(shape, w.first, 2)
    of_pair = np.repeat(np.arange(len(w.offsets) - 1), np.diff(begin))
    bucket = np.r_[code >> shift, pairs >> shift, shape >> shift, shapes >> shift].astype(np.int64)
    return bucket, np.r_[text, of_pair, text, of_pair]


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def score(self, w: Words) -> np.ndarray:
        bucket, text = hashed(w)
        n = len(w.offsets) - 1
        dot = np.bincount(text, weights=self.weights[bucket], minlength=n)
        size = np.sqrt(np.maximum(np.bincount(text, minlength=n), 1))
        return 1.0 / (1.0 + np.exp(-np.clip(dot / size + self.bias, -30, 30)))


def sparse(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of each text."""
    bucket, text = hashed(words)
    key, count = np.unique(text * np.int64(BUCKETS) + bucket, return_counts=True)
    cut_at = np.searchsorted(key, np.arange(len(words.offsets)) * np.int64(BUCKETS))
    key %= BUCKETS
    return [(key[a:b].astype(np.int32), count[a:b].astype(np.int32)) for a, b in zip(cut_at[:-1], cut_at[1:])]


def learn(rows: Callable[[], Iterable[tuple[np.ndarray, np.ndarray, int]]], epochs: int = EPOCHS) -> Model:
    """FTRL-proximal, one update a text, in the order of rows(), which begins each epoch anew.

    The bias is one more feature of weight 1 without L1.  Without rows, or with
    one label only, the model still gives scores in (0, 1).
    """
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    free = np.full(BUCKETS + 1, L1)
    free[BUCKETS] = 0.0
    for _ in range(epochs):
        for found, count, y in rows():
            at, x = np.r_[found, BUCKETS], np.r_[count / np.sqrt(max(int(count.sum()), 1)), 1.0]
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) <= free[at], 0.0, -(zi - np.sign(zi) * free[at]) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = 1.0 / (1.0 + np.exp(-np.clip(wi @ x, -30, 30)))
            g = (p - y) * x
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at] += g - sigma * wi
            n[at] += g * g
    w = np.where(np.abs(z) <= free, 0.0, -(z - np.sign(z) * free) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return Model(w[:BUCKETS], w[BUCKETS])


def train(texts: list[str | None], labels: list[int], epochs: int = EPOCHS) -> Model:
    """A model of texts at hand, in the given order."""
    found = [x for _, _, w in word_slices(pa.array(texts, pa.string()), lower=False) for x in sparse(w)]
    return learn(lambda: [(*x, y) for x, y in zip(found, labels)], epochs)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(draw, id, label, text) to (draw, id, label, buckets, counts)."""
    for batch in batches:
        for lo, hi, w in word_slices(batch.column(3), lower=False):
            found = sparse(w)
            yield pa.record_batch(
                [
                    *(batch.column(i).slice(lo, hi - lo) for i in range(3)),
                    pa.array([b.tobytes() for b, _ in found], pa.binary()), pa.array([c.tobytes() for _, c in found], pa.binary()),
                ],
                names=["draw", "id", "y", "buckets", "counts"],
            )


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id", rows: int = TRAIN_ROWS) -> Model:
    """A model of at most `rows` documents that labels mark with 0 or 1.

    Of contradicting labels of one id the larger counts, of several texts of
    one id the smallest; rows without an id teach nothing.  Texts of any
    length are read whole.
    """
    mark = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("y"))
    draw = F.xxhash64(F.col("id").cast("string"), F.lit(4))
    # the ids are chosen before the texts are touched
    chosen = mark.join(docs.select(F.col(doc_id).alias("id")).distinct(), "id", "left_semi").select(draw.alias("draw"), "id", "y").orderBy("draw", "id").limit(rows)
    found = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").select(
        "draw", F.col("id").cast("string").alias("id"), "y", "text"
    )
    once = found.groupBy("draw", "id", "y").agg(F.min("text").alias("text"))
    made = once.transform(map_batches, _features, "draw long, id string, y int, buckets binary, counts binary")
    dealt = cut(made.repartitionByRange(TRAIN_PARTS, "draw", "id").sortWithinPartitions("draw", "id"))

    def again() -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        for r in dealt.toLocalIterator():
            yield np.frombuffer(r["buckets"], dtype=np.int32), np.frombuffer(r["counts"], dtype=np.int32), r["y"]

    return learn(again)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w in word_slices(batch.column(2), lower=False):
                yield pa.record_batch(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(model.value.score(w))],
                    names=["doc_id", "held_out", "score"],
                )

    return run


def score_quality(docs: DataFrame, model: Model, held_out: Column | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score) of every row; score is the probability of label 1.

    A null or empty text has no features: its score is the bias alone.  Whole
    texts are read.  Repeated rows stay, other columns are ignored, an empty
    table gives an empty table.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = F.lit(None).cast("boolean") if held_out is None else held_out
    rows = docs.select(F.col(doc_id).alias("doc_id"), held.alias("held_out"), F.col(text).alias("text"))
    return rows.transform(map_batches, _score(shared), f"doc_id {kind}, held_out boolean, score double")


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = split_code() % 5 == 0
    model = fit(docs.where(~held_out), labels.where(~held_out))
    return score_quality(docs, model, held_out).withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))
