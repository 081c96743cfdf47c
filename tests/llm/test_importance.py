"""Importance resampling against a plain version."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sluice.llm import importance
from sluice.llm.textcore import LOWER, Words, byte_view
from tests.llm.brute import LICENSE_WORDS, lowered


def runs(text, shortest, longest):
    w = LICENSE_WORDS.findall(lowered(text))
    return [" ".join(w[i : i + k]) for k in range(shortest, longest + 1) for i in range(len(w) - k + 1)]


def plain(rows, target, shortest=1, longest=1, buckets=10_000, least=20, percent=10, seed="2024"):
    """[(id, features, words, weight, score, rank)] by dictionaries and one sort."""
    of = lambda t: [zlib.crc32(x.encode()) % buckets for x in runs(t, shortest, longest)]
    s, t = Counter(x for _, d in rows for x in of(d)), Counter(x for d in target for x in of(d))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda x: math.floor(1000 * math.log((t[x] + 1) * (n_s + buckets) / ((s[x] + 1) * (n_t + buckets))))
    out = []
    for key, text in rows:
        found = of(text)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found))
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((key, len(found), len(LICENSE_WORDS.findall(lowered(text))), weight, score))
    fit = sorted((x for x in out if x[2] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0, -x[3], -x[1]))
    drawn = fit[: percent * len(fit) // 100]
    rest = Counter(out) - Counter(drawn)
    return sorted([(*x, i + 1) for i, x in enumerate(drawn)] + [(*x, None) for x in rest.elements()], key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "n_words", "weight", "score", "rank").collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    pool = ["Alpha", "beta", "GAMMA", "naïve", "ÄRGER", "x9", "9", "e", "word" * 20, "y" * 300, "日本"]
    text = lambda: rng.choice([" ", ", ", "\n", "--"]).join(rng.choice(pool) for _ in range(rng.randrange(60)))
    return [(i, text()) for i in range(150)] + [(200, None), (201, ""), (202, " ?! "), (203, "lorem " * 9000), *[(300 + i, "copy of one text " * 8) for i in range(60)]]


TARGET = ["alpha beta alpha", "naïve x9", None, ""]


@pytest.mark.parametrize("options", [{}, {"shortest": 1, "longest": 3}, {"shortest": 2, "longest": 2, "buckets": 97, "percent": 37, "seed": "x"}, {"buckets": 1 << 16, "percent": 100}, {"percent": 0}])
def test_like_a_plain_version(spark, rows, options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    target = spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id long, text string")
    expected = plain(rows, TARGET, options.get("shortest", 1), options.get("longest", 1), options.get("buckets", 10_000), 20, options.get("percent", 10), options.get("seed", "2024"))
    assert found(importance.importance_ranks(docs, target, **options)) == expected


def test_null_and_repeated_keys_ties_and_clashing_names(spark, rows):
    """Repeated rows tie in everything and take ranks of their own."""
    many = [(None if i % 5 == 0 else i % 40, t) for i, (_, t) in enumerate(rows)] * 2
    docs = spark.createDataFrame(many, "doc_id long, text string")
    for name in ("id", "ids", "stream", "score", "rank", "n_words", "__p", "__m"):
        docs = docs.withColumn(name, F.lit("other"))
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = importance.importance_ranks(docs, target, percent=50)
    assert found(got) == plain(many, TARGET, percent=50)
    ranks = sorted(r["rank"] for r in got.collect() if r["rank"] is not None)
    assert ranks == list(range(1, len(ranks) + 1))


def test_empty_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.importance_ranks(none, docs).collect() == []
    assert found(importance.importance_ranks(docs, none)) == plain(rows, [])


def test_drawn_rows_keep_their_columns(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rank", F.lit("own"))
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = importance.resampled(docs, target)
    assert got.columns == docs.columns
    assert {r["doc_id"] for r in got.collect()} == {x[0] for x in plain(rows, TARGET) if x[5] is not None}


def test_checksums_of_words_of_any_length():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcé0") for _ in range(n)) for n in [*range(1, 90), 254, 255, 256, 257, 1000]]
    buf, offsets = byte_view(pa.array([" ".join(words), "", " ".join(reversed(words))]))
    stream, begin = importance.bucket_stream(Words(LOWER[buf], offsets, importance.APART), 1, 1, 1 << 16)
    assert stream[: begin[1]].tolist() == [zlib.crc32(x.encode()) % (1 << 16) for x in words]
    assert begin.tolist() == [0, len(words), len(words), 2 * len(words)] and stream[begin[2] :].tolist() == stream[: begin[1]].tolist()[::-1]


def test_runs_count_as_plain_counts():
    """Sorted and run-length encoded, also for an empty stream and the last bucket."""
    rng = np.random.default_rng(1)
    blocks = [rng.integers(0, 1 << 16, 5000).astype(np.uint16), np.zeros(0, np.uint16), np.full(3, 65535, np.uint16)]
    (out,) = importance._runs(iter([pa.record_batch([pa.array([b.tobytes() for b in blocks], pa.binary())], names=["stream"])]))
    assert dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist())) == dict(Counter(np.concatenate(blocks).tolist()))


def test_ranges_number_a_global_order(spark):
    df = spark.range(5000).select((F.col("id") % 700).alias("a"), "id").repartition(9)
    got = importance.numbered(df, [F.col("a").desc(), F.col("id")], "nth").orderBy("nth").collect()
    assert [r["nth"] for r in got] == list(range(1, 5001))
    assert [(r["a"], r["id"]) for r in got] == sorted(((r["a"], r["id"]) for r in got), key=lambda x: (-x[0], x[1]))


