"""Ranked search against a plain version that scores every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sluice.llm import lexical_search
from tests.llm.brute import lowered

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs, items, top):
    """[(item id, rank, doc id, score)], by scoring all documents for all items."""
    found = [Counter(lowered(x) for x in TERMS.findall(t or "")) for _, t in docs]
    n_docs, n_terms = sum(bool(c) for c in found), sum(sum(c.values()) for c in found)
    df = Counter(w for c in found for w in c)
    out = []
    for item, text in items:
        scored = []
        for (key, _), c in zip(docs, found):
            m = 50 + 50 * sum(c.values()) * n_docs // max(n_terms, 1)
            s = 0
            for w in {lowered(x) for x in TERMS.findall(text or "")} & c.keys():
                s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 20 * m))
            if s > 0:
                scored.append((-s, key is None, key or 0, key))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(13)
    pool = ["the"] * 30 + ["of"] * 20 + ["Alpha", "BETA", "gamma", "naïve", "Ärger", "x9", "日本", "w" * 200] + [f"rare{i}" for i in range(60)]
    text = lambda n: rng.choice([" ", ", ", "\n", "--", "_"]).join(rng.choice(pool) for _ in range(n))
    docs = [(i * 3 % 401, text(rng.randrange(80))) for i in range(401)]
    docs += [(1000, None), (1001, ""), (1002, " ?! "), (1003, "alpha " * 20_000), *[(1100 + i, "copy of alpha and rare1") for i in range(90)]]
    items = [(i, text(rng.randrange(1, 30))) for i in range(25)] + [(50, None), (51, ""), (52, "nowhere found"), (53, "copy rare1"), (54, "the the THE"), (55, "alpha")]
    return docs, items


def frames(spark, docs, items, parts=5):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(parts), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("top, shard_docs, together", [(10, 8192, 256), (10, 7, 4), (1, 50, 1), (600, 64, 256)])
def test_like_a_plain_version(spark, corpus, monkeypatch, top, shard_docs, together):
    """Small and large shards, heaps that fill and that never do; many documents tie."""
    # the functions that Spark sends to its workers read these where they are called
    shards, run = lexical_search._shards, lexical_search._search

    def small_shards(codes):
        inner = shards(codes)

        def go(batches):
            lexical_search.SHARD_DOCS = shard_docs
            yield from inner(b for batch in batches for b in (batch.slice(i, 5) for i in range(0, batch.num_rows, 5)))

        return go

    def few_items(*a):
        inner = run(*a)

        def go(batches):
            lexical_search.TOGETHER = together
            yield from inner(batches)

        return go

    monkeypatch.setattr(lexical_search, "_shards", small_shards)
    monkeypatch.setattr(lexical_search, "_search", few_items)
    assert found(lexical_search.search(*frames(spark, *corpus), top=top)) == plain(*corpus, top)


def test_several_indexes(spark, corpus, monkeypatch):
    """More terms than one index serves."""
    monkeypatch.setattr(lexical_search, "INDEX_TERMS", 12)
    assert len(list(lexical_search.item_groups(frames(spark, *corpus)[1], "text", "item_id"))) > 3
    assert found(lexical_search.search(*frames(spark, *corpus), top=7)) == plain(*corpus, 7)


def test_null_and_repeated_ids_and_clashing_names(spark, corpus):
    docs, items = corpus
    docs = [(None if i % 7 == 0 else k % 100, t) for i, (k, t) in enumerate(docs)] + docs[:20]
    items = [*items[:6], (None, "alpha rare1"), (3, "beta")]
    d, q = frames(spark, docs, items)
    for name in ("id", "ids", "term", "score", "rank", "item", "part", "number"):
        d, q = d.withColumn(name, F.lit("other")), q.withColumn(name, F.lit("other"))
    assert found(lexical_search.search(d, q, top=9)) == plain(docs, items, 9)


def test_empty_tables(spark, corpus):
    docs, items = frames(spark, *corpus)
    assert lexical_search.search(docs.limit(0), items).collect() == []
    assert lexical_search.search(docs, items.limit(0)).collect() == []
    assert lexical_search.search(docs, items.limit(0)).columns == lexical_search.search(docs, items).columns


def test_weak_documents_are_not_scored():
    """Of 4,000 documents that hold a term of the item only those that can reach the threshold are scored."""
    rng = random.Random(2)
    texts = [" ".join(["common"] * rng.randrange(1, 4) + ["filler"] * 30 + (["scarce"] if i % 40 == 0 else [])) for i in range(4000)]
    ids, text = pa.array(range(4000), pa.int64()), pa.array(texts)
    w = next(lexical_search.term_slices(pa.array(["common scarce"])))[2]
    codes = np.unique(w.code)
    (out,) = lexical_search._shards(codes)(iter([pa.record_batch([ids, text], names=["id", "text"])]))
    parts = [np.frombuffer(out.column(c)[0].as_buffer(), dtype=np.int32 if c < 4 else np.int64) for c in (1, 2, 3, 4)]
    df = np.bincount(parts[0], minlength=2)
    shard = lexical_search.Shard.of(ids, *parts, lexical_search.term_weights(df, 4000), 4000, sum(len(t.split()) for t in texts))
    heaps = lexical_search.Heaps(1, 10)
    scored = lexical_search.search_shard([np.array([0, 1])], shard, heaps)
    assert scored < 400
    best = sorted(zip(heaps.score[0].tolist(), heaps.id[0].tolist()), key=lambda x: (-x[0], x[1]))
    assert [(s, d) for _, _, d, s in sorted(plain(list(enumerate(texts)), [(0, "common scarce")], 10), key=lambda x: x[1])] == best


def test_lengths_beyond_64_bits():
    size = np.array([0, 3, 10**9])
    assert lexical_search.lengths(size, 10**12, 7 * 10**12).tolist() == [50 + 50 * int(x) * 10**12 // (7 * 10**12) for x in size]
