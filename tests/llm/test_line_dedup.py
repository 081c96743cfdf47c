"""Line dedup against a plain version, on edge rows and hot lines."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sluice.llm import line_dedup
from tests.llm.brute import lowered

BLANKS = " \t\n\x0b\f\r"


def plain(texts, min_docs, min_chars=1):
    """(text, lines, dropped) of each text."""
    key = lambda line: lowered(line.strip(BLANKS))
    lines = [(t or "").split("\n") for t in texts]
    n = Counter(k for ls in lines for k in {key(x) for x in ls})
    gone = {k for k, c in n.items() if c >= min_docs and len(k) >= min_chars}
    kept = [[x for x in ls if key(x) not in gone] for ls in lines]
    return [(None if t is None else "\n".join(k), len(ls), len(ls) - len(k)) for t, ls, k in zip(texts, lines, kept)]


def found(df):
    return sorted(((r["text"], r["n_lines"], r["n_dropped"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    pool = ["Hot", " hot\t", "HOT\r", "Ähnlich", "ähnlich", "\x0b\f", "", "a", "  b  c ", "ß", "x" * 3000, "Ärger", "ÄRGER", "two ", "two"]
    out = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9))) for _ in range(120)]
    return [*out, None, "", "\n", "\n\n\n", "only here", "Hot", "Hot\n", "hot\nhot\nhot", "kept\nHot\nkept too\n\nhot", *["copy\nof a text"] * 9]


@pytest.mark.parametrize("most", [line_dedup.BROADCAST_KEYS, 0])
@pytest.mark.parametrize("min_docs, min_chars", [(10, 1), (9, 1), (2, 3), (1, 1)])
def test_like_a_plain_version(spark, texts, monkeypatch, most, min_docs, min_chars):
    """Broadcast and shuffled keys alike; copies at the threshold and one below it."""
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", most)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = line_dedup.drop_repeated_lines(df, min_docs=min_docs, min_chars=min_chars)
    assert found(got) == sorted(plain(texts, min_docs, min_chars), key=str)


@pytest.mark.parametrize("key", ["doc_id", None])
def test_null_and_repeated_ids_and_clashing_names(spark, texts, key):
    """Ids only spread the work; other columns pass, whatever their names."""
    twice = [*texts, *texts]
    rows = [(None if i % 3 else 7, t, i) for i, t in enumerate(twice)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h1 long")
    for name in ("h2", "n", "k", "pos", "line", "n_lines", "n_dropped", "__r1", "__at"):
        df = df.withColumn(name, F.lit("other"))
    got = line_dedup.drop_repeated_lines(df, key=key, min_docs=5)
    assert got.columns == [*(c for c in df.columns if c not in ("n_lines", "n_dropped")), "n_lines", "n_dropped"]
    assert {(r["h1"], r["text"]) for r in got.collect()} == {(i, t) for i, (t, _, _) in enumerate(plain(twice, 5))}
    assert got.where("h2 = 'other' and k = 'other' and __at = 'other'").count() == len(rows)


def test_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.drop_repeated_lines(df).collect() == []


def test_long_texts_and_a_line_of_all_rows(spark):
    """A text of 60,000 lines, every other of which goes, and a line that each row has many times."""
    many = [f"row {i}\nHEAD" for i in range(300)]
    texts = [*many, "\n".join(f"own {i}\nhead " for i in range(30_000)), *["head\n" * 200] * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = line_dedup.drop_repeated_lines(df)
    assert found(got) == sorted(plain(texts, 10), key=str)


def test_only_dropped_places_travel(spark, sf_dir):
    """No exchange holds lines, and the counts combine before theirs."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = line_dedup.frequent_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and "Python" not in plan and "Arrow" not in plan
    whole = line_dedup.drop_repeated_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in whole and "Arrow" not in whole and "NestedLoop" not in whole and "Cartesian" not in whole
