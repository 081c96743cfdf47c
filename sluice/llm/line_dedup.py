"""Line dedup in DataFrame expressions only.

Lines are normalised, hashed and exploded; each hash counts the documents that
have it (once a document, so the counts combine before the shuffle).  A second
pass explodes lines with their positions, meets the hashes that are over the
threshold, and gathers the positions to drop by document: only lines that go
travel.  What stays of a text is put together from the stretches between the
dropped positions, so a long text with many dropped lines is linear.

No hash of a line is more than a row: a line that most documents have is a
count before it is shuffled, and its places meet it in a broadcast of at most
HOT keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textcore import HOT, cut, fresh

MIN_DOCS, MIN_CHARS = 10, 1
#: Keys over the threshold that are sent to all tasks, 16 bytes each; beyond it, the join shuffles.
BROADCAST_KEYS = 200_000
#: White space at the ends of a line that is no part of its key.
BLANKS = " \t\n\x0b\f\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Seed of the second half of a hash.
_SALT = 0x5DEECE66D


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    # lower() is the faster of the two, and the same where all symbols are ASCII
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


def _hash(*columns: Column) -> tuple[Column, Column]:
    """128 bits in two longs."""
    return F.xxhash64(*columns), F.xxhash64(F.lit(_SALT), *columns)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def frequent_lines(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, n): hash of each key found in at least `min_docs` rows of docs, and their number."""
    keys = F.array_distinct(F.transform(_lines(F.col(f"`{text}`")), line_key))
    h1, h2 = _hash(F.col("k"))
    each = docs.select(F.explode(keys).alias("k")).where(F.char_length("k") >= min_chars)
    return each.select(h1.alias("h1"), h2.alias("h2")).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)


def _dropped_places(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """Rows of lines whose hash (h1, h2) is frequent."""
    known, total = frequent.agg(F.count(F.lit(1)), F.sum("n")).head()
    keys = frequent.select("h1", "h2")
    if known <= BROADCAST_KEYS:
        return lines.join(F.broadcast(keys), ["h1", "h2"], "left_semi")
    # a key with a share of all places has that share of the frequent ones at least, so no more than HOT are hot
    hot = F.broadcast(frequent.where(F.col("n") * HOT >= total).select("h1", "h2"))
    rest = lines.join(hot, ["h1", "h2"], "left_anti").join(keys, ["h1", "h2"], "left_semi")
    return lines.join(hot, ["h1", "h2"], "left_semi").union(rest)


def _without(text: Column, dropped: Column) -> Column:
    """text without the lines at the sorted positions `dropped`, from 0."""
    cuts = lambda lines: F.concat(F.array(F.lit(-1)), dropped, F.array(F.size(lines)))

    def kept(x: Column) -> Column:
        between = lambda i: F.slice(x["lines"], F.element_at(x["cuts"], i) + 2, F.element_at(x["cuts"], i + 1) - F.element_at(x["cuts"], i) - 1)
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(1), F.size(x["cuts"]) - 1), between)), "\n")

    # names for values that are made once a row
    split = F.transform(F.array(_lines(text)), lambda lines: F.struct(lines.alias("lines"), cuts(lines).alias("cuts")))
    return F.element_at(F.transform(split, kept), 1)


def drop_repeated_lines(
    docs: DataFrame, text: str = "text", key: str | None = "doc_id", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
    n_lines: str = "n_lines", n_dropped: str = "n_dropped",
) -> DataFrame:
    """docs without the lines whose key stands in at least `min_docs` rows, in every row.

    A key is the line without white space at its ends and with A-Z in lower
    case; keys below `min_chars` code points stay.  Other lines stay as they
    are, in order, joined by newlines; a text all of whose lines go is empty.
    A null text stays null and counts as one empty line.  Repeated rows are
    rows of their own, and repeated lines of a row count once.  An empty table
    stays empty.  `n_lines` (before dropping) and `n_dropped` are added, or
    replace columns of those names; all others pass through.  `key` only
    spreads equal texts over tasks: it may be null or repeated, or left out.
    """
    rest = docs.drop(n_lines, n_dropped)
    r1, r2, at = fresh(rest, "__r1", "__r2", "__at")
    whole = F.col(f"`{text}`")
    by = [F.col(f"`{key}`").cast("string")] if key is not None else []
    a, b = _hash(*by, whole)
    rows = rest.withColumns({r1: a, r2: b})
    h1, h2 = _hash(line_key(F.col("line")))
    frequent = cut(frequent_lines(docs, text, min_docs, min_chars))
    lines = rows.select(r1, r2, F.posexplode(_lines(whole)).alias("pos", "line")).select(r1, r2, "pos", h1.alias("h1"), h2.alias("h2"))
    # equal rows share a hash and have equal positions: a set
    gone = _dropped_places(lines, frequent).groupBy(r1, r2).agg(F.array_sort(F.collect_set("pos")).alias(at))
    return rows.join(gone, [r1, r2], "left").select(
        *(F.when(F.col(at).isNull(), whole).otherwise(_without(whole, F.col(at))).alias(c) if c == text else F.col(f"`{c}`") for c in rest.columns),
        F.size(_lines(whole)).cast("long").alias(n_lines), F.when(F.col(at).isNull(), F.lit(0)).otherwise(F.size(at)).cast("long").alias(n_dropped),
    )


def op11_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = drop_repeated_lines(docs)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
