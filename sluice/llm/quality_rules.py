"""Quality rules as a short-circuit cascade, ordered by rejections per cost.

A rule is a test on counts of a text.  On a drawn sample every count is timed
and every rule run, on the executors.  The order is then chosen greedily: next
comes the rule that rejects most of the texts still left for the time of the
counts that it needs and that no earlier rule (nor the caller) has made.  In
the cascade a text leaves at the first rule that rejects it, and counts are
made for the texts that are left.  The order changes the work, never the
verdict: a text is kept if no rule rejects it.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import IS_SPACE, Words, byte_view, map_batches, slices, windows

#: The sample from which rules are ordered: partitions drawn at most, rows of each at most.
SAMPLE_PARTS, SAMPLE_ROWS = 8, 50
SEED = 11

#: The symbols that n_symbols counts.
SYMBOLS = b"#*$%&|<>"
IS_SYMBOL = np.zeros(256, dtype=bool)
IS_SYMBOL[list(SYMBOLS)] = True
IS_CAPITAL = np.zeros(256, dtype=bool)
IS_CAPITAL[65:91] = True
IS_SMALL = np.zeros(256, dtype=bool)
IS_SMALL[97:123] = True
IS_DIGIT = np.zeros(256, dtype=bool)
IS_DIGIT[48:58] = True


class Texts:
    """Lazily computed counts of the texts of a slice, and the seconds that each took."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf, self.offsets, self.n = buf, offsets, len(offsets) - 1
        self.seen: dict[str, np.ndarray] = {}
        self.seconds: dict[str, float] = {}
        self._words: Words | None = None

    def get(self, name: str) -> np.ndarray:
        if name not in self.seen:
            for other in NEEDS.get(name, ()):
                self.get(other)
            began = time.perf_counter()
            self.seen[name] = METRICS[name](self)
            self.seconds[name] = time.perf_counter() - began
        return self.seen[name]

    @property
    def words(self) -> Words:
        if self._words is None:
            self._words = Words(self.buf, self.offsets)
        return self._words

    def only(self, keep: np.ndarray) -> Texts:
        """The texts where keep is true, with the counts known so far."""
        size = np.diff(self.offsets)
        out = Texts(self.buf[np.repeat(keep, size)], np.r_[0, np.cumsum(size[keep])])
        out.seen = {k: v[keep] for k, v in self.seen.items()}
        return out

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Bytes of each text where flags is true."""
        return np.diff(np.r_[0, np.cumsum(flags)][self.offsets])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of every line, cut at newlines."""
        newline = np.flatnonzero(self.buf == 10)
        text = np.searchsorted(self.offsets, newline, side="right") - 1
        start = np.sort(np.r_[self.offsets[:-1], newline + 1])
        return start, np.sort(np.r_[newline, self.offsets[1:]]), np.sort(np.r_[np.arange(self.n), text])


def _word_chars(t: Texts) -> np.ndarray:
    return t.per_text(~IS_SPACE[t.buf] & ((t.buf & 0xC0) != 0x80))


def _dup_lines(t: Texts) -> np.ndarray:
    """Lines (cut at newline) with a word that equal an earlier line of their text."""
    w = t.words
    start, end, text = t.lines()
    has_word = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end, text = start[has_word], end[has_word], text[has_word]
    code = w.span_code(start, end)
    order = np.lexsort((code, text))
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (code[order][1:] == code[order][:-1]) & (text[order][1:] == text[order][:-1])
    return np.bincount(text[order][same], minlength=t.n)


def _repeat_words(t: Texts) -> np.ndarray:
    """Words that stand in a 3-word window found twice or more in their text."""
    w = t.words
    code, begin = windows(w.code, w.first, 3)
    text = np.repeat(np.arange(t.n), np.diff(begin))
    order = np.lexsort((code, text))
    same = (code[order][1:] == code[order][:-1]) & (text[order][1:] == text[order][:-1])
    twice = np.zeros(len(code), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = (np.repeat(w.first[:-1] - begin[:-1], np.diff(begin)) + np.arange(len(code)))[twice]
    covered = np.zeros(len(w.start), dtype=bool)
    for i in range(3):
        covered[at + i] = True
    return np.diff(np.r_[0, np.cumsum(covered)][w.first])


def _bullets(t: Texts) -> np.ndarray:
    """Lines that begin with - or *."""
    start, end, text = t.lines()
    first = t.buf[np.minimum(start, max(len(t.buf) - 1, 0))] if len(t.buf) else np.zeros(len(start), np.uint8)
    return np.bincount(text[(end > start) & ((first == 45) | (first == 42))], minlength=t.n)


def _ellipses(t: Texts) -> np.ndarray:
    """Lines that end with three dots."""
    start, end, text = t.lines()
    long = end - start >= 3
    at = end[long]
    return np.bincount(text[long][(t.buf[at - 1] == 46) & (t.buf[at - 2] == 46) & (t.buf[at - 3] == 46)], minlength=t.n)


METRICS: dict[str, Callable[[Texts], np.ndarray]] = {
    "n_words": lambda t: np.diff(t.words.first),
    "word_chars": _word_chars,
    "n_symbols": lambda t: t.per_text(IS_SYMBOL[t.buf]),
    "n_capitals": lambda t: t.per_text(IS_CAPITAL[t.buf]),
    "n_small": lambda t: t.per_text(IS_SMALL[t.buf]),
    "n_digits": lambda t: t.per_text(IS_DIGIT[t.buf]),
    "n_lines": lambda t: t.per_text(t.buf == 10) + 1,
    "n_bullets": _bullets,
    "n_ellipses": _ellipses,
    "n_dup_lines": _dup_lines,
    "n_repeat_words": _repeat_words,
}
#: Counts that another one needs first (the words of the texts come with n_words).
NEEDS = {"n_dup_lines": ("n_words",), "n_repeat_words": ("n_words",)}


@dataclass(frozen=True)
class Rule:
    """A test on the counts named in `needs`: rejects(count) -> one boolean per text."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., np.ndarray]

    def __call__(self, t: Texts) -> np.ndarray:
        return self.rejects(*(t.get(n) for n in self.needs))


#: The two base rules first; the order here is only the tie-break.
RULES = (
    Rule("few_words", ("n_words",), lambda w: w < 50),
    Rule("repeated_words", ("n_repeat_words", "n_words"), lambda r, w: 100 * r > 50 * w),
    Rule("symbols", ("n_symbols", "n_words"), lambda s, w: 4 * s > w),
    Rule("capitals", ("n_capitals", "n_small"), lambda c, s: c > s),
    Rule("digits", ("n_digits", "word_chars"), lambda d, c: 2 * d > c),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda d, n: 10 * d > 6 * n),
    Rule("bullets", ("n_bullets", "n_lines"), lambda b, n: 10 * b > 9 * n),
    Rule("ellipses", ("n_ellipses", "n_lines"), lambda e, n: 10 * e > 3 * n),
    Rule("word_length", ("word_chars", "n_words"), lambda c, w: (c < 2 * w) | (c > 25 * w)),
)
BASE = ("few_words", "repeated_words")


def measure(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> tuple[dict[str, float], np.ndarray]:
    """(seconds of each count, rejected by [text, rule]) of a sample; the least time of three counts."""
    buf, offsets = byte_view(pa.array(texts, pa.string()))
    seconds: dict[str, float] = {}
    verdict = np.zeros((len(texts), len(rules)), dtype=bool)
    for _ in range(3):
        t = Texts(buf, offsets)
        for i, rule in enumerate(rules):
            verdict[:, i] = rule(t)
        seconds = {k: min(v, seconds.get(k, v)) for k, v in t.seconds.items()}
    return seconds, verdict


def rank_rules(seconds: Mapping[str, float], verdict: np.ndarray, rules: tuple[Rule, ...] = RULES, given: tuple[str, ...] = ()) -> list[tuple[str, float, int]]:
    """(rule, further seconds, further rejections) in cascade order.

    Greedy: each step takes the rule with the most rejections among the texts
    left per second of counts not made yet; counts in `given` cost nothing.
    Without texts the given order stays.
    """
    made, out = set(given), []
    left, todo = np.ones(len(verdict), dtype=bool), list(range(len(rules)))

    def cost(rule: Rule) -> float:
        new: set[str] = set()
        for n in rule.needs:
            new |= {n, *NEEDS.get(n, ())}
        return sum(seconds.get(n, 0.0) for n in new - made) + 1e-7

    while todo:
        hits = {i: int((verdict[:, i] & left).sum()) for i in todo}
        best = max(todo, key=lambda i: (hits[i] / cost(rules[i]), -i))
        out.append((rules[best].name, cost(rules[best]), hits[best]))
        todo.remove(best)
        left &= ~verdict[:, best]
        for n in rules[best].needs:
            made |= {n, *NEEDS.get(n, ())}
    return out


def plan(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, given: tuple[str, ...] = (), parts: int = SAMPLE_PARTS, rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules in cascade order, from at most rows rows of at most parts drawn partitions.

    Only those rows are read.  They are counted where they are, whole texts;
    the driver gets seconds and verdicts.
    """
    table = docs.select(F.col(text).alias("text")).rdd
    n = table.getNumPartitions()
    drawn = sorted(random.Random(SEED).sample(range(n), min(parts, n)))

    def sampled(found):
        texts = [r[0] for _, r in zip(range(rows), found)]
        return [measure(texts, rules)] if texts else []

    seconds: dict[str, float] = {}
    verdicts = [np.zeros((0, len(rules)), dtype=bool)]
    for taken, verdict in docs.sparkSession.sparkContext.runJob(table, sampled, drawn) if drawn else []:
        verdicts.append(verdict)
        for k, v in taken.items():
            seconds[k] = seconds.get(k, 0.0) + v
    return [name for name, _, _ in rank_rules(seconds, np.concatenate(verdicts), rules, given)]


def cascade(t: Texts, order: list[Rule]) -> np.ndarray:
    """Name of the first rule that rejects each text, None where none does.

    Before a count that isn't made yet, rejected texts are left behind if they
    hold half of the bytes or more: copying the others then costs less.
    """
    verdict = np.full(t.n, None, dtype=object)
    row = np.arange(t.n)
    alive = np.ones(t.n, dtype=bool)
    for rule in order:
        if not alive.any():
            break
        if any(n not in t.seen for n in rule.needs) and 2 * np.diff(t.offsets)[alive].sum() <= len(t.buf):
            t, row, alive = t.only(alive), row[alive], np.ones(int(alive.sum()), dtype=bool)
        bad = rule(t) & alive
        verdict[row[bad]] = rule.name
        alive &= ~bad
    return verdict


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _judge(order: list[str], rules: tuple[Rule, ...], counts: bool):
    by_name = {r.name: r for r in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = byte_view(batch.column(batch.num_columns - 1))
            for lo, hi in slices(offsets):
                t = Texts(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                for name in COUNTS if counts else ():
                    t.get(name)
                verdict = cascade(t, [by_name[n] for n in order])
                kept = np.array([v is None for v in verdict], dtype=bool)
                columns = [c.slice(lo, hi - lo) for c in batch.columns[:-1]]
                names = list(batch.schema.names[:-1])
                if counts:
                    failed = np.zeros(t.n, dtype=bool)
                    for rule in RULES[: len(BASE)]:
                        failed |= rule(t)
                    columns += [pa.array(t.get(name)) for name in COUNTS] + [pa.array(failed)]
                    names += [*COUNTS, "base_failed"]
                columns += [pa.array(kept), pa.array(list(verdict), pa.string())]
                yield pa.record_batch(columns, names=[*names, "kept", "rejected_by"])

    return run


def judge(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rules: tuple[Rule, ...] = RULES, counts: bool = False) -> DataFrame:
    """(doc_id, kept, rejected_by) of every row; with counts, the counts as well.

    A null or empty text has no words and is rejected as too short.  A count
    that only later rules need is not made for a text that one rejects (but
    where few texts of a slice go, for the slice as a whole).  With counts, the
    base counts are made for all texts, and the order treats them as free.  An
    empty table gives an empty table; other columns are ignored; repeated rows
    stay, and rows with a null id as well.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    order = plan(docs, text, rules, COUNTS if counts else ())
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = f"doc_id {kind}, {SCHEMA}" if counts else f"doc_id {kind}, kept boolean, rejected_by string"
    return rows.transform(map_batches, _judge(order, rules, counts), out)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, counts=True).drop("rejected_by")  # which rule came first depends on measured costs
