"""Language of each word by a linear-chain conditional random field.

A word's emission is a sum of learned weights of hashed features: prefixes,
suffixes, inner byte trigrams and the whole word (the lexicon).  Learned
transitions tie neighbouring words, and forward-backward gives each word's
language probabilities, so that code-switched text is labelled word by word.
Half of the training words stand in chains put together from texts of several
languages, from which the transitions learn what a switch is worth.  A text's
language is the one with the largest mean probability over its words.

The chain runs over all texts of a slice in step: one array operation handles
the t-th word of every text that has one.  A long text is cut into blocks whose
transfer matrices are multiplied up, so that its blocks run in step as well;
the result is that of the whole chain.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textcore import Words, byte_view, cut, map_batches, slices, split_code

#: Training rows of each language at most, the first by a hash; of all languages
#: together TRAIN_ROWS (but LEAST_ROWS of each), so that many languages have fewer
#: rows each.  A row teaches by its whole text, in passages of PASSAGE bytes, of
#: which the driver has those of a partition, AT_ONCE or so, at a time.
TRAIN_PER_LANGUAGE, TRAIN_ROWS, LEAST_ROWS = 250, 16_000, 8
PASSAGE, AT_ONCE = 20_000, 320
BUCKETS = 1 << 16
#: Buckets in which training counts trigrams; one is familiar that comes FAMILIAR
#: times in the texts of TRAIN_PER_LANGUAGE rows, in fewer rows as much more rarely.
TRIGRAMS, FAMILIAR = 1 << 20, 3
PREFIXES, SUFFIXES, INNER = (2, 3), (2, 3, 4), 3
EPOCHS, BATCH_TEXTS, RATE = 3, 40, 0.4
FEATURE_BYTES, CHAIN_BYTES = 1 << 19, 2 << 20
#: Words of a block of a long chain, for few and for many languages.
BLOCK_WORDS, FEW = (512, 4096), 16
#: Mean words of a piece, and pieces of a chain, in switched training chains.
PIECE_WORDS, PIECES = 12, 4

#: A word is a run of ASCII letters and non-ASCII bytes.
IS_BREAK = np.ones(256, dtype=bool)
IS_BREAK[97:123] = False
IS_BREAK[65:91] = False
IS_BREAK[128:] = False


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of the Latin-1 letters in small letters."""
    out = buf.copy()
    out[(buf >= 65) & (buf <= 90)] += 32
    if len(buf) > 1:
        latin = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        out[1:][latin] += 32
    return out


def features(w: Words, lo: int, hi: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(one bucket array per affix or lexicon feature, trigram buckets, trigrams, their words) of words lo..hi."""
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    first, last = w.start[lo:hi], w.end[lo:hi]

    def hashed(start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
        return w.span_code(start, end) * np.uint64(2 * salt + 1)

    def bucket(start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
        return (hashed(start, end, salt) >> shift).astype(np.int32)

    single = [bucket(first, last, 0)]
    single += [bucket(first, np.minimum(first + k, last), k) for k in PREFIXES]
    single += [bucket(np.maximum(last - k, first), last, 10 + k) for k in SUFFIXES]
    count = np.maximum(last - first - INNER + 1, 0)
    word = np.repeat(np.arange(len(count)), count)
    begin = np.r_[0, np.cumsum(count)][:-1]
    at = np.repeat(first - begin, count) + np.arange(len(word))
    inner = hashed(at, at + INNER, 30)
    return single, (inner >> shift).astype(np.int32), (inner >> np.uint64(64 - TRIGRAMS.bit_length() + 1)).astype(np.int32), word


def in_pieces(text_of: np.ndarray, n_texts: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(order of words, first word of each chain plus the end): half of the texts as
    they are, the others cut into pieces that are shuffled and chained."""
    n = len(text_of)
    whole = rng.random(n_texts) < 0.5
    cut = ~whole[text_of] & (rng.random(n) < 1 / PIECE_WORDS)
    edge = np.ones(n, dtype=bool)
    edge[1:] = (text_of[1:] != text_of[:-1]) | cut[1:]
    at = np.r_[np.flatnonzero(edge), n]
    size, stays = np.diff(at), whole[text_of[at[:-1]]]
    loose = rng.permutation(np.flatnonzero(~stays))
    pieces = np.r_[np.flatnonzero(stays), loose]
    order = np.repeat(at[pieces] - np.r_[0, np.cumsum(size[pieces])][:-1], size[pieces]) + np.arange(n)
    begins = np.r_[np.arange(int(stays.sum())), int(stays.sum()) + np.arange(0, len(loose), PIECES)]
    return order, np.r_[np.r_[0, np.cumsum(size[pieces])][begins], n]


class Crf:
    """Weights [bucket, language] and transition scores [from, to]."""

    def __init__(self, languages: list[str]):
        k = len(languages)
        self.languages = languages
        self.weights = np.zeros((BUCKETS, k), dtype=np.float32)
        self.moves = np.eye(k) * 2.0
        self.known = np.zeros(TRIGRAMS, dtype=bool)

    def ranges(self, w: Words) -> Iterator[tuple[int, int]]:
        """Ranges of words of some FEATURE_BYTES together."""
        step = max(FEATURE_BYTES // max(1, len(self.languages) // FEW), 1)
        lo = 0
        while lo < len(w.start):
            hi = max(lo + 1, int(np.searchsorted(w.start, w.start[lo] + step)))
            yield lo, hi
            lo = hi

    def emissions(self, w: Words, lo: int, hi: int) -> tuple[np.ndarray, tuple]:
        single, inner, _, word = found = features(w, lo, hi)
        out = np.zeros((hi - lo, len(self.languages)), dtype=np.float32)
        for b in single:
            out += self.weights[b]
        if len(word):
            count = np.bincount(word, minlength=len(out))
            part = np.r_[0, np.cumsum(count)]
            has = count > 0
            out[has] += np.add.reduceat(self.weights[inner], part[:-1][has], axis=0) / count[has, None].astype(np.float32)
        return out, found

    def marginals(self, emission: np.ndarray, first: np.ndarray, pairs: bool = False, block: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(language probabilities of each word, expected transitions) by forward-backward."""
        k = len(self.languages)
        block = block or BLOCK_WORDS[k > FEW]
        emit = np.exp(emission - emission.max(axis=1, keepdims=True)).astype(np.float64) if len(emission) else emission
        step = np.exp(self.moves - self.moves.max())
        # blocks of chains, the longest first
        many = -(-np.diff(first) // block)
        nth = np.arange(many.sum()) - np.repeat(np.r_[0, np.cumsum(many)][:-1], many)
        head = np.repeat(first[:-1], many) + nth * block
        size = np.minimum(np.repeat(first[1:], many) - head, block)
        before, after = np.full((len(head), k), 1.0 / k), np.ones((len(head), k))
        if len(nth) and nth.max():
            self._borders(emit, step, head, size, nth, before, after)
        order = np.argsort(-size, kind="stable")
        head, size, inside = head[order], size[order], nth[order] > 0
        a, b = before[order], after[order]
        entering = a.copy()
        longest = int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(longest), side="left")
        ahead = np.empty_like(emit)
        for t in range(longest):
            m = active[t]
            at = head[:m] + t
            a = (a[:m] @ step if t else np.where(inside[:m, None], a[:m] @ step, a[:m])) * emit[at]
            a /= a.sum(axis=1, keepdims=True)
            ahead[at] = a
        out = np.empty_like(emit)
        expected = np.zeros((k, k))
        for t in range(longest - 1, -1, -1):
            m = active[t]
            at = head[:m] + t
            if t + 1 < longest:
                n = active[t + 1]
                later = b[:n] * emit[at[:n] + 1]
                if pairs:
                    expected += self._moved(ahead[at[:n]], step, later)
                b[:n] = later @ step.T
                b[:n] /= b[:n].sum(axis=1, keepdims=True)
            g = ahead[at] * b[:m]
            out[at] = g / g.sum(axis=1, keepdims=True)
        if pairs and inside.any():
            expected += self._moved(entering[inside], step, b[inside] * emit[head[inside]])
        return out, expected

    @staticmethod
    def _moved(a: np.ndarray, step: np.ndarray, later: np.ndarray) -> np.ndarray:
        both = a[:, :, None] * step[None] * later[:, None, :]
        return (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)

    def _borders(self, emit, step, head, size, nth, before, after) -> None:
        """What enters each block from its left (before) and from its right (after)."""
        k = emit.shape[1]
        last = np.r_[nth[1:] == 0, True]
        own = np.flatnonzero(~(last & (nth == 0)))  # blocks of chains that have several
        own = own[np.argsort(-size[own], kind="stable")]
        through = np.repeat(np.eye(k)[None], len(own), axis=0)
        for t in range(int(size[own[0]])):
            m = int(np.searchsorted(-size[own], -t, side="left"))
            now = through[:m]
            moved = (now.reshape(-1, k) @ step).reshape(m, k, k) if t else np.where((nth[own[:m]] > 0)[:, None, None], step[None], now)
            moved *= emit[head[own[:m]] + t][:, None, :]
            through[:m] = moved / moved.max(axis=(1, 2), keepdims=True)
        at = np.empty(len(head), dtype=np.int64)
        at[own] = np.arange(len(own))
        for j in range(1, int(nth.max()) + 1):
            b = np.flatnonzero(nth == j)
            v = (before[b - 1][:, None, :] @ through[at[b - 1]])[:, 0]
            before[b] = v / v.sum(axis=1, keepdims=True)
        for j in range(int(nth.max()), 0, -1):
            b = np.flatnonzero(nth == j)
            v = (through[at[b]] @ after[b][:, :, None])[:, :, 0]
            after[b - 1] = v / v.sum(axis=1, keepdims=True)

    def learn(self, passages: Callable[[], Iterable[tuple[str, int]]], rows: np.ndarray) -> None:
        """Adaptive gradient steps on the log-likelihood of the word labels.

        passages() gives (text, label) in a fixed order that mixes labels, anew
        for each epoch; rows are the training rows of each language.  Every
        word of a passage bears its label; pieces of half of the passages stand
        in chains of several languages (in_pieces).
        """
        squares = np.full(self.weights.shape, 1e-3, dtype=np.float32)
        move_squares = np.full(self.moves.shape, 1e-3)
        k = len(self.languages)
        rng = np.random.default_rng(7)
        times = np.zeros(TRIGRAMS)
        worth = TRAIN_PER_LANGUAGE / np.maximum(rows, 1)
        for epoch in range(EPOCHS):
            for some in batched(passages(), BATCH_TEXTS):
                labels = np.array([y for _, y in some])
                buf, offsets = byte_view(pa.array([t for t, _ in some], pa.string()))
                w = Words(lowered(buf), offsets, IS_BREAK)
                if not len(w.start):
                    continue
                emission, (single, inner, trigram, word) = self.emissions(w, 0, len(w.start))
                if epoch == 0:
                    times += np.bincount(trigram, weights=worth[labels[w.text_of()[word]]], minlength=TRIGRAMS)
                place, first = in_pieces(w.text_of(), len(some), rng)
                p, expected = np.empty((len(place), k)), None
                p[place], expected = self.marginals(emission[place], first, pairs=True)
                truth = labels[w.text_of()]
                error = -p
                error[np.arange(len(truth)), truth] += 1.0
                error /= len(truth)
                count = np.maximum(np.bincount(word, minlength=len(truth)), 1)
                bucket = np.concatenate([*single, inner])
                for c in range(k):
                    e = np.concatenate([*([error[:, c]] * len(single)), (error[:, c] / count)[word]])
                    g = np.bincount(bucket, weights=e, minlength=BUCKETS) * 100
                    squares[:, c] += g * g
                    self.weights[:, c] += (RATE * g / np.sqrt(squares[:, c])).astype(np.float32)
                seen = np.zeros((k, k))
                chained = truth[place]
                follows = np.ones(len(place), dtype=bool)
                follows[first[:-1][first[:-1] < len(place)]] = False
                next_to = np.flatnonzero(follows)
                np.add.at(seen, (chained[next_to - 1], chained[next_to]), 1.0)
                g = (seen - expected) / max(seen.sum(), 1) - 1e-3 * self.moves
                move_squares += g * g
                self.moves += RATE * g / np.sqrt(move_squares)
        self.known = times >= FAMILIAR

    def label(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Words, np.ndarray]]:
        """(rows, mean language probabilities by text, by word, words, familiarity) of each slice.

        A text's familiarity is the share of its words' trigrams that training
        has seen often enough, 1 without any.  Features are made for a bounded number of
        bytes at a time; the chain then runs over CHAIN_BYTES of text together,
        as its cost is in steps more than in words.
        """
        buf, offsets = byte_view(column)
        held: list[tuple[int, int, Words, np.ndarray, np.ndarray]] = []
        many = max(1, len(self.languages) // FEW)
        for lo, hi in slices(offsets, FEATURE_BYTES // many):
            w = Words(lowered(buf[offsets[lo] : offsets[hi]]), offsets[lo : hi + 1] - offsets[lo], IS_BREAK)
            emission = np.zeros((len(w.start), len(self.languages)), dtype=np.float32)
            seen, met = np.zeros(hi - lo), np.zeros(hi - lo)
            text = w.text_of()
            if self.languages:
                for a, b in self.ranges(w):
                    emission[a:b], (_, _, trigram, word) = self.emissions(w, a, b)
                    met += np.bincount(text[a:b][word], minlength=hi - lo)
                    seen += np.bincount(text[a:b][word], weights=self.known[trigram], minlength=hi - lo)
            w.forget()
            held.append((lo, hi, w, emission, np.where(met > 0, seen / np.maximum(met, 1), 1.0)))
            if offsets[hi] - offsets[held[0][0]] >= CHAIN_BYTES // many:
                yield from self._chained(held)
                held = []
        if held:
            yield from self._chained(held)

    def _chained(self, held: list) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Words, np.ndarray]]:
        k = len(self.languages)
        begin = np.r_[0, np.cumsum([len(h[3]) for h in held])]
        if k:
            first = np.concatenate([h[2].first[:-1] + b for h, b in zip(held, begin)] + [begin[-1:]])
            p, _ = self.marginals(np.concatenate([h[3] for h in held]), first)
        else:
            p = np.zeros((begin[-1], 0))
        for (lo, hi, w, _, familiar), b in zip(held, begin):
            own, text = p[b : b + len(w.start)], w.text_of()
            size = np.maximum(np.diff(w.first), 1)
            mean = np.zeros((hi - lo, k))
            for c in range(k):
                mean[:, c] = np.bincount(text, weights=own[:, c], minlength=hi - lo) / size
            yield lo, hi, mean, own, w, familiar


def has_letter(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter (of any script)."""
    ascii_letter = ((buf | 32) >= 97) & ((buf | 32) <= 122) & (buf < 128)
    out = np.diff(np.r_[0, np.cumsum(ascii_letter)][offsets]) > 0
    for i in np.flatnonzero(~out & (np.diff(np.r_[0, np.cumsum(buf >= 128)][offsets]) > 0)):
        out[i] = any(map(str.isalpha, buf[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    return out


def _least_levels(counts: list, wanted: int) -> dict[str, int]:
    """The level of each language from which rows are drawn: enough for `wanted`, all if it has fewer."""
    by: dict[str, dict[int, int]] = {}
    for value, level, n in counts:
        by.setdefault(value, {})[level] = n
    out = {}
    for value, levels in by.items():
        got = 0
        for level in sorted(levels, reverse=True):
            got += levels[level]
            out[value] = level
            if got >= wanted:
                break
    return out


def passages_of(raw: bytes, size: int) -> list[bytes]:
    """A whole text in passages of at most `size` bytes, cut behind a space if there is one, else between symbols."""
    out, at = [], 0
    while len(raw) - at > size:
        end = raw.rfind(b" ", at, at + size) + 1
        if end <= at:
            end = at + size
            while end > at + 1 and raw[end] & 0xC0 == 0x80:
                end -= 1
        out.append(raw[at:end])
        at = end
    return [*out, raw[at:]]


def _passages(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                texts = passages_of(batch.column(2)[i].cast(pa.binary()).as_buffer().to_pybytes(), size)
                for lo in range(0, len(texts), AT_ONCE):
                    some, nth = texts[lo : lo + AT_ONCE], np.arange(lo, min(lo + AT_ONCE, len(texts)))
                    same = [pa.array([batch.column(k)[i].as_py()] * len(some), batch.column(k).type) for k in (0, 1)]
                    yield pa.record_batch([*same, pa.array(nth, pa.int64()), pa.array(some, pa.binary()).cast(pa.string())], names=["l", "draw", "nth", "t"])

    return run


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = TRAIN_PER_LANGUAGE) -> Crf:
    """A model of every non-null language value that has a text, from at most per_language rows of each.

    Whole texts of any length take part, in passages.  Equal rows teach once.
    """
    code = F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col(text), F.lit(8))
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("l"), code.alias("draw"), F.col(doc_id).cast("string").alias("id"), F.col(text).alias("t"),
    ).withColumn("level", F.expr("64 - if(draw = 0, 0, length(bin(draw)))"))
    # one row in two has at least level 1, one in four level 2, and so on
    counts = [tuple(r) for r in rows.groupBy("l", "level").count().collect()]
    languages = sorted({r[0] for r in counts})
    wanted = min(per_language, max(LEAST_ROWS, TRAIN_ROWS // max(len(languages), 1)))
    alike: dict[int, list[str]] = {}
    for value, level in _least_levels(counts, wanted).items():
        alike.setdefault(level, []).append(value)
    chosen = F.lit(False)
    for level, values in sorted(alike.items()):
        chosen = chosen | ((F.col("level") >= level) & F.col("l").isin(values))
    first = Window.partitionBy("l").orderBy("draw", "id", "t")
    drawn = rows.where(chosen).select("l", "draw", "id", "t").distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= wanted)
    parts = cut(map_batches(drawn.select("l", "draw", "t"), _passages(PASSAGE), "l string, draw long, nth long, t string"))
    taken = {r["l"]: (r["rows"], r["n"]) for r in parts.groupBy("l").agg(F.sum(F.when(F.col("nth") == 0, 1)).alias("rows"), F.count(F.lit(1)).alias("n")).collect()}
    number = max(1, -(-sum(n for _, n in taken.values()) // AT_ONCE))
    order = [F.xxhash64("draw", "nth", "l"), F.col("l"), F.col("nth")]
    placed = cut(parts.repartitionByRange(number, *order).sortWithinPartitions(*order).select("l", "t"))
    at = {value: i for i, value in enumerate(languages)}
    model = Crf(languages)
    if languages:
        model.learn(lambda: ((r["t"], at[r["l"]]) for r in placed.toLocalIterator()), np.array([taken[value][0] for value in languages]))
    return model


def _predict(model, text_at: int, kept: list[int], names: list[str]):
    """Kept columns of each batch, then language, score and familiarity of its text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = model.value
        for batch in batches:
            column = batch.column(text_at)
            letter = has_letter(*byte_view(column))
            for lo, hi, mean, _, _, familiar in crf.label(column):
                n = hi - lo
                if crf.languages:
                    best, ok = mean.argmax(axis=1), letter[lo:hi]
                    found = [crf.languages[b] if o else "und" for b, o in zip(best, ok)]
                    score = np.where(ok, np.clip(mean.max(axis=1), 0.0, 1.0), 0.0)
                else:
                    found, score = ["und"] * n, np.zeros(n)
                part = [batch.column(i).slice(lo, n) for i in kept]
                yield pa.record_batch([*part, pa.array(found, pa.string()), pa.array(score), pa.array(familiar)], names=names)

    return run


def annotate(docs: DataFrame, model: Crf, text: str = "text", lang_name: str = "lang_pred", score_name: str = "lang_score", known_name: str = "lang_known", drop_text: bool = False) -> DataFrame:
    """docs with three more columns: the language, its score (see identify) and the
    share of the text's trigrams that training has seen often enough.

    Existing columns of these names are replaced.  Rows stay where they are:
    no shuffle, and no column needs to identify a row.
    """
    rows = docs.drop(lang_name, score_name, known_name)
    at = rows.columns.index(text)
    kept = [i for i in range(len(rows.columns)) if not (drop_text and i == at)]
    schema = T.StructType([
        *(rows.schema.fields[i] for i in kept), T.StructField(lang_name, T.StringType()), T.StructField(score_name, T.DoubleType()),
        T.StructField(known_name, T.DoubleType()),
    ])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.transform(map_batches, _predict(shared, at, kept, schema.names), schema)


def identify(docs: DataFrame, model: Crf, held_out: Column | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row.

    A null text, or one without a letter, is `und` with score 0; a text's score
    is the mean probability of its language over its words.  Very long texts
    are read whole.  Repeated rows stay, other columns are ignored, an empty
    table gives an empty table, and a model without languages says `und`.
    """
    held = F.lit(None).cast("boolean") if held_out is None else held_out
    rows = docs.select(F.col(doc_id).alias("doc_id"), held.alias("held_out"), F.col(text).alias("text"))
    return annotate(rows, model, "text", "lang_pred", "score", "known", drop_text=True).drop("known")


def _label_words(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = model.value
        for batch in batches:
            for lo, hi, _, p, w, _ in crf.label(batch.column(1)):
                base = w.offsets[:-1][w.text_of()]
                inner = pa.array([crf.languages[b] for b in p.argmax(axis=1)] if crf.languages else ["und"] * len(p), pa.string())
                cut = pa.array(w.first.astype(np.int32))
                yield pa.record_batch(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.ListArray.from_arrays(cut, pa.array((w.start - base).astype(np.int32))),
                        pa.ListArray.from_arrays(cut, pa.array((w.end - base).astype(np.int32))),
                        pa.ListArray.from_arrays(cut, inner),
                    ],
                    names=["doc_id", "word_start", "word_end", "word_lang"],
                )

    return run


def label_words(docs: DataFrame, model: Crf, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each text's words as byte spans with a language each, for code-switched text.

    A null or empty text has no words; repeated rows stay, other columns are
    ignored, an empty table gives an empty table, and a model without languages
    labels all words `und`.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.transform(map_batches, _label_words(shared), f"doc_id {kind}, word_start array<int>, word_end array<int>, word_lang array<string>")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = split_code() % 4 == 2
    return identify(docs, fit(docs.where(~held_out)), held_out)
