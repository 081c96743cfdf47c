"""Packing documents into sequences by cutting-stock column generation.

A document's token ids (its text's, then END) are cut into pieces of CONTEXT
ids and a rest.  Pieces are counted by length class (UNIT ids wide, so at most
CONTEXT / UNIT classes whatever the corpus holds).  The linear program over
cutting patterns starts from one pattern per class; an unbounded-knapsack
dynamic program prices new patterns until none saves more than GAP.  Patterns
rounded down are repeated, what is left is filled largest first.  Pieces are
ranked within their class, and a rank determines the sequence: no task sees
more than its own pieces, and the driver sees class counts and patterns only.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textcore import Words, byte_view, cut, give_back, map_batches, same_spans, slices

CONTEXT = 4096
UNIT = 8
END = 2
GAP = 5e-4
#: Distinct words whose ids a worker keeps in each of two generations, and their bytes together;
#: words that wait to be sorted into a generation.
CACHE, CACHE_BYTES, RECENT = 3 << 17, 12 << 20, 1 << 16
#: Bytes of text whose ids are made together; words that are tokenized in one call.
PIECE_BYTES, CALL_WORDS = 1 << 19, 1 << 13
#: Rows (partition and class) up to which the ranks before each partition are sent to all tasks.
BROADCAST_ROWS = 200_000
#: New words that are tokenized as one text, with a special token between them.
JOINED = 256
#: Plain words have code points below PLAIN (alone under NFC, whatever stands beside them) and at most PLAIN_BYTES bytes;
#: their runs go to the model PLAIN_CALL bytes at a time, PLAIN_JOINED as one text.
PLAIN, PLAIN_BYTES, PLAIN_CALL, PLAIN_JOINED = 0x300, 1 << 12, 1 << 17, 64
#: What a tokenizer does before its model, if plain words can do without it.
_NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Known:
    """Words, sorted by hash, with their bytes and their ids."""

    def __init__(self, code, size, begin, count, at, raw, ids):
        order = np.argsort(code, kind="stable")  # sorted parts are merged, not sorted again
        self.code, self.size, self.begin = code[order], size[order], begin[order]
        self.count, self.at, self.ids = count[order], at[order], ids
        self.raw = Words(raw, np.array([0, len(raw)]))

    @classmethod
    def none(cls) -> _Known:
        nothing = np.zeros(0, np.int64)
        return cls(np.zeros(0, np.uint64), nothing, nothing, nothing, nothing, np.zeros(0, np.uint8), np.zeros(0, np.uint32))

    def with_more(self, o: _Known) -> _Known:
        """Both together; the bytes and ids of o stand after those of self."""
        begin, at = o.begin + len(self.raw.buf), o.at + len(self.ids)
        parts = (self.code, o.code), (self.size, o.size), (self.begin, begin), (self.count, o.count), (self.at, at), (self.raw.buf, o.raw.buf), (self.ids, o.ids)
        return _Known(*(np.concatenate(c) for c in parts))

    def find(self, w: Words, words: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The place of each word of w, -1 for a word that isn't known."""
        if not len(self.code):
            return np.full(len(words), -1, dtype=np.int64)
        spot = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        size = w.end[words] - w.start[words]
        hit = np.flatnonzero((self.code[spot] == code) & (self.size[spot] == size))
        alike = same_spans(w, w.start[words[hit]], self.raw, self.begin[spot[hit]], size[hit])
        out = np.full(len(words), -1, dtype=np.int64)
        out[hit[alike]] = spot[hit[alike]]
        return out


class _Plain:
    """Ids of plain words from the tokenizer's model alone.

    Normalizing and splitting take most of the time of a call.  For code points
    below PLAIN without apostrophes they are a table: each is lower-cased on
    its own, letters and other signs make runs, a digit is a run.  The table is
    asked of the tokenizer's own steps; the model gets runs between spaces, and
    its end-of-word suffix tells where a run's ids end.
    """

    SPACE, LETTER, OTHER, DIGIT = 1, 2, 3, 4

    def __init__(self, tokenizer):
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer(tokenizer.model)  # the same model, not a copy
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab, suffix = tokenizer.get_vocab(), tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        # every added token has its greatest character, so no plain word holds one
        barred = {"'"} | {max(t.content) for t in tokenizer.get_added_tokens_decoder().values()}
        self.kind = np.zeros(PLAIN + 1, dtype=np.uint8)  # 0: not plain
        self.signs = np.zeros((PLAIN + 1, 2), dtype=np.uint32)
        self.kind[32], self.signs[32, 0] = self.SPACE, 32
        split = tokenizer.pre_tokenizer.pre_tokenize_str
        for c in range(PLAIN):
            low = tokenizer.normalizer.normalize_str(chr(c))
            signs = "".join(x for x, _ in split(low))
            if chr(c) in barred or low.isspace() or len(low) != 1 or not 0 < len(signs) < 3 or not all(x in vocab and x + suffix in vocab for x in signs):
                continue
            self.kind[c] = self.LETTER if len(split("a" + low)) == 1 else self.OTHER if len(split("!" + low)) == 1 else self.DIGIT
            self.signs[c, : len(signs)] = [ord(x) for x in signs]

    @classmethod
    def of(cls, tokenizer) -> _Plain | None:
        """None for a tokenizer whose steps are others."""
        normal, split, model = tokenizer.normalizer, tokenizer.pre_tokenizer, tokenizer.model
        if not (normal and split and json.loads(normal.__getstate__()) == _NORMAL and json.loads(split.__getstate__()) == _SPLIT):
            return None
        if type(model).__name__ != "BPE" or not model.end_of_word_suffix or model.dropout or tokenizer.truncation or tokenizer.padding:
            return None
        if tokenizer.post_processor or any(t.normalized for t in tokenizer.get_added_tokens_decoder().values()):
            return None
        return cls(tokenizer)

    def tokenized(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether each word is plain, number of ids of each that is, their ids)."""
        short = end - start <= PLAIN_BYTES
        a, size = start[short], (end - start)[short] + 1
        upto = np.r_[0, np.cumsum(size)]
        parts = [self._part(buf, a[lo:hi], size[lo:hi]) for lo, hi in slices(upto, PLAIN_CALL)]
        plain, count, ids = (np.concatenate(x) for x in zip((np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.uint32)), *parts))
        short[short] = plain
        return short, count, ids

    def _part(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        upto = np.cumsum(size)
        raw = buf[np.minimum(np.repeat(start - upto + size, size) + np.arange(upto[-1]), len(buf) - 1)]
        raw[upto - 1] = 32
        point = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype="<u4")
        after = np.flatnonzero(point == 32) + 1
        point = np.minimum(point, PLAIN)
        kind = self.kind[point]
        plain = np.add.reduceat(kind == 0, np.r_[0, after[:-1]], dtype=np.int64) == 0
        if not plain.all():
            kept = np.repeat(plain, np.diff(after, prepend=0))
            point, kind = point[kept], kind[kept]
        if not len(point):
            return plain, np.zeros(0, np.int64), np.zeros(0, np.uint32)
        cut_after = np.zeros(len(kind), dtype=bool)
        cut_after[:-1] = ((kind[:-1] != kind[1:]) | (kind[:-1] == self.DIGIT)) & (kind[:-1] != self.SPACE) & (kind[1:] != self.SPACE)
        signs = np.empty((len(point), 3), dtype="<u4")
        signs[:, :2], signs[:, 2] = self.signs[point], cut_after * np.uint32(32)
        signs = signs[signs != 0]
        text = signs.tobytes().decode("utf-32-le")
        at = [0, *(np.flatnonzero(signs == 32)[PLAIN_JOINED - 1 :: PLAIN_JOINED] + 1).tolist(), len(text)]
        found = self.model.encode_batch_fast([text[i:j] for i, j in zip(at, at[1:])], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in found])
        ends = np.flatnonzero(self.ends[ids]) + 1
        space = kind == self.SPACE
        run = np.cumsum(cut_after | space)
        if len(ends) != run[-1] or ends[-1] != len(ids):
            raise ValueError("the tokenizer's model does not end words by its suffix")
        return plain, np.diff(ends[run[space] - 1], prepend=0), ids


class WordTokenizer:
    """Ids of whole texts, each distinct white-space word tokenized once.

    The tokenizer drops white space and never joins over it, so a text's ids
    are those of its words in turn.  Known words are kept in two generations:
    a full one becomes the old one, from which words still in use come back.
    """

    loaded: dict[str, WordTokenizer] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; more threads take more memory
        self.tokenizer = Tokenizer.from_file(path)
        special = {k: t.content for k, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word)}
        self.mark = min(special, default=None)
        self.between = special.get(self.mark, "")
        self.plain = _Plain.of(self.tokenizer)
        give_back()  # what reading the file and the vocabulary took
        self.kept = [_Known.none()] * 3  # recent words, the present generation, the one before

    @classmethod
    def get(cls, path: str) -> WordTokenizer:
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return size, np.fromiter((i for f in found for i in f), dtype=np.uint32, count=int(size.sum()))

    def _tokenized(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, ids)."""
        if self.plain is None:
            return self._by_mark(buf.tobytes(), start, end)
        plain, some, ids = self.plain.tokenized(buf, start, end)
        if plain.all():
            return some, ids
        others, more = self._by_mark(buf.tobytes(), start[~plain], end[~plain])
        count, at = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        count[plain], count[~plain] = some, others
        at[plain], at[~plain] = np.cumsum(some) - some, np.cumsum(others) - others + len(ids)
        return count, _gathered([ids, more], at, count)

    def _by_mark(self, raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, ids): many words at once, cut where the special token stands again."""
        words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start.tolist(), end.tolist())]
        if not self.between or any(self.between in x for x in words):
            return self._each(words)
        found = []
        for lo in range(0, len(words), CALL_WORDS):
            some = words[lo : lo + CALL_WORDS]
            joined = [self.between.join(some[i : i + JOINED]) + self.between for i in range(0, len(some), JOINED)]
            found += [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate(found)
        ends = np.flatnonzero(ids == self.mark)
        if len(ends) != len(words):
            raise ValueError("the tokenizer does not keep its special token apart")
        return np.diff(np.r_[-1, ends]) - 1, ids[ids != self.mark]

    def _keep(self, new: _Known) -> None:
        recent, main, old = self.kept
        recent = recent.with_more(new)
        if len(recent.code) > RECENT or len(recent.raw.buf) > CACHE_BYTES:
            main, recent = main.with_more(recent), _Known.none()
        if len(main.code) > CACHE or len(main.raw.buf) > CACHE_BYTES:
            main, old = _Known.none(), main
        self.kept = [recent, main, old]

    def encode(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with END after each, first id of each text plus the end).

        Hashes only find words; their bytes are compared wherever a hash brings
        two of them together, and unlike words of one hash are kept apart.
        """
        code = w.code
        order = np.argsort(code)
        ranged = code[order]
        first = np.r_[True, ranged[1:] != ranged[:-1]][: len(code)]
        distinct, example, inverse = ranged[first], order[first], np.empty(len(code), np.int64)
        inverse[order] = np.cumsum(first) - 1
        unlike = np.flatnonzero(~w.same(np.arange(len(inverse)), example[inverse]))
        inverse[unlike] = len(example) + np.arange(len(unlike))
        example, distinct = np.r_[example, unlike], np.r_[distinct, code[unlike]]
        n = len(example)
        at, size, pools, upto = np.zeros(n, np.int64), np.zeros(n, np.int64), [], 0
        left = np.arange(n)
        for known in self.kept:
            place = known.find(w, example[left], distinct[left])
            hit = place >= 0
            at[left[hit]], size[left[hit]] = known.at[place[hit]] + upto, known.count[place[hit]]
            pools.append(known.ids)
            upto += len(known.ids)
            left = left[~hit]
        if len(left):
            start, end = w.start[example[left]], w.end[example[left]]
            count, ids = self._tokenized(w.buf, start, end)
            at[left], size[left] = upto + np.r_[0, np.cumsum(count)][:-1], count
            pools.append(ids)
            once = np.flatnonzero(left < n - len(unlike))  # of the words of one hash the first is kept
            length = end - start
            if len(once) == len(left):
                begin = np.r_[0, np.cumsum(length)][:-1]
                spread = np.repeat(start - begin, length) + np.arange(length.sum())
                self._keep(_Known(distinct[left], length, begin, count, np.r_[0, np.cumsum(count)][:-1], w.buf[spread], ids))
        # the ids of this slice's words, in the order of `example`
        ids = _gathered(pools, at, size)
        at = np.r_[0, np.cumsum(size)][:-1][inverse]
        size = size[inverse]
        # one more id after each text's last word
        n_texts = len(w.offsets) - 1
        upto = np.r_[0, np.cumsum(size)]
        first = upto[w.first] + np.arange(n_texts + 1)
        out = np.full(first[-1], END, dtype=np.uint32)
        begin = upto[:-1] + w.text_of()
        source = np.repeat(at - upto[:-1], size) + np.arange(upto[-1])
        target = np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])
        out[target] = ids[source]
        return out, first


def _gathered(pools: list[np.ndarray], at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ids at at .. at + size of the pools, which stand one after the other."""
    out = np.zeros(int(size.sum()), dtype=np.uint32)
    upto, low = np.r_[0, np.cumsum(size)][:-1], 0
    for pool in pools:
        own = np.flatnonzero((at >= low) & (at < low + len(pool)) & (size > 0))
        n = size[own]
        step = np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)][:-1], n)
        out[np.repeat(upto[own], n) + step] = pool[np.repeat(at[own] - low, n) + step]
        low += len(pool)
    return out


def _pieces(path: str, context: int, unit: int, with_ids: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "cls"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.get(path)
        for batch in batches:
            buf, offsets = byte_view(batch.column(1))
            for lo, hi in slices(offsets, PIECE_BYTES):
                w = Words(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                ids, first = tokenizer.encode(w)
                n = np.diff(first)
                count = -(-n // context)
                row = np.repeat(np.arange(len(n)), count)
                nth = np.arange(count.sum()) - np.repeat(np.r_[0, np.cumsum(count)][:-1], count)
                start = nth * context
                length = np.minimum(n[row] - start, context)
                a = first[row] + start
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[i : i + m]) for i, m in zip(a.tolist(), length.tolist())]
                columns = [
                    batch.column(0).slice(lo, hi - lo).take(pa.array(row)),
                    pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[row]),
                    pa.array((-(-length // unit)).astype(np.int32)),
                ]
                if with_ids:
                    cuts = np.r_[a, first[-1]].astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(raw.astype(np.int32))))
                yield pa.record_batch(columns, names=names)

    return run


def knapsack(price: np.ndarray, capacity: int) -> np.ndarray:
    """Counts by class (index = width) of the dearest pattern within capacity."""
    value = np.zeros(capacity + 1)
    choice = np.zeros(capacity + 1, dtype=np.int64)
    for width in range(1, capacity + 1):
        gain = price[1 : width + 1] + value[width - 1 :: -1][:width]
        best = int(gain.argmax())
        if gain[best] > value[width - 1]:
            value[width], choice[width] = gain[best], best + 1
        else:
            value[width] = value[width - 1]
    pattern = np.zeros(len(price), dtype=np.int64)
    width = capacity
    while width > 0:
        if choice[width]:
            pattern[choice[width]] += 1
            width -= choice[width]
        else:
            width -= 1
    return pattern


def solve(counts: np.ndarray, capacity: int, gap: float = GAP, max_rounds: int = 6000) -> list[tuple[np.ndarray, float]]:
    """(pattern, times) of the linear relaxation by column generation.

    counts[width] is the demand; widths are 1..capacity.  The basis inverse is
    updated by one pivot a round; rounds end within `gap` of the dual bound.
    """
    widths = np.flatnonzero(counts)
    m = len(widths)
    if not m:
        return []
    fill = capacity // widths
    columns = [np.where(np.arange(m) == i, fill[i], 0) for i in range(m)]
    inverse = np.diag(1.0 / fill)
    x = counts[widths] / fill
    basis = [np.asarray(c) for c in columns]
    for _ in range(max_rounds):
        dual = inverse.sum(axis=0)
        price = np.zeros(capacity + 1)
        price[widths] = dual
        pattern = knapsack(price, capacity)[widths]
        worth = float(dual @ pattern)
        if worth <= 1 + gap:
            break
        direction = inverse @ pattern
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(direction > 1e-9, x / direction, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        step = ratio[out]
        x = np.maximum(x - step * direction, 0)
        x[out] = step
        row = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, row)
        inverse[out] = row
        basis[out] = pattern
    out_patterns = []
    for pattern, times in zip(basis, x):
        full = np.zeros(capacity + 1, dtype=np.int64)
        full[widths] = pattern
        out_patterns.append((full, float(times)))
    return out_patterns


def plan(counts: np.ndarray, capacity: int, gap: float = GAP) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) in whole numbers that cover all counts."""
    left = counts.astype(np.int64).copy()
    chosen: list[tuple[np.ndarray, int]] = []

    def take(pattern: np.ndarray, times: int) -> None:
        chosen.append((pattern, times))
        np.subtract(left, pattern * times, out=left)

    for pattern, times in sorted(solve(counts, capacity, gap), key=lambda p: -p[1]):
        used = pattern > 0
        whole = min(int(np.floor(times + 1e-9)), int((left[used] // pattern[used]).min()) if used.any() else 0)
        if whole > 0:
            take(pattern, whole)
    while left.any():
        pattern, room = np.zeros_like(left), capacity
        for width in range(capacity, 0, -1):
            if left[width] and width <= room:
                pattern[width] = min(left[width], room // width)
                room -= pattern[width] * width
        used = pattern > 0
        take(pattern, max(1, int((left[used] // pattern[used]).min())))
    return chosen


def _tables(chosen: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, ...]:
    """Rows (class, first rank, items per sequence, first sequence), sorted."""
    rows, sequence, upto = [], 0, {}
    for pattern, times in chosen:
        for width in np.flatnonzero(pattern).tolist():
            first = upto.get(width, 0)
            rows.append((width, first, int(pattern[width]), sequence))
            upto[width] = first + int(pattern[width]) * times
        sequence += times
    rows.sort()
    return tuple(np.array(c, dtype=np.int64) for c in zip(*rows)) if rows else tuple(np.zeros(0, np.int64) for _ in range(4))


def _ranked(capacity: int):
    """Adds each piece's partition and its rank within partition and class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upto = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            cls = batch.column("cls").to_numpy().astype(np.int64)
            order = np.argsort(cls, kind="stable")
            group = cls[order]
            at = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
            size = np.diff(np.r_[at, len(group)])
            rank = np.empty(len(cls), dtype=np.int64)
            rank[order] = np.arange(len(cls)) - np.repeat(at, size) + upto[group]
            upto[group[at]] += size
            yield pa.record_batch([*batch.columns, pa.array(rank)], names=[*batch.schema.names, "nth"])

    return run


def _placed(tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, first, items, sequence = tables.value
        wide = np.int64(1) << 48
        key = width * wide + first
        for batch in batches:
            cls = batch.column("cls").to_numpy().astype(np.int64)
            rank = batch.column("rank").to_numpy()
            spot = np.searchsorted(key, cls * wide + rank, side="right") - 1
            place = sequence[spot] + (rank - first[spot]) // items[spot]
            yield pa.record_batch([*batch.columns, pa.array(place)], names=[*batch.schema.names, "sequence_id"])

    return run


def pack_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, context: int = CONTEXT, unit: int = UNIT, with_ids: bool = False) -> DataFrame:
    """Pieces of all rows of docs with their place in the packed sequences.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    and, with_ids, ids.  A null or empty text is the single id END.  Repeated
    rows are packed once each; other columns are ignored; an empty table gives
    an empty table.  A sequence's pieces stand without gaps from offset 0 and
    hold at most `context` ids together.
    """
    if context % unit:
        raise ValueError("context must be a multiple of unit")
    capacity = context // unit
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, cls int" + ", ids array<int>" * with_ids
    pieces = cut(rows.transform(map_batches, _pieces(tokenizer or default_tokenizer(), context, unit, with_ids), schema))
    parts = cut(pieces.groupBy(F.spark_partition_id().alias("part"), "cls").agg(F.count(F.lit(1)).alias("n")))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for c, n in parts.groupBy("cls").agg(F.sum("n")).collect():  # at most `capacity` rows
        counts[c] = n
    tables = docs.sparkSession.sparkContext.broadcast(_tables(plan(counts, capacity)))
    before = Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", "cls", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    if parts.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    ranked = pieces.transform(map_batches, _ranked(capacity), f"{schema}, nth long").withColumn("part", F.spark_partition_id())
    ranked = ranked.join(offsets, ["part", "cls"]).withColumn("rank", F.col("nth") + F.col("before")).drop("part", "nth", "before")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields)
    placed = ranked.transform(map_batches, _placed(tables), f"{fields}, sequence_id long")
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("cls"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids
    )


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
