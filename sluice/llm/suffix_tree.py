"""Language-model scores: add-0.1 unigrams over all words and a probabilistic suffix tree.

The tree predicts a text symbol by symbol (UTF-8 bytes of the lower-cased
words, one space between words, an end symbol).  Its contexts are the symbol
strings of up to DEPTH symbols seen at least MIN_COUNT times, so they grow with
the corpus, and of these the ones that pass a divergence test against the next
shorter context (with their suffixes; contexts of up to CORE symbols all stay).
Next-symbol distributions are smoothed towards the shorter context's.

Contexts longer than CORE are built by tasks, group by group of the last GROUP
symbols, and stay a distributed table of one row a group.  The groups used most,
PART_ENTRIES probabilities at most, are broadcast, and most positions are scored
by them in one pass over the texts, each from its nearest symbol to older ones
through bitmaps of children, without sorting.  Strings of other groups, once for each text,
meet their groups in tasks and then their texts in a join by string, so the work
does not grow with the number of parts that a large tree would have.

Word counts cover the whole corpus and are never collected: words with a share
of at least 1 / HEAD of all training tokens (at most HEAD of them) are sent to
the tasks, the others meet their counts in a join by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textcore import Words, cut, map_batches, mix, runs, split_code, spread_join, word_slices

#: Longest context, and the most that a 64-bit key holds with the next symbol.
DEPTH, MOST_DEPTH = 6, 6
#: Times that a context must have been seen, whatever the size of the corpus.
MIN_COUNT = 4
#: Contexts up to CORE symbols go with every part; groups are named by GROUP symbols.
CORE, GROUP = 2, 3
#: Probabilities that are broadcast (about 10 bytes each in a task, more where texts have above 128 different bytes).
PART_ENTRIES = 1 << 22
HEAD = 1 << 19
#: Weight of the shorter context's distribution, in observations for each different next symbol.
PRIOR = 1.0
#: Distinct keys that a task counts before it hands them on.
HELD = 1 << 21
#: A symbol is a byte of UTF-8, but 0 is the end; the byte 0 is told as 0xFF, which UTF-8 doesn't know.
BITS = 8
SYMBOL = np.arange(256, dtype=np.uint8)
SYMBOL[0] = 255
#: Positions that are scored at once, so that what is made for them stays in a processor's cache.
AT_ONCE = 1 << 16
#: Places (as a power of 2) in which a task keeps probabilities that it has looked up, 16 bytes each.
MEMO_BITS = 20
END_WORD = np.int64(-0x6A09E667F3BCC909)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def symbol_stream(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, first position of each text plus the end).

    A text is its words with one space between them and the end symbol 0.
    """
    change = np.zeros(len(w.buf) + 1, dtype=np.int8)
    change[w.start] += 1
    change[w.end] -= 1
    keep = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
    last = np.zeros(len(w.start), dtype=bool)
    last[w.first[1:][w.first[1:] > w.first[:-1]] - 1] = True
    gap = w.end[~last]
    buf = w.buf
    if len(gap):
        buf = buf.copy()
        buf[gap] = 32
        keep[gap] = True
    upto = np.r_[0, np.cumsum(keep)][w.offsets]
    return np.insert(SYMBOL[buf[keep]], upto[1:], 0), upto + np.arange(len(upto))


def grams(symbols: np.ndarray, first: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Each position's symbol with the `depth` before it, packed: the symbol in the
    lowest bits, older symbols above; before a text stands the end symbol."""
    n = len(symbols)
    # read backwards, the 8 bytes from each symbol on are a number of this form
    back = np.zeros(n + 8, dtype=np.uint8)
    back[:n] = symbols[::-1]
    out = np.ndarray((n,), dtype="<i8", buffer=back.data, strides=(1,))[::-1] & ((1 << (BITS * (depth + 1))) - 1)
    size = np.diff(first)
    for k in range(depth):
        out[first[:-1][size > k] + k] &= (1 << (BITS * (k + 1))) - 1
    return out


class _Counter:
    """Counts of 64-bit keys, kept as sorted arrays of bounded size."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        if len(keys):
            self.parts.append(np.unique(keys, return_counts=True))
            self.size += len(self.parts[-1][0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([p[0] for p in self.parts]) if self.parts else np.zeros(0, np.int64)
        counts = np.concatenate([p[1] for p in self.parts]) if self.parts else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        return keys[at], np.add.reduceat(counts, at) if len(at) else counts

    def full(self) -> bool:
        """Whether more than HELD distinct keys are held; merges when that many have come in."""
        if self.size > 2 * HELD and len(self.parts) > 1:
            self.parts = [self.merged()]
            self.size = len(self.parts[0][0])
            return self.size > HELD
        return self.size > 2 * HELD

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.merged()
        self.parts, self.size = [], 0
        return out


def _word_codes(w: Words) -> np.ndarray:
    return w.code.view(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["kind", "key", "n"]
    held = (_Counter(), _Counter())

    def rows(kind: int) -> pa.RecordBatch:
        keys, counts = held[kind].take()
        return pa.record_batch([pa.array(np.full(len(keys), kind, dtype=np.int32)), pa.array(keys), pa.array(counts)], names=names)

    for batch in batches:
        for _, _, w in word_slices(batch.column(0), lower=True):
            symbols, first = symbol_stream(w)
            held[0].add(np.r_[_word_codes(w), np.full(len(first) - 1, END_WORD)])
            held[1].add(grams(symbols, first))
            for kind in (0, 1):
                if held[kind].full():
                    yield rows(kind)
    for kind in (0, 1):
        yield rows(kind)


def corpus_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, key, n): counts of words (kind 0) and of symbol strings (kind 1) over all rows."""
    return docs.select(F.col(text).alias("text")).transform(map_batches, _count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _turned(keys: np.ndarray, depth: int) -> np.ndarray:
    """Contexts of packed strings, the nearest symbol in the highest of depth * BITS bits."""
    out = np.zeros(len(keys), dtype=np.int64)
    for k in range(1, depth + 1):
        out |= ((keys >> (BITS * k)) & ((1 << BITS) - 1)) << (BITS * (depth - k))
    return out


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(n, at) if len(at) else n


class Level:
    """Contexts of one depth: entries (context << BITS | symbol, probability), sorted,
    and of each context its first entry, total and whether it stays."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, shorter: tuple[np.ndarray, np.ndarray], min_count: int):
        keys, n = _summed(keys, n)
        name = keys >> BITS
        first = np.flatnonzero(np.r_[True, name[1:] != name[:-1]]) if len(name) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(keys)])
        total = np.add.reduceat(n, first) if len(first) else n
        often = total >= min_count
        keep = np.repeat(often, size)
        self.keys, n, self.total, self.size = keys[keep], n[keep], total[often], size[often]
        self.first = np.r_[0, np.cumsum(self.size)][:-1].astype(np.int64)
        self.name = self.keys[self.first] >> BITS
        # a context seen often enough has all its suffixes, with the same next symbols
        base = shorter[1][np.searchsorted(shorter[0], ((self.keys >> (2 * BITS)) << BITS) | (self.keys & ((1 << BITS) - 1)))] if len(self.keys) else np.zeros(0)
        all_of, weight = np.repeat(self.total, self.size), np.repeat(PRIOR * self.size, self.size)
        self.p = (n + weight * base) / (all_of + weight)
        gain = np.add.reduceat(n * np.log(n / all_of / base), self.first) if len(self.first) else np.zeros(0)
        self.stays = gain >= 0.5 * self.size * np.log(np.maximum(self.total, 2))


def _state(name: np.ndarray, d: int, depth: int) -> np.ndarray:
    """A context's name: its symbols, the nearest highest, and its depth."""
    return (name << (BITS * (depth - d) + 4)) | d


class Part:
    """States (sorted names, log10 weight of the shorter one) and their entries
    (state number << BITS | symbol, log10 probability)."""

    def __init__(self, states: np.ndarray, back: np.ndarray, sizes: np.ndarray, symbols: np.ndarray, logp: np.ndarray, depth: int):
        order = np.argsort(states, kind="stable")
        self.depth, self.states, self.back = depth, states[order], back[order]
        number = np.empty(len(states), dtype=np.int64)
        number[order] = np.arange(len(states))
        entries = (np.repeat(number, sizes) << BITS) | symbols
        by = np.argsort(entries, kind="stable")
        self.entries, self.logp = entries[by], logp[by]
        self.deepest = int((self.states & 15).max())

    def walk(self, turned: np.ndarray, symbol: np.ndarray, left: np.ndarray, out: np.ndarray, top: int, bottom: int) -> np.ndarray:
        """Adds to `out` what contexts of top down to bottom symbols tell; the numbers still without a probability."""
        sought = np.zeros(len(out), dtype=bool)
        for d in range(min(top, self.deepest), bottom - 1, -1):
            if not len(left):
                break
            name = _state(turned[left] >> (BITS * (self.depth - d)), d, self.depth)
            at = np.minimum(np.searchsorted(self.states, name), len(self.states) - 1)
            is_state = self.states[at] == name
            at, on = at[is_state], left[is_state]
            entry = (at << BITS) | symbol[on]
            spot = np.minimum(np.searchsorted(self.entries, entry), len(self.entries) - 1)
            seen = self.entries[spot] == entry
            out[on] += np.where(seen, self.logp[spot], self.back[at])
            sought[on[seen]] = True
            left = left[~sought[left]]
        return left

    def logs(self, keys: np.ndarray, longer: Part | None = None) -> np.ndarray:
        """log10 probability of the last symbol of each packed string; `longer` has the contexts above CORE symbols."""
        out = np.zeros(len(keys))
        turned = _turned(keys, self.depth)
        order = np.argsort(turned, kind="stable")
        turned, symbol = turned[order], keys[order] & ((1 << BITS) - 1)
        left = np.arange(len(keys))
        if longer is not None:
            left = longer.walk(turned, symbol, left, out, self.depth, GROUP)
        self.walk(turned, symbol, left, out, self.depth if longer is None else CORE, 0)
        result = np.empty(len(keys))
        result[order] = out
        return result


class Memo:
    """What a trie told of strings met before, the last one for each place."""

    def __init__(self) -> None:
        self.key, self.value = np.full(1 << MEMO_BITS, -1, dtype=np.int64), np.zeros(1 << MEMO_BITS)

    def logs(self, trie: Trie, keys: np.ndarray, whole: bool) -> np.ndarray:
        out = np.empty(len(keys))
        for lo in range(0, len(keys), AT_ONCE):
            some = keys[lo : lo + AT_ONCE]
            place = ((some.view(np.uint64) * _SPREAD) >> np.uint64(64 - MEMO_BITS)).view(np.int64)
            p, new = self.value.take(place), np.flatnonzero(self.key.take(place) != some)
            if len(new):
                place, some = place.take(new), some.take(new)
                p[new] = found = trie.logs(some, whole)
                self.key[place], self.value[place] = some, found
            out[lo : lo + AT_ONCE] = p
        return out


class Trie:
    """The states of a part (each with all its suffixes), numbered by depth and then by name.

    A state's children are those with one older symbol.  Children and entries
    stand one after the other in the order of their symbols; for each state
    `wide` words of 64 bits tell which symbols there are, and the number of the
    first one of each word.  So a position goes from state to state, and to its
    probability, by looking up and counting bits.
    """

    def __init__(self, part: Part):
        depth, self.deepest = part.depth, part.deepest
        by = np.argsort(part.states & 15, kind="stable")
        of, name = (part.states & 15)[by], part.states[by] >> 4
        start = np.searchsorted(of, np.arange(depth + 2))
        self.pairs = int(start[CORE])
        edge = ((name >> (BITS * (depth - of))) & ((1 << BITS) - 1)).astype(np.uint8)
        self.back, self.parent = part.back[by].astype(np.float64), np.zeros(len(of), dtype=np.int32)
        for d in range(1, depth + 1):
            here, above = slice(start[d], start[d + 1]), slice(start[d - 1], start[d])
            self.parent[here] = start[d - 1] + np.searchsorted(name[above], name[here] >> (BITS * (depth - d + 1)) << (BITS * (depth - d + 1)))
        self.near = np.zeros((1 << BITS, 1 << BITS), dtype=np.int32)
        one, two = np.arange(start[1], start[2]), np.arange(start[2], start[3])
        self.near[edge[one]] = one[:, None]
        self.near[edge[self.parent[two]], edge[two]] = two
        self.near = self.near.ravel()

        number = np.empty(len(by), dtype=np.int32)
        number[by] = np.arange(len(by), dtype=np.int32)
        node = number[part.entries >> BITS]
        order = np.argsort(node, kind="stable")
        node, symbol, self.logp = node[order], (part.entries & ((1 << BITS) - 1)).astype(np.uint8)[order], part.logp[order]
        at = int(np.searchsorted(node, 1))
        self.root, node, symbol, self.logp = self.logp[:at].copy(), node[at:], symbol[at:], self.logp[at:].copy()

        known = np.union1d(symbol, edge[1:]).astype(np.int64)
        rank = np.arange(len(known), dtype=np.uint64)
        self.wide = max(1, -(-len(known) // 64))
        self.word, self.bit, self.below = np.zeros(1 << BITS, dtype=np.int64), np.zeros(1 << BITS, dtype=np.uint64), np.zeros(1 << BITS, dtype=np.uint64)
        self.word[known] = rank // np.uint64(64)
        self.bit[known] = np.uint64(1) << rank % np.uint64(64)
        self.below[known] = self.bit[known] - np.uint64(1)
        self.entries = self._table(node, symbol, len(of), 0)
        deep = int(start[CORE + 1])
        self.children = self._table(self.parent[deep:] - self.pairs, edge[deep:], int(start[depth]) - self.pairs, deep)

    def _table(self, row: np.ndarray, symbol: np.ndarray, rows: int, number: int) -> tuple[np.ndarray, np.ndarray]:
        """(symbols that there are, number of the first) of each word, from rows and symbols in order."""
        spot = row * np.int64(self.wide) + self.word[symbol]
        at = np.flatnonzero(np.r_[True, spot[1:] != spot[:-1]]) if len(spot) else np.zeros(0, np.int64)
        has, first = np.zeros(rows * self.wide, dtype=np.uint64), np.zeros(rows * self.wide, dtype=np.int32)
        if len(at):
            has[spot[at]] = np.bitwise_or.reduceat(self.bit[symbol], at)
            first[spot[at]] = at + number
        return has, first

    def _find(self, table: tuple[np.ndarray, np.ndarray], row: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether the row has the symbol, its number if so)."""
        symbol = symbol.astype(np.int64)
        spot = row * self.wide + self.word.take(symbol)
        has = table[0].take(spot)
        return (has & self.bit.take(symbol)) != 0, table[1].take(spot) + np.bitwise_count(has & self.below.take(symbol))

    def logs(self, keys: np.ndarray, whole: bool = True) -> np.ndarray:
        """log10 probability of the last symbol of each packed string; where the tree isn't whole, NaN
        for strings of groups that aren't here."""
        older = [(keys >> (BITS * k)) & ((1 << BITS) - 1) for k in range(max(self.deepest, CORE) + 1)]
        node = self.near.take(older[1] << BITS | older[2]).astype(np.int64)
        live = np.flatnonzero(node >= self.pairs)
        out = np.full(len(keys), 0.0 if whole else np.nan)
        for d in range(GROUP, self.deepest + 1):
            has, child = self._find(self.children, node.take(live) - self.pairs, older[d].take(live))
            live = live[has]
            node[live] = child[has]
            if d == GROUP:
                out[live] = 0.0
        left = np.arange(len(keys)) if whole else np.flatnonzero(out == 0)
        while len(left):
            at = node.take(left)
            ends = at == 0
            if ends.any():
                last, left, at = left[ends], left[~ends], at[~ends]
                out[last] += self.root.take(older[0].take(last))
            has, spot = self._find(self.entries, at, older[0].take(left))
            out[left[has]] += self.logp.take(spot[has])
            left, at = left[~has], at[~has]
            out[left] += self.back.take(at)
            node[left] = self.parent.take(at)
        return out

    def score(self, symbols: np.ndarray, first: np.ndarray, depth: int, whole: bool, memo: Memo) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(each text's sum of log10 probabilities, first of its further strings plus the end, these
        strings, times of each): strings of groups that aren't here are left over if the tree isn't whole."""
        n = len(first) - 1
        if n < 1:
            return np.zeros(0), np.zeros(1, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)
        keys = grams(symbols, first, depth)
        p = memo.logs(self, keys, whole)
        rest = np.flatnonzero(np.isnan(p))
        p[rest] = 0.0
        keys, at = np.unique(keys[rest], return_inverse=True)
        text = np.searchsorted(first, rest, side="right") - 1
        wide = np.int64(max(1, len(keys)))
        pair, times = np.unique(text * wide + at, return_counts=True)
        cuts = np.searchsorted(pair, np.arange(n + 1) * wide)
        return np.add.reduceat(p, first[:-1]), cuts.astype(np.int32), keys[pair % wide], times.astype(np.int32)


def _rows_of(levels: list[tuple[int, Level, np.ndarray]], depth: int) -> tuple[np.ndarray, ...]:
    """(states, back, sizes, symbols, logp) of the contexts of some levels that a mask picks."""
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    for d, level, mask in levels:
        inside = np.repeat(mask, level.size)
        for held, x in zip(out, (
            _state(level.name[mask], d, depth), -np.log10(1 + level.total[mask] / (PRIOR * level.size[mask])), level.size[mask],
            level.keys[inside] & ((1 << BITS) - 1), np.log10(level.p[inside]),
        )):
            held.append(x)
    kinds = (np.int64, np.float32, np.int32, np.uint8, np.float32)
    return tuple(np.concatenate([np.zeros(0), *x]).astype(k) if k != np.int64 else np.concatenate([np.zeros(0, np.int64), *x]) for x, k in zip(out, kinds))


def _grow(core, depth: int, min_count: int):
    """Strings sorted by group to one row of states a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shorter_core = core.value
        for table in runs(batches, ["g"]):
            of = table.column("g").to_numpy()
            edges = np.r_[np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), len(of)]
            keys, n = table.column("key").to_numpy(), table.column("n").to_numpy()
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                turned, symbol, shorter = _turned(keys[lo:hi], depth), keys[lo:hi] & ((1 << BITS) - 1), shorter_core
                levels: list[tuple[int, Level]] = []
                for d in range(GROUP, depth + 1):
                    level = Level(((turned >> (BITS * (depth - d))) << BITS) | symbol, n[lo:hi], shorter, min_count)
                    if not len(level.name):
                        break
                    levels.append((d, level))
                    shorter = level.keys, level.p
                for (_, level), (_, longer) in zip(levels[-2::-1], levels[:0:-1]):
                    level.stays |= np.isin(level.name, longer.name[longer.stays] >> BITS)
                found = _rows_of([(d, level, level.stays) for d, level in levels], depth)
                if len(found[0]):
                    row = [pa.array([int(of[lo])], pa.int64()), pa.array([len(found[3])], pa.int64()), pa.array([int(n[lo:hi].sum())], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in found)]
                    yield pa.record_batch(row, names=["g", "n", "w", *KINDS])

    return run


#: Binary columns of a group's row.
KINDS = {"states": np.int64, "back": np.float32, "sizes": np.int32, "symbols": np.uint8, "logp": np.float32}


class Forest:
    """The whole tree: its core here, its groups in a distributed table, and which of them are broadcast."""

    def __init__(self, core: tuple[np.ndarray, ...], groups: DataFrame, depth: int):
        self.core, self.groups, self.depth = core, groups, depth
        sizes = groups.select("g", "n", "w").toPandas().sort_values(["w", "g"], ascending=[False, True])
        taken = int((sizes["n"].cumsum() <= PART_ENTRIES).sum())
        self.whole = taken == len(sizes)
        self.head = np.sort(sizes["g"].to_numpy(dtype=np.int64)[:taken])
        self.least = (int(sizes["w"].iloc[taken - 1]), int(sizes["g"].iloc[taken - 1])) if taken else None

    def part(self) -> Part:
        """The core with the groups that are broadcast."""
        rows = None
        if self.least is not None:
            w, g = self.least
            rows = self.groups.where((F.col("w") > w) | ((F.col("w") == w) & (F.col("g") <= g))).select(*KINDS).toPandas()
        return Part(*(
            np.concatenate([mine, np.frombuffer(b"".join(rows[c]), dtype=k)]) if rows is not None else mine
            for mine, (c, k) in zip(self.core, KINDS.items())
        ), depth=self.depth)

    def resolved(self, keys: DataFrame) -> DataFrame:
        """(key, logp) of a table of different packed strings: each meets its group's row in a task."""
        core = self.groups.sparkSession.sparkContext.broadcast(Part(*self.core, depth=self.depth))
        group = F.expr(f"(key >> {BITS}) & {(1 << (BITS * GROUP)) - 1}").alias("g")
        none = [F.lit(None).cast("binary").alias(c) for c in KINDS]
        both = self.groups.select("g", F.lit(None).cast("long").alias("key"), *KINDS).union(keys.select(group, "key", *none))
        dealt = both.repartition("g").sortWithinPartitions("g", F.col("key").asc_nulls_first())
        return dealt.transform(map_batches, _resolve(core, self.depth), "key long, logp double")


def _resolve(core, depth: int):
    """Rows sorted by group, a group's own row first, to (key, logp); one group is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, longer = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            of, is_key = batch.column(0).to_numpy(), batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            keys = batch.column(1).fill_null(0).to_numpy()
            logp = np.zeros(len(keys))
            edges = np.r_[np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), len(of)]
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if of[lo] != group:
                    group, longer = of[lo], None
                if not is_key[lo]:
                    longer = Part(*(np.frombuffer(batch.column(c)[lo].as_buffer(), dtype=k) for c, k in KINDS.items()), depth=depth)
                    lo += 1
                logp[lo:hi] = core.value.logs(keys[lo:hi], longer)
            yield pa.record_batch([pa.array(keys[is_key]), pa.array(logp[is_key])], names=["key", "logp"])

    return run


def learn_tree(counts: DataFrame, depth: int = DEPTH, min_count: int = MIN_COUNT) -> Forest:
    """The tree of the symbol-string counts.

    Only strings of CORE + 1 symbols, the sizes of the groups, both bounded by
    the alphabet, and the groups that are broadcast reach the driver.
    """
    if not GROUP <= depth <= MOST_DEPTH:
        raise ValueError(f"contexts have {GROUP} to {MOST_DEPTH} symbols")
    found = counts.where("kind = 1")
    short = found.groupBy(F.expr(f"key & {(1 << (BITS * (CORE + 1))) - 1}").alias("key")).agg(F.sum("n").alias("n")).toPandas()
    keys, n = short["key"].to_numpy(dtype=np.int64), short["n"].to_numpy(dtype=np.int64)
    symbol, wide = keys & ((1 << BITS) - 1), 1 << BITS
    root = np.bincount(symbol, weights=n, minlength=wide) + 0.5
    root /= root.sum()
    turned, shorter = _turned(keys, CORE), (np.arange(wide), root)
    levels = []
    for d in range(1, CORE + 1):
        level = Level(((turned >> (BITS * (CORE - d))) << BITS) | symbol, n, shorter, min_count)
        levels.append((d, level, np.ones(len(level.name), dtype=bool)))
        shorter = level.keys, level.p
    own = _rows_of(levels, depth)
    first = (np.zeros(1, np.int64), np.zeros(1, np.float32), np.full(1, wide, np.int32), np.arange(wide, dtype=np.uint8), np.log10(root).astype(np.float32))
    core = tuple(np.concatenate([a, b]) for a, b in zip(first, own))
    shared = counts.sparkSession.sparkContext.broadcast(shorter)
    group = F.expr(f"(key >> {BITS}) & {(1 << (BITS * GROUP)) - 1}").alias("g")
    dealt = found.select(group, "key", "n").repartition("g").sortWithinPartitions("g")
    schema = "g long, n long, w long, states binary, back binary, sizes binary, symbols binary, logp binary"
    return Forest(core, cut(dealt.transform(map_batches, _grow(shared, depth, min_count), schema)), depth)


def _score(tree, depth: int, whole: bool, head, floor: float):
    """(doc_id, held_out, text) to scores, and the words and strings that the broadcast tables don't hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, (known, value, end_value), memo = tree.value, head.value, Memo()
        for batch in batches:
            for lo, hi, w in word_slices(batch.column(2), lower=True):
                n = hi - lo
                score, more, strings, string_times = model.score(*symbol_stream(w), depth, whole, memo)
                code, text_of = _word_codes(w), w.text_of()
                spot = np.searchsorted(known, code)
                spot[spot == len(known)] = 0
                hit = known[spot] == code if len(known) else np.zeros(len(code), dtype=bool)
                base = np.bincount(text_of[hit], weights=value[spot[hit]], minlength=n) + end_value
                n_known = np.bincount(text_of[hit], minlength=n)
                order = np.lexsort((code[~hit], text_of[~hit]))
                rest, rest_of = code[~hit][order], text_of[~hit][order]
                at = np.flatnonzero(np.r_[True, (rest[1:] != rest[:-1]) | (rest_of[1:] != rest_of[:-1])]) if len(rest) else np.zeros(0, np.int64)
                offsets = np.searchsorted(rest_of[at], np.arange(n + 1)).astype(np.int32)
                times = np.diff(np.r_[at, len(rest)]).astype(np.int32)
                name = text_names(w)
                yield pa.record_batch(
                    [
                        batch.column(0).slice(lo, n), batch.column(1).slice(lo, n),
                        pa.array(np.diff(w.first) + 1), pa.array(n_known), pa.array(base), pa.array(score), pa.array(name),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(rest[at])),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(times)),
                        pa.ListArray.from_arrays(pa.array(more), pa.array(strings)), pa.ListArray.from_arrays(pa.array(more), pa.array(string_times)),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "name", "words", "times", "strings", "string_times"],
                )

    return run


def text_names(w: Words) -> np.ndarray:
    """A 64-bit name of each text's lower-cased bytes."""
    return mix(w.span_code(w.offsets[:-1], w.offsets[1:]) + np.diff(w.offsets).astype(np.uint64)).view(np.int64)


def lm_scores(docs: DataFrame, held_out: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Models learn from the rows where held_out is false.  Tokens are the
    white-space words (A-Z lower-cased) and one end; a null or empty text has
    only the end.  base_score sums log10((c + 0.1) / (N + 0.1 * (V + 1))) over
    tokens; score is the tree's log10 probability of the text.  Equal texts
    have equal values; repeated rows stay; other columns are ignored; without
    training rows N and V are 0 and the tree is uniform.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))
    counts = cut(corpus_counts(rows.where(~F.col("held_out"))))
    words = counts.where("kind = 0").select(F.col("key").alias("word"), F.col("n").alias("c"))
    n_all, n_distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).head()
    floor = n_all + 0.1 * (n_distinct + 1)
    frequent = words.where(F.col("c") * HEAD >= n_all).where(F.col("c") > 0).toPandas()
    order = np.argsort(frequent["word"].to_numpy(dtype=np.int64), kind="stable")
    known, c = frequent["word"].to_numpy(dtype=np.int64)[order], frequent["c"].to_numpy(dtype=np.float64)[order]
    ends = words.where(F.col("word") == int(END_WORD)).agg(F.coalesce(F.sum("c"), F.lit(0))).head()[0]
    context = docs.sparkSession.sparkContext
    tree = learn_tree(counts)
    part = context.broadcast(Trie(tree.part()))
    head = context.broadcast((known, np.log10((c + 0.1) / floor), float(np.log10((ends + 0.1) / floor))))
    scored = cut(rows.transform(
        map_batches, _score(part, tree.depth, tree.whole, head, floor),
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, name long, words array<long>, times array<int>,"
        " strings array<long>, string_times array<int>",
    ))
    copies = scored.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    tail = scored.select("name", F.explode(F.arrays_zip("words", "times")).alias("w")).select("name", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    sums = tail.join(words, "word", "left").groupBy("name").agg(
        F.sum(F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + 0.1) / floor)).alias("base"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("seen"), F.lit(0.0).alias("tree"),
    )
    if not tree.whole:
        strings = scored.select("name", F.explode(F.arrays_zip("strings", "string_times")).alias("s")).select("name", F.col("s.strings").alias("key"), F.col("s.string_times").alias("times"))
        found = cut(tree.resolved(strings.select("key").distinct()))
        more = strings.join(found, "key").groupBy("name").agg(F.sum(F.col("times") * F.col("logp")).alias("tree"))
        sums = sums.unionByName(more.select("name", F.lit(0.0).alias("base"), F.lit(0).cast("long").alias("seen"), "tree")).groupBy("name").agg(
            *(F.sum(x).alias(x) for x in ("base", "seen", "tree"))
        )
    # a text's rare words and strings come once for each of its copies, hence the division
    tails = sums.join(copies, "name").select(
        "name", (F.col("base") / F.col("n")).alias("base"), F.expr("cast(round(seen / n) as bigint)").alias("seen"), (F.col("tree") / F.col("n")).alias("tree")
    )
    plain = scored.drop("words", "times", "strings", "string_times")
    return spread_join(plain, tails, "name", copies).select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("seen", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("tree", F.lit(0.0))).alias("score"),
    )


def op6_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return lm_scores(docs, split_code() % 10 == 0)
