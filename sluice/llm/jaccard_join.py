"""N-gram Jaccard join by parity sketches, exact at any group size.

Each text becomes a set of hashed word shingles.  Texts with equal sets share
one class, named by a hash of the set, and all later work is on classes.

1.  Size bands.  Band j holds the set sizes from EDGE * RATIO**(j-1) up to
    EDGE * RATIO**j.  A pair is looked for in the band of its larger set, so a
    set joins its own band and, if a partner may be larger than the band, the
    next one too.
2.  Parity sketch.  In a band every shingle toggles bits: XOR of shingle
    hashes by block.  Two sets with symmetric difference D differ in at most D
    of the k blocks and in at most D bits of a one-bit-per-shingle sketch.
3.  Pigeonhole.  With D <= d and e empty blocks at least k - d - e non-empty
    blocks agree; therefore, in any order that depends on a block's content
    only, the first d + 1 non-empty blocks of both sets have one in common.
    The order puts keys that many sets have last, so that a common line brings
    no sets together that have enough else, and then the fullest blocks first,
    as those are the most selective.  How common a key is was counted in drawn
    texts; whatever was drawn, no link is lost, as all sets use one order.
    A set with too few non-empty blocks (tiny sets) adds a key by a second
    hash, and at last one for its band.
4.  Join.  Rows (block key, class) are dealt by key and sorted.  In small
    buckets all pairs are compared by size and by the Hamming distance of their
    sketches; what passes is a candidate link.
5.  Contract.  Classes of large buckets first meet in chunks of a few of their
    buckets, where exact intersections decide.  That joins the near copies,
    which fill such buckets, to components with work in proportion to their
    number.  Then the members of each large bucket that are in different
    components are compared by sketch, chunk against chunk: a bucket of one
    component is done, and the chunks of its largest component only meet the
    members outside it.  Of each pair of chunks a spanning forest of candidate
    links leaves.
6.  Verify.  Candidate links make coarse groups.  The shingles of the classes
    of a group that is not yet one component meet in the same way, in chunks of
    bounded size; exact intersections decide, and a spanning forest of true
    links leaves.  Every pair of a group is compared unless it is connected.

No bucket or group is capped, sampled or dropped, and no step holds more than
two chunks of a group in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .textcore import cut, map_batches, mix, runs, spread_join, sweep, windows, word_slices

EDGE, RATIO = 8, 4
#: Buckets up to this size are compared at once, larger ones by chunks.
SMALL_BUCKET = 24
#: Members of a chunk of a large bucket; bytes of shingles in a chunk of a group.
CHUNK_ROWS, CHUNK_BYTES = 2048, 4 << 20
#: Large buckets in which a class is linked first; members from which a component is set apart in dealing.
FIRST_BUCKETS, APART = 2, 256
#: Of the texts one in so many is drawn to count keys, though so many texts at least; a key is common that
#: so many drawn sets have, and at most so many keys, the most frequent ones, count as common.
DRAWN_ONE_IN, DRAWN_LEAST, COMMON, COMMON_KEYS = 32, 4096, 4, 1 << 17
#: Low bits of a block key that tell its band.
BAND_BITS = 5
#: Bytes of a shingle hash; classes that a task remembers to skip copies of.
HASH_BYTES, REMEMBERED = 8, 1 << 20


def band_of(n: int) -> int:
    j, top = 0, EDGE
    while n >= top:
        j, top = j + 1, top * RATIO
    return j


def band_top(j: int) -> int:
    """Largest set size of band j."""
    return EDGE * RATIO**j - 1


class Rule:
    """Similarity of at least num / den, in whole numbers."""

    def __init__(self, similarity: float):
        f = Fraction(str(similarity))
        if not 0 < f <= 1:
            raise ValueError("similarity must be above 0 and at most 1")
        self.num, self.den = f.numerator, f.denominator

    def largest_partner(self, n: int) -> int:
        return n * self.den // self.num

    def differences(self, a: int, b: int) -> int:
        """Largest symmetric difference of linked sets of sizes a and b."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def linked(self, common: int, a: int, b: int) -> bool:
        return self.den * common >= self.num * (a + b - common)


def distinct(x: np.ndarray) -> np.ndarray:
    """np.unique by sorting, which takes a fraction of the time of its hash table."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text that has a word."""
    for lo, _, words in word_slices(column, lower=True):
        code, first = words.code, words.first
        grams, begin = windows(code, first, size)
        for i in range(len(first) - 1):
            n = first[i + 1] - first[i]
            if n >= size:
                yield lo + i, distinct(grams[begin[i] : begin[i + 1]])
            elif n:
                whole, _ = windows(code[first[i] : first[i + 1]], np.array([0, n]), int(n))
                yield lo + i, mix(whole + np.uint64(n))


def set_code(s: np.ndarray) -> int:
    """Signed 64-bit name of a shingle set."""
    tied = np.bitwise_xor.reduce(mix(s ^ np.uint64(0x51ED270B7F6A3C19)), keepdims=True)
    total = s.sum(dtype=np.uint64, keepdims=True) * np.uint64(0x9E3779B97F4A7C15)
    return int(mix(tied + total + np.uint64(len(s))).view(np.int64)[0])


def bit_sketch(s: np.ndarray) -> bytes:
    """One-bit-per-shingle parity sketch; its width follows the set's band."""
    bits = band_top(band_of(len(s))) + 1
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def fold(sketch: np.ndarray, width: int) -> np.ndarray:
    """The same parity sketch at a smaller width (rows of bytes)."""
    while sketch.shape[-1] > width:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def _level(key: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How common each key is; 0 for those not in the sorted keys of `common`."""
    keys, level = common
    if not len(keys):
        return np.zeros(len(key), dtype=np.uint8)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return np.where(keys[at] == key, level[at], 0)


def _place(key: np.ndarray, load: np.ndarray, common: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Places of blocks in the one order, in a number each: rare before common, then full, then by key."""
    place = key >> np.uint64(13) | (63 - np.minimum(load, 63)).astype(np.uint64) << np.uint64(51)
    return place if common is None else place | _level(key, common).astype(np.uint64) << np.uint64(57)


def block_keys(s: np.ndarray, rule: Rule, common: tuple[np.ndarray, np.ndarray] | None = None, whole: bool = False) -> np.ndarray:
    """Bucket keys of one set: for each band it joins, its first d + 1 blocks (whole: all of them).

    `common` has keys, sorted as unsigned numbers, and how common each is.
    """
    n = len(s)
    own, most = band_of(n), rule.largest_partner(n)
    if most <= n and rule.differences(n, n) == 0 and rule.differences(n, most) == 0:
        return np.zeros(0, dtype=np.int64)  # only equal sets can link, and those share a class
    out: list[np.ndarray] = []
    for band in range(own, band_of(most) + 1):
        top = band_top(band)
        d = rule.differences(n, min(most, top))
        k = 2 * rule.differences(top, top) + 6
        named = lambda key, band=band: (key >> np.uint64(BAND_BITS)) << np.uint64(BAND_BITS) | np.uint64(band)
        for salt in (0, 1):
            h = s if salt == 0 else np.sort(mix(s ^ np.uint64(0xA0761D6478BD642F)))
            block = ((h >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)  # rises with h
            edge = np.flatnonzero(block[1:] != block[:-1]) + 1
            at = np.concatenate(([0], edge))
            value = np.bitwise_xor.reduceat(mix(h), at)
            key = named(mix(value ^ mix(block[at] + np.uint64((band * 4 + salt + 1) << 40))))
            enough = k - d - (k - len(at)) >= 1
            take = d + 1 if enough and not whole else len(at)
            if take < len(at):
                load = np.concatenate((edge, [n])) - at
                place = _place(key, load, common)
                key = key[place <= np.partition(place, take - 1)[take - 1]]  # all that share the last place
            out.append(key)
            if enough:
                break
        else:
            out.append(named(mix(np.array([band + 0x7F000000], dtype=np.uint64))))
    return distinct(np.concatenate(out)).view(np.int64)


def _classes(similarity: float, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            names, sizes, sketches = [None] * n, [0] * n, [None] * n
            for row, s in shingle_sets(batch.column(2), size):
                names[row], sizes[row], sketches[row] = set_code(s), len(s), bit_sketch(s)
            yield pa.record_batch(
                [*batch.columns[:2], pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())],
                names=["doc_id", "text_code", "class_id", "n_shingles", "sketch"],
            )

    return run


def _keys(similarity: float, size: int, common: tuple[np.ndarray, np.ndarray] | None = None, whole: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule, seen = Rule(similarity), set()
        for batch in batches:
            keys, names = [], []
            for _, s in shingle_sets(batch.column(0), size):
                name = set_code(s)
                if name not in seen:  # a copy in this task has the same rows
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(name)
                    found = block_keys(s, rule, common, whole)
                    keys.append(found)
                    names.append(np.full(len(found), name, dtype=np.int64))
            if keys:
                yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(np.concatenate(names))], names=["key", "class_id"])

    return run


_BUCKET = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])


def _pairs(key: np.ndarray, name: np.ndarray) -> pa.RecordBatch | None:
    """All pairs within each bucket of sorted small buckets, once each."""
    left, right = [], []
    for step in range(1, SMALL_BUCKET):
        i = np.flatnonzero(key[step:] == key[:-step]) if len(key) > step else np.zeros(0, np.int64)
        if not len(i):
            break
        left.append(name[i])
        right.append(name[i + step])
    if not left:
        return None
    a, b = np.concatenate(left), np.concatenate(right)
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    once = np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])]
    return pa.record_batch([pa.array(low[once]), pa.array(high[once]), pa.nulls(int(once.sum()), pa.int64())], schema=_BUCKET)


def _members(key: np.ndarray, name: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(name), pa.nulls(len(name), pa.int64()), pa.array(key)], schema=_BUCKET)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, class) rows to pairs of small buckets and rows of large ones.

    A pair row has b set; a row of a large bucket has b null and a bucket key.
    Between batches at most SMALL_BUCKET rows are kept, however large a bucket.
    """
    held_key = held_name = np.zeros(0, dtype=np.int64)
    passing: int | None = None  # the large bucket that the last batch ended in
    for batch in batches:
        key = np.concatenate([held_key, batch.column(0).to_numpy()])
        name = np.concatenate([held_name, batch.column(1).to_numpy()])
        if not len(key):
            continue
        if passing is not None:
            n = int(np.searchsorted(key, passing, side="right"))
            if n:
                yield _members(key[:n], name[:n])
                key, name = key[n:], name[n:]
            if not len(key):
                held_key, held_name = key, name
                continue
            passing = None
        new = np.r_[True, (key[1:] != key[:-1]) | (name[1:] != name[:-1])]
        key, name = key[new], name[new]
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.diff(np.r_[at, len(key)])
        each = np.repeat(count, count)
        end = int(at[-1])  # the last bucket may go on in the next batch
        big = each > SMALL_BUCKET
        if big.any():
            yield _members(key[big], name[big])
        small = ~big
        small[end:] = False
        pairs = _pairs(key[small], name[small])
        if pairs is not None:
            yield pairs
        if big[-1]:
            passing = int(key[-1])
            held_key, held_name = key[:0], name[:0]
        else:
            held_key, held_name = key[end:], name[end:]
    pairs = _pairs(held_key, held_name)
    if pairs is not None:
        yield pairs


_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bit distances between rows of bytes."""
    x = np.ascontiguousarray(a ^ b)
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64) if hasattr(np, "bitwise_count") else _ONES[x].sum(axis=-1, dtype=np.int64)


def _sketch_rows(sketches: pa.Array, rows: np.ndarray, width: int) -> np.ndarray:
    """The sketches of some rows, all of one size, folded to `width` bytes."""
    off = np.frombuffer(sketches.buffers()[1], dtype=np.int32)[sketches.offset :][: len(sketches) + 1]
    data, at = np.frombuffer(sketches.buffers()[2], dtype=np.uint8), off[rows].astype(np.int64)
    return fold(data[at[:, None] + np.arange(int(off[rows[0] + 1] - at[0]))], width)


def _pair_filter(similarity: float):
    """Candidate pairs whose sizes and sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = Rule(similarity)
        for batch in batches:
            na, nb = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            low, high = np.minimum(na, nb), np.maximum(na, nb)
            keep = low * rule.den >= high * rule.num
            limit = (na + nb) * (rule.den - rule.num) // (rule.den + rule.num)
            wide = [pa.compute.binary_length(batch.column(i)).to_numpy(zero_copy_only=False).astype(np.int64) for i in (4, 5)]
            left = np.flatnonzero(keep)
            shape = wide[0][left] * (1 << 32) + wide[1][left]
            for s in np.unique(shape):  # pairs of sketches of the same two widths
                rows = left[shape == s]
                width = int(min(s >> 32, s & 0xFFFFFFFF))
                for lo in range(0, len(rows), max(1, CHUNK_BYTES // width)):
                    some = rows[lo : lo + max(1, CHUNK_BYTES // width)]
                    keep[some] = hamming(*(_sketch_rows(batch.column(i), some, width) for i in (4, 5))) <= limit[some]
            yield pa.record_batch([c.filter(pa.array(keep)) for c in (batch.column(0), batch.column(1))], names=["a", "b"])

    return run


class Forest:
    """Union-find over the members of one chunk pair."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def spanning(n: int, near, check=None, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph on 0..n-1.

    near(i, others) tells which of `others` may link with i; check(i, j)
    decides (None: near decides).  Each i is held against all others outside
    its present tree, so that no connection is missed.  Members with one value
    in `known` are connected to begin with.
    """
    forest, links = Forest(n), []
    if known is not None:
        _, first, group = np.unique(known, return_index=True, return_inverse=True)
        forest.up = [int(min(i, first[g])) for i, g in enumerate(group)]
    tree = np.array(forest.up)  # the root of each member, kept in step with the forest
    for i in range(n):
        others = np.flatnonzero(tree[i + 1 :] != tree[i]) + i + 1
        if not len(others):
            continue
        changed = False
        for j in others[near(i, others)]:
            j = int(j)
            if forest.root(i) != forest.root(j) and (check is None or check(i, j)):
                forest.join(i, j)
                links.append((i, j))
                changed = True
        if changed:
            roots: dict[int, int] = {}
            tree = np.array([roots.setdefault(int(t), forest.root(int(t))) for t in tree])
    return links


def _sketch_near(rule: Rule, size: np.ndarray, sketch: list[np.ndarray]):
    """near() by size and Hamming distance; sketches are folded to one width."""
    width = min(map(len, sketch))
    flat = np.stack([fold(s, width) for s in sketch])

    def near(i: int, others: np.ndarray) -> np.ndarray:
        low, high = np.minimum(size[i], size[others]), np.maximum(size[i], size[others])
        ok = low * rule.den >= high * rule.num
        limit = (size[i] + size[others]) * (rule.den - rule.num) // (rule.den + rule.num)
        found = np.flatnonzero(ok)
        ok[found] = hamming(flat[others[found]], flat[i]) <= limit[found]
        return ok

    return near


def _chunks(similarity: float, exact: bool):
    """Rows of (group, chunk pair), sorted, to the links of a spanning forest.

    Members with equal `comp` are connected already.  With exact, `shingles` holds the members' shingles and intersections
    decide; else the sketches do.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = Rule(similarity)
        for table in runs(batches, ["grp", "i", "j"]):
            grp, ci, cj = (table.column(k).to_numpy() for k in ("grp", "i", "j"))
            name, size, comp = (table.column(k).to_numpy() for k in ("class_id", "n_shingles", "comp"))
            bits = table.column("sketch").combine_chunks()
            data = table.column("shingles").combine_chunks() if exact else None
            new = np.r_[True, (grp[1:] != grp[:-1]) | (ci[1:] != ci[:-1]) | (cj[1:] != cj[:-1])]
            edge = np.r_[np.flatnonzero(new), len(grp)]
            a, b = [], []
            for lo, hi in zip(edge[:-1], edge[1:]):
                _, row = np.unique(name[lo:hi], return_index=True)
                row += lo
                if len(row) < 2 or (comp[row] == comp[row[0]]).all():
                    continue
                near = _sketch_near(rule, size[row], [np.frombuffer(bits[int(r)].as_py(), np.uint8) for r in row])
                check = None
                if exact:
                    def of(i: int, row=row) -> np.ndarray:
                        return np.frombuffer(data[int(row[i])].as_buffer(), dtype="<u8")

                    def check(i: int, j: int, of=of, row=row) -> bool:
                        x, y = of(i), of(j)
                        both = np.sort(np.concatenate((x, y)), kind="stable")
                        return rule.linked(int((both[1:] == both[:-1]).sum()), int(size[row[i]]), int(size[row[j]]))

                for i, j in spanning(len(row), near, check, comp[row]):
                    a.append(int(name[row[i]]))
                    b.append(int(name[row[j]]))
            if a:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return run


def _payload(size: int, names: list[str]):
    """Rows with a class and a text to rows with the class's shingles in the text's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("class_id").to_numpy()
            rows, data = [], []
            for row, s in shingle_sets(batch.column("text"), size):
                if set_code(s) == wanted[row]:
                    rows.append(row)
                    data.append(s.astype("<u8").tobytes())
            kept = batch.select(names).take(pa.array(rows, pa.int64()))
            yield pa.record_batch([*kept.columns, pa.array(data, pa.binary())], names=[*names, "shingles"])

    return run


def _pieces(rows: str, shingles: str | None) -> str:
    """SQL for the chunks of so many rows with so many shingles together."""
    by_rows = f"ceil({rows} / {CHUNK_ROWS})"
    return f"cast(greatest({by_rows}, ceil({shingles} * {HASH_BYTES} / {CHUNK_BYTES})) as bigint)" if shingles else f"cast({by_rows} as bigint)"


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")


def _loads(rows: DataFrame, by_bytes: bool) -> DataFrame:
    """(grp, n, main, pm, po) of the groups with more than one component: the largest component if it
    is to be set apart (else null), its number of chunks and that of the others."""
    comps = rows.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"))
    loads = comps.groupBy("grp").agg(
        F.max(F.struct("n", "w", "comp")).alias("top"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("comps")
    ).where("comps > 1").withColumn("apart", F.col("top.n") >= APART)
    w = lambda of, other: f"if(apart, {of}, {other})" if by_bytes else None
    return loads.select(
        "grp", "n", F.expr("if(apart, top.comp, null)").alias("main"),
        F.expr(_pieces("if(apart, top.n, 0)", w("top.w", "0"))).alias("pm"), F.expr(_pieces("if(apart, n - top.n, n)", w("w - top.w", "w"))).alias("po"),
    )


def _loaded(rows: DataFrame, by_bytes: bool) -> DataFrame:
    """The rows of groups with more than one component, each with its group's load."""
    loads = cut(_loads(rows, by_bytes))
    return spread_join(rows, loads.drop("n"), "grp", loads.select("grp", "n")).where("po IS NOT NULL")


def _deal(rows: DataFrame) -> DataFrame:
    """Each row, with its group's load, to all chunk pairs that its chunk takes part in, dealt and sorted.

    Chunks of the main component have negative numbers and meet those of the
    others; those of the others meet each other as well.
    """
    upto = lambda n: f"if({n} > 0, sequence(cast(0 as bigint), {n} - 1), cast(array() as array<bigint>))"
    ours = F.expr("main IS NOT NULL AND comp = main")
    mine = F.pmod(F.xxhash64("class_id"), F.when(ours, F.col("pm")).otherwise(F.col("po")))
    pairs = F.when(ours, F.expr(f"transform({upto('po')}, x -> named_struct('i', -mine - 1, 'j', x))")).otherwise(F.expr(
        f"concat(transform({upto('pm')}, x -> named_struct('i', -x - 1, 'j', mine)),"
        f" transform({upto('po')}, x -> named_struct('i', least(x, mine), 'j', greatest(x, mine))))"
    ))
    return _dealt(rows.withColumn("mine", mine).withColumn("pair", F.explode(pairs)).select(
        *(c for c in rows.columns if c not in ("main", "pm", "po")), "pair.i", "pair.j"
    ))


def shingle_classes(docs: DataFrame, size: int = 5, similarity: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text_code, class_id, n_shingles, sketch); class_id null where a text has no word."""
    out = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, text_code long, class_id long, n_shingles long, sketch binary"
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_code"), F.col(text).alias("text"))
    return rows.transform(map_batches, _classes(similarity, size), out)


def with_texts(docs: DataFrame, group: DataFrame, text: str, doc_id: str) -> DataFrame:
    """group, with a text for each row: that of a document of its class.

    A class is found by the smallest id of its rows, or, if none of them has
    one, by the hash of a text of theirs.
    """
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    nameless = texts.where("doc_id IS NULL").groupBy(F.xxhash64("text").alias("text_code")).agg(F.first("text").alias("text"))
    named = group.where("doc_id IS NOT NULL").drop("text_code").join(texts, "doc_id").drop("doc_id")
    return named.unionByName(group.where("doc_id IS NULL").drop("doc_id").join(nameless, "text_code").drop("text_code"))


def common_keys(docs: DataFrame, rows: int, size: int, similarity: float, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(keys, levels) of the block keys that many sets have, counted in drawn texts of the about `rows` ones.

    A level is the number of the count's binary digits.
    """
    one_in = max(1, min(DRAWN_ONE_IN, rows // DRAWN_LEAST))
    drawn = docs.select(F.col(text).alias("text")).where(F.pmod(F.xxhash64(F.col("text"), F.lit(one_in)), F.lit(one_in)) == 0)
    keys = drawn.transform(map_batches, _keys(similarity, size, whole=True), "key long, class_id long").distinct()
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(COMMON, SMALL_BUCKET // one_in))
    found = counts.orderBy(F.desc("n"), "key").limit(COMMON_KEYS).toArrow()
    key, n = found.column("key").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(key)
    return key[order], np.ceil(np.log2(n[order] + 1)).astype(np.uint8)


def class_links(docs: DataFrame, classes: DataFrame, size: int = 5, similarity: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(a, b): true links between shingle classes, a spanning forest of them all.

    `classes` is shingle_classes(docs), already written, as it is read thrice.
    """
    one = cut(classes.where("class_id is not null").groupBy("class_id").agg(
        F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("doc_id"), F.min("text_code").alias("text_code")
    ))
    common = common_keys(docs, classes.count(), size, similarity, text)
    keys = docs.select(F.col(text).alias("text")).transform(map_batches, _keys(similarity, size, common), "key long, class_id long")
    dealt = keys.repartition("key").sortWithinPartitions("key", "class_id")
    found = cut(dealt.transform(map_batches, _buckets, "a long, b long, key long"))
    del keys, dealt
    sweep(found)

    links = "a long, b long"
    side = one.select("class_id", "n_shingles", "sketch")
    pairs = found.where("b is not null").select("a", "b").distinct()
    for c in ("a", "b"):
        pairs = pairs.join(side.toDF(c, f"n_{c}", f"s_{c}"), c)
    close = pairs.select("a", "b", "n_a", "n_b", "s_a", "s_b").transform(map_batches, _pair_filter(similarity), links)

    def shingled(group: DataFrame) -> DataFrame:
        names = [c for c in group.columns if c not in ("doc_id", "text_code")]
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in group.select(*names).schema.fields)
        return with_texts(docs, group, text, doc_id).transform(map_batches, _payload(size, names), f"{kinds}, shingles binary")

    large = found.where("b is null").select(F.col("key").alias("grp"), F.col("a").alias("class_id"))
    first = None
    if not large.isEmpty():
        # some buckets of each class, the first ones in one order of all keys, so that near copies have them in common
        few = large.groupBy("class_id").agg(F.collect_set(F.struct(F.xxhash64("grp").alias("h"), "grp")).alias("all"))
        few = few.select("class_id", F.explode(F.slice(F.array_sort("all"), 1, FIRST_BUCKETS)).alias("x")).select("class_id", "x.grp")
        some = few.join(one, "class_id")
        load = some.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w")).select("grp", F.expr(_pieces("n", "w")).alias("pieces"))
        chunk = F.pmod(F.xxhash64("class_id", "grp"), F.col("pieces"))
        placed = some.join(load, "grp").select("grp", chunk.alias("i"), chunk.alias("j"), "class_id", F.col("class_id").alias("comp"), "n_shingles", "sketch", "doc_id", "text_code")
        first = cut(_dealt(shingled(placed)).transform(map_batches, _chunks(similarity, True), links))
        sweep(first)
        known = components(first).select(F.col("node").alias("class_id"), F.col("label").alias("comp"))
        comp = lambda rows: rows.join(known, "class_id", "left").withColumn("comp", F.coalesce("comp", "class_id"))
        # buckets of one component are done
        mixed = cut(comp(large).groupBy("grp").agg(
            F.min("comp").alias("least"), F.max("comp").alias("most"), F.count(F.lit(1)).alias("n")
        ).where("least <> most").select("grp", F.lit(True).alias("mixed"), "n"))
        open_rows = spread_join(large, mixed.drop("n"), "grp", mixed.select("grp", "n")).where("mixed").drop("mixed")
        light = cut(comp(open_rows.join(one.select("class_id", "n_shingles"), "class_id")))
        rest = _loaded(light, False).join(one.select("class_id", "sketch"), "class_id")
        close = close.union(_deal(rest).transform(map_batches, _chunks(similarity, False), links)).union(first)
    close = cut(close)
    sweep(close)
    coarse = components(close)
    group = one.join(coarse.select(F.col("node").alias("class_id"), F.col("label").alias("grp")), "class_id")
    group = cut(comp(group) if first is not None else group.withColumn("comp", F.col("class_id")))
    rows = shingled(_loaded(group, True))
    exact = _deal(rows).transform(map_batches, _chunks(similarity, True), links)
    return exact if first is None else exact.union(first)


def jaccard_components(docs: DataFrame, size: int = 5, similarity: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) for every row of docs.

    A set holds the distinct runs of `size` words (white-space words, A-Z
    lower-cased); a shorter text's whole sequence is its only element; a null
    or wordless text has an empty set, links with nothing and is its own
    component.  Two texts link when common >= similarity * union, compared in
    whole numbers.  component_id is the smallest doc_id reachable by links.
    Repeated rows give repeated rows; other columns of docs are ignored; an
    empty table gives an empty table.  Rows with a null doc_id link like all
    others, but never name a component; where a component has no other rows
    its component_id is null.
    """
    classes = cut(shingle_classes(docs, size, similarity, text, doc_id))
    links = cut(class_links(docs, classes, size, similarity, text, doc_id))
    labels = components(links).select(F.col("node").alias("class_id"), F.col("label").alias("root"))
    names = classes.where("class_id is not null").groupBy("class_id").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    known = cut(names.join(labels, "class_id", "left").withColumn("root", F.coalesce("root", "class_id")))
    roots = known.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = spread_join(known.select("class_id", "root", "n"), roots.drop("n"), "root", roots.select(F.col("root"), "n")).drop("root", "n")
    counts = known.select("class_id", "n")
    return spread_join(classes.select("doc_id", "n_shingles", "class_id"), named, "class_id", counts).select(
        "doc_id", "n_shingles", "class_id", F.when(F.col("class_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without near duplicates: of each component the smallest doc_id stays.

    All rows of an id stay or go together, and they go if one of them would;
    rows with a null id stay, as nothing tells them apart.  Null and empty texts
    are linked with nothing and stay; an empty table stays empty.
    """
    found = jaccard_components(docs, size, similarity)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def op10_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")
