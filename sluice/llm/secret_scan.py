"""Secret scan in DataFrame expressions only.

Pattern finders give the base spans.  On top of them candidate strings (runs
of token symbols, without base spans and harmless stretches) are scanned by a
sliding window whose Shannon entropy is kept up by incremental counts (one
symbol enters, one leaves), with a threshold for each character class and an
allow-list that suppresses well-known harmless forms.

Positions are code points, end exclusive.  Spark has no function for the
positions of all matches, so they are prefix sums over the lengths of matches
and of the pieces between them.  Everything is linear in a text but for a
logarithm: prefix sums and maxima double their reach step by step, windows are
judged and texts cut in blocks of bounded size, and no list grows by copying.
Texts without any match, nearly all, pay for the searches only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textcore import fresh

#: Base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_ASSIGNED = 6
KINDS = ("assign", "access", "hex", "entropy")

#: Candidate strings: whole runs of token symbols with a digit in them.
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}+"
#: Bits per symbol from which a window counts, by class of the candidate.
CLASSES = (("hex", "^[0-9a-f]++$", 2.9), ("upper", "^[A-Z0-9]++=*$", 3.3), ("mixed", "", 3.6))
#: Harmless forms of a whole candidate: UUIDs; words or numbers joined by marks,
#: which are the runs where no letter stands next to a digit.
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
LETTER_BY_DIGIT = r"[A-Za-z][0-9]|[0-9][A-Za-z]"
#: Harmless stretches, cut out of a run: a part between marks that names a placeholder; repeated symbols.
STRETCHES = (
    r"(?i:(?<![a-z0-9])[a-z0-9]*(?:example|sample|placeholder|changeme|dummy)[a-z0-9]*)",
    r"(?i:x{4,}+)",
    r"(.)\1{5,}+",
)
#: What is cut out becomes this symbol, once for each of its own; marks next to it go too.
HOLE = "\x01"
LOOSE_MARKS = "(?<=\x01)[-+/_=]++|(?<![-+/_=])[-+/_=]++(?=\x01)"

#: Windows judged, and code points of a text cut, in one block.
JUDGED, BLOCK = 512, 1024

_SPAN = "array<struct<start:int,rank:int,end:int>>"
_RANGE = "array<struct<a:int,b:int>>"


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """SQL for body with `name` standing for value, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _prefix(items: str, op: str) -> str:
    """SQL for the running op (+ or greatest) over an array of integers."""
    both = "x + element_at(q.acc, i - q.d + 1)" if op == "+" else "greatest(x, element_at(q.acc, i - q.d + 1))"
    step = _let("named_struct('acc', acc, 'd', shiftleft(1, k))", "q", f"transform(q.acc, (x, i) -> if(i >= q.d, {both}, x))")
    return _let(items, "pf", f"aggregate(sequence(0, cast(ceil(log2(size(pf) + 1)) as int)), pf, (acc, k) -> {step})")


def _matches(text: str, pattern: str, body: str, otherwise: str) -> str:
    """SQL for body over m (pieces, hits, ends of hits) where text has a match."""
    p = _quoted(pattern)
    ends = _prefix("zip_with(slice(h.pieces, 1, size(h.hits)), h.hits, (a, b) -> length(a) + length(b))", "+")
    hits = f"named_struct('pieces', split({text}, {p}, -1), 'hits', regexp_extract_all({text}, {p}, 0))"
    with_ends = _let(hits, "h", f"named_struct('pieces', h.pieces, 'hits', h.hits, 'ends', {ends})")
    return f"CASE WHEN {text} RLIKE {p} THEN {_let(with_ends, 'm', body)} ELSE {otherwise} END"


def _found(text: str, pattern: str, rank: int, least: int = 0) -> str:
    """SQL for the spans of all matches; with `least`, group 2 has so many symbols."""
    spans = f"zip_with(m.hits, m.ends, (h, e) -> named_struct('start', e - length(h), 'rank', {rank}, 'end', e))"
    if least:
        long = f"transform(regexp_extract_all({text}, {_quoted(pattern)}, 2), g -> length(g) >= {least})"
        spans = f"transform(filter(zip_with({spans}, {long}, (s, ok) -> named_struct('s', s, 'ok', ok)), x -> x.ok), x -> x.s)"
    return _matches(text, pattern, spans, f"cast(array() as {_SPAN})")


def _holes(text: str, pattern: str) -> str:
    """SQL for text with every match turned into holes."""
    filled = f"zip_with(m.pieces, m.hits, (a, b) -> concat(a, repeat('{HOLE}', coalesce(length(b), 0))))"
    return _matches(text, pattern, f"array_join({filled}, '')", text)


def _merged(spans: str) -> str:
    """SQL for the union of spans that are sorted by start, as ranges (a, b)."""
    far = _prefix("transform(v.s, x -> x.end)", "greatest")
    starts = "filter(transform(u.s, (x, i) -> if(i = 0, x.start, if(x.start > element_at(u.far, i), x.start, -1))), x -> x >= 0)"
    ends = "filter(transform(u.far, (x, i) -> if(i + 1 = size(u.s), x, if(element_at(u.s, i + 2).start > x, x, -1))), x -> x >= 0)"
    return _let(f"named_struct('s', {spans})", "v", _let(f"named_struct('s', v.s, 'far', {far})", "u", f"zip_with({starts}, {ends}, (a, b) -> named_struct('a', a, 'b', b))"))


def _covered(text: str, ranges: str, cover: str) -> str:
    """SQL for text with each range r (a, b) replaced by `cover`; ranges are apart, sorted and at least one."""
    block = lambda k, a, b: f"substring(element_at(t.blocks, {k} + 1), greatest({a} - {k} * {BLOCK}, 0) + 1, {b} - greatest({a}, {k} * {BLOCK}))"
    part = f"if(w.b > w.a, array_join(transform(sequence(cast(w.a div {BLOCK} as int), cast((w.b - 1) div {BLOCK} as int)), k -> {block('k', 'w.a', 'w.b')}), ''), '')"
    gap = _let("named_struct('a', if(i = 0, 0, element_at(t.r, i).b), 'b', r.a)", "w", part)
    tail = _let(f"named_struct('a', element_at(t.r, -1).b, 'b', length({text}))", "w", part)
    cut = f"named_struct('r', {ranges}, 'blocks', regexp_extract_all({text}, '(?s).{{1,{BLOCK}}}', 0))"
    return _let(cut, "t", f"concat(array_join(transform(t.r, (r, i) -> concat({gap}, {cover})), ''), {tail})")


def _windows(candidate: str) -> str:
    """SQL for the ranges of a candidate whose windows reach its class's entropy.

    State: counts of each symbol in the window, the sum of count * log2(count),
    and the merged ranges so far.  A step changes at most two counts.  A block
    of windows begins with the counts of its first one's symbols.
    """
    table = "array(" + ", ".join(f"{c * math.log2(c) if c else 0.0!r}D" for c in range(WINDOW + 1)) + ")"
    limit = "CASE " + " ".join(
        f"WHEN d.text RLIKE {_quoted(p)} THEN {bits}D" if p else f"ELSE {bits}D" for _, p, bits in CLASSES
    ) + " END"
    term = "element_at(c.t, {} + 1)"
    count = "element_at(s.n, {})"
    leaving = f"{term.format(count.format('x.y'))} - {term.format(count.format('x.y') + ' - 1')}"
    entering = f"{term.format(count.format('x.x') + ' + 1')} - {term.format(count.format('x.x'))}"
    codes = f"named_struct('x', element_at(c.codes, i), 'y', if(i - {WINDOW} >= o.first, element_at(c.codes, greatest(i - {WINDOW}, 1)), 0))"
    step = _let(codes, "x", f"""named_struct(
        'n', if(x.x = x.y, s.n, transform(s.n, (v, k) -> v + if(k + 1 = x.x, 1, 0) - if(k + 1 = x.y, 1, 0))),
        'sum', if(x.x = x.y, s.sum, s.sum + {entering} - if(x.y > 0, {leaving}, 0D)),
        'out', s.out)""")
    judged = _let(step, "w", f"""named_struct('n', w.n, 'sum', w.sum, 'out',
        CASE WHEN i < o.first + {WINDOW - 1} OR {math.log2(WINDOW)!r}D - w.sum / {WINDOW} < c.bits THEN w.out
             WHEN size(w.out) > 0 AND element_at(w.out, -1).b >= i - {WINDOW}
             THEN concat(slice(w.out, 1, size(w.out) - 1), array(named_struct('a', element_at(w.out, -1).a, 'b', i)))
             ELSE concat(w.out, array(named_struct('a', i - {WINDOW}, 'b', i))) END)""")
    of_block = f"""aggregate(sequence(o.first, least(o.first + {JUDGED + WINDOW - 2}, size(c.codes))),
        named_struct('n', array_repeat(0, {len(SYMBOLS)}), 'sum', 0D, 'out', cast(array() as {_RANGE})),
        (s, i) -> {judged}, s -> s.out)"""
    blocks = f"""flatten(transform(sequence(0, cast((size(c.codes) - {WINDOW}) div {JUDGED} as int)),
        k -> {_let(f"named_struct('first', k * {JUDGED} + 1)", 'o', of_block)}))"""
    # ranges of neighbouring blocks may touch
    joined = _let(f"named_struct('s', {blocks})", "g", """zip_with(
        filter(transform(g.s, (x, i) -> if(i = 0, x.a, if(x.a > element_at(g.s, i).b, x.a, -1))), x -> x >= 0),
        filter(transform(g.s, (x, i) -> if(i + 1 = size(g.s), x.b, if(element_at(g.s, i + 2).a > x.b, x.b, -1))), x -> x >= 0),
        (a, b) -> named_struct('a', a, 'b', b))""")
    symbols = f"transform(split(d.text, ''), z -> instr({_quoted(SYMBOLS)}, z))"
    return _let(f"named_struct('text', {candidate})", "d", _let(f"named_struct('codes', {symbols}, 'bits', {limit}, 't', {table})", "c", joined))


def with_secret_spans(docs: DataFrame, text: str = "text", name: str = "secret_spans") -> DataFrame:
    """docs with the column `name`: array of (start, rank, end, kind), by start, then kind.

    A null or empty text has an empty array.  Base spans of different kinds may
    overlap each other.  Base spans and harmless stretches are cut out of a
    candidate run, with the marks next to them, and what is left of it is
    scanned, so an entropy span touches no base span, and a run's other secrets
    are still found.  A column of that name is replaced; all others pass
    through, whatever their names.  Repeated rows stay, an empty table stays
    empty.
    """
    if name == text:
        raise ValueError("the spans need a column of their own")
    rest = docs.drop(name)
    whole, base, clear = fresh(rest, "__text", "__base", "__clear")
    kinds = "array(" + ", ".join(map(_quoted, KINDS)) + ")"
    rows = rest.withColumn(whole, F.coalesce(F.col(f"`{text}`"), F.lit("")))
    rows = rows.withColumn(base, F.expr(f"concat({_found(whole, ASSIGN, 0, MIN_ASSIGNED)}, {_found(whole, ACCESS, 1)}, {_found(whole, HEX, 2)})"))
    hole = f"repeat('{HOLE}', r.b - r.a)"
    # texts without a candidate, nearly all, need no holes
    rows = rows.withColumn(clear, F.expr(
        f"CASE WHEN NOT {whole} RLIKE {_quoted(CANDIDATE)} THEN '' WHEN size({base}) > 0"
        f" THEN {_covered(whole, _merged(f'array_sort({base})'), hole)} ELSE {whole} END"
    ))
    rows = rows.withColumn(clear, F.expr(_holes(clear, "|".join(STRETCHES))))
    rows = rows.withColumn(clear, F.expr(_holes(clear, LOOSE_MARKS)))
    ranges = f"transform({_windows('p.h')}, r -> named_struct('start', p.at + r.a, 'rank', 3, 'end', p.at + r.b))"
    candidates = "zip_with(m.hits, m.ends, (h, e) -> named_struct('h', h, 'at', e - length(h)))"
    suspect = f"filter({candidates}, p -> p.h RLIKE {_quoted(LETTER_BY_DIGIT)} AND NOT p.h RLIKE {_quoted(UUID)})"
    entropy = _matches(clear, CANDIDATE, f"flatten(transform({suspect}, p -> {ranges}))", f"cast(array() as {_SPAN})")
    return rows.withColumn(base, F.expr(f"array_sort(concat({base}, {entropy}))")).withColumn(name, F.expr(
        f"transform({base}, s -> named_struct('start', s.start, 'rank', s.rank, 'end', s.end, 'kind', element_at({kinds}, s.rank + 1)))"
    )).drop(whole, base, clear)


def spans_text(spans: str, only_base: bool = False) -> Column:
    """kind:start:end of each span, comma-joined."""
    source = f"filter({spans}, s -> s.rank < 3)" if only_base else spans
    return F.expr(f"array_join(transform({source}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret span of `text` replaced by `mark`, overlapping spans by one.

    The columns are those of docs, in their order; a null text stays null, an
    empty one empty; repeated rows stay, an empty table stays empty.
    """
    (spans,) = fresh(docs, "__spans")
    found = with_secret_spans(docs, text, spans)
    covered = _covered(f"`{text}`", _merged(spans), _quoted(mark))
    return found.withColumn(text, F.expr(f"CASE WHEN size({spans}) > 0 THEN {covered} ELSE `{text}` END")).drop(spans)


def op1_secret_scans(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_secret_spans(docs).drop("text")
    count = lambda rank: F.expr(f"cast(size(filter(secret_spans, s -> s.rank = {rank})) as bigint)")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(spans_text("secret_spans", only_base=True).cast("binary"), 256).alias("base_sha256"),
        spans_text("secret_spans").alias("spans"),
    )
