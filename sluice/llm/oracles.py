"""DuckDB SQL of the operators whose whole result SQL can express."""

from __future__ import annotations

from .importance import BUCKETS, LEAST_WORDS, PERCENT, SEED
from .lexical_search import TOP
from .line_dedup import MIN_CHARS, MIN_DOCS
from .mixing import BUDGET, DIMENSIONS, NONE, TEMPER

#: The raking of the tables at hand has settled after so many sweeps, the budget after so many rounds.
SWEEPS, WATER_ROUNDS = 24, 12

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"


def quality_rules() -> str:
    gone = lambda marks: f"length(t) - length(regexp_replace(t, '{marks}', '', 'g'))"
    return rf"""
    with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w from documents),
    each as (select doc_id, unnest(w) as a, generate_subscripts(w, 1) as i from d),
    three as (select doc_id, i, a, lead(a, 1) over o as b, lead(a, 2) over o as c from each window o as (partition by doc_id order by i)),
    runs as (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as n from three where c is not null),
    covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from runs where n > 1) group by doc_id),
    lines as (select doc_id, count(*) - count(distinct l) as n from (select doc_id, unnest(string_split(t, chr(10))) as l from d)
              where regexp_matches(l, '{_WORD}') group by doc_id),
    c as (select d.doc_id, len(w) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
            {gone('[#*$%&|<>]')} as n_symbols, coalesce(lines.n, 0) as n_dup_lines, coalesce(covered.n, 0) as n_repeat_words,
            {gone('[A-Z]')} as capitals, {gone('[a-z]')} as small, {gone('[0-9]')} as digits, {gone(chr(92) + 'n')} + 1 as n_lines,
            len(regexp_extract_all(t, '(?m)^[-*]')) as n_bullets,
            len(regexp_extract_all(t, '(?m)[.][.][.]$')) as n_ellipses
          from d left join covered using (doc_id) left join lines using (doc_id)),
    f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from c)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      not (base_failed or 4 * n_symbols > n_words or capitals > small or 10 * n_dup_lines > 6 * n_lines
           or 2 * digits > word_chars or 10 * n_bullets > 9 * n_lines or 10 * n_ellipses > 3 * n_lines or word_chars < 2 * n_words or word_chars > 25 * n_words) as kept
    from f"""


def jaccard_join() -> str:
    return rf"""
    with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') as w from documents),
    each as (select doc_id, unnest(w) as a, generate_subscripts(w, 1) as i from d),
    five as (select doc_id, a, lead(a, 1) over o as b, lead(a, 2) over o as c, lead(a, 3) over o as d, lead(a, 4) over o as e
             from each window o as (partition by doc_id order by i)),
    s as materialized (select distinct doc_id, concat_ws(' ', a, b, c, d, e) as x from five where e is not null
             union all select doc_id, array_to_string(w, ' ') from d where len(w) between 1 and 4),
    n as materialized (select doc_id, count(*) as n from s group by doc_id),
    p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by all),
    links as materialized (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
    both_ways as materialized (select a, b from links union select b, a from links),
    reach as (select a, b from both_ways union select r.a, e.b from reach r join both_ways e on r.b = e.a)
    select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(least(d.doc_id, m.b), d.doc_id) as component_id
    from d left join n using (doc_id) left join (select a, min(b) as b from reach group by a) m on m.a = d.doc_id"""


def mixing() -> str:
    gone = lambda marks: f"length(t) - length(translate(t, '{marks}', ''))"
    parts = [rf"""
    r as materialized (select *, case when tokens = 0 then 'empty' when ({gone('|#$%*&<>{}')}) * 10 > tokens then 'marked'
        when ({gone("' || chr(10) || '")}) * 8 > tokens then 'listed' when tokens >= 800 then 'long' when tokens < 120 then 'short' else 'plain' end as topic
      from (select doc_id, source, lang, coalesce(text, '') as t, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) as tokens from documents)),
    cells as materialized (select coalesce(source, '{NONE}') as source, coalesce(lang, '{NONE}') as lang, topic, cast(sum(tokens) as bigint) as tokens from r group by all),
    q as materialized (select *, {", ".join(f"pow(cast(sum(tokens) over (partition by {d}) as double), {TEMPER}) as s_{d}, count(*) over (partition by {d}) as n_{d}" for d in DIMENSIONS)} from cells),
    w0 as (select source, lang, topic, tokens, cast(tokens as double) as weight,
      {", ".join(f"s_{d} / (select sum(s_{d} / n_{d}) from q) as t_{d}" for d in DIMENSIONS)} from q)"""]
    step = 0
    for _ in range(SWEEPS):
        for d in DIMENSIONS:
            total = f"sum(weight) over (partition by {d})"
            parts.append(
                f"w{step + 1} as materialized (select source, lang, topic, tokens, case when {total} > 0 then weight * t_{d} / {total} else 0.0 end as weight,"
                f" t_source, t_lang, t_topic from w{step})"
            )
            step += 1
    parts.append(f"z0 as (select {BUDGET} * sum(tokens) / sum(weight) as scale from w{step})")
    for i in range(WATER_ROUNDS):
        short = "weight * scale >= tokens"
        parts.append(
            f"y{i} as (select any_value(scale) as scale, sum(case when {short} then tokens else 0 end) as given,"
            f" sum(case when {short} then 0.0 else weight end) as rest, sum(tokens) as n from w{step}, z{i})"
        )
        new = f"greatest({BUDGET} * n - given, 0) / rest"
        parts.append(f"z{i + 1} as (select case when rest <= 0 or {new} <= scale * (1 + 1e-12) then scale else {new} end as scale from y{i})")
    return f"""
    with {", ".join(parts)}
    select r.doc_id, r.source, r.lang, r.topic, r.tokens,
      round(case when c.tokens > 0 then weight * (select sum(tokens) from cells) / c.tokens else 0.0 end, 6) as weight,
      round(p, 6) as probability, ('0x' || substr(md5(cast(r.doc_id as varchar) || ':5'), 1, 13))::bigint / 4503599627370496.0 < p as kept
    from r join (select *, case when tokens > 0 then least(1.0, weight * (select scale from z{WATER_ROUNDS}) / tokens) else 0.0 end as p from w{step}) c
      on coalesce(r.source, '{NONE}') = c.source and coalesce(r.lang, '{NONE}') = c.lang and r.topic = c.topic"""


def line_dedup() -> str:
    blanks = " || ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13))
    return f"""
    with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
    l as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as i from d),
    k as (select *, translate(trim(line, {blanks}), '{_UPPER}', '{_LOWER}') as k from l),
    f as (select k from k where length(k) >= {MIN_CHARS} group by k having count(distinct doc_id) >= {MIN_DOCS}),
    j as (select k.*, f.k is not null as gone from k left join f on k.k = f.k)
    select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
      sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
    from j group by doc_id"""


def importance_resampling() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    of = lambda table, key: f"select {key} as k, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{word}')) as w from {table}"
    entry = "list_reduce(list_prepend(n, range(8)), lambda c, k: case when c % 2 = 1 then xor(3988292384, c >> 1) else c >> 1 end)"
    code = "list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i::int + 1, 2))::bigint)"
    sums = lambda name: f"(select coalesce(sum(n), 0) from {name})"
    return f"""
    with crc as (select list_transform(range(256), lambda n: {entry}) as tab),
    d as materialized ({of("documents", "doc_id")}), b as materialized ({of("benchmark", "item_id")}),
    words as (select distinct w from (select w from d union all select w from b)),
    coded as materialized (select w, xor(4294967295, list_reduce(list_prepend(4294967295, {code}), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1]))) % {BUCKETS} as bucket from words, crc),
    s as materialized (select bucket, count(*) as n from d join coded using (w) group by bucket),
    t as materialized (select bucket, count(*) as n from b join coded using (w) group by bucket),
    g as (select bucket, cast(floor(1000 * ln((coalesce(t.n, 0) + 1) * ({sums("s")} + {BUCKETS})::double / ((s.n + 1) * ({sums("t")} + {BUCKETS})::double))) as bigint) as gain from s left join t using (bucket)),
    f as (select k, count(*) as n, cast(sum(gain) as bigint) as weight from d join coded using (w) join g using (bucket) group by k),
    h as (select doc_id, coalesce(n, 0) as n, coalesce(weight, 0) as weight, ('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::bigint as h from documents left join f on k = doc_id),
    r as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double))) as bigint) as score from h),
    o as (select doc_id, row_number() over (order by score desc, doc_id) as rank from r where n >= {LEAST_WORDS})
    select r.doc_id, n as n_features, weight, score, case when rank <= {PERCENT} * (select count(*) from o) // 100 then rank end as rank
    from r left join o using (doc_id)"""


def ranked_search() -> str:
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    terms = lambda table, key: f"select {key}, translate(unnest(regexp_extract_all(coalesce(text, ''), '{word}')), '{_UPPER}', '{_LOWER}') as w from {table}"
    return f"""
    with q as materialized (select distinct item_id, w from ({terms("benchmark", "item_id")})),
    d as materialized ({terms("documents", "doc_id")}),
    n as materialized (select doc_id, count(*) as n from d group by doc_id),
    g as materialized (select count(*) as docs, cast(sum(n) as bigint) as all_terms from n),
    p as materialized (select doc_id, w, count(*) as tf from d where w in (select w from q) group by all),
    t as materialized (select w, cast(floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double)) as bigint) as weight from p, g group by w, docs),
    s as (select item_id, doc_id, cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // all_terms)))) as bigint) as score
          from q join p using (w) join t using (w) join n using (doc_id), g group by all),
    r as (select *, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank from s where score > 0)
    select item_id, rank, doc_id, score from r where rank <= {TOP}"""


ORACLE_SQL = {
    "op3_quality_rules": quality_rules(), "op5_mixing_sources": mixing(), "op10_ngram_jaccard_join": jaccard_join(), "op11_line_dedup": line_dedup(),
    "op12_importance_resampling": importance_resampling(),
    "op13_ranked_search": ranked_search(),
}
