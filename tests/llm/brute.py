"""Slow and plain versions of what the operators compute."""

import hashlib
import math
import re
import zlib
from collections import Counter

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LICENSE_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_SMALL = {c: c + 32 for c in range(65, 91)}


def lowered(text):
    return (text or "").translate(_SMALL)


def shingles(text, size=5):
    w = SPACE_WORDS.findall(lowered(text))
    if len(w) >= size:
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
    return {tuple(w)} if w else set()


def first_blocks(s, rule, common=None):
    """Bucket keys of a set by dictionaries and a plain sort; rule, bands and hash are the operator's."""
    import numpy as np

    from sluice.llm.jaccard_join import BAND_BITS, band_of, band_top
    from sluice.llm.textcore import mix

    one = lambda x: int(mix(np.array([x], dtype=np.uint64))[0])
    n, out = len(s), set()
    level = dict(zip(*(x.tolist() for x in common))) if common else {}
    most = rule.largest_partner(n)
    if most <= n and rule.differences(n, n) == 0:
        return np.zeros(0, dtype=np.int64)
    for band in range(band_of(n), band_of(most) + 1):
        top = band_top(band)
        d, k = rule.differences(n, min(most, top)), 2 * rule.differences(top, top) + 6
        for salt in (0, 1):
            blocks = {}
            for h in (mix(s ^ np.uint64(0xA0761D6478BD642F)) if salt else s).tolist():
                value, load = blocks.get((h >> 32) * k >> 32, (0, 0))
                blocks[(h >> 32) * k >> 32] = value ^ one(h), load + 1
            found = []
            for b, (value, load) in blocks.items():
                key = one(value ^ one(b + ((band * 4 + salt + 1) << 40))) >> BAND_BITS << BAND_BITS | band
                found.append((level.get(key, 0), -load, key))
            out |= {key for _, _, key in sorted(found)[: d + 1 if len(found) > d else None]}
            if len(found) > d:
                break
        else:
            out.add(one(band + 0x7F000000) >> BAND_BITS << BAND_BITS | band)
    return np.array(sorted(out), dtype=np.uint64).view(np.int64)


def components(texts):
    """{id: (set size, smallest linked id)} by comparing all pairs that share a shingle."""
    sets = {k: shingles(t) for k, t in texts.items()}
    up = {k: k for k in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    having = {}
    for k, s in sets.items():
        for x in s:
            having.setdefault(x, []).append(k)
    for k, s in sets.items():
        common = Counter(o for x in s for o in having[x] if o < k)
        for o, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[o]) - n):
                a, b = root(o), root(k)
                up[max(a, b)] = min(a, b)
    return {k: (len(s), root(k)) for k, s in sets.items()}


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_secrets(text):
    t = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found)


def all_secrets(text):
    """Base spans and entropy spans, symbol by symbol."""
    t = text or ""
    base = base_secrets(t)
    gone = [any(a <= i < b for a, _, b, _ in base) for i in range(len(t))] if base else [False] * len(t)
    masked = "".join("\x01" if g else c for g, c in zip(gone, t))
    harmless = r"(?i:(?<![a-z0-9])[a-z0-9]*(?:example|sample|placeholder|changeme|dummy)[a-z0-9]*)|(?i:x{4,})|(.)\1{5,}"
    masked = re.sub(harmless, lambda m: "\x01" * len(m[0]), masked, flags=re.A)
    masked = re.sub("(?<=\x01)[-+/_=]+|[-+/_=]+(?=\x01)", lambda m: "\x01" * len(m[0]), masked)
    out = list(base)
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", masked):
        run = m[0]
        uuid = re.fullmatch("[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", run)
        if not re.search("[0-9]", run) or uuid or not re.search("[A-Za-z][0-9]|[0-9][A-Za-z]", run):
            continue
        bits = 2.9 if re.fullmatch("[0-9a-f]+", run) else 3.3 if re.fullmatch("[A-Z0-9]+=*", run) else 3.6
        merged = []
        for i in range(len(run) - 19):
            c = Counter(run[i : i + 20])
            if -sum(n / 20 * math.log2(n / 20) for n in c.values()) >= bits - 1e-9:
                if merged and merged[-1][1] >= i:
                    merged[-1][1] = i + 20
                else:
                    merged.append([i, i + 20])
        out += [(m.start() + a, 3, m.start() + b, "entropy") for a, b in merged]
    return sorted(out)


def secrets_sha(found):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in found).encode()).hexdigest()


def quality_counts(text):
    t = text or ""
    w = SPACE_WORDS.findall(t)
    seen, duplicates = set(), 0
    for line in t.split("\n"):
        if SPACE_WORDS.search(line):
            duplicates += line in seen
            seen.add(line)
    runs = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), duplicates, len(covered)


def base_licenses(text, phrases):
    w = LICENSE_WORDS.findall(lowered(text))
    places, labels = [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), sorted(places), sorted(labels)


def licence_terms(tokens, label_of, exception_of, permissive):
    """(binding, options, exceptions, permissive) by recursive descent."""
    at = 0

    def chain(word, inner, join):
        nonlocal at
        out = inner()
        while at < len(tokens) and tokens[at] == word:
            at += 1
            out = join(out, inner())
        return out

    def simple():
        nonlocal at
        if tokens[at] == "(":
            at += 1
            out = any_of()
            assert tokens[at] == ")"
            at += 1
            return out
        label, extra = label_of(tokens[at]), set()
        at += 1
        if at < len(tokens) and tokens[at] == "WITH":
            extra = {exception_of(tokens[at + 1])}
            at += 2
        return {label}, set(), extra, label in permissive

    both = lambda a, b: (a[0] | b[0], (a[1] | b[1]) - a[0] - b[0], a[2] | b[2], a[3] and b[3])
    either = lambda a, b: (a[0] & b[0], (a[0] | b[0] | a[1] | b[1]) - (a[0] & b[0]), a[2] | b[2], a[3] or b[3])
    all_of = lambda: chain("AND", simple, both)
    any_of = lambda: chain("OR", all_of, either)
    out = any_of()
    assert at == len(tokens)
    return out


def unigrams(texts, held_out):
    """{id: (tokens, known, base score)} and the number of training tokens."""
    tokens = {k: [*SPACE_WORDS.findall(lowered(t)), None] for k, t in texts.items()}
    counts = Counter(x for k, v in tokens.items() if not held_out(k) for x in v)
    n, v = sum(counts.values()), len(counts)
    score = lambda x: math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1)))
    return {k: (len(t), sum(counts[x] > 0 for x in t), sum(map(score, t))) for k, t in tokens.items()}, n


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def quality_features(text):
    """Counts of tokens, token pairs, shapes and shape pairs, by name instead of hash."""
    tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0D]+", (text or "").encode())
    shapes = []
    for i, t in enumerate(tokens):
        capital, digit = re.compile(rb"[A-Z]"), re.compile(rb"[0-9]")
        mark = not re.match(rb"[0-9A-Za-z\x80-\xff]", t)
        shapes.append((bool(capital.match(t)), bool(capital.match(t[-1:])), bool(digit.match(t)), mark, i > 0 and tokens[i - 1] == t))
    found = Counter(("token", t) for t in tokens)
    found.update(("pair", a, b) for a, b in zip(tokens, tokens[1:]))
    found.update(("shape", x) for x in shapes)
    found.update(("shapes", a, b) for a, b in zip(shapes, shapes[1:]))
    size = math.sqrt(max(sum(found.values()), 1))
    return {k: n / size for k, n in found.items()} | {"bias": 1.0}


def ftrl_scores(train, asked, epochs=3, alpha=1.0, beta=1.0, l1=0.001, l2=0.01):
    """Scores of the asked texts after follow-the-regularised-leader over (text, label) rows in order."""
    z, n = Counter(), Counter()

    def weight(k):
        free = 0.0 if k == "bias" else l1
        return 0.0 if abs(z[k]) <= free else -(z[k] - math.copysign(free, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    chance = lambda x: 1 / (1 + math.exp(-sum(weight(k) * v for k, v in x.items())))
    rows = [(quality_features(t), y) for t, y in train]
    for _ in range(epochs):
        for x, y in rows:
            p, w = chance(x), {k: weight(k) for k in x}
            for k, v in x.items():
                g = (p - y) * v
                sigma = (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha
                z[k] += g - sigma * w[k]
                n[k] += g * g
    return [chance(quality_features(t)) for t in asked]


def language_scores(text, words, emission, moves, languages):
    """Mean probability of each language over the words, by forward-backward in logarithms, word by word.

    words(text) gives the words, emission(word) a weight for each language.
    """
    found = [emission(w) for w in words(text)]
    k = range(len(languages))
    lse = lambda x: max(x) + math.log(sum(math.exp(v - max(x)) for v in x))
    ahead, behind = [], [[0.0 for _ in k]]
    for e in found:
        ahead.append([e[j] + (lse([ahead[-1][i] + moves[i][j] for i in k]) if ahead else 0.0) for j in k])
    for e in found[:0:-1]:
        behind.insert(0, [lse([moves[i][j] + e[j] + behind[0][j] for j in k]) for i in k])
    total = [0.0 for _ in k]
    for a, b in zip(ahead, behind):
        z = lse([x + y for x, y in zip(a, b)])
        total = [t + math.exp(x + y - z) for t, x, y in zip(total, a, b)]
    return [t / max(len(found), 1) for t in total]


def suffix_tree_scores(train, asked, depth=6, core=2, least=4, prior=1.0):
    """log10 probabilities by a tree of dictionaries: contexts seen `least` times, kept by a divergence
    test (with their suffixes; up to `core` symbols in any case), smoothed by distinct followers."""
    stream = lambda t: [255 if b == 0 else b for b in " ".join(SPACE_WORDS.findall(lowered(t))).encode()] + [0]
    seen = {}
    for t in train:
        x = [0] * depth + stream(t)
        for i in range(depth, len(x)):
            for d in range(depth + 1):
                seen.setdefault(tuple(x[i - d : i]), Counter())[x[i]] += 1
    total = sum(seen.get((), Counter()).values())
    root = {c: (seen.get((), Counter())[c] + 0.5) / (total + 128) for c in range(256)}
    p, kept = {}, set()

    def chance(context, symbol):
        if not context:
            return root[symbol]
        n, below = seen[context], chance(context[1:], symbol)
        weight = prior * len(n)
        return (n[symbol] + weight * below) / (sum(n.values()) + weight)

    for c, n in seen.items():
        size = sum(n.values())
        if not c or size < least:
            continue
        gain = sum(v * math.log(v / size / chance(c[1:], x)) for x, v in n.items())
        if len(c) <= core or gain >= 0.5 * len(n) * math.log(max(size, 2)):
            for k in range(len(c)):
                kept.add(c[k:])
    out = []
    for t in asked:
        x, score = [0] * depth + stream(t), 0.0
        for i in range(depth, len(x)):
            state = next((tuple(x[i - d : i]) for d in range(depth, 0, -1) if tuple(x[i - d : i]) in kept), ())
            key = (state, x[i])
            if key not in p:
                p[key] = math.log10(chance(*key))
            score += p[key]
        out.append(score)
    return out
