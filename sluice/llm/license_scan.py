"""License scan: Aho-Corasick over words, and expressions by shunting-yard.

One automaton finds notice phrases and the words of an identifier tag in one
pass over a text's normalised words.  After a tag the raw text holds a licence
expression (and, or, with, brackets, trailing +) of any length: its tokens are
read while they can continue it, and a shunting-yard parser turns the longest
well-formed part into postfix, which is evaluated to the licences that bind in
any case, those that are one option of several, the exceptions granted, and
whether all-permissive terms can be chosen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import byte_view, map_batches

#: The base phrases and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Notice phrases of the method's own labels.
NOTICE_PHRASES = {
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache license": "apache-2",
    "apache software license": "apache-2",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl-2",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "common development and distribution license": "cddl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "isc license": "isc",
    "permission to use copy modify and or distribute this software": "isc",
    "boost software license": "bsl",
    "zlib license": "zlib",
    "artistic license": "artistic",
    "python software foundation license": "psf",
    "sil open font license": "ofl",
    "do what the fuck you want to public license": "wtfpl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by 4 0": "cc-by",
    "cc by 3 0": "cc-by",
    "cc0 1 0": "cc0",
    "open data commons open database license": "odbl",
    "released into the public domain": "public-domain",
    "dedicated to the public domain": "public-domain",
    "apache license version 2 0": "apache-2.0",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu general public license v2": "gpl-2.0",
    "gnu general public license v3": "gpl-3.0",
    "gnu lesser general public license version 2 1": "lgpl-2.1",
    "gnu lesser general public license version 3": "lgpl-3.0",
    "gnu affero general public license version 3": "agpl-3.0",
    "version 2 of the license or at your option any later version": "gpl-2.0-or-later",
    "version 3 of the license or at your option any later version": "gpl-3.0-or-later",
    "version 2 1 of the license or at your option any later version": "lgpl-2.1-or-later",
    "mozilla public license version 2 0": "mpl-2.0",
    "mozilla public license v 2 0": "mpl-2.0",
    "eclipse public license v1 0": "epl-1.0",
    "eclipse public license v 1 0": "epl-1.0",
    "eclipse public license v 2 0": "epl-2.0",
    "european union public licence v 1 2": "eupl-1.2",
    "boost software license version 1 0": "bsl-1.0",
    "sil open font license version 1 1": "ofl-1.1",
    "academic free license": "afl",
    "open software license": "osl",
    "microsoft public license": "ms-pl",
    "microsoft reciprocal license": "ms-rl",
    "server side public license": "sspl",
    "business source license": "busl",
    "elastic license": "elastic",
    "commons clause": "commons-clause",
    "universal permissive license": "upl",
    "mulan permissive software license": "mulanpsl",
    "educational community license": "ecl",
    "blue oak model license": "blueoak",
    "neither the name of the copyright holder nor the names of its contributors": "bsd-3-clause",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "attribution noncommercial 4 0 international": "cc-by-nc-4.0",
    "attribution noncommercial sharealike 4 0 international": "cc-by-nc-sa-4.0",
    "attribution noncommercial noderivatives 4 0 international": "cc-by-nc-nd-4.0",
    "attribution sharealike 4 0 international": "cc-by-sa-4.0",
    "attribution noderivatives 4 0 international": "cc-by-nd-4.0",
    "attribution 4 0 international": "cc-by-4.0",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "open data commons attribution license": "odc-by",
    "open data commons public domain dedication": "pddl",
    "all rights reserved": "all-rights-reserved",
    "proprietary and confidential": "proprietary",
}
#: Words of an identifier tag as it stands in the text; an expression follows.
TAG_PHRASE, TAG = "spdx license identifier", b"spdx-license-identifier"
COLON = re.compile(rb"[ \t]*:[ \t]*")
TOKEN = re.compile(rb"[ \t]*([()]|[A-Za-z0-9.+:-]+)")
#: The public licence identifiers without their versions; any other is OTHER.
#: Those that ask for no more than notices and disclaimers come first.
PERMISSIVE = frozenset("""
    0bsd afl aladdin-free apache artistic-free blessing blueoak bsd bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause
    bsd-3-clause-clear bsd-3-clause-lbnl bsd-4-clause bsl bzip2 cc-by cc0 cc-pddc cecill-b curl ecl efl ftl hpnd ibm-pibs icu ijg
    imagemagick isc json libpng libtiff mit mit-0 mit-cmu mit-modern-variant ms-pl mulanpsl naist-2003 ncsa odc-by openssl php pddl
    postgresql psf public-domain python ruby ssh-short tcl unicode-dfs unicode unlicense upl vim w3c wtfpl x11 xnet zlib
    zlib-acknowledgement zpl
""".split())
RESTRICTIVE = frozenset("""
    agpl apsl artistic bittorrent busl catosl cc-by-nc cc-by-nc-nd cc-by-nc-sa cc-by-nd cc-by-sa cddl cdla-permissive cdla-sharing cecill
    cecill-c commons-clause copyleft-next cpal cpl cua-opl elastic epl erlpl eupl gfdl gfdl-invariants gfdl-no-invariants gpl interbase
    ipl lal lgpl lgpllr lppl ms-rl mpl nasa nosl npl nposl odbl ofl ogl-uk oldap openldap osl parity polyform-noncommercial
    polyform-small-business qpl rpl rpsl rscpl simpl sissl sleepycat spl sspl sugarcrm watcom ypl zimbra
""".split())
KNOWN = PERMISSIVE | RESTRICTIVE
#: An identifier's version, country and what it says of other versions.
VERSIONED = re.compile(r"(?P<family>.+?)(?:-(?P<version>v?\d+(?:\.\d+)*))?(?:-(?:igo|uk|us|jp|de|fr|nl|at|au|eu))?(?P<later>-only|-or-later|\+)?$")
#: Exceptions after "with", by the start of their identifier.
EXCEPTIONS = (
    "389-exception", "asterisk-exception", "autoconf-exception", "bison-exception", "bootloader-exception", "classpath-exception", "clisp-exception",
    "eclipse-exception", "ecos-exception", "fawkes-runtime-exception", "flt-exception", "font-exception", "freertos-exception", "gcc-exception",
    "gnu-javamail-exception", "gpl-cc", "i2p-gpl-java-exception", "libtool-exception", "linux-syscall-note", "llvm-exception", "lzma-exception",
    "mif-exception", "ocaml-lgpl-linking-exception", "openssl-exception", "qt-gpl-exception", "qt-lgpl-exception", "qwt-exception",
    "swift-exception", "u-boot-exception", "universal-foss-exception", "wxwindows-exception",
)
OTHER = "other"
#: How sure one find makes us: a phrase, a parsed tag.
PHRASE_WEIGHT, TAG_WEIGHT = 0.6, 0.9

#: One pass: A-Z to small letters, all other separators to a space.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
BINDS = {"WITH": 3, "AND": 2, "OR": 1}


def tokens_of(raw: bytes, at: int = 0, end: int | None = None) -> list[str]:
    """The longest well-formed licence expression of raw[at:end] at its start, as tokens.

    Operators are in capitals or in small letters; a small one counts only
    before a bracket or a known identifier, as it may be a word of the prose.
    One pass: the end of the last well-formed part is kept.
    """
    found: list[str] = []
    good = depth = 0
    operand_next, prose = True, False
    while m := TOKEN.match(raw, at, len(raw) if end is None else end):
        token, at = m[1].decode("ascii"), m.end()
        upper = token.upper() if token in ("and", "or", "with") else token
        if upper in BINDS:
            if operand_next:
                break
            operand_next, prose = True, upper != token
            token = upper
        elif token == "(":
            if not operand_next or (found and found[-1] == "WITH"):
                break
            depth, prose = depth + 1, False
        elif token == ")":
            if operand_next or not depth:
                break
            depth -= 1
        else:
            known = exception_of(token) if found and found[-1] == "WITH" else label_of(token)
            if not operand_next or (prose and known == OTHER):
                break
            operand_next = False
        found.append(token)
        if not operand_next and not depth:
            good = len(found)
    return found[:good]


def to_postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard over a well-formed expression: operators after their operands."""
    out: list[str] = []
    held: list[str] = []
    for token in tokens:
        if token in BINDS:
            while held and held[-1] != "(" and BINDS[held[-1]] >= BINDS[token]:
                out.append(held.pop())
            held.append(token)
        elif token == "(":
            held.append(token)
        elif token == ")":
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        else:
            out.append(token)
    return out + held[::-1]


def _known(identifier: str, names) -> str | None:
    low = identifier.lower().rstrip("+.")
    return max((k for k in names if low == k or low.startswith(k + "-") or low.startswith(k + ".")), key=len, default=None)


def family_of(label: str) -> str | None:
    """The longest public identifier, without a version, that a label or identifier begins with."""
    low = label.lower().rstrip(".")
    whole = VERSIONED.match(low)
    if whole and whole["family"] in KNOWN:
        return whole["family"]
    return _known(low, KNOWN)


def label_of(identifier: str) -> str:
    """The identifier in small letters: its family, version and whether later ones may be chosen (`+` is -or-later).

    What a family's name is followed by otherwise (clauses, ports) is left out.
    """
    family = family_of(identifier)
    if family is None:
        return OTHER
    rest = identifier.lower().rstrip(".")[len(family) :]
    version = re.match(r"-v?(\d+(?:\.\d+)*)", rest)
    later = "-only" if rest.endswith("-only") else "-or-later" if rest.endswith(("-or-later", "+")) else ""
    return family + (f"-{version[1]}" if version else "") + later


def is_permissive(label: str) -> bool:
    return family_of(label) in PERMISSIVE


def exception_of(identifier: str) -> str:
    return _known(identifier, EXCEPTIONS) or OTHER


@dataclass(frozen=True)
class Terms:
    """What an expression comes to: licences that bind in any case, options, exceptions, a permissive choice."""

    binding: frozenset[str]
    options: frozenset[str] = frozenset()
    exceptions: frozenset[str] = frozenset()
    permissive: bool = False

    def both(self, o: Terms) -> Terms:
        binding = self.binding | o.binding
        return Terms(binding, (self.options | o.options) - binding, self.exceptions | o.exceptions, self.permissive and o.permissive)

    def either(self, o: Terms) -> Terms:
        binding = self.binding & o.binding
        options = (self.binding | o.binding | self.options | o.options) - binding
        return Terms(binding, options, self.exceptions | o.exceptions, self.permissive or o.permissive)

    def labels(self) -> set[str]:
        """Binding licences by name, others as option:, exceptions as exception:, and the choice."""
        return {
            *self.binding, *(f"option:{x}" for x in self.options), *(f"exception:{x}" for x in self.exceptions),
            "choice:permissive" if self.permissive else "choice:restricted",
        }


def evaluate(tokens: list[str]) -> Terms | None:
    """The terms of an expression's tokens; None without tokens."""
    stack: list[Terms | str] = []
    for token in to_postfix(tokens):
        if token in BINDS:
            right, left = stack.pop(), stack.pop()
            left = left if isinstance(left, Terms) else _licence(left)
            if token == "WITH":  # grants more than the licence, and is none itself
                stack.append(replace(left, exceptions=left.exceptions | {exception_of(str(right))}))
            else:
                right = right if isinstance(right, Terms) else _licence(right)
                stack.append(left.both(right) if token == "AND" else left.either(right))
        else:
            stack.append(token)
    if not stack:
        return None
    top = stack.pop()
    return top if isinstance(top, Terms) else _licence(top)


def _licence(identifier: str) -> Terms:
    label = label_of(identifier)
    return Terms(frozenset({label}), permissive=is_permissive(label))


def _automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    kinds: dict[str, list] = {}
    for phrase, label in BASE_PHRASES.items():
        kinds.setdefault(phrase, []).append(("base", label))
    for phrase, label in NOTICE_PHRASES.items():
        kinds.setdefault(phrase, []).append(("own", label))
    kinds.setdefault(TAG_PHRASE, []).append(("tag", ""))
    for phrase, found in kinds.items():
        whole = f" {phrase} "
        out.add_word(whole, (len(whole), found))
    out.make_automaton()
    return out


def scan_text(raw: bytes, automaton) -> tuple[int, list[int], set[str], set[str], float]:
    """(words, starts of base places, base labels, all labels, score) of a text's bytes."""
    flat = raw.translate(_WORD_BYTES)
    words = flat.split()
    norm = f" {b' '.join(words).decode('latin-1')} "
    starts: list[int] = []
    tags: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    doubt = 1.0
    at = nth = 0
    for end, (size, found) in automaton.iter(norm):
        start = end - size + 1
        for kind, label in found:
            if kind != "own":
                # words before `start`; matches come by their end, so count from either side
                nth += norm.count(" ", at, start) if start >= at else -norm.count(" ", start, at)
                at = start
            if kind == "tag":
                tags.append(nth)
                continue
            if kind == "base":
                starts.append(nth)
                base.add(label)
            labels.add(label)
            doubt *= 1 - PHRASE_WEIGHT
    if tags:
        spans = [m.span() for m in re.finditer(rb"[^ ]+", flat)]
        for nth, after in zip(tags, [*tags[1:], None]):
            a, b = spans[nth][0], spans[nth + 2][1]
            colon = COLON.match(raw, b) if raw[a:b].lower() == TAG else None
            if colon:  # the next tag ends the expression at the latest
                terms = evaluate(tokens_of(raw, colon.end(), spans[after][0] if after is not None else None))
                if terms is not None:
                    labels |= terms.labels()
                    doubt *= 1 - TAG_WEIGHT
    return len(words), starts, base, labels, 1.0 - doubt


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton()
    for batch in batches:
        buf, offsets = byte_view(batch.column(1))
        raw = memoryview(np.ascontiguousarray(buf))
        rows = [scan_text(bytes(raw[a:b]), automaton) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.record_batch(
            [
                batch.column(0),
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.list_(pa.int64())),
                pa.array([sorted(r[2]) for r in rows], pa.list_(pa.string())),
                pa.array([sorted(r[3]) for r in rows], pa.list_(pa.string())),
                pa.array([r[4] for r in rows], pa.float64()),
            ],
            names=["doc_id", "n_words", "base_starts", "base_labels", "labels", "score"],
        )


def scan_licenses(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, base_starts, base_labels, labels, score) of every row.

    base_starts lists the first word of every place of a base phrase; score is
    1 minus the product of the doubts that the finds leave, 0 without a find.
    A null or empty text has no words and no labels.  A malformed expression
    counts as far as it is well formed, else not at all; identifiers that are
    not known are labelled `other`.  An expression ends with its line.  Repeated rows stay,
    other columns are ignored, an empty table gives an empty table.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).transform(
        map_batches, _scan, f"doc_id {kind}, n_words long, base_starts array<long>, base_labels array<string>, labels array<string>, score double"
    )


def op2_license_scans(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", "n_words",
        F.size("base_starts").cast("long").alias("n_base"),
        F.array_min("base_starts").alias("first_word"), F.array_max("base_starts").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"),
        "score",
    )
