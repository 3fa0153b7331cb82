"""Licence scans: notices and identifier tags in whole texts, and SPDX expressions evaluated.

An Aho-Corasick automaton finds every phrase of ``PHRASES`` in the text's word sequence, the tag
that precedes a licence expression among them. Expressions behind a tag are parsed by shunting-yard
(``with`` binds closest, then ``and``, then ``or``) and evaluated to the labels they name and to
whether they can be met by permissive licences alone.

Words are maximal runs of [0-9a-z] and of characters from U+0080 on, A-Z lower-cased first. A place
is where all words of a phrase stand one after another; places may overlap and all count.

The score tells how much of a notice the text has: 0 without any place, else 1 - 1 / (1 + e), with
e the count of places, an expression that parses counting twice.

Edge cases: null and empty texts have no words, no places, null first and last words, empty labels
and score 0; a tag without a parsable expression counts as a place and adds no label; repeated rows
and extra columns pass through, columns named like the results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
TAG = "spdx license identifier"
# Phrases that the method adds; a version or variant has a label of its own beside the base one.
ADDED = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "apache license version 2 0": "apache-2.0",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "permission is hereby granted free of charge": "mit",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
    "creative commons attribution": "cc-by",
    "boost software license": "bsl",
    "isc license": "isc",
    "zlib license": "zlib",
    TAG: "",
}
PHRASES = {p: (label, True) for p, label in BASE.items()} | {p: (label, False) for p, label in ADDED.items()}
PERMISSIVE = frozenset(["mit", "apache", "apache-2.0", "bsd", "isc", "zlib", "bsl", "cc0", "cc-by", "public-domain", "unlicense", "0bsd"])

# Bytes that are no part of a word become spaces, A-Z small letters.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_EXPRESSION = re.compile(r"(?i)spdx-license-identifier:[\x20\t]*([^\r\n]*)")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
_BINDS = {"or": 1, "and": 2, "with": 3}


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, (label, base) in PHRASES.items():
        found.add_word(f" {phrase} ", (len(phrase) + 1, label, base, phrase == TAG))
    found.make_automaton()
    return found


def to_postfix(expression: str) -> list[str] | None:
    """Shunting-yard; None if the expression is not well formed."""
    out: list[str] = []
    held: list[str] = []
    operand_next = True
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if low in _BINDS:
            if operand_next:
                return None
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[low]:
                out.append(held.pop())
            held.append(low)
            operand_next = True
        elif token == "(":
            if not operand_next:
                return None
            held.append(token)
        elif token == ")":
            if operand_next:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        else:
            if not operand_next:
                break  # prose after the expression
            out.append(low)
            operand_next = False
    if operand_next or "(" in held:
        return None
    return out + held[::-1]


def licence_label(identifier: str) -> str:
    """Family of an identifier: gpl-2.0-only is gpl-2.0, bsd-3-clause bsd, cc-by-4.0 cc-by."""
    name = re.sub(r"(?:-only|-or-later|\+)$", "", identifier)
    if name.startswith("bsd-"):
        return "bsd"
    if name.startswith("cc0"):
        return "cc0"
    return re.sub(r"-[0-9.]+$", "", name) if name.startswith("cc-") else name


def evaluate(postfix: list[str]) -> tuple[set[str], bool]:
    """Labels named, and whether permissive licences alone can meet the expression."""
    stack: list[tuple[set[str], bool]] = []
    for token in postfix:
        if token not in _BINDS:
            label = licence_label(token)
            stack.append(({label}, label in PERMISSIVE))
            continue
        (right, may_right), (left, may_left) = stack.pop(), stack.pop()
        if token == "with":  # an exception is no licence of its own, and only loosens
            stack.append((left, may_left))
        elif token == "and":
            stack.append((left | right, may_left and may_right))
        else:
            stack.append((left | right, may_left or may_right))
    return stack[0]


def expressions(text: str) -> list[tuple[set[str], bool]]:
    """Every well-formed expression behind a tag, evaluated."""
    return [evaluate(p) for m in _EXPRESSION.finditer(text) if (p := to_postfix(m[1])) is not None]


def scan_text(text: str | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, permissive, score)"""
    words = (text or "").encode("utf-8").translate(_FOLD).split()
    plain = " " + b" ".join(words).decode("utf-8") + " "
    base, labels, starts, places, tagged = set(), set(), [], 0, False
    for end, (back, label, is_base, is_tag) in automaton().iter(plain):
        places += 1
        tagged |= is_tag
        if label:
            labels.add(label)
        if is_base:
            base.add(label)
            starts.append(end - back)
    found = expressions(text) if tagged else []
    for named, _ in found:
        labels |= named
    # A word starts after each space; the count of spaces before a start is the word's number.
    first = plain.count(" ", 0, min(starts)) if starts else None
    last = plain.count(" ", 0, max(starts)) if starts else None
    score = 1 - 1 / (1 + places + 2 * len(found)) if places else 0.0
    permissive = all(may for _, may in found) if found else None
    return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), permissive, score


FIELDS = [
    ("n_words", T.LongType(), pa.int64()), ("n_base", T.LongType(), pa.int64()), ("first_word", T.LongType(), pa.int64()), ("last_word", T.LongType(), pa.int64()),
    ("base_labels", T.StringType(), pa.string()), ("labels", T.StringType(), pa.string()), ("permissive", T.BooleanType(), pa.bool_()), ("score", T.DoubleType(), pa.float64()),
]


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the columns of FIELDS; ``permissive`` is null without an expression."""
    names = [n for n, _, _ in FIELDS]
    schema = T.StructType([f for f in df.schema.fields if f.name not in names] + [T.StructField(n, k) for n, k, _ in FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                keep = [n for n in part.schema.names if n not in names]
                rows = [scan_text(t) for t in part.column(part.schema.get_field_index(text)).to_pylist()]
                added = [pa.array([r[i] for r in rows], kind) for i, (_, _, kind) in enumerate(FIELDS)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in keep), *added], names=[*keep, *names])

    return df.mapInArrow(run, schema)
