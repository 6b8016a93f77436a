"""Licence scans: Aho-Corasick over words for tags and notices, and a shunting-yard evaluation of licence expressions."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from landloom.session import read

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices by their words, and identifiers by their words as tags write them. The last value is how freely a text may be reused, 0 to 1. A notice's phrase is long
#: enough to tell it; where licences share a sentence the most permissive of those that begin so is named.
LICENCES = {
    "mit": (["mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software"], 0.9),
    "isc": (["isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided"], 0.9),
    "0bsd": (["zero clause bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software"], 1.0),
    "bsd": (["redistribution and use in source and binary forms with or without modification are permitted", "bsd license"], 0.9),
    "bsd-2-clause": (["bsd 2 clause", "simplified bsd license", "freebsd license"], 0.9),
    "bsd-3-clause": (["bsd 3 clause", "new bsd license", "revised bsd license", "may be used to endorse or promote products derived from this software without specific prior written permission"], 0.9),
    "apache-2.0": (["apache license version 2 0", "apache license 2 0", "apache 2 0", "licensed under the apache license"], 0.85),
    "zlib": (["zlib license", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"], 0.9),
    "bsl-1.0": (["boost software license"], 0.9),
    "artistic-2.0": (["artistic license 2 0", "the artistic license"], 0.7),
    "python-2.0": (["psf license agreement", "python software foundation license"], 0.85),
    "ms-pl": (["microsoft public license"], 0.7),
    "ofl-1.1": (["sil open font license"], 0.7),
    "mpl-2.0": (["mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v 2 0", "mpl 2 0"], 0.6),
    "epl-2.0": (["eclipse public license 2 0", "eclipse public license v 2 0", "eclipse public license version 2 0"], 0.55),
    "cddl-1.0": (["common development and distribution license"], 0.5),
    "eupl-1.2": (["european union public licence", "european union public license", "eupl"], 0.5),
    "lgpl": (["lesser general public license", "library general public license"], 0.5),
    "lgpl-2.1": (["lesser general public license version 2 1", "lesser general public license as published by the free software foundation either version 2 1", "lgpl 2 1"], 0.5),
    "lgpl-3.0": (["lesser general public license version 3", "lesser general public license as published by the free software foundation either version 3", "lgpl 3 0"], 0.5),
    "gpl-2.0": (["gnu general public license version 2", "gnu general public license as published by the free software foundation either version 2", "gpl 2 0"], 0.4),
    "gpl-3.0": (["gnu general public license version 3", "gnu general public license as published by the free software foundation either version 3", "gpl 3 0"], 0.4),
    "agpl-3.0": (["affero general public license version 3", "affero general public license as published by the free software foundation either version 3", "agpl 3 0"], 0.3),
    "cc0-1.0": (["cc0", "creative commons zero", "to the extent possible under law"], 1.0),
    "unlicense": (["the unlicense", "released into the public domain"], 1.0),
    "wtfpl": (["do what the fuck you want to public license"], 1.0),
    "cc-by-sa": (["cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"], 0.6),
    "cc-by-nc": (["cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial"], 0.2),
    "cc-by-nd": (["cc by nd", "creative commons attribution noderivatives", "creative commons attribution noderivs"], 0.2),
    "cc-by": (["creative commons attribution"], 0.8),
    "gpl": ([], 0.4),
    "reserved": ([], 0.05),
    "proprietary": (["proprietary and confidential", "unauthorized copying of this file"], 0.02),
}
TAG = "spdx license identifier"
#: A byte of a word, A-Z made small, or a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


class Found(NamedTuple):
    n_words: int
    base: list[tuple[int, str]]  # (first word, label)
    labels: set[str]
    score: float
    expressions: list[str]


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    known: dict[str, list[tuple[str, str]]] = {TAG: [("tag", "")]}
    for phrase, label in BASE.items():
        known.setdefault(phrase, []).append(("base", label))
    for label, (phrases, _) in LICENCES.items():
        for phrase in phrases:
            known.setdefault(phrase, []).append(("notice", label))
    for phrase, meant in known.items():
        a.add_word(f" {phrase} ", (len(phrase), meant))
    a.make_automaton()
    return a


AUTOMATON = _automaton()
TAGGED = re.compile(r"spdx-license-identifier\s*:\s*([^\r\n]*)", re.IGNORECASE)
TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
#: Operators and how tightly they bind.
BINDS = {"or": 1, "and": 2, "with": 3}


class BadExpression(ValueError):
    pass


def to_postfix(text: str) -> list[str]:
    """Shunting-yard over identifiers, and/or/with and parentheses; what follows the longest expression (a comment's end) is left aside."""
    out: list[str] = []
    ops: list[str] = []
    operand_next = True
    at = 0
    for m in TOKEN.finditer(text):
        t, op = m[0], m[0].lower()
        if text[at : m.start()].strip():
            break
        at = m.end()
        if t == "(":
            if not operand_next:
                break
            ops.append(t)
        elif t == ")":
            if operand_next or "(" not in ops:
                break
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
        elif op in BINDS:
            if operand_next:
                raise BadExpression(text)
            while ops and ops[-1] != "(" and BINDS[ops[-1]] >= BINDS[op]:
                out.append(ops.pop())
            ops.append(op)
            operand_next = True
        else:
            if not operand_next:
                break
            out.append(t)
            operand_next = False
    if operand_next or "(" in ops:
        raise BadExpression(text)
    return out + ops[::-1]


def _label(identifier: str) -> str:
    name = identifier.lower().removesuffix("+")
    for end in ("-only", "-or-later"):
        name = name.removesuffix(end)
    if name in LICENCES:
        return name
    return next((k for k in ("cc-by-nc", "cc-by-nd", "cc-by-sa", "cc-by") if name.startswith(f"{k}-")), name)


@lru_cache(4096)
def evaluate(text: str) -> tuple[frozenset[str], float]:
    """Labels of an expression, and how freely it lets reuse: ``or`` takes the freer side, ``and`` the stricter, ``with`` halves the way to 1.

    Identifiers that aren't known count 0.3.
    """
    stack: list[tuple[frozenset[str], float]] = []
    for t in to_postfix(text):
        if t in BINDS:
            (right, r), (left, v) = stack.pop(), stack.pop()
            if t == "with":
                stack.append((left, (1 + v) / 2))
            else:
                stack.append((left | right, max(v, r) if t == "or" else min(v, r)))
        else:
            label = _label(t)
            stack.append((frozenset([label]), LICENCES[label][1] if label in LICENCES else 0.3))
    return stack[0]


def look(text: bytes) -> Found:
    """Licence places, labels and score of a UTF-8 text."""
    words = text.translate(FOLD).split()
    flat = f" {b' '.join(words).decode('utf-8', 'replace')} "
    base, notices, tagged = [], [], False
    counted, spaces = 0, 0  # the spaces of flat before ``counted``
    for end, (length, meant) in AUTOMATON.iter(flat):
        spaces, counted = spaces + flat.count(" ", counted, end), end
        for what, label in meant:
            if what == "tag":
                tagged = True
                continue
            notices.append((spaces - 1 - flat.count(" ", end - length, end), label))
            if what == "base":
                base.append(notices[-1])
    labels, values, expressions, told = {label for _, label in base}, [], [], []
    if tagged:
        at, n = 0, 0  # words before ``at``
        whole = text.decode("utf-8", "replace")
        for m in TAGGED.finditer(whole):
            first = n + len(whole[at : m.start(1)].encode().translate(FOLD).split())
            at, n = m.end(1), first + len(m[1].encode().translate(FOLD).split())
            try:
                found, value = evaluate(m[1])
            except BadExpression:
                continue
            expressions.append(m[1].strip())
            labels |= found
            values.append(value)
            told.append((first, n))
    # What stands in an expression is told by the expression: "MIT OR MPL-2.0" isn't the stricter of both.
    starts = [a for a, _ in told]
    outside = {label for place, label in notices if not ((k := bisect_right(starts, place)) and place < told[k - 1][1])}
    finer = {"gpl": "gpl-", "lgpl": "lgpl-", "cc-by": "cc-by-", "bsd": "bsd-"}
    for label in outside:  # the base phrase within a finer notice says no more than that notice
        if not (label in finer and any(o.startswith(finer[label]) for o in outside)):
            values.append(LICENCES[label][1])
    return Found(len(words), base, labels | outside, min(values, default=0.0), expressions)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, places array<struct<word,label>>, labels, score, expressions) of the whole text of every row.

    Places are those of the base phrases, in order; labels are those of phrases, notices and identifier tags, sorted; the score is how freely
    the strictest of them lets reuse, over 0 even for what may not be reused at all; 0 says that no licence was found. Notices inside a tag's expression count by the expression's value. Identifiers that aren't known are labels as they are written, in lower case. A tag whose expression can't be parsed adds nothing. Null texts count as
    empty; ids may be null and rows may repeat, each giving a row; an empty table gives none; other columns are ignored. The time a text takes grows with its length.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    place = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [look(t or b"") for t in b.column(1).to_pylist()]
            columns = [
                b.column(0),
                pa.array([f.n_words for f in found], pa.int64()),
                pa.array([[{"word": w, "label": n} for w, n in sorted(f.base)] for f in found], place),
                pa.array([sorted(f.labels) for f in found], pa.list_(pa.string())),
                pa.array([f.score for f in found], pa.float64()),
                pa.array([f.expressions for f in found], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "places", "labels", "score", "expressions"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(each, f"doc_id {kind}, n_words long, places array<struct<word:long,label:string>>, labels array<string>, score double, expressions array<string>")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.transform("places", lambda p: p["word"])
    label = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    return scan(read(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(word).alias("first_word"),
        F.array_max(word).alias("last_word"),
        F.array_join(label, ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )
