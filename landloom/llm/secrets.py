"""Secret scans: patterns, and sliding-window Shannon entropy of each character class over candidate strings."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from landloom.session import free_name, read

# Kinds of the base patterns, in order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
ALNUM = re.compile(r"[A-Za-z0-9]+")
#: Character classes, narrowest first, and the bits of entropy that a window of a run of such characters must reach.
CLASSES = ((re.compile(r"[0-9a-fA-F]{20,}"), 3.0), (re.compile(r"[A-Za-z0-9]{20,}"), 3.7), (re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 3.9))
#: What looks random but is none: UUIDs, and numbers and dates.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    re.compile(r"[0-9]+([-_/=+][0-9]+)*[-_/=+]*"),
)
#: Segments of a string between separators, and the words and numbers of a segment, as paths, slugs and names in camel case have them.
SEGMENT = re.compile(r"[A-Za-z0-9]+")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

Span = tuple[str, int, int]


def greatest_entropy(text: str, window: int = WINDOW) -> float:
    """The greatest Shannon entropy in bits of a window of the text; as the window slides, one count goes down and one up."""
    width = min(window, len(text))
    if not width:
        return 0.0
    term = [0.0] + [-(k / width) * log2(k / width) for k in range(1, width + 1)]
    counts: dict[str, int] = {}
    now = 0.0
    best = 0.0
    for i, ch in enumerate(text):
        if i >= width:
            old = text[i - width]
            k = counts[old]
            now += term[k - 1] - term[k]
            counts[old] = k - 1
        k = counts.get(ch, 0)
        now += term[k + 1] - term[k]
        counts[ch] = k + 1
        if i >= width - 1 and now > best:
            best = now
    return best


def wordlike(letters: str, tenths: int = 3) -> bool:
    """Whether letters can be read as words: so many tenths of vowels, and no long run without one. Many random letters seldom pass."""
    low = letters.lower()
    vowels = sum(map(low.count, "aeiouy"))
    return 10 * vowels >= tenths * len(low) and max(map(len, re.split("[aeiouy]", low))) <= 4


def readable(segment: str) -> bool:
    """Whether a segment of letters and digits is made of words and short numbers, as in ``getUserProfile2`` or ``chapter7``: its parts are long enough and nearly all of it reads like words."""
    parts = PART.findall(segment)
    if len(segment) < 3 * len(parts) and len(segment) > 6:
        return False
    good = sum(len(p) for p in parts if (len(p) <= 8 if p[0].isdigit() else len(p) < 3 or any(c in "aeiouyAEIOUY" for c in p) and (len(p) < 6 or wordlike(p, 1 if len(p) < 10 else 3))))
    return 10 * good >= 9 * len(segment)


def allowed(text: str) -> bool:
    """Whether the allow-list covers all of the text: UUIDs, numbers, or words joined by separators or case."""
    return any(p.fullmatch(text) for p in ALLOWED) or all(readable(m[0]) for m in SEGMENT.finditer(text))


def random_parts(text: str) -> list[tuple[int, int]]:
    """Ranges of a candidate string that look random: stretches without readable segments, in which a window of a run of one character class reaches that class's entropy.

    So a key is found behind a name or a path, by its own class, and what is readable around it stays.
    """
    if any(p.fullmatch(text) for p in ALLOWED):
        return []
    stretches, start, keep = [], None, 0
    for m in SEGMENT.finditer(text):
        if readable(m[0]) and len(m[0]) > 2:
            if start is not None:
                stretches.append((start, keep))
            start = None
        else:
            start, keep = m.start() if start is None else start, m.end()
    if start is not None:
        stretches.append((start, len(text)))
    out = []
    for a, b in stretches:
        a = 0 if not SEGMENT.search(text, 0, a) else a
        runs = ((r[0], least) for kind, least in CLASSES for r in kind.finditer(text, a, b))
        if any(not ALLOWED[1].fullmatch(r) and greatest_entropy(r) >= least for r, least in runs):
            out.append((a, b))
    return out


def random_looking(text: str) -> bool:
    """Whether a part of the text looks random."""
    return bool(random_parts(text))


class _Walk:
    """Base spans as disjoint ranges in order, walked along with the candidates."""

    def __init__(self, base: list[Span]) -> None:
        self.ranges, self.at = [], 0
        for _, s, e in sorted(base, key=lambda b: b[1]):
            if self.ranges and s <= self.ranges[-1][1]:
                self.ranges[-1][1] = max(e, self.ranges[-1][1])
            else:
                self.ranges.append([s, e])

    def rest(self, start: int, end: int) -> list[tuple[int, int]]:
        """What is left of a range without the base spans; ranges must come in order."""
        while self.at < len(self.ranges) and self.ranges[self.at][1] <= start:
            self.at += 1
        out, k = [], self.at
        while k < len(self.ranges) and self.ranges[k][0] < end:
            s, e = self.ranges[k]
            if s > start:
                out.append((start, s))
            start = max(start, e)
            k += 1
        return [*out, (start, end)] if start < end else out


class _Candidate:
    """A candidate string, of which pieces are scored: a long one by itself, a short one as a part of the run of letters and digits that goes over its border."""

    def __init__(self, text: str, start: int, end: int) -> None:
        self.text, self.span, self.runs = text, (start, end), None

    def _over(self, at: int) -> bool:
        """Whether a random-looking run goes over this place."""
        if self.runs is None:
            self.runs = [r.span() for r in ALNUM.finditer(self.text, *self.span) if r.end() - r.start() >= WINDOW and random_looking(r[0])]
        k = bisect_right(self.runs, at, key=lambda r: r[0]) - 1
        return k >= 0 and self.runs[k][0] < at < self.runs[k][1]

    def secrets(self, start: int, end: int) -> list[tuple[int, int]]:
        piece = self.text[start:end]
        if end - start >= WINDOW:
            return [(start + a, start + b) for a, b in random_parts(piece)]
        return [(start, end)] if not allowed(piece) and (self._over(start) or self._over(end)) else []


def find(text: str) -> list[Span]:
    """Spans (kind, start, end) in code points, by start, then kind. Of a candidate string, what base spans leave is scored."""
    spans: list[Span] = []
    if "=" in text or ":" in text:
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [("hex", *m.span()) for m in LONG_HEX.finditer(text)]
    walk = _Walk(spans)
    for m in CANDIDATE.finditer(text):
        candidate = _Candidate(text, *m.span())
        spans += [("entropy", a, b) for s, e in walk.rest(*m.span()) for a, b in candidate.secrets(s, e)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


#: A match of HEX is a whole run, so those of 24 and more are these.
LONG_HEX = re.compile(r"[0-9a-f]{24,}")


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with each span, or run of overlapping spans, replaced by the mark."""
    out, done = [], 0
    for _, start, end in find(text):
        if start >= done:
            out += [text[done:start], mark]
            done = end
        else:
            done = max(done, end)
    return "".join([*out, text[done:]]) if out else text


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind,start,end>>) of the whole text of every row.

    Null texts count as empty; rows without a secret have an empty array; ids may be null and rows may repeat, each giving a row; an empty
    table gives none; of spans that start at one place the kind's order decides; other columns are ignored. The time a text takes grows with its length.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[dict(zip(("kind", "start", "end"), s)) for s in find(t or "")] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, spans)], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(each, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>")


def redacted(docs: DataFrame, text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """``docs`` with the secrets of whole texts replaced by a mark; ``count_col``, if there, follows.

    Null texts stay null and empty ones empty; no row goes, repeats and columns stay as they are, and an empty table stays empty.
    """

    @F.udf("string", useArrow=True)
    def clean(text: str | None) -> str | None:
        return None if text is None else redact(text)

    held = free_name(docs, "_clean")
    out = docs.withColumn(held, clean(F.col(text_col)))
    count = {count_col: F.length(held).cast(docs.schema[count_col].dataType)} if count_col in docs.columns else {}
    return out.withColumns({text_col: F.col(held)} | count).select(*docs.columns)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
