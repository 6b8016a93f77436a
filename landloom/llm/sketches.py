"""Document fingerprints: a threshold-scaled sketch that keeps every shingle hash below a fixed fraction of the hash range."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from landloom.session import read

#: Of this many hashes one is kept, whatever the text.
SCALE = 4
#: Code points of a shingle. Shingles of words are too few in short texts, where one edit breaks most of them.
WIDTH = 8
#: Hashes have so many bits, which are written as eight characters.
BITS = 48
#: Rows of a range of ids, and ranges at most: their ends are held by the driver and by each task.
ROWS, RANGES = 2048, 50_000


def shingle_hashes(text: str, width: int = WIDTH) -> np.ndarray:
    """A hash of BITS bits for each run of ``width`` code points of a text in lower case (A-Z) whose white space is single spaces; it is padded at both ends, so that ends count and short texts have shingles too."""
    words = text.encode(errors="surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    points = np.frombuffer(b" ".join(words).decode(errors="surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    padded = np.zeros(len(points) + 2 * (width - 1), np.uint64)
    padded[width - 1 : width - 1 + len(points)] = points
    n = len(points) + width - 1
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += padded[k : k + n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h >> np.uint64(64 - BITS)


def sketch(text: str, width: int = WIDTH, scale: int = SCALE) -> np.ndarray:
    """The distinct hashes in the lowest of ``scale`` parts of their range, in order."""
    h = shingle_hashes(text, width)
    return np.unique(h[h < np.uint64((1 << BITS) // scale)])


def write(text: str, hashes: np.ndarray) -> str:
    """A fingerprint as text: 16 digits that tell the text itself, a colon, and the kept hashes in base64, eight characters each."""
    kept = np.ascontiguousarray(hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8 :])
    return f"{xxhash.xxh64_intdigest(text.encode(errors='surrogatepass')):016x}:{base64.b64encode(kept.tobytes()).decode()}"


def parse(fingerprint: str) -> np.ndarray:
    kept = np.frombuffer(base64.b64decode(fingerprint.partition(":")[2]), np.uint8).reshape(-1, BITS // 8)
    out = np.zeros((len(kept), 8), np.uint8)
    out[:, 8 - BITS // 8 :] = kept
    return out.reshape(-1).view(">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of two texts' shingles together: as the limit is fixed, just the union."""
    return np.union1d(a, b)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated share of a's shingles that b has; 0 where nothing of a was kept. The sizes may be as unequal as they like."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 0.0


def likeness(a: np.ndarray, b: np.ndarray, same: bool = False) -> float:
    """The estimated share of shingles in common out of those of either (Jaccard); of equal texts 1, and 0 where nothing was kept."""
    if same:
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    total = len(a) + len(b) - common
    return common / total if total else 0.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(doc_id, fingerprint) of the whole text of every row.

    Equal texts have equal fingerprints. Null texts count as empty, whose sketch holds nothing; texts of few characters
    may keep none. Rows may repeat, ids may be null, an empty table gives no rows, other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = pa.array([write(t or "", sketch(t or "", width, scale)) for t in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), out], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(each, f"doc_id {kind}, fingerprint string")


def with_next(docs: DataFrame, make, schema: str, id_col: str = "doc_id", text_col: str = "text", rows_each: int = ROWS) -> DataFrame:
    """Rows that ``make()(id, text, next_text)`` gives for each document and the next one in descending order of id, the first following the last.

    The ids are cut into ranges of about ``rows_each`` rows, so their number follows the input (RANGES at most, then ranges grow). Each range is a partition, sorted and read as a
    stream, together with a copy of the first row of the next range that has rows, so a text moves once. Nulls come last; rows of one id are ordered by text,
    null texts being empty. An empty table gives no rows; a single row is its own next; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    n = rows.select("i").count()
    if not n:
        return docs.sparkSession.createDataFrame([], schema)
    parts = min(RANGES, -(-n // rows_each))
    ends = rows.agg(F.percentile_approx("i", [k / parts for k in range(1, parts)], 4 * parts)).first()[0] if parts > 1 else []
    ends = np.array(sorted(set(ends or [])), np.int64)

    # Range 0 holds the greatest ids, the last one nulls. Only ids go through Python here.
    @F.pandas_udf("int")
    def nth(i: pd.Series) -> pd.Series:
        known = i.notna().to_numpy()
        at = np.where(known, len(ends) - np.searchsorted(ends, i.fillna(0).to_numpy(np.int64), side="right"), len(ends) + 1)
        return pd.Series(at.astype(np.int32))

    numbered = rows.withColumn("range", nth("i"))
    tops = {r.range: r.top for r in numbered.select("i", "range").groupBy("range").agg(F.max("i").alias("top")).collect()}  # as many as ranges
    order = sorted(tops)
    before = {r: order[k - 1] for k, r in enumerate(order)}

    @F.pandas_udf("int")
    def previous(r: pd.Series) -> pd.Series:
        return r.map(before).astype("int32")

    firsts = [v for v in tops.values() if v is not None]
    first = F.col("i").isin(firsts) if firsts else F.lit(False)
    if None in tops.values():
        first = first | F.col("i").isNull()
    # Of the rows of a range's first id the one with the smallest text is its first.
    copies = rows.where(first).groupBy("i").agg(F.min("t").alias("t")).withColumn("own", nth("i"))
    copies = copies.select("i", "t", previous("own").alias("range"), F.lit(True).alias("copy"))
    dealt = numbered.select("i", "t", "range", F.lit(False).alias("copy")).unionByName(copies)
    ordered = dealt.repartitionById(len(ends) + 2, F.col("range")).sortWithinPartitions("copy", F.col("i").desc_nulls_last(), "t")
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        last = None
        for b in batches:
            out = []
            for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if last:
                    out.append(work(*last, row[1]))
                last = row
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)

    return ordered.select("i", "t").mapInArrow(each, schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and how much of the edited and of the next text's sketch is contained in the document's own, and the other way round."""

    def make():
        held: list = [None, None]  # the next text and its sketch, which is the next row's own

        def work(doc_id: int | None, text: str, following: str) -> dict:
            k = len(text) // 3
            edited = text[: len(text) - k] + following[:k]
            a = held[1] if held[0] == text else sketch(text)
            b, c = sketch(edited), sketch(following)
            held[:] = following, c
            return {
                "doc_id": doc_id,
                "n_chars": len(text),
                "edited_sha256": hashlib.sha256(edited.encode(errors="surrogatepass")).hexdigest(),
                "fingerprint": write(text, a),
                "edited_fingerprint": write(edited, b),
                "near_edited": likeness(a, b, text == edited),
                "near_next": likeness(a, c, text == following),
                "edited_in_own": containment(b, a),
                "own_in_edited": containment(a, b),
                "next_in_own": containment(c, a),
                "own_in_next": containment(a, c),
            }

        return work

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_in_own double, own_in_edited double, next_in_own double, own_in_next double"
    return with_next(read(spark, sf_dir, "documents"), make, schema)
