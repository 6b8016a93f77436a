"""SimHash near-duplicates by a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import acos, ceil, floor, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from landloom.llm.members import marked
from landloom.operators.components import connected_components
from landloom.session import cut, read

BYTES = 8
#: Rows of one posting list that are compared in one place; longer lists are dealt in pairs of blocks.
BLOCK = 1024


def shingle_hashes(text: bytes, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each word shingle, one for each place; the whole of a text of fewer words is one shingle, and a text without words has none."""
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    flat = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    digest, last = xxhash.xxh64_intdigest, len(words)
    n = max(1, last - width + 1)
    return np.fromiter((digest(flat[ends[i] : ends[min(i + width, last)] - 1], seed) for i in range(n)), np.uint64, n)


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a UTF-8 text, as a signed long: a bit is 1 if it is set in over half the hashes of its word shingles; without words all are 0."""
    hashes = shingle_hashes(text, width, seed)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little")
    over = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(over, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long.

    Null texts count as empty, and empty ones have fp 0; texts are read whole. Ids may be null or repeat; an empty table gives no rows; other columns are ignored.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint(t or b"", width) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fp], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(each, f"doc_id {kind}, fp long")


def covering_triples() -> list[tuple[int, int, int]]:
    """Triples of byte positions such that any four positions hold at least one: 20 of them (Turan's groups of 3, 3 and 2)."""
    group = [i % 3 for i in range(BYTES)]
    chosen = []
    for t in combinations(range(BYTES), 3):
        count = [sum(group[i] == g for i in t) for g in range(3)]
        if 3 in count or any(count[g] == 2 and count[(g + 1) % 3] == 1 for g in range(3)):
            chosen.append(t)
    return chosen


def tallied(values: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs i < j of fingerprints whose tally, the positions at which their bytes are equal, reaches ``least``."""
    held = np.ascontiguousarray(values).view(np.uint8).reshape(-1, BYTES)
    count = np.zeros((len(held), len(held)), np.uint8)
    for k in range(BYTES):
        count += held[:, k, None] == held[None, :, k]
    return np.nonzero(np.triu(count >= least, 1))


def verified_pairs(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs that the tally retains those that differ in ``bits`` bits or fewer."""
    i, j = tallied(values, BYTES - bits)
    good = np.bitwise_count(values[i] ^ values[j]) <= bits
    return i[good], j[good]


def _forest(values: np.ndarray, bits: int) -> np.ndarray:
    """A spanning forest, as edges, of the links among the values."""
    i, j = verified_pairs(values, bits)
    near = np.zeros((len(values), len(values)), bool)
    near[i, j] = near[j, i] = True
    left, edges = np.ones(len(values), bool), [np.empty((0, 2), np.uint64)]
    for root in np.unique(i):
        if not left[root]:
            continue
        left[root] = False
        front = np.array([root])
        while len(front):
            reached = near[front]
            found = np.flatnonzero(reached.any(axis=0) & left)
            left[found] = False
            edges.append(np.stack([values[found], values[front[reached[:, found].argmax(axis=0)]]], axis=1))
            front = found
    return np.concatenate(edges)


def near_links(fps: DataFrame, bits: int = 4) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp), enough to connect all that differ in ``bits`` (at most 4) bits or fewer.

    ``bits`` differing bits spoil at most as many bytes, so linked fingerprints share 8 - bits positional bytes or more. A posting
    list for a single byte holds a 256th of all rows, whose pairs would grow with the square of the input, so the inverted index has a
    list for each value of each chosen triple of positions, and any four shared positions hold a triple. In a list the
    shared positional bytes of each pair are tallied; pairs that reach the guaranteed minimum, 8 - bits, are retained (most that
    meet by chance share the list's three bytes only) and verified by their differing bits. A list of over BLOCK rows is dealt as pairs of blocks, so no task
    holds more than two blocks of it, and a block gives a spanning forest of its links instead of all pairs. Nulls are no
    fingerprints; repeated ones link to themselves at most; no rows give no edges; other columns are ignored.
    """
    if not 0 <= bits <= 4:
        raise ValueError("bits must be from 0 to 4")
    byte = [F.shiftrightunsigned("fp", 8 * i).bitwiseAND(255) for i in range(BYTES)]
    keys = [F.lit(k << 24) + byte[i] * 65536 + byte[j] * 256 + byte[m] for k, (i, j, m) in enumerate(covering_triples())]
    index = fps.where("fp is not null").select("fp", F.explode(F.array(*keys)).alias("key"))
    lists = index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    dealt = (
        index.join(lists, "key")
        .withColumn("g", F.ceil(F.col("n") / BLOCK).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        .groupBy("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select("fps")
    )

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(0)
            values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            starts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            size = np.diff(starts)
            two = starts[:-1][size == 2]  # most lists: many at once
            first, second = values[two], values[two + 1]
            kept = np.flatnonzero(((first ^ second).view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1) >= BYTES - bits)
            good = kept[np.bitwise_count(first[kept] ^ second[kept]) <= bits]
            found = [np.stack([first[good], second[good]], axis=1)]
            found += [_forest(values[starts[i] : starts[i + 1]], bits) for i in np.flatnonzero(size > 2)]
            edges = np.concatenate(found).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

    return dealt.mapInArrow(links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, bits: int = 4) -> DataFrame:
    """Near-duplicate components of all rows: (doc_id, fingerprint, component_id).

    Two rows are linked if the fingerprints of their whole texts differ in ``bits`` bits or fewer; component_id is the smallest
    doc_id that links reach. Null and empty texts have fingerprint zero and are linked like any other. Rows that repeat each give a row. A null doc_id
    takes part but names no component; where a component has no other, its component_id is null. Empty tables give
    no rows, other columns are ignored.
    """
    rows = cut(fingerprints(docs, id_col, text_col, width))
    # A node bears the smallest id of its fingerprint, those without any come last, so that a component's smallest node names it.
    node = F.struct(F.col("least").isNull().alias("none"), F.col("least"), F.col("fp"))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")).select("fp", node.alias("node")))
    ends = [nodes.select(F.col("fp").alias(k), F.col("node").alias(f"{k}_node")) for k in ("a", "b")]
    links = near_links(nodes.select("fp"), bits).join(ends[0], "a").join(ends[1], "b")
    tied = connected_components(links.select("a_node", "b_node"), "a_node", "b_node").select(F.col("node.fp").alias("fp"), F.col("component.least").alias("tied"), F.lit(True).alias("linked"))
    named = nodes.join(tied, "fp", "left").select("fp", F.when(F.col("linked"), F.col("tied")).otherwise(F.col("node.least")).alias("component_id"))
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- similarity of 0.8 and more -------------------------------------------------------------------------------------
#
# Texts that share 0.8 of their shingles differ in about ten of 64 fingerprint bits, which no index of eight bytes finds for sure. The stage that keeps
# one of each group therefore has a fingerprint of 256 bytes; lists of triples of its bytes propose pairs, and each link is verified by exact Jaccard.

#: Bytes of a wide fingerprint, and how many of them lists are keyed by; the others go with each posting.
WIDE, KEYED = 256, 251
#: List k holds the texts by the bytes k, k + 1 and k + 3 around the ring of keyed positions, so two lists share one position at most.
RING = (0, 1, 3)
#: Odd multipliers that turn one hash into the 64-bit words of a wide fingerprint.
WORDS = np.random.default_rng(42).integers(0, 1 << 63, WIDE // 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Partners, the closest ones, that a text's links are verified with first, in rounds, each over one of FIRST parts of the lists; then all pairs that are left are verified.
PARTNERS, ROUNDS, FIRST = 3, 2, 8
#: Pairs that one task verifies, about.
CELL = 10_000
#: Texts of fewer shingles have fingerprints that vary more.
FEW = 20


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so that few texts' hashes are held at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def wide_fingerprint(distinct: np.ndarray) -> bytes:
    """SimHash of WIDE bytes of distinct hashes."""
    total = np.zeros(WIDE * 8, np.int64)
    for at in range(0, len(distinct), 255):  # as many ones as a byte counts
        x = distinct[at : at + 255, None] * WORDS
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        total += np.add.reduce(np.unpackbits(x.view(np.uint8).reshape(len(x), WIDE), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(distinct)).tobytes()


def bit_rate(similarity: float, few: bool = False) -> float:
    """The share of bits in which fingerprints of two texts of that similarity differ; a quarter more for texts of few shingles, where ties are common."""
    return acos(2 * similarity / (1 + similarity)) / pi * (1.25 if few else 1.0)


def most_bits(bits: int, similarity: float, few: bool = False) -> int:
    """Differing bits, of so many, that texts of the similarity stay under: four standard deviations over the mean."""
    p = bit_rate(similarity, few)
    return floor(bits * p + 4 * sqrt(bits * p * (1 - p)))


def least_shared(places: int, similarity: float, few: bool = False) -> int:
    """Equal bytes, of so many positions, that texts of the similarity reach: four standard deviations under the mean."""
    q = (1 - bit_rate(similarity, few)) ** 8
    return max(1, ceil(places * q - 4 * sqrt(places * q * (1 - q))))


def postings(ids: np.ndarray, sizes: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed, id) of every list of every text: 8 bits of list, 24 of its bytes, then what goes with it, 24 further bits and 7 of size."""
    k = np.arange(KEYED)
    key = k.astype(np.int64) << 24
    out = np.tile(key, (len(ids), 1))
    for place, at in enumerate(RING):
        out |= prints[:, (k + at) % KEYED].astype(np.int64) << (16 - 8 * place)
    more = np.zeros(len(ids), np.int64)
    for at in range(KEYED, KEYED + 3):
        more = more << 8 | prints[:, at]
    level = np.minimum(127, np.floor(np.log(np.maximum(sizes, 1)) / np.log(1.1))).astype(np.int64)
    return (out << 31 | (more << 7 | level)[:, None]).ravel(), np.repeat(ids, KEYED)


def may_be(one: np.ndarray, other: np.ndarray, similarity: float) -> np.ndarray:
    """Whether what goes with two postings, sizes and further bits, allows the similarity."""
    levels = ceil(np.log(1 / similarity) / np.log(1.1))
    bits = np.bitwise_count((one ^ other) >> 7)
    return (np.abs((one & 127) - (other & 127)) <= levels) & (bits <= most_bits(24, similarity, True))


def _live(similarity: float):
    """Of postings in order (packed, id) those rows (key, id) that have a row in their list which they may be that similar to. Lists of over BLOCK rows stay whole."""

    def run(packed: np.ndarray) -> np.ndarray:
        """Which rows of whole lists, one behind the other."""
        key = packed >> 31
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(starts, len(key)))
        good = np.repeat(size > BLOCK, size)
        for n in np.unique(size[(size > 1) & (size <= BLOCK)]):
            rows = starts[size == n][:, None] + np.arange(n)
            for part in np.array_split(rows, 1 + (rows.size * n >> 18)):  # a quarter of a million pairs at a time
                more = packed[part] & 0x7FFFFFFF
                near = may_be(more[:, :, None], more[:, None, :], similarity)
                good[part] = near.sum(axis=2) > 1  # besides itself
        return good

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_p, held_i = np.empty(0, np.int64), np.empty(0, np.int64)  # a list that may go on

        def whole(p: np.ndarray, i: np.ndarray) -> Iterator[pa.RecordBatch]:
            good = run(p)
            if good.any():
                yield pa.RecordBatch.from_arrays([pa.array(p[good] >> 31), pa.array(i[good])], ["key", "id"])

        for b in batches:
            p, i = (np.concatenate([held, b.column(k).to_numpy(zero_copy_only=False)]) for k, held in ((0, held_p), (1, held_i)))
            if not len(p):
                continue
            end = int(np.searchsorted(p >> 31, p[-1] >> 31))
            held_p, held_i = p[end:], i[end:]
            if end:
                yield from whole(p[:end], i[:end])
        if len(held_p):
            yield from whole(held_p, held_i)

    return each


def retained(prints: np.ndarray, sizes: np.ndarray, other: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pairs i < j of rows of one list that ``other`` (a matrix) asks for and whose fingerprints share as many positional bytes, and differ in no more bits, than those of texts of that
    similarity do; their differing bits, and the first list that both are in."""
    n = len(prints)
    shared = np.array([least_shared(KEYED, similarity, few) for few in (False, True)])
    most = np.array([most_bits(WIDE * 8, similarity, few) for few in (False, True)])
    if n <= 64:
        i, j = np.nonzero(np.triu(other, 1))
        tally = (prints[i, :KEYED] == prints[j, :KEYED]).sum(axis=1)
    else:
        counts = np.zeros((n, n), np.uint8)
        for k in range(KEYED):
            counts += prints[:, k, None] == prints[None, :, k]
        i, j = np.nonzero(np.triu(other & (counts >= shared.min()), 1))
        tally = counts[i, j]
    few = (np.minimum(sizes[i], sizes[j]) < FEW).astype(int)
    kept = tally >= shared[few]
    i, j, few = i[kept], j[kept], few[kept]
    out = []
    for at in range(0, max(1, len(i)), 8192):
        x, y = prints[i[at : at + 8192]], prints[j[at : at + 8192]]
        bits = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        equal = x[:, :KEYED] == y[:, :KEYED]
        first = np.logical_and.reduce([np.roll(equal, -k, axis=1) for k in RING]).argmax(axis=1)
        out.append((bits, first))
    bits, first = (np.concatenate(x) for x in zip(*out))
    good = bits <= most[few]
    return i[good], j[good], bits[good], first[good]


def proposed(live: DataFrame, tied: DataFrame | None, nodes: DataFrame, similarity: float, partners: int | None) -> DataFrame:
    """Pairs (a, b) of ids of one list (rows key, id) that are retained and that ``tied`` doesn't hold together: each text's closest ``partners``, or all.

    Lists are dealt in pairs of blocks of BLOCK rows, and lists that are tied together already aren't dealt at all. Pairs are made inside a task; where a number of partners is told, at
    most so many for each text leave it.
    """
    parted = live.withColumn("c", F.col("id"))
    if tied is not None:
        parted = live.join(tied.select(F.col("node").alias("id"), "component"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    lists = parted.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("rows")).where("low <> high")
    dealt = (
        parted.join(lists.select("key", F.ceil(F.col("rows") / BLOCK).cast("int").alias("g")), "key")
        .join(nodes.select("id", "n", "fp"), "id")
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col("g")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        .groupBy("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
        .agg(F.collect_list(F.struct("id", "c", "own", "n", "fp")).alias("rows"))
        .where(F.size("rows") > 1)
        .select(F.expr("lo <> hi").alias("two"), F.shiftright("key", 24).alias("k"), *[F.col("rows")[k].alias(k) for k in ("id", "c", "own", "n", "fp")])
    )

    def closest(a: np.ndarray, b: np.ndarray, bits: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
        """Of each a the ``most`` rows of least bits, each b once."""
        order = np.lexsort((b, bits, a))
        a, b, bits = a[order], b[order], bits[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])  # equal pairs have equal bits
        a, b, bits = a[new], b[new], bits[new]
        start = np.flatnonzero(np.diff(a, prepend=a[:1] - 1))
        kept = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a)))) < most
        return a[kept], b[kept], bits[kept]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.empty(0, np.int64)] * 3
        for b in batches:
            ends = np.concatenate([[0], np.cumsum(np.asarray(b.column("id").value_lengths()))]).astype(int)
            ids, c, own, n = (b.column(k).flatten().to_numpy() for k in ("id", "c", "own", "n"))
            prints = np.frombuffer(b"".join(b.column("fp").flatten().to_pylist()), np.uint8).reshape(-1, WIDE)
            out = [[np.empty(0, np.int64)] * 3]
            for two, k, s, e in zip(b.column("two").to_pylist(), b.column("k").to_pylist(), ends, ends[1:]):
                other = c[s:e, None] != c[None, s:e]
                if two:  # pairs within a block are made where it meets itself
                    other &= own[s:e, None] != own[None, s:e]
                i, j, bits, first = retained(prints[s:e], n[s:e], other, similarity)
                if partners:
                    i, j, bits = closest(np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([bits, bits]), 1)
                else:  # a pair leaves the first of its lists
                    i, j, bits = i[first == k], j[first == k], bits[first == k]
                out.append([ids[s + i], ids[s + j], bits])
            found = [np.concatenate(x) for x in zip(*out)]
            if partners:
                best = closest(*(np.concatenate(x) for x in zip(best, found)), partners)
            else:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["a", "b", "bits"])
        if len(best[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], ["a", "b", "bits"])

    found = dealt.mapInArrow(pairs, "a long, b long, bits long")
    if partners:
        best = found.groupBy("a").agg(F.slice(F.sort_array(F.collect_set(F.struct("bits", "b"))), 1, partners).alias("best"))  # a row has few more candidates than lists
        found = best.select("a", F.explode("best.b").alias("b"))
        return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return found.select("a", "b")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two arrays of distinct hashes; of two empty ones 1."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    total = len(a) + len(b) - shared
    return shared / total if total else 1.0


def in_cells(pairs: DataFrame, contents, test) -> DataFrame:
    """The pairs (a, b) of ids that ``test`` finds good, by what ``contents`` of each id there is.

    Pairs are laid out in cells, by groups of both ids, so many that a cell has about CELL pairs. ``contents`` is given (id, cells), the cells of each id that
    has pairs, and returns rows (id, cells, s) with a binary s, which moves to each of these cells once, however many pairs it has there. ``test`` is given
    two arrays of positions of a cell's pairs and its list of contents, and returns which are good.
    """
    pairs = cut(pairs)
    sides = max(1, ceil(sqrt(pairs.count() / CELL)))
    cell = lambda a, b: F.pmod(F.xxhash64(a), F.lit(sides)) * sides + F.pmod(F.xxhash64(b, F.lit(1)), F.lit(sides))
    laid = pairs.select("a", "b", cell("a", "b").alias("cell"))
    places = laid.select("cell", F.explode(F.array("a", "b")).alias("id")).distinct()
    needed = places.groupBy("id").agg(F.collect_list("cell").alias("cells"))  # no more than an id's pairs, nor than two rows of cells
    held = contents(needed).select(F.explode("cells").alias("cell"), "id", "s")

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        a, b = left.column("a").to_numpy(), left.column("b").to_numpy()
        good = np.zeros(len(a), bool)
        if len(ids):
            at = [order[np.minimum(np.searchsorted(ids[order], x), len(ids) - 1)] for x in (a, b)]
            known = np.flatnonzero((ids[at[0]] == a) & (ids[at[1]] == b))
            good[known] = test(at[0][known], at[1][known], right.column("s").to_pylist())
        return pa.table([a[good], b[good]], names=["a", "b"])

    return laid.groupBy("cell").cogroup(held.groupBy("cell")).applyInArrow(check, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of ids whose texts (id, t) have at least that Jaccard similarity of distinct shingles. Texts without pairs don't move."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            made = pa.array([np.unique(shingle_hashes(t or b"", width)).tobytes() for t in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), made, b.column(2)], ["id", "s", "cells"])

    def shingles(needed: DataFrame) -> DataFrame:
        maybe = marked(texts, "id", needed.select("id"), "needed").where("needed").drop("needed")
        return maybe.join(needed, "id").select("id", "t", "cells").mapInArrow(sets, "id long, s binary, cells array<long>")

    def alike(i: np.ndarray, j: np.ndarray, held: list[bytes]) -> list[bool]:
        known = [np.frombuffer(s, np.uint64) for s in held]
        return [jaccard(known[x], known[y]) >= similarity - 1e-9 for x, y in zip(i, j)]

    return cut(in_cells(pairs, shingles, alike))


def similar_links(nodes: DataFrame, texts: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Edges (a, b) between ids that connect those whose texts have at least that similarity, and none below it.

    ``nodes`` are rows (id, n, fp) of distinct ids, ``texts`` rows (id, t). The index has KEYED lists of a text, each by three positional bytes. Two texts of similarity 0.8 meet in five
    lists in the mean and in none in 1.4 of 100 cases; of 0.85 in nine, and in none in 4 of 10,000 (README). In a list the positional bytes that two
    texts share are tallied, and pairs with as many as such texts have are retained. First each text's links to the closest of them, out of some of the lists, are verified, which ties crowds of
    copies by a linear number of pairs; then all pairs that are retained and still apart are. To verify means the exact Jaccard of the distinct shingles.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            prints = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, WIDE)
            packed, ids = postings(b.column(0).to_numpy(), b.column(1).to_numpy(), prints)
            yield pa.RecordBatch.from_arrays([pa.array(packed), pa.array(ids)], ["packed", "id"])

    index = nodes.select("id", "n", "fp").mapInArrow(keys, "packed long, id long")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = index.repartition(parts, F.shiftright("packed", 31)).sortWithinPartitions("packed")
    live = cut(lists.mapInArrow(_live(similarity), "key long, id long"))
    links, tied = None, None
    for k in range(ROUNDS):
        some = live.where(F.shiftright("key", 24) % FIRST == k)
        found = verified(proposed(some, tied, nodes, similarity, PARTNERS), texts, width, similarity)
        links = found if links is None else links.union(found)
        tied = cut(connected_components(links))
    return links.union(verified(proposed(live, tied, nodes, similarity, None), texts, width, similarity))


def _with_digests(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, t) with the digest of the text's set of shingles."""
    for b in _slices(batches):
        digest = [xxhash.xxh3_128_digest(np.unique(shingle_hashes(t or b"", width)).tobytes()) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digest, pa.binary())], ["id", "t", "digest"])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group of texts that links of at least ``similarity`` tie, the row of its smallest doc_id.

    The similarity is the exact Jaccard of the distinct word shingles of whole texts. A row that repeats with the same text stays once; rows of
    one doc_id with different texts stay if one of them does. Null and empty texts are copies of each other. Rows with a null doc_id
    can't be told apart by it: they stay, and remove none. Ids must be whole numbers. Columns come back as they were, whatever they are called; an empty table stays
    empty. Rows that surely stay aren't moved; what moves are postings, and the texts of pairs that are verified and of rows that may go.
    """
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} must hold whole numbers")
    known = docs.where(F.col(id_col).isNotNull())
    texts = known.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            sets = [np.unique(shingle_hashes(t or b"", width)) for t in b.column(1).to_pylist()]
            digest = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            n, fp = pa.array([len(s) for s in sets], pa.int32()), pa.array([wide_fingerprint(s) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), digest, n, fp], ["id", "digest", "n", "fp"])

    schema = "id long, digest binary, n int, fp binary"
    rows = cut(texts.mapInArrow(each, schema))
    # Of equal sets of shingles one is a node.
    nodes = cut(rows.groupBy("digest").agg(F.min(F.struct("id", "n", "fp")).alias("r")).select("digest", F.col("r.id").alias("doc"), "r.*"))
    again = nodes.groupBy("doc").agg(F.count("*").alias("times")).where("times > 1").select("doc")
    if again.take(1):  # an id that has several texts names none of them: their nodes get numbers out of their digests, under those of any document
        number = (-F.pmod(F.xxhash64("digest"), F.lit(1 << 61)) - (1 << 61)).alias("id")
        several = nodes.join(again, "doc", "left_semi")
        ids = again.withColumnRenamed("doc", "id")
        # Their texts are told apart by their digests, which are taken again for these alone.
        theirs = texts.join(ids, "id", "left_semi").mapInArrow(lambda batches: _with_digests(batches, width), "id long, t binary, digest binary")
        texts = texts.join(ids, "id", "left_anti").unionByName(theirs.select(number, "t").dropDuplicates(["id"]))
        nodes = cut(nodes.join(again, "doc", "left_anti").select("doc", "id", "n", "fp").unionByName(several.select("doc", number, "n", "fp")))
    tied = cut(connected_components(similar_links(nodes.select("id", "n", "fp"), texts, width, similarity)))
    # Of each group the smallest doc_id stays.
    grouped = nodes.join(tied.select(F.col("node").alias("id"), "component"), "id").groupBy("component").agg(F.min("doc").alias("id")).select("id")
    alone = nodes.join(tied.select(F.col("node").alias("id")), "id", "left_anti").select(F.col("doc").alias("id"))
    heads = grouped.union(alone).distinct().withColumn("stays", F.lit(True))
    # Rows of ids that go, or that repeat, are judged; all others stay where they are.
    judged = cut(rows.groupBy("id").agg(F.count("*").alias("rows")).join(heads, "id", "left").where("stays is null or rows > 1").select("id", F.coalesce("stays", F.lit(False)).alias("stays")))
    out = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"))
    out = marked(out, "id", judged.select("id"), "maybe")
    named = out.where("maybe").join(judged, "id", "left")
    once = named.where("stays").withColumn("t", F.sha2(F.coalesce(F.col("row")[text_col].cast("string"), F.lit("")), 256)).withColumn("none", F.col("row")[text_col].isNull())
    once = once.dropDuplicates(["id", "t", "none"]).select("row.*")
    return out.where("not maybe").select("row.*").union(named.where("stays is null").select("row.*")).union(once)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
