"""Cross-tokenizer alignment: tokens of two vocabularies that end together, counted over the corpus in dense vectors by a minimal perfect hash."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from landloom.session import cut, read, scratch_path

BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
# Fixed value: how byte-level vocabularies of this kind split a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Keys that a task gathers before it counts them; counts of a vector's slice; vectors that are summed at once.
HELD, SLICE, FAN = 1 << 21, 1 << 16, 16


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a letter: printable ones as themselves, the others, in order, as those from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class ByteBpe:
    """A byte-level BPE vocabulary (a tokenizers file). Its texts are encoded behind a space, special tokens' strings as plain text."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.content = f.read()
        spec = json.loads(self.content)
        letters, special = _byte_letters(), {t["id"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        self.bytes = [b""] * (1 + max(vocab.values(), default=-1))
        for token, i in vocab.items():
            self.bytes[i] = b"" if i in special else bytes(letters[c] for c in token)
        joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["model"]["merges"]]
        before = spec.get("pre_tokenizer") or {}
        #: Merges in the order of ids over bytes, no normalising: ranks say all, and the quicker library gives the same ids.
        self.ranked = (
            spec.get("normalizer") is None and before.get("type") == "ByteLevel" and bool(before.get("use_regex")) and not before.get("add_prefix_space")
            and not spec["model"].get("dropout") and not spec["model"].get("ignore_merges") and [vocab[t] for t in joined] == list(range(256, 256 + len(joined)))
        )

    def given(self, text: str) -> str:
        return f" {text}"

    def encode(self, texts: list[str]) -> list[list[int]]:
        return _byte_encoder(self.content, tuple(self.bytes) if self.ranked else None)([self.given(t) for t in texts])


@lru_cache(2)
def _byte_encoder(content: bytes, ranked: tuple[bytes, ...] | None):
    if ranked:
        import tiktoken

        quick = tiktoken.Encoding("ranked", pat_str=SPLIT, mergeable_ranks={b: i for i, b in enumerate(ranked) if b}, special_tokens={}).encode_ordinary
        return lambda texts: [quick(t) for t in texts]
    from tokenizers import Tokenizer

    whole = Tokenizer.from_buffer(content)
    whole.encode_special_tokens = True
    return lambda texts: [e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """A piece vocabulary with bytes for what it lacks (a sentencepiece file), which puts a space before a text itself."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.content = f.read()
        model = _piece_encoder(self.content)
        self.bytes = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            own = b"" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else bytes([int(piece[1:-1], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()
            self.bytes.append(own)

    def given(self, text: str) -> str:
        return f" {text}"

    def encode(self, texts: list[str]) -> list[list[int]]:
        return _piece_encoder(self.content).encode(texts, num_threads=1)


@lru_cache(2)
def _piece_encoder(content: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=content)


class PerfectHash:
    """n distinct long keys to the numbers 0 to n - 1, without gaps.

    Level by level, the keys that are left are hashed to twice as many places; those alone in their place stay, and a bit marks it. A key's number is the number of bits before its own. Keys are
    kept in the order of their numbers, so that a lookup can verify: keys that aren't among them have the number -1.
    """

    def __init__(self, keys: np.ndarray) -> None:
        rest, self.levels, first = np.unique(keys.astype(np.int64)), [], 0
        n = len(rest)
        while len(rest):
            size = -(-2 * len(rest) // 64) * 64
            at = self._place(rest, len(self.levels), size)
            crowd = np.bincount(at, minlength=size)
            words = np.packbits(crowd == 1, bitorder="little").view(np.uint64)
            before = first + np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype(np.int64)
            self.levels.append((size, words, before[:-1]))
            first, rest = int(before[-1]), rest[crowd[at] > 1]
        self.keys = np.zeros(n, np.int64)
        self.keys[self._number(np.unique(keys.astype(np.int64)))] = np.unique(keys.astype(np.int64))

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        h = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
        return ((h ^ (h >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    def _number(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, words, before) in enumerate(self.levels):
            if not len(left):
                break
            at = self._place(keys[left], level, size)
            word, bit = words[at >> 6], np.uint64(1) << (at & 63).astype(np.uint64)
            there = (word & bit) != 0
            out[left[there]] = (before[at >> 6] + np.bitwise_count(word & (bit - np.uint64(1))))[there]
            left = left[~there]
        return out

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = self._number(keys)
        if len(self.keys):
            out[self.keys[out] != keys] = -1
        return out


class Pair:
    """Two vocabularies, their tokens' lengths and texts."""

    def __init__(self, first, second) -> None:
        self.first, self.second = first, second
        self.kinds = [np.uint16 if len(v.bytes) <= 1 << 16 else np.uint32 for v in (first, second)]
        self.size = [np.array([len(b) for b in v.bytes], np.int64) for v in (first, second)]

    @property
    def shown(self) -> list[np.ndarray]:
        """Each number in decimal with what follows it: a comma, then what ends its side of a group."""
        if not hasattr(self, "_shown"):
            wide = f"S{len(str(max(map(len, self.size)))) + 1}"
            self._shown = [np.array([[f"{i}{end}" for i in range(len(s))] for end in (",", last)], wide) for s, last in zip(self.size, "|;")]
        return self._shown

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Both token sequences of each text; None for texts that are null or empty or that the tokens' bytes don't spell."""
        out: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(texts)
        some = [k for k, t in enumerate(texts) if t]
        ids = [v.encode([texts[k] for k in some]) for v in (self.first, self.second)]
        for k, *both in zip(some, *ids):
            if all(b"".join(map(v.bytes.__getitem__, i)) == v.given(texts[k]).encode() for v, i in zip((self.first, self.second), both)):
                out[k] = np.array(both[0], self.kinds[0]), np.array(both[1], self.kinds[1])
        return out

    def ends(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the tokens of either side that end where one of the other ends; tokens have bytes, so each has one partner."""
        ends_a, ends_b = np.cumsum(self.size[0][a]), np.cumsum(self.size[1][b])
        at = np.searchsorted(ends_b, ends_a)
        there = np.flatnonzero(ends_b[np.minimum(at, len(ends_b) - 1)] == ends_a) if len(b) else np.empty(0, np.int64)
        return there, at[there]

    def keys(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(np.int64) * len(self.size[1]) + b

    def groups(self, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: the tokens between common ends."""
        ends = [np.zeros(len(a), int), np.zeros(len(b), int)]
        ends[0][i] = ends[1][j] = 1
        of_a, of_b = np.searchsorted(i, np.arange(len(a))), np.searchsorted(j, np.arange(len(b)))
        table = self.shown
        out = np.empty(len(a) + len(b), table[0].dtype)
        out[np.arange(len(a)) + np.concatenate([[0], j + 1])[of_a]] = table[0][ends[0], a]
        out[np.arange(len(b)) + (i + 1)[of_b]] = table[1][ends[1], b]
        return out.tobytes().replace(b"\0", b"")[:-1]


def _arrays(batch: pa.RecordBatch, pair: Pair) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    for a, b in zip(batch.column("a"), batch.column("b")):
        yield (np.frombuffer(a.as_buffer(), pair.kinds[0]), np.frombuffer(b.as_buffer(), pair.kinds[1])) if a.is_valid else None


def encoded(docs: DataFrame, pair: Pair, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, a, b): each text's two token sequences, as numbers of two or four bytes; null for texts without tokens. Written to the shared folder once, so that no later pass tokenizes."""
    held = docs.sparkSession.sparkContext.broadcast(pair)  # two vocabulary files

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = np.cumsum([len(t.as_py() or "") for t in whole.column(1)])
            for start, end in _spans(sizes):
                batch = whole.slice(start, end - start)
                found = held.value.encode(batch.column(1).to_pylist())
                sides = [pa.array([f and f[k].tobytes() for f in found], pa.binary()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *sides], ["i", "a", "b"])

    kind = docs.schema[id_col].dataType.simpleString()
    path = scratch_path(docs.sparkSession, "encoded")
    docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(each, f"i {kind}, a binary, b binary").write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def _spans(ends: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Rows that are taken at once, of about ``most`` characters; a longer text is taken alone."""
    start = 0
    for k in range(len(ends)):
        if k + 1 == len(ends) or ends[k + 1] - (ends[start - 1] if start else 0) > most:
            yield start, k + 1
            start = k + 1


def partial_counts(tokens: DataFrame, pair: Pair) -> DataFrame:
    """(key, n): how often each pair of tokens is linked, a row for each task and pair."""
    held = tokens.sparkSession.sparkContext.broadcast(pair)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, waiting, size = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            new, n = np.unique(np.concatenate(waiting), return_counts=True) if waiting else (np.empty(0, np.int64), np.empty(0, np.int64))
            both, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
            total = np.zeros(len(both), np.int64)
            np.add.at(total, at, np.concatenate([counts, n]))
            return both, total

        for batch in batches:
            for x in _arrays(batch, held.value):
                if x:
                    i, j = held.value.ends(*x)
                    waiting.append(held.value.keys(x[0][i], x[1][j]))
                    size += len(i)
                    if size >= HELD:
                        keys, counts = merged()
                        waiting, size = [], 0
        keys, counts = merged()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])

    return tokens.select("a", "b").mapInArrow(each, "key long, n long")


def tree_sum(partial: DataFrame, index: PerfectHash) -> np.ndarray:
    """Sum of the partial counts by number: tasks fill dense vectors, slices of FAN vectors are summed by tasks until there is one of each."""
    held = partial.sparkSession.sparkContext.broadcast(index)
    n = len(index.keys)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for b in batches:
            at = held.value(b.column("key").to_numpy())
            if (at < 0).any():
                raise ValueError("a pair that the hash doesn't hold")
            np.add.at(total, at, b.column("n").to_numpy())
        if total.any():
            node, parts = TaskContext.get().partitionId(), range(0, n, SLICE)
            yield pa.RecordBatch.from_arrays([pa.array([node] * len(parts), pa.int64()), pa.array([p // SLICE for p in parts], pa.int64()), pa.array([total[p : p + SLICE].tobytes() for p in parts], pa.binary())], ["node", "slice", "counts"])

    def summed(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in t.column("counts"))
        return pa.table({"node": t.column("node")[:1], "slice": t.column("slice")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "node long, slice long, counts binary"
    tasks = max(1, partial.rdd.getNumPartitions() // FAN)
    level = cut(partial.coalesce(tasks).mapInArrow(dense, schema))
    while tasks > 1:
        tasks = -(-tasks // FAN)
        level = cut(level.withColumn("node", F.floor(F.col("node") / FAN)).groupBy("node", "slice").applyInArrow(summed, schema))
    out = np.zeros(n, np.int64)
    for slice_, counts in zip(*[level.toArrow().column(c).to_pylist() for c in ("slice", "counts")]):
        part = np.frombuffer(counts, np.int64)
        out[slice_ * SLICE : slice_ * SLICE + len(part)] += part
    return out


class Links:
    """What the corpus links: the hash of its pairs, each pair's count, and of each second token the highest count."""

    def __init__(self, index: PerfectHash, counts: np.ndarray, pair: Pair) -> None:
        self.index, self.counts = index, counts
        self.best = np.zeros(len(pair.size[1]), np.int64)
        np.maximum.at(self.best, index.keys % len(pair.size[1]), counts)


def linked(tokens: DataFrame, pair: Pair) -> Links:
    """Counts of all pairs over the whole corpus.

    What the driver and the broadcasts hold is bounded by the vocabularies, whatever the corpus: two tokens that end together spell the same bytes, so the shorter is a suffix of the longer, and a token of length l has
    at most l suffixes (``most_pairs``).
    """
    partial = cut(partial_counts(tokens, pair))
    index = PerfectHash(partial.select("key").distinct().toArrow().column("key").to_numpy())
    return Links(index, tree_sum(partial, index), pair)


def most_pairs(first, second) -> int:
    """How many pairs of the two vocabularies can ever be linked."""
    a, b = ({}, {})
    for known, v in ((a, first), (b, second)):
        for x in v.bytes:
            known[x] = known.get(x, 0) + bool(x)
    longer = sum(n * b.get(x[k:], 0) for x, n in a.items() for k in range(len(x)))
    return longer + sum(n * a.get(x[k:], 0) for x, n in b.items() for k in range(1, len(x)))


def aligned(docs: DataFrame, first, second, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): its alignment by ``first`` and ``second``.

    Byte offsets at which tokens of both end cut a text into groups; tokens that end together are linked, and a pair of ids counts how often the whole corpus links it. n_best counts links whose pair is the
    most frequent of its second id, ties included, count_sum adds the pairs' counts. groups_sha256 hashes the groups (``Pair.groups``). Texts that are null or empty, or that the tokens' bytes don't spell, have no
    tokens: zeros and ''. There is a row for each row of ``docs``: repeated ids have a row each, repeated texts count each time, null ids stay; an empty table gives none; other columns are ignored, whatever their names.

    Texts are tokenized once, in tasks, and written as token ids. A first pass aligns them and counts pairs for each task; the distinct pairs get numbers by a minimal perfect hash; vectors of
    counts by number are summed in a tree; the second pass aligns again and looks the counts up, each key being verified.
    """
    pair = Pair(first, second)
    tokens = encoded(docs, pair, id_col, text_col)
    held = docs.sparkSession.sparkContext.broadcast((pair, linked(tokens, pair)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, links = held.value
        for batch in batches:
            rows, texts = [], []
            for x in _arrays(batch, pair):
                if not x:
                    rows.append((0,) * 6)
                    texts.append("")
                    continue
                i, j = pair.ends(*x)
                a, b = x[0][i], x[1][j]
                at = links.index(pair.keys(a, b))
                if (at < 0).any():
                    raise ValueError("a pair that the corpus doesn't link")
                n = links.counts[at]
                rows.append((len(x[0]), len(x[1]), len(i), len(i), int((n == links.best[b]).sum()), int(n.sum())))
                texts.append(hashlib.sha256(pair.groups(*x, i, j)).hexdigest())
            numbers = np.array(rows, np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([batch.column("i"), *[pa.array(numbers[:, k]) for k in range(6)], pa.array(texts, pa.string())], ["i", *names, "groups_sha256"])

    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    kind = tokens.schema["i"].dataType.simpleString()
    return tokens.mapInArrow(each, f"i {kind}, {', '.join(f'{c} long' for c in names)}, groups_sha256 string").withColumnRenamed("i", id_col)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(read(spark, sf_dir, "documents"), ByteBpe(BYTE_BPE), Pieces(PIECE_BPE))
