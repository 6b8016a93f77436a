"""Encoding and decoding with a SentencePiece vocabulary: best segmentation by summed scores, giant documents by a max-plus scan over chunks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from landloom.session import cut, free_name, read

#: Texts of more characters are cut into chunks.
GIANT, CHUNK = 1 << 16, 1 << 15
NONE = -(1 << 60)
#: Steps of a score of 1, where scores are no whole numbers.
SCALE = 1 << 24
NAMES = ["doc_id", "n_chars", "ids", "round_trip"]
#: Of the rolling hash of a piece's characters.
STEP, MIX, MASK = 0x100000001B3, 0x9E3779B97F4A7C15, (1 << 64) - 1
#: Words whose pieces a task holds between batches, and the longest words that are segmented many at a time.
CACHE, SHORT = 250_000, 40


@dataclass
class Vocabulary:
    """Pieces by their text (a word's start written as a space), with their ids and whole-number scores; other characters fall back to byte pieces."""

    pieces: dict[str, tuple[int, int]]
    starts: set[str]
    texts: list[str]  # by id; of byte pieces and control pieces empty
    first_byte: int
    unknown: int
    longest: int
    cache: dict[str, bytes] = field(default_factory=dict)
    scores: dict[str, int] = field(default_factory=dict)
    tables: tuple[np.ndarray, ...] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}, "scores": {}, "tables": None}

    def _hashed(self) -> tuple:
        """Of pieces and their beginnings (row 0: of nothing else) the hash, score and id, and where a hash's row is: a table, and one for those whose place there is taken."""
        if self.tables is None:
            plain = [chr(b) for b in range(128) if chr(b) not in self.pieces]  # characters that are byte pieces
            known = [*self.pieces, *plain, *sorted(self.starts - self.pieces.keys() - set(plain))]
            hashes, scores, ids = np.zeros(len(known) + 1, np.uint64), np.full(len(known) + 1, NONE, np.int64), np.full(len(known) + 1, -1, np.int32)
            for row, text in enumerate(known, 1):
                h = 0
                for c in text:
                    h = (h * STEP + ord(c)) & MASK
                hashes[row] = h
                if row <= len(self.pieces):
                    ids[row], scores[row] = self.pieces[text]
                elif row <= len(self.pieces) + len(plain):
                    ids[row], scores[row] = self.first_byte + ord(text), self.unknown
            for mix in (np.uint64(m) for m in range(MIX, MIX + 2000, 2)):  # the first multiplier under which two places are enough
                first, second = np.zeros(1 << 20, np.int32), np.zeros(1 << 20, np.int32)
                mixed = hashes * mix
                places, rows = np.unique(mixed[1:] >> np.uint64(44), return_index=True)
                first[places] = rows + 1
                rest = np.setdiff1d(np.arange(1, len(hashes)), rows + 1)
                spare = (mixed[rest] >> np.uint64(20)) & np.uint64(0xFFFFF)
                if len(np.unique(spare)) == len(spare):
                    second[spare] = rest
                    break
            else:
                raise ValueError("no multiplier separates the pieces")
            self.tables = hashes, scores, ids, first, second, mix
        return self.tables

    def learn(self, words: set[str]) -> None:
        """Hold the segmentations of words (without their space), those of about one length at a time: every length of piece at every place at once."""
        if len(self.cache) > CACHE:
            self.cache.clear()
            self.scores.clear()
        new = sorted((w for w in words if w not in self.cache and len(w) < SHORT), key=len)
        hashes, scores, ids, first, second, mix = self._hashed()
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            size = np.array([len(w) + 1 for w in part])
            wide = int(size.max())
            points = np.frombuffer("".join([f" {w}".ljust(wide, "\0") for w in part]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), wide).T.astype(np.uint64)
            best = np.full((wide + 1, len(part)), NONE, np.int64)
            back, piece = np.zeros((wide + 1, len(part)), np.int16), np.full((wide + 1, len(part)), -1, np.int32)
            best[0] = 0
            for s in range(wide):
                on = np.flatnonzero(size > s)  # words in which a piece may go on from s
                h = np.zeros(len(on), np.uint64)
                for e in range(s + 1, min(s + self.longest, wide) + 1):
                    h = h * np.uint64(STEP) + points[e - 1][on]
                    mixed = h * mix
                    row = first[mixed >> np.uint64(44)]
                    wrong = np.flatnonzero((row > 0) & (hashes[row] != h))
                    if len(wrong):
                        other = second[(mixed[wrong] >> np.uint64(20)) & np.uint64(0xFFFFF)]
                        row[wrong] = np.where(hashes[other] == h[wrong], other, 0)
                    score, i = scores[row], ids[row]
                    if e == s + 1:
                        to, score = on, np.where(i >= 0, score, self.unknown)
                    else:
                        whole = np.flatnonzero(i >= 0)
                        to, score, i = on[whole], score[whole], i[whole]
                    score = score + best[s][to]
                    better = np.flatnonzero(score > best[e][to])
                    to = to[better]
                    best[e][to], back[e][to], piece[e][to] = score[better], s, i[better]
                    more = np.flatnonzero(row)
                    if not len(more):
                        break
                    on, h = on[more], h[more]
            every = np.arange(len(part))
            end, steps, odd = size.copy(), [], np.zeros(len(part), bool)
            while end.any():
                going = end > 0
                now = np.where(going, piece[end, every], -2)
                odd |= now == -1
                steps.append(now)
                end = np.where(going, back[end, every], 0)
            table = np.stack(steps[::-1]).T
            real = table >= 0
            flat, ends = table[real].astype(np.int32).tobytes(), np.cumsum(real.sum(axis=1) * 4).tolist()
            begin = 0
            for w, score, end, strange in zip(part, best[size, every].tolist(), ends, odd.tolist()):
                if not strange:  # words with other characters that no piece holds are left to word()
                    self.cache[w], self.scores[w] = flat[begin:end], score
                begin = end

    def ids_of(self, text: str, start: int, end: int) -> list[int]:
        known = self.pieces.get(text[start:end])
        return [known[0]] if known else [self.first_byte + b for b in text[start:end].encode()]

    def lattice(self, text: str, start: int, limit: int, entries: dict[int, int]) -> tuple[list[int], list[int]]:
        """Best score and last piece's start (-1: an entry) for each boundary, when pieces begin at an entry or a boundary before ``limit``.

        No piece goes over a word's start. Of equal scores the longest last piece counts, and an entry before any.
        """
        stop = min(len(text), limit + self.longest - 1)
        best, back = [NONE] * (stop + 1), [-1] * (stop + 1)
        for at, score in entries.items():
            if at <= stop:
                best[at] = score
        pieces, starts, unknown = self.pieces, self.starts, self.unknown
        for s in range(start, min(limit, len(text))):
            have = best[s]
            if have <= NONE // 2:
                continue
            alone = False
            for e in range(s + 1, min(s + self.longest, stop) + 1):
                if e - 1 > s and text[e - 1] == " ":
                    break
                part = text[s:e]
                known = pieces.get(part)
                if known:
                    alone |= e == s + 1
                    if have + known[1] > best[e]:
                        best[e], back[e] = have + known[1], s
                elif part not in starts:
                    break
            if not alone and have + unknown > best[s + 1]:
                best[s + 1], back[s + 1] = have + unknown, s
        return best, back

    def word(self, bare: str) -> tuple[int, bytes]:
        """Score and ids, as bytes of int32, of a word with a space before it."""
        if bare not in self.cache:
            word = f" {bare}"
            best, back = self.lattice(word, 0, len(word), {0: 0})
            ids, e = [], len(word)
            while e > 0:
                ids.append(self.ids_of(word, back[e], e))
                e = back[e]
            self.cache[bare], self.scores[bare] = np.fromiter(chain.from_iterable(reversed(ids)), np.int32).tobytes(), best[len(word)]
        return self.scores[bare], self.cache[bare]

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text, before which a space is put as SentencePiece does."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        split = [t.split(" ") if t else [] for t in texts]
        words = set(chain.from_iterable(split))
        self.learn(words)
        for w in words:
            if w not in self.cache:
                self.word(w)
        ids = self.cache.__getitem__
        return [np.frombuffer(b"".join(map(ids, ws)), np.int32) for ws in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids. A byte piece of ASCII is a character; runs of other byte pieces are put together as UTF-8."""
        texts, high = self.texts, self.first_byte + 128
        if not ((ids >= high) & (ids < high + 128)).any():
            return "".join(map(texts.__getitem__, ids.tolist()))[1:]
        return b"".join([bytes([i - high + 128]) if high <= i < high + 128 else texts[i].encode() for i in ids.tolist()])[1:].decode("utf-8", "replace")

    # --- chunks of a giant text ---------------------------------------------------------------------------------------
    #
    # Chunk k holds the characters from k * CHUNK, and those that a last piece may reach into the next chunk. Its states are the places of the first
    # boundary at or behind its start, and at or behind its end. ``size`` is the chunk's own length.

    def _parts(self, text: str, size: int) -> tuple[int, int]:
        """Where the first word that starts behind all entries starts, and the last word; equal if there is one start, or none (-1)."""
        first = text.find(" ", self.longest, size)
        return (first, text.rfind(" ", first, size)) if first >= 0 else (-1, -1)

    def transfer(self, text: str, size: int, last: bool) -> np.ndarray:
        """matrix[i, j]: best score from a first boundary at i to one at size + j; no such way: NONE. The last chunk ends at its size."""
        m = self.longest
        out = np.full((m, m), NONE, np.int64)
        first, end = self._parts(text, size)
        self.learn(set(text[first + 1 : end].split(" ")) if end > first >= 0 else set())
        ends = [0] if last else range(min(m, len(text) - size + 1))
        if first < 0:
            for i in range(min(m, size + 1)):
                best, _ = self.lattice(text, i, size, {i: 0})
                for j in ends:
                    out[i, j] = best[size + j] if size + j < len(best) else NONE
            return out
        middle = sum(self.word(w)[0] for w in text[first + 1 : end].split(" ")) if end > first else 0
        tail, _ = self.lattice(text, end, size, {end: 0})
        for i in range(m):
            head, _ = self.lattice(text[:first], i, first, {i: 0})
            if head[first] > NONE // 2:
                for j in ends:
                    if size + j < len(tail) and tail[size + j] > NONE // 2:
                        out[i, j] = head[first] + middle + tail[size + j]
        return out

    def trace(self, text: str, size: int, last: bool, entries: dict[int, int]) -> tuple[list[int], list[list[int]], list[int]]:
        """Ids that the ways to all last boundaries share, each way's own ids behind these, and the way's entry. Entries come with their scores so far."""
        first, end = self._parts(text, size)
        self.learn(set(text[first + 1 : end].split(" ")) if end > first >= 0 else set())
        ends = [0] if last else range(self.longest)

        def back_from(part: str, e: int, back: list[int]) -> tuple[list[int], int]:
            ids = []
            while back[e] >= 0:
                ids.append(self.ids_of(part, back[e], e))
                e = back[e]
            return list(chain.from_iterable(reversed(ids))), e

        if first < 0:
            best, back = self.lattice(text, 0, size, entries)
            ways = [back_from(text, size + j, back) if size + j < len(best) and best[size + j] > NONE // 2 else ([], -1) for j in ends]
            return [], [w for w, _ in ways], [e for _, e in ways]
        _, back = self.lattice(text[:first], 0, first, entries)
        shared, entry = back_from(text[:first], first, back)
        if end > first:
            shared += np.frombuffer(b"".join(self.word(w)[1] for w in text[first + 1 : end].split(" ")), np.int32).tolist()
        best, back = self.lattice(text, end, size, {end: 0})
        ways = [back_from(text, size + j, back)[0] if size + j < len(best) and best[size + j] > NONE // 2 else [] for j in ends]
        return shared, ways, [entry] * len(ways)


def _fields(blob: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message: whole numbers, and bytes of the rest."""
    at = 0

    def varint() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            byte = blob[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(blob):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if tag & 7 == 2 else 8 if tag & 7 == 1 else 4
            yield tag >> 3, blob[at : at + size]
            at += size


def model_kind(blob: bytes) -> tuple[str, str]:
    """The kind of a SentencePiece model and the name of its normaliser."""
    parts = {n: v for n, v in _fields(blob) if n in (2, 3)}
    kind = dict(_fields(parts.get(2, b""))).get(3, 1)
    return {1: "unigram", 2: "bpe", 3: "word", 4: "char"}.get(kind, "other"), bytes(dict(_fields(parts.get(3, b""))).get(1, b"")).decode()


def whole_scores(scores: list[float]) -> list[int]:
    """Scores as whole numbers, so that sums are exact: as they are if they are whole (ranks), else in steps of 2 ** -24, in which logarithms of 32 bits
    and at least a half in size are whole."""
    if all(s == round(s) for s in scores):
        return [round(s) for s in scores]
    return [round(s * SCALE) for s in scores]


def load(path: str, as_unigram: bool = False) -> Vocabulary:
    """The vocabulary of a SentencePiece model file that the driver can open; pieces that the model never uses (runs of spaces) are left out.

    The segmentation with the greatest sum of scores is what a unigram model encodes. A file of another kind is refused, unless it is to be taken
    ``as_unigram``: then its pieces and scores are, and ids aren't those of its own merges. Texts aren't normalised, whatever
    normaliser the file names, so that decoding gives them back.
    """
    import sentencepiece

    with open(path, "rb") as f:
        kind, _ = model_kind(f.read())
    if kind != "unigram" and not as_unigram:
        raise ValueError(f"{path} is a {kind} model; only a unigram model's encoding is the segmentation with the greatest sum")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
    texts = ["" if special[i] else model.id_to_piece(i).replace("▁", " ") for i in range(n)]
    used = [i for i, t in enumerate(texts) if t and " " not in t[1:]]
    first_byte = next((i for i in range(n) if model.is_byte(i)), n)  # a model without byte pieces gets their ids behind its own
    return vocabulary({texts[i]: i for i in used}, [model.get_score(i) for i in used], texts, first_byte)


def vocabulary(ids: dict[str, int], scores: list[float], texts: list[str], first_byte: int) -> Vocabulary:
    """Of pieces with their ids and scores, in that order, and the text of each id."""
    exact = whole_scores(scores)
    real = [s for s, given in zip(exact, scores) if given > -(10**8)]
    least = min(real, default=0) - 10 * (1 if exact == [round(s) for s in scores] else SCALE)
    pieces = {t: (i, max(s, least)) for (t, i), s in zip(ids.items(), exact)}  # the bare word mark has no score of its own
    starts = {t[:k] for t in pieces for k in range(1, len(t))}
    texts = [*texts, *[""] * (first_byte + 256 - len(texts))]
    texts[first_byte : first_byte + 128] = map(chr, range(128))
    return Vocabulary(pieces, starts, texts, first_byte, least, max(map(len, pieces), default=1))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of transfer matrices, which is associative: ways through a, then b."""
    return np.maximum((a[..., :, :, None] + b[..., None, :, :]).max(axis=-2), NONE)


def scan(matrices: np.ndarray) -> np.ndarray:
    """All prefix products of a chain of matrices, in as many rounds as its length has binary digits."""
    out, step = matrices.copy(), 1
    while step < len(out):
        out[step:] = combine(out[:-step], out[step:])
        step *= 2
    return out


def _checked(v: Vocabulary, texts: list[str | None], ids: list[np.ndarray | None]) -> list[bool | None]:
    return [None if t is None else v.decode(i) == t for t, i in zip(texts, ids)]


def _ordinary(rows: DataFrame, held: Broadcast) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        for b in batches:
            for at in range(0, b.num_rows, 250):
                part = b.slice(at, 250)
                texts = part.column(1).to_pylist()
                ids = [None if t is None else i for t, i in zip(texts, v.encode_all([t or "" for t in texts]))]
                size = pa.array([None if t is None else len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(ids, pa.list_(pa.int32())), pa.array(_checked(v, texts, ids), pa.bool_())], NAMES)

    return rows.mapInArrow(each, _schema(rows))


def _schema(rows: DataFrame) -> str:
    return f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_chars long, ids array<int>, round_trip boolean"


def _giants(rows: DataFrame, held: Broadcast, longest: int) -> DataFrame:
    """Each giant's chunks give transfer matrices; their scan gives each chunk's entry scores; each chunk then traces its ways back by itself."""
    texts = cut(rows.withColumn("uid", F.monotonically_increasing_id()))
    size = F.length("s")
    spaced = texts.withColumn("s", F.concat(F.lit(" "), "t")).withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((size - 1) / CHUNK).cast("int"))))
    from_k = F.col("k") * CHUNK
    chunks = spaced.select("uid", "k", F.substring(F.col("s"), from_k + 1, F.lit(CHUNK + longest - 1)).alias("part"), F.least(F.lit(CHUNK), size - from_k).alias("size"), (from_k + CHUNK >= size).alias("last"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = chunks.repartition(parts, "uid", "k")

    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        for b in batches:
            m = [v.transfer(t, n, last).tobytes() for t, n, last in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(m, pa.binary())], ["uid", "k", "m"])

    def entries(doc: pd.DataFrame) -> pd.DataFrame:
        doc = doc.sort_values("k")
        m = np.stack([np.frombuffer(x, np.int64).reshape(longest, longest) for x in doc["m"]])
        before = scan(m)[:, 0, :]  # the text begins with a boundary, state 0
        scores = [[0] + [NONE] * (longest - 1), *before[:-1].tolist()]
        return pd.DataFrame({"uid": doc["uid"], "k": doc["k"], "scores": scores})

    entered = chunks.mapInArrow(transfers, "uid long, k int, m binary").groupBy("uid").applyInPandas(entries, "uid long, k int, scores array<long>")

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        for b in batches:
            out = []
            for uid, k, t, n, last, scores in zip(*(b.column(i).to_pylist() for i in range(6))):
                shared, ways, entry = v.trace(t, n, last, {i: s for i, s in enumerate(scores) if s > NONE // 2})
                out.append({"uid": uid, "k": k, "shared": shared, "ways": ways, "entry": entry})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("uid", pa.int64()), ("k", pa.int32()), ("shared", pa.list_(pa.int32())), ("ways", pa.list_(pa.list_(pa.int32()))), ("entry", pa.list_(pa.int32()))]))

    joined = chunks.join(entered, ["uid", "k"]).select("uid", "k", "part", "size", "last", "scores")
    ways = joined.mapInArrow(traced, "uid long, k int, shared array<int>, ways array<array<int>>, entry array<int>")

    def assemble(doc: pd.DataFrame) -> pd.DataFrame:
        doc = doc.sort_values("k", ascending=False)
        out, state = [], 0
        for shared, way, entry in zip(doc["shared"], doc["ways"], doc["entry"]):
            out += [np.asarray(way[state], np.int32), np.asarray(shared, np.int32)]
            state = entry[state]
        return pd.DataFrame({"uid": [doc["uid"].iloc[0]], "ids": [np.concatenate(out[::-1])]})

    encoded = ways.groupBy("uid").applyInPandas(assemble, "uid long, ids array<int>")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        for b in batches:
            for at in range(b.num_rows):
                part = b.slice(at, 1)
                t, ids = part.column(1)[0].as_py(), part.column(2)[0].values.to_numpy()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t)], pa.int64()), part.column(2), pa.array(_checked(v, [t], [ids]), pa.bool_())], NAMES)

    return texts.join(encoded, "uid").select("doc_id", "t", "ids").mapInArrow(compared, _schema(rows))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", as_unigram: bool = False) -> DataFrame:
    """(doc_id, n_chars, ids, round_trip) of every row: the ids of its whole text's segmentation with the greatest sum of piece scores, and whether they decode to it.

    Of equal sums the one with the longest pieces from the right. Characters that no piece holds, which include the word mark itself, become
    byte pieces, so decoding gives the text back exactly. Null texts have null ids and empty ones none; ids may be null and rows may repeat; other
    columns are ignored. Texts of over 65536 characters are cut into chunks of 32768 that are encoded apart from each other,
    with the same result. Only one document's matrices, 2 KB a chunk, and its finished ids meet in a task.
    """
    v = load(model_path, as_unigram)
    held = docs.sparkSession.sparkContext.broadcast(v)  # the vocabulary
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    giant = F.coalesce(F.length("t") > GIANT, F.lit(False))
    return _ordinary(rows.where(~giant), held).unionByName(_giants(rows.where(giant), held, v.longest))


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with a last column of the text of each array of ids; of null null, of none empty. Where a column is called like ``out`` already, the new one's
    name has underscores in front. Rows, repeats and other columns stay; an empty table stays empty. Any kind of model decodes."""
    out = free_name(rows, out)
    held = rows.sparkSession.sparkContext.broadcast(load(model_path, as_unigram=True))

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        v = held.value
        return ids.map(lambda x: None if x is None else v.decode(np.asarray(x)))

    return rows.withColumn(out, text(F.col(ids_col)))


def model_path(spark: SparkSession) -> str:
    return spark.conf.get("landloom.pieces.model", "/opt/tokenizers/piece_bpe_32k.model")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, and whether they decode to its text. The public file is a BPE model's; its pieces and ranks are taken as a unigram vocabulary."""
    found = encode(read(spark, sf_dir, "documents"), model_path(spark), as_unigram=True)
    return found.select("doc_id", "n_chars", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")
