"""Toxicity: a weighted lexicon, matched by Aho-Corasick in texts whose look-alike letters and digits are folded, normalised by length, with phrases that excuse a word."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from landloom.session import cut, free_name, read

# Letters of other scripts that look like Latin ones, characters that aren't seen, and what digits and signs stand for inside words.
LOOK_ALIKE = dict(zip("авекмнорстухіјѕԁԛԝһүαβεικνορτυχ", "abekmhopctyxijsdqwhyabeiknoptux"))
UNSEEN = "­​‌‍⁠﻿"
STANDS_FOR = dict(zip("013456789@$!|+", "oieasgtbgasiit"))
#: Of these signs, which may stand for an l as well as for an i.
ALSO_L = "1!|"

#: Weights of words that are insults anywhere, for corpora that have too few labels to tell; those that the labels speak of get the labels' weights.
KNOWN = {" idiot ": 3.0, " idiots ": 3.0, " moron ": 3.0, " morons ": 3.0, " imbecile ": 3.0, " stupid ": 2.5, " loser ": 2.5, " losers ": 2.5, " scum ": 3.0, " worthless ": 2.0, " pathetic ": 2.0, " disgusting ": 2.0, " trash ": 1.5, " clown ": 1.5, " dumbass ": 3.5, " bastard ": 3.0, " arschloch ": 3.5, " dummkopf ": 3.0, " abschaum ": 3.0, " connard ": 3.5, " imbécile ": 3.0, " idiote ": 3.0, " gilipollas ": 3.5, " imbécil ": 3.0, " estúpido ": 2.5, " idiota ": 3.0}
#: Phrases in which such a word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "class clown", "circus clown", "scum line", "pond scum", "sore loser bracket", "the word idiot", "the word moron", "the word stupid", "stupid simple", "not stupid", "not worthless", "worthless stock", "worthless shares")

#: Lengths of word beginnings that can be terms; a term is dense where it is one word in so many; weights beyond this are cut.
STEMS, DENSE, MOST, ROOM = range(3, 8), 250, 6.0, 30
_HIDDEN = re.compile(rf"[{re.escape(''.join(STANDS_FOR))}]+(?=[^\W\d_])|(?<=[^\W\d_])[{re.escape(''.join(STANDS_FOR))}]+(?=[^\W\d_])")
_GOES_ON = re.compile(rf"[^\W\d_][{re.escape(''.join(STANDS_FOR))}]*[^\W\d_]")
_WORD = re.compile(r"[^\W\d_]+")
_FOLD = {ord(c): x for c, x in LOOK_ALIKE.items()} | {ord(c): None for c in UNSEEN}
_READ = str.maketrans(STANDS_FOR)
_READ_L = str.maketrans(STANDS_FOR | dict.fromkeys(ALSO_L, "l"))


def folded(text: str) -> list[str]:
    """The text's words in lower case with a space before, between and after, other scripts' look-alikes as Latin letters, digits and signs before or between letters as the letters that they stand for; where one of
    them may be an i or an l, both readings, word by word of the same length."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    doubtful = False

    def letters(m: re.Match) -> str:
        nonlocal doubtful
        start = m.start() == 0 or not text[m.start() - 1].isalpha()
        if start and not (len(m[0]) == 1 and _GOES_ON.match(text, m.end())):
            return m[0]  # 3d, 500km, $$pay: numbers and signs before a word are none of its letters, but for one alone, as in 1diot
        doubtful |= any(c in ALSO_L for c in m[0])
        return m[0].translate(_READ)

    plain = _HIDDEN.sub(letters, text)
    out = [f" {' '.join(_WORD.findall(plain))} "]
    if doubtful:
        out.append(f" {' '.join(_WORD.findall(_HIDDEN.sub(lambda m: letters(m) if letters(m) == m[0] else m[0].translate(_READ_L), text)))} ")
    return out


@dataclass
class Model:
    """The lexicon's terms, `` word `` or `` beginning`` of a word, with their weights, the phrases that excuse, and how a text's weight becomes a score."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 2.0
    shift: float = -4.0

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for phrase in self.exceptions:
            found.add_word(folded(phrase)[0], (len(folded(phrase)[0]), None))
        for term, weight in self.terms.items():
            found.add_word(term, (len(term), weight))
        if len(found):
            found.make_automaton()
        return found

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "automaton"}

    def weight(self, text: str) -> float:
        """Weight a word: of each word the greatest of its terms' weights, none inside an exception, summed and divided by the number of words, to which ROOM are added, as one chance hit says little in a short text."""
        best: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        readings = folded(text)
        if not len(self.automaton):
            return 0.0
        for reading in readings:
            for end, (size, weight) in self.automaton.iter(reading):
                start = end - size + 1
                if weight is None:
                    excused.append((start, end))
                elif weight > best.get(start, 0.0):
                    best[start] = weight
        for a, b in excused:
            for start in [s for s in best if a <= s < b]:
                del best[start]
        return sum(best.values()) / (readings[0].count(" ") + ROOM)

    def scores(self, texts: list[str]) -> np.ndarray:
        x = np.log1p(DENSE * np.array([self.weight(t) for t in texts], float))
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.shift, -30, 30)))


def terms_of(text: str) -> Counter:
    """How often each term that the text's words could give occurs, under '' the number of words."""
    words = Counter(folded(text)[0].split())
    out: Counter = Counter()
    for w, n in words.items():
        out[f" {w} "] += n
        for k in STEMS:
            if k <= len(w):
                out[" " + w[:k]] += n
    out[""] = sum(words.values())
    return out


def _counted(sample: DataFrame) -> DataFrame:
    """(term, p, n, p_dense, n_dense): toxic and clean documents that hold the term, and that hold it densely."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                sums: dict[str, list[int]] = {}
                part = whole.slice(at, 200)
                for y, t in zip(part.column("y").to_pylist(), part.column("t").to_pylist()):
                    found = terms_of(t)
                    total = found.pop("")
                    for term, k in found.items():
                        row = sums.setdefault(term, [0, 0, 0, 0])
                        row[1 - y] += 1
                        row[3 - y] += k * DENSE >= total
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *[pa.array([r[k] for r in sums.values()], pa.int64()) for k in range(4)]], ["term", "p", "n", "p_dense", "n_dense"])

    one = sample.select("y", "t").mapInArrow(each, "term string, p long, n long, p_dense long, n_dense long")
    return one.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("p", "n", "p_dense", "n_dense")])


def _evidence(p: Column, n: Column, toxic: int, clean: int) -> Column:
    """Twice the log-likelihood ratio of the term being as frequent in both classes, negative where it is more frequent in clean ones."""
    part = lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)
    both, all_ = p + n, toxic + clean
    g = part(p) + part(n) + part(toxic - p) + part(clean - n) - part(both) - part(all_ - both) - part(F.lit(toxic)) - part(F.lit(clean)) + part(F.lit(all_))
    return F.when(p * clean > n * toxic, 2 * g).otherwise(-2 * g)


def _odds(p: Column, n: Column, toxic: int, clean: int) -> Column:
    return F.least(F.log((p + 0.5) / (toxic + 1)) - F.log((n + 0.5) / (clean + 1)), F.lit(MOST))


def lexicon(sample: DataFrame, most: int = 50_000) -> dict[str, float]:
    """Terms that tell toxic documents from clean ones, and their weights, log-odds; of all words and beginnings only those beyond what chance gives so many of them, ``most`` at most.

    A term counts by the documents that hold it or, where that tells more, by those that hold it densely. A beginning counts where it tells more
    than any one of the longer terms that begin so (else these are more exact), and stands for those of them that tell no more.
    """
    totals = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    weights = dict(KNOWN)
    if not toxic or not clean:
        return weights
    counted = cut(_counted(sample))
    c, size = F.col, (toxic, clean)
    told = counted.select("term", "p", "n", *[f(c(f"p{d}"), c(f"n{d}"), *size).alias(f"{x}{d}") for d in ("", "_dense") for x, f in (("g", _evidence), ("w", _odds))])
    told = told.withColumn("w", F.when(c("g_dense") > c("g"), c("w_dense")).otherwise(c("w"))).withColumn("g", F.greatest("g", "g_dense"))
    chance = 2 * float(np.log(max(counted.where("p >= 3").count(), 2)))  # terms that fewer hold can't tell anything, whatever the others do
    for r in told.where(c("term").isin(list(KNOWN)) & (c("p") + c("n") >= 10)).collect():  # a row for each known word
        weights[r.term] = max(r.w, 0.0)
    chosen = told.where((c("p") >= 3) & (c("g") >= chance) & (c("w") > 1)).orderBy(F.desc("g"), "term").limit(most).select("term", "w", "g").toArrow()
    found = sorted(zip(*[chosen.column(k).to_pylist() for k in ("term", "w", "g")]), key=lambda x: (len(x[0]), x[0]))
    longer: dict[str, float] = {}
    for term, _, g in found:
        for k in STEMS:
            if k + 1 < len(term):
                longer[term[: k + 1]] = max(longer.get(term[: k + 1], 0.0), g)
    for term, w, g in found:
        whole = term[-1] == " "
        if (whole or g >= 1.1 * longer.get(term, 0.0)) and all(weights.get(term[: k + 1], 0.0) < w for k in STEMS if k + 1 < len(term)):
            weights[term] = w
    return {t: w for t, w in weights.items() if w > 0}


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn the weights from at most ``max_rows`` labelled documents, read whole: a quarter toxic ones at most, the rest clean, those whose hashed id is smallest.

    Ids with crc32(id as text) mod 4 = 2 are held out. Null ids, null labels and labels other than 0 and 1 teach nothing; of labels that repeat for an id the
    smallest counts, and of rows of ``docs`` that repeat an id that of the smallest text. Two thirds give the lexicon, the others tell how weight becomes a score; where these have few of a class, all do. Without toxic or clean labels the
    known words and a fixed curve remain. Only terms that tell the classes apart, and a number for each document of the sample, reach the driver.
    """
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and crc32(cast(i as string)) % 4 <> 2").groupBy("i").agg(F.min("y").alias("y"))
    part = lambda y, n: known.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(n)
    chosen = part(1, max_rows // 4).unionAll(part(0, max_rows - max_rows // 4))
    rows = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(chosen), "i")  # max_rows at most are broadcast
    sample = cut(rows.groupBy("i").agg(F.min("t").alias("t"), F.min("y").alias("y")))
    third = F.pmod(F.xxhash64("i", F.lit(3)), F.lit(3)) == 0
    few = {r.y: r["count"] for r in sample.where(third).groupBy("y").count().collect()}
    apart = min(few.get(0, 0), few.get(1, 0)) >= 40
    model = Model(lexicon(sample.where(~third) if apart else sample))
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def weights(text: pd.Series) -> pd.Series:
        return pd.Series([held.value.weight(t) for t in text], dtype="float64")

    seen = (sample.where(third) if apart else sample).select("y", weights("t").alias("x")).toArrow()
    model.slope, model.shift = _curve(np.log1p(DENSE * seen.column("x").to_numpy()), seen.column("y").to_numpy())
    return model


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton's method; the slope's small penalty keeps it finite where the classes don't overlap."""
    if not 0 < y.sum() < len(y):
        return Model.slope, Model.shift
    z = np.stack([x, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hill = z.T @ (z * (p * (1 - p))[:, None]) + np.diag([2 * ridge, 1e-6])
        step = np.linalg.solve(hill, z.T @ (y - p) - np.array([2 * ridge, 1e-6]) * w)
        w += np.clip(step, -2, 2)
    return float(w[0]), float(w[1])


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a last column of scores (0 to 1, higher: label 1 likelier) of their whole texts.

    Null and empty texts get the score of a text without terms. Rows, repeats and other columns stay as they are; where a
    column is called like ``out`` already, the new one's name has underscores in front. An empty table stays empty.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # the lexicon, of bounded size

    @F.pandas_udf("double")
    def scores(text: pd.Series) -> pd.Series:
        return pd.Series(held.value.scores([t or "" for t in text]), dtype="float64")

    return docs.withColumn(free_name(docs, out), scores(F.col(text_col)))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, read(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 4 = 2"), F.lit(False))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
