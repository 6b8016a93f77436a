"""Hard negatives, cross-tokenizer alignment and toxicity against plain Python, on odd rows too."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from landloom.llm import alignment, negatives, toxicity

DATA = "/root/testdata/sf0.001"


def mined(rows, is_anchor, positives, k, low=30, high=90, scale=256):
    known = {}
    for i, v, y in rows:
        if i is None or v is None or y is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        w = [int(np.floor(scale * x)) for x in v]
        known[i] = max(known.get(i, (w, y)), (w, y))
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a in known:
        if not is_anchor(a):
            continue
        s = sorted((-dot(known[a][0], known[x][0]), x) for x in known if x != a)
        for p, i in [t for t in s if known[t[1]][1] == known[a][1]][:positives]:
            near = [(n, j) for n, j in s if known[j][1] != known[a][1] and low * -p <= 100 * -n <= high * -p][:k]
            out += [(a, i, r, j, -p, -n) for r, (n, j) in enumerate(near, 1)]
    return sorted(out)


def vectors(seed=1, n=300, width=6):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(8, width))
    rows = [(i, [float(x) for x in centres[i % 8] + rnd.normal(scale=0.05, size=width)], i % 3) for i in range(n)]
    rows += [(n + i, list(rows[7][1]), 1) for i in range(40)]  # ties
    odd = [(900, None, 1), (901, [], 2), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (903, [float("nan")] * 6, 1), (904, [float("inf")] * 6, 2), (905, [0.5] * 6, None), (None, [0.5] * 6, 1), (906, [1.0, 2.0], 1), (906, [0.5, 2.0], 2), (20, [0.0] * 6, 0), (910, [0.0] * 6, 7), (912, [2.0] * 9, 0)]
    return rows + odd


@pytest.mark.parametrize("size, part", [(8192, 512), (5, 7)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, size, part):
    monkeypatch.setattr(negatives, "PART", part)
    monkeypatch.setattr(negatives, "CANDIDATES", 10 * part)
    monkeypatch.setattr(negatives.planted, "__defaults__", (size,))
    rows = vectors()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, anchor_id string").repartition(3)
    got = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("label"), positives=3, k=4)
    assert sorted(map(tuple, got.collect())) == mined(rows, lambda i: i % 10 == 0, 3, 4)
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0, F.col("label")).count() == 0
    assert negatives.hard_negatives(df, F.lit(False), F.col("label")).count() == 0


def test_scores_beyond_doubles_are_exact_and_end_at_a_long():
    big = np.array([[2**40, 3], [2**62, 2**62], [5, 7]], np.int64)
    assert negatives.exact_scores(big, np.array([2**20 + 1, 1], np.int64)).tolist() == [2**40 * (2**20 + 1) + 3, negatives.LONG.max, 5 * (2**20 + 1) + 7]


def test_tree_bounds_hold_and_spare_scores():
    rnd = np.random.default_rng(3)
    centres = 400 * rnd.normal(size=(6, 16))
    make = lambda n: np.rint(centres[rnd.integers(6, size=n)] + 4 * rnd.normal(size=(n, 16))).astype(np.int64)
    v, x = make(60), make(500)
    order, parent, edge = negatives.spanning_tree(v)
    v = v[order]
    assert sorted(order) == list(range(60)) and parent[0] == -1 and all(0 <= p < i for i, p in enumerate(parent) if i)
    scores, norm, seen = v @ x.T, np.sqrt((x**2).sum(1).astype(float)), 0
    for i, rows, s in negatives.rescored(v, parent, edge, x, norm, lambda i: (np.quantile(scores[i], 0.9), np.quantile(scores[i], 0.95), np.ones(500, bool))):
        inside = np.flatnonzero((scores[i] >= np.quantile(scores[i], 0.9)) & (scores[i] <= np.quantile(scores[i], 0.95)))
        assert set(inside) <= set(rows) and (scores[i][rows] == s).all()
        seen += len(rows)
    assert seen < 0.5 * scores.size


def test_op11(spark):
    rows = [(r["vec_id"], r["embedding"], None if r["label"] is None else (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in pq.read_table(f"{DATA}/embeddings.parquet").to_pylist()]
    assert sorted(map(tuple, entry.queries()["op11_hard_negatives"](spark, DATA).collect())) == mined(rows, lambda i: i % 100 == 0, 5, 10)


# --- alignment --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def plain():
    """Both encoders and their tokens' bytes, without the operator's classes; the first by the library that reads its file."""
    import sentencepiece
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(alignment.BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_BPE)
    first.encode_special_tokens = True
    shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
    letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    of_a = lambda i: bytes(letters[c] for c in first.id_to_token(i))
    of_b = lambda i: bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()
    return lambda t: ([(i, of_a(i)) for i in first.encode(" " + t, add_special_tokens=False).ids], [(i, of_b(i)) for i in second.encode(t)])


def alignments(texts, plain):
    sides, counts = [], collections.Counter()
    for t in texts:
        a, b = plain(t) if t else ([], [])
        whole = (" " + (t or "")).encode()
        if any(b"".join(x for _, x in s) != whole for s in (a, b)):
            a, b = [], []
        at, ends = [[], []], []
        for k, s in enumerate((a, b)):
            end = 0
            for i, x in s:
                end += len(x)
                at[k].append((end, i))
        ends = sorted({e for e, _ in at[0]} & {e for e, _ in at[1]})
        links = [(i, j) for e in ends for i in [i for f, i in at[0] if f == e] for j in [j for f, j in at[1] if f == e]] if len(ends) < 2000 else [(dict(at[0])[e], dict(at[1])[e]) for e in ends]
        counts.update(links)
        groups, from_a, from_b = [], 0, 0
        for e in ends:
            parts = []
            for k, start in ((0, from_a), (1, from_b)):
                stop = start
                while stop < len(at[k]) and at[k][stop][0] <= e:
                    stop += 1
                parts.append(",".join(str(i) for _, i in at[k][start:stop]))
                if k:
                    from_b = stop
                else:
                    from_a = stop
            groups.append("|".join(parts))
        sides.append((len(a), len(b), len(ends), links, ";".join(groups)))
    best = collections.Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return [(a, b, g, len(ls), sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls), hashlib.sha256(text.encode()).hexdigest() if a else "") for a, b, g, ls, text in sides]


def test_alignment_equals_brute_force(spark, plain, monkeypatch):
    rnd = random.Random(2)
    letters = "the The quick <|endoftext|> <s> </s> <0x41> ▁ \t\n  héé 日本語 😀 \x00 1234567 don't it's ####### ==== aaaa".split(" ") + [" ", "\r\n", " ", "ﬁ"]
    texts = [None, "", " ", "a", "▁", "x▁y", " lead", "<|endoftext|>", "z" * 5000, " ".join(rnd.choice(letters) for _ in range(4000)), "A", "﻿", "ｆｕｌｌ"]
    texts += ["".join(rnd.choice(letters) + rnd.choice(["", " "]) for _ in range(rnd.randrange(1, 40))) for _ in range(150)]
    texts += [texts[20]] * 7
    rows = [(None if k == 5 else k // 2, t, "a", "b", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, a string, i string, n_a int").repartition(5)
    monkeypatch.setattr(alignment, "SLICE", 64)
    monkeypatch.setattr(alignment, "FAN", 2)
    monkeypatch.setattr(alignment, "HELD", 500)
    first, second = alignment.ByteBpe(alignment.BYTE_BPE), alignment.Pieces(alignment.PIECE_BPE)
    got = alignment.aligned(docs, first, second)
    want = [(r[0], *w) for r, w in zip(rows, alignments(texts, plain))]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert alignment.aligned(docs.limit(0), first, second).count() == 0
    assert alignment.aligned(docs.where("text = ''"), first, second).drop("doc_id").distinct().collect() == [(0, 0, 0, 0, 0, 0, "")]
    slow = alignment.ByteBpe(alignment.BYTE_BPE)
    slow.ranked = False
    assert first.ranked and slow.encode([t or "" for t in texts]) == first.encode([t or "" for t in texts])


def test_op13(spark, plain):
    docs = pq.read_table(f"{DATA}/documents.parquet").to_pylist()
    got = {r.doc_id: tuple(r)[1:] for r in entry.queries()["op13_cross_alignment"](spark, DATA).collect()}
    assert got == {d["doc_id"]: w for d, w in zip(docs, alignments([d["text"] for d in docs], plain))}


def test_perfect_hash():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 64, 65, 1000, 200_000):
        keys = np.unique(rnd.integers(-(2**62), 2**62, n))
        h = alignment.PerfectHash(rnd.permutation(np.concatenate([keys, keys])))
        assert sorted(h(keys)) == list(range(len(keys))) and (h.keys[h(keys)] == keys).all()
        others = np.setdiff1d(rnd.integers(-(2**62), 2**62, 1000), keys)
        assert (h(others) == -1).all()
        assert sum(words.nbytes + before.nbytes for _, words, before in h.levels) <= 2 * len(keys) + 2048


def test_linked_pairs_are_bounded_by_the_vocabularies():
    first, second = alignment.ByteBpe(alignment.BYTE_BPE), alignment.Pieces(alignment.PIECE_BPE)
    assert 100_000 < alignment.most_pairs(first, second) < 400_000


# --- toxicity ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["idiot", "IDIOT!", "1d10t", "i.d1ot idi0t", "ｉｄｉｏｔ", "іdіоt", "id​iot", "you id!ot", "idiоt"])
def test_folding_finds_disguised_words(text):
    model = toxicity.Model({" idiot ": 3.0}, ())
    assert model.weight(text) > 0


def test_both_readings_of_a_one():
    model = toxicity.Model({" clown ": 3.0, " idiot ": 3.0}, ())
    assert model.weight("c1own") > 0 and model.weight("1diot") > 0 and model.weight("c0wl 500km 3d $$pay idiotic") == 0
    assert toxicity.folded("a1b c") == [" aib c ", " alb c "]


def test_exceptions_beginnings_and_length():
    model = toxicity.Model({" trash ": 2.0, " vequ": 3.0, " vequa ": 1.0}, ("trash can",))
    room = toxicity.ROOM
    assert model.weight("a trash can") == 0 and model.weight("trash canyon") == pytest.approx(2 / (3 + room))
    assert model.weight("vequa, vequelle; noveque") == pytest.approx(6 / (4 + room))
    assert model.weight("trash in the trash can") == pytest.approx(2 / (6 + room))
    assert model.weight("") == model.weight("...") == 0 == toxicity.Model({}, ()).weight("trash")
    assert model.weight("trash " + "word " * 1000) < model.weight("trash word")


def test_toxicity_learns_words_and_beginnings(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice(["ba", "ke", "lo", "mi", "nu", "tar", "sel"]) for _ in range(rnd.randrange(1, 4)))
    rows, labels = [], []
    for i in range(1200):
        words, toxic = [word() for _ in range(rnd.randrange(20, 80))], i % 4 == 0
        for _ in range(3 * toxic):
            words.insert(rnd.randrange(len(words)), rnd.choice(["grunk", "zorvel" + word()]))
        rows.append((i, " ".join(words), 0.5))
        labels.append((i, int(toxic), "x"))
    labels += [(None, 1, "x"), (3, None, "x"), (7, 5, "x"), (1, 1, "x")]
    rows += [(9000, None, 0.5), (9001, "", 0.5), (9002, "zorvelke " * 30000, 0.5), (None, "grunk grunk", 0.5), (9001, "", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(4)
    known = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    model = toxicity.fit(docs, known)
    assert " grunk " in model.terms and any(t.startswith(" zor") and t[-1] != " " for t in model.terms)
    out = toxicity.score(docs, model)
    assert out.columns == ["doc_id", "text", "score", "_score"] and out.count() == len(rows)
    got = {r.doc_id: r._score for r in out.collect()}
    held = [i for i in range(1200) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= 0.3) == (i % 4 == 0) for i in held]) > 0.97
    assert 0 <= got[9000] == got[9001] < 0.3 and got[9002] > 0.9
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.fit(docs.limit(0), known)
    assert none.terms == toxicity.KNOWN and toxicity.fit(docs, known.limit(0)).terms == toxicity.KNOWN
    flipped = spark.createDataFrame([(i, 1 - y if i is not None and zlib.crc32(str(i).encode()) % 4 == 2 else y, t) for i, y, t in labels if y in (0, 1)], "doc_id long, toxic int, text string")
    assert toxicity.fit(docs, flipped).terms == model.terms  # held-out labels teach nothing


def test_op12(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in entry.queries()["op12_toxicity"](spark, sf).collect()}
    assert got.keys() == {r["doc_id"] for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id"]).to_pylist()}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    right = collections.Counter((y, got[i].predicted) for i, y in labels.items() if got[i].held_out and y in (0, 1))
    assert right[1, 1] / (right[1, 1] + right[1, 0]) > 0.9 and right[0, 0] / (right[0, 0] + right[0, 1]) > 0.98
