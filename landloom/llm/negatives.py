"""Hard negatives by spanning trees of anchors: a parent's scores, give or take edge length times candidate norm, bound its child's."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from landloom.llm.search import _matrix, _same_width, distances, whole
from landloom.session import cut, read

#: Anchors of a tree, candidates that meet a tree in one task, and those of them whose bounds are held at a time.
ANCHORS, CANDIDATES, PART = 8192, 65536, 512
#: Vectors by whose distances anchors are put next to their like before trees are made.
PIVOTS = 32
LONG = np.iinfo(np.int64)


def exact_scores(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Inner products of whole vectors with one: by doubles where no sum can reach 2 ** 52, by unbounded whole numbers elsewhere; what a long can't hold becomes its end."""
    if float(np.abs(x.astype(np.float64)).max(initial=0)) * float(np.abs(a.astype(np.float64)).max(initial=0)) * max(len(a), 1) < 2**52:
        return np.rint(x.astype(np.float64) @ a.astype(np.float64)).astype(np.int64)
    return np.array([min(max(int(s), LONG.min), LONG.max) for s in x.astype(object) @ a.astype(object)], np.int64).reshape(len(x))


def spanning_tree(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least spanning tree of the rows of ``v`` (Prim): their order, in which parents come first, each one's parent by its place in that order (-1: the root), and the length of the edge."""
    n = len(v)
    order, parent, edge = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n)
    if not n:
        return order, parent, edge
    near, by, out = distances(v, v[:1])[:, 0], np.zeros(n, np.int64), np.ones(n, bool)
    out[0] = False
    for k in range(1, n):
        i = int(np.argmin(np.where(out, near, np.inf)))
        order[k], parent[k], edge[k], out[i] = i, by[i], near[i], False
        d = distances(v, v[i : i + 1])[:, 0]
        closer = out & (d < near)
        near[closer], by[closer] = d[closer], k
    return order, parent, edge


def rescored(v: np.ndarray, parent: np.ndarray, edge: np.ndarray, x: np.ndarray, norm: np.ndarray, window: Callable[[int], tuple[float, float, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, candidates, their exact scores) for all candidates whose bounds overlap the anchor's window.

    ``v``, ``parent`` and ``edge`` are a tree in its order; ``window(i)`` gives the least and greatest score that anchor i can use and which candidates it can.
    For a child c of p and a candidate x, |<c, x> - <p, x>| = |<c - p, x>| <= |c - p| |x|, so p's bounds, wider by that, are c's; a root is scored outright. Candidates that are
    rescored have exact bounds from there on down; those that aren't pass wider ones on. A node's bounds are dropped after its last child.
    """
    last = np.full(len(v), -1)
    for i, p in enumerate(parent):
        if p >= 0:
            last[p] = i
    low: dict[int, np.ndarray] = {}
    high: dict[int, np.ndarray] = {}
    for i, p in enumerate(parent):
        least, most, may = window(i)
        if p < 0:
            s = exact_scores(x, v[i])
            a = b = s.astype(np.float64)
            rows = np.flatnonzero(may & (a >= least) & (a <= most))
            found = s[rows]
        else:
            reach = edge[i] * norm
            reach += 1e-9 * (np.maximum(np.abs(low[p]), np.abs(high[p])) + reach) + 1  # more than rounding can take away
            a, b = low[p] - reach, high[p] + reach
            rows = np.flatnonzero(may & (b >= least) & (a <= most))
            found = exact_scores(x[rows], v[i])
            a[rows] = b[rows] = found
            if last[p] == i:
                del low[p], high[p]
        if last[i] >= 0:
            low[i], high[i] = a, b
        yield i, rows, found


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    top = np.lexsort((ids, -scores))[:k]
    return scores[top], ids[top]


def planted(anchors: DataFrame, size: int = ANCHORS) -> DataFrame:
    """``anchors`` (vec_id, v, ...) with columns b (tree), at (place in it), parent and edge. Anchors are dealt to trees of about ``size`` by their nearest of PIVOTS rows, a crowd of one pivot
    being split by hash; a tree is made in one task. The driver sees the pivots."""
    pivots = _matrix(anchors.orderBy(F.xxhash64("vec_id", F.lit(5))).select("v").limit(PIVOTS).toArrow().column(0))
    fields = anchors.schema.fields

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = distances(_matrix(batch.column("v")), pivots).argmin(axis=1) if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.astype(np.int32))], [*batch.schema.names, "p"])

    held = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    near = cut(anchors.mapInArrow(nearest, f"{held}, p int"))
    order = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each pivot
    crowds = near.groupBy("p").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(order), F.lit(0)))
    place = F.col("first") + F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("n"))
    blocks = near.join(F.broadcast(crowds), "p").withColumn("b", F.floor(place / size).cast("int")).select(*anchors.columns, "b")

    def tree(block: pa.Table) -> pa.Table:
        order, parent, edge = spanning_tree(_matrix(block.column("v")))
        block = block.take(pa.array(order))
        for name, values in (("at", np.arange(len(order))), ("parent", parent), ("edge", edge)):
            block = block.append_column(name, pa.array(values))
        return block

    return blocks.groupBy("b").applyInArrow(tree, f"{held}, b int, at long, parent long, edge double")


def _met(trees: DataFrame, rows: DataFrame, meet: Callable[[pa.Table, np.ndarray, pa.Table, np.ndarray], pa.Table], out: str) -> DataFrame:
    """Each tree with each part of the rows, in one task: meet(anchors in the tree's order, their vectors, candidates, theirs)."""
    n_b = trees.agg(F.max("b")).first()[0]
    n = rows.count()
    n_x = max(1, -(-n // CANDIDATES), min(rows.sparkSession.sparkContext.defaultParallelism, n // (4 * PART)))  # no task has more rows than that; small inputs keep all cores busy
    sides = trees.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_x - 1)))), rows.withColumn("c", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(n_x)).cast("int"))
    sides = sides[0], sides[1].withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_b or 0))))

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("at")
        q, x = _same_width(_matrix(left.column("v")), _matrix(right.column("v")))
        return meet(left, q, right, x)

    return sides[0].groupBy("b", "c").cogroup(sides[1].groupBy("b", "c")).applyInArrow(both, out)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, scale: float = 256.0, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its positives the first ``k`` rows of other labels whose score is ``low`` to ``high`` hundredths of the positive's.

    Vectors are scaled and floored to whole numbers, scores are their exact inner products; higher ones come first, ties by the smaller id. An anchor's positives are
    its first ``positives`` other rows of the same label. ``is_anchor`` is a condition on column vec_id, ``label`` an expression over the columns of ``vectors``. Rows whose id, label or vector is null, or whose
    vector holds a null or non-finite component, take no part; of rows that repeat an id the one with the greatest vector counts, then that of the greatest label; vectors of other
    lengths count as padded with zeros; scores that a long can't hold count as its end. Without rows of the same label, or without others in the window, an anchor gives no row, as does an empty table; other columns are ignored.

    Anchors lie in spanning trees, made once. Trees meet parts of the rows in tasks: scores at a parent bound those at its children, and only candidates whose bounds overlap what an anchor can
    still use are scored: above the last of its positives so far, then in the windows of its positives above the last of their negatives so far. Of each tree and part at most ``positives`` and ``k`` rows an anchor and positive go on.
    """
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("int").alias("label"), whole(F.col(vector_col), scale).alias("v")).where("vec_id is not null and label is not null and v is not null")
    rows = cut(kept.groupBy("vec_id").agg(F.max(F.struct("v", "label")).alias("r")).select("vec_id", "r.label", "r.v"))
    trees = cut(planted(rows.where(is_anchor)))

    def same(left: pa.Table, q: np.ndarray, right: pa.Table, x: np.ndarray) -> pa.Table:
        ids, labels, parent, edge = (left.column(c).to_numpy() for c in ("vec_id", "label", "parent", "edge"))
        at, kinds = right.column("vec_id").to_numpy(), right.column("label").to_numpy()
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]
        for start in range(0, len(at), PART):
            part = slice(start, start + PART)
            here, kind = at[part], kinds[part]
            window = lambda i: (float(best[i][0][-1]) if len(best[i][0]) == positives else -np.inf, np.inf, (kind == labels[i]) & (here != ids[i]))
            for i, found, s in rescored(q, parent, edge, x[part], norm[part], window):
                if len(found):
                    best[i] = _best(np.concatenate([best[i][0], s]), np.concatenate([best[i][1], here[found]]), positives)
        n = [len(s) for s, _ in best]
        return pa.table({"anchor_id": np.repeat(ids, n), "positive_id": np.concatenate([np.empty(0, np.int64), *[p for _, p in best]]), "positive_score": np.concatenate([np.empty(0, np.int64), *[s for s, _ in best]])})

    nearest = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = _met(trees, rows, same, "anchor_id long, positive_id long, positive_score long").withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= positives)
    each = found.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("r", "positive_id", "positive_score"))).alias("ps")).withColumnRenamed("anchor_id", "vec_id")
    armed = cut(trees.join(each, "vec_id", "left"))  # anchors without positives stay, as parents of others

    def others(left: pa.Table, q: np.ndarray, right: pa.Table, x: np.ndarray) -> pa.Table:
        ids, labels, parent, edge = (left.column(c).to_numpy() for c in ("vec_id", "label", "parent", "edge"))
        at, kinds = right.column("vec_id").to_numpy(), right.column("label").to_numpy()
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        windows, best = [], []
        for ps in left.column("ps").to_pylist():
            ends = [(-(-low * p["positive_score"] // 100), high * p["positive_score"] // 100) for p in ps or []]
            windows.append([(p["positive_id"], p["positive_score"], *w) for p, w in zip(ps or [], ends) if w[0] <= w[1]])
            best.append([(np.empty(0, np.int64), np.empty(0, np.int64))] * len(windows[-1]))
        nothing = np.zeros(PART, bool)
        for start in range(0, len(at), PART):
            part = slice(start, start + PART)
            here, kind = at[part], kinds[part]

            def window(i: int) -> tuple[float, float, np.ndarray]:
                if not windows[i]:
                    return np.inf, -np.inf, nothing[: len(here)]
                floors = [max(w[2], int(s[-1])) if len(s) == k else w[2] for w, (s, _) in zip(windows[i], best[i])]
                return float(min(floors)), float(max(w[3] for w in windows[i])), kind != labels[i]

            for i, rows_, s in rescored(q, parent, edge, x[part], norm[part], window):
                for j, w in enumerate(windows[i] if len(rows_) else []):
                    inside = (s >= w[2]) & (s <= w[3])
                    if inside.any():
                        best[i][j] = _best(np.concatenate([best[i][j][0], s[inside]]), np.concatenate([best[i][j][1], here[rows_[inside]]]), k)
        out: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64),) * 5]
        for own, ws, bs in zip(ids, windows, best):
            for (positive, score, *_), (s, n) in zip(ws, bs):
                out.append((np.full(len(s), own), np.full(len(s), positive), n, np.full(len(s), score), s))
        return pa.table([np.concatenate(c) for c in zip(*out)], names=["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    hard = _met(armed, rows, others, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return hard.withColumn("rank", rank).where(F.col("rank") <= k).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * x.v[i]))::BIGINT AS score
  FROM v a JOIN v x ON a.vec_id <> x.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5
), n AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
