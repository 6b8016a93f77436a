"""Exact top-k inner products by pivot-table elimination."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from landloom.session import cut, read

#: Queries and candidates that meet in one task at a time, and candidates that are evaluated between two looks at the bound.
QUERIES, CANDIDATES, STEP = 512, 8192, 256
#: Vectors whose scores give each query a first floor.
SEED = 4096


def whole(vector: Column, scale: float = 1024.0) -> Column:
    """floor(scale * x) of each component; null where the vector is null or holds a null, a NaN or an infinity."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Lists of whole numbers as rows of one array, shorter ones padded with zeros, which change no inner product and no distance."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    wide = max(width, int(size.max(initial=0)))
    if len(size) and (size == wide).all():
        return flat.reshape(len(size), wide)
    out = np.zeros((len(size), wide), flat.dtype)
    out[np.arange(wide) < size[:, None]] = flat
    return out


def _same_width(*tables: np.ndarray) -> list[np.ndarray]:
    wide = max(t.shape[1] for t in tables)
    return [np.pad(t, ((0, 0), (0, wide - t.shape[1]))) if t.shape[1] < wide else t for t in tables]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances; squares of whole numbers below 2 ** 53 are exact before the root."""
    x, y = (t.astype(np.float64) for t in _same_width(x, y))
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T), 0))


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: by doubles where no sum can reach 2 ** 52, by whole numbers elsewhere."""
    q, x = _same_width(q, x)
    safe = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(q.shape[1], 1) < 2**52
    return np.rint(q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64) if safe else q @ x.T


def upper_bounds(dq: np.ndarray, qq: float, dx: np.ndarray, xx: np.ndarray) -> np.ndarray:
    """Upper bounds of one query's scores out of its and the candidates' rows of the pivot table.

    By the triangle inequality |d(q, p) - d(x, p)| is a lower bound of d(q, x) for each pivot p; the greatest of
    them bounds the inner product, (|q|^2 + |x|^2 - d^2) / 2, from above.
    """
    least = np.abs(dx - dq).max(axis=1, initial=0)
    return (qq + xx - least * least) / 2 + 1e-9 * (qq + xx) + 1  # more than rounding can take away


def best(query: np.ndarray, own: int, most: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and scores of a query's k best candidates out of these, none that is below ``floor``, and how many were evaluated.

    Candidates are evaluated in the order of their bounds until that is below the k-th score so far, so that no better or equal one is left.
    """
    rows = np.flatnonzero((most >= floor) & (ids != own))
    rows = rows[np.argsort(-most[rows], kind="stable")]
    kept_s, kept_i, seen = np.empty(0, np.int64), np.empty(0, np.int64), 0
    for at in range(0, len(rows), STEP):
        part = rows[at : at + STEP]
        if len(kept_s) == k and most[part[0]] < kept_s[-1]:
            break
        s = _scores(query[None, :], vectors[part])[0]
        seen += len(part)
        kept_s, kept_i = np.concatenate([kept_s, s]), np.concatenate([kept_i, ids[part]])
        top = np.lexsort((kept_i, -kept_s))[:k]
        kept_s, kept_i = kept_s[top], kept_i[top]
    return kept_i, kept_s, seen


def pivot_table(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(vec_id, v, xx, d): each vector's square and its distances to the pivots, computed once."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column(1))
            d = distances(v, pivots)
            table = pa.ListArray.from_arrays(np.arange(0, d.size + 1, max(d.shape[1], 1), dtype=np.int32)[: len(d) + 1], d.ravel()) if d.size else pa.array([[]] * len(d), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((v.astype(np.float64) ** 2).sum(axis=1)), table], ["vec_id", "v", "xx", "d"])

    return vectors.mapInArrow(each, "vec_id long, v array<long>, xx double, d array<double>")


def query_floors(queries: DataFrame, ids: np.ndarray, seed: np.ndarray, k: int) -> DataFrame:
    """``queries`` with a column floor: the k-th score among the seed vectors, which the k-th of all can't be under; without so many, minus infinity."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.full(b.num_rows, -np.inf)
            for at in range(0, b.num_rows, QUERIES):
                part = b.slice(at, QUERIES)
                s = _scores(_matrix(part.column("v")), seed).astype(np.float64)
                s[part.column("vec_id").to_numpy()[:, None] == ids[None, :]] = -np.inf
                if s.shape[1] >= k:
                    out[at : at + QUERIES] = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, "floor"])

    return queries.mapInArrow(each, "vec_id long, v array<long>, xx double, d array<double>, floor double")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, pivots: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of each query row its k greatest inner products with the other rows, ties to the smaller id.

    Vectors are scaled and floored to whole numbers first, so scores are exact. ``is_query`` is a condition on column vec_id. Vectors that are null or hold a null or
    non-finite component, and null ids, take no part; vectors of other lengths count as padded with zeros; of rows that
    repeat an id the greatest vector counts. Less than k others give less than k rows; an empty table gives none; other columns are ignored.

    The pivot table, distances to ``pivots`` rows, is made once. Scores with SEED rows give each query a floor. Queries are dealt into blocks of about QUERIES, pivot by nearest
    pivot; of a block only the range of its distances to each pivot, its greatest square and its least floor are told to all tasks, and a candidate
    is sent to those blocks alone which it can have a winner for. There each query goes through the candidates in the order of their bounds. Of each pair of blocks
    at most k rows a query go on. The driver sees the pivots, the seed rows and a line for each block of QUERIES queries.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), whole(F.col(vector_col)).alias("v")).where("vec_id is not null and v is not null")
    rows = cut(rows.groupBy("vec_id").agg(F.max("v").alias("v")))
    few = rows.orderBy(F.xxhash64("vec_id", F.lit(5))).limit(SEED).toArrow()  # SEED rows
    seed = _matrix(few.column("v"))
    table = cut(pivot_table(rows, seed[:pivots]))
    asked = query_floors(table.where(is_query), few.column("vec_id").to_numpy(), seed, k)
    nearest = F.array_position("d", F.array_min("d")).cast("int")
    near = cut(asked.withColumn("p", F.coalesce(nearest, F.lit(0))))
    order = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each pivot
    crowds = near.groupBy("p").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(order), F.lit(0)))
    place = F.col("first") + F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("n"))  # about its place among all queries, pivot by pivot
    queries = cut(near.join(F.broadcast(crowds), "p").withColumn("b", F.floor(place / QUERIES).cast("int")).drop("p", "n", "first"))
    width = min(pivots, len(seed))
    told = [F.max("xx").alias("xx"), F.min("floor").alias("floor"), *[f(F.col("d")[j]).alias(f"{n}{j}") for j in range(width) for n, f in (("lo", F.min), ("hi", F.max))]]
    blocks = queries.groupBy("b").agg(*told).orderBy("b").toArrow()
    n_x = max(1, -(-table.count() // CANDIDATES))
    b_ids, b_xx, b_floor = (blocks.column(c).to_numpy() for c in ("b", "xx", "floor"))
    lo, hi = (np.stack([blocks.column(f"{n}{j}").to_numpy() for j in range(width)], axis=1) if width else np.empty((len(b_ids), 0)) for n in ("lo", "hi"))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each candidate's blocks: those of which its bound for the whole block reaches the least floor."""
        for b in batches:
            d, xx = _matrix(b.column("d")), b.column("xx").to_numpy()
            targets = []
            for i in range(b.num_rows):
                gap = np.maximum(np.maximum(d[i] - hi, lo - d[i]), 0).max(axis=1, initial=0)
                most = (b_xx + xx[i] - gap * gap) / 2 + 1e-9 * (b_xx + xx[i]) + 1
                targets.append(b_ids[most >= b_floor])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(targets, pa.list_(pa.int32()))], [*b.schema.names, "to"])

    asked_at = queries.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_x - 1))))
    others = table.mapInArrow(sent, "vec_id long, v array<long>, xx double, d array<double>, to array<int>")
    others = others.select("vec_id", "v", "xx", "d", F.explode("to").alias("b"), F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(n_x)).cast("int").alias("c"))
    names = ["query_id", "vec_id", "score"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        q, x = _same_width(_matrix(left.column("v")), _matrix(right.column("v")))
        dq, dx = _matrix(left.column("d")), _matrix(right.column("d"))
        ids, xx = right.column("vec_id").to_numpy(), right.column("xx").to_numpy()
        out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] * 3]
        for i, (own, qq, floor) in enumerate(zip(left.column("vec_id").to_pylist(), left.column("xx").to_pylist(), left.column("floor").to_pylist())):
            found, scores, _ = best(q[i], own, upper_bounds(dq[i], qq, dx, xx), ids, x, k, floor)
            out.append([np.full(len(found), own), found, scores])
        return pa.table([np.concatenate(c) for c in zip(*out)], names=names)

    found = asked_at.groupBy("b", "c").cogroup(others.groupBy("b", "c")).applyInArrow(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * x.v[i]))::BIGINT AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
) WHERE rank <= 10
"""
