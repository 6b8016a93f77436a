"""Length buckets of least padding, found by dynamic programming over the global histogram, and token-budget batches inside them."""

from __future__ import annotations

from collections import deque
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from landloom.session import cut, read

#: Rows of one length that are numbered together; a commoner length is split into as many groups as that takes.
GROUP = 50_000


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """At most ``buckets`` upper bounds, out of the increasing lengths, that minimise the padding when each row is padded to its bound.

    Padding is the sum of bounds less that of lengths, so the sum of bounds is minimised. The best cost of lengths up to j with one more bucket is a
    minimum of lines in lengths[j] whose slopes fall, which a queue of lines gives in steady time for each j.
    """
    n = len(lengths)
    if not n:
        return []
    below = [0]
    for c in counts:
        below.append(below[-1] + c)
    cost = [below[j] * lengths[j - 1] if j else 0 for j in range(n + 1)]
    choices = []
    for _ in range(1, min(buckets, n)):
        lines: deque[tuple[int, int, int]] = deque()  # (slope, intercept, i)
        now, chosen = [0] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            m, b = -below[j - 1], cost[j - 1]
            while len(lines) > 1:
                (m1, b1, _), (m2, b2, _) = lines[-2], lines[-1]
                if (b - b1) * (m1 - m2) > (b2 - b1) * (m1 - m):
                    break
                lines.pop()
            lines.append((m, b, j - 1))
            x = lengths[j - 1]
            while len(lines) > 1 and lines[1][0] * x + lines[1][1] <= lines[0][0] * x + lines[0][1]:
                lines.popleft()
            now[j], chosen[j] = lines[0][0] * x + lines[0][1] + below[j] * x, lines[0][2]
        cost = now
        choices.append(chosen)
    bounds, j = [], n
    for chosen in reversed(choices):
        if j:
            bounds.append(lengths[j - 1])
            j = chosen[j]
    if j:
        bounds.append(lengths[j - 1])
    return bounds[::-1]


def pack(docs: DataFrame, buckets: int = 16, budget: int = 32768, id_col: str = "doc_id", length: Column | None = None) -> DataFrame:
    """Batches of all rows: (doc_id, n_tokens, bucket, bucket_len, batch_id, slot).

    ``length`` (by default the words of column text; null counts as 0) is a row's tokens. The histogram of all lengths, which has a line for each
    length there is, fixes at most ``buckets`` upper bounds of least total padding. A batch holds max(1, budget // bucket_len) rows of one bucket, in order of length, so its padded tokens stay in the
    budget unless a single row is over it; only the last batch of a bucket may be short. Nothing is cut or left out: nulls, repeats and
    empty texts are rows like others (empty ones in a bucket of length 0 or with longer ones). Ties of length are ordered by
    a hash of the id, then the id, so ids that repeat may swap places. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    n = word_count(F.col("text")) if length is None else F.coalesce(length, F.lit(0))
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), n.cast("long").alias("n_tokens")))
    histogram = sorted((r.n_tokens, r.n) for r in rows.groupBy("n_tokens").agg(F.count("*").alias("n")).collect())  # a line for each length, of which the longest text sets a bound
    bounds = boundaries([h[0] for h in histogram], [h[1] for h in histogram], buckets)
    size = F.col("n_tokens")
    pick = lambda of: reduce(lambda other, k: F.when(size <= bounds[k], of(k)).otherwise(other), reversed(range(len(bounds))), F.lit(None)) if bounds else F.lit(None)
    # Lengths of more than GROUP rows, so at most as many as there are times GROUP rows.
    split = spark.createDataFrame([(h, -(-c // GROUP)) for h, c in histogram if c > GROUP], "n_tokens long, groups long")
    held = rows.join(F.broadcast(split), "n_tokens", "left")
    held = held.withColumns({"bucket": pick(lambda k: F.lit(k)).cast("int"), "bucket_len": pick(lambda k: F.lit(bounds[k])).cast("long"), "shard": F.pmod(F.xxhash64("doc_id"), F.coalesce("groups", F.lit(1).cast("long"))).cast("int")})
    # A row's place in its bucket is the rows of all smaller (length, shard) plus its own number in that group.
    groups = held.groupBy("bucket", "n_tokens", "shard").agg(F.count("*").alias("n"))
    before = groups.withColumn("before", F.sum("n").over(Window.partitionBy("bucket").orderBy("n_tokens", "shard").rowsBetween(Window.unboundedPreceding, -1)))
    numbered = held.withColumn("own", F.row_number().over(Window.partitionBy("n_tokens", "shard").orderBy("doc_id")))
    placed = numbered.join(before.select("n_tokens", "shard", F.coalesce("before", F.lit(0)).alias("before")), ["n_tokens", "shard"])
    place, each = F.col("before") + F.col("own") - 1, F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("bucket_len", F.lit(1)))).cast("long")
    return placed.select("doc_id", "n_tokens", "bucket", "bucket_len", F.floor(place / each).cast("long").alias("batch_id"), (place % each).cast("long").alias("slot"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
