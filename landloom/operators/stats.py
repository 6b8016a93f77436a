"""Layer profiles: one pass over all columns for moments, one over all for ranks and bins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from landloom.functions import geometry as g, text as tx
from landloom.session import cut


def layer_summary(df: DataFrame) -> DataFrame:
    """(layer, feature_count, geometry_type, srid, bounds, fields) of rows with layer, geom and srid; fields are the other columns, which all layers share."""
    fields = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema if f.name not in ("layer", "geom", "srid"))
    b = g.bbox(F.col("geom"))
    return df.groupBy("layer").agg(
        F.count("*").alias("feature_count"),
        F.min("geom.type").alias("geometry_type"),
        F.min("srid").alias("srid"),
        *[f(b[n]).alias(n) for n, f in (("xmin", F.min), ("ymin", F.min), ("xmax", F.max), ("ymax", F.max))],
        F.lit(fields).alias("fields"),
    )


def geometry_type_counts(df: DataFrame) -> DataFrame:
    """(geometry_type, n); null geometries don't count, empty ones do."""
    return df.where(F.col("geom").isNotNull()).groupBy(F.col("geom.type").alias("geometry_type")).agg(F.count("*").alias("n"))


def quality_counts(df: DataFrame) -> DataFrame:
    """One row: invalid (self-crossing, open or short rings) and empty (or null) geometries."""
    flags = g.geometry_flags(F.col("geom"))
    bad = F.arrays_overlap(flags, F.array(*[F.lit(x) for x in ("self_crossing", "ring_not_closed", "short_ring")]))
    return df.agg(F.count_if(bad).alias("invalid"), F.count_if(F.array_contains(flags, "empty")).alias("empty"))


def duplicates(df: DataFrame, key: Column) -> DataFrame:
    """One row: how many rows are further copies of a key; nulls are none. Keys are counted per task before they move."""
    return df.where(key.isNotNull()).groupBy(key.alias("k")).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("copies"))


def duplicate_geometries(df: DataFrame) -> DataFrame:
    """One row: how many geometries are further copies of one with the same type and vertices, to 6 decimals.

    Texts are hashed where they are read: 128 bits and the length move, and no text. Of 10^10 different geometries two share these with a probability below 10^-18.
    """
    text = g.geometry_text(F.col("geom"))
    keys = df.where(F.col("geom").isNotNull()).withColumn("_t", text).select(F.xxhash64("_t").alias("a"), F.xxhash64(F.lit(1), "_t").alias("b"), F.length("_t").alias("n"))
    return duplicates(keys, F.struct("a", "b", "n"))


def long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) for all non-null values of numeric columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(F.inline(pairs)).where("value is not null")


def numeric_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each numeric column: count, min, max, mean, median, population std, 5th and 95th by rank, and values over 3 std from the mean.

    Values are counted by (column, value) once, so repeats move once a task, and all else reads these counts. Columns without values give no row.
    """
    values = cut(long_form(df, columns).groupBy("column", "value").agg(F.count("*").alias("c")))
    moments = values.groupBy("column").agg(
        F.sum("c").alias("count"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        (F.sum(F.col("value") * F.col("c")) / F.sum("c")).alias("mean"),
    )
    moments = cut(moments)  # a row for each column
    centred = values.join(F.broadcast(moments), "column").withColumn("d", F.col("value") - F.col("mean"))
    spread = cut(centred.groupBy("column").agg(F.sqrt(F.sum(F.col("d") * F.col("d") * F.col("c")) / F.sum("c")).alias("std")))
    far = centred.join(F.broadcast(spread), "column").groupBy("column").agg(F.sum(F.when((F.col("std") > 0) & (F.abs("d") > 3 * F.col("std")), F.col("c")).otherwise(0)).alias("outliers"))
    ranks = {}
    for r in moments.select("column", "count", "min", "max").collect():
        n = r["count"]
        ranks[r["column"]] = (r["min"], r["max"], {"m1": (n - 1) // 2, "m2": n // 2, "p5": max(0, int(n * 0.05) - 1), "p95": min(n - 1, int(n * 0.95))})
    at = values_at(values, ranks)
    picked = df.sparkSession.createDataFrame([(c, (at[c, "m1"] + at[c, "m2"]) / 2, at[c, "p5"], at[c, "p95"]) for c in ranks], "column string, median double, p5 double, p95 double")
    return moments.join(spread, "column").join(far, "column").join(F.broadcast(picked), "column").select("column", "count", "min", "max", "mean", "median", "std", "p5", "p95", "outliers")


def values_at(values: DataFrame, ranks: dict[str, tuple[float, float, dict[str, int]]], bins: int = 512) -> dict[tuple[str, str], float]:
    """The value at each rank (from 0) of each column's values (column, value, c times), by rounds that narrow ranges; ``ranks`` has each column's least and greatest value and its ranks by name.

    Of each range ``bins`` parts are counted, and the part that holds the rank is the next round's range, so nothing is sorted. Ranges that stay crowded, as where one value is far from all
    others, are narrow in the next round. The driver sees the counts of these parts only.
    """
    spark = values.sparkSession
    found: dict[tuple[str, str], float] = {}
    left = {(c, name): (lo, hi, k) for c, (lo, hi, names) in ranks.items() for name, k in names.items()}
    while left:
        found |= {at: lo for at, (lo, hi, _) in left.items() if lo == hi}
        left = {at: r for at, r in left.items() if r[0] != r[1]}
        if not left:
            break
        spans = sorted({(c, lo, hi) for (c, _), (lo, hi, _) in left.items()})
        asked = F.broadcast(spark.createDataFrame(spans, "column string, lo double, hi double"))  # a few rows for each column
        part = F.least(F.lit(bins - 1), F.floor((F.col("value") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins))  # halves, as the whole width may be infinite
        counted = values.join(asked, "column").where("value between lo and hi").groupBy("column", "lo", "hi", part.alias("part")).agg(F.sum("c").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
        parts: dict[tuple[str, float, float], list] = {}
        for r in counted.orderBy("part").collect():
            parts.setdefault((r.column, r.lo, r.hi), []).append((r.least, r.most, r.n))
        for (c, name), (lo, hi, k) in list(left.items()):
            for least, most, n in parts[c, lo, hi]:
                if k < n:
                    left[c, name] = (least, most, k)
                    break
                k -= n
    return found


def histogram(df: DataFrame, columns: list[str], bins: int = 20) -> DataFrame:
    """(column, bin, low, high, n) with empty bins kept; a column of one value has one bin."""
    values = long_form(df, columns)
    ends = values.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    ends = F.broadcast(ends.withColumn("width", (F.col("hi") - F.col("lo")) / bins))  # a row for each column
    at = F.when(F.col("width") > 0, F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("lo")) / F.col("width")))).otherwise(0).cast("int")
    counted = values.join(ends, "column").groupBy("column", at.alias("bin")).agg(F.count("*").alias("n"))
    every = ends.withColumn("bin", F.explode(F.when(F.col("width") > 0, F.sequence(F.lit(0), F.lit(bins - 1))).otherwise(F.array(F.lit(0)))))
    edges = every.select("column", "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("high"))
    return edges.join(counted, ["column", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def categorical_stats(df: DataFrame, columns: list[str], top_n: int = 10) -> DataFrame:
    """(column, non_null, distinct, rank, value, n): the most frequent values of each column, ties by value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = df.select(F.inline(pairs)).where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    totals = F.broadcast(counts.groupBy("column").agg(F.sum("n").alias("non_null"), F.count("*").alias("distinct")))  # a row for each column
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= top_n)
    return ranked.join(totals, "column").select("column", "non_null", "distinct", "rank", "value", "n")


def field_range(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, min, max, distinct)."""
    return long_form(df, columns).groupBy("column", "value").agg(F.count("*")).groupBy("column").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("distinct"))


def numeric_columns(df: DataFrame) -> list[str]:
    """By type, so whole numbers of any width are numeric; ids aside."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in ("fid", "srid")]


def entity_counts(entities: DataFrame) -> DataFrame:
    """(layer, total, counts as 'TYPE=n;...', dominant, geometry_name) of each drawing layer; ties by type."""
    each = entities.groupBy("layer", "dxftype").agg(F.count("*").alias("n"))
    names = F.create_map(*[F.lit(v) for pair in tx.ENTITY_GEOMETRY.items() for v in pair])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dxftype", "n"))), lambda s: F.concat_ws("=", s["dxftype"], s["n"].cast("string"))), ";")
    out = each.groupBy("layer").agg(F.sum("n").alias("total"), text.alias("counts"), F.min_by("dxftype", F.struct(-F.col("n"), F.col("dxftype"))).alias("dominant"))
    return out.withColumn("geometry_name", F.coalesce(F.try_element_at(names, F.col("dominant")), F.col("dominant")))


def first_n(df: DataFrame, by: str, n: int = 3, order: str = "fid") -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("nth") <= n)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
