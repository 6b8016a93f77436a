"""Two versions of a layer compared, by key or by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from landloom.functions import geometry as g
from landloom.operators.rules import last_wins
from landloom.operators.spatial import _neighbour_cells, cell
from landloom.session import cut, dealt

METRES = 111000.0


def _slim(df: DataFrame, keys: list[str], attributes: list[str], prefix: str) -> DataFrame:
    """Keys as text, and what the comparison needs, measured before anything moves."""
    rows = df.where(F.col("geom").isNotNull()).withColumns({"_c": g.centroid(F.col("geom")), "_area": g.area(F.col("geom")), "_at": g.bbox(F.col("geom"))})
    c = F.col("_c")
    return rows.select(
        *[F.col(k).cast("string").alias(k) for k in keys],
        F.col("fid").alias(f"{prefix}_fid"),
        F.col("_area").alias(f"{prefix}_area"),
        c["x"].alias(f"{prefix}_x"),
        c["y"].alias(f"{prefix}_y"),
        F.struct(*[F.col(a) if a in df.columns else F.lit(None).alias(a) for a in attributes]).alias(f"{prefix}_a"),
        F.struct("fid", *[F.col(f"_at.{c}").alias(c) for c in ("ymin", "xmin", "ymax", "xmax")], *[F.col(a) for a in attributes if a in df.columns and not isinstance(df.schema[a].dataType, T.MapType)]).alias("_order"),
    )


def match_by_key(old: DataFrame, new: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    """Full outer match on keys as text. Rows with a null key go from both sides; of a key that repeats the row of the greatest fid counts, among rows of one fid that of the greatest box (ymin, xmin, ymax, xmax), then of the greatest attributes."""
    sides = [last_wins(_slim(df, keys, attributes, p), keys, "_order").drop("_order") for df, p in ((old, "old"), (new, "new"))]
    return sides[0].join(sides[1], keys, "full_outer")


def added(matched: DataFrame) -> DataFrame:
    return matched.where("old_fid is null")


def removed(matched: DataFrame) -> DataFrame:
    return matched.where("new_fid is null")


def match_by_proximity(old: DataFrame, new: DataFrame, metres: float, step: float | None = None) -> DataFrame:
    """(old_fid, new_fid): in order of old fid the nearest unused new centroid within the tolerance, ties to the smaller new fid.

    Pairs within the tolerance come from an equi-join on cells of its size. In rounds every old one asks for its nearest new one, and each new one keeps the smallest fid that asks: whoever has a greater fid never gets it,
    as what it keeps only gets smaller, so those pairs go. When no two ask for the same, all have what the order of fids would have given them: it is the one matching in which no pair would both rather have each
    other. Each round is two sums by key and a join, whatever hangs together; chains are settled at once where neighbours want different ones. Null and empty geometries match nothing. With a
    ``step``, in degrees, distances are compared in whole steps, so that the rounding of centroids decides no tie.
    """
    tol = metres / METRES
    side = lambda df: cut(df.select("fid", g.centroid(F.col("geom")).alias("c"))).select("fid", F.col("c.x").alias("x"), F.col("c.y").alias("y")).where("x is not null")
    right = side(new).select(F.col("fid").alias("nf"), F.col("x").alias("nx"), F.col("y").alias("ny"), cell(F.col("x"), tol).alias("cx"), cell(F.col("y"), tol).alias("cy"))
    dist = F.expr("sqrt((x - nx) * (x - nx) + (y - ny) * (y - ny))")
    pairs = cut(_neighbour_cells(side(old), tol).join(dealt(right), ["cx", "cy"]).select(F.col("fid").alias("of"), "nf", dist.alias("d")).where(F.col("d") <= tol).withColumn("d", F.col("d") if step is None else F.floor(F.col("d") / step + 0.5)))
    while True:
        asked = cut(pairs.groupBy("of").agg(F.min(F.struct("d", "nf")).alias("best")).select("of", F.col("best.nf").alias("nf")))
        kept = cut(asked.groupBy("nf").agg(F.min("of").alias("keeps")))
        if asked.count() == kept.count():
            return asked.select(F.col("of").alias("old_fid"), F.col("nf").alias("new_fid"))
        pairs = cut(pairs.join(dealt(kept), "nf", "left").where("keeps is null or of <= keeps").drop("keeps"))


def area_change(old: Column, new: Column) -> Column:
    return F.when(old == 0, 0.0).otherwise((new - old) / old * 100)


def diff_changes(matched: DataFrame, attributes: list[str]) -> DataFrame:
    """Matched rows with area_delta_pct, shift_m, changes (array of name, old, new as text, over the old columns) and status changed or unchanged."""
    both = matched.where("old_fid is not null and new_fid is not null")
    dx, dy = F.col("new_x") - F.col("old_x"), F.col("new_y") - F.col("old_y")
    o, n = (lambda a, p=p: F.col(f"{p}_a.{a}") for p in ("old", "new"))
    differing = [F.struct(F.lit(a).alias("name"), o(a).cast("string").alias("old"), n(a).cast("string").alias("new"), (~o(a).eqNullSafe(n(a))).alias("d")) for a in attributes]
    changes = F.transform(F.filter(F.array(*differing), lambda s: s["d"]), lambda s: F.struct(s["name"].alias("name"), s["old"].alias("old"), s["new"].alias("new")))
    out = both.withColumns({"area_delta_pct": area_change(F.col("old_area"), F.col("new_area")), "shift_m": F.sqrt(dx * dx + dy * dy) * METRES, "changes": changes if attributes else F.array().cast("array<struct<name:string,old:string,new:string>>")})
    same_place = (F.abs("area_delta_pct") < 0.1) & (F.col("shift_m") < 0.5)
    return out.withColumn("same_geometry", same_place).withColumn("status", F.when(same_place & (F.size("changes") == 0), "unchanged").otherwise("changed"))


def diff_summary(old: DataFrame, new: DataFrame, matched: DataFrame, changes: DataFrame) -> DataFrame:
    """One row of counts; old and new count all rows that have a geometry."""
    count = lambda df, name, where="true": df.where(where).agg(F.count("*").alias(name))
    parts = [count(old, "old_count", "geom is not null"), count(new, "new_count", "geom is not null"), matched.agg(F.count_if(F.col("old_fid").isNull()).alias("added"), F.count_if(F.col("new_fid").isNull()).alias("removed")), changes.agg(F.count_if(F.col("status") == "changed").alias("changed"), F.count_if(F.col("status") == "unchanged").alias("unchanged"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p)  # one row each
    return out


def type_guard(old: DataFrame, new: DataFrame) -> DataFrame:
    """(geometry_type, side) of types that only one side has; no rows: the sides may be compared."""
    kinds = lambda df: df.where("geom is not null").select(F.col("geom.type").alias("geometry_type")).distinct()
    o, n = kinds(old), kinds(new)
    return o.exceptAll(n).withColumn("side", F.lit("old")).union(n.exceptAll(o).withColumn("side", F.lit("new")))


def schema_difference(old: DataFrame, new: DataFrame) -> tuple[list[str], list[str]]:
    """Columns of only the old side, and of only the new one (which comparisons leave out)."""
    return [c for c in old.columns if c not in new.columns], [c for c in new.columns if c not in old.columns]


def check_comparable(old: DataFrame, new: DataFrame, old_srid: int, new_srid: int) -> None:
    if old_srid != new_srid:
        raise ValueError(f"snapshots in different coordinate systems: {old_srid} and {new_srid}")
    wrong = [f"{r.geometry_type} ({r.side})" for r in type_guard(old, new).collect()]  # type names
    if wrong:
        raise ValueError(f"geometry types differ: {', '.join(sorted(wrong))}")
