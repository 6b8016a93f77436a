"""Score curves, verdicts and the sentences that explain a criterion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

_c = lambda v: v if isinstance(v, Column) else F.lit(v)


def _span(high: Column, low: Column) -> Column:
    return F.greatest(high - low, F.lit(1e-9))


def score_linear_decreasing(v, ideal, acceptable, unacceptable) -> Column:
    """100 up to ideal, 70 at acceptable, 0 from unacceptable on; null for null."""
    v, i, a, u = map(_c, (v, ideal, acceptable, unacceptable))
    return F.when(v <= i, 100.0).when(v >= u, 0.0).when(v <= a, 100 - 30 * ((v - i) / _span(a, i))).when(v.isNotNull(), 70 - 70 * ((v - a) / _span(u, a)))


def score_linear_increasing(v, unacceptable, acceptable, ideal) -> Column:
    """0 up to unacceptable, 70 at acceptable, 100 from ideal on; null for null."""
    v, u, a, i = map(_c, (v, unacceptable, acceptable, ideal))
    return F.when(v <= u, 0.0).when(v >= i, 100.0).when(v < a, 70 * ((v - u) / _span(a, u))).when(v.isNotNull(), 70 + 30 * ((v - a) / _span(i, a)))


def score_bell(v, low, ideal, high) -> Column:
    """0 at and outside the ends, 100 at ideal; null for null."""
    v, lo, i, hi = map(_c, (v, low, ideal, high))
    return F.when((v <= lo) | (v >= hi), 0.0).when(v < i, 100 * ((v - lo) / _span(i, lo))).when(v.isNotNull(), 100 * ((hi - v) / _span(hi, i)))


def half_up(x: Column, digits: int = 1) -> Column:
    """Rounded so that Spark and other engines agree: floor(x * 10^d + 0.5) / 10^d."""
    p = 10.0**digits
    return F.floor(x * p + 0.5) / p


def curve_score(value: Column, kind: Column, curve: Column, b: Column) -> Column:
    """Score of a measured value under a criterion's curve; ``b`` is its struct of bounds. A curve that the criterion's type doesn't know scores 50."""
    curves = {
        "linear_decreasing": (score_linear_decreasing(value, b["ideal"], b["acceptable"], b["unacceptable"]), ("distance_to_layer", "terrain_stat")),
        "linear_increasing": (score_linear_increasing(value, b["unacceptable"], b["acceptable"], b["ideal"]), ("distance_to_layer", "terrain_stat", "density_count")),
        "bell": (score_bell(value, b["min"], b["ideal"], b["max"]), ("distance_to_layer", "density_count")),
    }
    return reduce(lambda out, item: F.when((curve == item[0]) & kind.isin(*item[1][1]), item[1][0]).otherwise(out), curves.items(), F.lit(50.0))


def verdict(score: Column, recommended=70.0, conditional=50.0) -> Column:
    """On the unrounded score."""
    return F.when(score >= _c(recommended), "RECOMMENDED").when(score >= _c(conditional), "CONDITIONAL").otherwise("NOT RECOMMENDED")


def explain(kind: Column, available: Column, value: Column, layer: Column, units: Column, radius_km: Column, stat: Column) -> Column:
    """Why a criterion has its score."""
    share = F.concat(F.floor(value * 100 + 0.5).cast("string"), F.lit("%"))
    missing = F.when(kind == "terrain_stat", F.when(stat == "elevation_meters", F.lit("DEM not available: neutral 50/100.")).otherwise(F.concat(stat, F.lit(" is not measured: neutral 50/100.")))).otherwise(
        F.concat(F.lit("Layer '"), layer, F.lit("' not available: neutral 50/100."))
    )
    return (
        F.when(~available, missing)
        .when(kind == "distance_to_layer", F.when(value.isNull() | (value == float("inf")), F.concat(F.lit("No feature in "), layer, F.lit("."))).otherwise(F.concat(F.format_string("%.2f", value), F.lit(" "), units, F.lit(" to nearest matching feature ("), layer, F.lit(").")) ))
        .when((kind == "overlap_with_layer") & value.isNull(), F.concat(F.lit("No overlap with "), layer, F.lit(".")))
        .when(kind == "overlap_with_layer", F.concat(F.when(value >= 0.95, "Full").otherwise("Partial"), F.lit(" overlap with "), layer, F.lit(" ("), share, F.lit(").")))
        .when(kind == "density_count", F.concat(value.cast("long").cast("string"), F.lit(" features within "), F.format_string("%.0f", radius_km), F.lit("km of candidate ("), layer, F.lit(").")))
        .when(kind == "terrain_stat", F.concat(F.format_string("%.0f", value), F.lit(" m elevation at centroid.")))
        .otherwise(F.concat(F.lit("Unsupported criterion type '"), kind, F.lit("'.")))
    )
