"""Parcels over time: damage, reconstruction status, land-use compliance, lineage, and matching to investment briefs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from landloom.functions import text as tx
from landloom.operators import patterns as pt, spatial as sp
from landloom.session import dealt

# Severities of damage from light to the worst.
SEVERITY = ("light", "moderate", "severe", "destroyed")
#: Share of the base footprint below which a building counts as destroyed.
LOST = 0.30
#: Uses by zone that a brief's industry may take.
PERMITTED = {"C-1": ("commercial", "retail", "office"), "R-1": ("residential",), "historic-district": ("commercial", "retail", "office", "residential")}


def damage_overlay(parcels: DataFrame, damage: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, severity): the worst severity of the damage polygons (geom, damage_severity) that a parcel meets; others give no row."""
    rank = F.array_position(F.array(*[F.lit(x) for x in SEVERITY]), F.col("damage_severity"))
    right = damage.select(F.struct(rank.alias("rank"), F.col("fid")).alias("b_id"), "geom")
    met = sp.spatial_join(parcels.select(F.struct(*keys).alias("a_id"), "geom"), right)
    worst = met.groupBy("a_id").agg(F.max("b_id.rank").alias("rank"))
    return worst.select(*[F.col(f"a_id.{k}").alias(k) for k in keys], F.element_at(F.array(*[F.lit(x) for x in SEVERITY]), F.col("rank").cast("int")).alias("severity"))


def reconstruction_status(in_base: Column, in_current: Column, key_known: Column, severity: Column, base_area: Column, current_area: Column, footprint_same: Column) -> Column:
    """One of seven statuses, the first that holds: unknown, new_construction, by damage, vacant, destroyed, intact, rebuilt."""
    return (
        F.when(~key_known, "unknown")
        .when(~in_base, "new_construction")
        .when(severity == "destroyed", "destroyed")
        .when(severity.isNotNull(), "damaged")
        .when(in_current & current_area.isNull(), "vacant")
        .when(~in_current | (current_area / base_area < LOST), "destroyed")
        .when(footprint_same, "intact")
        .otherwise("rebuilt")
    )


def restitution(status: Column) -> Column:
    """Destroyed parcels wait for restitution and must not be read as free land."""
    return F.when(status == "destroyed", "awaiting restitution")


def status_totals(rows: DataFrame, by: list[str], area: str) -> DataFrame:
    """(by..., n, area, share) with all subtotals and a grand total (nulls in ``by``); shares are of the grand total's rows."""
    out = rows.rollup(*by).agg(F.count("*").alias("n"), F.sum(area).alias("area"), F.grouping_id().alias("level"))
    total = F.broadcast(rows.agg(F.count("*").alias("all")))  # one row
    return out.join(total).select(*by, "level", "n", "area", (F.col("n") / F.col("all")).alias("share"))


def uses_match(current: Column, plan: Column, parent: Column) -> Column:
    """Equal, or the current use's more general code (from the mapping) is the planned one."""
    return (current == plan) | F.coalesce(parent == plan, F.lit(False))


def compliance_join(current: DataFrame, plan: DataFrame, previous: DataFrame | None, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """Current parcels with designated_use, previous_use (and whether there was one) and the general code of their use. The mapping (use, general_use) is small."""
    out = current.select(*keys, "current_use").join(dealt(plan.select(*keys, "designated_use")), keys, "left")
    if previous is None:
        out = out.withColumns({"previous_use": F.lit(None).cast("string"), "was": F.lit(None).cast("boolean")})
    else:
        out = out.join(dealt(previous.select(*keys, F.col("current_use").alias("previous_use"), F.lit(True).alias("was"))), keys, "left").withColumn("was", F.coalesce("was", F.lit(False)))
    m = F.broadcast(mapping.groupBy("use").agg(F.min("general_use").alias("general_use")))
    return out.join(m, F.col("current_use") == F.col("use"), "left").drop("use")


def landuse_status(rows: DataFrame) -> DataFrame:
    """With column status: no_plan, compliant, nonconforming_unknown_age (no previous run), violation or legacy_nonconforming."""
    c = F.col
    status = (
        F.when(c("designated_use").isNull(), "no_plan")
        .when(F.coalesce(uses_match(c("current_use"), c("designated_use"), c("general_use")), F.lit(False)), "compliant")
        .when(c("was").isNull(), "nonconforming_unknown_age")
        .when(~c("was") | ~c("previous_use").eqNullSafe(c("current_use")), "violation")
        .otherwise("legacy_nonconforming")
    )
    return rows.withColumn("status", status)


def parcel_lineage(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """(kind, keys, n): removed parcels that two or more new ones cover (subdivided), and new ones that cover two or more removed ones (merged).

    Covering means that the overlap is half of the smaller area or more. ``keys``, in order, name a parcel; only parcels whose keys are on one side are compared, and only
    with those that share all keys but the last, such as their jurisdiction.
    """
    gone, come = previous.join(current.select(*keys), keys, "left_anti"), current.join(previous.select(*keys), keys, "left_anti")
    within = [f"_{k}" for k in keys[:-1]]
    side = lambda df, name: df.select(*[F.col(k).alias(f"_{k}") for k in keys[:-1]], F.struct(*keys).alias(name), "geom")
    pairs = sp.overlaps(side(gone, "a_id"), side(come, "b_id"), within)
    close = pairs.where(F.col("overlap") >= 0.5 * F.least("a_area", "b_area"))
    count = lambda by, kind: close.groupBy(F.col(by).alias("parcel")).agg(F.count("*").alias("n")).where("n >= 2").select(F.lit(kind).alias("kind"), "parcel.*", "n")
    return count("a_id", "subdivided").unionByName(count("b_id", "merged"))


def drift_counts(previous: DataFrame, current: DataFrame, lineage: DataFrame, keys: list[str]) -> DataFrame:
    """(kind, n) of changed, new, removed, subdivided and merged parcels."""
    p, c = previous.select(*keys, F.col("current_use").alias("p_use"), F.lit(True).alias("p")), current.select(*keys, F.col("current_use").alias("c_use"), F.lit(True).alias("c"))
    both = p.join(c, keys, "full_outer")
    kind = F.when(F.col("p").isNull(), "new").when(F.col("c").isNull(), "removed").when(~F.col("p_use").eqNullSafe(F.col("c_use")), "changed")
    return both.select(kind.alias("kind")).where("kind is not null").groupBy("kind").agg(F.count("*").alias("n")).unionByName(lineage.groupBy("kind").agg(F.count("*").alias("n")))


def hot_zones(points: DataFrame, flagged: Column, eps_m: float, min_samples: int) -> DataFrame:
    """(fid, cluster_id) of flagged parcels' centroids (fid, x, y in degrees)."""
    metres, _ = pt.to_metres(points.where(flagged).select("fid", "x", "y"))
    return pt.dbscan(metres, eps_m, min_samples)


def top_groups(rows: DataFrame, by: str, n: int = 10) -> DataFrame:
    """(by, n, rank): the n greatest groups by rows, ties sharing a rank and all kept."""
    counts = rows.groupBy(by).agg(F.count("*").alias("n"))
    # Ranks are told by counts of counts: one more than the groups above. Only the n greatest different counts can be ranked, so however many groups tie no task gathers them.
    sizes = counts.groupBy("n").agg(F.count("*").alias("same")).orderBy(F.desc("n")).limit(n)
    above = F.coalesce(F.sum("same").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # n rows at most
    ranked = sizes.select("n", (above + 1).cast("int").alias("rank")).where(F.col("rank") <= n)
    return counts.join(F.broadcast(ranked), "n").select(by, "n", "rank")


def rebuild_velocity(snapshots: DataFrame, area: str = "area") -> DataFrame:
    """(area, snapshot_id, rebuilt, change): rebuilt parcels of each snapshot, and against the one before."""
    n = snapshots.groupBy(area, "snapshot_id").agg(F.count_if(F.col("status") == "rebuilt").alias("rebuilt"))
    return n.withColumn("change", F.col("rebuilt") - F.lag("rebuilt").over(Window.partitionBy(area).orderBy("snapshot_id")))


def consecutive_drift(updates: DataFrame) -> DataFrame:
    """Rows whose use differs from that parcel's use just before: (jurisdiction, parcel_id, ts, event_id, previous_use, observed_use)."""
    before = F.lag("observed_use").over(Window.partitionBy("jurisdiction", "parcel_id").orderBy("ts", "event_id"))
    out = updates.withColumn("previous_use", before).where(F.col("previous_use").isNotNull() & (F.col("previous_use") != F.col("observed_use")))
    return out.select("jurisdiction", "parcel_id", "ts", "event_id", "previous_use", "observed_use")


def match_sites(parcels: DataFrame, briefs: DataFrame) -> DataFrame:
    """(brief_id, jurisdiction, parcel_id, area_sqm, cost, nice): parcels that a brief can use.

    Parcels (zone_code, area_sqm, for_sale, price_per_sqm, utilities, attributes map<string,double>) meet briefs (brief_id, industry,
    required_area_sqm, budget_usd, required_infrastructure, must_have and nice_to_have map<string,string>): the zone permits the industry, the area is
    enough, it is for sale, has the infrastructure, is within the budget, and all must-haves hold. ``nice`` counts the nice-to-haves that hold. Briefs are few and are broadcast.
    """
    zones = F.create_map(*[x for z, uses in PERMITTED.items() for x in (F.lit(z), F.array(*[F.lit(u) for u in uses]))])
    allowed = briefs.withColumn("zone", F.explode(F.array(*[F.lit(z) for z in PERMITTED]))).where(F.array_contains(F.try_element_at(zones, F.col("zone")), F.col("industry")))
    met = parcels.where("for_sale").join(F.broadcast(allowed), F.col("zone_code") == F.col("zone"))
    cost = F.col("area_sqm") * F.col("price_per_sqm")
    fits = lambda entry: F.coalesce(tx.holds(F.try_element_at("attributes", entry["key"]), tx.parse_constraint(entry["value"])), F.lit(False))
    entries = lambda c: F.map_entries(F.coalesce(F.col(c), F.create_map().cast("map<string,string>")))
    good = (F.col("area_sqm") >= F.col("required_area_sqm")) & (cost <= F.col("budget_usd")) & (F.size(F.array_except("required_infrastructure", "utilities")) == 0) & F.forall(entries("must_have"), fits)
    return met.where(good).select("brief_id", "jurisdiction", "parcel_id", "area_sqm", cost.alias("cost"), F.size(F.filter(entries("nice_to_have"), fits)).alias("nice"))


def shortlist(matches: DataFrame, scores: DataFrame, n: int = 10) -> DataFrame:
    """The n best matches of each brief by site score, then nice-to-haves, then key; the first three that are RECOMMENDED are shortlisted."""
    both = matches.join(dealt(scores.select("jurisdiction", "parcel_id", "score", "verdict")), ["jurisdiction", "parcel_id"])
    w = Window.partitionBy("brief_id").orderBy(F.desc("score"), F.desc("nice"), "jurisdiction", "parcel_id")
    best = both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return best.withColumn("shortlisted", (F.col("rank") <= 3) & (F.col("verdict") == "RECOMMENDED"))
