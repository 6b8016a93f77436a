"""The composite jobs that a user starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from landloom.functions import geometry as g, text
from landloom.operators import diff, land, patterns, profiles, rules, sites, spatial, stats
from landloom.session import cut, dealt, spread
from landloom.sources import sinks
from landloom.streaming import landuse

KEY = ["jurisdiction", "parcel_id"]


def reconstruction(base: DataFrame, current: DataFrame, damage: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Status of every parcel of either snapshot. Rows with a null key, and all rows of a key that repeats in a snapshot, which can't be matched for sure, come out as unknown.

    Snapshots hold keys, fid, geom, neighborhood, area_sqm and footprint_area (null: no building).
    """
    no_key = " or ".join(f"{k} is null" for k in keys)
    # Files say little of the size of rows that are made of their keys: without the hints whole sides would be broadcast.
    repeated = base.groupBy(*keys).count().where("count > 1").select(*keys).union(current.groupBy(*keys).count().where("count > 1").select(*keys)).where(f"not ({no_key})").distinct()
    repeated = dealt(cut(repeated))
    lost = [df.where(no_key).unionByName(df.join(repeated, keys, "left_semi")).select(*keys, "neighborhood", F.col("area_sqm").alias("area"), F.lit("unknown").alias("status")) for df in (base, current)]
    base, current = (df.join(repeated, keys, "left_anti") for df in (base, current))
    matched = diff.match_by_key(base, current, keys, ["neighborhood", "area_sqm", "footprint_area"])
    compared = diff.diff_changes(matched, []).select(*keys, "same_geometry")
    worst = land.damage_overlay(base, damage, keys)
    rows = matched.join(dealt(compared), keys, "left").join(dealt(worst), keys, "left")
    status = land.reconstruction_status(F.col("old_fid").isNotNull(), F.col("new_fid").isNotNull(), F.lit(True), F.col("severity"), F.col("old_a.footprint_area"), F.col("new_a.footprint_area"), F.coalesce("same_geometry", F.lit(False)))
    known = rows.select(*keys, F.coalesce("old_a.neighborhood", "new_a.neighborhood").alias("neighborhood"), F.coalesce("new_a.area_sqm", "old_a.area_sqm").alias("area"), status.alias("status"))
    return known.unionByName(lost[0]).unionByName(lost[1]).withColumn("restitution_status", land.restitution(F.col("status")))


def track_reconstruction(base: DataFrame, current: DataFrame, damage: DataFrame, history: DataFrame | None = None, keys: list[str] = KEY, eps_m: float = 3000.0, min_samples: int = 4) -> dict[str, DataFrame]:
    """Status of each parcel, totals by the first key, the neighbourhoods with most damaged or destroyed parcels, clusters of these, and, of a ``history`` (area, snapshot_id, status), rebuilt parcels by snapshot."""
    status = cut(reconstruction(base, current, damage, keys))
    hit = status.where("status in ('damaged', 'destroyed')")
    c = g.centroid(F.col("geom"))
    at = base.join(hit.select(*keys), keys, "left_semi").select("fid", c["x"].alias("x"), c["y"].alias("y"))
    out = {"status": status, "totals": land.status_totals(status, [keys[0], "status"], "area"), "worst": land.top_groups(hit, "neighborhood"), "hot_zones": land.hot_zones(at, F.lit(True), eps_m, min_samples)}
    if history is not None:
        out["velocity"] = land.rebuild_velocity(history)
    return out


def convert_layer(features: DataFrame, target: str, table: str, srid: int = 4326, source_srid: int | None = 4326, layer: str | None = None, ddl: bool = False) -> DataFrame:
    """Rows of text that load a layer: filtered by name, reprojected (documents always to degrees), one statement or document for each feature.

    With ``ddl`` the rows also have a column part, in whose order they run: the statements that make the table and its index come one by one, then what loads it.
    """
    rows = spatial.layer_filter(features, layer).drop("layer") if layer is not None else features
    to = 4326 if target == "mongo" else srid
    rows = rows.withColumn("geom", g.reproject(F.col("geom"), source_srid, to))
    if target == "mongo":
        out = sinks.format_mongo(rows)
    else:
        out = sinks.format_postgis(rows, table) if target == "postgis" else sinks.format_mysql(rows, table, to)
    if not ddl:
        return out
    made = list(enumerate(sinks.emit_ddl(rows.schema, target, table, to)))
    return features.sparkSession.createDataFrame(made, "part int, value string").unionByName(out.select(F.lit(len(made)).alias("part"), "value"))


def inspect_layers(df: DataFrame, samples: int = 3) -> DataFrame:
    """(layer, feature_count, geometry_type, srid, bounds, fields, warnings, samples) of rows with layer, fid, geom and srid."""
    first = stats.first_n(df, "layer", samples).groupBy("layer").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", g.wkt_preview(F.col("geom")).alias("text")))), lambda s: s["text"]).alias("samples"))
    return stats.layer_summary(df).withColumn("warnings", text.crs_warnings(F.col("srid"), F.lit(False))).join(first, "layer", "left")


def layer_statistics(df: DataFrame, columns: list[str], categories: list[str], bins: int = 20) -> dict[str, DataFrame]:
    """Types, quality, duplicates, numeric statistics (those of areas and lengths among them), histograms and categories of a layer."""
    measured = df.where(~g.is_empty(F.col("geom"))).withColumns({"area": F.when(g.is_area(F.col("geom")), g.area(F.col("geom"))), "length": F.when(g.dimension(F.col("geom")) == 1, g.length(F.col("geom")))})
    numbers = [*columns, "area", "length"]
    measured = cut(measured.select(*dict.fromkeys([*numbers, *categories])))  # geometries are measured once
    return {
        "types": stats.geometry_type_counts(df),
        "quality": stats.quality_counts(df),
        "duplicates": stats.duplicate_geometries(df),
        "numeric": stats.numeric_stats(measured, numbers),
        "histograms": stats.histogram(measured, numbers, bins),
        "categories": stats.categorical_stats(measured, categories),
    }


def point_patterns(points: DataFrame, eps_km: float = 1.0, min_samples: int = 5) -> dict[str, DataFrame]:
    """Labels, clusters, nearest-neighbour summary and Clark-Evans ratio of points (fid, x, y in degrees), in metres of their UTM zone; and the points as features that bear their label."""
    metres, srid = patterns.to_metres(points)
    metres = cut(metres)
    labels = cut(patterns.dbscan(metres, eps_km * 1000, min_samples))
    nearest = cut(spatial.nearest_neighbor(metres, eps_km * 1000))
    features = points.join(labels, "fid").select("fid", "cluster_id", g.point(F.col("x"), F.col("y")).alias("geom"))
    return {"labels": labels, "features": features, "clusters": patterns.cluster_summary(metres, labels, srid), "nearest": patterns.nn_summary(nearest), "clark_evans": patterns.clark_evans(metres, nearest)}


def layer_diff(old: DataFrame, new: DataFrame, keys: list[str], attributes: list[str], old_srid: int = 4326, new_srid: int = 4326) -> dict[str, DataFrame]:
    """Matched rows, changes and their summary of two versions; versions of different systems or geometry types are an error."""
    diff.check_comparable(old, new, old_srid, new_srid)
    matched = cut(diff.match_by_key(old, new, keys, attributes))
    changes = cut(diff.diff_changes(matched, attributes))
    return {"matched": matched, "changes": changes, "added": diff.added(matched), "removed": diff.removed(matched), "summary": diff.diff_summary(old, new, matched, changes)}


def check_permits(proposals: DataFrame, permit_rules: DataFrame, fields: list[str], key: str = "proposal_id", at: str | None = None) -> DataFrame:
    """(key, violations, passes, verdict, recommendations) of proposals with parcel_area, zone_code and overlays; with a time ``at`` of the run also its run_id for each proposal's parcel_id.

    Proposals are dealt by key before the rules multiply them, so the results of a proposal meet without another shuffle.
    """
    parts = int(proposals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rules.derive_proposal(proposals).repartition(parts, key)
    results = rules.evaluate(rules.merge_overlays(dealt), permit_rules, fields, key)
    report = rules.permit_report(results, key)
    return report if at is None else report.join(proposals.select(key, rules.run_id(at, F.col("parcel_id")).alias("run_id")), key)


def town_profiles(sections: dict[str, DataFrame], strict: bool = False, parcels: DataFrame | None = None) -> dict[str, DataFrame]:
    """Statistics, headlines and completeness of the sections that there are; the narrative where economy or why_now is among them; and the land section out of
    ``parcels`` (town, area_sqm, use_class, price_per_sqm, for_sale, vacant, serviced) where none is given."""
    if parcels is not None and "land" not in sections:
        sections = sections | {"land": profiles.land_availability(parcels)}
    known = [profiles.profile_stats(df, name, strict) for name, df in sections.items() if name in profiles.FIELDS]
    rows = stats.union_all(known)
    out = {"stats": rows, "headlines": profiles.profile_headlines(rows), "completeness": profiles.section_completeness(rows)}
    if "land" in sections:
        out["land"] = sections["land"]
    if {"economy", "why_now"} <= sections.keys():
        out["narrative"] = profiles.profile_narrative(sections["economy"], sections["why_now"])
    return out


def match_investment_sites(parcels: DataFrame, briefs: DataFrame, layers: DataFrame, criteria: DataFrame, dem: DataFrame | None = None, n: int = 10) -> DataFrame:
    """The best parcels of each brief: matched first, then only those parcels are scored, once each, whatever the number of briefs. A parcel beyond the last bound of a distance's curve needs no search for that."""
    matches = cut(land.match_sites(parcels, briefs))
    wanted = spread(parcels.select(*KEY, "geom").join(dealt(matches.select(*KEY).distinct()), KEY, "left_semi"))
    at = cut(wanted.withColumn("_c", g.centroid(F.col("geom"))).select(F.struct(*KEY).alias("candidate_id"), F.col("_c.x").alias("x"), F.col("_c.y").alias("y"), "geom"))
    scored = sites.site_score(sites.score_criteria(at, layers, criteria, dem, scores_only=True))
    flat = scored.select(*[F.col(f"candidate_id.{k}").alias(k) for k in KEY], "score", "verdict")
    return land.shortlist(matches, flat, n)


def publish_cadastre(parcels: DataFrame, previous: DataFrame | None, folder: str, public_owner_names: bool = False) -> DataFrame | None:
    """Write the public copy; the change log against the copy before, if there is one."""
    sinks.publish_parcels(parcels, folder, public_owner_names)
    if previous is None:
        return None
    public = [text.strip_sensitive(df, public_owner_names=public_owner_names) for df in (previous, parcels)]
    attributes = [c for c in public[0].columns if c not in (*KEY, "geom", "fid")]
    return diff.diff_changes(diff.match_by_key(*public, KEY, attributes), attributes)


def monitor_landuse(current: DataFrame, plan: DataFrame, previous: DataFrame | None, mapping: DataFrame, thresholds: dict[str, int], run: str, snapshots: str | None = None, eps_m: float = 3000.0, min_samples: int = 4) -> dict[str, DataFrame]:
    """Status of each parcel, counts, alerts, the neighbourhoods with most violations and clusters of these; against a previous run, drift by kind.

    With a folder of ``snapshots`` the previous run is the one that was saved there last, unless one is given, and the current one is saved as ``run`` once its status is known.
    """
    if snapshots and previous is None:
        previous = landuse.previous_snapshot(current.sparkSession, snapshots)
    status = cut(land.landuse_status(land.compliance_join(current, plan, previous, mapping, KEY)))
    out = {"status": status, "counts": status.groupBy("status").agg(F.count("*").alias("n")), "alerts": landuse.violation_alerts(status, thresholds, run)}
    # Rows of one key may have different uses, and so different statuses.
    named = status.where("status = 'violation'").select(*[F.col(k).alias(f"_{k}") for k in KEY], F.col("current_use").alias("_use"))
    flagged = cut(current.join(named, F.expr(" and ".join(f"{k} = _{k}" for k in KEY) + " and current_use <=> _use"), "left_semi"))
    c = g.centroid(F.col("geom"))
    out["worst"] = land.top_groups(flagged, "neighborhood")
    out["hot_zones"] = land.hot_zones(flagged.select("fid", c["x"].alias("x"), c["y"].alias("y")), F.lit(True), eps_m, min_samples)
    if previous is not None:
        out["drift"] = land.drift_counts(previous, current, land.parcel_lineage(previous, current, KEY), KEY)
    if snapshots:
        landuse.persist_snapshot(current, snapshots, run)
    return out
