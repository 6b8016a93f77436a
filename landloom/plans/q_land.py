"""Queries of rules, diffs, sites, patterns, land and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from landloom import fixtures as fx
from landloom.functions import geometry as g
from landloom.operators import diff as df_, land as la, patterns as pt, profiles as pr, rules as ru, sites as si, spatial as sp
from landloom.plans.q_functions import _boxes, utm_sql
from landloom.session import dealt, spread
from landloom.sources.rulesets import load_permit_rulesets, load_site_rulesets

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_r = lambda c, n=6: F.round(F.col(c) if isinstance(c, str) else c, n)
KEY = ["jurisdiction", "parcel_id"]
ATTRS = ["zone_code", "area_sqm", "current_use", "for_sale", "owner_name", "tax_value", "footprint_area"]
FIELDS = ["use", "height_m", "setback_front_m", "setback_side_m", "setback_rear_m", "parking_spaces", "facade_material", "includes_demolition", "gross_floor_area_sqm", "lot_coverage_pct", "open_space_pct", "FAR", "units", "parcel_area_sqm"]


# --- diff ---------------------------------------------------------------------------------------------------------------

_O = "SELECT *, (x1 - x0) * (y1 - y0) AS area, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM"
_SIDES = f"{fx.duck('parcels_old', 'parcels_new')}, o AS ({_O} parcels_old), n AS ({_O} parcels_new)"
# Of a key that repeats the row of the greatest fid counts, then that of the greatest box, then of the greatest attributes.
_ONE = f"QUALIFY row_number() OVER (PARTITION BY jurisdiction, parcel_id ORDER BY fid DESC, y0 DESC, x0 DESC, y1 DESC, x1 DESC, {', '.join(f'{a} DESC NULLS LAST' for a in ATTRS)}) = 1"
_KEYED = f"{_SIDES}, ok AS (SELECT * FROM o {_ONE}), nk AS (SELECT * FROM n {_ONE})"
_DIFFS = " || ".join(f"CASE WHEN o.{a} IS DISTINCT FROM n.{a} THEN '{a},' ELSE '' END" for a in ATTRS)
_CHANGES = f"""{_KEYED}, c AS (SELECT o.jurisdiction, o.parcel_id, o.neighborhood, (n.area - o.area) / o.area * 100 AS d, sqrt(pow(n.cx - o.cx, 2) + pow(n.cy - o.cy, 2)) * 111000 AS m, {_DIFFS} AS names FROM ok o JOIN nk n ON o.jurisdiction = n.jurisdiction AND o.parcel_id = n.parcel_id),
s AS (SELECT *, abs(d) < 0.1e0 AND m < 0.5e0 AS same, CASE WHEN abs(d) < 0.1e0 AND m < 0.5e0 AND names = '' THEN 'unchanged' ELSE 'changed' END AS status FROM c)"""


def _pair(s, d):
    old, new = _boxes(s, d), _boxes(s, d, "parcels_new")
    return old, new, df_.match_by_key(old, new, KEY, ATTRS)


@query(f"{_KEYED} SELECT coalesce(o.jurisdiction, n.jurisdiction) AS jurisdiction, coalesce(o.parcel_id, n.parcel_id) AS parcel_id, o.fid AS old_fid, n.fid AS new_fid FROM ok o FULL JOIN nk n ON o.jurisdiction = n.jurisdiction AND o.parcel_id = n.parcel_id")
def j07_match_by_key(s, d):
    return _pair(s, d)[2].select(*KEY, "old_fid", "new_fid")


# Rounds: each old one asks for its nearest (in whole billionths of a degree, ties to the smaller fid), each new one keeps the smallest fid that asks, and pairs of greater fids go; the last round is that in which none goes.
_ROUNDS = f"""WITH RECURSIVE {_SIDES[5:]}, cells AS (SELECT fid, cx, cy, CAST(floor(cx / (5 / 111000e0)) AS BIGINT) + dx AS gx, CAST(floor(cy / (5 / 111000e0)) AS BIGINT) + dy AS gy FROM o CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dx) AS a CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dy) AS b),
p AS (SELECT old_fid, new_fid, CAST(floor(d / 1e-9 + 0.5e0) AS BIGINT) AS d FROM (SELECT c.fid AS old_fid, n.fid AS new_fid, sqrt(pow(n.cx - c.cx, 2) + pow(n.cy - c.cy, 2)) AS d FROM cells c JOIN n ON c.gx = CAST(floor(n.cx / (5 / 111000e0)) AS BIGINT) AND c.gy = CAST(floor(n.cy / (5 / 111000e0)) AS BIGINT)) AS t WHERE d <= 5 / 111000e0),
r AS (SELECT CAST(0 AS BIGINT) AS turn, old_fid, new_fid, d FROM p UNION ALL SELECT turn + 1, old_fid, new_fid, d FROM (SELECT *, count(*) FILTER (WHERE old_fid > keeps) OVER () AS gone FROM (SELECT *, min(old_fid) FILTER (WHERE nth = 1) OVER (PARTITION BY new_fid) AS keeps FROM (SELECT *, row_number() OVER (PARTITION BY old_fid ORDER BY d, new_fid) AS nth FROM r) AS a) AS b) AS c WHERE gone > 0 AND old_fid <= coalesce(keeps, old_fid))"""


@query(f"{_ROUNDS} SELECT old_fid, new_fid FROM (SELECT *, row_number() OVER (PARTITION BY old_fid ORDER BY d, new_fid) AS nth FROM r WHERE turn = (SELECT max(turn) FROM r)) AS t WHERE nth = 1")
def j08_match_by_proximity(s, d):
    # Centroids take long work and the files are small.
    old, new = (spread(fx.table(s, d, t)).withColumn("geom", g.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))) for t in ("parcels_old", "parcels_new"))
    return df_.match_by_proximity(old, new, 5.0, 1e-9)


@query(f"{_SIDES} SELECT n.jurisdiction, n.parcel_id, 'added' AS side FROM n ANTI JOIN o ON o.jurisdiction = n.jurisdiction AND o.parcel_id = n.parcel_id UNION ALL SELECT o.jurisdiction, o.parcel_id, 'removed' FROM o ANTI JOIN n ON o.jurisdiction = n.jurisdiction AND o.parcel_id = n.parcel_id")
def j17_added_removed(s, d):
    m = _pair(s, d)[2]
    return df_.added(m).select(*KEY, F.lit("added").alias("side")).union(df_.removed(m).select(*KEY, F.lit("removed").alias("side")))


@query(f"{_CHANGES} SELECT jurisdiction, parcel_id, round(d, 5) AS area_delta_pct, round(m, 4) AS shift_m, names, status FROM s")
def a22_diff_changes(s, d):
    c = df_.diff_changes(_pair(s, d)[2], ATTRS)
    names = F.array_join(F.transform("changes", lambda x: F.concat(x["name"], F.lit(","))), "")
    return c.select(*KEY, _r("area_delta_pct", 5).alias("area_delta_pct"), _r("shift_m", 4).alias("shift_m"), names.alias("names"), "status")


@query(f"""{_CHANGES} SELECT (SELECT count(*) FROM o) AS old_count, (SELECT count(*) FROM n) AS new_count, (SELECT count(*) FROM nk n ANTI JOIN ok o ON o.jurisdiction = n.jurisdiction AND o.parcel_id = n.parcel_id) AS added,
  (SELECT count(*) FROM ok o ANTI JOIN nk n ON o.jurisdiction = n.jurisdiction AND o.parcel_id = n.parcel_id) AS removed, (SELECT count(*) FROM s WHERE status = 'changed') AS changed, (SELECT count(*) FROM s WHERE status = 'unchanged') AS unchanged""")
def a23_diff_summary(s, d):
    old, new, m = _pair(s, d)
    return df_.diff_summary(old, new, m, df_.diff_changes(m, ATTRS))


@query(f"{fx.duck('use_updates')} SELECT jurisdiction, parcel_id, event_id, observed_use FROM (SELECT *, row_number() OVER (PARTITION BY jurisdiction, parcel_id ORDER BY event_id DESC) AS k FROM use_updates) AS t WHERE k = 1")
def w06_last_wins(s, d):
    return ru.last_wins(fx.table(s, d, "use_updates"), KEY, "event_id").select(*KEY, "event_id", "observed_use")


@query(f"{fx.duck('parcels_old')} SELECT 'Point' AS geometry_type, 'new' AS side FROM parcels_old LIMIT 1")
def u02_type_guard(s, d):
    new = _boxes(s, d, "parcels_new")
    mixed = new.withColumn("geom", F.when(F.col("fid") % 5 == 0, g.point(F.col("x0"), F.col("y0"))).otherwise(F.col("geom")))
    return df_.type_guard(_boxes(s, d), mixed)


@query(f"{_CHANGES} SELECT jurisdiction, parcel_id FROM s WHERE status = 'changed' ORDER BY jurisdiction, parcel_id LIMIT 20")
def t03_first_changes(s, d):
    c = df_.diff_changes(_pair(s, d)[2], ATTRS)
    return c.where("status = 'changed'").orderBy(*KEY).limit(20).select(*KEY)


@query(f"{fx.duck('facilities', 'points')} SELECT layer_key, fid, x FROM (SELECT layer_key, fid, x FROM facilities WHERE layer_key <> 'osm:place=city|town' UNION ALL SELECT 'osm:place=city|town', fid, x FROM points) AS t")
def u01_merge_layers(s, d):
    f, p = fx.table(s, d, "facilities"), fx.table(s, d, "points")
    geom = lambda t: t.withColumn("geom", g.point(F.col("x"), F.col("y")))
    m = si.merge_layers([geom(f), geom(p).withColumn("layer_key", F.lit("osm:place=city|town"))])
    return m.select("layer_key", "fid", F.col("geom.parts")[0][0][0]["x"].alias("x"))


# --- permits ------------------------------------------------------------------------------------------------------------


def _proposals(s, d):
    p = fx.table(s, d, "proposals").withColumn("overlays", F.when(F.col("overlay"), F.array(F.lit("historic-district"))))
    return ru.derive_proposal(p, "parcel_area")


def _results(s, d):
    return ru.evaluate(ru.merge_overlays(_proposals(s, d)), load_permit_rulesets(s), FIELDS)


_DERIVED = f"""{fx.duck('proposals')}, q AS (SELECT *, coalesce(parcel_area, 0) AS a FROM proposals), v AS (SELECT *, CASE WHEN a > 0 THEN footprint_sqm / a * 100 END AS cover, CASE WHEN a > 0 THEN 100 - footprint_sqm / a * 100 END AS open, CASE WHEN a > 0 THEN gross_floor_area_sqm / a END AS far, ceil(gross_floor_area_sqm / 80) AS units FROM q)"""
# The bundled rules, retyped: zone, number, name, what must hold, and the advice where it doesn't.
_USES = {"R-1": "residential, single_family, mixed_use_residential", "C-1": "commercial, retail, office, restaurant, mixed_use, mixed_use_commercial", "historic-district": "residential, commercial, retail, restaurant, office, mixed_use, cultural, museum, gallery"}
_LESS = lambda f, v: f"Reduce {f} to {v} or apply for a variance."
_MORE = lambda f, v: f"Increase {f} to {v} or apply for a variance."
_IN = lambda f, allowed: f"{f} IN ({', '.join(repr(v) for v in allowed.split(', '))})"
_RULE_ROWS = [
    ("R-1", "allowed_use", _IN("use", _USES["R-1"]), f"Change use to one of: {_USES['R-1']}."), ("R-1", "max_height_m", "height_m <= 10", _LESS("height_m", 10)), ("R-1", "max_lot_coverage_pct", "cover <= 35", _LESS("lot_coverage_pct", 35)), ("R-1", "max_FAR", "far <= 0.6e0", _LESS("FAR", 0.6)),
    ("R-1", "min_setback_front_m", "setback_front_m >= 5", _MORE("setback_front_m", 5)), ("R-1", "min_setback_side_m", "setback_side_m >= 2", _MORE("setback_side_m", 2)), ("R-1", "min_setback_rear_m", "setback_rear_m >= 3", _MORE("setback_rear_m", 3)), ("R-1", "min_parcel_size_sqm", "a >= 300", _MORE("parcel_area_sqm", 300)),
    ("R-1", "min_open_space_pct", "open >= 50", _MORE("open_space_pct", 50)), ("R-1", "min_parking_per_unit", "parking_spaces / units >= 1", "Raise the count of min_parking_per_unit to meet ≥ 1 per units."),
    ("C-1", "allowed_use", _IN("use", _USES["C-1"]), f"Change use to one of: {_USES['C-1']}."), ("C-1", "max_height_m", "height_m <= 15", _LESS("height_m", 15)), ("C-1", "max_lot_coverage_pct", "cover <= 70", _LESS("lot_coverage_pct", 70)), ("C-1", "max_FAR", "far <= 1.5e0", _LESS("FAR", 1.5)),
    ("C-1", "min_setback_front_m", "setback_front_m >= 0", _MORE("setback_front_m", 0)), ("C-1", "min_setback_side_m", "setback_side_m >= 0", _MORE("setback_side_m", 0)), ("C-1", "min_setback_rear_m", "setback_rear_m >= 3", _MORE("setback_rear_m", 3)),
    ("C-1", "min_parking_per_100sqm_commercial", "parking_spaces / gross_floor_area_sqm >= 0.03e0", "Raise the count of min_parking_per_100sqm_commercial to meet ≥ 0.03 per gross_floor_area_sqm."),
    ("historic-district", "allowed_use", _IN("use", _USES["historic-district"]), f"Change use to one of: {_USES['historic-district']}."), ("historic-district", "max_height_m", "height_m <= 12", _LESS("height_m", 12)),
    ("historic-district", "required_material_check", _IN("facade_material", "stone, brick, plaster, wood, traditional_render"), "Change facade_material to one of: stone, brick, plaster, wood, traditional_render."), ("historic-district", "demolition_request", "NOT includes_demolition", "Change includes_demolition to one of: false, no, partial_with_review."),
    ("historic-district", "max_facade_alteration_pct", "false", _LESS("facade_alteration_pct", 30)), ("historic-district", "window_pattern_preserved", "false", "Change window_pattern_change to one of: false, no, minor."), ("historic-district", "max_signage_area_sqm", "false", _LESS("signage_area_sqm", 2)),
]
_RULES = """, e AS (SELECT v.*, p.part, p.z FROM v, LATERAL (SELECT 0 AS part, zone_code AS z UNION ALL SELECT 1, 'historic-district' WHERE overlay AND zone_code <> 'historic-district') AS p), r AS (
 """ + "\n UNION ALL ".join(f"SELECT proposal_id, z, part, {no} AS no, '{name}' AS name, coalesce({holds}, false) AS passed, '{text}' AS text FROM e WHERE z = '{zone}'" for no, (zone, name, holds, text) in enumerate(_RULE_ROWS)) + ")"


@query(f"{_DERIVED} SELECT proposal_id, round(cover, 6) AS lot_coverage_pct, round(open, 6) AS open_space_pct, round(far, 6) AS far, units, a AS parcel_area_sqm FROM v")
def p26_derive_proposal(s, d):
    t = _proposals(s, d)
    return t.select("proposal_id", _r("lot_coverage_pct").alias("lot_coverage_pct"), _r("open_space_pct").alias("open_space_pct"), _r("FAR").alias("far"), "units", "parcel_area_sqm")


@query(f"{fx.duck('proposals')} SELECT proposal_id, round(CASE WHEN proposal_id % 2 = 0 THEN height_m * 0.3048e0 ELSE height_m END, 9) AS height_m, round(CASE WHEN proposal_id % 2 = 0 THEN footprint_sqm * 0.09290304e0 ELSE footprint_sqm END, 9) AS footprint_sqm FROM proposals")
def p27_to_si(s, d):
    t = fx.table(s, d, "proposals").select("proposal_id", "height_m", "footprint_sqm").withColumn("units", F.when(F.col("proposal_id") % 2 == 0, "Imperial").otherwise("metric"))
    return ru.to_si(t).select("proposal_id", _r("height_m", 9).alias("height_m"), _r("footprint_sqm", 9).alias("footprint_sqm"))


@query(f"{_DERIVED}{_RULES} SELECT proposal_id, name, count(*) AS n, CAST(count(*) FILTER (WHERE passed) AS BIGINT) AS passes FROM r GROUP BY 1, 2")
def r01_r07_rules(s, d):
    return _results(s, d).groupBy("proposal_id", "name").agg(F.count("*").alias("n"), F.count_if("passed").alias("passes"))


@query(f"""{fx.duck('proposals')} SELECT proposal_id, CAST(CASE WHEN setback_front_m IS NULL OR setback_front_m < 3 THEN 1 ELSE 0 END + CASE WHEN setback_side_m IS NULL OR setback_side_m < 1 THEN 1 ELSE 0 END AS INTEGER) AS failing,
  CASE WHEN height_m IS NULL OR height_m < 6 OR height_m > 14 THEN false ELSE true END AS in_range, false AS odd FROM proposals""")
def r03_r06_range_and_setbacks(s, d):
    """Ranges, setback checks and an unknown type, which no bundled ruleset holds."""
    from landloom.sources.rulesets import RULE

    base = {"jurisdiction": "generic-starter", "ruleset": "own", "field": None, "limit": None, "low": None, "high": None, "allowed": None, "denominator": None, "ratio": None, "fields": None, "limits": None, "citation": ""}
    rows = []
    for z in ("R-1", "C-1", "historic-district"):
        rows += [base | {"zone_code": z, "rule_no": 0, "name": "range", "type": "range", "field": "height_m", "low": 6.0, "high": 14.0}, base | {"zone_code": z, "rule_no": 1, "name": "setbacks", "type": "setback_check", "fields": {"front": "setback_front_m", "side": "setback_side_m"}, "limits": {"front": 3.0, "side": 1.0}}, base | {"zone_code": z, "rule_no": 2, "name": "odd", "type": "custom_python"}]
    res = ru.evaluate(fx.table(s, d, "proposals").withColumn("part", F.lit(0)), s.createDataFrame(rows, RULE), ["height_m", "setback_front_m", "setback_side_m"])
    of = lambda n, c: F.max(F.when(F.col("name") == n, F.col(c)))
    t = res.groupBy("proposal_id").agg(of("setbacks", "detail").alias("detail"), of("range", "passed").alias("in_range"), of("odd", "passed").alias("odd"))
    return t.select("proposal_id", F.when(F.col("detail") == "", 0).otherwise(F.size(F.split("detail", "; "))).alias("failing"), "in_range", "odd")


@query(f"{fx.duck('parcels_old')} SELECT parcel_id, CASE WHEN jurisdiction = 'town-1' AND zone_code = 'R-1' THEN 'town-1' WHEN zone_code = 'unzoned' THEN NULL ELSE 'generic-starter' END AS \"from\" FROM (SELECT parcel_id, jurisdiction, CASE WHEN fid % 7 = 0 THEN 'unzoned' ELSE zone_code END AS zone_code FROM parcels_old) AS t")
def j09_resolve_ruleset(s, d):
    rules = load_permit_rulesets(s)
    own = rules.where("zone_code = 'R-1'").withColumn("jurisdiction", F.lit("town-1"))
    t = fx.table(s, d, "parcels_old").select("fid", *KEY, F.when(F.col("fid") % 7 == 0, "unzoned").otherwise(F.col("zone_code")).alias("zone_code"))
    return ru.resolve_ruleset(t, rules.unionByName(own)).select("parcel_id", "from")


@query(f"{fx.duck('parcels_old')} SELECT parcel_id, zone_code AS base_zone, CAST(0 AS INTEGER) AS part, zone_code FROM parcels_old UNION ALL SELECT parcel_id, zone_code, 1, 'historic-district' FROM parcels_old WHERE overlay AND zone_code <> 'historic-district'")
def j10_merge_overlays(s, d):
    t = fx.table(s, d, "parcels_old").withColumn("overlays", F.when(F.col("overlay"), F.array(F.lit("historic-district"))))
    return ru.merge_overlays(t).select("parcel_id", "base_zone", "part", "zone_code")


@query(f"{_DERIVED}{_RULES} SELECT proposal_id, count(*) FILTER (WHERE NOT passed) AS violations, count(*) FILTER (WHERE passed) AS passes, CASE WHEN bool_and(passed) THEN 'COMPLIANT' ELSE 'NON-COMPLIANT' END AS verdict FROM r GROUP BY proposal_id")
def a16_permit_verdict(s, d):
    return ru.permit_verdict(_results(s, d))


@query(f"{_DERIVED}{_RULES} SELECT proposal_id, coalesce(string_agg(text, '|' ORDER BY part, no) FILTER (WHERE NOT passed), '') AS recommendations FROM r GROUP BY proposal_id")
def a17_permit_recommendations(s, d):
    return ru.permit_recommendations(_results(s, d)).select("proposal_id", F.array_join("recommendations", "|").alias("recommendations"))


# --- sites --------------------------------------------------------------------------------------------------------------

_SPHERE = lambda a, b: f"2 * 6371008.8e0 * asin(sqrt(pow(sin(radians({b}.y - {a}.y) / 2), 2) + cos(radians({a}.y)) * cos(radians({b}.y)) * pow(sin(radians({b}.x - {a}.x) / 2), 2)))"


def site_layers(s, d):
    f = fx.table(s, d, "facilities")
    p = _boxes(s, d, "protected").select(F.lit("natural_earth:protected_areas").alias("layer_key"), "fid", "geom")
    return f.select("layer_key", "fid", g.point(F.col("x"), F.col("y")).alias("geom")).unionByName(p)


def site_candidates(s, d):
    p = fx.table(s, d, "points")
    return p.select(F.col("fid").alias("candidate_id"), "x", "y", g.point(F.col("x"), F.col("y")).alias("geom"))


_DIST = f"dist AS (SELECT p.fid AS candidate_id, f.layer_key, min({_SPHERE('p', 'f')}) AS metres FROM points p JOIN facilities f ON true GROUP BY 1, 2)"


@query(f"{fx.duck('points', 'facilities')}, {_DIST} SELECT candidate_id, layer_key, round(metres, 2) AS metres FROM dist")
def j01_nearest_distance(s, d):
    layers = site_layers(s, d).where("layer_key <> 'natural_earth:protected_areas'")
    return si.nearest_distance(site_candidates(s, d), layers, sphere=True).select("candidate_id", "layer_key", _r("metres", 2).alias("metres"))


@query(f"{fx.duck('points', 'roads')} SELECT p.fid AS candidate_id, 'roads' AS layer_key, round(min(abs(p.y - r.y)) * radians(1) * 6371008.8e0, 2) AS metres FROM points p JOIN roads r ON true GROUP BY 1")
def j01_nearest_distance_to_lines(s, d):
    r = fx.table(s, d, "roads")
    layer = r.select(F.lit("roads").alias("layer_key"), "fid", g.line((r.x0, r.y), (r.x1, r.y)).alias("geom"))
    return si.nearest_distance(site_candidates(s, d), layer, sphere=True).select("candidate_id", "layer_key", _r("metres", 2).alias("metres"))


_GAP = "sqrt(pow(greatest(0, b.x0 - a.x1, a.x0 - b.x1), 2) + pow(greatest(0, b.y0 - a.y1, a.y0 - b.y1), 2))"


@query(f"{fx.duck('parcels_old', 'facilities')}, b AS (SELECT fid, layer_key, x AS x0, y AS y0, x AS x1, y AS y1 FROM facilities), n AS (SELECT a.fid AS candidate_id, b.layer_key, min({_SPHERE('u', 'v')}) AS metres FROM (SELECT * FROM parcels_old) a JOIN b ON true, LATERAL (SELECT greatest(a.x0, least(a.x1, b.x0)) AS x, greatest(a.y0, least(a.y1, b.y0)) AS y) u, LATERAL (SELECT b.x0 AS x, b.y0 AS y) v GROUP BY 1, 2) SELECT candidate_id, layer_key, round(metres, 2) AS metres FROM n")
def j01_nearest_distance_of_polygons(s, d):
    """From the edge of each parcel; 0 where the feature is in it."""
    layers = site_layers(s, d).where("layer_key <> 'natural_earth:protected_areas'")
    return si.nearest_distance(_boxes(s, d).select(F.col("fid").alias("candidate_id"), "geom"), layers, sphere=True).select("candidate_id", "layer_key", _r("metres", 2).alias("metres"))


@query(f"""{fx.duck('parcels_old', 'protected')} SELECT a.fid AS candidate_id, 'p' AS layer_key, round(max((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / ((a.x1 - a.x0) * (a.y1 - a.y0))), 8) AS share FROM parcels_old a JOIN protected b ON a.x1 >= b.x0 AND a.x0 <= b.x1 AND a.y1 >= b.y0 AND a.y0 <= b.y1 GROUP BY 1""")
def j02_overlap_share(s, d):
    layer = _boxes(s, d, "protected").select(F.lit("p").alias("layer_key"), "fid", "geom")
    return si.overlap_share(_boxes(s, d).select(F.col("fid").alias("candidate_id"), "geom"), layer).select("candidate_id", "layer_key", _r("share", 8).alias("share"))


@query(f"{fx.duck('points', 'dem')} SELECT p.fid AS candidate_id, e.elevation FROM points p LEFT JOIN dem e ON e.cell_x = CAST(floor((p.x - 36) / 0.01e0) AS BIGINT) AND e.cell_y = CAST(floor((p.y - 33) / 0.01e0) AS BIGINT)")
def a15_terrain_elevation(s, d):
    return si.terrain_elevation(site_candidates(s, d), fx.table(s, d, "dem"))


_DEC = lambda v, i, a, u: f"CASE WHEN {v} <= {i} THEN 100 WHEN {v} >= {u} THEN 0 WHEN {v} <= {a} THEN 100 - 30 * (({v} - {i}) / ({a} - {i})) ELSE 70 - 70 * (({v} - {a}) / ({u} - {a})) END"
_INC = lambda v, u, a, i: f"CASE WHEN {v} <= {u} THEN 0 WHEN {v} >= {i} THEN 100 WHEN {v} < {a} THEN 70 * (({v} - {u}) / ({a} - {u})) ELSE 70 + 30 * (({v} - {a}) / ({i} - {a})) END"
_BELL = lambda v, lo, i, hi: f"CASE WHEN {v} <= {lo} OR {v} >= {hi} THEN 0 WHEN {v} < {i} THEN 100 * (({v} - {lo}) / ({i} - {lo})) ELSE 100 * (({hi} - {v}) / ({hi} - {i})) END"
_HALF = lambda x: f"floor(({x}) * 10.0e0 + 0.5e0) / 10.0e0"
_AIRPORT = f"""{fx.duck('points', 'facilities', 'protected', 'dem')}, {_DIST},
k AS (SELECT p.fid AS candidate_id, p.x, p.y, road.metres / 1000 AS road, city.metres / 1000 AS city, port.metres / 1000 AS port, water.metres / 1000 AS water, e.elevation, EXISTS (SELECT 1 FROM protected b WHERE p.x BETWEEN b.x0 AND b.x1 AND p.y BETWEEN b.y0 AND b.y1) AS hit
  FROM points p JOIN dist road ON road.candidate_id = p.fid AND road.layer_key LIKE 'osm:highway%' JOIN dist city ON city.candidate_id = p.fid AND city.layer_key LIKE 'osm:place%' JOIN dist port ON port.candidate_id = p.fid AND port.layer_key LIKE 'osm:aero%' JOIN dist water ON water.candidate_id = p.fid AND water.layer_key LIKE 'osm:water%'
  LEFT JOIN dem e ON e.cell_x = CAST(floor((p.x - 36) / 0.01e0) AS BIGINT) AND e.cell_y = CAST(floor((p.y - 33) / 0.01e0) AS BIGINT)),
c AS (SELECT candidate_id, 0 AS no, 'terrain_slope' AS name, 20 AS w, 50e0 AS score FROM k UNION ALL SELECT candidate_id, 1, 'usable_flat_area', 15, 50e0 FROM k UNION ALL SELECT candidate_id, 2, 'distance_to_major_road', 10, {_HALF(_DEC('road', 2, 15, 50))} FROM k
 UNION ALL SELECT candidate_id, 3, 'distance_to_nearest_city', 10, {_HALF(_BELL('city', 15, 30, 80))} FROM k UNION ALL SELECT candidate_id, 4, 'protected_area_conflict', 15, CASE WHEN hit THEN 0e0 ELSE 100e0 END FROM k UNION ALL SELECT candidate_id, 5, 'existing_airport_proximity', 15, {_HALF(_INC('port', 0, 30, 80))} FROM k
 UNION ALL SELECT candidate_id, 6, 'flood_risk', 10, CASE WHEN elevation IS NULL THEN 50e0 ELSE {_HALF(_INC('elevation', 0, 100, 500))} END FROM k UNION ALL SELECT candidate_id, 7, 'distance_to_water', 5, {_HALF(_BELL('water', 1, 5, 30))} FROM k)"""


def _airport(s, d):
    rules = load_site_rulesets(s).where("ruleset = 'airport'")
    return si.score_criteria(site_candidates(s, d), site_layers(s, d), rules, fx.table(s, d, "dem"), sphere=True)


@query(f"{_AIRPORT} SELECT candidate_id, name, round(score, 1) AS score FROM c")
def a13_criterion_scores(s, d):
    return _airport(s, d).select("candidate_id", "name", _r("score", 1).alias("score"))


@query(f"{_AIRPORT} SELECT candidate_id, round(sum(score * w) / sum(w), 4) AS score, CASE WHEN sum(score * w) / sum(w) >= 70 THEN 'RECOMMENDED' WHEN sum(score * w) / sum(w) >= 50 THEN 'CONDITIONAL' ELSE 'NOT RECOMMENDED' END AS verdict FROM c GROUP BY candidate_id")
def a13_site_score(s, d):
    return si.site_score(_airport(s, d)).select("candidate_id", _r("score", 4).alias("score"), "verdict")


@query(f"{_AIRPORT}, r AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY score, no) AS nth FROM c) SELECT candidate_id, CAST(count(*) FILTER (WHERE nth <= 3 AND score < 60) AS INTEGER) AS n, string_agg(name, ',' ORDER BY nth) FILTER (WHERE nth <= 3) AS weakest FROM r GROUP BY candidate_id")
def a14_site_recommendations(s, d):
    """With W1, the weakest criteria."""
    scored = _airport(s, d)
    weak = si.weakest_criteria(scored).groupBy("candidate_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "name"))), lambda x: x["name"]), ",").alias("weakest"))
    return si.site_recommendations(scored).select("candidate_id", F.size("recommendations").alias("n")).join(weak, "candidate_id")


@query(f"{_AIRPORT} SELECT candidate_id, printf('%.2f', road) || ' km to nearest matching feature (osm:highway=motorway|trunk|primary).' AS road_why, CASE WHEN hit THEN 'Full overlap with natural_earth:protected_areas (100%).' ELSE 'No overlap with natural_earth:protected_areas.' END AS overlap_why FROM k")
def p33_explain_criterion(s, d):
    w = lambda n, a: F.max(F.when(F.col("name") == n, F.col("why"))).alias(a)
    return _airport(s, d).groupBy("candidate_id").agg(w("distance_to_major_road", "road_why"), w("protected_area_conflict", "overlap_why"))


# --- patterns -----------------------------------------------------------------------------------------------------------

_M = f"{fx.duck('points')}, m AS (SELECT fid, x * 100000 AS x, y * 100000 AS y FROM points), nn AS (SELECT a.fid, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS dist FROM m a JOIN m b ON a.fid <> b.fid GROUP BY a.fid)"


def _plane(s, d):
    return fx.table(s, d, "points").select("fid", (F.col("x") * 100000).alias("x"), (F.col("y") * 100000).alias("y"))


@query(f"{_M} SELECT round(avg(dist), 4) AS mean, round(median(dist), 4) AS median, round(stddev_pop(dist), 4) AS std FROM nn")
def a18_nn_summary(s, d):
    return pt.nn_summary(sp.nearest_neighbor(_plane(s, d), 2000.0)).select(*[_r(c, 4).alias(c) for c in ("mean", "median", "std")])


@query(f"{_M}, r AS (SELECT count(*) AS n, (SELECT avg(dist) FROM nn) / (0.5e0 / sqrt(count(*) / ((max(x) - min(x)) * (max(y) - min(y))))) AS r FROM m) SELECT n, round(r, 6) AS r, CASE WHEN r < 0.7e0 THEN 'strongly clustered' WHEN r < 0.95e0 THEN 'moderately clustered' WHEN r < 1.05e0 THEN 'random' WHEN r < 1.3e0 THEN 'moderately dispersed' ELSE 'strongly dispersed' END AS interpretation FROM r")
def a19_clark_evans(s, d):
    p = _plane(s, d)
    return pt.clark_evans(p, sp.nearest_neighbor(p, 2000.0)).withColumn("r", _r("r"))


_DB = """WITH RECURSIVE {m}, e AS (SELECT a.fid AS a, b.fid AS b FROM m a JOIN m b ON sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 150), core AS (SELECT a AS fid FROM e GROUP BY a HAVING count(*) >= 8),
ce AS (SELECT a, b FROM e WHERE a IN (SELECT fid FROM core) AND b IN (SELECT fid FROM core)), walk AS (SELECT fid, fid AS root FROM core UNION SELECT ce.b, walk.root FROM walk JOIN ce ON ce.a = walk.fid),
lab AS (SELECT fid, min(root) AS root FROM walk GROUP BY fid), num AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster_id FROM (SELECT DISTINCT root FROM lab) AS t),
done AS (SELECT lab.fid, num.cluster_id FROM lab JOIN num ON lab.root = num.root UNION ALL SELECT e.a, min(num.cluster_id) FROM e JOIN lab ON e.b = lab.fid JOIN num ON lab.root = num.root WHERE e.a NOT IN (SELECT fid FROM core) GROUP BY e.a)
"""
_PLAIN = fx.duck("points")[5:] + ", m AS (SELECT fid, x * 100000 AS x, y * 100000 AS y FROM points)"


@query(_DB.format(m=_PLAIN) + "SELECT m.fid, coalesce(done.cluster_id, -1) AS cluster_id FROM m LEFT JOIN done ON m.fid = done.fid")
def a20_dbscan(s, d):
    return pt.dbscan(_plane(s, d), 150.0, 8)


@query(_DB.format(m=_PLAIN) + "SELECT cluster_id, count(*) AS n, round(avg(x), 4) AS mx, round(avg(y), 4) AS my FROM m JOIN done ON m.fid = done.fid GROUP BY cluster_id")
def a21_cluster_summary(s, d):
    """Hull areas and degrees are tested against a brute-force hull; here are sizes and means."""
    p = _plane(s, d)
    moved = p.select("fid", (F.col("x") / 10 - 360000 + 500000).alias("x"), (F.col("y") / 10 - 330000 + 3700000).alias("y"))
    c = pt.cluster_summary(moved, pt.dbscan(p, 150.0, 8), 32637)
    u = g.to_utm(F.col("lng"), F.col("lat"), 32637)
    return c.select("cluster_id", "n", _r((u["x"] - 500000 + 360000) * 10, 4).alias("mx"), _r((u["y"] - 3700000 + 330000) * 10, 4).alias("my")).where(F.col("n") > 0)


# --- land ---------------------------------------------------------------------------------------------------------------


@query(f"{fx.duck('parcels_old', 'damage')} SELECT a.jurisdiction, a.parcel_id, ['light', 'moderate', 'severe', 'destroyed'][max(list_position(['light', 'moderate', 'severe', 'destroyed'], b.damage_severity))] AS severity FROM parcels_old a JOIN damage b ON a.x1 >= b.x0 AND a.x0 <= b.x1 AND a.y1 >= b.y0 AND a.y0 <= b.y1 GROUP BY 1, 2")
def j12_damage_overlay(s, d):
    return la.damage_overlay(_boxes(s, d), _boxes(s, d, "damage"), KEY)


def _general(s):
    rows = [("retail", "commercial"), ("office", "commercial"), ("industrial", "commercial")]
    return s.createDataFrame(rows, "use string, general_use string")


_PREV = fx.duck("parcels_old", "parcels_new", "master_plan")
_STATUS = f"""{_PREV}, j AS (SELECT c.jurisdiction, c.parcel_id, c.neighborhood, c.current_use, m.designated_use, p.current_use AS previous_use, p.parcel_id IS NOT NULL AS was, CASE WHEN c.current_use IN ('retail', 'office', 'industrial') THEN 'commercial' END AS general_use FROM parcels_new c LEFT JOIN master_plan m ON c.jurisdiction = m.jurisdiction AND c.parcel_id = m.parcel_id LEFT JOIN parcels_old p ON c.jurisdiction = p.jurisdiction AND c.parcel_id = p.parcel_id),
s AS (SELECT *, CASE WHEN designated_use IS NULL THEN 'no_plan' WHEN current_use = designated_use OR coalesce(general_use = designated_use, false) THEN 'compliant' WHEN NOT was OR previous_use IS DISTINCT FROM current_use THEN 'violation' ELSE 'legacy_nonconforming' END AS status FROM j)"""


def _compliance(s, d):
    return la.compliance_join(fx.table(s, d, "parcels_new"), fx.table(s, d, "master_plan"), fx.table(s, d, "parcels_old"), _general(s), KEY)


@query(f"{_STATUS} SELECT jurisdiction, parcel_id, current_use, designated_use, previous_use, was, general_use FROM j")
def j13_compliance_join(s, d):
    """With P32, the mapping of use codes."""
    return _compliance(s, d)


@query(f"{_STATUS} SELECT jurisdiction, parcel_id, status FROM s")
def a26_landuse_status(s, d):
    return la.landuse_status(_compliance(s, d)).select(*KEY, "status")


_LINEAGE = f"""{_PREV}, g AS (SELECT * FROM parcels_old o ANTI JOIN parcels_new n ON o.jurisdiction = n.jurisdiction AND o.parcel_id = n.parcel_id), c AS (SELECT * FROM parcels_new n ANTI JOIN parcels_old o ON o.jurisdiction = n.jurisdiction AND o.parcel_id = n.parcel_id),
o AS (SELECT g.jurisdiction, g.parcel_id AS a, c.parcel_id AS b FROM g JOIN c ON g.jurisdiction = c.jurisdiction AND g.x1 >= c.x0 AND g.x0 <= c.x1 AND g.y1 >= c.y0 AND g.y0 <= c.y1 WHERE (least(g.x1, c.x1) - greatest(g.x0, c.x0)) * (least(g.y1, c.y1) - greatest(g.y0, c.y0)) >= 0.5e0 * least((g.x1 - g.x0) * (g.y1 - g.y0), (c.x1 - c.x0) * (c.y1 - c.y0))),
l AS (SELECT 'subdivided' AS kind, jurisdiction, a AS parcel_id, count(*) AS n FROM o GROUP BY 2, 3 HAVING count(*) >= 2 UNION ALL SELECT 'merged', jurisdiction, b, count(*) FROM o GROUP BY 2, 3 HAVING count(*) >= 2)"""


@query(f"{_LINEAGE} SELECT kind, jurisdiction, parcel_id, n FROM l")
def j14_parcel_lineage(s, d):
    return la.parcel_lineage(_boxes(s, d), _boxes(s, d, "parcels_new"), KEY)


@query(f"""{_LINEAGE} SELECT kind, count(*) AS n FROM l GROUP BY kind UNION ALL SELECT CASE WHEN p.parcel_id IS NULL THEN 'new' WHEN q.parcel_id IS NULL THEN 'removed' ELSE 'changed' END AS kind, count(*) FROM parcels_old p FULL JOIN parcels_new q ON p.jurisdiction = q.jurisdiction AND p.parcel_id = q.parcel_id WHERE p.parcel_id IS NULL OR q.parcel_id IS NULL OR p.current_use IS DISTINCT FROM q.current_use GROUP BY 1""")
def a26_drift_counts(s, d):
    old, new = _boxes(s, d), _boxes(s, d, "parcels_new")
    return la.drift_counts(old, new, la.parcel_lineage(old, new, KEY), KEY)


# All rows of a key that repeats in a snapshot are unknown.
_RECON = f"""{fx.duck('parcels_old', 'parcels_new', 'damage')}, rep AS (SELECT jurisdiction, parcel_id FROM parcels_old GROUP BY 1, 2 HAVING count(*) > 1 UNION SELECT jurisdiction, parcel_id FROM parcels_new GROUP BY 1, 2 HAVING count(*) > 1),
base AS (SELECT o.* FROM parcels_old o ANTI JOIN rep ON o.jurisdiction = rep.jurisdiction AND o.parcel_id = rep.parcel_id), curr AS (SELECT n.* FROM parcels_new n ANTI JOIN rep ON n.jurisdiction = rep.jurisdiction AND n.parcel_id = rep.parcel_id), dmg AS (SELECT a.jurisdiction, a.parcel_id, max(list_position(['light', 'moderate', 'severe', 'destroyed'], b.damage_severity)) AS sev FROM parcels_old a JOIN damage b ON a.x1 >= b.x0 AND a.x0 <= b.x1 AND a.y1 >= b.y0 AND a.y0 <= b.y1 GROUP BY 1, 2),
r AS (SELECT coalesce(o.jurisdiction, n.jurisdiction) AS jurisdiction, coalesce(o.parcel_id, n.parcel_id) AS parcel_id, coalesce(o.neighborhood, n.neighborhood) AS neighborhood, coalesce(n.area_sqm, o.area_sqm) AS area, CASE WHEN o.parcel_id IS NULL THEN 'new_construction' WHEN sev = 4 THEN 'destroyed' WHEN sev IS NOT NULL THEN 'damaged'
  WHEN n.parcel_id IS NOT NULL AND n.footprint_area IS NULL THEN 'vacant' WHEN n.parcel_id IS NULL OR n.footprint_area / o.footprint_area < 0.30e0 THEN 'destroyed'
  WHEN abs((n.x1 - n.x0) * (n.y1 - n.y0) - (o.x1 - o.x0) * (o.y1 - o.y0)) / ((o.x1 - o.x0) * (o.y1 - o.y0)) * 100 < 0.1e0 AND sqrt(pow((n.x0 + n.x1 - o.x0 - o.x1) / 2, 2) + pow((n.y0 + n.y1 - o.y0 - o.y1) / 2, 2)) * 111000 < 0.5e0 THEN 'intact' ELSE 'rebuilt' END AS status
  FROM base o FULL JOIN curr n ON o.jurisdiction = n.jurisdiction AND o.parcel_id = n.parcel_id LEFT JOIN dmg ON o.jurisdiction = dmg.jurisdiction AND o.parcel_id = dmg.parcel_id
  UNION ALL SELECT p.jurisdiction, p.parcel_id, p.neighborhood, p.area_sqm, 'unknown' FROM (SELECT * FROM parcels_old UNION ALL SELECT * FROM parcels_new) p SEMI JOIN rep ON p.jurisdiction = rep.jurisdiction AND p.parcel_id = rep.parcel_id)"""


def reconstruction(s, d):
    """(jurisdiction, parcel_id, neighborhood, area, status, restitution_status) of all parcels of either snapshot."""
    from landloom.plans.jobs import reconstruction as status

    return status(_boxes(s, d), _boxes(s, d, "parcels_new"), _boxes(s, d, "damage"))


@query(f"{_RECON} SELECT jurisdiction, parcel_id, status, CASE WHEN status = 'destroyed' THEN 'awaiting restitution' END AS restitution_status FROM r")
def a24_reconstruction_status(s, d):
    return reconstruction(s, d).select(*KEY, "status", "restitution_status")


@query(f"{_RECON} SELECT jurisdiction, status, CAST(grouping(jurisdiction) * 2 + grouping(status) AS BIGINT) AS level, count(*) AS n, round(sum(area), 3) AS area, round(count(*) / (SELECT count(*) FROM r)::DOUBLE, 9) AS share FROM r GROUP BY ROLLUP (jurisdiction, status)")
def a25_status_totals(s, d):
    t = la.status_totals(reconstruction(s, d), ["jurisdiction", "status"], "area")
    return t.withColumns({"area": _r("area", 3), "share": _r("share", 9), "level": F.col("level").cast("long")})


@query(f"{_RECON}, c AS (SELECT neighborhood, count(*) AS n FROM r WHERE status IN ('damaged', 'destroyed') GROUP BY 1) SELECT neighborhood, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, rank() OVER (ORDER BY n DESC) AS rank FROM c) AS t WHERE rank <= 10")
def w05_top_neighborhoods(s, d):
    return la.top_groups(reconstruction(s, d).where("status in ('damaged', 'destroyed')"), "neighborhood")


_HOT = """WITH RECURSIVE {m}, e AS (SELECT a.fid AS a, b.fid AS b FROM m a JOIN m b ON pow(a.e - b.e, 2) + pow(a.n - b.n, 2) <= {eps} * {eps}), core AS (SELECT a AS fid FROM e GROUP BY a HAVING count(*) >= {least}),
ce AS (SELECT a, b FROM e WHERE a IN (SELECT fid FROM core) AND b IN (SELECT fid FROM core)), walk AS (SELECT fid, fid AS root FROM core UNION SELECT ce.b, walk.root FROM walk JOIN ce ON ce.a = walk.fid),
lab AS (SELECT fid, min(root) AS root FROM walk GROUP BY fid), num AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster_id FROM (SELECT DISTINCT root FROM lab) AS t),
done AS (SELECT lab.fid, num.cluster_id FROM lab JOIN num ON lab.root = num.root UNION ALL SELECT e.a, min(num.cluster_id) FROM e JOIN lab ON e.b = lab.fid JOIN num ON lab.root = num.root WHERE e.a NOT IN (SELECT fid FROM core) GROUP BY e.a)
"""


@query(_HOT.format(m=f"{_STATUS[5:]}, f AS (SELECT c.fid, (c.x0 + c.x1) / 2 AS x, (c.y0 + c.y1) / 2 AS y FROM parcels_new c JOIN s ON c.jurisdiction = s.jurisdiction AND c.parcel_id = s.parcel_id WHERE s.status = 'violation'), {utm_sql('m', 'f')}", eps=3000, least=4) + "SELECT m.fid, coalesce(done.cluster_id, -1) AS cluster_id FROM m LEFT JOIN done ON m.fid = done.fid")
def a27_hot_zones(s, d):
    """Clusters of violations, in metres."""
    flagged = la.landuse_status(_compliance(s, d)).where("status = 'violation'").select("jurisdiction", "parcel_id")
    c = g.centroid(F.col("geom"))
    pts = _boxes(s, d, "parcels_new").join(dealt(flagged), KEY).select("fid", c["x"].alias("x"), c["y"].alias("y"))
    return la.hot_zones(pts, F.lit(True), 3000.0, 4)


@query(f"""{fx.duck('parcels_old')}, t AS (SELECT neighborhood AS area, k.s AS snapshot_id, (fid * 7 + k.s * 3) % 5 < k.s AS rebuilt FROM parcels_old CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS s) k), n AS (SELECT area, snapshot_id, count(*) FILTER (WHERE rebuilt) AS rebuilt FROM t GROUP BY 1, 2)
  SELECT area, snapshot_id, rebuilt, rebuilt - lag(rebuilt) OVER (PARTITION BY area ORDER BY snapshot_id) AS change FROM n""")
def w07_rebuild_velocity(s, d):
    t = fx.table(s, d, "parcels_old").select(F.col("neighborhood").alias("area"), "fid", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])).alias("snapshot_id"))
    t = t.withColumn("status", F.when((F.col("fid") * 7 + F.col("snapshot_id") * 3) % 5 < F.col("snapshot_id"), "rebuilt").otherwise("intact"))
    return la.rebuild_velocity(t)


_DRIFT = f"{fx.duck('use_updates')}, l AS (SELECT *, lag(observed_use) OVER (PARTITION BY jurisdiction, parcel_id ORDER BY ts, event_id) AS previous_use FROM use_updates)"


@query(f"{_DRIFT} SELECT jurisdiction, parcel_id, ts, event_id, previous_use, observed_use FROM l WHERE previous_use <> observed_use")
def w08_consecutive_drift(s, d):
    return la.consecutive_drift(fx.table(s, d, "use_updates"))


# --- briefs and towns ---------------------------------------------------------------------------------------------------


def briefs(s):
    rows = [
        (1, "commercial", 500.0, 40000.0, ["water"], {"tax": "<= 60000"}, {"footprint": ">= 100"}),
        (2, "residential", 300.0, 20000.0, [], {}, {"tax": "< 20000"}),
        (3, "office", 900.0, 60000.0, ["water", "power"], {"footprint": ">= 60"}, {}),
        (4, "retail", 200.0, 9000.0, ["power"], {"tax": "> 1000"}, {"footprint": "<= 200"}),
        (5, "industrial", 100.0, 90000.0, [], {}, {}),
        (6, "commercial", 1500.0, 90000.0, [], {"tax": "about 5"}, {}),
    ]
    return s.createDataFrame(rows, "brief_id int, industry string, required_area_sqm double, budget_usd double, required_infrastructure array<string>, must_have map<string,string>, nice_to_have map<string,string>")


def offered(s, d):
    t = fx.table(s, d, "parcels_old")
    utilities = F.array_compact(F.array(F.when(F.col("fid") % 8 != 4, F.lit("water")), F.when(F.col("fid") % 3 != 0, F.lit("power"))))
    return t.withColumns({"utilities": utilities, "attributes": F.create_map(F.lit("tax"), "tax_value", F.lit("footprint"), "footprint_area")})


_BRIEF = f"""{fx.duck('parcels_old')}, b AS (SELECT * FROM (VALUES (1, 500e0, 40000e0), (2, 300e0, 20000e0), (3, 900e0, 60000e0), (4, 200e0, 9000e0)) AS t(brief_id, area, budget)),
m AS (SELECT b.brief_id, p.jurisdiction, p.parcel_id, p.area_sqm, p.area_sqm * p.price_per_sqm AS cost, CAST(CASE b.brief_id WHEN 1 THEN (footprint_area >= 100)::INT WHEN 2 THEN (tax_value < 20000)::INT WHEN 4 THEN (footprint_area <= 200)::INT ELSE 0 END AS INTEGER) AS nice FROM parcels_old p JOIN b ON p.for_sale AND p.area_sqm >= b.area AND p.area_sqm * p.price_per_sqm <= b.budget
  AND CASE b.brief_id WHEN 1 THEN zone_code IN ('C-1', 'historic-district') AND fid % 8 <> 4 AND tax_value <= 60000 WHEN 2 THEN zone_code IN ('R-1', 'historic-district') WHEN 3 THEN zone_code IN ('C-1', 'historic-district') AND fid % 8 <> 4 AND fid % 3 <> 0 AND footprint_area >= 60 WHEN 4 THEN zone_code IN ('C-1', 'historic-district') AND fid % 3 <> 0 AND tax_value > 1000 END)"""


@query(f"{_BRIEF} SELECT brief_id, jurisdiction, parcel_id, area_sqm, round(cost, 6) AS cost, nice FROM m")
def j11_match_sites(s, d):
    return la.match_sites(offered(s, d), briefs(s)).withColumn("cost", _r("cost"))


@query(f"""{_BRIEF}, r AS (SELECT m.*, CAST((o.fid * 37) % 101 AS DOUBLE) AS score FROM m JOIN parcels_old o ON o.parcel_id = m.parcel_id), k AS (SELECT *, row_number() OVER (PARTITION BY brief_id ORDER BY score DESC, nice DESC, jurisdiction, parcel_id) AS rank FROM r)
  SELECT brief_id, parcel_id, CAST(rank AS INTEGER) AS rank, score, rank <= 3 AND score >= 70 AS shortlisted FROM k WHERE rank <= 10""")
def w02_shortlist(s, d):
    o = offered(s, d)
    score = ((F.col("fid") * 37) % 101).cast("double")
    from landloom.functions.scoring import verdict

    scores = o.select(*KEY, score.alias("score"), verdict(score).alias("verdict"))
    return la.shortlist(la.match_sites(o, briefs(s)), scores).select("brief_id", "parcel_id", "rank", "score", "shortlisted")


@query(f"{fx.duck('town_years')} SELECT town, year, population FROM (SELECT *, row_number() OVER (PARTITION BY town ORDER BY as_of DESC NULLS LAST, year DESC NULLS LAST) AS k FROM town_years) AS t WHERE k = 1")
def w03_latest_snapshot(s, d):
    return pr.latest_snapshot(fx.table(s, d, "town_years")).select("town", "year", "population")


def town_parcels(s, d):
    t = fx.table(s, d, "parcels_old")
    return t.select(F.col("jurisdiction").alias("town"), "area_sqm", F.col("current_use").alias("use_class"), "price_per_sqm", "for_sale", (F.col("fid") % 6 == 0).alias("vacant"), (F.col("fid") % 4 != 1).alias("serviced"))


def _town_land(s, d):
    return pr.land_availability(town_parcels(s, d))


@query(f"""{fx.duck('parcels_old')} SELECT jurisdiction AS town, round(sum(coalesce(area_sqm, 0)) / 10000, 6) AS total, round(sum(CASE WHEN current_use = 'industrial' THEN coalesce(area_sqm, 0) ELSE 0 END) / 10000, 6) AS industrial, round(avg(CASE WHEN current_use = 'industrial' THEN price_per_sqm END), 6) AS price,
  round(sum(CASE WHEN fid % 6 = 0 AND fid % 4 <> 1 THEN coalesce(area_sqm, 0) ELSE 0 END) / 10000, 6) AS vacant, count(*) FILTER (WHERE for_sale) AS available, max(CASE WHEN for_sale THEN area_sqm END) AS largest FROM parcels_old GROUP BY 1""")
def a29_land_availability(s, d):
    return _town_land(s, d).select("town", _r("total_developable_ha").alias("total"), _r("industrial_ha").alias("industrial"), _r("industrial_price_per_sqm").alias("price"), _r("vacant_serviced_ha").alias("vacant"), "available", F.col("largest_available").alias("largest"))


def town_stats(s, d):
    latest = pr.latest_snapshot(fx.table(s, d, "town_years"))
    land = _town_land(s, d)
    return pr.profile_stats(latest.withColumn("population", F.col("population").cast("string")), "demographics").unionByName(pr.profile_stats(land, "land"))


_LAST = f"{fx.duck('town_years')}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY town ORDER BY as_of DESC NULLS LAST, year DESC NULLS LAST) AS k FROM town_years) AS t WHERE k = 1)"


@query(f"{_LAST} SELECT town, label, value, unit, coalesce(source, 'user-supplied') AS source, coalesce(as_of, '(undated)') AS as_of FROM l, LATERAL (SELECT 'Population' AS label, CAST(population AS VARCHAR) AS value, 'people' AS unit UNION ALL SELECT 'Median household income', CAST(round(median_income, 2) AS VARCHAR), '' WHERE median_income IS NOT NULL) AS v")
def a32_profile_stats(s, d):
    t = pr.latest_snapshot(fx.table(s, d, "town_years")).withColumn("median_income", _r("median_income", 2))
    return pr.profile_stats(t, "demographics").select("town", "label", "value", "unit", "source", "as_of")


@query(f"""WITH t AS (SELECT n_name AS town, n_nationkey AS k FROM nation), c AS (SELECT n_name AS town, string_agg(s_name || ' (sector ' || s_suppkey % 3 || ', ' || CASE WHEN s_suppkey % 4 = 0 THEN '?' ELSE CAST(s_suppkey * 10 AS VARCHAR) END || ' employees)', ', ' ORDER BY s_suppkey) AS employers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
  SELECT coalesce(c.town, t.town) AS town, employers, CASE WHEN t.k % 2 = 0 THEN 'tax relief;free land' END AS incentives, CASE WHEN t.k % 2 = 0 THEN 'flood' WHEN t.town IS NOT NULL THEN '' END AS risks FROM c FULL JOIN t ON c.town = t.town""")
def a33_profile_narrative(s, d):
    return pr.profile_narrative(*narrative_sources(s, d)).select("town", "employers", F.array_join("incentives", ";").alias("incentives"), F.array_join("risks", ";").alias("risks"))


def narrative_sources(s, d):
    """Economy and why_now of the nations as towns."""
    n, sup = s.read.parquet(f"{d}/nation.parquet"), s.read.parquet(f"{d}/supplier.parquet")
    e = F.struct("s_suppkey", F.col("s_name").alias("name"), F.concat(F.lit("sector "), (F.col("s_suppkey") % 3).cast("string")).alias("sector"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_suppkey") * 10).alias("headcount"))
    econ = sup.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("town")).agg(F.array_sort(F.collect_list(e)).alias("major_employers"))
    econ = econ.withColumn("top_industries", F.lit(None).cast("array<struct<industry:string,share_pct:double>>"))
    even = F.col("n_nationkey") % 2 == 0
    why = n.select(F.col("n_name").alias("town"), F.when(even, F.array(F.lit("tax relief"), F.lit("free land"))).alias("incentives"), F.lit(None).cast("array<string>").alias("recent_improvements"), F.lit(None).cast("array<string>").alias("advantages"), F.when(even, F.array(F.lit("flood"))).alias("risks"))
    return econ, why


@query(f"{_LAST}, p AS (SELECT town, CAST(population AS VARCHAR) AS value FROM l), q AS (SELECT DISTINCT jurisdiction AS town FROM part_land) SELECT town, 'Population' AS headline, 'Population' AS label FROM p UNION ALL SELECT town, 'Industrial-zoned land', 'Industrial-zoned land' FROM q".replace("part_land", "(SELECT 'town-' || CAST(p_partkey % 5 AS VARCHAR) AS jurisdiction FROM part) AS z"))
def a34_profile_headlines(s, d):
    return pr.profile_headlines(town_stats(s, d)).select("town", "headline", "label")


_LAND = """, z AS (SELECT jurisdiction AS town, sum(coalesce(area_sqm, 0)) / 10000 AS total, avg(CASE WHEN current_use = 'industrial' THEN price_per_sqm END) AS price, max(CASE WHEN for_sale THEN area_sqm END) AS largest FROM parcels_old GROUP BY 1)"""


@query(f"""{fx.duck('town_years', 'parcels_old')}, {_LAST[_LAST.index('l AS'):]}{_LAND} SELECT town, CAST(1 + (median_income IS NOT NULL)::INT AS BIGINT) AS demographics, CAST(0 AS BIGINT) AS infrastructure, CAST(0 AS BIGINT) AS land, CAST(0 AS BIGINT) AS economy FROM l
  UNION ALL SELECT town, 0, 0, 5 + (price IS NOT NULL)::INT, 0 FROM z""")
def a35_section_completeness(s, d):
    return pr.section_completeness(town_stats(s, d))
