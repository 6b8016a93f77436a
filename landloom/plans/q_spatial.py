"""Queries of joins by place and of layer profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from landloom import fixtures as fx
from landloom.functions import geometry as g
from landloom.operators import sites as si, spatial as sp, stats as st
from landloom.plans.q_functions import US, _boxes, _odd, _us

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_r = lambda c, n=6: F.round(c, n)
_MEET = "a.x1 >= b.x0 AND a.x0 <= b.x1 AND a.y1 >= b.y0 AND a.y0 <= b.y1"


@query(f"{fx.duck('points', 'facilities')} SELECT c.fid AS candidate_id, count(f.fid) AS n FROM points c LEFT JOIN facilities f ON sqrt((c.x - f.x) * (c.x - f.x) + (c.y - f.y) * (c.y - f.y)) <= 0.08e0 GROUP BY c.fid")
def j03_density_count(s, d):
    c = fx.table(s, d, "points").select(F.col("fid").alias("candidate_id"), "x", "y")
    return sp.density_count(c, fx.table(s, d, "facilities"), 0.08)


@query(f"""{fx.duck('parcels_old', 'damage', 'roads')}, f AS (SELECT fid, x0, y0, x1, y1 FROM damage UNION ALL SELECT 1000000 + fid, x0, y, x1, y FROM roads)
  SELECT a.fid AS candidate_id, count(b.fid) AS n FROM parcels_old a LEFT JOIN f b ON sqrt(pow(greatest(0, b.x0 - a.x1, a.x0 - b.x1), 2) + pow(greatest(0, b.y0 - a.y1, a.y0 - b.y1), 2)) <= 0.031e0 GROUP BY a.fid""")
def j03_density_count_of_shapes(s, d):
    """Parcels, and lines and polygons around them: what meets a parcel widened by the radius counts."""
    r = fx.table(s, d, "roads")
    lines = r.select(F.lit("f").alias("layer_key"), (F.col("fid") + 1000000).alias("fid"), g.line((r.x0, r.y), (r.x1, r.y)).alias("geom"))
    feats = _boxes(s, d, "damage").select(F.lit("f").alias("layer_key"), "fid", "geom").unionByName(lines)
    return si.features_within(_boxes(s, d).select(F.col("fid").alias("candidate_id"), "geom"), feats, 0.031)


@query(f"""{fx.duck('facilities')}, t AS (SELECT fid, 2 * 6371008.8e0 * asin(sqrt(pow(sin(radians(33.5e0 - y) / 2), 2) + cos(radians(y)) * cos(radians(33.5e0)) * pow(sin(radians(36.5e0 - x) / 2), 2))) AS m FROM facilities)
  SELECT fid, round(m, 3) AS metres FROM t WHERE m <= 40000 ORDER BY m, fid LIMIT 20""")
def j04_dwithin(s, d):
    return sp.dwithin(fx.table(s, d, "facilities"), 36.5, 33.5, 40000, 20).select("fid", _r(F.col("metres"), 3).alias("metres"))


_FAR = "CASE WHEN x + 143.5e0 > 180 THEN x + 143.5e0 - 360 ELSE x + 143.5e0 END"


@query(f"""{fx.duck('facilities')}, f AS (SELECT fid, {_FAR} AS x, y FROM facilities), t AS (SELECT fid, 2 * 6371008.8e0 * asin(sqrt(pow(sin(radians(33.5e0 - y) / 2), 2) + cos(radians(y)) * cos(radians(33.5e0)) * pow(sin(radians(179.998e0 - x) / 2), 2))) AS m FROM f)
  SELECT fid, round(m, 3) AS metres FROM t WHERE m <= 40000 ORDER BY m, fid LIMIT 20""")
def j04_dwithin_over_the_180th_meridian(s, d):
    """The facilities moved so that the 180th meridian goes through them."""
    moved = fx.table(s, d, "facilities").select("fid", F.expr(_FAR.replace("e0", "D")).alias("x"), "y")
    return sp.dwithin(moved, 179.998, 33.5, 40000, 20).select("fid", _r(F.col("metres"), 3).alias("metres"))


@query(f"""{fx.duck('parcels_old', 'damage')}, {US}, p AS (SELECT r.fid, d.fid AS b, max(CASE WHEN sign > 0 THEN 1 END) AS met, sum(sign * greatest(0, least(r.c, d.x1) - greatest(r.a, d.x0)) * greatest(0, least(r.e, d.y1) - greatest(r.b, d.y0))) AS m
    FROM r JOIN damage d ON r.a <= d.x1 AND r.c >= d.x0 AND r.b <= d.y1 AND r.e >= d.y0 GROUP BY r.fid, d.fid), s AS (SELECT fid, sum(sign * (c - a) * (e - b)) AS whole FROM r GROUP BY fid)
  SELECT p.fid AS a_id, b AS b_id, round(m / whole, 8) AS share FROM p JOIN s ON s.fid = p.fid WHERE met = 1""")
def j02_overlap_of_shapes(s, d):
    """U shapes, some with a hole, and boxes: every pair that meets and what share of the shape the box covers."""
    a, b = _us(s, d).select(F.col("fid").alias("a_id"), "geom"), _boxes(s, d, "damage").select(F.col("fid").alias("b_id"), "geom")
    return sp.overlaps(a, b).select("a_id", "b_id", _r(F.col("overlap") / F.col("a_area"), 8).alias("share"))


@query(f"{fx.duck('parcels_old', 'protected')} SELECT a.fid AS a_id, b.fid AS b_id FROM parcels_old a JOIN protected b ON {_MEET}")
def j05_spatial_join_intersects(s, d):
    a, b = _boxes(s, d), _boxes(s, d, "protected")
    return sp.spatial_join(a.select(F.col("fid").alias("a_id"), "geom"), b.select(F.col("fid").alias("b_id"), "geom"))


@query(f"{fx.duck('parcels_old', 'zones')} SELECT a.fid AS a_id, b.fid AS b_id FROM zones a JOIN parcels_old b ON a.x0 <= b.x0 AND a.x1 >= b.x1 AND a.y0 <= b.y0 AND a.y1 >= b.y1")
def j05_spatial_join_contains(s, d):
    a, b = _boxes(s, d, "zones"), _boxes(s, d)
    return sp.spatial_join(a.select(F.col("fid").alias("a_id"), "geom"), b.select(F.col("fid").alias("b_id"), "geom"), "contains")


@query(f"{fx.duck('parcels_old', 'zones')} SELECT a.fid AS a_id, b.fid AS b_id FROM parcels_old a JOIN zones b ON b.x0 <= a.x0 AND b.x1 >= a.x1 AND b.y0 <= a.y0 AND b.y1 >= a.y1")
def j05_spatial_join_within(s, d):
    a, b = _boxes(s, d), _boxes(s, d, "zones")
    return sp.spatial_join(a.select(F.col("fid").alias("a_id"), "geom"), b.select(F.col("fid").alias("b_id"), "geom"), "within")


@query(f"{fx.duck('points_big', 'zones')} SELECT p.fid, z.fid AS poly_id FROM points_big p JOIN zones z ON p.x BETWEEN z.x0 AND z.x1 AND p.y BETWEEN z.y0 AND z.y1")
def j06_point_in_polygon(s, d):
    return sp.point_in_polygon(fx.table(s, d, "points_big"), _boxes(s, d, "zones").select(F.col("fid").alias("poly_id"), "geom"))


@query(f"{fx.duck('points')} SELECT a.fid AS a, b.fid AS b, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 9) AS dist FROM points a JOIN points b ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.003e0")
def j15_neighbors_within(s, d):
    # Rounded by arithmetic, as the SQL's engine does: round() goes through decimals, which for so many rows takes longer than all the rest.
    return sp.neighbors_within(fx.table(s, d, "points"), 0.003).select("a", "b", (F.floor(F.col("dist") * 1e9 + 0.5) / F.lit(1e9)).alias("dist"))


@query(f"{fx.duck('points')} SELECT a.fid, round(min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 9) AS dist FROM points a JOIN points b ON a.fid <> b.fid GROUP BY a.fid")
def j16_nearest_neighbor(s, d):
    return sp.nearest_neighbor(fx.table(s, d, "points"), 0.02).select("fid", _r(F.col("dist"), 9).alias("dist"))


@query(f"{fx.duck('points_big')} SELECT CAST(floor(x / 0.05e0) AS BIGINT) AS cell_x, CAST(floor(y / 0.05e0) AS BIGINT) AS cell_y, count(*) AS n FROM points_big GROUP BY 1, 2")
def a28_density_grid(s, d):
    return sp.density_grid(fx.table(s, d, "points_big"), 0.05)


@query(f"{fx.duck('parcels_old')} SELECT jurisdiction, count(*) AS n, 'MultiPolygon' AS kind, round(sum((x1 - x0) * (y1 - y0)), 9) AS area FROM parcels_old GROUP BY jurisdiction")
def a31_collect_geometry(s, d):
    """In parts of some hundred vertices; what a group's parts hold together is compared."""
    t = sp.collect_geometry(_boxes(s, d), "jurisdiction", 200)
    return t.groupBy("jurisdiction").agg(F.sum("n").alias("n"), F.min("geom.type").alias("kind"), _r(F.sum(g.area(F.col("geom"))), 9).alias("area"))


def _layered(s, d):
    return _odd(s, d).select("fid", F.concat(F.lit("L"), (F.col("fid") % 3).cast("string")).alias("layer"), "geom", F.lit(4326).alias("srid"))


@query(f"""{fx.duck('odd')}, t AS (SELECT 'L' || CAST(fid % 3 AS VARCHAR) AS layer, fault, CASE WHEN fault NOT IN (5, 6) THEN x0 + CASE WHEN fault = 4 THEN 300 ELSE 0 END END AS a, CASE WHEN fault NOT IN (5, 6) THEN y0 END AS b,
  CASE WHEN fault NOT IN (5, 6) THEN x1 + CASE WHEN fault = 4 THEN 300 ELSE 0 END END AS c, CASE WHEN fault = 3 THEN y0 WHEN fault NOT IN (5, 6) THEN y1 END AS e FROM odd)
  SELECT layer, count(*) AS feature_count, 'Polygon' AS geometry_type, CAST(4326 AS INTEGER) AS srid, round(min(a), 9) AS xmin, round(min(b), 9) AS ymin, round(max(c), 9) AS xmax, round(max(e), 9) AS ymax, 'fid:bigint' AS fields FROM t GROUP BY layer""")
def a01_layer_summary(s, d):
    t = st.layer_summary(_layered(s, d))
    return t.withColumns({n: _r(F.col(n), 9) for n in ("xmin", "ymin", "xmax", "ymax")})


@query(f"{fx.duck('odd')} SELECT 'Polygon' AS geometry_type, count(*) AS n FROM odd WHERE fault <> 6")
def a02_geometry_type_counts(s, d):
    return st.geometry_type_counts(_odd(s, d))


@query(f"{fx.duck('odd')} SELECT count(*) FILTER (WHERE fault IN (1, 2, 3)) AS invalid, count(*) FILTER (WHERE fault IN (5, 6)) AS empty FROM odd")
def a03_quality_counts(s, d):
    return st.quality_counts(_odd(s, d))


@query(f"{fx.duck('points_big')} SELECT CAST(sum(c - 1) AS BIGINT) AS copies FROM (SELECT count(*) AS c FROM points_big GROUP BY round(x, 6), round(y, 6)) AS t")
def a04_duplicate_geometries(s, d):
    t = fx.table(s, d, "points_big").withColumn("geom", g.point(F.col("x"), F.col("y")))
    return st.duplicate_geometries(t)


@query(f"{fx.duck('parcels_old')} SELECT CAST(sum(c - 1) AS BIGINT) AS copies FROM (SELECT count(*) AS c FROM parcels_old GROUP BY owner_name) AS t")
def a05_duplicate_attributes(s, d):
    return st.duplicates(fx.table(s, d, "parcels_old"), F.col("owner_name"))


_COLS = ("l_quantity", "l_extendedprice", "l_tax")
_LONG = " UNION ALL ".join(f"SELECT '{c}' AS col, {c} AS v FROM lineitem WHERE {c} IS NOT NULL" for c in _COLS)


@query(f"""WITH t AS ({_LONG}), m AS (SELECT col, count(*) AS n, min(v) AS lo, max(v) AS hi, avg(v) AS mean, median(v) AS med, stddev_pop(v) AS sd, list(v ORDER BY v) AS l FROM t GROUP BY col)
  SELECT m.col AS "column", n AS count, lo AS min, hi AS max, round(mean, 4) AS mean, round(med, 4) AS median, round(sd, 4) AS std, l[greatest(0, CAST(floor(n * 0.05e0) AS BIGINT) - 1) + 1] AS p5, l[least(n - 1, CAST(floor(n * 0.95e0) AS BIGINT)) + 1] AS p95,
  (SELECT count(*) FROM t WHERE t.col = m.col AND sd > 0 AND abs(v - mean) > 3 * sd) AS outliers FROM m""")
def a06_numeric_stats(s, d):
    """With A7 (percentiles by rank) and A9 (outliers)."""
    t = st.numeric_stats(s.read.parquet(f"{d}/lineitem.parquet"), list(_COLS))
    return t.withColumns({c: _r(F.col(c), 4) for c in ("mean", "median", "std")})


@query(f"""WITH t AS ({_LONG}), e AS (SELECT col, min(v) AS lo, (max(v) - min(v)) / 20 AS w FROM t GROUP BY col), c AS (SELECT t.col, CAST(least(19, floor((v - lo) / w)) AS INTEGER) AS bin, count(*) AS n FROM t JOIN e ON t.col = e.col GROUP BY 1, 2)
  SELECT e.col AS "column", CAST(b.i AS INTEGER) AS bin, round(lo + b.i * w, 6) AS low, round(lo + (b.i + 1) * w, 6) AS high, coalesce(c.n, 0) AS n FROM e CROSS JOIN (SELECT unnest(range(20)) AS i) b LEFT JOIN c ON c.col = e.col AND c.bin = b.i""")
def a08_histogram(s, d):
    return st.histogram(s.read.parquet(f"{d}/lineitem.parquet"), list(_COLS)).withColumns({c: _r(F.col(c)) for c in ("low", "high")})


@query("""WITH t AS (SELECT 'l_returnflag' AS col, l_returnflag AS v FROM lineitem UNION ALL SELECT 'l_suppkey', CAST(l_suppkey AS VARCHAR) FROM lineitem), c AS (SELECT col, v, count(*) AS n FROM t GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, v) AS rank, sum(n) OVER (PARTITION BY col) AS non_null, count(*) OVER (PARTITION BY col) AS d FROM c)
  SELECT col AS "column", CAST(non_null AS BIGINT) AS non_null, d AS "distinct", CAST(rank AS INTEGER) AS rank, v AS value, n FROM r WHERE rank <= 10""")
def a10_categorical_stats(s, d):
    """With T1, the top values by count."""
    return st.categorical_stats(s.read.parquet(f"{d}/lineitem.parquet"), ["l_returnflag", "l_suppkey"])


@query(f"""{fx.duck('parcels_old')}, t AS (SELECT (x1 - x0) * (y1 - y0) * 1000000 AS v FROM parcels_old), m AS (SELECT count(*) AS n, avg(v) AS mean, stddev_pop(v) AS sd, min(v) AS lo, max(v) AS hi FROM t)
  SELECT 'area' AS "column", n AS count, round(lo, 4) AS min, round(hi, 4) AS max, round(mean, 4) AS mean, round(sd, 4) AS std, (SELECT count(*) FROM t WHERE abs(v - mean) > 3 * sd) AS outliers FROM m""")
def a11_area_statistics(s, d):
    t = _boxes(s, d).select((g.area(F.col("geom")) * 1000000).alias("area"))
    out = st.numeric_stats(t, ["area"])
    return out.select("column", "count", *[_r(F.col(c), 4).alias(c) for c in ("min", "max", "mean", "std")], "outliers")


@query("""SELECT 'p_size' AS "column", CAST(min(p_size) AS DOUBLE) AS min, CAST(max(p_size) AS DOUBLE) AS max, count(DISTINCT p_size) AS "distinct" FROM part UNION ALL SELECT 'p_retailprice', min(p_retailprice), max(p_retailprice), count(DISTINCT p_retailprice) FROM part""")
def a12_field_range(s, d):
    return st.field_range(s.read.parquet(f"{d}/part.parquet"), ["p_size", "p_retailprice"])


@query(f"""{fx.duck('entities')}, c AS (SELECT layer, dxftype, count(*) AS n FROM entities GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY n DESC, dxftype) AS k FROM c)
  SELECT layer, CAST(sum(n) AS BIGINT) AS total, string_agg(dxftype || '=' || n, ';' ORDER BY dxftype) AS counts, max(CASE WHEN k = 1 THEN dxftype END) AS dominant,
  max(CASE WHEN k = 1 THEN CASE dxftype WHEN 'POINT' THEN 'Point' WHEN 'LINE' THEN 'LineString' WHEN 'CIRCLE' THEN 'Polygon (approximated)' WHEN 'ARC' THEN 'LineString (sampled)' WHEN 'TEXT' THEN '(annotation — skipped)' ELSE 'Polygon|LineString' END END) AS geometry_name FROM r GROUP BY layer""")
def a30_entity_counts(s, d):
    """With W9, the most frequent kind of each layer."""
    return st.entity_counts(fx.table(s, d, "entities"))


@query(f"{fx.duck('odd')} SELECT layer, fid, nth FROM (SELECT 'L' || CAST(fid % 3 AS VARCHAR) AS layer, fid, CAST(row_number() OVER (PARTITION BY fid % 3 ORDER BY fid) AS INTEGER) AS nth FROM odd) AS t WHERE nth <= 3")
def w04_first_n_sample(s, d):
    return st.first_n(_layered(s, d), "layer").select("layer", "fid", "nth")
