"""Queries of the scalar functions and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from landloom import fixtures as fx
from landloom.functions import geometry as g, scoring as sc, text as tx
from landloom.session import spread

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _boxes(s: SparkSession, d: str, name: str = "parcels_old") -> DataFrame:
    t = fx.table(s, d, name)
    return t.withColumn("geom", g.box(t.x0, t.y0, t.x1, t.y1))


def _us(s: SparkSession, d: str) -> DataFrame:
    """Parcels as U shapes: a base of a third of the height, and a leg of a third of the width on each side; each fourth with a small hole in the base."""
    t = spread(fx.table(s, d, "parcels_old")).withColumns({"w3": F.expr("(x1 - x0) / 3"), "h3": F.expr("(y1 - y0) / 3")})
    ring = lambda *at: F.array(*[g.vertex(F.expr(x), F.expr(y)) for x, y in at])
    outer = ring(("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x1 - w3", "y1"), ("x1 - w3", "y0 + h3"), ("x0 + w3", "y0 + h3"), ("x0 + w3", "y1"), ("x0", "y1"), ("x0", "y0"))
    hole = ring(("x0 + w3", "y0 + h3 / 3"), ("x0 + w3", "y0 + 2 * h3 / 3"), ("x1 - w3", "y0 + 2 * h3 / 3"), ("x1 - w3", "y0 + h3 / 3"), ("x0 + w3", "y0 + h3 / 3"))
    return t.withColumn("geom", g.make("Polygon", F.array(F.when(t.fid % 4 == 0, F.array(outer, hole)).otherwise(F.array(outer)))))


#: The rectangles of the U shapes, with sign, so that sums over them are sums over the shapes.
US = """r AS (SELECT fid, 'base' AS part, 1 AS sign, x0 AS a, y0 AS b, x1 AS c, y0 + (y1 - y0) / 3 AS e FROM parcels_old
  UNION ALL SELECT fid, 'left', 1, x0, y0 + (y1 - y0) / 3, x0 + (x1 - x0) / 3, y1 FROM parcels_old UNION ALL SELECT fid, 'right', 1, x1 - (x1 - x0) / 3, y0 + (y1 - y0) / 3, x1, y1 FROM parcels_old
  UNION ALL SELECT fid, 'hole', -1, x0 + (x1 - x0) / 3, y0 + (y1 - y0) / 9, x1 - (x1 - x0) / 3, y0 + 2 * (y1 - y0) / 9 FROM parcels_old WHERE fid % 4 = 0)"""


def _odd(s: SparkSession, d: str) -> DataFrame:
    """Parcels with a fault for each remainder of 8: none, bow-tie, open ring, short ring, out of range, empty, null, hole."""
    t = fx.table(s, d, "odd")
    ring = lambda *at: g.make("Polygon", F.array(F.array(F.array(*[g.vertex(F.expr(x), F.expr(y)) for x, y in at]))))
    hole = g.make(
        "Polygon",
        F.array(
            F.array(
                F.array(*[g.vertex(F.expr(x), F.expr(y)) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))]),
                F.array(*[g.vertex(F.expr(x), F.expr(y)) for x, y in (("x0 + 0.001", "y0 + 0.001"), ("x0 + 0.002", "y0 + 0.001"), ("x0 + 0.002", "y0 + 0.002"), ("x0 + 0.001", "y0 + 0.002"), ("x0 + 0.001", "y0 + 0.001"))]),
            )
        ),
    )
    geom = (
        F.when(t.fault == 0, g.box(t.x0, t.y0, t.x1, t.y1))
        .when(t.fault == 1, ring(("x0", "y0"), ("x1", "y1"), ("x1", "y0"), ("x0", "y1"), ("x0", "y0")))
        .when(t.fault == 2, ring(("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")))
        .when(t.fault == 3, ring(("x0", "y0"), ("x1", "y0"), ("x0", "y0")))
        .when(t.fault == 4, g.box(t.x0 + 300, t.y0, t.x1 + 300, t.y1))
        .when(t.fault == 5, g.make("Polygon", F.array().cast("array<array<array<struct<x:double,y:double>>>>")))
        .when(t.fault == 7, hole)
    )
    return t.withColumn("geom", geom)


_r = lambda c, n=6: F.round(c, n)


@query()
def p01_reproject(s, d):
    """To the UTM zone and back; columns are checked by a test against the ellipsoid and by the round trip."""
    t = fx.table(s, d, "points").withColumn("geom", g.point(F.col("x"), F.col("y")))
    u = g.reproject(F.col("geom"), 4326, 32637)
    back, web = g.reproject(u, 32637, 4326), g.reproject(F.col("geom"), 4326, 3857)
    v = lambda c: c["parts"][0][0][0]
    return t.select("fid", _r(v(u)["x"], 3).alias("e"), _r(v(u)["y"], 3).alias("n"), _r(v(back)["x"], 8).alias("lng"), _r(v(back)["y"], 8).alias("lat"), _r(v(web)["x"], 3).alias("wx"), _r(v(web)["y"], 3).alias("wy"))


# The oracle writes the projection's series out, for zone 37.
_N = g._N
_E = 2 * _N**0.5 / (1 + _N)


def utm_sql(name: str, source: str) -> str:
    """Two CTEs: of ``source`` all columns and, of its x and y in degrees, e and n in metres of zone 37."""
    e = " + ".join(f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(g._ALPHA, 1))
    n = " + ".join(f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(g._ALPHA, 1))
    return f"""{name}_t AS (SELECT *, radians(x - 39) AS lam, sinh(sign(sin(radians(y))) * asinh(abs(sin(radians(y)) / cos(radians(y)))) - {_E!r} * atanh({_E!r} * sin(radians(y)))) AS t FROM {source}),
{name} AS (SELECT *, 500000 + 0.9996e0 * {g._RADIUS!r} * (eta + {e}) AS e, 0.9996e0 * {g._RADIUS!r} * (xi + {n}) AS n FROM (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM {name}_t) AS u)"""


SQL["p01_reproject"] = f"""{fx.duck('points')}, {utm_sql('m', 'points')}
SELECT fid, round(e, 3) AS e, round(n, 3) AS n, round(x, 8) AS lng, round(y, 8) AS lat, round(radians(x) * 6378137, 3) AS wx, round(atanh(sin(radians(y))) * 6378137, 3) AS wy FROM m"""


@query(f"{fx.duck('points')} SELECT fid, CAST(CASE WHEN (y - 33.5e0) * 3 >= 0 THEN 32600 ELSE 32700 END + least(floor(((x - 36) * 400 - 200 + 180) / 6) + 1, 60) AS INTEGER) AS epsg FROM points")
def p02_utm_epsg(s, d):
    """Points are spread over the globe first, so that all zones come up."""
    return fx.table(s, d, "points").select("fid", g.utm_epsg((F.col("x") - 36) * 400 - 200, (F.col("y") - 33.5) * 3).alias("epsg"))


SQL["p02_utm_epsg"] = SQL["p02_utm_epsg"].replace("least(floor", "least(greatest(floor").replace(") + 1, 60)", ") + 1, 1), 60)")


@query(f"{fx.duck('parcels_old')} SELECT parcel_id, jurisdiction FROM parcels_old WHERE x1 >= 36.3e0 AND x0 <= 36.5e0 AND y1 >= 33.1e0 AND y0 <= 33.2e0")
def p03_bbox_filter(s, d):
    from landloom.operators.spatial import bbox_filter

    return bbox_filter(g.with_bbox(_boxes(s, d)), 36.3, 33.1, 36.5, 33.2).select("parcel_id", "jurisdiction")


@query(f"{fx.duck('entities')} SELECT eid, layer FROM entities WHERE layer = 'PARCELS' AND r > 5")
def p04_layer_filter(s, d):
    from landloom.operators.spatial import layer_filter

    return layer_filter(fx.table(s, d, "entities"), "PARCELS", "r > 5").select("eid", "layer")


@query(f"""{fx.duck('parcels_old')} SELECT fid, round(greatest(0, least(x1, 36.415e0) - greatest(x0, 36.203e0)) * greatest(0, least(y1, 33.2055e0) - greatest(y0, 33.1e0)), 12) AS area FROM parcels_old
  WHERE least(x1, 36.415e0) > greatest(x0, 36.203e0) AND least(y1, 33.2055e0) > greatest(y0, 33.1e0)""")
def p05_clip_box(s, d):
    t = _boxes(s, d).withColumn("cut", g.clip_box(F.col("geom"), 36.203, 33.1, 36.415, 33.2055))
    return t.where("cut is not null").select("fid", _r(g.area(F.col("cut")), 12).alias("area")).where("area > 0")


#: A box whose edges cut legs, bases and holes of the shapes.
_CUT = (36.2031, 33.1027, 36.4152, 33.2065)


@query(f"""{fx.duck('parcels_old')}, {US}, k AS (SELECT *, sign * greatest(0, least(c, {_CUT[2]}e0) - greatest(a, {_CUT[0]}e0)) * greatest(0, least(e, {_CUT[3]}e0) - greatest(b, {_CUT[1]}e0)) AS m FROM r),
  h AS (SELECT fid, a > {_CUT[0]}e0 AND c < {_CUT[2]}e0 AND b > {_CUT[1]}e0 AND e < {_CUT[3]}e0 AS kept, a > {_CUT[0]}e0 AND c < {_CUT[2]}e0 AND b < {_CUT[1]}e0 AND e > {_CUT[1]}e0 AS below FROM r WHERE part = 'hole')
  SELECT k.fid, round(sum(m), 12) AS area, CAST(CASE WHEN sum(CASE WHEN part = 'base' THEN m END) > 0 THEN 1 ELSE count(*) FILTER (WHERE part IN ('left', 'right') AND m > 0) END AS INTEGER) AS parts,
  CAST(count(*) FILTER (WHERE part = 'hole' AND kept) AS INTEGER) AS holes, CAST(0 AS INTEGER) AS faults FROM k LEFT JOIN h ON h.fid = k.fid GROUP BY k.fid HAVING sum(m) > 0""")
def p05_clip_of_shapes(s, d):
    """Concave and holed shapes cut by a box: area, number of parts and of holes, and faults of the geometry."""
    t = _us(s, d).where(g.reaches_box(F.col("geom"), *_CUT)).withColumn("cut", g.clip_box(F.col("geom"), *_CUT)).where("cut is not null")
    holes = F.aggregate(F.transform("cut.parts", lambda p: F.size(p) - 1), F.lit(0), lambda a, n: a + n)
    return t.select("fid", _r(g.area(F.col("cut")), 12).alias("area"), g.num_geometries(F.col("cut")).alias("parts"), holes.alias("holes"), F.size(g.geometry_flags(F.col("cut"))).alias("faults"))


@query(f"{fx.duck('parcels_old')} SELECT fid, x0 AS geom_attr, y0 AS GEOG_attr, x1 AS geom_attr_ FROM parcels_old")
def p06_disambiguate_props(s, d):
    t = fx.table(s, d, "parcels_old").select("fid", F.col("x0").alias("geom_attr"), F.col("y0").alias("GEOG"), F.col("x1").alias("geom"))
    return tx.disambiguate_props(t)


@query(f"""{fx.duck('parcels_old')} SELECT fid, CASE WHEN area_sqm IS NULL THEN 'NULL' ELSE CAST(CAST(area_sqm AS BIGINT) AS VARCHAR) || '.0' END AS area_literal,
  CASE WHEN for_sale THEN 'TRUE' ELSE 'FALSE' END AS sale_literal, '''' || replace('O''Brien ' || owner_name, '''', '''''') || '''' AS text_literal, CAST(fid AS VARCHAR) AS id_literal FROM parcels_old""")
def p07_sql_literal(s, d):
    t = fx.table(s, d, "parcels_old").withColumn("text", F.concat(F.lit("O'Brien "), "owner_name"))
    lit = lambda c: tx.sql_literal(F.col(c), t.schema[c].dataType)
    return t.select("fid", lit("area_sqm").alias("area_literal"), lit("for_sale").alias("sale_literal"), lit("text").alias("text_literal"), lit("fid").alias("id_literal"))


@query(f"{fx.duck('parcels_old')} SELECT fid, 'MultiPolygon' AS kind, CAST(1 AS INTEGER) AS n, CAST(5 AS INTEGER) AS points FROM parcels_old")
def p08_promote_to_multi(s, d):
    m = g.promote_to_multi(g.force_2d(F.col("geom")))
    return _boxes(s, d).select("fid", g.geometry_type(m).alias("kind"), g.num_geometries(m).alias("n"), g.npoints(m).alias("points"))


@query(f"{fx.duck('parcels_old')} SELECT fid, round((x1 - x0) * (y1 - y0), 12) AS signed FROM parcels_old")
def p09_orient_ccw(s, d):
    t = _boxes(s, d).withColumn("geom", F.when(F.col("fid") % 2 == 0, F.col("geom")).otherwise(g.make("Polygon", F.transform("geom.parts", lambda p: F.transform(p, F.reverse)))))
    return t.select("fid", _r(g.ring_area(g.orient_ccw(F.col("geom"))["parts"][0][0]), 12).alias("signed"))


#: Shapes out of the range of degrees: those moved there, and parcels of such numbers that they lie north of the pole.
_OUT = "(fault = 4 OR fault IN (0, 1, 2, 7) AND y1 > 90 OR fault = 3 AND y0 > 90)"


@query(f"""{fx.duck('odd')} SELECT fid, concat_ws(',', CASE fault WHEN 1 THEN 'self_crossing' WHEN 2 THEN 'ring_not_closed' WHEN 3 THEN 'short_ring' WHEN 5 THEN 'empty' WHEN 6 THEN 'empty' END, CASE WHEN {_OUT} THEN 'out_of_range' END) AS flags FROM odd""")
def p10_geometry_flags(s, d):
    return _odd(s, d).select("fid", F.array_join(g.geometry_flags(F.col("geom")), ",").alias("flags"))


@query(f"""{fx.duck('odd')}, t AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h, (x1 - x0) * (y1 - y0) AS a FROM odd)
  SELECT fid, round(CASE WHEN fault IN (0, 2, 4) THEN a WHEN fault IN (1, 3, 5) THEN 0 WHEN fault = 7 THEN a - 0.000001e0 END, 10) AS area,
  round(CASE fault WHEN 0 THEN 2 * (w + h) WHEN 1 THEN 2 * sqrt(w * w + h * h) + 2 * h WHEN 2 THEN 2 * w + h WHEN 3 THEN 2 * w WHEN 4 THEN 2 * (w + h) WHEN 5 THEN 0 WHEN 7 THEN 2 * (w + h) + 0.004e0 END, 9) AS perimeter,
  CAST([5, 5, 4, 3, 5, 0, NULL, 10][fault + 1] AS INTEGER) AS npoints, CAST([1, 1, 1, 1, 1, 0, NULL, 1][fault + 1] AS INTEGER) AS n, CAST(CASE WHEN fault <> 6 THEN 2 END AS INTEGER) AS dimension, CASE WHEN fault <> 6 THEN 'Polygon' END AS kind, CASE WHEN fault <> 6 THEN 0.0e0 END AS length,
  round(CASE WHEN fault = 7 THEN (a * (x0 + x1) / 2 - 0.000001e0 * (x0 + 0.0015e0)) / (a - 0.000001e0) WHEN fault = 3 THEN (2 * x0 + x1) / 3 WHEN fault IN (0, 2, 4) THEN (x0 + x1) / 2 + CASE WHEN fault = 4 THEN 300 ELSE 0 END END, 7) AS cx,
  round(CASE WHEN fault = 7 THEN (a * (y0 + y1) / 2 - 0.000001e0 * (y0 + 0.0015e0)) / (a - 0.000001e0) WHEN fault = 3 THEN y0 WHEN fault IN (0, 2, 4) THEN (y0 + y1) / 2 END, 7) AS cy,
  round(CASE WHEN fault IN (0, 1, 2, 4, 7) THEN a WHEN fault = 3 THEN 0 END, 10) AS envelope_area FROM t""")
def p11_measures(s, d):
    """Of all shapes; a bow-tie's area is 0, so that its centroid is left out."""
    c = F.col("geom")
    m = F.when(F.col("fault") != 1, g.centroid(c))
    return _odd(s, d).select("fid", _r(g.area(c), 10).alias("area"), _r(g.perimeter(c), 9).alias("perimeter"), g.npoints(c).alias("npoints"), g.num_geometries(c).alias("n"), g.dimension(c).alias("dimension"), g.geometry_type(c).alias("kind"), g.length(c).alias("length"), _r(m["x"], 7).alias("cx"), _r(m["y"], 7).alias("cy"), _r(g.area(g.envelope(c)), 10).alias("envelope_area"))


@query(f"""{fx.duck('parcels_old')}, c AS (SELECT fid, k, CASE WHEN k IN (0, 3, 4) THEN x0 ELSE x1 END AS x, CASE WHEN k IN (0, 1, 4) THEN y0 ELSE y1 END AS y FROM parcels_old CROSS JOIN (SELECT unnest(range(5)) AS k) AS r), {utm_sql('m', 'c')}
  SELECT a.fid, round(abs(sum((a.e - o.e) * (b.n - o.n) - (b.e - o.e) * (a.n - o.n))) / 2, 2) AS sqm FROM m a JOIN m b ON a.fid = b.fid AND b.k = a.k + 1 JOIN m o ON o.fid = a.fid AND o.k = 0 GROUP BY a.fid""")
def p12_area_sqm(s, d):
    """Corners go to the zone, and the ring's area there counts."""
    return _boxes(s, d).select("fid", _r(g.area_sqm(F.col("geom"), 32637), 2).alias("sqm"))


@query(f"""{fx.duck('facilities')} SELECT fid, round(2 * 6371008.8e0 * asin(sqrt(pow(sin(radians(33.5e0 - y) / 2), 2) + cos(radians(y)) * cos(radians(33.5e0)) * pow(sin(radians(36.5e0 - x) / 2), 2))), 3) AS metres FROM facilities""")
def p13_distance_sphere(s, d):
    return fx.table(s, d, "facilities").select("fid", _r(g.distance_sphere("x", "y", 36.5, 33.5), 3).alias("metres"))


def _vincenty_sql(rounds: int = 12) -> str:
    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)
    out = [f"v0 AS (SELECT fid, atan({1 - f!r} * tan(radians(y))) AS u1, atan({1 - f!r} * tan(radians(33.5e0))) AS u2, radians(36.5e0 - x) AS l, radians(36.5e0 - x) AS lam FROM facilities)"]
    for k in range(rounds):
        out.append(f"w{k} AS (SELECT fid, u1, u2, l, lam, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM v{k})")
        out.append(f"x{k} AS (SELECT *, atan2(ss, cs) AS sg, CASE WHEN ss = 0 THEN 0 ELSE cos(u1) * cos(u2) * sin(lam) / ss END AS sa FROM w{k})")
        out.append(f"y{k} AS (SELECT *, 1 - sa * sa AS c2a, CASE WHEN sa * sa = 1 THEN 0 ELSE cs - 2 * sin(u1) * sin(u2) / (1 - sa * sa) END AS c2m FROM x{k})")
        out.append(f"z{k} AS (SELECT *, {f!r} / 16 * c2a * (4 + {f!r} * (4 - 3 * c2a)) AS c FROM y{k})")
        out.append(f"v{k + 1} AS (SELECT fid, u1, u2, l, l + (1 - c) * {f!r} * sa * (sg + c * ss * (c2m + c * cs * (2 * c2m * c2m - 1))) AS lam FROM z{k})")
    last = rounds - 1
    out.append(f"k AS (SELECT *, c2a * {(a * a - b * b) / (b * b)!r} AS q FROM z{last})")
    out.append("m AS (SELECT *, 1 + q / 16384e0 * (4096 + q * (q * (320 - 175 * q) - 768)) AS ba, q / 1024e0 * (256 + q * (q * (74 - 47 * q) - 128)) AS sb FROM k)")
    return ", ".join(out) + f" SELECT fid, round({b!r} * ba * (sg - sb * ss * (c2m + sb / 4 * (cs * (2 * c2m * c2m - 1) - sb / 6 * c2m * (4 * ss * ss - 3) * (4 * c2m * c2m - 3)))), 3) AS metres FROM m"


@query(f"{fx.duck('facilities')}, {_vincenty_sql()}")
def p14_distance_geodesic(s, d):
    return fx.table(s, d, "facilities").select("fid", _r(g.distance_geodesic("x", "y", F.lit(36.5), F.lit(33.5)), 3).alias("metres"))


_NUM = "rtrim(rtrim(printf('%.6f', {}), '0'), '.')"
_RING = lambda sep, o, c: " || ', ' || ".join(f"'{o}' || {_NUM.format(x)} || '{sep}' || {_NUM.format(y)} || '{c}'" for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0")))


@query(f"""{fx.duck('parcels_old')}, t AS (SELECT fid, '{{"type": "Polygon", "coordinates": [[' || {_RING(', ', '[', ']')} || ']]}}' AS geojson, 'POLYGON ((' || {_RING(' ', '', '')} || '))' AS wkt FROM parcels_old)
  SELECT fid, geojson, wkt, CASE WHEN length(wkt) > 60 THEN left(wkt, 60) || '…' ELSE wkt END AS preview FROM t""")
def p15_geometry_text(s, d):
    c = F.col("geom")
    return _boxes(s, d).select("fid", g.to_geojson(c).alias("geojson"), g.to_wkt(c).alias("wkt"), g.wkt_preview(c, 60).alias("preview"))


@query(f"{fx.duck('points')} SELECT count(*) AS copies FROM points GROUP BY round(x, 6), round(y, 6)")
def p16_geometry_hash(s, d):
    t = fx.table(s, d, "points").withColumn("geom", g.point(F.col("x"), F.col("y")))
    return t.groupBy(g.geometry_hash(F.col("geom")).alias("h")).agg(F.count("*").alias("copies")).select("copies")


@query(f"""{fx.duck('parcels_old')}, t AS (SELECT zone_code, min(x0 * f) AS a, max(x1 * f) AS b, min(y0 * f) AS c, max(y1 * f) AS e FROM (SELECT *, CASE zone_code WHEN 'R-1' THEN 1e0 WHEN 'C-1' THEN 10000e0 ELSE -10000e0 END AS f FROM parcels_old) AS q GROUP BY zone_code)
  SELECT zone_code, CASE WHEN a >= -180 AND b <= 180 AND c >= -90 AND e <= 90 THEN 'geographic' WHEN a >= 100000 AND b <= 900000 AND c >= 0 AND e <= 10000000 THEN 'utm' ELSE 'local' END AS crs FROM t""")
def p17_infer_crs(s, d):
    f = F.when(F.col("zone_code") == "R-1", 1.0).when(F.col("zone_code") == "C-1", 10000.0).otherwise(-10000.0)
    t = fx.table(s, d, "parcels_old").groupBy("zone_code").agg(F.min(F.col("x0") * f).alias("a"), F.max(F.col("x1") * f).alias("b"), F.min(F.col("y0") * f).alias("c"), F.max(F.col("y1") * f).alias("e"))
    return t.select("zone_code", tx.infer_crs(F.col("a"), F.col("b"), F.col("c"), F.col("e")).alias("crs"))


@query(f"""{fx.duck('parcels_old')} SELECT fid, CASE WHEN fid % 4 = 0 THEN 'high: no CRS metadata in a drawing' WHEN fid % 4 = 1 THEN 'high: No CRS detected' WHEN fid % 4 = 2 THEN 'medium: Source CRS is EPSG:32637; reprojection to EPSG:4326 will be required' ELSE '' END AS warnings FROM parcels_old""")
def p18_crs_warnings(s, d):
    srid = F.when(F.col("fid") % 4 == 2, 32637).when(F.col("fid") % 4 == 3, 4326)
    return fx.table(s, d, "parcels_old").select("fid", F.array_join(tx.crs_warnings(srid, F.col("fid") % 4 == 0), "; ").alias("warnings"))


@query(f"""{fx.duck('entities')} SELECT eid, CASE layer WHEN 'PARCELS' THEN 'parcel' WHEN 'BUILDING_A' THEN 'building' WHEN 'ROAD_MAIN' THEN 'road' WHEN 'WATER_1' THEN 'utility' WHEN 'misc' THEN 'unknown' ELSE 'skip' END AS content FROM entities""")
def p19_classify_cad_layer(s, d):
    return fx.table(s, d, "entities").select("eid", tx.classify_cad_layer(F.col("layer")).alias("content"))


@query(f"""{fx.duck('entities')} SELECT eid, round(r * CASE eid % 10 WHEN 0 THEN 1.0e0 WHEN 1 THEN 0.0254e0 WHEN 2 THEN 0.3048e0 WHEN 4 THEN 0.001e0 WHEN 5 THEN 0.01e0 WHEN 6 THEN 1.0e0 WHEN 8 THEN 2.54e-8 WHEN 9 THEN 2.54e-5 END, 9) AS metres FROM entities""")
def p20_scale_units(s, d):
    return fx.table(s, d, "entities").select("eid", _r(tx.scale_units(F.col("r"), F.col("eid") % 10), 9).alias("metres"))


def entity_points(t: DataFrame) -> DataFrame:
    """Vertices along a square around the entity's centre, none to four."""
    at = [g.vertex(F.col("cx") + dx * F.col("r"), F.col("cy") + dy * F.col("r")) for dx, dy in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
    return t.withColumn("pts", F.slice(F.array(*at), 1, F.greatest(F.col("npts"), F.lit(0)).cast("int")))


@query(f"""{fx.duck('entities')}, t AS (SELECT *, CASE WHEN a1 < a0 THEN a1 + 360 ELSE a1 END - a0 AS sweep, CASE WHEN npts > 4 THEN 4 ELSE npts END AS n FROM entities),
u AS (SELECT eid, CASE WHEN dxftype = 'POINT' THEN 'Point' WHEN dxftype = 'LINE' AND n >= 2 THEN 'LineString' WHEN dxftype IN ('LWPOLYLINE', 'POLYLINE') AND closed AND n >= 3 THEN 'Polygon' WHEN dxftype IN ('LWPOLYLINE', 'POLYLINE') AND n >= 2 THEN 'LineString' WHEN dxftype = 'CIRCLE' THEN 'Polygon' WHEN dxftype = 'ARC' THEN 'LineString' END AS kind,
 CAST(CASE WHEN dxftype = 'POINT' THEN 1 WHEN dxftype = 'LINE' THEN 2 WHEN dxftype = 'CIRCLE' THEN 65 WHEN dxftype = 'ARC' THEN greatest(16, floor(sweep / 5.625e0)) + 1 WHEN closed AND n >= 3 THEN n + 1 ELSE n END AS INTEGER) AS points FROM t)
SELECT eid, kind, points FROM u WHERE kind IS NOT NULL""")
def p21_entity_to_geometry(s, d):
    c = F.col
    t = entity_points(fx.table(s, d, "entities"))
    geom = tx.entity_to_geometry(c("dxftype"), c("pts"), c("closed"), c("cx"), c("cy"), c("r"), c("a0"), c("a1"))
    t = t.select("eid", F.explode(F.array_compact(F.array(geom))).alias("geom"))  # so that a filter doesn't make each geometry once more
    return t.select("eid", c("geom.type").alias("kind"), g.npoints(c("geom")).alias("points"))


@query("""SELECT l_orderkey * 10 + l_linenumber AS k, round(CASE WHEN l_quantity <= 5 THEN 100 WHEN l_quantity >= 40 THEN 0 WHEN l_quantity <= 15 THEN 100 - 30 * (l_quantity - 5) / 10 ELSE 70 - 70 * (l_quantity - 15) / 25 END, 6) AS dec,
  round(CASE WHEN l_quantity <= 5 THEN 0 WHEN l_quantity >= 40 THEN 100 WHEN l_quantity < 15 THEN 70 * (l_quantity - 5) / 10 ELSE 70 + 30 * (l_quantity - 15) / 25 END, 6) AS inc,
  round(CASE WHEN l_quantity <= 5 OR l_quantity >= 40 THEN 0 WHEN l_quantity < 15 THEN 100 * (l_quantity - 5) / 10 ELSE 100 * (40 - l_quantity) / 25 END, 6) AS bell,
  CASE WHEN l_quantity * 2 >= 70 THEN 'RECOMMENDED' WHEN l_quantity * 2 >= 50 THEN 'CONDITIONAL' ELSE 'NOT RECOMMENDED' END AS verdict FROM lineitem""")
def p22_p25_score_curves(s, d):
    v = F.col("l_quantity")
    return s.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), _r(sc.score_linear_decreasing(v, 5, 15, 40)).alias("dec"), _r(sc.score_linear_increasing(v, 5, 15, 40)).alias("inc"), _r(sc.score_bell(v, 5, 15, 40)).alias("bell"), sc.verdict(v * 2).alias("verdict"))


@query("""WITH t AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN '<= ' || p_size WHEN 1 THEN '>' || p_size || '.5' WHEN 2 THEN CAST(p_size AS VARCHAR) ELSE 'about ' || p_size END AS text, p_size FROM part)
  SELECT k, CASE k % 4 WHEN 0 THEN '<=' WHEN 1 THEN '>' WHEN 2 THEN '=' END AS op, CASE k % 4 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN p_size + 0.5e0 WHEN 2 THEN CAST(p_size AS DOUBLE) END AS value,
  CASE k % 4 WHEN 0 THEN 20 <= p_size WHEN 1 THEN 20 > p_size + 0.5e0 WHEN 2 THEN 20 = p_size END AS met FROM t""")
def p28_parse_constraint(s, d):
    size = F.col("p_size").cast("string")
    t = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("k"), F.when(F.expr("p_partkey % 4 = 0"), F.concat(F.lit("<= "), size)).when(F.expr("p_partkey % 4 = 1"), F.concat(F.lit(">"), size, F.lit(".5"))).when(F.expr("p_partkey % 4 = 2"), size).otherwise(F.concat(F.lit("about "), size)).alias("text"))
    c = tx.parse_constraint(F.col("text"))
    return t.select("k", c["op"].alias("op"), c["value"].alias("value"), tx.holds(F.lit(20.0), c).alias("met"))


@query(f"{fx.duck('parcels_old')} SELECT fid, parcel_id, jurisdiction, neighborhood, zone_code, overlay, area_sqm, current_use, for_sale, price_per_sqm, footprint_area, x0, y0, x1, y1 FROM parcels_old")
def p29_strip_sensitive(s, d):
    return tx.strip_sensitive(fx.table(s, d, "parcels_old"))


@query(f"{fx.duck('parcels_new')} SELECT fid, CASE WHEN area_sqm IS NULL THEN 'area_sqm,' ELSE '' END || CASE WHEN footprint_area IS NULL THEN 'footprint_area,' ELSE '' END || 'survey_date' AS missing FROM parcels_new")
def p30_required_properties(s, d):
    t = fx.table(s, d, "parcels_new")
    return t.select("fid", F.array_join(tx.required_properties(t, ["area_sqm", "footprint_area", "survey_date"]), ",").alias("missing"))


@query("SELECT p_partkey AS k, 'طابو ' || p_partkey AS text FROM part")
def p31_normalize_digits(s, d):
    arabic = F.translate(F.col("p_partkey").cast("string"), "0123456789", "٠١٢٣٤٥٦٧٨٩")
    return s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("k"), tx.normalize_digits(F.concat(F.lit("طابو "), arabic)).alias("text"))


@query(f"{fx.duck('odd')} SELECT fid, CASE WHEN fault IN (5, 6) THEN 'no geometry' WHEN {_OUT} THEN 'out of range' ELSE 'kept' END AS outcome FROM odd")
def p34_quarantine(s, d):
    flags = g.geometry_flags(F.col("geom"))
    good, bad = tx.quarantine(_odd(s, d), F.when(F.array_contains(flags, "empty"), "no geometry").when(F.array_contains(flags, "out_of_range"), "out of range"))
    return good.select("fid", F.lit("kept").alias("outcome")).union(bad.select("fid", "reason"))
