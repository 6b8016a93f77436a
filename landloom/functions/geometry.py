"""Geometry as struct<type, parts>: parts of rings of vertices. Measures, checks and text are column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from landloom.functions import helpers, kernels

VERTEX = "struct<x:double,y:double>"
GEOM = f"struct<type:string,parts:array<array<array<{VERTEX}>>>>"

_RING = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
GEOM_TYPE = T.StructType([T.StructField("type", T.StringType()), T.StructField("parts", T.ArrayType(T.ArrayType(_RING)))])

_c = lambda v: v if isinstance(v, Column) else F.lit(float(v)) if isinstance(v, (int, float)) else F.col(v)


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


# --- making -----------------------------------------------------------------------------------------------------------


def vertex(x: Column, y: Column) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def make(kind: str | Column, parts: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("type"), parts.alias("parts")).cast(GEOM)


def point(x: Column, y: Column) -> Column:
    return make("Point", F.array(F.array(F.array(vertex(x, y)))))


def line(*at: tuple[Column, Column]) -> Column:
    return make("LineString", F.array(F.array(F.array(*[vertex(x, y) for x, y in at]))))


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A counter-clockwise closed rectangle."""
    return make("Polygon", F.array(F.array(F.array(*[vertex(x, y) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]))))


# --- parts ------------------------------------------------------------------------------------------------------------


def vertices(g: Column) -> Column:
    return F.flatten(F.flatten(g["parts"]))


def is_area(g: Column) -> Column:
    return g["type"].isin("Polygon", "MultiPolygon")


def is_empty(g: Column) -> Column:
    """True for null and for geometries without a vertex."""
    return g.isNull() | F.coalesce(F.size(vertices(g)) <= 0, F.lit(True))


def bbox(g: Column) -> Column:
    """struct<xmin,ymin,xmax,ymax>; null for null and empty."""
    xs, ys = F.transform(vertices(g), lambda p: p["x"]), F.transform(vertices(g), lambda p: p["y"])
    return F.when(~is_empty(g), F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax")))


def with_bbox(df, geom: str = "geom"):
    """``df`` with columns xmin to ymax; null for null and empty geometries. The box is computed once a row."""
    v = f"flatten(flatten({geom}.parts))"
    ends = ", ".join(f"'{c}{end}', array_{end}(transform(v, p -> p.{c}))" for end in ("min", "max") for c in ("x", "y"))
    rows = df.withColumn("_box", F.expr(f"transform(array({v}), v -> if(size(v) > 0, named_struct({ends}), null))[0]"))
    return rows.select(*df.columns, *[F.col(f"_box.{n}").alias(n) for n in ("xmin", "ymin", "xmax", "ymax")])


def _pairs(ring: Column, make_pair) -> Column:
    n = F.size(ring)
    return F.when(n > 1, F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), make_pair)).otherwise(F.array().cast("array<double>"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def ring_area(ring: Column) -> Column:
    """Signed area, positive counter-clockwise, measured from the first vertex so that small rings far out keep their digits."""
    o = ring[0]
    return _sum(_pairs(ring, lambda a, b: (a["x"] - o["x"]) * (b["y"] - o["y"]) - (b["x"] - o["x"]) * (a["y"] - o["y"]))) / 2


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def ring_length(ring: Column) -> Column:
    return _sum(_pairs(ring, _distance))


def area(g: Column) -> Column:
    """Planar area in source units, holes taken off; 0 for points and lines, null for null."""
    rings = F.flatten(F.transform(g["parts"], lambda part: F.transform(part, lambda r, k: F.when(k == 0, F.abs(ring_area(r))).otherwise(-F.abs(ring_area(r))))))
    return F.when(is_area(g), _sum(rings)).when(g.isNotNull(), F.lit(0.0))


def length(g: Column) -> Column:
    """Planar length of lines; 0 for other types, null for null."""
    return F.when(g["type"].isin("LineString", "MultiLineString"), _sum(F.transform(F.flatten(g["parts"]), ring_length))).when(g.isNotNull(), F.lit(0.0))


def perimeter(g: Column) -> Column:
    return F.when(is_area(g), _sum(F.transform(F.flatten(g["parts"]), ring_length))).when(g.isNotNull(), F.lit(0.0))


def npoints(g: Column) -> Column:
    return F.when(g.isNotNull(), F.size(vertices(g)))


def num_geometries(g: Column) -> Column:
    return F.when(g.isNotNull(), F.size(g["parts"]))


def dimension(g: Column) -> Column:
    return F.when(is_area(g), 2).when(g["type"].endswith("LineString"), 1).when(g.isNotNull(), 0)


def geometry_type(g: Column) -> Column:
    return g["type"]


def envelope(g: Column) -> Column:
    b = bbox(g)
    return F.when(b.isNotNull(), box(b["xmin"], b["ymin"], b["xmax"], b["ymax"]))


def centroid(g: Column) -> Column:
    """struct<x,y>: weighted by area for polygons and by length for lines; the vertices' mean for points and where all weights are 0."""
    v = vertices(g)
    n = F.size(v)
    o = v[0]
    mean = lambda f: _sum(F.transform(v, lambda p: p[f] - o[f])) / n + o[f]

    def of_ring(r: Column, k: Column) -> Column:
        cross = lambda a, b: (a["x"] - o["x"]) * (b["y"] - o["y"]) - (b["x"] - o["x"]) * (a["y"] - o["y"])
        part = lambda f: _sum(_pairs(r, lambda a, b: (a[f] + b[f] - 2 * o[f]) * cross(a, b)))
        sums = F.struct(_sum(_pairs(r, cross)).alias("w"), part("x").alias("x"), part("y").alias("y"))
        return let(sums, lambda s: let(F.when((s["w"] < 0) == (k == 0), -1.0).otherwise(1.0), lambda sign: F.struct((s["w"] * sign).alias("w"), (s["x"] * sign / 3).alias("x"), (s["y"] * sign / 3).alias("y"))))

    def of_line(r: Column, k: Column) -> Column:
        part = lambda f: _sum(_pairs(r, lambda a, b: ((a[f] + b[f]) / 2 - o[f]) * _distance(a, b)))
        return F.struct(ring_length(r).alias("w"), part("x").alias("x"), part("y").alias("y"))

    def weighted(of) -> Column:
        parts = F.flatten(F.transform(g["parts"], lambda part: F.transform(part, of)))
        total = F.aggregate(
            parts,
            F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")),
            lambda a, p: F.struct((a["w"] + p["w"]).alias("w"), (a["x"] + p["x"]).alias("x"), (a["y"] + p["y"]).alias("y")),
        )
        return let(total, lambda t: F.when(t["w"] != 0, F.struct((t["x"] / t["w"] + o["x"]).alias("x"), (t["y"] / t["w"] + o["y"]).alias("y"))))

    plain = F.struct(mean("x").alias("x"), mean("y").alias("y"))
    return F.when(~is_empty(g), F.coalesce(F.when(is_area(g), weighted(of_ring)).when(g["type"].endswith("LineString"), weighted(of_line)), plain))


# --- changing ---------------------------------------------------------------------------------------------------------


def map_vertices(g: Column, f) -> Column:
    return F.when(g.isNotNull(), make(g["type"], F.transform(g["parts"], lambda part: F.transform(part, lambda r: F.transform(r, f)))))


def force_2d(g: Column) -> Column:
    """Vertices with x and y only, whatever further fields theirs have."""
    return map_vertices(g, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))


def promote_to_multi(g: Column) -> Column:
    return F.when(g.isNotNull(), make(F.when(g["type"].startswith("Multi"), g["type"]).otherwise(F.concat(F.lit("Multi"), g["type"])), g["parts"]))


def orient_ccw(g: Column) -> Column:
    """Exterior rings counter-clockwise, holes clockwise; other types as they are."""
    turn = lambda r, k: F.when((ring_area(r) < 0) == (k == 0), F.reverse(r)).otherwise(r)
    return F.when(is_area(g), make(g["type"], F.transform(g["parts"], lambda part: F.transform(part, turn)))).otherwise(g)


# --- coordinate systems -----------------------------------------------------------------------------------------------

# WGS84, and the series coefficients of the transverse Mercator projection in its third flattening, to the fourth order.
A, FLAT = 6378137.0, 1 / 298.257223563
_N = FLAT / (2 - FLAT)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)
_SCALE, _EAST = 0.9996, 500000.0
#: The mean radius.
SPHERE = 6371008.8


def utm_epsg(lng: Column, lat: Column) -> Column:
    """32600 or 32700 plus the zone, which is kept within 1 to 60."""
    zone = F.least(F.greatest(F.floor((_c(lng) + 180) / 6) + 1, F.lit(1)), F.lit(60))
    return (F.when(_c(lat) >= 0, 32600).otherwise(32700) + zone).cast("int")


def to_utm(lng: Column, lat: Column, srid: Column | int) -> Column:
    """struct<x,y> in metres of that zone."""
    s = F.lit(srid) if isinstance(srid, int) else srid
    lam = F.radians(_c(lng) - ((s % 100) * 6 - 183))
    phi = F.radians(_c(lat))
    e = 2 * math.sqrt(_N) / (1 + _N)
    sp = F.sin(phi)
    steep = F.signum(sp) * F.asinh(F.abs(sp / F.cos(phi)))  # atanh(sp), which loses digits towards the poles
    t = F.sinh(steep - e * F.atanh(e * sp))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x = eta + sum(a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    y = xi + sum(a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    south = F.when(F.floor(s / 100) == 327, 10000000.0).otherwise(0.0)
    return F.struct((_EAST + _SCALE * _RADIUS * x).alias("x"), (south + _SCALE * _RADIUS * y).alias("y"))


def from_utm(x: Column, y: Column, srid: Column | int) -> Column:
    """struct<x,y> of degrees."""
    s = F.lit(srid) if isinstance(srid, int) else srid
    south = F.when(F.floor(s / 100) == 327, 10000000.0).otherwise(0.0)
    xi, eta = (_c(y) - south) / (_SCALE * _RADIUS), (_c(x) - _EAST) / (_SCALE * _RADIUS)
    xp = xi - sum(b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(_BETA, 1))
    ep = eta - sum(b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(_BETA, 1))
    chi = F.asin(F.sin(xp) / F.cosh(ep))
    phi = chi + sum(d * F.sin(2 * j * chi) for j, d in enumerate(_DELTA, 1))
    lam = F.atan2(F.sinh(ep), F.cos(xp))
    return F.struct((F.degrees(lam) + (s % 100) * 6 - 183).alias("x"), F.degrees(phi).alias("y"))


def _known(srid: int) -> str:
    if srid == 4326:
        return "degrees"
    if srid == 3857:
        return "web"
    if srid // 100 in (326, 327) and 1 <= srid % 100 <= 60:
        return "utm"
    raise ValueError(f"EPSG:{srid} isn't supported; only 4326, 3857 and WGS84 UTM zones are")


def reproject_vertex(p: Column, src: int, dst: int) -> Column:
    kind = _known(src)
    if kind == "utm":
        p = from_utm(p["x"], p["y"], src)
    elif kind == "web":
        p = F.struct(F.degrees(p["x"] / A).alias("x"), F.degrees(F.atan(F.sinh(p["y"] / A))).alias("y"))
    kind = _known(dst)
    if kind == "utm":
        return to_utm(p["x"], p["y"], dst)
    if kind == "web":
        return F.struct((F.radians(p["x"]) * A).alias("x"), (F.atanh(F.sin(F.radians(p["y"]))) * A).alias("y"))
    return p


def reproject(g: Column, src: int | None, dst: int) -> Column:
    """The geometry in another coordinate system, x first; unchanged where the source is unknown or the same, null for null."""
    return g if src is None or src == dst else map_vertices(g, lambda p: reproject_vertex(p, src, dst))


def area_sqm(g: Column, srid: int) -> Column:
    """Square metres in a UTM zone, from degrees."""
    return area(reproject(g, 4326, srid))


def distance_sphere(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Great-circle metres on a sphere of the mean radius."""
    x1, y1, x2, y2 = map(_c, (x1, y1, x2, y2))
    h = F.pow(F.sin(F.radians(y2 - y1) / 2), 2) + F.cos(F.radians(y1)) * F.cos(F.radians(y2)) * F.pow(F.sin(F.radians(x2 - x1) / 2), 2)
    return F.lit(2 * SPHERE) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


@F.pandas_udf(T.DoubleType())
def distance_geodesic(x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.Series:
    """WGS84 ellipsoid metres; null where a coordinate is null."""
    out = pd.Series(helpers.vincenty(*(s.to_numpy(np.float64, na_value=np.nan) for s in (x1, y1, x2, y2))))
    return out.where(out.notna(), None)


# --- checks and text --------------------------------------------------------------------------------------------------


def ring_sides(rings: Column) -> Column:
    """array<struct<p,q>>: the sides of rings or lines; one of a single vertex is a side of length 0."""
    two = lambda r: F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    return F.flatten(F.transform(rings, lambda r: F.when(F.size(r) > 1, two(r)).otherwise(F.transform(r, lambda p: F.struct(p.alias("p"), p.alias("q"))))))


def sides(g: Column) -> Column:
    return ring_sides(F.flatten(g["parts"]))


def turn(p: Column, q: Column, x: Column, y: Column) -> Column:
    """Over 0 where (x, y) is to the left of the way from p to q, 0 on its line."""
    return (q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"])


def on_side(s: Column, x: Column, y: Column) -> Column:
    between = lambda f, v: (v >= F.least(s["p"][f], s["q"][f])) & (v <= F.greatest(s["p"][f], s["q"][f]))
    return (turn(s["p"], s["q"], x, y) == 0) & between("x", x) & between("y", y)


def sides_meet(s: Column, t: Column) -> Column:
    """Whether two closed sides have a point in common."""
    boxes = F.lit(True)
    for f in ("x", "y"):
        boxes &= (F.least(s["p"][f], s["q"][f]) <= F.greatest(t["p"][f], t["q"][f])) & (F.greatest(s["p"][f], s["q"][f]) >= F.least(t["p"][f], t["q"][f]))
    apart = lambda a, b: F.signum(a) * F.signum(b) <= 0
    # Where boxes meet and neither side's ends are strictly on one side of the other, the sides meet.
    of = lambda a, b: apart(turn(a["p"], a["q"], b["p"]["x"], b["p"]["y"]), turn(a["p"], a["q"], b["q"]["x"], b["q"]["y"]))
    return boxes & of(s, t) & of(t, s)


def in_polygon(x: Column, y: Column, g: Column) -> Column:
    """Whether a point is in a polygon or on its boundary; sides are counted that a ray to the right crosses."""
    all_sides = sides(g)
    on = F.exists(all_sides, lambda s: on_side(s, x, y))
    rises = lambda s: s["q"]["y"] > s["p"]["y"]
    t = lambda s: turn(s["p"], s["q"], x, y)
    crossed = F.size(F.filter(all_sides, lambda s: ((s["p"]["y"] > y) != (s["q"]["y"] > y)) & F.when(rises(s), t(s) > 0).otherwise(t(s) < 0)))
    return on | (crossed % 2 == 1)


def self_crossing(g: Column) -> Column:
    """Whether sides of a polygon's ring meet anywhere but at the corners that neighbours share."""

    def of_ring(ring: Column) -> Column:
        # Without the repeated end; sides are numbered and each meets the later ones that it isn't next to. Neighbours may not turn back.
        return let(F.when((F.size(ring) > 1) & (ring[0] == F.element_at(ring, -1)), F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring), lambda pts: of_points(pts))

    def of_points(pts: Column) -> Column:
        n = F.size(pts)
        at = lambda k: F.get(pts, k % n)
        numbered = F.transform(pts, lambda p, k: F.struct(p.alias("p"), at(k + 1).alias("q"), at(k + 2).alias("r"), k.alias("k")))

        def back(s: Column) -> Column:
            ahead = (s["p"]["x"] - s["q"]["x"]) * (s["r"]["x"] - s["q"]["x"]) + (s["p"]["y"] - s["q"]["y"]) * (s["r"]["y"] - s["q"]["y"])
            return (n > 2) & (turn(s["p"], s["q"], s["r"]["x"], s["r"]["y"]) == 0) & (ahead > 0)

        far = lambda s, t: (t["k"] > s["k"] + 1) & ~((s["k"] == 0) & (t["k"] == n - 1))
        return let(numbered, lambda all_: F.exists(all_, lambda s: back(s) | F.exists(all_, lambda t: far(s, t) & sides_meet(s, t))))

    return F.coalesce(is_area(g) & F.exists(F.flatten(g["parts"]), of_ring), F.lit(False))


def _first_vertices(g: Column) -> Column:
    return F.filter(F.transform(g["parts"], lambda part: part[0][0]), lambda v: v.isNotNull())


def intersects(a: Column, b: Column) -> Column:
    """Whether two geometries have a point in common: sides that meet, or one within the other; false for null. Points, lines and polygons of any form."""
    crossing = let(sides(b), lambda other: F.exists(sides(a), lambda s: F.exists(other, lambda t: sides_meet(s, t))))
    within = lambda x, y: is_area(y) & F.exists(_first_vertices(x), lambda v: in_polygon(v["x"], v["y"], y))
    return F.coalesce(a.isNotNull() & b.isNotNull() & (crossing | within(a, b) | within(b, a)), F.lit(False))


def contains(a: Column, b: Column) -> Column:
    """Whether polygon a holds all of b, which may touch its boundary; false for null and empty.

    The sides of b are cut where a's sides cross them or have an end on them; b is held if its vertices and the middles of all pieces are, and no hole's vertex of a lies inside b.
    """

    def pieces(s: Column, edges: Column) -> Column:
        """Places along a side, from 0 to 1, at which an edge crosses or touches it."""
        dx, dy = s["q"]["x"] - s["p"]["x"], s["q"]["y"] - s["p"]["y"]

        def along(e: Column) -> Column:
            ex, ey = e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]
            cross = dx * ey - dy * ex
            t = ((e["p"]["x"] - s["p"]["x"]) * ey - (e["p"]["y"] - s["p"]["y"]) * ex) / F.when(cross != 0, cross)
            end = lambda v: F.when(on_side(s, v["x"], v["y"]), F.when(F.abs(dx) > F.abs(dy), (v["x"] - s["p"]["x"]) / F.when(dx != 0, dx)).otherwise((v["y"] - s["p"]["y"]) / F.when(dy != 0, dy)))
            return F.array(F.when(sides_meet(s, e), t), end(e["p"]), end(e["q"]))

        inner = F.filter(F.flatten(F.transform(edges, along)), lambda t: (t > 0) & (t < 1))
        return F.array_sort(F.concat(F.array(F.lit(0.0)), inner, F.array(F.lit(1.0))))

    def middles_in(s: Column, edges: Column) -> Column:
        def held(ts: Column) -> Column:
            pairs = F.zip_with(F.slice(ts, 1, F.size(ts) - 1), F.slice(ts, 2, F.size(ts) - 1), lambda u, v: F.struct(((u + v) / 2).alias("m"), (v - u).alias("w")))
            inside = lambda m: in_polygon(s["p"]["x"] + m * (s["q"]["x"] - s["p"]["x"]), s["p"]["y"] + m * (s["q"]["y"] - s["p"]["y"]), a)
            return F.forall(pairs, lambda x: (x["w"] < 1e-9) | inside(x["m"]))

        crossed = F.exists(edges, lambda e: sides_meet(s, e))
        return F.when(crossed, let(pieces(s, edges), held)).otherwise(F.lit(True))

    corners = F.forall(vertices(b), lambda v: in_polygon(v["x"], v["y"], a))
    lines = let(sides(a), lambda edges: F.forall(sides(b), lambda s: middles_in(s, edges)))
    strictly = lambda v: in_polygon(v["x"], v["y"], b) & ~F.exists(sides(b), lambda s: on_side(s, v["x"], v["y"]))
    hole = is_area(b) & F.exists(F.flatten(F.transform(a["parts"], lambda part: F.slice(part, 2, F.greatest(F.size(part) - 1, F.lit(0))))), lambda r: F.exists(r, strictly))
    return F.coalesce(is_area(a) & ~is_empty(b) & corners & lines & ~hole, F.lit(False))


@F.arrow_udf(T.DoubleType())
def overlap_area(a: pa.Array, b: pa.Array) -> pa.Array:
    """Area common to two polygons; 0 if one is null. A batch is measured at once."""
    return pa.array(kernels.overlap_areas(a, b))


@F.arrow_udf(GEOM_TYPE)
def _clip(g: pa.Array, x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array) -> pa.Array:
    return kernels.clipped(g, x0, y0, x1, y1)


def _clip_lines(g: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """The pieces of lines inside a box, as a multi-line of their sides; null if there are none."""

    def piece(s: Column) -> Column:
        dx, dy = s["q"]["x"] - s["p"]["x"], s["q"]["y"] - s["p"]["y"]
        enter, leave, outside = [F.lit(0.0)], [F.lit(1.0)], F.lit(False)
        for d, at, low, high in ((dx, s["p"]["x"], x0, x1), (dy, s["p"]["y"], y0, y1)):
            step = F.when(d != 0, d)
            to_low, to_high = (low - at) / step, (high - at) / step
            enter.append(F.coalesce(F.least(to_low, to_high), F.lit(0.0)))
            leave.append(F.coalesce(F.greatest(to_low, to_high), F.lit(1.0)))
            outside |= (d == 0) & ((at < low) | (at > high))
        ends = F.struct(F.greatest(*enter).alias("t"), F.least(*leave).alias("u"))
        where = lambda t: vertex(s["p"]["x"] + t * dx, s["p"]["y"] + t * dy)
        return F.when(~outside, let(ends, lambda e: F.when(e["t"] < e["u"], F.array(F.array(F.when(e["t"] == 0, s["p"]).otherwise(where(e["t"])), F.when(e["u"] == 1, s["q"]).otherwise(where(e["u"])))))))

    return let(F.array_compact(F.transform(sides(g), piece)), lambda parts: F.when(F.size(parts) > 0, make("MultiLineString", parts)))


def _apart(b: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    return (b["xmax"] < x0) | (b["xmin"] > x1) | (b["ymax"] < y0) | (b["ymin"] > y1)


def reaches_box(g: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """Whether the bounding box meets the box; null for none. What doesn't has no part inside, so it needn't go to ``clip_box``."""
    return let(bbox(g), lambda b: ~_apart(b, x0, y0, x1, y1))


def clip_box(g: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """The part of a geometry inside a box; null if there is none. Lines across the edge come back as a multi-line of their pieces, points of a multi-point one by one. A polygon across the edge comes back as its true parts, each with the holes that it keeps. Only these leave the JVM."""
    inside = lambda b: (b["xmin"] >= x0) & (b["xmax"] <= x1) & (b["ymin"] >= y0) & (b["ymax"] <= y1)
    place = let(bbox(g), lambda b: F.when(inside(b), "in").when(~_apart(b, x0, y0, x1, y1), "across"))
    across = F.when((place == "across") & is_area(g), g)
    held = F.filter(g["parts"], lambda part: (part[0][0]["x"] >= x0) & (part[0][0]["x"] <= x1) & (part[0][0]["y"] >= y0) & (part[0][0]["y"] <= y1))
    return (
        F.when(place == "in", g)
        .when((place == "across") & is_area(g), F.when(across.isNotNull(), _clip(across, F.lit(float(x0)), F.lit(float(y0)), F.lit(float(x1)), F.lit(float(y1)))))
        .when((place == "across") & g["type"].endswith("LineString"), _clip_lines(g, float(x0), float(y0), float(x1), float(y1)))
        .when((place == "across") & (g["type"] == "MultiPoint"), F.when(F.size(held) > 0, make(g["type"], held)))
    )


def geometry_flags(g: Column) -> Column:
    """Names of the faults of a geometry: empty, self_crossing, ring_not_closed, short_ring, out_of_range, antimeridian."""
    rings = F.flatten(g["parts"])
    v, b = vertices(g), bbox(g)
    closed = lambda r: (F.size(r) > 0) & (r[0]["x"] == F.element_at(r, -1)["x"]) & (r[0]["y"] == F.element_at(r, -1)["y"])
    flags = {
        "empty": is_empty(g),
        "self_crossing": F.when(is_area(g), self_crossing(g)),
        "ring_not_closed": is_area(g) & F.exists(rings, lambda r: ~closed(r)),
        "short_ring": is_area(g) & F.exists(rings, lambda r: F.size(r) < 4),
        "out_of_range": F.exists(v, lambda p: (F.abs(p["x"]) > 180) | (F.abs(p["y"]) > 90)),
        "antimeridian": b["xmax"] - b["xmin"] > 180,
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in flags.items()]))


def number(x: Column, digits: int = 6) -> Column:
    """A double as text without exponent: up to so many decimals, half up, trailing zeros gone."""
    usual = F.coalesce(x.cast(f"decimal({18 + digits},{digits})").cast("string"), F.when(F.isnan(x) | (F.abs(x) > 1e17), F.format_string(f"%.{digits}f", x)))
    bare = F.rtrim(F.rtrim(usual, F.lit("0")), F.lit(".")) if digits else usual
    return F.when(bare == "-0", "0").otherwise(F.when(usual.contains("."), bare).otherwise(usual)) if digits else bare


def _nested(g: Column, pair, open_: str, close: str, sep: str) -> dict[str, Column]:
    wrap = lambda items: F.concat(F.lit(open_), F.array_join(items, sep), F.lit(close))
    ring = lambda r: wrap(F.transform(r, pair))
    part = lambda p: wrap(F.transform(p, ring))
    return {
        "Point": pair(g["parts"][0][0][0]),
        "MultiPoint": wrap(F.transform(vertices(g), pair)),
        "LineString": ring(g["parts"][0][0]),
        "MultiLineString": wrap(F.transform(F.flatten(g["parts"]), ring)),
        "Polygon": part(g["parts"][0]),
        "MultiPolygon": wrap(F.transform(g["parts"], part)),
    }


def to_geojson(g: Column, digits: int = 6) -> Column:
    """GeoJSON text of a geometry; null for null and empty."""
    pair = lambda p: F.concat(F.lit("["), number(p["x"], digits), F.lit(", "), number(p["y"], digits), F.lit("]"))
    out = F.lit(None).cast("string")
    for kind, text in _nested(g, pair, "[", "]", ", ").items():
        out = F.when(g["type"] == kind, text).otherwise(out)
    return F.when(~is_empty(g), F.concat(F.lit('{"type": "'), g["type"], F.lit('", "coordinates": '), out, F.lit("}")))


def to_wkt(g: Column, digits: int = 6) -> Column:
    """Well-known text; EMPTY for empty, null for null."""
    pair = lambda p: F.concat(number(p["x"], digits), F.lit(" "), number(p["y"], digits))
    out = F.lit(None).cast("string")
    for kind, text in _nested(g, pair, "(", ")", ", ").items():
        out = F.when(g["type"] == kind, F.concat(F.lit("("), text, F.lit(")")) if kind == "Point" else text).otherwise(out)
    return F.when(g.isNull(), None).when(is_empty(g), F.concat(F.upper(g["type"]), F.lit(" EMPTY"))).otherwise(F.concat(F.upper(g["type"]), F.lit(" "), out))


def wkt_preview(g: Column, n: int = 200) -> Column:
    text = to_wkt(g)
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def geometry_text(g: Column) -> Column:
    """Canonical text: type and coordinates to 6 decimals, in order of the vertices."""
    return F.when(g.isNotNull(), F.concat(g["type"], F.lit(":"), F.to_json(F.transform(vertices(g), lambda p: F.array(F.round(p["x"], 6), F.round(p["y"], 6))))))


def geometry_hash(g: Column) -> Column:
    return F.xxhash64(geometry_text(g))
