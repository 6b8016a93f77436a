"""Geometry functions and helpers: break points, closed forms, round trips and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import pyarrow as pa

from landloom.functions import geometry as g, helpers as h, kernels, scoring as sc, text as tx

BOX = [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]]]


def moved(parts, dx, dy):
    return [[[(x + dx, y + dy) for x, y in r] for r in p] for p in parts]


# --- brute force for what the library says by column expressions and in batches: sides and triangles one by one -------


def half(ring: list, keep, cross) -> list:
    out = []
    for p, q in zip(ring, ring[1:] + ring[:1]):
        if keep(p):
            out.append(p)
        if keep(p) != keep(q):
            out.append(cross(p, q))
    return out


def of_triangles(ring: list, by: list) -> list:
    """The part of a triangle inside another, both counter-clockwise."""
    for a, b in zip(by, by[1:] + by[:1]):
        side = lambda p, a=a, b=b: turned(a, b, p)
        ring = half(ring, lambda p, side=side: side(p) >= 0, lambda p, q, side=side: tuple(p[i] + side(p) / (side(p) - side(q)) * (q[i] - p[i]) for i in (0, 1)))
        if not ring:
            return []
    return ring


def triangles(parts: list) -> list:
    """Signed triangles that sum to a (multi)polygon, whatever way its rings turn."""
    out = []
    for part in parts:
        for k, ring in enumerate(part):
            ring = h.open_ring(ring)
            way = (1 if h.signed_area(ring) >= 0 else -1) * (1 if k == 0 else -1)
            for p, q in zip(ring[1:], ring[2:]):
                t, a = [ring[0], p, q], h.signed_area([ring[0], p, q])
                if a:
                    out.append((way if a > 0 else -way, t if a > 0 else t[::-1]))
    return out


def slow_overlap(a: list, b: list) -> float:
    return max(0.0, sum(s * r * h.signed_area(of_triangles(t, u)) for s, t in triangles(a) for r, u in triangles(b)))


def as_arrow(geoms: list) -> pa.Array:
    """Polygons (lists of parts, or None) as the library holds them."""
    vertex = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    kind = pa.struct([("type", pa.string()), ("parts", pa.list_(pa.list_(pa.list_(vertex))))])
    return pa.array([None if x is None else {"type": "Polygon" if len(x) == 1 else "MultiPolygon", "parts": [[[{"x": float(p[0]), "y": float(p[1])} for p in r] for r in part] for part in x]} for x in geoms], kind)


def overlap(a: list, b: list) -> float:
    return float(kernels.overlap_areas(as_arrow([a]), as_arrow([b]))[0])


def turned(p, q, r) -> float:
    return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])


def _on(p, q, r) -> bool:
    return turned(p, q, r) == 0 and min(p[0], q[0]) <= r[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= r[1] <= max(p[1], q[1])


def segments_meet(a, b, c, d) -> bool:
    """Whether two closed segments have a point in common."""
    t = turned(a, b, c), turned(a, b, d), turned(c, d, a), turned(c, d, b)
    if ((t[0] > 0 > t[1]) or (t[0] < 0 < t[1])) and ((t[2] > 0 > t[3]) or (t[2] < 0 < t[3])):
        return True
    return _on(a, b, c) or _on(a, b, d) or _on(c, d, a) or _on(c, d, b)


def crosses_itself(ring: list) -> bool:
    """Whether sides of a closed ring meet anywhere but at the corners that neighbours share."""
    pts = h.open_ring(ring)
    n = len(pts)
    sides = [(pts[i], pts[(i + 1) % n]) for i in range(n)]
    for i in range(n):
        for j in range(i + 1, n):
            near = j == i + 1 or (i == 0 and j == n - 1)
            if near:
                a, b = (sides[i], sides[j]) if j == i + 1 else (sides[j], sides[i])
                if n > 2 and turned(a[0], a[1], b[1]) == 0 and (a[0][0] - a[1][0]) * (b[1][0] - a[1][0]) + (a[0][1] - a[1][1]) * (b[1][1] - a[1][1]) > 0:
                    return True
            elif segments_meet(*sides[i], *sides[j]):
                return True
    return False


def where(p, rings: list) -> int:
    """1 inside a polygon, 0 on its boundary, -1 outside."""
    inside = False
    for ring in rings:
        pts = h.open_ring(ring)
        for a, b in zip(pts, pts[1:] + pts[:1]):
            if _on(a, b, p):
                return 0
            if (a[1] > p[1]) != (b[1] > p[1]) and (p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]):
                inside = not inside
    return 1 if inside else -1


def _sides(parts: list) -> list[tuple]:
    return [s for part in parts for ring in part for s in (zip(ring, ring[1:]) if len(ring) > 1 else [(ring[0], ring[0])] if ring else [])]


def meet(a: list, b: list, area_a: bool, area_b: bool) -> bool:
    """Whether two geometries (points, lines or, by the flags, polygons) have a point in common."""
    if any(segments_meet(*s, *t) for s in _sides(a) for t in _sides(b)):
        return True
    if area_b and any(where(part[0][0], q) >= 0 for part in a if part and part[0] for q in b):
        return True
    return area_a and any(where(part[0][0], q) >= 0 for part in b if part and part[0] for q in a)


def contains(a: list, b: list, area_b: bool) -> bool:
    """Whether polygon a holds all of b, which may touch its boundary."""
    points = [p for part in b for ring in part for p in ring]
    if not points or not all(any(where(p, part) >= 0 for part in a) for p in points):
        return False
    if area_b:
        whole = sum(s * h.signed_area(t) for s, t in triangles(b))
        return slow_overlap(a, b) >= whole * (1 - 1e-9)
    middles = [((p[0] + q[0]) / 2, (p[1] + q[1]) / 2) for p, q in _sides(b)]
    return all(any(where(m, part) >= 0 for part in a) for m in middles)


@pytest.mark.parametrize("dx, dy, want", [(0, 0, 1.0), (0.5, 0.5, 0.25), (1, 0, 0.0), (2, 2, 0.0), (0.25, 0, 0.75)])
def test_overlap_of_boxes(dx, dy, want):
    assert math.isclose(overlap(BOX, moved(BOX, dx, dy)), want, abs_tol=1e-12)


def test_overlap_with_holes_and_concave_rings():
    outer, hole = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (1, 3), (3, 3), (3, 1), (1, 1)]
    ring = [[outer, hole]]
    assert math.isclose(overlap(ring, [[outer]]), 12)
    assert math.isclose(overlap(ring, [[[(1, 1), (3, 1), (3, 3), (1, 3)]]]), 0, abs_tol=1e-12)
    ell = [[[(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2), (0, 0)]]]
    assert math.isclose(overlap(ell, BOX), 1) and math.isclose(overlap(ell, moved(BOX, 1, 1)), 0, abs_tol=1e-12)


def test_overlap_is_symmetric_and_bounded():
    rnd = random.Random(1)
    for _ in range(60):
        a, b = ([[h.hull([(rnd.random(), rnd.random()) for _ in range(7)])]] for _ in range(2))
        x, y = overlap(a, b), overlap(b, a)
        assert math.isclose(x, y, abs_tol=1e-12)
        assert x <= min(h.signed_area(a[0][0]), h.signed_area(b[0][0])) + 1e-12


def star(rnd, x, y, size, n):
    """A concave ring around a place."""
    return [(x + r * math.cos(t), y + r * math.sin(t)) for t, r in zip(((k + rnd.uniform(0, 0.5)) * 2 * math.pi / n for k in range(n)), (size * rnd.uniform(0.3, 1) for _ in range(n)))]


def shapes_of(rnd, n):
    """Stars, holed and multi-part ones among them, on a grid and off, some with coordinates like those of UTM zones."""
    out = []
    for k in range(n):
        x, y = rnd.uniform(0, 3), rnd.uniform(0, 3)
        ring = star(rnd, x, y, 2.0, rnd.randrange(6, 14))
        parts = [[[*ring, ring[0]]]]
        if k % 3 == 1:
            parts[0].append(star(rnd, x, y, 0.3, 6))
        if k % 4 == 2:
            parts.append([star(rnd, x + 9, y, 2.0, 7)[::-1]])
        if k % 5 == 3:
            parts = [[[(float(round(u)), float(round(v))) for u, v in r] for r in p] for p in [[[(0, 0), (4, 0), (4, 4), (3, 4), (3, 1), (1, 1), (1, 4), (0, 4), (0, 0)]]]]
            parts = moved(parts, float(rnd.randrange(3)), float(rnd.randrange(3)))
        out.append(moved(parts, 500000.0, 3700000.0) if k % 7 == 6 else parts)
    return out


def test_overlaps_of_a_batch_equal_those_of_triangles(monkeypatch):
    rnd = random.Random(5)
    a, b = shapes_of(rnd, 210), shapes_of(rnd, 210)
    a[3] = b[4] = None
    a[5] = []
    want = [slow_overlap(x, y) if x and y else 0.0 for x, y in zip(a, b)]
    for edges in (1 << 20, 50):
        monkeypatch.setattr(kernels, "EDGES", edges)
        got = kernels.overlap_areas(as_arrow(a), as_arrow(b))
        assert np.allclose(got, want, rtol=1e-9, atol=2e-8) and sum(w > 0.1 for w in want) > 60
    part = slice(17, 80)
    assert np.allclose(kernels.overlap_areas(as_arrow(a)[part], as_arrow(b)[part]), want[part], atol=2e-8)  # slices of larger arrays
    assert len(kernels.overlap_areas(as_arrow([]), as_arrow([]))) == 0


def test_overlaps_in_batches_are_a_hundred_times_as_fast():
    import time

    rnd = random.Random(6)
    a, b = ([[[star(rnd, rnd.uniform(0, 2), rnd.uniform(0, 2), 2.0, 16)]] for _ in range(20000)] for _ in range(2))
    x, y = as_arrow(a), as_arrow(b)
    began = time.perf_counter()
    kernels.overlap_areas(x, y)
    each = (time.perf_counter() - began) / 20000
    began = time.perf_counter()
    for p, q in zip(a[:40], b[:40]):
        slow_overlap(p, q)
    assert (time.perf_counter() - began) / 40 > 100 * each


def checked_clip(parts, box):
    """Parts inside the box, after checks: their area is what parts and box share, rings are closed, simple and turn right, holes lie in their exteriors."""
    got = kernels.clip_polygon(parts, *box)
    x0, y0, x1, y1 = box
    frame = [[[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]]
    area = sum(h.signed_area(h.open_ring(r)) for p in got for r in p)
    assert math.isclose(area, slow_overlap(parts, frame), rel_tol=1e-9, abs_tol=1e-9)
    for p in got:
        for k, r in enumerate(p):
            assert r[0] == r[-1] and len(r) > 3 and (h.signed_area(h.open_ring(r)) > 0) == (k == 0) and not crosses_itself(r)
            assert all(x0 <= u <= x1 and y0 <= v <= y1 for u, v in r)
    return got


def test_polygons_are_clipped_to_their_true_parts():
    u = [[[(0, 0), (6, 0), (6, 6), (4, 6), (4, 2), (2, 2), (2, 6), (0, 6), (0, 0)]]]
    assert len(checked_clip(u, (-1, 3, 7, 5))) == 2  # a band cuts a U into two
    assert len(checked_clip(u, (-1, 1, 7, 5))) == 1
    comb = [[[(0, 0), (9, 0), (9, 5), (8, 5), (8, 1), (7, 1), (7, 5), (6, 5), (6, 1), (5, 1), (5, 5), (4, 5), (4, 1), (0, 1), (0, 0)]]]
    assert len(checked_clip(comb, (0, 2, 9, 4))) == 3
    ring = [[[(0, 0), (6, 0), (6, 6), (0, 6), (0, 0)], [(2, 2), (2, 4), (4, 4), (4, 2), (2, 2)]]]
    assert [len(p) for p in checked_clip(ring, (-1, -1, 7, 7))] == [2]  # the hole stays
    assert [len(p) for p in checked_clip(ring, (-1, -1, 3, 7))] == [1]  # a hole across the edge becomes part of the border
    assert [len(p) for p in checked_clip(ring, (-1, 2.5, 7, 3.5))] == [1, 1]  # and cuts a band into two
    assert checked_clip(ring, (2.5, 2.5, 3.5, 3.5)) == [] == checked_clip(ring, (8, 8, 9, 9)) == checked_clip(ring, (6, 0, 7, 6))
    assert len(checked_clip(u + moved(u, 10, 0), (-1, 3, 17, 5))) == 4
    on_edges = checked_clip(u, (0, 2, 6, 6))  # edges and corners that lie on the box
    assert len(on_edges) == 2
    held = [[[(0, 0), (8, 0), (8, 8), (0, 8), (0, 0)], [(1, 1), (1, 2), (2, 2), (2, 1), (1, 1)], [(5, 5), (5, 6), (6, 6), (6, 5), (5, 5)]]]
    assert [len(p) for p in checked_clip(held, (0.5, 0.5, 5.5, 7))] == [2]


def test_clips_of_random_shapes():
    rnd = random.Random(8)
    several = holed = 0
    for parts in shapes_of(rnd, 300):
        x, y = np.mean([p for part in parts for r in part for p in r], axis=0)
        w, height = rnd.uniform(0.1, 3), rnd.uniform(0.05, 0.8)
        cx, cy = x + rnd.uniform(-1, 1), y + rnd.uniform(-1, 1)
        got = checked_clip(parts, (cx - w, cy - height, cx + w, cy + height))
        several += len(got) > 1
        holed += any(len(p) > 1 for p in got)
    assert several > 10 and holed > 3


AREAS = ("Polygon", "MultiPolygon")


def _shape(rnd):
    spot = lambda: (float(rnd.randrange(9)), float(rnd.randrange(9)))
    box = lambda x, y, w, height: [(x, y), (x + w, y), (x + w, y + height), (x, y + height), (x, y)]
    k = rnd.randrange(7)
    if k == 0:
        return "Point", [[[spot()]]]
    if k == 1:
        return "LineString", [[[spot() for _ in range(rnd.randrange(2, 5))]]]
    if k == 2:
        x, y = spot()
        return "Polygon", [[box(x, y, 4.0, 4.0), box(x + 1, y + 1, 2.0, 2.0)]]
    if k == 3:
        return "Polygon", [[box(*spot(), float(rnd.randrange(1, 5)), float(rnd.randrange(1, 5)))]]
    if k == 4:
        ring = [spot() for _ in range(rnd.randrange(3, 6))]  # may cross itself
        return "Polygon", [[[*ring, ring[0]]]]
    if k == 5:
        x, y = spot()
        return "Polygon", [[[(x, y), (x + 4, y), (x + 4, y + 4), (x + 3, y + 4), (x + 3, y + 1), (x + 1, y + 1), (x + 1, y + 4), (x, y + 4), (x, y)]]]
    return "MultiPolygon", [[box(*spot(), 1.0, 1.0)], [box(*spot(), 1.0, 1.0)]]


def _on_the_edge_of_a_hole(a, b):
    """Where brute force, which tries the middle of a side only, may be wrong."""
    return any(len(part) > 1 for part in a[1]) and b[0] not in AREAS


def test_meeting_containing_and_crossing_equal_brute_force(spark):
    rnd = random.Random(5)
    pairs = [(k, _shape(rnd), _shape(rnd)) for k in range(600)]
    df = spark.createDataFrame(pairs + [(600, None, pairs[0][1])], f"k int, a {g.GEOM}, b {g.GEOM}")
    a, b = F.col("a"), F.col("b")
    got = {r.k: r for r in df.select("k", g.intersects(a, b).alias("meet"), g.contains(a, b).alias("holds"), g.self_crossing(a).alias("crosses")).collect()}
    assert tuple(got[600])[1:] == (False, False, False)
    seen = [0, 0, 0]
    for k, a, b in pairs:
        crossed = any(a[0] in AREAS and crosses_itself(r) for part in a[1] for r in part)
        assert got[k].crosses == crossed, (a, b)
        seen[2] += crossed
        if crossed or any(b[0] in AREAS and crosses_itself(r) for part in b[1] for r in part):
            continue
        met = meet(a[1], b[1], a[0] in AREAS, b[0] in AREAS)
        assert got[k].meet == met, (a, b)
        seen[0] += met
        if not _on_the_edge_of_a_hole(a, b) and a[0] != "MultiPolygon":
            held = a[0] in AREAS and contains(a[1], b[1], b[0] in AREAS)
            assert got[k].holds == held, (a, b)
            seen[1] += held
    assert seen[0] > 100 and seen[1] > 5 and seen[2] > 10


def test_a_line_through_a_hole_is_not_held(spark):
    ring = ("Polygon", [[[(3.0, 1.0), (7.0, 1.0), (7.0, 5.0), (3.0, 5.0), (3.0, 1.0)], [(4.0, 2.0), (6.0, 2.0), (6.0, 4.0), (4.0, 4.0), (4.0, 2.0)]]])
    df = spark.createDataFrame([(ring, ("LineString", [[[(6.0, 3.0), (5.0, 5.0)]]])), (ring, ("LineString", [[[(3.0, 1.0), (7.0, 1.0)]]])), (ring, ("Polygon", [[[(3.0, 1.0), (7.0, 1.0), (7.0, 5.0), (3.0, 5.0), (3.0, 1.0)]]]))], f"a {g.GEOM}, b {g.GEOM}")
    assert [r.h for r in df.select(g.contains(F.col("a"), F.col("b")).alias("h")).collect()] == [False, True, False]


def test_self_crossing(spark):
    rings = [[(0, 0), (1, 1), (1, 0), (0, 1), (0, 0)], BOX[0][0], [(0, 0), (2, 0), (1, 0), (1, 1), (0, 0)]]  # a bow-tie, none, back on itself
    df = spark.createDataFrame([(("Polygon", [[[(float(x), float(y)) for x, y in r]]]),) for r in rings], f"a {g.GEOM}")
    assert [r.c for r in df.select(g.self_crossing(F.col("a")).alias("c")).collect()] == [True, False, True] == [crosses_itself(r) for r in rings]


def test_lines_are_clipped_to_their_pieces(spark):
    line = lambda *at: ("LineString", [[[(float(x), float(y)) for x, y in at]]])
    df = spark.createDataFrame([(line((-1, 0.5), (2, 0.5)),), (line((0.2, 0.2), (0.4, 0.4)),), (line((2, 2), (3, 3)),), (line((-1, 0), (0.5, 1.5)),), (line((0.5, 0.5), (0.5, 2), (0.8, 2), (0.8, 0.5)),), (("MultiPoint", [[[(0.5, 0.5)]], [[(5.0, 5.0)]]]),), (None,)], f"a {g.GEOM}")
    got = [r.c for r in df.select(g.clip_box(F.col("a"), 0, 0, 1, 1).alias("c")).collect()]
    flat = [None if c is None else [[(v.x, v.y) for v in part[0]] for part in c.parts] for c in got]
    assert flat == [[[(0, 0.5), (1, 0.5)]], [[(0.2, 0.2), (0.4, 0.4)]], None, None, [[(0.5, 0.5), (0.5, 1)], [(0.8, 1), (0.8, 0.5)]], [[(0.5, 0.5)]], None]
    assert [c.type for c in got if c] == ["MultiLineString", "LineString", "MultiLineString", "MultiPoint"]


def test_hull_against_brute_force():
    rnd = random.Random(2)
    pts = [(rnd.random(), rnd.random()) for _ in range(50)]
    ring = h.hull(pts)
    assert all(where(p, [ring]) >= 0 or min(abs(h._turn(a, b, p)) for a, b in zip(ring, ring[1:] + ring[:1])) < 1e-12 for p in pts)


def test_geodesics_near_antipodes():
    metres = lambda *p: float(h.vincenty(*(np.array([v], float) for v in p))[0])
    # Half a meridian twice, the same with a turn, and lines between nearly antipodal places.
    half = 20003931.4586
    for line, want in (((0, 0, 180, 0), half), ((0, 90, 0, -90), half), ((10, 30, -170, -30), half), ((0, 0, 179.5, 0.5), 19936288.579), ((-75, 90, 20, 90), 0.0)):
        assert abs(metres(*line) - want) < 1e-3, line
    rnd = np.random.default_rng(4)
    x, u = rnd.uniform(-180, 180, (2, 400))
    y, v = rnd.uniform(-89, 89, (2, 400))
    assert np.allclose(h.by_azimuth(x, y, u, v), h.vincenty(x, y, u, v), atol=2e-3, rtol=0)
    # Lines to places around an antipode differ by no more than the places lie apart, whichever way they were found.
    near = np.array([h.vincenty(np.zeros(50), np.full(50, 20.0), 180 + np.linspace(-1.2, 1.2, 50), np.full(50, -20.0 + d))for d in (0.0, 0.003)])
    assert not np.isnan(near).any() and np.abs(np.diff(near, axis=1)).max() < 1.2 * 2 / 49 * 105_000 and np.abs(np.diff(near, axis=0)).max() < 340
    assert math.isnan(metres(0, 0, float("nan"), 1))


def test_vincenty_known_line():
    # one degree of the equator, and one of the meridian at the equator
    d = h.vincenty(*(np.array([v]) for v in (0.0, 0.0, 1.0, 0.0)))[0]
    assert abs(d - 6378137.0 * math.pi / 180) < 1e-3
    m = h.vincenty(*(np.array([v]) for v in (0.0, 0.0, 0.0, 1.0)))[0]
    assert abs(m - 110574.389) < 1e-2
    assert h.vincenty(*(np.array([1.0]),) * 4)[0] == 0


@pytest.fixture(scope="module")
def shapes(spark):
    rows = [(k, random.Random(k).uniform(34.1, 41.9), random.Random(k + 1).uniform(-60, 70)) for k in range(80)]
    return spark.createDataFrame(rows, "fid long, x double, y double")


def test_reprojection_there_and_back(shapes):
    for srid in (32637, 3857):
        p = F.struct(F.col("x"), F.col("y"))
        back = g.reproject_vertex(g.reproject_vertex(p, 4326, srid), srid, 4326)
        worst = shapes.select(F.max(F.greatest(F.abs(back["x"] - F.col("x")), F.abs(back["y"] - F.col("y")))) .alias("d")).first().d
        assert worst < 1e-8
    south = g.reproject_vertex(F.struct(F.lit(39.0).alias("x"), F.lit(-10.0).alias("y")), 4326, 32737)
    r = shapes.limit(1).select(south["x"].alias("x"), south["y"].alias("y")).first()
    assert abs(r.x - 500000) < 1e-6 and 8_890_000 < r.y < 8_900_000
    with pytest.raises(ValueError):
        g.reproject(F.col("geom"), 4326, 2154)


def test_utm_area_is_about_that_of_the_sphere(spark):
    row = spark.range(1).select(g.area_sqm(g.box(F.lit(38.99), F.lit(33.0), F.lit(39.01), F.lit(33.01)), 32637).alias("a")).first()
    want = 6371008.8**2 * math.radians(0.02) * (math.sin(math.radians(33.01)) - math.sin(math.radians(33.0)))
    assert abs(row.a / want - 1) < 0.01


def test_null_and_empty_geometries(spark):
    df = spark.createDataFrame([(1, None), (2, {"type": "Polygon", "parts": []}), (3, {"type": "Point", "parts": [[[{"x": 1.0, "y": 2.0}]]]})], f"fid long, geom {g.GEOM}")
    c = F.col("geom")
    rows = {r.fid: r for r in df.select("fid", g.area(c).alias("area"), g.centroid(c).alias("c"), g.bbox(c).alias("b"), g.to_geojson(c).alias("j"), g.to_wkt(c).alias("w"), g.geometry_flags(c).alias("f")).collect()}
    assert rows[1].area is None and rows[1].c is None and rows[1].b is None and rows[1].j is None and rows[1].f == ["empty"]
    assert rows[2].c is None and rows[2].w == "POLYGON EMPTY" and rows[2].f == ["empty"]
    assert rows[3].area == 0 and rows[3].w == "POINT (1 2)" and tuple(rows[3].c) == (1.0, 2.0) and rows[3].f == []


def test_curves_at_their_break_points(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 2.0, 8.5, 15.0, 32.5, 50.0, 60.0)], "v double")
    v = F.col("v")
    got = [tuple(r) for r in df.select(sc.score_linear_decreasing(v, 2, 15, 50), sc.score_linear_increasing(v, 2, 15, 50), sc.score_bell(v, 2, 15, 50)).collect()]
    assert [r[0] for r in got] == [100, 100, 85, 70, 35, 0, 0]
    assert [r[1] for r in got] == [0, 0, 35, 70, 85, 100, 100]
    assert [r[2] for r in got] == [0, 0, 50, 100, 50, 0, 0]


def test_circles_arcs_and_names(spark):
    e = spark.createDataFrame([("CIRCLE", 0.0, 0.0), ("ARC", 350.0, 10.0), ("ARC", 0.0, 180.0), ("TEXT", 0.0, 0.0)], "k string, a0 double, a1 double").withColumn("p", F.array().cast(f"array<{g.VERTEX}>"))
    one = F.lit(1.0)
    geom = tx.entity_to_geometry(F.col("k"), F.col("p"), F.lit(False), one, one, one, F.col("a0"), F.col("a1"))
    got = [r.g for r in e.select(geom.alias("g")).collect()]
    circle = got[0].parts[0][0]
    assert len({(v.x, v.y) for v in circle}) == 64 and circle[0] == circle[-1]
    assert len(got[1].parts[0][0]) == 17 and len(got[2].parts[0][0]) == 33 and got[3] is None
    assert [tx.safe_ident(n) for n in ("a_1", "1a", 'x"y')] == ["a_1", '"1a"', '"x""y"']


def test_point_geometry_text_and_previews(spark):
    r = spark.range(1).select(g.to_geojson(g.box(F.lit(0), F.lit(0), F.lit(0.5), F.lit(1e-7))).alias("j"), g.wkt_preview(g.box(F.lit(0), F.lit(0), F.lit(1), F.lit(1)), 10).alias("p")).first()
    assert r.j == '{"type": "Polygon", "coordinates": [[[0, 0], [0.5, 0], [0.5, 0], [0, 0], [0, 0]]]}' and r.p == "POLYGON ((…"
