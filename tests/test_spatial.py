"""Joins by place against brute force: boxes of mixed sizes, degrees and metres, the 180th meridian and the poles, nearest features in crowds."""

import math
import random

import pytest
from pyspark.sql import functions as F

from landloom.functions import geometry as g
from landloom.operators import land, spatial as sp


def boxes(rnd, n, x, y, span, low, high):
    """Boxes whose sizes spread evenly over all scales from ``low`` to ``high``."""
    out = []
    for k in range(n):
        w, h = (low * (high / low) ** rnd.random() for _ in range(2))
        u, v = x + rnd.uniform(0, span), y + rnd.uniform(0, span)
        out.append((k, u, v, u + w, v + h))
    return out


def meet(a, b, pad=0.0):
    return a[1] - pad <= b[3] and a[3] + pad >= b[1] and a[2] - pad <= b[4] and a[4] + pad >= b[2]


LAYERS = {"degrees": (30.0, -20.0, 20.0, 1e-4, 10.0), "metres": (250000.0, 3600000.0, 400000.0, 5.0, 200000.0), "tiny": (1e6, 1e6, 1e-3, 1e-7, 1e-4), "around zero": (-1.0, -1.0, 2.0, 1e-4, 1.0)}


@pytest.mark.parametrize("name", LAYERS)
@pytest.mark.parametrize("pad", [0.0, 0.5])
def test_boxes_of_mixed_sizes_meet(spark, name, pad):
    rnd = random.Random(name)
    x, y, span, low, high = LAYERS[name]
    pad *= math.sqrt(low * high)
    a, b = boxes(rnd, 700, x, y, span, low, high), boxes(rnd, 700, x, y, span, low, high)
    a += [(800 + k, x + k * low, y, x + k * low, y) for k in range(5)] + [(810, a[0][3], a[0][4], a[0][3], a[0][4])]  # points, and a touching corner
    b += [(820, a[1][3], a[1][4], a[1][3] + low, a[1][4] + low), (821, *b[0][1:])]
    left = spark.createDataFrame(a, "i int, xmin double, ymin double, xmax double, ymax double")
    right = spark.createDataFrame([*b, (900, None, None, None, None)], "j int, xmin double, ymin double, xmax double, ymax double")
    got = [(r.i, r.j) for r in sp.bbox_pairs(left, right, pad).select("i", "j").collect()]
    want = {(p[0], q[0]) for p in a for q in b if meet(p, q, pad)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300


def test_index_rows_of_a_feature(spark):
    rnd = random.Random(1)
    for x, y, span, low, high in LAYERS.values():
        df = spark.createDataFrame(boxes(rnd, 3000, x, y, span, low, high), "i int, _x0 double, _y0 double, _x1 double, _y1 double")
        df = df.withColumn("_level", sp._level("_x0", "_y0", "_x1", "_y1"))
        levels = df.agg(F.collect_set("_level").alias("_levels"))
        rows = sp.indexed(df, levels, True)
        assert rows.count() <= 8 * 3000
        assert rows.groupBy("i", "role").count().where("role < 2").agg(F.max("count")).first()[0] <= 4


def test_shapes_join_like_their_boxes_and_in_their_jurisdiction(spark):
    rnd = random.Random(2)
    rows = [(k, f"t{k % 3}", *b[1:]) for k, b in enumerate(boxes(rnd, 250, 500000.0, 3.7e6, 900.0, 10.0, 400.0))]
    df = spark.createDataFrame(rows, "k int, t string, x0 double, y0 double, x1 double, y1 double").withColumn("geom", g.box("x0", "y0", "x1", "y1"))
    slanted = df.withColumn("geom", F.expr("named_struct('type', 'Polygon', 'parts', array(array(array(named_struct('x', x0, 'y', y0), named_struct('x', x1, 'y', y0), named_struct('x', x1, 'y', y1), named_struct('x', (x0 + x1) / 2, 'y', y1), named_struct('x', x0, 'y', y1), named_struct('x', x0, 'y', y0)))))").cast(g.GEOM))
    want = {(p[0], q[0]) for p in rows for q in rows if meet(p[1:], q[1:])}
    holds = {(p[0], q[0]) for p in rows for q in rows if p[2] <= q[2] and p[3] <= q[3] and p[4] >= q[4] and p[5] >= q[5]}
    for left in (df, slanted):  # the other one's boxes don't take the short way
        a, b = left.select(F.col("k").alias("a_id"), "geom"), df.select(F.col("k").alias("b_id"), "geom")
        assert {tuple(r) for r in sp.spatial_join(a, b).collect()} == want
        assert {tuple(r) for r in sp.spatial_join(a, b, "contains").collect()} == holds
        assert {tuple(r)[::-1] for r in sp.spatial_join(a, b, "within").collect()} == holds
        got = {(r.a_id, r.b_id): r.overlap for r in sp.overlaps(left.select("t", F.col("k").alias("a_id"), "geom"), df.select("t", F.col("k").alias("b_id"), "geom"), ["t"]).collect()}
        assert got.keys() == {(i, j) for i, j in want if i % 3 == j % 3}
        for (i, j), area in got.items():
            p, q = rows[i], rows[j]
            assert math.isclose(area, (min(p[4], q[4]) - max(p[2], q[2])) * (min(p[5], q[5]) - max(p[3], q[3])), rel_tol=1e-7, abs_tol=1e-5)
    points = spark.createDataFrame([(k, 500000 + rnd.uniform(0, 1300), 3.7e6 + rnd.uniform(0, 1300)) for k in range(300)], "fid int, x double, y double")
    inside = {(p.fid, r[0]) for p in points.collect() for r in rows if r[2] <= p.x <= r[4] and r[3] <= p.y <= r[5]}
    for polygons in (df, slanted):
        assert {tuple(r) for r in sp.point_in_polygon(points, polygons.select(F.col("k").alias("poly_id"), "geom")).collect()} == inside


def test_searches_reach_over_the_180th_meridian_and_the_poles(spark):
    rnd = random.Random(3)
    spots = [(180 - 360 * rnd.random(), math.degrees(math.asin(rnd.uniform(-1, 1)))) for _ in range(1500)]
    spots += [(-179.999, 0.0), (179.999, 0.001), (180.0, 10.0), (-180.0, 10.0), (20.0, 90.0), (-160.0, 89.9), (20.0, -89.95), (200.0 - 360, -89.96)]
    spots += [(c * (180 - 10 ** -rnd.uniform(0, 4)), rnd.uniform(-1, 1)) for c in (-1, 1) for _ in range(200)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(spots)], "fid int, x double, y double")

    def metres(x, y, u, v):
        h = math.sin(math.radians(v - y) / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(v)) * math.sin(math.radians(u - x) / 2) ** 2
        return 2 * g.SPHERE * math.asin(math.sqrt(min(1.0, h)))

    for x, y, within in ((179.9999, 0.0, 5000), (-179.9999, 0.0, 300), (180.0, 10.0, 1e6), (20.0, 89.9, 2e6), (0.0, 90.0, 3e6), (20.0, -89.9, 5e4), (100.0, 60.0, 4e6), (179.0, 0.0, 3e7), (-30.0, 20.0, 1.5e6)):
        want = sorted((metres(x, y, *p), k) for k, p in enumerate(spots) if metres(x, y, *p) <= within)[:50]
        got = [(r.metres, r.fid) for r in sp.dwithin(df, x, y, within, 50).collect()]
        assert len(got) == len(want) and all(math.isclose(p[0], q[0], rel_tol=1e-9, abs_tol=1e-3) for p, q in zip(got, want)) and (within > 1e4 or got)
    near = {r.fid for r in sp.dwithin(df, 179.9999, 0.0, 130, 50).collect()}
    assert 1500 in near  # at -179.999, 122 m away


def test_ranks_of_tied_groups(spark):
    rows = spark.createDataFrame([(f"n{k:03d}",) for k in range(300) for _ in range(1 + (k % 2))] + [("top",)] * 5, "name string")
    got = land.top_groups(rows, "name", 10)
    assert got.count() == 151 and {(r.n, r["rank"]) for r in got.where("n = 5 or n = 2").select("n", "rank").distinct().collect()} == {(5, 1), (2, 2)}
    wide = land.top_groups(rows, "name", 200)
    assert wide.count() == 301 and wide.agg(F.max("rank")).first()[0] == 152


# --- nearest features -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("sphere", [True, False])
def test_a_crowd_in_one_cell_makes_few_pairs(spark, sphere):
    """10^5 features within a hundredth of a degree, candidates among them and far away: some hundred sides each are looked at, not all."""
    from landloom.operators import sites

    crowd = spark.range(100_000).select(F.lit("a").alias("layer_key"), F.col("id").alias("fid"), (36 + F.rand(1) * 0.01).alias("ax"), (33 + F.rand(2) * 0.01).alias("ay"), F.lit(True).alias("lone"))
    seg = crowd.select("*", F.col("ax").alias("bx"), F.col("ay").alias("by"))
    spots = [(k, 36.005 + 0.0005 * k, 33.005) for k in range(8)] + [(10 + k, 36 + 2.0**-k, 34 - 3.0**-k) for k in range(8)] + [(30, 120.0, -40.0), (31, -50.0, 80.0)]
    places = spark.createDataFrame([(k, x, y, x, y, x, y) for k, x, y in spots], "candidate_id int, kx0 double, ky0 double, kx1 double, ky1 double, vx double, vy double")
    nodes, sides, depth = sites.side_tree(seg, 36.0, 33.0, 0.01)
    leaves = sites.near_leaves(places, places.select("candidate_id", F.lit("a").alias("layer_key")), nodes, sphere)
    pairs = leaves.join(sides, ["layer_key", "depth", "cx", "cy"])
    most = pairs.groupBy("candidate_id").count().agg(F.max("count"), F.sum("count")).first()
    assert depth > 1 and most[0] < 5000 and most[1] < 1000 * len(spots)
    length = g.distance_sphere if sphere else g.distance_geodesic
    got = {r.candidate_id: r.m for r in pairs.join(places, "candidate_id").withColumn("m", length(F.col("vx"), F.col("vy"), F.col("ax"), F.col("ay"))).groupBy("candidate_id").agg(F.min("m").alias("m")).collect()}
    every = places.join(seg).withColumn("m", length(F.col("vx"), F.col("vy"), F.col("ax"), F.col("ay")))  # brute force
    assert got == pytest.approx({r.candidate_id: r.m for r in every.groupBy("candidate_id").agg(F.min("m").alias("m")).collect()}, rel=1e-9)


@pytest.mark.parametrize("leaf", [64, 3])
def test_nearest_features_of_all_types_equal_brute_force(spark, monkeypatch, leaf):
    from landloom.operators import sites

    monkeypatch.setattr(sites, "LEAF", leaf)
    rnd = random.Random(11)
    feats = []
    for k in range(240):
        x, y = rnd.choice([(36, 33), (36.2, 33.1), (rnd.uniform(30, 42), rnd.uniform(28, 38)), (rnd.uniform(-60, 120), rnd.uniform(-50, 60))])
        n = 1 + k % 3
        feats.append(("ab"[k % 2], k, "Point" if n == 1 else "LineString", [(x + rnd.gauss(0, 0.3), y + rnd.gauss(0, 0.3)) for _ in range(n)]))
    feats.append(("c", 999, "Point", [(100.0, 10.0)]))
    rows = [(key, k, (kind, [[[(float(u), float(v)) for u, v in pts]]])) for key, k, kind, pts in feats]
    layer = spark.createDataFrame(rows, f"layer_key string, fid long, geom {g.GEOM}")
    spots = [(k, rnd.uniform(-70, 130), rnd.uniform(-60, 70)) for k in range(40)] + [(50 + k, 36 + rnd.gauss(0, 0.5), 33 + rnd.gauss(0, 0.5)) for k in range(60)]
    got = {(r.candidate_id, r.layer_key): r.metres for r in sites.nearest_distance(spark.createDataFrame(spots, "candidate_id int, x double, y double"), layer, sphere=True).collect()}

    def metres(x, y, u, v):
        h = math.sin(math.radians(v - y) / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(v)) * math.sin(math.radians(u - x) / 2) ** 2
        return 2 * g.SPHERE * math.asin(math.sqrt(min(1.0, h)))

    def closest(x, y, pts):
        best = None
        for (ax, ay), (bx, by) in zip(pts, pts[1:]) if len(pts) > 1 else [(pts[0], pts[0])]:
            dx, dy = bx - ax, by - ay
            t = 0.0 if dx == dy == 0 else min(1.0, max(0.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy)))
            u, v = ax + t * dx, ay + t * dy
            best = min(best or (math.inf,), (math.hypot(x - u, y - v), u, v))
        return metres(x, y, *best[1:])

    for k, x, y in spots:
        for key in "abc":
            assert math.isclose(got[k, key], min(closest(x, y, f[3]) for f in feats if f[0] == key), rel_tol=1e-6, abs_tol=1e-3), (k, key)
    assert len(got) == 3 * len(spots)


def test_candidates_look_for_their_nearest_in_groups(spark, monkeypatch):
    """4,000 candidates go down the tree as a few groups, among features and far north of them, over the pole too; results are those of all pairs."""
    from landloom.operators import sites

    met, real = [], sites.near_leaves
    monkeypatch.setattr(sites, "near_leaves", lambda places, *a: met.append(places.count()) or real(places, *a))
    layer = spark.range(500).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("layer_key"), F.col("id").alias("fid"), g.point(36 + F.rand(1), 33 + F.rand(2)).alias("geom")).localCheckpoint()
    spots = spark.range(4000).select(F.col("id").alias("candidate_id"), (36 + F.rand(3)).alias("x"), (33 + F.rand(4) * F.when(F.col("id") % 4 == 0, 240).otherwise(1)).alias("y")).localCheckpoint()
    got = {(r.candidate_id, r.layer_key): r.metres for r in sites.nearest_distance(spots, layer, sphere=True).collect()}
    assert met[0] < 1000
    at = F.col("geom.parts")[0][0][0]
    pairs = spots.join(layer.select("layer_key", at["x"].alias("u"), at["y"].alias("v"))).withColumn("m", g.distance_sphere("x", "y", F.col("u"), F.col("v")))
    want = {(r.candidate_id, r.layer_key): r.m for r in pairs.groupBy("candidate_id", "layer_key").agg(F.min("m").alias("m")).collect()}
    assert got == pytest.approx(want, rel=1e-9)


def test_crowded_candidates_are_dealt(spark):
    """20,000 candidates within a thousandth of a degree come in deals of some 4,096; counts are those of all pairs."""
    c = spark.range(20_000).select(F.col("id").alias("candidate_id"), (36 + F.rand(1) * 0.001).alias("x"), (33 + F.rand(2) * 0.001).alias("y")).localCheckpoint()
    layer = spark.range(300).select((36 + (F.rand(3) - 0.5) * 0.3).alias("x"), (33 + (F.rand(4) - 0.5) * 0.3).alias("y")).localCheckpoint()
    asked, deals = sp._deals(c, 0.08)
    assert asked.count() == 20_000 and asked.groupBy("hx", "hy", "deal").count().agg(F.max("count")).first()[0] < 1.2 * sp.DEAL and deals.count() >= 5
    near = F.sqrt((F.col("x") - F.col("u")) * (F.col("x") - F.col("u")) + (F.col("y") - F.col("v")) * (F.col("y") - F.col("v"))) <= 0.08
    want = {r.candidate_id: r.n for r in c.join(layer.select(F.col("x").alias("u"), F.col("y").alias("v"))).where(near).groupBy("candidate_id").agg(F.count("*").alias("n")).collect()}
    assert {r.candidate_id: r.n for r in sp.density_count(c, layer, 0.08).collect()} == {k: want.get(k, 0) for k in range(20_000)}


def test_boxes_far_from_all_features_meet_few_of_them(spark, monkeypatch):
    """4,000 upright boxes, near 3,000 features and up to 240 degrees north of them: a far group meets a few of the features, and lengths are those of all pairs."""
    from landloom.operators import sites

    seen, real = [], sites.near_leaves
    monkeypatch.setattr(sites, "near_leaves", lambda places, layers, *a: seen.append(r := real(places, layers, *a).localCheckpoint()) or r)
    monkeypatch.setattr(sites, "MATRIX", 256)
    feats = spark.range(3000).select(F.lit("a").alias("layer_key"), F.col("id").alias("fid"), (36 + F.rand(1)).alias("u"), (33 + F.rand(2)).alias("v")).localCheckpoint()
    layer = feats.select("layer_key", "fid", g.point(F.col("u"), F.col("v")).alias("geom"))
    b = spark.range(4000).select(F.col("id").alias("candidate_id"), (36 + F.col("id") % 50 * 0.02).alias("x0"), (33 + F.floor(F.col("id") / 50) * F.when(F.col("id") < 1000, 0.05).otherwise(3)).alias("y0"))
    b = b.withColumns({"x1": F.col("x0") + 0.01, "y1": F.col("y0") + 0.006}).localCheckpoint()
    got = {r.candidate_id: r.metres for r in sites.nearest_distance(b.select("candidate_id", g.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("geom")), layer, sphere=True).collect()}
    px, py = F.greatest("x0", F.least("x1", "u")), F.greatest("y0", F.least("y1", "v"))
    want = {r.candidate_id: r.m for r in b.join(feats).groupBy("candidate_id").agg(F.min(g.distance_sphere(px, py, F.col("u"), F.col("v"))).alias("m")).collect()}
    assert len(got) == 4000 and got == pytest.approx(want, rel=1e-9, abs=1e-6)
    far = seen[0].where("ky0 > 40").groupBy("candidate_id").count()
    assert far.agg(F.percentile_approx("count", 0.5)).first()[0] < 40  # of some hundred leaves


def test_site_scores_keep_no_row_for_each_criterion(spark, monkeypatch):
    """Scores and advice are those of the operators one by one; nothing that has a row for each candidate and criterion is checkpointed."""
    from landloom.operators import sites
    from landloom.sources.rulesets import load_site_rulesets

    sizes, real = [], sites.cut
    monkeypatch.setattr(sites, "cut", lambda df: sizes.append((r := real(df)).count()) or r)
    rules = load_site_rulesets(spark)
    spots = spark.range(300).select(F.col("id").alias("candidate_id"), (36 + F.rand(1)).alias("x"), (33 + F.rand(2)).alias("y")).localCheckpoint().withColumn("geom", g.point(F.col("x"), F.col("y")))
    layer = spark.range(40).select(F.when(F.col("id") % 2 == 0, "osm:highway=motorway|trunk|primary").otherwise("osm:landuse=industrial").alias("layer_key"), F.col("id").alias("fid"), g.point(36 + F.rand(3), 33 + F.rand(4)).alias("geom")).localCheckpoint()
    got = {(r.candidate_id, r.ruleset): (round(r.score, 9), r.verdict, r.recommendations) for r in sites.score_sites(spots, layer, rules, sphere=True).collect()}
    assert max(sizes) < 2000  # 10,500 rows of candidates and criteria
    scored = sites.score_criteria(spots, layer, rules, sphere=True)
    both = sites.site_score(scored).join(sites.site_recommendations(scored), ["candidate_id", "ruleset"])
    assert got == {(r.candidate_id, r.ruleset): (round(r.score, 9), r.verdict, r.recommendations) for r in both.collect()} and len(got) == 1200
