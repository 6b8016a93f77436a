"""Operators against brute force and hand-made cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from landloom.functions import geometry as g, helpers
from landloom.operators import diff, land, patterns, rules, sites, spatial, stats
from landloom.operators.components import connected_components
from landloom.sources import readers, sinks
from landloom.sources.rulesets import load_permit_rulesets, load_site_rulesets
from landloom.streaming import landuse

FIELDS = ["use", "height_m", "setback_front_m", "setback_side_m", "setback_rear_m", "parking_spaces", "lot_coverage_pct", "open_space_pct", "FAR", "units", "parcel_area_sqm"]


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(70)] + [(k, k + 1) for k in range(200, 260)] + [(500, 500), (None, 1), (3, None), (1, 2), (1, 2)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_permit_example_has_five_violations(spark):
    p = spark.createDataFrame([(1, "elsewhere", "R-1", 850.0, "residential", 13.5, 320.0, 1180.0, 4.0, 2.5, 5.0, 6.0)], "proposal_id long, jurisdiction string, zone_code string, parcel_area double, use string, height_m double, footprint_sqm double, gross_floor_area_sqm double, setback_front_m double, setback_side_m double, setback_rear_m double, parking_spaces double")
    d = rules.derive_proposal(p).withColumn("part", F.lit(0))
    res = rules.evaluate(d, load_permit_rulesets(spark), FIELDS)
    v = rules.permit_verdict(res).first()
    assert (v.violations, v.passes, v.verdict) == (5, 5, "NON-COMPLIANT")
    bad = {r.name: r.proposed for r in res.where("not passed").collect()}
    assert len(bad) == 5 and bad["max_lot_coverage_pct"].startswith("37.647")
    texts = rules.permit_recommendations(res).first().recommendations
    assert any("Increase setback_front_m to 5 or" in t for t in texts)


def test_missing_rulesets_fields_and_denominators(spark):
    rows = [(1, "x", "no-zone", None, None, None), (2, "x", "R-1", None, 0.0, 0.0), (3, "x", "historic-district", "false", None, None)]
    p = spark.createDataFrame(rows, "proposal_id long, jurisdiction string, zone_code string, includes_demolition string, parking_spaces double, units double").withColumn("part", F.lit(0))
    res = rules.evaluate(p, load_permit_rulesets(spark), ["includes_demolition", "parking_spaces", "units"]).collect()
    by = {(r.proposal_id, r.name): r for r in res}
    assert by[1, "ruleset"].type == "error" and not by[1, "ruleset"].passed
    assert by[2, "min_parking_per_unit"].proposed == "DIV/0" and by[2, "max_height_m"].proposed == "MISSING"
    assert by[3, "demolition_request"].passed


def test_rulesets_first_found_counts(spark, tmp_path):
    (tmp_path / "own.yaml").write_text("name: airport\ncriteria: []\n")
    (tmp_path / "p.yml").write_text("name: own\njurisdiction: generic-starter\nzone_code: R-1\nrules:\n- {name: a, type: max, field: height_m, limit: 3}\n")
    built_in = load_site_rulesets(spark)
    assert built_in.where("ruleset = 'airport'").count() == 8 and built_in.count() == 35
    assert load_site_rulesets(spark, override=[str(tmp_path)]).where("ruleset = 'airport'").count() == 0
    assert load_site_rulesets(spark, user=[str(tmp_path)]).where("ruleset = 'airport'").count() == 8
    assert load_permit_rulesets(spark, user=[str(tmp_path)]).where("zone_code = 'R-1'").count() == 1


@pytest.fixture(scope="module")
def cloud(spark):
    rnd = np.random.default_rng(3)
    pts = np.concatenate([rnd.normal(c, 0.5, (60, 2)) for c in ((0, 0), (5, 5), (0, 6))] + [rnd.uniform(-4, 10, (60, 2)), np.zeros((5, 2))])
    return pts, spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(pts)], "fid long, x double, y double")


@pytest.mark.parametrize("eps, least", [(0.5, 4), (0.9, 10), (0.05, 2), (30.0, 3)])
def test_dbscan_equals_brute_force(cloud, eps, least):
    pts, df = cloud
    near = ((pts[:, None] - pts[None]) ** 2).sum(2) <= eps * eps
    core = near.sum(1) >= least
    label = np.full(len(pts), -1)
    nxt = 0
    for i in range(len(pts)):
        if core[i] and label[i] < 0:
            front = [i]
            label[i] = nxt
            while front:
                for j in np.flatnonzero(near[front.pop()] & core & (label < 0)):
                    label[j] = nxt
                    front.append(j)
            nxt += 1
    for i in np.flatnonzero(~core):
        touching = label[near[i] & core]
        label[i] = touching.min() if len(touching) else -1
    got = {r.fid: r.cluster_id for r in patterns.dbscan(df, eps, least).collect()}
    assert got == dict(enumerate(label.tolist()))


def test_nearest_neighbour_and_single_points(spark, cloud):
    pts, df = cloud
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    got = {r.fid: r.dist for r in spatial.nearest_neighbor(df, 0.1).collect()}
    assert len(got) == len(pts) and all(abs(got[k] - d[k].min()) < 1e-12 for k in got)
    one = spark.createDataFrame([(1, 2.0, 3.0)], "fid long, x double, y double")
    assert [tuple(r) for r in spatial.nearest_neighbor(one, 1.0).collect()] == [(1, None)]
    assert spatial.nearest_neighbor(one.where("false"), 1.0).count() == 0


def test_sides_that_grow_are_not_broadcast(spark, monkeypatch):
    """Files of keys alone are small, so by their sizes Spark would lead whole sides of the joins of a search and of DBSCAN through the driver."""
    from landloom import session

    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.checkpoint(eager=True)

    session.shared_dir(spark)
    monkeypatch.setattr(session, "cut", seen)
    monkeypatch.setattr(patterns, "cut", seen)
    df = spark.range(300).selectExpr("id as fid", "(id * 37) % 101 / 10D as x", "(id * 59) % 103 / 10D as y")
    spatial.nearest_neighbor(df, 0.1).count()
    labels = patterns.dbscan(df, 0.9, 5)
    status = land.compliance_join(*[spark.range(9).selectExpr("cast(id as string) as parcel_id", f"'u' as {c}") for c in ("current_use", "designated_use", "current_use")], spark.range(0).selectExpr("'u' as use", "'u' as general_use"), ["parcel_id"])
    plans += [x._jdf.queryExecution().executedPlan().toString() for x in (labels, status)]
    assert sum("SortMergeJoin" in p for p in plans) > 5
    known = ("[p#", "[current_use#")  # a row for each partition, and for each code of the mapping
    assert all(j.lstrip().startswith(known) for p in plans for j in p.split("BroadcastHashJoin")[1:])


def test_pairs_of_a_crowd_are_compared_by_several_tasks(spark, monkeypatch):
    """2,000 points of one split, half of them in one cell, and one without a place: the pairs are those of brute force, no side is broadcast, and one cell's pairs come out of several tasks."""
    df = spark.range(0, 2000, 1, 1).selectExpr("id as fid", "if(id = 7, null, if(id % 2 = 0, (id * 37 % 101) / 1000D, id * 0.21D)) as x", "if(id % 2 = 0, (id * 59 % 103) / 1000D, -id * 0.013D) as y")
    got = spatial.neighbors_within(df, 0.2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    rows = got.withColumn("task", F.spark_partition_id()).toPandas()
    pts = df.where("x is not null").toPandas()
    dist = np.hypot(pts.x.to_numpy()[:, None] - pts.x.to_numpy(), pts.y.to_numpy()[:, None] - pts.y.to_numpy())
    near = np.argwhere(dist <= 0.2)
    assert len(rows) == len(near) > 1_000_000
    assert set(zip(rows.a, rows.b)) == set(zip(pts.fid.to_numpy()[near[:, 0]], pts.fid.to_numpy()[near[:, 1]]))
    assert "Broadcast" not in plan and rows[rows.a % 2 == 0].task.nunique() > 1
    assert spatial.neighbors_within(df.where("false"), 0.2).count() == 0
    monkeypatch.setattr(spatial, "BLOCK", 8)
    assert spatial.neighbors_within(df, 0.2).count() == len(near)


def test_density_equals_counting(spark, cloud):
    pts, df = cloud
    cands = df.where("fid % 7 = 0").withColumnRenamed("fid", "candidate_id")
    for r in (0.3, 2.0):
        got = {x.candidate_id: x.n for x in spatial.density_count(cands, df, r).collect()}
        assert got == {k: int((np.sqrt(((pts - pts[k]) ** 2).sum(1)) <= r).sum()) for k in range(0, len(pts), 7)}


def test_clusters_have_brute_force_hulls(cloud):
    from landloom.functions import helpers as h

    pts, df = cloud
    moved = df.select("fid", (F.col("x") * 100 + 500000).alias("x"), (F.col("y") * 100 + 3700000).alias("y"))
    labels = patterns.dbscan(moved, 60.0, 6)
    own = {}
    for r in moved.join(labels, "fid").collect():
        own.setdefault(r.cluster_id, []).append((r.x, r.y))
    for c in patterns.cluster_summary(moved, labels, 32637).collect():
        assert c.n == len(own[c.cluster_id]) and abs(c.hull_sqkm - abs(h.signed_area(h.hull(own[c.cluster_id]))) / 1e6) < 1e-9 and 38.9 < c.lng < 39.2


def _boxes(spark, rows):
    df = spark.createDataFrame(rows, "fid long, k string, x double, w double, a string")
    return df.withColumn("geom", F.when(F.col("w") > 0, g.box(F.col("x"), F.lit(0.0), F.col("x") + F.col("w"), F.lit(1.0))))


def test_diff_with_itself_is_unchanged(spark):
    old = _boxes(spark, [(k, None if k == 5 else f"k{k % 7}", float(k), 1.0 if k != 6 else -1.0, "x") for k in range(12)])
    m = diff.match_by_key(old, old, ["k"], ["a"])
    c = diff.diff_changes(m, ["a"]).collect()
    assert {r.status for r in c} == {"unchanged"} and diff.added(m).count() == 0 == diff.removed(m).count()
    assert {r.k: r.old_fid for r in c} == {"k0": 7, "k1": 8, "k2": 9, "k3": 10, "k4": 11}  # the last row of a key; 5 and 12 have none, 6 no shape
    assert diff.type_guard(old, old).count() == 0
    with pytest.raises(ValueError):
        diff.check_comparable(old, old, 4326, 32637)


def test_schema_difference(spark):
    old, new = spark.createDataFrame([], "a int, b int"), spark.createDataFrame([], "b int, c int")
    assert diff.schema_difference(old, new) == (["a"], ["c"])


def test_alerts_of_a_stream(spark, tmp_path):
    rows = [("t", f"p{k}", k, "retail") for k in range(5)] + [("t", "q", 9, "office")]
    spark.createDataFrame(rows, "jurisdiction string, parcel_id string, event_id long, observed_use string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("jurisdiction string, parcel_id string, event_id long, observed_use string").parquet(str(tmp_path / "in"))
    landuse.alert_stream(stream, 3, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("status", "n").collect()] == [("retail", 5)]


def test_proximity_matching_equals_greedy(spark):
    rnd = random.Random(5)
    tol = 500 / diff.METRES
    o = [(k, None, rnd.uniform(0, 0.05), 0.001, "x") for k in range(60)]
    n = [(k + 100, None, x + rnd.uniform(-1.5, 1.5) * tol, 0.001, "x") for k, (_, _, x, _, _) in enumerate(o)]
    used, want = set(), []
    for i, _, x, _, _ in o:
        near = sorted((abs(x - u), j) for j, _, u, _, _ in n if j not in used and abs(x - u) <= tol)
        if near:
            used.add(near[0][1])
            want.append((i, near[0][1]))
    got = sorted(tuple(r) for r in diff.match_by_proximity(_boxes(spark, o), _boxes(spark, n), 500.0).collect())
    assert got == want


def test_proximity_matching_of_a_crowd_equals_greedy(spark):
    """Rivals for the same places, ties on a grid, and fids that don't follow the place."""
    rnd = random.Random(9)
    tol = 500 / diff.METRES
    spot = lambda: (rnd.randrange(12) * tol / 3, rnd.randrange(12) * tol / 3)
    o, n = ([(k, *spot()) for k in rnd.sample(range(1000), 90)] for _ in range(2))
    used, want = set(), []
    for i, x, y in sorted(o):
        near = sorted((math.hypot(x - u, y - v), j) for j, u, v in n if j not in used and math.hypot(x - u, y - v) <= tol)
        if near:
            used.add(near[0][1])
            want.append((i, near[0][1]))
    points = lambda rows: spark.createDataFrame(rows, "fid long, x double, y double").select("fid", g.point(F.col("x"), F.col("y")).alias("geom"))
    assert sorted(tuple(r) for r in diff.match_by_proximity(points(o), points(n), 500.0).collect()) == want and len(want) > 40
    assert diff.match_by_proximity(points(o), points(n).limit(0), 500.0).count() == 0


def test_rounding_decides_no_tie_of_proximity(spark):
    """Two new ones in one place but for rounding: the smaller fid is taken, though the other is 10^-14 nearer."""
    at = lambda rows: spark.createDataFrame(rows, "fid long, x double, y double").select("fid", g.point(F.col("x"), F.col("y")).alias("geom"))
    got = diff.match_by_proximity(at([(5, 36.0, 33.0)]), at([(1, 36.0 + 1e-14, 33.0), (2, 36.0, 33.0)]), 5.0, 1e-9)
    assert [tuple(r) for r in got.collect()] == [(5, 1)]


def test_proximity_matching_of_a_long_chain(spark):
    """10^5 features, each within the tolerance of the next: one crowd, settled in a few rounds and without a group."""
    old = spark.range(100_000).select(F.col("id").alias("fid"), g.point(F.col("id") * 0.001, F.lit(0.0)).alias("geom"))
    new = spark.range(100_000).select(F.col("id").alias("fid"), g.point(F.col("id") * 0.001 + 0.0004, F.lit(0.0)).alias("geom"))
    got = diff.match_by_proximity(old, new, 0.0015 * diff.METRES)
    assert got.count() == 100_000 and got.where("old_fid <> new_fid").count() == 0


def test_no_side_of_proximity_matching_is_broadcast(spark, monkeypatch):
    """Neither the new features nor what they keep in a round is led through the driver, however small its files are."""
    from landloom import session

    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df.checkpoint(eager=True)

    session.shared_dir(spark)
    monkeypatch.setattr(diff, "cut", seen)
    # Two old ones want the same new one, so that there is a second round.
    at = lambda first, x: spark.range(first, first + 2).select(F.col("id").alias("fid"), g.point(F.expr(x), F.lit(0.0)).alias("geom"))
    got = diff.match_by_proximity(at(1, "(id - 1) * 0.001D"), at(8, "0.0008D + (id - 8) * 0.0017D"), 0.002 * diff.METRES)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 8), (2, 9)]
    assert sum("SortMergeJoin" in p for p in plans) >= 2 and not [p for p in plans if "Broadcast" in p]


def test_parcels_beyond_all_curves_are_not_searched(spark, monkeypatch):
    """Of 400 parcels up to 20 degrees away only those near the roads go into the search; all scores are those of the whole search."""
    from landloom.plans import jobs

    parcels = spark.range(400).selectExpr("'t' as jurisdiction", "concat('P-', id) as parcel_id", "'C-1' as zone_code", "1000D as area_sqm", "true as for_sale", "1D as price_per_sqm", "array('water') as utilities", "map('tax', 1D) as attributes", "36 + 0.02D * (id % 50) as x", "33 + 0.05D * id as y")
    parcels = parcels.withColumn("geom", g.box(F.col("x"), F.col("y"), F.col("x") + 0.004, F.col("y") + 0.004)).drop("x", "y")
    roads = spark.range(60).select(F.lit("osm:highway=motorway|trunk|primary").alias("layer_key"), F.col("id").alias("fid"), g.point(36 + (F.col("id") * 37 % 61) / 61, 33 + (F.col("id") * 17 % 59) / 59))
    roads = roads.toDF("layer_key", "fid", "geom")
    briefs = spark.createDataFrame([(1, "commercial", 500.0, 40000.0, [], {}, {})], "brief_id int, industry string, required_area_sqm double, budget_usd double, required_infrastructure array<string>, must_have map<string,string>, nice_to_have map<string,string>")
    rules = load_site_rulesets(spark).where("ruleset = 'commercial'")
    found = parcels.select(F.col("parcel_id").alias("candidate_id"), g.centroid(F.col("geom")).alias("c"), "geom").select("candidate_id", "c.x", "c.y", "geom")
    want = {r.candidate_id: (round(r.score, 9), r.verdict) for r in sites.site_score(sites.score_criteria(found, roads, rules)).collect()}
    searched, real = [], sites.sides_of
    monkeypatch.setattr(sites, "sides_of", lambda df: searched.append(df.count()) or real(df))
    got = {r.parcel_id: (round(r.score, 9), r.verdict) for r in jobs.match_investment_sites(parcels, briefs, roads, rules, n=400).collect()}
    assert got == want and len(got) == 400 and len({score for score, _ in got.values()}) > 5
    assert searched and max(searched) < 40


def test_only_curves_with_all_bounds_end_somewhere(spark):
    """A layer's distances matter up to the last bound of all its curves, in metres; where a curve isn't known or lacks a bound, all matter."""
    from pyspark.sql import Row

    row = lambda layer, curve, units, **b: Row(type="distance_to_layer", layer=layer, curve=curve, units=units, bounds={k: b.get(k) for k in ("ideal", "acceptable", "unacceptable", "min", "max")})
    rows = [row("a", "linear_decreasing", "km", ideal=1.0, acceptable=2.0, unacceptable=9.0), row("a", "bell", "m", min=1.0, ideal=5.0, max=70.0), row("b", "bell", "m", min=1.0, ideal=5.0, max=70.0), row("c", "linear_increasing", "km", ideal=1.0), row("d", "other", "km")]
    assert sites._farthest(rows) == {"a": 9000.0, "b": 70.0}


def test_hull_of_a_large_cluster_moves_few_points(spark):
    """A cluster of 10^6 points: tasks send their own hulls' corners only."""
    points = spark.range(1_000_000, numPartitions=8).select(F.lit(7).cast("long").alias("cluster_id"), F.cos(F.rand(1) * 6.283185).alias("c"), F.rand(2).alias("r"), F.rand(3).alias("t"))
    points = points.select("cluster_id", (F.col("r") * F.cos(F.col("t") * 6.283185) * 1000).alias("x"), (F.col("r") * F.sin(F.col("t") * 6.283185) * 500).alias("y"))
    found = patterns.hulls(points)
    plan = found._jdf.queryExecution().executedPlan()
    corners = [(r.x, r.y) for r in found.collect()]
    whole = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    assert len(corners) < 2000 and (min(x for x, _ in corners), max(x for x, _ in corners), min(y for _, y in corners), max(y for _, y in corners)) == tuple(whole)
    moved = [int(x) for x in __import__("re").findall(r"shuffle records written: ([0-9,]+)", str(plan))]
    assert all(n < 20_000 for n in moved)
    area = abs(helpers.signed_area(helpers.hull(corners)))
    assert 0.98 * math.pi * 500_000 < area <= math.pi * 500_000


def test_collections_have_bounded_parts(spark):
    rows = [(k, "a" if k % 3 else "b", float(k % 100), float(k // 100)) for k in range(3000)]
    df = spark.createDataFrame(rows, "fid long, t string, x double, y double").select("fid", "t", g.box(F.col("x"), F.col("y"), F.col("x") + 1, F.col("y") + 1).alias("geom"))
    df = df.unionByName(spark.createDataFrame([(9000, "a", None)], f"fid long, t string, geom {g.GEOM}"))
    parts = spatial.collect_geometry(df, "t", 60)
    got = parts.select("t", "part", "n", g.npoints(F.col("geom")).alias("v"), g.area(F.col("geom")).alias("m")).collect()
    assert max(r.v for r in got) <= 60 and {t: sum(r.n for r in got if r.t == t) for t in "ab"} == {"a": 2000, "b": 1000} and sum(r.m for r in got) == pytest.approx(3000)
    assert len(got) < 3000 * 5 / 60 + 60
    near = parts.select(((F.array_max(F.transform(g.vertices(F.col("geom")), lambda p: p["x"])) - F.array_min(F.transform(g.vertices(F.col("geom")), lambda p: p["x"])))).alias("w")).agg(F.avg("w")).first()[0]
    assert near < 25  # parts are neighbourhoods: a twelfth of the features in a row would be as wide as the layer
    assert spatial.collect_geometry(df.limit(0), "t").count() == 0


def test_medians_of_distances(spark):
    d = spark.createDataFrame([(1, 5.0), (2, 1.0), (3, 3.0), (4, 9.0), (5, None)], "fid long, dist double")
    assert tuple(patterns.nn_summary(d).first())[:2] == (4.5, 4.0) and tuple(patterns.nn_summary(d.limit(0)).first()) == (None, None, None)


def test_alerts_of_a_batch_that_runs_again(spark, tmp_path):
    """A batch that was written but not committed runs again after a restart: its alerts are there once."""
    import shutil

    kinds = "jurisdiction string, parcel_id string, event_id long, observed_use string"
    spark.createDataFrame([("t", f"p{k}", k, "retail") for k in range(5)], kinds).write.parquet(str(tmp_path / "in"))
    run = lambda: landuse.alert_stream(spark.readStream.schema(kinds).parquet(str(tmp_path / "in")), 3, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    run()
    shutil.rmtree(tmp_path / "state" / "commits")  # as if the run had ended between write and commit
    run()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("status", "n", "epoch").collect()] == [("retail", 5, 0)]


def test_statistics_of_small_columns(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0), (3, None, 5.0), (4, 100.0, 5.0)], "fid long, a double, b double")
    got = {r.column: r for r in stats.numeric_stats(df, ["a", "b"]).collect()}
    assert (got["a"]["count"], got["a"].median, got["b"]["std"], got["b"].outliers, got["b"].p5, got["b"].p95) == (3, 3.0, 0.0, 0, 5.0, 5.0)
    bins = stats.histogram(df, ["a", "b"], 4)
    assert [r.n for r in bins.where("column = 'a'").orderBy("bin").collect()] == [2, 0, 0, 1] and bins.where("column = 'b'").count() == 1
    assert stats.numeric_stats(df.where("false"), ["a"]).count() == 0


def test_site_scores_without_layers_are_neutral(spark):
    c = spark.createDataFrame([(1, 36.5, 33.5)], "candidate_id long, x double, y double").withColumn("geom", g.point(F.col("x"), F.col("y")))
    none = spark.createDataFrame([], f"layer_key string, fid long, geom {g.GEOM}")
    got = sites.score_sites(c, none, load_site_rulesets(spark)).collect()
    assert len(got) == 4 and all(r.score == 50 and r.verdict == "CONDITIONAL" and len(r.recommendations) == 3 for r in got)


def test_wkt_and_geojson_readers(spark, tmp_path):
    rows = [("POINT (1 2)", "Point"), ("POINT Z (1 2 3)", "Point"), ("LINESTRING (0 0, 1 1)", "LineString"), ("POLYGON ((0 0, 1 0, 1 1, 0 0))", "Polygon"), ("MULTIPOINT ((0 0), (1 1))", "MultiPoint"), ("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))", "MultiPolygon"), ("GEOMETRYCOLLECTION (POINT (1 2))", None), ("nonsense", None), (None, None)]
    got = spark.createDataFrame([(w,) for w, _ in rows], "w string").select(readers.from_wkt(F.col("w")).alias("g")).collect()
    assert [r.g.type if r.g else None for r in got] == [k for _, k in rows]
    assert got[1].g.parts[0][0][0].y == 2.0
    lines = ['{"type": "Feature", "geometry": null, "properties": {"a": 1}}', '{"type": "Feature", "geometry": {"type": "GeometryCollection", "geometries": []}, "properties": {}}', "{bad", "", '{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2, 3]}, "properties": null}']
    (tmp_path / "f.geojsonl").write_text("\n".join(lines))
    back = readers.read_geojsonseq(spark, str(tmp_path / "f.geojsonl")).collect()
    assert sorted(str(r.reason) for r in back) == sorted(["None", "unsupported geometry", "not a feature", "None"])


def test_ddl(spark):
    df = spark.createDataFrame([], f"parcel_id string, n int, `my col` double, geom {g.GEOM}, GEOM_attr boolean")
    text = "\n".join(sinks.emit_ddl(df.schema, "postgis", "parcels", 4326))
    assert "parcel_id TEXT" in text and "n BIGINT" in text and '"my col" DOUBLE PRECISION' in text and "geom geometry(Geometry, 4326) NOT NULL" in text
    assert "SPATIAL INDEX" in sinks.emit_ddl(df.schema, "mysql", "parcels", 4326)[1] and "2dsphere" in sinks.emit_ddl(df.schema, "mongo", "p", 4326)[0]


def test_snapshots_switch_only_when_written(spark, tmp_path):
    root = str(tmp_path / "s")
    assert landuse.previous_snapshot(spark, root) is None
    landuse.persist_snapshot(spark.range(3), root, "a")
    spark.range(9).write.parquet(f"{root}/versions/b")  # a run that stopped before its pointer
    assert landuse.previous_snapshot(spark, root).count() == 3
    (tmp_path / "s" / "pointer" / "1").mkdir()  # a run that stopped while it wrote its pointer
    assert landuse.previous_snapshot(spark, root).count() == 3
    landuse.persist_snapshot(spark.range(5), root, "c")
    landuse.persist_snapshot(spark.range(6), root, "d")
    assert landuse.previous_snapshot(spark, root).count() == 6


def test_equal_lines_are_features_of_their_own(spark, tmp_path):
    (tmp_path / "f.geojsonl").write_text('{"type": "Feature", "geometry": null, "properties": {"a": 1}}\n' * 5)
    ids = [r.fid for r in readers.read_geojsonseq(spark, str(tmp_path / "f.geojsonl")).collect()]
    assert len(set(ids)) == 5 and sorted(ids) == sorted(r.fid for r in readers.read_geojsonseq(spark, str(tmp_path / "f.geojsonl")).collect())


def test_keys_that_repeat_are_unknown(spark):
    from landloom.plans import jobs

    row = lambda k, fid, foot=50.0: ("t", k, fid, "n", 100.0, foot, ("Polygon", [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]]]))
    schema = f"jurisdiction string, parcel_id string, fid long, neighborhood string, area_sqm double, footprint_area double, geom {g.GEOM}"
    base = spark.createDataFrame([row("a", 1), row("b", 2), row("b", 3), row(None, 4), row("c", 5)], schema)
    current = spark.createDataFrame([row("a", 1), row("b", 2), row("c", 5, 10.0), row("d", 6)], schema)
    damage = spark.createDataFrame([], f"fid long, damage_severity string, geom {g.GEOM}")
    got = sorted((str(r.parcel_id), r.status) for r in jobs.reconstruction(base, current, damage).collect())
    assert got == [("None", "unknown"), ("a", "intact"), ("b", "unknown"), ("b", "unknown"), ("b", "unknown"), ("c", "destroyed"), ("d", "new_construction")]


def test_lineage_stays_inside_its_jurisdiction(spark):
    box = lambda x0, x1: ("Polygon", [[[(x0, 0.0), (x1, 0.0), (x1, 1.0), (x0, 1.0), (x0, 0.0)]]])
    schema = f"jurisdiction string, parcel_id string, geom {g.GEOM}"
    old = spark.createDataFrame([("1", "P", box(0.0, 2.0)), ("2", "P", box(10.0, 12.0))], schema)
    new = spark.createDataFrame([("1", "P-a", box(0.0, 1.0)), ("1", "P-b", box(1.0, 2.0)), ("2", "P", box(10.0, 12.0)), ("2", "Q", box(0.0, 1.0))], schema)
    assert [tuple(r) for r in land.parcel_lineage(old, new, ["jurisdiction", "parcel_id"]).collect()] == [("subdivided", "1", "P", 2)]


def test_crowded_cells_are_linked_right(spark, monkeypatch):
    monkeypatch.setattr(patterns, "BLOCK", 16)
    monkeypatch.setattr(spatial, "CROWD", 8)
    rnd = random.Random(3)
    crowd = lambda x, y, n, w: [(x + rnd.random() * w, y + rnd.random() * w) for _ in range(n)]
    at = crowd(0, 0, 150, 0.7) + crowd(1.6, 0, 150, 0.7) + crowd(0, 2.2, 120, 0.7) + crowd(2.9, 2.9, 40, 0.5) + [(9.0, 9.0)]  # gaps of about eps
    points = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(at)], "fid long, x double, y double")
    near = [[j for j, q in enumerate(at) if math.dist(p, q) <= 1] for p in at]
    core = [len(n) >= 5 for n in near]
    root = {k: k for k in range(len(at)) if core[k]}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k in root:
        for j in near[k]:
            if core[j]:
                a, b = find(k), find(j)
                root[max(a, b)] = min(a, b)
    numbers = {r: n for n, r in enumerate(sorted({find(k) for k in root}))}
    want = {k: numbers[find(k)] if core[k] else min((numbers[find(j)] for j in near[k] if core[j]), default=-1) for k in range(len(at))}
    assert {r.fid: r.cluster_id for r in patterns.dbscan(points, 1.0, 5).collect()} == want
    got = {r.fid: r.dist for r in spatial.nearest_neighbor(points, 1.0).collect()}
    assert all(abs(got[k] - min(math.dist(p, q) for j, q in enumerate(at) if j != k)) < 1e-9 for k, p in enumerate(at))


def test_ranks_with_a_value_far_from_all_others(spark):
    import statistics

    values = [float(k % 977) for k in range(4000)] + [1e300, -1e300, 7.5]
    got = stats.numeric_stats(spark.createDataFrame([(v,) for v in values], "v double"), ["v"]).first()
    ordered = sorted(values)
    n = len(ordered)
    assert (got.median, got.p5, got.p95) == (statistics.median(values), ordered[int(n * 0.05) - 1], ordered[int(n * 0.95)])


def test_distances_and_densities_of_shapes(spark):
    from landloom.operators import sites

    box = lambda x0, y0, x1, y1: ("Polygon", [[[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]])
    ell = ("Polygon", [[[(36.0, 33.0), (36.2, 33.0), (36.2, 33.1), (36.1, 33.1), (36.1, 33.2), (36.0, 33.2), (36.0, 33.0)]]])
    ring = ("Polygon", [[[(37.0, 33.0), (37.3, 33.0), (37.3, 33.3), (37.0, 33.3), (37.0, 33.0)], [(37.1, 33.1), (37.2, 33.1), (37.2, 33.2), (37.1, 33.2), (37.1, 33.1)]]])
    found = spark.createDataFrame([(1, ell), (2, ring), (3, ("Point", [[[(36.15, 33.15)]]])), (4, ("LineString", [[[(35.9, 33.05), (35.95, 33.05)]]])), (5, None)], f"candidate_id long, geom {g.GEOM}")
    layer = spark.createDataFrame([("p", 10, ("Point", [[[(36.15, 33.15)]]])), ("p", 11, ("Point", [[[(37.15, 33.15)]]])), ("b", 12, box(37.12, 33.12, 37.13, 33.13)), ("b", 13, box(36.01, 33.01, 36.02, 33.02))], f"layer_key string, fid long, geom {g.GEOM}")
    got = {(r.candidate_id, r.layer_key): r.metres for r in sites.nearest_distance(found, layer, sphere=True).collect()}
    degree = math.radians(1) * 6371008.8
    close = lambda a, b: abs(a - b) < 1e-3 * b + 1e-6
    assert close(got[1, "p"], 0.05 * degree * math.cos(math.radians(33.15))) and got[1, "b"] == 0 and got[3, "p"] == 0
    assert close(got[2, "p"], 0.05 * degree * math.cos(math.radians(33.15))) and close(got[2, "b"], 0.02 * degree * math.cos(math.radians(33.12)))  # in the hole
    assert close(got[4, "b"], math.hypot(0.06 * math.cos(math.radians(33.035)), 0.03) * degree) and (5, "p") not in got
    n = {r.candidate_id: r.n for r in sites.features_within(found, layer, 0.051).collect()}
    assert n == {1: 2, 2: 2, 3: 1, 4: 0, 5: 0}
