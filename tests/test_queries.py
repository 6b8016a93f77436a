"""Registered queries against their SQL on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from landloom import queries as core

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One of each kind here; all are compared on larger tables by the driver.
SOME = ["p02_utm_epsg", "p11_measures", "p15_geometry_text", "j03_density_count", "j05_spatial_join_intersects", "j06_point_in_polygon", "a06_numeric_stats", "a10_categorical_stats", "a16_permit_verdict", "a22_diff_changes", "a24_reconstruction_status", "j13_compliance_join", "j14_parcel_lineage", "w08_consecutive_drift", "j11_match_sites", "a34_profile_headlines", "s02_read_geojsonseq", "k01_format_postgis", "m01_landuse_drift_stream", "z12_monitor_landuse", "a17_permit_recommendations", "j01_nearest_distance_of_polygons", "j03_density_count_of_shapes", "s06_load_permit_rulesets", "p12_area_sqm"]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.8g}") + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def same(spark, con, name, folder):
    df = core.QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    rel = con.sql(core.ORACLE_SQL[name])
    names = list(rel.columns)
    assert sorted(names) == cols
    want = sorted((tuple(plain(dict(zip(names, r))[c]) for c in cols) for r in rel.fetchall()), key=str)
    assert got == want
    return got


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, duck, name):
    same(spark, duck, name, DATA)


def with_parts(folder, keys):
    """The smallest tables with parts of these keys (a table of k), as larger copies have them."""
    con = duckdb.connect()
    for t in TABLES:
        if t != "part":
            (folder / f"{t}.parquet").symlink_to(f"{DATA}/{t}.parquet")
    con.sql(f"copy (select k as p_partkey, 'part' as p_name, 'b' as p_brand, 't' as p_type, cast(1 + k % 50 as integer) as p_size, 900 + (k % 1000) / 10e0 as p_retailprice from ({keys})) to '{folder}/part.parquet'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def large_keys(tmp_path_factory):
    """Keys over a million, whose parcels share key and fid with new ones; 500 rows apart, whose new parcels lie on old ones; and about the pole and beyond."""
    folder = tmp_path_factory.mktemp("large")
    return str(folder), with_parts(folder, "select unnest(range(1500)) + a as k from (select unnest([0, 25000, 284300, 1000000]) as a)")


@pytest.mark.parametrize("name", ["j07_match_by_key", "j08_match_by_proximity", "a22_diff_changes", "a23_diff_summary", "z05_layer_diff", "z11_publish_cadastre", "a24_reconstruction_status", "a25_status_totals", "z10_track_reconstruction", "p10_geometry_flags", "p12_area_sqm", "p34_quarantine", "z12_monitor_landuse"])
def test_query_equals_its_sql_on_large_keys(spark, large_keys, name):
    assert same(spark, large_keys[1], name, large_keys[0])


def test_alerts_of_statuses_without_a_threshold(spark, tmp_path):
    """120,000 compliant parcels are no alert."""
    con = with_parts(tmp_path, "select unnest(range(150000)) as k")
    assert {r[2] for r in same(spark, con, "m03_violation_alerts", str(tmp_path))} == {"violation"}


def test_entry_and_registry(spark):
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 100
    assert entry.entry(spark).count() > 0


def test_the_library_does_not_need_the_training_data_operators():
    from pathlib import Path

    root = Path(core.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "landloom.llm" not in f.read_text() and "corpus_pipeline" not in f.read_text()


def test_shapes_to_clip_are_dealt_to_all_tasks_and_only_those_that_reach_the_box_are_cut(spark):
    """The table is one split."""
    df = core.QUERIES["p05_clip_of_shapes"](spark, DATA)
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = str(df._jdf.queryExecution().optimizedPlan())
    assert "Filter" in plan[plan.index("ArrowEvalPython") :]


def test_geometries_of_entities_are_made_once(spark):
    plan = str(core.QUERIES["p21_entity_to_geometry"](spark, DATA)._jdf.queryExecution().optimizedPlan())
    assert plan.count("5.625") <= 3  # a filter on the geometries had all of it twice, so 6


def test_files_of_features_lie_in_one_folder(spark, tmp_path, monkeypatch):
    from landloom.plans import q_jobs

    monkeypatch.setattr(q_jobs, "scratch_path", lambda s, name: str(tmp_path / name))
    got = q_jobs.s01_read_geojson(spark, DATA).where("reason is null").count()
    files = [p for p in (tmp_path / "geojson").iterdir() if p.name.endswith(".txt")]
    assert got > 0 and len(files) >= 5 and not [p for p in (tmp_path / "geojson").iterdir() if p.is_dir()]


def test_no_side_of_a_reconstruction_is_broadcast(spark):
    from landloom.plans.q_land import reconstruction

    plan = str(reconstruction(spark, DATA)._jdf.queryExecution().executedPlan())
    joins = [line for line in plan.splitlines() if "Join" in line and any(k in line for k in ("LeftOuter", "LeftSemi", "LeftAnti"))]
    assert joins and not [line for line in joins if "Broadcast" in line]
