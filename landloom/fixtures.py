"""Stand-in tables made from the driver's tables, as SQL that Spark and DuckDB both read; only whole-number division differs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_USE = lambda k: f"CASE ({k}) % 6 WHEN 0 THEN 'residential' WHEN 1 THEN 'commercial' WHEN 2 THEN 'retail' WHEN 3 THEN 'office' WHEN 4 THEN 'industrial' ELSE 'agricultural' END"
_ZONE = "CASE k % 3 WHEN 0 THEN 'R-1' WHEN 1 THEN 'C-1' ELSE 'historic-district' END"
_PARCEL = f"""
  SELECT k, 'P-' || CAST(k AS STRING) AS parcel_id, 'town-' || CAST((k DIV 2) % 5 AS STRING) AS jurisdiction, 'N-' || CAST(k DIV 100 AS STRING) AS neighborhood,
    {_ZONE} AS zone_code, k % 10 = 0 AS overlay, CASE WHEN k % 41 <> 0 THEN CAST(200 + (k * 37) % 1800 AS DOUBLE) END AS area_sqm,
    {_USE('k')} AS current_use, k % 4 = 0 AS for_sale, p_retailprice / 50 AS price_per_sqm, 'Owner ' || CAST(k % 97 AS STRING) AS owner_name,
    CAST((k * 211) % 90000 AS DOUBLE) AS tax_value, CAST(40 + (k * 17) % 300 AS DOUBLE) AS footprint_area,
    36 + (k % 50) * 0.02e0 AS x0, 33 + (k DIV 50) * 0.01e0 AS y0, 0.004e0 + (p_size % 10) * 0.001e0 AS w, 0.004e0 + (p_size % 5) * 0.001e0 AS h
  FROM (SELECT CAST(p_partkey AS BIGINT) AS k, p_size, p_retailprice FROM part) AS p0"""
_KEEP = "parcel_id, jurisdiction, neighborhood, zone_code, overlay, area_sqm, current_use, for_sale, price_per_sqm, owner_name, tax_value, footprint_area"

#: Name of each table, the tables that it needs first, and its SQL.
TABLES: dict[str, tuple[list[str], str]] = {
    "points": ([], """
      SELECT k AS fid, CASE WHEN k % 3 = 0 THEN 36.05e0 + 0.07e0 * ((k DIV 3) % 12) + ((k * 31) % 101) / 101e0 * 0.004e0 ELSE 36e0 + ((k * 7919) % 10007) / 10007e0 END AS x,
        CASE WHEN k % 3 = 0 THEN 33.5e0 + ((k * 47) % 103) / 103e0 * 0.004e0 ELSE 33e0 + ((k * 104729) % 10009) / 10009e0 END AS y
      FROM (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer) AS c0"""),
    "points_big": ([], """
      SELECT j AS fid, CASE WHEN hot THEN 36.5e0 + ((j * 7919) % 10007) / 10007e0 * 0.01e0 ELSE 36e0 + ((j * 7919) % 10007) / 10007e0 END AS x,
        CASE WHEN hot THEN 33.5e0 + ((j * 104729) % 10009) / 10009e0 * 0.01e0 ELSE 33e0 + ((j * 104729) % 10009) / 10009e0 END AS y
      FROM (SELECT CAST(l_orderkey AS BIGINT) * 10 + l_linenumber AS j, l_partkey % 10 < 3 AS hot FROM lineitem) AS l0"""),
    "facilities": ([], """
      SELECT k AS fid, 36e0 + ((k * 6007) % 1009) / 1009e0 AS x, 33e0 + ((k * 3001) % 1013) / 1013e0 AS y,
        CASE n % 4 WHEN 0 THEN 'osm:highway=motorway|trunk|primary' WHEN 1 THEN 'osm:place=city|town' WHEN 2 THEN 'osm:aeroway=aerodrome' ELSE 'osm:water=lake|river' END AS layer_key
      FROM (SELECT CAST(s_suppkey AS BIGINT) AS k, s_nationkey AS n FROM supplier) AS s0"""),
    "roads": ([], "SELECT CAST(n_nationkey AS BIGINT) AS fid, 36e0 AS x0, 37e0 AS x1, 33.02e0 + 0.04e0 * n_nationkey AS y FROM nation"),
    "protected": ([], "SELECT CAST(r_regionkey AS BIGINT) AS fid, 36.1e0 + 0.2e0 * r_regionkey AS x0, 33.05e0 + 0.03e0 * r_regionkey AS y0, 36.25e0 + 0.2e0 * r_regionkey AS x1, 33.25e0 + 0.03e0 * r_regionkey AS y1 FROM region"),
    "zones": ([], "SELECT k AS fid, 36 + 0.2e0 * (k % 5) AS x0, 33 + 0.2e0 * (k DIV 5) AS y0, 36 + 0.2e0 * (k % 5) + 0.2e0 AS x1, 33 + 0.2e0 * (k DIV 5) + 0.2e0 AS y1 FROM (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation) AS n0"),
    "parcels": ([], _PARCEL),
    "parcels_old": (["parcels"], f"SELECT k AS fid, {_KEEP}, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM parcels"),
    "parcels_new": (["parcels"], f"""
      WITH kind AS (SELECT *, CASE WHEN k % 17 = 0 THEN 'gone' WHEN k % 23 = 0 THEN 'split' WHEN k % 31 = 0 AND k % 50 < 49 THEN 'merged' WHEN k % 31 = 1 AND (k - 1) % 50 < 49 AND (k - 1) % 17 <> 0 AND (k - 1) % 23 <> 0 THEN 'eaten' ELSE 'kept' END AS what,
          CASE WHEN k % 13 = 0 THEN 0.00002e0 WHEN k % 29 = 0 THEN 0.000002e0 ELSE 0e0 END AS dx, CASE WHEN k % 11 = 0 THEN w * 1.05e0 ELSE w END AS w2,
          CASE WHEN k % 7 = 0 THEN {_USE('k + 1')} ELSE current_use END AS use2, CASE WHEN k % 37 = 0 THEN NULL WHEN k % 19 = 0 THEN footprint_area * 0.2e0 ELSE footprint_area END AS foot2 FROM parcels)
      SELECT k AS fid, parcel_id, jurisdiction, neighborhood, zone_code, overlay, area_sqm, use2 AS current_use, for_sale, price_per_sqm, owner_name, tax_value, foot2 AS footprint_area, x0 + dx AS x0, y0, x0 + dx + w2 AS x1, y0 + h AS y1 FROM kind WHERE what = 'kept'
      UNION ALL SELECT 2000000 + k, parcel_id || '-a', jurisdiction, neighborhood, zone_code, overlay, area_sqm, use2, for_sale, price_per_sqm, owner_name, tax_value, foot2, x0, y0, x0 + w / 2, y0 + h FROM kind WHERE what = 'split'
      UNION ALL SELECT 3000000 + k, parcel_id || '-b', jurisdiction, neighborhood, zone_code, overlay, area_sqm, use2, for_sale, price_per_sqm, owner_name, tax_value, foot2, x0 + w / 2, y0, x0 + w, y0 + h FROM kind WHERE what = 'split'
      UNION ALL SELECT 4000000 + a.k, a.parcel_id || '-m', a.jurisdiction, a.neighborhood, a.zone_code, a.overlay, a.area_sqm, a.use2, a.for_sale, a.price_per_sqm, a.owner_name, a.tax_value, a.foot2, a.x0, a.y0, b.x0 + b.w, a.y0 + GREATEST(a.h, b.h) FROM kind a JOIN kind b ON b.k = a.k + 1 WHERE a.what = 'merged'
      UNION ALL SELECT 1000000 + k, 'P-' || CAST(k + 1000000 AS STRING), jurisdiction, neighborhood, zone_code, overlay, area_sqm, current_use, for_sale, price_per_sqm, owner_name, tax_value, footprint_area, x0, y0 - 5, x0 + w, y0 - 5 + h FROM kind WHERE k % 43 = 0"""),
    "damage": (["facilities"], "SELECT fid, CASE fid % 4 WHEN 0 THEN 'light' WHEN 1 THEN 'moderate' WHEN 2 THEN 'severe' ELSE 'destroyed' END AS damage_severity, x - 0.003e0 AS x0, y - 0.003e0 AS y0, x + 0.003e0 AS x1, y + 0.003e0 AS y1 FROM facilities"),
    "master_plan": (["parcels"], f"SELECT parcel_id, jurisdiction, CASE WHEN k % 9 = 0 THEN {_USE('k + 2')} ELSE current_use END AS designated_use, 2020 AS master_plan_year FROM parcels WHERE k % 47 <> 0"),
    "proposals": (["parcels"], f"""
      SELECT CAST(o.o_orderkey AS BIGINT) AS proposal_id, p.parcel_id, p.jurisdiction, p.zone_code, p.overlay, p.area_sqm AS parcel_area,
        CASE WHEN o.o_orderkey % 53 <> 0 THEN {_USE('o.o_orderkey')} END AS use, CASE WHEN o.o_orderkey % 59 <> 0 THEN CAST(5 + o.o_orderkey % 12 AS DOUBLE) END AS height_m,
        CASE WHEN o.o_orderkey % 61 <> 0 THEN CAST(50 + (o.o_orderkey * 13) % 700 AS DOUBLE) END AS footprint_sqm,
        CASE WHEN o.o_orderkey % 67 <> 0 THEN CAST((50 + (o.o_orderkey * 13) % 700) * (1 + o.o_orderkey % 4) AS DOUBLE) END AS gross_floor_area_sqm,
        CASE WHEN o.o_orderkey % 71 <> 0 THEN CAST(o.o_orderkey % 8 AS DOUBLE) END AS setback_front_m, CASE WHEN o.o_orderkey % 73 <> 0 THEN CAST(o.o_orderkey % 4 AS DOUBLE) END AS setback_side_m,
        CASE WHEN o.o_orderkey % 79 <> 0 THEN CAST(o.o_orderkey % 6 AS DOUBLE) END AS setback_rear_m, CASE WHEN o.o_orderkey % 83 <> 0 THEN CAST(o.o_orderkey % 20 AS DOUBLE) END AS parking_spaces,
        CASE WHEN o.o_orderkey % 3 = 0 THEN 'brick' WHEN o.o_orderkey % 3 = 1 THEN 'glass' END AS facade_material, CASE WHEN o.o_orderkey % 5 < 4 THEN o.o_orderkey % 5 = 0 END AS includes_demolition
      FROM (SELECT *, o_orderkey % (SELECT COUNT(*) FROM part) AS at FROM orders) o JOIN parcels p ON p.k = o.at"""),
    "entities": ([], """
      SELECT j AS eid, CASE t WHEN 0 THEN 'POINT' WHEN 1 THEN 'LINE' WHEN 2 THEN 'LWPOLYLINE' WHEN 3 THEN 'POLYLINE' WHEN 4 THEN 'CIRCLE' WHEN 5 THEN 'ARC' ELSE 'TEXT' END AS dxftype,
        CASE s WHEN 0 THEN 'PARCELS' WHEN 1 THEN 'BUILDING_A' WHEN 2 THEN 'ROAD_MAIN' WHEN 3 THEN 'WATER_1' WHEN 4 THEN 'DEFPOINTS' WHEN 5 THEN 'DIMENSION' WHEN 6 THEN 'TITLE' ELSE 'misc' END AS layer,
        j % 2 = 0 AS closed, CAST(j % 1000 AS DOUBLE) AS cx, CAST(j % 777 AS DOUBLE) AS cy, CAST(1 + j % 9 AS DOUBLE) AS r, CAST((j * 17) % 360 AS DOUBLE) AS a0, CAST((j * 29) % 360 AS DOUBLE) AS a1, j % 5 AS npts
      FROM (SELECT CAST(l_orderkey AS BIGINT) * 10 + l_linenumber AS j, l_linenumber % 7 AS t, l_suppkey % 8 AS s FROM lineitem) AS l0"""),
    # Elevations at the cells that the parcels' towns stand in, so that the grid comes from the tables.
    "dem": ([], "SELECT CAST(a.k AS BIGINT) AS cell_x, CAST(b.k AS BIGINT) AS cell_y, CAST((a.k * 37 + b.k * 91) % 800 AS DOUBLE) AS elevation FROM (SELECT p_partkey AS k FROM part WHERE p_partkey < 100) AS a CROSS JOIN (SELECT p_partkey AS k FROM part WHERE p_partkey < 100) AS b"),
    "use_updates": ([], "SELECT CAST(event_id AS BIGINT) AS event_id, 'town-' || CAST(user_id % 5 AS STRING) AS jurisdiction, 'P-' || CAST(user_id AS STRING) AS parcel_id, event_type AS observed_use, ts FROM events"),
    "town_years": ([], """
      SELECT r.r_name || '/' || n.n_name AS town, 2018 + CAST(c.c_custkey % 5 AS INT) AS year, COUNT(*) AS population, AVG(c.c_acctbal) AS median_income,
        CASE WHEN MIN(n.n_nationkey) % 4 <> 0 THEN 'census' END AS source, CASE WHEN MIN(n.n_nationkey) % 3 <> 0 THEN CAST(2018 + c.c_custkey % 5 AS STRING) || '-12-31' END AS as_of
      FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY r.r_name, n.n_name, c.c_custkey % 5"""),
    # Shapes with faults, a kind for each remainder of 8.
    "odd": (["parcels"], "SELECT k AS fid, k % 8 AS fault, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM parcels"),
}

SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _order(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        out += [x for x in [*_order(TABLES[n][0]), n] if x not in out]
    return out


def duck(*names: str) -> str:
    """WITH clause that defines these stand-ins for DuckDB."""
    body = lambda n: TABLES[n][1].replace(" DIV ", " // ").replace("AS STRING", "AS VARCHAR")
    return "WITH " + ",\n".join(f"{n} AS ({body(n)})" for n in _order(list(names)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in as a DataFrame over the tables in ``sf_dir``."""
    order = _order([name])
    text = ",\n".join(f"{n} AS ({TABLES[n][1]})" for n in order)
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in SOURCES if any(f" {t}" in TABLES[n][1] for n in order)}
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(f"WITH {text} SELECT * FROM {name}", **used)
