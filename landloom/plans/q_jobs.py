"""Queries of sources, sinks, streams and composite jobs. Files are rendered from the tables first, below the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from landloom import fixtures as fx
from landloom.functions import geometry as g
from landloom.operators import sites as si, stats as st
from landloom.plans import jobs, q_land as ql
from landloom.plans.q_functions import _boxes, _odd, utm_sql
from landloom.session import scratch_path
from landloom.sources import readers as rd, sinks as sk
from landloom.sources.rulesets import load_permit_rulesets, load_site_rulesets
from landloom.streaming import landuse as lu

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


def _rendered(s, d) -> DataFrame:
    """Parcels as feature texts; each 50th is broken, each 41st has no geometry."""
    t = _boxes(s, d).select("fid", "parcel_id", F.when(F.col("fid") % 41 != 0, F.col("geom")).alias("geom"))
    return t.select("fid", F.when(F.col("fid") % 50 == 0, "{broken").otherwise(sk.features_text(t)).alias("value"))


_READ = f"""{fx.duck('parcels_old')} SELECT CASE WHEN fid % 50 <> 0 THEN parcel_id END AS parcel_id, CASE WHEN fid % 50 <> 0 AND fid % 41 <> 0 THEN round((x1 - x0) * (y1 - y0), 8) END AS area, CASE WHEN fid % 50 = 0 THEN 'not a feature' END AS reason FROM parcels_old"""


def _back(t: DataFrame) -> DataFrame:
    return t.select(F.get_json_object("properties", "$.parcel_id").alias("parcel_id"), _r(g.area(F.col("geom")), 8).alias("area"), "reason")


@query(_READ)
def s01_read_geojson(s, d):
    """Collections of a hundred features; a broken feature would break its whole file, so each broken one is a file of its own."""
    whole = F.col("fid") % 50 != 0
    t = _rendered(s, d).groupBy(F.when(whole, F.floor(F.col("fid") / 100)).otherwise(-F.col("fid") - 1).alias("grp")).agg(F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.array_join(F.collect_list("value"), ", "), F.lit("]}")).alias("value"))
    path = scratch_path(s, "geojson")
    t.select("value").write.option("maxRecordsPerFile", 1).text(path)  # a file for each row, in one folder
    return _back(rd.read_geojson(s, path))


@query(_READ)
def s02_read_geojsonseq(s, d):
    path = scratch_path(s, "geojsonseq")
    _rendered(s, d).select("value").write.text(path)
    return _back(rd.read_geojsonseq(s, path))


@query(f"{fx.duck('points', 'parcels_old')} SELECT 'point' AS kind, fid, CASE WHEN fid % 10 <> 0 THEN round(x, 6) END AS v FROM points UNION ALL SELECT 'wkt', fid, round((x1 - x0) * (y1 - y0), 8) FROM parcels_old")
def s03_read_csv(s, d):
    path = scratch_path(s, "csv")
    p = fx.table(s, d, "points").select("fid", F.when(F.col("fid") % 10 == 0, "n/a").otherwise(F.col("x").cast("string")).alias("lng"), F.col("y").alias("lat"))
    p.write.option("header", True).csv(f"{path}/points")
    _boxes(s, d).select("fid", g.to_wkt(F.col("geom"), 9).alias("wkt")).write.option("header", True).csv(f"{path}/wkt")
    a = rd.read_csv_points(s, f"{path}/points", "lng", "lat").select(F.lit("point").alias("kind"), F.col("fid").cast("long").alias("fid"), _r(F.col("geom.parts")[0][0][0]["x"]).alias("v"))
    return a.union(rd.read_csv_wkt(s, f"{path}/wkt", "wkt").select(F.lit("wkt").alias("kind"), F.col("fid").cast("long").alias("fid"), _r(g.area(F.col("geom")), 8).alias("v")))


@query(f"{fx.duck('parcels_old')} SELECT parcel_id AS name, CASE fid % 3 WHEN 0 THEN 'Point' WHEN 1 THEN 'LineString' ELSE 'Polygon' END AS kind, CAST(CASE fid % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 5 END AS INTEGER) AS points, round(CASE fid % 3 WHEN 2 THEN (x1 - x0) * (y1 - y0) ELSE 0 END, 8) AS area FROM parcels_old")
def s04_read_kml(s, d):
    at = lambda x, y: f"format_string('%.9f,%.9f,12', {x}, {y})"
    ring = f"concat_ws(' ', {at('x0', 'y0')}, {at('x1', 'y0')}, {at('x1', 'y1')}, {at('x0', 'y1')}, {at('x0', 'y0')})"
    body = f"CASE fid % 3 WHEN 0 THEN concat('<Point><coordinates>', {at('x0', 'y0')}, '</coordinates></Point>') WHEN 1 THEN concat('<LineString><coordinates>', {at('x0', 'y0')}, ' ', {at('x1', 'y1')}, '</coordinates></LineString>') ELSE concat('<Polygon><outerBoundaryIs><LinearRing><coordinates>', {ring}, '</coordinates></LinearRing></outerBoundaryIs></Polygon>') END"
    path = scratch_path(s, "kml")
    marks = fx.table(s, d, "parcels_old").select(F.floor(F.col("fid") / 100).alias("grp"), F.concat(F.lit("<Placemark><name>"), "parcel_id", F.lit("</name>"), F.expr(body), F.lit("</Placemark>")).alias("m"))
    files = marks.groupBy("grp").agg(F.concat(F.lit("<kml><Document>"), F.array_join(F.collect_list("m"), "\n"), F.lit("</Document></kml>")).alias("value"))
    files.write.partitionBy("grp").text(path)
    return rd.read_kml(s, path).select("name", F.col("geom.type").alias("kind"), g.npoints(F.col("geom")).alias("points"), _r(g.area(F.col("geom")), 8).alias("area"))


@query(f"{fx.duck('parcels_old')} SELECT parcel_id AS name, CASE fid % 3 WHEN 0 THEN 'MultiPolygon' WHEN 1 THEN 'MultiPoint' END AS kind, CAST(CASE fid % 3 WHEN 0 THEN 10 WHEN 1 THEN 2 END AS INTEGER) AS points, CASE fid % 3 WHEN 2 THEN 'a collection of several kinds' END AS reason FROM parcels_old")
def s04_read_kml_collections(s, d):
    """Placemarks with collections: of polygons, one of them nested, of points, and of several kinds."""
    at = lambda x, y: f"format_string('%.9f,%.9f', {x}, {y})"
    ring = lambda x: f"concat('<Polygon><outerBoundaryIs><LinearRing><coordinates>', concat_ws(' ', {at(x, 'y0')}, {at('x1', 'y0')}, {at('x1', 'y1')}, {at(x, 'y1')}, {at(x, 'y0')}), '</coordinates></LinearRing></outerBoundaryIs></Polygon>')"
    point = lambda x: f"concat('<Point><coordinates>', {at(x, 'y0')}, '</coordinates></Point>')"
    body = f"CASE fid % 3 WHEN 0 THEN concat({ring('x0')}, '<MultiGeometry>', {ring('(x0 + x1) / 2')}, '</MultiGeometry>') WHEN 1 THEN concat({point('x0')}, {point('x1')}) ELSE concat({point('x0')}, {ring('x0')}) END"
    path = scratch_path(s, "kml")
    marks = fx.table(s, d, "parcels_old").select(F.floor(F.col("fid") / 100).alias("grp"), F.concat(F.lit("<Placemark><name>"), "parcel_id", F.lit("</name><MultiGeometry>"), F.expr(body), F.lit("</MultiGeometry></Placemark>")).alias("m"))
    files = marks.groupBy("grp").agg(F.concat(F.lit("<kml><Document>"), F.array_join(F.collect_list("m"), "\n"), F.lit("</Document></kml>")).alias("value"))
    files.write.partitionBy("grp").text(path)
    return rd.read_kml(s, path).select("name", F.col("geom.type").alias("kind"), g.npoints(F.col("geom")).alias("points"), "reason")


@query(f"{fx.duck('town_years')} SELECT 'demographics' AS section, count(*) AS n FROM town_years UNION ALL SELECT 'land', count(DISTINCT jurisdiction) FROM (SELECT 'town-' || CAST(p_partkey % 5 AS VARCHAR) AS jurisdiction FROM part) AS t")
def s07_read_town_data(s, d):
    path = scratch_path(s, "towns")
    fx.table(s, d, "town_years").coalesce(1).write.option("header", True).csv(f"{path}/raw/demographics")
    ql._town_land(s, d).coalesce(1).write.json(f"{path}/raw/land")
    s.createDataFrame([], "a string").coalesce(1).write.option("header", True).csv(f"{path}/raw/empty")
    fs = s._jvm.org.apache.hadoop.fs
    conf = s._jsc.hadoopConfiguration()
    target = fs.Path(f"{path}/data")
    system = target.getFileSystem(conf)
    system.mkdirs(target)
    for name, end in (("demographics", "csv"), ("land", "json"), ("empty", "csv")):
        for part in system.globStatus(fs.Path(f"{path}/raw/{name}/part-*")) or []:
            if end == "json":  # one array, as such files come
                rows = s.read.text(part.getPath().toString()).agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value"))
                rows.coalesce(1).write.text(f"{path}/raw/array")
                part = system.globStatus(fs.Path(f"{path}/raw/array/part-*"))[0]
            system.rename(part.getPath(), fs.Path(f"{path}/data/{name}.{end}"))
    found = rd.read_town_data(s, f"{path}/data")
    out = None
    for name, df in found.items():
        row = df.agg(F.lit(name).alias("section"), F.count("*").alias("n"))
        out = row if out is None else out.union(row)
    return out


@query(f"{fx.duck('parcels_old')}, f AS (SELECT DISTINCT jurisdiction, zone_code FROM parcels_old) SELECT 'GeoJSONSeq' AS format, count(*) AS n FROM f UNION ALL SELECT 'CSV', count(*) FROM f UNION ALL SELECT 'File Geodatabase', count(*) FROM f")
def s08_file_inventory(s, d):
    """A file of each format for each town and zone that there is."""
    path = scratch_path(s, "inventory")
    rows = _rendered(s, d).join(fx.table(s, d, "parcels_old").select("fid", F.concat_ws("-", "jurisdiction", "zone_code").alias("grp")), "fid")
    groups = [r.grp for r in rows.select("grp").distinct().collect()]  # towns by zones
    rows.select("value", "grp").repartition("grp").write.partitionBy("grp").text(f"{path}-raw")
    fs, conf = s._jvm.org.apache.hadoop.fs, s._jsc.hadoopConfiguration()
    system = fs.Path(path).getFileSystem(conf)
    for grp in groups:
        part = system.globStatus(fs.Path(f"{path}-raw/grp={grp}/part-*"))[0].getPath()
        for name in (f"{grp}.geojsonl", f"{grp}.csv", f"{grp}.gdb/a00000001.gdbtable"):
            to = fs.Path(f"{path}/{name}")
            system.mkdirs(to.getParent())
            s._jvm.org.apache.hadoop.fs.FileUtil.copy(system, part, system, to, False, conf)
    return rd.file_inventory(s, path).where("bytes > 0").groupBy("format").agg(F.count("*").alias("n"))


_NUM = "rtrim(rtrim(printf('%.6f', {}), '0'), '.')"
_JSON = "'{\"type\": \"Point\", \"coordinates\": [' || " + _NUM.format("x0") + " || ', ' || " + _NUM.format("y0") + " || ']}'"


def _loads(s, d) -> DataFrame:
    t = fx.table(s, d, "parcels_old")
    return t.select("fid", F.concat(F.lit("O'"), "owner_name").alias("owner"), "for_sale", F.when(F.col("fid") % 41 != 0, g.point(F.col("x0"), F.col("y0"))).alias("geom"))


_VALUES = "'INSERT INTO parcels (fid, owner, for_sale, geom) VALUES (' || fid || ', ''O''''' || owner_name || ''', ' || CASE WHEN for_sale THEN 'TRUE' ELSE 'FALSE' END || ', ST_GeomFromGeoJSON(''' || " + _JSON


@query(f"{fx.duck('parcels_old')} SELECT {_VALUES} || '''));' AS value FROM parcels_old WHERE fid % 41 <> 0")
def k01_format_postgis(s, d):
    return sk.format_postgis(_loads(s, d), "parcels")


@query(f"{fx.duck('parcels_old')} SELECT {_VALUES} || ''', 2, 4326));' AS value FROM parcels_old WHERE fid % 41 <> 0")
def k02_format_mysql(s, d):
    return sk.format_mysql(_loads(s, d), "parcels", 4326)


@query(f"{fx.duck('parcels_old')} SELECT '{{\"fid\":' || fid || ',\"owner\":\"O''' || owner_name || '\",\"for_sale\":' || CASE WHEN for_sale THEN 'true' ELSE 'false' END || ', \"geometry\": ' || {_JSON} || '}}' AS value FROM parcels_old WHERE fid % 41 <> 0")
def k03_format_mongo(s, d):
    return sk.format_mongo(_loads(s, d))


@query(f"{fx.duck('parcels_old')} SELECT parcel_id, round((x1 - x0) * (y1 - y0), 8) AS area, CAST(NULL AS VARCHAR) AS reason FROM parcels_old")
def k05_write_geojson(s, d):
    path = scratch_path(s, "out")
    sk.write_geojson(_boxes(s, d).select("parcel_id", "zone_code", "geom"), path)
    return _back(rd.read_geojsonseq(s, path))


@query(f"{fx.duck('parcels_old')} SELECT parcel_id, zone_code, false AS has_owner FROM parcels_old")
def k06_publish_parcels(s, d):
    path = scratch_path(s, "public")
    sk.publish_parcels(_boxes(s, d), path)
    docs = s.read.parquet(f"{path}/documents")
    return docs.select("parcel_id", F.get_json_object("json", "$.properties.zone_code").alias("zone_code"), (F.col("json").contains("owner_name") | F.col("json").contains("tax_value")).alias("has_owner"))


@query(f"{fx.duck('parcels_old')} SELECT {_VALUES} || '''));' AS value FROM parcels_old WHERE fid % 41 <> 0 AND fid <= 10 ORDER BY fid LIMIT 10")
def k07_preview(s, d):
    return sk.format_postgis(sk.preview(_loads(s, d).where("geom is not null"), 10), "parcels")


@query(ql._DRIFT + " SELECT jurisdiction, parcel_id, ts, event_id, previous_use, observed_use FROM l WHERE previous_use <> observed_use")
def m01_landuse_drift_stream(s, d):
    """Four micro-batches in order of time give what lag gives over all rows."""
    path = scratch_path(s, "drift")
    t = fx.table(s, d, "use_updates").withColumn("ts", F.col("ts").cast("timestamp"))
    lo, hi = t.agg(F.min("ts"), F.max("ts")).first()
    for k in range(4):
        nth = F.least(F.lit(3), F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(lo))) * 4 / F.greatest(F.lit(1), F.unix_micros(F.lit(hi)) - F.unix_micros(F.lit(lo)))))
        t.where(nth == k).write.mode("append").parquet(f"{path}/in/{k}")
    # A batch is what has come since the run before; each run goes on from the state.
    for k in range(4):
        updates = s.readStream.schema(t.schema).option("recursiveFileLookup", True).parquet(f"{path}/in/[0-{k}]")
        lu.run_drift(updates, f"{path}/out", f"{path}/state").awaitTermination()
    return s.read.parquet(f"{path}/out")


@query(f"{fx.duck('parcels_new')} SELECT parcel_id, current_use FROM parcels_new")
def m02_persist_snapshot(s, d):
    path = scratch_path(s, "snapshots")
    lu.persist_snapshot(fx.table(s, d, "parcels_old"), path, "1")
    lu.persist_snapshot(fx.table(s, d, "parcels_new"), path, "2")
    return lu.previous_snapshot(s, path).select("parcel_id", "current_use")


@query(f"{ql._STATUS}, c AS (SELECT status, count(*) AS n FROM s GROUP BY 1) SELECT 'run-1' AS run, status, n, CAST(CASE status WHEN 'violation' THEN 50 WHEN 'no_plan' THEN 100000 END AS INTEGER) AS threshold FROM c WHERE n > CASE status WHEN 'violation' THEN 50 WHEN 'no_plan' THEN 100000 END")
def m03_violation_alerts(s, d):
    from landloom.operators import land

    return lu.violation_alerts(land.landuse_status(ql._compliance(s, d)), {"violation": 50, "no_plan": 100000}, "run-1")


# --- jobs ---------------------------------------------------------------------------------------------------------------


_DDL = """SELECT 0 AS part, 'CREATE EXTENSION IF NOT EXISTS postgis;' AS value UNION ALL SELECT 2, 'CREATE INDEX IF NOT EXISTS parcels_geom_gist ON parcels USING GIST (geom);'
  UNION ALL SELECT 1, concat_ws(chr(10), 'CREATE TABLE IF NOT EXISTS parcels (', '  id BIGSERIAL PRIMARY KEY,', '  fid BIGINT,', '  owner TEXT,', '  for_sale BOOLEAN,', '  geom geometry(Geometry, 4326) NOT NULL,', '  created_at TIMESTAMPTZ NOT NULL DEFAULT NOW()', ');')"""


@query(f"{fx.duck('parcels_old')} SELECT CAST(part AS INTEGER) AS part, value FROM ({_DDL} UNION ALL SELECT 3, {_VALUES} || '''));' FROM parcels_old WHERE fid % 41 <> 0 AND zone_code = 'R-1') AS t")
def z01_convert_layer(s, d):
    """With K4, the statements that make the table."""
    t = _loads(s, d).join(fx.table(s, d, "parcels_old").select("fid", F.col("zone_code").alias("layer")), "fid")
    return jobs.convert_layer(t, "postgis", "parcels", layer="R-1", ddl=True)


@query(f"{fx.duck('odd')} SELECT 'L' || CAST(fid % 3 AS VARCHAR) AS layer, count(*) AS feature_count, CAST(least(3, count(*)) AS INTEGER) AS n_samples, CASE WHEN fid % 3 = 1 THEN 'medium: Source CRS is EPSG:32637; reprojection to EPSG:4326 will be required' ELSE '' END AS warnings FROM odd GROUP BY fid % 3")
def z02_inspect_layers(s, d):
    t = _odd(s, d).where("fault <> 6").unionByName(_odd(s, d).where("fault = 6"))
    layer = F.col("fid") % 3
    t = t.select("fid", F.concat(F.lit("L"), layer.cast("string")).alias("layer"), "geom", F.when(layer == 1, 32637).otherwise(4326).alias("srid"))
    out = jobs.inspect_layers(t.withColumn("geom", F.coalesce("geom", g.point(F.lit(36.0), F.lit(33.0)))))
    return out.select("layer", "feature_count", F.size("samples").alias("n_samples"), F.array_join("warnings", ";").alias("warnings"))


@query(f"""{fx.duck('parcels_old')}, t AS (SELECT 'tax_value' AS c, tax_value AS v FROM parcels_old UNION ALL SELECT 'area_sqm', area_sqm FROM parcels_old WHERE area_sqm IS NOT NULL) SELECT c AS "column", count(*) AS count, min(v) AS min, max(v) AS max, round(avg(v), 4) AS mean, round(median(v), 4) AS median FROM t GROUP BY c""")
def z03_layer_statistics(s, d):
    t = jobs.layer_statistics(_boxes(s, d), ["tax_value", "area_sqm"], ["zone_code", "current_use"])
    return t["numeric"].where("column in ('tax_value', 'area_sqm')").select("column", "count", "min", "max", _r("mean", 4).alias("mean"), _r("median", 4).alias("median"))


@query(f"""{fx.duck('odd')}, t AS (SELECT * FROM odd WHERE fault NOT IN (5, 6)), m AS (SELECT count(*) AS n, min(y0) AS lo, max(y0) AS hi, avg(y0) AS mean, stddev_pop(y0) AS sd, list(y0 ORDER BY y0) AS l FROM t), b AS (SELECT CAST(unnest(range(20)) AS INTEGER) AS bin)
  SELECT 'type' AS part, 'Polygon' AS what, CAST(count(*) AS DOUBLE) AS value FROM odd WHERE fault <> 6
  UNION ALL SELECT 'quality', 'invalid', count(*) FILTER (WHERE fault IN (1, 2, 3)) FROM odd UNION ALL SELECT 'quality', 'empty', count(*) FILTER (WHERE fault IN (5, 6)) FROM odd
  UNION ALL SELECT 'duplicates', 'copies', greatest(0, count(*) FILTER (WHERE fault = 5) - 1) FROM odd
  UNION ALL SELECT 'y0', unnest(['count', 'min', 'max', 'mean', 'median', 'std', 'p5', 'p95', 'outliers']), round(unnest([n, lo, hi, mean, (l[(n - 1) // 2 + 1] + l[n // 2 + 1]) / 2, sd, l[greatest(0, CAST(floor(n * 0.05e0) AS BIGINT) - 1) + 1], l[least(n - 1, CAST(floor(n * 0.95e0) AS BIGINT)) + 1], (SELECT count(*) FROM t WHERE sd > 0 AND abs(y0 - mean) > 3 * sd)]), 6) FROM m
  UNION ALL SELECT 'histogram', CAST(bin AS VARCHAR), (SELECT count(*) FROM t WHERE CAST(least(19, floor((y0 - lo) / ((hi - lo) / 20))) AS INTEGER) = bin) FROM b, m
  UNION ALL SELECT 'category', CAST(fault AS VARCHAR), count(*) FROM t GROUP BY fault""")
def z03_layer_statistics_outputs(s, d):
    """All six outputs of the job over shapes with faults, as rows of numbers."""
    t = jobs.layer_statistics(_odd(s, d), ["y0"], ["fault"])
    row = lambda df, part, what, value: df.select(F.lit(part).alias("part"), what.cast("string").alias("what"), value.cast("double").alias("value"))
    fields = F.array(*[F.struct(F.lit(c).alias("k"), F.round(F.col(c).cast("double"), 6).alias("v")) for c in ("count", "min", "max", "mean", "median", "std", "p5", "p95", "outliers")])
    numbers = t["numeric"].where("column = 'y0'").select(F.explode(fields).alias("f"))
    quality = t["quality"].select(F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in ("invalid", "empty")])).alias("f"))
    outputs = [row(t["types"], "type", F.col("geometry_type"), F.col("n")), row(quality, "quality", F.col("f.k"), F.col("f.v")), row(t["duplicates"], "duplicates", F.lit("copies"), F.col("copies"))]
    outputs += [row(numbers, "y0", F.col("f.k"), F.col("f.v")), row(t["histograms"].where("column = 'y0'"), "histogram", F.col("bin"), F.col("n")), row(t["categories"], "category", F.col("value"), F.col("n"))]
    return st.union_all(outputs)


@query(ql._HOT.format(m=f"{fx.duck('points')[5:]}, {utm_sql('m', 'points')}", eps=150, least=8) + "SELECT m.fid, coalesce(done.cluster_id, -1) AS cluster_id, round(m.x, 6) AS lng FROM m LEFT JOIN done ON m.fid = done.fid")
def z04_point_patterns(s, d):
    """Labelled points, clustered in metres of their zone; summaries are compared in the plane by a18 to a21."""
    t = jobs.point_patterns(fx.table(s, d, "points"), 0.15, 8)
    return t["features"].select("fid", "cluster_id", _r(F.col("geom.parts")[0][0][0]["x"], 6).alias("lng"))


@query(ql.SQL["a23_diff_summary"])
def z05_layer_diff(s, d):
    return jobs.layer_diff(_boxes(s, d), _boxes(s, d, "parcels_new"), ql.KEY, ql.ATTRS)["summary"]


@query()
def z06_score_sites(s, d):
    """All four rulesets on the ellipsoid; the airport's scores are compared on the sphere by a13."""
    return si.score_sites(ql.site_candidates(s, d), ql.site_layers(s, d), load_site_rulesets(s), fx.table(s, d, "dem"))


@query(f"{ql._AIRPORT}, r AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY score, no) AS nth FROM c) SELECT candidate_id, round(sum(score * w) / sum(w), 4) AS score, CASE WHEN sum(score * w) / sum(w) >= 70 THEN 'RECOMMENDED' WHEN sum(score * w) / sum(w) >= 50 THEN 'CONDITIONAL' ELSE 'NOT RECOMMENDED' END AS verdict, CAST(count(*) FILTER (WHERE nth <= 3 AND score < 60) AS INTEGER) AS advice FROM r GROUP BY candidate_id")
def z06_score_sites_on_the_sphere(s, d):
    """The whole job with lengths on the sphere; the airport's rows are compared."""
    out = si.score_sites(ql.site_candidates(s, d), ql.site_layers(s, d), load_site_rulesets(s), fx.table(s, d, "dem"), sphere=True)
    return out.where("ruleset = 'airport'").select("candidate_id", _r("score", 4).alias("score"), "verdict", F.size("recommendations").alias("advice"))


@query(f"""{ql._DERIVED}{ql._RULES}, t AS (SELECT proposal_id, count(*) FILTER (WHERE NOT passed) AS violations, count(*) FILTER (WHERE passed) AS passes, CASE WHEN bool_and(passed) THEN 'COMPLIANT' ELSE 'NON-COMPLIANT' END AS verdict, coalesce(string_agg(text, '|' ORDER BY part, no) FILTER (WHERE NOT passed), '') AS advice FROM r GROUP BY proposal_id)
  SELECT t.*, 'permit-check-2024-01-01T00:00:00Z-' || p.parcel_id AS run_id FROM t JOIN proposals p ON p.proposal_id = t.proposal_id""")
def z07_check_permits(s, d):
    p = fx.table(s, d, "proposals").withColumn("overlays", F.when(F.col("overlay"), F.array(F.lit("historic-district"))))
    out = jobs.check_permits(p, load_permit_rulesets(s), ql.FIELDS, at="2024-01-01T00:00:00Z")
    return out.select("proposal_id", "violations", "passes", "verdict", F.array_join("recommendations", "|").alias("advice"), "run_id")


@query(f"""{fx.duck('town_years', 'parcels_old')}, {ql._LAST[ql._LAST.index('l AS'):]}{ql._LAND}, t AS (SELECT n_name AS town FROM nation), c AS (SELECT n_name AS town, string_agg(s_name || ' (sector ' || s_suppkey % 3 || ', ' || CASE WHEN s_suppkey % 4 = 0 THEN '?' ELSE CAST(s_suppkey * 10 AS VARCHAR) END || ' employees)', ', ' ORDER BY s_suppkey) AS employers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
  SELECT 'headline' AS part, town, 'Population' AS what, CAST(population AS VARCHAR) AS value FROM l UNION ALL SELECT 'land', town, 'largest', CAST(largest AS VARCHAR) FROM z UNION ALL SELECT 'narrative', t.town, 'employers', employers FROM t LEFT JOIN c ON t.town = c.town
  UNION ALL SELECT 'completeness', town, 'demographics', CAST(1 + (median_income IS NOT NULL)::INT AS VARCHAR) FROM l UNION ALL SELECT 'completeness', town, 'land', CAST(5 + (price IS NOT NULL)::INT AS VARCHAR) FROM z""")
def z08_town_profiles(s, d):
    """Headlines, the land section, narrative and completeness; values of land's headlines are compared by a29."""
    from landloom.operators import profiles as pr

    economy, why_now = ql.narrative_sources(s, d)
    t = jobs.town_profiles({"demographics": pr.latest_snapshot(fx.table(s, d, "town_years")), "economy": economy, "why_now": why_now}, parcels=ql.town_parcels(s, d))
    line = lambda df, part, what, value: df.select(F.lit(part).alias("part"), "town", (F.lit(what) if what else F.col("headline")).alias("what"), F.col(value).cast("string").alias("value"))
    full = t["completeness"]
    parts = [line(t["headlines"].where("headline = 'Population'"), "headline", None, "value"), line(t["land"], "land", "largest", "largest_available"), line(t["narrative"], "narrative", "employers", "employers")]
    return st.union_all([*parts, line(full.where("demographics > 0"), "completeness", "demographics", "demographics"), line(full.where("land > 0"), "completeness", "land", "land")])


@query()
def z09_match_investment_sites(s, d):
    """Matches are compared by j11 and the shortlist by w02; here parcels are scored by the commercial ruleset."""
    o = ql.offered(s, d).withColumn("geom", g.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    rules = load_site_rulesets(s).where("ruleset = 'commercial'")
    return jobs.match_investment_sites(o, ql.briefs(s), ql.site_layers(s, d), rules, fx.table(s, d, "dem")).select("brief_id", "jurisdiction", "parcel_id", "rank", "score", "verdict", "shortlisted")


_TOP = "SELECT neighborhood AS what, n FROM (SELECT *, rank() OVER (ORDER BY n DESC) AS k FROM (SELECT neighborhood, count(*) AS n FROM {} GROUP BY 1) AS t) AS u WHERE k <= 10"


@query(f"""{ql._RECON}, v AS (SELECT area, snapshot, count(*) FILTER (WHERE (fid * 7 + snapshot * 3) % 5 < snapshot) AS n FROM (SELECT neighborhood AS area, fid, s.snapshot FROM parcels_old CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS snapshot) AS s) AS t GROUP BY 1, 2)
  SELECT 'status' AS part, status AS what, count(*) AS n FROM r GROUP BY status UNION ALL SELECT 'total', jurisdiction, count(*) FROM r GROUP BY jurisdiction UNION ALL SELECT 'worst', what, n FROM ({_TOP.format("(SELECT * FROM r WHERE status IN ('damaged', 'destroyed'))")}) AS t UNION ALL SELECT 'velocity', area, CAST(sum(n) AS BIGINT) FROM v GROUP BY area
  UNION ALL SELECT 'hot zones', 'parcels', count(*) FROM parcels_old o JOIN r ON o.jurisdiction = r.jurisdiction AND o.parcel_id = r.parcel_id WHERE r.status IN ('damaged', 'destroyed')""")
def z10_track_reconstruction(s, d):
    """A line or more of each output; the clusters themselves are compared by a27."""
    h = fx.table(s, d, "parcels_old").select(F.col("neighborhood").alias("area"), "fid", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])).alias("snapshot_id"))
    h = h.withColumn("status", F.when((F.col("fid") * 7 + F.col("snapshot_id") * 3) % 5 < F.col("snapshot_id"), "rebuilt").otherwise("intact"))
    t = jobs.track_reconstruction(_boxes(s, d), _boxes(s, d, "parcels_new"), _boxes(s, d, "damage"), h)
    line = lambda df, part, what, n: df.select(F.lit(part).alias("part"), what.alias("what"), n.cast("long").alias("n"))
    parts = [line(t["status"].groupBy("status").count(), "status", F.col("status"), F.col("count")), line(t["totals"].where("level = 1"), "total", F.col("jurisdiction"), F.col("n")), line(t["worst"], "worst", F.col("neighborhood"), F.col("n"))]
    parts += [line(t["velocity"].groupBy("area").agg(F.sum("rebuilt").alias("n")), "velocity", F.col("area"), F.col("n")), line(t["hot_zones"].agg(F.count("*").alias("n")), "hot zones", F.lit("parcels"), F.col("n"))]
    return st.union_all(parts)


_PUBLIC = [a for a in ("neighborhood", "zone_code", "overlay", "area_sqm", "current_use", "for_sale", "price_per_sqm", "footprint_area")]
_PDIFF = " || ".join(f"CASE WHEN o.{a} IS DISTINCT FROM n.{a} THEN '{a},' ELSE '' END" for a in _PUBLIC)


@query(f"""{ql._KEYED}, c AS (SELECT o.parcel_id, (n.area - o.area) / o.area * 100 AS d, sqrt(pow(n.cx - o.cx, 2) + pow(n.cy - o.cy, 2)) * 111000 AS m, {_PDIFF} AS names FROM ok o JOIN nk n ON o.jurisdiction = n.jurisdiction AND o.parcel_id = n.parcel_id) SELECT parcel_id, CASE WHEN abs(d) < 0.1e0 AND m < 0.5e0 AND names = '' THEN 'unchanged' ELSE 'changed' END AS status FROM c""")
def z11_publish_cadastre(s, d):
    keep = [*ql.KEY, "fid", "geom", "owner_name", "tax_value", *_PUBLIC]
    return jobs.publish_cadastre(_boxes(s, d, "parcels_new").select(*keep), _boxes(s, d).select(*keep), scratch_path(s, "cadastre")).select("parcel_id", "status")


@query(f"""{ql._STATUS} SELECT 'counts' AS part, status AS what, count(*) AS n FROM s GROUP BY status UNION ALL SELECT 'worst', what, n FROM ({_TOP.format("(SELECT * FROM s WHERE status = 'violation')")}) AS t UNION ALL SELECT 'alerts', 'violation', count(*) FROM s WHERE status = 'violation' HAVING count(*) > 50
  UNION ALL SELECT 'drift', CASE WHEN p.parcel_id IS NULL THEN 'new' WHEN q.parcel_id IS NULL THEN 'removed' ELSE 'changed' END, count(*) FROM parcels_old p FULL JOIN parcels_new q ON p.jurisdiction = q.jurisdiction AND p.parcel_id = q.parcel_id WHERE p.parcel_id IS NULL OR q.parcel_id IS NULL OR p.current_use IS DISTINCT FROM q.current_use GROUP BY 2
  UNION ALL SELECT 'hot zones', 'parcels', count(*) FROM s WHERE status = 'violation' UNION ALL SELECT 'saved', 'parcels', count(*) FROM parcels_new""")
def z12_monitor_landuse(s, d):
    """A line or more of each output. The previous run is read from the folder of snapshots, and this one is saved there; lineage is compared by j14, clusters by a27."""
    path = scratch_path(s, "monitor")
    lu.persist_snapshot(_boxes(s, d), path, "run-0")
    t = jobs.monitor_landuse(_boxes(s, d, "parcels_new"), fx.table(s, d, "master_plan"), None, ql._general(s), {"violation": 50}, "run-1", snapshots=path)
    line = lambda df, part, what, n=F.col("n"): df.select(F.lit(part).alias("part"), what.alias("what"), n.cast("long").alias("n"))
    count = lambda df: df.agg(F.count("*").alias("n"))
    parts = [line(t["counts"], "counts", F.col("status")), line(t["worst"], "worst", F.col("neighborhood")), line(t["alerts"], "alerts", F.col("status")), line(t["drift"].where("kind in ('new', 'removed', 'changed')"), "drift", F.col("kind"))]
    return st.union_all([*parts, line(count(t["hot_zones"]), "hot zones", F.lit("parcels")), line(count(lu.previous_snapshot(s, path)), "saved", F.lit("parcels"))])


@query(f"""{fx.duck('parcels_old', 'parcels')} SELECT 'old' AS side, 'x1' AS name, count(x1) AS n FROM parcels_old UNION ALL SELECT 'old', 'y1', count(y1) FROM parcels_old UNION ALL SELECT 'old', 'fid', count(fid) FROM parcels_old
  UNION ALL SELECT 'new', 'k', count(k) FROM parcels UNION ALL SELECT 'new', 'w', count(w) FROM parcels UNION ALL SELECT 'new', 'h', count(h) FROM parcels""")
def u03_schema_difference(s, d):
    """Columns of one side only, and how many values a comparison leaves out with them."""
    from landloom.operators import diff

    old, new = fx.table(s, d, "parcels_old"), fx.table(s, d, "parcels")
    only = diff.schema_difference(old, new)
    counts = [df.select(F.lit(side).alias("side"), F.lit(c).alias("name"), F.count(c).alias("n")) for side, df, names in (("old", old, only[0]), ("new", new, only[1])) for c in names]
    return st.union_all(counts)


# Rulesets in files of the tables' own zones: a file for each town and zone.


def _rule_files(s, d, text) -> str:
    """A local folder of rulesets, made by ``text(row)`` for each town and zone; the library reads such files on the driver."""
    import tempfile
    from pathlib import Path

    folder = tempfile.mkdtemp(prefix="landloom-rules-")
    zones = fx.table(s, d, "parcels_old").groupBy("jurisdiction", "zone_code").agg(F.count("*").alias("n"), F.max("footprint_area").alias("most"))
    for r in zones.collect():  # towns by zones
        Path(folder, f"{r.jurisdiction}-{r.zone_code}.yaml").write_text(text(r))
    return folder


_ZONES = f"{fx.duck('parcels_old')}, z AS (SELECT jurisdiction, zone_code, count(*) AS n, max(footprint_area) AS most FROM parcels_old GROUP BY 1, 2)"


@query(f"{_ZONES} SELECT jurisdiction || '-' || zone_code AS ruleset, CAST(0 AS INTEGER) AS criterion_no, 'far' AS name, CAST(n AS DOUBLE) AS weight, 'distance_to_layer' AS type, CAST(20 + n AS DOUBLE) AS unacceptable FROM z UNION ALL SELECT jurisdiction || '-' || zone_code, 1, 'dense', 1.0e0, 'density_count', most FROM z")
def s05_load_site_rulesets(s, d):
    text = lambda r: f"name: {r.jurisdiction}-{r.zone_code}\ncriteria:\n  - {{name: far, weight: {r.n}, type: distance_to_layer, layer: roads, bounds: {{ideal: 1, acceptable: 10, unacceptable: {20 + r.n}}}}}\n  - {{name: dense, type: density_count, layer: roads, radius_km: 2, bounds: {{unacceptable: {r.most}}}}}\n"
    rules = load_site_rulesets(s, override=[_rule_files(s, d, text)]).where("ruleset like 'town-%'")
    return rules.select("ruleset", "criterion_no", "name", "weight", "type", F.col("bounds.unacceptable").alias("unacceptable"))


@query(f"{_ZONES} SELECT p.parcel_id, p.jurisdiction AS \"from\", r.name, r.lim AS \"limit\" FROM parcels_old p JOIN z ON p.jurisdiction = z.jurisdiction AND p.zone_code = z.zone_code, LATERAL (SELECT 'max_footprint' AS name, z.most AS lim UNION ALL SELECT 'min_share', CAST(z.n AS DOUBLE)) AS r")
def s06_load_permit_rulesets(s, d):
    """The rules that hold for each parcel, when each town has rulesets of its own besides the bundled ones."""
    from landloom.operators import rules as ru

    text = lambda r: f"name: own\njurisdiction: {r.jurisdiction}\nzone_code: {r.zone_code}\nrules:\n  - {{name: max_footprint, type: max, field: footprint_sqm, limit: {r.most}}}\n  - {{name: min_share, type: min, field: share, limit: {r.n}}}\n"
    rules = load_permit_rulesets(s, user=[_rule_files(s, d, text)])
    known = ru.resolve_ruleset(fx.table(s, d, "parcels_old").select("parcel_id", "jurisdiction", "zone_code"), rules)
    own = F.broadcast(rules.select(F.col("jurisdiction").alias("from"), F.col("zone_code"), "name", "limit"))
    return known.join(own, ["from", "zone_code"]).select("parcel_id", "from", "name", "limit")


def flagship(spark, sf_dir):
    return z06_score_sites(spark, sf_dir)
