"""Vector sources as rows of features: (fid, geom, properties as JSON text), with what can't be read kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from landloom.functions.geometry import GEOM, VERTEX, make

_PAIR = "array<double>"
#: How deep the coordinates of each type are nested, and how they become parts of rings.
_DEPTH = {
    "Point": (_PAIR, lambda c: F.array(F.array(F.array(_vertex(c))))),
    "MultiPoint": (f"array<{_PAIR}>", lambda c: F.transform(c, lambda p: F.array(F.array(_vertex(p))))),
    "LineString": (f"array<{_PAIR}>", lambda c: F.array(F.array(_ring(c)))),
    "MultiLineString": (f"array<array<{_PAIR}>>", lambda c: F.transform(c, lambda r: F.array(_ring(r)))),
    "Polygon": (f"array<array<{_PAIR}>>", lambda c: F.array(F.transform(c, _ring))),
    "MultiPolygon": (f"array<array<array<{_PAIR}>>>", lambda c: F.transform(c, lambda p: F.transform(p, _ring))),
}


def _vertex(p: Column) -> Column:
    return F.struct(p[0].alias("x"), p[1].alias("y")).cast(VERTEX)


def _ring(c: Column) -> Column:
    return F.transform(c, _vertex)


def geometry_from(kind: Column, coordinates: Column) -> Column:
    """Geometry of a type and its coordinates as JSON text; null for other types (collections too) and texts that don't parse. A third coordinate is dropped."""
    out = F.lit(None).cast(GEOM)
    for name, (schema, parts) in _DEPTH.items():
        c = F.from_json(coordinates, schema)
        out = F.when((kind == name) & c.isNotNull(), make(name, parts(c))).otherwise(out)
    return out


_FEATURE = "struct<type:string,id:string,geometry:struct<type:string,coordinates:string>,properties:string>"


def _features(rows: DataFrame) -> DataFrame:
    """(fid, geom, properties, reason) of rows (fid, f): a feature struct, or null where the text didn't parse."""
    f = F.col("f")
    geom = geometry_from(f["geometry"]["type"], f["geometry"]["coordinates"])
    reason = (
        F.when(f.isNull() | (F.coalesce(f["type"], F.lit("")) != "Feature"), "not a feature")
        .when(f["geometry"]["type"].isNotNull() & ~F.coalesce(f["geometry"]["type"].isin(*_DEPTH), F.lit(False)), "unsupported geometry")
        .when(f["geometry"]["type"].isNotNull() & geom.isNull(), "bad coordinates")
    )
    return rows.select("fid", geom.alias("geom"), f["properties"].alias("properties"), reason.alias("reason"))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of FeatureCollection and Feature files; a null geometry stays null. Bad features have a reason.

    A file is read as one row, so collections should be of a size that a task can hold; larger ones belong into sequences.
    """
    text = spark.read.text(path, wholetext=True)
    whole = F.from_json("value", "struct<type:string,features:array<string>,geometry:string>")
    one = F.when(whole["type"] == "Feature", F.array("value")).otherwise(F.coalesce(whole["features"], F.array(F.lit(None).cast("string"))))
    each = text.select(F.input_file_name().alias("file"), F.posexplode(one).alias("nth", "v"))
    return _features(each.select(F.concat_ws("#", "file", "nth").alias("fid"), F.from_json("v", _FEATURE).alias("f")))


def read_geojsonseq(spark: SparkSession, path: str) -> DataFrame:
    """Features of files with one on each line; lines may begin with a record separator. Files are split among tasks; empty lines are skipped.

    A feature's fid is its file, the place of the block it was read with and its number in that block, so equal lines have ids of their own, the same in every run over the same files.
    """
    rows = spark.read.text(path).select(F.regexp_replace("value", "^\\x1e", "").alias("v"), "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("m"))
    rows = rows.where("trim(v) <> ''").withColumn("nth", F.col("m").bitwiseAND(F.lit((1 << 33) - 1)))
    return _features(rows.select(F.concat_ws("#", "file_path", "file_block_start", "nth").alias("fid"), F.from_json("v", _FEATURE).alias("f")))


def read_csv_points(spark: SparkSession, path: str, lng: str, lat: str) -> DataFrame:
    """The rows of CSV files with a header, with geom; rows whose coordinates aren't numbers have a null geom."""
    rows = spark.read.csv(path, header=True)
    x, y = F.col(lng).try_cast("double"), F.col(lat).try_cast("double")
    return rows.withColumn("geom", F.when(x.isNotNull() & y.isNotNull(), make("Point", F.array(F.array(F.array(F.struct(x.alias("x"), y.alias("y"))))))))


def from_wkt(text: Column) -> Column:
    """Geometry of well-known text, made into nested JSON; null where it doesn't parse. A third coordinate is dropped."""
    kind = F.upper(F.regexp_extract(text, r"^\s*([A-Za-z]+)", 1))
    names = F.create_map(*[F.lit(v) for n in _DEPTH for v in (n.upper(), n)])
    body = F.regexp_extract(text, r"^\s*[A-Za-z]+\s*(?:Z|M|ZM)?\s*(\(.*\))\s*$", 1)
    pairs = F.regexp_replace(body, r"(-?[0-9.eE+-]+)\s+(-?[0-9.eE+-]+)(?:\s+-?[0-9.eE+-]+)*", "[$1,$2]")
    json = F.translate(pairs, "()", "[]")
    name = F.try_element_at(names, kind)
    flat = F.when(name == "Point", F.regexp_replace(json, r"^\[|\]$", "")).when((name == "MultiPoint") & body.startswith("(("), F.regexp_replace(json, r"\[\[([^\[\]]*)\]\]", "[$1]")).otherwise(json)
    return geometry_from(name, flat)


def read_csv_wkt(spark: SparkSession, path: str, col: str) -> DataFrame:
    return spark.read.csv(path, header=True, escape='"').withColumn("geom", from_wkt(F.col(col)))


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """(name, geom, srid, reason) of placemarks: points, lines, polygons, and collections of one of these kinds, also nested ones; altitudes and styles are dropped.

    What can't be read has a null geom and a reason: no geometry, or a collection of several kinds. Parts without places are left out.
    """
    ring = "struct<LinearRing:struct<coordinates:string>>"
    point, area = "struct<coordinates:string>", f"struct<outerBoundaryIs:{ring},innerBoundaryIs:array<{ring}>>"
    several = f"Point array<{point}>, LineString array<{point}>, Polygon array<{area}>"
    inner = f"struct<{several.replace(' array', ':array')}>"
    schema = f"name string, {several}, MultiGeometry array<struct<{several.replace(' array', ':array')},MultiGeometry:array<{inner}>>>"
    rows = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)

    def at(text: Column) -> Column:
        parts = F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")
        return F.transform(parts, lambda t: F.struct(F.split(t, ",")[0].cast("double").alias("x"), F.split(t, ",")[1].cast("double").alias("y")))

    def all_of(kind: str, of: str) -> Column:
        """The elements of a kind, at the top and in collections of collections."""
        empty = F.array().cast(f"array<{of}>")
        own = F.coalesce(F.col(kind), empty)
        deep = F.coalesce(F.expr(f"flatten(transform(MultiGeometry, m -> concat(coalesce(m.{kind}, cast(array() as array<{of}>)), coalesce(flatten(transform(m.MultiGeometry, n -> coalesce(n.{kind}, cast(array() as array<{of}>)))), cast(array() as array<{of}>)))))"), empty)
        return F.concat(own, deep)

    rings = lambda p: F.concat(F.array(at(p["outerBoundaryIs"]["LinearRing"]["coordinates"])), F.transform(F.coalesce(p["innerBoundaryIs"], F.array().cast(f"array<{ring}>")), lambda r: at(r["LinearRing"]["coordinates"])))
    filled = lambda parts: F.filter(parts, lambda part: F.coalesce(F.size(part[0]) > 0, F.lit(False)))
    found = rows.select(
        "name",
        filled(F.transform(all_of("Point", point), lambda p: F.array(at(p["coordinates"])))).alias("p"),
        filled(F.transform(all_of("LineString", point), lambda p: F.array(at(p["coordinates"])))).alias("l"),
        filled(F.transform(all_of("Polygon", area), rings)).alias("a"),
    )
    kinds = sum(((F.size(c) > 0).cast("int") for c in ("p", "l", "a")), F.lit(0))
    geom = F.lit(None).cast(GEOM)
    for c, kind in (("p", "Point"), ("l", "LineString"), ("a", "Polygon")):
        named = F.when(F.size(c) > 1, f"Multi{kind}").otherwise(kind)
        geom = F.when((kinds == 1) & (F.size(c) > 0), make(named, F.col(c))).otherwise(geom)
    reason = F.when(kinds == 0, "no geometry").when(kinds > 1, "a collection of several kinds")
    return found.select("name", geom.alias("geom"), F.lit(4326).alias("srid"), reason.alias("reason"))


# Format names by extension.
FORMATS = {"shp": "Shapefile", "geojson": "GeoJSON", "json": "GeoJSON", "geojsonl": "GeoJSONSeq", "kml": "KML", "kmz": "KMZ", "gpkg": "GeoPackage", "dxf": "DXF", "dwg": "DWG", "csv": "CSV", "gdb": "File Geodatabase"}


def file_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """(root, format, bytes): each file below the folder; a .gdb folder is one entry with the sum of its files if it holds .gdbtable files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    gdb = F.regexp_extract("path", r"^(.*\.gdb)/[^/]*$", 1)
    root = F.when(gdb != "", gdb).otherwise(F.col("path"))
    known = F.create_map(*[F.lit(v) for pair in FORMATS.items() for v in pair])
    sized = files.groupBy(root.alias("root")).agg(F.sum("length").alias("bytes"), F.bool_or(F.col("path").endswith(".gdbtable")).alias("table"))
    end = F.lower(F.regexp_extract("root", r"\.([^./]+)$", 1))
    name = F.when((end == "gdb") & ~F.col("table"), "unknown").otherwise(F.coalesce(F.try_element_at(known, end), F.lit("unknown")))
    return sized.select("root", name.alias("format"), "bytes")


def read_town_data(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Section name (file stem) to rows, of all JSON and CSV files of a folder; broken records are dropped, files without rows are left out."""
    files = spark.read.format("binaryFile").load(folder).select("path").collect()  # a handful of files
    out = {}
    for path in sorted(r.path for r in files):
        stem, _, end = path.rsplit("/", 1)[-1].rpartition(".")
        if end == "json":
            df = spark.read.option("mode", "DROPMALFORMED").json(path, multiLine=True)
        elif end == "csv":
            df = spark.read.option("mode", "DROPMALFORMED").csv(path, header=True)
        else:
            continue
        if df.columns and df.take(1):
            out[stem] = df
    return out
