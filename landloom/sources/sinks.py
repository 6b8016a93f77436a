"""Text sinks: SQL loads, documents, features and published parcels; one file for each partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from landloom.functions import text as tx
from landloom.functions.geometry import to_geojson

# Column types of the two SQL dialects.
POSTGRES = {"string": "TEXT", "int": "BIGINT", "float": "DOUBLE PRECISION", "bool": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMPTZ"}
MYSQL = {"string": "TEXT", "int": "BIGINT", "float": "DOUBLE", "bool": "TINYINT(1)", "date": "DATE", "timestamp": "TIMESTAMP"}


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.IntegralType):
        return "int"
    if isinstance(t, T.NumericType):
        return "float"
    if isinstance(t, T.DateType):
        return "date"
    return "timestamp" if isinstance(t, T.TimestampType) else "string"


def _inserts(features: DataFrame, table: str, wrap) -> DataFrame:
    props = tx.disambiguate_props(features, keep=("geom",))
    names = [c for c in props.columns if c != "geom"]
    head = f"INSERT INTO {tx.safe_ident(table)} ({', '.join([*map(tx.safe_ident, names), 'geom'])}) VALUES ("
    values = [tx.sql_literal(F.col(c), props.schema[c].dataType) for c in names] + [wrap(to_geojson(F.col("geom")))]
    return props.where(to_geojson(F.col("geom")).isNotNull()).select(F.concat(F.lit(head), F.concat_ws(", ", *values), F.lit(");")).alias("value"))


def format_postgis(features: DataFrame, table: str) -> DataFrame:
    """One INSERT for each feature (columns and geom), geometry last; null geometries give none."""
    return _inserts(features, table, lambda g: F.concat(F.lit("ST_GeomFromGeoJSON('"), g, F.lit("')")))


def format_mysql(features: DataFrame, table: str, srid: int) -> DataFrame:
    return _inserts(features, table, lambda g: F.concat(F.lit("ST_GeomFromGeoJSON('"), g, F.lit(f"', 2, {srid})")))


def format_mongo(features: DataFrame) -> DataFrame:
    """One document a line: properties at the root and geometry, always in degrees; null geometries give none."""
    props = tx.disambiguate_props(features, keep=("geom",))
    geo = to_geojson(F.col("geom"))
    rest = F.to_json(F.struct(*[F.col(c) for c in props.columns if c != "geom"]), {"ignoreNullFields": "false"})
    return props.where(geo.isNotNull()).select(F.concat(F.regexp_replace(rest, r"\}$", ""), F.lit(', "geometry": '), geo, F.lit("}")).alias("value"))


def emit_ddl(schema: T.StructType, target: str, table: str, srid: int) -> list[str]:
    """CREATE TABLE and index statements of target postgis, mysql or mongo, from a schema alone."""
    if target == "mongo":
        return [f'db.{table}.createIndex({{ "geometry": "2dsphere" }});']
    types = {"postgis": POSTGRES, "mysql": MYSQL}[target]
    taken = {f.name for f in schema}
    columns = []
    for f in schema:
        if f.name == "geom":
            continue
        name = f.name
        if name.lower() in tx.RESERVED:
            name += "_attr"
            while name in taken:
                name += "_"
        length = (f.metadata or {}).get("length")
        kind = f"VARCHAR({length})" if target == "mysql" and length and _kind(f.dataType) == "string" else types[_kind(f.dataType)]
        columns.append(f"  {tx.safe_ident(name)} {kind}")
    ident = tx.safe_ident(table)
    if target == "postgis":
        body = ["  id BIGSERIAL PRIMARY KEY", *columns, f"  geom geometry(Geometry, {srid}) NOT NULL", "  created_at TIMESTAMPTZ NOT NULL DEFAULT NOW()"]
        return ["CREATE EXTENSION IF NOT EXISTS postgis;", f"CREATE TABLE IF NOT EXISTS {ident} (\n" + ",\n".join(body) + "\n);", f"CREATE INDEX IF NOT EXISTS {table}_geom_gist ON {ident} USING GIST (geom);"]
    body = ["  id BIGINT UNSIGNED AUTO_INCREMENT PRIMARY KEY", *columns, f"  geom GEOMETRY NOT NULL SRID {srid}", "  created_at TIMESTAMP DEFAULT CURRENT_TIMESTAMP"]
    return [f"CREATE TABLE IF NOT EXISTS {ident} (\n" + ",\n".join(body) + "\n);", f"CREATE SPATIAL INDEX {table}_geom_idx ON {ident} (geom);"]


def features_text(df: DataFrame) -> Column:
    """A GeoJSON feature of a row: geom, and all other columns as properties."""
    props = F.to_json(F.struct(*[F.col(c) for c in df.columns if c != "geom"]), {"ignoreNullFields": "false"})
    return F.concat(F.lit('{"type": "Feature", "geometry": '), F.coalesce(to_geojson(F.col("geom")), F.lit("null")), F.lit(', "properties": '), props, F.lit("}"))


def write_geojson(df: DataFrame, path: str, per_file: int = 1_000_000) -> None:
    """Feature sequences, a file for each partition and million rows."""
    df.select(features_text(df).alias("value")).write.option("maxRecordsPerFile", per_file).text(path)


def publish_parcels(df: DataFrame, folder: str, public_owner_names: bool = False, buckets: int = 16) -> None:
    """The public copy of parcels: features, CSV, and one JSON document for each parcel as rows (parcel_id, json) in hash buckets. Private columns are dropped first."""
    public = tx.strip_sensitive(df, public_owner_names=public_owner_names)
    write_geojson(public, f"{folder}/geojson")
    flat = public.drop("geom")
    flat.write.option("header", True).csv(f"{folder}/csv")
    documents = public.select("parcel_id", features_text(public).alias("json"), F.pmod(F.xxhash64("parcel_id"), F.lit(buckets)).alias("bucket"))
    documents.write.partitionBy("bucket").parquet(f"{folder}/documents")


def preview(df: DataFrame, limit: int, order: str = "fid") -> DataFrame:
    """The first rows in order, for reading; the whole goes through a writer."""
    return df.orderBy(order).limit(limit)
