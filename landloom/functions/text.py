"""Text, attribute and drawing helpers."""

from __future__ import annotations

import re
from fnmatch import fnmatch

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from landloom.functions.geometry import make, number, vertex

# Names that the written schemas use themselves.
RESERVED = ("geom", "geog", "geometry")
# Fields that aren't published.
SENSITIVE = ("owner_*", "taxpayer_*", "purchase_price", "tax_value", "valuation_*", "phone", "email", "id_number", "national_id", "internal_*", "staff_note*", "comment")
# Drawing units and their metres; 0 is unspecified and taken as metres.
INSUNITS = {0: 1.0, 1: 0.0254, 2: 0.3048, 4: 0.001, 5: 0.01, 6: 1.0, 8: 2.54e-8, 9: 2.54e-5}
# Layer name patterns, the first that fits counts.
CAD_LAYERS = (
    ("skip", r"^(0|DEFPOINTS|DIM.*|TEXT.*|ANNO.*|LABEL.*|BORDER|TITLE|SHEET|NORTHARROW|LEGEND|VIEWPORT|HATCH.*|FILL.*|XREF|.*_REF)$"),
    ("parcel", r"^(PARCEL|LOT|PROPERTY)"),
    ("building", r"^(BUILDING|FOOTPRINT|STRUCTURE)"),
    ("road", r"^(ROAD|STREET|CL|EDGE_PAVEMENT|CURB|EOP|SIDEWALK|WALK)"),
    ("utility", r"^(PIPE|WATER|WTR|SEWER|SAN_|STORM_|GAS|OIL_|ELEC|POWER|OVERHEAD|UNDERGROUND|TELECOM|FIBER|COMM|MH|MANHOLE|CB|CATCHBASIN)"),
)
ARABIC = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"


def disambiguate_props(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns named like the reserved ones, in any case, get ``_attr``, then underscores until no column is called so. ``keep`` are left alone."""
    taken, names = set(df.columns), {}
    for c in df.columns:
        if c.lower() in RESERVED and c not in keep:
            new = f"{c}_attr"
            while new in taken:
                new += "_"
            taken.add(new)
            names[c] = new
    return df.withColumnsRenamed(names)


def safe_ident(name: str) -> str:
    return name if re.fullmatch(r"[a-zA-Z_][a-zA-Z0-9_]*", name) else '"' + name.replace('"', '""') + '"'


def sql_literal(c: Column, kind: T.DataType) -> Column:
    """NULL, TRUE or FALSE, a bare number without exponent, or quoted text."""
    if isinstance(kind, T.BooleanType):
        text = F.when(c, "TRUE").otherwise("FALSE")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = F.when(c == F.floor(c), F.format_string("%.1f", c.cast("double"))).otherwise(number(c.cast("double"), 12))
    elif isinstance(kind, T.NumericType):
        text = c.cast("string")
    else:
        text = F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(c.isNull(), "NULL").otherwise(text)


def parse_constraint(text: Column) -> Column:
    """struct<op,value> of texts like '<= 10' ('=' where none is written); null where there is no number."""
    part = lambda k: F.regexp_extract(text, r"^\s*(<=|>=|==|=|<|>)?\s*(-?[0-9]+(?:\.[0-9]+)?)\s*$", k)
    return F.when(part(2) != "", F.struct(F.when(part(1).isin("", "=="), "=").otherwise(part(1)).alias("op"), part(2).cast("double").alias("value")))


def holds(value: Column, constraint: Column) -> Column:
    op, limit = constraint["op"], constraint["value"]
    return F.when(op == "<=", value <= limit).when(op == ">=", value >= limit).when(op == "<", value < limit).when(op == ">", value > limit).when(op == "=", value == limit)


def strip_sensitive(df: DataFrame, patterns: tuple[str, ...] = SENSITIVE, public_owner_names: bool = False) -> DataFrame:
    """Without the columns that fit a pattern, in any case; owner_name* may stay where owner names are public records."""
    bad = [c for c in df.columns if any(fnmatch(c.lower(), p) for p in patterns) and not (public_owner_names and fnmatch(c.lower(), "owner_name*"))]
    return df.drop(*bad)


def required_properties(df: DataFrame, names: list[str]) -> Column:
    """The names of required properties that a row lacks; a column that isn't there is lacking everywhere."""
    absent = [F.when(F.col(n).isNull(), F.lit(n)) if n in df.columns else F.lit(n) for n in names]
    return F.array_compact(F.array(*absent))


def normalize_digits(text: Column) -> Column:
    return F.translate(text, ARABIC, "01234567890123456789")


def classify_cad_layer(name: Column) -> Column:
    out = F.lit("unknown")
    for kind, pattern in reversed(CAD_LAYERS):
        out = F.when(F.upper(name).rlike(pattern), kind).otherwise(out)
    return F.when(name.isNotNull(), out)


def scale_units(x: Column, insunits: Column) -> Column:
    """Drawing units in metres; unknown codes give null."""
    factors = F.create_map(*[F.lit(v) for pair in INSUNITS.items() for v in pair])
    return x * F.try_element_at(factors, insunits.cast("int"))


def entity_to_geometry(kind: Column, points: Column, closed: Column, cx: Column, cy: Column, r: Column, a0: Column, a1: Column) -> Column:
    """Geometry of a drawing entity; null for what has none (text, polylines of one point, other kinds). Angles are in degrees."""
    n = F.size(points)
    ring = F.when(n > 0, F.concat(points, F.array(points[0])))
    sweep = F.when(a1 < a0, a1 + 360).otherwise(a1) - a0
    start, end = F.radians(a0), F.radians(a0 + sweep)
    steps = F.greatest(F.lit(16), F.floor(sweep / 5.625)).cast("int")  # of pi / 32
    around = lambda at: vertex(cx + r * F.cos(at), cy + r * F.sin(at))
    circle = F.transform(F.sequence(F.lit(0), F.lit(64)), lambda i: around(2 * F.pi() * (i % 64) / 64))
    arc = F.transform(F.sequence(F.lit(0), steps), lambda i: around(start + (end - start) * i / steps))
    polyline = F.when(closed & (n >= 3), make("Polygon", F.array(F.array(ring)))).when(n >= 2, make("LineString", F.array(F.array(points))))
    return (
        F.when(kind == "POINT", make("Point", F.array(F.array(F.array(vertex(cx, cy))))))
        .when((kind == "LINE") & (n >= 2), make("LineString", F.array(F.array(F.slice(points, 1, 2)))))
        .when(kind.isin("LWPOLYLINE", "POLYLINE"), polyline)
        .when(kind == "CIRCLE", make("Polygon", F.array(F.array(circle))))
        .when(kind == "ARC", make("LineString", F.array(F.array(arc))))
    )


#: Geometry name for the most frequent entity kind of a drawing layer.
# Fixed values.
ENTITY_GEOMETRY = {
    "POINT": "Point",
    "LINE": "LineString",
    "LWPOLYLINE": "Polygon|LineString",
    "POLYLINE": "Polygon|LineString",
    "POLYGON": "Polygon",
    "CIRCLE": "Polygon (approximated)",
    "ARC": "LineString (sampled)",
    "ELLIPSE": "Polygon|LineString",
    "SPLINE": "LineString (sampled)",
    "HATCH": "Polygon (boundary)",
    "TEXT": "(annotation — skipped)",
    "MTEXT": "(annotation — skipped)",
    "DIMENSION": "(annotation — skipped)",
    "INSERT": "(block reference — skipped unless expanded)",
}


def infer_crs(xmin: Column, xmax: Column, ymin: Column, ymax: Column) -> Column:
    """The likely class of coordinate system from ranges; the first that fits counts."""
    within = lambda lo, hi, a, b: (lo >= a) & (hi <= b)
    return F.when(within(xmin, xmax, -180, 180) & within(ymin, ymax, -90, 90), "geographic").when(within(xmin, xmax, 100000, 900000) & within(ymin, ymax, 0, 10000000), "utm").when(xmin.isNotNull(), "local")


def crs_warnings(srid: Column, is_cad: Column) -> Column:
    """Warnings with their severity, as 'severity: text'."""
    return F.array_compact(
        F.array(
            F.when(is_cad, F.lit("high: no CRS metadata in a drawing")),
            F.when(~is_cad & srid.isNull(), F.lit("high: No CRS detected")),
            F.when(~is_cad & (srid != 4326), F.concat(F.lit("medium: Source CRS is EPSG:"), srid.cast("string"), F.lit("; reprojection to EPSG:4326 will be required"))),
        )
    )


def quarantine(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without a reason, and rows with one, which it names in a column ``reason``."""
    marked = df.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")
