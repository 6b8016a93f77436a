"""Permit rules: derived fields, the rules that apply, their evaluation, verdicts and advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from landloom.functions.geometry import number
from landloom.sources.rulesets import GENERIC

FEET, SQUARE_FEET = 0.3048, 0.09290304


def to_si(df: DataFrame, units: str = "units") -> DataFrame:
    """Proposals with units = imperial have their fields in feet and square feet (names ending in _m and _sqm) made metric; the column of units goes."""
    imperial = F.lower(F.col(units)) == "imperial"
    factor = lambda c: SQUARE_FEET if c.endswith("_sqm") else FEET if c.endswith("_m") else None
    changed = {c: F.when(imperial, F.col(c) * factor(c)).otherwise(F.col(c)) for c in df.columns if factor(c)}
    return df.withColumns(changed).drop(units)


def derive_proposal(df: DataFrame, area: str = "parcel_area") -> DataFrame:
    """With lot_coverage_pct, open_space_pct and FAR (where the parcel's area is over 0), units and parcel_area_sqm.

    What can be derived replaces what was supplied, units too unless avg_unit_size_sqm is given; what can't be derived stays as supplied. A missing area counts as 0.
    """
    a = F.coalesce(F.col(area), F.lit(0.0))
    old = lambda c: F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")
    foot, gross = old("footprint_sqm"), old("gross_floor_area_sqm")
    share = F.when((a > 0) & foot.isNotNull(), foot / a * 100)
    return df.withColumns(
        {
            "lot_coverage_pct": F.coalesce(share, old("lot_coverage_pct")),
            "open_space_pct": F.coalesce(100 - share, old("open_space_pct")),
            "FAR": F.coalesce(F.when((a > 0) & gross.isNotNull(), gross / a), old("FAR")),
            "units": F.coalesce(F.when(gross.isNotNull() & old("avg_unit_size_sqm").isNull(), F.ceil(gross / 80).cast("double")), old("units")),
            "parcel_area_sqm": a,
        }
    )


def resolve_ruleset(parcels: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (jurisdiction, zone_code, ...) with column ``from``: the jurisdiction whose rules hold for them, their own or the generic one; null if there are none."""
    known = F.broadcast(rules.select(F.col("jurisdiction").alias("j"), F.col("zone_code").alias("z")).distinct())
    own = known.withColumn("own", F.lit(True))
    generic = F.broadcast(known.where(F.col("j") == GENERIC).select(F.col("z").alias("gz"), F.lit(True).alias("generic")))
    out = parcels.join(own, (F.col("jurisdiction") == F.col("j")) & (F.col("zone_code") == F.col("z")), "left").join(generic, F.col("zone_code") == F.col("gz"), "left")
    chosen = F.when(F.col("own"), F.col("jurisdiction")).when(F.col("generic"), F.lit(GENERIC))
    return out.withColumn("from", chosen).drop("j", "z", "own", "gz", "generic")


def merge_overlays(parcels: DataFrame, overlays: str = "overlays") -> DataFrame:
    """A row for the base zone and each overlay, in that order (column part); all their rules must pass. Repeats and nulls among overlays count once and not."""
    zones = F.array_distinct(F.array_compact(F.concat(F.array("zone_code"), F.coalesce(F.col(overlays), F.array().cast("array<string>")))))
    keep = [F.col(c) for c in parcels.columns if c != "zone_code"]
    return parcels.select(*keep, F.col("zone_code").alias("base_zone"), F.posexplode(zones).alias("part", "zone_code"))


def required_text(kind: Column) -> Column:
    """What a rule asks for, as text."""
    none = F.lit("∞")
    return (
        F.when(kind == "max", F.concat(F.lit("≤ "), number(F.col("limit"))))
        .when(kind == "min", F.concat(F.lit("≥ "), number(F.col("limit"))))
        .when(kind == "range", F.concat(F.lit("["), F.coalesce(number(F.col("low")), F.concat(F.lit("-"), none)), F.lit(", "), F.coalesce(number(F.col("high")), none), F.lit("]")))
        .when(kind == "allowed_values", F.array_join("allowed", ", "))
        .when(kind == "ratio_min", F.concat(F.lit("≥ "), number(F.col("ratio")), F.lit(" per "), F.col("denominator")))
        .when(kind == "setback_check", F.array_join(F.transform(F.map_entries(F.coalesce("limits", F.create_map().cast("map<string,double>"))), lambda s: F.concat(s["key"], F.lit("≥"), number(s["value"]))), ", "))
        .otherwise(F.concat(F.lit("unsupported rule type '"), kind, F.lit("'")))
    )


def evaluate(proposals: DataFrame, rules: DataFrame, fields: list[str], key: str = "proposal_id") -> DataFrame:
    """(key, part, rule_no, name, type, field, required, proposed, passed, detail): a row for each rule that holds for a proposal.

    Proposals come with jurisdiction, zone_code and part. A missing field fails as MISSING, a denominator of 0 as DIV/0, an unknown rule type always. Where no
    ruleset is found there is one failing row of type error. Rules are a small dimension and are broadcast; proposals aren't shuffled.
    """
    resolved = resolve_ruleset(proposals, rules)
    kinds = {c: proposals.schema[c].dataType for c in fields}
    real = [c for c in fields if isinstance(kinds[c], (T.DoubleType, T.FloatType))]
    numeric = [c for c in fields if isinstance(kinds[c], T.NumericType)]
    told = rules.withColumn("required", required_text(F.col("type")))  # once for each rule
    rows = resolved.select(key, "part", "from", F.col("zone_code").alias("zone"), *fields)
    # Rules' own columns are put in a struct, as fields may be called like them.
    of_rule = F.broadcast(told.select(F.struct("*").alias("rule")))
    each = rows.join(of_rule, (F.col("from") == F.col("rule.jurisdiction")) & (F.col("zone") == F.col("rule.zone_code")), "left")

    def by_name(name: Column, columns: list[str], kind: str) -> Column:
        """The value of the field of that name, out of these columns; no map of all fields is made for it."""
        out = F.lit(None).cast(kind)
        for c in columns:
            out = F.when(name == c, F.col(c).cast(kind)).otherwise(out)
        return out

    asked = F.col("rule.field")
    values = F.map_from_entries(F.transform(F.map_entries(F.coalesce("rule.fields", F.create_map().cast("map<string,string>"))), lambda s: F.struct(s["key"], by_name(s["value"], numeric, "double"))))
    each = each.select(
        key,
        "part",
        "rule.*",
        by_name(asked, numeric, "double").alias("num"),
        by_name(asked, [c for c in fields if c not in real], "string").alias("plain"),
        by_name(F.col("rule.denominator"), numeric, "double").alias("den"),
        F.when(F.col("rule.type") == "setback_check", values).alias("n"),
    )
    v, num, den = F.col("num"), F.col("num"), F.col("den")
    # Text is made where a result shows it.
    text = F.coalesce("plain", number(F.col("num"), 10))
    missing = F.col("plain").isNull() & F.col("num").isNull()
    ratio = F.try_divide(num, den)
    directions = F.map_entries(F.coalesce("fields", F.create_map().cast("map<string,string>")))
    limit = lambda s: F.try_element_at(F.col("limits"), s["key"])
    value = lambda s: F.try_element_at(F.col("n"), s["key"])
    lacking = lambda s: value(s).isNull() | limit(s).isNull()
    failing = F.filter(directions, lambda s: lacking(s) | (value(s) < limit(s)))
    failures = F.transform(failing, lambda s: F.concat(s["key"], F.lit("="), F.when(lacking(s), "MISSING").otherwise(F.concat(number(value(s)), F.lit(" (need ≥ "), number(limit(s)), F.lit(")")))))
    present = F.filter(directions, lambda s: ~lacking(s))
    kind = F.col("type")
    simple = kind.isin("max", "min", "range", "allowed_values")
    ratio_missing = (kind == "ratio_min") & (num.isNull() | den.isNull())
    proposed = (
        F.when(kind.isNull(), "")
        .when(simple & missing | ratio_missing, "MISSING")
        .when(simple, text)
        .when((kind == "ratio_min") & (den == 0), "DIV/0")
        .when(kind == "ratio_min", F.concat(number(num), F.lit(" ("), F.format_string("%.2f", ratio), F.lit(" per "), F.col("denominator"), F.lit(")")))
        .when(kind == "setback_check", F.array_join(F.transform(present, lambda s: F.concat(s["key"], F.lit("="), number(value(s)))), ", "))
        .otherwise("")
    )
    passed = (
        F.when(kind == "max", v <= F.col("limit"))
        .when(kind == "min", v >= F.col("limit"))
        .when(kind == "range", F.coalesce(v >= F.col("low"), v.isNotNull() & F.col("low").isNull()) & F.coalesce(v <= F.col("high"), v.isNotNull() & F.col("high").isNull()))
        .when(kind == "allowed_values", F.array_contains("allowed", text))
        .when(kind == "ratio_min", ratio >= F.col("ratio"))
        .when(kind == "setback_check", F.size(failing) == 0)
    )
    return each.select(
        key,
        "part",
        F.coalesce("rule_no", F.lit(-1)).alias("rule_no"),
        F.coalesce("name", F.lit("ruleset")).alias("name"),
        F.coalesce("type", F.lit("error")).alias("type"),
        "field",
        F.coalesce("required", F.lit("no ruleset")).alias("required"),
        proposed.alias("proposed"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
        F.when(kind == "setback_check", F.array_join(failures, "; ")).otherwise("").alias("detail"),
    )


def advice(row_type: Column, field: Column, name: Column, required: Column, detail: Column) -> Column:
    """What to change for a failed rule; nothing for ranges and unknown types."""
    bare = F.regexp_replace(required, "^[≤≥] ", "")
    return (
        F.when(row_type == "max", F.concat(F.lit("Reduce "), field, F.lit(" to "), bare, F.lit(" or apply for a variance.")))
        .when(row_type == "min", F.concat(F.lit("Increase "), field, F.lit(" to "), bare, F.lit(" or apply for a variance.")))
        .when(row_type == "allowed_values", F.concat(F.lit("Change "), field, F.lit(" to one of: "), required, F.lit(".")))
        .when(row_type == "setback_check", F.concat(F.lit("Adjust setbacks: "), detail))
        .when(row_type == "ratio_min", F.concat(F.lit("Raise the count of "), name, F.lit(" to meet "), required, F.lit(".")))
    )


def _verdict() -> list[Column]:
    failed = F.count_if(~F.col("passed"))
    return [failed.alias("violations"), F.count_if("passed").alias("passes"), F.when(failed == 0, "COMPLIANT").otherwise("NON-COMPLIANT").alias("verdict")]


def _recommendations() -> Column:
    text = advice(F.col("type"), F.col("field"), F.col("name"), F.col("required"), F.col("detail"))
    said = F.when(~F.col("passed") & text.isNotNull(), F.struct("part", "rule_no", text.alias("text")))
    return F.transform(F.array_sort(F.collect_list(said)), lambda s: s["text"]).alias("recommendations")


def permit_verdict(results: DataFrame, key: str = "proposal_id") -> DataFrame:
    """(key, violations, passes, verdict)."""
    return results.groupBy(key).agg(*_verdict())


def permit_recommendations(results: DataFrame, key: str = "proposal_id") -> DataFrame:
    """(key, recommendations): texts for failed rules, in order of the rules; keys without any have an empty array."""
    return results.groupBy(key).agg(_recommendations())


def permit_report(results: DataFrame, key: str = "proposal_id") -> DataFrame:
    """Verdict and recommendations, in one pass."""
    return results.groupBy(key).agg(*_verdict(), _recommendations())


def run_id(at: str, parcel: Column) -> Column:
    """One time for the whole run, passed in as text."""
    return F.concat(F.lit(f"permit-check-{at}-"), parcel)


def last_wins(df: DataFrame, keys: list[str], order: str = "fid") -> DataFrame:
    """The row of greatest ``order`` of each key; rows with a null key go. The greatest is kept before the shuffle, so a key that repeats often moves little."""
    rest = [c for c in df.columns if c not in keys]
    known = df.where(" and ".join(f"{k} is not null" for k in keys))
    return known.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def top_n(df: DataFrame, by: list[str], order: list, n: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)
