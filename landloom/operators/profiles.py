"""Town profiles: latest snapshot, statistics as rows with their sources, narratives and headlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Label, field and unit of the statistics of each section, in order.
FIELDS = {
    "demographics": (
        ("Population", "population", "people"),
        ("Working-age (15-64) %", "working_age_pct", "%"),
        ("Post-secondary education %", "post_secondary_pct", "%"),
        ("Population trend (5y)", "population_5y_change", "%"),
        ("Median household income", "median_income", ""),
        ("Unemployment rate", "unemployment_pct", "%"),
        ("Average wage (monthly)", "average_wage", ""),
    ),
    "infrastructure": (
        ("Distance to highway", "highway_distance_km", "km"),
        ("Distance to nearest port", "port_distance_km", "km"),
        ("Distance to nearest airport", "airport_distance_km", "km"),
        ("Distance to nearest rail station", "rail_distance_km", "km"),
        ("Broadband availability", "broadband_max_mbps", "Mbps"),
        ("Power grid reliability", "power_reliability", ""),
        ("Water grid coverage", "water_coverage_pct", "%"),
        ("Natural gas available", "gas_available", ""),
    ),
    "land": (
        ("Total developable area", "total_developable_ha", "ha"),
        ("Industrial-zoned land", "industrial_ha", "ha"),
        ("Commercial-zoned land", "commercial_ha", "ha"),
        ("Residential-zoned land", "residential_ha", "ha"),
        ("Average price (industrial)", "industrial_price_per_sqm", "/m²"),
        ("Vacant land near infrastructure", "vacant_serviced_ha", "ha"),
    ),
    "economy": (("Recent investments (last 5y)", "count_5y", ""), ("Total amount invested (last 5y)", "total_5y_usd", "USD")),
}
HEADLINES = ("Population", "Industrial-zoned land", "Distance to highway")


def latest_snapshot(rows: DataFrame, by: str = "town") -> DataFrame:
    """Of each town the row of the greatest as_of, then year (nulls come last)."""
    w = Window.partitionBy(by).orderBy(F.col("as_of").desc_nulls_last(), F.col("year").desc_nulls_last())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def land_availability(parcels: DataFrame, by: str = "town") -> DataFrame:
    """Hectares in all and by use class, mean industrial price, vacant serviced hectares, and the count and the largest of parcels for sale; parcels without area count as 0."""
    ha = F.coalesce("area_sqm", F.lit(0.0)) / 10000
    of = lambda use: F.sum(F.when(F.col("use_class") == use, ha).otherwise(0.0)).alias(f"{use}_ha")
    return parcels.groupBy(by).agg(
        F.sum(ha).alias("total_developable_ha"),
        of("industrial"),
        of("commercial"),
        of("residential"),
        F.avg(F.when(F.col("use_class") == "industrial", F.col("price_per_sqm"))).alias("industrial_price_per_sqm"),
        F.sum(F.when(F.col("vacant") & F.col("serviced"), ha).otherwise(0.0)).alias("vacant_serviced_ha"),
        F.count_if("for_sale").alias("available"),
        F.max(F.when(F.col("for_sale"), F.col("area_sqm"))).alias("largest_available"),
    )


def profile_stats(wide: DataFrame, section: str, strict: bool = False, by: str = "town") -> DataFrame:
    """(town, section, nth, label, value, unit, source, as_of): a row for each known field that has a value.

    Without a source or date 'user-supplied' and '(undated)' stand; ``strict`` leaves such rows out. Without a known field there are no rows.
    """
    known = [(i, *f) for i, f in enumerate(FIELDS[section]) if f[1] in wide.columns]
    if not known:
        return wide.sparkSession.createDataFrame([], f"{by} string, section string, nth int, label string, value string, unit string, source string, as_of string")
    items = F.array(*[F.struct(F.lit(i).alias("nth"), F.lit(label).alias("label"), F.col(c).cast("string").alias("value"), F.lit(unit).alias("unit")) for i, label, c, unit in known])
    extra = lambda c: F.col(c).cast("string") if c in wide.columns else F.lit(None).cast("string")
    rows = wide.select(by, extra("source").alias("source"), extra("as_of").alias("as_of"), F.inline(items)).where("value is not null")
    if strict:
        rows = rows.where("source is not null and as_of is not null")
    return rows.select(by, F.lit(section).alias("section"), "nth", "label", "value", "unit", F.coalesce("source", F.lit("user-supplied")).alias("source"), F.coalesce("as_of", F.lit("(undated)")).alias("as_of"))


def employers_text(employers: Column) -> Column:
    """'name (sector, n employees), ...' of array<struct<name,sector,headcount>>; null where there are none."""
    one = lambda e: F.concat(e["name"], F.lit(" ("), e["sector"], F.lit(", "), F.coalesce(e["headcount"].cast("string"), F.lit("?")), F.lit(" employees)"))
    return F.when(F.size(employers) > 0, F.array_join(F.transform(employers, one), ", "))


def industries_text(industries: Column) -> Column:
    one = lambda e: F.concat(e["industry"], F.lit(" ("), e["share_pct"].cast("string"), F.lit("%)"))
    return F.when(F.size(industries) > 0, F.array_join(F.transform(industries, one), ", "))


def profile_narrative(economy: DataFrame, why_now: DataFrame, by: str = "town") -> DataFrame:
    """(town, employers, industries, incentives, improvements, advantages, risks) as texts and lists; towns of either table."""
    left = economy.select(by, employers_text(F.col("major_employers")).alias("employers"), industries_text(F.col("top_industries")).alias("industries"))
    right = why_now.select(by, "incentives", F.col("recent_improvements").alias("improvements"), "advantages", F.coalesce("risks", F.array().cast("array<string>")).alias("risks"))
    return left.join(right, by, "full_outer")


def profile_headlines(stats: DataFrame, by: str = "town") -> DataFrame:
    """(town, headline, label, value): the first statistic whose label holds each headline, in any case."""
    heads = F.filter(F.array(*[F.lit(h) for h in HEADLINES]), lambda h: F.contains(F.lower(F.col("label")), F.lower(h)))
    rows = stats.withColumn("headline", F.explode(heads))
    w = Window.partitionBy(by, "headline").orderBy("section", "nth")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(by, "headline", "label", "value")


def section_completeness(stats: DataFrame, by: str = "town") -> DataFrame:
    """(town, demographics, infrastructure, land, economy): statistics of each section, 0 where there are none."""
    return stats.groupBy(by).pivot("section", list(FIELDS)).agg(F.count("label")).na.fill(0)
