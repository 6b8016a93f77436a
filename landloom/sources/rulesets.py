"""Rulesets from YAML files as small tables, a row for each criterion or rule."""

from __future__ import annotations

from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession

BUILT_IN = Path(__file__).resolve().parent.parent / "rulesets"
GENERIC = "generic-starter"

CRITERION = """ruleset string, recommended double, conditional double, criterion_no int, name string, weight double, type string, layer string, units string, curve string,
  bounds struct<ideal:double,acceptable:double,unacceptable:double,min:double,max:double>, scores struct<no_overlap:double,partial_overlap:double,full_overlap:double>, radius_km double, stat string, description string"""
RULE = """jurisdiction string, zone_code string, ruleset string, rule_no int, name string, type string, field string, limit double, low double, high double, allowed array<string>,
  denominator string, ratio double, fields map<string,string>, limits map<string,double>, citation string"""

# Bounds where a ruleset gives none, by criterion type and curve.
DEFAULTS = {
    ("distance_to_layer", "linear_decreasing"): {"ideal": 0, "acceptable": 10, "unacceptable": 50},
    ("distance_to_layer", "linear_increasing"): {"unacceptable": 0, "acceptable": 30, "ideal": 80},
    ("distance_to_layer", "bell"): {"min": 0, "ideal": 30, "max": 100},
    ("terrain_stat", "linear_increasing"): {"unacceptable": 0, "acceptable": 100, "ideal": 500},
    ("terrain_stat", "linear_decreasing"): {"ideal": 0, "acceptable": 100, "unacceptable": 500},
    ("density_count", "linear_increasing"): {"unacceptable": 0, "acceptable": 100, "ideal": 1000},
    ("density_count", "bell"): {"min": 0, "ideal": 100, "max": 1000},
}
CURVES = {"distance_to_layer": "linear_decreasing", "terrain_stat": "linear_increasing", "density_count": "linear_increasing"}


def _documents(folders: list[str | Path]) -> list[dict]:
    """All rulesets of the YAML files in these folders, in order; a file holds one ruleset or a list of them."""
    out = []
    for folder in folders:
        for path in sorted(Path(folder).rglob("*.y*ml")) if Path(folder).is_dir() else []:
            found = yaml.safe_load(path.read_text(encoding="utf-8"))
            out += found if isinstance(found, list) else [found]
    return out


def canonical(v: Any) -> str:
    """Booleans as false and true, numbers without needless digits, else the text."""
    if isinstance(v, bool):
        return str(v).lower()
    return f"{v:g}" if isinstance(v, (int, float)) else str(v)


def _double(v: Any) -> float | None:
    return None if v is None else float(v)


def site_criteria(folders: list[str | Path]) -> list[dict]:
    seen, rows = set(), []
    for doc in _documents(folders):
        if "criteria" not in doc or doc["name"] in seen:
            continue
        seen.add(doc["name"])
        limits = doc.get("verdict_thresholds", {})
        for no, c in enumerate(doc.get("criteria", [])):
            kind = c.get("type")
            curve = c.get("score_curve") or CURVES.get(kind)
            b = {**DEFAULTS.get((kind, curve), {}), **c.get("bounds", {})}
            sc = {"no_overlap": 100, "partial_overlap": 30, "full_overlap": 0, **c.get("score", {})}
            rows.append(
                {
                    "ruleset": doc["name"], "recommended": float(limits.get("recommended", 70)), "conditional": float(limits.get("conditional", 50)), "criterion_no": no, "name": c["name"],
                    "weight": float(c.get("weight", 1)), "type": kind, "layer": c.get("layer"), "units": c.get("units", "km"), "curve": curve,
                    "bounds": {k: _double(b.get(k)) for k in ("ideal", "acceptable", "unacceptable", "min", "max")}, "scores": {k: float(sc[k]) for k in ("no_overlap", "partial_overlap", "full_overlap")},
                    "radius_km": float(c.get("radius_km", 1)), "stat": c.get("stat"), "description": c.get("description", ""),
                }
            )
    return rows


def load_site_rulesets(spark: SparkSession, override: list[str] | None = None, user: list[str] | None = None) -> DataFrame:
    """Criteria of all rulesets; of a name the first found counts: override, built-in, then user folders."""
    return spark.createDataFrame(site_criteria([*(override or []), BUILT_IN / "site", *(user or [])]), CRITERION)


def permit_rules(folders: list[str | Path]) -> list[dict]:
    seen, rows = set(), []
    for doc in _documents(folders):
        if "zone_code" not in doc:
            continue
        key = (doc.get("jurisdiction", GENERIC), doc["zone_code"])
        if key in seen:
            continue
        seen.add(key)
        for no, r in enumerate(doc.get("rules", [])):
            rows.append(
                {
                    "jurisdiction": key[0], "zone_code": key[1], "ruleset": doc.get("name", key[1]), "rule_no": no, "name": r["name"], "type": r.get("type"), "field": r.get("field"), "limit": _double(r.get("limit")),
                    "low": _double(r.get("min")), "high": _double(r.get("max")), "allowed": [canonical(v) for v in r["allowed"]] if "allowed" in r else None, "denominator": r.get("denominator"),
                    "ratio": _double(r.get("ratio")), "fields": r.get("fields"), "limits": {k: float(v) for k, v in r["limits"].items()} if "limits" in r else None, "citation": r.get("citation", ""),
                }
            )
    return rows


def load_permit_rulesets(spark: SparkSession, override: list[str] | None = None, user: list[str] | None = None) -> DataFrame:
    """Rules of all rulesets; of a (jurisdiction, zone) the first found counts: override, user, then built-in folders."""
    return spark.createDataFrame(permit_rules([*(override or []), *(user or []), BUILT_IN / "permit"]), RULE)
