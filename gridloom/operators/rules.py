"""Ordered classification rules: the first rule by priority whose patterns all match wins."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import duplicates, require_none

RULE_COLUMNS = (
    "rule_id", "priority", "source", "source_type_pattern", "technology_pattern", "fuel_pattern",
    "dataset", "class", "subclass",
)
PATTERNS = ("source_type_pattern", "technology_pattern", "fuel_pattern")
RULE_DATASETS = ("network", "generator", "storage")


def rule_issues(rules: DataFrame) -> DataFrame:
    """Broken rule tables as rows (code, rule_id)."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    issue = lambda df, code: df.select(F.lit(code).alias("code"), F.col("rule_id").cast("string"))
    priorities = duplicates(rules, "source", "priority").select(F.concat_ws(":", "source", "priority").alias("rule_id"))
    return (
        issue(rules.where(blank("rule_id")), "missing_rule_id")
        .union(issue(duplicates(rules, "rule_id"), "duplicate_rule_id"))
        .union(issue(priorities, "duplicate_priority"))
        .union(issue(rules.where(~F.col("dataset").isin(*RULE_DATASETS)), "unknown_dataset"))
        .union(issue(rules.where(blank("class")), "missing_class"))
        .union(issue(rules.where(F.col("priority").try_cast("double").isNull()), "invalid_priority"))
    )


def load_rules(rules: DataFrame, source: str, require: bool = True) -> list[dict]:
    """Checked rules of one source in order. A rule table is configuration: its rows become one expression."""
    missing = set(RULE_COLUMNS) - set(rules.columns)
    if missing:
        raise ValueError(f"The rule table is missing columns: {sorted(missing)}")
    require_none(rule_issues(rules), "Invalid classification rules")
    rows = [r.asDict() for r in rules.where(F.col("source") == source).collect()]
    if not rows and require:
        raise ValueError(f"No rules for source {source!r}.")
    for row in rows:
        for p in PATTERNS:
            row[p] = row[p] or ""
            re.compile(row[p] or ".*")
    return sorted(rows, key=lambda r: (float(r["priority"]), r["rule_id"]))


def _matches(rule: Mapping, inputs: Mapping[str, Column]) -> Column:
    ok = F.lit(True)
    for pattern, value in inputs.items():
        if rule[pattern]:
            ok = ok & F.coalesce(value.cast("string"), F.lit("")).rlike("(?i)" + rule[pattern])
    return ok


def first_match(rules: Sequence[Mapping], inputs: Mapping[str, Column]) -> Column:
    """Struct (dataset, class, subclass, rule_id) of the first matching rule, null without one.

    The rules become one ordered CASE expression: a single pass over the rows, no join at all.
    """
    out = F.lit(None)
    for rule in reversed(list(rules)):
        label = F.struct(
            F.lit(rule["dataset"]).alias("dataset"), F.lit(rule["class"]).alias("class"),
            F.lit(rule["subclass"] or None).cast("string").alias("subclass"),
            F.lit(rule["rule_id"]).alias("rule_id"),
        )
        out = F.when(_matches(rule, inputs), label).otherwise(out)
    return out


def classify(
    df: DataFrame, rules: Sequence[Mapping], source_type: str, technology: str, fuel: str
) -> DataFrame:
    """Add dataset, class, subclass and mapping_rule_id by all three patterns."""
    inputs = {
        "source_type_pattern": F.col(source_type), "technology_pattern": F.col(technology), "fuel_pattern": F.col(fuel),
    }
    return _spread(df.withColumn("__m", first_match(rules, inputs)))


def classify_technology(df: DataFrame, rules: Sequence[Mapping], technology: str, default: str = "other_storage") -> DataFrame:
    """Single-pattern variant with a default class."""
    out = _spread(df.withColumn("__m", first_match(rules, {"technology_pattern": F.col(technology)})))
    return out.withColumn("class", F.coalesce("class", F.lit(default)))


def _spread(df: DataFrame) -> DataFrame:
    return df.select(
        *[c for c in df.columns if c not in ("__m", "dataset", "class", "subclass", "mapping_rule_id")],
        F.col("__m.dataset").alias("dataset"), F.col("__m.class").alias("class"),
        F.col("__m.subclass").alias("subclass"), F.col("__m.rule_id").alias("mapping_rule_id"),
    )


def classify_parameters(
    df: DataFrame, rule_sets: Sequence[Sequence[Mapping]], source_type: str = "source_type",
    technology: str = "technology", fuel: str = "fuel",
) -> DataFrame:
    """Own dataset and class win when both are set; then the rule sets in order; else as found."""
    have = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    inputs = {
        "source_type_pattern": have(source_type), "technology_pattern": have(technology), "fuel_pattern": have(fuel),
    }
    own = F.struct(
        have("applies_to_dataset").alias("dataset"), have("class").alias("class"),
        have("subclass").alias("subclass"), have("mapping_rule_id").alias("rule_id"),
    )
    found = F.coalesce(*[first_match(rules, inputs) for rules in rule_sets], own) if rule_sets else own
    picked = F.when(have("applies_to_dataset").isNotNull() & have("class").isNotNull(), own).otherwise(found)
    out = df.withColumn("__m", picked)
    return out.select(
        *[c for c in df.columns if c not in ("applies_to_dataset", "class", "subclass", "mapping_rule_id")],
        F.col("__m.dataset").alias("applies_to_dataset"), F.col("__m.class").alias("class"),
        F.col("__m.subclass").alias("subclass"), F.col("__m.rule_id").alias("mapping_rule_id"),
    )


def classify_with_capacity(
    df: DataFrame, rules: Sequence[Mapping], asset_type: Column, technology: Column, capacity: Column
) -> Column:
    """First rule in file order by type, technology pattern and the capacity interval [min, max)."""
    out = F.lit(None).cast("int")
    text = F.lower(F.coalesce(technology, F.lit("")))
    for i in reversed(range(len(rules))):
        rule = rules[i]
        ok = (asset_type == rule["source_asset_type"]) & text.rlike(rule["source_technology_pattern"] or ".*")
        ok = ok & (capacity >= float(rule["capacity_min_mw"]))
        if rule.get("capacity_max_mw") is not None:
            ok = ok & (capacity < float(rule["capacity_max_mw"]))
        out = F.when(ok, F.lit(i)).otherwise(out)
    return out


def generator_type(source_type: Column, technology: Column, fuel: Column) -> Column:
    """Detailed generator type of a register row; later, more specific conditions win."""
    tech = F.lower(F.coalesce(technology, F.lit("")))
    burns = F.lower(F.coalesce(fuel, F.lit("")))
    gas = burns.rlike("fossil gas|natural gas|lng|coalbed methane|coal mine methane")
    return (
        F.when(source_type == "oil/gas", F.when(gas, "natural_gas").otherwise("other_oil_gas"))
        .when(
            source_type == "hydropower",
            F.when(tech.contains("pumped storage"), "pumped_storage")
            .when(tech.contains("conventional"), "reservoir_hydropower")
            .when(tech.contains("run-of-river"), "run_of_river_hydropower")
            .otherwise("other_hydropower"),
        )
        .when(source_type == "wind", F.when(tech.contains("offshore"), "offshore_wind").otherwise("onshore_wind"))
        .when(
            source_type == "utility-scale solar",
            F.when(tech.contains("solar thermal"), "solar_thermal").otherwise("utility_scale_solar"),
        )
        .otherwise(source_type)
    )


# Technology words of storage projects, first match wins.
STORAGE_TYPES = (
    ("pumped hydro", "pumped_storage"),
    ("lithium", "lithium_ion_storage"),
    ("flow battery", "flow_battery_storage"),
    ("compressed air", "compressed_air_storage"),
    ("heat|thermal", "thermal_storage"),
    ("sodium", "sodium_battery_storage"),
    ("capacitor", "capacitor_storage"),
)


def storage_type(technology: Column) -> Column:
    text = F.lower(F.coalesce(technology, F.lit("")))
    out = F.lit("other_storage")
    for pattern, label in reversed(STORAGE_TYPES):
        out = F.when(text.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def mapping_scope(inside: Column, same_region: Column, distance: Column, limit: float) -> Column:
    near = distance <= limit
    return (
        F.when(inside, "inside_station")
        .when(same_region & near, "same_province_near")
        .when(same_region, "same_province_distant")
        .when(near, "national_fallback_near")
        .otherwise("national_fallback_distant")
    )


def included(scope: Column) -> Column:
    return ~scope.endswith("distant")


def needs_distance_review(distance_m: Column, review_km: float) -> Column:
    return distance_m > review_km * 1000
