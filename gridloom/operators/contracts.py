"""Fixed ordered schemas, their enforcement and a live schema report."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import duplicates, require_none

# --- fixed values: required columns per table, in canonical order --------------------------------
REQUIRED_COLUMNS: dict[str, tuple[str, ...]] = {
    "spatial": (
        "uid", "level", "geometry", "geometry_method", "observed_at",
        "valid_from", "valid_to", "source_id", "source_uid",
    ),
    "generator": (
        "uid", "class", "subclass", "status", "capacity_mw", "fuel",
        "chp", "ccs", "voltage_kv", "geometry", "geometry_method",
        "observed_at", "valid_from", "valid_to", "source_id", "source_uid",
        "mapping_rule_id",
    ),
    "storage": (
        "uid", "class", "subclass", "status", "power_capacity_mw",
        "energy_capacity_mwh", "duration_h", "voltage_kv", "geometry",
        "geometry_method", "observed_at", "valid_from", "valid_to",
        "source_id", "source_uid", "mapping_rule_id",
    ),
    "network.bus": (
        "uid", "class", "subclass", "status", "voltage_kv", "current_type",
        "geometry", "geometry_method", "observed_at", "valid_from", "valid_to",
        "source_id", "source_uid",
    ),
    "network.branch": (
        "uid", "class", "subclass", "status", "voltage_kv", "current_type",
        "from_bus_uid", "to_bus_uid", "length_km", "geometry", "geometry_method",
        "observed_at", "valid_from", "valid_to", "source_id", "source_uid",
    ),
    "network.transformer": (
        "uid", "class", "subclass", "status", "from_bus_uid", "to_bus_uid",
        "from_voltage_kv", "to_voltage_kv", "geometry", "geometry_method",
        "observed_at", "valid_from", "valid_to", "source_id", "source_uid",
    ),
    "network.converter": (
        "uid", "class", "subclass", "status", "from_bus_uid", "to_bus_uid",
        "from_voltage_kv", "to_voltage_kv", "from_current_type", "to_current_type",
        "geometry", "geometry_method", "observed_at", "valid_from", "valid_to",
        "source_id", "source_uid",
    ),
    "population": (
        "uid", "class", "population", "geometry", "geometry_method",
        "observed_at", "valid_from", "valid_to", "source_id", "source_uid",
    ),
    "parameter": (
        "uid", "name", "group", "value", "unit",
        "applies_to_dataset", "applies_to_uid", "class", "subclass", "status",
        "observed_at", "valid_from", "valid_to", "source_id", "source_uid",
        "source_version",
    ),
    "load": ("time", "uid", "class", "demand_mw"),
    "resource": ("time", "uid", "class", "availability_pu"),
}
NUMERIC_COLUMNS = (
    "capacity_mw", "power_capacity_mw", "energy_capacity_mwh", "duration_h",
    "length_km", "population", "value", "capacity_min_mw", "capacity_max_mw",
    "from_voltage_kv", "to_voltage_kv", "demand_mw", "availability_pu",
)
BOOLEAN_COLUMNS = (
    "chp", "ccs", "voltage_inferred", "circuit_inferred", "cable_inferred",
    "is_derived", "inferred",
)
# Columns that the mapping layer adds to a table.
MAPPED_COLUMNS: dict[str, tuple[str, ...]] = {
    "spatial": ("spatial_uid", "admin_uid", "area_km2", "spatial_level", "cell_kind", "source_cell_uid"),
    "generator": ("spatial_uid", "admin_uid", "spatial_level", "cell_distance_km", "bus_uid"),
    "storage": ("spatial_uid", "admin_uid", "spatial_level", "cell_distance_km", "bus_uid"),
    "population": ("spatial_uid", "population"),
}
# ------------------------------------------------------------------------------------------------

SERIES = ("load", "resource")
SCALAR_VOLTAGE = ("network.bus", "network.branch")


def canonical_type(schema_id: str, column: str) -> str | None:
    """Spark type of a canonical column; None for geometry, which keeps its own layout."""
    if column == "geometry":
        return None
    if column == "time":
        return "timestamp_ntz"
    if column == "voltage_kv":
        return "double" if schema_id in SCALAR_VOLTAGE else "array<double>"
    if column in NUMERIC_COLUMNS:
        return "double"
    return "boolean" if column in BOOLEAN_COLUMNS else "string"


def finalize(df: DataFrame, schema_id: str) -> DataFrame:
    """Cast to canonical types, required columns first in order, extras after; uid must be a key."""
    required = REQUIRED_COLUMNS[schema_id]
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{schema_id} is missing required columns: {missing}")
    def cast(c: str):
        wanted = canonical_type(schema_id, c)
        known = c in required or c in NUMERIC_COLUMNS or c in BOOLEAN_COLUMNS
        return F.col(c).try_cast(wanted).alias(c) if wanted and known else F.col(c)

    out = df.select(*[cast(c) for c in required], *[cast(c) for c in df.columns if c not in required])
    if schema_id not in SERIES:
        require_unique_uid(out, schema_id)
    return with_attributes(out, standard_dataset_id=schema_id.split(".")[0])


def require_unique_uid(df: DataFrame, label: str) -> None:
    require_none(df.where("uid IS NULL").select("uid"), f"{label}: uid is missing")
    require_none(duplicates(df, "uid"), f"{label}: uid is not unique")


def require_globally_unique(tables: Mapping[str, DataFrame]) -> None:
    """uids unique over all network tables together."""
    out = None
    for t in tables.values():
        out = t.select("uid") if out is None else out.union(t.select("uid"))
    require_none(duplicates(out, "uid"), "Component uids must be globally unique")


def with_attributes(df: DataFrame, **attributes: str) -> DataFrame:
    """Dataset attributes ride in the column metadata of uid, so Parquet keeps them."""
    old = df.schema["uid"].metadata or {}
    return df.withMetadata("uid", {**old, **attributes})


def attributes(df: DataFrame) -> dict[str, str]:
    return dict(df.schema["uid"].metadata or {})


def contract_issues(df: DataFrame, schema_id: str) -> list[tuple[str, str]]:
    """Broken schema rules as (code, column); data checks are in `uid_issues`."""
    required = REQUIRED_COLUMNS[schema_id]
    issues = [("missing_column", c) for c in required if c not in df.columns]
    if not issues and tuple(df.columns[: len(required)]) != required:
        issues.append(("column_order", ",".join(required)))
    types = dict(df.dtypes)
    for c in required:
        wanted = canonical_type(schema_id, c)
        if wanted and c in types and types[c] != wanted:
            issues.append(("column_type", c))
    if "uid" in df.columns and attributes(df).get("standard_dataset_id") != schema_id.split(".")[0]:
        issues.append(("dataset_id", "uid"))
    return issues


def uid_issues(df: DataFrame) -> DataFrame:
    """One row: rows, missing uids, rows that repeat a uid."""
    per = df.groupBy("uid").agg(F.count("*").alias("n"))
    return per.agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("uid").isNull(), F.col("n"))), F.lit(0)).alias("missing_uid"),
        F.coalesce(F.sum(F.when(F.col("uid").isNotNull() & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias("repeated_uid"),
    )


def schema_report(df: DataFrame, schema_id: str, layer: str = "standard") -> DataFrame:
    """Live table schema: component, role, name, dimensions, dtype, size, required, value."""
    required = set(REQUIRED_COLUMNS[schema_id]) | (set(MAPPED_COLUMNS.get(schema_id, ())) if layer == "mapping" else set())
    variable = {"load": "demand_mw", "resource": "availability_pu"}.get(schema_id)
    dims = "time,uid,class" if variable else "row"
    def role(c: str) -> str:
        if variable:
            return "variable" if c == variable else "dimension" if c in ("time", "uid", "class") else "coordinate"
        return "column"

    rows = [(schema_id, role(f.name), f.name, dims, f.dataType.simpleString(), f.name in required, None) for f in df.schema.fields]
    rows += [(schema_id, "attribute", k, None, "string", True, str(v)) for k, v in sorted(attributes(df).items())]
    report = df.sparkSession.createDataFrame(
        rows, "component string, role string, name string, dimensions string, dtype string, required boolean, value string"
    )
    size = df.agg(F.count("*").alias("size"), F.lit(schema_id).alias("component"))
    return report.join(size, "component")
