"""Summary tables of registers, mappings, loads and capacities."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .skew import beside, exact_percentiles, with_group_totals, with_share

# --- fixed values -------------------------------------------------------------------------------
SCOPES = (
    "inside_station", "same_province_near", "same_province_distant",
    "national_fallback_near", "national_fallback_distant",
)
MODEL_ROLES = {
    "coal": "thermal_dispatchable", "natural_gas": "thermal_dispatchable", "other_oil_gas": "thermal_dispatchable",
    "bioenergy": "thermal_dispatchable", "nuclear": "nuclear_dispatchable", "utility_scale_solar": "variable_renewable",
    "solar_thermal": "thermal_storage_renewable", "onshore_wind": "variable_renewable", "offshore_wind": "variable_renewable",
    "geothermal": "dispatchable_renewable", "reservoir_hydropower": "reservoir_hydro",
    "run_of_river_hydropower": "run_of_river_hydro", "pumped_storage": "pumped_storage", "other_hydropower": "hydro",
}
OFFICIAL_TYPES = {
    "reservoir_hydropower": "hydropower", "run_of_river_hydropower": "hydropower", "pumped_storage": "hydropower",
    "other_hydropower": "hydropower", "coal": "thermal", "natural_gas": "thermal", "other_oil_gas": "thermal",
    "bioenergy": "thermal", "onshore_wind": "wind", "offshore_wind": "wind", "utility_scale_solar": "solar",
    "solar_thermal": "solar", "nuclear": "other", "geothermal": "other",
}
OFFICIAL_COLUMNS = ("hydropower_capacity_mw", "thermal_capacity_mw", "wind_capacity_mw", "solar_capacity_mw")
# ------------------------------------------------------------------------------------------------


def model_role(c: str = "generator_type"):
    return S.lookup(MODEL_ROLES, c)


def official_type(c: str = "generator_type"):
    return S.lookup(OFFICIAL_TYPES, c)


def type_metrics(df: DataFrame) -> DataFrame:
    """Records, locations and capacity per generator type."""
    return df.groupBy("generator_type").agg(
        F.count("*").alias("records"), F.countDistinct("location_uid").alias("locations"), F.sum("capacity_mw").alias("capacity_mw")
    )


def accuracy_by_type(df: DataFrame, types: Iterable[str]) -> DataFrame:
    """Records by location accuracy (rows) and type (columns)."""
    return df.groupBy(F.coalesce("location_accuracy", F.lit("missing")).alias("location_accuracy")).pivot(
        "generator_type", list(types)
    ).count().fillna(0)


def status_shares(df: DataFrame) -> DataFrame:
    """Share of each status in the capacity of its type."""
    per = df.groupBy("status", "generator_type").agg(F.sum("capacity_mw").alias("capacity_mw"))
    return with_share(per, ["generator_type"], "capacity_mw", "share")


def source_summary(df: DataFrame) -> DataFrame:
    """Register overview as (metric, value)."""
    by_location = df.groupBy("location_uid").agg(F.count("*").alias("n"))
    by_unit = df.groupBy("uid").agg((F.count("*") - 1).alias("extra"))
    one = beside(
        df.agg(
            F.count("*").alias("selected_records"), F.countDistinct("location_uid").alias("locations"), F.countDistinct("uid").alias("units"),
            F.count_if(F.col("latitude").isNull()).alias("missing_latitude"), F.count_if(F.col("longitude").isNull()).alias("missing_longitude"),
            F.count_if(F.coalesce("location_accuracy", F.lit("missing")) == "exact").alias("location_accuracy_exact"),
            F.count_if(F.coalesce("location_accuracy", F.lit("missing")) != "exact").alias("location_accuracy_non_exact_total"),
        ),
        by_unit.agg(F.sum("extra").alias("duplicated_units")),
        by_location.where("location_uid IS NOT NULL").agg(F.count_if(F.col("n") > 1).alias("multi_record_locations"), F.max("n").alias("maximum_records_per_location")),
    )
    return one.unpivot([], one.columns, "metric", "value")


def storage_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("storage_type", "status").agg(
        F.countDistinct("uid").alias("projects"), F.sum("power_capacity_mw").alias("power_capacity_mw"), F.sum("energy_capacity_mwh").alias("energy_capacity_mwh")
    )


def parameter_coverage(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.groupBy("generator_type").agg(
        F.count("*").alias("records"), F.sum("capacity_mw").alias("capacity_mw"), *[F.count(c).alias(f"{c}_values") for c in columns]
    )


def mapping_summary(df: DataFrame) -> DataFrame:
    """Records, places, capacity and exact distance percentiles per mapping scope; every scope is listed."""
    base = df.groupBy("mapping_scope").agg(
        F.count("*").alias("records"), F.countDistinct("location_uid").alias("locations"), F.countDistinct("node_uid").alias("candidate_nodes"),
        F.sum("capacity_mw").alias("capacity_mw"),
    )
    pct = exact_percentiles(df, ["mapping_scope"], "distance_km", {"median_distance_km": 0.5, "p95_distance_km": 0.95})
    scopes = df.sparkSession.createDataFrame([(s,) for s in SCOPES], "mapping_scope string")
    out = scopes.join(base, "mapping_scope", "left").join(pct, "mapping_scope", "left").fillna(0)
    return with_group_totals(out.withColumn("__g", F.lit(0)), ["__g"], __n=F.sum("records")).withColumn(
        "record_share_percent", F.coalesce(F.try_divide(100.0 * F.col("records"), F.col("__n")), F.lit(0.0))
    ).drop("__g", "__n")


def storage_mapping_summary(df: DataFrame) -> DataFrame:
    keys = ["storage_type", "mapping_scope"]
    base = df.groupBy(*keys).agg(
        F.countDistinct("uid").alias("projects"), F.sum("power_capacity_mw").alias("power_capacity_mw"), F.sum("energy_capacity_mwh").alias("energy_capacity_mwh")
    )
    return base.join(exact_percentiles(df, keys, "distance_km", {"median_distance_km": 0.5}), keys, "left")


def node_capacity(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Capacity, units and locations per station, type and status; null keys are kept as groups."""
    return df.groupBy(*keys).agg(
        F.sum("capacity_mw").alias("capacity_mw"), F.countDistinct("uid").alias("units"), F.countDistinct("location_uid").alias("locations")
    )


def top_nodes(df: DataFrame, n: int = 20) -> DataFrame:
    """The n largest nodes by capacity (a top-n report)."""
    return df.orderBy(F.col("capacity_mw").desc(), "node_uid").limit(n)


def capacity_comparison(official: DataFrame, register: DataFrame) -> DataFrame:
    """Official against register capacity per region and type.

    official: region, total_capacity_mw and the four type columns; the rest, not below 0, is 'other'.
    register: region, official_type, capacity_mw.
    """
    rest = F.greatest(F.col("total_capacity_mw") - sum((F.coalesce(c, F.lit(0.0)) for c in OFFICIAL_COLUMNS), F.lit(0.0)), F.lit(0.0))
    wide = official.withColumn("other_capacity_mw", rest)
    columns = [*OFFICIAL_COLUMNS, "other_capacity_mw"]
    long = wide.unpivot(["region", "total_capacity_mw"], columns, "t", "official_capacity_mw").withColumn(
        "official_type", F.regexp_replace("t", "_capacity_mw$", "")
    ).drop("t")
    mine = register.groupBy("region", "official_type").agg(F.sum("capacity_mw").alias("register_capacity_mw"))
    both = long.join(mine, ["region", "official_type"], "left").withColumn("register_capacity_mw", F.coalesce("register_capacity_mw", F.lit(0.0)))
    shared = with_share(both, ["region"], "register_capacity_mw", "__s")
    official_share = 100 * F.try_divide("official_capacity_mw", "total_capacity_mw")
    return shared.select(
        "region", "official_type", "official_capacity_mw", "register_capacity_mw",
        official_share.alias("official_share_percent"), (100 * F.col("__s")).alias("register_share_percent"),
        (100 * F.col("__s") - official_share).alias("share_difference_pp"),
        (100 * F.try_divide("register_capacity_mw", "official_capacity_mw")).alias("capacity_coverage_percent"),
    )


def comparison_by_type(df: DataFrame) -> DataFrame:
    out = df.groupBy("official_type").agg(
        F.sum("official_capacity_mw").alias("official_capacity_mw"), F.sum("register_capacity_mw").alias("register_capacity_mw"),
        F.avg(F.abs("share_difference_pp")).alias("mean_absolute_share_difference_pp"),
    )
    return out.withColumn("capacity_coverage_percent", 100 * F.try_divide("register_capacity_mw", "official_capacity_mw"))


def selected_regions(df: DataFrame, regions: Iterable[str]) -> DataFrame:
    return df.where(F.col("region").isin(list(regions)))


def station_load_weights(cells: DataFrame) -> DataFrame:
    """Population, cells, distances and load share per region and station."""
    per = cells.groupBy("region", "node_uid").agg(
        F.sum("population").alias("population"), F.count("*").alias("assigned_cells"),
        (F.avg("station_distance_m") / 1000).alias("mean_station_distance_km"), (F.max("station_distance_m") / 1000).alias("maximum_station_distance_km"),
    )
    return with_share(per, ["region"], "population", "region_load_share")


def unclosed_regions(weights: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    sums = weights.groupBy("region").agg(F.sum("region_load_share").alias("total"))
    return sums.where(F.abs(F.col("total") - 1) > tolerance)


def regional_load_summary(series: DataFrame, key: str = "uid", value: str = "demand") -> DataFrame:
    return series.groupBy(key).agg(F.count(value).alias("hours"), F.sum(value).alias("energy"), F.max(value).alias("peak"))


def node_load_table(series: DataFrame) -> DataFrame:
    """Peak and energy per node from hourly GWh."""
    return series.groupBy("node_uid").agg((F.max("load_gwh") * 1000).alias("peak_load_mw"), (F.sum("load_gwh") * 1000).alias("daily_energy_mwh"))


def availability_summary(series: DataFrame) -> DataFrame:
    return series.groupBy("class").agg(
        F.avg("availability_pu").alias("annual_mean_pu"), F.min("availability_pu").alias("minimum_pu"), F.max("availability_pu").alias("maximum_pu")
    )


def station_candidates(nodes: DataFrame) -> DataFrame:
    """Stations per region: counts by kind, multi-level nodes and the sorted list of levels."""
    region = F.coalesce("region", F.lit("unassigned"))
    counts = nodes.groupBy(region.alias("region")).agg(
        F.countDistinct("node_uid").alias("station_nodes"), F.count_if(F.col("station_type") == "substation").alias("substations"),
        F.count_if(F.col("station_type") == "converter").alias("converters"), F.count_if(F.size("levels") > 1).alias("multi_voltage_nodes"),
    )
    levels = nodes.select(region.alias("region"), F.explode("levels").alias("kv")).distinct().groupBy("region").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("kv")), lambda v: S.general_label(v)), ";").alias("voltage_levels_kv")
    )
    return counts.join(levels, "region", "left")


def missing_parameters(units: DataFrame, required: Iterable[str]) -> DataFrame:
    """Null counts of required columns per type (types with any gap only)."""
    required = list(required)
    out = units.groupBy("generator_type").agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    return out.where(sum((F.col(c) for c in required), F.lit(0)) > 0)


def cluster_summary(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("generator_type").agg(
        F.count("*").alias("clustered_generators"), F.sum("source_units").alias("source_units"), F.sum("p_nom_mw").alias("capacity_mw"),
        F.count_if("committable").alias("committable_clusters"),
    )


def capacity_pivot(generators: DataFrame, storage: DataFrame, types: Iterable[str]) -> DataFrame:
    """Node by type capacity with a total column, generators and storage together."""
    types = list(types)
    long = generators.select("node_uid", F.col("generator_type").alias("t"), "capacity_mw").unionByName(
        storage.select("node_uid", F.col("storage_type").alias("t"), F.col("power_capacity_mw").alias("capacity_mw"))
    )
    wide = long.groupBy("node_uid").pivot("t", types).sum("capacity_mw").fillna(0)
    return wide.withColumn("total_power_capacity_mw", sum((F.col(f"`{t}`") for t in types), F.lit(0.0)))


def unit_parameters_joined(units: DataFrame, parameters: DataFrame, statuses: Iterable[str]) -> DataFrame:
    """Included units of the statuses with capacity, joined one to one with their parameters."""
    from .skew import duplicates, require_none

    require_none(duplicates(parameters, "uid"), "Unit parameters are not unique")
    chosen = units.where(F.col("status").isin(list(statuses)) & F.col("model_inclusion") & (F.col("capacity_mw") > 0))
    require_none(duplicates(chosen, "uid"), "Units are not unique")
    return chosen.join(parameters, "uid", "left")

