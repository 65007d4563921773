"""Case aggregation: assets, memberships, parameters and load by bus or cell."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .skew import with_listed, with_share

METHODS = {"bus": "bus_uid", "cell": "spatial_uid"}


def _key(method: str) -> str:
    if method not in METHODS:
        raise ValueError("Aggregation must be 'none', 'bus' or 'cell'.")
    return METHODS[method]


def capacity_column(dataset_id: str) -> str:
    return "capacity_mw" if dataset_id == "generator" else "power_capacity_mw"


def aggregate_uid(dataset_id: str, key: str) -> Column:
    return F.concat_ws(
        ":", F.lit("case"), F.lit(dataset_id), F.col(key), F.col("class"), F.coalesce("subclass", F.lit("unspecified"))
    )


def identity_membership(data: DataFrame) -> DataFrame:
    return data.select(F.col("uid").alias("source_uid"), F.col("uid").alias("aggregate_uid"), F.lit(1.0).alias("weight"))


def membership(data: DataFrame, *, dataset_id: str, method: str) -> DataFrame:
    """Source asset to aggregate with its capacity share; 0 where the aggregate has no capacity."""
    if method == "none":
        return identity_membership(data)
    cap = capacity_column(dataset_id)
    place = lambda c: F.col(c) if c in data.columns else F.lit(None).cast("string").alias(c)
    base = data.select(
        F.col("uid").alias("source_uid"), aggregate_uid(dataset_id, _key(method)).alias("aggregate_uid"),
        F.col(cap).cast("double").alias("source_capacity_mw"),
        place("spatial_uid").alias("source_spatial_uid"), place("bus_uid").alias("source_bus_uid"),
    )
    return with_share(base, ["aggregate_uid"], "source_capacity_mw", "__w").select(
        "source_uid", "aggregate_uid", F.coalesce("__w", F.when(F.col("source_capacity_mw").isNotNull(), F.lit(0.0))).alias("weight"),
        "source_capacity_mw", "source_spatial_uid", "source_bus_uid",
    )


def aggregate_assets(data: DataFrame, *, dataset_id: str, method: str, list_sources: bool = True, places: DataFrame | None = None) -> DataFrame:
    """Assets of one bus or cell, class and subclass as one row; other columns from the first uid.

    places: (uid, x, y) of the buses or of the cells' centres; an aggregate stands at its own bus or cell.
    `source_uid` lists the members (see `with_listed`); each also is a membership row.
    """
    if method == "none":
        return data
    cap = capacity_column(dataset_id)
    base = data.withColumn("__a", aggregate_uid(dataset_id, _key(method)))
    summed = {cap, "energy_capacity_mwh", "duration_h", *(("x", "y") if places is not None else ())}
    other = [c for c in data.columns if c not in {*summed, "uid", "status", "source_uid", "geometry_method"}]
    aggs = [
        F.min_by(F.struct(*other), "uid").alias("__first"),
        F.coalesce(F.sum(cap), F.lit(0.0)).alias(cap), F.count("*").alias("source_count"),
    ]
    if dataset_id == "storage":
        aggs.append(F.sum("energy_capacity_mwh").alias("energy_capacity_mwh"))
    out = base.groupBy("__a").agg(*aggs)
    if list_sources:
        members = base.select("__a", F.col("uid").alias("source_uid"))
        out = with_listed(out, members, ["__a"], ["source_uid"])
    columns = [F.col("__a").alias("uid"), *[F.col("__first")[c].alias(c) for c in other], cap]
    if dataset_id == "storage":
        columns += ["energy_capacity_mwh", F.try_divide("energy_capacity_mwh", cap).alias("duration_h")]
    columns += [F.lit("aggregated").alias("status"), F.lit(f"case_{method}_aggregation").alias("geometry_method"), "source_count"]
    if list_sources:
        columns.append("source_uid")
    out = out.select(*columns)
    if places is None:
        return out
    at = places.select(F.col("uid").alias("__place"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return out.join(at, F.col(_key(method)) == F.col("__place"), "left").drop("__place")


def aggregate_parameters(
    parameter: DataFrame, members: DataFrame, *, sum_names: Iterable[str] = (), boolean_names: Iterable[str] = (), list_sources: bool = True,
    by: Sequence[str] = ("uid",),
) -> DataFrame:
    """Parameters of aggregates: sum, maximum or capacity-weighted mean; units stay apart.

    A zero total weight gives a null value instead of an error. Members with the same parameters name them by common
    columns (`by`; the default is the uid of the asset, `source_uid` of a member). Parameters are summed per such
    profile and members per aggregate and profile before both meet, so no row is made per member and parameter. Texts
    are listed once per set of profiles.
    """
    keys = [f"__{c}" for c in by]
    p = parameter.where("value IS NOT NULL").withColumnsRenamed(dict(zip(by, keys)))
    own = ["source_uid" if c == "uid" else c for c in by]
    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in keys))
    m = members.select(*[F.col(c).alias(k) for c, k in zip(own, keys)], "aggregate_uid", "source_capacity_mw").where(known)
    profiles = p.groupBy(*keys, "name", "unit").agg(F.sum("value").alias("v"), F.max("value").alias("most"), F.count("*").alias("n"))
    weights = m.groupBy("aggregate_uid", *keys).agg(F.count("*").alias("members"), F.sum("source_capacity_mw").alias("w"))
    joined = weights.join(profiles, keys)
    grouped = joined.groupBy("aggregate_uid", "name", "unit").agg(
        F.sum(F.col("v") * F.col("members")).alias("__sum"), F.max("most").alias("__max"),
        F.try_divide(F.sum(F.col("v") * F.col("w")), F.sum(F.col("n") * F.col("w"))).alias("__mean"), F.sum(F.col("n") * F.col("members")).alias("records"),
    )
    ids = [c for c in ("selected_parameter_uid", "source_id", "source_uid") if list_sources and c in parameter.columns]
    if ids:
        sets = weights.groupBy("aggregate_uid").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct(*keys)))), 256).alias("__set"))
        sets = cut_lineage(sets)
        one = sets.groupBy("__set").agg(F.min("aggregate_uid").alias("aggregate_uid"))
        within = one.join(weights.select("aggregate_uid", *keys), "aggregate_uid").join(p.select(*keys, "name", "unit", *ids), keys)
        scopes = ["__set", "name", "unit"]
        texts = with_listed(within.select(*scopes).distinct(), within, scopes, ids)
        texts = texts.withColumnsRenamed({"name": "__name", "unit": "__unit"})
        same = (F.col("name").eqNullSafe(F.col("__name"))) & (F.col("unit").eqNullSafe(F.col("__unit")))
        grouped = grouped.join(sets, "aggregate_uid").withColumnRenamed("__set", "__of")
        grouped = grouped.join(texts, (F.col("__of") == F.col("__set")) & same).drop("__of", "__set", "__name", "__unit")
    name = F.col("name")
    value = F.when(name.isin(list(sum_names)), F.col("__sum")).when(name.isin(list(boolean_names)), F.col("__max")).otherwise(F.col("__mean"))
    return grouped.withColumn("value", value).withColumn("match_result", F.lit("aggregated")).withColumn(
        "match_info", F.format_string("aggregated_parameter_records=%d", "records")
    ).withColumnRenamed("aggregate_uid", "uid").drop("__sum", "__max", "__mean")


def aggregate_load(series: DataFrame, dimension: DataFrame, method: str) -> DataFrame:
    """Load per bus or cell; one missing member leaves the timestamp missing.

    series: time, uid, class, demand_mw. dimension: uid and the target key.
    """
    if method == "none":
        return series
    key = _key(method)
    return (
        series.join(dimension.select("uid", key), "uid").groupBy("time", key, "class")
        .agg(F.when(F.count("demand_mw") == F.count("*"), F.sum("demand_mw")).alias("demand_mw"))
        .select("time", F.col(key).alias("uid"), "class", "demand_mw")
    )


def filter_assets(data: DataFrame, statuses: Iterable[str], low: float, high: float, capacity: str) -> DataFrame:
    """Status in the list and capacity inside the closed range; nulls never pass."""
    c = F.col(capacity).try_cast("double")
    return data.where(F.lower("status").isin([s.lower() for s in statuses]) & c.between(low, high))


def status_mask(allowed: Iterable[str], missing_is_active: bool) -> Column:
    status = F.lower("status")
    return F.coalesce(status.isin([s.lower() for s in allowed]), F.lit(False)) | (status.isNull() & F.lit(missing_is_active))


def select_assets(assets: DataFrame, selector: dict) -> DataFrame:
    """AND of column-in-values; a selector column the table lacks selects nothing."""
    for column, expected in selector.items():
        values = expected if isinstance(expected, (list, tuple)) else [expected]
        assets = assets.where(F.col(column).isin(list(values)) if column in assets.columns else F.lit(False))
    return assets
