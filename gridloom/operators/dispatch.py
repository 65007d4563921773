"""Analytics on dispatch results in long form: time, component, uid, variable, value, unit."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .skew import beside

UNITS = {"p": ("p_mw", "MW"), "state_of_charge": ("state_of_charge_mwh", "MWh"), "p_set": ("p_set_mw", "MW"),
         "p0": ("p0_mw", "MW"), "p1": ("p1_mw", "MW"), "status": ("status", "binary"),
         "start_up": ("start_up", "binary"), "shut_down": ("shut_down", "binary"),
         "marginal_price": ("marginal_price_eur_per_mwh", "EUR/MWh")}


def operation_series(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Wide result tables per component (time, uid, p, …) as one long series with units."""
    out = None
    for component, df in tables.items():
        variables = [c for c in df.columns if c in UNITS]
        names = {v: UNITS[v] for v in variables}
        long = df.unpivot(["time", "uid"], variables, "v", "value").select(
            "time", F.lit(component).alias("component"), "uid",
            S.lookup({k: n for k, (n, _) in names.items()}, "v").alias("variable"), F.col("value").cast("double").alias("value"),
            S.lookup({k: u for k, (_, u) in names.items()}, "v").alias("unit"),
        )
        out = long if out is None else out.unionByName(long)
    return out


def selected_buses(buses: DataFrame, admin_uids: Iterable[str] | None = None, spatial_uids: Iterable[str] | None = None) -> DataFrame:
    out = buses
    if admin_uids is not None:
        out = out.where(F.col("admin_uid").isin([admin_uids] if isinstance(admin_uids, str) else list(admin_uids)))
    if spatial_uids is not None:
        out = out.where(F.col("spatial_uid").isin([spatial_uids] if isinstance(spatial_uids, str) else list(spatial_uids)))
    if out.isEmpty():
        raise ValueError("The requested scope contains no buses.")
    return out.select("uid")


def snapshot_window(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    if start:
        df = df.where(F.col("time") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        df = df.where(F.col("time") <= F.lit(end).cast("timestamp_ntz"))
    return df


def dispatch_by_class(dispatch: DataFrame, buses: DataFrame | None = None) -> DataFrame:
    """Generation, storage discharge and storage charge per time and class.

    dispatch: time, component, bus_uid, carrier, p_mw. Missing power counts as 0.
    """
    if buses is not None:
        dispatch = dispatch.join(buses.select(F.col("uid").alias("bus_uid")), "bus_uid", "left_semi")
    p = F.coalesce("p_mw", F.lit(0.0))
    storage = F.col("component") == "storage"
    return dispatch.where(F.col("component").isin("generator", "storage")).groupBy(
        "time", S.base_class("carrier").alias("class")
    ).agg(
        F.sum(F.when(~storage, p).otherwise(0.0)).alias("generation_mw"),
        F.sum(F.when(storage, F.greatest(p, F.lit(0.0))).otherwise(0.0)).alias("storage_discharge_mw"),
        F.sum(F.when(storage, F.least(p, F.lit(0.0))).otherwise(0.0)).alias("storage_charge_mw"),
    )


def total_load(load: DataFrame) -> DataFrame:
    return load.groupBy("time").agg(F.sum(F.coalesce("p_set_mw", F.lit(0.0))).alias("load_mw"))


def run_summary(dispatch: DataFrame, load: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """One row: snapshots, load, shedding and its share, storage energy, weighted per snapshot.

    weights: time, weight (hours a snapshot stands for); 1 without it.
    """
    one = F.lit(1.0)
    if weights is not None:
        dispatch, load = dispatch.join(weights, "time", "left"), load.join(weights, "time", "left")
        one = F.coalesce("weight", F.lit(0.0))
    p = F.coalesce("p_mw", F.lit(0.0))
    storage = F.col("component") == "storage"
    a = dispatch.agg(
        F.sum(F.when(F.col("carrier") == "load_shedding", p * one)).alias("shed"),
        F.sum(F.when(storage, F.greatest(p, F.lit(0.0)) * one)).alias("dis"),
        F.sum(F.when(storage, -F.least(p, F.lit(0.0)) * one)).alias("chg"),
    )
    b = load.agg(F.sum(F.coalesce("p_set_mw", F.lit(0.0)) * one).alias("load"), F.countDistinct("time").alias("snapshots"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return beside(a, b).select(
        "snapshots", zero("load").alias("load_mwh"), zero("shed").alias("load_shedding_mwh"),
        F.coalesce(F.try_divide(zero("shed"), F.col("load")), F.lit(0.0)).alias("load_shedding_share"),
        zero("dis").alias("storage_discharge_mwh"), zero("chg").alias("storage_charge_mwh"),
    )


def dispatch_validity(dispatch: DataFrame, load: DataFrame, storage_limits: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Valid when finite everywhere, no generator below -tolerance and no storage above its limit."""
    d = dispatch.join(storage_limits.select(F.col("uid").alias("unit_uid"), "p_nom"), "unit_uid", "left")
    p = F.col("p_mw")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    a = d.agg(
        F.coalesce(F.min(F.when((F.col("component") == "generator") & ~F.isnan(p), p)), F.lit(0.0)).alias("generator_min_mw"),
        F.coalesce(F.max(F.when(F.col("component") == "storage", F.greatest(F.abs(p) - F.col("p_nom"), F.lit(0.0)))), F.lit(0.0)).alias("storage_limit_excess_mw"),
        F.count_if(~finite(p)).alias("bad"),
    )
    b = load.agg(F.count_if(~finite(F.col("p_set_mw"))).alias("bad_load"))
    return beside(a, b).select(
        ((F.col("bad") + F.col("bad_load") == 0) & (F.col("generator_min_mw") >= -tolerance) & (F.col("storage_limit_excess_mw") <= tolerance)).alias("dispatch_valid"),
        "generator_min_mw", "storage_limit_excess_mw",
    )


def result_summary(dispatch: DataFrame, load: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """Energy overview in GWh plus committed cluster hours."""
    base = run_summary(dispatch, load)
    hours = status.agg(F.coalesce(F.sum("status"), F.lit(0.0)).alias("committed_cluster_hours")) if status is not None else None
    out = base.select(
        (F.col("load_mwh") / 1000).alias("daily_load_gwh"), (F.col("load_shedding_mwh") / 1000).alias("load_shedding_gwh"),
        (F.col("storage_discharge_mwh") / 1000).alias("storage_discharge_gwh"), (F.col("storage_charge_mwh") / 1000).alias("storage_charging_gwh"),
        (F.col("load_shedding_share") * 100).alias("load_shedding_share_percent"),
    )
    return beside(out, hours) if hours is not None else out
