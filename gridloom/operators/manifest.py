"""Backend parameter contract: unit conversion, field override, fallback and coverage."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from .aggregate import select_assets

COMPONENTS = ("branch", "transformer", "converter", "generator", "storage")
THERMAL = ("bioenergy", "coal", "gas", "geothermal", "nuclear", "other")


@dataclass(frozen=True)
class ParameterSpec:
    key: str
    component: str
    target: str
    name: str
    unit: str
    fallback: float
    required: bool
    units: Mapping[str, float]
    selector: Mapping[str, object] = field(default_factory=dict)
    column: str | None = None


def _spec(key, target, name, unit, fallback, required, units=(), selector=None, column=None) -> ParameterSpec:
    return ParameterSpec(
        key, key.split("_")[0], target, name, unit, float(fallback), required,
        {u: 1.0 for u in (unit, *units)}, selector or {}, column,
    )


AC, DC, BURN = {"current_type": "AC"}, {"current_type": "DC"}, {"class": list(THERMAL)}
PU, MWH = ("per unit",), ("EUR/MWh output",)

# One row per backend attribute (key, target, parameter, unit, fallback, required).
CONTRACT: tuple[ParameterSpec, ...] = (
    _spec("branch_ac_r", "Line.r", "r_ohm_per_km", "ohm/km", 0.03, True, selector=AC),
    _spec("branch_ac_x", "Line.x", "x_ohm_per_km", "ohm/km", 0.30, True, selector=AC),
    _spec("branch_ac_b", "Line.b", "c_nf_per_km", "nF/km", 0.0, False, selector=AC),
    _spec("branch_ac_s_nom", "Line.s_nom", "s_nom_mva_per_circuit", "MVA/circuit", 2000.0, True, selector=AC),
    _spec("branch_dc_p_nom", "Link.p_nom", "s_nom_mva_per_circuit", "MVA/circuit", 2000.0, True, selector=DC),
    _spec("branch_dc_efficiency", "Link.efficiency", "efficiency", "p.u.", 1.0, False, PU, DC),
    _spec("transformer_s_nom", "Transformer.s_nom", "sn_mva", "MVA", 3000.0, True),
    _spec("transformer_vk", "Transformer.x", "vk_percent", "%", 12.0, True),
    _spec("transformer_vkr", "Transformer.r", "vkr_percent", "%", 0.3, True),
    _spec("converter_p_nom", "Link.p_nom", "p_nom_mw", "MW", 3000.0, True),
    _spec("converter_efficiency", "Link.efficiency", "efficiency", "p.u.", 0.98, True, PU),
    _spec("generator_efficiency", "Generator.efficiency", "efficiency", "p.u.", 1.0, True, (*PU, "per unit (in LHV)"), BURN),
    _spec("generator_vom", "Generator.marginal_cost", "vom", "EUR/MWh", 0.0, True, (*MWH, "EUR/MWh_e", "EUR/MWhel")),
    _spec("generator_fuel", "Generator.marginal_cost", "fuel", "EUR/MWh_th", 0.0, True, ("EUR/MWhth", "EUR/MWh"), BURN),
    _spec("generator_co2_intensity", "Carrier.co2_emissions", "co2_intensity", "tCO2/MWh_th", 0.0, False, selector=BURN),
    _spec("generator_minimum_output", "Generator.p_min_pu", "minimum_output_pu", "p.u.", 0.0, False, PU),
    _spec("generator_ramp_up", "Generator.ramp_limit_up", "ramp_up_pu_per_hour", "p.u./h", 1.0, True, selector=BURN),
    _spec("generator_ramp_down", "Generator.ramp_limit_down", "ramp_down_pu_per_hour", "p.u./h", 1.0, True, selector=BURN),
    _spec("generator_capital_cost", "Generator.capital_cost", "capital_cost", "EUR/MW/year", 0.0, False),
    _spec("storage_efficiency", "StorageUnit.efficiency_store,StorageUnit.efficiency_dispatch", "efficiency", "p.u.", 1.0, True, PU),
    _spec("storage_max_hours", "StorageUnit.max_hours", "energy_to_power_ratio", "h", 6.0, True, column="duration_h"),
    _spec("storage_standing_loss", "StorageUnit.standing_loss", "standing_loss_pu_per_hour", "p.u./h", 0.0, True),
    _spec("storage_cyclic_soc", "StorageUnit.cyclic_state_of_charge", "cyclic_state_of_charge", "boolean", 0.0, False),
    _spec("storage_marginal_cost", "StorageUnit.marginal_cost", "vom", "EUR/MWh", 0.0, False, MWH),
    _spec("storage_capital_cost", "StorageUnit.capital_cost", "capital_cost", "EUR/MW/year", 0.0, False),
)


def contract(specs: Iterable[ParameterSpec] = CONTRACT) -> dict[str, ParameterSpec]:
    specs = tuple(specs)
    out = {s.key: s for s in specs}
    if len(out) != len(specs):
        raise ValueError("Contract keys must be unique.")
    unknown = {s.component for s in specs} - set(COMPONENTS)
    if unknown:
        raise ValueError(f"Unsupported components: {sorted(unknown)}")
    return out


def contract_table(spark: SparkSession, specs: Iterable[ParameterSpec] = CONTRACT) -> DataFrame:
    rows = [
        (s.key, s.component, s.target, s.name, s.column, s.unit, list(s.units), s.fallback, s.required,
         {k: ",".join(v) if isinstance(v, (list, tuple)) else str(v) for k, v in s.selector.items()})
        for s in contract(specs).values()
    ]
    return spark.createDataFrame(
        rows, "key string, component string, target string, name string, field string, unit string, "
        "accepted_units array<string>, fallback double, required boolean, selector map<string,string>"
    )


def converted(parameters: DataFrame, spec: ParameterSpec) -> DataFrame:
    """Parameter values of the spec's name in its unit; unknown units drop out."""
    factor = S.lookup({u: float(f) for u, f in spec.units.items()}, "unit")
    value = F.col("value").try_cast("double") * factor
    order = F.col("selected_parameter_uid") if "selected_parameter_uid" in parameters.columns else F.lit("")
    return (
        parameters.where((F.col("name") == spec.name) & F.col("value").isNotNull())
        .select("uid", value.alias("v"), F.coalesce(order, F.lit("")).alias("order"))
        .where("v IS NOT NULL")
    )


def with_values(assets: DataFrame, parameters: DataFrame, specs: Mapping[str, ParameterSpec], by: Sequence[str] = ("uid",)) -> DataFrame:
    """One column per spec key: own field if finite, else the parameter, else the fallback.

    All keys of a component share one pass over its parameters: an aggregate per uid with one
    conditional pick per key, then a single join. Assets with the same parameters name them by common columns (`by`),
    so that rows of parameters are not repeated per asset.
    """
    order = F.col("selected_parameter_uid") if "selected_parameter_uid" in parameters.columns else F.lit("")
    rank = F.struct(F.coalesce(order, F.lit("")).alias("o"), F.col("value").alias("v"))
    picks = []
    for key, s in specs.items():
        v = F.when(F.col("name") == s.name, F.col("value").try_cast("double") * S.lookup({u: float(f) for u, f in s.units.items()}, "unit"))
        picks.append(F.min_by(v, F.when(v.isNotNull(), rank)).alias("__" + key))
    names = sorted({s.name for s in specs.values()})
    wide = parameters.where(F.col("name").isin(names)).groupBy(*by).agg(*picks)
    out = assets.join(wide, [*by], "left")
    columns = []
    for key, s in specs.items():
        own = S.number(s.column) if s.column and s.column in assets.columns else F.lit(None).cast("double")
        columns.append(F.coalesce(own, F.col("__" + key), F.lit(s.fallback)).alias(key))
    return out.select(*[F.col(c) for c in assets.columns], *columns)


def coverage_report(
    assets: Mapping[str, DataFrame], parameters: Mapping[str, DataFrame], specs: Iterable[ParameterSpec] = CONTRACT, by: Sequence[str] = ("uid",)
) -> DataFrame:
    """One row per key: targets, resolved, unit mismatches, conflicts and a status. `by` as in `with_values`."""
    out = None
    for s in contract(specs).values():
        row = _coverage(assets[s.component], parameters[s.component], s, by)
        out = row if out is None else out.unionByName(row)
    return out


def _coverage(assets: DataFrame, parameters: DataFrame, s: ParameterSpec, by: Sequence[str]) -> DataFrame:
    targets = select_assets(assets, dict(s.selector))
    own = S.number(s.column).isNotNull() if s.column and s.column in assets.columns else F.lit(False)
    targets = targets.select(*by, own.alias("own"))
    named = parameters.where((F.col("name") == s.name) & F.col("value").isNotNull()).select(*by, "value", "unit")
    factor = S.lookup({u: float(f) for u, f in s.units.items()}, "unit")
    per_uid = named.withColumn("v", F.col("value").try_cast("double") * factor).groupBy(*by).agg(
        F.count("v").alias("usable"), F.count_if(factor.isNull()).alias("mismatch"),
        (F.min("v") < F.max("v")).alias("conflict"),
    )
    joined = targets.join(per_uid, [*by], "left")
    conflict = F.coalesce("conflict", F.lit(False))
    good = (F.col("own") | (F.coalesce("usable", F.lit(0)) > 0)) & ~conflict
    return joined.agg(
        F.count("*").alias("targets"), F.count_if(good).alias("resolved"),
        F.coalesce(F.sum("mismatch"), F.lit(0)).alias("unit_mismatches"), F.count_if(conflict).alias("conflicting_assets"),
    ).select(
        F.lit("backend_parameter_manifest").alias("check"), F.lit(s.component).alias("component"), F.lit(s.key).alias("name"),
        F.lit(s.target).alias("target"),
        F.when(F.col("targets") == 0, "not_applicable").when(F.col("resolved") == F.col("targets"), "pass").otherwise("fallback").alias("status"),
        F.try_divide("resolved", "targets").alias("value"), F.lit(s.required).alias("required"),
        F.format_string(
            f"%d/%d resolved as {s.unit.replace('%', '%%')}; fallback={s.fallback:g}; unit_mismatches=%d; conflicting_assets=%d",
            "resolved", "targets", "unit_mismatches", "conflicting_assets",
        ).alias("detail"),
    )
