"""Solver input tables as plain DataFrames."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..session import cut_lineage
from .manifest import CONTRACT, contract, with_values

SPECS = contract(CONTRACT)
VARIABLE_CLASSES = ("wind", "solar", "hydropower")
MIN_LENGTH_KM = 0.001
GRID_HZ = 50

# Weather class of each generator subclass.
RESOURCE_CLASS = {
    "onshore": "onshore",
    "offshore_fixed": "offshore_fixed",
    "offshore_floating": "offshore_fixed",
    "offshore_unspecified": "offshore_fixed",
    "utility_scale_pv": "utility_scale_pv",
    "run_of_river": "run_of_river",
}


def _specs(component: str) -> dict:
    return {k: s for k, s in SPECS.items() if s.component == component}


def _positive(key: str) -> Column:
    return S.positive_or(key, SPECS[key].fallback)


def step_hours(step: timedelta) -> float:
    return step.total_seconds() / 3600


def with_extendable(table: DataFrame, component: str, settings: Mapping[str, bool]) -> DataFrame:
    """Add the flag of a component's capacity expansion from the backend settings; off where they are silent.

    One setting governs branches, whether they become lines or links.
    """
    name = "s_nom_extendable" if component in ("line", "transformer") else "p_nom_extendable"
    setting = "branch" if component in ("line", "link") else component
    return table.withColumn(name, F.lit(bool(settings.get(f"{setting}_extendable", False))))


def bus_table(bus: DataFrame) -> DataFrame:
    """bus: uid, voltage_kv, current_type, x, y (representative point in degrees)."""
    return bus.select(
        "uid", F.coalesce(F.col("voltage_kv").try_cast("double"), F.lit(1.0)).alias("v_nom"), "x", "y",
        F.coalesce("current_type", F.lit("AC")).alias("carrier"),
    )


def line_tables(branch: DataFrame, parameters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """AC branches as lines and the other branches as links."""
    t = with_values(branch, parameters, _specs("branch"))
    raw = F.coalesce(F.col("length_km").try_cast("double"), F.lit(0.0))
    length = F.greatest(raw, F.lit(MIN_LENGTH_KM))
    circuits = F.coalesce(F.col("circuits").try_cast("double"), F.lit(1.0)) if "circuits" in branch.columns else F.lit(1.0)
    current = F.upper(F.coalesce("current_type", F.lit("AC")))
    ends = [F.col("from_bus_uid").alias("bus0"), F.col("to_bus_uid").alias("bus1")]
    lines = t.where(current == "AC").select(
        "uid", *ends, (_positive("branch_ac_r") * length).alias("r"), (_positive("branch_ac_x") * length).alias("x"),
        (2 * math.pi * GRID_HZ * F.col("branch_ac_b") * 1e-9 * raw).alias("b"),
        (_positive("branch_ac_s_nom") * circuits).alias("s_nom"), raw.alias("length"), F.lit("AC").alias("carrier"),
    )
    links = t.where(current != "AC").select(
        "uid", *ends, (_positive("branch_dc_p_nom") * circuits).alias("p_nom"), F.lit(-1.0).alias("p_min_pu"),
        _positive("branch_dc_efficiency").alias("efficiency"), F.lit("DC branch").alias("carrier"),
    )
    return lines, links


def transformer_table(transformer: DataFrame, parameters: DataFrame) -> DataFrame:
    t = with_values(transformer, parameters, _specs("transformer"))
    vk, r = _positive("transformer_vk") / 100, _positive("transformer_vkr") / 100
    return t.select(
        "uid", F.col("from_bus_uid").alias("bus0"), F.col("to_bus_uid").alias("bus1"),
        _positive("transformer_s_nom").alias("s_nom"), r.alias("r"),
        F.sqrt(F.greatest(vk * vk - r * r, F.lit(0.0))).alias("x"),
    )


def converter_table(converter: DataFrame, parameters: DataFrame) -> DataFrame:
    t = with_values(converter, parameters, _specs("converter"))
    return t.select(
        "uid", F.col("from_bus_uid").alias("bus0"), F.col("to_bus_uid").alias("bus1"),
        _positive("converter_p_nom").alias("p_nom"), _positive("converter_efficiency").alias("efficiency"),
        F.lit("ac_dc_converter").alias("carrier"),
    )


def generator_table(
    generator: DataFrame, parameters: DataFrame, step: timedelta = timedelta(hours=1), carbon_price: float = 0.0, by: Sequence[str] = ("uid",)
) -> DataFrame:
    """Costs, ramps and efficiency of generators; fleets dispatch continuously, so no minimum output."""
    t = with_values(generator, parameters, _specs("generator"), by)
    eff = _positive("generator_efficiency")
    burn = F.try_divide(F.col("generator_fuel") + carbon_price * F.col("generator_co2_intensity"), eff)
    return t.select(
        "uid", F.col("bus_uid").alias("bus"), F.coalesce(F.col("capacity_mw").try_cast("double"), F.lit(0.0)).alias("p_nom"),
        S.carrier("class", "subclass").alias("carrier"), eff.alias("efficiency"),
        (F.col("generator_vom") + F.coalesce(burn, F.lit(0.0))).alias("marginal_cost"), F.lit(0.0).alias("p_min_pu"),
        (F.col("generator_ramp_up") * step_hours(step)).alias("ramp_limit_up"),
        (F.col("generator_ramp_down") * step_hours(step)).alias("ramp_limit_down"),
        F.lit(False).alias("committable"), F.col("generator_capital_cost").alias("capital_cost"),
    )


def storage_table(storage: DataFrame, parameters: DataFrame) -> DataFrame:
    t = with_values(storage, parameters, _specs("storage"))
    one_way = F.sqrt(_positive("storage_efficiency"))
    return t.select(
        "uid", F.col("bus_uid").alias("bus"), F.coalesce(F.col("power_capacity_mw").try_cast("double"), F.lit(0.0)).alias("p_nom"),
        _positive("storage_max_hours").alias("max_hours"), S.carrier("class", "subclass").alias("carrier"),
        one_way.alias("efficiency_store"), one_way.alias("efficiency_dispatch"),
        F.col("storage_standing_loss").alias("standing_loss"), (F.col("storage_cyclic_soc") != 0).alias("cyclic_state_of_charge"),
        F.col("storage_marginal_cost").alias("marginal_cost"), F.col("storage_capital_cost").alias("capital_cost"),
    )


def carrier_table(generator: DataFrame, storage: DataFrame, parameters: DataFrame) -> DataFrame:
    """Carriers with capacity-weighted emissions per electric MWh; 0 where there is no weight."""
    t = with_values(generator, parameters, _specs("generator"))
    weight = F.coalesce(F.col("capacity_mw").try_cast("double"), F.lit(0.0))
    e = F.col("generator_co2_intensity") / _positive("generator_efficiency")
    own = t.groupBy(S.carrier("class", "subclass").alias("carrier")).agg(
        F.coalesce(F.try_divide(F.sum(e * weight), F.sum(weight)), F.lit(0.0)).alias("co2_emissions")
    )
    fixed = generator.sparkSession.createDataFrame([("AC",), ("DC",), ("DC branch",), ("ac_dc_converter",)], "carrier string")
    rest = fixed.union(storage.select(S.carrier("class", "subclass"))).distinct().join(own, "carrier", "left_anti")
    return own.unionByName(rest.withColumn("co2_emissions", F.lit(0.0)))


def nodal_load(series: DataFrame) -> DataFrame:
    return series.groupBy("time", "uid").agg(F.sum("demand_mw").alias("p_set"))


def member_profiles(
    generator: DataFrame, members: DataFrame, resource: DataFrame, class_map: Mapping[str, str] = RESOURCE_CLASS
) -> DataFrame:
    """Availability of aggregates: capacity-weighted mean of their members' cell profiles.

    Members whose cell has no profile stay out of both sums.
    """
    wanted = generator.select(F.col("uid").alias("aggregate_uid"), S.lookup(class_map, "subclass").alias("class")).where("class IS NOT NULL")
    m = members.join(wanted, "aggregate_uid").select(
        "aggregate_uid", "class", F.col("source_spatial_uid").alias("cell"), F.col("source_capacity_mw").alias("w")
    ).groupBy("aggregate_uid", "class", "cell").agg(F.sum("w").alias("w"))
    r = resource.select("time", F.col("uid").alias("cell"), "class", "availability_pu")
    v = F.col("availability_pu")
    return m.join(r, ["cell", "class"]).groupBy("aggregate_uid", "time").agg(
        F.try_divide(F.sum(v * F.col("w")), F.sum("w")).alias("availability_pu")
    ).withColumnRenamed("aggregate_uid", "uid")


def load_shedding(nodal: DataFrame, bus_of: DataFrame, multiplier: float, cost: float) -> DataFrame:
    """One emergency generator per load with capacity peak x multiplier. bus_of: uid, bus."""
    peak = nodal.groupBy("uid").agg(F.max("p_set").alias("peak"))
    return bus_of.join(peak, "uid", "left").select(
        F.concat(F.lit("load_shedding:"), "uid").alias("uid"), "bus", F.lit("load_shedding").alias("carrier"),
        (F.coalesce("peak", F.lit(0.0)) * multiplier).alias("p_nom"), F.lit(float(cost)).alias("marginal_cost"),
    )


def append_load_shedding(generators: DataFrame, loads: DataFrame, cost: float, margin: float = 1.05) -> DataFrame:
    """Unit-commitment variant: shedding rows beside the generator clusters (peak x 1.05)."""
    rows = loads.select(
        "node_uid", F.lit("load_shedding").alias("generator_type"), (F.col("peak_load_mw") * margin).alias("p_nom_mw"),
        F.lit(0).cast("long").alias("source_units"), F.lit(float(cost)).alias("marginal_cost_eur_per_mwh"),
        F.lit(False).alias("committable"), F.lit(0.0).alias("p_min_pu"), F.lit(1.0).alias("p_max_pu"), F.lit(1.0).alias("efficiency"),
    )
    return generators.unionByName(rows, allowMissingColumns=True)


def dense_ids(nodes: DataFrame, uid: str, prefix: str, width: int = 5) -> DataFrame:
    """Display ids in uid order: range partitions are counted, then numbered with their offset."""
    ordered = nodes.select(F.col(uid).alias("__uid")).where(F.col(uid).isNotNull()).distinct().repartitionByRange("__uid").sortWithinPartitions("__uid")
    # The id holds the partition above 33 bits and the row in it below; both are kept as they were written.
    placed = cut_lineage(ordered.withColumn("__id", F.monotonically_increasing_id()))
    part, row = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__rows"))
    before = F.coalesce(F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = placed.withColumn("__part", part).join(sizes.select("__part", before.alias("__before")), "__part").select(
        "__uid", F.concat(F.lit(prefix), F.format_string(f"%0{width}d", F.col("__before") + row)).alias("display_id")
    )
    return nodes.join(numbered, F.col(uid) == F.col("__uid")).drop("__uid")


def number_endpoints(branches: DataFrame, ids: DataFrame, uid: str = "node_uid") -> DataFrame:
    out = branches
    for end, name in (("from_node", "bus0"), ("to_node", "bus1")):
        out = out.join(ids.select(F.col(uid).alias(end), F.col("display_id").alias(name)), end)
    return out


def equivalent_lines(branches: DataFrame, base_kv: float, capacity_multiplier: float) -> DataFrame:
    """Impedance on one base voltage and capacity from the assumption columns of a branch.

    branches: voltage_kv, length_km, circuits_assumed, r_ohm_per_km, x_ohm_per_km, s_nom_mva_per_circuit.
    """
    scale = S.voltage_scale(base_kv, "voltage_kv")
    per = lambda c: F.col(c) * F.col("length_km") * scale / F.col("circuits_assumed")
    return branches.withColumns({
        "r_ohm_equivalent": per("r_ohm_per_km"), "x_ohm_equivalent": per("x_ohm_per_km"),
        "s_nom_mva": F.col("s_nom_mva_per_circuit") * F.col("circuits_assumed") * capacity_multiplier,
    })


def operating_limits(df: DataFrame, availability: Mapping[str, float]) -> DataFrame:
    """Minimum output and ramp floors of committable clusters and fixed availability by type."""
    on = F.col("committable")
    p_min = F.when(on, F.col("minimum_output_pu")).otherwise(F.lit(0.0))
    out = df.withColumn("p_min_pu", p_min)
    for ramp in ("up", "down"):
        raw = F.col(f"ramp_{ramp}_pu_per_hour")
        out = out.withColumn(f"ramp_limit_{ramp}_pu", F.when(on, F.greatest(raw, F.col("p_min_pu"))).otherwise(raw))
    fixed = F.coalesce(S.lookup(dict(availability), "generator_type"), F.lit(1.0)) if availability else F.lit(1.0)
    return out.withColumn("p_max_pu", fixed)


def storage_defaults(df: DataFrame, defaults: Mapping[str, tuple[float, float, float, float]]) -> DataFrame:
    """Hours from the report when positive, else the type default; efficiencies and loss by type."""
    pick = lambda i: S.lookup({k: float(v[i]) for k, v in defaults.items()}, "storage_type")
    reported = F.try_divide("energy_capacity_mwh", "p_nom_mw")
    return df.withColumns({
        "reported_max_hours": reported,
        "max_hours": F.coalesce(F.when(reported > 0, reported), pick(0)),
        "efficiency_store": pick(1), "efficiency_dispatch": pick(2), "standing_loss": pick(3),
    })


def unit_costs(units: DataFrame, costs: DataFrame, overrides: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """Cost columns of units by technology and fuel, with derived O&M, startup and marginal cost.

    units: technology, fuel_technology, efficiency_override, startup_cost_eur_per_mw, capacity_mw.
    costs: technology, parameter, value, row_id (file order).
    """
    names = ["investment", "FOM", "VOM", "efficiency", "lifetime", "fuel", "CO2 intensity"]
    pick = lambda n: F.min_by(F.when(F.col("parameter") == n, F.col("value")), F.when(F.col("parameter") == n, F.col("row_id"))).alias(n)
    wide = costs.groupBy("technology").agg(*[pick(n) for n in names])
    for n in names:
        new = {t: float(v[n]) for t, v in (overrides or {}).items() if n in v}
        if new:
            wide = wide.withColumn(n, F.coalesce(S.lookup(new, "technology"), F.col(n)))
    tech = wide.select(
        "technology", F.col("investment").alias("investment_eur_per_kw"), F.col("FOM").alias("fixed_om_percent_per_year"),
        F.col("VOM").alias("variable_om_eur_per_mwh"), F.col("efficiency").alias("__eff"), F.col("lifetime").alias("lifetime_years"),
    )
    fuel = wide.select(F.col("technology").alias("fuel_technology"), F.col("fuel").alias("fuel_eur_per_mwh_th"), F.col("CO2 intensity").alias("co2_t_per_mwh_th"))
    out = units.join(tech, "technology", "left").join(fuel, "fuel_technology", "left")
    eff = F.coalesce("efficiency_override", "__eff")
    fuel_cost = F.when(F.col("fuel_eur_per_mwh_th").isNotNull(), F.try_divide(F.col("fuel_eur_per_mwh_th"), eff)).otherwise(F.lit(0.0))
    return out.withColumns({
        "efficiency": eff,
        "fixed_om_eur_per_kw_year": F.col("investment_eur_per_kw") * F.col("fixed_om_percent_per_year") / 100,
        "startup_cost_eur": F.col("startup_cost_eur_per_mw") * F.col("capacity_mw"),
        "marginal_cost_eur_per_mwh": F.coalesce("variable_om_eur_per_mwh", F.lit(0.0)) + fuel_cost,
    }).drop("__eff")


def cluster_generators(units: DataFrame, max_committable: int) -> DataFrame:
    """Units of one node and type as a cluster: weighted means, maxima, all-flags; the largest clusters
    of a type may commit.
    """
    w = F.col("capacity_mw")
    mean = lambda c: F.try_divide(F.sum(c * w), F.sum(w))
    clusters = units.groupBy("node_uid", "generator_type").agg(
        F.sum(w).alias("p_nom_mw"), F.countDistinct("uid").alias("source_units"), F.bool_and("committable").alias("commitment_eligible"),
        F.sum("startup_cost_eur").alias("startup_cost_eur"), F.sum(F.col("shutdown_cost_eur_per_mw") * w).alias("shutdown_cost_eur"),
        F.max("minimum_up_time_h").alias("minimum_up_time_h"), F.max("minimum_down_time_h").alias("minimum_down_time_h"),
        mean(F.col("minimum_output_pu")).alias("minimum_output_pu"), mean(F.col("ramp_up_pu_per_hour")).alias("ramp_up_pu_per_hour"),
        mean(F.col("ramp_down_pu_per_hour")).alias("ramp_down_pu_per_hour"),
        mean(F.col("marginal_cost_eur_per_mwh")).alias("marginal_cost_eur_per_mwh"),
        mean(F.coalesce("efficiency", F.lit(1.0))).alias("efficiency"), mean(F.coalesce("co2_t_per_mwh_th", F.lit(0.0))).alias("co2_t_per_mwh_th"),
    )
    top = rank_within(clusters, ["generator_type"], "p_nom_mw", "node_uid", max_committable)
    return top.withColumn("committable", F.col("commitment_eligible") & F.col("in_top")).drop("in_top")


def rank_within(df: DataFrame, keys: list[str], value: str, tie: str, n: int) -> DataFrame:
    """Flag the n largest rows of each key; ties by the tie column.

    The n-th row is found by a two-stage top-n (per hash bucket, then per key), so a large key is not
    sorted as a whole.
    """
    from pyspark.sql.window import Window

    order = [F.col(value).desc(), F.col(tie)]
    bucket = F.pmod(F.xxhash64(*keys, tie), F.lit(64))
    local = df.select(*keys, value, tie).withColumn("__b", bucket)
    local = local.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(*order))).where(F.col("__r") <= n)
    top = local.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= n)
    return df.join(top.select(*keys, tie, F.lit(True).alias("in_top")), [*keys, tie], "left").withColumn("in_top", F.coalesce("in_top", F.lit(False)))


def readiness_failures(validation: DataFrame) -> DataFrame:
    """Rows that block a strict conversion."""
    gap = (F.col("check") == "backend_parameter_manifest") & F.coalesce("required", F.lit(False)) & ~F.col("status").isin("pass", "not_applicable")
    fail = F.col("check").isin("resource_profile_coverage", "load_profile_coverage", "time_alignment") & (F.col("status") == "fail")
    return validation.where(gap | fail)


def require_ready(validation: DataFrame, strict: bool) -> int:
    count = readiness_failures(validation).count()
    if count and strict:
        raise ValueError(f"{count} required fallbacks or failed checks; inspect the validation table.")
    return count


