"""Case components and the validation report of a case."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregate import identity_membership
from .backend import RESOURCE_CLASS, VARIABLE_CLASSES
from .graph import connectivity
from .manifest import coverage_report
from .mapping import attach_buses, objects_to_buses
from .skew import beside

CHECK_COLUMNS = ("check", "component", "name", "status", "value", "detail")


@dataclass(frozen=True)
class CaseComponent:
    data: DataFrame
    parameter: DataFrame
    membership: DataFrame


@dataclass(frozen=True)
class PowerSystemCase:
    network: Mapping[str, CaseComponent]
    branch_mapping: DataFrame | None
    generator: CaseComponent
    storage: CaseComponent
    load: DataFrame
    resource: DataFrame
    spatial: DataFrame
    population: DataFrame
    validation: DataFrame
    config: Mapping[str, object] = field(default_factory=dict)

    def network_parameters(self) -> DataFrame:
        """Parameters of all four network components in one table."""
        out = None
        for c in self.network.values():
            out = c.parameter if out is None else out.unionByName(c.parameter, allowMissingColumns=True)
        return out


def component(data: DataFrame, parameter: DataFrame) -> CaseComponent:
    return CaseComponent(data, parameter, identity_membership(data))


def remap_assets(data: DataFrame, buses: DataFrame, **options) -> DataFrame:
    """Assign assets anew to the retained buses."""
    return attach_buses(data, objects_to_buses(data, buses, **options))


def remap_load(cells: DataFrame, buses: DataFrame, **options) -> DataFrame:
    """Bus of every load cell (centre points); returns the dimension of the load series."""
    points = cells.select(F.col("spatial_uid").alias("uid"), "spatial_uid", "admin_uid", "x", "y")
    return attach_buses(points, objects_to_buses(points, buses, **options))


def _row(df: DataFrame, check: str, comp: str, name: str, status: Column, value: Column, detail: Column) -> DataFrame:
    return df.select(
        F.lit(check).alias("check"), F.lit(comp).alias("component"), F.lit(name).alias("name"), status.alias("status"),
        value.cast("double").alias("value"), detail.alias("detail"),
    )


def _pass(ok: Column) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), "pass").otherwise("fail")


def network_check(bus: DataFrame, branch: DataFrame, transformer: DataFrame, converter: DataFrame) -> DataFrame:
    links = None
    for t in (branch, transformer, converter):
        pair = t.select("from_bus_uid", "to_bus_uid")
        links = pair if links is None else links.union(pair)
    c = connectivity(bus, links)
    return _row(c, "network_connectivity", "network", "largest_connected_graph", F.col("status"), F.col("components"),
                F.format_string("%d buses and %d connections", "buses", "connections"))


def time_check(load: DataFrame, resource: DataFrame) -> DataFrame:
    a = load.select("time").distinct().join(resource.select("time", F.lit(True).alias("hit")).distinct(), "time", "left")
    one = beside(
        a.agg(F.count("*").alias("n"), F.count_if(F.col("hit").isNull()).alias("missing")),
        resource.agg(F.countDistinct("time").alias("r")),
    )
    return _row(one, "time_alignment", "timeseries", "common_timestamps", _pass(F.col("missing") == 0), F.col("n"),
                F.format_string("%d load timestamps are covered by the %d-timestamp resource series", "n", "r"))


def aggregation_check(generator: DataFrame) -> DataFrame:
    note = "Class/subclass aggregation supports continuous dispatch, planning and clustered commitment, not exact unit-level commitment."
    return _row(generator.agg(F.count("*").alias("n")), "aggregation_limit", "generator", "clustered_unit_commitment",
                F.lit("warning"), F.col("n"), F.lit(note))


def resource_check(
    generator: DataFrame, members: DataFrame, resource: DataFrame, class_map: Mapping[str, str] = RESOURCE_CLASS,
    variable: Iterable[str] = VARIABLE_CLASSES,
) -> DataFrame:
    """Share of variable generators with a mapped profile; 1 when there are none."""
    from ..functions import scalars as S

    wanted = generator.where(F.col("class").isin(*variable)).select(
        F.col("uid").alias("aggregate_uid"), S.lookup(class_map, "subclass").alias("class")
    )
    classes = resource.select("class").distinct()
    cells = resource.select(F.col("uid").alias("source_spatial_uid")).distinct()
    served = (
        members.select("aggregate_uid", "source_spatial_uid").join(cells, "source_spatial_uid", "left_semi").select("aggregate_uid").distinct()
    )
    hit = wanted.join(classes, "class", "left_semi").join(served, "aggregate_uid", "left_semi")
    one = beside(wanted.agg(F.count("*").alias("n")), hit.agg(F.count("*").alias("c")))
    return _row(one, "resource_profile_coverage", "generator", "availability_pu", _pass(F.col("c") == F.col("n")),
                F.coalesce(F.try_divide("c", "n"), F.lit(1.0)), F.format_string("%d/%d variable generators have a mapped profile", "c", "n"))


def _near(a: Column, b: Column, rtol: float, atol: float) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def load_checks(load: DataFrame, cell_load: DataFrame, buses: DataFrame, population: DataFrame) -> DataFrame:
    """Five checks of nodal load: mapping, values, profiles, conservation, zero-population cells.

    load, cell_load: time, uid, class, demand_mw. population: spatial_uid, population.
    """
    v = F.col("demand_mw")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))

    def per_uid(df: DataFrame, p: str) -> DataFrame:
        u = df.groupBy("uid").agg(
            F.count("*").alias("rows"), F.count_if(ok).alias("good"), F.count_if(ok & (F.abs(v) <= 1e-8)).alias("zero"),
            F.count_if(v.isNull() | F.isnan(v)).alias("nan"),
        )
        all_nan, all_zero = F.col("nan") == F.col("rows"), F.col("zero") == F.col("rows")
        return u.agg(
            F.count("*").alias(f"{p}_uids"), F.sum("rows").alias(f"{p}_rows"), F.sum(F.col("rows") - F.col("good")).alias(f"{p}_bad"),
            F.count_if(all_nan).alias(f"{p}_nan"), F.count_if(all_zero).alias(f"{p}_zero"), F.count_if(~all_nan & ~all_zero).alias(f"{p}_fine"),
        )

    missing = load.select("uid").distinct().join(buses.select("uid"), "uid", "left_anti").agg(F.count("*").alias("lost"))
    total = lambda df, n: df.groupBy("time", "class").agg(F.when(F.count_if(~ok) == 0, F.sum(v)).alias(n))
    both = total(cell_load, "a").join(total(load, "b"), ["time", "class"], "full")
    gap = both.agg(
        F.bool_and(F.coalesce(_near(F.col("a"), F.col("b"), 1e-6, 1e-6), F.lit(False))).alias("conserved"),
        F.bool_and(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("whole"), F.max(F.abs(F.col("a") - F.col("b"))).alias("gap"),
    )
    zero_cells = population.where("population = 0").select(F.col("spatial_uid").alias("uid"))
    z = cell_load.join(zero_cells, "uid", "left_semi")
    empty = beside(
        z.agg(F.countDistinct("uid").alias("zero_cells"), F.count_if(~(ok & (F.abs(v) <= 1e-9))).alias("violations"))
    )
    one = beside(missing, per_uid(load, "bus"), per_uid(cell_load, "cell"), gap, empty)
    check = "load_profile_coverage"
    profile = F.when((F.col("cell_nan") > 0) | (F.col("bus_nan") > 0), "fail").when(F.col("bus_zero") > 0, "warning").otherwise("pass")
    rows = [
        _row(one, check, "load", "electrical_bus_mapping", _pass(F.col("lost") == 0),
             F.coalesce(F.try_divide(F.col("bus_uids") - F.col("lost"), F.col("bus_uids")), F.lit(1.0)),
             F.format_string("%d load UIDs do not reference retained buses", "lost")),
        _row(one, check, "load", "finite_values", _pass((F.col("bus_bad") == 0) & (F.col("cell_bad") == 0)),
             F.coalesce(F.try_divide(F.col("cell_rows") - F.col("cell_bad"), F.col("cell_rows")), F.lit(1.0)),
             F.format_string("cell_nonfinite=%d; bus_nonfinite=%d", "cell_bad", "bus_bad")),
        _row(one, check, "load", "profile_quality", profile, F.coalesce(F.try_divide("bus_fine", "bus_uids"), F.lit(1.0)),
             F.format_string("cell_all_nan=%d; bus_all_nan=%d; bus_all_zero=%d", "cell_nan", "bus_nan", "bus_zero")),
        _row(one, check, "load", "aggregate_conservation", _pass(F.col("conserved") & F.col("whole")),
             F.when(F.col("whole"), F.col("gap")), F.lit("Maximum absolute source-to-bus load error in MW")),
        _row(one, check, "load", "zero_auxiliary_load",
             F.when(F.col("zero_cells") == 0, "not_applicable").otherwise(_pass(F.col("violations") == 0)), F.col("violations"),
             F.format_string("%d zero-population cells; %d nonzero or non-finite values", "zero_cells", "violations")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def validate_case(
    network: Mapping[str, DataFrame], generator: DataFrame, storage: DataFrame, load: DataFrame, cell_load: DataFrame,
    population: DataFrame, resource: DataFrame, parameters: Mapping[str, DataFrame], generator_members: DataFrame,
    class_map: Mapping[str, str] = RESOURCE_CLASS,
) -> DataFrame:
    """All checks of a case as one table."""
    assets = {**network, "generator": generator, "storage": storage}
    parts = [
        network_check(network["bus"], network["branch"], network["transformer"], network["converter"]),
        time_check(load, resource), aggregation_check(generator), coverage_report(assets, parameters),
        resource_check(generator, generator_members, resource, class_map),
        load_checks(load, cell_load, network["bus"], population),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
