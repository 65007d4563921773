"""Map and chart layers as tables and JSON rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scalars as S
from .skew import beside, exact_percentiles

NODE_TYPES = {"junction_bus": "junction", "station_bus": "station"}
MARINE = "marine_zone"


def population_layer(df: DataFrame) -> DataFrame:
    raw = F.greatest(F.coalesce(S.number("population"), F.lit(0.0)), F.lit(0.0))
    return df.withColumn("raw_value", raw).withColumn("value", S.log_display("population"))


def capacity_reference(df: DataFrame, value: str) -> DataFrame:
    """One row: 99th percentile of the values, at least 1."""
    p = exact_percentiles(df, [], value, {"p99": 0.99})
    return p.select(F.greatest(F.coalesce("p99", F.lit(1.0)), F.lit(1.0)).alias("capacity_reference"))


def asset_points(df: DataFrame, capacity: str) -> DataFrame:
    """Assets with a place and capacity, with marker size against the reference capacity."""
    kept = df.withColumn("capacity", S.number(capacity)).where("x IS NOT NULL AND y IS NOT NULL AND capacity > 0")
    ref = capacity_reference(kept, "capacity").first()
    reference = float(ref[0]) if ref else 1.0
    ratio = F.least(F.greatest(F.col("capacity") / reference, F.lit(0.0)), F.lit(1.0))
    return kept.withColumn("class", F.coalesce("class", F.lit("other"))).withColumn("marker_size", 2 + 24 * F.sqrt(ratio))


def class_order(df: DataFrame) -> DataFrame:
    """Classes by number of assets, then name."""
    return df.groupBy(F.coalesce("class", F.lit("other")).alias("class")).agg(F.count("*").alias("assets"))


def asset_pies(df: DataFrame, key: str, capacity: str) -> DataFrame:
    """Capacity per place and class with the place total; classes without capacity are left out of the map.

    The breakdown map has one entry per class of a place, which is a short list.
    """
    per = df.where(F.col(key).isNotNull()).groupBy(key, F.coalesce("class", F.lit("other")).alias("class")).agg(
        F.sum(F.coalesce(S.number(capacity), F.lit(0.0))).alias("capacity")
    )
    entries = F.filter(F.collect_list(F.struct("class", "capacity")), lambda e: e["capacity"] > 0)
    return per.groupBy(key).agg(F.sum("capacity").alias("total_mw"), F.map_from_entries(F.array_sort(entries)).alias("breakdown"))


def styled_branches(branch: DataFrame) -> DataFrame:
    kv = F.col("voltage_kv")
    if dict(branch.dtypes)["voltage_kv"].startswith("array"):
        kv = S.max_voltage("voltage_kv")
    return branch.withColumn("style", S.branch_style(kv, "current_type"))


def style_order(styles: DataFrame) -> DataFrame:
    """Styles by voltage, unknown last."""
    first = F.split("style", " ")[0].try_cast("double")
    return styles.orderBy(first.asc_nulls_last(), "style")


def typed_buses(bus: DataFrame) -> DataFrame:
    return bus.where(F.col("subclass").isin(*NODE_TYPES)).withColumn("node_type", S.lookup(NODE_TYPES, "subclass"))


def annual_map(series: DataFrame, year: int, value: str, quantity: str, step_hours: float = 1.0) -> DataFrame:
    """Value per uid and class of one year: load energy in TWh, other series as mean."""
    data = series.where(F.year("time") == year)
    if data.isEmpty():
        raise ValueError(f"No {year} data are available.")
    agg = F.sum(value) * step_hours / 1e6 if quantity == "load" else F.avg(value)
    return data.groupBy("uid", "class").agg(agg.alias("value"))


def dispatch_layer(by_class: DataFrame) -> DataFrame:
    """Series rows (id, kind, time, value) of a dispatch; all-zero series drop out."""
    kinds = {"generation_mw": "generation", "storage_discharge_mw": "storage_discharge", "storage_charge_mw": "storage_charge"}
    long = by_class.unpivot(["time", "class"], list(kinds), "m", "value").select(
        F.col("class").alias("id"), S.lookup(kinds, "m").alias("kind"), "time", "value"
    )
    used = long.groupBy("id", "kind").agg(F.sum(F.abs("value")).alias("s")).where("s > 0").drop("s")
    return long.join(used, ["id", "kind"], "left_semi")


def series_arrays(layer: DataFrame) -> DataFrame:
    """One row per series with its values in time order (a chart's own size)."""
    ordered = F.array_sort(F.collect_list(F.struct("time", "value")))
    return layer.groupBy("id", "kind").agg(F.transform(ordered, lambda e: e["value"]).alias("values"))


def feature_json(df: DataFrame, columns: Iterable[str], geometry: Column, names: Mapping[str, str] | None = None) -> DataFrame:
    """One GeoJSON feature text per row; rows without geometry are left out, NaN becomes null."""
    names = names or {}
    types = dict(df.dtypes)
    clean = lambda c: S.null_if_nan(c) if types[c] in ("double", "float") else F.col(c)
    props = F.struct(*[clean(c).alias(names.get(c, c)) for c in columns if c in df.columns])
    text = F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), props.alias("properties")), {"ignoreNullFields": "false"})
    return df.where(geometry.isNotNull()).select(text.alias("feature"))


def point_geometry(x: str = "x", y: str = "y") -> Column:
    return F.when(
        F.col(x).isNotNull() & F.col(y).isNotNull(), F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
    )


def line_geometry(line: str) -> Column:
    return F.when(
        F.size(line) > 0, F.struct(F.lit("LineString").alias("type"), F.transform(line, lambda p: F.array(p["x"], p["y"])).alias("coordinates"))
    )


def polygon_geometry(ring: str) -> Column:
    closed = F.concat(F.col(ring), F.slice(ring, 1, 1))
    return F.when(
        F.size(ring) > 2,
        F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(closed, lambda p: F.array(p["x"], p["y"]))).alias("coordinates")),
    )


def layer_summary(df: DataFrame, value: str | None = None, how: str = "sum") -> DataFrame:
    """Count and value of a layer."""
    v = F.lit(None).cast("double") if value is None else (F.sum(value) if how == "sum" else F.avg(value))
    return df.agg(F.count("*").alias("count"), v.alias("value"))


def network_summary(bus: DataFrame, branch: DataFrame) -> DataFrame:
    return beside(bus.agg(F.count("*").alias("count")), branch.agg(F.count("*").alias("secondary_count")))


def category_list(df: DataFrame, column: str, colors: Mapping[str, str], fallback: str = "#909691") -> DataFrame:
    color = F.coalesce(S.lookup(dict(colors), "id"), F.lit(fallback)) if colors else F.lit(fallback)
    return df.select(F.col(column).alias("id")).distinct().withColumn("color", color)


def boundary_layer(units: DataFrame, tolerance: float) -> DataFrame:
    """Province rings, or every non-marine ring without provinces, simplified for display."""
    provinces = units.where("level = 'province'")
    chosen = units.where(F.col("level") != MARINE) if provinces.isEmpty() else provinces
    return chosen.withColumn("ring", G.simplify("ring", tolerance, closed=True))


def filter_levels(df: DataFrame, levels: Iterable[str], column: str = "spatial_level") -> DataFrame:
    return df.where(F.col(column).isin(list(levels)))


def require_levels(units: DataFrame, levels: Iterable[str]) -> DataFrame:
    """Units of the asked levels; unknown or repeated levels are errors."""
    from .cells import select_units

    return select_units(units, list(levels))


def filter_network_levels(net: Mapping[str, DataFrame], levels: Iterable[str]) -> dict[str, DataFrame]:
    """Buses and branch pieces of the levels, their branches, and equipment between kept buses."""
    bus = filter_levels(net["bus"], levels)
    pieces = filter_levels(net["branch_mapping"], levels)
    out = {"bus": bus, "branch_mapping": pieces}
    out["branch"] = net["branch"].join(pieces.select(F.col("branch_uid").alias("uid")).distinct(), "uid", "left_semi")
    ids = bus.select("uid")
    for name in ("transformer", "converter"):
        t = net[name]
        for end in ("from_bus_uid", "to_bus_uid"):
            t = t.join(ids.withColumnRenamed("uid", end), end, "left_semi")
        out[name] = t.select(net[name].columns)
    return out


def filter_extent(points: DataFrame, boxes: DataFrame, tile: float) -> DataFrame:
    """Objects (uid, x, y) inside any of the boxes."""
    from .tiling import points_in_boxes

    hit = points_in_boxes(points.select("uid", "x", "y"), boxes.select("x0", "y0", "x1", "y1"), tile)
    return points.join(hit.select("uid").distinct(), "uid", "left_semi")


def _segment_boxes(segments: DataFrame, p: str) -> DataFrame:
    return segments.select(
        *[F.col(c).alias(f"{p}_{c}") for c in segments.columns], F.least("ax", "bx").alias(f"{p}_x0"), F.least("ay", "by").alias(f"{p}_y0"),
        F.greatest("ax", "bx").alias(f"{p}_x1"), F.greatest("ay", "by").alias(f"{p}_y1"),
    )


def _segments_meet():
    """Whether segments l and r have a common point; their boxes are known to meet."""
    c = lambda p, k: F.col(f"{p}_{k}")
    side = lambda p, q, e: (c(p, "bx") - c(p, "ax")) * (c(q, e + "y") - c(p, "ay")) - (c(p, "by") - c(p, "ay")) * (c(q, e + "x") - c(p, "ax"))
    apart = lambda p, q: F.signum(side(p, q, "a")) * F.signum(side(p, q, "b")) > 0
    return ~apart("l", "r") & ~apart("r", "l")


def filter_shapes(shapes: DataFrame, areas: DataFrame) -> DataFrame:
    """Lines and areas (uid, path, closed) that meet any of the areas (ring, sign).

    A shape meets an area where one of its segments meets a border, or where it lies inside, or around it
    as a closed one; the last two are told from one vertex. Holes count as outside.
    """
    from ..functions import geometry as G
    from .tiling import ring_segments, segments_of, size_class_pairs

    ringed = areas.withColumn("ring_id", F.monotonically_increasing_id())
    path = F.when(F.col("closed"), F.concat("path", F.slice("path", 1, 1))).otherwise(F.col("path"))
    own = segments_of(shapes.select("uid", path.alias("line")), "uid", "line").drop("piece")
    borders = ring_segments(ringed, "ring_id").drop("piece", "ring_id")
    crossing = size_class_pairs(_segment_boxes(own, "l"), _segment_boxes(borders, "r")).where(_segments_meet()).select(F.col("l_uid").alias("uid"))

    def holding(points: DataFrame, rings: DataFrame) -> DataFrame:
        """Points (id, x, y) inside polygons (key, ring, sign): id, key."""
        l = points.select("id", F.col("x").alias("l_x0"), F.col("y").alias("l_y0"), F.col("x").alias("l_x1"), F.col("y").alias("l_y1"))
        r = rings.select("key", "ring", "sign", *G.bbox("ring", "r_"))
        hit = F.when(G.point_in_ring("l_x0", "l_y0", "ring"), F.col("sign")).otherwise(0)
        return size_class_pairs(l, r).groupBy("id", "key").agg(F.sum(hit).alias("h")).where("h > 0").select("id", "key")

    first = lambda c: F.get(F.col(c), 0)
    inside = holding(shapes.select(F.col("uid").alias("id"), first("path")["x"].alias("x"), first("path")["y"].alias("y")), ringed.select(F.lit(0).alias("key"), "ring", "sign"))
    outer = ringed.where("sign > 0").select(F.col("ring_id").alias("id"), first("ring")["x"].alias("x"), first("ring")["y"].alias("y"))
    around = holding(outer, shapes.where("closed").select(F.col("uid").alias("key"), F.col("path").alias("ring"), F.lit(1).alias("sign")))
    met = crossing.union(inside.select(F.col("id").alias("uid"))).union(around.select(F.col("key").alias("uid"))).distinct()
    return shapes.join(met, "uid", "left_semi")


def axis_step(df: DataFrame, axis: str, default: float = 0.25) -> DataFrame:
    """Median positive step between the distinct coordinates of an axis, as one row.

    Coordinates of a grid axis are a dimension: they are deduplicated first and ordered in ranges.
    """
    from .skew import with_next_value

    values = df.select((F.round(axis, 8) * 1e8).cast("long").alias("p")).where("p IS NOT NULL").distinct()
    gaps = with_next_value(values, "p", "n").where("n IS NOT NULL").select(((F.col("n") - F.col("p")) / 1e8).alias("d")).where("d > 1e-8")
    return exact_percentiles(gaps, [], "d", {"step": 0.5}).select(F.coalesce("step", F.lit(default)).alias("step"))


def parameter_matrix(params: DataFrame, names: Iterable[str]) -> DataFrame:
    """Class by parameter name counts, 0 where there is none."""
    return params.groupBy("class").pivot("name", list(names)).count().fillna(0)


def load_with_bus_points(load: DataFrame, bus: DataFrame) -> DataFrame:
    """Nodal load with the place of its bus; a bus without place is an error."""
    from .skew import require_none

    out = load.join(bus.select("uid", "x", "y"), "uid", "left")
    require_none(out.where("x IS NULL OR y IS NULL").select("uid").distinct(), "Load references buses without geometry")
    return out
