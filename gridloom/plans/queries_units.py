"""Unit-commitment inputs, level cascade, multi-part lines and remapped cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import backend, case, network, payloads, reports
from .registry import query, rounded


@query(
    "load_shedding_units",
    """WITH c AS (SELECT bus_uid AS node_uid, class AS generator_type, sum(coalesce(capacity_mw, 0)) AS p_nom_mw, count(*) AS source_units FROM v_generator GROUP BY 1, 2),
            l AS (SELECT uid, max(p_set_mw) AS peak FROM v_load GROUP BY 1)
       SELECT node_uid, generator_type, round(p_nom_mw, 6) AS p_nom_mw, source_units, NULL AS marginal_cost_eur_per_mwh, NULL AS committable FROM c
       UNION ALL SELECT uid, 'load_shedding', round(peak * 1.05E0, 6), 0, 5000.0E0, false FROM l""",
)
def load_shedding_units(t):
    fleet = t.v_generator.groupBy(F.col("bus_uid").alias("node_uid"), F.col("class").alias("generator_type")).agg(
        F.sum(F.coalesce("capacity_mw", F.lit(0.0))).alias("p_nom_mw"), F.count("*").alias("source_units")
    )
    loads = t.v_load.groupBy(F.col("uid").alias("node_uid")).agg(F.max("p_set_mw").alias("peak_load_mw"))
    out = backend.append_load_shedding(fleet, loads, 5000.0)
    return rounded(out.select("node_uid", "generator_type", "p_nom_mw", "source_units", "marginal_cost_eur_per_mwh", "committable"))


@query(
    "numbered_branches",
    """WITH i AS (SELECT uid, concat('bus_', CASE WHEN n < 100000 THEN lpad(CAST(n AS VARCHAR), 5, '0') ELSE CAST(n AS VARCHAR) END) AS id FROM (SELECT uid, row_number() OVER (ORDER BY uid) - 1 AS n FROM v_node))
       SELECT e.uid, a.id AS bus0, b.id AS bus1 FROM v_edge e JOIN i a ON a.uid = e.from_bus_uid JOIN i b ON b.uid = e.to_bus_uid""",
)
def numbered_branches(t):
    ids = backend.dense_ids(t.v_node.select("uid"), "uid", "bus_")
    branches = t.v_edge.select("uid", F.col("from_bus_uid").alias("from_node"), F.col("to_bus_uid").alias("to_node"))
    return backend.number_endpoints(branches, ids, "uid").select("uid", "bus0", "bus1")


@query(
    "unit_parameters",
    """WITH p AS (SELECT concat('gen:', source_uid) AS uid, value, unit FROM v_parameter)
       SELECT g.uid, g.class, round(g.capacity_mw, 6) AS capacity_mw, round(p.value, 6) AS value, p.unit FROM v_generator g LEFT JOIN p ON p.uid = g.uid
       WHERE g.status IN ('operating', 'Operating') AND g.class <> 'nuclear' AND g.capacity_mw > 0""",
)
def unit_parameters(t):
    units = t.v_generator.withColumn("model_inclusion", F.col("class") != "nuclear")
    values = t.v_parameter.select(F.concat(F.lit("gen:"), "source_uid").alias("uid"), "value", "unit")
    out = reports.unit_parameters_joined(units, values, ["operating", "Operating"])
    return rounded(out.select("uid", "class", "capacity_mw", "value", "unit"))


LEVEL_SQL = """b AS (SELECT v_bus.uid, a.level AS spatial_level, CAST(substr(v_bus.uid, 5) AS BIGINT) AS k, concat('bus:', substr(v_bus.admin_uid, 8)) AS other FROM v_bus JOIN v_admin a ON a.admin_uid = v_bus.admin_uid),
    e AS (SELECT concat('x:', CAST(b.k AS VARCHAR(20))) AS uid, b.uid AS f, o.uid AS t, b.spatial_level AS fl, o.spatial_level AS tl, b.k FROM b JOIN b o ON o.uid = b.other)"""


@query(
    "network_levels",
    f"""WITH {LEVEL_SQL}
        SELECT 'bus' AS component, uid FROM b WHERE spatial_level = 'province'
        UNION ALL SELECT 'branch', uid FROM e WHERE fl = 'province' OR tl = 'province'
        UNION ALL SELECT CASE WHEN k % 3 = 0 THEN 'transformer' ELSE 'converter' END, uid FROM e WHERE k % 3 < 2 AND fl = 'province' AND tl = 'province'""",
)
def network_levels(t):
    """Cascade of a level filter: buses, branches with a piece in the level, equipment between kept buses."""
    admin = t.v_admin.select("admin_uid", F.col("level").alias("spatial_level"))
    bus = t.v_bus.join(admin, "admin_uid").select("uid", "spatial_level", F.concat(F.lit("bus:"), F.expr("substring(admin_uid, 8)")).alias("other"))
    k = F.expr("substring(uid, 5)").cast("long")
    ends = bus.select(F.concat(F.lit("x:"), k.cast("string")).alias("uid"), F.col("uid").alias("from_bus_uid"), F.col("other").alias("to_bus_uid"), k.alias("k"))
    ends = ends.join(bus.select(F.col("uid").alias("to_bus_uid")), "to_bus_uid", "left_semi").select("uid", "from_bus_uid", "to_bus_uid", "k")
    level = lambda end: ends.join(bus.select(F.col("uid").alias(end), "spatial_level"), end).select(F.col("uid").alias("branch_uid"), "spatial_level")
    net = {
        "bus": bus, "branch": ends, "branch_mapping": level("from_bus_uid").union(level("to_bus_uid")),
        "transformer": ends.where("k % 3 = 0"), "converter": ends.where("k % 3 = 1"),
    }
    kept = payloads.filter_network_levels(net, ["province"])
    out = None
    for name in ("bus", "branch", "transformer", "converter"):
        rows = kept[name].select(F.lit(name).alias("component"), "uid")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "line_part_terminals",
    """WITH p AS (SELECT concat('m:', CAST(c_custkey AS VARCHAR(20))) AS uid, CAST(c_custkey % 1000 AS DOUBLE) AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer),
            s AS (SELECT concat(uid, '#0') AS u, x AS ax, y AS ay, x + 1 AS cx, y AS cy FROM p UNION ALL SELECT concat(uid, '#1'), x + 2, y, x + 3, y + 1 FROM p)
       SELECT concat(u, ':start') AS uid, 'start' AS terminal_position, ax AS x, ay AS y FROM s UNION ALL SELECT concat(u, ':end'), 'end', cx, cy FROM s""",
)
def line_part_terminals(t):
    """Multi-part lines to segments, and segments to their ends."""
    x, y = (F.col("c_custkey") % 1000).cast("double"), F.col("c_nationkey").cast("double")
    parts = F.array(F.array(G.point(x, y), G.point(x + 1, y)), F.array(G.point(x + 2, y), G.point(x + 3, y + 1)))
    lines = t.customer.select(F.concat(F.lit("m:"), F.col("c_custkey").cast("string")).alias("uid"), parts.alias("parts"))
    segments = network.explode_parts(lines).select("segment_uid", "line")
    return network.segment_terminals(segments).select("uid", "terminal_position", "x", "y")


@query(
    "best_geometries",
    """WITH f AS (SELECT concat('src:', CAST(c_custkey % 97 AS VARCHAR(20))) AS uid, CASE c_custkey % 4 WHEN 0 THEN 'Point' WHEN 1 THEN 'MultiPoint' WHEN 2 THEN CASE WHEN c_custkey % 3 = 0 THEN 'Polygon' ELSE 'Point' END ELSE 'LineString' END AS kind FROM customer)
       SELECT uid, arg_min(kind, CASE kind WHEN 'MultiPolygon' THEN 0 WHEN 'Polygon' THEN 1 WHEN 'MultiPoint' THEN 2 WHEN 'Point' THEN 3 ELSE 9 END) AS geometry_kind FROM f GROUP BY 1""",
)
def best_geometries(t):
    k = F.col("c_custkey")
    kind = F.when(k % 4 == 0, "Point").when(k % 4 == 1, "MultiPoint").when(k % 4 == 3, "LineString").when(k % 3 == 0, "Polygon").otherwise("Point")
    return network.keep_best_geometry(t.customer.select(F.concat(F.lit("src:"), (k % 97).cast("string")).alias("uid"), kind.alias("geometry_kind")))


@query(
    "remapped_assets",
    """WITH o AS (SELECT g.uid, g.admin_uid, g.x, g.y, EXISTS (SELECT 1 FROM v_bus b WHERE b.admin_uid = g.admin_uid AND b.subclass = 'station_bus') AS own FROM v_generator g),
            d AS (SELECT o.uid, b.uid AS bus_uid, o.admin_uid = b.admin_uid AS same, sqrt((o.x - b.x) * (o.x - b.x) + (o.y - b.y) * (o.y - b.y)) AS d, b.voltage_kv FROM o JOIN v_bus b ON b.subclass = 'station_bus' AND (NOT o.own OR b.admin_uid = o.admin_uid)),
            m AS (SELECT *, min(d) OVER (PARTITION BY uid) AS best FROM d)
       SELECT uid, arg_min(bus_uid, struct_pack(v := -voltage_kv, u := bus_uid)) AS bus_uid, round(min(d) / 1000, 6) AS bus_distance_km, arg_min(same, struct_pack(v := -voltage_kv, u := bus_uid)) AS bus_same_admin FROM m WHERE d <= best GROUP BY 1""",
)
def remapped_assets(t):
    """Assets that had other buses, assigned anew to the buses that a case retains."""
    assets = t.v_generator.withColumn("bus_distance_km", F.lit(1.0))
    out = case.remap_assets(assets, t.v_bus.where("subclass = 'station_bus'"))
    return rounded(out.select("uid", "bus_uid", "bus_distance_km", "bus_same_admin"))
