"""Graph and network-building queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scalars as S
from ..operators import aggregate, graph, mapping, network
from ..operators.skew import by_shuffle
from ..session import cut_lineage, stored
from .registry import query, rounded

# Root of every node by following its single link upward; the label is the smallest uid of the tree.
ROOTS = """up(uid, cur) AS (SELECT from_bus_uid, to_bus_uid FROM v_edge UNION SELECT u.uid, e.to_bus_uid FROM up u JOIN v_edge e ON e.from_bus_uid = u.cur WHERE e.from_bus_uid <> e.to_bus_uid),
 root AS (SELECT u.uid, u.cur AS r FROM up u JOIN v_edge e ON e.from_bus_uid = u.cur AND e.to_bus_uid = e.from_bus_uid),
 comp AS (SELECT uid AS node, min(uid) OVER (PARTITION BY r) AS component, count(*) OVER (PARTITION BY r) AS n FROM root)"""


@query("usable_edges", "SELECT uid, from_bus_uid, to_bus_uid FROM v_edge WHERE from_bus_uid <> to_bus_uid")
def usable_edges(t):
    return graph.usable_edges(t.v_edge, t.v_node).select("uid", "from_bus_uid", "to_bus_uid")


@query("component_labels", f"WITH RECURSIVE {ROOTS} SELECT node, component FROM comp WHERE n > 1")
def component_labels(t):
    return graph.connected_components(t.v_edge, "from_bus_uid", "to_bus_uid")


@query("component_sizes", f"WITH RECURSIVE {ROOTS} SELECT component, count(*) AS nodes FROM comp WHERE n > 1 GROUP BY 1")
def component_sizes(t):
    return graph.component_sizes(graph.connected_components(t.v_edge, "from_bus_uid", "to_bus_uid"))


@query(
    "largest_component",
    f"WITH RECURSIVE {ROOTS}, best AS (SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1) SELECT node FROM comp WHERE component IN (SELECT component FROM best)",
)
def largest_component(t):
    return graph.largest_component(graph.connected_components(t.v_edge, "from_bus_uid", "to_bus_uid"))


@query(
    "largest_network",
    f"""WITH RECURSIVE {ROOTS}, best AS (SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1), keep AS (SELECT node FROM comp WHERE component IN (SELECT component FROM best))
        SELECT 'bus' AS part, uid, true AS in_largest_connected_graph FROM v_node WHERE uid IN (SELECT node FROM keep)
        UNION ALL SELECT CASE WHEN CAST(substr(uid, 3) AS BIGINT) % 3 = 0 THEN 'transformer' WHEN CAST(substr(uid, 3) AS BIGINT) % 3 = 1 THEN 'branch' ELSE 'converter' END, uid, true FROM v_edge WHERE from_bus_uid <> to_bus_uid AND from_bus_uid IN (SELECT node FROM keep)""",
)
def largest_network(t):
    k = F.substring("uid", 3, 20).cast("long") % 3
    e = t.v_edge
    net = graph.largest_connected_network(t.v_node, e.where(k == 1), e.where(k == 0), e.where(k == 2))
    out = None
    for name, df in net.items():
        one = df.select(F.lit(name).alias("part"), "uid", "in_largest_connected_graph")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "connectivity",
    f"""WITH RECURSIVE {ROOTS} SELECT (SELECT count(*) FROM v_node) AS buses, (SELECT count(DISTINCT component) FROM comp) AS components, (SELECT count(*) FROM v_edge WHERE from_bus_uid <> to_bus_uid) AS connections, 'fail' AS status""",
)
def connectivity(t):
    return graph.connectivity(t.v_node, graph.usable_edges(t.v_edge, t.v_node))


@query(
    "component_classes",
    f"""WITH RECURSIVE {ROOTS}, c AS (SELECT component, count(*) AS nodes FROM comp GROUP BY 1)
        SELECT CASE WHEN nodes = 1 THEN 'isolated_node' WHEN nodes = 2 THEN 'single_edge' ELSE 'multi_edge' END AS component_class, count(*) AS components, CAST(sum(nodes) AS BIGINT) AS nodes, CAST(sum(nodes - 1) AS BIGINT) AS edges FROM c GROUP BY 1""",
)
def component_classes(t):
    return graph.component_classes(t.v_node, graph.usable_edges(t.v_edge, t.v_node), "from_bus_uid", "to_bus_uid")


@query(
    "node_degrees",
    "WITH e AS (SELECT from_bus_uid AS uid FROM v_edge UNION ALL SELECT to_bus_uid FROM v_edge) SELECT n.uid, count(e.uid) AS degree FROM v_node n LEFT JOIN e ON e.uid = n.uid GROUP BY 1",
)
def node_degrees(t):
    return graph.degrees(t.v_node.select("uid"), t.v_edge)


@query(
    "filter_network",
    """WITH RECURSIVE bus AS (SELECT uid FROM v_node WHERE (lower(status) = 'operating' OR status IS NULL) AND voltage_kv BETWEEN 110 AND 500),
            e AS (SELECT uid, from_bus_uid AS a, to_bus_uid AS b FROM v_edge WHERE (status = 'operating' OR status IS NULL) AND from_bus_uid <> to_bus_uid AND from_bus_uid IN (SELECT uid FROM bus) AND to_bus_uid IN (SELECT uid FROM bus)),
            both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), reach(x, y) AS (SELECT a, a FROM both_ UNION SELECT r.x, k.b FROM reach r JOIN both_ k ON k.a = r.y),
            comp AS (SELECT x, min(y) AS c FROM reach GROUP BY 1), best AS (SELECT c FROM comp GROUP BY 1 ORDER BY count(*) DESC, c LIMIT 1)
       SELECT 'bus' AS part, x AS uid FROM comp WHERE c IN (SELECT c FROM best) UNION ALL SELECT 'branch', uid FROM e WHERE a IN (SELECT x FROM comp WHERE c IN (SELECT c FROM best))""",
)
def filter_network(t):
    none = t.v_edge.limit(0)
    options = {
        "minimum_voltage_kv": 110, "maximum_voltage_kv": 500, "missing_status_is_active": True, "bus_statuses": ["operating"],
        "branch_statuses": ["Operating"], "transformer_statuses": [], "converter_statuses": [],
    }
    net = network.filter_network({"bus": t.v_node, "branch": t.v_edge, "transformer": none, "converter": none}, options)
    return net["bus"].select(F.lit("bus").alias("part"), "uid").unionByName(net["branch"].select(F.lit("branch").alias("part"), "uid"))


@query(
    "station_paths",
    """WITH RECURSIVE both_ AS (SELECT from_bus_uid AS a, to_bus_uid AS b, length_km AS w FROM v_edge WHERE from_bus_uid <> to_bus_uid UNION ALL SELECT to_bus_uid, from_bus_uid, length_km FROM v_edge WHERE from_bus_uid <> to_bus_uid),
            walk(node, prev, total, hops) AS (SELECT 'n:20', '', 0.0E0, 0 UNION ALL SELECT k.b, w.node, w.total + k.w, w.hops + 1 FROM walk w JOIN both_ k ON k.a = w.node AND k.b <> w.prev)
       SELECT node, round(total, 6) AS total, hops FROM walk""",
)
def station_paths(t):
    # v_edge is a forest, so every path is unique and plain SQL can state it
    edges = t.v_edge.where("from_bus_uid <> to_bus_uid").select("uid", F.col("from_bus_uid").alias("a"), F.col("to_bus_uid").alias("b"), F.col("length_km").alias("length"))
    return rounded(graph.path_lengths(edges, "n:20").select("node", "total", (F.size("nodes") - 1).alias("hops")))


# --- voltages and circuits ----------------------------------------------------------------------
@query(
    "source_voltages",
    """SELECT uid, CASE voltage WHEN '220000;110000' THEN '220;110' WHEN '500000' THEN '500' WHEN '110000;110000;220000' THEN '110;220' WHEN '220 kV, 330000' THEN '330' ELSE '' END AS levels,
              CASE WHEN voltage IS NULL THEN 'unresolved' WHEN voltage = '220 kV, 330000' THEN 'source_tag_normalized' ELSE 'source_tag' END AS voltage_method FROM v_line""",
)
def source_voltages(t):
    d = network.source_voltages(t.v_line)
    return d.select("uid", F.array_join(F.transform("voltage_values", lambda v: S.general_label(v)), ";").alias("levels"), "voltage_method")


@query(
    "line_systems",
    """WITH b AS (SELECT uid, frequency, circuits, cables, CASE WHEN frequency = '0' THEN 2.0E0 ELSE 3.0E0 END AS per,
              CASE voltage WHEN '220000;110000' THEN [220.0E0, 110.0E0] WHEN '500000' THEN [500.0E0] WHEN '110000;110000;220000' THEN [110.0E0, 220.0E0] WHEN '220 kV, 330000' THEN [330.0E0] ELSE [] END AS lv,
              CASE voltage WHEN '220000;110000' THEN 2 WHEN '110000;110000;220000' THEN 3 WHEN '500000' THEN 1 ELSE 0 END AS nraw FROM v_line),
            e AS (SELECT *, unnest(lv) AS voltage_kv, generate_subscripts(lv, 1) AS i, len(lv) AS n FROM b),
            c AS (SELECT *, CASE WHEN n = 1 THEN CASE circuits WHEN '2;1' THEN 3.0E0 WHEN '3' THEN 3.0E0 WHEN '4' THEN 4.0E0 ELSE CASE cables WHEN '3;3' THEN 6 / per WHEN '6;3;6' THEN 15 / per WHEN '7' THEN 7 / per ELSE 1.0E0 END END
                    ELSE CASE WHEN circuits = '2;1' THEN CASE WHEN i = 1 THEN 2.0E0 ELSE 1.0E0 END
                              WHEN circuits = '3' AND nraw = 3 THEN CASE WHEN i = 1 THEN 2.0E0 ELSE 1.0E0 END
                              WHEN circuits IN ('3') THEN CASE WHEN i = 1 THEN 2.0E0 ELSE 1.0E0 END
                              WHEN circuits = '4' THEN 2.0E0
                              WHEN cables = '3;3' THEN 3 / per WHEN cables = '6;3;6' AND nraw = 3 THEN CASE WHEN i = 1 THEN 9 / per ELSE 6 / per END ELSE 1.0E0 END END AS cc,
                    CASE WHEN n = 1 THEN CASE WHEN circuits IN ('2;1', '3', '4') THEN 'source_total' WHEN cables IS NOT NULL THEN 'inferred_from_cables' ELSE 'inferred_default_per_voltage' END
                    ELSE CASE WHEN circuits = '2;1' THEN 'position_aligned' WHEN circuits = '3' AND nraw = 3 THEN 'voltage_sequence' WHEN circuits IN ('3', '4') THEN 'inferred_balanced_front_remainder'
                              WHEN cables = '3;3' OR (cables = '6;3;6' AND nraw = 3) THEN 'inferred_from_cables' ELSE 'inferred_default_per_voltage' END END AS circuit_method FROM e)
       SELECT uid, voltage_kv, round(cc, 6) AS circuits, circuit_method,
              round(CASE WHEN n = 1 THEN CASE cables WHEN '3;3' THEN 6.0E0 WHEN '6;3;6' THEN 15.0E0 WHEN '7' THEN 7.0E0 ELSE cc * per END
                   WHEN cables = '3;3' THEN 3.0E0 WHEN cables = '6;3;6' AND nraw = 3 THEN CASE WHEN i = 1 THEN 9.0E0 ELSE 6.0E0 END
                   WHEN cables = '6;3;6' THEN CASE WHEN i = 1 THEN 8.0E0 ELSE 7.0E0 END WHEN cables = '7' THEN CASE WHEN i = 1 THEN 4.0E0 ELSE 3.0E0 END ELSE cc * per END, 6) AS cables,
              CASE WHEN n = 1 THEN CASE WHEN cables IS NOT NULL THEN 'source_total' ELSE 'inferred_from_circuits' END
                   WHEN cables = '3;3' OR (cables = '6;3;6' AND nraw = 3) THEN 'position_aligned' WHEN cables IS NOT NULL THEN 'inferred_balanced_front_remainder' ELSE 'inferred_from_circuits' END AS cable_method
       FROM c""",
)
def line_systems(t):
    d = network.source_voltages(t.v_line).where(F.size("voltage_values") > 0)
    return rounded(network.line_systems(d).select("uid", "voltage_kv", "circuits", "circuit_method", "cables", "cable_method"))


BFS_SQL = """WITH RECURSIVE inc AS (SELECT DISTINCT r.uid, r.node FROM v_refs r), known AS (SELECT uid FROM v_line WHERE voltage IS NOT NULL),
  one AS (SELECT i.uid, min(k.uid) AS ref FROM inc i JOIN inc j ON j.node = i.node JOIN known k ON k.uid = j.uid WHERE i.uid NOT IN (SELECT uid FROM known) GROUP BY 1)"""


@query(
    "bfs_propagation",
    f"""{BFS_SQL} SELECT l.uid, CASE WHEN l.voltage IS NOT NULL THEN l.uid ELSE o.ref END AS reference, CASE WHEN l.voltage IS NOT NULL THEN 0 ELSE 1 END AS hops FROM v_line l LEFT JOIN one o ON o.uid = l.uid WHERE (l.voltage IS NOT NULL OR o.ref IS NOT NULL)""",
)
def bfs_propagation(t):
    # lines without a tag are all one hop from a tagged line here; deeper paths are covered by tests
    seeds = t.v_line.where("voltage IS NOT NULL").select("uid")
    reached = graph.first_reach(seeds, t.v_refs.select("uid", "node"))
    return reached.select("uid", F.col("seed").alias("reference"), F.col("hop").alias("hops"))


@query(
    "line_voltage_methods",
    f"""{BFS_SQL} SELECT CASE WHEN l.voltage = '220 kV, 330000' THEN 'source_tag_normalized' WHEN l.voltage IS NOT NULL THEN 'source_tag' WHEN o.ref IS NOT NULL THEN 'inferred_nearest_connected_line' ELSE 'inferred_global_mode' END AS voltage_method,
        l.voltage IS NULL AS voltage_inferred, count(*) AS lines FROM v_line l LEFT JOIN one o ON o.uid = l.uid GROUP BY 1, 2""",
)
def line_voltage_methods(t):
    d = network.resolve_line_voltages(t.v_line, t.v_refs)
    return d.groupBy("voltage_method", "voltage_inferred").agg(F.count("*").alias("lines"))


# --- topology -----------------------------------------------------------------------------------
SYS_SQL = """sys AS (SELECT uid, unnest(CASE voltage WHEN '220000;110000' THEN [220.0E0, 110.0E0] WHEN '500000' THEN [500.0E0] WHEN '110000;110000;220000' THEN [110.0E0, 220.0E0] WHEN '220 kV, 330000' THEN [330.0E0] ELSE [] END) AS voltage_kv FROM v_line),
 fin AS (SELECT s.uid, s.voltage_kv, r.pos, r.node, max(r.pos) OVER (PARTITION BY r.uid) AS last_pos FROM sys s JOIN v_refs r ON r.uid = s.uid),
 long AS (SELECT * FROM fin WHERE last_pos > 0)"""


@query(
    "shared_nodes",
    f"WITH {SYS_SQL} SELECT node, voltage_kv FROM long GROUP BY 1, 2 HAVING count(DISTINCT uid) >= 2",
)
def shared_nodes(t):
    return network.shared_nodes(_incidence(t).select("uid", "node", "voltage_kv").distinct())


def _systems(t):
    return network.line_systems(network.source_voltages(t.v_line).where(F.size("voltage_values") > 0))


def _incidence(t):
    ends = network.line_ends(t.v_refs).select("uid")
    return t.v_refs.join(ends, "uid", "left_semi").join(_systems(t).select("uid", "voltage_kv"), "uid")


@query(
    "terminal_clusters",
    """WITH RECURSIVE t AS (SELECT p.node, CAST(p.node % 3 AS DOUBLE) AS kv, p.x, p.y FROM v_point p),
            e AS (SELECT a.node AS a, b.node AS b FROM t a JOIN t b ON a.kv = b.kv AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1500.0E0 * 1500.0E0 AND a.node <> b.node),
            reach(x, y) AS (SELECT node, node FROM t UNION SELECT r.x, e.b FROM reach r JOIN e ON e.a = r.y)
       SELECT t.node, t.kv AS voltage_kv, min(r.y) AS representative FROM t JOIN reach r ON r.x = t.node GROUP BY 1, 2""",
)
def terminal_clusters(t):
    d = t.v_point.withColumn("voltage_kv", (F.col("node") % 3).cast("double"))
    return network.cluster_terminals(d, 1500.0)


@query(
    "split_lines",
    f"""WITH {SYS_SQL}, shared AS (SELECT node, voltage_kv FROM long GROUP BY 1, 2 HAVING count(DISTINCT uid) >= 2),
          d AS (SELECT p.node, s.station_uid, sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)) AS d FROM v_point p JOIN v_station s ON (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) <= 6250000.0E0
                WHERE p.node IN (SELECT node FROM shared UNION SELECT node FROM long WHERE pos = 0 OR pos = last_pos)),
          st AS (SELECT node, station_uid FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY d, station_uid) AS rn FROM d) WHERE rn = 1),
          sp AS (SELECT l.uid, l.voltage_kv, l.pos, l.node, st.station_uid FROM long l LEFT JOIN shared s ON s.node = l.node AND s.voltage_kv = l.voltage_kv LEFT JOIN st ON st.node = l.node
                 WHERE l.pos = 0 OR l.pos = l.last_pos OR s.node IS NOT NULL OR st.station_uid IS NOT NULL),
          seg AS (SELECT uid, voltage_kv, pos, node, station_uid, lead(node) OVER w AS to_node, lead(station_uid) OVER w AS to_station, lead(pos) OVER w AS to_pos FROM sp WINDOW w AS (PARTITION BY uid, voltage_kv ORDER BY pos)),
          nm AS (SELECT *, coalesce(station_uid, concat('osm:node:', CAST(node AS VARCHAR(20)), ':voltage:', CAST(CAST(voltage_kv AS INT) AS VARCHAR(10)))) AS from_uid,
                 coalesce(to_station, concat('osm:node:', CAST(to_node AS VARCHAR(20)), ':voltage:', CAST(CAST(voltage_kv AS INT) AS VARCHAR(10)))) AS to_uid FROM seg WHERE to_pos IS NOT NULL),
          v AS (SELECT l.uid, l.voltage_kv, l.pos, p.x, p.y, lead(p.x) OVER w AS nx, lead(p.y) OVER w AS ny FROM long l JOIN v_point p ON p.node = l.node WINDOW w AS (PARTITION BY l.uid, l.voltage_kv ORDER BY l.pos)),
          len AS (SELECT n.uid, n.voltage_kv, n.pos, sum(sqrt((v.nx - v.x) * (v.nx - v.x) + (v.ny - v.y) * (v.ny - v.y))) / 1000 AS length_km FROM nm n JOIN v ON v.uid = n.uid AND v.voltage_kv = n.voltage_kv AND v.pos >= n.pos AND v.pos < n.to_pos GROUP BY 1, 2, 3)
        SELECT concat(n.uid, ':voltage:', CAST(CAST(n.voltage_kv AS INT) AS VARCHAR(10)), ':node:', CAST(n.node AS VARCHAR(20)), ':node:', CAST(n.to_node AS VARCHAR(20))) AS uid, n.from_uid, n.to_uid, n.voltage_kv, round(l.length_km, 4) AS length_km
        FROM nm n JOIN len l ON l.uid = n.uid AND l.voltage_kv = n.voltage_kv AND l.pos = n.pos WHERE n.from_uid <> n.to_uid""",
)
def split_lines(t):
    return rounded(_branches(t)[0].select("uid", "from_uid", "to_uid", "voltage_kv", "length_km"), 4)


def _branches(t):
    stations = t.v_station.select("station_uid", F.array(G.point("x", "y")).alias("ring"), F.lit(1).alias("sign"))
    no_transformers = t.v_point.limit(0).select(F.lit("").alias("transformer_uid"), "node")
    return network.build_branches(_systems(t), t.v_refs, t.v_point, stations, no_transformers, {"station_tolerance_m": 2500.0})


GRID_NODE_SQL = """nd AS (SELECT uid, CASE node_type WHEN 'station' THEN 'station' ELSE 'junction' END AS class FROM v_node),
 br AS (SELECT uid, from_bus_uid AS a, to_bus_uid AS b, CASE WHEN CAST(substr(uid, 3) AS BIGINT) % 4 = 0 THEN 110.0E0 WHEN CAST(substr(uid, 3) AS BIGINT) % 4 = 1 THEN 220.0E0 ELSE 500.0E0 END AS kv,
         CASE WHEN CAST(substr(uid, 3) AS BIGINT) % 9 = 0 THEN 'DC' ELSE 'AC' END AS cur FROM v_edge WHERE from_bus_uid <> to_bus_uid),
 bus AS (SELECT DISTINCT e.node, e.kv, e.cur, nd.class FROM (SELECT a AS node, kv, cur FROM br UNION ALL SELECT b, kv, cur FROM br) e JOIN nd ON nd.uid = e.node)"""


def _grid(t):
    k = F.substring("uid", 3, 20).cast("long")
    nodes = t.v_node.select("uid", F.col("node_type").alias("class"), F.lit("x").alias("subclass"), "status", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    kv = F.when(k % 4 == 0, 110.0).when(k % 4 == 1, 220.0).otherwise(500.0)
    branches = t.v_edge.where("from_bus_uid <> to_bus_uid").select(
        "uid", F.col("from_bus_uid").alias("from_uid"), F.col("to_bus_uid").alias("to_uid"), kv.alias("voltage_kv"), F.when(k % 9 == 0, "dc").otherwise("ac").alias("current_type")
    )
    return nodes, branches


@query(
    "bus_expansion",
    f"WITH {GRID_NODE_SQL} SELECT concat(node, ':bus:', lower(cur), ':', CAST(CAST(kv AS INT) AS VARCHAR(10))) AS uid, concat(class, '_bus') AS subclass, kv AS voltage_kv, cur AS current_type, node AS source_node_uid FROM bus",
)
def bus_expansion(t):
    return network.expand_buses(*_grid(t)).select("uid", "subclass", "voltage_kv", "current_type", "source_node_uid")


@query(
    "bus_chain_equipment",
    f"""WITH {GRID_NODE_SQL}, c AS (SELECT *, lead(kv) OVER w AS kv2, lead(cur) OVER w AS cur2 FROM bus WHERE class = 'station' WINDOW w AS (PARTITION BY node ORDER BY kv, cur))
        SELECT concat(node, ':', CASE WHEN cur = cur2 THEN 'transformer' ELSE 'converter' END, ':', lower(cur), ':', CAST(CAST(kv AS INT) AS VARCHAR(10)), ':', lower(cur2), ':', CAST(CAST(kv2 AS INT) AS VARCHAR(10))) AS uid,
               CASE WHEN cur = cur2 THEN 'transformer' ELSE 'converter' END AS class, kv AS from_voltage_kv, kv2 AS to_voltage_kv FROM c WHERE kv2 IS NOT NULL AND NOT (cur = 'DC' AND cur2 = 'DC')""",
)
def bus_chain_equipment(t):
    return network.infer_equipment(network.expand_buses(*_grid(t))).select("uid", "class", "from_voltage_kv", "to_voltage_kv")


@query(
    "branch_buses",
    f"""WITH {GRID_NODE_SQL} SELECT uid, concat(a, ':bus:', lower(cur), ':', CAST(CAST(kv AS INT) AS VARCHAR(10))) AS from_bus_uid, concat(b, ':bus:', lower(cur), ':', CAST(CAST(kv AS INT) AS VARCHAR(10))) AS to_bus_uid, cur AS current_type FROM br""",
)
def branch_buses(t):
    return network.connect_branches(_grid(t)[1]).select("uid", "from_bus_uid", "to_bus_uid", "current_type")


@query("electrical_issues", "SELECT 'none' AS rule, CAST(0 AS BIGINT) AS failures FROM v_edge WHERE false")
def electrical_issues(t):
    found = network.electrical_issues(network.build_electrical_network(*_grid(t)))
    return found.groupBy("rule").agg(F.count("*").alias("failures"))


@query(
    "incident_levels",
    f"""WITH {GRID_NODE_SQL}, e AS (SELECT a AS uid, uid AS branch, kv FROM br UNION ALL SELECT b, uid, kv FROM br)
        SELECT uid, string_agg(DISTINCT CAST(CAST(kv AS INT) AS VARCHAR(10)), ';' ORDER BY CAST(CAST(kv AS INT) AS VARCHAR(10))) AS levels, min(branch) AS first_branch, count(DISTINCT branch) > 1 AS several, count(*) AS degree FROM e GROUP BY 1""",
)
def incident_levels(t):
    d = network.incident(_grid(t)[1])
    text = F.array_join(F.array_sort(F.transform("connected", lambda v: S.general_label(v))), ";")
    return d.select("uid", text.alias("levels"), "first_branch", "several", "degree")


@query(
    "node_deduplication",
    """WITH n AS (SELECT uid, node_type AS class, status, voltage_kv, CAST(CAST(substr(uid, 3) AS BIGINT) % 40 AS DOUBLE) AS x FROM v_node),
            e AS (SELECT from_bus_uid AS a, to_bus_uid AS b FROM v_edge WHERE from_bus_uid <> to_bus_uid), used AS (SELECT a AS uid FROM e UNION SELECT b FROM e),
            r AS (SELECT *, row_number() OVER (PARTITION BY x, class, status, voltage_kv ORDER BY CASE WHEN uid IN (SELECT uid FROM used) THEN 0 ELSE 1 END, uid) AS rn, count(*) OVER (PARTITION BY x, class, status, voltage_kv) AS members FROM n)
       SELECT uid, members FROM r WHERE rn = 1""",
)
def node_deduplication(t):
    x = (F.substring("uid", 3, 20).cast("long") % 40).cast("double")
    nodes = t.v_node.select("uid", F.col("node_type").alias("class"), F.lit(None).cast("string").alias("subclass"), "status", F.array("voltage_kv").alias("voltage_kv"),
                            x.alias("x"), F.lit(0.0).alias("y"), F.lit(None).cast("string").alias("merged_source_uids"))
    kept, _ = network.deduplicate_nodes(nodes, _grid(t)[1])
    members = F.coalesce(F.size(F.split("merged_source_uids", ";")), F.lit(1)).cast("long")
    return kept.select("uid", members.alias("members"))


@query(
    "station_classes",
    """SELECT uid, CASE CAST(substr(uid, 5) AS BIGINT) % 4 WHEN 0 THEN 'converter' WHEN 1 THEN 'distribution' WHEN 2 THEN 'transmission' ELSE CASE WHEN voltage IS NULL THEN 'distribution' ELSE 'transmission' END END AS subclass,
              CASE WHEN CAST(substr(uid, 5) AS BIGINT) % 4 = 3 THEN 'inferred_voltage_threshold' ELSE 'source_tag' END AS method FROM v_line""",
)
def station_classes(t):
    k = F.substring("uid", 5, 20).cast("long") % 4
    raw = F.when(k == 0, "Converter;x").when(k == 1, "minor_distribution").when(k == 2, "Transmission")
    c = network.station_class(F.lit("substation"), raw, S.tag_voltages("voltage"), 220.0)
    return t.v_line.select("uid", c["subclass"].alias("subclass"), c["method"].alias("method"))


@query(
    "lifecycle_status",
    """SELECT uid, CASE WHEN k = 0 THEN 'line' WHEN k = 1 THEN 'cable' WHEN k = 2 THEN 'substation' END AS standard_type, CASE WHEN k = 0 THEN 'operating' WHEN k = 1 THEN 'construction' WHEN k = 2 THEN 'razed' END AS standard_status
       FROM (SELECT uid, CAST(substr(uid, 5) AS BIGINT) % 4 AS k FROM v_line)""",
)
def lifecycle_status(t):
    k = F.substring("uid", 5, 20).cast("long") % 4
    d = t.v_line.drop("standard_type", "standard_status").withColumns({
        "power": F.when(k == 0, "line").when(k == 3, "tower"), "construction:power": F.when(k == 1, "cable"), "razed:power": F.when(k.isin(1, 2), "substation"),
    })
    return network.lifecycle(d).select("uid", "standard_type", "standard_status")


@query(
    "feature_selection",
    """SELECT uid AS source_uid, standard_type FROM v_line WHERE standard_status IN ('O', 'F') AND standard_type IN ('line', 'cable') AND voltage IS NOT NULL AND frequency <> '0' AND uid IN (SELECT uid FROM v_refs)""",
)
def feature_selection(t):
    d = t.v_line.withColumnRenamed("uid", "source_uid").withColumn("feature_kind", F.lit("way"))
    lines, _, _ = network.select_features(d, t.v_refs, statuses=["O", "F"], anomalous_hz=[0.0])
    return lines.select("source_uid", "standard_type")


@query(
    "cross_region_branches",
    """SELECT e.uid AS branch_uid, a.admin_uid AS from_region, b.admin_uid AS to_region, a.admin_uid <> b.admin_uid AS is_cross_region FROM v_edge e JOIN v_node a ON a.uid = e.from_bus_uid JOIN v_node b ON b.uid = e.to_bus_uid""",
)
def cross_region_branches(t):
    nodes = t.v_node.select(F.col("uid").alias("node_uid"), "node_type", "admin_uid")
    edges = t.v_edge.select(F.col("uid").alias("branch_uid"), F.col("from_bus_uid").alias("from_node"), F.col("to_bus_uid").alias("to_node"))
    return network.cross_region(edges, nodes, "admin_uid").select("branch_uid", "from_region", "to_region", "is_cross_region")


STATION_GRAPH_SQL = """seg AS (SELECT r.uid, max(CASE WHEN pos = 0 THEN node END) AS a, max(CASE WHEN pos = lp THEN node END) AS b FROM (SELECT *, max(pos) OVER (PARTITION BY uid) AS lp FROM v_refs) r WHERE lp > 0 GROUP BY 1),
 hit AS (SELECT p.node, s.station_uid, sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)) AS d FROM v_point p JOIN v_station s ON (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) <= 9000000.0E0),
 asg AS (SELECT node, station_uid FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY d, station_uid) AS rn FROM hit) WHERE rn = 1)"""


def _terminals(t, levels=None):
    ends = network.line_ends(t.v_refs).select("uid", "first_node", "last_node")
    ends = ends.withColumn("voltage_kv", F.lit(220)) if levels is None else ends.join(by_shuffle(levels), "uid", "left")
    ends = cut_lineage(ends)
    rows = F.array(
        F.struct(F.lit("start").alias("terminal_position"), F.col("first_node").alias("node")),
        F.struct(F.lit("end").alias("terminal_position"), F.col("last_node").alias("node")),
    )
    d = ends.select(F.col("uid").alias("segment_uid"), "voltage_kv", F.explode(rows).alias("e")).select("segment_uid", "voltage_kv", "e.*").join(t.v_point, "node")
    return d.withColumn("uid", F.concat("segment_uid", F.lit(":"), "terminal_position")).withColumn("length_m", F.lit(1.0))


def _station_matches(t, all_matches):
    """Stations within 3 km of each place of a node: all of them, or the nearest."""
    stations = t.v_station.select("station_uid", F.array(G.point("x", "y")).alias("ring"), F.lit(1).alias("sign"))
    return mapping.nearest_of_places(t.v_point.select("x", "y"), stations, 3000.0, 3000.0, all_matches)


@query(
    "direct_branches",
    f"WITH {STATION_GRAPH_SQL} SELECT seg.uid AS segment_uid, x.station_uid AS from_station, y.station_uid AS to_station FROM seg JOIN asg x ON x.node = seg.a JOIN asg y ON y.node = seg.b WHERE x.station_uid <> y.station_uid",
)
def direct_branches(t):
    return network.direct_branches(_terminals(t).join(_station_matches(t, False).select("x", "y", "station_uid"), ["x", "y"]))


@query(
    "grid_summary",
    f"""WITH RECURSIVE {STATION_GRAPH_SQL}, tm AS (SELECT uid, 's' AS p, a AS node FROM seg UNION ALL SELECT uid, 'e', b FROM seg),
          m AS (SELECT tm.uid, tm.p, count(*) AS n, min(hit.station_uid) AS station_uid FROM tm JOIN hit ON hit.node = tm.node GROUP BY 1, 2),
          ms AS (SELECT hit.station_uid, count(*) AS met FROM tm JOIN hit ON hit.node = tm.node GROUP BY 1),
          one AS (SELECT met FROM m JOIN ms ON ms.station_uid = m.station_uid WHERE n = 1),
          lv AS (SELECT uid, max(CASE voltage WHEN '220000;110000' THEN 220 WHEN '500000' THEN 500 WHEN '110000;110000;220000' THEN 220 WHEN '220 kV, 330000' THEN 330 END) AS kv FROM v_line GROUP BY 1),
          pt AS (SELECT tm.uid, tm.p, lv.kv, coalesce(asg.station_uid, concat('junction:', CAST(v.x AS VARCHAR(20)), ':', CAST(v.y AS VARCHAR(20)), ':', coalesce(CAST(lv.kv AS VARCHAR(20)), ''))) AS n, asg.station_uid IS NOT NULL AS s
                 FROM tm JOIN v_point v ON v.node = tm.node LEFT JOIN lv ON lv.uid = tm.uid LEFT JOIN asg ON asg.node = tm.node),
          nodes AS (SELECT DISTINCT n, s FROM pt), e AS (SELECT a.uid, a.kv, a.n AS f, a.s AS fs, b.n AS t, b.s AS ts FROM pt a JOIN pt b ON b.uid = a.uid AND a.p = 's' AND b.p = 'e' WHERE a.n <> b.n),
          mv AS (SELECT n FROM (SELECT f AS n, kv FROM e WHERE fs UNION ALL SELECT t, kv FROM e WHERE ts) GROUP BY 1 HAVING count(DISTINCT kv) > 1),
          k AS (SELECT f AS a, t AS b FROM e UNION SELECT t, f FROM e),
          cc(n, comp) USING KEY (n) AS (SELECT n, n FROM nodes UNION SELECT k.b, min(c.comp) FROM cc c JOIN k ON k.a = c.n JOIN recurring.cc u ON u.n = k.b WHERE c.comp < u.comp GROUP BY 1),
          cb AS (SELECT cc.comp, count(*) AS branches FROM e JOIN cc ON cc.n = e.f GROUP BY 1),
          sub AS (SELECT c.comp, c.nodes, c.stations, coalesce(cb.branches, 0) AS branches FROM (SELECT cc.comp, count(*) AS nodes, count(*) FILTER (WHERE s) AS stations FROM cc JOIN nodes ON nodes.n = cc.n GROUP BY 1) c LEFT JOIN cb ON cb.comp = c.comp),
          big AS (SELECT nodes, branches, stations FROM sub ORDER BY nodes DESC, branches DESC, stations DESC LIMIT 1)
        SELECT 'matched_terminals' AS metric, count(*) AS value FROM m UNION ALL SELECT 'single_station_terminals', count(*) FROM m WHERE n = 1 UNION ALL SELECT 'multiple_station_terminals', count(*) FROM m WHERE n > 1
        UNION ALL SELECT 'shared_station_single_match_terminals', count(*) FROM one WHERE met > 1 UNION ALL SELECT 'one_to_one_terminal_station_matches', count(*) FROM one WHERE met = 1
        UNION ALL SELECT 'matched_stations', count(*) FROM ms
        UNION ALL SELECT 'nodes', count(*) FROM nodes UNION ALL SELECT 'station_nodes', count(*) FROM nodes WHERE s UNION ALL SELECT 'junction_nodes', count(*) FROM nodes WHERE NOT s UNION ALL SELECT 'multi_voltage_station_nodes', count(*) FROM mv
        UNION ALL SELECT 'branches', count(*) FROM e UNION ALL SELECT 'station_station_branches', count(*) FROM e WHERE fs AND ts UNION ALL SELECT 'station_junction_branches', count(*) FROM e WHERE fs <> ts UNION ALL SELECT 'junction_junction_branches', count(*) FROM e WHERE NOT fs AND NOT ts
        UNION ALL SELECT 'direct_branches', count(*) FROM seg JOIN asg x ON x.node = seg.a JOIN asg y ON y.node = seg.b WHERE x.station_uid <> y.station_uid
        UNION ALL SELECT 'connected_subgraphs', count(*) FROM sub UNION ALL SELECT 'isolated_node_subgraphs', count(*) FROM sub WHERE branches = 0 UNION ALL SELECT 'isolated_branches', count(*) FROM sub WHERE nodes = 2 AND branches = 1 UNION ALL SELECT 'multi_branch_subgraphs', count(*) FROM sub WHERE branches > 1
        UNION ALL SELECT 'largest_subgraph_nodes', coalesce(max(nodes), 0) FROM big UNION ALL SELECT 'largest_subgraph_branches', coalesce(max(branches), 0) FROM big UNION ALL SELECT 'largest_subgraph_station_nodes', coalesce(max(stations), 0) FROM big""",
)
def grid_summary(t):
    """Lines have the highest level of their tag, and a line without one has none; its junctions then are apart from those of the levels."""
    summary, nodes, edges, terminals = _grid_counts(t)
    direct = network.direct_branches(terminals.where("station_uid IS NOT NULL")).agg(F.count("*").alias("value")).select(F.lit("direct_branches").alias("metric"), "value")
    return summary.unionByName(direct).unionByName(network.subgraph_summary(nodes, edges))


def _grid_counts(t):
    """Counts of `grid_summary` but for the connected subgraphs, and the tables behind them."""
    levels = network.source_voltages(t.v_line).groupBy("uid").agg(F.max(F.array_max("voltage_values")).alias("voltage_kv"))
    terminals = _terminals(t, levels)
    placed = stored(network.placed_terminals(terminals, _station_matches(t, False), ("x", "y")), "terminals")
    nodes, edges = network.graph_of_terminals(placed)
    edges = stored(edges, "branches")
    return network.grid_summary(_station_matches(t, True), nodes, edges, placed), nodes, edges, placed


@query("summary_checks", "SELECT unnest(['node_types_close', 'branch_types_close', 'terminal_matches_close']) AS \"check\", true AS ok")
def summary_checks(t):
    return network.summary_checks(_grid_counts(t)[0])


@query(
    "status_mask",
    "SELECT uid, lower(coalesce(status, 'operating')) = 'operating' AS active, coalesce(lower(status) = 'operating', false) AS strict FROM v_bus",
)
def status_mask(t):
    return t.v_bus.select("uid", aggregate.status_mask(["OPERATING"], True).alias("active"), aggregate.status_mask(["operating"], False).alias("strict"))
