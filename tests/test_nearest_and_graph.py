"""Brute-force checks of nearest search, clustering and graph operators, with crowded inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.operators import cells, graph, nearest, network, tiling


def crowd(seed, n):
    """Most points packed into one spot, some stacked, the rest spread out."""
    rng = np.random.default_rng(seed)
    packed = 500 + rng.random((n // 2, 2)) * 1e-3
    stacked = np.repeat([[10.0, 10.0]], n // 6, axis=0)
    spread = rng.random((n - len(packed) - len(stacked), 2)) * 1000
    return np.concatenate([packed, stacked, spread])


def frame(spark, points, name):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], f"{name} long, x double, y double")


def test_nearest_points_in_a_crowd(spark):
    left, right = crowd(1, 240), crowd(2, 300)
    out = nearest.nearest_points(frame(spark, left, "lid"), frame(spark, right, "rid")).collect()
    d = np.hypot(left[:, None, 0] - right[None, :, 0], left[:, None, 1] - right[None, :, 1])
    want = {(i, j) for i in range(len(left)) for j in np.flatnonzero(d[i] <= d[i].min())}
    assert {(r.lid, r.rid) for r in out} == want


def test_nearest_boxes_and_segments(spark):
    rng = np.random.default_rng(5)
    a = np.column_stack([crowd(3, 60), crowd(3, 60) + rng.random((60, 2)) * 3])
    b = np.column_stack([crowd(4, 90), crowd(4, 90) + rng.random((90, 2)) * 40])
    to_df = lambda m, key, names: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(m)], f"{key} long, " + ", ".join(f"{n} double" for n in names))
    gap = np.hypot(
        np.maximum(0, np.maximum(b[None, :, 0] - a[:, None, 2], a[:, None, 0] - b[None, :, 2])),
        np.maximum(0, np.maximum(b[None, :, 1] - a[:, None, 3], a[:, None, 1] - b[None, :, 3])),
    )
    out = nearest.nearest_boxes(to_df(a, "lid", ("x0", "y0", "x1", "y1")), to_df(b, "rid", ("x0", "y0", "x1", "y1"))).collect()
    best = {}
    for r in out:
        best.setdefault(r.lid, set()).add(round(r.distance, 9))
    assert all(best[i] == {round(float(gap[i].min()), 9)} for i in range(len(a)))

    def seg(p, q):
        """Distance of two segments by dense sampling of the closed form at endpoints and crossings."""
        def point(pt, s):
            v = s[2:] - s[:2]
            t = np.clip((pt - s[:2]) @ v / max(v @ v, 1e-300), 0, 1)
            return np.hypot(*(pt - s[:2] - t * v))
        cross = lambda u, w: u[0] * w[1] - u[1] * w[0]
        d1, d2 = p[2:] - p[:2], q[2:] - q[:2]
        den = cross(d1, d2)
        if den:
            t, s = cross(q[:2] - p[:2], d2) / den, cross(q[:2] - p[:2], d1) / den
            if 0 <= t <= 1 and 0 <= s <= 1:
                return 0.0
        return min(point(p[:2], q), point(p[2:], q), point(q[:2], p), point(q[2:], p))

    ends = ("ax", "ay", "bx", "by")
    got = {r.lid: r.distance for r in nearest.nearest_segments(to_df(a, "lid", ends), to_df(b, "rid", ends)).collect()}
    assert all(abs(got[i] - min(seg(a[i], q) for q in b)) < 1e-6 for i in range(len(a)))


def test_terminal_clusters_in_a_crowd(spark):
    pts = crowd(7, 150)
    df = frame(spark, pts, "node").withColumn("voltage_kv", F.lit(220.0))
    got = {r.node: r.representative for r in network.cluster_terminals(df, 30.0).collect()}
    parent = list(range(len(pts)))
    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(pts)):
        for j in range(i):
            if np.hypot(*(pts[i] - pts[j])) <= 30:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in range(len(pts))}
    assert all(r.node == r.representative for r in network.cluster_terminals(df, 0).collect())


@pytest.mark.parametrize("partitions", ["2", "16"])
def test_components_with_a_hub_and_a_chain(spark, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        edges = [("h", f"x{i:03d}") for i in range(200)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("p", "q"), ("p", "q"), ("z", "z")]
        out = graph.connected_components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()
        got = {r.node: r.component for r in out}
        assert len(got) == 201 + 61 + 2 and "z" not in got
        assert {got[f"x{i:03d}"] for i in range(200)} == {"h"} and {got[f"c{i:03d}"] for i in range(61)} == {"c000"} and got["q"] == "p"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_largest_component_tie_takes_smallest_label(spark):
    edges = spark.createDataFrame([("b", "c"), ("a", "d")], "s string, t string")
    assert {r.node for r in graph.largest_component(graph.connected_components(edges, "s", "t")).collect()} == {"a", "d"}


def test_breadth_first_order(spark):
    # queue order: s1 reaches m before s2, so n hangs on s1 although s2 < t
    inc = [("s1", 1), ("m", 1), ("m", 2), ("n", 2), ("s2", 3), ("k", 3), ("k", 4), ("n", 4), ("far", 9)]
    out = graph.spread_from_seeds(spark.createDataFrame([("s1",), ("s2",)], "uid string"), spark.createDataFrame(inc, "uid string, node long"))
    assert {r.uid: r.path for r in out.collect()} == {"s1": ["s1"], "s2": ["s2"], "m": ["s1", "m"], "k": ["s2", "k"], "n": ["s1", "m", "n"]}


def test_station_connection(spark):
    nodes = spark.createDataFrame([("A", "station"), ("B", "station"), ("C", "station"), ("j", "junction")], "uid string, node_type string")
    edges = spark.createDataFrame([("e1", "A", "C", 1.0), ("e2", "C", "B", 1.0), ("e3", "A", "j", 2.0), ("e4", "j", "B", 2.0), ("e5", "A", "j", 5.0)], "uid string, a string, b string, length double")
    direct = graph.station_connection(nodes, edges, "A", "B").first()
    assert direct.length == 4.0 and direct.uids == ["e3", "e4"]
    assert graph.station_connection(nodes, edges, "A", "B", direct_only=False).first().nodes == ["A", "C", "B"]
    assert graph.shortest_path(edges, "A", "nowhere").count() == 0


def test_line_systems(spark):
    rows = [
        ("a", "220000;110000", "2;1", "3;3", "50", "x"), ("b", "110000", None, "6", "50", "x"), ("c", "220000;110000", "3", None, "50", "x"),
        ("d", "110000;110000;220000", "3", "9", "50", "x"), ("e", "800000", None, None, "0", "x"), ("f", "220000;110000", "1", None, "50", "HVDC line"),
    ]
    d = network.source_voltages(spark.createDataFrame(rows, "uid string, voltage string, circuits string, cables string, frequency string, name string"))
    got = {(r.uid, r.voltage_kv): (r.circuits, r.cables, r.circuit_method, r.cable_method) for r in network.line_systems(d).collect()}
    assert got[("a", 220.0)] == (2.0, 3.0, "position_aligned", "position_aligned")
    assert got[("b", 110.0)] == (2.0, 6.0, "inferred_from_cables", "source_total")
    assert got[("c", 220.0)][:3] == (2.0, 6.0, "inferred_balanced_front_remainder") and got[("c", 110.0)][0] == 1.0
    assert got[("d", 110.0)][:3] == (2.0, 5.0, "voltage_sequence") and got[("d", 220.0)][1] == 4.0
    assert got[("e", 800.0)] == (1.0, 2.0, "inferred_default_per_voltage", "inferred_from_circuits")
    assert got[("f", 220.0)][:2] == (0.5, 1.0)


def network_fixture(spark):
    lines = spark.createDataFrame(
        [("w1", "line", "operating", "110000", "1", None, "50", "a"), ("w2", "line", "operating", "110000", "1", None, "50", "b"), ("w3", "cable", "operating", "220000", "1", None, "50", "c")],
        "uid string, standard_type string, standard_status string, voltage string, circuits string, cables string, frequency string, name string",
    )
    refs = spark.createDataFrame([("w1", 0, 1), ("w1", 1, 2), ("w1", 2, 3), ("w2", 0, 2), ("w2", 1, 4), ("w3", 0, 4), ("w3", 1, 5)], "uid string, pos int, node long")
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 1000.0, 0.0), (3, 2000.0, 0.0), (4, 1000.0, 3000.0), (5, 1000.0, 9000.0)], "node long, x double, y double")
    box = [{"x": 900.0, "y": 2900.0}, {"x": 1100.0, "y": 2900.0}, {"x": 1100.0, "y": 3100.0}, {"x": 900.0, "y": 3100.0}]
    stations = spark.createDataFrame([("osm:way:9", box, 1)], f"station_uid string, ring {G.RING}, sign int")
    features = spark.createDataFrame([("osm:way:9", "substation", "operating", None, None, 1000.0, 3000.0)], "source_uid string, standard_type string, standard_status string, voltage string, substation string, x double, y double")
    return lines, refs, nodes, stations, features


def test_full_network_build(spark):
    lines, refs, nodes, stations, features = network_fixture(spark)
    systems = network.line_systems(network.source_voltages(lines))
    none = spark.createDataFrame([], "transformer_uid string, node long")
    branches, ends = network.build_branches(systems, refs, nodes, stations, none, {"station_tolerance_m": 50.0})
    got = {r.uid: (r.from_uid, r.to_uid, r.length_km) for r in branches.collect()}
    assert got == {
        "w1:voltage:110:node:1:node:2": ("osm:node:1:voltage:110", "osm:node:2:voltage:110", 1.0),
        "w1:voltage:110:node:2:node:3": ("osm:node:2:voltage:110", "osm:node:3:voltage:110", 1.0),
        "w2:voltage:110:node:2:node:4": ("osm:node:2:voltage:110", "osm:way:9", 3.0),
        "w3:voltage:220:node:4:node:5": ("osm:way:9", "osm:node:5:voltage:220", 6.0),
    }
    facilities = network.facility_nodes(features, "station", 220.0)
    all_nodes = network.build_nodes(facilities, branches, ends, nodes)
    by = {r.uid: r for r in all_nodes.collect()}
    assert by["osm:way:9"].voltage_kv == [110.0, 220.0] and by["osm:way:9"].subclass == "transmission"
    assert by["osm:node:2:voltage:110"].subclass == "same_voltage" and by["osm:node:1:voltage:110"].subclass == "line_terminal"
    kept, branches = network.deduplicate_nodes(all_nodes, branches)
    network.require_sound(network.node_issues(kept, branches), "nodes")
    net = network.build_electrical_network(kept, branches)
    network.require_sound(network.electrical_issues(net), "network")
    assert [r.uid for r in net["transformer"].collect()] == ["osm:way:9:transformer:ac:110:ac:220"]
    assert net["bus"].count() == 6 and net["converter"].count() == 0
    largest = graph.largest_connected_network(net["bus"], net["branch"], net["transformer"], net["converter"])
    assert largest["bus"].count() == 6


def test_voltage_fallbacks(spark):
    lines = spark.createDataFrame([("a", "110000"), ("b", None), ("c", None), ("d", None)], "uid string, voltage string")
    refs = spark.createDataFrame([("a", 0, 1), ("b", 0, 1), ("c", 0, 7), ("d", 0, 8)], "uid string, pos int, node long")
    segments = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 0.0), ("c", 0.0, 5.0, 1.0, 5.0)], "uid string, ax double, ay double, bx double, by double")
    got = {r.uid: (r.voltage_values, r.voltage_method, r.voltage_reference_uid) for r in network.resolve_line_voltages(lines, refs, segments).collect()}
    assert got["b"] == ([110.0], "inferred_nearest_connected_line", "a") and got["c"] == ([110.0], "inferred_nearest_line_geometry", "a")
    assert got["d"] == ([110.0], "inferred_global_mode", None)


def test_cells_of_a_concave_unit(spark):
    ring = [{"x": float(x), "y": float(y)} for x, y in [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]]
    units = spark.createDataFrame([("u", "p", ring, 1)], f"admin_uid string, level string, ring {G.RING}, sign int")
    parts = cells.ring_cells(units, 1.5, (0.0, 0.0))
    assert abs(parts.agg(F.sum("part_area")).first()[0] - 10.0) < 1e-9
    assert parts.count() == 8  # the top middle square lies between the two arms


def test_simplify_keeps_ends(spark):
    line = [{"x": float(i), "y": 0.01 * (i % 2)} for i in range(11)] + [{"x": 10.0, "y": 5.0}]
    d = spark.createDataFrame([(line,)], f"line {G.RING}")
    out = d.select(G.simplify("line", 0.1).alias("s")).first().s
    assert [(p.x, p.y) for p in out] == [(0.0, 0.0), (10.0, 0.0), (10.0, 5.0)]


def test_point_on_boundary_is_inside(spark):
    boxes = spark.createDataFrame([("b", 0.0, 0.0, 2.0, 2.0)], "key string, x0 double, y0 double, x1 double, y1 double")
    pts = spark.createDataFrame([("p", 2.0, 1.0), ("q", 2.1, 1.0)], "uid string, x double, y double")
    assert [r.uid for r in tiling.points_in_boxes(pts, boxes, 1.0).collect()] == ["p"]
