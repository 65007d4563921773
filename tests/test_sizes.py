"""Queries against their SQL on small tables that hold what only large ones show: high keys, stacked places, near ties."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

GIVEN = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture
def folder(tmp_path):
    """Write the given tables, some of them replaced by a text, into a folder."""

    def write(**changed: str) -> str:
        con = duckdb.connect()
        for name in TABLES:
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{GIVEN}/{name}.parquet'")
        for name in TABLES:
            con.execute(f"COPY ({changed.get(name, f'SELECT * FROM {name}')}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.close()
        return str(tmp_path)

    return write


def by_sql(name: str, at: str, columns: list[str]) -> list[tuple]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{at}/{table}.parquet'")
    wanted = ", ".join(f'"{c}"' for c in columns)
    rows = con.execute(f"SELECT {wanted} FROM ({entry.oracle_sql()[name]})").fetchall()
    con.close()
    return sorted(rows, key=repr)


def assert_same(spark, name: str, at: str) -> list[tuple]:
    d = entry.queries()[name](spark, at)
    got = sorted((tuple(r) for r in d.collect()), key=repr)
    assert got == by_sql(name, at, d.columns)
    return got


def test_numbered_branches_beyond_five_digits(spark, folder):
    at = folder(customer="SELECT CAST(i AS BIGINT) AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM (SELECT * FROM customer LIMIT 1), range(0, 100100) r(i)")
    got = assert_same(spark, "numbered_branches", at)
    assert any(r[1] == "bus_100099" for r in got)


#: Parts whose keys differ by 100,000 stand at the same place; few suppliers leave most of them without a station.
STACKED_PARTS = "SELECT CAST(p_partkey + i * 100000 AS BIGINT) AS p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part, range(0, 2) r(i)"
STACKED_ITEMS = "SELECT * REPLACE (CAST(l_partkey + 100000 * (l_linenumber % 2) AS BIGINT) AS l_partkey) FROM lineitem"


def test_grid_summary_of_stacked_junctions(spark, folder):
    assert_same(spark, "grid_summary", folder(part=STACKED_PARTS, lineitem=STACKED_ITEMS))


def test_nearest_in_region_of_near_ties(spark):
    """Distances that hypot and the root of the sum order differently."""
    from gridloom.operators import mapping

    place = lambda k: ((k * 7919) % 11000 / 100 - 5, (k * 4729) % 11000 / 100 - 5)
    x, y = place(32305)
    at = {k: (float(k * 37 % 100), float(k * 53 % 100)) for k in (1672, 1791)}
    length = {k: ((x - a) * (x - a) + (y - b) * (y - b)) ** 0.5 for k, (a, b) in at.items()}
    objects = spark.createDataFrame([("o", x, y, "r")], "uid string, x double, y double, region string")
    stations = spark.createDataFrame([(f"bus:{k}", a, b, "r") for k, (a, b) in at.items()], "node_uid string, x double, y double, region string")
    row = mapping.nearest_in_region(objects, stations, "region").first()
    best = min(at, key=lambda k: (length[k], f"bus:{k}"))
    assert (row.node_uid, row.station_distance_m) == (f"bus:{best}", length[best])


def test_stacked_boxes_meet_once(spark, monkeypatch):
    """Sources with the same box are one box of the search; the smallest uid is chosen."""
    from gridloom.operators import crosswalk

    seen = []
    search = crosswalk.nearest_boxes
    monkeypatch.setattr(crosswalk, "nearest_boxes", lambda left, right: seen.append(right.count()) or search(left, right))
    sources = spark.range(3000).selectExpr("concat('s:', id) AS uid", "0.0D AS x0", "0.0D AS y0", "2.0D AS x1", "2.0D AS y1")
    cells = spark.sql("SELECT 'c' AS spatial_uid, 'l' AS spatial_level, double(5) AS x0, double(0) AS y0, double(6) AS x1, double(1) AS y1")
    none = spark.createDataFrame([], "source_uid string, spatial_uid string, source_area double, target_area double, overlap_area double")
    row = crosswalk.attach_uncovered(none, sources, cells, spark.sql("SELECT 'c' AS spatial_uid, 1.0D AS weight"), ["l"]).collect()
    assert seen == [1] and [(r.source_uid, r.overlap_area) for r in row] == [("s:0", 1.0)]


def test_rings_are_clipped_once_per_square(spark):
    """A filter on the clipped ring must not hold the clipping again."""
    from gridloom.functions import geometry as G
    from gridloom.operators import cells

    units = spark.sql("SELECT 'a' AS admin_uid, 'l' AS level, 1 AS sign, 0.5D AS x0, 0.5D AS y0, 4.0D AS x1, 2.0D AS y1")
    parts = cells.ring_cells(units.select("admin_uid", "level", "sign", G.box_ring("x0", "y0", "x1", "y1").alias("ring")), 3.0, (0.0, 0.0))
    assert parts._jdf.queryExecution().optimizedPlan().toString().count("flatten(") == 4
    assert sorted((r.source_cell_uid, r.part_area) for r in parts.collect()) == [("square:3:0:0", 3.75), ("square:3:1:0", 1.5)]


def test_parameters_by_profile(spark):
    """Assets that share a profile get the values of its parameters, without a row per asset and parameter."""
    from gridloom.operators import aggregate, manifest

    p = spark.createDataFrame([("c", 1, "efficiency", 0.4, "p.u.", "p1"), ("c", 1, "efficiency", 0.5, "p.u.", "p2"), ("c", 2, "vom", 3.0, "EUR/MWh", "p3")],
                              "class string, k long, name string, value double, unit string, selected_parameter_uid string")
    a = spark.createDataFrame([("g1", "c", 1, 10.0), ("g2", "c", 1, None), ("g3", "c", 2, 30.0), ("g4", "d", 1, 1.0)], "uid string, class string, k long, capacity_mw double")
    specs = {k: s for k, s in manifest.contract().items() if k in ("generator_efficiency", "generator_vom")}
    got = {r.uid: (r.generator_efficiency, r.generator_vom) for r in manifest.with_values(a, p, specs, ("class", "k")).collect()}
    assert got == {"g1": (0.4, 0.0), "g2": (0.4, 0.0), "g3": (1.0, 3.0), "g4": (1.0, 0.0)}
    row = manifest.coverage_report({"generator": a}, {"generator": p}, [s for s in specs.values() if s.name == "vom"], ("class", "k")).first()
    assert row.detail.startswith("1/4 resolved")
    members = a.selectExpr("uid AS source_uid", "'A' AS aggregate_uid", "capacity_mw AS source_capacity_mw", "class", "k")
    by_profile = aggregate.aggregate_parameters(p, members, sum_names=["vom"], by=("class", "k"))
    rows = a.select("uid", "class", "k").join(p, ["class", "k"]).drop("class", "k")
    by_uid = aggregate.aggregate_parameters(rows, members.drop("class", "k"), sum_names=["vom"])
    columns = ["uid", "name", "unit", "value", "records", "selected_parameter_uid"]
    want = [("A", "efficiency", "p.u.", pytest.approx(0.45), 4, "p1;p2"), ("A", "vom", "EUR/MWh", 3.0, 1, "p3")]
    assert sorted(tuple(r) for r in by_profile.select(columns).collect()) == want == sorted(tuple(r) for r in by_uid.select(columns).collect())


def test_overlap_areas_of_many_pairs(spark):
    """The block form gives what the slab form gives, for concave rings too."""
    import numpy as np

    from gridloom.functions import geometry as G

    rng = np.random.default_rng(3)

    def star(n):
        angle = ((np.arange(n) + rng.uniform(0, 0.8, (200, n))) * 2 * np.pi / n)[:, :: rng.choice((1, -1))]
        radius, centre = rng.uniform(1, 3, (200, n)), rng.uniform(0, 4, (200, 2, 1))
        return centre[:, 0] + radius * np.cos(angle), centre[:, 1] + radius * np.sin(angle)

    for n, m in ((3, 3), (4, 7), (9, 5)):
        (lx, ly), (rx, ry) = star(n), star(m)
        got, _ = G._overlaps(lx, ly, rx, ry)
        want = [G._overlap(np.column_stack(a), np.column_stack(b)) for a, b in zip(zip(lx, ly), zip(rx, ry))]
        assert np.allclose(got, want, atol=1e-9)


def test_first_nearest_of_stacked_points(spark):
    from gridloom.operators import nearest

    left = spark.range(10).selectExpr("id AS lid", "double(id) AS x", "0.0D AS y")
    right = spark.range(400).selectExpr("concat('r:', lpad(id, 3, '0')) AS rid", "double(id % 2) * 9 AS x", "0.0D AS y")
    got = {r.lid: (r.rid, r.distance) for r in nearest.first_nearest(left, right).collect()}
    assert got == {k: ("r:000", float(k)) if k < 5 else ("r:001", 9.0 - k) for k in range(10)}


def test_stations_of_a_place_are_searched_once(spark):
    from gridloom.functions import geometry as G
    from gridloom.operators import mapping

    points = spark.range(60).selectExpr("id AS uid", "double(id % 3) AS x", "0.0D AS y")
    stations = spark.range(40).select(F.concat(F.lit("s:"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("station_uid"), F.array(G.point((F.col("id") % 2) * 10.0, F.lit(0.0))).alias("ring"), F.lit(1).alias("sign"))
    near = mapping.nearest_of_places(points, stations, 4.0, 2.0)
    assert sorted(tuple(r) for r in near.collect()) == [(0.0, 0.0, "s:00", 0.0), (1.0, 0.0, "s:00", 1.0), (2.0, 0.0, "s:00", 2.0)]
    every = mapping.nearest_of_places(points, stations, 4.0, 1.0, True).groupBy("x").count().collect()
    assert {r.x: r["count"] for r in every} == {0.0: 20, 1.0: 20}
    assert mapping.terminal_matches(points, stations, 4.0, 1.0).count() == 2 * 20 * 20


def test_level_priority_of_holes_and_stacks(spark):
    from gridloom.functions import geometry as G
    from gridloom.operators import cells

    rows = [("b", "p", 0, 0, 4, 4, 1), ("b", "p", 1, 1, 3, 3, -1), ("c", "m", 0, 0, 4, 4, 1), ("a", "m", 2, 2, 4, 4, 1), ("z", "other", 0, 0, 9, 9, 1)]
    d = spark.createDataFrame([(*r[:2], *map(float, r[2:6]), r[6]) for r in rows], "admin_uid string, level string, x0 double, y0 double, x1 double, y1 double, sign int")
    out = cells.level_priority(d.select("admin_uid", "level", "sign", G.box_ring("x0", "y0", "x1", "y1").alias("ring")), ["p", "m"], 1.0)
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.ix, r.iy): r.admin_uid for r in out.collect()}
    assert got == {(x, y): ("c" if (x, y) != (2, 2) else "a") if x in (1, 2) and y in (1, 2) else "b" for x in range(4) for y in range(4)}


def test_copies_of_a_shape_leave_before_they_are_clipped(spark):
    from gridloom.functions import geometry as G
    from gridloom.operators import overlay

    boxes = spark.range(500).selectExpr("concat('u:', lpad(id, 3, '0')) AS uid", "int(id % 2) AS rank", "double(id % 5) AS x")
    units = boxes.select(F.lit("all").alias("layer"), "rank", "uid", F.lit(1).alias("sign"), G.box_ring("x", F.lit(0.0), F.col("x") + 2, F.lit(1.0)).alias("ring"))
    assert sorted(r.uid for r in overlay.leading_units(units).collect()) == ["u:000", "u:002", "u:004", "u:006", "u:008"]
    assert sum(r.area for r in overlay.owned_parts(units, 6.0).collect()) == pytest.approx(6.0)


def test_composite_shares_do_not_shuffle_the_product(spark):
    from gridloom.operators import crosswalk

    z = spark.createDataFrame([("a", "r", "x", 2.0, 1.0), ("a", "r", "y", 3.0, 1.0), ("b", "r", "x", 2.0, 3.0), ("c", None, "y", 3.0, 2.0)], "uid string, region string, class string, e double, z double")
    h = spark.createDataFrame([(1, "x", 1.0), (1, "y", 10.0), (2, "x", 5.0)], "time int, class string, h double")
    d = crosswalk.composite_shares(z, h, ["uid", "region"], "e", "h", "z", "region")
    got = {(r.uid, r.time): (r.q, round(r.share, 9)) for r in d.collect()}
    assert got == {("a", 1): (32.0, round(32 / 38, 9)), ("b", 1): (6.0, round(6 / 38, 9)), ("c", 1): (60.0, 1.0), ("a", 2): (10.0, 0.25), ("b", 2): (30.0, 0.75)}


def test_conflicts_deal_their_rows(spark):
    from gridloom.operators import parameters

    rows = [("n", "u1", 1.0, "a", "s1"), ("n", "u2", 2.0, "a", "s2"), ("n", "u3", 2.0, "b", "s2"), ("m", "u4", 1.0, "a", "s1"), ("m", "u5", 1.0, "a", "s1")]
    p = spark.createDataFrame(rows, "name string, uid string, value double, unit string, source_id string").withColumn("applies_to_dataset", F.lit("generator"))
    d = parameters.conflicts(p)
    got = [(r.name, r.candidate_count, r.unit_count, r.source_count, r.low, r.high) for r in d.collect()]
    assert got == [("n", 3, 2, 2, 1.0, 2.0)]
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("RepartitionByExpression")


#: So many suppliers that about half of the terminals have a station; lines of several levels meet there and at junctions.
SOME_STATIONS = "SELECT CAST(s_suppkey + 10 * i AS BIGINT) AS s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier, range(0, 20) r(i)"


def test_grid_summary_of_several_levels(spark, folder):
    got = dict(assert_same(spark, "grid_summary", folder(supplier=SOME_STATIONS)))
    assert got["multi_voltage_station_nodes"] > 0 and got["isolated_node_subgraphs"] + got["isolated_branches"] + got["multi_branch_subgraphs"] == got["connected_subgraphs"] > 1
    assert got["shared_station_single_match_terminals"] + got["one_to_one_terminal_station_matches"] == got["single_station_terminals"] > 0
    assert got["direct_branches"] == got["station_station_branches"] > 0


def test_levels_of_a_small_grid(spark):
    """Two lines of different level between the same places: one pair of stations, but two pairs of junctions."""
    from gridloom.operators import network

    rows = [("a", 110, 0.0, 9.0), ("b", 220, 0.0, 9.0), ("c", 110, 9.0, 20.0), ("d", 220, 9.0, 20.0), ("e", None, 9.0, 20.0), ("f", 500, 30.0, 30.0)]
    ends = [(u, p, kv, 1.0, x, 0.0) for u, kv, start, end in rows for p, x in (("start", start), ("end", end))]
    terminals = spark.createDataFrame(ends, "segment_uid string, terminal_position string, voltage_kv int, length_m double, x double, y double")
    near = spark.createDataFrame([(0.0, 0.0, "s0"), (9.0, 0.0, "s9"), (30.0, 0.0, "s30")], "x double, y double, station_uid string")
    matches = near.union(spark.createDataFrame([(0.0, 0.0, "s9")], near.schema))
    nodes, edges = network.station_graph(terminals, near, ("x", "y"))
    got = {r.metric: r.value for d in (network.grid_summary(matches, nodes, edges, terminals), network.subgraph_summary(nodes, edges)) for r in d.collect()}
    assert got == {
        "matched_terminals": 9, "single_station_terminals": 7, "multiple_station_terminals": 2, "shared_station_single_match_terminals": 7, "one_to_one_terminal_station_matches": 0,
        "matched_stations": 3, "nodes": 6, "station_nodes": 3, "junction_nodes": 3, "multi_voltage_station_nodes": 2,
        "branches": 5, "station_station_branches": 2, "station_junction_branches": 3, "junction_junction_branches": 0,
        "connected_subgraphs": 2, "isolated_node_subgraphs": 1, "isolated_branches": 0, "multi_branch_subgraphs": 1,
        "largest_subgraph_nodes": 5, "largest_subgraph_branches": 5, "largest_subgraph_station_nodes": 2,
    }
