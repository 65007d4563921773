"""Numeric expectations of mapping, time alignment and aggregation."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.operators import aggregate, case, crosswalk, mapping, skew, timeseries

T0 = datetime(2024, 1, 1)
HOUR = timedelta(hours=1)


def series(spark, rows, value="demand_mw"):
    return spark.createDataFrame(rows, f"time timestamp_ntz, uid string, class string, {value} double")


def boxes(spark, rows, key="uid"):
    return spark.createDataFrame(rows, f"{key} string, x0 double, y0 double, x1 double, y1 double")


def cells(spark, rows):
    return spark.createDataFrame(rows, "spatial_uid string, spatial_level string, admin_uid string, x0 double, y0 double, x1 double, y1 double")


def test_extensive_mapping_zero_and_uncovered(spark):
    load = series(spark, [(T0, "r", "load", 100.0)])
    grid = cells(spark, [("a", "p", "1", 0.0, 0.0, 1.0, 1.0), ("b", "p", "1", 1.0, 0.0, 2.0, 1.0), ("c", "p", "1", 5.0, 0.0, 6.0, 1.0), ("d", "p", "1", 7.0, 0.0, 8.0, 1.0)])
    weight = spark.createDataFrame([("a", 10.0), ("b", 0.0), ("c", 0.0), ("d", 10.0)], "spatial_uid string, weight double")
    out = crosswalk.map_series_to_cells(
        load, boxes(spark, [("r", 0.0, 0.0, 2.0, 1.0)]), grid, value="demand_mw", tile=1.0, step=HOUR, quantity="extensive", method="auxiliary", auxiliary=weight
    )
    assert {r.spatial_uid: r.demand_mw for r in out.collect()} == {"a": 100.0, "b": 0.0, "c": 0.0, "d": None}


def test_nearshore_fallback(spark):
    load = series(spark, [(T0, "r", "load", 100.0)])
    grid = cells(spark, [("a", "province", "1", 0.0, 0.0, 1.0, 1.0), ("b", "marine_zone", "1", 1.5, 0.0, 2.5, 1.0)])
    weight = spark.createDataFrame([("a", 10.0), ("b", 10.0)], "spatial_uid string, weight double")
    out = crosswalk.map_series_to_cells(
        load, boxes(spark, [("r", 0.0, 0.0, 1.0, 1.0)]), grid, value="demand_mw", tile=1.0, step=HOUR, quantity="extensive", method="auxiliary",
        auxiliary=weight, nearest_levels=["marine_zone"],
    )
    assert sorted(r.demand_mw for r in out.collect()) == [50.0, 50.0]


def test_non_conservative_mapping_is_refused(spark):
    grid = cells(spark, [("a", "p", "1", 0.0, 0.0, 1.0, 1.0)])
    with pytest.raises(ValueError, match="not conservative"):
        crosswalk.map_series_to_cells(
            series(spark, [(T0, "r", "load", 1.0)]), boxes(spark, [("r", 0.0, 0.0, 2.0, 1.0)]), grid, value="demand_mw", tile=1.0, step=HOUR, quantity="extensive", method="linear"
        )


def test_zero_auxiliary_source_falls_back_to_area(spark):
    pairs = spark.createDataFrame([("s", "a", 4.0, 1.0, 1.0), ("s", "b", 4.0, 3.0, 3.0)], "source_uid string, spatial_uid string, source_area double, target_area double, overlap_area double")
    aux = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "spatial_uid string, weight double")
    assert sorted(r.weight for r in crosswalk.weights_extensive_auxiliary(pairs, aux).collect()) == [0.25, 0.75]


def test_resample_down_and_up(spark):
    rows = [(T0 + i * HOUR, "u", "c", float(i)) for i in range(3)]
    down = timeseries.align_time(series(spark, rows), source_zone="UTC", target_zone="UTC", source_step=HOUR, target_step=2 * HOUR, value="demand_mw")
    assert [r.demand_mw for r in down.orderBy("time").collect()] == [0.5, 2.0]
    up = timeseries.align_time(series(spark, rows), source_zone="UTC", target_zone="UTC", source_step=HOUR, target_step=HOUR / 2, value="demand_mw")
    assert [r.demand_mw for r in up.orderBy("time").collect()] == [0.0, 0.5, 1.0, 1.5, 2.0]


def test_downsample_lists_empty_bins_from_first_midnight(spark):
    rows = [(T0 + timedelta(hours=5), "u", "c", 1.0), (T0 + timedelta(hours=20), "u", "c", 3.0)]
    out = timeseries.downsample(series(spark, rows), timedelta(hours=7), "demand_mw").orderBy("time").collect()
    assert [(r.time.hour, r.demand_mw) for r in out] == [(0, 1.0), (7, None), (14, 3.0)]


def test_window_bounds_with_offset(spark):
    rows = [(T0 + i * HOUR, "u", "c", float(i)) for i in range(12)]
    out = timeseries.between_times(series(spark, rows), "2023-12-31T18:00:00Z", None, "Asia/Shanghai")
    assert sorted(r.demand_mw for r in out.collect()) == [float(i) for i in range(2, 12)]


@pytest.mark.parametrize("width", [1, 2, 5, 24, 25])
def test_centred_mean_is_independent_of_blocks(spark, width):
    values = np.random.default_rng(width).random(200)
    df = spark.createDataFrame([(T0 + i * HOUR, "u", "c", float(v)) for i, v in enumerate(values)], "time timestamp_ntz, uid string, class string, v double")
    out = timeseries.centered_mean(df, width, HOUR, "v", "m", block_steps=30).orderBy("time").collect()
    want = [values[max(0, i - width // 2): i + width - 1 - width // 2 + 1].mean() for i in range(200)]
    assert np.allclose([r.m for r in out], want)


def test_run_of_river_arguments(spark):
    df = spark.createDataFrame([(T0, "u", 1.0)], "time timestamp_ntz, uid string, runoff double")
    for bad in ({"smoothing_steps": 0}, {"design_quantile": 1.0}, {"environmental_fraction": 1.0}):
        with pytest.raises(ValueError):
            timeseries.run_of_river(df, **{"smoothing_steps": 1, "design_quantile": 0.5, "environmental_fraction": 0.1, **bad})


def test_load_aggregation_conserves_and_missing_poisons(spark):
    rows = [(T0 + i * HOUR, u, c, float(i * 4 + 2 * j + k)) for i in range(3) for j, u in enumerate(("cell:a", "cell:b")) for k, c in enumerate(("x", "y"))]
    dim = spark.createDataFrame([("cell:a", "bus:1"), ("cell:b", "bus:1")], "uid string, bus_uid string")
    whole = aggregate.aggregate_load(series(spark, rows), dim, "bus")
    assert whole.agg(F.sum("demand_mw")).first()[0] == sum(range(12))
    assert {r.uid for r in whole.collect()} == {"bus:1"}
    gone = [(a, b, c, None if b == "cell:b" else v) for a, b, c, v in rows]
    assert all(r.demand_mw is None for r in aggregate.aggregate_load(series(spark, gone), dim, "bus").collect())


def test_load_checks_pass(spark):
    cell = [(T0, "cell:a", "x", 5.0), (T0, "cell:b", "x", 0.0)]
    bus = [(T0, "bus:1", "x", 5.0)]
    buses = spark.createDataFrame([("bus:1",)], "uid string")
    population = spark.createDataFrame([("cell:a", 100.0), ("cell:b", 0.0)], "spatial_uid string, population double")
    out = case.load_checks(series(spark, bus), series(spark, cell), buses, population)
    status = {r.name: r.status for r in out.collect()}
    assert status.pop("profile_quality") == "pass" and set(status.values()) == {"pass"}


def test_hot_key_percentiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    hot = np.concatenate([np.zeros(4000), rng.random(9000), np.full(3000, 0.5)])
    cold = rng.random(7)
    rows = [("hot", float(v)) for v in hot] + [("cold", float(v)) for v in cold] + [("cold", None), ("cold", float("nan"))]
    out = skew.exact_percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"a": 0.0, "m": 0.5, "p": 0.95, "z": 1.0}, slack=0.002)
    got = {r.k: (r.a, r.m, r.p, r.z) for r in out.collect()}
    for name, values in (("hot", hot), ("cold", cold)):
        assert np.allclose(got[name], np.quantile(values, [0, 0.5, 0.95, 1]))


def test_next_row_and_running_max_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(skew, "BLOCK", 4)
    df = spark.createDataFrame([("k", i, i * 10) for i in (0, 3, 4, 9, 21, 22)], "k string, pos int, v int")
    out = skew.with_next(df, ["k"], "pos", ["pos", "v"]).orderBy("pos").collect()
    assert [r.next.pos if r.next else None for r in out] == [3, 4, 9, 21, 22, None]
    run = skew.with_running_max(df, ["k"], "pos", F.when(F.col("pos") % 3 == 0, F.col("pos")), "m").orderBy("pos").collect()
    assert [r.m for r in run] == [0, 3, 3, 9, 21, 21]


def test_bus_choice_prefers_voltage_only_among_ties(spark):
    objects = spark.createDataFrame([("o1", 0.0, 0.0, "A", "c"), ("o2", 9.0, 0.0, None, "c")], "uid string, x double, y double, admin_uid string, spatial_uid string")
    buses = spark.createDataFrame(
        [("b1", 1.0, 0.0, "A", 220.0), ("b2", -1.0, 0.0, "A", 500.0), ("b3", 0.5, 0.0, "B", 1000.0), ("b4", -1.0, 0.0, "A", 500.0)],
        "uid string, x double, y double, admin_uid string, voltage_kv double",
    ).withColumns({"subclass": F.lit("station_bus"), "spatial_uid": F.lit("c")})
    pick = lambda **kw: {r.uid: r.bus_uid for r in mapping.objects_to_buses(objects, buses, **kw).collect()}
    assert pick() == {"o1": "b2", "o2": "b1"}
    assert pick(voltage_preference="low") == {"o1": "b1", "o2": "b1"}
    assert pick(prefer_same_admin=False)["o1"] == "b3"
    with pytest.raises(ValueError):
        mapping.objects_to_buses(objects, buses, bus_subclasses=["none"])


def test_ring_crosswalk_with_hole(spark):
    ring = lambda pts: [{"x": float(x), "y": float(y)} for x, y in pts]
    outer, hole = ring([(0, 0), (4, 0), (4, 4), (0, 4)]), ring([(1, 1), (3, 1), (3, 3), (1, 3)])
    src = spark.createDataFrame([("s", outer, 1), ("s", hole, -1)], f"uid string, ring {G.RING}, sign int")
    tri = spark.createDataFrame([("c", ring([(0, 0), (4, 0), (4, 4)]), 1)], f"spatial_uid string, ring {G.RING}, sign int")
    row = crosswalk.ring_crosswalk(src, tri, 1.5).first()
    assert row.source_area == 12.0 and row.target_area == 8.0 and abs(row.overlap_area - 6.0) < 1e-9
