"""Map overlay: owners by priority against exact areas of hand-made and random polygons."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import dissolve, overlay

SCHEMA = "admin_uid string, level string, ring array<struct<x:double,y:double>>, sign int"


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def units(spark, *rows):
    return spark.createDataFrame([(u, level, [{"x": float(x), "y": float(y)} for x, y in ring], sign) for u, level, ring, sign in rows], SCHEMA)


def areas(parts):
    return {(r.level, r.admin_uid): r.a for r in parts.groupBy("level", "admin_uid").agg(F.sum("area").alias("a")).collect()}


@pytest.mark.parametrize("tile", [0.7, 3.0, 100.0])
def test_level_differences_of_polygons(spark, tile):
    """A triangle keeps its area; a ring with a hole loses what the triangle takes; a square in the hole is whole."""
    rows = units(
        spark, ("t", "high", [(0, 0), (4, 0), (0, 4)], 1), ("r", "low", box(-2, -2, 6, 6), 1), ("r", "low", box(3, 3, 5, 5), -1),
        ("s", "lowest", box(3.5, 3.5, 4.5, 4.5), 1), ("gone", "lowest", box(0.5, 0.5, 1, 1), 1), ("x", "unknown", box(0, 0, 9, 9), 1),
    )
    got = areas(overlay.level_differences(rows, ["high", "low", "lowest"], tile))
    assert got == pytest.approx({("high", "t"): 8.0, ("low", "r"): 64 - 4 - 8, ("lowest", "s"): 1.0})


def test_same_level_removal(spark):
    rows = units(spark, ("a", "p", box(0, 0, 2, 2), 1), ("b", "p", box(1.9, 0, 4, 2), 1), ("c", "q", box(0, 0, 4, 4), 1))
    parts = overlay.disjoint_units(rows, 1.5, 0.5)
    assert areas(parts) == pytest.approx({("p", "a"): 4.0, ("p", "b"): 4.0, ("q", "c"): 16.0})
    with pytest.raises(ValueError, match="overlap"):
        overlay.disjoint_units(rows, 1.5, 0.1)


def test_random_polygons_close(spark):
    """Pieces don't overlap, add up to the union, and belong to the first covering unit (checked on points)."""
    rng = random.Random(4)
    rows = []
    for k in range(30):
        cx, cy, n = rng.uniform(0, 10), rng.uniform(0, 10), rng.randrange(3, 9)
        at = sorted(rng.uniform(0, 6.28) for _ in range(n))
        rows.append((f"u{k:02d}", rng.choice("ab"), [(cx + rng.uniform(1, 3) * np.cos(t), cy + rng.uniform(1, 3) * np.sin(t)) for t in at], 1))
    parts = [(r.level, r.admin_uid, [(p.x, p.y) for p in r.ring]) for r in overlay.level_differences(units(spark, *rows), ["b", "a"], 2.5).collect()]

    def holds(ring, x, y):
        odd = False
        for (xa, ya), (xb, yb) in zip(ring, ring[1:] + ring[:1]):
            if (ya > y) != (yb > y) and x < xa + (y - ya) * (xb - xa) / (yb - ya):
                odd = not odd
        return odd

    for _ in range(1500):
        x, y = rng.uniform(-3, 13), rng.uniform(-3, 13)
        cover = sorted((level != "b", u) for u, level, ring, _ in rows if holds(ring, x, y))
        assert [u for _, u, ring in parts if holds(ring, x, y)] == [u for _, u in cover[:1]]


def test_crowded_and_stacked_tiles(spark, monkeypatch):
    """Tiles with many vertices are cut; copies of one shape are one row per tile."""
    monkeypatch.setattr(overlay, "VERTICES", 40)
    rows = [(f"u{i:04d}", "p", box(i % 20, i // 20, i % 20 + 1, i // 20 + 1), 1) for i in range(400)]
    rows += [(f"v{i:04d}", "p", box(0, 0, 20, 20), 1) for i in range(300)]
    got = areas(overlay.disjoint_units(units(spark, *rows), 20.0, 500.0))
    assert len(got) == 400 and all(a == pytest.approx(1.0) for a in got.values())


def rings(df):
    return sorted((r.key, r.sign, round(r.area, 9), round(r.perimeter, 9), len(r.ring)) for r in df.collect())


def test_dissolve_cancels_shared_edges(spark):
    """Parts of different size share pieces of edges; holes stay; parts that touch in a point stay apart."""
    rows = [("a", box(0, 0, 2, 2), 1), ("a", box(2, 0, 3, 1), 1), ("a", box(2, 1, 3, 2), 1), ("b", box(0, 0, 1, 1), 1), ("b", box(1, 1, 2, 2), 1)]
    rows += [("c", box(i % 5, i // 5, i % 5 + 1, i // 5 + 1)[:: 1 if i % 2 else -1], 1) for i in range(25) if i not in (6, 12)]
    rows += [("d", box(0, 0, 9, 9), 1), ("d", box(3, 3, 6, 6), -1)]
    parts = spark.createDataFrame([(k, [{"x": float(x), "y": float(y)} for x, y in r], s) for k, r, s in rows], "key string, ring array<struct<x:double,y:double>>, sign int")
    want = [("a", 1, 6.0, 10.0, 4), ("b", 1, 1.0, 4.0, 4), ("b", 1, 1.0, 4.0, 4), ("d", -1, 9.0, 12.0, 4), ("d", 1, 81.0, 36.0, 4)]
    for tile in (0.8, 50.0):
        got = rings(dissolve.dissolved(parts, tile))
        assert [g for g in got if g[0] != "c"] == want
        assert sum(g[1] * g[2] for g in got if g[0] == "c") == 23.0 and sum(g[3] for g in got if g[0] == "c") == 28.0
    assert dissolve.dissolved(parts.limit(0), 1.0).count() == 0


def test_dissolve_of_slanted_pieces(spark):
    """Overlay pieces of a triangle dissolve to the triangle again."""
    unit = units(spark, ("t", "p", [(0, 0), (8, 0), (0, 8)], 1))
    parts = overlay.disjoint_units(unit, 2.0, 0.0).select("level", "ring", F.lit(1).alias("sign")).withColumnRenamed("level", "key")
    got = rings(dissolve.dissolved(parts, 2.0))
    assert sum(g[2] * g[1] for g in got) == pytest.approx(32.0)


def test_long_ring(spark):
    """A comb of 400 teeth is one ring: the number of rounds is the number of binary digits of its length."""
    rows = [("k", [{"x": float(x), "y": float(y)} for x, y in box(i, 0, i + 1, 1 + i % 2)], 1) for i in range(400)]
    parts = spark.createDataFrame(rows, "key string, ring array<struct<x:double,y:double>>, sign int")
    (r,) = dissolve.dissolved(parts, 1.0).collect()
    assert (r.sign, r.area, len(r.ring)) == (1, 600.0, 802) and r.perimeter == 400 + 400 + 1 + 2 + 399
