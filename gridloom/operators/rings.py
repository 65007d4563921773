"""Nearest positions by rings of neighbour cells.

Each partition has a grid of its own over its right positions, with nested levels of 4 x 4 cells. The start
level is the one at which no cell holds more than `LEAF` positions. A left position looks up its cell and the eight
around it by an equi-join. What lies outside is farther away than the ring's border, so a partner inside that
distance is final. The others go on:

- with a partner beyond the border, the cells up to that distance are looked up (a ring of three at most);
- with an empty ring, the finest coarser level with an occupied cell around gives a bound, and the occupied
  cells within the bound are followed down, kept only while they can still hold the nearest position.

So the pairs per left position are bounded by the ring, wherever positions crowd. Equal distances are all
returned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

FAN, LEAF, DEEPEST = 4, 16, 25
SELF = ("part", "x", "y")
GRID = ("gx", "gy", "extent")
SLACK = 1 + 1e-9


def _size(level: Column | int) -> Column:
    return F.col("extent") / F.pow(F.lit(float(FAN)), level if isinstance(level, Column) else F.lit(level))


def _cell(axis: str, level: Column | int) -> Column:
    """Cell number of a position on a level; scaling by powers of two keeps levels nested exactly."""
    origin = {"x": "gx", "y": "gy"}[axis]
    return F.floor((F.col(axis) - F.col(origin)) / F.col("extent") * F.pow(F.lit(float(FAN)), level if isinstance(level, Column) else F.lit(level))).cast("long")


def _gap(level: Column | int) -> Column:
    """Smallest distance from a position to cell (cx, cy)."""
    s = _size(level)
    x0, y0 = F.col("cx") * s + F.col("gx"), F.col("cy") * s + F.col("gy")
    return F.hypot(F.greatest(x0 - F.col("x"), F.col("x") - x0 - s, F.lit(0.0)), F.greatest(y0 - F.col("y"), F.col("y") - y0 - s, F.lit(0.0)))


def _reach(level: Column | int) -> Column:
    """Largest distance from a position to cell (cx, cy)."""
    s = _size(level)
    x0, y0 = F.col("cx") * s + F.col("gx"), F.col("cy") * s + F.col("gy")
    return F.hypot(F.greatest(F.abs(F.col("x") - x0), F.abs(F.col("x") - x0 - s)), F.greatest(F.abs(F.col("y") - y0), F.abs(F.col("y") - y0 - s)))


def _around(df: DataFrame, level: Column | int, width: int) -> DataFrame:
    """One row per cell (cx, cy) in the square of that many cells on each side."""
    steps = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-width, width + 1) for j in range(-width, width + 1)]
    out = df.withColumn("__s", F.explode(F.array(*steps)))
    return out.withColumn("cx", _cell("x", level) + F.col("__s.i")).withColumn("cy", _cell("y", level) + F.col("__s.j")).drop("__s")


def _within(reach: Column | str) -> Column:
    return (F.col(reach) if isinstance(reach, str) else reach) * SLACK + 1e-9


def _grids(right: DataFrame) -> DataFrame:
    extent = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-9)) * SLACK
    return right.groupBy("part").agg(F.min("x").alias("gx"), F.min("y").alias("gy"), extent.alias("extent"), F.count("*").alias("n"))


def _depth(placed: DataFrame, most: int) -> int:
    """First level at which no cell holds more than `LEAF` positions."""
    depth = max(0, min(DEEPEST, math.ceil(math.log(max(most / LEAF, 1), FAN * FAN))))
    while depth < DEEPEST:
        if placed.groupBy("part", _cell("x", depth), _cell("y", depth)).count().agg(F.max("count")).first()[0] <= LEAF:
            break
        depth += 1
    return depth


def _best(pairs: DataFrame) -> DataFrame:
    """The nearest partners of each left position; a ring holds a bounded number of candidates."""
    dx, dy = F.col("x") - F.col("rx"), F.col("y") - F.col("ry")
    # The root of the sum, which every engine rounds alike; hypot may differ in the last digit, which decides ties.
    found = pairs.withColumn("distance", F.sqrt(dx * dx + dy * dy))
    lists = found.groupBy(*SELF, *GRID).agg(F.min("distance").alias("distance"), F.collect_set(F.struct("distance", "rx", "ry")).alias("all"))
    return lists.withColumn("all", F.filter("all", lambda c: c["distance"] <= F.col("distance")))


def nearest_positions(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct positions (part, x, y) to nearest distinct positions: part, x, y, rx, ry, distance.

    Left positions whose partition has no right position are absent.
    """
    right = cut_lineage(right)
    grids = _grids(right)
    most = grids.agg(F.max("n")).first()[0]
    if not most:
        return left.limit(0).select(*SELF, F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("x").alias("distance"))
    grids = grids.select("part", *GRID)
    placed = right.join(grids, "part")
    depth = _depth(placed, most)
    leaves = placed.select("part", _cell("x", depth).alias("cx"), _cell("y", depth).alias("cy"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    asked = left.join(grids, "part").select(*SELF, *GRID)
    met = _around(asked, depth, 1).join(leaves, ["part", "cx", "cy"])
    s = _size(depth)
    edge = F.least(*[F.col(a) - (_cell(a, depth) - 1) * s - F.col(g) for a, g in (("x", "gx"), ("y", "gy"))], *[(_cell(a, depth) + 2) * s + F.col(g) - F.col(a) for a, g in (("x", "gx"), ("y", "gy"))])
    first = cut_lineage(_best(met).withColumn("final", F.col("distance") * SLACK < edge))
    done = first.where("final")
    near = first.where("NOT final").select(*SELF, *GRID, F.col("distance").alias("reach"))
    more = _around(near, depth, 3).where(_gap(depth) <= _within("reach")).join(leaves, ["part", "cx", "cy"])
    out = _unfolded(done).unionByName(_unfolded(_best(more)))
    empty = asked.join(first.select(*SELF), [*SELF], "left_anti")
    if depth and not empty.isEmpty():
        out = out.unionByName(_unfolded(_best(_followed(cut_lineage(empty), placed, depth).join(leaves, ["part", "cx", "cy"]))))
    elif not depth:
        out = out.unionByName(_unfolded(_best(empty.withColumns({"cx": F.lit(0).cast("long"), "cy": F.lit(0).cast("long")}).join(leaves, ["part", "cx", "cy"]))))
    return out


def _unfolded(lists: DataFrame) -> DataFrame:
    return lists.select(*SELF, F.explode("all").alias("c")).select(*SELF, "c.rx", "c.ry", "c.distance")


def _followed(empty: DataFrame, placed: DataFrame, depth: int) -> DataFrame:
    """Leaf cells that can hold the nearest partner of positions with an empty ring on the start level."""
    level = F.col("level")
    levels = placed.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    occupied = cut_lineage(levels.select("part", "level", _cell("x", level).alias("cx"), _cell("y", level).alias("cy")).distinct())
    tried = _around(empty.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth - 1)))), level, 1)
    hits = tried.join(occupied, ["part", "level", "cx", "cy"]).withColumn("reach", _reach(level))
    found = hits.groupBy(*SELF).agg(F.max("level").alias("level"), F.min_by("reach", F.struct(-level, F.col("reach"))).alias("reach"))
    # Positions far outside of the grid begin with its only cell on level 0.
    known = empty.join(found, [*SELF], "left")
    inside = _around(known.where("level IS NOT NULL"), level, 3).where(_gap(level) <= _within("reach"))
    outside = known.where("level IS NULL").withColumns({"level": F.lit(0), "cx": F.lit(0).cast("long"), "cy": F.lit(0).cast("long")})
    columns = [*SELF, *GRID, "level", "cx", "cy"]
    entering = cut_lineage(inside.select(columns).unionByName(outside.select(columns)).join(occupied, ["part", "level", "cx", "cy"], "left_semi"))
    frontier = None
    for k in range(depth + 1):
        here = entering.where(level == k).drop("level")
        frontier = here if frontier is None else frontier.unionByName(here)
        if k == depth:
            break
        frontier = _kept(frontier, k)
        children = occupied.where(level == k + 1).select("part", F.floor(F.col("cx") / FAN).alias("px"), F.floor(F.col("cy") / FAN).alias("py"), F.col("cx").alias("kx"), F.col("cy").alias("ky"))
        frontier = frontier.withColumnsRenamed({"cx": "px", "cy": "py"}).join(children, ["part", "px", "py"]).drop("px", "py").withColumnsRenamed({"kx": "cx", "ky": "cy"})
    return _kept(frontier, depth)


def _kept(frontier: DataFrame, level: int) -> DataFrame:
    """Cells whose smallest distance does not exceed the smallest largest distance of the position's cells."""
    rows = frontier.withColumns({"near": _gap(level), "far": _reach(level)})
    lists = rows.groupBy(*SELF, *GRID).agg(F.min("far").alias("best"), F.collect_list(F.struct("near", "cx", "cy")).alias("cells"))
    return lists.select(*SELF, *GRID, F.explode(F.filter("cells", lambda c: c["near"] <= _within("best"))).alias("c")).select(*SELF, *GRID, "c.cx", "c.cy")
