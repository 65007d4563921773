"""Tile-key joins for boxes, points, rings and segments: an equi-join on grid cells, never a cross join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

BOX = ("x0", "y0", "x1", "y1")


def tile_of(c: Column | str, size: float | Column) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / size).cast("long")


def tile_keys(df: DataFrame, size: float, box: tuple[str, str, str, str] = BOX) -> DataFrame:
    """One row per tile touched by the box of a row."""
    x0, y0, x1, y1 = box
    return df.withColumn(
        "tile_x", F.explode(F.sequence(tile_of(x0, size), tile_of(x1, size)))
    ).withColumn("tile_y", F.explode(F.sequence(tile_of(y0, size), tile_of(y1, size))))


def mean_extent(df: DataFrame, box: tuple[str, str, str, str] = BOX) -> float:
    """Mean box side: a tile of about this size gives each object a handful of tiles."""
    x0, y0, x1, y1 = box
    side = F.greatest(F.col(x1) - F.col(x0), F.col(y1) - F.col(y0))
    value = df.agg(F.avg(side)).first()[0]
    return float(value) if value else 1.0


def overlap_pairs(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """Pairs of boxes with a common area. Columns of both sides must differ: `l_x0…` and `r_x0…`.

    Each pair is emitted once, by the tile that holds the lower-left corner of the overlap.
    """
    lt = tile_keys(left, size, ("l_x0", "l_y0", "l_x1", "l_y1"))
    rt = tile_keys(right, size, ("r_x0", "r_y0", "r_x1", "r_y1"))
    ix0, iy0 = F.greatest("l_x0", "r_x0"), F.greatest("l_y0", "r_y0")
    return (
        lt.join(rt, ["tile_x", "tile_y"])
        .where((F.least("l_x1", "r_x1") > ix0) & (F.least("l_y1", "r_y1") > iy0))
        .where((F.col("tile_x") == tile_of(ix0, size)) & (F.col("tile_y") == tile_of(iy0, size)))
        .drop("tile_x", "tile_y")
    )


def size_class_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of boxes (l_x0 … and r_x0 …) that meet, borders included, whatever their sizes are.

    A box belongs to the level whose squares (side 2^level) are no smaller than it, so it touches four of them at
    most, there and on every coarser level. A pair meets on the coarser of its two levels, by an equi-join on the
    square, and is kept by the square that holds the lower-left corner of the common part. A continental box
    thus is a few rows of a coarse level instead of all tiles of a city's size.
    """
    level = lambda p: F.ceil(F.log2(F.greatest(F.col(f"{p}_x1") - F.col(f"{p}_x0"), F.col(f"{p}_y1") - F.col(f"{p}_y0"), F.lit(1e-9)))).cast("int")
    l, r = left.withColumn("l_level", level("l")), right.withColumn("r_level", level("r"))
    levels = l.select(F.col("l_level").alias("v")).union(r.select("r_level")).distinct().agg(F.array_sort(F.collect_set("v")).alias("levels"))

    def keyed(df: DataFrame, p: str) -> DataFrame:
        # There are few levels: one per doubling of the size.
        known = df.withColumn("__one", F.lit(1)).join(levels.withColumn("__one", F.lit(1)), "__one").drop("__one")
        at = known.withColumn("__level", F.explode(F.filter("levels", lambda v: v >= F.col(f"{p}_level")))).drop("levels")
        side = F.pow(F.lit(2.0), F.col("__level"))
        span = lambda a: F.explode(F.sequence(tile_of(f"{p}_{a}0", side), tile_of(f"{p}_{a}1", side)))
        return at.withColumn("tile_x", span("x")).withColumn("tile_y", span("y"))

    ix0, iy0, side = F.greatest("l_x0", "r_x0"), F.greatest("l_y0", "r_y0"), F.pow(F.lit(2.0), F.col("__level"))
    return (
        keyed(l, "l").join(keyed(r, "r"), ["__level", "tile_x", "tile_y"])
        .where(F.col("__level") == F.greatest("l_level", "r_level"))
        .where((F.least("l_x1", "r_x1") >= ix0) & (F.least("l_y1", "r_y1") >= iy0))
        .where((F.col("tile_x") == tile_of(ix0, side)) & (F.col("tile_y") == tile_of(iy0, side)))
        .drop("__level", "tile_x", "tile_y", "l_level", "r_level")
    )


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """Point (x, y) and box (x0…y1) pairs where the closed box holds the point."""
    p = points.withColumn("tile_x", tile_of("x", size)).withColumn("tile_y", tile_of("y", size))
    b = tile_keys(boxes, size)
    x, y = F.col("x"), F.col("y")
    return (
        p.join(b, ["tile_x", "tile_y"])
        .where((x >= F.col("x0")) & (x <= F.col("x1")) & (y >= F.col("y0")) & (y <= F.col("y1")))
        .drop("tile_x", "tile_y")
    )


def points_in_rings(points: DataFrame, rings: DataFrame, size: float, key: str) -> DataFrame:
    """Point and polygon pairs; `rings` holds (key, ring, sign) rows, holes with sign -1."""
    boxed = rings.select(key, "ring", "sign", *G.bbox("ring"))
    pairs = points_in_boxes(points, boxed, size)
    inside = F.when(G.point_in_ring("x", "y", "ring"), F.col("sign")).otherwise(F.lit(0))
    return (
        pairs.groupBy(*points.columns, key).agg(F.sum(inside).alias("__hits")).where("__hits > 0").drop("__hits")
    )


def line_box_lengths(segments: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """Length of each segment (ax, ay, bx, by) inside each box that it crosses."""
    s = segments.select(
        "*",
        F.least("ax", "bx").alias("l_x0"), F.least("ay", "by").alias("l_y0"),
        F.greatest("ax", "bx").alias("l_x1"), F.greatest("ay", "by").alias("l_y1"),
    )
    b = boxes.select(
        *[c for c in boxes.columns if c not in BOX],
        *[F.col(c).alias("r_" + c) for c in BOX],
    )
    lt = tile_keys(s, size, ("l_x0", "l_y0", "l_x1", "l_y1"))
    rt = tile_keys(b, size, ("r_x0", "r_y0", "r_x1", "r_y1"))
    ix0, iy0 = F.greatest("l_x0", "r_x0"), F.greatest("l_y0", "r_y0")
    length = G.segment_box_length("ax", "ay", "bx", "by", "r_x0", "r_y0", "r_x1", "r_y1")
    return (
        lt.join(rt, ["tile_x", "tile_y"])
        .where((F.least("l_x1", "r_x1") >= ix0) & (F.least("l_y1", "r_y1") >= iy0))
        .where((F.col("tile_x") == tile_of(ix0, size)) & (F.col("tile_y") == tile_of(iy0, size)))
        .withColumn("inside_length", length)
        .where("inside_length > 0")
        .drop("tile_x", "tile_y", *[f"{p}_{c}" for p in "lr" for c in BOX])
    )


def segments_of(lines: DataFrame, key: str, line: str) -> DataFrame:
    """One row per straight piece of a line: (key, piece, ax, ay, bx, by)."""
    pieces = F.transform(
        F.sequence(F.lit(0), F.size(line) - 2),
        lambda i: F.struct(i.alias("piece"), F.get(F.col(line), i).alias("a"), F.get(F.col(line), i + 1).alias("b")),
    )
    return (
        lines.where(F.size(line) >= 2)
        .select(key, F.explode(pieces).alias("s"))
        .select(
            key, F.col("s.piece").alias("piece"),
            F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"),
            F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"),
        )
    )


def ring_segments(rings: DataFrame, key: str, ring: str = "ring") -> DataFrame:
    closed = rings.withColumn("__closed", F.concat(F.col(ring), F.slice(F.col(ring), 1, 1)))
    return segments_of(closed, key, "__closed")
