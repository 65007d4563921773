"""Dissolving polygons by edge cancellation.

Rings of a group are walked with the inside on their left. An edge that occurs in both directions lies between
two parts and vanishes; what is left bounds the group. Edges are first cut where a vertex of the group lies on
them, so parts of different size share whole edges. Each remaining edge points at the next one (the leftmost turn,
which keeps parts that touch in a point apart), and pointer doubling finds the ring and the place of every
edge in as many joins as the longest ring has binary digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import cut_lineage
from .tiling import ring_segments, tile_keys, tile_of

ENDS = ("ax", "ay", "bx", "by")


def directed_edges(parts: DataFrame) -> DataFrame:
    """(key, ax, ay, bx, by, n): edges of ring parts (key, ring, sign) with the inside on the left."""
    turned = F.when(G.signed_ring_area("ring") * F.col("sign") < 0, F.reverse("ring")).otherwise(F.col("ring"))
    edges = ring_segments(parts.where(F.size("ring") >= 3).select("key", turned.alias("ring")), "key")
    return edges.where("ax != bx OR ay != by").groupBy("key", *ENDS).agg(F.count("*").alias("n"))


def noded(edges: DataFrame, tile: float) -> DataFrame:
    """Cut edges at the vertices of their group that lie on them."""
    boxed = edges.withColumns({"x0": F.least("ax", "bx"), "y0": F.least("ay", "by"), "x1": F.greatest("ax", "bx"), "y1": F.greatest("ay", "by")})
    vertices = edges.select("key", F.col("ax").alias("px"), F.col("ay").alias("py")).distinct()
    vertices = vertices.withColumns({"tile_x": tile_of("px", tile), "tile_y": tile_of("py", tile)})
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    qx, qy = F.col("px") - F.col("ax"), F.col("py") - F.col("ay")
    along = qx * dx + qy * dy
    on = (dx * qy - dy * qx == 0) & (along > 0) & (along < dx * dx + dy * dy)
    met = tile_keys(boxed, tile).join(vertices, ["key", "tile_x", "tile_y"]).where(on)
    cuts = met.groupBy("key", *ENDS).agg(F.array_sort(F.collect_set(F.struct(along.alias("t"), F.col("px").alias("x"), F.col("py").alias("y")))).alias("cuts"))
    whole = edges.join(cuts, ["key", *ENDS], "left")
    inner = F.transform("cuts", lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y")))
    line = F.concat(F.array(G.point("ax", "ay")), F.coalesce(inner, F.array().cast("array<struct<x:double,y:double>>")), F.array(G.point("bx", "by")))
    pairs = F.transform(F.sequence(F.lit(0), F.size("line") - 2), lambda i: F.struct(F.get("line", i).alias("a"), F.get("line", i + 1).alias("b")))
    pieces = whole.select("key", "n", line.alias("line")).select("key", "n", F.explode(pairs).alias("s"))
    return pieces.select("key", "n", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))


def boundary_edges(parts: DataFrame, tile: float) -> DataFrame:
    """Directed edges (key, ax, ay, bx, by) that bound each group."""
    pieces = noded(directed_edges(parts), tile)
    forward = (F.col("ax") < F.col("bx")) | ((F.col("ax") == F.col("bx")) & (F.col("ay") < F.col("by")))
    pick = lambda one, other: F.when(forward, F.col(one)).otherwise(F.col(other))
    lined = pieces.select(
        "key", pick("ax", "bx").alias("ax"), pick("ay", "by").alias("ay"), pick("bx", "ax").alias("bx"), pick("by", "ay").alias("by"),
        F.when(forward, F.col("n")).otherwise(-F.col("n")).alias("n"),
    )
    left = lined.groupBy("key", *ENDS).agg(F.sum("n").alias("n")).where("n != 0")
    back = F.col("n") < 0
    pick = lambda one, other: F.when(back, F.col(other)).otherwise(F.col(one))
    return left.select("key", pick("ax", "bx").alias("ax"), pick("ay", "by").alias("ay"), pick("bx", "ax").alias("bx"), pick("by", "ay").alias("by"))


def _turn(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Angle from direction (a, b) to direction (c, d), left turns positive."""
    return F.atan2(a * d - b * c, a * c + b * d)


def ranked_rings(edges: DataFrame) -> DataFrame:
    """Edges with `ring_id` (the smallest edge number of the ring) and `pos`, their place behind that edge."""
    numbered = cut_lineage(edges.withColumn("id", F.monotonically_increasing_id()))
    to = numbered.select("key", F.col("id").alias("nxt"), F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("bx").alias("cx"), F.col("by").alias("cy"))
    turn = _turn(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("cx") - F.col("bx"), F.col("cy") - F.col("by"))
    state = numbered.join(to, ["key", "bx", "by"]).groupBy("id").agg(F.max_by("nxt", F.struct(turn, "nxt")).alias("nxt"))
    state = cut_lineage(state.select("id", "nxt", F.col("id").alias("low"), F.lit(0).cast("long").alias("ahead"), F.lit(True).alias("changed")))
    step = 1
    while not state.where("changed").isEmpty():
        # After a round, an edge knows the smallest of the next 2 * step edges and how far ahead it lies.
        other = state.select(F.col("id").alias("nxt"), F.col("nxt").alias("after"), F.col("low").alias("also"), F.col("ahead").alias("further"))
        smaller = F.col("also") < F.col("low")
        state = cut_lineage(state.join(other, "nxt").select(
            "id", F.col("after").alias("nxt"), F.least("low", "also").alias("low"),
            F.when(smaller, F.col("further") + step).otherwise(F.col("ahead")).alias("ahead"), smaller.alias("changed"),
        ))
        step *= 2
    sizes = state.groupBy("low").agg(F.count("*").alias("size"))
    placed = state.join(sizes, "low").select("id", F.col("low").alias("ring_id"), F.pmod(-F.col("ahead"), "size").alias("pos"))
    return numbered.join(placed, "id")


def _straightened(ring: Column) -> Column:
    """Ring without the vertices on a straight run."""
    n = F.size(ring)

    def bends(p: Column, i: Column) -> Column:
        before, after = F.get(ring, F.pmod(i + n - 1, n)), F.get(ring, F.pmod(i + 1, n))
        return (p["x"] - before["x"]) * (after["y"] - p["y"]) - (p["y"] - before["y"]) * (after["x"] - p["x"]) != 0

    return F.filter(ring, bends)


def dissolved(parts: DataFrame, tile: float) -> DataFrame:
    """Parts (key, ring, sign) that don't overlap to the rings of each key's union.

    Rows (key, ring, sign, area, perimeter): outer rings run counter-clockwise with sign 1, holes clockwise
    with sign -1. A tile should have about the size of an edge; it changes no result.
    """
    edges = ranked_rings(boundary_edges(parts, tile))
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    rings = edges.groupBy("key", "ring_id").agg(F.array_sort(F.collect_list(F.struct("pos", "ax", "ay"))).alias("r"), F.sum(length).alias("perimeter"))
    ring = F.transform("r", lambda e: F.struct(e["ax"].alias("x"), e["ay"].alias("y")))
    out = rings.select("key", ring.alias("ring"), "perimeter").withColumn("a", G.signed_ring_area("ring"))
    return out.select("key", _straightened(F.col("ring")).alias("ring"), F.signum("a").cast("int").alias("sign"), F.abs("a").alias("area"), "perimeter")


def dissolved_cells(parts: DataFrame, tile: float) -> DataFrame:
    """Cell parts (admin_uid, spatial_level, source_cell_uid, ring, sign) as one geometry per cell."""
    key = F.struct("admin_uid", "spatial_level", "source_cell_uid")
    return dissolved(parts.select(key.alias("key"), "ring", "sign"), tile).select("key.*", "ring", "sign", "area", "perimeter")


def background_outline(parts: DataFrame, tile: float, by: tuple[str, ...] = ("spatial_level",)) -> DataFrame:
    """Outline of all cells of a group, for a map's background."""
    return dissolved(parts.select(F.struct(*by).alias("key"), "ring", "sign"), tile).select("key.*", "ring", "sign", "area", "perimeter")
