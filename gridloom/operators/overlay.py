"""Map overlay by slabs per tile: every point of a map goes to the first of the units that cover it.

Rings are clipped to square tiles, and tiles with many vertices are cut in four until they hold few. A tile is
cut at the x of all vertices and crossings into vertical slabs; inside a slab, edges have one order from bottom to
top, and the area between two neighbours is covered by the same units throughout. That gives exact trapezoids,
which are joined again where the same two edges bound the same owner.

Units with the same shape are told apart by their rank before they are clipped, and again inside a tile before
it is gathered, so stacked copies never fill a task.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import cut_lineage
from .skew import dealt, require_none
from .tiling import tile_of

#: Vertices of a tile beyond which it is cut in four, and how often that is done.
VERTICES, CUTS = 600, 16
TILE = ("layer", "step", "ix", "iy")
RING = "array<struct<x:double,y:double>>"


def clipped_parts(units: DataFrame, tile: float) -> DataFrame:
    """Units (layer, rank, uid, ring, sign) to ring parts per tile. `step` counts how often a tile was cut."""
    boxed = dealt(units.select("layer", "rank", "uid", "sign", "ring", *G.bbox("ring")), "uid")
    ix = F.explode(F.sequence(tile_of("x0", tile), tile_of("x1", tile)))
    iy = F.explode(F.sequence(tile_of("y0", tile), tile_of("y1", tile)))
    parts = _clipped(boxed.withColumn("ix", ix).withColumn("iy", iy).withColumn("step", F.lit(0)).drop("x0", "y0", "x1", "y1"), tile)
    done = []
    for _ in range(CUTS):
        parts = cut_lineage(parts)
        crowded = cut_lineage(_crowded(parts))
        if crowded.isEmpty():
            break
        done.append(parts.join(crowded, [*TILE], "left_anti"))
        quarter = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
        cut = parts.join(crowded, [*TILE], "left_semi").withColumn("q", quarter)
        parts = _clipped(cut.withColumns({"ix": F.col("ix") * 2 + F.col("q.a"), "iy": F.col("iy") * 2 + F.col("q.b"), "step": F.col("step") + 1}).drop("q"), tile)
    for some in done:
        parts = parts.unionByName(some)
    return parts


def _clipped(rows: DataFrame, tile: float) -> DataFrame:
    size = F.lit(float(tile)) / F.pow(F.lit(2.0), F.col("step"))
    x0, y0 = F.col("ix") * size, F.col("iy") * size
    out = rows.withColumn("ring", G.once(G.clip_ring("ring", x0, y0, x0 + size, y0 + size)))
    return out.where((F.size("ring") >= 3) & (G.ring_area("ring") > 0)).select(*TILE, "rank", "uid", "ring", "sign")


def _crowded(parts: DataFrame) -> DataFrame:
    """Tiles with too many distinct vertices to be taken as a whole."""
    points = parts.select(*TILE, F.explode("ring").alias("p")).groupBy(*TILE, "p.x", "p.y").agg(F.lit(1).alias("one"))
    return points.groupBy(*TILE).agg(F.count("*").alias("n")).where(F.col("n") > VERTICES).drop("n")


def slab_owners(shapes: Sequence[tuple[str, Sequence[tuple[np.ndarray, int]]]]) -> list[tuple[str, list[tuple[float, float]]]]:
    """Trapezoids (owner, corners) of one tile. Shapes are (uid, [(ring, sign), …]), the first ones own first."""
    edges, turns = [], []
    for k, (_, rings) in enumerate(shapes):
        for r, (ring, sign) in enumerate(rings):
            nxt = np.roll(ring, -1, axis=0)
            for (xa, ya), (xb, yb) in zip(ring.tolist(), nxt.tolist()):
                if xa != xb:
                    edges.append((xa, ya, xb, yb) if xa < xb else (xb, yb, xa, ya))
                    turns.append((k, r, sign))
    if not edges:
        return []
    e = np.array(edges)
    lean = (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
    base = e[:, 1] - lean * e[:, 0]
    xs = [e[:, 0], e[:, 2]]
    # Crossings of edges whose x ranges overlap.
    with np.errstate(divide="ignore", invalid="ignore"):
        for i in range(len(e)):
            x = (base[i + 1 :] - base[i]) / (lean[i] - lean[i + 1 :])
            lo, hi = np.maximum(e[i, 0], e[i + 1 :, 0]), np.minimum(e[i, 2], e[i + 1 :, 2])
            xs.append(x[(x > lo) & (x < hi)])
    xs = np.unique(np.concatenate(xs))
    # Events closer than rounding are one.
    xs = xs[np.concatenate(([True], np.diff(xs) > 1e-12 * max(1.0, float(np.abs(xs).max()))))]
    y_at = lambda i, x: float(e[i, 1] + (x - e[i, 0]) * lean[i])
    open_now: dict[tuple[int, int, int], float] = {}
    out = []

    def close(key: tuple[int, int, int], start: float, end: float) -> None:
        k, low, high = key
        out.append((shapes[k][0], [(start, y_at(low, start)), (end, y_at(low, end)), (end, y_at(high, end)), (start, y_at(high, start))]))

    for x0, x1 in zip(xs[:-1].tolist(), xs[1:].tolist()):
        middle = (x0 + x1) / 2
        spanning = np.flatnonzero((e[:, 0] < middle) & (e[:, 2] > middle))
        heights = e[spanning, 1] + (middle - e[spanning, 0]) * lean[spanning]
        order = np.argsort(heights, kind="stable")
        inside: dict[tuple[int, int], bool] = {}
        cover: dict[int, int] = {}
        covering: list[int] = []
        owner, low, low_height = None, -1, 0.0
        found: list[tuple[int, int, int]] = []
        for i, height in zip(spanning[order].tolist(), heights[order].tolist()):
            k, r, sign = turns[i]
            now = not inside.get((k, r), False)
            inside[k, r] = now
            before = cover.get(k, 0)
            cover[k] = before + (sign if now else -sign)
            if before <= 0 < cover[k]:
                insort(covering, k)
            elif cover[k] <= 0 < before:
                covering.pop(bisect_left(covering, k))
            first = covering[0] if covering else None
            if first != owner:
                if owner is not None and height > low_height:
                    found.append((owner, low, i))
                owner, low, low_height = first, i, height
        after = {}
        for key in found:
            after[key] = open_now.pop(key, x0)
        for key, start in open_now.items():
            close(key, start, x0)
        open_now = after
    for key, start in open_now.items():
        close(key, start, float(xs[-1]))
    return out


def _owned(key, rows):
    """Group of one tile to its trapezoids."""
    tile = [k.as_py() for k in key]
    order = sorted(zip(rows.column("rank").to_pylist(), rows.column("uid").to_pylist(), rows.column("shape").to_pylist()), key=lambda r: r[:2])
    shapes = [(uid, [(np.array([(p["x"], p["y"]) for p in part["ring"]]), part["sign"]) for part in shape]) for _, uid, shape in order]
    found = slab_owners(shapes)
    rings = [[{"x": x, "y": y} for x, y in ring] for _, ring in found]
    n = len(found)
    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    return pa.table({
        "layer": pa.array([tile[0]] * n, pa.string()), "uid": pa.array([u for u, _ in found], pa.string()), "ring": pa.array(rings, pa.list_(point)),
    })


def owned_parts(units: DataFrame, tile: float) -> DataFrame:
    """Rows (layer, uid, ring, area): parts of the map by owner, the covering unit with the least (rank, uid).

    units: layer, rank (int), uid, ring, sign (holes -1). Layers don't meet each other. Parts are
    convex quadrilaterals or triangles that don't overlap; a unit without a part is covered by others.
    """
    shapes = clipped_parts(leading_units(units), tile).groupBy(*TILE, "rank", "uid").agg(F.array_sort(F.collect_list(F.struct("sign", "ring"))).alias("shape"))
    first = F.struct("rank", "uid")
    alike = shapes.groupBy(*TILE, F.md5(F.to_json("shape")).alias("same")).agg(F.min(first).alias("one"), F.min_by("shape", first).alias("shape"))
    tiles = alike.select(*TILE, "one.rank", "one.uid", "shape")
    out = tiles.groupBy(*TILE).applyInArrow(_owned, f"layer string, uid string, ring {RING}")
    return out.withColumn("area", G.ring_area("ring")).where("area > 0")


def leading_units(units: DataFrame) -> DataFrame:
    """Units (layer, rank, uid, ring, sign) without copies: of equal shapes only the first can own anything."""
    prints = units.groupBy("layer", "rank", "uid").agg(F.array_sort(F.collect_list(F.md5(F.to_json(F.struct("sign", "ring"))))).alias("prints"))
    first = prints.groupBy("layer", F.md5(F.array_join("prints", "")).alias("shape")).agg(F.min(F.struct("rank", "uid")).alias("one"))
    return units.join(first.select("layer", "one.rank", "one.uid"), ["layer", "rank", "uid"], "left_semi")


def kept_areas(units: DataFrame, parts: DataFrame) -> DataFrame:
    """(layer, uid, own_area, kept_area, removed_area) of every unit."""
    own = units.groupBy("layer", "uid").agg(F.sum(G.ring_area("ring") * F.col("sign")).alias("own_area"))
    kept = parts.groupBy("layer", "uid").agg(F.sum("area").alias("kept_area"))
    out = own.join(kept, ["layer", "uid"], "left").withColumn("kept_area", F.coalesce("kept_area", F.lit(0.0)))
    return out.withColumn("removed_area", F.col("own_area") - F.col("kept_area"))


def disjoint_units(units: DataFrame, tile: float, tolerance: float) -> DataFrame:
    """Parts of units (admin_uid, level, ring, sign) without overlaps inside a level: the smaller uid keeps.

    An overlap above the tolerance is refused, as it is no border noise.
    """
    if tolerance < 0:
        raise ValueError("The overlap tolerance cannot be negative.")
    layered = units.select(F.col("level").alias("layer"), F.lit(0).alias("rank"), F.col("admin_uid").alias("uid"), "ring", "sign")
    parts = cut_lineage(owned_parts(layered, tile))
    require_none(kept_areas(layered, parts).where(F.col("removed_area") > tolerance), "Units of one level overlap")
    return parts.select(F.col("uid").alias("admin_uid"), F.col("layer").alias("level"), "ring", "area")


def level_differences(units: DataFrame, order: Sequence[str], tile: float) -> DataFrame:
    """Parts of units (admin_uid, level, ring, sign) that no unit of an earlier level covers, and no unit of
    the same level with a smaller uid."""
    ranks = F.create_map(*[F.lit(v) for i, level in enumerate(order) for v in (level, i)])
    known = units.withColumn("rank", ranks[F.col("level")]).where("rank IS NOT NULL")
    parts = owned_parts(known.select(F.lit("all").alias("layer"), "rank", F.concat_ws("\u0001", "level", "admin_uid").alias("uid"), "ring", "sign"), tile)
    name = F.split("uid", "\u0001")
    return parts.select(name[1].alias("admin_uid"), name[0].alias("level"), "ring", "area")
