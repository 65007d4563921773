"""Planar geometry as column expressions.

Points are two double columns, lines and rings are array<struct<x,y>>. A polygon is one or more
ring rows (key, ring, sign) where sign is -1 for a hole, so dissolving polygons is a group-by and
never a union.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .scalars import ColumnLike, col, let

RING = "array<struct<x:double,y:double>>"

# --- fixed values: WGS84 ellipsoid and the Albers frame used for every measurement --------------
SEMI_MAJOR_M = 6378137.0
ECCENTRICITY2 = 0.00669437999014
ALBERS = {"lat_1": 25.0, "lat_2": 47.0, "lat_0": 0.0, "lon_0": 105.0}
# ------------------------------------------------------------------------------------------------


def point(x: ColumnLike, y: ColumnLike) -> Column:
    return F.struct(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))


def box_ring(x0, y0, x1, y1) -> Column:
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def valid_lonlat(lon: ColumnLike, lat: ColumnLike) -> Column:
    """Point struct, null when out of range or missing."""
    lon, lat = col(lon), col(lat)
    return F.when(lon.between(-180, 180) & lat.between(-90, 90), point(lon, lat))


def once(value: Column) -> Column:
    """A column that is computed once per row: Spark copies a plain expression into every later filter and lambda
    that reads it, but not over a generator. Only for `select` and `withColumn`."""
    return F.explode(F.array(value))


def next_vertex(ring: Column, i: Column) -> Column:
    return F.get(ring, (i + 1) % F.size(ring))


def ring_area(ring: ColumnLike) -> Column:
    """Unsigned shoelace area."""
    return F.abs(_signed_area(col(ring)))


def signed_ring_area(ring: ColumnLike) -> Column:
    """Shoelace area, positive for counter-clockwise rings."""
    return _signed_area(col(ring))


def _signed_area(ring: Column) -> Column:
    cross = F.transform(
        ring,
        lambda p, i: let(next_vertex(ring, i), lambda q: p["x"] * q["y"] - q["x"] * p["y"]),
    )
    return F.aggregate(cross, F.lit(0.0), lambda a, v: a + v) / 2


def ring_centroid(ring: ColumnLike) -> Column:
    """Area centroid of a ring with non-zero area, as a point struct."""
    r = col(ring)

    def moment(axis: str) -> Column:
        parts = F.transform(
            r,
            lambda p, i: let(
                next_vertex(r, i),
                lambda q: (p[axis] + q[axis]) * (p["x"] * q["y"] - q["x"] * p["y"]),
            ),
        )
        return F.aggregate(parts, F.lit(0.0), lambda a, v: a + v)

    area = _signed_area(r)
    return point(F.try_divide(moment("x"), 6 * area), F.try_divide(moment("y"), 6 * area))


def line_length(line: ColumnLike) -> Column:
    ln = col(line)
    parts = F.transform(
        ln,
        lambda p, i: let(
            F.get(ln, i + 1),
            lambda q: F.coalesce(F.hypot(q["x"] - p["x"], q["y"] - p["y"]), F.lit(0.0)),
        ),
    )
    return F.aggregate(parts, F.lit(0.0), lambda a, v: a + v)


def bbox(shape: ColumnLike, prefix: str = "") -> list[Column]:
    s = col(shape)
    xs, ys = F.transform(s, lambda p: p["x"]), F.transform(s, lambda p: p["y"])
    return [
        F.array_min(xs).alias(prefix + "x0"), F.array_min(ys).alias(prefix + "y0"),
        F.array_max(xs).alias(prefix + "x1"), F.array_max(ys).alias(prefix + "y1"),
    ]


def point_in_ring(x: ColumnLike, y: ColumnLike, ring: ColumnLike) -> Column:
    """Even-odd ray test; points on the boundary count as inside."""
    x, y, r = col(x), col(y), col(ring)

    def edge(p: Column, i: Column) -> Column:
        def test(q: Column) -> Column:
            cross = (q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"])
            on = (
                (cross == 0)
                & (x >= F.least(p["x"], q["x"])) & (x <= F.greatest(p["x"], q["x"]))
                & (y >= F.least(p["y"], q["y"])) & (y <= F.greatest(p["y"], q["y"]))
            )
            crosses = (p["y"] > y) != (q["y"] > y)
            at = p["x"] + F.try_divide((y - p["y"]) * (q["x"] - p["x"]), q["y"] - p["y"])
            return F.when(on, F.lit(1000000)).when(crosses & (x < at), F.lit(1)).otherwise(F.lit(0))

        return let(next_vertex(r, i), test)

    hits = F.aggregate(F.transform(r, edge), F.lit(0), lambda a, v: a + v)
    return (hits >= 1000000) | (hits % 2 == 1)


def clip_ring(ring: ColumnLike, x0: ColumnLike, y0: ColumnLike, x1: ColumnLike, y1: ColumnLike) -> Column:
    """Part of a ring inside an axis-aligned box (successive half-plane clips).

    A concave ring can leave zero-width bridges along the box edge; they carry no area.
    """
    out = col(ring)
    for axis, bound, keep_above in (("x", x0, True), ("x", x1, False), ("y", y0, True), ("y", y1, False)):
        out = _half_plane(out, axis, col(bound), keep_above)
    return out


def _half_plane(ring: Column, axis: str, bound: Column, keep_above: bool) -> Column:
    other = "y" if axis == "x" else "x"

    def inside(p: Column) -> Column:
        return p[axis] >= bound if keep_above else p[axis] <= bound

    def cut(p: Column, q: Column) -> Column:
        t = F.try_divide(bound - p[axis], q[axis] - p[axis])
        along = p[other] + t * (q[other] - p[other])
        return point(bound, along) if axis == "x" else point(along, bound)

    def edge(r: Column):
        def emit(p: Column, i: Column) -> Column:
            return let(
                next_vertex(r, i),
                lambda q: F.filter(
                    F.array(F.when(inside(p), p), F.when(inside(p) != inside(q), cut(p, q))),
                    lambda v: v.isNotNull(),
                ),
            )

        return emit

    return let(ring, lambda r: F.flatten(F.transform(r, edge(r))))


def segment_box_length(ax, ay, bx, by, x0, y0, x1, y1) -> Column:
    """Length of a segment inside a closed box (parametric clipping)."""
    ax, ay, bx, by = map(col, (ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    big = F.lit(float("1e300"))

    def span(start: Column, delta: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
        t0, t1 = F.try_divide(lo - start, delta), F.try_divide(hi - start, delta)
        within = (start >= lo) & (start <= hi)
        enter = F.when(delta == 0, F.when(within, -big).otherwise(big)).otherwise(F.least(t0, t1))
        leave = F.when(delta == 0, F.when(within, big).otherwise(-big)).otherwise(F.greatest(t0, t1))
        return enter, leave

    ex, lx = span(ax, dx, col(x0), col(x1))
    ey, ly = span(ay, dy, col(y0), col(y1))
    share = F.least(F.lit(1.0), lx, ly) - F.greatest(F.lit(0.0), ex, ey)
    return F.greatest(share, F.lit(0.0)) * F.hypot(dx, dy)


def point_segment_distance(px, py, ax, ay, bx, by) -> Column:
    px, py, ax, ay, bx, by = map(col, (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    t = F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def segment_segment_distance(a: tuple, b: tuple) -> Column:
    """Distance of segments a and b, each given as four columns; zero where they cross."""
    (ax, ay, bx, by), (cx, cy, dx, dy) = [tuple(map(col, s)) for s in (a, b)]

    def side(px, py, qx, qy, rx, ry):
        return F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))

    crossing = (
        (side(ax, ay, bx, by, cx, cy) * side(ax, ay, bx, by, dx, dy) < 0)
        & (side(cx, cy, dx, dy, ax, ay) * side(cx, cy, dx, dy, bx, by) < 0)
    )
    ends = F.least(
        point_segment_distance(ax, ay, cx, cy, dx, dy), point_segment_distance(bx, by, cx, cy, dx, dy),
        point_segment_distance(cx, cy, ax, ay, bx, by), point_segment_distance(dx, dy, ax, ay, bx, by),
    )
    return F.when(crossing, F.lit(0.0)).otherwise(ends)


def box_gap(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    """Distance between two closed boxes; zero when they touch or overlap."""
    dx = F.greatest(col(bx0) - col(ax1), col(ax0) - col(bx1), F.lit(0.0))
    dy = F.greatest(col(by0) - col(ay1), col(ay0) - col(by1), F.lit(0.0))
    return F.hypot(dx, dy)


# --- Albers equal-area, closed form -------------------------------------------------------------
def _q(sin_lat):
    e2, e = ECCENTRICITY2, math.sqrt(ECCENTRICITY2)
    log = math.log if isinstance(sin_lat, float) else F.log
    return (1 - e2) * (
        sin_lat / (1 - e2 * sin_lat * sin_lat)
        - (1 / (2 * e)) * log((1 - e * sin_lat) / (1 + e * sin_lat))
    )


def _albers_constants() -> tuple[float, float, float]:
    e2 = ECCENTRICITY2
    phi0, phi1, phi2 = (math.radians(ALBERS[k]) for k in ("lat_0", "lat_1", "lat_2"))
    m = lambda p: math.cos(p) / math.sqrt(1 - e2 * math.sin(p) ** 2)
    q0, q1, q2 = (_q(math.sin(p)) for p in (phi0, phi1, phi2))
    n = (m(phi1) ** 2 - m(phi2) ** 2) / (q2 - q1)
    c = m(phi1) ** 2 + n * q1
    return n, c, SEMI_MAJOR_M * math.sqrt(c - n * q0) / n


def to_albers(lon: ColumnLike, lat: ColumnLike) -> Column:
    """Longitude/latitude in degrees to metres."""
    n, c, rho0 = _albers_constants()
    q = _q(F.sin(F.radians(col(lat))))
    rho = F.lit(SEMI_MAJOR_M) * F.sqrt(F.lit(c) - F.lit(n) * q) / n
    theta = F.lit(n) * F.radians(col(lon) - F.lit(ALBERS["lon_0"]))
    return point(rho * F.sin(theta), F.lit(rho0) - rho * F.cos(theta))


def from_albers(x: ColumnLike, y: ColumnLike) -> Column:
    """Metres back to longitude/latitude; the latitude series is refined by five fixed steps."""
    n, c, rho0 = _albers_constants()
    e2, e = ECCENTRICITY2, math.sqrt(ECCENTRICITY2)
    x, y = col(x), col(y)
    rho = F.hypot(x, F.lit(rho0) - y)
    theta = F.atan2(x, F.lit(rho0) - y)
    q = (F.lit(c) - F.pow(rho * n / SEMI_MAJOR_M, F.lit(2.0))) / n

    def step(phi: Column) -> Column:
        s = F.sin(phi)
        w = 1 - e2 * s * s
        return phi + w * w / (2 * F.cos(phi)) * (
            q / (1 - e2) - s / w + (1 / (2 * e)) * F.log((1 - e * s) / (1 + e * s))
        )

    phi = F.asin(F.least(F.greatest(q / 2, F.lit(-1.0)), F.lit(1.0)))
    for _ in range(5):
        phi = let(phi, step)
    return point(F.degrees(theta) / n + ALBERS["lon_0"], F.degrees(phi))


def ring_to_albers(ring: ColumnLike) -> Column:
    return F.transform(col(ring), lambda p: to_albers(p["x"], p["y"]))


# --- text form ----------------------------------------------------------------------------------
def _coordinates(text: Column) -> Column:
    return F.transform(
        F.split(text, r"\s*,\s*"),
        lambda t: let(
            F.split(F.trim(t), r"\s+"),
            lambda xy: point(F.get(xy, F.lit(0)).try_cast("double"), F.get(xy, F.lit(1)).try_cast("double")),
        ),
    )


def wkt_vertices(c: ColumnLike) -> Column:
    """Vertices of POINT, LINESTRING or the outer ring of POLYGON."""
    return _coordinates(F.regexp_extract(col(c), r"\(+\s*([^()]+?)\s*\)", 1))


def wkt_kind(c: ColumnLike) -> Column:
    return F.upper(F.regexp_extract(col(c), r"^\s*([A-Za-z]+)", 1))


def to_wkt(kind: str, shape: ColumnLike) -> Column:
    s = col(shape)
    if kind == "POINT":
        return F.format_string("POINT (%.6f %.6f)", s["x"], s["y"])
    pairs = F.transform(s, lambda p: F.format_string("%.6f %.6f", p["x"], p["y"]))
    if kind == "LINESTRING":
        return F.concat(F.lit("LINESTRING ("), F.array_join(pairs, ", "), F.lit(")"))
    closed = F.concat(pairs, F.slice(pairs, 1, 1))
    return F.concat(F.lit("POLYGON (("), F.array_join(closed, ", "), F.lit("))"))


# --- ring hygiene and the Arrow helpers -----------------------------------------------------------
def clean_ring(ring: ColumnLike) -> Column:
    """Drop a repeated closing vertex and repeated neighbours; null when no area is left."""
    def dedupe(r: Column) -> Column:
        kept = F.filter(
            F.transform(
                r,
                lambda p, i: F.struct(
                    p.alias("p"),
                    let(F.get(r, (i + 1) % F.size(r)), lambda q: (p["x"] != q["x"]) | (p["y"] != q["y"])).alias("keep"),
                ),
            ),
            lambda s: s["keep"],
        )
        return F.transform(kept, lambda s: s["p"])

    return let(let(col(ring), dedupe), lambda r: F.when((F.size(r) >= 3) & (ring_area(r) > 0), r))


def representative_point(ring: ColumnLike) -> Column:
    """Centroid when it lies inside the ring, else the middle of the widest scan-line span."""
    r = col(ring)

    def scan(mid_y: Column) -> Column:
        xs = F.array_sort(
            F.filter(
                F.transform(
                    r,
                    lambda p, i: let(
                        next_vertex(r, i),
                        lambda q: F.when(
                            (p["y"] > mid_y) != (q["y"] > mid_y),
                            p["x"] + F.try_divide((mid_y - p["y"]) * (q["x"] - p["x"]), q["y"] - p["y"]),
                        ),
                    ),
                ),
                lambda v: v.isNotNull(),
            )
        )
        spans = let(
            xs,
            lambda s: F.transform(
                F.filter(F.transform(s, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda e: e["i"] % 2 == 0),
                lambda e: F.struct(
                    (F.get(s, e["i"] + 1) - e["v"]).alias("w"), ((F.get(s, e["i"] + 1) + e["v"]) / 2).alias("x")
                ),
            ),
        )
        return point(F.array_max(spans)["x"], mid_y)

    ys = F.transform(r, lambda p: p["y"])
    middle = (F.array_min(ys) + F.array_max(ys)) / 2
    return let(
        ring_centroid(r),
        lambda c: F.when(point_in_ring(c["x"], c["y"], r), c).otherwise(let(middle, scan)),
    )


def _xy(ring) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in ring], dtype=float)


def _crossings(ring: np.ndarray, x: float) -> np.ndarray:
    a, b = ring, np.roll(ring, -1, axis=0)
    hit = (a[:, 0] > x) != (b[:, 0] > x)
    a, b = a[hit], b[hit]
    return np.sort(a[:, 1] + (x - a[:, 0]) * (b[:, 1] - a[:, 1]) / (b[:, 0] - a[:, 0]))


def _overlap(left: np.ndarray, right: np.ndarray) -> float:
    """Exact overlap area of two simple rings by vertical slabs between all vertex and crossing x."""
    a, b = left, np.roll(left, -1, axis=0)
    c, d = right, np.roll(right, -1, axis=0)
    u, v = b - a, d - c
    det = u[:, None, 0] * v[None, :, 1] - u[:, None, 1] * v[None, :, 0]
    w = c[None, :, :] - a[:, None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (w[..., 0] * v[None, :, 1] - w[..., 1] * v[None, :, 0]) / det
        s = (w[..., 0] * u[:, None, 1] - w[..., 1] * u[:, None, 0]) / det
        hit = (det != 0) & (t >= 0) & (t <= 1) & (s >= 0) & (s <= 1)
        cross_x = (a[:, None, 0] + t * u[:, None, 0])[hit]
    xs = np.unique(np.concatenate([left[:, 0], right[:, 0], cross_x]))
    total = 0.0
    for lo, hi in zip(xs[:-1], xs[1:]):
        mid = (lo + hi) / 2
        ys, zs = _crossings(left, mid), _crossings(right, mid)
        for y0, y1 in zip(ys[::2], ys[1::2]):
            for z0, z1 in zip(zs[::2], zs[1::2]):
                total += max(0.0, min(y1, z1) - max(y0, z0)) * (hi - lo)
    return total


def _flat(rings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First vertex and number of vertices of each ring, and all x and y."""
    sizes = np.diff(rings.offsets.to_numpy(zero_copy_only=False))
    points = rings.flatten()
    x, y = (points.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
    return np.cumsum(sizes) - sizes, sizes, x, y


def _edges(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """Edges from left to right (x0, y0, x1, slope), their direction and the unsigned area of rings of one size."""
    nx, ny = np.roll(x, -1, axis=1), np.roll(y, -1, axis=1)
    area = ((x * ny - nx * y).sum(axis=1)) / 2
    back = nx < x
    x0, x1, y0, y1 = np.where(back, nx, x), np.where(back, x, nx), np.where(back, ny, y), np.where(back, y, ny)
    width = x1 - x0
    slope = np.divide(y1 - y0, width, out=np.zeros_like(width), where=width > 0)
    return x0, y0, x1, slope, np.where(back, 1.0, -1.0) * np.sign(area)[:, None], np.abs(area)


def _overlaps(lx: np.ndarray, ly: np.ndarray, rx: np.ndarray, ry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlap area and smaller area of many pairs of simple rings: rows are pairs, columns are vertices.

    A ring is the signed sum of the strips between its edges and a line below both rings, so the overlap is the
    signed sum of the common parts of two strips, which is the area under the lower of two edges.
    """
    ox, oy = np.minimum(lx.min(axis=1), rx.min(axis=1))[:, None], np.minimum(ly.min(axis=1), ry.min(axis=1))[:, None]
    ax0, ay0, ax1, am, asign, aarea = (v[..., None] if v.ndim == 2 else v for v in _edges(lx - ox, ly - oy))
    bx0, by0, bx1, bm, bsign, barea = (v[:, None, :] if v.ndim == 2 else v for v in _edges(rx - ox, ry - oy))
    lo, hi = np.maximum(ax0, bx0), np.minimum(ax1, bx1)
    width = np.maximum(hi - lo, 0.0)
    fl, fh, gl, gh = ay0 + (lo - ax0) * am, ay0 + (hi - ax0) * am, by0 + (lo - bx0) * bm, by0 + (hi - bx0) * bm
    d0, d1 = fl - gl, fh - gh
    # Where the edges cross, the lower one changes at the share t of the width, at the height c.
    crossing = d0 * d1 < 0
    t = np.divide(d0, d0 - d1, out=np.ones_like(d0), where=crossing)
    low0, low1 = np.minimum(fl, gl), np.minimum(fh, gh)
    c = np.where(crossing, fl + t * (fh - fl), low1)
    under = width / 2 * (t * (low0 + c) + (1 - t) * (c + low1))
    return (asign * bsign * under).sum(axis=(1, 2)), np.minimum(aarea, barea)


#: Edge pairs that are worked on at once, and the share of the smaller area below which rounding may have made a sum.
EDGE_PAIRS, NOISE = 1 << 20, 1e-9


@F.arrow_udf(DoubleType())
def ring_overlap_area(left: pa.Array, right: pa.Array) -> pa.Array:
    """Overlap area of two rings of a candidate pair; pairs with the same numbers of vertices are one block."""
    (ls, ln, lx, ly), (rs, rn, rx, ry) = _flat(left), _flat(right)
    out = np.zeros(len(ln))
    kinds, which = np.unique(np.stack([ln, rn]), axis=1, return_inverse=True)
    for k, (n, m) in enumerate(kinds.T.tolist()):
        rows = np.flatnonzero(which.ravel() == k)
        if n < 3 or m < 3:
            continue
        block = max(1, EDGE_PAIRS // (n * m))
        for some in (rows[i : i + block] for i in range(0, len(rows), block)):
            a, b = ls[some, None] + np.arange(n), rs[some, None] + np.arange(m)
            if n * m > EDGE_PAIRS:
                doubtful = np.ones(len(some), dtype=bool)
            else:
                out[some], least = _overlaps(lx[a], ly[a], rx[b], ry[b])
                doubtful = out[some] <= NOISE * least
            for i in np.flatnonzero(doubtful).tolist():
                out[some[i]] = _overlap(np.column_stack([lx[a[i]], ly[a[i]]]), np.column_stack([rx[b[i]], ry[b[i]]]))
    return pa.array(out)


def _simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    keep = np.zeros(len(points), dtype=bool)
    keep[[0, -1]] = True
    stack = [(0, len(points) - 1)]
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        a, d = points[i], points[j] - points[i]
        mid = points[i + 1:j] - a
        norm = float(d @ d)
        t = np.clip(mid @ d / norm, 0, 1) if norm else np.zeros(len(mid))
        gap = np.hypot(*(mid - t[:, None] * d).T)
        k = int(gap.argmax())
        if gap[k] > tolerance:
            keep[i + 1 + k] = True
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    return points[keep]


def simplify(shape: ColumnLike, tolerance: float, closed: bool = False) -> Column:
    """Drop vertices nearer than the tolerance to the simplified line."""

    @F.pandas_udf(RING)
    def run(shapes: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in shapes:
            out = []
            for ring in batch:
                pts = _xy(ring)
                pts = _simplify(np.vstack([pts, pts[:1]]) if closed else pts, tolerance)
                if closed:
                    pts = pts[:-1]
                    if len(pts) < 3:
                        pts = _xy(ring)
                out.append([{"x": float(x), "y": float(y)} for x, y in pts])
            yield pd.Series(out)

    return run(col(shape))
