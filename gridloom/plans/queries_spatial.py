"""Spatial mapping, cells and payload queries."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scalars as S
from ..operators import cells, crosswalk, dissolve, mapping, nearest, overlay, payloads, reports, tiling
from .registry import query, rounded

TILE = 15.0
HOUR = timedelta(hours=1)

CROSS_SQL = """SELECT s.uid AS source_uid, c.spatial_uid, (s.x1 - s.x0) * (s.y1 - s.y0) AS source_area, c.area AS target_area,
       (least(s.x1, c.x1) - greatest(s.x0, c.x0)) * (least(s.y1, c.y1) - greatest(s.y0, c.y0)) AS overlap_area
  FROM v_block s JOIN v_cell c ON least(s.x1, c.x1) > greatest(s.x0, c.x0) AND least(s.y1, c.y1) > greatest(s.y0, c.y0)"""


@query(
    "box_crosswalk",
    f"SELECT source_uid, spatial_uid, round(source_area, 6) AS source_area, round(target_area, 6) AS target_area, round(overlap_area, 6) AS overlap_area FROM ({CROSS_SQL})",
)
def box_crosswalk(t):
    return rounded(crosswalk.box_crosswalk(t.v_block, t.v_cell, TILE))


@query(
    "ring_crosswalk",
    f"SELECT source_uid, spatial_uid, round(source_area, 5) AS source_area, round(target_area, 5) AS target_area, round(overlap_area, 5) AS overlap_area FROM ({CROSS_SQL})",
)
def ring_crosswalk(t):
    ring = G.box_ring("x0", "y0", "x1", "y1")
    rings = lambda df, key: df.select(key, ring.alias("ring"), F.lit(1).alias("sign"))
    return rounded(crosswalk.ring_crosswalk(rings(t.v_block, "uid"), rings(t.v_cell, "spatial_uid"), TILE), 5)


@query(
    "population_on_cells",
    f"""WITH x AS ({CROSS_SQL}) SELECT c.spatial_uid, round(coalesce(sum(b.population * x.overlap_area / x.source_area), 0), 4) AS population
        FROM (SELECT DISTINCT spatial_uid FROM v_cell) c LEFT JOIN x ON x.spatial_uid = c.spatial_uid LEFT JOIN v_block b ON b.uid = x.source_uid GROUP BY 1""",
)
def population_on_cells(t):
    pairs = crosswalk.box_crosswalk(t.v_block, t.v_cell, TILE)
    return rounded(crosswalk.aggregate_extensive(t.v_block, t.v_cell, pairs, "population", nominal_cell_area=12.0), 4)


@query("weights_extensive_linear", f"SELECT source_uid, spatial_uid, round(overlap_area / source_area, 6) AS weight FROM ({CROSS_SQL})")
def weights_extensive_linear(t):
    return rounded(crosswalk.weights_extensive_linear(crosswalk.box_crosswalk(t.v_block, t.v_cell, TILE)))


@query(
    "weights_intensive",
    f"SELECT source_uid, spatial_uid, round(overlap_area / sum(overlap_area) OVER (PARTITION BY spatial_uid), 6) AS weight FROM ({CROSS_SQL})",
)
def weights_intensive(t):
    return rounded(crosswalk.weights_intensive_linear(crosswalk.box_crosswalk(t.v_block, t.v_cell, TILE)))


@query(
    "weights_extensive_aux",
    f"""WITH x AS ({CROSS_SQL}), r AS (SELECT x.*, w.weight * overlap_area / target_area AS raw FROM x JOIN v_weight w ON w.spatial_uid = x.spatial_uid)
        SELECT source_uid, spatial_uid, round(CASE WHEN sum(raw) OVER (PARTITION BY source_uid) > 0 THEN raw / sum(raw) OVER (PARTITION BY source_uid)
               ELSE overlap_area / sum(overlap_area) OVER (PARTITION BY source_uid) END, 6) AS weight FROM r""",
)
def weights_extensive_aux(t):
    return rounded(crosswalk.weights_extensive_auxiliary(crosswalk.box_crosswalk(t.v_block, t.v_cell, TILE), t.v_weight))


@query(
    "closure_errors",
    f"""WITH x AS ({CROSS_SQL}) SELECT b.uid AS source_uid, round(coalesce(sum(overlap_area / source_area), 0), 6) AS covered, round(abs(coalesce(sum(overlap_area / source_area), 0) - 1), 6) AS error
        FROM v_block b LEFT JOIN x ON x.source_uid = b.uid GROUP BY 1""",
)
def closure_errors(t):
    weights = crosswalk.weights_extensive_linear(crosswalk.box_crosswalk(t.v_block, t.v_cell, TILE))
    return rounded(crosswalk.closure_errors(weights, t.v_block))


LOAD_SQL = """x AS (SELECT u.admin_uid AS source_uid, c.spatial_uid, c.area AS target_area, (least(u.x1, c.x1) - greatest(u.x0, c.x0)) * (least(u.y1, c.y1) - greatest(u.y0, c.y0)) AS overlap_area
   FROM v_admin u JOIN v_cell c ON least(u.x1, c.x1) > greatest(u.x0, c.x0) AND least(u.y1, c.y1) > greatest(u.y0, c.y0)),
 r AS (SELECT x.*, w.weight AS aux, w.weight * overlap_area / target_area AS raw FROM x JOIN v_weight w ON w.spatial_uid = x.spatial_uid),
 wt AS (SELECT source_uid, spatial_uid, aux, CASE WHEN sum(raw) OVER (PARTITION BY source_uid) > 0 THEN raw / sum(raw) OVER (PARTITION BY source_uid)
        ELSE overlap_area / sum(overlap_area) OVER (PARTITION BY source_uid) END AS weight FROM r)"""


@query(
    "map_load_to_cells",
    f"""WITH {LOAD_SQL}, zero AS (SELECT spatial_uid FROM v_weight WHERE weight <= 0), axis AS (SELECT DISTINCT time FROM v_series), cls AS (SELECT DISTINCT class FROM v_series)
        SELECT CAST(s.time AS VARCHAR) AS time, wt.spatial_uid, s.class, round(sum(s.demand_mw * wt.weight), 6) AS demand_mw FROM v_series s JOIN wt ON wt.source_uid = s.uid WHERE wt.spatial_uid NOT IN (SELECT spatial_uid FROM zero) GROUP BY 1, 2, 3
        UNION ALL SELECT CAST(axis.time AS VARCHAR), zero.spatial_uid, cls.class, 0.0E0 FROM zero, axis, cls""",
)
def map_load_to_cells(t):
    sources = t.v_admin.withColumnRenamed("admin_uid", "uid")
    return rounded(crosswalk.map_series_to_cells(
        t.v_series, sources, t.v_cell, value="demand_mw", tile=TILE, step=HOUR, quantity="extensive", method="auxiliary",
        auxiliary=t.v_weight, nearest_levels=["marine_zone"],
    ))


@query(
    "map_resource_to_cells",
    """WITH g AS (SELECT DISTINCT concat('p:', CAST(CAST(floor(c_custkey / 40.0E0) AS BIGINT) AS VARCHAR(10))) AS uid, CAST(CAST(floor(c_custkey / 40.0E0) AS BIGINT) % 13 AS DOUBLE) * 7 AS x, CAST(CAST(floor(c_custkey / 40.0E0) AS BIGINT) % 11 AS DOUBLE) * 8 AS y FROM customer),
            b AS (SELECT uid, x - 5 AS x0, y - 4.5E0 AS y0, x + 5 AS x1, y + 4.5E0 AS y1 FROM g),
            x AS (SELECT b.uid, c.spatial_uid, (least(b.x1, c.x1) - greatest(b.x0, c.x0)) * (least(b.y1, c.y1) - greatest(b.y0, c.y0)) AS o FROM b JOIN v_cell c ON least(b.x1, c.x1) > greatest(b.x0, c.x0) AND least(b.y1, c.y1) > greatest(b.y0, c.y0)),
            w AS (SELECT uid, spatial_uid, o / sum(o) OVER (PARTITION BY spatial_uid) AS weight FROM x),
            s AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS time, concat('p:', CAST(user_id % 38 AS VARCHAR(10))) AS uid, event_type AS class, avg(value) / 97 AS v FROM events GROUP BY 1, 2, 3),
            axis AS (SELECT DISTINCT time FROM s), cls AS (SELECT DISTINCT class FROM s)
       SELECT CAST(s.time AS VARCHAR) AS time, w.spatial_uid, s.class, round(sum(s.v * w.weight), 6) AS v FROM s JOIN w ON w.uid = s.uid GROUP BY 1, 2, 3
       UNION ALL SELECT CAST(axis.time AS VARCHAR), c.spatial_uid, cls.class, NULL FROM (SELECT spatial_uid FROM v_cell WHERE spatial_uid NOT IN (SELECT spatial_uid FROM x)) c, axis, cls""",
)
def map_resource_to_cells(t):
    g = F.floor(F.col("c_custkey") / 40.0).cast("long")
    points = t.customer.select(
        F.concat(F.lit("p:"), g.cast("string")).alias("uid"), ((g % 13) * 7.0).alias("x"), ((g % 11) * 8.0).alias("y")
    ).distinct()
    support = crosswalk.point_support(points, 10.0, 9.0)
    s = t.events.groupBy(
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("time"), F.concat(F.lit("p:"), (F.col("user_id") % 38).cast("string")).alias("uid"),
        F.col("event_type").alias("class"),
    ).agg((F.avg("value") / 97).alias("v"))
    return rounded(crosswalk.map_series_to_cells(s, support, t.v_cell, value="v", tile=TILE, step=timedelta(days=1), quantity="intensive", method="linear"))


@query(
    "conservation_error",
    f"""WITH {LOAD_SQL}, m AS (SELECT s.time, sum(s.demand_mw * wt.weight) AS b FROM v_series s JOIN wt ON wt.source_uid = s.uid GROUP BY 1), a AS (SELECT time, sum(demand_mw) AS a FROM v_series GROUP BY 1)
        SELECT round(max(abs(a - b)), 6) + 0.0 AS max_error, count(*) AS timestamps FROM a JOIN m USING (time)""",
)
def conservation_error(t):
    pairs = crosswalk.box_crosswalk(t.v_admin.withColumnRenamed("admin_uid", "uid"), t.v_cell, TILE)
    mapped = crosswalk.apply_weights(t.v_series, crosswalk.weights_extensive_auxiliary(pairs, t.v_weight), "demand_mw")
    return rounded(crosswalk.conservation_error(t.v_series, mapped, "demand_mw"))


@query(
    "region_shares",
    "SELECT uid, round(population / sum(population) OVER (PARTITION BY CAST(floor(x0 / 20) AS BIGINT)), 6) AS share, CAST(floor(x0 / 20) AS BIGINT) AS region FROM v_block",
)
def region_shares(t):
    d = t.v_block.withColumn("region", F.floor(F.col("x0") / 20).cast("long"))
    return rounded(crosswalk.region_shares(d, "region", "population", "share").select("uid", "region", "share"))


@query(
    "cell_load_at",
    """WITH s AS (SELECT uid, admin_uid, CAST(x * 100 AS BIGINT) + 600 AS w FROM v_place), h AS (SELECT uid, w * 1.0E0 / sum(w) OVER (PARTITION BY admin_uid) AS share, admin_uid FROM s),
            n AS (SELECT uid AS admin_uid, sum(demand_mw) AS d FROM v_series WHERE time = TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1)
       SELECT h.uid, round(h.share, 6) AS share, round(n.d * h.share, 6) AS cell_load FROM h LEFT JOIN n USING (admin_uid)""",
)
def cell_load_at(t):
    d = t.v_place.select("uid", "admin_uid", (F.round(F.col("x") * 100).cast("long") + 600).alias("w"))
    shares = crosswalk.region_shares(d, "admin_uid", "w", "share")
    series = t.v_series.withColumnRenamed("uid", "admin_uid")
    return rounded(crosswalk.load_at(shares, series, "2024-01-15 12:00:00", "admin_uid", "share", "demand_mw").select("uid", "share", "cell_load"))


@query(
    "composite_shares",
    """WITH z AS (SELECT uid, admin_uid AS region, CAST(substr(uid, 5) AS BIGINT) % 7 + 1 AS a, CAST(substr(uid, 5) AS BIGINT) % 5 AS b FROM v_place),
            h AS (SELECT time, class, avg(demand_mw) AS h FROM v_series GROUP BY 1, 2), q AS (SELECT z.uid, z.region, h.time, sum(CASE h.class WHEN 'view' THEN 3.0E0 * h.h * z.a ELSE 2.0E0 * h.h * z.b END) AS q
              FROM z JOIN h ON h.class IN ('view', 'click') GROUP BY 1, 2, 3)
       SELECT uid, region, CAST(time AS VARCHAR) AS time, round(q, 6) AS q, round(q / nullif(sum(q) OVER (PARTITION BY region, time), 0), 6) AS share FROM q""",
)
def composite_shares(t):
    k = F.substring("uid", 5, 20).cast("long")
    sectors = F.array(
        F.struct(F.lit("view").alias("class"), F.lit(3.0).alias("energy"), (k % 7 + 1).cast("double").alias("z")),
        F.struct(F.lit("click").alias("class"), F.lit(2.0).alias("energy"), (k % 5).cast("double").alias("z")),
    )
    z = t.v_place.select("uid", F.col("admin_uid").alias("region"), F.explode(sectors).alias("s")).select("uid", "region", "s.*")
    h = t.v_series.groupBy("time", "class").agg(F.avg("demand_mw").alias("h"))
    return crosswalk.composite_shares(z, h, ["uid", "region"], "energy", "h", "z", "region", rounded)


# --- containment and nearest --------------------------------------------------------------------
@query(
    "point_in_cell",
    """WITH i AS (SELECT p.uid, min(c.spatial_uid) AS spatial_uid FROM v_place p JOIN v_cell c ON p.x BETWEEN c.x0 AND c.x1 AND p.y BETWEEN c.y0 AND c.y1 GROUP BY 1),
            d AS (SELECT p.uid, c.spatial_uid, sqrt(power(greatest(c.x0 - p.x, p.x - c.x1, 0), 2) + power(greatest(c.y0 - p.y, p.y - c.y1, 0), 2)) AS d FROM v_place p JOIN v_cell c ON p.uid NOT IN (SELECT uid FROM i)),
            m AS (SELECT uid, min(spatial_uid) AS spatial_uid, min(d) AS d FROM (SELECT *, min(d) OVER (PARTITION BY uid) AS best FROM d) WHERE d <= best + 1e-12 GROUP BY 1)
       SELECT a.uid, a.spatial_uid, c.admin_uid, c.spatial_level, round(a.d / 1000, 6) AS cell_distance_km FROM (SELECT uid, spatial_uid, 0.0E0 AS d FROM i UNION ALL SELECT uid, spatial_uid, d FROM m) a
       JOIN v_cell c ON c.spatial_uid = a.spatial_uid""",
)
def point_in_cell(t):
    return rounded(mapping.objects_to_cells(t.v_place.select("uid", "x", "y"), t.v_cell, TILE).drop("x", "y"))


@query(
    "point_in_polygon",
    """SELECT p.uid, min(a.admin_uid) AS admin_uid FROM (SELECT uid, x, y FROM v_place) p LEFT JOIN v_admin a ON p.y BETWEEN a.y0 AND a.y1 AND p.x >= a.x0 AND p.x <= a.x1 AND (p.x - a.x0) + (p.y - a.y0) <= 30 GROUP BY 1""",
)
def point_in_polygon(t):
    # boxes with one corner cut off along x + y = 30
    ring = F.array(
        G.point("x0", "y0"), G.point("x1", "y0"), G.point("x1", F.col("y0") + 10), G.point(F.col("x0") + 10, "y1"), G.point("x0", "y1")
    )
    units = t.v_admin.select("admin_uid", ring.alias("ring"), F.lit(1).alias("sign"))
    return mapping.objects_to_polygons(t.v_place.select("uid", "x", "y"), units, 20.0, "admin_uid").select("uid", "admin_uid")


NEAREST_SQL = """d AS (SELECT o.uid, b.uid AS bus_uid, o.admin_uid AS source_admin_uid, b.admin_uid AS bus_admin_uid, b.voltage_kv, o.spatial_uid AS source_spatial_uid, b.spatial_uid AS bus_spatial_uid,
   sqrt((o.x - b.x) * (o.x - b.x) + (o.y - b.y) * (o.y - b.y)) AS dist FROM v_generator o JOIN v_bus b ON b.subclass = 'station_bus' {extra}),
 n AS (SELECT *, min(dist) OVER (PARTITION BY uid) AS best FROM d),
 v AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY voltage_kv {direction}, bus_uid) AS rn FROM n WHERE dist <= best + 1e-9)"""


@query(
    "nearest_bus",
    f"""WITH {NEAREST_SQL.format(extra='', direction='DESC')} SELECT uid, bus_uid, round(dist / 1000, 6) AS distance_km, source_admin_uid = bus_admin_uid AS same_admin FROM v WHERE rn = 1""",
)
def nearest_bus(t):
    out = mapping.objects_to_buses(t.v_generator, t.v_bus, prefer_same_admin=False, bus_subclasses=["station_bus"])
    return rounded(out.select("uid", "bus_uid", "distance_km", "same_admin"))


@query(
    "nearest_bus_same_admin",
    f"""WITH {NEAREST_SQL.format(extra="AND (b.admin_uid = o.admin_uid OR o.admin_uid NOT IN (SELECT admin_uid FROM v_bus WHERE subclass = 'station_bus'))", direction='ASC')}
        SELECT uid, bus_uid, 'geometry' AS mapping_method, round(dist / 1000, 6) AS distance_km, source_admin_uid = bus_admin_uid AS same_admin, source_spatial_uid, bus_spatial_uid, source_admin_uid, bus_admin_uid FROM v WHERE rn = 1""",
)
def nearest_bus_same_admin(t):
    return rounded(mapping.objects_to_buses(t.v_generator, t.v_bus, voltage_preference="low", bus_subclasses=["station_bus"]))


@query(
    "nearest_station_ties",
    """WITH d AS (SELECT p.node AS lid, s.station_uid AS rid, sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)) AS d FROM v_point p CROSS JOIN v_station s), n AS (SELECT *, min(d) OVER (PARTITION BY lid) AS best FROM d)
       SELECT lid, rid, round(d, 4) AS distance FROM n WHERE d <= best""",
)
def nearest_station_ties(t):
    out = nearest.nearest_points(t.v_point.withColumnRenamed("node", "lid"), t.v_station.withColumnRenamed("station_uid", "rid"))
    return rounded(out, 4)


@query(
    "stations_within",
    """SELECT p.node AS uid, s.station_uid, round(sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)), 4) AS distance,
              CASE WHEN sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)) <= 1e-6 THEN 'terminal_in_station' ELSE 'terminal_near_station' END AS match_method
       FROM v_point p JOIN v_station s ON (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) <= 4000.0E0 * 4000.0E0""",
)
def stations_within(t):
    stations = t.v_station.select("station_uid", F.array(G.point("x", "y")).alias("ring"), F.lit(1).alias("sign"))
    points = t.v_point.withColumnRenamed("node", "uid")
    return rounded(mapping.terminal_matches(points, stations, 4000.0, 4000.0), 4)


@query(
    "nearest_in_region",
    """WITH c AS (SELECT uid, x, y, admin_uid AS region FROM v_place WHERE admin_uid IN (SELECT admin_uid FROM v_bus)),
            d AS (SELECT c.uid, b.uid AS node_uid, sqrt((c.x - b.x) * (c.x - b.x) + (c.y - b.y) * (c.y - b.y)) AS d FROM c JOIN v_bus b ON b.admin_uid = c.region)
       SELECT uid, node_uid, round(d, 6) AS station_distance_m FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY d, node_uid) AS rn FROM d) WHERE rn = 1""",
)
def nearest_in_region(t):
    stations = t.v_bus.select(F.col("uid").alias("node_uid"), "x", "y", F.col("admin_uid").alias("region"))
    objects = t.v_place.withColumnRenamed("admin_uid", "region").join(stations.select("region").distinct(), "region", "left_semi")
    return rounded(mapping.nearest_in_region(objects, stations, "region"))


@query(
    "uncovered_cells_nearest",
    """WITH b AS (SELECT s_suppkey AS k, concat('src:', CAST(s_suppkey AS VARCHAR(20))) AS uid, CAST((s_suppkey * 37) % 90 AS DOUBLE) AS x0, CAST((s_suppkey * 53) % 90 AS DOUBLE) AS y0 FROM supplier),
            far AS (SELECT spatial_uid, spatial_level, x0, y0, x1, y1, area FROM v_cell c WHERE NOT EXISTS (SELECT 1 FROM b WHERE least(b.x0 + 2, c.x1) > greatest(b.x0, c.x0) AND least(b.y0 + 2, c.y1) > greatest(b.y0, c.y0))),
            d AS (SELECT f.spatial_uid, b.uid, f.area, sqrt(power(greatest(b.x0 - f.x1, f.x0 - b.x0 - 2, 0), 2) + power(greatest(b.y0 - f.y1, f.y0 - b.y0 - 2, 0), 2)) AS d
                  FROM far f JOIN b ON f.spatial_uid IN (SELECT spatial_uid FROM v_weight WHERE weight > 0))
       SELECT uid AS source_uid, spatial_uid, 4.0E0 AS source_area, round(area, 6) AS target_area, round(area, 6) AS overlap_area FROM (SELECT *, row_number() OVER (PARTITION BY spatial_uid ORDER BY d, uid) AS rn FROM d) WHERE rn = 1
       UNION ALL SELECT b.uid, c.spatial_uid, 4.0E0, round(c.area, 6), round((least(b.x0 + 2, c.x1) - greatest(b.x0, c.x0)) * (least(b.y0 + 2, c.y1) - greatest(b.y0, c.y0)), 6) FROM b JOIN v_cell c ON least(b.x0 + 2, c.x1) > greatest(b.x0, c.x0) AND least(b.y0 + 2, c.y1) > greatest(b.y0, c.y0)""",
)
def uncovered_cells_nearest(t):
    k = F.col("s_suppkey")
    x, y = ((k * 37) % 90).cast("double"), ((k * 53) % 90).cast("double")
    src = t.supplier.select(F.concat(F.lit("src:"), k.cast("string")).alias("uid"), x.alias("x0"), y.alias("y0"), (x + 2).alias("x1"), (y + 2).alias("y1"))
    pairs = crosswalk.box_crosswalk(src, t.v_cell, TILE)
    return rounded(crosswalk.attach_uncovered(pairs, src, t.v_cell, t.v_weight, ["marine_zone", "province"]))


# --- cells and lines ----------------------------------------------------------------------------
@query(
    "clip_grid",
    """WITH g AS (SELECT CAST(r AS INT) AS i FROM range(0, 40) t(r))
       SELECT concat('cell:', b.uid, ':square:3:', CAST(a.i AS VARCHAR(10)), ':', CAST(c.i AS VARCHAR(10))) AS spatial_uid, b.uid AS admin_uid,
              round((least(b.x1, a.i * 3.0E0 + 3) - greatest(b.x0, a.i * 3.0E0)) * (least(b.y1, c.i * 3.0E0 + 3) - greatest(b.y0, c.i * 3.0E0)), 6) AS area
       FROM v_block b JOIN g a ON least(b.x1, a.i * 3.0E0 + 3) > greatest(b.x0, a.i * 3.0E0) JOIN g c ON least(b.y1, c.i * 3.0E0 + 3) > greatest(b.y0, c.i * 3.0E0)""",
)
def clip_grid(t):
    units = t.v_block.withColumnRenamed("uid", "admin_uid").withColumn("level", F.lit("block"))
    return rounded(cells.box_cells(units, 3.0, (0.0, 0.0)).select("spatial_uid", "admin_uid", "area"))


@query(
    "clip_rings",
    """WITH g AS (SELECT CAST(r AS INT) AS i FROM range(0, 40) t(r)), p AS (
         SELECT concat('cell:', b.uid, ':square:3:', CAST(a.i AS VARCHAR(10)), ':', CAST(c.i AS VARCHAR(10))) AS spatial_uid, greatest(b.x0, a.i * 3.0E0) AS x0, greatest(b.y0, c.i * 3.0E0) AS y0,
                least(b.x1, a.i * 3.0E0 + 3) AS x1, least(b.y1, c.i * 3.0E0 + 3) AS y1
         FROM v_block b JOIN g a ON least(b.x1, a.i * 3.0E0 + 3) > greatest(b.x0, a.i * 3.0E0) JOIN g c ON least(b.y1, c.i * 3.0E0 + 3) > greatest(b.y0, c.i * 3.0E0))
       SELECT spatial_uid, round((x1 - x0) * (y1 - y0), 5) AS area_km2, round((x0 + x1) / 2, 5) AS x, round((y0 + y1) / 2, 5) AS y FROM p""",
)
def clip_rings(t):
    ring = G.box_ring("x0", "y0", "x1", "y1")
    units = t.v_block.select(F.col("uid").alias("admin_uid"), F.lit("block").alias("level"), ring.alias("ring"), F.lit(1).alias("sign"))
    parts = cells.ring_cells(units, 3.0, (0.0, 0.0))
    return rounded(cells.cell_measures(parts, 1.0).select("spatial_uid", "area_km2", "x", "y"), 5)


@query(
    "merge_small_cells",
    """WITH c AS (SELECT uid AS spatial_uid, CAST(floor(x0 / 20) AS BIGINT) AS admin_uid, (x1 - x0) * (y1 - y0) AS area, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM v_block),
            l AS (SELECT * FROM c WHERE area >= 3.5), s AS (SELECT * FROM c WHERE area < 3.5),
            d AS (SELECT s.spatial_uid, l.spatial_uid AS target_uid, sqrt((s.x - l.x) * (s.x - l.x) + (s.y - l.y) * (s.y - l.y)) AS d FROM s JOIN l ON l.admin_uid = s.admin_uid)
       SELECT spatial_uid, spatial_uid AS target_uid FROM l UNION ALL SELECT spatial_uid, target_uid FROM (SELECT *, row_number() OVER (PARTITION BY spatial_uid ORDER BY d, target_uid) AS rn FROM d) WHERE rn = 1
       UNION ALL SELECT spatial_uid, min(spatial_uid) OVER (PARTITION BY admin_uid) FROM s WHERE admin_uid NOT IN (SELECT admin_uid FROM l)""",
)
def merge_small_cells(t):
    d = t.v_block.select(
        F.col("uid").alias("spatial_uid"), F.floor(F.col("x0") / 20).cast("long").alias("admin_uid"),
        ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"),
    )
    return cells.merge_small(d, 3.5)


@query(
    "level_overlaps",
    """WITH b AS (SELECT uid, CAST(CAST(substr(uid, 5) AS BIGINT) % 3 AS VARCHAR(5)) AS level, x0, y0, x1, y1 FROM v_block)
       SELECT l.level, l.uid AS owner_uid, r.uid AS other_uid, round((least(l.x1, r.x1) - greatest(l.x0, r.x0)) * (least(l.y1, r.y1) - greatest(l.y0, r.y0)), 5) AS overlap_area
       FROM b l JOIN b r ON l.level = r.level AND l.uid < r.uid AND least(l.x1, r.x1) > greatest(l.x0, r.x0) AND least(l.y1, r.y1) > greatest(l.y0, r.y0)""",
)
def level_overlaps(t):
    level = (F.substring("uid", 5, 20).cast("long") % 3).cast("string")
    units = t.v_block.select(F.col("uid").alias("admin_uid"), level.alias("level"), G.box_ring("x0", "y0", "x1", "y1").alias("ring"), F.lit(1).alias("sign"))
    return cells.level_overlaps(units, 4.0, 5)


@query(
    "level_priority",
    """WITH b AS (SELECT uid AS admin_uid, CASE CAST(substr(uid, 5) AS BIGINT) % 2 WHEN 0 THEN 'province' ELSE 'marine_zone' END AS level, x0, y0, x1, y1 FROM v_block),
            g AS (SELECT CAST(r AS BIGINT) AS i FROM range(0, 220) t(r)),
            h AS (SELECT a.i AS ix, c.i AS iy, b.admin_uid, b.level FROM b JOIN g a ON a.i * 0.5E0 + 0.25E0 BETWEEN b.x0 AND b.x1 JOIN g c ON c.i * 0.5E0 + 0.25E0 BETWEEN b.y0 AND b.y1)
       SELECT ix, iy, admin_uid, level AS spatial_level, 0.25E0 AS area FROM (SELECT *, row_number() OVER (PARTITION BY ix, iy ORDER BY CASE level WHEN 'province' THEN 0 ELSE 1 END, admin_uid) AS rn FROM h) WHERE rn = 1""",
)
def level_priority(t):
    level = F.when(F.substring("uid", 5, 20).cast("long") % 2 == 0, "province").otherwise("marine_zone")
    units = t.v_block.select(F.col("uid").alias("admin_uid"), level.alias("level"), G.box_ring("x0", "y0", "x1", "y1").alias("ring"), F.lit(1).alias("sign"))
    return cells.level_priority(units, ["province", "marine_zone"], 0.5)


OVERLAY_SQL = """b AS (SELECT uid, CASE CAST(substr(uid, 5) AS BIGINT) % 2 WHEN 0 THEN 'province' ELSE 'marine_zone' END AS level, x0, y0, x1, y1 FROM v_block),
            r AS (SELECT *, {layer} AS layer, row_number() OVER (ORDER BY {rank}) AS rk FROM b),
            ex AS (SELECT layer, x, lead(x) OVER (PARTITION BY layer ORDER BY x) AS x2 FROM (SELECT layer, x0 AS x FROM r UNION SELECT layer, x1 FROM r)),
            s AS (SELECT r.*, e.x AS sx, e.x2 AS sx2 FROM r JOIN ex e ON e.layer = r.layer AND e.x >= r.x0 AND e.x2 <= r.x1),
            ey AS (SELECT layer, sx, y, lead(y) OVER (PARTITION BY layer, sx ORDER BY y) AS y2 FROM (SELECT layer, sx, y0 AS y FROM s UNION SELECT layer, sx, y1 FROM s)),
            o AS (SELECT s.layer, s.sx, min(s.sx2) AS sx2, e.y, min(e.y2) AS y2, min(s.rk) AS rk FROM s JOIN ey e ON e.layer = s.layer AND e.sx = s.sx AND e.y >= s.y0 AND e.y2 <= s.y1 GROUP BY s.layer, s.sx, e.y),
            k AS (SELECT rk, sum((sx2 - sx) * (y2 - y)) AS kept FROM o GROUP BY 1)
       SELECT r.uid AS admin_uid, r.level, round((x1 - x0) * (y1 - y0), 5) AS own_area, round(coalesce(kept, 0), 5) AS kept_area FROM r LEFT JOIN k ON k.rk = r.rk"""


def _levelled_blocks(t):
    level = F.when(F.substring("uid", 5, 20).cast("long") % 2 == 0, "province").otherwise("marine_zone")
    return t.v_block.select(F.col("uid").alias("admin_uid"), level.alias("level"), G.box_ring("x0", "y0", "x1", "y1").alias("ring"), F.lit(1).alias("sign"))


def _with_kept(units, parts):
    own = units.groupBy("admin_uid", "level").agg(F.sum(G.ring_area("ring") * F.col("sign")).alias("own_area"))
    kept = parts.groupBy("admin_uid", "level").agg(F.sum("area").alias("kept_area"))
    return rounded(own.join(kept, ["admin_uid", "level"], "left").fillna(0.0, ["kept_area"]), 5)


@query("level_differences", "WITH " + OVERLAY_SQL.format(layer="'all'", rank="CASE level WHEN 'province' THEN 0 ELSE 1 END, uid"))
def level_differences(t):
    """Areas that stay with each unit when earlier levels, and smaller uids of its own level, are taken out."""
    units = _levelled_blocks(t)
    return _with_kept(units, overlay.level_differences(units, ["province", "marine_zone"], 6.0))


@query("same_level_removal", "WITH " + OVERLAY_SQL.format(layer="level", rank="uid"))
def same_level_removal(t):
    """Areas that stay with each unit when overlaps inside its level are removed."""
    units = _levelled_blocks(t)
    return _with_kept(units, overlay.disjoint_units(units, 6.0, 100.0))


@query(
    "dissolved_squares",
    """WITH RECURSIVE sq AS (SELECT * FROM v_square),
            e AS (SELECT grp, ix AS x, iy AS y, 0 AS d FROM sq s WHERE NOT EXISTS (SELECT 1 FROM sq o WHERE o.grp = s.grp AND o.ix = s.ix AND o.iy = s.iy - 1)
                  UNION ALL SELECT grp, ix + 1, iy, 1 FROM sq s WHERE NOT EXISTS (SELECT 1 FROM sq o WHERE o.grp = s.grp AND o.ix = s.ix + 1 AND o.iy = s.iy)
                  UNION ALL SELECT grp, ix + 1, iy + 1, 2 FROM sq s WHERE NOT EXISTS (SELECT 1 FROM sq o WHERE o.grp = s.grp AND o.ix = s.ix AND o.iy = s.iy + 1)
                  UNION ALL SELECT grp, ix, iy + 1, 3 FROM sq s WHERE NOT EXISTS (SELECT 1 FROM sq o WHERE o.grp = s.grp AND o.ix = s.ix - 1 AND o.iy = s.iy)),
            m AS (SELECT *, x + CASE d WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS tx, y + CASE d WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS ty FROM e),
            nx AS (SELECT m.grp, m.x, m.y, m.d, m.tx, m.ty, arg_min(f.d, (f.d - m.d + 7) % 4 * -1) AS td FROM m JOIN e f ON f.grp = m.grp AND f.x = m.tx AND f.y = m.ty AND f.d <> (m.d + 2) % 4 GROUP BY ALL),
            w AS (SELECT grp, x, y, d, x AS cx, y AS cy, d AS cd FROM e UNION SELECT w.grp, w.x, w.y, w.d, n.tx, n.ty, n.td FROM w JOIN nx n ON n.grp = w.grp AND n.x = w.cx AND n.y = w.cy AND n.d = w.cd),
            l AS (SELECT grp, x, y, d, min((cx * 100000 + cy) * 4 + cd) AS ring FROM w GROUP BY 1, 2, 3, 4),
            r AS (SELECT grp, ring, sum(CASE d WHEN 1 THEN x WHEN 3 THEN -x ELSE 0 END) AS a, count(*) AS p FROM l GROUP BY 1, 2)
       SELECT grp, count(*) FILTER (WHERE a > 0) AS outer_rings, count(*) FILTER (WHERE a < 0) AS holes, CAST(sum(a) AS DOUBLE) AS area, CAST(sum(p) AS DOUBLE) AS perimeter FROM r GROUP BY 1""",
)
def dissolved_squares(t):
    """Rings, area and perimeter of the union of the squares of each group."""
    x, y = F.col("ix").cast("double"), F.col("iy").cast("double")
    parts = t.v_square.select(F.col("grp").alias("key"), G.box_ring(x, y, x + 1, y + 1).alias("ring"), F.lit(1).alias("sign"))
    d = dissolve.dissolved(parts, 1.0)
    return rounded(d.groupBy(F.col("key").alias("grp")).agg(
        F.count_if(F.col("sign") > 0).alias("outer_rings"), F.count_if(F.col("sign") < 0).alias("holes"),
        F.sum(F.col("area") * F.col("sign")).alias("area"), F.sum("perimeter").alias("perimeter"),
    ))


@query(
    "background_outline",
    """WITH a AS (SELECT level, x0, y0 FROM v_admin)
       SELECT level AS spatial_level, CAST(count(*) * 400 AS DOUBLE) AS area,
              CAST(sum(20 * (4 - (SELECT count(*) FROM a o WHERE o.level = a.level AND abs(o.x0 - a.x0) + abs(o.y0 - a.y0) = 20))) AS DOUBLE) AS perimeter FROM a GROUP BY 1""",
)
def background_outline(t):
    """Outline of the cells of each level: cells of different size meet along parts of their sides."""
    parts = t.v_cell.select("admin_uid", "spatial_level", G.box_ring("x0", "y0", "x1", "y1").alias("ring"), F.lit(1).alias("sign"))
    d = dissolve.background_outline(parts, 5.0)
    return rounded(d.groupBy("spatial_level").agg(F.sum(F.col("area") * F.col("sign")).alias("area"), F.sum("perimeter").alias("perimeter")))


@query(
    "dissolved_attributes",
    """SELECT concat('nation:', CAST(c_nationkey AS VARCHAR(10))) AS uid, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segment,
              string_agg(DISTINCT CASE WHEN c_acctbal > 9000 THEN 'rich' WHEN c_acctbal > 8000 THEN 'well' END, ',' ORDER BY CASE WHEN c_acctbal > 9000 THEN 'rich' WHEN c_acctbal > 8000 THEN 'well' END) AS wealth FROM customer GROUP BY 1""",
)
def dissolved_attributes(t):
    d = t.customer.select(
        F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("uid"), F.col("c_mktsegment").alias("segment"),
        F.when(F.col("c_acctbal") > 9000, "rich").when(F.col("c_acctbal") > 8000, "well").alias("wealth"),
    )
    return cells.dissolve_attributes(d, "uid")


@query(
    "branch_cells",
    """WITH s AS (SELECT concat('b:', CAST(c_custkey AS VARCHAR(20))) AS uid, CAST((c_custkey * 7919) % 11000 AS DOUBLE) / 100 - 5 AS ax, CAST((c_custkey * 4729) % 11000 AS DOUBLE) / 100 - 5 AS y, 4.0E0 + c_nationkey AS w FROM customer),
            i AS (SELECT s.uid, c.spatial_uid, c.admin_uid, c.spatial_level, s.w, least(s.ax + s.w, c.x1) - greatest(s.ax, c.x0) AS len FROM s JOIN v_cell c ON s.y BETWEEN c.y0 AND c.y1 AND least(s.ax + s.w, c.x1) > greatest(s.ax, c.x0))
       SELECT uid AS branch_uid, spatial_uid, admin_uid, spatial_level, round(len / 1000, 6) AS overlap_length_km, round(least(len / w, 1.0E0), 6) AS branch_length_share, 'intersects' AS mapping_status FROM i
       UNION ALL SELECT uid, NULL, NULL, NULL, 0.0E0, 0.0E0, 'outside_cell_domain' FROM s WHERE uid NOT IN (SELECT uid FROM i)""",
)
def branch_cells(t):
    k = F.col("c_custkey")
    x, y = ((k * 7919) % 11000).cast("double") / 100 - 5, ((k * 4729) % 11000).cast("double") / 100 - 5
    w = F.lit(4.0) + F.col("c_nationkey")
    lines = t.customer.select(F.concat(F.lit("b:"), k.cast("string")).alias("uid"), F.array(G.point(x, y), G.point(x + w, y)).alias("line"))
    return rounded(mapping.branches_to_cells(lines, t.v_cell, TILE))


@query(
    "metric_lengths",
    "SELECT uid, round(3.0E0 + 4 * (x1 - x0), 6) AS length, round((x1 - x0) * (y1 - y0), 6) AS area, round((x0 + x1) / 2, 6) AS cx, round((y0 + y1) / 2, 6) AS cy FROM v_block",
)
def metric_lengths(t):
    line = F.array(G.point("x0", "y0"), G.point("x1", "y0"), G.point("x1", F.col("y0") + 3), G.point(F.col("x1") - 3 * (F.col("x1") - F.col("x0")), F.col("y0") + 3))
    d = t.v_block.withColumn("ring", G.box_ring("x0", "y0", "x1", "y1")).withColumn("c", G.representative_point("ring"))
    return rounded(d.select("uid", G.line_length(line).alias("length"), G.ring_area("ring").alias("area"), F.col("c.x").alias("cx"), F.col("c.y").alias("cy")))


@query(
    "albers_round_trip",
    "SELECT uid, round(70.0E0 + x0 / 2, 6) AS lon, round(18.0E0 + y0 / 3, 6) AS lat FROM v_block",
)
def albers_round_trip(t):
    d = t.v_block.select("uid", G.to_albers(F.lit(70.0) + F.col("x0") / 2, F.lit(18.0) + F.col("y0") / 3).alias("m"))
    d = d.select("uid", G.from_albers("m.x", "m.y").alias("p"))
    return rounded(d.select("uid", F.col("p.x").alias("lon"), F.col("p.y").alias("lat")))


@query(
    "wkt_round_trip",
    "SELECT uid, 'POLYGON' AS kind, 4 + 1 AS vertices, round(x0, 6) AS x0, round(y1, 6) AS y1 FROM v_block",
)
def wkt_round_trip(t):
    d = t.v_block.select("uid", G.to_wkt("POLYGON", G.box_ring("x0", "y0", "x1", "y1")).alias("wkt"))
    v = d.select("uid", G.wkt_kind("wkt").alias("kind"), G.wkt_vertices("wkt").alias("v"))
    box = G.bbox("v")
    return rounded(v.select("uid", "kind", F.size("v").alias("vertices"), box[0], box[3]))


@query(
    "grid_sample",
    """WITH g AS (SELECT gx, gy, count(*) AS n FROM (SELECT round(x0 / 2.5E0) * 2.5E0 AS gx, round(y0 / 2.5E0) * 2.5E0 AS gy FROM v_block) GROUP BY 1, 2)
       SELECT p.uid, g.n FROM v_place p LEFT JOIN g ON g.gx = round(p.x / 2.5E0) * 2.5E0 AND g.gy = round(p.y / 2.5E0) * 2.5E0""",
)
def grid_sample(t):
    snap = lambda c: F.round(F.col(c) / 2.5) * 2.5
    grid = t.v_block.groupBy(snap("x0").alias("gx"), snap("y0").alias("gy")).agg(F.count("*").alias("n"))
    return mapping.sample_grid(t.v_place, grid, 0.0, 0.0, 2.5).select("uid", "n")


# --- layers -------------------------------------------------------------------------------------
@query("population_layer", "SELECT uid, round(greatest(population, 0), 6) AS raw_value, round(log10(greatest(population, 0) + 1), 6) AS value FROM v_block")
def population_layer(t):
    return rounded(payloads.population_layer(t.v_block).select("uid", "raw_value", "value"))


@query(
    "asset_points",
    """WITH k AS (SELECT uid, class, capacity_mw FROM v_generator WHERE capacity_mw > 0), r AS (SELECT greatest(quantile_cont(capacity_mw, 0.99), 1) AS ref FROM k)
       SELECT uid, class, round(capacity_mw, 6) AS capacity, round(2 + 24 * sqrt(least(greatest(capacity_mw / ref, 0), 1)), 6) AS marker_size FROM k, r""",
)
def asset_points(t):
    return rounded(payloads.asset_points(t.v_generator, "capacity_mw").select("uid", "class", "capacity", "marker_size"))


@query("class_order", "SELECT class, count(*) AS assets FROM v_generator GROUP BY 1")
def class_order(t):
    return payloads.class_order(t.v_generator)


@query(
    "asset_pies",
    """WITH c AS (SELECT spatial_uid, class, sum(coalesce(capacity_mw, 0)) AS mw FROM v_generator GROUP BY 1, 2)
       SELECT spatial_uid, round(sum(mw), 6) AS total_mw, count(*) FILTER (WHERE mw > 0) AS classes, round(max(CASE WHEN class = 'coal' AND mw > 0 THEN mw END), 6) AS coal_mw FROM c GROUP BY 1""",
)
def asset_pies(t):
    d = payloads.asset_pies(t.v_generator, "spatial_uid", "capacity_mw")
    return rounded(d.select("spatial_uid", "total_mw", F.size("breakdown").cast("long").alias("classes"), F.col("breakdown")["coal"].alias("coal_mw")))


@query(
    "capacity_reference",
    """WITH c AS (SELECT spatial_uid, sum(coalesce(capacity_mw, 0)) AS mw FROM v_generator GROUP BY 1) SELECT round(greatest(quantile_cont(mw, 0.99), 1), 6) AS capacity_reference FROM c""",
)
def capacity_reference(t):
    return rounded(payloads.capacity_reference(payloads.asset_pies(t.v_generator, "spatial_uid", "capacity_mw"), "total_mw"))


@query(
    "network_styles",
    "SELECT concat(CAST(CAST(voltage_kv AS INT) AS VARCHAR(10)), ' kV ', current_type) AS style, count(*) AS buses FROM v_bus GROUP BY 1",
)
def network_styles(t):
    return payloads.styled_branches(t.v_bus).groupBy("style").agg(F.count("*").alias("buses"))


@query(
    "network_layer",
    """SELECT CASE subclass WHEN 'junction_bus' THEN 'junction' ELSE 'station' END AS node_type, count(*) AS features,
              sum(CASE WHEN status IS NULL THEN 1 ELSE 0 END) AS without_status, round(sum(x), 4) AS x_sum FROM v_bus GROUP BY 1""",
)
def network_layer(t):
    typed = payloads.typed_buses(t.v_bus)
    text = payloads.feature_json(typed, ["uid", "node_type", "status", "voltage_kv"], payloads.point_geometry(), {"voltage_kv": "kv"})
    parsed = text.select(F.from_json("feature", "type string, geometry struct<type:string,coordinates:array<double>>, properties struct<node_type:string,status:string,kv:double>").alias("f"))
    return rounded(parsed.groupBy(F.col("f.properties.node_type").alias("node_type")).agg(
        F.count("*").alias("features"), F.sum(F.when(F.col("f.properties.status").isNull(), 1).otherwise(0)).alias("without_status"),
        F.sum(F.col("f.geometry.coordinates")[0]).alias("x_sum"),
    ), 4)


@query("layer_summary", "SELECT count(*) AS count, round(sum(population), 4) AS value FROM v_block")
def layer_summary(t):
    return rounded(payloads.layer_summary(t.v_block, "population"), 4)


@query("category_list", "SELECT DISTINCT class AS id, CASE class WHEN 'coal' THEN '#3f3f46' ELSE '#909691' END AS color FROM v_generator")
def category_list(t):
    return payloads.category_list(t.v_generator, "class", {"coal": "#3f3f46"})


@query(
    "extent_filter",
    "SELECT p.uid FROM v_place p WHERE EXISTS (SELECT 1 FROM v_admin a WHERE a.level = 'marine_zone' AND p.x BETWEEN a.x0 AND a.x1 AND p.y BETWEEN a.y0 AND a.y1)",
)
def extent_filter(t):
    return payloads.filter_extent(t.v_place, payloads.require_levels(t.v_admin, ["marine_zone"]), 20.0).select("uid")


@query(
    "extent_shapes",
    """WITH m AS (SELECT * FROM v_admin WHERE level = 'marine_zone'),
            s AS (SELECT uid, x AS x0, y AS y0, x + 7 AS x1, y AS y1 FROM v_place UNION ALL SELECT uid, x0, y0, x1, y1 FROM v_block UNION ALL SELECT admin_uid, x0 - 45, y0 + 2, x1, y0 + 4 FROM v_admin)
       SELECT uid FROM s WHERE EXISTS (SELECT 1 FROM m WHERE s.x0 <= m.x1 AND s.x1 >= m.x0 AND s.y0 <= m.y1 AND s.y1 >= m.y0)""",
)
def extent_shapes(t):
    """Lines and areas of very different sizes that meet the units of a level."""
    x, y = F.col("x"), F.col("y")
    lines = t.v_place.select("uid", F.array(G.point(x, y), G.point(x + 7, y)).alias("path"), F.lit(False).alias("closed"))
    blocks = t.v_block.select("uid", G.box_ring("x0", "y0", "x1", "y1").alias("path"), F.lit(True).alias("closed"))
    strips = t.v_admin.select(F.col("admin_uid").alias("uid"), G.box_ring(F.col("x0") - 45, F.col("y0") + 2, F.col("x1"), F.col("y0") + 4).alias("path"), F.lit(True).alias("closed"))
    areas = payloads.require_levels(t.v_admin, ["marine_zone"]).select(G.box_ring("x0", "y0", "x1", "y1").alias("ring"), F.lit(1).alias("sign"))
    return payloads.filter_shapes(lines.unionByName(blocks).unionByName(strips), areas).select("uid")


@query(
    "axis_step",
    """WITH a AS (SELECT DISTINCT round(x0, 8) AS v FROM v_block), g AS (SELECT v - lag(v) OVER (ORDER BY v) AS d FROM a) SELECT round(coalesce(quantile_cont(d, 0.5), 0.25), 6) AS step FROM g WHERE d > 1e-8""",
)
def axis_step(t):
    return rounded(payloads.axis_step(t.v_block, "x0"))


@query(
    "station_load_weights",
    """WITH c AS (SELECT b.uid, b.population, CAST(floor(b.x0 / 20) AS BIGINT) AS region, b.x0 AS x, b.y0 AS y FROM v_block b), s AS (SELECT uid AS node_uid, x, y, CAST(floor(x / 20) AS BIGINT) AS region FROM v_bus),
            d AS (SELECT c.*, s.node_uid, sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)) AS d FROM c JOIN s ON s.region = c.region), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY d, node_uid) AS rn FROM d) WHERE rn = 1),
            g AS (SELECT region, node_uid, sum(population) AS population, count(*) AS assigned_cells, avg(d) / 1000 AS a, max(d) / 1000 AS m FROM n GROUP BY 1, 2)
       SELECT region, node_uid, round(population, 4) AS population, assigned_cells, round(a, 4) AS mean_station_distance_km, round(m, 4) AS maximum_station_distance_km, round(population / sum(population) OVER (PARTITION BY region), 4) AS region_load_share FROM g""",
)
def station_load_weights(t):
    region = lambda c: F.floor(F.col(c) / 20).cast("long").alias("region")
    blocks = t.v_block.select("uid", "population", F.col("x0").alias("x"), F.col("y0").alias("y"), region("x0"))
    stations = t.v_bus.select(F.col("uid").alias("node_uid"), "x", "y", region("x"))
    near = mapping.nearest_in_region(blocks, stations, "region")
    return rounded(reports.station_load_weights(blocks.join(near, "uid")), 4)


@query(
    "mapping_scopes",
    """WITH d AS (SELECT o.uid, o.capacity_mw, o.admin_uid, b.uid AS node_uid, b.admin_uid AS b_admin, sqrt((o.x - b.x) * (o.x - b.x) + (o.y - b.y) * (o.y - b.y)) AS d FROM v_generator o CROSS JOIN v_bus b),
            n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY d, node_uid) AS rn FROM d) WHERE rn = 1),
            k AS (SELECT *, CASE WHEN d <= 0.2 THEN 'inside_station' WHEN admin_uid = b_admin AND d <= 4 THEN 'same_province_near' WHEN admin_uid = b_admin THEN 'same_province_distant' WHEN d <= 4 THEN 'national_fallback_near' ELSE 'national_fallback_distant' END AS mapping_scope FROM n),
            g AS (SELECT mapping_scope, count(*) AS records, count(DISTINCT admin_uid) AS locations, count(DISTINCT node_uid) AS candidate_nodes, sum(capacity_mw) AS capacity_mw, quantile_cont(d, 0.5) AS med, quantile_cont(d, 0.95) AS p95 FROM k GROUP BY 1),
            s AS (SELECT unnest(['inside_station', 'same_province_near', 'same_province_distant', 'national_fallback_near', 'national_fallback_distant']) AS mapping_scope)
       SELECT s.mapping_scope, coalesce(records, 0) AS records, coalesce(locations, 0) AS locations, coalesce(candidate_nodes, 0) AS candidate_nodes, round(coalesce(capacity_mw, 0), 4) AS capacity_mw, round(coalesce(med, 0), 4) AS median_distance_km,
              round(coalesce(p95, 0), 4) AS p95_distance_km, round(100.0 * coalesce(records, 0) / (SELECT count(*) FROM k), 4) AS record_share_percent FROM s LEFT JOIN g USING (mapping_scope)""",
)
def mapping_scopes(t):
    from ..operators import rules

    best = nearest.first_nearest(t.v_generator.select(F.col("uid").alias("lid"), "x", "y"), t.v_bus.select(F.col("uid").alias("rid"), "x", "y"))
    d = (
        t.v_generator.join(best.withColumnsRenamed({"lid": "uid", "rid": "node_uid", "distance": "distance_km"}), "uid")
        .join(t.v_bus.select(F.col("uid").alias("node_uid"), F.col("admin_uid").alias("b_admin")), "node_uid")
        .withColumn("location_uid", F.col("admin_uid"))
    )
    scope = rules.mapping_scope(F.col("distance_km") <= 0.2, F.col("admin_uid") == F.col("b_admin"), F.col("distance_km"), 4.0)
    return rounded(reports.mapping_summary(d.withColumn("mapping_scope", scope)), 4)


@query(
    "segments_in_boxes",
    """SELECT uid, sum(n) AS pieces FROM (SELECT b.uid, count(*) AS n FROM v_block b JOIN v_cell c ON b.y0 BETWEEN c.y0 AND c.y1 AND least(b.x1, c.x1) > greatest(b.x0, c.x0) GROUP BY 1) GROUP BY 1""",
)
def segments_in_boxes(t):
    seg = t.v_block.select("uid", F.col("x0").alias("ax"), F.col("y0").alias("ay"), F.col("x1").alias("bx"), F.col("y0").alias("by"))
    return tiling.line_box_lengths(seg, t.v_cell.select("spatial_uid", *tiling.BOX), TILE).groupBy("uid").agg(F.count("*").alias("pieces"))
