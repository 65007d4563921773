"""Energy-shaped inputs derived from the given tables, as SQL that Spark and DuckDB both run.

Every view covers all rows of its tables. Spark inlines the views over its Parquet scans, the SQL
check inlines the same text over its registered tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, str] = {
    # 25 administrative boxes of 20 x 20 on a 100 x 100 map
    "v_admin": """
        SELECT concat('nation:', CAST(n_nationkey AS VARCHAR(10))) AS admin_uid,
               CASE WHEN n_nationkey % 5 = 4 THEN 'marine_zone' ELSE 'province' END AS level,
               (n_nationkey % 5) * 20.0E0 AS x0, CAST(floor(n_nationkey / 5.0E0) AS DOUBLE) * 20.0E0 AS y0,
               (n_nationkey % 5) * 20.0E0 + 20 AS x1, CAST(floor(n_nationkey / 5.0E0) AS DOUBLE) * 20.0E0 + 20 AS y1
        FROM nation""",
    # stations of the network, on an integer lattice so that distances tie
    "v_bus": """
        SELECT concat('bus:', CAST(s_suppkey AS VARCHAR(20))) AS uid,
               CASE s_suppkey % 4 WHEN 0 THEN 220.0E0 WHEN 1 THEN 330.0E0 WHEN 2 THEN 500.0E0 ELSE 1000.0E0 END AS voltage_kv,
               CASE WHEN s_suppkey % 7 = 0 THEN 'DC' ELSE 'AC' END AS current_type,
               CASE WHEN s_suppkey % 3 = 0 THEN 'junction_bus' ELSE 'station_bus' END AS subclass,
               CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 5 = 0 THEN 'planned' ELSE 'Operating' END AS status,
               concat('nation:', CAST(s_nationkey AS VARCHAR(10))) AS admin_uid,
               concat('sq:', CAST((s_suppkey * 37) % 100 AS VARCHAR(10))) AS spatial_uid,
               CAST((s_suppkey * 37) % 100 AS DOUBLE) AS x, CAST((s_suppkey * 53) % 100 AS DOUBLE) AS y
        FROM supplier""",
    "v_generator": """
        SELECT concat('gen:', CAST(p_partkey AS VARCHAR(20))) AS uid,
               CASE p_type WHEN 'ECONOMY' THEN 'coal' WHEN 'SMALL' THEN 'solar' WHEN 'MEDIUM' THEN 'wind' WHEN 'PROMO' THEN 'gas'
                    WHEN 'STANDARD' THEN 'hydropower' ELSE 'nuclear' END AS class,
               CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_type = 'SMALL' THEN 'utility_scale_pv' WHEN p_type = 'MEDIUM' THEN 'onshore'
                    WHEN p_type = 'STANDARD' THEN 'run_of_river' ELSE lower(replace(p_brand, '#', '_')) END AS subclass,
               CASE p_partkey % 4 WHEN 0 THEN 'Operating' WHEN 1 THEN 'In construction' WHEN 2 THEN 'operating' ELSE 'retired' END AS status,
               CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_size * 10.0E0 END AS capacity_mw, p_name AS technology,
               concat('bus:', CAST(p_partkey % (SELECT count(*) FROM supplier) AS VARCHAR(20))) AS bus_uid,
               concat('nation:', CAST(CAST(floor(((p_partkey * 77) % 1000) / 200.0E0) * 5 + floor(((p_partkey * 31) % 1000) / 200.0E0) AS BIGINT) AS VARCHAR(10))) AS admin_uid,
               concat('cell:', CAST(p_partkey % 25 AS VARCHAR(10))) AS spatial_uid,
               CAST((p_partkey * 31) % 1000 AS DOUBLE) / 10 AS x, CAST((p_partkey * 77) % 1000 AS DOUBLE) / 10 AS y
        FROM part""",
    "v_storage": """
        SELECT concat('sto:', CAST(s_suppkey AS VARCHAR(20))) AS uid,
               CASE s_suppkey % 3 WHEN 0 THEN 'pumped_storage' WHEN 1 THEN 'battery_storage' ELSE 'thermal_storage' END AS class,
               CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'lithium_ion' END AS subclass, 'operating' AS status,
               round(s_acctbal / 10, 1) AS power_capacity_mw, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE round(s_acctbal / 2, 1) END AS energy_capacity_mwh,
               CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 5.0E0 END AS duration_h,
               concat('bus:', CAST(s_suppkey % 10 AS VARCHAR(20))) AS bus_uid, concat('cell:', CAST(s_nationkey AS VARCHAR(10))) AS spatial_uid
        FROM supplier""",
    # population support: one small box per customer
    "v_block": """
        SELECT concat('pop:', CAST(c_custkey AS VARCHAR(20))) AS uid, abs(c_acctbal) AS population,
               CAST((c_custkey * 7919) % 9600 AS DOUBLE) / 100 AS x0, CAST((c_custkey * 4729) % 9600 AS DOUBLE) / 100 AS y0,
               CAST((c_custkey * 7919) % 9600 AS DOUBLE) / 100 + 1 + c_nationkey % 3 AS x1,
               CAST((c_custkey * 4729) % 9600 AS DOUBLE) / 100 + 1 + c_nationkey % 4 AS y1
        FROM customer""",
    "v_place": """
        SELECT concat('obj:', CAST(c_custkey AS VARCHAR(20))) AS uid, concat('nation:', CAST(c_nationkey AS VARCHAR(10))) AS admin_uid,
               concat('cell:', CAST(c_nationkey AS VARCHAR(10))) AS spatial_uid,
               CAST((c_custkey * 7919) % 11000 AS DOUBLE) / 100 - 5 AS x, CAST((c_custkey * 4729) % 11000 AS DOUBLE) / 100 - 5 AS y
        FROM customer""",
    # 7 x 7 squares of 15 clipped by the administrative boxes
    "v_cell": """
        SELECT concat('cell:', u.admin_uid, ':', 'square:15:', CAST(a.r AS VARCHAR(10)), ':', CAST(b.r AS VARCHAR(10))) AS spatial_uid,
               u.admin_uid, u.level AS spatial_level, greatest(u.x0, a.r * 15.0E0) AS x0, greatest(u.y0, b.r * 15.0E0) AS y0,
               least(u.x1, a.r * 15.0E0 + 15) AS x1, least(u.y1, b.r * 15.0E0 + 15) AS y1,
               (least(u.x1, a.r * 15.0E0 + 15) - greatest(u.x0, a.r * 15.0E0)) * (least(u.y1, b.r * 15.0E0 + 15) - greatest(u.y0, b.r * 15.0E0)) AS area
        FROM v_admin u
        JOIN (SELECT DISTINCT CAST(n_nationkey % 7 AS INT) AS r FROM nation) a ON least(u.x1, a.r * 15.0E0 + 15) > greatest(u.x0, a.r * 15.0E0)
        JOIN (SELECT DISTINCT CAST(n_nationkey % 7 AS INT) AS r FROM nation) b ON least(u.y1, b.r * 15.0E0 + 15) > greatest(u.y0, b.r * 15.0E0)""",
    "v_weight": """
        SELECT spatial_uid, CASE WHEN spatial_level = 'marine_zone' AND x0 + y0 > 90 THEN 0.0E0
               ELSE area * (1 + CAST(CAST(x0 + y0 AS INT) % 3 AS DOUBLE)) END AS weight FROM v_cell""",
    "v_series": """
        SELECT CAST(date_trunc('hour', ts) AS {ntz}) AS time, concat('nation:', CAST(user_id % 25 AS VARCHAR(10))) AS uid,
               event_type AS class, sum(value) AS demand_mw
        FROM events GROUP BY 1, 2, 3""",
    # dense hourly axis per uid: every hour between the first and the last event, 0 where nothing happened
    "v_hours": "SELECT DISTINCT CAST(date_trunc('hour', ts) AS {ntz}) AS time FROM events",
    "v_hourly": """
        SELECT CAST(date_trunc('hour', ts) AS {ntz}) AS time, event_type AS uid, 'all' AS class, sum(value) AS demand_mw, count(*) AS rows_
        FROM events GROUP BY 1, 2""",
    "v_daily": """
        SELECT CAST(date_trunc('day', ts) AS {ntz}) AS time, event_type AS uid, 'all' AS class, sum(value) - 500.0E0 AS runoff
        FROM events GROUP BY 1, 2""",
    # forest-like grid: each customer node hangs on an earlier one, with breaks
    "v_node": """
        SELECT concat('n:', CAST(c_custkey AS VARCHAR(20))) AS uid,
               CASE c_mktsegment WHEN 'BUILDING' THEN 110.0E0 WHEN 'AUTOMOBILE' THEN 220.0E0 WHEN 'MACHINERY' THEN 330.0E0 WHEN 'HOUSEHOLD' THEN 500.0E0 ELSE 1000.0E0 END AS voltage_kv,
               CASE WHEN c_custkey % 4 = 0 THEN 'junction' ELSE 'station' END AS node_type,
               CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 19 = 0 THEN 'planned' ELSE 'Operating' END AS status,
               concat('nation:', CAST(c_nationkey AS VARCHAR(10))) AS admin_uid
        FROM customer""",
    "v_edge": """
        SELECT concat('e:', CAST(c_custkey AS VARCHAR(20))) AS uid, concat('n:', CAST(c_custkey AS VARCHAR(20))) AS from_bus_uid,
               concat('n:', CAST(CASE WHEN CAST(floor(abs(c_acctbal)) AS BIGINT) % 23 = 0 OR c_custkey - 1 - c_nationkey % 7 < 0 THEN c_custkey
                      ELSE c_custkey - 1 - c_nationkey % 7 END AS VARCHAR(20))) AS to_bus_uid,
               CASE WHEN c_custkey % 29 = 0 THEN 'planned' WHEN c_custkey % 31 = 0 THEN NULL ELSE 'operating' END AS status,
               1.0E0 + c_nationkey AS length_km, 220.0E0 AS voltage_kv
        FROM customer""",
    # lines as ways over nodes: an order is a way, its items are its ordered references
    "v_refs": """
        SELECT concat('way:', CAST(l_orderkey AS VARCHAR(20))) AS uid,
               CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INT) AS pos,
               l_partkey AS node
        FROM lineitem""",
    "v_line": """
        SELECT concat('way:', CAST(o_orderkey AS VARCHAR(20))) AS uid,
               CASE o_orderpriority WHEN '1-URGENT' THEN '220000;110000' WHEN '2-HIGH' THEN '500000' WHEN '3-MEDIUM' THEN NULL
                    WHEN '4-NOT SPECIFIED' THEN '110000;110000;220000' ELSE '220 kV, 330000' END AS voltage,
               CASE o_orderkey % 5 WHEN 0 THEN '2;1' WHEN 1 THEN '3' WHEN 2 THEN NULL WHEN 3 THEN '2;x' ELSE '4' END AS circuits,
               CASE o_orderkey % 4 WHEN 0 THEN '3;3' WHEN 1 THEN NULL WHEN 2 THEN '6;3;6' ELSE '7' END AS cables,
               CASE WHEN o_orderkey % 11 = 0 THEN '0' ELSE '50' END AS frequency, o_orderpriority AS name, o_orderstatus AS standard_status,
               CASE WHEN o_orderstatus = 'P' THEN 'cable' ELSE 'line' END AS standard_type
        FROM orders""",
    "v_point": """
        SELECT p_partkey AS node, CAST((p_partkey * 7919) % 100000 AS DOUBLE) AS x, CAST((p_partkey * 104729) % 100000 AS DOUBLE) AS y FROM part""",
    "v_station": """
        SELECT concat('st:', CAST(s_suppkey AS VARCHAR(20))) AS station_uid,
               CAST((s_suppkey * 7717) % 100000 AS DOUBLE) AS x, CAST((s_suppkey * 60493) % 100000 AS DOUBLE) AS y FROM supplier""",
    "v_parameter": """
        SELECT concat('src', CAST(c_custkey % 3 AS VARCHAR(10)), ':', CAST(c_custkey AS VARCHAR(20))) AS uid,
               CASE c_custkey % 5 WHEN 0 THEN 'efficiency' WHEN 1 THEN 'vom' WHEN 2 THEN 'fuel' WHEN 3 THEN 'ramp_up_pu_per_hour' ELSE 'capital_cost' END AS name,
               CASE c_custkey % 5 WHEN 0 THEN 'technical' WHEN 1 THEN 'economic' WHEN 2 THEN 'environmental' WHEN 3 THEN 'technical' ELSE 'economic' END AS "group",
               round(c_acctbal / 10000, 1) AS value,
               CASE WHEN c_custkey % 17 = 0 THEN 'percent' WHEN c_custkey % 5 = 0 THEN 'p.u.' WHEN c_custkey % 5 = 1 THEN 'EUR/MWh' WHEN c_custkey % 5 = 2 THEN 'EUR/MWh_th' WHEN c_custkey % 5 = 3 THEN 'p.u./h' ELSE 'EUR/MW/year' END AS unit,
               CASE WHEN c_custkey % 19 = 0 THEN 'storage' ELSE 'generator' END AS applies_to_dataset,
               CASE WHEN c_custkey % 50 = 0 THEN concat('gen:', CAST(c_custkey % 100 AS VARCHAR(20))) ELSE NULL END AS applies_to_uid,
               CASE c_custkey % 7 WHEN 0 THEN 'coal' WHEN 1 THEN 'solar' WHEN 2 THEN 'wind' WHEN 3 THEN 'gas' WHEN 4 THEN 'hydropower' WHEN 5 THEN 'nuclear' ELSE NULL END AS class,
               CASE WHEN c_custkey % 8 = 0 THEN 'onshore' ELSE NULL END AS subclass, CAST(NULL AS VARCHAR(10)) AS status,
               CASE WHEN c_custkey % 4 = 0 THEN (c_custkey % 20) * 10.0E0 ELSE NULL END AS capacity_min_mw,
               CASE WHEN c_custkey % 4 = 0 THEN (c_custkey % 20) * 10.0E0 + 200 ELSE NULL END AS capacity_max_mw,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'source' WHEN 'AUTOMOBILE' THEN 'generic' WHEN 'MACHINERY' THEN 'derived' WHEN 'HOUSEHOLD' THEN 'proxy' ELSE 'other' END AS quality,
               CAST(2018 + c_custkey % 8 AS VARCHAR(4)) AS observed_at,
               CASE WHEN c_custkey % 6 = 0 THEN CAST(2020 + c_custkey % 7 AS VARCHAR(4)) ELSE NULL END AS valid_from,
               CASE WHEN c_custkey % 9 = 0 THEN CAST(2023 + c_custkey % 4 AS VARCHAR(4)) ELSE NULL END AS valid_to,
               CASE WHEN c_custkey % 10 = 0 THEN '{{"status":"operating"}}' ELSE '{{}}' END AS selector_json,
               concat('src', CAST(c_custkey % 3 AS VARCHAR(10))) AS source_id, CAST(c_custkey AS VARCHAR(20)) AS source_uid, '1' AS source_version,
               c_custkey % 6 = 0 AS is_derived, CASE WHEN c_custkey % 12 = 0 THEN 'fitted' ELSE NULL END AS derivation
        FROM customer""",
    # the same records with scopes of status, voltage, scenario and location and selectors of two keys
    "v_scoped_parameter": """
        SELECT uid, name, "group", value, unit, applies_to_dataset, applies_to_uid, class, subclass,
               CASE WHEN CAST(source_uid AS BIGINT) % 5 = 1 THEN 'operating' ELSE NULL END AS status, capacity_min_mw,
               CASE WHEN CAST(source_uid AS BIGINT) % 8 = 4 THEN NULL ELSE capacity_max_mw END AS capacity_max_mw,
               CASE CAST(source_uid AS BIGINT) % 6 WHEN 1 THEN array(220.0E0) WHEN 2 THEN array(220.0E0, 500.0E0) WHEN 3 THEN array(1000.0E0, 330.0E0, 500.0E0) ELSE NULL END AS voltage_kv,
               CASE CAST(source_uid AS BIGINT) % 9 WHEN 2 THEN 'base' WHEN 5 THEN 'stress' ELSE NULL END AS scenario,
               CASE WHEN CAST(source_uid AS BIGINT) % 11 = 3 THEN concat('nation:', CAST(CAST(source_uid AS BIGINT) % 25 AS VARCHAR(10))) ELSE NULL END AS location,
               quality, observed_at, valid_from, valid_to,
               CASE CAST(source_uid AS BIGINT) % 13 WHEN 1 THEN '{{"kv":{{"min":300}},"phase":["a","b"]}}' WHEN 2 THEN '{{"phase":"a"}}' ELSE '{{}}' END AS selector_json,
               source_id, source_uid, source_version, is_derived, derivation
        FROM v_parameter""",
    "v_scope_target": """
        SELECT uid, class, subclass, status, capacity_mw, admin_uid,
               CASE CAST(substring(uid, 5) AS BIGINT) % 5 WHEN 0 THEN array(220.0E0) WHEN 1 THEN array(500.0E0, 220.0E0) WHEN 2 THEN array(330.0E0) WHEN 3 THEN array(110.0E0) ELSE NULL END AS voltage_kv,
               CASE WHEN CAST(substring(uid, 5) AS BIGINT) % 10 = 6 THEN NULL ELSE concat('nation:', CAST(CAST(substring(uid, 5) AS BIGINT) % 25 AS VARCHAR(10))) END AS place,
               CASE CAST(substring(uid, 5) AS BIGINT) % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE NULL END AS phase,
               CASE WHEN CAST(substring(uid, 5) AS BIGINT) % 3 = 0 THEN 500.0E0 ELSE 220.0E0 END AS kv
        FROM v_generator""",
    # unit squares of five groups on a lattice that grows with the customers
    "v_square": """
        SELECT DISTINCT concat('group:', CAST(c_custkey % 5 AS VARCHAR(5))) AS grp,
               (c_custkey * 7919) % (SELECT CAST(floor(sqrt(count(*) * 0.6E0)) AS BIGINT) + 1 FROM customer) AS ix,
               CAST(floor(c_custkey / 5.0E0) AS BIGINT) % (SELECT CAST(floor(sqrt(count(*) * 0.6E0)) AS BIGINT) + 1 FROM customer) AS iy
        FROM customer""",
    "v_dispatch": """
        SELECT CAST(date_trunc('hour', ts) AS {ntz}) AS time, CASE WHEN event_type IN ('signup', 'error') THEN 'storage' ELSE 'generator' END AS component,
               concat('unit:', CAST(user_id AS VARCHAR(20))) AS unit_uid, concat('bus:', CAST(user_id % 10 AS VARCHAR(10))) AS bus_uid,
               CASE event_type WHEN 'view' THEN 'wind:onshore' WHEN 'click' THEN 'solar:utility_scale_pv' WHEN 'purchase' THEN 'load_shedding' ELSE 'battery_storage:lithium_ion' END AS carrier,
               sum(CASE WHEN event_type = 'error' THEN -value ELSE value END) AS p_mw
        FROM events GROUP BY 1, 2, 3, 4, 5""",
    "v_load": """
        SELECT CAST(date_trunc('hour', ts) AS {ntz}) AS time, concat('bus:', CAST(user_id % 10 AS VARCHAR(10))) AS uid, sum(value) * 1.5E0 AS p_set_mw
        FROM events GROUP BY 1, 2""",
    # case load on cells, with the bus and population of every cell
    "v_cell_load": """
        SELECT CAST(date_trunc('day', ts) AS {ntz}) AS time, concat('cell:', CAST(user_id AS VARCHAR(20))) AS uid, event_type AS class,
               CASE WHEN user_id % 41 = 3 AND event_type = 'view' THEN NULL ELSE sum(value) END AS demand_mw
        FROM events GROUP BY 1, 2, 3, user_id, event_type""",
    "v_cell_dim": """
        SELECT DISTINCT concat('cell:', CAST(user_id AS VARCHAR(20))) AS uid, concat('bus:', CAST(user_id % 10 AS VARCHAR(10))) AS bus_uid,
               concat('cell:', CAST(user_id % 25 AS VARCHAR(10))) AS spatial_uid, CASE WHEN user_id % 30 = 7 THEN 0.0E0 ELSE user_id * 10.0E0 END AS population
        FROM events""",
    "v_resource": """
        SELECT CAST(date_trunc('day', ts) AS {ntz}) AS time, concat('cell:', CAST(user_id % 20 AS VARCHAR(10))) AS uid,
               CASE event_type WHEN 'view' THEN 'onshore' WHEN 'click' THEN 'utility_scale_pv' ELSE 'run_of_river' END AS class,
               least(avg(value) / 97, 1.0E0) AS availability_pu
        FROM events GROUP BY 1, 2, 3""",
}


def dependencies(sql: str) -> list[str]:
    """Views that a text needs, in definition order."""
    found: set[str] = set()
    queue = [sql]
    while queue:
        text = queue.pop()
        for name in VIEWS:
            if name not in found and re.search(rf"\b{name}\b", text):
                found.add(name)
                queue.append(VIEWS[name])
    return [v for v in VIEWS if v in found]


def with_views(body: str) -> str:
    """DuckDB text: the needed views as common table expressions before the body."""
    parts = [f"{v} AS ({VIEWS[v].format(ntz='TIMESTAMP').replace('array(', 'list_value(')})" for v in dependencies(body)]
    body = body.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH "):
        parts.append(body[len("WITH RECURSIVE "):] if recursive else body[len("WITH "):])
        return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts)
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def _cells(t: "Tables") -> DataFrame:
    from ..operators.cells import box_cells

    return box_cells(t.v_admin, 15.0, (0.0, 0.0)).drop("source_cell_uid")


def _weights(t: "Tables") -> DataFrame:
    empty = (F.col("spatial_level") == "marine_zone") & (F.col("x0") + F.col("y0") > 90)
    scaled = F.col("area") * (1 + (F.col("x0") + F.col("y0")).cast("int") % 3)
    return t.v_cell.select("spatial_uid", F.when(empty, 0.0).otherwise(scaled).alias("weight"))


# Views that Spark builds with the engine's own operators instead of the inequality joins of the text.
SPARK_VIEWS = {"v_cell": _cells, "v_weight": _weights}


class Tables:
    """The given tables and the derived views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in SPARK_VIEWS:
            return SPARK_VIEWS[name](self)
        if name in VIEWS:
            return self.view(name)
        raise AttributeError(name)

    def view(self, name: str) -> DataFrame:
        needed = [*dependencies(VIEWS[name]), name]
        bases = [b for b in BASE if any(re.search(rf"\b{b}\b", VIEWS[v]) for v in needed)]
        ctes = [f"{b} AS (SELECT * FROM parquet.`{self.folder}/{b}.parquet`)" for b in bases]
        ctes += [f"{v} AS ({VIEWS[v].format(ntz='TIMESTAMP_NTZ')})" for v in needed]
        text = ("WITH " + ", ".join(ctes) + f" SELECT * FROM {name}").replace('"group"', "`group`")
        return self.spark.sql(text)
