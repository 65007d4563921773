"""Scalar functions, rules, filters and time-series queries."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregate, backend, dispatch, payloads, reports, rules, timeseries
from .registry import query, rounded

HOUR, DAY = timedelta(hours=1), timedelta(days=1)

SLUG_SQL = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query("snake_case", f"SELECT p_partkey AS id, {SLUG_SQL.format('concat(p_brand, chr(32), p_name)')} AS slug FROM part")
def snake_case(t):
    return t.part.select(F.col("p_partkey").alias("id"), S.slug(F.concat("p_brand", F.lit(" "), "p_name")).alias("slug"))


@query(
    "canonical_names",
    f"""SELECT p_partkey AS id, CASE WHEN {SLUG_SQL.format('p_name')} = 'red_widget' THEN 'widget' ELSE {SLUG_SQL.format('p_name')} END AS name FROM part""",
)
def canonical_names(t):
    return t.part.select(F.col("p_partkey").alias("id"), S.canonical_name("p_name", {"Red_Widget": "Widget"}).alias("name"))


@query(
    "asset_scope",
    """SELECT uid, status IN ('Operating', 'operating', 'In construction') AND admin_uid IN ('nation:0', 'nation:1', 'nation:2') AS in_scope FROM v_generator""",
)
def asset_scope(t):
    ok = S.in_scope("admin_uid", "status", ["Nation 0", "nation:1", "NATION-2"], ["operating", "In  Construction"])
    return t.v_generator.select("uid", ok.alias("in_scope"))


@query(
    "parameter_groups",
    """WITH named AS (SELECT p_partkey AS id, CASE p_size % 10 WHEN 0 THEN 'co2_intensity' WHEN 1 THEN 'vom' WHEN 2 THEN 'Fuel' WHEN 3 THEN 'Fuel price'
         WHEN 4 THEN 'ramp_up' WHEN 5 THEN 'p_nom_ratio' WHEN 6 THEN 'economic lifetime' WHEN 7 THEN 'lifetime' WHEN 8 THEN p_name ELSE 'capture_rate' END AS name FROM part)
       SELECT id, CASE WHEN name IN ('co2_intensity', 'Fuel', 'capture_rate') THEN 'environmental' WHEN name IN ('vom', 'Fuel price', 'economic lifetime') THEN 'economic'
              WHEN name IN ('ramp_up', 'p_nom_ratio', 'lifetime') THEN 'technical' ELSE 'others' END AS family FROM named""",
)
def parameter_groups(t):
    names = ("co2_intensity", "vom", "Fuel", "Fuel price", "ramp_up", "p_nom_ratio", "economic lifetime", "lifetime")
    picked = F.coalesce(
        F.get(F.lit(list(names)), (F.col("p_size") % 10).cast("int")),
        F.when(F.col("p_size") % 10 == 8, F.col("p_name")).otherwise("capture_rate"),
    )
    return t.part.select(F.col("p_partkey").alias("id"), S.parameter_group(picked).alias("family"))


@query(
    "osm_voltages",
    """SELECT uid, coalesce(array_to_string(list_sort(list_distinct(list_transform(list_filter(list_transform(
              regexp_extract_all(coalesce(voltage, ''), '\\d+(?:\\.\\d+)?'), lambda x: CAST(x AS DOUBLE)), lambda x: x >= 1000), lambda x: CAST(x / 1000 AS INT)))), ';'), '') AS levels,
              CASE WHEN voltage LIKE '%kV%' OR voltage IS NULL THEN 0 ELSE len(string_split(voltage, ';')) END AS plain
       FROM v_line""",
)
def osm_voltages(t):
    text = F.array_join(F.transform(S.tag_voltages("voltage"), lambda v: S.general_label(v)), ";")
    return t.v_line.select("uid", text.alias("levels"), F.size(S.tag_numbers("voltage")).alias("plain"))


@query("current_type", "SELECT uid, CASE WHEN frequency = '0' THEN 'DC' ELSE 'AC' END AS current_type FROM v_line")
def current_type(t):
    return t.v_line.select("uid", S.current_type("frequency", "name").alias("current_type"))


@query(
    "partial_time_bounds",
    """WITH p AS (SELECT o_orderkey AS id, o_orderdate AS d, o_orderkey % 4 AS k FROM orders)
       SELECT id, CAST(CASE k WHEN 0 THEN date_trunc('year', d) WHEN 1 THEN date_trunc('month', d) ELSE d END AS VARCHAR) AS lo,
              CAST(CASE k WHEN 0 THEN date_trunc('year', d) + INTERVAL 1 YEAR WHEN 1 THEN date_trunc('month', d) + INTERVAL 1 MONTH
                   WHEN 2 THEN d + INTERVAL 1 DAY ELSE d + INTERVAL 1 SECOND END AS VARCHAR) AS hi FROM p""",
)
def partial_time_bounds(t):
    d = F.col("o_orderdate")
    k = F.col("o_orderkey") % 4
    text = (
        F.when(k == 0, F.date_format(d, "yyyy")).when(k == 1, F.date_format(d, "yyyy-MM"))
        .when(k == 2, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "yyyy-MM-dd HH:mm:ss"))
    )
    return t.orders.select(
        F.col("o_orderkey").alias("id"), S.time_start(text).cast("string").alias("lo"), S.time_end(text).cast("string").alias("hi")
    )


@query(
    "release_times",
    """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m') WHEN 1 THEN strftime(o_orderdate, '%Y') ELSE NULL END AS version_time FROM orders""",
)
def release_times(t):
    k = F.col("o_orderkey") % 3
    text = (
        F.when(k == 0, F.date_format("o_orderdate", "MMMM yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy")).otherwise("release 7")
    )
    return t.orders.select(F.col("o_orderkey").alias("id"), S.version_time(text).alias("version_time"))


@query(
    "tag_scalars",
    """SELECT l_orderkey AS id, l_linenumber AS line, count(*) AS rows_,
              CASE l_returnflag WHEN 'A' THEN true WHEN 'N' THEN false ELSE NULL END AS flag,
              CASE WHEN l_linenumber % 3 = 0 THEN l_linenumber ELSE 1 END AS circuits,
              CASE WHEN l_linestatus = 'O' THEN 'wind:onshore' ELSE 'wind' END AS carrier
       FROM lineitem GROUP BY 1, 2, 4, 5, 6""",
)
def tag_scalars(t):
    word = F.when(F.col("l_returnflag") == "A", " Yes").when(F.col("l_returnflag") == "N", "FALSE ").otherwise("maybe")
    text = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("x"), F.col("l_linenumber").cast("string"), F.lit(" lines 99"))).otherwise("none")
    sub = F.when(F.col("l_linestatus") == "O", "onshore")
    d = t.lineitem.select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), S.tri_state(word).alias("flag"),
        S.circuit_count(text).alias("circuits"), S.carrier(F.lit("wind"), sub).alias("carrier"),
    )
    return d.groupBy(*d.columns).agg(F.count("*").alias("rows_"))


@query(
    "json_selectors",
    """SELECT uid, json_type(CAST(selector_json AS JSON)) = 'OBJECT' AS is_object, selector_json LIKE '%operating%' AS has_status FROM v_parameter""",
)
def json_selectors(t):
    status = F.from_json("selector_json", "map<string,string>")["status"]
    return t.v_parameter.select("uid", S.is_json_object("selector_json").alias("is_object"), F.coalesce(status == "operating", F.lit(False)).alias("has_status"))


# --- rules --------------------------------------------------------------------------------------
RULES = [
    {"rule_id": "ring_small", "priority": 10, "source_type_pattern": "^economy$", "technology_pattern": "ring$", "fuel_pattern": "", "dataset": "generator", "class": "coal", "subclass": "ring"},
    {"rule_id": "any_bolt", "priority": 20, "source_type_pattern": "", "technology_pattern": "bolt|NUT", "fuel_pattern": "", "dataset": "storage", "class": "battery_storage", "subclass": ""},
    {"rule_id": "brand_two", "priority": 30, "source_type_pattern": "^(?:small|large)$", "technology_pattern": "", "fuel_pattern": "brand#2", "dataset": "generator", "class": "gas", "subclass": "two"},
    {"rule_id": "rest", "priority": 90, "source_type_pattern": ".*", "technology_pattern": ".*", "fuel_pattern": ".*", "dataset": "generator", "class": "other", "subclass": ""},
]
CLASSIFY_SQL = """CASE WHEN regexp_matches(p_type, '^economy$', 'i') AND regexp_matches(p_name, 'ring$', 'i') THEN 'ring_small'
  WHEN regexp_matches(p_name, 'bolt|NUT', 'i') THEN 'any_bolt'
  WHEN regexp_matches(p_type, '^(?:small|large)$', 'i') AND regexp_matches(p_brand, 'brand#2', 'i') THEN 'brand_two' ELSE 'rest' END"""


@query(
    "classify_first_match",
    f"""WITH m AS (SELECT p_partkey AS id, {CLASSIFY_SQL} AS mapping_rule_id FROM part)
        SELECT id, mapping_rule_id, CASE mapping_rule_id WHEN 'any_bolt' THEN 'storage' ELSE 'generator' END AS dataset,
               CASE mapping_rule_id WHEN 'ring_small' THEN 'coal' WHEN 'any_bolt' THEN 'battery_storage' WHEN 'brand_two' THEN 'gas' ELSE 'other' END AS class,
               CASE mapping_rule_id WHEN 'ring_small' THEN 'ring' WHEN 'brand_two' THEN 'two' END AS subclass FROM m""",
)
def classify_first_match(t):
    d = rules.classify(t.part, RULES, "p_type", "p_name", "p_brand")
    return d.select(F.col("p_partkey").alias("id"), "mapping_rule_id", "dataset", "class", "subclass")


@query(
    "classify_technology",
    """SELECT p_partkey AS id, CASE WHEN regexp_matches(p_name, 'ring$', 'i') THEN 'coal' WHEN regexp_matches(p_name, 'bolt|nut', 'i') THEN 'battery_storage' ELSE 'other_storage' END AS class FROM part""",
)
def classify_technology(t):
    return rules.classify_technology(t.part, RULES[:2], "p_name").select(F.col("p_partkey").alias("id"), "class")


@query(
    "classify_by_capacity",
    """SELECT uid, CASE WHEN class = 'coal' AND capacity_mw >= 100 AND capacity_mw < 300 THEN 0 WHEN class = 'coal' AND capacity_mw >= 0 THEN 1
              WHEN class = 'gas' AND technology LIKE '%gear%' AND capacity_mw >= 50 THEN 2 END AS rule_index FROM v_generator""",
)
def classify_by_capacity(t):
    table = [
        {"source_asset_type": "coal", "source_technology_pattern": "", "capacity_min_mw": 100, "capacity_max_mw": 300},
        {"source_asset_type": "coal", "source_technology_pattern": ".*", "capacity_min_mw": 0, "capacity_max_mw": None},
        {"source_asset_type": "gas", "source_technology_pattern": "gear", "capacity_min_mw": 50, "capacity_max_mw": None},
    ]
    index = rules.classify_with_capacity(t.v_generator, table, F.col("class"), F.col("technology"), F.col("capacity_mw"))
    return t.v_generator.select("uid", index.alias("rule_index"))


@query(
    "fuel_labels",
    """WITH f AS (SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN 'Natural Gas, LNG' WHEN 1 THEN 'Fuel oil / hydrogen' WHEN 2 THEN p_name WHEN 3 THEN NULL WHEN 4 THEN 'xlngx' ELSE 'coal mine methane' END AS fuel FROM part)
       SELECT id, CASE fuel WHEN 'Natural Gas, LNG' THEN 'lng;natural_gas' WHEN 'Fuel oil / hydrogen' THEN 'oil;hydrogen_blend' WHEN 'coal mine methane' THEN 'coal_methane' ELSE lower(fuel) END AS label FROM f""",
)
def fuel_labels(t):
    k = F.col("p_size") % 6
    fuel = (
        F.when(k == 0, "Natural Gas, LNG").when(k == 1, "Fuel oil / hydrogen").when(k == 2, F.col("p_name")).when(k == 4, "xlngx").when(k == 5, "coal mine methane")
    )
    return t.part.select(F.col("p_partkey").alias("id"), S.fuel_labels(fuel).alias("label"))


@query(
    "detailed_types",
    """SELECT p_partkey AS id, CASE WHEN p_type = 'ECONOMY' THEN CASE WHEN p_name LIKE '%red%' THEN 'natural_gas' ELSE 'other_oil_gas' END
              WHEN p_type = 'SMALL' THEN CASE WHEN p_name LIKE '%blue%' THEN 'offshore_wind' ELSE 'onshore_wind' END
              WHEN p_type = 'MEDIUM' THEN CASE WHEN p_name LIKE '%red%' THEN 'pumped_storage' WHEN p_name LIKE '%blue%' THEN 'run_of_river_hydropower' ELSE 'other_hydropower' END
              ELSE lower(p_type) END AS generator_type,
              CASE WHEN p_name LIKE '%ring%' THEN 'lithium_ion_storage' WHEN p_name LIKE '%bolt%' THEN 'thermal_storage' ELSE 'other_storage' END AS storage_type
       FROM part""",
)
def detailed_types(t):
    name = F.col("p_name")
    kind = S.lookup({"ECONOMY": "oil/gas", "SMALL": "wind", "MEDIUM": "hydropower"}, "p_type")
    tech = F.concat(
        F.when(name.contains("blue"), "Offshore run-of-river ").otherwise(""), F.when(name.contains("red"), "Pumped storage").otherwise("")
    )
    fuel = F.when(name.contains("red"), "Fossil gas")
    stored = F.concat(F.when(name.contains("ring"), "Lithium-ion ").otherwise(""), F.when(name.contains("bolt"), "Sensible HEAT").otherwise(""))
    return t.part.select(
        F.col("p_partkey").alias("id"), rules.generator_type(F.coalesce(kind, F.lower("p_type")), tech, fuel).alias("generator_type"),
        rules.storage_type(stored).alias("storage_type"),
    )


@query(
    "filter_assets",
    "SELECT uid, round(capacity_mw, 6) AS capacity_mw FROM v_generator WHERE lower(status) IN ('operating', 'retired') AND capacity_mw BETWEEN 100 AND 400",
)
def filter_assets(t):
    return rounded(aggregate.filter_assets(t.v_generator, ["Operating", "Retired"], 100.0, 400.0, "capacity_mw").select("uid", "capacity_mw"))


# --- series -------------------------------------------------------------------------------------
@query(
    "align_downsample",
    """WITH b AS (SELECT uid, class, time_bucket(INTERVAL 7 HOUR, time, TIMESTAMP '2024-01-01 00:00:00') AS bin, avg(demand_mw) AS demand_mw FROM v_series GROUP BY 1, 2, 3),
            bins AS (SELECT DISTINCT bin FROM (SELECT unnest(generate_series((SELECT min(bin) FROM b), (SELECT max(bin) FROM b), INTERVAL 7 HOUR)) AS bin)),
            k AS (SELECT DISTINCT uid, class FROM v_series)
       SELECT CAST(bins.bin AS VARCHAR) AS time, k.uid, k.class, round(b.demand_mw, 6) AS demand_mw
       FROM bins CROSS JOIN k LEFT JOIN b ON b.bin = bins.bin AND b.uid = k.uid AND b.class = k.class""",
)
def align_downsample(t):
    return rounded(timeseries.downsample(t.v_series, timedelta(hours=7), "demand_mw"))


@query(
    "align_upsample",
    """WITH s AS (SELECT time, uid, demand_mw, lead(demand_mw) OVER (PARTITION BY uid ORDER BY time) AS nxt FROM (SELECT time, uid, class, runoff AS demand_mw FROM v_daily)),
            f AS (SELECT time + INTERVAL (x.h) HOUR AS time, uid, CASE WHEN x.h = 0 THEN demand_mw ELSE demand_mw + (x.h / 24.0E0) * (nxt - demand_mw) END AS demand_mw
                  FROM s JOIN (SELECT unnest([0, 6, 12, 18]) AS h) x ON x.h = 0 OR nxt IS NOT NULL)
       SELECT CAST(time AS VARCHAR) AS time, uid, round(demand_mw, 6) AS demand_mw FROM f""",
)
def align_upsample(t):
    d = t.v_daily.withColumnRenamed("runoff", "demand_mw")
    return rounded(timeseries.upsample(d, DAY, timedelta(hours=6), "demand_mw").select("time", "uid", "demand_mw"))


@query(
    "zone_shift",
    "SELECT CAST(time + INTERVAL 8 HOUR AS VARCHAR) AS time, uid, class, round(demand_mw, 6) AS demand_mw FROM v_series WHERE time + INTERVAL 8 HOUR BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'",
)
def zone_shift(t):
    local = timeseries.to_local(t.v_series, "UTC", "Asia/Shanghai")
    return rounded(timeseries.between_times(local, "2024-01-05 00:00:00", "2024-01-20 12:00:00"))


@query(
    "rolling_centered",
    "SELECT CAST(time AS VARCHAR) AS time, uid, round(avg(runoff) OVER (PARTITION BY uid ORDER BY time ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING), 6) AS smooth FROM v_daily",
)
def rolling_centered(t):
    return rounded(timeseries.centered_mean(t.v_daily, 24, DAY, "runoff", "smooth", block_steps=64).select("time", "uid", "smooth"))


@query(
    "run_of_river",
    """WITH f AS (SELECT time, uid, avg(greatest(runoff, 0.0E0)) OVER (PARTITION BY uid ORDER BY time ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS flow FROM v_daily),
            u AS (SELECT time, uid, greatest(flow - 0.2E0 * avg(flow) OVER (PARTITION BY uid), 0.0E0) AS usable FROM f),
            q AS (SELECT uid, quantile_cont(usable, 0.7) AS design FROM u GROUP BY uid)
       SELECT CAST(time AS VARCHAR) AS time, u.uid, round(coalesce(least(greatest(CASE WHEN design > 0 THEN usable / design END, 0.0E0), 1.0E0), 0.0E0), 6) AS availability_pu FROM u JOIN q ON u.uid = q.uid""",
)
def run_of_river(t):
    return rounded(timeseries.run_of_river(t.v_daily, smoothing_steps=6, design_quantile=0.7, environmental_fraction=0.2, step=DAY))


@query(
    "hydro_shape",
    """WITH f AS (SELECT time, uid, avg(greatest(runoff, 0.0E0)) OVER (PARTITION BY uid ORDER BY time ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS flow FROM v_daily)
       SELECT CAST(time AS VARCHAR) AS time, uid, round(coalesce(least(greatest(0.4E0 * flow / nullif(avg(flow) OVER (PARTITION BY uid), 0), 0.0E0), 1.0E0), 0.0E0), 6) AS availability_pu FROM f""",
)
def hydro_shape(t):
    return rounded(timeseries.hydro_shape(t.v_daily, smoothing_steps=7, target_mean=0.4, step=DAY))


@query(
    "stacked_availability",
    """SELECT CAST(time AS VARCHAR) AS time, uid, 'onshore' AS class, round(least(greatest(demand_mw / 300, 0.0E0), 1.0E0), 6) AS availability_pu FROM v_hourly
       UNION ALL SELECT CAST(time AS VARCHAR), uid, 'run_of_river', round(least(greatest(demand_mw / 900 - 0.1, 0.0E0), 1.0E0), 6) FROM v_hourly""",
)
def stacked_availability(t):
    h = t.v_hourly
    parts = {"onshore": h.withColumn("v", F.col("demand_mw") / 300), "run_of_river": h.withColumn("v", F.col("demand_mw") / 900 - 0.1)}
    return rounded(timeseries.stack_classes(parts, "v"))


@query(
    "common_times",
    """WITH a AS (SELECT time, uid, demand_mw FROM v_hourly WHERE uid <= 'error'), b AS (SELECT time, uid, demand_mw FROM v_hourly WHERE uid > 'error'),
            c AS (SELECT time FROM a INTERSECT SELECT time FROM b)
       SELECT CAST(x.time AS VARCHAR) AS time, x.uid, round(x.demand_mw, 6) AS demand_mw FROM (SELECT * FROM a UNION ALL SELECT * FROM b) x WHERE x.time IN (SELECT time FROM c)""",
)
def common_times(t):
    h = t.v_hourly.select("time", "uid", "demand_mw")
    a, b = timeseries.common_times(h.where("uid <= 'error'"), h.where("uid > 'error'"))
    return rounded(a.unionByName(b))


@query(
    "missing_times",
    "SELECT CAST(time AS VARCHAR) AS time FROM (SELECT time FROM v_hours EXCEPT SELECT time FROM v_hourly WHERE demand_mw > 400)",
)
def missing_times(t):
    return rounded(timeseries.missing_times(t.v_hours, t.v_hourly.where("demand_mw > 400")))


@query(
    "step_inference",
    "SELECT count(*) AS n, CASE WHEN count(*) = date_diff('hour', min(time), max(time)) + 1 THEN '3600 s' ELSE 'irregular' END AS step FROM v_hours",
)
def step_inference(t):
    return timeseries.infer_step(t.v_hours)


@query(
    "year_checks",
    """SELECT count(DISTINCT time) AS hours, count(*) FILTER (WHERE v IS NULL) AS missing, count(*) FILTER (WHERE v < 0 OR v > 1) AS out_of_range, count(DISTINCT time) IN (8760, 8784) AS complete_year
       FROM (SELECT time, CASE WHEN demand_mw > 400 THEN NULL ELSE demand_mw / 200 END AS v FROM v_hourly)""",
)
def year_checks(t):
    return timeseries.year_checks(t.v_hourly.withColumn("v", F.when(F.col("demand_mw") <= 400, F.col("demand_mw") / 200)), "v")


@query(
    "horizon_windows",
    "SELECT CAST(time AS VARCHAR) AS time, CAST(floor(date_diff('hour', (SELECT min(time) FROM v_hours), time) / 4.0E0) AS BIGINT) AS window_id FROM v_hours",
)
def horizon_windows(t):
    return rounded(timeseries.horizon_windows(t.v_hours, 4, HOUR))


@query(
    "availability_matrix",
    """WITH d AS (SELECT DISTINCT time FROM v_resource), p AS (SELECT time, uid, avg(availability_pu) AS availability_pu FROM v_resource GROUP BY 1, 2),
            a AS (SELECT uid, class, concat('cell:', CAST(CAST(substr(uid, 5) AS BIGINT) % 60 AS VARCHAR(10))) AS cell FROM v_generator)
       SELECT CAST(d.time AS VARCHAR) AS time, a.uid, round(coalesce(p.availability_pu, CASE WHEN a.class IN ('wind', 'solar', 'hydropower') THEN 0.0E0 ELSE 1.0E0 END), 6) AS p_max_pu
       FROM a CROSS JOIN d LEFT JOIN p ON p.uid = a.cell AND p.time = d.time""",
)
def availability_matrix(t):
    assets = t.v_generator.select(
        "uid", "class", F.concat(F.lit("cell:"), (F.substring("uid", 5, 20).cast("long") % 60).cast("string")).alias("cell")
    )
    cell = t.v_resource.groupBy("time", F.col("uid").alias("cell")).agg(F.avg("availability_pu").alias("availability_pu"))
    profiles = assets.join(cell, "cell").select("time", "uid", "availability_pu")
    return rounded(timeseries.availability_matrix(assets, t.v_resource.select("time"), profiles, backend.VARIABLE_CLASSES, DAY))


# --- dispatch and charts ------------------------------------------------------------------------
@query(
    "dispatch_by_class",
    """SELECT CAST(time AS VARCHAR) AS time, split_part(carrier, ':', 1) AS class,
              round(sum(CASE WHEN component = 'generator' THEN p_mw ELSE 0 END), 6) AS generation_mw,
              round(sum(CASE WHEN component = 'storage' THEN greatest(p_mw, 0) ELSE 0 END), 6) AS storage_discharge_mw,
              round(sum(CASE WHEN component = 'storage' THEN least(p_mw, 0) ELSE 0 END), 6) + 0.0 AS storage_charge_mw
       FROM v_dispatch GROUP BY 1, 2""",
)
def dispatch_by_class(t):
    return rounded(dispatch.dispatch_by_class(t.v_dispatch))


@query(
    "dispatch_in_scope",
    """SELECT CAST(time AS VARCHAR) AS time, split_part(carrier, ':', 1) AS class, round(sum(CASE WHEN component = 'generator' THEN p_mw ELSE 0 END), 6) AS generation_mw
       FROM v_dispatch WHERE bus_uid IN (SELECT uid FROM v_bus WHERE admin_uid IN ('nation:15', 'nation:20', 'nation:16')) AND time >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1, 2""",
)
def dispatch_in_scope(t):
    buses = dispatch.selected_buses(t.v_bus, ["nation:15", "nation:20", "nation:16"])
    window = dispatch.snapshot_window(t.v_dispatch, "2024-01-10 00:00:00")
    return rounded(dispatch.dispatch_by_class(window, buses).select("time", "class", "generation_mw"))


@query(
    "dispatch_summary",
    """WITH d AS (SELECT sum(CASE WHEN carrier = 'load_shedding' THEN p_mw END) AS shed, sum(CASE WHEN component = 'storage' THEN greatest(p_mw, 0) END) AS dis, -sum(CASE WHEN component = 'storage' THEN least(p_mw, 0) END) AS chg FROM v_dispatch),
            l AS (SELECT sum(p_set_mw) AS load, count(DISTINCT time) AS snapshots FROM v_load)
       SELECT snapshots, round(load, 4) AS load_mwh, round(shed, 4) AS load_shedding_mwh, round(shed / load, 4) AS load_shedding_share, round(dis, 4) AS storage_discharge_mwh, round(chg, 4) AS storage_charge_mwh FROM d, l""",
)
def dispatch_summary(t):
    return rounded(dispatch.run_summary(t.v_dispatch, t.v_load), 4)


@query(
    "dispatch_validity",
    """WITH lim AS (SELECT unit_uid, 60.0E0 AS p_nom FROM v_dispatch GROUP BY 1)
       SELECT min(CASE WHEN component = 'generator' THEN p_mw END) >= -0.001 AND max(CASE WHEN component = 'storage' THEN greatest(abs(p_mw) - p_nom, 0) END) <= 0.001 AS dispatch_valid,
              round(min(CASE WHEN component = 'generator' THEN p_mw END), 6) AS generator_min_mw, round(max(CASE WHEN component = 'storage' THEN greatest(abs(p_mw) - p_nom, 0) END), 6) AS storage_limit_excess_mw
       FROM v_dispatch JOIN lim USING (unit_uid)""",
)
def dispatch_validity(t):
    limits = t.v_dispatch.select(F.col("unit_uid").alias("uid")).distinct().withColumn("p_nom", F.lit(60.0))
    return rounded(dispatch.dispatch_validity(t.v_dispatch, t.v_load, limits))


@query(
    "operation_series",
    """WITH w AS (SELECT time, unit_uid AS uid, sum(p_mw) AS p, sum(abs(p_mw)) AS s FROM v_dispatch GROUP BY 1, 2)
       SELECT CAST(time AS VARCHAR) AS time, 'storage' AS component, uid, 'p_mw' AS variable, round(p, 6) AS value, 'MW' AS unit FROM w
       UNION ALL SELECT CAST(time AS VARCHAR), 'storage', uid, 'state_of_charge_mwh', round(s, 6), 'MWh' FROM w
       UNION ALL SELECT CAST(time AS VARCHAR), 'load', uid, 'p_set_mw', round(p_set_mw, 6), 'MW' FROM v_load""",
)
def operation_series(t):
    wide = t.v_dispatch.groupBy("time", F.col("unit_uid").alias("uid")).agg(F.sum("p_mw").alias("p"), F.sum(F.abs("p_mw")).alias("state_of_charge"))
    return rounded(dispatch.operation_series({"storage": wide, "load": t.v_load.withColumnRenamed("p_set_mw", "p_set")}))


@query(
    "result_summary",
    """WITH d AS (SELECT sum(CASE WHEN carrier = 'load_shedding' THEN p_mw END) AS shed, sum(CASE WHEN component = 'storage' THEN greatest(p_mw, 0) END) AS dis, -sum(CASE WHEN component = 'storage' THEN least(p_mw, 0) END) AS chg,
              CAST(count(*) FILTER (WHERE component = 'generator' AND p_mw > 50) AS DOUBLE) AS hrs FROM v_dispatch), l AS (SELECT sum(p_set_mw) AS load FROM v_load)
       SELECT round(load / 1000, 4) AS daily_load_gwh, round(shed / 1000, 4) AS load_shedding_gwh, round(dis / 1000, 4) AS storage_discharge_gwh, round(chg / 1000, 4) AS storage_charging_gwh,
              round(100 * shed / load, 4) AS load_shedding_share_percent, hrs AS committed_cluster_hours FROM d, l""",
)
def result_summary(t):
    status = t.v_dispatch.select(F.when((F.col("component") == "generator") & (F.col("p_mw") > 50), 1.0).otherwise(0.0).alias("status"))
    return rounded(dispatch.result_summary(t.v_dispatch, t.v_load, status), 4)


@query(
    "dispatch_layer",
    """WITH c AS (SELECT time, split_part(carrier, ':', 1) AS id, sum(CASE WHEN component = 'generator' THEN p_mw ELSE 0 END) AS g,
              sum(CASE WHEN component = 'storage' THEN greatest(p_mw, 0) ELSE 0 END) AS d, sum(CASE WHEN component = 'storage' THEN least(p_mw, 0) ELSE 0 END) AS h FROM v_dispatch GROUP BY 1, 2),
            l AS (SELECT id, 'generation' AS kind, g AS v FROM c UNION ALL SELECT id, 'storage_discharge', d FROM c UNION ALL SELECT id, 'storage_charge', h FROM c)
       SELECT id, kind, count(*) AS points, round(sum(v), 4) AS total FROM l GROUP BY 1, 2 HAVING sum(abs(v)) > 0""",
)
def dispatch_layer(t):
    layer = payloads.series_arrays(payloads.dispatch_layer(dispatch.dispatch_by_class(t.v_dispatch)))
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v)
    return rounded(layer.select("id", "kind", F.size("values").cast("long").alias("points"), total.alias("total")), 4)


@query(
    "annual_class_map",
    "SELECT uid, class, round(sum(demand_mw) / 1e6, 6) AS value FROM v_series WHERE year(time) = 2024 GROUP BY 1, 2",
)
def annual_class_map(t):
    return rounded(payloads.annual_map(t.v_series, 2024, "demand_mw", "load"))


@query("annual_resource_map", "SELECT uid, class, round(avg(availability_pu), 6) AS value FROM v_resource WHERE year(time) = 2024 GROUP BY 1, 2")
def annual_resource_map(t):
    return rounded(payloads.annual_map(t.v_resource, 2024, "availability_pu", "resource"))


@query(
    "availability_summary",
    "SELECT class, round(avg(availability_pu), 6) AS annual_mean_pu, round(min(availability_pu), 6) AS minimum_pu, round(max(availability_pu), 6) AS maximum_pu FROM v_resource GROUP BY 1",
)
def availability_summary(t):
    return rounded(reports.availability_summary(t.v_resource))


@query(
    "regional_load_summary",
    "SELECT uid, count(demand_mw) AS hours, round(sum(demand_mw), 4) AS energy, round(max(demand_mw), 4) AS peak FROM v_series GROUP BY 1",
)
def regional_load_summary(t):
    return rounded(reports.regional_load_summary(t.v_series, "uid", "demand_mw"), 4)


@query(
    "node_load_table",
    "SELECT uid AS node_uid, round(max(p_set_mw) * 1000, 4) AS peak_load_mw, round(sum(p_set_mw) * 1000, 4) AS daily_energy_mwh FROM v_load GROUP BY 1",
)
def node_load_table(t):
    return rounded(reports.node_load_table(t.v_load.select(F.col("uid").alias("node_uid"), F.col("p_set_mw").alias("load_gwh"))), 4)
