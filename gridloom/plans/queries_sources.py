"""Source scan and standardisation queries on records shaped from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells, contracts, skew, standardize
from ..sources import files, inventory
from .queries_series import RULES
from .registry import query, rounded


@query(
    "raster_blocks",
    """WITH p AS (SELECT l_partkey AS r, l_suppkey AS c, l_quantity - 5 AS v, l_linenumber <> 7 AS ok FROM lineitem),
            b AS (SELECT CAST(floor(r / 30.0E0) * 30 AS BIGINT) AS row_start, CAST(floor(c / 30.0E0) * 30 AS BIGINT) AS col_start, sum(CASE WHEN ok THEN greatest(v, 0) ELSE 0 END) AS population, count(*) FILTER (WHERE ok) AS n FROM p GROUP BY 1, 2)
       SELECT concat('pop:', CAST(row_start AS VARCHAR(20)), ':', CAST(col_start AS VARCHAR(20))) AS uid, 'cell_population' AS class, round(population, 4) AS population, n AS source_cell_count, row_start, col_start,
              concat(CAST(row_start AS VARCHAR(20)), ':', CAST(row_start + 30 AS VARCHAR(20)), ':', CAST(col_start AS VARCHAR(20)), ':', CAST(col_start + 30 AS VARCHAR(20))) AS source_uid FROM b WHERE n > 0""",
)
def raster_blocks(t):
    pixels = t.lineitem.select(
        F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col"), (F.col("l_quantity") - 5).alias("value"), (F.col("l_linenumber") != 7).alias("valid")
    )
    return rounded(standardize.population_blocks(pixels, 30, "pop"), 4)


OPL_SQL = """SELECT p_partkey AS node, round(CAST((p_partkey * 7919) % 36000 AS DOUBLE) / 100 - 180, 6) AS lon, round(CAST((p_partkey * 4729) % 18000 AS DOUBLE) / 100 - 90, 6) AS lat FROM part WHERE p_size % 10 <> 3"""


def _opl_lines(t):
    k = F.col("p_partkey")
    lon = F.format_string("%.2f", ((k * 7919) % 36000).cast("double") / 100 - 180)
    lat = F.when(F.col("p_size") % 10 != 3, F.concat(F.lit(" y"), F.format_string("%.2f", ((k * 4729) % 18000).cast("double") / 100 - 90))).otherwise("")
    nodes = t.part.select(F.concat(F.lit("n"), k.cast("string"), F.lit(" v1 dV x"), lon, lat).alias("value"))
    ways = t.v_refs.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("r")).select(
        F.concat(
            F.lit("w"), F.substring("uid", 5, 20), F.lit(" v1 Tname=%20%x N"),
            F.array_join(F.transform("r", lambda e: F.concat(F.lit("n"), e["node"].cast("string"))), ","),
        ).alias("value")
    )
    return nodes.unionByName(ways)


@query("opl_nodes", OPL_SQL)
def opl_nodes(t):
    return rounded(files.parse_opl(_opl_lines(t))[0])


@query("opl_refs", "SELECT concat('osm:way:', substr(uid, 5)) AS uid, pos, node FROM v_refs")
def opl_refs(t):
    return files.parse_opl(_opl_lines(t))[1]


@query(
    "file_inventory",
    """WITH d AS (SELECT doc_id, concat('docs/', source, '/', CAST(doc_id AS VARCHAR(20))) AS path, md5(text) AS sum, CAST(strlen(text) AS BIGINT) AS size FROM documents)
       SELECT concat('src:', CAST(doc_id AS VARCHAR(20))) AS source_id,
              CASE doc_id % 6 WHEN 0 THEN 'available' WHEN 1 THEN 'checksum_mismatch' WHEN 2 THEN 'available' WHEN 3 THEN 'local_path_mismatch' WHEN 4 THEN CASE WHEN doc_id % 4 = 0 THEN 'manual_action_required' ELSE 'credentials_required' END ELSE 'invalid_source_file' END AS status,
              CASE WHEN doc_id % 6 <> 4 THEN size END AS size_bytes, CASE doc_id % 6 WHEN 4 THEN '' WHEN 2 THEN '' ELSE sum END AS checksum FROM d""",
)
def file_inventory(t):
    k = F.col("doc_id") % 6
    path = F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"))
    d = t.documents.select("doc_id", "source", path.alias("path"), F.col("text"), k.alias("k"))
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    stored = d.where("k <> 4").select(
        F.when(F.col("k") == 3, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")).alias("path"), name.alias("file_name"),
        F.octet_length("text").cast("long").alias("size_bytes"), inventory.digest(F.col("text").cast("binary"), "md5").alias("checksum"), (F.col("k") != 5).alias("valid"),
    )
    catalog = d.select(
        F.concat(F.lit("src:"), F.col("doc_id").cast("string")).alias("source_id"), "path", name.alias("file_name"),
        F.when(F.col("doc_id") % 4 == 0, "manual").otherwise("atlite_cds").alias("acquisition_method"),
        F.when(F.col("k") != 2, "md5").alias("checksum_algorithm"),
        F.when(F.col("k") == 1, "bad").when(F.col("k").isin(0, 3, 5), F.upper(F.md5(F.col("text").cast("binary")))).when(F.col("k") == 4, "x").otherwise("").alias("expected_checksum"),
        F.lit(False).alias("credentials"),
    )
    return inventory.status_report(catalog, stored).select("source_id", "status", "size_bytes", "checksum")


@query(
    "vector_layers",
    """SELECT c_custkey AS uid, 'c' AS zone_class, c_name AS name FROM customer WHERE c_nationkey IN (1, 5, 7) UNION ALL SELECT s_suppkey, 's', s_name FROM supplier WHERE s_nationkey IN (1, 5, 7)""",
)
def vector_layers(t):
    def layer(path):
        if path == "customer":
            return t.customer.select(F.col("c_custkey").alias("uid"), F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("geometry"))
        return t.supplier.select(F.col("s_suppkey").alias("uid"), F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("geometry"))

    d = files.read_layers(t.spark, {"customer": ("parquet", "c"), "supplier": ("parquet", "s")}, uid_field="uid", filters={"nation": [1, 5, 7]}, keep=["name"], read=layer)
    return d.select("uid", "zone_class", "name")


def _register(t):
    kind = F.create_map(*[F.lit(x) for x in ("ECONOMY", "economy", "SMALL", "small", "LARGE", "large")])
    return t.part.select(
        F.coalesce(kind[F.col("p_type")], F.lower("p_type")).alias("Type"), F.when(F.col("p_size") % 3 == 0, "China Mainland").when(F.col("p_size") % 3 == 1, "CHINA").otherwise("Elsewhere").alias("Country/area"),
        F.col("p_name").alias("Plant / Project name"), F.when(F.col("p_partkey") % 13 != 0, F.col("p_size").cast("string")).otherwise("n/a").alias("Capacity (MW)"),
        F.when(F.col("p_partkey") % 4 == 0, "In Construction").otherwise("operating").alias("Status"), F.col("p_name").alias("Technology"),
        (F.col("p_partkey") % 200 - 100).cast("string").alias("Latitude"), (F.col("p_partkey") % 360 - 180).cast("string").alias("Longitude"),
        F.concat(F.lit("L"), (F.col("p_partkey") % 50).cast("string")).alias("GEM location ID"), F.concat(F.lit("G"), F.col("p_partkey").cast("string")).alias("GEM unit/phase ID"),
        F.col("p_brand").alias("Fuel (combustion only)"), F.when(F.col("p_size") % 2 == 0, "yes").alias("CHP"), F.when(F.col("p_size") % 5 == 0, "no").alias("CCS"),
        (F.col("p_partkey") % 30 + 1990).cast("string").alias("Start year"),
    )


REGISTER_SQL = """reg AS (SELECT p_partkey AS k, p_size, CASE WHEN regexp_matches(p_type, '^economy$', 'i') AND regexp_matches(p_name, 'ring$', 'i') THEN 'ring_small' WHEN regexp_matches(p_name, 'bolt|NUT', 'i') THEN 'any_bolt'
   WHEN regexp_matches(p_type, '^(?:small|large)$', 'i') AND regexp_matches(p_brand, 'brand#2', 'i') THEN 'brand_two' ELSE 'rest' END AS rule, lower(p_brand) AS fuel FROM part WHERE p_size % 3 <> 2)"""


@query(
    "generators_standard",
    f"""WITH {REGISTER_SQL} SELECT concat('gem:G', CAST(k AS VARCHAR(20))) AS uid, CASE rule WHEN 'ring_small' THEN 'coal' WHEN 'brand_two' THEN 'gas' ELSE 'other' END AS class, CASE WHEN k % 4 = 0 THEN 'in_construction' ELSE 'operating' END AS status,
        CASE WHEN k % 13 <> 0 THEN CAST(p_size AS DOUBLE) END AS capacity_mw, fuel, CASE WHEN p_size % 2 = 0 THEN true END AS chp, CASE WHEN p_size % 5 = 0 THEN false END AS ccs, abs(k % 200 - 100) <= 90 AS placed, CAST(k % 30 + 1990 AS VARCHAR(10)) AS valid_from, rule AS mapping_rule_id
        FROM reg WHERE rule <> 'any_bolt'""",
)
def generators_standard(t):
    d = standardize.generators(_register(t), RULES, source_id="reg", countries=["china"], statuses=["operating", "In construction"], observed_at="2026-03")
    return d.select("uid", "class", "status", "capacity_mw", "fuel", "chp", "ccs", F.col("geometry").isNotNull().alias("placed"), "valid_from", "mapping_rule_id")


def _projects(t):
    parts = t.lineitem.groupBy(F.col("l_suppkey").alias("k")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("flags"))
    device = F.transform("flags", lambda f: F.struct(F.struct(F.concat(F.lit("Tech "), f).alias("Technology Mid-Type")).alias("Storage Device")))
    return t.supplier.join(parts, F.col("s_suppkey") == F.col("k")).select(
        F.col("s_suppkey").cast("string").alias("ID"), F.col("s_name").alias("Project/Plant Name"), F.lit("China").alias("Country"), F.lit("P").alias("State/Province"),
        F.lit("C").alias("City"), F.lit("Operational").alias("Status"), F.lit("30").alias("Latitude"), F.when(F.col("s_suppkey") % 6 != 0, "100").alias("Longitude"),
        (F.col("s_suppkey") * 100).cast("string").alias("Rated Power (kW)"), F.when(F.col("s_suppkey") % 5 != 0, (F.col("s_suppkey") * 250).cast("string")).alias("Storage Capacity (kWh)"),
        F.when(F.col("s_suppkey") % 9 != 0, device).alias("Subsystems"),
    )


PROJECT_SQL = """pj AS (SELECT s.s_suppkey AS k, CASE WHEN s.s_suppkey % 9 <> 0 THEN (SELECT string_agg(DISTINCT concat('Tech ', l_returnflag), '; ' ORDER BY concat('Tech ', l_returnflag)) FROM lineitem l WHERE l.l_suppkey = s.s_suppkey) END AS tech FROM supplier s)"""


@query("storage_projects", f"WITH {PROJECT_SQL} SELECT CAST(k AS VARCHAR(20)) AS id, coalesce(tech, '') AS technology FROM pj")
def storage_projects(t):
    return files.project_rows(_projects(t)).select("id", "technology")


STORAGE_RULES = [
    {"rule_id": "r_a", "priority": 1, "source_type_pattern": "", "technology_pattern": "^tech a", "fuel_pattern": "", "dataset": "storage", "class": "battery_storage", "subclass": "a"},
    {"rule_id": "r_n", "priority": 2, "source_type_pattern": "", "technology_pattern": "tech n", "fuel_pattern": "", "dataset": "storage", "class": "pumped_storage", "subclass": ""},
]
REGISTER_STORAGE = [{"rule_id": "bolt", "priority": 1, "source_type_pattern": "", "technology_pattern": "bolt", "fuel_pattern": "", "dataset": "storage", "class": "pumped_storage", "subclass": ""}]


@query(
    "storage_standard",
    f"""WITH {PROJECT_SQL} SELECT concat('doe:', CAST(k AS VARCHAR(20))) AS uid, CASE WHEN tech LIKE 'Tech A%' THEN 'battery_storage' ELSE 'other_storage' END AS class, k / 10.0E0 AS power_capacity_mw, CASE WHEN k % 5 <> 0 THEN k / 4.0E0 END AS energy_capacity_mwh,
        CASE WHEN k % 5 <> 0 AND k > 0 THEN 2.5E0 END AS duration_h, k % 6 <> 0 AS placed FROM pj WHERE NOT (tech IS NOT NULL AND tech NOT LIKE 'Tech A%' AND tech LIKE '%Tech N%')
        UNION ALL SELECT concat('gem:G', CAST(p_partkey AS VARCHAR(20))), 'pumped_storage', CASE WHEN p_partkey % 13 <> 0 THEN CAST(p_size AS DOUBLE) END, NULL, NULL, abs(p_partkey % 200 - 100) <= 90 FROM part WHERE p_size % 3 <> 2 AND p_name LIKE '%bolt%'""",
)
def storage_standard(t):
    reg = standardize.register_storage(_register(t), REGISTER_STORAGE, source_id="reg", countries=["China"])
    doe = standardize.project_storage(files.project_rows(_projects(t)), STORAGE_RULES, source_id="doe", countries=["china mainland"])
    d = standardize.storage(reg, doe)
    return rounded(d.select("uid", "class", "power_capacity_mw", "energy_capacity_mwh", "duration_h", F.col("geometry").isNotNull().alias("placed")))


@query(
    "wide_load",
    """SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS time, concat('figshare:', CASE event_type WHEN 'view' THEN 'Anhui' WHEN 'click' THEN 'Beijing' WHEN 'error' THEN 'Hubei' WHEN 'signup' THEN 'Tibet' ELSE 'Yunnan' END) AS uid, round(sum(value) * 1000, 4) AS demand_mw,
              CASE event_type WHEN 'view' THEN '安徽省' WHEN 'click' THEN '北京市' WHEN 'error' THEN '湖北省' WHEN 'signup' THEN '西藏自治区' ELSE '云南省' END AS location FROM events GROUP BY 1, 2, 4""",
)
def wide_load(t):
    names = {"view": "Anhui (GWh)", "click": "Beijing (GWh)", "error": "Hubei", "signup": "Tibet (x)", "purchase": "Yunnan"}
    wide = t.events.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("time")).pivot("event_type", list(names)).sum("value").withColumnsRenamed(names)
    yearly = files.read_yearly({2024: wide}, [2024])
    return rounded(standardize.wide_load(yearly).select("time", "uid", "demand_mw", "location"), 4)


@query(
    "grid_dimension",
    """SELECT DISTINCT concat('w:', printf('%.6f', y), ':', printf('%.6f', x)) AS uid, concat(printf('%.6f', y), ',', printf('%.6f', x)) AS location, concat('POINT (', printf('%.6f', x), ' ', printf('%.6f', y), ')') AS geometry
       FROM (SELECT floor(x0 * 4) / 4 AS x, floor(y0 * 4) / 4 AS y FROM v_block)""",
)
def grid_dimension(t):
    snap = lambda c: (F.floor(F.col(c) * 4) / 4).cast("double")
    return standardize.grid_dimension(t.v_block.select(snap("x0").alias("x"), snap("y0").alias("y")), "w").select("uid", "location", "geometry")


@query(
    "parameter_long_rows",
    """SELECT concat('costs:', CAST(p_partkey AS VARCHAR(20)), ':v2') AS uid, p_name AS name, p_retailprice AS value, 'EUR' AS unit, 'generator' AS applies_to_dataset, CASE p_type WHEN 'SMALL' THEN 'solar' ELSE 'other' END AS class,
              CASE p_type WHEN 'SMALL' THEN 's' ELSE 'o' END AS mapping_rule_id, 'generic' AS quality, 'lab' AS source_provider, '7' AS source_version FROM part WHERE p_partkey % 5 <> 0""",
)
def parameter_long_rows(t):
    raw = t.part.select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("parameter_name"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice").cast("string")).otherwise("n/a").alias("value"),
        F.lit("EUR").alias("unit"), F.col("p_type").alias("technology"),
    )
    rule = lambda i, p, c: {"rule_id": i, "source_type_pattern": "", "technology_pattern": p, "fuel_pattern": "", "dataset": "generator", "class": c, "subclass": ""}
    spec = {"source_id": "costs", "source_uid_columns": ["id"], "source_uid_suffix": "v2", "quality": "generic"}
    d = standardize.long_parameters(raw, spec, [[rule("s", "^small$", "solar"), rule("o", "", "other")]], {"provider": "lab", "version": "7"})
    return d.select("uid", "name", "value", "unit", "applies_to_dataset", "class", "mapping_rule_id", "quality", "source_provider", "source_version")


@query(
    "parameter_wide_rows",
    """SELECT concat('types:', CAST(c_custkey AS VARCHAR(20)), ':', v.name) AS uid, v.name, CASE v.name WHEN 'r_ohm' THEN c_acctbal ELSE c_nationkey * 1.0E0 END AS value, CASE v.name WHEN 'r_ohm' THEN 'ohm/km' ELSE 'kA' END AS unit, 'network' AS applies_to_dataset, c_nationkey * 10.0E0 AS kv
       FROM customer, (SELECT unnest(['r_ohm', 'max_i']) AS name) v WHERE v.name = 'r_ohm' OR c_nationkey > 3""",
)
def parameter_wide_rows(t):
    raw = t.customer.select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_acctbal").cast("string").alias("r_ohm"), F.when(F.col("c_nationkey") > 3, F.col("c_nationkey").cast("string")).alias("max_i"),
        (F.col("c_nationkey") * 10).alias("vn"), F.lit("network").alias("applies_to_dataset"), F.lit("line").alias("class"),
    )
    spec = {"source_id": "types", "source_uid_columns": ["id"], "parameters": {"r_ohm": "ohm/km", "max_i": "kA"}, "voltage_column": "vn"}
    d = standardize.wide_parameters(raw, spec)
    return d.select("uid", "name", "value", "unit", "applies_to_dataset", F.col("voltage_kv")[0].alias("kv"))


@query(
    "spatial_units",
    """SELECT concat('s:', uid) AS uid, CASE WHEN CAST(substr(uid, 5) AS BIGINT) % 2 = 0 THEN 'province' ELSE 'city' END AS level, 'source_geometry_repaired' AS geometry_method, uid AS source_uid, concat('{"a":', CAST(CAST(substr(uid, 5) AS BIGINT) % 3 AS VARCHAR(5)), '}') AS extra FROM v_block""",
)
def spatial_units(t):
    from ..functions import geometry as G

    k = F.substring("uid", 5, 20).cast("long")
    d = t.v_block.select(
        F.col("uid").alias("code"), F.when(k % 2 == 0, " province").otherwise("city ").alias("kind"), G.clean_ring(G.box_ring("x0", "y0", "x1", "y1")).alias("geometry"), F.struct((k % 3).alias("a")).alias("extra")
    )
    return standardize.spatial_units(d, source_id="s", uid_field="code", level_field="kind").select("uid", "level", "geometry_method", "source_uid", "extra")


@query("uid_checks", "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS missing_uid, CAST((SELECT sum(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) WHERE n > 1) AS BIGINT) AS repeated_uid FROM lineitem")
def uid_checks(t):
    return contracts.uid_issues(t.lineitem.select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("uid")))


@query("schema_report", "SELECT name, dtype, (SELECT count(*) FROM v_block) AS size, required FROM (VALUES ('uid', 'string', true), ('class', 'string', true), ('population', 'double', true)) v(name, dtype, required)")
def schema_report(t):
    d = t.v_block.select("uid", F.lit("cell_population").alias("class"), "population")
    return contracts.schema_report(d, "population").select("name", "dtype", "size", "required")


@query("duplicate_uids", "SELECT concat(CAST(l_orderkey AS VARCHAR(20)), ':', CAST(l_linenumber AS VARCHAR(5))) AS uid, count(*) AS rows FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_uids(t):
    return skew.duplicates(t.lineitem.select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("uid")), "uid")


@query("background_parts", "SELECT admin_uid AS uid, spatial_level AS level, count(*) AS parts FROM v_cell GROUP BY 1, 2")
def background_parts(t):
    return cells.background(t.v_cell).groupBy("uid", "level").agg(F.count("*").alias("parts"))
