"""File scans: CSV tables, feature JSON, register and project files, wide loads, series, line text."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.geometry import RING
from ..operators.skew import duplicates, require_none
from ..session import cut_lineage

LAYER = "zone_class"

# Tags read from power features.
FEATURE_TAGS = (
    "@type", "@id", "power", "voltage", "frequency", "name", "operator", "circuits", "cables",
    "substation", "location", "start_date", "opening_date", "closing_date",
    "construction:power", "proposed:power", "planned:power", "disused:power", "abandoned:power",
    "demolished:power", "removed:power", "razed:power", "destroyed:power",
)


def read_csv(spark: SparkSession, path: str, schema: str | None = None, keep_blank: bool = False) -> DataFrame:
    """CSV with a header. Rule tables and catalogs keep blank text instead of null."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    return df.fillna("") if keep_blank else df


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet scan; a column list reaches the scan as its read schema."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_network(spark: SparkSession, root: str, parts: Iterable[str] = ("bus", "branch", "transformer", "converter")) -> dict[str, DataFrame]:
    return {p: spark.read.parquet(f"{root}/{p}") for p in parts}


def read_series(
    spark: SparkSession, path: str, dimension: DataFrame | None = None, classes: Iterable[str] | None = None
) -> DataFrame:
    """Long series, optionally some classes (partition pruning) and joined to its uid dimension."""
    df = spark.read.parquet(path)
    if classes is not None:
        df = df.where(F.col("class").isin(list(classes)))
    if dimension is None:
        return df
    require_none(df.select("uid").distinct().join(dimension.select("uid"), "uid", "left_anti"), "Series uids without a dimension row")
    return df.join(dimension, "uid")


GEOMETRY = "struct<type:string,coordinates:variant>"


#: A whole JSON string, as a regular expression.
STRING = r'"(?:[^"\\]+|\\.)*"'


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """Objects that lie directly in the outermost object of JSON files, or in its arrays: (file, json).

    Large files become many tasks. The text source cuts them at every closing brace, at any byte range. How deep
    a fragment begins, and whether it begins inside a string, is a prefix sum: over the fragments of a range, and
    over the ranges of a file. Fragments of one object then meet by its number, and only an object is put together.
    """
    rows = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value"
    )
    # The order of rows is fixed by file and range; escaped characters can't end a string.
    bare = F.split(F.regexp_replace("value", r"\\.", ""), '"')
    opened = lambda odd: F.aggregate(F.transform(bare, lambda t, i: F.when(i % 2 == odd, F.length(t) - F.length(F.replace(t, F.lit("{")))).otherwise(0)), F.lit(0), lambda x, v: x + v)
    rows = cut_lineage(rows.withColumns({"quotes": (F.size(bare) - 1) % 2, "outside": opened(0), "inside": opened(1)}))
    key = ["file", "block"]
    order = Window.partitionBy(*key).orderBy("row")

    def with_prefix(df: DataFrame, value: str, name: str) -> DataFrame:
        """Sum of a value over all earlier fragments of the file."""
        blocks = df.groupBy(*key).agg(F.sum(value).alias("__sum"))
        before = F.coalesce(F.sum("__sum").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = blocks.select(*key, before.alias("__start"))
        own = F.coalesce(F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return df.withColumn("__own", own).join(starts, key).withColumn(name, F.col("__start") + F.col("__own")).drop("__own", "__start")

    quoted = with_prefix(rows, "quotes", "__q").withColumn("in_string", F.col("__q") % 2 == 1)
    ends_open = (F.col("__q") + F.col("quotes")) % 2 == 1
    change = F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside")) - F.when(ends_open, 0).otherwise(1)
    deep = with_prefix(quoted.withColumn("change", change), "change", "depth")
    deep = deep.withColumn("closes", ((F.col("depth") + F.col("change") == 1) & ~ends_open).cast("int"))
    numbered = with_prefix(deep, "closes", "number")
    # What stands before an object: the outermost brace, keys, brackets and commas.
    head = F.when(F.col("depth") == 0, F.regexp_replace("value", r'^[^{]*\{(?:[^"{]+|' + STRING + ")*", "")).when(
        (F.col("depth") == 1) & ~F.col("in_string"), F.regexp_replace("value", r'^(?:[^"{]+|' + STRING + ")*", "")
    ).otherwise(F.col("value"))
    parts = numbered.select("file", "number", "block", "row", head.alias("text"), "closes")
    whole = parts.groupBy("file", "number").agg(F.max("closes").alias("closes"), F.array_sort(F.collect_list(F.struct("block", "row", "text"))).alias("parts"))
    return whole.where("closes = 1").select("file", F.concat(F.array_join(F.transform("parts", lambda x: x["text"]), "}"), F.lit("}")).alias("json"))


def read_features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """GeoJSON feature collections: one row per feature with its properties and a geometry variant.

    properties: DDL of the wanted attributes; missing properties give nulls. One large file is read by many tasks.
    """
    schema = f"type string, properties struct<{properties}>, geometry {GEOMETRY}"
    d = json_objects(spark, path).select(F.from_json("json", schema).alias("f")).where("f.type = 'Feature'")
    names = [f.name for f in T.StructType.fromDDL(properties.replace(":", " ")).fields] if ":" in properties else T.StructType.fromDDL(properties).fieldNames()
    return d.select(*[F.col("f.properties")[n].alias(n) for n in names], F.col("f.geometry").alias("geometry"))


def feature_rings(features: DataFrame, key: str) -> DataFrame:
    """Polygon and multi-polygon features to ring rows (key, part, ring, sign); inner rings count -1."""
    coords, kind = F.col("geometry.coordinates"), F.col("geometry.type")
    nest = "array<array<array<double>>>"
    polygons = F.when(kind == "MultiPolygon", F.try_variant_get(coords, "$", f"array<{nest}>")).when(
        kind == "Polygon", F.array(F.try_variant_get(coords, "$", nest))
    )
    d = features.select(key, F.posexplode(polygons).alias("part", "poly")).select(key, "part", F.posexplode("poly").alias("i", "r"))
    ring = F.transform("r", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).cast(RING)
    return d.select(key, "part", ring.alias("ring"), F.when(F.col("i") == 0, 1).otherwise(-1).alias("sign"))


def read_layers(
    spark: SparkSession, layers: Mapping[str, tuple[str, str]], *, uid_field: str, filters: Mapping[str, object] | None = None,
    keep: Iterable[str] = (), read=None,
) -> DataFrame:
    """Several layers {path: (format, zone)} as one table with their zone, filtered and pruned."""
    if not layers:
        raise ValueError("A layered source needs its layers.")
    out = None
    for path, (fmt, zone) in layers.items():
        one = (read(path) if read else spark.read.format(fmt).load(path)).withColumn(LAYER, F.lit(zone))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    for column, accepted in (filters or {}).items():
        if column not in out.columns:
            raise KeyError(f"No filter field {column!r}.")
        out = out.where(F.col(column).isin(list(accepted) if isinstance(accepted, (list, tuple)) else [accepted]))
    if uid_field not in out.columns:
        raise KeyError(f"No uid field {uid_field!r}.")
    wanted = [c for c in [*keep, LAYER, "geometry"] if c in out.columns]
    return out.select(*dict.fromkeys([uid_field, *wanted]))


PROJECT_SCHEMA = (
    "ID string, `Project/Plant Name` string, Country string, `State/Province` string, City string, Status string, "
    "Latitude string, Longitude string, `Rated Power (kW)` string, `Storage Capacity (kWh)` string, "
    "Subsystems array<struct<`Storage Device`:struct<`Technology Mid-Type`:string>>>"
)


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """Nested storage project JSON; distinct technologies are sorted into one text."""
    d = spark.read.schema(PROJECT_SCHEMA).option("multiLine", True).json(path)
    return project_rows(d)


def project_rows(d: DataFrame) -> DataFrame:
    devices = F.transform(
        F.coalesce("Subsystems", F.array().cast(d.schema["Subsystems"].dataType)),
        lambda s: s["Storage Device"]["Technology Mid-Type"],
    )
    found = F.array_sort(F.array_distinct(F.filter(devices, lambda t: t.isNotNull() & (t != ""))))
    return d.select(
        F.col("ID").alias("id"), F.col("`Project/Plant Name`").alias("name"), F.col("Country").alias("country"),
        F.col("`State/Province`").alias("province"), F.col("City").alias("city"), F.col("Status").alias("status"),
        F.col("Latitude").alias("latitude"), F.col("Longitude").alias("longitude"),
        F.col("`Rated Power (kW)`").alias("rated_power_kw"), F.col("`Storage Capacity (kWh)`").alias("storage_capacity_kwh"),
        F.array_join(found, "; ").alias("technology"),
    )


def read_yearly(frames: Mapping[int, DataFrame], years: Iterable[int], time: str = "time") -> DataFrame:
    """Yearly wide tables as one; a missing year or a repeated timestamp is an error."""
    missing = [y for y in years if y not in frames]
    if missing:
        raise ValueError(f"Missing years: {missing}")
    out = None
    for y in years:
        out = frames[y] if out is None else out.unionByName(frames[y])
    require_none(duplicates(out, time), "Timestamps are not unique")
    return out


def prepare_features(df: DataFrame) -> DataFrame:
    """Power features with the tags that exist, a source uid and the feature kind."""
    tags = [c for c in FEATURE_TAGS if c in df.columns]
    other = [c for c in ("x", "y", "ring", "line") if c in df.columns]
    out = df.select(*[F.col(f"`{c}`") for c in tags], *other)
    for c in FEATURE_TAGS:
        if c not in tags and ":" not in c:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out.withColumn("source_uid", F.concat_ws(":", F.lit("osm"), F.col("`@type`").cast("string"), F.col("`@id`").cast("string"))).withColumn(
        "feature_kind", F.col("`@type`")
    )


def parse_opl(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Object-per-line text (column value) to node coordinates and ordered way references.

    nodes: node, lon, lat (nodes lacking one are skipped); refs: uid, pos, node.
    """
    fields = F.split(F.rtrim(F.col("value")), " ")
    rest = F.slice(fields, 2, F.greatest(F.size(fields) - 1, F.lit(0)))
    d = lines.select(F.get(fields, F.lit(0)).alias("token"), rest.alias("rest"))

    def attribute(letter: str) -> Column:
        hit = F.filter("rest", lambda f: f.startswith(letter) & (F.length(f) > 1))
        return F.try_url_decode(F.substring(F.element_at(F.when(F.size(hit) > 0, hit), -1), 2, 1_000_000_000))

    number = F.substr(F.col("token"), F.lit(2)).cast("long")
    nodes = (
        d.where(F.col("token").startswith("n"))
        .select(number.alias("node"), attribute("x").try_cast("double").alias("lon"), attribute("y").try_cast("double").alias("lat"))
        .where("lon IS NOT NULL AND lat IS NOT NULL")
    )
    refs = d.where(F.col("token").startswith("w")).select(
        F.concat(F.lit("osm:way:"), F.substr(F.col("token"), F.lit(2))).alias("uid"),
        F.posexplode(F.filter(F.split(attribute("N"), ","), lambda t: t != "")).alias("pos", "ref"),
    )
    return nodes, refs.select("uid", "pos", F.regexp_replace("ref", "^n+", "").cast("long").alias("node"))


def read_opl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_opl(spark.read.text(path))
