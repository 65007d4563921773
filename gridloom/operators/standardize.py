"""Source records to canonical tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import contracts, rules
from .skew import duplicates, require_none

# --- fixed values: register columns -------------------------------------------------------------
REGISTER_COLUMNS = (
    "Type", "Country/area", "Plant / Project name", "Capacity (MW)", "Status", "Technology",
    "Latitude", "Longitude", "GEM location ID", "GEM unit/phase ID", "Fuel (combustion only)",
)
REGIONS = {
    "Anhui": "安徽省", "Beijing": "北京市", "Chongqing": "重庆市", "Fujian": "福建省", "Gansu": "甘肃省",
    "Guangdong": "广东省", "Guangxi": "广西壮族自治区", "Guizhou": "贵州省", "Hainan": "海南省",
    "Hebei": "河北省", "Heilongjiang": "黑龙江省", "Henan": "河南省", "Hubei": "湖北省", "Hunan": "湖南省",
    "Inner Mongolia": "内蒙古自治区", "Jiangsu": "江苏省", "Jiangxi": "江西省", "Jilin": "吉林省",
    "Liaoning": "辽宁省", "Ningxia": "宁夏回族自治区", "Qinghai": "青海省", "Shaanxi": "陕西省",
    "Shandong": "山东省", "Shanghai": "上海市", "Shanxi": "山西省", "Sichuan": "四川省", "Tianjin": "天津市",
    "Tibet": "西藏自治区", "Xinjiang": "新疆维吾尔自治区", "Yunnan": "云南省", "Zhejiang": "浙江省",
}
# ------------------------------------------------------------------------------------------------


def require_columns(df: DataFrame, columns: Iterable[str], label: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{label} is missing columns: {missing}")


def _have(df: DataFrame, c: str, kind: str = "string") -> Column:
    return F.col(f"`{c}`").cast(kind) if c in df.columns else F.lit(None).cast(kind)


def _register(df: DataFrame, dataset: str, rule_rows: Sequence[Mapping], countries, statuses) -> DataFrame:
    require_columns(df, REGISTER_COLUMNS, "Asset register")
    scoped = df.where(S.in_scope(F.col("`Country/area`"), F.col("Status"), countries, statuses))
    inputs = {
        "source_type_pattern": F.col("Type"), "technology_pattern": F.col("Technology"),
        "fuel_pattern": F.col("`Fuel (combustion only)`"),
    }
    return scoped.withColumn("__m", rules.first_match(rule_rows, inputs)).where(F.col("__m.dataset") == dataset)


def _common(df: DataFrame, source_id: str, observed_at: str | None) -> list[Column]:
    lon, lat = S.number(F.col("Longitude")), S.number(F.col("Latitude"))
    return [
        F.lit(observed_at).cast("string").alias("observed_at"),
        S.partial_time(_have(df, "Start year")).alias("valid_from"), S.partial_time(_have(df, "Retired year")).alias("valid_to"),
        F.lit(source_id).alias("source_id"), F.col("`GEM unit/phase ID`").cast("string").alias("source_uid"),
        F.col("__m.rule_id").alias("mapping_rule_id"), F.col("`Plant / Project name`").alias("name"),
        _have(df, "Subnational unit (state, province)").alias("source_province"), _have(df, "City").alias("source_city"),
        lon.alias("longitude"), lat.alias("latitude"), F.col("Technology").alias("technology"),
    ]


def generators(
    df: DataFrame, rule_rows: Sequence[Mapping], *, source_id: str, countries: Iterable[str], statuses: Iterable[str] = (),
    observed_at: str | None = None,
) -> DataFrame:
    """Asset register to the generator table."""
    from ..functions.geometry import valid_lonlat

    d = _register(df, "generator", rule_rows, countries, statuses)
    lon, lat = S.number(F.col("Longitude")), S.number(F.col("Latitude"))
    out = d.select(
        F.concat(F.lit("gem:"), F.col("`GEM unit/phase ID`").cast("string")).alias("uid"),
        F.col("__m.class").alias("class"), F.col("__m.subclass").alias("subclass"), S.slug("Status").alias("status"),
        S.number(F.col("`Capacity (MW)`")).alias("capacity_mw"), S.fuel_labels(F.col("`Fuel (combustion only)`")).alias("fuel"),
        S.tri_state(_have(df, "CHP")).alias("chp"),
        (S.tri_state(_have(df, "CCS")) | F.lower(F.coalesce("Technology", F.lit(""))).contains("ccs")).alias("ccs"),
        F.lit(None).cast("array<double>").alias("voltage_kv"), valid_lonlat(lon, lat).alias("geometry"),
        F.when(lon.isNotNull() & lat.isNotNull(), "source_coordinates").alias("geometry_method"),
        *_common(df, source_id, observed_at),
        F.concat(F.lit("gem:"), F.col("`GEM location ID`").cast("string")).alias("project_uid"),
        _have(df, "Unit / Phase name").alias("unit_name"), F.col("`Fuel (combustion only)`").alias("fuel_raw"),
        _have(df, "Owner(s)").alias("owner"), _have(df, "Operator(s)").alias("operator"), _have(df, "Location accuracy").alias("location_accuracy"),
    )
    return contracts.finalize(out, "generator")


def register_storage(
    df: DataFrame, rule_rows: Sequence[Mapping], *, source_id: str, countries: Iterable[str], statuses: Iterable[str] = (),
    observed_at: str | None = None,
) -> DataFrame:
    """Storage rows of the asset register; it reports no energy."""
    from ..functions.geometry import valid_lonlat

    d = _register(df, "storage", rule_rows, countries, statuses)
    lon, lat = S.number(F.col("Longitude")), S.number(F.col("Latitude"))
    place = valid_lonlat(lon, lat)
    return d.select(
        F.concat(F.lit("gem:"), F.col("`GEM unit/phase ID`").cast("string")).alias("uid"),
        F.col("__m.class").alias("class"), F.col("__m.subclass").alias("subclass"), S.slug("Status").alias("status"),
        S.number(F.col("`Capacity (MW)`")).alias("power_capacity_mw"), F.lit(None).cast("double").alias("energy_capacity_mwh"),
        F.lit(None).cast("double").alias("duration_h"), F.lit(None).cast("array<double>").alias("voltage_kv"),
        place.alias("geometry"), F.when(place.isNotNull(), "source_coordinates").alias("geometry_method"),
        *_common(df, source_id, observed_at),
    )


def project_storage(
    df: DataFrame, rule_rows: Sequence[Mapping], *, source_id: str, countries: Iterable[str], statuses: Iterable[str] = (),
    observed_at: str | None = None,
) -> DataFrame:
    """Storage projects (columns of `sources.files.read_projects`) in MW, MWh and hours.

    Pumped storage drops out because the register already holds it.
    """
    scoped = df.where(S.in_scope("country", "status", countries, statuses))
    d = rules.classify_technology(scoped.withColumn("__raw", F.coalesce("technology", F.lit(""))), rule_rows, "__raw")
    lon, lat = S.number("longitude"), S.number("latitude")
    power, energy = S.number("rated_power_kw") / 1000, S.number("storage_capacity_kwh") / 1000
    place = F.when(lon.isNotNull() & lat.isNotNull(), F.struct(lon.alias("x"), lat.alias("y")))
    none = F.lit(None).cast("string")
    return d.where("class <> 'pumped_storage'").select(
        F.concat(F.lit("doe:"), F.col("id").cast("string")).alias("uid"), "class", "subclass", S.slug("status").alias("status"),
        power.alias("power_capacity_mw"), energy.alias("energy_capacity_mwh"), F.when(power > 0, energy / power).alias("duration_h"),
        F.lit(None).cast("array<double>").alias("voltage_kv"), place.alias("geometry"),
        F.when(place.isNotNull(), "source_coordinates").alias("geometry_method"), F.lit(observed_at).cast("string").alias("observed_at"),
        none.alias("valid_from"), none.alias("valid_to"), F.lit(source_id).alias("source_id"), F.col("id").cast("string").alias("source_uid"),
        "mapping_rule_id", "name", F.col("province").alias("source_province"), F.col("city").alias("source_city"),
        lon.alias("longitude"), lat.alias("latitude"), F.when(F.col("__raw") != "", F.col("__raw")).alias("technology"),
    )


def storage(register: DataFrame, projects: DataFrame) -> DataFrame:
    return contracts.finalize(register.unionByName(projects, allowMissingColumns=True), "storage")


def spatial_units(
    df: DataFrame, *, source_id: str, uid_field: str, level: str | None = None, level_field: str | None = None,
    dissolved: bool = False, observed_at: str | None = None, version: str | None = None,
) -> DataFrame:
    """Feature rows (attributes plus geometry) to spatial units; nested attributes become JSON text."""
    if not level and not level_field:
        raise ValueError("A spatial source needs a level or a level field.")
    require_columns(df, [uid_field] + ([level_field] if level_field else []), "Spatial source")
    reserved = {"uid", "level", "geometry", "geometry_method", "observed_at", "valid_from", "valid_to", "source_id", "source_uid", uid_field}
    lv = F.trim(F.col(level_field).cast("string")) if level_field else F.lit(level)
    base = df.where("geometry IS NOT NULL")
    require_none(base.where(F.coalesce(lv, F.lit("")) == "").select(uid_field), "Spatial units without a level")
    text = lambda f: (F.to_json(F.col(f"`{f.name}`")) if f.dataType.typeName() in ("struct", "array", "map") else F.col(f"`{f.name}`").cast("string")).alias(f.name)
    none = F.lit(None).cast("string")
    out = base.select(
        F.concat(F.lit(source_id + ":"), F.col(uid_field).cast("string")).alias("uid"), lv.alias("level"), "geometry",
        F.lit("source_geometry_dissolved" if dissolved else "source_geometry_repaired").alias("geometry_method"),
        F.lit(observed_at).cast("string").alias("observed_at"), none.alias("valid_from"), none.alias("valid_to"),
        F.lit(source_id).alias("source_id"), F.col(uid_field).cast("string").alias("source_uid"), F.lit(version).cast("string").alias("source_version"),
        *[text(f) for f in df.schema.fields if f.name not in reserved],
    )
    return contracts.finalize(out, "spatial")


def wide_load(df: DataFrame, regions: Mapping[str, str] = REGIONS, time: str = "time", factor: float = 1000.0) -> DataFrame:
    """Wide hourly load in GWh per hour (one column per region) to a long series in MW.

    Column names count up to ' ('; unknown regions, repeated timestamps and gaps are errors.
    """
    names = {c: c.split(" (", 1)[0].strip() for c in df.columns if c != time}
    unknown = sorted(set(names.values()) - set(regions))
    if unknown:
        raise ValueError(f"Unknown load regions: {unknown}")
    require_none(duplicates(df, time), "Load timestamps are not unique")
    numeric = df.select(time, *[S.number(F.col(f"`{c}`")).alias(n) for c, n in names.items()])
    long = numeric.unpivot([time], list(names.values()), "region", "v")
    require_none(long.where("v IS NULL"), "Load values are missing")
    return long.select(
        F.col(time).cast("timestamp_ntz").alias("time"), F.concat(F.lit("figshare:"), "region").alias("uid"),
        F.lit("electric_load").alias("class"), (F.col("v") * factor).alias("demand_mw"),
        S.lookup(dict(regions), "region").alias("location"),
    )


def grid_dimension(points: DataFrame, source_id: str) -> DataFrame:
    """Weather grid points (x, y) to the uid dimension of a series."""
    lat, lon = F.format_string("%.6f", "y"), F.format_string("%.6f", "x")
    return points.select("x", "y").distinct().select(
        F.concat_ws(":", F.lit(source_id), lat, lon).alias("uid"), F.concat_ws(",", lat, lon).alias("location"),
        F.concat(F.lit("POINT ("), lon, F.lit(" "), lat, F.lit(")")).alias("geometry"), F.lit("source_cell_centroid").alias("geometry_method"),
        "x", "y",
    )


def population_blocks(pixels: DataFrame, factor: int, source_id: str, rows: int | None = None, columns: int | None = None) -> DataFrame:
    """Pixels (row, col, value, valid) summed in factor x factor blocks.

    Negative values count as 0; a block lives if one of its pixels is valid, even with sum 0. `rows`
    and `columns` give the raster size, so that edge blocks report their true extent.
    """
    if factor < 1:
        raise ValueError("The aggregation factor must be at least 1.")
    r, c = F.floor(F.col("row") / factor) * factor, F.floor(F.col("col") / factor) * factor
    valid = F.col("valid") & F.col("value").isNotNull()
    out = pixels.groupBy(r.cast("long").alias("row_start"), c.cast("long").alias("col_start")).agg(
        F.sum(F.when(valid, F.greatest(F.col("value"), F.lit(0.0))).otherwise(0.0)).alias("population"),
        F.count_if(valid).alias("source_cell_count"),
    ).where("source_cell_count > 0")
    end = lambda start, size: F.least(start + factor, F.lit(size)) if size is not None else start + factor
    return out.select(
        F.concat_ws(":", F.lit(source_id), F.col("row_start").cast("string"), F.col("col_start").cast("string")).alias("uid"),
        F.lit("cell_population").alias("class"), "population", "source_cell_count", "row_start", "col_start",
        F.concat_ws(":", *[x.cast("string") for x in (F.col("row_start"), end(F.col("row_start"), rows), F.col("col_start"), end(F.col("col_start"), columns))]).alias("source_uid"),
    )


def spec_value(df: DataFrame, spec: Mapping[str, object], name: str) -> Column:
    """Constant of the spec, else its named column, else the default column, else null."""
    if name in spec:
        return F.lit(spec[name])
    return _have(df, str(spec.get(f"{name}_column", name)))


def spec_uid(df: DataFrame, spec: Mapping[str, object], suffix: Column | None = None) -> Column:
    """Source uid: the uid column when filled, else the id columns, plus suffixes."""
    column = str(spec.get("source_uid_column", "source_uid"))
    ids = [F.col(c).cast("string") for c in spec.get("source_uid_columns", ())]
    if column not in df.columns and not ids:
        raise ValueError("A parameter source needs source_uid_column or source_uid_columns.")
    base = _have(df, column)
    if ids:
        base = F.coalesce(base, F.concat_ws(":", *ids))
    parts = [base] + ([F.lit(str(spec["source_uid_suffix"]))] if spec.get("source_uid_suffix") is not None else [])
    if suffix is not None:
        parts.append(suffix)
    return F.concat_ws(":", *parts)


METADATA = ("quality", "notes", "reference_url", "source_provider", "location", "scope", "standard_type", "scenario")
SCOPE_FIELDS = ("applies_to_uid", "status", "observed_at", "valid_from", "valid_to")


def _parameter_rows(df: DataFrame, spec: Mapping[str, object], rule_sets, catalog: Mapping[str, str], suffix: Column | None) -> DataFrame:
    source_id = str(spec["source_id"])
    named = df.withColumns({f"__{k}": spec_value(df, spec, k) for k in ("source_type", "technology", "fuel")})
    for k in ("applies_to_dataset", "class", "subclass"):
        named = named.withColumn(k, spec_value(df, spec, k))
    done = rules.classify_parameters(named, rule_sets, "__source_type", "__technology", "__fuel").drop("__source_type", "__technology", "__fuel")
    uid = spec_uid(df, spec, suffix)
    out = done.withColumns({
        **{k: spec_value(df, spec, k) for k in (*SCOPE_FIELDS, *METADATA)},
        "source_id": F.lit(source_id), "source_uid": uid, "uid": F.concat(F.lit(source_id + ":"), uid),
        "source_version": F.lit(catalog.get("version")).cast("string"),
    })
    return out.withColumn("source_provider", F.coalesce("source_provider", F.lit(catalog.get("provider")).cast("string")))


def long_parameters(df: DataFrame, spec: Mapping[str, object], rule_sets=(), catalog: Mapping[str, str] | None = None) -> DataFrame:
    """Adapter for one value per row; rows without a number drop out."""
    name, value, unit = (str(spec.get(f"{k}_column", d)) for k, d in (("name", "parameter_name"), ("value", "value"), ("unit", "unit")))
    require_columns(df, [name, value, unit], str(spec["source_id"]))
    base = df.withColumn("__value", S.number(value)).where("__value IS NOT NULL")
    base = base.withColumns({"source_name": F.col(name), "__name": F.col(name), "__unit": F.col(unit)})
    out = _parameter_rows(base, spec, rule_sets, catalog or {}, None)
    out = out.drop(name, "parameter_group")
    return out.withColumns({"name": F.col("__name"), "value": F.col("__value"), "unit": F.col("__unit")}).drop("__name", "__value", "__unit")


def wide_parameters(df: DataFrame, spec: Mapping[str, object], rule_sets=(), catalog: Mapping[str, str] | None = None) -> DataFrame:
    """Adapter for one column per parameter: melted with the units of the spec."""
    units = {str(k): str(v) for k, v in dict(spec.get("parameters", {})).items()}
    if not units:
        raise ValueError(f"{spec['source_id']} needs parameters.")
    require_columns(df, [*spec.get("source_uid_columns", ()), *units], str(spec["source_id"]))
    numeric = df.withColumns({c: S.number(c) for c in units})
    ids = [c for c in df.columns if c not in units]
    long = numeric.unpivot(ids, list(units), "name", "value").where("value IS NOT NULL")
    out = _parameter_rows(long, spec, rule_sets, catalog or {}, F.col("name"))
    out = out.withColumns({"source_name": F.col("name"), "unit": S.lookup(units, "name")})
    if spec.get("voltage_column"):
        v = S.number(str(spec["voltage_column"]))
        out = out.withColumn("voltage_kv", F.when(v.isNotNull(), F.array(v)))
    return out


PARAMETER_ADAPTERS = {"long_table": long_parameters, "wide_table": wide_parameters}


def register_adapter(name: str, adapter) -> None:
    """Add a parameter adapter: (df, spec, rule_sets, catalog) to adapter rows."""
    PARAMETER_ADAPTERS[name] = adapter


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out

