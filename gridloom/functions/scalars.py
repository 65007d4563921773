"""Scalar column functions. Everything here is a JVM expression; nothing calls Python per row."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

# --- fixed values -----------------------------------------------------------------------------
TRUE_WORDS = ("yes", "true", "1")
FALSE_WORDS = ("no", "false", "0")
ENVIRONMENTAL_NAMES = ("fuel", "commodity")
ENVIRONMENTAL_TOKENS = (
    "co2", "carbondioxide", "carbon_intensity", "emission",
    "capture_rate", "c_in_fuel", "c_stored",
)
ECONOMIC_NAMES = ("c_b", "c_v", "yield_biochar")
ECONOMIC_TOKENS = (
    "investment", "fom", "vom", "fuel_price", "cost", "discount",
    "price", "value_of_lost_load", "surcharge", "economic_lifetime",
)
TECHNICAL_TOKENS = (
    "committable", "minimum_output", "ramp_", "minimum_up_time",
    "minimum_down_time", "startup_time", "charging_efficiency",
    "discharging_efficiency", "standing_loss", "soc", "cyclic_",
    "efficiency", "lifetime", "capacity", "energy_to_power", "input",
    "output", "temperature", "fill_level", "motor_size", "p_nom_ratio",
    "r_ohm", "x_ohm", "c_nf", "max_i", "q_mm2", "alpha", "i0_",
    "pfe_", "sn_", "vn_", "vk_", "vkr_", "tap_", "shift_",
    "nominal_voltage", "s_nom",
)
FUEL_LABELS = (
    (r"\blng\b", "lng"),
    (r"natural gas", "natural_gas"),
    (r"blast furnace gas", "blast_furnace_gas"),
    (r"coke oven gas", "coke_oven_gas"),
    (r"coalbed methane|coal mine methane", "coal_methane"),
    (r"fuel oil|diesel|fossil liquids", "oil"),
    (r"hydrogen", "hydrogen_blend"),
)
DC_NAME_PATTERN = "(?i)直流|HVDC"
# ----------------------------------------------------------------------------------------------


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Bind an expression once inside a larger one (a one-element transform)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def any_of(c: Column, tokens: Iterable[str]) -> Column:
    out = F.lit(False)
    for token in tokens:
        out = out | c.contains(token)
    return out


def slug(c: ColumnLike) -> Column:
    """Lower-case, runs of other characters to one underscore; blank becomes null."""
    c = col(c).cast("string")
    body = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_")
    return F.when(F.trim(c) != "", F.regexp_replace(body, "^_+|_+$", ""))


def canonical_name(c: ColumnLike, aliases: Mapping[str, str] | None = None) -> Column:
    name = slug(c)
    if not aliases:
        return name
    pairs = [F.lit(x) for k, v in aliases.items() for x in (k.strip().lower(), v.strip().lower())]
    return F.coalesce(F.create_map(*pairs)[name], name)


def scope_country(c: ColumnLike) -> Column:
    s = slug(c)
    return F.when(s == "china_mainland", F.lit("china")).otherwise(s)


def in_scope(country: ColumnLike, status: ColumnLike, countries: Iterable[str], statuses: Iterable[str]) -> Column:
    """Country and lifecycle scope; an empty status list admits every status."""
    countries, statuses = list(countries), list(statuses)
    ok = scope_country(country).isin([_py_scope(x) for x in countries])
    if statuses:
        ok = ok & slug(status).isin([_py_slug(x) for x in statuses])
    return F.coalesce(ok, F.lit(False))


def _py_slug(s: str) -> str:
    return "_".join(part for part in "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in s.lower()).split())


def _py_scope(s: str) -> str:
    s = _py_slug(s)
    return "china" if s == "china_mainland" else s


def parameter_group(name: ColumnLike) -> Column:
    """Family of a canonical parameter name; first matching family wins."""
    n = F.coalesce(canonical_name(name), F.lit(""))
    return (
        F.when(n.isin(*ENVIRONMENTAL_NAMES) | any_of(n, ENVIRONMENTAL_TOKENS), F.lit("environmental"))
        .when(n.isin(*ECONOMIC_NAMES) | any_of(n, ECONOMIC_TOKENS), F.lit("economic"))
        .when(any_of(n, TECHNICAL_TOKENS), F.lit("technical"))
        .otherwise(F.lit("others"))
    )


def tri_state(c: ColumnLike) -> Column:
    s = F.lower(F.trim(col(c).cast("string")))
    return F.when(s.isin(*TRUE_WORDS), F.lit(True)).when(s.isin(*FALSE_WORDS), F.lit(False))


def number(c: ColumnLike) -> Column:
    """Numeric coercion: text that is no number, and NaN, become null."""
    v = col(c).try_cast("double")
    return F.when(~F.isnan(v), v)


def tag_voltages(c: ColumnLike) -> Column:
    """Every number of at least 1000 V in a tag, in kV, sorted and distinct (empty array if none)."""
    found = F.regexp_extract_all(F.coalesce(col(c).cast("string"), F.lit("")), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    volts = F.filter(F.transform(found, lambda t: t.cast("double")), lambda v: v >= 1000)
    return F.array_sort(F.array_distinct(F.transform(volts, lambda v: v / 1000)))


def tag_numbers(c: ColumnLike) -> Column:
    """Semicolon list of plain numbers; one bad token empties the whole list."""
    tokens = F.split(F.coalesce(col(c).cast("string"), F.lit("?")), ";")
    plain = r"^\s*\d+(\.\d+)?\s*$"
    return F.when(
        F.exists(tokens, lambda t: ~t.rlike(plain)), F.array().cast("array<double>")
    ).otherwise(F.transform(tokens, lambda t: F.trim(t).try_cast("double")))


def current_type(frequency: ColumnLike, name: ColumnLike) -> Column:
    """DC when a frequency token is zero or the name says so, else AC."""
    parts = F.split(F.coalesce(col(frequency).cast("string"), F.lit("")), "[;,/]")
    zero = F.exists(parts, lambda t: F.trim(t).isin("0", "0.0"))
    named = F.coalesce(col(name).cast("string"), F.lit("")).rlike(DC_NAME_PATTERN)
    return F.when(zero | named, F.lit("DC")).otherwise(F.lit("AC"))


def partial_time(c: ColumnLike, kind: str = "string") -> Column:
    """Keep the source precision of a time as text. `kind`: string, number or timestamp."""
    c = col(c)
    if kind == "timestamp":
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    if kind == "number":
        d = c.cast("double")
        whole = F.lpad(d.cast("long").cast("string"), 4, "0")
        return F.when(d.isNull() | F.isnan(d), F.lit(None).cast("string")).when(d == F.floor(d), whole).otherwise(c.cast("string"))
    s = F.trim(c.cast("string"))
    return F.when(~s.isin("", "nan", "NaT"), s)


def time_start(c: ColumnLike) -> Column:
    """Start of the interval a partial time stands for."""
    s = F.trim(col(c).cast("string"))
    full = (
        F.when(s.rlike(r"^\d{4}$"), F.concat(s, F.lit("-01-01")))
        .when(s.rlike(r"^\d{4}-\d{2}$"), F.concat(s, F.lit("-01")))
        .otherwise(s)
    )
    return full.try_cast("timestamp_ntz")


def time_end(c: ColumnLike) -> Column:
    """Exclusive end: a year, month, day or, for a full timestamp, one second later."""
    s = F.trim(col(c).cast("string"))
    start = time_start(s)
    return (
        F.when(s.rlike(r"^\d{4}$"), start + F.expr("INTERVAL 1 YEAR"))
        .when(s.rlike(r"^\d{4}-\d{2}$"), start + F.expr("INTERVAL 1 MONTH"))
        .when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), start + F.expr("INTERVAL 1 DAY"))
        .otherwise(start + F.expr("INTERVAL 1 SECOND"))
    )


def version_time(c: ColumnLike) -> Column:
    """Release label to a partial time: ISO stays, 'March 2026' becomes '2026-03', else null."""
    s = F.trim(col(c).cast("string"))
    word = F.initcap(s)
    month = F.coalesce(
        F.try_to_timestamp(word, F.lit("MMMM yyyy")), F.try_to_timestamp(word, F.lit("MMM yyyy"))
    )
    return F.when(s.rlike(r"^\d{4}(-\d{2}(-\d{2})?)?$"), s).otherwise(F.date_format(month, "yyyy-MM"))


def general_label(c: ColumnLike) -> Column:
    """Shortest label with six significant digits: 110.0 -> 110, 0.5 -> 0.5, 1e6 -> 1e+06."""
    v = col(c).cast("double")
    strip = lambda s: F.regexp_replace(s, r"(\.\d*?)0+$", "$1")
    fixed = F.regexp_replace(strip(F.format_string("%.10f", _significant(v))), r"\.$", "")
    sci = F.split(F.format_string("%.5e", v), "e")
    scientific = F.concat(F.regexp_replace(strip(sci[0]), r"\.$", ""), F.lit("e"), sci[1])
    big = (F.abs(v) >= 999999.5) | ((v != 0) & (F.abs(v) < 1e-4))
    return F.when(v.isNull(), F.lit(None).cast("string")).when(big, scientific).otherwise(fixed)


def _significant(v: Column) -> Column:
    mantissa = F.format_string("%.5e", v)
    return mantissa.try_cast("double")


def voltage_array(c: ColumnLike) -> Column:
    """Sorted distinct levels; an empty list becomes null."""
    clean = F.array_sort(F.array_distinct(F.filter(col(c), lambda v: v.isNotNull() & ~F.isnan(v))))
    return F.when(F.size(clean) > 0, clean)


def max_voltage(c: ColumnLike) -> Column:
    return F.array_max(F.filter(col(c), lambda v: v.isNotNull() & ~F.isnan(v)))


def carrier(cls: ColumnLike, subclass: ColumnLike) -> Column:
    return F.concat_ws(":", col(cls), col(subclass))


def base_class(c: ColumnLike) -> Column:
    return F.split_part(col(c), F.lit(":"), F.lit(1))


def log_display(c: ColumnLike) -> Column:
    return F.log10(F.greatest(F.coalesce(number(c), F.lit(0.0)), F.lit(0.0)) + 1)


def branch_style(voltage: ColumnLike, current: ColumnLike) -> Column:
    cur = F.coalesce(F.upper(col(current)), F.lit("AC"))
    return F.concat(F.coalesce(general_label(voltage), F.lit("Unknown")), F.lit(" kV "), cur)


def circuit_count(c: ColumnLike) -> Column:
    """First integer in the text, at least one; one when there is none."""
    first = F.regexp_extract(F.coalesce(col(c).cast("string"), F.lit("")), r"(\d+)", 1)
    return F.coalesce(F.greatest(first.try_cast("int"), F.lit(1)), F.lit(1))


def voltage_scale(base_kv: float, voltage: ColumnLike) -> Column:
    return F.pow(F.lit(float(base_kv)) / col(voltage), F.lit(2.0))


def null_if_nan(c: ColumnLike) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def is_missing_array(c: ColumnLike) -> Column:
    return col(c).isNull() | (F.size(col(c)) == 0)


def positive_or(c: ColumnLike, fallback: float) -> Column:
    c = col(c)
    return F.when((c > 0) & ~F.isnan(c), c).otherwise(F.lit(float(fallback)))


def fuel_labels(c: ColumnLike) -> Column:
    """All matching fuel labels joined by ';', else the lower-cased text; blank is null."""
    text = F.lower(F.coalesce(col(c).cast("string"), F.lit("")))
    hits = F.array(*[F.when(text.rlike(p), F.lit(label)) for p, label in FUEL_LABELS])
    joined = F.array_join(F.filter(hits, lambda x: x.isNotNull()), ";")
    return F.when(joined != "", joined).when(text != "", text)


def literal_map(mapping: Mapping[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def lookup(mapping: Mapping[str, object], key: ColumnLike) -> Column:
    return literal_map(mapping)[col(key)]


def is_json_object(c: ColumnLike) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(col(c))).startswith("OBJECT"), F.lit(False))


def sorted_json(entries: Column) -> Column:
    """JSON object from an array of (key, value) structs: keys sorted, nulls dropped."""
    kept = F.filter(entries, lambda e: e["value"].isNotNull())
    return F.to_json(F.map_from_entries(F.array_sort(kept)))
