"""Long-form series (time timestamp_ntz, uid, class, value): zones, steps, smoothing, calendar checks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .skew import exact_percentiles, require_none, with_group_totals

SERIES_KEYS = ("uid", "class")
BLOCK_STEPS = 4096


def to_local(df: DataFrame, source_zone: str, target_zone: str, time: str = "time") -> DataFrame:
    """Naive local timestamps of one zone to naive local timestamps of another."""
    if source_zone == target_zone:
        return df
    return df.withColumn(time, F.convert_timezone(F.lit(source_zone), F.lit(target_zone), F.col(time)))


def _first_midnight(df: DataFrame, time: str) -> datetime | None:
    first = df.agg(F.min(time)).first()[0]
    return first and first.replace(hour=0, minute=0, second=0, microsecond=0)


def _interval(step: timedelta) -> str:
    return f"{int(step.total_seconds())} seconds"


def downsample(
    df: DataFrame, step: timedelta, value: str, keys: Iterable[str] = SERIES_KEYS, time: str = "time"
) -> DataFrame:
    """Mean per bin: left-closed, left-labelled, bins count from midnight of the first day.

    Bins without any row are returned with a null value, like every bin between the ends.
    """
    keys = list(keys)
    origin = _first_midnight(df, time)
    if origin is None:
        return df.select(time, *keys, value)
    offset = int((origin - datetime(1970, 1, 1)).total_seconds()) % int(step.total_seconds())
    binned = (
        df.groupBy(F.window(time, _interval(step), startTime=f"{offset} seconds").alias("w"), *keys)
        .agg(F.avg(value).alias(value))
        .select(F.col("w.start").cast("timestamp_ntz").alias(time), *keys, value)
    )
    ends = binned.agg(F.min(time).alias("lo"), F.max(time).alias("hi")).first()
    grid = df.select(*keys).distinct().select(_axis(ends["lo"], ends["hi"], step).alias(time), *keys)
    return grid.join(binned, [time, *keys], "left").select(time, *keys, value)


def _axis(lo: datetime, hi: datetime, step: timedelta) -> Column:
    """Explode a regular calendar; the driver only knows its two ends."""
    return F.explode(
        F.sequence(F.lit(lo).cast("timestamp_ntz"), F.lit(hi).cast("timestamp_ntz"), F.expr(f"INTERVAL '{int(step.total_seconds())}' SECOND"))
    )


def upsample(
    df: DataFrame, source_step: timedelta, step: timedelta, value: str,
    keys: Iterable[str] = SERIES_KEYS, time: str = "time",
) -> DataFrame:
    """Linear interpolation of a regular series onto a finer step; nothing beyond its ends.

    The following point is found by an equi-join on time + source step, so a long series is never
    sorted in one task.
    """
    keys = list(keys)
    back = F.expr(f"INTERVAL '{int(source_step.total_seconds())}' SECOND")
    after = df.select((F.col(time) - back).alias(time), *keys, F.col(value).alias("__next"))
    pairs = df.join(after.withColumn("__has", F.lit(True)), [time, *keys], "left")
    seconds = int(source_step.total_seconds())
    steps = F.when(
        F.col("__has"),
        F.sequence(F.lit(0), F.lit(seconds - 1), F.lit(int(step.total_seconds()))),
    ).otherwise(F.array(F.lit(0)))
    fine = pairs.withColumn("__s", F.explode(steps))
    t = F.col("__s") / F.lit(float(seconds))
    return fine.select(
        (F.col(time) + F.make_dt_interval(secs=F.col("__s").cast("decimal(18,6)"))).alias(time),
        *keys,
        F.when(F.col("__s") == 0, F.col(value)).otherwise(F.col(value) + t * (F.col("__next") - F.col(value))).alias(value),
    )


def align_time(
    df: DataFrame, *, source_zone: str, target_zone: str, source_step: timedelta, target_step: timedelta,
    value: str, keys: Iterable[str] = SERIES_KEYS,
) -> DataFrame:
    """One zone and one step: mean when coarser, linear when finer, unchanged otherwise."""
    out = to_local(df, source_zone, target_zone)
    if target_step > source_step:
        return downsample(out, target_step, value, keys)
    if target_step < source_step:
        return upsample(out, source_step, target_step, value, keys)
    return out


def between_times(df: DataFrame, start: str | None, end: str | None, zone: str | None = None, time: str = "time") -> DataFrame:
    """Inclusive window; an empty bound is open; bounds that carry an offset become local time first."""
    def bound(text: str) -> Column:
        zoned = zone and (text.endswith("Z") or "+" in text[10:] or "-" in text[10:])
        if zoned:
            return F.expr(f"convert_timezone('UTC', '{zone}', CAST(to_utc_timestamp(TIMESTAMP '{text}', current_timezone()) AS TIMESTAMP_NTZ))")
        return F.lit(text).cast("timestamp_ntz")

    out = df
    if start:
        out = out.where(F.col(time) >= bound(start))
    if end:
        out = out.where(F.col(time) <= bound(end))
    return out


def common_times(a: DataFrame, b: DataFrame, time: str = "time") -> tuple[DataFrame, DataFrame]:
    """Both series on the timestamps they share."""
    ta, tb = a.select(time).distinct(), b.select(time).distinct()
    left, right = a.join(tb, time, "left_semi"), b.join(ta, time, "left_semi")
    if left.isEmpty():
        raise ValueError("The series have no common timestamps.")
    return left, right


def missing_times(wanted: DataFrame, available: DataFrame, time: str = "time") -> DataFrame:
    return wanted.select(time).distinct().join(available.select(time).distinct(), time, "left_anti")


def infer_step(times: DataFrame, time: str = "time") -> DataFrame:
    """One row (n, step): 'snapshot' for one timestamp, 'k s' for a regular axis, else 'irregular'.

    n distinct times on a lattice of exactly n points are regular, so two aggregates decide it.
    """
    axis = times.select(F.unix_micros(F.col(time).cast("timestamp")).alias("t")).distinct()
    ends = axis.agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("n"))
    step = F.try_divide(F.col("hi") - F.col("lo"), F.col("n") - 1)
    off = F.count_if(F.pmod(F.col("t") - F.col("lo"), F.col("w")) != 0)
    checked = axis.join(ends.withColumn("w", step)).groupBy("n", "w").agg(off.alias("off"))
    label = (
        F.when(F.col("n") == 1, F.lit("snapshot"))
        .when((F.col("off") == 0) & (F.col("w") == F.floor("w")), F.concat((F.col("w") / 1e6).cast("long").cast("string"), F.lit(" s")))
        .otherwise(F.lit("irregular"))
    )
    return checked.select("n", label.alias("step"))


def require_regular(df: DataFrame, step: timedelta, keys: Iterable[str] = SERIES_KEYS, time: str = "time") -> None:
    """Smoothing counts rows, so a series must have every step between its ends exactly once."""
    span = (F.unix_seconds(F.max(time).cast("timestamp")) - F.unix_seconds(F.min(time).cast("timestamp"))) / step.total_seconds() + 1
    bad = df.groupBy(*keys).agg(F.count("*").alias("rows"), F.countDistinct(time).alias("times"), span.alias("wanted"))
    require_none(bad.where("rows <> times OR rows <> wanted"), "Series are not gap-free")


def centered_mean(
    df: DataFrame, width: int, step: timedelta, value: str, out: str,
    keys: Iterable[str] = SERIES_KEYS, time: str = "time", block_steps: int = BLOCK_STEPS,
) -> DataFrame:
    """Centred rolling mean over `width` rows of a gap-free series, shorter at the ends.

    An even width leans to the past (24 rows: 12 before, 11 after). A series is cut into blocks of
    steps with a halo copied from the neighbours, so one long series spreads over many tasks.
    """
    if width < 1:
        raise ValueError("The window must be positive.")
    keys = list(keys)
    before, after = width // 2, width - 1 - width // 2
    span = max(block_steps, width)
    pos = F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / int(step.total_seconds())).cast("long")
    own = F.floor(F.col("__pos") / span).cast("long")
    copies = F.sequence(F.floor((F.col("__pos") - after) / span).cast("long"), F.floor((F.col("__pos") + before) / span).cast("long"))
    spread = df.withColumn("__pos", pos).withColumn("__own", own).withColumn("__block", F.explode(copies))
    w = Window.partitionBy(*keys, "__block").orderBy("__pos").rangeBetween(-before, after)
    return (
        spread.withColumn(out, F.avg(value).over(w))
        .where(F.col("__block") == F.col("__own"))
        .drop("__pos", "__own", "__block")
    )


def clip01(c: Column) -> Column:
    """Clip to [0, 1]; NaN is missing, not large."""
    v = F.when(~F.isnan(c), c)
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))


def stack_classes(parts: Mapping[str, DataFrame], value: str) -> DataFrame:
    """Variables as one class dimension, clipped to [0, 1]."""
    out = None
    for name, df in parts.items():
        one = df.select("time", "uid", F.lit(name).alias("class"), clip01(F.col(value)).alias("availability_pu"))
        out = one if out is None else out.unionByName(one)
    return out


def run_of_river(
    df: DataFrame, *, smoothing_steps: int, design_quantile: float, environmental_fraction: float,
    step: timedelta = timedelta(hours=1), value: str = "runoff",
) -> DataFrame:
    """Runoff (time, uid, runoff) to run-of-river availability (time, uid, availability_pu)."""
    if smoothing_steps < 1:
        raise ValueError("smoothing_steps must be positive.")
    if not 0 < design_quantile < 1:
        raise ValueError("design_quantile must be between 0 and 1.")
    if not 0 <= environmental_fraction < 1:
        raise ValueError("environmental_fraction must be in [0, 1).")
    flow = centered_mean(
        df.withColumn(value, F.greatest(F.col(value), F.lit(0.0))), smoothing_steps, step, value, "__flow", ["uid"]
    )
    usable = with_group_totals(flow, ["uid"], __mean=F.avg("__flow")).withColumn(
        "__usable", F.greatest(F.col("__flow") - F.col("__mean") * environmental_fraction, F.lit(0.0))
    )
    design = exact_percentiles(usable, ["uid"], "__usable", {"__design": design_quantile})
    ratio = F.when(F.col("__design") > 0, F.col("__usable") / F.col("__design"))
    return usable.join(design, "uid", "left").select(
        "time", "uid", F.coalesce(clip01(ratio), F.lit(0.0)).alias("availability_pu")
    )


def hydro_shape(
    df: DataFrame, *, smoothing_steps: int, target_mean: float, step: timedelta = timedelta(hours=1), value: str = "runoff"
) -> DataFrame:
    """Smoothed runoff scaled so that its mean is the target availability, clipped to [0, 1]."""
    flow = centered_mean(
        df.withColumn(value, F.greatest(F.col(value), F.lit(0.0))), smoothing_steps, step, value, "__flow", ["uid"]
    )
    shaped = with_group_totals(flow, ["uid"], __mean=F.avg("__flow"))
    ratio = F.when(F.col("__mean") > 0, F.col("__flow") / F.col("__mean")) * target_mean
    return shaped.select("time", "uid", F.coalesce(clip01(ratio), F.lit(0.0)).alias("availability_pu"))


def year_checks(df: DataFrame, value: str) -> DataFrame:
    """One row: timestamps, whether they make a complete year, missing and out-of-range values."""
    v = F.col(value)
    return df.agg(
        F.countDistinct("time").alias("hours"),
        F.count_if(v.isNull() | F.isnan(v)).alias("missing"),
        F.count_if((v < 0) | (v > 1)).alias("out_of_range"),
    ).withColumn("complete_year", F.col("hours").isin(8760, 8784))


def horizon_windows(times: DataFrame, horizon: int, step: timedelta, time: str = "time") -> DataFrame:
    """Rolling-horizon window number of each snapshot of a regular axis; the last may be short."""
    axis = times.select(time).distinct()
    first = axis.agg(F.min(time)).first()[0]
    seconds = F.unix_seconds(F.col(time).cast("timestamp")) - F.unix_seconds(F.lit(first).cast("timestamp_ntz").cast("timestamp"))
    return axis.withColumn("window_id", F.floor(seconds / (horizon * step.total_seconds())).cast("long"))


def availability_matrix(
    assets: DataFrame, axis: DataFrame, profiles: DataFrame, variable_classes: Iterable[str], step: timedelta = timedelta(hours=1)
) -> DataFrame:
    """Availability per asset and given snapshot: its profile, else 0 for a variable class, else 1.

    Assets times snapshots is the result itself. The calendar is exploded per asset from its two ends by
    `step`, then kept where the axis has a snapshot, so gaps of the axis stay gaps. Snapshots that lie on no
    step are refused.
    """
    snapshots = axis.select("time").where("time IS NOT NULL").distinct()
    ends = snapshots.agg(F.min("time").alias("lo"), F.max("time").alias("hi")).first()
    micros = F.unix_micros(F.col("time").cast("timestamp"))
    low = F.unix_micros(F.lit(ends["lo"]).cast("timestamp"))
    require_none(snapshots.where(F.pmod(micros - low, F.lit(int(step.total_seconds() * 1e6))) != 0), "snapshots off the step")
    grid = assets.select("uid", "class", _axis(ends["lo"], ends["hi"], step).alias("time")).join(snapshots, "time", "left_semi")
    default = F.when(F.col("class").isin(*variable_classes), F.lit(0.0)).otherwise(F.lit(1.0))
    return grid.join(profiles.select("uid", "time", F.col("availability_pu").alias("__p")), ["uid", "time"], "left").select(
        "time", "uid", F.coalesce("__p", default).alias("p_max_pu")
    )
