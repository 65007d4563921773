"""Building blocks that stay safe when one key holds a large part of the rows.

Each of them replaces a per-key window or a per-key collection by partial aggregates plus a join.
No broadcast is forced: AQE turns a join into a broadcast only after it has measured the side, and
splits skewed join partitions otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage


def with_group_totals(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Attach group aggregates to every row: partial aggregation, then a join on the group key."""
    keys = list(keys)
    totals = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    hidden = [f"__{k}" for k in keys]
    for k, h in zip(keys, hidden):
        totals = totals.withColumnRenamed(k, h)
    condition = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(h)) for k, h in zip(keys, hidden)))
    return df.join(totals, condition, "left").drop(*hidden)


def with_share(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Share of a row in its group total; null when the total is zero."""
    out = with_group_totals(df, keys, __total=F.sum(value))
    return out.withColumn(name, F.try_divide(F.col(value), F.col("__total"))).drop("__total")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Row with the smallest order tuple of each key, by `min_by` with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(df.columns)


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float], slack: float = 0.001
) -> DataFrame:
    """Linear-interpolated percentiles per key without gathering a whole group.

    Approximate percentiles (mergeable sketches) bracket the wanted ranks, one aggregate counts the
    rows under each bracket, and only the rows inside the brackets are ranked. A bracket widens to
    the group's minimum and maximum where the sketch could miss, so the result is exact.
    """
    names, k = list(quantiles), len(quantiles)
    group = list(keys) or ["__all"]
    df = df if keys else df.withColumn("__all", F.lit(0))
    data = df.select(*group, F.col(value).cast("double").alias("__v")).where(
        F.col("__v").isNotNull() & ~F.isnan("__v")
    )
    accuracy = int(4 / slack)
    marks = [max(0.0, q - slack) for q in quantiles.values()] + [min(1.0, q + slack) for q in quantiles.values()]
    sketch = data.groupBy(*group).agg(
        F.count("*").alias("__n"),
        F.percentile_approx("__v", [float(m) for m in marks], accuracy).alias("__m"),
        F.min("__v").alias("__min"),
        F.max("__v").alias("__max"),
    )
    small = F.col("__n") * slack < 4
    brackets = sketch.select(
        *group,
        "__n",
        F.posexplode(
            F.array(*[
                F.struct(
                    F.when(small | F.lit(q - slack <= 0), F.col("__min")).otherwise(F.col("__m")[i]).alias("lo"),
                    F.when(small | F.lit(q + slack >= 1), F.col("__max")).otherwise(F.col("__m")[k + i]).alias("hi"),
                    F.lit(float(q)).alias("q"),
                )
                for i, q in enumerate(quantiles.values())
            ])
        ).alias("__i", "__b"),
    ).select(*group, "__n", "__i", "__b.lo", "__b.hi", "__b.q")
    on = data.join(brackets, group)
    v = F.col("__v")
    # Rows below a bracket are only counted; rows inside are kept once per distinct value.
    slim = (
        on.where(v <= F.col("hi"))
        .withColumn("__v", F.when(v < F.col("lo"), F.lit(None)).otherwise(v))
        .groupBy(*group, "__i", "__n", "q", "__v")
        .agg(F.count("*").alias("__c"))
    )
    w = Window.partitionBy(*group, "__i").orderBy(F.col("__v").asc_nulls_first())
    ranked = slim.withColumn("__hi", F.sum("__c").over(w) - 1).withColumn("__lo", F.col("__hi") - F.col("__c") + 1)
    pos = F.col("q") * (F.col("__n") - 1)
    below, above = F.floor(pos), F.ceil(pos)
    hit = lambda r: F.max(F.when((F.col("__lo") <= r) & (F.col("__hi") >= r), F.col("__v")))
    out = ranked.groupBy(*group, "__i").agg(
        hit(below).alias("__a"), hit(above).alias("__z"), F.first(pos - F.floor(pos)).alias("__t")
    )
    interpolated = F.col("__a") + F.col("__t") * (F.col("__z") - F.col("__a"))
    return out.groupBy(*keys).agg(
        *[F.max(F.when(F.col("__i") == i, interpolated)).alias(n) for i, n in enumerate(names)]
    )


BLOCK = 4096


def with_listed(groups: DataFrame, rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Add sorted distinct values of columns as ';' text to a table of one row per key.

    The text holds all values of a group, so it is an option of the caller: the values also are rows of
    the membership table, which is the form for groups of any size.
    """
    for c in columns:
        values = rows.select(*keys, c).where(F.col(c).isNotNull()).distinct()
        text = F.array_join(F.array_sort(F.collect_list(c)), ";")
        found = values.groupBy(*keys).agg(text.alias(c)).withColumnsRenamed({k: f"__{k}" for k in keys})
        condition = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
        groups = groups.join(found, condition, "left").drop(*[f"__{k}" for k in keys])
        groups = groups.withColumn(c, F.coalesce(c, F.lit("")))
    return groups


def with_next(df: DataFrame, keys: Sequence[str], pos: str, payload: Sequence[str], name: str = "next") -> DataFrame:
    """Attach the payload of the following row (by integer position) of each key.

    Rows are windowed in blocks of positions; block ends look up the first row of the next block,
    and only those block heads are ordered per key.
    """
    rows = df.withColumn("__b", F.floor(F.col(pos) / BLOCK).cast("long"))
    inner = Window.partitionBy(*keys, "__b").orderBy(pos)
    heads = rows.groupBy(*keys, "__b").agg(F.min_by(F.struct(*payload), pos).alias("__head"))
    heads = heads.select(
        *keys, "__b", F.lead("__head").over(Window.partitionBy(*keys).orderBy("__b")).alias("__after")
    )
    return (
        rows.withColumn("__n", F.lead(F.struct(*payload)).over(inner))
        .join(heads, [*keys, "__b"])
        .withColumn(name, F.coalesce("__n", "__after"))
        .drop("__b", "__n", "__after")
    )


def with_next_value(df: DataFrame, value: str, name: str = "next") -> DataFrame:
    """Attach the next larger row's value to every row of a table of distinct values, however sparse they are.

    Ranges of the values (cut by Spark's sample of them) are ordered by themselves; the last row of a range takes
    the first value of the range behind it, and only those first values, one per range, are ordered as a whole.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = cut_lineage(df.select(value).repartitionByRange(parts, value).withColumn("__part", F.spark_partition_id()))
    heads = ranges.groupBy("__part").agg(F.min(value).alias("__head"))
    heads = heads.select("__part", F.lead("__head").over(Window.orderBy("__part")).alias("__after"))
    inner = Window.partitionBy("__part").orderBy(value)
    out = ranges.withColumn("__n", F.lead(value).over(inner)).join(heads, "__part")
    return out.select(value, F.coalesce("__n", "__after").alias(name))


def with_running_max(df: DataFrame, keys: Sequence[str], pos: str, value: Column, name: str) -> DataFrame:
    """Running maximum by integer position, in blocks with a carried maximum."""
    rows = df.withColumn("__b", F.floor(F.col(pos) / BLOCK).cast("long")).withColumn("__v", value)
    inner = Window.partitionBy(*keys, "__b").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy(*keys, "__b").agg(F.max("__v").alias("__m")).select(
        *keys, "__b", F.max("__m").over(before).alias("__carry")
    )
    return (
        rows.withColumn("__r", F.max("__v").over(inner)).join(carry, [*keys, "__b"])
        .withColumn(name, F.coalesce(F.greatest("__r", "__carry"), "__r", "__carry"))
        .drop("__b", "__v", "__r", "__carry")
    )


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows of a small table to all shuffle partitions, before a step that makes many rows of each."""
    return df.repartition(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def by_shuffle(df: DataFrame) -> DataFrame:
    """For the join of a table that grows with the input: it is never sent to the driver and from there to all executors.

    Spark takes the size of compressed files for the size of their rows, so it would broadcast tables of which the
    rows are tens of times as large as their files.
    """
    return df.hint("merge")


def require_none(bad: DataFrame, message: str) -> None:
    """Fail fast when a rule query returns rows; shows a bounded sample only."""
    sample = bad.limit(5).collect()
    if sample:
        raise ValueError(f"{message}: {[r.asDict() for r in sample]}")


def beside(*rows: DataFrame) -> DataFrame:
    """Put tables of exactly one row next to each other."""
    keyed = [r.withColumn("__one", F.lit(1)) for r in rows]
    return reduce(lambda a, b: a.join(b, "__one"), keyed).drop("__one")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")
