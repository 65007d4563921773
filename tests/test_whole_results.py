"""Large keys, groups and axes keep every row."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridloom.operators import aggregate, backend, parameters, timeseries


def test_selector_keys_beyond_ten_thousand(spark):
    rows = spark.range(10_005).select(F.concat(F.lit('{"k'), F.col("id").cast("string"), F.lit('": 1}')).alias("selector_json"))
    assert parameters.selector_keys(rows, ["k3", "k10004", "other"]) == ["k10004", "k3"]


def test_display_ids_beyond_five_digits(spark):
    nodes = spark.range(100_005).select(F.format_string("node:%07d", "id").alias("uid"))
    ids = backend.dense_ids(nodes, "uid", "bus_")
    got = ids.agg(F.countDistinct("display_id").alias("n"), F.min_by("display_id", "uid").alias("a"), F.max_by("display_id", "uid").alias("z")).first()
    assert (got.n, got.a, got.z) == (100_005, "bus_00000", "bus_100004")


def test_members_beyond_a_thousand_are_listed(spark):
    assets = spark.range(1_500).select(
        F.format_string("gen:%d", "id").alias("uid"), F.lit("coal").alias("class"), F.lit("a").alias("subclass"), F.lit("bus:1").alias("bus_uid"),
        F.lit("operating").alias("status"), F.lit(1.0).alias("capacity_mw"), F.lit("cell:1").alias("spatial_uid"),
    )
    row = aggregate.aggregate_assets(assets, dataset_id="generator", method="bus").first()
    assert len(row.source_uid.split(";")) == 1_500


def test_availability_on_the_given_snapshots(spark):
    start = datetime(2024, 1, 1)
    hours = [start + timedelta(hours=h) for h in (0, 1, 2, 5)]
    axis = spark.createDataFrame([(h,) for h in hours], "time timestamp_ntz")
    assets = spark.createDataFrame([("a", "wind"), ("b", "coal")], "uid string, class string")
    profiles = spark.createDataFrame([("a", hours[3], 0.25)], "uid string, time timestamp_ntz, availability_pu double")
    got = {(r.uid, r.time): r.p_max_pu for r in timeseries.availability_matrix(assets, axis, profiles, ["wind"]).collect()}
    assert got == {**{("a", h): 0.0 for h in hours}, **{("b", h): 1.0 for h in hours}, ("a", hours[3]): 0.25}
    with pytest.raises(ValueError):
        timeseries.availability_matrix(assets, axis, profiles, ["wind"], timedelta(hours=2))


def test_matching_rule_labels(spark):
    rules = {r["rank"]: r for r in parameters.matching_rules(spark).collect()}
    assert rules[5].direction == "latest first" and rules[6].direction == "equivalent" and rules[4].configured_value


def test_next_value_of_a_sparse_axis(spark):
    """No range holds much more than its share, and every value finds its follower."""
    from pyspark.sql import functions as F

    from gridloom.operators import skew

    rng = random.Random(2)
    values = sorted({rng.randrange(10**14) for _ in range(4000)} | set(range(500)))
    df = spark.createDataFrame([(v,) for v in values], "p long").repartition(5)
    got = {r.p: r.next for r in skew.with_next_value(df, "p").collect()}
    assert got == dict(zip(values, [*values[1:], None]))
    parts = df.repartitionByRange(8, "p").groupBy(F.spark_partition_id().alias("k")).count().collect()
    assert max(r["count"] for r in parts) < 2 * len(values) / 8
