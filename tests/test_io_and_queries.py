"""Readers, writers, contracts, and registered queries against SQL on the smallest tables."""

import json
import math
import os
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom.operators import contracts, payloads, rules
from gridloom.operators.aggregate import identity_membership
from gridloom.operators.case import CaseComponent
from gridloom.plans.registry import load_all
from gridloom.plans.views import BASE
from gridloom.sources import files, inventory, sinks

DATA = "/root/testdata/sf0.001"
CHECKED = (
    "snake_case", "fuel_labels", "align_downsample", "run_of_river", "dispatch_by_class", "box_crosswalk", "weights_extensive_aux", "nearest_bus_same_admin",
    "point_in_cell", "component_labels", "line_systems", "bus_chain_equipment", "aggregate_assets", "aggregate_parameters", "parameter_conflicts",
    "manifest_report", "load_profile_checks", "capacity_comparison", "raster_blocks", "generators_standard", "hourly_demand_per_bus",
)


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_geojson_rings(spark, folder):
    square = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    hole = [[1, 1], [2, 1], [2, 2], [1, 1]]
    path = os.path.join(folder, "a.json")
    with open(path, "w") as f:
        json.dump({"type": "FeatureCollection", "features": [
            {"type": "Feature", "properties": {"id": "a", "level": "province"}, "geometry": {"type": "Polygon", "coordinates": [square, hole]}},
            {"type": "Feature", "properties": None, "geometry": {"type": "MultiPolygon", "coordinates": [[square], [square]]}},
        ]}, f)
    d = files.read_features(spark, path, "id string, level string")
    assert [r.id for r in d.orderBy(F.col("id").desc_nulls_last()).collect()] == ["a", None]
    rings = files.feature_rings(d.withColumn("id", F.coalesce("id", F.lit("b"))), "id").collect()
    assert sorted((r.id, r.part, r.sign, len(r.ring)) for r in rings) == [("a", 0, -1, 4), ("a", 0, 1, 5), ("b", 0, 1, 5), ("b", 1, 1, 5)]


def test_project_file(spark, folder):
    path = os.path.join(folder, "p.json")
    device = lambda t: {"Storage Device": {"Technology Mid-Type": t}}
    with open(path, "w") as f:
        json.dump([{"ID": 1, "Country": "China", "Subsystems": [device("b"), device("a"), device("b")]}, {"ID": 2, "Subsystems": None}], f)
    assert [(r.id, r.technology) for r in files.read_projects(spark, path).orderBy("id").collect()] == [("1", "a; b"), ("2", "")]


def test_opl(spark):
    lines = spark.createDataFrame([("n1 v1 x1.5 y2.5",), ("n2 v1 x1",), ("w7 Tname=a%20%b Nn1,n2,n1",), ("r1 M",)], "value string")
    nodes, refs = files.parse_opl(lines)
    assert [tuple(r) for r in nodes.collect()] == [(1, 1.5, 2.5)]
    assert sorted(tuple(r) for r in refs.collect()) == [("osm:way:7", 0, 1), ("osm:way:7", 1, 2), ("osm:way:7", 2, 1)]


def test_tables_series_and_components(spark, folder):
    d = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 2.0)], "uid string, class string, value double")
    sinks.write_table(d, f"{folder}/t", standard_dataset_id="population")
    back = files.read_table(spark, f"{folder}/t", ["uid"])
    assert contracts.attributes(back) == {"standard_dataset_id": "population"} and back.columns == ["uid"]
    sinks.write_series(d, f"{folder}/s")
    assert files.read_series(spark, f"{folder}/s", classes=["x"]).count() == 1
    with pytest.raises(ValueError):
        files.read_series(spark, f"{folder}/s", d.where("uid = 'a'").select("uid"))
    sinks.write_component(CaseComponent(d, d, identity_membership(d)), f"{folder}/c")
    assert sinks.read_component(spark, f"{folder}/c").membership.count() == 2
    paths = [f"{folder}/c/{n}" for n in sinks.COMPONENT_TABLES]
    assert sinks.is_complete(spark, paths) and not sinks.is_complete(spark, [f"{folder}/none"])
    sinks.write_bundle({"bus": d, "branch": d}, f"{folder}/n")
    assert files.read_network(spark, f"{folder}/n", ("bus", "branch"))["bus"].count() == 2
    sinks.write_csv(d, f"{folder}/csv")
    assert files.read_csv(spark, f"{folder}/csv", "uid string, class string, value double").agg(F.sum("value")).first()[0] == 3.0


def test_payload_report_and_result(spark, folder):
    d = spark.createDataFrame([("a", 1.0, 2.0, float("nan"))], "uid string, x double, y double, v double")
    feature = payloads.feature_json(d, ["uid", "v"], payloads.point_geometry())
    sinks.write_payload(feature.withColumnRenamed("feature", "value"), f"{folder}/p")
    got = json.loads(spark.read.text(f"{folder}/p").first()[0])
    assert got == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}, "properties": {"uid": "a", "v": None}}
    sinks.write_report({"summary": d, "issues": d}, f"{folder}/r")
    assert spark.read.text(f"{folder}/r").count() == 2
    sinks.write_result(d.withColumn("component", F.lit("load")), d.select("uid"), f"{folder}/o")
    series, summary = sinks.read_result(spark, f"{folder}/o")
    assert series.count() == 1 and summary.first().uid == "a"


def test_inventory(spark, folder):
    with open(os.path.join(folder, "one.bin"), "wb") as f:
        f.write(b"abc")
    row = inventory.scan_files(spark, folder, "sha256").first()
    assert row.size_bytes == 3 and row.checksum.startswith("ba7816bf")
    with pytest.raises(ValueError):
        inventory.digest(F.lit("x"), "crc9")


def test_rule_table_checks(spark):
    cols = ", ".join(f"{c} string" for c in rules.RULE_COLUMNS)
    row = ("r", "1", "s", "", "", "", "generator", "coal", "")
    ok = spark.createDataFrame([row], cols)
    assert rules.load_rules(ok, "s")[0]["rule_id"] == "r"
    with pytest.raises(ValueError):
        rules.load_rules(spark.createDataFrame([row, row], cols), "s")
    with pytest.raises(ValueError):
        rules.load_rules(ok, "other")
    with pytest.raises(Exception):
        rules.load_rules(spark.createDataFrame([("r", "1", "s", "(", "", "", "generator", "coal", "")], cols), "s")


def test_contract(spark):
    names = contracts.REQUIRED_COLUMNS["population"]
    d = spark.createDataFrame([("u",)], "uid string").select(*[F.col("uid") if c == "uid" else F.lit(None).cast("string").alias(c) for c in reversed(names)], F.lit(1).alias("extra"))
    out = contracts.finalize(d, "population")
    assert out.columns == [*names, "extra"] and dict(out.dtypes)["population"] == "double"
    assert contracts.contract_issues(out, "population") == []
    assert ("missing_column", "population") in contracts.contract_issues(out.drop("population"), "population")
    with pytest.raises(ValueError, match="not unique"):
        contracts.finalize(d.union(d), "population")


def test_every_query_has_sql():
    registry = load_all()
    assert len(registry) > 150 and all(q.sql for q in registry.values())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 4) if isinstance(v, float) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, duck, name):
    q = load_all()[name]
    df = q.run(spark, DATA)
    rel = duck.execute(q.sql)
    columns = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(columns)
    ours, theirs = _rows(df.columns, df.collect()), _rows(columns, rel.fetchall())
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        assert all(x == y or (isinstance(x, float) and abs(x - y) <= 2e-4) for x, y in zip(a, b)), (a, b)
