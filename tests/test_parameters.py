"""Resolver ranks, contract values, validation and dispatch checks."""

import pytest
from pyspark.sql import functions as F

from gridloom.operators import dispatch, manifest, parameters
from gridloom.functions import scalars as S

COLUMNS = "uid string, name string, value double, unit string, applies_to_dataset string, applies_to_uid string, class string, quality string, source_id string, observed_at string, selector_json string"


def table(spark, *rows):
    base = dict(uid="p1", name="efficiency", value=0.4, unit="p.u.", applies_to_dataset="generator", applies_to_uid=None, **{"class": "coal"}, quality="source", source_id="s", observed_at="2020", selector_json="{}")
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], COLUMNS)


def assets(spark, *rows):
    return spark.createDataFrame([(u, c) for u, c in rows], "uid string, class string").withColumns(
        {"subclass": F.lit(None).cast("string"), "status": F.lit("operating"), "capacity_mw": F.lit(100.0)}
    )


def ranks(df):
    return {r.target_uid: (r.match_rank, r.match_result, r.value) for r in df.collect()}


def test_resolve_one_and_many(spark):
    out = parameters.resolve(assets(spark, ("a", "coal"), ("b", "gas")), table(spark, {}), ["efficiency"], dataset_id="generator")
    by = {r.target_uid: r for r in out.collect()}
    assert by["a"].match_rank == 0 and by["a"].value == 0.4
    assert by["b"].match_rank == -1 and by["b"].match_info == "mismatch:class (1)"
    gone = parameters.resolve(assets(spark, ("a", "coal")), table(spark, {}), ["nothing"], dataset_id="generator").first()
    assert gone.match_info == "no parameter has the requested name"


@pytest.mark.parametrize(
    "other, kwargs, rank, value",
    [
        ({"quality": "generic", "value": 0.5}, {}, 4, 0.4),
        ({"source_id": "z", "value": 0.5}, {"source_priority": {"s": 2, "z": 1}}, 3, 0.5),
        ({"value": 0.4}, {}, 6, 0.4),
        ({"value": 0.6}, {}, 7, None),
        ({"value": 0.4, "unit": "percent"}, {}, 7, None),
        ({"applies_to_uid": "a", "value": 0.9}, {}, 1, 0.9),
        ({"observed_at": "2024", "value": 0.7}, {}, 5, 0.7),
        ({"class": None, "value": 0.8}, {}, 2, 0.4),
    ],
)
def test_decisive_rank(spark, other, kwargs, rank, value):
    out = parameters.resolve(assets(spark, ("a", "coal")), table(spark, {}, {"uid": "p2", **other}), dataset_id="generator", **kwargs)
    got = out.first()
    assert (got.match_rank, got.value) == (rank, value)


def test_many_equal_records_stay_whole(spark):
    rows = [{"uid": f"p{i:05d}"} for i in range(1500)]
    got = parameters.resolve(assets(spark, ("a", "coal")), table(spark, *rows), dataset_id="generator").first()
    assert got.match_rank == 6 and got.selected_parameter_uid == "p00000"
    assert got.match_info == "parameter_uids=" + ";".join(r["uid"] for r in rows)  # every uid, whatever their number


def test_selector_context(spark):
    p = table(spark, {"selector_json": '{"current_type":"AC"}', "value": 0.03})
    a = assets(spark, ("a", "coal"))
    assert parameters.resolve(a, p, dataset_id="generator").first().match_info == "selector_mismatch:current_type (1)"
    assert parameters.resolve(a, p, dataset_id="generator", selector_context={"current_type": "AC"}).first().value == 0.03
    with pytest.raises(ValueError, match="conflicts"):
        parameters.resolve(a.withColumn("current_type", F.lit("DC")), p, dataset_id="generator", selector_context={"current_type": "AC"})
    with pytest.raises(ValueError, match="conflicts"):
        parameters.resolve(a, p, dataset_id="generator", declared_dataset="storage")


def test_candidate_table_columns(spark):
    d = parameters.candidate_table(assets(spark, ("a", "coal")), table(spark, {}, {"uid": "p2", "quality": "generic"}), dataset_id="generator")
    assert d.columns[:4] == ["selection_status", "match_rank", "rank_m1_ineligible", "rank_0_eligible"]
    assert {r.uid: r.selection_status for r in d.collect()} == {"p1": "selected", "p2": "not_selected"}


def test_contract_values_and_coverage(spark):
    branch = spark.createDataFrame([("l1", "AC"), ("l2", "AC")], "uid string, current_type string")
    p = spark.createDataFrame([("l1", "r_ohm_per_km", 0.04, "ohm/km"), ("l2", "r_ohm_per_km", 9.0, "invalid")], "uid string, name string, value double, unit string")
    spec = manifest.contract()["branch_ac_r"]
    values = manifest.with_values(branch, p, {"branch_ac_r": spec})
    assert {r.uid: r.branch_ac_r for r in values.collect()} == {"l1": 0.04, "l2": 0.03}
    row = manifest.coverage_report({"branch": branch}, {"branch": p}, [spec]).first()
    assert row.value == 0.5 and row.status == "fallback" and "unit_mismatches=1" in row.detail


def test_field_override(spark):
    storage = spark.createDataFrame([("a", 8.0), ("b", None), ("c", None)], "uid string, duration_h double")
    p = spark.createDataFrame([("b", "energy_to_power_ratio", 4.0, "h")], "uid string, name string, value double, unit string")
    out = manifest.with_values(storage, p, {"m": manifest.contract()["storage_max_hours"]})
    assert [r.m for r in out.orderBy("uid").collect()] == [8.0, 4.0, 6.0]
    assert len(manifest.contract()) == 25


def test_dispatch_validity(spark):
    d = spark.createDataFrame([("generator", "g", 1.0), ("generator", "g", -2.0), ("storage", "s", 3.0)], "component string, unit_uid string, p_mw double")
    load = spark.createDataFrame([(1.0,)], "p_set_mw double")
    row = dispatch.dispatch_validity(d, load, spark.createDataFrame([("s", 5.0)], "uid string, p_nom double")).first()
    assert not row.dispatch_valid and row.generator_min_mw == -2.0 and row.storage_limit_excess_mw == 0.0


def test_scope_and_versions(spark):
    d = spark.createDataFrame([("China Mainland", "Operating"), ("China", "retired"), ("India", "operating")], "c string, s string")
    assert [r[0] for r in d.select(S.in_scope("c", "s", ["China"], ["operating"])).collect()] == [True, False, False]
    v = spark.createDataFrame([("March 2026",), ("Mar 2026",), ("2022",), ("2022-05-01",), ("soon",)], "v string")
    assert [r[0] for r in v.select(S.version_time("v")).collect()] == ["2026-03", "2026-03", "2022", "2022-05-01", None]


def test_issue_codes(spark):
    bad = table(
        spark, {"uid": None}, {"uid": "d"}, {"uid": "d"}, {"uid": "n", "name": "Bad Name"}, {"uid": "j", "selector_json": "[1]"},
        {"uid": "k", "name": "minimum_soc", "value": 2.0},
    ).withColumns({"group": F.when(F.col("uid") == "j", "odd").otherwise(S.parameter_group("name")), "source_uid": F.lit("x"), "source_version": F.lit("1"),
                   "capacity_min_mw": F.when(F.col("uid") == "k", 5.0), "capacity_max_mw": F.when(F.col("uid") == "k", 1.0)})
    codes = {r.code for r in parameters.issues(bad).collect()}
    assert {"missing_value", "duplicate_uid", "noncanonical_name", "invalid_selector", "invalid_capacity_range", "invalid_per_unit_value", "invalid_parameter_group", "inconsistent_group"} <= codes
    assert not parameters.is_valid(parameters.issues(bad))
