"""Feature collections read in pieces hold the same features as read whole."""

import json
import random

import pytest

from gridloom.sources import files


def collection(rng, n):
    odd = ['plain', 'a "quoted" {brace}', 'end}', '{"type":"Feature"}', "back\\slash\\", 'ä}{"', "line\nbreak }, {", "", "\\\""]
    features = []
    for i in range(n):
        ring = [[rng.random(), rng.random()] for _ in range(rng.randrange(3, 40))]
        features.append({
            "type": "Feature", "properties": {"name": rng.choice(odd) + str(i), "nested": {"deep": [{"x": "}"}, {}]}, "uid": f"f{i}"},
            "geometry": {"type": "Polygon", "coordinates": [ring]},
        })
    return {"type": "FeatureCollection", "name": "a {odd} name", "crs": {"type": "name", "properties": {"name": "EPSG:4326"}}, "features": features, "end": {"a": 1}}


@pytest.mark.parametrize("indent", [None, 2])
def test_pieces_equal_the_whole(spark, tmp_path, indent):
    rng = random.Random(indent or 1)
    want = {}
    (tmp_path / "layers").mkdir()
    for k in range(2):
        data = collection(rng, 400)
        (tmp_path / "layers" / f"{k}.geojson").write_text(json.dumps(data, indent=indent, ensure_ascii=bool(k)), encoding="utf-8")
        for f in data["features"]:
            want.setdefault(f["properties"]["uid"], []).append((f["properties"]["name"], json.dumps(f["geometry"]["coordinates"])))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        path = str(tmp_path / "layers")
        assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 8
        got = {}
        rows = files.read_features(spark, path, "uid string, name string, missing string")
        for r in rows.selectExpr("uid", "name", "missing", "geometry.type AS kind", "cast(geometry.coordinates AS string) AS c").collect():
            assert r.missing is None and r.kind == "Polygon"
            got.setdefault(r.uid, []).append((r.name, json.dumps(json.loads(r.c))))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_empty_collections(spark, tmp_path):
    path = tmp_path / "none.geojson"
    path.write_text('{"type": "FeatureCollection", "features": []}\n')
    assert files.read_features(spark, str(path), "uid string").count() == 0
