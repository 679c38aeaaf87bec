"""Documents read in splits against the same documents read whole."""

import json
import random

import pytest

from streamweave.sources import geojson, tables

NASTY = ['}', '{"type":"Feature",', '"features":[{', '\\', '\\"', '"', "]}", "", "é{ü}", '\\u007d', "a}b{c", '","features":[']


def _document(rng, n):
    out = []
    for i in range(n):
        geometry = {"type": "LineString", "coordinates": [[rng.randint(-9, 9), i] for _ in range(rng.randint(0, 6))]}
        feature = {"type": "Feature", "properties": {"id": i, "name": rng.choice(NASTY) * rng.randint(1, 3), "features": [{"a": 1}], "more": {"features": [{"b": [1, {}]}]}}, "geometry": geometry}
        keys = list(feature)
        rng.shuffle(keys)
        out.append({k: feature[k] for k in keys})
    head = {"type": "FeatureCollection", "crs": {"properties": {"features": "no"}}, 'x"features': [{"id": -1}], "meta": [{"features": [{"id": -2}]}]}
    tail = {"after": [{"properties": {"id": -3}}], "last": {"a": ["}"]}}
    return head | {"features": out} | tail


@pytest.fixture
def splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    yield lambda size: [spark.conf.set(n, str(size)) for n in names]
    for n in names:
        spark.conf.unset(n)


@pytest.mark.parametrize("size", [37, 150, 4_000, 1_000_000])
def test_any_split_of_any_form(spark, tmp_path, splits, size):
    rng = random.Random(size)
    for i, form in enumerate([{"separators": (",", ":")}, {"indent": 3}, {"separators": (" , ", " :\n ")}, {"ensure_ascii": False}]):
        (tmp_path / f"{i}.json").write_text(json.dumps(_document(rng, 12), **form), encoding="utf-8")
    (tmp_path / "4.json").write_text('{"features": []}')
    (tmp_path / "5.json").write_text('{"type": "FeatureCollection"}\n')
    want = tables.geojson_features(spark, str(tmp_path), "id: long, name: string").where("id is not null").collect()
    splits(size)
    got = geojson.features(spark, str(tmp_path), "id: long, name: string")
    key = lambda r: (r["id"], r["name"], str(r["coordinates"]))
    have = sorted(map(key, got.collect()))
    assert len(have) == 48 and have == sorted(map(key, want))
    if size == 37:
        assert geojson._pieces(spark, str(tmp_path)).rdd.getNumPartitions() > 30


def test_a_feature_over_many_splits_and_a_document_cut_off(spark, tmp_path, splits):
    long = {"features": [{"properties": {"id": 1}, "geometry": {"type": "LineString", "coordinates": [[0, i] for i in range(900)]}}, {"properties": {"id": 2}, "geometry": {"type": "Multi", "coordinates": [[1, 1]]}}]}
    text = json.dumps(long)
    (tmp_path / "a.json").write_text(text)
    splits(100)
    rows = {r["id"]: r for r in geojson.features(spark, str(tmp_path / "a.json"), "id: long").collect()}
    assert set(rows) == {1, 2} and len(rows[1]["coordinates"]) == 900
    (tmp_path / "b.json").write_text(text[: text.index('"id": 2') + 3])
    assert [r["id"] for r in geojson.features(spark, str(tmp_path / "b.json"), "id: long").where("id is not null").collect()] == [1]


def test_changed_splits_are_an_error(spark, tmp_path, splits):
    (tmp_path / "a.json").write_text(json.dumps(_document(random.Random(1), 30)))
    splits(500)
    got = geojson.feature_texts(spark, str(tmp_path / "a.json"))
    splits(200)
    with pytest.raises(Exception, match="split otherwise"):
        got.count()
