"""The refresh of layers, the latest report, and dates in views."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as t
from tidemark.operators import refresh
from tidemark.operators.store import Table
from tidemark.schemas import Dataset
from tidemark.sources import reports

SETS = (Dataset("a", "A", "context", source_url="u/a"), Dataset("b", "B", "context", source_url="u/b"), Dataset("c", "C", "context", source_url="u/c"))


def layer(*features, **more):
    return json.dumps(more | {"type": "FeatureCollection", "features": list(features)})


def feature(x, y=35.5):
    return {"type": "Feature", "geometry": {"type": "Point", "coordinates": [x, y]}, "properties": {}}


def states(found):
    return {r.dataset_key: (r.state, r.error) for r in found.collect()}


def test_a_refresh_stores_what_passes_and_leaves_the_rest(spark, tmp_path):
    path, web = str(tmp_path / "layers"), {"u/a": layer(feature(14.0), feature(15.0)), "u/b": layer(feature(99.0))}

    def fetch(url, headers):
        assert "geo+json" in headers["accept"]
        return web[url]

    run = lambda **more: refresh.refresh(spark, path, SETS, fetch=fetch, **more)
    expected = {"a": ("changed", None), "b": ("failed", "feature 0 has no valid geometry"), "c": ("failed", "'u/c'")}
    assert states(run()) == expected and Table(spark, path, refresh.LAYERS).version() is None
    assert states(run(write=True)) == expected
    stored = {r.dataset_key: json.loads(r.raw) for r in Table(spark, path, refresh.LAYERS).read().collect()}
    assert list(stored) == ["a"] and stored["a"]["bbox"] == [14.0, 35.5, 15.0, 35.5] and len(stored["a"]["features"]) == 2
    # white space, the order of names and an old box make no change
    web["u/a"] = json.dumps(json.loads(layer(feature(14.0), feature(15.0), bbox=[0, 0, 0, 0])), indent=2, sort_keys=True)
    assert states(run(write=True))["a"] == ("unchanged", None)
    web["u/a"], web["u/b"] = layer(feature(14.5)), layer(feature(14.0, 36.0))
    found = {r.dataset_key: r for r in run(write=True).collect()}
    assert (found["a"].state, found["a"].current.feature_count, found["a"].next.feature_count) == ("changed", 2, 1) and found["b"].current is None
    web["u/a"] = "no JSON"
    assert states(run(write=True, only="a")) == {"a": ("failed", "not JSON")}
    assert sorted(r.dataset_key for r in Table(spark, path, refresh.LAYERS).read().collect()) == ["a", "b"]
    with pytest.raises(ValueError, match="no dataset z"):
        run(only="z")


def test_layers_that_do_not_pass(spark):
    texts = {"null": None, "json": "{", "kind": '{"type":"Point"}', "none": layer(), "type": layer(feature(14.0), {"type": "x"}), "shape": layer({"type": "Feature", "geometry": None}), "item": layer(None)}
    rows = spark.createDataFrame([(k, v, [13.0, 34.5, 16.0, 37.0], 1) for k, v in texts.items()], "dataset_key string, raw string, bounds array<double>, error int")
    got = {r.dataset_key: r for r in refresh.checked(rows).collect()}
    assert {k: r.error for k, r in got.items()} == {
        "null": "no text", "json": "not JSON", "kind": 'expected type FeatureCollection, got "Point"', "none": "no features", "type": "feature 1 is not a GeoJSON Feature", "shape": "feature 0 has no valid geometry",
        "item": "feature 0 is not a GeoJSON Feature",
    }
    assert all(r.payload is r.sha256 is r.feature_count is r.bbox is None for r in got.values())
    assert refresh.checked(rows.limit(0)).count() == 0


def test_latest_report(spark):
    page = '<a href="/uploads/2026/05/classification-week-2.pdf">x</a><a href="/uploads/2026/06/classification-week-1.pdf">x</a>'
    asked = []
    assert reports.fetch_latest(spark, "https://e.org/p", lambda u: page, lambda u: asked.append(u) or b"%PDF") == ("https://e.org/uploads/2026/06/classification-week-1.pdf", b"%PDF")
    assert asked == ["https://e.org/uploads/2026/06/classification-week-1.pdf"]
    with pytest.raises(LookupError, match="no report"):
        reports.fetch_latest(spark, "https://e.org/p", lambda u: "<p>", None)


def test_dates_in_views(spark):
    now = dt.datetime(2026, 6, 19, 12)
    texts = ["2026-06-19T10:00:00", "2026-06-19", "2026-06-19T12:00:00", "2026-06-20T12:00:01", "2024-06-19T12:00:00Z", "2026-05-19T12:00:00", "19 June", "", None, "2026-13-01", "2026-06-19T11:59:59.5"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", t.view_date(F.col("x")).alias("a"), t.view_relative(F.col("x"), F.lit(now)).alias("b"), t.datetime_local(F.col("x")).alias("c"))
    assert [(r.a, r.b, r.c) for r in rows.orderBy("i").collect()] == [
        ("19 Jun 2026, 10:00", "2 hours ago", "2026-06-19T10:00"), ("19 Jun 2026, 00:00", "12 hours ago", "2026-06-19T00:00"), ("19 Jun 2026, 12:00", "in 0 seconds", "2026-06-19T12:00"),
        ("20 Jun 2026, 12:00", "in 1 day", "2026-06-20T12:00"), ("19 Jun 2024, 12:00", "2 years ago", "2024-06-19T12:00"), ("19 May 2026, 12:00", "1 month ago", "2026-05-19T12:00"), ("19 June", "", "19 June"), ("", "", ""), ("", "", ""),
        ("2026-13-01", "", "2026-13-01"), ("19 Jun 2026, 11:59", "0 seconds ago", "2026-06-19T11:59"),
    ]
