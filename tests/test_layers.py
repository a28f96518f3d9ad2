"""Layers: reading, validity, adapters, ids, guards, classes and the catalog."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import geo
from tidemark.operators import adapters, catalog, classification
from tidemark.schemas import Dataset
from tidemark.sources import geojson, reports

SQUARE = [[14.0, 35.0], [14.1, 35.0], [14.1, 35.1], [14.0, 35.1], [14.0, 35.0]]


def collection(*features):
    return json.dumps({"type": "FeatureCollection", "features": list(features)})


def feature(geometry, **properties):
    return {"type": "Feature", "geometry": geometry, "properties": properties}


def point(x=14.4, y=35.9):
    return {"type": "Point", "coordinates": [x, y]}


def beaches(n):
    return collection(*[feature(point(14.4 + i * 1e-4), Site_Code=f"TEST-{i}", Name_ENG=f"Test beach {i}") for i in range(n)])


def layer(spark, key, raw):
    return spark.createDataFrame([(key, raw)], "dataset_key string, raw string")


def test_reading_keeps_what_can_be_read(spark, tmp_path):
    (tmp_path / "a.geojson").write_text(beaches(2))
    (tmp_path / "b.geojson").write_text('{"type":"Nope"}')
    (tmp_path / "c.geojson").write_text('{"type":"FeatureCollection","features":{}}')
    layers, failed = geojson.read_layers(spark, {k: str(tmp_path / f"{k}.geojson") for k in "abcd"})
    assert [r.dataset_key for r in layers.collect()] == ["a"]
    assert "Nope" in failed["b"] and "array" in failed["c"] and "d" in failed
    assert geojson.features(layers).count() == 2


@pytest.mark.parametrize(
    ("geometry", "valid"),
    [
        (point(), True),
        (point(0, 0), False),
        ({"type": "Point", "coordinates": [14.0]}, False),
        ({"type": "Point", "coordinates": "x"}, False),
        ({"type": "MultiPoint", "coordinates": []}, False),
        ({"type": "LineString", "coordinates": SQUARE[:2]}, True),
        ({"type": "LineString", "coordinates": SQUARE[:1]}, False),
        ({"type": "LineString", "coordinates": [[14.0, 35.0], [14.0, None]]}, False),
        ({"type": "MultiLineString", "coordinates": [SQUARE[:2], SQUARE[1:3]]}, True),
        ({"type": "Polygon", "coordinates": [SQUARE]}, True),
        ({"type": "Polygon", "coordinates": [SQUARE[:4]]}, False),
        ({"type": "Polygon", "coordinates": []}, False),
        ({"type": "Polygon", "coordinates": SQUARE}, False),
        ({"type": "MultiPolygon", "coordinates": [[SQUARE]]}, True),
        ({"type": "GeometryCollection", "geometries": []}, False),
    ],
)
def test_validity(spark, geometry, valid):
    row = spark.createDataFrame([(json.dumps(geometry),)], "g string").select(geo.valid_geometry(F.parse_json("g")).alias("v"), geo.bbox(geo.positions(F.parse_json("g"))).alias("b")).first()
    assert row.v == valid
    if valid:
        assert len(row.b) == 4


def adapted(spark, key, **properties):
    return spark.createDataFrame([(json.dumps(properties),)], "p string").select(adapters.ADAPTERS[key](F.parse_json("p")).alias("s")).first().s


def test_diving_site(spark):
    s = adapted(spark, "diving-sites", siteName=" Um ", siteType="location", hasDescription="true", shortDescription="x", interest="Cave & Reef & Wall", depthAverageMeters=5, depthMaxMeters="30", depthMaxIsMinimum=True, youtube="abcdef1,0,1", links="https://a.b|L", rating="4.5", ratings=2.5, identifier="http://i", sourcePath="p")
    assert (s.title, s.subtitle, s.description, s.tags, s.sourceId, s.sourceUrl) == ("Um", "Dive location", "x", ["Cave", "Reef", "Wall"], "p", "http://i")
    assert [tuple(d) for d in s.details] == [("Depth", "5–30+ m")] and s.youtubeIds == ["abcdef1"] and tuple(s.links[0]) == ("https://a.b", "L") and tuple(s.rating) == (4.5, 3)
    assert adapted(spark, "diving-sites", siteName=5).title is None
    assert adapted(spark, "diving-sites", text="t", depthMaxMeters="").details[0].value == "0 m"


def test_other_adapters(spark):
    assert adapted(spark, "bunkering-areas", name="Area 4", localId="bunkeringArea_2").title == "Bunkering area 4"
    assert adapted(spark, "bunkering-areas", localId="bunkeringArea_3").title == "Bunkering area 3"
    a = adapted(spark, "anchoring-and-mooring-hotspots", text="Bay", description="Boating hotspot - Seasonal", beginLifespanVersion="2020-01-02T00:00:00Z")
    assert (a.subtitle, a.tags, a.details[0].value) == ("Boating hotspot", ["Seasonal"], "2020-01-02")
    b = adapted(spark, "beaches", Name_ENG="Bay", Name_MT="BAY", Site_Code="A01", Sandy_OR_Rocky_Beach="ROCKY Beach", Blue_Flag_OR_Beach_of_Quality="Yes", RecommendedForBathing_YES_OR_NO="NO", Bathing_Water_Profile="https://p")
    assert b.tags == ["Rocky beach", "Blue Flag / Beach of Quality", "Not recommended for bathing"] and "Maltese name" not in {d.label for d in b.details} and b.links[0].label == "Bathing water profile"


def probe(keys):
    """Ids by sequential probing."""
    seen, out = set(), []
    for k in keys:
        found, i = f"d:{k}", 2
        while found in seen:
            found, i = f"d:{k}-{i}", i + 1
        seen.add(found)
        out.append(found)
    return out


def test_ids_collide_as_if_probed_in_order(spark):
    keys = ["a", "a", "a-2", "a", "b", "b-2-2", "b-2", "b-2", "b", "c", "c", "a-2", "!", "b"]
    rows = spark.createDataFrame([("d", i, k) for i, k in enumerate(keys)], "dataset_key string, feature_idx int, raw_id string").repartition(5)
    got = [r.id for r in catalog.with_ids(rows).orderBy("feature_idx").collect()]
    assert got == probe([k if k != "!" else "feature-13" for k in keys])


def test_drops_are_counted_in_order_of_precedence(spark):
    raw = collection(feature(None, text="x"), feature(point(0, 0)), feature(point()), feature(point(), text="ok"), feature(point(0, 0), text="x"))
    dataset = Dataset("anchoring-and-mooring-hotspots", "A", "interactive")
    rows = catalog.normalize(geojson.features(layer(spark, dataset.key, raw)), dataset)
    assert {r.reason: r["count"] for r in catalog.counts_by_reason(rows).collect()} == {"null geometry": 1, "invalid geometry": 2, "no title": 1}
    payload = json.loads(catalog.payload(rows).first().payload)
    assert [f["id"] for f in payload["features"]] == ["anchoring-and-mooring-hotspots:ok"] and payload["bbox"] == [14.4, 35.9, 14.4, 35.9]


def load(spark, tmp_path, n=80):
    (tmp_path / "beaches.geojson").write_text(beaches(n))
    (tmp_path / "routes.geojson").write_text(collection(feature({"type": "LineString", "coordinates": SQUARE[:2]}), feature(point(0, 0))))
    c = catalog.Catalog()
    c.load(spark, {"beaches": str(tmp_path / "beaches.geojson"), "harbour-approach-routes": str(tmp_path / "routes.geojson")})
    return c


def test_catalog(spark, tmp_path):
    c = load(spark, tmp_path)
    assert "invalid geometry" in c.failed["harbour-approach-routes"]
    assert c.status() == {"configured": 7, "loaded": 1, "unavailable": sorted({d.key for d in schemas.DATASETS} - {"beaches"}), "up": True}
    with pytest.raises(catalog.Unavailable):
        c.get("diving-sites")
    with pytest.raises(catalog.NotFound):
        c.get("nope")
    before = c.get("beaches")["sha256"]
    with pytest.raises(catalog.CatalogError, match="minimum safe count"):
        c.refresh(spark, "beaches", beaches(10))
    # a rejected candidate leaves nothing behind, also for a later change of classes
    classes = spark.createDataFrame([("TEST-0", "poor", True, "1 June 2026", "u"), ("ZZ", "good", False, None, "u")], schemas.CLASSIFICATIONS)
    assert c.set_classes(classes) == {"rebuilt": True, "merged": 1}
    entry = c.get("beaches")
    assert entry["feature_count"] == 80 and entry["sha256"] != before and len(entry["site_codes"]) == 80
    f = json.loads(entry["payload"])["features"]
    p = f[0]["properties"]
    assert p["details"][0] == {"label": "Water quality", "value": "Poor (as of 1 June 2026)"} and p["waterQuality"] == {"value": "poor", "label": "Poor", "rank": 1, "healthWarning": True}
    assert p["tags"] == ["Poor water quality", "Health warning"] and p["tagsCsv"] == ",Poor water quality,Health warning," and p["waterQualityRank"] == 1
    assert "waterQuality" not in f[1]["properties"]
    assert len(c.revision(spark)) == 64
    assert c.reapply(classes.limit(0)) == {"rebuilt": False, "merged": 0}
    with pytest.raises(catalog.CatalogError, match="no adapter"):
        catalog.normalize(geojson.features(layer(spark, "x", beaches(1))), Dataset("x", "X", "interactive"))


def test_etags():
    assert catalog.etag_matches('W/"a", "b"', '"a"') and catalog.etag_matches("*", '"z"') and catalog.etag_matches('"b"', 'W/"b"')
    assert not catalog.etag_matches(None, '"a"') and not catalog.etag_matches('"ab"', '"a"')


def test_reports(spark):
    sites = [{"siteCode": "a 01", "classification": " Poor ", "healthWarning": True}, {"siteCode": "A01", "classification": "good", "healthWarning": False}, {"siteCode": "E01", "classification": "good", "healthWarning": False}, {"siteCode": "B 10", "classification": "closed", "healthWarning": False}, {"siteCode": "C01", "classification": "?", "healthWarning": False}]
    rows = reports.sites(spark.createDataFrame([(" 1 June 2026 ", sites)], reports.REPORT), schemas.CLASSES)
    assert {r.siteCode: (r.classification, r.healthWarning, r.publishedOn) for r in rows.collect()} == {"A01": ("poor", True, "1 June 2026"), "B10": ("closed", False, "1 June 2026")}
    with pytest.raises(ValueError, match="80"):
        reports.assert_enough(rows)
    known = spark.createDataFrame([("A01",), ("A02",)], "siteCode string")
    classification.assert_overlap(rows, known)
    classification.assert_overlap(rows, known.limit(0))
    with pytest.raises(ValueError, match="known"):
        classification.assert_overlap(rows, known.filter("siteCode = 'A02'"))
    assert classification.replace(known, rows)[1] == 1


def test_latest_link(spark):
    html = '<a class="x" href="/wp-content/uploads/2026/05/classification-week-3.pdf?x">A</a><a href="/wp-content/uploads/2026/06/Bathing-report-week_4.PDF">B</a><a href="/wp-content/uploads/2026/06/site-update.pdf">Week <b>5</b></a><a href="/z.pdf">other</a><a href="/x.html">classification</a>'
    links = reports.anchors(spark.createDataFrame([(1, html)], "k int, html string"), "k", "html")
    got = reports.latest(links, F.lit("https://h.org/p/q.html"), "k").first().url
    assert got == "https://h.org/wp-content/uploads/2026/06/site-update.pdf"
    assert reports.latest(links.filter("href = '/z.pdf'"), F.lit("https://h.org/"), "k").count() == 0
    rows = spark.createDataFrame([("a.pdf",), ("//o.org/a",), ("mailto:x",)], "h string").select(reports.absolute(F.col("h"), F.lit("https://h.org/p/q.html?z#f")).alias("u"))
    assert [r.u for r in rows.collect()] == ["https://h.org/p/a.pdf", "https://o.org/a", "mailto:x"]


def canonical(spark, kind, points):
    row = spark.createDataFrame([(kind, [{"lon": float(x), "lat": float(y)} for x, y in points])], "k string, p array<struct<lon:double,lat:double>>")
    return row.select(geo.fingerprint(F.col("k"), F.col("p")).alias("x")).first().x


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(-170, 170), st.integers(-80, 80)), min_size=3, max_size=6, unique=True), st.integers(0, 5), st.booleans())
def test_fingerprints_ignore_start_and_direction(spark, ring, turn, back):
    k = turn % len(ring)
    other = ring[k:] + ring[:k]
    other = other[::-1] if back else other
    assert canonical(spark, "polygon", [*ring, ring[0]]) == canonical(spark, "polygon", other)
    assert canonical(spark, "line", ring) == canonical(spark, "line", ring[::-1])


def test_sea():
    box = lambda x0, y0, x1, y1: [[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]]
    sea = geo.Sea([box(14.0, 35.8, 14.6, 36.1)], [box(14.2, 35.85, 14.4, 35.95)])
    assert not sea.touches("point", [(14.3, 35.9)]) and sea.touches("point", [(14.5, 36.0)])
    assert sea.touches("polygon", [(14.35, 35.9), (14.45, 35.9), (14.45, 35.92)])
    assert not sea.touches("polygon", [(14.25, 35.88), (14.35, 35.88), (14.3, 35.92)])
    assert sea.touches("line", [(14.3, 35.9), (14.5, 35.9)]) and not sea.touches("line", [(14.3, 35.9)])
    assert sea.touches("polygon", [(13.0, 35.0), (15.0, 35.0), (15.0, 37.0), (13.0, 37.0)])
    assert sea.touches("line", [(13.9, 35.7), (14.7, 36.2)]) and not sea.touches("point", [(10.0, 10.0)])
    assert geo.Sea([]).touches("point", [(0.0, 0.0)]) and not sea.touches("point", [])


def test_anchors():
    square = [{"lat": a, "long": b} for a, b in ((35.9, 14.5), (36.0, 14.5), (36.0, 14.6), (35.9, 14.6))]
    assert geo.anchor("polygon", square) == (35.95, 14.55)
    assert geo.anchor("line", square[:1]) == (35.9, 14.5) and geo.anchor("polygon", []) is None
    assert geo.anchor("point", [{"lat": None, "long": 1.0}, {"lat": 2.0, "long": 3.0}]) == (2.0, 3.0)
    lat, long = geo.anchor("line", square[:2])
    assert 35.9 <= lat <= 36.0 and long == 14.5


def test_polygon_assets(tmp_path):
    (tmp_path / "p.json").write_text(collection(feature({"type": "GeometryCollection", "geometries": [{"type": "Polygon", "coordinates": [SQUARE]}, point()]}), feature({"type": "MultiPolygon", "coordinates": [[SQUARE], [SQUARE]]}), feature(None)))
    assert len(geojson.read_polygons(str(tmp_path / "p.json"))) == 3 and geojson.read_polygons(str(tmp_path / "no.json")) == []
    assert [d.key for d in geojson.due(schemas.DATASETS)] == ["beaches"]
