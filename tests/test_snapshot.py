"""KML, zones, guards, merging, tables, settings and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import geo
from tidemark.operators import snapshot as s
from tidemark.operators import store
from tidemark.sources import config, http, kml
from tidemark.streaming import events

NOW = dt.datetime(2026, 6, 1, 12)
RING = "14.0,35.0,0 14.1,35.0 14.1,35.1 14.0,35.0"


def document(*folders):
    return f'<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>{"".join(folders)}</Document></kml>'


def folder(name, *placemarks):
    return f"<Folder><name>{name}</name>{''.join(placemarks)}</Folder>"


def placemark(name, shape, description=""):
    return f"<Placemark><name>{name}</name><description><![CDATA[{description}]]></description>{shape}</Placemark>"


def polygon(at=RING):
    return f"<Polygon><outerBoundaryIs><LinearRing><coordinates>{at}</coordinates></LinearRing></outerBoundaryIs></Polygon>"


def point(at="14.0,35.0"):
    return f"<Point><coordinates>{at}</coordinates></Point>"


def line(at="14,35 15,36"):
    return f"<LineString><coordinates> {at} </coordinates></LineString>"


def test_kml():
    rows = kml.parse(document(folder("A", placemark("z", polygon() + point()), placemark("none", "")), folder("B", placemark("m", f"<MultiGeometry>{line()}{point()}</MultiGeometry>"))))
    assert [(r["folder"], r["name"], [g["type"] for g in r["geometries"]]) for r in rows] == [("A", "z", ["point", "polygon"]), ("B", "m", ["point", "line"])]
    assert kml.positions(",35") == [(0.0, 35.0)]


@pytest.mark.parametrize("xml", ["<html></html>", "<kml><a></kml>", "junk", document(folder("A", placemark("z", point("14")))), document(folder("A", placemark("z", point("200,0")))), document(folder("A", placemark("z", line("1,1 1,1")))), document(folder("A", placemark("z", polygon("1,1 2,2 1,1")))), document(folder("A", folder("B", placemark("z", point())))), document(folder("A", placemark("z", point(" "))))])
def test_bad_kml_fails_as_a_whole(xml):
    with pytest.raises(kml.KmlError):
        kml.parse(xml)


def test_reading_kml_files(spark, tmp_path):
    (tmp_path / "a.kml").write_text(document(folder("A", placemark("z", polygon()))))
    assert kml.read(spark, str(tmp_path)).count() == 1


@pytest.mark.parametrize(("name", "key"), [("Swimmer Zones in Malta 2027", "swimmer-zones"), ("CONSERVATION AREAS AROUND WRECKS (NtM)", "wreck-conservation"), ("Natura 2000 Sites", None), ("Other areas with restrictions", "other-restrictions")])
def test_layers(spark, name, key):
    assert spark.createDataFrame([(name,)], "n string").select(s.layer_of(F.col("n")).alias("k")).first().k == key


def full_map(n=60, extra=""):
    """A map with all layers and n swimmer zones."""
    swim = [placemark(f"Zone {i}", polygon(f"{14 + i * 0.001},35 14.5,35.0 14.5,35.5 {14 + i * 0.001},35"), f"In place from the 9th of April 2026 until 30 September 2026. Keep a distance of {i + 1}m.") for i in range(n)]
    return document(
        folder("Swimmer Zones", *swim, extra), folder("Conservation areas around wrecks, Notice to Mariners 09 of 2023", placemark("Wreck", point()), placemark("(1A) corner", point("14.2,35"))),
        folder("Archaeological zones at sea", placemark("Old", point())), folder("Life Garnija", placemark("Birds", line())), folder("Other areas with restrictions", placemark("Bay Pillar 1", polygon()), placemark("Park", polygon())), folder("Trees", placemark("Tree", polygon())),
    )


def test_zones(spark):
    ring2 = "14.1,35.1 14.1,35.0 14.0,35.0 14.1,35.1"
    xml = document(folder("Swimmer zones", placemark(" Blue  Lagoon", polygon()), placemark("blue lagoon", polygon(ring2), "text"), placemark("BLUE LAGOON", line(), "later"), placemark("Point", point())))
    z = s.zones(kml.placemarks(spark, xml)).collect()
    assert [(r.zoneName, len(r.geometries), r.sourceDescription, r.folderName) for r in z] == [("Blue Lagoon", 2, "text", "Swimmer zones")]
    keys = {r.layer for r in s.zones(kml.placemarks(spark, full_map())).collect()}
    assert keys == {d.key for d in schemas.MAP_LAYERS}
    names = {r.zoneName for r in s.zones(kml.placemarks(spark, full_map())).collect()}
    assert "(1A) corner" not in names and "Park" not in names and "Tree" not in names


def test_shapes_on_land_are_left_out(spark):
    sea = geo.Sea([[[[14.4, 34.0], [15.0, 34.0], [15.0, 36.0], [14.4, 36.0], [14.4, 34.0]]]])
    z = s.zones(kml.placemarks(spark, document(folder("Swimmer zones", placemark("in", line("14.5,35 14.6,35")), placemark("out", line("13.5,35 13.6,35"))))), geo.touches_sea(sea))
    assert [r.zoneName for r in z.collect()] == ["in"]


def test_guards(spark):
    z = s.zones(kml.placemarks(spark, full_map())).cache()
    s.assert_safe(z, 100)
    with pytest.raises(s.UnsafeSnapshot, match="shrank"):
        s.assert_safe(z, 120)
    with pytest.raises(s.UnsafeSnapshot, match="least"):
        s.assert_safe(s.zones(kml.placemarks(spark, full_map(10))), 0)
    with pytest.raises(s.UnsafeSnapshot, match="life-garnija"):
        s.assert_safe(z.filter("layer <> 'life-garnija'"), 0)


def stub(rows):
    """Writes a title and restrictions for every zone but the last ones."""
    return rows.filter("locationLabel <> 'Zone 3'").select("subKey", F.concat(F.lit("New "), "locationLabel").alias("newTitle"), F.lit("Summary.").alias("summary"), F.array(F.lit("No entry")).alias("restrictions"))


def test_import_merges_once(spark):
    at = F.lit(NOW).cast("timestamp_ntz")
    other = ("m", "info", None, "Manual", "d", "manual", None, None, "", None, [], None, NOW, NOW, None, False, [], 1, NOW, NOW)
    before = spark.createDataFrame([other], schemas.NOTICES)
    first, counts = s.run_import(before, kml.placemarks(spark, full_map()), at, enrich=stub)
    first = spark.createDataFrame(first.collect(), schemas.NOTICES)
    assert counts == {"upserted": 64, "deleted": 0, "kept": 0, "enriched": 59} and first.count() == 65
    rows = {r.locationLabel: r for r in first.collect()}
    zone = rows["Zone 5"]
    assert (zone.title, zone.distance, zone.activeFrom, zone.activeTo) == ("New Zone 5", 6.0, dt.datetime(2026, 4, 9), dt.datetime(2026, 9, 30, 23, 59, 59, 999000))
    assert zone.description == "Summary.\n\nRestrictions:\n- No entry" and not zone.needsReview
    assert rows["Zone 3"].reviewReasons == [s.ENRICHMENT_FAILED] and rows["Zone 3"].description == schemas.MAP_LAYERS[0].brief
    assert rows["Wreck"].activeFrom == dt.datetime(2023, 1, 1) and rows["Wreck"].noticeRef == "Notice to Mariners 09 of 2023" and rows["Wreck"].reviewReasons == [s.NO_DESCRIPTION]
    assert rows["Birds"].activeFrom == NOW
    # reports that others counted stay; a second import of the same map writes nothing
    counted = first.withColumn("reports", F.when(F.col("locationLabel") == "Zone 5", 7).otherwise(F.col("reports")))
    later = F.lit(NOW + dt.timedelta(days=1)).cast("timestamp_ntz")
    again, counts = s.run_import(counted, kml.placemarks(spark, full_map()), later, enrich=stub)
    assert (counts["upserted"], counts["deleted"], counts["kept"], counts["enriched"]) == (0, 0, 64, 0)
    assert sorted(map(str, again.collect())) == sorted(map(str, counted.collect()))
    # a zone goes, one changes and loses its end, one comes
    changed = full_map(60, placemark("New one", line())).replace("Zone 0<", "Zone X<").replace("until 30 September 2026. Keep a distance of 6m", "on. Keep a distance of 60m")
    third, counts = s.run_import(counted, kml.placemarks(spark, changed), later, enrich=stub)
    rows = {r.locationLabel: r for r in third.collect()}
    assert (counts["upserted"], counts["deleted"]) == (3, 1) and "Zone 0" not in rows
    assert rows["Zone 5"].reports == 7 and rows["Zone 5"].distance == 60.0 and rows["Zone 5"].activeTo is None and rows["Zone 5"].updatedAt == NOW + dt.timedelta(days=1)


def test_unsafe_imports_raise(spark):
    with pytest.raises(s.UnsafeSnapshot):
        s.run_import(spark.createDataFrame([], schemas.NOTICES), kml.placemarks(spark, full_map(3)), F.lit(NOW).cast("timestamp_ntz"))


def test_tables_swap_whole_versions(spark, tmp_path):
    table = store.Table(spark, str(tmp_path / "t"), "a int, b string")
    assert table.read().count() == 0
    v1 = table.commit(spark.createDataFrame([(1, "x")], "a int, b string"))
    old = table.read()
    v2 = table.commit(spark.createDataFrame([(2, "y"), (3, "z")], "a int, b string"))
    assert v1 != v2 == table.version() and table.read().count() == 2 and old.count() == 1


def test_settings():
    assert config.read({}).zone_import_enabled and config.read({"PORT": " ", "CACHE_TTL_MS": "5", "ZONE_IMPORT_ENABLED": "false"}) == config.Settings(cache_ttl_ms=5, zone_import_enabled=False)
    with pytest.raises(ValueError, match="PORT"):
        config.read({"PORT": "x"})
    with pytest.raises(ValueError, match="ZONE_IMPORT_ENABLED"):
        config.read({"ZONE_IMPORT_ENABLED": "maybe"})
    assert http.kml_url("a b/c").endswith("?mid=a%20b%2Fc&forcekml=1")


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(source)
    schema = spark.read.parquet(source).schema
    stream = events.read_events(spark, source, schema)
    query = events.windowed_counts(stream, "1 day").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == spark.read.parquet(source).count()
    table = store.Table(spark, str(tmp_path / "t"), "id string, reports int")
    table.commit(spark.createDataFrame([("1", 0), ("2", 5)], "id string, reports int"))
    reports = stream.filter("event_type = 'error'").select(F.col("user_id").cast("string").alias("id"))
    events.merge_reports(reports, table, str(tmp_path / "c2")).awaitTermination(120)
    errors = {r.id: r["count"] for r in spark.read.parquet(source).filter("event_type = 'error'").groupBy(F.col("user_id").cast("string").alias("id")).count().collect()}
    assert {r.id: r.reports for r in table.read().collect()} == {"1": errors.get("1", 0), "2": 5 + errors.get("2", 0)}


def test_service(spark, tmp_path):
    import json

    from tidemark.api import Service
    from tidemark.operators import notices as n

    service = Service(spark, str(tmp_path / "db"), clock=lambda: NOW)
    service.add_notice(json.dumps({"kind": "info", "title": "By hand", "description": "d", "activeFrom": "2026-05-01T00:00:00Z", "areas": [{"label": "x", "geometryType": "point", "points": [{"lat": 35.9, "long": 14.5}]}]}))
    page = service.get_notices({"limit": "5"})
    assert [x["title"] for x in page["items"]] == ["By hand"] and not page["hasMore"] and page["items"][0]["boundingCircle"]["radius"] == 0
    id_ = page["items"][0]["id"]
    service.report_notice(id_)
    with pytest.raises(KeyError):
        service.report_notice("nope")
    assert service.flagged()["items"][0]["reports"] == 1
    assert service.notice_metrics()["total"] == 1 and service.manifest()["notices"]["count"] == 1
    assert service.create_report("t", "damn", 1, 1) == {"accepted": False}
    made = service.create_report("t", "d", 1, 1)
    assert [r["id"] for r in service.user_reports()["items"]] == [made["id"]]
    service.resolve_report(made["id"])
    assert service.user_reports()["items"] == []
    with pytest.raises(n.Invalid):
        service.create_report("", "d", 1, 1)
    assert service.zones()["total"] == 1 and len(service.view_logs()["items"]) == 1
    service.dismiss(id_)
    assert service.flagged()["items"] == []


def test_first_import_publishes_in_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(s, "BATCH", 30)
    table = store.Table(spark, str(tmp_path / "t"), schemas.NOTICES)
    seen = []
    real = table.commit
    table.commit = lambda rows: (real(rows), seen.append(table.read().count()))[0]
    spark_map = kml.placemarks(spark, full_map(50))
    counts = s.bootstrap(table, spark_map, F.lit(NOW).cast("timestamp_ntz"))
    assert counts["upserted"] == 54 and seen == [30, 54]
