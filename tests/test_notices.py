"""Pages, metrics, tokens, served form, validation and changes of notices."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import notices as n

DAY = dt.timedelta(days=1)
NOW = dt.datetime(2026, 6, 1, 12)


def now():
    return F.lit(NOW)


def at(stamp):
    return F.lit(stamp).cast("timestamp_ntz")


AS_OF = "2026-06-01 12:00:00"


def notice(id_, **given):
    base = dict(kind="alert", category=None, title="t", description="d", source="s", noticeRef=None, sourceUrl=None, subKey=str(id_), locationLabel=None, areas=[], distance=None, publishedAt=NOW, activeFrom=NOW - DAY, activeTo=None, needsReview=False, reviewReasons=[], reports=0, createdAt=NOW, updatedAt=NOW)
    return (str(id_), *(base | given).values())


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.NOTICES)


def part(kind, *points):
    return {"label": "x", "geometryType": kind, "points": [{"lat": a, "long": b} for a, b in points]}


def test_active_window_includes_both_ends(spark):
    rows = frame(spark, notice(1, activeFrom=NOW), notice(2, activeTo=NOW), notice(3, activeFrom=NOW + DAY), notice(4, activeTo=NOW - DAY), notice(5))
    assert {r.id for r in rows.filter(n.active(at(AS_OF))).collect()} == {"1", "2", "5"}


def test_an_end_equal_to_now_has_expired_for_the_manifest(spark):
    rows = frame(spark, notice(1, activeTo=NOW), notice(2, activeTo=NOW + DAY), notice(3, activeTo=NOW + 2 * DAY, needsReview=True))
    r = n.manifest(rows, at(AS_OF)).first()
    assert (r["count"], r.next_expiry) == (2, NOW + DAY)
    empty = n.manifest(rows.limit(0), at(AS_OF)).first()
    assert empty["count"] == 0 and empty.updated is None and len(empty.revision) == 64


def test_pages(spark):
    rows = frame(spark, *[notice(i, activeFrom=NOW - DAY * (i % 3)) for i in range(9)])
    page = n.notice_page(rows, n.Page(limit=4, offset=2), at(AS_OF)).collect()
    want = sorted(range(9), key=lambda i: (i % 3, str(i)))[2:7]
    assert [r.id for r in page] == [str(i) for i in want]
    assert n.envelope(page, n.Page(limit=4, offset=2))["hasMore"]
    review = n.notice_page(rows.unionByName(frame(spark, notice("r", needsReview=True, activeTo=NOW - DAY))), n.page_args({}, review=True), at(AS_OF), needs_review=True)
    assert [r.id for r in review.collect()] == ["r"]


def test_page_links_keep_filters():
    links = n.page_links("/x", {"kind": "alert"}, n.Page(limit=10, offset=5), has_more=True)
    assert links == {"prev": "/x?kind=alert&limit=10&offset=0", "next": "/x?kind=alert&limit=10&offset=15"}


@pytest.mark.parametrize("query", [{"limit": "0"}, {"limit": "501"}, {"offset": "-1"}, {"kind": "x"}, {"limit": "a"}, {"activeOnly": "maybe"}, {"other": "1"}])
def test_bad_arguments(query):
    with pytest.raises(n.Invalid):
        n.page_args(query)


def test_argument_defaults():
    assert n.page_args({}) == n.Page(100, 0, None, True)
    assert n.page_args({"limit": "", "kind": ""}, review=True) == n.Page(100, 0, None, False)


def test_metrics_of_the_known_case(spark):
    rows = [("alert", False)] * 5 + [("alert", True)] + [("info", False)] * 4 + [("info", True)] * 2
    live = {("alert", False): 2, ("info", False): 2, ("info", True): 2}
    made = []
    for i, (kind, review) in enumerate(rows):
        left = live.get((kind, review), 0)
        live[(kind, review)] = left - 1
        made.append(notice(i, kind=kind, needsReview=review, activeTo=NOW + DAY if left > 0 else NOW - DAY))
    kinds = spark.createDataFrame([("alert",), ("info",), ("other",)], "kind string")
    got = {r.kind: r for r in n.metrics(frame(spark, *made), kinds, at(AS_OF)).collect()}
    assert [tuple(got["alert"])[1:4], tuple(got["info"])[1:4], tuple(got["other"])[1:]] == [(6, 5, 1), (6, 4, 2), (0, 0, 0, 0, 0)]
    assert sum(r.total for r in got.values()) == 12 and sum(r.public for r in got.values()) == 9
    assert sum(r.active_public for r in got.values()) == 4 and sum(r.active_review for r in got.values()) == 2


def test_served_geometry(spark):
    triangle = part("polygon", (35.9, 14.5), (35.91, 14.51), (35.9, 14.52))
    areas = [part("line", (35.9, 14.5)), triangle, part("point", (35.9, 14.5))]
    r = n.served(frame(spark, notice(1, areas=areas, distance=300.0))).first()
    assert [(f.part, f.geometry.type) for f in r.geometry] == [(1, "Polygon"), (2, "Point")]
    assert r.geometry[0].geometry.coordinates[0] == r.geometry[0].geometry.coordinates[3]
    assert len(r.representativePoints) == 3 and r.representativePoint == r.representativePoints[0]
    assert r.activeFrom == "2026-05-31T12:00:00.000Z" and "reports" not in r.asDict()
    none = n.served(frame(spark, notice(1, areas=[part("line", (35.9, 14.5))]), notice(2))).orderBy("id").collect()
    assert none[0].geometry is None and none[1].boundingCircle is None and none[1].representativePoint is None


def test_circles(spark):
    p, tri = part("point", (35.9, 14.5)), part("polygon", (35.9, 14.5), (35.91, 14.51), (35.9, 14.52))
    rows = frame(spark, notice(1, areas=[p], distance=300.0), notice(2, areas=[p]), notice(3, areas=[tri]), notice(4, areas=[tri], distance=500.0))
    c = {r.id: r.boundingCircle for r in n.served(rows).collect()}
    assert (c["1"].latitude, c["1"].longitude, c["1"].radius) == (35.9, 14.5, 300.0) and c["2"].radius == 0
    assert (round(c["3"].latitude, 6), round(c["3"].longitude, 6)) == (35.905, 14.51) and c["3"].radius > 500 and c["3"] == c["4"]


def test_zone_map(spark):
    areas = [part("point", (35.9, 14.5)), part("line", (1.0, 1.0))]
    rows = frame(spark, notice(1, kind="info", areas=areas), notice(2, areas=areas, source=schemas.ZONE_SOURCE), notice(3))
    zones = n.zone_map(rows)
    assert [(r.noticeId, r.part, r.community) for r in zones.collect()] == [("2", 0, True), ("1", 0, False)]
    assert tuple(n.zone_map_totals(zones).first()) == (2, 1)


def test_reports_are_counted_and_unknown_ids_told(spark):
    rows, unknown = n.count_reports(frame(spark, notice(1, reports=2), notice(2)), spark.createDataFrame([("1",), ("1",), ("9",)], "id string"))
    assert {r.id: r.reports for r in rows.collect()} == {"1": 4, "2": 0} and [r.id for r in unknown.collect()] == ["9"]


def test_accept_reports(spark):
    rows = [("a", " Title ", "d", 35.9, 14.5), ("b", " ", "d", 0.0, 0.0), ("c", "t", "d" * 1001, 0.0, 0.0), ("d", "t", "d", 91.0, 0.0), ("e", "t", "what SHIT!", 0.0, 0.0), ("f", "t", "ｓｈｉｔ", 0.0, 0.0), ("g", "t", "shitake", 0.0, 0.0), ("h", None, "d", 0.0, None)]
    good, bad = n.accept_reports(spark.createDataFrame(rows, "id string, title string, description string, latitude double, longitude double"))
    assert {r.id: r.title for r in good.collect()} == {"a": "Title", "g": "t"}
    assert {r.id for r in bad.collect()} == set("bcdefh")


def test_notices_from_json(spark):
    import json

    ok = {"kind": "alert", "title": "t", "activeFrom": "2026-06-01T00:00:00Z", "areas": json.dumps([{"label": "x", "geometryType": "line", "points": [{"lat": 1, "long": 2}, {"lat": 1, "long": 3}]}]), "distance": ""}
    bad = [ok | {"kind": "x"}, ok | {"color": "red"}, ok | {"title": " "}, ok | {"distance": -1}, ok | {"areas": [{"label": "x", "geometryType": "line", "points": [{"lat": 1, "long": 2}]}]}, ok | {"areas": [{"label": "x", "geometryType": "point", "points": [{"lat": 99, "long": 2}]}]}, ok | {"areas": [{"z": 1, "label": "x", "geometryType": "point", "points": [{"lat": 9, "long": 2}]}]}]
    rows = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate([ok, *bad])] + [(99, "{")], "i int, json string")
    got = {r.i: r for r in n.parse_notices(rows).collect()}
    assert got[0].errors == [] and len(got[0].notice.areas[0].points) == 2 and got[0].notice.distance is None
    assert [got[i].errors for i in range(1, 8)] == [["kind"], ["unknown name"], ["title"], ["distance"], ["areas"], ["areas"], ["unknown name"]]
    assert "json" in got[99].errors


def test_changes_by_hand(spark):
    rows = frame(spark, notice(1, needsReview=True, reviewReasons=["x"], reports=3), notice(2, reports=5))
    r = {x.id: x for x in n.approve(rows, "1").collect()}
    assert not r["1"].needsReview and r["1"].reviewReasons == [] and r["2"].reports == 5
    assert {x.id: x.reports for x in n.dismiss(rows, "2").collect()} == {"1": 3, "2": 0}
    assert [x.id for x in n.remove(rows, "1").collect()] == ["2"]
    with pytest.raises(KeyError):
        n.approve(rows, "9")
    reports = spark.createDataFrame([("1", "t", "d", 1.0, 1.0, True, NOW, NOW)], schemas.USER_REPORTS)
    assert n.resolve(reports, "1").first().resolved


def test_adding_a_notice_is_logged_and_keys_are_unique(spark):
    rows, logs = frame(spark, notice(1)), spark.createDataFrame([], schemas.LOGS)
    made = frame(spark, notice(2, subKey="new")).drop("id", "needsReview", "reviewReasons", "reports", "createdAt", "updatedAt")
    more, lines = n.add(rows, made, logs, at(AS_OF))
    assert more.count() == 2 and [r.description for r in lines.collect()] == ["Notice added: t"]
    with pytest.raises(n.Invalid):
        n.add(more, made, logs, at(AS_OF))


def test_log_retention(spark):
    rows = spark.createDataFrame([(1, "info", "a", NOW - 14 * DAY), (2, "info", "b", NOW - 15 * DAY)], schemas.LOGS)
    assert [r.id for r in n.retained(rows, at(AS_OF)).collect()] == [1]
    assert [r.id for r in n.logs_page(n.log(rows, "c", at(AS_OF)), limit=1).collect()] == [None, 1]
