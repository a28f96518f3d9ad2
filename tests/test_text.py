"""Text functions, one input each, and their edges."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as t


def one(spark, make, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(
    ("make", "value", "want"),
    [
        (t.some, "  a﻿ ", "a"),
        (t.some, "  ", None),
        (t.http_url, "HTTPS://x", "HTTPS://x"),
        (t.http_url, "ftp://x", None),
        (t.yes_no_label, "YES", "Yes"),
        (t.yes_no_label, "N/A", None),
        (t.sentence_label, "ROCKY Beach", "Rocky beach"),
        (t.sentence_label, "n/A", None),
        (t.date_only, "2020-05-06T23:30:00Z", "2020-05-06"),
        (t.date_only, "soon", None),
        (t.parse_number, "", 0.0),
        (t.parse_number, " 0x10 ", 16.0),
        (t.parse_number, "Infinity", None),
        (t.parse_number, "5d", None),
        (t.parse_number, "-1.5e2", -150.0),
        (t.parse_number, ".", None),
        (t.slug, "  Blue Lagoon & Co. ", "blue-lagoon-co"),
        (t.slug, "x" * 130, "x" * 120),
        (t.error_code, " notFound error-2 ", "NOT_FOUND_ERROR_2"),
        (t.display_name, "(1A) Blue Lagoon", "Blue Lagoon"),
        (t.display_name, "(41)", "(41)"),
        (t.zone_name, " Ｂlue   Lagoon ", "Blue Lagoon"),
        (t.plain_source, "<p>a<br>b</p>", "a b"),
        (t.source_url, "see <a>https://x.org/a?b=1).</a> more", "https://x.org/a?b=1"),
        (t.notice_reference, "by Local  Notice to<br>Mariners No. 132 of 2025.", "Local Notice to Mariners No. 132 of 2025"),
        (t.distance_metres, "a distance of 100m", 100.0),
        (t.distance_metres, "a zone of 0.5 NM", 926.0),
        (t.distance_metres, "speed 3 Knots", None),
        (t.distance_metres, "distance of 0 m", None),
        (t.distance_metres, "distance of 100 m, zone of 1 NM", 100.0),
        (t.valid_from, "These restrictions are in place from the 9th of April 2026.", dt.datetime(2026, 4, 9)),
        (t.valid_from, "in place from the 9th of Smarch 2026", None),
        (t.valid_from, "effective from 31 February 2026", None),
        (t.valid_to, "effective from 1 June 2026 until 30 September 2026.", dt.datetime(2026, 9, 30, 23, 59, 59, 999000)),
        (t.notice_date, "Notice to Mariners 09 & 10 of 2023", dt.datetime(2023, 1, 1)),
        (t.notice_date, "Notice to Mariners 1 of 1899", None),
        (t.long_date, None, None),
    ],
)
def test_scalars(spark, make, value, want):
    assert one(spark, make, value) == want


def test_numbers_print_without_a_fraction(spark):
    assert [one(spark, t.number_text, x, "double") for x in (5.0, 1e7, 2.5, -0.5)] == ["5", "10000000", "2.5", "-0.5"]


@pytest.mark.parametrize(("avg", "most", "a", "m", "want"), [(5.0, 30.0, True, True, "5–30+ m"), (5.0, 5.0, True, False, "5 m"), (None, 0.0, False, True, "0+ m"), (2.5, None, True, False, "2.5+ m"), (None, None, True, True, None)])
def test_depth(spark, avg, most, a, m, want):
    row = spark.createDataFrame([(avg, most, a, m)], "avg double, most double, a boolean, m boolean")
    assert row.select(t.depth(F.col("avg"), F.col("most"), F.col("a"), F.col("m")).alias("x")).first().x == want


def test_tags_are_unique_whatever_their_case(spark):
    assert one(spark, t.tags, ["Cave", "", "cave", None, "Reef", "REEF"], "array<string>") == ["Cave", "Reef"]
    assert one(spark, t.tags, [""], "array<string>") is None
    twice = one(spark, lambda c: t.tags(t.tags(c)), ["a", "A", "b"], "array<string>")
    assert twice == ["a", "b"]
    assert one(spark, t.tags_csv, ["a", "b"], "array<string>") == ",a,b," and one(spark, t.tags_csv, None, "array<string>") is None


def test_splits(spark):
    assert tuple(one(spark, t.kind_and_period, "Boating hotspot - Seasonal")) == ("Boating hotspot", "Seasonal")
    assert tuple(one(spark, t.kind_and_period, "A - B - C")) == ("A", "B")
    assert tuple(one(spark, t.kind_and_period, "A")) == ("A", None)
    assert one(spark, t.kind_and_period, None) is None


def test_links_and_videos(spark):
    got = one(spark, t.links, "https://a.b|Label http://c.d ftp://e.f junk https://g.h|")
    assert [tuple(x) for x in got] == [("https://a.b", "Label"), ("http://c.d", None), ("https://g.h", None)]
    assert one(spark, t.video_ids, "abcdef_-1,10,20 x abc") == ["abcdef_-1"]
    assert one(spark, t.links, None) is None


def test_facts_and_descriptions(spark):
    row = spark.createDataFrame([(100.0, dt.datetime(2026, 4, 9), None, "Notice 1 of 2026", " Sum. ", [" a ", " ", "b"])], "d double, f timestamp_ntz, u timestamp_ntz, r string, s string, l array<string>")
    got = row.select(t.fact_lines(*[F.col(c) for c in "dfur"]).alias("x"), t.compose_description(F.col("s"), F.col("l")).alias("y")).first()
    assert got.x == ["Vessels must keep at least 100 m clear.", "In force from 9 April 2026.", "Established by Notice 1 of 2026."]
    assert got.y == "Sum.\n\nRestrictions:\n- a\n- b"


def test_names_that_differ_in_case_and_space_share_a_key(spark):
    keys = {one(spark, lambda c: t.sub_key(F.lit("l"), t.zone_name(c)), x) for x in ("Blue Lagoon", "  blue   lagoon  ")}
    assert len(keys) == 1 and len(keys.pop()) == 22


def test_feature_labels(spark):
    rows = spark.createDataFrame([('{"title":"b","name":""}',), ('{"LABEL":7}',), ("{}",)], "j string").select(t.feature_label(F.parse_json("j")).alias("x"))
    assert [r.x for r in rows.collect()] == ["b", "7", ""]


def test_job_ids(spark):
    assert one(spark, lambda c: t.job_id("daily", c), dt.datetime(2026, 6, 1, 23), "timestamp_ntz") == "daily-2026-06-01"
