"""Served forms, validation, zone facts, guards and sources bound to customer, orders, part, supplier, nation and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas, session
from tidemark.functions import geo, text
from tidemark.operators import adapters, catalog, classification, refresh, snapshot
from tidemark.operators import notices as n
from tidemark.plans import layers, zones
from tidemark.plans import notices as bound
from tidemark.sources import geojson, kml, reports

def _point(lat, long):
    return F.struct(lat.cast("double").alias("lat"), long.cast("double").alias("long"))


def _part(kind: str, *points):
    return F.struct(F.lit("x").alias("label"), F.lit(kind).alias("geometryType"), F.array(*points).alias("points"))


def drawn_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as notices: a point, a level line, a rectangle or an L, and for every fifth a line of one point, which can't be drawn."""
    c, k = spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("c_custkey")
    at = lambda lat, long: _point(k % 30 + lat, k % 70 + long)
    box, bent = [(0, 0), (0, 4), (2, 4), (2, 0)], [(0, 0), (0, 4), (1, 4), (1, 1), (4, 1), (4, 0)]
    ring = F.when(k % 2 == 0, _part("polygon", *[at(*p) for p in box])).otherwise(_part("polygon", *[at(*p) for p in bent]))
    areas = F.array(_part("point", _point(k % 50, k % 100)), _part("line", _point(k % 40, k % 60), _point(k % 40, k % 60 + 2)), ring)
    short = F.array(_part("line", _point(k % 20, k % 20)))
    none = F.lit(None).cast("string")
    day = F.lit("1997-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval((k % 90).cast("int"))
    return c.select(
        k.cast("string").alias("id"), F.when(k % 3 == 0, "alert").otherwise("info").alias("kind"), F.col("c_mktsegment").alias("category"), F.col("c_name").alias("title"), F.lit("d").alias("description"),
        F.when(k % 4 == 0, schemas.ZONE_SOURCE).otherwise("manual").alias("source"), none.alias("noticeRef"), none.alias("sourceUrl"), k.cast("string").alias("subKey"), none.alias("locationLabel"),
        F.when(k % 5 == 0, F.concat(areas, short)).otherwise(areas).alias("areas"), (k % 3).cast("double").alias("distance"), day.alias("publishedAt"), day.alias("activeFrom"), none.cast("timestamp_ntz").alias("activeTo"),
        F.lit(False).alias("needsReview"), F.array().cast("array<string>").alias("reviewReasons"), (k % 7).cast("int").alias("reports"), day.alias("createdAt"), day.alias("updatedAt"),
    )


def served_notices(spark, sf_dir):
    """The form for the public and for the administrator: parts that can be drawn, anchors, the circle's middle, reports."""
    rows = n.served_flagged(drawn_notices(spark, sf_dir))
    whole = lambda x: x.cast("int").cast("string")
    anchors = F.array_join(F.transform("representativePoints", lambda a: F.concat(whole(a["latitude"]), F.lit(","), whole(a["longitude"]))), ";")
    first = F.concat(whole(F.col("representativePoint.latitude")), F.lit(","), whole(F.col("representativePoint.longitude")))
    return rows.select("id", "activeFrom", "reports", F.size("geometry").alias("drawn"), anchors.alias("anchors"), first.alias("anchor"), F.col("boundingCircle.latitude").alias("middle_lat"), F.col("boundingCircle.longitude").alias("middle_long"))


def zone_map(spark, sf_dir):
    """One row for each part that can be drawn."""
    return n.zone_map(drawn_notices(spark, sf_dir)).select("noticeId", "part", F.col("geometry.type").alias("type"), "kind", "community", "reports")


def zone_map_totals(spark, sf_dir):
    return n.zone_map_totals(n.zone_map(drawn_notices(spark, sf_dir)))


def refused_reports(spark, sf_dir):
    """Documents as reports: those refused for what is wrong with them, or for their words."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text_ = F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("What a DAMN "), F.substring("text", 1, 50))).otherwise(F.col("text"))
    rows = d.select("doc_id", F.col("source").alias("title"), text_.alias("description"), F.lit(1.0).alias("latitude"), (F.col("doc_id") % 400 - 200).cast("double").alias("longitude"))
    _, bad = n.accept_reports(rows)
    return bad.select("doc_id", F.array_join("errors", ",").alias("errors"), "swears")


def parsed_notices(spark, sf_dir):
    """Orders as notices in JSON, seven of eight of them wrong in some way."""
    o, k = spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("o_orderkey") % 8
    kind, title = F.when(k == 1, "rumour").otherwise("alert"), F.when(k == 2, " ").otherwise(F.concat(F.lit(" Order "), F.col("o_orderkey").cast("string")))
    extra = (
        F.when(k == 3, ',"colour":"red"')
        .when(k == 4, ',"areas":"[{\\"geometryType\\":\\"point\\",\\"points\\":[{\\"lat\\":1,\\"long\\":2,\\"height\\":3}]}]"')
        .when(k == 5, ',"areas":[{"geometryType":"point","points":[{"lat":95,"long":2}]}]')
        .when(k == 6, ',"distance":"-1"')
        .otherwise(',"areas":[{"geometryType":"line","points":[{"lat":1,"long":2},{"lat":2,"long":2}]}],"distance":""')
    )
    json = F.concat(F.lit('{"kind":"'), kind, F.lit('","title":"'), title, F.lit('","activeFrom":"1997-01-01T00:00:00Z"'), extra, F.when(k == 7, "").otherwise("}"))
    done = n.parse_notices(o.select("o_orderkey", json.alias("json")))
    return done.select("o_orderkey", F.array_join("errors", ",").alias("errors"), F.col("notice.title").alias("title"), F.size("notice.areas").alias("areas"))


def moderated_notices(spark, sf_dir):
    """Orders as notices: one is approved, one's reports are dismissed, one is removed."""
    rows = bound.notices(spark, sf_dir).select("id", "kind", F.lit(True).alias("needsReview"), F.array(F.lit("why")).alias("reviewReasons"), (F.col("id") % 9).cast("int").alias("reports"))
    done = n.remove(n.dismiss(n.approve(rows, 10), 11), 12)
    return done.select("id", "needsReview", F.size("reviewReasons").alias("reasons"), "reports")


def resolved_reports(spark, sf_dir):
    rows = bound.logs(spark, sf_dir).select("id", (F.col("logType") == "signup").alias("resolved"))
    return n.remove(n.resolve(rows, 5), 6)


def _added(spark, sf_dir):
    stored = drawn_notices(spark, sf_dir)
    none = F.lit(None).cast("string")
    made = spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        F.lit("info").alias("kind"), none.alias("category"), F.col("n_name").alias("title"), F.lit("d").alias("description"), F.lit("by hand").alias("source"), none.alias("noticeRef"), none.alias("sourceUrl"), F.col("n_nationkey").cast("string").alias("subKey"),
        none.alias("locationLabel"), F.array().cast(schemas.AREAS).alias("areas"), F.lit(None).cast("double").alias("distance"), none.cast("timestamp_ntz").alias("publishedAt"), F.lit("1997-02-03 04:05:06").cast("timestamp_ntz").alias("activeFrom"), none.cast("timestamp_ntz").alias("activeTo"),
    )
    now = F.lit(zones.NOW).cast("timestamp_ntz")
    return n.add(stored, made, n.log(bound.logs(spark, sf_dir), "begun", now, "note"), now)


def added_notices(spark, sf_dir):
    """Nations as notices made by hand, beside the customers'."""
    return _added(spark, sf_dir)[0].select("source", "subKey", "title", "needsReview", "reports", "publishedAt", F.length("id").alias("id_chars"))


def added_logs(spark, sf_dir):
    return _added(spark, sf_dir)[1].select("id", "logType", "description", "createdAt")


# Zones.


def _snapshot(spark, sf_dir):
    """Parts as zones with texts of four kinds."""
    p, k = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_partkey")
    number = k.cast("string")
    described = (
        F.when(k % 4 == 0, F.concat(F.lit("Effective from 1 June 2026 until 30 September 2026. Keep a distance of "), (k % 500 + 1).cast("string"), F.lit(" m.")))
        .when(k % 4 == 1, F.concat(F.lit("Local Notice to Mariners 9 of 2023.<br>See https://example.org/"), number, F.lit(".")))
        .when(k % 4 == 2, "")
        .otherwise("A zone of 2 NM applies.")
    )
    line = F.array(F.struct(F.lit("line").alias("type"), F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((1.0, 2.0), (3.0, 4.0))]).alias("points")))
    keys = F.array(*[F.lit(x.key) for x in schemas.MAP_LAYERS])
    return p.select(
        F.element_at(keys, (k % 5 + 1).cast("int")).alias("layer"), F.concat(F.when(k % 3 == 0, "(1A) ").otherwise(""), F.lit("Zone "), number).alias("zoneName"), number.alias("subKey"), line.alias("geometries"),
        described.alias("sourceDescription"), F.when(k % 2 == 0, "Folder of Notice to Mariners 3 of 2021").otherwise("Folder").alias("folderName"),
    )


def _facts(spark, sf_dir, stored):
    return snapshot.facts(_snapshot(spark, sf_dir), stored, F.lit(zones.NOW).cast("timestamp_ntz"))


def zone_facts(spark, sf_dir):
    """What the texts of zones state, and what is taken from the notices stored for them."""
    rows = _facts(spark, sf_dir, zones._as_notices(spark, sf_dir, zones.BEFORE))
    parts = F.transform("areas", lambda a: F.concat_ws(":", a["label"], a["geometryType"], F.size(a["points"]).cast("string")))
    return rows.select("subKey", "kind", "category", "title", "distance", "noticeRef", "sourceUrl", "activeFrom", "activeTo", "publishedAt", "needsReview", F.array_join("factLines", "|").alias("lines"), F.array_join(parts, ",").alias("parts"))


def zone_descriptions(spark, sf_dir):
    """Descriptions after an import: kept where nothing has changed, written anew for every second zone, else the fallback."""
    k = F.col("subKey").cast("long")
    empty = spark.createDataFrame([], schemas.NOTICES)
    before = _facts(spark, sf_dir, empty).filter(k % 3 == 0)
    stored = before.withColumns({"id": F.col("subKey"), "description": F.lit("Old.\n\nRestrictions:\n- one"), "title": F.lit("Old"), "distance": F.when(k % 9 == 0, F.col("distance") + 1).otherwise(F.col("distance")), "reports": F.lit(0), "createdAt": F.col("activeFrom"), "updatedAt": F.col("activeFrom")})

    def enrich(rows):
        return rows.filter(k % 2 == 0).select("subKey", F.concat(F.lit(" New "), "locationLabel").alias("newTitle"), F.lit("Sum.").alias("summary"), F.array(F.lit("a"), F.lit(" "), F.lit("b")).alias("restrictions"))

    done = snapshot.describe(_facts(spark, sf_dir, stored.select(*empty.columns)), enrich)
    return done.select("subKey", "title", F.md5("description").alias("description_md5"), "needsReview", F.array_join("reviewReasons", ",").alias("reasons"), "usedEnrichment")


def importable_shapes(spark, sf_dir):
    """How many shapes of a placemark are imported: points only of layers with named points, and not those of corner markers."""
    shape = lambda kind: F.struct(F.lit(kind).alias("type"), F.array(F.struct(F.lit(1.0).alias("lon"), F.lit(1.0).alias("lat"))).alias("points"))
    rows = _snapshot(spark, sf_dir).withColumn("shapes", F.array(shape("point"), shape("line"), shape("point")))
    return rows.select("subKey", F.size(snapshot.importable(F.col("layer"), F.col("zoneName"), F.col("shapes"))).alias("shapes"))


def import_counts(spark, sf_dir):
    """What an import did, as one row."""
    new = zones._as_notices(spark, sf_dir, zones.AFTER).filter("CAST(subKey AS BIGINT) % 11 <> 0")
    merged = snapshot.merge(zones._as_notices(spark, sf_dir, zones.BEFORE), new, F.lit(zones.NOW).cast("timestamp_ntz"))
    counts = snapshot.import_summary(merged, new.withColumn("usedEnrichment", F.col("distance").isNotNull()))
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{c} long" for c in counts))


# Layers.


def anchoring_adapter(spark, sf_dir):
    """Parts as anchoring hotspots."""
    p, k = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_partkey")
    props = layers._variant(
        text=F.col("p_name"), description=F.when(k % 2 == 0, F.concat("p_brand", F.lit(" - "), "p_type", F.lit(" - x"))).otherwise(F.col("p_brand")), CharacterString=F.lit(" Authority "),
        beginLifespanVersion=F.when(k % 5 == 0, "soon").otherwise("2020-01-02T03:04:05"), localId=F.when(k % 3 != 0, k.cast("string")), gml_id=F.lit("gml"), identifier=F.concat(F.when(k % 4 == 0, "HTTPS://x.org/").otherwise("urn:x:"), k.cast("string")),
    )
    rows = p.select("p_partkey", adapters.anchoring_hotspot(props).alias("s"))
    return rows.select("p_partkey", *layers._flat("s"), F.col("s.sourceUrl").alias("source_url"))


def bunkering_adapter(spark, sf_dir):
    """Parts as bunkering areas."""
    p, k = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_partkey")
    props = layers._variant(name=F.when(k % 2 == 0, F.concat(F.lit("Bunkering AREA "), k.cast("string"), F.lit(" north"))), localId=F.when(k % 5 != 0, F.concat(F.lit("id_"), k.cast("string"))), gml_id=F.lit("gml"), description=F.col("p_type"))
    rows = p.select("p_partkey", adapters.bunkering_area(props).alias("s"))
    return rows.select("p_partkey", *layers._flat("s"))


def label_functions(spark, sf_dir):
    """Names, codes, lists and dates of parts through the functions for labels."""
    p, k = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_partkey")
    number = k.cast("string")
    links = text.links(F.concat(F.lit("https://a.org/"), number, F.lit("|Label ftp://x HTTP://b.org |c")))
    parts = text.kind_and_period(F.concat("p_brand", F.lit("  -\t"), "p_type", F.lit(" - x")))
    props = F.parse_json(F.concat(F.lit('{"name":"","title":'), F.when(k % 2 == 0, "0").otherwise('"t"'), F.lit(',"Name":"'), number, F.lit('"}')))
    return p.select(
        "p_partkey", text.display_name(F.when(k % 11 == 0, "(1A)").otherwise(F.concat(F.lit("(1A) "), "p_name"))).alias("display"), text.error_code(F.concat(F.lit(" badRequest value-"), number)).alias("code"),
        text.job_id("sync", F.lit("1997-06-01 12:00:00").cast("timestamp_ntz")).alias("job"), text.rounded(k / 7).alias("rounded"), F.array_join(text.video_ids(F.concat(F.lit("abcdef_"), number, F.lit(",10,20 short  zzzzzz-9"))), ",").alias("videos"),
        F.array_join(F.transform(links, lambda x: F.concat_ws("=", x["url"], x["label"])), ";").alias("links"), parts["kind"].alias("kind"), parts["period"].alias("period"), text.date_only(F.when(k % 2 == 0, "2024-03-05T10:00:00").otherwise("junk")).alias("day"),
        text.first_text(F.lit(""), F.lit(None).cast("string"), F.col("p_name")).alias("first"), text.feature_label(props).alias("label"), text.long_date(F.lit("2024-03-05").cast("date")).alias("long_date"),
    )


#: Geometries by kind of case: valid ones of four types, then outside the bounds, too short, not closed, of another type.
SHAPES = (
    '{"type":"Point","coordinates":[X,35]}', '{"type":"LineString","coordinates":[[X,35],[15,36]]}', '{"type":"Polygon","coordinates":[[[X,35],[15,36],[X,36],[X,35]]]}', '{"type":"MultiPoint","coordinates":[[X,35],[15,36]]}',
    '{"type":"Point","coordinates":[X00,35]}', '{"type":"LineString","coordinates":[[X,35]]}', '{"type":"Polygon","coordinates":[[[X,35],[15,36],[X,36],[15,35]]]}', '{"type":"GeometryCollection","coordinates":[]}',
)


def valid_geometries(spark, sf_dir):
    """Which geometries can be served, and the boxes of those."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    shape = F.element_at(F.array(*[F.lit(x) for x in SHAPES]), (F.col("vec_id") % 8 + 1).cast("int"))
    g = F.parse_json(F.replace(shape, F.lit("X"), (F.col("vec_id") % 2 + 13).cast("string")))
    rows = e.select("vec_id", geo.valid_geometry(g).alias("valid"), geo.bbox(geo.positions(g)).alias("box"))
    return rows.select("vec_id", "valid", *[F.when(F.col("valid"), F.get("box", i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))], F.when(F.col("valid"), geo.box_within(F.col("box"))).alias("inside"))


def _layer(spark, sf_dir):
    """Suppliers as a file of beaches, read back: a layer is one file."""
    s, k = spark.read.parquet(f"{sf_dir}/supplier.parquet"), F.col("s_suppkey")
    number = k.cast("string")
    names = F.when(k % 7 == 0, "{}").otherwise(F.concat(F.lit('{"Name_ENG":"'), F.col("s_name"), F.lit('","Site_Code":"b '), number, F.lit('"}')))
    shape = F.when(k % 10 == 0, "null").otherwise(F.concat(F.lit('{"type":"Point","coordinates":['), (k % 3 + 13).cast("string"), F.lit(",35]}")))
    feature = F.concat(F.lit('{"type":"Feature","geometry":'), shape, F.lit(',"properties":'), names, F.lit("}"))
    every = s.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, feature.alias("f")))), lambda x: x["f"]), ",").alias("fs"))
    path = session.shared_path(spark, "layer")
    every.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "fs", F.lit("]}"))).write.text(path)
    found, failed = geojson.read_layers(spark, {schemas.BEACHES: path, "none": f"{path}/none"})
    assert set(failed) == {"none"}
    return geojson.features(found)


def layer_normalized(spark, sf_dir):
    """Features of a layer's file: served ones with their ids and codes, the others with the reason."""
    dataset = next(d for d in schemas.DATASETS if d.key == schemas.BEACHES)
    rows = catalog.normalize(_layer(spark, sf_dir), dataset)
    return rows.select("feature_idx", "reason", "id", "title", "site_code", "geometryType", F.get("bbox", 0).alias("x"))


def layer_summary(spark, sf_dir):
    dataset = next(d for d in schemas.DATASETS if d.key == schemas.BEACHES)
    s = catalog.summary(catalog.normalize(_layer(spark, sf_dir), dataset))
    return s.select("dataset_key", "feature_count", F.array_join("geometry_types", ",").alias("types"), F.size("site_codes").alias("codes"), F.get("bbox", 0).alias("x0"), F.get("bbox", 2).alias("x1"))


def kml_placemarks(spark, sf_dir):
    """Nations as placemarks of a map with a folder for each region, written to a file and read back."""
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    k = F.col("n_nationkey")
    at = lambda x, y: F.concat(x.cast("string"), F.lit(","), y.cast("string"), F.lit(",0"))
    line = F.concat(F.lit("<LineString><coordinates> "), at(k, F.lit(1)), F.lit("\n"), at(k + 1, F.lit(2)), F.lit(" </coordinates></LineString>"))
    shapes = F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.lit("<Point><coordinates>"), at(k, F.lit(3)), F.lit("</coordinates></Point>"))).when(k % 4 == 2, line).otherwise(F.concat(F.lit("<MultiGeometry>"), line, line, F.lit("</MultiGeometry>")))
    mark = F.concat(F.lit("<Placemark><name> "), F.col("n_name"), F.lit(" </name><description>of &lt;b&gt;"), F.col("r_name"), F.lit("</description>"), shapes, F.lit("</Placemark>"))
    rows = nation.join(region, nation.n_regionkey == region.r_regionkey).select("r_regionkey", "r_name", k, mark.alias("m"))
    marks = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "m"))), lambda x: x["m"]), "")
    folders = rows.groupBy("r_regionkey", "r_name").agg(marks.alias("m")).select("r_regionkey", F.concat(F.lit("<Folder><name>"), "r_name", F.lit("</name>"), "m", F.lit("</Folder>")).alias("f"))
    whole = folders.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", "f"))), lambda x: x["f"]), "").alias("fs"))
    path = session.shared_path(spark, "map")
    whole.select(F.concat(F.lit("<kml><Document>"), "fs", F.lit("</Document></kml>"))).write.text(path)
    got = kml.read(spark, path)
    return got.select("folder_idx", "placemark_idx", "folder", "name", "description", F.size("geometries").alias("shapes"), F.col("geometries")[0]["type"].alias("type"), F.size(F.col("geometries")[0]["points"]).alias("points"), F.col("geometries")[0]["points"][0]["lon"].alias("lon"))


def context_check(spark, sf_dir):
    """What keeps a layer of context from being served: nothing, one bad feature, no features."""
    dataset = next(d for d in schemas.DATASETS if d.kind == "context")
    e = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.lit(dataset.key).alias("dataset_key"), F.col("n_nationkey").alias("feature_idx"), F.lit("Feature").alias("type"), F.parse_json(F.lit('{"a":1}')).alias("properties"))
    shape = lambda i: F.parse_json(F.lit(SHAPES[i].replace("X", "14")))
    good, bad = e.withColumn("geometry", shape(1)), e.withColumn("geometry", F.when(F.col("feature_idx") < 9, shape(2)).otherwise(shape(6)))
    cases = {"good": good, "bad": bad, "none": good.filter("false"), "untyped": good.withColumn("type", F.lit("Shape"))}
    return spark.createDataFrame([(name, catalog.context_error(rows, dataset)) for name, rows in cases.items()], "name string, error string")


def import_guards(spark, sf_dir):
    """What the guards of imports say about tables of other sizes."""
    rows = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    beaches = next(d for d in schemas.DATASETS if d.key == schemas.BEACHES)
    found, parts = zones.layer_match(spark, sf_dir), rows("part").count()
    codes = layers._classes(spark, sf_dir)
    known = rows("documents").select((F.col("doc_id") + 37).cast("string").alias("siteCode"))
    checks = {
        "refresh": lambda: catalog.assert_refresh(beaches, rows("supplier").count(), rows("customer").count()),
        "first refresh": lambda: catalog.assert_refresh(beaches, rows("customer").count(), None),
        "snapshot": lambda: snapshot.assert_safe(found, parts, zones.PART_LAYERS),
        "first snapshot": lambda: snapshot.assert_safe(found, 0, zones.PART_LAYERS),
        "layer": lambda: snapshot.assert_safe(found.filter("layer <> 'bolts'"), 0, zones.PART_LAYERS),
        "report": lambda: reports.assert_enough(layers.report_sites(spark, sf_dir), 10_000),
        "classes": lambda: classification.assert_overlap(codes, known),
        "all classes": lambda: classification.assert_overlap(codes, known.filter("CAST(siteCode AS BIGINT) < 60"), 1.0),
        "adapter": lambda: catalog.normalize(None, next(d for d in schemas.DATASETS if d.kind == "context")),
    }
    out = []
    for name, check in checks.items():
        try:
            check()
            out.append((name, None))
        except ValueError as e:
            out.append((name, str(e)))
    return spark.createDataFrame(out, "name string, error string")


VIEWED = "1998-08-02T12:00:00"


def date_views(spark, sf_dir):
    """Days of orders, written in six ways, as views show them on a fixed day."""
    o, k = spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    written = F.when(k % 6 == 0, day).when(k % 6 == 1, F.concat(day, F.lit("T11:59:30.250"))).when(k % 6 == 2, F.concat(day, F.lit("T23:30:00+02:00"))).when(k % 6 == 3, F.concat(day, F.lit(" noon"))).when(k % 6 == 4, "")
    # every seventh is near the fixed day
    near = F.concat(F.lit("1998-08-0"), (k % 4 + 1).cast("string"), F.lit("T12:0"), (k % 10).cast("string"), F.lit(":01Z"))
    at, now = F.when(k % 7 == 0, near).otherwise(written), F.lit(VIEWED).cast("timestamp")
    return o.select("o_orderkey", text.view_date(at).alias("shown"), text.view_relative(at, now).alias("since"), text.datetime_local(at).alias("field"))


def layer_refresh(spark, sf_dir):
    """Customers as layers: a fetched text that passes or fails in eight ways against a stored one that is the same, another, damaged or absent."""
    c, k = spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("c_custkey")
    shape = lambda g, kind="Feature": f'{{"type":"{kind}","geometry":{g},"properties":{{"n":"N"}}}}'
    point, line = '{"type":"Point","coordinates":[X,35]}', '{"type":"GeometryCollection","geometries":[{"type":"LineString","coordinates":[[X,36],[15,36.5]]}]}'
    of = lambda *fs: f'{{"type":"FeatureCollection","bbox":[1],"name":"N","features":[{",".join(fs)}]}}'
    texts = (of(shape(point), shape(line)), of(shape(point)), None, '{"type":"Point"}', of(), of(shape(point), shape(point, "Thing")), of(shape(point), shape("null")), of(shape(line), shape(point.replace("X", "X00"))))
    filled = lambda x: F.replace(F.replace(x, F.lit("X"), (k % 2 + 13).cast("string")), F.lit("N"), k.cast("string"))
    raw = filled(F.element_at(F.array(*[F.lit(x) for x in texts]), (k % 8 + 1).cast("int")))
    old = F.when(k % 5 == 1, "{").when(k % 3 == 0, filled(F.lit(of(shape(line))))).otherwise(F.regexp_replace(raw, '"(features|name)":', '"$1" : '))
    bounds = F.array(*[F.lit(x) for x in geo.BOUNDS]).alias("bounds")
    key = k.cast("string").alias("dataset_key")
    found = refresh.compared(c.select(key, raw.alias("raw"), bounds), c.filter(k % 5 != 0).select(key, old.alias("raw"), bounds).filter("raw IS NOT NULL"))
    return found.select("dataset_key", "state", "error", F.col("next.feature_count").alias("features"), *[F.get("next.bbox", i).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))], F.col("current.feature_count").alias("old_features"))


QUERIES = {
    f.__name__: f
    for f in (
        served_notices, zone_map, zone_map_totals, refused_reports, parsed_notices, moderated_notices, resolved_reports, added_notices, added_logs, zone_facts, zone_descriptions, importable_shapes, import_counts,
        anchoring_adapter, bunkering_adapter, label_functions, valid_geometries, layer_normalized, layer_summary, kml_placemarks, context_check, import_guards, date_views, layer_refresh,
    )
}
_layers = [x.key for x in schemas.MAP_LAYERS]
_named = [x.key for x in schemas.MAP_LAYERS if x.named_points]
_first_context = next(d.key for d in schemas.DATASETS if d.kind == "context")
SNAPSHOT = f"""(SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS "subKey", {_layers}[p_partkey % 5 + 1] AS layer, 'Zone ' || p_partkey AS label, p_partkey % 3 = 0 AS marked,
  CASE WHEN p_partkey % 4 = 0 THEN CAST(p_partkey % 500 + 1 AS DOUBLE) WHEN p_partkey % 4 = 3 THEN 3704.0 END AS distance,
  CASE WHEN p_partkey % 4 = 1 THEN 'Local Notice to Mariners 9 of 2023' WHEN p_partkey % 2 = 0 THEN 'Notice to Mariners 3 of 2021' END AS ref, p_partkey % 4 = 0 AS seasonal FROM part)"""
_stale = "(k % 3 <> 0 OR (k % 9 = 0 AND distance IS NOT NULL))"
_made = f"({_stale} AND k % 2 = 0 AND k % 4 <> 2)"
ORACLES = {
    "served_notices": """
WITH a AS (SELECT c_custkey AS k, c_custkey % 5 = 0 AS short, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 4 END AS tall FROM customer),
b AS (SELECT *, list_concat([k % 50, k % 40, k % 30, k % 30 + tall], CASE WHEN short THEN [k % 20] ELSE [] END) AS lat, list_concat([k % 100, k % 60, k % 60 + 2, k % 70, k % 70 + 4], CASE WHEN short THEN [k % 20] ELSE [] END) AS long FROM a)
SELECT CAST(k AS VARCHAR) AS id, strftime(TIMESTAMP '1997-01-01' + to_days(CAST(k % 90 AS INT)), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS "activeFrom", CAST(k % 7 AS INT) AS reports, 3 AS drawn, (k % 50) || ',' || (k % 100) AS anchor,
  concat_ws(';', (k % 50) || ',' || (k % 100), (k % 40) || ',' || (k % 60 + 1), (k % 30 + 1) || ',' || (k % 70 + CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END), CASE WHEN short THEN (k % 20) || ',' || (k % 20) END) AS anchors,
  (list_min(lat) + list_max(lat)) / 2 AS middle_lat, (list_min(long) + list_max(long)) / 2 AS middle_long FROM b""",
    "zone_map": f"""SELECT CAST(c_custkey AS VARCHAR) AS "noticeId", CAST(part AS INT) AS part, type, CASE WHEN c_custkey % 3 = 0 THEN 'alert' ELSE 'info' END AS kind, c_custkey % 4 = 0 AS community, CAST(c_custkey % 7 AS INT) AS reports
FROM customer, (VALUES (0, 'Point'), (1, 'LineString'), (2, 'Polygon')) x(part, type)""",
    "zone_map_totals": "SELECT count(*) AS total, count(*) FILTER (WHERE c_custkey % 4 = 0) AS community FROM customer",
    "refused_reports": f"""SELECT doc_id, errors, swears FROM (SELECT doc_id, concat_ws(',', CASE WHEN coalesce(length(trim(d, ' ' || chr(9) || chr(10) || chr(13))), 0) NOT BETWEEN 1 AND 1000 THEN 'description' END, CASE WHEN doc_id % 400 - 200 < -180 OR doc_id % 400 - 200 > 180 THEN 'longitude' END) AS errors,
  regexp_matches(lower(concat_ws(chr(10), source, d)), '(^|[^a-z0-9])({"|".join(schemas.SWEAR_WORDS)})($|[^a-z0-9])') AS swears
  FROM (SELECT doc_id, source, CASE WHEN doc_id % 13 = 0 THEN 'What a DAMN ' || left(text, 50) ELSE text END AS d FROM documents)) WHERE errors <> '' OR swears""",
    "parsed_notices": """SELECT o_orderkey, ['', 'kind', 'title', 'unknown name', 'unknown name', 'areas', 'distance', 'json,kind,title,activeFrom'][o_orderkey % 8 + 1] AS errors, CASE WHEN o_orderkey % 8 NOT IN (2, 7) THEN 'Order ' || o_orderkey END AS title,
  [1, 1, 1, 0, 1, 1, 0, 0][o_orderkey % 8 + 1] AS areas FROM orders""",
    "moderated_notices": "SELECT o_orderkey AS id, o_orderkey <> 10 AS \"needsReview\", CASE WHEN o_orderkey = 10 THEN 0 ELSE 1 END AS reasons, CAST(CASE WHEN o_orderkey = 11 THEN 0 ELSE o_orderkey % 9 END AS INT) AS reports FROM orders WHERE o_orderkey <> 12",
    "resolved_reports": "SELECT event_id AS id, event_type = 'signup' OR event_id = 5 AS resolved FROM events WHERE event_id <> 6",
    "added_notices": """SELECT CASE WHEN c_custkey % 4 = 0 THEN 'community-map' ELSE 'manual' END AS source, CAST(c_custkey AS VARCHAR) AS "subKey", c_name AS title, false AS "needsReview", CAST(c_custkey % 7 AS INT) AS reports,
  TIMESTAMP '1997-01-01' + to_days(CAST(c_custkey % 90 AS INT)) AS "publishedAt", CAST(length(CAST(c_custkey AS VARCHAR)) AS INT) AS id_chars FROM customer
UNION ALL SELECT 'by hand', CAST(n_nationkey AS VARCHAR), n_name, false, 0, TIMESTAMP '1997-02-03 04:05:06', 36 FROM nation""",
    "added_logs": f"""SELECT event_id AS id, event_type AS "logType", props AS description, ts AS "createdAt" FROM events UNION ALL SELECT NULL, 'note', 'begun', TIMESTAMP '{zones.NOW}'
UNION ALL SELECT NULL, 'info', 'Notice added: ' || n_name, TIMESTAMP '{zones.NOW}' FROM nation""",
    "zone_facts": f"""
WITH s AS (SELECT s.*, o.o_orderdate AS prior, CASE WHEN seasonal THEN TIMESTAMP '2026-06-01' WHEN k % 4 = 1 THEN TIMESTAMP '2023-01-01' WHEN k % 2 = 0 THEN TIMESTAMP '2021-01-01' ELSE coalesce(o.o_orderdate, TIMESTAMP '{zones.NOW}') END AS start
  FROM {SNAPSHOT} s LEFT JOIN {zones._cut(zones.BEFORE)} o ON o.o_custkey = s.k)
SELECT "subKey", 'alert' AS kind, layer AS category, label AS title, distance, ref AS "noticeRef", CASE WHEN k % 4 = 1 THEN 'https://example.org/' || k END AS "sourceUrl", start AS "activeFrom", CASE WHEN seasonal THEN TIMESTAMP '2026-09-30 23:59:59.999' END AS "activeTo",
  coalesce(prior, start) AS "publishedAt", false AS "needsReview", label || ':line:2' AS parts,
  concat_ws('|', 'Vessels must keep at least ' || CAST(distance AS BIGINT) || ' m clear.', CASE WHEN seasonal THEN 'In force from 1 June 2026 until 30 September 2026.' END, 'Established by ' || ref || '.') AS lines FROM s""",
    "zone_descriptions": f"""
SELECT "subKey", CASE WHEN NOT {_stale} THEN 'Old' WHEN {_made} THEN 'New ' || label ELSE label END AS title, {_made} AS "usedEnrichment", {_stale} AND NOT {_made} AS "needsReview",
  md5(CASE WHEN {_made} THEN 'Sum.' || chr(10) || chr(10) || 'Restrictions:' || chr(10) || '- a' || chr(10) || '- b' WHEN k % 3 = 0 THEN 'Old.' || chr(10) || chr(10) || 'Restrictions:' || chr(10) || '- one'
    ELSE CASE layer {" ".join("WHEN '" + x.key + "' THEN '" + x.brief + "'" for x in schemas.MAP_LAYERS)} END END) AS description_md5,
  CASE WHEN NOT {_stale} OR {_made} THEN '' WHEN k % 4 = 2 THEN '{snapshot.NO_DESCRIPTION}' ELSE '{snapshot.ENRICHMENT_FAILED}' END AS reasons FROM {SNAPSHOT}""",
    "importable_shapes": f"""SELECT "subKey", CASE WHEN list_contains({_named}, layer) AND NOT marked THEN 3 ELSE 1 END AS shapes FROM {SNAPSHOT}""",
    "import_counts": f"""SELECT count(*) FILTER (WHERE action IN ('insert', 'update')) AS upserted, count(*) FILTER (WHERE action = 'delete') AS deleted, count(*) FILTER (WHERE action = 'keep') AS kept,
  (SELECT count(*) FROM {zones._cut(zones.AFTER)} WHERE o_custkey % 11 <> 0 AND o_orderkey % 3 = 0) AS enriched FROM ({zones.ORACLES["snapshot_merge"]})""",
    "anchoring_adapter": """SELECT p_partkey, p_name AS title, p_brand AS subtitle, CASE WHEN p_partkey % 2 = 0 THEN p_brand || ' - ' || p_type || ' - x' ELSE p_brand END AS description, CASE WHEN p_partkey % 2 = 0 THEN ',' || p_type || ',' END AS tags,
  'Authority=Authority' || CASE WHEN p_partkey % 5 <> 0 THEN ';Published=2020-01-02' ELSE '' END AS details, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_partkey AS VARCHAR) ELSE 'gml' END AS source_id, CASE WHEN p_partkey % 4 = 0 THEN 'HTTPS://x.org/' || p_partkey END AS source_url FROM part""",
    "bunkering_adapter": """SELECT p_partkey, 'Bunkering area' || CASE WHEN p_partkey % 2 = 0 OR p_partkey % 5 <> 0 THEN ' ' || p_partkey ELSE '' END AS title, 'Offshore bunkering' AS subtitle, p_type AS description, CAST(NULL AS VARCHAR) AS tags, CAST(NULL AS VARCHAR) AS details,
  CASE WHEN p_partkey % 5 <> 0 THEN 'id_' || p_partkey ELSE 'gml' END AS source_id FROM part""",
    "label_functions": """SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN '(1A)' ELSE p_name END AS display, 'BAD_REQUEST_VALUE_' || p_partkey AS code, 'sync-1997-06-01' AS job, round(p_partkey / 7, 6) AS rounded, 'abcdef_' || p_partkey || ',zzzzzz-9' AS videos,
  'https://a.org/' || p_partkey || '=Label;HTTP://b.org' AS links, p_brand AS kind, p_type AS period, CASE WHEN p_partkey % 2 = 0 THEN '2024-03-05' END AS day, p_name AS first, CASE WHEN p_partkey = 0 THEN '' WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE 't' END AS label, '5 March 2024' AS long_date FROM part""",
    "valid_geometries": """SELECT vec_id, vec_id % 8 < 4 AS valid, CASE WHEN vec_id % 8 < 4 THEN CAST(vec_id % 2 + 13 AS DOUBLE) END AS x0, CASE WHEN vec_id % 8 < 4 THEN 35.0 END::DOUBLE AS y0, CASE WHEN vec_id % 8 = 0 THEN CAST(vec_id % 2 + 13 AS DOUBLE) WHEN vec_id % 8 < 4 THEN 15.0 END::DOUBLE AS x1,
  CASE WHEN vec_id % 8 = 0 THEN 35.0 WHEN vec_id % 8 < 4 THEN 36.0 END::DOUBLE AS y1, CASE WHEN vec_id % 8 < 4 THEN true END AS inside FROM embeddings""",
    "layer_normalized": """SELECT CAST(i AS INT) AS feature_idx, reason, CASE WHEN reason IS NULL THEN 'beaches:b-' || k END AS id, CASE WHEN k % 7 <> 0 THEN s_name END AS title, CASE WHEN k % 7 <> 0 THEN 'B' || k END AS site_code, CASE WHEN k % 10 <> 0 THEN 'Point' END AS "geometryType",
  CASE WHEN k % 10 <> 0 THEN CAST(k % 3 + 13 AS DOUBLE) END AS x FROM (SELECT s_suppkey AS k, s_name, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, CASE WHEN s_suppkey % 10 = 0 THEN 'null geometry' WHEN s_suppkey % 7 = 0 THEN 'no title' END AS reason FROM supplier)""",
    "layer_summary": """SELECT 'beaches' AS dataset_key, count(*) AS feature_count, 'Point' AS types, CAST(count(*) AS INT) AS codes, CAST(min(s_suppkey % 3 + 13) AS DOUBLE) AS x0, CAST(max(s_suppkey % 3 + 13) AS DOUBLE) AS x1 FROM supplier WHERE s_suppkey % 10 <> 0 AND s_suppkey % 7 <> 0""",
    "kml_placemarks": """SELECT CAST(r_regionkey AS INT) AS folder_idx, CAST(row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1 AS INT) AS placemark_idx, r_name AS folder, n_name AS name, 'of <b>' || r_name AS description, CASE WHEN n_nationkey % 4 = 3 THEN 2 ELSE 1 END AS shapes,
  CASE WHEN n_nationkey % 4 = 1 THEN 'point' ELSE 'line' END AS type, CASE WHEN n_nationkey % 4 = 1 THEN 1 ELSE 2 END AS points, CAST(n_nationkey AS DOUBLE) AS lon, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "context_check": f"""SELECT * FROM (VALUES ('good', NULL), ('bad', 'feature 9 in "{_first_context}" has invalid geometry'), ('none', 'dataset "{_first_context}" has no features'), ('untyped', 'feature 0 in "{_first_context}" is not a GeoJSON Feature')) x(name, error)""",
    "import_guards": f"""
WITH c AS (SELECT (SELECT count(*) FROM supplier) AS suppliers, (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM part) AS parts, (SELECT count(*) FROM ({zones.ORACLES["layer_match"]})) AS zones,
  (SELECT count(*) FROM ({layers.ORACLES["report_sites"]})) AS sites, (SELECT count(*) FROM labels) AS labels, (SELECT count(*) FROM labels WHERE doc_id BETWEEN 37 AND 59) AS few)
SELECT 'refresh' AS name, CASE WHEN suppliers < greatest(80, ceil(customers * 0.75)) THEN 'dataset "beaches" has ' || suppliers || ' features; the minimum safe count is ' || CAST(greatest(80, ceil(customers * 0.75)) AS BIGINT) END AS error FROM c
UNION ALL SELECT 'first refresh', CASE WHEN customers < 80 THEN 'dataset "beaches" has ' || customers || ' features; the minimum safe count is 80' END FROM c
UNION ALL SELECT 'snapshot', CASE WHEN zones < 50 THEN 'the snapshot has ' || zones || ' zones; 50 are the least' WHEN zones < parts * 0.6 THEN 'the snapshot shrank from ' || parts || ' to ' || zones || ' zones' END FROM c
UNION ALL SELECT 'first snapshot', CASE WHEN zones < 50 THEN 'the snapshot has ' || zones || ' zones; 50 are the least' END FROM c
UNION ALL SELECT 'layer', 'the snapshot has no layer bolts' FROM c UNION ALL SELECT 'report', 'the report has ' || sites || ' site(s); 10000 are the least that is trusted' FROM c
UNION ALL SELECT 'classes', NULL FROM c UNION ALL SELECT 'all classes', 'only ' || few || ' of ' || labels || ' classified sites are known' FROM c
UNION ALL SELECT 'adapter', 'interactive dataset "{_first_context}" has no adapter' FROM c""",
}
ORACLES["date_views"] = f"""
WITH a AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders),
b AS (SELECT k, CASE WHEN k % 7 = 0 THEN '1998-08-0' || (k % 4 + 1) || 'T12:0' || (k % 10) || ':01Z' ELSE CASE k % 6 WHEN 0 THEN d WHEN 1 THEN d || 'T11:59:30.250' WHEN 2 THEN d || 'T23:30:00+02:00' WHEN 3 THEN d || ' noon' WHEN 4 THEN '' END END AS w,
  CASE WHEN k % 7 = 0 THEN CAST('1998-08-0' || (k % 4 + 1) || ' 12:0' || (k % 10) || ':01' AS TIMESTAMP) ELSE CASE k % 6 WHEN 0 THEN CAST(d AS TIMESTAMP) WHEN 1 THEN CAST(d || ' 11:59:30.250' AS TIMESTAMP) WHEN 2 THEN CAST(d || ' 21:30:00' AS TIMESTAMP) END END AS t FROM a),
n AS (SELECT *, TIMESTAMP '{VIEWED}' AS v FROM b),
u AS (SELECT *, least(t, v) AS l, greatest(t, v) AS h FROM n),
s AS (SELECT *, CASE WHEN date_sub('year', l, h) > 0 THEN [date_sub('year', l, h), 1] WHEN date_sub('month', l, h) > 0 THEN [date_sub('month', l, h), 2] WHEN date_sub('day', l, h) > 0 THEN [date_sub('day', l, h), 3]
  WHEN date_sub('hour', l, h) > 0 THEN [date_sub('hour', l, h), 4] WHEN date_sub('minute', l, h) > 0 THEN [date_sub('minute', l, h), 5] ELSE [date_sub('second', l, h), 6] END AS p FROM u)
SELECT k AS o_orderkey, coalesce(strftime(t, '%d %b %Y, %H:%M'), w, '') AS shown,
  CASE WHEN t IS NULL THEN '' ELSE CASE WHEN t < v THEN '' ELSE 'in ' END || p[1] || ' ' || ['year', 'month', 'day', 'hour', 'minute', 'second'][p[2]] || CASE WHEN p[1] = 1 THEN '' ELSE 's' END || CASE WHEN t < v THEN ' ago' ELSE '' END END AS since,
  CASE WHEN t IS NULL THEN coalesce(w, '') WHEN length(w) > 10 THEN left(w, 16) ELSE w || 'T00:00' END AS field FROM s"""
ORACLES["layer_refresh"] = """
WITH a AS (SELECT c_custkey AS k, c_custkey % 8 AS m, c_custkey % 2 + 13 AS x FROM customer),
b AS (SELECT *, CASE m WHEN 2 THEN 'no text' WHEN 3 THEN 'expected type FeatureCollection, got "Point"' WHEN 4 THEN 'no features' WHEN 5 THEN 'feature 1 is not a GeoJSON Feature' WHEN 6 THEN 'feature 1 has no valid geometry' WHEN 7 THEN 'feature 1 has no valid geometry' END AS wrong,
  k % 5 = 1 AS damaged, k % 5 <> 0 AND k % 3 = 0 AND k % 5 <> 1 AS another, k % 5 = 0 AS absent FROM a)
SELECT CAST(k AS VARCHAR) AS dataset_key, CASE WHEN wrong IS NOT NULL OR damaged THEN 'failed' WHEN another OR absent THEN 'changed' ELSE 'unchanged' END AS state, coalesce(wrong, CASE WHEN damaged THEN 'stored: not JSON' END) AS error,
  CASE m WHEN 0 THEN 2 WHEN 1 THEN 1 END AS features, CASE WHEN m < 2 THEN CAST(x AS DOUBLE) END AS x0, CASE WHEN m < 2 THEN 35.0::DOUBLE END AS y0, CASE m WHEN 0 THEN 15.0::DOUBLE WHEN 1 THEN CAST(x AS DOUBLE) END AS x1, CASE m WHEN 0 THEN 36.5::DOUBLE WHEN 1 THEN 35.0::DOUBLE END AS y1,
  CASE WHEN absent OR damaged THEN NULL WHEN another THEN 1 WHEN m = 0 THEN 2 WHEN m = 1 THEN 1 END AS old_features FROM b"""
#: The place in the folder counts placemarks without shapes, too.
ORACLES["kml_placemarks"] = f"SELECT * EXCLUDE n_nationkey FROM ({ORACLES['kml_placemarks']}) WHERE n_nationkey % 4 <> 0"
