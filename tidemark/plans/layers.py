"""Layer queries bound to part, supplier, nation, customer, documents, labels, pages and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import geo, text
from tidemark.operators import adapters, catalog, classification
from tidemark.sources import reports

#: Words that the profanity query looks for in the documents.
LISTED = ("the", "pour", "lichber", "ciónll")


def _variant(**columns):
    return F.parse_json(F.to_json(F.struct(*[c.alias(n) for n, c in columns.items()])))


def _flat(served):
    s = lambda c: F.col(f"{served}.{c}")
    pairs = F.array_join(F.transform(s("details"), lambda d: F.concat_ws("=", d["label"], d["value"])), ";")
    return [s("title").alias("title"), s("subtitle").alias("subtitle"), s("description").alias("description"), text.tags_csv(s("tags")).alias("tags"), pairs.alias("details"), s("sourceId").alias("source_id")]


def feature_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as diving sites."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    size = F.col("p_size")
    props = _variant(
        siteName=F.when(size % 7 != 0, F.concat(F.lit("  "), F.col("p_name"), F.lit(" "))), location=F.col("p_brand"), siteType=F.when(size % 2 == 0, "location").otherwise("site"),
        interest=F.when(size % 5 == 0, "n/a").otherwise(F.concat("p_type", F.lit(" & "), F.lower("p_type"), F.lit("& "), "p_brand")), hasDescription=(size % 3 == 0), shortDescription=F.col("p_type"),
        depthMaxMeters=F.when(size % 4 != 0, size).otherwise(F.lit(None)), depthAverageMeters=F.when(size % 6 != 0, (size / 2).cast("string")), depthMaxIsMinimum=(size % 8 == 1), shoreAccess=F.col("p_brand"),
        rating=(size % 6).cast("string"), ratings=size, localId=F.concat(F.lit("p_"), F.col("p_partkey")),
    )
    rows = p.select("p_partkey", adapters.diving_site(props).alias("s"))
    return rows.select("p_partkey", *_flat("s"), F.col("s.rating.value").alias("rating_value"), F.col("s.rating.count").alias("rating_count"))


def beach_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as beaches."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k = F.col("s_suppkey")
    props = _variant(
        Name_ENG=F.when(k % 4 != 0, F.col("s_name")), Name_MT=F.when(k % 3 == 0, F.upper("s_name")), Site_Code=F.concat(F.lit("A"), k.cast("string")), Sandy_OR_Rocky_Beach=F.when(k % 5 == 0, "NA").when(k % 2 == 0, "ROCKY beach").otherwise("sandy Beach"),
        Blue_Flag_OR_Beach_of_Quality=F.when(k % 2 == 0, "Yes").otherwise("no"), RecommendedForBathing_YES_OR_NO=F.when(k % 6 == 0, "NO").when(k % 6 == 1, "YES").otherwise(""), Pubic_convenience=F.when(k % 3 == 0, "N/A").otherwise("Situated 1"),
    )
    return s.select("s_suppkey", adapters.beach(props).alias("s")).select("s_suppkey", *_flat("s"))


def tag_dedupe(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = F.array(F.upper("lang"), F.col("lang"), F.col("source"), F.lit(""), F.upper("source"), F.when(F.col("n_chars") > 1000, "long"))
    return d.select("doc_id", text.tags_csv(text.tags(words)).alias("tags"))


def slug_ids(spark, sf_dir):
    """Ids of parts as features of one layer; many share a name."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = p.select(F.lit("parts").alias("dataset_key"), F.col("p_partkey").cast("int").alias("feature_idx"), F.concat(F.lit(" "), F.initcap("p_name"), F.lit("! ")).alias("raw_id"))
    return catalog.with_ids(rows).select("feature_idx", "id")


def _classes(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/labels.parquet")
    names = F.array(*[F.lit(x) for x in schemas.CLASSES])
    return c.select(F.col("doc_id").cast("string").alias("siteCode"), F.element_at(names, (F.col("doc_id") % 7 + 1).cast("int")).alias("classification"), (F.col("toxic") == 1).alias("healthWarning"), F.when(F.col("quality") == 1, "1 June 2026").alias("publishedOn"))


def classification_overlay(spark, sf_dir):
    """Documents as beaches, labels as their classes."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = d.select("doc_id", F.col("doc_id").cast("string").alias("site_code"), F.array("lang", "source").alias("tags"), text.details(text.detail("Source", F.col("source"))).alias("details"))
    out = classification.overlay(rows, _classes(spark, sf_dir))
    pairs = F.array_join(F.transform("details", lambda x: F.concat_ws("=", x["label"], x["value"])), ";")
    return out.select("doc_id", text.tags_csv(F.col("tags")).alias("tags"), pairs.alias("details"), F.col("waterQuality.rank").alias("rank"), F.col("waterQuality.healthWarning").alias("warning"))


def classification_overlap(spark, sf_dir):
    """Labels against documents whose keys are moved on by 37, so that some have no label."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") + 37).cast("string").alias("siteCode"))
    return classification.overlap(_classes(spark, sf_dir), d)


def report_sites(spark, sf_dir):
    """Conversations as reports: the first well-formed row of each site code."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    code = F.concat(F.substring(F.lit("abcde"), (F.col("conv_id") % 5 + 1).cast("int"), F.lit(1)), F.lit(" "), F.lpad((F.col("conv_id") % 97).cast("string"), 2, "0"))
    site = F.struct(code.alias("siteCode"), F.when(F.col("role") == "user", " Excellent ").when(F.col("turn") % 4 == 1, "closed").otherwise("unheard of").alias("classification"), (F.col("turn") > 2).alias("healthWarning"))
    rows = c.select(F.lit(" today ").alias("publishedOn"), F.array(site).alias("sites"), "conv_id", "turn")
    return reports.sites(rows, schemas.CLASSES, "conv_id", "turn")


def catalog_revision(spark, sf_dir):
    """Nations as layers, each hashed over its customers' names."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    layers = c.groupBy(F.col("c_nationkey").cast("string").alias("dataset_key")).agg(F.array_join(F.array_sort(F.collect_list("c_name")), ",").alias("payload"))
    return catalog.revision(catalog.with_hash(layers))


def catalog_names(spark, sf_dir):
    """Mixed-case names in the order that people expect, numbered."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("name"))
    from pyspark.sql import Window

    return n.select("name", F.row_number().over(Window.orderBy(F.collate("name", "UNICODE"), "name")).alias("place"))


def refresh_report(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("dataset_key"), F.col("c_name").alias("payload"))
    new = c.withColumn("payload", F.when(F.col("dataset_key") % 5 == 0, F.lit(None)).when(F.col("dataset_key") % 3 == 0, F.lower("payload")).otherwise(F.col("payload")))
    return catalog.refresh_report(new, c.filter("dataset_key % 7 <> 0"))


def dropped_reasons(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    reason = catalog.dropped_reason(F.col("doc_id") % 4 == 0, F.col("n_chars") < 2000, F.when(F.col("lang") != "fr", F.col("lang")))
    return catalog.counts_by_reason(d.select(reason.alias("reason"))).withColumnRenamed("count", "n")


def html_plain(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", F.sha2(text.plain_source(F.col("html")), 256).alias("plain_sha256"))


def html_links(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return reports.anchors(p, "page_id", "html", suffix="(?i)^/[a-m]").select("page_id", "pos", "href", "label")


def latest_link(spark, sf_dir):
    """Pages' links as uploads of reports, the months and weeks made from the page and the place of the link."""
    links = reports.anchors(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html", suffix=".")
    month, week_ = F.lpad((F.col("pos") % 12 + 1).cast("string"), 2, "0"), F.col("page_id") % 5
    href = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("/uploads/2026/"), month, F.lit("/classification-week-"), week_, F.lit(".pdf"))).otherwise(F.concat(F.lit("other"), F.col("href")))
    return reports.latest(links.withColumn("href", href), F.lit("https://example.org/reports/"), "page_id")


def profanity_filter(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.filter(text.swears(F.col("text"), LISTED)).select("doc_id")


# Geometry: an embedding's components in pairs are 32 positions within the default bounds.


def _scaled(x, low, high):
    return F.round(low + (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double"))) + 1) / 2 * (high - low), 6)


def positions(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    at = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.array(_scaled(F.get("embedding", 2 * i), 13.0, 16.0), _scaled(F.get("embedding", 2 * i + 1), 34.5, 37.0)))
    return e.select("vec_id", "label", at.alias("at"))


def geo_bbox(spark, sf_dir):
    box = geo.bbox(F.col("at"))
    return positions(spark, sf_dir).select("vec_id", *[box[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


def geo_summary(spark, sf_dir):
    """Boxes and counts by label, folded from the features' boxes."""
    rows = positions(spark, sf_dir).select(F.col("label").cast("string").alias("dataset_key"), F.lit(None).cast("string").alias("reason"), geo.bbox(F.col("at")).alias("bbox"), F.when(F.col("vec_id") % 2 == 0, "Polygon").otherwise("LineString").alias("geometryType"), F.lit(None).cast("string").alias("site_code"))
    s = catalog.summary(rows)
    return s.select("dataset_key", "feature_count", F.array_join("geometry_types", ",").alias("geometry_types"), *[F.get("bbox", i).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


def _parts(spark, sf_dir):
    """Each vector as a notice of three parts: a point, a line of two, and a ring of 0 to 4 points."""
    p = positions(spark, sf_dir)
    point = lambda a: F.struct(a[1].alias("lat"), a[0].alias("long"))
    part = lambda kind, start, n: F.struct(F.lit("x").alias("label"), F.lit(kind).alias("geometryType"), F.transform(F.slice("at", start, n), point).alias("points"))
    size = (F.col("vec_id") % 5).cast("int")
    return p.select("vec_id", F.array(part("point", 1, 1), part("line", 2, F.lit(2)), part("polygon", 4, size)).alias("areas"))


def geo_circle(spark, sf_dir):
    c = geo.bounding_circle(F.col("areas"), (F.col("vec_id") % 3).cast("double") * 100)
    rows = _parts(spark, sf_dir).select("vec_id", c.alias("c"))
    return rows.select("vec_id", F.round("c.latitude", 7).alias("latitude"), F.round("c.longitude", 7).alias("longitude"), F.round("c.radius", 2).alias("radius"))


def geo_features(spark, sf_dir):
    """Parts that can be drawn, with their place and number of positions."""
    rows = _parts(spark, sf_dir).select("vec_id", F.explode(geo.features(F.col("areas"))).alias("f"))
    return rows.select("vec_id", "f.part", F.col("f.geometry.type").alias("type"), F.size("f.geometry.coordinates").alias("n"))


def geo_fingerprint(spark, sf_dir):
    """Fingerprints of the first five positions as a ring, turned by the vector's number, half of them reversed."""
    p = positions(spark, sf_dir)
    five = F.transform(F.slice("at", 1, 5), lambda a: F.struct(a[0].alias("lon"), a[1].alias("lat")))
    turn = (F.col("vec_id") % 5).cast("int")
    turned = F.concat(F.slice("five", turn + 1, F.lit(5)), F.slice("five", F.lit(1), turn))
    ring = F.when(F.col("vec_id") % 2 == 0, F.col("turned")).otherwise(F.reverse("turned"))
    return p.select("vec_id", five.alias("five")).withColumn("turned", turned).select("vec_id", geo.fingerprint(F.lit("polygon"), ring).alias("fingerprint"))


#: A box of waters with land in it, for the sea query.
WATERS = [[[[13.5, 35.0], [15.5, 35.0], [15.5, 36.5], [13.5, 36.5], [13.5, 35.0]]]]
LAND = [[[[14.4, 35.6], [14.7, 35.6], [14.7, 35.9], [14.4, 35.9], [14.4, 35.6]]]]


def sea_filter(spark, sf_dir):
    p = positions(spark, sf_dir).select("vec_id", F.posexplode("at").alias("i", "a"))
    test = geo.point_in_sea(geo.Sea(WATERS, LAND))
    return p.select("vec_id", F.col("a")[0].alias("lon"), F.col("a")[1].alias("lat")).filter(test(F.col("lon"), F.col("lat"))).groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"))


def positions_within(spark, sf_dir):
    p = positions(spark, sf_dir).select("vec_id", F.explode("at").alias("a"))
    return p.filter(geo.within(F.col("a"), (14.0, 35.0, 15.0, 36.0))).groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        feature_adapter, beach_adapter, tag_dedupe, slug_ids, classification_overlay, classification_overlap, report_sites, catalog_revision, catalog_names, refresh_report, dropped_reasons,
        html_plain, html_links, latest_link, profanity_filter, geo_bbox, geo_summary, geo_circle, geo_features, geo_fingerprint, sea_filter, positions_within,
    )
}
_scale = lambda x, low, high: f"round({low} + (greatest(-1.0, least(1.0, CAST({x} AS DOUBLE))) + 1) / 2 * ({high} - {low}), 6)"
POSITIONS = f"(SELECT vec_id, label, i, {_scale('embedding[2 * i + 1]', '13.0', '16.0')} AS x, {_scale('embedding[2 * i + 2]', '34.5', '37.0')} AS y FROM embeddings, range(0, 32) r(i))"
CLASSES = """(SELECT doc_id, ['excellent', 'good', 'sufficient', 'poor', 'insufficient', 'closed', 'inaccessible'][doc_id % 7 + 1] AS c, [4, 3, 2, 1, 0, 0, 0][doc_id % 7 + 1] AS rank,
  toxic = 1 AS warning, CASE WHEN quality = 1 THEN ' (as of 1 June 2026)' ELSE '' END AS published FROM labels)"""
_haversine = f"2 * {geo.EARTH_RADIUS} * atan2(sqrt(a), sqrt(1 - a))"
ORACLES = {
    "feature_adapter": """
SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN p_name ELSE p_brand END AS title, CASE WHEN p_size % 2 = 0 THEN 'Dive location' ELSE 'Dive site' END AS subtitle,
  CASE WHEN p_size % 3 = 0 THEN p_type END AS description, CASE WHEN p_size % 5 <> 0 THEN ',' || p_type || ',' || p_brand || ',' END AS tags,
  concat_ws(';', 'Depth=' || CASE WHEN p_size % 4 <> 0 AND p_size % 6 <> 0 THEN CASE WHEN p_size % 2 = 0 THEN CAST(p_size // 2 AS VARCHAR) ELSE CAST(p_size / 2 AS VARCHAR) END || '–' || p_size || CASE WHEN p_size % 8 = 1 THEN '+' ELSE '' END
    WHEN p_size % 4 <> 0 THEN p_size || CASE WHEN p_size % 8 = 1 THEN '+' ELSE '' END WHEN p_size % 6 <> 0 THEN CAST(p_size // 2 AS VARCHAR) END || ' m', 'Shore access=' || p_brand) AS details,
  'p_' || p_partkey AS source_id, CASE WHEN p_size % 6 > 0 AND p_size > 0 THEN CAST(p_size % 6 AS DOUBLE) END AS rating_value, CASE WHEN p_size % 6 > 0 AND p_size > 0 THEN CAST(p_size AS BIGINT) END AS rating_count
FROM part""",
    "beach_adapter": """
SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 THEN s_name WHEN s_suppkey % 3 = 0 THEN upper(s_name) ELSE 'Bathing site A' || s_suppkey END AS title, 'Bathing water site' AS subtitle, CAST(NULL AS VARCHAR) AS description,
  CASE WHEN t <> '' THEN ',' || t || ',' END AS tags,
  concat_ws(';', 'Recommended for bathing=' || CASE s_suppkey % 6 WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' END, 'Blue Flag / Beach of Quality=' || CASE WHEN s_suppkey % 2 = 0 THEN 'Yes' ELSE 'No' END, 'Beach type=' || b,
    CASE WHEN s_suppkey % 3 <> 0 THEN 'Public convenience=Available nearby' END) AS details, 'A' || s_suppkey AS source_id
FROM (SELECT *, concat_ws(',', b, CASE WHEN s_suppkey % 2 = 0 THEN 'Blue Flag / Beach of Quality' END, CASE WHEN s_suppkey % 6 = 0 THEN 'Not recommended for bathing' END) AS t
  FROM (SELECT *, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 2 = 0 THEN 'Rocky beach' ELSE 'Sandy beach' END AS b FROM supplier))""",
    "tag_dedupe": "SELECT doc_id, ',' || upper(lang) || ',' || source || CASE WHEN n_chars > 1000 THEN ',long' ELSE '' END || ',' AS tags FROM documents",
    "slug_ids": """SELECT CAST(p_partkey AS INT) AS feature_idx, 'parts:' || replace(p_name, ' ', '-') || CASE WHEN n = 1 THEN '' ELSE '-' || n END AS id
FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)""",
    "classification_overlay": f"""
SELECT doc_id, ',' || concat_ws(',', CASE c WHEN 'closed' THEN 'CLOSED — bathing not recommended' WHEN 'poor' THEN 'Poor water quality' WHEN 'insufficient' THEN 'Insufficient water quality data' WHEN 'inaccessible' THEN 'Inaccessible' END,
    CASE WHEN warning THEN 'Health warning' END, lang, source) || ',' AS tags,
  CASE WHEN c IS NOT NULL THEN 'Water quality=' || upper(c[1]) || c[2:] || published || ';' ELSE '' END || 'Source=' || source AS details, rank, CASE WHEN warning THEN true END AS warning
FROM documents LEFT JOIN {CLASSES} USING (doc_id)""",
    "classification_overlap": """SELECT count(*) AS n, count(d.doc_id) AS matched, count(d.doc_id) / count(*) AS ratio FROM labels l LEFT JOIN (SELECT DISTINCT doc_id + 37 AS doc_id FROM documents) d USING (doc_id)""",
    "report_sites": """
SELECT code AS "siteCode", c AS classification, turn > 2 AS "healthWarning", 'today' AS "publishedOn" FROM (
  SELECT *, row_number() OVER (PARTITION BY code ORDER BY conv_id, turn) AS n FROM (
    SELECT conv_id, turn, upper('abcde'[conv_id % 5 + 1]) || lpad(CAST(conv_id % 97 AS VARCHAR), 2, '0') AS code, CASE WHEN role = 'user' THEN 'excellent' WHEN turn % 4 = 1 THEN 'closed' END AS c FROM conversations)
  WHERE c IS NOT NULL AND regexp_matches(code, '^[A-D][0-9]{2}$')) WHERE n = 1""",
    "catalog_revision": """SELECT sha256(string_agg(line, chr(10) ORDER BY line)) AS revision FROM (
  SELECT c_nationkey || ':' || sha256(string_agg(c_name, ',' ORDER BY c_name)) AS line FROM customer GROUP BY c_nationkey)""",
    "catalog_names": """SELECT name, CAST(row_number() OVER (ORDER BY name COLLATE NOCASE, name DESC) AS INT) AS place FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS name FROM nation)""",
    "refresh_report": """SELECT c_custkey AS dataset_key, CASE WHEN c_custkey % 5 = 0 THEN 'failed' WHEN c_custkey % 3 <> 0 AND c_custkey % 7 <> 0 THEN 'unchanged' ELSE 'changed' END AS state FROM customer""",
    "dropped_reasons": """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN doc_id % 4 = 0 THEN 'null geometry' WHEN n_chars >= 2000 THEN 'invalid geometry' WHEN lang = 'fr' OR lang IS NULL THEN 'no title' END AS reason FROM documents)
WHERE reason IS NOT NULL GROUP BY reason""",
    "html_plain": r"SELECT page_id, sha256(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[\s\x0B\x{00A0}]+', ' ', 'g'))) AS plain_sha256 FROM pages",
    "html_links": r"""SELECT page_id, CAST(i - 1 AS INT) AS pos, regexp_extract(a, 'href="([^"]+)"', 1) AS href, regexp_replace(regexp_extract(a, '(?is)^<a\b[^>]*>(.*?)</a>$', 1), '<[^>]+>', ' ', 'g') AS label FROM (
  SELECT page_id, unnest(l) AS a, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*href="[^"]+"[^>]*>.*?</a>') AS l FROM pages))
WHERE regexp_matches(regexp_extract(a, 'href="([^"]+)"', 1), '(?i)^/[a-m]')""",
    "latest_link": r"""SELECT page_id, 'https://example.org/uploads/2026/' || lpad(CAST(m AS VARCHAR), 2, '0') || '/classification-week-' || page_id % 5 || '.pdf' AS url FROM (
  SELECT page_id, max((i - 1) % 12 + 1) AS m FROM (SELECT page_id, generate_subscripts(regexp_extract_all(html, '(?is)<a\b[^>]*href="[^"]+"[^>]*>.*?</a>'), 1) AS i FROM pages) WHERE (i - 1) % 3 = 0 GROUP BY page_id)""",
    "profanity_filter": f"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9])({'|'.join(LISTED)})($|[^a-z0-9])')",
    "geo_bbox": f"SELECT vec_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM {POSITIONS} GROUP BY vec_id",
    "geo_summary": f"""SELECT CAST(label AS VARCHAR) AS dataset_key, count(DISTINCT vec_id) AS feature_count, array_to_string(list_sort(list(DISTINCT CASE WHEN vec_id % 2 = 0 THEN 'Polygon' ELSE 'LineString' END)), ',') AS geometry_types,
  min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM {POSITIONS} GROUP BY label""",
    "geo_circle": f"""WITH p AS (SELECT * FROM {POSITIONS} WHERE i < 3 + vec_id % 5), b AS (SELECT vec_id, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy FROM p GROUP BY vec_id),
d AS (SELECT vec_id, cx, cy, pow(sin(radians(y - cy) / 2), 2) + pow(sin(radians(x - cx) / 2), 2) * cos(radians(cy)) * cos(radians(y)) AS a FROM p JOIN b USING (vec_id))
SELECT vec_id, round(cy, 7) AS latitude, round(cx, 7) AS longitude, round(max({_haversine}) + (vec_id % 3) * 100, 2) AS radius FROM d GROUP BY vec_id, cx, cy""",
    "geo_features": """SELECT vec_id, CAST(part AS INT) AS part, type, CAST(n AS INT) AS n FROM (SELECT vec_id, 0 AS part, 'Point' AS type, 1 AS n FROM embeddings UNION ALL SELECT vec_id, 1, 'LineString', 2 FROM embeddings
UNION ALL SELECT vec_id, 2, 'Polygon', vec_id % 5 + 1 FROM embeddings WHERE vec_id % 5 >= 3)""",
    "geo_fingerprint": f"""WITH t AS (SELECT vec_id, i, printf('%.7f,%.7f', x, y) AS s FROM {POSITIONS} WHERE i < 5),
r AS (SELECT a.vec_id, k, string_agg(b.s, ';' ORDER BY (b.i - k + 5) % 5) AS forward, string_agg(b.s, ';' ORDER BY (k - b.i + 5) % 5) AS backward FROM (SELECT DISTINCT vec_id, unnest(range(0, 5)) AS k FROM t) a JOIN t b USING (vec_id) GROUP BY a.vec_id, k)
SELECT vec_id, sha256('polygon:' || least(min(forward), min(backward))) AS fingerprint FROM r GROUP BY vec_id""",
    "sea_filter": f"SELECT vec_id, count(*) AS n FROM {POSITIONS} WHERE x BETWEEN 13.5 AND 15.5 AND y BETWEEN 35.0 AND 36.5 AND NOT (x > 14.4 AND x < 14.7 AND y > 35.6 AND y < 35.9) GROUP BY vec_id",
    "positions_within": f"SELECT vec_id, count(*) AS n FROM {POSITIONS} WHERE x BETWEEN 14 AND 15 AND y BETWEEN 35 AND 36 GROUP BY vec_id",
}
