"""Classification reports: finding the latest one, and reading its table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.sources import http

#: The least number of sites that a report is trusted with, and patterns of codes, links and weeks.
LEAST_SITES = 80
SITE_CODE = r"^[A-D]\d{2}$"
ANCHOR = r'(?is)<a\b[^>]*href="([^"]+)"[^>]*>(.*?)</a>'
WEEK = r"(?i)\bweek(?:[-_\s]*)(\d{1,2})\b"
UPLOAD = r"/uploads/(\d{4})/(\d{2})/"
REPORT = "publishedOn STRING, sites ARRAY<STRUCT<siteCode: STRING, classification: STRING, healthWarning: BOOLEAN>>"


def anchors(pages: DataFrame, key: str, html: str, suffix: str = r"(?i)\.pdf(?:[?#]|$)") -> DataFrame:
    """(key, pos, href, label) of the links in each page whose href matches ``suffix``."""
    every = F.regexp_extract_all(F.col(html), F.lit(ANCHOR), 0)
    each = pages.select(key, F.posexplode(every).alias("pos", "a"))
    out = each.select(key, "pos", F.regexp_extract("a", ANCHOR, 1).alias("href"), text.without_tags(F.regexp_extract("a", ANCHOR, 2)).alias("label"))
    return out.filter(F.col("href").rlike(suffix))


def looks_like_report(href: Column, label: Column) -> Column:
    where = F.lower(F.concat_ws(" ", href, label))
    has = lambda w: where.contains(w)
    return has("classification") | (has("site") & has("update")) | (has("bathing") & has("report"))


def absolute(href: Column, base: Column) -> Column:
    """The link as seen from a page; null where it can't be resolved."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<![:/])/[^/]*$", "")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(origin == "", F.lit(None))
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, href))
        .otherwise(F.concat(folder, F.lit("/"), href))
    )


def upload_key(url: Column) -> Column:
    month = F.concat_ws("/", F.regexp_extract(url, UPLOAD, 1), F.regexp_extract(url, UPLOAD, 2))
    return F.when(month != "/", month).otherwise(F.concat(F.lit("0000/00 "), url))


def week(value: Column) -> Column:
    return F.coalesce(text.group(value, WEEK, 1).cast("int"), F.lit(0))


def latest(links: DataFrame, base: Column, *keys: str) -> DataFrame:
    """The link of the latest report for each key: by upload month, then week, then place in the page."""
    url = absolute(F.col("href"), base)
    some = links.filter(looks_like_report(F.col("href"), F.col("label"))).withColumn("url", url).filter("url IS NOT NULL")
    order = F.struct(upload_key(F.col("url")), week(F.concat_ws(" ", "href", "label")), "pos")
    return some.groupBy(*keys).agg(F.max_by("url", order).alias("url"))


def site_code(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), f"{text.WS}+", "")


def classification(c: Column, classes) -> Column:
    low = F.lower(text.trim(c))
    return F.when(low.isin(*classes), low)


def fetch_latest(spark: SparkSession, page: str, text_of=http.fetch_text, bytes_of=http.fetch_bytes) -> tuple[str, bytes]:
    """The URL and the content of the latest report that a page links to; none is an error."""
    links = anchors(spark.createDataFrame([(page, text_of(page))], "page string, html string"), "page", "html")
    if not (found := latest(links, F.col("page"), "page").first()):
        raise LookupError(f"no report on {page}")
    return found.url, bytes_of(found.url)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A report that has been transcribed to JSON: (publishedOn, sites)."""
    return spark.read.schema(REPORT).option("multiLine", True).json(path)


def sites(report: DataFrame, classes, *order: str) -> DataFrame:
    """(siteCode, classification, healthWarning, publishedOn): well-formed codes with a known class, the first of each code.

    Several reports are taken in the order of their columns ``order``. The first is kept before the shuffle, too.
    """
    rows = report.select(*order, F.nullif(text.trim(F.col("publishedOn")), F.lit("")).alias("publishedOn"), F.posexplode("sites").alias("pos", "s"))
    kept = rows.select(F.struct(*order, "pos").alias("at"), site_code(F.col("s.siteCode")).alias("siteCode"), classification(F.col("s.classification"), classes).alias("classification"), F.col("s.healthWarning").alias("healthWarning"), "publishedOn")
    kept = kept.filter(F.col("siteCode").rlike(SITE_CODE) & F.col("classification").isNotNull())
    return kept.groupBy("siteCode").agg(F.min_by(F.struct("classification", "healthWarning", "publishedOn"), "at").alias("first")).select("siteCode", "first.*")


def assert_enough(found: DataFrame, least: int = LEAST_SITES) -> None:
    if (n := found.count()) < least:
        raise ValueError(f"the report has {n} site(s); {least} are the least that is trusted")
