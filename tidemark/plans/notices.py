"""Notice, report and log queries bound to orders, lineitem, events and customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import notices as n

AS_OF = "1997-06-01 00:00:00"
LOG_AS_OF = "2024-01-30 00:00:00"
PRIORITIES = ("0-NONE", "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _at(stamp: str):
    return F.lit(stamp).cast("timestamp_ntz")


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the shape of notices."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey")
    return o.select(
        key.alias("id"),
        F.when(F.col("o_orderpriority") < "3", "alert").otherwise("info").alias("kind"),
        F.col("o_orderpriority").alias("category"),
        (F.col("o_orderstatus") == "P").alias("needsReview"),
        F.col("o_orderdate").alias("activeFrom"),
        F.when(key % 5 != 0, F.col("o_orderdate") + F.make_dt_interval((key % 90).cast("int"))).alias("activeTo"),
        (F.col("o_orderdate") + F.make_dt_interval((key % 7).cast("int"))).alias("updatedAt"),
    )


NOTICES = """(SELECT o_orderkey AS id, CASE WHEN o_orderpriority < '3' THEN 'alert' ELSE 'info' END AS kind, o_orderpriority AS category,
  o_orderstatus = 'P' AS "needsReview", o_orderdate AS "activeFrom",
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + to_days(CAST(o_orderkey % 90 AS INT)) END AS "activeTo",
  o_orderdate + to_days(CAST(o_orderkey % 7 AS INT)) AS "updatedAt" FROM orders)"""
ACTIVE = f""" "activeFrom" <= TIMESTAMP '{AS_OF}' AND ("activeTo" >= TIMESTAMP '{AS_OF}' OR "activeTo" IS NULL) """
PAGE = ["id", "kind", "activeFrom", "activeTo"]


def notice_page(spark, sf_dir):
    return n.notice_page(notices(spark, sf_dir), n.Page(), _at(AS_OF)).select(*PAGE)


def review_page(spark, sf_dir):
    return n.notice_page(notices(spark, sf_dir), n.Page(limit=10, offset=20, kind="alert", active_only=False), _at(AS_OF), needs_review=True).select(*PAGE)


def active_notices(spark, sf_dir):
    return notices(spark, sf_dir).filter(n.active(_at(AS_OF))).select(*PAGE)


def notice_metrics(spark, sf_dir):
    kinds = spark.createDataFrame([(k,) for k in PRIORITIES], "kind string")
    return n.metrics(notices(spark, sf_dir).withColumn("kind", F.col("category")), kinds, _at(AS_OF))


def notice_manifest(spark, sf_dir):
    return n.manifest(notices(spark, sf_dir), _at(AS_OF))


def flagged_page(spark, sf_dir):
    reports = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("reports"))
    rows = notices(spark, sf_dir).join(reports, "id").withColumnRenamed("updatedAt", "createdAt")
    return n.flagged_page(rows, least=7, limit=50).select("id", "reports", "createdAt")


def logs(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("logType"), F.col("props").alias("description"), F.col("ts").alias("createdAt"))


def logs_page(spark, sf_dir):
    return n.logs_page(logs(spark, sf_dir), kind="error", since=_at("2024-01-10 00:00:00"), limit=200, offset=10)


def log_retention(spark, sf_dir):
    return n.retained(logs(spark, sf_dir), _at(LOG_AS_OF))


def reports_page(spark, sf_dir):
    rows = logs(spark, sf_dir).select("id", (F.col("logType") == "signup").alias("resolved"), "createdAt")
    return n.reports_page(rows, resolved=True, limit=25)


def _counted(spark, sf_dir):
    # the customers' keys are moved on, so that some events name none
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select((F.col("c_custkey") + 50).alias("id"), F.col("c_nationkey").alias("reports"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type = 'error'").select(F.col("user_id").alias("id"))
    return n.count_reports(rows, events)


def report_increment(spark, sf_dir):
    return _counted(spark, sf_dir)[0]


def unknown_reports(spark, sf_dir):
    return _counted(spark, sf_dir)[1]


def report_validation(spark, sf_dir):
    """Documents as reports, at places made from their numbers: what is wrong with each."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lat, lon = (F.col("doc_id") % 200 - 100).cast("double"), (F.col("doc_id") % 400 - 200).cast("double")
    wrong = n.report_errors(F.when(F.col("doc_id") % 9 != 0, F.col("source")), F.col("text"), lat, lon)
    return d.select("doc_id", F.array_join(wrong, ",").alias("errors"))


def json_props(spark, sf_dir):
    """Numbers from the JSON of events, by type."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return e.select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("most"))


QUERIES = {
    f.__name__: f
    for f in (notice_page, review_page, active_notices, notice_metrics, notice_manifest, flagged_page, logs_page, log_retention, reports_page, report_increment, unknown_reports, report_validation, json_props)
}
LOGS = """(SELECT event_id AS id, event_type AS "logType", props AS description, ts AS "createdAt" FROM events)"""
COUNTED = "SELECT user_id AS id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id"
ORACLES = {
    "notice_page": f"""SELECT id, kind, "activeFrom", "activeTo" FROM {NOTICES} WHERE NOT "needsReview" AND {ACTIVE} ORDER BY "activeFrom" DESC, id LIMIT 101""",
    "review_page": f"""SELECT id, kind, "activeFrom", "activeTo" FROM {NOTICES} WHERE "needsReview" AND kind = 'alert' ORDER BY "activeFrom" DESC, id LIMIT 11 OFFSET 20""",
    "active_notices": f"""SELECT id, kind, "activeFrom", "activeTo" FROM {NOTICES} WHERE {ACTIVE}""",
    "notice_metrics": f"""SELECT k.kind, count(x.id) AS total, count(x.id) FILTER (WHERE NOT "needsReview") AS public, count(x.id) FILTER (WHERE "needsReview") AS needs_review,
  count(x.id) FILTER (WHERE NOT "needsReview" AND {ACTIVE}) AS active_public, count(x.id) FILTER (WHERE "needsReview" AND {ACTIVE}) AS active_review
FROM (VALUES {", ".join(f"('{k}')" for k in PRIORITIES)}) k(kind) LEFT JOIN {NOTICES} x ON x.category = k.kind GROUP BY k.kind""",
    "notice_manifest": f"""SELECT *, sha256(CAST("count" AS VARCHAR) || ':' || coalesce(strftime(updated, '%Y-%m-%dT%H:%M:%S.%g') || 'Z', '0')) AS revision FROM (
  SELECT count(*) AS "count", max("updatedAt") AS updated, min("activeTo") FILTER (WHERE "activeFrom" <= TIMESTAMP '{AS_OF}' AND "activeTo" > TIMESTAMP '{AS_OF}') AS next_expiry
  FROM {NOTICES} WHERE NOT "needsReview")""",
    "flagged_page": f"""SELECT id, reports, "updatedAt" AS "createdAt" FROM {NOTICES} JOIN (SELECT l_orderkey AS id, count(*) AS reports FROM lineitem GROUP BY 1) USING (id)
WHERE reports >= 7 ORDER BY reports DESC, "createdAt" DESC, id LIMIT 51""",
    "logs_page": f"""SELECT * FROM {LOGS} WHERE "logType" = 'error' AND "createdAt" >= TIMESTAMP '2024-01-10' ORDER BY "createdAt" DESC, id LIMIT 201 OFFSET 10""",
    "log_retention": f"""SELECT * FROM {LOGS} WHERE "createdAt" >= TIMESTAMP '{LOG_AS_OF}' - INTERVAL 14 DAYS""",
    "reports_page": f"""SELECT id, true AS resolved, "createdAt" FROM {LOGS} WHERE "logType" = 'signup' ORDER BY "createdAt" DESC, id LIMIT 26""",
    "report_increment": f"SELECT c_custkey + 50 AS id, CAST(c_nationkey + coalesce(n, 0) AS INT) AS reports FROM customer LEFT JOIN ({COUNTED}) e ON e.id = c_custkey + 50",
    "unknown_reports": f"SELECT id FROM ({COUNTED}) WHERE id NOT IN (SELECT c_custkey + 50 FROM customer)",
    "report_validation": """SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 9 = 0 THEN 'title' END,
  CASE WHEN coalesce(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), 0) NOT BETWEEN 1 AND 1000 THEN 'description' END,
  CASE WHEN doc_id % 200 - 100 NOT BETWEEN -90 AND 90 THEN 'latitude' END, CASE WHEN doc_id % 400 - 200 NOT BETWEEN -180 AND 180 THEN 'longitude' END) AS errors FROM documents""".replace("\\\\", "\\"),
    "json_props": "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, max(k) AS most FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type",
}
