"""Zone import and text-fact queries bound to part, orders and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import text
from tidemark.operators import snapshot
from tidemark.schemas import MapLayer

#: Layers by the names of parts; the first match wins.
PART_LAYERS = (MapLayer("ring-like", "(?i)ring|gear", placemarks="^small"), MapLayer("blue", "(?i)^BLUE "), MapLayer("bolts", "bolt"))


def layer_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    layer = snapshot.layer_of(F.col("p_name"), PART_LAYERS)
    rows = p.select("p_partkey", "p_name", layer.alias("layer")).filter("layer IS NOT NULL")
    return rows.filter(snapshot.wanted_placemark(F.col("layer"), F.col("p_name"), PART_LAYERS)).select("p_partkey", "layer")


def zone_group(spark, sf_dir):
    """Conversations as placemarks: the role is the folder, a name repeats in other cases and spacing, shapes repeat."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    k = F.col("conv_id")
    name = F.when(k % 2 == 0, F.concat(F.lit("Zone  "), (k % 40).cast("string"))).otherwise(F.concat(F.lit(" zone "), (k % 40).cast("string"), F.lit(" ")))
    point = lambda a, b: F.struct(a.cast("double").alias("lon"), b.cast("double").alias("lat"))
    line = F.struct(F.lit("line").alias("type"), F.array(point(k % 3, F.lit(1)), point(k % 3 + 1, F.col("turn") % 2)).alias("points"))
    rows = c.select(k.cast("int").alias("folder_idx"), F.col("turn").cast("int").alias("placemark_idx"), F.col("role").alias("folder"), name.alias("name"), F.when(F.col("turn") > 1, F.col("text")).otherwise("").alias("description"), F.array(line).alias("geometries"))
    layers = tuple(MapLayer(r, f"^{r}$") for r in ("user", "assistant", "system"))
    z = snapshot.zones(rows, layers=layers)
    return z.select("layer", "subKey", "zoneName", F.size("geometries").alias("shapes"), "sourceDescription")


def _as_notices(spark, sf_dir, when: str) -> DataFrame:
    """Orders before a day as notices of the zone map, one for each customer: the latest."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").filter(F.col("o_orderdate") < F.lit(when).cast("timestamp_ntz"))
    last = o.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderdate", "o_orderpriority", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("o"))
    none = F.lit(None)
    return last.select(
        F.col("o_custkey").cast("string").alias("id"), F.lit("alert").alias("kind"), F.col("o.o_orderpriority").alias("category"), F.concat(F.lit("Order "), F.col("o.o_orderkey")).alias("title"), F.lit("d").alias("description"),
        F.lit(schemas.ZONE_SOURCE).alias("source"), none.cast("string").alias("noticeRef"), none.cast("string").alias("sourceUrl"), F.col("o_custkey").cast("string").alias("subKey"), none.cast("string").alias("locationLabel"),
        F.array().cast(schemas.AREAS).alias("areas"), F.when(F.col("o.o_orderkey") % 3 == 0, F.col("o.o_totalprice")).alias("distance"), F.col("o.o_orderdate").alias("publishedAt"), F.col("o.o_orderdate").alias("activeFrom"), none.cast("timestamp_ntz").alias("activeTo"),
        F.lit(False).alias("needsReview"), F.array().cast("array<string>").alias("reviewReasons"), (F.col("o_custkey") % 5).cast("int").alias("reports"), F.col("o.o_orderdate").alias("createdAt"), F.col("o.o_orderdate").alias("updatedAt"),
    )


BEFORE, AFTER, NOW = "1995-06-01", "1995-09-01", "1995-09-01 12:00:00"


def snapshot_merge(spark, sf_dir):
    """Two cuts of the orders as the stored and the new snapshot; customers divisible by 11 are missing from the new one."""
    new = _as_notices(spark, sf_dir, AFTER).filter("CAST(subKey AS BIGINT) % 11 <> 0")
    merged = snapshot.merge(_as_notices(spark, sf_dir, BEFORE), new, F.lit(NOW).cast("timestamp_ntz"))
    return merged.select("subKey", "action", "title", "distance", "reports", "updatedAt")


def stale_keys(spark, sf_dir):
    new = _as_notices(spark, sf_dir, AFTER).filter("CAST(subKey AS BIGINT) % 11 <> 0")
    return snapshot.stale_keys(_as_notices(spark, sf_dir, BEFORE), new)


def fact_extract(spark, sf_dir):
    """Sentences made of orders' dates and numbers, and the facts read back from them."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "d")
    start = F.concat(F.lit("These limits<br>are in place <b>from the "), day, F.lit("th of "), F.date_format("o_orderdate", "MMMM yyyy"), F.lit(" until "), day, F.lit(" "), F.date_format("o_orderdate", "MMMM"), F.lit(" "), (F.year("o_orderdate") + 1).cast("string"), F.lit(". "))
    far = F.when(k % 3 == 0, F.concat(F.lit("Keep a distance of "), (k % 500).cast("string"), F.lit("m. "))).when(k % 3 == 1, F.concat(F.lit("A zone of "), (k % 9).cast("string"), F.lit(".5 NM applies. "))).otherwise("Speed 3 knots. ")
    notice = F.when(k % 2 == 0, F.concat(F.lit("Local Notice to Mariners No. "), (k % 100).cast("string"), F.lit(" of "), F.year("o_orderdate").cast("string"), F.lit(" at https://example.org/"), k, F.lit(". "))).otherwise("")
    rows = o.select("o_orderkey", F.concat(start, far, notice).alias("t"))
    return rows.select("o_orderkey", text.facts(F.col("t")).alias("f")).select("o_orderkey", "f.*")


def description_compose(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    lines = F.transform(F.sequence(F.lit(1), (k % 15 + 1).cast("int")), lambda i: F.when(i % 4 == 0, " ").otherwise(F.concat(F.lit(" rule "), i.cast("string"))))
    return c.select("c_custkey", F.sha2(text.compose_description(F.concat(F.lit(" "), "c_name"), lines), 256).alias("description_sha256"))


def number_texts(spark, sf_dir):
    """Prices and odd texts through the number parser."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey") % 6
    raw = F.when(k == 0, F.lit("")).when(k == 1, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" "))).when(k == 2, F.concat(F.lit("0x"), F.hex("p_size"))).when(k == 3, F.lit("Infinity")).when(k == 4, F.concat("p_size", F.lit("d"))).otherwise(F.concat("p_size", F.lit(".5e1")))
    n = text.parse_number(raw)
    return p.select("p_partkey", n.alias("n"), text.number_text(n).alias("shown"))


QUERIES = {f.__name__: f for f in (layer_match, zone_group, snapshot_merge, stale_keys, fact_extract, description_compose, number_texts)}
_cut = lambda when: f"""(SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '{when}' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)"""
ORACLES = {
    "layer_match": """SELECT p_partkey, layer FROM (SELECT p_partkey, p_name, CASE WHEN regexp_matches(lower(p_name), 'ring|gear') THEN 'ring-like' WHEN lower(p_name) LIKE 'blue %' THEN 'blue' WHEN contains(p_name, 'bolt') THEN 'bolts' END AS layer FROM part)
WHERE layer IS NOT NULL AND (layer <> 'ring-like' OR p_name LIKE 'small%')""",
    "zone_group": r"""
WITH r AS (SELECT role AS layer, 'zone ' || conv_id % 40 AS ident, CASE WHEN conv_id % 2 = 0 THEN 'Zone ' ELSE 'zone ' END || conv_id % 40 AS name, CASE WHEN turn > 1 THEN text ELSE '' END AS d, conv_id, turn,
  least(conv_id % 3 || ',1;' || conv_id % 3 + 1 || ',' || turn % 2, conv_id % 3 + 1 || ',' || turn % 2 || ';' || conv_id % 3 || ',1') AS shape FROM conversations)
SELECT layer, layer || ':' || left(sha256(ident), 20) AS "subKey", arg_min(name, conv_id * 1000 + turn) AS "zoneName", CAST(count(DISTINCT shape) AS INT) AS shapes, coalesce(arg_min(d, conv_id * 1000 + turn) FILTER (WHERE d <> ''), '') AS "sourceDescription"
FROM r GROUP BY layer, ident""",
    "snapshot_merge": f"""
SELECT coalesce(CAST(a.o_custkey AS VARCHAR), CAST(b.o_custkey AS VARCHAR)) AS "subKey", CASE WHEN a.o_custkey IS NULL THEN 'insert' WHEN b.o_custkey IS NULL THEN 'delete' WHEN a.o_orderkey = b.o_orderkey THEN 'keep' ELSE 'update' END AS action,
  'Order ' || coalesce(b.o_orderkey, a.o_orderkey) AS title, CASE WHEN coalesce(b.o_orderkey, a.o_orderkey) % 3 = 0 THEN coalesce(b.o_totalprice, a.o_totalprice) END AS distance,
  CASE WHEN a.o_custkey IS NULL THEN 0 ELSE CAST(a.o_custkey % 5 AS INT) END AS reports, CASE WHEN b.o_orderkey IS NULL OR a.o_orderkey = b.o_orderkey THEN a.o_orderdate ELSE TIMESTAMP '{NOW}' END AS "updatedAt"
FROM {_cut(BEFORE)} a FULL JOIN (SELECT * FROM {_cut(AFTER)} WHERE o_custkey % 11 <> 0) b ON a.o_custkey = b.o_custkey""",
    "stale_keys": f"""SELECT CAST(o_custkey AS VARCHAR) AS "subKey" FROM {_cut(BEFORE)} WHERE o_custkey % 11 = 0""",
    "fact_extract": """
SELECT o_orderkey, o_orderdate AS valid_from, TRY_CAST(year(o_orderdate) + 1 || strftime(o_orderdate, '-%m-%d') || ' 23:59:59.999' AS TIMESTAMP) AS valid_to,
  CASE WHEN o_orderkey % 2 = 0 AND year(o_orderdate) >= 2000 THEN make_timestamp(year(o_orderdate), 1, 1, 0, 0, 0) END AS notice_date,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Local Notice to Mariners No. ' || o_orderkey % 100 || ' of ' || year(o_orderdate) END AS reference, CASE WHEN o_orderkey % 2 = 0 THEN 'https://example.org/' || o_orderkey END AS url,
  CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 500 > 0 THEN CAST(o_orderkey % 500 AS DOUBLE) WHEN o_orderkey % 3 = 1 THEN (o_orderkey % 9 + CAST(0.5 AS DOUBLE)) * 1852 END AS distance
FROM orders""",
    "description_compose": """SELECT c_custkey, sha256(c_name || chr(10) || chr(10) || 'Restrictions:' || chr(10) || array_to_string([('- rule ' || i) FOR i IN range(1, CAST(least(12, c_custkey % 15 + 1) AS BIGINT) + 1) IF i % 4 <> 0], chr(10))) AS description_sha256 FROM customer""",
    "number_texts": """SELECT p_partkey, n, CASE WHEN n = floor(n) THEN CAST(CAST(n AS BIGINT) AS VARCHAR) ELSE CAST(n AS VARCHAR) END AS shown FROM (
  SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 0.0 WHEN 1 THEN CAST(p_size AS DOUBLE) WHEN 2 THEN CAST(p_size AS DOUBLE) WHEN 5 THEN p_size * 10.0 + 5 END::DOUBLE AS n FROM part)""",
}
