"""The corpus operators applied to the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language, quality, warc
from tidemark.llm.bpe import bpe_encode
from tidemark.llm.common import documents
from tidemark.llm.embedding_dedup import embedding_groups
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.packing import pack_documents
from tidemark.llm.pii import BASE, listed, of_kind, pii_spans
from tidemark.llm.simhash import simhash_groups


def vocabulary(name: str) -> str:
    """A public tokenizer file. It is installed on every machine; only its path is handed around."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = warc.resolve_revisits(warc.page_captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return done.select("record_id", "canonical_url", "status", "matched_id", F.sha2(warc.header_list(F.col("headers")), 256).alias("headers_sha256"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii_spans(documents(spark, sf_dir).select("doc_id", "text"))
    number = [F.array_size(F.array_compact(F.transform("spans", of_kind(k)))).cast("long").alias(f"n_{k}") for k in BASE]
    spans = F.col("spans")
    return done.select("doc_id", *number, F.sha2(listed(spans, only_base=True), 256).alias("base_sha256"), listed(spans).alias("spans"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe_encode(documents(spark, sf_dir).select("doc_id", "text"), vocabulary("byte_bpe_50k.json"), with_ids=False)
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pack_documents(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))
    return done.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = simhash_groups(documents(spark, sf_dir))
    # the bytes are little-endian; F.reverse would take them for characters
    digits = F.concat(*[F.hex(F.substring("fp", k, 1)) for k in range(8, 0, -1)])
    return done.select("doc_id", F.lower(digits).alias("fingerprint"), "component_id")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def _fold(folds: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.train(docs.filter(_fold(4) != 2))
    done = language.identify(docs.select("doc_id", "text"), model)
    return done.select("doc_id", (_fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality.train(docs, labels.filter(_fold(5) != 0))
    done = quality.judge(docs, model)
    return done.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", "predicted")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_revisits": op1_warc_revisits,
    "op2_line_dedup": op2_line_dedup,
    "op3_pii": op3_pii,
    "op4_bpe": op4_bpe,
    "op5_packing": op5_packing,
    "op6_simhash": op6_simhash,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_language": op8_language,
    "op9_quality": op9_quality,
    "op10_embedding_dedup": op10_embedding_dedup,
}
ORACLES: dict[str, str] = {
    "op1_warc_revisits": r"""
WITH p AS (
  SELECT page_id, CAST(page_id AS VARCHAR) AS id, coalesce(html, '') AS html, '"' || md5(coalesce(html, '')) || '"' AS etag,
         TIMESTAMP '2024-01-01' + to_seconds(CAST(page_id AS DOUBLE)) AS start,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
u AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^(?:[^/?@]*@)?([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') AS host,
         regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(lower(q), '^(utm_[a-z]+|fbclid|gclid|msclkid|ref)(=|$)'))) AS query FROM p),
v AS (SELECT *, host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END AS curl FROM u),
f AS (SELECT 'a' || id AS rid, start AS ts, curl, etag, 'page ' || id AS modified, CAST(strlen(html) AS VARCHAR) AS size FROM v),
r AS (SELECT 'b' || id AS rid, start + INTERVAL 1 DAY AS ts, curl, etag, id, 1 AS n FROM v
      UNION ALL SELECT 'c' || id, start + INTERVAL 2 DAY, curl, CASE WHEN page_id % 7 = 0 THEN '"none"' ELSE etag END, id, 2 FROM v),
j AS (SELECT r.*, f.rid AS m, f.etag AS old, f.modified, f.size FROM r LEFT JOIN f ON r.curl = f.curl AND (f.ts, f.rid) < (r.ts, r.rid)
      QUALIFY row_number() OVER (PARTITION BY r.rid ORDER BY f.ts DESC NULLS LAST, f.rid DESC) = 1)
SELECT rid AS record_id, curl AS canonical_url, 'full' AS status, NULL AS matched_id,
       sha256(concat_ws(chr(10), 'content-length:' || size, 'etag:' || etag, 'last-modified:' || modified, 'server:a')) AS headers_sha256 FROM f
UNION ALL
SELECT rid, curl, CASE WHEN m IS NULL THEN 'no_response' WHEN old = etag THEN 'resolved' ELSE 'mismatch' END, CASE WHEN old = etag THEN m END,
       sha256(CASE WHEN n = 1 AND old = etag THEN concat_ws(chr(10), 'content-length:' || size, 'etag:W/' || etag, 'expires:' || id, 'last-modified:' || modified, 'server:a')
                   WHEN n = 1 THEN concat_ws(chr(10), 'etag:W/' || etag, 'expires:' || id, 'server:b')
                   WHEN old = etag THEN concat_ws(chr(10), 'content-length:' || size, 'date:' || id, 'etag:' || etag, 'last-modified:' || modified, 'server:a')
                   ELSE concat_ws(chr(10), 'content-length:0', 'date:' || id, 'etag:' || etag) END) FROM j""",
    "op2_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.doc_id, k.pos, k.line, often.key IS NOT NULL AS gone FROM k LEFT JOIN often USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op7_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
