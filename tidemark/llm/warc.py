"""Web-archive captures, and the resolution of not-modified revisits.

A revisit holds no body. It is joined as of its own time to the latest earlier full response with the same canonical URL
(earlier by (ts, record_id)), the validators of both are compared, and where they agree the stored headers are brought up
to date with those that a 304 may change.

The join is a fill along a sort: captures are dealt to tasks by ranges of (URL, time), so that one URL may hold any
share of the rows; within a task a window carries the last response forward; between tasks only each task's last response
of a URL is carried, which are as many rows as a URL has tasks. Only the metadata of captures takes part; bodies are
attached by record id.

Cases: no earlier response gives ``no_response``; no validator on both sides gives ``unverified`` (matched, headers not
merged); a validator that differs gives ``mismatch``; full responses give ``full``. ETags compare weakly. Ties in time are
ordered by record_id; repeated records resolve alike; a null URL or time matches nothing; a null ``revisit`` counts as
false and null headers as none; an empty table gives an empty result; other columns are ignored.

Files are parsed record by record, and what is parsed is handed on in bounded batches. Where a file is damaged (a cut
gzip stream or block, a bad length, no record where one must begin), its records before that place are kept, and one row
with ``error`` and nothing else but nulls stands for the rest; a bad date gives a null ``ts``.
"""

from __future__ import annotations

import datetime
import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import session
from tidemark.llm.common import default_partitions

#: Headers of a 304 that replace those of the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that don't tell pages apart.
TRACKING = r"^(utm_[a-z]+|fbclid|gclid|msclkid|ref)(=|$)"
CAPTURES = "record_id string, ts timestamp_ntz, url string, revisit boolean, headers map<string,string>, digest string, body binary"
#: Bytes of bodies of one batch of parsed records.
BATCH_BYTES = 8 << 20


def canonical_url(url):
    """Host without ``www.`` and default port in lower case, path without a slash at the end, sorted query without tracking parameters; no scheme, user or fragment."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^(?:[^/?@]*@)?([^/?]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def _etag(headers):
    return F.regexp_replace(headers["etag"], "^W/", "")


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """(record_id, canonical_url, status, matched_id, headers), one row for each capture."""
    spark = captures.sparkSession
    full = F.struct("ts", "record_id", "digest", "headers")
    meta = captures.select("record_id", "ts", canonical_url(F.col("url")).alias("canonical_url"), F.coalesce("revisit", F.lit(False)).alias("revisit"), "digest", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"))
    known = F.col("canonical_url").isNotNull() & F.col("ts").isNotNull()
    dealt = meta.repartitionByRange(default_partitions(spark), "canonical_url", "ts", "record_id").withColumn("task", F.spark_partition_id())
    rows = session.cut(dealt.withColumn("response", F.when(known & ~F.col("revisit"), full)))

    # the last response that the same task has
    before = Window.partitionBy("task", "canonical_url").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    here = rows.withColumn("found", F.when(F.col("revisit") & known, F.last("response", ignorenulls=True).over(before)))
    # what earlier tasks hand on: a row for each task that shares a URL with another
    spans = rows.filter(known).groupBy("canonical_url", "task").agg(F.max_by("response", F.when(F.col("response").isNotNull(), F.struct("ts", "record_id"))).alias("last"))
    carry = Window.partitionBy("canonical_url").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    handed = spans.withColumn("carried", F.last("last", ignorenulls=True).over(carry)).filter("carried IS NOT NULL").select("canonical_url", "task", "carried")
    joined = here.join(handed, ["canonical_url", "task"], "left").withColumn("match", F.when(F.col("revisit"), F.coalesce("found", "carried")))

    stored = F.col("match.headers")
    both_etag = _etag(stored).isNotNull() & _etag(F.col("headers")).isNotNull()
    both_date = stored["last-modified"].isNotNull() & F.col("headers")["last-modified"].isNotNull()
    both_digest = F.col("match.digest").isNotNull() & F.col("digest").isNotNull()
    same = (
        F.when(both_digest & (F.col("match.digest") != F.col("digest")), False)
        .when(both_etag, _etag(stored) == _etag(F.col("headers")))
        .when(both_date, stored["last-modified"] == F.col("headers")["last-modified"])
        .when(both_digest, True)
    )
    status = F.when(~F.col("revisit"), "full").when(F.col("match").isNull(), "no_response").when(same.isNull(), "unverified").when(same, "resolved").otherwise("mismatch")
    fresh = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(fresh), k))
    merged = F.when(F.col("status") == "resolved", F.map_concat(kept, fresh)).otherwise(F.col("headers"))
    out = joined.withColumn("status", status)
    return out.select("record_id", "canonical_url", "status", F.when(F.col("status").isin("resolved", "unverified"), F.col("match.record_id")).alias("matched_id"), merged.alias("headers"))


def with_bodies(resolved: DataFrame, captures: DataFrame) -> DataFrame:
    """``resolved`` with the body that each capture stands for: its own, or its match's."""
    own = captures.filter("revisit IS NULL OR NOT revisit").select(F.col("record_id").alias("body_id"), "body")
    bodies = own.groupBy("body_id").agg(F.min("body").alias("body"))  # records of one id: the least body
    wanted = resolved.withColumn("body_id", F.when(F.col("status") == "full", F.col("record_id")).when(F.col("status") == "resolved", F.col("matched_id")))
    return wanted.join(bodies, "body_id", "left").drop("body_id")


def header_list(headers):
    """Headers as one text: name:value, sorted by name, one on a line."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), "\n")


# Files.


def parse_warc(data: bytes) -> Iterator[dict]:
    """The response and revisit records of a WARC file, plain or gzipped, one by one."""
    stream = gzip.open(io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    try:
        while line := stream.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            head = _headers(stream)
            size = int(head.get("content-length", 0))
            block = stream.read(size)
            if size < 0 or len(block) < size:
                raise ValueError("a record's block is cut short")
            kind = head.get("warc-type")
            if kind in ("response", "revisit"):
                http, _, body = block.partition(b"\r\n\r\n")
                fields = _headers(io.BytesIO(http.partition(b"\r\n")[2]))
                yield {
                    "record_id": head.get("warc-record-id", "").strip("<>"),
                    "ts": head.get("warc-date"),
                    "url": head.get("warc-target-uri"),
                    "revisit": kind == "revisit",
                    "headers": fields,
                    "digest": head.get("warc-payload-digest"),
                    "body": None if kind == "revisit" else body,
                }
    except (ValueError, EOFError, OSError, zlib.error) as e:  # what follows can't be read
        yield {"error": f"{type(e).__name__}: {e}"}


def _headers(stream) -> dict[str, str]:
    out: dict[str, str] = {}
    while line := stream.readline().strip(b"\r\n"):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def write_warc(records: list[dict]) -> bytes:
    """The inverse of ``parse_warc``, for records with a body in memory."""
    out = []
    for r in records:
        status = b"HTTP/1.1 304 Not Modified" if r["revisit"] else b"HTTP/1.1 200 OK"
        http = b"\r\n".join([status, *[f"{k}: {v}".encode() for k, v in r["headers"].items()]]) + b"\r\n\r\n" + (r["body"] or b"")
        head = {"WARC-Type": "revisit" if r["revisit"] else "response", "WARC-Record-ID": f"<{r['record_id']}>", "WARC-Date": r["ts"], "WARC-Target-URI": r["url"]}
        if r["digest"]:
            head["WARC-Payload-Digest"] = r["digest"]
        if r["revisit"]:
            head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
        head["Content-Length"] = str(len(http))
        out.append(b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items()) + b"\r\n" + http + b"\r\n\r\n")
    return b"".join(out)


def _time(date: str | None) -> datetime.datetime | None:
    try:
        return datetime.datetime.strptime(date[:19], "%Y-%m-%dT%H:%M:%S") if date else None
    except ValueError:
        return None


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Captures of the WARC files at ``path``, and a row with ``error`` for a damaged one; a file is read by one task."""
    fields = [("record_id", pa.string()), ("ts", pa.timestamp("us")), ("url", pa.string()), ("revisit", pa.bool_()), ("headers", pa.map_(pa.string(), pa.string())), ("digest", pa.string()), ("body", pa.binary()), ("error", pa.string())]

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for data in batch.column(0):
                for r in parse_warc(data.as_py()):
                    held.append(r | {"ts": _time(r.get("ts")), "headers": list(r["headers"].items()) if "headers" in r else None})
                    size += 200 + len(r.get("body") or b"")
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema=pa.schema(fields))
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=pa.schema(fields))

    return session.arrow_map(spark.read.format("binaryFile").load(path).select("content"), run, f"{CAPTURES}, error string")


def payload_digest(body: bytes) -> str:
    return "sha256:" + hashlib.sha256(body).hexdigest()


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures made from a table of pages, three for each: the page in full, a revisit a day later that carries its ETag, and one two days later that carries a date and, for every seventh page, another page's ETag."""
    start = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST(page_id AS DECIMAL(18, 6)))")
    html = F.coalesce("html", F.lit(""))
    etag, id_ = F.concat(F.lit('"'), F.md5(html.cast("binary")), F.lit('"')), F.col("page_id").cast("string")
    base = pages.select("page_id", "url", html.alias("html"), start.alias("start"), etag.alias("etag"), id_.alias("id"))
    day = lambda n: F.col("start") + F.expr(f"make_dt_interval({n})")
    mark = F.concat(F.lit("page "), F.col("id"))
    full = F.struct(
        F.concat(F.lit("a"), F.col("id")).alias("record_id"), F.col("start").alias("ts"), F.lit(False).alias("revisit"),
        F.create_map(F.lit("content-length"), F.octet_length("html").cast("string"), F.lit("etag"), F.col("etag"), F.lit("last-modified"), mark, F.lit("server"), F.lit("a")).alias("headers"),
        F.concat(F.lit("sha256:"), F.sha2("html", 256)).alias("digest"), F.col("html").cast("binary").alias("body"),
    )
    first = F.struct(
        F.concat(F.lit("b"), F.col("id")).alias("record_id"), day(1).alias("ts"), F.lit(True).alias("revisit"),
        F.create_map(F.lit("etag"), F.concat(F.lit("W/"), F.col("etag")), F.lit("expires"), F.col("id"), F.lit("server"), F.lit("b")).alias("headers"),
        F.lit(None).cast("string").alias("digest"), F.lit(None).cast("binary").alias("body"),
    )
    wrong = F.when(F.col("page_id") % 7 == 0, '"none"').otherwise(F.col("etag"))
    second = F.struct(
        F.concat(F.lit("c"), F.col("id")).alias("record_id"), day(2).alias("ts"), F.lit(True).alias("revisit"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("etag"), wrong, F.lit("date"), F.col("id")).alias("headers"),
        F.lit(None).cast("string").alias("digest"), F.lit(None).cast("binary").alias("body"),
    )
    return base.select("url", F.explode(F.array(full, first, second)).alias("x")).select("url", "x.*")
