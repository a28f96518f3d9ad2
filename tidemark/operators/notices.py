"""Notices and reports: predicates, pages, metrics, change tokens, served form and changes by hand."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import geo, text


class Invalid(ValueError):
    """An argument or a row that isn't accepted."""


# Arguments.


@dataclass(frozen=True)
class Page:
    """Arguments of a paged list."""

    limit: int = 100
    offset: int = 0
    kind: str | None = None
    active_only: bool = True

    def __post_init__(self):
        if not 1 <= self.limit <= 500:
            raise Invalid("limit must be 1 to 500")
        if self.offset < 0:
            raise Invalid("offset must not be negative")
        if self.kind not in (None, *schemas.KINDS):
            raise Invalid(f"kind must be one of {', '.join(schemas.KINDS)}")


def page_args(query: dict[str, str], review: bool = False) -> Page:
    """Typed arguments of a query; a review lists inactive notices too unless told otherwise."""
    unknown = set(query) - {"limit", "offset", "kind", "activeOnly"}
    if unknown:
        raise Invalid(f"unknown arguments: {', '.join(sorted(unknown))}")

    def number(name, default):
        raw = query.get(name, "")
        if raw == "":
            return default
        try:
            return int(raw)
        except ValueError:
            raise Invalid(f"{name} must be a whole number") from None

    active = query.get("activeOnly", "")
    if active not in ("", "true", "false"):
        raise Invalid("activeOnly must be true or false")
    return Page(number("limit", 100), number("offset", 0), query.get("kind") or None, active == "true" if active else not review)


# Predicates.


def active(now: Column, start: str = "activeFrom", end: str = "activeTo") -> Column:
    """Both ends count; without an end a notice stays active."""
    begun = F.col(start) <= now
    return (begun & (F.col(end) >= now)) | (begun & F.col(end).isNull())


def visible(rows: DataFrame, needs_review: bool = False, kind: str | None = None) -> DataFrame:
    rows = rows.filter(F.col("needsReview") == needs_review)
    return rows.filter(F.col("kind") == kind) if kind else rows


# Pages. One row more than the limit is read; it tells whether another page follows.


def page(rows: DataFrame, order: list, limit: int, offset: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit + 1)


def notice_page(notices: DataFrame, args: Page, now: Column, needs_review: bool = False) -> DataFrame:
    rows = visible(notices, needs_review, args.kind)
    if args.active_only:
        rows = rows.filter(active(now))
    return page(rows, [F.desc("activeFrom"), "id"], args.limit, args.offset)


def flagged_page(notices: DataFrame, least: int = 1, limit: int = 100, offset: int = 0) -> DataFrame:
    return page(notices.filter(F.col("reports") >= least), [F.desc("reports"), F.desc("createdAt"), "id"], limit, offset)


def logs_page(logs: DataFrame, kind: str | None = None, since: Column | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    if kind:
        logs = logs.filter(F.col("logType") == kind)
    if since is not None:
        logs = logs.filter(F.col("createdAt") >= since)
    return page(logs, [F.desc("createdAt"), "id"], limit, offset)


def reports_page(reports: DataFrame, resolved: bool = False, limit: int = 100, offset: int = 0) -> DataFrame:
    return page(reports.filter(F.col("resolved") == resolved), [F.desc("createdAt"), "id"], limit, offset)


def envelope(rows: list, args: Page) -> dict:
    return {"items": rows[: args.limit], "limit": args.limit, "offset": args.offset, "hasMore": len(rows) > args.limit}


def page_links(path: str, filters: dict[str, str], args: Page, has_more: bool) -> dict[str, str | None]:
    """Links to the page before and after, with the filters kept."""
    from urllib.parse import urlencode

    to = lambda offset: f"{path}?{urlencode({**filters, 'limit': args.limit, 'offset': offset})}"
    return {"prev": to(max(0, args.offset - args.limit)) if args.offset else None, "next": to(args.offset + args.limit) if has_more else None}


# Metrics and change tokens.


def metrics(notices: DataFrame, kinds: DataFrame, now: Column) -> DataFrame:
    """(kind, total, public, needs_review, active_public, active_review) for each kind of the dimension, zero-filled.

    One pass over the notices, counted before the shuffle; sums over the rows are the grand totals.
    """
    review, live = F.col("needsReview"), active(now)
    counts = {"total": F.lit(True), "public": ~review, "needs_review": review, "active_public": live & ~review, "active_review": live & review}
    found = notices.groupBy("kind").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    return kinds.join(found, "kind", "left").select("kind", *[F.coalesce(n, F.lit(0)).alias(n) for n in counts])


def manifest(notices: DataFrame, now: Column) -> DataFrame:
    """(count, updated, next_expiry, revision) of public notices. An end equal to ``now`` has expired here."""
    public = notices.filter("NOT needsReview")
    upcoming = F.when((F.col("activeFrom") <= now) & (F.col("activeTo") > now), F.col("activeTo"))
    row = public.agg(F.count(F.lit(1)).alias("count"), F.max("updatedAt").alias("updated"), F.min(upcoming).alias("next_expiry"))
    return row.withColumn("revision", F.sha2(F.concat_ws(":", "count", F.coalesce(text.iso_millis(F.col("updated")), F.lit("0"))), 256))


# Served form.


def served(notices: DataFrame, *more: str) -> DataFrame:
    """Public columns with derived geometry, and the columns ``more`` as they are. Apply after the page is cut."""
    anchors = geo.representative_points(F.col("areas"))
    return notices.withColumn("anchors", anchors).select(
        "id", "kind", "category", "title", "description", "source", "noticeRef", "sourceUrl", "locationLabel",
        text.iso_millis(F.col("activeFrom")).alias("activeFrom"), text.iso_millis(F.col("activeTo")).alias("activeTo"), "distance",
        F.coalesce("reviewReasons", F.array().cast("array<string>")).alias("reviewReasons"),
        geo.features(F.col("areas")).alias("geometry"), F.get("anchors", 0).alias("representativePoint"), F.col("anchors").alias("representativePoints"),
        geo.bounding_circle(F.col("areas"), F.col("distance")).alias("boundingCircle"), *more,
    )


def served_flagged(notices: DataFrame) -> DataFrame:
    """For the administrator only: the served form with the number of reports."""
    return served(notices, "reports")


def kind_rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in schemas.KINDS]), kind)


def zone_map(notices: DataFrame) -> DataFrame:
    """One row for each part that can be drawn, kinds in their order, newest first."""
    parts = geo.features(F.col("areas"))
    rows = notices.withColumn("f", F.explode(parts))
    shown = rows.select(
        F.col("id").alias("noticeId"), "f.part", "f.geometry", "title", "kind", "category", "description", "locationLabel", "source", "sourceUrl", "noticeRef", "distance",
        (F.col("source") == schemas.ZONE_SOURCE).alias("community"), "needsReview", "reviewReasons", "reports", "activeFrom", "activeTo",
    )
    return shown.orderBy(kind_rank(F.col("kind")), F.desc("activeFrom"), "noticeId", "part")


def zone_map_totals(zones: DataFrame) -> DataFrame:
    return zones.agg(F.count_distinct("noticeId").alias("total"), F.count_distinct(F.when(F.col("community"), F.col("noticeId"))).alias("community"))


# Validation.


def report_errors(title: Column, description: Column, latitude: Column, longitude: Column) -> Column:
    """What is wrong with a report by a user."""
    t, d = text.trim(title), text.trim(description)
    wrong = F.array(
        F.when(F.coalesce(F.length(t), F.lit(0)).between(1, 255), None).otherwise("title"),
        F.when(F.coalesce(F.length(d), F.lit(0)).between(1, 1000), None).otherwise("description"),
        F.when(F.coalesce(latitude.between(-90, 90), F.lit(False)), None).otherwise("latitude"),
        F.when(F.coalesce(longitude.between(-180, 180), F.lit(False)), None).otherwise("longitude"),
    )
    return F.filter(wrong, lambda x: x.isNotNull())


def accept_reports(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports to store, and those refused: invalid, or with a word that isn't wanted."""
    wrong = report_errors(F.col("title"), F.col("description"), F.col("latitude"), F.col("longitude"))
    marked = reports.withColumn("errors", wrong).withColumn("swears", text.swears(F.concat_ws("\n", "title", "description"), schemas.SWEAR_WORDS))
    bad = (F.size("errors") > 0) | F.col("swears")
    good = marked.filter(~bad).drop("errors", "swears").withColumns({"title": text.trim(F.col("title")), "description": text.trim(F.col("description")), "resolved": F.lit(False)})
    return good, marked.filter(bad)


#: The least number of points of each kind of part.
LEAST_POINTS = {"point": 1, "line": 2, "polygon": 3}
PART_KEYS, POINT_KEYS = {"label", "geometryType", "points"}, {"lat", "long"}
NOTICE_KEYS = {"kind", "category", "title", "description", "source", "noticeRef", "sourceUrl", "subKey", "locationLabel", "areas", "distance", "publishedAt", "activeFrom", "activeTo"}


def area_errors(areas: Column) -> Column:
    """Whether each part has a known type, enough points, and coordinates in range."""

    def bad(p):
        enough = F.lit(False)
        for kind, least in LEAST_POINTS.items():
            enough = enough | ((p["geometryType"] == kind) & (F.size(p["points"]) >= least))
        inside = F.forall(p["points"], lambda q: F.coalesce(q["lat"].between(-90, 90) & q["long"].between(-180, 180), F.lit(False)))
        return ~F.coalesce(enough & inside, F.lit(False))

    return F.when(F.exists(areas, bad), "areas")


def parse_notices(rows: DataFrame, column: str = "json") -> DataFrame:
    """``rows`` with notice (a struct) and errors, from JSON texts; areas may be JSON within JSON, '' counts as unset, and unknown names are refused."""
    # parsed once: the plan keeps these columns apart from those that use them
    v, areas_text = F.col("__json"), F.col("__areas")
    inner = F.try_variant_get(v, "$.areas", "variant")
    raw = lambda k: F.nullif(F.try_variant_get(v, f"$.{k}", "string"), F.lit(""))
    read = rows.withColumn("__json", F.try_parse_json(column)).withColumn("__areas", F.when(F.schema_of_variant(inner) == "STRING", raw("areas")).otherwise(F.to_json(inner)))
    areas = F.from_json(areas_text, schemas.AREAS)
    unknown = lambda keys, known: F.size(F.array_except(keys, F.array(*[F.lit(k) for k in sorted(known)]))) > 0
    parts = F.from_json(areas_text, "array<map<string,string>>")
    points = F.from_json(areas_text, "array<struct<points:array<map<string,string>>>>")
    extra = unknown(F.json_object_keys(column), NOTICE_KEYS) | F.coalesce(F.exists(parts, lambda p: unknown(F.map_keys(p), PART_KEYS)), F.lit(False))
    extra = extra | F.coalesce(F.exists(points, lambda p: F.exists(p["points"], lambda q: unknown(F.map_keys(q), POINT_KEYS))), F.lit(False))
    stamp = lambda k: F.try_to_timestamp(raw(k)).cast("timestamp_ntz")
    distance = raw("distance").try_cast("double")
    notice = F.struct(
        raw("kind").alias("kind"), raw("category").alias("category"), text.some(raw("title")).alias("title"), text.some(raw("description")).alias("description"), F.coalesce(raw("source"), F.lit("manual")).alias("source"),
        F.coalesce(raw("subKey"), F.lit("")).alias("subKey"), raw("noticeRef").alias("noticeRef"), raw("sourceUrl").alias("sourceUrl"), raw("locationLabel").alias("locationLabel"),
        F.coalesce(areas, F.array().cast(schemas.AREAS)).alias("areas"), distance.alias("distance"), stamp("publishedAt").alias("publishedAt"), stamp("activeFrom").alias("activeFrom"), stamp("activeTo").alias("activeTo"),
    )
    out = read.withColumn("notice", notice)
    wrong = F.array(
        F.when(v.isNull(), "json"),
        F.when(extra, "unknown name"),
        F.when(~F.coalesce(F.col("notice.kind").isin(*schemas.KINDS), F.lit(False)), "kind"),
        F.when(F.col("notice.title").isNull(), "title"),
        F.when(F.col("notice.activeFrom").isNull(), "activeFrom"),
        F.when(raw("distance").isNotNull() & ~F.coalesce(distance >= 0, F.lit(False)), "distance"),
        F.when(areas_text.isNotNull() & areas.isNull(), "areas").otherwise(area_errors(F.col("notice.areas"))),
    )
    return out.withColumn("errors", F.filter(wrong, lambda x: x.isNotNull())).drop("__json", "__areas")


# Changes.


def count_reports(notices: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notices with the events (id) added to their reports, and the ids that no notice has."""
    found = events.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("__n"))
    more = notices.join(found, "id", "left").withColumn("reports", F.col("reports") + F.coalesce("__n", F.lit(0))).drop("__n")
    return more, found.join(notices.select("id"), "id", "left_anti").select("id")


def _change(rows: DataFrame, id_: str, **columns: Column) -> DataFrame:
    if rows.filter(F.col("id") == id_).isEmpty():
        raise KeyError(id_)
    mine = F.col("id") == id_
    return rows.withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in columns.items()})


def approve(notices: DataFrame, id_: str) -> DataFrame:
    return _change(notices, id_, needsReview=F.lit(False), reviewReasons=F.array().cast("array<string>"))


def dismiss(notices: DataFrame, id_: str) -> DataFrame:
    return _change(notices, id_, reports=F.lit(0))


def remove(rows: DataFrame, id_: str) -> DataFrame:
    """Reject a notice, or delete a report."""
    return _change(rows, id_).filter(F.col("id") != id_)


def resolve(reports: DataFrame, id_: str) -> DataFrame:
    return _change(reports, id_, resolved=F.lit(True))


def add(notices: DataFrame, made: DataFrame, logs: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Notices made by hand skip the review; each is logged. A second one with the same (source, subKey) is refused."""
    key = ["source", "subKey"]
    if not made.groupBy(*key).count().filter("count > 1").isEmpty() or not made.join(notices, key, "left_semi").isEmpty():
        raise Invalid("a notice with this source and subKey exists")
    rows = made.withColumns({"id": F.uuid(), "needsReview": F.lit(False), "reviewReasons": F.array().cast("array<string>"), "reports": F.lit(0), "createdAt": now, "updatedAt": now})
    line = rows.select(F.lit(None).cast("bigint").alias("id"), F.lit("info").alias("logType"), F.concat(F.lit("Notice added: "), "title").alias("description"), now.alias("createdAt"))
    return notices.unionByName(rows.withColumn("publishedAt", F.coalesce("publishedAt", "activeFrom")).select(notices.columns)), logs.unionByName(line)


def log(logs: DataFrame, description: str, now: Column, kind: str = "info") -> DataFrame:
    line = logs.sparkSession.range(1).select(F.lit(None).cast("bigint").alias("id"), F.lit(kind).alias("logType"), F.lit(description).alias("description"), now.alias("createdAt"))
    return logs.unionByName(line)


def retained(logs: DataFrame, now: Column, days: int = 14) -> DataFrame:
    return logs.filter(F.col("createdAt") >= now - F.expr(f"INTERVAL {days} DAYS"))
