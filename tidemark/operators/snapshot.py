"""Importing the zone map: from placemarks to zones, to notices, to a guarded merge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import geo, text

LEAST_ZONES, LEAST_RATIO = 50, 0.6
#: Why a zone needs a look, and marks of descriptions of other formats.
ENRICHMENT_FAILED, NO_DESCRIPTION = "community-map-ai-enrichment-failed", "community-map-source-description-missing"
UNVERIFIED, ACTION = "Source details require manual verification.", "\n\nRecommended action:"
KEY = ["source", "subKey"]
#: Columns that an import writes. Reports are counted by others and stay.
OWNED = ("kind", "category", "title", "description", "noticeRef", "sourceUrl", "locationLabel", "areas", "distance", "publishedAt", "activeFrom", "activeTo", "needsReview", "reviewReasons")
COMPARED = ("kind", "title", "description", "activeFrom", "activeTo", "category", "noticeRef", "sourceUrl", "distance", "needsReview", "reviewReasons", "areas")


class UnsafeSnapshot(ValueError):
    """A snapshot that would destroy too much."""


def layer_of(folder: Column, layers=schemas.MAP_LAYERS) -> Column:
    """The key of the first layer whose pattern is in the folder's name."""
    out = F.lit(None).cast("string")
    for d in reversed(layers):
        out = F.when(folder.rlike(d.match), d.key).otherwise(out)
    return out


def _of_layer(layer: Column, values: dict[str, object], default) -> Column:
    out = F.lit(default)
    for key, value in values.items():
        out = F.when(layer == key, F.lit(value)).otherwise(out)
    return out


def wanted_placemark(layer: Column, name: Column, layers=schemas.MAP_LAYERS) -> Column:
    out = F.lit(True)
    for d in layers:
        if d.placemarks:
            out = F.when(layer == d.key, name.rlike(d.placemarks)).otherwise(out)
    return out


def importable(layer: Column, name: Column, geometries: Column, layers=schemas.MAP_LAYERS) -> Column:
    """Shapes of a placemark; points only where the layer has named ones and the name isn't that of a corner marker."""
    points = _of_layer(layer, {d.key: d.named_points for d in layers}, False) & ~name.rlike(text.MARKER)
    return F.filter(geometries, lambda g: (g["type"] != "point") | points)


def zones(placemarks: DataFrame, touches_sea: Callable | None = None, layers=schemas.MAP_LAYERS) -> DataFrame:
    """(layer, zoneName, subKey, geometries, sourceDescription, folderName), one row for each zone.

    Placemarks of one layer with the same name, but for case and white space, are one zone: the first name and folder,
    the first description that isn't empty, and all shapes; of equal shapes the last. Without ``touches_sea`` every
    shape counts as being at sea.
    """
    named = placemarks.withColumn("layer", layer_of(F.col("folder"), layers)).filter("layer IS NOT NULL").withColumn("zoneName", text.zone_name(F.coalesce(F.nullif("name", F.lit("")), F.col("folder"))))
    named = named.filter(wanted_placemark(F.col("layer"), F.col("zoneName"), layers)).withColumn("order", F.struct("folder_idx", "placemark_idx"))
    shapes = named.withColumn("shapes", importable(F.col("layer"), F.col("zoneName"), F.col("geometries"), layers)).select("layer", "zoneName", "folder", "description", "order", F.posexplode("shapes").alias("i", "g"))
    if touches_sea is not None:
        shapes = shapes.filter(touches_sea(F.col("g.type"), F.col("g.points")))
    shapes = shapes.withColumn("subKey", text.sub_key(F.col("layer"), F.col("zoneName"))).withColumn("print", geo.fingerprint(F.col("g.type"), F.col("g.points")))
    key = ["layer", "subKey"]
    unique = shapes.groupBy(*key, "print").agg(F.max_by("g", F.struct("order", "i")).alias("g"))
    geometries = unique.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("print", "g"))), lambda x: x["g"]).alias("geometries"))
    described = F.when(F.col("description") != "", F.col("order"))
    facts = shapes.groupBy(*key).agg(F.min_by("zoneName", "order").alias("zoneName"), F.min_by("folder", "order").alias("folderName"), F.coalesce(F.min_by("description", described), F.lit("")).alias("sourceDescription"))
    return facts.join(geometries, key).select("layer", "zoneName", "subKey", "geometries", "sourceDescription", "folderName")


def assert_safe(snapshot: DataFrame, existing: int, layers=schemas.MAP_LAYERS) -> None:
    r = snapshot.agg(F.count(F.lit(1)).alias("n"), F.collect_set("layer").alias("keys")).first()
    if missing := [d.key for d in layers if d.key not in r["keys"]]:
        raise UnsafeSnapshot(f"the snapshot has no layer {', '.join(missing)}")
    if r.n < LEAST_ZONES:
        raise UnsafeSnapshot(f"the snapshot has {r.n} zones; {LEAST_ZONES} are the least")
    if existing and r.n < existing * LEAST_RATIO:
        raise UnsafeSnapshot(f"the snapshot shrank from {existing} to {r.n} zones")


def areas(label: Column, geometries: Column) -> Column:
    """Parts of a notice from shapes of the map."""
    return F.transform(geometries, lambda g: F.struct(label.alias("label"), g["type"].alias("geometryType"), F.transform(g["points"], lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("long"))).alias("points")))


def facts(snapshot: DataFrame, notices: DataFrame, now: Column, layers=schemas.MAP_LAYERS) -> DataFrame:
    """Zones with what their texts state, joined with the notice that is stored for each (``prior``, null for a new one)."""
    mine = notices.filter(F.col("source") == schemas.ZONE_SOURCE)
    prior = mine.select("subKey", F.struct(*[c for c in mine.columns]).alias("prior"))
    d, folder = F.col("sourceDescription"), F.col("folderName")
    label = text.display_name(F.col("zoneName"))
    rows = snapshot.join(prior, "subKey", "left").withColumns(
        {
            "kind": _of_layer(F.col("layer"), {x.key: x.kind for x in layers}, "alert"),
            "category": F.col("layer"),
            "title": label,
            "locationLabel": label,
            "source": F.lit(schemas.ZONE_SOURCE),
            "brief": _of_layer(F.col("layer"), {x.key: x.brief for x in layers}, ""),
            "seasonalFrom": text.valid_from(d),
            "activeTo": text.valid_to(d),
            "noticeRef": F.coalesce(text.notice_reference(d), text.notice_reference(folder)),
            "sourceUrl": text.source_url(d),
            "distance": text.distance_metres(d),
            "areas": areas(label, F.col("geometries")),
        }
    )
    rows = rows.withColumn("activeFrom", F.coalesce("seasonalFrom", text.notice_date(d), text.notice_date(folder), "prior.activeFrom", now))
    return rows.withColumns(
        {
            "publishedAt": F.coalesce("prior.publishedAt", "activeFrom"),
            "needsReview": F.coalesce("prior.needsReview", F.lit(False)),
            "reviewReasons": F.coalesce("prior.reviewReasons", F.array().cast("array<string>")),
            "factLines": text.fact_lines(F.col("distance"), F.col("seasonalFrom"), F.col("activeTo"), F.col("noticeRef")),
        }
    )


def facts_changed() -> Column:
    """Whether what a stored description was written from differs now. Names are compared by their label: titles may have been rewritten."""
    p = F.col("prior")
    same = lambda c: p[c].eqNullSafe(F.col(c))
    return ~same("locationLabel") | ~same("category") | ~same("distance") | ~same("noticeRef") | ~same("activeTo") | (F.col("seasonalFrom").isNotNull() & (p["activeFrom"] != F.col("seasonalFrom")))


def current_format(description: Column) -> Column:
    return description.contains(f"\n\n{text.RESTRICTIONS}\n") & ~description.contains(ACTION)


def stale() -> Column:
    """Whether a zone's description has to be written anew."""
    p = F.col("prior")
    reasons = F.coalesce(p["reviewReasons"], F.array().cast("array<string>"))
    lacks = F.array_contains(reasons, ENRICHMENT_FAILED) | F.array_contains(reasons, NO_DESCRIPTION)
    return p.isNull() | F.coalesce(~current_format(p["description"]) | lacks | facts_changed(), F.lit(True))


def usable(description: Column) -> Column:
    return F.coalesce((description != "") & ~description.contains(UNVERIFIED), F.lit(False))


def describe(rows: DataFrame, enrich: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``rows`` of facts with the final title, description, needsReview and reviewReasons.

    ``enrich`` gets the stale rows that have a source text (subKey, locationLabel, brief, factLines, plain) and returns
    (subKey, newTitle, summary, restrictions) for those it could write; only these rows go there. The others keep a usable
    description, or get the layer's brief, and are marked for review.
    """
    marked = rows.withColumns({"stale": stale(), "plain": text.plain_source(F.col("sourceDescription"))})
    if enrich is not None:
        made = enrich(marked.filter("stale AND plain <> ''").select("subKey", "locationLabel", "brief", "factLines", "plain"))
        made = made.filter((F.length(text.trim(F.col("newTitle"))) > 0) & (F.size("restrictions") > 0))
        marked = marked.join(made.select("subKey", F.struct("newTitle", "summary", "restrictions").alias("made")), "subKey", "left")
    else:
        marked = marked.withColumn("made", F.lit(None).cast("struct<newTitle:string,summary:string,restrictions:array<string>>"))
    made, p = F.col("made"), F.col("prior")
    fallback = F.when(usable(p["description"]), p["description"]).otherwise(F.col("brief"))
    reason = F.when(F.col("plain") == "", NO_DESCRIPTION).otherwise(ENRICHMENT_FAILED)
    none = F.array().cast("array<string>")
    return marked.withColumns(
        {
            "description": F.when(~F.col("stale"), p["description"]).when(made.isNotNull(), text.compose_description(made["summary"], made["restrictions"])).otherwise(fallback),
            "title": F.when(~F.col("stale"), p["title"]).when(made.isNotNull(), text.trim(made["newTitle"])).otherwise(F.col("title")),
            "needsReview": F.when(F.col("stale"), made.isNull()).otherwise(F.col("needsReview")),
            "reviewReasons": F.when(F.col("stale"), F.when(made.isNull(), F.array(reason)).otherwise(none)).otherwise(F.col("reviewReasons")),
        }
    ).withColumn("usedEnrichment", made.isNotNull())


def merge(notices: DataFrame, rows: DataFrame, now: Column, source: str = schemas.ZONE_SOURCE) -> DataFrame:
    """The notices after an import of ``rows``, each with ``action``: insert, update, keep, delete, or none for other sources.

    One join on (source, subKey). An update takes all owned columns as they are, null included, and keeps the reports;
    rows without a change are kept as they were, so that a second import of the same snapshot writes nothing.
    """
    new = rows.select(*[F.col(c).alias(f"new_{c}") for c in (*KEY, *OWNED)])
    both = notices.join(new, (F.col("source") == F.col("new_source")) & (F.col("subKey") == F.col("new_subKey")), "full_outer")
    old_there, new_there = F.col("source").isNotNull(), F.col("new_subKey").isNotNull()
    same = F.lit(True)
    for c in COMPARED:
        same = same & F.col(c).eqNullSafe(F.col(f"new_{c}"))
    action = (
        F.when(~old_there, "insert")
        .when(F.col("source") != source, "none")
        .when(~new_there, "delete")
        .when(same, "keep")
        .otherwise("update")
    )
    out = both.withColumn("action", action)
    write = F.col("action").isin("insert", "update")
    columns = {c: F.when(write, F.col(f"new_{c}")).otherwise(F.col(c)) for c in (*KEY, *OWNED)}
    insert = F.col("action") == "insert"
    columns |= {
        "id": F.coalesce("id", F.when(insert, F.sha2(F.concat_ws(":", "new_source", "new_subKey"), 256))),
        "reports": F.when(insert, 0).otherwise(F.col("reports")),
        "createdAt": F.when(insert, now).otherwise(F.col("createdAt")),
        "updatedAt": F.when(write, now).otherwise(F.col("updatedAt")),
    }
    return out.select(*[columns.get(c, F.col(c)).alias(c) for c in notices.columns], "action")


def import_summary(merged: DataFrame, described: DataFrame) -> dict[str, int]:
    count = lambda a: F.count_if(F.col("action").isin(*a))
    r = merged.agg(count(["insert", "update"]).alias("upserted"), count(["delete"]).alias("deleted"), count(["keep"]).alias("kept")).first()
    return {"upserted": r.upserted, "deleted": r.deleted, "kept": r.kept, "enriched": described.filter("usedEnrichment").count()}


def stale_keys(notices: DataFrame, rows: DataFrame, source: str = schemas.ZONE_SOURCE) -> DataFrame:
    return notices.filter(F.col("source") == source).select("subKey").join(rows.select("subKey"), "subKey", "left_anti")


def run_import(notices: DataFrame, placemarks: DataFrame, now: Column, touches_sea=None, enrich=None) -> tuple[DataFrame, dict[str, int]]:
    """The whole import: zones, guards, facts, descriptions, merge. Raises before anything is merged if the snapshot is unsafe."""
    snapshot = zones(placemarks, touches_sea)
    assert_safe(snapshot, notices.filter(F.col("source") == schemas.ZONE_SOURCE).count())
    rows = describe(facts(snapshot, notices, now), enrich)
    merged = merge(notices, rows, now)
    return merged.filter("action <> 'delete'").drop("action"), import_summary(merged, rows)


#: Zones that a first import publishes at a time.
BATCH = 8


def bootstrap(table, placemarks: DataFrame, now: Column, touches_sea=None, enrich=None) -> dict[str, int]:
    """The first import into a table without zones: readers get each batch of zones as soon as it is described."""
    snapshot = zones(placemarks, touches_sea)
    assert_safe(snapshot, 0)
    keys = [r.subKey for r in snapshot.select("subKey").orderBy("subKey").collect()]  # names of zones: a map has hundreds
    counts = {"upserted": 0, "deleted": 0, "kept": 0, "enriched": 0}
    for i in range(0, len(keys), BATCH):
        notices = table.read()
        rows = describe(facts(snapshot.filter(F.col("subKey").isin(keys[i : i + BATCH])), notices, now), enrich)
        merged = merge(notices, rows, now)
        made = import_summary(merged.filter("action <> 'delete'"), rows)
        # zones of earlier batches aren't in this one and stay
        table.commit(merged.drop("action"))
        counts = {k: counts[k] + made[k] for k in counts} | {"kept": 0}
    return counts
