"""Served layers: validation, normalization, summaries, payloads and the rails of a refresh."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schemas, session
from tidemark.functions import geo, text
from tidemark.operators import adapters, classification
from tidemark.sources import geojson, reports


class CatalogError(ValueError):
    """A layer that can't be served."""


class NotFound(KeyError):
    """A layer that isn't configured."""


class Unavailable(RuntimeError):
    """A configured layer that isn't loaded."""


REASONS = ("null geometry", "invalid geometry", "no title")


def dropped_reason(geometry_missing: Column, geometry_valid: Column, title: Column) -> Column:
    """Why a feature can't be served; null if it can."""
    return F.when(geometry_missing, REASONS[0]).when(~geometry_valid, REASONS[1]).when(title.isNull(), REASONS[2])


def with_ids(rows: DataFrame) -> DataFrame:
    """``rows`` (dataset_key, feature_idx, raw_id, ...) with id: ``key:slug``, and -2, -3, ... where it is taken, in order.

    Ids of different slugs can only meet where one slug is another with a number after it. Only such slugs are probed one
    by one, in groups; the ids of all others follow from a row number, which no task counts for a whole slug.
    """
    slug = F.coalesce(F.nullif(text.slug(F.col("raw_id")), F.lit("")), F.concat(F.lit("feature-"), F.col("feature_idx") + 1))
    based = rows.select("dataset_key", "feature_idx", F.concat("dataset_key", F.lit(":"), slug).alias("base"))
    dealt = session.cut(based.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "base", "feature_idx").withColumn("task", F.spark_partition_id()))
    counts = session.cut(dealt.groupBy("base", "task").agg(F.count(F.lit(1)).alias("n")))
    bases = counts.select("base").distinct()
    numbered = bases.select("base", F.regexp_extract("base", r"^(.+)-\d+$", 1).alias("stem")).join(bases.select(F.col("base").alias("stem")), "stem", "left_semi")
    tangled = numbered.select("base").union(numbered.select("stem")).distinct().withColumn("family", F.regexp_replace("base", r"(-\d+)+$", ""))

    # a slug's rows before a task's own, as many rows as a slug has tasks
    before = Window.partitionBy("base").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("base", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    n = F.col("start") + F.row_number().over(Window.partitionBy("task", "base").orderBy("feature_idx"))
    numbers = dealt.join(tangled, "base", "left_anti").join(starts, ["base", "task"]).withColumn("number", n)
    plain = numbers.withColumn("id", F.when(F.col("number") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), "number")))

    def probe(group: pd.DataFrame) -> pd.DataFrame:
        seen, ids = set(), []
        group = group.sort_values("feature_idx")
        for base in group["base"]:
            found, k = base, 2
            while found in seen:
                found, k = f"{base}-{k}", k + 1
            seen.add(found)
            ids.append(found)
        return group.assign(id=ids)[["dataset_key", "feature_idx", "id"]]

    session.ship(rows.sparkSession)
    probed = dealt.join(tangled, "base").select("dataset_key", "feature_idx", "base", "family")
    probed = probed.groupBy("family").applyInPandas(probe, "dataset_key string, feature_idx int, id string")
    ids = plain.select("dataset_key", "feature_idx", "id").unionByName(probed)
    return rows.join(ids, ["dataset_key", "feature_idx"])


def normalize(features: DataFrame, dataset: schemas.Dataset, classes: DataFrame | None = None) -> DataFrame:
    """Every feature of an interactive layer with its reason to be dropped, or its id, box and served properties."""
    if dataset.key not in adapters.ADAPTERS:
        raise CatalogError(f'interactive dataset "{dataset.key}" has no adapter')
    props, geometry = F.coalesce("properties", F.parse_json(F.lit("{}"))), F.col("geometry")
    mine = features.filter(F.col("dataset_key") == dataset.key).withColumn("served", adapters.ADAPTERS[dataset.key](props))
    kind = F.schema_of_variant(geometry)
    rows = mine.withColumn("reason", dropped_reason(~F.coalesce(kind, F.lit("VOID")).startswith("OBJECT"), geo.valid_geometry(geometry, dataset.bounds), F.col("served.title")))
    local = [text.prop(props, k) for k in ("localId", "gml_id", "identifier")]
    rows = rows.select(
        "dataset_key", "feature_idx", "geometry", "reason", "served.*", geo.bbox(geo.positions(geometry)).alias("bbox"), F.try_variant_get(geometry, "$.type", "string").alias("geometryType"),
        F.coalesce("served.sourceId", *local, "served.title").alias("raw_id"), reports.site_code(text.prop(props, "Site_Code")).alias("site_code"),
    )
    kept = with_ids(rows.filter("reason IS NULL"))
    if dataset.key == schemas.BEACHES and classes is not None:
        kept = classification.overlay(kept, classes)
    else:
        kept = kept.withColumn("waterQuality", F.lit(None).cast("struct<value:string,label:string,rank:int,healthWarning:boolean>"))
    return kept.unionByName(rows.filter("reason IS NOT NULL"), allowMissingColumns=True)


def counts_by_reason(rows: DataFrame) -> DataFrame:
    return rows.filter("reason IS NOT NULL").groupBy("reason").count()


def summary(rows: DataFrame) -> DataFrame:
    """(dataset_key, feature_count, geometry_types, bbox, site_codes) of served features."""
    at = lambda i: F.get("bbox", i)
    box = F.array(F.min(at(0)), F.min(at(1)), F.max(at(2)), F.max(at(3)))
    return rows.filter("reason IS NULL").groupBy("dataset_key").agg(F.count(F.lit(1)).alias("feature_count"), F.array_sort(F.collect_set("geometryType")).alias("geometry_types"), box.alias("bbox"), F.array_sort(F.collect_set("site_code")).alias("site_codes"))


def styling() -> dict[str, Column]:
    """Flat properties for map styles, each only where what it comes from is set."""
    return {"ratingValue": F.col("rating.value"), "ratingCount": F.col("rating.count"), "tagsCsv": text.tags_csv(F.col("tags")), "waterQualityValue": F.col("waterQuality.value"), "waterQualityRank": F.col("waterQuality.rank")}


def payload(rows: DataFrame) -> DataFrame:
    """(dataset_key, payload, sha256, bytes): each layer as a FeatureCollection, features in order.

    A layer's payload is one value and is bounded by what a client can load; it is built by the task that owns the layer.
    """
    properties = [F.col(c) for c in ("id", *adapters.KINDS, "waterQuality")] + [c.alias(n) for n, c in styling().items()]
    feature = F.struct(F.lit("Feature").alias("type"), F.col("id"), F.col("bbox"), F.col("geometry"), F.struct(*properties).alias("properties"))
    served = rows.filter("reason IS NULL").select("dataset_key", "feature_idx", "bbox", F.to_json(feature).alias("f"))
    at = lambda i: F.get("bbox", i)
    grouped = served.groupBy("dataset_key").agg(F.array_sort(F.collect_list(F.struct("feature_idx", "f"))).alias("fs"), F.array(F.min(at(0)), F.min(at(1)), F.max(at(2)), F.max(at(3))).alias("bbox"))
    body = F.concat(F.lit('{"type":"FeatureCollection","bbox":'), F.to_json("bbox"), F.lit(',"features":['), F.array_join(F.transform("fs", lambda x: x["f"]), ","), F.lit("]}"))
    return with_hash(grouped.select("dataset_key", body.alias("payload")))


def with_hash(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"sha256": F.sha2("payload", 256), "bytes": F.octet_length("payload")})


def context_error(features: DataFrame, dataset: schemas.Dataset) -> str | None:
    """What keeps a context layer from being served; one bad feature rejects the layer."""
    mine = features.filter(F.col("dataset_key") == dataset.key)
    props = F.schema_of_variant("properties")
    wrong = F.when(~F.col("type").eqNullSafe("Feature"), "is not a GeoJSON Feature").when(~F.coalesce(props, F.lit("VOID")).rlike("^(OBJECT|VOID)"), "has invalid properties").when(~geo.valid_geometry(F.col("geometry"), dataset.bounds), "has invalid geometry")
    r = mine.select("feature_idx", wrong.alias("wrong")).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("wrong").isNotNull(), F.struct("feature_idx", "wrong"))).alias("first")).first()
    if not r.n:
        return f'dataset "{dataset.key}" has no features'
    return f'feature {r["first"].feature_idx} in "{dataset.key}" {r["first"].wrong}' if r["first"] else None


def build(features: DataFrame, layers: DataFrame, dataset: schemas.Dataset, classes: DataFrame | None = None) -> DataFrame:
    """The entry of one layer: (dataset_key, payload, sha256, bytes, feature_count, geometry_types, bbox, site_codes)."""
    if dataset.kind == "context":
        if wrong := context_error(features, dataset):
            raise CatalogError(wrong)
        mine = features.filter(F.col("dataset_key") == dataset.key)
        rows = mine.select("dataset_key", F.lit(None).cast("string").alias("reason"), geo.bbox(geo.positions(F.col("geometry"))).alias("bbox"), F.try_variant_get("geometry", "$.type", "string").alias("geometryType"), F.lit(None).cast("string").alias("site_code"))
        body = with_hash(layers.filter(F.col("dataset_key") == dataset.key).select("dataset_key", F.col("raw").alias("payload")))
    else:
        rows = normalize(features, dataset, classes)
        body = payload(rows)
    entry = body.join(summary(rows), "dataset_key")
    if entry.isEmpty():
        raise CatalogError(f'dataset "{dataset.key}" produced no features after normalization')
    return entry


def assert_refresh(dataset: schemas.Dataset, now: int, before: int | None) -> None:
    """Refuse a candidate that has shrunk too far."""
    least = max(dataset.least_features or 1, math.ceil((before or 0) * (dataset.least_ratio or 0)))
    if now < least:
        raise CatalogError(f'dataset "{dataset.key}" has {now} features; the minimum safe count is {least}')


class Catalog:
    """Loaded layers. A candidate is built and checked in full before it takes a layer's place, so a rejected one leaves nothing behind."""

    def __init__(self, datasets=schemas.DATASETS):
        self.datasets = {d.key: d for d in datasets}
        self.entries: dict[str, dict] = {}
        self.raw: dict[str, DataFrame] = {}
        self.failed: dict[str, str] = {}
        self.classes: DataFrame | None = None

    def load(self, spark, paths: dict[str, str]) -> None:
        layers, self.failed = geojson.read_layers(spark, paths)
        for key in paths:
            if key not in self.failed:
                try:
                    self._put(key, layers.filter(F.col("dataset_key") == key), first=True)
                except CatalogError as e:
                    self.failed[key] = str(e)

    def _put(self, key: str, layer: DataFrame, first: bool = False) -> dict:
        dataset = self.datasets[key]
        made = build(geojson.features(layer), layer, dataset, self.classes).first().asDict()
        if not first:
            assert_refresh(dataset, made["feature_count"], self.entries.get(key, {}).get("feature_count"))
        self.entries[key], self.raw[key] = made, layer
        self.failed.pop(key, None)
        return made

    def refresh(self, spark, key: str, raw: str) -> dict:
        layer = spark.createDataFrame([(key, raw)], "dataset_key string, raw string")
        if wrong := layer.select(geojson.shape_error(F.col("raw")).alias("e")).first().e:
            raise CatalogError(f'dataset "{key}": {wrong}')
        return self._put(key, layer)

    def set_classes(self, classes: DataFrame) -> dict:
        """Lay classes over the beaches that are served; returns whether that was done, and how many sites matched."""
        self.classes = classes
        if schemas.BEACHES not in self.raw:
            return {"rebuilt": False, "merged": 0}
        codes = self._put(schemas.BEACHES, self.raw[schemas.BEACHES], first=True)["site_codes"]
        return {"rebuilt": True, "merged": classes.filter(F.col("siteCode").isin(codes)).select("siteCode").distinct().count()}

    def reapply(self, stored: DataFrame) -> dict:
        """Lay stored classes over the layer again; an empty table changes nothing."""
        return {"rebuilt": False, "merged": 0} if stored.isEmpty() else self.set_classes(stored)

    def get(self, key: str) -> dict:
        if key in self.entries:
            return self.entries[key]
        if key in self.datasets:
            raise Unavailable(f'dataset "{key}" is unavailable')
        raise NotFound(key)

    def revision(self, spark) -> str:
        return revision(spark.createDataFrame([(k, e["sha256"]) for k, e in self.entries.items()], "dataset_key string, sha256 string")).first().revision

    def status(self) -> dict:
        missing = sorted(set(self.datasets) - set(self.entries))
        return {"configured": len(self.datasets), "loaded": len(self.entries), "unavailable": missing, "up": bool(self.entries) or not self.datasets}


def revision(entries: DataFrame) -> DataFrame:
    """(revision): hash of the sorted lines ``key:sha256``; the layers are few, whatever their size."""
    return entries.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("dataset_key", F.lit(":"), "sha256"))), "\n"), 256).alias("revision"))


def by_name(rows: DataFrame, name: str = "name") -> DataFrame:
    return rows.orderBy(F.collate(F.col(name), "UNICODE"), name)


def etag_matches(header: str | None, etag: str) -> bool:
    if header is None:
        return False
    bare = lambda x: re.sub(r"^W/", "", x.strip())
    return header.strip() == "*" or bare(etag) in [bare(x) for x in header.split(",")]


def refresh_report(candidates: DataFrame, current: DataFrame) -> DataFrame:
    """(dataset_key, state): how each fetched layer (dataset_key, payload or null) differs from the stored one."""
    now = candidates.select("dataset_key", F.sha2("payload", 256).alias("new"))
    old = current.select("dataset_key", F.sha2("payload", 256).alias("old"))
    state = F.when(F.col("new").isNull(), "failed").when(F.col("new").eqNullSafe(F.col("old")), "unchanged").otherwise("changed")
    return now.join(old, "dataset_key", "left").select("dataset_key", state.alias("state"))
