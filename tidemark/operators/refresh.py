"""The refresh of layers: fetch, check, compare with what is stored, and store what passed.

A layer's text is a GeoJSON FeatureCollection. It passes if it holds a feature or more, all of them Features whose box lies
in the layer's bounds. What is stored is the text without white space between its parts, with names in order and its box
recomputed; its hash tells whether a layer has changed, so a layer that only orders names otherwise is unchanged.

Cases: a text that is null or isn't JSON, an empty collection, and features without geometry are errors of their layer
and leave the other layers alone; keys are unique; no layers give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas, session
from tidemark.functions import geo
from tidemark.operators.store import Table
from tidemark.sources import geojson, http

LAYERS = "dataset_key string, raw string"
ACCEPT = {"accept": "application/geo+json, application/json;q=0.9, */*;q=0.1"}


def positions(geometry: Column) -> Column:
    """All positions of a geometry or of the members of a collection."""
    members = F.try_variant_get(geometry, "$.geometries", "array<variant>")
    return F.coalesce(geo.positions(geometry), F.flatten(F.transform(members, geo.positions)))


def checked(layers: DataFrame) -> DataFrame:
    """(dataset_key, payload, sha256, feature_count, bbox, error) of (dataset_key, raw, bounds); all but the key and the error are null where there is one."""
    wrong = F.when(F.col("raw").isNull(), "no text").otherwise(geojson.shape_error(F.col("raw")))
    rows = layers.select("dataset_key", "bounds", F.try_parse_json("raw").alias("v"), wrong.alias("wrong"))
    each = rows.filter("wrong IS NULL").selectExpr("dataset_key", "bounds", "posexplode(CAST(v:features AS ARRAY<VARIANT>)) AS (i, f)")
    box = geo.bbox(positions(F.try_variant_get("f", "$.geometry", "variant")))
    each = each.select("dataset_key", "bounds", "i", F.try_variant_get("f", "$.type", "string").alias("type"), box.alias("box"))
    bad = F.when(~F.col("type").eqNullSafe("Feature"), "is not a GeoJSON Feature").when(~F.coalesce(geo.box_within(F.col("box"), F.col("bounds")), F.lit(False)), "has no valid geometry")
    each = each.select("dataset_key", "box", F.when(bad.isNotNull(), F.struct("i", bad.alias("what"))).alias("bad"))
    at = lambda i: F.get("box", i)
    sums = each.groupBy("dataset_key").agg(F.count(F.lit(1)).alias("n"), F.min("bad").alias("bad"), F.array(F.min(at(0)), F.min(at(1)), F.max(at(2)), F.max(at(3))).alias("bbox"))
    first = F.concat(F.lit("feature "), F.col("bad.i"), F.lit(" "), F.col("bad.what"))
    found = rows.join(sums, "dataset_key", "left").withColumn("error", F.coalesce("wrong", F.when(F.col("n").isNull(), "no features"), first))
    fields = F.map_filter(F.expr("CAST(v AS MAP<STRING, VARIANT>)"), lambda k, _: k != "bbox")
    text = F.to_json(F.map_concat(fields, F.create_map(F.lit("bbox"), F.col("bbox").cast("variant"))))
    kept = lambda c: F.when(F.col("error").isNull(), c)
    found = found.select("dataset_key", kept(text).alias("payload"), kept(F.col("n")).alias("feature_count"), kept(F.col("bbox")).alias("bbox"), "error")
    return found.select("dataset_key", "payload", F.sha2("payload", 256).alias("sha256"), "feature_count", "bbox", "error")


def compared(fetched: DataFrame, stored: DataFrame) -> DataFrame:
    """(dataset_key, state, error, next, current, payload) of fetched layers: failed, unchanged or changed.

    Both tables have (dataset_key, raw, bounds). A layer whose stored text doesn't pass is failed as well.
    """
    summary = lambda name: F.when(F.col("sha256").isNotNull(), F.struct("feature_count", "bbox", "sha256")).alias(name)
    new = checked(fetched).select("dataset_key", "payload", summary("next"), F.col("error").alias("new_error"))
    old = checked(stored).select("dataset_key", summary("current"), F.concat(F.lit("stored: "), "error").alias("old_error"))
    error = F.coalesce("new_error", "old_error")
    state = F.when(error.isNotNull(), "failed").when(F.col("next.sha256") == F.col("current.sha256"), "unchanged").otherwise("changed")
    return new.join(old, "dataset_key", "left").select("dataset_key", state.alias("state"), error.alias("error"), "next", "current", "payload")


def refresh(spark: SparkSession, path: str, datasets=schemas.DATASETS, only: str | None = None, write: bool = False, fetch: Callable[..., str] = http.fetch_text) -> DataFrame:
    """Refresh the layers of the table at ``path``; what ``compared`` gives, with ``error`` also for what can't be fetched.

    With ``write``, layers that didn't fail replace the stored ones in one commit; the others stay as they are.
    """
    some = [d for d in datasets if only in (None, d.key)]
    if not some:
        raise ValueError(f"no dataset {only}")
    got, lost = [], []
    for d in some:
        try:
            got.append((d.key, fetch(d.source_url, ACCEPT | d.headers), list(d.bounds)))
        except Exception as e:  # noqa: BLE001  one layer that can't be fetched doesn't keep the others from it
            lost.append((d.key, "failed", str(e)))
    store, bounds = Table(spark, path, LAYERS), spark.createDataFrame([(d.key, list(d.bounds)) for d in some], "dataset_key string, bounds array<double>")
    stored = store.read()
    found = session.cut(compared(spark.createDataFrame(got, f"{LAYERS}, bounds array<double>"), stored.join(bounds, "dataset_key")))
    if write:
        passed = found.filter("state <> 'failed'").select("dataset_key", F.col("payload").alias("raw"))
        if not passed.isEmpty():
            store.commit(stored.join(passed, "dataset_key", "left_anti").select("dataset_key", "raw").unionByName(passed))
    return found.unionByName(spark.createDataFrame(lost, "dataset_key string, state string, error string"), allowMissingColumns=True)
