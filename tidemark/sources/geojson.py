"""GeoJSON layers as rows of features."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import Dataset


def read_layers(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """(dataset_key, raw) of the files that can be read, and for each other key what was wrong."""
    rows, failed = None, {}
    for key, path in paths.items():
        try:
            one = spark.read.text(path, wholetext=True).select(F.lit(key).alias("dataset_key"), F.col("value").alias("raw"))
            if (wrong := one.select(shape_error(F.col("raw")).alias("e")).first()) is None or wrong.e:
                raise ValueError(f'dataset "{key}": {wrong.e if wrong else "empty file"}')
        except Exception as e:  # noqa: BLE001  one bad layer doesn't keep the others from loading
            failed[key] = str(e).splitlines()[0]
            continue
        rows = one if rows is None else rows.unionByName(one)
    return (rows if rows is not None else spark.createDataFrame([], "dataset_key string, raw string")), failed


def shape_error(raw):
    """Null if the text is a FeatureCollection with an array of features, else what is wrong with it."""
    v = F.try_parse_json(raw)
    kind = F.try_variant_get(v, "$.type", "string")
    features = F.schema_of_variant(F.try_variant_get(v, "$.features", "variant"))
    return (
        F.when(v.isNull(), F.lit("not JSON"))
        .when(~kind.eqNullSafe("FeatureCollection"), F.concat(F.lit("expected type FeatureCollection, got "), F.coalesce(F.to_json(F.try_variant_get(v, "$.type", "variant")), F.lit("undefined"))))
        .when(~F.coalesce(features, F.lit("")).startswith("ARRAY"), F.concat(F.lit("expected an array of features, got "), F.coalesce(features, F.lit("undefined"))))
    )


def features(layers: DataFrame) -> DataFrame:
    """(dataset_key, feature_idx, type, geometry, properties) of (dataset_key, raw)."""
    parsed = layers.select("dataset_key", F.parse_json("raw").alias("v"))
    each = parsed.selectExpr("dataset_key", "posexplode(CAST(v:features AS ARRAY<VARIANT>)) AS (feature_idx, f)")
    return each.select("dataset_key", "feature_idx", F.try_variant_get("f", "$.type", "string").alias("type"), F.try_variant_get("f", "$.geometry", "variant").alias("geometry"), F.try_variant_get("f", "$.properties", "variant").alias("properties"))


def read_polygons(path: str) -> list[list[list]]:
    """Polygons (lists of rings) of a GeoJSON asset, from collections, features and geometry collections; none if there is no file."""
    if not Path(path).exists():
        return []
    out: list = []

    def walk(x: dict | None):
        kind = (x or {}).get("type")
        if kind == "FeatureCollection":
            for f in x["features"]:
                walk(f)
        elif kind == "Feature":
            walk(x["geometry"])
        elif kind == "GeometryCollection":
            for g in x["geometries"]:
                walk(g)
        elif kind == "Polygon":
            out.append(x["coordinates"])
        elif kind == "MultiPolygon":
            out.extend(x["coordinates"])

    walk(json.loads(Path(path).read_text(encoding="utf-8")))
    return out


def due(datasets: tuple[Dataset, ...], refresh: str = "daily") -> list[Dataset]:
    return [d for d in datasets if d.refresh == refresh]
