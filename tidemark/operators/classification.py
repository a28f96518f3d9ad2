"""Classes of bathing sites: labels, ranks and tags, and laying them over the beaches."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import text


def _map(values: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in values.items()))


def label(c: Column) -> Column:
    return F.try_element_at(_map(schemas.CLASS_LABELS), c)


def rank(c: Column) -> Column:
    return F.try_element_at(_map(schemas.CLASS_RANKS), c)


def safety_tags(c: Column, warning: Column) -> Column:
    every = F.array(F.try_element_at(_map(schemas.CLASS_TAGS), c), F.when(warning, schemas.HEALTH_WARNING_TAG))
    return F.filter(every, lambda x: x.isNotNull())


def overlay(features: DataFrame, classes: DataFrame, code: str = "site_code") -> DataFrame:
    """``features`` (with ``code``, tags, details) joined with classes (siteCode, classification, healthWarning, publishedOn).

    Where a class is known, the water quality leads the details, safety tags lead the tags, and waterQuality is set.
    """
    c = classes.select(F.col("siteCode").alias("__code"), F.struct("classification", "healthWarning", "publishedOn").alias("__c"))
    joined = features.join(c, features[code] == c["__code"], "left")
    found, cls = F.col("__c").isNotNull(), F.col("__c.classification")
    value = F.when(F.nullif(F.col("__c.publishedOn"), F.lit("")).isNotNull(), F.concat(label(cls), F.lit(" (as of "), F.col("__c.publishedOn"), F.lit(")"))).otherwise(label(cls))
    none = F.array().cast("array<string>")
    quality = F.struct(cls.alias("value"), label(cls).alias("label"), rank(cls).alias("rank"), F.when(F.col("__c.healthWarning"), True).alias("healthWarning"))
    first = F.array(F.struct(F.lit("Water quality").alias("label"), value.alias("value")))
    return joined.withColumns(
        {
            "details": F.when(found, F.when(F.col("details").isNull(), first).otherwise(F.concat(first, F.col("details")))).otherwise(F.col("details")),
            "tags": F.when(found, text.tags(F.concat(safety_tags(cls, F.col("__c.healthWarning")), F.coalesce("tags", none)))).otherwise(F.col("tags")),
            "waterQuality": F.when(found, quality),
        }
    ).drop("__code", "__c")


def overlap(codes: DataFrame, known: DataFrame) -> DataFrame:
    """(n, matched, ratio) of codes among known codes; the ratio is null where nothing is known or asked."""
    k = known.select(F.col("siteCode").alias("k")).distinct()
    joined = codes.select("siteCode").distinct().join(k, F.col("siteCode") == F.col("k"), "left")
    return joined.agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("matched")).withColumn("ratio", F.when(F.col("matched") + F.col("n") > 0, F.col("matched") / F.col("n")))


def assert_overlap(codes: DataFrame, known: DataFrame, least: float = 0.5) -> None:
    """Refuse classes of which too few belong to sites that are known; without known sites nothing is checked."""
    if known.isEmpty():
        return
    r = overlap(codes, known).first()
    if (r.ratio or 0.0) < least:
        raise ValueError(f"only {r.matched} of {r.n} classified sites are known")


def replace(old: DataFrame, new: DataFrame) -> tuple[DataFrame, int]:
    """The table after an import: what is in ``new`` stays, the rest goes; and how many sites went."""
    gone = old.join(new.select("siteCode"), "siteCode", "left_anti").count()
    return new, gone
