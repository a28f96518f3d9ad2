"""From a layer's raw properties to the properties that are served, one adapter for each interactive layer."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text as t

STRINGS, DETAILS, LINKS = T.ArrayType(T.StringType()), T.ArrayType(t.DETAIL), T.ArrayType(t.LINK)
RATING = T.StructType([T.StructField("value", T.DoubleType()), T.StructField("count", T.LongType())])
KINDS = {"title": T.StringType(), "subtitle": T.StringType(), "description": T.StringType(), "tags": STRINGS, "details": DETAILS, "youtubeIds": STRINGS, "links": LINKS, "rating": RATING, "sourceId": T.StringType(), "sourceUrl": T.StringType()}


def served(**columns: Column) -> Column:
    """The properties of a feature as one struct; a null title drops the feature."""
    return F.struct(*[columns.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in KINDS.items()])


def once(adapter):
    """The adapter with its variant computed once, however many properties it reads."""

    @functools.wraps(adapter)
    def adapted(p: Column) -> Column:
        return t.let(p, adapter)

    return adapted


@once
def diving_site(p: Column) -> Column:
    s = lambda k: t.prop(p, k)
    interest = s("interest")
    depth = t.depth(t.number_prop(p, "depthAverageMeters"), t.number_prop(p, "depthMaxMeters"), t.flag(p, "depthAverageIsMinimum"), t.flag(p, "depthMaxIsMinimum"))
    return served(
        title=F.coalesce(s("siteName"), s("location"), s("text")),
        subtitle=F.when(s("siteType") == "location", "Dive location").otherwise("Dive site"),
        description=F.when(t.flag(p, "hasDescription"), s("shortDescription")),
        tags=t.let(interest, lambda v: F.when(F.upper(v) != "N/A", t.tags(F.transform(F.split(v, "&"), t.trim)))),
        details=t.details(t.detail("Depth", depth), t.detail("Shore access", s("shoreAccess")), t.detail("Level", s("qualification")), t.detail("Popularity", s("popularity"))),
        youtubeIds=t.video_ids(s("youtube")),
        links=t.links(s("links")),
        rating=t.rating(t.number_prop(p, "rating"), t.number_prop(p, "ratings")),
        sourceId=F.coalesce(s("localId"), s("sourcePath")),
        sourceUrl=t.http_url(s("identifier")),
    )


@once
def anchoring_hotspot(p: Column) -> Column:
    s = lambda k: t.prop(p, k)
    parts = t.kind_and_period(s("description"))
    return served(
        title=s("text"),
        subtitle=F.coalesce(parts["kind"], F.lit("Anchoring & mooring hotspot")),
        description=s("description"),
        tags=t.tags(F.array(parts["period"])),
        details=t.details(t.detail("Authority", s("CharacterString")), t.detail("Published", t.date_only(s("beginLifespanVersion")))),
        sourceId=F.coalesce(s("localId"), s("gml_id")),
        sourceUrl=t.http_url(s("identifier")),
    )


@once
def bunkering_area(p: Column) -> Column:
    s = lambda k: t.prop(p, k)
    number = F.coalesce(t.group(s("name"), r"(?i)\barea\s*(\d+)\b", 1), t.group(s("localId"), r"(\d+)$", 1))
    return served(
        title=F.when(number.isNotNull(), F.concat(F.lit("Bunkering area "), number)).otherwise("Bunkering area"),
        subtitle=F.lit("Offshore bunkering"),
        description=s("description"),
        details=t.details(t.detail("Published", t.date_only(s("beginLifespanVersion")))),
        sourceId=F.coalesce(s("localId"), s("gml_id")),
        sourceUrl=t.http_url(s("identifier")),
    )


@once
def beach(p: Column) -> Column:
    s = lambda k: t.prop(p, k)
    code, maltese = s("Site_Code"), s("Name_MT")
    title = F.coalesce(s("Name_ENG"), maltese, F.concat(F.lit("Bathing site "), code))
    sort = t.sentence_label(s("Sandy_OR_Rocky_Beach"))
    flag, pets, bathing = s("Blue_Flag_OR_Beach_of_Quality"), s("Pet_Friendly"), s("RecommendedForBathing_YES_OR_NO")
    profile = t.http_url(s("Bathing_Water_Profile"))
    return served(
        title=title,
        subtitle=F.lit("Bathing water site"),
        description=s("Description"),
        tags=t.tags(F.array(sort, F.when(t.yes_no(flag), "Blue Flag / Beach of Quality"), F.when(t.yes_no(pets), "Pet friendly"), F.when(~t.yes_no(bathing), "Not recommended for bathing"))),
        details=t.details(
            t.detail("Locality", s("Local_Council")),
            t.detail("Maltese name", F.when(F.lower(maltese) != F.lower(title), maltese)),
            t.detail("Recommended for bathing", t.yes_no_label(bathing)),
            t.detail("Blue Flag / Beach of Quality", t.yes_no_label(flag)),
            t.detail("Beach type", sort),
            t.detail("Pet friendly", t.yes_no_label(pets)),
            t.detail("Public convenience", t.presence_label(s("Pubic_convenience"), "Available nearby")),
        ),
        links=F.when(profile.isNotNull(), F.array(F.struct(profile.alias("url"), F.lit("Bathing water profile").alias("label")))),
        sourceId=F.coalesce(code, s("GlobalID")),
        sourceUrl=profile,
    )


ADAPTERS = {"diving-sites": diving_site, "anchoring-and-mooring-hotspots": anchoring_hotspot, "bunkering-areas": bunkering_area, "beaches": beach}
