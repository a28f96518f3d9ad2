"""Zone maps in KML: folders, placemarks and their geometries."""

from __future__ import annotations

import math
import re
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import session
from tidemark.schemas import PLACEMARKS


class KmlError(ValueError):
    """The document can't be trusted; an import of it has to stop."""


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _all(e: ET.Element, name: str):
    return (x for x in e.iter() if x is not e and _local(x) == name)


def _text(e: ET.Element, name: str) -> str:
    """The trimmed text of the first descendant of that name."""
    found = next(_all(e, name), None)
    return "".join(found.itertext()).strip() if found is not None else ""


def _number(text: str) -> float:
    text = text.strip()
    if not text:
        return 0.0  # as publishers' and clients' readers have it
    return float(text) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text) else math.nan


def positions(raw: str) -> list[tuple[float, float]]:
    """(lon, lat) of 'lon,lat[,alt]' tuples; one bad tuple fails the document."""
    out = []
    for t in raw.split():
        lon, _, rest = t.partition(",")
        x, y = _number(lon), _number(rest.partition(",")[0]) if rest or "," in t else math.nan
        if not (abs(x) <= 180 and abs(y) <= 90):
            raise KmlError(f"invalid coordinates: {t}")
        out.append((x, y))
    if not out:
        raise KmlError("empty coordinates")
    return out


def geometries(placemark: ET.Element) -> list[tuple[str, list[tuple[float, float]]]]:
    """Points, then lines, then polygons (outer rings), also those within a MultiGeometry."""
    out = [("point", positions(_text(p, "coordinates"))[:1]) for p in _all(placemark, "Point")]
    for kind, name, least in (("line", "LineString", 2), ("polygon", "Polygon", 3)):
        for shape in _all(placemark, name):
            ring = next(_all(shape, "outerBoundaryIs"), shape) if kind == "polygon" else shape
            at = positions(_text(ring, "coordinates"))
            if len(set(at)) < least:
                raise KmlError(f"degenerate {kind} geometry")
            out.append((kind, at))
    return out


def parse(xml: str) -> list[dict]:
    """Placemarks with geometry, by folder; rows of ``schemas.PLACEMARKS``."""
    try:
        root = ET.fromstring(xml)  # noqa: S314
    except ET.ParseError as e:
        raise KmlError(f"not valid KML: {e}") from None
    if _local(root).lower() != "kml":
        raise KmlError("not valid KML: the root isn't <kml>")
    rows = []
    for i, folder in enumerate(x for x in root.iter() if _local(x) == "Folder"):
        if next(_all(folder, "Folder"), None) is not None:
            raise KmlError("nested folders")
        for j, placemark in enumerate(_all(folder, "Placemark")):
            if shapes := geometries(placemark):
                rows.append({"folder_idx": i, "placemark_idx": j, "folder": _text(folder, "name"), "name": _text(placemark, "name"), "description": _text(placemark, "description"), "geometries": [{"type": k, "points": [{"lon": x, "lat": y} for x, y in at]} for k, at in shapes]})
    return rows


def read(spark: SparkSession, path: str) -> DataFrame:
    """Placemarks of the KML files at ``path``; each file is parsed by one task, and a bad one fails the read."""
    import pandas as pd

    columns = [c.split()[0] for c in ("folder_idx INT", "placemark_idx INT", "folder STRING", "name STRING", "description STRING", "geometries ARRAY")]

    def run(batches):
        for batch in batches:
            for xml in batch["value"]:
                yield pd.DataFrame(parse(xml), columns=columns)

    session.ship(spark)
    return spark.read.text(path, wholetext=True).mapInPandas(run, PLACEMARKS)


def placemarks(spark: SparkSession, xml: str) -> DataFrame:
    rows = parse(xml)
    return spark.createDataFrame([tuple(r.values()) for r in rows], PLACEMARKS) if rows else spark.createDataFrame([], PLACEMARKS).where(F.lit(False))
