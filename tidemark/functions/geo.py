"""Geometry as Column expressions; only anchors and the sea test need Python.

Points of notices are structs (lat, long), points of layers structs (lon, lat); rings and lines are arrays of points.
"""

from __future__ import annotations

import functools
import math
import operator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import session
from tidemark.functions import text

#: Mean earth radius in metres, for great-circle distances.
EARTH_RADIUS = 6_371_008.8
#: Default extent of a layer: least longitude and latitude, greatest longitude and latitude.
BOUNDS = (13.0, 34.5, 16.0, 37.0)
POSITIONS = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def finite_points(points: Column) -> Column:
    """Points (lat, long) without null, NaN or infinite coordinates."""
    return F.filter(points, lambda p: finite(p["lat"]) & finite(p["long"]))


def ring_closed(ring: Column) -> Column:
    return (F.size(ring) >= 2) & (F.element_at(ring, 1) == F.element_at(ring, -1))


def close_ring(ring: Column) -> Column:
    return F.when((F.size(ring) == 0) | ring_closed(ring), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def position(point: Column) -> Column:
    """[long, lat] of a point of a notice."""
    return F.array(point["long"], point["lat"])


def part_geometry(part: Column) -> Column:
    """(type, coordinates) of a part of a notice, where it can be drawn; coordinates are a ring, a line or one position."""
    places = F.transform(finite_points(part["points"]), position)
    ring = close_ring(places)
    shape = lambda name, at: F.struct(F.lit(name).alias("type"), at.alias("coordinates"))
    return (
        F.when((part["geometryType"] == "point") & (F.size(places) >= 1), shape("Point", F.slice(places, 1, 1)))
        .when((part["geometryType"] == "line") & (F.size(places) >= 2), shape("LineString", places))
        .when((part["geometryType"] == "polygon") & (F.size(places) >= 1) & (F.size(ring) >= 4), shape("Polygon", ring))
    )


def features(areas: Column) -> Column:
    """(part, kind, geometry) of the parts that can be drawn, with their place in the notice; null if none can."""
    every = F.transform(areas, lambda p, i: F.struct(i.alias("part"), p["geometryType"].alias("kind"), part_geometry(p).alias("geometry")))
    drawn = F.filter(every, lambda f: f["geometry"].isNotNull())
    return F.when(F.size(drawn) > 0, drawn)


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2) * F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
    return 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a)) * EARTH_RADIUS


def bounding_circle(areas: Column, berth: Column) -> Column:
    """(latitude, longitude, radius) around all finite points; the berth counts if any part is a point."""
    extra = F.when(F.exists(areas, lambda p: p["geometryType"] == "point") & (berth > 0), berth).otherwise(0.0)

    def around(points):
        lat, lon = F.transform(points, lambda p: p["lat"]), F.transform(points, lambda p: p["long"])
        middle = F.struct(((F.array_min(lat) + F.array_max(lat)) / 2).alias("lat"), ((F.array_min(lon) + F.array_max(lon)) / 2).alias("lon"))
        reach = lambda m: F.array_max(F.transform(points, lambda p: distance(m["lat"], m["lon"], p["lat"], p["long"])))
        circle = text.let(middle, lambda m: F.struct(m["lat"].alias("latitude"), m["lon"].alias("longitude"), (reach(m) + extra).alias("radius")))
        return F.when(F.size(points) > 0, circle)

    return text.let(finite_points(F.flatten(F.transform(areas, lambda p: p["points"]))), around)


def bbox(positions: Column) -> Column:
    """[least x, least y, greatest x, greatest y] of positions [x, y]; null if one isn't finite."""
    x, y = F.transform(positions, lambda p: F.get(p, 0)), F.transform(positions, lambda p: F.get(p, 1))
    box = F.array(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y))
    return F.when(F.forall(box, finite), box)


def within(p: Column, bounds=BOUNDS) -> Column:
    """Whether a position has two finite numbers or more and lies in the bounds, edges included."""
    x, y = F.get(p, 0), F.get(p, 1)
    return F.coalesce((F.size(p) >= 2) & finite(x) & finite(y) & x.between(bounds[0], bounds[2]) & y.between(bounds[1], bounds[3]), F.lit(False))


def coordinates(geometry: Column, depth: int) -> Column:
    """The coordinates of a GeoJSON variant as nested arrays; null, or null inside, where the depth differs."""
    return F.try_variant_get(geometry, "$.coordinates", "array<" * (depth + 1) + "double" + ">" * (depth + 1))


def valid_geometry(geometry: Column, bounds=BOUNDS) -> Column:
    """Whether a GeoJSON variant has one of the six drawable types, with enough positions, all within bounds, and closed rings."""
    kind = F.try_variant_get(geometry, "$.type", "string")
    ok = lambda p: within(p, bounds)
    line = lambda x: F.coalesce((F.size(x) >= 2) & F.forall(x, ok), F.lit(False))
    ends = lambda r: F.slice(F.element_at(r, 1), 1, 2) == F.slice(F.element_at(r, -1), 1, 2)
    ring = lambda r: F.coalesce((F.size(r) >= 4) & F.forall(r, ok) & ends(r), F.lit(False))
    polygon = lambda x: F.coalesce((F.size(x) >= 1) & F.forall(x, ring), F.lit(False))
    at = {k: coordinates(geometry, d) for k, d in POSITIONS.items()}
    valid = (
        F.when(kind == "Point", ok(at["Point"]))
        .when(kind == "MultiPoint", (F.size(at["MultiPoint"]) >= 1) & F.forall(at["MultiPoint"], ok))
        .when(kind == "LineString", line(at["LineString"]))
        .when(kind == "MultiLineString", (F.size(at["MultiLineString"]) >= 1) & F.forall(at["MultiLineString"], line))
        .when(kind == "Polygon", polygon(at["Polygon"]))
        .when(kind == "MultiPolygon", (F.size(at["MultiPolygon"]) >= 1) & F.forall(at["MultiPolygon"], polygon))
    )
    return F.coalesce(valid, F.lit(False))


def positions(geometry: Column) -> Column:
    """All positions of a GeoJSON variant."""
    kind = F.try_variant_get(geometry, "$.type", "string")
    out = F.when(kind == "Point", F.array(coordinates(geometry, 0)))
    for name, depth in POSITIONS.items():
        if depth:
            flat = coordinates(geometry, depth)
            for _ in range(depth - 1):
                flat = F.flatten(flat)
            out = out.when(kind == name, flat)
    return out


def box_within(box: Column, bounds=BOUNDS) -> Column:
    return (box[0] >= bounds[0]) & (box[1] >= bounds[1]) & (box[2] <= bounds[2]) & (box[3] <= bounds[3])


# Canonical form and fingerprint of layer geometries (type, points of (lon, lat)).


def _rotations(points: Column) -> Column:
    n = F.size(points)
    turn = lambda i: F.array_join(F.concat(F.slice(points, i + 1, n), F.slice(points, F.lit(1), i)), ";")
    return F.when(n == 0, "").otherwise(F.array_min(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), turn)))


def canonical(kind: Column, points: Column) -> Column:
    """The same text for equal shapes, whatever the start or direction of their points."""
    texts = F.transform(points, lambda p: F.format_string("%.7f,%.7f", p["lon"], p["lat"]))
    closed = (F.size(texts) > 1) & (F.element_at(texts, 1) == F.element_at(texts, -1))
    ring = F.when(closed, F.slice(texts, F.lit(1), F.size(texts) - 1)).otherwise(texts)
    line = F.least(F.array_join(texts, ";"), F.array_join(F.reverse(texts), ";"))
    polygon = F.least(_rotations(ring), _rotations(F.reverse(ring)))
    return F.when(kind == "point", F.concat(F.lit("point:"), F.coalesce(F.get(texts, 0), F.lit("")))).when(kind == "line", F.concat(F.lit("line:"), line)).otherwise(F.concat(F.lit("polygon:"), polygon))


def fingerprint(kind: Column, points: Column) -> Column:
    return F.sha2(canonical(kind, points), 256)


# Anchors.


def _inside(x: float, y: float, ring: np.ndarray) -> bool:
    """Whether a point is in a closed ring or on its edge."""
    a, b = ring[:-1], ring[1:]
    cross = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) - (b[:, 1] - a[:, 1]) * (x - a[:, 0])
    between = (np.minimum(a, b) <= (x, y)).all(axis=1) & (np.maximum(a, b) >= (x, y)).all(axis=1)
    if ((cross == 0) & between).any():
        return True
    spans = (a[:, 1] > y) != (b[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
    return bool((spans & (x < at)).sum() % 2)


def _on_line(x: float, y: float, line: np.ndarray) -> bool:
    a, b = line[:-1], line[1:]
    cross = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) - (b[:, 1] - a[:, 1]) * (x - a[:, 0])
    between = (np.minimum(a, b) <= (x, y)).all(axis=1) & (np.maximum(a, b) >= (x, y)).all(axis=1)
    return bool(((cross == 0) & between).any())


def anchor(kind: str, points: list) -> tuple[float, float] | None:
    """(lat, long) of a point on the part: the middle of its box if the part holds it, else the nearest vertex."""
    finite_ = [(p["long"], p["lat"]) for p in points if p["lat"] is not None and p["long"] is not None and math.isfinite(p["lat"]) and math.isfinite(p["long"])]
    if not finite_:
        return None
    if kind == "point" or len(finite_) < (2 if kind == "line" else 3):
        return finite_[0][1], finite_[0][0]
    at = np.array(finite_)
    x, y = (at.min(axis=0) + at.max(axis=0)) / 2
    if kind == "polygon" and (at[0] != at[-1]).any():
        at = np.vstack([at, at[:1]])
    if len(at) < 4 and kind == "polygon":
        return finite_[0][1], finite_[0][0]
    if (_inside if kind == "polygon" else _on_line)(x, y, at):
        return float(y), float(x)
    near = at[int(((at - (x, y)) ** 2).sum(axis=1).argmin())]
    return float(near[1]), float(near[0])


ANCHORS = T.ArrayType(T.StructType([T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType())]))


@F.pandas_udf(ANCHORS)
def _anchors(areas: pd.Series) -> pd.Series:
    return areas.map(lambda parts: [{"latitude": a[0], "longitude": a[1]} for p in parts if (a := anchor(p["geometryType"], p["points"])) is not None] if parts is not None else None)


def representative_points(areas: Column) -> Column:
    """An anchor for each part that has a usable point, in order."""
    session.ship_active()
    return _anchors(areas)


# The sea: what is in the waters and not in the interior of land.


class Sea:
    """Polygons of waters and of land, each a list of closed rings (the first outer, the others holes)."""

    def __init__(self, waters: list[list[list]], land: list[list[list]] = ()):
        as_rings = lambda polygons: [[np.asarray(r, dtype=float)[:, :2] for r in p] for p in polygons]
        self.waters, self.land = as_rings(waters), as_rings(land)
        rings = [r for p in [*self.waters, *self.land] for r in p]
        self.edges = np.vstack([np.hstack([r[:-1], r[1:]]) for r in rings]) if rings else np.zeros((0, 4))
        self.vertices = np.vstack(rings) if rings else np.zeros((0, 2))
        outer = [p[0] for p in self.waters]
        self.box = (np.vstack(outer).min(axis=0), np.vstack(outer).max(axis=0)) if outer else None

    @staticmethod
    def _place(x: float, y: float, polygon: list[np.ndarray]) -> int:
        """1 inside, 0 on an edge, -1 outside."""
        edge = any(_on_line(x, y, r) for r in polygon)
        if edge:
            return 0
        return 1 if _inside(x, y, polygon[0]) and not any(_inside(x, y, r) for r in polygon[1:]) else -1

    def holds(self, x: float, y: float) -> bool:
        return any(self._place(x, y, p) >= 0 for p in self.waters) and not any(self._place(x, y, p) > 0 for p in self.land)

    def _crossings(self, a: np.ndarray, b: np.ndarray) -> list[tuple[float, float]]:
        """Where the edge a-b meets edges of waters or land."""
        e = self.edges
        d, f = b - a, e[:, 2:] - e[:, :2]
        across = d[0] * f[:, 1] - d[1] * f[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((e[:, 0] - a[0]) * f[:, 1] - (e[:, 1] - a[1]) * f[:, 0]) / across
            u = ((e[:, 0] - a[0]) * d[1] - (e[:, 1] - a[1]) * d[0]) / across
        hit = (across != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        cuts = np.unique(np.concatenate([[0.0], t[hit], [1.0]]))
        # between two cuts a shape is wholly in or out, so their middles count too
        return [tuple(a + d * s) for s in [*cuts, *((cuts[1:] + cuts[:-1]) / 2)]]

    def touches(self, kind: str, points: list[tuple[float, float]]) -> bool:
        """Whether a shape meets the sea; without waters everything does."""
        if not self.waters:
            return True
        if not points or (kind == "line" and len(points) < 2) or (kind == "polygon" and len(points) < 3):
            return False
        at = np.asarray(points, dtype=float)
        if (at.min(axis=0) > self.box[1]).any() or (at.max(axis=0) < self.box[0]).any():
            return False
        if kind == "point":
            return self.holds(*at[0])
        if kind == "polygon" and (at[0] != at[-1]).any():
            at = np.vstack([at, at[:1]])
        for a, b in zip(at[:-1], at[1:], strict=True):
            if any(self.holds(x, y) for x, y in self._crossings(a, b)):
                return True
        return kind == "polygon" and any(_inside(x, y, at) and self.holds(x, y) for x, y in self.vertices)


def touches_sea(sea: Sea):
    """A Column function (kind, points of (lon, lat)) -> boolean. The polygons are a fixed asset and go along with it."""

    session.ship_active()

    @F.pandas_udf(T.BooleanType())
    def test(kind: pd.Series, points: pd.Series) -> pd.Series:
        return pd.Series([sea.touches(k, [(p["lon"], p["lat"]) for p in ps]) if ps is not None else False for k, ps in zip(kind, points, strict=True)])

    if sea.box is None:
        return test
    (x0, y0), (x1, y1) = sea.box

    def near(kind: Column, points: Column) -> Column:
        """Shapes whose box misses that of the waters are told by Column functions alone."""
        x, y = F.transform(points, lambda p: p["lon"]), F.transform(points, lambda p: p["lat"])
        apart = (F.array_min(x) > float(x1)) | (F.array_max(x) < float(x0)) | (F.array_min(y) > float(y1)) | (F.array_max(y) < float(y0))
        return F.when(F.coalesce(apart, F.lit(True)), False).otherwise(test(kind, points))

    return near


#: Edges up to which a point is tested by an expression; beyond that in Python.
MOST_EDGES = 64


def point_in_sea(sea: Sea):
    """A Column function (lon, lat) -> boolean, for points."""
    if not sea.waters:
        return lambda lon, lat: F.lit(True)
    if len(sea.edges) > MOST_EDGES:
        test = touches_sea(sea)
        return lambda lon, lat: test(F.lit("point"), F.array(F.struct(lon.alias("lon"), lat.alias("lat"))))

    def crossed(x, y, edge):
        ax, ay, bx, by = map(float, edge)
        return F.when(((F.lit(ay) > y) != (F.lit(by) > y)) & (x < F.lit(bx - ax) * (y - ay) / F.lit(by - ay) + ax), 1).otherwise(0) if ay != by else F.lit(0)

    def on(x, y, edge):
        ax, ay, bx, by = map(float, edge)
        return (F.lit(bx - ax) * (y - ay) - F.lit(by - ay) * (x - ax) == 0) & x.between(min(ax, bx), max(ax, bx)) & y.between(min(ay, by), max(ay, by))

    any_of = lambda tests: functools.reduce(operator.or_, tests, F.lit(False))
    edges = lambda ring: np.hstack([ring[:-1], ring[1:]]).tolist()
    odd = lambda x, y, ring: sum(crossed(x, y, e) for e in edges(ring)) % 2 == 1

    def place(x, y, polygon):
        """(on an edge, in the interior)"""
        edge = any_of(on(x, y, e) for ring in polygon for e in edges(ring))
        return edge, ~edge & odd(x, y, polygon[0]) & ~any_of(odd(x, y, hole) for hole in polygon[1:])

    def test(lon: Column, lat: Column) -> Column:
        wet = any_of(a | b for a, b in (place(lon, lat, p) for p in sea.waters))
        return wet & ~any_of(place(lon, lat, p)[1] for p in sea.land)

    return test
