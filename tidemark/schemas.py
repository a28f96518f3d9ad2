"""Schemas, enumerations and small fixed dimensions."""

from __future__ import annotations

from dataclasses import dataclass, field

POINTS = "ARRAY<STRUCT<lat: DOUBLE, long: DOUBLE>>"
AREAS = f"ARRAY<STRUCT<label: STRING, geometryType: STRING, points: {POINTS}>>"
SHAPES = "ARRAY<STRUCT<type: STRING, points: ARRAY<STRUCT<lon: DOUBLE, lat: DOUBLE>>>>"
NOTICES = (
    "id STRING, kind STRING, category STRING, title STRING, description STRING, source STRING, noticeRef STRING, sourceUrl STRING, subKey STRING, locationLabel STRING, "
    f"areas {AREAS}, distance DOUBLE, publishedAt TIMESTAMP_NTZ, activeFrom TIMESTAMP_NTZ, activeTo TIMESTAMP_NTZ, needsReview BOOLEAN, reviewReasons ARRAY<STRING>, reports INT, createdAt TIMESTAMP_NTZ, updatedAt TIMESTAMP_NTZ"
)
USER_REPORTS = "id STRING, title STRING, description STRING, latitude DOUBLE, longitude DOUBLE, resolved BOOLEAN, createdAt TIMESTAMP_NTZ, updatedAt TIMESTAMP_NTZ"
LOGS = "id BIGINT, logType STRING, description STRING, createdAt TIMESTAMP_NTZ"
CLASSIFICATIONS = "siteCode STRING, classification STRING, healthWarning BOOLEAN, publishedOn STRING, sourceUrl STRING"
PLACEMARKS = f"folder_idx INT, placemark_idx INT, folder STRING, name STRING, description STRING, geometries {SHAPES}"

KINDS = ("alert", "info")
#: Classes of bathing sites, their labels and ranks (4 the best, 0 no grade of quality), and safety tags.
CLASSES = ("excellent", "good", "sufficient", "poor", "insufficient", "closed", "inaccessible")
CLASS_LABELS = {"excellent": "Excellent", "good": "Good", "sufficient": "Sufficient", "poor": "Poor", "insufficient": "Insufficient", "closed": "Closed", "inaccessible": "Inaccessible"}
CLASS_RANKS = {"excellent": 4, "good": 3, "sufficient": 2, "poor": 1, "insufficient": 0, "closed": 0, "inaccessible": 0}
CLASS_TAGS = {"closed": "CLOSED — bathing not recommended", "poor": "Poor water quality", "insufficient": "Insufficient water quality data", "inaccessible": "Inaccessible"}
HEALTH_WARNING_TAG = "Health warning"
#: Words that keep a report from being stored.
SWEAR_WORDS = (
    "arsehole", "asshole", "bastard", "bitch", "bollocks", "bullshit", "crap", "cunt", "damn", "dick", "fuck", "fucked", "fucker", "fucking",
    "motherfucker", "piss", "pissed", "prick", "shit", "shitty", "slut", "twat", "wanker",
)


@dataclass(frozen=True)
class MapLayer:
    """A folder of the zone map that is imported. ``placemarks`` restricts a mixed folder."""

    key: str
    match: str
    kind: str = "alert"
    brief: str = ""
    placemarks: str | None = None
    named_points: bool = False


#: The layers, in order of precedence, with their patterns and briefs.
MAP_LAYERS = (
    MapLayer(
        "swimmer-zones", "(?i)swimmer zones|restricted navigational areas",
        brief="Area reserved for bathers and closed to navigation. Vessels, fishing gear and any object that could endanger swimmers are prohibited inside the zone; navigate clear of its limits.",
    ),
    MapLayer(
        "wreck-conservation", "(?i)conservation areas around wrecks", named_points=True,
        brief="Conservation area around a protected historic wreck. Entry and mooring are limited to vessels engaged in recreational or technical diving, after pre-notifying Valletta VTS.",
    ),
    MapLayer(
        "archaeological-zones", "(?i)archaeological zones at sea", named_points=True,
        brief="Underwater archaeological zone designated by the Superintendence of Cultural Heritage. No-stopping area: anchoring and mooring are prohibited except for AIS-fitted permitted dive vessels.",
    ),
    MapLayer(
        "life-garnija", "(?i)life garnija",
        brief="Seabird (Yelkouan shearwater) protection area at sea. No navigation and no anchoring except for fishing, diving and local commercial vessels, which must show only compulsory lights and sound.",
    ),
    MapLayer(
        "other-restrictions", "(?i)other areas with restrictions", placemarks=r"(?i)^Bay Pillar\b",
        brief="Coastal area subject to local navigational or environmental restrictions. Observe posted limits on access, speed and activity.",
    ),
)
ZONE_SOURCE = "community-map"


@dataclass(frozen=True)
class Dataset:
    """A served layer. ``interactive`` features have properties to show; ``context`` layers are geometry only."""

    key: str
    name: str
    kind: str
    bounds: tuple[float, float, float, float] = (13.0, 34.5, 16.0, 37.0)
    refresh: str | None = None
    least_features: int | None = None
    least_ratio: float | None = None
    source_url: str | None = None
    headers: dict[str, str] = field(default_factory=dict)


#: The served layers.
DATASETS = (
    Dataset("maltese-waters-contour", "Maltese waters contour", "context"),
    Dataset("bathymetric-contours", "Bathymetric contours", "context"),
    Dataset("anchoring-and-mooring-hotspots", "Anchoring and Mooring Hotspots", "interactive"),
    Dataset("bunkering-areas", "Bunkering areas", "interactive"),
    Dataset("harbour-approach-routes", "Harbour Approach Routes", "context"),
    Dataset("diving-sites", "Diving Sites", "interactive"),
    Dataset("beaches", "Beaches", "interactive", refresh="daily", least_features=80, least_ratio=0.75),
)
BEACHES = "beaches"
