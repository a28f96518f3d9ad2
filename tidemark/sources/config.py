"""Settings from environment-like mappings."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

TRUE, FALSE = ("true", "1", "yes", "on"), ("false", "0", "no", "off")


@dataclass(frozen=True)
class Settings:
    """Names in upper case; blank counts as unset."""

    port: int = 3000
    cache_ttl_ms: int = 30_000
    throttle_ttl_ms: int = 60_000
    throttle_limit: int = 120
    zone_map_id: str | None = None
    zone_import_enabled: bool = True
    classification_import_enabled: bool = True
    dataset_refresh_enabled: bool = True
    log_retention_days: int = 14


def read(env: Mapping[str, str]) -> Settings:
    """Typed settings with defaults; a value that can't be read is an error that names it."""
    found = {}
    for f in fields(Settings):
        raw = env.get(f.name.upper(), "").strip()
        if not raw:
            continue
        try:
            if isinstance(f.default, bool):
                if raw.lower() not in TRUE + FALSE:
                    raise ValueError(raw)
                found[f.name] = raw.lower() in TRUE
            else:
                found[f.name] = int(raw) if isinstance(f.default, int) else raw
        except ValueError:
            raise ValueError(f"{f.name.upper()}: can't read {raw!r}") from None
    return Settings(**found)
