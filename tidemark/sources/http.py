"""Fetching text. Only the driver fetches; files serve in tests."""

from __future__ import annotations

from urllib.parse import quote
from urllib.request import Request, urlopen

TIMEOUT_S = 30


def fetch_bytes(url: str, headers: dict[str, str] | None = None, timeout: float = TIMEOUT_S) -> bytes:
    """What is at a URL; a status beyond 2xx is an error."""
    with urlopen(Request(url, headers=headers or {}), timeout=timeout) as answer:  # noqa: S310
        if not 200 <= (answer.status or 200) < 300:
            raise OSError(f"{url}: status {answer.status}")
        return answer.read()


def fetch_text(url: str, headers: dict[str, str] | None = None, timeout: float = TIMEOUT_S) -> str:
    return fetch_bytes(url, headers, timeout).decode("utf-8", "replace")


def kml_url(map_id: str, base: str = "https://www.google.com/maps/d/kml") -> str:
    return f"{base}?mid={quote(map_id, safe='')}&forcekml=1"
