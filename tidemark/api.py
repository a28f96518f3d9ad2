"""The served routes as methods: each reads versioned tables, runs a query and gives what a client gets."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import catalog, classification, notices, snapshot, store
from tidemark.sources import config


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    return [r.asDict(recursive=True) for r in df.collect()]


class Service:
    """Tables below ``root``: notices, reports, logs and classifications."""

    def __init__(self, spark: SparkSession, root: str, settings: config.Settings | None = None, clock: Callable[[], dt.datetime] | None = None):
        self.spark, self.settings = spark, settings or config.Settings()
        self.clock = clock or (lambda: dt.datetime.now(dt.UTC).replace(tzinfo=None))
        self.notices = store.Table(spark, f"{root}/notices", schemas.NOTICES)
        self.reports = store.Table(spark, f"{root}/reports", schemas.USER_REPORTS)
        self.logs = store.Table(spark, f"{root}/logs", schemas.LOGS)
        self.classes = store.Table(spark, f"{root}/classifications", schemas.CLASSIFICATIONS)
        self.catalog = catalog.Catalog()
        self._kept: dict[tuple, tuple[float, Any]] = {}

    def _now(self):
        return F.lit(self.clock().isoformat(sep=" ")).cast("timestamp_ntz")

    def _cached(self, name: str, make: Callable[[], Any]) -> Any:
        """What was made for this version of the notices, for as long as the settings say."""
        key, at = (name, self.notices.version()), time.monotonic()
        if key not in self._kept or self._kept[key][0] < at:
            self._kept[key] = (at + self.settings.cache_ttl_ms / 1000, make())
        return self._kept[key][1]

    def _log(self, description: str) -> None:
        self.logs.commit(notices.log(self.logs.read(), description, self._now()))

    # Public.

    def get_notices(self, query: dict[str, str], review: bool = False) -> dict:
        args = notices.page_args(query, review)
        page = notices.notice_page(self.notices.read(), args, self._now(), needs_review=review)
        order = [r.id for r in page.select("id").collect()]
        made = {r["id"]: r for r in _rows(notices.served(page))}
        return notices.envelope([made[i] for i in order], args)

    def notice_metrics(self) -> dict:
        def make():
            kinds = self.spark.createDataFrame([(k,) for k in schemas.KINDS], "kind string")
            rows = {r["kind"]: r for r in _rows(notices.metrics(self.notices.read(), kinds, self._now()))}
            total = {c: sum(r[c] for r in rows.values()) for c in ("total", "public", "needs_review", "active_public", "active_review")}
            return {"asOf": self.clock().isoformat(), **total, "byKind": [rows[k] for k in schemas.KINDS]}

        return self._cached("metrics", make)

    def manifest(self) -> dict:
        def make():
            row = _rows(notices.manifest(self.notices.read(), self._now()))[0]
            return {"asOf": self.clock().isoformat(), "notices": row, "datasetsRevision": self.catalog.revision(self.spark)}

        return self._cached("manifest", make)

    def datasets(self) -> list[dict]:
        names = self.spark.createDataFrame([(d.key, d.name) for d in self.catalog.datasets.values() if d.key in self.catalog.entries], "key string, name string")
        hidden = {"payload", "site_codes"}
        return [{"key": r.key, "name": r.name} | {k: v for k, v in self.catalog.entries[r.key].items() if k not in hidden} for r in catalog.by_name(names).collect()]

    def dataset(self, key: str, if_none_match: str | None = None) -> tuple[int, str | None]:
        """(200, payload), or (304, None) if the client has it."""
        entry = self.catalog.get(key)
        return (304, None) if catalog.etag_matches(if_none_match, f'"{entry["sha256"]}"') else (200, entry["payload"])

    def report_notice(self, id_: str) -> None:
        rows, unknown = notices.count_reports(self.notices.read(), self.spark.createDataFrame([(id_,)], "id string"))
        if not unknown.isEmpty():
            raise KeyError(id_)
        self.notices.commit(rows)

    def create_report(self, title: str, description: str, latitude: float, longitude: float) -> dict:
        row = self.spark.createDataFrame([(title, description, float(latitude), float(longitude))], "title string, description string, latitude double, longitude double")
        good, bad = notices.accept_reports(row)
        if wrong := [r for r in bad.collect() if r.errors]:
            raise notices.Invalid(", ".join(wrong[0].errors))
        now = self._now()
        # the id is made here: a column with uuid() would be another one each time it is read
        made = [r.asDict() for r in good.collect()]
        if not made:
            return {"accepted": False}
        import uuid

        id_ = str(uuid.uuid4())
        stored = good.withColumns({"id": F.lit(id_), "createdAt": now, "updatedAt": now}).select(self.reports.read().columns)
        self.reports.commit(self.reports.read().unionByName(stored))
        return {"accepted": True, "id": id_}

    # Administration.

    def flagged(self, least: int = 1, limit: int = 100, offset: int = 0) -> dict:
        args = notices.Page(limit, offset)
        page = notices.flagged_page(self.notices.read(), least, limit, offset)
        order = [r.id for r in page.select("id").collect()]
        made = {r["id"]: r for r in _rows(notices.served_flagged(page))}
        return notices.envelope([made[i] for i in order], args)

    def user_reports(self, resolved: bool = False, limit: int = 100, offset: int = 0) -> dict:
        return notices.envelope(_rows(notices.reports_page(self.reports.read(), resolved, limit, offset)), notices.Page(limit, offset))

    def view_logs(self, kind: str | None = None, since: dt.datetime | None = None, limit: int = 100, offset: int = 0) -> dict:
        start = F.lit(since.isoformat(sep=" ")).cast("timestamp_ntz") if since else None
        return notices.envelope(_rows(notices.logs_page(self.logs.read(), kind, start, limit, offset)), notices.Page(limit, offset))

    def zones(self) -> dict:
        rows = notices.zone_map(self.notices.read())
        return {"features": _rows(rows), **_rows(notices.zone_map_totals(rows))[0]}

    def approve(self, id_: str) -> None:
        self.notices.commit(notices.approve(self.notices.read(), id_))

    def dismiss(self, id_: str) -> None:
        self.notices.commit(notices.dismiss(self.notices.read(), id_))

    def reject(self, id_: str) -> None:
        self.notices.commit(notices.remove(self.notices.read(), id_))

    def resolve_report(self, id_: str) -> None:
        self.reports.commit(notices.resolve(self.reports.read(), id_))

    def delete_report(self, id_: str) -> None:
        self.reports.commit(notices.remove(self.reports.read(), id_))

    def add_notice(self, body: str) -> None:
        """A notice from a JSON text."""
        row = notices.parse_notices(self.spark.createDataFrame([(body,)], "json string"))
        if wrong := row.first().errors:
            raise notices.Invalid(", ".join(wrong))
        rows, logs = notices.add(self.notices.read(), row.select("notice.*"), self.logs.read(), self._now())
        self.notices.commit(rows)
        self.logs.commit(logs)

    # Jobs.

    def import_zones(self, placemarks: DataFrame, touches_sea=None, enrich=None) -> dict[str, int]:
        if self.notices.read().filter(F.col("source") == schemas.ZONE_SOURCE).isEmpty():
            counts = snapshot.bootstrap(self.notices, placemarks, self._now(), touches_sea, enrich)
        else:
            rows, counts = snapshot.run_import(self.notices.read(), placemarks, self._now(), touches_sea, enrich)
            self.notices.commit(rows)
        self._log("Zones imported: " + ", ".join(f"{k} {v}" for k, v in counts.items()))
        return counts

    def import_classes(self, sites: DataFrame) -> dict:
        """Classes of a report, after the rails: enough sites, and enough of them known."""
        from tidemark.sources import reports

        reports.assert_enough(sites)
        codes = self.catalog.entries.get(schemas.BEACHES, {}).get("site_codes") or []
        classification.assert_overlap(sites, self.spark.createDataFrame([(c,) for c in codes], "siteCode string"))
        rows, gone = classification.replace(self.classes.read(), sites)
        self.classes.commit(rows.select("siteCode", "classification", "healthWarning", "publishedOn", F.lit(None).cast("string").alias("sourceUrl")))
        merged = self.catalog.set_classes(self.classes.read())
        self._log(f"Classes imported: {merged['merged']} merged, {gone} gone")
        return merged | {"deleted": gone}

    def prune_logs(self) -> None:
        self.logs.commit(notices.retained(self.logs.read(), self._now(), self.settings.log_retention_days))

    def health(self) -> dict:
        return self.catalog.status()
