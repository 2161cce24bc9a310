"""Jobs, retention and the schedule (SRC-13, SRT-4, ST-13 to ST-17, ST-20 to ST-22). Job tables are headers, one row a job."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RETENTION_DAYS, RECENT_ERRORS = 30, 10
TIME_OF_DAY = re.compile(r"([01]\d|2[0-3]):[0-5]\d")
MAX_FILES, MAX_VERSIONS = (500, 5000), (20, 100)


def listed(jobs: DataFrame, limit: int | None = None, kinds: list[str] = ()) -> DataFrame:
    """SRC-13, SRT-4: jobs newest first, sorted before the limit is applied."""
    own = jobs.filter(F.col("kind").isin(*kinds)) if kinds else jobs
    ordered = own.orderBy(F.col("started_at").desc(), "job_id")
    return ordered.limit(limit) if limit else ordered


def outcome(counters: DataFrame) -> DataFrame:
    """ST-13: counters (job_id, total, errors) with the final status: failed where all of a non-empty scan failed."""
    return counters.withColumn("status", F.when((F.col("total") > 0) & (F.col("errors") == F.col("total")), "failed").otherwise("completed"))


def with_errors(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """ST-13: the last RECENT_ERRORS errors of each job, the new ones (job_id, ordinal, error) after the old."""
    added = new.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "error"))).alias("_n"))
    every = F.concat(F.coalesce("recent_errors", F.array().cast("array<string>")), F.coalesce(F.transform("_n", lambda e: e["error"]), F.array().cast("array<string>")))
    cut = F.when(F.size(every) > RECENT_ERRORS, F.slice(every, -RECENT_ERRORS, RECENT_ERRORS)).otherwise(every)
    return jobs.join(added, "job_id", "left").withColumn("recent_errors", cut).drop("_n")


def expired(jobs: DataFrame, now: Column, days: int = RETENTION_DAYS, kinds: list[str] = ()) -> DataFrame:
    """ST-14: jobs started more than ``days`` ago that neither wait nor run; jobs without a time stay."""
    old = (F.col("started_at") < now - F.expr(f"INTERVAL {int(days)} DAYS")) & ~F.col("status").isin("queued", "running")
    return jobs.filter(old & F.col("kind").isin(*kinds)) if kinds else jobs.filter(old)


def purged(table: DataFrame, gone: DataFrame) -> DataFrame:
    """ST-15: the rows of any table by job that remain when jobs are gone."""
    return table.join(gone.select("job_id").distinct(), "job_id", "left_anti")


@dataclass(frozen=True)
class Schedule:
    """E22: the one schedule."""

    enabled: bool = False
    time_of_day: str = "02:00"
    time_zone: str = "UTC"
    last_fired_on: date | None = None

    def changed(self, enabled: bool | None = None, time_of_day: str | None = None, time_zone: str | None = None) -> Schedule:
        """ST-16: a partial update, checked first."""
        if enabled is not None and not isinstance(enabled, bool):
            raise ValueError("enabled must be true or false")
        if time_of_day is not None and not (isinstance(time_of_day, str) and TIME_OF_DAY.fullmatch(time_of_day)):
            raise ValueError("time of day must be HH:MM of 24 hours")
        if time_zone is not None:
            try:
                ZoneInfo(time_zone.strip() or "?")
            except (ZoneInfoNotFoundError, ValueError, AttributeError, OSError):
                raise ValueError(f"no such time zone: {time_zone!r}") from None
        given = {"enabled": enabled, "time_of_day": time_of_day, "time_zone": time_zone}
        return replace(self, **{k: v for k, v in given.items() if v is not None})

    def local(self, now: datetime) -> datetime:
        return now.astimezone(ZoneInfo(self.time_zone))

    def is_due(self, now: datetime) -> bool:
        """ST-16: enabled, not fired on this local day, and the local time of day is reached. now has a zone."""
        if not (self.enabled and TIME_OF_DAY.fullmatch(self.time_of_day)):
            return False
        here = self.local(now)
        return here.date() != self.last_fired_on and here.strftime("%H:%M") >= self.time_of_day

    def fired(self, now: datetime) -> Schedule:
        return replace(self, last_fired_on=self.local(now).date())


def due(instants: DataFrame, zone: str, time_of_day: str) -> DataFrame:
    """ST-16 over a table of checks (at without zone, in UTC): adds local_day, local_time, and is_due at the first check of a local day from that time on."""
    local = F.from_utc_timestamp(F.col("at").cast("timestamp"), zone)
    rows = instants.withColumns({"local_day": F.date_format(local, "yyyy-MM-dd"), "local_time": F.date_format(local, "HH:mm")})
    first = rows.filter(F.col("local_time") >= time_of_day).groupBy("local_day").agg(F.min("at").alias("_first"))
    return rows.join(first, "local_day", "left").withColumn("is_due", F.coalesce(F.col("at") == F.col("_first"), F.lit(False))).drop("_first")


def tick(schedule: Schedule, jobs: list[dict], now: datetime, enqueue=None) -> tuple[Schedule, list[dict]]:
    """ST-17: (schedule, new jobs) of one timer call: nothing while a scheduled job waits or runs, which is not counted as fired.

    Else a pages and a documents job that name each other; if ``enqueue`` raises, both have failed.
    """
    if not schedule.is_due(now) or any(j.get("caller") == "schedule" and j["status"] in ("queued", "running") for j in jobs):
        return schedule, []
    stamp = now.strftime("%y%m%d-%H%M%S")
    ids = {"pages": f"pag-{stamp}", "documents": f"doc-{stamp}"}
    made = [{"job_id": ids[k], "kind": k, "status": "queued", "caller": "schedule", "started_at": now, "sibling_job_id": ids["documents" if k == "pages" else "pages"]} for k in ids]
    try:
        for job in made:
            if enqueue:
                enqueue(job)
    except Exception as e:  # a queue that cannot be reached leaves no job that waits for ever
        made = [{**j, "status": "failed", "recent_errors": [str(e)]} for j in made]
    return schedule.fired(now), made


def allow(listed_rows: DataFrame, kind: str, value: str, note: str, by: str, at: datetime) -> DataFrame:
    """ST-20: an allowlist (kind, value, note, added_by, added_at) with one more entry; hashes are one in any case, a known entry stays as it is."""
    if not note.strip():
        raise ValueError("a note is required")
    stored = value.lower() if kind == "hash" else value
    new = listed_rows.sparkSession.createDataFrame([(kind, stored, note, by, at)], listed_rows.schema)
    return listed_rows.unionByName(new.join(listed_rows.select("kind", "value"), ["kind", "value"], "left_anti"))


def disallow(listed_rows: DataFrame, kind: str, value: str) -> DataFrame:
    """ST-20: the allowlist without an entry; it is no error if there is none."""
    stored = value.lower() if kind == "hash" else value
    return listed_rows.filter(~((F.col("kind") == kind) & (F.col("value") == stored)))


def version_job(library_files: DataFrame, library: str, max_files: int | None = None, max_versions: int | None = None) -> tuple[DataFrame, int]:
    """ST-21: (files of one library whose versions are recovered, versions for each); both numbers have defaults and ceilings, which are the feature."""
    pick = lambda asked, bounds: min(asked, bounds[1]) if asked and asked > 0 else bounds[0]
    own = library_files.filter(F.col("library") == library).orderBy("file_ref").limit(pick(max_files, MAX_FILES))
    return own, pick(max_versions, MAX_VERSIONS)


def promotable(job: dict) -> bool:
    """ST-22: only a completed preview of documents becomes a scan; the preview itself is left as it is."""
    return job.get("kind") == "documents" and job.get("status") == "completed" and bool(job.get("is_preview"))


def age_days(at: datetime, now: datetime) -> int:
    return max(0, (now - at) // timedelta(days=1))
