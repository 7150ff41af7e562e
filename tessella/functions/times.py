"""Calendar expressions. Instants are UTC; local days are those of a named zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EASTERN = "America/New_York"


def local(ts: Column, zone: str) -> Column:
    """The wall clock of a zone at a UTC instant."""
    return F.from_utc_timestamp(ts.cast("timestamp"), zone)


def bucket(ts: Column, unit: str, zone: str = "UTC") -> Column:
    """Start of the local hour, day, ISO week or month."""
    return F.date_trunc(unit, local(ts, zone))


def day_start_utc(day: Column, zone: str) -> Column:
    """The instant at which a local day starts, on days of clock changes too."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def listed_at(posted: Column, first_scan: Column) -> Column:
    """Midnight UTC of the posting day if that is before the day of the first scan, else the first scan."""
    return F.when(posted < F.to_date(first_scan), posted.cast("timestamp")).otherwise(first_scan)


def job_day(posted: Column, found: Column) -> Column:
    """The posting day, else the Eastern day on which it was found."""
    return F.coalesce(posted, F.to_date(local(found, EASTERN)))


def age_weeks(now: Column, ts: Column) -> Column:
    """Whole weeks by the Eastern wall clock; clock changes don't count."""
    wall = lambda t: F.unix_timestamp(local(t, EASTERN))
    return F.floor((wall(now) - wall(ts)) / 604800)


def tolerant_date(text: Column) -> Column:
    """The UTC day of an ISO date or instant, with or without zone; null for anything else."""
    fine = text.rlike(r"^\s*\d{4}-\d{2}-\d{2}([T ].*)?$")
    return F.when(fine, F.coalesce(F.to_date(F.try_to_timestamp(F.trim(text))), F.try_to_date(F.substring(F.trim(text), 1, 10), "yyyy-MM-dd")))


def month_day_year(text: Column) -> Column:
    """The day of '10/26/2026' or '10-26-2026'; null for anything else."""
    plain = F.regexp_replace(F.trim(text), "-", "/")
    return F.when(plain.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(plain, "M/d/yyyy"))


def is_recent(day: Column, today: str, days: int = 7) -> Column:
    """Within the last `days` days, today included and no later."""
    end = F.lit(today).cast("date")
    return day.between(F.date_sub(end, days - 1), end)


def months_back(day: Column, n: int) -> Column:
    """The first day of the month n months before."""
    return F.to_date(F.add_months(F.trunc(day, "month"), -n))


def jittered(minutes: Column, key: Column, share: float = 0.1) -> Column:
    """Minutes moved by up to the share either way, by the key's hash: the same at each run."""
    unit = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / 4294967295.0
    return F.bround(minutes * (1 + share * (2 * unit - 1)), 3)
