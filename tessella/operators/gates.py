"""Who is listed, due or wanted: conditions over postings, registered URLs and their companions, as single columns.

Each takes the instant as an argument, so that a condition is a constant range that reaches the scan.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.times import EASTERN

# Days that a page lives after its posting and after it was last seen; plausible salaries; miles around a city; what ages ask for a new logo look-up.
LIVE_DAYS, SEEN_DAYS = 60, 14
SALARY_FLOORS, MOST_SALARY = (50_000, 75_000, 100_000, 150_000, 200_000), 2_000_000
RADIUS_MILES = 25.0
LOGO_DAYS = {"ok": 90, "error": 1, "miss": 30}
#: Freshness: what it goes by, and how many local days back including today.
FRESH = {"posted-today": ("posted_at", 1), "posted-this-week": ("posted_at", 7), "found-today": ("found_at", 1), "found-this-week": ("found_at", 7), "verified-today": ("last_seen_at", 1)}


def _instant(x: datetime | date) -> Column:
    return F.lit(str(x)).cast("timestamp")


def canonical() -> Column:
    """Scanned with success, titled, nobody's copy, and open. Columns: status, title, primary, closed_at."""
    return (F.col("status") == "success") & F.col("title").isNotNull() & F.col("primary").isNull() & F.col("closed_at").isNull()


def live_page(now: str, country: str = "US") -> Column:
    """Postings that keep a page, open or closed: canonical but for that, of the country, unflagged, and young or seen of late."""
    at = datetime.fromisoformat(now)
    young = at - timedelta(days=LIVE_DAYS)
    fresh = (F.col("posted_at") >= F.lit(young.date())) | (F.col("posted_at").isNull() & (F.col("found_at") >= _instant(young)))
    seen = F.col("source").isNotNull() & (F.col("last_seen_at") >= _instant(at - timedelta(days=SEEN_DAYS)))
    kept = (F.col("status") == "success") & F.col("title").isNotNull() & F.col("primary").isNull()
    return kept & (F.col("country") == country) & F.col("flagged_at").isNull() & (fresh | seen)


def retry_due(now: str) -> Column:
    """Failed scans of open URLs whose wait is over."""
    return (F.col("status") == "failed") & (F.col("next_retry_at") <= _instant(datetime.fromisoformat(now))) & F.col("closed_at").isNull()


def follow_up_due(day: str, done: list[str]) -> Column:
    """Applications to be followed up by this day, once, unless archived or over."""
    return (F.col("follow_up_at") <= F.lit(day).cast("date")) & F.col("reminded_at").isNull() & ~F.col("archived") & ~F.col("status").isin(done)


def logo_due(now: str) -> Column:
    """Companies never looked up, or not since the age that their last result allows."""
    at = datetime.fromisoformat(now)
    older = lambda kind: F.col("logo_checked_at") < _instant(at - timedelta(days=LOGO_DAYS[kind]))
    status = F.col("logo_status")
    return status.isNull() | F.when(status == "ok", older("ok")).when(status == "error", older("error")).otherwise(older("miss"))


def sector_wanted(country: str = "US") -> Column:
    """Postings of the country, of none that is known, or remote."""
    return F.col("country").isNull() | (F.col("country") == country) | (F.col("workplace") == "remote")


def among(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose keys, taken together, are among those given."""
    return df.join(keys.select(*on).distinct(), on, "left_semi")


def _days(now: str, back: int) -> tuple[date, date]:
    today = datetime.fromisoformat(now).replace(tzinfo=ZoneInfo("UTC")).astimezone(ZoneInfo(EASTERN)).date()
    return today - timedelta(days=back - 1), today


def _start(day: date) -> Column:
    """The UTC instant at which an Eastern day starts."""
    at = datetime(day.year, day.month, day.day, tzinfo=ZoneInfo(EASTERN)).astimezone(ZoneInfo("UTC"))
    return _instant(at.replace(tzinfo=None))


def freshness(slug: str, now: str) -> Column | None:
    """Dates lie between the first day and today; instants from the first day's start to the end of today, both Eastern."""
    if slug not in FRESH:
        return None
    basis, back = FRESH[slug]
    first, today = _days(now, back)
    if basis == "posted_at":
        return F.col(basis).between(F.lit(first), F.lit(today))
    return (F.col(basis) >= _start(first)) & (F.col(basis) < _start(today + timedelta(days=1)))


def salary_floor(slug: str) -> Column | None:
    """`100k-plus`: the lower end, or else the upper, is plausible and at least that, in dollars or no stated currency."""
    floor = {f"{x // 1000}k-plus": x for x in SALARY_FLOORS}.get(slug)
    if floor is None:
        return None
    plausible = F.coalesce("salary_min", "salary_max").between(floor, MOST_SALARY)
    return plausible & (F.col("salary_currency").isNull() | (F.col("salary_currency") == "USD"))


def dimension(kind: str, slug: str, now: str, names: dict[str, dict[str, str]]) -> Column | None:
    """The condition that a kind and a slug stand for; None if either isn't known.

    `names` has, for category, role and location, what each slug is called in the rows.
    """
    if kind == "freshness":
        return freshness(slug, now)
    if kind == "salary":
        return salary_floor(slug)
    if (kind, slug) == ("location", "remote"):
        return F.col("workplace") == "remote"
    value = names.get(kind, {}).get(slug)
    if value is None:
        return None
    return {"category": F.col("sector") == value, "role": F.array_contains("standard_titles", value), "location": F.array_contains("areas", value)}[kind]


def collection(dimensions: dict[str, str], now: str, names: dict[str, dict[str, str]]) -> Column:
    """All of a collection's dimensions; one that isn't known matches nothing."""
    parts = [dimension(kind, slug, now, names) for kind, slug in dimensions.items()]
    return F.lit(False) if any(p is None for p in parts) else reduce(lambda a, b: a & b, parts, F.lit(True))


def location_like(text: str) -> Column:
    """One of the posting's places contains the text, in any case."""
    return F.exists("locations", lambda x: F.lower(x).contains(text.lower()))


def near_city(lat: float, lon: float, miles: float = RADIUS_MILES) -> Column:
    """One of the posting's points lies within so many miles. Column: points (array of lat, lon)."""
    return F.coalesce(geo.nearest_point(F.col("points"), F.lit(lat), F.lit(lon)) <= miles, F.lit(False))


def located(text: str, labels: dict[str, str], states: dict[str, list[str]], countries: tuple[str, ...] = ("united states", "usa", "us"), cities: dict[str, tuple[float, float]] | None = None, miles: float = RADIUS_MILES) -> Column:
    """The condition for a location that was typed: the area of that label, a radius around that city, the whole country, else a
    state's areas or the text."""
    low = text.strip().lower()
    if low in labels:
        return F.array_contains("areas", labels[low])
    if low in (cities or {}):
        return near_city(*cities[low], miles)
    if low in countries:
        return (F.col("country") == "US") | (F.size("areas") > 0) | location_like(low)
    return reduce(lambda a, b: a | b, (F.array_contains("areas", c) for c in states.get(low, [])), location_like(low))


def in_metro(slug: str, areas: dict[str, str]) -> Column:
    """Filed under the area of a slug; one that isn't known matches nothing."""
    return F.array_contains("areas", areas[slug]) if slug in areas else F.lit(False)
