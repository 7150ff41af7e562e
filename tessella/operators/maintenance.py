"""Incremental maintenance: coverage, schedules, retries and presence on boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The drop detector, the crawl schedule, retries, and the daily limit of closures.
WARM_UP, DROP, STREAK, ALPHA = 5, 0.5, 3, 0.3
SHRINK, GROW, SHORTEST, LONGEST = 0.5, 1.5, 120, 4320
CLOSE_LEAST, CLOSE_SHARE = 10, 0.2


def coverage(counts: DataFrame, key: str, order: str, count: str) -> DataFrame:
    """(key, samples, baseline, low_streak, flagged_at) after all counts of each source, in order.

    The baseline is a running mean at first, then exponentially smoothed; counts below half of it leave it frozen,
    and the third such in a row raises the flag, which falls with the next good count. A source's history is one
    array, as long as its number of crawls.
    """
    history = counts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(count).cast("double").alias("c")))).alias("h"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("base"), F.lit(0).alias("low"), F.lit(None).cast(counts.schema[order].dataType).alias("flag"))

    def step(s: Column, x: Column) -> Column:
        warm = s["n"] < WARM_UP
        low = ~warm & (s["base"] > 0) & (x["c"] < s["base"] * DROP)
        streak = F.when(low, s["low"] + 1).otherwise(0)
        base = F.when(warm, s["base"] + (x["c"] - s["base"]) / (s["n"] + 1)).when(low, s["base"]).otherwise(s["base"] + ALPHA * (x["c"] - s["base"]))
        flag = F.when(low & (streak >= STREAK), F.coalesce(s["flag"], x["at"])).when(low, s["flag"])
        return F.struct((s["n"] + 1).alias("n"), base.alias("base"), streak.alias("low"), flag.alias("flag"))

    end = history.select(key, F.aggregate("h", zero, step).alias("s"))
    return end.select(key, F.col("s.n").alias("samples"), F.col("s.base").alias("baseline"), F.col("s.low").alias("low_streak"), F.col("s.flag").alias("flagged_at"))


def next_interval(current: Column, new: Column, failed: Column) -> Column:
    """Minutes to the next crawl: half after new postings, half as long again after none, unchanged after a failure."""
    step = F.when(failed, current.cast("double")).when(new > 0, current * SHRINK).otherwise(current * GROW)
    return F.greatest(F.lit(SHORTEST), F.least(F.lit(LONGEST), F.bround(step).cast("int")))


def backoff(attempts: Column, base: float = 60, factor: float = 4, longest: float = 86400, give_up: int = 5) -> Column:
    """Seconds to the next try after so many failures; null once it is given up."""
    return F.when(attempts < give_up, F.least(F.lit(longest), base * F.pow(F.lit(factor), attempts - 1)))


def interval_tier(minutes: Column) -> Column:
    return F.when(minutes <= 120, "2h").when(minutes <= 720, "12h").when(minutes <= 1440, "1d").otherwise("3d")


def sources_due(sources: DataFrame, as_of: str, k: int, claim_minutes: int = 30) -> DataFrame:
    """The k sources to crawl next: active, unclaimed or with a claim that lapsed, never scheduled or due; never scheduled ones first."""
    now = F.lit(as_of).cast("timestamp")
    free = F.col("claimed_at").isNull() | (F.col("claimed_at") < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(claim_minutes)))
    due = F.col("next_at").isNull() | (F.col("next_at") <= now)
    return sources.where(F.col("active") & free & due).orderBy(F.asc_nulls_first("next_at"), "id").limit(k)


def presence(registry: DataFrame, listed: DataFrame, as_of: str, gap_hours: float = 1, refresh_hours: float = 6) -> DataFrame:
    """The registry after crawls of some boards.

    registry: source, url, last_seen_at, missing_since, closed_at. listed: source, healthy, and the urls seen (url null for
    an empty listing). Listed URLs are stamped (only if the stamp is old or they were missing) and reopened.
    Unlisted open URLs of healthy crawls get a miss; the second, an hour or more after, closes them, oldest first
    within the source's daily limit, which counts what was closed in the last day.
    """
    now = F.lit(as_of).cast("timestamp")
    hours = lambda h: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(h * 3600.0))
    seen = listed.where("url IS NOT NULL").select("source", "url", F.lit(True).alias("seen")).distinct()
    crawls = listed.groupBy("source").agg(F.bool_and("healthy").alias("healthy"))
    df = registry.join(seen, ["source", "url"], "left").join(crawls, "source", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    open_ = F.col("closed_at").isNull()
    missed = F.coalesce("healthy", F.lit(False)) & ~F.col("seen") & open_
    again = missed & F.coalesce(F.col("missing_since") <= now - hours(gap_hours), F.lit(False))
    per = df.groupBy("source").agg(F.count_if(open_).alias("open"), F.count_if(F.col("closed_at") >= now - hours(24)).alias("recent"))
    df = df.join(per, "source").withColumn("again", again)
    # Only what was missed again is ranked, a small share of a board, and joined back.
    order = Window.partitionBy("source").orderBy("missing_since", "url")
    limit = F.greatest(F.lit(CLOSE_LEAST), F.floor((F.col("open") + F.col("recent")) * CLOSE_SHARE)) - F.col("recent")
    due = df.where("again").select("source", "url", limit.alias("limit"), F.row_number().over(order).alias("r")).where("r <= limit")
    df = df.join(due.select("source", "url", F.lit(True).alias("_due")), ["source", "url"], "left")
    closes = F.coalesce("_due", F.lit(False))
    stamp = F.col("last_seen_at").isNull() | (F.col("last_seen_at") < now - hours(refresh_hours)) | F.col("missing_since").isNotNull() | ~open_
    return df.withColumn("closes", closes).select(
        "source", "url",
        F.when(F.col("seen") & stamp, now).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.when(F.col("seen"), F.lit(None)).when(missed & F.col("missing_since").isNull(), now).otherwise(F.col("missing_since")).alias("missing_since"),
        F.when(F.col("seen"), F.lit(None)).when(F.col("closes"), now).otherwise(F.col("closed_at")).alias("closed_at"),
    )
