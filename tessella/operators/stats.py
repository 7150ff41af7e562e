"""Collection statistics, qualification, discovery and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times

# Limits of plausible salaries, and the weights and thresholds of a collection's score.
SALARY_MOST, SALARY_ANNUAL = 2_000_000, 1000
WEIGHTS = {"inventory": 25, "diversity": 15, "freshness": 20, "quality": 10, "stability": 10, "uniqueness": 5}
INDEX_SCORE, REVIEW_SCORE, MIN_JOBS, INVENTORY_FULL, MIN_COMPANIES, COMPANIES_FULL = 80, 60, 20, 100, 5, 20
TOP_SHARE, FRESH_DAYS, VERIFIED_DAYS, FRESH_FULL, WEEKS, UNIQUE_FULL, NEAR_SHARE, STALE_DAYS = 0.5, 7, 2, 0.5, 4, 0.5, 0.9, 14


def plausible(x: Column) -> Column:
    return F.coalesce((x > 0) & (x <= SALARY_MOST), F.lit(False))


def salary_listed(low: Column, high: Column, currency: Column) -> Column:
    return (currency.isNull() | (currency == "USD")) & (plausible(low) | plausible(high))


def _median(x: Column, listed: Column) -> Column:
    """Median of annual figures, rounded half to even."""
    return F.bround(F.median(F.when(listed & plausible(x) & (x >= SALARY_ANNUAL), x.cast("double")))).cast("long")


def collection_stats(jobs: DataFrame, as_of: str, by: list[str]) -> DataFrame:
    """Nine counts and two medians of open jobs for each collection, in one pass."""
    now = F.lit(as_of).cast("timestamp")
    since = now - F.expr("INTERVAL 24 HOURS")
    today, first = (F.to_date(times.local(t, times.EASTERN)) for t in (now, since))
    listed = salary_listed(F.col("salary_min"), F.col("salary_max"), F.col("salary_currency"))
    last_day = lambda c: F.count_if((F.col(c) > since) & (F.col(c) <= now))
    return (
        jobs.where(~F.col("closed"))
        .groupBy(*by)
        .agg(
            F.count("*").alias("open_jobs"),
            F.countDistinct(F.coalesce("company_key", "domain")).alias("companies_hiring"),
            *(F.count_if(F.col("workplace") == w).alias(f"{w}_jobs") for w in ("remote", "hybrid", "onsite")),
            F.count_if(listed).alias("jobs_with_salary"),
            F.count_if(F.col("posted_at").between(first, today)).alias("jobs_posted_24h"),
            last_day("found_at").alias("jobs_found_24h"),
            last_day("last_seen_at").alias("jobs_verified_24h"),
            _median(F.col("salary_min"), listed).alias("median_salary_min"),
            _median(F.col("salary_max"), listed).alias("median_salary_max"),
        )
    )


def share(value: Column, full: Column) -> Column:
    return F.when(full > 0, F.least(F.lit(1.0), value / full)).otherwise(1.0)


def qualify(jobs: DataFrame, as_of: str, by: list[str], parents: DataFrame | None = None) -> DataFrame:
    """The six active parts of each collection's score, total, issues and recommendation.

    `parents` (the same keys, parent_size) holds the open jobs of what a collection narrows; without it uniqueness is full.
    """
    now = F.lit(as_of).cast("timestamp")
    open_ = jobs.where(~F.col("closed")).withColumn("employer", F.coalesce("company_key", "domain"))
    today = F.to_date(times.local(now, times.EASTERN))
    fresh_from = F.date_sub(today, FRESH_DAYS - 1)
    wall = lambda t: F.unix_timestamp(times.local(t, times.EASTERN))
    since = lambda c: wall(now) - wall(F.col(c))
    fresh = (F.to_date(times.local(F.col("found_at"), times.EASTERN)) >= fresh_from) | F.col("posted_at").between(fresh_from, today) | (since("last_seen_at") <= VERIFIED_DAYS * 86400)
    week = F.when(since("found_at") >= 0, F.floor(since("found_at") / 604800))
    listed = salary_listed(F.col("salary_min"), F.col("salary_max"), F.col("salary_currency"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    complete = flag(listed) + flag(F.col("workplace") != "unknown") + flag(F.col("posted_at").isNotNull()) + flag((F.size("areas") > 0) | (F.col("workplace") == "remote"))
    top = open_.groupBy(*by, "employer").agg(F.count("*").alias("k")).groupBy(*by).agg(F.max("k").alias("top"), F.count("employer").alias("companies"))
    sums = open_.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(flag(fresh)).alias("fresh"), F.sum(complete).alias("complete"),
        F.size(F.array_intersect(F.collect_set(week), F.sequence(F.lit(0).cast("long"), F.lit(WEEKS - 1).cast("long")))).alias("weeks"),
        F.least(F.min(since("found_at")), F.min(since("last_seen_at"))).alias("quiet"),
    )
    df = sums.join(top, by)
    df = df.join(parents, by, "left") if parents is not None else df.withColumn("parent_size", F.lit(None).cast("long"))
    n, top_share = F.col("n"), F.col("top") / F.col("n")
    concentration = F.when(top_share <= TOP_SHARE, 1.0).otherwise((1 - top_share) / (1 - TOP_SHARE))
    within = n / F.col("parent_size")
    has_parent = F.coalesce(F.col("parent_size") > 0, F.lit(False))
    shares = {
        "inventory": share(n, F.lit(INVENTORY_FULL)),
        "diversity": share(F.col("companies"), F.lit(COMPANIES_FULL)) * concentration,
        "freshness": share(F.col("fresh"), n * FRESH_FULL),
        "quality": F.col("complete") / (4 * n),
        "stability": F.col("weeks") / WEEKS,
        "uniqueness": F.when(has_parent, share(1 - within, F.lit(1 - UNIQUE_FULL))).otherwise(1.0),
    }
    df = df.withColumns({f"{k}_score": F.bround(v * WEIGHTS[k], 1) for k, v in shares.items()})
    total = F.bround(100 * sum((F.col(f"{k}_score") for k in shares), F.lit(0.0)) / sum(WEIGHTS.values())).cast("int")
    problems = {
        "too_few_jobs": n < MIN_JOBS, "too_few_employers": F.col("companies") < MIN_COMPANIES, "one_employer_dominates": top_share > TOP_SHARE,
        "near_duplicate": has_parent & (within >= NEAR_SHARE), "stale": F.col("quiet") > STALE_DAYS * 86400,
    }
    issues = F.array_join(F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in problems.items())), lambda x: x.isNotNull()), ",")
    df = df.withColumn("total", total).withColumn("issues", issues)
    verdict = F.when((F.col("total") >= INDEX_SCORE) & (F.col("issues") == ""), "index").when(F.col("total") >= REVIEW_SCORE, "review").otherwise("noindex")
    return df.withColumn("recommendation", verdict).select(*by, "n", "companies", *(f"{k}_score" for k in shares), "total", "issues", "recommendation")


def candidates(jobs: DataFrame, families: dict[str, list[str]], least: int) -> DataFrame:
    """(family, key, n) of every group of open jobs with at least `least` members, for several groupings in one pass."""
    open_ = jobs.where(~F.col("closed"))
    keys = sorted({c for cs in families.values() for c in cs})
    lists = F.array(*(F.struct(F.lit(f).alias("family"), F.concat_ws("|", *(F.col(c).cast("string") for c in cs)).alias("key")) for f, cs in families.items()))
    rows = open_.select(*keys).select(F.explode(lists).alias("x")).select("x.family", "x.key")
    return rows.groupBy("family", "key").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def transition(status: Column, total: Column, issues: Column) -> Column:
    """The next state of a collection: what qualifies goes live, what fell below review is retired, what is in between waits."""
    good = (total >= INDEX_SCORE) & (issues == "")
    return (
        F.when(status.isin("rejected", "merged"), status)
        .when(good & status.isin("candidate", "review", "retired"), "active")
        .when((total < REVIEW_SCORE) & (status == "active"), "retired")
        .when((total >= REVIEW_SCORE) & (status == "candidate"), "review")
        .otherwise(status)
    )


def sections(jobs: DataFrame, section: str, group: str, newest: list[Column], k: int, least: int) -> DataFrame:
    """(section, group, group_size, group_rank, rank, id): groups of at least `least`, largest first, with their k newest jobs."""
    # Sizes are counted apart, so that no group is held whole and ranks are cut before the shuffle.
    sizes = jobs.groupBy(section, group).agg(F.count("*").alias("group_size")).where(F.col("group_size") >= least)
    order = F.row_number().over(Window.partitionBy(section).orderBy(F.desc("group_size"), F.asc(group)))
    ranked = sizes.withColumn("group_rank", order).withColumnsRenamed({section: "_section", group: "_group"})
    rank = F.row_number().over(Window.partitionBy(section, group).orderBy(*newest))
    few = jobs.withColumn("rank", rank).where(F.col("rank") <= k)
    same = F.col(section).eqNullSafe(F.col("_section")) & F.col(group).eqNullSafe(F.col("_group"))
    return few.join(ranked, same).select(section, group, "group_size", "group_rank", "rank", "id")


def mode_and_share(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, mode, share, n): the commonest value, the least of equals, and its share of the rows that have one."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("k"))
    best = F.min(F.struct((-F.col("k")).alias("k"), F.col(value).alias("v")))
    return counts.groupBy(*by).agg(best.alias("b"), F.sum("k").alias("n")).select(*by, F.col("b.v").alias("mode"), (-F.col("b.k") / F.col("n")).alias("share"), "n")


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval; 0 and 0 without cases."""
    p, zz = k / n, z * z
    centre = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.when(n > 0, centre - half).otherwise(0.0), F.when(n > 0, centre + half).otherwise(0.0)


def stratified(df: DataFrame, stratum: str, id_col: str, limit: int, cap: int, seed: str) -> DataFrame:
    """At most `limit` rows: of each stratum its share, at least one and at most `cap`, topped up from the rest.

    The order is that of SHA-256 over seed and id, so a sample can be drawn again anywhere. Rows without a stratum are one of their own.
    No stratum is sorted whole: ranks beyond the limit, which no sample has, are cut before the shuffle.
    """
    h = F.sha2(F.concat(F.lit(seed), F.col(id_col).cast("string")).cast("binary"), 256)
    sizes = df.groupBy(stratum).agg(F.count("*").alias("size"))
    total = df.agg(F.count("*").alias("total"))
    quota = F.least(F.lit(cap), F.greatest(F.lit(1), F.ceil(limit * F.col("size") / F.col("total")))).cast("int")
    ranked = df.withColumn("h", h).withColumn("r", F.row_number().over(Window.partitionBy(stratum).orderBy("h", id_col))).where(F.col("r") <= limit)
    of = sizes.join(F.broadcast(total)).select(F.col(stratum).alias("_of"), quota.alias("_quota"))
    picked = ranked.join(of, F.col(stratum).eqNullSafe(F.col("_of"))).withColumn("extra", (F.col("r") > F.col("_quota")).cast("int"))
    return picked.orderBy("extra", "h", id_col).limit(limit).select(*df.columns)
