"""From scan results to stored postings: every derived column of a scan, and its merge into the row that a URL already has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, names, text
from ..functions.shown import fitted
from . import resolver

# Lengths of stored columns, and what stands for a workplace or kind of employment that isn't known.
LENGTHS = {"title": 255, "company": 255, "location": 255, "salary_currency": 3}
UNKNOWN = "unknown"


def official_names(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """All columns of `jobs` (with page_company and source) and `company`, the name that a job shows.

    sources: source, name, official, confirmed, sub_brands. A job of an official, confirmed source has the source's brand, or the first sub-brand that its page
    names. Any other has its page's name, cleaned, or the official name with the very same key: names of sources go before their sub-brands. Official names are
    one row a key, whatever the number of sources.
    """
    brand = names.brand_of_source(F.col("name"))
    usable = sources.withColumn("_brand", F.when(F.col("confirmed"), brand))
    official = usable.where(F.col("official") & F.col("confirmed"))
    first = official.where("_brand IS NOT NULL").select(text.company_key(F.col("_brand")).alias("_key"), F.lit(0).alias("tier"), "source", F.lit(0).alias("pos"), F.col("_brand").alias("_name"))
    second = official.select(F.col("source"), F.posexplode("sub_brands").alias("pos", "_name")).select(text.company_key(F.col("_name")).alias("_key"), F.lit(1).alias("tier"), "source", "pos", "_name")
    known = first.union(second).where("_key IS NOT NULL").groupBy("_key").agg(F.min(F.struct("tier", "source", "pos", "_name"))["_name"].alias("_official"))
    cleaned = F.coalesce(names.display_company(F.col("page_company")), F.col("page_company"))
    own = usable.where("official").select("source", F.col("_brand").alias("_own"), F.col("sub_brands").alias("_subs"), F.col("name").alias("_label"), F.lit(True).alias("_is_official"))
    met = jobs.join(own, "source", "left").withColumn("_clean", cleaned).withColumn("_key", text.company_key(F.col("_clean"))).join(known, "_key", "left")
    at_source = F.when(F.col("_own").isNotNull(), F.coalesce(names.sub_brand(F.col("_subs"), F.col("page_company")), F.col("_own"))).otherwise(names.company_shown(F.col("page_company"), F.col("_label")))
    shown = F.when(F.coalesce("_is_official", F.lit(False)), at_source).otherwise(F.coalesce("_official", "_clean"))
    return met.select(*[c for c in jobs.columns if c != "company"], shown.alias("company"))


def derived(scans: DataFrame, sources: DataFrame, gazetteer: resolver.Gazetteer) -> DataFrame:
    """The rows to store of scans: url_id, source, success, title, company, location, workplace, employment, salary_min, salary_max, salary_currency,
    description, posted_at, at. Adds page_company, locations, areas, points, country, company_key, title_key.

    Entities are decoded and zero bytes dropped before anything is derived, and texts are cut to their columns; locations come from the whole text.
    What a location says of the workplace replaces a guess. Repeated scans of a URL count once, the latest.
    """
    last = scans.where("url_id IS NOT NULL").withColumn("_r", F.struct("at", F.xxhash64(*scans.columns))).groupBy("url_id").agg(F.max_by(F.struct(*[c for c in scans.columns if c != "url_id"]), "_r").alias("s")).select("url_id", "s.*")
    plain = lambda c: F.replace(html.unescaped(c), F.lit("\x00"), F.lit(""))
    decoded = last.select(*[(plain(c).alias(c) if c in ("title", "company", "location", "description") else F.col(c)) for c in last.columns])
    named = official_names(decoded.withColumn("page_company", fitted(F.col("company"), LENGTHS["company"])), sources)
    placed = named.withColumn("locations", text.split_locations(F.col("location")))
    known = resolver.filed(placed, gazetteer, "url_id", "locations").withColumnRenamed("id", "url_id")
    entries = placed.select("url_id", F.explode("locations").alias("entry")).join(resolver.resolve(placed.select(F.explode("locations").alias("entry")), gazetteer).select("entry", "workplace", "geo"), "entry")
    said = entries.groupBy("url_id").agg(F.collect_list(F.struct("workplace", "geo")).alias("_said"))
    full = placed.join(known, "url_id", "left").join(said, "url_id", "left")
    work = names.workplace_agreed(F.coalesce("workplace", F.lit(UNKNOWN)), names.workplace_of(F.coalesce("_said", F.array().cast("array<struct<workplace:string,geo:string>>"))))
    cut = {c: fitted(F.col(c), n) for c, n in LENGTHS.items()}
    out = full.withColumns({**cut, "workplace": work, "employment": F.coalesce("employment", F.lit(UNKNOWN))}).drop("_said")
    return out.withColumns({"company_key": text.company_key(F.col("company")), "title_key": text.title_key(F.col("title"))})


def better(new: Column, old: Column, sentinel: str | None = None) -> Column:
    """The new value unless it is null, or the sentinel for what isn't known; then the old one."""
    return F.coalesce(F.nullif(new, F.lit(sentinel)) if sentinel else new, old, new)


def upsert(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """`stored` after the scans in `rows` (as `derived` gives them, one a url_id): the same columns, a row for each url_id of either.

    stored has url_id, first_scanned_at, scanned_at, status and columns of `rows`. A successful scan replaces the row, but a workplace or kind of employment that it
    doesn't know stays as it was; a failed one changes its status and time only. The first scan's time is written once, and no posting is
    dated after that day. Both sides meet once, by equal ids.
    """
    kept = [c for c in stored.columns if c not in ("url_id", "first_scanned_at", "scanned_at", "status")]
    new = rows.select("url_id", "success", "at", *[F.col(c).alias(f"_{c}") for c in kept])
    both = stored.join(new, "url_id", "full_outer")
    fine, seen = F.coalesce("success", F.lit(False)), F.col("at").isNotNull()
    first = F.coalesce("first_scanned_at", "at")
    sentinel = {"workplace": UNKNOWN, "employment": UNKNOWN}
    value = {c: F.when(fine, better(F.col(f"_{c}"), F.col(c), sentinel[c]) if c in sentinel else F.col(f"_{c}")).otherwise(F.col(c)) for c in kept}
    if "posted_at" in value:
        value["posted_at"] = F.least(value["posted_at"], F.when(value["posted_at"].isNotNull(), F.to_date(first)))
    value |= {"first_scanned_at": first, "scanned_at": F.coalesce("at", "scanned_at"), "status": F.when(seen, F.when(fine, "success").otherwise("failed")).otherwise(F.col("status"))}
    return both.select("url_id", *[value[c].cast(stored.schema[c].dataType).alias(c) for c in stored.columns if c != "url_id"]).select(*stored.columns)
