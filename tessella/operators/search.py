"""Faceted search over postings, similar postings and suggestions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text


@dataclass
class Search:
    """The facets of a search; those left None don't narrow it."""

    words: str | None = None
    company: str | None = None
    sector: str | None = None
    workplace: str | None = None
    area: str | None = None
    salary_from: float | None = None
    salary_to: float | None = None
    posted_within: int | None = None
    titles: tuple[str, ...] = ()


def predicate(s: Search, as_of: str) -> Column:
    """A search as one condition over title, company, sector, workplace, areas, salary_min/max, posted_at, standard_titles."""
    keep = F.lit(True)
    if s.words:
        by_word = text.matches_query(F.col("title"), s.words)
        if s.titles:
            _, avoid = text.query_terms(s.words)
            tagged = F.arrays_overlap(F.col("standard_titles"), F.array(*map(F.lit, s.titles)))
            for w in avoid:
                tagged = tagged & ~F.lower("title").contains(w.lower())
            by_word = by_word | tagged
        keep = keep & by_word
    if s.company:
        keep = keep & F.lower("company").contains(s.company.lower())
    for col, want in (("sector", s.sector), ("workplace", s.workplace)):
        if want is not None:
            keep = keep & (F.col(col) == want)
    if s.area is not None:
        keep = keep & F.array_contains("areas", s.area)
    # A posting without any salary fails either bound; 0 is a bound like any other.
    if s.salary_from is not None:
        keep = keep & (F.coalesce("salary_max", "salary_min") >= s.salary_from)
    if s.salary_to is not None:
        keep = keep & (F.coalesce("salary_min", "salary_max") <= s.salary_to)
    if s.posted_within is not None:
        keep = keep & (F.col("posted_at") >= F.date_sub(F.lit(as_of).cast("date"), s.posted_within))
    return keep


def search(postings: DataFrame, s: Search, as_of: str) -> DataFrame:
    return postings.where(predicate(s, as_of))


def page(found: DataFrame, size: int, offset: int = 0, order: list[Column] | None = None) -> DataFrame:
    """One page, newest listing first, ids breaking ties."""
    keys = order or [F.desc("listed_at"), F.desc("found_at"), F.asc("id")]
    return found.orderBy(*keys).offset(offset).limit(size)


#: What a caller may sort by, and the column that it stands for.
SORTS = {"found": "found_at", "listed": "listed_at", "title": "title", "company": "company", "salary": "salary_max", "seen": "last_seen_at"}


def sorted_page(found: DataFrame, by: str, descending: bool, size: int, offset: int = 0) -> DataFrame:
    """One page in the order that a caller chose, the newest found first among equals. Rows without the value come last where it ascends, first where it descends."""
    if by not in SORTS:
        raise ValueError(f"sorted by one of {', '.join(SORTS)}")
    way = F.desc_nulls_first if descending else F.asc_nulls_last
    return page(found, size, offset, [way(SORTS[by]), F.desc("found_at"), F.asc("id")])


def capped_count(found: DataFrame, cap: int) -> DataFrame:
    """(total, is_capped): counting stops just beyond the cap."""
    return found.limit(cap + 1).agg(F.least(F.count("*"), F.lit(cap)).cast("long").alias("total"), (F.count("*") > cap).alias("is_capped"))


def around(postings: DataFrame, lat: float, lon: float, miles: float) -> DataFrame:
    """Postings with a place within `miles`, with their distance and band; `places` is an array of (lat, lon)."""
    here = (F.lit(lat), F.lit(lon))
    boxed = postings.where(F.exists("places", lambda p: geo.box(p["lat"], p["lon"], *here, miles)))
    near = boxed.withColumn("distance", geo.nearest_point(F.col("places"), *here))
    return near.where(F.col("distance") <= miles).withColumn("band", geo.band(F.col("distance")))


def similar(postings: DataFrame, to: DataFrame, k: int) -> DataFrame:
    """For each posting in `to`: the k newest others of its company, and the k newest of its title at other companies.

    Columns: id, kind (company or title), rank, other. Candidates are bounded before they meet: of a company its k + 1
    newest, of a title its 2k newest once each company is limited to k, as k of them at most are of the own company.
    """
    mine = to.select(F.col("id").alias("of"), F.col("company").alias("own"), F.col("title").alias("wanted"))
    newest = [F.desc("listed_at"), F.asc("id")]
    slim = postings.select("id", "company", "title", "listed_at")

    def first(df: DataFrame, keys: list[str], n: int) -> DataFrame:
        return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))).where(F.col("_r") <= n).drop("_r")

    def branch(kind: str, few: DataFrame, on: Column) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("of").orderBy(*newest))
        return few.join(mine, on).withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("of").alias("id"), F.lit(kind).alias("kind"), "rank", F.col("id").alias("other"))

    same = branch("company", first(slim, ["company"], k + 1), (F.col("company") == F.col("own")) & (F.col("id") != F.col("of")))
    titled = first(first(slim, ["title", "company"], k), ["title"], 2 * k)
    return same.union(branch("title", titled, (F.col("title") == F.col("wanted")) & (F.col("company") != F.col("own"))))


def suggest(counts: DataFrame, name: str, typed: str, k: int) -> DataFrame:
    """The k best completions: names that start with what was typed first, then those that contain it; by count."""
    low = F.lower(name)
    hit = counts.where(low.contains(typed.lower()))
    return hit.withColumn("tier", F.when(low.startswith(typed.lower()), 0).otherwise(1)).orderBy("tier", F.desc("n"), name).limit(k)


def term_counts(df: DataFrame, array: str, id_col: str) -> DataFrame:
    """(term, n): in how many rows each element of an array column occurs. Ids are unique, so that nothing but sums is shuffled."""
    return df.where(F.col(id_col).isNotNull()).select(F.explode(F.array_distinct(array)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def related(postings: DataFrame, k: int) -> DataFrame:
    """(id, rank, other): up to k newest of the same title, then of the same sector and area, at other companies.

    Candidates are bounded before they meet: only the k + m newest of each key can be among the first k once
    those of the own company, at most m a company, are left out, so each company is limited to k first.
    """
    newest = [F.desc("listed_at"), F.asc("id")]

    def bounded(keys: list[str]) -> DataFrame:
        of_company = F.row_number().over(Window.partitionBy(*keys, "company").orderBy(*newest))
        few = postings.withColumn("r", of_company).where(F.col("r") <= k)
        per_key = few.withColumn("of_key", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest)))
        return per_key.where(F.col("of_key") <= 2 * k + 1).select(*keys, F.col("id").alias("other"), F.col("company").alias("other_company"), F.col("listed_at").alias("other_listed"))

    def branch(keys: list[str], priority: int) -> DataFrame:
        pairs = postings.select("id", "company", *keys).join(bounded(keys), keys)
        return pairs.where("company <> other_company").select("id", "other", "other_listed", F.lit(priority).alias("priority"))

    both = branch(["title"], 0).union(branch(["sector", "area"], 1))
    best = both.groupBy("id", "other", "other_listed").agg(F.min("priority").alias("priority"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("priority", F.desc("other_listed"), "other"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "rank", "other")
