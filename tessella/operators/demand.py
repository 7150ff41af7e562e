"""Search demand, alerts, keywords, surveys, domains and sitemaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Searches of a part and postings of a share; searches of a block (Parquet packs up to 504 values under one header) and postings of one; and the
#: postings that are broadcast for each of the bound.
PART, BLOCK, FEW, MOST = 65_536, 504, 256, 15


def weighted_position(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, clicks, impressions, position): the mean position weighted by impressions, half-even to two places, 0 without any."""
    sums = df.groupBy(*by).agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.sum(F.col("position") * F.col("impressions")).alias("w"))
    return sums.select(*by, "clicks", "impressions", F.when(F.col("impressions") > 0, F.bround(F.col("w") / F.col("impressions"), 2)).otherwise(0.0).alias("position"))


def top_parts(df: DataFrame, by: list[str], part: str, measure: str, k: int) -> DataFrame:
    """(by, rank, part, measure): the k largest parts of each group."""
    sums = df.groupBy(*by, part).agg(F.sum(measure).alias(measure))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(measure), part))
    return sums.withColumn("rank", rank).where(F.col("rank") <= k).select(*by, "rank", part, measure)


def alert_matches(searches: DataFrame, postings: DataFrame, bound: int = 10_000) -> DataFrame:
    """(search_id, id): postings found after each search's last alert that meet all of its parameters that aren't null.

    Searches that say the same stand in blocks, and postings of one sector do too; a posting is tested once a block of searches, all of which are then
    listed. A posting stands under its own sector and under none; one without a sector meets searches without one only. Only postings found after the
    earliest alert are looked at. Up to MOST * `bound` of them are broadcast; beyond that parts of searches meet shares of postings in a join on equal keys.

    The rows grow with the product of both tables, so their order counts where they are written: a block goes on from posting to posting, which
    gives long runs of one id beside searches that repeat, and a task has few different ones. Parquet holds such a row in about a bit.
    """
    wanted = ["want_words", "want_salary", "want_area", "want_sector", "last_alerted_at"]
    n, since = searches.agg(F.count("*"), F.min("last_alerted_at")).first()
    either, pay = F.array_distinct(F.array("sector", F.lit(None).cast("string"))), F.coalesce("salary_max", "salary_min").alias("_pay")
    fresh = postings.where(F.col("found_at") > F.lit(since)).select("id", F.lower("title").alias("_title"), "area", pay, "found_at", F.explode(either).alias("_under"))
    m, tasks = fresh.where("_under IS NULL").count(), int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = m <= MOST * bound
    parts, shares = n // PART + 1, max(-(-m // (PART if few else PART // 4)), -(-tasks // (n // BLOCK + 1)))  # a part meets a share in one task, unless broadcast
    of = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    key = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("")).alias("_sector")
    blocks = _blocks(searches.select(*wanted, key("want_sector"), of("search_id", parts).alias("_part"), "search_id"), [*wanted, "_sector", "_part"], BLOCK, "_searches")
    looking = _blocks(fresh.select(key("_under"), of("id", shares).alias("_share"), "id", "_title", "area", "_pay", "found_at"), ["_sector", "_share"], FEW, "_postings")
    on, dealt = ["_sector", "_share"], max(tasks, n // (2 * BLOCK) + 1)
    left = blocks.select("*", each(shares).alias("_share"))
    if few:
        left, right = left.repartition(dealt, *wanted, "_part", "_block", "_share"), F.broadcast(looking.drop("_block"))
    else:
        on.append("_part")
        left, right = left.repartition(dealt, *on).hint("merge"), looking.drop("_block").select("*", each(parts).alias("_part")).repartition(dealt, *on)
    fits = lambda param, ok: F.col(param).isNull() | ok
    meets = lambda p: (
        (p["found_at"] > F.col("last_alerted_at"))
        & fits("want_words", p["_title"].contains(F.lower("want_words")))
        & fits("want_salary", p["_pay"] >= F.col("want_salary"))
        & fits("want_area", p["area"] == F.col("want_area"))
    )
    met = left.join(right, on).select("_searches", F.filter("_postings", meets)["id"].alias("_ids"))
    return met.select("_searches", F.explode("_ids").alias("id")).select(F.explode("_searches.search_id").alias("search_id"), "id")


def _blocks(df: DataFrame, by: list[str], size: int, name: str) -> DataFrame:
    """(by, _block, name): the other columns of each group's rows, in order and so many a block. In order, so that a repeated task gives the same blocks."""
    rows = df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*[c for c in df.columns if c not in by]))).alias("_rows"))
    at = rows.select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.size("_rows") / size).cast("int") - 1)).alias("_block"))
    return at.select(*by, "_block", F.slice("_rows", F.col("_block") * size + 1, size).alias(name))


def keyword_summary(df: DataFrame, id_col: str, array: str, least: int, k: int) -> DataFrame:
    """(keyword, n): the k keywords that the most rows have, each counted once a row, lower case and trimmed."""
    words = F.array_distinct(F.transform(array, lambda w: F.lower(F.trim(w))))
    rows = df.select(F.col(id_col), F.explode(words).alias("keyword")).where("keyword <> ''")
    return rows.groupBy("keyword").agg(F.countDistinct(id_col).alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "keyword").limit(k)


def answer_counts(df: DataFrame, single: list[str], several: list[str]) -> DataFrame:
    """(question, answer, n) over columns with one answer and array columns with several, in one pass."""
    one = [F.array(F.struct(F.lit(c).alias("question"), F.col(c).cast("string").alias("answer"))) for c in single]
    more = [_answers(c) for c in several]
    rows = df.select(F.explode(F.concat(*one, *more)).alias("x")).select("x.question", "x.answer").where("answer IS NOT NULL")
    return rows.groupBy("question", "answer").agg(F.count("*").alias("n"))


def _answers(c: str) -> Column:
    return F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda a: F.struct(F.lit(c).alias("question"), a.alias("answer")))


def domains(evidence: DataFrame, shared: int = 3) -> DataFrame:
    """(company, domain, is_shared): each company's best-ranked domain; one that `shared` companies or more have is nobody's own.

    evidence: company, domain, rank (lower is better).
    """
    best = evidence.groupBy("company").agg(F.min(F.struct("rank", "domain")).alias("b")).select("company", F.col("b.domain").alias("domain"))
    owners = evidence.groupBy("domain").agg(F.countDistinct("company").alias("owners"))
    return best.join(owners, "domain").select("company", "domain", (F.col("owners") >= shared).alias("is_shared"))


def opportunities(rows: DataFrame, queries: int = 10, pages: int = 3) -> DataFrame:
    """(intent, clicks, impressions, position, queries, pages): what was searched for, with its top queries and pages.

    rows: intent, query, page, clicks, impressions, position. Each part is summed before it is ranked, and only the
    ranked few are collected.
    """
    total = weighted_position(rows, ["intent"])

    def best(part: str, k: int, more: list[str]) -> DataFrame:
        sums = rows.groupBy("intent", part).agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"))
        rank = F.row_number().over(Window.partitionBy("intent").orderBy(F.desc("impressions"), part))
        few = sums.withColumn("rank", rank).where(F.col("rank") <= k)
        listed = F.array_sort(F.collect_list(F.struct("rank", part, *more, "impressions")))
        return few.groupBy("intent").agg(listed.alias("of"))

    q = best("query", queries, ["clicks"]).withColumnRenamed("of", "queries")
    return total.join(q, "intent").join(best("page", pages, []).withColumnRenamed("of", "pages"), "intent")


def role_counts(jobs: DataFrame) -> DataFrame:
    """(kind, role, place, n) of open jobs by role, role and place, and place, in one pass; remote is a place as well."""
    remote = F.when(F.col("workplace") == "remote", F.array(F.lit("remote"))).otherwise(F.array().cast("array<string>"))
    df = jobs.where(~F.col("closed")).select("standard_titles", F.concat("areas", remote).alias("places"))
    none = F.lit(None).cast("string")
    key = lambda kind, role, place: F.struct(F.lit(kind).alias("kind"), role.alias("role"), place.alias("place"))
    roles = F.transform("standard_titles", lambda t: key("role", t, none))
    places = F.transform("places", lambda p: key("place", none, p))
    both = F.flatten(F.transform("standard_titles", lambda t: F.transform("places", lambda p: key("role_place", t, p))))
    return df.select(F.explode(F.concat(roles, places, both)).alias("x")).select("x.*").groupBy("kind", "role", "place").agg(F.count("*").alias("n"))


def sitemap_shards(pages: DataFrame, day: str, path: str, size: int = 45_000) -> DataFrame:
    """All columns and `shard`: newest days first, then by path, `size` pages a shard.

    Days are counted first; a page's place is the pages of later days plus its place in its own, so no task sorts all.
    """
    per_day = pages.groupBy(day).agg(F.count("*").alias("_n"))
    ahead = F.sum("_n").over(Window.orderBy(F.desc(day)).rowsBetween(Window.unboundedPreceding, -1))  # a row a day
    before = per_day.select(day, F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    place = F.row_number().over(Window.partitionBy(day).orderBy(path))
    return pages.join(before, day).withColumn("shard", F.floor((F.col("_ahead") + place - 1) / size).cast("int")).drop("_ahead")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
