"""Claims on pending scans: each source hands out its oldest URLs up to the scans that it may have at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.listing import exists

# Fixed value: seconds after which a claim lapses.
TTL = 600


def _cutoff(now: str, ttl: float) -> Column:
    return F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(ttl)))


def _pending() -> Column:
    return F.col("status") == "pending"


def _free(now: str, ttl: float) -> Column:
    return _pending() & (F.col("claimed_at").isNull() | (F.col("claimed_at") <= _cutoff(now, ttl)))


def allocate(urls: DataFrame, sources: DataFrame, now: str, ttl: float = TTL) -> DataFrame:
    """id, source of the URLs to scan next.

    urls: id, source, status, claimed_at, created_at. sources: source, cap. A source has cap less what is in flight (pending,
    with a claim younger than ttl) to give, to its oldest pending URLs that nobody holds. Sources that aren't listed, or have a null
    source, give none. No source's backlog is sorted whole: ranks beyond the largest cap are cut before the shuffle.
    """
    most = sources.agg(F.max("cap").alias("most")).first()["most"] or 0
    flying = urls.where(_pending() & (F.col("claimed_at") > _cutoff(now, ttl))).groupBy("source").agg(F.count("*").alias("flying"))
    room = sources.join(flying, "source", "left").select("source", (F.col("cap") - F.coalesce("flying", F.lit(0))).alias("room")).where("room > 0")
    oldest = Window.partitionBy("source").orderBy("created_at", "id")
    first = urls.where(_free(now, ttl)).select("id", "source", "created_at").withColumn("rank", F.row_number().over(oldest)).where(F.col("rank") <= most)
    return first.join(room, "source").where(F.col("rank") <= F.col("room")).select("id", "source")


def claimed(urls: DataFrame, given: DataFrame, now: str) -> DataFrame:
    """The URLs with the claims that were given."""
    mine = given.select("id", F.lit(True).alias("_given"))
    return urls.join(mine, "id", "left").withColumn("claimed_at", F.when(F.col("_given"), F.lit(now).cast("timestamp")).otherwise(F.col("claimed_at"))).select(*urls.columns)


def claim_once(urls: DataFrame, sources: DataFrame, path: str, batch: int, now: str, ttl: float = TTL) -> DataFrame:
    """The claims of a batch, kept below `path`: a batch that is delivered again gets those of its first delivery."""
    at = f"{path}/batch={batch}"
    if not exists(urls.sparkSession, f"{at}/_SUCCESS"):
        allocate(urls, sources, now, ttl).write.mode("overwrite").parquet(at)
    return urls.sparkSession.read.schema(urls.select("id", "source").schema).parquet(at)


def waiting(urls: DataFrame, sources: DataFrame) -> DataFrame:
    """source, cap, official of the sources that have anything pending, official ones first. sources: source, cap, official."""
    some = sources.join(urls.where(_pending()).select("source").distinct(), "source", "left_semi")
    return some.select("source", "cap", "official").orderBy(F.desc("official"), "source")
