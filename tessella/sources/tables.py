"""The standard tables, and views of them in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times, urls

#: The instant of the queries over orders, and over events.
AS_OF, EVENTS_AS_OF = "2001-08-02 00:00:00", "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt over the tasks by a key: a small file may come as one piece, and what is made of each row may take long."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Hand rows to Python in batches that stay small with whole pages, unless the session has a setting of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as postings: who hires, where, for how much, since when, and whether it is over."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    df = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("o_orderkey")
    posted = F.col("o_orderdate").cast("timestamp")
    found = posted + F.make_dt_interval(F.lit(0), (k % 48).cast("int"))
    out = df.select(
        k.alias("id"),
        F.col("o_orderpriority").alias("title"),
        F.array("o_orderpriority").alias("standard_titles"),
        F.col("c_name").alias("company"),
        F.col("c_custkey").cast("string").alias("company_key"),
        F.concat(F.lit("site"), F.col("c_nationkey").cast("string")).alias("domain"),
        F.col("c_mktsegment").alias("sector"),
        F.col("n_name").alias("area"),
        F.array(F.col("n_name"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))).alias("areas"),
        F.element_at(F.array(*map(F.lit, ("remote", "hybrid", "onsite", "unknown"))), (k % 4 + 1).cast("int")).alias("workplace"),
        F.when(k % 7 != 0, F.floor("o_totalprice")).cast("long").alias("salary_min"),
        F.when(k % 5 != 0, F.floor("o_totalprice") + 5000).cast("long").alias("salary_max"),
        F.when(k % 9 == 0, "EUR").when(k % 2 == 0, "USD").alias("salary_currency"),
        F.when(k % 11 != 0, F.to_date("o_orderdate")).alias("posted_at"),
        found.alias("found_at"),
        F.when(k % 6 != 0, found + F.make_dt_interval((k % 20).cast("int"))).alias("last_seen_at"),
        (F.col("o_orderstatus") == "F").alias("closed"),
    )
    return out.withColumn("listed_at", times.listed_at(F.col("posted_at"), F.col("found_at")))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as registered URLs: id, url, normalized, url_hash, domain."""
    df = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", urls.normalize_url(F.col("url")).alias("normalized"))
    return df.withColumn("url_hash", urls.url_hash(F.col("normalized"))).withColumn("domain", urls.domain_of(F.col("normalized")))
