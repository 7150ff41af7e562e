"""Counts over time, with empty buckets filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times


def spine(df: DataFrame, start: Column, end: Column, unit: str) -> DataFrame:
    """One row, `bucket`, for each hour, day, week or month from start to end, both included."""
    step = F.expr(f"INTERVAL 1 {unit.upper()}")
    one = df.sparkSession.range(1)
    return one.select(F.explode(F.sequence(F.date_trunc(unit, start), F.date_trunc(unit, end), step)).alias("bucket"))


def activity(df: DataFrame, ts: str, unit: str, start: str, end: str, zone: str = "UTC", measure: Column | None = None) -> DataFrame:
    """(bucket, n) for every bucket between the local instants start and end; buckets without rows have 0."""
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    counts = df.withColumn("bucket", times.bucket(F.col(ts), unit, zone)).groupBy("bucket").agg((measure if measure is not None else F.count("*")).cast("long").alias("n"))
    return spine(df, lo, hi, unit).join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def window_counts(df: DataFrame, ts: str, as_of: str, days: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Rows in the trailing windows, all in one pass: a column for each entry of `days`, and `total`."""
    now = F.lit(as_of).cast("timestamp")
    within = [F.count_if((F.col(ts).cast("timestamp") > now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(d * 86400.0))) & (F.col(ts).cast("timestamp") <= now)).alias(name) for name, d in days.items()]
    return df.groupBy(*by or []).agg(*within, F.count("*").alias("total"))


def zero_filled(df: DataFrame, col: str, values: list[str]) -> DataFrame:
    """(value, n) for each value of an enumeration, in its order, with 0 for absent ones."""
    known = df.sparkSession.createDataFrame([(v,) for v in values], "value string")
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    return known.join(F.broadcast(counts.where(F.col("value").isin(values))), "value", "left").select("value", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def returning_users(df: DataFrame, user: str, ts: str, unit: str, start: str, end: str, zone: str = "UTC") -> DataFrame:
    """(bucket, n) of distinct users who were active in a bucket and joined before its local day began.

    A user joins with their first row.
    """
    joined = df.groupBy(user).agg(F.min(F.col(ts).cast("timestamp")).alias("joined"))
    active = df.select(user, F.col(ts).cast("timestamp").alias("ts")).withColumn("hour", times.bucket(F.col("ts"), "hour", zone)).select(user, "hour").distinct()
    day = times.day_start_utc(F.to_date("hour"), zone)
    back = active.join(joined, user).where(F.col("joined") < day).withColumn("bucket", F.date_trunc(unit, "hour"))
    counts = back.groupBy("bucket").agg(F.countDistinct(user).alias("n"))
    return spine(df, F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"), unit).join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
