"""Streams without state of their own: registering URLs, activity by time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import urls
from ..sources.listing import insert_absent


def register_urls(stream: DataFrame, path: str, checkpoint: str, url: str = "url") -> StreamingQuery:
    """Register each new URL of a stream once: a batch that is delivered again adds nothing."""
    normal = stream.withColumn("normalized", urls.normalize_url(F.col(url)))
    keyed = normal.withColumn("url_hash", urls.url_hash(F.col("normalized"))).select("url_hash", "normalized")
    return keyed.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: insert_absent(df, path, ["url_hash"]).unpersist()).start()


def activity(stream: DataFrame, ts: str, kind: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts by window and kind; rows later than the watermark are left out."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")
