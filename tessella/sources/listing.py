"""Board listings, from payloads that were fetched before, and writes that may be repeated."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LISTING = "url string, posted string"


def from_json(field: str, url: str, posted: str | None = None) -> Callable[[str], Iterator[tuple]]:
    """Reader of a JSON payload whose list `field` (dots go deeper) has objects with a URL and maybe a date."""

    def read(body: str) -> Iterator[tuple]:
        x = json.loads(body)
        for part in filter(None, field.split(".")):
            x = x.get(part, []) if isinstance(x, dict) else []
        for row in x if isinstance(x, list) else []:
            if isinstance(row, dict) and row.get(url):
                yield str(row[url]), str(row[posted])[:10] if posted and row.get(posted) else None

    return read


def from_sitemap(body: str) -> Iterator[tuple]:
    """Reader of a sitemap: each location with its last change."""
    for m in re.finditer(r"(?is)<url>(.*?)</url>", body):
        loc, mod = (re.search(rf"(?is)<{t}>\s*(.*?)\s*</{t}>", m[1]) for t in ("loc", "lastmod"))
        if loc:
            yield loc[1], mod[1][:10] if mod else None


def from_links(pattern: str) -> Callable[[str], Iterator[tuple]]:
    """Reader of an HTML page: links whose target matches."""

    def read(body: str) -> Iterator[tuple]:
        for m in re.finditer(r"""(?is)<a\b[^>]*\bhref\s*=\s*["']([^"']+)["']""", body):
            if re.search(pattern, m[1]):
                yield m[1], None

    return read


def read_boards(payloads: DataFrame, readers: dict[str, Callable[[str], Iterator[tuple]]]) -> DataFrame:
    """(board, kind, pos, url, posted, broken) from fetched payloads (board, kind, body); kinds without a reader are skipped.

    A payload that its reader can't parse gives one row with `broken` true, so that it never counts as an empty board.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for board, kind, body in zip(b.board, b.kind, b.body, strict=True):
                if kind not in readers or body is None:
                    continue
                try:
                    rows += [(board, kind, i, u, p, False) for i, (u, p) in enumerate(readers[kind](body))]
                except (ValueError, TypeError, AttributeError):
                    rows.append((board, kind, 0, None, None, True))
            yield pd.DataFrame(rows, columns=["board", "kind", "pos", "url", "posted", "broken"])

    return payloads.select("board", "kind", "body").mapInPandas(run, "board string, kind string, pos int, url string, posted string, broken boolean")


def first_seen(listed: DataFrame, cap: int) -> DataFrame:
    """(board, url, posted, place): each board's URLs once, in the order they were first listed, up to the cap."""
    once = listed.where("url IS NOT NULL AND trim(url) <> ''").groupBy("board", "url").agg(F.min("pos").alias("pos"), F.min_by("posted", "pos").alias("posted"))
    place = F.row_number().over(Window.partitionBy("board").orderBy("pos", "url"))
    return once.withColumn("place", place).where(F.col("place") <= cap).select("board", "url", "posted", "place")


def completeness(listed: DataFrame, cap: int) -> DataFrame:
    """(board, urls, complete): a listing that reached the cap, or was broken, may lack some."""
    return listed.groupBy("board").agg(F.countDistinct("url").alias("urls"), F.bool_or("broken").alias("broken")).select("board", "urls", ((F.col("urls") < cap) & ~F.col("broken")).alias("complete"))


def insert_absent(new: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append the rows whose keys the table at `path` doesn't have yet; returns them. Running it again adds nothing.

    The rows are fixed before they are appended, so that returning them doesn't read the table they went into.
    """
    spark = new.sparkSession
    fresh = new.dropDuplicates(keys)
    if exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    fresh = fresh.persist()
    fresh.write.mode("append").parquet(path)
    return fresh


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a table at `path`, on whatever store Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """A table of comma- or tab-separated lines with a header; lines that don't fit the schema fail the read."""
    return spark.read.csv(path, schema=schema, header=True, sep=sep, mode="FAILFAST", enforceSchema=False)


def replace_days(new: DataFrame, path: str, day: str) -> None:
    """Overwrite the days that `new` has, and no others."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
