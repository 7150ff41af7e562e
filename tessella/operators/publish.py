"""Publication by content: digests against the former manifest, dates that move with the content only, and writes of what changed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: hexadecimal digits of a digest.
DIGITS = 12


def digest(*columns: Column) -> Column:
    """A digest of values in order; null and empty differ, and so do values that are cut in other places."""
    parts = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.substring(F.sha2(F.concat_ws(",", *parts).cast("binary"), 256), 1, DIGITS)


def manifest(now: DataFrame, before: DataFrame, key: str, today: str) -> DataFrame:
    """key, digest, date, status (new, changed, same, gone) of everything that is or was published.

    now: key, digest. before: key, digest, date. The date moves to today where the digest did, else it stays. What is gone keeps
    its last digest and date, so that its page can be taken down or its shard emptied. Keys are unique on either side.
    """
    was = before.select(key, F.col("digest").alias("_was"), F.col("date").alias("_date"))
    both = now.select(key, "digest").join(was, key, "full_outer")
    status = F.when(F.col("digest").isNull(), "gone").when(F.col("_was").isNull(), "new").when(F.col("digest") == F.col("_was"), "same").otherwise("changed")
    day = F.when(status.isin("same", "gone"), F.col("_date")).otherwise(F.lit(today).cast("date"))
    return both.select(key, F.coalesce("digest", "_was").alias("digest"), day.alias("date"), status.alias("status"))


def shard_digests(pages: DataFrame, shard: str, order: list[str], content: list[str]) -> DataFrame:
    """(shard, digest, pages) of shards of bounded size: a digest of their pages' digests in order."""
    item = F.struct(*order, digest(*map(F.col, content)).alias("_d"))
    lists = pages.groupBy(shard).agg(F.sort_array(F.collect_list(item)).alias("_x"))
    return lists.select(shard, digest(F.array_join(F.transform("_x", lambda x: x["_d"]), "")).alias("digest"), F.size("_x").cast("long").alias("pages"))


def changed(content: DataFrame, told: DataFrame, key: str) -> DataFrame:
    """The rows of `content` whose key is new or changed."""
    return content.join(told.where(F.col("status").isin("new", "changed")).select(key), key, "left_semi")


def write_changed(content: DataFrame, told: DataFrame, path: str, key: str) -> None:
    """Overwrite the partitions (by key) that are new or changed, empty those that are gone, and touch no other.

    A run that is repeated writes the same. Emptied partitions hold one row of nulls, so that readers of a listed shard find it.
    """
    rest = [c for c in content.columns if c != key]
    empty = told.where("status = 'gone'").select(*[F.lit(None).cast(content.schema[c].dataType).alias(c) for c in rest], F.col(key).cast(content.schema[key].dataType))
    out = changed(content, told, key).select(*rest, key).union(empty)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def families(paths: DataFrame, path: str, prefixes: list[str]) -> DataFrame:
    """(path) of what to invalidate: one wildcard for each family of paths that has any, and the other paths as they are."""
    hit = reduce(lambda acc, p: acc.when(F.col(path).startswith(p), f"{p}*"), prefixes[1:], F.when(F.col(path).startswith(prefixes[0]), f"{prefixes[0]}*")) if prefixes else F.lit(None)
    return paths.select(F.coalesce(hit, F.col(path)).alias(path)).distinct()
