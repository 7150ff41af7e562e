"""Pointers, gaps and updates between tables, and small aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest(df: DataFrame, keys: list[str], order: str, id_col: str, to: str) -> DataFrame:
    """(keys, to): the id of each key's newest row, the largest id among equals. A map-side-combined aggregate."""
    return df.groupBy(*keys).agg(F.max(F.struct(order, id_col)).alias("_x")).select(*keys, F.col(f"_x.{id_col}").alias(to))


def point_to_newest(rows: DataFrame, results: dict[str, tuple[DataFrame, list[str]]], order: str = "created_at", id_col: str = "id") -> DataFrame:
    """`rows` whose null pointers are set to the newest row of the table that each is for; set ones stay, and none stays null.

    `results`: pointer column -> (table, keys by which it belongs to a row). Pointers are set in turn, so a later one may hang on an earlier.
    """
    for pointer, (df, keys) in results.items():
        found = newest(df, keys, order, id_col, "_newest").dropna(subset=keys)
        rows = rows.join(found, keys, "left").withColumn(pointer, F.coalesce(pointer, "_newest")).drop("_newest")
    return rows


def keyed_update(df: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """`df` with the columns of `changes` (one row a key) put in where their keys meet, nulls included; other rows stay as they are."""
    given = [c for c in changes.columns if c not in keys]
    new = changes.select(*keys, F.struct(*given).alias("_new"))
    both = df.join(new, keys, "left")
    return both.select(*(F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in df.columns))


def replace_all(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def csv_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def takeover(leaders: DataFrame, arrived: DataFrame, keys: list[str]) -> DataFrame:
    """(id, primary): new postings beside the groups' leaders. An official newcomer takes over from a leader that isn't.

    leaders: keys, id, official, created_at, one row a group; arrived: the same of new rows. Of several newcomers the official, oldest,
    smallest id counts. The leader of a group points to null, all others of it to the leader; groups without newcomers aren't returned.
    """
    rank = F.struct((~F.col("official")).alias("o"), "created_at", "id")
    best = arrived.groupBy(*keys).agg(F.min(rank).alias("_n"))
    old = leaders.select(*keys, F.struct("id", "official").alias("_l"))
    settled = best.join(old, keys, "left")
    wins = F.col("_l").isNull() | (~F.col("_l.official") & ~F.col("_n.o"))
    head = settled.select(*keys, F.when(wins, F.col("_n.id")).otherwise(F.col("_l.id")).alias("_head"))
    rows = arrived.select(*keys, "id").unionByName(leaders.select(*keys, "id"))
    return rows.join(head, keys).select("id", F.when(F.col("id") != F.col("_head"), F.col("_head")).alias("primary"))


def uncovered(companies: DataFrame, covered: DataFrame, key: Column) -> DataFrame:
    """Companies whose normalised key no covered one has; without a key a company is not covered."""
    have = covered.select(key.alias("_k")).where("_k IS NOT NULL").distinct()
    return companies.withColumn("_k", key).join(have, "_k", "left_anti").drop("_k")


def over_limit(events: DataFrame, by: str, ts: str, now: str, seconds: int, most: int) -> DataFrame:
    """(by, n): who did more than `most` in the last `seconds`."""
    end = F.lit(now).cast("timestamp")
    recent = events.where((F.col(ts) > end - F.make_dt_interval(secs=F.lit(seconds))) & (F.col(ts) <= end))
    return recent.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") > most)


def sample_rows(df: DataFrame, id_col: str, n: int, seed: str) -> DataFrame:
    """n rows picked by the hash of seed and id: the same ones however the rows are dealt."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string")).cast("binary")), id_col).limit(n)


def suggest_places(places: DataFrame, typed: str, k: int) -> DataFrame:
    """The k best places for what was typed: names that start with it, then those with a word that does; in each country, state, city, by population.

    An area (kind `area`, with its principal city's population) comes right after that city."""
    name, low = F.lower("name"), typed.lower()
    tier = F.when(name.startswith(low), 0).when(name.contains(f" {low}"), 1)
    kinds = F.when(F.col("kind") == "country", 1).when(F.col("kind") == "state", 2).otherwise(3)
    return places.withColumn("tier", tier).where("tier IS NOT NULL").orderBy("tier", kinds, F.desc("population"), F.col("kind") == "area", "name").limit(k)


def ordered_union(*arrays: Column) -> Column:
    """The different elements of arrays, in the order they are first met."""
    return F.array_distinct(F.concat(*arrays))


def merged_maps(first: Column, second: Column) -> Column:
    """Two maps as one; where both have a key the second's value counts."""
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k)), second)


def rounded_places(places: Column) -> Column:
    """The different 'lat,lon' of an array of places, to four decimals, sorted."""
    show = lambda x: F.format_string("%.4f", F.bround(x, 4))
    return F.array_sort(F.array_distinct(F.transform(places, lambda p: F.concat_ws(",", show(p["lat"]), show(p["lon"])))))


def in_order(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """(by, values): each group's values as an array in the given order."""
    got = F.array_sort(F.collect_list(F.struct(order, value)))
    return df.groupBy(by).agg(F.transform(got, lambda x: x[value]).alias("values"))

