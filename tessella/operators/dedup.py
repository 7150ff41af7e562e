"""Duplicate postings, URL registration and row versions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, which must be total."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def possible_groups(df: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """(keys, n, first_id): keys that two or more rows share."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id")).where("n > 1")


def linked_groups(df: DataFrame, id_col: str, primary_col: str) -> DataFrame:
    """Rows that some duplicate points to, with how many do (a semi-join and its count in one)."""
    copies = df.where(F.col(primary_col).isNotNull()).groupBy(F.col(primary_col).alias(id_col)).agg(F.count("*").alias("copies"))
    return df.join(copies, id_col)


def new_only(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The rows of `found`, one for each key, whose key isn't known yet."""
    return found.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def exact_leaders(df: DataFrame, keys: list[str], order: list[str], id_col: str) -> DataFrame:
    """(id, primary): each row's leader where equality of the keys is the whole match; leaders have null.

    The leader is the smallest by `order`, which must be total. It comes from a map-side-combined aggregate that is joined
    back, so no task sorts all copies of one key. Rows with a null key neither match nor lead.
    """
    slim = df.select(id_col, *keys, *(c for c in order if c not in (*keys, id_col)))
    leads = slim.dropna(subset=keys).groupBy(*keys).agg(F.min(F.struct(*order, F.col(id_col).alias("_id"))).alias("_first"))
    both = slim.join(leads, keys, "left")
    return both.select(id_col, F.when(F.col("_first._id") != F.col(id_col), F.col("_first._id")).alias("primary"))


RANK = ("official", "closed", "linked", "created_at", "id")


def _rank() -> list[Column]:
    """Official first, open first, unlinked first, oldest, id."""
    return [F.desc("official"), *(F.asc(c) for c in RANK[1:])]


def _places_known() -> Column:
    return F.coalesce(F.col("company_key").isNotNull() & F.col("title_key").isNotNull() & (F.size("locations") > 0), F.lit(False))


def _elect(heads: DataFrame, leaders: DataFrame | None = None) -> DataFrame:
    """(id, top) of each head: the leader that it joins, null if it leads. `leaders` lead already, and go first."""
    keys = ["company_key", "title_key"]

    def elect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, leads = None, {}
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                if (r.company_key, r.title_key) != group:
                    group, leads = (r.company_key, r.title_key), {}
                other = None if r.leads else next((i for p in sorted(r.places) for i, d in leads.get(p, []) if d != r.domain), None)
                if not r.leads:
                    out.append((r.id, other))
                if other is None:
                    for p in r.places:
                        # The first leader of a place, and the first of another domain, are all that any row can join.
                        at = leads.setdefault(p, [])
                        if len(at) < 2 and all(d != r.domain for _, d in at):
                            at.append((r.id, r.domain))
            yield pd.DataFrame(out, columns=["id", "top"]).astype({"id": "int64", "top": "Int64"})

    columns = [*keys, "id", "domain", "places", *RANK[:-1]]
    rows = heads.select(*columns, F.lit(False).alias("leads"))
    if leaders is not None:
        rows = rows.union(leaders.select(*columns, F.lit(True).alias("leads")))
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, F.desc("leads"), *_rank())
    return dealt.select("id", *keys, "domain", "places", "leads").mapInPandas(elect, "id long, top long")


def place_leaders(df: DataFrame, leaders: DataFrame | None = None) -> DataFrame:
    """(id, primary) by greedy election among the rows of one (company_key, title_key).

    Input: id, company_key, title_key, official, closed, linked (had a primary), created_at, domain, locations (sorted
    array), places (array of rounded 'lat,lon'). In order - official first, open first, unlinked first, oldest,
    id - each row joins the leader with its very locations, else one of another domain that shares a place, else
    it leads. Rows without locations stand alone. The election is sequential by nature, but only within a group, and
    rows with equal locations are settled beforehand, so a group holds one row for each different list of locations.
    """
    settled = df.where(_places_known())
    same = Window.partitionBy("company_key", "title_key", "locations").orderBy(*_rank())
    settled = settled.withColumn("leader", F.first("id").over(same)).withColumn("pos", F.row_number().over(same))
    # A row may differ from its namesakes in domain and places only; the first of them decides for its locations.
    won = _elect(settled.where("pos = 1"), leaders)
    joined = settled.join(won.withColumnRenamed("id", "leader"), "leader")
    primary = F.when(F.col("top").isNotNull(), F.col("top")).when(F.col("pos") > 1, F.col("leader"))
    return joined.select("id", primary.alias("primary")).union(df.where(~_places_known()).select("id", F.lit(None).cast("long")))


def place_arrivals(arrivals: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, primary) of postings that come in after others were settled, which keep their leaders.

    Both as in `place_leaders`; `stored` has its `primary` too, and closed ones take nobody. An arrival joins the group of the stored row
    with its very locations; the others are elected among themselves, with the stored leaders going first. Only groups that have arrivals are
    touched. The result is that of a whole election as long as no arrival outranks a stored row.
    """
    keys = ["company_key", "title_key"]
    known = arrivals.where(_places_known())
    open_ = stored.where(_places_known() & ~F.col("closed")).join(known.select(*keys).distinct(), keys, "left_semi")
    order = F.struct((~F.col("official")).alias("o"), "linked", "created_at", "id", F.coalesce("primary", "id").alias("to"))
    groups = open_.groupBy(*keys, "locations").agg(F.min(order)["to"].alias("to"))
    met = known.join(groups, [*keys, "locations"], "left")
    rest = met.where("to IS NULL").drop("to")
    own = place_leaders(rest, open_.where("primary IS NULL"))
    alone = arrivals.where(~_places_known()).select("id", F.lit(None).cast("long").alias("primary"))
    return met.where("to IS NOT NULL").select("id", F.col("to").alias("primary")).union(own).union(alone)


def manifest_diff(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """(key, status) of what is new, removed or changed between two manifests."""
    both = old.select(key, F.col(version).alias("was")).join(new.select(key, F.col(version).alias("now")), key, "full_outer")
    status = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return both.withColumn("status", status).where("status IS NOT NULL").select(key, "status")


def near_equal_sets(df: DataFrame, group: str, item: str, share: float) -> DataFrame:
    """(a, b, shared): pairs of groups that share at least `share` of the larger one's items.

    Only groups whose sizes allow it are paired, and each group looks for partners by its rarest items only: two
    groups with n items, of which s may differ, must agree in one of any s + 1.
    """
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i")).distinct()
    often = rows.groupBy("i").agg(F.count("*").alias("often"))
    sized = rows.join(rows.groupBy("g").agg(F.count("*").alias("size")), "g").join(often, "i")
    rank = F.row_number().over(Window.partitionBy("g").orderBy("often", "i"))
    prefix = sized.withColumn("r", rank).where(F.col("r") <= F.col("size") - F.ceil(F.col("size") * share) + 1).select("g", "i", "size")
    a, b = prefix.alias("a"), prefix.alias("b")
    fits = (F.least("a.size", "b.size") >= F.greatest("a.size", "b.size") * share) & (F.col("a.g") < F.col("b.g"))
    pairs = a.join(b, (F.col("a.i") == F.col("b.i")) & fits).select(F.col("a.g").alias("a"), F.col("b.g").alias("b"), F.greatest("a.size", "b.size").alias("larger")).distinct()
    x, y = rows.select(F.col("g").alias("a"), "i"), rows.select(F.col("g").alias("b"), "i")
    shared = pairs.join(x, "a").join(y, ["b", "i"]).groupBy("a", "b", "larger").agg(F.count("*").alias("shared"))
    return shared.where(F.col("shared") >= F.col("larger") * share).select("a", "b", "shared")
