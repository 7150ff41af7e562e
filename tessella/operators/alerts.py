"""Alerts for saved searches: an index over the searches that new postings probe, digests, and marks that move with what was sent.

A search is filed under one key only, the one that fewest of the new postings carry: an area, a sector, a way of working, three letters of its
words or company, or a step of its salary. A posting carries all its keys, so every match meets at the search's key, and the join
is on equal keys; what it gives is tested against the whole search. Only a search without any such parameter meets all postings.

A sweep needs each search's latest postings and their number only. Searches that say the same but for times and salaries are one sign, and
postings are met once a sign; times and salaries are then tested by columns, block against block, so that no pair of search and posting is a row.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Postings of a digest, and hours that a posting is new.
DIGEST, NEW_HOURS = 10, 48
#: Ratio of two steps of salaries, and letters that stand for a text that is searched for.
STEP, LETTERS = 1.25, 3
#: Parts that postings are dealt to where they meet searches without any key.
PARTS = 64
#: Different searches, and postings, of a block.
WANTS, POSTINGS = 20_000, 100_000

#: Columns that a search may leave null; `want_words` are words of a title, `not_words` words that it must not have.
PARAMETERS = ("want_words", "not_words", "want_company", "want_area", "want_sector", "want_workplace", "want_salary", "want_salary_most", "want_days")
#: Those that a sign has; the others are bounds on numbers.
SIGNS = PARAMETERS[:6]
BOUNDS, FLOATS = ("since", "want_salary", "want_salary_most", "from_day"), ("high", "low", "want_salary", "want_salary_most")


def _grams(text: Column) -> Column:
    """All runs of LETTERS letters of a text, lower case."""
    low = F.lower(text)
    starts = F.when(F.length(low) >= LETTERS, F.sequence(F.lit(1), F.length(low) - LETTERS + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(low, i, LETTERS)))


def _tagged(tag: str, values: Column) -> Column:
    return F.transform(F.filter(values, lambda v: v.isNotNull()), lambda v: F.concat(F.lit(f"{tag}:"), v))


def _step(salary: Column) -> Column:
    return F.floor(F.log(F.greatest(salary, F.lit(1)).cast("double")) / F.log(F.lit(STEP))).cast("int")


def _words(words: Column) -> Column:
    return F.filter(F.split(F.coalesce(F.trim(words), F.lit("")), r"\s+"), lambda w: w != "")


def search_keys() -> Column:
    """The keys that a search could be filed under."""
    some = lambda tag, c: _tagged(tag, F.array(F.col(c)))
    words = F.array_distinct(F.flatten(F.transform(_words(F.col("want_words")), _grams)))
    return F.concat(some("area", "want_area"), some("sector", "want_sector"), some("work", "want_workplace"), _tagged("word", words), _tagged("name", _grams(F.coalesce("want_company", F.lit("")))), _tagged("pay", F.array(F.when(F.col("want_salary") > 0, _step(F.col("want_salary")).cast("string")))))


def posting_keys() -> Column:
    """All keys that a posting carries: its own and those of every lower salary."""
    pay = F.coalesce("salary_max", "salary_min")
    steps = F.when(pay > 0, F.transform(F.sequence(F.lit(0), _step(pay)), lambda i: i.cast("string"))).otherwise(F.array().cast("array<string>"))
    return F.concat(
        _tagged("area", F.array_distinct(F.coalesce("areas", F.array().cast("array<string>")))), _tagged("sector", F.array("sector")), _tagged("work", F.array("workplace")),
        _tagged("word", _grams(F.coalesce("title", F.lit("")))), _tagged("name", _grams(F.coalesce("company", F.lit("")))), _tagged("pay", steps),
    )


def meets(now: Column) -> Column:
    """Whether a posting meets all parameters of a search, side by side in one row. Salaries that are unknown meet no salary."""
    low = F.lower("title")
    has = lambda words: F.forall(_words(F.col(words)), lambda w: low.contains(F.lower(w)))
    lacks = F.forall(_words(F.col("not_words")), lambda w: ~low.contains(F.lower(w)))
    tests = {
        "want_words": has("want_words"), "not_words": lacks, "want_company": F.lower("company").contains(F.lower("want_company")), "want_area": F.array_contains("areas", F.col("want_area")),
        "want_sector": F.col("sector") == F.col("want_sector"), "want_workplace": F.col("workplace") == F.col("want_workplace"),
        "want_salary": F.coalesce("salary_max", "salary_min") >= F.col("want_salary"), "want_salary_most": F.coalesce("salary_min", "salary_max") <= F.col("want_salary_most"),
        "want_days": F.col("posted_at") >= F.date_sub(now.cast("date"), F.col("want_days")),
    }
    return reduce(lambda a, b: a & b, [F.col(c).isNull() | F.coalesce(t, F.lit(False)) for c, t in tests.items()])


def matches(searches: DataFrame, postings: DataFrame, now: str, hours: float = NEW_HOURS) -> DataFrame:
    """search_id, id, listed_at: postings that are new and were scanned since a search last told of any, and that it matches.

    searches: search_id, created_at, last_alerted_at, and the PARAMETERS. postings: id, title, company, areas, sector, workplace,
    salary_min, salary_max, posted_at, listed_at, scanned_at, first_scanned_at.
    """
    return _met(searches, postings, now, hours).select("search_id", "id", "listed_at")


def _met(searches: DataFrame, postings: DataFrame, now: str, hours: float) -> DataFrame:
    """The matches, with all columns of both sides."""
    at = F.lit(now).cast("timestamp")
    new = postings.where(F.col("first_scanned_at") >= at - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600.0)))
    since = searches.withColumn("since", F.coalesce("last_alerted_at", "created_at")).withColumn("keys", F.array_distinct(search_keys()))
    wanted = since.select("search_id", F.explode("keys").alias("key"))
    asked = wanted.select("key").distinct()
    carried = new.select("id", F.explode(F.array_distinct(posting_keys())).alias("key")).join(asked, "key", "left_semi")
    often = carried.groupBy("key").agg(F.count("*").alias("n"))
    rarest = wanted.join(often, "key", "left").groupBy("search_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("best"))
    filed = since.drop("keys").join(rarest, "search_id", "left")
    # Searches without a key have only a longest age, words to leave out or a highest salary: every posting is a candidate, and
    # meets them in one of some parts, to each of which such a search is copied.
    part = lambda x: F.concat(F.lit("any:"), x.cast("string"))
    parts = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), part)
    under = F.when(F.col("best").isNull(), parts).when(F.col("best.n") > 0, F.array(F.col("best.key"))).otherwise(F.array().cast("array<string>"))
    keyed = filed.select("search_id", "since", *PARAMETERS, F.explode(under).alias("key"))
    probes = new.withColumn("key", F.explode(F.array_append(F.array_distinct(posting_keys()), part(F.pmod(F.xxhash64("id"), F.lit(PARTS))))))
    met = probes.join(keyed, "key")
    return met.where((F.col("scanned_at") >= F.col("since")) & meets(at))


def sweep(searches: DataFrame, users: DataFrame, postings: DataFrame, now: str, k: int = DIGEST, hours: float = NEW_HOURS) -> DataFrame:
    """search_id, rank, id, more: the digests, each search's latest postings and how many there are beyond those.

    Searches of users who switched alerts off aren't looked at, and keep their marks. users: user_id, alerts.
    """
    on = searches.join(users.where("alerts").select("user_id"), "user_id", "left_semi")
    number = lambda c: F.col(c).cast("double").alias(c)
    told = on.select(
        "search_id", F.to_json(F.struct(*SIGNS)).alias("sign"), *SIGNS, F.unix_micros(F.coalesce("last_alerted_at", "created_at")).alias("since"), number("want_salary"), number("want_salary_most"),
        F.unix_date(F.date_sub(F.lit(now).cast("date"), F.col("want_days"))).alias("from_day"),
    ).where("since IS NOT NULL").withColumn("want", F.to_json(F.struct("sign", *BOUNDS)))
    none, ever = F.lit(None), F.lit("0001-01-01").cast("timestamp")
    types = dict(on.dtypes)
    signs = told.select(F.col("sign").alias("search_id"), *SIGNS).distinct().select("*", *[none.cast(types[c]).alias(c) for c in PARAMETERS[6:]], ever.alias("created_at"), none.cast("timestamp").alias("last_alerted_at"))
    met = _met(signs, postings, now, hours).select(
        F.col("search_id").alias("sign"), "id", F.coalesce(-F.unix_micros("listed_at"), F.lit(2**63 - 1)).alias("at"), F.unix_micros("scanned_at").alias("scanned"),
        F.coalesce("salary_max", "salary_min").cast("double").alias("high"), F.coalesce("salary_min", "salary_max").cast("double").alias("low"), F.unix_date("posted_at").alias("day"),
    )
    wants = told.select("want", "sign", *BOUNDS).distinct()
    # Blocks of both sides, each of which meets each of its sign.
    of = lambda x, n: F.pmod(F.xxhash64(x), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    parts = wants.groupBy("sign").agg(F.ceil(F.count("*") / WANTS).cast("int").alias("parts"))
    blocks = met.groupBy("sign").agg(F.ceil(F.count("*") / POSTINGS).cast("int").alias("blocks"))
    sizes = parts.join(blocks, "sign")
    left = wants.join(sizes, "sign").withColumn("part", of("want", F.col("parts"))).select("want", *BOUNDS, "sign", "part", each(F.col("blocks")).alias("block"))
    right = met.join(sizes, "sign").withColumn("block", of("id", F.col("blocks"))).select(*met.columns, "block", each(F.col("parts")).alias("part"))
    key, kind = ["sign", "part", "block"], dict(postings.dtypes)["id"]
    some = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_latest(k), f"want string, n long, top array<struct<at: long, id: {kind}>>")
    best = some.groupBy("want").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
    out = told.select("search_id", "want").join(best, "want").select("search_id", F.posexplode("top").alias("i", "x"), "n")
    return out.select("search_id", (F.col("i") + 1).alias("rank"), "x.id", F.greatest(F.lit(0), F.col("n") - k).alias("more"))


def _latest(k: int):
    """A function that gives, for each of a block's searches that match any, the number and the k latest of a block's postings."""

    def run(wants: pa.Table, postings: pa.Table) -> pa.Table:
        postings = postings.sort_by([("at", "ascending"), ("id", "ascending")]).combine_chunks()
        # Unknown is beyond every bound that is given; a bound that isn't given is met by all.
        col = lambda t, c, null: t.column(c).cast(pa.float64() if c in FLOATS else pa.int64()).fill_null(null).to_numpy()
        scanned, day = col(postings, "scanned", -(2**63)), col(postings, "day", -(2**62))
        high, low = col(postings, "high", -np.inf), col(postings, "low", np.inf)
        given = {c: wants.column(c).is_valid().to_pylist() for c in BOUNDS}
        bound = {c: col(wants, c, 0) for c in BOUNDS}
        at, n, sizes, found = [], [], [0], []
        for i in range(wants.num_rows):
            ok = scanned >= bound["since"][i]
            for c, x, fits in (("want_salary", high, np.greater_equal), ("want_salary_most", low, np.less_equal), ("from_day", day, np.greater_equal)):
                if given[c][i]:
                    ok &= fits(x, bound[c][i])
            if many := int(np.count_nonzero(ok)):
                at.append(i)
                n.append(many)
                found.append(_first(ok, k))
                sizes.append(sizes[-1] + len(found[-1]))
        hit = postings.select(["at", "id"]).take(pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
        pairs = pa.StructArray.from_arrays([_whole(hit.column("at")), _whole(hit.column("id"))], names=["at", "id"])
        top = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pairs)
        return pa.table({"want": wants.column("want").take(pa.array(at, pa.int64())), "n": pa.array(n, pa.int64()), "top": top})

    return run


def _whole(x: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(x.chunks) if x.num_chunks else pa.array([], x.type)


def _first(ok: np.ndarray, k: int) -> np.ndarray:
    """Where the first k that are true stand."""
    step = 64 * k
    near = np.flatnonzero(ok[:step])
    return near[:k] if len(near) >= k or len(ok) <= step else np.flatnonzero(ok)[:k]


def advance(searches: DataFrame, digests: DataFrame, now: str) -> DataFrame:
    """The searches after the sweep: marks move to now where a digest was sent, so that what comes in between two sweeps is never missed."""
    sent = digests.where("rank = 1").select("search_id", F.lit(now).cast("timestamp").alias("_at"))
    return searches.join(sent, "search_id", "left").withColumn("last_alerted_at", F.coalesce("_at", "last_alerted_at")).select(*searches.columns)
