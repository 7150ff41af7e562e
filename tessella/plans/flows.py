"""Queries of alerts, claims, presence and publication, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pay, urls
from ..operators import alerts, claims, hosts, publish
from ..sources.tables import postings, table
from .catalogue import POSTINGS, query

_ALERTS_AT = "1998-06-15 12:00:00"
_SEARCHES = f"""
{POSTINGS},
fresh AS (SELECT *, found_at + to_hours(CAST(id % 5 AS INTEGER)) AS scanned_at FROM postings WHERE found_at >= TIMESTAMP '{_ALERTS_AT}' - INTERVAL 48 hour AND found_at <= TIMESTAMP '{_ALERTS_AT}'),
saved AS (SELECT c_custkey AS search_id, c_nationkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN (['high', 'urgent', 'not spec'])[c_custkey // 3 % 3 + 1] END AS want_words, CASE WHEN c_custkey % 7 = 0 THEN 'LOW' END AS not_words,
    CASE WHEN c_custkey % 11 = 0 THEN '#0000' || substr(c_name, 14, 2) END AS want_company, CASE WHEN c_custkey % 4 = 1 THEN 'R' || c_custkey % 5 END AS want_area, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS want_sector,
    CASE WHEN c_custkey % 6 = 5 THEN 'remote' END AS want_workplace, CASE WHEN c_custkey % 3 = 1 THEN CAST(floor(c_acctbal) AS BIGINT) * 40 END AS want_salary, CASE WHEN c_custkey % 13 = 0 THEN 400000 END AS want_salary_most, CASE WHEN c_custkey % 17 = 0 THEN 2 END AS want_days,
    TIMESTAMP '1998-01-01' AS created_at, CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '{_ALERTS_AT}' - to_hours(CAST(c_custkey % 60 AS INTEGER)) END AS last_alerted_at FROM customer WHERE c_nationkey % 6 <> 0),
found AS (SELECT search_id, id, listed_at FROM saved JOIN fresh ON scanned_at >= coalesce(last_alerted_at, created_at) AND (want_words IS NULL OR len(list_filter(string_split(want_words, ' '), lambda w: NOT contains(lower(title), w))) = 0)
    AND (not_words IS NULL OR NOT contains(lower(title), lower(not_words))) AND (want_company IS NULL OR contains(lower(company), lower(want_company))) AND (want_area IS NULL OR list_contains(areas, want_area)) AND (want_sector IS NULL OR sector = want_sector)
    AND (want_workplace IS NULL OR workplace = want_workplace) AND (want_salary IS NULL OR coalesce(salary_max, salary_min) >= want_salary) AND (want_salary_most IS NULL OR coalesce(salary_min, salary_max) <= want_salary_most)
    AND (want_days IS NULL OR posted_at >= DATE '{_ALERTS_AT[:10]}' - want_days))"""


def saved_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, some = F.col("c_custkey"), F.when
    words = F.array(*map(F.lit, ("high", "urgent", "not spec")))
    at = F.lit(_ALERTS_AT).cast("timestamp")
    return table(spark, sf_dir, "customer").select(
        k.alias("search_id"), F.col("c_nationkey").alias("user_id"), some(k % 3 == 0, F.get(words, (F.floor(k / 3) % 3).cast("int"))).alias("want_words"), some(k % 7 == 0, "LOW").alias("not_words"),
        some(k % 11 == 0, F.concat(F.lit("#0000"), F.substring("c_name", 14, 2))).alias("want_company"), some(k % 4 == 1, F.concat(F.lit("R"), (k % 5).cast("string"))).alias("want_area"), some(k % 5 != 0, F.col("c_mktsegment")).alias("want_sector"),
        some(k % 6 == 5, "remote").alias("want_workplace"), some(k % 3 == 1, F.floor("c_acctbal") * 40).alias("want_salary"), some(k % 13 == 0, 400_000).alias("want_salary_most"), some(k % 17 == 0, 2).alias("want_days"),
        F.lit("1998-01-01").cast("timestamp").alias("created_at"), some(k % 2 == 0, at - F.make_dt_interval(F.lit(0), (k % 60).cast("int"))).alias("last_alerted_at"),
    )


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = postings(spark, sf_dir).where(F.col("found_at") <= F.lit(_ALERTS_AT).cast("timestamp"))
    return known.withColumn("first_scanned_at", F.col("found_at")).withColumn("scanned_at", F.col("found_at") + F.make_dt_interval(F.lit(0), (F.col("id") % 5).cast("int")))


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("user_id"), (F.col("n_nationkey") % 6 != 0).alias("alerts"))
    return alerts.sweep(saved_searches(spark, sf_dir), users, scanned(spark, sf_dir), _ALERTS_AT)


@query("alert_digests", f"""
WITH {_SEARCHES}
SELECT search_id, CAST(row_number() OVER w AS INTEGER) AS rank, id, greatest(0, count(*) OVER (PARTITION BY search_id) - 10) AS more FROM found WINDOW w AS (PARTITION BY search_id ORDER BY listed_at DESC, id) QUALIFY rank <= 10""")
def alert_digests(spark, sf_dir):
    return _sweep(spark, sf_dir)


@query("alert_marks", f"""
WITH {_SEARCHES}
SELECT c_custkey AS search_id, strftime(CASE WHEN c_custkey IN (SELECT search_id FROM found) THEN TIMESTAMP '{_ALERTS_AT}' WHEN c_custkey % 2 = 0 THEN TIMESTAMP '{_ALERTS_AT}' - to_hours(CAST(c_custkey % 60 AS INTEGER)) END, '%Y-%m-%d %H:%M:%S') AS last_alerted_at FROM customer""")
def alert_marks(spark, sf_dir):
    out = alerts.advance(saved_searches(spark, sf_dir), _sweep(spark, sf_dir), _ALERTS_AT)
    return out.select("search_id", F.date_format("last_alerted_at", "yyyy-MM-dd HH:mm:ss").alias("last_alerted_at"))


_CLAIMS_AT = "2001-08-02 00:00:00"
_QUEUE = f"""
queue AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 19 <> 0 THEN o_custkey % 40 END AS source, CASE o_orderstatus WHEN 'O' THEN 'success' ELSE 'pending' END AS status,
    CASE WHEN o_orderkey % 5 = 0 THEN TIMESTAMP '{_CLAIMS_AT}' - to_seconds(o_orderkey % 1300) END AS claimed_at, o_orderdate AS created_at FROM orders),
boards AS (SELECT s_suppkey AS source, 1 + CAST(floor(s_acctbal) AS BIGINT) % 400 AS cap, s_nationkey % 4 = 0 AS official FROM supplier WHERE s_suppkey < 45),
flying AS (SELECT source, count(*) AS n FROM queue WHERE status = 'pending' AND claimed_at > TIMESTAMP '{_CLAIMS_AT}' - INTERVAL 600 second GROUP BY 1)"""


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(F.col("o_custkey") % 19 != 0, F.col("o_custkey") % 40).alias("source"), F.when(F.col("o_orderstatus") == "O", "success").otherwise("pending").alias("status"),
        F.when(k % 5 == 0, F.lit(_CLAIMS_AT).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (k % 1300).cast("double"))).alias("claimed_at"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def _boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").where(k < 45).select(k.cast("long").alias("source"), (1 + F.floor("s_acctbal") % 400).alias("cap"), (F.col("s_nationkey") % 4 == 0).alias("official"))


@query("scan_claims", f"""
WITH {_QUEUE}
SELECT q.id, q.source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY created_at, id) AS r FROM queue WHERE status = 'pending' AND (claimed_at IS NULL OR claimed_at <= TIMESTAMP '{_CLAIMS_AT}' - INTERVAL 600 second)) q
JOIN boards b ON b.source = q.source LEFT JOIN flying f ON f.source = q.source WHERE r <= cap - coalesce(n, 0)""")
def scan_claims(spark, sf_dir):
    return claims.allocate(_queue(spark, sf_dir), _boards(spark, sf_dir), _CLAIMS_AT)


@query("sources_waiting", f"WITH {_QUEUE} SELECT source, cap, official FROM boards WHERE source IN (SELECT source FROM queue WHERE status = 'pending')")
def sources_waiting(spark, sf_dir):
    return claims.waiting(_queue(spark, sf_dir), _boards(spark, sf_dir))


# Fixed rules of the queries: suffixes that nobody can register, and boards by URL.
SUFFIXES = ("com", "org", "*.example.net", "!m.example.net", "!thther.example.net", "example.org", "net", "*.nowhere")
BOARDS = [
    {"priority": 1, "kind": "farm", "host": "spam-farm.example.org", "key": "path:1"},
    {"priority": 2, "kind": "blog", "host": "example.net", "key": "label", "path": "^/en/"},
    {"priority": 3, "kind": "shop", "host": "example.com", "key": "page"},
    {"priority": 4, "kind": "site", "host": "example.com", "key": "label"},
    {"priority": 5, "kind": "page", "host": "", "key": "path:2", "path": r"\.html$"},
]
_HOSTS = r"hosts AS (SELECT DISTINCT url, regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)"


@query("registrable_domains", f"""
WITH {_HOSTS},
rules AS (SELECT ltrim(rule, '*!.') AS suffix, CASE WHEN rule LIKE '!%' THEN -1 WHEN rule LIKE '*%' THEN 1 ELSE 0 END AS extra FROM (VALUES {", ".join(f"('{s}')" for s in SUFFIXES)}) AS t(rule)),
labels AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM hosts),
tails AS (SELECT host, l, i, array_to_string(l[i:], '.') AS suffix, len(l) - i + 1 AS size FROM labels, unnest(range(1, len(l) + 1)) AS t(i)),
met AS (SELECT host, l, extra, size + extra AS n FROM tails JOIN rules USING (suffix) WHERE extra <> 1 OR size < len(l)),
best AS (SELECT host, l, coalesce(max(n) FILTER (extra = -1), max(n)) AS n FROM met GROUP BY 1, 2)
SELECT url, CASE WHEN len(l) > n THEN array_to_string(l[len(l) - n:], '.') END AS domain FROM hosts LEFT JOIN best USING (host)""")
def registrable_domains(spark, sf_dir):
    rules = spark.createDataFrame([(s,) for s in SUFFIXES], "rule string")
    return hosts.registrable(table(spark, sf_dir, "pages"), rules)


@query("routed_urls", rf"""
WITH {_HOSTS},
r AS (SELECT url, CASE WHEN host = 'spam-farm.example.org' OR host LIKE '%.spam-farm.example.org' THEN nullif(string_split(ltrim(path, '/'), '/')[1], '') END AS farm,
    CASE WHEN host LIKE '%.example.net' AND path LIKE '/en/%' THEN regexp_extract(host, '([^.]+)\.example\.net$', 1) END AS blog, CASE WHEN host LIKE '%example.com' THEN nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') END AS shop,
    CASE WHEN host LIKE '%.example.com' THEN regexp_extract(host, '([^.]+)\.example\.com$', 1) END AS site, CASE WHEN path LIKE '%.html' THEN nullif(string_split(ltrim(path, '/'), '/')[2], '') END AS page FROM hosts)
SELECT url, CASE WHEN farm IS NOT NULL THEN 'farm' WHEN blog IS NOT NULL THEN 'blog' WHEN shop IS NOT NULL THEN 'shop' WHEN site IS NOT NULL THEN 'site' WHEN page IS NOT NULL THEN 'page' END AS kind, coalesce(farm, blog, shop, site, page) AS board FROM r""")
def routed_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("url").distinct().withColumn("to", hosts.route(F.col("url"), BOARDS)).select("url", "to.kind", "to.board")


_TODAY = "2024-03-01"
_DIGEST = lambda *cs: "substr(sha256(" + " || ',' || ".join(f"coalesce(length({c}) || ':' || {c}, '-')" for c in cs) + "), 1, 12)"
_MANIFEST = f"""
live AS (SELECT page_id, url, html, page_id // 40 AS shard, {_DIGEST("url", "html")} AS digest FROM pages WHERE page_id % 11 <> 0),
former AS (SELECT page_id, url, CASE WHEN page_id % 5 = 0 THEN html || ' edited' ELSE html END AS html, page_id // 40 AS shard, DATE '2024-01-01' + CAST(page_id % 50 AS INTEGER) AS date FROM pages WHERE page_id % 7 <> 0 AND page_id // 40 <> 2)"""


def _former(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    page = F.when(k % 5 == 0, F.concat("html", F.lit(" edited"))).otherwise(F.col("html")).alias("html")
    rows = table(spark, sf_dir, "pages").where((k % 7 != 0) & (F.floor(k / 40) != 2))
    return rows.select("page_id", "url", page, F.floor(k / 40).alias("shard"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 50).cast("int")).alias("date"))


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(F.col("page_id") % 11 != 0).withColumn("shard", F.floor(F.col("page_id") / 40))


@query("page_manifest", f"""
WITH {_MANIFEST}, was AS (SELECT page_id, {_DIGEST("url", "html")} AS digest, date FROM former)
SELECT coalesce(l.page_id, w.page_id) AS page_id, coalesce(l.digest, w.digest) AS digest, CASE WHEN l.page_id IS NULL OR l.digest = w.digest THEN w.date ELSE DATE '{_TODAY}' END AS date,
  CASE WHEN l.page_id IS NULL THEN 'gone' WHEN w.page_id IS NULL THEN 'new' WHEN l.digest = w.digest THEN 'same' ELSE 'changed' END AS status FROM live l FULL JOIN was w ON l.page_id = w.page_id""")
def page_manifest(spark, sf_dir):
    told = publish.digest(F.col("url"), F.col("html")).alias("digest")
    return publish.manifest(_live(spark, sf_dir).select("page_id", told), _former(spark, sf_dir).select("page_id", told, "date"), "page_id", _TODAY)


@query("shard_manifest", f"""
WITH {_MANIFEST}, a AS (SELECT shard, string_agg(digest, '' ORDER BY url, page_id) AS x FROM live GROUP BY 1), b AS (SELECT shard, string_agg(digest, '' ORDER BY url, page_id) AS x, max(date) AS date FROM (SELECT *, {_DIGEST("url", "html")} AS digest FROM former) GROUP BY 1),
n AS (SELECT shard, {_DIGEST("x")} AS digest FROM a), w AS (SELECT shard, {_DIGEST("x")} AS digest, date FROM b)
SELECT coalesce(n.shard, w.shard) AS shard, coalesce(n.digest, w.digest) AS digest, CASE WHEN n.shard IS NULL OR n.digest = w.digest THEN w.date ELSE DATE '{_TODAY}' END AS date,
  CASE WHEN n.shard IS NULL THEN 'gone' WHEN w.shard IS NULL THEN 'new' WHEN n.digest = w.digest THEN 'same' ELSE 'changed' END AS status FROM n FULL JOIN w ON n.shard = w.shard""")
def shard_manifest(spark, sf_dir):
    former = _former(spark, sf_dir)
    order, content = ["url", "page_id"], ["url", "html"]
    was = publish.shard_digests(former, "shard", order, content).join(former.groupBy("shard").agg(F.max("date").alias("date")), "shard")
    return publish.manifest(publish.shard_digests(_live(spark, sf_dir), "shard", order, content), was, "shard", _TODAY)


@query("invalidated_paths", f"""
WITH {_MANIFEST}, was AS (SELECT page_id, url, {_DIGEST("url", "html")} AS digest FROM former), p AS (SELECT regexp_extract(coalesce(l.url, w.url), '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path FROM live l FULL JOIN was w ON l.page_id = w.page_id WHERE l.digest IS DISTINCT FROM w.digest)
SELECT DISTINCT CASE WHEN path LIKE '/en/%' THEN '/en/*' WHEN path LIKE '/es/%' THEN '/es/*' ELSE path END AS path FROM p""")
def invalidated_paths(spark, sf_dir):
    told = page_manifest(spark, sf_dir).where("status <> 'same'").select("page_id")
    known = table(spark, sf_dir, "pages").join(told, "page_id", "left_semi").select(urls.path_of(F.col("url")).alias("path"))
    return publish.families(known, "path", ["/en/", "/es/"])


_OFFERS = """
offers AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice / 10) AS BIGINT) + 20000 AS low, o_orderkey % 6 AS form FROM orders)"""


@query("salaries_in_prose", f"""
WITH {_OFFERS}
SELECT id, CASE form WHEN 5 THEN NULL WHEN 3 THEN floor(low / 1000) * 1000 ELSE low END::DOUBLE AS salary_min, CASE form WHEN 5 THEN NULL WHEN 2 THEN low WHEN 3 THEN floor(low / 1000) * 1000 + 9000 ELSE low + 5000 END::DOUBLE AS salary_max,
  CASE form WHEN 5 THEN NULL WHEN 1 THEN 'EUR' WHEN 4 THEN 'GBP' ELSE 'USD' END AS salary_currency, CASE form WHEN 0 THEN 'year' WHEN 2 THEN 'year' END AS salary_period FROM offers""")
def salaries_in_prose(spark, sf_dir):
    low, k = F.floor(F.col("o_totalprice") / 10) + 20_000, F.col("o_orderkey")
    text = lambda x: F.format_number(x, 0)
    short = F.floor(low / 1000)
    forms = F.array(
        F.concat(F.lit("We ask for 3-5 years of work. Base $"), text(low), F.lit(" - $"), text(low + 5000), F.lit(" per year, 401 plan")), F.concat(F.lit("between EUR "), low.cast("string"), F.lit(" and "), (low + 5000).cast("string")),
        F.concat(text(low), F.lit(".00 USD Annually")), F.concat(F.lit("pay of $"), short.cast("string"), F.lit("-"), (short + 9).cast("string"), F.lit("k")),
        F.concat(F.lit("**Minimum salary**\n\n£"), text(low), F.lit("\n\n**Maximum salary**\n\n£"), text(low + 5000)), F.concat(F.lit("Room for "), low.cast("string"), F.lit(" to "), (low + 5000).cast("string"), F.lit(" people")),
    )
    said = table(spark, sf_dir, "orders").select(k.alias("id"), pay.salary_from_text(F.get(forms, (k % 6).cast("int"))).alias("s"))
    return said.select("id", "s.*")
