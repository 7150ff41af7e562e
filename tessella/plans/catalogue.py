"""Every query of the library outside the training-data subpackage, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, names, pay, text, times
from ..operators import dedup, demand, maintenance, places, search, stats, timeseries
from ..sources.tables import AS_OF, EVENTS_AS_OF, dealt, postings, registry, small_batches, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Orders as postings, as `tables.postings` gives them.
POSTINGS = """
postings AS (
  SELECT *, CASE WHEN posted_at < CAST(found_at AS DATE) THEN CAST(posted_at AS TIMESTAMP) ELSE found_at END AS listed_at FROM (
    SELECT o_orderkey AS id, o_orderpriority AS title, c_name AS company, CAST(c_custkey AS VARCHAR) AS company_key, 'site' || c_nationkey AS domain,
      c_mktsegment AS sector, n_name AS area, [n_name, 'R' || n_regionkey] AS areas, (['remote','hybrid','onsite','unknown'])[o_orderkey % 4 + 1] AS workplace,
      CASE WHEN o_orderkey % 7 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS salary_min,
      CASE WHEN o_orderkey % 5 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) + 5000 END AS salary_max,
      CASE WHEN o_orderkey % 9 = 0 THEN 'EUR' WHEN o_orderkey % 2 = 0 THEN 'USD' END AS salary_currency,
      CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END AS posted_at,
      o_orderdate + to_hours(CAST(o_orderkey % 48 AS INTEGER)) AS found_at,
      CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate + to_hours(CAST(o_orderkey % 48 AS INTEGER)) + to_days(CAST(o_orderkey % 20 AS INTEGER)) END AS last_seen_at,
      o_orderstatus = 'F' AS closed
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey))"""

NORMAL = """
parts AS (
  SELECT page_id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\\?([^#]*))?', ['s','h','p','_q','q']) AS x FROM pages),
normal AS (
  SELECT page_id AS id, url, lower(x.h) AS domain,
    lower(x.s) || '://' || lower(x.h) || CASE WHEN rtrim(x.p, '/') = '' THEN '/' ELSE rtrim(x.p, '/') END
    || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(list_sort(kept), '&') END AS normalized
  FROM (SELECT *, [CASE WHEN contains(p, '=') THEN p ELSE p || '=' END FOR p IN string_split(x.q, '&') IF p <> ''
      AND lower(string_split(p, '=')[1]) NOT IN ('gclid','fbclid','ref','igshid') AND NOT starts_with(lower(string_split(p, '=')[1]), 'utm_')] AS kept FROM parts))"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# Activity over time


def _activity(unit: str, fmt: str, start: str, end: str, zone: str = "UTC"):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = timeseries.activity(table(spark, sf_dir, "events"), "ts", unit, start, end, zone)
        return out.select(F.date_format("bucket", fmt).alias("bucket"), "n")

    return run


def _activity_sql(unit: str, fmt: str, start: str, end: str, ts: str = "ts") -> str:
    return f"""
WITH spine AS (SELECT unnest(generate_series(date_trunc('{unit}', TIMESTAMP '{start}'), date_trunc('{unit}', TIMESTAMP '{end}'), INTERVAL 1 {unit})) AS b),
counts AS (SELECT date_trunc('{unit}', {ts}) AS b, count(*) AS n FROM events GROUP BY 1)
SELECT strftime(spine.b, '{fmt}') AS bucket, coalesce(n, 0) AS n FROM spine LEFT JOIN counts ON spine.b = counts.b"""


for _unit, _java, _c in (("day", "yyyy-MM-dd", "%Y-%m-%d"), ("hour", "yyyy-MM-dd HH:mm", "%Y-%m-%d %H:%M"), ("week", "yyyy-MM-dd", "%Y-%m-%d"), ("month", "yyyy-MM", "%Y-%m")):
    _span = ("2023-12-30 00:00:00", "2024-02-02 00:00:00")
    query(f"activity_by_{_unit}", _activity_sql(_unit, _c, *_span))(_activity(_unit, _java, *_span))

_EASTERN_TS = "timezone('America/New_York', timezone('UTC', ts))"
query("activity_by_day_local", _activity_sql("day", "%Y-%m-%d", "2023-12-30 00:00:00", "2024-02-02 00:00:00", _EASTERN_TS))(_activity("day", "yyyy-MM-dd", "2023-12-30 00:00:00", "2024-02-02 00:00:00", times.EASTERN))


@query("returning_users_by_day", """
WITH e AS (SELECT user_id, ts FROM events), joined AS (SELECT user_id, min(ts) AS j FROM e GROUP BY 1),
active AS (SELECT DISTINCT user_id, date_trunc('hour', ts) AS h FROM e),
counts AS (SELECT date_trunc('day', h) AS b, count(DISTINCT user_id) AS n FROM active JOIN joined USING (user_id) WHERE j < date_trunc('day', h) GROUP BY 1),
spine AS (SELECT unnest(generate_series(TIMESTAMP '2023-12-31', TIMESTAMP '2024-02-01', INTERVAL 1 day)) AS b)
SELECT CAST(spine.b AS DATE) AS bucket, coalesce(n, 0) AS n FROM spine LEFT JOIN counts ON spine.b = counts.b""")
def returning_users_by_day(spark, sf_dir):
    out = timeseries.returning_users(table(spark, sf_dir, "events"), "user_id", "ts", "day", "2023-12-31 00:00:00", "2024-02-01 00:00:00")
    return out.select(F.to_date("bucket").alias("bucket"), "n")


@query("window_counts", f"""
SELECT event_type, count(*) FILTER (ts > TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 1 day AND ts <= TIMESTAMP '{EVENTS_AS_OF}') AS last_24h,
  count(*) FILTER (ts > TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 7 day AND ts <= TIMESTAMP '{EVENTS_AS_OF}') AS last_7d,
  count(*) FILTER (ts > TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 30 day AND ts <= TIMESTAMP '{EVENTS_AS_OF}') AS last_30d,
  count(*) FILTER (ts > TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 90 day AND ts <= TIMESTAMP '{EVENTS_AS_OF}') AS last_90d, count(*) AS total
FROM events GROUP BY event_type""")
def window_counts(spark, sf_dir):
    return timeseries.window_counts(table(spark, sf_dir, "events"), "ts", EVENTS_AS_OF, {"last_24h": 1, "last_7d": 7, "last_30d": 30, "last_90d": 90}, ["event_type"])


@query("status_counts", """
SELECT v AS value, count(o_orderkey) AS n FROM (SELECT unnest(['F','O','P','X']) AS v) LEFT JOIN orders ON o_orderstatus = v GROUP BY v""")
def status_counts(spark, sf_dir):
    return timeseries.zero_filled(table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O", "P", "X"])


# Search


@query("job_search", f"""
WITH {POSTINGS}
SELECT id, title, company, salary_min, salary_max, strftime(listed_at, '%Y-%m-%d %H:%M:%S') AS listed FROM postings
WHERE contains(lower(title), 'high') AND NOT contains(lower(title), 'low') AND NOT closed AND sector = 'BUILDING'
  AND coalesce(salary_max, salary_min) >= 50000 AND coalesce(salary_min, salary_max) <= 400000
ORDER BY listed_at DESC, found_at DESC, id LIMIT 50""")
def job_search(spark, sf_dir):
    s = search.Search(words="HIGH -low", sector="BUILDING", salary_from=50_000, salary_to=400_000)
    found = search.search(postings(spark, sf_dir).where(~F.col("closed")), s, AS_OF)
    return search.page(found, 50).select("id", "title", "company", "salary_min", "salary_max", F.date_format("listed_at", "yyyy-MM-dd HH:mm:ss").alias("listed"))


@query("search_facets", f"""
WITH {POSTINGS}
SELECT id, area, workplace FROM postings WHERE workplace = 'remote' AND list_contains(areas, 'R1') AND posted_at >= CAST(TIMESTAMP '{AS_OF}' AS DATE) - 400""")
def search_facets(spark, sf_dir):
    return search.search(postings(spark, sf_dir), search.Search(workplace="remote", area="R1", posted_within=400), AS_OF).select("id", "area", "workplace")


@query("search_titles", "SELECT p_partkey AS id, p_name AS title FROM part WHERE contains(lower(p_name), 'ring') AND contains(lower(p_name), 'l') AND NOT contains(lower(p_name), 'small')")
def search_titles(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.where(text.matches_query(F.col("p_name"), "RING l -Small")).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))


@query("search_page_two", f"""
WITH {POSTINGS} SELECT id, company FROM postings WHERE NOT closed ORDER BY listed_at DESC, found_at DESC, id LIMIT 20 OFFSET 20""")
def search_page_two(spark, sf_dir):
    return search.page(postings(spark, sf_dir).where(~F.col("closed")), 20, 20).select("id", "company")


@query("search_capped_count", f"WITH {POSTINGS} SELECT least(count(*), 1000) AS total, count(*) > 1000 AS is_capped FROM postings WHERE NOT closed")
def search_capped_count(spark, sf_dir):
    return search.capped_count(postings(spark, sf_dir).where(~F.col("closed")), 1000)


_PLACES = "[{'lat': 25 + s_suppkey % 20 + 0.01 * (s_suppkey % 7), 'lon': -120 + s_suppkey % 50 + 0.02 * (s_suppkey % 5)}, {'lat': 30.0 + s_nationkey, 'lon': -100.0 + s_nationkey}]"


@query("search_radius", f"""
WITH p AS (SELECT s_suppkey AS id, unnest({_PLACES}) AS p FROM supplier),
d AS (SELECT id, min(2 * 3958.8 * asin(sqrt(least(1.0, pow(sin(radians(40.0 - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(40.0)) * pow(sin(radians(-90.0 - p.lon) / 2), 2))))) AS distance FROM p GROUP BY id)
SELECT id, round(distance, 6) AS distance, CASE WHEN distance < 0.5 THEN 0 WHEN distance <= 5 THEN 1 WHEN distance <= 15 THEN 2 ELSE 3 END AS band FROM d WHERE distance <= 300""")
def search_radius(spark, sf_dir):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    point = lambda lat, lon: F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"))
    places = F.array(point(25 + k % 20 + 0.01 * (k % 7), -120 + k % 50 + 0.02 * (k % 5)), point(30.0 + n, -100.0 + n))
    df = table(spark, sf_dir, "supplier").select(k.alias("id"), places.alias("places"))
    return search.around(df, 40.0, -90.0, 300.0).select("id", F.round("distance", 6).alias("distance"), "band")


@query("similar_jobs", f"""
WITH {POSTINGS}, few AS (SELECT id AS of_id, company AS own, title AS wanted FROM postings WHERE id % 100 = 0),
a AS (SELECT of_id AS id, 'company' AS kind, row_number() OVER (PARTITION BY of_id ORDER BY listed_at DESC, p.id) AS rank, p.id AS other FROM postings p JOIN few ON company = own AND p.id <> of_id),
b AS (SELECT of_id AS id, 'title' AS kind, row_number() OVER (PARTITION BY of_id ORDER BY listed_at DESC, p.id) AS rank, p.id AS other FROM postings p JOIN few ON title = wanted AND company <> own)
SELECT id, kind, CAST(rank AS INTEGER) AS rank, other FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE rank <= 4""")
def similar_jobs(spark, sf_dir):
    df = postings(spark, sf_dir)
    return search.similar(df, df.where("id % 100 = 0"), 4)  # the postings whose pages are asked for


@query("related_jobs", f"""
WITH {POSTINGS}, open_ AS (SELECT * FROM postings WHERE NOT closed),
t AS (SELECT a.id, b.id AS other, b.listed_at AS l, 0 AS p FROM open_ a JOIN open_ b ON a.title = b.title AND a.company <> b.company),
s AS (SELECT a.id, b.id AS other, b.listed_at AS l, 1 AS p FROM open_ a JOIN open_ b ON a.sector = b.sector AND a.area = b.area AND a.company <> b.company),
m AS (SELECT id, other, l, min(p) AS p FROM (SELECT * FROM t UNION ALL SELECT * FROM s) GROUP BY ALL),
r AS (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY p, l DESC, other) AS rank FROM m)
SELECT id, CAST(rank AS INTEGER) AS rank, other FROM r WHERE rank <= 6""")
def related_jobs(spark, sf_dir):
    return search.related(postings(spark, sf_dir).where(~F.col("closed")), 6)


@query("suggest_terms", """
WITH w AS (SELECT doc_id, unnest(list_distinct(string_split(lower(text), ' '))) AS term FROM documents),
c AS (SELECT term, count(DISTINCT doc_id) AS n FROM w GROUP BY term)
SELECT term, n, CASE WHEN starts_with(term, 'th') THEN 0 ELSE 1 END AS tier FROM c WHERE contains(term, 'th') ORDER BY tier, n DESC, term LIMIT 25""")
def suggest_terms(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", F.split(F.lower("text"), " ").alias("words"))
    return search.suggest(search.term_counts(df, "words", "doc_id"), "term", "th", 25).select("term", "n", "tier")


# URLs and text


@query("url_normalize", f"WITH {NORMAL} SELECT id, normalized, sha256(normalized) AS url_hash, domain FROM normal")
def url_normalize(spark, sf_dir):
    return registry(spark, sf_dir).select("id", "normalized", "url_hash", "domain")


@query("url_dedup", f"WITH {NORMAL} SELECT normalized, count(*) AS n, min(id) AS first_id FROM normal GROUP BY 1")
def url_dedup(spark, sf_dir):
    return registry(spark, sf_dir).groupBy("normalized").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("url_new_only", f"""
WITH {NORMAL} SELECT DISTINCT sha256(normalized) AS url_hash FROM normal WHERE id % 3 <> 0 AND normalized NOT IN (SELECT normalized FROM normal WHERE id % 3 = 0)""")
def url_new_only(spark, sf_dir):
    r = registry(spark, sf_dir)
    return dedup.new_only(r.where("id % 3 <> 0"), r.where("id % 3 = 0"), "url_hash").select("url_hash")


@query("company_keys", """
WITH n AS (SELECT c_custkey AS id, replace(c_name, '#', ' ') || (['', ' Inc.', ', LLC', '  Co', ' GmbH ', ' Company'])[c_custkey % 6 + 1] AS name FROM customer)
SELECT id, nullif(regexp_replace(trim(regexp_replace(regexp_replace(lower(trim(name)), '[.,]', '', 'g'), '\\b(inc|incorporated|llc|l\\.l\\.c|corp|corporation|co|company|ltd|limited|plc|gmbh)\\.?\\s*$', '')), '\\s+', ' ', 'g'), '') AS company_key FROM n""")
def company_keys(spark, sf_dir):
    ends = F.array(*map(F.lit, ("", " Inc.", ", LLC", "  Co", " GmbH ", " Company")))
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.translate("c_name", "#", " "), F.element_at(ends, (F.col("c_custkey") % 6 + 1).cast("int"))).alias("name"))
    return df.select("id", text.company_key(F.col("name")).alias("company_key"))


@query("title_keys", """
SELECT p_partkey AS id, nullif(trim(regexp_replace(regexp_replace(lower(trim(p_name || ' / ' || p_type || ' (' || p_brand || ')')), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '') AS title_key FROM part""")
def title_keys(spark, sf_dir):
    title = F.concat("p_name", F.lit(" / "), "p_type", F.lit(" ("), "p_brand", F.lit(")"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.title_key(title).alias("title_key"))


@query("slugs", """
WITH s AS (SELECT p_partkey AS id, trim(regexp_replace(lower(p_type || '  ' || p_name || '!'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part)
SELECT id, slug, CASE WHEN len(slug) <= 12 THEN slug WHEN contains(slug[1:13], '-') THEN regexp_replace(slug[1:13], '-[^-]*$', '') ELSE slug[1:12] END AS short FROM s""")
def slugs(spark, sf_dir):
    name = F.concat("p_type", F.lit("  "), "p_name", F.lit("!"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.slug(name).alias("slug"), text.slug(name, 12).alias("short"))


_RAW = "CASE WHEN turn % 2 = 0 THEN replace(replace(text, '. ', '; '), ', ', '|') ELSE replace(text, ' ', ' ; ') END"


@query("location_counts", f"""
WITH c AS (SELECT conv_id, [trim(x) FOR x IN regexp_split_to_array({_RAW}, '[;|]') IF trim(x) <> '' AND NOT ends_with(trim(x), '...')] AS e FROM conversations),
f AS (SELECT conv_id, [x FOR x, i IN e IF list_position([lower(y) FOR y IN e], lower(x)) = i] AS e FROM c),
u AS (SELECT conv_id, unnest(e) AS place FROM f)
SELECT place, count(DISTINCT conv_id) AS n FROM u GROUP BY place ORDER BY n DESC, place LIMIT 500""")
def location_counts(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").select("conv_id", text.split_locations(F.expr(_RAW), None, None).alias("places"))
    return df.select("conv_id", F.explode("places").alias("place")).groupBy("place").agg(F.countDistinct("conv_id").alias("n")).orderBy(F.desc("n"), "place").limit(500)


# Duplicates


_DUP = "regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')"


@query("duplicate_groups_possible", f"SELECT source, sha256({_DUP}) AS title_key, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_groups_possible(spark, sf_dir):
    return dedup.possible_groups(_keyed(spark, sf_dir), ["source", "title_key"], "doc_id")


def _keyed(spark, sf_dir) -> DataFrame:
    """Documents with a short key of their normalised text."""
    key = F.sha2(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ").cast("binary"), 256)
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", key.alias("title_key"))


_LEADERS = f"""
keyed AS (SELECT doc_id, source, sha256({_DUP}) AS k FROM documents),
leaders AS (SELECT doc_id, source, nullif(first_value(doc_id) OVER (PARTITION BY k ORDER BY source, doc_id), doc_id) AS "primary" FROM keyed)"""


@query("dedup_leaders", f'WITH {_LEADERS} SELECT doc_id, "primary" FROM leaders')
def dedup_leaders(spark, sf_dir):
    return dedup.exact_leaders(_keyed(spark, sf_dir), ["title_key"], ["source", "doc_id"], "doc_id")


@query("duplicate_groups_linked", f'WITH {_LEADERS} SELECT l.doc_id, l.source, c.n AS copies FROM leaders l JOIN (SELECT "primary" AS p, count(*) AS n FROM leaders WHERE "primary" IS NOT NULL GROUP BY 1) c ON l.doc_id = c.p')
def duplicate_groups_linked(spark, sf_dir):
    keyed = _keyed(spark, sf_dir)
    linked = keyed.join(dedup.exact_leaders(keyed, ["title_key"], ["source", "doc_id"], "doc_id"), "doc_id")
    return dedup.linked_groups(linked, "doc_id", "primary").select("doc_id", "source", "copies")


def placed_postings(spark, sf_dir) -> DataFrame:
    p = postings(spark, sf_dir)
    place = F.concat(F.col("area"), F.lit("/"), (F.col("id") % 13).cast("string"))
    return p.select(
        "id", F.col("company_key"), F.col("title").alias("title_key"), (F.col("id") % 5 == 0).alias("official"), "closed", F.lit(False).alias("linked"), F.col("found_at").alias("created_at"),
        F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("domain"), F.when(F.col("id") % 10 != 0, F.array(place)).otherwise(F.array().cast("array<string>")).alias("locations"), F.array(F.concat(F.col("area"), F.lit("@"), (F.col("id") % 4).cast("string"))).alias("places"),
    )


@query("dedup_by_place")
def dedup_by_place(spark, sf_dir):
    return dedup.place_leaders(placed_postings(spark, sf_dir))


@query("dedup_arrivals")
def dedup_arrivals(spark, sf_dir):
    df = placed_postings(spark, sf_dir)
    young = F.col("created_at") >= F.lit("1998-06-01").cast("timestamp")
    old = df.where(~young)
    return dedup.place_arrivals(df.where(young), old.join(dedup.place_leaders(old), "id"))


@query("latest_per_user", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_user(spark, sf_dir):
    return dedup.latest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type", "value")


@query("near_equal_sets", """
WITH r AS (SELECT DISTINCT l_suppkey % 40 AS g, l_partkey % 60 AS i FROM lineitem WHERE (l_partkey + l_suppkey) % 5 <> 0 OR l_quantity > 30),
s AS (SELECT g, count(*) AS size FROM r GROUP BY g),
p AS (SELECT x.g AS a, y.g AS b, count(*) AS shared FROM r x JOIN r y ON x.i = y.i AND x.g < y.g GROUP BY 1, 2)
SELECT a, b, shared FROM p JOIN s sa ON sa.g = a JOIN s sb ON sb.g = b WHERE shared >= 0.9 * greatest(sa.size, sb.size)""")
def near_equal_sets(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").where("(l_partkey + l_suppkey) % 5 <> 0 OR l_quantity > 30")
    return dedup.near_equal_sets(df.select((F.col("l_suppkey") % 40).alias("g"), (F.col("l_partkey") % 60).alias("i")), "g", "i", 0.9)


@query("manifest_diff", f"""
WITH {POSTINGS}, o AS (SELECT id, title AS v FROM postings WHERE id % 10 <> 0), n AS (SELECT id, CASE WHEN id % 7 = 0 THEN 'x' ELSE title END AS v FROM postings WHERE id % 11 <> 0)
SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'new' WHEN n.id IS NULL THEN 'removed' ELSE 'changed' END AS status FROM o FULL JOIN n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.v <> n.v""")
def manifest_diff(spark, sf_dir):
    p = postings(spark, sf_dir).select("id", F.col("title").alias("v"))
    return dedup.manifest_diff(p.where("id % 10 <> 0"), p.where("id % 11 <> 0").withColumn("v", F.when(F.col("id") % 7 == 0, "x").otherwise(F.col("v"))), "id", "v")


# Collections


_OK = "(salary_currency IS NULL OR salary_currency = 'USD') AND (coalesce(salary_min > 0 AND salary_min <= 2000000, false) OR coalesce(salary_max > 0 AND salary_max <= 2000000, false))"
_NOW = f"TIMESTAMP '{AS_OF}'"
_E = "timezone('America/New_York', timezone('UTC', {}))"
_TODAY, _FIRST = f"CAST({_E.format(_NOW)} AS DATE)", f"CAST({_E.format(f'({_NOW} - INTERVAL 24 hour)')} AS DATE)"


@query("collection_stats", f"""
WITH {POSTINGS}
SELECT sector, area, count(*) AS open_jobs, count(DISTINCT coalesce(company_key, domain)) AS companies_hiring, count(*) FILTER (workplace = 'remote') AS remote_jobs, count(*) FILTER (workplace = 'hybrid') AS hybrid_jobs,
  count(*) FILTER (workplace = 'onsite') AS onsite_jobs, count(*) FILTER ({_OK}) AS jobs_with_salary, count(*) FILTER (posted_at BETWEEN {_FIRST} AND {_TODAY}) AS jobs_posted_24h,
  count(*) FILTER (found_at > {_NOW} - INTERVAL 24 hour AND found_at <= {_NOW}) AS jobs_found_24h, count(*) FILTER (last_seen_at > {_NOW} - INTERVAL 24 hour AND last_seen_at <= {_NOW}) AS jobs_verified_24h,
  CAST(round_even(median(salary_min) FILTER ({_OK} AND salary_min BETWEEN 1000 AND 2000000), 0) AS BIGINT) AS median_salary_min,
  CAST(round_even(median(salary_max) FILTER ({_OK} AND salary_max BETWEEN 1000 AND 2000000), 0) AS BIGINT) AS median_salary_max
FROM postings WHERE NOT closed GROUP BY sector, area""")
def collection_stats(spark, sf_dir):
    return stats.collection_stats(postings(spark, sf_dir), AS_OF, ["sector", "area"])


_W = lambda x: f"epoch({_E.format(x)})"
_QUALIFY = f"""
j AS (SELECT *, {_W(_NOW)} - {_W('found_at')} AS age, {_W(_NOW)} - {_W('last_seen_at')} AS seen, {_OK} AS ok FROM postings WHERE NOT closed),
g AS (SELECT sector, area, count(*) AS n, sum(CAST(coalesce(CAST({_E.format('found_at')} AS DATE) >= {_TODAY} - 6 OR posted_at BETWEEN {_TODAY} - 6 AND {_TODAY} OR seen <= 172800, false) AS INTEGER)) AS fresh,
  sum(CAST(ok AS INTEGER) + CAST(workplace <> 'unknown' AS INTEGER) + CAST(posted_at IS NOT NULL AS INTEGER) + 1) AS complete,
  count(DISTINCT CASE WHEN age >= 0 AND age < 4 * 604800 THEN floor(age / 604800) END) AS weeks, least(min(age), min(seen)) AS quiet FROM j GROUP BY 1, 2),
t AS (SELECT sector, area, max(k) AS top, count(*) AS companies FROM (SELECT sector, area, company_key, count(*) AS k FROM j GROUP BY ALL) GROUP BY 1, 2),
p AS (SELECT sector, count(*) AS parent_size FROM j GROUP BY 1),
s AS (SELECT sector, area, n, companies, top / n AS ts, n / parent_size AS within, quiet,
  round_even(least(1.0, n / 100) * 25, 1) AS inventory_score,
  round_even(least(1.0, companies / 20) * CASE WHEN top / n <= 0.5 THEN 1.0 ELSE (1 - top / n) / 0.5 END * 15, 1) AS diversity_score,
  round_even(least(1.0, fresh / (n * 0.5)) * 20, 1) AS freshness_score, round_even(complete / (4 * n) * 10, 1) AS quality_score, round_even(weeks / 4 * 10, 1) AS stability_score,
  round_even(least(1.0, (1 - n / parent_size) / 0.5) * 5, 1) AS uniqueness_score FROM g JOIN t USING (sector, area) JOIN p USING (sector)),
q AS (SELECT *, CAST(round_even(100 * (inventory_score + diversity_score + freshness_score + quality_score + stability_score + uniqueness_score) / 85, 0) AS INTEGER) AS total,
  array_to_string([x FOR x IN [CASE WHEN n < 20 THEN 'too_few_jobs' END, CASE WHEN companies < 5 THEN 'too_few_employers' END, CASE WHEN ts > 0.5 THEN 'one_employer_dominates' END, CASE WHEN within >= 0.9 THEN 'near_duplicate' END, CASE WHEN quiet > 14 * 86400 THEN 'stale' END] IF x IS NOT NULL], ',') AS issues FROM s),
qualified AS (SELECT sector, area, n, companies, inventory_score, diversity_score, freshness_score, quality_score, stability_score, uniqueness_score, total, issues,
  CASE WHEN total >= 80 AND issues = '' THEN 'index' WHEN total >= 60 THEN 'review' ELSE 'noindex' END AS recommendation FROM q)"""


def _qualified(spark, sf_dir) -> DataFrame:
    jobs = postings(spark, sf_dir)
    parents = jobs.where(~F.col("closed")).groupBy("sector").agg(F.count("*").alias("parent_size"))
    pairs = jobs.where(~F.col("closed")).select("sector", "area").distinct().join(parents, "sector")
    return stats.qualify(jobs, AS_OF, ["sector", "area"], pairs)


@query("qualify_groups", f"WITH {POSTINGS}, {_QUALIFY} SELECT * FROM qualified")
def qualify_groups(spark, sf_dir):
    return _qualified(spark, sf_dir)


@query("discover_groups", f"WITH {POSTINGS}, {_QUALIFY} SELECT sector, area, n, total, recommendation FROM qualified WHERE n >= 20 ORDER BY total DESC, n DESC, sector, area LIMIT 100")
def discover_groups(spark, sf_dir):
    return _qualified(spark, sf_dir).where("n >= 20").orderBy(F.desc("total"), F.desc("n"), "sector", "area").limit(100).select("sector", "area", "n", "total", "recommendation")


@query("lifecycle_transitions", f"""
WITH {POSTINGS}, {_QUALIFY}, st AS (SELECT *, (['candidate','active','review','retired','rejected'])[(n + companies) % 5 + 1] AS status FROM qualified)
SELECT sector, area, status, CASE WHEN status IN ('rejected','merged') THEN status WHEN total >= 80 AND issues = '' AND status IN ('candidate','review','retired') THEN 'active'
  WHEN total < 60 AND status = 'active' THEN 'retired' WHEN total >= 60 AND status = 'candidate' THEN 'review' ELSE status END AS next_status FROM st""")
def lifecycle_transitions(spark, sf_dir):
    states = F.array(*map(F.lit, ("candidate", "active", "review", "retired", "rejected")))
    df = _qualified(spark, sf_dir).withColumn("status", F.element_at(states, ((F.col("n") + F.col("companies")) % 5 + 1).cast("int")))
    return df.select("sector", "area", "status", stats.transition(F.col("status"), F.col("total"), F.col("issues")).alias("next_status"))


_FAMILIES = {"sector": ["sector"], "area": ["area"], "sector_area": ["sector", "area"], "sector_workplace": ["sector", "workplace"], "title": ["title"], "title_sector": ["title", "sector"], "title_area": ["title", "area"]}


@query("collection_report", "WITH " + POSTINGS + ", x AS (" + " UNION ALL ".join(f"SELECT '{f}' AS family, {' || $$|$$ || '.join(c)} AS key, count(*) AS n FROM postings WHERE NOT closed GROUP BY ALL" for f, c in _FAMILIES.items()) + ") SELECT * FROM x WHERE n >= 20")
def collection_report(spark, sf_dir):
    return stats.candidates(postings(spark, sf_dir), _FAMILIES, 20)


@query("hub_sections", f"""
WITH {POSTINGS}, r AS (SELECT sector, area, id, count(*) OVER (PARTITION BY sector, area) AS group_size, row_number() OVER (PARTITION BY sector, area ORDER BY listed_at DESC, id) AS rank FROM postings WHERE NOT closed)
SELECT sector, area, group_size, CAST(dense_rank() OVER (PARTITION BY sector ORDER BY group_size DESC, area) AS INTEGER) AS group_rank, CAST(rank AS INTEGER) AS rank, id FROM r WHERE rank <= 5 AND group_size >= 5""")
def hub_sections(spark, sf_dir):
    return stats.sections(postings(spark, sf_dir).where(~F.col("closed")), "sector", "area", [F.desc("listed_at"), F.asc("id")], 5, 5)


@query("sector_day_manifest", f"""
WITH {POSTINGS}, d AS (SELECT sector, coalesce(posted_at, CAST({_E.format('found_at')} AS DATE)) AS day FROM postings)
SELECT sector, day, count(*) AS n FROM d GROUP BY GROUPING SETS ((sector, day), (sector))""")
def sector_day_manifest(spark, sf_dir):
    df = postings(spark, sf_dir).select("sector", times.job_day(F.col("posted_at"), F.col("found_at")).alias("day"))
    return df.groupingSets([[F.col("sector"), F.col("day")], [F.col("sector")]], "sector", "day").agg(F.count("*").alias("n"))


@query("mode_and_share", """
WITH c AS (SELECT user_id, event_type, count(*) AS k FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k DESC, event_type) AS r, sum(k) OVER (PARTITION BY user_id) AS n FROM c)
SELECT user_id, event_type AS mode, k / n AS share, CAST(n AS BIGINT) AS n FROM r WHERE r = 1""")
def mode_and_share(spark, sf_dir):
    return stats.mode_and_share(table(spark, sf_dir, "events"), ["user_id"], "event_type")


@query("stratified_sample", """
WITH h AS (SELECT doc_id, source, sha256('7' || doc_id) AS h, count(*) OVER (PARTITION BY source) AS size, count(*) OVER () AS total FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS r FROM h)
SELECT doc_id, source FROM r ORDER BY CASE WHEN r > least(20, greatest(1, ceil(200 * size / total))) THEN 1 ELSE 0 END, h, doc_id LIMIT 200""")
def stratified_sample(spark, sf_dir):
    return stats.stratified(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 200, 20, "7")


@query("wilson_interval", """
WITH c AS (SELECT source, count(*) FILTER (quality = 1) AS k, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source)
SELECT source, k, n, round((k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 9) AS low,
  round((k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 9) AS high FROM c""")
def wilson_interval(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    sums = df.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("k"), F.count("*").alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return sums.select("source", "k", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


# Maintenance


@query("coverage_folds", """
WITH RECURSIVE n AS (SELECT l_suppkey AS source, CAST(date_trunc('month', l_shipdate) AS DATE) AS at_month, CAST(count(*) AS DOUBLE) AS c FROM lineitem GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY at_month) AS i FROM n),
f AS (SELECT DISTINCT source, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS base, 0 AS low, CAST(NULL AS DATE) AS flag FROM o
  UNION ALL SELECT f.source, o.i, CASE WHEN f.i < 5 THEN base + (c - base) / (f.i + 1) WHEN base > 0 AND c < base * 0.5 THEN base ELSE base + 0.3 * (c - base) END,
    CASE WHEN f.i >= 5 AND base > 0 AND c < base * 0.5 THEN low + 1 ELSE 0 END, CASE WHEN f.i >= 5 AND base > 0 AND c < base * 0.5 THEN CASE WHEN low + 1 >= 3 THEN coalesce(flag, at_month) ELSE flag END END
  FROM f JOIN o ON o.source = f.source AND o.i = f.i + 1)
SELECT source, CAST(i AS INTEGER) AS samples, round(base, 6) AS baseline, low AS low_streak, flag AS flagged_at FROM f QUALIFY i = max(i) OVER (PARTITION BY source)""")
def coverage_folds(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("source"), F.date_trunc("month", F.col("l_shipdate").cast("timestamp")).alias("at")).agg(F.count("*").alias("n"))
    out = maintenance.coverage(df, "source", "at", "n")
    return out.withColumn("baseline", F.round("baseline", 6)).withColumn("flagged_at", F.to_date("flagged_at"))


@query("adaptive_intervals", """
SELECT s_suppkey AS id, greatest(120, least(4320, CAST(round_even(CASE WHEN s_suppkey % 5 = 0 THEN CAST(m AS DOUBLE) WHEN s_suppkey % 3 > 0 THEN m * 0.5 ELSE m * 1.5 END, 0) AS INTEGER))) AS minutes
FROM (SELECT s_suppkey, CAST(100 + s_suppkey * 37 % 5000 AS INTEGER) AS m FROM supplier)""")
def adaptive_intervals(spark, sf_dir):
    k = F.col("s_suppkey")
    df = table(spark, sf_dir, "supplier").select(k.alias("id"), (100 + k * 37 % 5000).cast("int").alias("m"))
    return df.select("id", maintenance.next_interval(F.col("m"), F.col("id") % 3, F.col("id") % 5 == 0).alias("minutes"))


@query("backoff_schedule", "SELECT event_id, CASE WHEN event_id % 7 < 5 THEN least(86400.0, 60 * pow(4, event_id % 7 - 1)) END AS wait FROM events")
def backoff_schedule(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", maintenance.backoff(F.col("event_id") % 7).alias("wait"))


@query("interval_tiers", """
SELECT CASE WHEN m <= 120 THEN '2h' WHEN m <= 720 THEN '12h' WHEN m <= 1440 THEN '1d' ELSE '3d' END AS tier, count(*) AS n FROM (SELECT 100 + s_suppkey * 37 % 5000 AS m FROM supplier) GROUP BY 1""")
def interval_tiers(spark, sf_dir):
    return table(spark, sf_dir, "supplier").groupBy(maintenance.interval_tier(100 + F.col("s_suppkey") * 37 % 5000).alias("tier")).agg(F.count("*").alias("n"))


@query("sources_due", f"""
SELECT s_suppkey AS id FROM supplier WHERE s_acctbal > 0 AND (s_suppkey % 4 <> 0 OR {_NOW} - to_minutes(CAST(s_suppkey % 60 AS INTEGER)) < {_NOW} - INTERVAL 30 minute)
  AND (s_suppkey % 3 = 0 OR {_NOW} + to_minutes(CAST(s_suppkey % 90 - 45 AS INTEGER)) <= {_NOW})
ORDER BY CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey % 90 - 45 END NULLS FIRST, s_suppkey LIMIT 40""")
def sources_due(spark, sf_dir):
    k, now = F.col("s_suppkey"), F.lit(AS_OF).cast("timestamp")
    minutes = lambda m: F.make_dt_interval(F.lit(0), F.lit(0), m.cast("int"))
    df = table(spark, sf_dir, "supplier").select(k.alias("id"), (F.col("s_acctbal") > 0).alias("active"), F.when(k % 4 == 0, now - minutes(k % 60)).alias("claimed_at"), F.when(k % 3 != 0, now + minutes(k % 90 - 45)).alias("next_at"))
    return maintenance.sources_due(df, AS_OF, 40).select("id")


@query("presence_sweep", f"""
WITH r AS (SELECT o_custkey % 20 AS source, o_orderkey AS url, CASE WHEN o_orderkey % 3 <> 0 THEN {_NOW} - to_hours(CAST(o_orderkey % 12 AS INTEGER)) END AS last_seen_at,
    CASE WHEN o_orderkey % 4 = 0 THEN {_NOW} - to_minutes(CAST(o_orderkey % 300 AS INTEGER)) END AS missing_since, CASE WHEN o_orderkey % 6 = 1 THEN {_NOW} - to_hours(CAST(o_orderkey % 40 AS INTEGER)) END AS closed_at,
    o_orderkey % 5 IN (0, 1) AS seen, o_custkey % 20 % 4 <> 0 AS healthy FROM orders),
m AS (SELECT *, healthy AND NOT seen AND closed_at IS NULL AS missed, healthy AND NOT seen AND closed_at IS NULL AND coalesce(missing_since <= {_NOW} - INTERVAL 1 hour, false) AS again,
    count(*) FILTER (closed_at IS NULL) OVER (PARTITION BY source) AS o, count(*) FILTER (closed_at >= {_NOW} - INTERVAL 24 hour) OVER (PARTITION BY source) AS c FROM r),
k AS (SELECT *, again AND row_number() OVER (PARTITION BY source ORDER BY again DESC, missing_since, url) <= greatest(0, greatest(10, floor((o + c) * 0.2)) - c) AS closes FROM m)
SELECT source, count(*) AS urls, count(*) FILTER (closes) AS closed_now, count(*) FILTER (CASE WHEN seen THEN false WHEN missed AND missing_since IS NULL THEN true ELSE missing_since IS NOT NULL END) AS missing,
  count(*) FILTER (CASE WHEN seen THEN false ELSE closed_at IS NOT NULL OR closes END) AS closed,
  count(*) FILTER (seen AND (last_seen_at IS NULL OR last_seen_at < {_NOW} - INTERVAL 6 hour OR missing_since IS NOT NULL OR closed_at IS NOT NULL) OR coalesce(last_seen_at = {_NOW}, false)) AS stamped FROM k GROUP BY source""")
def presence_sweep(spark, sf_dir):
    k, now = F.col("o_orderkey"), F.lit(AS_OF).cast("timestamp")
    ago = lambda h, m: now - F.make_dt_interval(F.lit(0), h.cast("int"), m.cast("int"))
    none = F.lit(0)
    orders = table(spark, sf_dir, "orders").withColumn("source", F.col("o_custkey") % 20)
    reg = orders.select("source", k.alias("url"), F.when(k % 3 != 0, ago(k % 12, none)).alias("last_seen_at"), F.when(k % 4 == 0, ago(none, k % 300)).alias("missing_since"), F.when(k % 6 == 1, ago(k % 40, none)).alias("closed_at"))
    listed = orders.where(k % 5 <= 1).select("source", (F.col("source") % 4 != 0).alias("healthy"), k.alias("url"))
    after = maintenance.presence(reg, listed, AS_OF)
    was = reg.select("source", "url", F.col("closed_at").alias("was"))
    both = after.join(was, ["source", "url"])
    return both.groupBy("source").agg(
        F.count("*").alias("urls"), F.count_if(F.col("was").isNull() & F.col("closed_at").isNotNull()).alias("closed_now"), F.count_if(F.col("missing_since").isNotNull()).alias("missing"),
        F.count_if(F.col("closed_at").isNotNull()).alias("closed"), F.count_if(F.col("last_seen_at") == now).alias("stamped"),
    )


# Demand


@query("alert_matches", f"""
WITH {POSTINGS}, s AS (SELECT p_partkey AS search_id, CASE WHEN p_partkey % 2 = 0 THEN 'urgent' END AS want_words, CASE WHEN p_partkey % 3 = 0 THEN 300000 END AS want_salary,
  CASE WHEN p_partkey % 5 <> 0 THEN (['BUILDING','MACHINERY','FURNITURE'])[p_partkey % 3 + 1] END AS want_sector, TIMESTAMP '2001-07-01' AS last_alerted_at FROM part)
SELECT search_id, id FROM s JOIN postings ON found_at > last_alerted_at AND (want_words IS NULL OR contains(lower(title), want_words)) AND (want_salary IS NULL OR coalesce(salary_max, salary_min) >= want_salary)
  AND (want_sector IS NULL OR sector = want_sector)""")
def alert_matches(spark, sf_dir):
    k = F.col("p_partkey")
    sectors = F.array(*map(F.lit, ("BUILDING", "MACHINERY", "FURNITURE")))
    saved = table(spark, sf_dir, "part").select(
        k.alias("search_id"), F.when(k % 2 == 0, "urgent").alias("want_words"), F.when(k % 3 == 0, 300000).alias("want_salary"), F.when(k % 5 != 0, F.element_at(sectors, (k % 3 + 1).cast("int"))).alias("want_sector"),
        F.lit(None).cast("string").alias("want_area"), F.lit("2001-07-01 00:00:00").cast("timestamp").alias("last_alerted_at"),
    )
    return demand.alert_matches(saved, postings(spark, sf_dir))


@query("weighted_position", """
WITH p AS (SELECT event_type, CAST(ts AS DATE) AS day, CAST(floor(value) AS BIGINT) % 5 AS clicks, CAST(floor(value) AS BIGINT) AS impressions, 1 + event_id % 40 AS position FROM events)
SELECT event_type, day, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, CASE WHEN sum(impressions) > 0 THEN round_even(CAST(sum(position * impressions) AS DOUBLE) / CAST(sum(impressions) AS DOUBLE), 2) ELSE 0.0 END AS position FROM p GROUP BY 1, 2""")
def weighted_position(spark, sf_dir):
    return demand.weighted_position(_performance(spark, sf_dir), ["event_type", "day"])


def _performance(spark, sf_dir) -> DataFrame:
    n = F.floor("value").cast("long")
    return table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), (n % 5).alias("clicks"), n.alias("impressions"), (1 + F.col("event_id") % 40).alias("position"), F.get_json_object("props", "$.k").cast("int").alias("page"))


@query("demand_top_pages", """
WITH p AS (SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS page, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS impressions FROM events GROUP BY 1, 2)
SELECT event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY impressions DESC, page) AS INTEGER) AS rank, page, impressions FROM p QUALIFY rank <= 10""")
def demand_top_pages(spark, sf_dir):
    return demand.top_parts(_performance(spark, sf_dir), ["event_type"], "page", "impressions", 10)


@query("shared_domains", """
WITH e AS (SELECT c_custkey AS company, 'd' || ((c_custkey * 7 + k * 13) % 300) AS domain, k AS rank FROM customer, (SELECT unnest([1, 2, 3]) AS k)),
b AS (SELECT company, domain FROM e QUALIFY row_number() OVER (PARTITION BY company ORDER BY rank, domain) = 1), o AS (SELECT domain, count(DISTINCT company) AS n FROM e GROUP BY 1)
SELECT company, domain, n >= 3 AS is_shared FROM b JOIN o USING (domain)""")
def shared_domains(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("company"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("rank"))
    return demand.domains(df.withColumn("domain", F.concat(F.lit("d"), ((F.col("company") * 7 + F.col("rank") * 13) % 300).cast("string"))))


@query("missing_keywords", """
WITH w AS (SELECT conv_id, lower(trim(unnest(string_split(text, ' ')))) AS keyword FROM conversations)
SELECT keyword, count(DISTINCT conv_id) AS n FROM w WHERE keyword <> '' GROUP BY 1 HAVING count(DISTINCT conv_id) >= 2 ORDER BY n DESC, keyword LIMIT 20""")
def missing_keywords(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").select("conv_id", F.split("text", " ").alias("words"))
    return demand.keyword_summary(df, "conv_id", "words", 2, 20)


@query("survey_counts", """
WITH r AS (SELECT 'role' AS question, role AS answer FROM conversations UNION ALL SELECT 'turn', CAST(turn AS VARCHAR) FROM conversations UNION ALL SELECT 'word', unnest(list_distinct(string_split(text, ' '))) FROM conversations)
SELECT question, answer, count(*) AS n FROM r WHERE answer IS NOT NULL GROUP BY 1, 2""")
def survey_counts(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").select("role", "turn", F.array_distinct(F.split("text", " ")).alias("word"))
    return demand.answer_counts(df, ["role", "turn"], ["word"])


@query("sitemap_shards", f"""
WITH {POSTINGS} SELECT id, CAST(floor((row_number() OVER (ORDER BY CAST(listed_at AS DATE) DESC, CAST(id AS VARCHAR)) - 1) / 1000) AS INTEGER) AS shard FROM postings""")
def sitemap_shards(spark, sf_dir):
    df = postings(spark, sf_dir).select("id", F.to_date("listed_at").alias("day"), F.col("id").cast("string").alias("path"))
    return demand.sitemap_shards(df, "day", "path", 1000).select("id", "shard")


@query("incomplete_by_source", """
SELECT source, count(*) AS n FROM documents WHERE length(trim(coalesce(text, ''))) < 300 GROUP BY source ORDER BY n DESC, source LIMIT 10""")
def incomplete_by_source(spark, sf_dir):
    df = table(spark, sf_dir, "documents").where(~html.is_complete(F.col("text"), F.lit(None).cast("string")))
    return df.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


# Pages


@query("html_titles", """
SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), '') AS title FROM pages""")
def html_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.page_title(F.col("html")).alias("title"))


@query("html_text")
def html_text(spark, sf_dir):
    small_batches(spark)
    return table(spark, sf_dir, "pages").select("page_id", html.html_to_text("html").alias("text"))


@query("html_postings")
def html_postings(spark, sf_dir):
    small_batches(spark)
    x = table(spark, sf_dir, "pages").select("page_id", html.ld_posting("html").alias("x"), html.page_title(F.col("html")).alias("t"), pay.salary_from_text("html").alias("s"))
    return x.select("page_id", F.coalesce("x.title", "t").alias("title"), "x.company", "x.location", F.coalesce("x.salary_min", "s.salary_min").alias("salary_min"), F.coalesce("x.salary_max", "s.salary_max").alias("salary_max"), "x.posted", "x.workplace")


# Names, sectors, workplaces and places


_SHAPES = ["{}", "Careers at {}", "{} Careers", "Corporate Careers | {}", "{} | A tagline of ours", "{} External Careers Site", "{} - Talent Acquisition", "careers.{}.com", "Careers", "Join us | Jobs with {} | {}", "{}.eightfold.ai", "Employment Opportunities at {}"]


@query("display_names", """
SELECT c_custkey AS id, CASE c_custkey % 12 WHEN 7 THEN 'careers.' || n || '.com' WHEN 8 THEN NULL WHEN 10 THEN n || '.eightfold.ai' ELSE n END AS company
FROM (SELECT c_custkey, replace(c_name, '#', ' ') AS n FROM customer)""")
def display_names(spark, sf_dir):
    shape = F.element_at(F.array(*map(F.lit, _SHAPES)), (F.col("c_custkey") % 12 + 1).cast("int"))
    raw = F.replace(shape, F.lit("{}"), F.translate("c_name", "#", " "))
    people = dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")
    return people.select(F.col("c_custkey").alias("id"), names.display_company(raw).alias("company"))


@query("sector_hashes", """
SELECT p_partkey AS id, substr(sha256(p_name || chr(0) || p_type), 1, 16) AS text_hash, CASE WHEN p_size / 50.0 >= 0.7 AND p_brand IN ('Brand#11', 'Brand#22', 'Brand#33') THEN p_brand ELSE 'unknown' END AS sector FROM part""")
def sector_hashes(spark, sf_dir):
    shown = names.sector_shown(F.col("p_brand"), F.col("p_size") / 50.0, ["Brand#11", "Brand#22", "Brand#33"])
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), names.text_hash(F.col("p_name"), F.col("p_type")).alias("text_hash"), shown.alias("sector"))


@query("accepted_titles", """
WITH s AS (SELECT p_partkey AS id, list_sort([{'s': -((p_partkey * k * 37) % 100) / 100.0, 'i': k} FOR k IN [1, 2, 3, 4, 5]])[1:3] AS x FROM part)
SELECT id, array_to_string(['t' || e.i FOR e, i IN x IF i = 1 OR -e.s >= 0.5], ',') AS titles FROM s""")
def accepted_titles(spark, sf_dir):
    k = F.col("p_partkey")
    scored = F.array(*(F.struct(F.lit(f"t{i}").alias("title"), ((k * i * 37) % 100 / 100.0).alias("score")) for i in range(1, 6)))
    return table(spark, sf_dir, "part").select(k.alias("id"), F.array_join(names.accepted(scored, 0.5, 3), ",").alias("titles"))


_SAID, _GEO = ["remote", None, "hybrid", "onsite", None, None, "remote"], ["other", "city", "other", "city", "state", "other", "city"]
_SQL_SAID = "[" + ", ".join(f"'{x}'" if x else "NULL" for x in _SAID) + "]"


@query("workplaces", f"""
WITH e AS (SELECT o_orderkey AS id, [o_orderkey % 7 + 1, o_orderkey // 7 % 7 + 1] AS k, {_SQL_SAID} AS w, {_GEO!r} AS g FROM orders),
t AS (SELECT id, [CASE WHEN w[i] = 'remote' AND g[i] = 'city' THEN 'hybrid' ELSE w[i] END FOR i IN k IF w[i] IS NOT NULL] AS said, len([i FOR i IN k IF w[i] IS NULL AND g[i] = 'city']) > 0 AS city, len([i FOR i IN k IF w[i] IS NULL AND g[i] = 'other']) > 0 AS odd FROM e),
u AS (SELECT id, odd, list_distinct([CASE WHEN x = 'remote' AND city THEN 'hybrid' ELSE x END FOR x IN said]) AS kinds FROM t),
d AS (SELECT id, (['unknown', 'onsite', 'remote', 'hybrid'])[id % 4 + 1] AS current, CASE WHEN len(kinds) = 1 AND NOT (kinds[1] = 'remote' AND odd) THEN kinds[1] END AS derived FROM u)
SELECT id, derived, CASE WHEN derived IS NOT NULL AND current IN ('unknown', 'onsite') THEN derived ELSE current END AS workplace FROM d""")
def workplaces(spark, sf_dir):
    k = F.col("o_orderkey")
    options = F.array(*(F.struct(F.lit(w).cast("string").alias("workplace"), F.lit(g).alias("geo")) for w, g in zip(_SAID, _GEO, strict=True)))
    entries = F.array(*(F.element_at(options, (i % 7 + 1).cast("int")) for i in (k, F.floor(k / 7))))
    current = F.element_at(F.array(*map(F.lit, ("unknown", "onsite", "remote", "hybrid"))), (k % 4 + 1).cast("int"))
    df = table(spark, sf_dir, "orders").select(k.alias("id"), names.workplace_of(entries).alias("derived"), current.alias("current"))
    return df.select("id", "derived", names.workplace_agreed(F.col("current"), F.col("derived")).alias("workplace"))


@query("full_read_slots", """
SELECT s_suppkey AS id, CAST(480 + list_reduce([instr('0123456789abcdef', c) - 1 FOR c IN string_split(md5(CAST(s_suppkey AS VARCHAR)), '')], lambda a, c: (a * 16 + c) % 720) AS INTEGER) AS minute FROM supplier""")
def full_read_slots(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), names.full_read_slot(F.md5(F.col("s_suppkey").cast("string").cast("binary"))).alias("minute"))


_GAZETTEER = "SELECT c_custkey AS place, 25 + (c_custkey * 7 % 2000) / 100.0 AS plat, -120 + (c_custkey * 13 % 5000) / 100.0 AS plon, c_custkey * 97 % 100000 AS people, 'A' || c_nationkey AS area FROM customer"
_POINTS = "SELECT s_suppkey AS id, 25 + (s_suppkey * 31 % 2000) / 100.0 AS lat, -120 + (s_suppkey * 17 % 5000) / 100.0 AS lon, 'A' || s_nationkey AS own_area FROM supplier"
_MILES = "2 * 3958.8 * asin(sqrt(least(1.0, pow(sin(radians(plat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(plat)) * pow(sin(radians(plon - lon) / 2), 2))))"


def _points(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), (25 + k * 31 % 2000 / 100.0).alias("lat"), (-120 + k * 17 % 5000 / 100.0).alias("lon"), F.concat(F.lit("A"), F.col("s_nationkey").cast("string")).alias("own_area"))


def _gazetteer(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("place"), (25 + k * 7 % 2000 / 100.0).alias("place_lat"), (-120 + k * 13 % 5000 / 100.0).alias("place_lon"), (k * 97 % 100000).alias("population"), F.concat(F.lit("A"), F.col("c_nationkey").cast("string")).alias("area"))


@query("nearest_places", f"""
WITH g AS ({_GAZETTEER}), p AS ({_POINTS}), d AS (SELECT id, place, {_MILES} AS distance FROM p, g WHERE people >= 5000)
SELECT id, place, round(distance, 6) AS distance FROM d WHERE distance <= 100 QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, place) = 1""")
def nearest_places(spark, sf_dir):
    out = places.nearest(_points(spark, sf_dir), _gazetteer(spark, sf_dir), "id", least_people=5000)
    return out.select("id", "place", F.round("distance", 6).alias("distance"))


@query("areas_around", f"""
WITH g AS ({_GAZETTEER}), p AS ({_POINTS}), d AS (SELECT id, area, {_MILES} AS distance FROM p, g UNION ALL SELECT id, own_area, -1 FROM p),
m AS (SELECT id, area, min(distance) AS distance FROM d WHERE distance <= 60 GROUP BY id, area)
SELECT id, area, CAST(row_number() OVER (PARTITION BY id ORDER BY distance, area) AS INTEGER) AS rank FROM m""")
def areas_around(spark, sf_dir):
    return places.areas_around(_points(spark, sf_dir), _gazetteer(spark, sf_dir), "id", 60.0)


@query("top_places", f"""
WITH {POSTINGS}, c AS (SELECT sector, unnest(areas) AS place FROM postings WHERE NOT closed), n AS (SELECT sector, place, count(*) AS n FROM c GROUP BY 1, 2)
SELECT sector, CAST(row_number() OVER (PARTITION BY sector ORDER BY n DESC, place) AS INTEGER) AS rank, place, n FROM n QUALIFY rank <= 15""")
def top_places(spark, sf_dir):
    return places.top_places(postings(spark, sf_dir).where(~F.col("closed")), "sector", "areas")


@query("role_counts", f"""
WITH {POSTINGS}, o AS (SELECT title, CASE WHEN workplace = 'remote' THEN list_append(areas, 'remote') ELSE areas END AS places FROM postings WHERE NOT closed), u AS (SELECT title, unnest(places) AS place FROM o)
SELECT 'role' AS kind, title AS role, CAST(NULL AS VARCHAR) AS place, count(*) AS n FROM o GROUP BY title UNION ALL
SELECT 'place', NULL, place, count(*) FROM u GROUP BY place UNION ALL SELECT 'role_place', title, place, count(*) FROM u GROUP BY title, place""")
def role_counts(spark, sf_dir):
    return demand.role_counts(postings(spark, sf_dir))


@query("search_opportunities", """
WITH r AS (SELECT event_type AS intent, 'q' || event_id % 25 AS query, CAST(json_extract(props, '$.k') AS INTEGER) AS page, CAST(floor(value) AS BIGINT) % 5 AS clicks, CAST(floor(value) AS BIGINT) AS impressions, 1 + event_id % 40 AS position FROM events),
t AS (SELECT intent, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, CASE WHEN sum(impressions) > 0 THEN round_even(CAST(sum(position * impressions) AS DOUBLE) / CAST(sum(impressions) AS DOUBLE), 2) ELSE 0.0 END AS position FROM r GROUP BY 1),
q AS (SELECT intent, query, CAST(sum(clicks) AS BIGINT) AS c, CAST(sum(impressions) AS BIGINT) AS i FROM r GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY intent ORDER BY i DESC, query) <= 10),
p AS (SELECT intent, page, CAST(sum(impressions) AS BIGINT) AS i FROM r GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY intent ORDER BY i DESC, page) <= 3),
qs AS (SELECT intent, string_agg(query || ':' || c || ':' || i, ',' ORDER BY i DESC, query) AS queries FROM q GROUP BY 1), ps AS (SELECT intent, string_agg(page || ':' || i, ',' ORDER BY i DESC, page) AS pages FROM p GROUP BY 1)
SELECT * FROM t JOIN qs USING (intent) JOIN ps USING (intent)""")
def search_opportunities(spark, sf_dir):
    n = F.floor("value").cast("long")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("intent"), F.concat(F.lit("q"), (F.col("event_id") % 25).cast("string")).alias("query"), F.get_json_object("props", "$.k").cast("int").alias("page"), (n % 5).alias("clicks"), n.alias("impressions"), (1 + F.col("event_id") % 40).alias("position"))
    out = demand.opportunities(rows)
    line = lambda col, parts: F.array_join(F.transform(col, lambda x: F.concat_ws(":", *(x[p].cast("string") for p in parts))), ",").alias(col)
    return out.select("intent", "clicks", "impressions", "position", line("queries", ["query", "clicks", "impressions"]), line("pages", ["page", "impressions"]))
