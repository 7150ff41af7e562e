"""Queries of gates, pointers, updates and small functions, with the DuckDB SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, html, names, times
from ..operators import gates, intent, links
from ..sources.tables import AS_OF, dealt, postings, table
from .catalogue import POSTINGS, query

_NOW = f"TIMESTAMP '{AS_OF}'"
_EXTRA = f"""
WITH {POSTINGS}, wide AS (
  SELECT *, (['success','failed','queued'])[id % 3 + 1] AS status, CASE WHEN id % 8 = 0 THEN id - 1 END AS "primary", CASE WHEN id % 5 = 0 THEN found_at END AS closed_at,
    CASE WHEN id % 10 = 3 THEN NULL WHEN id % 6 = 1 THEN 'CA' ELSE 'US' END AS country, CASE WHEN id % 17 = 0 THEN found_at END AS flagged_at, CASE WHEN id % 4 <> 0 THEN id % 4 END AS source,
    CASE WHEN id % 2 = 0 THEN found_at + to_hours(CAST(id % 900 AS INTEGER)) END AS next_retry_at, [area || ', ' || sector, 'Remote ' || (id % 3)] AS locations FROM postings)"""


def _wide(spark, sf_dir) -> DataFrame:
    k = F.col("id")
    return postings(spark, sf_dir).select(
        "*", F.element_at(F.array(*map(F.lit, ("success", "failed", "queued"))), (k % 3 + 1).cast("int")).alias("status"), F.when(k % 8 == 0, k - 1).alias("primary"), F.when(k % 5 == 0, F.col("found_at")).alias("closed_at"),
        F.when(k % 10 == 3, None).when(k % 6 == 1, "CA").otherwise("US").alias("country"), F.when(k % 17 == 0, F.col("found_at")).alias("flagged_at"), F.when(k % 4 != 0, k % 4).alias("source"),
        F.when(k % 2 == 0, F.col("found_at") + F.make_dt_interval(F.lit(0), (k % 900).cast("int"))).alias("next_retry_at"),
        F.array(F.concat("area", F.lit(", "), "sector"), F.concat(F.lit("Remote "), (k % 3).cast("string"))).alias("locations"),
    )


def _gate(name: str, sql: str, condition) -> None:
    query(name, f"{_EXTRA} SELECT id FROM wide WHERE {sql}")(lambda spark, sf_dir: _wide(spark, sf_dir).where(condition()).select("id"))


_gate("canonical_jobs", "status = 'success' AND title IS NOT NULL AND \"primary\" IS NULL AND closed_at IS NULL", gates.canonical)
_gate("live_pages", f"""status = 'success' AND title IS NOT NULL AND "primary" IS NULL AND country = 'US' AND flagged_at IS NULL AND (posted_at >= CAST({_NOW} AS DATE) - 60
  OR (posted_at IS NULL AND found_at >= {_NOW} - INTERVAL 60 day) OR (source IS NOT NULL AND last_seen_at >= {_NOW} - INTERVAL 14 day))""", lambda: gates.live_page(AS_OF))
_gate("retries_due", f"status = 'failed' AND next_retry_at <= {_NOW} AND closed_at IS NULL", lambda: gates.retry_due(AS_OF))
_gate("sectors_wanted", "country IS NULL OR country = 'US' OR workplace = 'remote'", gates.sector_wanted)
_gate("located_by_text", "len([x FOR x IN locations IF contains(lower(x), 'furn')]) > 0", lambda: gates.located("Furn", {}, {}))
_gate("located_in_state", "list_contains(areas, 'R2') OR list_contains(areas, 'CHINA') OR len([x FOR x IN locations IF contains(lower(x), 'asia')]) > 0", lambda: gates.located("Asia", {}, {"asia": ["R2", "CHINA"]}))
_gate("located_by_label", "list_contains(areas, 'R1')", lambda: gates.located("Americas (metro area)", {"americas (metro area)": "R1"}, {}))
_gate("located_in_country", "country = 'US' OR len(areas) > 0 OR len([x FOR x IN locations IF contains(lower(x), 'usa')]) > 0", lambda: gates.located("USA", {}, {}))


@query("metro_slugs", f"WITH {POSTINGS} SELECT count(*) FILTER (list_contains(areas, 'R1')) AS known, CAST(0 AS BIGINT) AS unknown FROM postings")
def metro_slugs(spark, sf_dir):
    areas = {"americas": "R1"}
    return postings(spark, sf_dir).agg(F.count_if(gates.in_metro("americas", areas)).alias("known"), F.count_if(gates.in_metro("nowhere", areas)).alias("unknown"))



_NAMES = {"category": {"building": "BUILDING"}, "role": {"urgent": "1-URGENT"}, "location": {"asia": "R2"}}
_MONEY = "coalesce(salary_min, salary_max) BETWEEN {} AND 2000000 AND (salary_currency IS NULL OR salary_currency = 'USD')"
_DAY = f"CAST(timezone('America/New_York', timezone('UTC', {_NOW})) AS DATE)"
_EAST = "CAST(timezone('America/New_York', timezone('UTC', {})) AS DATE)"
_DIMENSIONS = [
    ("category", "building", "sector = 'BUILDING'"), ("role", "urgent", "title = '1-URGENT'"), ("location", "asia", "list_contains(areas, 'R2')"), ("location", "remote", "workplace = 'remote'"), ("salary", "100k-plus", _MONEY.format(100_000)),
    ("salary", "200k-plus", _MONEY.format(200_000)), ("freshness", "posted-today", f"posted_at = {_DAY}"), ("freshness", "posted-this-week", f"posted_at BETWEEN {_DAY} - 6 AND {_DAY}"), ("freshness", "found-today", f"{_EAST.format('found_at')} = {_DAY}"),
    ("freshness", "found-this-week", f"{_EAST.format('found_at')} BETWEEN {_DAY} - 6 AND {_DAY}"), ("freshness", "verified-today", f"{_EAST.format('last_seen_at')} = {_DAY}"),
]


@query("dimension_counts", f"WITH {POSTINGS} " + " UNION ALL ".join(f"SELECT '{k}' AS kind, '{s}' AS slug, count(*) FILTER ({c}) AS n FROM postings" for k, s, c in _DIMENSIONS))
def dimension_counts(spark, sf_dir):
    told = [F.struct(F.lit(k).alias("kind"), F.lit(s).alias("slug"), F.count_if(gates.dimension(k, s, AS_OF, _NAMES)).alias("n")) for k, s, _ in _DIMENSIONS]
    return postings(spark, sf_dir).agg(F.array(*told).alias("x")).select(F.explode("x").alias("x")).select("x.*")  # one pass for all


@query("collection_jobs", f"WITH {POSTINGS} SELECT id FROM postings WHERE sector = 'BUILDING' AND title = '1-URGENT' AND {_MONEY.format(75_000)}")
def collection_jobs(spark, sf_dir):
    return postings(spark, sf_dir).where(gates.collection({"category": "building", "role": "urgent", "salary": "75k-plus"}, AS_OF, _NAMES)).select("id")


@query("follow_ups_due", """
SELECT o_orderkey AS id FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1998-01-01' AND o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 1 AND o_orderstatus NOT IN ('F')""")
def follow_ups_due(spark, sf_dir):
    k = F.col("id")
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("follow_up_at"), F.col("o_orderstatus").alias("status"))
    df = df.withColumn("reminded_at", F.when(k % 3 == 0, F.col("follow_up_at"))).withColumn("archived", k % 4 == 1)
    return df.where(gates.follow_up_due("1998-01-01", ["F"])).select("id")


@query("logos_due", f"""
WITH c AS (SELECT c_custkey AS id, (['ok','error','none',NULL])[c_custkey % 4 + 1] AS s, {_NOW} - to_days(CAST(c_custkey * 7 % 200 AS INTEGER)) AS seen FROM customer)
SELECT id FROM c WHERE s IS NULL OR (s = 'ok' AND seen < {_NOW} - INTERVAL 90 day) OR (s = 'error' AND seen < {_NOW} - INTERVAL 1 day) OR (s = 'none' AND seen < {_NOW} - INTERVAL 30 day)""")
def logos_due(spark, sf_dir):
    k = F.col("c_custkey")
    status = F.element_at(F.array(F.lit("ok"), F.lit("error"), F.lit("none"), F.lit(None).cast("string")), (k % 4 + 1).cast("int"))
    checked = F.lit(AS_OF).cast("timestamp") - F.make_dt_interval((k * 7 % 200).cast("int"))
    return table(spark, sf_dir, "customer").select(k.alias("id"), status.alias("logo_status"), checked.alias("logo_checked_at")).where(gates.logo_due(AS_OF)).select("id")


@query("rows_among_pairs", "SELECT o_orderkey AS id FROM orders WHERE (o_orderstatus, o_orderpriority) IN (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders WHERE o_totalprice > 499900)")
def rows_among_pairs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return gates.among(orders, orders.where("o_totalprice > 499900"), ["o_orderstatus", "o_orderpriority"]).select(F.col("o_orderkey").alias("id"))


# Pointers, gaps and updates


@query("newest_results", """
WITH n AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderpriority AS p FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN -1 ELSE a.id END AS score, b.id AS letter FROM customer LEFT JOIN n a ON a.k = c_custkey AND a.p = '1-URGENT' LEFT JOIN n b ON b.k = c_custkey AND b.p = '5-LOW'""")
def newest_results(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), "o_orderpriority")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.lit(-1).cast("long")).alias("score"), F.lit(None).cast("long").alias("letter"))
    of = lambda p: (orders.where(F.col("o_orderpriority") == p).drop("o_orderpriority"), ["c_custkey"])
    return links.point_to_newest(rows, {"score": of("1-URGENT"), "letter": of("5-LOW")})


@query("keyed_updates", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'new' || s_suppkey WHEN s_suppkey % 4 = 2 THEN NULL ELSE s_name END AS name FROM supplier")
def keyed_updates(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    changes = df.where("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, F.concat(F.lit("new"), F.col("id").cast("string"))).alias("name"))
    return links.keyed_update(df, changes, ["id"])


@query("official_takeover", """
WITH p AS (SELECT o_custkey AS g, o_orderkey AS id, o_orderkey % 3 = 0 AS official, o_orderdate AS made, o_orderkey % 4 = 0 AS arrived FROM orders),
l AS (SELECT * FROM p WHERE NOT arrived QUALIFY row_number() OVER (PARTITION BY g ORDER BY made, id) = 1), a AS (SELECT * FROM p WHERE arrived),
n AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY g ORDER BY official DESC, made, id) = 1),
h AS (SELECT n.g, CASE WHEN l.id IS NULL OR (NOT l.official AND n.official) THEN n.id ELSE l.id END AS head FROM n LEFT JOIN l USING (g))
SELECT id, nullif(head, id) AS "primary" FROM (SELECT g, id FROM a UNION ALL SELECT g, id FROM l) JOIN h USING (g)""")
def official_takeover(spark, sf_dir):
    k = F.col("id")
    df = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3 == 0).alias("official"), F.col("o_orderdate").alias("created_at"))
    old = df.where(k % 4 != 0).groupBy("g").agg(F.min(F.struct("created_at", "id", "official")).alias("x")).select("g", "x.id", "x.official", "x.created_at")
    return links.takeover(old, df.where(k % 4 == 0), ["g"])


@query("uncovered_companies", """
WITH k AS (SELECT c_custkey AS id, c_mktsegment AS m, lower(c_name) AS key FROM customer) SELECT id FROM k WHERE key NOT IN (SELECT key FROM k WHERE m = 'BUILDING')""")
def uncovered_companies(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_mktsegment")
    return links.uncovered(df, df.where("c_mktsegment = 'BUILDING'"), F.lower("c_name")).select("id")


@query("companies_without_site", """
SELECT o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 2 = 0 LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey > 2
WHERE n_nationkey IS NULL OR r_regionkey IS NULL""")
def companies_without_site(spark, sf_dir):
    orders, customer, nation, region = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    df = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation.where("n_nationkey % 2 = 0"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return df.join(region.where("r_regionkey > 2"), F.col("n_regionkey") == F.col("r_regionkey"), "left").where("n_nationkey IS NULL OR r_regionkey IS NULL").select(F.col("o_orderkey").alias("id"))


@query("source_domains", "SELECT DISTINCT c_nationkey AS source, c_mktsegment AS domain FROM customer JOIN orders ON o_custkey = c_custkey")
def source_domains(spark, sf_dir):
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.col("c_nationkey").alias("source"), F.col("c_mktsegment").alias("domain")).distinct()


@query("copies_per_company", "SELECT c_custkey AS id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS n FROM customer")
def copies_per_company(spark, sf_dir):
    n = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


# Small aggregates


@query("companies_of_source", "SELECT c_nationkey AS source, c_mktsegment AS company, count(*) AS n, max(c_name) AS shown FROM customer GROUP BY 1, 2 ORDER BY n DESC, source, company LIMIT 50")
def companies_of_source(spark, sf_dir):
    out = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("source"), F.col("c_mktsegment").alias("company")).agg(F.count("*").alias("n"), F.max("c_name").alias("shown"))
    return out.orderBy(F.desc("n"), "source", "company").limit(50)


@query("latest_days", "SELECT event_type, CAST(max(ts) AS DATE) AS day FROM events GROUP BY 1")
def latest_days(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.to_date(F.max("ts")).alias("day"))


@query("users_over_limit", "SELECT user_id, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL 86400 second AND ts <= TIMESTAMP '2024-01-31' GROUP BY 1 HAVING count(*) > 1")
def users_over_limit(spark, sf_dir):
    return links.over_limit(table(spark, sf_dir, "events"), "user_id", "ts", "2024-01-31 00:00:00", 86_400, 1)


@query("sampled_rows", "SELECT o_orderkey AS id FROM orders ORDER BY md5('s7' || o_orderkey), o_orderkey LIMIT 40")
def sampled_rows(spark, sf_dir):
    return links.sample_rows(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), "id", 40, "s7")


@query("nearest_first", """
WITH d AS (SELECT s_suppkey AS id, 2 * 3958.8 * asin(sqrt(least(1.0, pow(sin(radians(40.0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(40.0)) * pow(sin(radians(-90.0 - lon) / 2), 2)))) AS miles
  FROM (SELECT s_suppkey, 40 + s_suppkey % 30 / 100.0 AS lat, -90 + s_suppkey % 7 / 50.0 AS lon FROM supplier))
SELECT id, CASE WHEN miles < 0.5 THEN 0 WHEN miles <= 5 THEN 1 WHEN miles <= 15 THEN 2 ELSE 3 END AS band FROM d ORDER BY band, id DESC LIMIT 25""")
def nearest_first(spark, sf_dir):
    k = F.col("s_suppkey")
    miles = geo.haversine(40 + k % 30 / 100.0, -90 + k % 7 / 50.0, F.lit(40.0), F.lit(-90.0))
    return table(spark, sf_dir, "supplier").select(k.alias("id"), geo.band(miles).alias("band")).orderBy("band", F.desc("id")).limit(25)


@query("place_suggestions", """
WITH p AS (SELECT p_name AS name, (['country','state','city'])[p_partkey % 3 + 1] AS kind, max(p_partkey * 31 % 10007) AS population FROM part GROUP BY 1, 2),
t AS (SELECT *, CASE WHEN starts_with(lower(name), 'r') THEN 0 WHEN contains(lower(name), ' r') THEN 1 END AS tier FROM p)
SELECT name, kind, tier FROM t WHERE tier IS NOT NULL ORDER BY tier, list_position(['country','state','city'], kind), population DESC, name LIMIT 20""")
def place_suggestions(spark, sf_dir):
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("country", "state", "city"))), (k % 3 + 1).cast("int"))
    df = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name"), kind.alias("kind")).agg(F.max(k * 31 % 10007).alias("population"))
    return links.suggest_places(df, "r", 20).select("name", "kind", "tier")


# Arrays, maps, dates and names


@query("ordered_unions", "SELECT p_partkey AS id, array_to_string([x FOR x, i IN a IF list_position(a, x) = i], ',') AS items FROM (SELECT p_partkey, [p_brand, p_type, p_name] || [p_type, 'x', p_brand] AS a FROM part)")
def ordered_unions(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(links.ordered_union(F.array("p_brand", "p_type", "p_name"), F.array(F.col("p_type"), F.lit("x"), F.col("p_brand"))), ",").alias("items"))


@query("merged_maps", "SELECT p_partkey AS id, p_brand AS a, CASE WHEN p_partkey % 2 = 0 THEN 'new' ELSE p_type END AS b FROM part")
def merged_maps(spark, sf_dir):
    first = F.create_map(F.lit("a"), F.col("p_brand"), F.lit("b"), F.col("p_type"))
    second = F.map_filter(F.create_map(F.lit("b"), F.lit("new")), lambda k, v: F.col("p_partkey") % 2 == 0)
    m = links.merged_maps(first, second)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), m["a"].alias("a"), m["b"].alias("b"))


@query("rounded_places", "SELECT s_suppkey AS id, printf('%.4f', round_even(s_suppkey / 7.0, 4)) || ',' || printf('%.4f', round_even(-s_suppkey / 3.0, 4)) AS places FROM supplier")
def rounded_places(spark, sf_dir):
    k = F.col("s_suppkey")
    p = F.struct((k / 7.0).alias("lat"), (-k / 3.0).alias("lon"))
    return table(spark, sf_dir, "supplier").select(k.alias("id"), F.array_join(links.rounded_places(F.array(p, p)), ";").alias("places"))


@query("turns_in_order", "SELECT conv_id, string_agg(role, ',' ORDER BY turn, role) AS roles FROM conversations GROUP BY 1")
def turns_in_order(spark, sf_dir):
    return links.in_order(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role").select("conv_id", F.array_join("values", ",").alias("roles"))


# Dates as pages write them: a day, a day that isn't one, instants with and without a zone, words, American days, numbers that are no day.
_JAVA = ["yyyy-MM-dd", "yyyy-'02-30'", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss'-05:00'", "'posted in 'MMMM", "MM/dd/yyyy", "M-d-yyyy", "'13/40/'yyyy"]


@query("parsed_dates", """
WITH d AS (SELECT event_id AS id, CASE WHEN event_id % 8 IN (0, 2) THEN CAST(ts AS DATE) WHEN event_id % 8 = 3 THEN CAST(ts + INTERVAL 5 hour AS DATE) END AS iso, CASE WHEN event_id % 8 IN (5, 6) THEN CAST(ts AS DATE) END AS mdy FROM events)
SELECT *, coalesce(iso BETWEEN DATE '2024-01-15' - 5 AND DATE '2024-01-15', false) AS recent FROM d""")
def parsed_dates(spark, sf_dir):
    text = F.get(F.array(*[F.date_format("ts", f) for f in _JAVA]), (F.col("event_id") % 8).cast("int"))
    iso = times.tolerant_date(text)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), iso.alias("iso"), times.month_day_year(text).alias("mdy"), F.coalesce(times.is_recent(iso, "2024-01-15", 6), F.lit(False)).alias("recent"))


@query("months_before", "SELECT o_orderkey AS id, CAST(date_trunc('month', o_orderdate) - INTERVAL 14 month AS DATE) AS month FROM orders")
def months_before(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), times.months_back(F.to_date("o_orderdate"), 14).alias("month"))


@query("jittered_intervals", "SELECT s_suppkey AS id, round_even(600 * (1 + 0.1 * (2 * (CAST('0x' || substr(md5(CAST(s_suppkey AS VARCHAR)), 1, 8) AS BIGINT) / 4294967295.0) - 1)), 3) AS minutes FROM supplier")
def jittered_intervals(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), times.jittered(F.lit(600.0), F.col("s_suppkey")).alias("minutes"))


@query("companies_shown", """
WITH c AS (SELECT c_custkey AS id, c_custkey % 5 AS form, replace(c_name, '#', ' ') AS n FROM customer)
SELECT id, CASE form WHEN 1 THEN '12-3456789 ' || n WHEN 3 THEN '12 ' || n WHEN 4 THEN n || ' / CityMD' ELSE n END AS company, CASE form WHEN 3 THEN '12 ' || n WHEN 4 THEN 'Careers' ELSE n END AS bare FROM c""")
def companies_shown(spark, sf_dir):
    n, k, form = F.translate("c_name", "#", " "), F.col("c_custkey"), (F.col("c_custkey") % 5).cast("int")
    after = lambda x: F.concat(n, F.lit(x))
    page = F.get(F.array(F.concat((k + 100).cast("string"), F.lit(" "), n), F.concat(F.lit("12-3456789 "), n), n, F.concat(F.lit("12 "), n), F.lit("Careers")), form)
    label = F.get(F.array(after(" (retail and home)"), F.concat(F.lit("lever/"), F.translate(n, " ", "")), after(" Group"), F.concat(F.lit("jobs."), F.translate(n, " ", ""), F.lit(".com")), after(" / CityMD")), form)
    people = dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")
    return people.select(k.alias("id"), names.company_shown(page, label).alias("company"), names.strip_entity_code(page).alias("bare"))


@query("microdata_postings", """
SELECT p_partkey AS id, p_name AS title, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type END AS company, p_brand || ', US' AS location, CASE WHEN p_partkey % 2 = 0 THEN '2024-03-01' END AS posted
FROM part""")
def microdata_postings(spark, sf_dir):
    k, c, t = F.col("p_partkey"), F.col, F.lit
    company = F.concat(t("<p itemprop='hiringOrganization' itemscope>by <b itemprop='name'> "), c("p_type"), t("</b></p>"))
    place = F.concat(t('<div itemprop="jobLocation" itemscope><br><div itemprop="address"><span itemprop="addressLocality">'), c("p_brand"), t('</span><meta itemprop="addressCountry" content="US"></div></div>'))
    page = F.concat(
        t('<h1 itemprop="title">Not here</h1><div itemscope itemtype="https://schema.org/JobPosting"><h1 itemprop="title">'), c("p_name"), t("</h1>"), F.when(k % 3 == 0, "").otherwise(company),
        place, F.when(k % 2 == 0, '<meta itemprop="datePosted" content="2024-03-01T10:00">').otherwise(""), t('</div><i itemprop="datePosted">2020-01-01</i>'),
    )
    parts = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand"), "p_partkey")
    return parts.select(k.alias("id"), html.ld_posting(page).alias("x")).select("id", "x.title", "x.company", "x.location", "x.posted")


@query("search_intents", """
WITH c AS (SELECT c_custkey AS id, c_custkey % 8 AS form, p_name, n_nationkey FROM customer JOIN part ON p_partkey = c_custkey JOIN nation ON n_nationkey = c_nationkey)
SELECT id, CASE WHEN form IN (0, 1) THEN 'role' WHEN form = 2 THEN 'company' WHEN form IN (3, 4) THEN 'location' ELSE 'other' END AS kind, CASE WHEN form IN (0, 1) THEN p_name END AS role,
  CASE WHEN form IN (0, 3) THEN 'place-' || n_nationkey WHEN form IN (1, 4) THEN 'remote' END AS location, CASE WHEN form = 2 THEN 'company-' || id END AS company FROM c""")
def search_intents(spark, sf_dir):
    people, parts, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part"), table(spark, sf_dir, "nation")
    rows = people.join(parts, F.col("p_partkey") == F.col("c_custkey")).join(nations, F.col("n_nationkey") == F.col("c_nationkey"))
    k, role, place, company = F.col("c_custkey"), F.col("p_name"), F.col("n_name"), F.col("c_name")
    text = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    phrases = F.array(text(F.initcap(role), "s jobs near ", place), text(role, " work from home"), text(company, " careers"), text("jobs in ", F.lower(place)), F.lit("Remote jobs"), text("best r\u00e9sum\u00e9 tips ", k.cast("string")), text("remote ", company), F.lit(None).cast("string"))
    titles = parts.select(role.alias("name"), role.alias("role")).distinct()
    places = nations.select(place.alias("name"), text("place-", F.col("n_nationkey").cast("string")).alias("location"))
    companies = people.select(company.alias("name"), text("company-", k.cast("string")).alias("company"))
    out = intent.search_intents(rows.select(k.alias("id"), F.get(phrases, (k % 8).cast("int")).alias("phrase")), titles, places, companies)
    return out.select("id", "kind", "role", "location", "company")
