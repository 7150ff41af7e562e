"""Queries of what is shown, of curated names and of pages' markup, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import markup, shown
from ..operators import curation, scan, search
from ..sources.tables import postings, table
from .catalogue import POSTINGS, query

_SLUG = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '-')"


@query("masked_postings", f"""
WITH {POSTINGS} SELECT id, CAST(NULL AS VARCHAR) AS url, title, CAST(NULL AS TIMESTAMP) IS NOT NULL AS flagged, id % 3 <> 0 AS has_url,
  'jobs/us/' || {_SLUG("sector")} || '/' || CAST(CAST(listed_at AS DATE) AS VARCHAR) || '/' || {_SLUG("title")} || '-' || {_SLUG("area")} || '-' || id AS path FROM postings""")
def masked_postings(spark, sf_dir):
    df = postings(spark, sf_dir)
    path = shown.job_path(F.col("title"), F.regexp_replace(F.lower("area"), "[^a-z0-9]+", "-"), F.col("id"), F.col("sector"), F.to_date("listed_at"))
    full = df.select("id", "title", F.when(F.col("id") % 3 != 0, F.concat(F.lit("https://x/"), F.col("id").cast("string"))).alias("url"), F.col("found_at").alias("flagged_at"), path.alias("path"))
    out = shown.masked(full, signed_in=False, admin=False)
    return out.select("id", "url", "title", F.col("flagged_at").isNotNull().alias("flagged"), "has_url", "path")


@query("scan_states", """
SELECT o_orderkey AS id, o_orderkey % 4 = 1 AS incomplete, o_orderkey % 4 <> 1 AS others, o_orderstatus = 'O' OR (o_orderstatus <> 'F' AND o_orderkey % 4 = 2) AS expired, left(o_orderpriority, 4) AS fitted FROM orders""")
def scan_states(spark, sf_dir):
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    error = F.when(k % 4 == 1, F.concat(F.lit(shown.INCOMPLETE), "o_orderpriority")).when(k % 4 == 2, F.concat(F.lit(shown.GONE), F.lit("404"))).when(k % 4 == 3, "timed out")
    dirty = F.concat(F.substring("o_orderpriority", 1, 2), F.lit("\x00"), F.substring("o_orderpriority", 3, 100))
    return table(spark, sf_dir, "orders").select(k.alias("id"), shown.incomplete(error).alias("incomplete"), shown.incomplete(error, False).alias("others"), shown.expired(status == "F", status == "O", error).alias("expired"), shown.fitted(dirty, 4).alias("fitted"))


@query("places_with_types", f"""
WITH {POSTINGS}, c AS (SELECT id, area, workplace, sector FROM postings)
SELECT id, CASE id % 5 WHEN 0 THEN area WHEN 1 THEN area || '; ' || sector WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE area END AS place,
  CASE id % 5 WHEN 0 THEN workplace WHEN 1 THEN 'unknown' WHEN 2 THEN 'remote' WHEN 3 THEN 'unknown' ELSE 'hybrid' END AS workplace,
  (['full_time', 'part_time', 'contract', 'unknown', 'internship'])[id % 5 + 1] AS employment FROM (SELECT id, CASE WHEN workplace = 'unknown' THEN NULL ELSE area END AS area, workplace, sector FROM c WHERE workplace <> 'unknown' OR id % 5 IN (2, 3))""")
def places_with_types(spark, sf_dir):
    area, work, k = F.col("area"), F.col("workplace"), F.col("id")
    kept = postings(spark, sf_dir).where((work != "unknown") | (k % 5).isin(2, 3))
    bar = lambda a, b: F.concat(a, F.lit(" | "), b)
    other = F.when(work == "remote", "On-site").otherwise("Remote")
    said = F.array(bar(area, F.initcap(work)), F.concat(bar(area, work), F.lit(" ; "), bar(F.col("sector"), other)), F.lit("Remote"), F.concat(area, F.lit(" | apply now")), F.concat(bar(area, F.lit("hybrid")), F.lit(";"), bar(area, F.lit("HYBRID")), F.lit("; ")))
    kind = F.get(F.array(*map(F.lit, ("Full-time", "part time", "CONTRACTOR", "whenever", " intern "))), (k % 5).cast("int"))
    place, workplace = shown.place_and_workplace(F.get(said, (k % 5).cast("int")))
    return kept.select("id", place.alias("place"), workplace.alias("workplace"), shown.employment(kind).alias("employment"))


@query("event_extras", "SELECT event_id AS id, event_type IN ('click', 'view') AS known, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 2 END AS extras FROM events")
def event_extras(spark, sf_dir):
    fields = F.create_map(F.col("event_type"), F.col("value"), F.lit("k"), F.lit(1.0), F.lit("user"), F.col("user_id").cast("double"))
    rest = shown.extra(fields, ["click", "view", "user"])
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (~F.map_contains_key(rest, F.col("event_type"))).alias("known"), F.size(rest).alias("extras"))


@query("company_backfill", f"""
WITH {POSTINGS} SELECT company_key, max(company) AS display_name, CAST(count(DISTINCT (domain, sector)) AS BIGINT) AS sites FROM postings WHERE CAST(company_key AS BIGINT) % 3 <> 0 GROUP BY 1""")
def company_backfill(spark, sf_dir):
    df = postings(spark, sf_dir).withColumn("source", F.col("sector"))
    known = table(spark, sf_dir, "customer").where(F.col("c_custkey") % 3 == 0).select(F.col("c_custkey").cast("string").alias("company_key"))
    sites = curation.site_combinations(df).groupBy("company_key").agg(F.count("*").alias("sites"))
    return curation.company_names(df, known).join(sites, "company_key")


@query("spaced_names", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS name FROM part")
def spaced_names(spark, sf_dir):
    joined = F.replace(F.col("p_name"), F.lit(" "), F.lit(""))
    name = F.when(F.col("p_partkey") % 3 == 0, F.initcap(joined)).when(F.col("p_partkey") % 3 == 1, F.upper(joined)).otherwise(F.initcap("p_name"))
    pages = F.array(F.lit("Nobody Inc."), F.lit(None).cast("string"), F.concat(F.lit("The "), "p_name", F.lit(", Inc.")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), shown.unsquashed(name, pages).alias("name"))


@query("source_names", f"""
WITH {POSTINGS}, c AS (SELECT domain AS source, company, count(*) AS n FROM (SELECT domain, CASE WHEN id % 10 < 7 THEN 'Acme ' || domain ELSE replace(company, '#', ' ') END AS company FROM postings) GROUP BY 1, 2),
t AS (SELECT source, sum(n) AS total, max(n) FILTER (company = 'Acme ' || source) AS main FROM c GROUP BY 1)
SELECT source, CASE WHEN CAST(substr(source, 5) AS BIGINT) % 3 = 0 THEN 'fix' WHEN CAST(substr(source, 5) AS BIGINT) % 3 = 1 THEN 'fix' ELSE 'review' END AS kind, CASE WHEN CAST(substr(source, 5) AS BIGINT) % 3 = 1 THEN 'Site' ELSE 'Acme ' || source END AS name,
  CASE WHEN CAST(substr(source, 5) AS BIGINT) % 3 = 1 THEN NULL ELSE CAST(main AS DOUBLE) / total END AS share
FROM t WHERE CAST(substr(source, 5) AS BIGINT) % 3 = 1 OR (CAST(main AS DOUBLE) / total >= 0.6 AND (CAST(substr(source, 5) AS BIGINT) % 3 = 0 OR total >= 20))
UNION ALL SELECT source, 'brand', company, NULL FROM c WHERE n >= 10 AND (company NOT LIKE 'Acme %' OR CAST(substr(source, 5) AS BIGINT) % 3 <> 0)""")
def source_names(spark, sf_dir):
    """Sources by domain: some named by a slug that their address confirms, some with a note, some with a name that no posting has."""
    df = postings(spark, sf_dir).select(F.col("domain").alias("source"), F.when(F.col("id") % 10 < 7, F.concat(F.lit("Acme "), "domain")).otherwise(F.translate("company", "#", " ")).alias("company"))
    n = F.substring("source", 5, 10).cast("int")
    name = F.when(n % 3 == 0, F.concat(F.lit("lever/"), "source")).when(n % 3 == 1, "Site (retail)").otherwise("Bluebird")
    sources = df.select("source").distinct().select("source", name.alias("name"), F.lit("https://board.example/acme").alias("board"))
    return curation.proposals(sources, df)


@query("page_links", r"""
WITH a AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '<!--.*?-->', '', 'gs'), '(?s)<a href="[^"]*">.*?</a>')) AS x FROM pages)
SELECT page_id, regexp_extract(x, 'href="([^"]*)"', 1) AS href, CAST(count(*) AS BIGINT) AS n FROM a GROUP BY 1, 2""")
def page_links(spark, sf_dir):
    found = links_of(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(found).alias("l")).groupBy("page_id", F.col("l.href").alias("href")).agg(F.count("*").alias("n"))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("href", T.StringType()), T.StructField("text", T.StringType())])))
def links_of(col):
    return col.map(lambda page: [{"href": h, "text": t} for h, t in markup.links(page)])


@F.pandas_udf(T.StringType())
def advert(col):
    return col.map(lambda page: markup.section(page, "class", "ad"))


@query("page_sections", r"""SELECT page_id, nullif(regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1), '') AS advert FROM pages""")
def page_sections(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.nullif(advert("html"), F.lit("")).alias("advert"))


@query("page_lint", r"""
WITH p AS (SELECT page_id AS id, url, html, page_id % 4 <> 0 AS indexed, regexp_extract_all(html, '(?s)<title>(.*?)</title>', 1) AS titles, len(regexp_extract_all(html, '<h1[ >]')) AS h1 FROM pages),
t AS (SELECT *, trim(replace(replace(replace(titles[1], '&amp;', '&'), '&lt;', '<'), '&gt;', '>')) AS title FROM p)
SELECT id, 'title' AS issue FROM t WHERE len(titles) <> 1 OR title = '' UNION ALL SELECT id, 'title_length' FROM t WHERE len(titles) = 1 AND length(title) > 60 UNION ALL SELECT id, 'description' FROM t UNION ALL SELECT id, 'canonical' FROM t
UNION ALL SELECT id, 'h1' FROM t WHERE h1 <> 1 UNION ALL SELECT id, 'robots' FROM t
UNION ALL SELECT id, 'duplicate_title' FROM (SELECT id, min(id) OVER (PARTITION BY title) AS least FROM t WHERE indexed AND title IS NOT NULL) WHERE id <> least""")
def page_lint(spark, sf_dir):
    return curation.page_issues(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", "html", (F.col("page_id") % 4 != 0).alias("indexed")))


_SCANNED = """
jobs AS (SELECT o_orderkey AS id, o_orderkey % 5 AS form, o_orderpriority AS title, 'Customer ' || o_custkey AS company, CAST(floor(o_totalprice / 10) AS BIGINT) + 20000 AS low, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders)"""


@query("scanned_pages", f"""
WITH {_SCANNED}, s AS (SELECT *, form = 0 AND day < '1998-01-01' AS over FROM jobs)
SELECT id, CASE WHEN over THEN 'expired' WHEN form = 4 THEN 'empty' ELSE 'ok' END AS status, CASE WHEN over OR form = 4 THEN NULL ELSE title END AS title, CASE WHEN NOT over AND form <> 3 AND form <> 4 THEN company END AS company,
  CASE WHEN NOT over AND form IN (0, 1) THEN 'Ely, GB' WHEN form = 2 THEN 'Ely' END AS location, CASE WHEN over THEN NULL WHEN form = 0 THEN 'onsite' WHEN form IN (1, 2) THEN 'hybrid' ELSE 'unknown' END AS workplace,
  CASE WHEN over THEN NULL WHEN form = 0 THEN 'full_time' ELSE 'unknown' END AS employment, CASE WHEN NOT over AND form IN (0, 1, 3) THEN low::DOUBLE END AS salary_min, CASE WHEN NOT over AND form IN (0, 1, 3) THEN low + 5000::DOUBLE END AS salary_max,
  CASE WHEN over THEN NULL WHEN form = 0 THEN 'EUR' WHEN form IN (1, 3) THEN 'USD' END AS salary_currency, CASE WHEN NOT over AND form IN (0, 1) THEN day END AS posted, CASE WHEN over THEN NULL WHEN form IN (0, 1) THEN 'json-ld' WHEN form = 2 THEN 'open graph' WHEN form = 3 THEN 'title' END AS told_by FROM s""")
def scanned_pages(spark, sf_dir):
    k, text, t = F.col("o_orderkey"), lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs]), F.col("o_orderpriority")
    company, low, day = text("Customer ", F.col("o_custkey").cast("string")), F.floor(F.col("o_totalprice") / 10) + 20_000, F.to_date("o_orderdate").cast("string")
    say = lambda x: F.format_number(x, 0)
    ld = lambda more: text('<title>Wrong</title><script type="application/ld+json">{"@type": "JobPosting", "title": "', t, '", "hiringOrganization": {"name": "', company, '"}, "jobLocation": {"address": {"addressLocality": "Ely", "addressRegion": "UNAVAILABLE", "addressCountry": {"name": "GB"}}}, "datePosted": "', day, 'T09:00", ', more, "}</script>")
    pages = F.array(
        ld(text('"employmentType": ["Full-time"], "baseSalary": {"currency": "EUR", "value": {"minValue": ', low.cast("string"), ', "maxValue": ', (low + 5000).cast("string"), '}}, "validThrough": "', day, '"')),
        ld(text('"jobLocationType": "TELECOMMUTE", "description": "<p>Pay of $', say(low), " to $", say(low + 5000), '</p>"')),
        text('<title>Wrong</title><meta property="og:title" content="', t, '"><meta content="Ely | Hybrid" property="og:description"><meta property="og:site_name" content=" ', company, ' ">'),
        text("<title> ", t, ' </title><meta name="description" content="Pay of $', say(low), " - $", say(low + 5000), '">'), F.lit("<p>Nothing to see</p>"),
    )
    out = scan.scan_pages(table(spark, sf_dir, "orders").select(k.alias("id"), F.get(pages, (k % 5).cast("int")).alias("html")), "1998-01-01")
    return out.drop("description")


@query("sorted_pages", f"""
WITH {POSTINGS}, a AS (SELECT 'company' AS by_, id FROM postings ORDER BY company ASC NULLS LAST, found_at DESC, id LIMIT 30 OFFSET 60), b AS (SELECT 'salary' AS by_, id FROM postings ORDER BY salary_max DESC NULLS FIRST, found_at DESC, id LIMIT 30 OFFSET 60)
SELECT by_ AS sorted_by, id FROM a UNION ALL SELECT by_, id FROM b""")
def sorted_pages(spark, sf_dir):
    df = postings(spark, sf_dir)
    one = lambda by, down: search.sorted_page(df, by, down, 30, 60).select(F.lit(by).alias("sorted_by"), "id")
    return one("company", False).union(one("salary", True))
