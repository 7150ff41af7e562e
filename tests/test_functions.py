from __future__ import annotations

import time

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessella.functions import geo, html, markup, names, pay, text, times, urls


def values(spark, cases, column):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, x string")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_company_key(spark):
    cases = {"Acme Inc.": "acme", "acme, llc": "acme", " Acme   Group  Ltd. ": "acme group", "Company": None, "": None, None: None, "Incident Co": "incident", "L.L.C": None, "Disco": "disco"}
    assert values(spark, cases, text.company_key) == list(cases.values())


def test_title_key(spark):
    cases = {"Senior Engineer (Remote) - C++": "senior engineer remote c", "Développeur / Été": "développeur été", "!!!": None, None: None}
    assert values(spark, cases, text.title_key) == list(cases.values())


def test_slug(spark):
    cases = {"Café Zürich & Söhne": "cafe-zurich-sohne", "--A  b--": "a-b", "☃": "", None: ""}
    assert values(spark, cases, text.slug) == list(cases.values())
    assert values(spark, ["alpha beta gamma", "abcdefghijkl", "alpha beta"], lambda x: text.slug(x, 10)) == ["alpha-beta", "abcdefghij", "alpha-beta"]


def test_split_locations(spark):
    cases = ["Paris; London|paris ; ; Rome...", None, "", "a" * 300, ";".join(str(i) for i in range(150))]
    got = values(spark, cases, text.split_locations)
    assert got[:3] == [["Paris", "London"], [], []] and len(got[3][0]) == 255 and len(got[4]) == 100


def test_query_terms():
    assert text.query_terms("data  engineer -senior - -x") == (["data", "engineer", "-"], ["senior", "x"])
    assert text.query_terms("-a1 ") == ([], ["a1"])


def test_prefer_and_salary_label(spark):
    df = spark.sql("SELECT * FROM VALUES ('unknown', 'remote', 1000, 2000), (NULL, 'hybrid', NULL, 5), ('onsite', 'x', NULL, NULL) AS t(a, b, lo, hi)")
    rows = df.select(text.prefer(F.col("a"), F.col("b")).alias("p"), text.salary_label(F.col("lo"), F.col("hi"), F.lit(None).cast("string")).alias("s")).collect()
    assert [(r.p, r.s) for r in rows] == [("remote", "USD 1,000 - 2,000"), ("hybrid", "USD 5"), ("onsite", None)]


def test_urls(spark):
    cases = {
        "HTTPS://Ex.com/A/b/?utm_source=1&z=2&a=&ref=x#top": "https://ex.com/A/b?a=&z=2",
        "http://ex.com": "http://ex.com/", "http://ex.com:80//": "http://ex.com:80/", "http://ex.com/?gclid=1": "http://ex.com/", "no url": "no url", None: None,
        "http://e.com/p?b&a=1&a=0": "http://e.com/p?a=0&a=1&b=",
    }
    assert values(spark, cases, urls.normalize_url) == list(cases.values())
    assert values(spark, ["http://a.b/x/", "http://a.b", "http://c.d/x"], lambda x: urls.page_path(x, "a.b")) == ["/x", "/", None]


def test_times(spark):
    spark_ts = lambda s: F.lit(s).cast("timestamp")
    r = spark.range(1).select(
        times.day_start_utc(F.lit("2024-03-10"), times.EASTERN).alias("spring"),
        times.listed_at(F.lit(dt.date(2024, 1, 1)), spark_ts("2024-01-02 05:00:00")).alias("a"),
        times.listed_at(F.lit(dt.date(2024, 1, 2)), spark_ts("2024-01-02 05:00:00")).alias("b"),
        times.job_day(F.lit(None).cast("date"), spark_ts("2024-01-02 03:00:00")).alias("day"),
        times.age_weeks(spark_ts("2024-03-12 12:00:00"), spark_ts("2024-03-05 13:00:00")).alias("weeks"),
    ).first()
    assert (r.spring.hour, r.a.hour, r.a.day, r.b.hour, str(r.day), r.weeks) == (5, 0, 1, 5, "2024-01-01", 1)


def test_geo(spark):
    point = lambda lat, lon: F.struct(F.lit(lat).alias("lat"), F.lit(lon).alias("lon"))
    r = spark.range(1).select(
        geo.haversine(F.lit(40.7128), F.lit(-74.006), F.lit(34.0522), F.lit(-118.2437)).alias("d"),
        geo.nearest_point(F.array(point(0.0, 0.0), point(1.0, 1.0)), F.lit(1.0), F.lit(1.1)).alias("near"),
        geo.nearest_point(F.array().cast("array<struct<lat:double,lon:double>>"), F.lit(1.0), F.lit(1.1)).alias("none"),
        *(geo.band(F.lit(x)).alias(f"b{i}") for i, x in enumerate((0.49, 0.5, 5.0, 15.0, 15.1))),
    ).first()
    assert r.d == pytest.approx(2445.7, abs=2) and r.near == pytest.approx(6.9, abs=0.1) and r.none is None
    assert [r[f"b{i}"] for i in range(5)] == [0, 1, 1, 2, 3]


PAGE = """<!DOCTYPE html><html><head><title> A <b>job</b>
 here </title><meta content='short &amp; sweet' name="description"><style>x{}</style><script>var a = "<p>";</script>
<script type="application/ld+json">{"@graph": [{"@type": ["Thing", "JobPosting"], "title": "Cook", "hiringOrganization": {"name": "Diner"},
"jobLocation": [{"address": {"addressLocality": "Rome", "addressCountry": "IT"}}], "baseSalary": {"currency": "EUR", "value": {"minValue": 0, "maxValue": 30000}}, "datePosted": "2024-05-06T10:00"}]}</script></head>
<body><h2>About</h2><p>We &amp; you</p><ul><li>one</li><li><strong>two</strong></li></ul></body></html>"""


def test_html():
    out = html.markdown(PAGE)
    assert "We & you" in out and "- one" in out and "- **two**" in out and "var a" not in out and "x{}" not in out
    x = html.posting(PAGE)
    assert (x["title"], x["company"], x["location"], x["salary_min"], x["salary_max"], x["posted"]) == ("Cook", "Diner", "Rome, IT", None, 30000.0, "2024-05-06")
    assert html.posting("<script type='application/ld+json'>{broken</script>") == {} and html.posting(None) == {}


def test_html_columns(spark):
    df = spark.createDataFrame([(PAGE,), (None,), ("<p>x</p>",)], "page string")
    rows = df.select(html.meta(F.col("page"), "description").alias("d"), html.page_title(F.col("page")).alias("t"), html.ld_posting("page").alias("p"), html.html_to_text("page").alias("m"), html.unescaped("page").alias("u")).collect()
    assert rows[0].d == "short &amp; sweet" and rows[0].t == "A <b>job</b> here" and rows[0].p.title == "Cook"
    assert rows[1].d is None and rows[1].m is None and rows[2].m == "x" and rows[2].p.title is None


def test_salary():
    cases = {
        "Pay: $50,000 - $60,000 a year, up to $70k - $80k": (50_000, 80_000, "USD", "year"), "$20 per hour": (20, 20, "USD", "hour"), "$50-60k": (50_000, 60_000, "USD", None), "from $90k to $100k": (90_000, 100_000, "USD", None),
        "224,000 - 356,500 USD for Level 5, and 272,000 - 431,250 USD for Level 6": (224_000, 431_250, "USD", None), "Base Salary Range: $145k-$163k": (145_000, 163_000, "USD", None),
        "$103750 - $174750 annually + bonus": (103_750, 174_750, "USD", "year"), "€50,000 - €60,000 per year": (50_000, 60_000, "EUR", "year"), "USD 50,000 to 60,000": (50_000, 60_000, "USD", None),
        "base USD $124,000.00 - USD $329,200.00 /Yr.": (124_000, 329_200, "USD", "year"), "8-10 years, 26.25 - 29.75 USD hourly": (26, 30, "USD", "hour"), "$121, 720 - $143,200k": (121_720, 143_200, "USD", None),
        "**Salary Minimum**\n\n$92,000.00\n\n**Salary Maximum**\n\n$120,750.00\n\nmore": (92_000, 120_750, "USD", None), "Pay Range Minimum: USD 25.50 per hour. Pay Range Maximum: USD 32.00 per hour.": (26, 32, "USD", "hour"),
        "Minimum Salary: £40,000\nMaximum Salary: £52,000": (40_000, 52_000, "GBP", None), "Base pay min $85k, base pay max $110k": (85_000, 110_000, "USD", None), "Austin, TX, USA - 116,100.00 USD Annually": (116_100, 116_100, "USD", "year"),
    }
    nothing = ["$5 - $9,000,000", "no figure", None, "", "we raised $5 in 2020", "We need 8-10 years of experience", "Minimum of 3 years of experience. Maximum 10 direct reports.", "Minimum order $50. Maximum order $500.", "Salary Minimum: $92,000", "$0 - $0", "4 per year"]
    assert {k: pay.salary(k) for k in cases} == cases
    assert {pay.salary(k) for k in nothing} == {(None, None, None, None)}
    for unit in ("$1 - ", "minimum pay ", "USD ", "9", "1,000,", "$ 1, 000 ", "max salary $5 "):
        began = time.monotonic()
        pay.salary(unit * (500_000 // len(unit)))
        assert time.monotonic() - began < 20, unit


def test_completeness(spark):
    df = spark.createDataFrame([("x" * 300, None), ("x" * 299, None), ("y " * 200, ("y  " * 200).strip()), (None, None)], "t string, d string")
    assert [r.c for r in df.select(html.is_complete(F.col("t"), F.col("d")).alias("c")).collect()] == [True, False, False, False]


def test_display_company(spark):
    cases = {
        "Careers at Bluebird": "Bluebird", "Corporate Careers | Bluebird": "Bluebird", "Bluebird | A bank": "Bluebird", "bluebird.eightfold.ai": None, "careers.bluebird.com": None, "Careers": None,
        "Super.com": "Super.com", "Studio Helper | Careers | Two Rivers": "Two Rivers", "Bluebird External": "Bluebird", "J.P.Bird": "J.P.Bird", " | ": None, "": None, None: None,
    }
    assert values(spark, cases, names.display_company) == list(cases.values())
    brands = F.array(F.lit(""), F.lit("Golf Nest"), F.lit("Marsh's"))
    assert values(spark, ["Marsh s of MA", "Galaxy Golf", None], lambda x: names.sub_brand(brands, x)) == ["Marsh's", None, None]


def test_microdata_and_inline_markup():
    page = """<div itemtype='http://schema.org/JobPosting' itemscope><h2 itemprop=title>Nurse &amp; <b>Carer</b></h2><img src=x>
      <span itemprop="jobLocation"><span itemprop="addressLocality">Ely</span><span itemprop="addressRegion"> </span></span><meta itemprop="validThrough" content="2024-05-06T00:00"/>
      <div itemprop="hiringOrganization"><span itemprop="name">Fen</span><span itemprop="name">Other</span></div></div><b itemprop="title">Late</b>"""
    assert html.posting(page) == {"title": "Nurse & Carer", "company": "Fen", "location": "Ely", "posted": None, "expires": "2024-05-06", "workplace": "unknown", "told_by": "microdata"}
    assert html.microdata(None) == html.microdata("") == html.microdata("<p>JobPosting</p>") == html.microdata("<div itemscope itemtype='https://schema.org/JobPosting'>") == {}
    assert html.markdown('See <a class="x" href="https://a.b/c"><b>this</b></a>, <em> now </em><i></i>') == "See [**this**](https://a.b/c), *now*"
    assert html.markdown("&lt;p&gt;One&lt;/p&gt;&lt;p&gt;two &lt;b&gt;bold&lt;/b&gt;&lt;/p&gt;").split() == ["One", "two", "**bold**"]


def test_pages_of_a_million_unclosed_tags_take_linear_time():
    scope = "<div itemscope itemtype='https://schema.org/JobPosting'>"
    for unit in ("<b>", "</b>", "<a href='x'>", "<script>", "<!--", "<h2>", "<", "<i></i>", "<b><i>", "<a x=\"", "<template><", "x<br", "<h1></h2>", "<p>- "):
        page = unit * (1_000_000 // len(unit))
        began = time.monotonic()
        html.markdown(page)
        list(html.ld_nodes(page))
        assert time.monotonic() - began < 20, unit
    for unit in ("<b itemprop='title'> ", "<b itemprop='jobLocation'></i>", "<p>text", "<meta itemprop=title content=' '>", "<b itemprop='hiringOrganization'><i itemprop=name></b>"):
        began = time.monotonic()
        html.microdata(scope + unit * (1_000_000 // len(unit)) + "JobPosting")
        markup.links(unit * 20_000), markup.section(unit * 20_000, "class", "x")
        assert time.monotonic() - began < 20, unit


def test_links_and_sections():
    page = """<div class="a b"><div>in<div></div></div>ner <!-- </div> --></div><a href="/x?a=1&amp;b=2">One <b>two</b><a href='/y'>three</a><a name=z>no</a><br id=v><script id="s">if (a < b) "</div>"</script><p id=open>"""
    assert markup.section(page, "class", "b") == "<div>in<div></div></div>ner <!-- </div> -->"
    assert markup.section(page, "id", "v") == "" and markup.section(page, "id", "s") == 'if (a < b) "</div>"'
    assert markup.section(page, "id", "open") is None and markup.section(page, "class", "c") is None and markup.section(None, "id", "x") is None
    assert markup.links(page) == [("/x?a=1&b=2", "One two"), ("/y", "three")] and markup.links(None) == []
    assert html.microdata('<div itemscope itemtype="https://schema.org/JobPosting"><meta itemprop="title" content="a > b"></div>')["title"] == "a > b"
    assert html.markdown("<h2>A <b>bold</b> <a href=x>link</a></h2><b>open <i>both</b> end</i> 1 < 2") == "## A bold link\n\n**open *both** end* 1 < 2"
    assert html.markdown("<b> <i> </i> </b>x<b>y</b ><strong>z <br></strong>end") == "x**y****z**\nend" or html.markdown("<b> </b>x") == "x"


def test_folds(spark):
    cases = {"Crème Brûlée": "creme brulee", "Straße & Söhne": "strasse and sohne", "ﬁrst ﬀ ﬄ": "first ff ffl", "Ｗｉｄｅ": "wide", "Đà Nẵng": "a nang", "Ǆ ĳ": "dz ij", "D.C.": "dc", "☃": "", None: None}
    assert values(spark, cases, text.plain_words) == list(cases.values())
    assert values(spark, ["Crème ﬂan", "Straße", "Huế"], text.slug) == ["creme-flan", "strae", "hue"]


def test_names_are_worked_out_once(spark):
    """Inside lambdas Spark repeats an expression as often as it is named, which made the plan of one name many times longer."""
    df = spark.createDataFrame([("a", "b")], "page string, label string")
    splits = lambda c: df.select(c)._jdf.queryExecution().optimizedPlan().toString().count("split(")
    assert splits(names.display_company(F.col("page"))) <= 30 and splits(names.company_shown(F.col("page"), F.col("label"))) <= 60


def test_locations_are_split_once(spark):
    df = spark.createDataFrame([(";".join(f"{'Aa'[k % 2]}{k // 2}" for k in range(600)),)], "x string")
    out = df.select(text.split_locations(F.col("x")).alias("y"))
    assert out.first().y == [f"A{k}" for k in range(100)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("[;|]") == 1


def test_all_locations_whole(spark):
    case = [";".join(f"{'Aa'[k % 2]}{k // 2}" for k in range(600)), "b;a;B; A|c", "x" * 300 + "y|" + "x" * 300 + "z", None]
    got = values(spark, case, lambda x: text.split_locations(x, None, None))
    assert got == [[f"A{k}" for k in range(300)], ["b", "a", "c"], ["x" * 300 + "y", "x" * 300 + "z"], []]
    began, many = time.time(), spark.range(8).selectExpr("array_join(transform(sequence(1, 20000), k -> concat(k, ' ', id)), ';') AS x").select(text.split_locations(F.col("x"), None, None).alias("y"))
    assert many.agg(F.sum(F.size("y")), F.max(F.element_at("y", -1))).first() == (160_000, "20000 7") and time.time() - began < 20
