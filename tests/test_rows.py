"""What is shown of rows, curated names and the rules that pages keep."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from tessella.functions import shown
from tessella.operators import curation


def values(spark, cases, column):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, x string")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_masks(spark):
    df = spark.createDataFrame([(1, "u", "a", "r"), (2, None, None, None), (3, "", "a", "r")], "id int, url string, apply_url string, flag_reason string")
    assert [tuple(r) for r in shown.masked(df, False, False).collect()] == [(1, None, None, None, True), (2, None, None, None, False), (3, None, None, None, False)]
    assert [tuple(r) for r in shown.masked(df, True, True).collect()] == [(1, "u", "a", "r", True), (2, None, None, None, False), (3, "", "a", "r", False)]
    assert shown.masked(df, True, False).first().flag_reason is None and shown.masked(df, True, False).first().url == "u"


def test_places_with_types(spark):
    cases = {
        "Utah | Hybrid": ("Utah", "hybrid"), "San Francisco, CA | On-site": ("San Francisco, CA", "onsite"), "Remote": (None, "remote"), "Arizona | Remote; Utah | Hybrid": ("Arizona; Utah", "unknown"), "Utah|remote; Utah | REMOTE": ("Utah", "remote"),
        "We are great | join us": (None, "unknown"), "a | b | Remote": (None, "unknown"), " | Remote": (None, "remote"), "": (None, "unknown"), None: (None, "unknown"), "; ;": (None, "unknown"), "x" * 300 + " | Remote": ("x" * 252 + "...", "remote"),
    }
    got = values(spark, cases, lambda x: F.struct(*shown.place_and_workplace(x)))
    assert [tuple(r) for r in got] == list(cases.values())
    kinds = {"FULL_TIME": "full_time", "Full-time": "full_time", " part time ": "part_time", "INTERN": "internship", "OTHER": "unknown", "": "unknown", None: "unknown"}
    assert values(spark, kinds, shown.employment) == list(kinds.values())


def test_unsquashed(spark):
    pages = F.array(F.lit("Palo Alto Networks, Inc."), F.lit(None).cast("string"), F.lit("EPIC Epicor Software"), F.lit("Good year"))
    cases = {"Paloaltonetworks": "Palo Alto Networks", "Epicorsoftware": "Epicor Software", "Goodyear": "Good year", "WeWork": None, "FIS": None, "Palo Alto": None, "Networks": None, "": None, None: None, "Epic": None}
    assert values(spark, cases, lambda x: shown.unsquashed(x, pages)) == list(cases.values())
    rng, tried = random.Random(1), []
    for _ in range(60):
        words = [rng.choice(["a", "ab", "b", "ba", "aa"]) for _ in range(rng.randrange(6))]
        tried.append(("".join(rng.choices("ab", k=rng.randrange(1, 6))).capitalize(), " ".join(words)))

    def plain(name, page):
        words = re.findall(r"\w+", page)
        return next((" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 2, len(words) + 1) if "".join(words[i:j]) == name.lower()), None)

    df = spark.createDataFrame([(i, n, p) for i, (n, p) in enumerate(tried)], "i int, n string, p string")
    got = [r.y for r in df.select("i", shown.unsquashed(F.col("n"), F.array("p")).alias("y")).orderBy("i").collect()]
    assert got == [plain(n, p) for n, p in tried] and any(got)


def test_proposals(spark):
    sources = spark.createDataFrame([("s1", "greenhouse/honda", "https://careers.honda.com"), ("s2", "CenterWell (primary care)", "x"), ("s3", "lever/zzz", "https://lever.co/zzz"), ("s4", "Paloaltonetworks", "x"), ("s5", "Acme", "x"), ("s6", "Quiet", "x")], "source string, name string, board string")
    rows = [("s1", "Honda Motor")] * 9 + [("s1", "Other")] + [("s3", "Whole Other")] * 5 + [("s4", "Palo Alto Networks")] * 3 + [("s5", "Bluebird")] * 30 + [("s5", "Acme Group")] * 12 + [("s5", "123 Entity")] * 50 + [("s6", None)] * 40
    got = {(r.source, r.kind, r.name) for r in curation.proposals(sources, spark.createDataFrame(rows, "source string, company string")).collect()}
    assert got == {("s1", "fix", "Honda Motor"), ("s2", "fix", "CenterWell"), ("s3", "review", "Whole Other"), ("s4", "review", "Palo Alto Networks"), ("s5", "review", "Bluebird"), ("s5", "brand", "Bluebird")}
    assert curation.proposals(sources, spark.createDataFrame(rows, "source string, company string").where("false")).count() == 1


def test_page_issues(spark):
    good = '<title>A title</title><meta name="description" content="{d}"><h1>x</h1><link rel="canonical" href="/{i}"><meta name="robots" content="index, follow">'
    pages = [
        (1, "/1", good.format(d="d" * 60, i=1), True), (2, "/2", good.format(d="e" * 60, i=2), True), (3, "/3", good.format(d="short", i=3).replace("A title", "B" * 61), True), (4, "/4", None, True), (5, "/5", good.format(d="f" * 60, i=5), False),
        (6, "/6", good.format(d="d" * 60, i="x").replace("A title", "C") + '<h1>y</h1><title>D</title><script type="application/ld+json">{"@type": "JobPosting"}</script><script type="application/ld+json">{</script>', True),
    ]
    got: dict = {}
    for r in curation.page_issues(spark.createDataFrame(pages, "id int, url string, html string, indexed boolean")).collect():
        got.setdefault(r.id, set()).add(r.issue)
    assert got == {
        2: {"duplicate_title"}, 3: {"title_length", "description_length"}, 4: {"title", "description", "h1", "canonical", "robots"}, 5: {"robots"},
        6: {"title", "h1", "canonical", "job_posting_markup", "structured_data", "duplicate_description"},
    }
