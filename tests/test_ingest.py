"""Scans become stored rows, and merge into those that are there."""

from __future__ import annotations

from datetime import date, datetime

import pytest

from tessella.operators import ingest, resolver

DAY = datetime(2024, 5, 6, 12)
SCAN = "url_id int, source string, success boolean, title string, company string, location string, workplace string, employment string, salary_min long, salary_max long, salary_currency string, description string, posted_at date, at timestamp"


def scan(url_id, source=None, success=True, title="Cook", company=None, location=None, workplace="unknown", employment=None, posted=None, at=DAY, description="text"):
    return (url_id, source, success, title, company, location, workplace, employment, None, None, "USDX", description, posted, at)


@pytest.fixture(scope="module")
def sources(spark):
    rows = [("lowes", "Lowe's (stores)", True, True, ["Sam's Club", "Sierra"]), ("slug", "lever/thing", True, True, []), ("new", "Placeholder", True, False, []), ("board", "Some Board", False, True, ["Nope"])]
    return spark.createDataFrame(rows, "source string, name string, official boolean, confirmed boolean, sub_brands array<string>")


def test_names_of_companies(spark, sources):
    cases = [("lowes", "Anything", "Lowe's"), ("lowes", "Sam s Club of MA", "Sam's Club"), ("lowes", None, "Lowe's"), ("slug", "Careers at Thing", "Thing"), ("new", "New Co", "New Co"), ("board", "Lowe's, Inc.", "Lowe's"), ("board", "SIERRA", "Sierra"), ("board", "Sierra Nevada Corp", "Sierra Nevada Corp"), (None, "Careers at Blue", "Blue"), (None, None, None), ("none", "x.eightfold.ai", "x.eightfold.ai")]
    df = spark.createDataFrame([(i, s, p) for i, (s, p, _) in enumerate(cases)], "i int, source string, page_company string")
    assert [r.company for r in ingest.official_names(df, sources).orderBy("i").collect()] == [c for *_, c in cases]


@pytest.fixture(scope="module")
def gazetteer(spark):
    places = spark.createDataFrame([(1, "Boston", "MA", "m-bos", 650_000, 42.36, -71.06, [])], "place_id int, name string, state string, area string, population long, lat double, lon double, aliases array<string>")
    return resolver.Gazetteer(places, {"MA": "Massachusetts"}, {"Canada": "CA"})


def test_derived_columns(spark, sources, gazetteer):
    rows = [scan(1, "lowes", title="Cook &amp; \x00chef", location="Boston, MA; Remote | Toronto, Canada", workplace="onsite"), scan(2, None, title="x" * 300, company="A&amp;B Inc.", location="Boston, MA Office"), scan(2, None, title="late", company="A&amp;B Inc.", at=datetime(2024, 5, 7)), scan(3, "board", title=None), scan(None)]
    got = {r.url_id: r for r in ingest.derived(spark.createDataFrame(rows, SCAN), sources, gazetteer).collect()}
    assert sorted(got) == [1, 2, 3]
    one, two, three = got[1], got[2], got[3]
    assert (one.title, one.title_key, one.company, one.company_key, one.salary_currency) == ("Cook & chef", "cook chef", "Lowe's", "lowe's", "USD")
    assert (one.locations, one.areas, one.country, [tuple(p) for p in one.points]) == (["Boston, MA", "Remote", "Toronto, Canada"], ["m-bos", "MA"], "US", [(42.36, -71.06)])
    assert (one.workplace, two.title, two.company, two.company_key, two.page_company, two.areas, two.employment) == ("hybrid", "late", "A&B Inc.", "a&b", "A&B Inc.", [], "unknown")
    assert (three.title, three.title_key, three.locations) == (None, None, [])


def test_upsert(spark, sources, gazetteer):
    first = ingest.derived(spark.createDataFrame([scan(1, workplace="remote", employment="contract", posted=date(2024, 5, 9)), scan(2, title="Keep"), scan(3, success=False)], SCAN), sources, gazetteer)
    kind = "url_id int, title string, company string, workplace string, employment string, posted_at date, areas array<string>, first_scanned_at timestamp, scanned_at timestamp, status string"
    stored = spark.createDataFrame(ingest.upsert(spark.createDataFrame([], kind), first).collect(), kind)
    rows = {r.url_id: r for r in stored.collect()}
    assert (rows[1].posted_at, rows[1].first_scanned_at, rows[1].status, rows[3].status, rows[3].title) == (date(2024, 5, 6), DAY, "success", "failed", None)
    later = datetime(2024, 5, 20)
    again = ingest.derived(spark.createDataFrame([scan(1, title="Chef", workplace="unknown", posted=date(2024, 5, 1), at=later), scan(2, success=False, title=None, at=later), scan(4, title="New", at=later)], SCAN), sources, gazetteer)
    got = {r.url_id: r for r in ingest.upsert(stored, again).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert (got[1].title, got[1].workplace, got[1].employment, got[1].posted_at, got[1].first_scanned_at, got[1].scanned_at) == ("Chef", "remote", "contract", date(2024, 5, 1), DAY, later)
    assert (got[2].title, got[2].status, got[2].scanned_at) == ("Keep", "failed", later) and (got[3].status, got[3].scanned_at) == ("failed", DAY) and got[4].first_scanned_at == later
    same = ingest.upsert(ingest.upsert(stored, again), again)
    assert sorted(map(str, same.collect())) == sorted(map(str, got.values())) and same.schema == stored.schema
    assert ingest.upsert(stored, again.where("false")).exceptAll(stored).isEmpty()
