"""Places that free text names, over a small gazetteer."""

from __future__ import annotations

import pytest

from tessella.operators import resolver

# place_id, name, state, area, population, lat, lon, aliases
PLACES = [
    (1, "Salt Lake City", "UT", "m-slc", 200_000, 40.76, -111.89, ["SLC", "Great Salt Lake City"]),
    (2, "Sandy", "UT", "m-slc", 95_000, 40.59, -111.88, []),
    (3, "Delta", "UT", None, 3_500, 39.35, -112.57, []),
    (4, "St. George", "UT", "m-stg", 95_000, 37.09, -113.58, ["Saint George"]),
    (5, "New York", "NY", "m-nyc", 8_400_000, 40.71, -74.0, ["New York City", "NYC"]),
    (6, "Jersey City", "NJ", "m-nyc", 290_000, 40.72, -74.04, []),
    (7, "Washington", "DC", "m-dc", 700_000, 38.9, -77.03, ["Washington DC", "Washington D.C."]),
    (8, "Seattle", "WA", "m-sea", 740_000, 47.6, -122.33, []),
    (9, "Redmond", "WA", "m-sea", 73_000, 47.67, -122.12, []),
    (10, "Springfield", "IL", "m-spi", 114_000, 39.8, -89.64, []),
    (11, "Springfield", "MO", "m-spm", 169_000, 37.2, -93.29, []),
    (12, "Kansas City", "MO", "m-kc", 508_000, 39.1, -94.58, []),
    (13, "Kansas City", "KS", "m-kc", 156_000, 39.1, -94.63, []),
    (14, "London", "KY", "m-lky", 8_000, 37.13, -84.08, []),
    (15, "Elizabethtown", "KY", "m-etn", 31_000, 37.7, -85.86, []),
    (16, "Hopkinsville", "KY", "m-hop", 31_500, 36.87, -87.49, ["Elizabethtown"]),
    (17, "Minneapolis", "MN", "m-msp", 430_000, 44.98, -93.27, []),
    (18, "Arden Hills", "MN", "m-msp", 10_000, 45.05, -93.16, []),
    (19, "Charlotte", "NC", "m-clt", 880_000, 35.23, -80.84, []),
    (20, "North Ogden", "UT", "m-ogd", 21_000, 41.31, -111.96, ["North"]),
    (21, "University Park", "TX", "m-dfw", 25_000, 32.85, -96.79, []),
    (22, "Irving", "TX", "m-dfw", 240_000, 32.81, -96.95, []),
    (23, "Ontario", "CA", "m-riv", 175_000, 34.06, -117.65, []),
    (24, "Vista", "CA", "m-sd", 98_000, 33.2, -117.24, []),
    (25, "Mexico", "MO", "m-mex", 11_500, 39.17, -91.88, []),
    (26, "Concord", "CA", "m-sf", 125_000, 37.98, -122.03, []),
    (27, "Boston", "MA", "m-bos", 650_000, 42.36, -71.06, []),
    (28, "Lebanon", "OH", "m-cin", 21_000, 39.43, -84.21, []),
    (29, "San Francisco", "CA", "m-sf", 800_000, 37.77, -122.42, []),
    (30, "Mount Pleasant", "SC", "m-chs", 90_000, 32.83, -79.83, []),
]
STATES = {"UT": "Utah", "NY": "New York", "NJ": "New Jersey", "DC": "District of Columbia", "WA": "Washington", "IL": "Illinois", "MO": "Missouri", "KS": "Kansas", "KY": "Kentucky", "MN": "Minnesota", "NC": "North Carolina", "TX": "Texas", "CA": "California", "IN": "Indiana", "DE": "Delaware", "CO": "Colorado", "GA": "Georgia", "MD": "Maryland", "MA": "Massachusetts", "OH": "Ohio", "SC": "South Carolina", "NE": "Nebraska", "FL": "Florida"}
COUNTRIES = {"Canada": "CA", "India": "IN", "Germany": "DE", "United Kingdom": "GB", "UK": "GB", "Mexico": "MX", "Georgia": "GE", "Malaysia": "MY", "Netherlands": "NL"}
NAMESAKES = [("London", 8_900_000), ("Paris", 2_100_000), ("Boston", 45_000)]


@pytest.fixture(scope="module")
def gazetteer(spark):
    places = spark.createDataFrame(PLACES, "place_id int, name string, state string, area string, population long, lat double, lon double, aliases array<string>")
    return resolver.Gazetteer(places, STATES, COUNTRIES, spark.createDataFrame(NAMESAKES, "name string, population long"), {"bay area": ("m-sf", "CA"), "san francisco bay area": ("m-sf", "CA"), "twin cities": ("m-msp", "MN")})


# entry -> (geo, place_id, state, area, workplace, country)
CITY = {
    "Salt Lake City, UT, US": 1, "Salt Lake City, Utah": 1, "Salt Lake City, United States of America": 1, "Salt Lake City": 1, "salt  lake city": 1,
    "Salt Lake City UT, United States of America": 1, "USA, UT, Salt Lake City": 1, "Home Services - Salt Lake City, United States of America": 1,
    "Sandy, UT": 2, "Delta, Utah": 3, "St. George, Utah, United States": 4, "Saint George, UT": 4, "New York, NY, United States": 5, "New York City, NY, USA": 5, "New York, New York": 5, "New York": 5,
    "Washington, D.C.": 7, "Washington D.C., United States": 7, "USA, DC, Washington (20 M St SE), United States of America": 7, "USA, WA, Seattle": 8, "Seattle, WA,US, US": 8,
    "United States, Washington, Redmond": 9, "Kansas City": 12, "7173 - Kansas City, United States of America": 12, "Kansas City, KS": 13,
    "Elizabethtown, KY": 15, "Hopkinsville, KY": 16, "1000 Nicollet Mall, Minneapolis,MN 55403-2542, United States of America": 17, "Arden Hills US-MN, United States": 18,
    "Charlotte NC - 214 North Tryon Street, United States of America": 19, "141753-NC-Three Wells Fargo Center, Charlotte, United States of America": 19,
    "6400 LAS COLINAS BLVD IRVING, TX": 22, "Ontario, CA": 23, "2260 Watson Way  Vista, CA 92083": 24, "Mexico, MO": 25, "Client Office: Washington, DC, United States of America": 7,
    "480 WASHINGTON BOULEVARD JERSEY CITY, United States of America": 6, "Lebanon, Ohio": 28, "140 West St, New York, NY (NY0466), United States of America": 5, "New York, United, States (Hybrid)": 5,
    "San Francisco- Hybrid, US": 29, "Mt. Pleasant, SC": 30, "Greater Boston Area": 27, "Boston or Remote": 27, "New York, NY HQ": 5, "London, KY": 14, "New York, 1 Columbus Circle, United States of America": 5,
}
STATE = {"Utah": "UT", "Remote - California": "CA", "California - Remote, United States of America": "CA", "CA, United States": "CA", "Remote - CA, United States of America": "CA", "Somewhere Unknown, TX 75001": "TX", "GEORGIA - VIRTUAL - GA01, United States of America": "GA", "141278-NC-CIC Customer Information Ctr, United States of America": "NC", "Remote - New York": "NY", "Home Office - Illinois": "IL", "Maryland Remote Office (MD99), United States of America": "MD", "Remote City, FL, 33412 USA": "FL"}
NOTHING = {
    "London": "other", "London, UK": "other", "Paris": "other", "Toronto, Canada": "other", "Cambridge, Ontario, Canada": "other", "Berlin, Berlin, DE": "other", "Pune, MH, IN": "other", "Springfield": "other", "United States": "country", "US": "country", "Remote - US": "country", "Hybrid": "empty", "Remote": "empty", "": "empty", "   ": "empty",
    "Penn State University Park, United States of America": "other", "214 North Tryon Street, United States of America": "other", "IN - Hyderabad_HQ, India": "other", "Remote - India": "country", "Canada (Remote)": "country", "Tbilisi, Georgia": "other", "CA": "other", "Georgia": "other", "Washington": "other", "Asia": "country", "Mexico": "country", "Remote - Ontario": "country", "210 CITATION DRIVE,L4K 2V2,CONCORD,CA, Canada": "other", "CAN - Ontario - Toronto, Canada": "other", "Bend 1501 NE Medical Center Dr, United States of America": "other", "Kulim, Kedah,MY, MY": "other", "☃": "other", "Nowhere at all": "other",
}
WORKPLACE = {"Remote": "remote", "Hybrid": "hybrid", "Remote or Office": "hybrid", "New York, NY Office": "onsite", "Boston or Remote": "remote", "San Francisco- Hybrid, US": "hybrid", "Home Office - Illinois": None, "Maryland Remote Office (MD99), United States of America": "remote", "New York, NY HQ": None, "Cleveland Clinic Main Campus": None, "Work from home, Utah": "remote"}
ABROAD = {"Toronto, Canada": "CA", "Kulim, Kedah,MY, MY": "MY", "Remote - India": "IN", "London, UK": "GB", "CA": None, "US": "US", "Asia": None, "Pune, MH, IN": None, "Mexico": "MX"}


@pytest.fixture(scope="module")
def resolved(spark, gazetteer):
    entries = list({**CITY, **STATE, **NOTHING, **WORKPLACE, **ABROAD}) + ["San Francisco Bay Area, CA", "Twin Cities"]
    df = spark.createDataFrame([(e,) for e in entries * 2] + [(None,)], "entry string")
    rows = resolver.resolve(df, gazetteer).collect()
    assert len(rows) == len(entries)
    return {r.entry: r for r in rows}


def test_cities(resolved):
    places = {p[0]: p for p in PLACES}
    wrong = {e: resolved[e] for e, i in CITY.items() if (resolved[e].geo, resolved[e].place_id, resolved[e].state, resolved[e].area, resolved[e].country) != ("city", i, places[i][2], places[i][3], "US")}
    assert not wrong


def test_states(resolved):
    assert not {e: resolved[e] for e, s in STATE.items() if (resolved[e].geo, resolved[e].state, resolved[e].place_id, resolved[e].area, resolved[e].country) != ("state", s, None, None, "US")}


def test_entries_that_name_no_place_here(resolved):
    assert not {e: resolved[e] for e, g in NOTHING.items() if (resolved[e].geo, resolved[e].state, resolved[e].place_id) != (g, None, None)}


def test_nicknames_workplaces_countries(resolved):
    assert [(resolved[e].geo, resolved[e].area, resolved[e].state, resolved[e].place_id) for e in ("San Francisco Bay Area, CA", "Twin Cities")] == [("city", "m-sf", "CA", None), ("city", "m-msp", "MN", None)]
    assert {e: resolved[e].workplace for e in WORKPLACE} == WORKPLACE
    assert {e: resolved[e].country for e in ABROAD} == ABROAD


def test_areas_of_lists(spark, gazetteer, monkeypatch):
    rows = [(1, ["San Francisco, CA", "Remote - US", "New York City, NY", "Concord, CA", "Utah", "Sandy, Utah"]), (2, []), (3, None), (4, ["Toronto, Canada", "Pune, India", "Seattle, WA"]), (5, ["Toronto, Canada", "Pune, India"]), (6, ["Remote", None])]
    df = spark.createDataFrame(rows, "id int, locations array<string>")
    for limit in (resolver.BROADCAST, 0):
        monkeypatch.setattr(resolver, "BROADCAST", limit)
        got = {r.id: (r.areas, [tuple(p) for p in r.points], r.country) for r in resolver.filed(df, gazetteer, "id", "locations").collect()}
        assert got == {
            1: (["m-sf", "CA", "m-nyc", "NY", "UT", "m-slc"], [(37.77, -122.42), (40.71, -74.0), (37.98, -122.03), (40.59, -111.88)], "US"),
            2: ([], [], None), 3: ([], [], None), 4: (["m-sea", "WA"], [(47.6, -122.33)], "US"), 5: ([], [], "CA"), 6: ([], [], None),
        }


def test_names_that_dominate(spark):
    """The window of two against all pairs."""
    import random

    rng = random.Random(3)
    rows = [(i, rng.choice("abcdef") * 3, rng.choice(["UT", "NY", "KS"]), rng.choice([None, "m1", "m2"]), rng.randrange(1, 4000) ** 2, 0.0, 0.0, [rng.choice("abcdef") * 3]) for i in range(60)]
    places = spark.createDataFrame(rows, "place_id int, name string, state string, area string, population long, lat double, lon double, aliases array<string>")
    got = {(r.key, r.primary): r.place.place_id for r in resolver.index(resolver.Gazetteer(places, STATES, {})).where("state = ''").collect()}
    want = {}
    for key in {r[1] for r in rows} | {a for r in rows for a in r[7]}:
        for primary in (False, True):
            of = sorted((r for r in rows if r[1] == key or (not primary and key in r[7])), key=lambda r: -r[4])
            other = [r[4] for r in of if (r[3] or r[2]) != (of[0][3] or of[0][2])]
            if of and of[0][4] >= 5 * max([1, *other]):
                want[key, primary] = of[0][0]
    assert got == want
