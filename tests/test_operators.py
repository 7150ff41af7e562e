from __future__ import annotations

import datetime as dt
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.operators import dedup, demand, gates, links, maintenance, places, search, stats, timeseries
from tessella.sources import listing
from tessella.sources.tables import AS_OF
from tessella.streaming import incremental, state


def fold(counts):
    n, base, low, flag = 0, 0.0, 0, None
    for at, c in counts:
        if n < 5:
            base += (c - base) / (n + 1)
            low, flag = 0, None
        elif base > 0 and c < base * 0.5:
            low += 1
            flag = flag if flag is not None or low < 3 else at
        else:
            base, low, flag = base + 0.3 * (c - base), 0, None
        n += 1
    return n, base, low, flag


def histories():
    rng = random.Random(2)
    out = {"drop": [100] * 5 + [10] * 4, "back": [100] * 5 + [10] * 3 + [90], "few": [3, 0], "zero": [0] * 8}
    return out | {f"r{i}": [rng.choice((100, 95, 20, 0)) for _ in range(rng.randrange(1, 30))] for i in range(20)}


def test_coverage(spark):
    rows = [(k, t, c) for k, h in histories().items() for t, c in enumerate(h)]
    random.Random(1).shuffle(rows)
    got = maintenance.coverage(spark.createDataFrame(rows, "source string, at int, n int"), "source", "at", "n").collect()
    for r in got:
        n, base, low, flag = fold(list(enumerate(histories()[r.source])))
        assert (r.samples, r.low_streak, r.flagged_at) == (n, low, flag) and abs(r.baseline - base) < 1e-9


def test_coverage_stream(spark, tmp_path):
    for k in range(2):
        rows = [(s, t, c) for s, h in histories().items() for t, c in enumerate(h) if (t >= 6) == bool(k)]
        spark.createDataFrame(rows, "source string, at int, n int").coalesce(1).write.parquet(f"{tmp_path}/in{k}")
    stream = spark.readStream.schema("source string, at int, n int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    state.use_state_store(spark)
    q = state.coverage(stream).writeStream.outputMode("update").format("memory").queryName("covered").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    last = {}
    for r in spark.table("covered").collect():
        if r.source not in last or r.samples > last[r.source].samples:
            last[r.source] = r
    for s, h in histories().items():
        n, base, low, flag = fold(list(enumerate(h)))
        assert (last[s].samples, last[s].low, last[s].flagged) == (n, low, None if flag is None else str(flag)) and abs(last[s].baseline - base) < 1e-9


def elect(rows):
    """The greedy election, row by row."""
    out, groups = {}, defaultdict(list)
    for r in rows:
        groups[r["company_key"], r["title_key"]].append(r)
    for (c, t), g in groups.items():
        g.sort(key=lambda r: (not r["official"], r["closed"], r["linked"], r["created_at"], r["id"]))
        by_loc, leads = {}, []
        for r in g:
            key, lead = tuple(r["locations"]), None
            if c is not None and t is not None and key:
                lead = by_loc.get(key)
                if lead is None:
                    lead = next((x["id"] for p in sorted(r["places"]) for x in leads if p in x["places"] and x["domain"] != r["domain"]), None)
                if lead is None:
                    by_loc[key] = r["id"]
                    leads.append(r)
                else:
                    by_loc.setdefault(key, lead)
            out[r["id"]] = lead
    return out


def test_place_leaders(spark):
    rng = random.Random(4)
    rows = [
        {"id": i, "company_key": rng.choice(("a", "b", None)), "title_key": rng.choice(("x", "y")), "official": rng.random() < 0.2, "closed": rng.random() < 0.3, "linked": rng.random() < 0.1, "created_at": rng.randrange(50),
         "domain": (d := rng.choice("pqr")), "locations": [rng.choice("klmno") + d] if rng.random() < 0.9 else [], "places": sorted({rng.choice("1234567") for _ in range(2)})}
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, "id long, company_key string, title_key string, official boolean, closed boolean, linked boolean, created_at int, domain string, locations array<string>, places array<string>")
    got = {r.id: r.primary for r in dedup.place_leaders(df).collect()}
    assert got == elect(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_arrivals_join_as_a_whole_election_would(spark, seed):
    rng = random.Random(seed)
    rows = [
        {"id": i, "company_key": rng.choice(("a", "b", "c", None)), "title_key": rng.choice(("x", "y")), "official": i < 150 and rng.random() < 0.2, "closed": False, "linked": False, "created_at": rng.randrange(50) + 100 * (i >= 150),
         "domain": (d := rng.choice("pqr")), "locations": [rng.choice("klmnotuv") + rng.choice(d + "z")] if rng.random() < 0.9 else [], "places": sorted({rng.choice("123456789") for _ in range(rng.randrange(3))})}
        for i in range(260)
    ]
    kind = "id long, company_key string, title_key string, official boolean, closed boolean, linked boolean, created_at int, domain string, locations array<string>, places array<string>"
    first, whole = elect(rows[:150]), elect(rows)
    stored = spark.createDataFrame([r | {"primary": first[r["id"]]} for r in rows[:150] if r["company_key"] != "c"], kind + ", primary long")
    got = {r.id: r.primary for r in dedup.place_arrivals(spark.createDataFrame(rows[150:], kind), stored).collect()}
    unseen = elect([r for r in rows if r["company_key"] == "c" and r["id"] >= 150])
    assert got == {r["id"]: unseen[r["id"]] if r["company_key"] == "c" else whole[r["id"]] for r in rows[150:]}
    assert {whole[r["id"]] for r in rows[150:]} & {r["id"] for r in rows[150:]} and all(whole[i] == p for i, p in first.items())
    closed = stored.withColumn("closed", F.lit(True))
    assert {r.id: r.primary for r in dedup.place_arrivals(spark.createDataFrame(rows[150:], kind), closed).collect()} == elect(rows[150:])


def test_arrivals_of_real_postings(spark, sf_dir):
    """Half of all postings settled, the other half arriving, against one election of all."""
    from tessella.plans import catalogue

    df = catalogue.placed_postings(spark, sf_dir).withColumn("closed", F.lit(False)).withColumn("official", F.lit(False)).cache()
    middle = df.approxQuantile("id", [0.5], 0.0)[0]
    df = df.withColumn("created_at", F.when(F.col("id") > middle, F.col("created_at") + F.make_dt_interval(F.lit(40_000))).otherwise(F.col("created_at")))
    old, new = df.where(F.col("id") <= middle), df.where(F.col("id") > middle)
    stored = old.join(dedup.place_leaders(old), "id")
    got = {(r.id, r.primary) for r in dedup.place_arrivals(new, stored).union(stored.select("id", "primary")).collect()}
    assert got == {(r.id, r.primary) for r in dedup.place_leaders(df).collect()} and len(got) == df.count()


def test_near_equal_sets_lose_nothing(spark):
    rng = random.Random(3)
    base = [f"i{k}" for k in range(30)]
    groups = {g: set(base) - {rng.choice(base) for _ in range(rng.randrange(5))} for g in range(25)} | {99: {"i1"}}
    df = spark.createDataFrame([(g, i) for g, s in groups.items() for i in s], "g int, i string")
    want = {(a, b) for a in groups for b in groups if a < b and len(groups[a] & groups[b]) >= 0.9 * max(len(groups[a]), len(groups[b]))}
    assert {(r.a, r.b) for r in dedup.near_equal_sets(df, "g", "i", 0.9).collect()} == want


def test_alerts_by_both_ways(spark):
    p = spark.sql("SELECT id, concat('t', id % 3) AS title, element_at(array('A','B'), CAST(id % 2 + 1 AS INT)) AS sector, 'x' AS area, id * 10 AS salary_max, CAST(NULL AS BIGINT) AS salary_min, timestamp'2024-01-02' AS found_at FROM range(40)")
    s = spark.sql("SELECT * FROM VALUES (1, 't1', NULL, NULL, NULL), (2, NULL, 200, 'A', NULL), (3, NULL, NULL, 'B', 'x'), (4, NULL, NULL, NULL, 'y') AS t(search_id, want_words, want_salary, want_sector, want_area)").withColumn("last_alerted_at", F.lit("2024-01-01").cast("timestamp"))
    a, b = (sorted(map(tuple, demand.alert_matches(s, p, bound).collect())) for bound in (10, 2))
    assert a == b and {x for x, _ in a} == {1, 2, 3}


def test_alerts_of_postings_without_sector(spark):
    p = spark.sql("SELECT * FROM VALUES (1, 'A'), (2, NULL), (3, 'B') AS t(id, sector)").selectExpr("id", "sector", "'t' AS title", "'x' AS area", "10 AS salary_max", "CAST(NULL AS INT) AS salary_min", "timestamp'2024-01-02' AS found_at")
    s = spark.sql("SELECT * FROM VALUES (1, NULL), (2, 'A'), (3, NULL) AS t(search_id, want_sector)").selectExpr("*", "CAST(NULL AS STRING) AS want_words", "CAST(NULL AS INT) AS want_salary", "CAST(NULL AS STRING) AS want_area", "timestamp'2024-01-01' AS last_alerted_at")
    for bound in (10, 0):
        assert sorted(map(tuple, demand.alert_matches(s, p, bound).collect())) == [(1, 1), (1, 2), (1, 3), (2, 1), (3, 1), (3, 2), (3, 3)]


def test_equal_searches_meet_postings_in_blocks(spark):
    p = spark.range(200).selectExpr("id", "'t' AS title", "'A' AS sector", "'x' AS area", "id AS salary_max", "CAST(NULL AS BIGINT) AS salary_min", "timestamp'2024-01-02' + make_interval(0, 0, 0, -2 * (id % 2)) AS found_at")
    s = spark.range(500).selectExpr("nullif(id, 7) AS search_id", "CAST(NULL AS STRING) AS want_words", "100 AS want_salary", "element_at(array('A', NULL), CAST(id % 2 + 1 AS INT)) AS want_sector", "'x' AS want_area", "timestamp'2024-01-01' AS last_alerted_at")
    want = sorted((str(None if x == 7 else x), i) for x in range(500) for i in range(100, 200, 2))
    for bound in (10, 1):
        out = demand.alert_matches(s, p, bound)
        assert sorted((str(x), i) for x, i in map(tuple, out.collect())) == want and joined_rows(spark, out) < 1_000  # of 25,000 matches
    assert demand.alert_matches(s.where("false"), p).isEmpty()


def test_alerts_by_both_ways_against_all_pairs(spark):
    rng = random.Random(6)
    some = lambda *x: rng.choice([None, *x])
    day = lambda k: dt.datetime(2024, 1, 1 + k)
    s = [(i, some("t1", "T2"), some(150, 300), some("A", "B", "C", ""), some("x", "y"), day(rng.randrange(4))) for i in range(300)]
    p = [(i, rng.choice(["T1 t2", "t1", None, "u"]), some("A", "B", ""), some("x", "y"), some(100, 200, 400), some(100, 300), day(rng.randrange(5))) for i in range(700)]
    meet = lambda s, p: p[6] > s[5] and (s[1] is None or s[1].lower() in (p[1] or "").lower()) and (s[2] is None or next((v for v in (p[5], p[4]) if v is not None), 0) >= s[2]) and s[3] in (None, p[2]) and s[4] in (None, p[3])
    want = sorted((a[0], b[0]) for a in s for b in p if meet(a, b))
    searches = spark.createDataFrame(s, "search_id long, want_words string, want_salary int, want_sector string, want_area string, last_alerted_at timestamp")
    found = spark.createDataFrame(p, "id long, title string, sector string, area string, salary_min long, salary_max long, found_at timestamp")
    for bound in (10_000, 1):
        assert sorted(map(tuple, demand.alert_matches(searches, found, bound).collect())) == want


def test_alerts_take_little_disk(spark, tmp_path):
    """The rows grow with the product of searches and postings; runs and repeats in their order keep the files small."""
    p = spark.range(3_000).selectExpr("id", "'t' AS title", "concat('S', id % 5) AS sector", "'x' AS area", "id AS salary_max", "CAST(NULL AS BIGINT) AS salary_min", "timestamp'2024-01-02' AS found_at")
    s = spark.range(12_000).selectExpr("id AS search_id", "CAST(NULL AS STRING) AS want_words", "nullif(id % 3 * 1000, 0) AS want_salary", "nullif(concat('S', id % 7), 'S6') AS want_sector", "CAST(NULL AS STRING) AS want_area", "timestamp'2024-01-01' AS last_alerted_at")
    for bound in (10_000, 1):
        out = str(tmp_path / str(bound))
        demand.alert_matches(s, p, bound).write.parquet(out)
        assert spark.read.parquet(out).count() == s.join(p, F.expr("(want_salary IS NULL OR salary_max >= want_salary) AND (want_sector IS NULL OR sector = want_sector)")).count()
        size = sum(x.stat().st_size for x in (tmp_path / str(bound)).glob("*.parquet"))
        assert size < 0.4 * spark.read.parquet(out).count(), size


def test_similar_against_all_pairs(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("abc"), rng.choice("xy"), rng.randrange(20)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, company string, title string, listed_at int")
    want = []
    for i, company, title, _ in rows[::5]:
        for kind, ok in (("company", lambda r, c=company, n=i: r[1] == c and r[0] != n), ("title", lambda r, c=company, t=title: r[2] == t and r[1] != c)):
            best = sorted((r for r in rows if ok(r)), key=lambda r: (-r[3], r[0]))[:3]
            want += [(i, kind, n + 1, r[0]) for n, r in enumerate(best)]
    assert sorted(map(tuple, search.similar(df, df.where("id % 5 = 0"), 3).collect())) == sorted(want)


def test_exact_leaders_with_nulls_and_ties(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 'k', 2), (2, 'k', 1), (3, NULL, 0), (4, 'm', 0), (5, 'k', 1) AS t(id, k, o)")
    assert sorted(map(tuple, dedup.exact_leaders(df, ["k"], ["o", "id"], "id").collect()), key=str) == [(1, 2), (2, None), (3, None), (4, None), (5, 2)]


def test_search_with_synonyms(spark):
    df = spark.sql("SELECT 1 AS id, 'Data Engineer' AS title, array('x') AS standard_titles UNION ALL SELECT 2, 'Plumber', array('Engineer') UNION ALL SELECT 3, 'Senior Plumber', array('Engineer')")
    s = search.Search(words="engineer -senior", titles=("Engineer",))
    assert sorted(r.id for r in search.search(df, s, "2024-01-01").collect()) == [1, 2]


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "id long, g string, ts timestamp")
    assert timeseries.activity(none, "ts", "day", "2024-01-01", "2024-01-03").agg(F.sum("n")).first()[0] == 0
    assert stats.mode_and_share(none, ["id"], "g").count() == 0
    assert maintenance.coverage(none, "id", "ts", "id").count() == 0


def test_listing(spark):
    body = '{"jobs": {"list": [{"u": "/a", "d": "2024-01-02T00"}, {"u": "/b"}, {"u": "/a", "d": "x"}, {"u": ""}]}}'
    sitemap = "<urlset><url><loc> http://x/1 </loc><lastmod>2024-05-06</lastmod></url><url><loc>http://x/2</loc></url></urlset>"
    rows = [("b1", "json", body), ("b2", "map", sitemap), ("b3", "html", "<a class='k' href='/job/7'>x</a><a href=\"/about\">y</a>"), ("b4", "json", "{broken"), ("b5", "other", "")]
    df = spark.createDataFrame(rows, "board string, kind string, body string")
    read = listing.read_boards(df, {"json": listing.from_json("jobs.list", "u", "d"), "map": listing.from_sitemap, "html": listing.from_links("/job/")})
    got = [(r.board, r.url, r.posted, r.place) for r in listing.first_seen(read, 2).orderBy("board", "place").collect()]
    assert got == [("b1", "/a", "2024-01-02", 1), ("b1", "/b", None, 2), ("b2", "http://x/1", "2024-05-06", 1), ("b2", "http://x/2", None, 2), ("b3", "/job/7", None, 1)]
    assert {r.board: r.complete for r in listing.completeness(read, 2).collect()} == {"b1": False, "b2": False, "b3": True, "b4": False}


def test_sinks(spark, tmp_path):
    path = f"{tmp_path}/t"
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    assert listing.insert_absent(df, path, ["k"]).count() == 2 and listing.insert_absent(df, path, ["k"]).count() == 0
    assert spark.read.parquet(path).count() == 2
    days = f"{tmp_path}/d"
    listing.replace_days(spark.createDataFrame([("x", 1), ("y", 1)], "day string, n int"), days, "day")
    listing.replace_days(spark.createDataFrame([("y", 2)], "day string, n int"), days, "day")
    assert sorted((r.day, r.n) for r in spark.read.parquet(days).collect()) == [("x", 1), ("y", 2)]


def test_register_stream(spark, tmp_path):
    spark.createDataFrame([("http://A.b/x/?utm_a=1",), ("http://a.b/x",), ("http://a.b/y",)], "url string").write.parquet(f"{tmp_path}/in")
    for c in ("c1", "c2"):  # the second stream delivers everything again
        incremental.register_urls(spark.readStream.schema("url string").parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/{c}").awaitTermination()
    assert sorted(r.normalized for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["http://a.b/x", "http://a.b/y"]


def test_activity_stream(spark, tmp_path):
    spark.sql("SELECT timestamp_seconds(id * 600) AS ts, CAST(id % 2 AS STRING) AS kind FROM range(12)").write.parquet(f"{tmp_path}/in")
    q = incremental.activity(spark.readStream.schema("ts timestamp, kind string").parquet(f"{tmp_path}/in"), "ts", "kind").writeStream.outputMode("complete").format("memory").queryName("acts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("acts").collect()) == [3, 3, 3, 3]


def test_places_within_lose_nothing(spark):
    rng = random.Random(6)
    spot = lambda: (rng.choice((rng.uniform(-90, 90), rng.uniform(84, 90), 0.0, -90.0)), rng.choice((rng.uniform(-180, 180), -180.0, 179.9, 0.0)))
    a, b = [(i, *spot()) for i in range(150)], [(i, *spot()) for i in range(150)]

    def miles(p, q):
        x, y = math.radians(p[1]), math.radians(q[1])
        h = math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * 3958.8 * math.asin(math.sqrt(min(1.0, h)))

    points = spark.createDataFrame([*a, (999, None, None)], "id int, lat double, lon double")
    gazetteer = spark.createDataFrame(b, "place int, place_lat double, place_lon double")
    for most in (40.0, 700.0):
        want = {(p[0], q[0]) for p in a for q in b if miles(p, q) <= most}
        got = [(r.id, r.place) for r in places.within(points, gazetteer, most).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def joined_rows(spark, df) -> int:
    """Rows that the joins of a query give, as Spark counts them when it runs without adaptive execution."""
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select("*")  # planned anew
        plan = df._jdf.queryExecution().executedPlan()
        df._jdf.collectToPython()
        todo, n = [plan], 0
        while todo:
            x = todo.pop()
            if "Join" in x.nodeName():
                n += x.metrics().apply("numOutputRows").value()
            todo += [x.children().apply(i) for i in range(x.children().size())]
        return n
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


def test_places_on_one_spot_meet_once(spark):
    points = spark.range(300).selectExpr("id", "id % 3 + 0D AS lat", "0D AS lon", "concat('own', id % 2) AS own_area")
    gazetteer = spark.range(400).selectExpr("id AS place", "id % 4 + 0D AS place_lat", "0D AS place_lon", "id % 5 * 1000 AS population", "concat('a', id % 8) AS area")
    near = places.nearest(points, gazetteer, "id", least_people=2000)
    assert {(r.id, r.place, round(r.distance, 6)) for r in near.collect()} == {(i, min(p for p in range(400) if p % 4 == i % 3 and p % 5 >= 2), 0.0) for i in range(300)}
    around = places.areas_around(points, gazetteer, "id", 75.0)
    for i, got in ((i, [r.area for r in around.where(f"id = {i}").orderBy("rank").collect()]) for i in (0, 1, 5)):
        by = {f"a{p}": min(abs(i % 3 - q % 4) for q in range(8) if q == p) for p in range(8)}
        assert got == [f"own{i % 2}", *sorted((a for a, d in by.items() if d <= 1), key=lambda a: (by[a], a))]
    assert joined_rows(spark, near) < 2_000 and joined_rows(spark, around) < 10_000  # 30,000 pairs at each spot before


def test_updates_and_reports(spark, tmp_path):
    df = spark.sql("SELECT * FROM VALUES (1, 'a', 'x'), (2, 'b', 'y'), (NULL, 'c', 'z') AS t(id, v, w)")
    new = spark.sql("SELECT * FROM VALUES (1, CAST(NULL AS STRING)), (9, 'q'), (NULL, 'n') AS t(id, v)")
    out = links.keyed_update(df, new, ["id"])
    assert out.columns == df.columns and sorted(map(tuple, out.collect()), key=str) == [(1, None, "x"), (2, "b", "y"), (None, "c", "z")]
    links.csv_report(df, f"{tmp_path}/r")
    back = listing.read_delimited(spark, f"{tmp_path}/r", "id int, v string, w string")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    for rows in (df, df.where("id = 1")):
        links.replace_all(rows, f"{tmp_path}/t")
        assert spark.read.parquet(f"{tmp_path}/t").count() == rows.count()


def test_takeover_by_official_copies(spark):
    kind = "g string, id int, official boolean, created_at int"
    old = spark.createDataFrame([("a", 1, False, 0), ("b", 2, True, 0), ("c", 3, False, 0)], kind)
    new = spark.createDataFrame([("a", 11, False, 1), ("a", 12, True, 9), ("b", 13, True, 1), ("c", 14, False, 1), ("d", 15, False, 2), ("d", 16, False, 1)], kind)
    assert {r.id: r.primary for r in links.takeover(old, new, ["g"]).collect()} == {1: 12, 11: 12, 12: None, 2: None, 13: 2, 3: None, 14: 3, 15: 16, 16: None}


def test_days_of_clock_changes():
    first, today = gates._days("2026-03-10 03:59:00", 7)
    assert (str(first), str(today)) == ("2026-03-03", "2026-03-09")  # before midnight in New York
    assert gates.freshness("found-yesterday", AS_OF) is None and gates.salary_floor("60k-plus") is None


def test_places_that_are_offered(spark):
    rows = [("Salt Lake City", "city", 200), ("Salt Lake City metro area", "area", 200), ("Saltillo", "city", 300), ("Salta", "state", 1), ("New Salt", "city", 900), ("Basalt", "city", 999), ("Salt Land", "country", 0)]
    places = spark.createDataFrame(rows, "name string, kind string, population int")
    got = [r.name for r in links.suggest_places(places, "Salt", 10).collect()]
    assert got == ["Salt Land", "Salta", "Saltillo", "Salt Lake City", "Salt Lake City metro area", "New Salt"]


def test_sorts_that_callers_choose(spark):
    df = spark.createDataFrame([(1, "b", 5), (2, None, 9), (3, "a", 1), (4, "b", 7)], "id int, company string, found_at int")
    assert [r.id for r in search.sorted_page(df, "company", False, 9).collect()] == [3, 4, 1, 2] and [r.id for r in search.sorted_page(df, "company", True, 2, 1).collect()] == [4, 1]
    with pytest.raises(ValueError):
        search.sorted_page(df, "id; drop", False, 9)
