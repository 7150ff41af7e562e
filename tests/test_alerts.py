"""The alert sweep against a nested loop, and its marks over several sweeps."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest

from tessella.operators import alerts

NOW = datetime(2024, 3, 10, 12)
SEARCH = "search_id int, user_id int, want_words string, not_words string, want_company string, want_area string, want_sector string, want_workplace string, want_salary long, want_salary_most long, want_days int, created_at timestamp, last_alerted_at timestamp"
POSTING = "id int, title string, company string, areas array<string>, sector string, workplace string, salary_min long, salary_max long, posted_at date, listed_at timestamp, scanned_at timestamp, first_scanned_at timestamp"


def made(rng: random.Random):
    maybe = lambda x, p=0.3: x if rng.random() < p else None
    words = ["data", "lead", "engineer", "ml", "ops", "Ünïcode", "go", "nurse"]
    searches = [(i, i % 5, maybe(" ".join(rng.sample(words, rng.randint(1, 2)))), maybe("lead nurse", 0.2), maybe(rng.choice(["acme", "ab", "CORP"])), maybe(rng.choice("xyz")), maybe(rng.choice("st")), maybe("remote"), maybe(rng.choice([0, 1, 50_000, 90_000])), maybe(80_000, 0.2), maybe(3, 0.2), NOW - timedelta(days=9), maybe(NOW - timedelta(hours=rng.randint(0, 60)), 0.5)) for i in range(120)]
    postings = []
    for i in range(150):
        first = NOW - timedelta(hours=rng.randint(0, 70))
        postings.append((i, maybe(" ".join(rng.sample(words, 3)).title(), 0.95), maybe(rng.choice(["Acme Corp", "AB", "other"]), 0.9), maybe(rng.sample("xyz", rng.randint(0, 2)), 0.9), maybe(rng.choice("stu"), 0.9), maybe(rng.choice(["remote", "onsite"]), 0.9), maybe(rng.randrange(120_000), 0.6), maybe(rng.randrange(120_000), 0.6), maybe(date(2024, 3, rng.randint(1, 10)), 0.8), first, min(NOW, first + timedelta(hours=rng.randint(0, 9))), first))
    return searches, postings


def fits(s, p, hours=48) -> bool:
    low, pay, least = (p[1] or "").lower(), p[7] if p[7] is not None else p[6], p[6] if p[6] is not None else p[7]
    since = s[12] or s[11]
    ok = [p[10] >= since, p[11] >= NOW - timedelta(hours=hours)]
    ok += [p[1] is not None and all(w.lower() in low for w in s[2].split())] if s[2] else []
    ok += [p[1] is not None and not any(w in low for w in s[3].split())] if s[3] else []
    ok += [p[2] is not None and s[4].lower() in p[2].lower()] if s[4] else []
    ok += [s[5] in (p[3] or [])] if s[5] else []
    ok += [p[4] == s[6]] if s[6] else []
    ok += [p[5] == s[7]] if s[7] else []
    ok += [pay is not None and pay >= s[8]] if s[8] is not None else []
    ok += [least is not None and least <= s[9]] if s[9] is not None else []
    ok += [p[8] is not None and p[8] >= NOW.date() - timedelta(days=s[10])] if s[10] is not None else []
    return all(ok)


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_equal_a_nested_loop(spark, seed):
    searches, postings = made(random.Random(seed))
    got = [(r.search_id, r.id) for r in alerts.matches(spark.createDataFrame(searches, SEARCH), spark.createDataFrame(postings, POSTING), str(NOW)).collect()]
    assert sorted(got) == sorted((s[0], p[0]) for s in searches for p in postings if fits(s, p)) and len(got) > 100


def test_digests_and_marks_over_sweeps(spark):
    searches, postings = made(random.Random(3))
    searches.append((500, 1, *[None] * 9, NOW - timedelta(days=9), None))
    users = spark.createDataFrame([(i, i != 2) for i in range(5)], "user_id int, alerts boolean")
    saved, jobs = spark.createDataFrame(searches, SEARCH), spark.createDataFrame(postings, POSTING)
    digests = alerts.sweep(saved, users, jobs, str(NOW))
    got: dict = {}
    for r in digests.collect():
        got.setdefault(r.search_id, {})[r.rank] = (r.id, r.more)
    for s in searches:
        want = sorted(((p[9], -p[0]) for p in postings if s[1] != 2 and fits(s, p)), reverse=True)
        assert got.get(s[0], {}) == {k + 1: (-i, max(0, len(want) - 10)) for k, (_, i) in enumerate(want[:10])}
    after = alerts.advance(saved, digests, str(NOW))
    marks = {r.search_id: r.last_alerted_at for r in after.collect()}
    assert marks == {s[0]: NOW if s[0] in got else s[12] for s in searches} and after.columns == saved.columns
    later = jobs.where("scanned_at < timestamp '2024-03-10 12:00:00'")
    again = alerts.sweep(after, users, later, str(NOW + timedelta(minutes=5)))
    assert {r.search_id for r in again.collect()} <= {s[0] for s in searches} - set(got)
    assert again.where("search_id = 500").isEmpty()
    assert alerts.sweep(saved.where("false"), users, jobs, str(NOW)).isEmpty() and alerts.sweep(saved, users, jobs.where("false"), str(NOW)).isEmpty()


def test_old_postings_that_were_scanned_again_are_not_new(spark):
    old, late = NOW - timedelta(days=30), NOW - timedelta(hours=1)
    rows = [(1, "A", "c", [], "s", "r", 1, 2, None, old, late, old), (2, "A", "c", [], "s", "r", 1, 2, None, late, late, NOW - timedelta(hours=30))]
    search = spark.createDataFrame([(1, 1, "a", *[None] * 8, NOW - timedelta(hours=2), None)], SEARCH)
    assert [r.id for r in alerts.matches(search, spark.createDataFrame(rows, POSTING), str(NOW)).collect()] == [2]


def test_a_sweep_makes_no_row_for_each_match(spark):
    from test_operators import joined_rows

    searches = [(i, 1, *[None] * 4, "s", None, i % 700, None, None, NOW - timedelta(days=9), None) for i in range(1_000)]
    postings = [(i, "A", "c", [], "s", "r", 400, 400, None, NOW - timedelta(minutes=i % 90), NOW, NOW) for i in range(400)]
    users = spark.createDataFrame([(1, True)], "user_id int, alerts boolean")
    digests = alerts.sweep(spark.createDataFrame(searches, SEARCH), users, spark.createDataFrame(postings, POSTING), str(NOW))
    rows = digests.collect()
    latest = sorted(range(400), key=lambda i: (i % 90, i))[:10]
    assert sorted((r.search_id, r["rank"], r.id, r.more) for r in rows) == [(s, k + 1, p, 390) for s in range(1_000) if s % 700 <= 400 for k, p in enumerate(latest)]
    assert joined_rows(spark, digests) < 20_000  # of 280,000 matches
