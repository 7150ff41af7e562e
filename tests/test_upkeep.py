"""Presence on a stream against the batch form, and claims against a queue that hands out one URL at a time."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from tessella.operators import claims, maintenance
from tessella.streaming import state

START = datetime(2024, 5, 1)
REGISTRY = "source string, url string, last_seen_at timestamp, missing_since timestamp, closed_at timestamp"


def crawls_and_registry(rng: random.Random):
    registry, crawls = [], []
    for s, n in (("big", 70), ("small", 12), ("odd", 5)):
        urls = [f"{s}/{i:02}" for i in range(n)]
        for u in urls:
            at = START - timedelta(hours=rng.randint(1, 100))
            closed = rng.random() < 0.2
            registry.append((s, u, rng.choice([None, at]), at if closed or rng.random() < 0.3 else None, at if closed else None))
    at = START
    for _ in range(6):
        at += timedelta(minutes=rng.choice([20, 45, 90, 400, 1500]))
        for s, n in (("big", 70), ("small", 12), ("odd", 5)):
            listed = [f"{s}/{i:02}" for i in range(n) if rng.random() < rng.choice([0.2, 0.6, 0.95])]
            crawls.append((s, at, rng.random() < 0.8, rng.choice([listed, listed * 2])))
    return crawls, registry


@pytest.mark.parametrize("seed,splits", [(1, 2), (2, 5)])
def test_presence_stream_equals_the_batch_form(spark, tmp_path, seed, splits):
    rng = random.Random(seed)
    crawls, registry = crawls_and_registry(rng)
    want = spark.createDataFrame(registry, REGISTRY)
    for at in sorted({c[1] for c in crawls}):
        now = [(s, healthy, u) for s, t, healthy, urls in crawls if t == at for u in urls or [None]]
        want = spark.createDataFrame(maintenance.presence(want, spark.createDataFrame(now, "source string, healthy boolean, url string"), str(at)).collect(), REGISTRY)
    schema = "source string, at timestamp, healthy boolean, urls array<string>"
    cuts = sorted(rng.sample(range(1, len(crawls)), splits - 1))
    for k, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(crawls)], strict=True)):
        part = crawls[lo:hi] + (crawls[max(0, lo - 3) : lo] if k else [])  # some crawls are delivered again
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in{k}")
    state.use_state_store(spark)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    q = state.presence(stream, spark.createDataFrame(registry, REGISTRY)).writeStream.outputMode("update").format("memory").queryName(f"seen{seed}").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(s, u): (a, b, c) for s, u, a, b, c in registry}
    events = spark.table(f"seen{seed}").orderBy("at").collect()
    for r in events:
        got[r.source, r.url] = (r.last_seen_at, r.missing_since, r.closed_at)
    assert got == {(r.source, r.url): (r.last_seen_at, r.missing_since, r.closed_at) for r in want.collect()}
    assert {"seen", "missed", "closed", "reopened"} <= {r.event for r in events} and len({(r.source, r.url, r.at) for r in events}) == len(events)


def test_presence_stream_of_new_urls_and_empty_listings(spark, tmp_path):
    rows = [("s", START, True, ["a", "b"]), ("s", START + timedelta(hours=2), True, []), ("s", START + timedelta(hours=4), True, None), ("s", START + timedelta(days=100), False, ["b"]), (None, START, True, ["x"]), ("t", None, True, ["x"])]
    schema = "source string, at timestamp, healthy boolean, urls array<string>"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    state.use_state_store(spark)
    q = state.presence(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), forget_days=10).writeStream.outputMode("update").format("memory").queryName("fresh").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r.url, r.event) for r in spark.table("fresh").orderBy("at", "url").collect()]
    assert got == [("a", "new"), ("b", "new"), ("a", "missed"), ("b", "missed"), ("a", "closed"), ("b", "closed"), ("b", "reopened")]


NOW = datetime(2024, 5, 2)
URL = "id int, source string, status string, claimed_at timestamp, created_at timestamp"


def urls_of(rng: random.Random) -> list[tuple]:
    age = lambda: rng.choice([None, None, NOW - timedelta(seconds=rng.choice([100, 599, 600, 700]))])
    return [(i, rng.choice(["a", "b", "c", "nowhere", None]), rng.choice(["pending", "pending", "success"]), age(), NOW - timedelta(minutes=rng.randint(0, 5))) for i in range(200)]


def one_by_one(urls: list[tuple], caps: dict[str, int]) -> set[int]:
    """A queue that hands out one URL at a time until every source refuses."""
    held, given = {u[0]: u[3] for u in urls}, set()
    cutoff = NOW - timedelta(seconds=600)
    for s, cap in caps.items():
        mine = sorted((u[4], u[0]) for u in urls if u[1] == s and u[2] == "pending")
        while sum(held[i] is not None and held[i] > cutoff for _, i in mine) < cap:
            free = [i for _, i in mine if held[i] is None or held[i] <= cutoff]
            if not free:
                break
            held[free[0]] = NOW
            given.add(free[0])
    return given


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_claims_equal_a_queue(spark, tmp_path, seed):
    rng = random.Random(seed)
    urls, caps = urls_of(rng), {"a": rng.randint(0, 30), "b": 100, "c": rng.randint(1, 12), "idle": 3}
    df = spark.createDataFrame(urls, URL)
    sources = spark.createDataFrame([(s, c, s == "b") for s, c in caps.items()], "source string, cap int, official boolean")
    given = claims.allocate(df, sources, str(NOW))
    assert {r.id for r in given.collect()} == one_by_one(urls, caps)
    after = spark.createDataFrame(claims.claimed(df, given, str(NOW)).collect(), URL)
    assert claims.allocate(after, sources, str(NOW)).isEmpty() or "b" in {r.source for r in claims.allocate(after, sources, str(NOW)).collect()} and caps["b"] > 60
    first = {r.id for r in claims.claim_once(df, sources, f"{tmp_path}/claims", 7, str(NOW)).collect()}
    assert first == {r.id for r in given.collect()} == {r.id for r in claims.claim_once(after, sources, f"{tmp_path}/claims", 7, str(NOW)).collect()}
    assert [r.source for r in claims.waiting(df, sources).collect()] == ["b", "a", "c"]
    assert claims.allocate(df.where("false"), sources, str(NOW)).isEmpty() and claims.allocate(df, sources.where("false"), str(NOW)).isEmpty()
