"""Registrable domains, routing of URLs, and publication of what changed."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import hosts, publish

RULES = ["com", "uk", "co.uk", "*.ck", "!www.ck", "jp", "*.kobe.jp", "!city.kobe.jp", "blogspot.com"]


def plain(url: str) -> str | None:
    """Label by label: the longest rule, an exception before any."""
    rest = url.strip().split("//", 1)[-1]
    host = rest.split("/")[0].split("?")[0].split("#")[0].split("@")[-1].split(":")[0].lower().rstrip(".")
    labels, n, sure = host.split("."), 0, None
    for i in range(len(labels)):
        tail = ".".join(labels[i:])
        size = len(labels) - i
        if f"!{tail}" in RULES:
            sure = size - 1
        if tail in RULES:
            n = max(n, size)
        if i > 0 and f"*.{tail}" in RULES:
            n = max(n, size + 1)
    n = sure if sure is not None else n
    return ".".join(labels[-n - 1 :]) if n and len(labels) > n else None


def test_registrable_domains(spark, monkeypatch):
    rng = random.Random(1)
    urls = ["https://careers.rcw.com/jobs/1", "jobs.bbc.co.uk", "http://user:pw@A.B.Example.COM:8080/x?y#z", "a.ck", "x.a.ck", "www.ck", "b.www.ck", "city.kobe.jp", "x.city.kobe.jp", "x.y.kobe.jp", "kobe.jp", "com", "127.0.0.1", "localhost", "", "  ", "co.uk", "x.blogspot.com", "a.x.blogspot.com.", "//h.jp/p", "mailto:x@y.zz", "http://[::1]/"]
    urls += [".".join(rng.choices(["a", "www", "city", "x", "kobe"], k=rng.randrange(3))) + "." + rng.choice(["com", "co.uk", "ck", "kobe.jp", "jp", "zz"]) for _ in range(80)]
    urls = [u.lstrip(".") for u in urls]
    rules, df = spark.createDataFrame([(r,) for r in RULES], "rule string"), spark.createDataFrame([(u,) for u in urls * 2] + [(None,)], "url string")
    want = {u: plain(u) for u in urls}
    assert want["https://careers.rcw.com/jobs/1"] == "rcw.com" and want["jobs.bbc.co.uk"] == "bbc.co.uk" and want["b.www.ck"] == "www.ck" and want["a.ck"] is None
    for most in (hosts.BROADCAST, 0):
        monkeypatch.setattr(hosts, "BROADCAST", most)
        rows = hosts.registrable(df, rules).collect()
        assert {r.url: r.domain for r in rows} == want and len(rows) == len(want)


def test_routing(spark):
    rules = [
        {"priority": 5, "kind": "any", "host": "", "key": "path:1", "path": "^/careers/"}, {"priority": 1, "kind": "lever", "host": "jobs.lever.co", "key": "path:1"}, {"priority": 2, "kind": "green", "host": "greenhouse.io", "key": "for"},
        {"priority": 3, "kind": "green", "host": "greenhouse.io", "key": "path:1", "path": "^/[^/]+/jobs"}, {"priority": 4, "kind": "day", "host": "myworkdayjobs.com", "key": "label"}, {"priority": 4, "kind": "self", "host": "one.example", "key": "host"},
    ]
    cases = {
        "https://jobs.lever.co/acme/123?x=1": ("lever", "acme"), "https://jobs.lever.co/": None, "https://boards.greenhouse.io/embed?for=acme&x": ("green", "acme"), "https://boards.greenhouse.io/acme/jobs/1": ("green", "acme"), "https://greenhouse.io/acme": None,
        "https://acme.wd5.myworkdayjobs.com/en": ("day", "wd5"), "https://myworkdayjobs.com/en": None, "http://ONE.example:80": ("self", "one.example"), "http://notone.example/careers/x": ("any", "careers"), "http://x.y/z": None, "junk": None, "": None, None: None,
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string").select("url", hosts.route(F.col("url"), rules).alias("r"))
    assert {r.url: (r.r.kind, r.r.board) if r.r else None for r in df.collect()} == cases
    with pytest.raises(ValueError):
        hosts.route(F.col("url"), rules * 500)


def test_only_what_changed_is_written(spark, tmp_path):
    pages = lambda rows: spark.createDataFrame(rows, "shard int, path string, text string")
    now = spark.createDataFrame([], "shard int, digest string, date date")
    at, days, stamps = f"{tmp_path}/site", [], []
    first = [(1, "/a", "x"), (1, "/b", None), (2, "/c", "y"), (3, "/d", "z")]
    for day, rows in (("2024-01-01", first), ("2024-01-02", first[::-1]), ("2024-01-03", [*first[:2], (2, "/c", "new"), (4, "/e", "")])):
        digests = publish.shard_digests(pages(rows), "shard", ["path"], ["path", "text"])
        told = publish.manifest(digests, now, "shard", day).cache()
        publish.write_changed(pages(rows), told, at, "shard")
        now = told.where("status <> 'gone'").select("shard", "digest", "date")
        days.append({r.shard: (str(r.date), r.status) for r in told.collect()})
        stamps.append({p.name: max(f.stat().st_mtime_ns for f in p.iterdir()) for p in (tmp_path / "site").glob("shard=*")})
    assert days[0] == {1: ("2024-01-01", "new"), 2: ("2024-01-01", "new"), 3: ("2024-01-01", "new")}
    assert days[1] == {1: ("2024-01-01", "same"), 2: ("2024-01-01", "same"), 3: ("2024-01-01", "same")} and stamps[0] == stamps[1]
    assert days[2] == {1: ("2024-01-01", "same"), 2: ("2024-01-03", "changed"), 3: ("2024-01-01", "gone"), 4: ("2024-01-03", "new")}
    assert stamps[2]["shard=1"] == stamps[0]["shard=1"] and stamps[2]["shard=2"] > stamps[0]["shard=2"]
    assert sorted((r.shard, r.path, r.text) for r in spark.read.parquet(at).where("path IS NOT NULL").collect()) == [(1, "/a", "x"), (1, "/b", None), (2, "/c", "new"), (4, "/e", "")]
    assert [tuple(r) for r in spark.read.parquet(at).where("shard = 3").collect()] == [(None, None, 3)]


def test_digests_and_families(spark):
    df = spark.createDataFrame([("a", "b"), ("ab", ""), ("a", None), (None, "a"), ("1:a", "b")], "x string, y string")
    assert len({r.d for r in df.select(publish.digest(F.col("x"), F.col("y")).alias("d")).collect()}) == 5
    paths = spark.createDataFrame([("/jobs/a",), ("/job/b",), ("/jobs/c",), ("/sitemap.xml",), ("/",)], "path string")
    assert sorted(r.path for r in publish.families(paths, "path", ["/jobs/", "/job/"]).collect()) == ["/", "/job/*", "/jobs/*", "/sitemap.xml"]
    assert publish.families(paths, "path", []).count() == 5
