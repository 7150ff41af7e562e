"""Decontamination, toxicity, sharding and archives."""

from __future__ import annotations

import hashlib
import io
import itertools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard as zstd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import decontam, sharding, toxicity, warc

SF = "/root/testdata/sf0.001"


def plain_words(text: str | None) -> list[bytes]:
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", raw)


def brute(doc: list, items: dict, width: int) -> tuple[set, set]:
    hit, names = set(), set()
    for name, ws in items.items():
        windows = [ws[i : i + width] for i in range(len(ws) - width + 1)] if len(ws) >= width else [ws] if ws else []
        for w in windows:
            for i in range(len(doc) - len(w) + 1):
                if doc[i : i + len(w)] == w:
                    hit |= set(range(i, i + len(w)))
                    names.add(name)
    return hit, names


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=9), max_size=6), st.lists(st.sampled_from([b"a", b"b", b"c", b"x"]), max_size=40), st.integers(1, 5))
def test_automaton_matches_brute_force(items, doc, width):
    named = {f"i{k}": ws for k, ws in enumerate(items)}
    auto = decontam.SuffixAutomaton([(k, ws) for k, ws in named.items() if ws], width)
    spans, hit, _ = auto.scan(doc)
    want, names = brute(doc, named, width)
    assert {i for lo, hi in spans for i in range(lo, hi)} == want
    assert {auto.names[k] for k in hit} == names
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_report(spark, documents):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {str(r.item_id): plain_words(r.text) for r in bench.collect()}
    items["short"] = [b"with", b"the"]
    more = bench.selectExpr("CAST(item_id AS STRING) AS item_id", "text").union(spark.createDataFrame([("short", "With, THE!"), ("none", " .. "), ("null", None)], "item_id string, text string"))
    for limit in (400_000, 300):  # one automaton, and several
        got = {r.doc_id: r for r in decontam.report(documents, more, limit=limit).collect()}
        for r in documents.collect():
            doc = plain_words(r.text)
            hit, names = brute(doc, items, 10)
            g = got[r.doc_id]
            assert (g.n_words, g.n_hit, g.n_items, g.contaminated) == (len(doc), len(hit), len(names), bool(hit))
            assert g.items_sha256 == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def test_long_items_are_cut_without_losing_windows(spark):
    words = [f"w{i}" for i in range(500)]
    bench = spark.createDataFrame([("long", " ".join(words)), ("long", " ".join(words)), (None, "so short"), ("few", "w1 w2 w3")], "item_id string, text string")
    docs = spark.createDataFrame([(k, "x " + " ".join(words[k : k + 10]) + " y so short") for k in range(0, 491)] + [(1000, " ".join(words)), (1001, " ".join(words[7:16]))], "doc_id long, text string")
    for limit in (400_000, 240, 8):
        got = {r.doc_id: (r.n_hit, r.n_items) for r in decontam.report(docs, bench, limit=limit).collect()}
        assert got[0] == (12, 2) and got[1] == (12, 2) and all(got[k] == (12, 1) for k in range(2, 491))
        assert got[1000] == (500, 2) and got[1001] == (0, 0)


def test_clean(spark, tricky, no_documents):
    passage = " ".join(f"w{i}" for i in range(30))
    bench = spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string")
    rows = [(1, "Before, " + passage.upper() + "! After " + "and on " * 40, 9), (2, "x " + passage, 5), (3, "clean", 5), (4, None, 0)]
    got = {r.doc_id: (r.text, r.n_chars) for r in decontam.clean(spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), bench).collect()}
    assert got[1] == ("Before, ! After " + "and on " * 40, len("Before, ! After " + "and on " * 40))
    assert 2 not in got and got[3] == ("clean", 5) and got[4] == (None, 0)
    assert sorted(map(str, decontam.clean(tricky, bench).collect())) == sorted(map(str, tricky.collect()))
    assert decontam.clean(no_documents, bench).collect() == [] and decontam.report(tricky, bench.where("false")).where("contaminated").count() == 0


def test_clean_has_one_worker_a_task(spark, documents):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    plan = decontam.clean(documents, bench)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1, plan


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(0)
    logp = np.log(rng.dirichlet(np.ones(toxicity.N), size=(toxicity.N, toxicity.N)))
    ways = toxicity.lattice("a1$$b0*")

    def all_paths(k, a, b, score, text):
        if k == len(ways):
            yield score + logp[a, b, 0], text
            return
        for codes, cost in ways[k]:
            x, y, s = a, b, score - cost
            for c in codes:
                s += logp[x, y, c]
                x, y = y, c
            yield from all_paths(k + 1, x, y, s, text + "".join(toxicity.TO_CHAR[c] for c in codes))

    assert toxicity.decode(ways, logp) == max(all_paths(0, 0, 0, 0.0, ""))[1]


@pytest.fixture(scope="module")
def taught(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice(("ba", "lo", "ti", "mer", "sun", "ke")) for _ in range(rng.randrange(2, 4))) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(40)]
        if i % 6 == 0:
            text[rng.randrange(40)] = rng.choice(("grumbel", "snotface", "wrackling"))
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 6 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_held_out(taught):
    docs, labels = taught
    got = toxicity.score_held_out(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(r.predicted == int(r.doc_id % 6 == 0) and 0 <= r.score <= 1 for r in held)


def test_weights_are_fitted_on_all_labelled_rows(spark):
    """At its optimum a logistic model's mean score is the share of toxic rows, over the rows that it was fitted on."""
    n = 40_000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat_ws(' ', IF(id % 9 = 0, 'grumbel', 'timer'), IF(id % 7 = 0, 'wrackling', 'balo')) AS text")
    chance = "pmod(xxhash64(id, 'toxic'), 1000) < CASE WHEN id % 9 = 0 AND id % 7 = 0 THEN 700 WHEN id % 9 = 0 THEN 400 WHEN id % 7 = 0 THEN 300 ELSE 40 END"
    labels = spark.range(n).selectExpr("id AS doc_id", f"CAST({chance} AS INT) AS toxic")
    model = toxicity.train(docs, labels)
    mean = toxicity.score(docs, model, ["doc_id"]).agg(F.avg("score")).first()[0]
    assert len(model.weights) > 2 and mean == pytest.approx(labels.agg(F.avg("toxic")).first()[0], rel=1e-3)


def test_disguised_words_are_restored(taught):
    docs, labels = taught
    model = toxicity.train(docs, labels)
    for text in ("you gr0mb3l grumb3l", "a sn0tf4ce", "g r u m b e l", "w.r.a.c.k.l.i.n.g", "snooootface!", "$notf@ce"):
        assert model.score(text) >= 0.5, text
    for text in ("", "balo timer 2024", "3rd of 10 sun-ke", "mail a1@b2.cc", "a b c"):
        assert model.score(text) < 0.5, text


def test_toxicity_of_tricky_rows(taught, tricky, no_documents):
    docs, labels = taught
    model = toxicity.train(docs, labels)
    out = toxicity.score(tricky, model, ["doc_id", "source"])
    assert out.count() == tricky.count() and out.where("score IS NULL").count() == 0
    assert toxicity.score_held_out(no_documents, labels).collect() == []
    assert len(toxicity.score_held_out(docs, labels.where("toxic = 0")).where("predicted = 0").collect()) == 600
    assert toxicity.score_held_out(tricky, labels.where("false")).count() == tricky.count()


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000])
def test_feistel(n):
    f = sharding.Feistel(n, 5)
    p = f.forward(np.arange(n))
    assert sorted(p) == list(range(n)) and (f.backward(p) == np.arange(n)).all()


def test_sharding(spark, documents, tricky, no_documents):
    for df in (documents, tricky, documents.repartition(7).unionByName(documents.limit(3))):
        rows = sharding.shard_rows(df).collect()
        assert len(rows) == df.count() and sorted(r.row_number for r in rows) == list(range(len(rows)))
        counts = Counter(r.shard for r in rows)
        assert max(counts.values()) - min(counts.get(s, 0) for s in range(16)) <= 1
        for s, n in counts.items():
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    text = {r.doc_id: (r.text or "").encode() for r in documents.collect()}
    a, b = (sorted(map(tuple, sharding.shard_rows(x).collect())) for x in (documents, documents.repartition(5)))
    assert a == b and all(r[1] == len(text[r[0]]) + 1 and r[2] == zlib.crc32(text[r[0]]) for r in a)
    assert sharding.shard_rows(no_documents).collect() == []


def test_archives(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    big = "é" * 600
    more = spark.createDataFrame([(9001, "u", big), (9003, None, big), (9002, "u\r\nX: y", big), (9004, "u", "small"), (9005, "u", "small"), (9006, "u", None), (9007, "u", ""), (None, "u", big), (9003, None, big)], "page_id long, url string, html string")
    df = pages.unionByName(more)
    rows = df.collect()
    best: dict = {}
    for r in rows:
        body = (r.html or "").encode()
        if len(body) >= 1000 and r.page_id is not None:
            best[body] = max(best.get(body, -1), r.page_id)
    want = sorted(str((r.page_id, len(b := (r.html or "").encode()), hashlib.sha1(b).hexdigest(), *(("response", None) if len(b) < 1000 or best.get(b) == r.page_id else ("revisit", best[b])))) for r in rows)
    manifest = warc.write(df, archive_bytes=20_000)
    assert manifest.count() > 2
    back = warc.read(manifest)
    assert sorted(str(tuple(r)) for r in back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == want
    whole = {r.page_id: r.html for r in rows}
    assert all(r.payload == (whole[r.page_id] or "") for r in back.where("record_type = 'response'").collect())
    assert warc.read(warc.write(df.where("false"))).collect() == []


def test_broken_archives():
    good = warc.record(1, "http://a", b"x" * 50, hashlib.sha1(b"x" * 50).hexdigest(), None, "2026-01-01T00:00:00Z")
    assert warc.parse(good)["payload"] == b"x" * 50
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WURC/1.1"), good.replace(b"xxxx", b"xxxy", 1), good.replace(b"Content-Length: 50", b"Content-Length: 51"), good.replace(b"WARC-Date", b"WARC-Data"), good.replace(b"sha1:", b"md5:"), b""):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)
    samples = [f"record {i} of many like it, with text {i * 7}".encode() * 20 for i in range(200)]
    words = warc.train_dictionary(samples)
    packer = zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(words))
    archive = warc.leading_frame(words) + b"".join(packer.compress(s) for s in samples)
    assert list(warc.read_archive(io.BytesIO(archive))) == samples
    plain = zstd.ZstdCompressor().compress(b"no dictionary")
    assert list(warc.read_archive(io.BytesIO(plain))) == [b"no dictionary"] and list(warc.read_archive(io.BytesIO(b""))) == []
    for bad in (archive[:-3], archive[:20], archive[: len(warc.leading_frame(words))] + b"junk here"):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(io.BytesIO(bad)))


def test_many_copies_of_one_row_are_numbered_in_parts(spark):
    df = spark.range(5000).selectExpr("CAST(NULL AS BIGINT) AS a", "'x' AS b").union(spark.range(300).selectExpr("id AS a", "'y' AS b"))
    for parts in (1, 7, sharding.PARTS):
        out, total = sharding.number_rows(df, parts=parts)
        rows = out.collect()
        assert total == 5300 and sorted(r.row_number for r in rows) == list(range(5300))
        assert sorted(r.row_number for r in rows if r.b == "x") == list(range(min(r.row_number for r in rows if r.b == "x"), min(r.row_number for r in rows if r.b == "x") + 5000))


def test_long_disguised_words_are_restored(documents):
    logp = toxicity.char_model(sum(toxicity.trigram_counts([r.text or ""]) for r in documents.select("text").collect()))
    long = "w" + "o" * 200 + "rd"
    assert toxicity.restore(long, logp) in ("word", "woord")
    run = " ".join("the and that " * 20).replace("   ", " ")
    assert len(toxicity.set_apart(run, logp)) >= 1 and max(map(len, toxicity.set_apart(run, logp))) <= 260


def test_signs_at_the_ends_of_a_word():
    """As the patterns say it: a repeated sign at either end goes, with the punctuation around it."""
    adorned = re.compile(r"^(\W)\1+|(\W)\2+$")
    for n in range(1, 6):
        for t in itertools.product("a!@_.", repeat=n):
            word = "".join(t)
            assert toxicity.core(word) == adorned.sub("", word.strip(toxicity.EDGE)).strip(toxicity.EDGE), word


def test_long_tokens_take_linear_time(documents):
    logp = toxicity.char_model(sum(toxicity.trigram_counts([r.text or ""]) for r in documents.limit(20).select("text").collect()))
    n = 1 << 20
    for token in ("a" + "!" * n + "a", "ab" * (n // 2) + "-x", "@" * n, "a" + "-" * n, "x" * n + "1", "<" * n + "a", "!" * n):
        began = time.monotonic()
        toxicity.restore(token, logp)
        assert time.monotonic() - began < 20, token[:3]


def test_letters_of_other_scripts_that_look_latin(taught):
    model = toxicity.train(*taught)
    for word in ("b\u0430d", "\u0441ode", "t\u0435xt"):
        assert toxicity.restore(word, model.logp) == word.translate(toxicity.HOMOGLYPHS)
    assert toxicity.restore("\u0441\u043e\u0431\u0430\u043a\u0430", model.logp) == "\u0441\u043e\u0431\u0430\u043a\u0430"


def test_scores_equal_a_plain_computation_and_tell_held_out_labels(spark):
    """Scores word by word without memos, and the area under the curve of labels that were never read."""
    import math

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.withColumn("held", toxicity.fold("doc_id", 5) == 0)
    model = toxicity.train(rows.where("NOT held"), labels)
    scored = {r.doc_id: r.score for r in toxicity.score(rows.where("held"), model, ["doc_id"]).collect()}

    def plain(text: str) -> float:
        words = {toxicity.restore(w, model.logp) for w in text.lower().split()} | toxicity.set_apart(text.lower(), model.logp)
        keys = {k for w in words if w for k in toxicity.features(w)}
        return 1 / (1 + math.exp(-max(min(model.bias + math.fsum(model.weights.get(k, 0.0) for k in keys), 700), -700)))

    some = rows.where("held").limit(150).collect()
    assert all(scored[r.doc_id] == pytest.approx(plain(r.text or ""), rel=1e-12) for r in some)
    truth = {r.doc_id: r.toxic for r in labels.where("toxic IS NOT NULL").collect()}
    bad, fine = ([scored[i] for i in scored if truth.get(i) == k] for k in (1, 0))
    auc = sum((x > y) + (x == y) / 2 for x in bad for y in fine) / (len(bad) * len(fine))
    assert auc >= 0.95 and sum(x >= 0.5 for x in bad) >= 0.8 * len(bad) and sum(x >= 0.5 for x in fine) <= 0.02 * len(fine)
