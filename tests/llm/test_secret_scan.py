"""Secret scans against plain Python: base patterns, the battery, the rule for false discoveries, planted keys."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.llm import secret_scan as scan

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def plain(text: str) -> list[tuple[int, int, int]]:
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


HARD = [
    "password=abcdefgh PASSWD : 'x.y/z+w=' token==abcdefg token=abcdefg secret  =  \"aaaaaaaa\" apikey:12345678 api_key'='12345678",
    'token=secret="abcdefghij" token=secret=abcdefghij tokentoken=aaaaaaaaa password"  :  "aaaaaaaa password\n=aaaaaaaaaa',
    "AKIA1234567890AB AKIA1234567890A AKIAAKIA12345678 xAKIA1234567890ABCDE AKIAKIA123456789 AKIA akia1234567890ab",
    "0123456789abcdef0123456789abcdef " + "a" * 31 + " " + "b" * 33 + " 0123456789ABCDEF0123456789ABCDEF G" + "0" * 32,
    "☃𝒳 token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff 𝒳 AKIA" + "Z" * 100,
    "token" + " " * 5000 + "x" + "token" * 2000 + "=",
    "=" * 3000 + "secret:" * 1000,
    "",
]


def test_base_spans_match_plain_patterns(spark, documents):
    texts = HARD + [r.text or "" for r in documents.select("text").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in scan.report(df).collect():
        want = plain(texts[r.doc_id])
        kinds = Counter(k for _, k, _ in want)
        listed = ",".join(f"{scan.KINDS[k]}:{lo}:{hi}" for lo, k, hi in want)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds[0], kinds[1], kinds[2])
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), texts[r.doc_id][:100]
        assert [s for s in r.spans.split(",") if s and not s.startswith("random")] == ([listed] if listed and len(want) == 1 else listed.split(",") if listed else [])


def upper(z: float) -> float:
    return max(math.erfc(z / math.sqrt(2)) / 2, 1e-300)


def plain_battery(run: str, counts: dict[str, int]):
    w = run.rstrip("=")
    if w.isdigit():
        return None
    alphabet = next((a for a, _ in scan.ENCODINGS if set(w) <= set(a)), None)
    if alphabet is None:
        return None
    n, k = len(w), len(alphabet)
    xs, m = [alphabet.index(c) for c in w], (k - 1) / 2
    chi = sum((w.count(c) - n / k) ** 2 / (n / k) for c in alphabet)
    u = 2 / (9 * (k - 1))
    t = -math.log(upper(((chi / (k - 1)) ** (1 / 3) - 1 + u) / math.sqrt(u)))
    changes = sum((a > m) != (b > m) for a, b in itertools.pairwise(xs))
    t -= math.log(min(1, 2 * upper(abs(changes - (n - 1) / 2) / math.sqrt((n - 1) / 4))))
    serial = sum((a - m) * (b - m) for a, b in itertools.pairwise(xs)) / ((k * k - 1) / 12)
    t -= math.log(min(1, 2 * upper(abs(serial) / math.sqrt(n - 1))))
    share = {b: sum(counts.get(a + b, 0) for a in alphabet) + 0.5 for b in alphabet}
    total = sum(share.values())
    share = {b: s / total for b, s in share.items()}
    bet = -math.log(share[w[0]] * k)
    for a, b in itertools.pairwise(w):
        row = sum(counts.get(a + c, 0) for c in alphabet)
        bet -= math.log((counts.get(a + b, 0) + k / 2 * share[b]) / (row + k / 2) * k)
    return math.exp(-t) * (1 + t + t * t / 2), min(0.0, -bet), n


def keys(rng: random.Random) -> list[str]:
    raw = lambda n: bytes(rng.randrange(256) for _ in range(n))
    pick = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    return [raw(12).hex(), raw(14).hex().upper(), base64.b32encode(raw(20)).decode(), base64.b64encode(raw(31)).decode(), base64.urlsafe_b64encode(raw(48)).decode(), pick(scan.LOWER + scan.DIGITS, 32), pick(scan.UPPER + scan.DIGITS, 28), pick(scan.LOWER + scan.UPPER + scan.DIGITS, 40)]


def test_battery_matches_plain_python(spark):
    rng = random.Random(4)
    runs = [k for _ in range(20) for k in keys(rng)] + ["0" * 20, "a" * 16, "z" * 4096, "0123456789abcdef" * 3, "1234567890123456", "usr_local/lib-python", "Donaudampfschifffahrt", "AAAAAAAAAAAAAAAAAAA==", "abcdefghijklmnopqrstuvwxyz"]
    counts = dict(Counter(a + b for t in HARD + ["the quick brown fox jumps over the lazy dog " * 50] for a, b in itertools.pairwise(t) if re.fullmatch("[A-Za-z0-9+/_-]{2}", a + b)))
    model = scan.Model(counts, [])
    got = spark.createDataFrame([(r,) for r in runs], "run string").select("run", scan.battery(F.col("run"), model).alias("t")).collect()
    for r in got:
        want = plain_battery(r.run, counts)
        if want is None:
            assert r.t is None
            continue
        assert r.t.length == want[2] and r.t.text == pytest.approx(want[1], rel=1e-6, abs=1e-6)
        assert r.t.random == pytest.approx(want[0], rel=1e-4, abs=1e-9)


def test_pairs_of_whole_texts(spark):
    long = "".join(random.Random(5).choice("ab_+ é") for _ in range(20_000))
    texts = [long, None, "", "a", "ab", "𝒳ab𝒳", "x\ny"]
    got = scan.pairs(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert got == dict(Counter(a + b for t in texts if t for a, b in itertools.pairwise(t) if re.fullmatch("[A-Za-z0-9+/_-]{2}", a + b)))


def test_cuts_follow_the_rule():
    """Rank by rank over the runs themselves; p-values are those of the bins' upper ends."""
    rng = random.Random(6)
    for _ in range(50):
        runs = [(rng.randrange(scan.CLASSES), rng.choice([0, 0, 0, rng.randrange(60), rng.randrange(400)])) for _ in range(rng.randrange(300))]
        got = scan.cuts([(s, b, n) for (s, b), n in Counter(runs).items()], 0.05)
        for size in range(scan.CLASSES):
            p = sorted(10 ** (-b / scan.BINS) if b else 1.0 for s, b in runs if s == size)
            limit = max((x for i, x in enumerate(p) if x < 1 and x <= 0.05 * (i + 1) / len(p)), default=-1)
            taken = [b for s, b in runs if s == size and b >= got[size]]
            assert len(taken) == sum(x <= limit for x in p)


@pytest.fixture(scope="module")
def planted(spark, documents):
    rng = random.Random(7)
    rows, want = [], {}
    for r in documents.collect():
        text, some = r.text or "", keys(rng)
        if r.doc_id % 4 == 0:
            key = some[r.doc_id // 4 % len(some)]
            rows.append((r.doc_id, f"{text} {key} and so on", "x"))
            want[r.doc_id] = (len(text) + 1, len(text) + 1 + len(key))
        else:
            rows.append((r.doc_id, f"{text} this_is-an/ordinary/path and-this-is-a-heading_of_words 2024010120240102", "x"))
    return spark.createDataFrame(rows, "doc_id long, text string, spans string"), want


def test_planted_keys_are_found_and_words_are_not(planted):
    df, want = planted
    got = {r.doc_id: [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("random")] for r in scan.report(df).collect()}
    found = sum(span in got[i] for i, span in want.items())
    lost = [t for t in (df.where(F.col("doc_id") == i).first().text[lo:hi] for i, (lo, hi) in want.items() if (lo, hi) not in got[i])]
    assert found >= 0.95 * len(want), lost
    assert sum(map(len, got.values())) == found
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in scan.remove(df).collect():
        assert r.spans == "x" and (r.doc_id in want or "ordinary/path" in r.text)
        for lo, hi in got[r.doc_id]:
            assert texts[r.doc_id][lo:hi] not in r.text and "[SECRET] and so on" in r.text


def test_tricky_rows(tricky, no_documents, spark):
    assert scan.report(tricky).count() == tricky.count() and {r.spans for r in scan.report(tricky).collect()} == {""}
    out = scan.remove(tricky)
    assert out.columns == tricky.columns and sorted(map(str, out.collect())) == sorted(map(str, tricky.collect()))
    assert scan.report(no_documents).collect() == [] and scan.remove(no_documents).collect() == []


def test_very_long_runs_and_many_secrets(spark):
    rng = random.Random(8)
    blob = "".join(rng.choice(scan.LOWER + scan.UPPER + scan.DIGITS) for _ in range(100_000))
    many = " ".join(f"token = {rng.randrange(16**40):040x}" for _ in range(20_000))
    df = spark.createDataFrame([(1, blob + "!" + "z" * 1_000_000), (2, many)] + [(10 + i, "plain words as they come in any text, over and over") for i in range(50)], "doc_id long, text string")
    got = {r.doc_id: r for r in scan.report(df).collect()}
    pieces = [tuple(map(int, s.split(":")[1:])) for s in got[1].spans.split(",")]
    assert pieces == [(lo, min(lo + scan.MOST, 100_000)) for lo in range(0, 100_000, scan.MOST)]
    assert got[2].n_assign == 20_000 and got[2].n_hex == 20_000 and got[20].spans == ""
