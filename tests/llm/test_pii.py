from __future__ import annotations

import hashlib
import re

import pytest

from tessella.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text: str) -> list[tuple[int, int, int]]:
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


HARD = [
    "a@b.c@d.e x_a@b.c-d.e..f@g.h.i a@b a@@b.c ü@x.de .@.-.a a.b@c.d_e@f.g",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3 0000255.1.1.1 1.2.3.4444 9.9.9.99999999999999",
    "4111 1111 1111 1111, 4111-1111-1111-1111 41111111111111112 4111  1111 1111 1111 1 4111 1111 1111 1111 - 5",
    "0000 0000 0000 " + "1 " * 3000 + "79927398713 0",
    "+1 (988) 555-2485, +49.30.123456-7 +1 2 +123456789012345678 +1+2345678901 ++12345678 9",
    "☃𝒳 mail: x@y.zz 𝒳 10.0.0.1 ☃ 4012888888881881 𝒳+44 20 7946 0958",
    "",
]


def test_base_spans_match_plain_patterns(spark, documents):
    texts = HARD + [r.text or "" for r in documents.select("text").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find(df).collect():
        assert [(s.start, s.k, s.end) for s in r.base] == plain(texts[r.doc_id]), texts[r.doc_id][:200]


def test_report_digest(spark):
    text = "write a@b.cc or 10.0.0.1"
    r = pii.report(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert (r[0].n_email, r[0].n_ip, r[0].n_card, r[0].n_phone) == (1, 1, 0, 0)
    assert r[0].spans == "email:6:12,ip:16:24" and r[0].base_sha256 == hashlib.sha256(r[0].spans.encode()).hexdigest()
    assert r[1].spans == "" and r[1].base_sha256 == hashlib.sha256(b"").hexdigest()


@pytest.fixture(scope="module")
def told(spark):
    rows = [(i, f"number {i} says that Zebulon writes from z@q.org to the team number {i}") for i in range(4)]
    rows += [(10 + i, f"the team says number {i} and that is all") for i in range(60)]
    rows += [(90 + i, "the same text names Quimby at w@q.org") for i in range(5)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_terms_that_reveal_an_entity(told):
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.sanitise(told.selectExpr("*", "0 AS n_chars")).collect()}
    text = "number 0 says that  writes from [EMAIL] to the team number 0"
    assert "Zebulon" not in got[0][0] and "[EMAIL]" in got[0][0] and "team" in got[0][0] and got[0][1] == len(got[0][0])
    assert len(got[0][0]) <= len(text)
    assert got[10] == ("the team says number 0 and that is all", 0)
    assert got[90][0] == "the same text names Quimby at [EMAIL]"  # copies of one text prove nothing


def test_shares_match_brute_force(told):
    import math

    rows = told.collect()
    n = len(rows)
    has = lambda w: sum(w in r.text.lower().split() for r in rows)
    share = {w: math.log(4 * n / (has(w) * 4)) / math.log(n / 4) for w in ("zebulon", "writes", "says", "team", "number")}
    out = pii.find(told).where("doc_id = 0").first()
    text = rows[0].text
    words = {text[s.start : s.end].lower() for s in out.added}
    assert {w for w, s in share.items() if s >= pii.GENERALISE} == words & set(share)


def test_terms_count_wherever_they_stand(spark, monkeypatch):
    far = " ".join(["the team says that"] * 20)
    rows = [(i, f"{i} Zebulon R2D2 {far} mail z@q.org {far} asks Zebulon, zebulon R2D2 xZebulon{i}") for i in range(4)]
    rows += [(10 + i, f"{far} number {i}") for i in range(2000)] + [(5000, "no address but Zebulon here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for few in (pii.BROADCAST, 0):
        monkeypatch.setattr(pii, "BROADCAST", few)
        got = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
        assert len(got) == len(rows)
        for i in range(4):
            words = got[i].replace(",", "").split()
            assert not {"Zebulon", "zebulon", "R2D2"} & set(words) and f"xZebulon{i}" in words and words.count("team") == 40
        assert "Zebulon" not in got[5000] and got[5000].startswith("no address but ")
        assert all(got[i] == t for i, t in rows if 10 <= i < 5000)


def names_of(kind: int, hit: str) -> set:
    digits = re.sub("[^0-9]", "", hit)
    group = (hit.split("@")[-1].lower(), ".".join(hit.split(".")[:2]), digits[:6], digits[:4])[kind]
    return {(kind, hit), (kind, "group", group), (kind, "kind")}


def test_learnt_terms_of_real_documents_match_brute_force(spark, documents):
    """Every pair of entity and term over whole texts, at a low support so that there are some."""
    import math
    from collections import Counter, defaultdict

    made = [(10**6 + i, f"note {i} from Zorblatt of Quux corp at u{i}@quux.org {'and so on ' * (i % 3)}") for i in range(6)]
    rows = [(r.doc_id, r.text or "") for r in documents.select("doc_id", "text").collect()] + made
    n, n_e, n_t = len(rows), Counter(), Counter()
    n_te, texts_te, texts_e = Counter(), defaultdict(set), defaultdict(set)
    for _, t in rows:
        base, masked = plain(t), list(t.replace("\u0001", " "))
        for lo, _, hi in base:
            masked[lo:hi] = "\u0001" * (hi - lo)
        words = {w.lower() for w in re.findall(r"[^\W_]+", t)}
        n_t.update(words)
        own = set().union(*(names_of(k, t[lo:hi]) for lo, k, hi in base)) if base else set()
        n_e.update(own)
        around = {w.lower() for w in re.findall(r"(?:\x01|[^\W_])+", "".join(masked)) if "\u0001" not in w}
        for e in own:
            texts_e[e].add(t)
            for w in around:
                n_te[e, w] += 1
                texts_te[e, w].add(t)
    for support in (2, 3):
        want = Counter()
        for (e, w), k in n_te.items():
            before = n_e[e] / n
            told = (k + before) / (max(n_t[w], k) + 1)
            share = math.log(told / before) / -math.log(before)
            if len(texts_te[e, w]) >= support and len(texts_e[e]) >= support and share >= pii.GENERALISE and told >= pii.CERTAIN:
                want[w, round(share, 9)] += 1
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = Counter((r.term, round(r.share, 9)) for r in pii.disclosing(df, pii.analyse(df), support=support).collect())
        assert got == want and {"zorblatt", "quux"} <= {w for w, _ in got}


def test_very_many_identifiers_in_one_text(spark):
    text = " ".join(f"u{i}@h{i % 7}.org w{i % 50}" for i in range(100_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = pii.report(df).first()
    assert r.n_email == 100_000 and r.base_sha256 == hashlib.sha256(",".join(f"email:{lo}:{hi}" for lo, _, hi in plain(text)).encode()).hexdigest()
    assert pii.sanitise(df).first().text == EMAIL.sub("[EMAIL]", text)


def test_terms_are_generalised_to_their_class(spark):
    """A share between the bounds: terms that most texts of an entity have, and some others."""
    filler = [f"quiet text number {i} about nothing at all" for i in range(400)]
    rows = [f"{w} says hello from m{i}@q.org today {i}" for i, w in enumerate(["Zebulon 8841 R2D2 zoltan"] * 4)] + ["Zebulon 8841 R2D2 zoltan without any address"] * 2 + filler
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    out = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert out[4].text == "[NAME] [NUMBER] [CODE] [WORD] without any address"
    assert out[0].text.startswith("[NAME] [NUMBER] [CODE] [WORD]") and out[10].text == rows[10]


def test_logs_that_share_thousands_of_addresses(spark):
    """Three texts of 5,000 common identifiers and 3,000 words: the identifiers are one class, and the pairs stay few."""
    ids = " ".join(f"u{i}@h{i}.org" for i in range(5000))
    rows = [(i, f"{ids} " + " ".join(f"w{k}" for k in range(3000 + 100 * i))) for i in range(3)] + [(10 + i, f"plain text {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = pii.checkpoint(pii.analyse(df))
    classes = pii._classes(texts, 3)
    assert classes.count() == 10_001 and classes.select("of").distinct().count() == 1
    told = pii.disclosing(df, texts)
    assert told.select("term").distinct().count() == 3000 and told.select("entity").distinct().count() == 10_001


def test_tricky_rows(tricky, no_documents):
    out = pii.sanitise(tricky)
    assert out.columns == tricky.columns and sorted(map(str, out.collect())) == sorted(map(str, tricky.collect()))
    assert pii.report(tricky).count() == tricky.count()
    assert pii.report(no_documents).collect() == [] and pii.sanitise(no_documents).collect() == []
