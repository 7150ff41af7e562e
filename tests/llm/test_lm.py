from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessella.llm import lm


def brute(train: list[str], texts: list[str]):
    """Interpolated modified Kneser-Ney bigrams with plain dictionaries."""
    docs = [[w.decode() for w in t.encode().lower().split()] + ["</s>"] for t in train]
    uni = Counter(w for d in docs for w in d)
    bi = Counter(p for d in docs for p in zip(["<s>", *d], d, strict=False))
    before, after = defaultdict(int), defaultdict(list)
    for (a, b), c in bi.items():
        before[b] += 1
        after[a].append(c)

    def discounts(counts):
        t = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
        if min(t[:3]) == 0:
            return [0, 0.5, 1.0, 1.5]
        y = t[0] / (t[0] + 2 * t[1])
        return [0, *(min(max(k - (k + 1) * y * t[k] / t[k - 1], 0), k) for k in (1, 2, 3))]

    up, low = discounts(bi.values()), discounts(before.values())
    kinds = len(bi)
    rest_low = sum(low[min(c, 3)] for c in before.values()) / kinds if kinds else 1.0

    def prob(a, b):
        p = (before[b] - low[min(before[b], 3)]) / kinds if b in before else 0.0
        p += rest_low / (len(before) + 1)
        if a in after:
            total, c = sum(after[a]), bi[a, b]
            p = max(c - up[min(c, 3)], 0) / total + sum(up[min(x, 3)] for x in after[a]) / total * p
        return p

    n, v = sum(uni.values()), len(uni)
    out = []
    for t in texts:
        d = [w.decode() for w in t.encode().lower().split()] + ["</s>"]
        out.append((len(d), sum(uni[w] > 0 for w in d), n, sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in d), sum(math.log10(prob(a, b)) for a, b in zip(["<s>", *d], d, strict=False))))
    return out, prob, before


def held(i):
    return zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 1


def test_matches_brute_force(documents):
    rows = documents.select("doc_id", "text").collect()
    want, _, _ = brute([r.text or "" for r in rows if not held(r.doc_id)], [r.text or "" for r in rows])
    got = {r.doc_id: r for r in lm.score_held_out(documents).collect()}
    for r, w in zip(rows, want, strict=True):
        g = got[r.doc_id]
        assert g.held_out == held(r.doc_id)
        assert (g.n_tokens, g.n_known, g.train_tokens) == w[:3]
        assert g.base_score == pytest.approx(w[3], rel=1e-9) and g.score == pytest.approx(w[4], rel=1e-9)


def test_probabilities_sum_to_one(spark):
    train = ["a b a c a b", "b a d", "c c a b d", "a"]
    model = lm.train(spark.createDataFrame([(t,) for t in train], "text string"))
    _, prob, before = brute(train, [])
    for ctx in ("<s>", "a", "b", "never"):
        assert sum(prob(ctx, w) for w in before) + prob(ctx, "unknown") == pytest.approx(1)
    h, starts = lm.hashes([b"a zzz b"])
    logp, _ = model.score(h, starts)
    assert logp[0] == pytest.approx(math.log10(prob("<s>", "a"))) and logp[1] == pytest.approx(math.log10(prob("a", "zzz")))


def brute_of_order(train: list[str], order: int):
    """Interpolated modified Kneser-Ney of any order with plain dictionaries: (probability of a word after a history, known words)."""
    grams = [Counter() for _ in range(order + 1)]
    for t in train:
        d = ["<s>"] * (order - 1) + t.lower().split() + ["</s>"]
        grams[order].update(tuple(d[i : i + order]) for i in range(len(d) - order + 1))
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])

    def discounts(counts):
        t = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
        if min(t[:3]) == 0:
            return [0, 0.5, 1.0, 1.5]
        y = t[0] / (t[0] + 2 * t[1])
        return [0, *(min(max(k - (k + 1) * y * t[k] / t[k - 1], 0.01), k) for k in (1, 2, 3))]

    d = [None] + [discounts(g.values()) for g in grams[1:]]
    after = [defaultdict(list) for _ in range(order + 1)]
    for k in range(1, order + 1):
        for g, c in grams[k].items():
            after[k][g[:-1]].append(c)

    def prob(history: tuple, w: str) -> float:
        p = 1.0 / (len(grams[1]) + 1)
        for k in range(1, order + 1):
            ctx = tuple(history[len(history) - k + 1 :]) if k > 1 else ()
            counts = after[k].get(ctx)
            if counts:
                c = grams[k][(*ctx, w)]
                p = max(c - d[k][min(c, 3)], 0) / sum(counts) + sum(d[k][min(x, 3)] for x in counts) / sum(counts) * p
        return p

    return prob, [g[0] for g in grams[1]]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_any_order_matches_brute_force(spark, order):
    rng = np.random.default_rng(order)
    make = lambda: " ".join(rng.choice(list("abcdefgh"), rng.integers(0, 12), p=[0.3, 0.2, 0.15, 0.1, 0.1, 0.05, 0.05, 0.05]))
    train, texts = [make() for _ in range(300)], [make() + extra for extra in ("", " zzz a b", " a a a a") for _ in range(5)] + [""]
    model = lm.train(spark.createDataFrame([(t,) for t in train], "text string").repartition(3), order=order)
    prob, known = brute_of_order(train, order)
    assert model.order == order and model.types == len(known) and model.total == sum(len(t.split()) + 1 for t in train)
    for history in (("<s>",) * (order - 1), ("a", "b", "a")[-order + 1 :], ("never", "a", "never")[-order + 1 :]):
        assert sum(prob(history, w) for w in [*known, "unknown"]) == pytest.approx(1)
    h, starts = lm.hashes([t.encode() for t in texts])
    logp, count = model.score(h, starts)
    want = []
    for t in texts:
        d = ["<s>"] * (order - 1) + t.split() + ["</s>"]
        want += [math.log10(prob(tuple(d[i - order + 1 : i]), d[i])) for i in range(order - 1, len(d))]
    assert logp == pytest.approx(want, rel=1e-9)


def test_third_order_on_documents(documents):
    """Held-out texts are likelier under trigrams than under the unigram base."""
    rows = lm.score_held_out(documents, order=3).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_tricky_rows(tricky, no_documents):
    rows = lm.score_held_out(tricky).collect()
    assert len(rows) == tricky.count() and all(np.isfinite(r.score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4, 5)} == {1}
    assert lm.score_held_out(no_documents).collect() == []


def test_untrained_model_is_uniform(spark, no_documents, tricky):
    model = lm.train(no_documents)
    assert lm.score(tricky.where("doc_id = 3"), model, ["doc_id"]).first().score == 0


def test_counts_beyond_four_bytes(tmp_path):
    from tessella.llm import hashstore

    assert lm.narrow([np.array([2**32 - 1])]) == "<u4" and lm.narrow([np.array([1]), np.array([2**32])]) == "<i8" and lm.narrow([]) == "<u4"
    keys, big = np.array([1, 2], np.uint64), np.array([5, 2**40])
    hashstore.write_shard(str(tmp_path), 0, keys, [big.astype(lm.narrow([big]))])
    store = hashstore.HashStore(str(tmp_path), 1, ["<u4"], {0: 2}, frozenset([0]))
    found, (got,) = store.lookup(np.array([2, 3], np.uint64))
    assert found.tolist() == [True, False] and got.tolist() == [2**40, 0]
