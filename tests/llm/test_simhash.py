from __future__ import annotations

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import simhash


def plain_fp(text: str | None, k: int = 3) -> int:
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps: list[int], radius: int) -> list[int]:
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(fps))]


def test_matches_brute_force(documents):
    rows = documents.select("doc_id", "text").collect()
    fps = {r.doc_id: plain_fp(r.text) for r in rows}
    ids = sorted(fps)
    want = dict(zip(ids, (ids[k] for k in plain_components([fps[i] for i in ids], 3)), strict=True))
    got = simhash.near_duplicates(documents).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.fp & (2**64 - 1) == fps[r.doc_id] and r.component_id == want[r.doc_id]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 9), st.lists(st.integers(1, 150), min_size=1, max_size=4), st.integers(0, 9))
def test_bit_slices_match_popcounts(radius, sizes, seed):
    rng = np.random.default_rng(seed)
    centre = rng.integers(0, 2**63, dtype=np.uint64)
    n = sum(sizes)
    flips = (rng.integers(0, 2**63, (n, 1), dtype=np.uint64) & rng.integers(0, 2**63, (n, 1), dtype=np.uint64) & rng.integers(0, 2**63, (n, 1), dtype=np.uint64)) & rng.integers(0, 2**63, (n, 1), dtype=np.uint64)
    fps = centre ^ flips
    got, at = simhash.within_groups(fps, np.array(sizes), radius), 0
    for s in sizes:
        want = plain_components([int(x) for x in fps[at : at + s, 0]], radius)
        assert [int(x) - at for x in got[at : at + s]] == want
        at += s


def test_wide_fingerprints():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, (1, 8), dtype=np.uint64)
    fps = np.repeat(base, 70, axis=0)
    fps[1:60, 3] ^= np.uint64(0b11111)  # five bits, equal among themselves
    fps[60:] = rng.integers(0, 2**63, (10, 8), dtype=np.uint64)
    assert set(simhash.within_groups(fps, np.array([70]), 5)[:60]) == {0}
    assert simhash.within_groups(fps, np.array([70]), 4)[:60].tolist() == [0] + [1] * 59
    assert simhash.within_groups(fps, np.array([70]), 5)[60:].tolist() == list(range(60, 70))


def test_full_buckets_are_refined_without_loss(spark):
    rng = np.random.default_rng(3)
    fps = sorted({int(x) for x in rng.integers(0, 2**10, 300)} | {int(x) << 20 for x in rng.integers(0, 2**20, 200)})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    labels = {r.node: r.label for r in simhash.link_fingerprints(df, 3, limit=20).collect()}
    want = plain_components(fps, 3)
    assert [labels.get(x, x) for x in fps] == [fps[k] for k in want]


def test_tricky_rows(tricky, no_documents):
    got = {r.doc_id: r for r in simhash.near_duplicates(tricky).collect()}
    assert got[3].fp == got[4].fp == got[5].fp == 0 and got[5].component_id == 3
    assert got[1].component_id == got[2].component_id == 1 and got[8].component_id == 8
    assert simhash.near_duplicates(tricky).count() == tricky.count()
    assert simhash.near_duplicates(no_documents).collect() == []
