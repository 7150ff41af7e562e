from __future__ import annotations

import numpy as np
import pytest

from tessella.llm import hnsw


def exact(rows: dict[int, np.ndarray], q: int, k: int) -> list[tuple[float, int]]:
    return sorted((float(np.sqrt(((rows[q] - v) ** 2).sum())), i) for i, v in rows.items() if i != q)[:k]


@pytest.mark.parametrize("kind", ["uniform", "clusters"])
def test_graph_recall(kind):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 24))
    if kind == "clusters":
        x = x * 0.05 + rng.normal(size=(30, 24))[rng.integers(0, 30, 3000)]
    g = hnsw.build(x)
    got = g.search(x[:100], 10)
    hits = [len(set(got[i][:10]) & set(np.argsort(((x - x[i]) ** 2).sum(1))[:10])) for i in range(100)]
    assert np.mean(hits) >= 9.5


def test_query(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    got: dict = {}
    for r in hnsw.nearest(df).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.score, r.vec_id)
    assert set(got) == {i for i in rows if i % 100 == 0}
    same = 0
    for q, found in got.items():
        want = exact(rows, q, 10)
        assert sorted(found) == list(range(1, 11)) and [found[k] for k in sorted(found)] == sorted(found.values())
        assert all(s == pytest.approx(float(np.sqrt(((rows[q] - rows[i]) ** 2).sum())), rel=1e-12) for s, i in found.values())
        same += len({i for _, i in found.values()} & {i for _, i in want})
    assert same >= 0.9 * 10 * len(got)


@pytest.mark.parametrize("size", [300, 2000])
def test_recall_over_several_shards(spark, size):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 32)) * 0.3 + rng.normal(size=(60, 32))[rng.integers(0, 60, 6000)]
    rows = dict(enumerate(x))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "vec_id long, embedding array<double>")
    assert hnsw.shard_count(len(x), size) == 6000 // size
    found: dict = {}
    for r in hnsw.nearest(df, shard_size=size).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    same = sum(len(found[q] & {i for _, i in exact(rows, q, 10)}) for q in range(0, 6000, 100))
    assert len(found) == 60 and same >= 0.9 * 600


def test_shards_depend_on_the_vectors_only():
    assert [hnsw.shard_count(n) for n in (0, 1, 4096, 4097, 1_000_000, 10**9)] == [1, 1, 1, 2, 16, 4000]


def test_copies_ties_and_bad_vectors(spark):
    one, two = [1.0, 0.0], [0.0, 2.0]
    rows = [(i, one) for i in range(0, 300)] + [(400, two), (401, two), (402, [0.0, 0.0]), (500, None), (501, [1.0, None]), (502, [float("nan"), 1.0]), (503, [float("inf"), 1.0]), (504, [1.0]), (None, one), (0, one)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS rank")
    got: dict = {}
    for r in hnsw.nearest(df, k=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    assert got == {0: [(1, 0.0), (2, 0.0), (3, 0.0)], 100: [(0, 0.0), (1, 0.0), (2, 0.0)], 200: [(0, 0.0), (1, 0.0), (2, 0.0)], 400: [(401, 0.0), (0, round(5**0.5, 9)), (1, round(5**0.5, 9))]}
    assert hnsw.nearest(df.where("false")).collect() == [] and hnsw.nearest(df.where("vec_id = 400")).collect() == []
