"""Whitening and vector codes against plain NumPy and Python."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from tessella.llm import queries, vafile, whitening

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def embeddings(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


def plain_whitening(vectors: dict, scale=64, offset=1_000_000, k=16):
    grid = {i: [math.floor(scale * float(c)) + offset for c in v] for i, v in vectors.items()}
    fit = np.array(sorted({tuple(x) for x in grid.values()}), object)
    n, s = len(fit), fit.sum(0)
    y = ((fit * n - s) / n).astype(float)
    cov = y.T @ y / n
    e, a = np.linalg.eigh(cov)
    e, a = e[::-1][:k], a[:, ::-1][:, :k]
    own = {i: (np.array(x, object) * n - s) for i, x in grid.items()}
    return n, {i: int((v**2).sum()) for i, v in own.items()}, {i: (v / n).astype(float) @ a / np.sqrt(e) for i, v in own.items()}, e / np.trace(cov)


def test_whitening_equals_numpy(spark, embeddings):
    vectors = {r.vec_id: r.embedding for r in embeddings.collect()}
    n, deviation, whitened, explained = plain_whitening(vectors)
    got: dict = {}
    for r in queries.op12_whitening(spark, SF).collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    assert set(got) == set(vectors) and all(sorted(rows) == list(range(1, 17)) for rows in got.values())
    one = next(iter(got.values()))
    sign = np.sign([sum(got[i][c].whitened * whitened[i][c - 1] for i in got) for c in range(1, 17)])
    for i, rows in got.items():
        assert all(r.n == n and r.deviation == deviation[i] for r in rows.values())
        assert np.allclose([rows[c].whitened for c in range(1, 17)], whitened[i] * sign, atol=1e-8)
    assert np.allclose([one[c].explained for c in range(1, 17)], explained, rtol=1e-10)
    assert 0 <= one[1].identity_error < 1e-9 and len({r.identity_error for rows in got.values() for r in rows.values()}) == 1


@pytest.mark.parametrize("width,tile", [(7, 3), (40, None), (5, 5)])
def test_tiles_make_the_whole_product(spark, width, tile):
    rng = np.random.default_rng(1)
    x = rng.integers(-50, 50, (3000, width))
    from tessella.llm.common import checkpoint

    points = checkpoint(spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(5))
    assert whitening.totals(points) == (3000, x.sum(0).tolist())
    assert np.array_equal(whitening.products(points, width, lambda m: m.astype(float), tile), (x.T @ x).astype(float))


ROWS = [(1, [0.5, -0.25, 0.0]), (2, [0.5, -0.25, 0.0]), (2, [0.5, -0.25, 0.0]), (3, [1.0, 2.0, 0.0]), (None, [-1.0, 0.3, 0.0]), (4, None), (5, [1.0, None, 0.0]), (6, [float("nan"), 0.0, 0.0]), (7, [0.0, float("-inf"), 0.0]), (8, [1.0]), (9, []), (10, [0.0, 0.0, 0.0])]


def test_whitening_of_odd_rows(spark):
    df = spark.createDataFrame(ROWS, "vec_id long, embedding array<float>").selectExpr("*", "1 AS component", "2 AS whitened", "3 AS x")
    got = whitening.components(df).collect()
    kept = [r for r in ROWS if r[1] and len(r[1]) == 3 and all(c is not None and math.isfinite(c) for c in r[1])]
    n, deviation, whitened, _ = plain_whitening({i: v for i, (_, v) in enumerate(kept)}, k=2)
    assert n == 4 and len(got) == 2 * len(kept) and {r.n for r in got} == {4}  # the third dimension doesn't vary
    assert sorted((r.vec_id or 0, r.deviation) for r in got if r.component == 1) == sorted((i or 0, deviation[k]) for k, (i, _) in enumerate(kept))
    assert sorted(abs(r.whitened) for r in got if r.component == 2) == pytest.approx(sorted(abs(w[1]) for w in whitened.values()))
    for none in ("false", "vec_id = 1", "embedding IS NULL"):
        assert whitening.components(df.where(none)).collect() == []


def test_whitening_is_exact_with_large_numbers(spark):
    rows = [(i, [1e9 * (i % 3), 3e13 + i, 1e300 if i == 5 else 0.0]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = whitening.fit(df, components=2)
    held = [[math.floor(max(min(64 * c, 1e15), -1e15)) + 1_000_000 for c in v] for _, v in rows]
    points = {tuple(v) for v in held}  # the second dimension is held at 1e15 everywhere
    assert (model.n, model.sums) == (len(points), [sum(c) for c in zip(*points, strict=True)])
    want = [sum((model.n * c - s) ** 2 for c, s in zip(v, model.sums, strict=True)) for v in held]
    got = {r.vec_id: r.deviation for r in whitening.transform(df, model, ["vec_id"]).collect()}
    assert got == {i: (v if v < 1 << 63 else None) for i, v in enumerate(want)}


def plain_codes(rows: list[tuple], parts=16, entries=64, rounds=2, scale=256):
    grid = {k: [math.floor(scale * float(c)) for c in v] for k, (_, _, v) in enumerate(rows)}
    w = len(rows[0][2]) // parts
    cut = {k: [tuple(x[p * w : p * w + w]) for p in range(parts)] for k, x in grid.items()}
    first = sorted({i: k for k, (i, _, _) in reversed(list(enumerate(rows))) if i is not None}.items())[:entries]
    books = [[cut[k][p] for _, k in first] for p in range(parts)]
    near = lambda p, q: min((sum((a - b) ** 2 for a, b in zip(q, e, strict=True)), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            of: dict = {}
            for k in cut:
                of.setdefault(near(p, cut[k][p])[1], []).append(cut[k][p])
            new.append([tuple(sum(c) // len(of[j]) for c in zip(*of[j], strict=True)) if j in of else e for j, e in enumerate(books[p])])
        books = new
    out, by = [], {}
    for k, (i, label, _) in enumerate(rows):
        found = [near(p, cut[k][p]) for p in range(parts)]
        out.append((i, label, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found)))
        by[label] = by.get(label, 0) + out[-1][3]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i if i is not None else -1), code, error, by[label], digest) for i, label, code, error in out)


def coded(df) -> list[tuple]:
    return sorted((r.vec_id if r.vec_id is not None else -1, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def test_codes_equal_brute_force(spark, embeddings):
    rows = [(r.vec_id, r.label, r.embedding) for r in embeddings.limit(200).collect()]
    df = spark.createDataFrame(rows, embeddings.select("vec_id", "label", "embedding").schema)
    assert coded(vafile.compress(df)) == plain_codes(rows)


def test_codes_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = [(int(i), int(i) % 3 if i % 4 else None, (rng.integers(-3, 4, 6) / 256).tolist()) for i in rng.permutation(60)]
    good += [(100, 7, [0.01] * 6)] * 3 + [(None, None, [-0.5] * 6)]
    bad = [(-5, 1, None), (-4, 1, [1.0, None, 0, 0, 0, 0]), (-3, 1, [float("nan")] * 6), (-2, 1, [float("inf")] * 6), (-1, 1, [0.5]), (-6, 1, [])]
    df = spark.createDataFrame([(i, lab, [None if c is None else float(c) for c in v] if v is not None else None) for i, lab, v in good + bad], "vec_id long, label int, embedding array<double>").selectExpr("*", "'c' AS code", "1 AS error", "1 AS id", "1 AS v")
    assert coded(vafile.compress(df, parts=3, entries=8)) == plain_codes(good, parts=3, entries=8)
    assert coded(vafile.compress(df, parts=2, entries=200)) == plain_codes(good, parts=2, entries=200)
    assert vafile.compress(df.where("false")).collect() == [] and vafile.compress(df.where("vec_id IS NULL")).collect() == []


def test_labels_dealt_to_parts(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    whole = coded(vafile.compress(df, entries=8))
    monkeypatch.setattr(vafile, "FEW", 3)
    assert coded(vafile.compress(df, entries=8)) == whole


def test_bounds_hold_and_cells_leave_most_entries_out():
    rng = np.random.default_rng(3)
    cells = vafile.Cells.of(rng.integers(-100, 100, (64, 4)))
    q = rng.integers(-150, 150, (500, 4))
    exact = ((q[None] - cells.entries[:, None]) ** 2).sum(2)
    lower, upper = cells.bounds(q)
    assert (lower <= exact).all() and (exact <= upper).all() and (lower <= upper.min(0)).mean() < 0.2
    index, dist = cells.nearest(q)
    assert np.array_equal(index, exact.argmin(0)) and np.array_equal(dist, exact.min(0))
    books = vafile.Codebooks(256, 1 << 20, [cells.entries, cells.entries[:3]])
    assert np.array_equal(books.decode("0a02") * 256, np.concatenate([cells.entries[10], cells.entries[2]]))
