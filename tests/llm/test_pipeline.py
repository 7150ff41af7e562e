from __future__ import annotations

import itertools
import pathlib
import random
from tempfile import mkdtemp

import pytest

import corpus_pipeline
from tessella.llm import simhash

SF = "/root/testdata/sf0.001"


def shingle_set(text: str, k: int = 5) -> set:
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for i in range(60):
        base = [word() for _ in range(rng.choice((30, 200, 600)))]
        rows.append((10 * i, " ".join(base)))
        for j in range(1, 4):
            near = list(base)
            for _ in range(max(0, len(near) // 100 * j)):
                near[rng.randrange(len(near))] = word()
            rows.append((10 * i + j, " ".join(near)))
    boiler = " ".join(word() for _ in range(60))
    rows += [(5000 + i, boiler + " " + " ".join(word() for _ in range(120))) for i in range(40)]
    return rows


@pytest.mark.parametrize("limit", [4096, 8])
def test_near_duplicates_against_jaccard(spark, planted, limit):
    df = spark.createDataFrame(planted, "doc_id long, text string")
    label = {r.doc_id: r.label for r in simhash.near_groups(df, limit=limit).collect()}
    sets = {i: shingle_set(t) for i, t in planted}
    missed = total = wrong = 0
    for a, b in itertools.combinations(sets, 2):
        j = jaccard(sets[a], sets[b])
        if j >= 0.85:
            total += 1
            missed += label[a] != label[b]
        elif j < 0.3:
            wrong += label[a] == label[b]
    assert total > 100 and missed <= 0.02 * total and wrong == 0


def test_links_are_exact_similarities(spark):
    rng = random.Random(9)
    words = lambda n: [rng.choice("abcdefghij") + str(rng.randrange(10**6)) for _ in range(n)]
    line = words(14)
    rows = [(i, " ".join((line + ["end"]) * 30 + words(104))) for i in range(20)]  # a repeated line: similarity below 0.1
    for i in range(100, 400, 10):
        short, long = words(9), words(140)
        rows += [(i, " ".join(short)), (i + 1, " ".join(short[:8]))]  # 5 and 4 shingles: exactly 0.8
        rows += [(i + 2, " ".join(long)), (i + 3, " ".join(long[:124]))]  # 136 and 120: 0.88
        rows += [(i + 4, " ".join(long[:60] + words(1) + long[61:100] + words(1) + long[101:124] + words(4)))]  # about 0.78 of the last
    df = spark.createDataFrame(rows, "doc_id long, text string")
    label = {r.doc_id: r.label for r in simhash.near_groups(df).collect()}
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if jaccard(sets[a], sets[b]) >= 0.8:
            root[find(b)] = find(a)
    for a, b in itertools.combinations(sets, 2):
        assert (label[a] == label[b]) == (find(a) == find(b)), (a, b, jaccard(sets[a], sets[b]))


def test_full_keys_lose_no_link(spark):
    rng = random.Random(12)
    words = lambda n: [rng.choice("abcdefghij") + str(rng.randrange(10**6)) for _ in range(n)]
    rows = []
    for i in range(0, 3000, 100):  # 4 shingles, the same and one more (0.8), and one more each (0.67 among them)
        passage = words(8)
        rows += [(i, " ".join(passage))] + [(i + j, " ".join(passage + words(1))) for j in range(1, 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    label = {r.doc_id: r.label for r in simhash.near_groups(df, limit=6).collect()}
    whole = {r.doc_id: r.label for r in simhash.near_groups(df).collect()}
    keys = {r.doc_id: set(r.anchors) for r in simhash.wide_fingerprints(df, mkdtemp()).collect()}
    for i, _ in rows:
        assert (label[i] == label[i - i % 100]) == (whole[i] == whole[i - i % 100])
        if keys[i] & keys[i - i % 100]:
            assert label[i] == label[i - i % 100], i
    assert len(set(label.values())) >= 30


def test_blocks_stay_small_and_whole(spark):
    rows = [(k, 1000 * k + i, 40 + i % 30) for k in (1, 2) for i in range(150 * k)] + [(3, 9000 + i, 5) for i in range(9)]
    keyed = spark.createDataFrame(rows, "key long, node long, size long")
    size = {node: n for _, node, n in rows}
    under = {}
    for r in simhash.in_blocks(keyed, 20).collect():
        under.setdefault(r.key, set()).add(r.node)
    assert max(map(len, under.values())) <= 40
    met = {pair for group in under.values() for pair in itertools.combinations(sorted(group), 2)}
    for k in (1, 2, 3):
        for a, b in itertools.combinations(sorted(node for key, node, _ in rows if key == k), 2):
            assert (a, b) in met or 5 * min(size[a], size[b]) < 4 * max(size[a], size[b])


def test_keep_one(spark, tricky, no_documents):
    kept = simhash.keep_one(tricky)
    assert kept.columns == tricky.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 3, 6, 7, 8, 9, 10, None]))
    assert simhash.keep_one(no_documents).collect() == []


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
            assert docs.where("n_chars <> length(text)").count() == 0
    assert 0 < docs.count() < before and docs.where("NOT lossless").count() == 0
    assert docs.where("size(ids) <> n_ids").count() == 0


def test_run_equals_its_stages_and_clears_up(spark, tmp_path):
    """`run` writes each stage and reads it again; what it gives is what the stages give one after another."""
    from tessella.llm.common import shared_dir

    root = pathlib.Path(shared_dir(spark).removeprefix("file://")).parent
    before = {p.name for p in root.iterdir()} if root.exists() else set()
    out = corpus_pipeline.run(spark, SF)
    got = out.collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert sorted(map(str, got)) == sorted(map(str, docs.select(out.columns).collect()))
    assert 0 < len(got) < spark.read.parquet(f"{SF}/documents.parquet").count()
    left = {p.name for p in root.iterdir()} - before if root.exists() else set()
    assert len([name for name in left if name.endswith("-personal_data")]) == 1 and not [name for name in left if name.endswith(("-toxicity", "-near_duplicates", "-decontamination"))]


def test_pipeline_on_tricky_rows(spark, tricky, no_documents):
    rows = tricky.select("doc_id", "text", "lang", "source", "n_chars", "shard")
    for docs in (rows, no_documents.select(*rows.columns)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        docs.collect()


def test_pipeline_with_clashing_names(spark, tricky, no_documents):
    odd = ["_key", "_", "base", "added", "h", "label", "predicted", "_text", "Score_", "spans"]
    rows = tricky.selectExpr("*", *(f"'{c}' AS `{c}`" for c in odd))
    for docs in (rows, no_documents.selectExpr("*", *(f"'{c}' AS `{c}`" for c in odd))):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before = docs.columns
            docs = stage(spark, docs, SF)
            if k < 4:
                assert docs.columns == before
                assert all(r[c] == c for r in docs.collect() for c in odd)
        docs.collect()


@pytest.mark.parametrize("size", [60, 400])
def test_recall_at_the_threshold(spark, size):
    """Pairs of a similarity of 0.80 to 0.82 are linked, 9 of 10 at least."""
    rng = random.Random(size)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(10**7))
    rows = []
    while len(rows) < 160:
        base = [word() for _ in range(size)]
        near = list(base)
        while jaccard(shingle_set(" ".join(base)), shingle_set(" ".join(near))) > 0.82:
            near[rng.randrange(size)] = word()
        if jaccard(shingle_set(" ".join(base)), shingle_set(" ".join(near))) >= 0.8:
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(near))]
    label = {r.doc_id: r.label for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = sum(label[i] == label[i + 1] for i in range(0, len(rows), 2))
    assert linked >= 0.9 * len(rows) / 2
