"""Token counts and SentencePiece, against the public libraries and brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessella.llm import pieces, token_count

ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a   b\n\n  c", "it's we'll I'D", "x\t \ty", "a \nb", "a\n b", "1234 5six", "naïve ☃𝒳 日本語", "<|endoftext|>", "a <|endoftext|>  b<|endoftext|><|endoftext|>",
    " x  y\x1c z\x85 w", "...!!! ---", "\r\n\r\n", "é ​‍", "▁x ▁ y", "a" * 3000, " " * 500, "\n" * 50 + "x",
]


@pytest.fixture(scope="module")
def mixed(spark, documents):
    rng = random.Random(1)
    alphabet = list("ab'st 1.\n\t é日 ") + ["  ", "<|endoftext|>"]
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(300)]
    return ODD + made + [r.text or "" for r in documents.select("text").collect()]


def test_token_counts(spark, mixed):
    t = Tokenizer.from_file(token_count.default_path())
    want = [len(e.ids) for e in t.encode_batch(mixed, add_special_tokens=False)]
    df = spark.createDataFrame(list(enumerate(mixed)), "doc_id long, text string")
    got = {r.doc_id: r for r in token_count.count_tokens(df).collect()}
    assert [got[i].n_tokens for i in range(len(mixed))] == want
    assert all(got[i].n_bytes == len(x.encode()) and got[i].over_limit == (want[i] > 1024) for i, x in enumerate(mixed))


def test_token_counts_of_tricky_rows(tricky, no_documents):
    got = token_count.count_tokens(tricky).collect()
    assert len(got) == tricky.count() and {r.n_tokens for r in got if r.doc_id in (3, 4)} == {0}
    assert token_count.count_tokens(no_documents).collect() == []


def test_trie_holds_every_key_and_no_other():
    rng = random.Random(2)
    keys = sorted({bytes(rng.choice(b"abc\xff\x00") for _ in range(rng.randrange(1, 6))) for _ in range(300)})
    trie = pieces.DoubleArray(keys)
    data = np.array([rng.choice(b"abc\xff\x00") for _ in range(400)], np.int32)
    begin, end, key = trie.matches(data, np.arange(400), np.full(400, 400))
    got = {(int(b), int(e), int(k)) for b, e, k in zip(begin, end, key, strict=True)}
    at = {k: i for i, k in enumerate(keys)}
    raw = bytes(data.astype(np.uint8))
    assert got == {(i, j, at[raw[i:j]]) for i in range(400) for j in range(i + 1, min(400, i + 6) + 1) if raw[i:j] in at}


def brute(v: pieces.Vocabulary, whole: str) -> float:
    """The best score over all segmentations of a text that has its markers, character by character."""
    scores = {bytes(v.bytes[i]): s for i, s in zip(v.ids, v.score, strict=True)}
    best = [0.0] + [-np.inf] * len(whole)
    for i in range(len(whole)):
        for j in range(i + 1, min(len(whole), i + 17) + 1):
            s = scores.get(whole[i:j].encode(), v.unknown if j == i + 1 else None)
            if s is not None:
                best[j] = max(best[j], best[i] + s)
    return best[-1]


def test_segmentation_is_the_best(mixed):
    v = pieces.vocabulary(pieces.default_path())
    own = {i: s for i, s in zip(v.ids.tolist(), v.score.tolist(), strict=True)}
    for x in [x[:300] for x in mixed if x][:150]:
        ids = np.concatenate(v.segment(v.units(x))).tolist()
        total, k = 0.0, 0
        while k < len(ids):
            if v.is_byte[ids[k]]:
                first = v.bytes[ids[k]][0]
                k += 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                total += v.unknown
            else:
                total += own[ids[k]]
                k += 1
        assert total == pytest.approx(brute(v, "▁" + x.replace(" ", "▁")), rel=1e-12)


def test_ids_are_known_to_the_library(mixed):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    v = pieces.vocabulary(pieces.default_path())
    for x in mixed[:150]:
        us = v.units(x)
        ids = np.concatenate(v.segment(us)) if us else np.zeros(0, np.int32)
        assert v.decode(ids) == sp.decode(ids.tolist()) == x.replace("▁", " ")


def test_round_trip(spark, mixed, tricky, no_documents):
    df = spark.createDataFrame(list(enumerate(mixed)), "doc_id long, text string")
    back = pieces.decode(pieces.encode(df)).collect()
    assert all(r.decoded == r.text.replace("▁", " ") for r in back)
    short = {r.doc_id: r for r in pieces.round_trip(df, ["doc_id"], with_ids=True).collect()}
    for r in back:
        assert short[r.doc_id].ids == r.ids and short[r.doc_id].n_ids == len(r.ids) and short[r.doc_id].lossless == ("▁" not in r.text)
    out = pieces.decode(pieces.encode(tricky)).collect()
    assert {r.doc_id: r.ids for r in out}[4] is None and {r.doc_id: r.ids for r in out}[3] == []
    assert pieces.round_trip(tricky, ["doc_id", "row"]).count() == tricky.count() and pieces.encode(no_documents).collect() == []


def test_decoding_broken_bytes():
    v = pieces.vocabulary(pieces.default_path())
    assert v.decode(np.array([v.byte_id[0xE2], v.byte_id[0x98]])) == "�" and v.decode(np.zeros(0, np.int32)) == ""
