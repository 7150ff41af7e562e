"""Token counts without token ids.

A text's pre-tokens are the stretches that the tokenizer's pattern cuts before any merge; a merge never
crosses them. So each distinct pre-token is counted once, the counts are stored as sorted hash arrays, and
each document's pre-token frequencies are joined to them by look-up and summed. Only distinct pre-tokens are
shuffled, never (document, pre-token) rows.
"""

from __future__ import annotations

import os
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from . import hashstore
from .common import released, shared_dir, strings

#: Distinct pre-tokens that a task holds before it hands them on.
FLUSH = 400_000
#: Stretches whose sums a task remembers.
MEMO = 1_000_000
#: Look-ups are made for this many texts' characters at once.
BLOCK_CHARS = 4_000_000


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


@cache
def _rules(pattern: str):
    # A blank next to other white space: its run may be cut elsewhere than before the blank.
    return regex.compile(pattern), regex.compile(r"\s | \s")


@cache
def _special(strings_: tuple[str, ...]):
    return regex.compile("|".join(map(regex.escape, strings_)))


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def stretches(text: str, pattern: str) -> list[str]:
    """Cut a text into stretches that pre-tokens don't cross: before each lone blank, else at each pre-token."""
    whole, blanks = _rules(pattern)
    if blanks.search(text):
        return whole.findall(text)
    first, *rest = text.split(" ")
    out = [" " + x for x in rest]
    return [first, *out] if first else out


def segments(text: str, special: list[str]) -> tuple[list[str], int]:
    """The text between special strings, and how many of those there are (each is one token): the leftmost, and of those the longest."""
    if not any(s in text for s in special):
        return [text], 0
    parts = _special(tuple(special)).split(text)
    return parts, len(parts) - 1


def pieces(batch: list[str], path: str) -> list[int]:
    return [len(x.ids) for x in _tokenizer(path).encode_batch(batch, add_special_tokens=False)]


def key(pre: str) -> int:
    return xxhash.xxh64_intdigest(pre.encode())


def count_tokens(docs: DataFrame, path: str | None = None, pattern: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every whole text; null counts as empty, which has no tokens.

    `path` is a byte-level BPE tokenizer file and `pattern` its pre-token rule. Special strings inside texts are
    one token each, the library's default. Repeated rows and null ids are rows like any other.
    """
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    path = path or default_path()
    special = sorted((t.content for t in _tokenizer(path).get_added_tokens_decoder().values()), key=len, reverse=True)
    df = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def distinct(batches):
        seen, known, out = set(), set(), lambda s: pa.RecordBatch.from_arrays([pa.array(list(s), pa.string())], names=["pre"])
        rule = _rules(pattern)[0]
        for b in batches:
            for text in strings(b.column(0)):
                for part in segments(text, special)[0]:
                    fresh = set(stretches(part, pattern)) - known
                    for s in fresh:
                        seen.update(rule.findall(s))
                    known |= fresh
                if len(known) > MEMO or len(seen) > FLUSH:
                    yield out(seen)
                    seen, known = set(), set()
        if seen:
            yield out(seen)

    def count(batches):
        for b in batches:
            pre = b.column(0).to_pylist()
            h = np.fromiter((key(x) for x in pre), np.uint64, len(pre))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(pieces(pre, path), pa.int32())], names=["h", "n"])

    spark = docs.sparkSession
    counted = df.select("text").mapInArrow(released(distinct), "pre string").distinct().mapInArrow(released(count), "h long, n int")
    bits = max(4, min(16, (df.rdd.getNumPartitions() * 2 - 1).bit_length()))
    # Two pre-tokens with one 64-bit hash would share a count; at a billion distinct ones the chance is 3 %.
    store = hashstore.build(counted.dropDuplicates(["h"]), shared_dir(spark), bits, ["n"], ["<i4"])

    def total(batches):
        memo: dict[str, int] = {}
        rule = _rules(pattern)[0]

        def learn(stretch: set[str]) -> None:
            cut = {s: rule.findall(s) for s in stretch}
            pre = list({p for c in cut.values() for p in c})
            h = np.fromiter((key(x) for x in pre), np.uint64, len(pre))
            order = np.argsort(h)
            found, (n,) = store.lookup(h[order])
            if not found.all():
                raise KeyError("a pre-token has no count")
            by = dict(zip((pre[i] for i in order), n.tolist(), strict=True))
            memo.update((s, sum(by[p] for p in c)) for s, c in cut.items())

        def block(docs_):
            freq = []
            for _, text in docs_:
                parts, extra = segments(text, special)
                f: Counter = Counter()
                for part in parts:
                    f.update(stretches(part, pattern))
                freq.append((f, extra))
            if len(memo) > MEMO:
                memo.clear()
            fresh = {s for f, _ in freq for s in f if s not in memo}
            if fresh:
                learn(fresh)
            tokens = [extra + sum(memo[s] * k for s, k in f.items()) for f, extra in freq]
            return pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in docs_], b_type), pa.array([len(t.encode()) for _, t in docs_], pa.int64()), pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens])],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

        for b in batches:
            b_type = b.column(0).type
            held, size = [], 0
            for i, text in zip(b.column(0).to_pylist(), strings(b.column(1)), strict=True):
                held.append((i, text))
                size += len(text)
                if size > BLOCK_CHARS:
                    yield block(held)
                    held, size = [], 0
            if held:
                yield block(held)

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(released(total), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
