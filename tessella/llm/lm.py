"""Interpolated modified Kneser-Ney language model of any order, counted in Spark and memory-mapped by workers.

Tokens are 64-bit hashes of words. Tasks count the n-grams of their texts and hand on packed, sorted runs, one for
each range of the n-gram's hash; ranges are even whatever the words are, so no word or word pair is one task's. Each
range is merged and stored as sorted hash arrays; what each n-gram tells of the next shorter ones goes on to another exchange, by their
hashes: of its beginning, as a context (its total, and its followers seen once, twice, more often), and of its end, as a
continuation (its distinct predecessors, which are the counts of all orders but the highest). Workers map the stores of all
orders and look up the distinct n-grams of a block of texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, released, shared_dir, texts
from .hashstore import HashStore, write_shard

BEGIN, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
#: Tokens that a task counts before it hands a run on.
RUN = 3_000_000
#: Tokens that are scored at once.
BLOCK = 400_000
#: Words of an n-gram, and bits of its hash that deal n-grams to ranges, at most.
ORDER, MOST_BITS = 2, 20
#: A discount is this at least, so that no word's probability is nothing.
LEAST = 0.01
#: What is kept of an n-gram below the highest order: as a context its total and its followers seen once, twice, more often;
#: its distinct predecessors; how often its last word was seen, however preceded.
FIELDS = ("uses", "once", "twice", "often", "before", "raw")


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def chain(words: list[np.ndarray]) -> np.ndarray:
    """Hashes of n-grams; that of a single word is its own."""
    out = words[0]
    for w in words[1:]:
        out = pair_hash(out, w)
    return out


def pack(arrays: list[np.ndarray]) -> bytes:
    return zstd.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(x).tobytes() for x in arrays))


def unpack(blob: bytes, n: list[int], dtypes: list[str]) -> list[np.ndarray]:
    raw, out, at = zstd.ZstdDecompressor().decompress(blob), [], 0
    for k, d in zip(n, dtypes, strict=True):
        out.append(np.frombuffer(raw, d, k, at))
        at += k * np.dtype(d).itemsize
    return out


def summed(words: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(hashes ascending, words, sums of the values) of the distinct n-grams."""
    g = chain(words)
    order = np.argsort(g, kind="stable")
    g = g[order]
    first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
    return g[first], [w[order[first]] for w in words], [np.add.reduceat(v[order], first) if len(g) else v for v in values]


def ranges(g: np.ndarray, words: list[np.ndarray], values: list[np.ndarray], bits: int):
    """(shard, n, names, kind, blob) of n-grams by ascending hash. A blob of pairs and longer ones has its own list of words, to which they refer."""
    edges = np.searchsorted(g >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    for k in np.flatnonzero(np.diff(edges)):
        own, held = [w[edges[k] : edges[k + 1]] for w in words], [v[edges[k] : edges[k + 1]] for v in values]
        kind, n = narrow(held), len(own[0])
        if len(words) == 1:
            yield int(k), n, 0, kind, pack([own[0], *(v.astype(kind) for v in held)])
            continue
        names, refs = np.unique(np.concatenate(own), return_inverse=True)
        refs = refs.reshape(len(words), n)
        order = np.lexsort(refs[::-1])  # ascending first words, whose steps pack into almost nothing
        ref = ref_type(len(names))
        yield int(k), n, len(names), kind, pack([names, np.diff(refs[0][order], prepend=0).astype(ref), *(r[order].astype(ref) for r in refs[1:]), *(v[order].astype(kind) for v in held)])


def opened(r: dict, length: int, fields: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(words, values) of a row of `ranges`."""
    n, kinds = r["n"], [r["kind"]] * fields
    if length == 1:
        first, *rest = unpack(r["blob"], [n] * (1 + fields), ["<u8", *kinds])
        return [first], rest
    names, *rest = unpack(r["blob"], [r["m"], *[n] * (length + fields)], ["<u8", *[ref_type(r["m"])] * length, *kinds])
    refs = [np.cumsum(rest[0], dtype=np.int64), *rest[1:length]]
    return [names[x] for x in refs], rest[length:]


def narrow(arrays: list[np.ndarray]) -> str:
    """The type that holds all counts of some arrays: 4 bytes, or 8 where one is beyond them."""
    return "<u4" if max((int(x.max(initial=0)) for x in arrays), default=0) < 1 << 32 else "<i8"


def ref_type(names: int) -> str:
    return "<u2" if names <= 1 << 16 else "<u4"


def _sum_of_counts(c: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(c, 5).astype(np.int64), minlength=6)[1:5].tolist()


@dataclass
class Discounts:
    """The three discounts of modified Kneser-Ney, from the numbers of n-grams seen once to four times."""

    by_count: list[float]

    @classmethod
    def of(cls, t: list[int]) -> Discounts:
        if min(t[:3]) <= 0:  # too little text for the estimate
            return cls([0.0, 0.5, 1.0, 1.5])
        y = t[0] / (t[0] + 2 * t[1])
        return cls([0.0, *(min(max(k - (k + 1) * y * t[k] / t[k - 1], LEAST), float(k)) for k in (1, 2, 3))])

    def __call__(self, c: np.ndarray) -> np.ndarray:
        return np.array(self.by_count)[np.minimum(c, 3)]


def contexts(h: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """The words 1, 2, ... order - 1 places before each token; before a text there are beginnings."""
    place = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
    out = []
    for j in range(1, order):
        w = np.full_like(h, BEGIN)
        far = place >= j
        w[far] = h[np.flatnonzero(far) - j]
        out.append(w)
    return out


@dataclass
class Model:
    """A trained model: a store for each length of n-grams and a few sums. `total` counts all training tokens, `types` the distinct
    ones, `kinds` the distinct pairs that the lowest order counts."""

    stores: list[HashStore]
    discounts: list[Discounts]
    total: int
    types: int
    kinds: int
    lower_rest: float

    @property
    def order(self) -> int:
        return len(self.stores)

    def score(self, h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 probability, training count) of each token, given all texts' tokens in order and where texts start."""
        names, word = np.unique(h, return_inverse=True)
        _, (_, _, _, _, before, raw) = self.stores[0].lookup(names)
        b, base = before.astype(np.int64), 1.0 / (self.types + 1)
        low = np.maximum(b - self.discounts[0](b), 0.0) / self.kinds + self.lower_rest * base if self.kinds else np.full(len(names), base)
        p, back = low[word], contexts(h, starts, self.order)
        for k in range(2, self.order + 1):
            ctx = chain(back[k - 2 :: -1])
            distinct, at = np.unique(ctx, return_inverse=True)
            _, (uses, once, twice, often, *_) = self.stores[k - 2].lookup(distinct)
            uses, d = uses.astype(np.int64), self.discounts[k - 1].by_count
            rest = np.where(uses > 0, (d[1] * once + d[2] * twice + d[3] * often) / np.maximum(uses, 1), 1.0)
            grams, of = np.unique(pair_hash(ctx, h), return_inverse=True)
            _, values = self.stores[k - 1].lookup(grams)
            c = values[0 if k == self.order else 4].astype(np.int64)
            p = (np.maximum(c - self.discounts[k - 1](c), 0.0))[of] / np.maximum(uses, 1)[at] + rest[at] * p
        return np.log10(p), raw.astype(np.int64)[word]


def hashes(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes with an end for each text, where texts start)."""
    f = xxhash.xxh64_intdigest
    words = [tokens(t) for t in batch]
    n = np.fromiter(map(len, words), np.int64, len(words)) + 1
    h = np.empty(int(n.sum()), np.uint64)
    ends = np.cumsum(n) - 1
    h[ends] = END
    inner = np.ones(len(h), bool)
    inner[ends] = False
    h[inner] = np.fromiter((f(w) for ws in words for w in ws), np.uint64, int(n.sum()) - len(words))
    return h, ends - n + 1


def text_blocks(batch: list[bytes], size: int = 6 * BLOCK):
    """(from, to) of runs of texts of about `size` bytes."""
    lo = held = 0
    for i, t in enumerate(batch):
        held += len(t)
        if held >= size:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(batch):
        yield lo, len(batch)


ROW = "shard int, level int, n int, m int, kind string, blob binary, size long, seen array<long>, thrice long, wide boolean, raw long, kinds long"


def _row(shard: int, n: int, m: int, kind: str, blob: bytes) -> dict:
    return {"shard": shard, "level": 0, "n": n, "m": m, "kind": kind, "blob": blob}


def train(docs: DataFrame, text_col: str = "text", order: int = ORDER) -> Model:
    """Count a model of n-grams of up to `order` words over every whole text. Null counts as empty, which is one end; no rows
    give a uniform model."""
    if order < 2:
        raise ValueError("an order of two at least")
    spark = docs.sparkSession
    df = docs.select(F.col(text_col).cast("string").alias("text"))
    bits = max(4, min(MOST_BITS, (2 * df.rdd.getNumPartitions() - 1).bit_length()))
    at = [shared_dir(spark) for _ in range(order)]
    schema = row_schema()

    def count(batches):
        held, size = [], 0

        def out():
            words = [np.concatenate(x) for x in zip(*held, strict=True)]
            for made in ranges(*summed(words, [np.ones(len(words[0]), np.int64)]), bits):
                yield pa.RecordBatch.from_pylist([_row(*made)], schema)

        for b in batches:
            whole = texts(b.column(0))
            for lo, hi in text_blocks(whole):
                h, starts = hashes(whole[lo:hi])
                held.append((*contexts(h, starts, order)[::-1], h))
                size += len(h)
                if size >= RUN:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    def merge(length: int):
        """Merges the n-grams of a length and a range, stores them, and hands on what they tell of shorter ones."""
        top = length == order

        def run(t: pa.Table) -> pa.Table:
            k, rows = t.column("shard")[0].as_py(), t.to_pylist()
            out = [r for r in rows if r["level"]]  # the sums of ranges that were merged before
            parts = [opened(r, length, 1 if top else len(FIELDS)) for r in rows if not r["level"]]
            if not parts:
                return pa.Table.from_pylist(out, schema)
            words = [np.concatenate(x) for x in zip(*(p[0] for p in parts), strict=True)]
            values = [np.concatenate(x).astype(np.int64) for x in zip(*(p[1] for p in parts), strict=True)]
            del parts, rows
            g, words, values = summed(words, values)
            kind = narrow(values)
            write_shard(at[length - 1], k, g, [v.astype(kind) for v in values])
            c, raw = values[0 if top else 4], values[0 if top else 5]
            sums = {"size": len(g), "seen": _sum_of_counts(c), "thrice": int((c > 2).sum()), "wide": kind == "<i8", "raw": int(raw.sum()), "kinds": int(c.sum())}
            out.append({"shard": k, "level": length, **sums})
            if length > 1:
                some = c > 0
                c, raw, words = c[some], raw[some], [w[some] for w in words]
                zero, one = np.zeros(len(c), np.int64), np.ones(len(c), np.int64)
                told = [(c, zero), (c == 1, zero), (c == 2, zero), (c > 2, zero), (zero, one), (zero, raw)]
                shorter = [np.concatenate(x) for x in zip(words[:-1], words[1:], strict=True)]
                out += [_row(*made) for made in ranges(*summed(shorter, [np.concatenate(x).astype(np.int64) for x in told]), bits)]
            return pa.Table.from_pylist(out, schema)

        return run

    rows = df.mapInArrow(released(count), ROW)
    for length in range(order, 0, -1):
        rows = rows.groupBy("shard").applyInArrow(merge(length), ROW)
    of: list[list] = [[] for _ in range(order)]
    for r in rows.select("level", "shard", "size", "seen", "thrice", "wide", "raw", "kinds").collect():  # a row for each range and length
        of[r.level - 1].append(r)
    seen = [[sum(r.seen[i] for r in rs) for i in range(4)] for rs in of]
    discounts = [Discounts.of(x) for x in seen]
    kinds, d = sum(r["kinds"] for r in of[0]), discounts[0].by_count
    return Model(
        stores=[HashStore(at[i], bits, ["<u4"] * (1 if i == order - 1 else len(FIELDS)), {r.shard: r["size"] for r in rs}, frozenset(r.shard for r in rs if r.wide)) for i, rs in enumerate(of)],
        discounts=discounts, total=sum(r.raw for r in of[0]), types=sum(seen[0][:2]) + sum(r.thrice for r in of[0]), kinds=kinds,
        lower_rest=(d[1] * seen[0][0] + d[2] * seen[0][1] + d[3] * sum(r.thrice for r in of[0])) / kinds if kinds else 1.0,
    )


def row_schema() -> pa.Schema:
    """ROW as Arrow has it."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ROW.split(", "))])


def score(docs: DataFrame, model: Model, carry: list[str], text_col: str = "text") -> DataFrame:
    """The columns in `carry`, with n_tokens, n_known, train_tokens, base_score, score of every whole text.

    base_score is the add-one-half unigram model over the same counts. Null counts as empty: one end.
    """
    df = docs.select(*carry, F.col(text_col).cast("string").alias(free_name("_text", carry)))

    def run(batches):
        for b in batches:
            whole = texts(b.column(len(carry)))
            for lo, hi in text_blocks(whole):
                h, starts = hashes(whole[lo:hi])
                logp, count = model.score(h, starts)
                base = np.log10((count + 0.5) / (model.total + 0.5 * (model.types + 1)))
                sums = [np.add.reduceat(x, starts) for x in (np.ones(len(h), np.int64), (count > 0).astype(np.int64), base, logp)]
                own = [b.column(i).slice(lo, hi - lo) for i in range(len(carry))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(sums[0]), pa.array(sums[1]), pa.array(np.full(hi - lo, model.total, np.int64)), pa.array(sums[2]), pa.array(sums[3])], names=[*carry, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry)
    return df.mapInArrow(released(run), f"{kinds}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def fold(col: str, n: int = 5):
    """crc32 of the id as text, mod n; a null id is the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def score_held_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 1, order: int = ORDER) -> DataFrame:
    """Train on the documents outside the held fold and score all: doc_id, held_out, and the columns of `score`.

    Null and empty texts are one end token; a null id is hashed as the empty text; repeated rows each count and are each
    scored; an empty table gives none. Only id and text are read, so other columns can't clash.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (fold(id_col, folds) == held).alias("held_out"))
    return score(df, train(df.where("NOT held_out"), order=order), ["doc_id", "held_out"])
