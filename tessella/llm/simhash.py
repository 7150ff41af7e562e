"""SimHash near-duplicates by bit-sliced comparison.

A block of 64 fingerprints is stored as bit planes: one machine word holds one bit of all 64. A query
is compared with the whole block plane by plane; a carry-save tree of bitwise counters adds up the
64 distances at once, and a block is abandoned as soon as every counter has passed the radius.

Which blocks are compared at all comes from exact keys. For a radius r below 4 the bits are cut into four bands:
fingerprints that differ in at most three bits agree in a whole band. A band value that too many
fingerprints share is cut again, by four bands of the remaining bits, which loses nothing. `near_groups` has wide
fingerprints whose radius no band survives; there the keys are minima of the shingles' hashes, and the fingerprints only
pick the pairs whose sets of shingles are then compared exactly.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashstore
from .common import checkpoint, free_name, local_path, partitions, released, shared_dir, texts
from .components import components

#: Fingerprints under one key beyond which the key is refined.
BUCKET = 4096
#: Shingles that are held at once while fingerprints are made.
BLOCK = 400_000
#: (Query, block) pairs that are compared at once.
TILE = 1 << 18
MAX = np.uint64(2**64 - 1)

#: The byte's bits, each in a byte of its own.
SPREAD = sum((np.arange(256, dtype=np.uint64) >> np.uint64(i) & np.uint64(1)) << np.uint64(8 * i) for i in range(8))


def shingles(text: bytes, k: int) -> list[bytes]:
    """Lower-cased (A-Z) k-word shingles with repeats; fewer words give the whole sequence, none gives none."""
    w = text.lower().split()
    if len(w) <= k:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*(w[i:] for i in range(k)), strict=False)))


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majority(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The 64-bit fingerprints of documents with `counts` hashes each (all above 0), from their hashes in order.

    Bits are counted eight at a time in the bytes of a word, over stretches of at most 255 hashes.
    """
    n_parts = -(-counts // 255)
    first = np.concatenate(([0], np.cumsum(n_parts)[:-1]))
    within = np.arange(n_parts.sum()) - np.repeat(first, n_parts)
    starts = np.repeat(np.concatenate(([0], np.cumsum(counts)[:-1])), n_parts) + within * 255
    octets = h.view(np.uint8).reshape(-1, 8)
    bits = np.empty((len(counts), 64), dtype=np.uint8)
    for k in range(8):
        lanes = np.add.reduceat(SPREAD[octets[:, k]], starts).view(np.uint8).reshape(-1, 8)
        bits[:, 8 * k : 8 * k + 8] = np.add.reduceat(lanes, first, axis=0, dtype=np.int64) * 2 > counts[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def blocks(column: pa.Array, k: int, distinct: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, shingle counts, XXH64 hashes with seed 42) of runs of texts that fit in memory.

    With `distinct` each text's hashes are its set, sorted.
    """
    f, lo, counts, held = xxhash.xxh64_intdigest, 0, [], []
    size = 0
    for i, t in enumerate(texts(column)):
        s = shingles(t, k)
        h = np.fromiter((f(x, 42) for x in s), np.uint64, len(s))
        held.append(np.unique(h) if distinct else h)
        counts.append(len(held[-1]))
        size += len(held[-1])
        if size >= BLOCK:
            yield lo, i + 1, np.array(counts), np.concatenate(held)
            lo, counts, held, size = i + 1, [], [], 0
    if counts:
        yield lo, lo + len(counts), np.array(counts), np.concatenate(held)


def fingerprints(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (long) of every whole text. No words, or null: fingerprint 0."""

    def make(batches):
        for b in batches:
            for lo, hi, counts, h in blocks(b.column(1), k):
                fp = np.zeros(hi - lo, np.uint64)
                some = counts > 0
                if some.any():
                    fp[some] = majority(h, counts[some])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(released(make), f"doc_id {kind}, fp long")


class Counters:
    """64 saturating counters a word, in carry-save form: `over` has a bit where a count has passed the radius."""

    def __init__(self, n: int, radius: int):
        self.levels = max(1, radius.bit_length())
        ahead = (1 << self.levels) - 1 - radius  # so that the top level overflows just beyond the radius
        self.sums = [np.full(n, MAX if ahead >> j & 1 else 0, np.uint64) for j in range(self.levels)]
        self.waiting: list[np.ndarray | None] = [None] * self.levels
        self.over = np.zeros(n, np.uint64)

    def add(self, x: np.ndarray) -> None:
        for j in range(self.levels):
            if self.waiting[j] is None:
                self.waiting[j] = x
                return
            a, self.waiting[j] = self.waiting[j], None
            u = self.sums[j] ^ a
            carry = (self.sums[j] & a) | (u & x)
            self.sums[j] = u ^ x
            x = carry
        self.over |= x

    def flush(self) -> None:
        for j in range(self.levels):
            x, self.waiting[j] = self.waiting[j], None
            for i in range(j, self.levels):
                if x is None:
                    break
                self.sums[i], x = self.sums[i] ^ x, self.sums[i] & x
            if x is not None:
                self.over |= x

    def keep(self, at: np.ndarray) -> None:
        self.sums = [x[at] for x in self.sums]
        self.waiting = [None if x is None else x[at] for x in self.waiting]
        self.over = self.over[at]


def planes_of(fps: np.ndarray, slot: np.ndarray, n_blocks: int) -> np.ndarray:
    """Bit planes (bits, blocks) of fingerprints (n, words) put at places `slot` of blocks of 64."""
    laid = np.zeros((n_blocks * 64, fps.shape[1]), np.uint64)
    laid[slot] = fps
    out = np.empty((64 * fps.shape[1], n_blocks), np.uint64)
    for b in range(len(out)):
        bit = ((laid[:, b >> 6] >> np.uint64(b & 63)) & np.uint64(1)).astype(np.uint8)
        out[b] = np.packbits(bit, bitorder="little").view("<u8")
    return out


def within_groups(fps: np.ndarray, sizes: np.ndarray, radius: int, sets: Sets | None = None) -> np.ndarray:
    """For each fingerprint the place of its component's first member, when those of a group within the radius are linked.

    `fps` (n, words) holds the groups one after another. With `sets` only those links count that the sets confirm.
    """
    n, bits = len(fps), 64 * fps.shape[1]
    group = np.repeat(np.arange(len(sizes)), sizes)
    start = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    n_blocks = -(-sizes // 64)
    first_block = np.concatenate(([0], np.cumsum(n_blocks)[:-1]))
    inside = np.arange(n) - start[group]
    own = first_block[group] + inside // 64
    planes = planes_of(fps, own * 64 + inside % 64, int(n_blocks.sum()))
    member = np.zeros(int(n_blocks.sum()) * 64, np.int64)
    member[own * 64 + inside % 64] = np.arange(n)
    filled = np.zeros(len(member), np.uint8)
    filled[own * 64 + inside % 64] = 1
    valid = np.packbits(filled, bitorder="little").view("<u8")
    label = np.arange(n)
    reach = first_block[group] + n_blocks[group] - own  # own block and those after it
    ends = np.cumsum(reach)
    lo = 0
    while lo < n:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + TILE, side="right")))
        rows = np.repeat(np.arange(lo, hi), reach[lo:hi])
        block = own[rows] + np.arange(len(rows)) - np.repeat(ends[lo:hi] - reach[lo:hi] - base, reach[lo:hi])
        later = np.where(block == own[rows], ~((np.uint64(2) << (inside[rows] % 64).astype(np.uint64)) - np.uint64(1)), MAX)
        alive, c = valid[block] & later, Counters(len(rows), radius)
        step = 8 if bits == 64 else 64
        for b in range(0, bits, step):
            q = fps[rows, b >> 6]
            for j in range(b, b + step):
                c.add(planes[j, block] ^ (np.uint64(0) - ((q >> np.uint64(j & 63)) & np.uint64(1))))
            if b + step == bits:
                c.flush()
            at = np.flatnonzero(alive & ~c.over)
            if len(at) < 0.8 * len(rows):
                rows, block, alive = rows[at], block[at], alive[at]
                c.keep(at)
            if not len(at):
                break
        hits = alive & ~c.over
        some = np.flatnonzero(hits)
        for part in np.array_split(some, max(1, len(some) // 20_000)):
            if len(part):
                r, bit = np.nonzero(np.unpackbits(hits[part].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                a, b = rows[part][r], member[block[part][r] * 64 + bit]
                if sets is None:
                    union(label, a, b)
                else:
                    union_confirmed(label, a, b, sets)
        lo = hi
    return label


def union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of a and b in place; labels stay the smallest place of a component."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


class Sets:
    """Sorted hash sets (n of them) in files below `folder`, read when they are asked for; the last ones read are held."""

    def __init__(self, folder: str, file: np.ndarray, at: np.ndarray, size: np.ndarray):
        self.folder, self.file, self.at, self.size = folder, file, at, size
        self.held: OrderedDict[int, np.ndarray] = OrderedDict()
        self.n_held = 0

    def get(self, i: int) -> np.ndarray:
        if i in self.held:
            self.held.move_to_end(i)
            return self.held[i]
        out = np.fromfile(f"{self.folder}/{self.file[i]}", "<u8", self.size[i], offset=self.at[i])
        if len(out) != self.size[i]:
            raise OSError(f"{self.folder}/{self.file[i]} is cut short")
        self.held[i] = out
        self.n_held += len(out)
        while self.n_held > HELD and len(self.held) > 2:
            self.n_held -= len(self.held.popitem(last=False)[1])
        return out

    def may(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the sizes of the sets allow the similarity."""
        return 5 * np.minimum(self.size[a], self.size[b]) >= 4 * np.maximum(self.size[a], self.size[b])

    def similar(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the Jaccard similarity is 0.8 or more, pair by pair."""
        out = np.zeros(len(a), bool)
        for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            x, y = self.get(i), self.get(j)
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            both = int(np.count_nonzero(y[at] == x))
            out[k] = 5 * both >= 4 * (len(x) + len(y) - both)
        return out


def union_confirmed(label: np.ndarray, a: np.ndarray, b: np.ndarray, sets: Sets) -> None:
    """`union` of the pairs that the sets confirm. Pairs that are joined by then aren't looked at: they change nothing."""
    some = sets.may(a, b)
    a, b = a[some], b[some]
    for lo in range(0, len(a), PAIRS):
        x, y = a[lo : lo + PAIRS], b[lo : lo + PAIRS]
        for single in (True, True, False):  # at first one pair for each component, as most of a group of copies joins at once
            apart = label[x] != label[y]
            x, y = x[apart], y[apart]
            if not len(x):
                break
            at = np.unique(label[y], return_index=True)[1] if single else np.arange(len(x))
            ok = at[sets.similar(x[at], y[at])]
            union(label, x[ok], y[ok])
            x, y = np.delete(x, at), np.delete(y, at)


def grouped(batches: Iterator[pa.RecordBatch], rows: int = 1 << 17) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by their column `key`."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held)
        keys = t.column("key").to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield t.slice(0, cut)
            held = t.slice(cut).combine_chunks().to_batches()
            n = t.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def bucket_links(keyed: DataFrame, radius: int, words: int) -> DataFrame:
    """Edges (a, b) that join what lies within the radius under one key. Input: key, node (long), fp (long or binary).

    Links inside a bucket are joined at once, so a bucket gives fewer edges than it has rows.
    """

    def link(batches):
        for t in grouped(batches):
            keys = t.column("key").to_numpy()
            edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            sizes = np.diff(np.append(edge, len(keys)))
            keep = np.repeat(sizes, sizes) > 1
            node = t.column("node").to_numpy()[keep]
            if not len(node):
                continue
            if words == 1:
                fp = t.column("fp").to_numpy()[keep].view(np.uint64).reshape(-1, 1)
            else:
                fp = np.frombuffer(b"".join(t.column("fp").to_pylist()), "<u8").reshape(-1, words)[keep]
            label = within_groups(fp, sizes[sizes > 1], radius)
            at = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[label[at]])], names=["a", "b"])

    spread = keyed.repartition(partitions(keyed.sparkSession), "key").sortWithinPartitions("key")
    return spread.select("key", "node", "fp").mapInArrow(released(link), "a long, b long")


def set_links(keyed: DataFrame, folder: str, words: int = 0) -> DataFrame:
    """Edges (a, b) that join what has a similarity of 0.8 or more under one key. Input: key, node, fp, and where the sets are.

    Fingerprints within WIDE_RADIUS pick the pairs to compare; among short sets, whose bits differ more, those within SHORT_RADIUS.
    """
    words = words or WIDE

    def link(batches):
        for t in grouped(batches):
            keys, node, size = (t.column(c).to_numpy() for c in ("key", "node", "size"))
            for longest, radius in ((None, WIDE_RADIUS), (SHORT, SHORT_RADIUS)):
                some = np.arange(len(keys)) if longest is None else np.flatnonzero(size <= longest)
                if not len(some):
                    continue
                _, group, n = np.unique(keys[some], return_inverse=True, return_counts=True)
                some, n = some[n[group] > 1], n[n > 1]
                if not len(some):
                    continue
                at = t.take(pa.array(some))
                fp = np.frombuffer(b"".join(at.column("fp").to_pylist()), "<u8").reshape(-1, words)
                sets = Sets(folder, *(at.column(c).to_numpy() for c in ("file", "at", "size")))
                label = within_groups(fp, n, radius, sets)
                moved = np.flatnonzero(label != np.arange(len(label)))
                yield pa.RecordBatch.from_arrays([pa.array(node[some[moved]]), pa.array(node[some[label[moved]]])], names=["a", "b"])

    spread = keyed.repartition(partitions(keyed.sparkSession), "key").sortWithinPartitions("key")
    return spread.select("key", "node", "fp", "file", "at", "size").mapInArrow(released(link), "a long, b long")


def refine(keyed: DataFrame, again: Callable[[DataFrame], DataFrame | None], limit: int = BUCKET) -> list[DataFrame]:
    """Parts of `keyed` whose keys have at most `limit` rows; the rows of fuller keys are keyed anew, while `again` can."""
    parts = []
    while True:
        full = checkpoint(keyed.groupBy("key").count().where(F.col("count") > limit).select("key"))
        if full.isEmpty():
            return [*parts, keyed]
        more = again(keyed.join(full, "key", "left_semi"))
        if more is None:
            return [*parts, keyed]
        parts.append(keyed.join(full, "key", "left_anti"))
        keyed = checkpoint(more)


def bands(rows: DataFrame) -> DataFrame:
    """Key each (node, fp, used, key) by four bands of the bits that `used` doesn't hold yet."""

    def cut(batches):
        for b in batches:
            fp, used, key = (b.column(i).to_numpy().view(np.uint64) for i in range(3))
            out = []
            for mask in np.unique(used):
                at = np.flatnonzero(used == mask)
                free = [i for i in range(64) if not int(mask) >> i & 1]
                for part in np.array_split(free, 4):
                    band = np.uint64(sum(1 << int(i) for i in part))
                    new = mix(mix(fp[at] & band, 1) ^ key[at], int(band) & 0xFFFF_FFFF ^ int(band) >> 32)
                    out.append((fp[at], np.full(len(at), mask | band), new))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in zip(*out, strict=True)], names=["fp", "used", "key"])

    return rows.select("fp", "used", "key").mapInArrow(released(cut), "fp long, used long, key long").withColumn("node", F.col("fp"))


def link_fingerprints(fps: DataFrame, radius: int = 3, limit: int = BUCKET) -> DataFrame:
    """(node, label) of fingerprints (column fp, distinct) that have others within the radius, which is 3 at most."""
    if not 0 <= radius <= 3:
        raise ValueError("four bands prove links of at most three differing bits")
    depth = 0

    def again(rows: DataFrame) -> DataFrame | None:
        nonlocal depth
        depth += 1
        return bands(rows) if depth < 5 else None  # then 15 bits are free: at most 32,768 fingerprints under a key

    keyed = checkpoint(bands(fps.select("fp", F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("key"))))
    edges = None
    for part in refine(keyed, again, limit):
        found = bucket_links(part, radius, 1)
        edges = found if edges is None else edges.union(found)
    return components(edges)


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", limit: int = BUCKET) -> DataFrame:
    """doc_id, fp, component_id: fingerprints within the radius are linked, and a component has its smallest doc_id.

    Texts without words (null too) have fingerprint 0, linked like any other. Equal fingerprints meet in one aggregate
    before any comparison, so a group of copies costs one row. A component whose ids are all null has a null id;
    repeated rows get equal results; an empty table gives none.
    """
    base = checkpoint(fingerprints(docs, k, id_col, text_col))
    fps = checkpoint(base.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = link_fingerprints(fps, radius, limit)
    named = fps.join(labels, fps.fp == labels.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    smallest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = named.select("fp", "label").join(smallest, "label").select("fp", "component_id")
    return base.join(ids, "fp").select("doc_id", "fp", "component_id")


#: Near-duplicates of word shingles: width in 64-bit words, words of a shingle, and how many keys a text has.
WIDE, WORDS, ANCHORS = 16, 5, 8
#: Differing bits of 1024 up to which two sets of shingles are compared: a Jaccard similarity of 0.8 gives 155 on average,
#: give or take 11. Few shingles give more, 4 against 5 gives 192: sets of up to SHORT have a radius of their own.
WIDE_RADIUS, SHORT, SHORT_RADIUS = 210, 12, 288
#: Shingles beyond which a text under a full key is keyed again, and full keys up to which they are broadcast.
PAIRED, FEW = 50, 50_000
#: Hashes of sets that a task holds, and pairs that are looked at before those joined by then are left out.
HELD, PAIRS = 1 << 22, 1 << 16


def wide_fingerprints(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, words: int = WIDE, anchors: int = ANCHORS) -> DataFrame:
    """doc_id, h (hash of the text), node (hash of its set of shingles), fp (binary), anchors, and where the set is: file, at, size.

    Each task writes its sets to a file of its own below `folder`. The shingles' hashes are dealt to `anchors` bins,
    and the least hash of each bin is a key: two texts of similarity s share each key with probability s.
    """

    def make(batches):
        file, written, end = uuid.uuid4().hex, {}, 0
        with open(f"{folder}/{file}", "wb") as out:
            for b in batches:
                for lo, hi, counts, h in blocks(b.column(2), k, distinct=True):
                    fp = np.zeros((hi - lo, words), np.uint64)
                    keys: list[list[int]] = [[] for _ in range(hi - lo)]
                    some = np.flatnonzero(counts)
                    if len(some):
                        for j in range(words):
                            fp[some, j] = majority(mix(h, j + 1), counts[some])
                        starts = np.concatenate(([0], np.cumsum(counts[some])[:-1]))
                        order = mix(h, 99)
                        for j in range(anchors):
                            least = np.minimum.reduceat(np.where(h % np.uint64(anchors) == j, order, MAX), starts)
                            for i in np.flatnonzero(least < MAX):
                                keys[some[i]].append(int((least[i] ^ np.uint64(j)).view(np.int64)))
                    node, at = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.int64)
                    for i, one in enumerate(np.split(h, np.cumsum(counts)[:-1])):
                        raw = one.tobytes()
                        node[i] = name = xxhash.xxh64_intdigest(raw)
                        if name not in written:
                            written[name], end = end, end + len(raw)
                            out.write(raw)
                        at[i] = written[name]
                    columns = [pa.array(node.view(np.int64)), pa.array([x.tobytes() for x in fp], pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array([file] * (hi - lo)), pa.array(at), pa.array(counts, pa.int64())]
                    out.flush()
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), *columns], names=["doc_id", "h", "node", "fp", "anchors", "file", "at", "size"])

    df = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).cast("string").alias("text"))
    return df.mapInArrow(released(make), f"doc_id {df.schema['doc_id'].dataType.simpleString()}, h long, node long, fp binary, anchors array<long>, file string, at long, size long")


def full_keys(keyed: DataFrame, limit: int) -> tuple[DataFrame | None, Callable[[DataFrame], DataFrame]]:
    """(the keys of more than `limit` rows or None, how to hand them to a join: broadcast where they are few)."""
    full = checkpoint(keyed.groupBy("key").count().where(F.col("count") > limit).select("key"))
    n = full.limit(FEW + 1).count()
    return (full if n else None), (F.broadcast if n <= FEW else lambda df: df)


def in_blocks(keyed: DataFrame, limit: int = BUCKET) -> DataFrame:
    """`keyed` with the rows under each key of more than `limit` dealt to blocks; each new key has two blocks that may be similar.

    Sets of similarity 0.8 have sizes in the same or in neighbouring classes of a ratio of 1.26, so only such blocks meet.
    A class is dealt to its blocks by hash. No link of the old key is lost, and no new key has many more rows than `limit`.
    """
    columns = keyed.columns
    full, hand = full_keys(keyed, limit)
    if full is None:
        return keyed
    rows = keyed.join(hand(full), "key", "left_semi").withColumn("rung", F.floor(F.log("size") / F.log(F.lit(1.26))))
    n = checkpoint(rows.groupBy("key", "rung").agg(F.ceil(F.count("*") / F.lit(max(1, limit // 2))).alias("n")))
    beside = [n.select("key", (F.col("rung") + by).alias("rung"), F.col("n").alias(name)) for by, name in ((1, "below"), (-1, "above"))]
    cut = n.join(beside[0], ["key", "rung"], "left").join(beside[1], ["key", "rung"], "left")
    mine = rows.join(cut, ["key", "rung"]).withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("n")))

    def meet(many: str, low: Callable, high: Callable):
        count = F.coalesce(F.col(many), F.lit(0)).cast("long")
        others = F.filter(F.sequence(F.lit(-1).cast("long"), count - 1), lambda j: j >= 0)
        return F.transform(others, lambda j: F.xxhash64("key", *low(j), *high(j)))

    rung, block = F.col("rung"), F.col("block")
    own = meet("n", lambda j: (rung, F.least(block, j)), lambda j: (rung, F.greatest(block, j)))
    below = meet("below", lambda j: (rung - 1, j), lambda j: (rung, block))
    above = meet("above", lambda j: (rung, block), lambda j: (rung + 1, j))
    dealt = mine.withColumn("key", F.explode(F.concat(own, below, above))).select(*columns)
    return keyed.join(hand(full), "key", "left_anti").select(*columns).union(dealt)


def bounded_keys(nodes: DataFrame, limit: int = BUCKET) -> DataFrame:
    """key, node, fp, file, at, size of every node (with its `anchors`), under keys of about `limit` rows.

    A passage that very many texts share makes full keys. There a text of more than PAIRED shingles is keyed again by the
    full key together with each other anchor: a pair of similarity 0.8 has but the full one in common with probability 0.00008,
    while texts that only share the passage part. Shorter texts, which have few anchors, and what is still full then are cut
    into blocks that all meet. Any similar pair lies on one side whole: their sizes differ by a quarter at most.
    """
    columns = ["key", "node", "fp", "file", "at", "size"]
    keyed = nodes.select(F.explode("anchors").alias("key"), *columns[1:], "anchors")
    full, hand = full_keys(nodes.select(F.explode("anchors").alias("key")), limit)
    if full is None:
        return keyed.select(*columns)
    crowded = keyed.join(hand(full), "key", "left_semi")
    both = F.transform(F.array_remove("anchors", F.col("key")), lambda a: F.xxhash64(F.least(a, F.col("key")), F.greatest(a, F.col("key"))))
    paired = crowded.where(F.col("size") > PAIRED).withColumn("key", F.explode(both)).select(*columns)
    short = crowded.where(5 * F.col("size") <= 5 * PAIRED + 2 * PAIRED).select(*columns)
    rest = keyed.join(hand(full), "key", "left_anti").select(*columns)
    return rest.union(in_blocks(paired.dropDuplicates(["key", "node"]), limit)).union(in_blocks(short, limit))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = BUCKET) -> DataFrame:
    """doc_id, h, label of every document; near-duplicates, directly or through others, have one label.

    Near-duplicates are texts whose sets of shingles have a Jaccard similarity of 0.8 or more.

    Texts are compared that share a key; where more than `limit` different ones share it, as `bounded_keys` says. Equal sets of shingles are one node, so copies cost nothing here.
    """
    folder = local_path(shared_dir(docs.sparkSession))
    os.makedirs(folder)
    base = checkpoint(wide_fingerprints(docs, folder, id_col, text_col))
    one = base.groupBy("node").agg(F.first(F.struct("fp", "anchors", "file", "at", "size")).alias("one"))
    nodes = checkpoint(one.select("node", "one.*"))
    labels = components(set_links(bounded_keys(nodes, limit), folder))
    return base.select("doc_id", "h", "node").join(labels, "node", "left").select("doc_id", "h", F.coalesce("label", "node").alias("label"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each group the row with the smallest id (nulls last) stays.

    What goes is looked up by each row's own key, so no text is shuffled. Rows with equal id and text are one
    document and one of them stays.
    """
    groups = checkpoint(near_groups(docs, id_col, text_col, **options))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("h"))
    first = groups.groupBy("label").agg(F.min(rank).alias("first"))
    rows = groups.groupBy("label", "doc_id", "h").agg(F.count("*").alias("n")).join(first, "label")
    stays = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.h") == F.col("h"))
    told = rows.where(~stays | (F.col("n") > 1)).select(F.xxhash64("doc_id", "h").alias("h"), F.when(stays, 2).otherwise(1).alias("what"))
    spark = docs.sparkSession
    bits = max(4, min(16, docs.rdd.getNumPartitions().bit_length()))
    store = hashstore.build(told.groupBy("h").agg(F.max("what").alias("what")), shared_dir(spark), bits, ["what"], ["u1"])

    def choose(want: int):
        def run(batches):
            for b in batches:
                key = b.column(b.num_columns - 1).to_numpy().view(np.uint64)
                order = np.argsort(key)
                _, (what,) = store.lookup(key[order])
                mine = np.zeros(len(key), bool)
                mine[order] = what == want
                yield b.filter(pa.array(mine))

        return run

    key = free_name("_key", docs.columns)
    keyed = docs.withColumn(key, F.xxhash64(F.col(id_col), F.xxhash64(text_col)))
    out = keyed.mapInArrow(released(choose(0)), keyed.schema).select(*docs.columns)
    if told.where("what = 2").isEmpty():
        return out
    return out.union(keyed.mapInArrow(released(choose(2)), keyed.schema).dropDuplicates([key]).select(*docs.columns))
