"""Vector code compression: product codebooks of whole numbers, searched through vector-approximation files.

A vector is cut into equal parts; each part becomes the index of its codebook's nearest entry. The coordinates of the entries
are quantised to a few bits. For a part that asks, a table of each dimension has the least and the largest squared
distance to every cell; summed over the dimensions they bound its distance to every entry, and only entries whose lower bound
doesn't exceed the least upper bound are compared, in whole numbers. Nothing is lost by that: the nearest entries are always among them.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, free_name, released
from .vectors import complete, matrix

PARTS, ENTRIES, ROUNDS, SCALE, BITS = 16, 64, 2, 256, 4
#: Parts that are compared at a time.
BLOCK = 4096
#: Labels up to which their sums are broadcast, and the parts that the rows of one label are dealt to beyond.
FEW, SALTS = 50_000, 64


@dataclass
class Cells:
    """The entries (k, w) of one codebook, with the cell of each coordinate and the span (w, cells) of what lies in it."""

    entries: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray, bits: int = BITS) -> Cells:
        k, w = entries.shape
        least, most = entries.min(0), entries.max(0)
        cell = ((entries - least) * (1 << bits)) // (most - least + 1)
        low, high = np.zeros((w, 1 << bits), np.int64), np.zeros((w, 1 << bits), np.int64)
        for d in range(w):
            for c in np.unique(cell[:, d]):
                low[d, c], high[d, c] = (f(entries[cell[:, d] == c, d]) for f in (np.min, np.max))
        return cls(entries, cell, low, high)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (k, m) of the squared distances of the parts q (m, w) to the entries, by tables of the cells."""
        lower, upper = np.zeros((2, len(self.entries), len(q)), np.int64)
        for d in range(q.shape[1]):
            below, above = self.low[d][:, None] - q[None, :, d], q[None, :, d] - self.high[d][:, None]
            lower += (np.maximum(np.maximum(below, above), 0) ** 2)[self.cell[:, d]]
            upper += (np.maximum(-below, -above) ** 2)[self.cell[:, d]]
        return lower, upper

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each part; of equally near ones the first."""
        k, index, dist = len(self.entries), np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        for lo in range(0, len(q), BLOCK):
            some = q[lo : lo + BLOCK]
            lower, upper = self.bounds(some)
            who, entry = np.nonzero((lower <= upper.min(0)).T)
            exact = ((some[who] - self.entries[entry]) ** 2).sum(1)
            first = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
            best = np.minimum.reduceat(exact * k + entry, first)
            index[lo : lo + BLOCK], dist[lo : lo + BLOCK] = best % k, best // k
        return index, dist


@dataclass
class Codebooks:
    """Entries of each part position: lists of (k, width) arrays; `limit` is where components are held."""

    scale: float
    limit: int
    parts: list[np.ndarray]

    def grid(self, column: pa.Array) -> np.ndarray:
        """floor(scale * x) of a batch of vectors."""
        return np.clip(np.floor(matrix(column) * self.scale), -self.limit, self.limit).astype(np.int64)

    def cut(self, x: np.ndarray) -> list[np.ndarray]:
        return np.split(x, np.cumsum([p.shape[1] for p in self.parts])[:-1], axis=1)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for p in self.parts for v in p.ravel().tolist()).encode()).hexdigest()

    def decode(self, code: str) -> np.ndarray:
        """The vector that a code (two hex digits a part) stands for."""
        return np.concatenate([p[int(code[2 * i : 2 * i + 2], 16)] for i, p in enumerate(self.parts)]) / self.scale


def first_entries(rows: DataFrame, id_col: str, vec_col: str, entries: int) -> list:
    """Vectors of the `entries` smallest ids, ascending; of rows with one id the smallest vector counts, null ids never."""
    ids = rows.where(F.col(id_col).isNotNull()).select(id_col).distinct().orderBy(id_col).limit(entries)
    least = [r[0] for r in ids.collect()]
    if not least:
        return []
    # Rows of one id and vector meet before the shuffle, so copies cost nothing.
    found = rows.where(F.col(id_col).isin(least)).select(id_col, vec_col).distinct().groupBy(id_col).agg(F.min(vec_col).alias("v"))
    return [r["v"] for r in sorted(found.collect(), key=lambda r: r[0])]


def fit(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> Codebooks:
    """Codebooks by `rounds` of assignment and floored means, from the vectors of the smallest ids.

    All arithmetic is in whole numbers, so the result doesn't depend on how rows are dealt. Components are held where a
    squared distance still fits in 64 bits (beyond 90,000 for 64 dimensions). Vectors whose length isn't a multiple of
    `parts` have leading parts one longer. Fewer ids than entries make smaller codebooks; without any there are no entries.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part, so 1 to 256 entries")
    rows = complete(df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")), "v")
    seeds = np.array(first_entries(rows, "id", "v", entries), float)
    if not len(seeds):
        return Codebooks(scale, 0, [])
    d = seeds.shape[1]
    limit = math.isqrt(((1 << 63) - 1) // (d * entries)) // 2
    start = np.clip(np.floor(seeds * scale), -limit, limit).astype(np.int64)
    books = Codebooks(scale, limit, np.array_split(start, parts, axis=1))

    def sums(batches, books: Codebooks):
        cells = [Cells.of(p) for p in books.parts]
        n = [np.zeros(len(p), np.int64) for p in books.parts]
        s = [np.zeros_like(p) for p in books.parts]
        for b in batches:
            if b.num_rows:
                for i, q in enumerate(books.cut(books.grid(b.column(0)))):
                    index, _ = cells[i].nearest(q)
                    n[i] += np.bincount(index, minlength=len(n[i]))
                    np.add.at(s[i], index, q)
        for i, p in enumerate(books.parts):
            k, w = p.shape
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k * w, i), pa.int32()), pa.array(np.repeat(np.arange(k), w), pa.int32()), pa.array(np.tile(np.arange(w), k), pa.int32()), pa.array(np.repeat(n[i], w)), pa.array(s[i].ravel())], names=["part", "entry", "place", "n", "s"])

    for _ in range(rounds):
        run = lambda batches, now=books: sums(batches, now)
        found = rows.select("v").mapInArrow(released(run), "part int, entry int, place int, n long, s long").groupBy("part", "entry", "place")
        moved = [p.copy() for p in books.parts]
        for r in found.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():  # a number of each entry
            if r.n:
                moved[r.part][r.entry, r.place] = int(r.s) // r.n
        books = Codebooks(scale, limit, moved)
    return books


def encode(df: DataFrame, books: Codebooks, carry: list[str], vec_col: str = "embedding") -> DataFrame:
    """The columns of `carry`, code and error of every row that has a complete vector of the codebooks' length."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry)
    out = [free_name(c, carry) for c in ("code", "error")]
    schema = f"{kinds}, {out[0]} string, {out[1]} long"
    width = sum(p.shape[1] for p in books.parts)
    rows = complete(df.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(carry)], F.col(vec_col).alias("_v")), "_v").where(F.size("_v") == width)

    def run(batches):
        cells = [Cells.of(p) for p in books.parts]
        for b in batches:
            if b.num_rows:
                found = [cells[i].nearest(q) for i, q in enumerate(books.cut(books.grid(b.column(b.num_columns - 1))))]
                raw = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x.tobytes().hex() for x in raw]), pa.array(sum(f[1] for f in found), pa.int64())], names=[*carry, *out])

    return rows.mapInArrow(released(run), schema)


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", **options) -> DataFrame:
    """vec_id, code, error, label_error (summed over equal labels, nulls together), codebooks_sha256 of each remaining row.

    Rows without a complete vector are dropped; repeated rows and null ids stay rows of their own (null ids give no first
    entries; where all ids are null there are no codebooks and no rows); ties go to the lower index; an empty table gives none.
    `label_error` is null beyond 64 bits. Other columns aren't read.
    """
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("embedding"))
    books = fit(rows, "vec_id", "embedding", **options)
    coded = checkpoint(encode(rows, books, ["vec_id", "label"]))
    totals = checkpoint(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")))
    if totals.limit(FEW + 1).count() <= FEW:
        each = totals.select(F.col("label").alias("of"), "label_error")
        joined = coded.join(F.broadcast(each), F.col("label").eqNullSafe(F.col("of")))
    else:
        each = totals.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        dealt = coded.withColumn("part", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
        joined = dealt.join(each, F.col("label").eqNullSafe(F.col("of")) & (F.col("part") == F.col("salt")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
