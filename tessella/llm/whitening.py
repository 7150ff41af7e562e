"""Embedding whitening by a tiled covariance.

Vectors are put on a grid of whole numbers, so that sums, means and deviations are exact. The covariance is made of tiles:
the dimensions are cut into column blocks, a pair of blocks is a tile key, the rows are cut into row blocks, and each
column block is shuffled to the tiles that it belongs to, under its row block. A task multiplies the pairs that meet and adds
them up per tile; partial tiles are added up in two steps. The tiles, whose size depends on the dimensions alone, are put
together and decomposed on the driver, and the rows are projected by the tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, partitions, released
from .vectors import complete, matrix

#: Least width of a column block, most column blocks, bytes of a block, and dimensions that a model may have.
TILE, BLOCKS, BLOCK_BYTES, MOST = 32, 4, 1 << 18, 8192
#: Partial sums of a tile are added up in so many groups first.
SALTS = 32
#: Grid values are held within this, so that sums of two never overflow.
LIMIT = 1e15
#: Components of less variance than this share of the first have no direction that rounding leaves, and are left out.
LEAST_SHARE = 1e-10


@dataclass
class Whitening:
    """The fit list's size and sums (exact), unit eigenvectors (d, k), their eigenvalues and shares, and the check of the result."""

    scale: float
    offset: int
    n: int
    sums: list[int]
    axes: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n in double precision: whole means are taken off exactly, then what is left of them."""
        return centred(x, self.n, self.sums)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n*x - S)^2 of each row, exact; None where it is beyond 64 bits."""
        whole = [round(s / self.n) for s in self.sums]
        rest = [s - self.n * w for s, w in zip(self.sums, whole, strict=True)]
        at = x - np.array(whole, np.int64)
        most = self.n * int(np.abs(at).max(initial=0)) + max(map(abs, rest), default=0)
        if len(rest) * most * most < 1 << 63:
            return ((self.n * at - np.array(rest, np.int64)) ** 2).sum(1).tolist()
        found = (((at.astype(object) * self.n - np.array(rest, object)) ** 2).sum(1)).tolist()
        return [v if v < 1 << 63 else None for v in found]

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes / np.sqrt(self.variances)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    whole = [round(s / n) for s in sums]
    rest = np.array([(s - n * w) / n for s, w in zip(sums, whole, strict=True)])
    return (x - np.array(whole, np.int64)).astype(float) - rest


def on_grid(df: DataFrame, vec_col: str, scale: float, offset: int, to_col: str) -> DataFrame:
    """The rows of `df` with a complete vector, and `to_col`: floor(scale * c) + offset of each entry c (array<long>)."""
    inside = lambda c: F.greatest(F.least(c.cast("double") * F.lit(float(scale)), F.lit(LIMIT)), F.lit(-LIMIT))
    return complete(df, vec_col).withColumn(to_col, F.transform(vec_col, lambda c: F.floor(inside(c)) + F.lit(offset).cast("long")))


def totals(points: DataFrame) -> tuple[int, list[int]]:
    """(rows, sum of each dimension) of the column x, exact however large."""

    def run(batches):
        n, high, low = 0, 0, 0
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0), np.int64)
                n, high, low = n + len(x), high + (x >> 20).sum(0), low + (x & 0xFFFFF).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(high)), pa.int32()), pa.array(np.full(len(high), n)), pa.array(high), pa.array(low)], names=["dim", "n", "high", "low"])

    parts = points.select("x").mapInArrow(released(run), "dim int, n long, high long, low long")
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]
    found = sorted(parts.groupBy("dim").agg(*exact).collect())  # a row a dimension
    return (int(found[0]["n"]) if found else 0), [int(r["high"]) * (1 << 20) + int(r["low"]) for r in found]


def products(points: DataFrame, width: int, columns: Callable[[np.ndarray], np.ndarray], tile: int | None = None) -> np.ndarray:
    """Y'Y, where Y (rows, width) is what `columns` makes of the column x, by tiles.

    `points` must give the same rows in the same order whenever it is read (checkpoint it): a block that is made again is then the same.
    """
    tile = tile or max(TILE, -(-width // BLOCKS))
    starts = list(range(0, width, tile))
    pairs = [(i, j) for i in range(len(starts)) for j in range(i, len(starts))]
    rows = max(16, BLOCK_BYTES // (8 * tile))

    def cut(batches):
        first, seen = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            for lo in range(0, b.num_rows, rows):
                y = columns(matrix(b.column(0).slice(lo, rows), np.int64))
                data = [np.ascontiguousarray(y[:, s : s + tile]).tobytes() for s in starts]
                made = [(i, j, side, data[(i, j)[side]]) for i, j in pairs for side in range(1 + (i != j))]
                out = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([*out[:2], pa.array([first + seen] * len(made), pa.int64()), *out[2:]], names=["i", "j", "block", "side", "data"])
                seen += 1

    def multiply(batches):
        at, left, total = None, None, None
        for b in batches:
            for i, j, side, raw in zip(*(b.column(c).to_pylist() for c in ("i", "j", "side", "data")), strict=True):
                if (i, j) != at:
                    if at:
                        yield packed(*at, total)
                    at, total = (i, j), 0.0
                y = np.frombuffer(raw).reshape(-1, min(tile, width - starts[(i, j)[side]]))
                if i == j:
                    total = total + y.T @ y
                elif side == 0:
                    left = y
                else:
                    total = total + left.T @ y
        if at:
            yield packed(*at, total)

    def add(batches):
        at, total = None, 0.0
        for b in batches:
            for i, j, raw in zip(*(b.column(c).to_pylist() for c in ("i", "j", "data")), strict=True):
                at, total = (i, j), total + np.frombuffer(raw)
        yield packed(*at, total)

    key = ["i", "j", "block"]
    blocks = points.select("x").mapInArrow(released(cut), "i int, j int, block long, side int, data binary")
    dealt = blocks.repartition(partitions(points.sparkSession), *key).sortWithinPartitions(*key, "side")
    kind = "i int, j int, data binary"
    partial = dealt.mapInArrow(released(multiply), kind).withColumn("salt", F.spark_partition_id() % SALTS)
    summed = partial.groupBy("i", "j", "salt").applyInArrow(_streamed(add), kind).groupBy("i", "j").applyInArrow(_streamed(add), kind)
    out = np.zeros((width, width))
    for r in summed.toLocalIterator():  # at most BLOCKS * (BLOCKS + 1) / 2 tiles
        a, b = starts[r.i], starts[r.j]
        part = np.frombuffer(bytes(r.data)).reshape(min(tile, width - a), -1)
        out[a : a + tile, b : b + tile] = part
        out[b : b + tile, a : a + tile] = part.T
    return out


def packed(i: int, j: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([np.ascontiguousarray(total).tobytes()], pa.binary())], names=["i", "j", "data"])


def _streamed(run):
    """Marks a function of batches as one that reads a group as a stream."""
    from collections.abc import Iterator

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(batches)

    group.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return group


def fit(df: DataFrame, vec_col: str = "embedding", components: int = 16, scale: float = 64, offset: int = 1_000_000, tile: int | None = None) -> Whitening:
    """The whitening of the different grid vectors, each taken once, however many rows have it.

    Covariances have the divisor n. Where there is no variance, or no vector, there are no components.
    """
    points = checkpoint(on_grid(df.select(vec_col), vec_col, scale, offset, "x").select("x").distinct())
    n, sums = totals(points)
    d = len(sums)
    if d > MOST:
        raise ValueError(f"a covariance of {d} dimensions; {MOST} at most fit on the driver")
    if not n:
        return Whitening(scale, offset, 0, [], np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0.0)
    cov = products(points, d, lambda x: centred(x, n, sums), tile) / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    k = int((values[:components] > max(values[0], 0) * LEAST_SHARE).sum()) if values[0] > 0 else 0
    model = Whitening(scale, offset, n, sums, np.ascontiguousarray(axes[:, :k]), values[:k], values[:k] / max(np.trace(cov), 1e-300), 0.0)
    if k:
        model.identity_error = float(np.abs(products(points, k, model.whiten) / n - np.eye(k)).max())
    return model


def transform(df: DataFrame, model: Whitening, carry: list[str], vec_col: str = "embedding") -> DataFrame:
    """The columns of `carry`, whitened (array<double>, by falling variance) and deviation, of each row that has a complete vector.

    The vectors are expected to have the model's length; rows of any other are left out.
    """
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry)
    named = df.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(carry)], F.col(vec_col).alias("_v"))
    rows = on_grid(named, "_v", model.scale, model.offset, "_x").where(F.size("_x") == len(model.sums)).drop("_v")
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the dimensions: at most MOST times `components` numbers

    def run(batches):
        m = shared.value
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(b.num_columns - 1), np.int64)
                y = m.whiten(x)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists, pa.array(m.deviation(x), pa.int64())], names=[*carry, "whitened", "deviation"])

    return rows.mapInArrow(released(run), f"{kinds}, whitened array<double>, deviation long")


def components(df: DataFrame, k: int = 16, id_col: str = "vec_id", vec_col: str = "embedding", **options) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each remaining row and component.

    Rows without a complete vector are dropped; repeated rows and null ids stay rows of their own; an empty table, or one
    without any variance, gives no rows. `deviation` is null where it is beyond 64 bits. Only id and vector are read, so
    other columns can't clash.
    """
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("embedding"))
    model = fit(rows, "embedding", k, **options)
    told = F.array(*map(F.lit, model.explained.tolist())).cast("array<double>")
    each = transform(rows, model, ["vec_id"]).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(told, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
