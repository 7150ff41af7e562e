"""Sorted hash arrays: an immutable map from 64-bit keys to numbers, made by Spark and memory-mapped by workers.

A store is a folder with one file for each range of the key's leading bits. A file holds its keys in
ascending order, then each value column. Readers map the files and binary-search them, so a worker
holds only the pages that it touches and the store may be larger than its memory.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import local_path


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int32)


def write_shard(folder: str, shard: int, keys: np.ndarray, values: list[np.ndarray]) -> int:
    """Write one file whole or not at all: a repeated task replaces it by the same content."""
    path = local_path(folder)
    os.makedirs(path, exist_ok=True)
    part = f"{path}/.{shard}-{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        for x in (keys, *values):
            f.write(np.ascontiguousarray(x).tobytes())
    os.replace(part, f"{path}/{shard}.bin")
    return len(keys)


class HashStore:
    """Reader of a store. `dtypes` are those of the value columns; `sizes` maps each shard to its number of keys. The
    shards in `wide` have 64-bit values throughout, because theirs don't fit the usual types."""

    def __init__(self, folder: str, bits: int, dtypes: list[str], sizes: dict[int, int], wide: frozenset[int] = frozenset()):
        self.folder, self.bits, self.dtypes, self.sizes, self.wide = folder, bits, dtypes, sizes, wide
        self._open: dict[int, list[np.ndarray]] = {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def shard(self, k: int) -> list[np.ndarray] | None:
        if k not in self._open and self.sizes.get(k):
            n, at, out = self.sizes[k], 0, []
            for d in ("<u8", *(["<i8"] * len(self.dtypes) if k in self.wide else self.dtypes)):
                out.append(np.memmap(f"{local_path(self.folder)}/{k}.bin", dtype=d, mode="r", offset=at, shape=(n,)))
                at += n * np.dtype(d).itemsize
            self._open[k] = out
        return self._open.get(k)

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(found, values) of ascending keys; values of missing keys are 0."""
        found = np.zeros(len(keys), dtype=bool)
        values = [np.zeros(len(keys), dtype="<i8" if self.wide else d) for d in self.dtypes]
        shards = shard_of(keys, self.bits)
        edges = np.searchsorted(shards, np.arange((1 << self.bits) + 1))
        for k in np.unique(shards):
            own = self.shard(int(k))
            if own is None:
                continue
            lo, hi = edges[k], edges[k + 1]
            at = np.minimum(np.searchsorted(own[0], keys[lo:hi]), len(own[0]) - 1)
            ok = own[0][at] == keys[lo:hi]
            found[lo:hi] = ok
            for v, x in zip(values, own[1:], strict=True):
                v[lo:hi] = np.where(ok, x[at], 0)
        return found, values


def build(df: DataFrame, folder: str, bits: int, names: list[str], dtypes: list[str]) -> HashStore:
    """Store the rows (h, *names) of df, one for each key h. Keys are hashes, so the shards are even.

    Spark shuffles each row once, to the task of its shard; what comes to the driver is one count a shard.
    """

    def save(t: pa.Table) -> pa.Table:
        h = t.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h)
        k = t.column("shard")[0].as_py()
        n = write_shard(folder, k, h[order], [t.column(c).to_numpy()[order].astype(d) for c, d in zip(names, dtypes, strict=True)])
        return pa.table({"shard": pa.array([k], pa.int32()), "n": pa.array([n], pa.int64())})

    sharded = df.withColumn("shard", F.shiftrightunsigned("h", 64 - bits).cast("int"))
    sizes = sharded.groupBy("shard").applyInArrow(save, "shard int, n long").collect()
    return HashStore(folder, bits, dtypes, {r.shard: r.n for r in sizes})
