"""Sharding by a keyed permutation of global row numbers.

Rows get the numbers 0 to N-1 in an order that depends on their content alone. A Feistel network
permutes the numbers; results at or beyond N walk on through the network until they fall below N, which
keeps the permutation exact. Permuted number p goes to shard p mod S, slot p div S. Both directions can
be computed without any table: `Feistel.forward` and `Feistel.backward`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

#: Row numbers are counted within this many hash ranges, so that no task sorts more than a sliver of the rows.
BUCKETS = 4096
#: Parts that equal rows are counted in, so that none gives more than a sliver of them back at once.
PARTS = 4096


class Feistel:
    """A keyed permutation of 0..n-1."""

    def __init__(self, n: int, seed: int, rounds: int = 6):
        self.n = n
        self.half = np.uint64(max(1, -(-max(1, n - 1).bit_length() // 2)))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = [np.uint64((seed * 0x9E3779B97F4A7C15 + (i + 1) * 0xD1B54A32D192ED03) & (2**64 - 1)) for i in range(rounds)]

    @staticmethod
    def _mix(x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))

    def _once(self, x: np.ndarray, keys: list[np.uint64], back: bool) -> np.ndarray:
        a, b = x >> self.half, x & self.mask
        for k in keys:
            if back:
                a, b = b ^ (self._mix(a, k) & self.mask), a
            else:
                a, b = b, a ^ (self._mix(b, k) & self.mask)
        return (a << self.half) | b

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        keys = self.keys[::-1] if back else self.keys
        with np.errstate(over="ignore"):
            out = self._once(x.astype(np.uint64), keys, back)
            while (far := out >= np.uint64(self.n)).any():
                out[far] = self._once(out[far], keys, back)
        return out.astype(np.int64)

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self._walk(np.asarray(x), False)

    def backward(self, x: np.ndarray) -> np.ndarray:
        return self._walk(np.asarray(x), True)


def number_rows(df: DataFrame, buckets: int = BUCKETS, parts: int = PARTS) -> tuple[DataFrame, int]:
    """(df with `row_number` 0..N-1, N). The number depends on the rows' content only.

    Equal rows are counted before anything is sorted, in `parts` parts, and come back as that many rows with numbers
    in turn: all copies of one row cost `parts` rows at most. The different rows are dealt to hash ranges and placed inside each
    by running sums; the ranges' counts, at most `buckets` rows, give the offsets.
    """
    keys = df.columns
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts))
    counted = df.withColumn("_p", part).groupBy(*keys, "_p").agg(F.count("*").alias("_n"))
    dealt = checkpoint(counted.withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")))
    offsets, total = [0] * buckets, 0
    for r in sorted(dealt.groupBy("_b").agg(F.sum("_n").alias("_n")).collect(), key=lambda r: r["_b"]):
        offsets[r["_b"]] = total
        total += r["_n"]
    start = F.broadcast(df.sparkSession.createDataFrame(list(enumerate(offsets)), "_b int, _o long"))
    before = Window.partitionBy("_b").orderBy(*[F.col(k).asc_nulls_first() for k in keys], "_p").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_o") + F.coalesce(F.sum("_n").over(before), F.lit(0))
    placed = dealt.join(start, "_b").withColumn("_first", first)
    return placed.select(*keys, F.explode(F.sequence("_first", F.col("_first") + F.col("_n") - 1)).alias("row_number")), total


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal every row to a shard and a slot; shard counts are at most one apart and slots are gapless from 0.

    Returns doc_id, size (UTF-8 bytes + 1; null text counts as none), text_crc32, row_number, shard, slot.
    Null ids and repeated rows are rows like any other; an empty table gives an empty result. Only the id and
    the text of the input are used, so other columns can't clash. The text itself is never shuffled.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    numbered, total = number_rows(base.select("doc_id", "text_crc32", "size"))
    perm = Feistel(total, seed)

    def deal(batches):
        for b in batches:
            p = perm.forward(b.column("row_number").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((p % shards).astype(np.int32)), pa.array(p // shards)], names=[*b.schema.names, "shard", "slot"])

    out = numbered.select("doc_id", "size", "text_crc32", "row_number")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema)
    return out.mapInArrow(deal, f"{kinds}, shard int, slot long")
