"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard.

A graph is a few flat arrays (vectors, and for each layer an array of neighbours padded with -1), saved in the shared
folder and memory-mapped by the searching tasks. Vectors go in by batches and queries are searched by
batches: each step expands one node of every query at once, so the work is in array operations. The shards' results are
merged by distance.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, local_path, partitions, shared_dir

#: Neighbours of a node above the base layer (twice as many on it), width of the search while building and searching.
LINKS, BUILD_WIDTH, SEARCH_WIDTH = 12, 72, 96
#: A shard has this share of the vectors, within these bounds; the shards depend on the vectors alone, not on the cluster.
SHARD_SHARE, SHARD_LEAST, SHARD_MOST = 16, 4096, 250_000
#: Queries of one search task.
QUERY_BLOCK = 4096


def _pairs(x: np.ndarray) -> np.ndarray:
    """Squared distances (n, k, k) among the vectors (n, k, d)."""
    sq = np.einsum("nkd,nkd->nk", x, x)
    return np.maximum(sq[:, :, None] + sq[:, None, :] - 2 * (x @ x.transpose(0, 2, 1)), 0)


@dataclass
class Graph:
    """vectors (n, d) float32; level (n,); links[l] (n, width) int32, -1 for none; entry is a node of the top level."""

    vectors: np.ndarray
    level: np.ndarray
    links: list[np.ndarray]
    entry: int

    def search_layer(self, q: np.ndarray, start: np.ndarray, ef: int, layer: int, spread: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(ids, squared distances) of the ef nearest nodes found for each query, nearest first; -1 where there are fewer."""
        links, n = self.links[layer], len(self.vectors)
        b = len(q)
        rows = np.arange(b)[:, None]
        seen = np.zeros((b, n + 1), bool)
        seen[:, n] = True  # the place of -1
        ids = np.full((b, ef), -1, np.int32)
        dist = np.full((b, ef), np.inf, np.float32)
        k = start.shape[1]
        ids[:, :k] = start
        dist[:, :k] = self.distances(q, start)
        seen[rows, start] = True
        done = np.zeros((b, ef), bool)
        active = np.arange(b)
        while len(active):
            open_ = np.where(done[active] | (ids[active] < 0), np.inf, dist[active])
            pick = np.argpartition(open_, spread - 1, axis=1)[:, :spread] if ef > spread else np.argmin(open_, axis=1)[:, None]
            near = np.take_along_axis(open_, pick, 1)
            go = np.isfinite(near).any(1)
            active, pick, near = active[go], pick[go], near[go]
            if not len(active):
                break
            a = active[:, None]
            at = np.where(np.isfinite(near), ids[a, pick], -1)
            done[a, pick] = True
            new = np.where(at[:, :, None] >= 0, links[at], -1).reshape(len(active), -1)
            new = np.where(seen[a, new], -1, new)
            seen[a, new] = True
            seen[active, n] = True
            # A node may come from two of the expanded ones: keep it once.
            order = np.sort(new, axis=1)
            order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
            d = np.where(order >= 0, self.distances(q[active], order), np.inf).astype(np.float32)
            all_d = np.concatenate((dist[active], d), axis=1)
            best = np.argpartition(all_d, ef - 1, axis=1)[:, :ef]
            dist[active] = np.take_along_axis(all_d, best, 1)
            ids[active] = np.take_along_axis(np.concatenate((ids[active], order), axis=1), best, 1)
            done[active] = np.take_along_axis(np.concatenate((done[active], np.zeros(order.shape, bool)), axis=1), best, 1)
        ids[np.isinf(dist)] = -1
        order = np.argsort(dist, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)

    def distances(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        d = self.vectors[nodes] - q[:, None, :]
        return np.einsum("bkd,bkd->bk", d, d)

    def search(self, q: np.ndarray, k: int, ef: int = SEARCH_WIDTH) -> np.ndarray:
        """Nodes (queries, at most max(k, ef)), nearest first, -1 where there are fewer."""
        ef = min(max(ef, k), max(1, len(self.vectors)))
        out = []
        for lo in range(0, len(q), 128):
            part = np.ascontiguousarray(q[lo : lo + 128], np.float32)
            at = np.full((len(part), 1), self.entry)
            for layer in range(len(self.links) - 1, 0, -1):
                at = self.search_layer(part, at, 1, layer)[0]
            out.append(self.search_layer(part, at, ef, 0)[0])
        return np.concatenate(out) if out else np.zeros((0, ef), np.int32)

    def save(self, folder: str) -> None:
        path = local_path(folder)
        os.makedirs(path, exist_ok=True)
        for name, x in [("vectors", self.vectors), ("level", self.level), *((f"links{i}", x) for i, x in enumerate(self.links))]:
            part = f"{path}/.{name}-{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                np.save(f, x)
            os.replace(part, f"{path}/{name}.npy")

    @classmethod
    def load(cls, folder: str, layers: int, entry: int) -> Graph:
        get = lambda name: np.load(f"{local_path(folder)}/{name}.npy", mmap_mode="r")
        return cls(get("vectors"), get("level"), [get(f"links{i}") for i in range(layers)], entry)


def choose(owner: np.ndarray, ids: np.ndarray, dist: np.ndarray, vectors: np.ndarray, m: int) -> np.ndarray:
    """At most m of each row's candidates (ascending distance, -1 for none): first those nearer to the owner than
    to any that was chosen, then the nearest of the rest."""
    n, k = ids.shape
    ok = ids >= 0
    if k <= m:
        return np.pad(np.where(ok, ids, -1), ((0, 0), (0, m - k)), constant_values=-1)
    among = _pairs(vectors[np.maximum(ids, 0)])
    taken = np.zeros((n, k), bool)
    nearest = np.full((n, k), np.inf)
    for j in range(k):
        t = ok[:, j] & (dist[:, j] < nearest[:, j]) & (taken.sum(1) < m)
        taken[:, j] = t
        nearest[t] = np.minimum(nearest[t], among[t, j])
    rank = np.where(taken, 0, np.where(ok, 1, 2)) * k + np.arange(k)
    return np.take_along_axis(np.where(ok, ids, -1), np.argsort(rank, axis=1, kind="stable")[:, :m], 1)


def build(vectors: np.ndarray, seed: int = 11, links: int = LINKS, width: int = BUILD_WIDTH) -> Graph:
    """A graph over distinct vectors (n, d)."""
    vectors = np.ascontiguousarray(vectors, np.float32)
    n = len(vectors)
    rng = np.random.default_rng(seed)
    level = np.minimum((-np.log(1 - rng.random(n)) / np.log(links)).astype(np.int32), 8)
    top = int(level.max()) if n else 0
    order = np.argsort(-level, kind="stable")  # tall nodes first, so that every layer is there when it is searched
    g = Graph(vectors, level, [np.full((n, links * (1 if layer else 2)), -1, np.int32) for layer in range(top + 1)], int(order[0]) if n else 0)
    lo = 1
    while lo < n:
        new = order[lo : lo + min(256, lo)]
        q = vectors[new]
        at = np.full((len(new), 1), g.entry)
        inside = _pairs(q[None])[0].astype(np.float32)
        np.fill_diagonal(inside, np.inf)
        for layer in range(top, -1, -1):
            mine = level[new] >= layer
            if not mine.any():
                at = g.search_layer(q, at, 1, layer)[0]
                continue
            found, dist = g.search_layer(q, at, min(width, lo), layer)
            at = found[:, :1]
            # Members of the batch don't see each other in the graph yet: they are compared directly.
            own, peers = np.flatnonzero(mine), new[mine]
            near = np.where(found[own] >= 0, dist[own], np.inf)
            ids = np.concatenate((found[own], np.broadcast_to(peers, (len(own), len(peers)))), axis=1)
            d = np.concatenate((near, inside[np.ix_(own, own)]), axis=1)
            keep = np.argsort(d, axis=1, kind="stable")[:, :width]
            d = np.take_along_axis(d, keep, 1)
            ids = np.where(np.isfinite(d), np.take_along_axis(ids, keep, 1), -1)
            picked = choose(peers, ids, d, vectors, links)
            g.links[layer][peers, :links] = picked
            _link_back(g, layer, peers, picked)
        lo += len(new)
    return g


def _link_back(g: Graph, layer: int, peers: np.ndarray, picked: np.ndarray) -> None:
    """Add the new nodes to their neighbours' lists, and choose again where a list is full."""
    table = g.links[layer]
    m = table.shape[1]
    to, of = picked.ravel(), np.repeat(peers, picked.shape[1])
    to, of = to[to >= 0], of[to >= 0]
    while len(to):
        order = np.argsort(to, kind="stable")
        to, of = to[order], of[order]
        first = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        rank = np.arange(len(to)) - np.repeat(first, np.diff(np.append(first, len(to))))
        now = rank < m
        nodes = to[first]
        more = np.full((len(nodes), min(m, int(rank.max()) + 1)), -1, np.int32)
        row = np.searchsorted(nodes, to[now])
        more[row, rank[now]] = of[now]
        for lo in range(0, len(nodes), 1024):
            v, old = nodes[lo : lo + 1024], table[nodes[lo : lo + 1024]]
            extra = more[lo : lo + 1024]
            extra = np.where((extra[:, :, None] == old[:, None, :]).any(2), -1, extra)
            ids = np.concatenate((old, extra), axis=1)
            d = np.where(ids >= 0, g.distances(g.vectors[v], ids), np.inf)
            keep = np.argsort(d, axis=1, kind="stable")
            ids, d = np.take_along_axis(ids, keep, 1), np.take_along_axis(d, keep, 1)
            ids = np.where(np.isfinite(d), ids, -1)
            full = (ids >= 0).sum(1) > m
            table[v[~full]] = ids[~full, :m]
            if full.any():
                table[v[full]] = choose(v[full], ids[full], d[full], g.vectors, m)
        to, of = to[~now], of[~now]


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v of the rows that take part: neither id nor vector null, all components finite, not all zero, of the commonest length."""
    v = F.col(vec_col)
    plain = df.select(F.col(id_col).alias("vec_id"), v.cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    fine = plain.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
    sized = fine.withColumn("size", F.size("v"))
    common = sized.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    return sized.where(F.col("size") == (common["size"] if common else 0)).select("vec_id", "v")


def shard_count(n: int, size: int | None = None) -> int:
    """Shards for n vectors, of about `size` each."""
    return max(1, -(-n // (size or min(SHARD_MOST, max(SHARD_LEAST, n // SHARD_SHARE)))))


def nearest(df: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding", shard_size: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id is divisible by `every`, among all other rows.

    Score is the Euclidean distance in double precision on the original vectors; ties go to the smaller vec_id. Every
    vector is indexed. Equal vectors are one node that keeps its k + 1 smallest ids, which is all that k results can
    use, so copies neither distort the graph nor pile up. Exactly repeated rows count once. Vectors that take no part
    are those of `usable`. An empty table, or one without queries, gives no rows; other columns aren't read.

    A shard's nodes are put in the order of their smallest ids, and each attempt of a task writes to a folder of its own, whose name is
    its result: a repeated task gives the same graph, and files of two attempts never mix.
    """
    spark = df.sparkSession
    rows = checkpoint(usable(df, id_col, vec_col))
    first = Window.partitionBy("v").orderBy("vec_id")
    few = rows.distinct().withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    nodes = checkpoint(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    shards = shard_count(nodes.count(), shard_size)
    folder = shared_dir(spark)

    def index(t: pa.Table) -> pa.Table:
        ids = t.column("ids").combine_chunks()
        starts = ids.offsets.to_numpy()
        order = np.argsort(ids.values.to_numpy()[starts[:-1]])
        x = np.array(t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(t.num_rows, -1)[order]
        g, at = build(x), f"{folder}/{uuid.uuid4().hex}"
        g.save(at)
        sorted_ids = ids.take(pa.array(order))
        for name, a in (("exact", x), ("ids", sorted_ids.flatten().to_numpy()), ("offsets", sorted_ids.offsets.to_numpy() - sorted_ids.offsets[0].as_py())):
            np.save(f"{local_path(at)}/{name}.npy", a)
        return pa.table({"shard": pa.array([t.column("shard")[0].as_py()], pa.int32()), "layers": pa.array([len(g.links)], pa.int32()), "entry": pa.array([g.entry], pa.int32()), "at": pa.array([at])})

    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
    graphs = checkpoint(dealt.groupBy("shard").applyInArrow(index, "shard int, layers int, entry int, at string"))

    def keep(batches):
        path = local_path(f"{folder}/queries")
        os.makedirs(path, exist_ok=True)
        for b in batches:
            for lo in range(0, b.num_rows, QUERY_BLOCK):
                part = b.slice(lo, QUERY_BLOCK)
                name = f"{path}/{uuid.uuid4().hex}"
                np.save(f"{name}-id.npy", part.column(0).to_numpy())
                np.save(f"{name}-v.npy", np.array(part.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(part.num_rows, -1))
                yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    asked = rows.where(F.pmod(F.col("vec_id"), F.lit(every)) == 0).distinct()
    blocks = checkpoint(asked.coalesce(max(1, asked.count() // QUERY_BLOCK)).mapInArrow(keep, "name string"))

    def look(batches):
        last, g, exact, ids, offsets = None, None, None, None, None
        for b in batches:
            for r in b.to_pylist():
                if r["at"] != last:
                    last = r["at"]
                    g = Graph.load(last, r["layers"], r["entry"])
                    g = Graph(np.array(g.vectors), g.level, g.links, g.entry)
                    exact, ids, offsets = (np.load(f"{local_path(last)}/{x}.npy", mmap_mode="r") for x in ("exact", "ids", "offsets"))
                qid, q = np.load(f"{r['name']}-id.npy"), np.load(f"{r['name']}-v.npy")
                for lo in range(0, len(q), 512):
                    a, vec, s = best_of(g.search(q[lo : lo + 512], k + 1), qid[lo : lo + 512], q[lo : lo + 512], exact, ids, offsets, k)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(vec, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    # Each block of queries meets each shard: a row of names a task, made and dealt by Spark.
    tasks = blocks.select("name", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")).join(graphs, "shard").select("shard", "layers", "entry", "at", "name")
    found = tasks.repartition(partitions(spark), "shard", "name").sortWithinPartitions("shard").mapInArrow(look, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def best_of(got: np.ndarray, qid: np.ndarray, q: np.ndarray, exact: np.ndarray, ids: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vec_id, distance) of the k nearest other rows of each query among the nodes `got`, all ids of a node included."""
    query, at = np.nonzero(got >= 0)
    node = got[query, at]
    d = np.sqrt(((exact[node] - q[query]) ** 2).sum(1))
    copies = offsets[node + 1] - offsets[node]
    which = np.repeat(np.arange(len(node)), copies)
    inner = np.arange(len(which)) - np.repeat(np.cumsum(copies) - copies, copies)
    vec = ids[offsets[node[which]] + inner]
    a, s = qid[query[which]], d[which]
    other = vec != a
    a, s, vec = a[other], s[other], vec[other]
    order = np.lexsort((vec, s, a))
    a, s, vec = a[order], s[order], vec[order]
    start = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, int)
    rank = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
    return a[rank < k], vec[rank < k], s[rank < k]
