"""SentencePiece encoding and decoding: unigram Viterbi search over a double-array trie.

Pieces and their log scores come from a model file. White space becomes the marker U+2581, a marker is put before
the text, and characters without a piece fall back to their UTF-8 bytes. No piece has a marker after another character
(this is checked), so a text splits before each run of markers and every distinct stretch is searched once a
block, all of a block's stretches in lockstep.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, released, strings

MARK = "▁"
#: A character without a piece scores this much less than the worst piece, as in the public library.
UNKNOWN_PENALTY = 10.0
#: Stretches that a task remembers, and as many older ones, and characters of text that are encoded at once.
MEMO, BLOCK_CHARS = 60_000, 100_000


class DoubleArray:
    """A trie over bytes in two arrays: the child of s by byte c is base[s] + c + 1, if check[there] == s."""

    def __init__(self, keys: list[bytes]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for k, key in enumerate(keys):
            s = 0
            for c in key:
                if c not in children[s]:
                    children[s][c] = len(children)
                    children.append({})
                    value.append(-1)
                s = children[s][c]
            value[s] = k
        size = 4 * len(children) + 8192
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        free = np.ones(size, bool)
        free[0] = False
        self.value[0] = value[0]
        todo, lowest, sparse, ahead = [(0, 0)], 257, 257, np.arange(512)[:, None]
        while todo:
            node, at = todo.pop()
            codes = np.array(sorted(c + 1 for c in children[node]), np.int64)
            if not len(codes):
                continue
            while not free[lowest]:
                lowest += 1
            if len(codes) == 1:
                base = lowest - int(codes[0])
                while not free[base + codes[0]]:
                    base += 1
            else:  # below `sparse` hardly any place has room for several children
                base = max(lowest, sparse) - int(codes[0])
                while not len(fits := np.flatnonzero(free[base + ahead + codes].all(1))):
                    base += len(ahead)
                    sparse = base
                base += int(fits[0])
            self.base[at] = base
            for c in codes.tolist():
                to, child = base + c, children[node][c - 1]
                free[to], self.check[to], self.value[to] = False, at, value[child]
                todo.append((child, to))

    def matches(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, key) of every key that begins at one of `starts` and ends by its `stops`, longest first for each end."""
        out = []
        state, at, begin = np.zeros(len(starts), np.int32), starts.copy(), starts
        while len(at):
            on = at < stops
            state, at, begin, stops = state[on], at[on], begin[on], stops[on]
            to = self.base[state] + data[at] + 1
            ok = self.check[to] == state
            state, at, begin, stops = to[ok], at[ok] + 1, begin[ok], stops[ok]
            hit = self.value[state] >= 0
            out.append((begin[hit], at[hit], self.value[state[hit]]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (starts, starts, starts)


class Vocabulary:
    """Pieces, scores, byte pieces and the trie of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = np.full(256, -1, np.int32)
        keys, ids = [], []
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                keys.append(p.encode())
                ids.append(i)
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte fallback")
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("a piece crosses a white-space marker")
        probe = "A  béﬁ "
        if sp.decode(sp.encode(probe)) != probe:
            raise ValueError("the model normalises its input")
        self.ids = np.array(ids, np.int32)
        self.score = np.array([sp.get_score(i) for i in ids], np.float64)
        self.unknown = float(self.score.min()) - UNKNOWN_PENALTY
        self.trie = DoubleArray(keys)
        self.bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else p.encode() for i, p in enumerate(pieces)]
        self.is_byte = np.array([sp.is_byte(i) for i in range(n)])
        self.newline_apart = not any("\n" in p for p in pieces)
        self.digits = [str(i) for i in range(n)]
        self.spelled = [x.replace(MARK.encode(), b" ") for x in self.bytes]

    def segment(self, units: list[str]) -> list[np.ndarray]:
        """The ids of each stretch."""
        ids, edges = self.search(units)
        return [ids[lo:hi] for lo, hi in zip(edges, edges[1:], strict=False)]

    def search(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all stretches, where each starts and the last ends): the path of the highest score; among equals the
        one with the longest last piece, at each place."""
        raw = [u.encode() for u in units]
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int32)
        size = np.array([len(r) for r in raw], np.int64)
        stop = np.cumsum(size)
        first = stop - size
        unit = np.repeat(np.arange(len(raw)), size)
        head = np.flatnonzero((data & 0xC0) != 0x80)
        after = np.append(head[1:], len(data))
        begin, end, key = self.trie.matches(data, head, stop[unit[head]])
        whole = np.zeros(len(data), bool)
        width = np.zeros(len(data), np.int64)
        width[head] = after - head
        whole[begin[end - begin == width[begin]]] = True
        lone = ~whole[head]  # characters that are no piece by themselves
        begin, end = np.concatenate((begin, head[lone])), np.concatenate((end, after[lone]))
        gain = np.concatenate((self.score[key], np.full(lone.sum(), self.unknown)))
        key = np.concatenate((self.ids[key], np.full(lone.sum(), -1, np.int32)))
        own = unit[begin]
        depth = end - first[own]
        order = np.lexsort((begin, own, depth))
        begin, end, gain, key, own, depth = (x[order] for x in (begin, end, gain, key, own, depth))
        best = np.full(len(data) + len(raw), -np.inf)  # one place more for each unit: its end
        best[first + np.arange(len(raw))] = 0.0
        back = np.full(len(best), -1, np.int64)
        edges = np.searchsorted(depth, np.arange(1, (depth.max() if len(depth) else 0) + 2))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if lo == hi:
                continue
            to = end[lo:hi] + own[lo:hi]
            total = best[begin[lo:hi] + own[lo:hi]] + gain[lo:hi]
            group = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
            top = np.maximum.reduceat(total, group)
            tie = np.where(total == np.repeat(top, np.diff(np.append(group, hi - lo))), np.arange(lo, hi), len(depth))
            best[to[group]] = top
            back[to[group]] = np.minimum.reduceat(tie, group)
        own, e = self._walk_back(back, begin, stop, size)
        many = np.where(key[e] >= 0, 1, end[e] - begin[e])
        ids = np.repeat(key[e], many)
        within = np.arange(len(ids)) - np.repeat(np.cumsum(many) - many, many)
        spelled = ids < 0
        ids[spelled] = self.byte_id[data[(np.repeat(begin[e], many) + within)[spelled]]]
        return ids.astype(np.int32), np.concatenate(([0], np.cumsum(np.bincount(own, many, len(raw)).astype(np.int64))))

    @staticmethod
    def _walk_back(back: np.ndarray, begin: np.ndarray, stop: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unit, edge) of the best paths in order; a step goes back one edge in all units at once."""
        units, edges, steps = [], [], []
        on = np.flatnonzero(size)
        at = stop[on] + on
        while len(on):
            e = back[at]
            units.append(on)
            edges.append(e)
            steps.append(np.full(len(on), -len(steps)))
            at = begin[e] + on
            going = at > (stop - size)[on] + on
            on, at = on[going], at[going]
        if not units:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        unit, edge, step = (np.concatenate(x) for x in (units, edges, steps))
        order = np.lexsort((step, unit))
        return unit[order], edge[order]

    def units(self, text: str) -> list[str]:
        """The stretches of a text, with markers for blanks and one before it; an empty text has none."""
        if not text:
            return []
        lines = (MARK + text.replace(" ", MARK)).split("\n") if self.newline_apart else [MARK + text.replace(" ", MARK)]
        out = []
        for i, line in enumerate(lines):
            if i:
                out.append("\n")
            if line:
                if MARK + MARK in line:
                    out += re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", line)
                else:
                    head, *rest = line.split(MARK)
                    out += ([head] if head else []) + [MARK + x for x in rest]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD, and the first marker, which encoding put there, goes."""
        return self.spell(b"".join(map(self.spelled.__getitem__, ids.tolist())))

    @staticmethod
    def spell(raw: bytes) -> str:
        text = raw.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Stretches:
    """What is known of the stretches met so far: ids (as bytes of int32), the ids as text, and the bytes that they spell.

    A character's bytes never cross a stretch, so a text's ids and its decoded text are those of its stretches, joined.
    """

    def __init__(self, v: Vocabulary, remember: int = MEMO):
        self.v, self.remember, self.known, self.older = v, remember, {}, {}

    def learn(self, units: list[str]) -> None:
        v = self.v
        ids, edges = v.search(units)
        listed, raw, at = ids.tolist(), ids.tobytes(), edges.tolist()
        digits, spelled = list(map(v.digits.__getitem__, listed)), list(map(v.spelled.__getitem__, listed))
        for u, lo, hi in zip(units, at, at[1:], strict=False):
            self.known[u] = (raw[4 * lo : 4 * hi], ",".join(digits[lo:hi]), b"".join(spelled[lo:hi]))

    def of(self, batch: list[str | None]):
        """(from, to, the known stretches of each text) of runs of texts; each stretch that isn't known is searched once a run."""
        lo = size = 0
        for i, t in enumerate(batch):
            size += len(t or "")
            if size < BLOCK_CHARS and i + 1 < len(batch):
                continue
            cut = [self.v.units(t or "") for t in batch[lo : i + 1]]
            if len(self.known) > self.remember:  # what isn't met again before as many others is forgotten
                self.known, self.older = {}, self.known
            fresh = set().union(*cut).difference(self.known)
            for u in fresh & self.older.keys():
                self.known[u] = self.older[u]
            self.learn(list(fresh.difference(self.known)))
            get = self.known.__getitem__
            yield lo, i + 1, [list(map(get, us)) for us in cut]
            lo, size = i + 1, 0


def _ids(parts: list[tuple]) -> np.ndarray:
    return np.frombuffer(b"".join([p[0] for p in parts]), np.int32)


def _lists(ids: list[np.ndarray], null: list[bool]) -> pa.Array:
    offsets = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)), mask=pa.array(null))


def _kinds(df: DataFrame, cols: list[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in cols)


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """All columns of `docs` and `ids` (array<int>) of every whole text. Null gives null, an empty text no ids.

    A column that is already called `ids_col` is replaced.
    """
    path = path or default_path()
    keep = [c for c in docs.columns if c != ids_col]
    at = keep.index(text_col)

    def run(batches):
        known = Stretches(vocabulary(path))
        for b in batches:
            text = b.column(at).to_pylist()
            for lo, hi, parts in known.of(text):
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns), _lists([_ids(x) for x in parts], [t is None for t in text[lo:hi]])], names=[*keep, ids_col])

    return docs.select(*keep).mapInArrow(released(run), f"{_kinds(docs, keep)}`{ids_col}` array<int>")


def decode(df: DataFrame, path: str | None = None, ids_col: str = "ids", to_col: str = "decoded") -> DataFrame:
    """All columns of `df` and the text of their ids; null ids give null. A column called `to_col` is replaced."""
    path = path or default_path()
    keep = [c for c in df.columns if c != to_col]
    at = keep.index(ids_col)

    def run(batches):
        v = vocabulary(path)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                text = [v.decode(x.values.to_numpy()) if x.is_valid else None for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.string())], names=[*keep, to_col])

    return df.select(*keep).mapInArrow(released(run), f"{_kinds(df, keep)}`{to_col}` string")


def round_trip(docs: DataFrame, carry: list[str], path: str | None = None, text_col: str = "text", with_ids: bool = False, remember: int = MEMO) -> DataFrame:
    """The columns in `carry`, with n_ids, n_byte_ids, ids_sha256 (of the ids, comma-joined), decoded_sha256, lossless of
    every whole text, encoded and decoded again in one pass, and `ids` if asked for. Null counts as empty.

    A task remembers `remember` stretches, and as many older ones: more of them cost memory and save searches.
    A text that has U+2581 itself decodes with a blank there, so it isn't lossless.
    """
    path = path or default_path()
    df = docs.select(*carry, F.col(text_col).cast("string").alias(free_name("_text", carry)))
    names = [*carry, "n_ids", "n_byte_ids", "ids_sha256", "decoded_sha256", "lossless", *["ids"] * with_ids]

    def run(batches):
        v = vocabulary(path)
        known = Stretches(v, remember)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            text = strings(b.column(len(carry)))
            for lo, hi, parts in known.of(text):
                ids = [_ids(x) for x in parts]
                back = [v.spell(b"".join([p[2] for p in x])) for x in parts]
                out = [
                    pa.array([len(x) for x in ids], pa.int64()), pa.array([int(np.count_nonzero(v.is_byte[x])) for x in ids], pa.int64()), pa.array([sha(",".join([p[1] for p in x]).encode()) for x in parts]),
                    pa.array([sha(x.encode()) for x in back]), pa.array([x == y for x, y in zip(back, text[lo:hi], strict=True)]), *[_lists(ids, [False] * len(ids))] * with_ids,
                ]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns[:-1]), *out], names=names)

    kinds = "n_ids long, n_byte_ids long, ids_sha256 string, decoded_sha256 string, lossless boolean" + ", ids array<int>" * with_ids
    return df.mapInArrow(released(run), f"{_kinds(df, carry)}{kinds}")
