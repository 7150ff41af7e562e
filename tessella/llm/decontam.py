"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton accepts every run of words inside any test item. Training words are streamed through it; the
current state gives the longest match that ends at each word, so every occurrence of a window, at
any place of an item, is found in one pass. Documents are never shuffled; automata are built in tasks and lie in the shared folder.
"""

from __future__ import annotations

import functools
import hashlib
import pickle
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import filesystem, free_name, released, shared_dir, texts

#: Items are put into automata of about this many words, whose size is thereby bounded.
AUTOMATON_WORDS = 400_000
#: A task holds about this much text while all automata are run over it, one after another.
GROUP_BYTES = 32 << 20
#: Lower-cases A-Z and blanks every ASCII byte that isn't a digit or letter.
NORMALISE = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(NORMALISE).split()


class SuffixAutomaton:
    """Over the words of `items` (pairs of id and words). Windows: `width` words, or a whole shorter item.

    `step` maps a state's words to states, `link` and `length` are the usual arrays. `short` is
    the length of the longest whole item under `width` words that ends every match in the state, `owners` the
    items of a state, and `short_owners` those of its short items.
    """

    def __init__(self, items: list[tuple[object, list[bytes]]], width: int):
        self.width = width
        self.ids: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, int]] = []
        whole: dict[int, set[int]] = {}
        self.names = [i for i, _ in items]
        for n, (_, ws) in enumerate(items):
            last = 0
            for w in ws:
                last = self._extend(last, self.ids.setdefault(w, len(self.ids)))
                ends.append((last, n))
            if 0 < len(ws) < width:
                whole.setdefault(last, set()).add(n)
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        self.owners: list[set[int]] = [set() for _ in self.link]
        for s, n in ends:
            self.owners[s].add(n)
        for s in reversed(order):
            if self.length[self.link[s]] >= width:
                self.owners[self.link[s]] |= self.owners[s]
        self.short = [0] * len(self.link)
        self.short_owners: list[frozenset[int]] = [frozenset()] * len(self.link)
        for s in order:
            up = self.link[s]
            self.short[s] = self.length[s] if s in whole else self.short[up]
            self.short_owners[s] = self.short_owners[up] | whole.get(s, frozenset())
        # The state of a window is the one on the link path whose lengths include the width.
        self.window_owners = self._window_owners(order)
        del self.owners

    def _window_owners(self, order: list[int]) -> list[frozenset[int]]:
        out = [frozenset()] * len(self.link)
        for s in order:
            up = self.link[s]
            if self.length[s] >= self.width:
                out[s] = out[up] if self.length[up] >= self.width else frozenset(self.owners[s])
        return out

    def _extend(self, last: int, c: int) -> int:
        step, link, length = self.step, self.link, self.length
        if c in step[last]:
            q = step[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, q, c)
        cur = len(link)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p != -1:
            q = step[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return cur

    def _clone(self, p: int, q: int, c: int) -> int:
        step, link, length = self.step, self.link, self.length
        new = len(link)
        step.append(dict(step[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = new
        while p != -1 and step[p].get(c) == q:
            step[p][c] = new
            p = link[p]
        return new

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[int], int]:
        """(hit spans of words, merged and in order; items with occurring windows; longest match) of a document."""
        get, step, link, length, width = self.ids.get, self.step, self.link, self.length, self.width
        short, state, n, longest = self.short, 0, 0, 0
        spans: list[tuple[int, int]] = []
        hit: set[int] = set()
        for i, c in enumerate(map(get, ws), 1):
            if c is None:
                state = n = 0
                continue
            while state and c not in step[state]:
                state = link[state]
                n = length[state]
            if c in step[state]:
                state = step[state][c]
                n += 1
            # A match may be shorter than the state's longest: then windows and short items are those of the path.
            if n > longest:
                longest = n
            if n >= width:
                hit |= self.window_owners[state]
                reach = width
            else:
                reach = 0
            if short[state]:
                s = state
                while short[s] > n:
                    s = link[s]
                if short[s]:
                    hit |= self.short_owners[s]
                    reach = max(reach, short[s])
            if reach:
                lo = i - reach
                if spans and lo <= spans[-1][1]:
                    while spans and lo <= spans[-1][1]:
                        lo = min(lo, spans.pop()[0])
                spans.append((lo, i))
        return spans, hit, longest


def automata(bench: DataFrame, width: int, id_col: str, text_col: str, limit: int) -> list[str]:
    """Files of automata over all items, each of about `limit` words, built by tasks in the shared folder.

    Items are cut into pieces that overlap by `width - 1` words, so that no window is lost and a long item can't overfill an
    automaton; equal rows collapse; pieces are dealt by hash. Only file names come back to the driver.
    """
    size = max(limit // 8, 2 * width)

    def split(batches):
        for b in batches:
            rows = [(i, words(t)) for i, t in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True)]
            cut = [(i, ws[k : k + size + width - 1]) for i, ws in rows for k in range(0, max(len(ws) - width + 1, min(len(ws), 1)), size)]
            columns = [pa.array([i for i, _ in cut], pa.string()), pa.array([b" ".join(ws) for _, ws in cut], pa.binary()), pa.array([len(ws) for _, ws in cut], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "words", "n"])

    spark = bench.sparkSession
    pieces = bench.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(released(split), "item string, words binary, n long").distinct()
    many = max(1, -(-(pieces.agg(F.sum("n")).first()[0] or 0) // limit))
    folder = shared_dir(spark)

    def build(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group["item"].to_pylist(), group["words"].to_pylist(), strict=True), key=lambda r: (r[0] or "", r[1]))
        raw = pickle.dumps(SuffixAutomaton([(i, ws.split()) for i, ws in rows], width), pickle.HIGHEST_PROTOCOL)
        fs, root = filesystem(folder)
        fs.create_dir(root)
        name = f"{uuid.uuid4().hex}.automaton"  # an attempt's own: one that is repeated leaves the other's file unused
        with fs.open_output_stream(f"{root}/{name}") as f:
            f.write(raw)
        return pa.table({"file": [f"{folder}/{name}"]})

    chunk = F.pmod(F.xxhash64("item", "words"), F.lit(many)).alias("chunk")
    built = pieces.select("item", "words", chunk).repartition(many, "chunk").groupBy("chunk").applyInArrow(build, "file string")
    return [r.file for r in built.collect()]  # a name for each `limit` words


@functools.lru_cache(maxsize=1)
def load(file: str) -> SuffixAutomaton:
    """The automaton of a file. A worker keeps one, so that with a single one it is read once."""
    fs, at = filesystem(file)
    with fs.open_input_file(at) as f:
        return pickle.loads(f.read())


def find(docs: DataFrame, bench: DataFrame, carry: list[str], width: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", limit: int = AUTOMATON_WORDS) -> DataFrame:
    """row (a struct of the columns in `carry`), text, spans (int32 pairs of word positions, end exclusive), items (sorted strings), longest.

    Null and empty texts have no words; items without words are ignored; an empty benchmark hits nothing. Repeated
    rows and null ids stay rows of their own, null item ids are ignored as names but their words count as hits.
    `longest` is the longest match, in words, within one piece of an item (an eighth of `limit` and more).
    """
    rows = packed(docs, carry, text_col)
    schema = T.StructType([*rows.schema.fields, T.StructField("spans", T.BinaryType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("longest", T.IntegerType())])
    return rows.mapInArrow(released(scanner(automata(bench, width, item_col, item_text, limit))), schema)


def packed(docs: DataFrame, carry: list[str], text_col: str) -> DataFrame:
    """row (a struct of the columns in `carry`) and text."""
    row = F.struct(*[F.col(c) for c in carry], F.lit(0).alias(free_name("_", carry)))
    return docs.select(row.alias("row"), F.col(text_col).cast("string").alias("text"))


def scanner(files: list[str]):
    """A batch function that adds what the automata of `files` find to rows and texts."""

    def scan(batches):
        for group in grouped(batches, GROUP_BYTES):
            spans = [[[] for _ in range(b.num_rows)] for b in group]
            items = [[set() for _ in range(b.num_rows)] for b in group]
            longest = [[0] * b.num_rows for b in group]
            for file in files:
                auto = load(file)
                for b, span, item, far in zip(group, spans, items, longest, strict=True):
                    for k, text in enumerate(texts(b.column(1))):
                        new, hit, n = auto.scan(words(text))
                        span[k] = merge([*span[k], *new]) if span[k] else new
                        item[k].update(auto.names[x] for x in hit if auto.names[x] is not None)
                        far[k] = max(far[k], n)
            for b, span, item, far in zip(group, spans, items, longest, strict=True):
                flat = [np.array(x, np.int32).tobytes() for x in span]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(flat, pa.binary()), pa.array([sorted(x) for x in item], pa.list_(pa.string())), pa.array(far, pa.int32())], names=["row", "text", "spans", "items", "longest"])

    return scan


def grouped(batches, limit: int):
    """Lists of batches, each complete as soon as it holds `limit` bytes: what is in memory while the automata take turns."""
    group, size = [], 0
    for b in batches:
        group.append(b)
        size += b.nbytes
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def unpack(spans: bytes | None) -> list[list[int]]:
    return np.frombuffer(spans or b"", np.int32).reshape(-1, 2).tolist()


def merge(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(map(tuple, spans)):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def report(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document.

    Null and empty texts have no words; repeated rows and null ids stay rows of their own; an empty table gives none, an
    empty benchmark no hits. Only id and text are read, so other columns can't clash.
    """

    def digest(batches):
        for b in batches:
            n = [len(words(t)) for t in texts(b.column(1))]
            hit = [sum(hi - lo for lo, hi in unpack(s)) for s in b.column(2).to_pylist()]
            names = b.column(3).to_pylist()
            sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array(sha, pa.string()), pa.array([x > 0 for x in hit], pa.bool_())], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    found = find(docs.select(F.col(id_col).alias("doc_id"), F.col(options.get("text_col", "text")).alias("text")), bench, ["doc_id"], **options | {"text_col": "text"})
    flat = found.select("row.doc_id", "text", "spans", "items")
    return flat.mapInArrow(released(digest), f"doc_id {flat.schema['doc_id'].dataType.simpleString()}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans, and without what stands between the words of one span."""
    raw = text.encode()
    plain = raw.translate(NORMALISE)
    at, bounds = 0, []
    for w in plain.split():
        at = plain.index(w, at)
        bounds.append((at, at + len(w)))
        at += len(w)
    out, last = [], 0
    for lo, hi in spans:
        out.append(raw[last : bounds[lo][0]])
        last = bounds[hi - 1][1]
    out.append(raw[last:])
    return b"".join(out).decode()


def clean(docs: DataFrame, bench: DataFrame, width: int = 10, coverage: float = 0.5, text_col: str = "text", count_col: str | None = "n_chars", item_col: str = "item_id", item_text: str = "text", limit: int = AUTOMATON_WORDS) -> DataFrame:
    """Documents without contaminated spans; documents whose hit words exceed `coverage` of all words go.

    Returns the columns of `docs`; where `count_col` is one of them it is set anew for texts that were cut. Null
    texts stay null. Texts are searched and cut in one pass: a second one would have a worker of its own beside each task.
    """
    others = [c for c in docs.columns if c != text_col]
    rows = packed(docs, others, text_col)
    scan = scanner(automata(bench, width, item_col, item_text, limit))
    schema = T.StructType([*rows.schema.fields, T.StructField("cut", T.BooleanType())])

    def edit(batches):
        for b in scan(batches):
            text, was_cut, keep = [], [], []
            for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                spans = unpack(s)
                stays = not spans or sum(hi - lo for lo, hi in spans) <= coverage * len(words(t.encode()))
                keep.append(stays)
                was_cut.append(bool(spans))
                text.append(cut(t, spans) if spans and stays else t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string()), pa.array(was_cut, pa.bool_())], names=["row", "text", "cut"]).filter(pa.array(keep, pa.bool_()))

    edited = rows.mapInArrow(released(edit), schema)
    columns = {c: F.col("row")[c] for c in others} | {text_col: F.col("text")}
    if count_col in others:
        columns[count_col] = F.when(F.col("cut"), F.length("text")).otherwise(columns[count_col]).cast(docs.schema[count_col].dataType)
    return edited.select(*[columns[c].alias(c) for c in docs.columns])
