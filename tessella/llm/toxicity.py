"""Toxicity by noisy-channel deobfuscation.

A token that looks disguised (look-alike symbols, stretched letters, letters set apart) becomes a lattice of what each
symbol may stand for; Viterbi search under a character language model finds the likeliest original, and the restored
text is scored. The score is a logistic model over the presence of words and of word beginnings, so that
inflected forms of a stem count as well.

What is learned: character trigrams of all texts, mixed with those of words that mark toxic texts; document
frequencies of words and beginnings in all labelled texts of the training folds; the weights, from all of those too,
by Spark's logistic regression.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import hashstore
from .common import checkpoint, free_name, released, shared_dir, strings
from .lm import fold

#: Labelled rows of a task while the weights are fitted: each round is a pass over them all, and tasks cost more than rows.
FIT_ROWS = 20_000
#: Toxic texts that must have a feature: so many and such a share, which bounds the number of features.
MIN_TEXTS, MIN_SHARE = 4, 0.0005
BEGINNINGS = (4, 5, 6, 7)
#: Standard errors by which a feature's log-odds must be above zero to have a weight.
TELLING = 3.0
#: Lower bound (99 %) of the share of toxic texts among those with a feature, beyond which it is a sign by itself.
SURE = 0.9
#: The weight that such a feature must have of its own, as a share of the bias.
WEIGHTY = 0.1
MEMO = 150_000

# What look-alike symbols stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou"}
# Small Cyrillic and Greek letters that look like Latin ones.
HOMOGLYPHS = str.maketrans({"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ғ": "f", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "υ": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "χ": "x", "γ": "y"})
#: Costs in nats of the channel: a symbol for a letter, a masked letter, a dropped repeat, a joint between words.
SWAP, MASK, REPEAT, JOINT = 0.7, 2.0, 0.3, 3.0

#: Codes of characters: 0 for all that isn't a letter, 1 to 26 for a-z, then the small letters of Latin-1.
CODES = np.array([b - 96 if 97 <= b <= 122 else b - 223 + 27 if 223 <= b and b != 247 else 0 for b in range(256)], np.int64)
N = 60
OF_CHAR = {bytes([b]).decode("latin-1"): int(c) for b, c in enumerate(CODES) if c}
TO_CHAR = {c: ch for ch, c in OF_CHAR.items()} | {0: " "}


def trigram_counts(batch: list[str]) -> np.ndarray:
    codes = CODES[np.frombuffer(" ".join(["", *batch, ""]).lower().encode("latin-1", "replace"), np.uint8)]
    if len(codes) < 3:
        return np.zeros(N**3, np.int64)
    return np.bincount(codes[:-2] * (N * N) + codes[1:-1] * N + codes[2:], minlength=N**3)


def char_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b) as an array (N, N, N), Witten-Bell interpolated."""
    three = counts.reshape(N, N, N).astype(float)
    p = np.full(N, 1.0 / N)
    for c in (three.sum((0, 1)), three.sum(0), three):
        total, kinds = c.sum(-1, keepdims=True), (c > 0).sum(-1, keepdims=True)
        p = (c + np.maximum(kinds, 1) * p) / (total + np.maximum(kinds, 1))
    return np.log(p)


def lattice(token: str, spaced: bool = False) -> list[list[tuple[tuple[int, ...], float]]]:
    """For each run of one symbol the (codes, cost) that it may stand for."""
    out = []
    for m in re.finditer(r"(.)\1*", token, re.S):
        ch, n = m[1], len(m[0])
        if ch in OF_CHAR:
            letters = [(OF_CHAR[ch], 0.0)]
        else:
            letters = [(OF_CHAR[x], MASK if ch == "*" else SWAP) for x in LOOKALIKES.get(ch, "")]
        if not letters:
            out.append([((), MASK)])
            continue
        lengths = [(1, 0.0)] if n == 1 else [(1, REPEAT), (2, 0.0 if n == 2 else REPEAT)]
        ways = [((c,) * k, cost * (1 if ch != "*" else k) + more) for c, cost in letters for k, more in lengths]
        if spaced and out:
            ways += [((0, *cs), cost + JOINT) for cs, cost in ways]
        out.append(ways)
    return out


def decode(ways: list[list[tuple[tuple[int, ...], float]]], logp: np.ndarray) -> str:
    """The likeliest letters through a lattice, by Viterbi search over the last two characters."""
    best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for column in ways:
        new: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (score, path) in best.items():
            for codes, cost in column:
                x, y, s, p = a, b, score - cost, path
                for c in codes:
                    s += logp[x, y, c]
                    x, y, p = y, c, (p, c)
                if (x, y) not in new or s > new[x, y][0]:
                    new[x, y] = (s, p)
        best = new
    score, path = max(((s + logp[a, b, 0], p) for (a, b), (s, p) in best.items()), key=lambda x: x[0])
    out = []
    while path:
        path, c = path
        out.append(TO_CHAR[c])
    return "".join(reversed(out))


EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in LOOKALIKES)
APART = re.compile(r"^\w(?:[._*~-]\w){2,}$")
LETTER = re.compile(r"[^\W\d_]")
TRIPLE = re.compile(r"(.)\1\1")
ODD = re.compile(r"[0-9@$!|+(€£*]|([^\W\d_])\1\1")
SETAPART = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")


def core(word: str) -> str:
    """The word without outer punctuation, and without one repeated sign at either end. Each end is walked once, however long."""
    w = word.strip(EDGE)
    if w.isalnum():
        return w  # no sign at either end
    for strip in (str.lstrip, str.rstrip):
        end = w[:1] if strip is str.lstrip else w[-1:]
        if end and not (end.isalnum() or end == "_"):
            rest = strip(w, end)
            w = rest if len(w) - len(rest) > 1 else w
    return w.strip(EDGE)


def unmixed(word: str) -> str:
    """Letters of other scripts that look like Latin ones, turned into those where the word has Latin letters too."""
    if not any("a" <= c <= "z" for c in word):
        return word
    return word.translate(HOMOGLYPHS)


def restore(word: str, logp: np.ndarray) -> str:
    """The word as likely meant; words without signs of disguise come back without their outer punctuation."""
    if not word.isascii():
        word = unmixed(word)
    w = word.strip(EDGE)
    if w.isalpha() and not TRIPLE.search(w):
        return w  # what nearly all words are, told without the patterns below
    w = core(word)
    if APART.match(w):
        return decode(lattice(re.sub(r"[._*~-]", "", w)), logp)
    if not ODD.search(w) or not LETTER.search(w):
        return w.strip("!|+(*")
    plain = w.strip("!|+(*")
    if plain.isalpha() and not TRIPLE.search(plain):
        return plain  # a mark at its end, no disguise
    if "://" in w or "=" in w or -1 < w.find("@") < w.rfind("."):
        return w
    return decode(lattice(w), logp)


def set_apart(text: str, logp: np.ndarray) -> set[str]:
    """The words that runs of letters set apart by blanks are decoded to."""
    out: set[str] = set()
    for m in SETAPART.finditer(text):
        out.update(decode(lattice(re.sub(r"\s", "", m[0]), spaced=True), logp).split())
    return out


def key_of(word: str) -> int:
    return xxhash.xxh64_intdigest(word, 1) >> 1


def beginnings(word: str) -> list[int]:
    return [xxhash.xxh64_intdigest(word[:n], n + 1) >> 1 for n in BEGINNINGS if len(word) >= n]


def features(word: str) -> list[int]:
    """64-bit keys of a word and its beginnings."""
    return [key_of(word), *beginnings(word)]


class Known:
    """The features of words, looked up once a word: most have none, and whole sets of those are left out at once."""

    def __init__(self, look):
        self.look, self.some, self.none = look, {}, set()

    def __call__(self, words: set[str]) -> set[int]:
        rest = words.difference(self.none)
        for w in rest.difference(self.some):
            if k := self.look(w):
                self.some[w] = k
            else:
                self.none.add(w)
        out: set[int] = set().union(*map(self.some.get, rest, repeat(())))
        for memo in (self.some, self.none):
            if len(memo) > MEMO:
                memo.clear()
        return out


@dataclass
class Model:
    logp: np.ndarray
    weights: dict[int, float]
    bias: float
    known: Known | None = None
    heads: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"known": None, "heads": {}}

    def _look(self, word: str) -> tuple[int, ...]:
        r = restore(word, self.logp)
        if not r:
            return ()
        # Very many words share a beginning, whose features are looked up once.
        head, weights = r[: BEGINNINGS[-1]], self.weights
        keys = self.heads.get(head)
        if keys is None:
            if len(self.heads) > MEMO:
                self.heads.clear()
            keys = self.heads[head] = tuple(x for x in beginnings(head) if x in weights)
        own = key_of(r)
        return (own, *keys) if own in weights else keys

    def score(self, text: str) -> float:
        if self.known is None:
            self.known = Known(self._look)
        text = text.lower()
        seen = self.known(set(text.split()))
        for w in set_apart(text, self.logp):
            seen.update(x for x in features(w) if x in self.weights)
        z = self.bias + math.fsum(map(self.weights.__getitem__, seen))  # exact, whatever the order
        return 1 / (1 + math.exp(-max(min(z, 700.0), -700.0)))


def vectors(n: int):
    """A batch function that turns labels and sorted lists of features into what Spark's models take: sparse vectors of ones."""

    def run(batches):
        for b in batches:
            m, at = b.num_rows, b.column(1)
            ends = np.concatenate([[0], np.cumsum(at.value_lengths().to_numpy())]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (at.flatten(), pa.array(np.ones(ends[-1])))]
            x = pa.StructArray.from_arrays([pa.array(np.zeros(m, np.int8)), pa.array(np.full(m, n, np.int32)), *lists], names=["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.float64()), x], names=["label", "features"])

    return run


def fit(rows: DataFrame, total: int, n: int, rounds: int = 300, ridge: float = 0.01) -> tuple[np.ndarray, float]:
    """Logistic regression on presence features, over all of `rows` (y, at: lists of feature numbers below n): (weights, bias)."""
    df = rows.select("y", "at").mapInArrow(vectors(n), StructType([StructField("label", DoubleType()), StructField("features", VectorUDT())]))
    model = LogisticRegression(family="binomial", regParam=ridge / total, standardization=False, maxIter=rounds).fit(df.coalesce(-(-total // FIT_ROWS)))
    return model.coefficients.toArray(), float(model.intercept)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from the documents that have a label. Rows with a null id or label teach nothing; where a document has
    several labels the largest counts; with one class only, every score is that class's share."""
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.xxhash64(F.col(id_col).cast("string")).alias("h")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    store = hashstore.build(known, shared_dir(spark), 6, ["y"], ["u1"])
    df = docs.select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text"))

    def labelled(b: pa.RecordBatch) -> tuple[list[int], list[str]]:
        """Labels and texts of a batch's labelled rows."""
        h = b.column(0).to_numpy().view(np.uint64)
        order = np.argsort(h)
        found, (y,) = store.lookup(h[order])
        hit = order[found]
        return y[found].tolist(), strings(b.column(1).take(pa.array(hit))) if len(hit) else []

    def counted(keys, n, kind):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(np.asarray(keys, np.int64)), pa.array(np.asarray(n, np.int64))], names=["kind", "key", "n"])

    def survey(batches):
        grams, totals, found = np.zeros(N**3, np.int64), [0, 0], {}
        for b in batches:
            whole = strings(b.column(1))
            for lo in range(0, len(whole), 200):
                grams += trigram_counts(whole[lo : lo + 200])
            for y, text in zip(*labelled(b), strict=True):
                totals[y > 0] += 1
                if y:
                    for k in {k for w in {core(w) for w in text.lower().split()} if w for k in features(w)}:
                        found[k] = found.get(k, 0) + 1
            if len(found) > 1_000_000:
                yield counted(list(found), list(found.values()), 2)
                found = {}
        at = np.flatnonzero(grams)
        yield counted(at, grams[at], 0)
        yield counted([0, 1], totals, 1)
        yield counted(list(found), list(found.values()), 2)

    summed = checkpoint(df.mapInArrow(released(survey), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    grams, totals = np.zeros(N**3, np.int64), [0, 0]
    for r in summed.where("kind < 2").collect():  # 216,000 trigrams at most, and two totals
        (grams if r.kind == 0 else totals)[r.key] = r.n
    least = max(MIN_TEXTS, math.ceil(MIN_SHARE * totals[1]))
    # A feature has at least MIN_SHARE of the toxic texts, so there are at most 1 / MIN_SHARE times the features of a mean one.
    toxic = {r.key: r.n for r in summed.where((F.col("kind") == 2) & (F.col("n") >= least)).select("key", "n").toLocalIterator()}
    if min(totals) == 0:
        return Model(char_model(grams), {}, math.log((totals[1] + 0.5) / (totals[0] + 0.5)))
    keys = np.array(sorted(toxic), np.int64)
    wanted = {int(k): i for i, k in enumerate(keys)}
    shared = spark.sparkContext.broadcast(wanted)

    def clean(batches):
        n, at = np.zeros(len(keys), np.int64), shared.value
        known = Known(lambda w: tuple(at[x] for x in features(c) if x in at) if (c := core(w)) else ())
        for b in batches:
            for y, text in zip(*labelled(b), strict=True):
                if not y:
                    n[list(known(set(text.lower().split())))] += 1
        i = np.flatnonzero(n)
        yield counted(i, n[i], 0)

    fine = np.zeros(len(keys))
    for r in df.mapInArrow(released(clean), "kind int, key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect():
        fine[r.key] = r.n
    bad = np.array([toxic[k] for k in keys.tolist()], float)
    odds = np.log((bad + 0.5) / (totals[1] + 1)) - np.log((fine + 0.5) / (totals[0] + 1))
    sure = odds / np.sqrt(1 / (bad + 0.5) + 1 / (fine + 0.5))
    chosen = np.flatnonzero(sure > TELLING)
    index = {int(keys[i]): j for j, i in enumerate(chosen)}
    strong = {int(keys[i]) for i in chosen if odds[i] > 3}
    if not len(chosen):
        return Model(char_model(grams), {}, math.log(totals[1] / totals[0]))

    def featured(batches):
        """Label and features of each labelled row, and the strong words of toxic ones where the task first meets them."""
        memo: dict[str, tuple] = {}
        told: set[str] = set()
        for b in batches:
            ys, ats, names = [], [], []
            for y, text in zip(*labelled(b), strict=True):
                hit, marks = set(), set()
                for w in set(text.lower().split()):
                    k = memo.get(w)
                    if k is None:
                        c = core(w)
                        ks = features(c) if c else []
                        k = memo[w] = (tuple(index[x] for x in ks if x in index), c if ks and ks[0] in strong and c.isalpha() else "")
                    hit.update(k[0])
                    if k[1] and y:
                        marks.add(k[1])
                ys.append(int(y > 0))
                ats.append(sorted(hit))
                names.append(sorted(marks - told))
                told |= marks
            if len(memo) > MEMO:
                memo.clear()
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(ats, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))], names=["y", "at", "marks"])

    rows = checkpoint(df.mapInArrow(released(featured), "y int, at array<int>, marks array<string>"))
    w, bias = fit(rows, sum(totals), len(chosen))
    # A feature that is surely a sign by itself is enough by itself: the fit alone spreads the weight over
    # features that occur together, and a text may have one of them only. Words that merely stand in a toxic text
    # with many copies look like signs too, but the fit gives them next to no weight, and so they get no more.
    k, n = bad[chosen], bad[chosen] + fine[chosen]
    z = 2.58
    low = (k / n + z * z / (2 * n) - z * np.sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    alone = np.log(low / (1 - low)) - bias
    w = np.where((low > SURE) & (w > WEIGHTY * abs(bias)), np.maximum(w, alone), w)
    marks = sorted(r.m for r in rows.select(F.explode("marks").alias("m")).distinct().collect())  # a word for each strong feature at most
    own = trigram_counts(marks)
    corpus, mark_model = np.exp(char_model(grams)), np.exp(char_model(own))
    logp = np.log(0.7 * corpus + 0.3 * mark_model) if marks else np.log(corpus)
    return Model(logp, {k: float(w[j]) for k, j in index.items()}, float(bias))


def score(docs: DataFrame, model: Model, carry: list[str], text_col: str = "text", to_col: str = "score") -> DataFrame:
    """The columns in `carry` and, as `to_col`, the score of every whole text: 0 to 1, higher is likelier toxic. Null counts as empty."""
    df = docs.select(*carry, F.col(text_col).cast("string").alias(free_name("_text", carry)))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: the weights (see MIN_SHARE), 216,000 trigrams

    def run(batches):
        m = replace(shared.value, known=None, heads={})  # what it remembers goes with the task; broadcast values stay in the worker
        for b in batches:
            s = [m.score(t) for t in strings(b.column(len(carry)))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64())], names=[*carry, to_col])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry)
    return df.mapInArrow(released(run), f"{kinds}, `{to_col}` double")


def score_held_out(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels of the held fold are never read.

    Null and empty texts have the score of a text without features; a null id is hashed as the empty text and has no
    label; repeated rows are each scored; an empty table gives none. Only id and text are read, so other columns can't clash.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (fold(id_col, folds) == held).alias("held_out"))
    model = train(df.where("NOT held_out"), labels.withColumnRenamed(id_col, "doc_id"))
    return score(df, model, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
