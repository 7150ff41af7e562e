"""Secret scans by a randomness test battery, in DataFrame functions only.

Base patterns give assignments to telling names, access key ids and long hexadecimal runs. The method adds runs of key
characters that look drawn at random. For such a run the narrowest encoding whose alphabet has all its characters is
inferred (decimal numbers have none). Under the hypothesis that the characters are drawn uniformly from that alphabet three tests
give a p-value each:

* chi-squared uniformity over the alphabet (large values tell against it; Wilson and Hilferty's cube root),
* runs: changes between the alphabet's halves, which are binomial,
* serial correlation of neighbours' places in the alphabet, whose mean and variance are known.

Fisher's method combines them; a run passes if the result is at least FLOOR. Passing alone proves little for short runs, and
a corpus has many: so each run also bets against the hypothesis that it is ordinary text, that is, a chain in which characters of
that alphabet follow each other as they do in the corpus. The bet is how many times likelier the run is by uniform draws than by
the chain. If the hypothesis holds its mean is one, so its inverse is a p-value, however the runs depend on each other; it falls with
every character of a random run, so the length is in it. Runs that fail the battery count with p = 1. Within each class of lengths the
Benjamini-Hochberg rule at RATE takes those that ordinary text doesn't explain, so that short runs, of which there are most, must be
the more surprising. It is read off a histogram of the p-values (a few thousand numbers, whatever the corpus), whose bins round p-values
up, so that the rate holds.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name
from .spans import MARK, SPAN, count, let, listed, masked, matches, none, redact

KINDS = ("assign", "access", "hex", "random")
#: Characters of a run that is tested; longer runs are tested in pieces.
LEAST, MOST = 16, 4096
#: Least p-value of the battery, and the share of wrong ones among the runs that are taken.
FLOOR, RATE = 0.0001, 0.01
#: Classes of lengths (two to each doubling), bins to a power of ten of p, and the last bin.
CLASSES, BINS, LAST = 8, 20, 6000

KEYWORD = r"(?i:password|passwd|secret|token|api_?key)"
VALUE = "[A-Za-z0-9+/_.=-]"
ASSIGN = rf"""{KEYWORD}["']?+\x20*+[:=]\x20*+["']?+{VALUE}++"""
LONG_ASSIGN = rf"""^{KEYWORD}["']?+\x20*+[:=]\x20*+["']?+{VALUE}{{8,}}+$"""
# A run of 16 starts where the first AKIA of its run does, and one of 32 where its run starts.
ACCESS = "AKIA[A-Z0-9]{12,}+"
HEX = "(?<![0-9a-f])[0-9a-f]{32,}+"
RUN = rf"[A-Za-z0-9+/_-]{{{LEAST},{MOST}}}+={{0,2}}+"
MARKED_RUN = RUN.replace("[", f"[{MARK}", 1)

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets, narrowest first, each with the pattern of what it can write.
ENCODINGS = (
    (DIGITS + LOWER[:6], "^[0-9a-f]+$"),
    (DIGITS + UPPER[:6], "^[0-9A-F]+$"),
    (UPPER + DIGITS[2:8], "^[A-Z2-7]+$"),
    (DIGITS + LOWER, "^[0-9a-z]+$"),
    (DIGITS + UPPER, "^[0-9A-Z]+$"),
    (DIGITS + UPPER + LOWER, "^[0-9A-Za-z]+$"),
    (UPPER + LOWER + DIGITS + "+/", "^[A-Za-z0-9+/]+$"),
    (UPPER + LOWER + DIGITS + "-_", "^[A-Za-z0-9_-]+$"),
)


def base_spans(text: Column) -> Column:
    """Assignments, access key ids and hexadecimal runs, by start, then kind as listed; array<SPAN>. Null text has none."""
    always = lambda m: F.lit(True)
    parts = [
        F.when(text.rlike(ASSIGN), matches(text, ASSIGN, 0, lambda m: m.rlike(LONG_ASSIGN))).otherwise(none()),
        F.when(text.contains("AKIA"), matches(text, ACCESS, 1, always)).otherwise(none()),
        F.when(text.rlike(HEX), matches(text, HEX, 2, always)).otherwise(none()),
    ]
    return F.coalesce(F.array_sort(F.concat(*parts)), none())


@dataclass
class Model:
    """How often one character of the alphabets follows another in the corpus, and the first bin of p that is taken in each class of lengths."""

    pairs: dict[str, int]
    cuts: list[int]

    def bets(self, alphabet: str) -> np.ndarray:
        """(k + 1, k): logarithms of how many times likelier each character of an alphabet is by uniform draws than in ordinary
        text, after each other one and, last, at the start."""
        k = len(alphabet)
        n = np.array([[self.pairs.get(a + b, 0) for b in alphabet] for a in alphabet], float)
        share = (n.sum(0) + 0.5) / (n.sum() + 0.5 * k)
        return -np.log(np.vstack([(n + k / 2 * share) / (n.sum(1, keepdims=True) + k / 2), share]) * k)


def log_tail(z: Column) -> Column:
    """Logarithm of the upper tail of the normal distribution at z, to seven digits (a Chebyshev fit of erfc)."""
    coefficients = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)

    def tail(x: Column) -> Column:
        def of(t: Column) -> Column:
            fit = F.lit(0.0)
            for c in coefficients:
                fit = fit * t + F.lit(c)
            return F.log(t / 2) - x * x + fit

        return let(F.lit(1.0) / (1 + x / 2), of)

    return let(z / math.sqrt(2), lambda x: let(tail(F.abs(x)), lambda p: F.when(x >= 0, p).otherwise(F.log1p(-F.exp(p)))))


def battery(run: Column, model: Model) -> Column:
    """struct<random double, text double, length int>: the battery's p-value, the logarithm of that of ordinary text (0 at most), and the length.

    Null for a run without an encoding.
    """
    lists = lambda xs: F.array(*map(F.lit, xs))
    numbers = lambda x: F.split(F.lit(",".join(f"{v:.9g}" for v in x.ravel())), ",").cast("array<double>")
    alphabet = lambda e: F.element_at(lists([a for a, _ in ENCODINGS]), e + 1)
    bets = F.array(*[numbers(model.bets(a)) for a, _ in ENCODINGS])

    def tests(v: Column) -> Column:
        """v: run, its length n, its alphabet a of k characters, the encoding e, and the places xs of its characters."""
        n, k = v["n"].cast("double"), v["k"].cast("double")
        squares = F.aggregate(F.split(v["a"], ""), F.lit(0.0), lambda acc, c: acc + F.pow(v["n"] - F.length(F.replace(v["w"], c, F.lit(""))), F.lit(2)))
        free = k - 1
        chi = let(2 / (9 * free), lambda u: log_tail((F.pow((squares * k / n - n) / free, F.lit(1 / 3)) - 1 + u) / F.sqrt(u)))
        # Neighbours, the first with the start, whose place is after the alphabet's.
        pairs = F.zip_with(F.concat(F.array(v["k"]), F.slice(v["xs"], 1, v["n"] - 1)), v["xs"], lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        start = F.struct(*[F.lit(0.0).alias(c) for c in ("changes", "products", "bet")])
        middle = free / 2

        def step(acc: Column, p: Column) -> Column:
            inner = (p["x"] < v["k"]).cast("double")
            changed = ((p["x"] > middle) != (p["y"] > middle)).cast("double")
            bet = acc["bet"] + F.get(F.get(bets, v["e"]), p["x"] * v["k"] + p["y"])
            return F.struct((acc["changes"] + inner * changed).alias("changes"), (acc["products"] + inner * (p["x"] - middle) * (p["y"] - middle)).alias("products"), bet.alias("bet"))

        both = lambda z: F.least(F.lit(0.0), log_tail(F.abs(z)) + math.log(2))
        runs = lambda c: both((c["changes"] - (n - 1) / 2) / (F.sqrt(n - 1) / 2))
        serial = lambda c: both(c["products"] / ((k * k - 1) / 12) / F.sqrt(n - 1))
        fisher = lambda c: let(-(chi + runs(c) + serial(c)), lambda t: F.exp(-t) * (1 + t + t * t / 2))
        return let(F.aggregate(pairs, start, step), lambda c: F.struct(fisher(c).alias("random"), F.least(F.lit(0.0), -c["bet"]).alias("text"), v["n"].alias("length")))

    def placed(v: Column) -> Column:
        xs = F.transform(F.split(v["w"], ""), lambda c: F.instr(v["a"], c) - 1)
        full = F.struct(v["w"].alias("w"), F.length(v["w"]).alias("n"), v["a"].alias("a"), F.length(v["a"]).alias("k"), v["e"].alias("e"), xs.alias("xs"))
        return let(full, tests)

    def coded(w: Column) -> Column:
        code = F.when(w.rlike("^[0-9]+$"), None)
        for i, (_, pattern) in enumerate(ENCODINGS):
            code = code.when(w.rlike(pattern), i)
        return let(code, lambda e: F.when(e.isNotNull(), let(F.struct(w.alias("w"), e.alias("e"), alphabet(e).alias("a")), placed)))

    return let(F.regexp_replace(run, "=+$", ""), coded)


def ranked(tests: Column) -> Column:
    """struct<size int, bin int> of a run: its class of lengths, and its bin of p, which is 0 where the battery fails."""
    size = F.least(F.lit(CLASSES - 1), F.floor(2 * F.log2(tests["length"] / LEAST)).cast("int"))
    place = F.when(tests["random"] >= FLOOR, F.least(F.lit(LAST), F.floor(-tests["text"] * (BINS / math.log(10))).cast("int"))).otherwise(0)
    return F.struct(F.greatest(F.lit(0), size).alias("size"), F.greatest(F.lit(0), place).alias("bin"))


def taken(run: Column, model: Model) -> Column:
    """Whether a run (of RUN) is taken for a secret."""
    cuts = F.array(*map(F.lit, model.cuts))
    return let(battery(run, model), lambda t: F.when(t.isNotNull(), let(ranked(t), lambda r: r["bin"] >= F.get(cuts, r["size"]))).otherwise(False))


def pairs(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """How often one character of the alphabets follows another in all texts.

    Texts are cut into stretches that overlap by a character first, so that a long one needs little memory.
    """
    parts = docs.select(F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit("(?s)(?=(.{2,4097})).{1,4096}"), F.lit(1))).alias("part"))
    each = parts.select(F.explode(F.regexp_extract_all("part", F.lit("(?=([A-Za-z0-9+/_-]{2}))."), F.lit(1))).alias("pair"))
    return {r.pair: r.n for r in each.groupBy("pair").agg(F.count("*").alias("n")).collect()}  # 66 * 66 at most


def cuts(bins: list[tuple[int, int, int]], rate: float = RATE) -> list[int]:
    """The first bin of p to be taken in each class, by the Benjamini-Hochberg rule; input: (class, bin, runs)."""
    of = defaultdict(dict)
    for size, at, n in bins:
        of[size][at] = n
    out = []
    for size in range(CLASSES):
        total, seen, cut = sum(of[size].values()), 0, LAST + 1
        for at in sorted(of[size], reverse=True):
            seen += of[size][at]
            if at and 10 ** (-at / BINS) <= rate * seen / total:
                cut = at
        out.append(cut)
    return out


def learn(docs: DataFrame, text_col: str = "text", rate: float = RATE) -> Model:
    """Counts of pairs and the cut of each class of lengths, over all texts; a run counts once, however often it occurs."""
    model = Model(pairs(docs, text_col), [LAST + 1] * CLASSES)
    runs = docs.select(F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(RUN), F.lit(0))).alias("run")).distinct()
    tested = runs.select(battery(F.col("run"), model).alias("t")).where("t IS NOT NULL").select(ranked(F.col("t")).alias("r"))
    found = tested.groupBy("r.size", "r.bin").agg(F.count("*").alias("n")).collect()  # CLASSES * (LAST + 1) at most
    return Model(model.pairs, cuts([tuple(r) for r in found], rate))


def with_spans(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with base and added (array<SPAN>): what the patterns find, and the random runs that touch none of it."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.withColumn("base", base_spans(text))
    rest = F.when(F.size("base") > 0, masked(text, F.col("base"))).otherwise(F.translate(text, MARK, " "))
    found = matches(rest, MARKED_RUN, 3, lambda m: F.when(m.contains(MARK), False).otherwise(taken(m, model)))
    return base.withColumn("added", F.when(text.rlike(f"[A-Za-z0-9+/_-]{{{LEAST}}}"), found).otherwise(none()).cast(f"array<{SPAN}>"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (all, with the added ones), one row for each document.

    Null and empty texts have no spans; repeated rows and null ids stay rows of their own; spans that start together go by
    kind; runs without an encoding (numbers, or characters of both kinds of base 64) aren't tested; what is left of a run beyond
    a multiple of MOST characters and shorter than LEAST isn't either. An empty table gives no rows. Only id and text are read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = with_spans(rows, learn(rows, "text", rate))
    counts = [count(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(3)]
    return out.select("doc_id", *counts, F.sha2(listed(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "added")), KINDS).alias("spans"))


def remove(docs: DataFrame, text_col: str = "text", put: str = "[SECRET]") -> DataFrame:
    """All rows and columns of `docs`, each secret in a text replaced by `put`. Null stays null; other texts pass untouched."""
    cols = docs.columns
    renamed = docs.select(F.struct(*[F.col(c) for c in cols if c != text_col], F.lit(0).alias(free_name("_", cols))).alias("row"), F.col(text_col).alias("text"))
    found = with_spans(renamed, learn(renamed)).withColumn("spans", F.array_sort(F.concat("base", "added")))
    text = F.when(F.size("spans") > 0, redact(F.col("text"), F.col("spans"), lambda s: F.lit(put))).otherwise(F.col("text"))
    both = found.select("row", text.alias("text"))
    return both.select(*[(F.col("text") if c == text_col else F.col("row")[c]).alias(c) for c in cols])
