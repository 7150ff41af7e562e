"""Spans of texts in DataFrame functions: finding matches, listing them and replacing them.

Work on a text grows with its length and the number of its spans: spans are built in chunks of CHUNK, as appending
to one growing array would cost the square of their number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spans of a text that are appended one by one.
CHUNK = 64
#: Stands for spans that were found while others are looked for, so that a match they cut isn't taken for a whole one.
MARK = "\u0001"

SPAN = "struct<start:int,k:int,end:int,more:string>"


def none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def let(x: Column, f) -> Column:
    """f of x, where x is worked out once however often f uses it."""
    return F.get(F.transform(F.array(x), f), 0)


def chunks(x: Column) -> Column:
    return F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), F.size(x) - 1, F.lit(CHUNK)), lambda lo: F.slice(x, lo + 1, CHUNK))).otherwise(F.array())


def matches(text: Column, pattern: str, k: int, keep) -> Column:
    """Spans (array<SPAN>) of the matches for which `keep` holds; `more` is the match. Places are code points from 0.

    Matches and the stretches between them come from two calls; running lengths give the places, inside each chunk
    from the chunk's start, which the lengths of the chunks before it give.
    """
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def step(acc: Column, x: Column) -> Column:
        lo = acc["at"] + F.length(x["gap"])
        hit = F.coalesce(x["hit"], F.lit(""))
        hi = lo + F.length(hit)
        span = F.array(F.struct(lo.alias("start"), F.lit(k).alias("k"), hi.alias("end"), hit.alias("more")))
        return F.struct(hi.alias("at"), F.when((hit != "") & keep(hit), F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def inside(chunk: Column) -> Column:
        return F.aggregate(chunk, F.struct(F.lit(0).alias("at"), none().alias("out")), step)

    def placed(parts: Column) -> Column:
        first = F.array(F.lit(0))
        starts = F.aggregate(parts, first, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["at"])))
        moved = lambda lo: lambda s: F.struct((s["start"] + lo).alias("start"), s["k"].alias("k"), (s["end"] + lo).alias("end"), s["more"].alias("more"))
        pairs = F.arrays_zip(parts.alias("part"), starts.alias("lo"))
        return F.flatten(F.transform(F.filter(pairs, lambda p: p["part"].isNotNull()), lambda p: F.transform(p["part"]["out"], moved(p["lo"]))))

    return let(zipped, lambda z: let(F.transform(chunks(z), inside), placed))


def masked(text: Column, base: Column) -> Column:
    """The text with spans overwritten by marks, so that places stay, and marks of its own blanked."""
    return redact(F.translate(text, MARK, " "), base, lambda s: F.repeat(F.lit(MARK), s["end"] - s["start"]))



def listed(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, k: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["k"] == k)).cast("long")


def redact(text: Column, spans: Column, put: Callable[[Column], Column]) -> Column:
    """The text with each span (sorted) replaced by `put` of it. A span that starts inside the one before is covered by it."""

    def cut(v: Column) -> Column:
        """Pieces of text, one a chunk of spans; a chunk starts where those before it end."""
        ends = lambda x: F.aggregate(x, F.lit(0), lambda acc, s: F.greatest(acc, s["end"]))
        starts = F.aggregate(v["c"], F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), ends(x)))))
        return let(starts, lambda at: F.concat(F.transform(v["c"], lambda x, i: piece(v["t"], x, F.get(at, i), F.get(at, i + 1))), F.array(F.substring(v["t"], F.element_at(at, -1) + 1, F.length(v["t"])))))

    def piece(t: Column, x: Column, lo: Column, hi: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            ahead = F.concat(acc["out"], F.substring(acc["own"], acc["at"] - lo + 1, s["start"] - acc["at"]), put(s))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], ahead).otherwise(acc["out"]).alias("out"), acc["own"].alias("own"))

        return F.aggregate(x, F.struct(lo.alias("at"), F.lit("").alias("out"), F.substring(t, lo + 1, hi - lo).alias("own")), step)["out"]

    done = let(F.struct(text.alias("t"), let(spans, chunks).alias("c")), lambda v: F.array_join(cut(v), ""))
    return F.when(F.size(spans) > 0, done).otherwise(text)
