"""Normalisers and other text expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms that company names carry inconsistently.
LEGAL_FORMS = "inc|incorporated|llc|l\\.l\\.c|corp|corporation|co|company|ltd|limited|plc|gmbh"


#: Where letters with marks, ligatures and wide forms are: Latin extensions, Vietnamese, ligatures, full-width ASCII.
_FOLDED = (range(0xC0, 0x250), range(0x1E00, 0x1F00), range(0xFB00, 0xFB07), range(0xFF01, 0xFF5F))


def _folds() -> tuple[str, str, dict[str, str]]:
    """Letters and the plain letter that compatibility decomposition leaves of each; those that leave several, with these."""
    pairs = [(chr(i), unicodedata.normalize("NFKD", chr(i)).encode("ascii", "ignore").decode()) for r in _FOLDED for i in r]
    kept = [(a, b) for a, b in pairs if len(b) == 1]
    return "".join(a for a, _ in kept), "".join(b for _, b in kept), {a: b for a, b in pairs if len(b) > 1}


FOLD_FROM, FOLD_TO, LIGATURES = _folds()


def folded(text: Column) -> Column:
    """Without marks, ligatures and wide forms."""
    plain = F.translate(text, FOLD_FROM, FOLD_TO)
    spelt = plain
    for a, b in LIGATURES.items():
        spelt = F.replace(spelt, F.lit(a), F.lit(b))
    return F.when(plain.rlike(f"[{''.join(LIGATURES)}]"), spelt).otherwise(plain)


def company_key(name: Column) -> Column:
    """Lower case, without dots and commas, one trailing legal form and repeated blanks; null when nothing is left."""
    plain = F.regexp_replace(F.lower(F.trim(name)), "[.,]", "")
    bare = F.trim(F.regexp_replace(plain, rf"\b({LEGAL_FORMS})\.?\s*$", ""))
    return F.nullif(F.regexp_replace(bare, r"\s+", " "), F.lit(""))


def title_key(title: Column) -> Column:
    """Lower case, punctuation to blanks, blanks squeezed; null when nothing is left."""
    plain = F.regexp_replace(F.lower(F.trim(title)), r"(?U)[^\w\s]", " ")
    return F.nullif(F.trim(F.regexp_replace(plain, r"(?U)\s+", " ")), F.lit(""))


def plain_words(text: Column) -> Column:
    """Lower-case words of letters and digits without marks, joined by blanks: "D.C." is "dc", "A&B" is "a and b"."""
    plain = F.regexp_replace(F.replace(F.lower(folded(text)), F.lit("\u00df"), F.lit("ss")), "&", " and ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "[.'\u2019`\\p{M}]", ""), "[^a-z0-9]", " "), " +", " "))


def slug(text: Column, most: int | None = None) -> Column:
    """Lower-case ASCII words joined by hyphens, cut at a hyphen when longer than `most`; null gives an empty slug."""
    plain = F.lower(folded(F.coalesce(text, F.lit(""))))
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "[^\\x00-\\x7F]", ""), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    if most is None:
        return out
    head = F.substring(out, 1, most + 1)
    cut = F.when(head.contains("-"), F.regexp_replace(head, "-[^-]*$", "")).otherwise(F.substring(out, 1, most))
    return F.when(F.length(out) > most, cut).otherwise(out)


def split_locations(raw: Column, entries: int | None = 100, longest: int | None = 255) -> Column:
    """The places of a location string, in order, the first of those that differ in case only.

    Chunks end at ; or |; blank ones and those that end in an ellipsis are dropped. HTML entities must be decoded before.
    A stored list has up to `entries` places of up to `longest` characters; None gives all of them, or whole.
    """
    chunks = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), "[;|]"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.endswith("..."))
    # Each is worked out once a row. In order of lower case those that differ in case only stand side by side, the first of them in front,
    # so time grows little faster than the chunks.
    keyed = F.transform(F.array(chunks), lambda c: F.array_sort(F.transform(c, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("i"), x.alias("place")))))
    firsts = F.transform(keyed, lambda k: F.array_sort(F.transform(F.filter(k, lambda x, i: (i == 0) | (x["low"] != F.get(k, i - 1)["low"])), lambda x: F.struct(x["i"], x["place"]))))
    kept = F.get(firsts, 0) if entries is None else F.get(F.transform(firsts, lambda f: F.slice(f, 1, entries)), 0)
    return kept["place"] if longest is None else F.transform(kept["place"], lambda x: F.substring(x, 1, longest))


def query_terms(q: str) -> tuple[list[str], list[str]]:
    """(words that a title must have, words that it must not): tokens with a leading hyphen exclude."""
    out = [t[1:] for t in q.split() if len(t) > 1 and t.startswith("-")]
    return [t for t in q.split() if not (len(t) > 1 and t.startswith("-"))], out


def matches_query(title: Column, q: str) -> Column:
    """All included words occur in the title in any order and case, and no excluded one does."""
    low, keep = F.lower(title), F.lit(True)
    want, avoid = query_terms(q)
    for w in want:
        keep = keep & low.contains(w.lower())
    for w in avoid:
        keep = keep & ~low.contains(w.lower())
    return keep


def salary_label(low: Column, high: Column, currency: Column) -> Column:
    """'USD 50,000 - 60,000', one figure where the other is missing, null without any."""
    parts = F.array_distinct(F.filter(F.array(F.format_number(low, 0), F.format_number(high, 0)), lambda x: x.isNotNull()))
    return F.when(F.size(parts) > 0, F.concat_ws(" ", F.coalesce(currency, F.lit("USD")), F.array_join(parts, " - ")))


def prefer(first: Column, second: Column, blank: str = "unknown") -> Column:
    """The first value, unless it is null or the sentinel that stands for not known."""
    return F.coalesce(F.nullif(first, F.lit(blank)), second)
