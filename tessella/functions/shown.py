"""What of a row is shown, stored or believed: masks, paths, lengths, errors, and types of work, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import slug

# How errors begin that mean an incomplete scan or a page that is gone; words for places of work and kinds of employment.
INCOMPLETE, GONE = "Incomplete scan: ", "Posting gone: "
WORKPLACES = {"remote": "remote", "hybrid": "hybrid", "on-site": "onsite", "onsite": "onsite", "on site": "onsite", "in-office": "onsite", "in office": "onsite"}
EMPLOYMENT = {"FULL_TIME": "full_time", "PART_TIME": "part_time", "CONTRACTOR": "contract", "TEMPORARY": "temporary", "INTERN": "internship"}
LONGEST_PLACE = 255

LINKS, FLAGS = ("url", "apply_url"), ("flagged_at", "flag_reason", "flag_note")


def masked(df: DataFrame, signed_in: bool, admin: bool) -> DataFrame:
    """The rows as a caller may see them, and has_url: links for those who signed in, flags for administrators. Columns that aren't there stay away."""
    hidden = {c for cs, seen in ((LINKS, signed_in), (FLAGS, admin)) if not seen for c in cs}
    has = F.coalesce(F.col("url") != "", F.lit(False)).alias("has_url")
    return df.select(*[(F.lit(None).cast(df.schema[c].dataType).alias(c) if c in hidden else F.col(c)) for c in df.columns], has)


def job_path(title: Column, place: Column, id_: Column, sector: Column, day: Column, country: str = "us", longest: int = 60) -> Column:
    """jobs/<country>/<sector>/<day>/<title>-<place>-<id>, without what is empty."""
    last = F.array_join(F.filter(F.array(slug(title, longest), F.coalesce(place, F.lit("")), id_.cast("string")), lambda x: x != ""), "-")
    return F.concat_ws("/", F.lit("jobs"), F.lit(country), slug(sector), day.cast("string"), last)


def fitted(value: Column, longest: int) -> Column:
    """A text as a column of that length holds it: without zero bytes, cut."""
    return F.substring(F.replace(value, F.lit("\x00"), F.lit("")), 1, longest)


def incomplete(error: Column, wanted: bool = True) -> Column:
    """Scans that ended incomplete, or all others, those without any error included."""
    hit = F.coalesce(error.startswith(INCOMPLETE), F.lit(False))
    return hit if wanted else ~hit


def expired(success: Column, was: Column, error: Column) -> Column:
    """Whether a posting is over: it was already, or its page answered that it is gone."""
    return was | (~success & F.coalesce(error.startswith(GONE), F.lit(False)))


def _word(words: dict[str, str], x: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in words.items() for v in kv]), x)


def place_and_workplace(text: Column) -> tuple[Column, Column]:
    """(places, workplace) of "Utah | Hybrid; Remote": what stands before a word for a place of work, each once, in order, and that word's meaning
    where all agree; null and unknown otherwise. Text of another shape says nothing."""
    chunks = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    parts = F.transform(chunks, lambda c: F.transform(F.split(c, r"\|"), lambda x: F.trim(x)))
    read = F.transform(parts, lambda p: F.struct(F.when(F.size(p) == 2, F.get(p, 0)).alias("place"), F.when(F.size(p) <= 2, _word(WORKPLACES, F.lower(F.get(p, F.size(p) - 1)))).alias("work")))
    fine = F.filter(read, lambda r: r["work"].isNotNull())
    places = F.array_join(F.array_distinct(F.filter(F.transform(fine, lambda r: r["place"]), lambda x: x.isNotNull() & (x != ""))), "; ")
    short = F.when(F.length(places) > LONGEST_PLACE, F.concat(F.substring(places, 1, LONGEST_PLACE - 3), F.lit("..."))).otherwise(places)
    kinds = F.array_distinct(F.transform(fine, lambda r: r["work"]))
    return F.nullif(short, F.lit("")), F.when(F.size(kinds) == 1, F.get(kinds, 0)).otherwise("unknown")


def employment(kind: Column) -> Column:
    """Kinds of employment as schema.org has them, with any separators; unknown for others."""
    return F.coalesce(_word(EMPLOYMENT, F.regexp_replace(F.upper(F.trim(kind)), "[- ]", "_")), F.lit("unknown"))


def extra(fields: Column, known: list[str]) -> Column:
    """Of a map the entries whose keys aren't among those known."""
    return F.map_filter(fields, lambda k, _: ~k.isin(known) if known else F.lit(True))


def unsquashed(name: Column, page_names: Column) -> Column:
    """The run of a page name's words that a name written as one word stands for, as the first page that has one writes it.

    Only names with one capital at their start are taken for squashed: others are spelt so on purpose.
    """
    target = F.lower(name)
    squashed = ~name.contains(" ") & target.rlike("^[a-z0-9]+$") & (name == F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, 2, 10_000))))

    def runs(page: Column) -> Column:
        words = F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
        starts = F.when(F.size(words) > 1, F.sequence(F.lit(1), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
        # Only as many words as the name has letters can make it up.
        ends = lambda i: F.sequence(F.lit(2), F.least(F.size(words) - i + 1, F.length(target) + 1))
        each = F.flatten(F.transform(starts, lambda i: F.transform(ends(i), lambda n: F.array_join(F.slice(words, i, n), " "))))
        return F.get(F.filter(each, lambda r: F.lower(F.replace(r, F.lit(" "), F.lit(""))) == target), 0)

    return F.when(squashed, F.get(F.filter(F.transform(page_names, runs), lambda r: r.isNotNull()), 0))
