"""What a search phrase is after: a role, a place, a company, or something else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded, title_key

# What stands for remote work, and words that say nothing of what is sought.
REMOTE_WORDS = ["remote", "wfh", "telecommute", "telework", "virtual"]
REMOTE_PHRASES = ["work from home", "work at home"]
FILLER_WORDS = """job jobs career careers hiring hire openings opening opportunities opportunity position positions vacancies vacancy employment
recruiting apply now immediately near me in at for the a an and or of us usa empleo empleos trabajo trabajos en de""".split()


def search_key(text: Column) -> Column:
    """Plain lower-case words with one blank between; empty without any."""
    return F.coalesce(title_key(folded(text)), F.lit(""))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def _without(text: Column, phrase: str) -> Column:
    """`text` (words with blanks around) without the first `phrase`."""
    at = F.instr(text, f" {phrase} ")
    return F.when(at > 0, F.concat(F.substr(text, F.lit(1), at), F.substr(text, at + len(phrase) + 2))).otherwise(text)


def _named(df: DataFrame, value: str) -> DataFrame:
    return df.select(search_key(F.col("name")).alias("_rest"), value).where("_rest <> ''").groupBy("_rest").agg(F.min(value).alias(value))


def search_intents(phrases: DataFrame, titles: DataFrame, places: DataFrame, companies: DataFrame) -> DataFrame:
    """All columns of `phrases` (with `phrase`) and kind (role, company, location or other), role, location, company.

    `titles` (name, role), `places` (name, location) and `companies` (name, company) are met by equal words. The longest title in a phrase,
    or its plural, is the role, the first of equally long ones; what is left, without filler words, names a place or a company. A company
    comes before a place of its name. Null and empty phrases are "other". Equal phrases are read once; they are
    cut into runs of words no longer than the longest title.
    """
    one = titles.select(search_key(F.col("name")).alias("_run"), "role").where("_run <> ''")
    known = one.unionByName(one.select(F.concat("_run", F.lit("s")).alias("_run"), "role")).groupBy("_run").agg(F.min("role").alias("role"))
    most = known.agg(F.max(F.size(_words(F.col("_run"))))).first()[0] or 1
    texts = phrases.select(search_key(F.col("phrase")).alias("_text")).distinct().withColumn("_words", _words(F.col("_text")))
    size = F.size("_words")
    starts = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    run = lambda i, n: F.struct(n.alias("n"), (-i).alias("i"), F.array_join(F.slice("_words", i, n), " ").alias("_run"))
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), size - i + 1)), lambda n: run(i, n))))
    best = texts.select("_text", F.explode(runs).alias("x")).select("_text", "x.*").join(known, "_run").groupBy("_text").agg(F.max(F.struct("n", "i", "role")).alias("_best"))
    df = texts.join(best, "_text", "left")
    left = F.when(F.col("_best").isNull(), F.col("_words")).otherwise(F.concat(F.slice("_words", 1, -F.col("_best.i") - 1), F.slice("_words", -F.col("_best.i") + F.col("_best.n"), F.greatest(size, F.lit(1)))))
    df = df.withColumn("_left", F.concat(F.lit(" "), F.array_join(left, " "), F.lit(" ")))
    far = F.lit(False)
    rest = F.array_join(F.filter(_words(F.col("_left")), lambda w: ~w.isin(REMOTE_WORDS)), " ")
    for p in reversed(REMOTE_PHRASES):
        found = F.instr("_left", f" {p} ") > 0
        far, rest = far | found, F.when(found, _without(F.col("_left"), p)).otherwise(rest)
    far = far | F.arrays_overlap(_words(F.col("_left")), F.array(*map(F.lit, REMOTE_WORDS)))
    df = df.select("_text", F.col("_best.role").alias("role"), far.alias("_far"), F.array_join(F.filter(_words(rest), lambda w: ~w.isin(FILLER_WORDS)), " ").alias("_rest"))
    df = df.join(_named(places, "location"), "_rest", "left").join(_named(companies, "company"), "_rest", "left")
    company = F.col("role").isNull() & ~F.col("_far") & F.col("company").isNotNull()
    where = F.when(F.col("_far"), "remote").otherwise(F.col("location"))
    placed = where.isNotNull() & (F.col("location").isNotNull() | (F.col("_rest") == ""))
    kind = F.when(F.col("role").isNotNull(), "role").when(company, "company").when(placed, "location").otherwise("other")
    told = df.select("_text", kind.alias("kind"), "role", F.when(kind.isin("role", "location"), where).alias("location"), F.when(company, F.col("company")).alias("company"))
    return phrases.withColumn("_text", search_key(F.col("phrase"))).join(told, "_text").drop("_text")
