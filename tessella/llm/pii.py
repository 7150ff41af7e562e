"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Identifiers (e-mail addresses, IP addresses, card and phone numbers) name the protected entities, at three levels: the
identifier itself; its owner's group, which recurs where single identifiers don't (mail domain, network, issuer, number
prefix); and its kind. A term in the texts of an entity reveals it as far as the corpus shows: of all N documents n(t)
have the term, n(e) the entity, n(t, e) both. P(e) = n(e) / N, and P(e | t) = (n(t,e) + P(e)) / (n(t) + 1) is smoothed
towards it. PMI = log(P(e | t) / P(e)) is what t tells about e, the entity's information content IC = -log P(e) all there
is to tell. A term discloses an entity if the share PMI / IC reaches GENERALISE and P(e | t) reaches CERTAIN; it is then
replaced by its class (a name, a number, a code, a word), and from the share REMOVE on removed, wherever it stands in any document. A pair needs
SUPPORT different texts, so that copies of one text prove nothing (near copies count: drop them before). Terms are runs of letters and
digits that touch no identifier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, free_name
from .spans import MARK, SPAN, count, let, listed, masked, matches, none, redact

KINDS = ("email", "ip", "card", "phone", "term")
#: Shares of an entity's information that a term may tell before it is generalised or removed.
GENERALISE, REMOVE = 0.75, 0.9
#: Probability that a document with the term is one of the entity's, below which other documents give cover.
CERTAIN = 0.5
#: Different texts in which a term must stand with an entity.
SUPPORT = 3
#: Learnt terms, or texts' words, up to which they are broadcast, and the parts that copies of one text are dealt to when it gets its terms.
BROADCAST, SALTS = 50_000, 16
#: Terms up to which their hashes are broadcast (8 MB).
HASHES = 1_000_000

LOCAL = "[A-Za-z0-9._%+-]"
# The look-behinds start matches where runs of the leading class start (or the last match ended), as the plain
# patterns do; they only keep the matcher from trying every later start of a run.
EMAIL = rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# 12 to 19 digits with at most one blank or hyphen between two, not part of a longer such number.
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
WORD = r"[\p{L}\p{M}\p{N}]++"
def _ip_ok(m: Column) -> Column:
    plain = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(plain, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def base_spans(text: Column) -> Column:
    """All identifiers of a text, by start, then kind as listed; array<SPAN>. Null text has none."""
    digits = lambda m: F.regexp_replace(m, "[^0-9]", "")
    always = lambda m: F.lit(True)
    parts = [
        F.when(text.contains("@"), matches(text, EMAIL, 0, always)).otherwise(none()),
        F.when(text.rlike(r"[0-9]\.[0-9]+\.[0-9]"), matches(text, IP, 1, _ip_ok)).otherwise(none()),
        F.when(text.rlike(r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"), matches(text, CARD, 2, lambda m: F.call_function("luhn_check", digits(m)))).otherwise(none()),
        F.when(text.contains("+"), matches(text, PHONE, 3, lambda m: F.length(digits(m)).between(9, 15))).otherwise(none()),
    ]
    return F.coalesce(F.array_sort(F.concat(*parts)), none())


def _words(text: Column) -> Column:
    """The different words of a text, lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.lower(w)))


#: Words, with the marks that touch them.
MARKED_WORD = WORD.replace("[", f"[{MARK}")


def _around(text: Column, base: Column) -> Column:
    """The different words of a text that no identifier touches."""
    whole = F.regexp_extract_all(masked(text, base), F.lit(MARKED_WORD), F.lit(0))
    return F.array_distinct(F.transform(F.filter(whole, lambda w: ~w.contains(MARK)), lambda w: F.lower(w)))


def _entities(base: Column) -> Column:
    """Hashes of what a text's identifiers name: each itself, its group and its kind."""
    digits = lambda m: F.regexp_replace(m, "[^0-9]", "")

    def named(b: Column) -> Column:
        group = (
            F.when(b["k"] == 0, F.lower(F.substring_index(b["more"], "@", -1)))
            .when(b["k"] == 1, F.substring_index(b["more"], ".", 2))
            .when(b["k"] == 2, F.substring(digits(b["more"]), 1, 6))
            .otherwise(F.substring(digits(b["more"]), 1, 4))
        )
        return F.array(F.xxhash64(b["k"], b["more"]), F.xxhash64(b["k"], F.lit("group"), group), F.xxhash64(b["k"], F.lit("kind")))

    return F.array_distinct(F.flatten(F.transform(base, named)))


def analyse(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row for each different text with identifiers: h (a hash of it), copies, entities, words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    some = docs.select(text.alias("text")).withColumn("base", base_spans(F.col("text"))).where(F.size("base") > 0)
    found = some.select(F.xxhash64("text").alias("h"), _entities(F.col("base")).alias("entities"), _around(F.col("text"), F.col("base")).alias("words"))
    return found.groupBy("h").agg(F.count("*").alias("copies"), F.first("entities").alias("entities"), F.first("words").alias("words"))


def _classes(texts: DataFrame, support: int) -> DataFrame:
    """entity, n_e, members of the entities that stand in `support` different texts, one for all that stand in the very same texts.

    Such entities have the same counts with every term, so one of them speaks for all: logs that share thousands of addresses pair
    their words with a few classes. Equal sets of texts are told by their size and two 64-bit sums of hashes.
    """
    mention = texts.select("h", "copies", F.explode("entities").alias("entity"))
    both = [F.bit_xor("h").alias("x"), F.bit_xor(F.xxhash64("h", F.lit("second"))).alias("y")]
    each = mention.groupBy("entity").agg(F.sum("copies").alias("n_e"), F.count("*").alias("texts"), *both).where(F.col("texts") >= support)
    first = each.groupBy("x", "y", "texts").agg(F.min("entity").alias("of"), F.first("n_e").alias("n_e"))
    return checkpoint(each.select("entity", "x", "y", "texts").join(first, ["x", "y", "texts"]).select("entity", "of", "n_e"))


def _told(docs: DataFrame, texts: DataFrame, classes: DataFrame, text_col: str, support: int, least: float, certain: float) -> DataFrame:
    """(entity, term, share) for one entity of each class."""
    leads = classes.where(F.col("entity") == F.col("of")).select("entity", "n_e")
    often = texts.select("h", F.explode("entities").alias("entity")).join(leads.select("entity"), "entity", "left_semi").groupBy("h").agg(F.collect_list("entity").alias("of"))
    # Where the words that can reach the support are few enough to be at hand, only those meet a text's entities.
    common = checkpoint(texts.select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("texts")).where(F.col("texts") >= support).select("term"))
    kept = _among(texts.join(often, "h").select("copies", "of", F.explode("words").alias("term")), common)
    pair = kept.select("copies", "term", F.explode("of").alias("entity"))
    pairs = checkpoint(pair.groupBy("entity", "term").agg(F.sum("copies").alias("n_te"), F.count("*").alias("texts")).where(F.col("texts") >= support))
    asked = checkpoint(pairs.select("term").distinct())
    words = _among(docs.select(F.explode(_words(F.col(text_col).cast("string"))).alias("term")), asked)
    terms = words.groupBy("term").agg(F.count("*").alias("n_t"))
    n = F.lit(max(2, docs.count()))
    counted = pairs.join(terms, "term").join(leads, "entity")
    before = F.col("n_e") / n
    told = (F.col("n_te") + before) / (F.greatest("n_t", "n_te") + 1)
    share = F.when(before < 1, F.log(told / before) / -F.log(before)).otherwise(0.0)
    return counted.withColumn("share", share).where((F.col("share") >= least) & (told >= certain)).select("entity", "term", "share")


def disclosing(docs: DataFrame, texts: DataFrame, text_col: str = "text", support: int = SUPPORT, least: float = GENERALISE, certain: float = CERTAIN) -> DataFrame:
    """(entity, term, share) of the terms that disclose an entity: see the module's text.

    `texts` is what `analyse` gives. Document frequencies of terms are counted over all documents; every count is a
    map-side-combined aggregate. Entities of fewer than `support` texts have no pair with that many.
    """
    classes = _classes(texts, support)
    told = _told(docs, texts, classes, text_col, support, least, certain)
    return told.withColumnRenamed("entity", "of").join(classes.select("entity", "of"), "of").select("entity", "term", "share")


def _few(df: DataFrame, most: int | None = None) -> bool:
    most = BROADCAST if most is None else most
    return df.limit(most + 1).count() <= most


def _among(words: DataFrame, terms: DataFrame) -> DataFrame:
    """`words` without most of those whose `term` isn't among `terms`, told by broadcast hashes, which are of one size whatever the terms.

    A word may stay that only shares its hash; nothing that is wanted goes. Where there are too many terms all stay.
    """
    if not _few(terms, HASHES):
        return words
    hashes = terms.select(F.xxhash64("term").alias("_t")).distinct()
    return words.withColumn("_t", F.xxhash64("term")).join(F.broadcast(hashes), "_t", "left_semi").drop("_t")


def _table(terms: Column) -> Column:
    """Terms (structs of term and what) dealt by hash to as many lists as the root of their number, so that a look-up is short."""
    many = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(terms))).cast("int"))
    return let(F.struct(terms.alias("t"), many.alias("n")), lambda v: F.transform(F.sequence(F.lit(0), v["n"] - 1), lambda i: F.filter(v["t"], lambda e: F.pmod(F.hash(e["term"]), v["n"]) == i)))


def _become(table: Column, word: Column) -> Column:
    """What becomes of a word; null if the table doesn't have it."""
    lot = F.get(table, F.pmod(F.hash(word), F.size(table)))
    return F.get(F.filter(lot, lambda e: e["term"] == word), 0)["what"]


def _put(what: Column, word: Column) -> Column:
    """Nothing for a word that is removed, else its class."""
    kind = F.when(word.rlike(r"^\p{N}+$"), "[NUMBER]").when(word.rlike(r"\p{N}"), "[CODE]").when(word.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
    return F.when(what == "", what).otherwise(kind)


def with_spans(docs: DataFrame, text_col: str = "text", support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """`docs` with base and added (array<SPAN>): the identifiers, and the terms (`more` is what becomes of them) that tell of an entity.

    A learnt term counts in every document. Equal texts get equal spans; null counts as empty.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = checkpoint(analyse(docs, text_col))
    shares = _told(docs, texts, _classes(texts, support), text_col, support, generalise, CERTAIN)
    told = checkpoint(shares.groupBy("term").agg(F.max("share").alias("share")))
    word = docs.select(F.xxhash64(text).alias("h"), F.explode(_words(text)).alias("term"))
    hits = checkpoint(word.join(F.broadcast(told) if _few(told) else told, "term").distinct())
    become = F.when(F.col("share") >= remove, F.lit("")).otherwise(F.lit("class"))
    terms = hits.groupBy("h").agg(_table(F.collect_list(F.struct("term", become.alias("what")))).alias("_terms"))
    based = docs.withColumn("_h", F.xxhash64(text)).withColumn("base", base_spans(text))
    if _few(hits):  # no text moves
        joined = based.join(F.broadcast(terms.withColumnRenamed("h", "_h")), "_h", "left")
    else:
        parts = terms.select(F.col("h").alias("_h"), "_terms", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_part"))
        joined = based.withColumn("_part", F.spark_partition_id() % SALTS).join(parts, ["_h", "_part"], "left").drop("_part")

    def added(table: Column) -> Column:
        found = matches(masked(text, F.col("base")), MARKED_WORD, 4, lambda m: ~m.contains(MARK) & _become(table, F.lower(m)).isNotNull())
        return F.transform(found, lambda w: F.struct(w["start"].alias("start"), w["k"].alias("k"), w["end"].alias("end"), _put(_become(table, F.lower(w["more"])), w["more"]).alias("more")))

    named = F.when(F.col("_terms").isNotNull(), added(F.col("_terms")).cast(f"array<{SPAN}>")).otherwise(none())
    return joined.withColumn("added", named).drop("_h", "_terms")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base, added of every document. Null counts as empty; equal texts get equal spans; ids play no part; an
    empty table gives no rows. Only id and text are read, so other columns can't clash."""
    return with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", "base", "added")


def report(docs: DataFrame, **options: str) -> DataFrame:
    """doc_id, counts of identifiers by kind, base_sha256, spans (all, with the added ones), one row for each document.

    Null and empty texts have no spans; repeated rows and null ids stay rows of their own; spans that start together go by kind.
    """
    out = find(docs, **options)
    counts = [count(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(4)]
    return out.select("doc_id", *counts, F.sha2(listed(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "added")), KINDS).alias("spans"))


def replaced(s: Column) -> Column:
    """What stands for a span: the kind in brackets for an identifier, what becomes of it for a term."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS[:4]))
    return F.coalesce(F.when(s["k"] == 4, s["more"]).otherwise(F.get(names, s["k"])), F.lit(""))


def sanitise(docs: DataFrame, text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns of `docs` with their texts redacted; `count_col`, if there, is set anew where a text changed.

    All other texts pass through untouched. Null stays null.
    """
    cols = docs.columns
    renamed = docs.select(F.struct(*[F.col(c) for c in cols if c != text_col], F.lit(0).alias(free_name("_", cols))).alias("row"), F.col(text_col).alias("text"))
    found = with_spans(renamed).withColumn("spans", F.array_sort(F.concat("base", "added")))
    changed = F.size("spans") > 0
    both = found.select("row", F.when(changed, redact(F.col("text"), F.col("spans"), replaced)).otherwise(F.col("text")).alias("text"), changed.alias("changed"))
    out = {c: F.col("row")[c] for c in cols if c != text_col} | {text_col: F.col("text")}
    if count_col in cols:
        out[count_col] = F.when(F.col("changed"), F.length("text")).otherwise(out[count_col]).cast(docs.schema[count_col].dataType)
    return both.select(*[out[c].alias(c) for c in cols])
