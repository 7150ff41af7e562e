"""Names of sources and companies, as their postings have them: dominant names, proposals, and pages that break rules."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup, names
from ..functions.shown import unsquashed

# The share and number of postings that make a name a source's, and those of a brand within one; lengths that a page keeps to.
MAJORITY, ENOUGH, BRAND = 0.6, 20, 10
LONGEST_TITLE, DESCRIPTION = 60, (50, 160)
#: Page names of a source that are looked through for a spelling with blanks.
PAGE_NAMES = 50


def company_names(postings: DataFrame, known: DataFrame) -> DataFrame:
    """(company_key, display_name) of companies that aren't known yet: the largest name of each key, else the key."""
    named = postings.where("company_key IS NOT NULL").groupBy("company_key").agg(F.max("company").alias("name"))
    return named.join(known.select("company_key"), "company_key", "left_anti").select("company_key", F.substring(F.coalesce("name", "company_key"), 1, 255).alias("display_name"))


def site_combinations(postings: DataFrame) -> DataFrame:
    """(company_key, domain, source, name): the different places a company's postings come from, each with one name."""
    return postings.where("company_key IS NOT NULL").groupBy("company_key", "domain", "source").agg(F.max("company").alias("name"))


def proposals(sources: DataFrame, postings: DataFrame) -> DataFrame:
    """(source, kind, name, share): what the names on a source's postings say of its own name.

    sources: source, name, board. postings: source, company. kind is `fix` where the name is a slug or host, or has a note, and a name takes its place that
    is confirmed by the board's address or that was left by dropping the note; `review` where a name dominates that the address doesn't confirm,
    shares no word with the source's, or spells a squashed one; `brand` for names with enough postings and no word of the source's. Names of postings are counted
    before they meet their source, so a source's row count plays no part after that.
    """
    counted = postings.where("company IS NOT NULL").groupBy("source", "company").agg(F.count("*").alias("n"))
    usable = F.when(~names.has_entity_code(F.col("company")), names.display_company(F.col("company")))
    votes = counted.withColumn("usable", usable).where("usable IS NOT NULL").groupBy("source", "usable").agg(F.sum("n").alias("n"))
    best = votes.groupBy("source").agg(F.min(F.struct((-F.col("n")).alias("less"), "usable")).alias("b"), F.sum("n").alias("all"))
    dominant = best.select("source", F.col("b.usable").alias("dominant"), (-F.col("b.less") / F.col("all")).alias("share"))
    order = Window.partitionBy("source").orderBy(F.desc("n"), "company")
    pages = counted.withColumn("r", F.row_number().over(order)).where(F.col("r") <= PAGE_NAMES)
    spelt = pages.groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "company"))), lambda x: x["company"]).alias("pages"))
    total = counted.groupBy("source").agg(F.sum("n").alias("postings"))
    tokens = lambda c: F.filter(F.array_distinct(F.split(names.plain_words(c), " ")), lambda w: F.length(w) >= 3)
    own = sources.withColumn("brand", names.brand_of_source(F.col("name")))
    df = own.join(dominant, "source", "left").join(spelt, "source", "left").join(total, "source", "left").withColumn("spaced", unsquashed(F.col("name"), F.coalesce("pages", F.array().cast("array<string>"))))
    address = F.lower(F.concat_ws(" ", "name", "board"))
    confirmed = F.exists(tokens(F.col("dominant")), lambda w: address.contains(w))
    slug, noted = F.col("brand").isNull(), F.col("brand").isNotNull() & (F.col("brand") != F.col("name"))
    major = F.col("share") >= MAJORITY
    apart = major & (F.col("postings") >= ENOUGH) & ~F.arrays_overlap(tokens(F.col("brand")), tokens(F.col("dominant")))
    kind = F.when(noted, "fix").when(slug & major & confirmed, "fix").when(slug & major, "review").when(~slug & F.col("spaced").isNotNull(), "review").when(~slug & apart, "review")
    name = F.when(noted, F.col("brand")).when(slug, F.col("dominant")).when(F.col("spaced").isNotNull(), F.col("spaced")).otherwise(F.col("dominant"))
    main = df.select("source", kind.alias("kind"), name.alias("name"), F.when(noted | (~slug & F.col("spaced").isNotNull()), F.lit(None)).otherwise(F.col("share")).alias("share")).where("kind IS NOT NULL")
    fixed = main.where("kind = 'fix'").select("source", F.col("name").alias("_fixed"))
    called = sources.join(fixed, "source", "left").select("source", tokens(F.coalesce("_fixed", "name")).alias("own"))
    brands = counted.where(F.col("n") >= BRAND).where(~names.has_entity_code(F.col("company"))).join(called, "source").where(~F.arrays_overlap(tokens(F.col("company")), "own"))
    return main.unionByName(brands.select("source", F.lit("brand").alias("kind"), F.col("company").alias("name"), F.lit(None).cast("double").alias("share")))


def _issues(page: str | None, url: str | None, indexed: bool) -> tuple[str | None, str | None, list[str]]:
    """(title, description, issues) of a page."""
    titles, headings, description, canonical, robots, blocks = [], 0, None, [], None, []
    words: list[str] | None = None
    for kind, name, text, lo, hi in markup.tokens(page or ""):
        if words is not None and kind == "text":
            words.append(text)
        elif name == "title":
            if kind == "close" and words is not None:
                titles.append(markup.html.unescape("".join(words)).strip())
            words = [] if kind == "open" else None
        elif kind == "raw":
            if name == "script" and markup.attributes(text).get("type") == "application/ld+json":
                blocks.append(page[lo:hi])
        elif kind == "open" and name == "h1":
            headings += 1
        elif kind == "open" and name in ("meta", "link"):
            a = markup.attributes(text)
            if name == "link" and a.get("rel") == "canonical":
                canonical.append(a.get("href", ""))
            elif name == "meta" and a.get("name") == "description":
                description = a.get("content", "")
            elif name == "meta" and a.get("name") == "robots":
                robots = a.get("content", "")
    out = []
    if len(titles) != 1 or not titles[0]:
        out.append("title")
    elif len(titles[0]) > LONGEST_TITLE:
        out.append("title_length")
    if not description:
        out.append("description")
    elif not DESCRIPTION[0] <= len(description) <= DESCRIPTION[1]:
        out.append("description_length")
    out += ["h1"] * (headings != 1) + ["canonical"] * (canonical != [url]) + ["robots"] * (robots != ("index, follow" if indexed else "noindex, follow"))
    for raw in blocks:
        try:
            if "JobPosting" in json.dumps(json.loads(raw)):
                out.append("job_posting_markup")
        except (ValueError, RecursionError):
            out.append("structured_data")
    return (titles[0] if titles else None), description, list(dict.fromkeys(out))


def page_issues(pages: DataFrame) -> DataFrame:
    """(id, issue) of pages: id, url, html, indexed. Rules of a page by itself, then titles and descriptions that indexed pages share.

    Of pages that share one the one with the smallest id is in order. A page is read once, in time that grows with its length.
    """
    kind = pages.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, bool(x), *_issues(h, u, bool(x))) for i, u, h, x in zip(b["id"], b["url"], b["html"], b["indexed"], strict=True)]
            yield pd.DataFrame(rows, columns=["id", "indexed", "title", "description", "issues"])

    read = pages.select("id", "url", "html", "indexed").mapInPandas(run, f"id {kind}, indexed boolean, title string, description string, issues array<string>")
    firsts = lambda c: read.where(F.col("indexed") & F.col(c).isNotNull()).groupBy(c).agg(F.min("id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    out = read.select("id", F.explode("issues").alias("issue"))
    for c in ("title", "description"):
        again = read.where("indexed").select("id", c).join(firsts(c), c).where("id <> _first")
        out = out.union(again.select("id", F.lit(f"duplicate_{c}").alias("issue")))
    return out
