"""The generic scan: what a page says of a job, from its structured data, else from its Open Graph tags, title and prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, pay, shown


def _text(x: Column) -> Column:
    """Entities decoded, blanks squeezed; null when nothing is left."""
    return F.nullif(html.squeezed(html.unescaped(x)), F.lit(""))


def scan_pages(pages: DataFrame, today: str) -> DataFrame:
    """id, status, title, company, location, workplace, employment, salary_min, salary_max, salary_currency, description, posted, told_by.

    pages: id, html. A posting whose last day is over is `expired` and says nothing else, whatever is left on its page. Without structured data
    og:title goes before the title, and og:description may hold "Location | Type". Salaries come from the structure, else from the text.
    A page without anything is `empty`. Each page is parsed once.
    """
    page = F.col("html")
    read = pages.select("id", html.ld_posting("html").alias("x"), _text(html.page_title(page)).alias("page_title"), _text(html.meta(page, "description")).alias("summary"), *[_text(html.meta(page, f"og:{c}")).alias(c) for c in ("title", "site_name", "description")])
    known = F.col("x.told_by").isNotNull()
    over = F.coalesce(F.try_to_date(F.col("x.expires")) < F.lit(today).cast("date"), F.lit(False))
    place, work = shown.place_and_workplace(F.col("description"))
    told = read.select(
        "id", over.alias("over"), F.coalesce(F.when(known, F.col("x.title")).otherwise(F.col("title")), "page_title").alias("title"), F.when(known, F.col("x.company")).otherwise(F.col("site_name")).alias("company"),
        F.when(known, F.col("x.location")).otherwise(place).alias("location"), F.when(known, F.coalesce("x.workplace", F.lit("unknown"))).otherwise(work).alias("workplace"), F.coalesce("x.employment", F.lit("unknown")).alias("employment"),
        F.when(known, F.coalesce("x.description", "summary")).otherwise(F.coalesce("summary", "description")).alias("description"),
        "x.salary_min", "x.salary_max", "x.salary_currency", "x.posted", F.coalesce("x.told_by", F.when(F.col("title").isNotNull() | F.col("description").isNotNull(), F.lit("open graph")).when(F.col("page_title").isNotNull(), F.lit("title"))).alias("told_by"),
    ).withColumn("prose", pay.salary_from_text(F.col("description")))
    structured = F.col("salary_min").isNotNull() | F.col("salary_max").isNotNull()
    for c in ("salary_min", "salary_max", "salary_currency"):
        told = told.withColumn(f"_{c}", F.when(structured, F.col(c)).otherwise(F.col(f"prose.{c}")))
    status = F.when(F.col("over"), "expired").when(F.col("told_by").isNull() & F.col("description").isNull(), "empty").otherwise("ok")
    fields = ["title", "company", "location", "workplace", "employment", "description", "posted", "told_by"]
    keep = lambda c, name=None: F.when(~F.col("over"), F.col(c)).alias(name or c)
    return told.select("id", status.alias("status"), *map(keep, fields), *[keep(f"_{c}", c) for c in ("salary_min", "salary_max", "salary_currency")])
