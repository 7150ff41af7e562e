"""Expressions and batch functions over HTML pages."""

from __future__ import annotations

import html
import json
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .markup import Scope, attributes, markdown, tokens
from .shown import EMPLOYMENT

#: A description of fewer characters is incomplete.
COMPLETE_CHARS = 300
# What stands where no place is known.
NO_PLACE = ("UNAVAILABLE", "N/A")


def squeezed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def page_title(page: Column) -> Column:
    """The text of <title>, tags and repeated blanks removed; null without one."""
    return F.nullif(squeezed(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def meta(page: Column, name: str) -> Column:
    """The content of <meta name=...> or <meta property=...>, attributes in either order; null without one."""
    tag = rf"""(?is)<meta\b(?=[^>]*\b(?:name|property)\s*=\s*["']{re.escape(name)}["'])[^>]*\bcontent\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    return F.nullif(F.concat(F.regexp_extract(page, tag, 1), F.regexp_extract(page, tag, 2)), F.lit(""))


def is_complete(text: Column, description: Column) -> Column:
    """Long enough, and more than the page's own short description."""
    same = (F.length(description) <= 1000) & (squeezed(text) == squeezed(description))
    return (F.length(F.trim(F.coalesce(text, F.lit("")))) >= COMPLETE_CHARS) & ~F.coalesce(same, F.lit(False))


@F.pandas_udf(T.StringType())
def unescaped(col: pd.Series) -> pd.Series:
    """HTML entities decoded, up to three layers deep."""

    def one(x: str | None) -> str | None:
        for _ in range(3):
            if x is None or x == (y := html.unescape(x)):
                break
            x = y
        return x

    return col.map(one, na_action="ignore")


@F.pandas_udf(T.StringType())
def html_to_text(col: pd.Series) -> pd.Series:
    return col.map(markdown, na_action="ignore")


def ld_nodes(page: str | None) -> Iterator[dict]:
    """All objects of a page's JSON-LD blocks, lists and graphs unrolled; broken blocks are tried unescaped, then skipped."""
    if "script" not in (page or "").lower():
        return
    for kind, name, tag, lo, hi in tokens(page):
        if kind != "raw" or name != "script" or attributes(tag).get("type", "").strip().lower() != "application/ld+json":
            continue
        for text in (page[lo:hi], html.unescape(page[lo:hi])):
            try:
                todo = deque([json.loads(text, strict=False)])
            except (ValueError, RecursionError):
                continue
            while todo:
                x = todo.popleft()
                if isinstance(x, list):
                    todo.extendleft(reversed(x))
                elif isinstance(x, dict):
                    yield x
                    if "@graph" in x:
                        todo.appendleft(x["@graph"])
            break


def microdata(page: str | None) -> dict:
    """Title, company, place and dates of the first job posting in a page's microdata; empty without one."""
    if "JobPosting" not in (page or ""):
        return {}
    x = Scope(page)
    where = ", ".join(filter(None, (x.value(k, "jobLocation") for k in ("addressLocality", "addressRegion", "addressCountry"))))
    out = {"title": x.value("title"), "company": x.value("name", "hiringOrganization"), "location": where[:255] or None, "posted": (x.value("datePosted") or "")[:10] or None, "expires": (x.value("validThrough") or "")[:10] or None}
    return out | {"workplace": "unknown"} if any(out.values()) else {}


def _kind_of_employment(x: object) -> str:
    one = x[0] if isinstance(x, list) and x else x
    return EMPLOYMENT.get(one.strip().upper().replace("-", "_").replace(" ", "_"), "unknown") if isinstance(one, str) else "unknown"


def _place(node: object) -> str | None:
    """Towns, states and countries of a job's locations, each once, in order; what says only that none is known is left out."""
    out: list[str] = []
    for place in node if isinstance(node, list) else [node]:
        address = place.get("address") if isinstance(place, dict) else None
        address = address[0] if isinstance(address, list) and address else address
        if isinstance(address, dict):
            said = [x.get("name") if isinstance(x, dict) else x for x in (address.get(k) for k in ("addressLocality", "addressRegion", "addressCountry"))]
            out.append(", ".join(x.strip() for x in said if isinstance(x, str) and x.strip() and x.strip().upper() not in NO_PLACE))
    return "; ".join(dict.fromkeys(filter(None, out)))[:255] or None


def posting(page: str | None) -> dict:
    """Title, company, place, salary, kind of work, text and dates of the first JSON-LD job posting, else of the microdata; empty without both."""
    first = lambda x: x[0] if isinstance(x, list) and x else x
    for x in ld_nodes(page):
        kinds = x.get("@type")
        if "JobPosting" not in (kinds if isinstance(kinds, list) else [kinds]):
            continue
        org, pay, where = first(x.get("hiringOrganization")), first(x.get("baseSalary")), _place(x.get("jobLocation"))
        value = pay.get("value") if isinstance(pay, dict) else None
        low, high = (value.get("minValue"), value.get("maxValue")) if isinstance(value, dict) else (value, value)
        number = lambda v: float(v) if isinstance(v, int | float) and not isinstance(v, bool) and v > 0 else None
        text = lambda v: v if isinstance(v, str) else None
        far = x.get("jobLocationType")
        far = far == "TELECOMMUTE" or (isinstance(far, list) and "TELECOMMUTE" in far)
        return {
            "title": text(x.get("title")), "company": text(org.get("name")) if isinstance(org, dict) else text(org), "location": where,
            "salary_min": number(low), "salary_max": number(high), "salary_currency": text(pay.get("currency")) if isinstance(pay, dict) else None,
            "posted": str(x.get("datePosted") or "")[:10] or None, "expires": str(x.get("validThrough") or "")[:10] or None,
            "workplace": {(True, True): "hybrid", (True, False): "remote", (False, True): "onsite"}.get((far, where is not None), "unknown"),
            "employment": _kind_of_employment(x.get("employmentType")), "description": markdown(text(x.get("description"))), "told_by": "json-ld",
        }
    found = microdata(page)
    return found | {"told_by": "microdata"} if found else found


_NUMBERS = ("salary_min", "salary_max")
_FIELDS = ("title", "company", "location", *_NUMBERS, "salary_currency", "posted", "expires", "workplace", "employment", "description", "told_by")
POSTING = T.StructType([T.StructField(c, T.DoubleType() if c in _NUMBERS else T.StringType()) for c in _FIELDS])


@F.pandas_udf(POSTING)
def ld_posting(col: pd.Series) -> pd.DataFrame:
    df = pd.DataFrame([posting(x) for x in col], columns=POSTING.names, dtype=object)
    return df.where(df.notna(), None).astype(dict.fromkeys(_NUMBERS, float))
