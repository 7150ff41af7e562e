"""URL expressions: canonical form, hash, host and path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that only track where a visitor came from.
TRACKING = ["gclid", "fbclid", "ref", "igshid"]
TRACKING_PREFIX = "utm_"

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _PARTS, n)


def domain_of(url: Column) -> Column:
    """Host, with its port if there is one."""
    return F.lower(_part(url, 2))


def host_of(url: Column) -> Column:
    """Host without user, port and a dot at its end, lower case; null where a URL has none."""
    bare = F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:@]*)", 1)
    return F.nullif(F.regexp_replace(F.lower(bare), r"\.+$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and host, no trailing slash but the root's, no tracking parameters, the others sorted, no fragment.

    Escapes inside parameters are kept as they are.
    """
    path = F.regexp_replace(_part(url, 3), "/+$", "")
    params = F.filter(F.split(_part(url, 4), "&"), lambda p: p != "")
    name = lambda p: F.lower(F.regexp_extract(p, "^[^=]*", 0))
    kept = F.filter(params, lambda p: ~name(p).isin(TRACKING) & ~name(p).startswith(TRACKING_PREFIX))
    query = F.array_join(F.array_sort(F.transform(kept, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))), "&")
    out = F.concat(F.lower(_part(url, 1)), F.lit("://"), domain_of(url), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(url.rlike(_PARTS), out).otherwise(url)


def url_hash(normalized: Column) -> Column:
    return F.sha2(normalized.cast("binary"), 256)


def page_path(url: Column, host: str) -> Column:
    """The path of a page on the given host, without a trailing slash; null elsewhere."""
    path = F.regexp_replace(_part(url, 3), "/+$", "")
    return F.when(domain_of(url) == host, F.when(path == "", "/").otherwise(path))
