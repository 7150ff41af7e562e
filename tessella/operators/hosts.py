"""What a URL's host says: the domain that can be registered, and the kind of board a URL belongs to. Rules are tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import host_of, path_of

#: Rules up to which they are broadcast, and rules of boards that fit into one expression.
BROADCAST, RULES = 500_000, 1_000


def suffixes(host: Column) -> Column:
    """All suffixes of a host by labels, the longest first: a.b.c, b.c, c."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def registrable(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """(url, domain) of each different URL or bare host: the public suffix and one label more.

    rules: rule, as in lists of public suffixes: `co.uk`, `*.ck` (any label before), `!www.ck` (not after all). The longest rule counts, an
    exception before any. Hosts under no rule (addresses, local names, junk), and hosts that are a suffix themselves, have none. Each
    different host is looked up once, by equality of its suffixes.
    """
    host = F.coalesce(host_of(F.col("url")), host_of(F.concat(F.lit("//"), F.trim("url"))))
    each = urls.select(F.col(url_col).alias("url")).where("url IS NOT NULL").distinct().withColumn("host", F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit("")))
    rule = F.lower(F.trim("rule"))
    kinds = rules.select(F.regexp_replace(rule, r"^(\*\.|!)", "").alias("suffix"), F.when(rule.startswith("!"), -1).when(rule.startswith("*."), 1).otherwise(0).alias("extra")).distinct()
    known = kinds.groupBy("suffix").agg(F.min("extra").alias("least"), F.max("extra").alias("most"))
    known = known if known.limit(BROADCAST + 1).count() > BROADCAST else F.broadcast(known)
    hosts = each.select("host").where("host IS NOT NULL").distinct()
    met = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("suffix")).join(known, "suffix")
    size = F.size(F.split("suffix", r"\."))
    # A wildcard needs a label to stand for; without one the plain rule of that name counts, if there is one.
    wide = (F.col("most") == 1) & (size < F.size(F.split("host", r"\.")))
    labels = F.when(F.col("least") == -1, size - 1).when(wide, size + 1).when((F.col("least") == 0) | (F.col("most") == 0), size)
    best = met.groupBy("host").agg(F.coalesce(F.max(F.when(F.col("least") == -1, labels)), F.max(labels)).alias("n"))
    parts = F.split("host", r"\.")
    domain = F.when(F.size(parts) > F.col("n"), F.array_join(F.slice(parts, F.size(parts) - F.col("n"), F.col("n") + 1), "."))
    return each.join(best.select("host", domain.alias("domain")), "host", "left").select("url", "domain")


def route(url: Column, rules: list[dict]) -> Column:
    """struct<kind, board, priority> of the first rule that a URL meets, null without one.

    A rule has `priority`, `kind`, `host` (a suffix by labels, or empty for any host), `key` (`label`: the host's label before the suffix;
    `host`; `path:n`: the n-th part of the path; or the name of a parameter) and, if need be, `path`: a pattern that the path must match. Only the rules
    filed under one of the host's own suffixes are looked at, so a URL's work doesn't grow with their number.
    """
    if len(rules) > RULES:
        raise ValueError(f"more than {RULES} rules")
    filed: dict[str, list[dict]] = {}
    for r in rules:
        filed.setdefault(r["host"], []).append(r)
    fields = ("priority", "kind", "host", "key", "path")
    item = lambda r: F.struct(*[F.lit(r.get(c)).cast("int" if c == "priority" else "string").alias(c) for c in fields])
    table = F.create_map(*[x for h, rs in sorted(filed.items()) for x in (F.lit(h), F.array(*map(item, rs)))])
    host, path = host_of(url), path_of(url)
    segments = F.filter(F.split(path, "/"), lambda p: p != "")

    def met(r: Column) -> Column:
        before = F.nullif(F.regexp_extract(F.substring(host, F.lit(1), F.length(host) - F.length(r["host"]) - 1), r"[^.]+$", 0), F.lit(""))
        nth = F.get(segments, F.substring_index(r["key"], ":", -1).cast("int") - 1)
        parameter = F.try_element_at(F.str_to_map(F.coalesce(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit("")), F.lit("&"), F.lit("=")), r["key"])
        key = F.when(r["key"] == "label", before).when(r["key"] == "host", host).when(r["key"].startswith("path:"), nth).otherwise(parameter)
        return F.struct(r["priority"].alias("priority"), r["kind"].alias("kind"), F.when(r["path"].isNull() | F.regexp_like(path, F.coalesce(r["path"], F.lit(""))), F.nullif(key, F.lit(""))).alias("board"))

    own = F.concat(suffixes(host), F.array(F.lit("")))
    found = F.filter(F.flatten(F.filter(F.transform(own, lambda s: F.try_element_at(table, s)), lambda x: x.isNotNull())), lambda r: r.isNotNull())
    hits = F.filter(F.transform(found, met), lambda r: r["board"].isNotNull())
    first = F.array_min(hits)
    return F.when(first.isNotNull(), F.struct(first["kind"].alias("kind"), first["board"].alias("board"), first["priority"].alias("priority")))
