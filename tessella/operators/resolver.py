"""Free-text places: what each entry of a posting's locations names, looked up in a gazetteer that is a table.

Every different entry is taken apart once, in column expressions: words on how one works are set aside, the rest gives a few
variants, and each variant gives an ordered list of look-ups (a name within a state, or a name alone). All look-ups meet the
gazetteer in one join on equal keys; the first that is found counts. A name alone is trusted only where it dominates, which
a window of two over each name's areas tells beforehand.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain_words

# Fixed values.
DOMINANCE = 5
CITY_WORDS = 4
HOME_NAMES = ("us", "usa", "united states", "united states of america", "america")
REGION_WORDS = ("asia", "apac", "emea", "europe", "latam", "latin america", "worldwide", "global", "anywhere", "north america", "americas", "international", "nationwide")
PROVINCES = ("ontario", "quebec", "british columbia", "alberta", "manitoba", "saskatchewan", "nova scotia", "new brunswick", "newfoundland and labrador", "newfoundland", "prince edward island", "yukon", "northwest territories", "nunavut")
SPELT_OUT = {"st": "saint", "ste": "sainte", "ft": "fort", "mt": "mount"}
AFTER_STATE = ("us", "usa", "america", "the")
NEVER_A_STATE_ALONE = ("washington",)
STATE_WITH_SIGNAL_ONLY = ("georgia",)
CITY_NAMED_AS_STATE = ("new york",)
GENERIC_WORDS = ("north", "south", "east", "west", "central", "new", "old", "street", "avenue", "road", "drive", "boulevard", "park", "plaza", "center", "centre", "campus", "building", "tower", "square", "suite", "floor", "lane", "way", "court", "circle", "place", "main", "first", "second", "third")
REMOTE_WORDS = r"remote(?:ly)?|virtual|telecommut\w*|tele-?work\w*|work\s+from\s+home|wfh"
ONSITE_WORDS = r"on-?site|in-?office|office"
SITE_WORDS = "hq|headquarters|campus"

HOME_SIGNAL = r"\b(us|usa|united states( of america)?)\b"
DASH = r"\s+[-–—]\s+"
EDGES = r"^[\s\-–—/:]+|[\s\-–—/:]+$"
#: Names of a gazetteer up to which it is broadcast, and rows that a list of states or countries may have.
BROADCAST, FEW = 500_000, 10_000


@dataclass
class Gazetteer:
    """places: place_id, name, state (code), area (code or null), population, lat, lon, aliases (array).

    states: code -> name. countries: name -> code, of all but the home country. namesakes: name, population of cities abroad.
    nicknames: a name of an area -> (area, state).
    """

    places: DataFrame
    states: dict[str, str]
    countries: dict[str, str]
    namesakes: DataFrame | None = None
    nicknames: dict[str, tuple[str, str]] = field(default_factory=dict)
    home: str = "US"

    def __post_init__(self):
        if len(self.states) + len(self.countries) > FEW:
            raise ValueError(f"more than {FEW} states and countries")
        simple = lambda s: " ".join("".join(c if c.isalnum() else " " for c in s.lower().replace(".", "").replace("'", "")).split())
        self.code_of = {c.lower(): c for c in self.states}
        self.code_of_name = {simple(n): c for c, n in self.states.items()}
        self.abroad = {simple(n): c for n, c in self.countries.items()}
        self.foreign = sorted((set(self.abroad) | set(PROVINCES)) - set(self.code_of_name))


def city_key(words: Column) -> Column:
    """A normalised name with short forms spelt out."""
    return reduce(lambda x, s: F.regexp_replace(x, rf"\b{s}\b", SPELT_OUT[s]), SPELT_OUT, words)


def _named(d: dict[str, str], key: Column) -> Column:
    """d[key], null where it has none."""
    if not d:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), key)


def _parts(text: Column, at: str = ",") -> Column:
    """The normalised parts of a text, without empty ones."""
    return F.filter(F.transform(F.split(text, at), plain_words), lambda x: x != "")


def _all(xs: Column, f: Callable[[Column], Column]) -> Column:
    return (F.size(xs) > 0) & F.forall(xs, f)


def index(g: Gazetteer) -> DataFrame:
    """state, key, primary -> place: what each look-up finds.

    Within a state a place's own name goes before another's alias, then the larger place. A name without a state (state is
    empty) has a place only if its largest area is DOMINANCE times the next, and no city abroad of that name is larger;
    `primary` counts own names alone.
    """
    key = lambda c: city_key(plain_words(c))
    place = F.struct(*[F.col(c) for c in ("place_id", "state", "area", "lat", "lon")]).alias("place")
    rows = g.places.select(place, "state", F.coalesce("area", F.concat(F.lit("rural:"), "state")).alias("district"), "population", key(F.col("name")).alias("own"), F.transform(F.coalesce("aliases", F.array()), key).alias("others"))
    aliases = F.filter(F.array_except("others", F.array("own")), lambda a: ~a.isin(*GENERIC_WORDS) & (a != ""))
    entries = F.concat(F.array(F.struct(F.col("own").alias("key"), F.lit(False).alias("alias"))), F.transform(aliases, lambda a: F.struct(a.alias("key"), F.lit(True).alias("alias"))))
    names = rows.select("place", "state", "district", "population", F.inline(entries)).where("key <> ''")
    inside = names.groupBy("state", "key").agg(F.min(F.struct("alias", (-F.col("population")).alias("less"), "place")).alias("b")).select("state", "key", F.lit(False).alias("primary"), F.col("b.place").alias("place"))

    both = names.select("*", F.explode(F.when(F.col("alias"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("primary"))
    largest = both.groupBy("primary", "key", "district").agg(F.min(F.struct((-F.col("population")).alias("less"), "place")).alias("b"))
    two = Window.partitionBy("primary", "key").orderBy("b")
    ranked = largest.withColumn("r", F.row_number().over(two)).where("r <= 2")
    best = ranked.groupBy("primary", "key").agg(F.min(F.when(F.col("r") == 1, F.col("b"))).alias("b"), F.coalesce(F.max(F.when(F.col("r") == 2, -F.col("b.less"))), F.lit(0)).alias("next"))
    if g.namesakes is not None:
        abroad = g.namesakes.select(key(F.col("name")).alias("key"), F.col("population").alias("rival")).groupBy("key").agg(F.max("rival").alias("rival"))
        best = best.join(abroad, "key", "left")
    else:
        best = best.withColumn("rival", F.lit(0))
    sure = (-F.col("b.less") >= DOMINANCE * F.greatest("next", F.lit(1))) & (F.coalesce("rival", F.lit(0)) <= -F.col("b.less"))
    alone = best.where(sure).select(F.lit("").alias("state"), "key", "primary", F.col("b.place").alias("place"))
    return inside.unionByName(alone)


def workplace_words(entry: Column) -> tuple[Column, Column]:
    """(the entry without the words on how one works, what they say or null)."""
    text = F.regexp_replace(F.replace(entry, F.lit("_"), F.lit(" ")), r"(?i)\bhome\s+office\b", " ")
    away = r"(?i)\b(?:remote|virtual)\s+office\b"
    rest = F.regexp_replace(text, away, " ")
    remote = text.rlike(away) | rest.rlike(rf"(?i)\b(?:{REMOTE_WORDS})\b")
    hybrid, onsite = rest.rlike(r"(?i)\bhybrid\b"), F.regexp_replace(rest, rf"(?i)\b(?:{REMOTE_WORDS})\b", " ").rlike(rf"(?i)\b(?:{ONSITE_WORDS})\b")
    every = rf"(?i)\b(?:{REMOTE_WORDS}|hybrid|{ONSITE_WORDS}|{SITE_WORDS})\b"

    def bare(part: Column) -> Column:
        trimmed = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(part, every, " "), r"\s+", " ")), EDGES, "")
        return F.regexp_replace(F.regexp_replace(trimmed, r"(?i)^(?:or|and)\b|\b(?:or|and)$", ""), EDGES, "")

    touched = text.rlike(away) | rest.rlike(every)
    cleaned = F.array_join(F.filter(F.transform(F.split(rest, ","), bare), lambda p: p != ""), ", ")
    says = F.when(hybrid | (remote & onsite), "hybrid").when(remote, "remote").when(onsite, "onsite")
    return F.when(touched, cleaned).otherwise(text), says


def variants(entry: Column, stripped: Column, home: Column) -> Column:
    """The stripped entry without noise, then each part of a "Facility - City" entry, likeliest first, then all without area words."""
    cleaned = F.regexp_replace(stripped, r"\([^)]*\)", " ")
    cleaned = F.regexp_replace(cleaned, r"(?i)\bunited\s*,\s*states\b", "United States")
    cleaned = F.regexp_replace(cleaned, r"\bUS[- ]([A-Za-z]{2})\b", ", $1, US")
    cleaned = F.element_at(F.split(cleaned, ":"), -1)
    segments = F.split(cleaned, DASH)
    first = F.concat(F.array(cleaned), F.reverse(F.slice(segments, 2, F.size(segments))), F.slice(segments, 1, 1))
    without = F.transform(first, lambda v: F.regexp_replace(v, r"(?i)\b(?:metropolitan|metro|area|greater)\b", " "))
    code = F.regexp_extract(entry, r"\b[0-9]{2,}[-_]([A-Z]{2})[-_]", 1)
    last = F.when(home & (code != ""), F.array(F.concat(code, F.lit(", United States")))).otherwise(F.array())
    return F.array_distinct(F.filter(F.transform(F.concat(first, without, last), lambda v: F.trim(v)), lambda v: F.regexp_replace(v, r"[\s,\-–—/]", "") != ""))


def state_mark(token: Column, g: Gazetteer) -> Column:
    """struct<code, how> of a token that names a state: by its code, its name, or its code before a ZIP; code is null otherwise."""
    head = F.element_at(F.split(token, " "), 1)
    zipped, noisy = token.rlike("^[a-z]{2}( [0-9]+)+$"), token.rlike(rf"^[a-z]{{2}}( ([0-9]+|{'|'.join(AFTER_STATE)}))+$")
    by_code, by_name = _named(g.code_of, head), _named(g.code_of_name, token)
    short = F.length(token) == 2
    code = F.when(short & by_code.isNotNull(), by_code).when(by_name.isNotNull(), by_name).when(zipped | noisy, by_code)
    how = F.when(short & by_code.isNotNull(), "abbr").when(by_name.isNotNull(), "name").when(zipped, "zip").when(noisy, "abbr")
    return F.struct(code.alias("code"), how.alias("how"))


def phrases(token: Column, cut: Column) -> Column:
    """The token, and where `cut` holds the groups of words at its end and at its start, longest first, without numbers."""
    words = F.filter(F.split(token, " "), lambda w: ~w.rlike("^[0-9]+$"))
    most = F.least(F.size(words) - 1, F.lit(CITY_WORDS))
    sizes = F.when(most >= 1, F.sequence(most, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    groups = F.flatten(F.transform(sizes, lambda n: F.array(F.array_join(F.slice(words, -n, n), " "), F.array_join(F.slice(words, 1, n), " "))))
    every = F.concat(F.array(token), groups, F.array(F.array_join(words, " ")))
    return F.filter(F.array_distinct(F.when(cut, every).otherwise(F.array(token))), lambda p: ~p.rlike("^[0-9]*$"))


LOOKUP = "array<struct<branch:string,rank:int,state:string,key:string,primary:boolean,blocked:boolean>>"


def _within(branch: str, state: Column, exact: Column, loose: Column, blocked: Callable[[Column], Column]) -> Column:
    """Look-ups of whole tokens, then of the phrases of looser ones, in a state."""

    def made(rank: Column, phrase: Column, token: Column) -> Column:
        return F.struct(F.lit(branch).alias("branch"), rank.cast("int").alias("rank"), state.alias("state"), city_key(phrase).alias("key"), F.lit(False).alias("primary"), blocked(token).alias("blocked"))

    whole = F.transform(exact, lambda t, i: made(i, t, t))
    cut = F.transform(loose, lambda t, j: F.transform(phrases(t, F.lit(True)), lambda p, k: made(F.lit(10_000) + j * 100 + k, p, t)))
    return F.concat(whole, F.flatten(cut)).cast(LOOKUP)


def lookups(rows: DataFrame, g: Gazetteer) -> DataFrame:
    """`rows` (variant, home, foreign) with tokens, nickname, fallback (a state's code), sure, and the array `looks`.

    Branch A reads the state first and the city after it; where the second token is a state too, that holds only if its first
    look-up finds a place. Branch B reads the rightmost state, or one glued to the first token, or a name without state.
    """
    none = F.array().cast(LOOKUP)
    every = rows.withColumn("_all", _parts(F.col("variant")))
    signal = F.col("home") | F.exists("_all", lambda t: t.isin(*HOME_NAMES))
    kept = F.filter("_all", lambda t: ~t.isin(*HOME_NAMES) & ~t.rlike("^[0-9]+$"))
    df = every.withColumn("_signal", signal).withColumn("ts", kept).withColumn("marks", F.transform("ts", lambda t: state_mark(t, g)))
    ts, marks, n = F.col("ts"), F.col("marks"), F.size("ts")
    right = F.array_max(F.filter(F.transform(marks, lambda m, i: F.when(m["code"].isNotNull() & (i >= 1), i)), lambda i: i.isNotNull()))
    head = F.regexp_replace(F.get(ts, 0), " [a-z]{2}$", "")
    glued = F.when(F.get(ts, 0).rlike(" [a-z]{2}$"), _named(g.code_of, F.right(F.get(ts, 0), F.lit(2))))
    df = df.withColumn("_first", F.when(n >= 2, F.get(marks, 0)["code"])).withColumn("_second", F.get(marks, 1)["code"]).withColumn("_right", right).withColumn("_glued", glued).withColumn("_head", head)

    def blocked(token: Column) -> Column:
        # "Concord, CA, Canada": another country is named, so the code isn't a state's.
        return F.col("foreign") & F.exists(ts, lambda t: t.isin(*g.foreign) & (t != token)) if g.foreign else F.lit(False)

    i = F.col("_right").cast("int")
    state_first = F.when(F.col("_first").isNotNull(), _within("A", F.col("_first"), F.concat(F.slice(ts, 2, F.greatest(n - 1, F.lit(0))), F.slice(ts, 1, 1)), F.slice(ts, 2, 1), blocked)).otherwise(none)
    exact = F.concat(F.reverse(F.slice(ts, 1, i)), F.slice(ts, i + 2, n), F.slice(ts, i + 1, 1))
    by_right = _within("B", F.get(marks, i)["code"], exact, F.array(F.get(ts, i - 1), F.get(ts, 0)), blocked)
    by_glued = _within("B", F.col("_glued"), F.array("_head"), F.array("_head"), blocked)

    def alone(t: Column, j: Column) -> Column:
        def made(p: Column, k: Column) -> Column:
            return F.struct(F.lit("B").alias("branch"), (j * 100 + k).cast("int").alias("rank"), F.lit("").alias("state"), city_key(p).alias("key"), (p != t).alias("primary"), F.lit(False).alias("blocked"))

        return F.transform(F.filter(phrases(t, t.rlike("^[0-9]")), lambda p: (p == t) | ~p.isin(*GENERIC_WORDS)), made)

    asked = F.when(n == 1, ts).when(F.col("_signal"), F.reverse(ts)).otherwise(F.array().cast("array<string>"))
    cities = F.filter(asked, lambda t: ~t.isin(*g.code_of_name) | t.isin(*CITY_NAMED_AS_STATE))
    stateless = F.when(F.col("foreign"), none).otherwise(F.flatten(F.transform(cities, alone)).cast(LOOKUP))
    other = F.when(i.isNotNull(), by_right).when(F.col("_glued").isNotNull(), by_glued).otherwise(stateless)
    sure = F.col("_first").isNotNull() & F.col("_second").isNull()
    pairs = F.arrays_zip(ts.alias("t"), marks.alias("m"))
    named = lambda x: (x["m"]["how"] == "name") & ~x["t"].isin(*NEVER_A_STATE_ALONE) & (~x["t"].isin(*STATE_WITH_SIGNAL_ONLY) | F.col("_signal"))
    trusted = F.filter(pairs, lambda x: x["m"]["code"].isNotNull() & ((x["m"]["how"] == "zip") | ((x["m"]["how"] == "abbr") & F.col("_signal")) | named(x)))
    abroad = F.col("foreign") | (F.exists(ts, lambda t: t.isin(*g.foreign)) if g.foreign else F.lit(False))
    fallback = F.when(~abroad, F.get(trusted, 0)["m"]["code"])
    nickname = F.get(F.filter(ts, lambda t: t.isin(*g.nicknames)), 0) if g.nicknames else F.lit(None).cast("string")
    looks = F.when(nickname.isNotNull(), none).otherwise(F.concat(state_first, F.when(sure, none).otherwise(other)))
    return df.withColumn("nickname", nickname).withColumn("fallback", fallback).withColumn("sure", sure).withColumn("looks", looks)


def country(entry: Column, g: Gazetteer) -> Column:
    """The code of the country that an entry names, by name or by a code said twice at its end; null if it says none."""
    parts = F.split(entry, f",|{DASH}")
    by_name = F.filter(F.transform(F.transform(parts, plain_words), lambda p: F.when(p.isin(*HOME_NAMES), F.lit(g.home)).otherwise(_named(g.abroad, p))), lambda c: c.isNotNull())
    bare = F.filter(F.transform(parts, lambda p: F.upper(F.trim(p))), lambda p: p != "")
    last = F.get(bare, F.size(bare) - 1)
    twice = (F.size(bare) >= 2) & (last == F.get(bare, F.size(bare) - 2)) & (F.length(last) == 2) & last.isin(*{c.upper() for c in g.countries.values()})
    return F.coalesce(F.get(by_name, 0), F.when(twice, last))


def resolve(entries: DataFrame, g: Gazetteer, entry_col: str = "entry") -> DataFrame:
    """entry, geo, place_id, state, area, lat, lon, workplace, country of each different entry that isn't null.

    geo: city, state, country (nothing but countries or regions), empty (nothing is left), other. Once the entries are dealt to
    their different values no more shuffle is needed where the gazetteer is broadcast, which its size decides.
    """
    entry = F.col("entry")
    stripped, says = workplace_words(F.trim(entry))
    one = entries.select(F.col(entry_col).alias("entry")).where("entry IS NOT NULL").distinct().withColumn("stripped", stripped).withColumn("workplace", says)
    outside = F.exists(_parts(entry, f",|{DASH}"), lambda p: p.isin(*g.foreign)) if g.foreign else F.lit(False)
    one = one.withColumn("home", plain_words(entry).rlike(HOME_SIGNAL)).withColumn("foreign", ~F.col("home") & outside)
    blank = F.regexp_replace("stripped", r"[\s,\-–—/]", "") == ""
    one = one.withColumn("blank", blank).withColumn("variants", F.when(~blank, variants(entry, F.col("stripped"), F.col("home"))))
    looked = lookups(one.select("*", F.posexplode_outer("variants").alias("v", "variant")), g)
    known = index(g)
    known = known if known.limit(BROADCAST + 1).count() > BROADCAST else F.broadcast(known)
    each = looked.select("entry", "stripped", "workplace", "blank", "v", "nickname", "fallback", "sure", F.explode_outer("looks").alias("look"))
    met = each.select("*", *[F.col(f"look.{c}").alias(c) for c in ("branch", "rank", "state", "key", "primary", "blocked")]).drop("look").join(known, ["state", "key", "primary"], "left")
    hit, free = F.col("place").isNotNull(), ~F.coalesce("blocked", F.lit(False))
    best = lambda b: F.min(F.when(hit & free & (F.col("branch") == b), F.struct("rank", "place"))).alias(b)
    carried = [F.first(c).alias(c) for c in ("stripped", "workplace", "blank", "nickname", "fallback", "sure")]
    variant = met.groupBy("entry", "v").agg(*carried, F.max(hit & (F.col("branch") == "A") & (F.col("rank") == 0)).alias("probe"), best("A"), best("B"))
    found = F.when(F.col("sure") | F.coalesce("probe", F.lit(False)), F.col("A.place")).otherwise(F.col("B.place"))
    area_of = _named({k: v[0] for k, v in g.nicknames.items()}, F.col("nickname"))
    state_of = _named({k: v[1] for k, v in g.nicknames.items()}, F.col("nickname"))
    kind = g.places.schema["place_id"].dataType
    by_name = F.struct(F.lit(None).cast(kind).alias("place_id"), state_of.alias("state"), area_of.alias("area"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))
    spot = F.when(F.col("nickname").isNotNull(), by_name).otherwise(found)
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("v", c)))[c].alias(c)
    out = variant.withColumn("spot", spot).groupBy("entry").agg(*[F.first(c).alias(c) for c in ("stripped", "workplace", "blank")], first("spot"), first("fallback"))
    left = F.filter(_parts(F.col("stripped")), lambda t: ~t.isin(*HOME_NAMES))
    bare_state = (F.size(left) == 1) & F.get(left, 0).isin(*g.code_of_name)
    # "Remote - New York": with a word for remote, a name of both a state and a city means the state.
    as_state = F.col("spot").isNotNull() & (F.col("workplace") == "remote") & bare_state
    rest = _parts(F.regexp_replace("stripped", r"\([^)]*\)", " "))
    only_countries = _all(rest, lambda t: t.isin(*HOME_NAMES, *g.foreign, *REGION_WORDS))
    city = F.col("spot").isNotNull() & ~F.coalesce(as_state, F.lit(False))
    geo = F.when(F.col("blank"), "empty").when(city, "city").when(F.col("spot").isNotNull() | F.col("fallback").isNotNull(), "state").when(only_countries, "country").otherwise("other")
    state = F.coalesce(F.col("spot.state"), F.col("fallback"))
    shown = lambda c: F.when(city, F.col(f"spot.{c}")).alias(c)
    return out.select("entry", geo.alias("geo"), shown("place_id"), state.alias("state"), shown("area"), shown("lat"), shown("lon"), "workplace", F.when(geo.isin("city", "state"), F.lit(g.home)).otherwise(country(entry, g)).alias("country"))


def filed(jobs: DataFrame, g: Gazetteer, id_col: str, locations_col: str) -> DataFrame:
    """id, areas, points, country of each posting: codes of its entries' areas and states, and their places, each once, in order.

    The home country wins wherever any entry is in it, else the first entry that names a country decides. An entry that very
    many postings share is one row on the other side of the join, which adaptive execution splits or broadcasts.
    """
    rows = jobs.select(F.col(id_col).alias("id"), F.posexplode(F.coalesce(locations_col, F.array())).alias("pos", "entry"))
    known = resolve(rows, g)
    met = rows.join(known, "entry")
    item = F.struct("pos", "area", "state", F.struct("lat", "lon").alias("point"), "country")
    lists = met.groupBy("id").agg(F.sort_array(F.collect_list(item)).alias("xs"))
    codes = F.array_distinct(F.filter(F.flatten(F.transform("xs", lambda x: F.array(x["area"], x["state"]))), lambda c: c.isNotNull()))
    points = F.array_distinct(F.filter(F.transform("xs", lambda x: x["point"]), lambda p: p["lat"].isNotNull()))
    named = F.filter(F.transform("xs", lambda x: x["country"]), lambda c: c.isNotNull())
    told = lists.select("id", codes.alias("areas"), points.alias("points"), F.when(F.array_contains(named, g.home), F.lit(g.home)).otherwise(F.get(named, 0)).alias("country"))
    return jobs.select(F.col(id_col).alias("id")).distinct().join(told, "id", "left").select("id", F.coalesce("areas", F.array().cast("array<string>")).alias("areas"), F.coalesce("points", F.array().cast("array<struct<lat:double,lon:double>>")).alias("points"), "country")
