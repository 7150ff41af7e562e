"""Queries over places that free text names, with the SQL that checks them.

Parts are places, nations outside one region are states, those inside are other countries, and orders name places in several ways.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import gates, resolver
from ..sources.tables import table
from .catalogue import query

#: Places, and what orders say of them.
GAZETTEER = """
states AS (SELECT n_nationkey, n_name, chr(65 + n_nationkey // 5) || chr(65 + n_nationkey % 5) AS code, n_regionkey = 3 AS abroad FROM nation),
spots AS (SELECT p_partkey AS place_id, p_name AS name, code AS state, CASE WHEN p_partkey % 7 <> 0 THEN 'm' || p_partkey % 40 END AS area,
    CASE WHEN p_partkey % 97 = 0 THEN 10000000 ELSE p_size * 1000 END AS population, p_partkey % 49 + 0.5 AS lat, -(p_partkey % 100) - 0.25 AS lon
  FROM part JOIN states ON n_nationkey = p_partkey % 25 WHERE NOT abroad),
said AS (SELECT o_orderkey, o_custkey, p_name AS name, code, abroad, CASE WHEN abroad THEN 6 ELSE o_orderkey % 6 END AS form,
    CASE WHEN abroad THEN p_name || ', ' || n_name ELSE ([p_name || ', ' || code, p_name || ', ' || n_name, 'USA, ' || code || ', ' || p_name, 'Remote - ' || n_name, '12 ' || p_name || ', ' || code || ' 55403', p_name])[o_orderkey % 6 + 1] END AS entry
  FROM orders JOIN part ON p_partkey = o_custkey JOIN states ON n_nationkey = o_orderkey % 25),
inside AS (SELECT state, name, arg_min(spots, (-population, place_id)) AS spot FROM spots GROUP BY 1, 2),
districts AS (SELECT name, arg_min(spots, (-population, place_id)) AS spot, max(population) AS most FROM spots GROUP BY name, coalesce(area, 'rural:' || state)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY most DESC, spot.place_id) AS r FROM districts),
alone AS (SELECT a.name, a.spot FROM ranked a LEFT JOIN ranked b ON b.name = a.name AND b.r = 2 WHERE a.r = 1 AND a.most >= 5 * greatest(coalesce(b.most, 0), 1)),
resolved AS (
  SELECT DISTINCT said.entry, CASE WHEN spot IS NOT NULL THEN 'city' WHEN form IN (1, 2, 3, 4) THEN 'state' ELSE 'other' END AS geo, spot.place_id AS place_id,
    CASE WHEN spot IS NOT NULL THEN spot.state WHEN form IN (1, 2, 3, 4) THEN code END AS state, spot.area AS area, spot.lat AS lat, spot.lon AS lon,
    CASE WHEN form = 3 THEN 'remote' END AS workplace, CASE WHEN spot IS NOT NULL OR form IN (1, 2, 3, 4) THEN 'US' WHEN abroad THEN code END AS country
  FROM (SELECT s.*, CASE WHEN form = 5 THEN a.spot WHEN form NOT IN (3, 6) THEN i.spot END AS spot
    FROM said s LEFT JOIN inside i ON i.state = s.code AND i.name = s.name LEFT JOIN alone a ON a.name = s.name) said)"""


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    code = F.concat(F.chr(65 + F.floor(k / 5)), F.chr(65 + k % 5))
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", code.alias("code"), (F.col("n_regionkey") == 3).alias("abroad"))


def gazetteer(spark: SparkSession, sf_dir: str) -> resolver.Gazetteer:
    states, k = _states(spark, sf_dir), F.col("p_partkey")
    parts = table(spark, sf_dir, "part").join(states.where("NOT abroad"), F.col("n_nationkey") == k % 25)
    population = F.when(k % 97 == 0, 10_000_000).otherwise(F.col("p_size") * 1000).cast("long")
    places = parts.select(k.alias("place_id"), F.col("p_name").alias("name"), F.col("code").alias("state"), F.when(k % 7 != 0, F.concat(F.lit("m"), (k % 40).cast("string"))).alias("area"), population.alias("population"), (k % 49 + 0.5).alias("lat"), (-(k % 100) - 0.25).alias("lon"), F.array().cast("array<string>").alias("aliases"))
    known = states.collect()  # the nations
    return resolver.Gazetteer(places, {r.code: r.n_name for r in known if not r.abroad}, {r.n_name: r.code for r in known if r.abroad})


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, o_custkey, entry: the places of orders as people write them."""
    orders, parts = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    rows = orders.join(parts, F.col("p_partkey") == F.col("o_custkey")).join(_states(spark, sf_dir), F.col("n_nationkey") == F.col("o_orderkey") % 25)
    name, code, nation = F.col("p_name"), F.col("code"), F.col("n_name")
    forms = F.array(F.concat_ws(", ", name, code), F.concat_ws(", ", name, nation), F.concat_ws(", ", F.lit("USA"), code, name), F.concat(F.lit("Remote - "), nation), F.concat(F.lit("12 "), name, F.lit(", "), code, F.lit(" 55403")), name)
    return rows.select("o_orderkey", "o_custkey", F.when(F.col("abroad"), F.concat_ws(", ", name, nation)).otherwise(F.get(forms, (F.col("o_orderkey") % 6).cast("int"))).alias("entry"))


@query("resolved_entries", f"WITH {GAZETTEER} SELECT entry, geo, place_id, state, area, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, workplace, country FROM resolved")
def resolved_entries(spark, sf_dir):
    out = resolver.resolve(said(spark, sf_dir), gazetteer(spark, sf_dir))
    return out.withColumn("lat", F.col("lat").cast("double")).withColumn("lon", F.col("lon").cast("double"))


@query("areas_of_postings", f"""
WITH {GAZETTEER},
found AS (SELECT o_custkey AS id, o_orderkey AS pos, area, state, country FROM said JOIN resolved USING (entry)),
codes AS (SELECT id, code, min((pos, kind)) AS place_in_list FROM (SELECT id, pos, 0 AS kind, area AS code FROM found UNION ALL SELECT id, pos, 1, state FROM found) WHERE code IS NOT NULL GROUP BY 1, 2),
lists AS (SELECT id, string_agg(code, ',' ORDER BY place_in_list) AS areas FROM codes GROUP BY 1),
countries AS (SELECT id, CASE WHEN bool_or(country = 'US') THEN 'US' ELSE arg_min(country, pos) FILTER (country IS NOT NULL) END AS country FROM found GROUP BY 1)
SELECT id, coalesce(areas, '') AS areas, country FROM (SELECT DISTINCT o_custkey AS id FROM orders) LEFT JOIN lists USING (id) LEFT JOIN countries USING (id)""")
def areas_of_postings(spark, sf_dir):
    jobs = said(spark, sf_dir).groupBy(F.col("o_custkey").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "entry"))), lambda x: x["entry"]).alias("locations"))
    return resolver.filed(jobs, gazetteer(spark, sf_dir), "id", "locations").select("id", F.array_join("areas", ",").alias("areas"), "country")


_NEAR = f"2 * {geo.RADIUS} * asin(sqrt(least(1.0, pow(sin(radians(40.5 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(40.5)) * pow(sin(radians(-40.25 - lon) / 2), 2))))"


@query("located_near_a_city", f"""
WITH {GAZETTEER}
SELECT o_custkey AS id, min(CASE WHEN {_NEAR} < 0.5 THEN 0 WHEN {_NEAR} <= 5 THEN 1 WHEN {_NEAR} <= 15 THEN 2 ELSE 3 END) AS band
FROM said JOIN resolved USING (entry) WHERE lat IS NOT NULL AND {_NEAR} <= 600 GROUP BY 1""")
def located_near_a_city(spark, sf_dir):
    jobs = said(spark, sf_dir).groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set("entry").alias("locations"))
    points = resolver.filed(jobs, gazetteer(spark, sf_dir), "id", "locations")
    typed = {"some city, aa": (40.5, -40.25)}
    near = points.where(gates.located("Some City, AA", {}, {}, cities=typed, miles=600.0))
    return near.select("id", geo.band(geo.nearest_point(F.col("points"), *map(F.lit, typed["some city, aa"]))).alias("band"))
