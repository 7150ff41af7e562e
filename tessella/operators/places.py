"""Joins by distance: places near points, the nearest place, areas around a place, and the commonest places of a group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo

# Fixed value: beyond so many miles no place is a good guess.
NEAREST_MOST = 100.0


def _bands(miles: float) -> tuple[int, float]:
    """(number of latitude bands, height of one in degrees); a band is at least as high as the radius."""
    n = max(1, int(180 / (miles / 69.0)))
    return n, 180 / n


def _width(band: Column, height: float, miles: float) -> Column:
    """(number of cells of a band) such that a cell is as wide as the radius anywhere in the band and beside it."""
    far = F.greatest(F.abs(band * height - 90), F.abs((band + 1) * height - 90)) + height
    ratio = F.when(far < 90, math.sin(miles / 2 / geo.RADIUS) / F.cos(F.radians(far)))
    # Near the poles, where any longitude is near, a band is one cell.
    return F.when(ratio < 1, F.greatest(F.lit(1), F.floor(360 / F.degrees(2 * F.asin(ratio))))).otherwise(1).cast("int")


def _cell(lon: Column, cells: Column) -> Column:
    return F.pmod(F.floor((lon + 180) / 360 * cells).cast("int"), cells)


def within(points: DataFrame, places: DataFrame, miles: float) -> DataFrame:
    """All columns of both and `distance`, for each point (lat, lon) and place (place_lat, place_lon) within `miles`.

    Both meet in the cells of a grid: a place is in one cell, a point looks into the nine around it, so no row
    meets all of the other side, and cells meet across the date line. Points without coordinates are near nothing.
    """
    n, height = _bands(miles)
    band = lambda lat: F.least(F.greatest(F.floor((lat + 90) / height).cast("int"), F.lit(0)), F.lit(n - 1))
    home = places.withColumn("_band", band(F.col("place_lat")))
    home = home.withColumn("_cell", _cell(F.col("place_lon"), _width(F.col("_band"), height, miles)))
    near_bands = F.filter(F.array(*[band(F.col("lat")) + d for d in (-1, 0, 1)]), lambda b: (b >= 0) & (b < n))
    look = points.where("lat IS NOT NULL AND lon IS NOT NULL").withColumn("_band", F.explode(F.array_distinct(near_bands)))
    cells = _width(F.col("_band"), height, miles)
    own = _cell(F.col("lon"), cells)
    look = look.withColumn("_cell", F.explode(F.array_distinct(F.array(*[F.pmod(own + d, cells) for d in (-1, 0, 1)]))))
    both = look.join(home, ["_band", "_cell"]).drop("_band", "_cell")
    far = both.withColumn("distance", geo.haversine(F.col("lat"), F.col("lon"), F.col("place_lat"), F.col("place_lon")))
    return far.where(F.col("distance") <= miles)


def _spots(points: DataFrame, places: DataFrame, miles: float) -> DataFrame:
    """(lat, lon, place_lat, place_lon, distance): `within` between the different spots of both sides.

    Very many points and places lie on the same spots, so the work grows with the spots; what lies on them is joined back on equal keys.
    """
    here = _placed(points, ("lat", "lon")).select("lat", "lon").distinct()
    there = _placed(places, ("place_lat", "place_lon")).select("place_lat", "place_lon").distinct()
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return within(here.repartition(tasks, "lat", "lon"), there, miles)


def _placed(df: DataFrame, columns: tuple[str, str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def nearest(points: DataFrame, places: DataFrame, id_col: str, miles: float = NEAREST_MOST, least_people: int = 0) -> DataFrame:
    """(id, place, distance) of the nearest place with at least so many people; points without one within `miles` are left out."""
    big = _placed(places.where(F.col("population") >= least_people), ("place_lat", "place_lon"))
    # Of the places on one spot the smallest is the nearest; they are as far from anywhere.
    first = big.groupBy("place_lat", "place_lon").agg(F.min("place").alias("place"))
    at = F.struct("distance", "place")
    best = _spots(points, big, miles).join(first, ["place_lat", "place_lon"]).groupBy("lat", "lon").agg(F.min(at).alias("b"))
    found = _placed(points.select(id_col, "lat", "lon"), ("lat", "lon")).join(best, ["lat", "lon"])
    only = found.groupBy(id_col).agg(F.min("b").alias("b"))
    return only.select(id_col, F.col("b.place").alias("place"), F.col("b.distance").alias("distance"))


def areas_around(points: DataFrame, places: DataFrame, id_col: str, miles: float) -> DataFrame:
    """(id, area, rank): the areas of the places within `miles` of each point, its own first, then by distance.

    points: id, lat, lon, own_area. places: place_lat, place_lon, area.
    """
    named = _placed(places.where("area IS NOT NULL"), ("place_lat", "place_lon"))
    on = named.select("place_lat", "place_lon", "area").distinct()
    # Areas are looked up for each pair of spots, and only the nearest spot of an area is kept before points are joined.
    around = _spots(points, named, miles).join(on, ["place_lat", "place_lon"]).groupBy("lat", "lon", "area").agg(F.min("distance").alias("distance"))
    found = _placed(points.select(id_col, "lat", "lon"), ("lat", "lon")).join(around, ["lat", "lon"]).select(id_col, "area", "distance")
    all_ = found.union(points.select(id_col, F.col("own_area").alias("area"), F.lit(-1.0).alias("distance")))
    least = all_.where("area IS NOT NULL").groupBy(id_col, "area").agg(F.min("distance").alias("distance"))
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy("distance", "area"))
    return least.select(id_col, "area", rank.alias("rank"))


def top_places(jobs: DataFrame, by: str, places: str, k: int = 15) -> DataFrame:
    """(by, rank, place, n): the k commonest places of each group, each counted once a job."""
    rows = jobs.select(by, F.explode(F.array_distinct(places)).alias("place"))
    counts = rows.groupBy(by, "place").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "place"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k).select(by, "rank", "place", "n")
