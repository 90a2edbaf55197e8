"""Nearest places by a grid join, and saved places that override them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import grid, rough_km, squared_degrees
from ..schema import FAR_DEGREES, FAR_SQUARED, NEAR_DEGREES, NEAREST_FETCH


def box_pairs(points: DataFrame, places: DataFrame, *, lat: str, lon: str, delta: float = FAR_DEGREES, plat: str = "latitude", plon: str = "longitude") -> DataFrame:
    """Points and all places in a box of ``delta`` degrees around each: an equi-join on grid cells, places standing in nine."""
    near = [F.lit(i) for i in (-1, 0, 1)]
    spread = places.withColumn("_cy", F.explode(F.transform(F.array(*near), lambda i: grid(F.col(plat), delta) + i)))
    spread = spread.withColumn("_cx", F.explode(F.transform(F.array(*near), lambda i: grid(F.col(plon), delta) + i)))
    celled = points.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumn("_cy", grid(F.col(lat), delta)).withColumn("_cx", grid(F.col(lon), delta))
    inside = F.col(plat).between(F.col(lat) - delta, F.col(lat) + delta) & F.col(plon).between(F.col(lon) - delta, F.col(lon) + delta)
    return celled.join(spread, ["_cy", "_cx"]).filter(inside).drop("_cy", "_cx").withColumn("dist_sq", squared_degrees(F.col(plat), F.col(plon), F.col(lat), F.col(lon)))


#: Cells of the search, each level's half as wide as those of the one before.
LEVELS = 13


def _cells(df: DataFrame, k: Column, width: float, lat: str, lon: str) -> DataFrame:
    """Rows with level ``_k`` and the cell there, level 0 having cells of ``width``."""
    step = F.lit(width) / F.pow(F.lit(2.0), F.col("_k"))
    return df.withColumn("_k", k).withColumn("_cy", grid(F.col(lat), step)).withColumn("_cx", grid(F.col(lon), step))


def near_pairs(points: DataFrame, places: DataFrame, *, key: str, lat: str, lon: str, delta: float = FAR_DEGREES, fine: float = NEAR_DEGREES, fetch: int = NEAREST_FETCH, plat: str = "latitude", plon: str = "longitude", ties: list[str] | None = None) -> DataFrame:
    """Pairs enough for the nearest ``fetch`` places of each point (of distinct ``key``) within the box of ``delta``, and within that of ``fine``.

    A point searches cells twice as wide as the smallest around it that has ``fetch`` places: all of those are within that
    cell's diagonal, so nothing farther can be among the nearest.  So few meet however dense the places are; only where no cell
    has as many, all of the box of ``delta`` does.  Of places at one spot only the first ``fetch`` by ``ties`` count, if given.
    """
    if ties:
        spot = Window.partitionBy(plat, plon).orderBy(*ties)
        places = places.select("*", F.row_number().over(spot).alias("_spot")).filter(F.col("_spot") <= fetch).drop("_spot")
    located = points.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    levels, top, cell = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))), delta * 1.001, ["_k", "_cy", "_cx"]  # a box as wide as a cell would touch four by rounding
    full = _cells(places.select(plat, plon), levels, top / 2, plat, plon).groupBy(*cell).count().filter(F.col("count") >= fetch).select(*cell)
    level = _cells(located.select(key, lat, lon), levels, top / 2, lat, lon).join(full, cell, "left_semi").groupBy(key).agg(F.max("_k").alias("_level"))
    asking = _cells(located.join(level, key, "left"), F.coalesce("_level", F.lit(0)), top, lat, lon)
    near = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    around = asking.select(*cell).distinct().withColumn("_y", F.explode(F.transform(near, lambda i: F.col("_cy") + i))).withColumn("_x", F.explode(F.transform(near, lambda i: F.col("_cx") + i)))
    standing = _cells(places, levels, top, plat, plon).withColumnsRenamed({"_cy": "_y", "_cx": "_x"}).join(around, ["_k", "_y", "_x"])
    half = F.lit(top / 2) / F.pow(F.lit(2.0), F.col("_level"))
    box = lambda d: F.col(plat).between(F.col(lat) - d, F.col(lat) + d) & F.col(plon).between(F.col(lon) - d, F.col(lon) + d)
    met = asking.join(standing, cell).withColumn("dist_sq", squared_degrees(F.col(plat), F.col(plon), F.col(lat), F.col(lon)))
    within = F.when(F.col("_level").isNull(), box(delta)).otherwise((F.col("dist_sq") <= 2.000001 * half * half) | ((2 * half * half > fine * fine) & box(1.000001 * fine)))
    return met.filter(within).select(*points.columns, *places.columns, "dist_sq")


def candidates(pairs: DataFrame, *, key: str, limit: int, marks: str, ties: list[str], fetch: int = NEAREST_FETCH) -> DataFrame:
    """Of each key the nearest ``fetch`` places, then those within reach, plainly spelled ones first, at most ``limit``."""
    first = Window.partitionBy(key).orderBy("dist_sq", *ties)
    reach = pairs.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= fetch).filter(F.col("dist_sq") <= FAR_SQUARED)
    again = Window.partitionBy(key).orderBy(marks, "dist_sq", "_r")
    return reach.withColumn("rank", F.row_number().over(again)).filter(F.col("rank") <= limit).drop("_r").withColumn("dist_km", rough_km(F.col("dist_sq")))


def fold_anchors(df: DataFrame, anchors: list[tuple[str, float, float]], *, lat: str, lon: str, place: str, out: str = "at_saved_place") -> DataFrame:
    """The first saved place (folder, lat, lon) within reach names a located row.  Anchors are settings, few by nature; rows
    that no geocoding found stay as they are."""
    hit = F.lit(None).cast("string")
    for name, y, x in reversed(anchors):
        hit = F.when(squared_degrees(F.col(lat), F.col(lon), F.lit(y), F.lit(x)) <= FAR_SQUARED, F.lit(name)).otherwise(hit)
    hit = F.when(F.coalesce(F.col(place), F.lit("")) != "", hit)
    return df.withColumn("_hit", hit).withColumn(out, F.col("_hit").isNotNull()).withColumn(place, F.coalesce("_hit", place)).drop("_hit")
