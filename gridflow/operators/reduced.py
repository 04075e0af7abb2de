"""Weights from reduced grids: circles of latitude with their own numbers of points, evenly spaced on each circle.

Points are (cell, circle, lon, lat, mask), circles are numbered from south to north and cells along a circle, eastwards.
A target finds its circles by an equi-join on bins of latitude, and its points on a circle by arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import cut
from .curvilinear import _four_nearest
from .weights import bins_for, with_nearest_unmasked


def octahedral_grid(spark: SparkSession, ny: int) -> DataFrame:
    """(cell, circle, k, lon, lat, mask): ny circles with 20 points next to a pole and 4 more on each circle towards the equator."""
    rows = spark.range(1, ny + 1).select(F.col("id").alias("circle"), (4 * F.least(F.col("id"), ny + 1 - F.col("id")) + 16).alias("n"))
    # the points of the circles before: 4 (1 + ... + m) + 16 m up to the middle, the same from the other end after it
    m = F.col("circle") - 1
    half, up = ny // 2, lambda x: 2 * x * (x + 1) + 16 * x
    total = up(half) * 2 + (ny % 2) * (4 * (half + 1) + 16)
    before = F.when(m <= half, up(m)).otherwise(total - up(ny - m))
    points = rows.withColumn("before", before.cast("long")).select("circle", "n", "before", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k"))
    cell = F.col("before") + F.col("k")
    return points.select(
        cell.alias("cell"), "circle", "k", ((F.col("k") - 1) * 360.0 / F.col("n")).alias("lon"), ((F.col("circle") - 0.5) * 180.0 / ny - 90).alias("lat"), F.when(cell % 7 == 0, 1).otherwise(0).alias("mask")
    )


def circles(grid: DataFrame) -> DataFrame:
    """(circle, lat, n, first, lon0): a row for each circle."""
    return grid.groupBy("circle").agg(F.min("lat").alias("lat"), F.count("*").alias("n"), F.min("cell").alias("first"), F.min_by("lon", "cell").alias("lon0"))


def stencil(grid: DataFrame, dst: DataFrame, half: int, width: float = 1.0) -> DataFrame:
    """(dst, lon, lat, row, circle_lat, column, src, x): the 2 half circles around each target, with the 2 half points around it on each.

    ``row`` and ``column`` count from 1, ``x`` is the point's place along its circle in steps, with the target at a place
    between 0 and 1 (``t``). Targets that do not have all circles are left out.
    """
    rings = circles(grid)
    order = Window.orderBy("circle")  # a row for each circle: thousands at most, whatever the number of points
    gap = rings.select("circle", "lat", F.lead("lat").over(order).alias("north")).where("north IS NOT NULL")
    lo, hi = F.floor((F.col("lat") + 90) / width), F.floor((F.col("north") + 90) / width)
    gap = gap.select("circle", F.col("lat").alias("south"), "north", F.explode(F.sequence(lo, hi)).alias("bin"))
    at = dst.select(F.col("cell").alias("dst"), F.pmod("lon", F.lit(360.0)).alias("lon"), "lat", F.floor((F.col("lat") + 90) / width).alias("bin"))
    # a target on a circle is between it and the next
    placed = at.join(gap, "bin").where((F.col("lat") >= F.col("south")) & (F.col("lat") < F.col("north"))).drop("bin", "south", "north")
    rows = placed.select("dst", "lon", "lat", F.posexplode(F.sequence(F.col("circle") - half + 1, F.col("circle") + half)).alias("row", "circle"))
    met = rows.join(rings.withColumnRenamed("lat", "circle_lat"), "circle")
    met = met.withColumn("have", F.count("*").over(Window.partitionBy("dst"))).where(F.col("have") == 2 * half)
    u = F.pmod(F.col("lon") - F.col("lon0"), F.lit(360.0)) * F.col("n") / 360.0
    met = met.withColumn("u", u).withColumn("west", F.floor("u"))
    met = met.select("dst", "lon", "lat", (F.col("row") + 1).alias("row"), "circle_lat", "n", "first", (F.col("u") - F.col("west")).alias("t"), "west", F.posexplode(F.sequence(F.lit(1 - half), F.lit(half))).alias("column", "x"))
    src = F.col("first") + F.pmod(F.col("west") + F.col("x"), F.col("n"))
    return met.select("dst", "lon", "lat", "row", "circle_lat", (F.col("column") + 1).alias("column"), src.cast("long").alias("src"), F.col("x").cast("double").alias("x"), "t")


def _share(places: str, mine: Column, at: Column) -> Column:
    """The weight of the point at ``mine`` in the polynomial through the points at ``places`` (an array), taken at ``at``."""
    return F.aggregate(F.filter(places, lambda x: x != mine), F.lit(1.0), lambda w, x: w * (at - x) / (mine - x))


def _weights(grid: DataFrame, dst: DataFrame, half: int, whole: bool) -> DataFrame:
    """Polynomials through the unmasked points along each circle, and through the circles that have any.

    ``whole``: a target with a masked point has no weights.
    """
    points = stencil(grid, dst, half).join(grid.select(F.col("cell").alias("src"), "mask"), "src")
    if whole:
        points = points.withColumn("hidden", F.max("mask").over(Window.partitionBy("dst"))).where("hidden = 0").drop("hidden")
    points = points.where("mask = 0")
    on_circle = Window.partitionBy("dst", "row")
    points = points.withColumn("xs", F.collect_list("x").over(on_circle)).withColumn("w", _share("xs", F.col("x"), F.col("t")))
    # the circles that are left, each once: at most 2 half
    points = points.withColumn("ys", F.collect_set("circle_lat").over(Window.partitionBy("dst")))
    return points.select("dst", "src", (F.col("w") * _share("ys", F.col("circle_lat"), F.col("lat"))).alias("w"))


def _with_rest(links: DataFrame, grid: DataFrame, active: DataFrame) -> DataFrame:
    links, bins = cut(links), bins_for(grid)
    rest = cut(active.join(links.select(F.col("dst").alias("cell")).distinct(), "cell", "left_anti"))
    return links.unionByName(with_nearest_unmasked(_four_nearest(grid, rest, bins), grid, rest, bins))


def bilinear(grid: DataFrame, dst: DataFrame) -> DataFrame:
    """(dst, src, w) from two points on each of the two circles around a target: linear along the circles and across.

    Where a point is masked, or beyond the outermost circles, the unmasked of the four nearest points share by inverse
    distance; where these are all masked, the nearest unmasked point has it all.
    """
    active = dst.where("mask = 0")
    return _with_rest(_weights(grid, active, 1, True), grid, active)


def bicubic(grid: DataFrame, dst: DataFrame) -> DataFrame:
    """(dst, src, w) from four points on each of four circles: cubic, or parabolic, linear or constant by how many are unmasked.

    Targets without all four circles, or without any unmasked point on them, are done as by :func:`bilinear`.
    """
    active = dst.where("mask = 0")
    links = cut(_weights(grid, active, 2, False))
    rest = cut(active.join(links.select(F.col("dst").alias("cell")).distinct(), "cell", "left_anti"))
    return links.unionByName(bilinear(grid, rest))

