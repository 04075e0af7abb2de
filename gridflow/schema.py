"""Grids and tables of the data model.

Cells are numbered from 1, the first index runs fastest. Masks are 0 for active
and 1 for masked points. Angles are degrees; areas are on the unit sphere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.batch import running


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def regular_grid(spark: SparkSession, nx: int, ny: int) -> DataFrame:
    """(cell, i, j, lon, lat, lon_lo, lon_hi, lat_lo, lat_hi, area, mask) of a regular global grid."""
    cell = F.col("cell")
    i, j = F.col("i"), F.col("j")
    out = spark.range(1, nx * ny + 1).select(F.col("id").alias("cell"))
    out = out.withColumns({"j": ((cell - 1) / nx).cast("long") + 1}).withColumn("i", cell - (F.col("j") - 1) * nx)
    out = out.withColumns(
        {
            "lon": (i - 0.5) * (360.0 / nx),
            "lat": (j - 0.5) * (180.0 / ny) - 90.0,
            "lon_lo": (i - 1) * (360.0 / nx),
            "lon_hi": i * (360.0 / nx),
            "lat_lo": (j - 1) * (180.0 / ny) - 90.0,
            "lat_hi": j * (180.0 / ny) - 90.0,
        }
    )
    area = F.radians(F.col("lon_hi") - F.col("lon_lo")) * (F.sin(F.radians("lat_hi")) - F.sin(F.radians("lat_lo")))
    return out.withColumns({"area": area, "mask": F.when(cell % 7 == 0, 1).otherwise(0)})


def with_corners(grid: DataFrame) -> DataFrame:
    """A regular grid with the corners of its cells, clon and clat, anticlockwise from the south-west."""
    return grid.withColumns({"clon": F.array("lon_lo", "lon_hi", "lon_hi", "lon_lo"), "clat": F.array("lat_lo", "lat_lo", "lat_hi", "lat_hi")})


def turned(lon: Column, lat: Column, tilt: float) -> tuple[Column, Column]:
    """(lon, lat) after the sphere is turned by ``tilt`` degrees about the axis through longitudes 90 and 270 on the equator."""
    a = math.radians(tilt)
    x, y, z = F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))
    new_x, new_z = x * math.cos(a) + z * math.sin(a), z * math.cos(a) - x * math.sin(a)
    return F.pmod(F.degrees(F.atan2(y, new_x)), F.lit(360.0)), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), new_z))))


def rotated_grid(spark: SparkSession, nx: int, ny: int, tilt: float = 30.0) -> DataFrame:
    """(cell, i, j, lon, lat, clon, clat, mask): a regular grid whose poles are turned away, so that rows and columns bend."""
    base = regular_grid(spark, nx, ny)
    lon, lat = turned(F.col("lon"), F.col("lat"), tilt)
    corners = [turned(F.col(x), F.col(y), tilt) for x, y in (("lon_lo", "lat_lo"), ("lon_hi", "lat_lo"), ("lon_hi", "lat_hi"), ("lon_lo", "lat_hi"))]
    return base.select("cell", "i", "j", lon.alias("lon"), lat.alias("lat"), F.array(*[c[0] for c in corners]).alias("clon"), F.array(*[c[1] for c in corners]).alias("clat"), "mask")


def product_grid(axes: dict[str, DataFrame]) -> DataFrame:
    """Cartesian product of coordinate axes, the first axis slowest, numbered from 1 as ``cell``.

    Each axis has one column of its name, with values that differ; they are numbered and joined to the cells by arithmetic.
    """
    counts = [axis.count() for axis in axes.values()]
    total = math.prod(counts)
    spark = next(iter(axes.values())).sparkSession
    out = spark.range(1, total + 1).select(F.col("id").alias("cell"))
    rest = total
    for (name, axis), n in zip(axes.items(), counts, strict=True):
        rest //= max(n, 1)
        numbered = running(axis.select(name), [F.col(name)], F.lit(1), "__at")
        out = out.withColumn("__at", F.floor((F.col("cell") - 1) / rest) % n + 1).join(numbered, "__at").drop("__at")
    return out


def analytic_field(lon, lat):
    """The smooth test field of the interpolation test: 2 - cos(pi acos(cos lat cos lon) / (1.2 pi))."""
    c = F.cos(F.radians(lat)) * F.cos(F.radians(lon))
    return 2 - F.cos(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))) / 1.2)
