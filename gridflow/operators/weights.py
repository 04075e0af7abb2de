"""Builders of interpolation weights as distributed queries.

Neighbour and overlap searches bin one side by latitude and longitude and join on the bin, so
no pair outside neighbouring bins is formed. The k-nearest search takes the targets
whose k-th distance reaches past them down a tree of bins, so it is exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut
from .batch import running

EPSILON = 2.220446049250313e-16
#: Source points that every task may hold, and pairs of targets and bins that a task of a search forms, or so.
FEW, PAIRS = 4096, 250_000
#: Radians by which a distance may be off: acos is good to 1e-7 or so.
SLACK = 1e-7


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Angle in radians between points in degrees, the argument of acos clamped."""
    a, b = F.radians(lat1), F.radians(lat2)
    c = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * (F.cos(F.radians(lon1)) * F.cos(F.radians(lon2)) + F.sin(F.radians(lon1)) * F.sin(F.radians(lon2)))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def bins_for(points: DataFrame) -> int:
    """Latitude bands for as many points, twice as many sectors of longitude go with them: about one point a bin on an even grid."""
    return max(1, math.ceil(math.sqrt(points.count() / 2)))


def nearest_k(src: DataFrame, dst: DataFrame, k: int, bins: int | None = None) -> DataFrame:
    """(dst, src, d, rank) of the k nearest source points of each target; ties (to 1e-9) go to the lower address.

    Distance is at least the difference in latitude, and at least the distance to the meridian that bounds the
    sectors looked at. A target looks at its own band and those beside it, and as far in longitude, all around near the
    poles; if its k-th distance is more than what is left to the edges, it goes down a tree of bins (:func:`_from_above`).
    """
    out = dst.select(F.col("cell").alias("dst"), F.lit(None).cast("long").alias("src"), F.lit(None).cast("double").alias("d"), F.lit(None).cast("int").alias("rank")).limit(0)
    if not (n := dst.count()):
        return out
    bins, few = bins or bins_for(src), src.count() <= FEW
    height, sectors = 180.0 / bins, 2 * bins

    def of(lat: Column) -> Column:
        return F.least(F.floor((lat + 90) / height), F.lit(bins - 1)).cast("int")

    def sector(lon: Column) -> Column:
        return F.least(F.floor(F.pmod(lon, F.lit(360.0)) / height), F.lit(sectors - 1)).cast("int")

    s = src.select(F.col("cell").alias("src"), F.col("lon").alias("slon"), F.col("lat").alias("slat"), of(F.col("lat")).alias("bin"), sector(F.col("lon")).alias("sector"))
    todo = dst.select(F.col("cell").alias("dst"), "lon", "lat", of(F.col("lat")).alias("home"), sector(F.col("lon")).alias("east"))
    low, high = F.greatest(F.col("home") - 1, F.lit(0)), F.least(F.col("home") + 1, F.lit(bins - 1))
    wide = F.least(F.ceil(1 / F.greatest(F.cos(F.radians("lat")), F.lit(1e-6))), F.lit(bins)).cast("int")
    turn = F.when(2 * F.col("wide") + 1 >= sectors, F.sequence(F.lit(0), F.lit(sectors - 1))).otherwise(
        F.transform(F.sequence(F.col("east") - F.col("wide"), F.col("east") + F.col("wide")), lambda x: F.pmod(x, F.lit(sectors)))
    )
    tasks = math.ceil(n * 9 / PAIRS)
    looked = todo.repartition(tasks, "dst").withColumn("wide", wide).withColumn("bin", F.explode(F.sequence(low, high))).withColumn("sector", F.explode(turn))
    # more points than a few are never sent through the driver, as small as Spark may take them for
    near = looked.join(s.hint("broadcast" if few else "merge"), ["bin", "sector"])
    best = _ranked(near.select("dst", "lon", "lat", "home", "east", "wide", "src", "slon", "slat"), k)
    below = F.when(F.col("home") <= 1, F.lit(math.pi)).otherwise(F.radians(F.col("lat") + 90 - (F.col("home") - 1) * height))
    above = F.when(F.col("home") + 1 >= bins - 1, F.lit(math.pi)).otherwise(F.radians((F.col("home") + 2) * height - 90 - F.col("lat")))
    at = F.pmod(F.col("lon"), F.lit(360.0)) - F.col("east") * height
    left = F.least(F.least(at, height - at) + F.col("wide") * height, F.lit(90.0))
    beside = F.when(2 * F.col("wide") + 1 >= sectors, F.lit(math.pi)).otherwise(F.asin(F.cos(F.radians("lat")) * F.sin(F.radians(left))))
    last = Window.partitionBy("dst")
    best = best.withColumn("sure", (F.max("d").over(last) <= F.least(below, above, beside) - SLACK) & (F.max("rank").over(last) >= k) | F.lit(bins == 1))
    best = cut(best)  # used three times
    done = best.where("sure").select("dst", "src", "d", "rank")
    rest = todo.select("dst", "lon", "lat").join(best.where("sure").select("dst").distinct(), "dst", "left_anti")
    if bins == 1 or rest.isEmpty():
        return done
    return done.unionAll(_from_above(s, rest, k, bins))


def _ranked(near: DataFrame, k: int) -> DataFrame:
    """The rows (dst, lon, lat, src, slon, slat) of the k nearest of each target, with d and rank."""
    d = great_circle(F.col("lon"), F.col("lat"), F.col("slon"), F.col("slat"))
    # rounding errors don't part equal distances
    order = Window.partitionBy("dst").orderBy(F.round("d", 9), "src")
    return near.withColumn("d", d).drop("slon", "slat").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def box_distances(lon: Column, lat: Column, west: Column, east: Column, south: Column, north: Column) -> tuple[Column, Column]:
    """The least and the greatest angle, in radians, between a point and those of a box; all in degrees, longitudes from 0 to 360."""

    def apart(edge: Column) -> Column:
        return F.least(F.abs(lon - edge), 360 - F.abs(lon - edge))

    # distance grows with the difference in longitude, so both ends lie on a meridian
    near = F.radians(F.when(lon.between(west, east), F.lit(0.0)).otherwise(F.least(apart(west), apart(east))))
    far = F.radians(F.when(F.pmod(lon + 180, F.lit(360.0)).between(west, east), F.lit(180.0)).otherwise(F.greatest(apart(west), apart(east))))

    def cosines(turn: Column) -> tuple[Column, Column, Column, Column]:
        """At the box's ends of a meridian and at the meridian's nearest point, and the latitude of that."""
        a, b = F.sin(F.radians(lat)), F.cos(F.radians(lat)) * F.cos(turn)
        return *[a * F.sin(F.radians(y)) + b * F.cos(F.radians(y)) for y in (south, north)], F.sqrt(a * a + b * b), F.degrees(F.atan2(a, b))

    (s, n, top, at), (s2, n2, top2, at2) = cosines(near), cosines(far)
    opposite = F.when(at2 > 0, at2 - 180).otherwise(at2 + 180)
    most = F.when(at.between(south, north), top).otherwise(F.greatest(s, n))
    least = F.when(opposite.between(south, north), -top2).otherwise(F.least(s2, n2))
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), most))), F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), least)))


def _from_above(s: DataFrame, todo: DataFrame, k: int, bins: int) -> DataFrame:
    """(dst, src, d, rank) of the k nearest of (src, slon, slat, bin, sector) for targets (dst, lon, lat) that may be far from all.

    Boxes of a level have 4 by 4 boxes of the one below, down to those of 4 by 4 bins. A target goes on to the boxes that may hold one of
    its k nearest: no farther than the distance within which the boxes it looks at hold k points for certain.
    """
    height, top = 180.0 / bins, max(1, math.ceil(math.log(bins / 2, 4)))
    lowest = s.groupBy(F.shiftright("bin", 2).alias("row"), F.shiftright("sector", 2).alias("column")).agg(F.count("*").alias("held"))
    lowest, looked = cut(lowest), None  # read by each level
    for level in range(top, 0, -1):
        side, up = height * 4**level, 2 * (level - 1)
        boxes = lowest.groupBy(F.shiftright("row", up).alias("row"), F.shiftright("column", up).alias("column")).agg(F.sum("held").alias("held"))
        if looked is None:
            looked = todo.crossJoin(F.broadcast(boxes))  # 2 by 4 at most
        else:
            few = 2 * math.ceil(bins / 4**level) ** 2 <= FEW
            below = boxes.withColumns({"__row": F.shiftright("row", 2), "__column": F.shiftright("column", 2)})
            looked = looked.withColumnsRenamed({"row": "__row", "column": "__column"}).join(below.hint("broadcast" if few else "merge"), ["__row", "__column"])
        south, west = F.col("row") * side - 90, F.col("column") * side
        nearest, farthest = box_distances(F.pmod("lon", F.lit(360.0)), F.col("lat"), west, F.least(west + side, F.lit(360.0)), south, F.least(south + side, F.lit(90.0)))
        looked = looked.select("dst", "lon", "lat", "row", "column", "held", nearest.alias("nearest"), farthest.alias("farthest"))
        sums = Window.partitionBy("dst").orderBy("farthest", "row", "column").rowsBetween(Window.unboundedPreceding, 0)
        looked = looked.withColumn("sum", F.sum("held").over(sums))
        within = F.min(F.when(F.col("sum") >= k, F.col("farthest"))).over(Window.partitionBy("dst"))
        looked = looked.withColumn("within", F.coalesce(within, F.lit(math.pi))).where(F.col("nearest") <= F.col("within") + SLACK).select("dst", "lon", "lat", "row", "column")
    points = s.select("src", "slon", "slat", F.shiftright("bin", 2).alias("row"), F.shiftright("sector", 2).alias("column"))
    return _ranked(looked.join(points.hint("merge"), ["row", "column"]).select("dst", "lon", "lat", "src", "slon", "slat"), k).select("dst", "src", "d", "rank")


def _normalised(near: DataFrame, src: DataFrame, raw: Column) -> DataFrame:
    """Shares among the unmasked of the k nearest; the masked ones count as neighbours and are then dropped."""
    live = near.join(src.select(F.col("cell").alias("src"), "mask"), "src").where("mask = 0").withColumn("w", raw)
    return live.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("dst"))).select("dst", "src", "w")


def with_nearest_unmasked(links: DataFrame, src: DataFrame, dst: DataFrame, bins: int | None = None) -> DataFrame:
    """Targets without links get their nearest unmasked source with weight 1."""
    return links.unionByName(nearest_unmasked(links, src, dst, bins))


def nearest_unmasked(links: DataFrame, src: DataFrame, dst: DataFrame, bins: int | None = None) -> DataFrame:
    """(dst, src, w): the nearest unmasked source, with weight 1, of each target without links."""
    bare = cut(dst.join(links.select("dst").distinct(), dst["cell"] == F.col("dst"), "left_anti"))  # read by each round of the search
    return nearest_k(src.where("mask = 0"), bare, 1, bins).select("dst", "src", F.lit(1.0).alias("w"))


def distance_weights(src: DataFrame, dst: DataFrame, k: int) -> DataFrame:
    """Inverse-distance weights of the k nearest neighbours of active targets."""
    active = dst.where("mask = 0")
    links = _normalised(nearest_k(src, active, k), src, F.lit(1.0) / (F.col("d") + EPSILON))
    return with_nearest_unmasked(links, src, active)


def average_distance(grid: DataFrame) -> DataFrame:
    """One row: the mean distance of points that follow each other by address, around the cycle; addresses may have gaps."""
    places = running(grid.select("cell", "lon", "lat"), [F.col("cell")], F.lit(1), "place")
    n = places.agg(F.max("place").alias("n"))
    after = places.crossJoin(F.broadcast(n)).select(F.when(F.col("place") == 1, F.col("n")).otherwise(F.col("place") - 1).alias("place"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    return places.join(after, "place").agg(F.avg(great_circle(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"))).alias("distance"))


def chord_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Angle in radians between points in degrees, from the chord between them: exact for close points too."""
    def at(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
        return F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))

    square = sum(((a - b) * (a - b) for a, b in zip(at(lon1, lat1), at(lon2, lat2), strict=True)), F.lit(0.0))
    return 2 * F.asin(F.least(F.lit(1.0), F.sqrt(square) / 2))


def gaussian_weights(src: DataFrame, dst: DataFrame, k: int, variance: float) -> DataFrame:
    active = dst.where("mask = 0")
    mean = average_distance(src).first()["distance"]
    links = _normalised(nearest_k(src, active, k), src, F.exp(-0.5 * F.col("d") * F.col("d") / (variance * mean * mean)))
    return with_nearest_unmasked(links, src, active)


def overlaps(src: DataFrame, dst: DataFrame, bins: int | None = None) -> DataFrame:
    """(dst, src, overlap, dst_area) of regular cells whose interiors meet."""
    bins = bins or bins_for(src)
    height = 180.0 / bins

    def span(lo: str, hi: str, origin: int, n: int) -> Column:
        first = F.floor((F.col(lo) + origin) / height).cast("int")
        last = F.least(F.ceil((F.col(hi) + origin) / height).cast("int") - 1, F.lit(n - 1))
        return F.explode(F.sequence(first, F.greatest(first, last)))

    def binned(cells: DataFrame) -> DataFrame:
        return cells.withColumn("bin", span("lat_lo", "lat_hi", 90, bins)).withColumn("sector", span("lon_lo", "lon_hi", 0, 2 * bins))

    a = binned(src).select(F.col("cell").alias("src"), *[F.col(c).alias(f"s_{c}") for c in ("lon_lo", "lon_hi", "lat_lo", "lat_hi", "mask")], "bin", "sector")
    b = binned(dst).select(F.col("cell").alias("dst"), "lon_lo", "lon_hi", "lat_lo", "lat_hi", F.col("area").alias("dst_area"), "bin", "sector")
    east, west = F.least("lon_hi", "s_lon_hi"), F.greatest("lon_lo", "s_lon_lo")
    north, south = F.least("lat_hi", "s_lat_hi"), F.greatest("lat_lo", "s_lat_lo")
    # a pair is formed in the first bin that both are in
    first = (F.floor((south + 90) / height).cast("int") == F.col("bin")) & (F.floor(west / height).cast("int") == F.col("sector"))
    met = a.join(b, ["bin", "sector"]).where((east - west > 1e-9) & (north - south > 1e-9) & first)
    return met.select("dst", "src", "s_mask", "dst_area", (F.radians(east - west) * (F.sin(F.radians(north)) - F.sin(F.radians(south)))).alias("overlap"))


def conservative_weights(src: DataFrame, dst: DataFrame, normalisation: str = "FRACAREA") -> DataFrame:
    """First-order conservative weights of regular cells: FRACAREA, DESTAREA, NONE or FRACNNEI."""
    met = overlaps(src, dst).where("s_mask = 0")
    if normalisation == "DESTAREA":
        w = F.col("overlap") / F.col("dst_area")
    elif normalisation in ("FRACAREA", "FRACNNEI"):
        w = F.col("overlap") / F.sum("overlap").over(Window.partitionBy("dst"))
    elif normalisation == "NONE":
        w = F.col("overlap")
    else:
        raise ValueError(f"unknown normalisation {normalisation}")
    links = met.select("dst", "src", w.alias("w"))
    return with_nearest_unmasked(links, src, dst) if normalisation == "FRACNNEI" else links


def point_in_cell(src: DataFrame, dst: DataFrame, bins: int | None = None) -> DataFrame:
    """(dst, src): the first source cell, by address, that holds the target's point."""
    bins = bins or bins_for(src)
    height = 180.0 / bins

    def at(c: str, origin: int, n: int) -> Column:
        return F.least(F.floor((F.col(c) + origin) / height), F.lit(n - 1)).cast("int")

    rows, columns = F.explode(F.sequence(at("lat_lo", 90, bins), at("lat_hi", 90, bins))), F.explode(F.sequence(at("lon_lo", 0, 2 * bins), at("lon_hi", 0, 2 * bins)))
    a = src.select(F.col("cell").alias("src"), "lon_lo", "lon_hi", "lat_lo", "lat_hi").withColumn("bin", rows).withColumn("sector", columns)
    b = dst.select(F.col("cell").alias("dst"), "lon", "lat", at("lat", 90, bins).alias("bin"), at("lon", 0, 2 * bins).alias("sector"))
    inside = F.col("lon").between(F.col("lon_lo"), F.col("lon_hi")) & F.col("lat").between(F.col("lat_lo"), F.col("lat_hi"))
    return a.join(b, ["bin", "sector"]).where(inside).groupBy("dst").agg(F.min("src").alias("src"))


def bilinear_weights(dst: DataFrame, nx: int, ny: int) -> DataFrame:
    """Bilinear weights from a regular global grid of nx by ny points, periodic in longitude.

    On a regular grid the position within the four surrounding points has a
    closed form. Targets beyond the outermost rows take the row's two points.
    """
    x = F.col("lon") * nx / 360.0 + 0.5
    y = (F.col("lat") + 90.0) * ny / 180.0 + 0.5
    at = dst.select(F.col("cell").alias("dst"), x.alias("x"), F.greatest(F.lit(1.0), F.least(F.lit(float(ny)), y)).alias("y"))
    at = at.withColumns({"i": F.floor("x"), "j": F.least(F.floor("y"), F.lit(ny - 1))}).withColumns({"p": F.col("x") - F.col("i"), "q": F.col("y") - F.col("j")})
    corner = F.explode(
        F.array(
            *[
                F.struct(
                    ((F.col("j") + dj - 1) * nx + F.pmod(F.col("i") + di - 1, F.lit(nx)) + 1).alias("src"),
                    ((F.col("p") if di else 1 - F.col("p")) * (F.col("q") if dj else 1 - F.col("q"))).alias("w"),
                )
                for di, dj in ((0, 0), (1, 0), (1, 1), (0, 1))
            ]
        )
    ).alias("c")
    return at.select("dst", corner).select("dst", F.col("c.src").cast("long").alias("src"), F.col("c.w").alias("w")).where(F.abs("w") > 1e-12)


def masked_bilinear_weights(src: DataFrame, dst: DataFrame, nx: int, ny: int) -> DataFrame:
    """Bilinear weights of active targets, where no masked source point takes part.

    A target with a masked corner takes inverse distances of the unmasked among
    its four nearest points, or else its nearest unmasked point.
    """
    active = dst.where("mask = 0")
    links = bilinear_weights(active, nx, ny)
    hidden = links.join(src.where("mask <> 0").select(F.col("cell").alias("src")), "src", "left_semi").select("dst").distinct()
    whole = links.join(hidden, "dst", "left_anti")
    rest = active.join(hidden, active["cell"] == hidden["dst"], "left_semi")
    near = _normalised(nearest_k(src, rest, 4), src, F.lit(1.0) / (F.col("d") + EPSILON))
    return with_nearest_unmasked(whole.unionByName(near), src, active)


def hermite(t: Column) -> tuple[Column, Column, Column, Column]:
    """h00, h01, h10, h11 of the bicubic weights."""
    return 1 - t * t * (3 - 2 * t), t * t * (3 - 2 * t), t * (t - 1) * (t - 1), t * t * (t - 1)


def bicubic_weights(dst: DataFrame, nx: int, ny: int) -> DataFrame:
    """(dst, src, w1, w2, w3, w4): weights of the value and of its i, j and cross gradients."""
    x = F.col("lon") * nx / 360.0 + 0.5
    y = (F.col("lat") + 90.0) * ny / 180.0 + 0.5
    at = dst.select(F.col("cell").alias("dst"), x.alias("x"), F.greatest(F.lit(1.0), F.least(F.lit(float(ny)), y)).alias("y"))
    at = at.withColumns({"i": F.floor("x"), "j": F.least(F.floor("y"), F.lit(ny - 1))}).withColumns({"p": F.col("x") - F.col("i"), "q": F.col("y") - F.col("j")})
    hp, hq = hermite(F.col("p")), hermite(F.col("q"))
    corners = []
    for di, dj in ((0, 0), (1, 0), (1, 1), (0, 1)):
        src = (F.col("j") + dj - 1) * nx + F.pmod(F.col("i") + di - 1, F.lit(nx)) + 1
        value_i, slope_i, value_j, slope_j = hp[di], hp[2 + di], hq[dj], hq[2 + dj]
        corners.append(F.struct(src.cast("long").alias("src"), (value_i * value_j).alias("w1"), (slope_i * value_j).alias("w2"), (value_i * slope_j).alias("w3"), (slope_i * slope_j).alias("w4")))
    return at.select("dst", F.explode(F.array(*corners)).alias("c")).select("dst", "c.*")


def gradients(field: DataFrame, nx: int, ny: int, value: str = "v") -> DataFrame:
    """(cell, value, gi, gj, gij): central differences along i (periodic), j (one-sided at the ends) and both."""
    # each value goes to the nine places that look at it; one shuffle by place
    around = F.explode(F.array(*[F.struct(F.lit(di).alias("di"), F.lit(dj).alias("dj")) for di in (-1, 0, 1) for dj in (-1, 0, 1)])).alias("o")
    sent = field.select("cell", "i", "j", F.col(value).alias("v"), around)
    sent = sent.select("cell", "v", "o.di", "o.dj", (F.pmod(F.col("i") - F.col("o.di") - 1, F.lit(nx)) + 1).alias("i"), (F.col("j") - F.col("o.dj")).alias("j"))

    def seen(di: int, dj: int, column: str) -> Column:
        return F.max(F.when((F.col("di") == di) & (F.col("dj") == dj), F.col(column)))

    parts = [seen(di, dj, "v").alias(f"v{di + 1}{dj + 1}") for di in (-1, 0, 1) for dj in (-1, 0, 1) if di or dj]
    out = sent.groupBy("i", "j").agg(seen(0, 0, "cell").alias("cell"), seen(0, 0, "v").alias("v"), *parts).where("cell IS NOT NULL")
    j = F.col("j")
    up, down = F.coalesce(F.col("v12"), F.col("v")), F.coalesce(F.col("v10"), F.col("v"))
    steps = F.when((j == 1) | (j == ny), 1).otherwise(2)
    cross = (F.coalesce("v22", "v21") - F.coalesce("v02", "v01")) - (F.coalesce("v20", "v21") - F.coalesce("v00", "v01"))
    return out.select("cell", "v", ((F.col("v21") - F.col("v01")) / 2).alias("gi"), ((up - down) / steps).alias("gj"), (cross / 2 / steps).alias("gij"))
