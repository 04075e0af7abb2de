"""Grids whose rows and columns bend: preparation, quadrilaterals, and weights by position within them.

Points are (cell, i, j, lon, lat, mask). Quadrilateral (i, j) has the points (i, j), (i+1, j), (i+1, j+1), (i, j+1) as
its corners; it is known by the cell of the first and made by one shuffle of the points. Longitudes are compared after
they are moved next to each other, so nothing breaks where 360 meets 0. Targets and quadrilaterals meet by bins of
latitude and longitude.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut
from .weights import EPSILON, bins_for, hermite, nearest_k, with_nearest_unmasked


SHIFT = 0.0012345678
#: Points of a bin that are kept in one row, and of a group at most; pairs of points that a task forms at least, and tasks that groups ask for, or so.
BLOCK, GROUP, MET, TILES = 4096, 250_000, 20_000_000, 1000


def beside(lon: Column, other: Column) -> Column:
    """``lon - other``, turned to lie in [-180, 180)."""
    return F.pmod(lon - other + 180.0, F.lit(360.0)) - 180.0


def prepared(grid: DataFrame) -> DataFrame:
    """Longitudes in [0, 360), latitudes in [-90, 90], and the box of each cell's corners (clon, clat).

    Corners lie next to their centre, so ``box_lon_lo`` may be below 0 and ``box_lon_hi`` above 360. A cell whose corners
    go around a pole has the whole circle as its box, which reaches to that pole.
    """
    lon, lat = F.pmod("lon", F.lit(360.0)), F.greatest(F.lit(-90.0), F.least(F.lit(90.0), F.col("lat")))
    out = grid.withColumns({"lon": lon, "lat": lat}).withColumn("__x", F.transform("clon", lambda c: F.col("lon") + beside(c, F.col("lon"))))
    n = F.size("clon")
    turn = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda a, k: a + beside(F.get("clon", F.pmod(k + 1, n)), F.get("clon", k)))
    polar = F.abs(turn) > 180
    north = F.col("lat") >= 0
    return out.select(
        *[c for c in out.columns if c != "__x"],
        F.when(polar, F.lit(0.0)).otherwise(F.array_min("__x")).alias("box_lon_lo"),
        F.when(polar, F.lit(360.0)).otherwise(F.array_max("__x")).alias("box_lon_hi"),
        F.when(polar & ~north, F.lit(-90.0)).otherwise(F.greatest(F.lit(-90.0), F.array_min("clat"))).alias("box_lat_lo"),
        F.when(polar & north, F.lit(90.0)).otherwise(F.least(F.lit(90.0), F.array_max("clat"))).alias("box_lat_hi"),
    )


def flipped(grid: DataFrame) -> DataFrame:
    """The grid with its mask the other way round: 1 for active points in one convention, 0 in the other."""
    return grid.withColumn("mask", 1 - F.col("mask"))


def duplicates(grid: DataFrame, width: float = 1e-6) -> DataFrame:
    """(cell, other): pairs of points that differ by less than ``width`` degrees in both coordinates, ``cell`` the higher.

    Points meet in bins of that width. A bin's points are kept in blocks, and its blocks in groups; groups of a bin and of the ones beside it
    meet in pairs, each in a task. Groups grow with what is to be compared, so that a point is sent to a bounded number of tasks
    however many coincide, up to the ``GROUP`` points that a task holds. Pairs are formed point by point and not held.
    """
    turn = round(360 / width)
    x, y = F.pmod(F.floor(F.pmod("lon", F.lit(360.0)) / width).cast("long"), F.lit(turn)), F.floor((F.col("lat") + 90) / width).cast("long")
    at = grid.where("cell IS NOT NULL").select(F.col("cell").cast("long").alias("cell"), F.pmod("lon", F.lit(360.0)).alias("lon"), "lat", x.alias("x"), y.alias("y"))
    # NaN is above all numbers
    at = at.where((F.col("lon") <= 360) & (F.abs("lat") < math.inf))
    bins = at.groupBy("x", "y").agg(F.count("*").alias("n"))
    most, pairs = bins.agg(F.max("n"), F.sum(F.col("n").cast("double") * F.col("n"))).first()
    most, pairs = most or 1, pairs or 0
    held = max(BLOCK, min(GROUP, math.sqrt(max(MET, pairs / TILES))))
    block = F.pmod(F.xxhash64("cell"), F.lit(math.ceil(most / BLOCK))).alias("block")
    p = F.sort_array(F.collect_list(F.struct("cell", "lon", "lat"))).alias("p")
    blocks = at.groupBy("x", "y", block).agg(p).select("x", "y", "block", *[F.col(f"p.{c}").alias(c) for c in ("cell", "lon", "lat")])
    # each pair of bins once: a bin looks at itself (0), eastwards and to the north
    ahead = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(j).alias("j")) for d, (i, j) in enumerate(((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1)))])).alias("o")
    sent = bins.select(F.col("x").alias("x1"), F.col("y").alias("y1"), F.ceil(F.col("n") / held).alias("n1"), (F.col("n") > 1).alias("many"), ahead)
    sent = sent.where("many OR o.d > 0").select("x1", "y1", "n1", "o.d", F.pmod(F.col("x1") + F.col("o.i"), F.lit(turn)).alias("x"), (F.col("y1") + F.col("o.j")).alias("y"))
    # Spark takes arrays and exploded rows for much smaller than they are, and would send a whole grid through the driver
    met = sent.hint("merge").join(bins.select("x", "y", F.ceil(F.col("n") / held).alias("n2")), ["x", "y"])
    own, keys = F.col("d") == 0, ("x1", "y1", "d", "i", "j")
    # group i of the first bin meets group j of the second, or those up to its own
    first = blocks.join(met.select(F.col("x1").alias("x"), F.col("y1").alias("y"), "x1", "y1", "d", "n1", "n2").hint("merge"), ["x", "y"]).withColumn("i", F.pmod("block", "n1"))
    first = first.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.when(own, F.col("i")).otherwise(F.col("n2") - 1))))
    second = blocks.join(met.select("x", "y", "x1", "y1", "d", "n1", "n2").hint("merge"), ["x", "y"]).withColumn("j", F.pmod("block", "n2"))
    second = second.withColumn("i", F.explode(F.sequence(F.when(own, F.col("j")).otherwise(0), F.col("n1") - 1)))
    first, second = first.select(*keys, "cell", "lon", "lat"), second.select(*keys, *[F.col(c).alias(f"{c}2") for c in ("cell", "lon", "lat")])
    if pairs > MET:
        # by hand: Spark would put tasks together by their bytes, which say little of their pairs
        tasks = int(grid.sparkSession.conf.get("spark.sql.shuffle.partitions")) + math.ceil(min(pairs / held**2, 10_000))
        first, second = first.repartition(tasks, *keys), second.repartition(tasks, *keys)
    points = first.select(*keys, F.explode(F.arrays_zip("cell", "lon", "lat")).alias("p")).select(*keys, "p.cell", "p.lon", "p.lat")
    both = points.hint("merge").join(second, list(keys)).select("d", "i", "j", "cell", "lon", "lat", "lon2", "lat2", F.posexplode("cell2").alias("k", "other"))
    step = F.abs(F.col("lon") - F.get("lon2", "k"))
    close = ((step < width) | (step > 360 - width)) & (F.abs(F.col("lat") - F.get("lat2", "k")) < width)
    # a group that meets itself has each pair twice
    once = F.when(own & (F.col("i") == F.col("j")), F.col("cell") > F.col("other")).otherwise(F.col("cell") != F.col("other"))
    return both.where(close & once).select(F.greatest("cell", "other").alias("cell"), F.least("cell", "other").alias("other"))


def without_duplicates(grid: DataFrame, width: float = 1e-6) -> DataFrame:
    """Of active points that coincide only the one with the highest address stays active."""
    lower = duplicates(grid.where("mask = 0"), width).select(F.col("other").alias("cell")).distinct()
    hidden = grid.join(lower.withColumn("__hidden", F.lit(True)), "cell", "left")
    return hidden.select(*[F.when(F.col("__hidden"), 1).otherwise(F.col("mask")).alias("mask") if c == "mask" else F.col(c) for c in grid.columns])


def quads(grid: DataFrame, nx: int, periodic: bool = True) -> DataFrame:
    """(quad, c1..c4, x1..x4, y1..y4, hidden): corners in order, x next to x1; ``hidden``: some corner is masked."""
    corner = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(di).alias("di"), F.lit(dj).alias("dj")) for k, (di, dj) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)), 1)])).alias("o")
    moved = grid.select("cell", "lon", "lat", "mask", "i", "j", corner).select("cell", "lon", "lat", "mask", "o.k", (F.col("i") - F.col("o.di")).alias("i"), (F.col("j") - F.col("o.dj")).alias("j"))
    if periodic:
        moved = moved.withColumn("i", F.pmod(F.col("i") - 1, F.lit(nx)) + 1)
    parts = [F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{n}{k}") for c, n in (("cell", "c"), ("lon", "x"), ("lat", "y")) for k in range(1, 5)]
    whole = moved.groupBy("i", "j").agg(F.count("*").alias("n"), F.max(F.col("mask") != 0).alias("hidden"), *parts).where("n = 4")
    xs = [F.col("x1"), *[(F.col("x1") + beside(F.col(f"x{k}"), F.col("x1"))).alias(f"x{k}") for k in (2, 3, 4)]]
    return whole.select(F.col("c1").alias("quad"), *[f"c{k}" for k in range(1, 5)], *xs, *[f"y{k}" for k in range(1, 5)], "hidden")


def _binned(df: DataFrame, lon_lo: Column, lon_hi: Column, lat_lo: Column, lat_hi: Column, bins: int) -> DataFrame:
    """A row for each bin (band, sector) that the box meets; longitudes may pass 0 and 360.

    Sectors begin at ``-SHIFT``, away from the longitudes that grids have, so that rounding can't part equal ones.
    """
    height, sectors = 180.0 / bins, 2 * bins

    def band(lat: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.floor((lat + 90) / height), F.lit(bins - 1))).cast("int")

    first, last = (F.floor((lon + SHIFT) / height).cast("int") for lon in (lon_lo, lon_hi))
    turn = F.when(last - first >= sectors - 1, F.sequence(F.lit(0), F.lit(sectors - 1))).otherwise(F.transform(F.sequence(first, last), lambda s: F.pmod(s, F.lit(sectors))))
    return df.withColumn("sector", F.explode(turn)).withColumn("band", F.explode(F.sequence(band(lat_lo), band(lat_hi))))


def _cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def located(quads_: DataFrame, dst: DataFrame, bins: int | None = None) -> DataFrame:
    """(dst, quad, hidden, c1..c4, p, q): the first quadrilateral, by address, that holds each target's point, and the place in it.

    The point is P1 + p a + q b + p q c with a = P2 - P1, b = P4 - P1, c = P1 - P2 + P3 - P4. Leaving out p gives a
    quadratic in q, of which the root that lies within the quadrilateral is taken.
    """
    bins = bins or bins_for(quads_)
    xs, ys = [F.col(f"x{k}") for k in range(1, 5)], [F.col(f"y{k}") for k in range(1, 5)]
    a = _binned(quads_, F.least(*xs), F.greatest(*xs), F.least(*ys), F.greatest(*ys), bins)
    b = _binned(dst.select(F.col("cell").alias("dst"), F.pmod("lon", F.lit(360.0)).alias("lon"), "lat"), F.pmod("lon", F.lit(360.0)), F.pmod("lon", F.lit(360.0)), F.col("lat"), F.col("lat"), bins)
    met = a.hint("merge").join(b, ["band", "sector"]).withColumns({"x": F.col("x1") + beside(F.col("lon"), F.col("x1")), "y": F.col("lat")})
    px, py = F.col("x"), F.col("y")
    sides = [_cross(xs[(k + 1) % 4] - xs[k], ys[(k + 1) % 4] - ys[k], px - xs[k], py - ys[k]) for k in range(4)]
    slack = 1e-12
    inside = (F.least(*sides) >= -slack) | (F.greatest(*sides) <= slack)
    one = met.where(inside).groupBy("dst").agg(F.min_by(F.struct("quad", "hidden", "x", "y", *[f"{n}{k}" for n in "cxy" for k in range(1, 5)]), "quad").alias("s")).select("dst", "s.*")
    one = one.withColumns({"ax": xs[1] - xs[0], "ay": ys[1] - ys[0], "bx": xs[3] - xs[0], "by": ys[3] - ys[0], "ux": px - xs[0], "uy": py - ys[0]})
    one = one.withColumns({"cx": xs[0] - xs[1] + xs[2] - xs[3], "cy": ys[0] - ys[1] + ys[2] - ys[3]})
    v = {n: F.col(n) for n in ("ax", "ay", "bx", "by", "cx", "cy", "ux", "uy")}
    one = one.withColumns(
        {
            "A": -_cross(v["bx"], v["by"], v["cx"], v["cy"]),
            "B": _cross(v["ux"], v["uy"], v["cx"], v["cy"]) + _cross(v["ax"], v["ay"], v["bx"], v["by"]),
            "C": _cross(v["ux"], v["uy"], v["ax"], v["ay"]),
        }
    )
    root = F.sqrt(F.greatest(F.col("B") * F.col("B") - 4 * F.col("A") * F.col("C"), F.lit(0.0)))
    half = -(F.col("B") + F.when(F.col("B") < 0, -root).otherwise(root)) / 2
    # small: C / half, well defined as A goes to 0; large: half / A
    one = one.withColumn("near", F.coalesce(F.try_divide("C", half), F.lit(0.0))).withColumn("far", F.try_divide(half, F.col("A")))
    out_of = lambda q: F.greatest(-q, q - 1, F.lit(0.0))
    one = one.withColumn("q", F.when(F.col("far").isNotNull() & (out_of(F.col("far")) < out_of(F.col("near"))), F.col("far")).otherwise(F.col("near")))
    gx, gy = v["ax"] + F.col("q") * v["cx"], v["ay"] + F.col("q") * v["cy"]
    p = F.when(F.abs(gx) >= F.abs(gy), F.try_divide(v["ux"] - F.col("q") * v["bx"], gx)).otherwise(F.try_divide(v["uy"] - F.col("q") * v["by"], gy))
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return one.select("dst", "quad", "hidden", *[f"c{k}" for k in range(1, 5)], clip(F.coalesce(p, F.lit(0.0))).alias("p"), clip(F.col("q")).alias("q"))


def _four_nearest(src: DataFrame, targets: DataFrame, bins: int | None = None) -> DataFrame:
    """Inverse distances of the unmasked among the four nearest points."""
    near = nearest_k(src, targets, 4, bins).join(src.select(F.col("cell").alias("src"), "mask"), "src").where("mask = 0")
    near = near.withColumn("w", F.lit(1.0) / (F.col("d") + EPSILON))
    return near.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("dst"))).select("dst", "src", "w")


def _placed(src: DataFrame, active: DataFrame, nx: int, periodic: bool, bins: int) -> tuple[DataFrame, DataFrame]:
    """Where the active targets are, and those of them that no unmasked quadrilateral holds; both are used by several jobs, so they are written."""
    placed = cut(located(quads(src, nx, periodic), active, bins).where("NOT hidden"))
    return placed, cut(active.join(placed.select(F.col("dst").alias("cell")), "cell", "left_anti"))


def bilinear(src: DataFrame, dst: DataFrame, nx: int, periodic: bool = True) -> DataFrame:
    """(dst, src, w) of active targets. Where a corner is masked or no quadrilateral holds the target, the unmasked of the
    four nearest points share by inverse distance; where these are all masked, the nearest unmasked point has it all."""
    active = dst.where("mask = 0")
    bins = bins_for(src)
    placed, rest = _placed(src, active, nx, periodic, bins)
    p, q = F.col("p"), F.col("q")
    shares = ((1 - p) * (1 - q), p * (1 - q), p * q, (1 - p) * q)
    corner = F.explode(F.array(*[F.struct(F.col(f"c{k}").alias("src"), w.alias("w")) for k, w in enumerate(shares, 1)])).alias("c")
    links = placed.select("dst", corner).select("dst", "c.src", "c.w")
    return links.unionByName(with_nearest_unmasked(_four_nearest(src, rest, bins), src, rest, bins))


def bicubic(src: DataFrame, dst: DataFrame, nx: int, periodic: bool = True) -> DataFrame:
    """(dst, src, w1, w2, w3, w4): weights of the value and of its i, j and cross gradients; elsewhere as :func:`bilinear`, in w1."""
    active = dst.where("mask = 0")
    bins = bins_for(src)
    placed, rest = _placed(src, active, nx, periodic, bins)
    hp, hq = hermite(F.col("p")), hermite(F.col("q"))
    corners = []
    for k, (di, dj) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)), 1):
        value_i, slope_i, value_j, slope_j = hp[di], hp[2 + di], hq[dj], hq[2 + dj]
        corners.append(F.struct(F.col(f"c{k}").alias("src"), (value_i * value_j).alias("w1"), (slope_i * value_j).alias("w2"), (value_i * slope_j).alias("w3"), (slope_i * slope_j).alias("w4")))
    links = placed.select("dst", F.explode(F.array(*corners)).alias("c")).select("dst", "c.*")
    plain = with_nearest_unmasked(_four_nearest(src, rest, bins), src, rest, bins)
    return links.unionByName(plain.select("dst", "src", F.col("w").alias("w1"), *[F.lit(0.0).alias(f"w{k}") for k in (2, 3, 4)]))
