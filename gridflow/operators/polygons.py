"""Conservative weights of polygon cells, first and second order.

A cell is a polygon in longitude and latitude with straight sides between its corners, or with sides along great circles
where it comes near a pole (:func:`with_great_circles`). The corners' polygon is cut into
convex pieces with four corners each; a cell around a pole, or with a point on its rim there, becomes one piece for each
side, from that side up to the pole. Pieces of both grids meet by bins, and each pair is clipped and integrated along the sides of what they share (by Stokes'
theorem a side (phi, theta) gives the cap below it): area, and the integrals of latitude and of longitude times cosine
over it, for second order. Pairs are Arrow batches; everything before and after is joins and aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .curvilinear import SHIFT, _binned, beside
from ..shared import cut
from .weights import bins_for, nearest_unmasked

_GAUSS = ((0.5 - 15**0.5 / 10, 5 / 18), (0.5, 8 / 18), (0.5 + 15**0.5 / 10, 5 / 18))


def with_great_circles(grid: DataFrame, parts: int = 8, above: float = math.degrees(1.45)) -> DataFrame:
    """The grid with ``parts`` points on each side that reaches beyond the latitude ``above``, along the great circle between its corners.

    Between these points sides are straight in degrees, so areas are off by a share that falls as 1 / parts**2. A side is the same for both
    cells that have it, so cells still fill the sphere; a side of half a turn or more has no great circle.
    """
    n = F.size("clon")

    def along(k: Column) -> Column:
        after = F.pmod(k + 1, n)
        x, y, x2, y2 = (F.radians(F.get(c, at)) for at in (k, after) for c in ("clon", "clat"))
        ends = [(F.cos(b) * F.cos(a), F.cos(b) * F.sin(a), F.sin(b)) for a, b in ((x, y), (x2, y2))]

        def point(j: Column) -> Column:
            # on the chord, and from there outwards
            u, v, w = ((1 - j / parts) * a + j / parts * b for a, b in zip(*ends, strict=True))
            return F.struct(F.degrees(F.atan2(v, u)).alias("x"), F.degrees(F.atan2(w, F.sqrt(u * u + v * v))).alias("y"))

        first = F.array(F.struct(F.get("clon", k).alias("x"), F.get("clat", k).alias("y")))
        near = F.greatest(F.abs(F.get("clat", k)), F.abs(F.get("clat", after))) > above
        return F.when(near, F.concat(first, F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), point))).otherwise(first) if parts > 1 else first

    out = grid.withColumn("__arc", F.flatten(F.transform(F.sequence(F.lit(0), n - 1), along)))
    return out.withColumns({"clon": F.col("__arc.x"), "clat": F.col("__arc.y")}).drop("__arc")


def pieces(grid: DataFrame, cell: str) -> DataFrame:
    """(cell, x array, y array, sign): convex pieces in degrees of grid rows (cell, lon, lat, clon, clat), corners in turn.

    A corner at a pole has the longitudes of both its neighbours. Four-cornered polygons that are not convex are cut into triangles from their first
    corner; a triangle has its last corner twice. Polygons of more corners, and those at a pole, are the sum of what lies between each side and the pole,
    taken with the side's direction as ``sign``: whatever their shape, what is out of them cancels.
    """
    n = F.size("clon")

    def corner(k: Column) -> Column:
        def point(at: Column) -> Column:
            return F.struct(F.get("clon", at).alias("x"), F.get("clat", k).alias("y"))

        # a cell with a side along the pole has its own longitudes there
        bare = F.greatest(F.abs(F.get("clat", F.pmod(k - 1, n))), F.abs(F.get("clat", F.pmod(k + 1, n)))) <= 90 - 1e-7
        return F.when(bare & (F.abs(F.get("clat", k)) > 90 - 1e-7), F.array(point(F.pmod(k - 1, n)), point(F.pmod(k + 1, n)))).otherwise(F.array(point(k)))

    def over_the_pole(k: Column) -> Column:
        """Two points at the pole after corner k, if the side from there goes half around it."""
        after = F.pmod(k + 1, n)
        half = (F.abs(F.abs(beside(F.get("clon", after), F.get("clon", k))) - 180) < 1e-6) & (F.abs(F.get("clat", k)) <= 90 - 1e-7) & (F.abs(F.get("clat", after)) <= 90 - 1e-7)
        top = F.when(F.get("clat", k) >= 0, F.lit(90.0)).otherwise(F.lit(-90.0))
        points = F.array(*[F.struct(F.get("clon", at).alias("x"), top.alias("y")) for at in (k, after)])
        return F.when(half, points).otherwise(F.slice(points, 1, 0))

    corners = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.concat(corner(k), over_the_pole(k))))
    grid = grid.withColumn("__c", corners).select("cell", "lat", F.col("__c.x").alias("clon"), F.col("__c.y").alias("clat"))
    # corners next to each other, all around; the last step says whether the cell goes around a pole
    step = F.transform(F.sequence(F.lit(0), n - 1), lambda k: beside(F.get("clon", F.pmod(k + 1, n)), F.get("clon", k)))
    out = grid.select(F.col("cell").alias(cell), "lat", "clon", "clat", n.alias("n"), step.alias("step"))
    # a step of half a turn, along the pole, is the way back of the others
    half = lambda s: F.abs(F.abs(s) - 180) < 1e-6
    others = F.aggregate(F.filter("step", lambda s: ~half(s)), F.lit(0.0), lambda a, s: a + s)
    out = out.withColumn("step", F.transform("step", lambda s: F.when(half(s), -others).otherwise(s)))
    along = F.transform(F.sequence(F.lit(0), F.col("n")), lambda k: F.get("clon", F.lit(0)) + F.aggregate(F.slice("step", F.lit(1), k), F.lit(0.0), lambda a, s: a + s))
    out = out.withColumns({"x": along, "y": F.concat("clat", F.slice("clat", 1, 1))})
    polar = (F.abs(F.get("x", F.col("n")) - F.get("x", F.lit(0))) > 180) | (F.array_max(F.transform("y", lambda y: F.abs(y))) > 90 - 1e-7)
    pole = F.when(F.col("lat") >= 0, F.lit(90.0)).otherwise(F.lit(-90.0))

    def at(name: str, k: Column) -> Column:
        return F.get(name, k)

    def cross(k: Column) -> Column:
        a, b, c = k, F.pmod(k + 1, F.col("n")), F.pmod(k + 2, F.col("n"))
        return (at("x", b) - at("x", a)) * (at("y", c) - at("y", b)) - (at("y", b) - at("y", a)) * (at("x", c) - at("x", b))

    turns = F.transform(F.sequence(F.lit(0), F.col("n") - 1), cross)
    convex = (F.col("n") == 4) & ((F.array_min(turns) >= -1e-12) | (F.array_max(turns) <= 1e-12))
    out = out.withColumn("way", F.signum(F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), F.lit(0.0), lambda a, k: a + (at("x", k + 1) - at("x", k)) * (180 - F.abs(at("y", k)) - F.abs(at("y", k + 1))))))
    sides = F.transform(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda k: F.struct(F.array(at("x", k), at("x", k + 1), at("x", k + 1), at("x", k)).alias("x"), F.array(at("y", k), at("y", k + 1), pole, pole).alias("y"), (F.signum(at("x", k + 1) - at("x", k)) * F.col("way")).alias("sign")),
    )
    fan = F.transform(F.sequence(F.lit(1), F.col("n") - 2), lambda k: F.struct(*[F.array(at(c, F.lit(0)), at(c, k), at(c, k + 1), at(c, k + 1)).alias(c) for c in "xy"], F.lit(1.0).alias("sign")))
    whole = F.array(F.struct(F.slice("x", 1, 4).alias("x"), F.slice("y", 1, 4).alias("y"), F.lit(1.0).alias("sign")))
    return out.select(cell, F.explode(F.when(polar | (F.col("n") > 4), sides).when(convex, whole).otherwise(fan)).alias("o")).select(cell, "o.x", "o.y", "o.sign").where("sign <> 0")


def _clipped(sx: np.ndarray, sy: np.ndarray, cx: np.ndarray, cy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, m) corners of the convex polygons (sx, sy) cut to the convex polygons (cx, cy), both anticlockwise, side by side; repeated corners fill the rows."""
    for k in range(cx.shape[1]):
        ax, ay = cx[:, k, None], cy[:, k, None]
        bx, by = cx[:, (k + 1) % cx.shape[1], None], cy[:, (k + 1) % cx.shape[1], None]
        d = (bx - ax) * (sy - ay) - (by - ay) * (sx - ax)
        none = (bx == ax) & (by == ay)  # a side without length cuts nothing
        d = np.where(none, 1.0, d)
        nd, nx, ny = np.roll(d, -1, 1), np.roll(sx, -1, 1), np.roll(sy, -1, 1)
        crosses = (d < 0) != (nd < 0)
        t = np.where(crosses, d / np.where(crosses, d - nd, 1.0), 0.0)
        # each corner gives itself, if it is within, and the point where its side crosses
        px = np.stack((sx, sx + t * (nx - sx)), axis=2).reshape(len(sx), -1)
        py = np.stack((sy, sy + t * (ny - sy)), axis=2).reshape(len(sx), -1)
        keep = np.stack((d >= 0, crosses), axis=2).reshape(len(sx), -1)
        order = np.argsort(~keep, axis=1, kind="stable")
        count = keep.sum(axis=1)
        width = max(1, int(count.max(initial=0)))
        order = order[:, :width]
        # rows with fewer corners repeat their last one
        fill = np.minimum(np.arange(width), np.maximum(count - 1, 0)[:, None])
        order = np.take_along_axis(order, fill, 1)
        sx, sy = np.take_along_axis(px, order, 1), np.take_along_axis(py, order, 1)
        sx[count == 0], sy[count == 0] = 0.0, 0.0
    return sx, sy


def integrals(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(n, 3) integrals over polygons with corners in degrees, anticlockwise: of 1, of latitude, and of longitude times the cosine of latitude."""
    phi, theta = np.radians(x), np.radians(y)
    dphi, dtheta = np.roll(phi, -1, 1) - phi, np.roll(theta, -1, 1) - theta
    # the mean of the sine along a side that is straight in both
    area = -dphi * np.sin(theta + dtheta / 2) * np.sinc(dtheta / 2 / np.pi)
    lat, lon = np.zeros_like(area), np.zeros_like(area)
    for at, share in _GAUSS:
        t, f = theta + at * dtheta, phi + at * dphi
        lat -= share * dphi * (np.cos(t) + t * np.sin(t))
        lon -= share * dphi * f * (np.sin(t) * np.cos(t) + t) / 2
    return np.stack((area.sum(axis=1), lat.sum(axis=1), lon.sum(axis=1)), axis=1)


def _anticlockwise(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    turned = (x * np.roll(y, -1, 1) - y * np.roll(x, -1, 1)).sum(axis=1) < 0
    x[turned], y[turned] = x[turned, ::-1], y[turned, ::-1]
    return x, y


def overlaps(src: DataFrame, dst: DataFrame, bins: int | None = None) -> DataFrame:
    """(dst, src, area, lat, lon): integrals over what each pair of cells shares; ``lon`` runs on from the source's first corner."""
    bins = bins or bins_for(src)

    def dealt(grid: DataFrame, name: str) -> DataFrame:
        p = pieces(grid, name).select(name, F.col("x").alias(f"{name}_x"), F.col("y").alias(f"{name}_y"), F.col("sign").alias(f"{name}_sign"), F.monotonically_increasing_id().alias(f"{name}_piece"))
        ends = [f(f"{name}_{c}") for c in "xy" for f in (F.array_min, F.array_max)]
        return _binned(p, ends[0], ends[1], ends[2], ends[3], bins)

    height, sectors = 180.0 / bins, 2 * bins
    s_lo, s_hi, d_lo, d_hi = (f(c) for c in ("src_x", "dst_x") for f in (F.array_min, F.array_max))
    # the target may meet the source a turn away, and more than once where one of them is wide
    turn = F.explode(F.filter(F.array(*[F.lit(360.0 * k) for k in (-2, -1, 0, 1, 2)]), lambda t: (d_lo + t < s_hi) & (d_hi + t > s_lo))).alias("turn")
    south = F.greatest(F.array_min("src_y"), F.array_min("dst_y"))
    tall = south < F.least(F.array_max("src_y"), F.array_max("dst_y"))
    # Spark takes arrays and exploded rows for much smaller than they are, and would send a whole grid through the driver
    met = dealt(src, "src").hint("merge").join(dealt(dst, "dst"), ["band", "sector"]).where(tall).select("*", turn)
    west = F.greatest(s_lo, d_lo + F.col("turn"))
    # a pair is formed in the first bin that both are in
    first = (F.least(F.floor((south + 90) / height), F.lit(bins - 1)) == F.col("band")) & (F.pmod(F.floor((west + SHIFT) / height), F.lit(sectors)) == F.col("sector"))
    pairs = met.where(first).select("src", "dst", (F.col("src_sign") * F.col("dst_sign")).alias("sign"), "src_x", "src_y", F.transform("dst_x", lambda x: x + F.col("turn")).alias("dst_x"), "dst_y")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                sx, sy, dx, dy = (np.stack(pdf[c].to_numpy()) for c in ("src_x", "src_y", "dst_x", "dst_y"))
                x, y = _clipped(*_anticlockwise(sx, sy), *_anticlockwise(dx, dy))
                w = integrals(x, y)
                some = w[:, 0] > 1e-15
                w *= pdf["sign"].to_numpy()[:, None]
                yield pd.DataFrame({"dst": pdf["dst"][some], "src": pdf["src"][some], "area": w[some, 0], "lat": w[some, 1], "lon": w[some, 2]})

    parts = pairs.mapInPandas(run, "dst long, src long, area double, lat double, lon double")
    # pairs of which all parts cancel do not meet
    return parts.groupBy("dst", "src").agg(*[F.sum(c).alias(c) for c in ("area", "lat", "lon")]).where("area > 1e-15")


def measured(grid: DataFrame) -> DataFrame:
    """(cell, area, lat, lon): the integrals over each cell, ``lon`` from its first corner on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                w = integrals(*_anticlockwise(np.stack(pdf["x"].to_numpy()), np.stack(pdf["y"].to_numpy()))) * pdf["sign"].to_numpy()[:, None]
                yield pd.DataFrame({"cell": pdf["cell"], "area": w[:, 0], "lat": w[:, 1], "lon": w[:, 2]})

    parts = pieces(grid, "cell").mapInPandas(run, "cell long, area double, lat double, lon double")
    return parts.groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("area", "lat", "lon")])


def conservative(src: DataFrame, dst: DataFrame, normalisation: str = "FRACAREA", second: bool = False, arcs: int = 0) -> DataFrame:
    """(dst, src, w1[, w2, w3]) of unmasked sources: FRACAREA, DESTAREA, NONE or FRACNNEI.

    ``arcs``: sides near the poles are great circles, of so many points each; 0 for sides straight in degrees everywhere.

    With ``second``, w2 goes with the gradient by latitude and w3 with the gradient by longitude over the cosine of
    latitude, both per radian and at the source's centroid.
    """
    if arcs:
        src, dst = with_great_circles(src, arcs), with_great_circles(dst, arcs)
    met = overlaps(src.where("mask = 0"), dst)
    if normalisation in ("FRACAREA", "FRACNNEI"):
        met = met.withColumn("by", F.sum("area").over(Window.partitionBy("dst")))
    elif normalisation == "DESTAREA":
        met = met.join(measured(dst).select(F.col("cell").alias("dst"), F.col("area").alias("by")), "dst")
    elif normalisation == "NONE":
        met = met.withColumn("by", F.lit(1.0))
    else:
        raise ValueError(f"unknown normalisation {normalisation}")
    whole = measured(src).select(F.col("cell").alias("src"), F.col("area").alias("a"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    w = {"w1": F.col("area") / F.col("by")}
    if second:
        met = met.join(whole, "src")
        w["w2"] = (F.col("lat") - F.col("area") * F.col("a_lat") / F.col("a")) / F.col("by")
        w["w3"] = (F.col("lon") - F.col("area") * F.col("a_lon") / F.col("a")) / F.col("by")
    links = met.select("dst", "src", *[c.alias(n) for n, c in w.items()])
    if normalisation != "FRACNNEI":
        return links
    links = cut(links)  # the repair below reads them in several jobs
    near = nearest_unmasked(links, src, dst.where("mask = 0"))
    return links.unionByName(near.select("dst", "src", F.col("w").alias("w1"), *[F.lit(0.0).alias(n) for n in w if n != "w1"]))
