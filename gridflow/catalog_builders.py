"""Registered queries on grids that bend, are reduced, or have polygons as cells. Grids grow with the ``part`` table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import _folder, query, r, rounded
from .operators import curvilinear, polygons, reduced, remap, weights
from .plans.exchange import Remap, remapped
from .schema import analytic_field, regular_grid, rotated_grid, table, with_corners

TILT = 33.0


def size(spark, d) -> int:
    return math.isqrt(table(spark, d, "part").count() // 8)


def grids(spark, d) -> tuple[DataFrame, DataFrame, int]:
    """A rotated grid of 2n by n points, a regular one of n + 3 by n // 2 + 2, and the length of the first one's rows."""
    n = size(spark, d)
    return rotated_grid(spark, 2 * n, n, TILT), regular_grid(spark, n + 3, n // 2 + 2), 2 * n


def boxes(spark, d) -> tuple[DataFrame, DataFrame]:
    n = size(spark, d)
    return with_corners(regular_grid(spark, 2 * n, n)), with_corners(regular_grid(spark, n + 3, n // 2 + 2))


def with_values(grid: DataFrame) -> DataFrame:
    return grid.withColumn("v", analytic_field(F.col("lon"), F.col("lat")))


# ---------------------------------------------------------------- the grids in SQL

_N = "n AS (SELECT CAST(floor(sqrt(count(*) // 8)) AS BIGINT) AS n FROM part)"


def _regular(nx: str, ny: str) -> str:
    return f"""(SELECT *, radians(lon_hi - lon_lo) * (sin(radians(lat_hi)) - sin(radians(lat_lo))) AS area FROM (SELECT i + (j - 1) * nx AS cell, i, j, nx, ny,
(i - 0.5) * (360.0 / nx) AS lon, (j - 0.5) * (180.0 / ny) - 90 AS lat, (i - 1) * (360.0 / nx) AS lon_lo, i * (360.0 / nx) AS lon_hi,
(j - 1) * (180.0 / ny) - 90 AS lat_lo, j * (180.0 / ny) - 90 AS lat_hi, CASE WHEN (i + (j - 1) * nx) % 7 = 0 THEN 1 ELSE 0 END AS mask
FROM (SELECT nx, ny, i, unnest(range(1, ny + 1)) AS j FROM (SELECT {nx} AS nx, {ny} AS ny, unnest(range(1, {nx} + 1)) AS i FROM n))))"""


def _beside(a: str, b: str) -> str:
    return f"(((({a} - {b} + 180) % 360) + 360) % 360 - 180)"


def _value(p: str = "") -> str:
    return f"(2 - cos(acos(greatest(-1.0, least(1.0, cos(radians({p}lat)) * cos(radians({p}lon))))) / 1.2))"


_A = math.radians(TILT)
_SOURCE, _TARGET = _regular("2 * n", "n"), _regular("n + 3", "n // 2 + 2")
_ROTATED = f"""(SELECT cell, i, j, nx, ny, mask, ((degrees(atan2(y, x * {math.cos(_A)!r} + z * {math.sin(_A)!r})) % 360) + 360) % 360 AS lon,
degrees(asin(greatest(-1.0, least(1.0, z * {math.cos(_A)!r} - x * {math.sin(_A)!r})))) AS lat
FROM (SELECT *, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM {_SOURCE}))"""
_DISTANCE = """acos(greatest(-1.0, least(1.0, sin(radians(s.lat)) * sin(radians(t.lat)) + cos(radians(s.lat)) * cos(radians(t.lat)) *
(cos(radians(s.lon)) * cos(radians(t.lon)) + sin(radians(s.lon)) * sin(radians(t.lon))))))"""


def _nearest(rest: str) -> str:
    """CTEs ending in ``nearest`` (dst, src, w): what targets of ``rest`` get from their four nearest points, or their nearest unmasked one."""
    return f"""dist AS (SELECT t.cell AS dst, s.cell AS src, s.mask, {_DISTANCE} AS d FROM s, t WHERE t.cell IN (SELECT cell FROM {rest})),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY round(d, 9), src) AS k, row_number() OVER (PARTITION BY dst, mask ORDER BY round(d, 9), src) AS u FROM dist),
four AS (SELECT dst, src, 1 / (d + 2.220446049250313e-16) AS w FROM ranked WHERE k <= 4 AND mask = 0),
nearest AS (SELECT dst, src, w / sum(w) OVER (PARTITION BY dst) AS w FROM four UNION ALL SELECT dst, src, 1.0 FROM ranked WHERE u = 1 AND mask = 0 AND dst NOT IN (SELECT dst FROM four))"""


def _cross(k: int) -> str:
    a, b = k, k % 4 + 1
    return f"(x{b} - x{a}) * (y - y{a}) - (y{b} - y{a}) * (x - x{a})"


_LOCATED = f"""WITH {_N}, s AS {_ROTATED}, t AS {_TARGET},
q AS (SELECT a.cell AS quad, a.cell AS c1, b.cell AS c2, c.cell AS c3, e.cell AS c4, a.lon AS x1, a.lon + {_beside("b.lon", "a.lon")} AS x2, a.lon + {_beside("c.lon", "a.lon")} AS x3, a.lon + {_beside("e.lon", "a.lon")} AS x4,
a.lat AS y1, b.lat AS y2, c.lat AS y3, e.lat AS y4, a.mask + b.mask + c.mask + e.mask > 0 AS hidden
FROM s a JOIN s b ON b.j = a.j AND b.i = a.i % a.nx + 1 JOIN s c ON c.j = a.j + 1 AND c.i = b.i JOIN s e ON e.j = a.j + 1 AND e.i = a.i),
m AS (SELECT t.cell AS dst, q.*, x1 + {_beside("t.lon", "x1")} AS x, t.lat AS y FROM t, q WHERE t.mask = 0),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY quad) AS k FROM m
WHERE least({_cross(1)}, {_cross(2)}, {_cross(3)}, {_cross(4)}) >= -1e-12 OR greatest({_cross(1)}, {_cross(2)}, {_cross(3)}, {_cross(4)}) <= 1e-12) WHERE k = 1),
g AS (SELECT *, x2 - x1 AS ax, y2 - y1 AS ay, x4 - x1 AS bx, y4 - y1 AS by_, x1 - x2 + x3 - x4 AS cx, y1 - y2 + y3 - y4 AS cy, x - x1 AS ux, y - y1 AS uy FROM o),
h AS (SELECT *, by_ * cx - bx * cy AS aa, ux * cy - uy * cx + ax * by_ - ay * bx AS bb, ux * ay - uy * ax AS cc FROM g),
z AS (SELECT *, sqrt(greatest(bb * bb - 4 * aa * cc, 0)) AS root FROM h),
y AS (SELECT *, -(bb + CASE WHEN bb < 0 THEN -root ELSE root END) / 2 AS half FROM z),
e AS (SELECT *, CASE WHEN half = 0 THEN 0 ELSE cc / half END AS near, CASE WHEN aa = 0 THEN NULL ELSE half / aa END AS far FROM y),
w AS (SELECT *, CASE WHEN far IS NOT NULL AND greatest(-far, far - 1, 0) < greatest(-near, near - 1, 0) THEN far ELSE near END AS q FROM e),
placed AS (SELECT dst, quad, hidden, c1, c2, c3, c4, greatest(0, least(1, CASE WHEN abs(ax + q * cx) >= abs(ay + q * cy) THEN (ux - q * bx) / (ax + q * cx) ELSE (uy - q * by_) / (ay + q * cy) END)) AS p, greatest(0, least(1, q)) AS q FROM w),
rest AS (SELECT cell FROM t WHERE mask = 0 AND cell NOT IN (SELECT dst FROM placed WHERE NOT hidden)), {_nearest("rest")} """


@query(_LOCATED + "SELECT dst, quad, round(p, 6) AS p, round(q, 6) AS q FROM placed")
def point_in_quad(spark, d):
    src, dst, nx = grids(spark, d)
    return rounded(curvilinear.located(curvilinear.quads(src, nx), dst.where("mask = 0")).select("dst", "quad", "p", "q"))


@query(_LOCATED + f""", links AS (SELECT dst, c1 AS src, (1 - p) * (1 - q) AS w FROM placed WHERE NOT hidden UNION ALL SELECT dst, c2, p * (1 - q) FROM placed WHERE NOT hidden
UNION ALL SELECT dst, c3, p * q FROM placed WHERE NOT hidden UNION ALL SELECT dst, c4, (1 - p) * q FROM placed WHERE NOT hidden UNION ALL SELECT dst, src, w FROM nearest)
SELECT dst, count(*) AS n_links, round(sum(w), 6) AS w_sum, round(sum(w * {_value()}), 6) AS v FROM links JOIN s ON src = cell GROUP BY 1""")
def bilinear_curvilinear(spark, d):
    """Masked corners and targets near the poles get distance weights."""
    src, dst, nx = grids(spark, d)
    links = Remap("BILINEAR").weights(src, dst, nx).join(with_values(src).select(F.col("cell").alias("src"), "v"), "src")
    return rounded(links.groupBy("dst").agg(F.count("*").alias("n_links"), F.sum("w").alias("w_sum"), F.sum(F.col("w") * F.col("v")).alias("v")))


def _hermite_sql() -> str:
    h = {0: "1 - {t} * {t} * (3 - 2 * {t})", 1: "{t} * {t} * (3 - 2 * {t})"}
    g = {0: "{t} * ({t} - 1) * ({t} - 1)", 1: "{t} * {t} * ({t} - 1)"}
    rows = []
    for k, (di, dj) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)), 1):
        vi, si, vj, sj = (f"({x.format(t=t)})" for x, t in ((h[di], "p"), (g[di], "p"), (h[dj], "q"), (g[dj], "q")))
        rows.append(f"SELECT dst, c{k} AS src, {vi} * {vj} AS w1, {si} * {vj} AS w2, {vi} * {sj} AS w3, {si} * {sj} AS w4 FROM placed WHERE NOT hidden")
    return " UNION ALL ".join(rows)


@query(_LOCATED + f""", links AS ({_hermite_sql()} UNION ALL SELECT dst, src, w, 0, 0, 0 FROM nearest)
SELECT dst, count(*) AS n_links, round(sum(w1 * {_value()}), 6) AS v1, round(sum(w2 * {_value()}), 6) AS v2, round(sum(w3 * {_value()}), 6) AS v3, round(sum(w4 * {_value()}), 6) AS v4 FROM links JOIN s ON src = cell GROUP BY 1""")
def bicubic_curvilinear(spark, d):
    src, dst, nx = grids(spark, d)
    links = Remap("BICUBIC").weights(src, dst, nx).join(with_values(src).select(F.col("cell").alias("src"), "v"), "src")
    return rounded(links.groupBy("dst").agg(F.count("*").alias("n_links"), *[F.sum(F.col(f"w{k}") * F.col("v")).alias(f"v{k}") for k in range(1, 5)]))


# ---------------------------------------------------------------- distance weights, held against all pairs

_ALL = f"""WITH {_N}, s AS {_SOURCE}, t AS {_TARGET}, dist AS (SELECT t.cell AS dst, s.cell AS src, s.mask, {_DISTANCE} AS d FROM s, t WHERE t.mask = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY round(d, 9), src) AS k, row_number() OVER (PARTITION BY dst, mask ORDER BY round(d, 9), src) AS u FROM dist),
mean AS (SELECT avg({_DISTANCE}) AS h FROM s JOIN s t ON t.cell = s.cell % (s.nx * s.ny) + 1),
raw AS (SELECT dst, src, {{}} AS w FROM ranked, mean WHERE k <= 4 AND mask = 0),
links AS (SELECT dst, src, w / sum(w) OVER (PARTITION BY dst) AS w FROM raw UNION ALL SELECT dst, src, 1.0 FROM ranked WHERE u = 1 AND mask = 0 AND dst NOT IN (SELECT dst FROM raw))
SELECT dst, count(*) AS n_links, round(sum(w), 6) AS w_sum, round(max(w), 6) AS w_max FROM links GROUP BY 1"""


def _summary(links: DataFrame) -> DataFrame:
    """What ties between equally distant neighbours can't change."""
    return rounded(links.groupBy("dst").agg(F.count("*").alias("n_links"), F.sum("w").alias("w_sum"), F.max("w").alias("w_max")))


@query(_ALL.format("1 / (d + 2.220446049250313e-16)"))
def distwgt_sized(spark, d):
    src, dst = boxes(spark, d)
    return _summary(Remap("DISTWGT", neighbours=4).weights(src.drop("clon", "clat"), dst))


@query(_ALL.format("exp(-0.5 * d * d / (2.0 * h * h))"))
def gauswgt_sized(spark, d):
    src, dst = boxes(spark, d)
    return _summary(Remap("GAUSWGT", neighbours=4, variance=2.0).weights(src, dst))


# ---------------------------------------------------------------- polygons

_SHARED = f"""WITH {_N}, s AS (SELECT *, {_value()} AS v FROM {_SOURCE}), t AS {_TARGET},
c AS (SELECT t.cell AS dst, s.cell AS src, t.area AS dst_area, s.area AS src_area, s.mask, s.v, radians(greatest(s.lon_lo, t.lon_lo)) AS f1, radians(least(s.lon_hi, t.lon_hi)) AS f2,
radians(greatest(s.lat_lo, t.lat_lo)) AS h1, radians(least(s.lat_hi, t.lat_hi)) AS h2, radians(s.lon_lo) AS sf1, radians(s.lon_hi) AS sf2, radians(s.lat_lo) AS sh1, radians(s.lat_hi) AS sh2 FROM s JOIN t
ON least(s.lon_hi, t.lon_hi) - greatest(s.lon_lo, t.lon_lo) > 1e-9 AND least(s.lat_hi, t.lat_hi) - greatest(s.lat_lo, t.lat_lo) > 1e-9),
k AS (SELECT *, (f2 - f1) * (sin(h2) - sin(h1)) AS area, (f2 - f1) * (h2 * sin(h2) + cos(h2) - h1 * sin(h1) - cos(h1)) AS lat, (f2 * f2 - f1 * f1) / 2 * (h2 / 2 + sin(2 * h2) / 4 - h1 / 2 - sin(2 * h1) / 4) AS lon,
(sf2 - sf1) * (sh2 * sin(sh2) + cos(sh2) - sh1 * sin(sh1) - cos(sh1)) AS src_lat, (sf2 * sf2 - sf1 * sf1) / 2 * (sh2 / 2 + sin(2 * sh2) / 4 - sh1 / 2 - sin(2 * sh1) / 4) AS src_lon FROM c) """


@query(_SHARED + "SELECT dst, round(sum(w * v), 6) AS v FROM (SELECT dst, v, area / sum(area) OVER (PARTITION BY dst) AS w FROM k WHERE mask = 0) GROUP BY 1")
def conserv_polygons(spark, d):
    """Boxes, dealt with as polygons."""
    src, dst = boxes(spark, d)
    return rounded(remap.apply_weights(Remap("CONSERV", norm="FRACAREA", order="FIRST").weights(src, dst), with_values(src), {"v": "v"}, "w1"))


@query(_SHARED + """SELECT dst, round(sum(area / dst_area * v), 6) AS v1, round(sum((lat - area * src_lat / src_area) / dst_area * v), 6) AS v2, round(sum((lon - area * src_lon / src_area) / dst_area * v), 6) AS v3
FROM k WHERE mask = 0 GROUP BY 1""")
def conserv_second_order(spark, d):
    src, dst = boxes(spark, d)
    links = Remap("CONSERV", norm="DESTAREA", order="SECOND").weights(src, dst).join(with_values(src).select(F.col("cell").alias("src"), "v"), "src")
    return rounded(links.groupBy("dst").agg(*[F.sum(F.col(f"w{k}") * F.col("v")).alias(f"v{k}") for k in (1, 2, 3)]))


@query(f"WITH {_N}, t AS {_TARGET} SELECT cell, round(area, 9) AS shared FROM t")
def conserv_rotated(spark, d):
    """Cells of a rotated grid, those around the poles among them, cover each target once."""
    src, dst, _ = grids(spark, d)
    shared = polygons.overlaps(src, with_corners(dst)).groupBy(F.col("dst").alias("cell")).agg(F.sum("area").alias("shared"))
    return rounded(shared, 9)


_BLOCKED = "CASE WHEN lat_lo >= 0 AND lon_hi <= 180 THEN 1 ELSE mask END"


@query(f"""WITH {_N}, s AS (SELECT * REPLACE ({_BLOCKED} AS mask), {_value()} AS v FROM {_SOURCE}), t AS {_TARGET},
o AS (SELECT t.cell AS dst, s.cell AS src, radians(least(s.lon_hi, t.lon_hi) - greatest(s.lon_lo, t.lon_lo)) * (sin(radians(least(s.lat_hi, t.lat_hi))) - sin(radians(greatest(s.lat_lo, t.lat_lo)))) AS area FROM s JOIN t
ON least(s.lon_hi, t.lon_hi) - greatest(s.lon_lo, t.lon_lo) > 1e-9 AND least(s.lat_hi, t.lat_hi) - greatest(s.lat_lo, t.lat_lo) > 1e-9 WHERE s.mask = 0),
dist AS (SELECT t.cell AS dst, s.cell AS src, row_number() OVER (PARTITION BY t.cell ORDER BY round({_DISTANCE}, 9), s.cell) AS k FROM s, t WHERE s.mask = 0 AND t.mask = 0 AND t.cell NOT IN (SELECT dst FROM o)),
w AS (SELECT dst, src, area / sum(area) OVER (PARTITION BY dst) AS w FROM o UNION ALL SELECT dst, src, 1.0 FROM dist WHERE k = 1)
SELECT dst, count(*) AS n_links, round(sum(w), 6) AS w_sum FROM w GROUP BY 1""")
def fracnnei_masked(spark, d):
    """A masked quarter of the sphere: targets in it have masked sources only and take the nearest unmasked one."""
    src, dst = boxes(spark, d)
    src = src.withColumn("mask", F.when((F.col("lat_lo") >= 0) & (F.col("lon_hi") <= 180), 1).otherwise(F.col("mask")))
    links = Remap("CONSERV", norm="FRACNNEI", order="FIRST").weights(src, dst)
    return rounded(links.groupBy("dst").agg(F.count("*").alias("n_links"), F.sum("w1").alias("w_sum")))


# ---------------------------------------------------------------- reduced grids

_OCTAHEDRAL = """(SELECT row_number() OVER (ORDER BY circle, k) AS cell, circle, k, n, (k - 1) * 360.0 / n AS lon, (circle - 0.5) * 180.0 / ny - 90 AS lat, ny, 0 AS mask FROM (
SELECT *, unnest(range(1, n + 1)) AS k FROM (SELECT ny, circle, 4 * least(circle, ny + 1 - circle) + 16 AS n FROM (SELECT n + 4 AS ny, unnest(range(1, n + 5)) AS circle FROM n))))"""


def _stencil_sql(half: int) -> str:
    """CTEs ending in ``points{half}`` (dst, src, x, t, row, u): place along the circle, and of the target among the circles."""
    return f"""at{half} AS (SELECT t.cell AS dst, t.lon, (t.lat + 90) * c.ny / 180.0 + 0.5 AS u FROM t, (SELECT DISTINCT ny FROM s) c WHERE t.mask = 0),
rows{half} AS (SELECT dst, lon, u - floor(u) AS u, unnest(range({1 - half}, {half + 1})) AS row, CAST(floor(u) AS BIGINT) AS home, ny FROM at{half}, (SELECT DISTINCT ny FROM s) WHERE floor(u) >= {half} AND floor(u) <= ny - {half}),
on{half} AS (SELECT r.*, c.n, r.lon * c.n / 360.0 - floor(r.lon * c.n / 360.0) AS t, CAST(floor(r.lon * c.n / 360.0) AS BIGINT) AS west FROM rows{half} r JOIN (SELECT DISTINCT circle, n FROM s) c ON c.circle = r.home + r.row),
points{half} AS (SELECT o.dst, s.cell AS src, x, t, row, u FROM (SELECT *, unnest(range({1 - half}, {half + 1})) AS x FROM on{half}) o JOIN s ON s.circle = o.home + o.row AND s.k = (o.west + o.x + o.n) % o.n + 1)"""


_TWO = "(CASE WHEN x = 1 THEN t ELSE 1 - t END) * (CASE WHEN row = 1 THEN u ELSE 1 - u END)"


def _four(k: str, t: str) -> str:
    return f"""(CASE {k} WHEN -1 THEN -{t} * ({t} - 1) * ({t} - 2) / 6 WHEN 0 THEN ({t} + 1) * ({t} - 1) * ({t} - 2) / 2 WHEN 1 THEN -({t} + 1) * {t} * ({t} - 2) / 2 ELSE ({t} + 1) * {t} * ({t} - 1) / 6 END)"""


def _octahedral(spark, d) -> tuple[DataFrame, DataFrame]:
    n = size(spark, d)
    return reduced.octahedral_grid(spark, n + 4).withColumn("mask", F.lit(0)), regular_grid(spark, n + 3, n // 2 + 2)


def _valued(links: DataFrame, src: DataFrame) -> DataFrame:
    held = links.join(with_values(src).select(F.col("cell").alias("src"), "v"), "src")
    return rounded(held.groupBy("dst").agg(F.sum("w").alias("w_sum"), F.sum(F.col("w") * F.col("v")).alias("v")))


_REDUCED = f"WITH {_N}, s AS {_OCTAHEDRAL}, t AS {_TARGET}, {_stencil_sql(1)}, {_stencil_sql(2)}, "
_SUMS = f"SELECT dst, round(sum(w), 6) AS w_sum, round(sum(w * {_value()}), 6) AS v FROM links JOIN s ON src = cell GROUP BY 1"


@query(_REDUCED + f"""rest AS (SELECT cell FROM t WHERE mask = 0 AND cell NOT IN (SELECT dst FROM points1)), {_nearest("rest")},
links AS (SELECT dst, src, {_TWO} AS w FROM points1 UNION ALL SELECT dst, src, w FROM nearest) {_SUMS}""")
def bilinear_reduced(spark, d):
    src, dst = _octahedral(spark, d)
    return _valued(Remap("BILINEAR", kind="D").weights(src, dst), src)


@query(_REDUCED + f"""rest AS (SELECT cell FROM t WHERE mask = 0 AND cell NOT IN (SELECT dst FROM points1)), {_nearest("rest")},
links AS (SELECT dst, src, {_four("x", "t")} * {_four("row", "u")} AS w FROM points2 UNION ALL SELECT dst, src, {_TWO} FROM points1 WHERE dst NOT IN (SELECT dst FROM points2) UNION ALL SELECT dst, src, w FROM nearest) {_SUMS}""")
def bicubic_reduced(spark, d):
    src, dst = _octahedral(spark, d)
    return _valued(Remap("BICUBIC", kind="D").weights(src, dst), src)


# ---------------------------------------------------------------- preparation


@query(f"WITH {_N}, s AS {_SOURCE} SELECT cell, round(lon, 6) AS lon, round(lat, 6) AS lat, round(lon_lo, 6) AS box_lon_lo, round(lon_hi, 6) AS box_lon_hi, round(lat_lo, 6) AS box_lat_lo, round(lat_hi, 6) AS box_lat_hi FROM s")
def grid_prepared(spark, d):
    """A grid whose longitudes and corners come in whole turns off is what it was after preparation."""
    src, _ = boxes(spark, d)
    off = src.withColumns({"lon": F.col("lon") - 720.0, "clon": F.transform("clon", lambda x: x + 360.0)})
    return rounded(curvilinear.prepared(off).select("cell", "lon", "lat", "box_lon_lo", "box_lon_hi", "box_lat_lo", "box_lat_hi"))


@query("""WITH p AS (SELECT p_partkey AS cell, CAST(p_size * 7 % 360 AS DOUBLE) AS lon, CAST(p_retailprice * 100 AS BIGINT) % 10 - 5 AS lat FROM part)
SELECT a.cell, b.cell AS other FROM p a JOIN p b ON a.lon = b.lon AND a.lat = b.lat AND a.cell > b.cell""")
def duplicate_points(spark, d):
    p = table(spark, d, "part")
    points = p.select(F.col("p_partkey").alias("cell"), (F.col("p_size") * 7 % 360).cast("double").alias("lon"), (F.round(F.col("p_retailprice") * 100).cast("long") % 10 - 5).cast("double").alias("lat"))
    return curvilinear.duplicates(points)


@query(f"""WITH {_N}, g AS {_SOURCE}, a AS (SELECT cell, lon AS x1, lat AS y1, cell % (nx * ny) + 1 AS after FROM g)
SELECT a.cell, round(acos(greatest(-1.0, least(1.0, sin(radians(y1)) * sin(radians(g.lat)) + cos(radians(y1)) * cos(radians(g.lat)) * cos(radians(x1 - g.lon))))), 6) AS d FROM a JOIN g ON a.after = g.cell""")
def chord_distances(spark, d):
    src, _ = boxes(spark, d)
    n = 2 * size(spark, d) ** 2
    a = src.select("cell", F.col("lon").alias("x"), F.col("lat").alias("y"), (F.col("cell") % n + 1).alias("after"))
    b = src.select(F.col("cell").alias("after"), "lon", "lat")
    return a.join(b, "after").select("cell", r(weights.chord_distance(F.col("x"), F.col("y"), F.col("lon"), F.col("lat"))).alias("d"))


@query(f"WITH {_N}, g AS {_SOURCE} SELECT cell, 1 - mask AS mask FROM g")
def mask_flipped(spark, d):
    src, _ = boxes(spark, d)
    return curvilinear.flipped(src).select("cell", "mask")


@query(_SHARED + "SELECT dst, round(sum(w * v), 6) AS v FROM (SELECT dst, v, area / sum(area) OVER (PARTITION BY dst) AS w FROM k WHERE mask = 0) GROUP BY 1")
def weights_built_once(spark, d):
    """A map that is stored when it is first asked for, and read the second time."""
    src, dst = boxes(spark, d)
    folder = _folder(spark, "maps")
    for _ in range(2):
        links = remapped(spark, folder, "boxes", Remap("CONSERV", norm="FRACAREA", order="FIRST"), src, dst, columns=("w1",)).withColumnRenamed("w1", "w")
    return rounded(remap.apply_weights(links, with_values(src), {"v": "v"}))


@query(f"""WITH {_N}, g AS (SELECT *, {_value()} AS v FROM {_SOURCE}), e AS (SELECT a.cell, a.j, a.ny, a.v, e.v AS east, w.v AS west, n.v AS north, s.v AS south,
ne.v AS ne, nw.v AS nw, se.v AS se, sw.v AS sw FROM g a JOIN g e ON e.j = a.j AND e.i = a.i % a.nx + 1 JOIN g w ON w.j = a.j AND w.i = (a.i + a.nx - 2) % a.nx + 1
LEFT JOIN g n ON n.j = a.j + 1 AND n.i = a.i LEFT JOIN g s ON s.j = a.j - 1 AND s.i = a.i LEFT JOIN g ne ON ne.j = a.j + 1 AND ne.i = e.i LEFT JOIN g nw ON nw.j = a.j + 1 AND nw.i = w.i
LEFT JOIN g se ON se.j = a.j - 1 AND se.i = e.i LEFT JOIN g sw ON sw.j = a.j - 1 AND sw.i = w.i)
SELECT cell, round((east - west) / 2, 6) AS gi, round((coalesce(north, v) - coalesce(south, v)) / CASE WHEN j IN (1, ny) THEN 1 ELSE 2 END, 6) AS gj,
round(((coalesce(ne, east) - coalesce(nw, west)) - (coalesce(se, east) - coalesce(sw, west))) / 2 / CASE WHEN j IN (1, ny) THEN 1 ELSE 2 END, 6) AS gij FROM e""")
def field_gradients(spark, d):
    src, _ = boxes(spark, d)
    n = size(spark, d)
    return rounded(weights.gradients(with_values(src), 2 * n, n).select("cell", "gi", "gj", "gij"))
