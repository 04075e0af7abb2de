"""Registered queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import names as fn
from .operators import batch, partition, reduce, remap, timewin, weights
from .plans import exchange as plan
from .schema import analytic_field, product_grid, regular_grid, table
from .sources import tables
from .streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[r(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


# ---------------------------------------------------------------- sparse products


def links(spark: SparkSession, d: str, weight: str = "l_discount") -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("dst"), F.col("l_partkey").alias("src"), F.col(weight).alias("w"))


def parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("cell"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"))


@query("SELECT l_orderkey AS dst, round(sum(l_discount * p_retailprice), 4) AS y FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def spmv_local(spark, d):
    return rounded(remap.apply_weights(links(spark, d), parts(spark, d), {"price": "y"}), 4)


@query("""SELECT l_orderkey AS dst, round(sum(l_discount * p_retailprice), 4) AS y1, round(sum(l_discount * p_size), 4) AS y2
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def spmv_multi_column(spark, d):
    return rounded(remap.apply_weights(links(spark, d), parts(spark, d), {"price": "y1", "size": "y2"}), 4)


@query("""SELECT o_orderkey AS cell, round(coalesce(y, 0), 4) AS y FROM orders LEFT JOIN (
SELECT l_orderkey AS dst, sum(l_discount * p_retailprice) AS y FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE l_quantity > 45 GROUP BY 1) ON o_orderkey = dst""")
def spmv_zero_fill(spark, d):
    few = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("dst"), F.col("l_partkey").alias("src"), F.col("l_discount").alias("w"))
    mapped = remap.apply_weights(few, parts(spark, d), {"price": "y"})
    return rounded(remap.zero_filled(mapped, table(spark, d, "orders").select(F.col("o_orderkey").alias("cell")), ["y"]), 4)


@query("""SELECT l_orderkey AS dst, round(sum(l_discount * p_retailprice + l_tax * p_size), 4) AS y
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def spmv_higher_order(spark, d):
    two = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("dst"), F.col("l_partkey").alias("src"), F.col("l_discount").alias("w1"), F.col("l_tax").alias("w2"))
    return rounded(remap.apply_higher_order(two, parts(spark, d), [("w1", "price"), ("w2", "size")]), 4)


@query("SELECT l_orderkey AS dst, round(sum(l_discount * p_retailprice), 4) AS y FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def spmv_ordered(spark, d):
    return rounded(remap.ordered_apply(links(spark, d), parts(spark, d), "price"), 4)


@query("SELECT l_orderkey AS dst, l_partkey AS src, round(sum(l_discount), 6) AS w FROM lineitem GROUP BY 1, 2")
def link_accumulate(spark, d):
    return rounded(remap.accumulate_links(links(spark, d)))


@query("SELECT l_orderkey AS dst, round(sum(l_discount), 6) AS row_sum FROM lineitem GROUP BY 1")
def row_sum(spark, d):
    return rounded(remap.row_sums(links(spark, d)))


@query("""SELECT dst, round(s, 6) AS row_sum, (abs(s - 0.1) <= 0.0205 OR abs(s - 0.2) <= 0.0205) AS valid
FROM (SELECT l_orderkey AS dst, sum(l_discount) AS s FROM lineitem GROUP BY 1)""")
def row_sum_check(spark, d):
    return rounded(remap.row_sum_check(links(spark, d), [0.1, 0.2], 0.0205))


@query("""SELECT count(*) AS n_elements, count(*) / (1000.0 * 1000) AS sparsity, min(l_orderkey) AS first_row, max(l_orderkey) AS last_row,
min(l_partkey) AS first_column, max(l_partkey) AS last_column FROM lineitem""")
def sparsity(spark, d):
    return remap.statistics(links(spark, d), 1000, 1000)


@query("SELECT min(l_orderkey) AS first_row, max(l_orderkey) AS last_row, min(l_partkey) AS first_column, max(l_partkey) AS last_column FROM lineitem")
def matrix_ranges(spark, d):
    return remap.statistics(links(spark, d), 1, 1).drop("n_elements", "sparsity")


@query("SELECT count(*) AS n_out FROM lineitem WHERE l_orderkey NOT BETWEEN 1 AND 1000 OR l_partkey NOT BETWEEN 1 AND 100")
def bounds_check(spark, d):
    return remap.out_of_bounds(links(spark, d), 1000, 100).agg(F.count("*").alias("n_out"))


@query("""SELECT l_orderkey * 1000000 + l_partkey AS link, row_number() OVER (ORDER BY l_partkey DESC, l_orderkey) AS place
FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)""")
def matrix_sort(spark, d):
    rows = remap.accumulate_links(links(spark, d)).withColumn("link", F.col("dst") * 1000000 + F.col("src"))
    return batch.permutation(rows, [("src", True), ("dst", False)], "link")


@query("""WITH p AS (SELECT DISTINCT l_partkey AS i FROM lineitem), g AS (SELECT i, i - row_number() OVER (ORDER BY i) AS k FROM p)
SELECT 0 AS part, min(i) AS start, count(*) AS length FROM g GROUP BY k""")
def matrix_columns(spark, d):
    return partition.columns_of(links(spark, d))


# ---------------------------------------------------------------- reductions


@query("SELECT sum(l_quantity) AS l_quantity, sum(l_linenumber) AS l_linenumber FROM lineitem")
def local_reduce_sum(spark, d):
    return reduce.local_reduce(table(spark, d, "lineitem"), "SUM", ["l_quantity", "l_linenumber"])


@query("SELECT min(l_quantity) AS l_quantity, min(l_extendedprice) AS l_extendedprice FROM lineitem")
def local_reduce_min(spark, d):
    return reduce.local_reduce(table(spark, d, "lineitem"), "MIN", ["l_quantity", "l_extendedprice"])


@query("SELECT max(l_quantity) AS l_quantity, max(l_extendedprice) AS l_extendedprice FROM lineitem")
def local_reduce_max(spark, d):
    return reduce.local_reduce(table(spark, d, "lineitem"), "MAX", ["l_quantity", "l_extendedprice"])


@query("SELECT l_linenumber AS cell, round(sum(l_quantity), 3) AS l_quantity FROM lineitem GROUP BY 1")
def all_reduce_sum(spark, d):
    return rounded(reduce.all_reduce(table(spark, d, "lineitem").withColumn("cell", F.col("l_linenumber")), "SUM", ["l_quantity"]), 3)


@query("SELECT round(sum(o_totalprice / 1000 * (o_custkey % 5)), 2) AS v, sum(o_custkey % 5) AS weight_sum FROM orders")
def weighted_sum(spark, d):
    o = table(spark, d, "orders").select((F.col("o_totalprice") / 1000).alias("v"), (F.col("o_custkey") % 5).alias("w"))
    return rounded(reduce.weighted_sum(o, F.col("w"), ["v"]), 2)


def order_grid(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(k.alias("cell"), (F.col("o_totalprice") / 1000).alias("v"), (1 + k % 5).cast("double").alias("area"), F.when(k % 7 == 0, 0).otherwise(1).alias("m"), ((k % 4) / 4.0).alias("f"))


_ORDER_GRID = """WITH g AS (SELECT o_orderkey AS cell, o_totalprice / 1000 AS v, CAST(1 + o_orderkey % 5 AS DOUBLE) AS area,
CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 1 END AS m, (o_orderkey % 4) / 4.0 AS f FROM orders) """


@query(_ORDER_GRID + "SELECT round(sum(v * area), 2) AS v FROM g")
def spatial_integral(spark, d):
    return rounded(reduce.spatial_integral(order_grid(spark, d), F.col("area"), ["v"]), 2)


@query(_ORDER_GRID + "SELECT round(sum(v * area) / sum(area), 6) AS v FROM g")
def spatial_average(spark, d):
    return rounded(reduce.spatial_average(order_grid(spark, d), F.col("area"), ["v"]))


@query(_ORDER_GRID + "SELECT round(sum(v * area * m * f), 2) AS v, round(sum(area * m * f), 2) AS weight_sum FROM g")
def masked_integral(spark, d):
    return rounded(reduce.weighted_sum(order_grid(spark, d), reduce.masked_weight(F.col("area"), ["m"], ["f"]), ["v"]), 2)


@query(_ORDER_GRID + "SELECT round(sum(v * area * m * f) / sum(area * m * f), 6) AS v FROM g")
def masked_average(spark, d):
    return rounded(reduce.spatial_average(order_grid(spark, d), reduce.masked_weight(F.col("area"), ["m"], ["f"]), ["v"]))


@query(_ORDER_GRID + """SELECT round(sum(v * area), 2) AS v, 'first' AS side FROM g
UNION ALL SELECT round(sum(c_acctbal / 1000 * (1 + c_custkey % 3)), 2), 'second' FROM customer""")
def paired_integrals(spark, d):
    c = table(spark, d, "customer").select((F.col("c_acctbal") / 1000).alias("v"), (1 + F.col("c_custkey") % 3).alias("area"))
    both = reduce.paired(reduce.spatial_integral(order_grid(spark, d), F.col("area"), ["v"]), reduce.spatial_integral(c, F.col("area"), ["v"]))
    return rounded(both, 2)


@query(_ORDER_GRID + """SELECT round(sum(v * area * m) / sum(area * m), 6) AS v, 'first' AS side FROM g
UNION ALL SELECT round(sum(c_acctbal / 1000 * (1 + c_custkey % 3)) / sum(1 + c_custkey % 3), 6), 'second' FROM customer""")
def paired_averages(spark, d):
    c = table(spark, d, "customer").select((F.col("c_acctbal") / 1000).alias("v"), (1 + F.col("c_custkey") % 3).alias("area"))
    first = reduce.spatial_average(order_grid(spark, d), reduce.masked_weight(F.col("area"), ["m"]), ["v"])
    return rounded(reduce.paired(first, reduce.spatial_average(c, F.col("area"), ["v"])))


@query("""SELECT 'o_totalprice' AS field, round(min(o_totalprice / 1000), 6) AS vmin, round(max(o_totalprice / 1000), 6) AS vmax, round(sum(o_totalprice / 1000), 2) AS vsum FROM orders
UNION ALL SELECT 'o_custkey', min(o_custkey), max(o_custkey), sum(o_custkey) FROM orders""")
def diagnostics(spark, d):
    o = table(spark, d, "orders").withColumn("o_totalprice", F.col("o_totalprice") / 1000)
    return reduce.diagnostics(o, ["o_totalprice", "o_custkey"]).select("field", r("vmin").alias("vmin"), r("vmax").alias("vmax"), r("vsum", 2).alias("vsum"))


@query(_ORDER_GRID + "SELECT count(*) FILTER (m NOT IN (0, 1)) AS bad_m, count(*) FILTER (f NOT BETWEEN 0 AND 1) AS bad_f FROM g")
def check_masks(spark, d):
    return batch.check_masks(order_grid(spark, d), ["m"], ["f"])


def by_nation(spark, d, t: str, key: str, nation: str, value: Column, mask: Column) -> DataFrame:
    rows = table(spark, d, t).groupBy(F.col(nation).alias("cell")).agg(F.avg(value).alias("v"), F.count("*").alias("n"))
    return rows.withColumn("m", mask)


_NATIONS = """WITH c AS (SELECT c_nationkey AS cell, avg(c_acctbal) AS v, count(*) % 3 AS m FROM customer GROUP BY 1),
s AS (SELECT s_nationkey AS cell, avg(s_acctbal) AS v, 1 AS m FROM supplier GROUP BY 1),
n AS (SELECT n_nationkey AS cell, CAST(n_regionkey AS DOUBLE) AS v, 2 AS m FROM nation),
k AS (SELECT n_nationkey AS cell, CAST(n_nationkey AS DOUBLE) AS v, n_nationkey % 2 AS m FROM nation) """


def _nation_sources(spark, d):
    n = table(spark, d, "nation")
    return [
        (by_nation(spark, d, "customer", "c_custkey", "c_nationkey", F.col("c_acctbal"), F.col("n") % 3), ["m"]),
        (by_nation(spark, d, "supplier", "s_suppkey", "s_nationkey", F.col("s_acctbal"), F.lit(1)), ["m"]),
        (n.select(F.col("n_nationkey").alias("cell"), F.col("n_regionkey").cast("double").alias("v"), F.lit(2).alias("m")), ["m"]),
        (n.select(F.col("n_nationkey").alias("cell"), F.col("n_nationkey").cast("double").alias("v"), (F.col("n_nationkey") % 2).alias("m")), ["m"]),
    ]


def _merge_sql(tables: str) -> str:
    stacked = " UNION ALL ".join(f"SELECT cell, v, m FROM {t}" for t in tables)
    return _NATIONS + f"""SELECT cell, CASE WHEN sum(m) = 0 THEN NULL ELSE round(sum(v * m) / sum(m), 4) END AS v, CAST(sum(m) AS DOUBLE) AS weight_sum
FROM ({stacked}) GROUP BY 1"""


@query(_merge_sql("cs"))
def merge_two(spark, d):
    return rounded(reduce.merge(_nation_sources(spark, d)[:2], ["v"], strict=False), 4)


@query(_merge_sql("csn"))
def merge_three(spark, d):
    return rounded(reduce.merge(_nation_sources(spark, d)[:3], ["v"], strict=False), 4)


@query(_merge_sql("csnk"))
def merge_four(spark, d):
    return rounded(reduce.merge(_nation_sources(spark, d), ["v"], strict=False), 4)


# ---------------------------------------------------------------- conservation


def _sides(spark, d):
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    src = table(spark, d, "supplier").select(k.alias("cell"), (F.col("s_acctbal") / 1000 + 20).alias("v"), (1 + k % 5).cast("double").alias("area"), F.when(k % 7 == 0, 1).otherwise(0).alias("mask"))
    dst = table(spark, d, "customer").select(c.alias("cell"), (F.col("c_acctbal") / 1000 + 20).alias("v"), (1 + c % 5).cast("double").alias("area"), F.when(c % 7 == 0, 1).otherwise(0).alias("mask"))
    return src, dst


_SIDES = """WITH s AS (SELECT s_acctbal / 1000 + 20 AS v, CAST(1 + s_suppkey % 5 AS DOUBLE) AS area FROM supplier WHERE s_suppkey % 7 <> 0),
t AS (SELECT c_custkey AS cell, c_acctbal / 1000 + 20 AS v, CAST(1 + c_custkey % 5 AS DOUBLE) AS area, CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS mask FROM customer),
a AS (SELECT sum(v * area) AS ss, sum(area) AS ws FROM s), b AS (SELECT sum(v * area) AS sd, sum(area) AS wd FROM t WHERE mask = 0)
SELECT cell, round(CASE WHEN mask = 0 THEN {} ELSE v END, 6) AS v, area, mask FROM t, a, b"""


def _conserve(mode: str, sql: str) -> None:
    def run(spark, d):
        return rounded(reduce.conserve(*_sides(spark, d), mode))

    run.__name__ = f"conserve_{mode.lower()}"
    query(_SIDES.format(sql))(run)


_conserve("GLOBAL", "v - (sd - ss) / wd")
_conserve("GLBPOS", "v * (ss / sd)")
_conserve("BASBAL", "v - (sd - ss * wd / ws) / wd")
_conserve("BASPOS", "v * (ss / sd * (wd / ws))")


# ---------------------------------------------------------------- weights


def _grid_sql(nx: int, ny: int) -> str:
    return f"""(SELECT *, radians(lon_hi - lon_lo) * (sin(radians(lat_hi)) - sin(radians(lat_lo))) AS area FROM (SELECT i + (j - 1) * {nx} AS cell, i, j,
(i - 0.5) * {360.0 / nx} AS lon, (j - 0.5) * {180.0 / ny} - 90 AS lat, (i - 1) * {360.0 / nx} AS lon_lo, i * {360.0 / nx} AS lon_hi,
(j - 1) * {180.0 / ny} - 90 AS lat_lo, j * {180.0 / ny} - 90 AS lat_hi, CASE WHEN (i + (j - 1) * {nx}) % 7 = 0 THEN 1 ELSE 0 END AS mask
FROM range(1, {nx + 1}) a(i), range(1, {ny + 1}) b(j)))"""


_DISTANCE = """acos(greatest(-1.0, least(1.0, sin(radians(s.lat)) * sin(radians(t.lat)) + cos(radians(s.lat)) * cos(radians(t.lat)) *
(cos(radians(s.lon)) * cos(radians(t.lon)) + sin(radians(s.lon)) * sin(radians(t.lon))))))"""
#: Customers and suppliers as points of the sphere, by their balances and keys.
_POINTS = """(SELECT {1} AS cell, {2} * 7.3 - floor({2} * 7.3 / 360) * 360 AS lon, ({1} * 37 % 1789) * 180.0 / 1789 - 90 AS lat, CASE WHEN {1} % 7 = 0 THEN 1 ELSE 0 END AS mask FROM {0})"""
_CUSTOMERS, _SUPPLIERS = _POINTS.format("customer", "c_custkey", "c_acctbal"), _POINTS.format("supplier", "s_suppkey", "s_acctbal")


def _points(spark, d, name: str, key: str, balance: str) -> DataFrame:
    x, k = F.col(balance) * 7.3, F.col(key)
    lon = x - F.floor(x / 360) * 360
    return table(spark, d, name).select(k.alias("cell"), lon.alias("lon"), ((k * 37 % 1789) * 180.0 / 1789 - 90).alias("lat"), F.when(k % 7 == 0, 1).otherwise(0).alias("mask"))


def _customers(spark, d) -> DataFrame:
    return _points(spark, d, "customer", "c_custkey", "c_acctbal")


def _suppliers(spark, d) -> DataFrame:
    return _points(spark, d, "supplier", "s_suppkey", "s_acctbal")


def _near(s: str, t: str) -> str:
    return f"""WITH s AS {s}, t AS {t},
d AS (SELECT t.cell AS dst, s.cell AS src, t.mask AS tmask, s.mask AS smask, {_DISTANCE} AS d FROM s, t),
k AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY round(d, 9), src) AS rank FROM d),
n AS (SELECT * FROM k WHERE rank <= 4) """


_NEAR = _near(_CUSTOMERS, _SUPPLIERS)
#: The point before each, around the cycle of addresses.
_BEFORE = "(SELECT coalesce(lag(cell) OVER (ORDER BY cell), max(cell) OVER ()) AS before, lon, lat FROM s)"


def _near_points(spark, d):
    return _customers(spark, d), _suppliers(spark, d)


@query(_NEAR + "SELECT dst, rank, round(d, 6) AS d FROM n")
def nearest_k(spark, d):
    src, dst = _near_points(spark, d)
    return weights.nearest_k(src, dst, 4).select("dst", F.col("rank").cast("long").alias("rank"), r("d").alias("d"))


def _shares(raw: str) -> str:
    return _NEAR + f""", w AS (SELECT dst, src, {raw} AS w FROM n WHERE smask = 0 AND tmask = 0),
o AS (SELECT dst, src, w / sum(w) OVER (PARTITION BY dst) AS w FROM w),
l AS (SELECT k.dst, k.src, 1.0 AS w, row_number() OVER (PARTITION BY k.dst ORDER BY round(k.d, 9), k.src) AS x FROM k WHERE k.tmask = 0 AND k.smask = 0 AND k.dst NOT IN (SELECT dst FROM o))
SELECT dst, count(*) AS n_links, round(sum(w), 6) AS w_sum, round(max(w), 6) AS w_max FROM (SELECT dst, src, w FROM o UNION ALL SELECT dst, src, w FROM l WHERE x = 1) GROUP BY 1"""


def _summary(links: DataFrame) -> DataFrame:
    """What ties between equally distant neighbours can't change."""
    return rounded(links.groupBy("dst").agg(F.count("*").alias("n_links"), F.sum("w").alias("w_sum"), F.max("w").alias("w_max")))


@query(_shares("1 / (d + 2.220446049250313e-16)"))
def distwgt(spark, d):
    return _summary(weights.distance_weights(*_near_points(spark, d), 4))


@query()
def distwgt_of_parts(spark, d):
    """Distance weights from a grid of about as many points as there are parts to one of about half as many."""
    ny = max(2, math.isqrt(table(spark, d, "part").count() // 2))
    return _summary(weights.distance_weights(regular_grid(spark, 2 * ny, ny), regular_grid(spark, ny, ny), 4))


@query(_shares(f"exp(-0.5 * d * d / (2.0 * (SELECT avg({_DISTANCE}) FROM s JOIN {_BEFORE} t ON s.cell = t.before) ** 2))"))
def gauswgt(spark, d):
    return _summary(weights.gaussian_weights(*_near_points(spark, d), 4, 2.0))


@query(f"""WITH s AS {_CUSTOMERS} SELECT round(avg({_DISTANCE}), 6) AS distance FROM s JOIN {_BEFORE} t ON s.cell = t.before""")
def dist_average(spark, d):
    return rounded(weights.average_distance(_customers(spark, d)))


@query(f"""WITH s AS {_grid_sql(24, 12)}, t AS {_CUSTOMERS}
SELECT t.cell AS dst, min(s.cell) AS src FROM s JOIN t ON t.lon BETWEEN s.lon_lo AND s.lon_hi AND t.lat BETWEEN s.lat_lo AND s.lat_hi GROUP BY 1""")
def point_in_cell(spark, d):
    return weights.point_in_cell(regular_grid(spark, 24, 12), _customers(spark, d))


def _grid_values(spark, d, n: int) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy((F.pmod("o_orderkey", F.lit(n)) + 1).alias("cell")).agg((F.avg("o_totalprice") / 1000).alias("v"))


_VALUES = "(SELECT o_orderkey % {0} + 1 AS cell, avg(o_totalprice) / 1000 AS v FROM orders GROUP BY 1)"
_CONSERV = f"""WITH s AS {_grid_sql(36, 18)}, t AS {_grid_sql(24, 12)}, v AS {_VALUES.format(648)},
p AS (SELECT t.cell AS dst, s.cell AS src, t.area, radians(least(s.lon_hi, t.lon_hi) - greatest(s.lon_lo, t.lon_lo)) *
(sin(radians(least(s.lat_hi, t.lat_hi))) - sin(radians(greatest(s.lat_lo, t.lat_lo)))) AS o FROM s JOIN t
ON least(s.lon_hi, t.lon_hi) - greatest(s.lon_lo, t.lon_lo) > 1e-9 AND least(s.lat_hi, t.lat_hi) - greatest(s.lat_lo, t.lat_lo) > 1e-9 WHERE s.mask = 0),
w AS (SELECT dst, src, {{}} AS w FROM p) SELECT dst, round(sum(w * v), 6) AS v FROM w JOIN v ON src = cell GROUP BY 1"""


def _conserv(name: str, norm: str, sql: str) -> None:
    def run(spark, d):
        links_ = weights.conservative_weights(regular_grid(spark, 36, 18), regular_grid(spark, 24, 12), norm)
        return rounded(remap.apply_weights(links_, _grid_values(spark, d, 648), {"v": "v"}))

    run.__name__ = f"remap_conserv_{name}"
    query(_CONSERV.format(sql))(run)


_conserv("fracarea", "FRACAREA", "o / sum(o) OVER (PARTITION BY dst)")
_conserv("destarea", "DESTAREA", "o / area")
_conserv("none", "NONE", "o")
_conserv("fracnnei", "FRACNNEI", "o / sum(o) OVER (PARTITION BY dst)")  # no target here has masked sources only


@query(f"""WITH t AS {_grid_sql(16, 8)}, v AS {_VALUES.format(288)}, p AS (SELECT cell AS dst, lon * 24 / 360.0 + 0.5 AS x, greatest(1.0, least(12.0, (lat + 90) * 12 / 180.0 + 0.5)) AS y FROM t),
q AS (SELECT dst, floor(x) AS i, least(floor(y), 11) AS j, x - floor(x) AS p, y - least(floor(y), 11) AS q FROM p),
c AS (SELECT dst, (j + dj - 1) * 24 + ((CAST(i + di - 1 AS BIGINT) % 24) + 24) % 24 + 1 AS src, (CASE WHEN di = 1 THEN p ELSE 1 - p END) * (CASE WHEN dj = 1 THEN q ELSE 1 - q END) AS w
FROM q, range(0, 2) a(di), range(0, 2) b(dj)) SELECT dst, round(sum(w * v), 4) AS v FROM c JOIN v ON src = cell GROUP BY 1""")
def bilinear_rectilinear(spark, d):
    links_ = weights.bilinear_weights(regular_grid(spark, 16, 8), 24, 12)
    return rounded(remap.apply_weights(links_, _grid_values(spark, d, 288), {"v": "v"}), 4)


_AT = """p AS (SELECT cell AS dst, lon * 24 / 360.0 + 0.5 AS x, greatest(1.0, least(12.0, (lat + 90) * 12 / 180.0 + 0.5)) AS y FROM t),
q AS (SELECT dst, floor(x) AS i, least(floor(y), 11) AS j, x - floor(x) AS p, y - least(floor(y), 11) AS q FROM p),
c AS (SELECT dst, p, q, di, dj, CAST((j + dj - 1) * 24 + ((CAST(i + di - 1 AS BIGINT) % 24) + 24) % 24 + 1 AS BIGINT) AS src,
(CASE WHEN di = 1 THEN p ELSE 1 - p END) * (CASE WHEN dj = 1 THEN q ELSE 1 - q END) AS w FROM q, range(0, 2) a(di), range(0, 2) b(dj))"""


@query(_near(_grid_sql(24, 12), _CUSTOMERS) + f""", {_AT}, a AS (SELECT c.dst, c.src, c.w FROM c JOIN t ON c.dst = t.cell WHERE t.mask = 0 AND abs(c.w) > 1e-12), h AS (SELECT DISTINCT dst FROM a JOIN s ON src = cell WHERE s.mask <> 0),
r AS (SELECT dst, src, 1 / (d + 2.220446049250313e-16) AS w FROM n WHERE smask = 0 AND dst IN (SELECT dst FROM h)),
o AS (SELECT dst, src, w FROM a WHERE dst NOT IN (SELECT dst FROM h) UNION ALL SELECT dst, src, w / sum(w) OVER (PARTITION BY dst) FROM r),
l AS (SELECT k.dst, k.src, 1.0 AS w, row_number() OVER (PARTITION BY k.dst ORDER BY round(k.d, 9), k.src) AS x FROM k WHERE k.tmask = 0 AND k.smask = 0 AND k.dst NOT IN (SELECT dst FROM o))
SELECT dst, count(*) AS n_links, round(sum(w), 6) AS w_sum, round(max(w), 6) AS w_max FROM (SELECT dst, src, w FROM o UNION ALL SELECT dst, src, w FROM l WHERE x = 1) GROUP BY 1""")
def bilinear_masked(spark, d):
    src, dst = regular_grid(spark, 24, 12), _customers(spark, d)
    links_ = weights.masked_bilinear_weights(src, dst, 24, 12)
    return _summary(links_)


_V = "(2 - cos(acos(greatest(-1.0, least(1.0, cos(radians(lat)) * cos(radians(lon))))) / 1.2))"


@query(f"""WITH t AS {_CUSTOMERS}, g AS (SELECT *, {_V} AS v FROM {_grid_sql(24, 12)}), {_AT},
e AS (SELECT a.cell, a.v, (e.v - w.v) / 2 AS gi, (coalesce(n.v, a.v) - coalesce(s.v, a.v)) / CASE WHEN a.j IN (1, 12) THEN 1 ELSE 2 END AS gj,
((coalesce(ne.v, e.v) - coalesce(nw.v, w.v)) - (coalesce(se.v, e.v) - coalesce(sw.v, w.v))) / 2 / CASE WHEN a.j IN (1, 12) THEN 1 ELSE 2 END AS gij
FROM g a JOIN g e ON e.j = a.j AND e.i = a.i % 24 + 1 JOIN g w ON w.j = a.j AND w.i = (a.i + 22) % 24 + 1 LEFT JOIN g n ON n.j = a.j + 1 AND n.i = a.i LEFT JOIN g s ON s.j = a.j - 1 AND s.i = a.i
LEFT JOIN g ne ON ne.j = a.j + 1 AND ne.i = e.i LEFT JOIN g nw ON nw.j = a.j + 1 AND nw.i = w.i LEFT JOIN g se ON se.j = a.j - 1 AND se.i = e.i LEFT JOIN g sw ON sw.j = a.j - 1 AND sw.i = w.i),
b AS (SELECT dst, src, CASE WHEN di = 0 THEN 1 - p * p * (3 - 2 * p) ELSE p * p * (3 - 2 * p) END AS vi, CASE WHEN di = 0 THEN p * (p - 1) * (p - 1) ELSE p * p * (p - 1) END AS si,
CASE WHEN dj = 0 THEN 1 - q * q * (3 - 2 * q) ELSE q * q * (3 - 2 * q) END AS vj, CASE WHEN dj = 0 THEN q * (q - 1) * (q - 1) ELSE q * q * (q - 1) END AS sj FROM c)
SELECT dst, round(sum(vi * vj * v + si * vj * gi + vi * sj * gj + si * sj * gij), 6) AS y FROM b JOIN e ON src = cell GROUP BY 1""")
def bicubic_rectilinear(spark, d):
    src, dst = regular_grid(spark, 24, 12), _customers(spark, d)
    field = weights.gradients(src.withColumn("v", analytic_field(F.col("lon"), F.col("lat"))), 24, 12)
    got = remap.apply_higher_order(weights.bicubic_weights(dst, 24, 12), field, [("w1", "v"), ("w2", "gi"), ("w3", "gj"), ("w4", "gij")])
    return rounded(got)


@query(f"""WITH g AS {_CUSTOMERS} SELECT cell, round(2 - cos(acos(greatest(-1.0, least(1.0, cos(radians(lat)) * cos(radians(lon))))) / 1.2), 6) AS v FROM g""")
def analytic_values(spark, d):
    return _customers(spark, d).select("cell", r(analytic_field(F.col("lon"), F.col("lat"))).alias("v"))


@query("""SELECT n_nationkey * 5 + r_regionkey + 1 AS cell, n_nationkey AS a, r_regionkey AS b FROM nation, region""")
def grid_product(spark, d):
    a = table(spark, d, "nation").select(F.col("n_nationkey").alias("a"))
    b = table(spark, d, "region").select(F.col("r_regionkey").alias("b"))
    return product_grid({"a": a, "b": b}).select(F.col("cell").cast("long").alias("cell"), "a", "b")


# ---------------------------------------------------------------- time


def puts(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    t = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))
    return e.select("event_id", F.col("event_type").alias("field"), F.col("user_id").alias("cell"), t.alias("t"), F.col("value").alias("v"))


_PUTS = "WITH p AS (SELECT event_id, event_type AS field, user_id AS cell, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS t, value AS v FROM events) "
DT = 21600


def _loctrans(transform: str, sql: str, lag: int = 0, name: str | None = None) -> None:
    def run(spark, d):
        return rounded(timewin.loctrans(puts(spark, d), transform, DT, lag), 5)

    run.__name__ = name or f"loctrans_{transform.lower().removeprefix('t_')}"
    query(_PUTS + f"SELECT field, cell, CAST(ceil((t + {lag}) / {DT}.0) AS BIGINT) * {DT} AS t, round({sql}(v), 5) AS v FROM p GROUP BY 1, 2, 3")(run)


_loctrans("AVERAGE", "avg")
_loctrans("ACCUMUL", "sum")
_loctrans("T_MIN", "min")
_loctrans("T_MAX", "max")
_loctrans("AVERAGE", "avg", 3600, "lag_shift")


@query(_PUTS + "SELECT field, cell, t, round(v, 6) AS v FROM p WHERE t % 60 = 0")
def loctrans_instant(spark, d):
    return rounded(timewin.loctrans(puts(spark, d), "INSTANT", 60))


@query(_PUTS + f"""SELECT w, count(DISTINCT field) AS n_fields, count(DISTINCT field) = 3 AS ready FROM (SELECT field, CAST(ceil(t / {DT}.0) AS BIGINT) AS w FROM p
WHERE field IN ('view', 'click', 'purchase')) GROUP BY 1""")
def readiness_barrier(spark, d):
    return timewin.ready(puts(spark, d), ["view", "click", "purchase"], DT)


@query(_PUTS + """, w AS (SELECT DISTINCT field, CAST(ceil(t / 3600.0) AS BIGINT) AS w FROM p), b AS (SELECT *, lag(w) OVER (PARTITION BY field ORDER BY w) AS before FROM w)
SELECT field, w, before, w - before - 1 AS n_missed FROM b WHERE w > before + 1""")
def missed_period(spark, d):
    return timewin.missed(puts(spark, d), 3600)


@query(_PUTS + """, b AS (SELECT *, max(t) OVER (PARTITION BY field ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM p)
SELECT field, count(*) AS n_backward FROM b WHERE t < seen GROUP BY 1""")
def backward_time(spark, d):
    return timewin.backward(puts(spark, d), "event_id").groupBy("field").agg(F.count("*").alias("n_backward"))


@query(_PUTS + """SELECT event_id, CASE WHEN (t + 3600) % 21600 = 0 AND t + 3600 = 1296000 THEN 6 WHEN t + 3600 >= 1296000 THEN 0 WHEN (t + 3600) % 21600 = 0 THEN 4 ELSE 5 END AS code FROM p""")
def return_codes(spark, d):
    return puts(spark, d).select("event_id", timewin.return_code(F.col("t"), DT, 3600, 1296000).alias("code"))


@query(_PUTS + "SELECT field, cell, t, count(*) AS n FROM p GROUP BY 1, 2, 3 HAVING count(*) > 1")
def repeated_exchange(spark, d):
    return timewin.repeated(puts(spark, d))


def steps(spark, d) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("cell").orderBy("event_id"))
    return puts(spark, d).select("cell", "event_id", "v", F.round("v").cast("long").alias("k")).withColumn("step", place)


_STEPS = _PUTS + """, s AS (SELECT cell, v, CAST(round(v) AS BIGINT) AS k, row_number() OVER (PARTITION BY cell ORDER BY event_id) AS step FROM p),
a AS (SELECT cell, CAST(floor((step - 1) / 5) AS BIGINT) AS cycle, sum(v) AS s, CAST(sum(k) AS BIGINT) AS k, count(*) AS n FROM s GROUP BY 1, 2) """


@query(_STEPS + "SELECT cell, cycle, round(s, 5) AS v FROM a")
def accumulator_sum(spark, d):
    return rounded(timewin.accumulate(steps(spark, d), 5, "SUM"), 5)


@query(_STEPS + "SELECT cell, cycle, round(CASE WHEN n = 5 THEN s / 5 ELSE s END, 5) AS v FROM a")
def accumulator_avg(spark, d):
    return rounded(timewin.accumulate(steps(spark, d), 5, "AVG"), 5)


@query(_STEPS + "SELECT cell, cycle, CASE WHEN n = 5 THEN CAST(trunc(k / 5.0) AS BIGINT) ELSE k END AS k FROM a")
def accumulator_int_avg(spark, d):
    return timewin.accumulate(steps(spark, d), 5, "AVG", value="k", integer=True)


# ---------------------------------------------------------------- tables


def _folder(spark, name: str) -> str:
    return f"{tables.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _products_of_stored(spark, d, owned: DataFrame) -> DataFrame:
    """A map of two weights a link, written, read again by the owner of some targets, and applied to the prices of parts."""
    folder = _folder(spark, "weights")
    both = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("dst"), F.col("l_partkey").alias("src"), "l_discount", "l_tax")
    tables.write_weights(both, folder, "lines", ("l_discount", "l_tax"))
    read, n = tables.read_weights(spark, folder, "lines", owned), tables.dealt(both)
    # no task sorts or sums more as the map grows, and parts do not go through the driver
    read = read.repartition(n, "src").join(parts(spark, d).hint("merge"), F.col("src") == F.col("cell"))
    terms = read.select("dst", *[(F.col("w")[i] * F.col("price")).alias(name) for i, name in enumerate("yz")]).repartition(n, "dst")
    return rounded(terms.groupBy("dst").agg(*[F.sum(name).alias(name) for name in "yz"]), 4)


@query("SELECT l_orderkey AS dst, round(sum(l_discount * p_retailprice), 4) AS y, round(sum(l_tax * p_retailprice), 4) AS z FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' GROUP BY 1")
def weights_stored(spark, d):
    """A map of two weights a link, written, and read again by the owner of some targets."""
    return _products_of_stored(spark, d, table(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("dst")))


@query(_PUTS + "SELECT cell, round(avg(v), 5) AS v FROM p WHERE field = 'view' AND CAST(ceil(t / 86400.0) AS BIGINT) * 86400 = 1296000 GROUP BY 1")
def input_at_time(spark, d):
    """What a run put out, read by another at exactly one time."""
    folder = _folder(spark, "output")
    tables.append_output(timewin.loctrans(puts(spark, d), "AVERAGE", 86400), folder)
    return rounded(tables.read_input(spark, folder, "view", 1296000), 5)


@query("SELECT p_partkey AS cell, p_retailprice AS area, CAST(p_size AS DOUBLE) AS mask FROM part")
def grid_written_once(spark, d):
    """A variable that a grid has already stays as it was first written."""
    folder, cells = _folder(spark, "grids"), parts(spark, d)
    tables.write_grid(cells.withColumnRenamed("price", "area"), folder, "parts", ("area",))
    tables.write_grid(cells.select("cell", F.lit(0.0).alias("area"), F.col("size").alias("mask")), folder, "parts", ("area", "mask"))
    return tables.read_grid(spark, folder, "parts", ("area", "mask"))


@query(_PUTS + f"SELECT field, cell, CAST(ceil(t / {DT}.0) AS BIGINT) * {DT} AS t, round(avg(v), 5) AS v FROM p GROUP BY 1, 2, 3")
def window_restart(spark, d):
    """A run that ends within a window leaves sums and counts; the next one completes the window."""
    end, folder = 1_000_000, _folder(spark, "restart")
    held = puts(spark, d)
    first, last = timewin.partial(held.where(F.col("t") < end), DT), -(-end // DT)
    tables.write_restart(first.where(F.col("w") == last), folder, "events", "loctrans")
    again = tables.read_restart(spark, folder, "events", "loctrans").withColumn("w", F.lit(last).cast("long"))
    later = timewin.partial(held.where(F.col("t") >= end), DT)
    return rounded(timewin.completed(first.where(F.col("w") < last).unionByName(again).unionByName(later), DT), 5)


# ---------------------------------------------------------------- streams

DELAY = 600


def _stream(spark, d) -> DataFrame:
    """The puts as a stream of the events file."""
    schema = table(spark, d, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    t = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))
    return e.select("event_id", F.col("event_type").alias("field"), F.col("user_id").alias("cell"), t.alias("t"), F.col("value").alias("v"))


_CLOSED = f"WHERE t <= (SELECT max(t) - 1 - {DELAY} FROM p)"


@query(_PUTS + f", a AS (SELECT field, cell, CAST(ceil(t / {DT}.0) AS BIGINT) * {DT} AS t, round(avg(v), 5) AS v FROM p GROUP BY 1, 2, 3) SELECT * FROM a {_CLOSED}")
def stream_average(spark, d):
    return rounded(windows.drain(windows.loctrans(_stream(spark, d), "AVERAGE", DT, delay=DELAY), _folder(spark, "stream")), 5)


@query(_PUTS + "SELECT field, cell, t, round(v, 6) AS v FROM p WHERE t % 60 = 0")
def stream_instant(spark, d):
    return rounded(windows.drain(windows.loctrans(_stream(spark, d), "INSTANT", 60), _folder(spark, "stream")))


@query(_PUTS + f"""SELECT w, n_fields, n_fields = 3 AS ready FROM (SELECT CAST(ceil(t / {DT}.0) AS BIGINT) AS w, count(DISTINCT field) AS n_fields FROM p WHERE field IN ('view', 'click', 'purchase') GROUP BY 1)
WHERE w * {DT} <= (SELECT max(t) - 1 - {DELAY} FROM p WHERE field IN ('view', 'click', 'purchase'))""")
def stream_barrier(spark, d):
    return windows.drain(windows.ready(_stream(spark, d), ["view", "click", "purchase"], DT, delay=DELAY), _folder(spark, "stream"))


@query(_PUTS + """, h AS (SELECT *, event_id * 7919 % 1000003 AS place FROM p), b AS (SELECT *, max(t) OVER (PARTITION BY field, cell ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM h)
SELECT field, cell, t, seen FROM b WHERE t < seen""")
def stream_backward(spark, d):
    """Puts that are called in another order than that of their times."""
    # places that two puts share are called in the order of the events
    stream = _stream(spark, d).withColumn("place", F.col("event_id") * 7919 % 1_000_003)
    return windows.drain(windows.backward(stream, "place", "event_id"), _folder(spark, "stream"))


# ---------------------------------------------------------------- decompositions


def _keys(spark, d) -> DataFrame:
    """The orders of each customer, a part, as points in the order of their keys."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("part"), k.alias("pos"), k.alias("index"))


_SEGMENTS = """WITH k AS (SELECT o_custkey AS part, o_orderkey AS i FROM orders),
g AS (SELECT part, i, i - row_number() OVER (PARTITION BY part ORDER BY i) AS run FROM k),
seg AS (SELECT part, min(i) AS start, count(*) AS length FROM g GROUP BY part, run) """


@query(_SEGMENTS + "SELECT part, start, length FROM seg")
def points_to_segments(spark, d):
    return partition.points(_keys(spark, d))


@query("SELECT 0 AS part, j * 100 + 11 AS start, 40 AS length FROM (SELECT unnest(range(0, count(*) // 100)) AS j FROM orders)")
def box_partition(spark, d):
    """A box of 40 columns in rows of 100 orders."""
    return partition.box(spark, 10, 40, table(spark, d, "orders").count() // 100, 100)


@query("SELECT 1 AS part, count(*) // 3 + 1 AS start, count(*) // 2 AS length FROM orders")
def apple_partition(spark, d):
    n = table(spark, d, "orders").count()
    return partition.apple(spark, n // 3, n // 2, 1)


@query("SELECT 0 AS part, CAST(1 AS BIGINT) AS start, count(*) AS length FROM orders")
def serial_partition(spark, d):
    return partition.serial(spark, table(spark, d, "orders").count())


@query("SELECT c_nationkey AS part, c_custkey * 10 + 1 AS start, c_custkey % 4 AS length FROM customer WHERE c_custkey % 4 > 0")
def orange_partition(spark, d):
    c = table(spark, d, "customer").select("c_nationkey", (F.col("c_custkey") * 10).alias("offset"), (F.col("c_custkey") % 4).alias("length"))
    return partition.orange(c, F.col("c_nationkey"))


@query("SELECT p AS part, p * n // 7 + 1 AS start, (p + 1) * n // 7 - p * n // 7 AS length FROM range(0, 7) t(p), (SELECT count(*) AS n FROM orders)")
def block_partition(spark, d):
    return partition.blocks(spark, table(spark, d, "orders").count(), 7)


@query(_SEGMENTS + "SELECT part, row_number() OVER (PARTITION BY part ORDER BY i) AS pos, i AS index FROM k")
def ordered_points(spark, d):
    return partition.ordered_points(partition.points(_keys(spark, d)))


@query(_SEGMENTS + "SELECT part, count(*) AS n_segments, CAST(sum(length) AS BIGINT) AS n_points, max(start + length - 1) AS last_index FROM seg GROUP BY 1")
def segment_stats(spark, d):
    return partition.statistics(partition.points(_keys(spark, d)))


@query(_SEGMENTS + "SELECT o_orderkey AS index, part FROM orders JOIN seg ON o_orderkey BETWEEN start AND start + length - 1")
def owner_lookup(spark, d):
    return partition.owners(partition.points(_keys(spark, d)), table(spark, d, "orders").select(F.col("o_orderkey").alias("index")))


@query(_SEGMENTS + """SELECT o_orderkey AS index, k.part, coalesce(pos, -1) AS local FROM orders LEFT JOIN
(SELECT part, i, row_number() OVER (PARTITION BY part ORDER BY i) AS pos FROM k) k ON o_orderkey = i""")
def global_to_local(spark, d):
    return partition.local_index(partition.points(_keys(spark, d)), table(spark, d, "orders").select(F.col("o_orderkey").alias("index")))


@query(_SEGMENTS + """, b AS (SELECT p AS part, p * n // 7 + 1 AS start, (p + 1) * n // 7 - p * n // 7 AS length FROM range(0, 7) t(p), (SELECT max(o_orderkey) AS n FROM orders))
SELECT seg.part AS part_a, b.part AS part_b, greatest(seg.start, b.start) AS start,
least(seg.start + seg.length, b.start + b.length) - greatest(seg.start, b.start) AS length FROM seg JOIN b ON least(seg.start + seg.length, b.start + b.length) > greatest(seg.start, b.start)""")
def segment_overlap(spark, d):
    return partition.overlap(partition.points(_keys(spark, d)), partition.blocks(spark, table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0], 7))


@query("SELECT false AS haloed")
def halo_test(spark, d):
    return partition.haloed(partition.points(_keys(spark, d)))


# the same over all orders: none is left out, gaps come from dealing each stretch of 1,000 orders by priority


def _dealt(spark, d) -> DataFrame:
    """Every order as a point, indices from 1; a stretch of 1,000 orders is dealt to five parts by the order's priority."""
    k, priority = F.col("o_orderkey"), F.substring("o_orderpriority", 1, 1).cast("long")
    return table(spark, d, "orders").select((F.expr("o_orderkey div 1000") * 5 + priority - 1).alias("part"), k.alias("pos"), (k + 1).alias("index"))


def _wanted(spark, d) -> DataFrame:
    return table(spark, d, "orders").select((F.col("o_orderkey") + 1).alias("index"))


_DEALT = """WITH k AS (SELECT o_orderkey // 1000 * 5 + CAST(substr(o_orderpriority, 1, 1) AS BIGINT) - 1 AS part, o_orderkey + 1 AS i FROM orders),
g AS (SELECT part, i, i - row_number() OVER (PARTITION BY part ORDER BY i) AS run FROM k),
seg AS (SELECT part, min(i) AS start, count(*) AS length FROM g GROUP BY part, run) """


@query(_DEALT + "SELECT part, start, length FROM seg")
def order_segments(spark, d):
    return partition.points(_dealt(spark, d))


@query(_DEALT + "SELECT part, row_number() OVER (PARTITION BY part ORDER BY i) AS pos, i AS index FROM k")
def order_points(spark, d):
    return partition.ordered_points(partition.points(_dealt(spark, d)))


@query(_DEALT + "SELECT part, count(*) AS n_segments, CAST(sum(length) AS BIGINT) AS n_points, max(start + length - 1) AS last_index FROM seg GROUP BY 1")
def order_segment_stats(spark, d):
    return partition.statistics(partition.points(_dealt(spark, d)))


@query(_DEALT + "SELECT i AS index, part FROM k")
def order_owners(spark, d):
    return partition.owners(partition.points(_dealt(spark, d)), _wanted(spark, d))


@query(_DEALT + "SELECT i AS index, part, row_number() OVER (PARTITION BY part ORDER BY i) AS local FROM k")
def order_local_index(spark, d):
    return partition.local_index(partition.points(_dealt(spark, d)), _wanted(spark, d))


@query(_DEALT + """, n AS (SELECT max(i) AS n FROM k), b AS (SELECT p AS part, p * n // 7 + 1 AS start, (p + 1) * n // 7 - p * n // 7 AS length FROM n, range(0, 7) t(p))
SELECT seg.part AS part_a, b.part AS part_b, greatest(seg.start, b.start) AS start,
least(seg.start + seg.length, b.start + b.length) - greatest(seg.start, b.start) AS length FROM seg JOIN b ON least(seg.start + seg.length, b.start + b.length) > greatest(seg.start, b.start)""")
def order_overlap(spark, d):
    n = _wanted(spark, d).agg(F.max("index")).first()[0] or 0
    return partition.overlap(partition.points(_dealt(spark, d)), partition.blocks(spark, n, 7))


@query(_DEALT + "SELECT coalesce(max(start + length - 1 >= after), false) AS haloed FROM (SELECT *, lead(start) OVER (ORDER BY start) AS after FROM seg)")
def order_halo(spark, d):
    return partition.haloed(partition.points(_dealt(spark, d)))


@query("""SELECT l_orderkey AS dst, round(sum(l_discount * p_retailprice), 4) AS y, round(sum(l_tax * p_retailprice), 4) AS z FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1""")
def weights_of_finished(spark, d):
    """As ``weights_stored``, read again for the orders of one status."""
    return _products_of_stored(spark, d, table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("dst")).distinct())


@query("SELECT l_orderkey AS cell, round(sum(l_quantity), 3) AS q FROM lineitem GROUP BY 1")
def rearrange_sum(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cell"), F.col("l_quantity").alias("q"))
    return rounded(partition.rearrange(rows, ["q"], add=True), 3)


# ---------------------------------------------------------------- columns, lists, strings


@query("SELECT p_partkey, round(p_retailprice * 1.5 - 10, 6) AS p_retailprice FROM part")
def affine_scale(spark, d):
    return rounded(batch.affine(table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 1.5, -10.0))


@query("SELECT p_partkey, p_retailprice AS price, p_size AS size FROM part")
def copy_rename(spark, d):
    return batch.copied(table(spark, d, "part"), {"p_retailprice": "price", "p_size": "size"}, ["p_partkey"])


@query("SELECT i AS cell, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b, 0 AS k FROM range(1, 101) t(i)")
def zero_batch(spark, d):
    return batch.zero_batch(spark, 100, ["a", "b"], ["k"])


@query("SELECT 'doc_id' AS name")
def shared_columns(spark, d):
    names = batch.shared_columns(table(spark, d, "documents").drop("text"), table(spark, d, "labels"))
    return spark.createDataFrame([(n,) for n in names], "name string")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_brand, p_partkey) AS place FROM part")
def multi_key_sort(spark, d):
    return batch.permutation(table(spark, d, "part"), [("p_size", True), ("p_brand", False)], "p_partkey")


@query("""SELECT p_brand, p_partkey, p_retailprice, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS INTEGER) AS rank FROM part) WHERE rank <= 3""")
def topk_nearest(spark, d):
    return batch.top_k(table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice"), 3, "p_retailprice", ["p_brand"], "p_partkey")


def _lists(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.concat_ws(":", F.lit("T"), "n_name", F.lit("U")).alias("a"), F.concat_ws(":", F.lit("U"), F.lit("V"), "n_name").alias("b"))


@query("""SELECT n_nationkey, 'T:' || n_name || ':U:V' AS joined, n_name || ':U' AS shared, 'T:' || n_name || ':U:V' AS merged, 'T:' || n_name || ':U:U:V:' || n_name AS appended,
CAST(2 AS BIGINT) AS place, 3 AS n, n_name AS second FROM nation""")
def list_algebra(spark, d):
    a, b = F.col("a"), F.col("b")
    return _lists(spark, d).select(
        "n_nationkey",
        fn.list_union(a, b).alias("joined"),
        fn.list_intersect(a, b).alias("shared"),
        fn.list_merge(a, b).alias("merged"),
        fn.list_append(a, b).alias("appended"),
        fn.list_index(a, F.element_at(fn.as_list(a), 2)).alias("place"),
        fn.list_count(a).alias("n"),
        fn.list_name(a, 2).alias("second"),
    )


@query("""SELECT e AS event_id, printf('%02d:%02d:%02d', CAST(e * 37 // 3600 AS BIGINT), CAST(e * 37 % 3600 // 60 AS BIGINT), CAST(e * 37 % 60 AS BIGINT)) AS hms
FROM (SELECT event_id % 2000 AS e FROM events)""")
def sec2hms(spark, d):
    e = (F.col("event_id") % 2000).alias("event_id")
    return table(spark, d, "events").select(e).select("event_id", fn.seconds_to_hms(F.col("event_id") * 37).alias("hms"))


@query("SELECT n_nationkey, 'days' AS unit, 19900100 + n_nationkey + 1 AS base_date, 3600 + n_nationkey * 60 AS base_seconds FROM nation")
def cf_time_unit(spark, d):
    u = F.format_string("days since 1990-01-%02d 01:%02d:00", F.col("n_nationkey") + 1, F.col("n_nationkey"))
    unit, date, seconds = fn.cf_time_unit(F.col("u"))
    return table(spark, d, "nation").select("n_nationkey", u.alias("u")).select("n_nationkey", unit.alias("unit"), date.alias("base_date"), seconds.alias("base_seconds"))


@query("""SELECT p_partkey, length(p_name) - length(replace(p_name, 'a', '')) AS n_a, CASE WHEN strpos(reverse(p_name), 'a') > 0 THEN length(p_name) - strpos(reverse(p_name), 'a') + 1 ELSE 0 END AS last_a,
regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g') AS alnum, upper(p_name) AS up FROM part""")
def string_functions(spark, d):
    s = F.col("p_name")
    return table(spark, d, "part").select(
        "p_partkey", fn.count_char(s, "a").alias("n_a"), fn.last_index(s, "a").cast("long").alias("last_a"), fn.alphanumeric(s).alias("alnum"), F.upper(s).alias("up")
    )


@query(f"""WITH s AS {_CUSTOMERS}, t AS (SELECT 10.0 AS lon, 20.0 AS lat) SELECT s.cell, round({_DISTANCE}, 6) AS d FROM s, t""")
def great_circle(spark, d):
    return _customers(spark, d).select("cell", r(weights.great_circle(F.col("lon"), F.col("lat"), F.lit(10.0), F.lit(20.0))).alias("d"))


# ---------------------------------------------------------------- one whole exchange


@query(_PUTS + """, a AS (SELECT field, cell + 1 AS cell, CAST(ceil(t / 21600.0) AS BIGINT) * 21600 AS t, avg(v) * 2 + 1 AS v FROM p GROUP BY 1, 2, 3),
l AS (SELECT c_custkey AS dst, c_custkey AS src, 0.5 + (c_custkey % 3) / 4.0 AS w FROM customer),
g AS (SELECT c_custkey AS cell, CAST(1 + c_custkey % 5 AS DOUBLE) AS area, CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS mask FROM customer),
m AS (SELECT field, t, dst AS cell, sum(w * v) AS v FROM l JOIN a ON src = cell GROUP BY 1, 2, 3),
ss AS (SELECT field, t, sum(v * area) AS ss FROM a JOIN g USING (cell) WHERE mask = 0 GROUP BY 1, 2),
sd AS (SELECT field, t, sum(v * area) AS sd, sum(area) AS wd FROM m JOIN g USING (cell) WHERE mask = 0 GROUP BY 1, 2)
SELECT m.field, m.t, m.cell, round((CASE WHEN mask = 0 THEN m.v - coalesce((sd - ss) / wd, 0) ELSE m.v END) * 0.5 + 3e-11, 9) AS v
FROM m JOIN g USING (cell) LEFT JOIN ss ON ss.field = m.field AND ss.t = m.t LEFT JOIN sd ON sd.field = m.field AND sd.t = m.t""")
def exchange_pipeline(spark, d):
    """All customers are cells, every user is a cell of its own."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    grid = c.select(k.alias("cell"), (1 + k % 5).cast("double").alias("area"), F.when(k % 7 == 0, 1).otherwise(0).alias("mask"))
    links_ = c.select(k.alias("dst"), k.alias("src"), (0.5 + (k % 3) / 4.0).alias("w"))
    fields = ("view", "click", "purchase", "signup", "error")
    entry = plan.Entry(fields, fields, DT, map_mode="sum", loctrans="AVERAGE", source_scale=(2.0, 1.0), target_scale=(0.5, 0.0), conserv="GLOBAL", conserv_mode="opt")
    sent = puts(spark, d).withColumn("cell", F.col("cell") + 1)
    # many values end with a 5 at the tenth digit; the small shift rounds them all up
    return plan.exchange(entry, sent, links_, grid, grid).withColumn("v", r(F.col("v") + 3e-11, 9))


# queries of these modules are registered with the others
from . import catalog_builders, catalog_runs  # noqa: E402, F401

