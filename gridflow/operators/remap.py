"""Sparse interpolation: applying weights, higher orders, and checks of a matrix of links.

Links are rows (dst, src, w) or (dst, src, w1 .. wk). A product is one equi-join
and one combining aggregate; the optimizer chooses whether the field is
broadcast or shuffled, and partial sums are made before the shuffle on dst.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apply_weights(links: DataFrame, field: DataFrame, columns: dict[str, str], weight: str = "w", cell: str = "cell") -> DataFrame:
    """(dst, out columns): y = sum of w x over a target's links; ``columns`` maps source to target names."""
    sums = [F.sum(F.col(weight) * F.col(a)).alias(b) for a, b in columns.items()]
    return links.join(field, F.col("src") == F.col(cell)).groupBy("dst").agg(*sums)


def zero_filled(mapped: DataFrame, targets: DataFrame, columns: list[str], cell: str = "cell") -> DataFrame:
    """One row per target cell; targets without links get 0."""
    out = targets.select(cell).join(mapped, F.col(cell) == F.col("dst"), "left")
    return out.select(cell, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in columns])


def apply_higher_order(links: DataFrame, field: DataFrame, orders: list[tuple[str, str]], out: str = "y", cell: str = "cell") -> DataFrame:
    """(dst, out): the sum over (weight, value array) pairs; pairs that were never sent are left out by the caller."""
    term = sum((F.col(w) * F.col(v) for w, v in orders[1:]), F.col(orders[0][0]) * F.col(orders[0][1]))
    return links.join(field, F.col("src") == F.col(cell)).groupBy("dst").agg(F.sum(term).alias(out))


def ordered_apply(links: DataFrame, field: DataFrame, value: str, out: str = "y", cell: str = "cell", width: int = 4096) -> DataFrame:
    """As :func:`apply_weights`, but summed in the order of src for equal bits on any partitioning.

    Sums are made in order within ranges of ``width`` sources, and these are summed in order:
    a target of any number of sources is never gathered whole.
    """

    def summed(at: str) -> Column:
        return F.aggregate(F.sort_array(F.collect_list(F.struct(at, "x"))), F.lit(0.0), lambda a, t: a + t["x"])

    terms = links.join(field, F.col("src") == F.col(cell)).select("dst", F.floor(F.col("src") / width).alias("bin"), "src", (F.col("w") * F.col(value)).alias("x"))
    within = terms.groupBy("dst", "bin").agg(summed("src").alias("x"))
    return within.groupBy("dst").agg(summed("bin").alias(out))


def accumulate_links(links: DataFrame) -> DataFrame:
    """Links of the same (dst, src) added up."""
    return links.groupBy("dst", "src").agg(F.sum("w").alias("w"))


def row_sums(links: DataFrame) -> DataFrame:
    return links.groupBy("dst").agg(F.sum("w").alias("row_sum"))


def row_sum_check(links: DataFrame, valid: list[float], tolerance: float) -> DataFrame:
    """(dst, row_sum, valid): whether the row's sum is within the tolerance of a valid value."""
    near = F.lit(False)
    for v in valid:
        near = near | (F.abs(F.col("row_sum") - v) <= tolerance)
    return row_sums(links).withColumn("valid", near)


def statistics(links: DataFrame, n_rows: int, n_columns: int) -> DataFrame:
    """One row: number of elements, sparsity, ranges of rows and columns."""
    return links.agg(
        F.count("*").alias("n_elements"),
        (F.count("*") / F.lit(float(n_rows) * n_columns)).alias("sparsity"),
        F.min("dst").alias("first_row"),
        F.max("dst").alias("last_row"),
        F.min("src").alias("first_column"),
        F.max("src").alias("last_column"),
    )


def out_of_bounds(links: DataFrame, n_rows: int, n_columns: int) -> DataFrame:
    return links.where(~F.col("dst").between(1, n_rows) | ~F.col("src").between(1, n_columns))
