"""Sums that have the same bits on any partitioning.

A double is an integer times a power of two. It is split, without rounding, into at most four digits of ``WIDTH``
bits, each of which belongs to a bin of exponents. Digits of a bin are added as integers, so partial sums combine in any
order; carries between bins then give the one form that the total has, and this is rounded once for each sum. The shuffle
carries a row for each key and bin, of which doubles have fewer than a hundred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 24
_LOW, _HIGH = -1074 // WIDTH, 1023 // WIDTH
#: 2 ** (WIDTH / 2 * bin) of all bins, from the lowest on; its square may be out of a double's range.
_HALF = [2.0 ** (WIDTH // 2 * b) for b in range(_LOW, _HIGH + 2)]
_WIDE = "decimal(28,0)"


def _times(x: Column, bin_: Column, over: bool = False) -> Column:
    """x times 2 ** (WIDTH bin), or divided by it; exact wherever the result is a double."""
    half = F.get(F.array(*[F.lit(1 / h if over else h) for h in _HALF]), (bin_ - _LOW).cast("int"))
    return x * half * half


def with_digits(rows: DataFrame, x: str) -> DataFrame:
    """``rows`` with __digits [(bin, digit)]: those that are not 0 of the finite double ``x``."""
    size = F.abs(x)
    guess = F.greatest(F.lit(_LOW), F.least(F.lit(_HIGH), F.floor(F.log2(size) / WIDTH)))
    # a logarithm may be rounded over the edge of a bin
    off = F.when(_times(size, F.col("__top"), True) >= 2.0**WIDTH, 1).when(_times(size, F.col("__top"), True) < 1, -1).otherwise(0)
    out = rows.withColumn("__top", guess.cast("int")).withColumn("__top", F.greatest(F.lit(_LOW), F.col("__top") + off)).withColumn("__rest", F.col(x))
    pairs = []
    for k in range(4):
        bin_ = F.greatest(F.lit(_LOW), F.col("__top") - k)
        out = out.withColumn(f"__d{k}", _times(F.col("__rest"), bin_, True).cast("long"))
        out = out.withColumn("__rest", F.col("__rest") - _times(F.col(f"__d{k}").cast("double"), bin_))
        pairs.append(F.struct(bin_.alias("bin"), F.col(f"__d{k}").alias("digit")))
    digits = F.filter(F.array(*pairs), lambda d: d["digit"] != 0)
    return out.withColumn("__digits", digits).drop("__top", "__rest", *[f"__d{k}" for k in range(4)])


def rounded_total(bins: Column) -> Column:
    """The double that [(bin, digit)] stands for: carries go up from the lowest bin, and digits, all of one sign, are then added in that order."""
    base = F.lit(1 << WIDTH).cast("decimal(10,0)")
    held = F.map_from_entries(bins)
    low, high = F.array_min(F.map_keys(held)), F.array_max(F.map_keys(held))

    def walked(sign: int) -> Column:
        def step(got: Column, b: Column) -> Column:
            all_ = (F.coalesce(F.element_at(held, b) * sign, F.lit(0).cast(_WIDE)) + got["carry"]).cast(_WIDE)
            carry = F.floor(all_ / base).cast(_WIDE)
            return F.struct(carry.alias("carry"), (got["sum"] + _times((all_ - carry * base).cast("double"), b)).alias("sum"))

        start = F.struct(F.lit(0).cast(_WIDE).alias("carry"), F.lit(0.0).alias("sum"))
        done = lambda got: F.when(got["carry"] >= 0, sign * (got["sum"] + _times(got["carry"].cast("double"), high + 1)))
        return F.aggregate(F.sequence(low, high), start, step, done)

    # a negative total ends with a negative carry; its opposite does not
    return F.coalesce(walked(1), walked(-1))


def exact_sums(rows: DataFrame, sums: dict[str, Column], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, a sum for each name of ``sums``); null where a group has no value, as ``sum`` gives.

    Infinities and NaN give what ``sum`` gives. A group without any value has no row; without keys there is one row, even of an empty table.
    """
    each = rows.select(*keys, F.posexplode(F.array(*[c.cast("double") for c in sums.values()])).alias("__k", "__x")).where("__x IS NOT NULL")
    finite = F.abs("__x") < float("inf")
    split = with_digits(each.withColumns({"__odd": F.when(~finite, F.col("__x")), "__x": F.when(finite, F.col("__x")).otherwise(0.0)}), "__x")
    long = split.select(*keys, "__k", "__odd", F.explode_outer("__digits").alias("__d"))
    by_bin = long.groupBy(*keys, "__k", F.col("__d.bin").alias("__bin")).agg(F.sum(F.col("__d.digit").cast("decimal(10,0)")).cast(_WIDE).alias("__digit"), F.sum("__odd").alias("__odd"))
    bins = F.collect_list(F.when(F.col("__bin").isNotNull(), F.struct("__bin", "__digit")))  # as many as there are exponents
    got = by_bin.groupBy(*keys, "__k").agg(bins.alias("__bins"), F.sum("__odd").alias("__odd"))
    one = got.select(*keys, "__k", F.coalesce("__odd", F.when(F.size("__bins") > 0, rounded_total(F.col("__bins"))).otherwise(0.0)).alias("__y"))
    return one.groupBy(*keys).agg(*[F.max(F.when(F.col("__k") == i, F.col("__y"))).alias(n) for i, n in enumerate(sums)])
