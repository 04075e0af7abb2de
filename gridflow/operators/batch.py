"""Algebra of named columns: copies with new names, shared columns, scaling, sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut


def zero_batch(spark, n: int, reals: list[str], ints: list[str] = ()) -> DataFrame:
    return spark.range(1, n + 1).select(F.col("id").alias("cell"), *[F.lit(0.0).alias(c) for c in reals], *[F.lit(0).alias(c) for c in ints])


def copied(batch: DataFrame, names: dict[str, str], keep: list[str] = ()) -> DataFrame:
    """``keep`` and the columns of ``names`` under their new names."""
    return batch.select(*keep, *[F.col(a).alias(b) for a, b in names.items()])


def shared_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Names that both have with the same type, in the order of ``a``."""
    other = dict(b.dtypes)
    return [n for n, kind in a.dtypes if other.get(n) == kind]


def affine(batch: DataFrame, column: str, factor: float = 1.0, offset: float = 0.0) -> DataFrame:
    return batch.withColumn(column, F.col(column) * factor + offset)


def ranged(batch: DataFrame, order: str, bins: int | None = None) -> DataFrame:
    """The batch with ``__range``, the place of the range of the number ``order`` that a row is in.

    Bounds are quantiles of the column, fixed in the plan: ranges hold about equally many rows, equal values share one,
    and all uses of the result see the same ranges. Nulls are in the first. There are as many ranges as the session has shuffle partitions.
    """
    bins = bins or max(2, int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted(set(batch.approxQuantile(order, [k / bins for k in range(1, bins)], 1 / (4 * bins))))
    place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(order))) if bounds else F.lit(0)
    return batch.withColumn("__range", place)


def running(batch: DataFrame, order: list[Column], value: Column, out: str, bins: int | None = None) -> DataFrame:
    """The batch with ``out``: the sum of the integer ``value`` over the rows up to each, in ``order`` (which must have no ties).

    Rows are range-partitioned, once, and summed within their range; the sums of the ranges before are added, so
    no single task sorts all rows. There are as many ranges as the session has shuffle partitions.
    """
    bins = bins or int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(batch.withColumn("__value", value.cast("long")).repartitionByRange(bins, *order).withColumn("__part", F.spark_partition_id()))
    up_to = F.sum("__value").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    # a row for each range
    sums = dealt.groupBy("__part").agg(F.sum("__value").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = dealt.withColumn("__k", up_to).join(F.broadcast(sums.select("__part", before.alias("__before"))), "__part")
    return whole.withColumn(out, F.col("__before") + F.col("__k")).drop("__value", "__part", "__k", "__before")


def fingerprint(rows: DataFrame) -> str:
    """What rows are in a table, whatever their order and partitions: equal tables have equal fingerprints."""
    h = F.xxhash64(*[F.col(c) for c in sorted(rows.columns)])
    one = rows.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(28,0)")).alias("sum"), F.bit_xor(F.xxhash64(h)).alias("mixed")).first()
    return f"{one['n']}:{one['sum'] or 0}:{one['mixed'] or 0}"


def by(keys: list[tuple[str, bool]], tie: str) -> list[Column]:
    return [F.col(c).desc() if down else F.col(c).asc() for c, down in keys] + [F.col(tie).asc()]


def permutation(batch: DataFrame, keys: list[tuple[str, bool]], tie: str = "cell", bins: int | None = None) -> DataFrame:
    """(tie, place): each row's place in the order of ``keys`` (name, descending) and then ``tie``."""
    narrow = batch.select(tie, *[c for c, _ in keys if c != tie])
    return running(narrow, by(keys, tie), F.lit(1), "place", bins).select(tie, "place")


def permuted(batch: DataFrame, places: DataFrame, cell: str = "cell") -> DataFrame:
    """The batch with every row renumbered to its place in ``places`` (cell, place)."""
    return batch.join(places, cell).withColumn(cell, F.col("place")).drop("place")


def unpermuted(batch: DataFrame, places: DataFrame, cell: str = "cell") -> DataFrame:
    """The batch that :func:`permuted` was given."""
    back = places.select(F.col("place").alias("__at"), F.col(cell).alias("__was"))
    return batch.join(back, F.col(cell) == F.col("__at")).withColumn(cell, F.col("__was")).drop("__at", "__was")


def in_order(batch: DataFrame, keys: list[tuple[str, bool]], cell: str = "cell") -> DataFrame:
    """The batch renumbered in the order of ``keys`` and then of its numbers."""
    return permuted(batch, permutation(batch, keys, cell), cell)


def rank_merge(a: DataFrame, b: DataFrame, key: str, cell: str = "cell") -> DataFrame:
    """(side, cell, place): places of both lists' rows in one merged order by ``key``; equal keys of ``a`` come first."""
    both = a.select(F.lit(0).alias("side"), cell, key).unionByName(b.select(F.lit(1).alias("side"), cell, key))
    return running(both, [F.col(key), F.col("side"), F.col(cell)], F.lit(1), "place").select("side", cell, "place")


def unique(batch: DataFrame, key: str, cell: str = "cell") -> DataFrame:
    """(key, cell): the first row of each run of equal keys."""
    return batch.groupBy(key).agg(F.min(cell).alias(cell))


def bin_index(batch: DataFrame, key: str) -> DataFrame:
    """(key, start, n): where each key's rows begin, from 1, if rows are sorted by key, and how many they are."""
    counted = batch.groupBy(key).agg(F.count("*").alias("n"))
    return running(counted, [F.col(key)], F.col("n"), "end").select(key, (F.col("end") - F.col("n") + 1).alias("start"), "n")


def column_counts(batch: DataFrame) -> DataFrame:
    """One row: rows, real columns, integer columns (but for ``cell``)."""
    kinds = [k for c, k in batch.dtypes if c != "cell"]
    reals, ints = sum(k in ("double", "float") for k in kinds), sum(k in ("int", "bigint", "smallint", "tinyint") for k in kinds)
    return batch.agg(F.count("*").alias("n_rows"), F.lit(reals).alias("n_reals"), F.lit(ints).alias("n_ints"))


def position(batch: DataFrame, name: str, strict: bool = True) -> int:
    """The place of a column among those of its kind, from 1; 0, or an error if ``strict``, where it is not there."""
    kind = dict(batch.dtypes).get(name)
    if kind is None:
        if strict:
            raise LookupError(f"no column {name}")
        return 0
    return [c for c, k in batch.dtypes if c != "cell" and k == kind].index(name) + 1


def shared_places(a: DataFrame, b: DataFrame) -> list[tuple[str, int, int]]:
    """(name, place in a, place in b) of the shared columns, in the order of ``a``."""
    return [(c, position(a, c), position(b, c)) for c in shared_columns(a, b)]


def appended(batch: DataFrame, reals: list[str] = (), ints: list[str] = ()) -> DataFrame:
    """The batch with new columns of zeros; names that it has are an error."""
    taken = set(batch.columns) & {*reals, *ints}
    if taken:
        raise ValueError(f"already there: {', '.join(sorted(taken))}")
    return batch.withColumns({c: F.lit(0.0) for c in reals} | {c: F.lit(0) for c in ints})


def exported(batch: DataFrame, column: str, cell: str = "cell") -> DataFrame:
    """(cell, v) of one column."""
    return batch.select(cell, F.col(column).alias("v"))


def imported(batch: DataFrame, vector: DataFrame, column: str, cell: str = "cell") -> DataFrame:
    """The batch with ``column`` taken from (cell, v); rows that the vector lacks keep theirs."""
    held = batch.join(vector.select(cell, F.col("v").alias("__v")), cell, "left")
    return held.select(*[F.coalesce("__v", column).alias(column) if c == column else F.col(c) for c in batch.columns])


def check_masks(batch: DataFrame, ints: list[str], reals: list[str]) -> DataFrame:
    """One row: how many values are out of {0, 1} and out of [0, 1]."""
    def wrong(c: str, bad: Column) -> Column:
        return F.count_if(bad).alias(f"bad_{c}")

    return batch.agg(*[wrong(c, ~F.col(c).isin(0, 1)) for c in ints], *[wrong(c, ~F.col(c).between(0, 1)) for c in reals])


def masked_strictly(batch: DataFrame, ints: list[str], reals: list[str]) -> DataFrame:
    """The batch as it is; a mask out of its range raises as soon as its row is read."""
    def held(c: str, ok: Column) -> Column:
        return F.when(ok, F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"mask {c} is out of range: "), F.col(c).cast("string"))).cast(dict(batch.dtypes)[c])).alias(c)

    checked = {c: held(c, F.col(c).isin(0, 1)) for c in ints} | {c: held(c, F.col(c).between(0, 1)) for c in reals}
    return batch.select(*[checked.get(c, F.col(c)) for c in batch.columns])


def top_k(batch: DataFrame, k: int, by: str, keys: list[str], tie: str) -> DataFrame:
    """The k smallest of each group; ties go to the smaller ``tie``."""
    order = Window.partitionBy(*keys).orderBy(by, tie)
    return batch.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
