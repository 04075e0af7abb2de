"""Reductions, spatial integrals and averages, merges and conservation.

All are combining aggregates: partial sums are made before the one shuffle. A
global correction joins a one-row aggregate back, which Spark broadcasts.
"""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exact import exact_sums

ACTIONS = {"SUM": F.sum, "MIN": F.min, "MAX": F.max}


def local_reduce(batch: DataFrame, action: str, columns: list[str]) -> DataFrame:
    return batch.agg(*[ACTIONS[action](c).alias(c) for c in columns])


def all_reduce(batch: DataFrame, action: str, columns: list[str], cell: str = "cell") -> DataFrame:
    """Point by point over replicas."""
    return batch.groupBy(cell).agg(*[ACTIONS[action](c).alias(c) for c in columns])


def weighted_sum(batch: DataFrame, weight: Column, columns: list[str], weight_sum: str | None = "weight_sum") -> DataFrame:
    out = [F.sum(F.col(c) * weight).alias(c) for c in columns]
    return batch.agg(*out, *([F.sum(weight).alias(weight_sum)] if weight_sum else []))


def masked_weight(weight: Column, int_masks: list[str] = (), real_masks: list[str] = ()) -> Column:
    """The weight times all masks (here 1 means active, as in merges and integrals)."""
    return fold(lambda w, m: w * F.col(m), [*int_masks, *real_masks], weight)


def spatial_integral(batch: DataFrame, weight: Column, columns: list[str]) -> DataFrame:
    return weighted_sum(batch, weight, columns, None)


def spatial_average(batch: DataFrame, weight: Column, columns: list[str], null_if_empty: bool = False) -> DataFrame:
    """Integrals over the sum of weights; a zero sum raises, or gives null by option."""
    total = F.sum(weight)
    safe = F.try_divide if null_if_empty else (lambda a, b: a / b)
    return batch.agg(*[safe(F.sum(F.col(c) * weight), total).alias(c) for c in columns])


def paired(first: DataFrame, second: DataFrame, names: tuple[str, str] = ("first", "second")) -> DataFrame:
    """Two reductions in one table, a row each."""
    return first.withColumn("side", F.lit(names[0])).unionByName(second.withColumn("side", F.lit(names[1])))


def diagnostics(batch: DataFrame, columns: list[str]) -> DataFrame:
    """(field, min, max, sum) over all points, without mask or weight."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("v")) for c in columns])).alias("p")
    return batch.select(pairs).groupBy("p.field").agg(F.min("p.v").alias("vmin"), F.max("p.v").alias("vmax"), F.sum("p.v").alias("vsum"))


def merge(sources: list[tuple[DataFrame, list[str]]], columns: list[str], cell: str = "cell", strict: bool = True) -> DataFrame:
    """Points' weighted means over sources; a source's weight is the product of its masks (1 without).

    The sources are stacked and summed by cell, so any number of them costs one
    shuffle. A zero sum of weights raises, or gives null if not ``strict``.
    """
    parts = []
    for batch, masks in sources:
        w = masked_weight(F.lit(1.0), masks)
        parts.append(batch.select(cell, w.alias("w"), *[(F.col(c) * w).alias(c) for c in columns]))
    total = fold(DataFrame.unionByName, parts).groupBy(cell).agg(F.sum("w").alias("weight_sum"), *[F.sum(c).alias(c) for c in columns])
    safe = (lambda a, b: a / b) if strict else F.try_divide
    return total.select(cell, *[safe(F.col(c), F.col("weight_sum")).alias(c) for c in columns], "weight_sum")


CONSERVATION = ("GLOBAL", "GLBPOS", "BASBAL", "BASPOS")


def sums(batch: DataFrame, prefix: str, value: str = "v", keys: tuple[str, ...] = (), mode: str = "opt") -> DataFrame:
    """(keys, <prefix>s, <prefix>w): active points' value times area, and area; one row without keys.

    Mode "bfb" gives equal bits on any partitioning, "opt" adds as rows come.
    """
    active = F.col("mask") == 0
    if mode == "bfb":
        # masked points count as 0, so that a group of them has a row
        parts = {f"{prefix}s": F.when(active, F.col(value) * F.col("area")), f"{prefix}w": F.when(active, F.col("area"))}
        out = exact_sums(batch, {n: F.coalesce(c, F.lit(0.0)) for n, c in parts.items()}, keys)
        return out.select(*keys, *[F.coalesce(n, F.lit(0.0)).alias(n) for n in parts])
    return batch.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(active, F.col(value) * F.col("area"))), F.lit(0.0)).alias(f"{prefix}s"),
        F.coalesce(F.sum(F.when(active, F.col("area"))), F.lit(0.0)).alias(f"{prefix}w"),
    )


def correction(mode: str, ss: Column, ws: Column, sd: Column, wd: Column) -> tuple[Column, Column]:
    """(factor, shift) that the target's active values take, from the sums and areas of source and target.

    GLOBAL and BASBAL share the difference by area, GLBPOS and BASPOS scale; the BAS modes compare means over the
    basins' areas. Zero areas or sums that the formula divides by raise when the rows are made, but scaling leaves the field
    alone if both sums are 0.
    """
    if mode not in CONSERVATION:
        raise ValueError(f"unknown mode {mode}")

    def sure(bad: Column, what: str, value: Column) -> Column:
        return F.when(bad, F.raise_error(F.lit(f"{mode}: {what} is 0")).cast("double")).otherwise(value)

    one, none = F.lit(1.0), F.lit(0.0)
    if mode == "GLOBAL":
        return one, sure(wd == 0, "the target's active area", F.try_divide(ss - sd, wd))
    if mode == "BASBAL":
        return one, sure((wd == 0) | (ws == 0), "an active area", F.try_divide(F.try_divide(ss * wd, ws) - sd, wd))
    scale = F.try_divide(ss, sd) * (F.try_divide(wd, ws) if mode == "BASPOS" else one)
    bad = (sd == 0) & (ss != 0) | ((ws == 0) if mode == "BASPOS" else F.lit(False))
    return sure(bad, "the target's sum" if mode == "GLBPOS" else "the target's sum or the source's area", F.when(sd == 0, one).otherwise(scale)), none


def conserve(src: DataFrame, dst: DataFrame, mode: str, value: str = "v", keys: tuple[str, ...] = (), how: str = "opt") -> DataFrame:
    """``dst`` with ``value`` corrected on active points so that the integrals agree, for each of ``keys`` by itself.

    ``how``: the integrals' mode, "bfb" or "opt", as in :func:`sums`.

    Of several groups, one that has no active target points has nothing to correct and stays as it is.
    """
    total, given = sums(dst, "b", value, keys, how), sums(src, "a", value, keys, how)
    both = total.join(given, list(keys), "left") if keys else total.crossJoin(given)
    held = [F.coalesce(c, F.lit(0.0)) for c in ("as", "aw", "bs", "bw")]
    factor, shift = correction(mode, *held)
    if keys:
        factor, shift = (F.when(held[3] == 0, F.lit(none)).otherwise(c) for c, none in ((factor, 1.0), (shift, 0.0)))
    fix = both.select(*keys, factor.alias("__factor"), shift.alias("__shift"))
    out = dst.join(fix, list(keys)) if keys else dst.crossJoin(F.broadcast(fix))  # one row without keys
    # masked rows look at the correction too, so that its guards speak where no row is active
    new = F.when(F.col("mask") == 0, F.col(value) * F.col("__factor") + F.col("__shift")).otherwise(F.col(value) + 0.0 * (F.col("__factor") + F.col("__shift")))
    return out.select(*[new.alias(value) if c == value else F.col(c) for c in dst.columns])


def running_merge(total: DataFrame | None, batch: DataFrame, masks: list[str], columns: list[str], cell: str = "cell") -> DataFrame:
    """(cell, columns, weight_sum): one more source added to a merge that is under way, as sums that are not divided yet."""
    w = masked_weight(F.lit(1.0), masks)
    more = batch.select(cell, *[(F.col(c) * w).alias(c) for c in columns], w.alias("weight_sum"))
    both = more if total is None else total.select(cell, *columns, "weight_sum").unionByName(more)
    return both.groupBy(cell).agg(*[F.sum(c).alias(c) for c in (*columns, "weight_sum")])


def merged(total: DataFrame, columns: list[str], cell: str = "cell", strict: bool = True) -> DataFrame:
    """The means of a running merge; a zero sum of weights raises, or gives null if not ``strict``."""
    safe = (lambda a, b: a / b) if strict else F.try_divide
    return total.select(cell, *[safe(F.col(c), F.col("weight_sum")).alias(c) for c in columns], "weight_sum")
