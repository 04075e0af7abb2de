"""Time transforms over coupling windows.

Window k holds the times with (k-1) dt < t + lag <= k dt, so a window closes on
the coupling lattice. Reductions are combining aggregates by (window, cell).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batch import ranged

TRANSFORMS = {"AVERAGE": F.avg, "ACCUMUL": F.sum, "T_MIN": F.min, "T_MAX": F.max}


def window_id(t: Column, dt: int, lag: int = 0) -> Column:
    return F.ceil((t + lag) / F.lit(float(dt))).cast("long")


def check_lag(dt: int, lag: int) -> None:
    if not -dt < lag <= dt:
        raise ValueError(f"lag {lag} is not within the period {dt}")


def check_values(transform: str, values: tuple[str, ...]) -> None:
    """Extremes are taken of one value array; of several it would not be clear which one's time counts."""
    if transform in ("T_MIN", "T_MAX") and len(values) > 1:
        raise ValueError(f"{transform} takes one value array, not {', '.join(values)}")


def loctrans(puts: DataFrame, transform: str, dt: int, lag: int = 0, keys: tuple[str, ...] = ("field", "cell"), values: tuple[str, ...] = ("v",)) -> DataFrame:
    """(keys, t, values): one value for each window and key, stamped with the lattice time it leaves at (t + lag = k dt)."""
    check_lag(dt, lag)
    check_values(transform, values)
    if transform == "INSTANT":
        return puts.where(F.pmod(F.col("t") + lag, F.lit(dt)) == 0).select(*keys, (F.col("t") + lag).alias("t"), *values)
    w = window_id(F.col("t"), dt, lag).alias("w")
    out = puts.select(*keys, w, *values).groupBy(*keys, "w").agg(*[TRANSFORMS[transform](v).alias(v) for v in values])
    return out.select(*keys, (F.col("w") * dt).alias("t"), *values)


@dataclass(frozen=True)
class Leg:
    """What one run of several gives: values delivered in it, and what it leaves for the next."""

    delivered: DataFrame  # keys, t, values
    ready: DataFrame  # keys, values, cnt: what the next leg delivers at its start
    carried: DataFrame  # keys, values, cnt: the window that the next leg completes


def leg(
    puts: DataFrame, transform: str, dt: int, lag: int, start: int, end: int, ready: DataFrame | None = None, carried: DataFrame | None = None, keys: tuple[str, ...] = ("field", "cell"), values: tuple[str, ...] = ("v",)
) -> Leg:
    """A run over [start, end), both on the lattice, of the puts in it and what the run before left.

    With a positive lag the first exchange is served from ``ready``, and what would leave at the end is left for the next run.
    Windows that the end cuts are left as sums (or extremes) and counts, of all value arrays.
    """
    check_lag(dt, lag)
    check_values(transform, values)
    if start % dt or end % dt or end <= start:
        raise ValueError(f"{start} and {end} are not on the lattice of {dt}")
    own = puts.where((F.col("t") >= start) & (F.col("t") < end))
    if transform == "INSTANT":
        own = own.where(F.pmod(F.col("t") + lag, F.lit(dt)) == 0)
    parts = partial(own, dt, lag, keys, transform, values)
    last = end // dt
    if carried is not None:
        before = carried.select(*keys, F.lit(start // dt + (1 if lag > 0 else 0)).cast("long").alias("w"), *values, "cnt")
        parts = _together(parts.unionByName(before), keys, transform, values)
    whole = F.col("w") < last if lag <= 0 else F.col("w") <= last
    done = completed(parts.where(whole), dt, keys, transform, values)
    out = done.where(F.col("t") < end)
    if ready is not None:
        out = out.unionByName(ready.select(*keys, F.lit(start).cast("long").alias("t"), *values))
    left = done.where(F.col("t") == end).select(*keys, *values, F.lit(1).cast("long").alias("cnt"))
    return Leg(out, left, parts.where(~whole).select(*keys, *values, "cnt"))


def within(puts: DataFrame, runtime: int) -> DataFrame:
    """The puts; one at or after the end of the run raises as soon as its row is read."""
    t = F.when(F.col("t") < runtime, F.col("t")).otherwise(F.raise_error(F.concat(F.lit(f"the run ends at {runtime}, a put is at "), F.col("t").cast("string"))).cast("long"))
    return puts.withColumn("t", t)


def aligned(gets: DataFrame, delivered: DataFrame, dt: int, keys: tuple[str, ...] = ("field", "cell")) -> DataFrame:
    """(gets, v, code): what each get (keys, t) receives: the value that leaves at its time. Codes as :func:`get_code`."""
    held = delivered.select(*keys, "t", "v", *[c for c in ("origin",) if c in delivered.columns])
    out = gets.join(held, [*keys, "t"], "left")
    origin = F.col("origin") if "origin" in delivered.columns else F.lit("put")
    return out.select(*gets.columns, "v", get_code(F.col("t"), dt, F.when(F.col("v").isNotNull(), origin)).alias("code"))


def get_code(t: Column, dt: int, origin: Column, writes: bool = False) -> Column:
    """What a get at ``t`` did, by where its value came from ("put", "restart", "input"): codes of the coupling interface (fixed values)."""
    received, from_restart, read_input, received_out, from_restart_out, ok = 3, 10, 11, 12, 13, 0
    on = F.pmod(t, F.lit(dt)) == 0
    return (
        F.when(~on | origin.isNull(), ok)
        .when(origin == "input", read_input)
        .when(origin == "restart", from_restart_out if writes else from_restart)
        .otherwise(received_out if writes else received)
    )


def blocked(gets: DataFrame, entries: DataFrame) -> DataFrame:
    """(entry, t, waits_for): gets (entry, t) that wait for an entry of lower SEQ whose exchange at or before ``t`` is still to come.

    ``entries``: (entry, seq, dt, last), ``last`` the time of the last exchange; a few rows, as a coupling has entries.
    """
    own = gets.join(F.broadcast(entries.select("entry", "seq")), "entry")
    others = entries.select(F.col("entry").alias("waits_for"), F.col("seq").alias("other"), F.col("dt").alias("d"), "last")
    due = F.floor(F.col("t") / F.col("d")) * F.col("d")
    return own.join(F.broadcast(others), F.col("other") < F.col("seq")).where(F.col("last") < due).select("entry", "t", "waits_for")


def ready(puts: DataFrame, fields: list[str], dt: int, lag: int = 0) -> DataFrame:
    """(w, n_fields, ready): an entry of several fields fires once all are there."""
    w = window_id(F.col("t"), dt, lag).alias("w")
    got = puts.where(F.col("field").isin(fields)).select(w, "field").groupBy("w").agg(F.count_distinct("field").alias("n_fields"))
    return got.withColumn("ready", F.col("n_fields") == len(fields))


def missed(puts: DataFrame, dt: int, keys: tuple[str, ...] = ("field",)) -> DataFrame:
    """(keys, w, before, n_missed): windows that follow a gap."""
    w = puts.select(*keys, window_id(F.col("t"), dt).alias("w")).distinct()
    before = F.lag("w").over(Window.partitionBy(*keys).orderBy("w"))
    return w.withColumn("before", before).where(F.col("w") > F.col("before") + 1).withColumn("n_missed", F.col("w") - F.col("before") - 1)


def backward(puts: DataFrame, order: str, keys: tuple[str, ...] = ("field",), ties: tuple[str, ...] = ()) -> DataFrame:
    """Puts that are earlier than one before them in calling order: the latest before them in their range of that
    order, or the latest of the ranges before. Equal places share a range, within which they go by ``ties``."""
    dealt = ranged(puts, order)
    before = (Window.unboundedPreceding, -1)
    here = F.max("t").over(Window.partitionBy("__range", *keys).orderBy(order, *ties).rowsBetween(*before))
    # one row for each range and key
    tops = dealt.groupBy("__range", *keys).agg(F.max("t").alias("__top"))
    earlier = tops.select("__range", *keys, F.max("__top").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(*before)).alias("__earlier"))
    # greatest leaves nulls out
    seen = dealt.withColumn("__here", here).join(earlier, ["__range", *keys]).withColumn("seen", F.greatest("__here", "__earlier"))
    return seen.where(F.col("t") < F.col("seen")).select(*puts.columns, "seen")


def repeated(puts: DataFrame, keys: tuple[str, ...] = ("field", "cell", "t")) -> DataFrame:
    return puts.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def return_code(t: Column, dt: int, lag: int, runtime: int, writes: bool = False) -> Column:
    """What a put at ``t`` does: codes of the coupling interface (fixed values)."""
    sent, loctrans_, to_restart_, sent_out, to_restart_out, ok = 4, 5, 6, 8, 9, 0
    at = t + lag
    on = F.pmod(at, F.lit(dt)) == 0
    return (
        F.when(on & (at == runtime) & (F.lit(lag) > 0), to_restart_out if writes else to_restart_)
        .when(at >= runtime, ok)
        .when(on, sent_out if writes else sent)
        .otherwise(loctrans_)
    )


def accumulate(steps: DataFrame, n_steps: int, action: str, value: str = "v", keys: tuple[str, ...] = ("cell",), integer: bool = False) -> DataFrame:
    """(keys, cycle, v) over cycles of ``n_steps``; an unfinished cycle keeps its running sum."""
    cycle = F.floor((F.col("step") - 1) / n_steps).cast("long").alias("cycle")
    out = steps.select(*keys, cycle, "step", value).groupBy(*keys, "cycle").agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    if action == "SUM":
        v = F.col("s")
    elif integer:
        # integer averages truncate
        v = F.when(F.col("n") == n_steps, F.expr(f"s div {n_steps}")).otherwise(F.col("s"))
    else:
        v = F.when(F.col("n") == n_steps, F.col("s") / n_steps).otherwise(F.col("s"))
    return out.select(*keys, "cycle", v.alias(value))


def partial(puts: DataFrame, dt: int, lag: int = 0, keys: tuple[str, ...] = ("field", "cell"), transform: str = "AVERAGE", values: tuple[str, ...] = ("v",)) -> DataFrame:
    """(keys, w, values, cnt): sums, or extremes, and counts of each window; what a run that ends within a window leaves behind."""
    w = window_id(F.col("t"), dt, lag).alias("w")
    return _together(puts.select(*keys, w, *values, F.lit(1).cast("long").alias("cnt")), keys, transform, values)


def _together(parts: DataFrame, keys: tuple[str, ...], transform: str, values: tuple[str, ...] = ("v",)) -> DataFrame:
    add = {"T_MIN": F.min, "T_MAX": F.max}.get(transform, F.sum)
    return parts.groupBy(*keys, "w").agg(*[add(v).alias(v) for v in values], F.sum("cnt").alias("cnt"))


def completed(parts: DataFrame, dt: int, keys: tuple[str, ...] = ("field", "cell"), transform: str = "AVERAGE", values: tuple[str, ...] = ("v",)) -> DataFrame:
    """(keys, t, values): the values of windows whose parts (keys, w, values, cnt) come from several runs."""
    out = _together(parts, keys, transform, values)
    return out.select(*keys, (F.col("w") * dt).alias("t"), *[(F.col(v) / F.col("cnt") if transform == "AVERAGE" else F.col(v)).alias(v) for v in values])
