"""Coupling windows over a stream of puts, with Structured Streaming's own state.

``puts`` has (field, cell, t, v), ``t`` in whole seconds since the run's start.
Event-time windows are closed on the left; a put counts one second earlier than
it is stamped, so that they become the coupling windows (k-1) dt < t + lag <= k dt.
A stream's watermark begins at 1970 and drops what is not later, so the run's start is put at :func:`origin`, far after it.
A window is sent once the watermark has passed its end and then leaves the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.timewin import TRANSFORMS, check_lag


#: Seconds that puts may lie before the run's start.
EARLIEST = 1 << 31


def origin(dt: int) -> int:
    """The event time, in seconds, of the run's start: on the lattice of ``dt``."""
    return -(-EARLIEST // dt) * dt


def event_time(dt: int, lag: int) -> Column:
    """When a put counts: a second earlier than it is stamped, as windows are closed at their end."""
    return F.timestamp_seconds(F.col("t") + lag - 1 + origin(dt))


def _timed(puts: DataFrame, dt: int, lag: int, delay: int) -> tuple[DataFrame, Column]:
    check_lag(dt, lag)
    at = event_time(dt, lag)
    return puts.withColumn("at", at).withWatermark("at", f"{delay} seconds"), F.window("at", f"{dt} seconds").alias("span")


def loctrans(puts: DataFrame, transform: str, dt: int, lag: int = 0, delay: int = 0, keys: tuple[str, ...] = ("field", "cell")) -> DataFrame:
    """(keys, t, v) of each closed window, stamped with the lattice time; INSTANT has no state."""
    if transform == "INSTANT":
        check_lag(dt, lag)
        return puts.where(F.pmod(F.col("t") + lag, F.lit(dt)) == 0).select(*keys, (F.col("t") + lag).alias("t"), "v")
    timed, span = _timed(puts, dt, lag, delay)
    out = timed.groupBy(span, *keys).agg(TRANSFORMS[transform]("v").alias("v"))
    return out.select(*keys, (F.unix_seconds("span.end") - origin(dt)).alias("t"), "v")


def ready(puts: DataFrame, fields: list[str], dt: int, lag: int = 0, delay: int = 0) -> DataFrame:
    """(w, n_fields, ready) of each closed window: an entry of several fields fires once all are there.

    The state of a window is a set of at most ``len(fields)`` names.
    """
    timed, span = _timed(puts.where(F.col("field").isin(fields)), dt, lag, delay)
    got = timed.groupBy(span).agg(F.size(F.collect_set("field")).cast("long").alias("n_fields"))
    return got.select(((F.unix_seconds("span.end") - origin(dt)) / dt).cast("long").alias("w"), "n_fields", (F.col("n_fields") == len(fields)).alias("ready"))


def backward(puts: DataFrame, *order: str) -> DataFrame:
    """(field, cell, t, seen): puts that are earlier than one before them, by ``order`` within a batch.

    The state of a (field, cell) is its latest time.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(list(order))
        known = state.get[0] if state.exists else rows["t"].iloc[0]
        seen = rows["t"].cummax().shift(fill_value=known).clip(lower=known)
        state.update((int(max(known, rows["t"].max())),))
        late = rows["t"] < seen
        yield pd.DataFrame({"field": key[0], "cell": key[1], "t": rows["t"][late], "seen": seen[late]})

    out = "field string, cell long, t long, seen long"
    return puts.groupBy("field", "cell").applyInPandasWithState(run, out, "latest long", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """What the stream gives for all input that is there now, written below ``folder``.

    The checkpoint beside the output makes a run that is started again go on where it ended.
    """
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
