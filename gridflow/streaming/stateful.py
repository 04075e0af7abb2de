"""Coupling windows over a stream as state: legs of a run that go on from it, and a last window that closes.

An open window of a (field, cell) is kept as the sums (or extremes) and the count of its puts, of up to five value arrays, by a streaming
aggregation, and is sent once the watermark is past its end. The state lives in the stream's checkpoint: a
stream that stops within a window goes on with it, :func:`left_open` reads it back as restart values, and :func:`windows` starts from such values.

The end of a run is a row of a clock stream (:func:`with_clock`), which moves the watermark past the last window without a put.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.batch import fingerprint
from ..operators.timewin import TRANSFORMS, check_lag, check_values
from ..shared import shared_folder
from .windows import EARLIEST, event_time, origin

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLOCK = "clock"  # the field of clock rows
_ADD = {"T_MIN": F.min, "T_MAX": F.max}


def windows(puts: DataFrame, transform: str, dt: int, lag: int = 0, delay: int = 0, values: tuple[str, ...] = ("v",), begin: DataFrame | None = None) -> DataFrame:
    """(field, cell, t, values) of each window of the stream ``puts`` (field, cell, t, values), once it has closed.

    ``begin``: windows that a run before has left open, as rows (field, cell, w, values, cnt). Puts of windows that have closed are late and dropped.
    """
    check_lag(dt, lag)
    check_values(transform, values)
    if transform not in TRANSFORMS:
        raise ValueError(f"no windows for {transform}")
    cnt = F.when(F.col("field").eqNullSafe(CLOCK), 0).otherwise(1).cast("long").alias("cnt")
    rows = puts.select("field", "cell", event_time(dt, lag).alias("at"), *values, cnt)
    if begin is not None:
        # at the first second of their window: no put of it is late for them
        at = F.timestamp_seconds((F.col("w") - 1) * dt + origin(dt)).alias("at")
        rows = rows.unionByName(_as_stream(begin.select("field", "cell", at, *[F.col(v).cast("double").alias(v) for v in values], F.col("cnt").cast("long").alias("cnt"))))
    add = _ADD.get(transform, F.sum)
    spans = rows.withWatermark("at", f"{delay} seconds").groupBy(F.window("at", f"{dt} seconds").alias("span"), "field", "cell")
    held = spans.agg(*[add(v).alias(v) for v in values], F.sum("cnt").alias("cnt"))
    out = [(F.col(v) / F.col("cnt") if transform == "AVERAGE" else F.col(v)).alias(v) for v in values]
    # rows of the clock are left out by their count: a condition on their field would be pushed below the watermark, which they move
    return held.where("cnt > 0").select("field", "cell", (F.unix_seconds("span.end") - origin(dt)).alias("t"), *out)


def _as_stream(rows: DataFrame) -> DataFrame:
    """The rows as a stream of a table in the shared folder that is known by its content: a stream that goes on in another process finds it there."""
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/begin-{fingerprint(rows).replace(':', '_')}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        rows.write.mode("overwrite").parquet(folder)
    return spark.readStream.schema(rows.schema).parquet(folder)


def with_clock(puts: DataFrame, folder: str, values: tuple[str, ...] = ("v",)) -> DataFrame:
    """The stream with the rows of the clock in ``folder``; it stands still until :func:`tick`."""
    spark = puts.sparkSession
    spark.createDataFrame([], "t long").write.mode("ignore").parquet(folder)
    clock = spark.readStream.schema("t long").parquet(folder)
    rows = clock.select(F.lit(CLOCK).alias("field"), F.lit(-1).cast("long").alias("cell"), "t", *[F.lit(0.0).alias(v) for v in values])
    return puts.select("field", "cell", "t", *values).unionByName(rows)


def tick(spark: SparkSession, folder: str, t: int) -> None:
    """Nothing at or before ``t`` is still to come."""
    spark.range(1).select(F.lit(t).cast("long").alias("t")).coalesce(1).write.mode("append").parquet(folder)


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """What the stream has given up to what is there now, written below ``folder``; a call with the same folder goes on from the state of the last."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def left_open(spark: SparkSession, folder: str, values: tuple[str, ...] = ("v",)) -> DataFrame:
    """(field, cell, w, values, cnt): the windows that are open in the state of a stream of these values that has been drained to ``folder``."""
    rows = spark.read.format("statestore").option("path", f"{folder}/state").load()
    end, start = F.unix_seconds("key.window.end"), F.unix_seconds("key.window.start")
    # windows count from the run's start, which lies on their lattice
    w = (F.ceil(end / (end - start)) - F.ceil(F.lit(EARLIEST) / (end - start))).cast("long").alias("w")
    # the state has its values in their order, without names
    held = F.col("value").cast(f"struct<{', '.join(f'{v}: double' for v in values)}, cnt: bigint>").alias("held")
    return rows.select("key.field", "key.cell", w, held).select("field", "cell", "w", "held.*").where("cnt > 0")
