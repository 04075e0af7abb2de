"""Helpers that the operators of this subpackage share.

Nothing here collects rows: the helpers count, cut lineage in the shared
checkpoint folder and label connected components, all as Spark jobs.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of strings that a side may have before it is no longer broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and runs on one machine (tests) a
    temporary folder is set; on a cluster executors could not read it.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        held = sc._jsc.sc().getCheckpointDir()
    return held.get()


#: Whether Spark removes the shuffle files of an execution as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there.

    What was shuffled for it is removed then, so iterations don't fill the disks; nothing
    reads it again, as the checkpoint is a reliable one.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint()  # the setting holds for plans that are made under it
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def spare(df: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores before each that ``df`` already has (case does not count)."""
    held = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``bound`` rows and ``BROADCAST_BYTES`` of strings, else as it is.

    The caller has cut ``df``, so counting is cheap. Beyond the bound Spark
    joins by shuffle, where adaptive execution splits hot partitions.
    """
    strings = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    width = sum(strings, F.lit(0)).cast("long")
    held = df.limit(bound + 1).agg(F.count("*").alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if held["rows"] <= bound and held["bytes"] <= BROADCAST_BYTES else df


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """Connected components of ``edges``: one row (node, component) per node.

    ``component`` is the smallest node that can be reached. Rounds of
    large-star and small-star (Kiveris et al., 2014): every round reduces each
    neighbourhood to its minimum, by a combining aggregate and one join, so a
    hub of any degree is pre-aggregated and no neighbourhood is gathered. The
    rounds end when only stars are left, and each round is cut in the
    shared folder. An empty input gives an empty result; null ends and self
    links are dropped.
    """
    e = (
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    e = cut(e)
    for _ in range(max_rounds):
        # large star: each node's larger neighbours move to the node's minimum
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        # small star: each node's smaller neighbours, and itself, move to its minimum
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(
            large.join(low, "u")
            .select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        # all stars: no centre points on to another node
        if e.join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
