"""Sparse matrices that stay where they are: links in buckets, so that one product after another moves no link.

A matrix is kept as two tables of the session's warehouse, in buckets by source and by target. A product picks one:

* by target, where the field is small enough to be sent to all tasks (its size is checked): a target's terms meet
  where its links are, and nothing but the field moves;
* by source, where it is not: the field is dealt to the links' buckets, terms are added for each target there, and
  only these partial sums move on.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a field that is sent to all tasks, at most.
SENT = 500_000


def _table(name: str, side: str) -> str:
    return f"matrix_{re.sub(r'[^0-9A-Za-z_]', '_', name)}_by_{side}"


def keep_matrix(links: DataFrame, name: str, buckets: int) -> None:
    """Keeps links (dst, src, w, ...) under a name, in place of what is there; ``buckets`` as many as a product is to have tasks."""
    for side in ("src", "dst"):
        # dealt as the buckets are, so that each has one file
        links.repartition(buckets, side).write.mode("overwrite").bucketBy(buckets, side).sortBy(side).saveAsTable(_table(name, side))


def strategy(field: DataFrame, bound: int = SENT) -> str:
    """"target" for a field of at most ``bound`` rows, else "source"."""
    return "target" if field.limit(bound + 1).count() <= bound else "source"


def product(spark: SparkSession, name: str, field: DataFrame, keys: tuple[str, ...] = (), value: str = "v", weight: str = "w", how: str | None = None) -> DataFrame:
    """(keys, dst, y): the kept matrix times a field (keys, cell, value)."""
    how = how or strategy(field)
    links = spark.table(_table(name, "dst" if how == "target" else "src"))
    x = field.select(*keys, F.col("cell").alias("src"), F.col(value).alias("__x"))
    # a join by shuffle: the hint keeps the links' buckets in use whatever the field's size
    terms = links.join(F.broadcast(x) if how == "target" else x.hint("merge"), "src")
    return terms.groupBy(*keys, "dst").agg(F.sum(F.col(weight) * F.col("__x")).alias("y"))
