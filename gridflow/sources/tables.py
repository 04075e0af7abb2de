"""Sources and sinks of the data model: Parquet tables in a shared folder.

Tables are partitioned by what a read asks for (entry, field, map or grid), so
a read prunes to its own folders. A sink that replaces does so by partition:
what other entries, maps or grids wrote stays.

A leg of a run writes its records and restart values below its own name and commits them last, by a
row of the table of commits. Until then no read sees them, and a leg that is run again replaces what an attempt before has left.
"""

from __future__ import annotations

import math
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_folder

__all__ = [
    "append_output", "commit", "committed", "read_arrays", "read_grid", "read_input", "read_records", "read_restart", "read_weights", "resource", "shared_folder", "write_arrays", "write_grid", "write_restart", "write_weights",
]

#: Links that a task sorts, or so.
LINKS = 500_000
VALUES = ("v", "v2", "v3", "v4", "v5")
RESTART = f"cell long, {', '.join(f'{v} double' for v in VALUES)}, cnt long, entry string, kind string, at long, field string"
OUTPUT = "t long, cell long, v double, leg string, field string"
COMMITS = "end long, entry string, start long"
DIRECT = "-"  # the leg of records that no leg has written
WEIGHTS = "dst long, src long, w array<double>, map string"
GRID = "cell long, value double, grid string, variable string"


def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The table, or no rows where nothing has been written yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder)


def _replace(df: DataFrame, folder: str, *by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(folder)


def write_restart(rows: DataFrame, folder: str, entry: str, kind: str, whole: bool = False, at: int = 0) -> None:
    """Replaces the restart values at time ``at`` of this entry, kind and the fields that ``rows`` (field, cell, v[, v2 .. v5, cnt]) holds.

    ``whole``: of all fields, so that those without rows have no values from then on.
    """
    cnt = F.col("cnt") if "cnt" in rows.columns else F.lit(1)
    held = [F.col(v) if v in rows.columns else F.lit(None).cast("double").alias(v) for v in VALUES]
    rows = rows.select("cell", *held, cnt.cast("long").alias("cnt"), "field")
    if whole:
        # partition folders are named as Spark escapes them
        rows.write.mode("overwrite").partitionBy("field").parquet(f"{folder}/restart/entry={quote(entry, safe='')}/kind={quote(kind, safe='')}/at={at}")
    else:
        _replace(rows.withColumns({"entry": F.lit(entry), "kind": F.lit(kind), "at": F.lit(at)}), f"{folder}/restart", "entry", "kind", "at", "field")


def read_restart(spark: SparkSession, folder: str, entry: str, kind: str, required: bool = True, at: int = 0, values: tuple[str, ...] = ("v",)) -> DataFrame:
    """(field, cell, values, cnt) of an entry at time ``at``; raises if there are none and they are required. Value arrays that were not written are 0."""
    own = (F.col("entry") == entry) & (F.col("kind") == kind) & (F.col("at") == at)
    out = _read(spark, f"{folder}/restart", RESTART).where(own).select("field", "cell", *[F.coalesce(v, F.lit(0.0)).alias(v) if v != "v" else F.col(v) for v in values], "cnt")
    if required and out.isEmpty():
        raise LookupError(f"no restart values of {entry}, {kind} at {at} in {folder}")
    return out


def commit(spark: SparkSession, folder: str, entry: str, start: int, end: int) -> None:
    """From now on the records of the entry's leg over [start, end) can be read, and a leg can go on from its end."""
    spark.range(1).select(F.lit(end).cast("long").alias("end")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/commits/entry={quote(entry, safe='')}/start={start}")


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """(entry, start, end): a row for each leg that has been committed."""
    return _read(spark, f"{folder}/commits", COMMITS).select("entry", "start", "end")


def write_arrays(rows: DataFrame, folder: str, entry: str) -> None:
    """Replaces the small arrays of an entry, such as counters, by rows (name, place, i, r) of integers and reals."""
    values = rows.select("name", F.col("place").cast("long").alias("place"), F.col("i").cast("long").alias("i"), F.col("r").cast("double").alias("r"))
    values.coalesce(1).write.mode("overwrite").parquet(f"{folder}/arrays/entry={quote(entry, safe='')}")  # small: one file


def read_arrays(spark: SparkSession, folder: str, entry: str) -> DataFrame:
    """(name, place, i, r) of an entry."""
    rows = _read(spark, f"{folder}/arrays", "name string, place long, i long, r double, entry string")
    return rows.where(F.col("entry") == entry).select("name", "place", "i", "r")


def append_output(values: DataFrame, folder: str, entry: str | None = None, start: int = 0) -> None:
    """Adds (field, t, cell, v) to the records of its fields.

    With an ``entry``, as the records of its leg from ``start``: they replace those that an earlier attempt of the
    leg has written, and are there to be read once the leg is committed.
    """
    rows = values.select("t", "cell", "v", "field")
    if entry is None:
        rows.withColumn("leg", F.lit(DIRECT)).write.mode("append").partitionBy("leg", "field").parquet(f"{folder}/records")
    else:
        rows.write.mode("overwrite").partitionBy("field").parquet(f"{folder}/records/leg={quote(f'{entry}@{start}', safe='')}")


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """(field, t, cell, v) of all records that can be read."""
    legs = committed(spark, folder).select(F.concat("entry", F.lit("@"), "start").alias("leg"))
    rows = _read(spark, f"{folder}/records", OUTPUT)
    direct = rows.where(F.col("leg") == DIRECT)
    return direct.unionByName(rows.join(legs, "leg", "left_semi")).select("field", "t", "cell", "v")


def read_input(spark: SparkSession, folder: str, field: str, t: int) -> DataFrame:
    """(cell, v) of a field at exactly ``t``; raises if there is no such record."""
    return read_records(spark, folder, (field,), t, t + 1, 1).select("cell", "v")


def read_records(spark: SparkSession, folder: str, fields: tuple[str, ...], start: int, end: int, dt: int) -> DataFrame:
    """(field, t, cell, v) at start, start + dt, ... before ``end``, in one scan; raises if a field has no record at one of these times."""
    on = (F.col("t") >= start) & (F.col("t") < end) & ((F.col("t") - start) % dt == 0)
    out = _records(spark, folder).where(F.col("field").isin(*fields) & on)
    wanted = spark.range(start, end, dt).select(F.explode(F.array(*map(F.lit, fields))).alias("field"), F.col("id").alias("t"))
    # a few of what is missing
    missing = wanted.join(out.select("field", "t").distinct(), ["field", "t"], "left_anti").limit(3).collect()
    if missing:
        raise LookupError(f"no record of {', '.join(f'{r.field} at {r.t}' for r in missing)} in {folder}")
    return out


def resource(spark: SparkSession, path: str) -> DataFrame:
    """(key, line, place, token) of a text file of "key: tokens" lines and "key::" tables that end with "::".

    ``line`` counts the lines of a table from 1 (1 for a single line), ``place`` the tokens of a line from 1. Blank lines and what
    follows a # count for nothing. Tokens are strings; cast them to what they are. The file is a small one: it is
    read as one row, so that its lines have an order.
    """
    text = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"(?m)^(?=[ \t]*[A-Za-z]\S*?::?(?:\s|$))")).alias("block"))
    block = text.select(F.regexp_replace("block", "(?m)#.*$", "").alias("block"), F.regexp_extract("block", r"^\s*([A-Za-z][^\s:]*)(::?)", 1).alias("key"), (F.regexp_extract("block", r"^\s*([A-Za-z][^\s:]*)(::?)", 2) == "::").alias("many"))
    body = F.regexp_replace("block", r"^\s*[A-Za-z][^\s:]*::?", "")
    held = F.when(F.col("many"), F.split(F.regexp_extract(body, r"(?s)^(.*?)(?:^|\n)[ \t]*::", 1), "\n")).otherwise(F.slice(F.split(body, "\n"), 1, 1))
    lines = block.where("key <> ''").select("key", F.posexplode(F.filter(F.transform(held, lambda x: F.trim(x)), lambda x: x != "")).alias("line", "words"))
    return lines.select("key", (F.col("line") + 1).alias("line"), F.posexplode(F.split("words", r"\s+")).alias("place", "token")).select("key", "line", (F.col("place") + 1).alias("place"), "token")


def dealt(links: DataFrame) -> int:
    """Tasks for a shuffle of as many links as ``links`` has, so that the share that a task sorts does not grow; no fewer than the session's, or a join would deal them anew."""
    return max(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(links.count() / LINKS))


def write_weights(links: DataFrame, folder: str, name: str, columns: tuple[str, ...] = ("w",)) -> None:
    """Replaces the map ``name`` by (dst, src, one or more weights), in ranges of targets: a file, and a part of it, tells which it has."""
    links = links.repartitionByRange(max(1, math.ceil(links.count() / LINKS)), "dst", "src").sortWithinPartitions("dst", "src")
    _replace(links.select("dst", "src", F.array(*[F.col(c).cast("double") for c in columns]).alias("w"), F.lit(name).alias("map")), folder, "map")


def read_weights(spark: SparkSession, folder: str, name: str, owned: DataFrame | None = None) -> DataFrame:
    """(dst, src, w array) of a map, of the targets in ``owned`` (dst) alone if that is given; of these, files outside of their range are not read."""
    out = _read(spark, folder, WEIGHTS).where(F.col("map") == name).select("dst", "src", "w")
    if owned is None:
        return out
    ends = owned.agg(F.min("dst").alias("lo"), F.max("dst").alias("hi")).first()
    out = out.where(F.col("dst").between(ends["lo"], ends["hi"]))
    n = dealt(out)
    return out.repartition(n, "dst").join(owned.select("dst").repartition(n, "dst").hint("merge"), "dst", "left_semi")


def write_grid(cells: DataFrame, folder: str, name: str, variables: tuple[str, ...]) -> None:
    """Adds variables of a grid; one that is there already stays as it is."""
    spark = cells.sparkSession
    values = cells.select("cell", *[F.col(v).cast("double").alias(v) for v in variables]).unpivot("cell", list(variables), "variable", "value")
    held = _read(spark, folder, GRID).where(F.col("grid") == name).select("variable").distinct()
    new = values.join(F.broadcast(held), "variable", "left_anti")  # a row for each variable that was asked for
    new.select("cell", "value", F.lit(name).alias("grid"), "variable").write.mode("append").partitionBy("grid", "variable").parquet(folder)


def read_grid(spark: SparkSession, folder: str, name: str, variables: tuple[str, ...]) -> DataFrame:
    """(cell, a column for each variable); raises if a variable has not been written."""
    rows = _read(spark, folder, GRID).where((F.col("grid") == name) & F.col("variable").isin(*variables))
    missing = set(variables) - {r[0] for r in rows.select("variable").distinct().collect()}  # at most as many as were asked for
    if missing:
        raise LookupError(f"grid {name} has no {', '.join(sorted(missing))}")
    return rows.groupBy("cell").pivot("variable", list(variables)).agg(F.first("value"))
