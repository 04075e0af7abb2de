"""Index decompositions as tables of segments (part, start, length), indices from 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batch import fingerprint, ranged, running


def _segments(df: DataFrame) -> DataFrame:
    return df.select("part", F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length")).where("length > 0")


def serial(spark: SparkSession, n: int, part: int = 0) -> DataFrame:
    return _segments(spark.range(1).select(F.lit(part).alias("part"), F.lit(1).alias("start"), F.lit(n).alias("length")))


def apple(spark: SparkSession, offset: int, n: int, part: int = 0) -> DataFrame:
    return _segments(spark.range(1).select(F.lit(part).alias("part"), F.lit(offset + 1).alias("start"), F.lit(n).alias("length")))


def box(spark: SparkSession, offset: int, nx: int, ny: int, stride: int, part: int = 0) -> DataFrame:
    return _segments(spark.range(ny).select(F.lit(part).alias("part"), (F.col("id") * stride + offset + 1).alias("start"), F.lit(nx).alias("length")))


def replicated(segments: DataFrame, parts: int) -> DataFrame:
    """The same segments for each of ``parts`` parts."""
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    return segments.select(every, "start", "length")


def at_root(segments: DataFrame, root: int = 0) -> DataFrame:
    """All segments owned by one part."""
    return segments.select(F.lit(root).alias("part"), "start", "length")


def increasing(segments: DataFrame) -> DataFrame:
    """(part, increasing): whether a part's segments, in the order of ``pos``, begin later and later."""
    before = F.lag("start").over(Window.partitionBy("part").orderBy("pos"))
    steps = segments.withColumn("__before", before)
    return steps.groupBy("part").agg(F.coalesce(F.min(F.col("start") > F.col("__before")), F.lit(True)).alias("increasing"))


def sorted_segments(segments: DataFrame, bins: int | None = None) -> DataFrame:
    """(place, part, start, length): all segments numbered in the order of their starts, then parts."""
    return running(segments.select("part", "start", "length"), [F.col("start"), F.col("part"), F.col("length")], F.lit(1), "place", bins).select("place", "part", "start", "length")


def block_of(index: Column, n: int, parts: int) -> Column:
    """The part of the default blocks that holds an index from 1; -1 if none does."""
    p = F.floor(((index - 1) * parts + parts - 1) / n)
    # the block after, or before, where rounding down starts it elsewhere
    low = lambda x: F.floor(x * n / parts)
    p = F.when(low(p) > index - 1, p - 1).when(low(p + 1) <= index - 1, p + 1).otherwise(p)
    return F.when((index >= 1) & (index <= n), p).otherwise(F.lit(-1)).cast("int")


def bounds_of(segments: DataFrame) -> DataFrame:
    """(part, first, last): the lowest and highest index of each part of a block map."""
    return segments.groupBy("part").agg(F.min("start").alias("first"), F.max(F.col("start") + F.col("length") - 1).alias("last"))


def as_blocks(segments: DataFrame) -> DataFrame:
    """A block map of segments that cover 1 .. n in the order of their parts: one segment for each part; others raise."""
    whole = bounds_of(segments).join(segments.groupBy("part").agg(F.sum("length").alias("n")), "part")
    ok = F.col("last") - F.col("first") + 1 == F.col("n")
    length = F.when(ok, F.col("n")).otherwise(F.raise_error(F.concat(F.lit("not one block: part "), F.col("part").cast("string"))).cast("long"))
    return whole.select("part", F.col("first").alias("start"), length.alias("length"))


def orange(pieces: DataFrame, part: Column) -> DataFrame:
    """Segments of rows (offset, length); empty ones are dropped."""
    return _segments(pieces.select(part.alias("part"), (F.col("offset") + 1).alias("start"), "length"))


def points(indices: DataFrame, part: str = "part", order: str = "pos", index: str = "index") -> DataFrame:
    """Runs of indices that follow each other in list order (gaps and islands)."""
    w = Window.partitionBy(part).orderBy(order)
    step = F.when(F.col(index) == F.lag(index).over(w) + 1, 0).otherwise(1)
    runs = indices.withColumn("__new", step).withColumn("__run", F.sum("__new").over(w))
    return runs.groupBy(F.col(part).alias("part"), "__run").agg(F.min(index).alias("start"), F.count("*").alias("length")).select("part", "start", "length")


def blocks(spark: SparkSession, n: int, parts: int) -> DataFrame:
    """The default 1-D decomposition: nearly equal contiguous blocks."""
    p = F.col("id")
    low = F.floor(p * n / parts)
    return _segments(spark.range(parts).select(p.cast("int").alias("part"), (low + 1).alias("start"), (F.floor((p + 1) * n / parts) - low).alias("length")))


def ordered_points(segments: DataFrame) -> DataFrame:
    """(part, pos, index): every index with its place in its part, segments in order of start.

    The place adds the lengths of the segments before, so no part's points meet.
    """
    before = F.coalesce(F.sum("length").over(Window.partitionBy("part").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = segments.withColumn("before", before).select("part", "before", F.posexplode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("k", "index"))
    return out.select("part", (F.col("before") + F.col("k") + 1).alias("pos"), "index")


def statistics(segments: DataFrame) -> DataFrame:
    return segments.groupBy("part").agg(F.count("*").alias("n_segments"), F.sum("length").alias("n_points"), F.max(F.col("start") + F.col("length") - 1).alias("last_index"))


def owners(segments: DataFrame, indices: DataFrame, width: int = 1024, index: str = "index") -> DataFrame:
    """(index, part) of the segments that hold each index: an equi-join on ranges of ``width``."""
    s = segments.withColumn("bin", F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"(start + length - 1) div {width}"))))
    q = indices.select(F.col(index).alias("index")).withColumn("bin", F.expr(f"index div {width}"))
    return q.join(s, "bin").where(F.col("index").between(F.col("start"), F.col("start") + F.col("length") - 1)).select("index", "part")


def local_index(segments: DataFrame, indices: DataFrame) -> DataFrame:
    """(index, part, local): the position within the owner's points, -1 where nobody owns the index."""
    before = F.coalesce(F.sum("length").over(Window.partitionBy("part").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = owners_with(segments.withColumn("before", before), indices)
    found = held.select("index", "part", (F.col("before") + F.col("index") - F.col("start") + 1).alias("local"))
    return indices.select("index").distinct().join(found, "index", "left").select("index", "part", F.coalesce("local", F.lit(-1)).cast("long").alias("local"))


def owners_with(segments: DataFrame, indices: DataFrame, width: int = 1024) -> DataFrame:
    s = segments.withColumn("bin", F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"(start + length - 1) div {width}"))))
    q = indices.select("index").distinct().withColumn("bin", F.expr(f"index div {width}"))
    return q.join(s, "bin").where(F.col("index").between(F.col("start"), F.col("start") + F.col("length") - 1)).drop("bin")


def overlap(a: DataFrame, b: DataFrame, width: int = 1024) -> DataFrame:
    """(part_a, part_b, start, length) of the indices that segments of both share: the transfer lists."""
    def binned(s: DataFrame, x: str) -> DataFrame:
        bins = F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"(start + length - 1) div {width}"))).alias("bin")
        return s.select(F.col("part").alias(f"part_{x}"), F.col("start").alias(f"s{x}"), (F.col("start") + F.col("length") - 1).alias(f"e{x}"), bins)

    lo, hi = F.greatest("sa", "sb"), F.least("ea", "eb")
    met = binned(a, "a").join(binned(b, "b"), "bin").where((lo <= hi) & (F.col("bin") == F.expr(f"greatest(sa, sb) div {width}")))
    return met.select("part_a", "part_b", lo.alias("start"), (hi - lo + 1).alias("length"))


def haloed(segments: DataFrame) -> DataFrame:
    """One row: whether any segment reaches into the next, within ranges of starts and then from range to range."""
    dealt = ranged(segments.select("start", "length"), "start")
    after = F.lead("start").over(Window.partitionBy("__range").orderBy("start"))
    last = F.col("start") + F.col("length") - 1
    within = dealt.withColumn("after", after).groupBy("__range").agg(F.max(last >= F.col("after")).alias("meets"), F.min("start").alias("first"), F.max_by(last, "start").alias("end"))
    # one row for each range
    next_ = F.lead("first").over(Window.partitionBy(F.lit(0)).orderBy("__range"))
    both = within.withColumn("next", next_).select(F.coalesce("meets", F.lit(False)).alias("meets"), F.coalesce(F.col("end") >= F.col("next"), F.lit(False)).alias("crosses"))
    return both.agg(F.coalesce(F.max(F.col("meets") | F.col("crosses")), F.lit(False)).alias("haloed"))


def rearrange(batch: DataFrame, columns: list[str], add: bool = False, cell: str = "cell") -> DataFrame:
    """A batch dealt anew by cell; with ``add``, duplicates are summed. For the parts of a decomposition see :func:`rearranged`."""
    return batch.groupBy(cell).agg(*[F.sum(c).alias(c) for c in columns]) if add else batch.repartition(cell)


def rearranged(batch: DataFrame, segments: DataFrame, parts: int, cell: str = "cell") -> DataFrame:
    """The batch with ``part``, the owner of each cell, dealt so that partition k holds what part k owns; cells without an owner are left out."""
    owned = owners_with(segments, batch.select(F.col(cell).alias("index"))).select(F.col("index").alias(cell), F.col("part").cast("int").alias("part"))
    return batch.join(owned, cell).repartitionById(parts, F.col("part"))


def kept_transfers(spark: SparkSession, folder: str, name: str, a: DataFrame, b: DataFrame) -> DataFrame:
    """(part_a, part_b, start, length): what the parts of one decomposition send to those of another, found once and kept by the content of both."""
    path = f"{folder}/transfers/{name}-{fingerprint(a)}-{fingerprint(b)}".replace(":", "_")
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        overlap(a, b).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def transferred(batch: DataFrame, transfers: DataFrame, parts: int, cell: str = "cell", width: int = 1024) -> DataFrame:
    """A batch (part, cell, ...) sent on by :func:`kept_transfers`: ``part`` is the new owner, and partition k holds what part k gets."""
    last = F.col("start") + F.col("length") - 1
    lists = transfers.select("part_a", "part_b", "start", last.alias("__last"), F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"(start + length - 1) div {width}"))).alias("__bin"))
    met = batch.join(lists, (F.col("part") == F.col("part_a")) & (lists["__bin"] == F.expr(f"{cell} div {width}")))
    own = met.where(F.col(cell).between(F.col("start"), F.col("__last")))
    return own.select(*[F.col("part_b").cast("int").alias("part") if c == "part" else F.col(c) for c in batch.columns]).repartitionById(parts, F.col("part"))


def columns_of(links: DataFrame, index: str = "src") -> DataFrame:
    """Segments of the source indices that a matrix uses: runs within ranges of indices, joined where ranges meet."""
    dealt = ranged(links.select(F.col(index).alias("index")).distinct(), "index")
    runs = points(dealt.select(F.col("__range").alias("part"), F.col("index").alias("pos"), "index"))
    # only a range's first and last run can meet those of others: two rows for each range
    ends = Window.partitionBy("part")
    runs = runs.withColumn("edge", (F.col("start") == F.min("start").over(ends)) | (F.col("start") == F.max("start").over(ends)))
    order = Window.partitionBy(F.lit(0)).orderBy("start")
    new = F.when(F.col("start") == F.lag(F.col("start") + F.col("length")).over(order), 0).otherwise(1)
    edges = runs.where("edge").withColumn("new", new).withColumn("run", F.sum("new").over(order)).groupBy("run").agg(F.min("start").alias("start"), F.sum("length").alias("length"))
    return runs.where("NOT edge").select("start", "length").unionByName(edges.select("start", "length")).select(F.lit(0).alias("part"), "start", "length")


def rows_of(links: DataFrame) -> DataFrame:
    """Segments of the target indices that a matrix has."""
    return columns_of(links, "dst")


def dealt_by_row(links: DataFrame, segments: DataFrame) -> DataFrame:
    """(part, dst, src, w): each link with the part that owns its target."""
    return _dealt(links, segments, "dst")


def dealt_by_column(links: DataFrame, segments: DataFrame) -> DataFrame:
    """(part, dst, src, w): each link with the part that owns its source."""
    return _dealt(links, segments, "src")


def _dealt(links: DataFrame, segments: DataFrame, index: str) -> DataFrame:
    owned = owners(segments, links.select(index).distinct(), index=index)
    return links.join(owned.withColumnRenamed("index", index), index).select("part", "dst", "src", "w")
