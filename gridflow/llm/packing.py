"""Best-fit packing of sequences into bins of several permitted sizes.

Texts longer than the largest size are cut into pieces of that size. Pieces are
dealt by hash to groups of bounded size (their number grows with the data), and
a group is packed in one task, so nothing is gathered beyond a group; a group of
``GROUP`` pieces wastes next to nothing over packing them all at once.

Within a group the longest piece comes first (ties: smaller id, then piece). It
goes into the open bin that it leaves least room in. If none has room, a bin is
opened. All permitted sizes compete on every opening: each is filled, on trial,
from the lengths that the group has left, and the one with the least cost for
a token held is opened; a bin costs ``OVERHEAD + size + size**2 / QUADRATIC``, at
the size that its contents need. At last every bin is downsized to the smallest
permitted size that holds its contents.

Very long texts give many pieces. Defined cases: empty pieces (null, empty and blank texts) are returned without
a bin; repeated rows are packed like any others; null ids are kept; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SIZES = (256, 512, 1024, 2048)
GROUP = 20_000
OVERHEAD = 32.0
QUADRATIC = 16_384.0


def cost(size: int) -> float:
    return OVERHEAD + size + size * size / QUADRATIC


def reach(held: list[int], mask: int, size: int) -> int:
    """What a new bin of this size would hold, filled from the lengths that are left, the longest that fits first."""
    room = size
    below = mask & ((1 << (size + 1)) - 1)
    while below:
        n = below.bit_length() - 1
        k = min(held[n], room // n)
        room -= k * n
        below &= (1 << min(n, room + 1)) - 1
    return size - room


def best_fit(lengths: list[int], sizes: tuple[int, ...] = SIZES) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset, final size of the bin) of each length; lengths fall and are in 1 .. max(sizes).

    Open bins hang in lists by the room they have; the set bits of a number say
    which lists have any, and those of another which lengths are left. Of bins
    with equal room the one opened last is taken.
    """
    rooms: list[list[int]] = [[] for _ in range(max(sizes) + 1)]
    held = [0] * (max(sizes) + 1)
    for n in lengths:
        held[n] += 1
    open_rooms, left = 0, sum(1 << n for n, k in enumerate(held) if k)
    filled: list[int] = []
    bins, offsets = [], []
    for n in lengths:
        fits = open_rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_rooms &= ~(1 << room)
        else:
            room = least_cost(n, held, left, sizes)
            b = len(filled)
            filled.append(0)
        bins.append(b)
        offsets.append(filled[b])
        filled[b] += n
        held[n] -= 1
        if not held[n]:
            left &= ~(1 << n)
        if room > n:
            rooms[room - n].append(b)
            open_rooms |= 1 << (room - n)
    final = [min(s for s in sizes if s >= f) for f in filled]
    return bins, offsets, [final[b] for b in bins]


def least_cost(n: int, held: list[int], left: int, sizes: tuple[int, ...]) -> int:
    """The size to open for a piece of length ``n``: the least cost for each token that it can be filled with."""
    best = None
    for s in sizes:
        if s >= n:
            used = reach(held, left, s)
            end = min(x for x in sizes if x >= used)
            price = (cost(end) / used, s)
            best = price if best is None or price < best else best
    return best[1]


def words(text: Column) -> Column:
    """The number of words between white space; 0 for null and blank texts."""
    bare = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.coalesce(bare, F.lit("")) == "", 0).otherwise(F.size(F.split(bare, " "))).cast("long")


def pack(lengths: DataFrame, sizes: tuple[int, ...] = SIZES, id_col: str = "doc_id", length_col: str = "length") -> DataFrame:
    """Rows (id, piece, start, length, bin_id, bin_offset, bin_size) of rows (id, length).

    An id column that is called like one of the others has an underscore before its name in the result.
    """
    top = max(sizes)
    rows = lengths.select(F.col(id_col), F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0)), F.lit(0)))
    id_col = f"_{id_col}" if id_col in ("piece", "start", "length", "bin_id", "bin_offset", "bin_size") else id_col
    n, group = (f"{id_col}_{x}" for x in ("n", "group"))
    rows = rows.toDF(id_col, n)
    last = F.greatest(F.ceil(F.col(n) / top) - 1, F.lit(0))
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    pieces = pieces.select(id_col, "piece", (F.col("piece") * top).alias("start"), F.least(F.col(n) - F.col("piece") * top, F.lit(top)).alias("length"))
    pieces = cut(pieces)
    groups = -(-pieces.count() // GROUP) or 1
    # dealt by the place in the cut table, so that rows without an id, or with one id, are spread like any others
    full = pieces.where("length > 0").withColumn(group, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    extra = "bin_id long, bin_offset long, bin_size int"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", id_col, "piece"], ascending=[False, True, True], kind="stable", na_position="first")
        bins, offsets, final = best_fit(pdf["length"].tolist(), sizes)
        first = int(pdf[group].iloc[0]) << 32
        return pdf.drop(columns=group).assign(bin_id=np.array(bins, np.int64) + first, bin_offset=offsets, bin_size=final)

    packed = full.groupBy(group).applyInPandas(run, f"{schema}, {extra}")
    empty = pieces.where("length = 0")
    none = [F.lit(None).cast(k).alias(n) for n, k in (x.split() for x in extra.split(", "))]
    return packed.unionByName(empty.select("*", *none))


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs.select("doc_id", words(F.col("text")).alias("length")))
