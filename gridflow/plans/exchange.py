"""One exchange as a plan: window, scale, check, map, conserve, scale; and what an entry may say."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import batch, curvilinear, polygons, reduce, reduced, timewin, weights
from ..operators.exact import exact_sums
from ..sources import tables

# fixed values: words of the coupling interface
STATUS = {"EXPORTED": "EXPORTED", "EXPOUT": "EXPOUT", "IGNORED": "EXPORTED", "IGNOUT": "EXPOUT", "INPUT": "INPUT", "OUTPUT": "OUTPUT"}
RETIRED = "REDGLO INVERT MASK EXTRAP CORRECT INTERP MOZAIC NOINTERP FILLING MASKP REVERSE GLORED".split()
TRANSFORMS = "LOCTRANS BLASOLD CHECKIN SCRIPR MAPPING CONSERV BLASNEW CHECKOUT".split()
METHODS = ("BILINEAR", "BICUBIC", "DISTWGT", "GAUSWGT", "CONSERV")
VALUES = tables.VALUES


@dataclass(frozen=True)
class Run:
    """What holds for all entries of a run: its length, its components and how much is told."""

    runtime: int
    components: tuple[str, ...] = ()
    log_level: int = 0

    def __post_init__(self) -> None:
        if self.runtime <= 0 or len(set(self.components)) != len(self.components):
            raise ValueError("a run has a positive length and components of different names")


@dataclass(frozen=True)
class Remap:
    """How weights are made: ``kind`` is LR (regular), D (reduced) or U (unstructured)."""

    method: str
    kind: str = "LR"
    restriction: str = "LATLON"
    field: str = "SCALAR"
    norm: str | None = None
    order: str | None = None
    neighbours: int | None = None
    variance: float | None = None
    arcs: int = 0

    def __post_init__(self) -> None:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(f"{self.method}: {what}")

        need(self.method in METHODS, "unknown method")
        need(self.kind in ("LR", "D", "U"), f"unknown kind of grid {self.kind}")
        need(self.method not in ("BILINEAR", "BICUBIC") or self.kind != "U", "needs a grid with rows (LR or D)")
        need(self.method != "CONSERV" or self.norm in ("FRACAREA", "DESTAREA", "FRACNNEI", "NONE") and self.order in ("FIRST", "SECOND"), "needs a normalisation and an order")
        need(self.method not in ("DISTWGT", "GAUSWGT") or (self.neighbours or 0) > 0, "needs a number of neighbours")
        need(self.method != "GAUSWGT" or (self.variance or 0) > 0, "needs a variance")
        if self.kind == "D":  # reduced grids are searched by their circles
            object.__setattr__(self, "restriction", "REDUCED")
        object.__setattr__(self, "field", "SCALAR")  # vectors are remapped by component

    def weights(self, src: DataFrame, dst: DataFrame, nx: int = 0, periodic: bool = True, overlap: int = 0) -> DataFrame:
        """(dst, src, w) or (dst, src, w1, ...) by this method; ``nx``, ``periodic`` and ``overlap`` (columns that repeat the first ones) describe rows of an LR grid."""
        if overlap:
            src, nx = without_overlap(src, nx, overlap), nx - overlap
        if self.method == "DISTWGT":
            return weights.distance_weights(src, dst, self.neighbours)
        if self.method == "GAUSWGT":
            return weights.gaussian_weights(src, dst, self.neighbours, self.variance)
        if self.method == "CONSERV":
            return polygons.conservative(src, dst, self.norm, self.order == "SECOND", self.arcs)
        if self.kind == "D":
            return (reduced.bilinear if self.method == "BILINEAR" else reduced.bicubic)(src, dst)
        return (curvilinear.bilinear if self.method == "BILINEAR" else curvilinear.bicubic)(src, dst, nx, periodic)


@dataclass(frozen=True)
class Entry:
    """A coupling entry: which fields go where, when and how."""

    source: tuple[str, ...]
    target: tuple[str, ...]
    dt: int
    lag: int = 0
    seq: int = 1
    status: str = "EXPORTED"
    restart: str | None = None
    loctrans: str = "INSTANT"
    source_scale: tuple[float, float] = (1.0, 0.0)
    target_scale: tuple[float, float] = (1.0, 0.0)
    map_mode: str = "bfb"
    remap: Remap | None = None
    conserv: str | None = None
    conserv_mode: str = "bfb"
    checkin: bool = False
    checkout: bool = False

    def __post_init__(self) -> None:
        timewin.check_lag(self.dt, self.lag)
        if self.status not in STATUS:
            raise ValueError(f"unknown or retired status {self.status}")
        object.__setattr__(self, "status", STATUS[self.status])
        if self.loctrans != "INSTANT" and self.loctrans not in timewin.TRANSFORMS:
            raise ValueError(f"unknown time transform {self.loctrans}")
        if self.conserv is not None and self.conserv not in reduce.CONSERVATION:
            raise ValueError(f"unknown conservation {self.conserv}")
        if self.conserv_mode not in ("bfb", "opt"):
            raise ValueError(f"unknown way of conserving {self.conserv_mode}")
        if len(self.source) != len(self.target):
            raise ValueError(f"{len(self.source)} sources for {len(self.target)} targets")
        if self.map_mode not in ("bfb", "sum", "opt"):
            raise ValueError(f"unknown way of mapping {self.map_mode}")
        if self.lag > 0 and self.restart is None and self.status in ("EXPORTED", "EXPOUT"):
            raise ValueError("a positive lag needs a restart table")


def check_transforms(names: list[str]) -> None:
    """Names of an entry's transforms: known ones, in the order in which they are done."""
    for name in names:
        if name in RETIRED:
            raise ValueError(f"{name} is no longer a transform")
        if name not in TRANSFORMS:
            raise ValueError(f"unknown transform {name}")
    places = [TRANSFORMS.index(n) for n in names]
    if sorted(set(places)) != places:
        raise ValueError(f"transforms are done in the order {', '.join(TRANSFORMS)}")


def in_sequence(entries: list[Entry]) -> list[Entry]:
    """Entries by SEQ, equal ones in their order."""
    if any(e.seq < 1 for e in entries):
        raise ValueError("SEQ begins at 1")
    return sorted(entries, key=lambda e: e.seq)


def matched(entries: DataFrame, variables: DataFrame) -> DataFrame:
    """(entry, source, target, from_component, to_component, problem) of entries (entry, source, target).

    ``variables``: (component, name, direction), direction "out" or "in". ``problem`` is null where all is well: one
    component puts the source, another gets the target, and no other entry has the same target. One source may feed several targets.
    """
    out = variables.where("direction = 'out'").select(F.col("name").alias("source"), F.col("component").alias("from_component"))
    into = variables.where("direction = 'in'").select(F.col("name").alias("target"), F.col("component").alias("to_component"))
    feeds = entries.groupBy("target").agg(F.count("*").alias("n_feeds"))
    both = entries.join(out, "source", "left").join(into, "target", "left").join(feeds, "target")
    problem = (
        F.when(F.col("from_component").isNull(), "nobody puts the source")
        .when(F.col("to_component").isNull(), "nobody gets the target")
        .when(F.col("from_component") == F.col("to_component"), "one component on both sides")
        .when(F.col("n_feeds") > 1, "several sources for one target")
    )
    return both.select("entry", "source", "target", "from_component", "to_component", problem.alias("problem"))


def without_overlap(grid: DataFrame, nx: int, overlap: int) -> DataFrame:
    """A periodic grid whose last ``overlap`` columns repeat its first ones, without these; rows are nx - overlap long from then on."""
    return grid.where(F.col("i") <= nx - overlap)


def stored(
    spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame], columns: tuple[str, ...] = ("w",), of: tuple[object, ...] = ()
) -> DataFrame:
    """(dst, src, columns) of the map ``name``: read if it is there, else built once and written.

    ``of``: what the map is made of, tables (grids) and other values (a :class:`Remap`). A map is known by its name and by the
    content of these, so another mask, another cell or another method builds a new one.
    """
    if of:
        parts = [batch.fingerprint(x) if isinstance(x, DataFrame) else repr(x) for x in of]
        name = f"{name}@{hashlib.sha256(repr((parts, columns)).encode()).hexdigest()[:32]}"
    try:
        found = not tables.read_weights(spark, folder, name).isEmpty()
    except LookupError:
        found = False
    if not found:
        tables.write_weights(build(), folder, name, columns)
    return tables.read_weights(spark, folder, name).select("dst", "src", *[F.col("w")[i].alias(c) for i, c in enumerate(columns)])


def remapped(spark: SparkSession, folder: str, name: str, remap: Remap, src: DataFrame, dst: DataFrame, nx: int = 0, periodic: bool = True, columns: tuple[str, ...] = ("w",)) -> DataFrame:
    """The weights of ``remap`` from ``src`` to ``dst``, kept in ``folder`` and built again only if one of these has changed."""
    return stored(spark, folder, name, lambda: remap.weights(src, dst, nx, periodic), columns, (remap, src, dst, nx, periodic))


def windowed(entry: Entry, puts: DataFrame, runtime: int | None = None) -> DataFrame:
    """The values that leave the source: only fields of the entry, before the end of the run; up to five value arrays."""
    own = puts.where(F.col("field").isin(*entry.source))
    if runtime is not None:
        own = timewin.within(own, runtime).where(F.col("t") + entry.lag < runtime)
    values = tuple(v for v in VALUES if v in puts.columns)
    return batch.affine(timewin.loctrans(own, entry.loctrans, entry.dt, entry.lag, values=values), "v", *entry.source_scale)


def mapped(entry: Entry, field: DataFrame, links: DataFrame | None) -> DataFrame:
    """(field, t, cell, v) on the target grid; without links the field stays as it is.

    The second to fifth value arrays go with the weights of the same number, w2 to w5. Mode "bfb" sums a target's terms in the
    order of their sources, for equal bits on any partitioning; the others as they come.
    """
    if links is None:
        return field
    pairs = [(v, w) for v, w in zip(VALUES, ("w", "w2", "w3", "w4", "w5"), strict=True) if v in field.columns and w in links.columns]
    terms = links.join(field, F.col("src") == F.col("cell"))
    x = sum((F.col(w) * F.col(v) for v, w in pairs[1:]), F.col("w") * F.col("v"))
    keys = ["field", "t", F.col("dst").alias("cell")]
    if entry.map_mode != "bfb":
        return terms.groupBy(*keys).agg(F.sum(x).alias("v"))
    width = 4096  # sources of a target that are summed in one list
    ordered = lambda at, v: F.aggregate(F.sort_array(F.collect_list(F.struct(at, v))), F.lit(0.0), lambda a, t: a + t[v])
    # links that repeat a pair would meet in one list
    repeats = links.groupBy("dst", "src").agg(F.count("*").alias("n")).where("n > 1")
    if not repeats.isEmpty():
        whole = {w: F.col(w) for _, w in pairs} | ({"w": F.col("w")})
        terms = exact_sums(links, whole, ("dst", "src")).join(field, F.col("src") == F.col("cell"))
    within = terms.select("field", "t", "dst", F.floor(F.col("src") / width).alias("bin"), "src", x.alias("x")).groupBy("field", "t", "dst", "bin").agg(ordered("src", "x").alias("y"))
    return within.groupBy(*keys).agg(ordered("bin", "y").alias("v"))


def conserved(entry: Entry, src: DataFrame, dst: DataFrame, src_grid: DataFrame, dst_grid: DataFrame) -> DataFrame:
    """The target corrected for each (field, t) at once; a target grid without any active area raises."""
    at = ("field", "t")
    whole = [f.join(g.select("cell", "area", "mask"), "cell") for f, g in ((src, src_grid), (dst, dst_grid))]
    active = reduce.sums(dst_grid.withColumn("v", F.lit(0.0)), "g").select("gw")  # one row
    sure = F.when(F.col("gw") > 0, F.col("v")).otherwise(F.raise_error(F.lit(f"{entry.conserv}: the target's active area is 0")).cast("double"))
    whole[1] = whole[1].crossJoin(F.broadcast(active)).withColumn("v", sure).drop("gw")
    return reduce.conserve(*whole, entry.conserv, keys=at, how=entry.conserv_mode).select("field", "t", "cell", "v")


def exchange(
    entry: Entry, puts: DataFrame, links: DataFrame | None = None, src_grid: DataFrame | None = None, dst_grid: DataFrame | None = None, runtime: int | None = None
) -> DataFrame:
    """The delivered (field, t, cell, v): fixed order of window, scale, map, conserve, scale."""
    return delivered(entry, windowed(entry, puts, runtime), links, src_grid, dst_grid)


def delivered(entry: Entry, sent: DataFrame, links: DataFrame | None = None, src_grid: DataFrame | None = None, dst_grid: DataFrame | None = None) -> DataFrame:
    got = mapped(entry, sent, links)
    if entry.conserv and links is not None:
        got = conserved(entry, sent, got, src_grid, dst_grid)
    got = batch.affine(got, "v", *entry.target_scale)
    names = F.create_map(*[F.lit(n) for pair in zip(entry.source, entry.target, strict=True) for n in pair])
    return got.withColumn("field", F.coalesce(names[F.col("field")], F.col("field")))


def checks(entry: Entry, sent: DataFrame, got: DataFrame) -> DataFrame | None:
    """(side, field, t, vmin, vmax, vsum) of the sides that the entry wants checked."""
    wanted = [(side, f) for on, side, f in ((entry.checkin, "in", sent), (entry.checkout, "out", got)) if on]
    out = None
    for side, f in wanted:
        one = f.groupBy("field", "t").agg(F.min("v").alias("vmin"), F.max("v").alias("vmax"), F.sum("v").alias("vsum")).select(F.lit(side).alias("side"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def run_leg(
    entry: Entry, puts: DataFrame | None, start: int, end: int, folder: str, links: DataFrame | None = None, src_grid: DataFrame | None = None, dst_grid: DataFrame | None = None, first: bool = False
) -> DataFrame:
    """One run of several over [start, end): delivered (field, t, cell, v), with what the run before left and what this one leaves in ``folder``.

    By status: EXPORTED delivers, EXPOUT also writes records, OUTPUT only writes them, INPUT delivers records that are there. A
    positive lag reads restart values at the start (those of the ``first`` run must have been written before, for its start) and writes
    them at the end. All value arrays of the puts (v to v5) go through windows, restart values and the map.

    A leg goes on from a leg of the same entry that was committed and ended at ``start``. What it writes counts once it is
    committed, which comes last; a leg that is run again, after a failure or not, leaves the same tables.
    """
    spark = puts.sparkSession if puts is not None else SparkSession.getActiveSession()
    if entry.status == "INPUT":
        return delivered(entry, tables.read_records(spark, folder, entry.source, start, end, entry.dt), links, src_grid, dst_grid)
    values = tuple(v for v in VALUES if v in puts.columns)
    own = puts.where(F.col("field").isin(*entry.source))
    name = entry.restart or ":".join(entry.source)
    if not first and tables.committed(spark, folder).where((F.col("entry") == name) & (F.col("end") == start)).isEmpty():
        raise LookupError(f"no leg of {name} that ends at {start} in {folder}")
    ready = tables.read_restart(spark, folder, name, "ready", first, start, values) if entry.lag > 0 else None
    carried = None if first else tables.read_restart(spark, folder, name, "loctrans", False, start, values)
    leg = timewin.leg(own, entry.loctrans, entry.dt, entry.lag, start, end, ready, carried, values=values)
    if entry.lag > 0:
        tables.write_restart(leg.ready, folder, name, "ready", True, end)
    tables.write_restart(leg.carried, folder, name, "loctrans", True, end)
    sent = batch.affine(leg.delivered, "v", *entry.source_scale)
    if entry.status in ("EXPOUT", "OUTPUT"):
        tables.append_output(sent, folder, name, start)
    tables.commit(spark, folder, name, start, end)
    return delivered(entry, sent, links, src_grid, dst_grid) if entry.status != "OUTPUT" else sent.limit(0)
