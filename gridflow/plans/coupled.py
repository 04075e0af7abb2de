"""Runs of several entries: components that put and get, in both directions.

The exchanges of a run are nodes (entry, time) of a graph. The exchange of an entry at t is made of its component's puts
up to t - lag, and a put at p follows what the component has got: every exchange that delivers to it before p, and at p itself
that of an entry whose SEQ is not higher (a component calls by SEQ, and gets before it puts where SEQ is equal). Exchanges of one
entry follow each other. Nodes without open ends form a level; a cycle is told before anything runs.

Each level becomes one plan, written to the shared folder before the next: a run has as many
jobs as its longest chain of exchanges, however many entries and cells there are. Entries that do not hear from each other share levels,
and a run without any feedback has as many levels as one window needs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce as fold

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import timewin
from ..shared import cut
from .exchange import Entry, Run, delivered, in_sequence, windowed

Node = tuple[int, int]


@dataclass(frozen=True)
class Coupled:
    """An entry between two components, its map and grids, and for a positive lag what it delivers at time 0: (field, cell, v)."""

    entry: Entry
    source: str
    target: str
    links: DataFrame | None = None
    src_grid: DataFrame | None = None
    dst_grid: DataFrame | None = None
    begin: DataFrame | None = None

    def __post_init__(self) -> None:
        if self.source == self.target:
            raise ValueError(f"{self.source} can't be on both sides of an entry")
        if self.entry.lag > 0 and self.begin is None:
            raise ValueError(f"{', '.join(self.entry.source)}: a positive lag needs values for time 0")
        if self.entry.status not in ("EXPORTED", "EXPOUT"):
            raise ValueError(f"{', '.join(self.entry.source)}: only exported entries are exchanged")


#: (received, start, end) to the puts (field, cell, t, v) of a component at start <= t < end. ``received`` has (field, cell, t, v,
#: since): what the component has got; a put at p may use the rows with since <= p.
Model = Callable[[DataFrame, int, int], DataFrame]


def check(coupling: list[Coupled], run: Run) -> None:
    """Entries whose components are those of the run, and whose targets differ."""
    known = set(run.components)
    for c in coupling:
        if missing := {c.source, c.target} - known:
            raise ValueError(f"not a component of the run: {', '.join(sorted(missing))}")
    targets = [(c.target, t) for c in coupling for t in c.entry.target]
    if twice := {t for t in targets if targets.count(t) > 1}:
        raise ValueError(f"several sources for one target: {', '.join(sorted(t for _, t in twice))}")


def exchange_times(entry: Entry, runtime: int) -> range:
    return range(0, runtime, entry.dt)


def waits_for(coupling: list[Coupled], run: Run) -> dict[Node, set[Node]]:
    """What each exchange (place of its entry, time) waits for: of each entry that its source gets, the latest exchange by then. Those before that count too."""
    out: dict[Node, set[Node]] = {}
    for i, c in enumerate(coupling):
        for t in exchange_times(c.entry, run.runtime):
            out[i, t] = set()
            if t == 0 and c.entry.lag > 0:
                continue  # delivered from the values for time 0
            last = t - c.entry.lag  # time of the last put in it
            for k, other in enumerate(coupling):
                ready = min(run.runtime - 1, last if other.entry.seq <= c.entry.seq else last - 1)
                if other.target == c.source and ready >= 0:
                    out[i, t].add((k, ready - ready % other.entry.dt))
    return out


def levels(coupling: list[Coupled], run: Run) -> list[list[Node]]:
    """Exchanges by the length of the longest chain that they wait for; a cycle raises."""
    direct = waits_for(coupling, run)
    # (k, t, True) stands for an entry's exchanges up to t
    needs: dict[tuple[int, int, bool], set[tuple[int, int, bool]]] = {}
    for (i, t), own in direct.items():
        needs[i, t, False] = {(*n, True) for n in own}
        before = t - coupling[i].entry.dt
        needs[i, t, True] = {(i, t, False)} | ({(i, before, True)} if before >= 0 else set())
    follow: dict[tuple[int, int, bool], list[tuple[int, int, bool]]] = {n: [] for n in needs}
    for n, own in needs.items():
        for m in own:
            follow[m].append(n)
    left = {n: len(own) for n, own in needs.items()}
    level = dict.fromkeys(needs, 0)
    free = [n for n, k in left.items() if not k]
    while free:
        n = free.pop()
        for m in follow[n]:
            level[m] = max(level[m], level[n] + (not m[2]))
            left[m] -= 1
            if not left[m]:
                free.append(m)
    stuck = {n for n, k in left.items() if k}
    if stuck:
        chain = [min(stuck)]
        while chain.count(chain[-1]) < 2:
            chain.append(min(n for n in needs[chain[-1]] if n in stuck))
        named = [f"{', '.join(coupling[i].entry.source)} at {t}" for i, t, upto in chain[chain.index(chain[-1]) :] if not upto]
        raise ValueError(f"entries wait for each other: {' and '.join(dict.fromkeys(named))}")
    out: list[list[Node]] = [[] for _ in range(max(level.values(), default=-1) + 1)]
    for (i, t, upto), k in sorted(level.items()):
        if not upto:
            out[k].append((i, t))
    return [x for x in out if x]


def _heard(coupling: list[Coupled], component: str, seq: int, got: list[tuple[int, DataFrame]], spark: SparkSession) -> DataFrame:
    """What a component has got, with the time from which its puts for an entry of ``seq`` may use it."""
    parts = []
    for i, frame in got:
        e = coupling[i].entry
        if coupling[i].target == component:
            since = F.col("t") if e.seq <= seq else F.col("t") + 1
            own = frame.where((F.col("component") == component) & F.col("field").isin(*e.target))
            parts.append(own.select("field", "cell", "t", "v", since.cast("long").alias("since")))
    return fold(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "field string, cell long, t long, v double, since long")


def _exchanged(c: Coupled, times: list[int], model: Model, heard: DataFrame) -> DataFrame | None:
    """(component, field, t, cell, v) of an entry at some of its times."""
    e, out = c.entry, []
    if e.lag > 0 and 0 in times:
        out.append(delivered(e, c.begin.select("field", "cell", F.lit(0).cast("long").alias("t"), "v"), c.links, c.src_grid, c.dst_grid))
    later = [t for t in times if t or e.lag <= 0]
    if later:
        # puts of the windows that end at these times
        start, end = max(0, min(later) - e.dt - e.lag + 1), max(later) - e.lag + 1
        puts = model(heard, start, end)
        puts = puts.where((F.col("t") >= start) & (F.col("t") < end) & F.col("field").isin(*e.source))
        on = F.col("t").between(min(later), max(later)) if len(later) * e.dt == max(later) - min(later) + e.dt else F.col("t").isin(*later)
        sent = windowed(e, puts).where(on)
        if len(e.source) > 1:
            whole = timewin.ready(puts, list(e.source), e.dt, e.lag).where("ready").select((F.col("w") * e.dt).alias("t"))
            sent = sent.join(whole, "t", "left_semi")  # a row for each time
        out.append(delivered(e, sent, c.links, c.src_grid, c.dst_grid))
    parts = [x.select(F.lit(c.target).alias("component"), "field", "t", "cell", "v") for x in out]
    return fold(DataFrame.unionByName, parts) if parts else None


def run_coupled(spark: SparkSession, coupling: list[Coupled], models: dict[str, Model], run: Run) -> DataFrame:
    """(component, field, t, cell, v): what each component of a run gets, and when.

    ``models`` has what each component puts. An entry of several fields is exchanged at a time if all of them were put in its window.
    """
    coupling = in_order(coupling)
    check(coupling, run)
    got: list[tuple[int, DataFrame]] = []
    out: DataFrame | None = None
    for level in levels(coupling, run):
        times: dict[int, list[int]] = {}
        for i, t in level:
            times.setdefault(i, []).append(t)
        made = {i: _exchanged(coupling[i], ts, models[coupling[i].source], _heard(coupling, coupling[i].source, coupling[i].entry.seq, got, spark)) for i, ts in times.items()}
        parts = [x for x in made.values() if x is not None]
        if parts:
            frame = cut(fold(DataFrame.unionByName, parts))
            got += [(i, frame) for i, x in made.items() if x is not None]
            out = frame if out is None else out.unionByName(frame)
    return out if out is not None else spark.createDataFrame([], "component string, field string, t long, cell long, v double")


def in_order(coupling: list[Coupled]) -> list[Coupled]:
    """Entries by SEQ, equal ones in their order."""
    place = {id(e): k for k, e in enumerate(in_sequence([c.entry for c in coupling]))}
    return sorted(coupling, key=lambda c: place[id(c.entry)])


def latest(puts: DataFrame, received: DataFrame, fields: dict[str, str]) -> DataFrame:
    """``puts`` (cell, t, ...) with a column for each of ``fields`` (received field: column): of the values in the same cell that a put may use, the latest; 0 if there is none.

    Both are sorted together by cell and time, so a put does not meet the values before it one by one.
    """
    held = [F.when(F.col("field") == f, F.col("v")).alias(c) for f, c in fields.items()]
    row = F.struct(*puts.columns)
    kind = next(f.dataType for f in puts.select(row.alias("r")).schema if f.name == "r").simpleString()
    values = received.where(F.col("field").isin(*fields)).select("cell", F.col("since").alias("__at"), F.lit(0).alias("__put"), F.col("t").alias("__t"), F.lit(None).cast(kind).alias("__row"), *held)
    both = values.unionByName(puts.select("cell", F.col("t").alias("__at"), F.lit(1).alias("__put"), F.lit(None).cast("long").alias("__t"), row.alias("__row"), *[F.lit(None).cast("double").alias(c) for c in fields.values()]))
    so_far = Window.partitionBy("cell").orderBy("__at", "__put", "__t").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.lit(0.0)) for c in fields.values()})
    return seen.where("__put = 1").select("__row.*", *fields.values())
