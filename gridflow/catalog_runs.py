"""Registered queries on runs of several legs, entries of a coupling, sorts, batches, index maps and strings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .catalog import _DEALT, _PUTS, _SIDES, _dealt, _folder, _merge_sql, _nation_sources, _sides, links, order_grid, parts, puts, query, r, rounded
from .functions import names as fn
from .operators import batch, matrix, partition, reduce, timewin
from .plans import coupled
from .plans import exchange as plan
from .schema import regular_grid, table, with_corners
from .sources import netcdf, tables
from .streaming import stateful

DT = 21600

# ---------------------------------------------------------------- legs, restarts, statuses

_LEG_ENDS = (0, 864_000, 1_728_000, 2_592_000)


def _legs(name: str, transform: str, sql: str, lag: int) -> None:
    fields = ("view", "click", "purchase")

    def run(spark, d):
        """Three runs that hand over their restart tables give what one long run gives."""
        entry = plan.Entry(fields, fields, DT, lag=lag, restart="events" if lag > 0 else None, loctrans=transform, map_mode="sum")
        folder, out = _folder(spark, "legs"), None
        begin = table(spark, d, "customer").select(F.lit("view").alias("field"), (-F.col("c_custkey")).alias("cell"), F.col("c_acctbal").alias("v"))
        if lag > 0:
            tables.write_restart(begin, folder, "events", "ready")
        for k, (start, end) in enumerate(zip(_LEG_ENDS, _LEG_ENDS[1:], strict=False)):
            leg = batch.cut(plan.run_leg(entry, puts(spark, d), start, end, folder, first=k == 0))
            out = leg if out is None else out.unionByName(leg)
        return rounded(out, 5)

    run.__name__ = name
    first = "UNION ALL SELECT 'view', -c_custkey, 0, round(c_acctbal, 5) FROM customer" if lag > 0 else ""
    w = f"CAST(ceil((t + {lag}) / {DT}.0) AS BIGINT)"
    query(_PUTS + f"""SELECT field, cell, w * {DT} AS t, round({sql}(v), 5) AS v FROM (SELECT field, cell, v, {w} AS w FROM p WHERE field IN {fields} AND t < {_LEG_ENDS[-1]})
WHERE w * {DT} < {_LEG_ENDS[-1]} GROUP BY field, cell, w {first}""")(run)


_legs("restart_legs_average", "AVERAGE", "avg", 3600)
_legs("restart_legs_accumul", "ACCUMUL", "sum", 0)
_legs("restart_legs_max", "T_MAX", "max", 7200)
_legs("restart_legs_min", "T_MIN", "min", -1800)


@query(_PUTS + f"SELECT cell, CAST(ceil(t / {DT}.0) AS BIGINT) * {DT} AS t, round(avg(v) * 3, 5) AS v FROM p WHERE field = 'view' AND CAST(ceil(t / {DT}.0) AS BIGINT) * {DT} IN (864000, 885600) GROUP BY ALL")
def output_then_input(spark, d):
    """Records that an OUTPUT entry wrote, read by an INPUT entry at two times."""
    folder = _folder(spark, "records")
    plan.run_leg(plan.Entry(("view",), ("view",), DT, status="OUTPUT", loctrans="AVERAGE"), puts(spark, d), 0, 1_728_000, folder, first=True)
    reads = plan.Entry(("view",), ("view",), DT, status="INPUT", target_scale=(3.0, 0.0))
    return rounded(plan.run_leg(reads, table(spark, d, "events"), 864_000, 907_200, folder).drop("field"), 5)


@query(_PUTS + f"""SELECT field, cell, w * {DT} AS t, round(avg(v), 5) AS v FROM (SELECT field, cell, v, CAST(ceil((t + 7200) / {DT}.0) AS BIGINT) AS w FROM p WHERE field = 'click' AND t + 7200 < 2592000) GROUP BY field, cell, w""")
def exchange_to_the_end(spark, d):
    """Puts whose exchange would come at or after the end of the run are not sent."""
    entry = plan.Entry(("click",), ("click",), DT, lag=7200, restart="click", loctrans="AVERAGE")
    return rounded(plan.windowed(entry, puts(spark, d), 2_592_000), 5)


@query("SELECT 'users' AS name, row_number() OVER (ORDER BY event_type) AS place, count(DISTINCT user_id) AS i, round(avg(value), 6) AS r FROM events GROUP BY event_type")
def counters_stored(spark, d):
    """A counter and a mean for each field, written as small arrays and read again."""
    folder = _folder(spark, "counters")
    n = puts(spark, d).groupBy("field").agg(F.count_distinct("cell").alias("i"), F.avg("v").alias("r"))
    ordered = batch.running(n, [F.col("field")], F.lit(1), "place")
    tables.write_arrays(ordered.select(F.lit("old").alias("name"), "place", "i", "r"), folder, "a:b")
    tables.write_arrays(ordered.select(F.lit("users").alias("name"), "place", "i", "r"), folder, "a:b")
    return rounded(tables.read_arrays(spark, folder, "a:b"))


def _hours(spark, d):
    """The puts with times at full hours, and places of their own in calling order."""
    return puts(spark, d).withColumns({"t": F.floor(F.col("t") / 3600).cast("long") * 3600, "place": F.col("event_id") * 7919 % 1_000_003})


_HOURS = _PUTS + ", h AS (SELECT event_id * 7919 % 1000003 AS place, event_id, field, cell, t // 3600 * 3600 AS t, v FROM p) "


@query(_HOURS + "SELECT field, cell, t, count(*) AS n FROM h GROUP BY 1, 2, 3 HAVING count(*) > 1")
def repeated_hours(spark, d):
    return timewin.repeated(_hours(spark, d))


@query(_HOURS + """, b AS (SELECT *, max(t) OVER (PARTITION BY field ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM h)
SELECT place, field, t, seen FROM b WHERE t < seen""")
def backward_shuffled(spark, d):
    """Puts that are called in another order than that of their times."""
    # places that two puts share are called in the order of the events
    return timewin.backward(_hours(spark, d), "place", ties=("event_id",)).select("place", "field", "t", "seen")


@query(_HOURS + f""", s AS (SELECT field, cell, CAST(ceil(t / {DT}.0) AS BIGINT) * {DT} AS t, avg(v) AS v FROM h GROUP BY 1, 2, 3)
SELECT e.event_id, round(s.v, 5) AS v, CASE WHEN e.t % {DT} <> 0 OR s.v IS NULL THEN 0 WHEN e.t < 864000 THEN 10 ELSE 3 END AS code
FROM h e LEFT JOIN s ON s.field = e.field AND s.cell = e.cell AND s.t = e.t""")
def get_codes(spark, d):
    """What gets at the events' hours receive; values of the first ten days count as served from a restart."""
    sent = timewin.loctrans(_hours(spark, d), "AVERAGE", DT).withColumn("origin", F.when(F.col("t") < 864_000, "restart").otherwise("put"))
    gets = _hours(spark, d).select("event_id", "field", "cell", "t")
    return timewin.aligned(gets, sent, DT).select("event_id", r("v", 5).alias("v"), "code")


_ENTRIES = "n AS (SELECT n_nationkey AS entry, n_regionkey + 1 AS seq, (n_nationkey % 3 + 1) * 3600 AS dt, n_nationkey * 1800 AS last FROM nation), g AS (SELECT o_custkey % 25 AS entry, o_orderkey * 60 AS t FROM orders) "


@query(f"WITH {_ENTRIES} SELECT g.entry, g.t, CAST(o.entry AS BIGINT) AS waits_for FROM g JOIN n ON n.entry = g.entry JOIN n o ON o.seq < n.seq AND o.last < g.t // o.dt * o.dt")
def sequence_deadlock(spark, d):
    n = table(spark, d, "nation")
    entries = n.select(F.col("n_nationkey").cast("long").alias("entry"), (F.col("n_regionkey") + 1).alias("seq"), ((F.col("n_nationkey") % 3 + 1) * 3600).alias("dt"), (F.col("n_nationkey") * 1800).alias("last"))
    gets = table(spark, d, "orders").select((F.col("o_custkey") % 25).alias("entry"), (F.col("o_orderkey") * 60).alias("t"))
    return timewin.blocked(gets, entries)


@query("""WITH v AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'sea' ELSE 'air' END AS component, 'S' || n_nationkey AS name FROM nation WHERE n_nationkey < 20),
g AS (SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'sea' ELSE 'air' END AS component, 'T' || n_nationkey AS name FROM nation WHERE n_nationkey > 2),
e AS (SELECT n_nationkey AS entry, 'S' || n_nationkey AS source, 'T' || (n_nationkey // 2 * 2) AS target FROM nation WHERE n_regionkey < 2 UNION ALL SELECT 100 + n_nationkey, 'S' || n_nationkey, 'T' || n_nationkey FROM nation WHERE n_regionkey >= 2),
k AS (SELECT target, count(*) AS n FROM e GROUP BY 1)
SELECT e.entry, e.source, e.target, v.component AS from_component, g.component AS to_component, CASE WHEN v.component IS NULL THEN 'nobody puts the source' WHEN g.component IS NULL THEN 'nobody gets the target'
WHEN v.component = g.component THEN 'one component on both sides' WHEN k.n > 1 THEN 'several sources for one target' END AS problem
FROM e LEFT JOIN v ON v.name = e.source LEFT JOIN g ON g.name = e.target JOIN k ON k.target = e.target""")
def entry_matching(spark, d):
    n = table(spark, d, "nation")
    key = F.col("n_nationkey")
    out = n.where("n_nationkey < 20").select(F.when(key % 2 == 0, "sea").otherwise("air").alias("component"), F.concat(F.lit("S"), key).alias("name"), F.lit("out").alias("direction"))
    into = n.where("n_nationkey > 2").select(F.when(key % 3 == 0, "sea").otherwise("air").alias("component"), F.concat(F.lit("T"), key).alias("name"), F.lit("in").alias("direction"))
    first = n.where("n_regionkey < 2").select(key.alias("entry"), F.concat(F.lit("S"), key).alias("source"), F.concat(F.lit("T"), (F.floor(key / 2) * 2)).alias("target"))
    second = n.where("n_regionkey >= 2").select((key + 100).alias("entry"), F.concat(F.lit("S"), key).alias("source"), F.concat(F.lit("T"), key).alias("target"))
    return plan.matched(first.unionByName(second), out.unionByName(into))


# ---------------------------------------------------------------- exchanges


def _exchange_conserv(mode: str, sql: str) -> None:
    def run(spark, d):
        """Both fields of an exchange, corrected each by itself."""
        src, dst = _sides(spark, d)
        entry = plan.Entry(("f", "g"), ("f", "g"), 10, map_mode="sum", conserv=mode)
        sides = [s.select("cell", F.explode(F.array(F.lit("f"), F.lit("g"))).alias("field"), F.lit(10).cast("long").alias("t"), "v").withColumn("v", F.when(F.col("field") == "g", F.col("v") * 2).otherwise(F.col("v"))) for s in (src, dst)]
        return rounded(plan.conserved(entry, *sides, src, dst))

    run.__name__ = f"exchange_conserv_{mode.lower()}"
    base = _SIDES.format(sql).replace("SELECT cell, round(CASE", "SELECT field, t, cell, round(k * CASE").replace("FROM t, a, b", "FROM t, a, b, (VALUES ('f', CAST(10 AS BIGINT), 1.0), ('g', CAST(10 AS BIGINT), 2.0)) x(field, t, k)")
    query(base.replace(", area, mask FROM", " FROM"))(run)


_exchange_conserv("GLOBAL", "v - (sd - ss) / wd")
_exchange_conserv("GLBPOS", "v * (ss / sd)")
_exchange_conserv("BASBAL", "v - (sd - ss * wd / ws) / wd")
_exchange_conserv("BASPOS", "v * (ss / sd * (wd / ws))")


@query(_PUTS + f""", a AS (SELECT field, cell, CAST(ceil(t / {DT}.0) AS BIGINT) * {DT} AS t, avg(v) AS v, avg(v * v) AS v2, avg(t % 100) AS v3 FROM p GROUP BY 1, 2, 3),
l AS (SELECT c_custkey AS dst, c_custkey % 15 AS src, 0.5 AS w, c_acctbal / 1000 AS w2, c_custkey / 100.0 AS w3 FROM customer)
SELECT field, t, dst AS cell, round(sum(w * v + w2 * v2 + w3 * v3), 3) AS v FROM l JOIN a ON src = cell GROUP BY 1, 2, 3""")
def exchange_value_arrays(spark, d):
    """A put of three value arrays, each with weights of its own."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    links_ = c.select(k.alias("dst"), (k % 15).alias("src"), F.lit(0.5).alias("w"), (F.col("c_acctbal") / 1000).alias("w2"), (k / 100).alias("w3"))
    fields = ("view", "click", "purchase", "signup", "error")
    sent = puts(spark, d).withColumns({"v2": F.col("v") * F.col("v"), "v3": (F.col("t") % 100).cast("double")})
    return rounded(plan.exchange(plan.Entry(fields, fields, DT, loctrans="AVERAGE"), sent, links_), 3)


_RUN, _WEEK, _LATE = 2_592_000, 432_000, 3600


def _coupled_sql() -> str:
    """The exchanges of the run below, one after the other: heat and rain every five days, the sea's answer every ten."""
    names = {"heat": ("view", _WEEK), "rain": ("click", _WEEK), "sst": ("purchase", 2 * _WEEK)}
    hears = {"heat": {"sst": 0.5}, "rain": {"sst": 0.5}, "sst": {"heat": 0.25, "rain": -0.125}}
    ctes, there = [], {n: [] for n in names}
    for n, (_, dt) in names.items():
        ctes.append(f"{n}_0 AS (SELECT cell, CAST(0 AS BIGINT) AS t, CAST(cell % {dt // 43200} AS DOUBLE) AS v FROM (SELECT DISTINCT cell FROM p))")
        there[n].append(0)
    for t, n in sorted((t, n) for n, (_, dt) in names.items() for t in range(dt, _RUN, dt)):
        field, dt = names[n]
        last, more = t - _LATE, ""
        for other, factor in hears[n].items():
            known = " UNION ALL ".join(f"SELECT * FROM {other}_{k}" for k in there[other] if k <= last)
            more += f" + {factor} * coalesce((SELECT arg_max(s.v, s.t) FROM ({known}) s WHERE s.cell = p.cell AND s.t <= p.t), 0)"
        ctes.append(f"{n}_{t} AS (SELECT cell, CAST({t} AS BIGINT) AS t, avg(v{more}) AS v FROM p WHERE field = '{field}' AND t > {last - dt} AND t <= {last} GROUP BY 1)")
        there[n].append(t)
    side = {"heat": "ocean", "rain": "ocean", "sst": "atmos"}
    rows = " UNION ALL ".join(f"SELECT '{side[n]}' AS component, '{n}' AS field, t, cell, round(v + 3e-9, 5) AS v FROM {n}_{t}" for n, ts in there.items() for t in ts)
    return f"{_PUTS}, {', '.join(ctes)} {rows}"


@query(_coupled_sql())
def coupled_feedback(spark, d):
    """Three entries between two components, both ways: what each puts follows what it has got from the other."""
    held, cells = puts(spark, d).select("field", "cell", "t", "v"), puts(spark, d).select("cell").distinct()

    def begin(field: str, dt: int):
        return cells.select(F.lit(field).alias("field"), "cell", (F.col("cell") % (dt // 43200)).cast("double").alias("v"))

    def model(names: tuple[str, ...], hears: dict[str, float]):
        def put(received, start, end):
            own = held.where(F.col("field").isin(*names) & (F.col("t") >= start) & (F.col("t") < end))
            known = coupled.latest(own, received, {f: f"got_{f}" for f in hears})
            return known.select("field", "cell", "t", (F.col("v") + sum(F.col(f"got_{f}") * w for f, w in hears.items())).alias("v"))

        return put

    def entry(source: str, target: str, dt: int):
        return plan.Entry((source,), (target,), dt, lag=_LATE, restart="begin", loctrans="AVERAGE", map_mode="sum")

    entries = [
        coupled.Coupled(entry("view", "heat", _WEEK), "atmos", "ocean", begin=begin("view", _WEEK)),
        coupled.Coupled(entry("click", "rain", _WEEK), "atmos", "ocean", begin=begin("click", _WEEK)),
        coupled.Coupled(entry("purchase", "sst", 2 * _WEEK), "ocean", "atmos", begin=begin("purchase", 2 * _WEEK)),
    ]
    models = {"atmos": model(("view", "click"), {"sst": 0.5}), "ocean": model(("purchase",), {"heat": 0.25, "rain": -0.125})}
    # values that end with a 5 at the sixth digit are rounded up
    return coupled.run_coupled(spark, entries, models, plan.Run(_RUN, ("atmos", "ocean"))).withColumn("v", r(F.col("v") + 3e-9, 5))


@query(_PUTS + f""", a AS (SELECT field, cell, CAST(ceil((t + 3600) / {DT}.0) AS BIGINT) * {DT} AS t, avg(v) AS v, avg(v * v) AS v2, avg(t % 100) AS v3 FROM p WHERE field IN ('view', 'click') AND t < {_LEG_ENDS[-1]} GROUP BY 1, 2, 3
UNION ALL SELECT 'view', c_custkey % 15, 0, sum(c_acctbal), sum(c_acctbal) / 2, 0 FROM customer GROUP BY 2),
l AS (SELECT c_custkey AS dst, c_custkey % 15 AS src, 0.5 AS w, c_acctbal / 1000 AS w2, c_custkey / 100.0 AS w3 FROM customer)
SELECT field, t, dst AS cell, round(sum(w * v + w2 * v2 + w3 * v3) + 3e-7, 3) AS v FROM l JOIN a ON src = cell WHERE t < {_LEG_ENDS[-1]} GROUP BY 1, 2, 3""")
def restart_legs_arrays(spark, d):
    """Three value arrays through lag, restart values and three legs, each with weights of its own; the second leg is run twice."""
    c, k, fields = table(spark, d, "customer"), F.col("c_custkey"), ("view", "click")
    links_ = c.select(k.alias("dst"), (k % 15).alias("src"), F.lit(0.5).alias("w"), (F.col("c_acctbal") / 1000).alias("w2"), (k / 100).alias("w3"))
    sent = puts(spark, d).withColumns({"v2": F.col("v") * F.col("v"), "v3": (F.col("t") % 100).cast("double")})
    entry, folder = plan.Entry(fields, fields, DT, lag=3600, restart="events", loctrans="AVERAGE", map_mode="sum"), _folder(spark, "legs")
    begin = c.groupBy((k % 15).alias("cell")).agg(F.sum("c_acctbal").alias("v")).withColumns({"v2": F.col("v") / 2, "field": F.lit("view")})
    tables.write_restart(begin, folder, "events", "ready")
    out = []
    for i, (start, end) in enumerate(zip(_LEG_ENDS, _LEG_ENDS[1:], strict=False)):
        for _ in range(2 if i == 1 else 1):
            leg = plan.run_leg(entry, sent, start, end, folder, links_, first=i == 0)
        out.append(leg)
    # many values end with a 5 at the fourth digit; the small shift rounds them all up
    return out[0].unionByName(out[1]).unionByName(out[2]).withColumn("v", r(F.col("v") + 3e-7, 3))


_TWO_DAYS = 172_800


@query(_PUTS + f"SELECT field, cell, CAST(ceil(t / {_TWO_DAYS}.0) AS BIGINT) * {_TWO_DAYS} AS t, round(avg(v), 5) AS v FROM p WHERE field IN ('view', 'click') AND t > 0 AND t <= 864000 - {_TWO_DAYS} GROUP BY 1, 2, 3")
def records_of_repeated_legs(spark, d):
    """Legs that write records; the first is run twice, and a third one that is not committed has left records too. What is read has every record once."""
    fields, folder = ("view", "click"), _folder(spark, "records")
    entry = plan.Entry(fields, fields, _TWO_DAYS, status="EXPOUT", loctrans="AVERAGE")
    for start, end in ((0, 345_600), (0, 345_600), (345_600, 864_000)):
        plan.run_leg(entry, puts(spark, d), start, end, folder, first=start == 0)
    tables.append_output(timewin.loctrans(puts(spark, d), "AVERAGE", _TWO_DAYS), folder, ":".join(fields), 864_000)
    return rounded(tables.read_records(spark, folder, fields, _TWO_DAYS, 864_000, _TWO_DAYS), 5)


@query("""WITH g AS (SELECT o_orderkey AS cell, o_orderstatus AS field, CAST(0 AS BIGINT) AS t, o_totalprice AS v, CAST(1 + o_orderkey % 5 AS DOUBLE) AS area, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS mask FROM orders),
s AS (SELECT field, sum(v * area) FILTER (mask = 0) AS ss, 1.5 * sum(v * area) FILTER (mask = 0) AS sd, sum(area) FILTER (mask = 0) AS wd FROM g GROUP BY 1)
SELECT field, cell, round(1.5 * v + CASE WHEN mask = 0 THEN (ss - sd) / wd ELSE 0 END, 4) AS v, true AS same FROM g JOIN s USING (field)""")
def conserve_same_bits(spark, d):
    """GLOBAL conservation in mode bfb of the orders of each status, on 3 and on 211 partitions: ``same`` compares bits."""
    k = F.col("o_orderkey")
    orders = table(spark, d, "orders").select(k.alias("cell"), F.col("o_orderstatus").alias("field"), F.lit(0).cast("long").alias("t"), F.col("o_totalprice").alias("v"), (1 + k % 5).cast("double").alias("area"), F.when(k % 7 == 0, 1).otherwise(0).alias("mask"))
    out = []
    for n in (3, 211):
        src = orders.repartition(n)
        dst = src.withColumn("v", F.col("v") * 1.5).repartition(n, "cell")
        out.append(reduce.conserve(src, dst, "GLOBAL", keys=("field", "t"), how="bfb").select("field", "cell", "v"))
    both = out[0].join(out[1].select("cell", F.col("v").alias("other")), "cell")
    return both.select("field", "cell", r("v", 4).alias("v"), (F.col("v") == F.col("other")).alias("same"))


# ---------------------------------------------------------------- streams that stop and go on


def _landed(spark, d, folder: str, start: int, end: int) -> None:
    """The puts of a leg arrive in the folder of the stream."""
    part = puts(spark, d).where((F.col("t") >= start) & (F.col("t") < end)).withColumns({"v2": F.col("v") * F.col("v"), "v3": (F.col("t") % 100).cast("double")})
    part.select("field", "cell", "t", "v", "v2", "v3").write.mode("append").parquet(folder)


def _stream_legs(name: str, transform: str, lag: int, values: tuple[str, ...], sql: str) -> None:
    def run(spark, d):
        """A stream that is stopped twice and goes on from its state; at the end of the run its clock closes the last windows."""
        folder = _folder(spark, "stream-legs")
        landing = f"{folder}/puts"
        _landed(spark, d, landing, 0, 0)
        stream = spark.readStream.schema("field string, cell long, t long, v double, v2 double, v3 double").parquet(landing)
        stream = stateful.windows(stateful.with_clock(stream, f"{folder}/clock", values), transform, DT, lag, values=values)
        for start, end in zip(_LEG_ENDS, _LEG_ENDS[1:], strict=False):
            _landed(spark, d, landing, start, end)
            stateful.drain(stream, folder)
        stateful.tick(spark, f"{folder}/clock", _LEG_ENDS[-1] + 2 * DT)
        out = stateful.drain(stream, folder)
        return out.select("field", "cell", "t", *[r(F.col(v) + 3e-9, 5).alias(v) for v in values])

    run.__name__ = name
    query(_PUTS + f"SELECT field, cell, CAST(ceil((t + {lag}) / {DT}.0) AS BIGINT) * {DT} AS t, {sql} FROM p WHERE t < {_LEG_ENDS[-1]} GROUP BY 1, 2, 3")(run)


_stream_legs("stream_legs_average", "AVERAGE", 3600, ("v", "v2", "v3"), "round(avg(v) + 3e-9, 5) AS v, round(avg(v * v) + 3e-9, 5) AS v2, round(avg(t % 100) + 3e-9, 5) AS v3")
_stream_legs("stream_legs_max", "T_MAX", 0, ("v",), "round(max(v) + 3e-9, 5) AS v")


@query(_PUTS + f"SELECT field, cell, CAST(ceil(t / {DT}.0) AS BIGINT) AS w, round(sum(v) + 3e-9, 5) AS v, count(*) AS cnt FROM p WHERE t < 1000000 AND CAST(ceil(t / {DT}.0) AS BIGINT) * {DT} > (SELECT max(t) - 1 FROM p WHERE t < 1000000) GROUP BY 1, 2, 3")
def stream_state_as_restart(spark, d):
    """A stream that stops within a window, and what its state holds of it."""
    folder = _folder(spark, "stream-state")
    _landed(spark, d, f"{folder}/puts", 0, 1_000_000)
    stream = spark.readStream.schema("field string, cell long, t long, v double, v2 double, v3 double").parquet(f"{folder}/puts")
    stateful.drain(stateful.windows(stream, "AVERAGE", DT), folder)
    return stateful.left_open(spark, folder).withColumn("v", r(F.col("v") + 3e-9, 5))


# ---------------------------------------------------------------- NetCDF files


@query("SELECT l_orderkey AS dst, l_partkey AS src, l_discount AS w1, l_tax AS w2, l_returnflag AS mode, count(*) AS n FROM lineitem GROUP BY 1, 2, 3, 4, 5")
def netcdf_weights(spark, d):
    """A map of two weights a link, written as NetCDF files and read again in small stretches."""
    netcdf.register(spark)
    folder, li = _folder(spark, "netcdf"), table(spark, d, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("dst_address"), F.col("l_partkey").alias("src_address"), F.array("l_discount", "l_tax").alias("remap_matrix"), F.col("l_returnflag").alias("mode"))
    rows.write.format("netcdf").option("dimension", "num_links").mode("overwrite").save(folder)
    got = spark.read.format("netcdf").option("dimensions", "num_links").option("points", 20_000).load(folder)
    w = F.col("remap_matrix")
    return got.groupBy(F.col("dst_address").alias("dst"), F.col("src_address").alias("src"), w[0].alias("w1"), w[1].alias("w2"), "mode").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS cell, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders")
def netcdf_restart(spark, d):
    """Restart values with gaps, of which only two variables are read."""
    netcdf.register(spark)
    folder, k = _folder(spark, "netcdf"), F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("cell"), F.when(k % 11 != 0, F.col("o_totalprice")).alias("v"), F.lit(1).alias("cnt"), "o_orderstatus")
    rows.write.format("netcdf").mode("overwrite").save(folder)
    return spark.read.format("netcdf").schema("cell long, v double").load(folder)


# ---------------------------------------------------------------- sorts and batches


@query("SELECT p_partkey AS cell, p_retailprice AS v FROM part")
def permute_and_back(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("cell"), F.col("p_retailprice").alias("v"))
    places = batch.cut(batch.permutation(p, [("v", True)]))
    return batch.unpermuted(batch.permuted(p, places), places)


@query("SELECT row_number() OVER (ORDER BY p_brand DESC, p_retailprice, p_partkey) AS cell, p_brand, p_retailprice FROM part")
def batch_in_order(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("cell"), "p_brand", "p_retailprice")
    return batch.in_order(p, [("p_brand", True), ("p_retailprice", False)])


@query("SELECT row_number() OVER (ORDER BY c_nationkey DESC, c_acctbal, c_custkey) AS cell, c_acctbal AS lon, CAST(c_nationkey AS DOUBLE) AS lat FROM customer")
def grid_in_order(spark, d):
    """Points numbered from north to south and then eastwards."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_acctbal").alias("lon"), F.col("c_nationkey").cast("double").alias("lat"))
    return batch.in_order(c, [("lat", True), ("lon", False)])


@query(_DEALT + "SELECT row_number() OVER (ORDER BY start, part, length) AS place, part, start, length FROM seg")
def segments_in_order(spark, d):
    return partition.sorted_segments(partition.points(_dealt(spark, d)))


@query("""WITH b AS (SELECT 0 AS side, p_partkey AS cell, CAST(p_size AS BIGINT) AS key FROM part UNION ALL SELECT 1, c_custkey, c_nationkey FROM customer)
SELECT side, cell, row_number() OVER (ORDER BY key, side, cell) AS place FROM b""")
def rank_merge(spark, d):
    a = table(spark, d, "part").select(F.col("p_partkey").alias("cell"), F.col("p_size").cast("long").alias("key"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_nationkey").cast("long").alias("key"))
    return batch.rank_merge(a, b, "key")


@query("SELECT p_size, min(p_partkey) AS p_partkey FROM part GROUP BY 1")
def unique_keys(spark, d):
    return batch.unique(table(spark, d, "part").select("p_size", "p_partkey"), "p_size", "p_partkey")


def _bins(name: str, key: str) -> None:
    def run(spark, d):
        return batch.bin_index(table(spark, d, "part").select(F.expr(key).alias("key")), "key")

    run.__name__ = f"bin_index_{name}"
    query(f"SELECT key, CAST(sum(n) OVER (ORDER BY key) AS BIGINT) - n + 1 AS start, n FROM (SELECT {key} AS key, count(*) AS n FROM part GROUP BY 1)")(run)


_bins("integer", "p_size")
_bins("char", "p_brand")
_bins("logical", "p_size > 25")


@query(_merge_sql("csnk"))
def merge_running(spark, d):
    """Four sources, added one at a time."""
    total = None
    for source, masks in _nation_sources(spark, d):
        total = reduce.running_merge(total, source, masks, ["v"])
    return rounded(reduce.merged(total, ["v"], strict=False), 4)


@query("SELECT count(*) AS n_rows, 1 AS n_reals, 1 AS n_ints FROM part")
def column_counts(spark, d):
    return batch.column_counts(table(spark, d, "part").select(F.col("p_partkey").alias("cell"), "p_size", "p_retailprice"))


@query("SELECT * FROM (VALUES ('s_suppkey', 1, 2), ('s_acctbal', 1, 2)) t(name, place_a, place_b)")
def shared_places(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    other = s.select(F.lit(1).cast("long").alias("first"), F.lit(0.5).alias("weight"), "s_acctbal", "s_suppkey")
    return spark.createDataFrame(batch.shared_places(s, other), "name string, place_a int, place_b int")


@query("SELECT p_partkey AS cell, CASE WHEN p_size > 10 THEN p_retailprice ELSE 0 END AS a, CAST(0 AS DOUBLE) AS b, 0 AS k FROM part")
def columns_appended(spark, d):
    """New columns of zeros, one of which takes the values of a vector that lacks some rows."""
    p = table(spark, d, "part")
    whole = batch.appended(p.select(F.col("p_partkey").alias("cell")), ["a", "b"], ["k"])
    vector = batch.exported(p.where("p_size > 10").select(F.col("p_partkey").alias("cell"), "p_retailprice"), "p_retailprice")
    return batch.imported(whole, vector, "a")


@query("SELECT count(*) FILTER (o_orderkey % 3 NOT IN (0, 1)) AS bad_m, count(*) FILTER (o_totalprice / 100000 NOT BETWEEN 0 AND 1) AS bad_f FROM orders")
def check_bad_masks(spark, d):
    o = table(spark, d, "orders")
    return batch.check_masks(o.select((F.col("o_orderkey") % 3).alias("m"), (F.col("o_totalprice") / 100000).alias("f")), ["m"], ["f"])


@query("""SELECT o_orderkey AS cell, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 1 END AS m, (o_orderkey % 4) / 4.0 AS f FROM orders""")
def masks_held(spark, d):
    return batch.masked_strictly(order_grid(spark, d).select("cell", "m", "f"), ["m"], ["f"])


# ---------------------------------------------------------------- index maps


@query(_DEALT + "SELECT true AS haloed FROM seg LIMIT 1")
def halo_of_copies(spark, d):
    """Segments that two parts hold meet each other."""
    return partition.haloed(partition.replicated(partition.points(_dealt(spark, d)).select("start", "length"), 2))


@query(_DEALT + "SELECT CAST(p AS INTEGER) AS part, start, length FROM seg, range(0, 3) t(p)")
def replicated_map(spark, d):
    return partition.replicated(partition.points(_dealt(spark, d)), 3)


@query(_DEALT + "SELECT 4 AS part, start, length FROM seg")
def map_at_root(spark, d):
    return partition.at_root(partition.points(_dealt(spark, d)), 4)


@query(_DEALT + """, o AS (SELECT part, start, CASE WHEN part % 2 = 0 THEN start ELSE start * 7919 % 1009 END AS pos FROM seg),
b AS (SELECT *, lag(start) OVER (PARTITION BY part ORDER BY pos, start) AS before FROM o) SELECT part, coalesce(bool_and(before IS NULL OR start > before), true) AS increasing FROM b GROUP BY 1""")
def increasing_segments(spark, d):
    """Whether the segments of each part are listed in the order of their starts; odd parts list theirs in another one."""
    seg = partition.points(_dealt(spark, d))
    listed = F.when(F.col("part") % 2 == 0, F.col("start")).otherwise(F.col("start") * 7919 % 1009)
    return partition.increasing(seg.withColumn("pos", F.struct(listed, "start")))


@query("""WITH n AS (SELECT max(o_orderkey) + 1 AS n FROM orders), b AS (SELECT p AS part, p * n // 7 + 1 AS start, (p + 1) * n // 7 AS last FROM n, range(0, 7) t(p))
SELECT o_orderkey + 1 AS index, CAST(part AS INTEGER) AS part FROM orders JOIN b ON o_orderkey + 1 BETWEEN start AND last""")
def block_owner(spark, d):
    o = table(spark, d, "orders")
    n = o.agg(F.max("o_orderkey")).first()[0] + 1
    return o.select((F.col("o_orderkey") + 1).alias("index"), partition.block_of(F.col("o_orderkey") + 1, n, 7).alias("part"))


@query("""WITH n AS (SELECT max(o_orderkey) + 1 AS n FROM orders) SELECT CAST(p AS INTEGER) AS part, p * n // 7 + 1 AS start, (p + 1) * n // 7 - p * n // 7 AS length FROM n, range(0, 7) t(p)""")
def segments_as_blocks(spark, d):
    """Blocks, cut into segments and put together again."""
    n = table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0] + 1
    cells = spark.range(1, n + 1).select(F.col("id").alias("index"), F.col("id").alias("pos"), partition.block_of(F.col("id"), n, 7).alias("part"))
    return partition.as_blocks(partition.points(cells))


@query("""WITH p AS (SELECT DISTINCT l_orderkey AS i FROM lineitem), g AS (SELECT i, i - row_number() OVER (ORDER BY i) AS k FROM p)
SELECT 0 AS part, min(i) AS start, count(*) AS length FROM g GROUP BY k""")
def matrix_rows(spark, d):
    return partition.rows_of(links(spark, d))


def _by(name: str, column: str, how) -> None:
    def run(spark, d):
        rows = links(spark, d)
        n = rows.agg(F.max(column)).first()[0]
        dealt = how(rows, partition.blocks(spark, n, 5))
        return rounded(dealt.groupBy("part").agg(F.count("*").alias("n"), F.sum("w").alias("w")), 4)

    run.__name__ = f"links_by_{name}"
    key = {"dst": "l_orderkey", "src": "l_partkey"}[column]
    query(f"""WITH n AS (SELECT max({key}) AS n FROM lineitem), b AS (SELECT p AS part, p * n // 5 + 1 AS start, (p + 1) * n // 5 AS last FROM n, range(0, 5) t(p))
SELECT CAST(part AS INTEGER) AS part, count(*) AS n, round(sum(l_discount), 4) AS w FROM lineitem JOIN b ON {key} BETWEEN start AND last GROUP BY 1""")(run)


_by("row", "dst", partition.dealt_by_row)
_by("column", "src", partition.dealt_by_column)


def _kept_product(how: str) -> None:
    def run(spark, d):
        """Three products of one kept matrix, none of which moves its links."""
        name = f"lines_{uuid.uuid4().hex}"
        matrix.keep_matrix(links(spark, d), name, int(spark.conf.get("spark.sql.shuffle.partitions")))
        p, out = parts(spark, d), []
        for k in range(3):
            field = p.select("cell", F.lit(k).alias("step"), (F.col("price") + k * F.col("size")).alias("v"))
            out.append(matrix.product(spark, name, field, ("step",), how=how))
        return rounded(out[0].unionByName(out[1]).unionByName(out[2]), 3)

    run.__name__ = f"kept_product_by_{how}"
    query("SELECT step, l_orderkey AS dst, round(sum(l_discount * (p_retailprice + step * p_size)), 3) AS y FROM lineitem JOIN part ON l_partkey = p_partkey, (SELECT CAST(unnest(range(0, 3)) AS INTEGER) AS step) GROUP BY 1, 2")(run)


_kept_product("source")
_kept_product("target")


@query(_DEALT + "SELECT o_orderkey + 1 AS cell, o_totalprice AS v, CAST(part % 5 AS INTEGER) AS part, true AS at_home FROM orders JOIN seg ON o_orderkey + 1 BETWEEN start AND start + length - 1")
def rearranged_to_owners(spark, d):
    """Orders dealt to the five parts that own them: ``at_home`` compares the partition that a row is in with its part."""
    seg = partition.points(_dealt(spark, d)).withColumn("part", F.col("part") % 5)
    rows = table(spark, d, "orders").select((F.col("o_orderkey") + 1).alias("cell"), F.col("o_totalprice").alias("v"))
    return partition.rearranged(rows, seg, 5).withColumn("at_home", F.spark_partition_id() == F.col("part"))


@query("""WITH n AS (SELECT max(o_orderkey) + 1 AS n FROM orders), b AS (SELECT p AS part, p * n // 5 + 1 AS start, (p + 1) * n // 5 AS last FROM n, range(0, 5) t(p))
SELECT o_orderkey + 1 AS cell, o_totalprice AS v, CAST(part AS INTEGER) AS part, true AS at_home FROM orders JOIN b ON o_orderkey + 1 BETWEEN start AND last""")
def transferred_between_blocks(spark, d):
    """Orders in 7 blocks sent on to 5 by a table of transfers that is found once and read the second time."""
    n, folder = table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0] + 1, _folder(spark, "transfers")
    a, b = partition.blocks(spark, n, 7), partition.blocks(spark, n, 5)
    rows = table(spark, d, "orders").select((F.col("o_orderkey") + 1).alias("cell"), F.col("o_totalprice").alias("v"))
    rows = rows.withColumn("part", partition.block_of(F.col("cell"), n, 7))
    for _ in range(2):
        lists = partition.kept_transfers(spark, folder, "blocks", a, b)
    return partition.transferred(rows, lists, 5).withColumn("at_home", F.spark_partition_id() == F.col("part"))


# ---------------------------------------------------------------- tables, strings, times


@query("SELECT n_nationkey * 5 + r_regionkey + 1 AS cell, n_name || '-' || r_name AS name FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS n_nationkey FROM nation), (SELECT r_name, row_number() OVER (ORDER BY r_name) - 1 AS r_regionkey FROM region)")
def product_of_names(spark, d):
    from .schema import product_grid

    axes = {"a": table(spark, d, "nation").select(F.col("n_name").alias("a")), "b": table(spark, d, "region").select(F.col("r_name").alias("b"))}
    return product_grid(axes).select("cell", F.concat_ws("-", "a", "b").alias("name"))


@query("""WITH n AS (SELECT CAST(floor(sqrt(count(*) // 8)) AS BIGINT) AS n FROM part), g AS (SELECT n, 2 * n AS nx, unnest(range(1, 2 * n + 1)) AS i FROM n), c AS (SELECT nx, n AS ny, i, unnest(range(1, n + 1)) AS j FROM g)
SELECT i + (j - 1) * nx AS cell, round(i * 360.0 / nx, 6) AS clo_2, round(j * 180.0 / ny - 90, 6) AS cla_3, CAST(CASE WHEN (i + (j - 1) * nx) % 7 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS mask FROM c""")
def grid_corners_stored(spark, d):
    """A grid's corners and mask, written as variables of their own and read again."""
    from .catalog_builders import size

    n, folder = size(spark, d), _folder(spark, "grids")
    grid = with_corners(regular_grid(spark, 2 * n, n))
    named = grid.select("cell", "mask", *[F.col(c)[k - 1].alias(f"{v}_{k}") for c, v in (("clon", "clo"), ("clat", "cla")) for k in range(1, 5)])
    tables.write_grid(named, folder, "boxes", tuple(c for c in named.columns if c != "cell"))
    return rounded(tables.read_grid(spark, folder, "boxes", ("clo_2", "cla_3", "mask")))


@query("SELECT 'nations' AS key, line, p AS place, CASE p WHEN 1 THEN n_name ELSE CAST(n_regionkey AS VARCHAR) END AS token FROM (SELECT n_name, n_regionkey, row_number() OVER (ORDER BY n_name) AS line FROM (SELECT regexp_replace(n_name, ' ', '_', 'g') AS n_name, n_regionkey FROM nation)), range(1, 3) t(p) UNION ALL SELECT 'count', 1, 1, CAST(count(*) AS VARCHAR) FROM nation")
def resource_table(spark, d):
    """A resource file with a line and a table, written as text and read."""
    folder = _folder(spark, "resource")
    n = table(spark, d, "nation").select(F.concat_ws(" ", F.regexp_replace("n_name", " ", "_"), "n_regionkey").alias("line"))
    text = n.agg(F.count("*").alias("n"), F.sort_array(F.collect_list("line")).alias("lines"))
    whole = F.concat(F.lit("# sizes\ncount: "), F.col("n").cast("string"), F.lit("  # nations\n\nnations::\n  "), F.array_join("lines", "\n  "), F.lit("\n::\n"))
    text.select(whole.alias("value")).coalesce(1).write.text(folder)
    return tables.resource(spark, folder).select("key", F.col("line").cast("long").alias("line"), F.col("place").cast("long").alias("place"), "token")


@query("""SELECT event_id, strftime(ts, 'run_%Y%m_%y-') || month(ts) || '/' || lower(strftime(ts, '%b')) || day(ts) || '.' || strftime(ts, '%d_') || hour(ts) || strftime(ts, '_%H') || lpad(CAST(hour(ts) AS VARCHAR), 3, '0') || strftime(ts, '%M') AS name FROM events""")
def template_dates(spark, d):
    name = fn.template_date(F.lit("run_%y4%m2_%y2-%m1/%mc%d1.%d2_%h1_%h2%h3%n2"), F.col("ts").cast("timestamp_ntz"))
    return table(spark, d, "events").select("event_id", name.alias("name"))


@query("""SELECT p_partkey, p_name AS tagged, 'a/' || p_brand AS parent, 'x ' || p_brand || ' y' AS clean, CAST(20240100 + p_partkey % 28 + 1 AS VARCHAR) AS digits,
'2024-01-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') AS date FROM part""")
def string_parts(spark, d):
    day = 20240100 + F.col("p_partkey") % 28 + 1
    return table(spark, d, "part").select(
        "p_partkey",
        fn.between_tags(F.concat(F.lit("<a><n>"), "p_name", F.lit("</n>")), "<n>", "</n>").alias("tagged"),
        fn.parent_dir(F.concat(F.lit("a/"), "p_brand", F.lit("/file.nc"))).alias("parent"),
        fn.cleaned(F.concat(F.lit("  x \t"), "p_brand", F.lit("\n\n y "))).alias("clean"),
        day.cast("string").alias("digits"),
        fn.yyyymmdd_to_date(day).alias("date"),
    )


@query("""SELECT n_nationkey, n_name || ':U' AS middle, NOT contains(n_name, ' ') AS valid, false AS doubled FROM nation""")
def list_ranges(spark, d):
    names = F.concat_ws(":", F.lit("T"), "n_name", F.lit("U"), F.lit("V"))
    return table(spark, d, "nation").select("n_nationkey", fn.list_range(names, 2, 3).alias("middle"), fn.list_valid(names).alias("valid"), fn.list_valid(F.concat(names, F.lit("::x"))).alias("doubled"))
