"""Exact sums, legs that are run again, maps by content, runs of many entries, streams as state, NetCDF files, kept matrices."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from gridflow import catalog
from gridflow.operators import batch, exact, matrix, partition, reduce, timewin
from gridflow.plans import coupled
from gridflow.plans import exchange as plan
from gridflow.schema import regular_grid
from gridflow.sources import netcdf, tables
from gridflow.streaming import stateful, windows

PUTS = "field string, cell long, t long, v double"


# ---------------------------------------------------------------- exact sums


def test_exact_sums_equal_those_of_fractions(spark):
    rng = random.Random(1)
    groups = {
        0: [rng.choice([1, -1]) * rng.random() * 10.0 ** rng.randrange(-300, 300) for _ in range(400)],
        1: [0.1] * 10,
        2: [1e300, -1e300, 1e-300],
        3: [5e-324] * 3,
        4: [0.0, -0.0],
        5: [2.0**24, 2.0**48, 1 - 2.0**48],
        6: [1.7e308, 1e292],
        7: [-rng.random() / 7 for _ in range(300)],
        8: [float(2**53), 1.0, 1.0, -3.0],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [(9, math.inf), (9, 1.0), (10, math.inf), (10, -math.inf), (11, None)]
    got = {r.k: r.y for r in exact.exact_sums(spark.createDataFrame(rows, "k long, v double"), {"y": F.col("v")}, ("k",)).collect()}
    for k, vs in groups.items():
        want = math.fsum(vs)
        assert got[k] == want or abs(got[k] - want) <= 2 * math.ulp(want), (k, got[k], want)
    assert got[9] == math.inf and math.isnan(got[10]) and 11 not in got


def test_equal_bits_on_any_partitions(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(i, "f", 0, rng.random() * 10.0 ** rng.randrange(-9, 9), rng.random(), int(rng.random() < 0.2)) for i in range(3000)], "cell long, field string, t long, v double, area double, mask int")
    seen = set()
    for n in (1, 3, 7, 61):
        src = rows.repartition(n)
        out = reduce.conserve(src, src.withColumn("v", F.col("v") * 1.25), "GLOBAL", keys=("field", "t"), how="bfb")
        seen.add(tuple(r.v.hex() for r in out.orderBy("cell").collect()))
    assert len(seen) == 1
    assert exact.exact_sums(rows.limit(0), {"y": F.col("v")}).first().y is None


# ---------------------------------------------------------------- legs


def entry(**given):
    return plan.Entry(("f",), ("f",), 10, **given)


def test_a_leg_that_is_run_again_leaves_the_same_tables(spark, tmp_path):
    folder = str(tmp_path)
    puts = spark.createDataFrame([("f", 1, t, float(t)) for t in range(60)], PUTS)
    e = entry(status="EXPOUT", loctrans="AVERAGE", lag=5, restart="f")
    tables.write_restart(spark.createDataFrame([("f", 1, 7.0)], "field string, cell long, v double"), folder, "f", "ready")
    first = plan.run_leg(e, puts, 0, 30, folder, first=True).orderBy("t").collect()
    plan.run_leg(e, puts, 30, 60, folder)
    again = plan.run_leg(e, puts, 0, 30, folder, first=True).orderBy("t").collect()
    assert first == again
    last = plan.run_leg(e, puts, 30, 60, folder).orderBy("t").collect()
    whole = {r.t: r.v for r in timewin.loctrans(puts, "AVERAGE", 10, 5).collect()}
    assert {r.t: r.v for r in [*first, *last]} == {0: 7.0} | {t: v for t, v in whole.items() if 0 < t < 60}
    held = tables.read_records(spark, folder, ("f",), 0, 60, 10).collect()
    assert sorted(r.t for r in held) == [0, 10, 20, 30, 40, 50]


def test_what_is_not_committed_is_not_read(spark, tmp_path):
    folder = str(tmp_path)
    puts = spark.createDataFrame([("f", 1, t, float(t)) for t in range(20)], PUTS)
    tables.append_output(puts, folder, "f", 0)
    with pytest.raises(LookupError, match="no record of f at 0"):
        tables.read_input(spark, folder, "f", 0)
    with pytest.raises(LookupError, match="no leg of f that ends at 10"):
        plan.run_leg(entry(), puts, 10, 20, folder)
    tables.commit(spark, folder, "f", 0, 20)
    assert tables.read_records(spark, folder, ("f",), 0, 20, 5).count() == 4
    with pytest.raises(LookupError, match="f at 20"):
        tables.read_records(spark, folder, ("f",), 0, 30, 10)


def test_value_arrays_go_through_a_leg_as_through_an_exchange(spark, tmp_path):
    puts = spark.createDataFrame([("f", 1, 10, 1.0, 100.0)], PUTS + ", v2 double")
    links = spark.createDataFrame([(5, 1, 1.0, 1.0)], "dst long, src long, w double, w2 double")
    e = entry(map_mode="sum")
    assert plan.exchange(e, puts, links).first().v == 101.0
    assert plan.run_leg(e, puts, 0, 20, str(tmp_path), links, first=True).first().v == 101.0


def test_extremes_take_one_array(spark):
    puts = spark.createDataFrame([("f", 1, 10, 1.0, 100.0)], PUTS + ", v2 double")
    for transform in ("T_MIN", "T_MAX"):
        with pytest.raises(ValueError, match="takes one value array"):
            timewin.leg(puts, transform, 10, 0, 0, 20, values=("v", "v2"))
    with pytest.raises(ValueError, match="sources for"):
        plan.Entry(("a", "b"), ("c",), 10)


def test_repeated_links_of_a_pair_are_one(spark):
    puts = spark.createDataFrame([("f", 1, 10, 3.0)], PUTS)
    links = spark.createDataFrame([(5, 1, 0.1)] * 10 + [(6, 1, 2.0)], "dst long, src long, w double")
    assert {r.cell: r.v for r in plan.exchange(entry(), puts, links).collect()} == {5: 3.0, 6: 6.0}


def test_a_changed_grid_builds_a_new_map(spark, tmp_path):
    src, dst = regular_grid(spark, 6, 3), regular_grid(spark, 4, 2)
    remap, folder, made = plan.Remap("DISTWGT", neighbours=2), str(tmp_path), []

    def links(a, r=remap):
        return {tuple(x) for x in plan.remapped(spark, folder, "a_to_b", r, a, dst).collect()}

    one = links(src)
    assert links(src.repartition(5)) == one
    other = links(src.withColumn("mask", F.when(F.col("cell") % 2 == 0, 1).otherwise(0)))
    assert other != one and links(src) == one
    assert links(src, plan.Remap("DISTWGT", neighbours=3)) != one
    for _ in range(2):
        plan.stored(spark, folder, "counted", lambda: made.append(1) or spark.createDataFrame([(1, 2, 0.5)], "dst long, src long, w double"), of=(src, "x"))
    assert made == [1]
    assert batch.fingerprint(src) == batch.fingerprint(src.repartition(7)) != batch.fingerprint(src.limit(3))


def test_owned_weights_are_read_from_their_files(spark, tmp_path):
    links = spark.range(100_000).select((F.col("id") * 7919 % 100_000).alias("dst"), F.col("id").alias("src"), F.lit(0.5).alias("w"))
    tables.write_weights(links, str(tmp_path), "m")
    owned = spark.range(5000, 6000).select(F.col("id").alias("dst"))
    read = tables.read_weights(spark, str(tmp_path), "m", owned)
    assert read.count() == 1000
    assert "PushedFilters: [IsNotNull(dst), GreaterThanOrEqual(dst,5000), LessThanOrEqual(dst,5999)" in read._jdf.queryExecution().toString()
    spans = spark.read.parquet(f"{tmp_path}/map=m").groupBy(F.input_file_name().alias("f")).agg(F.min("dst").alias("lo"), F.max("dst").alias("hi")).orderBy("lo").collect()
    assert all(a.hi < b.lo for a, b in zip(spans, spans[1:], strict=False))


# ---------------------------------------------------------------- runs of many entries


def joint(source, target, a, b, **given):
    e = plan.Entry((source,), (target,), given.pop("dt", 10), restart="r", map_mode="sum", **given)
    return coupled.Coupled(e, a, b, begin=given.get("begin", object()))


def test_levels_follow_what_is_heard():
    run = plan.Run(60, ("A", "B"))
    assert coupled.levels([joint("x", "y", "A", "B")], run) == [[(0, t) for t in range(0, 60, 10)]]
    both = [joint("x", "y", "A", "B", lag=2), joint("u", "v", "B", "A", lag=3, dt=20)]
    assert coupled.levels(both, run) == [[(0, 0), (1, 0)], [(0, 10), (0, 20)], [(1, 20)], [(0, 30), (0, 40)], [(1, 40)], [(0, 50)]]
    ordered = [joint("x", "y", "A", "B", seq=1), joint("u", "v", "B", "A", seq=2)]
    assert coupled.levels(ordered, plan.Run(20, ("A", "B"))) == [[(0, 0)], [(1, 0)], [(0, 10)], [(1, 10)]]
    assert len(coupled.levels([joint("x", "y", "A", "B", dt=1, lag=1), joint("u", "v", "B", "A", dt=1, lag=1)], plan.Run(9000, ("A", "B")))) == 9000


def test_cycles_and_wrong_couplings_are_told_at_once(spark):
    run = plan.Run(60, ("A", "B"))
    with pytest.raises(ValueError, match="entries wait for each other: x at 0 and u at 0"):
        coupled.run_coupled(spark, [joint("x", "y", "A", "B"), joint("u", "v", "B", "A")], {}, run)
    for wrong, what in (([joint("x", "y", "A", "C")], "not a component"), ([joint("x", "y", "A", "B"), joint("z", "y", "A", "B")], "several sources"), ([joint("x", "y", "A", "B", seq=0)], "SEQ")):
        with pytest.raises(ValueError, match=what):
            coupled.run_coupled(spark, wrong, {}, run)


def test_a_run_equals_one_step_after_the_other(spark):
    """Two components that answer each other, once with delays and once by SEQ."""
    cells = [1, 2]

    def model(name, hears):
        def put(received, start, end):
            own = spark.createDataFrame([(name, c, t, float(c * t)) for c in cells for t in range(start, end)] or [], PUTS)
            return coupled.latest(own, received, {hears: "heard"}).select("field", "cell", "t", (F.col("v") + F.col("heard") / 2).alias("v"))

        return put

    def expected(lags, seqs, dts, runtime):
        got = {("y", 0): {c: 5.0 for c in cells} if lags[0] else None, ("v", 0): {c: 5.0 for c in cells} if lags[1] else None}
        for t in range(runtime):
            for k in sorted((0, 1), key=lambda k: seqs[k]):
                target, hears, dt, lag = ("y", "v")[k], ("v", "y")[k], dts[k], lags[k]
                if t % dt or (t == 0 and lag):
                    continue
                p = t - lag
                known = [(x, v) for (f, x), v in got.items() if f == hears and v is not None and (x <= p if seqs[1 - k] <= seqs[k] else x < p)]
                latest = max(known, key=lambda x: x[0])[1] if known else dict.fromkeys(cells, 0.0)
                got[target, t] = {c: c * p + latest[c] / 2 for c in cells}
        return {(f, t, c): v for (f, t), vs in got.items() if vs for c, v in vs.items()}

    for lags, seqs, dts in (((2, 3), (1, 1), (5, 10)), ((0, 0), (1, 2), (5, 5))):
        begin = lambda n: spark.createDataFrame([(n, c, 5.0) for c in cells], "field string, cell long, v double")
        entries = [
            coupled.Coupled(plan.Entry((s,), (t,), dts[k], lag=lags[k], seq=seqs[k], restart="r", map_mode="sum"), a, b, begin=begin(s))
            for k, (s, t, a, b) in enumerate((("x", "y", "A", "B"), ("u", "v", "B", "A")))
        ]
        out = coupled.run_coupled(spark, entries, {"A": model("x", "v"), "B": model("u", "y")}, plan.Run(20, ("A", "B")))
        assert {(r.field, r.t, r.cell): r.v for r in out.collect()} == expected(lags, seqs, dts, 20)


# ---------------------------------------------------------------- streams


def test_state_begins_from_a_restart_and_is_read_back(spark, tmp_path):
    landing, folder = str(tmp_path / "puts"), str(tmp_path / "run")
    spark.createDataFrame([("f", 1, 12, 4.0), ("f", 1, 19, 6.0), ("g", 2, 31, 1.0)], PUTS).write.parquet(landing)
    begin = spark.createDataFrame([("f", 1, 2, 10.0, 2)], "field string, cell long, w long, v double, cnt long")
    stream = stateful.windows(spark.readStream.schema(PUTS).parquet(landing), "AVERAGE", 10, begin=begin)
    out = stateful.drain(stream, folder)
    assert [(r.field, r.cell, r.t, r.v) for r in out.collect()] == [("f", 1, 20, 5.0)]
    assert [tuple(r) for r in stateful.left_open(spark, folder).collect()] == [("g", 2, 4, 1.0, 1)]
    with pytest.raises(ValueError, match="takes one value array"):
        stateful.windows(spark.readStream.schema(PUTS).parquet(landing), "T_MAX", 10, values=("v", "v2"))


def test_puts_at_the_start_of_a_run_are_not_late(spark, tmp_path):
    landing = str(tmp_path / "puts")
    early = [("f", 1, t, float(t)) for t in (-25, 0, 1, 2)]
    spark.createDataFrame([*early, ("f", 1, 50, 0.0)], PUTS).write.parquet(landing)
    puts = spark.readStream.schema(PUTS).parquet(landing)
    want = [(-20, -25.0), (0, 0.0), (10, 2.0)]
    for k, stream in enumerate((windows.loctrans(puts, "T_MAX", 10), stateful.windows(puts, "T_MAX", 10))):
        drain = (windows, stateful)[k].drain
        assert sorted((r.t, r.v) for r in drain(stream, str(tmp_path / f"run{k}")).collect()) == want
    ready = windows.drain(windows.ready(puts, ["f"], 10), str(tmp_path / "ready"))
    assert sorted((r.w, r.ready) for r in ready.collect()) == [(-2, True), (0, True), (1, True)]


def test_windows_of_many_keys_stay_in_the_aggregation(spark, tmp_path):
    landing, folder, values = str(tmp_path / "puts"), str(tmp_path / "run"), ("v", "v2")
    rows = spark.range(600).select(F.lit("f").alias("field"), (F.col("id") % 200).alias("cell"), (F.floor(F.col("id") / 200) * 10 + 5).alias("t"), F.col("id").cast("double").alias("v"), F.lit(2.0).alias("v2"))
    rows.write.parquet(landing)
    stream = stateful.windows(stateful.with_clock(spark.readStream.schema(rows.schema).parquet(landing), str(tmp_path / "clock"), values), "AVERAGE", 10, values=values)
    assert "InPandas" not in stream._jdf.queryExecution().logical().toString()  # no call of Python for a key or a window
    assert stateful.drain(stream, folder).count() == 400
    left = {r.cell: (r.w, r.v, r.v2, r.cnt) for r in stateful.left_open(spark, folder, values).collect()}
    assert left == {c: (3, 400.0 + c, 2.0, 1) for c in range(200)}
    stateful.tick(spark, str(tmp_path / "clock"), 50)
    got = stateful.drain(stream, folder)
    assert sorted((r.t, r.cell, r.v, r.v2) for r in got.collect()) == [(10 * k + 10, c, 200.0 * k + c, 2.0) for k in range(3) for c in range(200)]
    assert stateful.left_open(spark, folder, values).isEmpty()


# ---------------------------------------------------------------- NetCDF


def record_file(path, records, ny):
    """A CDF-1 file with an unlimited dimension: t(time), a(time, y) and a fixed b(y) of shorts."""
    name = lambda s: struct.pack(">i", len(s)) + s.encode().ljust(-(-len(s) // 4) * 4, b"\0")

    def head(begins):
        out = b"CDF\x01" + struct.pack(">iii", records, 10, 2) + name("time") + struct.pack(">i", 0) + name("y") + struct.pack(">i", ny) + struct.pack(">iiii", 0, 0, 11, 3)
        for n, dims, kind, size, begin in (("t", (0,), 4, 4, begins[0]), ("a", (0, 1), 6, 8 * ny, begins[1]), ("b", (1,), 3, -(-2 * ny // 4) * 4, begins[2])):
            out += name(n) + struct.pack(f">i{len(dims)}i", len(dims), *dims) + struct.pack(">ii", 0, 0) + struct.pack(">iii", kind, size, begin)
        return out

    base = len(head((0, 0, 0)))
    fixed = struct.pack(f">{ny}h", *range(ny)).ljust(-(-2 * ny // 4) * 4, b"\0")
    first = base + len(fixed)
    body = b"".join(struct.pack(">i", 100 + r) + struct.pack(f">{ny}d", *[r + k / 8 for k in range(ny)]) for r in range(records))
    path.write_bytes(head((first, first + 4, base)) + fixed + body)


def test_records_are_read_in_stretches(spark, tmp_path):
    netcdf.register(spark)
    path, records, ny = tmp_path / "a.nc", 13, 5
    record_file(path, records, ny)
    read = lambda **o: spark.read.format("netcdf").options(**o).load(str(path))
    a = read(dimensions="time,y", points="17")
    assert a.columns == ["index", "a"] and sorted(map(tuple, a.collect())) == [(r * ny + k + 1, r + k / 8) for r in range(records) for k in range(ny)]
    t = read(dimensions="time", points="4")
    assert t.columns == ["index", "t", "a"] and sorted((r["index"], r.t, r.a) for r in t.collect()) == [(r + 1, 100 + r, [r + k / 8 for k in range(ny)]) for r in range(records)]
    assert [r.b for r in read(variables="b").orderBy("index").collect()] == list(range(ny))
    with pytest.raises(Exception, match="no variable z"):
        read(variables="z").count()


def test_stretches_never_share_bytes(spark, tmp_path):
    record_file(tmp_path / "a.nc", 40, 3)
    record_file(tmp_path / "b.nc", 7, 3)
    reader = netcdf.Reader(None, {"path": str(tmp_path), "dimensions": "time,y", "points": "10"})
    parts = reader.partitions()
    covered = sorted((p.path, p.start, p.end) for p in parts)
    assert len(parts) > 10 and all(a[2] == b[1] if a[0] == b[0] else b[1] == 0 for a, b in zip(covered, covered[1:], strict=False))
    assert sum(p.end - p.start for p in parts) == 3 * 47 and sorted(p.index for p in parts)[0] == 1


def test_tables_come_back_from_files(spark, tmp_path):
    netcdf.register(spark)
    rows = spark.createDataFrame([(k, k / 3 if k % 5 else None, "é" * (k % 4), [k, 2 * k], k % 7) for k in range(100)], "cell long, v double, name string, w array<long>, small int")
    for _ in range(2):
        rows.repartition(3).write.format("netcdf").mode("overwrite").save(str(tmp_path / "x"))
    back = spark.read.format("netcdf").option("dimensions", "cell_count").option("points", 9).load(str(tmp_path / "x"))
    assert sorted(map(str, back.select(rows.columns).collect())) == sorted(map(str, rows.collect()))
    assert sorted(r["index"] for r in back.collect()) == list(range(1, 101))
    with pytest.raises(Exception, match="beyond 2"):
        rows.withColumn("cell", F.lit(2**60)).write.format("netcdf").mode("overwrite").save(str(tmp_path / "y"))
    with pytest.raises(Exception, match="not a NetCDF"):
        (tmp_path / "z.nc").write_bytes(b"no such file")
        spark.read.format("netcdf").load(str(tmp_path / "z.nc"))


def test_partitions_without_rows_write_no_file(spark, tmp_path):
    netcdf.register(spark)
    rows = spark.createDataFrame([(k, k / 3, "x") for k in range(3)], "cell long, v double, name string").repartition(8, "cell")
    assert rows.select(F.spark_partition_id()).distinct().count() < 8
    rows.write.format("netcdf").mode("overwrite").save(str(tmp_path / "x"))
    read = spark.read.format("netcdf").schema("cell long, v double")
    assert sorted(map(tuple, read.load(str(tmp_path / "x")).collect())) == [(k, k / 3) for k in range(3)]
    rows.where("cell < 0").write.format("netcdf").mode("overwrite").save(str(tmp_path / "x"))
    assert read.load(str(tmp_path / "x")).count() == 0


# ---------------------------------------------------------------- matrices and decompositions


def test_products_do_not_move_a_kept_matrix(spark):
    links = spark.range(4000).select((F.col("id") % 300).alias("dst"), (F.col("id") * 7 % 500).alias("src"), (F.col("id") / 8).alias("w"))
    matrix.keep_matrix(links, "test map", 4)
    field = spark.range(500).select(F.col("id").alias("cell"), (F.col("id") * 1.5).alias("v"))
    want = {r.dst: r.y for r in links.join(field, F.col("src") == F.col("cell")).groupBy("dst").agg(F.sum(F.col("w") * F.col("v")).alias("y")).collect()}
    assert matrix.strategy(field) == "target" and matrix.strategy(field, 10) == "source"
    for how, exchanges in (("target", 0), ("source", 2)):
        y = matrix.product(spark, "test map", field, how=how)
        text = y._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in text and text.count("Exchange hashpartitioning") == exchanges, text
        got = {r.dst: r.y for r in y.collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_rows_are_where_their_owners_are(spark, tmp_path):
    segments = spark.createDataFrame([(0, 1, 10), (1, 11, 5), (2, 16, 2000), (0, 2016, 50)], "part int, start long, length long")
    rows = spark.range(0, 2100).select(F.col("id").alias("cell"), (F.col("id") * 2).alias("v"))
    out = partition.rearranged(rows, segments, 3).withColumn("at", F.spark_partition_id())
    assert out.where("at <> part").isEmpty() and out.count() == 2065
    other = spark.createDataFrame([(1, 1, 1000), (0, 1001, 1065)], "part int, start long, length long")
    lists = [partition.kept_transfers(spark, str(tmp_path), "x", segments, other) for _ in range(2)]
    assert len(list((tmp_path / "transfers").iterdir())) == 1
    moved = partition.transferred(out.drop("at"), lists[1], 2).withColumn("at", F.spark_partition_id())
    assert moved.where("at <> part OR part <> IF(cell <= 1000, 1, 0)").isEmpty() and moved.count() == 2065


def test_overlapping_columns_leave_a_grid(spark):
    whole = regular_grid(spark, 10, 4)
    assert plan.without_overlap(whole, 10, 2).agg(F.max("i")).first()[0] == 8
    src = regular_grid(spark, 8, 4)
    wide = src.unionByName(src.where("i <= 2").withColumns({"i": F.col("i") + 8, "cell": F.col("cell") + 1000}))
    remap, dst = plan.Remap("BILINEAR"), regular_grid(spark, 5, 3)
    one, two = ({tuple(r) for r in remap.weights(s, dst, nx, overlap=o).select("dst", "src", F.round("w", 9)).collect()} for s, nx, o in ((src, 8, 0), (wide, 10, 2)))
    assert one == two


# ---------------------------------------------------------------- sides near the poles


def rotated(spark, n, tilt=0.9):
    """Cells of a grid of 2n x n boxes, turned about the y axis so that a pole lies among them: corners and centres in degrees."""
    rows = []
    turn = lambda x, y, z: (x * math.cos(tilt) + z * math.sin(tilt), y, -x * math.sin(tilt) + z * math.cos(tilt))

    def at(lon, lat):
        a, b = math.radians(lon), math.radians(lat)
        x, y, z = turn(math.cos(b) * math.cos(a), math.cos(b) * math.sin(a), math.sin(b))
        return math.degrees(math.atan2(y, x)) % 360, math.degrees(math.asin(max(-1.0, min(1.0, z))))

    h = 60 / n
    for i in range(n):
        for j in range(n):
            lon, lat = 150 + i * h + 0.013, 90 - math.degrees(tilt) - 30 + j * h + 0.017
            box = [(lon, lat), (lon + h, lat), (lon + h, lat + h), (lon, lat + h)]
            centre = at(lon + h / 2, lat + h / 2)
            points = [at(*p) for p in box]
            rows.append((i * n + j, *centre, [p[0] for p in points], [p[1] for p in points], 0))
    return spark.createDataFrame(rows, "cell long, lon double, lat double, clon array<double>, clat array<double>, mask int")


def sphere_area(clon, clat):
    """Area of a polygon of great circles by its angles."""
    import numpy as np

    a, b = np.radians(clon), np.radians(clat)
    p = np.stack((np.cos(b) * np.cos(a), np.cos(b) * np.sin(a), np.sin(b)), 1)
    total = 0.0
    for k in range(1, len(p) - 1):
        u, v, w = p[0], p[k], p[k + 1]
        total += 2 * math.atan2(float(u @ np.cross(v, w)), 1 + float(u @ v) + float(v @ w) + float(w @ u))
    return abs(total)


def test_areas_near_the_pole_converge_to_those_of_great_circles(spark):
    from gridflow.operators import polygons

    grid = rotated(spark, 6)
    exact_ = {r.cell: sphere_area(r.clon, r.clat) for r in grid.collect()}
    near = {r.cell for r in grid.collect() if max(map(abs, r.clat)) > math.degrees(1.45)}
    assert len(near) >= 2  # cells at the pole, and one around it
    errors = []
    for parts in (1, 4, 8, 16, 32):
        got = {r.cell: r.area for r in polygons.measured(polygons.with_great_circles(grid, parts, 0.0)).collect()}
        errors.append(sum(abs(got[c] - exact_[c]) for c in near))
    assert errors[0] > 1e-3 and all(3.5 < a / b < 4.5 for a, b in zip(errors[1:], errors[2:], strict=False)), errors


def test_parts_of_cells_with_great_circles_add_up(spark):
    from gridflow.operators import polygons

    src, dst = rotated(spark, 6), rotated(spark, 4)
    links = plan.Remap("CONSERV", norm="NONE", order="FIRST", arcs=16).weights(src, dst)
    inner = {r.cell for r in src.collect() if r.cell // 6 in range(1, 5) and r.cell % 6 in range(1, 5)}
    sums = {r.src: r.w for r in links.groupBy("src").agg(F.sum("w1").alias("w")).collect()}
    whole = {r.cell: r.area for r in polygons.measured(polygons.with_great_circles(src, 16)).collect()}
    assert all(abs(sums[c] - whole[c]) < 1e-3 * whole[c] for c in inner), [(c, sums[c], whole[c]) for c in inner]


def test_puts_of_one_place_are_called_by_event(spark, tmp_path):
    rows = [(1_000_004, "2024-01-01 01:00:00", 7), (1, "2024-01-01 02:00:00", 7)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long").coalesce(1)
    events = events.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("").alias("props"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.QUERIES["backward_shuffled"](spark, str(tmp_path)).select("t", "seen").collect()
    assert [tuple(r) for r in got] == [(3600, 7200)]


@pytest.mark.parametrize("name", ["backward_shuffled", "stream_backward"])
def test_places_go_before_events_of_any_number(spark, tmp_path, name):
    rows = [(245_369, "2024-01-01 02:00:00", 7), (10**12, "2024-01-01 01:00:00", 7), (10**12 + 1_000_003, "2024-01-01 03:00:00", 7)]  # places 71,282 and twice 71,271
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long").coalesce(1)
    events = events.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("").alias("props"))
    events.write.parquet(str(tmp_path / "in" / "events.parquet"))
    # the stream reads a file of that name
    next((tmp_path / "in" / "events.parquet").glob("part-*")).rename(tmp_path / "events.parquet")
    got = catalog.QUERIES[name](spark, str(tmp_path)).select("t", "seen").collect()
    assert [tuple(r) for r in got] == [(7200, 10800)]
