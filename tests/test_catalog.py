"""Every registered query with SQL gives the same rows in DuckDB; and edge cases of the operators."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridflow import catalog
from gridflow.operators import batch, partition, reduce, remap, timewin, weights
from gridflow.plans.exchange import Entry
from gridflow.schema import regular_grid
from gridflow.sources import tables
from gridflow.streaming import windows

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(rows):
    def key(x):
        return (x is None, "" if x is None else str(type(x)) if isinstance(x, str) else "", x if isinstance(x, str) else 0 if x is None else float(x))

    return sorted(([*r] for r in rows), key=lambda r: [key(x) for x in r])


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_against_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = plain(df.select(*columns).collect())
    rel = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = plain([r[i] for i in at] for r in rel.fetchall())
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        for a, b in zip(g, w, strict=True):
            assert a == b or (isinstance(a, float) and math.isclose(a, float(b), abs_tol=1e-9))


def test_conservative_weights_sum_to_the_sphere(spark):
    w = weights.conservative_weights(regular_grid(spark, 12, 6).withColumn("mask", F.lit(0)), regular_grid(spark, 8, 4), "NONE")
    assert math.isclose(w.agg(F.sum("w")).first()[0], 4 * math.pi, rel_tol=1e-12)


def test_conservation_guards(spark):
    one = spark.createDataFrame([(1, 1.0, 1.0, 1)], "cell long, v double, area double, mask int")
    for mode in ("GLOBAL", "BASBAL"):
        with pytest.raises(Exception, match="active area is 0"):
            reduce.conserve(one, one, mode).collect()
    with pytest.raises(ValueError):
        reduce.conserve(one, one, "OTHER")


def test_lag_bounds():
    for lag in (-10, 11):
        with pytest.raises(ValueError):
            timewin.check_lag(10, lag)
    with pytest.raises(ValueError):
        Entry(("a",), ("b",), 10, lag=20)


def test_windows_close_on_the_lattice(spark):
    puts = spark.createDataFrame([("f", 1, t, float(t)) for t in (0, 5, 10, 11, 20)], "field string, cell long, t long, v double")
    got = {r.t: r.v for r in timewin.loctrans(puts, "AVERAGE", 10).collect()}
    assert got == {0: 0.0, 10: 7.5, 20: 15.5}


def test_bilinear_partition_of_unity(spark):
    w = weights.bilinear_weights(regular_grid(spark, 16, 8), 24, 12).groupBy("dst").agg(F.sum("w").alias("s"))
    assert w.where("abs(s - 1) > 1e-12").isEmpty() and w.count() == 128


def test_segments_of_nothing(spark):
    none = spark.createDataFrame([], "part int, pos long, index long")
    assert partition.points(none).isEmpty()


def test_targets_without_links_are_zero(spark):
    links = spark.createDataFrame([(1, 1, 0.5)], "dst long, src long, w double")
    field = spark.createDataFrame([(1, 4.0)], "cell long, x double")
    targets = spark.createDataFrame([(1,), (2,)], "cell long")
    got = {r.cell: r.y for r in remap.zero_filled(remap.apply_weights(links, field, {"x": "y"}), targets, ["y"]).collect()}
    assert got == {1: 2.0, 2: 0.0}


def brute_distances(src, dst):
    """Angles of all targets (rows) and sources (columns)."""

    def xyz(g):
        lon, lat = np.radians(g["lon"].to_numpy()), np.radians(g["lat"].to_numpy())
        return np.stack((np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)), axis=1)

    return np.arccos(np.clip(xyz(dst) @ xyz(src).T, -1, 1))


def brute_shares(src, dst, k, weigh):
    """Sums that ties can't change: {target: (weights' sum, largest weight)} of the unmasked among the k nearest."""
    d, masked, out = brute_distances(src, dst), src["mask"].to_numpy() != 0, {}
    for row, (cell, mask) in enumerate(zip(dst["cell"], dst["mask"], strict=True)):
        if mask:
            continue
        best = np.lexsort((src["cell"], np.round(d[row], 12)))[:k]
        w = np.array([0 if masked[i] else weigh(d[row, i]) for i in best])
        out[cell] = (1.0, (w / w.sum()).max()) if w.sum() > 0 else (1.0, 1.0)
    return out


@pytest.fixture(scope="module")
def grids(spark, sf):
    """What the registered queries search: customers as sources and suppliers as targets."""
    return [points(spark, sf).orderBy("cell").toPandas() for points in (catalog._customers, catalog._suppliers)]


def held_against(rows, want):
    got = {r.dst: (r.w_sum, r.w_max) for r in rows}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], atol=2e-6) for k in got)


def test_distance_weights_by_brute_force(spark, sf, grids):
    held_against(catalog.distwgt(spark, sf).collect(), brute_shares(*grids, 4, lambda d: 1 / (d + weights.EPSILON)))


def test_distance_weights_of_parts_by_brute_force(spark, tmp_path):
    for n, ny in ((300, 12), (1000, 22)):
        spark.range(n).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/{n}/part.parquet")
        both = [regular_grid(spark, nx, ny).orderBy("cell").toPandas() for nx in (2 * ny, ny)]
        held_against(catalog.distwgt_of_parts(spark, f"{tmp_path}/{n}").collect(), brute_shares(*both, 4, lambda d: 1 / (d + weights.EPSILON)))


def test_gaussian_weights_by_brute_force(spark, sf, grids):
    src = grids[0]
    mean = brute_distances(src, src)[np.arange(len(src)), np.roll(np.arange(len(src)), -1)].mean()
    held_against(catalog.gauswgt(spark, sf).collect(), brute_shares(*grids, 4, lambda d: math.exp(-0.5 * d * d / (2.0 * mean * mean))))


def test_masked_bilinear_leaves_no_masked_source(spark):
    src, dst = regular_grid(spark, 24, 12), regular_grid(spark, 16, 8)
    w = weights.masked_bilinear_weights(src, dst, 24, 12)
    assert w.join(src.where("mask <> 0"), w["src"] == src["cell"], "left_semi").isEmpty()
    sums = {x.dst: x.s for x in w.groupBy("dst").agg(F.sum("w").alias("s")).collect()}
    assert sums.keys() == {x.cell for x in dst.where("mask = 0").collect()}
    assert all(math.isclose(s, 1, abs_tol=1e-12) for s in sums.values())
    plain_ = weights.bilinear_weights(dst, 24, 12)
    open_ = weights.masked_bilinear_weights(src.withColumn("mask", F.lit(0)), dst.withColumn("mask", F.lit(0)), 24, 12)
    assert open_.exceptAll(plain_).isEmpty() and plain_.exceptAll(open_).isEmpty()


def test_bicubic_follows_the_smooth_field(spark, sf):
    got = {x.dst: x.v for x in catalog.bicubic_rectilinear(spark, sf).toDF("dst", "v").collect()}
    dst = catalog._customers(spark, sf)
    want = {x.cell: (x.v, x.lat) for x in dst.select("cell", "lat", catalog.analytic_field(F.col("lon"), F.col("lat")).alias("v")).collect()}
    assert got.keys() == want.keys()
    inner = [abs(got[c] - v) for c, (v, lat) in want.items() if abs(lat) < 67.5]
    assert max(inner) < 0.05 and sum(inner) / len(inner) < 0.01


def test_tables_replace_by_partition_and_miss_loudly(spark, tmp_path):
    folder = str(tmp_path / "restart")
    rows = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0)], "field string, cell long, v double")
    with pytest.raises(LookupError):
        tables.read_restart(spark, folder, "e", "lag")
    assert tables.read_restart(spark, folder, "e", "lag", required=False).isEmpty()
    tables.write_restart(rows, folder, "e", "lag")
    tables.write_restart(rows.where("field = 'a'").withColumn("v", F.lit(9.0)), folder, "e", "lag")
    tables.write_restart(rows, folder, "other", "lag")
    assert {(x.field, x.v, x.cnt) for x in tables.read_restart(spark, folder, "e", "lag").collect()} == {("a", 9.0, 1), ("b", 2.0, 1)}
    out = str(tmp_path / "output")
    tables.append_output(rows.withColumn("t", F.lit(10).cast("long")), out)
    assert tables.read_input(spark, out, "a", 10).count() == 1
    for field, t in (("a", 11), ("c", 10)):
        with pytest.raises(LookupError):
            tables.read_input(spark, out, field, t)
    with pytest.raises(LookupError):
        tables.read_grid(spark, str(tmp_path / "grids"), "g", ("area",))


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    kind = "field string, cell long, t long, v double"
    source, work = str(tmp_path / "in"), str(tmp_path / "work")
    for rows in ([("f", 1, 5, 1.0), ("f", 1, 10, 3.0), ("f", 1, 11, 5.0)], [("f", 1, 20, 7.0), ("f", 1, 40, 1.0)]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
        got = windows.drain(windows.loctrans(spark.readStream.schema(kind).parquet(source), "AVERAGE", 10), work)
        last = {x.t: x.v for x in got.collect()}
    assert last == {10: 2.0, 20: 6.0}


def test_exchange_keeps_every_user_and_customer(spark, tmp_path):
    """Beyond 150 users and customers nothing is dropped or folded: one reduction, one link and one correction a cell."""
    n = 400
    con = duckdb.connect()
    con.sql(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i % 7 * 9000 + 1) AS ts, i % {n - 1} AS user_id,
    CASE WHEN i % 3 = 0 THEN 'view' ELSE 'click' END AS event_type, i % 11 + 0.5 AS value FROM range(0, 4000) t(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con.sql(f"COPY (SELECT i AS c_custkey FROM range(0, {n}) t(i)) TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    for name in ("events", "customer"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    whole = catalog.ORACLE_SQL["exchange_pipeline"].replace("cell % 150 + 1", "cell + 1").replace(" WHERE c_custkey <= 150", "")
    want = plain(con.sql(f"SELECT cell, field, t, v FROM ({whole})").fetchall())
    got = plain(catalog.exchange_pipeline(spark, str(tmp_path)).select("cell", "field", "t", "v").collect())
    assert len({g[0] for g in got}) == n - 1 and len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3] and math.isclose(g[3], w[3], abs_tol=1e-8)


def test_every_order_has_a_part_an_owner_and_a_block(spark, tmp_path):
    """The transfer list covers all orders, whatever the key range: the sf0.001 range ends at 1,499."""
    n = 20_000
    duckdb.sql(f"COPY (SELECT i AS o_orderkey, (i // 3 * 7919 % 5 + 1) || '-X' AS o_orderpriority FROM range(0, {n}) t(i)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    d = str(tmp_path)
    met = catalog.order_overlap(spark, d).toPandas()
    assert met["length"].sum() == n and met["start"].min() == 1 and (met["start"] + met["length"]).max() == n + 1 and set(met["part_b"]) == set(range(7))
    assert catalog.order_segments(spark, d).agg(F.sum("length")).first()[0] == n
    assert catalog.order_owners(spark, d).select("index").distinct().count() == n
    assert catalog.order_local_index(spark, d).where("local < 1").isEmpty()


def test_ordered_work_is_dealt_to_ranges(spark):
    """No group holds more than a few of 64 ranges' rows, and what crosses ranges is as in one pass."""
    n = 6400
    dealt = batch.ranged(spark.range(n), "id", 64)
    assert max(r["count"] for r in dealt.groupBy("__range").count().collect()) <= n // 16

    rng = np.random.default_rng(3)
    src = np.setdiff1d(np.arange(1, n), rng.integers(1, n, 40))
    starts = src[np.r_[True, np.diff(src) > 1]]
    ends = src[np.r_[np.diff(src) > 1, True]]
    links = spark.createDataFrame([(1, int(s), 0.5) for s in src], "dst long, src long, w double")
    got = sorted((r.start, r.length) for r in partition.columns_of(links).collect())
    assert got == [(s, e - s + 1) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]

    t = rng.integers(0, 10**6, n)
    puts = spark.createDataFrame([(int(i), "ab"[i % 2], int(v)) for i, v in enumerate(t)], "event_id long, field string, t long")
    want = set()
    for f in (0, 1):
        own = np.arange(f, n, 2)
        seen = np.maximum.accumulate(t[own])[:-1]
        want |= {(int(i), int(s)) for i, s in zip(own[1:], seen, strict=True) if t[i] < s}
    assert {(r.event_id, r.seen) for r in timewin.backward(puts, "event_id").collect()} == want

    apart = [(0, k * 10, 10) for k in range(500)]
    for at in (None, 0, 7, 63, 250, 498):
        one = [(p, s, 11 if k == at else m) for k, (p, s, m) in enumerate(apart)]
        assert partition.haloed(spark.createDataFrame(one, "part int, start long, length long")).first()[0] == (at is not None)

    field = spark.createDataFrame([(int(s), float(s)) for s in src], "cell long, x double")
    got = remap.ordered_apply(links, field, "x", width=100)
    assert math.isclose(got.first().y, 0.5 * float(src.sum())) and "bin" in got._jdf.queryExecution().optimizedPlan().toString()
    none = links.where("false")
    assert partition.columns_of(none).isEmpty() and not partition.haloed(partition.points(none.selectExpr("dst AS part", "src AS pos", "src AS index"))).first()[0]


def test_bins_follow_the_grid(spark):
    """More points make more bins, and the nearest are those of brute force, poles and date line included."""
    src, dst = regular_grid(spark, 64, 32), regular_grid(spark, 30, 15)
    assert weights.bins_for(src) == 32
    a, b = src.orderBy("cell").toPandas(), dst.orderBy("cell").toPandas()
    d = np.sort(brute_distances(a, b), axis=1)[:, :4]
    got = {}
    for x in weights.nearest_k(src, dst, 4).collect():
        got.setdefault(x.dst, []).append(x.d)
    assert got.keys() == set(b["cell"]) and all(np.allclose(sorted(got[c]), d[i], atol=1e-6) for i, c in enumerate(b["cell"]))
    area = weights.overlaps(src, dst).groupBy("dst").agg(F.sum("overlap").alias("s"), F.first("dst_area").alias("a"))
    assert area.count() == 450 and area.where("abs(s - a) > 1e-9").isEmpty()
