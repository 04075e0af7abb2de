"""Weights on grids that bend, are reduced or have polygon cells, and the rules of entries and runs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridflow.operators import batch, curvilinear, partition, polygons, reduce, reduced, remap, timewin, weights
from gridflow.plans import exchange as plan
from gridflow.schema import analytic_field, product_grid, regular_grid, rotated_grid, with_corners
from gridflow.sources import tables


def error_of(links, src, dst, weight="w"):
    """Per cent off the smooth field: (largest, mean), and how many targets there are."""
    v = src.select("cell", analytic_field(F.col("lon"), F.col("lat")).alias("v"))
    got = remap.apply_weights(links, v, {"v": "g"}, weight).join(dst, F.col("dst") == F.col("cell"))
    off = 100 * F.abs(F.col("g") / analytic_field(F.col("lon"), F.col("lat")) - 1)
    return tuple(got.agg(F.max(off), F.avg(off), F.count("*")).first())


@pytest.mark.parametrize("tilt", [30.0, 33.0])  # with 30 the poles are corners of cells, with 33 they are within cells
def test_polygons_share_the_sphere(spark, tilt):
    src, dst = rotated_grid(spark, 24, 12, tilt), with_corners(regular_grid(spark, 11, 7))
    shared = polygons.overlaps(src, dst).cache()
    assert math.isclose(shared.agg(F.sum("area")).first()[0], 4 * math.pi, rel_tol=1e-12)
    for side, grid in (("src", src), ("dst", dst)):
        both = shared.groupBy(F.col(side).alias("cell")).agg(F.sum("area").alias("got")).join(polygons.measured(grid), "cell")
        worst = both.agg(F.max(F.abs(F.col("got") / F.col("area") - 1)), F.count("*")).first()
        assert worst[0] < 1e-9 and worst[1] == grid.count()


def test_second_order_weights_reproduce_linear_fields(spark):
    src, dst = rotated_grid(spark, 20, 10, 33.0).withColumn("mask", F.lit(0)), with_corners(regular_grid(spark, 9, 5))
    links = polygons.conservative(src, dst, "DESTAREA", second=True)
    means = [polygons.measured(g).select(F.col("cell").alias(n), (F.col("lat") / F.col("area")).alias(f"{n}_mean")) for g, n in ((src, "src"), (dst, "dst"))]
    got = links.join(means[0], "src").groupBy("dst").agg(F.sum("w1").alias("one"), F.sum(F.col("w1") * F.col("src_mean") + F.col("w2")).alias("linear"), F.sum(F.col("w1") * F.col("src_mean")).alias("first")).join(means[1], "dst")
    worst = got.agg(F.max(F.abs(F.col("one") - 1)), F.max(F.abs(F.col("linear") - F.col("dst_mean"))), F.max(F.abs(F.col("first") - F.col("dst_mean")))).first()
    assert worst[0] < 1e-9 and worst[1] < 1e-9 < worst[2]


def test_polygons_of_other_shapes(spark):
    """Triangles and a bent pentagon that together make a box of ten by ten degrees, against that box."""
    rows = [
        (1, 22.0, 2.0, [20.0, 30.0, 30.0], [0.0, 0.0, 10.0], 0),
        (2, 22.0, 8.0, [20.0, 30.0, 20.0], [0.0, 10.0, 10.0], 0),
        (3, 15.0, 5.0, [10.0, 20.0, 20.0, 15.0, 10.0], [0.0, 0.0, 10.0, 10.0, 10.0], 1),
    ]
    src = spark.createDataFrame(rows, "cell long, lon double, lat double, clon array<double>, clat array<double>, mask int")
    dst = spark.createDataFrame([(1, 380.0, 5.0, [370.0, 390.0, 390.0, 370.0], [0.0, 0.0, 10.0, 10.0], 0)], src.schema)  # a turn away
    got = {r.src: r.area for r in polygons.overlaps(src, dst).collect()}
    half = math.radians(10) * math.sin(math.radians(10))
    assert math.isclose(got[3], half, rel_tol=1e-9) and math.isclose(got[1] + got[2], half, rel_tol=1e-9) and got[1] != got[2]
    w = {r.src: r.w1 for r in polygons.conservative(src, dst, "FRACAREA").collect()}
    assert sorted(w) == [1, 2] and math.isclose(sum(w.values()), 1)
    assert polygons.conservative(src.limit(0), dst).isEmpty()


def test_curvilinear_weights_interpolate_the_smooth_field(spark):
    src, dst = rotated_grid(spark, 36, 18, 33.0).withColumn("mask", F.lit(0)), regular_grid(spark, 20, 10).withColumn("mask", F.lit(0))
    worst, mean, n = error_of(curvilinear.bilinear(src, dst, 36), src, dst)
    assert worst < 3 and mean < 0.4 and n == 200
    field = weights.gradients(src.withColumn("v", analytic_field(F.col("lon"), F.col("lat"))), 36, 18)
    links = curvilinear.bicubic(src, dst, 36)
    got = remap.apply_higher_order(links, field, [("w1", "v"), ("w2", "gi"), ("w3", "gj"), ("w4", "gij")]).join(dst, F.col("dst") == F.col("cell"))
    off = 100 * F.abs(F.col("y") / analytic_field(F.col("lon"), F.col("lat")) - 1)
    worst, mean = got.agg(F.max(off), F.avg(off)).first()
    assert worst < 3 and mean < 0.2


def test_regular_grids_are_a_case_of_curvilinear_ones(spark):
    src, dst = regular_grid(spark, 24, 12).withColumn("mask", F.lit(0)), regular_grid(spark, 16, 7).withColumn("mask", F.lit(0)).where("abs(lat) < 80")
    a = curvilinear.bilinear(src, dst, 24).where("w > 1e-9")
    b = weights.bilinear_weights(dst, 24, 12).where("w > 1e-9").withColumnRenamed("w", "w2")
    both = a.join(b, ["dst", "src"], "full")
    assert both.where("w IS NULL OR w2 IS NULL OR abs(w - w2) > 1e-9").isEmpty()


def test_no_masked_source_takes_part(spark):
    src, round_, dst = rotated_grid(spark, 24, 12), reduced.octahedral_grid(spark, 10), regular_grid(spark, 10, 6)
    for links, w in ((curvilinear.bilinear(src, dst, 24), "w"), (curvilinear.bicubic(src, dst, 24), "w1"), (reduced.bilinear(round_, dst), "w"), (reduced.bicubic(round_, dst), "w")):
        sums = links.groupBy("dst").agg(F.sum(w).alias("s"))
        assert sums.count() == dst.where("mask = 0").count() and sums.where("abs(s - 1) > 1e-9").isEmpty()
        assert links.where(F.col("src") % 7 == 0).isEmpty()


def test_stencils_of_reduced_grids(spark):
    grid, dst = reduced.octahedral_grid(spark, 18).withColumn("mask", F.lit(0)), regular_grid(spark, 20, 10).withColumn("mask", F.lit(0))
    n = grid.agg(F.count("*"), F.max("cell"), F.count_distinct("cell")).first()
    assert len(set(n)) == 1
    worst2, mean2, _ = error_of(reduced.bilinear(grid, dst), grid, dst)
    worst4, mean4, _ = error_of(reduced.bicubic(grid, dst), grid, dst)
    assert worst4 < worst2 < 0.5 and mean4 < mean2 / 5
    cubic = reduced._weights(grid, dst, 2, False).groupBy("dst").agg(F.count("*").alias("n"), F.sum("w").alias("s"))
    assert cubic.where("n <> 16 OR abs(s - 1) > 1e-9").isEmpty()


@pytest.mark.parametrize("size", [(24, 12), (48, 24), (96, 48)])
def test_searches_look_at_a_bounded_number_of_points(spark, size):
    """Pairs that meet in a bin, for each target, do not grow with the grid."""
    src, dst = regular_grid(spark, *size), regular_grid(spark, size[0] // 2, size[1] // 2)
    quads = curvilinear.quads(src, size[0])
    bins = weights.bins_for(quads)
    xs, ys = [F.col(f"x{k}") for k in range(1, 5)], [F.col(f"y{k}") for k in range(1, 5)]
    a = curvilinear._binned(quads, F.least(*xs), F.greatest(*xs), F.least(*ys), F.greatest(*ys), bins)
    b = curvilinear._binned(dst, F.col("lon"), F.col("lon"), F.col("lat"), F.col("lat"), bins)
    assert a.join(b, ["band", "sector"]).count() <= 12 * dst.count()


def test_duplicates_and_preparation(spark):
    rows = [(1, 359.9999999, 10.0, 0), (2, 0.0000001, 10.0, 0), (3, 5.0, 89.0, 0), (4, 365.0, 89.0, 0), (5, 5.0, 88.0, 0), (6, 5.0, 89.0, 1)]
    grid = spark.createDataFrame(rows, "cell long, lon double, lat double, mask int")
    assert sorted(map(tuple, curvilinear.duplicates(grid).collect())) == [(2, 1), (4, 3), (6, 3), (6, 4)]
    assert sorted(r.cell for r in curvilinear.without_duplicates(grid).where("mask = 0").collect()) == [2, 4, 5]
    polar = rotated_grid(spark, 24, 12, 33.0)
    box = curvilinear.prepared(polar)
    assert box.where("box_lat_hi = 90").count() == 1 and box.where("box_lat_lo = -90").count() == 1
    assert box.where("box_lon_hi - box_lon_lo > 180 AND abs(lat) < 70").isEmpty()


def test_chords_are_exact_for_close_points(spark):
    one = spark.createDataFrame([(10.0, 20.0, 10.0 + 1e-9, 20.0)], "a double, b double, c double, d double")
    got = one.select(weights.chord_distance(*[F.col(c) for c in "abcd"])).first()[0]
    assert math.isclose(got, math.radians(1e-9) * math.cos(math.radians(20)), rel_tol=1e-5)


def test_average_distance_with_gaps_in_the_addresses(spark):
    rows = [(2, 0.0, 0.0), (5, 10.0, 0.0), (9, 30.0, 0.0)]
    got = weights.average_distance(spark.createDataFrame(rows, "cell long, lon double, lat double")).first()[0]
    assert math.isclose(got, math.radians(10 + 20 + 30) / 3)


# ------------------------------------------------------------ places, products


def test_places_do_not_depend_on_reused_exchanges(spark):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        rows = spark.range(1, 200_001).select(F.col("id").alias("cell"), (F.xxhash64("id") % 1000).alias("k"))
        got = batch.permutation(rows, [("k", True)]).agg(F.count_distinct("place"), F.min("place"), F.max("place")).first()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert tuple(got) == (200_000, 1, 200_000)


def test_products_of_axes(spark):
    axes = {"a": spark.createDataFrame([(3.0,), (1.0,)], "a double"), "b": spark.createDataFrame([("y",), ("x",), ("z",)], "b string")}
    assert [tuple(r) for r in product_grid(axes).orderBy("cell").select("cell", "a", "b").collect()] == [(1, 1.0, "x"), (2, 1.0, "y"), (3, 1.0, "z"), (4, 3.0, "x"), (5, 3.0, "y"), (6, 3.0, "z")]


def test_masks_out_of_range_raise(spark):
    bad = spark.createDataFrame([(1, 2, 0.5)], "cell long, m int, f double")
    with pytest.raises(Exception, match="mask m is out of range"):
        batch.masked_strictly(bad, ["m"], ["f"]).collect()
    with pytest.raises(ValueError):
        batch.appended(bad, ["f"])
    with pytest.raises(LookupError):
        batch.position(bad, "x")


@pytest.mark.parametrize(("n", "parts"), [(10, 3), (7, 7), (5, 8), (1000, 7), (1, 1)])
def test_blocks_and_their_owners(spark, n, parts):
    cells = spark.range(0, n + 2).select(F.col("id").alias("index"), partition.block_of(F.col("id"), n, parts).alias("part"))
    held = {r["index"]: r.part for r in cells.collect()}
    assert held[0] == held[n + 1] == -1
    for r in partition.blocks(spark, n, parts).collect():
        assert all(held[i] == r.part for i in range(r.start, r.start + r.length))


def test_torn_blocks_raise(spark):
    with pytest.raises(Exception, match="not one block"):
        partition.as_blocks(spark.createDataFrame([(0, 1, 2), (0, 5, 1)], "part int, start long, length long")).collect()


# ------------------------------------------------------------ entries and runs


def test_what_an_entry_may_say():
    good = plan.Entry(("a",), ("b",), 10, status="IGNOUT")
    assert good.status == "EXPOUT"
    for bad in ({"status": "AUXILARY"}, {"conserv": "GLOBL"}, {"loctrans": "MEAN"}, {"map_mode": "fast"}, {"lag": 5}, {"lag": -10}):
        with pytest.raises(ValueError):
            plan.Entry(("a",), ("b",), 10, **bad)
    with pytest.raises(ValueError):
        plan.in_sequence([plan.Entry(("a",), ("b",), 10, seq=0)])
    order = [plan.Entry((n,), ("b",), 10, seq=s) for n, s in (("x", 2), ("y", 1), ("z", 2), ("w", 1))]
    assert [e.source[0] for e in plan.in_sequence(order)] == ["y", "w", "x", "z"]
    plan.check_transforms(["LOCTRANS", "SCRIPR", "CHECKOUT"])
    for bad in (["MASK"], ["NOSUCH"], ["SCRIPR", "LOCTRANS"], ["SCRIPR", "SCRIPR"]):
        with pytest.raises(ValueError):
            plan.check_transforms(bad)
    for bad in (
        {"method": "BILINEAR", "kind": "U"},
        {"method": "CONSERV"},
        {"method": "CONSERV", "norm": "FRACAREA", "order": "THIRD"},
        {"method": "DISTWGT"},
        {"method": "GAUSWGT", "neighbours": 4},
        {"method": "NOSUCH"},
    ):
        with pytest.raises(ValueError):
            plan.Remap(**bad)
    assert plan.Remap("BILINEAR", kind="D", field="VECTOR").restriction == "REDUCED" and plan.Remap("BICUBIC", field="VECTOR").field == "SCALAR"
    with pytest.raises(ValueError):
        plan.Run(0)


def test_conservation_of_an_exchange_has_guards(spark):
    field = spark.createDataFrame([("f", 1, 1, 0.0)], "field string, t long, cell long, v double")
    grid = spark.createDataFrame([(1, 2.0, 0)], "cell long, area double, mask int")
    shut = grid.withColumn("mask", F.lit(1))

    def run(mode, src, dst, src_grid, dst_grid):
        entry = plan.Entry(("f",), ("f",), 10, conserv=mode)
        return [r.v for r in plan.conserved(entry, src, dst, src_grid, dst_grid).collect()]

    for mode in ("GLBPOS", "BASPOS"):
        assert run(mode, field, field, grid, grid) == [0.0]  # both sums are 0: the field stays
        with pytest.raises(Exception, match="is 0"):
            run(mode, field.withColumn("v", F.lit(1.0)), field, grid, grid)
    for mode in ("GLOBAL", "BASBAL"):
        with pytest.raises(Exception, match="active area"):
            run(mode, field, field, grid, shut)


def test_puts_after_the_end_raise(spark):
    puts = spark.createDataFrame([("f", 1, 20, 1.0)], "field string, cell long, t long, v double")
    with pytest.raises(Exception, match="the run ends at 20"):
        timewin.within(puts, 20).collect()
    assert timewin.within(puts, 21).count() == 1


def test_checks_of_both_sides(spark):
    f = spark.createDataFrame([("f", 1, 1, 1.0), ("f", 1, 2, 3.0)], "field string, t long, cell long, v double")
    entry = plan.Entry(("f",), ("f",), 10, checkin=True, checkout=True)
    assert sorted(map(tuple, plan.checks(entry, f, f.withColumn("v", F.col("v") * 2)).collect())) == [("in", "f", 1, 1.0, 3.0, 4.0), ("out", "f", 1, 2.0, 6.0, 8.0)]
    assert plan.checks(plan.Entry(("f",), ("f",), 10), f, f) is None


def test_maps_are_built_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.createDataFrame([(1, 2, 0.5)], "dst long, src long, w double")

    for _ in range(2):
        assert [tuple(r) for r in plan.stored(spark, str(tmp_path / "maps"), "a_to_b", build).collect()] == [(1, 2, 0.5)]
    assert len(built) == 1


def test_restart_values_of_fields_that_went_are_gone(spark, tmp_path):
    folder = str(tmp_path / "restart")
    rows = spark.createDataFrame([("f", 1, 1.0), ("g", 1, 2.0)], "field string, cell long, v double")
    tables.write_restart(rows, folder, "a:b", "ready")
    tables.write_restart(rows.where("field = 'g'"), folder, "other", "ready")
    tables.write_restart(rows.where("field = 'f'"), folder, "a:b", "ready", whole=True)
    assert [r.field for r in tables.read_restart(spark, folder, "a:b", "ready").collect()] == ["f"]
    assert [r.field for r in tables.read_restart(spark, folder, "other", "ready").collect()] == ["g"]


def test_ordered_mapping_gives_equal_bits(spark):
    rng = np.random.default_rng(0)
    links = spark.createDataFrame([(1, i, float(w)) for i, w in enumerate(rng.normal(size=9000))], "dst long, src long, w double")
    field = spark.createDataFrame([("f", 1, i, float(v)) for i, v in enumerate(rng.normal(size=9000) * 1e6)], "field string, t long, cell long, v double")
    entry = plan.Entry(("f",), ("f",), 10)
    got = {plan.mapped(entry, field.repartition(n), links.repartition(m)).first().v for n, m in ((1, 1), (3, 7), (8, 2))}
    assert len(got) == 1


def test_running_merge_raises_on_no_weight(spark):
    none = spark.createDataFrame([(1, 1.0, 0)], "cell long, v double, m int")
    total = reduce.running_merge(None, none, ["m"], ["v"])
    assert reduce.merged(total, ["v"], strict=False).first().v is None
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        reduce.merged(total, ["v"]).collect()


def test_searches_deal_their_targets(spark, monkeypatch):
    """Few source points and many targets: the pairs that a task forms do not grow with the targets, and the result is the same."""
    src, dst = regular_grid(spark, 12, 6), regular_grid(spark, 30, 15)
    whole = sorted(map(tuple, weights.nearest_k(src, dst, 4).select("dst", "src", "rank").collect()))
    monkeypatch.setattr(weights, "PAIRS", 100)
    dealt = weights.nearest_k(src, dst, 4)
    assert sorted(map(tuple, dealt.select("dst", "src", "rank").collect())) == whole
    assert dealt.rdd.getNumPartitions() >= 450 * 9 // 100


@pytest.mark.parametrize(("n", "k"), [(6000, 1), (6000, 4), (3, 5)])
def test_far_targets_go_down_a_tree(spark, monkeypatch, n, k):
    """Targets far from all source points find those of brute force, and do not look at bins by the square of how far that is."""
    monkeypatch.setattr(weights, "PAIRS", 100)
    rng = np.random.default_rng(n + k)
    slon, slat = rng.uniform(190, 360, n), rng.uniform(-85, -20, n)
    lon, lat = rng.uniform(-180, 540, 150), np.degrees(np.arcsin(rng.uniform(-1, 1, 150)))
    lat[:4], lon[4:6] = (90, -90, 89.99, -89.99), (0, 360)
    src, dst = (spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "cell long, lon double, lat double") for a, b in ((slon, slat), (lon, lat)))
    near = weights.nearest_k(src, dst, k)
    assert near.rdd.getNumPartitions() < 150
    a, b, a2, b2 = np.radians(lat)[:, None], np.radians(lon)[:, None], np.radians(slat), np.radians(slon)
    d = np.arccos(np.clip(np.sin(a) * np.sin(a2) + np.cos(a) * np.cos(a2) * np.cos(b - b2), -1, 1))
    got = {(r.dst, r["rank"]): (r.src, r.d) for r in near.collect()}
    assert len(got) == 150 * min(n, k)
    order = np.argsort(d, axis=1)
    for (at, rank), (cell, far) in got.items():
        assert abs(far - d[at, order[at, rank - 1]]) < 1e-7 and abs(d[at, cell] - far) < 1e-7
    # each source point once for a target
    assert len({(at, cell) for (at, _), (cell, _) in got.items()}) == len(got)


def test_points_that_coincide_meet_by_blocks(spark, monkeypatch):
    """Places with many points: every pair once, whatever the size of the blocks, and no grid goes through the driver."""
    rng = np.random.default_rng(5)
    lon = rng.choice([0.0, 1e-7, 360 - 1e-7, 360 - 1e-14, 12.0, 12.0 + 9e-7, 200.0, -160.0], 400)
    lat = rng.choice([10.0, 10.0 + 9e-7, 10.0 - 9e-7, -90.0], 400)
    grid = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(lon, lat, strict=True))], "cell long, lon double, lat double")
    step = np.abs((lon[:, None] - lon + 180) % 360 - 180)
    close = np.tril((step < 1e-6) & (np.abs(lat[:, None] - lat) < 1e-6), -1)
    want = sorted(map(tuple, np.argwhere(close).tolist()))
    for block in (8192, 7):
        monkeypatch.setattr(curvilinear, "BLOCK", block)
        got = curvilinear.duplicates(grid)
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.collect())) == want
    assert curvilinear.duplicates(grid.where("false")).isEmpty()


def test_points_that_coincide_are_sent_to_a_bounded_number_of_tasks(spark, monkeypatch):
    """Four times as many points at two places: sixteen times the pairs, but about four times the shuffled bytes."""
    monkeypatch.setattr(curvilinear, "BLOCK", 8)
    monkeypatch.setattr(curvilinear, "MET", 10_000)
    monkeypatch.setattr(curvilinear, "TILES", 50, raising=False)
    context = spark.sparkContext._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorList(True).apply(0).totalShuffleWrite()

    sent = {}
    for n in (1000, 4000):
        grid = spark.range(n).select(F.col("id").alias("cell"), (F.col("id") % 2 * 7.0).alias("lon"), F.lit(10.0).alias("lat"))
        before = written()
        assert curvilinear.duplicates(grid).count() == n * (n // 2 - 1) // 2
        sent[n] = written() - before
    assert sent[4000] < 7 * sent[1000], sent


@pytest.mark.parametrize("group", [7, 20])
def test_groups_of_bins_meet_once(spark, monkeypatch, group):
    """Bins of several groups, next to one another, around the date line, with repeated cells, and points that lie nowhere."""
    monkeypatch.setattr(curvilinear, "BLOCK", 7)
    monkeypatch.setattr(curvilinear, "MET", 1)
    monkeypatch.setattr(curvilinear, "GROUP", group, raising=False)
    rng = np.random.default_rng(6)
    lon = rng.choice([0.0, 1e-7, 360 - 1e-7, 12.0, 12.0 + 9e-7, 12.0 + 1.8e-6], 300)
    lat = rng.choice([10.0, 10.0 + 9e-7, 10.0 - 9e-7], 300)
    cell = np.r_[np.arange(290), np.arange(10)]
    rows = [(int(i), float(x), float(y)) for i, x, y in zip(cell, lon, lat, strict=True)]
    nowhere = [(900 + k, x, y) for k, (x, y) in enumerate([(math.nan, 10.0)] * 2 + [(12.0, math.nan)] * 2 + [(None, 10.0)] * 2 + [(12.0, None)] * 2 + [(math.inf, 10.0), (12.0, math.inf)] * 2)]
    grid = spark.createDataFrame(rows + nowhere, "cell long, lon double, lat double")
    step = np.abs((lon[:, None] - lon + 180) % 360 - 180)
    close = np.triu((step < 1e-6) & (np.abs(lat[:, None] - lat) < 1e-6), 1)
    want = sorted((int(max(cell[a], cell[b])), int(min(cell[a], cell[b]))) for a, b in np.argwhere(close) if cell[a] != cell[b])
    assert sorted(map(tuple, curvilinear.duplicates(grid).collect())) == want


def test_stored_maps_are_dealt_by_their_links(spark, tmp_path, monkeypatch):
    """A map with more links is written and read by more tasks, whatever the session's partitions; ranges of targets stay apart."""
    monkeypatch.setattr(tables, "LINKS", 100)
    links = spark.range(2000).select((F.col("id") % 500).alias("dst"), F.col("id").alias("src"), F.lit(0.5).alias("w"))
    tables.write_weights(links, str(tmp_path / "maps"), "m")
    read = tables.read_weights(spark, str(tmp_path / "maps"), "m")
    assert len(read.inputFiles()) == 20
    own = tables.read_weights(spark, str(tmp_path / "maps"), "m", spark.range(100, 400).select(F.col("id").alias("dst")))
    assert own.rdd.getNumPartitions() >= 12 and own.count() == 1200
    assert "Broadcast" not in own._jdf.queryExecution().executedPlan().toString()
    none = spark.createDataFrame([], "dst long")
    assert tables.read_weights(spark, str(tmp_path / "maps"), "m", none).isEmpty()
