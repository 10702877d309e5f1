"""Samples, matching, suppression, folds, bootstraps against brute force and invariants."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from surfaudit.operators import ranking as rk, regions as rg, sampling as sp, windows as wn


def test_density_bins_and_suppression(rows):
    pts = rows("z double, y double, x double", [(10.0, 10.0, 10.0), (20.0, 10.0, 10.0), (150.0, 10.0, 10.0), (160.0, 10.0, 10.0), (300.0, 300.0, 300.0)])
    bins = {(r["bz"], r["by"], r["bx"]): (r["points"], r["z_med"]) for r in rg.density_bins(pts, {"z": 100, "y": 100, "x": 100}).collect()}
    assert bins[(0, 0, 0)] == (2, 15.0) and bins[(1, 0, 0)] == (2, 155.0) and len(bins) == 3


@pytest.mark.parametrize("limit", [4, 100])
def test_suppression_equals_the_greedy_loop(rows, limit):
    rng = random.Random(limit)
    pts = [(i, float(rng.randrange(60)), float(rng.randrange(60))) for i in range(80)]
    kept = []
    for i, y, x in pts:
        if all(math.hypot(y - b, x - c) >= 9 for _, b, c in kept):
            kept.append((i, y, x))
    got = rk.suppress_close(rows("prio int, y double, x double", pts), ["y", "x"], "prio", 9.0, limit).collect()
    assert sorted(r["prio"] for r in got) == [k[0] for k in kept[:limit]]


def test_annulus_pairs_equal_the_sequential_draws(rows, spark):
    rng = random.Random(5)
    ink = [(rng.randrange(30), rng.randrange(30)) for _ in range(60)]
    ink = sorted(set(ink))
    free = [(y, x) for y in range(30) for x in range(30) if (y, x) not in set(ink) and rng.random() < 0.3]
    pos, ctrl = rows("y int, x int", ink), rows("y int, x int", free)
    got = sp.annulus_pairs(pos, ctrl, 16, 2, 5, 1000, 10, 9).collect()
    h = pos.select("y", "x", sp.hash_order(9, F.col("y"), F.col("x")).alias("o"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("a")).withColumn(
        "r", sp.hash_order(10, F.col("y"), F.col("x"), F.col("a"))).collect()
    used, want, draws = set(), {}, {}
    for r in h:
        draws.setdefault((r["o"], r["y"], r["x"]), {})[r["a"]] = r["r"]
    for (o, y, x), own in sorted(draws.items()):
        for a in range(10):
            cy, cx = y + own[a] % 11 - 5, x + own[a] // 11 % 11 - 5
            d = math.hypot(cy - y, cx - x)
            if 2 <= d <= 5 and (cy // 16, cx // 16) == (y // 16, x // 16) and (cy, cx) in set(free) - used:
                used.add((cy, cx))
                want[(y, x)] = (cy, cx)
                break
    assert {(r["y"], r["x"]): (r["cy"], r["cx"]) for r in got} == want and len(want) > 10


def test_annulus_limit_per_block(rows):
    ink = [(y, x) for y in range(8) for x in range(8)]
    free = [(y, x) for y in range(16) for x in range(8, 16)]
    got = sp.annulus_pairs(rows("y int, x int", ink), rows("y int, x int", free), 16, 3, 8, 3, 20, 1).collect()
    assert len(got) == 3 and len({(r["cy"], r["cx"]) for r in got}) == 3
    assert all(3 <= r["distance"] <= 8 for r in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_caliper_matching_is_one_to_one_and_maximal(rows, seed):
    rng = random.Random(seed)
    # A third of the values coincide.
    draw = lambda: 0.5 if rng.random() < 0.33 else rng.random()
    a = [(i, draw()) for i in range(120)]
    b = [(1000 + i, draw()) for i in range(90)]
    out = sp.caliper_match(rows("id int, v double", a), rows("id int, v double", b), "v", 0.02).collect()
    va, vb = dict(a), dict(b)
    assert len({r["id_a"] for r in out}) == len(out) == len({r["id_b"] for r in out})
    assert all(abs(va[r["id_a"]] - vb[r["id_b"]]) <= 0.02 for r in out)
    left, right = set(va) - {r["id_a"] for r in out}, set(vb) - {r["id_b"] for r in out}
    assert not any(abs(va[i] - vb[j]) <= 0.02 for i in left for j in right)


def test_rank_rows_is_a_total_order(rows):
    data = [(i, float(i % 3), "hot" if i % 4 else "cold") for i in range(60)]
    out = rk.rank_rows(rows("id int, s double, g string", data), "s", "id", ["g"]).collect()
    for g in ("hot", "cold"):
        want = [i for i, s, k in sorted(data, key=lambda d: (-d[1], d[0])) if k == g]
        assert [r["id"] for r in sorted((r for r in out if r["g"] == g), key=lambda r: r["rank"])] == want


def test_folds_split_like_array_split(rows):
    for n, k in ((4, 2), (7, 3), (11, 4)):
        got = {r["c"]: r["fold"] for r in wn.contiguous_folds(rows("c int", [(256 * i,) for i in range(n)]), "c", k).collect()}
        want = {256 * int(i): f for f, part in enumerate(np.array_split(np.arange(n), k)) for i in part}
        assert got == want


def test_buffered_folds_drop_neighbours(rows):
    out = sp.buffered_folds(rows("y int", [(i,) for i in range(20)]), "y", 2, 3).where("fold = 0").collect()
    role = {r["y"]: r["role"] for r in out}
    assert role[9] == "test" and role[10] == role[12] == "buffer" and role[13] == "train"


def test_samples_are_deterministic_and_balanced(rows, spark):
    df = spark.range(300).select("id", (F.col("id") % 3 == 0).alias("p"), (F.col("id") % 2).alias("k"), (F.col("id") / 300.0).alias("v"))
    one = sp.balanced_per_block(df, "p", ["k"], 20, 4, ["id"])
    two = sp.balanced_per_block(df.repartition(7), "p", ["k"], 20, 4, ["id"])
    assert {r["id"] for r in one.collect()} == {r["id"] for r in two.collect()}
    assert {tuple(r)[2] for r in one.groupBy("k", "p").count().collect()} == {20}
    s = sp.stratified_sample(df, "v", 0.2, 0.6, 0.05, 40, 4, "id").collect()
    assert len(s) == 40 and all(0.2 <= r["v"] < 0.6 for r in s) and {r["bin"] for r in s} == set(range(8))


def test_blinded_order_is_a_permutation(spark):
    out = sp.blinded_order(spark.range(50), "id", 3).collect()
    assert sorted(r["id"] for r in out) == list(range(50)) and {r["blind_id"] for r in out} == {f"B{i:03d}" for i in range(1, 51)}
    assert [r["id"] for r in sorted(out, key=lambda r: r["rank"])] != list(range(50))


def test_bootstrap_weights_equal_repeating_blocks(rows):
    rng = random.Random(2)
    data = [(i % 5, rng.random() < 0.5, round(rng.random(), 1)) for i in range(80)]
    df = rows("block int, positive boolean, s double", data)
    weights = sp.draw_weights(df, "block", 12, 3).collect()
    assert all(sum(r["w"] for r in weights if r["rep"] == k) == 5 for k in range(12))
    assert len({tuple(sorted((r["block"], r["w"]) for r in weights if r["rep"] == k)) for k in range(12)}) > 6
    from tests.test_metrics import brute

    want = []
    for k in range(12):
        sample = [d for r in weights if r["rep"] == k for d in data if d[0] == r["block"] for _ in range(r["w"])]
        want.append(brute([d[1] for d in sample], [d[2] for d in sample])[0])
    r = sp.block_bootstrap(df, "positive", "s", "block", 12, 3).first()
    assert r["valid_replicates"] == 12
    assert math.isclose(r["low"], np.quantile(want, 0.025)) and math.isclose(r["high"], np.quantile(want, 0.975))


def test_single_class_replicates_are_skipped(rows):
    df = rows("block int, positive boolean, s double", [(0, True, 1.0), (1, False, 2.0)])
    r = sp.block_bootstrap(df, "positive", "s", "block", 40, 3).first()
    assert 0 < r["valid_replicates"] < 40


def test_top_fraction_keeps_ties(rows):
    df = rows("s double", [(1.0,), (2.0,), (3.0,), (3.0,)])
    assert rk.top_fraction(df, "s", 0.25).count() == 2


def broadcast_rows(spark, first):
    """Row counts of all broadcasts of the executions numbered from ``first`` on."""
    store, out = spark._jsparkSession.sharedState().statusStore(), []
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = store.executionsList()
    for run in (runs.apply(i).executionId() for i in range(first, runs.size())):
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            metrics = node.metrics()
            for m in (metrics.apply(i) for i in range(metrics.size())):
                found = values.get(m.accumulatorId())
                if node.name().startswith("BroadcastExchange") and m.name() == "number of output rows" and found.isDefined():
                    out.append(int(found.get().replace(",", "")))
    return out


@pytest.mark.parametrize("kind", ["mean", "metric"])
def test_bootstrap_draws_are_not_broadcast(spark, rows, kind):
    """Draws grow as blocks times replicates; made by exploding a short range they were taken for few."""
    df = rows("block int, s double, positive boolean", [(b, (b * 7 % 11) / 10 + v / 100, (b + v) % 3 == 0) for b in range(100) for v in range(3)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
    try:
        first = spark._jsparkSession.sharedState().statusStore().executionsList().size()
        r = (sp.mean_bootstrap(df, "block", "s", 400, 3) if kind == "mean" else sp.block_bootstrap(df, "positive", "s", "block", 400, 3)).first()
        assert r["valid_replicates"] == 400
        assert max(broadcast_rows(spark, first), default=0) <= 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_resample_deals_a_hot_block_into_parts(rows):
    counts = rows("block int, score int, n long, pos long", [(b, s, 1 + s % 3, s % 2) for b, top in ((0, 500), (1, 3), (2, 1)) for s in range(top)])
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(sp.resample(counts, "block", ["score"], 6, 3, at_once=16)) == key(sp.resample(counts, "block", ["score"], 6, 3))


def shuffled_rows(spark, first):
    """Rows written to shuffles by the executions numbered from ``first`` on."""
    store, total = spark._jsparkSession.sharedState().statusStore(), 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = store.executionsList()
    for run in (runs.apply(i).executionId() for i in range(first, runs.size())):
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            metrics = node.metrics()
            for m in (metrics.apply(i) for i in range(metrics.size())):
                found = values.get(m.accumulatorId())
                if m.name() == "shuffle records written" and found.isDefined():
                    total += int(found.get().replace(",", ""))
    return total


def test_density_bins_of_sparse_points_shuffle_each_point_twice(spark):
    pts = spark.range(3000).select((F.col("id") * 100.0).alias("z"), (F.col("id") % 70 * 1.0).alias("y"), F.lit(1.5).alias("x"))
    first = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    assert len(rg.density_bins(pts, {"z": 100, "y": 10, "x": 10}).collect()) == 3000
    assert shuffled_rows(spark, first) <= 2.1 * 3000


@pytest.mark.parametrize("hot", [3, 10, 1000])
def test_density_bins_equal_plain_medians_around_the_hot_limit(rows, hot):
    rng, nan, bins = random.Random(3), float("nan"), {}
    pts = [tuple(rng.choice([None, nan, round(rng.random() * 9, 1)]) if rng.random() < 0.1 else round(rng.random() * 40, 1) for _ in "zyx") for _ in range(150)]
    floor = lambda v: None if v is None else 0 if math.isnan(v) else int(v // 20)
    for p in pts:
        bins.setdefault(tuple(map(floor, p)), []).append(p)
    want = {}
    for key, held in bins.items():
        values = [[v for v in axis if v is not None and not math.isnan(v)] for axis in zip(*held)]
        if max(map(len, values)):
            want[key] = (max(map(len, values)), *[float(np.median(v)) if v else None for v in values])
    got = rg.density_bins(rows("z double, y double, x double", pts), {a: 20 for a in "zyx"}, hot).collect()
    assert len(got) == len(want)
    for r in got:
        n, *meds = want[r["bz"], r["by"], r["bx"]]
        assert r["points"] == n
        for a, m in zip("zyx", meds):
            assert r[f"{a}_med"] is None if m is None else math.isclose(r[f"{a}_med"], m)


def test_suppression_looks_only_at_the_best_points(spark, monkeypatch):
    """Far down the order nothing can be kept once the limit is reached: those points stay out of the rounds."""
    held, cut = [], rk.cut_lineage

    def counted(df):
        out = cut(df)
        held.append(out.count())
        return out

    monkeypatch.setattr(rk, "cut_lineage", counted)
    pts = spark.range(20000).select(F.col("id").alias("prio"), (F.col("id") * 7 % 199 * 1.0).alias("y"), (F.col("id") * 11 % 101 * 1.0).alias("x"))
    got = rk.suppress_close(pts, ["y", "x"], "prio", 30.0, 3).collect()
    assert [r["rank"] for r in sorted(got, key=lambda r: r["prio"])] == [1, 2, 3]
    assert sum(held[1:]) < 20000


@pytest.mark.parametrize("limit", [2, 60])
def test_suppression_in_batches_equals_the_greedy_loop(rows, monkeypatch, limit):
    monkeypatch.setattr(rk, "_batch_bounds", lambda *_: [19, 20, 90, 299])
    rng = random.Random(limit)
    pts = [(i, float(rng.randrange(90) if i > 25 else rng.randrange(4)), float(rng.randrange(90) if i > 25 else 1)) for i in range(300)]
    kept = []
    for i, y, x in pts:
        if all(math.hypot(y - b, x - c) >= 9 for _, b, c in kept):
            kept.append((i, y, x))
    got = rk.suppress_close(rows("prio int, y double, x double", pts), ["y", "x"], "prio", 9.0, limit).collect()
    assert sorted(r["prio"] for r in got) == [k[0] for k in kept[:limit]]


def test_annulus_pairs_shuffle_each_pixel_once(spark):
    px = spark.range(6400).select((F.col("id") % 80).cast("int").alias("y"), F.floor(F.col("id") / 80).cast("int").alias("x"), (F.col("id") % 3 == 0).alias("ink"))
    first = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    got = sp.annulus_pairs(px.where("ink"), px.where("not ink"), 32, 2, 6, 50, 8, 4).collect()
    assert shuffled_rows(spark, first) <= 6400
    per = {}
    for r in got:
        assert 2 <= r["distance"] <= 6 and (r["cy"] // 32, r["cx"] // 32) == (r["y"] // 32, r["x"] // 32) == (r["by"], r["bx"])
        per[r["by"], r["bx"]] = per.get((r["by"], r["bx"]), 0) + 1
    assert len({(r["cy"], r["cx"]) for r in got}) == len({(r["y"], r["x"]) for r in got}) == len(got)
    assert len(per) == 9 and all(n == 50 for n in per.values())
