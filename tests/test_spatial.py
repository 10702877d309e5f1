"""Components, geometry, burden, tile jobs: fixtures, brute force and invariance to tiling."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from surfaudit.operators import components as cc, grid as gr, joins as jn, physical as ph, tiles as tl, windows as wn
from surfaudit.operators.sampling import checkerboard

YX = "y int, x int"


def flood(cells, full):
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0) and (full or abs(a) + abs(b) == 1)]
    left, out = set(cells), {}
    for c in sorted(cells):
        if c in left:
            stack, part = [c], []
            left.discard(c)
            while stack:
                y, x = stack.pop()
                part.append((y, x))
                for a, b in steps:
                    if (y + a, x + b) in left:
                        left.discard((y + a, x + b))
                        stack.append((y + a, x + b))
            for q in part:
                out[q] = min(part)
    return out


@pytest.mark.parametrize("full,tile", [(False, 4), (True, 4), (False, 64)])
def test_components_match_flood_fill_for_any_tile(rows, full, tile):
    rng = random.Random(tile + full)
    cells = [(y, x) for y in range(20) for x in range(20) if rng.random() < 0.5]
    got = cc.components(rows(YX, cells), full, tile).collect()
    assert {(r["y"], r["x"]): divmod(r["component"], 1 << 31) for r in got} == flood(cells, full)


def test_snake_across_many_tiles_is_one_component(rows):
    cells = [(y, x) for y in range(0, 17, 2) for x in range(17)] + [(y, 16 if (y // 2) % 2 == 0 else 0) for y in range(1, 16, 2)]
    got = cc.component_areas(cc.components(rows(YX, cells), tile=4)).collect()
    assert [r["cells"] for r in got] == [len(cells)]


def test_graph_components_with_a_hub(spark):
    # One hub touches a third of all nodes, the rest are paths of length three.
    hub = spark.range(1, 400).select(F.lit(0).cast("bigint").alias("src"), F.col("id").alias("dst"))
    path = spark.range(1000, 1800).where("id % 4 <> 3").select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = {r["node"]: r["component"] for r in cc.connected_components(hub.unionAll(path)).collect()}
    assert {got[i] for i in range(400)} == {0}
    assert all(got[i] == i - i % 4 for i in range(1000, 1800))


def test_clipped_components_do_not_cross_chunks(rows):
    cells = [(0, x) for x in range(8)]
    assert cc.component_areas(cc.components(rows(YX, cells), tile=4, clip=True)).count() == 2


def test_components_of_nothing(rows):
    assert cc.components(rows(YX, []), tile=4).count() == 0


PX = "y int, x int, accepted boolean, positive boolean, valid boolean, area_um2 double"


def test_false_positive_burden_by_hand(rows):
    hot = {(0, 0), (0, 1), (2, 2)}
    px = rows(PX, [(y, x, (y, x) in hot, False, True, 1e6) for y in range(3) for x in range(3)])
    r = ph.fp_burden(px, 1.5).first()
    assert (r["components_all"], r["components_retained"]) == (2, 1)
    assert math.isclose(r["negative_cm2"], 0.09) and math.isclose(r["fp_cm2"], 0.03)


def test_burden_uses_the_area_of_each_pixel(rows):
    px = rows(PX, [(0, 0, True, False, True, 2.0), (0, 1, False, False, True, 8.0)])
    assert math.isclose(ph.fp_burden(px, 0).first()["fp_fraction"], 0.2)


def test_policies(rows):
    px = rows("y int, x int, positive boolean, valid boolean, area_um2 double, s double",
              [(0, 0, True, True, 10.0, 0.9), (0, 1, False, True, 20.0, 0.8)])
    out = {r["policy"]: r for r in ph.evaluate_policies(px, "s", 0.5, [0.5], 0, 32).collect()}
    assert out["score_gte_0.5"]["precision"] == 0.5 and out["score_gte_0.5"]["recall"] == 1.0
    assert out["top_0.5"]["true_px"] == 1 and out["top_0.5"]["components"] == 0
    assert out["abstain_all"]["precision"] is None and out["abstain_all"]["fp_fraction"] == 0


GRID = "v int, u int, x double, y double, z double"


def plane(h, w, step=20.0):
    return [(v, u, u * step, v * step, 50.0) for v in range(h) for u in range(w)]


def test_planar_grid(rows):
    g = rows(GRID, plane(5, 6))
    for r in gr.grid_continuity(g, 20, 0.05, 1.5).collect():
        assert r["within_tolerance"] and r["abrupt_jumps"] == 0 and r["p50"] == 20
    t = gr.grid_topology(g).first()
    assert (t["quads"], t["degenerate"], t["normal_flips"], t["median_area"]) == (20, 0, 0, 400.0)
    assert cc.component_areas(cc.components(g.select(F.col("v").alias("y"), F.col("u").alias("x")), True)).count() == 1


def test_partial_sentinel(rows):
    data = plane(3, 3)
    data[4] = (1, 1, -1.0, 20.0, 50.0)
    r = gr.grid_vertices(rows(GRID, data)).first()
    assert (r["partial_sentinel"], r["valid"]) == (1, 8)


def test_pixel_area_and_unsupported_cell(rows):
    px = rows("y int, x int, c int", [(y, x, 0) for y in range(10) for x in range(10)])
    g = rows(GRID, plane(4, 4))
    assert {r["area_um2"] for r in gr.pixel_area(px, g, 5, 2.0).collect()} == {64.0}
    ok = gr.roi_geometry(px, g, 5, 2.0, ["c"]).first()
    assert ok["passes"] and ok["unsupported"] == 0
    broken = [r if r[:2] != (0, 0) else (0, 0, -1.0, -1.0, -1.0) for r in plane(4, 4)]
    bad = gr.roi_geometry(px, rows(GRID, broken), 5, 2.0, ["c"]).first()
    assert bad["unsupported"] == 25 and not bad["passes"]


def test_affine_is_recovered(rows):
    pts = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (2, 3, 4)]
    data = [(*map(float, p), 2.0 * p[0] + 5, 3.0 * p[1] + 6, 4.0 * p[2] + 7) for p in pts]
    df = rows("sx double, sy double, sz double, tx double, ty double, tz double", data)
    m = gr.fit_affine(df)
    assert np.allclose(m, [[2, 0, 0], [0, 3, 0], [0, 0, 4], [5, 6, 7]])
    assert gr.residuals(df, m).agg(F.max("residual")).first()[0] < 1e-9
    with pytest.raises(ValueError):
        gr.fit_affine(df.where("sz = 0"))


def test_uv_pairing_meets_end_points(rows):
    pairs = jn.pair_uv(rows(GRID, plane(3, 3)), rows(GRID, plane(5, 5)), (3, 3), (5, 5), 2).collect()
    assert {(r["v"], r["u"]): (r["tv"], r["tu"]) for r in pairs}[(2, 2)] == (4, 4) and len(pairs) == 4


def test_checkerboard(rows):
    out = checkerboard(rows("v int, u int", [(0, 0), (0, 8), (8, 8)]), 8, 2, 1).collect()
    assert [r["fold"] for r in out] == [0, 1, 0]


def test_support_policies_are_nested(rows):
    lattice = rows("v int, u int, ok boolean", [(0, 0, True), (0, 1, False), (1, 0, True), (1, 1, True)])
    px = rows(YX, [(y, x) for y in range(6) for x in range(6)])
    for r in jn.sample_support(px, lattice, (6, 6), (2, 2)).collect():
        assert r["all"] <= r["nearest"] <= r["any"]
    one = jn.resample_mask(rows(YX, [(0, 0), (1, 0), (1, 1)]), (2, 2), (1, 1)).first()
    assert (one["all"], one["center"], one["any"]) == (False, True, True)


def test_trilinear_on_a_linear_volume(rows):
    vox = rows("z int, y int, x int, v double", [(z, y, x, float(z + 2 * y + 3 * x)) for z in range(4) for y in range(4) for x in range(4)])
    pts = rows("id int, pz double, py double, px double", [(0, 1.5, 1.5, 1.5)])
    assert jn.sample_volume(pts, vox, ["id"]).first()["sample"] == 9.0


def test_nearest_boxes_against_brute_force(rows):
    rng = random.Random(3)
    boxes = [(i, y := rng.randrange(200), y + rng.randrange(1, 9), x := rng.randrange(200), x + rng.randrange(1, 9)) for i in range(60)]
    pts = [(i, float(rng.randrange(-50, 260)), float(rng.randrange(200))) for i in range(25)]
    got = jn.nearest_boxes(rows("point_id int, y double, x double", pts), rows("box_id int, y0 int, y1 int, x0 int, x1 int", boxes), ["y", "x"], 4, 8.0)
    found = {}
    for r in got.collect():
        found.setdefault(r["point_id"], {})[r["rank"]] = r["box_id"]
    for i, y, x in pts:
        key = lambda b: (math.hypot(max(b[1] - y, y - b[2], 0), max(b[3] - x, x - b[4], 0)), (b[2] - b[1]) * (b[4] - b[3]), b[0])
        assert [found[i][k] for k in (1, 2, 3, 4)] == [b[0] for b in sorted(boxes, key=key)[:4]]


def test_nearest_of_boxes_of_all_sizes(rows):
    """Boxes 10^5 wide among small ones: on the grid of the small ones they would be 10^8 rows each."""
    rng = random.Random(4)
    boxes = [(i, y := rng.randrange(300), y + rng.randrange(1, 9), x := rng.randrange(300), x + rng.randrange(1, 9)) for i in range(20)]
    boxes += [(100, -50_000, 50_000, 20, 100_020), (101, 10, 3_000, 10, 40), (102, 150, 151, -90_000, 90_000), (103, 0, 64, 0, 64)]
    pts = [(i, float(rng.randrange(-50, 360)), float(rng.randrange(300))) for i in range(12)] + [(90, 40_000.0, 99_000.0)]
    got = jn.nearest_boxes(rows("point_id int, y double, x double", pts), rows("box_id int, y0 int, y1 int, x0 int, x1 int", boxes), ["y", "x"], 3, 8.0)
    found = {}
    for r in got.collect():
        found.setdefault(r["point_id"], {})[r["rank"]] = r["box_id"]
    for i, y, x in pts:
        key = lambda b: (math.hypot(max(b[1] - y, y - b[2], 0), max(b[3] - x, x - b[4], 0)), (b[2] - b[1]) * (b[4] - b[3]), b[0])
        assert [found[i][k] for k in (1, 2, 3)] == [b[0] for b in sorted(boxes, key=key)[:3]]


def test_support_rectangles(rows):
    box = "box_id int, y0 int, y1 int, x0 int, x1 int"
    out = {(r["ky"], r["kx"]): r["covered"] for r in jn.overlap_fraction(rows(box, [(1, 5, 15, 0, 10)]), 10).collect()}
    assert out == {(0, 0): 0.5, (1, 0): 0.5}
    assert jn.overlapping_cells(rows(box, [(1, 0, 5, 0, 5), (2, 5, 9, 0, 5)])).count() == 0
    assert jn.overlapping_cells(rows(box, [(1, 0, 5, 0, 5), (2, 4, 9, 4, 9)])).count() == 1


def test_densest_window_prefers_the_first(rows):
    r = wn.densest_window(rows(YX, [(1, 1), (1, 2), (4, 4), (4, 5)]), 6, 6, 2).first()
    assert (r["y"], r["x"], r["total"]) == (0, 1, 2)


def dense_px(rows, h, w, seed):
    image = np.random.default_rng(seed).random((h, w))
    return image, rows("y int, x int, score double, valid boolean", [(y, x, float(image[y, x]), True) for y in range(h) for x in range(w)])


@pytest.mark.parametrize("tile", [8, 64])
def test_structure_does_not_depend_on_the_tile(rows, tile):
    p = tl.StructureParams(0, 1, 0.7, 1.0, 1.5)
    image, px = dense_px(rows, 21, 30, 5)
    out = np.zeros(image.shape)
    for r in tl.structural_map(px, image.shape, p, tile).collect():
        out[r["y"], r["x"]] = r["structure"]
    assert np.allclose(out, tl.structure_image(image, p))


def test_gaussian_keeps_a_constant_and_its_mass():
    assert np.allclose(tl.gaussian(np.full((9, 9), 3.0), 1.3), 3.0)
    spike = np.zeros((41, 41))
    spike[20, 20] = 1
    out = tl.gaussian(spike, 2.0)
    assert math.isclose(out.sum(), 1.0) and np.allclose(out, out.T) and np.allclose(out, out[::-1])


def test_thinning_keeps_one_connected_line():
    bar = np.zeros((9, 30), bool)
    bar[3:6, 3:27] = True
    s = tl.thin(bar)
    assert s.sum() < 30 and (s & ~bar).sum() == 0 and len(np.unique(tl.label_image(s))) == 2


def test_distance_image_against_brute_force():
    mask = np.random.default_rng(2).random((5, 6, 7)) < 0.05
    mask[2, 3, 3] = True
    on = np.argwhere(mask)
    for at in np.ndindex(mask.shape):
        assert math.isclose(tl.distance_image(mask)[at], np.sqrt(((on - at) ** 2).sum(axis=1).min()), abs_tol=1e-9)


def test_eccentricity_of_a_disk_and_a_line():
    disk = np.array([(y, x) for y in range(-9, 10) for x in range(-9, 10) if y * y + x * x <= 81])
    assert tl.eccentricity(disk) < 0.2 and tl.eccentricity(np.array([(0, i) for i in range(20)])) > 0.99


def test_morphology_joins_agree_with_the_image_kernel(rows):
    mask = np.random.default_rng(6).random((15, 18)) < 0.2
    df = rows(YX, [tuple(map(int, c)) for c in np.argwhere(mask)])
    got = {tuple(r) for r in tl.close(df, 2, mask.shape).collect()}
    assert got == {tuple(c) for c in np.argwhere(tl.close_image(mask, 2)).tolist()}


def test_candidate_masks_and_component_scores(rows):
    image, px = np.zeros((16, 16)), None
    image[4:7, 2:14] = 1.0
    px = rows("y int, x int, score double, valid boolean", [(y, x, float(image[y, x]), True) for y in range(16) for x in range(16)])
    r = tl.candidate_masks(px, 16, (16, 16), [0.4, 0.5, 0.6], 0.5, 1, 4, 0.8, 0.8).first()
    assert (r["mask_px"], r["components"], r["iou_low"], r["stable"]) == (36, 1, 1.0, True)
    scored = px.withColumn("structure", F.col("score"))
    s = tl.component_score(scored, 16, (16, 16), 0.5, 0, 4, 3).first()
    assert s["kept"] == 1 and s["best"] > 0.5 and s["longest"] == r["skeleton_px"]


def test_flat_surface_renders_its_volume(rows):
    vox = rows("z int, y int, x int, v int", [(z, y, x, 10 * z + x) for z in range(6) for y in range(6) for x in range(6)])
    g = rows(GRID, [(v, u, float(u), float(v), 2.0) for v in range(5) for u in range(5)])
    out = {(r["y"], r["x"], r["offset"]): r["v"] for r in tl.render_surface(g, vox, (5, 5), 2, [-1.0, 0.0, 1.0]).collect()}
    middle, side = out[(4, 4, 0.0)], {out[(4, 4, -1.0)], out[(4, 4, 1.0)]}
    assert middle == 22 and side == {12, 32}


def test_samplers_leave_out_chunks_without_a_point(rows):
    from surfaudit.operators import joins as jn

    vox = rows("z int, y int, x int, v int", [(0, y, x, y + x) for y in range(0, 300, 3) for x in range(0, 300, 3)])
    wanted = rows("z int, y int, x int", [(0, 5, 5), (0, 290, 70)])
    kept = jn.chunks_wanted(vox, wanted, ["z", "y", "x"], 64).collect()
    assert {(r["y"] // 64, r["x"] // 64) for r in kept} == {(0, 0), (4, 1)}
    points = rows("id int, pz double, py double, px double", [(1, 0.0, 6.0, 9.0), (2, 0.0, 290.5, 70.0)])
    got = {r["id"]: r["sample"] for r in jn.sample_volume(points, vox, ["id"]).collect()}
    assert got[1] == 15.0


def test_differences_stop_at_gaps_and_cross_segments(rows):
    from surfaudit.operators import windows as wn

    line = rows("u int, v int, z double", [(u, 0, float(u * u)) for u in [0, 1, 3, *range(1020, 1030)]])
    got = {r["u"]: r["dz"] for r in wn.central_diff(line, "z", "u", "v").collect()}
    assert (got[0], got[1], got[3]) == (2.0, 2.0, None)
    assert all(got[u] == 4.0 * u for u in range(1021, 1029))


def test_window_sums_cross_segments(rows):
    from surfaudit.operators import windows as wn

    out = {(r["y"], r["x"]): r["total"] for r in wn.window_sums(rows(YX, [(0, 1023), (1, 1024), (2, 5)]), 3, 1030, 2).collect()}
    assert len(out) == 2 * 1029 and out[(0, 1023)] == 2 and out[(1, 1024)] == 1 and out[(1, 4)] == 1 and sum(out.values()) == 2 + 4 + 2


def test_window_sums_equal_numpy(rows, monkeypatch):
    from surfaudit.operators import windows as wn

    monkeypatch.setattr(wn, "TILE", 8)
    draw = np.random.default_rng(6)
    cells = [(int(y), int(x)) for y, x in zip(draw.integers(0, 20, 40), draw.integers(0, 60, 40)) if x < 25 or x > 50] + [(3, 3)] * 5 + [(25, 2), (-1, 4)]
    full = np.zeros((20, 60), dtype=int)
    for y, x in cells:
        if 0 <= y < 20:
            full[y, x] += 1
    for k in (1, 3, 11):
        want = {(y, x): int(full[y : y + k, x : x + k].sum()) for y in range(21 - k) for x in range(61 - k)}
        assert {(r["y"], r["x"]): r["total"] for r in wn.window_sums(rows(YX, cells), 20, 60, k).collect()} == want
        best = wn.densest_window(rows(YX, cells), 20, 60, k).first()
        assert (best["total"], -best["y"], -best["x"]) == max((t, -y, -x) for (y, x), t in want.items())
    none = rows(YX, cells).where("false")
    assert tuple(wn.densest_window(none, 20, 60, 3).first()) == (0, 0, 0)
    assert tuple(wn.densest_window(none, 2, 60, 3).first()) == (None, None, None)


def test_nearest_boxes_meet_copies_of_points_and_boxes_once(spark):
    """3,000 points at 10 places and 600 boxes of 6 shapes: only places and the first boxes of a shape meet."""
    from tests.test_sampling import broadcast_rows

    pts = spark.range(3000).select(F.col("id").alias("point_id"), (F.col("id") % 10 * 9.0).alias("y"), (F.col("id") % 5 * 7.0).alias("x"))
    kind = F.col("id") % 6
    boxes = spark.range(600).select(F.col("id").alias("box_id"), (kind * 13).alias("y0"), (kind * 13 + 5).alias("y1"), (kind * 4).alias("x0"), (kind * 4 + 3).alias("x1"))
    first = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    got = {(r["point_id"], r["rank"]): (r["box_id"], r["distance"], r["volume"]) for r in jn.nearest_boxes(pts, boxes, ["y", "x"], 4, 8.0).collect()}
    assert max(broadcast_rows(spark, first), default=0) <= 10 * 6 * 4
    shapes = [(b, b % 6 * 13, b % 6 * 13 + 5, b % 6 * 4, b % 6 * 4 + 3) for b in range(600)]
    want = {}
    for p in range(3000):
        y, x = p % 10 * 9.0, p % 5 * 7.0
        if p < 10:
            best = sorted((math.hypot(max(y0 - y, y - y1, 0), max(x0 - x, x - x1, 0)), (y1 - y0) * (x1 - x0), b) for b, y0, y1, x0, x1 in shapes)[:4]
        else:
            best = [(d, v, b) for b, d, v in (want[p % 10, r] for r in range(1, 5))]
        for rank, (d, v, b) in enumerate(best, 1):
            want[p, rank] = (b, d, v)
    assert got.keys() == want.keys()
    assert all(got[k][0] == w[0] and math.isclose(got[k][1], w[1]) and got[k][2] == w[2] for k, w in want.items())


def volume(rng, n=400, span=90):
    return {(rng.randrange(-2, 4), rng.randrange(-40, span), rng.randrange(-40, span)): float(rng.randrange(256)) for _ in range(n)}


def trilinear(cells, p):
    total = 0.0
    for corner in range(8):
        at, weight = [], 1.0
        for d in range(3):
            on, base = corner >> d & 1, math.floor(p[d])
            weight *= (p[d] - base) if on else 1 - (p[d] - base)
            at.append(base + on)
        total += weight * cells.get(tuple(at), 0.0)
    return total


@pytest.mark.parametrize("at_once", [7, 1 << 16])
def test_samples_along_normals_equal_brute_force(rows, monkeypatch, at_once):
    monkeypatch.setattr(jn, "POINTS_AT_ONCE", at_once)
    rng = random.Random(8)
    cells = volume(rng, 6000)
    vox = rows("z int, y int, x int, v int", [(*k, int(v)) for k, v in cells.items()])
    pts = [(i, rng.uniform(-3, 5), rng.choice([31.0, 31.5, 32.0, -0.5, 63.9, rng.uniform(-45, 95)]), rng.uniform(-45, 95)) for i in range(120)]
    pts = [(*p, *rng.choice([(0.6, 0.0, -0.8), (0.0, -0.6, 0.8), (1.0, 0.0, 0.0)])) for p in pts]
    pts.append((500, None, 1.0, 1.0, 0.6, 0.0, -0.8))
    df = rows("id int, pz double, py double, px double, nz double, ny double, nx double", pts)
    got = {(r["id"], r["offset"]): r["sample"] for r in jn.sample_volume(df, vox, ["id"], along=[-2.5, 0.0, 1.0]).collect()}
    want = {(i, o): trilinear(cells, [a + n * o for a, n in zip(p, ns)]) for i, *rest in pts[:-1] for p, ns in [(rest[:3], rest[3:])] for o in (-2.5, 0.0, 1.0)}
    assert got.keys() == want.keys() and all(math.isclose(got[k], w, abs_tol=1e-9) for k, w in want.items())
    plain = {r["id"]: r["sample"] for r in jn.sample_volume(df, vox, ["id"]).collect()}
    assert len(plain) == 120 and all(math.isclose(plain[i], want[i, 0.0], abs_tol=1e-9) for i in plain)


def test_a_point_is_shuffled_once_not_for_each_corner(spark, rows):
    from tests.test_sampling import broadcast_rows, shuffled_rows

    pts = spark.range(4000).select("id", *[(F.col("id") % m + F.lit(0.25)).alias(f"p{a}") for a, m in (("z", 3), ("y", 31), ("x", 29))])
    vox = spark.range(2000).select((F.col("id") % 3).alias("z"), (F.floor(F.col("id") / 3) % 30).alias("y"), F.floor(F.col("id") / 90).alias("x"), F.lit(1).alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10000")
    try:
        first = spark._jsparkSession.sharedState().statusStore().executionsList().size()
        assert len(jn.sample_volume(pts, vox, ["id"]).collect()) == 4000
        assert shuffled_rows(spark, first) < 2 * (4000 + 2000)
        assert max(broadcast_rows(spark, first), default=0) <= 10
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def joined_rows(spark, first):
    """Rows that came out of joins in the executions numbered from ``first`` on."""
    store, total = spark._jsparkSession.sharedState().statusStore(), 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = store.executionsList()
    for run in (runs.apply(i).executionId() for i in range(first, runs.size())):
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            metrics = node.metrics()
            for m in (metrics.apply(i) for i in range(metrics.size())):
                found = values.get(m.accumulatorId())
                if "Join" in node.name() and m.name() == "number of output rows" and found.isDefined():
                    total += int(found.get().replace(",", ""))
    return total


def test_candidates_of_equal_bounds_meet_the_grid_once(spark):
    vertices = spark.range(2500).select((F.col("id") % 50).alias("v"), F.floor(F.col("id") / 50).alias("u")).withColumn("x", F.col("v") + 1.0).withColumn(
        "y", F.col("u") + 2.0).withColumn("z", F.lit(5.0))
    k = F.col("id") % 5
    boxes = spark.range(2000).select(F.col("id").alias("box_id"), (k * 6).alias("y0"), (k * 6 + 9 + k).alias("y1"), (k * 3).alias("x0"), (k * 3 + 20).alias("x1"))
    first = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    got = {r["box_id"]: tuple(r)[1:] for r in gr.candidate_geometry(boxes, vertices, (2.0, 2.0)).collect()}
    assert len(got) == 2000 and joined_rows(spark, first) < 4000
    for b in range(5):
        v0, v1, u0, u1 = b * 3, -(-(b * 7 + 9) // 2), b * 3 // 2, -(-(b * 3 + 20) // 2)
        want = ((v1 - v0) * (u1 - u0), v0 + 1.0, u0 + 2.0, 5.0, float(v1), u1 + 1.0, 5.0)
        assert got[b] == want and got[b + 1995] == want


def test_closing_shuffles_a_pixel_about_once_and_crosses_tiles(rows, spark):
    """Two surfaces, one without a name, on a canvas of several tiles with pixels off it; equal to the footprints counted."""
    from tests.test_sampling import shuffled_rows

    rng = np.random.default_rng(9)
    px = [(s, int(y), int(x)) for s in (1, None) for y, x in np.argwhere(rng.random((150, 140)) < 0.2) - 3]
    df = rows("surface int, y int, x int", px)
    first = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    got = [tuple(r) for r in tl.close(df, 2, (140, 133), ["surface"]).collect()]
    assert shuffled_rows(spark, first) < 1.4 * len(px)
    steps = tl.disk(2)
    for s in (1, None):
        grown = {(y + a, x + b) for t, y, x in px if t == s for a, b in steps}
        grown = {(y, x) for y, x in grown if 0 <= y < 140 and 0 <= x < 133}
        want = {p for p in grown if all((p[0] + a, p[1] + b) in grown for a, b in steps)}
        mine = [(y, x) for t, y, x in got if t == s]
        assert set(mine) == want and len(mine) == len(want)


def test_shells_equal_brute_force_across_tiles_in_few_shuffled_rows(rows, spark):
    """Voxels and surface of two groups, one without a name, on a volume of several tiles cut by its limits."""
    from tests.test_sampling import shuffled_rows

    rng = random.Random(12)
    spot = lambda: (rng.randrange(-2, 6), rng.randrange(20, 75), rng.randrange(60, 72))
    vox = {(g, *spot()): rng.choice([None, 3, 8, 100]) for g in (7, None) for _ in range(500)}
    near = {(g, *spot()) for g in (7, None) for _ in range(9)}
    columns = "g int, z int, y int, x int"
    v, s = rows(columns + ", v int", [(*k, x) for k, x in vox.items()]), rows(columns, sorted(near, key=str))
    limits = [(0, 6), (22, 70), (F.lit(60), F.lit(70))]
    first = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    got = {r["g"]: r for r in tl.shell_stats(v, s, limits, ["g"]).collect()}
    assert shuffled_rows(spark, first) < 1500 and len(got) == 2
    for g in (7, None):
        mine, held = [k[1:] for k in near if k[0] == g], {}
        for z in range(6):
            for y in range(22, 70):
                for x in range(60, 70):
                    d2 = min((z - a) ** 2 + (y - b) ** 2 + (x - c) ** 2 for a, b, c in mine)
                    if d2 <= 25:
                        held[z, y, x] = d2, vox.get((g, z, y, x)) or 0
        for name, (lo, hi) in tl.SHELLS.items():
            values = [v for d2, v in held.values() if lo < d2 <= hi]
            assert math.isclose(got[g][name], sum(values) / len(values)) if values else got[g][name] is None


def test_small_tiles_are_labelled_in_blocks(spark, rows, monkeypatch):
    draw = np.random.default_rng(23)
    cells = [(int(s), int(y), int(x)) for s in range(2) for y, x in np.argwhere(draw.random((40, 40)) < 0.55)]
    df = rows("surface int, y int, x int", cells)
    groups = spark.sparkContext.accumulator(0)
    plain = cc.tile_labels

    def counted(*a):
        groups.add(1)
        return plain(*a)

    monkeypatch.setattr(cc, "tile_labels", counted)
    label = lambda **kind: {(r.surface, r.y, r.x): r.component for r in cc.components(df, by=["surface"], **kind).collect()}
    one, clipped = label(tile=4), label(tile=4, clip=True)
    assert 0 < groups.value <= 4  # one block a surface; tiles of 4 alone would be 200 groups a run
    monkeypatch.setattr(cc, "BLOCK", {2: 4, 3: 4})
    assert one == label(tile=4) and clipped == label(tile=4, clip=True)
    monkeypatch.setattr(cc, "BLOCK", {2: 10, 3: 4})  # blocks of two tiles, with borders inside
    assert one == label(tile=4) and clipped == label(tile=4, clip=True)


def test_closing_takes_repeats_and_packs_the_pixels_of_a_tile(rows, monkeypatch):
    monkeypatch.setattr(tl, "PIXELS_AT_ONCE", 50)
    cells = [(int(y), int(x)) for y, x in np.argwhere(np.random.default_rng(5).random((30, 150)) < 0.3)]
    want = {(r.y, r.x) for r in tl.erode(tl.dilate(rows(YX, cells), 2, (30, 150)), 2).collect()}
    got = [(r.y, r.x) for r in tl.close(rows(YX, cells * 3).repartition(3), 2, (30, 150)).collect()]
    assert len(got) == len(want) and set(got) == want
    plan = tl.close(rows(YX, cells), 2, (30, 150))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan[plan.index("Exchange"):]  # packed before the shuffle
