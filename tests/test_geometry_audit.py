"""The geometry audit: a sound surface earns G2, and each fault is named."""

import pytest

from surfaudit.operators.geometry_audit import Criteria, Volume, geometry_audit

SIZE, STEP = 6, 2
CRITERIA = Criteria(10.0, 0.05, 1.5, 0.9, 0.5)


def sound():
    return {(v, u): (10.0 * u + 1, 10.0 * v + 1, 50.0) for v in range(SIZE) for u in range(SIZE)}


def audited(rows, vertices, *, pixels=None, reference=(SIZE * STEP, SIZE * STEP), volume=Volume((100, 100, 100), True, (1, 3)), dark=(), criteria=CRITERIA):
    pixels = [("a", y, x) for y in range(4) for x in range(4)] + [("b", 9, x) for x in range(5)] if pixels is None else pixels
    grid = rows("v int, u int, x double, y double, z double", [(*k, *p) for k, p in vertices.items()])
    vox = [(z, y, x, 0 if b in dark else 7) for b, y, x in pixels for z in (1, 4)]
    args = (grid, (SIZE, SIZE), reference, rows("box_id string, y int, x int", pixels), rows("z int, y int, x int, v int", vox), volume, criteria)
    return geometry_audit(*args).first()


def test_a_sound_surface(rows):
    r = audited(rows, sound())
    assert (r.tier, list(r.blockers), r.largest_fraction, r.supervised, r.unsupported, r.candidates, r.passing) == ("G2", [], 1.0, 21, 0, 2, 2)


@pytest.mark.parametrize("change, blocker, column, value", [
    ({(0, 0): (float("nan"), 1.0, 1.0)}, "grid_checks", "nonfinite", 1),
    ({(5, 5): (-1.0, 1.0, 50.0)}, "grid_checks", "partial_sentinel", 1),
    ({(2, 2): (-1.0, -1.0, -1.0), (0, 0): (-1.0, -1.0, -1.0)}, "grid_checks", "unsupported", 4),
    ({(5, u): (10.0 * u + 1, 41.0, 50.0) for u in range(SIZE)}, "grid_checks", "degenerate_quads", 5),
    ({(5, 5): (71.0, 51.0, 50.0)}, "grid_checks", "abrupt_jumps", 2),
    ({(v, 5): (200.0, 10.0 * v + 1, 50.0) for v in range(SIZE)}, "volume_bounds", "out_of_bounds", 6),
])
def test_faults_of_the_grid(rows, change, blocker, column, value):
    r = audited(rows, sound() | change)
    assert r.tier == "G1" and blocker in r.blockers and r[column] == value


def test_faults_beside_the_grid(rows):
    assert list(audited(rows, sound(), dark=("b",)).blockers) == ["ct_support"]
    assert audited(rows, sound(), dark=("b",), criteria=Criteria(10.0, 0.05, 1.5, 0.9, 0.5, every_candidate=False)).tier == "G2"
    assert list(audited(rows, sound(), volume=Volume((100, 100, 100), False, (1, 3))).blockers) == ["volume_bounds"]
    r = audited(rows, sound(), reference=(13, 12))
    assert list(r.blockers) == ["grid_checks"] and r.integer_aligned is False and r.supervised is None
    r = audited(rows, {(0, 0): (-1.0, -1.0, -1.0)}, pixels=[])
    assert r.tier == "G1" and set(r.blockers) == {"volume_bounds", "ct_support", "grid_checks"} and r.valid == 0


def test_stencil_equals_shifted_copies_across_tiles(spark, monkeypatch):
    """Every place from which a point is seen, with repeated points, NULLs, NaNs and tile borders; a point is dealt about once."""
    from pyspark.sql import functions as F
    from surfaudit.operators import grid

    shape = "k string, v int, u int, a double, b bigint"
    data = [(k, v, u, float("nan") if (v + u) % 7 == 0 else None if (v + u) % 5 == 0 else v * 0.5 - u, v * u if v % 3 else None)
            for k in ("s", None) for v in range(9) for u in range(11) if (v * 5 + u) % 6]
    data += [("s", 4, 4, 99.0, None), ("s", 4, 4, None, 7), (None, 8, 3, -1.0, 1)]
    points = spark.createDataFrame(data, shape)
    want = None
    for dv, du in grid.CORNERS:
        moved = points.select("k", (F.col("v") - dv).alias("v"), (F.col("u") - du).alias("u"), *[
            (F.col(c) if (a, b) == (dv, du) else F.lit(None)).cast(t).alias(f"{c}_{a}{b}") for c, t in (("a", "double"), ("b", "bigint")) for a, b in grid.CORNERS])
        want = moved if want is None else want.unionAll(moved)
    want = want.groupBy("k", "v", "u").agg(*[F.max(c).alias(c) for c in want.columns[3:]])
    for tile in (3, 256):
        monkeypatch.setattr(grid, "TILE", tile)
        got = grid.stencil(points, ["a", "b"], by=["k"])
        assert got.dtypes == want.dtypes
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "FlatMapGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()
    assert grid.stencil(points.where("false"), ["a", "b"], by=["k"]).count() == 0
