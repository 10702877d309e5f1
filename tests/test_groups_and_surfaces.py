"""NULL groups, NULL scores and repeated keys lose no row; surfaces never mix."""

import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from surfaudit.functions import scalar as sc
from surfaudit.operators import components as cc, depth, evidence as ev, independence as ind, metrics as m
from surfaudit.operators import physical as ph, prefix as p, ranking as rk, regions as rg, tiles as tl
from surfaudit.operators.contracts import ContractError


@pytest.fixture(scope="module")
def scored(spark, rows):
    draw = random.Random(9)
    data = [(draw.choice(["a", "b", None]), draw.choice([None, *map(float, range(12))]), draw.random() < 0.4, i % 40) for i in range(400)]
    return rows("g string, s double, positive boolean, id int", data), data


def test_every_grouped_operator_keeps_the_null_group(scored):
    df, data = scored
    size = {g: sum(d[0] == g and d[1] is not None for d in data) for g in ("a", "b", None)}
    counts = lambda out: {r["g"]: r["n"] for r in out.collect()}
    assert counts(p.exact_quantiles(df, "s", {"q": 0.5}, ["g"])) == size
    assert counts(m.average_precision(df, "positive", "s", ["g"])) == size
    assert counts(m.roc_auc(df, "positive", "s", ["g"])) == size
    assert {r["g"]: r["n"] for r in p.value_ranks(df, "s", ["g"]).groupBy("g").agg(F.sum("n").alias("n")).collect()} == size
    assert {r["g"] for r in m.histogram_ap(df, "positive", "s", 4, ["g"]).collect()} == {"a", "b", None}
    assert ev.robust_mad(df.where("s IS NOT NULL"), "s", "g").count() == sum(size.values())
    reviews = df.select(F.col("g").alias("response"), F.col("s").alias("seconds"), F.lit(1).alias("confidence"))
    out = rg.review_summary(reviews).collect()
    assert len(out) == 3 and abs(sum(r["share"] for r in out) - 1) < 1e-12


@pytest.mark.parametrize("descending", [True, False])
def test_ranks_are_consecutive_with_nulls_and_repeats(scored, descending):
    df, data = scored
    out = rk.rank_rows(df, "s", ["id"], ["g"], descending).collect()
    assert len(out) == len(data)
    sign = -1 if descending else 1
    for g in ("a", "b", None):
        own = sorted((r for r in out if r["g"] == g), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))
        keys = [(r["s"] is None, sign * (r["s"] or 0), r["id"]) for r in own]
        assert keys == sorted(keys)


def test_surfaces_do_not_touch(rows):
    rng = np.random.default_rng(3)
    cells = [(s, int(y), int(x)) for s in (1, 2, None) for y, x in np.argwhere(rng.random((30, 30)) < 0.55)]
    df = rows("surface int, y int, x int", cells)
    got = {(r["surface"], r["y"], r["x"]): r["component"] for r in cc.components(df, tile=8, by=["surface"]).collect()}
    assert len(got) == len(cells)
    for s in (1, 2, None):
        own = df.where(F.col("surface").eqNullSafe(F.lit(s))).select("y", "x")
        alone = {(r["y"], r["x"]): r["component"] for r in cc.components(own, tile=64).collect()}
        assert alone == {(y, x): c for (k, y, x), c in got.items() if k == s}


def test_burden_per_surface_equals_each_surface_alone(rows):
    draw = random.Random(4)
    px = rows("surface int, y int, x int, accepted boolean, positive boolean, valid boolean, area_um2 double",
              [(s, y, x, draw.random() < 0.5, draw.random() < 0.2, True, 4e5) for s in (1, None) for y in range(12) for x in range(12)])
    both = {r["surface"]: r.asDict() for r in ph.fp_burden(px, 0.5, tile=4, by=["surface"]).collect()}
    for s in (1, None):
        alone = ph.fp_burden(px.where(F.col("surface").eqNullSafe(F.lit(s))).drop("surface"), 0.5).first().asDict()
        assert {k: v for k, v in both[s].items() if k != "surface"} == alone


def test_component_ids_refuse_coordinates_out_of_range(rows):
    with pytest.raises(PySparkException):
        cc.components(rows("z int, y int, x int", [(0, 0, 1 << 21)]), axes=("z", "y", "x")).collect()


def test_undeclared_and_repeated_readings_are_violations(rows):
    px = rows("y int, x int, view_id string, score double", [(0, 0, "p", 1.0), (0, 0, "p", 0.5), (0, 1, "zz", 1.0), (0, 1, None, 1.0)])
    found = {(r["key"], r["problem"]) for r in ev.undeclared_views(px, {"p": "a", "q": "b"}).collect()}
    assert found == {("p", "repeated_reading"), ("zz", "undeclared_view"), ("NULL", "undeclared_view")}
    with pytest.raises(ContractError, match="3 violations"):
        ev.require_declared(px, {"p": "a", "q": "b"})


def test_all_incomplete_fields_are_reasons(rows):
    v = rows("ord int, grp string, a string, b string", [(1, "g", None, "x"), (2, "h", "y", None)])
    links = ind.provenance_links(v, ["a", "b"]).where("reason = 'missing_provenance'")
    assert {r["field"] for r in links.collect()} == {"a", "b"}


def test_absent_planes_are_zero(rows):
    out = depth.pool_depth(rows("z int, y int, x int, v int", [(0, 0, 0, 8)]), 6, 3, 2).collect()
    assert sorted((r["plane"], r["v"]) for r in out) == [(0, 4), (1, 0), (2, 0)]


def test_tiles_without_a_pixel_are_run(rows):
    out = tl.structural_map(rows("y int, x int, score double", [(0, 0, 1.0)]), (20, 20), tl.StructureParams(), tile=8)
    assert out.count() == 400


def test_small_objects_are_four_connected(rows):
    px = rows("y int, x int, score double, valid boolean", [(y, x, float(x == y < 6), True) for y in range(8) for x in range(8)])
    r = tl.candidate_masks(px, 8, (8, 8), [0.4, 0.5], 0.5, 0, 4, 0.5, 0.5).first()
    assert (r["mask_px"], r["components"]) == (0, 0)


def test_names_a_job_needs_must_match(rows):
    um = sc.parse_required(F.col("n"), sc.VOLUME_NAME, 2)
    assert rows("n string", [("7-2.4um-x",)]).select(um.alias("um")).first()["um"] == "2.4"
    with pytest.raises(PySparkException):
        rows("n string", [("7-1.2.3um-x",)]).select(um.alias("um")).collect()
