"""Consensus: hand-computed cases, invariances and failed contracts."""

import math

import pytest
from pyspark.sql import functions as F

from surfaudit.operators import contracts as ct, evidence as ev, independence as ind
from surfaudit.plans.flows import ConsensusJob, run_consensus
from surfaudit.sources.ledgers import scratch

PX = "y int, x int, view_id int, score double"


def square(views):
    return [(y, x, v, float(s)) for v, values in views.items() for (y, x), s in zip([(0, 0), (0, 1), (1, 0), (1, 1)], values)]


def maps(df):
    return {(r["y"], r["x"]): r for r in df.collect()}


def test_correlated_views_count_once(rows):
    px = rows(PX, square({1: [1] * 4, 2: [1] * 4, 3: [0] * 4}))
    out = maps(ev.combine_evidence(px, {1: "a", 2: "a", 3: "b"}))
    assert {r["support"] for r in out.values()} == {0.5}
    assert not any(r["accepted"] for r in out.values())
    assert {r["valid_groups"] for r in out.values()} == {2}


def test_agreement_gate_and_missing_pixel(rows):
    px = rows(PX, square({1: [0.9, 0.2, 0.8, 0.9], 2: [0.8, 0.9, 0.7, math.nan]}))
    out = maps(ev.combine_evidence(px, {1: "a", 2: "b"}, ev.Gates(0.6, 2, 1.0, 0.3)))
    assert [out[k]["accepted"] for k in sorted(out)] == [True, False, True, False]
    assert out[(1, 1)]["valid_groups"] == 1


def test_pixel_without_any_view_is_rejected_not_null(rows):
    px = rows(PX, [(0, 0, 1, math.nan), (0, 0, 2, None)])
    r = ev.combine_evidence(px, {1: "a", 2: "b"}).first()
    assert r["accepted"] is False and r["support"] == 0 and r["consensus"] is None and r["disagreement"] is None


def test_duplicating_a_view_inside_its_group_changes_nothing(rows):
    base = square({1: [0.9, 0.4, 0.6, 0.7], 2: [0.7, 0.9, 0.65, 0.6]})
    twice = base + [(y, x, 3, s) for y, x, v, s in base if v == 1]
    one = ev.combine_evidence(rows(PX, base), {1: "a", 2: "b"})
    two = ev.combine_evidence(rows(PX, twice), {1: "a", 2: "b", 3: "a"})
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_normalised_entry_point_clips_infinity(rows):
    px = rows(PX, [(0, 0, 1, math.inf), (0, 0, 2, 200.0)])
    r = ev.combine_evidence(px, {1: "a", 2: "b"}, normalise=(0, 200)).first()
    assert r["consensus"] == 1.0 and r["accepted"]
    r = ev.combine_evidence(px, {1: "a", 2: "b"}).first()
    assert r["valid_groups"] == 1


def test_row_order_and_partitions_do_not_matter(rows):
    px = rows(PX, square({v: [0.1 * v, 0.9, 0.5, 0.7] for v in range(1, 6)}))
    groups = {1: "a", 2: "a", 3: "b", 4: "b", 5: "c"}
    a = ev.combine_evidence(px, groups).collect()
    b = ev.combine_evidence(px.orderBy(F.rand(3)).repartition(7), groups).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


VIEWS = "ord int, view_id string, grp string, acq string, fam string"


def test_shared_provenance_merges_groups(rows):
    v = rows(VIEWS, [(1, "p", "a", "s1", "f1"), (2, "q", "b", "s1", "f1")])
    r = ind.independence_audit(v, ["acq", "fam"]).first()
    assert (r["declared_groups"], r["effective_groups"], r["passed"]) == (2, 1, False)


def test_missing_provenance_merges_all(rows):
    v = rows(VIEWS, [(1, "p", "a", "s1", "f1"), (2, "q", "b", None, "f2"), (3, "r", "c", "s3", "f3")])
    assert ind.independence_audit(v, ["acq"]).first()["effective_groups"] == 1
    assert ind.provenance_links(v, ["acq"]).where("reason = 'missing_provenance'").count() == 2


def test_empty_string_is_a_value(rows):
    v = rows(VIEWS, [(1, "p", "a", "", "f1"), (2, "q", "b", "s2", "f2")])
    assert ind.independence_audit(v, ["acq"]).first()["effective_groups"] == 2


def test_effective_labels_follow_first_appearance(rows):
    v = rows(VIEWS, [(1, "p", "z", "s1", "f"), (2, "q", "m", "s2", "f"), (3, "r", "a", "s2", "f")])
    got = {r["grp"]: r["effective"] for r in ind.effective_groups(v, ["acq"]).collect()}
    assert got == {"z": 1, "m": 2, "a": 2}


def test_consensus_job_writes_maps_and_refuses_false_independence(spark, rows):
    px = rows("y int, x int, view_id string, score double", [(0, x, v, 0.9) for x in range(3) for v in "pq"])
    good = rows(VIEWS, [(1, "p", "a", "s1", "f"), (2, "q", "b", "s2", "f")])
    job = ConsensusJob("DEV", ev.Gates(), ["acq"])
    report = run_consensus(px, good, job, (1, 4), scratch(spark, "m"), scratch(spark, "r")).first()
    assert (report["pixels"], report["accepted_pixels"], report["effective_groups"]) == (4, 3, 2)
    bad = rows(VIEWS, [(1, "p", "a", "s1", "f"), (2, "q", "b", "s1", "f")])
    with pytest.raises(ct.ContractError):
        run_consensus(px, bad, job, (2, 2), scratch(spark, "m"), scratch(spark, "r"))
    with pytest.raises(ct.ContractError):
        run_consensus(px, rows(VIEWS, [(1, "p", "a", "s1", "f"), (2, "p", "b", "s2", "f")]), job, (2, 2), "x", "y")


def test_robust_scaling_of_a_constant_chunk(rows):
    out = ev.robust_mad(rows("k int, v double", [(0, 5.0)] * 4), "v", "k").collect()
    assert [r["scaled"] for r in out] == [0.0] * 4


def test_ct_support(rows):
    vox = rows("z int, y int, x int, v int", [(0, 0, 0, 9), (1, 0, 0, 3), (2, 1, 1, 4)])
    mask = rows("y int, x int, k int", [(0, 0, 1), (1, 1, 1)])
    r = ev.ct_support(vox, mask, (1, 2), 3, ["k"]).first()
    assert (r["any_fraction"], r["central_fraction"], r["pixels"]) == (1.0, 0.5, 2)
