"""Sources, sinks, contracts, gates, claims and incremental runs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from surfaudit.functions import scalar as sc
from surfaudit.operators import contracts as ct, depth, fitting as ft, joins as jn
from surfaudit.operators.ranking import candidate_package, select_chunks, same_keys
from surfaudit.sources import arrays, ledgers as ld
from surfaudit.streaming import incremental as inc


def test_array_files_become_rows(spark, tmp_path):
    image = np.array([[1.0, np.nan], [3.0, 4.0]], dtype="float32")
    np.save(tmp_path / "a.npy", image)
    np.savez(tmp_path / "b.npz", other=image * 0, scores=image * 2)
    np.arange(8, dtype="uint8").tofile(tmp_path / "0.raw")
    rows = arrays.read_arrays(spark, f"{tmp_path}/a.npy", ["y", "x"]).collect()
    assert {(r["y"], r["x"]): r["value"] for r in rows} == {(0, 0): 1.0, (0, 1): None, (1, 0): 3.0, (1, 1): 4.0}
    z = arrays.read_arrays(spark, f"{tmp_path}/b.npz", ["y", "x"], key="scores").agg(F.max("value")).first()[0]
    assert z == 8.0
    raw = arrays.read_arrays(spark, f"{tmp_path}/0.raw", ["z", "y", "x"], shape=(2, 2, 2)).collect()
    assert {(r["z"], r["y"], r["x"]): r["value"] for r in raw}[(1, 1, 0)] == 6.0


def test_chunks_survive_a_round_trip(rows):
    px = rows("y int, x int, s double", [(0, 0, 1.0), (5, 9, 2.0)])
    back = arrays.decode_arrays(arrays.encode_chunks(px, "s", 4), ["y", "x"], keep=["ky", "kx"])
    got = back.where("value is not null").select((F.col("ky") * 4 + F.col("y")).alias("y"), (F.col("kx") * 4 + F.col("x")).alias("x"), "value")
    assert sorted(map(tuple, got.collect())) == [(0, 0, 1.0), (5, 9, 2.0)]


def test_receipts_from_files(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"regime": "DEV", "go_checks": {"a": True, "b": False}, "extra": 1}))
    r = ld.read_receipts(spark, str(tmp_path)).first()
    assert r["regime"] == "DEV" and r["go_checks"] == {"a": True, "b": False} and len(r["sha"]) == 64


def test_listing_names_and_conflicts(rows):
    raw = rows("name string, ref string, size bigint, bytes bigint", [("a", None, 1, None), (None, "a", None, 2), ("", "b", 3, None)])
    listing = ld.normalize_listing(raw)
    assert sorted(r["name"] for r in listing.collect()) == ["a", "a", "b"]
    assert [r["name"] for r in ld.listing_conflicts(listing).collect()] == ["a"]


def test_catalog_keeps_empty_samples(rows):
    text = rows("value string", [('{"id": "s", "scans": [{"id": "1", "px": 2.4}, {"id": "2"}]}',), ('{"id": "t"}',)])
    scans = ld.explode_catalog(ld.parse_catalog(text), "scans")
    assert sorted((r["sample"], r["scan"]) for r in scans.where("scan is not null").collect()) == [("s", "1"), ("s", "2")]
    assert scans.count() == 3 and ld.at_resolution(scans, 2.4).count() == 1


def test_content_verification(rows):
    good = rows("path string, content string", [("a", "x"), ("b", "y"), ("z", "q")]).withColumn("content", F.encode("content", "UTF-8"))
    sha = lambda t: __import__("hashlib").sha256(t.encode()).hexdigest()
    man = rows("path string, bytes bigint, sha string", [("a", 1, sha("x")), ("b", 1, sha("n")), ("c", 1, sha("c"))])
    assert {r["path"]: r["problem"] for r in ld.verify_content(good, man).collect()} == {"b": "hash_mismatch", "c": "missing", "z": "unlisted"}


def test_snapshot_hash_ignores_order_but_not_content(rows):
    data = [(str(i % 50), i % 7) for i in range(200)]
    h = lambda d, n: ld.snapshot_hash(rows("p string, b int", d).repartition(n), ["p", "b"]).first()["digest"]
    assert h(data, 3) == h(data[::-1], 5) != h(data[:-1], 3)


def test_region_csv_keeps_eligible_rows(spark, rows, tmp_path):
    ld.write_report(rows("id int, eligible string", [(1, "True"), (2, "false"), (3, "TRUE")]), f"{tmp_path}/c", "csv")
    assert sorted(r["id"] for r in ld.read_regions(spark, f"{tmp_path}/c", "id int, eligible string").collect()) == [1, 3]


def test_chunk_selection_order_and_shortage(rows):
    listing = rows("cy int, cx int, bytes int", [(0, 0, 5), (0, 1, 9), (1, 0, 9), (1, 1, 1)])
    out = select_chunks(listing, 2, 2).collect()
    assert [(r["cy"], r["cx"]) for r in sorted(out, key=lambda r: r["rank"])] == [(0, 1), (1, 0)] and out[0]["found"] == 3
    assert select_chunks(listing, 4, 2).first()["enough"] is False


def test_package_contract(rows):
    c = rows("candidate_id string, rank int, y0 int, y1 int, x0 int, x1 int, has_uv boolean, has_xyz boolean",
             [("a", 1, 0, 4, 0, 4, True, True), ("b", 1, 4, 4, 0, 4, False, True)])
    got = {(r["key"], r["problem"]) for r in ct.validate_package(c, "G1").collect()}
    assert got == {("b", "invalid_bounds"), ("b", "no_uv_bounds"), ("1", "repeated_rank")}
    ranked = candidate_package(rows("region_id string, s double, eligible boolean", [("p", 1.0, True), ("q", 3.0, True), ("r", 9.0, False)]), "s", 5, "e", "region_id")
    assert [r["candidate_id"] for r in ranked.collect()] == ["e-r001", "e-r002"]


def test_review_contract(rows):
    q = rows("candidate_id string", [("a",), ("b",)])
    r = rows("candidate_id string, response string, confidence int, seconds double", [("a", "yes", 3, 1.0), ("a", "maybe", 9, -1.0)])
    got = {(x["candidate_id"], x["problem"]) for x in jn.validate_reviews(q, r, "candidate_id", ["yes", "no"]).collect()}
    assert got == {("a", "repeated"), ("b", "not_reviewed"), ("a", "invalid_response"), ("a", "invalid_confidence"), ("a", "invalid_seconds")}
    assert same_keys(q, q, "candidate_id").first()["same"]


@pytest.mark.parametrize("change,eligible,problem", [
    ({}, True, None), ({"role": "post_hoc"}, False, None), ({"declared_sha": "x"}, False, "hash_mismatch"), ({"tier": "G1"}, False, None),
    ({"regime": "DEV"}, False, "role_regime_mismatch"), ({"subject_sha": "other"}, False, "audit_not_bound"), ({"subject_sha": None}, False, None),
    ({"schema": "other"}, False, "schema_mismatch"), ({"role": None}, False, "unknown_role"), ({"regime": None}, False, "role_regime_mismatch"),
    ({"role": "post_hoc", "analysis": None}, False, "not_post_hoc"), ({"audit_sha": "x"}, False, "audit_hash_mismatch"),
    ({"audit_schema": "x"}, False, "audit_schema_mismatch"), ({"go_checks": None}, False, None), ({"go_checks": {"a": None}}, False, None),
    ({"truth_independent": False}, False, None), ({"go_checks": {"a": True, "b": False}}, False, None), ({"go_checks": {}}, False, None),
])
def test_claim_needs_every_condition(rows, change, eligible, problem):
    v = {"role": "locked_validation", "declared_sha": "s", "sha": "s", "regime": "VALIDATION", "tier": "G2", "subject_sha": "s",
         "truth_independent": True, "go_checks": {"a": True}, "schema": "r/1", "analysis": ct.POST_HOC, "audit_sha": "a",
         "audit_schema": ct.AUDIT_SCHEMA} | change
    ledger = rows("artifact int, evidence_id int, declared_sha string, role string, declared_groups int, truth_independent boolean, expected_schema string, "
                  "declared_audit_sha string", [(1, 1, v["declared_sha"], v["role"], 3, v["truth_independent"], "r/1", "a")])
    receipts = rows("artifact int, sha string, regime string, tier string, go_checks map<string,boolean>, schema_version string, analysis_type string",
                    [(1, v["sha"], v["regime"], v["tier"], v["go_checks"], v["schema"], v["analysis"])])
    audits = rows("artifact int, subject_sha string, effective_groups int, gate_passed boolean, audit_sha string, audit_schema string",
                  [(1, v["subject_sha"], 2, True, v["audit_sha"], v["audit_schema"])] if v["subject_sha"] else [])
    r = ct.claim_ceiling(ledger, receipts, audits).first()
    assert (r["eligible"], r["problem"]) == (eligible, problem)
    if v["subject_sha"] is None:
        assert r["groups"] == 1
    s = ct.claim_summary(ct.claim_ceiling(ledger, receipts, audits)).first()
    assert s["status"] == ("CLAIM_READY" if eligible else "NO_GO_SUBMISSION_CLAIM")


def test_gates_fail_on_undefined_metrics(rows):
    r = ct.gates(rows("a double", [(None,)]), {"a": F.col("a") >= 0}).first()
    assert r["passed"] is False and r["checks"] == {"a": False}


def test_partition_gate(rows):
    stats = rows("valid_px int, positive_px int", [(100, 10), (100, 0)])
    assert ct.partition_gate(stats, 5, 5, 1).first()["status"] == "CONTINUE_GEOMETRY_GATES"
    assert ct.partition_gate(stats, 5, 5, 2).first()["status"] == ct.NO_GO_LABELS


def test_scalar_contracts():
    with pytest.raises(ValueError):
        sc.normalize(F.lit(1), 1, 1)
    with pytest.raises(ValueError):
        sc.affine([[1, 0, 0, 0]] * 3 + [[0, 0, 1, 1]], F.lit(0), F.lit(0), F.lit(0))


def test_depth_pooling_is_centred(rows):
    vox = rows("z int, y int, x int, v int", [(z, 0, 0, z) for z in range(109)])
    out = {r["plane"]: r["v"] for r in depth.pool_depth(vox, 109, 21, 4).collect()}
    assert len(out) == 21 and out[0] == 14 and out[20] == 94


def test_array_statistics(rows):
    r = rows("a array<double>", [([1.0, 5.0, 5.0, 1.0],)]).select(*[c.alias(k) for k, c in sc.profile_features(F.col("a")).items()]).first()
    assert (r["mean"], r["std"], r["argmax"], r["slope"], r["center_contrast"]) == (3.0, 2.0, 1, 0.0, 4.0)


def test_extents_of_empty_axes(rows):
    r = rows("a array<int>, b array<int>", [([0, 4], [0, 2])]).select(
        sc.extent_ratio(F.col("a"), F.array(F.lit(1.0), F.lit(1.0)), F.col("b"), F.array(F.lit(1.0), F.lit(1.0))).alias("r")).first()
    assert r["r"] == [0.0, 0.5]


def test_incremental_run_processes_each_file_once(spark, rows, tmp_path):
    src, sink, state = (f"{tmp_path}/{n}" for n in ("src", "sink", "state"))
    schema = "id int, v double"
    op = lambda df: df.where("v > 0")
    rows(schema, [(1, 1.0), (2, -1.0)]).coalesce(1).write.parquet(src)
    inc.run_incremental(inc.arrivals(spark, src, schema), op, sink, state)
    rows(schema, [(3, 3.0)]).coalesce(1).write.mode("append").parquet(src)
    inc.run_incremental(inc.arrivals(spark, src, schema), op, sink, state)
    inc.run_incremental(inc.arrivals(spark, src, schema), op, sink, state)
    assert sorted(r["id"] for r in spark.read.parquet(sink).collect()) == [1, 3]


def test_progress_adds_up_over_batches(spark, rows, tmp_path):
    src, sink, log, state = (f"{tmp_path}/{n}" for n in ("src", "sink", "log", "state"))
    rows("id int, v double", [(i, float(i)) for i in range(9)]).repartition(3).write.parquet(src)
    inc.run_with_progress(inc.arrivals(spark, src, "id int, v double", files_per_batch=1), lambda d: d.where("v > 2"), sink, log, state, "v")
    r = inc.progress(spark, log, spark.read.parquet(src)).first()
    assert (r["batches"], r["done"], r["verified"], r["total"]) == (3, 6, 33.0, 9)


def test_crossfit_scores_every_row_and_learns(spark):
    df = spark.range(240).select("id", (F.col("id") % 2 == 0).alias("label"), (F.col("id") % 2 + F.rand(1) * 1.2).alias("f"))
    from surfaudit.operators.metrics import roc_auc
    from surfaudit.operators.sampling import buffered_folds

    folded = buffered_folds(df, "id", 3, 2)
    out = ft.crossfit_logistic(folded, ["f"], "label", "fold", ["id"])
    assert ft.oof_completeness(out, df, "id").count() == 0
    assert roc_auc(out, "label", "score").first()["auc"] > 0.8


def test_median_fill(rows):
    df = rows("a double, b double", [(1.0, None), (3.0, 4.0), (None, 8.0)])
    assert sorted(map(tuple, ft.impute_median(df, ["a", "b"]).collect())) == [(1.0, 6.0), (2.0, 8.0), (3.0, 4.0)]
