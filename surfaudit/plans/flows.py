"""End-to-end jobs: consensus maps, locked label evaluation, region audit to candidate package.

Configuration is checked before any pixel is read, cheap gates run before costly stages, and
each job ends in the sinks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from surfaudit.operators import contracts as ct, evidence as ev, independence as ind, metrics as m
from surfaudit.operators import ranking as rk, regions as rg, sampling as sp
from surfaudit.functions.scalar import lit
from surfaudit.operators.joins import sample_support
from surfaudit.session import cut_lineage
from surfaudit.sources.ledgers import write_maps, write_report


@dataclass(frozen=True)
class ConsensusJob:
    regime: str
    gates: ev.Gates
    required_fields: Sequence[str] = field(default_factory=list)
    value_range: tuple[float, float] | None = None


def effective_mapping(views: DataFrame, job: ConsensusJob) -> dict:
    """view_id -> effective group.  Views are a short declared list, as in a configuration."""
    if not job.required_fields:
        return {r["view_id"]: r["grp"] for r in views.select("view_id", "grp").collect()}
    groups = ind.effective_groups(views, job.required_fields)
    rows = views.select("view_id", "grp").join(groups, "grp").collect()
    mapping = {r["view_id"]: r["effective"] for r in rows}
    if len(set(mapping.values())) < job.gates.min_groups:
        raise ct.ContractError("insufficient effective independent groups after provenance audit")
    return mapping


def run_consensus(
    px: DataFrame, views: DataFrame, job: ConsensusJob, canvas: tuple[int, int], maps_path: str, report_path: str
) -> DataFrame:
    """Contract, independence audit, collapse, consensus, map and report sinks.

    Readings of undeclared views, and two readings of one view on a pixel, are violations.
    """
    if job.regime not in ct.REGIMES:
        raise ct.ContractError(f"regime must be one of {ct.REGIMES}")
    thresholds = {
        "evidence": job.gates.evidence, "min_support": job.gates.min_support, "max_disagreement": job.gates.max_disagreement
    }
    ct.require(ct.view_contract(views, job.gates.min_groups, thresholds), "view contract")
    mapping = effective_mapping(views, job)
    ev.require_declared(px, mapping)
    maps = ev.combine_evidence(px, mapping, job.gates, normalise=job.value_range)
    write_maps(maps.withColumn("cy", F.floor(F.col("y") / 256)), maps_path, ["cy"])
    report = ev.evidence_report(px.sparkSession.read.parquet(maps_path), canvas).withColumn(
        "effective_groups", F.lit(len(set(mapping.values())))
    ).withColumn("regime", F.lit(job.regime))
    write_report(report, report_path)
    return report


def evaluate_locked(
    px: DataFrame, lattices: Sequence[DataFrame], canvas: tuple[int, int], shapes: Sequence[tuple[int, int]],
    min_positive: int, min_negative: int, min_both: int, abstention: float, min_gain: float, reps: int, seed: int,
) -> DataFrame:
    """Two-model evaluation on common support.

    Pixels (y, x, cy, cx, positive, valid, s0, s1) must be supported by every lattice.  The
    support gate is one cheap aggregate; no score is compared when it fails.
    """
    eligible = px.where("valid")
    for lattice, shape in zip(lattices, shapes):
        eligible = sample_support(eligible, lattice, canvas, shape).where("all").drop("nearest", "all", "any")
    eligible = cut_lineage(eligible)
    gate = ct.partition_gate(
        rg.label_stats(eligible, ["cy", "cx"]).where("cy is not null"), min_positive, min_negative, min_both
    )
    head = gate.select("valid_px", "positive_px", "both_chunks", "passed").first()
    if not head["passed"]:
        return gate.select("valid_px", "positive_px", F.lit("NO_GO_EVALUATION_SUPPORT").alias("status"))
    block = eligible.withColumn("block", F.col("cy").cast("bigint") * (1 << 31) + F.col("cx"))
    single = m.baseline_table(eligible, "positive", ["s0", "s1"]).agg(F.max("ap")).scalar()
    ci = sp.gain_bootstrap(block, "positive", "block", abstention, reps, seed)
    low = ci.where("gain = 'fusion'").select("low").scalar()
    out = m.abstain(eligible, abstention).withColumn("best_single", single).withColumn("fusion_low", low)
    return ct.gates(
        out,
        {
            "fusion_gain": F.col("ap") - F.col("best_single") >= lit(min_gain),
            "fusion_low": F.col("fusion_low") > 0,
            "abstention_gain": F.col("gain") >= 0,
        },
        "GO_CROSS_MODEL_VALUE", "NO_GO_CROSS_MODEL_VALUE",
    )


def region_package(
    px: DataFrame, size: int, min_valid: float, canvas: tuple[int, int], positive_px: int, scores: Sequence[str], baseline: str, n: int, prefix: str
) -> tuple[DataFrame, DataFrame]:
    """Region audit, score ablation and the ranked candidate package, from one region table."""
    regions = cut_lineage(rg.summarize_regions(px, size, min_valid, canvas))
    ranked = regions.where("eligible").withColumn("ord", F.col("y0") * (1 << 31) + F.col("x0")).withColumn(
        "label", F.col("positive_px") >= positive_px
    )
    ablation = m.score_ablation(ranked, "label", scores, baseline, 0.05, "ord")
    return ablation, rk.candidate_package(regions, baseline, n, prefix, "region_id")
