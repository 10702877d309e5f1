"""Contracts, gates, decision ladders and the claim ceiling.

Contract checks return violations as rows; ``require`` raises on the first few before any
costly job starts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from surfaudit.functions.scalar import url_host

# The vocabularies a configuration may use, and the statuses a decision may have.
REGIMES = ("DEV", "VALIDATION", "DISCOVERY")
TRACKS = ("A", "B", "C")
TIERS = ("G0", "G1", "G2", "G3")
ROLES = ("locked_validation", "development", "post_hoc")
CONTINUE, NO_GO_LABELS = "CONTINUE_GEOMETRY_GATES", "NO_GO_LABEL_DIVERSITY_UPPER_BOUND"
NO_REGISTRATION, NO_SUPPORT = "NO_GO_REGISTRATION", "NO_GO_NO_COMMON_GEOMETRY_SUPPORT"
SINGLE_CLASS, COMPARE = "NO_GO_SINGLE_CLASS_COMMON_SUPPORT", "GO_SCORE_COMPARISON"
FROZEN = "frozen_before_ground_truth"
POST_HOC = "post_hoc_diagnostic"
AUDIT_SCHEMA = "independence-audit/1.0"


class ContractError(ValueError):
    """A table or configuration breaks its contract."""


def require(violations: DataFrame, what: str) -> None:
    bad = [r.asDict() for r in violations.limit(5).collect()]
    if bad:
        raise ContractError(f"{what}: {violations.count()} violations, such as {bad}")


def check_rows(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """(key, problem): every row rule that is not true; NULL counts as broken."""
    named = F.filter(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]),
        lambda p: p.isNotNull(),
    )
    return df.select(F.col(key).cast("string").alias("key"), F.explode(named).alias("problem"))


def repeated(df: DataFrame, key: str, problem: str = "repeated") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.col(key).cast("string").alias("key"), F.lit(problem).alias("problem")
    )


def view_contract(views: DataFrame, min_groups: int, gates: Mapping[str, float]) -> DataFrame:
    """Ids unique and non-empty, a group everywhere, thresholds in [0, 1], enough groups."""
    for name, value in gates.items():
        if not 0 <= value <= 1:
            raise ContractError(f"{name} must be in [0, 1]")
    filled = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    rows = check_rows(views, "view_id", {"empty_id": filled("view_id"), "no_group": filled("grp")})
    groups = views.groupBy("grp").agg(F.lit(1).alias("_g")).agg(F.count("grp").alias("n"))
    few = groups.where((F.col("n") < min_groups) | F.lit(min_groups < 2)).select(
        F.col("n").cast("string").alias("key"), F.lit("too_few_groups").alias("problem")
    )
    return rows.unionByName(repeated(views, "view_id", "repeated_id")).unionByName(few)


def coverage(px: DataFrame, view: str = "view_id", keys=("y", "x")) -> DataFrame:
    """Pixels per view against the canvas: aligned views cover the same pixels."""
    canvas = px.select(*keys).distinct().agg(F.count(F.lit(1))).scalar()
    return px.groupBy(view).agg(F.count(F.lit(1)).alias("pixels")).withColumn("canvas", canvas).withColumn(
        "aligned", F.col("pixels") == F.col("canvas")
    )


def allowed(df: DataFrame, key: str, enums: Mapping[str, Sequence[str]]) -> DataFrame:
    return check_rows(df, key, {f"invalid_{c}": F.col(c).isin(*values) for c, values in enums.items()})


def validate_package(candidates: DataFrame, tier: str) -> DataFrame:
    """Candidate contract: whole half-open bounds, geometry for G1 and above, ranks 1..n."""
    bounds = [F.col(c) for c in ("y0", "y1", "x0", "x1")]
    rules = {
        "incomplete_bounds": reduce(lambda a, c: a & c.isNotNull(), bounds, F.lit(True)),
        "invalid_bounds": (F.col("y0") < F.col("y1")) & (F.col("x0") < F.col("x1")),
    }
    if tier != "G0":
        rules["no_uv_bounds"] = F.col("has_uv")
        rules["no_xyz_bounds"] = F.col("has_xyz")
    total = candidates.agg(F.count(F.lit(1))).scalar()
    rules["rank_out_of_range"] = F.col("rank").between(1, F.col("_n"))
    rows = check_rows(candidates.withColumn("_n", total), "candidate_id", rules)
    return rows.unionByName(repeated(candidates, "rank", "repeated_rank"))


# -- gates ---------------------------------------------------------------------------------


def gates(metrics: DataFrame, criteria: Mapping[str, Column], go: str = "GO", no_go: str = "NO_GO") -> DataFrame:
    """Named booleans, whether all hold, and the status; an undefined metric fails its gate."""
    pairs = [x for name, ok in criteria.items() for x in (F.lit(name), F.coalesce(ok, F.lit(False)))]
    checks = metrics.withColumn("checks", F.create_map(*pairs))
    return checks.withColumn("passed", F.forall(F.map_values("checks"), lambda ok: ok)).withColumn(
        "status", F.when(F.col("passed"), go).otherwise(no_go)
    )


def ladder(df: DataFrame, steps: Sequence[tuple[Column, str]], default: str, alias: str = "status") -> DataFrame:
    """The status of the first step whose condition holds."""
    out = F.lit(default)
    for cond, status in reversed(steps):
        out = F.when(cond, status).otherwise(out)
    return df.withColumn(alias, out)


def partition_gate(stats: DataFrame, min_positive: int, min_negative: int, min_both: int) -> DataFrame:
    """Upper-bound gate on label counts, run before any geometry is read."""
    total = stats.agg(
        F.sum("valid_px").alias("valid_px"), F.sum("positive_px").alias("positive_px"),
        F.count_if((F.col("positive_px") > 0) & (F.col("positive_px") < F.col("valid_px"))).alias("both_chunks"),
    ).withColumn("negative_px", F.col("valid_px") - F.col("positive_px"))
    return gates(
        total,
        {
            "positive": F.col("positive_px") >= min_positive,
            "negative": F.col("negative_px") >= min_negative,
            "both": F.col("both_chunks") >= min_both,
        },
        CONTINUE,
        NO_GO_LABELS,
    )


def geometry_tier(audit: DataFrame) -> DataFrame:
    """G2 when the grid checks, the volume bounds and the CT support all hold, else G1 with blockers."""
    named = F.array(
        F.when(~F.col("bounds_ok"), "volume_bounds"), F.when(~F.col("ct_ok"), "ct_support"),
        F.when(~F.col("grid_ok"), "grid_checks"),
    )
    return audit.withColumn("blockers", F.array_compact(named)).withColumn(
        "tier", F.when(F.size("blockers") == 0, "G2").otherwise("G1")
    )


# -- ledger --------------------------------------------------------------------------------


def claim_ceiling(ledger: DataFrame, receipts: DataFrame, audits: DataFrame) -> DataFrame:
    """What each evidence receipt may support.

    A receipt must match its ledger hash, the schema the ledger expects and its role's regime; a
    post-hoc receipt must say what it is.  An audit must match its own ledger hash and schema and
    be bound to the receipt's hash; groups without one count as at most one.  Only a locked
    result with every check passed, tier G2 or G3, two audited groups and independent ground
    truth is eligible.  A missing value never satisfies a condition.
    """
    own = audits.select("artifact", "subject_sha", "effective_groups", "gate_passed", "audit_sha", "audit_schema", F.lit(True).alias("_audited"))
    both = ledger.join(receipts, "artifact", "left").join(own, "artifact", "left")
    both = both.withColumn("go_checks", F.coalesce("go_checks", F.create_map().cast("map<string,boolean>")))
    role, audited = F.coalesce("role", F.lit("")), F.coalesce("_audited", F.lit(False))
    same = lambda a, b: F.coalesce(F.col(a) == (F.col(b) if isinstance(b, str) else b), F.lit(False))
    problem = (
        F.when(F.col("sha").isNull(), "missing_receipt")
        .when(~role.isin(*ROLES), "unknown_role")
        .when(~same("sha", "declared_sha"), "hash_mismatch")
        .when(~same("schema_version", "expected_schema"), "schema_mismatch")
        .when((role == "locked_validation") & ~same("regime", F.lit("VALIDATION")), "role_regime_mismatch")
        .when((role == "development") & ~same("regime", F.lit("DEV")), "role_regime_mismatch")
        .when((role == "post_hoc") & ~same("analysis_type", F.lit(POST_HOC)), "not_post_hoc")
        .when(audited & ~same("audit_sha", "declared_audit_sha"), "audit_hash_mismatch")
        .when(audited & ~same("audit_schema", F.lit(AUDIT_SCHEMA)), "audit_schema_mismatch")
        .when(audited & ~same("subject_sha", "sha"), "audit_not_bound")
    )
    groups = F.when(audited, F.col("effective_groups")).otherwise(F.least(F.col("declared_groups"), F.lit(1)))
    checks = F.transform(F.map_values("go_checks"), lambda ok: F.coalesce(ok, F.lit(False)))
    eligible = (
        (role == "locked_validation") & (F.size(checks) > 0) & F.forall(checks, lambda ok: ok)
        & F.col("tier").isin("G2", "G3") & F.col("gate_passed") & (F.col("groups") >= 2)
        & F.col("truth_independent") & F.col("problem").isNull()
    )
    return both.withColumn("problem", problem).withColumn("groups", groups).select(
        "evidence_id", "role", "tier", "groups",
        F.aggregate(checks, F.lit(0), lambda n, ok: n + ok.cast("int")).alias("checks_passed"),
        F.size(checks).alias("checks_total"), "problem",
        F.coalesce(eligible, F.lit(False)).alias("eligible"),
    )


def claim_summary(entries: DataFrame) -> DataFrame:
    """Overall status: a claim needs an eligible receipt; the guardrail shows when none is."""
    out = entries.agg(
        F.count(F.lit(1)).alias("receipts"), F.count_if("eligible").alias("confirmations"),
        F.count_if(F.col("role") == "locked_validation").alias("locked"),
        F.count_if(F.col("role") == "post_hoc").alias("post_hoc"),
        F.count("problem").alias("problems"),
    )
    ready = F.col("confirmations") > 0
    return out.withColumn("status", F.when(ready, "CLAIM_READY").otherwise("NO_GO_SUBMISSION_CLAIM")).withColumn(
        "guardrail", (F.col("locked") > 0) & (F.col("post_hoc") > 0) & ~ready
    )


def freeze_lock(manifest: DataFrame, key: str) -> DataFrame:
    """Validation rows need a frozen state, method hash, partition id and no earlier reveal."""
    filled = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    return check_rows(
        manifest.where(F.col("regime") == "VALIDATION"), key,
        {
            "not_frozen": F.col("freeze_state") == FROZEN,
            "no_method_hash": filled("method_sha"),
            "no_partition": filled("partition_id"),
            "already_revealed": F.col("reveals") == 0,
        },
    )


def provenance_match(attrs: DataFrame, key: str, source: Column, level: Column) -> DataFrame:
    """Declared source and level must equal the configured ones; trailing slashes do not count."""
    trim = lambda c: F.regexp_replace(c, "/+$", "")
    return check_rows(
        attrs, key,
        {"source_mismatch": trim(F.col("declared_source")) == trim(source), "level_mismatch": F.col("declared_level") == level},
    )


def select_manifest(
    wanted: DataFrame, manifest: DataFrame, prefix: str, hosts: Sequence[str], forbidden: str
) -> DataFrame:
    """Requested files with their size and the first rule each one breaks (NULL when fine)."""
    counts = wanted.groupBy("name").agg(F.count(F.lit(1)).alias("times"))
    joined = counts.join(manifest.select(F.col("path").alias("name"), "bytes", "url", F.lit(True).alias("_in")), "name", "left")
    problem = (
        F.when(F.col("times") > 1, "requested_twice")
        .when(~F.col("name").startswith(prefix), "outside_prefix")
        .when(F.contains("name", F.lit(forbidden)), "forbidden_path")
        .when(F.col("_in").isNull(), "absent")
        .when(F.col("bytes").isNull() | (F.col("bytes") <= 0), "unknown_size")
        .when(~F.coalesce(url_host(F.col("url")).isin(*hosts), F.lit(False)), "host_not_allowed")
    )
    return joined.select("name", "bytes", problem.alias("problem"))


def selection_cap(selection: DataFrame, cap: int) -> DataFrame:
    fine = F.col("problem").isNull()
    total = F.coalesce(F.sum(F.when(fine, F.col("bytes"))), F.lit(0))
    return selection.agg(
        F.count(F.lit(1)).alias("requested"), F.count_if(fine).alias("selected"), total.alias("bytes"),
        (total <= F.lit(cap)).alias("within_cap"),
    )
