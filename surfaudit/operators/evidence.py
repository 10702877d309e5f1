"""Consensus over views: correlated replicas are collapsed before anything is counted."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from surfaudit.functions.scalar import count_of, fuse, lit, median_of, normalize, valid_score
from surfaudit.operators.contracts import require
from surfaudit.operators.prefix import join_by


@dataclass(frozen=True)
class Gates:
    """Acceptance thresholds; every comparison is inclusive."""

    evidence: float = 0.6
    min_groups: int = 2
    min_support: float = 1.0
    max_disagreement: float = 0.3


def undeclared_views(px: DataFrame, groups: Mapping, keys=("y", "x")) -> DataFrame:
    """(key, problem): views without a declared group, and views read twice on a pixel."""
    per = px.groupBy(*keys, "view_id").agg(F.count(F.lit(1)).alias("n"))
    found = per.groupBy("view_id").agg(F.count_if(F.col("n") > 1).alias("twice"))
    unknown = ~F.coalesce(F.col("view_id").isin(*groups), F.lit(False))
    problems = F.array_compact(F.array(F.when(unknown, "undeclared_view"), F.when(F.col("twice") > 0, "repeated_reading")))
    return found.select(F.coalesce(F.col("view_id").cast("string"), F.lit("NULL")).alias("key"), F.explode(problems).alias("problem"))


def require_declared(px: DataFrame, groups: Mapping, keys=("y", "x")) -> None:
    """Raises on readings that the consensus would ignore or merge."""
    require(undeclared_views(px, groups, keys), "views")


def _collapse(px: DataFrame, groups: Mapping, keys, score: Column) -> tuple[DataFrame, list]:
    """Wide form: one column of views per group name, from a single hash aggregate.

    Declared views become conditional aggregates, so the shuffle on the pixel key combines on
    the map side and nothing is sorted or collected.
    """
    slots = {view: f"_v{i}" for i, view in enumerate(groups)}
    wide = px.groupBy(*keys).agg(
        *[F.max(F.when(F.col("view_id") == v, score)).alias(s) for v, s in slots.items()]
    )
    names = list(dict.fromkeys(groups.values()))
    return wide, [(g, [F.col(slots[v]) for v in groups if groups[v] == g]) for g in names]


def collapse_groups(px: DataFrame, groups: Mapping, keys=("y", "x")) -> DataFrame:
    """Median of the valid views of each independence group, one row per pixel and group."""
    wide, members = _collapse(px, groups, keys, valid_score(F.col("score")))
    rows = F.array(*[
        F.struct(F.lit(g).alias("grp"), median_of(*cols).alias("score"), count_of(*cols).alias("views")) for g, cols in members
    ])
    return wide.select(*keys, F.explode(rows).alias("g")).select(*keys, "g.*").where("views > 0")


def _decide(groups: list[Column], gates: Gates) -> dict[str, Column]:
    n = count_of(*groups)
    consensus = median_of(*groups)
    spread = F.greatest(*groups) - F.least(*groups) if len(groups) > 1 else groups[0] - groups[0]
    above = lit(0)
    for g in groups:
        above = above + F.coalesce((g >= lit(gates.evidence)).cast("double"), lit(0))
    support = F.coalesce(F.try_divide(above, n), lit(0))
    accepted = (
        (n >= gates.min_groups)
        & (consensus >= lit(gates.evidence))
        & (support >= lit(gates.min_support))
        & (spread <= lit(gates.max_disagreement))
    )
    return {
        "valid_groups": n,
        "consensus": consensus,
        "disagreement": spread,
        "support": support,
        "accepted": F.coalesce(accepted, F.lit(False)),
    }


def combine_evidence(
    px: DataFrame, groups: Mapping, gates: Gates = Gates(), keys=("y", "x"), normalise=None
) -> DataFrame:
    """Per-pixel consensus of long pixels(keys, view_id, score).

    ``groups`` maps each declared view to its effective group (a short configuration, like
    the list of score columns).  Both medians follow from one hash aggregate.
    """
    if not 2 <= gates.min_groups <= len(set(groups.values())):
        raise ValueError("min_groups must lie between 2 and the number of groups")
    score = F.col("score")
    score = normalize(score, *normalise) if normalise else valid_score(score)
    wide, members = _collapse(px, groups, keys, score)
    names = [g for g, _ in members]
    collapsed = wide.select(*keys, *[median_of(*cols).alias(f"_g{i}") for i, (_, cols) in enumerate(members)])
    decided = _decide([F.col(f"_g{i}") for i in range(len(names))], gates)
    return collapsed.select(*keys, *[c.alias(k) for k, c in decided.items()])


def evidence_report(maps: DataFrame, canvas: tuple[int, int]) -> DataFrame:
    """Accepted pixels over all pixels of the canvas (height, width), stored or not.

    A pixel without a row has no valid group and no support.
    """
    pixels = F.lit(canvas[0] * canvas[1]).cast("bigint")
    return maps.agg(
        F.count_if("accepted").alias("accepted_pixels"),
        F.coalesce(F.max("valid_groups"), F.lit(0)).alias("max_valid_groups"),
        F.coalesce(F.sum("support"), lit(0)).alias("_support"),
    ).select(
        pixels.alias("pixels"), "accepted_pixels", F.try_divide("accepted_pixels", pixels).alias("accepted_fraction"),
        "max_valid_groups", F.try_divide("_support", pixels).alias("mean_support"),
    )


def consistency_maps(pairs: DataFrame, max_disagreement: float, keys=("y", "x")) -> DataFrame:
    """Disagreement, geometric consensus and the retained flag of pixels valid in both views."""
    a, b = F.col("a"), F.col("b")
    return pairs.select(
        *keys,
        fuse(a, b, "disagreement").alias("disagreement"),
        fuse(a, b, "geometric").alias("consensus"),
        (fuse(a, b, "disagreement") <= lit(max_disagreement)).alias("retained"),
    )


def blend_tiles(tiles: DataFrame, keys=("y", "x")) -> DataFrame:
    """Weighted mean of overlapping tile predictions; ``valid`` switches a contribution off."""
    w = F.when(F.col("valid"), F.col("w")).otherwise(lit(0))
    return tiles.groupBy(*keys).agg(
        (F.sum(F.col("p") * w) / F.greatest(F.sum(w), lit(1e-12))).alias("blended"),
        F.sum(w).alias("weight"),
    )


def robust_mad(df: DataFrame, value: str, by: str) -> DataFrame:
    """Clip to p01-p99, centre on the median, divide by 1.4826 MAD (with a fallback scale).

    A unit is one stored chunk, whose cell count is fixed by the chunk shape, so its exact
    percentiles are bounded.
    """
    v = F.col(value).cast("double")
    cut = df.groupBy(by).agg(F.percentile(v, [0.01, 0.99]).alias("_cut"))
    clipped = join_by(df, cut, [by]).withColumn(
        "_c", F.greatest(F.get("_cut", F.lit(0)), F.least(F.get("_cut", F.lit(1)), v))
    )
    mid = clipped.groupBy(by).agg(
        F.median("_c").alias("_med"),
        F.stddev_pop("_c").alias("_std"),
        F.max(F.get("_cut", F.lit(1)) - F.get("_cut", F.lit(0))).alias("_span"),
    )
    centred = join_by(clipped, mid, [by])
    mad = centred.groupBy(by).agg(F.median(F.abs(F.col("_c") - F.col("_med"))).alias("_mad"))
    scale = lit(1.4826) * F.col("_mad")
    scale = F.when(scale < lit(1e-6), F.greatest("_std", F.col("_span") / 2, lit(1))).otherwise(scale)
    return join_by(centred, mad, [by]).withColumn("scaled", (F.col("_c") - F.col("_med")) / scale).select(
        *df.columns, "scaled"
    )


def ct_support(
    vox: DataFrame, mask: DataFrame, central: tuple[int, int], depth: int, by, keys=("y", "x")
) -> DataFrame:
    """Share of masked pixels with a nonzero voxel at any / central depth, median nonzero share.

    Pixels without stored voxels count as empty, so the mask drives the join.
    """
    z0, z1 = central
    hit = F.col("v") > 0
    per_pixel = vox.groupBy(*keys).agg(
        F.count_if(hit).alias("hits"),
        F.count_if(hit & (F.col("z") >= z0) & (F.col("z") < z1)).alias("central_hits"),
    )
    joined = mask.join(per_pixel, list(keys), "left").fillna(0, ["hits", "central_hits"])
    return joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pixels"),
        F.avg((F.col("hits") > 0).cast("double")).alias("any_fraction"),
        F.avg((F.col("central_hits") > 0).cast("double")).alias("central_fraction"),
        F.median(F.col("hits") / lit(depth)).alias("median_depth_fraction"),
    )
