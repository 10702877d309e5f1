"""False-positive burden in physical area, and policy comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from surfaudit.functions.scalar import lit
from surfaudit.operators.components import component_areas, components
from surfaudit.operators.prefix import join_by, prefix_sum, value_counts
from surfaudit.session import cut_lineage

UM2_PER_MM2 = 1e6
UM2_PER_CM2 = 1e8


def _negative():
    return F.col("valid") & ~F.col("positive")


def fp_burden(px: DataFrame, min_mm2: float, tile: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Negative area, false-positive pixels and area, and retained components per negative cm2.

    One row per surface ``by``.  Components below the minimum stay in the area but not in the
    retained rate.
    """
    by = list(by)
    fp = F.col("accepted") & _negative()
    base = px.groupBy(*by).agg(
        F.count_if(_negative()).alias("negative_px"),
        (F.sum(F.when(_negative(), F.col("area_um2"))) / lit(UM2_PER_CM2)).alias("negative_cm2"),
        F.count_if(fp).alias("fp_px"),
        (F.coalesce(F.sum(F.when(fp, F.col("area_um2"))), lit(0)) / lit(UM2_PER_CM2)).alias("fp_cm2"),
    )
    hits = cut_lineage(px.where(fp).select(*by, "y", "x", "area_um2"))  # the hits alone, read twice
    labelled = join_by(components(hits, tile=tile, by=by), hits, by, on=["y", "x"])
    counts = component_areas(labelled, by, "area_um2").groupBy(*by).agg(
        F.count(F.lit(1)).alias("components_all"), F.count_if(F.col("area") >= lit(min_mm2 * UM2_PER_MM2)).alias("components_retained")
    )
    out = join_by(base, counts, by, "left").fillna(0, ["components_all", "components_retained"])
    return out.select(
        *by, "negative_px", "negative_cm2", "fp_px", "fp_cm2",
        F.try_divide("fp_cm2", "negative_cm2").alias("fp_fraction"), "components_all", "components_retained",
        F.try_divide("components_retained", "negative_cm2").alias("components_per_cm2"),
    )


def top_cutoffs(px: DataFrame, score: str, fractions: Sequence[float]) -> DataFrame:
    """One row with the k-th largest score per fraction, k = max(1, ceil(n * fraction))."""
    curve = prefix_sum(value_counts(px, score), "value", ["n"], descending=True)
    k = lambda f: F.greatest(F.lit(1), F.ceil(F.col("total_n").cast("double") * lit(f)))
    return curve.agg(
        F.array(*[F.max(F.when(F.col("cum_n") >= k(f), F.col("value"))) for f in fractions]).alias("cuts")
    )


def evaluate_policies(
    px: DataFrame, score: str, threshold: float, fractions: Sequence[float], min_mm2: float, chunk: int
) -> DataFrame:
    """Yield, precision and false-positive area of abstaining, a threshold and top fractions.

    Pixels are scanned once and fan out over the literal policy list; components are clipped
    at chunk borders.  Precision is NULL where nothing is accepted.
    """
    px = px.where("valid").select("y", "x", "positive", "area_um2", score)
    cuts = top_cutoffs(px, score, fractions).scalar()
    s = F.col(score)
    options = [("abstain_all", F.lit(False)), (f"score_gte_{threshold:g}", s >= lit(threshold))]
    options += [(f"top_{f:g}", s >= F.get("_cuts", F.lit(i))) for i, f in enumerate(fractions)]
    long = px.withColumn("_cuts", cuts).select(
        "y", "x", "positive", "area_um2",
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("policy"), F.coalesce(c, F.lit(False)).alias("accepted")) for n, c in options])
        ).alias("p"),
    ).select("y", "x", "positive", "area_um2", "p.*")
    acc, pos = F.col("accepted"), F.col("positive")
    base = long.groupBy("policy").agg(
        F.count(F.lit(1)).alias("pixels"), F.count_if(acc).alias("accepted_px"),
        F.count_if(acc & pos).alias("true_px"), F.count_if(pos).alias("positive_px"),
        (F.sum(F.when(~pos, F.col("area_um2"))) / lit(UM2_PER_CM2)).alias("negative_cm2"),
        (F.coalesce(F.sum(F.when(acc & ~pos, F.col("area_um2"))), lit(0)) / lit(UM2_PER_CM2)).alias("fp_cm2"),
    )
    hits = cut_lineage(long.where(acc & ~pos).select("policy", "y", "x", "area_um2"))  # the hits alone, read twice
    clipped = components(hits, tile=chunk, by=["policy"], clip=True)
    kept = (
        component_areas(clipped.join(hits, ["policy", "y", "x"]), ["policy"], "area_um2")
        .where(F.col("area") >= lit(min_mm2 * UM2_PER_MM2))
        .groupBy("policy").agg(F.count(F.lit(1)).alias("components"))
    )
    return base.join(kept, "policy", "left").select(
        "policy", "pixels", "accepted_px", "true_px",
        F.try_divide("true_px", "accepted_px").alias("precision"),
        F.try_divide("true_px", "positive_px").alias("recall"),
        F.try_divide("fp_cm2", "negative_cm2").alias("fp_fraction"),
        F.coalesce("components", F.lit(0)).alias("components"),
        F.try_divide(F.coalesce("components", F.lit(0)), F.col("negative_cm2")).alias("components_per_cm2"),
    )
