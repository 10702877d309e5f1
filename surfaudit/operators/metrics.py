"""Ranking and agreement metrics as one collapsed table plus distributed prefix sums.

Every metric first reduces pixels to one row per (group, score) with counts, which the
map side does partially, so equal scores form one threshold and a hot score is one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from surfaudit.functions.scalar import fuse, lit
from surfaudit.operators.prefix import (
    exact_quantiles,
    join_by,
    prefix_sum,
    quantile_column,
    value_ranks,
)
from surfaudit.session import cut_lineage


def score_counts(
    df: DataFrame, label: str, score: str, by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """(by, score, n, pos); a weight repeats a row that many times."""
    w = F.col(weight) if weight else F.lit(1).cast("bigint")
    s = F.col(score).cast("double")
    return (
        df.where(s.isNotNull() & ~F.isnan(s) & F.col(label).isNotNull())
        .groupBy(*by, s.alias("score"))
        .agg(F.sum(w).alias("n"), F.sum(F.when(F.col(label), w).otherwise(0)).alias("pos"))
    )


def rank_curve(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cumulative n and pos from the highest score down, read at the end of each tie group."""
    return prefix_sum(counts, "score", ["n", "pos"], by, descending=True)


def rank_metrics(counts: DataFrame, by: Sequence[str] = (), both_classes: bool = False) -> DataFrame:
    """Average precision and ROC AUC of collapsed counts, NULL where undefined.

    AP needs one positive (both classes on request); AUC counts ties half and is 0.5 for a
    constant score.
    """
    curve = rank_curve(counts, by)
    n, pos = F.sum("n"), F.sum("pos")
    ap = F.try_divide(F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")), pos)
    above = F.col("cum_n") - F.col("cum_pos") - (F.col("n") - F.col("pos")) / lit(2)
    auc = lit(1) - F.try_divide(F.sum(F.col("pos") * above), pos.cast("double") * (n - pos))
    if both_classes:
        ap = F.when(pos < n, ap)
    return curve.groupBy(*by).agg(n.alias("n"), pos.alias("positives"), ap.alias("ap"), auc.alias("auc"))


def average_precision(
    df: DataFrame, label: str, score: str, by: Sequence[str] = (), both_classes: bool = False
) -> DataFrame:
    out = rank_metrics(score_counts(df, label, score, by), by, both_classes)
    return out.select(*by, "n", "positives", "ap")


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    out = rank_metrics(score_counts(df, label, score, by), by)
    return out.select(*by, "n", "auc", F.greatest(F.col("auc"), lit(1) - F.col("auc")).alias("auc_any"))


def class_margin(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    pos = F.avg(F.when(F.col(label), F.col(score)))
    neg = F.avg(F.when(~F.col(label), F.col(score)))
    return df.groupBy(*by).agg(
        pos.alias("positive_mean"), neg.alias("negative_mean"), (pos - neg).alias("margin")
    )


def unpivot_scores(df: DataFrame, keep: Sequence[str], scores: Sequence[str]) -> DataFrame:
    """Long form (keep, name, score): several score columns share one scan and one shuffle."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(s).alias("name"), F.col(s).cast("double").alias("score")) for s in scores])
    )
    return df.select(*keep, pairs.alias("_p")).select(*keep, "_p.name", "_p.score")


# -- histogram metrics ------------------------------------------------------------------


def histogram_ap(df: DataFrame, label: str, score: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """AP and best F0.5 over equal-width bins, both directions; the maximum is in the last bin.

    ``bins`` rows per group leave the partial aggregate, so the windows below are bounded.
    """
    from pyspark.sql import Window as W

    ends = df.groupBy(*by).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    if by:
        bounded = join_by(df, ends, by)
    else:
        row = ends.select(F.struct("_lo", "_hi").alias("e")).scalar()
        bounded = df.withColumn("_e", row).select("*", "_e._lo", "_e._hi")
    position = F.try_divide((F.col(score) - F.col("_lo")) * lit(bins), F.col("_hi") - F.col("_lo"))
    hist = (
        bounded.where(position.isNotNull())
        .withColumn("bin", F.least(F.floor(position), F.lit(bins - 1)).cast("int"))
        .groupBy(*by, "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(label).alias("pos"))
    )
    both = hist.withColumn("_d", F.explode(F.array(F.lit("high"), F.lit("low")))).select(
        *by,
        F.col("_d").alias("direction"),
        F.when(F.col("_d") == "high", F.lit(bins - 1) - F.col("bin")).otherwise(F.col("bin")).alias("bin"),
        "n",
        "pos",
    )
    group = W.partitionBy(*by, "direction")
    run = group.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    curve = both.select(
        *by, "direction", "bin", "pos",
        F.sum("n").over(run).alias("cn"),
        F.sum("pos").over(run).alias("cp"),
        F.sum("pos").over(group).alias("tp"),
    )
    precision = F.col("cp") / F.col("cn")
    recall = F.try_divide(F.col("cp"), F.col("tp"))
    f05 = F.coalesce(
        F.try_divide(lit(1.25) * precision * recall, lit(0.25) * precision + recall), lit(0)
    )
    # Empty bins repeat the previous point, so the first best bin is the first stored one.
    return curve.groupBy(*by, "direction").agg(
        F.try_divide(F.sum(F.col("pos") * precision), F.max("tp")).alias("ap"),
        F.max(F.struct(F.round(f05, 12).alias("f"), (-F.col("bin")).alias("b"))).alias("_best"),
    ).select(
        *by, "direction", "ap",
        F.col("_best.f").alias("best_f05"),
        (-F.col("_best.b")).alias("best_bin"),
    )


# -- review and correlation ------------------------------------------------------------------


def review_metrics(
    regions: DataFrame, score: str, fraction: float, tiebreak: str, by: Sequence[str] = ()
) -> DataFrame:
    """Precision, recall and enrichment of the ranked top ceil(n * fraction) regions.

    Regions need positive and valid pixel counts.  Ranks come from prefix sums over
    (score, count) rows; only the tie group at the cut is ordered by ``tiebreak``.
    """
    by = list(by)
    counts = (
        regions.withColumn("score", F.col(score).cast("double"))
        .groupBy(*by, "score")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("positive_px").alias("p"), F.sum("valid_px").alias("v"))
    )
    curve = prefix_sum(counts, "score", ["n", "p", "v"], by, descending=True)
    take = F.greatest(F.lit(1), F.ceil(F.col("total_n").cast("double") * lit(fraction)))
    curve = curve.withColumn("take", take)
    start = F.col("cum_n") - F.col("n")
    full = curve.groupBy(*by).agg(
        F.max("take").alias("reviewed"),
        F.sum(F.when(F.col("cum_n") <= F.col("take"), F.col("p")).otherwise(0)).alias("p_full"),
        F.sum(F.when(F.col("cum_n") <= F.col("take"), F.col("v")).otherwise(0)).alias("v_full"),
        F.max("total_p").alias("p_all"),
        F.max("total_v").alias("v_all"),
        F.max(F.when((F.col("cum_n") > F.col("take")) & (start < F.col("take")), F.col("score"))).alias("cut"),
        F.max(F.when(start < F.col("take"), F.col("take") - start)).alias("_any"),
        F.max(
            F.when((F.col("cum_n") > F.col("take")) & (start < F.col("take")), F.col("take") - start)
        ).alias("room"),
    )
    tied = regions.withColumn("score", F.col(score).cast("double")).select(
        *by, "score", F.col(tiebreak).cast("double").alias("_tb"), "positive_px", "valid_px"
    )
    at_cut = join_by(tied, full.where("room is not null").select(*by, F.col("cut").alias("score"), "room"), by, on=["score"])
    per = at_cut.groupBy(*by, "_tb", "room").agg(
        F.count(F.lit(1)).alias("n"), F.sum("positive_px").alias("p"), F.sum("valid_px").alias("v")
    )
    inside = prefix_sum(per, "_tb", ["n"], by).where("cum_n <= room")
    part = inside.groupBy(*by).agg(F.sum("p").alias("p_cut"), F.sum("v").alias("v_cut"))
    if by:
        out = join_by(full, part, by, "left")
    else:
        row = part.select(F.struct("p_cut", "v_cut").alias("c")).scalar()
        out = full.withColumn("_c", row).select("*", "_c.p_cut", "_c.v_cut")
    p = F.col("p_full") + F.coalesce("p_cut", F.lit(0))
    v = F.col("v_full") + F.coalesce("v_cut", F.lit(0))
    precision = F.coalesce(F.try_divide(p, v), lit(0))
    return out.select(
        *by,
        "reviewed",
        F.coalesce(F.try_divide(p, F.col("p_all")), lit(0)).alias("recall"),
        precision.alias("precision"),
        F.coalesce(F.try_divide(precision, F.try_divide(F.col("p_all"), F.col("v_all"))), lit(0)).alias("enrichment"),
    )


def _pearson(n: Column, sa: Column, sb: Column, saa: Column, sbb: Column, sab: Column) -> Column:
    va, vb = saa - sa * sa / n, sbb - sb * sb / n
    varied = (n > 1) & (va > lit(1e-12) * saa) & (vb > lit(1e-12) * sbb)
    return F.when(varied, F.try_divide(sab - sa * sb / n, F.sqrt(F.abs(va)) * F.sqrt(F.abs(vb))))


def pearson(df: DataFrame, a: str, b: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Pearson r from sums in one pass, NULL for a constant input."""
    w = F.col(weight).cast("double") if weight else lit(1)
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    sums = df.where(x.isNotNull() & y.isNotNull()).groupBy(*by).agg(
        F.sum(w).alias("n"), F.sum(w * x).alias("sa"), F.sum(w * y).alias("sb"),
        F.sum(w * x * x).alias("saa"), F.sum(w * y * y).alias("sbb"), F.sum(w * x * y).alias("sab"),
    )
    return sums.select(
        *by, F.col("n").cast("bigint").alias("n"),
        _pearson(*[F.col(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")]).alias("pearson"),
    )


def _counted(df: DataFrame, *cols: str) -> DataFrame:
    """Rows collapsed to (cols, w), combined on the map side, and kept for several readers."""
    return cut_lineage(df.groupBy(*cols).agg(F.count(F.lit(1)).alias("w")))


def correlations(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pearson and Spearman.  Pairs collapse to counts of (a, b) before anything is kept."""
    counts = _counted(pairs, a, b)
    distinct = counts.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ra = value_ranks(counts, a, weight="w").select(a, F.col("avg_rank").alias("ra"))
    rb = value_ranks(counts, b, weight="w").select(b, F.col("avg_rank").alias("rb"))
    ranked = distinct.join(ra, a).join(rb, b)
    rho = pearson(ranked, "ra", "rb", weight="w").select(F.col("pearson").alias("spearman"))
    return pearson(distinct, a, b, weight="w").withColumn("spearman", rho.scalar())


def top_overlap(pairs: DataFrame, quantile: float, a: str = "a", b: str = "b") -> DataFrame:
    """Intersection, Jaccard and enrichment of the top quantile of both maps."""
    counts = _counted(pairs, a, b)
    ta, tb = quantile_column(counts, a, 1 - quantile, "w"), quantile_column(counts, b, 1 - quantile, "w")
    flags = counts.withColumn("_ta", ta).withColumn("_tb", tb).withColumn(
        "_a", F.col(a) >= F.col("_ta")
    ).withColumn("_b", F.col(b) >= F.col("_tb"))
    weight = lambda c: F.coalesce(F.sum(F.when(c, F.col("w"))), F.lit(0))
    both, either = weight(F.col("_a") & F.col("_b")), weight(F.col("_a") | F.col("_b"))
    share = F.try_divide(both, F.sum("w"))
    return flags.agg(
        F.max("_ta").alias("threshold_a"),
        F.max("_tb").alias("threshold_b"),
        both.alias("intersection"),
        F.coalesce(F.try_divide(both, either), lit(0)).alias("jaccard"),
        (share / lit(quantile * quantile)).alias("enrichment"),
    )


# -- disagreement and abstention --------------------------------------------------------------


def with_fusion(df: DataFrame, s0: str = "s0", s1: str = "s1") -> DataFrame:
    a, b = F.col(s0), F.col(s1)
    return df.withColumn("fused", fuse(a, b, "mean")).withColumn("disagreement", fuse(a, b, "disagreement"))


def disagreement_summary(df: DataFrame, label: str = "positive") -> DataFrame:
    """AP of +/- disagreement, its correlation with the label and class means."""
    d = _counted(with_fusion(df), label, "disagreement")
    long = d.select(
        label,
        "w",
        F.explode(
            F.array(
                F.struct(F.lit("high").alias("name"), F.col("disagreement").alias("score")),
                F.struct(F.lit("low").alias("name"), (-F.col("disagreement")).alias("score")),
            )
        ).alias("p"),
    ).select(label, "w", "p.*")
    ap = rank_metrics(score_counts(long, label, "score", ["name"], "w"), ["name"]).agg(
        F.struct(
            F.max(F.when(F.col("name") == "high", F.col("ap"))).alias("high"),
            F.max(F.when(F.col("name") == "low", F.col("ap"))).alias("low"),
        ).alias("ap")
    )
    r = pearson(d.withColumn("_y", F.col(label).cast("double")), "disagreement", "_y", weight="w").select("pearson")
    mean = lambda value, on: F.try_divide(
        F.sum(F.when(on & value.isNotNull(), value * F.col("w"))), F.sum(F.when(on & value.isNotNull(), F.col("w")))
    )
    means = d.agg(
        mean(F.col("disagreement"), F.col(label)).alias("positive_mean"), mean(F.col("disagreement"), ~F.col(label)).alias("negative_mean")
    )
    base = d.agg(F.sum("w").alias("pixels"), mean(F.col(label).cast("double"), F.lit(True)).alias("prevalence"))
    return (
        base.withColumn("_ap", ap.scalar())
        .withColumn("label_pearson", r.scalar())
        .withColumn("_m", means.select(F.struct("*").alias("m")).scalar())
        .select(
            "pixels", "prevalence", F.col("_ap.high").alias("ap_high"), F.col("_ap.low").alias("ap_low"),
            "label_pearson", F.col("_m.positive_mean").alias("mean_positive"),
            F.col("_m.negative_mean").alias("mean_negative"),
        )
    )


def disagreement_bins(df: DataFrame, bins: int, label: str = "positive") -> DataFrame:
    """Quantile-bin table: left-closed bins, the last closed on both sides, empty bins kept."""
    d = _counted(with_fusion(df), label, "fused", "disagreement")
    qs = {f"e{i}": i / bins for i in range(bins + 1)}
    edges = exact_quantiles(d, "disagreement", qs, weight="w").select(F.array(*qs).alias("e")).scalar()
    # One pass: the edges are a single-row subquery, a pixel belongs to the bins that hold it.
    placed = d.withColumn("_e", edges).withColumn(
        "bin",
        F.when(
            F.col("disagreement") >= F.get("_e", F.lit(bins - 1)), F.lit(bins - 1)
        ).otherwise(F.size(F.filter("_e", lambda e: e <= F.col("disagreement"))) - 1),
    )
    stats = placed.groupBy("bin").agg(
        F.sum("w").alias("pixels"),
        F.try_divide(F.sum(F.col(label).cast("double") * F.col("w")), F.sum(F.when(F.col(label).isNotNull(), F.col("w")))).alias("prevalence"),
        F.try_divide(F.sum(F.col("fused") * F.col("w")), F.sum(F.when(F.col("fused").isNotNull(), F.col("w")))).alias("mean_score"),
    )
    frame = (
        df.sparkSession.range(1)
        .select(edges.alias("_e"))
        .select("_e", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
        .select("bin", F.get("_e", F.col("bin")).alias("lower"), F.get("_e", F.col("bin") + 1).alias("upper"))
    )
    return frame.join(stats, "bin", "left").fillna(0, ["pixels"])


def retained(df: DataFrame, fraction: float) -> DataFrame:
    """Pixels kept after abstaining on the given share of highest disagreement."""
    d = with_fusion(df)
    cut = quantile_column(d, "disagreement", 1 - fraction)
    return d.withColumn("_cut", cut).where(F.col("disagreement") <= F.col("_cut"))


def abstain(df: DataFrame, fraction: float, label: str = "positive") -> DataFrame:
    """AP of the fused score before and after abstention, from one scan of the pixels."""
    d = _counted(with_fusion(df), label, "fused", "disagreement")
    cut = quantile_column(d, "disagreement", 1 - fraction, "w")
    tagged = d.withColumn("_cut", cut).select(
        label, "fused", "w",
        F.explode(
            F.when(F.col("disagreement") <= F.col("_cut"), F.array(F.lit("all"), F.lit("kept"))).otherwise(
                F.array(F.lit("all"))
            )
        ).alias("part"),
    )
    ap = rank_metrics(score_counts(tagged, label, "fused", ["part"], "w"), ["part"])
    pick = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
    return ap.agg(
        pick("all", "n").alias("pixels"), pick("kept", "n").alias("kept_pixels"),
        pick("all", "ap").alias("ap"), pick("kept", "ap").alias("kept_ap"),
        (pick("kept", "ap") - pick("all", "ap")).alias("gain"),
    )


def control_margin(df: DataFrame, chunk: Sequence[str], label: str, score: str) -> DataFrame:
    """Mean score on positives minus mean score of chunks without any positive.

    Chunk sums first, so no pixel is joined back to its chunk flag.
    """
    per = df.groupBy(*chunk).agg(
        F.count(F.lit(1)).alias("n"), F.sum(score).alias("s"),
        F.count_if(label).alias("np"), F.sum(F.when(F.col(label), F.col(score))).alias("sp"),
    )
    empty = F.col("np") == 0
    control = F.try_divide(F.sum(F.when(empty, F.col("s"))), F.sum(F.when(empty, F.col("n"))))
    positive = F.try_divide(F.sum("sp"), F.sum("np"))
    return per.agg(
        F.count_if(empty).alias("control_chunks"), positive.alias("positive_mean"),
        control.alias("control_mean"), (positive - control).alias("margin"),
    )


def baseline_table(df: DataFrame, label: str, scores: Sequence[str]) -> DataFrame:
    """AP and class means per score column, best AP flagged."""
    counts = cut_lineage(score_counts(unpivot_scores(df, [label], scores), label, "score", ["name"]))
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    mean = lambda w: F.try_divide(F.sum(F.when(w > 0, F.col("score") * w)), F.sum(w))
    margins = counts.groupBy("name").agg(mean(pos).alias("positive_mean"), mean(neg).alias("negative_mean"))
    margins = margins.withColumn("margin", F.col("positive_mean") - F.col("negative_mean"))
    ap = cut_lineage(rank_metrics(counts, ["name"]))  # one row per score
    out = ap.join(margins, "name")
    best = ap.agg(F.max_by("name", F.struct(F.round("ap", 12), F.col("name")))).scalar()
    return out.withColumn("_best", best).select(
        "name", "ap", "positive_mean", "negative_mean", "margin", (F.col("name") == F.col("_best")).alias("best")
    )


def regional_gain(
    df: DataFrame, chunk: Sequence[str], label: str, model: str, baselines: Sequence[str]
) -> DataFrame:
    """Per-chunk AP of the model minus that of the best baseline overall, both-class chunks only."""
    long = unpivot_scores(df, [*chunk, label], [model, *baselines])
    counts = cut_lineage(score_counts(long, label, "score", [*chunk, "name"]))
    whole = counts.where(F.col("name") != model).groupBy("name", "score").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    overall = rank_metrics(whole, ["name"])
    best = overall.agg(F.max_by("name", F.struct(F.round("ap", 12), F.col("name")))).scalar()
    per = rank_metrics(counts, [*chunk, "name"], both_classes=True)
    per = per.withColumn("_best", best)
    return (
        per.groupBy(*chunk)
        .agg(
            F.max(F.when(F.col("name") == model, F.col("ap"))).alias("model_ap"),
            F.max(F.when(F.col("name") == F.col("_best"), F.col("ap"))).alias("baseline_ap"),
        )
        .where("model_ap is not null and baseline_ap is not null")
        .withColumn("gain", F.col("model_ap") - F.col("baseline_ap"))
    )


def feature_audit(
    df: DataFrame, label: str, features: Sequence[str], block: Sequence[str]
) -> DataFrame:
    """Features ranked by direction-free AUC, with medians, standardised and block differences."""
    long = unpivot_scores(cut_lineage(df.select(label, *block, *features)), [label, *block], features)
    auc = roc_auc(long, label, "score", ["name"])
    medians = exact_quantiles(long, "score", {"med": 0.5}, ["name", label]).groupBy("name").agg(
        F.max(F.when(F.col(label), F.col("med"))).alias("positive_median"),
        F.max(F.when(~F.col(label), F.col("med"))).alias("negative_median"),
    )
    s = F.col("score")
    on = lambda f: (f(F.when(F.col(label), s)), f(F.when(~F.col(label), s)))
    (mp, mn), (vp, vn) = on(F.avg), on(F.var_pop)
    moments = long.groupBy("name").agg(
        mp.alias("mp"), mn.alias("mn"), F.sqrt((vp + vn) / lit(2)).alias("pooled")
    )
    blocks = (
        long.groupBy("name", *block)
        .agg(on(F.avg)[0].alias("bp"), on(F.avg)[1].alias("bn"))
        .groupBy("name")
        .agg(F.avg(F.col("bp") - F.col("bn")).alias("block_difference"))
    )
    return (
        auc.join(medians, "name").join(moments, "name").join(blocks, "name")
        .select(
            "name", "auc", F.col("auc_any"),
            F.when(F.col("auc") >= 0.5, "high").otherwise("low").alias("direction"),
            "positive_median", "negative_median",
            F.coalesce(F.try_divide(F.col("mp") - F.col("mn"), F.col("pooled")), lit(0)).alias("standardized_difference"),
            "block_difference",
        )
    )


def score_ablation(
    regions: DataFrame, label: str, scores: Sequence[str], baseline: str, fraction: float, tiebreak: str
) -> DataFrame:
    """AP and review enrichment per score column, and their change against the baseline."""
    keep = [label, "positive_px", "valid_px", tiebreak]
    long = unpivot_scores(regions, keep, scores)
    ap = average_precision(long, label, "score", ["name"]).select("name", "ap")
    review = review_metrics(long, "score", fraction, tiebreak, ["name"])
    both = cut_lineage(ap.join(review, "name"))  # one row per score
    base = both.where(F.col("name") == baseline).select(F.struct("ap", "enrichment").alias("b")).scalar()
    best = both.agg(F.max_by("name", F.struct(F.round("ap", 12), F.col("name")))).scalar()
    return both.withColumn("_b", base).withColumn("_best", best).select(
        "name", "ap", (F.col("ap") - F.col("_b.ap")).alias("delta_ap"), "enrichment",
        (F.col("enrichment") - F.col("_b.enrichment")).alias("delta_enrichment"),
        (F.col("name") == F.col("_best")).alias("best"),
    )
