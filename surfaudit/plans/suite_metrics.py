"""Ranking, agreement, abstention and policy queries over labelled pixels."""

from pyspark.sql import functions as F

from surfaudit.operators import metrics as m, prefix
from surfaudit.plans import bindings as b
from surfaudit.plans.registry import register
from surfaudit.plans.suite_regions import REGIONS, regions
from surfaudit.session import cut_lineage

S = b.SCORED_ALL


def ap_sql(source: str, by: str = "", score: str = "score", out: str = "ap") -> str:
    """SQL twin of the collapsed AP / AUC: tie groups, descending running sums."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""{out}_c AS (SELECT {keys}{score} AS s, count(*) AS n, sum(CASE WHEN positive THEN 1 ELSE 0 END) AS pos
    FROM {source} WHERE {score} IS NOT NULL GROUP BY {keys}{score}),
{out}_r AS (SELECT {keys}s, n, pos, sum(n) OVER ({part}ORDER BY s DESC) AS cn, sum(pos) OVER ({part}ORDER BY s DESC) AS cp FROM {out}_c),
{out} AS (SELECT {keys}sum(n) AS n, sum(pos) AS positives,
    sum(pos * cp / cast(cn AS DOUBLE)) / nullif(sum(pos), 0) AS ap,
    1 - sum(pos * ((cn - cp) - (n - pos) / cast(2 AS DOUBLE))) / nullif(cast(sum(pos) AS DOUBLE) * (sum(n) - sum(pos)), 0) AS auc
    FROM {out}_r {group})"""


@register("d26_average_precision", "n:i positives:i ap:d9",
          f"WITH {S}, {ap_sql('scored', score='s0')} SELECT n, positives, ap FROM ap")
def d26(spark, sf):
    return m.average_precision(b.scored(spark, sf), "positive", "s0")


@register("d26_average_precision_by_chunk", "cy:i cx:i n:i positives:i ap:d9",
          f"WITH {S}, {ap_sql('scored', 'cy, cx', 's0')} SELECT cy, cx, n, positives, CASE WHEN positives < n THEN ap END AS ap FROM ap")
def d26_by(spark, sf):
    return m.average_precision(b.scored(spark, sf), "positive", "s0", ["cy", "cx"], both_classes=True)


@register("d26_average_precision_continuous", "n:i positives:i ap:d9",
          f"""WITH p AS (SELECT o_orderstatus = 'F' AS positive, o_totalprice AS score FROM orders),
{ap_sql('p')} SELECT n, positives, ap FROM ap""")
def d26_continuous(spark, sf):
    px = b.table(spark, sf, "orders").select((F.col("o_orderstatus") == "F").alias("positive"), "o_totalprice")
    return m.average_precision(px, "positive", "o_totalprice")


@register("d26_average_precision_null_group", "g:i n:i positives:i ap:d9",
          f"""WITH {S}, px AS (SELECT CASE WHEN y % 3 <> 0 THEN y % 3 ELSE -1 END AS g, positive, s0 FROM scored), {ap_sql('px', 'g', 's0')}
SELECT nullif(g, -1) AS g, n, positives, ap FROM ap""")
def d26_null(spark, sf):
    px = b.scored(spark, sf).withColumn("g", F.when(F.col("y") % 3 != 0, F.col("y") % 3))
    return m.average_precision(px, "positive", "s0", ["g"])


@register("d27_class_margin", "positive_mean:d negative_mean:d margin:d",
          f"""WITH {S} SELECT avg(s0) FILTER (WHERE positive) AS positive_mean, avg(s0) FILTER (WHERE NOT positive) AS negative_mean,
avg(s0) FILTER (WHERE positive) - avg(s0) FILTER (WHERE NOT positive) AS margin FROM scored""")
def d27(spark, sf):
    return m.class_margin(b.scored(spark, sf), "positive", "s0")


@register("d28_roc_auc", "cy:i cx:i n:i auc:d9 auc_any:d9",
          f"WITH {S}, {ap_sql('scored', 'cy, cx', 's0')} SELECT cy, cx, n, auc, greatest(auc, 1 - auc) AS auc_any FROM ap")
def d28(spark, sf):
    return m.roc_auc(b.scored(spark, sf), "positive", "s0", ["cy", "cx"])


@register("d29_histogram_ap", "direction:s ap:d9 best_f05:d9 best_bin:i",
          """WITH p AS (SELECT o_orderstatus = 'F' AS positive, o_totalprice AS s, min(o_totalprice) OVER () AS lo, max(o_totalprice) OVER () AS hi FROM orders),
h AS (SELECT cast(least(floor((s - lo) * 256 / (hi - lo)), 255) AS BIGINT) AS bin, count(*) AS n, sum(CASE WHEN positive THEN 1 ELSE 0 END) AS pos FROM p GROUP BY 1),
d AS (SELECT 'high' AS direction, 255 - bin AS bin, n, pos FROM h UNION ALL SELECT 'low', bin, n, pos FROM h),
c AS (SELECT direction, bin, pos, sum(n) OVER w AS cn, sum(pos) OVER w AS cp, sum(pos) OVER (PARTITION BY direction) AS tp
  FROM d WINDOW w AS (PARTITION BY direction ORDER BY bin)),
f AS (SELECT *, cp / cast(cn AS DOUBLE) AS pr, cp / cast(tp AS DOUBLE) AS re FROM c),
g AS (SELECT *, CASE WHEN pr + re > 0 THEN round(cast(1.25 AS DOUBLE) * pr * re / (cast(0.25 AS DOUBLE) * pr + re), 12) ELSE 0 END AS f05 FROM f)
SELECT direction, sum(pos * pr) / max(tp) AS ap, max(f05) AS best_f05, min(bin) FILTER (WHERE f05 = mx) AS best_bin
FROM (SELECT *, max(f05) OVER (PARTITION BY direction) AS mx FROM g) GROUP BY direction""")
def d29(spark, sf):
    px = b.table(spark, sf, "orders").select((F.col("o_orderstatus") == "F").alias("positive"), "o_totalprice")
    return m.histogram_ap(px, "positive", "o_totalprice", 256)


def ranked_regions(spark, sf):
    # The region table is read many times and is far smaller than the pixels behind it.
    rows = regions(spark, sf).where("eligible").withColumn("ord", F.col("y0") * 100000 + F.col("x0"))
    return cut_lineage(rows)


def review_sql(score: str) -> str:
    return f"""SELECT reviewed, rp / cast(ap AS DOUBLE) AS recall, rp / cast(nullif(rv, 0) AS DOUBLE) AS precision,
  (rp / cast(nullif(rv, 0) AS DOUBLE)) / (ap / cast(av AS DOUBLE)) AS enrichment
FROM (SELECT max(k) AS reviewed, sum(CASE WHEN rn <= k THEN positive_px ELSE 0 END) AS rp,
       sum(CASE WHEN rn <= k THEN valid_px ELSE 0 END) AS rv, sum(positive_px) AS ap, sum(valid_px) AS av
  FROM (SELECT *, row_number() OVER (ORDER BY {score} DESC, y0, x0) AS rn,
       greatest(1, ceil(count(*) OVER () * cast(0.1 AS DOUBLE))) AS k FROM regions WHERE eligible))"""


@register("d30_review_metrics", "reviewed:i recall:d precision:d enrichment:d",
          f"WITH {REGIONS} {review_sql('mean')}")
def d30(spark, sf):
    return m.review_metrics(ranked_regions(spark, sf), "mean", 0.1, "ord")


@register("d31_correlations", "n:i pearson:d9 spearman:d9",
          f"""WITH {b.CELLS}, {b.TWO_VIEWS},
r AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / cast(2 AS DOUBLE) AS ra,
             rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / cast(2 AS DOUBLE) AS rb FROM two)
SELECT count(*) AS n, corr(a, b) AS pearson, corr(ra, rb) AS spearman FROM r""")
def d31(spark, sf):
    return m.correlations(b.two_views(spark, sf))


@register("d32_top_overlap", "threshold_a:d threshold_b:d intersection:i jaccard:d enrichment:d",
          f"""WITH {b.CELLS}, {b.TWO_VIEWS},
t AS (SELECT quantile_cont(a, 0.9) AS ta, quantile_cont(b, 0.9) AS tb FROM two)
SELECT max(ta) AS threshold_a, max(tb) AS threshold_b, count(*) FILTER (WHERE a >= ta AND b >= tb) AS intersection,
  count(*) FILTER (WHERE a >= ta AND b >= tb) / cast(count(*) FILTER (WHERE a >= ta OR b >= tb) AS DOUBLE) AS jaccard,
  count(*) FILTER (WHERE a >= ta AND b >= tb) / cast(count(*) AS DOUBLE) / cast(0.01 AS DOUBLE) AS enrichment
FROM two, t""")
def d32(spark, sf):
    return m.top_overlap(b.two_views(spark, sf), 0.1)


DIS = "dis AS (SELECT *, (s0 + s1) / 2 AS fused, abs(s0 - s1) AS d, -abs(s0 - s1) AS nd FROM scored)"


@register("d33_disagreement_summary",
          "pixels:i prevalence:d ap_high:d9 ap_low:d9 label_pearson:d9 mean_positive:d mean_negative:d",
          f"""WITH {S}, {DIS}, {ap_sql('dis', score='d', out='hi')}, {ap_sql('dis', score='nd', out='lo')}
SELECT count(*) AS pixels, avg(CASE WHEN positive THEN 1.0 ELSE 0.0 END) AS prevalence, (SELECT ap FROM hi) AS ap_high,
 (SELECT ap FROM lo) AS ap_low, corr(d, CASE WHEN positive THEN 1.0 ELSE 0.0 END) AS label_pearson,
 avg(d) FILTER (WHERE positive) AS mean_positive, avg(d) FILTER (WHERE NOT positive) AS mean_negative FROM dis""")
def d33(spark, sf):
    return m.disagreement_summary(b.scored(spark, sf))


# Each disagreement is |a/10 - b/10| of two decimals; edges are compared after rounding so
# that equal decimals are equal doubles in both engines.
@register("d33_disagreement_bins", "bin:i lower:d upper:d pixels:i prevalence:d mean_score:d",
          f"""WITH {b.CELLS}, {b.TWO_VIEWS}, {b.TRUTH}, scored AS (
  SELECT t.*, round(p.a * 100) AS s0, round(p.b * 100) AS s1 FROM truth t JOIN two p ON t.y = p.y AND t.x = p.x WHERE t.valid),
{DIS},
i AS (SELECT unnest(range(10)) AS bin),
e AS (SELECT bin, (SELECT quantile_cont(d, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) FROM dis) AS q FROM i),
k AS (SELECT bin, q[bin + 1] AS lower, q[bin + 2] AS upper FROM e)
SELECT k.bin, k.lower, k.upper, count(d) AS pixels, avg(CASE WHEN d IS NULL THEN NULL WHEN positive THEN 1.0 ELSE 0.0 END) AS prevalence,
       avg(fused) AS mean_score
FROM k LEFT JOIN dis ON d >= k.lower AND (d < k.upper OR (k.bin = 9 AND d <= k.upper)) GROUP BY k.bin, k.lower, k.upper""")
def d33_bins(spark, sf):
    px = b.scored(spark, sf).withColumn("s0", F.round(F.col("s0") * 100)).withColumn("s1", F.round(F.col("s1") * 100))
    return m.disagreement_bins(px, 10)


@register("d34_abstain", "pixels:i kept_pixels:i ap:d9 kept_ap:d9 gain:d9",
          f"""WITH {S}, {DIS}, kept AS (SELECT * FROM dis WHERE d <= (SELECT quantile_cont(d, 0.8) FROM dis)),
{ap_sql('dis', score='fused', out='al')}, {ap_sql('kept', score='fused', out='ke')}
SELECT al.n AS pixels, ke.n AS kept_pixels, al.ap AS ap, ke.ap AS kept_ap, ke.ap - al.ap AS gain FROM al, ke""")
def d34(spark, sf):
    return m.abstain(b.scored(spark, sf), 0.2)


@register("d35_control_margin", "control_chunks:i positive_mean:d control_mean:d margin:d",
          f"""WITH {S}, c AS (SELECT floor(y / 4.0) AS ky, floor(x / 4.0) AS kx, count(*) AS n, sum(s0) AS s,
  sum(CASE WHEN positive THEN 1 ELSE 0 END) AS np, sum(CASE WHEN positive THEN s0 ELSE 0 END) AS sp FROM scored GROUP BY 1, 2)
SELECT count(*) FILTER (WHERE np = 0) AS control_chunks, sum(sp) / sum(np) AS positive_mean,
 sum(s) FILTER (WHERE np = 0) / sum(n) FILTER (WHERE np = 0) AS control_mean,
 sum(sp) / sum(np) - sum(s) FILTER (WHERE np = 0) / sum(n) FILTER (WHERE np = 0) AS margin FROM c""")
def d35(spark, sf):
    px = b.scored(spark, sf).withColumn("ky", F.floor(F.col("y") / 4)).withColumn("kx", F.floor(F.col("x") / 4))
    return m.control_margin(px, ["ky", "kx"], "positive", "s0")


def raw_scores(spark, sf):
    """Scored pixels with raw depth baselines beside the models."""
    from surfaudit.operators.depth import depth_features

    raw = depth_features(b.voxels(spark, sf), 2, 5).select("y", "x", "depth_std", "depth_max")
    central = b.voxels(spark, sf).where("z = 3").select("y", "x", F.col("v").alias("central_slice"))
    px = b.scored(spark, sf).withColumn("fused", (F.col("s0") + F.col("s1")) / 2)
    return px.join(raw, ["y", "x"]).join(central, ["y", "x"], "left").fillna(0, ["central_slice"])


RAW = f"""{S}, {b.VOXELS},
raw AS (SELECT y, x, stddev_pop(v) AS depth_std, max(v) AS depth_max,
        coalesce(max(CASE WHEN z = 3 THEN v END), 0) AS central_slice FROM voxels GROUP BY y, x),
rs AS (SELECT s.*, (s0 + s1) / 2 AS fused, round(depth_std, 9) AS depth_std, cast(depth_max AS DOUBLE) AS depth_max,
       cast(central_slice AS DOUBLE) AS central_slice FROM scored s JOIN raw r ON s.y = r.y AND s.x = r.x),
long AS (SELECT cy, cx, positive, 'fused' AS name, fused AS score FROM rs UNION ALL SELECT cy, cx, positive, 'depth_std', depth_std FROM rs
   UNION ALL SELECT cy, cx, positive, 'depth_max', depth_max FROM rs UNION ALL SELECT cy, cx, positive, 'central_slice', central_slice FROM rs)"""
RAW_NAMES = ["depth_std", "depth_max", "central_slice"]


@register("d36_regional_gain", "cy:i cx:i model_ap:d9 baseline_ap:d9 gain:d9",
          f"""WITH {RAW}, {ap_sql('long', 'name', out='o')}, {ap_sql('long', 'cy, cx, name', out='c')},
best AS (SELECT name FROM o WHERE name <> 'fused' ORDER BY round(ap, 12) DESC, name DESC LIMIT 1)
SELECT f.cy, f.cx, f.ap AS model_ap, g.ap AS baseline_ap, f.ap - g.ap AS gain FROM c f JOIN c g ON f.cy = g.cy AND f.cx = g.cx
WHERE f.name = 'fused' AND g.name = (SELECT name FROM best) AND f.positives > 0 AND f.positives < f.n""")
def d36(spark, sf):
    px = raw_scores(spark, sf).withColumn("depth_std", F.round("depth_std", 9))
    return m.regional_gain(px, ["cy", "cx"], "positive", "fused", RAW_NAMES)


@register("d37_baseline_table", "name:s ap:d9 positive_mean:d negative_mean:d margin:d best:b",
          f"""WITH {RAW}, {ap_sql('long', 'name', out='o')},
mm AS (SELECT name, avg(score) FILTER (WHERE positive) AS pm, avg(score) FILTER (WHERE NOT positive) AS nm FROM long GROUP BY name)
SELECT o.name, o.ap, pm AS positive_mean, nm AS negative_mean, pm - nm AS margin,
  o.name = (SELECT name FROM o ORDER BY round(ap, 12) DESC, name DESC LIMIT 1) AS best FROM o JOIN mm ON o.name = mm.name""")
def d37(spark, sf):
    px = raw_scores(spark, sf).withColumn("depth_std", F.round("depth_std", 9))
    return m.baseline_table(px, "positive", ["fused", *RAW_NAMES])


@register("d38_feature_audit",
          "name:s auc:d9 auc_any:d9 direction:s positive_median:d negative_median:d standardized_difference:d block_difference:d",
          f"""WITH {RAW}, {ap_sql('long', 'name', out='o')},
mm AS (SELECT name, median(score) FILTER (WHERE positive) AS pmed, median(score) FILTER (WHERE NOT positive) AS nmed,
  (avg(score) FILTER (WHERE positive) - avg(score) FILTER (WHERE NOT positive))
   / sqrt((var_pop(score) FILTER (WHERE positive) + var_pop(score) FILTER (WHERE NOT positive)) / 2) AS sd FROM long GROUP BY name),
bb AS (SELECT name, avg(p - q) AS bd FROM (SELECT name, cy, cx, avg(score) FILTER (WHERE positive) AS p, avg(score) FILTER (WHERE NOT positive) AS q
   FROM long GROUP BY name, cy, cx) GROUP BY name)
SELECT o.name, auc, greatest(auc, 1 - auc) AS auc_any, CASE WHEN auc >= 0.5 THEN 'high' ELSE 'low' END AS direction,
 pmed AS positive_median, nmed AS negative_median, sd AS standardized_difference, bd AS block_difference
FROM o JOIN mm ON o.name = mm.name JOIN bb ON o.name = bb.name""")
def d38(spark, sf):
    px = raw_scores(spark, sf).withColumn("depth_std", F.round("depth_std", 9))
    return m.feature_audit(px, "positive", ["fused", *RAW_NAMES], ["cy", "cx"])


ABLATION_SCORES = ["mean", "p95", "max", "positive_fraction"]


def _ablation_sql():
    rows = " UNION ALL ".join(
        f"""SELECT '{s}' AS name, y0, x0, positive_px, valid_px, positive_px >= 100 AS positive, "{s}" AS score FROM regions WHERE eligible"""
        for s in ABLATION_SCORES)
    return f"""WITH {REGIONS}, long AS ({rows}), {ap_sql('long', 'name', out='o')},
rv AS (SELECT name, sum(CASE WHEN rn <= k THEN positive_px ELSE 0 END) / cast(sum(CASE WHEN rn <= k THEN valid_px ELSE 0 END) AS DOUBLE)
      / (sum(positive_px) / cast(sum(valid_px) AS DOUBLE)) AS enrichment
  FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, y0, x0) AS rn,
     greatest(1, ceil(count(*) OVER (PARTITION BY name) * cast(0.1 AS DOUBLE))) AS k FROM long) GROUP BY name),
j AS (SELECT o.name, o.ap, rv.enrichment FROM o JOIN rv ON o.name = rv.name)
SELECT name, ap, ap - (SELECT ap FROM j WHERE name = 'mean') AS delta_ap, enrichment,
  enrichment - (SELECT enrichment FROM j WHERE name = 'mean') AS delta_enrichment,
  name = (SELECT name FROM j ORDER BY round(ap, 12) DESC, name DESC LIMIT 1) AS best FROM j"""


@register("d41_score_ablation", "name:s ap:d9 delta_ap:d9 enrichment:d delta_enrichment:d best:b", _ablation_sql())
def d41(spark, sf):
    rows = ranked_regions(spark, sf).withColumn("label", F.col("positive_px") >= 100)
    return m.score_ablation(rows, "label", ABLATION_SCORES, "mean", 0.1, "ord")


@register("e01_prefix_sum", "score:d n:i pos:i cum_n:i cum_pos:i",
          """SELECT score, n, pos, sum(n) OVER (ORDER BY score DESC) AS cum_n, sum(pos) OVER (ORDER BY score DESC) AS cum_pos
FROM (SELECT o_totalprice AS score, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS pos FROM orders GROUP BY 1)""")
def e01(spark, sf):
    px = b.table(spark, sf, "orders").select((F.col("o_orderstatus") == "F").alias("positive"), "o_totalprice")
    return m.rank_curve(m.score_counts(px, "positive", "o_totalprice"))


@register("e03_average_rank", "score:d n:i avg_rank:d",
          f"""WITH {b.CELLS} SELECT DISTINCT score, count(*) OVER (PARTITION BY score) AS n,
rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / cast(2 AS DOUBLE) AS avg_rank FROM cells""")
def e03(spark, sf):
    return prefix.value_ranks(b.cells(spark, sf), "score")
