"""Region, mask and ledger queries."""

from pyspark.sql import functions as F

from surfaudit.operators import prefix, regions as rg
from surfaudit.plans import bindings as b
from surfaudit.plans.registry import register

SIZE = 16


def labelled(spark, sf):
    """Every canvas pixel with its label, mask and two scores (NULL where nothing was read)."""
    per = b.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.max(F.col("l_discount") * 10).alias("score"), F.avg("l_quantity").alias("depth_mean")
    )
    per = per.select(
        F.floor(F.col("l_orderkey") / b.WIDTH).cast("int").alias("y"),
        (F.col("l_orderkey") % b.WIDTH).cast("int").alias("x"), "score", "depth_mean",
    )
    return b.truth(spark, sf).join(per, ["y", "x"], "left").withColumn(
        "valid", F.col("valid") & F.col("score").isNotNull()
    )


LABELLED = f"""{b.TRUTH},
px AS (SELECT t.y, t.x, t.cy, t.cx, t.positive, t.area_um2, t.valid AND p.score IS NOT NULL AS valid, p.score, p.depth_mean
  FROM truth t LEFT JOIN (
    SELECT {b._yx_sql('l_orderkey')}, max(l_discount * 10) AS score, avg(l_quantity) AS depth_mean
    FROM lineitem GROUP BY l_orderkey) p ON t.y = p.y AND t.x = p.x)"""

REGIONS = f"""{LABELLED},
regions AS (
  SELECT 'y' || lpad(cast(ry * 16 AS VARCHAR), 5, '0') || '_x' || lpad(cast(rx * 16 AS VARCHAR), 5, '0') AS region_id,
         ry * 16 AS y0, rx * 16 AS x0, valid_px, positive_px,
         positive_px / cast(nullif(valid_px, 0) AS DOUBLE) AS positive_fraction, mean, p95, p99, mx AS "max",
         valid_px / cast(footprint AS DOUBLE) >= cast(0.5 AS DOUBLE) AS eligible
  FROM (SELECT f.ry, f.rx, footprint, coalesce(valid_px, 0) AS valid_px, coalesce(positive_px, 0) AS positive_px, mean, p95, p99, mx
        FROM (SELECT ry, rx, least(16, h - ry * 16) * least(16, {b.WIDTH} - rx * 16) AS footprint
              FROM (SELECT h, unnest(range((h + 15) // 16)) AS ry FROM (SELECT max(y) + 1 AS h FROM truth)) CROSS JOIN (SELECT unnest(range(({b.WIDTH} + 15) // 16)) AS rx)) AS f
        LEFT JOIN (SELECT cast(floor(y / cast(16 AS DOUBLE)) AS BIGINT) AS ry, cast(floor(x / cast(16 AS DOUBLE)) AS BIGINT) AS rx,
               count(*) FILTER (WHERE valid) AS valid_px,
               count(*) FILTER (WHERE valid AND positive) AS positive_px,
               avg(score) FILTER (WHERE valid) AS mean, quantile_cont(score, 0.95) FILTER (WHERE valid) AS p95,
               quantile_cont(score, 0.99) FILTER (WHERE valid) AS p99, max(score) FILTER (WHERE valid) AS mx
        FROM px GROUP BY 1, 2) AS a ON a.ry = f.ry AND a.rx = f.rx))"""


def regions(spark, sf):
    return rg.summarize_regions(labelled(spark, sf), SIZE, 0.5, b.canvas(spark, sf))


@register("d09_summarize_regions",
          "region_id:s y0:i x0:i valid_px:i positive_px:i positive_fraction:d mean:d p95:d p99:d max:d eligible:b",
          f"WITH {REGIONS} SELECT * FROM regions")
def d09(spark, sf):
    return regions(spark, sf)


@register("d10_region_stats", "ry:i rx:i name:s stat:s value:d neg:d",
          f"""WITH {LABELLED},
w AS (SELECT cast(floor(y / cast(16 AS DOUBLE)) AS BIGINT) AS ry, cast(floor(x / cast(16 AS DOUBLE)) AS BIGINT) AS rx,
             avg(score) FILTER (WHERE valid) AS a1, quantile_cont(score, 0.95) FILTER (WHERE valid) AS a2,
             max(score) FILTER (WHERE valid) AS a3, avg(depth_mean) FILTER (WHERE valid) AS b1,
             quantile_cont(depth_mean, 0.95) FILTER (WHERE valid) AS b2, max(depth_mean) FILTER (WHERE valid) AS b3
      FROM px GROUP BY 1, 2),
l AS (SELECT ry, rx, 'score' AS name, 'mean' AS stat, a1 AS value FROM w UNION ALL SELECT ry, rx, 'score', 'p95', a2 FROM w
      UNION ALL SELECT ry, rx, 'score', 'max', a3 FROM w UNION ALL SELECT ry, rx, 'depth_mean', 'mean', b1 FROM w
      UNION ALL SELECT ry, rx, 'depth_mean', 'p95', b2 FROM w UNION ALL SELECT ry, rx, 'depth_mean', 'max', b3 FROM w)
SELECT *, -value AS neg FROM l""")
def d10(spark, sf):
    return rg.region_stats(labelled(spark, sf), SIZE, ["score", "depth_mean"])


@register("d11_mask_bbox", "y0:i y1:i x0:i x1:i",
          f"WITH {b.MASK} SELECT min(y) AS y0, max(y) + 1 AS y1, min(x) AS x0, max(x) + 1 AS x1 FROM mask")
def d11(spark, sf):
    return rg.mask_bbox(b.mask(spark, sf))


@register("d12_quantiles", "n:i p05:d p25:d p50:d p75:d p95:d",
          """SELECT count(*) AS n, quantile_cont(o_totalprice, 0.05) AS p05, quantile_cont(o_totalprice, 0.25) AS p25,
quantile_cont(o_totalprice, 0.5) AS p50, quantile_cont(o_totalprice, 0.75) AS p75, quantile_cont(o_totalprice, 0.95) AS p95
FROM orders""")
def d12(spark, sf):
    qs = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    return prefix.exact_quantiles(b.table(spark, sf, "orders"), "o_totalprice", qs)


@register("d13_hist_percentile", "n:i p50:i p95:i p99:i",
          """WITH h AS (SELECT cast(l_quantity AS BIGINT) AS v, count(*) AS n FROM lineitem GROUP BY 1),
c AS (SELECT v, sum(n) OVER (ORDER BY v) AS cum, sum(n) OVER () AS total FROM h)
SELECT max(total) AS n, min(CASE WHEN cum >= cast(0.5 AS DOUBLE) * (total - 1) + 1 THEN v END) AS p50,
       min(CASE WHEN cum >= cast(0.95 AS DOUBLE) * (total - 1) + 1 THEN v END) AS p95,
       min(CASE WHEN cum >= cast(0.99 AS DOUBLE) * (total - 1) + 1 THEN v END) AS p99 FROM c""")
def d13(spark, sf):
    return prefix.hist_percentile(b.table(spark, sf, "lineitem"), "l_quantity", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@register("d14_mask_summary",
          "valid_px:i positive_inside:i positive_outside:i positive_fraction:d p01:d p05:d p50:d p95:d p99:d",
          f"""WITH {b.TRUTH}
SELECT count(*) FILTER (WHERE valid) AS valid_px, count(*) FILTER (WHERE valid AND positive) AS positive_inside,
  count(*) FILTER (WHERE positive AND NOT valid) AS positive_outside,
  count(*) FILTER (WHERE valid AND positive) / cast(count(*) FILTER (WHERE valid) AS DOUBLE) AS positive_fraction,
  quantile_cont(area_um2, 0.01) FILTER (WHERE valid) AS p01, quantile_cont(area_um2, 0.05) FILTER (WHERE valid) AS p05,
  quantile_cont(area_um2, 0.5) FILTER (WHERE valid) AS p50, quantile_cont(area_um2, 0.95) FILTER (WHERE valid) AS p95,
  quantile_cont(area_um2, 0.99) FILTER (WHERE valid) AS p99 FROM truth""")
def d14(spark, sf):
    return rg.mask_summary(b.truth(spark, sf), "area_um2")


LABEL_STATS = """per AS (SELECT cy, cx, count(*) FILTER (WHERE valid) AS valid_px,
        count(*) FILTER (WHERE valid AND positive) AS positive_px FROM truth GROUP BY cy, cx),
flag AS (SELECT *, CASE WHEN positive_px > 0 AND positive_px < valid_px THEN 1 ELSE 0 END AS both_chunks FROM per)"""


@register("d15_label_stats", "cy:i cx:i valid_px:i positive_px:i both_chunks:i",
          f"""WITH {b.TRUTH}, {LABEL_STATS}
SELECT cy, cx, valid_px, positive_px, both_chunks FROM flag
UNION ALL SELECT NULL, NULL, sum(valid_px), sum(positive_px), sum(both_chunks) FROM flag""")
def d15(spark, sf):
    return rg.label_stats(b.truth(spark, sf), ["cy", "cx"])


@register("d17_mask_stability", "mid_px:i iou_low:d iou_high:d high_retention:d",
          f"""WITH {b.CELLS}, {b.TWO_VIEWS}
SELECT sum(CASE WHEN a >= 0.5 THEN 1 ELSE 0 END) AS mid_px,
  sum(CASE WHEN a >= cast(0.5 AS DOUBLE) THEN 1 ELSE 0 END) / cast(sum(CASE WHEN a >= cast(0.3 AS DOUBLE) THEN 1 ELSE 0 END) AS DOUBLE) AS iou_low,
  sum(CASE WHEN a >= cast(0.7 AS DOUBLE) THEN 1 ELSE 0 END) / cast(sum(CASE WHEN a >= cast(0.5 AS DOUBLE) THEN 1 ELSE 0 END) AS DOUBLE) AS iou_high,
  sum(CASE WHEN a >= cast(0.7 AS DOUBLE) THEN 1 ELSE 0 END) / cast(sum(CASE WHEN a >= cast(0.5 AS DOUBLE) THEN 1 ELSE 0 END) AS DOUBLE) AS high_retention
FROM two""")
def d17(spark, sf):
    return rg.mask_stability(b.two_views(spark, sf), "a", 0.3, 0.5, 0.7)


@register("d18_duplicates", "rows:i distinct_keys:i duplicates:i",
          """SELECT sum(n) AS "rows", count(*) AS distinct_keys, sum(n) - count(*) AS duplicates
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def d18(spark, sf):
    return rg.duplicates(b.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


DENSITY = """bins AS (SELECT cast(floor(floor(z) / 100.0) AS BIGINT) AS bz, cast(floor(floor(y) / 10.0) AS BIGINT) AS by_,
     cast(floor(floor(x) / 10.0) AS BIGINT) AS bx, count(*) AS points,
     median(z) AS z_med, median(y) AS y_med, median(x) AS x_med FROM points3 GROUP BY 1, 2, 3)"""

DENSITY_SIZES = {"z": 100, "y": 10, "x": 10}


@register("d19_density_bins", "bz:i by_:i bx:i points:i z_med:d y_med:d x_med:d",
          f"WITH {b.POINTS3}, {DENSITY} SELECT * FROM bins")
def d19(spark, sf):
    return rg.density_bins(b.points3(spark, sf), DENSITY_SIZES).withColumnRenamed("by", "by_")


@register("d20_budget", "regime:s surface:s stage:s files:i bytes:i within_cap:b",
          f"""WITH {b.MANIFEST}
SELECT regime, surface, stage, count(*) AS files, sum(bytes) AS bytes, sum(bytes) <= 500000 AS within_cap
FROM (SELECT *, CASE WHEN role IN ('en', 'de') THEN 'A1' ELSE 'A2' END AS stage FROM manifest)
GROUP BY ROLLUP (regime, surface, stage)""")
def d20(spark, sf):
    files = b.manifest(spark, sf).withColumn("stage", F.when(F.col("role").isin("en", "de"), "A1").otherwise("A2"))
    return rg.budget(files, 500000)


def scans(spark, sf):
    n = b.table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    return b.table(spark, sf, "supplier").join(n, "s_nationkey").select(
        F.col("n_regionkey").alias("sample"), F.col("s_suppkey").alias("scan"),
        (F.col("s_nationkey") % 3).alias("energy"), F.floor(F.col("s_acctbal") / 4000).alias("px"),
        (F.col("s_suppkey") % 4).alias("facility"), "s_acctbal",
    )


SCANS = """scans AS (SELECT n_regionkey AS sample, s_suppkey AS scan, s_nationkey % 3 AS energy,
  cast(floor(s_acctbal / cast(4000 AS DOUBLE)) AS BIGINT) AS px, s_suppkey % 4 AS facility, s_acctbal
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


@register("d21_catalog_summary", "sample:i scans:i pairs:i ready:b",
          f"""WITH {SCANS},
p AS (SELECT a.sample, count(*) AS pairs FROM scans a JOIN scans b ON a.sample = b.sample AND a.scan < b.scan
  WHERE (CASE WHEN a.energy <> b.energy THEN 1 ELSE 0 END) + (CASE WHEN a.px <> b.px THEN 1 ELSE 0 END)
      + (CASE WHEN a.facility <> b.facility THEN 1 ELSE 0 END) >= 2 GROUP BY a.sample),
c AS (SELECT sample, count(*) AS scans FROM scans GROUP BY sample)
SELECT c.sample, c.scans, coalesce(p.pairs, 0) AS pairs, c.scans >= 15 AND coalesce(p.pairs, 0) >= 100 AS ready
FROM c LEFT JOIN p ON c.sample = p.sample""")
def d21(spark, sf):
    return rg.catalog_summary(scans(spark, sf), "sample", "scan", ["energy", "px", "facility"], 2, 15, 100)


@register("d22_screen_summary", "rows_eligible:i rows_passing:i pairs_screened:i pairs_passing:i",
          f"""WITH {b.CELLS}, e AS (SELECT y, x, grp, view_id, score, score >= cast(0.6 AS DOUBLE) AS ok FROM cells WHERE view_id <= 6),
p AS (SELECT a.ok AND b.ok AS ok FROM e a JOIN e b ON a.y = b.y AND a.x = b.x AND a.view_id < b.view_id AND a.grp <> b.grp)
SELECT (SELECT count(*) FROM e) AS rows_eligible, (SELECT count(*) FROM e WHERE ok) AS rows_passing,
       count(*) AS pairs_screened, sum(CASE WHEN ok THEN 1 ELSE 0 END) AS pairs_passing FROM p""")
def d22(spark, sf):
    return rg.screen_summary(b.cells(spark, sf), ["y", "x"], "grp", F.col("score") >= F.lit(0.6), F.col("view_id") <= 6)


@register("d23_census", "surface:s renders:i volumes:i models:i has_validation:b status:s",
          f"""WITH {b.MANIFEST},
c AS (SELECT surface, count(*) AS renders, count(DISTINCT doc_id % 5) AS volumes, count(DISTINCT role) AS models,
      bool_or(regime = 'VALIDATION') AS has_validation FROM manifest GROUP BY surface)
SELECT *, CASE WHEN volumes >= 2 AND models >= 2 AND has_validation THEN 'candidate_validation'
               WHEN volumes >= 2 AND models >= 2 THEN 'candidate_dev' ELSE 'no_distinct_pair' END AS status FROM c""")
def d23(spark, sf):
    listing = b.manifest(spark, sf).select(
        "surface", (F.col("doc_id") % 5).alias("volume"), F.col("role").alias("model"),
        (F.col("regime") == "VALIDATION").alias("validation"),
    )
    return rg.census(listing, "surface")


@register("d24_review_summary",
          "response:s reviews:i total_seconds:d3 mean_confidence:d median_seconds:d p90_seconds:d share:d",
          f"""WITH {b.REVIEWS}
SELECT response, count(*) AS reviews, sum(seconds) AS total_seconds, avg(confidence) AS mean_confidence,
  quantile_cont(seconds, 0.5) AS median_seconds, quantile_cont(seconds, 0.9) AS p90_seconds,
  count(*) / cast((SELECT count(*) FROM reviews) AS DOUBLE) AS share FROM reviews GROUP BY response""")
def d24(spark, sf):
    return rg.review_summary(b.reviews(spark, sf))


@register("d25_roi_sanity", "cy:i cx:i nonzero_fraction:d max_value:d",
          f"""WITH {b.CELLS} SELECT cast(floor(y / 32.0) AS BIGINT) AS cy, cast(floor(x / 32.0) AS BIGINT) AS cx,
avg(CASE WHEN score <> 0 THEN 1.0 ELSE 0.0 END) AS nonzero_fraction, max(score) AS max_value FROM cells GROUP BY 1, 2""")
def d25(spark, sf):
    px = b.cells(spark, sf).withColumn("cy", F.floor(F.col("y") / 32)).withColumn("cx", F.floor(F.col("x") / 32))
    return rg.roi_sanity(px, ["cy", "cx"], "score")
