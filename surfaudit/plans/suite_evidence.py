"""Evidence queries: contracts on views, collapse, consensus, blending, scaling, CT support."""

from pyspark.sql import functions as F

from surfaudit.operators import evidence as ev
from surfaudit.plans import bindings as b
from surfaudit.plans.registry import register

CONSENSUS = """maps AS (
  SELECT y, x, count(g) AS valid_groups, median(g) AS consensus, max(g) - min(g) AS disagreement,
         coalesce(sum(CASE WHEN g >= cast(0.6 AS DOUBLE) THEN 1 ELSE 0 END) / cast(nullif(count(g), 0) AS DOUBLE), 0) AS support
  FROM (SELECT y, x, grp, median(score) AS g FROM cells GROUP BY y, x, grp) GROUP BY y, x),
decided AS (
  SELECT *, coalesce(valid_groups >= 2 AND consensus >= cast(0.6 AS DOUBLE) AND support >= cast(1.0 AS DOUBLE)
                     AND disagreement <= cast(0.3 AS DOUBLE), false) AS accepted FROM maps)"""


@register("d01_collapse_groups", "y:i x:i grp:s score:d views:i",
          f"WITH {b.CELLS} SELECT y, x, grp, median(score) AS score, count(*) AS views FROM cells GROUP BY y, x, grp")
def d01(spark, sf):
    return ev.collapse_groups(b.raw_pixels(spark, sf), b.VIEW_GROUPS)


def consensus(spark, sf):
    return ev.combine_evidence(b.raw_pixels(spark, sf), b.VIEW_GROUPS)


@register("d02_combine_evidence", "y:i x:i valid_groups:i consensus:d disagreement:d support:d accepted:b",
          f"WITH {b.CELLS}, {CONSENSUS} SELECT * FROM decided")
def d02(spark, sf):
    return consensus(spark, sf)


@register("d03_evidence_report", "pixels:i accepted_pixels:i accepted_fraction:d max_valid_groups:i mean_support:d",
          f"""WITH {b.CELLS}, {CONSENSUS}, {b.TRUTH}, cs AS (SELECT (max(y) + 1) * {b.WIDTH} AS n FROM truth)
SELECT max(n) AS pixels, sum(CASE WHEN accepted THEN 1 ELSE 0 END) AS accepted_pixels,
       sum(CASE WHEN accepted THEN 1.0 ELSE 0.0 END) / max(n) AS accepted_fraction,
       max(valid_groups) AS max_valid_groups, sum(support) / max(n) AS mean_support FROM decided, cs""")
def d03(spark, sf):
    return ev.evidence_report(consensus(spark, sf), b.canvas(spark, sf))


@register("d04_consistency_maps", "y:i x:i disagreement:d consensus:d retained:b",
          f"""WITH {b.CELLS}, {b.TWO_VIEWS}
SELECT y, x, abs(a - b) AS disagreement, sqrt(least(1, greatest(0, a)) * least(1, greatest(0, b))) AS consensus,
       abs(a - b) <= cast(0.25 AS DOUBLE) AS retained FROM two""")
def d04(spark, sf):
    return ev.consistency_maps(b.two_views(spark, sf), 0.25)


@register("d05_blend_tiles", "y:i x:i blended:d weight:d",
          f"""WITH {b.CELLS}
SELECT y, x, sum(score * w * ok) / greatest(sum(w * ok), cast(1e-12 AS DOUBLE)) AS blended, sum(w * ok) AS weight
FROM (SELECT *, cast(view_id AS DOUBLE) / 7 AS w, CASE WHEN (y + x + view_id) % 5 <> 0 THEN 1 ELSE 0 END AS ok FROM cells)
GROUP BY y, x""")
def d05(spark, sf):
    tiles = b.cells(spark, sf).select(
        "y", "x", F.col("score").alias("p"), (F.col("view_id") / F.lit(7.0)).alias("w"),
        ((F.col("y") + F.col("x") + F.col("view_id")) % 5 != 0).alias("valid"),
    )
    return ev.blend_tiles(tiles)


@register("d06_robust_mad", "pixel:i layer:i scaled:d5",
          f"""WITH {b.PROFILES},
v AS (SELECT pixel, unnest(range(len(layers))) AS layer, cast(unnest(layers) AS DOUBLE) AS v FROM profiles),
cut AS (SELECT pixel, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM v GROUP BY pixel),
c AS (SELECT v.pixel, layer, least(hi, greatest(lo, v)) AS c, hi - lo AS span FROM v JOIN cut ON v.pixel = cut.pixel),
m AS (SELECT pixel, median(c) AS med, stddev_pop(c) AS sd, max(span) AS span FROM c GROUP BY pixel),
d AS (SELECT c.pixel, median(abs(c.c - m.med)) * cast(1.4826 AS DOUBLE) AS mad FROM c JOIN m ON c.pixel = m.pixel GROUP BY c.pixel)
SELECT c.pixel, c.layer, (c.c - m.med) / CASE WHEN d.mad < cast(1e-6 AS DOUBLE)
       THEN greatest(m.sd, m.span / 2, 1) ELSE d.mad END AS scaled
FROM c JOIN m ON c.pixel = m.pixel JOIN d ON c.pixel = d.pixel""")
def d06(spark, sf):
    rows = b.profiles(spark, sf).select("pixel", F.posexplode("layers").alias("layer", "v"))
    return ev.robust_mad(rows, "v", "pixel")


@register("d07_ct_support", "cy:i cx:i pixels:i any_fraction:d central_fraction:d median_depth_fraction:d",
          f"""WITH {b.VOXELS}, {b.TRUTH},
h AS (SELECT y, x, sum(CASE WHEN v > 10 THEN 1 ELSE 0 END) AS hits,
             sum(CASE WHEN v > 10 AND z >= 2 AND z < 5 THEN 1 ELSE 0 END) AS central FROM voxels GROUP BY y, x)
SELECT cy, cx, count(*) AS pixels, avg(CASE WHEN coalesce(hits, 0) > 0 THEN 1.0 ELSE 0.0 END) AS any_fraction,
       avg(CASE WHEN coalesce(central, 0) > 0 THEN 1.0 ELSE 0.0 END) AS central_fraction,
       median(coalesce(hits, 0) / cast(7 AS DOUBLE)) AS median_depth_fraction
FROM truth t LEFT JOIN h ON t.y = h.y AND t.x = h.x WHERE t.valid GROUP BY cy, cx""")
def d07(spark, sf):
    vox = b.voxels(spark, sf).withColumn("v", F.col("v") - 10)
    return ev.ct_support(vox, b.truth(spark, sf).where("valid"), (2, 5), 7, ["cy", "cx"])
