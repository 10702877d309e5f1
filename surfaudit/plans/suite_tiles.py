"""Morphology, tile-job and model-fitting queries."""

from pyspark.sql import functions as F

from surfaudit.functions.scalar import profile_features
from surfaudit.operators import fitting as ft, metrics as m, tiles as tl
from surfaudit.operators.sampling import buffered_folds
from surfaudit.plans import bindings as b
from surfaudit.plans.registry import register
from surfaudit.session import cut_lineage

DISK = "k AS (SELECT dy, dx FROM (SELECT unnest(range(-2, 3)) AS dy) CROSS JOIN (SELECT unnest(range(-2, 3)) AS dx) WHERE dy * dy + dx * dx <= 4)"
CANVAS = f"cs AS (SELECT max(y) + 1 AS h, {b.WIDTH} AS w FROM truth)"


@register("i05_dilate", "y:i x:i",
          f"""WITH {b.MASK}, {b.TRUTH}, {CANVAS}, {DISK} SELECT DISTINCT s.y + dy AS y, s.x + dx AS x FROM mask s CROSS JOIN k CROSS JOIN cs
WHERE s.y + dy >= 0 AND s.y + dy < h AND s.x + dx >= 0 AND s.x + dx < w""")
def i05(spark, sf):
    return tl.dilate(b.mask(spark, sf), 2, b.canvas(spark, sf))


@register("i05_close", "y:i x:i",
          f"""WITH {b.MASK}, {b.TRUTH}, {CANVAS}, {DISK}, d AS (SELECT DISTINCT s.y + dy AS y, s.x + dx AS x FROM mask s CROSS JOIN k CROSS JOIN cs
WHERE s.y + dy >= 0 AND s.y + dy < h AND s.x + dx >= 0 AND s.x + dx < w)
SELECT y - dy AS y, x - dx AS x FROM d CROSS JOIN k GROUP BY 1, 2 HAVING count(*) = 13""")
def i05_close(spark, sf):
    return tl.close(b.mask_readings(spark, sf), 2, b.canvas(spark, sf))


@register("i05_close_by_surface", "surface:i y:i x:i",
          f"""WITH {b.SURFACES}, {DISK}, cs AS (SELECT max(y) + 1 AS h, {b.WIDTH} AS w FROM surfaces),
d AS (SELECT DISTINCT s.surface, s.y + dy AS y, s.x + dx AS x FROM surfaces s CROSS JOIN k CROSS JOIN cs
WHERE s.y + dy >= 0 AND s.y + dy < h AND s.x + dx >= 0 AND s.x + dx < w)
SELECT surface, y - dy AS y, x - dx AS x FROM d CROSS JOIN k GROUP BY 1, 2, 3 HAVING count(*) = 13""")
def i05_close_by_surface(spark, sf):
    px = b.surfaces(spark, sf)
    height = px.agg(F.max("y") + 1).first()[0]  # canvas size, one number
    return tl.close(px, 2, (height, b.WIDTH), ["surface"])


def patches(spark, sf):
    """Voxels of 7 x 32 x 32 patches with a second field s marking the surface."""
    line = b.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_quantity").cast("int").alias("v"), F.max("l_tax").alias("s"))
    y, x = b._yx("l_orderkey")
    rows = line.select((F.col("l_linenumber") - 1).alias("z"), y, x, "v", "s")
    return rows.withColumn("py", F.floor(F.col("y") / 32).cast("int")).withColumn("px", F.floor(F.col("x") / 32).cast("int"))


PATCHES = f"""pv AS (SELECT *, y // 32 AS py, x // 32 AS px FROM (SELECT l_linenumber - 1 AS z, {b._yx_sql('l_orderkey')}, cast(max(l_quantity) AS INTEGER) AS v, max(l_tax) AS s
  FROM lineitem GROUP BY l_orderkey, l_linenumber))"""
SHELLS = "shell_0:d shell_1:d shell_2:d shell_3:d shell_4_5:d band_1:d band_2:d decay:d"


@register("i06_shell_stats", "py:i px:i " + SHELLS,
          f"""WITH {PATCHES}, o AS (SELECT * FROM (SELECT unnest(range(-5, 6)) AS dz) CROSS JOIN (SELECT unnest(range(-5, 6)) AS dy) CROSS JOIN (SELECT unnest(range(-5, 6)) AS dx)
  WHERE dz * dz + dy * dy + dx * dx <= 25),
d AS (SELECT py, px, z + dz AS z, y + dy AS y, x + dx AS x, min(dz * dz + dy * dy + dx * dx) AS d2 FROM pv CROSS JOIN o WHERE s >= cast(0.08 AS DOUBLE)
  AND z + dz >= 0 AND z + dz < 7 AND (y + dy) // 32 = py AND y + dy >= 0 AND (x + dx) // 32 = px AND x + dx >= 0 GROUP BY 1, 2, 3, 4, 5),
j AS (SELECT d.py, d.px, d2, cast(coalesce(v, 0) AS DOUBLE) AS v FROM d LEFT JOIN pv ON pv.z = d.z AND pv.y = d.y AND pv.x = d.x)
SELECT py, px, avg(v) FILTER (WHERE d2 = 0) AS shell_0, avg(v) FILTER (WHERE d2 > 0 AND d2 <= 1) AS shell_1, avg(v) FILTER (WHERE d2 > 1 AND d2 <= 4) AS shell_2,
 avg(v) FILTER (WHERE d2 > 4 AND d2 <= 9) AS shell_3, avg(v) FILTER (WHERE d2 > 9) AS shell_4_5, avg(v) FILTER (WHERE d2 <= 1) AS band_1, avg(v) FILTER (WHERE d2 <= 4) AS band_2,
 avg(v) FILTER (WHERE d2 = 0) - avg(v) FILTER (WHERE d2 > 9) AS decay FROM j GROUP BY py, px""")
def i06(spark, sf):
    vox = patches(spark, sf)
    edge = lambda c: (F.col(c) * 32, F.col(c) * 32 + 32)
    return tl.shell_stats(vox, vox.where(F.col("s") >= 0.08), [(0, 7), edge("py"), edge("px")], ["py", "px"])


def raster(spark, sf):
    """Dense score raster with its mask."""
    px = b.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max(F.col("l_discount") * 10).alias("score")).select(*b._yx("l_orderkey"), "score")
    return b.truth(spark, sf).select("y", "x", "valid").join(px, ["y", "x"], "left").fillna(0.0, ["score"])


def structured(spark, sf):
    px = raster(spark, sf)
    canvas = b.canvas(spark, sf)
    return px.join(tl.structural_map(px, canvas, tl.StructureParams(), tile=64), ["y", "x"]), canvas


@register("j01_structural_map", "y:i x:i structure:d")
def j01(spark, sf):
    return structured(spark, sf)[0]


@register("j02_component_score", "ry:i rx:i best:d kept:i longest:i")
def j02(spark, sf):
    px, canvas = structured(spark, sf)
    return tl.component_score(px, 64, canvas, 0.9, 1, 6, 3)


@register("j03_candidate_masks",
          "ry:i rx:i mask_px:i skeleton_px:i components:i iou_low:d iou_high:d high_retention:d stable:b")
def j03(spark, sf):
    return tl.candidate_masks(raster(spark, sf), 64, b.canvas(spark, sf), [0.8, 0.9, 1.0], 0.9, 1, 6, 0.5, 0.5)


@register("j04_patch_features",
          "py:i px:i ink_fraction:d surface_fraction:d overlap_fraction:d ink_on_surface_fraction:d ink_mean:d ink_std:d ink_max:d "
          "positive_ink_mean:d positive_ink_p90:d ink_p90:d ink_p95:d ink_p99:d",
          f"""WITH {PATCHES}, c AS (SELECT py, px, unnest(range(7168)) AS i FROM (SELECT DISTINCT py, px FROM pv)),
f AS (SELECT c.py, c.px, cast(coalesce(v, 0) AS DOUBLE) AS v, coalesce(s, 0) AS s FROM c LEFT JOIN pv ON pv.py = c.py AND pv.px = c.px AND pv.z = i // 1024 AND pv.y = c.py * 32 + (i // 32) % 32 AND pv.x = c.px * 32 + i % 32)
SELECT py, px, avg(CASE WHEN v >= 40 THEN 1.0 ELSE 0 END) AS ink_fraction, avg(CASE WHEN s >= cast(0.06 AS DOUBLE) THEN 1.0 ELSE 0 END) AS surface_fraction,
 avg(CASE WHEN v >= 40 AND s >= cast(0.06 AS DOUBLE) THEN 1.0 ELSE 0 END) AS overlap_fraction,
 count(*) FILTER (WHERE v >= 40 AND s >= cast(0.06 AS DOUBLE)) / cast(count(*) FILTER (WHERE v >= 40) AS DOUBLE) AS ink_on_surface_fraction,
 avg(v) AS ink_mean, stddev_pop(v) AS ink_std, max(v) AS ink_max, avg(v) FILTER (WHERE v >= 40) AS positive_ink_mean, quantile_cont(v, 0.9) FILTER (WHERE v >= 40) AS positive_ink_p90,
 quantile_cont(v, 0.9) AS ink_p90, quantile_cont(v, 0.95) AS ink_p95, quantile_cont(v, 0.99) AS ink_p99 FROM f GROUP BY py, px""")
def j04(spark, sf):
    return tl.patch_features(patches(spark, sf), ["py", "px"], 7 * 32 * 32, 40, 0.06)


@register("j04_patch_distances",
          "py:i px:i dist_mean:d dist_median:d dist_p90:d dist_p95:d dist_max:d le_0:d le_1:d le_2:d le_3:d le_5:d",
          f"""WITH {PATCHES}, a AS (SELECT * FROM pv WHERE v >= 40), q AS (SELECT * FROM pv WHERE s >= cast(0.06 AS DOUBLE)),
d AS (SELECT a.py, a.px, a.z, a.y, a.x, sqrt(min((a.z - q.z) * (a.z - q.z) + (a.y - q.y) * (a.y - q.y) + (a.x - q.x) * (a.x - q.x))) AS d
  FROM a JOIN q ON a.py = q.py AND a.px = q.px GROUP BY 1, 2, 3, 4, 5)
SELECT py, px, avg(d) AS dist_mean, median(d) AS dist_median, quantile_cont(d, 0.9) AS dist_p90, quantile_cont(d, 0.95) AS dist_p95, max(d) AS dist_max,
 avg(CASE WHEN d <= 0 THEN 1.0 ELSE 0 END) AS le_0, avg(CASE WHEN d <= 1 THEN 1.0 ELSE 0 END) AS le_1, avg(CASE WHEN d <= 2 THEN 1.0 ELSE 0 END) AS le_2,
 avg(CASE WHEN d <= 3 THEN 1.0 ELSE 0 END) AS le_3, avg(CASE WHEN d <= 5 THEN 1.0 ELSE 0 END) AS le_5 FROM d GROUP BY py, px""")
def j04_distances(spark, sf):
    return tl.patch_distances(patches(spark, sf), ["py", "px"], (7, 32, 32), 40, 0.06)


@register("j05_render_surface", "y:i x:i offset:d v:i")
def j05(spark, sf):
    # The grid is brought into the volume: one vertex per pixel column, height near the middle.
    grid = b.grid(spark, sf).select(
        "v", "u", F.col("u").cast("double").alias("x"), F.col("v").cast("double").alias("y"),
        (F.lit(2.0) + F.abs(F.col("z")) % 7 / F.lit(4.0)).alias("z"))
    height = grid.agg(F.max("v") + 1).first()[0]
    return tl.render_surface(grid, b.voxels(spark, sf), (height, b.WIDTH), 2, [-1.0, 0.0, 1.0])


LAYERS = 64  # length of the supplied profiles
FEATURES = [*[f"layer_{i}" for i in range(LAYERS)], "mean", "std", "min", "max", "range", "argmax", "slope", "center_contrast"]


def folded(spark, sf):
    """All layers of a profile and its eight summary features."""
    rows = b.profiles(spark, sf)
    f = profile_features(F.col("layers")) | {f"layer_{i}": F.get("layers", F.lit(i)).cast("double") for i in range(LAYERS)}
    table = rows.select("pixel", "positive", *[f[n].cast("double").alias(n) for n in FEATURES])
    return buffered_folds(cut_lineage(table), "pixel", 3, 10)


@register("k01_crossfit_logistic", "pixel:i fold:i score:d")
def k01(spark, sf):
    return ft.crossfit_logistic(folded(spark, sf), FEATURES, "positive", "fold", ["pixel"])


@register("k02_crossfit_gbt", "fold:i n:i auc:d")
def k02(spark, sf):
    scores = ft.crossfit_gbt(folded(spark, sf), FEATURES, "positive", "fold", ["pixel"], rounds=100)
    return m.roc_auc(scores, "positive", "score", ["fold"]).select("fold", "n", "auc")


def gappy(spark, sf):
    """Scores of labelled pixels where a view may be missing."""
    per = b.raw_pixels(spark, sf).groupBy("y", "x").agg(
        F.max(F.when(F.col("view_id") == 1, F.col("score"))).alias("a"), F.max(F.when(F.col("view_id") == 2, F.col("score"))).alias("b"))
    return b.truth(spark, sf).select("y", "x").join(per, ["y", "x"], "left")


GAPPY = f"{b.CELLS}, {b.TRUTH}, gp AS (SELECT t.y, t.x, p.score AS a, q.score AS b FROM truth t LEFT JOIN cells p ON p.y = t.y AND p.x = t.x AND p.view_id = 1 LEFT JOIN cells q ON q.y = t.y AND q.x = t.x AND q.view_id = 2)"


@register("k03_fill_values", "name:s fill:d",
          f"WITH {GAPPY} SELECT 'a' AS name, median(a) AS fill FROM gp UNION ALL SELECT 'b', median(b) FROM gp")
def k03(spark, sf):
    return ft.fill_values(gappy(spark, sf), ["a", "b"])


@register("k03_impute_median", "y:i x:i a:d b:d",
          f"WITH {GAPPY} SELECT y, x, coalesce(a, (SELECT median(a) FROM gp)) AS a, coalesce(b, (SELECT median(b) FROM gp)) AS b FROM gp")
def k03_impute(spark, sf):
    return ft.impute_median(gappy(spark, sf), ["a", "b"])


@register("k04_oof_scores", "fold:i n:i positives:i ap:d missing:i")
def k04(spark, sf):
    rows = folded(spark, sf)
    scores = cut_lineage(ft.crossfit_logistic(rows, FEATURES, "positive", "fold", ["pixel"]))
    gaps = ft.oof_completeness(scores, b.profiles(spark, sf), "pixel").agg(F.count(F.lit(1))).scalar()
    return m.average_precision(scores, "positive", "score", ["fold"]).withColumn("missing", gaps)
