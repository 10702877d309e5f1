"""Window, top-k, suppression and set queries."""

from pyspark.sql import functions as F

from surfaudit.operators import ranking as rk, windows as wn
from surfaudit.plans import bindings as b
from surfaudit.plans.registry import register
from surfaudit.plans.suite_regions import DENSITY, DENSITY_SIZES, REGIONS, regions
from surfaudit.operators.regions import density_bins
from surfaudit.session import cut_lineage


@register("e02_rank_rows", "o_orderkey:i rank:i",
          "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def e02(spark, sf):
    return rk.rank_rows(b.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@register("e02_rank_rows_nulls", "g:i o_orderkey:i rank:i",
          """WITH r AS (SELECT CASE WHEN o_custkey % 3 <> 0 THEN o_custkey % 3 END AS g, o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 50 END AS s FROM orders)
SELECT g, o_orderkey, row_number() OVER (PARTITION BY g ORDER BY s DESC NULLS LAST, o_orderkey) AS rank FROM r""")
def e02_nulls(spark, sf):
    key = F.col("o_orderkey")
    rows = b.table(spark, sf, "orders").select(
        F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey") % 3).alias("g"), key, F.when(key % 7 != 0, key % 50).alias("s"))
    return rk.rank_rows(rows, "s", "o_orderkey", ["g"])


@register("e04_contiguous_folds", "cell:i fold:i",
          "SELECT cell, ntile(7) OVER (ORDER BY cell) - 1 AS fold FROM (SELECT DISTINCT l_orderkey AS cell FROM lineitem)")
def e04(spark, sf):
    return wn.contiguous_folds(b.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("cell")), "cell", 7)


@register("e05_central_diff", "v:i u:i dz_du:d dz_dv:d",
          f"""WITH {b.GRID},
l AS (SELECT v, u, z, lag(z) OVER r AS pu, lead(z) OVER r AS nu, lag(z) OVER c AS pv, lead(z) OVER c AS nv FROM grid
      WINDOW r AS (PARTITION BY v ORDER BY u), c AS (PARTITION BY u ORDER BY v))
SELECT v, u, CASE WHEN pu IS NULL THEN 2 * (nu - z) WHEN nu IS NULL THEN 2 * (z - pu) ELSE nu - pu END AS dz_du,
  CASE WHEN pv IS NULL THEN nv - z WHEN nv IS NULL THEN z - pv ELSE (nv - pv) / 2 END AS dz_dv FROM l""")
def e05(spark, sf):
    g = wn.central_diff(b.grid(spark, sf), "z", "u", "v", alias="dz_du")
    return wn.central_diff(g, "z", "v", "u", half=True, alias="dz_dv")


@register("e06_smooth_first_min", "pixel:i gap:i smooth_min:d",
          f"""WITH {b.PROFILES},
v AS (SELECT pixel, unnest(range(len(layers))) AS layer, cast(unnest(layers) AS DOUBLE) AS v FROM profiles),
s AS (SELECT pixel, layer, (coalesce(lag(v) OVER w, 0) + v + coalesce(lead(v) OVER w, 0)) / 3 AS s FROM v
      WINDOW w AS (PARTITION BY pixel ORDER BY layer)),
m AS (SELECT pixel, layer, s, round(s, 9) AS r, round(lag(s) OVER w, 9) AS p, round(lead(s) OVER w, 9) AS n FROM s
      WINDOW w AS (PARTITION BY pixel ORDER BY layer))
SELECT pixel, coalesce(min(layer) FILTER (WHERE p IS NOT NULL AND n IS NOT NULL AND r <= p AND r <= n),
       arg_min(layer, r)) AS gap, min(s) AS smooth_min FROM m GROUP BY pixel""")
def e06(spark, sf):
    rows = b.profiles(spark, sf).select("pixel", F.posexplode("layers").alias("layer", "v")).withColumn(
        "v", F.col("v").cast("double"))
    return wn.smooth_first_min(rows, ["pixel"], "layer", "v")


@register("e07_densest_window", "y:i x:i total:i",
          f"""WITH {b.MASK}, h AS (SELECT max(y) + 1 AS h FROM mask),
c AS (SELECT y, x FROM (SELECT unnest(range((SELECT h FROM h))) AS y), (SELECT unnest(range(125)) AS x)),
m AS (SELECT c.y, c.x, CASE WHEN k.y IS NULL THEN 0 ELSE 1 END AS m FROM c LEFT JOIN mask k ON c.y = k.y AND c.x = k.x),
r AS (SELECT y, x, sum(m) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS r FROM m),
t AS (SELECT y, x, sum(r) OVER (PARTITION BY x ORDER BY y ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS total FROM r)
SELECT y, x, total FROM t WHERE y <= (SELECT h FROM h) - 12 AND x <= 125 - 12 ORDER BY total DESC, y, x LIMIT 1""")
def e07(spark, sf):
    px = b.mask(spark, sf)
    height = px.agg(F.max("y") + 1).first()[0]  # canvas size, one number
    return wn.densest_window(px, height, b.WIDTH, 12)


@register("e07_densest_by_surface", "surface:i y:i x:i total:i",
          f"""WITH {b.SURFACES}, h AS (SELECT max(y) + 1 AS h FROM surfaces),
o AS (SELECT * FROM (SELECT unnest(range(12)) AS dy) CROSS JOIN (SELECT unnest(range(12)) AS dx)),
t AS (SELECT surface, y - dy AS y, x - dx AS x, count(*) AS total FROM surfaces CROSS JOIN o GROUP BY 1, 2, 3)
SELECT surface, y, x, total FROM (SELECT *, row_number() OVER (PARTITION BY surface ORDER BY total DESC, y, x) AS r FROM t, h
  WHERE y BETWEEN 0 AND h - 12 AND x BETWEEN 0 AND {b.WIDTH} - 12) WHERE r = 1""")
def e07_by_surface(spark, sf):
    px = b.surfaces(spark, sf)
    height = px.agg(F.max("y") + 1).first()[0]  # canvas size, one number
    return wn.densest_window(px, height, b.WIDTH, 12, ["surface"])


@register("e08_rank_within", "o_custkey:i o_orderkey:i rank:i",
          """SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank
FROM orders) WHERE rank <= 3""")
def e08(spark, sf):
    return wn.rank_within(b.table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


@register("f01_candidate_package", "candidate_id:s region_id:s rank:i mean:d",
          f"""WITH {REGIONS}
SELECT 'cand-r' || lpad(cast(rank AS VARCHAR), 3, '0') AS candidate_id, region_id, rank, mean
FROM (SELECT *, row_number() OVER (ORDER BY round(mean, 9) DESC, region_id) AS rank FROM regions WHERE eligible) WHERE rank <= 10""")
def f01(spark, sf):
    rows = regions(spark, sf).withColumn("score", F.round("mean", 9))
    return rk.candidate_package(rows, "score", 10, "cand", "region_id")


@register("f02_select_chunks", "cy:i cx:i bytes:i rank:i found:i enough:b",
          """WITH listing AS (SELECT doc_id % 12 AS cy, cast(floor(doc_id / 12.0) AS BIGINT) AS cx, n_chars AS bytes FROM documents),
fit AS (SELECT *, row_number() OVER (ORDER BY bytes DESC, cy, cx) AS rank, count(*) OVER () AS found FROM listing
  WHERE bytes >= 200 AND cy >= 2 AND cy < 10 AND cx >= 0 AND cx < 60)
SELECT *, found >= 20 AS enough FROM fit WHERE rank <= 20""")
def f02(spark, sf):
    d = b.table(spark, sf, "documents")
    listing = d.select((F.col("doc_id") % 12).alias("cy"), F.floor(F.col("doc_id") / 12).alias("cx"), F.col("n_chars").alias("bytes"))
    return rk.select_chunks(listing, 20, 200, (2, 10, 0, 60))


@register("f03_top_fraction", "y:i x:i area_um2:d2 cutoff:d2",
          f"""WITH {b.TRUTH}, r AS (SELECT y, x, area_um2, row_number() OVER (ORDER BY area_um2 DESC) AS rn, count(*) OVER () AS n FROM truth),
c AS (SELECT min(area_um2) AS cutoff FROM r WHERE rn <= greatest(1, ceil(n * cast(0.05 AS DOUBLE))))
SELECT y, x, area_um2, cutoff FROM truth, c WHERE area_um2 >= cutoff""")
def f03(spark, sf):
    return rk.top_fraction(b.truth(spark, sf), "area_um2", 0.05)


@register("f04_suppress_close", "rank:i points:i bz:i by_:i bx:i",
          f"""WITH {b.POINTS3}, {DENSITY},
r AS (SELECT *, row_number() OVER (ORDER BY points DESC, bz, by_, bx) AS prio FROM bins),
g AS (SELECT list_reduce(list(struct_pack(p := prio, z := z_med, y := y_med, x := x_med, keep := [struct_pack(p := prio, z := z_med, y := y_med, x := x_med)]) ORDER BY prio),
   lambda acc, c: struct_pack(p := acc.p, z := acc.z, y := acc.y, x := acc.x,
     keep := CASE WHEN len(list_filter(acc.keep, lambda k: sqrt((k.z - c.z) * (k.z - c.z) + (k.y - c.y) * (k.y - c.y) + (k.x - c.x) * (k.x - c.x)) < cast(60 AS DOUBLE))) = 0
             THEN list_append(acc.keep, struct_pack(p := c.p, z := c.z, y := c.y, x := c.x)) ELSE acc.keep END)).keep AS keep FROM r),
s AS (SELECT unnest(keep) AS k FROM g),
t AS (SELECT k.p AS prio, row_number() OVER (ORDER BY k.p) AS rank FROM s)
SELECT t.rank, points, bz, by_, bx FROM t JOIN r ON r.prio = t.prio WHERE t.rank <= 12""")
def f04(spark, sf):
    bins = cut_lineage(density_bins(b.points3(spark, sf), DENSITY_SIZES).withColumnRenamed("by", "by_"))
    ranked = rk.rank_rows(bins, "points", ["bz", "by_", "bx"]).select(
        F.col("rank").alias("prio"), "points", "bz", "by_", "bx", F.col("z_med").alias("z"), F.col("y_med").alias("y"), F.col("x_med").alias("x"))
    return rk.suppress_close(ranked, ["z", "y", "x"], "prio", 60.0, 12)


@register("f05_ordered_listing", "path:s bytes:i", f"WITH {b.MANIFEST} SELECT path, bytes FROM manifest ORDER BY path")
def f05(spark, sf):
    return b.manifest(spark, sf).select("path", "bytes").orderBy("path")


@register("g01_missing", "o_orderkey:i",
          "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def g01(spark, sf):
    lines = b.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return rk.missing(b.table(spark, sf, "orders"), lines, ["o_orderkey"])


@register("g02_same_keys",
          "left_keys:i right_keys:i only_left:i only_right:i left_duplicates:i right_duplicates:i same:b",
          """WITH a AS (SELECT o_orderkey AS k, count(*) AS n FROM orders GROUP BY 1), l AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1),
j AS (SELECT coalesce(a.n, 0) AS l, coalesce(l.n, 0) AS r FROM a FULL JOIN l ON a.k = l.k)
SELECT count(*) FILTER (WHERE l > 0) AS left_keys, count(*) FILTER (WHERE r > 0) AS right_keys,
 count(*) FILTER (WHERE l > 0 AND r = 0) AS only_left, count(*) FILTER (WHERE r > 0 AND l = 0) AS only_right,
 sum(greatest(l - 1, 0)) AS left_duplicates, sum(greatest(r - 1, 0)) AS right_duplicates,
 count(*) FILTER (WHERE l <> 1 OR r <> 1) = 0 AS same FROM j""")
def g02(spark, sf):
    left = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    return rk.same_keys(left, b.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


@register("g03_union_keys", "ky:i kx:i",
          f"""WITH {b.BOXES}, {b.MASK},
bk AS (SELECT ky, unnest(range(x0 // 16, (x1 - 1) // 16 + 1)) AS kx
       FROM (SELECT *, unnest(range(y0 // 16, (y1 - 1) // 16 + 1)) AS ky FROM boxes))
SELECT ky, kx FROM bk UNION SELECT y // 16, x // 16 FROM mask""")
def g03(spark, sf):
    from surfaudit.operators.joins import chunk_cover

    touched = chunk_cover(b.boxes(spark, sf), {"y": 16, "x": 16})
    px = b.mask(spark, sf).select(F.floor(F.col("y") / 16).alias("ky"), F.floor(F.col("x") / 16).alias("kx"))
    return rk.union_keys(touched, px)


@register("g04_mask_algebra", "y:i x:i in_both:b only_a:b",
          f"""WITH {b.MASK}, {b.TRUTH}, p AS (SELECT y, x FROM truth WHERE positive)
SELECT coalesce(m.y, p.y) AS y, coalesce(m.x, p.x) AS x, m.y IS NOT NULL AND p.y IS NOT NULL AS in_both, p.y IS NULL AS only_a
FROM mask m FULL JOIN p ON m.y = p.y AND m.x = p.x""")
def g04(spark, sf):
    return rk.mask_algebra(b.mask(spark, sf), b.truth(spark, sf).where("positive"), ["y", "x"])


@register("g05_concat_tagged", "y:i x:i tag:s",
          f"WITH {b.MASK}, {b.TRUTH} SELECT y, x, 'mask' AS tag FROM mask UNION ALL SELECT y, x, 'truth' FROM truth WHERE positive")
def g05(spark, sf):
    return rk.concat_tagged({"mask": b.mask(spark, sf), "truth": b.truth(spark, sf).where("positive").select("y", "x")})
