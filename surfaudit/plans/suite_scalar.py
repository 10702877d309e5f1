"""Column-function queries."""

from pyspark.sql import functions as F

from surfaudit.functions import scalar as sc
from surfaudit.operators import depth
from surfaudit.plans import bindings as b
from surfaudit.plans.registry import register


@register("b01_normalize", "o_orderkey:i norm:d",
          """SELECT o_orderkey, greatest(0, least(1, (o_totalprice - cast(1000 AS DOUBLE)) / cast(250000 AS DOUBLE))) AS norm FROM orders""")
def b01(spark, sf):
    return b.table(spark, sf, "orders").select("o_orderkey", sc.normalize(F.col("o_totalprice"), 1000, 251000).alias("norm"))


@register("b02_valid_score", "y:i x:i score:d",
          f"WITH {b.TRUTH} SELECT y, x, CASE WHEN valid THEN area_um2 END AS score FROM truth")
def b02(spark, sf):
    return b.truth(spark, sf).select("y", "x", sc.valid_score(F.col("area_um2"), F.col("valid")).alias("score"))


@register("b03_vertex_valid", "v:i u:i strict:b partial:b positive:b",
          f"""WITH {b.GRID} SELECT v, u, {b.STRICT} AS strict, {b.NOT_ALL} AS partial, (x > 0 AND y > 0 AND z > 0) AS positive FROM grid""")
def b03(spark, sf):
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return b.grid(spark, sf).select("v", "u", sc.vertex_valid(x, y, z).alias("strict"),
                                    sc.vertex_valid(x, y, z, "not_all_sentinel").alias("partial"),
                                    sc.vertex_valid(x, y, z, "positive").alias("positive"))


@register("b04_region_ids", "y:i x:i region:s block:s",
          f"""WITH {b.TRUTH} SELECT y, x,
 'y' || lpad(cast(y // 16 * 16 AS VARCHAR), 5, '0') || '_x' || lpad(cast(x // 16 * 16 AS VARCHAR), 5, '0') AS region,
 'by' || lpad(cast(y // 64 AS VARCHAR), cast(greatest(2, length(cast(y // 64 AS VARCHAR))) AS INTEGER), '0') || '_bx' || lpad(cast(x // 64 AS VARCHAR), 2, '0') AS block FROM truth""")
def b04(spark, sf):
    y, x = F.col("y"), F.col("x")
    return b.truth(spark, sf).select("y", "x", sc.region_id(y, x, 16).alias("region"), sc.block_id(y, x, 64).alias("block"))


@register("b05_parse_names", "doc_id:i cy:i cx:i volume:i um:s kev:i block_row:i",
          """WITH n AS (SELECT doc_id, source || '/0.' || cast(doc_id % 17 AS VARCHAR) || CASE WHEN doc_id % 5 = 0 THEN '' ELSE '.' || cast(doc_id % 13 AS VARCHAR) END AS chunk,
  'x/volume-' || cast(doc_id AS VARCHAR) || '.zarr' AS url, cast(doc_id AS VARCHAR) || '-2.4um-' || CASE WHEN doc_id % 3 = 0 THEN '53keV-a' WHEN doc_id % 3 = 1 THEN '53keV' ELSE 'none' END AS vol,
  'by' || lpad(cast(doc_id % 40 AS VARCHAR), 2, '0') || '_bx01' AS block FROM documents)
SELECT doc_id, cast(nullif(regexp_extract(chunk, '/0\\.(\\d+)\\.(\\d+)$', 1), '') AS BIGINT) AS cy, cast(nullif(regexp_extract(chunk, '/0\\.(\\d+)\\.(\\d+)$', 2), '') AS BIGINT) AS cx,
 cast(nullif(regexp_extract(url, 'volume-(\\d+)', 1), '') AS BIGINT) AS volume, nullif(regexp_extract(vol, '^(\\d+)-(\\d+(\\.\\d+)?)um-', 2), '') AS um,
 cast(nullif(regexp_extract(vol, '-(\\d+)keV-', 1), '') AS BIGINT) AS kev, cast(regexp_extract(block, '^by(\\d+)_', 1) AS BIGINT) AS block_row FROM n""")
def b05(spark, sf):
    i, text = F.col("doc_id"), lambda c: c.cast("string")
    n = b.table(spark, sf, "documents").select(
        "doc_id",
        F.concat("source", F.lit("/0."), text(i % 17), F.when(i % 5 == 0, "").otherwise(F.concat(F.lit("."), text(i % 13)))).alias("chunk"),
        F.concat(F.lit("x/volume-"), text(i), F.lit(".zarr")).alias("url"),
        F.concat(text(i), F.lit("-2.4um-"), F.when(i % 3 == 0, "53keV-a").when(i % 3 == 1, "53keV").otherwise("none")).alias("vol"),
        F.concat(F.lit("by"), F.lpad(text(i % 40), 2, "0"), F.lit("_bx01")).alias("block"))
    cy, cx = sc.chunk_key(F.col("chunk"))
    return n.select("doc_id", cy.alias("cy"), cx.alias("cx"), sc.parse_int(F.col("url"), sc.VOLUME_IN_URL).alias("volume"),
                    sc.parse_required(F.col("vol"), sc.VOLUME_NAME, 2).alias("um"), sc.parse_int(F.col("vol"), sc.ENERGY_NAME).alias("kev"),
                    sc.parse_int(F.col("block"), sc.BLOCK_ROW).alias("block_row"))


@register("b06_rewrite_urls", "page_id:i https:s host:s prefix:s",
          """SELECT page_id, CASE WHEN starts_with(s3, 's3://') THEN 'https://' || split_part(substr(s3, 6), '/', 1) || '.s3.amazonaws.com/' || substr(s3, 6 + length(split_part(substr(s3, 6), '/', 1)) + 1) ELSE s3 END AS https,
  nullif(regexp_extract(url, '^[a-z0-9]+://([^/?#:]+)', 1), '') AS host,
  CASE WHEN contains(key, '/surface/') THEN split_part(key, '/surface/', 1) END AS prefix
FROM (SELECT page_id, url, 's3://bucket' || cast(page_id % 7 AS VARCHAR) || '/seg' || cast(page_id AS VARCHAR) || CASE WHEN page_id % 2 = 0 THEN '/surface/' ELSE '/mesh/' END || 'a.zarr' AS s3,
   'seg' || cast(page_id AS VARCHAR) || CASE WHEN page_id % 2 = 0 THEN '/surface/' ELSE '/mesh/' END || 'a.zarr' AS key FROM pages)""")
def b06(spark, sf):
    i = F.col("page_id").cast("string")
    s3 = F.concat(F.lit("s3://bucket"), (F.col("page_id") % 7).cast("string"), F.lit("/seg"), i,
                  F.when(F.col("page_id") % 2 == 0, "/surface/").otherwise("/mesh/"), F.lit("a.zarr"))
    return b.table(spark, sf, "pages").select("page_id", sc.s3_to_https(s3).alias("https"), sc.url_host(F.col("url")).alias("host"),
                                              sc.path_prefix(s3, "/surface/").alias("prefix"))


@register("b07_affine", "z:d y:d x:d n:i",
          f"""WITH {b.POINTS3} SELECT 2 * z + 5 AS z, 3 * y + cast(0.5 AS DOUBLE) * x + 6 AS y, 4 * x + 7 AS x, count(*) AS n FROM points3 GROUP BY z, points3.y, points3.x""")
def b07(spark, sf):
    matrix = [[2, 0, 0, 5], [0, 3, 0.5, 6], [0, 0, 4, 7], [0, 0, 0, 1]]
    z, y, x = sc.affine(matrix, F.col("z"), F.col("y"), F.col("x"))
    return b.points3(spark, sf).groupBy("z", "y", "x").agg(F.count(F.lit(1)).alias("n")).select(
        z.alias("z"), y.alias("y"), x.alias("x"), "n")


@register("b08_levels", "l_partkey:i center:d level:d rounded:i",
          """SELECT DISTINCT l_partkey, cast(l_partkey * 128 + 64 AS DOUBLE) AS center, l_partkey / cast(8 AS DOUBLE) AS level, round_even(l_partkey / cast(8 AS DOUBLE), 0) AS rounded FROM lineitem""")
def b08(spark, sf):
    k = F.col("l_partkey")
    return b.table(spark, sf, "lineitem").select("l_partkey").distinct().select(
        "l_partkey", sc.chunk_center(k, 128).alias("center"), sc.to_level(k, 3).alias("level"), sc.to_level(k, 3, True).alias("rounded"))


@register("b09_centered_bounds", "box_id:i lo:i hi:i inside:b",
          f"WITH {b.BOXES} SELECT box_id, greatest(y0 - 16, 0) AS lo, least(y0 + 16, 90) AS hi, greatest(y0 - 16, 0) < least(y0 + 16, 90) AS inside FROM boxes")
def b09(spark, sf):
    lo, hi = sc.centered_bounds(F.col("y0"), 32, 90)
    return b.boxes(spark, sf).select("box_id", lo.alias("lo"), hi.alias("hi"), (lo < hi).alias("inside"))


@register("b10_map_bounds", "box_id:i lo:i hi:i",
          f"WITH {b.BOXES} SELECT box_id, floor(y0 * cast(37 AS DOUBLE) / 160) AS lo, ceil(y1 * cast(37 AS DOUBLE) / 160) AS hi FROM boxes")
def b10(spark, sf):
    lo, hi = sc.map_bounds(F.col("y0"), F.col("y1"), 160, 37)
    return b.boxes(spark, sf).select("box_id", lo.alias("lo"), hi.alias("hi"))


@register("b11_box_distance", "box_id:i distance:d volume:d",
          f"""WITH {b.BOXES} SELECT box_id, sqrt(pow(greatest(y0 - 50, 50 - y1, 0), 2) + pow(greatest(x0 - 60, 60 - x1, 0), 2)) AS distance,
cast((y1 - y0) * (x1 - x0) AS DOUBLE) AS volume FROM boxes""")
def b11(spark, sf):
    lo, hi = [F.col("y0"), F.col("x0")], [F.col("y1"), F.col("x1")]
    return b.boxes(spark, sf).select("box_id", sc.box_distance([F.lit(50), F.lit(60)], lo, hi).alias("distance"),
                                     sc.box_volume(lo, hi).alias("volume"))


@register("b12_profile_features",
          "pixel:i mean:d std:d min:d max:d range:d argmax:i slope:d center_contrast:d",
          f"""WITH {b.PROFILES},
v AS (SELECT pixel, len(layers) AS n, unnest(range(len(layers))) AS i, cast(unnest(layers) AS DOUBLE) AS v FROM profiles)
SELECT pixel, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS "min", max(v) AS "max", max(v) - min(v) AS "range", min(i) FILTER (WHERE v = m) AS argmax,
  sum(v * (i - (n - 1) / cast(2 AS DOUBLE))) / sum(pow(i - (n - 1) / cast(2 AS DOUBLE), 2)) AS slope,
  avg(v) FILTER (WHERE i >= n // 4 AND i < n - n // 4) - avg(v) FILTER (WHERE i < n // 4 OR i >= n - n // 4) AS center_contrast
FROM (SELECT *, max(v) OVER (PARTITION BY pixel) AS m FROM v) GROUP BY pixel""")
def b12(spark, sf):
    f = sc.profile_features(F.col("layers"))
    return b.profiles(spark, sf).select("pixel", *[c.alias(k) for k, c in f.items()])


@register("b13_depth_features", "y:i x:i depth_mean:d depth_max:d depth_std:d central_contrast:d",
          f"""WITH {b.VOXELS} SELECT y, x, avg(v) AS depth_mean, max(v) AS depth_max, stddev_pop(v) AS depth_std,
avg(v) FILTER (WHERE z >= 2 AND z < 5) - avg(v) FILTER (WHERE z < 2 OR z >= 5) AS central_contrast FROM voxels GROUP BY y, x""")
def b13(spark, sf):
    return depth.depth_features(b.voxels(spark, sf), 2, 5)


@register("b14_pool_depth", "y:i x:i plane:i v:i",
          f"""WITH {b.VOXELS}, p AS (SELECT y, x, unnest(range(3)) AS plane FROM (SELECT DISTINCT y, x FROM voxels))
SELECT p.y, p.x, plane, round_even(coalesce(sum(v), 0) / cast(2 AS DOUBLE), 0) AS v FROM p LEFT JOIN voxels AS x ON x.y = p.y AND x.x = p.x AND x.z >= 1 AND x.z < 7 AND (x.z - 1) // 2 = plane GROUP BY 1, 2, 3""")
def b14(spark, sf):
    return depth.pool_depth(b.voxels(spark, sf), 7, 3, 2)


@register("b15_fuse", "y:i x:i mean:d disagreement:d geometric:d",
          f"""WITH {b.CELLS}, {b.TWO_VIEWS} SELECT y, x, (a + b) / 2 AS mean, abs(a - b) AS disagreement,
sqrt(greatest(0, least(1, a)) * greatest(0, least(1, b))) AS geometric FROM two""")
def b15(spark, sf):
    a, c = F.col("a"), F.col("b")
    return b.two_views(spark, sf).select("y", "x", *[sc.fuse(a, c, h).alias(h) for h in ("mean", "disagreement", "geometric")])


@register("b16_extent_ratio", "box_id:i ratio_y:d ratio_x:d axes:s scale:d",
          f"""WITH {b.BOXES}, e AS (SELECT box_id, round((y1 - y0) * cast(2.4 AS DOUBLE), 6) AS ay, round((x1 - x0) * cast(2.4 AS DOUBLE), 6) AS ax,
  round((x1 - x0) * cast(3.2 AS DOUBLE), 6) AS by_, round((y1 - y0) * cast(3.2 AS DOUBLE), 6) AS bx FROM boxes)
SELECT box_id, least(ay, by_) / greatest(ay, by_) AS ratio_y, least(ax, bx) / greatest(ax, bx) AS ratio_x, '["y","x"]' AS axes, 2.4 AS scale FROM e""")
def b16(spark, sf):
    h, w = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    scale = lambda s: F.array(sc.lit(s), sc.lit(s))
    ratio = sc.extent_ratio(F.array(h, w), scale(2.4), F.array(w, h), scale(3.2))
    transforms = F.array(F.struct(F.lit("translation").alias("type"), sc.lit(0).alias("s")), F.struct(F.lit("scale").alias("type"), sc.lit(2.4).alias("s")))
    first = F.get(F.filter(transforms, lambda t: t["type"] == "scale"), F.lit(0))
    return b.boxes(spark, sf).select("box_id", F.get(ratio, F.lit(0)).alias("ratio_y"), F.get(ratio, F.lit(1)).alias("ratio_x"),
                                     F.to_json(F.array(F.lit("y"), F.lit("x"))).alias("axes"), first["s"].alias("scale"))


@register("b17_shortfall", "y:i x:i shortfall:d",
          f"WITH {b.CELLS}, {b.TWO_VIEWS} SELECT y, x, greatest(0, cast(0.6 AS DOUBLE) - a, cast(0.6 AS DOUBLE) - b) AS shortfall FROM two")
def b17(spark, sf):
    return b.two_views(spark, sf).select("y", "x", sc.shortfall(0.6, F.col("a"), F.col("b")).alias("shortfall"))


@register("b18_tile_grid", "box_id:i start:i weight:d",
          f"""WITH {b.BOXES}, s AS (SELECT unnest(list_sort(list_distinct(list_append(range(0, 100 - 24 + 1, 10), 100 - 24)))) AS start)
SELECT box_id, start, cast(0.5 AS DOUBLE) - cast(0.5 AS DOUBLE) * cos(2 * pi() * (y0 - start) / 23) AS weight FROM boxes JOIN s ON y0 >= start AND y0 < start + 24""")
def b18(spark, sf):
    tiles = b.boxes(spark, sf).select("box_id", "y0", F.explode(sc.tile_starts(100, 24, 10)).alias("start"))
    return tiles.where((F.col("y0") >= F.col("start")) & (F.col("y0") < F.col("start") + 24)).select(
        "box_id", "start", sc.hann(F.col("y0") - F.col("start"), 24).alias("weight"))


@register("b20_edge_chunk", "box_id:i extent:i bytes:i",
          f"""WITH {b.BOXES}, k AS (SELECT box_id, y0 // 16 AS ky, x0 // 16 AS kx FROM boxes)
SELECT box_id, CASE WHEN 90 - ky * 16 > 0 THEN least(16, 90 - ky * 16) END AS extent,
 CASE WHEN 90 - ky * 16 > 0 AND 90 - kx * 16 > 0 THEN 7 * least(16, 90 - ky * 16) * least(16, 90 - kx * 16) END AS bytes FROM k""")
def b20(spark, sf):
    ky, kx = sc.floor_div(F.col("y0"), 16), sc.floor_div(F.col("x0"), 16)
    h, w = sc.edge_chunk(ky, 16, 90), sc.edge_chunk(kx, 16, 90)
    return b.boxes(spark, sf).select("box_id", h.alias("extent"), (h * w * 7).alias("bytes"))
