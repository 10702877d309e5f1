"""Alignment, lookup, sampling and range-join queries."""

from pyspark.sql import functions as F

from surfaudit.functions.scalar import vertex_valid
from surfaudit.operators import joins as jn, metrics as m, regions as rg
from surfaudit.plans import bindings as b
from surfaudit.plans.registry import register
from surfaudit.session import scratch
from surfaudit.sources.chunks import ChunkStore, assemble_pixels


@register("c01_align", "y:i x:i a:d b:d", f"WITH {b.CELLS}, {b.TWO_VIEWS} SELECT y, x, a, b FROM two")
def c01(spark, sf):
    px = b.cells(spark, sf)
    return jn.align(px.where("view_id = 1"), px.where("view_id = 2"))


@register("c02_pairs", "y:i x:i view_id_a:i view_id_b:i score_a:d score_b:d",
          f"""WITH {b.CELLS} SELECT a.y, a.x, a.view_id AS view_id_a, b.view_id AS view_id_b, a.score AS score_a, b.score AS score_b
FROM cells a JOIN cells b ON a.y = b.y AND a.x = b.x AND a.view_id < b.view_id AND a.grp <> b.grp""")
def c02(spark, sf):
    return jn.pairs(b.cells(spark, sf), ["y", "x"], "view_id", "grp", ["score"], salts=2)


@register("c03_require_match", "o_orderkey:i found:b",
          """SELECT o_orderkey, l.k IS NOT NULL AS found FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) l ON o_orderkey = l.k""")
def c03(spark, sf):
    present = b.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return jn.require_match(b.table(spark, sf, "orders").select("o_orderkey"), present, ["o_orderkey"])


@register("c04_with_dim", "c_custkey:i c_acctbal:d2 n_name:s r_name:s",
          """SELECT c_custkey, c_acctbal, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey""")
def c04(spark, sf):
    n = b.table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    r = b.table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return jn.with_dim(jn.with_dim(b.table(spark, sf, "customer"), n, ["c_nationkey"]), r, ["n_regionkey"])


@register("c05_with_cell", "v:i u:i pixels:i mean_z:d",
          f"""WITH {b.GRID}, {b.TRUTH}
SELECT v, u, count(*) AS pixels, avg(z) AS mean_z FROM (
  SELECT cast(floor(t.y / cast(5 AS DOUBLE)) AS INTEGER) AS pv, cast(floor(t.x / cast(5 AS DOUBLE)) AS INTEGER) AS pu FROM truth t) p
LEFT JOIN grid g ON g.v = p.pv AND g.u = p.pu GROUP BY v, u""")
def c05(spark, sf):
    joined = jn.with_cell(b.truth(spark, sf).select("y", "x"), b.grid(spark, sf).select("v", "u", "z"), 5)
    return joined.groupBy("v", "u").agg(F.count(F.lit(1)).alias("pixels"), F.avg("z").alias("mean_z"))


# Support lattice, five times coarser: a node holds where its whole block of vertices does.
def lattice(spark, sf):
    ok = vertex_valid(F.col("x"), F.col("y"), F.col("z"), "not_all_sentinel")
    return b.grid(spark, sf).groupBy(
        F.floor(F.col("v") / 5).cast("int").alias("v"), F.floor(F.col("u") / 5).cast("int").alias("u")
    ).agg(F.bool_and(ok).alias("ok"))


LATTICE = f"""{b.GRID}, lat AS (SELECT v // 5 AS v, u // 5 AS u, bool_and({b.NOT_ALL}) AS ok FROM grid GROUP BY 1, 2),
sh AS (SELECT max(v) + 1 AS h, max(u) + 1 AS w FROM lat), {b.TRUTH}, cs AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM truth)"""


def shapes(spark, sf):
    """Lattice and canvas shapes: four maxima, i.e. raster metadata."""
    lat = lattice(spark, sf).agg(F.max("v") + 1, F.max("u") + 1).first()
    px = b.truth(spark, sf).agg(F.max("y") + 1, F.max("x") + 1).first()
    return (lat[0], lat[1]), (px[0], px[1])


def supported(spark, sf):
    shape, canvas = shapes(spark, sf)
    px = b.truth(spark, sf).select("y", "x", "cy", "cx", "positive", "valid")
    return jn.sample_support(px, lattice(spark, sf), canvas, shape)


SUPPORT = f"""{LATTICE},
p AS (SELECT t.y, t.x, t.cy, t.cx, t.positive, t.valid, (t.y + cast(0.5 AS DOUBLE)) * sh.h / cs.h - cast(0.5 AS DOUBLE) AS gy,
      (t.x + cast(0.5 AS DOUBLE)) * sh.w / cs.w - cast(0.5 AS DOUBLE) AS gx, sh.h, sh.w FROM truth t, sh, cs),
k AS (SELECT *, greatest(0, least(h - 1, floor(gy))) AS v0, greatest(0, least(h - 1, ceil(gy))) AS v1,
      greatest(0, least(w - 1, floor(gx))) AS u0, greatest(0, least(w - 1, ceil(gx))) AS u1,
      greatest(0, least(h - 1, round_even(gy, 0))) AS vn, greatest(0, least(w - 1, round_even(gx, 0))) AS un FROM p),
sup AS (SELECT k.y, k.x, k.cy, k.cx, k.positive, k.valid, coalesce(n.ok, false) AS nearest,
  coalesce(a.ok, false) AND coalesce(b.ok, false) AND coalesce(c.ok, false) AND coalesce(d.ok, false) AS "all",
  coalesce(a.ok, false) OR coalesce(b.ok, false) OR coalesce(c.ok, false) OR coalesce(d.ok, false) AS "any"
  FROM k LEFT JOIN lat n ON n.v = vn AND n.u = un LEFT JOIN lat a ON a.v = v0 AND a.u = u0 LEFT JOIN lat b ON b.v = v0 AND b.u = u1
  LEFT JOIN lat c ON c.v = v1 AND c.u = u0 LEFT JOIN lat d ON d.v = v1 AND d.u = u1)"""


@register("c06_sample_support", "y:i x:i near_ok:b all_ok:b any_ok:b",
          f'WITH {SUPPORT} SELECT y, x, nearest AS near_ok, "all" AS all_ok, "any" AS any_ok FROM sup')
def c06(spark, sf):
    return supported(spark, sf).select(
        "y", "x", F.col("nearest").alias("near_ok"), F.col("all").alias("all_ok"), F.col("any").alias("any_ok"))


@register("d16_common_support", "policy:s cy:i cx:i eligible:i positive_px:i negative_px:i",
          f"""WITH {SUPPORT}, long AS (SELECT cy, cx, positive, 'all' AS policy, "all" AS ok FROM sup WHERE valid
 UNION ALL SELECT cy, cx, positive, 'nearest', nearest FROM sup WHERE valid UNION ALL SELECT cy, cx, positive, 'any', "any" FROM sup WHERE valid)
SELECT policy, cy, cx, sum(CASE WHEN ok THEN 1 ELSE 0 END) AS eligible, sum(CASE WHEN ok AND positive THEN 1 ELSE 0 END) AS positive_px,
 sum(CASE WHEN ok AND NOT positive THEN 1 ELSE 0 END) AS negative_px FROM long GROUP BY GROUPING SETS ((policy, cy, cx), (policy))""")
def d16(spark, sf):
    return rg.common_support(supported(spark, sf), ["all", "nearest", "any"], ["cy", "cx"])


@register("c07_resample_mask", "y:i x:i center_ok:b any_ok:b all_ok:b",
          f"""WITH {b.MASK}, sh AS (SELECT max(y) + 1 AS h FROM mask),
t AS (SELECT y, unnest(range(50)) AS x, h FROM (SELECT unnest(range(40)) AS y, h FROM sh)),
r AS (SELECT y, x, floor(y * h / cast(40 AS DOUBLE)) AS y0, ceil((y + 1) * h / cast(40 AS DOUBLE)) AS y1,
      floor(x * 125 / cast(50 AS DOUBLE)) AS x0, ceil((x + 1) * 125 / cast(50 AS DOUBLE)) AS x1,
      least(floor((y + cast(0.5 AS DOUBLE)) * h / 40), h - 1) AS yc, least(floor((x + cast(0.5 AS DOUBLE)) * 125 / 50), 124) AS xc FROM t)
SELECT r.y, r.x, coalesce(bool_or(m.y = yc AND m.x = xc), false) AS center_ok, count(m.y) > 0 AS any_ok,
       count(m.y) = max((y1 - y0) * (x1 - x0)) AS all_ok
FROM r LEFT JOIN mask m ON m.y >= y0 AND m.y < y1 AND m.x >= x0 AND m.x < x1 GROUP BY r.y, r.x""")
def c07(spark, sf):
    px = b.mask(spark, sf)
    height = px.agg(F.max("y") + 1).first()[0]
    return jn.resample_mask(px, (height, b.WIDTH), (40, 50)).select(
        "y", "x", F.col("center").alias("center_ok"), F.col("any").alias("any_ok"), F.col("all").alias("all_ok"))


C08 = f"""WITH {b.TRUTH}, sh AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM truth),
p AS (SELECT o_orderkey, o_custkey % 131 - cast(0.5 AS DOUBLE) + (o_orderkey % 4) / cast(4 AS DOUBLE) AS fy,
      o_custkey % 127 - cast(0.5 AS DOUBLE) + (o_orderkey % 3) / cast(4 AS DOUBLE) AS fx FROM orders),
k AS (SELECT *, fy - floor(fy) AS wy, fx - floor(fx) AS wx, greatest(0, least(h - 1, floor(fy))) AS v0, greatest(0, least(w - 1, floor(fx))) AS u0,
      CASE WHEN fy < 0 THEN 0 ELSE least(h - 1, greatest(0, least(h - 1, floor(fy))) + 1) END AS v1,
      CASE WHEN fx < 0 THEN 0 ELSE least(w - 1, greatest(0, least(w - 1, floor(fx))) + 1) END AS u1 FROM p, sh)
SELECT o_orderkey, a.area_um2 * (1 - wy) * (1 - wx) + b.area_um2 * (1 - wy) * wx + c.area_um2 * wy * (1 - wx) + d.area_um2 * wy * wx AS sample
FROM k JOIN truth a ON a.y = v0 AND a.x = u0 JOIN truth b ON b.y = v0 AND b.x = u1 JOIN truth c ON c.y = v1 AND c.x = u0 JOIN truth d ON d.y = v1 AND d.x = u1"""

@register("c08_sample_bilinear", "o_orderkey:i sample:d5",
          C08)
def c08(spark, sf):
    shape = b.truth(spark, sf).agg(F.max("y") + 1, F.max("x") + 1).first()
    points = bilinear_points(spark, sf).withColumnsRenamed({"py": "fy", "px": "fx"})
    return jn.sample_bilinear(points, b.truth(spark, sf), (shape[0], shape[1]), "area_um2")


def bilinear_points(spark, sf):
    half = F.lit(0.5)
    return b.table(spark, sf, "orders").select(
        "o_orderkey",
        (F.col("o_custkey") % 131 - half + (F.col("o_orderkey") % 4) / F.lit(4.0)).alias("py"),
        (F.col("o_custkey") % 127 - half + (F.col("o_orderkey") % 3) / F.lit(4.0)).alias("px"))


@register("c08_sample_stored", "o_orderkey:i sample:d5",
          C08)
def c08_stored(spark, sf):
    image = b.truth(spark, sf)
    shape = image.agg(F.max("y") + 1, F.max("x") + 1).first()
    store = ChunkStore(scratch(spark, "image"), ("y", "x"), 32).write(image, "area_um2")
    return store.sample(bilinear_points(spark, sf), ["o_orderkey"], shape=(shape[0], shape[1]))


def probe_points(spark, sf):
    """Surface points inside the seven-layer volume, off the lattice by quarters."""
    quarter = lambda c, n: (F.col(c) % n) / F.lit(4.0)
    return b.table(spark, sf, "orders").select(
        "o_orderkey",
        (F.lit(2.0) + quarter("o_custkey", 5)).alias("pz"),
        (F.floor(F.col("o_orderkey") / b.WIDTH) + quarter("o_custkey", 3)).alias("py"),
        (F.col("o_orderkey") % b.WIDTH + quarter("o_custkey", 4)).alias("px"))


PROBE = f"""probe AS (SELECT o_orderkey, 2 + (o_custkey % 5) / cast(4 AS DOUBLE) AS pz,
  floor(o_orderkey / cast({b.WIDTH} AS DOUBLE)) + (o_custkey % 3) / cast(4 AS DOUBLE) AS py,
  o_orderkey % {b.WIDTH} + (o_custkey % 4) / cast(4 AS DOUBLE) AS px FROM orders)"""


C09 = f"""WITH {b.VOXELS}, {PROBE},
c AS (SELECT o_orderkey, pz, py, px, unnest(range(8)) AS i FROM probe),
w AS (SELECT o_orderkey, floor(pz) + i % 2 AS z, floor(py) + (i // 2) % 2 AS y, floor(px) + i // 4 AS x,
  (CASE WHEN i % 2 = 1 THEN pz - floor(pz) ELSE 1 - (pz - floor(pz)) END) * (CASE WHEN (i // 2) % 2 = 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END)
  * (CASE WHEN i // 4 = 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END) AS w FROM c)
SELECT o_orderkey, sum(w * coalesce(v, 0)) AS sample FROM w LEFT JOIN voxels v ON v.z = w.z AND v.y = w.y AND v.x = w.x GROUP BY o_orderkey"""


@register("c09_sample_trilinear", "o_orderkey:i sample:d",
          C09)
def c09(spark, sf):
    return jn.sample_volume(probe_points(spark, sf), b.voxels(spark, sf), ["o_orderkey"])


@register("c09_sample_stored", "o_orderkey:i sample:d",
          C09)
def c09_stored(spark, sf):
    return jn.sample_volume(probe_points(spark, sf), voxel_store(spark, sf), ["o_orderkey"])


def voxel_store(spark, sf):
    return ChunkStore(scratch(spark, "voxels"), size=16, slab=2).write(b.voxels(spark, sf), "v")


@register("c09_sample_nearest", "o_orderkey:i sample:d",
          f"""WITH {b.VOXELS}, {PROBE}
SELECT o_orderkey, coalesce(v, 0) AS sample FROM probe LEFT JOIN voxels v
ON v.z = round_even(pz, 0) AND v.y = round_even(py, 0) AND v.x = round_even(px, 0)""")
def c09_nearest(spark, sf):
    return jn.sample_volume(probe_points(spark, sf), b.voxels(spark, sf), ["o_orderkey"], "nearest")


@register("c10_shifted_join", "dy:i dx:i n:i pearson:d9",
          f"""WITH {b.CELLS}, {b.TWO_VIEWS}, s AS (SELECT * FROM (VALUES (0, 0), (3, 0), (0, 5), (-4, 2)) t(dy, dx))
SELECT dy, dx, count(*) AS n, corr(p.a, q.b) AS pearson FROM s JOIN two q ON true JOIN two p ON p.y = q.y + dy AND p.x = q.x + dx GROUP BY dy, dx""")
def c10(spark, sf):
    shifted = jn.shifted_views(b.two_views(spark, sf), [(0, 0), (3, 0), (0, 5), (-4, 2)])
    return m.pearson(shifted, "a", "b", ["dy", "dx"])


@register("c10_shifted_by_surface", "surface:i dy:i dx:i n:i a:d b:d",
          f"""WITH {b.SURFACES}, s AS (SELECT * FROM (VALUES (0, 0), (3, 0), (0, 5), (-4, 2)) t(dy, dx))
SELECT p.surface, dy, dx, count(*) AS n, avg(p.a) AS a, avg(q.b) AS b FROM s JOIN surfaces q ON true
JOIN surfaces p ON p.surface IS NOT DISTINCT FROM q.surface AND p.y = q.y + dy AND p.x = q.x + dx GROUP BY p.surface, dy, dx""")
def c10_by_surface(spark, sf):
    shifted = jn.shifted_views(b.surfaces(spark, sf), [(0, 0), (3, 0), (0, 5), (-4, 2)], ["surface"])
    return shifted.groupBy("surface", "dy", "dx").agg(F.count("*").alias("n"), F.avg("a").alias("a"), F.avg("b").alias("b"))


COVER = """cover AS (SELECT *, unnest(range(x0 // 16, (x1 - 1) // 16 + 1)) AS kx
  FROM (SELECT *, unnest(range(y0 // 16, (y1 - 1) // 16 + 1)) AS ky FROM boxes)),
area AS (SELECT *, (least(y1, (ky + 1) * 16) - greatest(y0, ky * 16)) * (least(x1, (kx + 1) * 16) - greatest(x0, kx * 16)) AS a FROM cover)"""


@register("c11_overlap_fraction", "ky:i kx:i boxes:i covered:d",
          f"WITH {b.BOXES}, {COVER} SELECT ky, kx, count(*) AS boxes, sum(a) / cast(256 AS DOUBLE) AS covered FROM area GROUP BY ky, kx")
def c11(spark, sf):
    return jn.overlap_fraction(b.boxes(spark, sf), 16)


@register("c11_overlapping_cells", "y:i kx:i length:i distinct_px:i",
          f"""WITH {b.BOXES}, p AS (SELECT y, unnest(range(x0, x1)) AS x FROM (SELECT *, unnest(range(y0, y1)) AS y FROM boxes))
SELECT y, x // 32 AS kx, count(*) AS length, count(DISTINCT x) AS distinct_px FROM p GROUP BY 1, 2 HAVING count(*) > count(DISTINCT x)""")
def c11_cells(spark, sf):
    return jn.overlapping_cells(b.boxes(spark, sf))


@register("c12_chunk_cover", "ky:i kx:i", f"WITH {b.BOXES}, {COVER} SELECT DISTINCT ky, kx FROM cover")
def c12(spark, sf):
    return jn.chunk_cover(b.boxes(spark, sf), {"y": 16, "x": 16})


@register("c13_assemble_window", "box_id:i chunks:i present:i area:i supplied:i complete:b",
          f"""WITH {b.BOXES}, {COVER}, {b.TRUTH}, ch AS (SELECT DISTINCT y // 16 AS ky, x // 16 AS kx FROM truth)
SELECT box_id, count(*) AS chunks, count(ch.ky) AS present, sum(a) AS area, coalesce(sum(CASE WHEN ch.ky IS NOT NULL THEN a END), 0) AS supplied,
  sum(a) = coalesce(sum(CASE WHEN ch.ky IS NOT NULL THEN a END), 0) AS complete
FROM area LEFT JOIN ch ON ch.ky = area.ky AND ch.kx = area.kx GROUP BY box_id""")
def c13(spark, sf):
    chunks = b.truth(spark, sf).select(F.floor(F.col("y") / 16).alias("ky"), F.floor(F.col("x") / 16).alias("kx")).distinct()
    return jn.assemble_window(b.boxes(spark, sf), chunks, 16)


@register("c13_assemble_pixels", "box_id:i y:i x:i value:d covered:b",
          f"""WITH {b.BOXES}, {b.TRUTH}, ch AS (SELECT DISTINCT y // 16 AS ky, x // 16 AS kx FROM truth),
line AS (SELECT box_id, unnest(range(y0, y1)) AS y, x0, x1 FROM boxes), px AS (SELECT box_id, y, unnest(range(x0, x1)) AS x FROM line)
SELECT box_id, px.y, px.x, t.area_um2 AS value, ch.ky IS NOT NULL AS covered
FROM px LEFT JOIN truth t ON t.y = px.y AND t.x = px.x LEFT JOIN ch ON ch.ky = px.y // 16 AND ch.kx = px.x // 16""")
def c13_pixels(spark, sf):
    store = ChunkStore(scratch(spark, "truth"), ("y", "x"), 16).write(b.truth(spark, sf), "area_um2")
    boxes = b.boxes(spark, sf)
    return assemble_pixels(boxes, store.chunks(jn.chunk_cover(boxes, {"y": 16, "x": 16})), 16)


@register("c14_pair_uv", "v:i u:i tv:i tu:i sx:d tx:d",
          f"""WITH {b.GRID}, sh AS (SELECT max(v) + 1 AS h, max(u) + 1 AS w FROM grid),
tg AS (SELECT v // 2 AS v, u // 2 AS u, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM grid WHERE {b.NOT_ALL} GROUP BY 1, 2),
ts AS (SELECT (h + 1) // 2 AS h, (w + 1) // 2 AS w FROM sh),
s AS (SELECT g.*, round_even(v * cast(ts.h - 1 AS DOUBLE) / (sh.h - 1), 0) AS tv, round_even(u * cast(ts.w - 1 AS DOUBLE) / (sh.w - 1), 0) AS tu
  FROM grid g, sh, ts WHERE v % 4 = 0 AND u % 4 = 0 AND {b.NOT_ALL})
SELECT s.v, s.u, s.tv, s.tu, s.x AS sx, tg.x AS tx FROM s JOIN tg ON tg.v = s.tv AND tg.u = s.tu""")
def c14(spark, sf):
    return uv_pairs(spark, sf, 4)


def uv_pairs(spark, sf, stride):
    g = b.grid(spark, sf)
    h, w = g.agg(F.max("v") + 1, F.max("u") + 1).first()
    ok = vertex_valid(F.col("x"), F.col("y"), F.col("z"), "not_all_sentinel")
    # The target grid is half as dense: mean position of each 2 x 2 block of valid vertices.
    target = g.where(ok).groupBy(
        F.floor(F.col("v") / 2).cast("int").alias("v"), F.floor(F.col("u") / 2).cast("int").alias("u")
    ).agg(*[F.avg(c).alias(c) for c in "xyz"])
    return jn.pair_uv(g.where(ok), target, (h, w), ((h + 1) // 2, (w + 1) // 2), stride)


@register("c15_nearest_boxes", "point_id:i box_id:i distance:d volume:d rank:i",
          f"""WITH {b.BOXES}, p AS (SELECT c_custkey AS point_id, cast(c_custkey % 173 AS DOUBLE) AS y, cast(c_custkey * 31 % 167 AS DOUBLE) AS x FROM customer),
d AS (SELECT point_id, box_id, sqrt(pow(greatest(y0 - y, y - y1, 0), 2) + pow(greatest(x0 - x, x - x1, 0), 2)) AS distance,
      cast((y1 - y0) * (x1 - x0) AS DOUBLE) AS volume FROM p, boxes)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY distance, volume, box_id) AS rank FROM d) WHERE rank <= 3""")
def c15(spark, sf):
    points = b.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("point_id"), (F.col("c_custkey") % 173).cast("double").alias("y"),
        (F.col("c_custkey") * 31 % 167).cast("double").alias("x"))
    return jn.nearest_boxes(points, b.boxes(spark, sf), ["y", "x"], 3, 8.0)


@register("c17_validate_reviews", "candidate_id:i problem:s times:i",
          f"""WITH {b.REVIEWS}, q AS (SELECT DISTINCT c_custkey AS candidate_id FROM customer), s AS (SELECT candidate_id, count(*) AS n FROM reviews GROUP BY 1),
k AS (SELECT coalesce(q.candidate_id, s.candidate_id) AS candidate_id, CASE WHEN s.n IS NULL THEN 'not_reviewed'
   WHEN q.candidate_id IS NULL THEN 'not_queued' WHEN s.n > 1 THEN 'repeated' END AS problem FROM q FULL JOIN s ON q.candidate_id = s.candidate_id),
r AS (SELECT candidate_id, 'invalid_response' AS problem FROM reviews WHERE response NOT IN ('view', 'click')
   UNION ALL SELECT candidate_id, 'invalid_confidence' FROM reviews WHERE NOT confidence BETWEEN 1 AND 5
   UNION ALL SELECT candidate_id, 'invalid_seconds' FROM reviews WHERE NOT seconds >= 0)
SELECT candidate_id, problem, count(*) AS times FROM (SELECT * FROM k WHERE problem IS NOT NULL UNION ALL SELECT * FROM r) GROUP BY 1, 2""")
def c17(spark, sf):
    queue = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("candidate_id"))
    return jn.validate_reviews(queue, b.reviews(spark, sf), "candidate_id", ["view", "click"])
