"""Independence, component, grid, burden and morphology queries."""

from pyspark.sql import functions as F

from surfaudit.operators import components as cc, grid as gr, independence as ind, physical as ph, probe
from surfaudit.operators.geometry_audit import Criteria, Volume, geometry_audit
from surfaudit.plans import bindings as b
from surfaudit.plans.registry import register
from surfaudit.plans.suite_joins import uv_pairs, voxel_store


def four_sql(cells: str, out: str, keys: str = "", extra: str = "") -> str:
    """4-connected components; neighbours by equi-joins so that whole rasters stay cheap."""
    k = f"{keys}, " if keys else ""
    ks = [c.strip() for c in keys.split(",") if c.strip()]
    on = "".join(f" AND a.{c} = b.{c}" for c in ks) + extra
    a_k = "".join(f"a.{c}, " for c in ks)
    r_k = "".join(f"r.{c}, " for c in ks)
    on_r = "".join(f" AND r.{c} = e.{c}" for c in ks)
    arms = " UNION ALL ".join(
        f"SELECT {a_k}a.id AS src, b.id AS dst FROM {out}_n a JOIN {out}_n b ON b.y = a.y + {dy} AND b.x = a.x + {dx}{on}"
        for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0)))
    return f"""{out}_n AS (SELECT *, y * 2147483648 + x AS id FROM {cells}),
{out}_e AS ({arms}),
{out}_r AS (SELECT {k}id, id AS lab FROM {out}_n UNION SELECT {r_k}e.dst, r.lab FROM {out}_r r JOIN {out}_e e ON r.id = e.src{on_r} AND r.lab < e.dst),
{out} AS (SELECT {k}id, min(lab) AS component FROM {out}_r GROUP BY {k}id)"""


def dense_sql(cells: str, out: str, dims: int, keys: str = "", full: bool = True, rounds: int = 9, hops: int = 7) -> str:
    """Components by hooking every label to the smallest one next to it and jumping along labels.

    Large components stay cheap, unlike a recursion over (cell, label) pairs.  A round at least
    halves the labels that still touch; the rounds and hops given are more than the rasters need.
    """
    ks = [c.strip() for c in keys.split(",") if c.strip()]
    k = "".join(f"{c}, " for c in ks)
    on = "".join(f" AND a.{c} IS NOT DISTINCT FROM b.{c}" for c in ks)
    axes = ["z", "y", "x"][-dims:]
    cell = "cast(y AS BIGINT) * 2147483648 + x" if dims == 2 else "cast(z AS BIGINT) * 4398046511104 + cast(y AS BIGINT) * 2097152 + x"
    offs = ", ".join(f"d{a}" for a in axes)
    table = " CROSS JOIN ".join(f"(SELECT unnest([-1, 0, 1]) AS d{a})" for a in axes)
    join = " AND ".join(f"b.{a} = a.{a} + o.d{a}" for a in axes)
    size = " + ".join(f"abs(d{a})" for a in axes)
    order = "".join(f"{c} NULLS FIRST, " for c in ks)
    parts = [f"""{out}_n AS MATERIALIZED (SELECT *, {cell} AS cell, row_number() OVER (ORDER BY {order}{cell}) AS id FROM {cells}),
{out}_o AS (SELECT {offs} FROM {table} WHERE {size} {">= 1" if full else "= 1"}),
{out}_e AS MATERIALIZED (SELECT a.id AS src, b.id AS dst FROM {out}_n a CROSS JOIN {out}_o o JOIN {out}_n b ON {join}{on}),
{out}_l0 AS MATERIALIZED (SELECT id, id AS lab FROM {out}_n)"""]
    for r in range(rounds):
        parts.append(f"""{out}_m{r} AS MATERIALIZED (SELECT l.lab AS r, min(n.lab) AS p FROM {out}_e e JOIN {out}_l{r} l ON l.id = e.src JOIN {out}_l{r} n ON n.id = e.dst
  WHERE n.lab < l.lab GROUP BY l.lab),
{out}_p{r}_0 AS MATERIALIZED (SELECT k.lab AS r, coalesce(m.p, k.lab) AS p FROM (SELECT DISTINCT lab FROM {out}_l{r}) k LEFT JOIN {out}_m{r} m ON m.r = k.lab)""")
        parts += [f"{out}_p{r}_{h + 1} AS MATERIALIZED (SELECT a.r, b.p FROM {out}_p{r}_{h} a JOIN {out}_p{r}_{h} b ON b.r = a.p)" for h in range(hops)]
        parts.append(f"{out}_l{r + 1} AS MATERIALIZED (SELECT l.id, p.p AS lab FROM {out}_l{r} l JOIN {out}_p{r}_{hops} p ON p.r = l.lab)")
    parts.append(f"{out} AS (SELECT {''.join('n.' + c + ', ' for c in ks)}n.cell AS id, f.cell AS component FROM {out}_n n JOIN {out}_l{rounds} l ON l.id = n.id JOIN {out}_n f ON f.id = l.lab)")
    return ",\n".join(parts)


# -- independence -------------------------------------------------------------------------


def audit_sql(acquisition: str) -> str:
    return f"""WITH RECURSIVE {b.VIEWS},
w AS (SELECT ord, grp, {acquisition} AS acquisition, n AS nation FROM (SELECT *, grp AS n FROM views)),
f AS (SELECT grp, min(ord) AS g FROM w GROUP BY grp),
l AS (SELECT DISTINCT f.g, w.acquisition AS value FROM w JOIN f ON w.grp = f.grp),
e AS (SELECT a.g AS src, c.g AS dst FROM l a JOIN l c ON a.g <> c.g AND (a.value = c.value OR a.value IS NULL OR c.value IS NULL)),
r AS (SELECT g, g AS lab FROM f UNION SELECT e.dst, r.lab FROM r JOIN e ON r.g = e.src AND r.lab < e.dst),
c AS (SELECT g, min(lab) AS root FROM r GROUP BY g),
eff AS (SELECT f.grp, dense_rank() OVER (ORDER BY c.root) AS effective FROM f JOIN c ON f.g = c.g)"""


@register("i01_effective_groups", "grp:s effective:i", audit_sql("acquisition") + " SELECT grp, effective FROM eff")
def i01(spark, sf):
    return ind.effective_groups(b.views(spark, sf), ["acquisition"])


@register("i01_independence_audit", "declared_groups:i effective_groups:i passed:b",
          audit_sql("CASE WHEN ord % 41 <> 0 THEN acquisition END")
          + " SELECT count(*) AS declared_groups, max(effective) AS effective_groups, max(effective) >= 2 AS passed FROM eff")
def i01_missing(spark, sf):
    views = b.views(spark, sf).withColumn("acquisition", F.when(F.col("ord") % 41 != 0, F.col("acquisition")))
    return ind.independence_audit(views, ["acquisition"])


@register("i01_provenance_links", "src:i dst:i field:s value:s reason:s",
          f"""WITH {b.VIEWS}, f AS (SELECT grp, min(ord) AS g FROM views GROUP BY grp),
l AS (SELECT DISTINCT g, 'acquisition' AS field, acquisition AS value FROM views JOIN f ON views.grp = f.grp
      UNION SELECT DISTINCT g, 'family', family FROM views JOIN f ON views.grp = f.grp),
h AS (SELECT field, value, min(g) AS hub FROM l GROUP BY field, value)
SELECT g AS src, hub AS dst, l.field, l.value, 'shared_value' AS reason FROM l JOIN h ON l.field = h.field AND l.value = h.value WHERE g <> hub""")
def i01_links(spark, sf):
    return ind.provenance_links(b.views(spark, sf), ["acquisition", "family"])


# -- components ----------------------------------------------------------------------------


@register("i02_components_area", "component:i cells:i area:d2",
          f"""WITH RECURSIVE {b.MASK}, {b.TRUTH}, {four_sql('mask', 'c4')}
SELECT component, count(*) AS cells, sum(area_um2) AS area FROM c4 JOIN truth t ON c4.id = t.y * 2147483648 + t.x
GROUP BY component HAVING sum(area_um2) >= 200000""")
def i02(spark, sf):
    labelled = cc.components(b.mask(spark, sf), tile=64)
    areas = labelled.join(b.truth(spark, sf).select("y", "x", "area_um2"), ["y", "x"])
    return cc.component_areas(areas, area="area_um2").where(F.col("area") >= 200000)


@register("i02_components_by_surface", "surface:i component:i cells:i",
          f"""WITH surf AS (SELECT DISTINCT CASE WHEN l_linenumber <= 3 THEN l_linenumber END AS surface, {b._yx_sql('l_orderkey')} FROM lineitem WHERE l_discount >= cast(0.05 AS DOUBLE)),
{dense_sql('surf', 'cs', 2, 'surface', full=False)} SELECT surface, component, count(*) AS cells FROM cs GROUP BY 1, 2""")
def i02_surface(spark, sf):
    """Three surfaces and one without a name, whose coordinates overlap."""
    cells = b.table(spark, sf, "lineitem").where(F.col("l_discount") >= 0.05).select(
        F.when(F.col("l_linenumber") <= 3, F.col("l_linenumber")).alias("surface"), *b._yx("l_orderkey")).distinct()
    return cc.component_areas(cc.components(cells, tile=16, by=["surface"]), ["surface"]).select("surface", "component", "cells")


@register("i03_components_8", "components:i largest:i cells:i largest_fraction:d",
          f"""WITH {b.MASK}, {dense_sql('mask', 'c8', 2)}, s AS (SELECT component, count(*) AS n FROM c8 GROUP BY component)
SELECT count(*) AS components, max(n) AS largest, sum(n) AS cells, max(n) / cast(sum(n) AS DOUBLE) AS largest_fraction FROM s""")
def i03(spark, sf):
    return cc.component_summary(cc.component_areas(cc.components(b.mask(spark, sf), full=True, tile=64)))


@register("i03_drop_small", "y:i x:i",
          f"""WITH {b.MASK}, {dense_sql('mask', 'c8', 2)}, s AS (SELECT component FROM c8 GROUP BY component HAVING count(*) >= 6)
SELECT id // 2147483648 AS y, id % 2147483648 AS x FROM c8 WHERE component IN (SELECT component FROM s)""")
def i03_drop(spark, sf):
    return cc.drop_small(cc.components(b.mask(spark, sf), full=True, tile=64), 6)


@register("i04_components_3d", "py:i px:i components:i largest:i cells:i largest_fraction:d",
          f"""WITH {b.VOXELS}, v AS (SELECT y // 32 AS py, x // 32 AS px, z, y, x FROM voxels WHERE v >= 25), {dense_sql('v', 'c26', 3, 'py, px')},
s AS (SELECT py, px, component, count(*) AS n FROM c26 GROUP BY 1, 2, 3)
SELECT py, px, count(*) AS components, max(n) AS largest, sum(n) AS cells, max(n) / cast(sum(n) AS DOUBLE) AS largest_fraction FROM s GROUP BY py, px""")
def i04(spark, sf):
    v = b.voxels(spark, sf).where("v >= 25").select(
        F.floor(F.col("y") / 32).cast("int").alias("py"), F.floor(F.col("x") / 32).cast("int").alias("px"), "z", "y", "x")
    labelled = cc.components(v, full=True, tile=32, by=["py", "px"], axes=("z", "y", "x"), clip=True)
    return cc.component_summary(cc.component_areas(labelled, ["py", "px"]), ["py", "px"])


@register("i07_components_clipped", "component:i cells:i area:d",
          f"""WITH RECURSIVE {b.MASK}, {four_sql('mask', 'cl', extra=' AND a.y // 16 = b.y // 16 AND a.x // 16 = b.x // 16')}
SELECT component, count(*) AS cells, count(*) AS area FROM cl GROUP BY component""")
def i07(spark, sf):
    return cc.component_areas(cc.components(b.mask(spark, sf), tile=16, clip=True))


# -- burden and policies --------------------------------------------------------------------


@register("d39_fp_burden",
          "negative_px:i negative_cm2:d fp_px:i fp_cm2:d fp_fraction:d components_all:i components_retained:i components_per_cm2:d",
          f"""WITH RECURSIVE {b.SCORED_ALL}, fp AS (SELECT y, x FROM scored WHERE s0 >= cast(0.3 AS DOUBLE) AND NOT positive), {four_sql('fp', 'cf')},
a AS (SELECT component, sum(area_um2) AS area FROM cf JOIN truth t ON cf.id = t.y * 2147483648 + t.x GROUP BY component),
n AS (SELECT count(*) AS negative_px, sum(area_um2) / 1e8 AS negative_cm2, count(*) FILTER (WHERE s0 >= cast(0.3 AS DOUBLE)) AS fp_px,
  sum(area_um2) FILTER (WHERE s0 >= cast(0.3 AS DOUBLE)) / 1e8 AS fp_cm2 FROM scored WHERE NOT positive)
SELECT *, fp_cm2 / negative_cm2 AS fp_fraction, (SELECT count(*) FROM a) AS components_all,
 (SELECT count(*) FROM a WHERE area >= 200000) AS components_retained, (SELECT count(*) FROM a WHERE area >= 200000) / negative_cm2 AS components_per_cm2 FROM n""")
def d39(spark, sf):
    px = b.scored(spark, sf).withColumn("accepted", F.col("s0") >= F.lit(0.3))
    return ph.fp_burden(px, 0.2, tile=64)


@register("d39_fp_burden_by_surface",
          "surface:i negative_px:i negative_cm2:d fp_px:i fp_cm2:d fp_fraction:d components_all:i components_retained:i components_per_cm2:d",
          f"""WITH {b.SCORED_ALL}, sf AS (SELECT s.*, k.surface FROM scored s CROSS JOIN (SELECT unnest([1, 2, 3, NULL]) AS surface) k WHERE (y + x) % 4 <> coalesce(surface, 0)),
fp AS (SELECT surface, y, x FROM sf WHERE s0 >= cast(0.3 AS DOUBLE) AND NOT positive), {dense_sql('fp', 'cf', 2, 'surface', full=False)},
a AS (SELECT surface, component, sum(area_um2) AS area FROM cf JOIN truth t ON cf.id = cast(t.y AS BIGINT) * 2147483648 + t.x GROUP BY 1, 2),
c AS (SELECT surface, count(*) AS ca, count(*) FILTER (WHERE area >= 200000) AS cr FROM a GROUP BY 1),
n AS (SELECT surface, count(*) AS negative_px, sum(area_um2) / 1e8 AS negative_cm2, count(*) FILTER (WHERE s0 >= cast(0.3 AS DOUBLE)) AS fp_px,
  sum(area_um2) FILTER (WHERE s0 >= cast(0.3 AS DOUBLE)) / 1e8 AS fp_cm2 FROM sf WHERE NOT positive GROUP BY 1)
SELECT n.*, fp_cm2 / negative_cm2 AS fp_fraction, ca AS components_all, cr AS components_retained, cr / negative_cm2 AS components_per_cm2
FROM n JOIN c ON n.surface IS NOT DISTINCT FROM c.surface""")
def d39_surface(spark, sf):
    """Every pixel on three surfaces and one without a name, each with holes of its own."""
    surface = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(None).cast("int")))
    px = b.scored(spark, sf).withColumn("surface", surface).where((F.col("y") + F.col("x")) % 4 != F.coalesce("surface", F.lit(0)))
    return ph.fp_burden(px.withColumn("accepted", F.col("s0") >= F.lit(0.3)), 0.2, tile=16, by=["surface"])


@register("d40_evaluate_policies",
          "policy:s pixels:i accepted_px:i true_px:i precision:d recall:d fp_fraction:d components:i components_per_cm2:d",
          f"""WITH RECURSIVE {b.SCORED_ALL},
r AS (SELECT s0, row_number() OVER (ORDER BY s0 DESC) AS rn, count(*) OVER () AS n FROM scored),
c AS (SELECT min(s0) FILTER (WHERE rn <= greatest(1, ceil(n * cast(0.05 AS DOUBLE)))) AS c1, min(s0) FILTER (WHERE rn <= greatest(1, ceil(n * cast(0.2 AS DOUBLE)))) AS c2 FROM r),
l AS (SELECT 'abstain_all' AS policy, y, x, positive, area_um2, false AS acc FROM scored UNION ALL SELECT 'score_gte_0.5', y, x, positive, area_um2, s0 >= cast(0.5 AS DOUBLE) FROM scored
 UNION ALL SELECT 'top_0.05', y, x, positive, area_um2, s0 >= c1 FROM scored, c UNION ALL SELECT 'top_0.2', y, x, positive, area_um2, s0 >= c2 FROM scored, c),
fp AS (SELECT policy, y, x, area_um2 FROM l WHERE acc AND NOT positive), {four_sql('fp', 'cp', 'policy', ' AND a.y // 32 = b.y // 32 AND a.x // 32 = b.x // 32')},
a AS (SELECT cp.policy, component, sum(area_um2) AS area FROM cp JOIN truth t ON cp.id = t.y * 2147483648 + t.x GROUP BY cp.policy, component),
k AS (SELECT policy, count(*) AS components FROM a WHERE area >= 200000 GROUP BY policy),
g AS (SELECT policy, count(*) AS pixels, count(*) FILTER (WHERE acc) AS accepted_px, count(*) FILTER (WHERE acc AND positive) AS true_px,
 count(*) FILTER (WHERE positive) AS pos, sum(area_um2) FILTER (WHERE NOT positive) / 1e8 AS neg, coalesce(sum(area_um2) FILTER (WHERE acc AND NOT positive), 0) / 1e8 AS fp FROM l GROUP BY policy)
SELECT g.policy, pixels, accepted_px, true_px, true_px / cast(nullif(accepted_px, 0) AS DOUBLE) AS precision, true_px / cast(pos AS DOUBLE) AS recall, fp / neg AS fp_fraction,
  coalesce(components, 0) AS components, coalesce(components, 0) / neg AS components_per_cm2 FROM g LEFT JOIN k ON g.policy = k.policy""")
def d40(spark, sf):
    return ph.evaluate_policies(b.scored(spark, sf), "s0", 0.5, [0.05, 0.2], 0.2, 32)


# -- grid -----------------------------------------------------------------------------------

EDGES = f"""gv AS (SELECT * FROM grid WHERE {b.STRICT}),
edges AS (SELECT a.v, a.u, 'u' AS direction, sqrt(pow(c.x - a.x, 2) + pow(c.y - a.y, 2) + pow(c.z - a.z, 2)) AS distance FROM gv a JOIN gv c ON c.v = a.v AND c.u = a.u + 1
  UNION ALL SELECT a.v, a.u, 'v', sqrt(pow(c.x - a.x, 2) + pow(c.y - a.y, 2) + pow(c.z - a.z, 2)) FROM gv a JOIN gv c ON c.v = a.v + 1 AND c.u = a.u)"""


@register("c16_neighbour_edges", "v:i u:i direction:s distance:d", f"WITH {b.GRID}, {EDGES} SELECT * FROM edges")
def c16(spark, sf):
    return gr.neighbour_edges(b.grid(spark, sf))


@register("i08_grid_continuity",
          "direction:s edges:i min:d p01:d p50:d p99:d max:d relative_error:d within_tolerance:b abrupt_jumps:i",
          f"""WITH {b.GRID}, {EDGES}
SELECT direction, count(*) AS edges, min(distance) AS "min", quantile_cont(distance, 0.01) AS p01, quantile_cont(distance, 0.5) AS p50, quantile_cont(distance, 0.99) AS p99,
 max(distance) AS "max", abs(quantile_cont(distance, 0.5) - 20) / 20 AS relative_error, abs(quantile_cont(distance, 0.5) - 20) / 20 <= cast(0.05 AS DOUBLE) AS within_tolerance,
 count(*) FILTER (WHERE distance > cast(21.5 AS DOUBLE)) AS abrupt_jumps FROM edges GROUP BY direction""")
def i08(spark, sf):
    return gr.grid_continuity(b.grid(spark, sf), 20, 0.05, 1.075)


@register("i08_grid_vertices", "vertices:i valid:i partial_sentinel:i x_min:d y_min:d z_min:d x_max:d y_max:d z_max:d",
          f"""WITH {b.GRID} SELECT count(*) AS vertices, count(*) FILTER (WHERE {b.STRICT}) AS valid,
 count(*) FILTER (WHERE (x = -1 OR y = -1 OR z = -1) AND NOT (x = -1 AND y = -1 AND z = -1)) AS partial_sentinel,
 min(x) FILTER (WHERE {b.STRICT}) AS x_min, min(y) FILTER (WHERE {b.STRICT}) AS y_min, min(z) FILTER (WHERE {b.STRICT}) AS z_min,
 max(x) FILTER (WHERE {b.STRICT}) AS x_max, max(y) FILTER (WHERE {b.STRICT}) AS y_max, max(z) FILTER (WHERE {b.STRICT}) AS z_max FROM grid""")
def i08_vertices(spark, sf):
    return gr.grid_vertices(b.grid(spark, sf))


def quads_sql(rule: str) -> str:
    return f"""gq AS (SELECT * FROM grid WHERE {rule}),
qn AS (SELECT a.v, a.u, (r.y - a.y) * (d.z - a.z) - (r.z - a.z) * (d.y - a.y) AS nx, (r.z - a.z) * (d.x - a.x) - (r.x - a.x) * (d.z - a.z) AS ny,
   (r.x - a.x) * (d.y - a.y) - (r.y - a.y) * (d.x - a.x) AS nz
  FROM gq a JOIN gq r ON r.v = a.v AND r.u = a.u + 1 JOIN gq d ON d.v = a.v + 1 AND d.u = a.u JOIN gq e ON e.v = a.v + 1 AND e.u = a.u + 1),
quads AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS area FROM qn),
un AS (SELECT v, u, nx / area AS nx, ny / area AS ny, nz / area AS nz FROM quads WHERE area > 0),
dots AS (SELECT a.v, a.u, 'u' AS direction, a.nx * c.nx + a.ny * c.ny + a.nz * c.nz AS dot FROM un a JOIN un c ON c.v = a.v AND c.u = a.u + 1
  UNION ALL SELECT a.v, a.u, 'v', a.nx * c.nx + a.ny * c.ny + a.nz * c.nz FROM un a JOIN un c ON c.v = a.v + 1 AND c.u = a.u)"""


@register("i09_grid_topology", "quads:i degenerate:i median_area:d normal_pairs:i normal_flips:i dot_p01:d",
          f"""WITH {b.GRID}, {quads_sql(b.STRICT)}, m AS (SELECT median(area) AS m FROM quads)
SELECT (SELECT count(*) FROM quads) AS quads, (SELECT count(*) FROM quads, m WHERE area <= m * cast(0.01 AS DOUBLE)) AS degenerate, (SELECT m FROM m) AS median_area,
 count(*) AS normal_pairs, count(*) FILTER (WHERE dot < 0) AS normal_flips, quantile_cont(dot, 0.01) AS dot_p01 FROM dots""")
def i09(spark, sf):
    return gr.grid_topology(b.grid(spark, sf))


def grid_surfaces(spark, sf):
    """The grid cut into strips whose coordinates overlap; one has no name."""
    strip = F.floor(F.col("u") / 40).cast("int")
    return b.grid(spark, sf).select(F.when(strip < 3, strip).alias("surface"), "v", (F.col("u") % 40).alias("u"), "x", "y", "z")


STRIPS = f"{b.GRID.replace('grid AS (', 'one AS (', 1)}, grid AS (SELECT CASE WHEN u // 40 < 3 THEN u // 40 END AS surface, v, u % 40 AS u, x, y, z FROM one)"
STRIP_EDGES = f"""gv AS (SELECT * FROM grid WHERE {b.STRICT}),
edges AS (SELECT a.surface, 'u' AS direction, sqrt((r.x - a.x) * (r.x - a.x) + (r.y - a.y) * (r.y - a.y) + (r.z - a.z) * (r.z - a.z)) AS distance
  FROM gv a JOIN gv r ON r.surface IS NOT DISTINCT FROM a.surface AND r.v = a.v AND r.u = a.u + 1
UNION ALL SELECT a.surface, 'v', sqrt((r.x - a.x) * (r.x - a.x) + (r.y - a.y) * (r.y - a.y) + (r.z - a.z) * (r.z - a.z))
  FROM gv a JOIN gv r ON r.surface IS NOT DISTINCT FROM a.surface AND r.v = a.v + 1 AND r.u = a.u)"""


@register("i08_continuity_by_surface", "surface:i direction:s edges:i min:d p50:d max:d within_tolerance:b abrupt_jumps:i",
          f"""WITH {STRIPS}, {STRIP_EDGES}
SELECT surface, direction, count(*) AS edges, min(distance) AS "min", quantile_cont(distance, 0.5) AS p50, max(distance) AS "max",
 abs(quantile_cont(distance, 0.5) - 20) / 20 <= cast(0.05 AS DOUBLE) AS within_tolerance,
 count(*) FILTER (WHERE distance > cast(21.5 AS DOUBLE)) AS abrupt_jumps FROM edges GROUP BY surface, direction""")
def i08_by_surface(spark, sf):
    return gr.grid_continuity(grid_surfaces(spark, sf), 20, 0.05, 1.075, ["surface"])


@register("i09_topology_by_surface", "surface:i quads:i degenerate:i median_area:d normal_pairs:i normal_flips:i",
          f"""WITH {STRIPS}, gq AS (SELECT * FROM grid WHERE {b.STRICT}),
qn AS (SELECT a.surface, a.v, a.u, (r.y - a.y) * (d.z - a.z) - (r.z - a.z) * (d.y - a.y) AS nx, (r.z - a.z) * (d.x - a.x) - (r.x - a.x) * (d.z - a.z) AS ny,
   (r.x - a.x) * (d.y - a.y) - (r.y - a.y) * (d.x - a.x) AS nz
  FROM gq a JOIN gq r ON r.surface IS NOT DISTINCT FROM a.surface AND r.v = a.v AND r.u = a.u + 1
  JOIN gq d ON d.surface IS NOT DISTINCT FROM a.surface AND d.v = a.v + 1 AND d.u = a.u
  JOIN gq e ON e.surface IS NOT DISTINCT FROM a.surface AND e.v = a.v + 1 AND e.u = a.u + 1),
quads AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS area FROM qn),
un AS (SELECT surface, v, u, nx / area AS nx, ny / area AS ny, nz / area AS nz FROM quads WHERE area > 0),
dots AS (SELECT a.surface, a.nx * c.nx + a.ny * c.ny + a.nz * c.nz AS dot FROM un a JOIN un c ON c.surface IS NOT DISTINCT FROM a.surface
  AND (c.v = a.v AND c.u = a.u + 1 OR c.v = a.v + 1 AND c.u = a.u)),
m AS (SELECT surface, median(area) AS m FROM quads GROUP BY surface),
q AS (SELECT quads.surface, count(*) AS quads, count(*) FILTER (WHERE area <= m * cast(0.01 AS DOUBLE)) AS degenerate, max(m) AS median_area
  FROM quads JOIN m ON m.surface IS NOT DISTINCT FROM quads.surface GROUP BY quads.surface),
n AS (SELECT surface, count(*) AS normal_pairs, count(*) FILTER (WHERE dot < 0) AS normal_flips FROM dots GROUP BY surface)
SELECT q.*, normal_pairs, normal_flips FROM q LEFT JOIN n ON n.surface IS NOT DISTINCT FROM q.surface""")
def i09_by_surface(spark, sf):
    return gr.grid_topology(grid_surfaces(spark, sf), ["surface"])


@register("i10_pixel_area", "y:i x:i area_um2:d",
          f"""WITH {b.GRID}, {quads_sql(b.NOT_ALL)}, {b.TRUTH}
SELECT t.y, t.x, q.area * cast(4 AS DOUBLE) / 25 AS area_um2 FROM truth t LEFT JOIN quads q ON q.v = t.y // 5 AND q.u = t.x // 5 WHERE t.valid""")
def i10(spark, sf):
    px = b.truth(spark, sf).where("valid").select("y", "x")
    return gr.pixel_area(px, b.grid(spark, sf), 5, 2.0)


@register("i10_roi_geometry",
          "cy:i cx:i evaluated:i unsupported:i cells:i degenerate:i area_cm2:d9 area_p50:d flips:i passes:b",
          f"""WITH {b.GRID}, {quads_sql(b.NOT_ALL)}, {b.TRUTH}, m AS (SELECT median(area) AS m FROM quads),
p AS (SELECT t.cy, t.cx, t.y // 5 AS v, t.x // 5 AS u, q.area FROM truth t LEFT JOIN quads q ON q.v = t.y // 5 AND q.u = t.x // 5 WHERE t.valid),
s AS (SELECT DISTINCT cy, cx, v, u, area FROM p),
f AS (SELECT s.cy, s.cx, count(*) AS flips FROM s JOIN dots d ON d.v = s.v AND d.u = s.u AND d.dot < 0
  JOIN s t ON t.cy = s.cy AND t.cx = s.cx AND t.v = s.v + CASE WHEN d.direction = 'v' THEN 1 ELSE 0 END AND t.u = s.u + CASE WHEN d.direction = 'u' THEN 1 ELSE 0 END GROUP BY 1, 2),
g AS (SELECT cy, cx, count(*) AS cells, count(*) FILTER (WHERE area <= m * cast(0.01 AS DOUBLE)) AS degenerate FROM s, m GROUP BY cy, cx),
h AS (SELECT cy, cx, count(*) AS evaluated, count(*) FILTER (WHERE area IS NULL) AS unsupported, sum(area) * 4 / 25 / 1e8 AS area_cm2, median(area) * 4 / 25 AS area_p50 FROM p GROUP BY cy, cx)
SELECT h.*, g.cells, g.degenerate, coalesce(f.flips, 0) AS flips, unsupported = 0 AND degenerate = 0 AND coalesce(f.flips, 0) = 0 AS passes
FROM h JOIN g ON h.cy = g.cy AND h.cx = g.cx LEFT JOIN f ON f.cy = h.cy AND f.cx = h.cx""")
def i10_roi(spark, sf):
    px = b.truth(spark, sf).where("valid")
    return gr.roi_geometry(px, b.grid(spark, sf), 5, 2.0, ["cy", "cx"])


@register("i11_grid_step", "edges:i step:d crop_px:i",
          f"""WITH {b.GRID}, {EDGES.replace(b.STRICT, '(x > 0 AND y > 0 AND z > 0)')}
SELECT count(*) AS edges, median(distance) AS step, round_even(cast(4000 AS DOUBLE) / (median(distance) * 2), 0) AS crop_px FROM edges""")
def i11(spark, sf):
    return gr.grid_step(b.grid(spark, sf), 4.0, 2.0)


def _normals_sql():
    diff = lambda c, w: (f"CASE WHEN lag({c}) OVER {w} IS NULL THEN 2 * (lead({c}) OVER {w} - {c}) WHEN lead({c}) OVER {w} IS NULL "
                         f"THEN 2 * ({c} - lag({c}) OVER {w}) ELSE lead({c}) OVER {w} - lag({c}) OVER {w} END")
    cols = ", ".join(f"{diff(c, 'r')} AS {c}u, {diff(c, 'c')} AS {c}v" for c in "xyz")
    return f"""WITH {b.GRID}, d AS (SELECT v, u, x, y, z, {cols} FROM grid WINDOW r AS (PARTITION BY v ORDER BY u), c AS (PARTITION BY u ORDER BY v)),
n AS (SELECT v, u, yu * zv - zu * yv AS nx, zu * xv - xu * zv AS ny, xu * yv - yu * xv AS nz FROM d WHERE x > 0 AND y > 0 AND z > 0)
SELECT v, u, nx / (sqrt(nx*nx + ny*ny + nz*nz) + cast(1e-9 AS DOUBLE)) AS nx, ny / (sqrt(nx*nx + ny*ny + nz*nz) + cast(1e-9 AS DOUBLE)) AS ny,
 nz / (sqrt(nx*nx + ny*ny + nz*nz) + cast(1e-9 AS DOUBLE)) AS nz FROM n"""


@register("i11_surface_normals", "v:i u:i nx:d ny:d nz:d", _normals_sql())
def i11_normals(spark, sf):
    return gr.surface_normals(b.grid(spark, sf))


def _affine_sql():
    """Centred normal equations solved by Cramer's rule, then residual quantiles on the holdout."""
    sums = ", ".join(f"sum(d{a} * d{c}) AS {a}{c}" for a in ("sx", "sy", "sz") for c in ("sx", "sy", "sz", "tx", "ty", "tz"))
    centred = ", ".join(f"{c} - m_{c} AS d{c}" for c in ("sx", "sy", "sz", "tx", "ty", "tz"))
    means = ", ".join(f"avg({c}) AS m_{c}" for c in ("sx", "sy", "sz", "tx", "ty", "tz"))
    det3 = lambda m: (f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]})"
                      f" + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))")
    src = ("sx", "sy", "sz")
    base = [[f"{a}{c}" for c in src] for a in src]
    coef = []
    for t in ("tx", "ty", "tz"):
        for k in range(3):
            m = [[f"{src[i]}{t}" if j == k else base[i][j] for j in range(3)] for i in range(3)]
            coef.append(f"{det3(m)} / {det3(base)} AS {src[k]}_{t}")
    moved = " + ".join(
        f"pow(m_{t} + " + " + ".join(f"{s}_{t} * (h.{s} - m_{s})" for s in src) + f" - h.{t}, 2)" for t in ("tx", "ty", "tz"))
    return f"""WITH {b.GRID}, sh AS (SELECT max(v) + 1 AS h, max(u) + 1 AS w FROM grid),
tg AS (SELECT v // 2 AS v, u // 2 AS u, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM grid WHERE {b.NOT_ALL} GROUP BY 1, 2), ts AS (SELECT (h + 1) // 2 AS h, (w + 1) // 2 AS w FROM sh),
s AS (SELECT g.*, round_even(v * cast(ts.h - 1 AS DOUBLE) / (sh.h - 1), 0) AS tv, round_even(u * cast(ts.w - 1 AS DOUBLE) / (sh.w - 1), 0) AS tu
  FROM grid g, sh, ts WHERE v % 2 = 0 AND u % 2 = 0 AND {b.NOT_ALL}),
p AS (SELECT (s.v // 16 + s.u // 16) % 5 = 0 AS holdout, s.x AS sx, s.y AS sy, s.z AS sz, tg.x AS tx, tg.y AS ty, tg.z AS tz FROM s JOIN tg ON tg.v = s.tv AND tg.u = s.tu),
mean AS (SELECT {means} FROM p WHERE NOT holdout), c AS (SELECT {centred} FROM p, mean WHERE NOT holdout), n AS (SELECT {sums} FROM c), k AS (SELECT {', '.join(coef)} FROM n),
r AS (SELECT sqrt({moved}) AS residual FROM p h, mean, k WHERE h.holdout)
SELECT count(*) AS n, median(residual) AS p50, quantile_cont(residual, 0.9) AS p90, quantile_cont(residual, 0.99) AS p99, max(residual) AS "max",
  median(residual) <= 30 AND quantile_cont(residual, 0.9) <= 45 AS passes FROM r"""


@register("i12_registration", "n:i p50:d5 p90:d5 p99:d5 max:d5 passes:b", _affine_sql())
def i12(spark, sf):
    return gr.registration_report(uv_pairs(spark, sf, 2), 16, 5, 0, 30, 45)


@register("i12_residuals", "v:i u:i residual:d",
          f"""WITH {b.GRID}, sh AS (SELECT max(v) + 1 AS h, max(u) + 1 AS w FROM grid),
tg AS (SELECT v // 2 AS v, u // 2 AS u, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM grid WHERE {b.NOT_ALL} GROUP BY 1, 2), ts AS (SELECT (h + 1) // 2 AS h, (w + 1) // 2 AS w FROM sh),
s AS (SELECT g.*, round_even(v * cast(ts.h - 1 AS DOUBLE) / (sh.h - 1), 0) AS tv, round_even(u * cast(ts.w - 1 AS DOUBLE) / (sh.w - 1), 0) AS tu
  FROM grid g, sh, ts WHERE v % 4 = 0 AND u % 4 = 0 AND {b.NOT_ALL})
SELECT s.v, s.u, sqrt(pow(s.x + 1 - tg.x, 2) + pow(s.y + 2 - tg.y, 2) + pow(s.z + 3 - tg.z, 2)) AS residual FROM s JOIN tg ON tg.v = s.tv AND tg.u = s.tu""")
def i12_residuals(spark, sf):
    return gr.residuals(uv_pairs(spark, sf, 4), [[1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 2, 3]])


@register("i13_candidate_geometry", "box_id:i vertices:i x_min:d y_min:d z_min:d x_max:d y_max:d z_max:d",
          f"""WITH {b.GRID}, {b.BOXES},
c AS (SELECT box_id, greatest(0, floor(y0 / cast(2 AS DOUBLE))) AS v0, ceil(y1 / cast(2 AS DOUBLE)) AS v1, greatest(0, floor(x0 / cast(2 AS DOUBLE))) AS u0, ceil(x1 / cast(2 AS DOUBLE)) AS u1 FROM boxes)
SELECT box_id, count(*) AS vertices, min(x) AS x_min, min(y) AS y_min, min(z) AS z_min, max(x) AS x_max, max(y) AS y_max, max(z) AS z_max
FROM c JOIN grid g ON g.v >= v0 AND g.v < v1 AND g.u >= u0 AND g.u < u1 WHERE {b.STRICT} GROUP BY box_id""")
def i13(spark, sf):
    return gr.candidate_geometry(b.boxes(spark, sf), b.grid(spark, sf), (2.0, 2.0))


@register("i14_out_of_bounds", "valid:i outside:i",
          f"""WITH {b.GRID} SELECT count(*) AS valid, count(*) FILTER (WHERE NOT (z >= 0 AND z < 102 AND y >= 0 AND y < 2200 AND x >= 0 AND x < 2400)) AS outside FROM grid WHERE {b.STRICT}""")
def i14(spark, sf):
    return gr.out_of_bounds(b.grid(spark, sf), (102, 2200, 2400))


SEATING = f"""WITH {b.VOXELS}, {b.TRUTH},
p AS (SELECT y * 1000 + x AS pid, cast(3 AS DOUBLE) AS pz, cast(y AS DOUBLE) AS py, cast(x AS DOUBLE) AS px, cast(1 AS DOUBLE) AS nz, (x % 3) / cast(4 AS DOUBLE) AS ny FROM truth WHERE valid),
o AS (SELECT 0 AS step, 1 AS side UNION ALL SELECT s, d FROM (SELECT unnest([1, 2, 3]) AS s) CROSS JOIN (SELECT unnest([1, -1]) AS d)),
q AS (SELECT pid, step, side, round_even(pz + nz * step * side, 0) AS z, round_even(py + ny * step * side, 0) AS y, px AS x FROM p CROSS JOIN o),
s AS (SELECT pid, step, side, cast(coalesce(v, 0) AS DOUBLE) AS s FROM q LEFT JOIN voxels v ON v.z = q.z AND v.y = q.y AND v.x = q.x),
m AS (SELECT step, (avg(s) FILTER (WHERE side = 1) + avg(s) FILTER (WHERE side = -1)) / 2 AS m FROM s WHERE step > 0 GROUP BY step),
sm AS (SELECT step, (coalesce(lag(m) OVER w, 0) + m + coalesce(lead(m) OVER w, 0)) / 3 AS sm FROM m WINDOW w AS (ORDER BY step)),
l AS (SELECT step, round(sm, 9) AS r, round(lag(sm) OVER w, 9) AS a, round(lead(sm) OVER w, 9) AS c FROM sm WINDOW w AS (ORDER BY step)),
g AS (SELECT coalesce(min(step) FILTER (WHERE a IS NOT NULL AND c IS NOT NULL AND r <= a AND r <= c), arg_min(step, r)) AS gap FROM l),
t AS (SELECT pid, max(gap) AS gap, max(s) FILTER (WHERE step = 0) AS ce, max(s) FILTER (WHERE step = gap AND side = -1) AS be, max(s) FILTER (WHERE step = gap AND side = 1) AS af FROM s, g GROUP BY pid)
SELECT max(gap) AS gap, avg(CASE WHEN ce > 20 THEN 1.0 ELSE 0.0 END) AS coverage, avg(ce - (be + af) / 2) FILTER (WHERE ce > 20) AS contrast,
 avg(ce - (be + af) / 2) FILTER (WHERE ce > 20) * avg(CASE WHEN ce > 20 THEN 1.0 ELSE 0.0 END) AS score, avg(ce) FILTER (WHERE ce > 20) AS surface_mean FROM t"""


@register("d08_seating_score", "gap:d coverage:d contrast:d score:d surface_mean:d",
          SEATING)
def d08(spark, sf):
    return probe.seating_score(seating_points(spark, sf), b.voxels(spark, sf), [1, 2, 3], bright=20, min_coverage=0.05)


def seating_points(spark, sf):
    return b.truth(spark, sf).where("valid").select(
        (F.col("y") * 1000 + F.col("x")).alias("point_id"), F.lit(3.0).alias("pz"), F.col("y").cast("double").alias("py"),
        F.col("x").cast("double").alias("px"), F.lit(1.0).alias("nz"), ((F.col("x") % 3) / F.lit(4.0)).alias("ny"), F.lit(0.0).alias("nx"))


@register("u02_probe_reader", "gap:d coverage:d contrast:d score:d surface_mean:d",
          SEATING)
def u02(spark, sf):
    """The probe on a reader in place of a voxel table."""
    return probe.seating_score(seating_points(spark, sf), voxel_store(spark, sf), [1, 2, 3], bright=20, min_coverage=0.05)


L05 = "valid:i partial_sentinel:i largest_fraction:d within_tolerance:b abrupt_jumps:i degenerate_quads:i normal_flips:i supervised:i unsupported:i out_of_bounds:i candidates:i passing:i tier:s blockers:s"


def audit_sql(rule: str, jump: float, share: float) -> str:
    """One row of audits of the grid's vertices for which ``rule`` holds."""
    return f"""WITH {b.GRID.replace('grid AS (', 'every AS (', 1)}, grid AS (SELECT * FROM every WHERE {rule}), {EDGES}, {quads_sql(b.STRICT)}, {b.VOXELS}, {b.TRUTH},
vv AS (SELECT v AS y, u AS x FROM grid WHERE {b.STRICT}), {dense_sql('vv', 'c8', 2)},
ss AS (SELECT DISTINCT cy * 1000 + cx AS box_id, y, x FROM truth WHERE valid AND positive),
lf AS (SELECT max(n) / cast(sum(n) AS DOUBLE) AS largest_fraction FROM (SELECT count(*) AS n FROM c8 GROUP BY component)),
co AS (SELECT bool_and(ok) AS within_tolerance, sum(j) AS abrupt_jumps FROM (SELECT abs(quantile_cont(distance, 0.5) - 20) / 20 <= cast(0.05 AS DOUBLE) AS ok,
  count(*) FILTER (WHERE distance > cast({20 * jump} AS DOUBLE)) AS j FROM edges GROUP BY direction)),
md AS (SELECT median(area) AS m FROM quads),
tp AS (SELECT (SELECT count(*) FROM quads, md WHERE area <= m * cast(0.01 AS DOUBLE)) AS degenerate_quads, (SELECT count(*) FROM dots WHERE dot < 0) AS normal_flips),
mp AS (SELECT count(*) AS supervised, count(*) FILTER (WHERE g.v IS NULL) AS unsupported
  FROM (SELECT DISTINCT y, x FROM ss) AS p LEFT JOIN (SELECT v, u FROM grid WHERE {b.STRICT}) AS g ON g.v = p.y // 5 AND g.u = p.x // 5),
ob AS (SELECT count(*) AS valid, count(*) FILTER (WHERE NOT (z >= 0 AND z < 2200 AND y >= 0 AND y < 20000 AND x >= 0 AND x < 20000)) AS out_of_bounds FROM grid WHERE {b.STRICT}),
ps AS (SELECT count(*) AS partial_sentinel FROM grid WHERE (x = -1 OR y = -1 OR z = -1) AND NOT (x = -1 AND y = -1 AND z = -1)),
hit AS (SELECT y, x, bool_or(v > 0) AS h, bool_or(v > 0 AND z >= 2 AND z < 5) AS ch FROM voxels GROUP BY y, x),
cd AS (SELECT box_id, avg(CASE WHEN coalesce(h, false) THEN 1.0 ELSE 0.0 END) AS f, avg(CASE WHEN coalesce(ch, false) THEN 1.0 ELSE 0.0 END) AS c
  FROM ss LEFT JOIN hit ON hit.y = ss.y AND hit.x = ss.x GROUP BY box_id),
ct AS (SELECT count(*) AS candidates, count(*) FILTER (WHERE f >= cast({share} AS DOUBLE) AND c >= cast({share} AS DOUBLE)) AS passing FROM cd),
al AS (SELECT *, partial_sentinel = 0 AND largest_fraction >= cast(0.99 AS DOUBLE) AND within_tolerance AND abrupt_jumps = 0 AND degenerate_quads = 0 AND normal_flips = 0
  AND unsupported = 0 AS go, valid > 0 AND out_of_bounds = 0 AS bo, candidates > 0 AND passing = candidates AS co FROM lf, co, tp, mp, ob, ps, ct)
SELECT *, CASE WHEN go AND bo AND co THEN 'G2' ELSE 'G1' END AS tier,
 concat_ws(',', CASE WHEN NOT bo THEN 'volume_bounds' END, CASE WHEN NOT co THEN 'ct_support' END, CASE WHEN NOT go THEN 'grid_checks' END) AS blockers FROM al"""


def audited(spark, sf, rule, jump, share):
    grid = b.grid(spark, sf)
    h, w = grid.agg(F.max("v") + 1, F.max("u") + 1).first()
    marked = b.truth(spark, sf).where("valid and positive").select((F.col("cy") * 1000 + F.col("cx")).alias("box_id"), "y", "x").distinct()
    volume, criteria = Volume((2200, 20000, 20000), True, (2, 5)), Criteria(20, 0.05, jump, share, share)
    audit = geometry_audit(grid.where(rule), (h, w), (5 * h, 5 * w), marked, b.voxels(spark, sf), volume, criteria)
    return audit.withColumn("blockers", F.concat_ws(",", "blockers"))


@register("l05_geometry_from_audits", L05, audit_sql("true", 1.075, 0.9))
def l05_audits(spark, sf):
    """The tier of the grid as it is, from its own audits."""
    return audited(spark, sf, "true", 1.075, 0.9)


@register("l05_geometry_whole_vertices", L05, audit_sql("x <> -1", 1.5, 0.1))
def l05_whole(spark, sf):
    """The same of vertices with an x only, and wider criteria."""
    return audited(spark, sf, "x <> -1", 1.5, 0.1)
