"""Sampling, matching, fold and bootstrap queries."""

from pyspark.sql import functions as F

from surfaudit.operators import sampling as sp
from surfaudit.plans import bindings as b
from surfaudit.plans.registry import register

S = b.SCORED_ALL


def hash_sql(seed: int, *keys: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *[f"cast({k} AS VARCHAR)" for k in keys]])
    return f"cast('0x' || substr(sha256({text}), 1, 13) AS BIGINT)"


def draws_sql(blocks: str, key: str, reps: int, seed: int) -> str:
    """dw(rep, key, w) for the distinct keys of a CTE."""
    return f"""dk AS (SELECT {key}, row_number() OVER (ORDER BY {key}) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT {key} FROM {blocks})),
dr AS (SELECT rep, unnest(range((SELECT max(n) FROM dk))) AS slot, (SELECT max(n) FROM dk) AS n FROM (SELECT unnest(range({reps})) AS rep)),
di AS (SELECT rep, ((((rep * 7919 + slot * 104729 + {seed}) % 2147483647) * ((rep * 7919 + slot * 104729 + {seed}) % 2147483647)) % 2147483647 * 48271 % 2147483647) % n AS idx FROM dr),
dw AS (SELECT rep, {key}, count(*) AS w FROM di JOIN dk ON di.idx = dk.idx GROUP BY rep, {key})"""


def curve_sql(source: str, keys: str, out: str) -> str:
    """AP and AUC of weighted counts (keys, s, n, pos)."""
    return f"""{out}_r AS (SELECT {keys}, s, n, pos, sum(n) OVER (PARTITION BY {keys} ORDER BY s DESC) AS cn, sum(pos) OVER (PARTITION BY {keys} ORDER BY s DESC) AS cp FROM {source}),
{out} AS (SELECT {keys}, sum(n) AS n, sum(pos) AS p, sum(pos * cp / cast(cn AS DOUBLE)) / nullif(sum(pos), 0) AS ap,
  1 - sum(pos * ((cn - cp) - (n - pos) / cast(2 AS DOUBLE))) / nullif(cast(sum(pos) AS DOUBLE) * (sum(n) - sum(pos)), 0) AS auc FROM {out}_r GROUP BY {keys})"""


def interval_sql(source: str, col: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return (f"SELECT {k}count({col}) AS valid_replicates, quantile_cont({col}, 0.025) AS low, quantile_cont({col}, 0.975) AS high, "
            f"avg({col}) AS mean FROM {source} WHERE {col} IS NOT NULL {group}")


@register("h01_stratified_sample", "o_orderkey:i bin:i",
          f"""WITH f AS (SELECT o_orderkey, cast(floor((o_totalprice - 20000) / cast(20000 AS DOUBLE)) AS INTEGER) AS bin, {hash_sql(7, 'o_orderkey')} AS h
  FROM orders WHERE o_totalprice >= 20000 AND o_totalprice < 400000),
r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY h, o_orderkey) AS rn, ceil(500 / cast((SELECT count(DISTINCT bin) FROM f) AS DOUBLE)) AS k FROM f)
SELECT o_orderkey, bin FROM r WHERE rn <= k ORDER BY h, o_orderkey LIMIT 500""")
def h01(spark, sf):
    return sp.stratified_sample(b.table(spark, sf, "orders"), "o_totalprice", 20000, 400000, 20000, 500, 7, "o_orderkey")


@register("h02_balanced_per_block", "y:i x:i positive:b",
          f"""WITH {b.TRUTH}, t AS (SELECT *, y // 16 AS ky, x // 16 AS kx, {hash_sql(11, 'y', 'x')} AS h FROM truth WHERE valid),
r AS (SELECT *, row_number() OVER (PARTITION BY ky, kx, positive ORDER BY h, y, x) AS rn,
  least(count(*) FILTER (WHERE positive) OVER (PARTITION BY ky, kx), count(*) FILTER (WHERE NOT positive) OVER (PARTITION BY ky, kx), 20) AS k FROM t)
SELECT y, x, positive FROM r WHERE rn <= k""")
def h02(spark, sf):
    px = b.truth(spark, sf).where("valid").withColumn("ky", F.floor(F.col("y") / 16)).withColumn("kx", F.floor(F.col("x") / 16))
    return sp.balanced_per_block(px, "positive", ["ky", "kx"], 20, 11, ["y", "x"])


@register("h03_annulus_pairs", "y:i x:i cy:i cx:i distance:d")
def h03(spark, sf):
    px = b.truth(spark, sf).where("valid")
    return sp.annulus_pairs(px.where("positive"), px.where("not positive"), 64, 3, 8, 500, 12, 5)


@register("h04_caliper_match", "id_a:i id_b:i delta:d",
          """WITH s AS (SELECT o_orderkey AS id, o_totalprice / 1e6 AS v, cast(floor(o_totalprice / 1e6 / cast(0.00005 AS DOUBLE)) AS BIGINT) AS cell, o_orderstatus = 'F' AS pos FROM orders),
a1 AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY v, id) AS rn FROM s WHERE pos), b1 AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY v, id) AS rn FROM s WHERE NOT pos),
p1 AS (SELECT a1.id AS id_a, b1.id AS id_b, abs(a1.v - b1.v) AS delta FROM a1 JOIN b1 ON a1.cell = b1.cell AND a1.rn = b1.rn WHERE abs(a1.v - b1.v) <= cast(0.00005 AS DOUBLE)),
a2 AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY v DESC, id) AS rn FROM s WHERE pos AND id NOT IN (SELECT id_a FROM p1)),
b2 AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY v, id) AS rn FROM s WHERE NOT pos AND id NOT IN (SELECT id_b FROM p1)),
p2 AS (SELECT a2.id AS id_a, b2.id AS id_b, abs(a2.v - b2.v) AS delta FROM a2 JOIN b2 ON a2.cell = b2.cell - 1 AND a2.rn = b2.rn WHERE abs(a2.v - b2.v) <= cast(0.00005 AS DOUBLE)),
a3 AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY v, id) AS rn FROM s WHERE pos AND id NOT IN (SELECT id_a FROM p1 UNION ALL SELECT id_a FROM p2)),
b3 AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY v DESC, id) AS rn FROM s WHERE NOT pos AND id NOT IN (SELECT id_b FROM p1 UNION ALL SELECT id_b FROM p2)),
p3 AS (SELECT a3.id AS id_a, b3.id AS id_b, abs(a3.v - b3.v) AS delta FROM a3 JOIN b3 ON a3.cell = b3.cell + 1 AND a3.rn = b3.rn WHERE abs(a3.v - b3.v) <= cast(0.00005 AS DOUBLE))
SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3""")
def h04(spark, sf):
    o = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / F.lit(1e6)).alias("v"), "o_orderstatus")
    return sp.caliper_match(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'"), "v", 0.00005)


def blocked(spark, sf):
    return b.scored(spark, sf).withColumn("block", (F.col("cy") * 1000 + F.col("cx")).cast("bigint"))


BLOCKED = f"{S}, bl AS (SELECT *, cast(cy * 1000 + cx AS BIGINT) AS block, (s0 + s1) / 2 AS fused FROM scored)"


@register("h05_block_bootstrap", "valid_replicates:i low:d high:d mean:d",
          f"""WITH {BLOCKED}, {draws_sql('bl', 'block', 2000, 17)},
c AS (SELECT block, s0 AS s, count(*) AS n, sum(CASE WHEN positive THEN 1 ELSE 0 END) AS pos FROM bl GROUP BY 1, 2),
w AS (SELECT rep, s, sum(w * n) AS n, sum(w * pos) AS pos FROM dw JOIN c ON dw.block = c.block GROUP BY rep, s),
{curve_sql('w', 'rep', 'k')} {interval_sql('k', 'ap')}""")
def h05(spark, sf):
    return sp.block_bootstrap(blocked(spark, sf), "positive", "s0", "block", 2000, 17)


@register("h06_mean_bootstrap", "valid_replicates:i low:d high:d mean:d",
          f"""WITH {BLOCKED}, u AS (SELECT block, avg(s0) AS m FROM bl GROUP BY block), {draws_sql('u', 'block', 2000, 23)},
v AS (SELECT rep, sum(w * m) / cast(sum(w) AS DOUBLE) AS value FROM dw JOIN u ON dw.block = u.block GROUP BY rep) {interval_sql('v', 'value')}""")
def h06(spark, sf):
    return sp.mean_bootstrap(blocked(spark, sf), "block", "s0", 2000, 23)


# The cut is a quantile of replicated disagreements; scores are scaled to whole numbers so
# that the comparison is exact in both engines.
@register("h07_gain_bootstrap", "gain:s valid_replicates:i low:d high:d mean:d",
          f"""WITH {BLOCKED}, q AS (SELECT block, positive, round(s0 * 100) AS s0, round(s1 * 100) AS s1 FROM bl), {draws_sql('q', 'block', 2000, 29)},
c AS (SELECT block, s0, s1, count(*) AS n, sum(CASE WHEN positive THEN 1 ELSE 0 END) AS pos FROM q GROUP BY 1, 2, 3),
w AS (SELECT rep, s0, s1, sum(w * n) AS n, sum(w * pos) AS pos FROM dw JOIN c ON dw.block = c.block GROUP BY 1, 2, 3),
e AS (SELECT rep, abs(s0 - s1) AS d, unnest(range(cast(n AS BIGINT))) AS i FROM w), ct AS (SELECT rep, quantile_cont(d, 0.8) AS cut FROM e GROUP BY rep),
l AS (SELECT rep, 's0' AS name, s0 AS s, n, pos FROM w UNION ALL SELECT rep, 's1', s1, n, pos FROM w UNION ALL SELECT rep, 'fused', (s0 + s1) / 2, n, pos FROM w
   UNION ALL SELECT w.rep, 'kept', (s0 + s1) / 2, n, pos FROM w JOIN ct ON ct.rep = w.rep WHERE abs(s0 - s1) <= cut),
g AS (SELECT rep, name, s, sum(n) AS n, sum(pos) AS pos FROM l GROUP BY 1, 2, 3), {curve_sql('g', 'rep, name', 'k')},
o AS (SELECT rep, max(ap) FILTER (WHERE name = 'fused') AS f, max(ap) FILTER (WHERE name IN ('s0', 's1')) AS b, max(ap) FILTER (WHERE name = 'kept') AS k,
  bool_and(p > 0 AND p < n) AS ok FROM k GROUP BY rep),
v AS (SELECT 'fusion' AS gain, f - b AS value FROM o WHERE ok UNION ALL SELECT 'abstention', k - f FROM o WHERE ok) {interval_sql('v', 'value', 'gain')}""")
def h07(spark, sf):
    px = blocked(spark, sf).withColumn("s0", F.round(F.col("s0") * 100)).withColumn("s1", F.round(F.col("s1") * 100))
    return sp.gain_bootstrap(px, "positive", "block", 0.2, 2000, 29)


@register("h08_paired_bootstrap", "metric:s valid_replicates:i low:d high:d mean:d",
          f"""WITH {BLOCKED}, {draws_sql('bl', 'block', 1000, 31)},
l AS (SELECT block, positive, 'fused' AS name, fused AS s FROM bl UNION ALL SELECT block, positive, 's0', s0 FROM bl),
c AS (SELECT block, name, s, count(*) AS n, sum(CASE WHEN positive THEN 1 ELSE 0 END) AS pos FROM l GROUP BY 1, 2, 3),
w AS (SELECT rep, name, s, sum(w * n) AS n, sum(w * pos) AS pos FROM dw JOIN c ON dw.block = c.block GROUP BY 1, 2, 3), {curve_sql('w', 'rep, name', 'k')},
d AS (SELECT a.rep, a.auc - z.auc AS auc, a.ap - z.ap AS ap FROM k a JOIN k z ON a.rep = z.rep AND a.name = 'fused' AND z.name = 's0'),
v AS (SELECT 'auc' AS metric, auc AS value FROM d UNION ALL SELECT 'ap', CASE WHEN auc IS NOT NULL THEN ap END FROM d) {interval_sql('v', 'value', 'metric')}""")
def h08(spark, sf):
    px = blocked(spark, sf).withColumn("fused", (F.col("s0") + F.col("s1")) / 2)
    return sp.paired_bootstrap(px, "positive", "fused", "s0", "block", 1000, 31)


@register("h09_buffered_folds", "fold:i role:s rows:i ymin:i ymax:i",
          f"""WITH {b.TRUTH}, k AS (SELECT y, ntile(4) OVER (ORDER BY y) - 1 AS fold FROM (SELECT DISTINCT y FROM truth)),
r AS (SELECT fold, min(y) AS lo, max(y) AS hi FROM k GROUP BY fold)
SELECT fold, role, count(*) AS "rows", min(y) AS ymin, max(y) AS ymax FROM (
  SELECT r.fold, t.y, CASE WHEN t.y >= lo AND t.y <= hi THEN 'test' WHEN t.y < lo - 6 OR t.y > hi + 6 THEN 'train' ELSE 'buffer' END AS role FROM truth t CROSS JOIN r)
GROUP BY fold, role""")
def h09(spark, sf):
    rows = sp.buffered_folds(b.truth(spark, sf).select("y", "x"), "y", 4, 6)
    return rows.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("rows"), F.min("y").alias("ymin"), F.max("y").alias("ymax"))


@register("h10_checkerboard", "y:i x:i fold:i holdout:b",
          f"WITH {b.TRUTH} SELECT y, x, (y // 8 + x // 8) % 5 AS fold, (y // 8 + x // 8) % 5 = 2 AS holdout FROM truth")
def h10(spark, sf):
    return sp.checkerboard(b.truth(spark, sf).select("y", "x"), 8, 5, 2, "y", "x")


@register("h11_spatial_group", "group_key:s fold:i rows:i",
          f"""WITH {b.POINTS3}, g AS (SELECT cast(cast(floor(z / 256) AS BIGINT) AS VARCHAR) || '_' || cast(cast(floor(y / 256) AS BIGINT) AS VARCHAR) || '_' || cast(cast(floor(x / 256) AS BIGINT) AS VARCHAR) AS group_key FROM points3)
SELECT group_key, {hash_sql(3, 'group_key')} % 5 AS fold, count(*) AS "rows" FROM g GROUP BY 1, 2""")
def h11(spark, sf):
    return sp.spatial_group(b.points3(spark, sf), 256, 5, 3).groupBy("group_key", "fold").agg(F.count(F.lit(1)).alias("rows"))


@register("h12_blinded_order", "c_custkey:i rank:i blind_id:s",
          f"""WITH h AS (SELECT c_custkey, row_number() OVER (ORDER BY {hash_sql(13, 'c_custkey')}, c_custkey) AS rank FROM customer)
SELECT c_custkey, rank, 'B' || CASE WHEN rank < 1000 THEN lpad(cast(rank AS VARCHAR), 3, '0') ELSE cast(rank AS VARCHAR) END AS blind_id FROM h""")
def h12(spark, sf):
    return sp.blinded_order(b.table(spark, sf, "customer").select("c_custkey"), "c_custkey", 13)


def spread_metric(counts):
    """A user metric: share of positives among the rows scored at least 0.5."""
    top = F.col("score") >= F.lit(0.5)
    return counts.groupBy("rep").agg(
        F.try_divide(F.sum(F.when(top, F.col("pos"))), F.sum(F.when(top, F.col("n")))).alias("value"))


@register("u01_user_metric_bootstrap", "valid_replicates:i low:d high:d mean:d",
          f"""WITH {BLOCKED}, {draws_sql('bl', 'block', 2000, 17)},
c AS (SELECT block, count(*) FILTER (WHERE s0 >= cast(0.5 AS DOUBLE)) AS n, count(*) FILTER (WHERE positive AND s0 >= cast(0.5 AS DOUBLE)) AS pos FROM bl GROUP BY 1),
v AS (SELECT rep, sum(w * pos) / cast(nullif(sum(w * n), 0) AS DOUBLE) AS value FROM dw JOIN c ON dw.block = c.block GROUP BY rep) {interval_sql('v', 'value')}""")
def u01(spark, sf):
    return sp.block_bootstrap(blocked(spark, sf), "positive", "s0", "block", 2000, 17, spread_metric)
