"""Source, sink, contract, gate and streaming queries."""

from pyspark.sql import functions as F

from surfaudit.operators import contracts as ct, metrics as m, regions as rg
from surfaudit.plans import bindings as b
from surfaudit.plans.registry import register
from surfaudit.plans.suite_evidence import CONSENSUS, consensus
from surfaudit.plans.suite_metrics import ap_sql
from surfaudit.plans.suite_regions import LABEL_STATS, REGIONS, regions
from surfaudit.session import scratch
from surfaudit.sources import arrays, bands, ledgers as ld
from surfaudit.streaming import incremental as inc


# -- sources and sinks -----------------------------------------------------------------------


@register("a01_read_arrays", "path:s y:i x:i value:d",
          f"""WITH {b.CELLS}, {b.TWO_VIEWS}, c AS (SELECT DISTINCT y // 16 AS ky, x // 16 AS kx FROM two),
g AS (SELECT ky, kx, cast(ky AS VARCHAR) || '_' || cast(kx AS VARCHAR) || '.npy' AS path, i // 16 AS y, i % 16 AS x FROM (SELECT *, unnest(range(256)) AS i FROM c))
SELECT g.path, g.y, g.x, t.a AS value FROM g LEFT JOIN two t ON t.y = g.ky * 16 + g.y AND t.x = g.kx * 16 + g.x""")
def a01(spark, sf):
    return arrays.decode_arrays(arrays.encode_chunks(b.two_views(spark, sf), "a", 16), ["y", "x"])


@register("a01_read_bands", "path:s y:i x:i value:d",
          f"""WITH {b.CELLS}, {b.TWO_VIEWS}, c AS (SELECT DISTINCT y // 64 AS ky, x // 64 AS kx FROM two),
g AS (SELECT ky, kx, cast(ky AS VARCHAR) || '_' || cast(kx AS VARCHAR) || '.npy' AS path, i // 64 AS y, i % 64 AS x FROM (SELECT *, unnest(range(4096)) AS i FROM c))
SELECT g.path, g.y, g.x, t.a AS value FROM g LEFT JOIN two t ON t.y = g.ky * 64 + g.y AND t.x = g.kx * 64 + g.x""")
def a01_bands(spark, sf):
    folder = scratch(spark, "arrays")
    bands.write_array_files(arrays.encode_chunks(b.two_views(spark, sf), "a", 64), folder)
    found = bands.read_array_bands(spark, folder, ["y", "x"], elements=1000)
    return found.withColumn("path", F.substring_index("path", "/", -1))


@register("a02_read_regions", "region_id:s valid_px:i positive_px:i mean:d",
          f"WITH {REGIONS} SELECT region_id, valid_px, positive_px, mean FROM regions WHERE eligible")
def a02(spark, sf):
    path = ld.scratch(spark, "regions")
    ld.write_report(regions(spark, sf).select("region_id", "valid_px", "positive_px", "mean", "eligible"), path, "csv")
    return ld.read_regions(spark, path, "region_id string, valid_px bigint, positive_px bigint, mean double, eligible string")


def catalog_text(spark, sf):
    """Catalog documents as JSON text, one per customer, lists sized by the data."""
    i = F.col("c_custkey")
    scan = lambda k: F.struct(F.concat_ws("-", i.cast("string"), k.cast("string")).alias("id"),
                              F.when(k < 3, k.cast("double") * F.lit(2.4)).alias("px"), (i % 5 + k).cast("double").alias("energy"))
    render = lambda k: F.struct((i + k).cast("string").alias("volume"), F.concat(F.lit("m"), (k % 2).cast("string")).alias("model"),
                                F.lit("u").alias("url"))
    some = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(1).cast("bigint"), F.greatest(n, F.lit(1))), f))
    doc = F.struct(
        i.cast("string").alias("id"), some(i % 4, scan).alias("scans"),
        some(i % 3, lambda k: F.struct(k.cast("string").alias("id"), F.col("c_mktsegment").alias("label"), some(k, render).alias("renders"))).alias("segments"))
    return b.table(spark, sf, "customer").select(F.to_json(doc).alias("value"))


@register("a03_catalog_scans", "sample:s scan:s px:d energy:d",
          """WITH s AS (SELECT c_custkey AS i, unnest(CASE WHEN c_custkey % 4 = 0 THEN [NULL] ELSE range(1, c_custkey % 4 + 1) END) AS k FROM customer)
SELECT cast(i AS VARCHAR) AS sample, cast(i AS VARCHAR) || '-' || cast(k AS VARCHAR) AS scan, CASE WHEN k < 3 THEN k * cast(2.4 AS DOUBLE) END AS px, i % 5 + k AS energy FROM s""")
def a03(spark, sf):
    return ld.explode_catalog(ld.parse_catalog(catalog_text(spark, sf)), "scans")


@register("a03_catalog_renders", "sample:s segment:s label:s volume:s model:s",
          """WITH s AS (SELECT c_custkey AS i, c_mktsegment AS g, unnest(CASE WHEN c_custkey % 3 = 0 THEN [NULL] ELSE range(1, c_custkey % 3 + 1) END) AS k FROM customer),
r AS (SELECT *, unnest(CASE WHEN k IS NULL THEN [NULL] ELSE range(1, k + 1) END) AS j FROM s)
SELECT cast(i AS VARCHAR) AS sample, cast(k AS VARCHAR) AS segment, CASE WHEN k IS NOT NULL THEN g END AS label, cast(i + j AS VARCHAR) AS volume,
  'm' || cast(j % 2 AS VARCHAR) AS model FROM r""")
def a03_renders(spark, sf):
    return ld.explode_catalog(ld.parse_catalog(catalog_text(spark, sf)), "renders")


def receipt_text(spark, sf):
    """One receipt per document: JSON text whose regime, tier and checks depend on the row."""
    i = F.col("doc_id")
    checks = F.create_map(F.lit("quality"), F.col("quality") == 1, F.lit("clean"), F.col("toxic") == 0)
    doc = F.struct(
        F.when(i % 17 == 0, "receipt/0.9").otherwise("receipt/1.0").alias("schema_version"),
        F.when(i % 3 == 0, "VALIDATION").when(i % 3 == 1, "DEV").otherwise("DISCOVERY").alias("regime"),
        F.concat(F.lit("G"), (i % 4).cast("string")).alias("geometry_tier"), F.lit("complete").alias("status"),
        F.when(i % 11 != 0, checks).alias("go_checks"))
    return b.table(spark, sf, "documents").join(b.table(spark, sf, "labels"), "doc_id").select(
        F.col("doc_id"), F.sha2("text", 256).alias("sha"), "quality", "toxic", F.to_json(doc).alias("value"))


RECEIPTS = """receipts AS (SELECT d.doc_id, sha256(d.text) AS sha, l.quality, l.toxic,
  CASE d.doc_id % 3 WHEN 0 THEN 'VALIDATION' WHEN 1 THEN 'DEV' ELSE 'DISCOVERY' END AS regime, 'G' || cast(d.doc_id % 4 AS VARCHAR) AS tier,
  CASE WHEN d.doc_id % 11 = 0 THEN 0 ELSE 2 END AS checks_total,
  CASE WHEN d.doc_id % 11 = 0 THEN 0 ELSE (CASE WHEN quality = 1 THEN 1 ELSE 0 END) + (CASE WHEN toxic = 0 THEN 1 ELSE 0 END) END AS checks_passed
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


@register("a04_read_receipts", "doc_id:i regime:s tier:s quality_ok:b clean_ok:b",
          f"""WITH {RECEIPTS} SELECT doc_id, regime, tier, CASE WHEN checks_total > 0 THEN quality = 1 END AS quality_ok,
CASE WHEN checks_total > 0 THEN toxic = 0 END AS clean_ok FROM receipts""")
def a04(spark, sf):
    r = ld.parse_receipts(receipt_text(spark, sf))
    return r.select("doc_id", "regime", F.col("geometry_tier").alias("tier"), F.col("go_checks")["quality"].alias("quality_ok"),
                    F.col("go_checks")["clean"].alias("clean_ok"))


def raw_listing(spark, sf):
    i, name = F.col("doc_id"), F.concat_ws("/", "source", (F.col("doc_id") % 400).cast("string"))
    return b.table(spark, sf, "documents").select(
        F.when(i % 3 == 0, name).alias("name"), F.when(i % 3 == 1, name).alias("ref"), F.when(i % 3 == 2, name).alias("file_name"),
        F.when(i % 2 == 0, F.col("n_chars")).alias("total_bytes"), F.when(i % 2 == 1, F.col("n_chars")).alias("size"),
        F.lit("2024").alias("creation_date"))


@register("a05_normalize_listing", "name:s bytes:i created:s",
          "SELECT source || '/' || cast(doc_id % 400 AS VARCHAR) AS name, n_chars AS bytes, '2024' AS created FROM documents")
def a05(spark, sf):
    return ld.normalize_listing(raw_listing(spark, sf))


@register("a05_listing_conflicts", "name:s versions:i",
          """SELECT source || '/' || cast(doc_id % 400 AS VARCHAR) AS name, count(DISTINCT n_chars) AS versions FROM documents GROUP BY 1 HAVING count(DISTINCT n_chars) > 1""")
def a05_conflicts(spark, sf):
    return ld.listing_conflicts(ld.normalize_listing(raw_listing(spark, sf)))


@register("a06_write_maps", "cy:i y:i x:i consensus:d accepted:b",
          f"WITH {b.CELLS}, {CONSENSUS} SELECT y // 32 AS cy, y, x, consensus, accepted FROM decided")
def a06(spark, sf):
    path = ld.scratch(spark, "maps")
    ld.write_maps(consensus(spark, sf).withColumn("cy", F.floor(F.col("y") / 32)), path, ["cy"])
    return spark.read.parquet(path)


@register("a07_write_report", "pixels:i valid_px:i positive_px:i",
          f"WITH {b.TRUTH} SELECT count(*) AS pixels, count(*) FILTER (WHERE valid) AS valid_px, count(*) FILTER (WHERE positive) AS positive_px FROM truth")
def a07(spark, sf):
    path = ld.scratch(spark, "report")
    report = b.truth(spark, sf).agg(F.count(F.lit(1)).alias("pixels"), F.count_if("valid").alias("valid_px"), F.count_if("positive").alias("positive_px"))
    ld.write_report(report, path)
    return spark.read.json(path, schema="pixels bigint, valid_px bigint, positive_px bigint")


@register("a08_fill_sparse", "y:i x:i z:i v:i",
          f"""WITH {b.VOXELS}, {b.TRUTH} SELECT t.y, t.x, k.z, coalesce(v, 0) AS v FROM truth t CROSS JOIN (SELECT unnest(range(7)) AS z) k
LEFT JOIN voxels o ON o.y = t.y AND o.x = t.x AND o.z = k.z""")
def a08(spark, sf):
    keys = b.truth(spark, sf).select("y", "x", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("z"))
    return ld.fill_sparse(keys, b.voxels(spark, sf), ["y", "x", "z"], "v")


@register("a09_verify_content", "path:s problem:s",
          f"""WITH {b.MANIFEST}, m AS (SELECT path, octet_length(encode(text)) + CASE WHEN doc_id % 70 = 0 THEN 1 ELSE 0 END AS n, CASE WHEN doc_id % 90 = 7 THEN 'x' ELSE sha END AS s FROM manifest WHERE role <> 'de'),
f AS (SELECT path, octet_length(encode(text)) AS n, sha AS s FROM manifest WHERE surface <> 'src4')
SELECT * FROM (SELECT coalesce(m.path, f.path) AS path, CASE WHEN m.path IS NULL THEN 'unlisted' WHEN f.path IS NULL THEN 'missing' WHEN m.n <> f.n THEN 'size_mismatch'
  WHEN m.s <> f.s THEN 'hash_mismatch' END AS problem FROM m FULL JOIN f ON m.path = f.path) WHERE problem IS NOT NULL""")
def a09(spark, sf):
    man = b.manifest(spark, sf)
    i = F.col("doc_id")
    listed = man.where("role <> 'de'").select(  # one language is not listed, one source not delivered
        "path", (F.octet_length("text") + F.when(i % 70 == 0, 1).otherwise(0)).alias("bytes"), F.when(i % 90 == 7, "x").otherwise(F.col("sha")).alias("sha"))
    files = man.where("surface <> 'src4'").select("path", F.encode("text", "UTF-8").alias("content"))
    return ld.verify_content(files, listed)


@register("a10_snapshot_hash", "digest:s rows:i",
          f"""WITH {b.MANIFEST}, l AS (SELECT sha256('{{"path":"' || path || '","bytes":' || cast(bytes AS VARCHAR) || ',"sha":"' || sha || '"}}') AS h FROM manifest),
n0 AS (SELECT h, h || ':' || cast(count(*) AS VARCHAR) AS t FROM l GROUP BY h),
n1 AS (SELECT substr(h, 1, 4) AS h, sha256(string_agg(t, ',' ORDER BY t)) AS d FROM n0 GROUP BY 1), t1 AS (SELECT h, h || ':' || d AS t FROM n1),
n2 AS (SELECT substr(h, 1, 2) AS h, sha256(string_agg(t, ',' ORDER BY t)) AS d FROM t1 GROUP BY 1), t2 AS (SELECT h, h || ':' || d AS t FROM n2)
SELECT sha256(string_agg(t, ',' ORDER BY t)) AS digest, (SELECT count(*) FROM manifest) AS "rows" FROM t2""")
def a10(spark, sf):
    return ld.snapshot_hash(b.manifest(spark, sf), ["path", "bytes", "sha"])


@register("a11_pending", "event_id:i", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def a11(spark, sf):
    done = b.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event_id"))
    return ld.pending(b.table(spark, sf, "events"), done, ["event_id"]).select("event_id")


# -- contracts and gates -----------------------------------------------------------------------


@register("b19_validate_package", "key:s problem:s",
          """WITH c AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 50 <> 1 THEN p_partkey * 7 % 100 END AS y0, p_partkey * 7 % 100 + p_size - 3 AS y1, p_size > 2 AS uv, p_size > 1 AS xyz,
  p_partkey - CASE WHEN p_partkey % 400 = 2 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 500 = 0 THEN 100000000 ELSE 0 END AS rank FROM part)
SELECT cast(id AS VARCHAR) AS key, 'incomplete_bounds' AS problem FROM c WHERE y0 IS NULL
UNION ALL SELECT cast(id AS VARCHAR), 'invalid_bounds' FROM c WHERE y0 IS NULL OR y0 >= y1
UNION ALL SELECT cast(id AS VARCHAR), 'no_uv_bounds' FROM c WHERE NOT uv UNION ALL SELECT cast(id AS VARCHAR), 'no_xyz_bounds' FROM c WHERE NOT xyz
UNION ALL SELECT cast(id AS VARCHAR), 'rank_out_of_range' FROM c WHERE rank < 1 OR rank > (SELECT count(*) FROM c)
UNION ALL SELECT cast(rank AS VARCHAR), 'repeated_rank' FROM c GROUP BY rank HAVING count(*) > 1""")
def b19(spark, sf):
    k = F.col("p_partkey")
    c = b.table(spark, sf, "part").select(
        k.alias("candidate_id"), F.when(k % 50 != 1, k * 7 % 100).alias("y0"), (k * 7 % 100 + F.col("p_size") - 3).alias("y1"),
        F.lit(0).alias("x0"), F.lit(1).alias("x1"), (F.col("p_size") > 2).alias("has_uv"), (F.col("p_size") > 1).alias("has_xyz"),
        (k - F.when(k % 400 == 2, 1).otherwise(0) + F.when(k % 500 == 0, 100000000).otherwise(0)).alias("rank"))
    return ct.validate_package(c, "G2")


@register("l01_view_contract", "key:s problem:s",
          f"""WITH {b.VIEWS}, w AS (SELECT CASE WHEN ord % 13 = 0 THEN '' WHEN ord % 17 = 0 THEN 'same' ELSE view_id END AS id, CASE WHEN ord % 19 <> 0 THEN grp END AS grp FROM views)
SELECT id AS key, 'empty_id' AS problem FROM w WHERE id = '' UNION ALL SELECT id, 'no_group' FROM w WHERE grp IS NULL
UNION ALL SELECT id, 'repeated_id' FROM w GROUP BY id HAVING count(*) > 1
UNION ALL SELECT cast(count(DISTINCT grp) AS VARCHAR), 'too_few_groups' FROM w HAVING count(DISTINCT grp) < 40""")
def l01(spark, sf):
    o = F.col("ord")
    views = b.views(spark, sf).withColumn("view_id", F.when(o % 13 == 0, "").when(o % 17 == 0, "same").otherwise(F.col("view_id"))).withColumn(
        "grp", F.when(o % 19 != 0, F.col("grp")))
    return ct.view_contract(views, 40, {"evidence": 0.6, "support": 1.0, "disagreement": 0.3})


@register("l01_coverage", "view_id:i pixels:i canvas:i aligned:b",
          f"""WITH {b.CELLS} SELECT view_id, count(*) AS pixels, (SELECT count(*) FROM (SELECT DISTINCT y, x FROM cells)) AS canvas,
count(*) = (SELECT count(*) FROM (SELECT DISTINCT y, x FROM cells)) AS aligned FROM cells GROUP BY view_id""")
def l01_coverage(spark, sf):
    return ct.coverage(b.cells(spark, sf))


@register("l02_gates", "ap:d9 margin:d passed:b status:s ap_ok:b margin_ok:b pixels_ok:b",
          f"""WITH {b.SCORED_ALL}, {ap_sql('scored', score='s0')}, g AS (SELECT (SELECT ap FROM ap) AS ap, count(*) AS n,
 avg(s0) FILTER (WHERE positive) - avg(s0) FILTER (WHERE NOT positive) AS margin FROM scored)
SELECT ap, margin, ap >= cast(0.3 AS DOUBLE) AND margin >= cast(0.2 AS DOUBLE) AND n >= 1000 AS passed,
 CASE WHEN ap >= cast(0.3 AS DOUBLE) AND margin >= cast(0.2 AS DOUBLE) AND n >= 1000 THEN 'GO' ELSE 'NO_GO' END AS status,
 ap >= cast(0.3 AS DOUBLE) AS ap_ok, margin >= cast(0.2 AS DOUBLE) AS margin_ok, n >= 1000 AS pixels_ok FROM g""")
def l02(spark, sf):
    px = b.scored(spark, sf)
    margin = m.class_margin(px, "positive", "s0").select("margin").scalar()
    metrics = m.average_precision(px, "positive", "s0").withColumn("margin", margin)
    out = ct.gates(metrics, {"ap": F.col("ap") >= F.lit(0.3), "margin": F.col("margin") >= F.lit(0.2), "pixels": F.col("n") >= 1000})
    return out.select("ap", "margin", "passed", "status", F.col("checks")["ap"].alias("ap_ok"),
                      F.col("checks")["margin"].alias("margin_ok"), F.col("checks")["pixels"].alias("pixels_ok"))


@register("l03_ladder", "cy:i cx:i status:s",
          f"""WITH {b.TRUTH}, {LABEL_STATS} SELECT cy, cx, CASE WHEN valid_px < 500 THEN 'NO_GO_REGISTRATION' WHEN positive_px = 0 THEN 'NO_GO_NO_COMMON_GEOMETRY_SUPPORT'
WHEN both_chunks = 0 THEN 'NO_GO_SINGLE_CLASS_COMMON_SUPPORT' ELSE 'GO_SCORE_COMPARISON' END AS status FROM flag""")
def l03(spark, sf):
    stats = rg.label_stats(b.truth(spark, sf), ["cy", "cx"]).where("cy is not null")
    return ct.ladder(stats, [(F.col("valid_px") < 500, ct.NO_REGISTRATION), (F.col("positive_px") == 0, ct.NO_SUPPORT),
                             (F.col("both_chunks") == 0, ct.SINGLE_CLASS)], ct.COMPARE)


@register("l04_partition_gate", "valid_px:i positive_px:i negative_px:i both_chunks:i passed:b status:s",
          f"""WITH {b.TRUTH}, {LABEL_STATS}, t AS (SELECT sum(valid_px) AS valid_px, sum(positive_px) AS positive_px, sum(valid_px) - sum(positive_px) AS negative_px, sum(both_chunks) AS both_chunks FROM flag)
SELECT *, positive_px >= 1000 AND negative_px >= 1000 AND both_chunks >= 20 AS passed,
 CASE WHEN positive_px >= 1000 AND negative_px >= 1000 AND both_chunks >= 20 THEN 'CONTINUE_GEOMETRY_GATES' ELSE 'NO_GO_LABEL_DIVERSITY_UPPER_BOUND' END AS status FROM t""")
def l04(spark, sf):
    stats = rg.label_stats(b.truth(spark, sf), ["cy", "cx"]).where("cy is not null")
    return ct.partition_gate(stats, 1000, 1000, 20)


@register("l05_geometry_tier", "cy:i cx:i tier:s blockers:s",
          f"""WITH {b.TRUTH}, {LABEL_STATS}, a AS (SELECT cy, cx, valid_px > 300 AS bo, positive_px > 200 AS co, (cy + cx) % 2 = 0 AS go FROM flag)
SELECT cy, cx, CASE WHEN bo AND co AND go THEN 'G2' ELSE 'G1' END AS tier,
 concat_ws(',', CASE WHEN NOT bo THEN 'volume_bounds' END, CASE WHEN NOT co THEN 'ct_support' END, CASE WHEN NOT go THEN 'grid_checks' END) AS blockers FROM a""")
def l05(spark, sf):
    audit = rg.label_stats(b.truth(spark, sf), ["cy", "cx"]).where("cy is not null").select(
        "cy", "cx", (F.col("valid_px") > 300).alias("bounds_ok"), (F.col("positive_px") > 200).alias("ct_ok"),
        ((F.col("cy") + F.col("cx")) % 2 == 0).alias("grid_ok"))
    return ct.geometry_tier(audit).withColumn("blockers", F.concat_ws(",", "blockers"))


def ledger(spark, sf):
    r = ld.parse_receipts(receipt_text(spark, sf))
    i = F.col("doc_id")
    receipts = r.select(i.alias("artifact"), "sha", "regime", F.col("geometry_tier").alias("tier"), "go_checks", "schema_version",
                        F.when(i % 5 != 0, ct.POST_HOC).alias("analysis_type"))
    entries = r.select(
        i.alias("artifact"), i.alias("evidence_id"), F.when(i % 50 == 0, "bad").otherwise(F.col("sha")).alias("declared_sha"),
        F.when(i % 43 == 0, None).when(i % 3 == 0, "locked_validation").when(i % 7 == 0, "development").otherwise("post_hoc").alias("role"),
        F.lit("receipt/1.0").alias("expected_schema"), F.concat(F.lit("a"), i.cast("string")).alias("declared_audit_sha"), (i % 4).alias("declared_groups"), (F.col("quality") == 1).alias("truth_independent"))
    audits = r.where(F.col("toxic") == 0).select(
        i.alias("artifact"), F.when(i % 31 == 0, "other").otherwise(F.col("sha")).alias("subject_sha"),
        (i % 5).alias("effective_groups"), (i % 5 >= 2).alias("gate_passed"),
        F.when(i % 37 != 0, F.concat(F.lit("a"), i.cast("string"))).alias("audit_sha"),
        F.when(i % 29 == 0, "other/1.0").otherwise(ct.AUDIT_SCHEMA).alias("audit_schema"))
    return ct.claim_ceiling(entries, receipts, audits)


CLAIMS = f"""{RECEIPTS}, e AS (SELECT *, CASE WHEN doc_id % 50 = 0 THEN 'bad' ELSE sha END AS declared,
  CASE WHEN doc_id % 43 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'locked_validation' WHEN doc_id % 7 = 0 THEN 'development' ELSE 'post_hoc' END AS role, toxic = 0 AS audited FROM receipts),
p AS (SELECT *, CASE WHEN role IS NULL THEN 'unknown_role' WHEN declared <> sha THEN 'hash_mismatch' WHEN doc_id % 17 = 0 THEN 'schema_mismatch' WHEN role = 'locked_validation' AND regime <> 'VALIDATION' THEN 'role_regime_mismatch'
   WHEN role = 'development' AND regime <> 'DEV' THEN 'role_regime_mismatch' WHEN role = 'post_hoc' AND doc_id % 5 = 0 THEN 'not_post_hoc'
   WHEN audited AND doc_id % 37 = 0 THEN 'audit_hash_mismatch' WHEN audited AND doc_id % 29 = 0 THEN 'audit_schema_mismatch' WHEN audited AND doc_id % 31 = 0 THEN 'audit_not_bound' END AS problem,
  CASE WHEN audited THEN doc_id % 5 ELSE least(doc_id % 4, 1) END AS groups FROM e),
claims AS (SELECT doc_id AS evidence_id, role, tier, groups, checks_passed, checks_total, problem,
  coalesce(role, '') = 'locked_validation' AND checks_total > 0 AND checks_passed = checks_total AND tier IN ('G2', 'G3') AND audited AND doc_id % 5 >= 2 AND groups >= 2 AND quality = 1 AND problem IS NULL AS eligible FROM p)"""


@register("l06_claim_ceiling", "evidence_id:i role:s tier:s groups:i checks_passed:i checks_total:i problem:s eligible:b",
          f"WITH {CLAIMS} SELECT * FROM claims")
def l06(spark, sf):
    return ledger(spark, sf)


@register("l06_claim_summary", "receipts:i confirmations:i locked:i post_hoc:i problems:i status:s guardrail:b",
          f"""WITH {CLAIMS} SELECT count(*) AS receipts, count(*) FILTER (WHERE eligible) AS confirmations, count(*) FILTER (WHERE role = 'locked_validation') AS locked,
 count(*) FILTER (WHERE role = 'post_hoc') AS post_hoc, count(problem) AS problems, CASE WHEN count(*) FILTER (WHERE eligible) > 0 THEN 'CLAIM_READY' ELSE 'NO_GO_SUBMISSION_CLAIM' END AS status,
 count(*) FILTER (WHERE role = 'locked_validation') > 0 AND count(*) FILTER (WHERE role = 'post_hoc') > 0 AND count(*) FILTER (WHERE eligible) = 0 AS guardrail FROM claims""")
def l06_summary(spark, sf):
    return ct.claim_summary(ledger(spark, sf))


@register("l07_freeze_lock", "key:s problem:s",
          f"""WITH {b.MANIFEST}, v AS (SELECT * FROM manifest WHERE regime = 'VALIDATION')
SELECT path AS key, 'not_frozen' AS problem FROM v WHERE doc_id % 4 = 0 UNION ALL SELECT path, 'no_method_hash' FROM v WHERE bytes % 10 = 0
UNION ALL SELECT path, 'no_partition' FROM v WHERE doc_id % 8 = 1 UNION ALL SELECT path, 'already_revealed' FROM v WHERE doc_id % 9 = 4""")
def l07(spark, sf):
    i = F.col("doc_id")
    rows = b.manifest(spark, sf).select(
        "path", "regime", F.when(i % 4 != 0, ct.FROZEN).alias("freeze_state"), F.when(F.col("bytes") % 10 != 0, F.col("sha")).alias("method_sha"),
        F.when(i % 8 != 1, "p1").otherwise("").alias("partition_id"), (i % 9 == 4).cast("int").alias("reveals"))
    return ct.freeze_lock(rows, "path")


@register("l08_provenance_match", "key:s problem:s",
          """WITH p AS (SELECT page_id, url || CASE WHEN page_id % 3 = 0 THEN '/' WHEN page_id % 3 = 1 THEN '' ELSE 'x' END AS declared, url, page_id % 4 AS lvl FROM pages)
SELECT cast(page_id AS VARCHAR) AS key, 'source_mismatch' AS problem FROM p WHERE rtrim(declared, '/') <> rtrim(url, '/')
UNION ALL SELECT cast(page_id AS VARCHAR), 'level_mismatch' FROM p WHERE lvl <> 2""")
def l08(spark, sf):
    i = F.col("page_id")
    attrs = b.table(spark, sf, "pages").select(
        "page_id", "url", F.concat("url", F.when(i % 3 == 0, "/").when(i % 3 == 1, "").otherwise("x")).alias("declared_source"), (i % 4).alias("declared_level"))
    return ct.provenance_match(attrs, "page_id", F.col("url"), F.lit(2))


def selection(spark, sf):
    i = F.col("doc_id")
    man = b.manifest(spark, sf)
    host = F.when(i % 6 == 5, "https://other.org/").otherwise("https://data.org/")
    files = man.where("role <> 'de'").select("path", F.when(i % 10 != 3, F.col("bytes")).alias("bytes"), F.concat(host, "path").alias("url"))
    wanted = man.select(F.col("path").alias("name")).unionAll(man.where("surface = 'src4' and role = 'fr'").select("path"))
    return ct.select_manifest(wanted, files, "src1", ["data.org"], "/19")


SELECTION = f"""{b.MANIFEST}, sel AS (SELECT path AS name, CASE WHEN role <> 'de' AND doc_id % 10 <> 3 THEN bytes END AS bytes,
 CASE WHEN surface = 'src4' AND role = 'fr' THEN 'requested_twice' WHEN NOT starts_with(path, 'src1') THEN 'outside_prefix' WHEN contains(path, '/19') THEN 'forbidden_path' WHEN role = 'de' THEN 'absent'
      WHEN doc_id % 10 = 3 OR bytes <= 0 THEN 'unknown_size' WHEN doc_id % 6 = 5 THEN 'host_not_allowed' END AS problem FROM manifest)"""


@register("l09_select_manifest", "name:s bytes:i problem:s", f"WITH {SELECTION} SELECT * FROM sel")
def l09(spark, sf):
    return selection(spark, sf)


@register("l09_selection_cap", "requested:i selected:i bytes:i within_cap:b",
          f"""WITH {SELECTION} SELECT count(*) AS requested, count(*) FILTER (WHERE problem IS NULL) AS selected, coalesce(sum(bytes) FILTER (WHERE problem IS NULL), 0) AS bytes,
 coalesce(sum(bytes) FILTER (WHERE problem IS NULL), 0) <= 400000 AS within_cap FROM sel""")
def l09_cap(spark, sf):
    return ct.selection_cap(selection(spark, sf), 400000)


# -- streaming ------------------------------------------------------------------------------------


def _screen(rows):
    return rows.where(F.col("value") >= 10).select("event_id", "user_id", "event_type", "value")


@register("m01_incremental", "event_type:s rows:i total:d3",
          "SELECT event_type, count(*) AS \"rows\", sum(value) AS total FROM events WHERE value >= 10 GROUP BY event_type")
def m01(spark, sf):
    sink, state = ld.scratch(spark, "stream"), ld.scratch(spark, "state")
    stream = inc.arrivals(spark, sf, b.table(spark, sf, "events").schema, "events.parquet")
    inc.run_incremental(stream, _screen, sink, state)
    return spark.read.parquet(sink).groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.sum("value").alias("total"))


@register("m02_progress", "batches:i done:i verified:d3 total:i fraction:d",
          """SELECT 1 AS batches, count(*) FILTER (WHERE value >= 10) AS done, sum(value) FILTER (WHERE value >= 10) AS verified, count(*) AS total,
count(*) FILTER (WHERE value >= 10) / cast(count(*) AS DOUBLE) AS fraction FROM events""")
def m02(spark, sf):
    sink, log, state = (ld.scratch(spark, n) for n in ("stream", "progress", "state"))
    events = b.table(spark, sf, "events")
    inc.run_with_progress(inc.arrivals(spark, sf, events.schema, "events.parquet"), _screen, sink, log, state, "value")
    return inc.progress(spark, log, events)
