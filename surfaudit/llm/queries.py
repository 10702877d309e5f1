"""The registered corpus queries: fn(spark, sf_dir), and their SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from surfaudit.llm.bpe import encode_texts
from surfaudit.llm.common import table
from surfaudit.llm.decontaminate import contamination_report
from surfaudit.llm.html_text import page_texts
from surfaudit.llm.language import identify_languages
from surfaudit.llm.lm_scoring import score_documents
from surfaudit.llm.resampling import clean_ids, resample, target_share
from surfaudit.llm.sharding import shard_documents
from surfaudit.llm.simhash import simhash_components
from surfaudit.llm.spelling import spelling_variants
from surfaudit.llm.substring import GRAM, WINDOW, cut_spans
from surfaudit.llm.toxicity import score_toxicity
from surfaudit.llm.turn_trie import conversation_trie
from surfaudit.llm.vectors import near_vectors


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of `documents`; null texts and texts without a letter are `und`, rows of one id are judged apart."""
    return identify_languages(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 20-word windows of `documents`, first places kept; a null text has no word, rows of one id are ordered by their text."""
    cut = cut_spans(table(spark, sf_dir, "documents"), ["doc_id"], WINDOW, GRAM, "doc_id", "text")
    return cut.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every text of `documents`; null texts have no word, repeated rows give a row each."""
    found = contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), items, "contaminated")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text of `documents` and their decoding; null and empty texts have no token."""
    coded = encode_texts(table(spark, sf_dir, "documents"), decoded=True)
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log weight and Gumbel key of every text of `documents`; texts without words have no weight, ties go by key."""
    labels = table(spark, sf_dir, "labels")
    return resample(table(spark, sf_dir, "documents"), clean_ids(labels), target_share(labels))


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of every text of `documents` and its component; texts without words share fingerprint zero."""
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page of `pages`; null and empty html give an empty text."""
    return page_texts(table(spark, sf_dir, "pages"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of every whole text of `documents` under the clean and the whole corpus; empty texts have none."""
    return score_documents(table(spark, sf_dir, "documents"), clean_ids(table(spark, sf_dir, "labels")))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector of `embeddings`; vectors that are null, zero or not finite stay alone."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of `documents` under the law `bytes`; a null text has one byte, copies stay together below a grain."""
    placed = shard_documents(table(spark, sf_dir, "documents"), shards=16)
    none = F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", none)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every whole text; see ``score_toxicity``."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all conversations; see ``conversation_trie``."""
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of all documents with its form and root; see ``spelling_variants``."""
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_importance_resampling": op5_importance_resampling,
    "op6_simhash_components": op6_simhash_components,
    "op7_html_text": op7_html_text,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_near_vectors": op9_near_vectors,
    "op10_kd_shards": op10_kd_shards,
    "op11_toxicity": op11_toxicity,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_spelling_variants": op13_spelling_variants,
}

# CRC-32 of the UTF-8 of a string {0} of code points below 2048, bit by bit.
CRC32_SQL = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split({0}, ''), lambda q: CASE
    WHEN unicode(q) < 128 THEN [CAST(unicode(q) AS BIGINT)] ELSE [192 + (CAST(unicode(q) AS BIGINT) >> 6), 128 + (CAST(unicode(q) AS BIGINT) & 63)] END))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda u, z: xor(u >> 1, 3988292384 * (u & 1)))), 4294967295)"""

OP12_SQL = """
WITH t AS (
    SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
    FROM conversations WHERE conv_id IS NOT NULL
), c AS (
    SELECT conv_id, conv_id - conv_id % 100 AS b, {crc} % 6 AS h FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM t) AS d
), turns AS (
    SELECT c.conv_id, 0 AS part, i, r, x FROM c JOIN t ON t.conv_id = c.b AND t.i <= c.h
    UNION ALL SELECT c.conv_id, 1 AS part, i, r, x FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h
), p AS (
    SELECT c.conv_id, coalesce(list({{'r': r, 'x': x}} ORDER BY part, i) FILTER (WHERE r IS NOT NULL), []) AS k
    FROM c LEFT JOIN turns ON turns.conv_id = c.conv_id GROUP BY c.conv_id
), m AS (
    SELECT conv_id, k[1:d] AS k, d, len(k) = d AS ends FROM (SELECT conv_id, k, unnest(generate_series(0, len(k))) AS d FROM p) AS e
), n AS (
    SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
    FROM m GROUP BY k, d
), kids AS (
    SELECT k[1:d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY k[1:d - 1]
), own AS (
    SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * length(n.k[d].x) END AS saved
    FROM n LEFT JOIN kids ON kids.k = n.k
), sums AS (
    SELECT k, count(*) FILTER (WHERE leaf) AS n_leaves, sum(saved) AS saved_tokens
    FROM (SELECT k[1:e] AS k, leaf, saved FROM (SELECT k, n_children = 0 AS leaf, saved, unnest(generate_series(0, d)) AS e FROM own) AS o) AS a GROUP BY k
)
SELECT own.conv_id, CAST(own.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, own.n_convs, CAST(own.n_children AS BIGINT) AS n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, own.ends_sha256
FROM own JOIN sums ON sums.k = own.k LEFT JOIN n AS up ON own.d > 0 AND up.d = own.d - 1 AND up.k = own.k[1:own.d - 1]
""".format(crc=CRC32_SQL.format("s"))

OP2_SQL = r"""
WITH w AS (
    SELECT doc_id, [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents
), win AS (
    SELECT doc_id, s, list_aggregate(ws[s:s + 19], 'string_agg', ' ') AS k
    FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS s FROM w WHERE len(ws) >= 20) AS t
), again AS (
    SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM win) AS t WHERE r > 1
), gone AS (
    SELECT DISTINCT doc_id, s + o AS i FROM again, generate_series(0, 19) AS g(o)
), word AS (
    SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w
), kept AS (
    SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

OP3_SQL = r"""
WITH w AS (
    SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS ws FROM documents
), b AS (
    SELECT item_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS ws FROM benchmark
), bw AS (
    SELECT DISTINCT item_id, n, list_aggregate(ws[s:s + n - 1], 'string_agg', ' ') AS k
    FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(generate_series(1, len(ws) - least(10, len(ws)) + 1)) AS s FROM b WHERE len(ws) > 0) AS t
), lens AS (
    SELECT DISTINCT n FROM bw
), dw AS (
    SELECT doc_id, n, s, list_aggregate(ws[s:s + n - 1], 'string_agg', ' ') AS k
    FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS s FROM w, lens WHERE len(ws) >= n) AS t
), hit AS (
    SELECT DISTINCT doc_id, dw.n, s, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n
), words AS (
    SELECT doc_id, count(DISTINCT s + o) AS n_hit FROM hit, generate_series(0, 9) AS g(o) WHERE o < n GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) AS t GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words ON w.doc_id = words.doc_id LEFT JOIN items ON w.doc_id = items.doc_id
"""

OP9_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), sims AS (
    SELECT a.vec_id AS s, b.vec_id AS t, list_cosine_similarity(a.e, b.e) AS c FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id
), p AS (
    SELECT s, t FROM sims WHERE isfinite(c) AND c >= CAST(0.9 AS DOUBLE)
), r AS (
    SELECT vec_id AS id, vec_id AS lab FROM v UNION SELECT p.t, r.lab FROM r JOIN p ON p.s = r.id AND r.lab < p.t
), c AS (
    SELECT id, min(lab) AS component_id FROM r GROUP BY id
), n AS (
    SELECT s, count(*) AS n FROM p GROUP BY s
)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, vec_id = c.component_id AS kept
FROM v JOIN c ON c.id = v.vec_id LEFT JOIN n ON n.s = v.vec_id
"""

OP13_SQL = """
WITH RECURSIVE d AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents
), r AS (
    SELECT doc, w, count(*) AS n FROM (SELECT doc, unnest(regexp_extract_all(t, '[A-Za-zÀ-ÿ]+')) AS w FROM d) AS e WHERE length(w) >= 7 GROUP BY doc, w
), h AS (
    SELECT w, n, {crc} AS h FROM (SELECT w, n, doc || ':' || w AS s FROM r) AS k
), words AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, n FROM h
    ) AS s WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), hole AS (
    SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM words) AS u
), pairs AS (
    SELECT x.word AS u, y.word AS v, y.n AS vn FROM hole AS x JOIN hole AS y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
    UNION SELECT x.word, y.word, y.n FROM words AS x JOIN hole AS y ON x.word = y.a || y.b
    UNION SELECT y.word, x.word, x.n FROM words AS x JOIN hole AS y ON x.word = y.a || y.b
), best AS (
    SELECT u, count(*) AS n_near, max(vn) AS most FROM pairs GROUP BY u
), named AS (
    SELECT best.u, n_near, most, min(v) AS v FROM best JOIN pairs ON pairs.u = best.u AND vn = most GROUP BY best.u, n_near, most
), f AS (
    SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * words.n THEN v END AS form, CASE WHEN most >= 10 * words.n THEN most END AS form_n
    FROM words LEFT JOIN named ON named.u = words.word
), walk AS (
    SELECT word, word AS at FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, walk.at AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM f JOIN walk ON walk.word = f.word JOIN f AS last ON last.word = walk.at AND last.form IS NULL
""".format(crc=CRC32_SQL.format("s"))

ORACLES = {
    "op13_spelling_variants": OP13_SQL,
    "op12_conversation_trie": OP12_SQL,
    "op9_near_vectors": OP9_SQL,
    "op3_decontaminate": OP3_SQL,
    "op2_substring_dedup": OP2_SQL,
}
