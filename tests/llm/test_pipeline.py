"""The pipeline against a brute-force run of its stages, and the queries' shapes."""

import base64

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from surfaudit.llm.bpe import RANKS
from surfaudit.llm.common import table
from surfaudit.llm.language import Packer, held_out, learn_dictionaries
from surfaudit.llm.queries import ORACLES, QUERIES
from tests.llm.test_near_copies import brute_kept
from tests.llm.test_operators import SF, brute_contamination, brute_substrings


def brute_pipeline(spark, sf):
    docs = table(spark, sf, "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    packer = Packer(learn_dictionaries(docs.where(~held_out())))  # the sample is drawn by Spark, the judging is not
    rows = [(i, t) for i, t in rows if packer.judge(t)[3]]
    first = brute_kept(rows)
    rows = [(i, t) for i, t in rows if i in first]
    cut = brute_substrings(rows)
    rows = [(i, kept if gone else t) for (i, t), (n, gone, kept) in zip(rows, cut) if gone < n or not n]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    bad = {r[0] for r in brute_contamination(rows, items) if r[4]}
    with open(public_tokenizers.path(RANKS), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return {i: encoding.encode_ordinary(t) for i, t in rows if i not in bad}


def test_pipeline_equals_brute_force(spark):
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == brute_pipeline(spark, SF)
    assert 0 < len(got) < table(spark, SF, "documents").count()


def test_stages_keep_the_columns(spark):
    docs = table(spark, SF, "documents").withColumn("row", F.lit("x")).withColumn("kept", F.lit(1)).limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "byte_bpe",
    ]


def test_stages_take_empty_and_odd_documents(spark, odd_docs):
    for docs in (odd_docs, odd_docs.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= docs.count()


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
