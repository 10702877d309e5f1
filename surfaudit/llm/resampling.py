"""Importance resampling: documents are drawn towards a target by hashed n-gram models.

Both models are bags of hashed word unigrams and bigrams (the method of Xie et al., 2023).  A
document's log weight is the sum over its n-grams of log p(target) - log p(raw), and adding
Gumbel noise to it and keeping the largest keys draws without replacement in proportion to the
weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from surfaudit.llm.common import BLOCK_BYTES, WordHashes, in_blocks, materialize, mix

BUCKETS = 10_000
SEED = 11
DIGIT = 16  # bits of the key by which the boundary of the sample is found at a time
TOKENS = re.compile(r"\w+|[^\w\s]+")


def _features(text: str | None, memo: WordHashes) -> np.ndarray:
    """Bucket of each unigram and bigram of a text."""
    tokens = memo.of([t.encode() for t in TOKENS.findall(text.lower())] if text else [])
    pairs = mix(tokens[:-1] * np.uint64(0x9E3779B97F4A7C15) + tokens[1:])
    return (np.concatenate((mix(tokens), pairs)) % np.uint64(BUCKETS)).astype(np.int64)


def _counts(group: pa.Table, ids: pa.Table) -> pa.Table:
    """(bucket, raw, target): occurrences in a block's texts, in all of them and in those with a target id."""
    memo, wanted = WordHashes(), set(ids.column("_id").to_pylist())
    raw, target = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
    for text, doc in zip(group.column("text").to_pylist(), group.column("doc_id").to_pylist()):
        own = np.bincount(_features(text, memo), minlength=BUCKETS)
        raw += own
        if doc is not None and doc in wanted:
            target += own
    some = np.flatnonzero(raw)
    return pa.Table.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])


def bucket_counts(rows: DataFrame, target_ids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of every bucket in the target and in all texts: BUCKETS numbers each, whatever the input."""
    dealt, targets = in_blocks(rows, target_ids, BLOCK_BYTES)
    found = dealt.groupBy("block").cogroup(targets.groupBy("block")).applyInArrow(_counts, "bucket bigint, raw bigint, target bigint")
    target, raw = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
    for r in found.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        target[r["bucket"]], raw[r["bucket"]] = r["target"], r["raw"]
    return target, raw


def clean_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids of documents labelled good and not toxic; of contradicting labels the worse holds."""
    worst = labels.groupBy(F.col(id_col).cast("bigint").alias("_id")).agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return worst.where("quality = 1 AND toxic = 0 AND _id IS NOT NULL").select("_id")


def log_weights(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, log_weight) per row; null where a text has no n-gram.  ``mark`` is a hash of the text."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    smooth = [np.log((c + 1) / (c.sum() + BUCKETS)) for c in bucket_counts(rows, target_ids)]
    ratio = smooth[0] - smooth[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            found = (_features(t, memo) for t in batch.column("text").to_pylist())
            weights = pa.array([float(ratio[f].sum()) if len(f) else None for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), weights], ["doc_id", "mark", "log_weight"])

    return rows.mapInArrow(run, "doc_id bigint, mark bigint, log_weight double")


def kth_largest(df: DataFrame, key: str, k: int) -> int | None:
    """Exact k-th largest value of a bigint column, digit by digit: at most 65,536 counts per round."""
    prefix, above = None, 0
    for shift in range(64 - DIGIT, -1, -DIGIT):
        rows = df.where(F.col(key).isNotNull())
        if prefix is not None:
            rows = rows.where(F.shiftright(key, shift + DIGIT) == prefix)
        digit = F.shiftright(key, shift) if prefix is None else F.shiftright(key, shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
        counts = rows.groupBy(digit.alias("d")).count().collect()
        last = None
        for r in sorted(counts, key=lambda r: -r["d"]):
            last = r["d"]
            if above + r["count"] >= k:
                break
            above += r["count"]
        if last is None:
            return None
        prefix = last if prefix is None else prefix << DIGIT | last
    return prefix


def resample(
    docs: DataFrame, target_ids: DataFrame, fraction: float, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, log_weight, sample_key, selected) per row of ``docs``.

    ``fraction`` of the documents that have an n-gram are selected: those with the largest
    ``sample_key``, the log weight plus Gumbel noise drawn by a hash of seed, id and text.  Equal
    rows have equal keys and are selected together.  A null or empty text has no weight and is
    never selected; without target texts all weights follow the raw model alone.
    """
    weighed = log_weights(docs, target_ids, id_col, text_col)
    uniform = (F.pmod(F.xxhash64("doc_id", "mark", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = weighed.withColumn("sample_key", F.col("log_weight") - F.log(-F.log(uniform)))
    # The key to a millionth as an integer, so that its digits can be counted.
    keyed = materialize(keyed.withColumn("rank_key", F.floor(F.col("sample_key") * 1e6).cast("bigint")))
    k = round(fraction * keyed.where("rank_key IS NOT NULL").count())
    bound = kth_largest(keyed, "rank_key", k) if k > 0 else None
    selected = F.coalesce(F.col("rank_key") >= bound, F.lit(False)) if bound is not None else F.lit(False)
    return keyed.select("doc_id", "log_weight", "sample_key", selected.alias("selected"))


def target_share(labels: DataFrame) -> float:
    """Share of labelled documents that are labelled good; one half without labels."""
    return labels.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0] or 0.5
