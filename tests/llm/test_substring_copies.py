"""Substring dedup where rows share an id, or are one row many times."""

import random

import pytest
from pyspark.sql import functions as F

from surfaudit.llm import substring
from surfaudit.llm.substring import dedup_substrings


def words(draw, n):
    return " ".join(f"w{draw.randrange(10**6)}" for _ in range(n))


def test_many_rows_of_one_id(spark):
    """Texts that occur once keep all their words, however many rows share the id or have none."""
    draw = random.Random(1)
    texts = [words(draw, 24) for _ in range(5_000)]
    rows = [(7, t) for t in texts] + [(None, words(draw, 22)) for _ in range(5_000)] + [(9, texts[0] + " and more")]
    found = dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert found.where("doc_id IS NULL OR doc_id = 7").agg(F.sum("n_removed")).first()[0] == 0
    assert [(r.n_words, r.n_removed, r.kept) for r in found.where("doc_id = 9").collect()] == [(26, 24, "and more")]


def test_one_row_many_times(spark):
    draw = random.Random(2)
    text = words(draw, 60)
    many = spark.range(100_000).select(F.lit(3).cast("bigint").alias("doc_id"), F.lit(text).alias("text"))
    rows = many.unionByName(spark.createDataFrame([(1, "x " + text + " y"), (5, text)], "doc_id bigint, text string"))
    found = dedup_substrings(rows).groupBy("doc_id", "n_words", "n_removed", "kept").count().collect()
    assert sorted(tuple(r) for r in found) == [(1, 62, 0, "x " + text + " y", 1), (3, 60, 60, "", 100_000), (5, 60, 60, "", 1)]


def test_words_are_compared_at_the_source():
    """Equal hashes with other words at the source remove nothing."""
    import numpy as np
    import pyarrow as pa

    from surfaudit.llm.common import Words

    held = Words([b" ".join(b"%d" % i for i in range(30)), b"a b"])
    digest = substring._digests(held, np.array([2]), np.array([20]))
    at = (2 << substring.PATH_BITS) | 0
    for offset, gone in ((0, 20), (1, 0)):
        runs = pa.array([[{"at": at, "digest": int(digest[0]) + offset}], None], pa.list_(pa.struct([("at", pa.int64()), ("digest", pa.int64())])))
        assert substring._gone(held, runs, 20).sum() == gone
    runs = pa.array([[{"at": at, "digest": None}], None], pa.list_(pa.struct([("at", pa.int64()), ("digest", pa.int64())])))
    assert substring._gone(held, runs, 20).sum() == 20


@pytest.mark.parametrize("size", [1 << 20, 64])
def test_slices_do_not_show(spark, monkeypatch, size):
    monkeypatch.setattr(substring, "SLICE", size)
    draw = random.Random(4)
    shared = words(draw, 45)
    rows = [(i, f"{words(draw, i % 30)} {shared if i % 3 == 0 else ''} {words(draw, 7)}") for i in range(90)]
    found = dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.n_removed for r in found} == {i: 45 if i % 3 == 0 and i else 0 for i in range(90)}
