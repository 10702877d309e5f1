"""Ranking metrics: hand-computed values, brute force on random data, degenerate and skewed input."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from surfaudit.operators import metrics as m, prefix as p, regions as rg

PAIR = "positive boolean, s double"


def ap(rows, labels, scores, **kw):
    return m.average_precision(rows(PAIR, list(zip(map(bool, labels), map(float, scores)))), "positive", "s", **kw).first()["ap"]


def test_average_precision_by_hand(rows):
    assert ap(rows, [1, 0, 1, 0], [4, 2, 3, 1]) == 1.0
    assert math.isclose(ap(rows, [1, 0, 1, 0], [1, 3, 2, 4]), 5 / 12)
    assert ap(rows, [1, 0], [1, 1]) == 0.5


def test_average_precision_contracts(rows):
    assert ap(rows, [0, 0], [1, 2]) is None
    assert ap(rows, [1, 1], [1, 2]) == 1.0
    assert ap(rows, [1, 1], [1, 2], both_classes=True) is None


def brute(labels, scores):
    order = sorted(range(len(scores)), key=lambda i: -scores[i])
    total, tp, n, out, i = sum(labels), 0, 0, 0.0, 0
    while i < len(order):
        j = i
        while j < len(order) and scores[order[j]] == scores[order[i]]:
            j += 1
        new = sum(labels[k] for k in order[i:j])
        tp, n, i = tp + new, n + j - i, j
        out += new / total * tp / n
    pos = [s for s, l in zip(scores, labels) if l]
    neg = [s for s, l in zip(scores, labels) if not l]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    return out, auc


@pytest.mark.parametrize("seed", [1, 2])
def test_ap_and_auc_against_brute_force_with_hot_values(rows, seed):
    rng = random.Random(seed)
    # A third of all rows share one score, one group holds most of them.
    data = [("hot" if rng.random() < 0.7 else "cold", rng.random() < 0.4, 0.5 if rng.random() < 0.33 else round(rng.random(), 2))
            for _ in range(600)]
    df = rows("g string, positive boolean, s double", data)
    got = {r["g"]: r for r in m.rank_metrics(m.score_counts(df, "positive", "s", ["g"]), ["g"]).collect()}
    for g in ("hot", "cold"):
        a, u = brute([l for k, l, s in data if k == g], [s for k, l, s in data if k == g])
        assert math.isclose(got[g]["ap"], a) and math.isclose(got[g]["auc"], u)


def test_constant_score_has_auc_one_half(rows):
    r = m.roc_auc(rows(PAIR, [(True, 1.0), (False, 1.0)]), "positive", "s").first()
    assert r["auc"] == 0.5


def test_nan_scores_are_dropped(rows):
    assert ap(rows, [1, 0, 1], [3.0, 1.0, math.nan]) == 1.0


@pytest.mark.parametrize("digits", [1, 2, 3])
def test_prefix_sum_does_not_depend_on_buckets(spark, digits):
    df = spark.range(500).select((F.col("id") * 37 % 499).cast("double").alias("v"), F.lit(1).alias("c"), (F.col("id") % 3).alias("g"))
    one = df.groupBy("g", "v").agg(F.sum("c").alias("c"))
    out = p.prefix_sum(one, "v", ["c"], ["g"], digits=digits).collect()
    for g in range(3):
        part = sorted((r for r in out if r["g"] == g), key=lambda r: r["v"])
        assert [r["cum_c"] for r in part] == list(np.cumsum([r["c"] for r in part]))
        assert {r["total_c"] for r in part} == {sum(r["c"] for r in part)}


def test_quantiles_match_numpy(rows):
    rng = random.Random(4)
    data = [(rng.choice("ab"), rng.choice([1.0, rng.gauss(0, 5)])) for _ in range(400)]
    qs = {"q0": 0, "q3": 0.3, "q5": 0.5, "q9": 0.95, "q1": 1}
    out = {r["g"]: r for r in p.exact_quantiles(rows("g string, v double", data), "v", qs, ["g"]).collect()}
    for g in "ab":
        values = [v for k, v in data if k == g]
        for name, q in qs.items():
            assert math.isclose(out[g][name], np.quantile(values, q), rel_tol=1e-12, abs_tol=1e-12)


def test_quantile_of_nothing(rows):
    assert p.exact_quantiles(rows("v double", [(None,)]), "v", {"q": 0.5}).first()["q"] is None


def test_histogram_percentile(rows):
    df = rows("v int", [(10,)] * 3 + [(20,)])
    r = p.hist_percentile(df, "v", {"p50": 0.5, "p99": 0.99}).first()
    assert (r["p50"], r["p99"]) == (10, 20)


def test_average_ranks(rows):
    got = {r["v"]: r["avg_rank"] for r in p.value_ranks(rows("v double", [(1.0,), (2.0,), (2.0,), (5.0,)]), "v").collect()}
    assert got == {1.0: 1.0, 2.0: 2.5, 5.0: 4.0}


def test_histogram_ap(rows):
    df = rows(PAIR, [(False, 0.0), (False, 1.0), (True, 2.0), (True, 3.0)])
    out = {r["direction"]: r for r in m.histogram_ap(df, "positive", "s", 4).collect()}
    assert out["high"]["ap"] > out["low"]["ap"] and out["high"]["best_f05"] == 1.0


REGIONS = "ord int, score double, positive_px int, valid_px int"


def test_review_enrichment(rows):
    r = m.review_metrics(rows(REGIONS, [(0, 2.0, 50, 100), (1, 1.0, 0, 100)]), "score", 0.5, "ord").first()
    assert (r["reviewed"], r["recall"], r["enrichment"]) == (1, 1.0, 2.0)


def test_review_ties_follow_the_tiebreak(rows):
    df = rows(REGIONS, [(i, 1.0, 10 * (i < 3), 10) for i in range(10)])
    r = m.review_metrics(df, "score", 0.5, "ord").first()
    assert (r["reviewed"], r["recall"], r["precision"]) == (5, 1.0, 0.6)


def test_fraction_counts_use_binary_floating_point(rows):
    df = rows(REGIONS, [(i, float(i), 1, 1) for i in range(100)])
    assert m.review_metrics(df, "score", 0.07, "ord").first()["reviewed"] == 8


def test_correlation_of_a_constant_is_null(rows):
    r = m.correlations(rows("a double, b double", [(1.0, 2.0), (1.0, 3.0)])).first()
    assert r["pearson"] is None and r["spearman"] is None


def test_spearman_with_ties(rows):
    data = [(1.0, 3.0), (2.0, 3.0), (2.0, 8.0), (7.0, 9.0), (9.0, 1.0)]
    r = m.correlations(rows("a double, b double", data)).first()
    rank = lambda v: [sum(x < i for x in v) + (sum(x == i for x in v) + 1) / 2 for i in v]
    assert math.isclose(r["spearman"], np.corrcoef(rank([a for a, _ in data]), rank([b for _, b in data]))[0, 1])


def test_top_overlap_of_identical_maps(rows):
    df = rows("a double, b double", [(float(i), float(i)) for i in range(100)])
    r = m.top_overlap(df, 0.1).first()
    assert r["jaccard"] == 1.0 and math.isclose(r["enrichment"], 10.0)


def test_disagreement_bins_keep_empty_ones(rows):
    df = rows("positive boolean, s0 double, s1 double", [(True, 0.0, 0.0)] * 9 + [(False, 1.0, 0.0)])
    out = sorted(m.disagreement_bins(df, 4).collect(), key=lambda r: r["bin"])
    assert [r["pixels"] for r in out] == [0, 0, 0, 10] and out[0]["prevalence"] is None
    assert m.disagreement_summary(df).first()["ap_low"] > 0.9


def test_single_class_chunks_have_no_gain(rows):
    df = rows("cy int, positive boolean, f double, r double", [(0, True, 1.0, 2.0), (1, True, 2.0, 1.0), (1, False, 1.0, 2.0)])
    out = m.regional_gain(df, ["cy"], "positive", "f", ["r"]).collect()
    assert [r["cy"] for r in out] == [1] and out[0]["gain"] == 0.5


def test_region_summary_and_empty_region(rows):
    df = rows("y int, x int, positive boolean, valid boolean, score double",
              [(0, 0, True, True, 1.0), (0, 1, False, True, 2.0), (1, 0, True, False, 9.0), (0, 2, True, False, 4.0)])
    out = {r["region_id"]: r for r in rg.summarize_regions(df, 2, 0.5, (4, 3)).collect()}
    first = out["y00000_x00000"]
    assert (first["valid_px"], first["positive_px"], first["max"], first["eligible"]) == (2, 1, 2.0, True)
    assert out["y00000_x00002"]["mean"] is None and not out["y00000_x00002"]["eligible"]
    # A region without a stored pixel is there; absent pixels count as invalid.
    assert len(out) == 4 and out["y00002_x00000"]["valid_px"] == 0 and not out["y00002_x00000"]["eligible"]
    sparse = rows("y int, x int, positive boolean, valid boolean, score double", [(0, 0, True, True, 1.0), (0, 1, True, True, 1.0)])
    assert not rg.summarize_regions(sparse, 16, 0.5, (16, 16)).first()["eligible"]


def test_pair_counts_match_enumeration(rows):
    rng = random.Random(8)
    data = [(i % 2, i % 17, rng.randrange(3), rng.randrange(2), rng.randrange(4)) for i in range(60)]
    df = rows("g int, scan int, a int, b int, c int", data)
    for least in (1, 2, 3):
        got = {r["g"]: r["pairs"] for r in rg.pair_counts(df, "g", "scan", ["a", "b", "c"], least).collect()}
        for g in (0, 1):
            own = [d for d in data if d[0] == g]
            want = sum(p[1] != q[1] and sum(u != v for u, v in zip(p[2:], q[2:])) >= least
                       for i, p in enumerate(own) for q in own[i + 1:])
            assert got[g] == want
