"""The toxicity network: gradients, scores window by window, held-out accuracy, odd rows."""

import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from surfaudit.llm import toxicity
from surfaudit.llm.common import Words, table
from surfaudit.llm.toxicity import APART, STRIDE, WIDTH, Network, features, learn_toxicity, score_toxicity, windows
from tests.llm.test_operators import SF


def test_gradient_equals_differences():
    net = Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = Words([b"ab cd ef gh ab", b"xy zz", b"q " * 60], APART)
    f, which = features(words)
    _, start, size = windows(words.first)
    at = which[np.minimum(start[:, None] + np.arange(WIDTH), len(which) - 1)]
    label, share = np.arange(len(at)) % 2, np.full(len(at), 0.5)

    def loss():
        logit = net.forward(net.inputs(f), at, size)
        return float((share * (np.logaddexp(0, logit) - label * logit)).sum())

    grads = net.gradient(f, at, size, label, share)
    places = {"word": (f.word[0], 2), "char": (f.grams[1], 1), "attend": (3,), "out": (1,), "bias": (0,)}
    for way in "fb":
        places |= {f"in_{way}": (2, 5), f"add_{way}": (4,), f"gate_{way}": (1, 2), f"new_{way}": (0, 3)}
    for name, place in places.items():
        held, ends = net.p[name][place], []
        for step in (2e-3, -2e-3):  # states are single precision
            net.p[name][place] = held + step
            ends.append(loss())
        net.p[name][place] = held
        assert np.isclose((ends[0] - ends[1]) / 4e-3, grads[name][place], rtol=2e-2, atol=2e-6), name


def slow_score(net, text):
    """One window after the other, one word after the other."""
    words = re.findall(rb"[0-9a-z\x80-\xff]+", text.lower())
    if not words:
        return 0.0
    starts = [0] if len(words) <= WIDTH else [*range(0, len(words) - WIDTH, STRIDE), len(words) - WIDTH]
    logits = []
    for s in starts:
        states = {}
        window = words[s : s + WIDTH]
        x = []
        for w in window:
            f, _ = features(Words([w], APART))
            x.append(np.concatenate((net.p["word"][f.word[0]], net.p["char"][f.grams].mean(axis=0))))
        for way in "fb":
            h, own = np.zeros(toxicity.HIDDEN), []
            for v in x if way == "f" else x[::-1]:
                given = v @ net.p[f"in_{way}"] + net.p[f"add_{way}"]
                gate = 1 / (1 + np.exp(-(given[: 2 * toxicity.HIDDEN] + h @ net.p[f"gate_{way}"])))
                z, r = gate[: toxicity.HIDDEN], gate[toxicity.HIDDEN :]
                h = (1 - z) * np.tanh(given[2 * toxicity.HIDDEN :] + r * (h @ net.p[f"new_{way}"])) + z * h
                own.append(h)
            states[way] = own if way == "f" else own[::-1]
        both = np.concatenate((states["f"], states["b"]), axis=1)
        weight = np.exp(both @ net.p["attend"])
        logits.append((weight / weight.sum()) @ both @ net.p["out"] + net.p["bias"][0])
    return float(1 / (1 + np.exp(-(net.scale * max(logits) + net.shift))))


def test_scores_equal_brute_force(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    net = learn_toxicity(docs, labels)
    rows = {r.doc_id: r for r in score_toxicity(docs, labels).collect()}
    assert len(rows) == docs.count()
    for r in docs.orderBy(F.char_length("text")).limit(60).collect():
        assert np.isclose(rows[r.doc_id].score, slow_score(net, r.text.encode()), atol=1e-4)
    for r in rows.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    found = score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels")).where("held_out")
    rates = {r.toxic: r.rate for r in found.join(table(spark, folder, "labels"), "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("rate")).collect()}
    assert rates[1] > 0.6 and rates[0] < 0.03


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 23)] + [(None, 1), (5, None), (5, 0)], "doc_id bigint, toxic int")
    long = odd_docs.unionByName(odd_docs.limit(1).withColumns({"doc_id": F.lit(99).cast("bigint"), "text": F.repeat(F.lit("wörd x1 "), 60_000)}))
    rows = score_toxicity(long.withColumns({"size": F.lit("x"), "score": F.lit(1)}), labels).collect()
    assert len(rows) == long.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.score == 0 for r in rows if r.doc_id in (2, 3))
    assert score_toxicity(no_docs, labels).count() == 0
    assert {r.score for r in score_toxicity(odd_docs, labels.where("toxic = 1")).collect()} == {0.5}
