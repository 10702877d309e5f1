"""Toxicity by a bidirectional gated recurrent network with attention pooling, in NumPy.

A word enters as two vectors: one for the whole word and the mean of those of its character
n-grams, both by hash.  Windows of WIDTH words, each overlapping the next, run through a gated
recurrent layer in either direction; attention pools its states and a logistic unit scores the
window.  A document is as toxic as its worst window.  Word inputs are projected once per distinct
word of a slice of text, so a window costs its recurrence only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from surfaudit.llm.common import Words, slices, text_bytes
from surfaudit.llm.language import held_out

WIDTH, STRIDE = 40, 30  # words of a window, and from one window to the next
HIDDEN = 8  # of each direction
WORD_DIMS, CHAR_DIMS = 8, 8
WORD_ROWS, CHAR_ROWS = 1 << 15, 1 << 14
GRAMS = (3, 4, 5)  # bytes of a character n-gram, word edges included
TOXIC = 0.7  # score from which a document is called toxic
# The bounds of the labelled sample: documents of each kind, and characters of each.
SAMPLE = {1: 2048, 0: 4096}
SAMPLE_CHARS = 4096
EPOCHS, BATCH, RATE = 6, 128, 0.01
PER_DOC = 4  # windows of a document in an epoch
SLICE = 1 << 20
# Bytes of words: digits, a-z (texts are lower-cased) and all beyond ASCII.
APART = np.ones(256, dtype=bool)
APART[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
EDGE = 0x5F


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


@dataclass
class Features:
    """Distinct words of some texts: word row, and rows of their n-grams one after another."""

    word: np.ndarray
    grams: np.ndarray
    count: np.ndarray  # of n-grams, 1 at least

    def of(self, some: np.ndarray) -> Features:
        begin = np.cumsum(self.count) - self.count
        count = self.count[some]
        at = np.repeat(begin[some], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return Features(self.word[some], self.grams[at], count)


def features(words: Words) -> tuple[Features, np.ndarray]:
    """Features of the distinct words, and the number of its distinct word for each word."""
    hashes = words.hashes()
    known, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    size = words.end[first] - words.start[first]
    # _word_ for each distinct word, in one buffer.
    total = size + 2
    begin = np.cumsum(total) - total
    buffer = np.full(int(total.sum()), EDGE, dtype=np.uint64)
    inner = np.repeat(begin + 1, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    buffer[inner] = words.bytes[np.repeat(words.start[first], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
    owner = np.repeat(np.arange(len(known)), total)
    rows, owners = [], []
    for n in GRAMS:
        if len(buffer) < n:
            continue
        value = np.full(len(buffer) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            value = value * np.uint64(0x100000001B3) ^ buffer[k : len(buffer) - n + 1 + k]
        value = (value ^ (value >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        inside = np.flatnonzero(owner[: len(value)] == owner[n - 1 :])
        rows.append((value[inside] >> np.uint64(40)).astype(np.int64) % CHAR_ROWS)
        owners.append(owner[inside])
    if not rows:
        return Features(*(np.zeros(0, dtype=np.int64) for _ in range(3))), which
    rows, owners = np.concatenate(rows), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")  # three bytes and more each, so every word has an n-gram
    return Features((known % np.uint64(WORD_ROWS)).astype(np.int64), rows[order], np.bincount(owners, minlength=len(known))), which


def windows(first: np.ndarray, width: int = WIDTH, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, words) of all windows; the last of a text ends with it, a shorter text is one window."""
    count = np.diff(first)
    n = np.where(count > width, 1 + -(-(count - width) // stride), count > 0)
    text = np.repeat(np.arange(len(count)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.minimum(step * stride, np.maximum(count[text] - width, 0))
    return text, first[text] + start, np.minimum(count[text], width)


class Network:
    """Parameters, scores, and gradients by backpropagation through time."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        near = lambda *shape: (draw.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {
            "word": (0.1 * draw.standard_normal((WORD_ROWS, WORD_DIMS))).astype(np.float32),
            "char": (0.1 * draw.standard_normal((CHAR_ROWS, CHAR_DIMS))).astype(np.float32),
            "attend": near(2 * HIDDEN), "out": near(2 * HIDDEN), "bias": np.zeros(1, dtype=np.float32),
        }
        for way in "fb":
            self.p[f"in_{way}"], self.p[f"add_{way}"] = near(WORD_DIMS + CHAR_DIMS, 3 * HIDDEN), np.zeros(3 * HIDDEN, dtype=np.float32)
            self.p[f"gate_{way}"], self.p[f"new_{way}"] = near(HIDDEN, 2 * HIDDEN), near(HIDDEN, HIDDEN)
        self.scale, self.shift = 1.0, 0.0  # of a document's worst logit

    def inputs(self, f: Features) -> np.ndarray:
        if not len(f.word):
            return np.zeros((0, WORD_DIMS + CHAR_DIMS), dtype=np.float32)
        chars = np.add.reduceat(self.p["char"][f.grams], np.cumsum(f.count) - f.count, axis=0) / f.count[:, None].astype(np.float32)
        return np.concatenate((self.p["word"][f.word], chars), axis=1)

    def forward(self, x: np.ndarray, at: np.ndarray, size: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits of windows: ``at`` (window, step) names rows of ``x``, ``size`` the words of each window.

        ``keep`` takes what the gradient needs.
        """
        n, steps = at.shape
        h2, p = 2 * HIDDEN, self.p
        states = np.zeros((steps, n, h2), dtype=np.float32)
        short = bool((size < steps).any())
        for d, way in enumerate("fb"):
            given = x @ p[f"in_{way}"] + p[f"add_{way}"]
            h = np.zeros((n, HIDDEN), dtype=np.float32)
            for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
                now = given[at[:, t]]
                gate = _sigmoid(now[:, :h2] + h @ p[f"gate_{way}"])
                z, r = gate[:, :HIDDEN], gate[:, HIDDEN:]
                turned = h @ p[f"new_{way}"]
                new = np.tanh(now[:, h2:] + r * turned)
                after = new + z * (h - new)
                if short:
                    after = np.where((t < size)[:, None], after, h)
                if keep is not None:
                    keep.append((way, t, h, z, r, turned, new))
                h = after
                states[t, :, d * HIDDEN : (d + 1) * HIDDEN] = h
        weight = states @ p["attend"]
        if short:
            weight = np.where(np.arange(steps)[:, None] < size, weight, np.float32(-1e9))
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        if keep is not None:
            keep.append((states, weight, pooled))
        return pooled @ p["out"] + p["bias"]

    def gradient(self, f: Features, at: np.ndarray, size: np.ndarray, label: np.ndarray, share: np.ndarray) -> dict[str, np.ndarray]:
        """Of the logistic loss of windows, each with its ``share``."""
        p, keep = self.p, []
        x = self.inputs(f)
        logit = self.forward(x, at, size, keep)
        states, weight, pooled = keep.pop()
        (n, steps), h2 = at.shape, 2 * HIDDEN
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "char")}
        loss = ((_sigmoid(logit) - label) * share).astype(np.float32)
        g["out"], g["bias"] = pooled.T @ loss, loss.sum(keepdims=True)
        to_pooled = loss[:, None] * p["out"]
        to_weight = np.einsum("tnh,nh->tn", states, to_pooled)
        to_score = weight * (to_weight - (weight * to_weight).sum(axis=0))
        g["attend"] = np.einsum("tn,tnh->h", to_score, states)
        to_states = weight[:, :, None] * to_pooled + to_score[:, :, None] * p["attend"]
        to_x = np.zeros_like(x)
        by = np.argsort(at.T.ravel(), kind="stable")  # every row of x occurs
        head = np.searchsorted(at.T.ravel()[by], np.arange(len(x)))
        for d, way in enumerate("fb"):
            back, steps_in = np.zeros((n, HIDDEN), dtype=np.float32), np.zeros((steps, n, 3 * HIDDEN), dtype=np.float32)
            for way_t, t, h, z, r, turned, new in reversed([k for k in keep if k[0] == way]):
                on = (t < size)[:, None]
                dh = back + to_states[t, :, d * HIDDEN : (d + 1) * HIDDEN]
                live = np.where(on, dh, 0)
                dnew = live * (1 - z) * (1 - new * new)
                dz, dr = live * (h - new) * z * (1 - z), dnew * turned * r * (1 - r)
                dgate, dturned = np.concatenate((dz, dr), axis=1), dnew * r
                g[f"gate_{way}"] += h.T @ dgate
                g[f"new_{way}"] += h.T @ dturned
                back = np.where(on, live * z + dgate @ p[f"gate_{way}"].T + dturned @ p[f"new_{way}"].T, dh)
                steps_in[t, :, :h2], steps_in[t, :, h2:] = dgate, dnew
            given = np.add.reduceat(steps_in.reshape(-1, 3 * HIDDEN)[by], head, axis=0)
            g[f"add_{way}"] = given.sum(axis=0)
            g[f"in_{way}"] = x.T @ given
            to_x += given @ p[f"in_{way}"].T
        shared = np.repeat(to_x[:, WORD_DIMS:] / f.count[:, None].astype(np.float32), f.count, axis=0)
        for name, rows, values in (("word", f.word, to_x[:, :WORD_DIMS]), ("char", f.grams, shared)):
            g[name] = np.column_stack([np.bincount(rows, v, minlength=len(p[name])) for v in values.T]).astype(np.float32)
        return g

    def logits(self, f: Features, which: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Logits of all windows; whole ones and short ones apart, the latter with padding."""
        x, out = self.inputs(f), np.zeros(len(start), dtype=np.float32)
        for some in (np.flatnonzero(size == WIDTH), np.flatnonzero(size < WIDTH)):
            for i in range(0, len(some), 4 * BATCH):
                k = some[i : i + 4 * BATCH]
                out[k] = self.forward(x, which[np.minimum(start[k, None] + np.arange(WIDTH), len(which) - 1)], size[k])
        return out

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """Score of each text: its worst window, on the scale of the labels; 0 without words."""
        words = Words([t.lower() if t else t for t in texts], APART)
        out = np.zeros(len(texts))
        if not len(words):
            return out
        text, start, size = windows(words.first)
        logit = self.logits(*features(words), start, size)
        head = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        worst = np.maximum.reduceat(logit, head).astype(np.float64)
        out[text[head]] = 1 / (1 + np.exp(-np.clip(self.scale * worst + self.shift, -60, 60)))
        return out


def _fit_scale(worst: np.ndarray, label: np.ndarray, share: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one number, by Newton steps with a little ridge."""
    design, beta = np.column_stack((worst, np.ones(len(worst)))), np.zeros(2)
    for _ in range(30):
        guess = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (share * (label - guess)) - 1e-2 * beta
        curve = (design * (share * guess * (1 - guess))[:, None]).T @ design + 1e-2 * np.eye(2)
        beta = beta + np.linalg.solve(curve, slope)
    return float(max(beta[0], 1e-3)), float(beta[1])


def train(texts: list[bytes], labels: list[int], share_toxic: float, seed: int = 7) -> Network:
    """A network from labelled texts; every fifth sets the scale only.

    At first every window has the label of its document; from the second round on the windows of a
    toxic document that score highest, and of a clean one the highest and some others.
    """
    draw, net = np.random.default_rng(seed), Network(seed)
    words = Words([t.lower() for t in texts], APART)
    found, which = features(words)
    text, start, size = windows(words.first)
    label = np.array(labels, dtype=np.float32)
    rate = {k: np.zeros_like(v) for k, v in net.p.items()}
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    learns = np.arange(len(texts)) % 5 != 0
    if not 0 < label[learns].sum() < learns.sum():
        return net
    logit, steps = None, 0
    for epoch in range(EPOCHS):
        order = draw.random(len(text))
        if logit is not None:
            rank = np.empty(len(text), dtype=np.int64)
            by = np.lexsort((-logit, text))
            rank[by] = np.arange(len(by)) - np.searchsorted(text[by], text[by])
            order = np.where((rank < PER_DOC // 2) | ((label[text] > 0) & (logit > 0)), order - 1, order)
        by = np.lexsort((order, text))
        place = np.arange(len(by)) - np.searchsorted(text[by], text[by])
        most = np.where((label[text[by]] > 0) & (logit is not None), PER_DOC // 2, PER_DOC)
        chosen = by[(place < most) & learns[text[by]]]
        chosen = draw.permutation(chosen)
        toxic = label[text[chosen]].sum()
        if not 0 < toxic < len(chosen):  # no window of one of the kinds
            break
        even = np.where(label > 0, len(chosen) / 2 / toxic, len(chosen) / 2 / (len(chosen) - toxic)).astype(np.float32)
        for i in range(0, len(chosen), BATCH):
            k = chosen[i : i + BATCH]
            at = which[np.minimum(start[k, None] + np.arange(WIDTH), len(which) - 1)]
            some, at = np.unique(at, return_inverse=True)
            grads = net.gradient(found.of(some), at.reshape(len(k), WIDTH), size[k], label[text[k]], even[text[k]] / len(k))
            steps += 1
            for name, grad in grads.items():
                mean[name] += 0.1 * (grad - mean[name])
                rate[name] += 0.001 * (grad * grad - rate[name])
                step = RATE * np.sqrt(1 - 0.999**steps) / (1 - 0.9**steps) * (1 - epoch / EPOCHS)
                net.p[name] -= (step * mean[name] / (np.sqrt(rate[name]) + 1e-8)).astype(np.float32)
        logit = net.logits(found, which, start, size)
    if logit is not None:
        head = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        worst, own = np.maximum.reduceat(logit, head).astype(np.float64), text[head]
        test = ~learns[own]
        if 0 < label[own[test]].sum() < test.sum():
            worst, own = worst[test], own[test]
        toxic = max(float(label[own].mean()), 1e-6)
        share = np.where(label[own] > 0, share_toxic / toxic, (1 - share_toxic) / max(1 - toxic, 1e-6))
        net.scale, net.shift = _fit_scale(worst, label[own], share)
    return net


def learn_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network | None:
    """A network from a sample of labelled documents drawn by hash; None without labels of both kinds.

    Rows held out, and rows without text or label, teach nothing; a document with several labels
    has the highest.  At most SAMPLE documents of each kind come to the driver, with SAMPLE_CHARS
    of each from a place its hash chooses.
    """
    kinds = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    kinds = kinds.groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    counts = {r["label"]: r["n"] for r in kinds.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(1) or not counts.get(0):
        return None
    drawn = []
    for label, most in SAMPLE.items():
        drawn += kinds.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(most).collect()  # bounded by SAMPLE
    some = docs.sparkSession.createDataFrame([(r["id"], r["label"]) for r in drawn], "id bigint, label int")
    text = F.col(text_col)
    begin = (F.lit(1) + F.pmod(F.xxhash64(text), F.greatest(F.char_length(text) - SAMPLE_CHARS, F.lit(0)) + 1)).cast("int")
    pieces = docs.where(text.isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.substring(text, begin, F.lit(SAMPLE_CHARS)).alias("piece"))
    rows = pieces.join(some, "id").orderBy(F.xxhash64("id"), F.xxhash64("piece")).limit(sum(SAMPLE.values())).collect()
    if len({r["label"] for r in rows}) < 2:
        return None
    return train([r["piece"].encode() for r in rows], [r["label"] for r in rows], counts[1] / (counts[0] + counts[1]))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``, learned from labelled rows not held out.

    Every window of every text is scored, whatever its length; the worst one counts.  Texts that
    are null, empty or without a word score 0, and without labels of both kinds every text scores
    0.5.  Rows that repeat a doc_id are scored one by one; other columns are not read.
    """
    net = learn_toxicity(docs, labels, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([n or 0 for n in batch.column("size").to_pylist()], SLICE):
                rows = batch.slice(part.start, part.stop - part.start)
                scores = np.full(len(rows), 0.5) if net is None else net.scores(list(text_bytes(rows)))
                columns = [rows.column("doc_id"), rows.column("held_out"), pa.array(scores), pa.array((scores >= TOXIC).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.octet_length(text).alias("size"), text.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
