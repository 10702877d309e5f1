"""Cross-entropy difference of two byte n-gram models (Moore and Lewis, 2010).

Target and background model have the same order, the same smoothing and one closed vocabulary,
the 256 bytes, so no token is unknown to either.  Counts cover all documents.  A model has a row
per ORDER-gram met, and it stays distributed: documents are dealt into blocks together with the
ids of the target, a block counts its grams, and the losses it needs meet it in its task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from surfaudit.llm.common import BLOCK_BYTES, in_blocks, materialize, slices

ORDER = 4
START = b"\xff" * (ORDER - 1)  # comes before every text; no UTF-8 text holds this byte


def _grams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each byte of the texts, and the number of bytes of each text."""
    size = np.fromiter((len(t or b"") for t in texts), dtype=np.int64, count=len(texts))
    held = np.frombuffer(b"".join(p for t in texts for p in (START, t or b"")), dtype=np.uint8)
    wide = held.astype(np.uint32)
    grams = wide[ORDER - 1 :].copy()
    for back in range(1, ORDER):
        grams |= wide[ORDER - 1 - back : len(wide) - back] << np.uint32(8 * back)
    return grams[held[ORDER - 1 :] != 0xFF], size


def _merged(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of two lists of (distinct gram, count)."""
    unique, where = np.unique(np.concatenate((one[0], two[0])), return_inverse=True)
    return unique, np.bincount(where, weights=np.concatenate((one[1], two[1])), minlength=len(unique)).astype(np.int64)


def _counts(group: pa.Table, ids: pa.Table) -> pa.Table:
    """(block, gram, b, t): grams of a block's texts, in all of them and in those with a target id."""
    texts, doc_ids = group.column("text").cast(pa.binary()).to_pylist(), group.column("doc_id").to_pylist()
    wanted = set(ids.column("_id").to_pylist())
    none = (np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64))
    every, target = none, none
    for part in slices([len(t or b"") for t in texts]):
        grams, size = _grams(texts[part])
        every = _merged(every, np.unique(grams, return_counts=True))
        chosen = np.repeat([i is not None and i in wanted for i in doc_ids[part]], size)
        target = _merged(target, np.unique(grams[chosen], return_counts=True))
    keys, b = every
    t = np.zeros(len(keys), dtype=np.int64)
    t[np.searchsorted(keys, target[0])] = target[1]
    block = np.full(len(keys), group.column("block")[0].as_py() if len(texts) else 0, dtype=np.int64)
    return pa.Table.from_arrays([pa.array(block), pa.array(keys.astype(np.int64)), pa.array(b), pa.array(t)], ["block", "gram", "b", "t"])


def _chance(count: str, seen: Column, kinds: Column, lower: Column) -> Column:
    """Witten-Bell: what was seen after the context, filled up from the shorter context."""
    whole = seen + kinds
    return F.when(whole > 0, (F.col(count) + kinds * lower) / whole).otherwise(lower)


def gram_losses(counts: DataFrame) -> DataFrame:
    """(gram, loss_background, loss_target): negative log probability of a gram's last byte after the others.

    ``counts`` has the occurrences of each gram in the background, ``b``, and in the target, ``t``.
    """
    lower = None
    for order in range(1, ORDER + 1):
        tail = F.col("gram").bitwiseAND(F.lit((1 << (8 * order)) - 1))
        grams = counts.groupBy(tail.alias("gram")).agg(F.sum("b").alias("b"), F.sum("t").alias("t")) if order < ORDER else counts
        grams = grams.withColumn("context", F.shiftright("gram", 8))
        contexts = grams.groupBy("context").agg(
            *[F.sum(c).alias(f"{c}_seen") for c in "bt"], *[F.count_if(F.col(c) > 0).alias(f"{c}_kinds") for c in "bt"]
        )
        joined = grams.join(contexts, "context")
        if lower is None:
            joined = joined.withColumns({"b_low": F.lit(1 / 256), "t_low": F.lit(1 / 256)})
        else:
            shorter = lower.select(F.col("gram").alias("short"), F.col("b_p").alias("b_low"), F.col("t_p").alias("t_low"))
            joined = joined.withColumn("short", F.col("gram").bitwiseAND(F.lit((1 << (8 * (order - 1))) - 1))).join(shorter, "short")
        chances = [_chance(c, F.col(f"{c}_seen"), F.col(f"{c}_kinds"), F.col(f"{c}_low")).alias(f"{c}_p") for c in "bt"]
        lower = joined.select("gram", *chances)
    return materialize(lower.select("gram", (-F.log("b_p")).alias("loss_background"), (-F.log("t_p")).alias("loss_target")))


def score_documents(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, loss_target, loss_background, ce_diff) per row of ``docs``.

    Losses are means per byte in nats; ``ce_diff`` is target minus background, so the smaller the
    closer to the target.  ``target_ids`` has the ids (column ``_id``) of the target's documents;
    the background is all of ``docs``.  A null or empty text has no token and null losses.  Rows
    that share an id lie in one block and are in the target together; a null id is in no target.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    dealt, targets = in_blocks(rows, target_ids, BLOCK_BYTES)
    found = dealt.groupBy("block").cogroup(targets.groupBy("block")).applyInArrow(_counts, "block bigint, gram bigint, b bigint, t bigint")
    met = materialize(found)
    counts = materialize(met.groupBy("gram").agg(F.sum("b").alias("b"), F.sum("t").alias("t")))
    losses = gram_losses(counts)

    def scored(group: pa.Table, model: pa.Table) -> pa.Table:
        key = model.column("gram").to_numpy()
        order = np.argsort(key)
        key = key[order].astype(np.uint32)
        loss = [model.column(c).to_numpy()[order] for c in ("loss_target", "loss_background")]
        texts = group.column("text").cast(pa.binary()).to_pylist()
        sizes, sums = [], ([], [])
        for part in slices([len(t or b"") for t in texts]):
            grams, size = _grams(texts[part])
            at = np.searchsorted(key, grams)
            ends = np.cumsum(size)
            sizes.append(size)
            for held, values in zip(sums, loss):
                run = np.concatenate(([0.0], np.cumsum(values[at]))) if len(at) else np.zeros(1)
                held.append(run[ends] - run[ends - size])
        n = np.concatenate(sizes) if sizes else np.zeros(0, dtype=np.int64)
        none = n == 0
        means = [pa.array(np.concatenate(s) / np.maximum(n, 1) if sizes else np.zeros(0), mask=none) for s in sums]
        return pa.Table.from_arrays([group.column("doc_id"), pa.array(n), *means], ["doc_id", "n_tokens", "loss_target", "loss_background"])

    models = met.select("block", "gram").join(losses, "gram").select("block", "gram", "loss_target", "loss_background")
    out = dealt.groupBy("block").cogroup(models.groupBy("block")).applyInArrow(
        scored, "doc_id bigint, n_tokens bigint, loss_target double, loss_background double"
    )
    return out.withColumn("ce_diff", F.col("loss_target") - F.col("loss_background"))
