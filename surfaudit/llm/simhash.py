"""SimHash near-duplicates: fingerprints, pigeonhole blocks, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from surfaudit.llm.common import NO_ID, text_bytes
from surfaudit.operators.components import connected_components
from surfaudit.session import cut_lineage

BITS = 64
SHINGLE = 3
SEED = 42
MAX_BITS = 2
BLOCKS = 5  # any MAX_BITS differing bits leave BLOCKS - MAX_BITS whole blocks equal
PAIRED = 64  # fingerprints of a bucket up to which its pairs are compared one by one
AT_ONCE = 1 << 16  # shingles whose bits are counted at once


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Majority bits over the hashes of all word shingles, repeats included; no word: zero."""
    words = text.lower().split() if text else []  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        end = np.cumsum(size + 1) - 1
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip((end - size).tolist(), end[shingle - 1 :].tolist())]
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), AT_ONCE):
        part = np.array(hashes[i : i + AT_ONCE], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int.from_bytes(bits.tobytes(), "little", signed=True)


def simhash_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, fp): one row per document; a null text counts as one without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([fingerprint(t) for t in text_bytes(batch)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), prints], ["doc_id", "mark", "fp"])

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, mark bigint, fp bigint")


def _block_masks(max_bits: int) -> list[int]:
    """One mask per choice of blocks that may be the equal ones, as signed 64-bit integers."""
    edges = [BITS * i // BLOCKS for i in range(BLOCKS + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [sum(block[i] for i in pick) for pick in combinations(range(BLOCKS), BLOCKS - max_bits)]
    return [_signed(m) for m in masks]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint_links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (src, dst) that connect distinct fingerprints with at most ``max_bits`` differing bits.

    Close pairs share BLOCKS - max_bits blocks, so they meet in a bucket of one of the block
    tables.  Pairs of small buckets are compared there.  In a larger bucket each fingerprint is
    put to all points one bit off in the blocks that are not shared: two of them are at most two
    bits apart exactly if they share a point, so each point, which few fingerprints can hold,
    links its own to the smallest.  That takes a fixed number of rows per fingerprint whatever
    the size of the bucket, and gives the same components.
    """
    if max_bits != 2:
        raise ValueError("buckets are opened by single bit flips, which serves two bits")
    masks = _block_masks(max_bits)
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(m).alias("mask")) for i, m in enumerate(masks)])
    keyed = prints.select("fp", F.explode(tables).alias("b")).select(
        "fp", F.col("b.t").alias("t"), F.col("fp").bitwiseAND(F.col("b.mask")).alias("key")
    )
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut_lineage(keyed.join(sizes, ["t", "key"]))

    small = shared.where(F.col("n") <= PAIRED)
    pairs = small.select("t", "key", F.col("fp").alias("src")).join(
        small.select("t", "key", F.col("fp").alias("dst")), ["t", "key"]
    ).where((F.col("src") < F.col("dst")) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= max_bits))

    flips = F.array(*[
        F.array(F.lit(0).cast("bigint"), *[F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1]) for m in masks
    ])
    points = shared.where(F.col("n") > PAIRED).select("t", "key", "fp", F.explode(F.get(flips, F.col("t"))).alias("flip"))
    points = points.withColumn("point", F.col("fp").bitwiseXOR(F.col("flip")))
    around = points.groupBy("t", "key", "point").agg(F.collect_list("fp").alias("near")).where(F.size("near") > 1)
    stars = around.select(F.explode("near").alias("src"), F.array_min("near").alias("dst")).where("src <> dst")
    return pairs.select("src", "dst").unionAll(stars).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, fp, component_id, node) per row of ``docs``.

    Rows with equal fingerprints are one node, whatever their number.  ``component_id`` is the
    smallest doc_id reachable, ``node`` names the component by a fingerprint and ``mark`` is a
    hash of the text.  Null and empty texts have fingerprint zero and link like any other; rows
    that repeat a doc_id are rows of their own; a null doc_id is never the smallest, and a
    component of such rows alone has a null component_id.
    """
    prints = cut_lineage(simhash_fingerprints(docs, id_col, text_col))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    edges = fingerprint_links(classes.select("fp"))
    merged = cut_lineage(connected_components(edges)).withColumnRenamed("node", "fp")
    named = classes.join(merged, "fp", "left").withColumn("node", F.coalesce("component", "fp"))
    smallest = named.groupBy("node").agg(F.min("first").alias("component_id"))
    by_print = named.join(smallest, "node").select("fp", "node", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "mark", "fp", "component_id", "node")


def keep_first(docs: DataFrame, components: DataFrame) -> DataFrame:
    """One row of each component, with all columns: the one with the smallest doc_id.

    ``components`` has (doc_id, mark, node) for each row of ``docs``.  A row without doc_id stays
    only if its component has none with one.  Rows that share the doc_id are told apart by their
    texts, and of equal rows one stays.
    """
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "mark")
    keep = components.groupBy("node").agg(F.min(order).alias("k"))
    keep = keep.select(F.coalesce("k.doc_id", F.lit(NO_ID)).alias("_id"), F.col("k.mark").alias("_mark")).distinct()
    # The row travels in a struct, so that no column of it can meet one of these names.
    marked = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("_id"), F.xxhash64("text").alias("_mark"))
    # The join leaves rows dealt and sorted by these keys, so the window adds no shuffle.
    same = W.partitionBy("_id", "_mark").orderBy("_id", "_mark")
    kept = marked.join(keep, ["_id", "_mark"], "left_semi").withColumn("_row", F.row_number().over(same))
    return kept.where("_row = 1").select("row.*")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each component of close fingerprints."""
    return keep_first(docs, simhash_components(docs))
