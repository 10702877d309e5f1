"""Near copies as the pipeline has them: word-shingle sets with a Jaccard similarity of LEAST or more.

Two texts at similarity 0.8 have SimHashes about 15 % of their bits apart, whatever the width, so no
few blocks of one print cover that.  Here a print has as many blocks as it takes: texts meet where
a block of bits is equal, stay if their check bits are near enough, and are checked on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from surfaudit.llm.common import NO_ID, SpanHashes, Words, materialize, mix, signed, slices, text_bytes
from surfaudit.llm.simhash import keep_first
from surfaudit.operators.components import connected_components

SHINGLE = 5
LEAST = (4, 5)  # similarity as a fraction
BLOCKS, BLOCK_BITS = 56, 8  # a pair right at the threshold has no equal block with a chance of 3 in 10 million, one of 8 and 9 words of 3 in 100,000
APART = 0.1515  # share of bits in which two long texts right at the threshold differ
CHECK_WORDS, CHECK_APART = 2, 40  # check bits, none of them in a block: 64 a word, and how many may differ; a chance of 1 in a million to 1 in 5,000
FULL = 512  # texts in a block's bucket, on average, from which blocks get longer
PAIRED = 4096  # texts of a bucket up to which its pairs are held against the check bits
SLOT = 1 << 15  # texts of a block that one group opens
PARITY_LONGS = 16  # 1,024 bits, named by the upper ten of a shingle's hash
AT_ONCE = 255  # shingles whose bits are counted at once, in single bytes
SLICE = 1 << 20  # bytes of text whose shingles are held at once
ENTRY = np.dtype([("key", "<u2"), ("node", "<i8"), ("n", "<u4"), ("check", "<u8", CHECK_WORDS)])


@dataclass(frozen=True)
class Blocks:
    """How many blocks of how many bits a print has; ``low`` bits of a block's value order a slot, the others name it."""

    count: int
    bits: int
    low: int

    @staticmethod
    def of(texts: int) -> Blocks:
        """Blocks of equal recall at any number of texts: longer ones are equal less often, so there are more."""
        bits = max(BLOCK_BITS, int(np.ceil(np.log2(max(texts, 1) / FULL))))
        slots = max(0, int(np.ceil(np.log2(max(texts, 1) / SLOT))))
        return Blocks(int(np.ceil(BLOCKS / (1 - APART) ** (bits - BLOCK_BITS))), bits, bits - min(slots, bits))

    @property
    def words(self) -> int:
        return CHECK_WORDS - -self.count * self.bits // 64


def shingle_sets(batch: pa.RecordBatch) -> Iterator[tuple[slice, list[np.ndarray]]]:
    """Sorted hashes of the distinct word shingles of each text, a few texts at a time.

    A text of fewer words is one shingle, one without words has none.
    """
    sizes = [x or 0 for x in batch.column("size").to_pylist()]
    for part in slices(sizes, SLICE):
        texts = list(text_bytes(batch.slice(part.start, part.stop - part.start)))
        words = Words([t.lower() if t else t for t in texts])  # bytes: A-Z only
        spans = SpanHashes(words.hashes())
        grams, held = spans.grams(SHINGLE), []
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            if b - a >= SHINGLE:
                held.append(np.unique(grams[a : b - SHINGLE + 1]))
            else:
                held.append(spans.spans(np.array([a]), np.array([b]))[: b - a])
        yield part, held


def simhash(held: np.ndarray, words: int) -> np.ndarray:
    """Majority bits over the hashes of distinct shingles, 64 a word, as zeros and ones."""
    draw = np.random.default_rng(42).integers(0, 1 << 64, size=(2, words), dtype=np.uint64)
    flip, factor = draw[0], draw[1] | np.uint64(1)
    counts = np.zeros(64 * words, dtype=np.int64)
    for i in range(0, len(held), AT_ONCE):
        hashes = mix((held[i : i + AT_ONCE, None] ^ flip) * factor)
        counts += np.add.reduce(np.unpackbits(hashes.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return (2 * counts > len(held)).astype(np.uint8)


def _print(held: np.ndarray, blocks: Blocks) -> tuple[bytes, bytes]:
    """(blocks, check): the values of the blocks of a set's SimHash, and its check bits."""
    bits = simhash(held, blocks.words)
    check = 64 * CHECK_WORDS
    values = bits[check : check + blocks.count * blocks.bits].reshape(blocks.count, blocks.bits).astype(np.uint32) @ (1 << np.arange(blocks.bits, dtype=np.uint32))
    return values.astype("<u4").tobytes(), np.packbits(bits[:check]).tobytes()


def _parity(held: np.ndarray) -> np.ndarray:
    """Bits that tell whether an even or odd number of shingles falls on them: sets differ in as many shingles as bits at least."""
    odd = np.bincount((held >> np.uint64(54)).astype(np.int64), minlength=64 * PARITY_LONGS) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def _sketches(docs: DataFrame, blocks: Blocks) -> DataFrame:
    """(doc_id, mark, node, n, blocks, check): ``node`` is a hash of the whole set of n shingles, the rest its SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in shingle_sets(batch):
                node = np.array([xxhash.xxh64_intdigest(held.tobytes()) for held in sets], dtype=np.uint64)
                prints = [_print(held, blocks) if len(held) else (None, None) for held in sets]
                rows = batch.slice(part.start, len(sets))
                columns = [rows.column("doc_id"), rows.column("mark"), pa.array(signed(node)), pa.array(list(map(len, sets)), pa.int64())]
                columns += [pa.array(x, pa.binary()) for x in zip(*prints)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "node", "n", "blocks", "check"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("mark"), F.octet_length("text").alias("size"), "text")
    return materialize(rows.mapInArrow(run, "doc_id bigint, mark bigint, node bigint, n bigint, blocks binary, check binary"))


def in_sight(entries: np.ndarray) -> np.ndarray:
    """For each of ``entries``, in order of their keys, the first that it reaches in its bucket.

    Two of a key see each other if their sizes and check bits are near enough; in a bucket of
    more than PAIRED all do.
    """
    p, q = LEAST
    key, check, n = entries["key"], entries["check"], entries["n"].astype(np.int64)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(first, len(key)))
    large = np.repeat(size > PAIRED, size)
    root = np.where(large, np.repeat(first, size), np.arange(len(key)))
    at = np.flatnonzero(~large)
    step = 1
    while len(at):
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        a, b = n[at], n[at + step]
        met = at[q * np.minimum(a, b) >= p * np.maximum(a, b)]
        met = met[np.bitwise_count(check[met] ^ check[met + step]).sum(axis=1, dtype=np.int64) <= CHECK_APART]
        while True:
            a, b = root[met], root[met + step]
            met, a, b = (x[a != b] for x in (met, a, b))
            if not len(met):
                break
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
        step += 1
    return root


def shared_blocks(classes: DataFrame, blocks: Blocks) -> DataFrame:
    """(band, node, rows): a band holds those nodes of a bucket, a block and its value, that reach each other by sight, ``rows`` of them."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column("blocks").to_pylist()), dtype="<u4").reshape(-1, blocks.count)
            entries = np.empty(len(values), dtype=ENTRY)
            entries["node"], entries["n"] = batch.column("node").to_numpy(), batch.column("n").to_numpy()
            entries["check"] = np.frombuffer(b"".join(batch.column("check").to_pylist()), dtype="<u8").reshape(-1, CHECK_WORDS)
            for k in range(blocks.count):
                entries["key"] = values[:, k] & ((1 << blocks.low) - 1)
                slot = (values[:, k] >> blocks.low).astype(np.int64)
                order = np.argsort(slot, kind="stable")
                cuts = np.flatnonzero(np.diff(slot[order])) + 1
                parts = np.split(entries[order], cuts)
                names = slot[order][np.append(0, cuts)] + (k << (blocks.bits - blocks.low))
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([x.tobytes() for x in parts], pa.binary())], ["slot", "entries"])

    def meet(group: pa.Table) -> pa.Table:
        entries = np.frombuffer(b"".join(group.column("entries").to_pylist()), dtype=ENTRY)
        entries = entries[np.argsort(entries["key"], kind="stable")]
        _, back, size = np.unique(in_sight(entries), return_inverse=True, return_counts=True)
        met = size[back] > 1
        band = (group.column("slot")[0].as_py() << 32) + back[met]
        return pa.table({"band": band, "node": np.ascontiguousarray(entries["node"][met]), "rows": size[back][met].astype(np.int64)})

    printed = classes.where("blocks is not null").select("node", "n", "blocks", "check")
    dealt = printed.mapInArrow(deal, "slot bigint, entries binary")
    return materialize(dealt.groupBy("slot").applyInArrow(meet, "band bigint, node bigint, rows bigint"))


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, held, parity): the shingle sets of the nodes of ``wanted`` (node, first), each from its first text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in shingle_sets(batch):
                node = batch.column("node").slice(part.start, len(sets))
                held, marks = (pa.array(x, pa.list_(pa.int64())) for x in ([signed(x) for x in sets], [_parity(x) for x in sets]))
                yield pa.RecordBatch.from_arrays([node, held, marks], ["node", "held", "parity"])

    keys = wanted.select("node", F.coalesce("first.doc_id", F.lit(NO_ID)).alias("_id"), F.col("first.mark").alias("_mark"))
    marked = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("_id"), F.xxhash64("text").alias("_mark"), "text")
    texts = marked.join(keys, ["_id", "_mark"]).select("node", F.octet_length("text").alias("size"), "text")
    return materialize(texts.mapInArrow(run, "node bigint, held array<bigint>, parity array<bigint>").dropDuplicates(["node"]))


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (src, dst) whose sets are similar enough, counted on the whole sets."""
    p, q = LEAST
    met = pairs.join(sets.select(F.col("node").alias("src"), F.col("held").alias("a")), "src").join(
        sets.select(F.col("node").alias("dst"), F.col("held").alias("b")), "dst"
    )
    both = F.size(F.array_intersect("a", "b"))
    return materialize(met.where((p + q) * both >= p * (F.size("a") + F.size("b"))).select("src", "dst"))


def _in_reach(a: Column, b: Column) -> Column:
    """Set sizes at which two sets can be similar enough."""
    p, q = LEAST
    return q * F.least(a, b) >= p * F.greatest(a, b)


def _prefixes(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, n, parity, prefix): the rarest shingles of each of ``nodes`` (node).

    Two sets of n and m shingles at similarity p / q or more have p / q of either in common, so
    they share one of the n - ceil(n p / q) + 1 first of each in any common order (Chaudhuri,
    Ganti and Kaushik, 2006).  In the order of rarity texts that are alike, but not enough, seldom do.
    """
    p, q = LEAST
    mine = nodes.join(sets, "node")
    each = materialize(mine.select("node", F.size("held").alias("n"), F.explode("held").alias("shingle")))
    common = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    ranked = each.join(materialize(common), "shingle", "left").groupBy("node", "n").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("texts", F.lit(1)).alias("texts"), "shingle"))).alias("held")
    )
    first = F.slice("held", F.lit(1), (F.col("n") - F.ceil(F.col("n") * p / q) + 1).cast("int"))
    met = F.filter(first, lambda s: s["texts"] > 1)  # a shingle of one text meets no other
    prefixes = ranked.select("node", "n", F.transform(met, lambda s: s["shingle"]).alias("prefix"))
    return materialize(prefixes.join(mine.select("node", "parity"), "node"))


def _parity_allows(a: str, b: str, sizes: Column) -> Column:
    """No more bits differ than shingles may: two sets at p / q differ in (q - p) / (q + p) of the sum of their sizes at most."""
    p, q = LEAST
    differ = [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(PARITY_LONGS)]
    return (q + p) * reduce(lambda x, y: x + y, differ) <= (q - p) * sizes


def _leaders(nodes: DataFrame) -> DataFrame:
    """(band, lead): the node of each band that meets most others, in a group of edited copies the text they come from."""
    return nodes.groupBy("band").agg(F.max(F.struct("degree", "node", "n", "part")).alias("lead"))


def near_copy_links(classes: DataFrame, docs: DataFrame, blocks: Blocks) -> DataFrame:
    """Edges (src, dst) between nodes that give the components of all similar pairs with an equal block.

    ``classes`` has (node, n, blocks, check, first).  First the nodes of a bucket meet its leader, so a
    large group of copies costs one pair per copy.  Nodes of a bucket that are still in several
    components meet if the parities of their sets allow it and they share one of their rarest shingles.
    """
    shared = shared_blocks(classes, blocks)
    degree = materialize(shared.groupBy("node").agg(F.sum("rows").alias("degree")).join(classes.select("node", "n"), "node"))
    sets = _sets(docs, classes.join(degree, "node", "left_semi").select("node", "first"))
    named = materialize(shared.select("band", "node").join(degree, "node").withColumn("part", F.col("node")))

    links, leaders = None, _leaders(named)
    for _ in range(2):
        led = named.join(materialize(leaders), "band").where((F.col("part") != F.col("lead.part")) & _in_reach(F.col("n"), F.col("lead.n")))
        pairs = led.select(F.least("node", "lead.node").alias("src"), F.greatest("node", "lead.node").alias("dst")).distinct()
        found = _alike(materialize(pairs), sets)
        links = found if links is None else links.unionAll(found)
        merged = materialize(connected_components(links))
        parts = named.drop("part").join(merged, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
        split = parts.groupBy("band").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("band")
        named = materialize(parts.join(split, "band"))
        # Next the best of those that the first leader of the band did not reach.
        top = _leaders(named).select("band", F.col("lead.part").alias("top"))
        leaders = _leaders(named.join(materialize(top), "band").where(F.col("part") != F.col("top")))

    prefixes = _prefixes(named.select("node").distinct(), sets)
    held = materialize(named.select("band", "node", "part").join(prefixes, "node"))
    one, two = (held.select("band", *[F.col(c).alias(f"{c}{i}") for c in ("node", "part", "n", "parity", "prefix")]) for i in (1, 2))
    near = (F.col("part1") < F.col("part2")) & _in_reach(F.col("n1"), F.col("n2")) & _parity_allows("parity1", "parity2", F.col("n1") + F.col("n2"))
    near = near & F.arrays_overlap("prefix1", "prefix2")
    cross = one.join(two, (one["band"] == two["band"]) & near).select(F.least("node1", "node2").alias("src"), F.greatest("node1", "node2").alias("dst")).distinct()
    return links.unionAll(_alike(cross, sets))


def near_copy_components(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, node) per row of ``docs``: ``node`` names the component of near copies.

    Texts with equal shingle sets are one; texts without words, null ones included, are near
    copies of each other.  A null doc_id counts as larger than all others; rows that repeat a
    doc_id are told apart by a hash of their text.  An empty table gives no row.
    """
    blocks = Blocks.of(docs.count())
    rows = _sketches(docs, blocks)
    classes = rows.groupBy("node").agg(
        F.first("n").alias("n"), F.first("blocks").alias("blocks"), F.first("check").alias("check"),
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first"),
    )
    merged = connected_components(near_copy_links(materialize(classes), docs, blocks))
    return rows.join(merged, "node", "left").select("doc_id", "mark", F.coalesce("component", "node").alias("node"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each component of near copies, as ``keep_first`` has it."""
    return keep_first(docs, near_copy_components(docs))
