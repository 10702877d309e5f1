"""Shards of near equal bytes from a k-d tree over document metadata.

A node is cut at the weighted median of the dimension that spreads widest in it, and its leaves
are shared out in proportion, until every leaf is a shard.  Points of the tree are groups of
equal texts, so that copies stay together; a group heavier than GRAIN of a shard is dealt into
pieces that stay neighbours in every order.  Medians come from histograms over twelve bits of a
sort key at a time.  Histograms are summed up where they are made: a round sends one row per open
cell, however many documents there are, and cuts are tables that points are joined with.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from surfaudit.llm.common import NO_ID, materialize

GRAIN = 1e-3  # of a shard's bytes: heavier groups are dealt into pieces, and medians are exact to it
DIGIT = 12
KEY_BITS = 60  # 20 of the coordinate, 40 of the text's hash
PIECE_BITS = 48  # of the piece, which comes after the key
SLOT_ROWS = 2_000  # rows numbered together, in this many buckets of a shard at least
LEAST_BUCKETS = 64
GROUP = ["mark", "text_crc32", "size"]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    extra = {c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in ("lang", "source")}
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("mark"), *[v.alias(k) for k, v in extra.items()],
        F.monotonically_increasing_id().alias("row"),  # tells equal rows apart; written before it is used
    )


def _groups(rows: DataFrame) -> DataFrame:
    """One row per text: bytes of all its copies, and coordinates of 20 bits each."""
    first = F.min_by(F.struct("lang", "source"), F.coalesce("doc_id", F.lit(NO_ID)))
    groups = rows.groupBy(*GROUP).agg(F.sum("size").alias("bytes"), F.min("doc_id").alias("place"), first.alias("m"))
    groups = materialize(groups)
    low = groups.agg(F.min("size"), F.max("size"), F.min("place"), F.max("place")).first()

    def scaled(value: Column, a: float | None, b: float | None) -> Column:
        if a is None or a == b:
            return F.lit(0).cast("bigint")
        return F.coalesce(F.floor((value - a) / (b - a) * ((1 << 20) - 1)), F.lit(0)).cast("bigint")

    def coded(value: str) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(1 << 20)).cast("bigint")

    sizes = [math.log(v) if v is not None else None for v in low[:2]]
    axes = [scaled(F.ln("size"), *sizes), scaled(F.col("place"), *low[2:]), coded("m.lang"), coded("m.source")]
    tail = F.pmod("mark", F.lit(1 << 40))
    return groups.select(*GROUP, "bytes", F.array(*[F.shiftleft(a, 40) + tail for a in axes]).alias("keys"))


def _piece(n: Column) -> Column:
    return F.pmod(F.xxhash64("doc_id", "row", F.lit(7)), n).cast("bigint")


class Tree:
    """Cells of a binary tree; a cell's children are 2c and 2c + 1, and the root is 1."""

    def __init__(self, leaves: int):
        self.leaves = {1: leaves}  # cell -> shards below it
        self.levels: list[dict[int, tuple[int, int, int]]] = []  # cell -> axis, key and piece at which its right side starts

    def open_cells(self) -> list[int]:
        return [c for c, n in self.leaves.items() if n > 1 and c.bit_length() == len(self.levels) + 1]

    def split(self, cuts: dict[int, tuple[int, int, int]]) -> None:
        self.levels.append(cuts)
        for c in cuts:
            n = self.leaves[c]
            self.leaves[2 * c], self.leaves[2 * c + 1] = (n + 1) // 2, n // 2

    def lowered(self, df: DataFrame, level: int) -> DataFrame:
        """``df`` with ``cell`` one level further down; the cuts of a level are a table of at most as many rows as shards."""
        rows = [(c, *cut) for c, cut in self.levels[level].items()]
        cuts = df.sparkSession.createDataFrame(rows, "cell bigint, axis int, cut bigint, cut_piece bigint")
        key = F.get("keys", F.col("axis"))
        right = (key > F.col("cut")) | ((key == F.col("cut")) & (F.col("piece") >= F.col("cut_piece")))
        down = F.when(F.col("axis").isNull(), F.col("cell")).otherwise(2 * F.col("cell") + right.cast("bigint"))
        return df.join(cuts, "cell", "left").select(*[c for c in df.columns if c != "cell"], down.alias("cell"))

    def shards(self) -> dict[int, int]:
        """Leaves numbered from left to right."""
        inner = {c for level in self.levels for c in level}
        ends = [c for c in self.leaves if c not in inner]
        top = max(c.bit_length() for c in ends)
        return {c: i for i, c in enumerate(sorted(ends, key=lambda c: c << (top - c.bit_length())))}


@dataclass
class Median:
    """What is known of a cell's cut: digits of key and piece, the last one's name and shift, bytes before and at it."""

    axis: int
    left: float  # bytes that go left
    key: int = 0
    piece: int = 0
    name: str = "key"
    shift: int = KEY_BITS
    before: int = 0
    weight: float = math.inf

    def cut(self) -> tuple[int, int, int]:
        step = (1 << self.shift) * (self.before + self.weight - self.left < self.left - self.before)
        return (self.axis, self.key + step, 0) if self.name == "key" else (self.axis, self.key, self.piece + step)


def _medians(points: DataFrame, cells: dict[int, Median], grain: float) -> None:
    """Finds the cut of each cell, twelve bits at a time, until the bytes at it are no more than a grain."""
    spark = points.sparkSession
    axes = spark.createDataFrame([(c, m.axis) for c, m in cells.items()], "cell bigint, axis int")
    keyed = points.join(axes, "cell").select("cell", "bytes", F.get("keys", F.col("axis")).alias("key"), "piece")
    digits = [("key", s) for s in range(KEY_BITS - DIGIT, -1, -DIGIT)] + [("piece", s) for s in range(PIECE_BITS - DIGIT, -1, -DIGIT)]
    for name, shift in digits:
        some = [(c, m.key, m.piece, m.left - m.before) for c, m in cells.items() if m.weight > grain]
        if not some:
            return
        known = spark.createDataFrame(some, "cell bigint, known_key bigint, known_piece bigint, left double")
        inside = F.shiftright(name, shift + DIGIT) == F.shiftright(f"known_{name}", shift + DIGIT)
        if name == "piece":
            inside &= F.col("key") == F.col("known_key")
        digit = F.shiftright(name, shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
        bins = keyed.join(known, "cell").where(inside).groupBy("cell", "left", digit.alias("d")).agg(F.sum("bytes").alias("b"))
        upto = F.sum("b").over(W.partitionBy("cell").orderBy("d").rowsBetween(W.unboundedPreceding, 0))  # of 4096 rows at most
        at = F.struct("d", (F.col("upto") - F.col("b")).alias("before"), "b")
        found = bins.withColumn("upto", upto).groupBy("cell").agg(F.coalesce(F.min(F.when(F.col("upto") >= F.col("left"), at)), F.max(at)).alias("at"))
        for c, (d, before, b) in found.collect():  # a row per open cell
            m = cells[c]
            setattr(m, name, getattr(m, name) + (d << shift))
            m.name, m.shift, m.before, m.weight = name, shift, m.before + before, b


def shard_documents(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs``.

    Give the number of shards, or the bytes a shard should have.  ``size`` is the UTF-8 length of
    the text (null: none) plus one.  Shards have near equal sizes: each cut is off by at most
    GRAIN of a shard.  Slots number a shard's rows without gaps.  Equal texts share a shard
    unless a cut falls inside a group that weighs more than that.  Dimensions are the length, the
    smallest doc_id, lang and source of a text's first copy, where those columns exist; nulls lie
    at the origin.  An empty table gives an empty result.
    """
    rows = materialize(_rows(docs, id_col, text_col))
    groups = _groups(rows)
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    if shards is None:
        shards = max(1, -(-total // (target_bytes or total or 1)))
    grain = max(1.0, GRAIN * total / shards)
    groups = materialize(groups.withColumn("pieces", F.ceil(F.col("bytes") / grain).cast("bigint")))
    # Written tables, whose size Spark knows: heavy groups are fewer than shards / GRAIN.
    heavy = materialize(groups.where("pieces > 1").select(*GROUP, "keys", "pieces"))
    dealt = rows.join(heavy, GROUP).withColumn("piece", _piece(F.col("pieces"))).groupBy(*GROUP, "piece").agg(
        F.sum("size").alias("bytes"), F.first("keys").alias("keys")
    )
    points = groups.where("pieces = 1").select("keys", F.lit(0).cast("bigint").alias("piece"), "bytes")
    points = points.unionAll(dealt.select("keys", "piece", "bytes")).withColumn("cell", F.lit(1).cast("bigint"))
    points = materialize(points)

    tree = Tree(shards)
    while total and (cells := tree.open_cells()):
        spread = [(F.max(F.col("keys")[i]) - F.min(F.col("keys")[i])).alias(f"a{i}") for i in range(4)]
        found = points.groupBy("cell").agg(F.sum("bytes").alias("bytes"), *spread).collect()  # a row per cell
        level = {}
        for r in found:
            if r["cell"] in cells:
                share = (tree.leaves[r["cell"]] + 1) // 2 / tree.leaves[r["cell"]]
                level[r["cell"]] = Median(max(range(4), key=lambda i: (r[f"a{i}"], -i)), r["bytes"] * share)
        if level:
            _medians(points, level, grain)
        tree.split({c: level[c].cut() if c in level else (0, 0, 0) for c in cells})  # nothing lies in the others
        points = materialize(tree.lowered(points, len(tree.levels) - 1))

    own = rows.join(groups.select(*GROUP, "keys", "pieces"), GROUP).withColumn("piece", F.when(F.col("pieces") > 1, _piece(F.col("pieces"))).otherwise(0))
    placed = own.select("doc_id", "size", "text_crc32", "mark", "row", "keys", "piece", F.lit(1).cast("bigint").alias("cell"))
    for level in range(len(tree.levels)):
        placed = tree.lowered(placed, level)
    numbers = docs.sparkSession.createDataFrame(list(tree.shards().items()), "cell bigint, shard int")
    placed = materialize(placed.join(numbers, "cell").select("doc_id", "size", "text_crc32", "mark", "row", "shard"))
    return _slotted(placed, shards).select("doc_id", "size", "text_crc32", "shard", "slot")


def _slotted(placed: DataFrame, shards: int) -> DataFrame:
    """Adds ``slot``: rows are numbered inside buckets, and buckets start where those before end."""
    buckets = max(LEAST_BUCKETS, placed.count() // (shards * SLOT_ROWS))
    rows = placed.withColumn("b", F.pmod(F.xxhash64("doc_id", "mark", "row"), F.lit(buckets)).cast("bigint"))
    counts = rows.groupBy("shard", "b").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = W.partitionBy("shard", "b").orderBy("doc_id", "mark", "row")
    return rows.withColumn("i", F.row_number().over(inside)).join(starts, ["shard", "b"]).withColumn(
        "slot", (F.col("start") + F.col("i") - 1).cast("bigint")
    )
