"""Prefix trie of conversations from padded turn-id matrices.

Turns become ids, conversations become rows of ids, and rows are dealt into ranges of their order,
so a hot first turn is cut like any other stretch.  A range is sorted column by column, a few
columns at a time and only the rows that reach them; change masks, OR-accumulated over the
columns, mark where nodes start at each depth, and reduceat sums up each node.  Only the nodes on
the way to the first and last row of a range can lie in two ranges: their parts are put together
afterwards, the rest is whole where it is found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from surfaudit.llm.common import materialize

FAMILY = 100  # conversations that share the opening of the one whose id is a multiple of this
OPENINGS = 6  # an opening has fewer turns than this
BLOCK = 8  # turns whose columns are sorted together
RANGE_TURNS = 1 << 19  # turns of a range at most, unless one conversation has more ...
LEAST_TURNS = 1 << 12  # ... and at least, where there are partitions to spare
CHUNK_IDS = 1 << 13  # ids joined into one row on the way to a digest
PAD = np.iinfo(np.int64).min
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "kind int, key binary, parent_key binary, top binary, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, " \
    "n_children bigint, n_leaves bigint, saved_tokens bigint, last_points bigint, ends string"
WHOLE, PART, IDS = range(3)  # kinds of rows


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): structs (a, b, points) by turn, null first, then by role and text.

    ``a`` and ``b`` are two 64-bit hashes of (role, text), ``points`` the code points of the text.
    Rows without conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role, text)
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    turn = F.struct(
        place.alias("i"), F.greatest(F.xxhash64("role", "text"), F.lit(PAD + 1)).alias("a"), F.xxhash64(F.lit(1), "text", "role").alias("b"),
        F.char_length("text").alias("points"),
    )
    turns = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return turns.select("conv_id", F.transform("t", lambda t: F.struct(t["a"], t["b"], t["points"])).alias("turns"))


def opening_turns(conv_id: str = "conv_id") -> Column:
    """How many turns a conversation takes from the first of its family."""
    return (F.crc32(F.col(conv_id).cast("string")) % OPENINGS).cast("int")


def with_openings(turns: DataFrame) -> DataFrame:
    """Conversations whose first turns are replaced by those of the first of their family.

    At most FAMILY conversations share an opening, so no key of this join is hot.
    """
    own = turns.withColumns({"h": opening_turns(), "base": F.col("conv_id") - F.col("conv_id") % FAMILY})
    heads = turns.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, OPENINGS - 1).alias("head"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return own.join(heads, "base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def _chain(ids: np.ndarray) -> list[bytes]:
    """Keys of the nodes on the way to a row, the root first."""
    state = hashlib.blake2b(digest_size=16)
    out = [state.digest()]
    for pair in ids.reshape(-1, 2):
        state.update(pair.tobytes())
        out.append(state.digest())
    return out


def _levels(conv: np.ndarray, length: np.ndarray, ids: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, list[dict]]:
    """Row order, and per depth from 1 the nodes: parent, n, conv, points, and (first, count) of the rows that end there.

    ``ids`` has two per turn.  Rows stand by their ids, a row before its continuations, equal rows by conv.
    """
    offset = np.cumsum(length) - length
    order = np.lexsort((conv, length > 0))
    group = np.zeros(len(conv), dtype=np.int64)
    held = np.zeros(len(conv), dtype=np.int64)  # node of the depth before, by place in the order
    levels: list[dict] = []
    begin = 0
    while True:
        active = np.flatnonzero(length[order] > begin)
        if not len(active):
            return order, levels
        rows = order[active]
        matrix = np.full((2 * BLOCK, len(rows)), PAD, dtype=np.int64)
        for j in range(BLOCK):
            has = np.flatnonzero(length[rows] > begin + j)
            at = 2 * (offset[rows[has]] + begin + j)
            matrix[2 * j, has], matrix[2 * j + 1, has] = ids[at], ids[at + 1]
        longer = length[rows] > begin + BLOCK  # after those that end with these columns
        moved = np.lexsort((longer, *matrix[::-1], group[active]))  # stable: equal rows keep their order
        rows, matrix, own = rows[moved], matrix[:, moved], group[active][moved]
        order[active] = rows
        change = np.ones((2 * BLOCK, len(rows)), dtype=bool)
        change[:, 1:] = matrix[:, 1:] != matrix[:, :-1]
        change[0, 1:] |= own[1:] != own[:-1]
        change = np.logical_or.accumulate(change, axis=0)
        for j in range(BLOCK):
            depth = begin + j + 1
            present = np.flatnonzero(length[rows] >= depth)
            if not len(present):
                break
            start = np.flatnonzero(change[2 * j + 1, present])
            lead = rows[present[start]]
            ends = length[rows[present]] == depth  # the rows of a node that end there come first
            levels.append({
                "parent": held[active[present[start]]], "n": np.diff(np.append(start, len(present))),
                "conv": np.minimum.reduceat(conv[rows[present]], start), "points": points[offset[lead] + depth - 1].astype(np.int64),
                "first": active[present[start]], "ends": np.add.reduceat(ends.astype(np.int64), start),
            })
            held[active[present]] = np.cumsum(change[2 * j + 1, present]) - 1
        group[active] = np.cumsum(change[-1])
        begin += BLOCK


def _up(parents: int, parent: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` by parent; children of one parent stand together."""
    out = np.zeros(parents, dtype=np.int64)
    if len(parent):
        start = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
        out[parent[start]] = np.add.reduceat(values, start)
    return out


def _joined(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def _range_nodes(conv: np.ndarray, length: np.ndarray, ids: np.ndarray, points: np.ndarray) -> Iterator[dict[str, list]]:
    """Columns of NODE for the nodes of one range of rows, depth by depth from the deepest."""
    order, levels = _levels(conv, length, ids, points)
    offset = np.cumsum(length) - length
    edge = [_chain(ids[2 * offset[r] : 2 * (offset[r] + length[r])]) for r in (order[0], order[-1])]
    none = int(np.count_nonzero(length == 0))
    root = {"n": np.array([len(conv)]), "conv": np.array([conv.min()]), "points": np.zeros(1, dtype=np.int64), "first": np.zeros(1, dtype=np.int64), "ends": np.array([none])}
    levels = [root, *levels]

    def on_chain(d: int) -> dict[int, bytes]:
        """Nodes of a depth on the way to the first and last row, with their keys."""
        ends = {} if d >= len(edge[1]) else {len(levels[d]["n"]) - 1: edge[1][d]}
        return ends if d >= len(edge[0]) else {**ends, 0: edge[0][d]}

    below: tuple | None = None  # parent, leaves, saved of the whole nodes one depth further down
    for d in range(len(levels) - 1, -1, -1):
        level, chain = levels[d], on_chain(d)
        count = len(level["n"])
        children, leaves, saved = (np.zeros(count, dtype=np.int64) for _ in range(3)) if below is None else (
            _up(count, below[0], x) for x in (np.ones(len(below[0]), dtype=np.int64), below[1], below[2])
        )
        whole = np.ones(count, dtype=bool)
        whole[list(chain)] = False
        leaves = leaves + (whole & (children == 0))
        saved = saved + np.where(whole, (level["n"] - 1) * level["points"], 0)
        up = on_chain(d - 1) if d else {}
        parent = level["parent"] if d else np.zeros(1, dtype=np.int64)
        below = (parent[whole], leaves[whole], saved[whole])
        top = lambda k: chain[k] if d == 1 else edge[0][1] if k == 0 and len(edge[0]) > d else edge[1][1]
        parent_conv = levels[d - 1]["conv"][parent] if d else np.zeros(1, dtype=np.int64)
        ends = []
        for k, (a, n) in enumerate(zip(level["first"].tolist(), level["ends"].tolist())):
            ends.append(hashlib.sha256(_joined(conv[order[a : a + n]]).encode()).hexdigest() if n and whole[k] else EMPTY if whole[k] else None)
        over = parent.tolist()
        yield {
            "kind": np.where(whole, WHOLE, PART).astype(np.int32), "key": [chain.get(k) for k in range(count)],
            "parent_key": [up.get(k) for k in over], "top": [top(k) if k in chain and d else None for k in range(count)],
            "depth": np.full(count, d), "conv_id": level["conv"], "parent_conv_id": [None if k in up or not d else c for k, c in zip(over, parent_conv.tolist())],
            "n_convs": level["n"], "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "last_points": level["points"], "ends": ends,
        }
        for k, key in chain.items():
            mine = conv[order[level["first"][k] : level["first"][k] + level["ends"][k]]]
            for i in range(0, len(mine), CHUNK_IDS):
                some = mine[i : i + CHUNK_IDS]
                yield {"kind": np.array([IDS], dtype=np.int32), "key": [key], "conv_id": some[:1], "ends": [_joined(some)]}


def _sort_and_mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of one range; its ids are held, never a text."""
    parts = list(batches)
    rows = pa.Table.from_batches(parts).combine_chunks() if parts else None
    if rows is None or not rows.num_rows:
        return
    turns = rows.column("turns").combine_chunks()
    length = turns.value_lengths().to_numpy().astype(np.int64)
    a, b, points = (turns.flatten().field(k).to_numpy() for k in range(3))
    names = [c.split()[0] for c in NODE.split(", ")]
    kinds = [pa.int32(), *[pa.binary()] * 3, *[pa.int64()] * 8, pa.string()]
    for nodes in _range_nodes(rows.column("conv_id").to_numpy(), length, np.column_stack((a, b)).ravel(), points):
        n = len(nodes["kind"])
        yield pa.RecordBatch.from_arrays([pa.array(nodes[c], t) if c in nodes else pa.nulls(n, t) for c, t in zip(names, kinds)], names)


def _digest_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the chunks of each key in turn; rows come by key and first id, and only the state is held."""
    now, state = None, None
    for batch in batches:
        for key, text in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if key == now:
                state.update(b"," + text.encode())
                continue
            if now is not None:
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], ["key", "sha"])
            now, state = key, hashlib.sha256(text.encode())
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], ["key", "sha"])


def _recombined(parts: pd.DataFrame) -> pd.DataFrame:
    """Nodes that lie in several ranges, put together from their parts; all are below one first turn."""
    sums = {c: "sum" for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")}
    nodes = parts.groupby("key").agg({"parent_key": "first", "depth": "first", "conv_id": "min", "last_points": "first", **sums})
    nodes = nodes.sort_values("depth", ascending=False, kind="stable")
    values = {k: list(v) for k, v in zip(nodes.index, nodes[list(sums)].to_numpy().tolist())}
    for key, parent, points in zip(nodes.index, nodes["parent_key"], nodes["last_points"]):
        mine = values[key]
        mine[2] += mine[1] == 0
        mine[3] += (mine[0] - 1) * points
        if parent in values:
            values[parent][1] += 1
            values[parent][2] += mine[2]
            values[parent][3] += mine[3]
    nodes[list(sums)] = [values[k] for k in nodes.index]
    return nodes.reset_index()[["key", "parent_key", "depth", "conv_id", *sums]]


def trie_nodes(rebuilt: DataFrame) -> DataFrame:
    """One row per node of the trie of ``rebuilt`` (conv_id, turns): see ``conversation_trie``."""
    rows = materialize(rebuilt)
    spark = rows.sparkSession
    turns = rows.agg(F.sum(F.size("turns") + 1)).first()[0] or 0
    spare = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, -(-turns // RANGE_TURNS), min(spare, turns // LEAST_TURNS))
    nodes = materialize(rows.repartitionByRange(ranges, "turns", "conv_id").mapInArrow(_sort_and_mark, NODE))

    whole, parts = nodes.where(F.col("kind") == WHOLE), nodes.where(F.col("kind") == PART)
    chunks = nodes.where(F.col("kind") == IDS).select("key", "conv_id", "ends")
    digests = chunks.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_digest_chunks, "key binary, sha string")
    digests = materialize(digests)
    fields = ["depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    cut = parts.where("depth > 0").select("top", "key", "parent_key", "last_points", *fields)
    schema = "key binary, parent_key binary, depth bigint, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"
    cut = materialize(cut.groupBy("top").applyInPandas(_recombined, schema))

    firsts = whole.select(*fields).unionAll(cut.select(*fields)).where("depth = 1")
    below = firsts.agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
    root = parts.where("depth = 0").groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"))
    root = root.select(F.lit(0).alias("one"), "key", "conv_id", "n_convs").join(below.withColumn("one", F.lit(0)), "one")
    root = materialize(root.select(
        "key", F.lit(None).cast("binary").alias("parent_key"), F.lit(0).cast("bigint").alias("depth"), "conv_id", "n_convs", "n_children",
        F.coalesce("l", F.lit(1)).alias("n_leaves"), F.coalesce("s", F.lit(0)).alias("saved_tokens"),
    ))
    least = root.agg(F.min("conv_id")).first()[0]
    root_key = bytearray(_chain(np.zeros(0, dtype=np.int64))[0])

    named = root.unionByName(cut).join(digests, "key", "left").select(
        "parent_key", *fields, F.lit(None).cast("bigint").alias("parent_conv_id"), F.coalesce("sha", F.lit(EMPTY)).alias("ends_sha256")
    )
    every = whole.select("parent_key", *fields, "parent_conv_id", F.col("ends").alias("ends_sha256")).unionByName(named)
    # Nodes right below the root get its id as a number; only nodes below a recombined one are joined.
    over = cut.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("over"))
    under_root = F.col("parent_key") == F.lit(root_key)
    apart = F.col("parent_key").isNotNull() & ~under_root
    direct = every.where(~apart | F.col("parent_key").isNull()).withColumn("parent_conv_id", F.when(under_root, F.lit(least)).otherwise(F.col("parent_conv_id")))
    joined = every.where(apart).join(over, "parent_key").withColumn("parent_conv_id", F.col("over")).drop("over")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return direct.select(*out).unionAll(joined.select(*out))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct sequence of first turns (role, text) of the conversations with their openings.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a node is
    named by its smallest member and its depth.  Turns stand by ``turn``, null first, ties by role and
    text; a null role or text is empty; rows that repeat all of these are turns of their own.  Rows
    without conv_id are left out, and a table without conversations has no node, not even a root.
    Conversations may be of any length: only ids of turns are gathered, 20 bytes each.  Other columns
    are not read.
    """
    return trie_nodes(with_openings(turn_rows(conversations)))
