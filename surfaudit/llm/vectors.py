"""Near-duplicate vectors by collision counting on one-dimensional random projections.

Projections of unit vectors are cut into windows; ``depth`` of them together name a bucket, and
there are ``tables`` such tables.  Inside a bucket every vector is a query: the pairs it forms
are counted by how many further projections fall into a window centred on its own, and pairs
whose count reaches a calibrated number are verified by their cosine.  Depth, tables and the
count follow from the number of vectors and the recall wanted for pairs right at the threshold.

Equal vectors are one node with a weight.  No pair leaves a task: a pair is counted in the first
table in which it shares a bucket, where both ends get their weights added and linked ends are
joined to the smallest node of their piece.  Buckets of more than BLOCK vectors are dealt into
pairs of blocks, so a large group is many tasks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from surfaudit.llm.common import materialize, mix, signed
from surfaudit.operators.components import connected_components

THRESHOLD = 0.9
RECALL = 0.97  # of the buckets, for a pair at the threshold; pairs above it are found more often
COUNT_RECALL = 0.99  # of the collision count
COUNTED = 16  # projections whose collisions are counted
BUCKET_ROWS = 500  # mean number of unrelated vectors that meet in a bucket
BLOCK = 1024
SEED = 20


def _normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def _same_window(width: float, distance: float) -> float:
    """Chance that two points so far apart fall into one window of a projection with random offset."""
    r = width / distance
    return 1 - 2 * _normal_cdf(-r) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


@dataclass(frozen=True)
class Plan:
    depth: int
    tables: int
    width: float  # of a bucket's windows
    reach: float  # half width of a query's window
    least: int  # collisions a pair needs
    threshold: float

    @classmethod
    def of(cls, vectors: int, threshold: float, recall: float = RECALL) -> Plan:
        near = math.sqrt(2 - 2 * threshold)
        far = math.sqrt(2)
        width = 3.6 * near
        p_near, p_far = _same_window(width, near), _same_window(width, far)
        depth = max(2, math.ceil(math.log(max(1.0, vectors / BUCKET_ROWS)) / -math.log(p_far)))
        tables = math.ceil(math.log(1 - recall) / math.log(1 - p_near**depth))
        p = 0.8
        reach = 1.2816 * near  # holds a share p of the projections of a pair at the threshold
        below, least = 0.0, 0
        while below + (step := math.comb(COUNTED, least) * p**least * (1 - p) ** (COUNTED - least)) <= 1 - COUNT_RECALL:
            below += step
            least += 1
        return cls(depth, tables, width, reach, least, threshold)

    def draws(self, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Directions and offsets of the tables, hash factors, and directions to count on; the same in every task."""
        rng = np.random.default_rng([SEED, dim])
        count = rng.standard_normal((dim, COUNTED))
        directions = rng.standard_normal((dim, self.tables * self.depth))
        offsets = rng.random(self.tables * self.depth) * self.width
        factors = rng.integers(1, 1 << 63, size=self.depth, dtype=np.uint64) | np.uint64(1)
        return directions, offsets, factors, count

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        """(vectors, tables) bucket numbers; the number of a table and the dimension go into them."""
        dim = unit.shape[1]
        directions, offsets, factors, _ = self.draws(dim)
        cells = np.floor((unit @ directions + offsets) / self.width).astype(np.int64).view(np.uint64)
        cells = cells.reshape(len(unit), self.tables, self.depth)
        named = (cells * factors).sum(axis=2, dtype=np.uint64) + np.arange(self.tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return signed(mix(mix(named) + np.uint64(dim)))


def _unit(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _with_buckets(nodes: DataFrame, plan: Plan) -> DataFrame:
    kind = dict(nodes.dtypes)["embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                buckets = plan.buckets(_unit(part.column("embedding"), int(dim)))
                ends = pa.array(np.arange(len(buckets) + 1, dtype=np.int32) * plan.tables)
                yield part.append_column("buckets", pa.ListArray.from_arrays(ends, pa.array(buckets.ravel())))

    return nodes.mapInArrow(run, f"node bigint, weight bigint, dim int, embedding {kind}, buckets array<bigint>")


def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            return root
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]


def _linked(plan: Plan, table: int, first: np.ndarray, second: np.ndarray | None, unit, seen, buckets) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, row) of a group that are counted here and reach the threshold."""
    other = first if second is None else second
    count = np.zeros((len(first), len(other)), dtype=np.int8)
    for k in range(COUNTED):
        count += np.abs(seen[first, k, None] - seen[None, other, k]) <= plan.reach
    passed = count >= plan.least
    if second is None:
        passed = np.triu(passed, 1)
    a, b = np.nonzero(passed)
    a, b = first[a], other[b]
    new = ~(buckets[a, :table] == buckets[b, :table]).any(axis=1)
    a, b = a[new], b[new]
    good = np.concatenate([
        np.einsum("ij,ij->i", unit[a[i : i + 65536]], unit[b[i : i + 65536]]) >= plan.threshold for i in range(0, max(1, len(a)), 65536)
    ])
    return a[good], b[good]


def _links_in_groups(groups: DataFrame, plan: Plan) -> DataFrame:
    """(node, links, root) of the nodes that get links in a group; groups lie together in a partition."""

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Tables that end where a group ends."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("bucket", "low", "high")])
            change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))
            if held:
                last = held[-1].slice(held[-1].num_rows - 1)
                if any(last.column(c)[0].as_py() != batch.column(c)[0].as_py() for c in ("bucket", "low", "high")):
                    yield pa.Table.from_batches(held)
                    held = []
            if len(change):
                cut = int(change[-1]) + 1
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in finished(batches):
            rows = rows.combine_chunks()
            dims = rows.column("dim").to_numpy()
            for dim in np.unique(dims):  # a bucket has one dimension only
                part = rows.filter(pa.array(dims == dim)).combine_chunks()
                unit = _unit(part.column("embedding").combine_chunks(), int(dim))
                seen = (unit @ plan.draws(int(dim))[3]).astype(np.float32)
                buckets = plan.buckets(unit)
                bucket, low, high, block, node, weight, table = (
                    part.column(c).to_numpy() for c in ("bucket", "low", "high", "block", "node", "weight", "t")
                )
                change = (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
                starts = np.concatenate(([0], np.flatnonzero(change) + 1, [len(bucket)]))
                links, left, right = np.zeros(len(node), dtype=np.int64), [], []
                for s, e in zip(starts[:-1], starts[1:]):
                    at = np.arange(s, e)
                    if low[s] == high[s]:
                        sides = (at, None)
                    else:
                        sides = (at[block[s:e] == low[s]], at[block[s:e] == high[s]])
                    a, b = _linked(plan, int(table[s]), *sides, unit, seen, buckets)
                    np.add.at(links, a, weight[b])
                    np.add.at(links, b, weight[a])
                    left.append(a)
                    right.append(b)
                a, b = np.concatenate(left), np.concatenate(right)
                root = _local_roots(len(node), a, b)
                some = np.flatnonzero(links)
                if len(some):
                    columns = [pa.array(node[some]), pa.array(links[some]), pa.array(node[root[some]])]
                    yield pa.RecordBatch.from_arrays(columns, ["node", "links", "root"])

    return groups.mapInArrow(run, "node bigint, links bigint, root bigint")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors``.

    Vectors link at a cosine of ``threshold`` or more, in double precision; no link is below it,
    and pairs right at it are found with the given recall, closer ones more surely, equal ones
    always.  Vectors that are null, empty or zero, or hold null or non-finite components, link
    with nothing, nor do vectors of different lengths.  Rows that repeat an id count as vectors
    of their own; a null id is never the smallest.
    """
    v = F.col(vector_col)
    number = lambda x: F.coalesce(x.cast("double"), F.lit(float("nan")))
    finite = F.forall(v, lambda x: ~F.isnan(number(x)) & (F.abs(number(x)) < float("inf")))
    valid = v.isNotNull() & F.coalesce(finite & F.exists(v, lambda x: number(x) != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.when(valid, v).alias("embedding"))
    rows = rows.withColumn("node", F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding")))

    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(
        F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first"), F.any_value("embedding").alias("embedding")
    )
    nodes = materialize(nodes.withColumn("dim", F.size("embedding")))
    plan = Plan.of(nodes.count(), threshold, recall)
    placed = materialize(_with_buckets(nodes.select("node", "weight", "dim", "embedding"), plan))

    met = placed.select("node", F.posexplode("buckets").alias("t", "bucket"))
    sizes = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sizes = materialize(sizes.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")))
    rows_of = placed.select("node", "weight", "dim", "embedding", F.posexplode("buckets").alias("t", "bucket")).join(sizes, "bucket")
    rows_of = rows_of.withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    rows_of = rows_of.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = rows_of.select(
        "bucket", "t", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "node", "weight", "dim", "embedding"
    ).repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    links = materialize(_links_in_groups(groups, plan))

    merged = connected_components(links.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "weight", "first").join(merged, "node", "left").join(counted, "node", "left")
    named = materialize(named.withColumn("component", F.coalesce("component", "node")))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    own = named.join(smallest, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("found"), "component_id")
    # A row without a usable vector gets a key of its own, which no node answers to.
    keyed = rows.select("vec_id", F.coalesce("node", F.xxhash64("vec_id", F.lit("none"))).alias("node"), F.col("node").isNotNull().alias("usable"))
    out = keyed.join(own.withColumn("usable", F.lit(True)), ["node", "usable"], "left")
    component = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id")).cast("bigint")
    return out.select(
        "vec_id", F.coalesce("found", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
