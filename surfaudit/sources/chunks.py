"""A store of array chunks, read chunk by chunk: assembly of windows and samples at points.

A chunk is one row: its keys and its cells as deflated .npy bytes.  Chunks lie in slabs, which are
dealt to a bounded number of folders, so a look that is confined to some slabs never lists the files
of the others.  What is shuffled are chunks that are looked at, and points; cells become rows only
in the result.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from surfaudit.functions.scalar import floor_div, lit
from surfaudit.operators.joins import explode_chunks, written

FOLDERS = 1024  # of a store at most
POINTS_A_TASK = 1 << 19  # points that one task sorts by chunk
POINTS_AT_ONCE = 1 << 16  # points of a chunk that one group looks up
CELLS_AT_ONCE = 1 << 16  # cells of a window that become rows at once


def _encoded(dense: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, dense)
    return zlib.compress(out.getvalue(), 1)


def _decoded(content: bytes) -> np.ndarray:
    """Cells of a chunk, deflated or as they are in a .npy file."""
    plain = content if content.startswith(b"\x93NUMPY") else zlib.decompress(content)
    return np.load(io.BytesIO(plain), allow_pickle=False)


@dataclass(frozen=True)
class ChunkStore:
    """Chunks of ``size`` cells a side along ``axes``, ``slab`` chunks a side to a slab, below ``path``."""

    path: str
    axes: tuple[str, ...] = ("z", "y", "x")
    size: int = 32
    slab: int = 8

    @property
    def keys(self) -> list[str]:
        return [f"k{a}" for a in self.axes]

    def slab_of(self) -> Column:
        """Folder of the slab of a chunk; slabs far apart share one, so folders do not grow with the store."""
        side = int(FOLDERS ** (1 / len(self.axes)) + 1e-9)
        return F.concat_ws("_", *[F.pmod(floor_div(F.col(k), self.slab), F.lit(side)).cast("string") for k in self.keys])

    def write(self, cells: DataFrame, value: str) -> ChunkStore:
        """Stores ``cells`` (axes, value); a cell that is absent, or null, has no value there.

        Cells are dealt in the order of their slabs and chunks before they are encoded, so a folder
        is few files whatever its size, and no chunk is shuffled or encoded twice.
        """
        axes, keys, size = list(self.axes), self.keys, self.size
        placed = cells.select(*axes, F.col(value).cast("double").alias("_v"), *[floor_div(F.col(a), size).cast("int").alias(k) for a, k in zip(axes, keys)])
        cell = reduce(lambda i, a: i * size + F.pmod(F.col(a), F.lit(size)), axes, F.lit(0)).cast("int")
        ordered = placed.select(self.slab_of().alias("slab"), *keys, cell.alias("_cell"), "_v").repartitionByRange("slab", *keys).sortWithinPartitions("slab", *keys)

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """One chunk after another, as their cells come; a chunk may go on in the next batch."""
            last, dense = None, None

            def rows(done: list[tuple[tuple[int, ...], bytes]]) -> pa.RecordBatch:
                columns = [pa.array([k[i] for k, _ in done], pa.int32()) for i in range(len(keys))]
                return pa.RecordBatch.from_arrays([*columns, pa.array([c for _, c in done], pa.binary())], [*keys, "content"])

            for batch in batches:
                at = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
                cells_at, values = batch.column("_cell").to_numpy(), batch.column("_v").to_numpy(zero_copy_only=False)
                cuts, done = (np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), []
                for a, b in zip([0, *cuts], [*cuts, len(at)]):
                    if a < b and last != tuple(at[a].tolist()):
                        if last is not None:
                            done.append((last, _encoded(dense)))
                        last, dense = tuple(at[a].tolist()), np.full((size,) * len(axes), np.nan)
                    if a < b:
                        dense.ravel()[cells_at[a:b]] = values[a:b]
                if done:
                    yield rows(done)
            if last is not None:
                yield rows([(last, _encoded(dense))])

        schema = ", ".join([*[f"{k} int" for k in keys], "content binary"])
        stored = ordered.select(*keys, "_cell", "_v").mapInArrow(encode, schema).withColumn("slab", self.slab_of())
        stored.write.partitionBy("slab").parquet(self.path)
        return self

    def chunks(self, wanted: DataFrame) -> DataFrame:
        """(keys, content) of the stored chunks among the keys of ``wanted``.

        Folders are listed first: their names, a bounded number, prune the scan, the bounds of the
        keys prune inside of them, and chunks are then matched by key.
        """
        stored = wanted.sparkSession.read.parquet(self.path)
        keys = wanted.select(*self.keys).distinct()
        slabs = keys.withColumn("slab", self.slab_of()).join(stored.select("slab").distinct(), "slab", "left_semi")
        ends = [f(k).alias(f"{k}{i}") for k in self.keys for i, f in enumerate((F.min, F.max))]
        look = slabs.agg(F.collect_set("slab").alias("names"), *ends).first()
        found = stored.where(F.col("slab").isin(look["names"]))
        if look["names"]:
            found = found.where(reduce(lambda p, q: p & q, [F.col(k).between(look[f"{k}0"], look[f"{k}1"]) for k in self.keys]))
        return found.select(*self.keys, "content").join(keys, self.keys, "left_semi")

    def sample(self, points: DataFrame, key: Sequence[str], how: str = "linear", shape: Sequence[int] | None = None) -> DataFrame:
        """(key, sample) of the stored array at points: see ``sample_store``."""
        return sample_store(points, self, key, how, shape)

    def sample_along(self, points: DataFrame, key: Sequence[str], offsets: Sequence[float], how: str = "linear") -> DataFrame:
        """(key, samples) of the stored array at offsets along n<axis> of points, in their order: see ``sample_store``."""
        return sample_store(points, self, key, how, along=offsets)


def _window_cells(keys: np.ndarray, low: np.ndarray, high: np.ndarray, size: int, chunk: np.ndarray | None, dims: int) -> Iterator[list[np.ndarray]]:
    """Columns (axes..., value, covered) of the part of a window that lies in a chunk, some cells at a time."""
    first, last = np.maximum(low, keys * size), np.minimum(high, (keys + 1) * size)
    shape = tuple((last - first).tolist())
    total = int(np.prod(shape))
    cut = None
    if chunk is not None:
        cut = chunk[tuple(slice(a, b) for a, b in zip(first - keys * size, last - keys * size))].ravel()
    for i in range(0, total, CELLS_AT_ONCE):
        flat = np.arange(i, min(total, i + CELLS_AT_ONCE))
        places = [p + o for p, o in zip(np.unravel_index(flat, shape), first)]
        value = np.full(len(flat), np.nan) if cut is None else cut[flat].astype("float64")
        yield [*places, value, np.full(len(flat), cut is not None)]


def assemble_pixels(boxes: DataFrame, chunks: DataFrame, size: int, axes: Sequence[str] = ("y", "x"), gaps: str = "flag") -> DataFrame:
    """(box_id, axes, value, covered): every cell of half-open boxes, pasted together over chunk borders.

    ``boxes`` has box_id and <axis>0, <axis>1; ``chunks`` has k<axis> and content, as
    ``ChunkStore.chunks`` returns them.  A cell of an absent chunk has no value and is not
    ``covered``; with ``gaps`` "raise" the job fails on it.  A cell without a value in its chunk is
    null, too, but covered.  Boxes that are empty along an axis have no cell.  A task holds one
    chunk and some of its cells at a time.
    """
    if gaps not in ("flag", "raise"):
        raise ValueError("gaps must be flag or raise")
    axes, dims = list(axes), len(axes)
    keys = [f"k{a}" for a in axes]
    filled = reduce(lambda a, b: a & b, [F.col(f"{a}0") < F.col(f"{a}1") for a in axes])
    touched = explode_chunks(boxes.where(filled), {a: size for a in axes})
    bounds = [f"{a}{i}" for a in axes for i in (0, 1)]
    met = touched.select("box_id", *[F.col(c).cast("bigint").alias(c) for c in (*bounds, *keys)]).join(
        chunks.select(*[F.col(k).cast("bigint").alias(k) for k in keys], "content"), keys, "left"
    )
    if gaps == "raise":
        absent = F.concat(F.lit("no chunk covers box "), F.col("box_id").cast("string"))
        met = met.withColumn("content", F.when(F.col("content").isNull(), F.raise_error(absent).cast("binary")).otherwise(F.col("content")))

    def paste(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["box_id", *axes, "value", "covered"]

        def joined(batch: pa.RecordBatch, rows: list[int], held: list[list[np.ndarray]]) -> pa.RecordBatch:
            """One batch of the cells of several windows, whose rows in ``batch`` are ``rows``."""
            box = batch.column("box_id").take(pa.array(np.repeat(rows, [len(c[-1]) for c in held])))
            columns = [np.concatenate(c) for c in zip(*held)]
            places = [pa.array(c.astype("int64")) for c in columns[:dims]]
            return pa.RecordBatch.from_arrays([box, *places, pa.array(columns[dims], from_pandas=True), pa.array(columns[-1])], names)

        for batch in batches:
            at = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
            low, high = (np.stack([batch.column(f"{a}{i}").to_numpy() for a in axes], axis=1) for i in (0, 1))
            rows, held, total, last, chunk = [], [], 0, None, None
            for r in range(len(batch)):
                # Rows of one chunk mostly follow each other; it is decoded once for them.
                content = batch.column("content")[r].as_py()
                if content != last:
                    last, chunk = content, None if content is None else _decoded(content)
                for columns in _window_cells(at[r], low[r], high[r], size, chunk, dims):
                    rows.append(r)
                    held.append(columns)
                    total += len(columns[-1])
                    if total >= CELLS_AT_ONCE:
                        yield joined(batch, rows, held)
                        rows, held, total = [], [], 0
            if rows:
                yield joined(batch, rows, held)

    kind = dict(boxes.dtypes)["box_id"]
    schema = ", ".join([f"box_id {kind}", *[f"{a} bigint" for a in axes], "value double", "covered boolean"])
    return met.mapInArrow(paste, schema)


def _corners(places: np.ndarray, how: str, shape: Sequence[int] | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(cells, weight) of each corner of points; corners beyond ``shape`` clamp to its border."""
    dims = places.shape[1]
    clamp = (lambda c: np.clip(c, 0, np.asarray(shape) - 1)) if shape is not None else (lambda c: c)
    if how == "nearest":
        yield clamp(np.rint(places).astype(np.int64)), np.ones(len(places))
        return
    base = np.floor(places)
    part = places - base
    for corner in range(1 << dims):
        on = np.array([corner >> d & 1 for d in range(dims)])
        yield clamp(base.astype(np.int64) + on), np.where(on, part, 1 - part).prod(axis=1)


def sample_store(
    points: DataFrame, store: ChunkStore, key: Sequence[str], how: str = "linear", shape: Sequence[int] | None = None,
    along: Sequence[float] = (),
) -> DataFrame:
    """(key, sample): value of a stored array at fractional p<axis> of each point.

    ``how`` is linear (bi- or trilinear) or nearest (half to even).  Cells without a value are
    zero; with ``shape`` corners clamp to the border, without it they lie outside and are zero.
    ``key`` identifies a point.  With ``along`` a point is sampled at these offsets along its
    vector n<axis>: (key, samples), an array in their order.

    A point goes to the chunks that its samples lie in, one as a rule, whatever the number of
    samples; the points of a chunk are dealt into groups of bounded size, each with a copy of the
    chunk, and tasks hold a bounded number of points.
    """
    if how not in ("linear", "nearest"):
        raise ValueError("how must be linear or nearest")
    key, axes, keys, size = list(key), list(store.axes), store.keys, store.size
    held = [*[f"p{a}" for a in axes], *([f"n{a}" for a in axes] if along else [])]
    placed = points.select(*key, *[F.col(c).cast("double").alias(c) for c in held])

    whole = F.lit(True)
    for d, a in enumerate(axes):
        p, n = F.col(f"p{a}"), F.col(f"n{a}")
        clamp = lambda c, d=d: c if shape is None else F.greatest(F.lit(0), F.least(c, F.lit(int(shape[d]) - 1)))
        # Offsets are values of an array: Spark 4.1 gave wrong ends for sums of n = 0 and literals.
        spots = F.transform(F.array(*[lit(o) for o in along]), lambda o: p + n * o) if along else F.array(p)
        low, high = F.array_min(spots), F.array_max(spots)
        ends = [F.rint(low), F.rint(high)] if how == "nearest" else [F.floor(low), F.ceil(high)]
        placed = placed.withColumn(f"_k{a}", F.sequence(*[floor_div(clamp(e.cast("bigint")), size).cast("int") for e in ends]))
        whole = whole & (F.size(f"_k{a}") == 1)
    placed = placed.withColumn("_whole", whole)
    for a in axes:
        placed = placed.withColumn(f"k{a}", F.explode(f"_k{a}")).drop(f"_k{a}")
    counts = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    # The keys are few next to points and cells; written, their size is known when they are joined.
    # A chunk gets one number: where an axis is the same for all points, Spark takes its key for a constant.
    named = counts.withColumn("blocks", F.ceil(F.col("n") / POINTS_AT_ONCE).cast("int")).withColumn("_chunk", F.monotonically_increasing_id())
    blocks = written(named, "chunk-keys")
    tasks = -(-(blocks.agg(F.sum("n")).first()[0] or 1) // POINTS_A_TASK)
    tasks = max(tasks, points.sparkSession.sparkContext.defaultParallelism)
    blocks, group = blocks.drop("n"), ["_chunk", "block"]
    dealt = placed.join(blocks, keys).withColumn("block", F.pmod(F.xxhash64(*key), F.col("blocks")).cast("int"))
    dealt = dealt.select(*key, *held, "_whole", *group).repartition(tasks, *group)
    stored = store.chunks(blocks).join(blocks, keys).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    stored = stored.select(*keys, *group, "content").repartition(tasks, *group)

    def look(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        offsets = along or (0.0,)
        sums = np.zeros((len(mine), len(offsets)))
        if len(mine) and len(theirs):
            take = lambda kind: np.stack([mine.column(f"{kind}{a}").to_numpy() for a in axes], axis=1)
            cells, start = _decoded(theirs.column("content")[0].as_py()), take("p")
            first = np.array([theirs.column(k)[0].as_py() for k in keys]) * size
            for i, offset in enumerate(offsets):
                places = start + take("n") * offset if along else start
                for at, weight in _corners(places, how, shape):
                    inside = np.flatnonzero(((at >= first) & (at < first + size)).all(axis=1) & (weight > 0))
                    sums[inside, i] += np.nan_to_num(cells[tuple((at[inside] - first).T)]) * weight[inside]
        out = mine.select([*key, "_whole"] if along else key)
        if not along:
            return out.append_column("part", pa.array(sums[:, 0]))
        ends = pa.array(np.arange(len(mine) + 1, dtype=np.int32) * len(offsets))
        return out.append_column("samples", pa.ListArray.from_arrays(ends, pa.array(sums.ravel())))

    kinds = dict(points.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in key], *(["_whole boolean", "samples array<double>"] if along else ["part double"])])
    parts = dealt.groupBy(*group).cogroup(stored.groupBy(*group)).applyInArrow(look, schema)
    if not along:
        return parts.groupBy(*key).agg(F.sum("part").alias("sample"))
    # Only points near a border of their chunk are put together.
    parts = written(parts, "samples")
    rest = parts.where("not _whole").groupBy(*key).agg(F.array(*[F.sum(F.get("samples", F.lit(i))) for i in range(len(along))]).alias("samples"))
    return parts.where("_whole").select(*key, "samples").unionAll(rest)
