"""Alignment, lookup, range and sampling joins, all as equi-joins on pixel, cell or chunk keys."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from surfaudit.functions.scalar import box_distance, box_volume, floor_div, lit
from surfaudit.operators.prefix import join_by
from surfaudit.session import cut_lineage, scratch

VOLUME_CHUNK = 32  # side of the chunks in which points of a volume are sampled
POINTS_AT_ONCE = 1 << 16  # points of a chunk that one group looks up
CHUNK = 64  # side of the chunks by which sparse looks are pruned


def align(a: DataFrame, b: DataFrame, keys=("y", "x")) -> DataFrame:
    """Pixels valid in both maps: keys, a, b."""
    left = a.where(F.col("score").isNotNull()).select(*keys, F.col("score").alias("a"))
    right = b.where(F.col("score").isNotNull()).select(*keys, F.col("score").alias("b"))
    return left.join(right, list(keys))


def shifted_join(a: DataFrame, b: DataFrame, dy: int, dx: int, by: Sequence[str] = ()) -> DataFrame:
    """Score of a at (y, x) beside that of b at (y - dy, x - dx), surface by surface; a NULL in ``by`` is one of its own."""
    moved = b.select(*by, (F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), F.col("score").alias("b"))
    return join_by(a.select(*by, "y", "x", F.col("score").alias("a")), moved, list(by), on=["y", "x"])


def shifted_views(px: DataFrame, shifts: Sequence[tuple[int, int]], by: Sequence[str] = ()) -> DataFrame:
    """Every negative-control shift of pixels(by, y, x, a, b) in one join: (by, dy, dx, y, x, a, b)."""
    by = list(by)
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in shifts])
    moved = px.select(*by, "y", "x", "b", F.explode(offsets).alias("s")).select(
        *by, "s.dy", "s.dx", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "b"
    )
    return join_by(moved, px.select(*by, "y", "x", "a"), by, on=["y", "x"]).select(*by, "dy", "dx", "y", "x", "a", "b")


def pairs(df: DataFrame, by: Sequence[str], order: str, differ: str, keep: Sequence[str], salts: int = 8) -> DataFrame:
    """Pairs (i < j) within a group whose ``differ`` values differ.

    The pair list is the result itself.  A hot group is spread over ``salts`` tasks: the left
    side is split by a hash of its order column, the right side is repeated per split.  Where
    only the number of pairs matters use the pair counts, which build none.
    """
    by = list(by)
    cols = lambda s: [F.col(c).alias(f"{c}_{s}") for c in dict.fromkeys([order, differ, *keep])]
    left = df.select(*by, F.pmod(F.xxhash64(order), F.lit(salts)).alias("_salt"), *cols("a"))
    right = df.select(
        *by, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("_salt"), *cols("b")
    )
    joined = left.join(right, [*by, "_salt"])
    return joined.where(
        (F.col(f"{order}_a") < F.col(f"{order}_b")) & (F.col(f"{differ}_a") != F.col(f"{differ}_b"))
    ).drop("_salt")


def require_match(wanted: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every wanted row with its match, and ``found`` false where there is none."""
    return wanted.join(present.withColumn("found", F.lit(True)), list(keys), "left").fillna(False, ["found"])


def with_dim(df: DataFrame, dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Dimension lookup; Spark broadcasts the dimension only when its size allows."""
    return df.join(dim, list(keys), "left")


def with_cell(px: DataFrame, grid: DataFrame, step: int) -> DataFrame:
    """Attach to each pixel the grid cell that covers it."""
    cell = px.withColumn("v", floor_div(F.col("y"), step).cast("int")).withColumn(
        "u", floor_div(F.col("x"), step).cast("int")
    )
    return cell.join(grid, ["v", "u"], "left")


# -- lattice quads: one join per sample instead of four --------------------------------------


def quads(lattice: DataFrame, value: str, height: int, width: int) -> DataFrame:
    """(v, u, q00, q01, q10, q11): each lattice point with its right and lower neighbours.

    Neighbours beyond the border clamp to the border.  One hash aggregate builds all four
    corners, so the far larger sample side joins once.
    """
    here = F.struct(F.lit(0).alias("dv"), F.lit(0).alias("du"))
    spread = lattice.select(
        "v", "u", value,
        F.explode(F.array(here, *[F.struct(F.lit(a).alias("dv"), F.lit(b).alias("du")) for a, b in ((0, 1), (1, 0), (1, 1))])).alias("o"),
    ).select((F.col("v") - F.col("o.dv")).alias("v"), (F.col("u") - F.col("o.du")).alias("u"), "o.*", value)
    corner = lambda a, b: F.max(F.when((F.col("dv") == a) & (F.col("du") == b), F.col(value)))
    wide = spread.where("v >= 0 and u >= 0").groupBy("v", "u").agg(
        corner(0, 0).alias("q00"), corner(0, 1).alias("q01"), corner(1, 0).alias("q10"), corner(1, 1).alias("q11")
    )
    last_v, last_u = F.col("v") >= height - 1, F.col("u") >= width - 1
    return wide.select(
        "v", "u", "q00",
        F.when(last_u, F.col("q00")).otherwise(F.col("q01")).alias("q01"),
        F.when(last_v, F.col("q00")).otherwise(F.col("q10")).alias("q10"),
        F.when(last_u & last_v, F.col("q00"))
        .when(last_u, F.col("q10"))
        .when(last_v, F.col("q01"))
        .otherwise(F.col("q11")).alias("q11"),
    )


def _clamp(c: Column, n: int) -> Column:
    return F.greatest(F.lit(0), F.least(c, F.lit(n - 1))).cast("int")


def chunks_wanted(cells: DataFrame, wanted: DataFrame, axes: Sequence[str], size: int = CHUNK) -> DataFrame:
    """Those ``cells`` that lie in a chunk with a wanted cell, for a sparse look into a large array.

    Chunk keys are few next to cells.  They are written first, so that Spark knows their size: it
    broadcasts them where they are small and cuts the array down while it is scanned, and joins by
    chunk where they are not.  An array in a ``ChunkStore`` is read by chunk from the start.
    """
    at = lambda: [floor_div(F.col(a), size).alias(f"_k{a}") for a in axes]
    folder = scratch(cells.sparkSession, "chunk-keys")
    wanted.select(*at()).distinct().write.parquet(folder)
    names = [f"_k{a}" for a in axes]
    keys = cells.sparkSession.read.parquet(folder)
    return cells.select("*", *at()).join(keys, names, "left_semi").drop(*names)


def sample_support(
    px: DataFrame, lattice: DataFrame, canvas: tuple[int, int], shape: tuple[int, int]
) -> DataFrame:
    """Support of each canvas pixel at half-pixel centres: nearest, all and any of its corners.

    ``lattice`` is (v, u, ok).  Flags travel as 0/1 through the quad table.
    """
    gy = (F.col("y") + lit(0.5)) * lit(shape[0]) / lit(canvas[0]) - lit(0.5)
    gx = (F.col("x") + lit(0.5)) * lit(shape[1]) / lit(canvas[1]) - lit(0.5)
    table = quads(lattice.withColumn("ok", F.col("ok").cast("int")), "ok", *shape)
    placed = px.select(
        "*",
        _clamp(F.floor(gy), shape[0]).alias("v"), _clamp(F.floor(gx), shape[1]).alias("u"),
        _clamp(F.ceil(gy), shape[0]).alias("_v1"), _clamp(F.ceil(gx), shape[1]).alias("_u1"),
        _clamp(F.rint(gy), shape[0]).alias("_vn"), _clamp(F.rint(gx), shape[1]).alias("_un"),
    ).join(table, ["v", "u"], "left")
    q = {k: F.coalesce(F.col(k), F.lit(0)) for k in ("q00", "q01", "q10", "q11")}
    down, right = F.col("_v1") > F.col("v"), F.col("_u1") > F.col("u")
    corners = [
        q["q00"],
        F.when(right, q["q01"]).otherwise(q["q00"]),
        F.when(down, q["q10"]).otherwise(q["q00"]),
        F.when(down & right, q["q11"]).when(down, q["q10"]).when(right, q["q01"]).otherwise(q["q00"]),
    ]
    near_v, near_u = F.col("_vn") > F.col("v"), F.col("_un") > F.col("u")
    nearest = (
        F.when(near_v & near_u, q["q11"]).when(near_v, q["q10"]).when(near_u, q["q01"]).otherwise(q["q00"])
    )
    return placed.select(
        *px.columns,
        (nearest > 0).alias("nearest"),
        (F.least(*corners) > 0).alias("all"),
        (F.greatest(*corners) > 0).alias("any"),
    )


def sample_bilinear(points: DataFrame, image: DataFrame, shape: tuple[int, int], value: str = "score") -> DataFrame:
    """Bilinear value at fractional (fy, fx) with clamped corners; the image is (y, x, value).

    Only the chunks of the image that hold a corner are read into quads.
    """
    lattice = image.select(F.col("y").alias("v"), F.col("x").alias("u"), F.col(value).alias("_val"))
    fy, fx = F.col("fy"), F.col("fx")
    wy, wx = fy - F.floor(fy), fx - F.floor(fx)
    placed = points.withColumn("v", _clamp(F.floor(fy), shape[0])).withColumn("u", _clamp(F.floor(fx), shape[1]))
    reach = lambda c: F.explode(F.array(F.col(c), F.col(c) + 1)).alias(c)
    corners = placed.select("v", "u").distinct().select(reach("v"), "u").select("v", reach("u"))
    table = quads(chunks_wanted(lattice, corners, ["v", "u"]), "_val", *shape)
    # Left of the first pixel both corners clamp to it.
    q = lambda a, b: F.coalesce(
        F.when((fy < 0) & (fx < 0), F.col("q00")).when(fy < 0, F.col(f"q0{b}")).when(fx < 0, F.col(f"q{a}0")).otherwise(F.col(f"q{a}{b}")),
        lit(0),
    )
    blended = (
        q(0, 0) * (1 - wy) * (1 - wx) + q(0, 1) * (1 - wy) * wx + q(1, 0) * wy * (1 - wx) + q(1, 1) * wy * wx
    )
    return placed.join(table, ["v", "u"], "left").select(*points.columns, blended.alias("sample"))


class VoxelReader(Protocol):
    """A user's way to a volume: values at points, absent voxels zero; ``ChunkStore`` is one."""

    def sample(self, points: DataFrame, key: Sequence[str], how: str) -> DataFrame: ...


def sample_volume(
    points: DataFrame, vox: DataFrame | VoxelReader, key: Sequence[str], how: str = "trilinear", along: Sequence[float] = ()
) -> DataFrame:
    """(key, sample): value of a sparse volume at fractional (pz, py, px); absent voxels are zero.

    ``vox`` is a table (z, y, x, v) or a reader.  ``key`` identifies a point.  With ``along`` each
    point is sampled at these offsets along its unit vector (nz, ny, nx): (key, offset, sample).

    A point goes once to the chunk of the volume it lies in, which has a border as wide as its
    samples reach, so neither corners nor offsets are shuffled.  The points of a chunk are dealt
    into groups of bounded size; chunks without a point are left out while the volume is scanned.
    """
    axes = ("z", "y", "x")
    if along and (how == "nearest" or not isinstance(vox, DataFrame)):
        moved = points.withColumn("offset", F.explode(F.array(*[lit(o) for o in along])))
        moved = moved.select(*key, "offset", *[(F.col(f"p{a}") + F.col(f"n{a}") * F.col("offset")).alias(f"p{a}") for a in axes])
        return sample_volume(moved, vox, [*key, "offset"], how)
    if not isinstance(vox, DataFrame):
        return vox.sample(points, key, "nearest" if how == "nearest" else "linear")
    if how == "nearest":
        at = points.select(*key, *[F.rint(f"p{a}").cast("int").alias(a) for a in axes])
        return at.join(chunks_wanted(vox.select(*axes, "v"), at, axes), list(axes), "left").select(
            *key, F.coalesce(F.col("v").cast("double"), lit(0)).alias("sample")
        )
    key, names = list(key), [f"_k{a}" for a in axes]
    reach = math.ceil(max(map(abs, along), default=0))
    held = [*[f"p{a}" for a in axes], *([f"n{a}" for a in axes] if along else [])]
    home = [floor_div(F.floor(f"p{a}"), VOLUME_CHUNK).alias(n) for a, n in zip(axes, names)]
    known = reduce(lambda p, q: p & q, [F.col(c).isNotNull() for c in held])
    placed = points.where(known).select(*key, *[F.col(c).cast("double").alias(c) for c in held], *home)
    counts = placed.groupBy(*names).agg(F.ceil(F.count(F.lit(1)) / POINTS_AT_ONCE).cast("int").alias("_blocks"))
    # Few next to points and voxels; written, so that their size and numbers are fixed.
    blocks = written(counts.withColumn("_chunk", F.monotonically_increasing_id()), "chunk-keys")
    deal = F.pmod(F.xxhash64(*key), F.col("_blocks")).cast("int").alias("_block")
    dealt = placed.join(blocks, names).select(*key, *held, "_chunk", deal)
    cells = vox.where("v is not null").select(*[F.col(a).cast("bigint").alias(a) for a in axes], F.col("v").cast("double").alias("v"))
    for a, n in zip(axes, names):
        chunk, last = floor_div(F.col(a), VOLUME_CHUNK), floor_div(F.col(a) - reach - 1, VOLUME_CHUNK)
        cells = cells.withColumn(n, F.explode(F.sequence(last, floor_div(F.col(a) + reach, VOLUME_CHUNK))))
    cells = cells.join(blocks, names).select(
        F.col("_chunk").alias("_chunk"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"),
        *[(F.col(a) - F.col(n) * VOLUME_CHUNK + reach).cast("int").alias(a) for a, n in zip(axes, names)], "v",
    )
    look = _sampler(key, reach, along)
    kinds = dict(points.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in key], *(["offset double"] if along else []), "sample double"])
    group = ["_chunk", "_block"]
    return dealt.groupBy(*group).cogroup(cells.groupBy(*group)).applyInArrow(look, schema)


def _sampler(key: list[str], reach: int, along: Sequence[float]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Trilinear samples of the points of one chunk, from its cells, counted from ``reach`` before the chunk."""
    side = VOLUME_CHUNK + 2 * reach + 1

    def look(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        take = lambda t, names: np.stack([t.column(n).to_numpy() for n in names], axis=1)
        dense = np.zeros(side**3)
        if len(theirs):
            np.add.at(dense, take(theirs, "zyx").astype(np.int64) @ [side * side, side, 1], theirs.column("v").to_numpy())
        start = take(mine, ("pz", "py", "px"))
        # NaN lies in chunk 0, as its floor does, and has the sample NaN.
        first = np.floor(np.nan_to_num(start[:1])) // VOLUME_CHUNK * VOLUME_CHUNK - reach
        sums = []
        for offset in along or (0.0,):
            places = start + take(mine, ("nz", "ny", "nx")) * offset if along else start
            base = np.floor(places)
            part, low = places - base, np.nan_to_num(base - first).astype(np.int64)
            total = np.where(np.isnan(places).any(axis=1), np.nan, 0.0)
            for corner in range(8):
                on = np.array([corner & 1, corner >> 1 & 1, corner >> 2 & 1])
                weight = np.where(on, part, 1 - part).prod(axis=1)
                used = np.flatnonzero(weight > 0)  # a corner of weight zero is not read
                total[used] += weight[used] * dense[(low[used] + on) @ [side * side, side, 1]]
            sums.append(total)
        out = pa.concat_tables([mine.select(key)] * len(sums)) if sums else mine.select(key)
        if along:
            out = out.append_column("offset", pa.array(np.repeat(np.array(along, dtype="float64"), len(mine))))
        return out.append_column("sample", pa.array(np.concatenate(sums)))

    return look


def resample_mask(mask: DataFrame, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """Mask on another canvas by area: (y, x, center, any, all) for every target cell.

    Each source pixel is sent to the target cells whose rectangle covers it, so empty target
    cells cost nothing until the final left join with the canvas.
    """
    def reach(axis: str, s: int, t: int):
        # Target i covers [floor(i s / t), ceil((i + 1) s / t)).
        p = F.col(axis).cast("double")
        lo = F.floor(p * t / lit(s)) - 1
        hi = F.ceil((p + 1) * t / lit(s))
        return F.filter(
            F.sequence(F.greatest(lo, F.lit(0)), F.least(hi, F.lit(t - 1))),
            lambda i: (F.floor(i * lit(s) / lit(t)) <= p) & (F.ceil((i + 1) * lit(s) / lit(t)) > p),
        )

    hits = mask.select("y", "x", F.explode(reach("y", source[0], target[0])).alias("ty")).select(
        "y", "x", "ty", F.explode(reach("x", source[1], target[1])).alias("tx")
    )
    mid = lambda i, s, t: F.least(F.floor((i + lit(0.5)) * lit(s) / lit(t)), F.lit(s - 1))
    counts = hits.groupBy("ty", "tx").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or((F.col("y") == mid(F.col("ty"), source[0], target[0])) & (F.col("x") == mid(F.col("tx"), source[1], target[1]))).alias("center"),
    )
    span = lambda i, s, t: F.ceil((F.col(i) + 1) * lit(s) / lit(t)) - F.floor(F.col(i) * lit(s) / lit(t))
    canvas = mask.sparkSession.range(target[0]).select(
        F.col("id").alias("ty"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(target[1] - 1).cast("bigint"))).alias("tx")
    )
    return canvas.join(counts, ["ty", "tx"], "left").select(
        F.col("ty").alias("y"), F.col("tx").alias("x"),
        F.coalesce("center", F.lit(False)).alias("center"),
        (F.coalesce("n", F.lit(0)) > 0).alias("any"),
        (F.coalesce("n", F.lit(0)) == span("ty", source[0], target[0]) * span("tx", source[1], target[1])).alias("all"),
    )


# -- boxes and chunks -----------------------------------------------------------------------


def explode_chunks(boxes: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """One row per box and touched chunk, with chunk keys k<axis>."""
    out = boxes
    for a, s in sizes.items():
        span = F.sequence(floor_div(F.col(f"{a}0"), s), floor_div(F.col(f"{a}1") - 1, s))
        out = out.withColumn(f"k{a}", F.explode(span))
    return out


def chunk_cover(boxes: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Distinct chunk keys touched by half-open boxes."""
    return explode_chunks(boxes, sizes).select(*[f"k{a}" for a in sizes]).distinct()


def _overlap(lo: Column, hi: Column, key: Column, size: int) -> Column:
    return F.greatest(F.lit(0), F.least(hi, (key + 1) * size) - F.greatest(lo, key * size))


def overlap_fraction(boxes: DataFrame, size: int) -> DataFrame:
    """Covered share of each touched chunk; exact while the boxes do not overlap."""
    touched = explode_chunks(boxes, {"y": size, "x": size})
    area = _overlap(F.col("y0"), F.col("y1"), F.col("ky"), size) * _overlap(F.col("x0"), F.col("x1"), F.col("kx"), size)
    return touched.groupBy("ky", "kx").agg(
        F.count(F.lit(1)).alias("boxes"), (F.sum(area) / lit(size * size)).alias("covered")
    )


def overlapping_cells(boxes: DataFrame, size: int = 32) -> DataFrame:
    """Chunk rows where boxes overlap: covered length exceeds distinct covered pixels.

    Each box row becomes a bit mask of at most 32 pixels, so overlap shows as a difference of
    two partial aggregates and no pair of boxes is built.
    """
    if size > 32:
        raise ValueError("chunk rows must fit a 32-bit mask")
    lines = explode_chunks(boxes, {"y": size, "x": size}).select(
        "kx",
        F.explode(
            F.sequence(
                F.greatest(F.col("y0"), F.col("ky") * size), F.least(F.col("y1"), (F.col("ky") + 1) * size) - 1
            )
        ).alias("y"),
        F.greatest(F.col("x0") - F.col("kx") * size, F.lit(0)).cast("int").alias("a"),
        F.least(F.col("x1") - F.col("kx") * size, F.lit(size)).cast("int").alias("b"),
    )
    ones = lambda n: F.expr(f"shiftleft(1L, {n}) - 1L")
    return (
        lines.withColumn("bits", ones("b") - ones("a"))
        .groupBy("y", "kx")
        .agg(F.sum(F.col("b") - F.col("a")).alias("length"), F.bit_count(F.bit_or("bits")).alias("distinct_px"))
        .where(F.col("length") > F.col("distinct_px"))
    )


def assemble_window(boxes: DataFrame, chunks: DataFrame, size: int) -> DataFrame:
    """Pixels of each box that stored chunks (ky, kx) supply, and whether they cover it."""
    touched = explode_chunks(boxes, {"y": size, "x": size})
    area = _overlap(F.col("y0"), F.col("y1"), F.col("ky"), size) * _overlap(F.col("x0"), F.col("x1"), F.col("kx"), size)
    have = touched.withColumn("_a", area).join(chunks.withColumn("_has", F.lit(True)), ["ky", "kx"], "left")
    return have.groupBy("box_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if("_has").alias("present"),
        F.sum("_a").alias("area"), F.coalesce(F.sum(F.when(F.col("_has"), F.col("_a"))), F.lit(0)).alias("supplied"),
    ).withColumn("complete", F.col("area") == F.col("supplied"))


def pair_uv(
    source: DataFrame, target: DataFrame, source_shape: tuple[int, int], target_shape: tuple[int, int], stride: int
) -> DataFrame:
    """Strided vertex correspondence between two grids, rounded so that end points meet."""
    to = lambda c, s, t: F.rint(F.col(c) * lit(t - 1) / lit(s - 1)).cast("int")
    picked = source.where((F.col("v") % stride == 0) & (F.col("u") % stride == 0)).select(
        "v", "u",
        to("v", source_shape[0], target_shape[0]).alias("tv"),
        to("u", source_shape[1], target_shape[1]).alias("tu"),
        *[F.col(c).alias(f"s{c}") for c in "xyz"],
    )
    return picked.join(
        target.select(F.col("v").alias("tv"), F.col("u").alias("tu"), *[F.col(c).alias(f"t{c}") for c in "xyz"]),
        ["tv", "tu"],
    )


def _contenders(rated: DataFrame, cells: Sequence[str], k: int) -> DataFrame:
    """Boxes per cell that may be among the k nearest of some point of the cell.

    k boxes have a largest distance of at most D to any point of the cell; a box whose smallest
    distance exceeds D cannot matter, and of those that contain the cell only the k first do.
    """
    from surfaudit.operators.windows import rank_within

    order = F.struct("_max", "_vol", "box_id")
    top = rank_within(rated, cells, ["_max", "_vol", "box_id"], k)
    limit = top.groupBy(*cells).agg(F.max(order).alias("_last"), F.count(F.lit(1)).alias("_n"))
    keep = (
        (F.col("_n") < k) | (order <= F.col("_last")) | ((F.col("_max") > 0) & (F.col("_min") <= F.col("_last._max")))
    )
    return rated.join(limit, list(cells)).where(keep).drop("_min", "_max", "_last", "_n")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of its own below the checkpoint folder, of known size."""
    folder = scratch(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def nearest_boxes(points: DataFrame, boxes: DataFrame, axes: Sequence[str], k: int, side: float) -> DataFrame:
    """The k nearest boxes of every point, ties by smaller volume and then by id.

    Points are held in cells of the given side.  A round looks for boxes within a radius of
    each cell that still has open points: cells and boxes meet on a grid of that radius, a cell
    drops every box that k others beat for all of its points, and only then do points and boxes
    meet.  A point with k boxes within the radius is finished; the rest go on with four times
    the radius until it spans everything.  Points at one place have the same boxes, so places are
    looked up in their stead, and of boxes with equal bounds the k first by id are enough.
    """
    from surfaudit.operators.windows import rank_within

    axes = list(axes)
    lo, hi = [F.col(f"{a}0") for a in axes], [F.col(f"{a}1") for a in axes]
    spans = boxes.agg(*[F.min(f"{a}0").alias(f"l{a}") for a in axes], *[F.max(f"{a}1").alias(f"h{a}") for a in axes]).first()
    reach = points.agg(*[F.min(a).alias(f"l{a}") for a in axes], *[F.max(a).alias(f"h{a}") for a in axes]).first()
    if spans[0] is None or reach[0] is None:
        raise ValueError("points and boxes must not be empty")
    diameter = sum((max(spans[f"h{a}"], reach[f"h{a}"]) - min(spans[f"l{a}"], reach[f"l{a}"])) ** 2 for a in axes) ** 0.5
    cells, coarse = [f"_k{a}" for a in axes], [f"_r{a}" for a in axes]
    norm = lambda parts: F.sqrt(reduce(lambda t, p: t + p * p, parts, lit(0)))
    start = {a: F.col(f"_k{a}") * lit(side) for a in axes}
    stop = {a: (F.col(f"_k{a}") + 1) * lit(side) for a in axes}
    least = norm([F.greatest(F.col(f"{a}0") - stop[a], start[a] - F.col(f"{a}1"), lit(0)) for a in axes])
    most = norm([F.greatest(F.col(f"{a}0") - start[a], stop[a] - F.col(f"{a}1"), lit(0)) for a in axes])

    bounds = [f"{a}{i}" for a in axes for i in (0, 1)]
    distinct = rank_within(boxes.select("box_id", *bounds), bounds, ["box_id"], k).drop("rank")
    places = points.select(*axes).distinct().select(*axes, *[floor_div(F.col(a), side).alias(c) for a, c in zip(axes, cells)])
    # Written, so that their size is known when they are joined.
    open_points, boxes = written(places, "places"), written(distinct.withColumn("_vol", box_volume(lo, hi)), "boxes")
    radius, done = side, []
    while True:
        # A box lies on the grid whose cells are as wide as itself, so it covers a few of them
        # whatever its extent; a cell of points looks on each grid that holds boxes.
        extent = F.greatest(*[b - a for a, b in zip(lo, hi)], lit(radius))
        level = F.ceil(F.log2(extent / lit(radius)) - lit(1e-9)).cast("int")
        sized = boxes.withColumn("_level", level)
        levels = [r[0] for r in sized.select("_level").distinct().collect()]  # powers of two: some dozens at most
        width = lit(radius) * F.pow(lit(2), F.col("_level"))
        held = open_points.select(*cells).distinct().withColumn("_level", F.explode(F.array(*[F.lit(v) for v in levels]))).select(
            *cells, "_level", *[F.floor(start[a] / width).cast("bigint").alias(r) for a, r in zip(axes, coarse)]
        )
        wide = sized
        for a, r in zip(axes, coarse):
            # A cell starts at most radius + side before the box and radius after it.
            near = F.sequence(
                F.floor((F.col(f"{a}0") - lit(radius + side)) / width).cast("bigint"), F.floor((F.col(f"{a}1") + lit(radius)) / width).cast("bigint")
            )
            wide = wide.withColumn(r, F.explode(near))
        rated = held.join(wide, [*coarse, "_level"]).drop(*coarse, "_level").withColumn("_min", least).withColumn("_max", most).where(
            F.col("_min") <= lit(radius)
        )
        met = open_points.join(_contenders(rated, cells, k), cells).withColumn(
            "distance", box_distance([F.col(a) for a in axes], lo, hi)
        ).where(F.col("distance") <= lit(radius))
        best = written(rank_within(met, axes, ["distance", "_vol", "box_id"], k).select(
            *axes, "box_id", "distance", F.col("_vol").alias("volume"), "rank"
        ), "nearest")
        if radius >= diameter:
            done.append(best)
            break
        full = best.where(F.col("rank") == k).select(*axes)
        done.append(best.join(full, axes, "left_semi"))
        open_points = written(open_points.join(full, axes, "left_anti"), "places")
        if open_points.isEmpty():
            break
        radius *= 4
    # The points are the long side: they are never broadcast, whatever their file is taken for.
    held = points.select("point_id", *axes).hint("merge")
    return held.join(reduce(DataFrame.unionByName, done), axes).select("point_id", "box_id", "distance", "volume", "rank")


def validate_reviews(queue: DataFrame, reviews: DataFrame, key: str, options: Sequence[str]) -> DataFrame:
    """Violations (key, problem): gaps, strangers, repeats and values outside their range."""
    seen = reviews.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    both = queue.select(key).distinct().withColumn("_q", F.lit(True)).join(seen, key, "full")
    keys = both.select(
        key,
        F.when(F.col("n").isNull(), "not_reviewed").when(F.col("_q").isNull(), "not_queued").when(F.col("n") > 1, "repeated").alias("problem"),
    )
    checks = F.filter(
        F.array(
            F.when(~F.col("response").isin(*options), "invalid_response"),
            F.when(~F.coalesce(F.col("confidence").between(1, 5), F.lit(False)), "invalid_confidence"),
            F.when(~F.coalesce(F.col("seconds") >= 0, F.lit(False)), "invalid_seconds"),
        ),
        lambda c: c.isNotNull(),
    )
    rows = reviews.select(key, F.explode(checks).alias("problem"))
    return keys.where("problem is not null").unionByName(rows).groupBy(key, "problem").agg(
        F.count(F.lit(1)).alias("times")
    )
