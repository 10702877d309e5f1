"""Folds, differences, smoothing and window search over ordered rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from surfaudit.functions.scalar import floor_div, lit
from surfaudit.operators.prefix import dense_index, join_by


def fold_of(idx: Column, n: Column, k: int) -> Column:
    """Contiguous split of n ordered keys into k folds; the first n mod k folds get one extra."""
    size, extra = F.floor(n / lit(k)), n % F.lit(k)
    head = extra * (size + 1)
    return F.when(idx < head, F.floor(idx / (size + 1))).otherwise(
        extra + F.floor(F.try_divide(idx - head, size))
    ).cast("bigint")


def contiguous_folds(df: DataFrame, key: str, k: int) -> DataFrame:
    """(key, fold) over the distinct keys; k must not exceed their number."""
    return dense_index(df, key).select(key, fold_of(F.col("idx"), F.col("n_keys"), k).alias("fold"))


TILE = 256  # cells a side of the tiles that window sums are made in
SEGMENT = 1024  # cells of a raster line that one window holds


def _segmented(df: DataFrame, along: str, size: int, before: int, after: int) -> DataFrame:
    """Adds ``_seg`` (and ``_own``): each cell once in its segment, and in the segments next to it
    whose last ``before`` or next ``after`` cells reach it."""
    own, place = floor_div(F.col(along), size), F.pmod(F.col(along), F.lit(size))
    reach = F.array_compact(F.array(own, F.when(place < after, own - 1), F.when(place >= size - before, own + 1)))
    return df.withColumn("_own", own).withColumn("_seg", F.explode(reach))


def central_diff(
    grid: DataFrame, col: str | Sequence[str], along: str, across: str, half: bool = False, alias: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Central difference of one or more columns along one axis; ``alias`` names the result, ``{}`` in it is the column.

    Inside it is next - previous, at an edge twice the one-sided difference; ``half`` halves
    both, which is the usual numerical gradient.  A missing cell is an edge to its neighbours,
    and a cell without any neighbour has no difference.  A window is one segment of a line with
    one cell of its neighbours, so no long line is sorted in one task.
    """
    w = W.partitionBy(*by, across, "_seg").orderBy(along)
    cells = _segmented(grid, along, SEGMENT, 1, 1)
    before, after = (F.lag(along).over(w) == F.col(along) - 1), (F.lead(along).over(w) == F.col(along) + 1)
    out = cells
    for c in [col] if isinstance(col, str) else col:
        here, prev, nxt = F.col(c), F.when(before, F.lag(c).over(w)), F.when(after, F.lead(c).over(w))
        diff = (
            F.when(prev.isNull(), (nxt - here) * lit(2))
            .when(nxt.isNull(), (here - prev) * lit(2))
            .otherwise(nxt - prev)
        )
        out = out.withColumn((alias or "d{}").format(c), diff / lit(2) if half else diff)
    return out.where("_seg = _own").drop("_seg", "_own")


def smooth_first_min(df: DataFrame, by: Sequence[str], order: str, col: str) -> DataFrame:
    """Order value of the first local minimum of the 3-tap mean (zero padded), else its argmin.

    A partition is one probe (a fixed number of steps).
    """
    w = W.partitionBy(*by).orderBy(order)
    zero = lit(0)
    smooth = df.withColumn(
        "smooth",
        (F.coalesce(F.lag(col).over(w), zero) + F.col(col) + F.coalesce(F.lead(col).over(w), zero)) / lit(3),
    )
    s, p, n = F.round("smooth", 9), F.round(F.lag("smooth").over(w), 9), F.round(F.lead("smooth").over(w), 9)
    marked = smooth.withColumn("local", p.isNotNull() & n.isNotNull() & (s <= p) & (s <= n))
    return marked.groupBy(*by).agg(
        F.coalesce(
            F.min(F.when(F.col("local"), F.col(order))),
            F.min_by(order, F.struct(F.round("smooth", 9), F.col(order))),
        ).alias("gap"),
        F.min("smooth").alias("smooth_min"),
    )


def window_sums(mask: DataFrame, height: int, width: int, k: int, empty: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Mask pixels inside every k x k window of each surface, keyed by its top-left corner: (by, y, x, total).

    A stored pixel goes to the tiles in which windows over it start, four at most, and a tile has a
    summed-area table of its own cells and the k - 1 beyond; no canvas is laid out.  A task holds
    one tile of max(TILE, k) cells a side.  Repeated pixels count each; pixels off the canvas do
    not.  With ``empty`` windows far from any pixel are there too, with zero.
    """
    by, side, down, across = list(by), max(TILE, k), height - k + 1, width - k + 1
    kinds = dict(mask.dtypes)
    on = F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)
    cells = mask.where(on).groupBy(*by, "y", "x").agg(F.count(F.lit(1)).alias("n"))
    for a, t in (("y", "ty"), ("x", "tx")):
        starts = F.array_distinct(F.array(*[floor_div(F.greatest(F.col(a) - d, F.lit(0)), side).cast("int") for d in (0, k - 1)]))
        cells = cells.withColumn(t, F.explode(starts))

    def table(group: pa.Table) -> pa.Table:
        y0, x0 = (group.column(t)[0].as_py() * side for t in ("ty", "tx"))
        h, w = min(side, down - y0), min(side, across - x0)
        if h <= 0 or w <= 0:
            places = pa.table({c: pa.array([], t) for c, t in (("y", pa.int32()), ("x", pa.int32()), ("total", pa.int64()))})
            return pa.table([*[group.column(c).slice(0, 0) for c in by], *places.columns], names=[*by, *places.column_names])
        sums = np.zeros((h + k, w + k), dtype=np.int64)
        y, x = (group.column(c).to_numpy() - o for c, o in (("y", y0), ("x", x0)))
        inside = (y < h + k - 1) & (x < w + k - 1)
        np.add.at(sums, (y[inside] + 1, x[inside] + 1), group.column("n").to_numpy()[inside])
        sums = sums.cumsum(axis=0).cumsum(axis=1)
        total = sums[k:, k:] - sums[:-k, k:] - sums[k:, :-k] + sums[:-k, :-k]
        at = np.indices(total.shape)
        surface = [group.column(c).take(pa.array(np.zeros(total.size, dtype=np.int64))) for c in by]
        places = [pa.array((at[0] + y0).ravel().astype("int32")), pa.array((at[1] + x0).ravel().astype("int32")), pa.array(total.ravel())]
        return pa.table([*surface, *places], names=[*by, "y", "x", "total"])

    schema = ", ".join([*[f"{c} {kinds[c]}" for c in by], "y int", "x int", "total bigint"])
    found = cells.groupBy(*by, "ty", "tx").applyInArrow(table, schema)
    if not empty or down <= 0 or across <= 0:
        return found
    rows, columns = -(-down // side), -(-across // side)
    surfaces = cells.select(*by).distinct() if by else mask.sparkSession.range(1).select()
    tiles = surfaces.withColumn("id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(rows * columns - 1).cast("bigint")))).select(
        *by, F.floor(F.col("id") / columns).cast("int").alias("ty"), (F.col("id") % columns).cast("int").alias("tx")
    )
    bare = join_by(tiles, cells.select(*by, "ty", "tx").distinct(), by, "left_anti", ["ty", "tx"])
    place = lambda t, n: F.explode(F.sequence(F.col(t) * side, F.least(F.col(t) * side + side, F.lit(n)) - 1))
    bare = bare.withColumn("y", place("ty", down)).withColumn("x", place("tx", across))
    return found.unionAll(bare.select(*by, "y", "x", F.lit(0).cast("bigint").alias("total")))


def densest_window(mask: DataFrame, height: int, width: int, k: int, by: Sequence[str] = ()) -> DataFrame:
    """The fullest k x k window of each surface, the first in row-major order on a tie; only windows near a pixel are looked at.

    Of an empty mask it is the first window of all; a canvas smaller than a window has none.  With
    ``by`` a surface without pixels is not there.
    """
    best = F.max(F.struct("total", (-F.col("y")).alias("y"), (-F.col("x")).alias("x")))
    first = F.when(F.lit(k <= min(height, width)), F.lit(0))
    return window_sums(mask, height, width, k, False, by).where("total > 0").groupBy(*by).agg(best.alias("b")).select(
        *by, F.coalesce(-F.col("b.y"), first).alias("y"), F.coalesce(-F.col("b.x"), first).alias("x"), F.coalesce("b.total", first.cast("bigint")).alias("total")
    )


def rank_within(df: DataFrame, by: Sequence[str], order: Sequence, k: int) -> DataFrame:
    """The first k rows of each group; the rank filter is pushed below the shuffle."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
