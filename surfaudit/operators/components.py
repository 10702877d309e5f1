"""Connected components of general graphs and of raster masks."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from surfaudit.functions.scalar import floor_div
from surfaudit.operators.prefix import join_by
from surfaudit.session import cut_lineage

# Strides that turn coordinates into one row-major id; rasters stay below 2^31 columns and
# volumes below 2^21 rows and columns.
PLANE = {2: (1 << 31, 1), 3: (1 << 42, 1 << 21, 1)}
BLOCK = {2: 256, 3: 32}  # cells a side that one group labels


def forward_offsets(dims: int, full: bool) -> list[tuple[int, ...]]:
    """Half of the neighbour offsets: faces only, or every touching cell when ``full``."""
    steps = [o for o in product((-1, 0, 1), repeat=dims) if o > (0,) * dims]
    return [o for o in steps if full or sum(map(abs, o)) == 1]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for edges(src, dst); a component is named by its smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014): every step is a
    minimum per node, combined on the map side, and a join of the edge list with one row per
    node, which adaptive execution splits when a hub is hot.
    """
    pairs = edges.where("src <> dst").select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")
    ).distinct()
    pairs = cut_lineage(pairs)
    mark = None
    while True:
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = cut_lineage(small.unionAll(down.select("u", F.col("m").alias("v"))).distinct())
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    # Every remaining pair joins a node to the minimum of its component.
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def tile_labels(coords: np.ndarray, offsets: Sequence[tuple[int, ...]], clip: int | None = None) -> np.ndarray:
    """Component of each cell of one block, named by its first cell in the given order; ``clip`` is the side of tiles whose borders separate."""
    n = len(coords)
    lo = coords.min(axis=0)
    index = np.full(tuple(coords.max(axis=0) - lo + 3), -1, dtype=np.int64)
    at = coords - lo + 1
    index[tuple(at.T)] = np.arange(n)
    links = []
    for o in offsets:
        other = index[tuple((at + np.asarray(o)).T)]
        links.append(np.column_stack((np.flatnonzero(other >= 0), other[other >= 0])))
    a, b = np.concatenate(links).T
    if clip is not None:
        same = (coords[a] // clip == coords[b] // clip).all(axis=1)
        a, b = a[same], b[same]
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            return root
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]


def components(
    mask: DataFrame,
    full: bool = False,
    tile: int | None = None,
    by: Sequence[str] = (),
    axes: Sequence[str] = ("y", "x"),
    clip: bool = False,
) -> DataFrame:
    """Adds ``component`` to mask cells: the row-major id of the component's first cell.

    ``by`` names the surface (or volume) a cell lies on; surfaces never touch, so a component is
    (by, component), and a NULL is a surface of its own.  Cells are labelled inside blocks of
    whole tiles (a tile, or as many as fit into 256 cells a side in two dimensions and 32 in three),
    then only labels that touch across block borders enter the component graph, so small tiles
    make neither many groups nor many border cells.  With ``clip`` tiles are chunks whose borders
    separate components.  ``full`` joins diagonal neighbours too.  Coordinates outside the range
    of the ids raise.
    """
    by, axes = list(by), list(axes)
    tile = tile or BLOCK[len(axes)]
    block = tile * max(1, BLOCK[len(axes)] // tile)
    offsets = forward_offsets(len(axes), full)
    strides = PLANE[len(axes)]
    tiles = [f"_t{a}" for a in axes]
    cells = mask.select(
        *by, *[F.col(a).cast("int").alias(a) for a in axes], *[floor_div(F.col(a), block).alias(t) for a, t in zip(axes, tiles)]
    )

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(axes, ignore_index=True)
        coords = pdf[axes].to_numpy(dtype=np.int64)
        if coords.min() < 0 or any(coords[:, k].max() >= strides[k - 1] // strides[k] for k in range(1, len(axes))):
            raise ValueError(f"coordinates {axes} are beyond the range of component ids")
        first = coords[tile_labels(coords, offsets, tile if clip else None)]
        pdf["label"] = first @ np.asarray(strides, dtype=np.int64)
        return pdf[[*by, *axes, "label"]]

    types = dict(mask.dtypes)
    schema = ", ".join([*[f"{c} {types[c]}" for c in by], *[f"{a} int" for a in axes], "label bigint"])
    labelled = cells.groupBy(*by, *tiles).applyInPandas(label, schema)
    if clip:
        return labelled.withColumnRenamed("label", "component")

    labelled = cut_lineage(labelled)  # the labels are read three times below
    edge_cell = None
    for a in axes:
        rest = F.pmod(F.col(a), F.lit(block))
        hit = (rest == 0) | (rest == block - 1)
        edge_cell = hit if edge_cell is None else edge_cell | hit
    border = labelled.where(edge_cell)
    node = F.struct(*by, "label") if by else F.col("label")
    steps = F.array(*[F.array(*[F.lit(v) for v in o]) for o in offsets])
    moved = border.withColumn("_o", F.explode(steps)).select(
        *by, *[(F.col(a) + F.get("_o", F.lit(i))).alias(a) for i, a in enumerate(axes)], node.alias("src")
    )
    edges = join_by(moved, border.select(*by, *axes, node.alias("dst")), by, on=axes).where("src <> dst").select("src", "dst")
    merged = connected_components(edges)
    if by:
        merged = merged.select("node.*", F.col("component.label").alias("component"))
    else:
        merged = merged.select(F.col("node").alias("label"), "component")
    return join_by(labelled, merged, by, "left", ["label"]).select(*by, *axes, F.coalesce("component", "label").alias("component"))


def component_areas(labelled: DataFrame, by: Sequence[str] = (), area: str | None = None) -> DataFrame:
    size = F.sum(area) if area else F.count(F.lit(1))
    return labelled.groupBy(*by, "component").agg(F.count(F.lit(1)).alias("cells"), size.cast("double").alias("area"))


def component_summary(sizes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of components, largest one and its share."""
    return sizes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("components"), F.max("cells").alias("largest"), F.sum("cells").alias("cells")
    ).withColumn("largest_fraction", F.col("largest") / F.col("cells"))


def drop_small(labelled: DataFrame, minimum: int, by: Sequence[str] = ()) -> DataFrame:
    """Cells of components with at least ``minimum`` cells."""
    keep = labelled.groupBy(*by, "component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= minimum)
    return join_by(labelled, keep.select(*by, "component"), by, "left_semi", ["component"])
