"""Surface-grid geometry: stencils, continuity, topology, pixel area, registration."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from surfaudit.functions.scalar import floor_div, lit, vertex_valid
from surfaudit.operators.prefix import exact_quantiles, join_by
from surfaudit.operators.windows import central_diff
from surfaudit.session import cut_lineage

AXES = ("x", "y", "z")
CORNERS = ((0, 0), (0, 1), (1, 0), (1, 1))
TILE = 256  # lattice points a side that a task looks at together


def stencil(points: DataFrame, values: Sequence[str], corners=CORNERS, by: Sequence[str] = ()) -> DataFrame:
    """(by, v, u, <value>_<dv><du>): each lattice point with its right, lower and diagonal neighbours on its surface.

    A point goes to its tile once, and from a tile's edge to the neighbour that looks at it; corners are
    looked up in the task.  A missing neighbour leaves NULLs; of points at one place each value is the largest.
    """
    by, values, kinds = list(by), list(values), dict(points.dtypes)
    reach = F.array(*[F.struct(floor_div(F.col("v") - a, TILE).alias("tv"), floor_div(F.col("u") - b, TILE).alias("tu")) for a, b in corners])
    dealt = points.where("v is not null and u is not null").select(*by, "v", "u", *values, F.explode(F.array_distinct(reach)).alias("_t")).select(*by, "v", "u", *values, "_t.*")
    high, wide = (max(o[k] for o in corners) + TILE for k in (0, 1))

    def look(group: pa.Table) -> pa.Table:
        tv, tu, v, u = (group.column(c).to_numpy().astype(np.int64) for c in ("tv", "tu", "v", "u"))
        v0, u0 = int(tv[0]) * TILE, int(tu[0]) * TILE
        cell = (v - v0) * wide + (u - u0)
        inside = np.flatnonzero((v >= v0) & (v < v0 + high) & (u >= u0) & (u < u0 + wide))
        repeated = len(np.unique(cell[inside])) < len(inside)
        at = {}
        for c in values if repeated else values[:1]:
            held = group.column(c).combine_chunks()
            order = inside
            if repeated:  # the last to be put to a cell stays: NULL before all numbers, NaN after them
                number = held.fill_null(0).to_numpy(zero_copy_only=False)[inside]
                order = inside[np.lexsort((number, held.is_valid().to_numpy(zero_copy_only=False)[inside]))]
            at[c] = np.full(high * wide, -1, dtype=np.int64)
            at[c][cell[order]] = order
        whole = {c: at.get(c, at[values[0]]).reshape(high, wide) for c in values}
        seen = lambda c, a, b: whole[c][a : a + TILE, b : b + TILE]
        some = np.zeros((TILE, TILE), dtype=bool)
        for a, b in corners:
            some |= seen(values[0], a, b) >= 0
        y, x = np.nonzero(some)
        out = {c: group.column(c).take(pa.array(np.zeros(len(y), dtype=np.int64))) for c in by}
        for c, place in (("v", y + v0), ("u", x + u0)):
            out[c] = pa.array(place).cast(group.schema.field(c).type)
        for c in values:
            for a, b in corners:
                rows = seen(c, a, b)[y, x]
                out[f"{c}_{a}{b}"] = group.column(c).take(pa.array(rows, mask=rows < 0))
        return pa.table(out)

    names = [(c, f"{c}_{a}{b}") for c in values for a, b in corners]
    schema = ", ".join(f"`{n}` {kinds[c]}" for c, n in [*[(c, c) for c in [*by, "v", "u"]], *names])
    return dealt.groupBy(*by, "tv", "tu").applyInArrow(look, schema)


def valid_vertices(grid: DataFrame, mode: str) -> DataFrame:
    return grid.where(vertex_valid(F.col("x"), F.col("y"), F.col("z"), mode))


def length(d: Sequence[Column]) -> Column:
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def cross(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _edge(corner: str) -> list[Column]:
    return [F.col(f"{c}_{corner}") - F.col(f"{c}_00") for c in AXES]


def neighbour_edges(grid: DataFrame, mode: str = "strict", by: Sequence[str] = ()) -> DataFrame:
    """(by, v, u, direction, distance) of valid vertex pairs to the right (u) and below (v)."""
    table = stencil(valid_vertices(grid, mode), AXES, ((0, 0), (0, 1), (1, 0)), by)
    both = F.array(
        F.struct(F.lit("u").alias("direction"), length(_edge("01")).alias("distance")),
        F.struct(F.lit("v").alias("direction"), length(_edge("10")).alias("distance")),
    )
    return table.select(*by, "v", "u", F.explode(both).alias("e")).select(*by, "v", "u", "e.*").where("distance is not null")


def grid_continuity(grid: DataFrame, spacing: float, tolerance: float, jump: float, by: Sequence[str] = ()) -> DataFrame:
    """Edge lengths per surface and direction against the expected spacing."""
    jumps = F.sum(F.when(F.col("value") > lit(spacing * jump), F.col("n")).otherwise(0))
    q = exact_quantiles(
        neighbour_edges(grid, by=by), "distance", {"min": 0, "p01": 0.01, "p50": 0.5, "p99": 0.99, "max": 1}, [*by, "direction"],
        abrupt_jumps=jumps,
    )
    error = F.abs(F.col("p50") - lit(spacing)) / lit(spacing)
    return q.withColumn("relative_error", error).withColumn(
        "within_tolerance", error <= lit(tolerance)
    ).withColumnRenamed("n", "edges")


def grid_vertices(grid: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Vertex counts by state and the bounds of the valid ones, per surface."""
    x, y, z = (F.col(c) for c in AXES)
    every = (x == -1) & (y == -1) & (z == -1)
    some = ((x == -1) | (y == -1) | (z == -1)) & ~every
    ok = vertex_valid(x, y, z)
    return grid.groupBy(*by).agg(
        F.count(F.lit(1)).alias("vertices"), F.count_if(ok).alias("valid"), F.count_if(some).alias("partial_sentinel"),
        *[F.min(F.when(ok, F.col(c))).alias(f"{c}_min") for c in AXES],
        *[F.max(F.when(ok, F.col(c))).alias(f"{c}_max") for c in AXES],
    )


def quad_cells(grid: DataFrame, mode: str = "strict", by: Sequence[str] = ()) -> DataFrame:
    """(by, v, u, area, nx, ny, nz): valid quads, their parallelogram area and normal."""
    table = stencil(valid_vertices(grid, mode), AXES, by=by)
    whole = F.lit(True)
    for a, b in CORNERS:
        whole = whole & F.col(f"x_{a}{b}").isNotNull()
    normal = cross(_edge("01"), _edge("10"))
    return table.where(whole).select(
        *by, "v", "u", length(normal).alias("area"), *[c.alias(n) for c, n in zip(normal, ("nx", "ny", "nz"))]
    )


def _unit_dots(quads: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, v, u, direction, dot) of unit normals of adjacent quads."""
    unit = quads.where("area > 0").select(*by, "v", "u", *[(F.col(n) / F.col("area")).alias(n) for n in ("nx", "ny", "nz")])
    table = stencil(unit, ("nx", "ny", "nz"), ((0, 0), (0, 1), (1, 0)), by)
    dot = lambda corner: sum(
        (F.col(f"{n}_00") * F.col(f"{n}_{corner}") for n in ("ny", "nz")), F.col("nx_00") * F.col(f"nx_{corner}")
    )
    both = F.array(
        F.struct(F.lit("u").alias("direction"), dot("01").alias("dot")),
        F.struct(F.lit("v").alias("direction"), dot("10").alias("dot")),
    )
    return table.select(*by, "v", "u", F.explode(both).alias("e")).select(*by, "v", "u", "e.*").where("dot is not null")


def grid_topology(grid: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Quads, degenerate ones, and flips between neighbouring unit normals: one row, or one per surface."""
    by = list(by)
    quads = cut_lineage(quad_cells(grid, by=by))  # one row per quad, read four times below
    medians = exact_quantiles(quads, "area", {"_m": 0.5}, by)
    degenerate = F.count_if(F.col("area") <= F.col("_m") * lit(0.01)).alias("degenerate")
    flips = F.sum(F.when(F.col("value") < 0, F.col("n")).otherwise(0))
    dots = exact_quantiles(_unit_dots(quads, by), "dot", {"p01": 0.01}, by, flips=flips)
    total = F.count(F.lit(1)).alias("quads")
    if by:
        base = join_by(quads.select(*by, "area"), medians.select(*by, "_m"), by).groupBy(*by).agg(total, degenerate, F.max("_m").alias("median_area"))
        found = join_by(base, dots.select(*by, F.struct("n", "p01", "flips").alias("_d")), by, "left")
    else:
        base = quads.withColumn("_m", medians.select("_m").scalar()).agg(total, degenerate, F.max("_m").alias("median_area"))
        found = base.withColumn("_d", dots.select(F.struct("n", "p01", "flips").alias("d")).scalar())
    return found.select(
        *by, "quads", "degenerate", "median_area", F.col("_d.n").alias("normal_pairs"),
        F.col("_d.flips").alias("normal_flips"), F.col("_d.p01").alias("dot_p01"),
    )


def pixel_area(px: DataFrame, grid: DataFrame, step: int, voxel_um: float) -> DataFrame:
    """Pixels with the physical area of their grid cell, NULL where the cell is not supported."""
    cell = px.withColumn("v", floor_div(F.col("y"), step).cast("int")).withColumn(
        "u", floor_div(F.col("x"), step).cast("int")
    )
    quads = quad_cells(grid, "not_all_sentinel").select("v", "u", F.col("area").alias("quad_area"))
    return cell.join(quads, ["v", "u"], "left").withColumn(
        "area_um2", F.col("quad_area") * lit(voxel_um**2) / lit(step * step)
    )


def roi_geometry(px: DataFrame, grid: DataFrame, step: int, voxel_um: float, chunk: Sequence[str]) -> DataFrame:
    """Per chunk: evaluated and unsupported pixels, degenerate and flipped cells, area, verdict.

    A chunk has a fixed pixel count, so its exact area percentile is bounded.
    """
    chunk = list(chunk)
    quads = cut_lineage(quad_cells(grid, "not_all_sentinel"))
    median = exact_quantiles(quads, "area", {"q": 0.5}).select("q").scalar()
    cell = px.select(
        *chunk, floor_div(F.col("y"), step).cast("int").alias("v"), floor_div(F.col("x"), step).cast("int").alias("u")
    )
    # Pixels collapse to grid cells with a count before the geometry is attached.
    cells = cut_lineage(cell.groupBy(*chunk, "v", "u").agg(F.count(F.lit(1)).alias("px")))
    rows = cells.join(quads.select("v", "u", "area"), ["v", "u"], "left").withColumn("_m", median)
    scale = lit(voxel_um**2 / (step * step))
    out = rows.groupBy(*chunk).agg(
        F.sum("px").alias("evaluated"),
        F.sum(F.when(F.col("area").isNull(), F.col("px")).otherwise(0)).alias("unsupported"),
        F.count(F.lit(1)).alias("cells"),
        F.count_if(F.col("area") <= F.col("_m") * lit(0.01)).alias("degenerate"),
        (F.sum(F.col("area") * F.col("px")) * scale / lit(1e8)).alias("area_cm2"),
        (F.percentile("area", 0.5, F.when(F.col("area").isNotNull(), F.col("px")).otherwise(0)) * scale).alias("area_p50"),
    )
    flips = _unit_dots(quads).where("dot < 0")
    here = cells.select(*chunk, "v", "u").join(flips, ["v", "u"]).select(
        *chunk, (F.col("v") + (F.col("direction") == "v").cast("int")).alias("v"),
        (F.col("u") + (F.col("direction") == "u").cast("int")).alias("u"),
    )
    flipped = here.join(cells.select(*chunk, "v", "u"), [*chunk, "v", "u"]).groupBy(*chunk).agg(
        F.count(F.lit(1)).alias("flips")
    )
    return out.join(flipped, chunk, "left").fillna(0, ["flips"]).withColumn(
        "passes", (F.col("unsupported") == 0) & (F.col("degenerate") == 0) & (F.col("flips") == 0)
    )


def grid_step(grid: DataFrame, crop_mm: float, voxel_um: float) -> DataFrame:
    """Median edge length over both directions and the crop it gives in grid pixels."""
    edges = neighbour_edges(grid, "positive")
    return exact_quantiles(edges, "distance", {"step": 0.5}).select(
        F.col("n").alias("edges"), "step",
        F.rint(lit(crop_mm * 1000) / (F.col("step") * lit(voxel_um))).cast("bigint").alias("crop_px"),
    )


def surface_normals(grid: DataFrame) -> DataFrame:
    """Unit normals from central differences along u and v, at valid vertices."""
    g = grid
    for c in AXES:
        g = central_diff(g, c, "u", "v", alias=f"{c}_du")
    for c in AXES:
        g = central_diff(g, c, "v", "u", alias=f"{c}_dv")
    normal = cross([F.col(f"{c}_du") for c in AXES], [F.col(f"{c}_dv") for c in AXES])
    norm = length(normal) + lit(1e-9)
    return valid_vertices(g, "positive").select(
        "v", "u", *AXES, *[(c / norm).alias(n) for c, n in zip(normal, ("nx", "ny", "nz"))]
    )


# -- registration -----------------------------------------------------------------------------


def fit_affine(pairs: DataFrame, source=("sx", "sy", "sz"), target=("tx", "ty", "tz")) -> np.ndarray:
    """Least-squares 4x3 affine; one aggregate builds the centred normal equations.

    Only 22 sums reach the driver, whatever the number of pairs.
    """
    cols = [*source, *target]
    means = pairs.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in cols]).first()
    if means["n"] < 4:
        raise ValueError("an affine fit needs at least four pairs")
    c = {k: F.col(k) - lit(means[k]) for k in cols}
    sums = {(a, b): F.sum(c[a] * c[b]) for i, a in enumerate(source) for b in [*source[i:], *target]}
    row = pairs.agg(*[s.alias(f"{a}|{b}") for (a, b), s in sums.items()]).first().asDict()
    get = lambda a, b: row.get(f"{a}|{b}", row.get(f"{b}|{a}"))
    xx = np.array([[get(a, b) for b in source] for a in source])
    xy = np.array([[get(a, b) for b in target] for a in source])
    if np.linalg.matrix_rank(xx) < 3:
        raise ValueError("affine registration is rank deficient")
    linear = np.linalg.solve(xx, xy)
    shift = np.array([means[t] for t in target]) - np.array([means[s] for s in source]) @ linear
    return np.vstack((linear, shift))


def residuals(pairs: DataFrame, matrix, source=("sx", "sy", "sz"), target=("tx", "ty", "tz")) -> DataFrame:
    """Adds the distance between the transformed source and the target."""
    m = np.asarray(matrix, dtype=float)
    moved = [
        lit(m[3, j]) + sum((lit(m[i, j]) * F.col(s) for i, s in enumerate(source)), lit(0)) for j in range(3)
    ]
    return pairs.withColumn("residual", length([a - F.col(t) for a, t in zip(moved, target)]))


def registration_report(pairs: DataFrame, block: int, folds: int, holdout: int, max_p50: float, max_p90: float) -> DataFrame:
    """Affine fitted off the held-out checkerboard, residual quantiles on it, and the gate."""
    from surfaudit.operators.sampling import checkerboard

    split = checkerboard(pairs, block, folds, holdout)
    matrix = fit_affine(split.where(~F.col("holdout")))
    held = residuals(split.where("holdout"), matrix)
    q = exact_quantiles(held, "residual", {"p50": 0.5, "p90": 0.9, "p99": 0.99, "max": 1})
    return q.withColumn("passes", (F.col("p50") <= lit(max_p50)) & (F.col("p90") <= lit(max_p90)))


def candidate_geometry(candidates: DataFrame, grid: DataFrame, ratio: tuple[float, float], cell: int = 8) -> DataFrame:
    """XYZ box of the valid vertices under each candidate's raster bounds.

    Candidates and vertices meet on grid cells, an equi-join in place of a range join.  The cells
    are small, so a candidate meets few vertices that it does not hold, and candidates of equal
    bounds meet them once.
    """
    to = lambda c, r, f: f(F.col(c).cast("double") / lit(r)).cast("int")
    boxes = candidates.select(
        "box_id",
        F.greatest(to("y0", ratio[0], F.floor), F.lit(0)).alias("v0"), to("y1", ratio[0], F.ceil).alias("v1"),
        F.greatest(to("x0", ratio[1], F.floor), F.lit(0)).alias("u0"), to("x1", ratio[1], F.ceil).alias("u1"),
    )
    bounds = ["v0", "v1", "u0", "u1"]
    spans = boxes.select(*bounds).distinct()
    for a in ("v", "u"):
        spans = spans.where(f"{a}0 < {a}1").withColumn(
            f"_k{a}", F.explode(F.sequence(floor_div(F.col(f"{a}0"), cell), floor_div(F.col(f"{a}1") - 1, cell)))
        )
    points = valid_vertices(grid, "strict").withColumn("_kv", floor_div(F.col("v"), cell)).withColumn(
        "_ku", floor_div(F.col("u"), cell)
    )
    inside = points.join(spans, ["_kv", "_ku"]).where("v >= v0 and v < v1 and u >= u0 and u < u1")
    found = inside.groupBy(*bounds).agg(
        F.count(F.lit(1)).alias("vertices"),
        *[F.min(c).alias(f"{c}_min") for c in AXES], *[F.max(c).alias(f"{c}_max") for c in AXES],
    )
    return boxes.join(found, bounds).groupBy("box_id").agg(
        F.sum("vertices").alias("vertices"),
        *[F.min(f"{c}_min").alias(f"{c}_min") for c in AXES], *[F.max(f"{c}_max").alias(f"{c}_max") for c in AXES],
    )


def out_of_bounds(grid: DataFrame, shape_zyx: tuple[int, int, int]) -> DataFrame:
    inside = F.lit(True)
    for c, n in zip(("z", "y", "x"), shape_zyx):
        inside = inside & (F.col(c) >= 0) & (F.col(c) < n)
    return valid_vertices(grid, "strict").agg(F.count(F.lit(1)).alias("valid"), F.count_if(~inside).alias("outside"))
