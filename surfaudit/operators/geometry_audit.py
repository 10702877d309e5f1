"""The geometry audit of one surface: grid, mapping, volume bounds and CT support, and the tier they earn."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from surfaudit.functions.scalar import floor_div, lit
from surfaudit.operators.components import component_areas, component_summary, components
from surfaudit.operators.contracts import geometry_tier
from surfaudit.operators.evidence import ct_support
from surfaudit.operators.grid import AXES, grid_continuity, grid_topology, grid_vertices, out_of_bounds, valid_vertices


@dataclass(frozen=True)
class Criteria:
    """What a surface has to hold to: spacing of its vertices, and the CT support of its candidates."""

    spacing: float
    tolerance: float
    jump: float
    any_support: float
    central_support: float
    every_candidate: bool = True
    least_component: float = 0.99


@dataclass(frozen=True)
class Volume:
    """The parent volume: its shape (z, y, x), whether the catalog ties the surface to it, and its central layers."""

    shape: tuple[int, int, int]
    associated: bool
    central: tuple[int, int]


def grid_mapping(grid: DataFrame, pixels: DataFrame, shape: tuple[int, int], reference: tuple[int, int]) -> DataFrame:
    """(integer_aligned, supervised, unsupported): supervised pixels (y, x), and those whose vertex is not valid.

    A raster whose size is not a multiple of the grid's is not aligned, and nothing is counted.
    """
    if any(r % g or r < g for r, g in zip(reference, shape)):
        return pixels.sparkSession.range(1).select(F.lit(False).alias("integer_aligned"), F.lit(None).cast("bigint").alias("supervised"), F.lit(None).cast("bigint").alias("unsupported"))
    ry, rx = (r // g for r, g in zip(reference, shape))
    # Pixels collapse to vertices with a count before the grid is met.
    cells = pixels.groupBy(floor_div(F.col("y"), ry).cast("int").alias("v"), floor_div(F.col("x"), rx).cast("int").alias("u")).agg(F.count(F.lit(1)).alias("px"))
    good = valid_vertices(grid, "strict").select("v", "u", F.lit(True).alias("ok"))
    met = cells.join(good, ["v", "u"], "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return met.agg(
        F.lit(True).alias("integer_aligned"), total(F.col("px")).alias("supervised"),
        total(F.when(F.col("ok").isNull(), F.col("px"))).alias("unsupported"),
    )


def support_report(vox: DataFrame, supervised: DataFrame, central: tuple[int, int], depth: int, any_support: float, central_support: float) -> DataFrame:
    """(candidates, passing) over the candidates of ``supervised`` (box_id, y, x); a candidate without pixels is not there."""
    each = ct_support(vox, supervised, central, depth, ["box_id"])
    good = (F.col("any_fraction") >= lit(any_support)) & (F.col("central_fraction") >= lit(central_support))
    return each.agg(F.count(F.lit(1)).alias("candidates"), F.count_if(good).alias("passing"))


def _row(df: DataFrame) -> Column:
    """The one row of a table as a struct, a subquery of the audit."""
    return df.select(F.struct("*")).scalar()


def geometry_audit(
    grid: DataFrame, shape: tuple[int, int], reference: tuple[int, int], supervised: DataFrame, vox: DataFrame, volume: Volume, criteria: Criteria
) -> DataFrame:
    """One row: what each audit found, the three verdicts, blockers and tier of a surface.

    ``grid`` is (v, u, x, y, z) of ``shape`` vertices, ``supervised`` the (box_id, y, x) pixels of
    the candidates on a raster of ``reference`` size, ``vox`` the (z, y, x, v) voxels extracted
    along it.  Vertices that are not finite, or lack some coordinates, fail the grid; so do a
    largest 8-connected piece below its share, a spacing off the expected one, jumps, degenerate
    quads, flipped normals, and supervised pixels on invalid vertices.  A grid without valid
    vertices, or a volume the catalog does not tie to the surface, is not verified.
    """
    finite = F.lit(True)
    for c in AXES:
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < lit(float("inf")))
    nonfinite = grid.agg(F.count_if(~finite).alias("n"))
    whole = grid.where(finite)
    vertices = valid_vertices(whole, "strict").select(F.col("v").alias("y"), F.col("u").alias("x"))
    pieces = component_summary(component_areas(components(vertices, full=True)))
    spread = grid_continuity(whole, criteria.spacing, criteria.tolerance, criteria.jump).agg(
        F.count(F.lit(1)).alias("directions"), F.bool_and("within_tolerance").alias("within_tolerance"), F.sum("abrupt_jumps").alias("abrupt_jumps")
    )
    depth = volume.shape[0]
    support = support_report(vox, supervised, volume.central, depth, criteria.any_support, criteria.central_support)
    found = grid_vertices(whole).select("vertices", "valid", "partial_sentinel").withColumns({
        "n": _row(nonfinite), "c": _row(pieces), "s": _row(spread), "t": _row(grid_topology(whole)),
        "m": _row(grid_mapping(whole, supervised.select("y", "x").distinct(), shape, reference)), "o": _row(out_of_bounds(whole, volume.shape)), "p": _row(support),
    })
    out = found.select(
        "vertices", "valid", "partial_sentinel", F.col("n.n").alias("nonfinite"), F.coalesce("c.largest_fraction", lit(0)).alias("largest_fraction"),
        F.coalesce("s.within_tolerance", F.lit(False)).alias("within_tolerance"), F.coalesce("s.abrupt_jumps", F.lit(0)).alias("abrupt_jumps"),
        F.col("t.degenerate").alias("degenerate_quads"), F.coalesce("t.normal_flips", F.lit(0)).alias("normal_flips"),
        "m.integer_aligned", "m.supervised", "m.unsupported", F.col("o.outside").alias("out_of_bounds"), "p.candidates", "p.passing",
    )
    grid_ok = (
        (F.col("nonfinite") == 0) & (F.col("partial_sentinel") == 0) & (F.col("largest_fraction") >= lit(criteria.least_component))
        & F.col("within_tolerance") & (F.col("abrupt_jumps") == 0) & (F.col("degenerate_quads") == 0) & (F.col("normal_flips") == 0)
        & F.col("integer_aligned") & (F.coalesce("unsupported", F.lit(0)) == 0)
    )
    all_pass = F.col("passing") == F.col("candidates") if criteria.every_candidate else F.lit(True)
    return geometry_tier(out.withColumns({
        "grid_ok": grid_ok, "bounds_ok": F.lit(volume.associated) & (F.col("valid") > 0) & (F.col("out_of_bounds") == 0),
        "ct_ok": (F.col("candidates") > 0) & all_pass,
    }))
