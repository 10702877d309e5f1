"""Probing a volume along surface normals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from surfaudit.functions.scalar import lit
from surfaudit.operators.joins import VoxelReader, sample_volume, written
from surfaudit.operators.windows import smooth_first_min


def _places(steps) -> list[tuple[float, int]]:
    """(step, side) of the samples of a point."""
    return [(0.0, 1)] + [(float(s), side) for s in steps for side in (1, -1)]


def probe_samples(points: DataFrame, vox: DataFrame | VoxelReader, steps) -> DataFrame:
    """(point_id, step, side, sample): nearest voxel at 0 and at +/- every step along the normal.

    ``vox`` is a voxel table or a reader, for instance a ``ChunkStore``.
    """
    offsets = F.array(*[F.struct(lit(s).alias("step"), F.lit(side).alias("side")) for s, side in _places(steps)])
    spread = points.select("*", F.explode(offsets).alias("o")).select(
        "point_id", "o.*", *[(F.col(f"p{a}") + F.col(f"n{a}") * F.col("o.step") * F.col("o.side")).alias(f"p{a}") for a in "zyx"]
    )
    return sample_volume(spread, vox, ["point_id", "step", "side"], "nearest").select("point_id", "step", "side", "sample")


def probe_profiles(points: DataFrame, vox: DataFrame | VoxelReader, steps) -> DataFrame:
    """(point_id, samples): the samples of each point as an array, at 0 and at + and - of every step.

    A reader with ``sample_along`` gets each point once; another one, or a table, each sample.
    """
    places = _places(steps)
    if hasattr(vox, "sample_along"):
        return vox.sample_along(points, ["point_id"], [step * side for step, side in places], "nearest")
    at = [F.max(F.when((F.col("step") == lit(step)) & (F.col("side") == side), F.col("sample"))) for step, side in places]
    return probe_samples(points, vox, steps).groupBy("point_id").agg(F.array(*at).alias("samples"))


def seating_score(points: DataFrame, vox: DataFrame | VoxelReader, steps, bright: float = 40, min_coverage: float = 0.25) -> DataFrame:
    """Gap to the neighbouring sheet, coverage, contrast and score of a surface in a volume.

    The profile of mean brightness over steps is smoothed and its first local minimum is the
    gap; contrast compares bright surface points with both sides at the gap.
    """
    places = _places(steps)
    profiles = written(probe_profiles(points, vox, steps), "profiles")  # read for the gap and for the score
    each = {place: F.get("samples", F.lit(i)) for i, place in enumerate(places)}
    sums = profiles.agg(*[F.avg(each[place]).alias(f"m{i}") for i, place in enumerate(places)])
    mean = {place: F.col(f"m{i}") for i, place in enumerate(places)}
    bands = F.array(*[
        F.struct(lit(s).alias("step"), ((mean[s, 1] + mean[s, -1]) / lit(2)).alias("mean")) for s in dict.fromkeys(map(float, steps))
    ])
    profile = sums.select(F.explode(bands).alias("b")).select("b.*", F.lit(0).alias("probe"))
    gap = smooth_first_min(profile, ["probe"], "step", "mean").select("gap").scalar()
    at = lambda side: F.coalesce(*[F.when(F.col("gap") == lit(s), each[s, side]) for s in dict.fromkeys(map(float, steps))])
    per = profiles.withColumn("gap", gap).select("gap", each[0.0, 1].alias("centre"), at(-1).alias("before"), at(1).alias("after"))
    on = F.col("centre") > lit(bright)
    out = per.agg(
        F.max("gap").alias("gap"),
        F.avg(on.cast("double")).alias("coverage"),
        F.avg(F.when(on, F.col("centre") - (F.col("before") + F.col("after")) / lit(2))).alias("_contrast"),
        F.avg(F.when(on, F.col("centre"))).alias("_bright"),
        F.avg("centre").alias("_all"),
    )
    seated = F.col("coverage") >= lit(min_coverage)
    return out.select(
        "gap", "coverage",
        F.when(seated, F.col("_contrast")).alias("contrast"),
        F.when(seated, F.col("_contrast") * F.col("coverage")).otherwise(lit(-1)).alias("score"),
        F.when(seated, F.col("_bright")).otherwise(F.col("_all")).alias("surface_mean"),
    )
