"""Per-pixel statistics along the depth axis of a volume."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from surfaudit.functions.scalar import floor_div, lit


def depth_features(vox: DataFrame, c0: int, c1: int, keys=("y", "x")) -> DataFrame:
    """Mean, max, population deviation and central-minus-outer contrast of each depth column."""
    central = (F.col("z") >= c0) & (F.col("z") < c1)
    v = F.col("v").cast("double")
    return vox.groupBy(*keys).agg(
        F.avg(v).alias("depth_mean"),
        F.max(v).alias("depth_max"),
        F.stddev_pop(v).alias("depth_std"),
        (F.avg(F.when(central, v)) - F.avg(F.when(~central, v))).alias("central_contrast"),
    )


def pool_depth(vox: DataFrame, depth: int, planes: int, pool: int, keys=("y", "x")) -> DataFrame:
    """Centred pooling of ``planes`` groups of ``pool`` layers, mean rounded half to even.

    Every pixel of ``vox`` has all planes; layers that are not stored are zero.
    """
    if planes * pool > depth:
        raise ValueError("pooling needs more layers than the volume has")
    start = math.ceil((depth - planes * pool) / 2)
    # One conditional sum per plane (a parameter), so a pixel is one row of a hash aggregate.
    plane = floor_div(F.col("z") - start, pool)
    inside = (F.col("z") >= start) & (F.col("z") < start + planes * pool)
    sums = [F.coalesce(F.sum(F.when(inside & (plane == p), F.col("v"))), F.lit(0)) for p in range(planes)]
    wide = vox.groupBy(*keys).agg(F.array(*[F.rint(s / lit(pool)).cast("bigint") for s in sums]).alias("_planes"))
    return wide.select(*keys, F.posexplode("_planes").alias("plane", "v"))
