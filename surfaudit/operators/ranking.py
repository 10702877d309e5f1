"""Top-k selections, suppression of close candidates, and set operations on keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from surfaudit.functions.scalar import floor_div, lit
from surfaudit.operators.prefix import RADIX, bucket_digits, group_key, prefix_sum, split_bucket, value_counts
from surfaudit.session import cut_lineage


def top_ranked(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows with their rank: each task keeps n rows, the merge sees no more."""
    w = W.partitionBy(F.lit(0)).orderBy(*order)
    return df.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(w))


def rank_rows(
    df: DataFrame, order: str, tiebreak: str | Sequence[str], by: Sequence[str] = (), descending: bool = True
) -> DataFrame:
    """Consecutive rank of every row by score, ties by ascending tie-breaks, within ``by``.

    NULL scores come last, NULL tie-breaks first, and a NULL group is a group of its own.  Rows
    equal in all of these are numbered in any order.  Rows fall into ordered buckets by split
    points of the score; a score heavy enough to be a split point has buckets of its own, cut by
    split points of the first tie-break.  So one shuffle numbers all rows, in buckets that
    neither a hot group nor a hot score fills, and bucket counts give the offsets.
    """
    ties = [tiebreak] if isinstance(tiebreak, str) else list(tiebreak)
    keyed = df.withColumn("_s", F.col(order).cast("double")).withColumn("_t", F.col(ties[0]).cast("double"))
    keyed = keyed.withColumn("_s", F.when(~F.isnan("_s"), F.col("_s"))).withColumn("_by", group_key(by))
    digits = bucket_digits(df)
    buckets = RADIX**digits
    probs = [i / buckets for i in range(1, buckets)]
    # Two short lists of numbers, taken once, so that every later pass cuts alike.
    points = keyed.agg(*[F.percentile_approx(c, probs, max(1000, 8 * buckets)) for c in ("_s", "_t")]).first()
    score_points, tie_points = (F.array(*[F.lit(float(v)) for v in p or []]).cast("array<double>") for p in points)
    cut = split_bucket(keyed, "_s", score_points, digits, "_b")
    at_point = F.coalesce(F.get(score_points, F.col("_b")) == F.col("_s"), F.lit(False)) | F.col("_s").isNull()
    cut = split_bucket(cut.withColumn("_eq", at_point.cast("int")), "_t", tie_points, digits, "_sub")
    cut = cut.withColumn("_sub", F.when(F.col("_eq") == 1, F.col("_sub")).otherwise(0)).withColumn("_none", F.col("_s").isNull().cast("int"))

    direction = F.desc if descending else F.asc
    place = ["_none", "_b", "_eq", "_sub"]
    before = W.partitionBy("_by").orderBy("_none", direction("_b"), direction("_eq"), "_sub").rowsBetween(W.unboundedPreceding, -1)
    counts = cut.groupBy("_by", *place).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_by", *place, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy("_by", *place).orderBy(direction("_s"), *[F.asc(t) for t in ties])
    numbered = cut.withColumn("_row", F.row_number().over(inside)).join(offsets, ["_by", *place])
    return numbered.select(*df.columns, (F.col("_before") + F.col("_row")).alias("rank"))


def candidate_package(regions: DataFrame, score: str, n: int, prefix: str, tiebreak: str) -> DataFrame:
    """Eligible regions, the best n by score, with consecutive candidate ids."""
    best = top_ranked(regions.where("eligible"), [F.desc(score), F.asc(tiebreak)], n)
    return best.withColumn("candidate_id", F.format_string(f"{prefix}-r%03d", F.col("rank")))


def select_chunks(
    listing: DataFrame, k: int, min_bytes: int, bounds: tuple[int, int, int, int] | None = None
) -> DataFrame:
    """The k largest chunks within bounds, then by key; ``found`` shows whether k were available."""
    ok = F.col("bytes") >= min_bytes
    if bounds:
        y0, y1, x0, x1 = bounds
        ok = ok & (F.col("cy") >= y0) & (F.col("cy") < y1) & (F.col("cx") >= x0) & (F.col("cx") < x1)
    fit = listing.where(ok)
    found = fit.agg(F.count(F.lit(1))).scalar()
    best = top_ranked(fit, [F.desc("bytes"), F.asc("cy"), F.asc("cx")], k)
    return best.withColumn("found", found).withColumn("enough", F.col("found") >= k)


def top_fraction(df: DataFrame, score: str, fraction: float) -> DataFrame:
    """Rows at or above the k-th largest score, k = max(1, ceil(n * fraction)); ties are kept."""
    curve = prefix_sum(value_counts(df, score), "value", ["n"], descending=True)
    k = F.greatest(F.lit(1), F.ceil(F.col("total_n").cast("double") * lit(fraction)))
    cut = curve.where(F.col("cum_n") >= k).agg(F.max("value")).scalar()
    return df.withColumn("cutoff", cut).where(F.col(score) >= F.col("cutoff"))


FIRST_BATCH, BATCH_GROWTH = 1 << 12, 8  # best points that suppression looks at first, and how much more each time


def _batch_bounds(df: DataFrame, order: str, first: int) -> list:
    """Ascending values of ``order``, the last its maximum, with about ``first`` rows up to the first
    and BATCH_GROWTH times as many up to each further one."""
    n, top = df.agg(F.count(order), F.max(order)).first()
    shares = []
    while first < n:
        shares.append(first / n)
        first *= BATCH_GROWTH
    # A few numbers; where they lie decides how much is looked at, not the result.
    cuts = df.agg(F.percentile_approx(order, shares, 10000)).first()[0] if shares else []
    return sorted({*cuts, top} - {None})


def suppress_close(
    ranked: DataFrame, axes: Sequence[str], priority: str, distance: float, limit: int
) -> DataFrame:
    """Greedy non-maximum suppression: best priority first, skip centres closer than distance.

    ``priority`` is a unique ascending order.  Space is cut into cells whose points all lie
    within the distance, so a cell keeps at most one point and only its best open point, the
    leader, can be next.  A leader better than every leader in reach is kept, as the greedy loop
    would; the open points around it go.  Work per round is linear in cells and open points: no
    pairs of points are listed, however dense a cell is.

    What the greedy loop keeps of the best points does not depend on the others.  So the points
    come in batches, each BATCH_GROWTH times the one before, the best first, less those around what
    is kept already; the rest is left alone once ``limit`` points are kept.
    """
    dims = len(axes)
    side = distance / dims**0.5 * (1 - 1e-9)
    reach = int(dims**0.5) + 1
    cells = [f"_c{a}" for a in axes]
    ranked = cut_lineage(ranked)
    points = ranked.select(
        F.col(priority).alias("p"), *axes, *[floor_div(F.col(a), side).alias(c) for a, c in zip(axes, cells)]
    )

    def around(df: DataFrame) -> DataFrame:
        for c in cells:
            df = df.withColumn(c, F.explode(F.array(*[F.col(c) + d for d in range(-reach, reach + 1)])))
        return df

    gap = reduce(lambda t, a: t + (F.col(a) - F.col(f"_{a}")) * (F.col(a) - F.col(f"_{a}")), axes, lit(0))

    def without(df: DataFrame, chosen: DataFrame) -> DataFrame:
        """The points of ``df`` that lie around none of ``chosen``."""
        shadow = around(chosen.select(*[F.col(a).alias(f"_{a}") for a in axes], *cells))
        hit = df.join(shadow, cells).where(F.sqrt(gap) < lit(distance)).select("p").distinct()
        return cut_lineage(df.join(hit, "p", "left_anti"))

    kept, last = None, None
    for bound in _batch_bounds(points, "p", max(FIRST_BATCH, 16 * limit)):
        batch = points.where(F.col("p") <= bound)
        if last is not None:
            batch = batch.where(F.col("p") > last)
        batch, last = cut_lineage(batch), bound
        open_points = batch if kept is None else without(batch, kept)
        while True:
            first_open = open_points.agg(F.min("p")).first()[0]
            if first_open is None:
                break
            # Everything better than the first open point is final.
            if kept is not None and kept.where(F.col("p") < first_open).count() >= limit:
                break
            leaders = open_points.groupBy(*cells).agg(F.min("p").alias("p"))
            best_near = around(leaders).groupBy(*cells).agg(F.min("p").alias("best"))
            chosen = leaders.join(best_near, cells).where("p = best").select("p")
            chosen = cut_lineage(open_points.join(chosen, "p", "left_semi"))
            kept = chosen if kept is None else kept.unionAll(chosen)
            open_points = without(open_points, chosen)
        if kept is not None and kept.count() >= limit:
            break
    if kept is None:
        return ranked.withColumn("rank", F.lit(1)).limit(0)
    return top_ranked(ranked.join(kept.select(F.col("p").alias(priority)), priority), [F.asc(priority)], limit)


# -- sets -----------------------------------------------------------------------------------


def missing(wanted: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    return wanted.select(*keys).distinct().join(present.select(*keys), list(keys), "left_anti")


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Counts per side and the verdict: equal sets, every key once on each side.

    Keys of both sides are counted in one shuffle.
    """
    both = a.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(
        b.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    per = both.groupBy(key).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    out = per.agg(
        F.count_if(F.expr("l > 0")).alias("left_keys"), F.count_if(F.expr("r > 0")).alias("right_keys"),
        F.count_if(F.expr("l > 0 and r = 0")).alias("only_left"), F.count_if(F.expr("r > 0 and l = 0")).alias("only_right"),
        F.sum(F.greatest(F.col("l") - 1, F.lit(0))).alias("left_duplicates"),
        F.sum(F.greatest(F.col("r") - 1, F.lit(0))).alias("right_duplicates"),
    )
    clean = [F.col(c) == 0 for c in ("only_left", "only_right", "left_duplicates", "right_duplicates")]
    return out.withColumn("same", reduce(lambda p, q: p & q, clean))


def union_keys(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames).distinct()


def mask_algebra(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AND, OR and AND NOT of two sparse pixel sets as flags, in one shuffle."""
    both = a.select(*keys, F.lit(True).alias("a"), F.lit(False).alias("b")).unionAll(
        b.select(*keys, F.lit(False).alias("a"), F.lit(True).alias("b"))
    )
    return both.groupBy(*keys).agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b")).select(
        *keys, (F.col("a") & F.col("b")).alias("in_both"), (F.col("a") & ~F.col("b")).alias("only_a")
    )


def concat_tagged(frames: dict[str, DataFrame], tag: str = "tag") -> DataFrame:
    return reduce(DataFrame.unionByName, [df.withColumn(tag, F.lit(name)) for name, df in frames.items()])
