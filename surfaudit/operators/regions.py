"""Tile, mask and ledger aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from surfaudit.functions.scalar import floor_div, lit, region_id
from surfaudit.operators.prefix import exact_quantiles, join_by
from surfaudit.session import scratch

HOT_BIN = 1 << 14  # points of a bin that are gathered to be sorted


def summarize_regions(px: DataFrame, size: int, min_valid: float, canvas: tuple[int, int], score: str = "score") -> DataFrame:
    """One row per size x size region of the canvas, from pixels(y, x, positive, valid, score).

    The valid fraction is taken of the region's area on the canvas (height, width), so pixels
    that are not stored count as invalid.  Statistics are NULL without valid pixels.  A region
    holds at most size * size pixels, so its exact percentiles are bounded.
    """
    high, wide = (-(-n // size) for n in canvas)
    side = lambda r, n: F.least(F.lit(size), F.lit(n) - F.col(r) * size)
    frame = px.sparkSession.range(high * wide).select(
        F.floor(F.col("id") / wide).cast("bigint").alias("ry"), (F.col("id") % wide).alias("rx")
    ).withColumn("footprint", side("ry", canvas[0]) * side("rx", canvas[1]))
    v = F.when(F.col("valid"), F.col(score))
    pct = F.percentile(v, [0.95, 0.99])
    valid = F.count_if("valid")
    found = px.groupBy(floor_div(F.col("y"), size).alias("ry"), floor_div(F.col("x"), size).alias("rx")).agg(
        valid.alias("valid_px"),
        F.count_if(F.col("valid") & F.col("positive")).alias("positive_px"),
        F.avg(v).alias("mean"),
        pct.alias("_p"),
        F.max(v).alias("max"),
    )
    return (
        frame.join(found, ["ry", "rx"], "left")
        .fillna(0, ["valid_px", "positive_px"])
        .select(
            region_id(F.col("ry") * size, F.col("rx") * size, size).alias("region_id"),
            (F.col("ry") * size).alias("y0"),
            (F.col("rx") * size).alias("x0"),
            "valid_px",
            "positive_px",
            F.try_divide("positive_px", "valid_px").alias("positive_fraction"),
            "mean",
            F.get("_p", F.lit(0)).alias("p95"),
            F.get("_p", F.lit(1)).alias("p99"),
            "max",
            (F.col("valid_px") / F.col("footprint") >= lit(min_valid)).alias("eligible"),
        )
    )


def region_stats(px: DataFrame, size: int, cols: Sequence[str]) -> DataFrame:
    """Long form (ry, rx, name, stat, value, neg): mean, p95 and max of many columns in one pass."""
    aggs = []
    for c in cols:
        v = F.when(F.col("valid"), F.col(c))
        aggs += [F.avg(v).alias(f"{c}_mean"), F.percentile(v, 0.95).alias(f"{c}_p95"), F.max(v).alias(f"{c}_max")]
    wide = px.groupBy(floor_div(F.col("y"), size).alias("ry"), floor_div(F.col("x"), size).alias("rx")).agg(*aggs)
    items = [
        F.struct(F.lit(c).alias("name"), F.lit(s).alias("stat"), F.col(f"{c}_{s}").cast("double").alias("value"))
        for c in cols
        for s in ("mean", "p95", "max")
    ]
    return wide.select("ry", "rx", F.explode(F.array(*items)).alias("i")).select(
        "ry", "rx", "i.*", (-F.col("i.value")).alias("neg")
    )


def mask_bbox(mask: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Half-open bounding box."""
    return mask.groupBy(*by).agg(
        F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"), F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")
    )


def mask_summary(px: DataFrame, value: str) -> DataFrame:
    """Positives inside and outside the mask, and exact quantiles of a value on the mask."""
    inside = F.count_if(F.col("valid") & F.col("positive"))
    counts = px.agg(
        F.count_if("valid").alias("valid_px"),
        inside.alias("positive_inside"),
        F.count_if(~F.col("valid") & F.col("positive")).alias("positive_outside"),
        F.try_divide(inside, F.count_if("valid")).alias("positive_fraction"),
    )
    qs = {"p01": 0.01, "p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    q = exact_quantiles(px.where("valid"), value, qs).select(F.struct(*qs).alias("q")).scalar()
    return counts.withColumn("_q", q).select("*", "_q.*").drop("_q")


def label_stats(px: DataFrame, chunk: Sequence[str]) -> DataFrame:
    """Valid and positive pixels per chunk, plus one total row (chunk columns NULL).

    Totals are GROUPING SETS over the chunk rows, so pixels are read once.
    """
    per = px.groupBy(*chunk).agg(
        F.count_if("valid").alias("valid_px"),
        F.count_if(F.col("valid") & F.col("positive")).alias("positive_px"),
    ).withColumn("both", (F.col("positive_px") > 0) & (F.col("positive_px") < F.col("valid_px")))
    return per.groupingSets([[F.col(c) for c in chunk], []], *chunk).agg(
        F.sum("valid_px").alias("valid_px"),
        F.sum("positive_px").alias("positive_px"),
        F.count_if("both").alias("both_chunks"),
    )


def common_support(px: DataFrame, policies: Sequence[str], chunk: Sequence[str]) -> DataFrame:
    """Eligible, positive and negative pixels per (policy, chunk) and per policy.

    ``px`` has one boolean column per policy; totals are GROUPING SETS of the same pass.
    """
    long = px.where("valid").select(
        *chunk,
        "positive",
        F.explode(
            F.array(*[F.struct(F.lit(p).alias("policy"), F.col(p).alias("ok")) for p in policies])
        ).alias("p"),
    ).select(*chunk, "positive", "p.*")
    sets = [[F.col("policy"), *[F.col(c) for c in chunk]], [F.col("policy")]]
    return long.groupingSets(sets, "policy", *chunk).agg(
        F.count_if("ok").alias("eligible"),
        F.count_if(F.col("ok") & F.col("positive")).alias("positive_px"),
        F.count_if(F.col("ok") & ~F.col("positive")).alias("negative_px"),
    )


def mask_stability(px: DataFrame, score: str, low: float, mid: float, high: float) -> DataFrame:
    """IoU of the middle threshold with its neighbours, and what the high threshold keeps."""
    n = lambda c: F.count_if(c)
    s = F.col(score)
    at = lambda t: s >= lit(t)
    iou = lambda a, b: F.coalesce(F.try_divide(n(a & b), n(a | b)), lit(1))
    return px.agg(
        n(at(mid)).alias("mid_px"),
        iou(at(mid), at(low)).alias("iou_low"),
        iou(at(mid), at(high)).alias("iou_high"),
        F.coalesce(F.try_divide(n(at(high)), n(at(mid))), lit(1)).alias("high_retention"),
    )


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows minus distinct keys; the first aggregate combines on the map side."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_keys"),
        (F.sum("n") - F.count(F.lit(1))).alias("duplicates"),
    )


def density_bins(points: DataFrame, sizes: dict[str, int], hot: int = HOT_BIN) -> DataFrame:
    """Points per occupied bin and the median of each axis; NULL and NaN coordinates count for neither.

    The values of a bin of up to ``hot`` points are sorted as short arrays, in one shuffle of the
    points; the medians of bins with more, found by a count first, are read off distributed
    cumulative counts.
    """
    axes = list(sizes)
    keys = [f"b{a}" for a in axes]
    place = [floor_div(F.floor(a), s).alias(f"b{a}") for a, s in sizes.items()]
    value = lambda a: F.when(~F.isnan(F.col(a).cast("double")), F.col(a).cast("double"))
    binned = points.select(*place, *[value(a).alias(a) for a in axes])
    many = binned.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot).drop("_n")
    # One bin per ``hot`` points at most; written, so that its size is known.
    folder = scratch(points.sparkSession, "hot-bins")
    many.write.parquet(folder)
    many = points.sparkSession.read.parquet(folder)

    some_hot = not many.isEmpty()
    few = join_by(binned, many, keys, "left_anti") if some_hot else binned
    sorted_ = few.groupBy(*keys).agg(*[F.sort_array(F.collect_list(a)).alias(f"_{a}") for a in axes])
    middle = lambda a, n: F.get(f"_{a}", F.floor(n / 2).cast("int"))
    low, high = ({a: middle(a, F.size(f"_{a}") - d) for a in axes} for d in (1, 0))
    meds = sorted_.select(
        *keys, F.greatest(*[F.size(f"_{a}") for a in axes]).cast("bigint").alias("points"),
        *[(low[a] + (high[a] - low[a]) * lit(0.5)).alias(f"{a}_med") for a in axes],
    ).where("points > 0")
    if not some_hot:
        return meds
    long = join_by(binned, many, keys, "left_semi").select(
        *keys,
        F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("c")) for a in axes])).alias("p"),
    ).select(*keys, "p.*")
    med = exact_quantiles(long, "c", {"med": 0.5}, [*keys, "axis"])
    return meds.unionByName(med.groupBy(*keys).agg(
        F.max("n").alias("points"),
        *[F.max(F.when(F.col("axis") == a, F.col("med"))).alias(f"{a}_med") for a in axes],
    ))


# -- ledgers --------------------------------------------------------------------------------


def budget(files: DataFrame, cap: int) -> DataFrame:
    """Files and bytes by surface x stage x regime with rolled-up totals and a cap check."""
    return files.rollup("regime", "surface", "stage").agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes")
    ).withColumn("within_cap", F.col("bytes") <= F.lit(cap))


def _pairs(n: Column) -> Column:
    return n * (n - 1) / lit(2)


def pair_counts(df: DataFrame, by: str, distinct: str, dims: Sequence[str], min_dims: int) -> DataFrame:
    """Pairs per group that differ in ``distinct`` and in at least ``min_dims`` of ``dims``.

    No pair is materialised.  For each subset S of dims the pairs agreeing on S follow from
    group sizes, all subsets come from one GROUPING SETS pass, and inclusion-exclusion turns
    "agrees on S" into "agrees on exactly S".
    """
    subsets = [s for r in range(len(dims) + 1) for s in combinations(dims, r)]
    sets = [[F.col(by), *[F.col(c) for c in s], *extra] for s in subsets for extra in ([], [F.col(distinct)])]
    grouped = df.groupingSets(sets, by, *dims, distinct).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_gid")
    )
    bits = len(dims) + 2  # by, dims..., distinct: bit set means "not grouped"
    agree = grouped.groupBy(by, "_gid").agg(F.sum(_pairs(F.col("n"))).alias("agree"))

    def gid(subset, with_distinct: bool) -> int:
        used = {by, *subset, *([distinct] if with_distinct else [])}
        return sum(1 << (bits - 1 - i) for i, c in enumerate([by, *dims, distinct]) if c not in used)

    weight: dict[int, int] = {}
    for exact in subsets:
        if len(dims) - len(exact) < min_dims:
            continue
        for s in subsets:
            if set(exact) <= set(s):
                sign = (-1) ** (len(s) - len(exact))
                weight[gid(s, False)] = weight.get(gid(s, False), 0) + sign
                weight[gid(s, True)] = weight.get(gid(s, True), 0) - sign
    factor = F.create_map(*[F.lit(v) for kv in weight.items() for v in kv])
    return agree.groupBy(by).agg(
        F.coalesce(F.sum(F.col("agree") * F.coalesce(F.try_element_at(factor, F.col("_gid").cast("int")), F.lit(0))), lit(0))
        .cast("bigint").alias("pairs")
    )


def catalog_summary(
    scans: DataFrame, sample: str, scan_id: str, dims: Sequence[str], min_dims: int, min_scans: int, min_pairs: int
) -> DataFrame:
    """Scan counts, qualified scan pairs and the readiness gate per sample."""
    counts = scans.groupBy(sample).agg(F.count(F.lit(1)).alias("scans"))
    pairs = pair_counts(scans, sample, scan_id, dims, min_dims)
    return counts.join(pairs, sample).withColumn(
        "ready", (F.col("scans") >= min_scans) & (F.col("pairs") >= min_pairs)
    )


def screen_summary(rows: DataFrame, by: Sequence[str], distinct: str, passes: Column, eligible: Column) -> DataFrame:
    """Rows passing alone, pairs screened and pairs passing both gates, counted from group sizes."""
    per = rows.where(eligible).groupBy(*by, distinct).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(passes).alias("p")
    )
    group = per.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum("p").alias("p"), F.sum(F.col("p") * F.col("p")).alias("pp"),
    )
    return group.agg(
        F.sum("n").alias("rows_eligible"),
        F.sum("p").alias("rows_passing"),
        (F.sum(F.col("n") * F.col("n") - F.col("nn")) / lit(2)).cast("bigint").alias("pairs_screened"),
        (F.sum(F.col("p") * F.col("p") - F.col("pp")) / lit(2)).cast("bigint").alias("pairs_passing"),
    )


def census(listing: DataFrame, case: str) -> DataFrame:
    """Distinct volumes and models per case and the resulting status."""
    pairs = listing.groupBy(case, "volume", "model").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("validation").alias("validation")
    )
    out = pairs.groupBy(case).agg(
        F.sum("n").alias("renders"),
        F.count_distinct("volume").alias("volumes"),
        F.count_distinct("model").alias("models"),
        F.bool_or("validation").alias("has_validation"),
    )
    enough = (F.col("volumes") >= 2) & (F.col("models") >= 2)
    return out.withColumn(
        "status",
        F.when(enough & F.col("has_validation"), "candidate_validation")
        .when(enough, "candidate_dev")
        .otherwise("no_distinct_pair"),
    )


def review_summary(reviews: DataFrame) -> DataFrame:
    """Counts, share, time quantiles and mean confidence per response (hot responses allowed)."""
    total = reviews.agg(F.count(F.lit(1)).alias("n")).scalar()
    q = exact_quantiles(reviews, "seconds", {"median_seconds": 0.5, "p90_seconds": 0.9}, ["response"])
    base = reviews.groupBy("response").agg(
        F.count(F.lit(1)).alias("reviews"), F.sum("seconds").alias("total_seconds"),
        F.avg("confidence").alias("mean_confidence"),
    ).withColumn("_all", total)
    return join_by(base, q.drop("n"), ["response"], "left").withColumn("share", F.col("reviews") / F.col("_all")).drop("_all")


def roi_sanity(px: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return px.groupBy(*by).agg(
        F.avg((F.col(value) != 0).cast("double")).alias("nonzero_fraction"), F.max(value).alias("max_value")
    )
