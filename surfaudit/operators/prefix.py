"""Distributed prefix sums, and the rank and quantile operators built on them.

``Window.orderBy`` without ``partitionBy`` sends every row to one task.  Here rows
are first collapsed to one per distinct value, the values are cut into ordered
buckets, and the window runs inside a bucket; only the bucket totals (one row per
bucket and group) are summed in sequence.  A row's bucket depends on its
value alone, so a lost executor recomputes exactly the same buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

RADIX = 8  # split points are searched digit by digit in base RADIX


def bucket_digits(df: DataFrame) -> int:
    """Digits of the bucket number: about as many buckets as the cluster shuffles partitions."""
    wanted = df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")
    digits = 1
    while RADIX**digits < (int(wanted) if wanted.isdigit() else 200):
        digits += 1
    return digits


def group_key(by: Sequence[str]) -> Column:
    """One never-null key for the columns ``by``: structs are equal where both sides are NULL."""
    return F.struct(*[F.col(c) for c in by]) if by else F.lit(0)


def join_by(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner", on: Sequence[str] = ()) -> DataFrame:
    """Equi-join on ``by`` that keeps NULL groups together, and on the never-null columns ``on``."""
    l = left.withColumn("_by", group_key(by))
    r = right.withColumn("_by", group_key(by)).drop(*by)
    if not by and on:
        return left.join(right, list(on), how)
    return l.join(r, ["_by", *on], how).drop("_by")


def split_bucket(df: DataFrame, order: str, bounds: Column, digits: int, name: str = "_bucket") -> DataFrame:
    """Adds column ``name``: the number of split points below the value, found by radix search.

    Plain comparisons stay inside generated code, unlike a filter over the array.  The result
    is never NULL, or a not-null filter on it would be pushed down to the raw rows.
    """
    out = df.withColumn("_bounds", bounds).withColumn(name, F.lit(0))
    step = RADIX**digits
    while step > 1:
        step //= RADIX
        digit = F.lit(0)
        for k in range(1, RADIX):
            bound = F.get("_bounds", F.col(name) + (k * step - 1))
            digit = digit + F.when(bound < F.col(order), 1).otherwise(0)
        out = out.withColumn(name, F.col(name) + digit * step)
    return out.withColumn(name, F.coalesce(name, F.lit(0))).drop("_bounds")


def value_counts(
    df: DataFrame, value: str, by: Sequence[str] = (), weight: str | None = None, **sums: Column
) -> DataFrame:
    """One row per (group, value) with ``n`` and further sums; NULL and NaN values drop out.

    A weight repeats a row that many times.
    """
    v = F.col(value).cast("double")
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return (
        df.where(v.isNotNull() & ~F.isnan(v))
        .groupBy(*by, v.alias("value"))
        .agg(n.alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])
    )


def prefix_sum(
    df: DataFrame,
    order: str,
    cols: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    digits: int | None = None,
) -> DataFrame:
    """Add ``cum_<col>`` (inclusive) and ``total_<col>`` along ``order`` within ``by``.

    ``df`` holds one row per (by, order); a NULL group is a group of its own.  The RADIX ** digits - 1 split points come from an
    approximate-quantile subquery, a single row.
    """
    by = list(by)
    digits = digits or bucket_digits(df)
    buckets = RADIX**digits
    probs = [i / buckets for i in range(1, buckets)]
    # The filter is always true in effect; it keeps every column alive so that the subquery and
    # the main plan share one shuffle of ``df`` instead of computing it twice.
    whole = df.where(F.xxhash64(*df.columns) != 0)
    bounds = whole.agg(F.percentile_approx(order, probs, max(1000, 8 * buckets)).alias("b")).scalar()
    cut = split_bucket(df, order, bounds, digits).withColumn("_by", group_key(by))

    direction = F.desc if descending else F.asc
    totals = cut.groupBy("_by", "_bucket").agg(*[F.sum(c).alias(f"_s_{c}") for c in cols])
    # One row per bucket and group reaches these windows.
    group = W.partitionBy("_by")
    before = group.orderBy(direction("_bucket")).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "_by",
        "_bucket",
        *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in cols],
        *[F.sum(f"_s_{c}").over(group).alias(f"total_{c}") for c in cols],
    )
    inside = (
        W.partitionBy("_by", "_bucket")
        .orderBy(direction(order))
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return (
        cut.join(offsets, ["_by", "_bucket"])
        .select(
            *df.columns,
            *[(F.col(f"_o_{c}") + F.sum(c).over(inside)).alias(f"cum_{c}") for c in cols],
            *[f"total_{c}" for c in cols],
        )
    )


def exact_quantiles(
    df: DataFrame, value: str, qs: dict[str, float], by: Sequence[str] = (), weight: str | None = None, **extra: Column
) -> DataFrame:
    """Linear-interpolated quantiles of unbounded groups, one row per group.

    Spark's ``percentile`` keeps every distinct value of a group in one task; here each
    position is read off the distributed cumulative counts instead.
    """
    return quantiles_of_counts(value_counts(df, value, by, weight), qs, by, **extra)


def quantiles_of_counts(
    counts: DataFrame, qs: dict[str, float], by: Sequence[str] = (), **extra: Column
) -> DataFrame:
    """The same from (by, value, n), where n may be a weight.

    ``extra`` aggregates over (value, n) ride along in the same pass.
    """
    ranked = prefix_sum(counts.select(*by, "value", "n"), "value", ["n"], by)
    picks, out = [], []
    for name, q in qs.items():
        h = (F.col("total_n") - 1) * F.lit(float(q))
        picks += [
            F.min(F.when(F.col("cum_n") > F.floor(h), F.col("value"))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("cum_n") > F.ceil(h), F.col("value"))).alias(f"_hi_{name}"),
        ]
        g = (F.col("n") - 1) * F.lit(float(q))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (g - F.floor(g))).alias(name))
    riders = [c.alias(k) for k, c in extra.items()]
    return ranked.groupBy(*by).agg(F.sum("n").alias("n"), *picks, *riders).select(*by, "n", *out, *extra)


def quantile_column(df: DataFrame, value: str, q: float, weight: str | None = None) -> Column:
    """One global quantile as a scalar subquery, usable in any expression."""
    return exact_quantiles(df, value, {"q": q}, weight=weight).select("q").scalar()


def hist_percentile(df: DataFrame, value: str, qs: dict[str, float]) -> DataFrame:
    """Nearest-rank percentile of an integer histogram: first bin whose count reaches q(n-1)+1."""
    ranked = prefix_sum(value_counts(df, value), "value", ["n"])
    picks = [
        F.min(
            F.when(F.col("cum_n") >= F.lit(float(q)) * (F.col("total_n") - 1) + 1, F.col("value"))
        ).cast("bigint").alias(name)
        for name, q in qs.items()
    ]
    return ranked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *picks).select(
        "n", *[F.coalesce(F.col(name), F.lit(0)).alias(name) for name in qs]
    )


def value_ranks(df: DataFrame, value: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Average rank of each distinct value: rows below it plus (ties + 1) / 2."""
    ranked = prefix_sum(value_counts(df, value, by, weight), "value", ["n"], by)
    return ranked.select(
        *by,
        F.col("value").alias(value),
        "n",
        (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2).alias("avg_rank"),
    )


def dense_index(df: DataFrame, key: str) -> DataFrame:
    """Distinct numeric keys numbered 0.. in order, and their total count."""
    keys = df.select(F.col(key)).distinct().withColumn("_one", F.lit(1).cast("bigint"))
    return prefix_sum(keys, key, ["_one"]).select(
        key, (F.col("cum__one") - 1).alias("idx"), F.col("total__one").alias("n_keys")
    )
