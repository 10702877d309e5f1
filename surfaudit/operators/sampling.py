"""Seeded samples, matched pairs, folds and block bootstraps.

Random streams are replaced by a portable hash order or an explicit draw formula, so a seed
gives the same rows on any engine and any partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from surfaudit.functions.scalar import floor_div, lit
from surfaudit.operators.metrics import rank_metrics, score_counts
from surfaudit.operators.prefix import dense_index, quantiles_of_counts
from surfaudit.operators.ranking import rank_rows
from surfaudit.operators.windows import contiguous_folds
from surfaudit.session import cut_lineage


def hash_order(seed: int, *keys: Column) -> Column:
    """52 bits of SHA-256 over seed and keys: a portable pseudo-random order."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("bigint")


# -- samples ------------------------------------------------------------------------------


def stratified_sample(df: DataFrame, col: str, lo: float, hi: float, width: float, n: int, seed: int, key: str) -> DataFrame:
    """About n rows spread over fixed-width bins of [lo, hi): ceil(n / bins) each, trimmed to n."""
    from surfaudit.operators.windows import rank_within

    inside = df.where((F.col(col) >= lit(lo)) & (F.col(col) < lit(hi))).withColumn(
        "bin", F.floor((F.col(col) - lit(lo)) / lit(width)).cast("int")
    ).withColumn("_h", hash_order(seed, F.col(key)))
    # No bin ever needs more than n rows; each task keeps at most n per bin before the shuffle.
    best = rank_within(inside, ["bin"], ["_h", key], n)
    bins = inside.agg(F.count_distinct("bin")).scalar()
    take = F.ceil(lit(n) / F.greatest(F.col("_bins"), F.lit(1)))
    chosen = best.withColumn("_bins", bins).where(F.col("rank") <= take)
    return chosen.orderBy("_h", key).limit(n).drop("_h", "_bins", "rank")


def balanced_per_block(df: DataFrame, label: str, block: Sequence[str], max_n: int, seed: int, key: Sequence[str]) -> DataFrame:
    """Per block the same number of positives and controls: min(max_n, positives, controls)."""
    from surfaudit.operators.windows import rank_within

    block = list(block)
    ranked = rank_within(
        df.withColumn("_h", hash_order(seed, *[F.col(k) for k in key])), [*block, label], ["_h", *key], max_n
    )
    counts = df.groupBy(*block).agg(
        F.least(F.count_if(F.col(label)), F.count_if(~F.col(label)), F.lit(max_n)).alias("_take")
    )
    return ranked.join(counts, block).where(F.col("rank") <= F.col("_take")).drop("_h", "_take")


def annulus_pairs(
    positives: DataFrame, controls: DataFrame, block: int, dmin: int, dmax: int, max_n: int, attempts: int, seed: int
) -> DataFrame:
    """Local control per positive: distance in [dmin, dmax], same block, each control once.

    Every positive draws ``attempts`` seeded offsets in order and takes its first free control;
    earlier positives (hash order) go first.  At most max_n pairs per block, the earliest ones.
    Pairs never leave a block, so blocks are served apart: a task holds the pixels of one block,
    block * block at most, and a positive is shuffled once with the places it draws.
    """
    span, place = 2 * dmax + 1, {"by": "y", "bx": "x"}
    known = F.col("y").isNotNull() & F.col("x").isNotNull()
    keys = [floor_div(F.col(c), block).cast("bigint").alias(k) for k, c in place.items()]

    def code(r: Column) -> Column:
        """The place that a draw leads to, counted within the block; NULL if it is no place for a control."""
        cy = F.col("y") + r % span - dmax
        cx = F.col("x") + F.floor(r / span) % span - dmax
        same = (floor_div(cy, block) == F.col("by")) & (floor_div(cx, block) == F.col("bx"))
        distance = F.sqrt((cy - F.col("y")) ** 2 + (cx - F.col("x")) ** 2)
        return F.when(distance.between(dmin, dmax) & same, (cy - F.col("by") * block) * block + cx - F.col("bx") * block)

    draws = F.transform(
        F.sequence(F.lit(0), F.lit(attempts - 1)), lambda i: code(hash_order(seed + 1, F.col("y"), F.col("x"), i)).cast("bigint")
    )
    wishes = positives.where(known).select("y", "x", *keys).select(
        "*", hash_order(seed, F.col("y"), F.col("x")).alias("ord"), F.array_compact(draws).alias("wishes")
    ).where(F.size("wishes") > 0)
    free = controls.where(known).select("y", "x", *keys).select(
        "by", "bx", ((F.col("y") - F.col("by") * block) * block + F.col("x") - F.col("bx") * block).cast("bigint").alias("at")
    )

    def serve(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        """The sequential rule in one block."""
        left, served, rows, places = set(theirs.column("at").to_pylist()), set(), [], []
        ys, xs, lists = (mine.column(c).to_pylist() for c in ("y", "x", "wishes"))
        for i in sorted(range(len(mine)), key=list(zip(mine.column("ord").to_pylist(), ys, xs)).__getitem__):
            if len(rows) == max_n or not left:
                break
            found = None if (ys[i], xs[i]) in served else next((w for w in lists[i] if w in left), None)
            served.add((ys[i], xs[i]))
            if found is not None:
                left.remove(found)
                rows.append(i)
                places.append(found)
        out = mine.select(["y", "x", "by", "bx"]).take(pa.array(rows, pa.int64()))
        return out.append_column("at", pa.array(places, pa.int64()))

    kinds = dict(positives.dtypes)
    schema = f"y {kinds['y']}, x {kinds['x']}, by bigint, bx bigint, at bigint"
    pairs = wishes.groupBy("by", "bx").cogroup(free.groupBy("by", "bx")).applyInArrow(serve, schema)
    cy, cx = F.floor(F.col("at") / block) + F.col("by") * block, F.col("at") % block + F.col("bx") * block
    return pairs.select("y", "x", cy.cast("int").alias("cy"), cx.cast("int").alias("cx"), "by", "bx").withColumn(
        "distance", F.sqrt((F.col("cy") - F.col("y")) ** 2 + (F.col("cx") - F.col("x")) ** 2)
    ).select("y", "x", "cy", "cx", "distance", "by", "bx")


def caliper_match(a: DataFrame, b: DataFrame, col: str, caliper: float, key: str = "id") -> DataFrame:
    """Maximal one-to-one matching of a and b rows whose values differ by at most the caliper.

    Values fall in cells of caliper width.  Rows of one cell pair by rank; what is left of a
    cell lies on one side only and pairs with the next cell outward from their common border.
    After the three phases no free a and b are within the caliper of each other.  Ranks are
    prefix sums, so a hot cell or value is never sorted in one task.
    """
    side = lambda df, s: df.where(F.col(col).isNotNull()).select(
        F.col(key).alias(f"id_{s}"), F.col(col).cast("double").alias("value"),
        F.floor(F.col(col) / lit(caliper)).cast("bigint").alias("cell"),
    )
    left, right, found = side(a, "a"), side(b, "b"), []
    # Phases: (shift of the b cell, order of a, order of b): same cell, b above, b below.
    for shift, a_desc, b_desc in ((0, False, False), (1, True, False), (-1, False, True)):
        ra = rank_rows(left, "value", "id_a", ["cell"], a_desc).withColumnRenamed("value", "value_a")
        rb = rank_rows(
            right.withColumn("cell", F.col("cell") - shift), "value", "id_b", ["cell"], b_desc
        ).withColumnRenamed("value", "value_b")
        gap = F.abs(F.col("value_a") - F.col("value_b"))
        pairs = ra.join(rb, ["cell", "rank"]).withColumn("delta", gap).where(F.col("delta") <= lit(caliper))
        pairs = cut_lineage(pairs.select("id_a", "id_b", "delta"))
        found.append(pairs)
        left = cut_lineage(left.join(pairs.select("id_a"), "id_a", "left_anti").select("id_a", "value", "cell"))
        right = cut_lineage(right.join(pairs.select("id_b"), "id_b", "left_anti").select("id_b", "value", "cell"))
    return found[0].unionAll(found[1]).unionAll(found[2])


# -- folds ----------------------------------------------------------------------------------


def checkerboard(df: DataFrame, block: int, k: int, holdout: int, y: str = "v", x: str = "u") -> DataFrame:
    fold = F.pmod(floor_div(F.col(y), block) + floor_div(F.col(x), block), F.lit(k))
    return df.withColumn("fold", fold).withColumn("holdout", F.col("fold") == holdout)


def spatial_group(df: DataFrame, size: int, k: int, seed: int, axes: Sequence[str] = ("z", "y", "x")) -> DataFrame:
    """Spatial group key and the fold it hashes to; a group never spans folds."""
    key = F.concat_ws("_", *[floor_div(F.col(a), size).cast("string") for a in axes])
    return df.withColumn("group_key", key).withColumn("fold", (hash_order(seed, F.col("group_key")) % k).cast("int"))


def buffered_folds(df: DataFrame, key: str, k: int, buffer: int) -> DataFrame:
    """(row, fold, role) for k contiguous test strips; rows within the buffer of a strip drop out.

    The k strip ranges travel as one small array.
    """
    folds = contiguous_folds(df.select(key), key, k)
    strips = folds.groupBy("fold").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    table = strips.agg(F.collect_list(F.struct("fold", "lo", "hi")).alias("s")).scalar()
    v = F.col(key)
    each = df.withColumn("_s", table).select(*df.columns, F.explode("_s").alias("s"))
    test = (v >= F.col("s.lo")) & (v <= F.col("s.hi"))
    far = (v < F.col("s.lo") - buffer) | (v > F.col("s.hi") + buffer)
    return each.select(
        *df.columns, F.col("s.fold").alias("fold"),
        F.when(test, "test").when(far, "train").otherwise("buffer").alias("role"),
    )


def blinded_order(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Seeded permutation with blind ids."""
    ranked = rank_rows(df.withColumn("_h", hash_order(seed, F.col(key))), "_h", key, descending=False)
    return ranked.withColumn("blind_id", F.format_string("B%03d", F.col("rank"))).drop("_h")


# -- bootstrap --------------------------------------------------------------------------------


def draw_weights(blocks: DataFrame, key: str, reps: int, seed: int) -> DataFrame:
    """(rep, key, w): how often each replicate draws each block, with replacement.

    Slot s of replicate r draws block h(r * 7919 + s * 104729 + seed) mod n with a quadratic
    congruential h; a linear one would permute the blocks.
    """
    p = 2147483647
    numbered = dense_index(blocks, key)
    n = numbered.agg(F.max("n_keys")).first()[0] or 0
    # A range has a known size; draws made by exploding a few rows would be taken for few, and broadcast.
    drawn = blocks.sparkSession.range(reps * n)
    rep, slot = F.floor(F.col("id") / F.lit(n)).cast("bigint"), F.col("id") % n
    k = F.pmod(rep * 7919 + slot * 104729 + seed, F.lit(p))
    idx = (((k * k) % p) * 48271 % p) % F.lit(n)
    weights = drawn.select(rep.alias("rep"), idx.alias("idx")).groupBy("rep", "idx").agg(F.count(F.lit(1)).alias("w"))
    return weights.join(numbered.select("idx", key), "idx").select("rep", key, "w")


def resample(
    counts: DataFrame, block: str, keys: Sequence[str], reps: int, seed: int, at_once: int = 1024
) -> DataFrame:
    """(rep, keys, n, pos): collapsed block counts added up with their draw weights.

    The count rows of a hot block are dealt by a hash of their keys into parts of about
    ``at_once``, and its weights, at most one per replicate, are repeated for each part.
    """
    counts = cut_lineage(counts)
    parts = counts.groupBy(block).agg(F.ceil(F.count(F.lit(1)) / at_once).cast("int").alias("_parts"))
    weights = draw_weights(parts.select(block), block, reps, seed)
    salted = counts.join(parts, block).withColumn("_salt", F.pmod(F.xxhash64(*keys), F.col("_parts")).cast("int")).drop("_parts")
    spread = weights.join(parts, block).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return spread.join(salted, [block, "_salt"]).groupBy("rep", *keys).agg(
        F.sum(F.col("w") * F.col("n")).alias("n"), F.sum(F.col("w") * F.col("pos")).alias("pos")
    )


def interval(values: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """95 % interval over replicates (their number is a parameter); undefined ones are skipped."""
    pct = F.percentile(col, [0.025, 0.975])
    return values.where(F.col(col).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("valid_replicates"), pct.alias("_p"), F.avg(col).alias("mean")
    ).select(*by, "valid_replicates", F.get("_p", F.lit(0)).alias("low"), F.get("_p", F.lit(1)).alias("high"), "mean")


def ap_metric(counts: DataFrame) -> DataFrame:
    return rank_metrics(counts, ["rep"]).select("rep", F.col("ap").alias("value"))


def block_bootstrap(
    df: DataFrame, label: str, score: str, block: str, reps: int, seed: int,
    metric: Callable[[DataFrame], DataFrame] = ap_metric,
) -> DataFrame:
    """Interval of a metric over resampled blocks.

    ``metric`` maps (rep, score, n, pos) to (rep, value), so any user metric plugs in.
    """
    per = score_counts(df, label, score, [block])
    return interval(metric(resample(per, block, ["score"], reps, seed)), "value")


def mean_bootstrap(df: DataFrame, unit: str, col: str, reps: int, seed: int) -> DataFrame:
    """Interval of the mean of unit means."""
    means = cut_lineage(df.groupBy(unit).agg(F.avg(col).alias("m")).where("m is not null"))
    drawn = draw_weights(means.select(unit), unit, reps, seed).join(means, unit)
    values = drawn.groupBy("rep").agg((F.sum(F.col("w") * F.col("m")) / F.sum("w")).alias("value"))
    return interval(values, "value")


def paired_bootstrap(df: DataFrame, label: str, candidate: str, baseline: str, block: str, reps: int, seed: int) -> DataFrame:
    """Intervals of AUC and AP differences between two scores on the same resampled blocks."""
    from surfaudit.operators.metrics import unpivot_scores

    long = unpivot_scores(df, [label, block], [candidate, baseline])
    per = score_counts(long, label, "score", [block, "name"])
    both = rank_metrics(resample(per, block, ["name", "score"], reps, seed), ["rep", "name"])
    pick = lambda c, n: F.max(F.when(F.col("name") == n, F.col(c)))
    diff = both.groupBy("rep").agg(
        (pick("auc", candidate) - pick("auc", baseline)).alias("auc"),
        (pick("ap", candidate) - pick("ap", baseline)).alias("ap"),
    )
    long_diff = diff.select(F.explode(F.array(
        F.struct(F.lit("auc").alias("metric"), F.col("auc").alias("value")),
        F.struct(F.lit("ap").alias("metric"), F.when(F.col("auc").isNotNull(), F.col("ap")).alias("value")),
    )).alias("m")).select("m.*")
    return interval(long_diff, "value", ["metric"])


def gain_bootstrap(df: DataFrame, label: str, block: str, fraction: float, reps: int, seed: int) -> DataFrame:
    """Intervals of the fusion AP gain and the abstention AP gain (columns s0, s1).

    Replicates are weighted (s0, s1) counts; the disagreement cut is a weighted quantile per
    replicate.  A replicate counts only if both classes survive before and after abstention.
    """
    per = df.groupBy(block, "s0", "s1").agg(F.count(F.lit(1)).alias("n"), F.count_if(label).alias("pos"))
    rep = cut_lineage(resample(per, block, ["s0", "s1"], reps, seed))
    d = F.abs(F.col("s0") - F.col("s1"))
    counts = rep.groupBy("rep", d.alias("value")).agg(F.sum("n").alias("n"))
    cut = quantiles_of_counts(counts, {"cut": 1 - fraction}, ["rep"]).select("rep", "cut")
    fused = (F.col("s0") + F.col("s1")) / lit(2)
    parts = rep.join(cut, "rep").select(
        "rep", "n", "pos",
        F.explode(F.array(
            F.struct(F.lit("s0").alias("name"), F.col("s0").alias("score")),
            F.struct(F.lit("s1").alias("name"), F.col("s1").alias("score")),
            F.struct(F.lit("fused").alias("name"), fused.alias("score")),
            F.when(d <= F.col("cut"), F.struct(F.lit("kept").alias("name"), fused.alias("score"))),
        )).alias("p"),
    ).where("p is not null").select("rep", "p.name", "p.score", "n", "pos")
    summed = parts.groupBy("rep", "name", "score").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    ap = rank_metrics(summed, ["rep", "name"], both_classes=True)
    pick = lambda n: F.max(F.when(F.col("name") == n, F.col("ap")))
    gains = ap.groupBy("rep").agg(
        (pick("fused") - F.greatest(pick("s0"), pick("s1"))).alias("fusion"), (pick("kept") - pick("fused")).alias("abstention")
    ).where("fusion is not null and abstention is not null")
    long = gains.select(F.explode(F.array(
        F.struct(F.lit("fusion").alias("gain"), F.col("fusion").alias("value")),
        F.struct(F.lit("abstention").alias("gain"), F.col("abstention").alias("value")),
    )).alias("g")).select("g.*")
    return interval(long, "value", ["gain"])
