"""Cross-fitted classifiers on Spark ML, one fit per spatial fold."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from surfaudit.operators.prefix import exact_quantiles
from surfaudit.session import cut_lineage


def fill_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(name, fill): the median that replaces a missing value, exact and distributed."""
    from surfaudit.operators.metrics import unpivot_scores

    return exact_quantiles(unpivot_scores(df, [], cols), "score", {"fill": 0.5}, ["name"]).select("name", "fill")


def impute_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing values replaced by the exact column median; one number per column is collected."""
    fills = {r["name"]: r["fill"] for r in fill_values(df, cols).collect()}
    return df.fillna({c: fills[c] for c in cols if fills.get(c) is not None})


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Weights that give both classes the same total: n / (2 * class count)."""
    counts = df.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count_if(label).alias("p"))).scalar()
    own = F.when(F.col(label), F.col("_c.p")).otherwise(F.col("_c.n") - F.col("_c.p"))
    return df.withColumn("_c", counts).withColumn("weight", F.try_divide("_c.n", own * 2)).drop("_c")


def _folds(df: DataFrame, label: str, fold: str) -> list[int]:
    """Fold ids that have both classes in the test part; k is a parameter, not data."""
    stats = df.where(F.col("role") == "test").groupBy(fold).agg(F.count_if(label).alias("p"), F.count(F.lit(1)).alias("n"))
    rows = stats.orderBy(fold).collect()
    poor = [r[fold] for r in rows if r["p"] in (0, r["n"])]
    if poor:
        raise ValueError(f"folds without both classes: {poor}")
    return [r[fold] for r in rows]


def crossfit(
    df: DataFrame, features: Sequence[str], label: str, fold: str, stages: Callable[[DataFrame], list], keep: Sequence[str]
) -> DataFrame:
    """Out-of-fold scores (keep, label, fold, score) for rows of (fold, role).

    Each fold trains on its train rows and scores its test rows.  Rows are written once and
    read per fold.  Features are standardised by mean and population deviation; a constant
    feature is only centred.
    """
    rows = cut_lineage(df.select(*keep, *features, label, fold, "role"))
    assemble = VectorAssembler(inputCols=list(features), outputCol="features")
    parts = []
    for f in _folds(rows, label, fold):
        train = balanced(rows.where((F.col(fold) == f) & (F.col("role") == "train")), label).withColumn(
            "y", F.col(label).cast("double")
        )
        moments = train.agg(*[g(c).alias(f"{n}_{i}") for i, c in enumerate(features) for n, g in (("m", F.avg), ("d", F.stddev_pop))]).first()
        scaled = {
            c: (F.col(c) - F.lit(moments[f"m_{i}"])) / F.lit(moments[f"d_{i}"] or 1.0) for i, c in enumerate(features)
        }
        model = Pipeline(stages=[assemble, *stages(train)]).fit(train.withColumns(scaled))
        test = rows.where((F.col(fold) == f) & (F.col("role") == "test"))
        scored = model.transform(test.withColumns(scaled)).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
        parts.append(scored.select(*keep, label, fold, "score"))
    return oof_scores(parts)


def crossfit_logistic(df, features, label, fold, keep, c: float = 1.0, max_iter: int = 200) -> DataFrame:
    """Standardised, class-balanced logistic regression with L2 strength 1 / C per total weight."""

    def stages(train: DataFrame) -> list:
        total = train.agg(F.sum("weight")).first()[0]
        return [LogisticRegression(
            featuresCol="features", labelCol="y", weightCol="weight", regParam=1.0 / (c * total), maxIter=max_iter,
            standardization=False,
        )]

    return crossfit(df, features, label, fold, stages, keep)


def crossfit_gbt(df, features, label, fold, keep, depth: int = 3, rounds: int = 10, rate: float = 0.1, seed: int = 0) -> DataFrame:
    def stages(train: DataFrame) -> list:
        return [GBTClassifier(
            featuresCol="features", labelCol="y", weightCol="weight", maxDepth=depth, maxIter=rounds, stepSize=rate, seed=seed
        )]

    return crossfit(df, features, label, fold, stages, keep)


def oof_scores(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def oof_completeness(scores: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows without exactly one finite out-of-fold score."""
    seen = scores.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("score").isNull() | F.isnan("score")).alias("bad")
    )
    return rows.select(key).join(seen, key, "left").where("n is null or n <> 1 or bad > 0").select(key)
