"""Which declared view groups are really independent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from surfaudit.operators.components import connected_components
from surfaudit.operators.prefix import dense_index


def provenance_links(views: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(src, dst, field, value, reason): groups tied by a shared or missing provenance value.

    Each (field, value) links its groups to the first of them, a star in place of all pairs.  A
    missing value may equal any other, so it links every group to the first one.  A group is
    named by the order of its first view.
    """
    first = views.groupBy("grp").agg(F.min("ord").alias("g"))
    long = views.join(first, "grp").select(
        "g", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("p")
    ).select("g", "p.*").distinct()
    shared = long.where(F.col("value").isNotNull())
    hub = shared.groupBy("field", "value").agg(F.min("g").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    by_value = shared.join(hub, ["field", "value"]).where("g <> hub").select(
        F.col("g").alias("src"), F.col("hub").alias("dst"), "field", "value", F.lit("shared_value").alias("reason")
    )
    # One row per incomplete field: the fields are a parameter, so the array is short.
    gaps = long.where(F.col("value").isNull()).agg(F.sort_array(F.collect_set("field"))).scalar()
    start = first.agg(F.min("g")).scalar()
    by_gap = first.withColumn("field", F.explode(gaps)).withColumn("dst", start).where(F.col("g") != F.col("dst")).select(
        F.col("g").alias("src"), "dst", "field", F.lit(None).cast("string").alias("value"),
        F.lit("missing_provenance").alias("reason"),
    )
    return by_value.unionByName(by_gap)


def effective_groups(views: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(grp, effective): effective groups numbered by first appearance of any of their views."""
    first = views.groupBy("grp").agg(F.min("ord").alias("g"))
    merged = connected_components(provenance_links(views, fields).select("src", "dst"))
    rooted = first.join(merged.withColumnRenamed("node", "g"), "g", "left").select(
        "grp", F.coalesce("component", "g").alias("root")
    )
    order = dense_index(rooted, "root").select("root", (F.col("idx") + 1).alias("effective"))
    return rooted.join(order, "root").select("grp", "effective")


def independence_audit(views: DataFrame, fields: Sequence[str], min_groups: int = 2) -> DataFrame:
    """Declared and effective group counts and the gate, one row."""
    if min_groups < 2 or not fields:
        raise ValueError("at least one field and two groups are required")
    return effective_groups(views, fields).agg(
        F.count(F.lit(1)).alias("declared_groups"), F.max("effective").alias("effective_groups")
    ).withColumn("passed", F.col("effective_groups") >= min_groups)
