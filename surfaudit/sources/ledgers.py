"""Catalogs, receipts, listings and manifests, and the sinks that write results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from surfaudit.functions.scalar import interleaved
from surfaudit.session import scratch  # noqa: F401  also part of this module's interface

CATALOG = (
    "id string, scans array<struct<id: string, px: double, energy: double>>, "
    "segments array<struct<id: string, label: string, renders: array<struct<volume: string, model: string, url: string>>>>"
)
RECEIPT = (
    "schema_version string, regime string, geometry_tier string, status string, go_checks map<string, boolean>"
)


# -- scans --------------------------------------------------------------------------------


def read_regions(spark: SparkSession, path: str, schema: str, eligible: str = "eligible") -> DataFrame:
    """CSV of regions or pairs; only rows whose eligibility text is true."""
    return spark.read.csv(path, header=True, schema=schema).where(
        F.lower(F.trim(F.col(eligible).cast("string"))).isin("true", "1", "yes")
    )


def parse_catalog(text: DataFrame, column: str = "value") -> DataFrame:
    """One struct per catalog document held as text; ``spark.read.json`` gives the same shape."""
    return text.select(F.from_json(column, CATALOG).alias("c")).select("c.*")


def explode_catalog(catalog: DataFrame, part: str) -> DataFrame:
    """Rows of samples x scans, or samples x segments x renders; empty lists keep their sample."""
    if part == "scans":
        return catalog.select(F.col("id").alias("sample"), F.explode_outer("scans").alias("s")).select(
            "sample", F.col("s.id").alias("scan"), F.col("s.px").alias("px"), F.col("s.energy").alias("energy")
        )
    if part == "renders":
        segments = catalog.select(F.col("id").alias("sample"), F.explode_outer("segments").alias("g"))
        return segments.select(
            "sample", F.col("g.id").alias("segment"), F.col("g.label").alias("label"), F.explode_outer("g.renders").alias("r")
        ).select("sample", "segment", "label", "r.*")
    raise ValueError(f"unknown catalog part: {part}")


def at_resolution(scans: DataFrame, um: float) -> DataFrame:
    """Scans of one voxel size; a missing size never matches."""
    return scans.where(F.col("px").eqNullSafe(F.lit(float(um))))


def parse_receipts(text: DataFrame, column: str = "value") -> DataFrame:
    """Receipt fields and the named checks; text that is no JSON object gives NULL fields."""
    return text.withColumn("_r", F.from_json(column, RECEIPT)).select(*text.columns, "_r.*").drop(column)


def read_receipts(spark: SparkSession, glob: str) -> DataFrame:
    files = spark.read.text(glob, wholetext=True).select(F.input_file_name().alias("artifact"), "value")
    return parse_receipts(files.withColumn("sha", F.sha2("value", 256)))


def normalize_listing(raw: DataFrame) -> DataFrame:
    """(name, bytes, created) from listings with alternative field names."""
    have = lambda names: [F.col(n) if n in raw.columns else F.lit(None) for n in names]
    first = lambda *names: F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in have(names)])
    size = F.coalesce(*[c.cast("bigint") for c in have(("total_bytes", "size", "bytes"))])
    return raw.select(
        first("name", "ref", "file_name").alias("name"), size.alias("bytes"), first("creation_date", "date_created").alias("created")
    )


def listing_conflicts(listing: DataFrame) -> DataFrame:
    """Names listed more than once with different metadata."""
    return listing.groupBy("name").agg(
        F.count_distinct(F.struct(F.coalesce("bytes", F.lit(-1)), F.coalesce("created", F.lit("")))).alias("versions")
    ).where("versions > 1")


# -- chunks and files --------------------------------------------------------------------------


def fill_sparse(keys: DataFrame, chunks: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Every wanted key with its value; a chunk that is not stored counts as zero."""
    return keys.join(chunks.select(*on, value), list(on), "left").fillna(0, [value])


def verify_content(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Violations of files(path, content) against manifest(path, bytes, sha)."""
    seen = files.select("path", F.octet_length("content").alias("_n"), F.sha2(F.col("content"), 256).alias("_sha"), F.lit(True).alias("_f"))
    both = manifest.select("path", "bytes", "sha", F.lit(True).alias("_m")).join(seen, "path", "full")
    problem = (
        F.when(F.col("_m").isNull(), "unlisted")
        .when(F.col("_f").isNull(), "missing")
        .when(F.col("bytes") != F.col("_n"), "size_mismatch")
        .when(F.col("sha") != F.col("_sha"), "hash_mismatch")
    )
    return both.select("path", problem.alias("problem")).where("problem is not null")


def snapshot_hash(df: DataFrame, cols: Sequence[str], levels: Sequence[int] = (4, 2)) -> DataFrame:
    """One SHA-256 for a table's content, independent of row order and partitioning.

    Rows are hashed and counted, then folded in a tree: hashes sharing a prefix are joined in
    order and hashed again.  Prefixes of a hash are uniform, so no group is hot and none holds
    more than a small share of the rows; widen ``levels`` for more rows.
    """
    row = F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)
    leaf = df.groupBy(row.alias("h")).agg(F.count(F.lit(1)).alias("n"))
    node = leaf.select("h", F.concat_ws(":", "h", F.col("n").cast("string")).alias("text"))
    total = leaf.agg(F.sum("n")).scalar()
    for width in [*levels, 0]:
        node = node.groupBy(F.substring("h", 1, width).alias("h")).agg(
            F.sha2(F.array_join(F.array_sort(F.collect_list("text")), ","), 256).alias("digest")
        ).select("h", F.concat_ws(":", "h", "digest").alias("text"), "digest")
    return node.select("digest").withColumn("rows", total)


def pending(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work not yet in the sink."""
    return todo.join(done.select(*keys), list(keys), "left_anti")


# -- sinks ------------------------------------------------------------------------------------


def write_maps(maps: DataFrame, path: str, partitions: Sequence[str], tasks: int | None = None) -> None:
    """Per-pixel maps as parquet, in the order of a curve through the pixels of each partition folder.

    A folder is dealt over as many tasks as its share of the rows asks for, whatever its size, and
    a file holds a compact piece of it, so readers of a window skip files and row groups by the
    bounds of y and x.  Maps have columns y and x.
    """
    order = [*partitions, interleaved(F.col("y"), F.col("x"))]
    dealt = maps.repartitionByRange(tasks, *order) if tasks else maps.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).write.mode("overwrite").partitionBy(*partitions).parquet(path)


def write_report(report: DataFrame, path: str, form: str = "json") -> None:
    """Reports as JSON lines or CSV; a failed job leaves no committed output."""
    writer = report.write.mode("overwrite")
    writer.json(path) if form == "json" else writer.csv(path, header=True)
