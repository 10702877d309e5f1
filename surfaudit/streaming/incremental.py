"""Process arriving chunk files once, with restartable progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def arrivals(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", files_per_batch: int = 64) -> DataFrame:
    """Stream over a folder of parquet files, a bounded number per batch."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def run_incremental(stream: DataFrame, op: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> None:
    """Apply a stateless operator to what has arrived since the last run and append the result.

    The file sink's log and the checkpoint make a rerun after a failure exactly once.
    """
    query = (
        op(stream).writeStream.format("parquet").outputMode("append").option("path", sink)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_with_progress(
    stream: DataFrame, op: Callable[[DataFrame], DataFrame], sink: str, log: str, checkpoint: str, size: str
) -> None:
    """The same through foreachBatch, with one progress row per batch.

    Output and progress of a batch go to a folder named by its number, so a repeated batch
    replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        out = op(batch)
        out.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        done = batch.sparkSession.read.parquet(f"{sink}/batch={number}")
        done.agg(F.count(F.lit(1)).alias("done"), F.coalesce(F.sum(size), F.lit(0.0)).alias("verified")).write.mode(
            "overwrite"
        ).parquet(f"{log}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def progress(spark: SparkSession, log: str, total: DataFrame) -> DataFrame:
    """Batches, rows done, verified size and the share of the total."""
    n = total.agg(F.count(F.lit(1))).scalar()
    return spark.read.parquet(log).agg(
        F.count(F.lit(1)).alias("batches"), F.sum("done").alias("done"), F.sum("verified").alias("verified")
    ).withColumn("total", n).withColumn("fraction", F.try_divide("done", "total"))
