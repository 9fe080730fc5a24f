"""Streams of extracted questions: redelivery dropped, windowed counts, registry kept by foreachBatch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemloom.operators.registry import reconcile
from stemloom.session import materialize
from stemloom.sources import versions


def stream_table(spark: SparkSession, folder: str, like: DataFrame, per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def once_each(stream: DataFrame, key: str, time: str, delay: str = "30 days") -> DataFrame:
    """Each key once within the watermark: redelivered rows differ from the first only in their load time."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def arrivals(stream: DataFrame, time: str, window: str = "1 day", delay: str = "30 days", by: str | None = None) -> DataFrame:
    """Rows per window (and column) of the event time; late rows count while the watermark allows."""
    keys = [F.window(time, window).alias("w"), *([F.col(by)] if by else [])]
    return stream.withWatermark(time, delay).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *([by] if by else []), "n")


def follow_registry(stream: DataFrame, registry_path: str, checkpoint: str, dataset: str = "dataset"):
    """Start a query that reconciles whole scans with the registry at registry_path.

    stream: scan_id, path, hash, n_files; a scan may come in any number of files and batches, so rows wait in a table until
    the scan has as many as its n_files says (null hashes count).  Whole scans are taken in order of scan_id, each published as one
    version (stemloom.sources.versions), with its scan_id in the rows, so a repeated
    batch changes nothing; a scan that becomes whole after a later one was taken is left out.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        waiting = f"{registry_path}/waiting"
        batch.select("scan_id", "path", "hash", "n_files", F.lit(number).alias("batch")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(waiting)
        rows = spark.read.parquet(waiting).select("scan_id", "path", "hash", "n_files").distinct()
        known = versions.current(spark, f"{registry_path}/registry")
        done = known.agg(F.max("scan_id")).first()[0] if known is not None else None
        whole = rows.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"), F.max("n_files").alias("of")).where("n >= of")
        if done is not None:
            whole = whole.where(F.col("scan_id") > done)
        for r in whole.select("scan_id").orderBy("scan_id").toLocalIterator():  # scans that became whole, a few a batch
            old = versions.current(spark, f"{registry_path}/registry")
            old = old.drop("scan_id", "presence", "change") if old is not None else spark.createDataFrame([], "source_id string, path string, history array<string>, hash string, revision int")
            new, _ = reconcile(old, rows.where(F.col("scan_id") == r["scan_id"]).select("path", "hash"), dataset)
            versions.publish(materialize(new.withColumn("scan_id", F.lit(r["scan_id"]))), f"{registry_path}/registry")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
