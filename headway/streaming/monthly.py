"""Incremental loading of counts with Structured Streaming.

New files are read once each; each micro-batch is summed and merged into a table of partitions, so that a batch that
runs again after a failure leaves the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import create_text, names_in

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(folder)


def hourly_counts(events: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Events and values per hour and type; hours close when events are later than ``lateness``."""
    hours = events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return hours.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("hour"), "event_type", "n", "value")


def load_batches(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch to its own partition of ``out``; a repeated batch replaces what it wrote before."""

    def write(batch: DataFrame, number: int) -> None:
        days = batch.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
        days.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load_finished_months(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Loads the months of ``folder`` (``ym=<month>/data`` and ``ym=<month>/manifest.json``) into partitions of ``out``.

    The stream reads manifests, which are written last: a month without one was interrupted and waits until a later run
    finds it. A month whose batch runs again replaces its own partition. Hours are summed over visits.
    """

    def write(batch: DataFrame, number: int) -> None:
        # one short text per finished month; all months of a batch are read and written together
        names = [name for (name,) in batch.select("name").distinct().collect()]
        if names:
            months = spark.read.parquet(*[name.rsplit("/", 1)[0] + "/data" for name in names])
            sums = months.groupBy("use_ym", "route", "ars", "hour").agg(F.sum("boardings").alias("boardings"))
            sums.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("use_ym").parquet(out)

    manifests = spark.readStream.format("text").schema("value string").option("wholetext", True).load(f"{folder}/ym=*/manifest.json").select(F.col("_metadata.file_path").alias("name"))
    return manifests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Ledger:
    """Batches that were committed, in order: a file per batch, created once, in a folder that all machines share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def committed(self) -> int:
        """How many batches were committed, without a gap from the first."""
        numbers = {int(n.removeprefix("batch-")) for n in names_in(self.spark, self.folder) if n.startswith("batch-")}
        done = 0
        while done in numbers:
            done += 1
        return done

    def commit(self, number: int) -> None:
        """Enters a batch; one that isn't the next fails, whether it comes too early or was committed before."""
        if number != self.committed() or not create_text(self.spark, f"{self.folder}/batch-{number:08d}", str(number)):
            raise ValueError(f"batch {number} is out of order: {self.committed()} batches are committed")


def write_in_batches(rows: DataFrame, number: Column, batches: int, out: str, ledger: Ledger, last: int | None = None) -> int:
    """Writes the rows of batch 0, 1, ... (``number``, an expression of the rows) to partitions of ``out``, from the first that
    isn't in the ledger, and enters each once it is written. ``last`` ends the run after that batch. A batch that was cut off
    before its entry is written again in its place. Returns how many batches were written."""
    numbered = rows.withColumn("batch", number.cast("int"))
    written = 0
    for k in range(ledger.committed(), batches):
        numbered.where(F.col("batch") == k).drop("batch").write.mode("overwrite").parquet(f"{out}/batch={k}")
        ledger.commit(k)
        written += 1
        if k == last:
            break
    return written
