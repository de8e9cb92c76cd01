"""Streams between the blocks of a distributed run, and what clients watch of a job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPDATE = "kind string, cell long, at timestamp, value double"


def read_updates(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """Updates that jobs append to a folder as JSON lines."""
    return spark.readStream.schema(UPDATE).option("maxFilesPerTrigger", files).json(folder)


def first_writes(updates: DataFrame, delay: str | None = None) -> DataFrame:
    """The first update of every cell; later and repeated ones are ignored.

    Without ``delay`` the state holds one key per cell of the grid, as long as the run lasts. With it,
    keys older than the watermark are forgotten: right when repeats come within that time.
    """
    values = updates.where("kind = 'V'")
    if delay is None:
        return values.dropDuplicates(["cell"])
    return values.withWatermark("at", delay).dropDuplicatesWithinWatermark(["cell"])


def for_owner(updates: DataFrame, jobs: int, job: int) -> DataFrame:
    """The updates of cells that a job owns, order modulo number of jobs."""
    return updates.where(F.pmod(F.col("cell"), F.lit(jobs)) == job)


def progress(messages: DataFrame) -> DataFrame:
    """The latest value of every job's key, from a stream (job, key, value, at)."""
    return messages.groupBy("job", "key").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))


def tail(spark: SparkSession, folder: str) -> DataFrame:
    """Log lines of all jobs as they are appended, with the job's name from the file."""
    lines = spark.readStream.text(folder)
    return lines.select(F.regexp_extract(F.col("_metadata.file_name"), r"^log_([A-Za-z0-9-]+)", 1).alias("job"), F.col("value").alias("line"))


def windowed_counts(events: DataFrame, delay: str = "1 hour", length: str = "1 day") -> DataFrame:
    """Events per type and window of event time, late ones beyond ``delay`` left out: the grid of hours as a stream."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
