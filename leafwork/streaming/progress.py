"""Progress events: the latest state of each stage of a job, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stage_state(events: DataFrame) -> DataFrame:
    """job_id, stage, done, total, sent_at, n_events: the state of each stage by its latest event that names it, fields
    that an event leaves out keep their latest value; repeated events count once. Null times come first."""
    one = events.select("job_id", "stage", "done", "total", "sent_at").distinct().filter("stage IS NOT NULL")
    pick = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("sent_at", F.col(c)))).alias(c)
    return one.groupBy("job_id", "stage").agg(pick("done"), pick("total"), F.max("sent_at").alias("sent_at"), F.count("*").alias("n_events"))


def unfinished(events: DataFrame) -> DataFrame:
    """job_id, stage, done, total of the stages that haven't reached their total; an unknown total is unfinished."""
    return stage_state(events).filter("total IS NULL OR done IS NULL OR done < total").select("job_id", "stage", "done", "total")


def progress_stream(events: DataFrame, late: str = "2 days", window: str = "1 day") -> DataFrame:
    """Events per stage and window of sending time, for append output: an event that comes later than ``late`` after the
    latest one seen is left out, repeats are dropped within that time."""
    one = events.withWatermark("sent_at", late).dropDuplicatesWithinWatermark(["job_id", "stage", "done", "sent_at"])
    return one.groupBy(F.window("sent_at", window).alias("w"), "stage").agg(F.count("*").alias("n_events"), F.max("done").alias("most_done")).select(F.col("w.start").alias("day"), "stage", "n_events", "most_done")
