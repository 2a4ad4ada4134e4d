"""Job states: the batch state machine and the same as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINAL = ("done", "error")


def latest(jobs: DataFrame) -> DataFrame:
    """Per job: its last state, by time and event; partial aggregates before the shuffle."""
    return jobs.groupBy("job_id").agg(F.max(F.struct("ts", "event_id", "status")).alias("m"), F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("first_ts")).select("job_id", F.col("m.status").alias("status"), F.col("m.ts").alias("last_ts"), "n_events", "first_ts")


def survivors(jobs: DataFrame) -> DataFrame:
    """What a restart restores: jobs that are done."""
    return latest(jobs).where("status = 'done'")


def starts(jobs: DataFrame, window: str = "1 hour") -> DataFrame:
    """The first start of a job within each window; later ones name the same start."""
    s = jobs.where("status = 'queued'").withColumn("w", F.window("ts", window).getField("start"))
    return s.groupBy("job_id", "w").agg(F.min("event_id").alias("start_id"), F.count(F.lit(1)).alias("n_starts"))


def windowed_counts(jobs: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """States per window, for streams with a watermark and for batches alike."""
    return jobs.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "status").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), "status", "n")


def event_stream(spark, sf_dir: str) -> DataFrame:
    """The events of a folder of tables as a stream; files of other tables are not read."""
    from lithos.session import read_table

    schema = read_table(spark, sf_dir, "events").schema
    # a stream reads folders or patterns, so a pattern names the one table, be it a file or a folder
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


def stream_counts(spark, sf_dir: str) -> DataFrame:
    """The events as a stream through windowed_counts, drained once; the result has a row per day and state.

    Only changed windows are written, so the watermark ends the state of old ones; the latest count of a window wins.
    """
    import uuid

    from lithos.session import shared_base
    from lithos.streaming.poller import drained

    status = F.expr("CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'done' ELSE 'error' END")
    jobs = event_stream(spark, sf_dir).select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("job_id"), status.alias("status"))
    table = f"{shared_base(spark)}/job-counts-{uuid.uuid4().hex}"
    drained(windowed_counts(jobs), table, "update")
    rows = spark.read.schema("day timestamp, status string, n long, batch long").parquet(table)
    return rows.groupBy("day", "status").agg(F.max_by("n", "batch").alias("n"))


def polled(spark, sf_dir: str) -> DataFrame:
    """The events as the jobs of their users' documents through the poller."""
    import uuid

    from lithos.session import shared_base
    from lithos.streaming.poller import poll

    kind = F.expr("CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'done' ELSE 'missing' END")
    rows = event_stream(spark, sf_dir).select(F.col("user_id").cast("long").alias("document_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"), kind.alias("kind"), F.lit(None).cast("string").alias("message"))
    return poll(spark, rows, f"{shared_base(spark)}/polled-{uuid.uuid4().hex}", "10 days", "1 day")
