"""Streaming forms: deduplication within a watermark, sliding and session windows, and the micro-batch cycle."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.plans.catalog import query
from ripplegraph.session import checkpoint_dir


def event_stream(spark: SparkSession, sf_dir: str, most_files: int | None = None) -> DataFrame:
    """The events table as a stream of files; event time as TIMESTAMP, which watermarks need.

    With `most_files` a batch takes so many new files; the others wait in the source for the next one.
    """
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # A file source reads a folder: the parent one, with a filter on the name, or the table's own folder.
    probe = spark.read.parquet(path).inputFiles()
    single = probe and probe[0].rstrip("/").endswith("/events.parquet")
    reader = spark.readStream.schema(schema)
    if most_files is not None:
        reader = reader.option("maxFilesPerTrigger", most_files)
    stream = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if single else reader.parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def run_once(stream: DataFrame, mode: str, folder: str | None = None) -> DataFrame:
    """Run a streaming query over what is there (available now) into a Parquet table, and read that.

    Given the folder of an earlier run, it goes on where that one stopped: only what is new is read.
    """
    spark = stream.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    query_ = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query_.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def dedup_stream(events: DataFrame, key: list[str], delay: str = "7 days") -> DataFrame:
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)


def for_each_batch(stream: DataFrame, stage: Callable[[DataFrame, int], None], folder: str | None = None) -> None:
    """The micro-batch cycle: each batch goes through `stage`, whose writes must be idempotent per batch number. A folder given again resumes."""
    folder = folder or f"{checkpoint_dir(stream.sparkSession)}/cycle-{uuid.uuid4().hex}"
    stream.writeStream.foreachBatch(stage).option("checkpointLocation", folder).trigger(availableNow=True).start().awaitTermination()


@query("SELECT event_id, user_id FROM events")
def stream_dedup_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event twice in the stream, once out of it."""
    twice = event_stream(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return run_once(dedup_stream(twice, ["event_id"]).select("event_id", "user_id"), "append")


def sliding(events: DataFrame, length: str = "7 days", every: str = "1 day") -> DataFrame:
    """Counts and sums by event type over sliding windows of ts (a TIMESTAMP); the same for a batch and, with a watermark, for a stream."""
    w = F.window("ts", length, every)
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), (cents / 100).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("""SELECT date_trunc('day', ts)::TIMESTAMP - INTERVAL (k) DAY AS start, event_type, count(*) AS n, sum(round(value * 100)::BIGINT) / 100 AS total FROM events CROSS JOIN range(7) r(k) GROUP BY ALL""")
def sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliding(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS stop, count(*) AS n FROM r GROUP BY user_id, run""")
def session_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events less than six hours apart; session windows merge map-side, so a busy user is no one task's list."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("stop"), "n")


def status_stream(attempts: DataFrame, most: int = 3) -> DataFrame:
    """event, attempts, status after each batch: queued, traced on a success (for good), failed after `most` failures.

    `attempts` is a stream of (event, ok). State is two numbers an event, kept by Spark across batches and lost executors.
    """

    def step(key, batches, state):
        tries, done = state.get if state.exists else (0, False)
        for rows in batches:
            for ok in rows["ok"]:
                if not done and tries < most:
                    tries, done = tries + 1, bool(ok)
        state.update((tries, done))
        yield pd.DataFrame({"event": [key[0]], "attempts": [tries], "status": ["traced" if done else "failed" if tries >= most else "queued"]})

    return attempts.groupBy("event").applyInPandasWithState(step, "event long, attempts long, status string", "tries long, done boolean", "update", "NoTimeout")


def cycle(stages: list[tuple[str, Callable[[DataFrame], None]]]) -> Callable[[DataFrame, int], None]:
    """A batch function for `for_each_batch` that runs the stages in order; those after a failed one still run, then the batch fails, to be tried again."""

    def run(batch: DataFrame, number: int) -> None:
        failed = []
        for name, stage in stages:
            try:
                stage(batch)
            except Exception as error:
                failed.append(f"{name}: {error}")
        if failed:
            raise RuntimeError(f"batch {number}: {'; '.join(failed)}")

    return run
