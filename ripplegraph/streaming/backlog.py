"""A queue with a budget: a cycle takes the most urgent events up to a number and a time; the others stay eligible, with their age."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplegraph.plans.catalog import query
from ripplegraph.plans.logical import view, with_views
from ripplegraph.session import checkpoint_dir

WAITING = "event_id long, priority long, first_batch long"


class OverflowQueue:
    """Events (event_id, priority) that wait in versioned tables under a folder.

    Cycle n reads the version that cycle n - 1 wrote and writes the next one last, so a cycle that is killed is run again from
    the same version and loses nothing; `stage` must then be idempotent per event. An event's rank is its priority and
    `aging` for each cycle that it waited; ties go to the longer wait, then to the smaller id. Null priorities rank lowest.
    An event that arrives again while it waits keeps its place and the higher priority; null ids are left out. A cycle may hand out
    `most` events, in `slices` equal parts; no part starts after `seconds`. A cycle's cost grows with what waits, not with what was ever taken.
    """

    def __init__(self, spark: SparkSession, folder: str, most: int, seconds: float | None = None, slices: int = 1, aging: int = 0, clock: Callable[[], float] = time.monotonic):
        self.spark, self.folder, self.most, self.seconds, self.slices, self.aging, self.clock = spark, folder, most, seconds, slices, aging, clock

    def backlog(self, number: int) -> DataFrame:
        """What waits as cycle `number` begins, without its arrivals."""
        return self.spark.read.schema(WAITING).parquet(f"{self.folder}/waiting/{number}") if number else self.spark.createDataFrame([], WAITING)

    def taken(self) -> DataFrame:
        """event_id, first_batch, batch of all that was handed out."""
        return self.spark.read.schema("event_id long, first_batch long, batch long").parquet(f"{self.folder}/taken/*")

    def cycle(self, arrivals: DataFrame, number: int, stage: Callable[[DataFrame], None] | None = None) -> None:
        """One batch, as `foreachBatch` calls it; without new events, give an empty frame to drain what waits."""
        fresh = arrivals.where("event_id is not null").select(F.col("event_id").cast("long").alias("event_id"), F.col("priority").cast("long").alias("priority"), F.lit(number).cast("long").alias("first_batch"))
        waiting = self.backlog(number).unionByName(fresh).groupBy("event_id").agg(F.max("priority").alias("priority"), F.min("first_batch").alias("first_batch"))
        rank = F.col("priority") + self.aging * (F.lit(number) - F.col("first_batch"))
        order = [F.desc_nulls_last(rank), F.col("first_batch"), F.col("event_id")]
        # Only `most` rows are brought together to be numbered.
        place = F.row_number().over(Window.orderBy(*order)) - 1
        part = F.floor(place * self.slices / max(self.most, 1)).cast("int")
        at = f"{self.folder}/chosen/{number}"
        waiting.orderBy(*order).limit(self.most).withColumn("part", part).write.mode("overwrite").parquet(at)
        chosen = self.spark.read.parquet(at)
        began, ended = self.clock(), 0
        while ended < self.slices and (self.seconds is None or self.clock() - began < self.seconds):
            if stage is not None:
                stage(chosen.where(F.col("part") == ended).drop("part"))
            ended += 1
        handed = chosen.where(F.col("part") < ended)
        handed.select("event_id", "first_batch", F.lit(number).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{self.folder}/taken/{number}")
        waiting.join(handed.select("event_id"), "event_id", "left_anti").write.mode("overwrite").parquet(f"{self.folder}/waiting/{number + 1}")


BUDGET, AGING, CYCLES = 400, 500, 3


def _cycle_sql(b: int) -> str:
    gone = "".join(f" ANTI JOIN t{i} USING (event_id)" for i in range(b))
    return f", t{b} AS MATERIALIZED (SELECT event_id, first_batch, {b}::BIGINT AS batch FROM arrivals{gone} WHERE first_batch <= {b} ORDER BY priority + {AGING} * ({b} - first_batch) DESC, first_batch, event_id LIMIT {BUDGET})"


@query(with_views("impacts") + ", arrivals AS MATERIALIZED (SELECT event_id, round(magnitude * 10000)::BIGINT AS priority, event_id % 3 AS first_batch FROM impacts)" + "".join(map(_cycle_sql, range(CYCLES)))
    + " SELECT event_id, a.first_batch, batch FROM arrivals a LEFT JOIN (" + " UNION ALL ".join(f"SELECT event_id, batch FROM t{b}" for b in range(CYCLES)) + ") t USING (event_id)")
def overflow_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the cycle it arrived in and the one that took it; null while it waits. The budget of a cycle is the feature."""
    rows = view(spark, sf_dir, "impacts").select("event_id", F.round(F.col("magnitude") * 10000).cast("long").alias("priority"))
    queue = OverflowQueue(spark, f"{checkpoint_dir(spark)}/queue-{uuid.uuid4().hex}", BUDGET, slices=4, aging=AGING)
    for number in range(CYCLES):
        queue.cycle(rows.where(F.col("event_id") % CYCLES == number), number)
    return queue.taken().unionByName(queue.backlog(CYCLES).select("event_id", "first_batch", F.lit(None).cast("long").alias("batch")))
