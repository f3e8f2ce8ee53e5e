"""Live node impacts: votes and daily masses are kept as events arrive, and decayed only when they are read, to whatever day it is."""

from __future__ import annotations

import datetime as dt
import functools
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplegraph.operators.events import ANSWER, HALF_LIFE, HOP_WEIGHT, TODAY, TOP, WINDOW, in_ten_thousandths, verdicts
from ripplegraph.plans.catalog import ORACLE_SQL, query
from ripplegraph.plans.logical import view
from ripplegraph.session import checkpoint_dir

VOTE = "node_id string, seed string, sign int, n long, best struct<weight: double, hop: int, event_id: long>, day date"
MASS = "node_id string, pos double, neg double, event_count long, driver_count long, direct_count long, day date"


def _merge(votes: DataFrame) -> DataFrame:
    order = F.struct("best.weight", -F.col("best.event_id"))
    return votes.groupBy("node_id", "seed", "day", "sign").agg(F.sum("n").alias("n"), F.max_by("best", order).alias("best"))


def votes_of(impacts: DataFrame) -> DataFrame:
    """One vote per node, seed, day and direction: its rows and the strongest of them, weighted by hop but not by age.

    All votes of a day decay alike, so the strongest of a day stays the strongest on every later one.
    """
    sign = F.when(F.col("direction") == "positive", 1).when(F.col("direction") == "negative", -1).otherwise(0)
    weight = F.when(sign != 0, F.least(F.lit(1.0), F.abs("magnitude")) * F.pow(F.lit(HOP_WEIGHT), F.col("hop"))).otherwise(0.0)
    best = F.struct(weight.alias("weight"), F.col("hop").cast("int").alias("hop"), F.col("event_id").cast("long").alias("event_id"))
    return _merge(impacts.select("node_id", "seed", F.to_date("ts").alias("day"), sign.cast("int").alias("sign"), F.lit(1).cast("long").alias("n"), best.alias("best")).where("day is not null"))


def _masses(votes: DataFrame) -> DataFrame:
    mass = lambda s: F.sum(F.when(F.col("sign") == s, F.col("best.weight")).otherwise(0.0))
    moved = (F.col("sign") != 0) & (F.col("best.weight") > 0)
    return votes.groupBy("node_id", "day").agg(
        mass(1).alias("pos"), mass(-1).alias("neg"), F.sum("n").alias("event_count"), F.count_if(moved).alias("driver_count"),
        F.count_if(moved & (F.col("best.hop") == 0)).alias("direct_count"),
    )


class LiveImpacts:
    """The state under a folder, a version per batch: the votes and the masses of each day, and a list of the days with the batch that wrote them last.

    A batch rewrites the days it touches, late ones too, and no other; its list is written last, so a batch that is killed is
    run again from the list before it and counts nothing twice. A reader adds up the masses of the window's days, each decayed by its age: at
    most eight rows a node, however many events there were. Rows without a time are left out; null nodes and seeds are keys.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def days(self, number: int) -> dict[dt.date, int]:
        """Day to the batch that wrote it, after batch `number`: a few thousand entries for ten years."""
        if number < 0:
            return {}
        return {r.day: r.batch for r in self.spark.read.schema("day date, batch int").parquet(f"{self.folder}/days/{number}").collect()}

    def _read(self, what: str, schema: str, days: dict[dt.date, int]) -> DataFrame:
        if not days:
            return self.spark.createDataFrame([], schema)
        parts = [self.spark.read.schema(schema).option("basePath", f"{self.folder}/{what}/{batch}").parquet(*[f"{self.folder}/{what}/{batch}/day={d}" for d, b in days.items() if b == batch]) for batch in sorted(set(days.values()))]
        return functools.reduce(DataFrame.unionByName, parts)

    def fold(self, impacts: DataFrame, number: int) -> None:
        """One batch, as `foreachBatch` calls it; batches are numbered from 0."""
        fresh = votes_of(impacts)
        days = self.days(number - 1)
        touched = [r.day for r in fresh.select("day").distinct().collect()]
        old = self._read("votes", VOTE, {d: days[d] for d in touched if d in days})
        at = f"{self.folder}/votes/{number}"
        _merge(fresh.select(*_VOTES).unionByName(old.select(*_VOTES))).write.mode("overwrite").partitionBy("day").parquet(at)
        days |= {d: number for d in touched}
        votes = self._read("votes", VOTE, {d: number for d in touched})
        _masses(votes).write.mode("overwrite").partitionBy("day").parquet(f"{self.folder}/masses/{number}")
        self.spark.createDataFrame(sorted(days.items()), "day date, batch int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/days/{number}")

    def at(self, number: int, today: str = TODAY, window: int = WINDOW) -> DataFrame:
        """The live verdict of each node after batch `number`, as of any day."""
        end = dt.date.fromisoformat(today)
        days = {d: b for d, b in self.days(number).items() if 0 <= (end - d).days <= window}
        decay = F.pow(F.lit(0.5), F.datediff(F.lit(end), "day") / HALF_LIFE)
        masses = self._read("masses", MASS, days)
        total = lambda c: F.sum(c).alias(c)
        sums = masses.groupBy("node_id").agg(F.sum(decay * F.col("pos")).alias("pos"), F.sum(decay * F.col("neg")).alias("neg"), total("event_count"), total("driver_count"), total("direct_count"))
        nodes = verdicts(sums)
        moved = self._read("votes", VOTE, days).where("sign <> 0 and best.weight > 0").withColumn("now", decay * F.col("best.weight"))
        order = Window.partitionBy("node_id").orderBy(F.desc(in_ten_thousandths(F.col("now"))), "best.event_id")
        first = moved.withColumn("place", F.row_number().over(order)).where(F.col("place") <= TOP)
        top = first.groupBy("node_id").agg(F.sort_array(F.collect_list(F.struct("place", F.col("best.event_id").alias("e")))).alias("top"))
        top = top.select(F.col("node_id").alias("__node"), F.array_join(F.transform("top", lambda x: x["e"].cast("string")), ",").alias("top_events"))
        nodes = nodes.join(top, F.col("node_id").eqNullSafe(F.col("__node")))
        return nodes.select(*ANSWER)


_VOTES = ["node_id", "seed", "sign", "n", "best", "day"]


@query(lambda: ORACLE_SQL["aggregate_impacts"])
def live_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches that each hold rows of every day, so the later ones are late; read once."""
    rows = view(spark, sf_dir, "impacts")
    live = LiveImpacts(spark, f"{checkpoint_dir(spark)}/live-{uuid.uuid4().hex}")
    for number in range(3):
        live.fold(rows.where(F.col("event_id") % 3 == number), number)
    return live.at(2)
