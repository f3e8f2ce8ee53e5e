"""A trace as a stream of frames: seeds, hops, refinement, verification and end, numbered per event, each stage published whole or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplegraph.operators import propagate as p
from ripplegraph.plans.catalog import query
from ripplegraph.plans.logical import view
from ripplegraph.session import checkpoint_dir, materialize

FRAME = "event_id long, seq long, step int, stage string, id string, hop int, parent string, direction string, magnitude double, kind string, note string"

#: What a later stage says of rows of the trace: from (trace, edges) to rows with the trace's columns, changed.
Stage = Callable[[DataFrame, DataFrame], DataFrame]


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """All frames published so far."""
    return spark.read.schema(FRAME).parquet(f"{folder}/frames/*")


def _publish_step(rows: Callable[[], DataFrame], earlier: DataFrame | None, folder: str, step: int, stage: str) -> DataFrame:
    """The frames of a step: those published before, or else computed, numbered after the event's earlier ones and renamed into place in one move."""
    spark = SparkSession.active()
    path = spark._jvm.org.apache.hadoop.fs.Path
    done, staged = f"{folder}/frames/{step:02d}-{stage}", f"{folder}/staged/{uuid.uuid4().hex}"
    fs = path(done).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path(done)):
        fresh = rows()
        for name, kind in (("hop", "int"), ("parent", "string"), ("kind", "string"), ("note", "string")):
            if name not in fresh.columns:
                fresh = fresh.withColumn(name, F.lit(None).cast(kind))
        place = F.row_number().over(Window.partitionBy("event_id").orderBy("id")) - 1
        fresh = fresh.withColumn("seq", place.cast("long"))
        if earlier is not None:
            sent = earlier.groupBy("event_id").agg(F.count("*").alias("sent"))
            fresh = fresh.join(sent, "event_id", "left").withColumn("seq", F.col("seq") + F.coalesce("sent", F.lit(0)))
        fresh = fresh.withColumn("step", F.lit(step)).withColumn("stage", F.lit(stage))
        columns = [F.col(c.split()[0]).cast(c.split()[1]) for c in FRAME.split(", ")]
        fresh.select(*columns).write.parquet(staged)
        fs.mkdirs(path(f"{folder}/frames"))
        if not fs.rename(path(staged), path(done)):
            raise RuntimeError(f"could not move {staged} to {done}")
    return spark.read.schema(FRAME).parquet(done)


def publish(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, folder: str, hops: int = p.HOPS, scorer: p.Scorer = p.rule_scorer, refiner: Stage = p.refine, judge: Stage = p.verify) -> DataFrame:
    """Trace the seeds and publish every stage under the folder as it ends; a run given the folder of one that was killed goes on after its last whole stage.

    Frames of an event are numbered from 0 without a gap, in the order of the stages and then of id. `note` holds what a
    refinement (`applied` or `kept`) or a judge says; the last frame, without an id, the number of nodes that moved. Stages with no
    row for an event publish none. The scorer is not asked again for a hop that is published. One writer a folder; a
    stage appears by one rename, which the store must do in one move.
    """
    trace = _publish_step(lambda: p.start_of(seeds, nodes), None, folder, 0, "seeds")
    frontier, ways = trace, None
    for hop in range(1, hops + 1):

        def ring(frontier: DataFrame = frontier, trace: DataFrame = trace, hop: int = hop) -> DataFrame:
            nonlocal ways
            if ways is None:
                ways = materialize(p.ways_of(nodes, edges))
            return p.next_ring(frontier.select(*p.TRACED), trace.select(*p.TRACED), ways, hop, scorer)

        frontier = _publish_step(ring, trace, folder, hop, "hop")
        trace = trace.unionByName(frontier)
    bare = trace.select("event_id", "id", "hop", "parent", "direction", "magnitude")
    says = lambda rows, note: rows.select("event_id", "id", "hop", "parent", "direction", "magnitude", note.alias("note"))
    refined = _publish_step(lambda: says(refiner(bare, edges), F.when(F.col("applied"), "applied").otherwise("kept")), trace, folder, hops + 1, "refinement")
    after, sent = _changed(bare, refined), trace.unionByName(refined)
    judged = _publish_step(lambda: says(judge(after, edges), F.col("verdict")), sent, folder, hops + 2, "verification")
    moved = F.count_if(F.col("direction") != "no_effect").cast("string")
    last = lambda: _changed(after, judged).groupBy("event_id").agg(moved.alias("note")).select("event_id", "note", F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("direction"), F.lit(None).cast("double").alias("magnitude"))
    _publish_step(last, sent.unionByName(judged), folder, hops + 3, "done")
    return frames(SparkSession.active(), folder)


def _changed(trace: DataFrame, frames_: DataFrame) -> DataFrame:
    """The trace with the directions and magnitudes of later frames."""
    new = frames_.select("event_id", "id", F.col("direction").alias("__d"), F.col("magnitude").alias("__m"))
    return trace.join(new, ["event_id", "id"], "left").withColumn("direction", F.coalesce("__d", "direction")).withColumn("magnitude", F.coalesce("__m", "magnitude")).drop("__d", "__m")


def result(spark: SparkSession, folder: str) -> DataFrame:
    """event_id, id, hop, direction, magnitude of what is published, each node by its last frame."""
    return frames(spark, folder).where("id is not null").groupBy("event_id", "id").agg(F.max_by(F.struct("hop", "direction", "magnitude"), "seq").alias("r")).select("event_id", "id", "r.*")


def follow(spark: SparkSession, folder: str, steps: int | None = None) -> DataFrame:
    """The frames as a stream, each once and in order: a frame waits in its event's state until those before it have passed.

    With `steps`, at most so many files a batch. State is the next number and the frames that wait, so it is empty where stages arrive in order.
    """
    reader = spark.readStream.schema(FRAME)
    if steps is not None:
        reader = reader.option("maxFilesPerTrigger", steps)
    names = [c.split()[0] for c in FRAME.split(", ")]

    def step(key, batches, state):
        following, waiting = state.get if state.exists else (0, "[]")
        held = {row[1]: row for row in json.loads(waiting)}
        for rows in batches:
            rows = rows[names].astype(object).where(rows[names].notna(), None)
            for row in rows.itertuples(index=False):
                if row[1] >= following:
                    held.setdefault(int(row[1]), [v.item() if hasattr(v, "item") else v for v in row])
        out = []
        while following in held:
            out.append(held.pop(following))
            following += 1
        state.update((following, json.dumps([held[k] for k in sorted(held)])))
        if out:
            yield pd.DataFrame(out, columns=names).astype({"event_id": "int64", "seq": "int64", "step": "int32", "hop": "Int32", "magnitude": "float64"})

    stream = reader.parquet(f"{folder}/frames/*")
    return stream.groupBy("event_id").applyInPandasWithState(step, FRAME, "following long, waiting string", "append", "NoTimeout")


@query(lambda: p.SECTOR_SQL + """, after AS MATERIALIZED (SELECT t.event_id, t.id, hop, parent, coalesce(r.direction, t.direction) AS direction, coalesce(r.magnitude, t.magnitude) AS magnitude FROM trace t LEFT JOIN refined r ON r.event_id = t.event_id AND r.id = t.id)"""
    + p.VERIFIED_SQL.format(trace="after") + """, ended AS (SELECT a.event_id, count(*) FILTER (coalesce(v.direction, a.direction) <> 'no_effect')::VARCHAR AS note FROM after a LEFT JOIN verified v ON v.event_id = a.event_id AND v.id = a.id GROUP BY a.event_id),
f AS (SELECT event_id, hop AS step, CASE hop WHEN 0 THEN 'seeds' ELSE 'hop' END AS stage, id, direction, magnitude, NULL AS note FROM trace
 UNION ALL SELECT event_id, 4, 'refinement', id, direction, magnitude, CASE WHEN applied THEN 'applied' ELSE 'kept' END FROM refined
 UNION ALL SELECT event_id, 5, 'verification', id, direction, magnitude, verdict FROM verified UNION ALL SELECT event_id, 6, 'done', NULL, NULL, NULL, note FROM ended)
SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY step, id) - 1 AS seq, step, stage, id, direction, magnitude, note FROM f""")
def progress_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame of the news about a nation's firms."""
    folder = f"{checkpoint_dir(spark)}/progress-{uuid.uuid4().hex}"
    published = publish(p.sector_seeds(spark, sf_dir), view(spark, sf_dir, "nodes"), view(spark, sf_dir, "edges"), folder)
    return published.select("event_id", "seq", "step", "stage", "id", "direction", "magnitude", "note")
