"""Streams over files written here, the status machine, the batch cycle, and the facade."""

import pytest
from pyspark.sql import functions as F

from ripplegraph.facade import Graph
from ripplegraph.streaming import events as streams

SF = "/root/testdata/sf0.001"


def test_status_machine_over_two_batches(spark, tmp_path):
    rows = [[(1, False), (2, True), (3, False)], [(1, True), (2, False), (3, False), (3, False), (3, True)]]
    for i, batch in enumerate(rows):
        spark.createDataFrame(batch, "event long, ok boolean").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema("event long, ok boolean").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    latest = {}

    def keep(batch, number):
        latest.update({r.event: (r.attempts, r.status) for r in batch.collect()})

    run = streams.status_stream(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert latest == {1: (2, "traced"), 2: (1, "traced"), 3: (3, "failed")}


def test_a_run_resumes_in_its_folder(spark, tmp_path):
    source = tmp_path / "events.parquet"
    rows = spark.read.parquet(f"{SF}/events.parquet").limit(20).cache()
    for part in (0, 1):
        rows.where(F.col("event_id") % 2 == part).coalesce(1).write.mode("append").parquet(str(source))
        out = streams.run_once(streams.event_stream(spark, str(tmp_path), most_files=1).select("event_id"), "append", str(tmp_path / "run"))
        assert sorted(r.event_id for r in out.collect()) == sorted(r.event_id for r in rows.where(F.col("event_id") % 2 <= part).collect())


def test_cycle_runs_every_stage_then_fails(spark):
    ran = []

    def bad(batch):
        raise ValueError("no")

    run = streams.cycle([("one", lambda b: ran.append(b.count())), ("two", bad), ("three", lambda b: ran.append(-1))])
    with pytest.raises(RuntimeError, match="batch 7: two: no"):
        run(spark.range(3), 7)
    assert ran == [3, -1]


def test_sliding_counts_in_a_stream_equal_the_batch(spark):
    out = streams.run_once(streams.sliding(streams.event_stream(spark, SF).withWatermark("ts", "1 day")), "append")
    got = {(r.start, r.event_type): r.n for r in out.collect()}
    want = {(r.start, r.event_type): r.n for r in streams.sliding_window(spark, SF).collect()}
    assert got and all(want[k] == n for k, n in got.items())


def test_facade(spark):
    g = Graph(spark, SF)
    one = g.node("sup-1").first()
    assert one.type == "Company" and g.edge("nothing").isEmpty()
    nodes, edges = g.ego("sup-1", provisional=True, inferred=True)
    assert nodes.where("center").count() == 1
    ids = {r.id for r in nodes.collect()}
    assert all(e.source in ids and e.target in ids and "sup-1" in (e.source, e.target) for e in edges.collect())
    found, inner, truncated = g.subgraph(["sup-1"], hops=9, provisional=True, inferred=True)
    assert not truncated and g.subgraph(["sup-1"], hops=2, node_cap=2)[2]
    assert found.agg(F.max("depth")).first()[0] <= 3 and ids <= {r.id for r in found.collect()}
    assert g.search("supplier", 3).count() == 3
    assert {r.hop for r in g.reliability(hop=1).collect()} == {1}
    trace = g.impact(spark.createDataFrame([(1, "sup-1", "positive", 1.0)], "event_id long, id string, direction string, magnitude double"))
    assert trace.where("hop = 0").count() == 1
