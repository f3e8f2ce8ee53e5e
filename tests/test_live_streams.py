"""Progress frames after a crash, the queue's overflow, and live decayed windows against the batch answer."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ripplegraph.operators import events, propagate
from ripplegraph.plans.logical import view
from ripplegraph.streaming import progress
from ripplegraph.streaming.backlog import OverflowQueue
from ripplegraph.streaming.live import LiveImpacts

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_killed_trace_continues_without_a_repeated_frame(spark, tmp_path):
    nodes, edges = view(spark, SF, "nodes"), view(spark, SF, "edges")
    seeds = propagate.sector_seeds(spark, SF)
    folder, asked, dies = str(tmp_path / "run"), [], [True]

    def scorer(ring):
        asked.append(1)
        if len(asked) == 2 and dies:
            raise RuntimeError("killed")
        return propagate.rule_scorer(ring)

    def refiner(trace, edges):
        return trace.where("hop = 1").withColumn("applied", F.lit(True)).withColumn("magnitude", F.lit(0.875))

    def read():
        run = progress.follow(spark, folder).writeStream.format("parquet").option("path", str(tmp_path / "seen")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        run.awaitTermination()
        return spark.read.schema(progress.FRAME).parquet(str(tmp_path / "seen"))

    with pytest.raises(RuntimeError, match="killed"):
        progress.publish(seeds, nodes, edges, folder, scorer=scorer, refiner=refiner)
    assert {r.stage for r in read().select("stage").distinct().collect()} == {"seeds", "hop"}
    dies.clear()
    whole = progress.publish(seeds, nodes, edges, folder, scorer=scorer, refiner=refiner)
    assert len(asked) == 4  # hops 1, 2 (killed), 2 and 3: the first is not scored again
    got = read()
    assert _rows(got) == _rows(whole) == _rows(progress.publish(seeds, nodes, edges, str(tmp_path / "other"), refiner=refiner))
    ends = whole.groupBy("event_id").agg(F.max("seq").alias("last"), F.count("*").alias("n"), F.count_distinct("seq").alias("k"), F.max_by("stage", "seq").alias("stage")).collect()
    assert ends and all(r.last + 1 == r.n == r.k and r.stage == "done" for r in ends)
    assert {r.stage for r in whole.select("stage").distinct().collect()} == {"seeds", "hop", "refinement", "verification", "done"}
    again = progress.publish(seeds, nodes, edges, folder, scorer=scorer, refiner=refiner)
    assert len(asked) == 4 and again.count() == whole.count() and read().count() == whole.count()
    final = progress.result(spark, folder)
    assert final.where("hop = 1 and magnitude = 0.875").count() > 0
    assert final.count() == propagate.propagate(seeds, nodes, edges).count()


def test_frames_out_of_order_wait_for_those_before(spark, tmp_path):
    rows = [(1, seq, 0, "hop", f"n{seq}", 1, None, "positive", 0.5, None, None) for seq in range(4)]
    out = []
    for i, batch in enumerate([[rows[2], rows[1]], [rows[1], rows[0]], [rows[3], rows[0]]]):
        spark.createDataFrame(batch, progress.FRAME).coalesce(1).write.parquet(str(tmp_path / f"frames/{i}"))
        run = progress.follow(spark, str(tmp_path)).writeStream.foreachBatch(lambda b, n: out.append(sorted(r.seq for r in b.collect()))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        run.awaitTermination()
    assert [b for b in out if b] == [[0, 1, 2], [3]]


def _arrivals(spark, rows):
    return spark.createDataFrame(rows, "event_id long, priority long")


def test_overflow_waits_with_its_age(spark, tmp_path):
    q = OverflowQueue(spark, str(tmp_path), most=2, aging=10)
    q.cycle(_arrivals(spark, [(1, 5), (2, 9), (3, 7), (4, None), (None, 99)]), 0)
    q.cycle(_arrivals(spark, [(5, 14), (6, 16), (1, 6)]), 1)
    q.cycle(_arrivals(spark, []), 2)
    q.cycle(_arrivals(spark, []), 3)
    took = {r.event_id: (r.first_batch, r.batch) for r in q.taken().collect()}
    # Event 1 came again with priority 6, kept its place and passed 5 by its age.
    assert took == {2: (0, 0), 3: (0, 0), 1: (0, 1), 6: (1, 1), 5: (1, 2), 4: (0, 2)}
    assert q.backlog(4).isEmpty()


def test_no_part_starts_after_the_time_and_a_killed_cycle_loses_nothing(spark, tmp_path):
    clock, ran = iter([0.0, 0.0, 1.0, 5.0]), []
    q = OverflowQueue(spark, str(tmp_path), most=6, seconds=3, slices=3, clock=lambda: next(clock, 9.0))
    rows = _arrivals(spark, [(i, 10 - i) for i in range(6)])
    q.cycle(rows, 0, lambda part: ran.append([r.event_id for r in part.orderBy("event_id").collect()]))
    assert ran == [[0, 1], [2, 3]] and sorted(r.event_id for r in q.backlog(1).collect()) == [4, 5]

    def dies(part):
        raise RuntimeError("killed")

    q.seconds = None
    with pytest.raises(RuntimeError):
        q.cycle(_arrivals(spark, [(9, 99)]), 1, dies)
    q.cycle(_arrivals(spark, [(9, 99)]), 1)
    assert sorted((r.event_id, r.batch) for r in q.taken().collect()) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 1), (5, 1), (9, 1)]


def test_live_windows_equal_the_batch_on_any_day_late_rows_and_replays_included(spark, tmp_path):
    rows = view(spark, SF, "impacts").cache()
    live = LiveImpacts(spark, str(tmp_path))
    late = F.col("event_id") % 5 == 0
    parts = [rows.where((F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")) & ~late), rows.where((F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")) & ~late), rows.where(late), rows.limit(0)]
    for number, part in enumerate(parts):
        live.fold(part, number)
        if number == 1:
            live.fold(part, number)  # a replay of the same batch
    for today in ("2024-01-30", "2024-01-22", "2024-01-05", "2023-12-01"):
        want, got = {r.node_id: r for r in events.aggregate(rows, today).collect()}, {r.node_id: r for r in live.at(3, today).collect()}
        assert want.keys() == got.keys()
        for k, w in want.items():
            assert got[k].magnitude == pytest.approx(w.magnitude, abs=1.1e-3) and got[k][1] == w[1] and got[k][3:] == w[3:]
    # Early days are not written again by the second batch.
    assert live.days(1)[dt.date(2024, 1, 10)] == 0 or dt.date(2024, 1, 10) not in live.days(1)
