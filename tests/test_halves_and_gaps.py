"""Tables on which the last digit decides: weights that end in a half of a ten-thousandth, and gaps that pass a limit by less than a second."""

import datetime as dt
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from ripplegraph.operators.upkeep import merge_spans

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _against_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    return sorted(map(tuple, entry.queries()[name](spark, str(folder)).select(*columns).collect())), sorted(want.fetchall())


@pytest.fixture(scope="module")
def halves(spark, tmp_path_factory):
    """Each user k has a vote of (2k + 1) / 2 ten-thousandths, and a later one of k + 1: they tie if the half goes up."""
    at = dt.datetime(2024, 1, 30, 12)
    rows = []
    for k in range(600, 4900):
        rows.append((33 * k + 1, at, k, "purchase", (2 * k + 1) / 100, "{}"))  # hop 1, seed 1
        rows.append((33 * k + 3, at, k, "purchase", (k + 1) / 100, "{}"))  # hop 0, seed 3
    folder = tmp_path_factory.mktemp("halves")
    spark.createDataFrame(rows, EVENT).write.parquet(f"{folder}/events.parquet")
    return Path(folder)


def test_drivers_are_ranked_as_in_sql_where_weights_end_in_a_half(spark, halves):
    got, want = _against_sql(spark, halves, "aggregate_impacts")
    assert len(want) == 4300 and got == want


def test_live_drivers_are_ranked_as_in_sql_where_weights_end_in_a_half(spark, halves):
    got, want = _against_sql(spark, halves, "live_window")
    assert len(want) == 4300 and got == want


def test_a_story_comes_again_when_its_gap_is_longer_by_less_than_a_second(spark, tmp_path):
    first, week = dt.datetime(2024, 1, 1, 0, 0, 0, 100_000), dt.timedelta(days=7)
    later = [week, week + dt.timedelta(microseconds=1), week + dt.timedelta(seconds=0.5), week - dt.timedelta(microseconds=1)]
    rows = [(11 * i, first, i, "view", 1.0, "{}") for i in range(4)] + [(11 * (i + 4), first + gap, i, "view", 1.0, "{}") for i, gap in enumerate(later)]
    spark.createDataFrame(rows, EVENT).write.parquet(f"{tmp_path}/events.parquet")
    got, want = _against_sql(spark, tmp_path, "stream_dedup")
    assert [r[0] for r in got] == [0, 11, 22, 33, 55, 66] and got == want


def test_spans_are_whole_where_offsets_are_tied(spark):
    rows = [(1, 1863), (1, 1199), (1, 1863), (2, 0), (2, 900), (2, 900), (2, 900), (2, 1100)]
    for given in (rows, rows[::-1]):
        got = merge_spans(spark.createDataFrame(given, "id long, off long").coalesce(1), 150).collect()
        assert sorted((r.id, r.start, r.stop, r.n) for r in got) == [(1, 1049, 1349, 1), (1, 1713, 2013, 2), (2, 0, 150, 1), (2, 750, 1250, 4)]
