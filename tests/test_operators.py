"""Graph, impact and market operators on small cases worked out by hand."""

import math
from datetime import datetime

import pytest

from ripplegraph.operators import events, graph, market

EDGE = "id string, source string, target string, type string, confidence double, weight double, audit boolean, inferred boolean"


def edges_of(spark, *rows):
    return spark.createDataFrame([(f"{t}:{s}>{d}", s, d, t, 0.9, w, a, False) for s, d, t, w, a in rows], EDGE)


def test_customer_of_skips_regions(spark):
    nodes = spark.createDataFrame([("a", "Company"), ("b", "Company"), ("r", "Region")], "id string, type string")
    edges = edges_of(spark, ("a", "b", "supplies", 0.5, False), ("a", "r", "supplies", 0.5, False), ("a", "b", "competes_with", None, False))
    got = graph.customer_of_edges(nodes, edges).collect()
    assert [(r.id, r.source, r.target) for r in got] == [("customer_of:supplies:a>b", "b", "a")]


def test_bfs_depths_and_cap(spark):
    edges = edges_of(spark, ("a", "b", "supplies", 1.0, False), ("c", "b", "supplies", 1.0, False), ("c", "d", "supplies", 1.0, False), ("d", "a", "competes_with", None, False), ("d", "e", "supplies", 1.0, False))
    seeds = spark.createDataFrame([("a",)], "id string")
    assert {r.id: r.depth for r in graph.bfs(edges, seeds, 3).collect()} == {"a": 0, "b": 1, "d": 1, "c": 2, "e": 2}
    assert {r.id for r in graph.bfs(edges, seeds, 3, node_cap=3).collect()} == {"a", "b", "d"}
    assert {r.id for r in graph.bfs(edges, seeds, 0).collect()} == {"a"}


def test_ring_falls_back_to_audit_edges(spark):
    edges = edges_of(spark, ("p", "x", "supplies", 0.4, False), ("p", "y", "supplies", 0.9, True), ("q", "y", "supplies", 0.2, True), ("q", "z", "supplies", 0.3, True), ("p", "g", "regulated_by", None, False))
    nodes = spark.createDataFrame([("g", "Regulator")], "id string, type string")
    parents = spark.createDataFrame([("p",), ("q",)], "id string")
    got = {r.child: r.parent for r in graph.ring(edges, parents, parents, nodes, stranded_cap=1).collect()}
    assert got == {"x": "p", "z": "q"}


def test_components_with_isolated_nodes(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "id string")
    edges = edges_of(spark, ("f", "e", "supplies", 1.0, False), ("e", "d", "supplies", 1.0, False), ("b", "a", "supplies", 1.0, False))
    assert {r.id: r.root for r in graph.connected(nodes, edges).collect()} == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "d", "f": "d"}


IMPACT = "event_id long, node_id string, seed string, ts timestamp, direction string, magnitude double, hop int"


def test_impacts_decay_and_net(spark):
    day = lambda d: datetime(2024, 1, d, 12)
    rows = [
        (1, "n", "s1", day(30), "positive", 1.0, 0),
        (2, "n", "s1", day(30), "positive", 0.5, 0),  # same seed, day and direction: the stronger counts
        (3, "n", "s2", day(27), "negative", 1.0, 1),  # three days and one hop: a quarter
        (4, "n", "s3", day(20), "negative", 1.0, 0),  # too old
        (5, "n", "s4", day(31), "positive", 1.0, 0),  # in the future
        (6, "inert", "s1", day(30), "no_effect", 1.0, 0),
        (7, "faint", "s1", day(30), "positive", 0.04, 0),
        (8, "mixed", "s1", day(30), "positive", 0.5, 0),
        (9, "mixed", "s2", day(30), "negative", 0.4, 0),
    ]
    got = {r.node_id: r for r in events.aggregate(spark.createDataFrame(rows, IMPACT)).collect()}
    assert set(got) == {"n", "mixed"}
    n = got["n"]
    assert (n.direction, n.magnitude, n.mixed_signals) == ("positive", round(math.tanh(0.75), 3), 0)
    assert (n.event_count, n.driver_count, n.direct_count, n.top_events) == (3, 2, 1, "1,3")
    assert got["mixed"].mixed_signals == 1 and got["mixed"].magnitude == 0.15


def test_upsert_insert_and_replace(spark):
    frame = lambda *r: spark.createDataFrame(r, "k int, g string, v int")
    old, new = frame((1, "a", 1), (2, "a", 2), (3, "b", 3)), frame((2, "a", 9), (4, "c", 4))
    rows = lambda df: sorted(tuple(r) for r in df.select("k", "g", "v").collect())
    assert rows(events.upsert(old, new, ["k"])) == [(1, "a", 1), (2, "a", 9), (3, "b", 3), (4, "c", 4)]
    assert rows(events.insert_new(old, new, ["k"])) == [(1, "a", 1), (2, "a", 2), (3, "b", 3), (4, "c", 4)]
    assert rows(events.replace_groups(old, new, ["g"])) == [(2, "a", 9), (3, "b", 3), (4, "c", 4)]


def test_t_tail_and_holm(spark):
    assert market.t_tail(2.228, 10) == pytest.approx(0.05, abs=2e-4)
    assert market.t_tail(12.706, 1) == pytest.approx(0.05, abs=1e-4)
    assert market.t_tail(0.0, 5) == 1.0
    rows = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.04), ("d", None)], "test string, p double")
    assert {r.test: r.rejected for r in market.holm(rows, "p").collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_clustered_mean(spark):
    rows = spark.createDataFrame([(1.0, "x"), (3.0, "x"), (5.0, "y")], "v double, c string")
    r = market.clustered_mean(rows, "v", "c").first()
    assert (r["n"], r.n_clusters, r["mean"]) == (3, 2, 3.0)
    assert r.se == pytest.approx(math.sqrt(2 / 1 * ((-2) ** 2 + 2**2)) / 3)
