"""Propagation, exits, resolution and upkeep on small cases worked out by hand or by brute force."""

from datetime import date

import pytest

from ripplegraph.operators import exits, propagate, resolve, upkeep
from ripplegraph.operators.cohorts import relabel

EDGE = "id string, source string, target string, type string, confidence double, weight double, audit boolean, inferred boolean"


def test_propagation_moves_flips_and_stops(spark):
    nodes = spark.createDataFrame([("a", "Company"), ("b", "Company"), ("c", "Company"), ("d", "Company"), ("r", "Region"), ("g", "Regulator")], "id string, type string")
    rows = [("a", "b", "supplies", 0.9, False), ("a", "c", "competes_with", None, False), ("b", "d", "supplies", 0.6, True), ("a", "g", "regulated_by", None, False), ("c", "r", "supplies", 1.0, False), ("r", "d", "supplies", 1.0, False)]
    edges = spark.createDataFrame([(f"{t}:{s}>{e}", s, e, t, 0.9, w, x, False) for s, e, t, w, x in rows], EDGE)
    seeds = spark.createDataFrame([(1, "a", "positive", 1.0), (2, "d", "negative", 0.1)], "event_id long, id string, direction string, magnitude double")
    got = {(r.event_id, r.id): (r.hop, r.parent, r.direction, r.magnitude) for r in propagate.propagate(seeds, nodes, edges).collect()}
    assert got == {
        (1, "a"): (0, None, "positive", 1.0),
        (1, "b"): (1, "a", "positive", 0.63),
        (1, "c"): (1, "a", "negative", 0.35),
        (1, "r"): (2, "c", "negative", 0.245),
        (1, "d"): (2, "b", "positive", 0.2646),  # b has no core edge left, so its audit edge serves
        (2, "d"): (0, None, "negative", 0.1),  # below the frontier
    }


def test_refinement_and_verification_rules(spark):
    rows = spark.createDataFrame(
        [(1, "no_effect", 0.0, "positive", 0.2), (2, "no_effect", 0.0, "positive", 0.19), (3, "positive", 0.1, "positive", 0.25), (4, "positive", 0.2, "positive", 0.3), (5, "positive", 0.2, "negative", 0.3), (6, "positive", 0.2, "negative", 0.29), (7, "positive", 0.2, "no_effect", 0.9)],
        "k int, direction string, magnitude double, new_direction string, new_magnitude double",
    )
    assert {r.k for r in propagate.apply_refinement(rows).where("applied").collect()} == {1, 3, 5}
    judged = spark.createDataFrame([("refuted", "positive", 0.6), ("weakened", "positive", 0.6), ("confirmed", "negative", 0.6)], "verdict string, direction string, magnitude double")
    assert {r.verdict: (r.direction, r.magnitude) for r in propagate.apply_verification(judged).collect()} == {"refuted": ("no_effect", 0.0), "weakened": ("positive", 0.3), "confirmed": ("negative", 0.6)}


def test_dynamic_exit_reasons(spark):
    days = [date(2024, 1, d) for d in range(1, 32)]
    prices = spark.createDataFrame([(t, d, i, 100.0 + i, 100.0 + i) for t in ("x", "y") for i, d in enumerate(days)], "ticker string, day date, t_idx int, open double, close double")
    bench = spark.createDataFrame([(d, 50.0, 50.0) for d in days], "day date, open double, close double")
    signals = spark.createDataFrame(
        [(1, "x", date(2024, 1, 1), 0, "positive", 1.0), (2, "y", date(2024, 1, 1), 0, "positive", 0.4), (3, "y", date(2024, 1, 4), 0, "negative", 1.0), (4, "y", date(2024, 1, 25), 0, "positive", 1.0)],
        "event_id long, ticker string, pub date, hop int, direction string, magnitude double",
    )
    got = {r.event_id: r for r in exits.dynamic_exits(signals, prices, bench).collect()}
    # 1 enters on the 2nd; the thesis is gone on the 9th, eight days after. 2 is outweighed on the 4th. 4 has no room for a full hold.
    assert {k: (r.holding, r.exit_reason) for k, r in got.items()} == {1: (8, "faded"), 2: (3, "reverse"), 3: (8, "faded")}
    assert got[1].abn_ret == pytest.approx(109 / 101 - 1)


def test_chain_against_brute_force(spark):
    names = [("acme steel", "n1", False), ("acme", "n2", True), ("acme steel works", "n3", False), ("bolt", "n4", False), ("great bolt company", "n5", False), ("aaaaaa", "n6", False), ("", "n7", False)]
    asked = ["acme", "acme steel", "acme s", "bolt", "t bolt", "olt", "a", "aaaaa", "zzz", "zzzzzz", "reat bolt", "work", "works", "banned", "", "  Bolt "]

    def plain(q):
        found = []
        for name, node, alias in names:
            rank = (2 if alias else 1) if name == q else (4 if alias else 3) if name.startswith(q) else 5 if len(q) >= 5 and q in name else None
            if name and rank:
                found.append((rank, len(name), node))
        return min(found)[2] if found else None

    got = resolve.resolve_chain(spark.createDataFrame([(q,) for q in asked], "q string"), spark.createDataFrame(names, "name string, node_id string, is_alias boolean"), spark.createDataFrame([("banned",)], "term string"))
    want = {q: plain(q) for q in {a.strip().lower() for a in asked} if q and q != "banned" and plain(q)}
    assert {r.q: r.node_id for r in got.collect()} == want


def test_fuzzy_ladder(spark):
    names = spark.createDataFrame([("acme steel", "n1"), ("acme steel works", "n2"), ("bright lamp", "n3"), ("bright lump", "n4")], "name string, node_id string")
    asked = spark.createDataFrame([("lamp bright",), ("acme steel",), ("nobody",), ("bright lampe",)], "q string")
    got = {r.q: (r.action, r.node_id) for r in resolve.fuzzy_ladder(asked, names).collect()}
    # "bright lampe" is 95.7 to the lamp and 87.0 to the lump: one hit of 90.
    assert got == {"lamp bright": ("accept", "n3"), "acme steel": ("review", None), "nobody": ("mint", "slug:nobody"), "bright lampe": ("accept", "n3")}
    assert resolve.indel_ratio("abcd", "abxd") == 75.0 and resolve.indel_ratio("", "") == 100.0


def test_upkeep_rules(spark):
    old = spark.createDataFrame([("1", "a"), ("2", None)], "id string, name string")
    new = spark.createDataFrame([("1", "z"), ("3", "a"), ("4", "d"), ("4", "c"), ("5", None)], "id string, name string")
    assert sorted((r.id, r.name) for r in upkeep.append_new(old, new, ["id", "name"]).collect()) == [("4", "c"), ("5", None)]
    spots = spark.createDataFrame([(1, 50), (1, 120), (1, 400), (2, 7)], "id int, off int")
    assert sorted((r.id, r.start, r.stop, r.n) for r in upkeep.merge_spans(spots, 40).collect()) == [(1, 10, 160, 2), (1, 360, 440, 1), (2, 0, 47, 1)]


def test_placebo_draws_are_members_and_agree(spark):
    pairs = spark.createDataFrame([("a", "b", "s")], "a string, b string, sector string")
    pool = spark.createDataFrame([("s", i, c) for i, c in enumerate("abcdef")], "sector string, i long, c string")
    runs = [sorted((r.perm, r.c) for r in relabel(pairs, pool, 30).collect()) for _ in range(2)]
    assert runs[0] == runs[1] and {c for _, c in runs[0]} <= set("cdef") and len(runs[0]) > 10


def test_betweenness_against_all_shortest_paths(spark):
    from itertools import permutations

    from ripplegraph.operators.hubs import path_scores

    ids = "abcdefgh"
    pairs = [("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "e"), ("e", "f"), ("f", "g"), ("e", "g")]  # h stands alone
    near = {x: {q for p in pairs for q in p if x in p and q != x} for x in ids}

    def paths(s, t):
        level, found = [[s]], []
        while level and not found:
            found = [p for p in level if p[-1] == t]
            level = [p + [x] for p in level for x in near[p[-1]] if x not in p]
        return found

    want = dict.fromkeys(ids, 0.0)
    for s, t in permutations(ids, 2):
        through = paths(s, t)
        for p in through:
            for x in p[1:-1]:
                want[x] += 1 / len(through) / (7 * 6)
    nodes = spark.createDataFrame([(x,) for x in ids], "id string")
    edges = spark.createDataFrame([(f"{s}>{t}", s, t, "supplies", 0.9, 1.0, False, False) for s, t in pairs], EDGE)
    got = {r.id: r.betweenness for r in path_scores(nodes, edges).collect()}
    assert got == pytest.approx(want)


def test_refinement_takes_weak_rows_with_two_strong_neighbours(spark):
    rows = [(1, "a", 0, "positive", 0.5), (1, "b", 1, "negative", 0.3), (1, "c", 1, "no_effect", 0.0), (1, "d", 1, "negative", 0.1), (1, "e", 1, "positive", 0.19), (1, "s", 1, "positive", 0.35), (2, "a", 0, "positive", 0.9), (2, "c", 1, "no_effect", 0.0)]
    trace = spark.createDataFrame(rows, "event_id long, id string, hop int, direction string, magnitude double")
    links = [("a", "c"), ("c", "b"), ("b", "c"), ("a", "d"), ("e", "d"), ("a", "b"), ("a", "s"), ("b", "s")]  # s is not weak, d has one strong neighbour
    edges = spark.createDataFrame([(f"{s}>{t}", s, t, "supplies", 0.9, 1.0, False, False) for s, t in links], EDGE)
    got = [(r.event_id, r.id, r.n, r.pos, r.neg) for r in propagate.refine_rows(trace, edges).collect()]
    assert sorted(got) == [(1, "b", 2, 850000, 0), (1, "c", 2, 500000, 300000)]


def test_resamples_and_permutations_are_as_many_as_the_reference_has(spark):
    from ripplegraph.operators import cohorts, study

    sums = spark.createDataFrame([(0, 1.0, 1), (1, 2.0, 1)], "g long, s double, m long")
    assert study.bootstrap_means(sums).count() == 1000
    pool = spark.createDataFrame([("x", i, c) for i, c in enumerate("cd")], "sector string, i long, c string")
    assert cohorts.relabel(spark.createDataFrame([("a", "b", "x")], "a string, b string, sector string"), pool).select("perm").distinct().count() == 500
