"""Betweenness from sampled pivots: leaves counted where they hang, pivots walked a few at a time, and nothing left on disk but the scores."""

import random
from collections import defaultdict
from pathlib import Path

import pytest

from ripplegraph.operators import hubs
from ripplegraph.session import checkpoint_dir


def _graph(spark, seed):
    """A core of 14 nodes, leaves on some of them, a star, a pair, a path of five, loops and repeated edges, and nodes without edges."""
    r = random.Random(seed)
    pairs = [(f"c{r.randrange(14)}", f"c{r.randrange(14)}") for _ in range(30)]
    pairs += [(f"c{i % 5}", f"l{i}") for i in range(12)] + [("hub", f"s{i}") for i in range(4)] + [("x", "y")] + [(f"p{i}", f"p{i + 1}") for i in range(4)]
    ids = sorted({x for p in pairs for x in p} | {"alone", "lonely"})
    nodes = spark.createDataFrame([(x,) for x in ids], "id string")
    return ids, pairs, nodes, spark.createDataFrame(pairs, "source string, target string")


def _brute(ids, pairs, chosen):
    near = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b), near[b].add(a)
    want = dict.fromkeys(ids, 0.0)
    for s in chosen:
        depth, sigma, order = {s: 0}, defaultdict(float, {s: 1.0}), [s]
        for x in order:
            for y in near[x]:
                if y not in depth:
                    depth[y] = depth[x] + 1
                    order.append(y)
                if depth[y] == depth[x] + 1:
                    sigma[y] += sigma[x]
        delta = dict.fromkeys(order, 0.0)
        for y in reversed(order):
            for x in near[y]:
                if depth[x] == depth[y] - 1:
                    delta[x] += sigma[x] / sigma[y] * (1 + delta[y])
        for x in order[1:]:
            want[x] += delta[x] * len(ids) / len(chosen) / ((len(ids) - 1) * (len(ids) - 2))
    return want


@pytest.mark.parametrize("count, at_once", [(500, 7), (17, None)])
def test_leaves_stars_pairs_and_samples_against_single_walks(spark, count, at_once):
    ids, pairs, nodes, edges = _graph(spark, count)
    chosen = [r.id for r in hubs.pivots(nodes, count).collect()]
    got = {r.id: r.betweenness for r in hubs.path_scores(nodes, edges, count, at_once=at_once).collect()}
    assert got == pytest.approx(_brute(ids, pairs, chosen))


def _bytes(folder):
    return sum(f.stat().st_size for f in Path(folder.removeprefix("file:")).rglob("*.parquet"))


def test_a_walk_is_removed_before_the_next_and_only_scores_stay(spark, monkeypatch):
    _, _, nodes, edges = _graph(spark, 1)
    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    before, walks, remove = set(folder.iterdir()), [], hubs.remove_folder
    monkeypatch.setattr(hubs, "remove_folder", lambda s, path: (walks.append((path, _bytes(path))), remove(s, path)))
    hubs.path_scores(nodes, edges, at_once=8)
    added = set(folder.iterdir()) - before
    assert len(added) == 1 and [p.name for p in added.pop().iterdir()] == ["scores"]
    assert len(walks) > 2 and all(size > 0 and not Path(path.removeprefix("file:")).exists() for path, size in walks)
