"""Hard negatives against a plain sort of all scores, and the tree's parts on their own."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ripplegraph.llm import hard_negatives as hn

SCHEMA = "id bigint, label int, vector array<float>, anchor boolean, rank string, score string, block string"


def plain(rows, positives=5, negatives=5):
    """Rows (id, label, vector, anchor); Python integers throughout."""
    width = max([len(r[2]) for r in rows if r[2]], default=0)
    whole, seen = [], set()
    for id, label, vector, anchor in rows:
        if id is None or label is None or vector is None or any(c is None or not np.isfinite(c) for c in vector):
            continue
        x = [int(np.floor(256 * float(np.float32(c)))) for c in vector]
        x = tuple(max(-(2**62), min(2**62, c)) for c in x) + (0,) * (width - len(x))
        if (id, label, x) not in seen:
            seen.add((id, label, x))
            whole.append((id, label, x, anchor))
    out = []
    for id, label, x, anchor in whole:
        if not anchor:
            continue
        scored = sorted((-max(1 - 2**63, min(2**63 - 1, sum(a * b for a, b in zip(x, o[2])))), o[0], o) for o in whole if (o[0], o[1], o[2]) != (id, label, x))
        for p in [s for s in scored if s[2][1] == label][:positives]:
            fit = [n for n in scored if n[2][1] != label and -80 * p[0] <= -100 * n[0] <= -100 * p[0]][:negatives]
            out += [(id, p[1], k + 1, n[1], -p[0], -n[0]) for k, n in enumerate(fit)]
    return sorted(out)


def result(spark, rows, **more):
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in hn.hard_negatives(df, **more).collect())


def made(n, width=6, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(4, width))
    return [(i, int(rng.integers(0, 3)), [float(np.float32(v)) for v in centre[i % 4] * 0.3 + rng.normal(size=width) * 0.1], i % 7 == 0) for i in range(n)]


@pytest.mark.parametrize("block", [4096, 9])
def test_equal_to_a_plain_sort(spark, monkeypatch, block):
    monkeypatch.setattr(hn, "SLAB", 150)
    rows = made(600)
    rows += [(5000 + i, 1, rows[3][2], i % 10 == 0) for i in range(60)]  # one vector under many ids, so ties by id
    rows += [(7000, 0, [0.0] * 6, True), (7001, 0, [0.0] * 6, True), (7002, 1, [0.0] * 6, False)]
    want = plain(rows)
    assert result(spark, rows, block=block) == want and len(want) > 300


def test_odd_rows(spark):
    rows = made(60)
    nan, inf = float("nan"), float("inf")
    rows += [(None, 1, rows[0][2], True), (100, None, rows[0][2], True), (101, 1, None, True), (102, 1, [nan] * 6, True), (103, 1, [inf, 0.0, 0.0, 0.0, 0.0, 0.0], True), (104, 1, [None] * 6, False)]
    rows += [(105, 1, [], True), (106, 2, [0.5], False), (0, *rows[0][1:]), rows[7], (8, 2, rows[9][2], True)]  # short vectors, equal rows, an id under two rows
    assert result(spark, rows) == plain(rows)
    assert result(spark, []) == [] and result(spark, [(0, 1, [1.0], True)]) == [] and result(spark, [(0, 1, [], True), (1, 1, [], True)]) == []
    assert result(spark, [(0, 1, [1.0], True), (1, 1, [1.0], False)]) == []


def test_numbers_beyond_doubles(spark):
    """Whole numbers that doubles don't hold, and scores that no long holds."""
    for x in (3e6, 3e13):
        rows = [(i, i % 2, [float(np.float32(v)) for v in (x + i * x / 9e4, -x * i / 9e3, 1.0)], i < 3) for i in range(40)]
        want = plain(rows)
        assert result(spark, rows) == want and want


def test_tiles_hold_every_row_once_and_boxes_bound_every_score():
    rng = np.random.default_rng(3)
    x, ids = rng.integers(-50, 50, (1000, 5)), np.arange(1000)
    parts = list(hn.tiles(x, ids, [2, 0, 1], leaf=16))
    assert sorted(np.concatenate(parts).tolist()) == list(range(1000)) and max(map(len, parts)) <= 16
    same = list(hn.tiles(np.zeros((1000, 5), int), ids, [2, 0, 1], leaf=16))
    assert max(map(len, same)) <= 16
    leaves = pa.table({"ids": [ids[p] for p in parts], "labels": pa.array([np.zeros(len(p), int) for p in parts], pa.list_(pa.int32())), "vectors": [hn._bytes(x[p]) for p in parts]})
    boxes = hn.Boxes(leaves, 5)
    anchors = rng.integers(-50, 50, (20, 5))
    scores = anchors @ boxes.x.T
    for low, high in boxes.intervals(anchors, float)[:1]:
        for i in range(len(parts)):
            s = scores[:, boxes.at[i] : boxes.at[i + 1]]
            assert (low[:, i] <= s.min(axis=1)).all() and (high[:, i] >= s.max(axis=1)).all()
    tops = boxes.intervals(anchors, float)[-1]
    assert tops[0].shape == (20, 1) and (tops[1][:, 0] >= scores.max(axis=1)).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.lists(st.integers(-9, 9), min_size=3, max_size=3)), min_size=1, max_size=60), st.integers(1, 4), st.integers(-60, 60))
def test_queue_finds_the_first_in_any_window(rows, k, high):
    x, labels, ids = np.array([r[1] for r in rows]), np.array([r[0] for r in rows]), np.arange(len(rows))
    parts = list(hn.tiles(x, ids, [0, 1, 2], leaf=4))
    leaves = pa.table({"ids": [ids[p] for p in parts], "labels": pa.array([labels[p] for p in parts], pa.list_(pa.int32())), "vectors": [hn._bytes(x[p]) for p in parts]})
    boxes = hn.Boxes(leaves, 3)
    one = hn.Search(boxes, boxes.x.astype(float), boxes.intervals(x[:1], float), 0, 0, int(labels[0]), x[0])
    scores = x @ x[0]
    order = sorted((-int(s), int(i)) for i, s in enumerate(scores))
    assert one.first(k, True) == [o for o in order if labels[o[1]] == labels[0] and o[1] != 0][:k]
    low = high - 20
    assert one.first(k, False, low, high) == [o for o in order if labels[o[1]] != labels[0] and low <= -o[0] <= high][:k]


def test_pruning_opens_few_leaves(spark):
    """Well separated groups: a search for the nearest opens a small part of the leaves."""
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(32, 8)) * 40
    x = np.floor(centre[np.arange(4096) % 32] + rng.normal(size=(4096, 8))).astype(np.int64)
    parts = list(hn.tiles(x, np.arange(4096), list(range(8)), leaf=32))
    leaves = pa.table({"ids": parts, "labels": pa.array([np.zeros(len(p), int) for p in parts], pa.list_(pa.int32())), "vectors": [hn._bytes(x[p]) for p in parts]})
    boxes = hn.Boxes(leaves, 8)
    one = hn.Search(boxes, boxes.x.astype(float), boxes.intervals(x[:1], float), 0, 0, 0, x[0])
    assert len(one.first(5, True)) == 5 and len(one.opened) * 4 < len(parts)
