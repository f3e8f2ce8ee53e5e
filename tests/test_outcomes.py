"""Outcomes, reliability blocks and ranks on hand-made rows."""

from datetime import date

import numpy as np
import pytest

from ripplegraph.operators import market

D = lambda n: date(2024, 1, n)
PRICES = "ticker string, day date, t_idx int, r double, close double, open double, bench string"
BENCH = "bench string, day date, close double, open double"


def frames(spark, days=(2, 3, 4, 5, 8, 9, 10, 11)):
    prices = [("x", D(d), i, 0.0, 100.0 + 2 * i, 99.0 + 2 * i, "own") for i, d in enumerate(days)]
    bench = [("own", D(d), 50.0 + i, 49.5 + i) for i, d in enumerate(days) if d != 10] + [("market", D(d), 1.0, 1.0) for d in days]
    return spark.createDataFrame(prices, PRICES), spark.createDataFrame(bench, BENCH)


def test_outcomes_by_hand(spark):
    prices, bench = frames(spark)
    signals = [(1, "x", D(3), 0, "positive", 0.5), (2, "x", D(6), 1, "negative", 0.2), (3, "x", D(2), 1, "positive", 0.2), (4, "x", D(11), 1, "positive", 0.2), (5, "x", D(20), 1, "positive", 0.2), (6, "x", D(9), 0, "positive", 0.3), (7, "no", D(3), 0, "positive", 0.3)]
    rows = market.outcomes(spark.createDataFrame(signals, "event_id int, ticker string, pub date, hop int, direction string, magnitude double"), prices, bench, (1, 3)).collect()
    got = {(r.event_id, r.horizon): r for r in rows}
    # Event 1: told on the 3rd (index 1), entered at the open of the 4th, left at the close of the 5th; the benchmark is the ticker's own.
    one = got[1, 1]
    assert (one.entry_day, one.exit_day, one.bench) == (D(4), D(5), "own")
    assert one.abn_ret == pytest.approx((106 / 103 - 1) - (53 / 51.5 - 1))
    assert one.ann_abn == pytest.approx((102 / 100 - 1) - (51 / 50 - 1)) and one.gap_abn == pytest.approx((103 / 102 - 1) - (51.5 / 51 - 1))
    # Event 2: told on a Saturday, entered on Monday the 8th; all that was missed is one gap from Friday's close.
    two = got[2, 1]
    assert (two.entry_day, two.exit_day, two.ann_abn) == (D(8), D(9), None)
    assert two.gap_abn == pytest.approx((107 / 106 - 1) - (53.5 / 53 - 1)) and two.net == pytest.approx(-two.abn_ret - market.COST)
    # Event 3: nothing is known before the first session. Events 4 and 5 have no later session; event 6 would enter on the 10th, when its benchmark has no price; so event 2 has no exit then.
    assert got[3, 1].ann_abn is None and got[3, 1].gap_abn is not None
    assert {k[0] for k in got} == {1, 2, 3} and (1, 3) in got and (2, 3) in got
    assert (got[2, 3].exit_day, got[1, 3].exit_day) == (D(11), D(9))


def test_mid_ranks_of_groups_of_any_size(spark):
    rng = np.random.default_rng(7)
    rows = [(g, int(v)) for g, n in (("a", 400), (None, 30), ("b", 1)) for v in rng.integers(0, 40, n)] + [("a", None), ("c", None)]
    got = sorted((r.g or "", r.v if r.v is not None else -1, r.k) for r in market.mid_ranks(spark.createDataFrame(rows, "g string, v int"), ["g"], "v", "k").collect())
    want = []
    for g, v in rows:
        group = [w for h, w in rows if h == g and w is not None]
        want.append((g or "", -1, None) if v is None else (g or "", v, sum(w < v for w in group) + (sum(w == v for w in group) + 1) / 2))
    assert got == sorted(want, key=lambda w: (w[0], w[1]))


ROWS = "g string, direction string, magnitude double, hit int, abn_ret double, net double, ann_abn double, gap_abn double"


def test_stat_block_by_hand(spark):
    rows = [("a", "positive", 0.1, 1, 0.02, 0.019, 0.01, 0.004), ("a", "positive", 0.2, 1, 0.03, 0.029, -0.01, None), ("a", "negative", 0.3, 1, -0.04, 0.039, -0.02, 0.002), ("a", "negative", 0.4, 0, 0.01, -0.011, None, 0.0), ("a", "positive", 0.5, 0, -0.05, -0.051, 0.0, 0.002)]
    rows += [("b", "positive", 0.5, 1, 0.0005, -0.0005, None, None)] * 6
    got = {r.g: r for r in market.stat_block(spark.createDataFrame(rows, ROWS), "g", ic=True).collect()}
    a, b = got["a"], got["b"]
    assert (a.n, a.hits, a.hit_rate, a.net_hit_rate, a.dir_acc, a.mean_gap) == (5, 3, 0.6, 0.6, 0.5, 0.002)
    assert (a.mean_abn, a.median_abn, a.mean_net) == (-0.006, 0.01, 0.005)
    # Magnitudes rank 1..5; the predicted direction's returns 0.02, 0.03, 0.04, -0.01, -0.05 rank 3, 4, 5, 2, 1.
    assert a.ic == pytest.approx(np.corrcoef([1, 2, 3, 4, 5], [3, 4, 5, 2, 1])[0, 1], abs=1e-4)
    assert (a.ci_low, a.ci_high) == (a.net_ci_low, a.net_ci_high)
    assert (b.hit_rate, b.net_hit_rate, b.dir_acc, b.mean_gap, b.ic) == (1.0, 0.0, None, None, None)  # constant, so no correlation
    assert market.stat_block(spark.createDataFrame([], ROWS), "g", ic=True).count() == 0
