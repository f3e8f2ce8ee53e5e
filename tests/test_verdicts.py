"""The study's gates and verdicts on hand-made cells: every state is reached, and every gate alone can stop a claim."""

import duckdb
import pytest

from ripplegraph.operators import market, verdicts

CELLS = "role string, window string, period string, n long, df long, mean double, se double, t double, p double"
GATES = "role string, window string, real_mean double, p05 double, p95 double, evaluable boolean, reason string"


def cell(role, window, period, mean, se, df=200):
    t = mean / se
    return (role, window, period, 1000, df, mean, se, t, market.t_tail(t, df))


def gate(role, window, real=0.01, low=-0.002, high=0.002, evaluable=True):
    return (role, window, real, low, high, evaluable, "" if evaluable else "few permutations have a value")


def run(spark, cells, gates):
    d = verdicts.decide(spark.createDataFrame(cells, CELLS), spark.createDataFrame(gates, GATES))
    rows = {(r.role, r.window): r for r in d.collect()}
    return rows, {r.role: r.verdict for r in verdicts.role_verdicts(d).collect()}


def quiet(role, se=0.001):
    """No effect anywhere, and small enough errors to have seen one."""
    return [cell(role, w, p, 0.0001, se) for w in ("d0", "w5", "w20", "w60") for p in ("exploration", "holdout")]


def replaced(cells, *new):
    keys = {c[:3] for c in new}
    return [c for c in cells if c[:3] not in keys] + list(new)


def same_day(role):
    return cell(role, "d0", "exploration", 0.01, 0.001), cell(role, "d0", "holdout", 0.008, 0.001)


def test_all_six_states(spark):
    slow = cell("larger", "w5", "exploration", 0.01, 0.001), cell("larger", "w5", "holdout", 0.009, 0.001)
    a = replaced(quiet("larger"), *slow) + replaced(quiet("smaller"), *same_day("smaller")) + quiet("equal")
    rows, v = run(spark, a, [gate("larger", "w5")])
    assert v == {"larger": "slow_ripple", "smaller": "same_day_only", "equal": "no_ripple"}
    assert rows["larger", "w5"]["pass"] and rows["larger", "w5"].reason == "" and rows["larger", "w20"].reason == "no claim"
    # The larger's claim has no placebo to beat; the smaller's errors are too large; the equal has both a same-day effect and large errors.
    b = replaced(quiet("larger"), *slow) + quiet("smaller", 0.01) + replaced(quiet("equal", 0.01), *same_day("equal"))
    rows, v = run(spark, b, [gate("larger", "w5", evaluable=False)])
    assert v == {"larger": "inconclusive_unevaluable", "smaller": "inconclusive_underpowered", "equal": "same_day_slow_inconclusive"}
    assert rows["larger", "w5"].unevaluable and rows["larger", "w5"].reason == "few permutations have a value"


@pytest.mark.parametrize(
    "holdout,g,reason",
    [
        ((0.009, 0.001), {}, ""),
        ((0.0049, 0.0001), {}, "below the floor"),
        ((0.005, 0.0001), {}, ""),
        ((0.009, 0.008), {}, "not replicated"),
        ((-0.009, 0.001), {}, "not replicated"),
        ((0.009, 0.001), {"real": 0.0015}, "not above the placebo"),
        ((0.009, 0.001), {"evaluable": False}, "few permutations have a value"),
        (None, {}, "no holdout cell"),
    ],
)
def test_each_gate(spark, holdout, g, reason):
    cells = [c for c in quiet("larger") if c[1:3] != ("w20", "holdout")]
    cells = replaced(cells, cell("larger", "w20", "exploration", 0.02, 0.002), *([cell("larger", "w20", "holdout", *holdout)] if holdout else []))
    rows, v = run(spark, cells, [gate("larger", "w20", **g)])
    got = rows["larger", "w20"]
    assert got.claim and got.reason == reason and got["pass"] == (reason == "")
    assert v["larger"] == ("slow_ripple" if reason == "" else "inconclusive_unevaluable" if got.unevaluable else "no_ripple")


def test_a_negative_claim_must_be_lower_than_its_placebo(spark):
    cells = replaced(quiet("equal"), cell("equal", "w60", "exploration", -0.02, 0.002), cell("equal", "w60", "holdout", -0.01, 0.001))
    assert run(spark, cells, [gate("equal", "w60", real=-0.01)])[0]["equal", "w60"]["pass"]
    assert not run(spark, cells, [gate("equal", "w60", real=-0.001)])[0]["equal", "w60"]["pass"]


def test_holm_counts_the_whole_family(spark):
    """With few degrees of freedom |t| of 3.1 has a p between 5 % / 9 and 5 %: alone it is no claim though two of the nine cells are all there is."""
    cells = [cell("larger", "w5", "exploration", 0.0031, 0.001, df=8), cell("larger", "w20", "exploration", 0.0001, 0.001, df=8)]
    got = run(spark, cells, [gate("larger", "w5")])[0]["larger", "w5"]
    assert got.t_e > verdicts.T_CLAIM and 0.05 / 9 < got.p_e < 0.05 and not got.claim
    assert run(spark, [cell("larger", "w5", "exploration", 0.0031, 0.001, df=400)], [])[0]["larger", "w5"].claim


def test_no_cells_are_inconclusive(spark):
    rows, v = run(spark, [], [])
    assert set(v.values()) == {"inconclusive_underpowered"} and len(rows) == 9


def test_placebo_gates(spark):
    means = [(k, "larger", "w5", 0.001 * k, 10) for k in range(100)]
    means += [(k, "smaller", "w5", 0.001 * k, 10) for k in range(89)]  # under nine tenths have a value
    means += [(k, "equal", "w5", 0.001 * k, 4 if k < 60 else 10) for k in range(100)]  # the median covers 4 of 10
    real = [(r, "w5", 0.05, 10) for r in ("larger", "smaller", "equal")] + [("larger", "w20", 0.01, 10)]
    got = {(r.role, r.window): r for r in verdicts.placebo_gates(spark.createDataFrame(means, "perm int, role string, window string, mean double, covered long"),
                                                                  spark.createDataFrame(real, "role string, window string, real_mean double, real_count long"), 100).collect()}
    assert got["larger", "w5"].evaluable and got["larger", "w5"].p95 == pytest.approx(0.09405)
    assert got["smaller", "w5"].reason == got["larger", "w20"].reason == "few permutations have a value"
    assert got["equal", "w5"].reason == "permutations cover few events" and not got["equal", "w5"].evaluable


@pytest.mark.parametrize("df", [1, 2, 3, 4, 7, 30, 101, 350])
def test_p_values_in_sql_and_in_tasks_agree(df):
    con = duckdb.connect()
    for t in (0.0, 0.3, -1.5, 2.9, 6.0):
        (p,) = con.execute(f"SELECT {verdicts.t_p_sql('t', 'df')} FROM (SELECT {t}::DOUBLE AS t, {df}::BIGINT AS df)").fetchone()
        assert p == pytest.approx(market.t_tail(t, df), abs=1e-10)
