"""Running-moment regressions against numpy, and stored projections that follow their tables."""

import re
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplegraph.operators import market, verdicts
from ripplegraph.plans import logical


def made(spark, sizes, holes=False, offset=0.0, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for k, n in enumerate(sizes):
        x, z = rng.normal(size=n) * 0.01 + offset, rng.normal(size=n) * 0.02
        y = 0.4 * x - 1.5 * z + rng.normal(size=n) * 0.005
        for i in range(n):
            rows.append((f"t{k}", i, None if holes and i % 13 == 3 else float(y[i]), None if holes and i % 17 == 5 else float(x[i]), float(z[i])))
    return rows, spark.createDataFrame(rows, "ticker string, t_idx int, y double, x double, z double").repartition(5)


@pytest.mark.parametrize("low,high", [(-270, -21), (-40, -21), (-7, 0), (-3, -3), (-19, -5)])
def test_window_sums_are_those_of_a_sliding_frame(spark, low, high):
    rows, df = made(spark, [400, 60, 5, 1], holes=True)
    got = {(r.ticker, r.t_idx): r.sums for r in market.window_sums(df, {"y": F.col("y"), "n": F.col("y").isNotNull().cast("double")}, low, high).collect()}
    want = {}
    for t in {r[0] for r in rows}:
        y = [r[2] for r in rows if r[0] == t]
        for i in range(-low, len(y)):
            part = [v for v in y[i + low : i + high + 1] if v is not None]
            want[t, i] = sum(part), len(part)
    assert got.keys() == want.keys()
    for k, (s, n) in want.items():
        assert got[k].n == n and abs(got[k].y - s) < 1e-12


@pytest.mark.parametrize("offset", [0.0, 1000.0])
def test_regressions_agree_with_least_squares(spark, offset):
    """Also where the market's mean is a hundred thousand times its spread."""
    rows, df = made(spark, [330], holes=True, offset=offset)
    one = {r.t_idx: r for r in market.market_model(df).collect()}
    two = {r.t_idx: r for r in verdicts.factor_model(df, ["x", "z"]).collect()}
    assert one.keys() == two.keys() and min(one) == 270
    for i in one:
        part = [r for r in rows[i - 270 : i - 20] if r[2] is not None and r[3] is not None]
        y, x, z = (np.array([r[c] for r in part]) for c in (2, 3, 4))
        c = x.mean()
        for row, factors in ((one[i], [x - c]), (two[i], [x - c, z])):
            a = np.column_stack([np.ones(len(y)), *factors])
            b = np.linalg.lstsq(a, y, rcond=None)[0]
            left = y - a @ b
            assert row.n == len(y)
            assert row.sigma == pytest.approx(np.sqrt(left @ left / (len(y) - a.shape[1])), rel=1e-9)
            slopes = [row.beta] if row is one[i] else row.slopes
            assert slopes == pytest.approx(list(b[1:]), rel=1e-8) and row.alpha == pytest.approx(b[0] - b[1] * c, rel=1e-6, abs=1e-9)


def test_a_flat_market_has_no_slope_and_short_tickers_no_row(spark):
    rows, df = made(spark, [300, 100])
    flat = df.withColumn("x", F.when(F.col("ticker") == "t0", F.lit(0.25)).otherwise(F.col("x")))
    found = market.market_model(flat).collect()
    assert {r.ticker for r in found} == {"t0"} and all(r.beta is None and r.ar is None for r in found)
    assert market.market_model(df.limit(0)).count() == 0


def test_plans_hold_no_sliding_frame(spark):
    frame = market._frame(spark, "/root/testdata/sf0.001")
    for df in (market.market_model(frame), verdicts.factor_model(frame, ["x"]), market.car_window(spark, "/root/testdata/sf0.001")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        frames = [[re.match(r"[\w-]+", end)[0] for end in f.split(", ")[:2]] for f in plan.split("RowFrame, ")[1:]]
        assert frames and all(low == high or low.startswith("unboundedpreceding") for low, high in frames)


def test_clean_flag_reads_few_tables(spark):
    plan = market.clean_flag(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") < 15


def test_stored_views_follow_files_rewritten_inside_a_folder(spark, tmp_path):
    for t in ("lineitem", "part"):
        shutil.copyfile(f"/root/testdata/sf0.001/{t}.parquet", tmp_path / f"{t}.parquet")
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    (tmp_path / "lineitem.parquet").unlink()
    folder = tmp_path / "lineitem.parquet"
    lines.coalesce(1).write.parquet(str(folder))
    first = logical.view(spark, str(tmp_path), "daily").count()
    again = logical.view(spark, str(tmp_path), "daily")
    key = (spark.sparkContext.applicationId, str(tmp_path), "daily")
    assert again.count() == first and len(logical._stored[key]) == 1
    paths = [logical._stored[key][-1][1]]
    for keep in (0.5, 0.25):
        (data,) = folder.glob("part-*.parquet")
        lines.where(F.col("l_orderkey") % 100 < 100 * keep).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "new"))
        (new,) = (tmp_path / "new").glob("part-*.parquet")
        for crc in folder.glob(".*.crc"):
            crc.unlink()
        shutil.copyfile(new, data)  # the folder's own entries stay as they were
        assert 0 < logical.view(spark, str(tmp_path), "daily").count() < first
        paths.append(logical._stored[key][-1][1])
    exists = lambda p: logical.content_state(spark, [p]) if spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(p)) else None
    assert len(set(paths)) == 3 and not exists(paths[0]) and exists(paths[1]) and exists(paths[2])
