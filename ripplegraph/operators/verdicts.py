"""Decisions of the event study: several-factor models, placebo distributions, power and the verdict of each role."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ripplegraph.operators.cohorts import _EVENTS, PERMS, _study, build_events_rows, relabel, ripples
from ripplegraph.operators.market import _FRAME, _OUT, _OUTCOMES, _frame, _outcomes, clustered_mean, holm, moments, t_p
from ripplegraph.operators.study import REPS, bootstrap_means, period
from ripplegraph.plans.catalog import query
from ripplegraph.plans.logical import view, with_views
from ripplegraph.session import materialize

#: Least t of a claim, and the least effect in the holdout that matters: 50 basis points.
T_CLAIM, LEAST_EFFECT = 3.0, 0.005


@F.pandas_udf(ArrayType(DoubleType()))
def _solve(cov: pd.Series, with_y: pd.Series) -> pd.Series:
    """Slopes from the factors' covariances (row by row) and those with y; the least-norm ones where factors are collinear."""
    if not len(cov):
        return pd.Series([], dtype=object)
    c = np.stack([np.asarray(v, float) for v in with_y])
    a = np.stack([np.asarray(v, float) for v in cov]).reshape(len(c), c.shape[1], c.shape[1])
    return pd.Series(list(np.einsum("nij,nj->ni", np.linalg.pinv(a, rcond=1e-12, hermitian=True), c)))


def factor_model(frame: DataFrame, factors: list[str], low: int = -270, high: int = -21, least: int = 200) -> DataFrame:
    """Rolling regression of y on several factors, frozen at each row: n, slopes (in the factors' order), alpha, sigma, ar.

    Moments are running sums; only the small solve leaves the JVM, in Arrow batches. A row with a null
    in y or a factor counts for nothing; fewer than `least` rows give no row.
    """
    m = moments(frame, "y", factors, low, high).where(F.col("n") >= least)
    about = lambda a, b: F.col(f"s_{a}_{b}" if a == "y" or factors.index(a) <= factors.index(b) else f"s_{b}_{a}") / (F.col("n") - 1)
    m = m.select(*frame.columns, "n", F.array(*[about(a, b) for a in factors for b in factors]).alias("__c"), F.array(*[about("y", a) for a in factors]).alias("__y"),
                 (F.col("s_y_y") / (F.col("n") - 1)).alias("__v"), F.col("m_y").alias("__my"), F.array(*[F.col(f"m_{a}") for a in factors]).alias("__m"))
    m = m.withColumn("slopes", _solve("__c", "__y"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    left = F.greatest(F.col("__v") - dot("slopes", "__y"), F.lit(0.0))
    m = m.withColumn("alpha", F.col("__my") - dot("slopes", "__m")).withColumn("sigma", F.sqrt(left * (F.col("n") - 1) / (F.col("n") - 1 - len(factors))))
    return m.withColumn("ar", F.col("y") - F.col("alpha") - dot("slopes", F.array(*[F.col(f) for f in factors]))).drop("__c", "__y", "__v", "__my", "__m")


_W = "OVER (PARTITION BY ticker ORDER BY t_idx ROWS BETWEEN 270 PRECEDING AND 21 PRECEDING)"


@query(with_views("prices") + _FRAME + f""", f2 AS (SELECT *, lag(x) OVER (PARTITION BY ticker ORDER BY t_idx) AS x2 FROM f), u AS (SELECT *, CASE WHEN x2 IS NOT NULL THEN x END AS x1, CASE WHEN x2 IS NOT NULL THEN y END AS yy FROM f2),
c AS (SELECT ticker, day, t_idx, y, x, x2, count(yy) {_W} AS n, covar_samp(x1, x1) {_W} AS s11, covar_samp(x1, x2) {_W} AS s12, covar_samp(x2, x2) {_W} AS s22, covar_samp(yy, x1) {_W} AS y1, covar_samp(yy, x2) {_W} AS y2, avg(yy) {_W} AS my, avg(x1) {_W} AS m1, avg(x2) {_W} AS m2 FROM u),
b AS (SELECT *, (y1 * s22 - y2 * s12) / (s11 * s22 - s12 * s12) AS b1, (y2 * s11 - y1 * s12) / (s11 * s22 - s12 * s12) AS b2 FROM c WHERE t_idx >= 270 AND n >= 200)
SELECT ticker, day, n, round(b1, 4) + 0.0 AS b_market, round(b2, 4) + 0.0 AS b_before, round(y - (my - b1 * m1 - b2 * m2) - b1 * x - b2 * x2, 6) + 0.0 AS ar FROM b""")
def factor_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market's return and that of the day before as two factors."""
    frame = _frame(spark, sf_dir).withColumn("x2", F.lag("x").over(Window.partitionBy("ticker").orderBy("t_idx")))
    m = factor_model(frame, ["x", "x2"])
    return m.select("ticker", "day", "n", (F.round(F.col("slopes")[0], 4) + 0.0).alias("b_market"), (F.round(F.col("slopes")[1], 4) + 0.0).alias("b_before"), (F.round("ar", 6) + 0.0).alias("ar"))


_PLACEBO = _EVENTS + f""", rp AS (SELECT a, e_idx, day, b, w, s * (car - (sum(car) OVER g - car) / (count(*) OVER g - 1)) AS ripple FROM cr WINDOW g AS (PARTITION BY a, e_idx, w) QUALIFY count(*) OVER g >= 3),
kv AS (SELECT a || ':' || e_idx AS a, b, w, ripple, a AS src FROM rp), real AS (SELECT kv.* FROM kv JOIN lk ON lk.a = src AND lk.b = kv.b),
pool AS (SELECT a, b AS c, row_number() OVER (PARTITION BY a ORDER BY b) - 1 AS i, count(*) OVER (PARTITION BY a) AS n FROM (SELECT DISTINCT a, b FROM kv)),
dr AS (SELECT perm, r.a, r.b, c FROM (SELECT DISTINCT a, b FROM real) r CROSS JOIN range({PERMS}) q(perm) JOIN pool p ON p.a = r.a AND p.i = ('0x' || substr(md5(perm || '-' || r.a || '-' || r.b), 1, 8))::BIGINT % p.n WHERE c <> r.b),
pb AS (SELECT perm, w, avg(ripple) AS mean FROM dr JOIN kv ON kv.a = dr.a AND kv.b = dr.c GROUP BY ALL),
rm AS (SELECT w, avg(ripple) AS real_mean FROM real GROUP BY w)"""


@query(with_views("prices") + _PLACEBO + """ SELECT w AS "window", count(*) AS perms, round(quantile_cont(mean, 0.05), 6) + 0.0 AS p05, round(quantile_cont(mean, 0.5), 6) + 0.0 AS p50, round(quantile_cont(mean, 0.95), 6) + 0.0 AS p95,
 round(avg((abs(mean) >= abs(real_mean) - 1e-12)::INT), 6) AS p_value FROM pb JOIN rm USING (w) GROUP BY w""")
def placebo_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means under relabelled partners by window: their quantiles, and the share as far from 0 as the real mean."""
    every, links = ripples(spark, sf_dir)
    keyed = materialize(every.withColumn("sector", F.concat_ws(":", "a", "e_idx")))
    real = keyed.join(links, ["a", "b"]).select("sector", "b", "window", "ripple")
    # The pool of an event is the tickers of that day, so a window of a few rows; a partner is drawn once for all windows.
    place = (F.row_number().over(Window.partitionBy("sector").orderBy("b")) - 1).cast("long")
    pool = keyed.select("sector", "b").distinct().select("sector", F.col("b").alias("c"), place.alias("i"))
    drawn = relabel(real.select(F.col("sector").alias("a"), "b", "sector").distinct(), pool)
    values = keyed.select(F.col("sector").alias("a"), F.col("b").alias("c"), "window", "ripple")
    means = drawn.join(values, ["a", "c"]).groupBy("perm", "window").agg(F.avg("ripple").alias("mean"))
    means = means.join(real.groupBy("window").agg(F.avg("ripple").alias("real_mean")), "window")
    at = lambda q, name: (F.round(F.percentile("mean", F.lit(q)), 6) + 0.0).alias(name)
    far = (F.abs("mean") >= F.abs("real_mean") - 1e-12).cast("int")
    return means.groupBy("window").agg(F.count("*").alias("perms"), at(0.05, "p05"), at(0.5, "p50"), at(0.95, "p95"), F.round(F.avg(far), 6).alias("p_value"))


def power_curve(means: DataFrame, mean: float, se: float, threshold: float = T_CLAIM, step_bp: int = 5, most_bp: int = 300) -> DataFrame:
    """effect_bp, power: the share of resampled means, moved to the effect, whose t is above the threshold; a row per effect."""
    grid = means.withColumn("effect_bp", F.explode(F.sequence(F.lit(0), F.lit(most_bp), F.lit(step_bp))))
    found = ((F.col("mean") - F.lit(mean) + F.col("effect_bp") / 10000.0) / F.lit(se) > threshold).cast("int")
    return grid.groupBy("effect_bp").agg(F.round(F.avg(found), 6).alias("power"))


@query(with_views(*_OUT) + _OUTCOMES + f""", d AS (SELECT pub, sum(abn_ret) AS s, count(*) AS m FROM o WHERE horizon = 1 GROUP BY pub), k AS (SELECT *, row_number() OVER (ORDER BY pub) - 1 AS g FROM d),
r AS (SELECT rep, ('0x' || substr(md5(rep || '-' || id), 1, 8))::BIGINT % (SELECT count(*) FROM k) AS g FROM range({REPS}) a(rep), (SELECT g AS id FROM k)), t AS (SELECT rep, sum(s) / sum(m) AS mean FROM r JOIN k USING (g) GROUP BY rep),
c AS (SELECT sum(s) / sum(m) AS mean, sum(m) AS n, count(*) AS g FROM d), ce AS (SELECT c.mean, sqrt(c.g / (c.g - 1) * sum(pow(s - m * c.mean, 2))) / c.n AS se FROM d, c GROUP BY c.mean, c.g, c.n)
SELECT bp::INT AS effect_bp, round(avg(((t.mean - ce.mean + bp / 10000.0) / ce.se > 3.0)::INT), 6) AS power FROM t, ce, range(0, 301, 5) q(bp) GROUP BY bp""")
def power_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power of the one-day mean over resampled days for effects of 0 to 3 % in steps of 5 basis points."""
    rows = materialize(_outcomes(spark, sf_dir).where("horizon = 1").select("pub", "abn_ret", F.lit(1).alias("all")))
    sums = rows.groupBy("pub").agg(F.sum("abn_ret").alias("s"), F.count("*").alias("m"))
    # A row for each day of the calendar, so one small window.
    sums = materialize(sums.withColumn("g", (F.row_number().over(Window.orderBy("pub")) - 1).cast("long")))
    cell = clustered_mean(rows, "abn_ret", "pub", "all").first()
    if cell is None:
        return spark.createDataFrame([], "effect_bp int, power double")
    return power_curve(bootstrap_means(sums), cell["mean"], cell["se"])


#: Roles of a linked brand beside the shocked one, and the windows whose effect would be a slow one; their cells are one family of tests.
ROLES, SLOW = ("larger", "smaller", "equal"), ("w5", "w20", "w60")
#: Controls of an event, share of the family's error, one-sided level of the holdout, and the effect that a role must be able to show in SLOW[1].
K, FAMILY_ALPHA, HOLDOUT_ALPHA, MDE_LIMIT = 5, 0.05, 0.05, 0.015
#: Standard errors above the bar at which a test finds an effect four times in five.
POWER_Z = 0.8416
#: A placebo counts if so many of its permutations have a value, and if its median number of events is this share of the real one.
LEAST_FINITE, LEAST_COVERAGE = 0.9, 0.5


def role(size_a: Column, size_b: Column) -> Column:
    return F.when(size_b > size_a, "larger").when(size_b < size_a, "smaller").otherwise("equal")


def study_cells(events: DataFrame) -> DataFrame:
    """role, window, period, n, df, mean, se, t, p (two-sided) of events (role, window, day, ripple), clustered by the ISO week; cells of one week have none."""
    rows = events.withColumn("period", period(F.col("day"))).where("period is not null")
    rows = rows.withColumn("week", F.concat_ws("-", F.expr("extract(yearofweek from day)"), F.weekofyear("day")))
    cells = clustered_mean(rows, "ripple", "week", "role", "window", "period").where("se > 0")
    cells = cells.select("role", "window", "period", "n", (F.col("n_clusters") - 1).alias("df"), "mean", "se", (F.col("mean") / F.col("se")).alias("t"))
    return cells.withColumn("p", t_p("t", "df"))


def placebo_gates(means: DataFrame, real: DataFrame, perms: int = PERMS) -> DataFrame:
    """role, window, real_mean, p05, p95, evaluable, reason of permutations (perm, role, window, mean, covered) and the real (role, window, real_mean, real_count).

    Not evaluable with under LEAST_FINITE of the permutations, or where the median number of events they cover (none in those without a value) is under LEAST_COVERAGE of the real.
    """
    at = lambda q: F.percentile("mean", F.lit(q))
    whole = means.groupBy("role", "window").agg(F.count("mean").alias("n_finite"), at(0.05).alias("p05"), at(0.95).alias("p95"), F.collect_list("covered").alias("covered"))  # `perms` numbers
    # The permutations without a row cover nothing; they stand first in the order.
    order = F.sort_array("covered")
    place = lambda i: F.when(F.lit(i) - (perms - F.size("covered")) < 0, 0).otherwise(F.get(order, (F.lit(i) - (perms - F.size("covered"))).cast("int")))
    median = (place((perms - 1) // 2) + place(perms // 2)) / 2
    j = real.join(whole, ["role", "window"], "left").withColumn("n_finite", F.coalesce("n_finite", F.lit(0))).withColumn("median_covered", F.coalesce(median, F.lit(0.0)))
    few, thin = F.col("n_finite") < math.ceil(LEAST_FINITE * perms), F.col("median_covered") < LEAST_COVERAGE * F.col("real_count")
    reason = F.when(few, "few permutations have a value").when(thin, "permutations cover few events").otherwise("")
    return j.select("role", "window", "real_mean", "p05", "p95", (~(few | thin)).alias("evaluable"), reason.alias("reason"))


def decide(cells: DataFrame, gates: DataFrame) -> DataFrame:
    """A row for each role and slow window: what the exploration claims, and what of it the holdout, the floor and the placebo leave.

    A claim is |t| above T_CLAIM that Holm's procedure rejects within the family of all roles and slow windows (cells without a t count in it). It passes if the
    holdout's one-sided p in the claim's direction is under HOLDOUT_ALPHA, its mean in that direction is LEAST_EFFECT or more, and the real mean beats the placebo's 95 %.
    h1: the same-day claim of the role, in both periods; mde: what the role can show in SLOW[1] in the exploration.
    """
    spark = cells.sparkSession
    of = lambda c, p: F.max(F.when(F.col("period") == p, F.col(c)))
    wide = cells.groupBy("role", "window").agg(*[of(c, p).alias(f"{c}_{p[0]}") for p in ("exploration", "holdout") for c in ("mean", "se", "t", "p")])
    grid = spark.createDataFrame([(r, w) for r in ROLES for w in ("d0", *SLOW)], "role string, window string").join(F.broadcast(wide), ["role", "window"], "left")
    slow = holm(grid.where("window <> 'd0'").withColumn("test", F.concat_ws("|", "role", "window")), "p_e", FAMILY_ALPHA)
    way = F.signum("mean_e")
    against = lambda t, p: F.when(t > 0, p / 2).otherwise(1 - p / 2)  # noqa: E731  one-sided, towards positive t
    slow = slow.withColumn("claim", F.coalesce(F.col("rejected") & (F.abs("t_e") > T_CLAIM), F.lit(False))).withColumn("direction", F.coalesce(way, F.lit(0.0)).cast("int"))
    slow = slow.withColumn("p_one", against(way * F.col("t_h"), F.col("p_h"))).withColumn("toward", way * F.col("mean_h"))
    slow = slow.join(F.broadcast(gates), ["role", "window"], "left")
    beats = F.col("evaluable") & F.when(way > 0, F.col("real_mean") > F.col("p95")).otherwise(-F.col("real_mean") > -F.col("p05"))
    slow = slow.withColumn("replicates", F.coalesce(F.col("p_one") < HOLDOUT_ALPHA, F.lit(False))).withColumn("floor_ok", F.coalesce(F.col("toward") >= LEAST_EFFECT, F.lit(False)))
    slow = slow.withColumn("beats_placebo", F.coalesce(beats, F.lit(False))).withColumn("pass", F.col("claim") & F.col("replicates") & F.col("floor_ok") & F.col("beats_placebo"))
    gone = F.col("claim") & ~F.col("pass") & (F.col("p_one").isNull() | ~F.coalesce("evaluable", F.lit(False)))
    slow = slow.withColumn("unevaluable", gone).withColumn("reason", F.when(~F.col("claim"), "no claim").when(F.col("pass"), "").when(F.col("p_one").isNull(), "no holdout cell").when(~F.coalesce("evaluable", F.lit(False)), F.coalesce("reason", F.lit("no placebo")))
                    .when(~F.col("replicates"), "not replicated").when(~F.col("floor_ok"), "below the floor").otherwise("not above the placebo"))
    same_day = grid.where("window = 'd0'").select("role", F.coalesce((F.col("t_e") > T_CLAIM) & (F.col("mean_h") > 0) & (against(F.col("t_h"), F.col("p_h")) < HOLDOUT_ALPHA), F.lit(False)).alias("h1"))
    able = grid.where(F.col("window") == SLOW[1]).select("role", ((T_CLAIM + POWER_Z) * F.col("se_e")).alias("mde"))
    return slow.join(F.broadcast(same_day), "role").join(F.broadcast(able), "role").select(
        "role", "window", "direction", "claim", "replicates", "floor_ok", "beats_placebo", "pass", "unevaluable", "reason", "h1", "mde", "t_e", "p_e", "p_one", "toward")


def role_verdicts(decisions: DataFrame) -> DataFrame:
    """role, slow, underpowered, unevaluable, h1, verdict; a role whose effect in SLOW[1] can't be measured, or not below MDE_LIMIT, is underpowered."""
    v = decisions.groupBy("role").agg(F.bool_or("pass").alias("slow"), F.coalesce(F.max("mde") > MDE_LIMIT, F.lit(True)).alias("underpowered"), F.bool_or("unevaluable").alias("unevaluable"), F.bool_or("h1").alias("h1"))
    return v.withColumn("verdict", F.expr(_ORDER))


def study_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events with K controls: a, e_idx, day, b, window, ripple, role; placebo means by permutation in the holdout; the real means there)."""
    study = _study(spark, sf_dir)
    sizes = study[3].select("id", "size")
    roled = lambda rows: rows.join(sizes.toDF("a", "size_a"), "a").join(sizes.toDF("b", "size_b"), "b").withColumn("role", role(F.col("size_a"), F.col("size_b"))).drop("size_a", "size_b")
    events = roled(build_events_rows(spark, sf_dir, study).where(F.col("k") == K))
    every, links = ripples(spark, sf_dir)
    keyed = materialize(every.where((period(F.col("day")) == "holdout") & F.col("window").isin(*SLOW)).withColumn("event", F.concat_ws(":", "a", "e_idx")))
    real = roled(keyed.join(links, ["a", "b"]))
    place = (F.row_number().over(Window.partitionBy("event").orderBy("b")) - 1).cast("long")  # the tickers of a day
    pool = keyed.select("event", "b").distinct().select(F.col("event").alias("sector"), F.col("b").alias("c"), place.alias("i"))
    drawn = relabel(real.select(F.col("event").alias("a"), "b", F.col("event").alias("sector")).distinct(), pool)
    values = keyed.select(F.col("event").alias("a"), F.col("b").alias("c"), "window", "ripple")
    drawn = drawn.join(real.select(F.col("event").alias("a"), "b", "role", "window"), ["a", "b"]).join(values, ["a", "c", "window"])
    means = drawn.groupBy("perm", "role", "window").agg(F.avg("ripple").alias("mean"), F.count("*").alias("covered"))
    return events, means, real.groupBy("role", "window").agg(F.avg("ripple").alias("real_mean"), F.count("*").alias("real_count"))


def t_p_sql(t: str, df: str) -> str:
    """SQL for the two-sided p-value of Student's t with whole degrees of freedom: the finite series in the angle atan(|t| / sqrt(df))."""
    a, c = f"atan(abs({t}) / sqrt({df}))", f"sqrt({df} / ({df} + {t} * {t}))"
    even = f"sin({a}) * list_sum(list_transform(range({df} // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * pow({c}, 2 * k)))"
    odd = f"2 / pi() * ({a} + CASE WHEN {df} < 2 THEN 0 ELSE sin({a}) * {c} * list_sum(list_transform(range(({df} - 1) // 2), lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1) - lgamma(k + 1.5)) * pow({c}, 2 * k))) END)"
    return f"greatest(0, 1 - CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END)"


_PERIOD = "CASE WHEN day < DATE '1999-01-01' THEN 'exploration' WHEN day >= DATE '2000-01-01' THEN 'holdout' END"
_ROLE = "CASE WHEN lb.size > la.size THEN 'larger' WHEN lb.size < la.size THEN 'smaller' ELSE 'equal' END"
_DECIDE = _EVENTS + f""", er AS (SELECT ev.*, {_ROLE} AS role, {_PERIOD} AS period FROM ev JOIN ld la ON la.t = a JOIN ld lb ON lb.t = b WHERE k = {K}),
wk AS (SELECT role, w, period, strftime(day, '%G-%V') AS week, sum(ripple) AS s, count(*) AS m FROM er WHERE period IS NOT NULL GROUP BY ALL), tt AS (SELECT role, w, period, sum(s) / sum(m) AS mean, sum(m) AS n, count(*) AS g FROM wk GROUP BY ALL),
ce AS (SELECT role, w, period, mean, n, tt.g - 1 AS df, sqrt(tt.g / (tt.g - 1) * sum(pow(s - m * mean, 2))) / n AS se FROM wk JOIN tt USING (role, w, period) WHERE tt.g >= 2 GROUP BY role, w, period, mean, n, tt.g),
cp AS (SELECT *, mean / se AS t, {t_p_sql("(mean / se)", "df")} AS p FROM ce WHERE se > 0),
rp AS (SELECT a || ':' || e_idx AS e, a, b, w, day, s * (car - (sum(car) OVER g - car) / (count(*) OVER g - 1)) AS ripple FROM cr WINDOW g AS (PARTITION BY a, e_idx, w) QUALIFY count(*) OVER g >= 3),
kv AS (SELECT * FROM rp WHERE {_PERIOD} = 'holdout' AND w IN ('w5', 'w20', 'w60')), real AS (SELECT kv.*, {_ROLE} AS role FROM kv JOIN lk USING (a, b) JOIN ld la ON la.t = a JOIN ld lb ON lb.t = b),
pool AS (SELECT e, b AS c, row_number() OVER (PARTITION BY e ORDER BY b) - 1 AS i, count(*) OVER (PARTITION BY e) AS n FROM (SELECT DISTINCT e, b FROM kv)),
dr AS (SELECT perm, r.e, r.b, c FROM (SELECT DISTINCT e, b FROM real) r CROSS JOIN range({PERMS}) q(perm) JOIN pool p ON p.e = r.e AND p.i = ('0x' || substr(md5(perm || '-' || r.e || '-' || r.b), 1, 8))::BIGINT % p.n WHERE c <> r.b AND c <> r.e),
pb AS (SELECT perm, role, real.w, avg(kv.ripple) AS mean, count(*) AS covered FROM dr JOIN real USING (e, b) JOIN kv ON kv.e = dr.e AND kv.b = dr.c AND kv.w = real.w GROUP BY ALL),
rm AS (SELECT role, w, avg(ripple) AS real_mean, count(*) AS real_count FROM real GROUP BY ALL),
pq AS (SELECT rm.role, rm.w, any_value(real_mean) AS real_mean, any_value(real_count) AS real_count, count(mean) AS finite, quantile_cont(mean, 0.05) AS p05, quantile_cont(mean, 0.95) AS p95, median(coalesce(covered, 0)) AS cover FROM rm CROSS JOIN range({PERMS}) q(perm) LEFT JOIN pb ON pb.perm = q.perm AND pb.role = rm.role AND pb.w = rm.w GROUP BY rm.role, rm.w),
ga AS (SELECT *, finite >= {LEAST_FINITE} * {PERMS} AND cover >= {LEAST_COVERAGE} * real_count AS evaluable FROM pq),
gr AS (SELECT role, w FROM (VALUES ('larger'), ('smaller'), ('equal')) x(role) CROSS JOIN (VALUES ('d0'), ('w5'), ('w20'), ('w60')) y(w)),
wd AS (SELECT gr.role, gr.w, x.mean AS me, x.se AS se, x.t AS te, x.p AS pe, h.mean AS mh, h.t AS th, h.p AS ph FROM gr LEFT JOIN cp x ON x.role = gr.role AND x.w = gr.w AND x.period = 'exploration' LEFT JOIN cp h ON h.role = gr.role AND h.w = gr.w AND h.period = 'holdout'),
hm AS (SELECT *, bool_and(coalesce(pe <= {FAMILY_ALPHA} / (9 - k + 1), false)) OVER (ORDER BY k) AS rejected FROM (SELECT *, row_number() OVER (ORDER BY pe NULLS LAST, role || '|' || w) AS k FROM wd WHERE w <> 'd0')),
sl AS (SELECT hm.*, coalesce(rejected AND abs(te) > {T_CLAIM}, false) AS claim, CASE WHEN sign(me) * th > 0 THEN ph / 2 ELSE 1 - ph / 2 END AS p_one, sign(me) * mh AS toward, real_mean, p05, p95, coalesce(evaluable, false) AS evaluable FROM hm LEFT JOIN ga USING (role, w)),
de AS (SELECT role, w, coalesce(sign(me), 0)::INT AS direction, claim, coalesce(p_one < {HOLDOUT_ALPHA}, false) AS replicates, coalesce(toward >= {LEAST_EFFECT}, false) AS floor_ok, coalesce(evaluable AND CASE WHEN sign(me) > 0 THEN real_mean > p95 ELSE real_mean < p05 END, false) AS beats_placebo, evaluable, p_one, te, pe FROM sl),
dp AS (SELECT *, claim AND replicates AND floor_ok AND beats_placebo AS pass FROM de), du AS (SELECT *, claim AND NOT pass AND (p_one IS NULL OR NOT evaluable) AS unevaluable FROM dp),
dh AS (SELECT role, coalesce(te > {T_CLAIM} AND mh > 0 AND CASE WHEN th > 0 THEN ph / 2 ELSE 1 - ph / 2 END < {HOLDOUT_ALPHA}, false) AS h1 FROM wd WHERE w = 'd0'), dm AS (SELECT role, ({T_CLAIM} + {POWER_Z}) * se AS mde FROM wd WHERE w = 'w20'),
v AS (SELECT role, bool_or(pass) AS slow, coalesce(max(mde) > {MDE_LIMIT}, true) AS underpowered, bool_or(unevaluable) AS unevaluable, bool_or(h1) AS h1 FROM du JOIN dh USING (role) JOIN dm USING (role) GROUP BY role)"""
_ORDER = "CASE WHEN slow THEN 'slow_ripple' WHEN (underpowered OR unevaluable) AND h1 THEN 'same_day_slow_inconclusive' WHEN underpowered THEN 'inconclusive_underpowered' WHEN unevaluable THEN 'inconclusive_unevaluable' WHEN h1 THEN 'same_day_only' ELSE 'no_ripple' END"


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, means, real = study_events(spark, sf_dir)
    return decide(materialize(study_cells(events)), placebo_gates(means, real))


@query(with_views("prices") + _DECIDE + """ SELECT role, w AS "window", direction, claim, replicates, floor_ok, beats_placebo, pass, unevaluable, round(te, 4) AS t, round(pe, 6) + 0.0 AS p, round(p_one, 6) + 0.0 AS p_one FROM du""")
def study_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slow cell of the event study: the exploration's claim under Holm, and the gates it meets in the holdout."""
    d = _decisions(spark, sf_dir)
    flags = ["role", "window", "direction", "claim", "replicates", "floor_ok", "beats_placebo", "pass", "unevaluable"]
    return d.select(*flags, F.round("t_e", 4).alias("t"), (F.round("p_e", 6) + 0.0).alias("p"), (F.round("p_one", 6) + 0.0).alias("p_one"))


@query(with_views("prices") + _DECIDE + f" SELECT role, h1, slow, underpowered, unevaluable, {_ORDER} AS verdict FROM v")
def study_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for each role of the event study from its cells in both periods."""
    return role_verdicts(_decisions(spark, sf_dir)).select("role", "h1", "slow", "underpowered", "unevaluable", "verdict")


@query(with_views("prices") + _EVENTS + f""", er AS (SELECT ev.*, {_ROLE} AS role, {_PERIOD} AS period FROM ev JOIN ld la ON la.t = a JOIN ld lb ON lb.t = b WHERE k = {K}),
wk AS (SELECT role, w, period, strftime(day, '%G-%V') AS week, sum(ripple) AS s, count(*) AS m FROM er WHERE period IS NOT NULL GROUP BY ALL), tt AS (SELECT role, w, period, sum(s) / sum(m) AS mean, sum(m)::BIGINT AS n, count(*) AS g FROM wk GROUP BY ALL),
ce AS (SELECT role, w, period, mean, n, tt.g - 1 AS df, sqrt(tt.g / (tt.g - 1) * sum(pow(s - m * mean, 2))) / n AS se FROM wk JOIN tt USING (role, w, period) WHERE tt.g >= 2 GROUP BY role, w, period, mean, n, tt.g)
SELECT role, w AS "window", period, n, df, round(mean, 5) + 0.0 AS mean, round(mean / se, 4) + 0.0 AS t, round({t_p_sql("(mean / se)", "df")}, 6) + 0.0 AS p, round(mean - 1.96 * se, 5) + 0.0 AS ci_low, round(mean + 1.96 * se, 5) + 0.0 AS ci_high FROM ce WHERE se > 0""")
def role_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event study's cells by role, window and period: mean, t, its p by Student's t, and the interval of 1.96 standard errors."""
    study = _study(spark, sf_dir)
    sizes = study[3].select("id", "size")
    rows = build_events_rows(spark, sf_dir, study).where(F.col("k") == K).join(sizes.toDF("a", "size_a"), "a").join(sizes.toDF("b", "size_b"), "b")
    c = study_cells(rows.withColumn("role", role(F.col("size_a"), F.col("size_b"))))
    end = lambda z: F.round(F.col("mean") + z * F.col("se"), 5) + 0.0
    return c.select("role", "window", "period", "n", "df", (F.round("mean", 5) + 0.0).alias("mean"), (F.round("t", 4) + 0.0).alias("t"), (F.round("p", 6) + 0.0).alias("p"), end(-1.96).alias("ci_low"), end(1.96).alias("ci_high"))


@query(with_views(*_OUT, "prices") + _OUTCOMES + """, el AS (SELECT ticker, year(day) AS y, count(*) AS sessions FROM prices WHERE t_idx >= 270 GROUP BY ALL), sg AS (SELECT ticker, year(pub) AS y, count(DISTINCT pub) AS days FROM o WHERE horizon = 1 GROUP BY ALL)
SELECT ticker, y, sessions, coalesce(days, 0) AS days, round(coalesce(days, 0) / sessions, 6) AS share FROM el LEFT JOIN sg USING (ticker, y)""")
def power_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible sessions of each ticker and year, and how many of them have a signal."""
    e = view(spark, sf_dir, "prices").where("t_idx >= 270").groupBy("ticker", F.year("day").alias("y")).agg(F.count("*").alias("sessions"))
    s = _outcomes(spark, sf_dir).where("horizon = 1").groupBy("ticker", F.year("pub").alias("y")).agg(F.countDistinct("pub").alias("days"))
    days = F.coalesce("days", F.lit(0))
    return e.join(s, ["ticker", "y"], "left").select("ticker", "y", "sessions", days.alias("days"), F.round(days / F.col("sessions"), 6).alias("share"))
