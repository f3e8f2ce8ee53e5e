"""Price, outcome, reliability and event-study operators."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ripplegraph.plans.catalog import query
from ripplegraph.plans.logical import view, with_views
from ripplegraph.session import materialize, shuffle_partitions

HORIZONS = (1, 5, 20, 60)
COST = 0.001


def next_session(signals: DataFrame, prices: DataFrame) -> DataFrame:
    """signals with ann_idx, ann_day: the first session of the ticker on or after pub (an as-of join forward).

    The distinct days asked for and the sessions are interleaved and the next session is carried back, so no range
    join is made and a window holds days, however many signals a ticker has.
    """
    s = prices.select("ticker", F.col("day").alias("at"), F.lit(1).alias("kind"), "t_idx", F.col("day").alias("ann_day"))
    q = signals.select("ticker", "pub", F.col("pub").alias("at"), F.lit(0).alias("kind")).distinct()
    both = q.unionByName(s, allowMissingColumns=True)
    w = Window.partitionBy("ticker").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("ann_idx", F.last("t_idx", ignorenulls=True).over(w)).withColumn("ann_day", F.last("ann_day", ignorenulls=True).over(w))
    return signals.join(found.where("kind = 0").select("ticker", "pub", "ann_idx", "ann_day"), ["ticker", "pub"])


def outcomes(signals: DataFrame, prices: DataFrame, benchmarks: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """One row per signal and horizon that has an exit: stock, benchmark and abnormal return, hit and net of costs, and the move that was missed.

    Entry is the open of the announcing session, or of the next one if news came on a session day; exit the close `horizon` sessions after entry. Returns are abnormal against
    the ticker's own benchmark (bench), on days that both have. ann_abn is the announcing session's move and gap_abn the night's after it; where news came on a day without a
    session, all that was missed is one gap from the last close, and there is no ann_abn.
    """
    at = next_session(signals, prices).where("ann_idx is not null")
    at = at.withColumn("entry_idx", F.col("ann_idx") + (F.col("ann_day") == F.col("pub")).cast("int"))
    p = prices.join(benchmarks.select("bench", "day", F.col("open").alias("b_open"), F.col("close").alias("b_close")), ["bench", "day"], "left")
    session = Window.partitionBy("ticker").orderBy("t_idx")
    near = lambda f, c, out: f(c).over(session).alias(out)
    told = p.select("ticker", "bench", F.col("t_idx").alias("ann_idx"), F.col("open").alias("o0"), F.col("b_open").alias("bo0"), F.col("close").alias("pa"), F.col("b_close").alias("ba"), near(F.lag, "close", "c_prev"), near(F.lag, "b_close", "b_prev"),
                    near(F.lead, "day", "day1"), near(F.lead, "open", "o1"), near(F.lead, "b_open", "bo1"))
    leave = p.select("ticker", F.col("t_idx").alias("exit_idx"), F.col("day").alias("exit_day"), F.col("close").alias("p1"), F.col("b_close").alias("b1"))
    later = F.col("entry_idx") > F.col("ann_idx")
    enter = lambda out, after, same: F.when(later, F.col(after)).otherwise(F.col(same)).alias(out)
    rows = at.join(told, ["ticker", "ann_idx"]).select("*", enter("entry_day", "day1", "ann_day"), enter("p0", "o1", "o0"), enter("b0", "bo1", "bo0")).where("p0 is not null and b0 is not null")
    move = lambda a, b, c, d: (F.col(a) / F.col(b) - 1) - (F.col(c) / F.col(d) - 1)
    rows = rows.withColumn("ann_abn", F.when(later, move("pa", "c_prev", "ba", "b_prev"))).withColumn("gap_abn", F.when(later, move("p0", "pa", "b0", "ba")).otherwise(move("p0", "c_prev", "b0", "b_prev")))
    rows = rows.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("exit_idx", F.col("entry_idx") + F.col("horizon"))
    rows = rows.join(leave, ["ticker", "exit_idx"]).where("p1 is not null and b1 is not null")
    sign = F.when(F.col("direction") == "positive", 1).otherwise(-1)
    rows = rows.withColumn("abn_ret", move("p1", "p0", "b1", "b0")).withColumn("signed", sign * F.col("abn_ret"))
    return rows.select("event_id", "ticker", "bench", "hop", "direction", "magnitude", "pub", "entry_day", "exit_day", "horizon", "abn_ret", "ann_abn", "gap_abn", (F.col("signed") > 1e-9).cast("int").alias("hit"), (F.col("signed") - COST).alias("net"))


_OUT = ("prices", "benchmarks", "signals")
_OUTCOMES = """, a AS (SELECT s.*, p.t_idx AS ann_idx, p.day AS ann_day FROM signals s ASOF JOIN prices p ON s.ticker = p.ticker AND s.pub <= p.day),
e AS (SELECT *, ann_idx + CASE WHEN ann_day = pub THEN 1 ELSE 0 END AS entry_idx FROM a),
q0 AS (SELECT p.*, b.open AS b_open, b.close AS b_close FROM prices p LEFT JOIN benchmarks b ON b.bench = p.bench AND b.day = p.day),
q AS (SELECT *, lag(close) OVER g AS c_prev, lag(b_close) OVER g AS b_prev FROM q0 WINDOW g AS (PARTITION BY ticker ORDER BY t_idx)),
outcomes AS (SELECT event_id, e.ticker, n.bench, hop, direction, magnitude, pub, n.day AS entry_day, x.day AS exit_day, h AS horizon, (x.close / n.open - 1) - (x.b_close / n.b_open - 1) AS abn_ret,
 CASE WHEN entry_idx > ann_idx THEN (t.close / t.c_prev - 1) - (t.b_close / t.b_prev - 1) END AS ann_abn,
 CASE WHEN entry_idx > ann_idx THEN (n.open / t.close - 1) - (n.b_open / t.b_close - 1) ELSE (n.open / t.c_prev - 1) - (n.b_open / t.b_prev - 1) END AS gap_abn
 FROM e JOIN q n ON n.ticker = e.ticker AND n.t_idx = entry_idx JOIN q t ON t.ticker = e.ticker AND t.t_idx = ann_idx CROSS JOIN (VALUES (1), (5), (20), (60)) v(h) JOIN q x ON x.ticker = e.ticker AND x.t_idx = entry_idx + h
 WHERE n.b_open IS NOT NULL AND x.b_close IS NOT NULL),
o AS (SELECT *, (CASE WHEN direction = 'positive' THEN abn_ret ELSE -abn_ret END > 1e-9)::INT AS hit, CASE WHEN direction = 'positive' THEN abn_ret ELSE -abn_ret END - 0.001 AS net FROM outcomes)"""


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(view(spark, sf_dir, "signals"), view(spark, sf_dir, "prices"), view(spark, sf_dir, "benchmarks"))


@query(with_views(*_OUT) + _OUTCOMES + " SELECT event_id, ticker, bench, entry_day, exit_day, horizon, round(abn_ret, 5) + 0.0 AS abn_ret, round(ann_abn, 5) + 0.0 AS ann_abn, round(gap_abn, 5) + 0.0 AS gap_abn FROM o")
def signal_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = [(F.round(c, 5) + 0.0).alias(c) for c in ("abn_ret", "ann_abn", "gap_abn")]
    return _outcomes(spark, sf_dir).select("event_id", "ticker", "bench", "entry_day", "exit_day", "horizon", *moves)


@query(with_views("prices", "signals") + """
SELECT s.event_id, s.ticker, s.pub, p.day AS ann_day, p.t_idx::INT AS ann_idx FROM signals s ASOF JOIN prices p ON s.ticker = p.ticker AND s.pub <= p.day""")
def asof_next_trading_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next_session(view(spark, sf_dir, "signals"), view(spark, sf_dir, "prices")).where("ann_idx is not null").select("event_id", "ticker", "pub", "ann_day", F.col("ann_idx").cast("int").alias("ann_idx"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p, z2 = hits / n, z * z
    mid, half = p + z2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return (mid - half) / (1 + z2 / n), (mid + half) / (1 + z2 / n)


def mid_ranks(rows: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """rows with the rank of value in its group (ties share their mean), in `out`; rows without a value have none.

    Distinct values are counted and range-partitioned, so no task holds a group: a value's rank is the rows of earlier ranges of its group, those before it in
    its own, and half its ties. Null groups are groups. rows is read twice.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__m"))
    ranged = materialize(counts.repartitionByRange(shuffle_partitions(rows.sparkSession), *by, value).withColumn("__part", F.spark_partition_id()))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    parts = ranged.groupBy(*by, "__part").agg(F.sum("__m").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*by, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranged = ranged.withColumn("__in", F.coalesce(F.sum("__m").over(inside), F.lit(0)))
    same = lambda a, b, cols: [a[c].eqNullSafe(b[c]) for c in cols]
    placed = ranged.join(parts, same(ranged, parts, [*by, "__part"])).select(*[ranged[c] for c in (*by, value)], (F.col("__before") + F.col("__in") + (F.col("__m") + 1) / 2).alias(out))
    return rows.join(placed, same(rows, placed, [*by, value]), "left").select(*[rows[c] for c in rows.columns], out)


def rank_correlation(rows: DataFrame, x: str, y: str, by: list[str], least: int = 5) -> DataFrame:
    """by, ic: Spearman's correlation of x and y, null with fewer than `least` rows or where one of them is constant."""
    rows = materialize(rows.select(*by, F.col(x).alias("__x"), F.col(y).alias("__y")))
    ranked = mid_ranks(mid_ranks(rows, by, "__x", "rx"), by, "__y", "ry")
    corr = F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry"))
    return ranked.groupBy(*by).agg(F.when(F.count("*") >= least, corr).alias("ic"))


def stat_block(rows: DataFrame, *by: str, ic: bool = False) -> DataFrame:
    """n, hits, hit rate with its Wilson interval, mean and median abnormal return; the same net of costs; dir_acc, the share of announcing sessions that went the predicted way; the mean gap missed; by the columns given.

    With ic also Spearman's correlation of magnitude and the return in the predicted direction.
    """
    net_hit = (F.col("net") > 0).cast("int")
    low, high = wilson(F.sum("hit"), F.count("*"))
    net_low, net_high = wilson(F.sum(net_hit), F.count("*"))
    right = F.when(F.col("ann_abn").isNotNull(), ((F.col("direction") == "positive") == (F.col("ann_abn") > 1e-9)).cast("int"))
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("hit").alias("hits"), F.round(F.avg("hit"), 6).alias("hit_rate"), F.round(low, 6).alias("ci_low"), F.round(high, 6).alias("ci_high"),
        (F.round(F.avg("abn_ret"), 5) + 0.0).alias("mean_abn"), (F.round(F.median("abn_ret"), 5) + 0.0).alias("median_abn"), F.round(F.avg(net_hit), 6).alias("net_hit_rate"),
        F.round(net_low, 6).alias("net_ci_low"), F.round(net_high, 6).alias("net_ci_high"), (F.round(F.avg("net"), 5) + 0.0).alias("mean_net"), F.round(F.avg(right), 6).alias("dir_acc"), (F.round(F.avg("gap_abn"), 5) + 0.0).alias("mean_gap"),
    )
    if not ic:
        return out
    toward = F.when(F.col("direction") == "positive", F.col("abn_ret")).otherwise(-F.col("abn_ret"))
    found = rank_correlation(rows.withColumn("toward", F.round(toward, 9)), "magnitude", "toward", list(by))
    return out.join(found, [out[c].eqNullSafe(found[c]) for c in by]).select(*[out[c] for c in out.columns], (F.round("ic", 4) + 0.0).alias("ic"))


def _wilson_sql(p: str) -> str:
    half = f"1.96 * sqrt({p} * (1 - {p}) / count(*) + 3.8416 / (4.0 * count(*) * count(*)))"
    return ", ".join(f"round(({p} + 3.8416 / (2 * count(*)) {sign} {half}) / (1 + 3.8416 / count(*)), 6) AS {{}}ci_{end}" for sign, end in (("-", "low"), ("+", "high")))


_BLOCK = f"""count(*) AS n, sum(hit)::BIGINT AS hits, round(avg(hit), 6) AS hit_rate, {_wilson_sql("avg(hit)").replace("{}", "")},
 round(avg(abn_ret), 5) + 0.0 AS mean_abn, round(median(abn_ret), 5) + 0.0 AS median_abn, round(avg((net > 0)::INT), 6) AS net_hit_rate, {_wilson_sql("avg((net > 0)::INT)").replace("{}", "net_")},
 round(avg(net), 5) + 0.0 AS mean_net, round(avg(((direction = 'positive') = (ann_abn > 1e-9))::INT), 6) AS dir_acc, round(avg(gap_abn), 5) + 0.0 AS mean_gap"""
_IC = "CASE WHEN count(*) >= 5 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN round(corr(rx, ry), 4) + 0.0 END AS ic"


def _ranked_sql(rows: str, by: str) -> str:
    """CTE rk: the rows with the ranks of magnitude and of the return in the predicted direction within the groups."""
    rank = lambda v, r: f"rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0 AS {r}"
    return f", tw AS (SELECT *, round(CASE WHEN direction = 'positive' THEN abn_ret ELSE -abn_ret END, 9) AS toward FROM {rows}), rk AS (SELECT *, {rank('magnitude', 'rx')}, {rank('toward', 'ry')} FROM tw)"


_BAND = "CASE WHEN magnitude < 0.15 THEN 'low' WHEN magnitude < 0.35 THEN 'mid' WHEN magnitude < 0.6 THEN 'high' ELSE 'extreme' END"


@query(lambda: with_views(*_OUT) + _OUTCOMES + _CLEAN + f", bd AS (SELECT *, {_BAND} AS band FROM oc)" + _ranked_sql("bd", "hop, direction, band, horizon, clean") + f" SELECT hop, direction, band, horizon, clean, {_BLOCK}, {_IC} FROM rk GROUP BY ALL")
def reliability_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(_clean(spark, sf_dir).withColumn("band", F.expr(_BAND)))
    return stat_block(rows, "hop", "direction", "band", "horizon", "clean", ic=True)


#: The rollups, by the columns that tell their cells apart.
ROLLUPS = (("hop", "horizon"), ("hop", "horizon", "clean"), ("band", "horizon"), ("direction", "horizon"), ("horizon",), ())
_ROLLED = {"hop": "INT", "direction": "VARCHAR", "band": "VARCHAR", "clean": "BOOLEAN", "horizon": "INT"}


def _rollup_sql() -> str:
    keep = lambda s: ", ".join(c if c in s else f"NULL::{t}" for c, t in _ROLLED.items())
    sets = " UNION ALL ".join(f"SELECT '{'-'.join(s) or 'all'}', {keep(s)}, direction, magnitude, hit, abn_ret, net, ann_abn, gap_abn FROM bd" for s in ROLLUPS)
    columns = ", ".join(f"g_{c}" for c in _ROLLED)
    return (with_views(*_OUT) + _OUTCOMES + _CLEAN + f", bd AS (SELECT *, {_BAND} AS band FROM oc), ex(rollup, {columns}, direction, magnitude, hit, abn_ret, net, ann_abn, gap_abn) AS ({sets})" + _ranked_sql("ex", f"rollup, {columns}")
            + f" SELECT rollup, g_hop AS hop, g_direction AS direction, g_band AS band, g_clean AS clean, g_horizon AS horizon, {_BLOCK}, {_IC} FROM rk GROUP BY rollup, {columns}")


@query(_rollup_sql)
def reliability_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by hop (all and clean), by band, by direction, by horizon and altogether: rows are expanded into the cells they belong to."""
    rows = _clean(spark, sf_dir).withColumn("band", F.expr(_BAND))
    types = {c: rows.schema[c].dataType for c in _ROLLED}
    cell = lambda s: F.struct(F.lit("-".join(s) or "all").alias("rollup"), *[(F.col(c) if c in s else F.lit(None).cast(t)).alias(f"g_{c}") for c, t in types.items()])
    expanded = materialize(rows.select("direction", "magnitude", "hit", "abn_ret", "net", "ann_abn", "gap_abn", F.inline(F.array(*[cell(s) for s in ROLLUPS]))))
    return stat_block(expanded, "rollup", *[f"g_{c}" for c in _ROLLED], ic=True).withColumnsRenamed({f"g_{c}": c for c in _ROLLED})


@query(with_views(*_OUT) + _OUTCOMES + """, x AS (SELECT horizon, magnitude, round(CASE WHEN direction = 'positive' THEN abn_ret ELSE -abn_ret END, 9) AS y FROM o),
k AS (SELECT horizon, rank() OVER (PARTITION BY horizon ORDER BY magnitude) + (count(*) OVER (PARTITION BY horizon, magnitude) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY horizon ORDER BY y) + (count(*) OVER (PARTITION BY horizon, y) - 1) / 2.0 AS ry FROM x)
SELECT horizon, count(*) AS n, round(corr(rx, ry), 4) AS ic FROM k GROUP BY horizon HAVING count(*) >= 5""")
def spearman_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns are ranked to nine digits: a ticker that is its sector's only one has returns of nought and noise."""
    toward = F.when(F.col("direction") == "positive", F.col("abn_ret")).otherwise(-F.col("abn_ret"))
    rows = materialize(_outcomes(spark, sf_dir).select("horizon", "magnitude", F.round(toward, 9).alias("y")))
    sizes = rows.groupBy("horizon").agg(F.count("*").alias("n"))
    return sizes.join(rank_correlation(rows, "magnitude", "y", ["horizon"]), "horizon").where("n >= 5").select("horizon", "n", F.round("ic", 4).alias("ic"))


@query(with_views(*_OUT) + _OUTCOMES + f""", b AS (SELECT hop, direction, horizon, {_BLOCK} FROM o GROUP BY hop, direction, horizon)
SELECT hop, direction, horizon, n, round(CASE WHEN n >= 20 AND (ci_low > 0.5 OR ci_high < 0.5) THEN least(1.5, greatest(0.5, 1 + n / (n + 30.0) * 2 * (hit_rate - 0.5))) ELSE 1.0 END, 5) AS multiplier FROM b""")
def reliability_multiplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = stat_block(_outcomes(spark, sf_dir), "hop", "direction", "horizon")
    raw = F.least(F.lit(1.5), F.greatest(F.lit(0.5), 1 + F.col("n") / (F.col("n") + 30.0) * 2 * (F.col("hit_rate") - 0.5)))
    sure = (F.col("n") >= 20) & ((F.col("ci_low") > 0.5) | (F.col("ci_high") < 0.5))
    return b.select("hop", "direction", "horizon", "n", F.round(F.when(sure, raw).otherwise(1.0), 5).alias("multiplier"))


def news_free(rows: DataFrame, news: DataFrame, calendar: DataFrame) -> DataFrame:
    """rows (ticker, hop, pub, exit_day) with clean: has the ticker no direct news from its announcement to its exit?

    Both days count; a direct signal (hop 0) is news itself, so for it the announcing day doesn't. `calendar` (ticker, d) holds every pub and exit_day
    that may be asked for: days of news up to each of them are counted once, so the interval is a difference of two counts and no range join is made.
    """
    days = news.select("ticker", F.col("pub").alias("d"), F.lit(1).alias("k"))
    upto = calendar.select("ticker", "d", F.lit(0).alias("k")).unionByName(days).groupBy("ticker", "d").agg(F.max("k").alias("own"))
    w = Window.partitionBy("ticker").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = upto.withColumn("c", F.sum("own").over(w)).select("ticker", "d", "c", "own")
    met = rows.join(upto.toDF("ticker", "pub", "c0", "own0"), ["ticker", "pub"]).join(upto.toDF("ticker", "exit_day", "c1", "own1"), ["ticker", "exit_day"])
    before = F.when(F.col("hop") == 0, F.col("c0")).otherwise(F.col("c0") - F.col("own0"))
    return met.withColumn("clean", F.col("c1") == before).drop("c0", "c1", "own0", "own1")


_CLEAN = """, n AS (SELECT DISTINCT ticker, pub FROM signals WHERE hop = 0),
oc AS (SELECT o.*, NOT EXISTS (SELECT 1 FROM n WHERE n.ticker = o.ticker AND n.pub <= o.exit_day AND (n.pub > o.pub OR (n.pub = o.pub AND o.hop <> 0))) AS clean FROM o)"""


@query(with_views(*_OUT) + _OUTCOMES + _CLEAN + " SELECT event_id, horizon, clean FROM oc")
def clean_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clean(spark, sf_dir).select("event_id", "horizon", "clean")


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = view(spark, sf_dir, "signals")
    calendar = view(spark, sf_dir, "prices").select("ticker", F.col("day").alias("d")).unionByName(signals.select("ticker", F.col("pub").alias("d")))
    return news_free(_outcomes(spark, sf_dir), signals.where("hop = 0"), calendar)


@query(with_views("prices") + """
SELECT ticker, day, round(close / lag(close) OVER (PARTITION BY ticker ORDER BY t_idx) - 1, 6) + 0.0 AS ret FROM prices""")
def simple_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("t_idx")
    return view(spark, sf_dir, "prices").select("ticker", "day", (F.round(F.col("close") / F.lag("close").over(w) - 1, 6) + 0.0).alias("ret"))


def _frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, day, t_idx, y (own return) and x (market return)."""
    daily = view(spark, sf_dir, "prices").select("ticker", "day", "t_idx", F.col("r").alias("y"))
    market = daily.groupBy("day").agg(F.avg("y").alias("x"))
    return daily.join(market, "day")


_FRAME = ", m AS (SELECT day, avg(r) AS x FROM prices GROUP BY day), f AS (SELECT ticker, day, t_idx, r AS y, x FROM prices JOIN m USING (day))"
_EST = "OVER (PARTITION BY ticker ORDER BY t_idx ROWS BETWEEN 270 PRECEDING AND 21 PRECEDING)"
_MODEL = _FRAME + f""", c AS (SELECT *, count(*) {_EST} AS n, regr_slope(y, x) {_EST} AS beta, regr_intercept(y, x) {_EST} AS alpha, regr_syy(y, x) {_EST} AS syy, regr_sxy(y, x) {_EST} AS sxy FROM f),
z AS (SELECT ticker, day, t_idx, n, beta, alpha, sqrt(greatest(syy - beta * sxy, 0) / (n - 2)) AS sigma, y - alpha - beta * x AS ar FROM c WHERE t_idx >= 270 AND n >= 200)"""


def window_sums(frame: DataFrame, terms: dict[str, Column], low: int, high: int) -> DataFrame:
    """frame with `sums`, a struct of each term's sum over the rows from `low` to `high` of its ticker (relative, both counted), for the rows that have them all.

    Rows are cut into blocks as long as the window, so a window is the end of one block and the beginning of the next: two
    running sums, looked up. A row costs the same whatever the length, and as no sum goes over more than a block, nothing cancels. Null terms count as 0.
    """
    size = high - low + 1
    by = Window.partitionBy("ticker").orderBy("__block", "__row")
    cell = Window.partitionBy("ticker", "__block")
    running = cell.orderBy("__row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = frame.withColumn("__row", F.row_number().over(Window.partitionBy("ticker").orderBy("t_idx")) - 1).withColumn("__block", F.expr(f"__row div {size}"))
    rows = rows.select("*", *[F.coalesce(t, F.lit(0.0)).alias(f"__{c}") for c, t in terms.items()])
    upto = {c: F.sum(f"__{c}").over(running) for c in terms}
    rows = rows.select("*", F.struct(*[u.alias(c) for c, u in upto.items()]).alias("__upto"), F.struct(*[(F.sum(f"__{c}").over(cell) - u + F.col(f"__{c}")).alias(c) for c, u in upto.items()]).alias("__from"))
    rows = rows.withColumn("__last", F.lag("__upto", -high).over(by)).withColumn("__first", F.lag("__from", -low).over(by))
    # A window that begins with a block ends with it.
    one = (F.col("__row") + low) % size == 0
    sums = F.struct(*[(F.when(one, 0.0).otherwise(F.col("__first")[c]) + F.col("__last")[c]).alias(c) for c in terms])
    return rows.withColumn("sums", sums).where((F.col("__row") >= -low) & F.col("__last").isNotNull()).drop("__row", "__block", "__upto", "__from", "__last", "__first", *[f"__{c}" for c in terms])


def moments(frame: DataFrame, y: str, factors: list[str], low: int, high: int) -> DataFrame:
    """frame with n, the window's means m_<column> and its sums of products s_<a>_<b> about them, of the rows with y and all factors.

    Values are taken about their ticker's mean first, so that no small spread is lost beside a large mean.
    """
    names = [y, *factors]
    whole = F.col(y).isNotNull()
    for f in factors:
        whole = whole & F.col(f).isNotNull()
    ticker = Window.partitionBy("ticker")
    rows = frame.select("*", whole.alias("__whole"), *[F.avg(c).over(ticker).alias(f"c_{c}") for c in names])
    d = {c: F.when(F.col("__whole"), F.col(c) - F.col(f"c_{c}")) for c in names}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = window_sums(rows, {"n": F.col("__whole").cast("double")} | {c: d[c] for c in names} | {f"{a}_{b}": d[a] * d[b] for a, b in pairs}, low, high)
    s = lambda c: F.col("sums")[c]
    out = sums.withColumn("n", s("n").cast("long"))
    out = out.select("*", *[(F.col(f"c_{c}") + s(c) / F.col("n")).alias(f"m_{c}") for c in names], *[(s(f"{a}_{b}") - s(a) * s(b) / F.col("n")).alias(f"s_{a}_{b}") for a, b in pairs],
                     *[s(f"{c}_{c}").alias(f"q_{c}") for c in names])
    return out.drop("sums", "__whole", *[f"c_{c}" for c in names])


def market_model(frame: DataFrame, low: int = -270, high: int = -21, least: int = 200) -> DataFrame:
    """Rolling market model frozen at each row: beta, alpha and the residuals' sigma over rows [-270, -21], at least 200 of them, and the row's abnormal return."""
    m = moments(frame, "y", ["x"], low, high).where(F.col("n") >= least)
    flat = F.col("s_x_x") <= 1e-12 * F.col("q_x")  # the market didn't move: no slope
    m = m.withColumn("beta", F.when(~flat, F.col("s_y_x") / F.col("s_x_x"))).withColumn("alpha", F.col("m_y") - F.col("beta") * F.col("m_x"))
    m = m.withColumn("sigma", F.sqrt(F.greatest(F.col("s_y_y") - F.col("beta") * F.col("s_y_x"), F.lit(0.0)) / (F.col("n") - 2)))
    return m.select(*frame.columns, "n", "beta", "alpha", "sigma").withColumn("ar", F.col("y") - F.col("alpha") - F.col("beta") * F.col("x"))


@query(with_views("prices") + _MODEL + " SELECT ticker, day, n, round(beta, 4) + 0.0 AS beta, round(alpha, 6) + 0.0 AS alpha, round(ar, 6) + 0.0 AS ar FROM z")
def rolling_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market_model(_frame(spark, sf_dir)).select("ticker", "day", "n", (F.round("beta", 4) + 0.0).alias("beta"), (F.round("alpha", 6) + 0.0).alias("alpha"), (F.round("ar", 6) + 0.0).alias("ar"))


#: Least |ar / sigma| of a shock, and rows before it without another.
SHOCK, QUIET = 3.0, 10


def shocks(model: DataFrame, least: float = SHOCK, quiet: int = QUIET) -> DataFrame:
    """Rows with |ar / sigma| >= least, kept only if no other such row came in the `quiet` rows before."""
    hit = model.withColumn("z", F.col("ar") / F.col("sigma")).where(F.abs("z") >= least)
    gap = F.col("t_idx") - F.lag("t_idx").over(Window.partitionBy("ticker").orderBy("t_idx"))
    return hit.withColumn("gap", gap).where(F.col("gap").isNull() | (F.col("gap") > quiet))


@query(with_views("prices") + _MODEL + """, s AS (SELECT ticker, day, t_idx, ar / sigma AS z FROM z WHERE abs(ar / sigma) >= 3.0)
SELECT ticker, day, round(z, 2) AS z FROM s QUALIFY lag(t_idx) OVER (PARTITION BY ticker ORDER BY t_idx) IS NULL OR t_idx - lag(t_idx) OVER (PARTITION BY ticker ORDER BY t_idx) > 10""")
def shock_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shocks(market_model(_frame(spark, sf_dir))).select("ticker", "day", F.round("z", 2).alias("z"))


@query(with_views("prices") + _FRAME + """, w AS (SELECT ticker, day, t_idx, avg(abs(y)) OVER (PARTITION BY ticker ORDER BY t_idx ROWS BETWEEN 80 PRECEDING AND 21 PRECEDING) AS m,
 count(*) OVER (PARTITION BY ticker ORDER BY t_idx ROWS BETWEEN 80 PRECEDING AND 21 PRECEDING) AS n FROM f)
SELECT ticker, day, round(m, 7) AS mean_abs, n FROM w WHERE t_idx >= 80 AND n >= 20""")
def trailing_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = window_sums(_frame(spark, sf_dir), {"total": F.abs("y"), "n": F.col("y").isNotNull().cast("double")}, -80, -21)
    n = F.col("sums.n").cast("long")
    return rows.where(n >= 20).select("ticker", "day", F.round(F.col("sums.total") / n, 7).alias("mean_abs"), n.alias("n"))


@query(with_views("prices") + _MODEL + """, v(w, lo, hi) AS (VALUES ('w5', 1, 5), ('w20', 1, 20), ('w60', 1, 60)), k AS (SELECT z.ticker, z.day, w, sum(f.y - alpha - beta * f.x) AS car, count(*) AS c, min(hi) AS hi FROM z CROSS JOIN v JOIN f ON f.ticker = z.ticker AND f.t_idx BETWEEN z.t_idx + lo AND z.t_idx + hi GROUP BY z.ticker, z.day, w)
SELECT ticker, day, w AS "window", round(car, 5) + 0.0 AS car FROM k WHERE c = hi""")
def car_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative abnormal returns after each row by that row's own coefficients: sums of y and x over the next rows."""
    frame = _frame(spark, sf_dir)
    spans = {"w5": 5, "w20": 20, "w60": 60}
    by = Window.partitionBy("ticker").orderBy("t_idx")
    running = frame.select("ticker", "t_idx", *[F.sum(c).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias(f"up_{c}") for c in ("y", "x")])
    # What is ahead is the running sum there less that here.
    ahead = lambda c, n: (F.lead(f"up_{c}", n).over(by) - F.col(f"up_{c}")).alias(c)
    sums = running.select("ticker", "t_idx", *[F.struct(ahead("y", n), ahead("x", n), F.lead(F.lit(n), n).over(by).alias("n")).alias(w) for w, n in spans.items()])
    m = market_model(frame).select("ticker", "day", "t_idx", "alpha", "beta").join(sums, ["ticker", "t_idx"])
    cars = F.array(*[F.struct(F.lit(w).alias("window"), F.when(F.col(w)["n"] == n, F.col(w)["y"] - n * F.col("alpha") - F.col("beta") * F.col(w)["x"]).alias("car")) for w, n in spans.items()])
    return m.select("ticker", "day", F.inline(cars)).where("car is not null").withColumn("car", F.round("car", 5) + 0.0)


def clustered_mean(rows: DataFrame, value: str, cluster: str, *by: str) -> DataFrame:
    """Mean with the CR1 standard error: G / (G - 1) * sum over clusters of squared residual sums / n^2."""
    sums = rows.where(F.col(value).isNotNull()).groupBy(*by, cluster).agg(F.sum(value).alias("s"), F.count("*").alias("m"))
    total = sums.groupBy(*by).agg(F.sum("s").alias("S"), F.sum("m").alias("n"), F.count("*").alias("G"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(F.col("s") * F.col("m")).alias("sm"), F.sum(F.col("m") * F.col("m")).alias("mm"))
    mean = F.col("S") / F.col("n")
    scores = F.greatest(F.col("ss") - 2 * mean * F.col("sm") + mean * mean * F.col("mm"), F.lit(0.0))
    se = F.sqrt(F.col("G") / (F.col("G") - 1) * scores) / F.col("n")
    return total.where("G >= 2").select(*by, "n", F.col("G").alias("n_clusters"), mean.alias("mean"), se.alias("se"))


@query(with_views(*_OUT) + _OUTCOMES + """, g AS (SELECT horizon, pub, sum(abn_ret) AS s, count(*) AS m FROM o GROUP BY ALL), t AS (SELECT horizon, sum(s) / sum(m) AS mean, sum(m)::BIGINT AS n, count(*) AS g FROM g GROUP BY horizon)
SELECT t.horizon, n, t.g AS n_clusters, round(mean, 6) AS mean, round(sqrt(t.g / (t.g - 1) * sum(pow(s - m * mean, 2))) / n, 6) AS se FROM g JOIN t USING (horizon) GROUP BY t.horizon, n, t.g, mean""")
def clustered_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered_mean(_outcomes(spark, sf_dir), "abn_ret", "pub", "horizon").select("horizon", "n", "n_clusters", F.round("mean", 6).alias("mean"), F.round("se", 6).alias("se"))


def holm(rows: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    """Step-down rejection: in order of p, while every p so far is at most alpha / (tests left). A row per test, so one small window."""
    w = Window.orderBy(F.col(p).asc_nulls_last(), "test")
    limit = F.lit(alpha) / (F.count("*").over(Window.partitionBy(F.lit(1))) - F.row_number().over(w) + 1)
    passed = F.coalesce(F.col(p) <= limit, F.lit(False)).cast("int")
    return rows.withColumn("passed", passed).withColumn("rejected", F.min("passed").over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("passed")


@query(lambda: _holm_sql())
def holm_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests of the mean abnormal return by horizon and direction, clustered by day: t, its two-sided p by Student's t, and Holm's verdict."""
    cells = clustered_mean(_outcomes(spark, sf_dir), "abn_ret", "pub", "horizon", "direction")
    rows = cells.select(F.concat(F.lit("h"), "horizon", F.lit("-"), "direction").alias("test"), (F.col("mean") / F.col("se")).alias("t"), (F.col("n_clusters") - 1).alias("df"))
    return holm(rows.withColumn("p", t_p("t", "df")), "p").select("test", F.round("t", 4).alias("t"), "df", F.round("p", 6).alias("p"), "rejected")


def _holm_sql() -> str:
    from ripplegraph.operators.verdicts import t_p_sql

    return with_views(*_OUT) + _OUTCOMES + f""", g AS (SELECT horizon, direction, pub, sum(abn_ret) AS s, count(*) AS m FROM o GROUP BY ALL), c AS (SELECT horizon, direction, sum(s) / sum(m) AS mean, sum(m) AS n, count(*) AS k FROM g GROUP BY ALL),
x AS (SELECT 'h' || horizon || '-' || direction AS test, c.k - 1 AS df, mean / (sqrt(c.k / (c.k - 1) * sum(pow(s - m * mean, 2))) / n) AS t FROM g JOIN c USING (horizon, direction) WHERE c.k >= 2 GROUP BY horizon, direction, mean, n, c.k),
p AS (SELECT *, {t_p_sql("t", "df")} AS p FROM x), r AS (SELECT *, row_number() OVER (ORDER BY p, test) AS i, count(*) OVER () AS n FROM p)
SELECT test, round(t, 4) AS t, df, round(p, 6) AS p, bool_and(p <= 0.05 / (n - i + 1)) OVER (ORDER BY i) AS rejected FROM r"""


@query(with_views(*_OUT) + _OUTCOMES + """, t AS (SELECT event_id, year(pub) AS y, horizon, rank() OVER (PARTITION BY horizon, year(pub) ORDER BY magnitude) + (count(*) OVER (PARTITION BY horizon, year(pub), magnitude) - 1) / 2.0 AS k, count(*) OVER (PARTITION BY horizon, year(pub)) AS n FROM o)
SELECT event_id, horizon, y, ceil(3 * (k / n))::INT AS tercile FROM t""")
def terciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _outcomes(spark, sf_dir).select("event_id", "horizon", F.year("pub").alias("y"), "magnitude")
    counts = rows.groupBy("horizon", "y", "magnitude").agg(F.count("*").alias("m"))
    w, whole = Window.partitionBy("horizon", "y").orderBy("magnitude").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("horizon", "y")
    ranks = counts.select("horizon", "y", "magnitude", ((F.coalesce(F.sum("m").over(w), F.lit(0)) + (F.col("m") + 1) / 2) / F.sum("m").over(whole)).alias("p"))
    return rows.join(ranks, ["horizon", "y", "magnitude"]).select("event_id", "horizon", "y", F.ceil(3 * F.col("p")).cast("int").alias("tercile"))


def t_tail(t: float, df: float) -> float:
    """Two-sided p-value of Student's t, by the continued fraction of the incomplete beta function."""
    if df <= 0 or math.isnan(t):
        return math.nan
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d or 1e-300)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 + num * d, 1 + num / c
                d, c = 1 / (d or 1e-300), c or 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of t; a row for each test."""
    return pd.Series([math.nan if a is None or b is None else t_tail(float(a), float(b)) for a, b in zip(t, df)])


@query(with_views("prices") + """, asked AS (SELECT DISTINCT ticker FROM prices)
SELECT ticker, min(day) AS first_day, max(day) AS last_day, count(*) AS n_days, min(day) FILTER (open IS NULL OR t_idx % 97 = 96) AS missing_open_from FROM prices GROUP BY ticker""")
def cache_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = F.col("open").isNull() | (F.col("t_idx") % 97 == 96)
    return view(spark, sf_dir, "prices").groupBy("ticker").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n_days"), F.min(F.when(missing, F.col("day"))).alias("missing_open_from"))


@query(with_views("prices") + """, old AS (SELECT ticker, day, close, open FROM prices WHERE t_idx % 3 <> 0), new AS (SELECT ticker, day, close * 2 AS close, CASE WHEN t_idx % 4 = 0 THEN NULL ELSE open END AS open FROM prices WHERE t_idx % 2 = 0)
SELECT coalesce(o.ticker, n.ticker) AS ticker, coalesce(o.day, n.day) AS day, floor(coalesce(n.close, o.close) * 1000) AS close, floor(coalesce(n.open, o.open) * 1000) AS open FROM old o FULL JOIN new n ON o.ticker = n.ticker AND o.day = n.day""")
def upsert_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "prices")
    old = p.where("t_idx % 3 <> 0").select("ticker", "day", F.col("close").alias("c0"), F.col("open").alias("o0"))
    new = p.where("t_idx % 2 = 0").select("ticker", "day", (F.col("close") * 2).alias("c1"), F.when(F.col("t_idx") % 4 != 0, F.col("open")).alias("o1"))
    both = old.join(new, ["ticker", "day"], "full")
    return both.select("ticker", "day", F.floor(F.coalesce("c1", "c0") * 1000).cast("double").alias("close"), F.floor(F.coalesce("o1", "o0") * 1000).cast("double").alias("open"))
