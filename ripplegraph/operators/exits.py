"""Exits and intraday outcomes, and the outcome tables' upkeep: thesis walks, hourly bars as of an action, preserved history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplegraph.operators.market import _OUT, _OUTCOMES, _outcomes, next_session
from ripplegraph.plans.catalog import query
from ripplegraph.plans.logical import view, with_views
from ripplegraph.session import table

AGES, HALF_LIFE, HOP_WEIGHT = 7, 3.0, 0.5
MAX_HOLD, EXIT_COST = 10, 0.002


def consensus(signals: DataFrame) -> DataFrame:
    """ticker, day, net: votes of the last AGES days, decayed; of one day and direction the strongest counts.

    Each day's vote is handed on to the days that it reaches, so no range join is made.
    """
    strength = F.least(F.lit(1.0), F.abs("magnitude")) * F.pow(F.lit(HOP_WEIGHT), F.col("hop"))
    votes = signals.groupBy("ticker", "pub", "direction").agg(F.max(strength).alias("v"))
    sign = F.when(F.col("direction") == "positive", 1).otherwise(-1)
    reach = votes.withColumn("age", F.explode(F.sequence(F.lit(0), F.lit(AGES))))
    return reach.groupBy("ticker", F.date_add("pub", F.col("age")).alias("day")).agg(F.round(F.sum(sign * F.col("v") * F.pow(F.lit(0.5), F.col("age") / HALF_LIFE)), 9).alias("net"))


_CONSENSUS = """, vt AS (SELECT ticker, pub, direction, max(least(1.0, abs(magnitude)) * pow(0.5, hop)) AS v FROM signals GROUP BY ALL),
cs AS (SELECT ticker, pub + age::INT AS day, round(sum(CASE direction WHEN 'positive' THEN v ELSE -v END * pow(0.5, age / 3.0)), 9) AS net FROM vt CROSS JOIN range(8) a(age) GROUP BY ALL)"""


@query(with_views("signals") + _CONSENSUS + " SELECT ticker, day, net + 0.0 AS net, round(tanh(net), 6) + 0.0 AS thesis FROM cs")
def consensus_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = consensus(view(spark, sf_dir, "signals"))
    return c.select("ticker", "day", (F.col("net") + 0.0).alias("net"), (F.round(F.tanh("net"), 6) + 0.0).alias("thesis"))


def dynamic_exits(signals: DataFrame, prices: DataFrame, benchmark: DataFrame, max_hold: int = MAX_HOLD) -> DataFrame:
    """One row a signal: out at the open after the first session whose thesis is not positive, else after `max_hold` sessions.

    Both signs' next triggers are found once per ticker and session by a frame of `max_hold` rows; signals look theirs up.
    """
    p = prices.join(benchmark.select("day", F.col("open").alias("b_open")), "day")
    cal = p.join(consensus(signals), ["ticker", "day"], "left").withColumn("net", F.coalesce("net", F.lit(0.0)))
    ahead = Window.partitionBy("ticker").orderBy("t_idx").rowsBetween(1, max_hold)
    low, high = F.col("net") <= 0, F.col("net") >= 0
    trig = lambda hit: F.min(F.when(hit, F.struct("t_idx", (F.col("net") != 0).alias("reverse")))).over(ahead)
    cal = cal.select("ticker", "t_idx", F.col("open").alias("p0"), F.col("b_open").alias("b0"), trig(low).alias("t_pos"), trig(high).alias("t_neg"), F.max("t_idx").over(Window.partitionBy("ticker")).alias("last"))
    at = next_session(signals, prices).where("ann_idx is not null").withColumn("t_idx", F.col("ann_idx") + (F.col("ann_day") == F.col("pub")).cast("int"))
    rows = at.join(cal, ["ticker", "t_idx"]).where(F.col("t_idx") + max_hold + 1 <= F.col("last"))
    up = F.col("direction") == "positive"
    hit = F.when(up, F.col("t_pos")).otherwise(F.col("t_neg"))
    rows = rows.withColumn("exit_idx", F.coalesce(hit["t_idx"], F.col("t_idx") + max_hold) + 1)
    rows = rows.withColumn("exit_reason", F.when(hit.isNull(), "maxhold").when(hit["reverse"], "reverse").otherwise("faded"))
    leave = p.select("ticker", F.col("t_idx").alias("exit_idx"), F.col("open").alias("p1"), F.col("b_open").alias("b1"))
    abn = (F.col("p1") / F.col("p0") - 1) - (F.col("b1") / F.col("b0") - 1)
    rows = rows.join(leave, ["ticker", "exit_idx"]).withColumn("abn_ret", abn)
    signed = F.when(up, F.col("abn_ret")).otherwise(-F.col("abn_ret"))
    return rows.select("event_id", "ticker", "direction", (F.col("exit_idx") - F.col("t_idx")).cast("int").alias("holding"), "exit_reason", "abn_ret", (signed > 1e-9).cast("int").alias("hit"), (signed - EXIT_COST).alias("net"))


_DYNAMIC = _CONSENSUS + """, pb AS (SELECT p.ticker, p.t_idx, p.day, p.open, b.open AS b_open FROM prices p JOIN benchmark b USING (day)),
cal AS (SELECT pb.*, coalesce(net, 0.0) AS net, max(t_idx) OVER (PARTITION BY pb.ticker) AS last FROM pb LEFT JOIN cs ON cs.ticker = pb.ticker AND cs.day = pb.day),
an AS (SELECT s.*, p.t_idx + CASE WHEN p.day = pub THEN 1 ELSE 0 END AS entry FROM signals s ASOF JOIN prices p ON s.ticker = p.ticker AND s.pub <= p.day),
wk AS (SELECT an.event_id, an.ticker, an.direction, an.entry, min(c.t_idx) FILTER (CASE an.direction WHEN 'positive' THEN c.net ELSE -c.net END <= 0) AS trig, min(c.last) AS last,
 arg_min(c.net, c.t_idx) FILTER (CASE an.direction WHEN 'positive' THEN c.net ELSE -c.net END <= 0) AS tnet
 FROM an JOIN cal c ON c.ticker = an.ticker AND c.t_idx BETWEEN an.entry + 1 AND an.entry + 10 GROUP BY ALL),
ex AS (SELECT *, coalesce(trig, entry + 10) + 1 AS exit_idx, CASE WHEN trig IS NULL THEN 'maxhold' WHEN tnet <> 0 THEN 'reverse' ELSE 'faded' END AS exit_reason FROM wk WHERE entry + 11 <= last),
dy AS (SELECT event_id, ex.ticker, direction, (exit_idx - entry)::INT AS holding, exit_reason, (x.open / n.open - 1) - (x.b_open / n.b_open - 1) AS abn_ret
 FROM ex JOIN pb n ON n.ticker = ex.ticker AND n.t_idx = entry JOIN pb x ON x.ticker = ex.ticker AND x.t_idx = exit_idx)"""


def _dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dynamic_exits(view(spark, sf_dir, "signals"), view(spark, sf_dir, "prices"), view(spark, sf_dir, "benchmark"))


@query(with_views(*_OUT) + _DYNAMIC + " SELECT event_id, ticker, holding, exit_reason, round(abn_ret, 5) + 0.0 AS abn_ret FROM dy")
def walk_forward_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dynamic(spark, sf_dir).select("event_id", "ticker", "holding", "exit_reason", (F.round("abn_ret", 5) + 0.0).alias("abn_ret"))


@query(with_views(*_OUT) + _DYNAMIC + """, s AS (SELECT *, CASE direction WHEN 'positive' THEN abn_ret ELSE -abn_ret END AS signed FROM dy)
SELECT direction, exit_reason, count(*) AS n, round(avg(holding), 6) AS mean_hold, round(avg((signed > 1e-9)::INT), 6) AS hit_rate, round(avg(signed - 0.002), 5) + 0.0 AS mean_net FROM s GROUP BY ALL""")
def dynamic_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dynamic(spark, sf_dir).groupBy("direction", "exit_reason").agg(F.count("*").alias("n"), F.round(F.avg("holding"), 6).alias("mean_hold"), F.round(F.avg("hit"), 6).alias("hit_rate"), (F.round(F.avg("net"), 5) + 0.0).alias("mean_net"))


def hourly_bars(events: DataFrame) -> DataFrame:
    """ticker, bar, b_idx, open, close: hours with trades; a ticker's open is its first value of the hour, its close the last."""
    when = F.struct("ts", "event_id")
    level = 100 + F.col("value")
    bars = events.groupBy(F.col("event_type").alias("ticker"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bar")).agg(F.min_by(level, when).alias("open"), F.max_by(level, when).alias("close"))
    return bars.withColumn("b_idx", F.row_number().over(Window.partitionBy("ticker").orderBy("bar")))


def asof_bars(actions: DataFrame, bars: DataFrame) -> DataFrame:
    """The ticker's first bar at or after each action (ticker, act).

    Bars begin at whole hours, so actions ask for the hour that they round up to; the distinct hours and the bars are
    laid in one order and the next bar is carried back.
    """
    whole = F.date_trunc("hour", "act").cast("timestamp_ntz")
    asked = actions.withColumn("at", F.when(F.col("act") == whole, whole).otherwise(whole + F.expr("interval 1 hour")))
    b = bars.select("ticker", F.col("bar").alias("at"), F.lit(1).alias("kind"), "bar", "b_idx", "open")
    both = asked.select("ticker", "at", F.lit(0).alias("kind")).distinct().unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy("ticker").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(F.when(F.col("kind") == 1, F.struct("bar", "b_idx", "open")), ignorenulls=True).over(w)
    met = both.withColumn("b", found).where("kind = 0 and b is not null").select("ticker", "at", "b.*")
    return asked.join(met, ["ticker", "at"]).drop("at")


_BARS = """WITH bars AS (SELECT event_type AS ticker, date_trunc('hour', ts)::TIMESTAMP AS bar, arg_min(100 + value, struct_pack(t := ts, e := event_id)) AS open, arg_max(100 + value, struct_pack(t := ts, e := event_id)) AS close FROM events GROUP BY ALL),
nb AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY bar)::INT AS b_idx FROM bars),
ac AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'click' ELSE 'view' END AS ticker, ts + INTERVAL 1 HOUR AS act, value >= 20 AS up FROM events WHERE event_type <> 'error'),
en AS (SELECT a.*, b.bar, b.b_idx, b.open FROM ac a ASOF JOIN nb b ON a.ticker = b.ticker AND a.act <= b.bar)"""


def _entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events")
    bars = hourly_bars(events)
    other = F.when(F.col("event_type") == "view", "click").otherwise("view")
    act = events.where("event_type <> 'error'").select("event_id", other.alias("ticker"), F.expr("ts + interval 1 hour").alias("act"), (F.col("value") >= 20).alias("up"))
    return asof_bars(act, bars), bars


@query(_BARS + " SELECT event_id, ticker, bar, b_idx, round(open, 6) AS open FROM en")
def asof_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir)[0].select("event_id", "ticker", "bar", "b_idx", F.round("open", 6).alias("open"))


_INTRA = _BARS + """, io AS (SELECT en.event_id, en.ticker, en.up, h, x.close / en.open - 1 - (y.close / m.open - 1) AS abn FROM en JOIN nb m ON m.ticker = 'error' AND m.bar = en.bar
 CROSS JOIN (VALUES (0), (1), (5), (20), (60)) v(h) JOIN nb x ON x.ticker = en.ticker AND x.b_idx = en.b_idx + h JOIN nb y ON y.ticker = 'error' AND y.bar = x.bar)"""


def _intraday(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, bars = _entries(spark, sf_dir)
    bench = bars.where("ticker = 'error'")
    rows = entries.join(bench.select("bar", F.col("open").alias("m0")), "bar").withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in (0, 1, 5, 20, 60)])))
    leave = bars.select("ticker", F.col("b_idx").alias("exit_idx"), F.col("bar").alias("exit_bar"), F.col("close").alias("p1"))
    rows = rows.withColumn("exit_idx", F.col("b_idx") + F.col("horizon")).join(leave, ["ticker", "exit_idx"])
    rows = rows.join(bench.select(F.col("bar").alias("exit_bar"), F.col("close").alias("m1")), "exit_bar")
    return rows.withColumn("abn", F.col("p1") / F.col("open") - 1 - (F.col("m1") / F.col("m0") - 1))


@query(_INTRA + " SELECT event_id, ticker, h AS horizon, round(abn, 6) + 0.0 AS abn_ret, (CASE WHEN up THEN abn ELSE -abn END > 1e-9)::INT AS hit FROM io")
def intraday_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark must trade in the very bars of entry and exit."""
    signed = F.when(F.col("up"), F.col("abn")).otherwise(-F.col("abn"))
    return _intraday(spark, sf_dir).select("event_id", "ticker", "horizon", (F.round("abn", 6) + 0.0).alias("abn_ret"), (signed > 1e-9).cast("int").alias("hit"))


@query(_INTRA + " SELECT ticker, h AS horizon, count(*) AS n, round(avg((CASE WHEN up THEN abn ELSE -abn END > 1e-9)::INT), 6) AS hit_rate, round(avg(abn), 5) + 0.0 AS mean_abn FROM io GROUP BY ALL")
def intraday_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = F.when(F.col("up"), F.col("abn")).otherwise(-F.col("abn"))
    return _intraday(spark, sf_dir).groupBy("ticker", "horizon").agg(F.count("*").alias("n"), F.round(F.avg((signed > 1e-9).cast("int")), 6).alias("hit_rate"), (F.round(F.avg("abn"), 5) + 0.0).alias("mean_abn"))


def upsert_preserving(old: DataFrame, new: DataFrame, alive: DataFrame, key: str = "event_id") -> DataFrame:
    """Old rows of living events go, those of pruned ones stay as history; then the new rows."""
    return old.join(alive.select(key).distinct(), key, "left_anti").unionByName(new)


@query(with_views(*_OUT) + _OUTCOMES + """, n AS (SELECT event_id, horizon, round(abn_ret, 5) + 0.0 AS abn_ret FROM o WHERE pub >= DATE '1998-01-01'), old AS (SELECT event_id, horizon, -1.0 AS abn_ret FROM o WHERE event_id % 2 = 0)
SELECT * FROM old WHERE event_id NOT IN (SELECT event_id FROM signals WHERE pub >= DATE '1998-01-01') UNION ALL SELECT * FROM n""")
def upsert_outcomes_preserve(spark: SparkSession, sf_dir: str) -> DataFrame:
    alive = view(spark, sf_dir, "signals").where("pub >= date'1998-01-01'")
    o = _outcomes(spark, sf_dir)
    new = o.where("pub >= date'1998-01-01'").select("event_id", "horizon", (F.round("abn_ret", 5) + 0.0).alias("abn_ret"))
    return upsert_preserving(o.where("event_id % 2 = 0").select("event_id", "horizon", F.lit(-1.0).alias("abn_ret")), new, alive)


@query(with_views(*_OUT) + _OUTCOMES + """, d AS (SELECT pub, dense_rank() OVER (ORDER BY pub) AS k FROM (SELECT DISTINCT pub FROM o)), m AS (SELECT max(k) // 2 AS half FROM d)
SELECT CASE WHEN k <= half THEN 'first' ELSE 'second' END AS part, horizon, count(*) AS n, round(avg(hit), 6) AS hit_rate FROM o JOIN d USING (pub), m GROUP BY ALL""")
def time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halves of the ordered days: days are few, so they alone are ranked."""
    o = _outcomes(spark, sf_dir).select("pub", "horizon", "hit")
    days = o.select("pub").distinct()
    k = days.withColumn("k", F.row_number().over(Window.orderBy("pub"))).withColumn("half", F.floor(F.count("*").over(Window.partitionBy(F.lit(1))) / 2))
    part = F.when(F.col("k") <= F.col("half"), "first").otherwise("second").alias("part")
    return o.join(k, "pub").groupBy(part, "horizon").agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("hit_rate"))


@query(with_views(*_OUT) + _OUTCOMES + " SELECT horizon, count(DISTINCT event_id) AS events, count(DISTINCT ticker) AS tickers, count(DISTINCT pub) AS days, min(pub) AS first_day, max(exit_day) AS last_day FROM o GROUP BY horizon")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).groupBy("horizon").agg(F.countDistinct("event_id").alias("events"), F.countDistinct("ticker").alias("tickers"), F.countDistinct("pub").alias("days"), F.min("pub").alias("first_day"), F.max("exit_day").alias("last_day"))


@query(with_views("prices", "signals") + """, a AS (SELECT s.event_id, s.ticker, p.t_idx AS e FROM signals s ASOF JOIN prices p ON s.ticker = p.ticker AND s.pub <= p.day), l AS (SELECT ticker, max(t_idx) FILTER (day < DATE '1999-01-01') AS last FROM prices GROUP BY ticker)
SELECT ticker, count(*) AS n, count(*) FILTER (e + 60 > last) AS n_w60, count(*) FILTER (e + 20 > last) AS n_w20, count(*) FILTER (e > last) AS n_out FROM a JOIN l USING (ticker) GROUP BY ticker""")
def embargo_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose window ends after the exploration period's last session."""
    p = view(spark, sf_dir, "prices")
    last = p.groupBy("ticker").agg(F.max(F.when(F.col("day") < F.lit("1999-01-01").cast("date"), F.col("t_idx"))).alias("last"))
    a = next_session(view(spark, sf_dir, "signals"), p).where("ann_idx is not null").join(last, "ticker")
    late = lambda w: F.count_if(F.col("ann_idx") + w > F.col("last"))
    return a.groupBy("ticker").agg(F.count("*").alias("n"), late(60).alias("n_w60"), late(20).alias("n_w20"), late(0).alias("n_out"))
