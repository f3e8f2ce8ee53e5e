"""The event study as a whole: events with matched controls, cells by role and window, placebos, power and the tables around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplegraph.operators.market import SHOCK, _FRAME, _MODEL, _OUT, _OUTCOMES, _frame, _outcomes, clustered_mean, market_model, moments, shocks
from ripplegraph.operators.study import controls
from ripplegraph.plans.catalog import query
from ripplegraph.plans.logical import view, with_views
from ripplegraph.session import join_dimension, materialize, table

WINDOWS = {"pre": (-5, -1), "d0": (0, 0), "w5": (1, 5), "w20": (1, 20), "w60": (1, 60)}
#: Sizes of control groups.
CONTROLS = (3, 5, 10)
_MODELS = with_views("prices") + _MODEL


def _at(ticker: str = "ticker") -> Window:
    return Window.partitionBy(ticker).orderBy("t_idx")


@query(with_views("prices") + """, q AS (SELECT ticker, day, t_idx, CASE WHEN t_idx % 97 = 5 THEN 2.5 WHEN t_idx % 89 = 7 THEN 0.3 ELSE 1 END * close AS close FROM prices), r AS (SELECT *, close / lag(close) OVER w - 1 AS ret, lead(close) OVER w / lag(close) OVER w - 1 AS two FROM q WINDOW w AS (PARTITION BY ticker ORDER BY t_idx)),
b AS (SELECT *, coalesce(abs(ret) > 0.5 AND abs(two) < 0.05, false) AS bad FROM r)
SELECT ticker, day, bad OR coalesce(lag(bad) OVER (PARTITION BY ticker ORDER BY t_idx), false) AS dropped FROM b""")
def bad_print_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A move of more than a half that the next day undoes to within 5 % marks both days; wrong prints are put into the prices for it."""
    w = _at()
    k = F.col("t_idx")
    close = F.when(k % 97 == 5, 2.5).when(k % 89 == 7, 0.3).otherwise(1.0) * F.col("close")
    rows = view(spark, sf_dir, "prices").select("ticker", "day", "t_idx", (close / F.lag("close").over(w) - 1).alias("ret"), (F.lead("close").over(w) / F.lag("close").over(w) - 1).alias("two"))
    rows = rows.withColumn("bad", F.coalesce((F.abs("ret") > 0.5) & (F.abs("two") < 0.05), F.lit(False)))
    return rows.select("ticker", "day", (F.col("bad") | F.coalesce(F.lag("bad").over(w), F.lit(False))).alias("dropped"))


@query(with_views("prices") + _FRAME + """, e AS (SELECT ticker, day, t_idx, stddev_samp(y - x) OVER w AS s, count(*) OVER w AS n FROM f WINDOW w AS (PARTITION BY ticker ORDER BY t_idx ROWS BETWEEN 270 PRECEDING AND 21 PRECEDING))
SELECT ticker, day, round(s, 8) AS sigma, n FROM e WHERE t_idx >= 270 AND n >= 200""")
def rolling_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = moments(_frame(spark, sf_dir).withColumn("e", F.col("y") - F.col("x")), "e", [], -270, -21).where("n >= 200")
    return rows.select("ticker", "day", F.round(F.sqrt(F.greatest("s_e_e", F.lit(0.0)) / (F.col("n") - 1)), 8).alias("sigma"), "n")


def frozen_path(model: DataFrame, frame: DataFrame, events: DataFrame, low: int = -5, high: int = 60) -> DataFrame:
    """ticker, e_idx, k, ar: abnormal returns around each event (ticker, e_idx) by the coefficients of the event's own row."""
    at = events.join(model.select("ticker", F.col("t_idx").alias("e_idx"), "alpha", "beta"), ["ticker", "e_idx"])
    days = at.withColumn("k", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("t_idx", F.col("e_idx") + F.col("k"))
    met = days.join(frame.select("ticker", "t_idx", "y", "x"), ["ticker", "t_idx"])
    return met.select("ticker", "e_idx", "k", (F.col("y") - F.col("alpha") - F.col("beta") * F.col("x")).alias("ar"))


_SHOCKS = _MODEL + """, sh AS (SELECT ticker, day, t_idx, ar, ar / sigma AS z, alpha, beta FROM z WHERE abs(ar / sigma) >= 3.0
 ), sk AS (SELECT * FROM sh QUALIFY lag(t_idx) OVER (PARTITION BY ticker ORDER BY t_idx) IS NULL OR t_idx - lag(t_idx) OVER (PARTITION BY ticker ORDER BY t_idx) > 10)"""
_PATH = _SHOCKS + """, ph AS (SELECT s.ticker, s.t_idx AS e_idx, f.t_idx - s.t_idx AS k, f.y - s.alpha - s.beta * f.x AS ar FROM sk s JOIN f ON f.ticker = s.ticker AND f.t_idx BETWEEN s.t_idx - 5 AND s.t_idx + 60)"""


def _shocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    frame = materialize(_frame(spark, sf_dir))
    model = materialize(market_model(frame))
    return frame, model, shocks(model)


def _path(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame, model, hit = _shocks(spark, sf_dir)
    return frozen_path(model, frame, hit.select("ticker", F.col("t_idx").alias("e_idx")))


@query(with_views("prices") + _PATH + " SELECT ticker, e_idx::INT AS e_idx, k::INT AS k, round(ar, 6) + 0.0 AS ar FROM ph")
def abnormal_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _path(spark, sf_dir).select("ticker", F.col("e_idx").cast("int").alias("e_idx"), F.col("k").cast("int").alias("k"), (F.round("ar", 6) + 0.0).alias("ar"))


@query(with_views("prices") + _PATH + ", d AS (SELECT k, avg(ar) AS m, count(*) AS n FROM ph GROUP BY k) SELECT k::INT AS k, n, round(m, 6) + 0.0 AS mean_ar, round(sum(m) OVER (ORDER BY k), 6) + 0.0 AS car FROM d")
def cumulative_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a day of the path, so one small window."""
    d = _path(spark, sf_dir).groupBy("k").agg(F.avg("ar").alias("m"), F.count("*").alias("n"))
    return d.select(F.col("k").cast("int").alias("k"), "n", (F.round("m", 6) + 0.0).alias("mean_ar"), (F.round(F.sum("m").over(Window.orderBy("k")), 6) + 0.0).alias("car"))


_EVENTS = _PATH + """, ld AS (SELECT p_brand AS t, min_by(p_type, p_partkey) AS kind, count(*) AS size FROM part GROUP BY p_brand), lr AS (SELECT *, row_number() OVER (ORDER BY size, t) AS r FROM ld),
lk AS (SELECT a.t AS a, b.t AS b FROM ld a JOIN ld b ON a.kind = b.kind AND a.t <> b.t),
ct AS (SELECT lk.a, lk.b, c.t AS c, row_number() OVER (PARTITION BY lk.a, lk.b ORDER BY abs(b.size - c.size), abs(b.r - c.r), c.t) AS rank FROM lk JOIN lr b ON b.t = lk.b JOIN lr c ON c.t <> lk.a AND c.t <> lk.b
 WHERE NOT EXISTS (SELECT 1 FROM lk k WHERE k.a = lk.a AND k.b = c.t) QUALIFY rank <= 10 AND count(*) OVER (PARTITION BY lk.a, lk.b) >= 2),
fz AS (SELECT s.ticker AS a, s.t_idx AS e_idx, s.day, sign(s.ar) AS s, m.ticker AS b, m.t_idx AS b_idx, m.alpha, m.beta FROM sk s JOIN z m ON m.day = s.day AND m.ticker <> s.ticker),
cr AS (SELECT a, e_idx, fz.day, s, b, w, sum(f.y - alpha - beta * f.x) AS car FROM fz CROSS JOIN (VALUES ('pre', -5, -1), ('d0', 0, 0), ('w5', 1, 5), ('w20', 1, 20), ('w60', 1, 60)) v(w, lo, hi)
 JOIN f ON f.ticker = b AND f.t_idx BETWEEN b_idx + lo AND b_idx + hi GROUP BY a, e_idx, fz.day, s, b, w HAVING count(*) = min(hi) - min(lo) + 1),
ev AS (SELECT r.a, r.e_idx, r.day, r.b, r.w, v.k, r.s * (r.car - avg(x.car)) AS ripple, count(*) AS controls FROM cr r JOIN ct ON ct.a = r.a AND ct.b = r.b JOIN cr x ON x.a = r.a AND x.e_idx = r.e_idx AND x.w = r.w AND x.b = ct.c
 CROSS JOIN (VALUES (3), (5), (10)) v(k) WHERE ct.rank <= v.k GROUP BY r.a, r.e_idx, r.day, r.b, r.w, v.k, r.s, r.car HAVING count(*) >= 2)"""


def lead_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind (type of its first part) and size (its parts) of each brand."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("id")).agg(F.min_by("p_type", "p_partkey").alias("kind"), F.count("*").alias("size"))


def linked_pairs(firms: DataFrame) -> DataFrame:
    """a, b: brands of one kind; few of a kind, as a brand has one."""
    return firms.select(F.col("id").alias("a"), "kind").join(firms.select(F.col("id").alias("b"), "kind"), "kind").where("a <> b").select("a", "b")


def event_cars(shock: DataFrame, needed: DataFrame, model: DataFrame, frame: DataFrame) -> DataFrame:
    """a, e_idx, day, s, t, window, car of the tickers t needed with a, at each shock of a, by the coefficients of the shock's day.

    A cumulated return is a difference of two running sums of y and of x, so each window costs two look-ups whatever its length.
    Windows that are not complete give no row.
    """
    upto = Window.partitionBy("ticker").orderBy("t_idx").rowsBetween(Window.unboundedPreceding, 0)
    sums = materialize(frame.select(F.col("ticker").alias("t"), "t_idx", F.sum("y").over(upto).alias("sy"), F.sum("x").over(upto).alias("sx"), "y", "x"))
    at = shock.join(needed, "a").join(model.select("day", F.col("ticker").alias("t"), F.col("t_idx").alias("at"), "alpha", "beta"), ["day", "t"])
    spans = F.array(*[F.struct(F.lit(w).alias("window"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for w, (lo, hi) in WINDOWS.items()])
    rows = at.select("*", F.inline(spans)).withColumn("i0", F.col("at") + F.col("lo")).withColumn("i1", F.col("at") + F.col("hi"))
    low = sums.select("t", F.col("t_idx").alias("i0"), (F.col("sy") - F.col("y")).alias("y0"), (F.col("sx") - F.col("x")).alias("x0"))
    high = sums.select("t", F.col("t_idx").alias("i1"), F.col("sy").alias("y1"), F.col("sx").alias("x1"))
    rows = rows.join(low, ["t", "i0"]).join(high, ["t", "i1"])
    car = F.col("y1") - F.col("y0") - (F.col("hi") - F.col("lo") + 1) * F.col("alpha") - F.col("beta") * (F.col("x1") - F.col("x0"))
    return rows.select("a", "e_idx", "day", "s", "t", "window", car.alias("car"))


def _study(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(shocks, model, frame, firms, links)."""
    frame, model, hit = _shocks(spark, sf_dir)
    firms = materialize(lead_parts(spark, sf_dir))
    return hit.select(F.col("ticker").alias("a"), F.col("t_idx").alias("e_idx"), "day", F.signum("ar").alias("s")), model, frame, firms, linked_pairs(firms)


def ripples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(a, e_idx, day, b, window, ripple of every other ticker at each shock against the mean of the rest; the links a, b): what placebos draw from."""
    shock, model, frame, firms, links = _study(spark, sf_dir)
    ids = firms.select("id")
    others = shock.select("a").distinct().join(ids, F.col("a") != F.col("id")).select("a", F.col("id").alias("t"))  # tickers by tickers, no rows of the tables
    long = event_cars(shock, others, model, frame).withColumnRenamed("t", "b")
    g = Window.partitionBy("a", "e_idx", "window")
    long = long.withColumn("n", F.count("*").over(g)).where("n >= 3").withColumn("ripple", F.col("s") * (F.col("car") - (F.sum("car").over(g) - F.col("car")) / (F.col("n") - 1)))
    return long.select("a", "e_idx", "day", "b", "window", "ripple"), links


def build_events_rows(spark: SparkSession, sf_dir: str, study: tuple | None = None) -> DataFrame:
    """a, e_idx, day, b, window, k, ripple, controls of the tickers linked to the one that was shocked, against their k nearest controls.

    Controls are tied to neither, rank by nearness of size, and the first k of them count as far as their window is complete, two at least.
    """
    shock, model, frame, firms, links = study or _study(spark, sf_dir)
    ranked = materialize(controls(links.toDF("a_id", "b_id"), firms.select("id", F.lit("all").alias("sector"), "size"), links.toDF("x_id", "y_id"), most=max(CONTROLS)))
    ranked = ranked.toDF("a", "b", "rank", "c")
    needed = ranked.select("a", F.col("b").alias("t")).unionByName(ranked.select("a", F.col("c").alias("t"))).distinct()
    cars = materialize(event_cars(shock, needed, model, frame))
    own = cars.withColumnRenamed("t", "b").join(ranked, ["a", "b"])
    met = own.join(cars.select("a", "e_idx", "window", F.col("t").alias("c"), F.col("car").alias("other")), ["a", "e_idx", "window", "c"])
    sizes = F.filter(F.array(*[F.lit(k) for k in CONTROLS]), lambda k: F.col("rank") <= k)
    met = met.withColumn("k", F.explode(sizes)).groupBy("a", "e_idx", "day", "b", "window", "k", "s", "car").agg(F.avg("other").alias("m"), F.count("*").alias("controls"))
    return met.where("controls >= 2").withColumn("ripple", F.col("s") * (F.col("car") - F.col("m"))).select("a", "e_idx", "day", "b", "window", "k", "ripple", "controls")


@query(with_views("prices") + _EVENTS + " SELECT a, e_idx::INT AS e_idx, b, w AS \"window\", k, controls, round(ripple, 5) + 0.0 AS ripple FROM ev")
def build_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_events_rows(spark, sf_dir).select("a", F.col("e_idx").cast("int").alias("e_idx"), "b", "window", "k", "controls", (F.round("ripple", 5) + 0.0).alias("ripple"))


@query(with_views("prices") + _EVENTS + """, wk AS (SELECT w, k, strftime(day, '%G-%V') AS week, sum(ripple) AS s, count(*) AS m FROM ev GROUP BY ALL), t AS (SELECT w, k, sum(s) / sum(m) AS mean, sum(m)::BIGINT AS n, count(*) AS g FROM wk GROUP BY w, k)
SELECT t.w AS "window", t.k, n, t.g AS n_clusters, round(mean, 5) + 0.0 AS mean, round(sqrt(t.g / (t.g - 1) * sum(pow(s - m * mean, 2))) / n, 5) AS se FROM wk JOIN t USING (w, k) GROUP BY t.w, t.k, n, t.g, mean HAVING t.g >= 2""")
def role_window_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by window and size of the control group, clustered by the ISO week of the event."""
    rows = build_events_rows(spark, sf_dir).withColumn("week", F.concat_ws("-", F.expr("extract(yearofweek from day)"), F.weekofyear("day")))
    return clustered_mean(rows, "ripple", "week", "window", "k").select("window", "k", "n", "n_clusters", (F.round("mean", 5) + 0.0).alias("mean"), F.round("se", 5).alias("se"))


@query(with_views("prices") + _SHOCKS + " SELECT DISTINCT s.ticker AS a, s.t_idx::INT AS e_idx, o.ticker AS b FROM sk s JOIN z m ON m.day = s.day JOIN sh o ON o.ticker = m.ticker AND o.ticker <> s.ticker AND o.t_idx BETWEEN m.t_idx - 10 AND m.t_idx")
def coshock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which other tickers had a large move in the ten rows up to a shock? The latest move is carried forward, not range joined."""
    _, model, hit = _shocks(spark, sf_dir)
    last = F.max(F.when(F.abs(F.col("ar") / F.col("sigma")) >= SHOCK, F.col("t_idx"))).over(_at().rowsBetween(Window.unboundedPreceding, 0))
    recent = model.select(F.col("ticker").alias("b"), "day", (F.col("t_idx") - last <= 10).alias("near")).where("near")
    return hit.select(F.col("ticker").alias("a"), F.col("t_idx").cast("int").alias("e_idx"), "day").join(recent, "day").where("a <> b").select("a", "e_idx", "b").distinct()


PERMS = 500


def relabel(pairs: DataFrame, pool: DataFrame, perms: int = PERMS) -> DataFrame:
    """perm, a, b, c: each B replaced in each permutation by a numbered member of its pool (sector, i, n, c), by hash; itself and A are left out.

    The draw is an equi join on (sector, place), so reruns agree and nothing is gathered.
    """
    drawn = pairs.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(perms - 1))))
    sizes = pool.groupBy("sector").agg(F.count("*").alias("n"))
    pick = F.conv(F.substring(F.md5(F.concat_ws("-", "perm", "a", "b")), 1, 8), 16, 10).cast("long") % F.col("n")
    return drawn.join(sizes, "sector").withColumn("i", pick).join(pool, ["sector", "i"]).where("c <> b and c <> a").select("perm", "a", "b", "c")


@query(with_views("nodes", "edges") + f""", p AS (SELECT e.source AS a, e.target AS b, n.sector FROM edges e JOIN nodes n ON n.id = e.target WHERE e.type = 'competes_with'),
pool AS (SELECT sector, id AS c, row_number() OVER (PARTITION BY sector ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY sector) AS n FROM nodes WHERE id LIKE 'sup-%')
SELECT perm::INT AS perm, a, b, c FROM p CROSS JOIN range({PERMS}) r(perm) JOIN pool ON pool.sector = p.sector AND pool.i = ('0x' || substr(md5(perm || '-' || a || '-' || b), 1, 8))::BIGINT % pool.n WHERE c <> b AND c <> a""")
def placebo_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = view(spark, sf_dir, "nodes")
    e = view(spark, sf_dir, "edges").where("type = 'competes_with'").select(F.col("source").alias("a"), F.col("target").alias("b"))
    firms = nodes.where("id like 'sup-%'").select("sector", F.col("id").alias("c"))
    # Numbered within a sector; the rows are two short strings.
    pool = firms.withColumn("i", (F.row_number().over(Window.partitionBy("sector").orderBy("c")) - 1).cast("long"))
    return relabel(e.join(nodes.select(F.col("id").alias("b"), "sector"), "b"), pool)


@query(with_views(*_OUT) + _OUTCOMES + """, x AS (SELECT horizon, pub AS g, magnitude AS x, abn_ret AS y FROM o), r AS (SELECT horizon, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n, avg(x) AS mx, regr_sxx(y, x) AS sxx, count(DISTINCT g) AS k FROM x GROUP BY horizon),
u AS (SELECT x.horizon, g, sum((x - mx) * (y - a - b * x)) AS q FROM x JOIN r USING (horizon) GROUP BY x.horizon, g)
SELECT r.horizon, n, round(b, 6) + 0.0 AS slope, round(sqrt(k / (k - 1) * (n - 1) / (n - 2) * sum(q * q)) / sxx, 6) AS se FROM u JOIN r USING (horizon) GROUP BY r.horizon, n, b, k, sxx""")
def clustered_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope with the CR1 sandwich: G / (G - 1) * (n - 1) / (n - 2) * sum of squared cluster scores / Sxx^2."""
    x = materialize(_outcomes(spark, sf_dir).select("horizon", F.col("pub").alias("g"), F.col("magnitude").alias("x"), F.col("abn_ret").alias("y")))
    r = x.groupBy("horizon").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.count("*").alias("n"), F.avg("x").alias("mx"), F.regr_sxx("y", "x").alias("sxx"), F.countDistinct("g").alias("k"))
    score = F.sum((F.col("x") - F.col("mx")) * (F.col("y") - F.col("a") - F.col("b") * F.col("x")))
    u = x.join(F.broadcast(r), "horizon").groupBy("horizon", "g", "n", "b", "k", "sxx").agg(score.alias("q"))  # r: a row a horizon
    k, n = F.col("k"), F.col("n")
    se = F.sqrt(k / (k - 1) * (n - 1) / (n - 2) * F.sum(F.col("q") * F.col("q"))) / F.col("sxx")
    return u.groupBy("horizon", "n", "b", "k", "sxx").agg(F.round(se, 6).alias("se")).select("horizon", "n", (F.round("b", 6) + 0.0).alias("slope"), "se")


@query(with_views(*_OUT) + _OUTCOMES + """, s AS (SELECT horizon, CASE WHEN direction = 'positive' THEN abn_ret ELSE -abn_ret END AS v, o.* FROM o), t AS (
 SELECT 'direct' AS subset, horizon, v FROM s WHERE hop = 0 UNION ALL SELECT 'far', horizon, v FROM s WHERE hop = 2 UNION ALL SELECT 'strong', horizon, v FROM s WHERE magnitude >= 0.6 UNION ALL SELECT 'late', horizon, v FROM s WHERE pub >= DATE '2000-01-01' UNION ALL SELECT 'all', horizon, v FROM s)
SELECT subset, horizon, count(*) AS n, round(avg(v), 5) + 0.0 AS mean FROM t GROUP BY ALL""".replace("SELECT horizon, CASE WHEN direction = 'positive' THEN abn_ret ELSE -abn_ret END AS v, o.*", "SELECT o.*, CASE WHEN direction = 'positive' THEN abn_ret ELSE -abn_ret END AS v"))
def robustness_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subsets overlap, so a row is expanded into those it is in: one pass, not one for each."""
    subsets = {"all": F.lit(True), "direct": F.col("hop") == 0, "far": F.col("hop") == 2, "strong": F.col("magnitude") >= 0.6, "late": F.col("pub") >= F.lit("2000-01-01").cast("date")}
    tags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in subsets.items()]))
    v = F.when(F.col("direction") == "positive", F.col("abn_ret")).otherwise(-F.col("abn_ret"))
    return _outcomes(spark, sf_dir).select("horizon", v.alias("v"), F.explode(tags).alias("subset")).groupBy("subset", "horizon").agg(F.count("*").alias("n"), (F.round(F.avg("v"), 5) + 0.0).alias("mean"))


@query(with_views("signals") + """, d AS (SELECT year(pub) AS y, pub, count(*) AS m FROM signals GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY m DESC, pub) AS k FROM d)
SELECT y, sum(m)::BIGINT AS n, round(sum(m) FILTER (k <= 5) / sum(m), 6) AS top5, round(sum(m) * sum(m) / sum(m * m), 4)::DOUBLE AS effective_days FROM k GROUP BY y""")
def date_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, "signals").groupBy(F.year("pub").alias("y"), "pub").agg(F.count("*").alias("m"))
    k = d.withColumn("k", F.row_number().over(Window.partitionBy("y").orderBy(F.desc("m"), "pub")))
    m = F.col("m")
    return k.groupBy("y").agg(F.sum("m").alias("n"), F.round(F.sum(F.when(F.col("k") <= 5, m)) / F.sum("m"), 6).alias("top5"), F.round(F.sum("m") * F.sum("m") / F.sum(m * m), 4).alias("effective_days"))


@query(with_views("impacts") + """, a AS (SELECT node_id, direction, magnitude FROM impacts WHERE event_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY magnitude DESC, event_id) = 1),
b AS (SELECT node_id, direction, magnitude FROM impacts WHERE event_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY magnitude DESC, event_id) = 1)
SELECT count(*) AS n_either, count(*) FILTER (a.node_id IS NOT NULL AND b.node_id IS NOT NULL) AS n_both, count(*) FILTER (a.direction = b.direction) AS n_agree, count(*) FILTER (a.direction <> b.direction AND a.direction <> 'no_effect' AND b.direction <> 'no_effect') AS n_opposed,
 round(count(*) FILTER (a.node_id IS NOT NULL AND b.node_id IS NOT NULL) / count(*), 6) AS jaccard FROM a FULL JOIN b ON a.node_id = b.node_id""")
def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two maps of verdicts side by side: overlap of their nodes and agreement of their directions."""
    rows = view(spark, sf_dir, "impacts")
    lead = F.min_by("direction", F.struct(-F.col("magnitude"), "event_id"))
    side = lambda k, d: rows.where(F.col("event_id") % 2 == k).groupBy("node_id").agg(lead.alias(d))
    m = side(0, "a").join(side(1, "b"), "node_id", "full")
    both, a, b = F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()), F.col("a"), F.col("b")
    return m.agg(F.count("*").alias("n_either"), both.alias("n_both"), F.count_if(a == b).alias("n_agree"), F.count_if((a != b) & (a != "no_effect") & (b != "no_effect")).alias("n_opposed"), F.round(both / F.count("*"), 6).alias("jaccard"))


@query("""WITH c AS (SELECT o_orderkey, o_orderstatus AS expected, CASE WHEN o_custkey % 9 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN 'O' ELSE o_orderstatus END AS got FROM orders)
SELECT count(*) AS total, count(*) FILTER (got IS NULL) AS not_in_graph, count(*) FILTER (got = expected) AS correct, round(count(*) FILTER (got = expected) / count(*) FILTER (got IS NOT NULL), 6) AS accuracy FROM c""")
def backtest_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = F.when(F.col("o_custkey") % 9 == 0, None).when(F.col("o_orderkey") % 4 == 0, "O").otherwise(F.col("o_orderstatus"))
    c = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("expected"), got.alias("got"))
    right = F.count_if(F.col("got") == F.col("expected"))
    return c.agg(F.count("*").alias("total"), F.count_if(F.col("got").isNull()).alias("not_in_graph"), right.alias("correct"), F.round(right / F.count("got"), 6).alias("accuracy"))
