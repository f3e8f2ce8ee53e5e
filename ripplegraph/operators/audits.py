"""Prices as they come in and what to fetch next, sanity checks, agreement between two scorers, and the study's leads and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.functions.markup import ITEMS, STUB, filing_passages
from ripplegraph.operators.cohorts import _EVENTS, _study, build_events_rows, event_cars
from ripplegraph.operators.events import aggregate
from ripplegraph.operators.market import _OUT, _outcomes, clustered_mean, holm, reliability_multiplier, t_p
from ripplegraph.plans.catalog import ORACLE_SQL, query
from ripplegraph.plans.logical import view, with_views
from ripplegraph.session import table
from ripplegraph.sources.files import html_tables


def normalise_prices(rows: DataFrame) -> DataFrame:
    """Rows without a close (null or not a number) go; an open that isn't a number is null."""
    missing = lambda c: F.col(c).isNull() | F.isnan(c)
    return rows.where(~missing("close")).withColumn("open", F.when(~missing("open"), F.col("open")))


@query(with_views("prices") + """ SELECT ticker, day, floor(close * 100)::BIGINT AS close, CASE WHEN t_idx % 20 <> 1 THEN floor(open * 100)::BIGINT END AS open FROM prices WHERE t_idx % 50 <> 3""")
def src_prices_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    nan, k = F.lit(float("nan")), F.col("t_idx")
    raw = view(spark, sf_dir, "prices").select("ticker", "day", F.when(k % 50 == 3, nan).otherwise(F.col("close")).alias("close"), F.when(k % 20 == 1, nan).otherwise(F.col("open")).alias("open"))
    return normalise_prices(raw).select("ticker", "day", F.floor(F.col("close") * 100).alias("close"), F.floor(F.col("open") * 100).alias("open"))


@query("""WITH b AS (SELECT event_type AS ticker, date_trunc('hour', ts)::TIMESTAMP AS ts, arg_min(value, struct_pack(t := ts, e := event_id)) AS open, arg_max(value, struct_pack(t := ts, e := event_id)) AS close FROM events GROUP BY ALL)
SELECT ticker, ts, CASE WHEN hour(ts) % 5 <> 2 THEN open END AS open, close FROM b WHERE hour(ts) % 7 <> 3""")
def src_prices_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of a stream of values, then the same rules."""
    order, hour = F.struct("ts", "event_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bar")
    b = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("ticker"), hour).agg(F.min_by("value", order).alias("open"), F.max_by("value", order).alias("close"))
    nan = F.lit(float("nan"))
    raw = b.select("ticker", F.col("bar").alias("ts"), F.when(F.hour("bar") % 5 == 2, nan).otherwise(F.col("open")).alias("open"), F.when(F.hour("bar") % 7 == 3, nan).otherwise(F.col("close")).alias("close"))
    return normalise_prices(raw)


#: Sessions' days that are fetched again, as late corrections come in.
REFRESH = 5


def fetch_plan(asked: DataFrame, cached: DataFrame) -> DataFrame:
    """ticker, start, reason, from_day: what to fetch of each ticker asked for (ticker, start, today) given the days in the cache (ticker, day, open).

    cold: nothing is cached; backfill: the cache begins too late; missing_open: a cached day has no open; forward: it ends before today; refresh: else.
    """
    have = cached.groupBy("ticker").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.min(F.when(F.col("open").isNull(), F.col("day"))).alias("hole"))
    rows = asked.join(have, "ticker", "left")
    late = F.date_sub("last", REFRESH)
    reason = F.when(F.col("first").isNull(), "cold").when(F.col("first") > F.col("start"), "backfill").when(F.col("hole") < late, "missing_open").when(F.col("last") < F.col("today"), "forward").otherwise("refresh")
    start = F.when(F.col("first").isNull() | (F.col("first") > F.col("start")), F.col("start")).otherwise(F.least(late, F.col("hole")))
    return rows.select("ticker", "start", reason.alias("reason"), start.alias("from_day"))


@query(with_views("prices") + """, a AS (SELECT DISTINCT p_brand AS ticker, DATE '1995-06-01' + (7 * (p_size % 3))::INT AS start, DATE '2001-06-01' AS today FROM part WHERE p_size IN (1, 2, 3) UNION SELECT DISTINCT p_type, DATE '1995-06-01', DATE '2001-06-01' FROM part),
h AS (SELECT ticker, min(day) AS first, max(day) AS last, min(day) FILTER (t_idx % 301 = 300) AS hole FROM prices WHERE day <= DATE '2001-05-01' + (length(ticker) * 9)::INT GROUP BY ticker)
SELECT ticker, start, CASE WHEN first IS NULL THEN 'cold' WHEN first > start THEN 'backfill' WHEN hole < last - 5 THEN 'missing_open' WHEN last < today THEN 'forward' ELSE 'refresh' END AS reason,
 CASE WHEN first IS NULL OR first > start THEN start ELSE least(last - 5, hole) END AS from_day FROM a LEFT JOIN h USING (ticker)""")
def cache_gap_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, day = table(spark, sf_dir, "part"), lambda d: F.lit(d).cast("date")
    asked = part.where("p_size in (1, 2, 3)").select(F.col("p_brand").alias("ticker"), F.date_add(day("1995-06-01"), (7 * (F.col("p_size") % 3)).cast("int")).alias("start"), day("2001-06-01").alias("today"))
    asked = asked.unionByName(part.select(F.col("p_type").alias("ticker"), day("1995-06-01").alias("start"), day("2001-06-01").alias("today"))).distinct()
    cached = view(spark, sf_dir, "prices").where(F.col("day") <= F.date_add(day("2001-05-01"), F.length("ticker") * 9))
    cached = cached.select("ticker", "day", F.when(F.col("t_idx") % 301 != 300, F.col("open")).alias("open"))
    return fetch_plan(asked, cached)


@query(with_views("prices") + """, r AS (SELECT ticker, day, close, close * CASE WHEN t_idx % 13 = 4 THEN 1.02 ELSE 1.0001 END AS raw FROM prices WHERE t_idx % 11 <> 6), x AS (SELECT p.ticker, p.day, p.close, r.raw FROM prices p FULL JOIN r ON r.ticker = p.ticker AND r.day = p.day)
SELECT ticker, count(*) AS n, count(raw) AS matched, count(*) FILTER (raw IS NULL) AS only_adjusted, count(*) FILTER (abs(raw / close - 1) > 0.01) AS beyond FROM x GROUP BY ticker""")
def raw_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjusted against raw closes: days in both, days in one, and those that differ by more than the tolerance."""
    p = view(spark, sf_dir, "prices").select("ticker", "day", "close", "t_idx")
    raw = p.where("t_idx % 11 <> 6").select("ticker", "day", (F.col("close") * F.when(F.col("t_idx") % 13 == 4, 1.02).otherwise(1.0001)).alias("raw"))
    x = p.select("ticker", "day", "close").join(raw, ["ticker", "day"], "full")
    return x.groupBy("ticker").agg(F.count("*").alias("n"), F.count("raw").alias("matched"), F.count_if(F.col("raw").isNull()).alias("only_adjusted"), F.count_if(F.abs(F.col("raw") / F.col("close") - 1) > 0.01).alias("beyond"))


def agreement(rows: DataFrame, *by: str) -> DataFrame:
    """n, agree, recovered (only the second has a direction), broke (only the first has) and opposed, of two directions a and b."""
    some = lambda c: F.col(c).isNotNull() & (F.col(c) != "no_effect")
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(F.col("a").eqNullSafe(F.col("b"))).alias("agree"), F.count_if(~some("a") & some("b")).alias("recovered"),
        F.count_if(some("a") & ~some("b")).alias("broke"), F.count_if(some("a") & some("b") & (F.col("a") != F.col("b"))).alias("opposed"),
    )


_SCORERS = """, f AS (SELECT event_id, seed, category, value, direction AS a, CASE WHEN value > 60 THEN 'positive' WHEN value < 20 THEN 'negative' WHEN value < 25 THEN NULL ELSE 'no_effect' END AS b FROM impacts)"""
_AGREE = """count(*) AS n, count(*) FILTER (a IS NOT DISTINCT FROM b) AS agree, count(*) FILTER ((a IS NULL OR a = 'no_effect') AND b IN ('positive', 'negative')) AS recovered,
 count(*) FILTER (a IN ('positive', 'negative') AND (b IS NULL OR b = 'no_effect')) AS broke, count(*) FILTER (a IN ('positive', 'negative') AND b IN ('positive', 'negative') AND a <> b) AS opposed"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scorers of the same events: the stored direction, and one by the value alone."""
    v = F.col("value")
    b = F.when(v > 60, "positive").when(v < 20, "negative").when(v < 25, None).otherwise("no_effect")
    return view(spark, sf_dir, "impacts").select("event_id", "seed", "category", "node_id", "value", F.col("direction").alias("a"), b.alias("b"))


@query(with_views("impacts") + _SCORERS + f", s AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY seed, category ORDER BY value DESC, event_id) = 1) SELECT category, {_AGREE} FROM s GROUP BY category")
def enrich_ab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scorers over a diverse sample: the strongest event of each seed and story."""
    best = F.min_by(F.struct("a", "b"), F.struct(-F.col("value"), "event_id"))
    sample = _scored(spark, sf_dir).groupBy("seed", "category").agg(best.alias("x")).select("category", "x.a", "x.b")
    return agreement(sample, "category")


@query(with_views("impacts") + _SCORERS + f" SELECT seed, {_AGREE} FROM f GROUP BY seed")
def noise_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over all events, by seed."""
    return agreement(_scored(spark, sf_dir), "seed")


@query(r"""WITH r AS (SELECT doc_id, lang, regexp_replace(regexp_replace(text, '\n([A-M])', chr(10) || 'Item 1.01 \1', 'g'), '\n([N-Z])', chr(10) || 'Item 5.02 \1', 'g') AS x FROM documents),
e AS (SELECT doc_id, lang, unnest(string_split(regexp_replace(x, '[Ii][Tt][Ee][Mm] +([0-9]{1,2}[.][0-9]{2})', chr(1) || '\1' || chr(2), 'g'), chr(1))[2:]) AS s FROM r),
b AS (SELECT doc_id, lang, s[:strpos(s, chr(2)) - 1] AS item FROM e WHERE length(trim(s[strpos(s, chr(2)) + 1:], ' ')) >= 200), d AS (SELECT doc_id, lang FROM documents)
SELECT d.lang, count(DISTINCT d.doc_id) AS docs, count(DISTINCT b.doc_id) AS found, count(*) FILTER (item = '1.01') AS item_101, count(*) FILTER (item = '5.02') AS item_502 FROM d LEFT JOIN b USING (doc_id) GROUP BY d.lang""")
def extract_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents have a section of each kind, by language."""
    docs = table(spark, sf_dir, "documents")
    text = F.regexp_replace(F.regexp_replace("text", r"\n([A-M])", "\nItem 1.01 $1"), r"\n([N-Z])", "\nItem 5.02 $1")
    found = filing_passages(docs.select("doc_id", text.alias("text")), (*ITEMS, "5.02"), STUB)
    per_doc = found.groupBy("doc_id").agg(F.count_if(F.col("item") == "1.01").alias("a"), F.count_if(F.col("item") == "5.02").alias("b"))
    rows = docs.select("doc_id", "lang").join(per_doc.withColumn("has", F.lit(1)), "doc_id", "left")
    return rows.groupBy("lang").agg(F.count("*").alias("docs"), F.count("has").alias("found"), F.coalesce(F.sum("a"), F.lit(0)).alias("item_101"), F.coalesce(F.sum("b"), F.lit(0)).alias("item_502"))


@query(with_views("prices") + _EVENTS + """, rl AS (SELECT DISTINCT a, e_idx, b FROM ev), u AS (SELECT DISTINCT a, e_idx, b AS c FROM cr WHERE w = 'w5')
SELECT rl.b, t.c, count(*) AS dates, count(u.c) AS usable FROM rl CROSS JOIN (SELECT p_brand AS c FROM part GROUP BY 1) t LEFT JOIN u ON u.a = rl.a AND u.e_idx = rl.e_idx AND u.c = t.c WHERE t.c <> rl.b AND t.c <> rl.a GROUP BY ALL HAVING count(u.c) = count(*)""")
def placebo_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickers with a complete window at every real event of a partner, other than it and the shocked one: those that may stand for it."""
    study = _study(spark, sf_dir)
    real = build_events_rows(spark, sf_dir, study).select("a", "e_idx", "b").distinct()
    shock, model, frame, firms, _ = study
    all_ = firms.select(F.col("id").alias("c"))
    pairs = real.select("a", "b").distinct().join(all_, (F.col("c") != F.col("b")) & (F.col("c") != F.col("a")))  # pairs of tickers, no rows of the tables
    cars = event_cars(shock, pairs.select("a", F.col("c").alias("t")).distinct(), model, frame).where(F.col("window") == "w5").select("a", "e_idx", F.col("t").alias("c"), F.lit(1).alias("ok"))
    rows = real.join(pairs, ["a", "b"]).join(cars, ["a", "e_idx", "c"], "left")
    return rows.groupBy("b", "c").agg(F.count("*").alias("dates"), F.count("ok").alias("usable")).where("usable = dates")


@query(with_views("prices") + _EVENTS + """, l AS (SELECT day, sha256(string_agg(a || ',' || e_idx || ',' || b || ',' || w || ',' || k || ',' || controls, chr(10) ORDER BY a, e_idx, b, w, k)) AS h, count(*) AS n FROM ev GROUP BY day)
SELECT year(day) AS y, sum(n)::BIGINT AS n, sha256(string_agg(h, chr(10) ORDER BY day)) AS fingerprint FROM l GROUP BY 1""")
def events_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checksum of the study's events by year: of the days' checksums in order, each of its day's lines in order, so no task holds more than a day."""
    rows = build_events_rows(spark, sf_dir)
    line = F.concat_ws(",", "a", "e_idx", "b", "window", "k", "controls")
    order = F.struct("a", "e_idx", "b", "window", "k", line.alias("line"))
    days = rows.groupBy("day").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(order))["line"], "\n"), 256).alias("h"), F.count("*").alias("n"))
    return days.groupBy(F.year("day").alias("y")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list(F.struct("day", "h")))["h"], "\n"), 256).alias("fingerprint"))


@query()
def uncommitted_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of direction, hop and horizon whose p is below 0.05 though Holm doesn't reject them: what a later study might look at."""
    cells = clustered_mean(_outcomes(spark, sf_dir), "abn_ret", "pub", "direction", "hop", "horizon")
    test = F.concat_ws("-", "direction", "hop", "horizon")
    rows = cells.select(test.alias("test"), "mean", "n_clusters", t_p(F.col("mean") / F.col("se"), F.col("n_clusters") - 1).alias("p"))
    return holm(rows, "p").where("p < 0.05 and not rejected").select("test", F.round("mean", 6).alias("mean"), F.round("p", 6).alias("p"))


def _tuned_sql() -> str:
    """The SQL of aggregate_impacts with the multipliers of that of reliability_multiplier joined in."""
    views, rest = ORACLE_SQL["aggregate_impacts"].split(", r AS (SELECT *,", 1)
    own = ORACLE_SQL["reliability_multiplier"].removeprefix(with_views(*_OUT))
    chain, last = own.rsplit("\nSELECT", 1)
    rest = rest.replace("* pow(0.5, hop) ELSE 0.0 END AS contrib FROM r WHERE", "* pow(0.5, hop) * coalesce(multiplier, 1.0) ELSE 0.0 END AS contrib FROM r LEFT JOIN mu USING (hop, direction) WHERE")
    chain = chain.replace(", a AS (", ", an AS (").replace(" FROM a)", " FROM an)")  # the other SQL has an a of its own
    return with_views(*_OUT, "impacts") + chain + f", mu AS (SELECT hop, direction, multiplier FROM (SELECT{last}) WHERE horizon = 1), r AS (SELECT *," + rest


@query(_tuned_sql)
def aggregate_impacts_tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live verdicts with each vote scaled by the measured reliability of its hop and direction over one session; classes without evidence count as they are."""
    m = reliability_multiplier(spark, sf_dir).where("horizon = 1").select("hop", "direction", "multiplier")
    return aggregate(view(spark, sf_dir, "impacts"), multiplier=m)


@query("""SELECT s_suppkey, 'T' || s_suppkey AS symbol, s_name AS name, n_name AS country FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def src_html_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each supplier, with a table of other columns and one of constituents whose columns stand in another order."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    other = "<html><table><tr><th>Year</th><td>1</td></tr></table><p>x</p>"
    head = F.lit(other + "<table class='c'><tr><th>Security </th><th><b>Country</b></th><th>CIK</th><th>Symbol</th></tr><tr><td>short</td></tr><tr><td>")
    page = F.concat(head, "s_name", F.lit("</td><td><a href='#'>"), "n_name", F.lit("</a></td><td>0</td><td> T"), "s_suppkey", F.lit("\n</td></tr></table></html>"))
    return html_tables(rows.select("s_suppkey", page.alias("html")), "s_suppkey", {"symbol": "symbol", "security": "name", "country": "country"})
