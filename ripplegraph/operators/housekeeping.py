"""Caches, exports, reports and layout rows around the graph."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplegraph.operators.market import _BLOCK, _OUT, _OUTCOMES, _outcomes, stat_block
from ripplegraph.plans.catalog import query
from ripplegraph.plans.logical import view, with_views
from ripplegraph.session import table


def slice_times(start: Column, end: Column, minutes: int = 15) -> Column:
    """The slice stamps in [start, end], floored to whole slices, newest last."""
    width = minutes * 60
    floor = lambda t: F.timestamp_seconds(F.floor(F.unix_seconds(t.cast("timestamp")) / width) * width)
    return F.sequence(floor(start), floor(end), F.expr(f"interval {minutes} minutes"))


@query("""WITH h AS (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id) SELECT user_id, strftime(t, '%Y%m%d%H%M%S') AS stamp FROM h,
 unnest(generate_series(time_bucket(INTERVAL 15 MINUTE, last - INTERVAL 1 HOUR, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 15 MINUTE, last, TIMESTAMP '1970-01-01'), INTERVAL 15 MINUTE)) u(t)""")
def gkg_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps of the slices of the hour up to each reader's last event."""
    h = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    t = F.explode(slice_times(F.col("last") - F.expr("interval 1 hour"), F.col("last")))
    return h.select("user_id", t.alias("t")).select("user_id", F.date_format("t", "yyyyMMddHHmmss").alias("stamp"))


@query("""WITH d AS (SELECT min(ts)::DATE AS a, max(ts)::DATE AS b FROM events), s AS (SELECT unnest(generate_series(a + INTERVAL 13 HOUR, b + INTERVAL 13 HOUR, INTERVAL 36 HOUR)) AS t FROM d)
SELECT strftime(t, '%Y%m%d%H%M%S') AS stamp, (SELECT count(*) FROM events WHERE ts >= t AND ts < t + INTERVAL 15 MINUTE) AS n FROM s""")
def slice_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices from 13:00 of the first day on, every 36 hours, with the events in each: counted by slice, then joined."""
    e = table(spark, sf_dir, "events")
    at = lambda f: (F.to_date(f("ts")).cast("timestamp") + F.expr("interval 13 hours"))
    stamps = e.agg(at(F.min).alias("a"), at(F.max).alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 36 hours"))).alias("t"))
    whole = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 900) * 900)
    counts = e.groupBy(whole.alias("t")).agg(F.count("*").alias("n"))
    return stamps.join(counts, "t", "left").select(F.date_format("t", "yyyyMMddHHmmss").alias("stamp"), F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) > 48""")
def slice_cache_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache that keeps the newest 48 of each reader drops."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("k", F.row_number().over(w)).where("k > 48").select("user_id", "event_id")


def to_fetch(wanted: DataFrame, cache: DataFrame, now: Column, ttl_hours: int = 24) -> DataFrame:
    """Wanted keys not answered for: cached bodies and final failures stay answered, a passing failure until its time to live is over."""
    fresh = cache.where((F.col("status") != "retry") | (F.col("fetched") > now - F.expr(f"interval {ttl_hours} hours")))
    return wanted.join(fresh.select("key"), "key", "left_anti")


@query("""WITH c AS (SELECT user_id AS key, arg_max(CASE event_type WHEN 'error' THEN 'retry' WHEN 'signup' THEN 'gone' ELSE 'ok' END, struct_pack(t := ts, e := event_id)) AS status, max(ts) AS fetched FROM events WHERE event_id % 7 = 0 GROUP BY user_id)
SELECT DISTINCT user_id AS key FROM events WHERE user_id NOT IN (SELECT key FROM c WHERE status <> 'retry' OR fetched > TIMESTAMP '2024-01-30' - INTERVAL 24 HOUR)""")
def article_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "retry").when(F.col("event_type") == "signup", "gone").otherwise("ok")
    cache = e.where("event_id % 7 = 0").groupBy(F.col("user_id").alias("key")).agg(F.max_by(status, F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("fetched"))
    return to_fetch(e.select(F.col("user_id").alias("key")).distinct(), cache, F.expr("timestamp_ntz'2024-01-30'"))


@query(with_views("nodes", "edges") + """, x AS (SELECT source AS id, list(struct_pack(target := target, type := type, confidence := confidence) ORDER BY type, target) AS out FROM edges GROUP BY source)
SELECT id, type, len(coalesce(out, [])) AS n_out, md5(coalesce(array_to_string(list_transform(out, lambda e: e.type || '>' || e.target), ';'), '')) AS out_md5 FROM nodes LEFT JOIN x USING (id)""")
def graph_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested row per node, its edges inside in order; here as their number and checksum."""
    nested = export_rows(view(spark, sf_dir, "nodes"), view(spark, sf_dir, "edges"))
    joined = F.array_join(F.transform("out", lambda e: F.concat(e["type"], F.lit(">"), e["target"])), ";")
    return nested.select("id", "type", F.size("out").cast("long").alias("n_out"), F.md5(joined).alias("out_md5"))


def export_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, type, name, out (edges by type and target): `.write.json` gives the nested graph. A node's edges are one row, as in the export."""
    out = edges.groupBy(F.col("source").alias("__s")).agg(F.sort_array(F.collect_list(F.struct("type", "target", "confidence"))).alias("out"))
    rows = nodes.join(out, F.col("id") == F.col("__s"), "left")
    return rows.select("id", "type", "name", F.coalesce("out", F.array().cast("array<struct<type:string,target:string,confidence:double>>")).alias("out"))


_ACTION = "CASE WHEN confidence >= 0.9 THEN 'auto' WHEN confidence >= 0.75 THEN 'review' ELSE 'minted' END"


@query(with_views("candidates") + f""" SELECT {_ACTION} AS action, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, min(confidence) AS least FROM candidates GROUP BY 1""")
def resolve_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by what was done with them; the counts add up to the candidates."""
    r = view(spark, sf_dir, "candidates").groupBy(F.expr(_ACTION).alias("action")).agg(F.count("*").alias("n"), F.min("confidence").alias("least"))
    return r.select("action", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6).alias("share"), "least")  # three rows


@query(with_views(*_OUT) + _OUTCOMES + f""", b AS (SELECT hop, horizon, {_BLOCK} FROM o GROUP BY hop, horizon) SELECT hop, horizon, n, hit_rate, ci_low <= 0.5 AND ci_high >= 0.5 AS straddles, n < 10 AS dim FROM b""")
def scorecard_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the scorecard; one whose interval holds a half says nothing, one of few rows is dimmed."""
    b = stat_block(_outcomes(spark, sf_dir), "hop", "horizon")
    return b.select("hop", "horizon", "n", "hit_rate", ((F.col("ci_low") <= 0.5) & (F.col("ci_high") >= 0.5)).alias("straddles"), (F.col("n") < 10).alias("dim"))


@query("""WITH d AS (SELECT ts::DATE AS day, event_type, sum(round(value * 100)::BIGINT) AS cents FROM events GROUP BY ALL), t AS (SELECT *, sum(cents) OVER (PARTITION BY day) AS total, sum(cents) OVER (PARTITION BY day ORDER BY event_type ROWS UNBOUNDED PRECEDING) AS top FROM d)
SELECT day, event_type, round((top - cents) / max(total) OVER (), 6) AS low, round(top / max(total) OVER (), 6) AS high FROM t""")
def usage_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacked bars of a day's cost by kind, the highest day as 1."""
    d = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    stack = Window.partitionBy("day").orderBy("event_type").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("total", F.sum("cents").over(Window.partitionBy("day"))).withColumn("top", F.sum("cents").over(stack))
    most = F.broadcast(d.agg(F.max("total").alias("most")))  # one row
    return d.join(most).select("day", "event_type", F.round((F.col("top") - F.col("cents")) / F.col("most"), 6).alias("low"), F.round(F.col("top") / F.col("most"), 6).alias("high"))


@query("""SELECT page_id, ('2024-01-01'::DATE + (page_id % 30)::INT) AS saved FROM (SELECT page_id::BIGINT AS page_id FROM pages) WHERE page_id % 30 >= 16 ORDER BY saved DESC, page_id""")
def archive_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archived pages within fourteen days of the last day, newest first."""
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id")).withColumn("saved", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 30).cast("int")))
    return rows.where(F.col("saved") > F.date_sub(F.lit("2024-01-30").cast("date"), 14)).orderBy(F.desc("saved"), "page_id")


@query(with_views("nodes", "edges") + """, shown AS (SELECT id FROM nodes WHERE type <> 'Company' OR sector IN ('ASIA', 'EUROPE')) SELECT id, source, target FROM edges WHERE source IN (SELECT id FROM shown) AND target IN (SELECT id FROM shown)""")
def bubble_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between nodes shown when two sectors are open: companies of the others stand inside their bubble."""
    shown = view(spark, sf_dir, "nodes").where("type <> 'Company' or sector in ('ASIA', 'EUROPE')").select("id")
    e = view(spark, sf_dir, "edges").select("id", "source", "target")
    return e.join(shown.withColumnRenamed("id", "source"), "source", "left_semi").join(shown.withColumnRenamed("id", "target"), "target", "left_semi").select("id", "source", "target")


#: Radii of the rings by type, of the circle of sectors and of a sector's spiral; fixed values of the layout.
RINGS, CIRCLE, SPIRAL = {"Regulator": 14.0, "Commodity": 38.0, "Region": 60.0}, 115.0, 22.0
GOLDEN = math.pi * (3 - math.sqrt(5))


def layout(nodes: DataFrame) -> DataFrame:
    """id, x, y: nodes of a ring type evenly on its ring, companies on a golden-angle spiral about their sector's place on the circle.

    Places are row numbers within a type or sector; a null sector is a sector of its own, last.
    """
    ring = F.create_map(*[F.lit(v) for kv in RINGS.items() for v in kv])[F.col("type")]
    nodes = nodes.withColumn("__ring", ring).withColumn("__group", F.when(ring.isNotNull(), F.col("type")).otherwise(F.coalesce("sector", F.lit("~"))))
    sizes = nodes.groupBy("__group").agg(F.count("*").alias("__n"), F.first("__ring").alias("__r"))
    # One row per type and sector.
    order = Window.partitionBy(F.col("__r").isNull()).orderBy("__group")
    sizes = sizes.select(F.col("__group").alias("__g"), "__n", (F.row_number().over(order) - 1).alias("__s"), F.count("*").over(Window.partitionBy(F.col("__r").isNull())).alias("__of"))
    rows = nodes.withColumn("__i", F.row_number().over(Window.partitionBy("__group").orderBy("id")) - 1).join(F.broadcast(sizes), F.col("__group") == F.col("__g"))
    turn = 2 * math.pi * F.col("__i") / F.col("__n")
    place, far = 2 * math.pi * F.col("__s") / F.col("__of"), F.sqrt((F.col("__i") + 0.5) / F.col("__n")) * SPIRAL
    at = lambda f: F.when(F.col("__ring").isNotNull(), F.col("__ring") * f(turn)).otherwise(CIRCLE * f(place) + far * f(F.col("__i") * GOLDEN))
    return rows.select("id", at(F.cos).alias("x"), at(F.sin).alias("y"))


_RING = "CASE type WHEN 'Regulator' THEN 14.0 WHEN 'Commodity' THEN 38.0 WHEN 'Region' THEN 60.0 END::DOUBLE"


@query(with_views("nodes") + f""", r AS (SELECT id, {_RING} AS ring, CASE WHEN type IN ('Regulator', 'Commodity', 'Region') THEN type ELSE coalesce(sector, '~') END AS g FROM nodes),
s AS (SELECT g, ring IS NULL AS free, count(*) AS n FROM r GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY free ORDER BY g) - 1 AS s, count(*) OVER (PARTITION BY free) AS of FROM s),
p AS (SELECT r.*, n, s, of, row_number() OVER (PARTITION BY r.g ORDER BY id) - 1 AS i FROM r JOIN k USING (g))
SELECT id, round(CASE WHEN ring IS NOT NULL THEN ring * cos(2 * pi() * i / n) ELSE 115 * cos(2 * pi() * s / of) + sqrt((i + 0.5) / n) * 22 * cos(i * pi() * (3 - sqrt(5))) END, 4) + 0.0 AS x,
 round(CASE WHEN ring IS NOT NULL THEN ring * sin(2 * pi() * i / n) ELSE 115 * sin(2 * pi() * s / of) + sqrt((i + 0.5) / n) * 22 * sin(i * pi() * (3 - sqrt(5))) END, 4) + 0.0 AS y FROM p""")
def sector_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout(view(spark, sf_dir, "nodes")).select("id", (F.round("x", 4) + 0.0).alias("x"), (F.round("y", 4) + 0.0).alias("y"))


@query(with_views("prices") + """, m AS (SELECT ticker, day FROM prices WHERE t_idx % 4 = 0) SELECT ticker, count(*) AS n_missing, min(day) AS first_missing FROM prices WHERE (ticker, day) NOT IN (SELECT (ticker, day) FROM m) GROUP BY ticker""")
def price_snapshot_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a pinned manifest still lacks, by ticker: bars never tried."""
    p = view(spark, sf_dir, "prices")
    lacking = p.select("ticker", "day").join(p.where("t_idx % 4 = 0").select("ticker", "day"), ["ticker", "day"], "left_anti")
    return lacking.groupBy("ticker").agg(F.count("*").alias("n_missing"), F.min("day").alias("first_missing"))


@query(with_views("nodes") + """ SELECT id, replace(ticker, '.', '-') AS symbol, trim(upper(sector)) AS sector FROM nodes WHERE type = 'Company' AND regexp_matches(ticker, '^[A-Z]{1,4}[0-9]*([.][A-Z])?$') AND NOT provisional""")
def load_firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settled companies with a listing of the home style; the dot of a share class becomes a dash."""
    rows = view(spark, sf_dir, "nodes").where("type = 'Company' and not provisional").where(F.regexp_like("ticker", F.lit("^[A-Z]{1,4}[0-9]*([.][A-Z])?$")))
    return rows.select("id", F.replace("ticker", F.lit("."), F.lit("-")).alias("symbol"), F.trim(F.upper("sector")).alias("sector"))
