"""News records against the graph: organisations to nodes, salience, nearness to business terms, materiality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.operators.graph import degrees, layer
from ripplegraph.plans.catalog import query
from ripplegraph.plans.logical import view, with_views
from ripplegraph.session import join_dimension, table
from ripplegraph.sources.newswire import parse_records

LEDE, NEAR, MENTIONS = 800, 400, 5
#: Our own short lists of theme prefixes and of hard events; parameters of the functions below.
BUSINESS = ("ECON_", "TRADE_")
HARD = ("ECON_BANKRUPTCY", "TRADE_STRIKE")

_THEME = "CASE {t} WHEN 'purchase' THEN 'ECON_SALES' WHEN 'error' THEN 'ECON_BANKRUPTCY' WHEN 'click' THEN 'TRADE_STRIKE' ELSE 'WEATHER' END"


def wire_lines(events: DataFrame) -> DataFrame:
    """The events table as 27-column lines; every thirteenth is cut short, as broken records are."""
    pad = lambda c, p: F.concat(F.lit(p), F.lpad((c).cast("string"), 9, "0"))
    user, sup = pad(F.col("user_id"), "Customer#"), pad(F.col("event_id") % 7, "Supplier#")
    theme = F.expr(_THEME.format(t="event_type"))
    off = (F.col("event_id") * 37 % 1100).cast("string")
    again = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(";"), user, F.lit(","), (F.col("event_id") * 37 % 1100 + 50).cast("string"))).otherwise("")
    v2 = F.concat(user, F.lit(","), off, again, F.lit(";"), sup, F.lit(",900;Nobody Known,5"))
    fields = {0: F.concat(F.lit("r-"), "event_id"), 1: F.date_format("ts", "yyyyMMddHHmmss"), 2: F.lit("1"), 3: F.concat("event_type", F.lit(".example.org")), 4: F.concat(F.lit("https://example.org/"), "event_id"),
              7: F.concat(theme, F.lit(";")), 8: F.concat(theme, F.lit(",600")), 13: F.concat(F.lower(user), F.lit(";"), F.lower(sup)), 14: v2, 15: F.concat_ws(",", F.col("value").cast("string"), F.lit("1"), F.lit("2"), F.format_number(F.col("event_id") % 12, 1), F.lit("0")),
              24: F.when(F.col("event_id") % 5 == 0, F.concat(F.col("value").cast("string"), F.lit(",dollars,300;"))).otherwise(""), 26: F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("<PAGE_TITLE>News of "), user, F.lit(" today</PAGE_TITLE>"))).otherwise("")}
    whole = F.concat_ws("\t", *[fields.get(i, F.lit("")) for i in range(27)])
    return events.select(F.when(F.col("event_id") % 13 == 0, F.concat_ws("\t", *[fields.get(i, F.lit("")) for i in range(20)])).otherwise(whole).alias("line"))


def node_index(nodes: DataFrame, key: Column) -> DataFrame:
    """key, node_id of the keys that mean one node; ambiguous ones go."""
    return nodes.groupBy(key.alias("key")).agg(F.countDistinct("id").alias("n"), F.min("id").alias("node_id")).where("n = 1 and key is not null").select("key", "node_id")


def match_orgs(records: DataFrame, index: DataFrame) -> DataFrame:
    """A row per record and node named in it: earliest offset, mentions, in_title and whether it stands near a business term.

    Organisations are exploded and joined on the name, so the index is a dimension (broadcast when small).
    """
    business = F.filter("v2themes", lambda t: F.exists(F.array(*[F.lit(b) for b in BUSINESS]), lambda b: F.startswith(t["code"], b)))
    spots = F.concat(F.transform(business, lambda t: t["off"]), F.transform("amounts", lambda a: a["off"]))
    o = records.select("record_id", F.lower(F.coalesce("title", F.lit(""))).alias("title"), spots.alias("spots"), F.explode("v2orgs").alias("o"))
    near = F.exists("spots", lambda s: F.abs(s - F.col("o.off")) <= NEAR)
    o = o.select("record_id", "title", F.lower("o.name").alias("key"), F.col("o.off").alias("off"), near.alias("near"))
    met = join_dimension(o, index.withColumnRenamed("key", "k"), F.col("key") == F.col("k"))
    return met.groupBy("record_id", "node_id").agg(F.min("off").alias("earliest"), F.count("*").alias("mentions"), F.bool_or("near").alias("near"), F.bool_or(F.contains("title", F.col("key"))).alias("in_title"))


def salience(rows: DataFrame) -> DataFrame:
    """Adds salience; a node named once, late and not in the title is incidental and goes."""
    kept = rows.where("in_title or earliest <= 800 or mentions > 1")
    lede = F.when(F.col("earliest") <= LEDE, 1.5 * (1 - F.col("earliest") / LEDE)).otherwise(0.0)
    return kept.withColumn("salience", F.round(F.when(F.col("in_title"), 3.0).otherwise(0.0) + lede + 0.3 * F.least("mentions", F.lit(MENTIONS)), 6))


def materiality(themes: Column, amounts: Column, tone: Column, polarity: Column, centrality: Column) -> Column:
    """min(business themes, 3) + 2 for a currency amount + 2 for a hard event + min(|tone| / 5, 2) + 0.5 for polarity above 6 + 2 centrality."""
    business = F.size(F.filter(themes, lambda t: F.exists(F.array(*[F.lit(b) for b in BUSINESS]), lambda b: F.startswith(t, b))))
    money = F.exists(amounts, lambda a: F.regexp_like(F.lower(a["object"]), F.lit(r"\b(dollars?|euros?|pounds?|yen)\b")))
    hard = F.arrays_overlap(themes, F.array(*[F.lit(h) for h in HARD]))
    return F.least(business, F.lit(3)) + 2 * money.cast("int") + 2 * hard.cast("int") + F.least(F.abs(tone) / 5, F.lit(2.0)) + 0.5 * F.coalesce((polarity > 6).cast("int"), F.lit(0)) + 2 * centrality


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_records(wire_lines(table(spark, sf_dir, "events")))


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_orgs(_records(spark, sf_dir), node_index(view(spark, sf_dir, "nodes"), F.lower("name")))


_T = _THEME.format(t="event_type")
_REC = f""", rec AS (SELECT 'r-' || event_id AS record_id, event_id, ts, value, {_T} AS theme, event_id * 37 % 1100 AS off, 'customer#' || lpad(user_id::VARCHAR, 9, '0') AS cust, 'supplier#' || lpad((event_id % 7)::VARCHAR, 9, '0') AS sup,
 CASE WHEN event_id % 3 = 0 THEN 'News of Customer#' || lpad(user_id::VARCHAR, 9, '0') || ' today' END AS title FROM events WHERE event_id % 13 <> 0),
ment AS (SELECT *, cust AS key, off AS o FROM rec UNION ALL SELECT *, cust, off + 50 FROM rec WHERE event_id % 2 = 0 UNION ALL SELECT *, sup, 900 FROM rec UNION ALL SELECT *, 'nobody known', 5 FROM rec),
idx AS (SELECT lower(name) AS key, min(id) AS node_id FROM nodes GROUP BY 1 HAVING count(DISTINCT id) = 1),
mt AS (SELECT record_id, node_id, min(o)::INT AS earliest, count(*) AS mentions, bool_or((theme <> 'WEATHER' AND abs(o - 600) <= 400) OR (event_id % 5 = 0 AND abs(o - 300) <= 400)) AS near, bool_or(contains(lower(coalesce(title, '')), key)) AS in_title
 FROM ment JOIN idx USING (key) GROUP BY ALL),
sal AS (SELECT *, round(CASE WHEN in_title THEN 3.0 ELSE 0.0 END + CASE WHEN earliest <= 800 THEN 1.5 * (1 - earliest / 800) ELSE 0.0 END + 0.3 * least(mentions, 5), 6)::DOUBLE AS salience FROM mt WHERE in_title OR earliest <= 800 OR mentions > 1),
dg AS (SELECT id, count(*) AS n FROM (SELECT source AS id FROM edges WHERE NOT audit UNION ALL SELECT target FROM edges WHERE NOT audit) GROUP BY id), cn AS (SELECT id, n / max(n) OVER () AS centrality FROM dg),
best AS (SELECT s.record_id, s.node_id, s.salience, coalesce(centrality, 0.0) AS centrality FROM sal s LEFT JOIN cn ON cn.id = s.node_id QUALIFY row_number() OVER (PARTITION BY s.record_id ORDER BY s.salience DESC, coalesce(centrality, 0.0) DESC, s.node_id) = 1)"""


@query(f"""SELECT 'r-' || event_id AS record_id, date_trunc('second', ts) AS published_ts, {_T} AS theme, value AS tone, (event_id % 12)::DOUBLE AS polarity, 'customer#' || lpad(user_id::VARCHAR, 9, '0') AS first_org,
 CASE WHEN event_id % 2 = 0 THEN 4 ELSE 3 END AS n_orgs, CASE WHEN event_id % 5 = 0 THEN value END AS amount, CASE WHEN event_id % 3 = 0 THEN 'News of Customer#' || lpad(user_id::VARCHAR, 9, '0') || ' today' END AS title FROM events WHERE event_id % 13 <> 0""")
def parse_gkg(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    return r.select("record_id", F.col("published_ts").cast("timestamp_ntz").alias("published_ts"), F.col("themes")[0].alias("theme"), "tone", "polarity", F.col("orgs")[0].alias("first_org"), F.size("v2orgs").alias("n_orgs"), F.get("amounts", F.lit(0))["value"].alias("amount"), "title")


@query(with_views("nodes") + """ SELECT lower(name) AS key, min(id) AS node_id FROM nodes GROUP BY 1 HAVING count(DISTINCT id) = 1""")
def gkg_node_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_index(view(spark, sf_dir, "nodes"), F.lower("name"))


@query(with_views("nodes", "edges") + _REC + " SELECT record_id, node_id, earliest, mentions, near FROM mt WHERE near")
def proximity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).where("near").select("record_id", "node_id", "earliest", "mentions", "near")


@query(with_views("nodes", "edges") + _REC + " SELECT record_id, node_id, earliest, mentions, in_title, salience FROM sal")
def salience_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return salience(_matches(spark, sf_dir)).select("record_id", "node_id", "earliest", "mentions", "in_title", "salience")


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, node_id, salience, centrality of each record's seed: the most salient node, then the most central, then by id."""
    d = degrees(layer(view(spark, sf_dir, "edges"))).select(F.col("id").alias("node_id"), F.col("degree").alias("n"))
    d = d.join(F.broadcast(d.agg(F.max("n").alias("most")))).select("node_id", (F.col("n") / F.col("most")).alias("centrality"))
    s = salience(_matches(spark, sf_dir)).join(d, "node_id", "left").withColumn("centrality", F.coalesce("centrality", F.lit(0.0)))
    lead = F.min_by(F.struct("node_id", "salience", "centrality"), F.struct(-F.col("salience"), -F.col("centrality"), "node_id"))
    return s.groupBy("record_id").agg(lead.alias("b")).select("record_id", "b.*")


@query(with_views("nodes", "edges") + _REC + " SELECT record_id, node_id, salience, round(centrality, 6) AS centrality FROM best")
def gkg_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir).select("record_id", "node_id", "salience", F.round("centrality", 6).alias("centrality"))


@query(with_views("nodes", "edges") + _REC + """ SELECT record_id, node_id, round((theme <> 'WEATHER')::INT + CASE WHEN event_id % 5 = 0 THEN 2 ELSE 0 END + CASE WHEN theme IN ('ECON_BANKRUPTCY', 'TRADE_STRIKE') THEN 2 ELSE 0 END + least(abs(value) / 5, 2.0)
 + CASE WHEN event_id % 12 > 6 THEN 0.5 ELSE 0.0 END + 2 * centrality, 6) AS prior FROM best JOIN rec USING (record_id)""")
def materiality_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir).select("record_id", "themes", "amounts", "tone", "polarity")
    prior = materiality(F.col("themes"), F.col("amounts"), F.col("tone"), F.col("polarity"), F.col("centrality"))
    return _best(spark, sf_dir).join(r, "record_id").select("record_id", "node_id", F.round(prior, 6).alias("prior"))


@query(with_views("nodes", "edges") + _REC + """ SELECT node_id, centrality FROM best JOIN cn ON id = node_id GROUP BY ALL ORDER BY centrality DESC, node_id LIMIT 15""".replace("SELECT node_id, centrality", "SELECT node_id, cn.centrality").replace("ORDER BY centrality", "ORDER BY cn.centrality"))
def top_matched_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir).where("centrality > 0").select("node_id", "centrality").distinct().orderBy(F.desc("centrality"), "node_id").limit(15)


@query(r"""SELECT page_id, trim(regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]+/(?:.*/)?([^/]+)/?$', 1), '[^A-Za-z0-9]+', ' ', 'g')) AS headline, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages WHERE regexp_matches(url, '^https?://')""")
def headline_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the last path segment, of http(s) pages alone."""
    path = F.regexp_replace("url", r"[?#].*$", "")
    slug = F.regexp_extract(path, r"^https?://[^/]+/(?:.*/)?([^/]+)/?$", 1)
    return table(spark, sf_dir, "pages").where(F.regexp_like("url", F.lit("^https?://"))).select("page_id", F.trim(F.regexp_replace(slug, "[^A-Za-z0-9]+", " ")).alias("headline"), F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"))
