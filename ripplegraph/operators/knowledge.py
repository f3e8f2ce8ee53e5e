"""Rows of an outside knowledge base and of rosters, pairs named in text, and what is attached to nodes and events by small rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplegraph.operators.events import TODAY
from ripplegraph.operators.graph import dedupe
from ripplegraph.plans.catalog import query
from ripplegraph.plans.logical import view, with_views
from ripplegraph.session import join_dimension, table

#: Relations of the knowledge base that make edges: (property, type, does the subject stand at the target end?).
RELATIONS = (("P1056", "supplies", False), ("P176", "supplies", True), ("P1889", "competes_with", False))
#: Sector words in the order tried, our own; the last resort is the default.
SECTOR_WORDS = (("STEEL", "Materials"), ("COPPER", "Materials"), ("TIN", "Materials"), ("BRASS", "Industrials"), ("NICKEL", "Industrials"))


def entity_id(uri: Column) -> Column:
    """Q123 of an entity's address, else null."""
    found = F.regexp_extract(uri, r"/(Q[0-9]+)$", 1)
    return F.when(found != "", found)


def relation_edges(answers: DataFrame, ids: DataFrame, stored: DataFrame) -> DataFrame:
    """source, target, type, n from JSON answers (s, p, o addresses) by the map of entities to nodes; pairs of one node, and pairs that the
    graph has in either direction, go."""
    part = lambda k: F.get_json_object("answer", f"$.{k}.value")
    rows = answers.select(entity_id(part("s")).alias("s"), F.regexp_extract(part("p"), r"(P[0-9]+)$", 1).alias("p"), entity_id(part("o")).alias("o"))
    rows = rows.join(ids.toDF("s", "a"), "s").join(ids.toDF("o", "b"), "o").where("a <> b")
    kinds = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(t).alias("type"), F.lit(turn).alias("turn")) for p, t, turn in RELATIONS])
    rows = rows.withColumn("k", F.get(F.filter(kinds, lambda k: k["p"] == F.col("p")), F.lit(0))).where("k is not null")
    turn = F.col("k.turn")
    rows = rows.select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("source"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("target"), "k.type")
    pair = lambda df: df.select("source", "target").unionByName(df.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    return rows.groupBy("source", "target", "type").agg(F.count("*").alias("n")).join(pair(stored), ["source", "target"], "left_anti")


@query(with_views("edges") + """, r AS (SELECT DISTINCT l_suppkey, l_partkey, CASE l_linenumber % 4 WHEN 0 THEN 'P1056' WHEN 1 THEN 'P176' WHEN 2 THEN 'P1889' ELSE 'P31' END AS p, l_orderkey FROM lineitem WHERE l_suppkey % 7 <> 3),
k AS (SELECT 'sup-' || l_suppkey AS a, 'com-' || l_partkey AS b, p FROM r), e AS (SELECT CASE WHEN p = 'P176' THEN b ELSE a END AS source, CASE WHEN p = 'P176' THEN a ELSE b END AS target, CASE WHEN p = 'P1889' THEN 'competes_with' ELSE 'supplies' END AS type FROM k WHERE p <> 'P31'),
st AS (SELECT source, target FROM edges UNION SELECT target, source FROM edges)
SELECT source, target, type, count(*) AS n FROM e WHERE (source, target) NOT IN (SELECT (source, target) FROM st) GROUP BY ALL""")
def wikidata_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers about suppliers and parts; every seventh supplier is unknown to the map."""
    k = F.col("l_linenumber") % 4
    p = F.when(k == 0, "P1056").when(k == 1, "P176").when(k == 2, "P1889").otherwise("P31")
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", p.alias("p"), "l_orderkey").distinct()
    value = lambda c: F.struct(c.alias("value"))
    at = "https://example.org/entity/"
    answer = F.to_json(F.struct(value(F.concat(F.lit(at + "Q1"), "l_suppkey")).alias("s"), value(F.concat(F.lit("https://example.org/prop/"), "p")).alias("p"), value(F.concat(F.lit(at + "Q2"), "l_partkey")).alias("o")))
    nodes = view(spark, sf_dir, "nodes").select("id")
    number = F.substr("id", F.lit(5))
    ids = nodes.where("id like 'sup-%'").where(number.cast("long") % 7 != 3).select(F.concat(F.lit("Q1"), number).alias("q"), "id")
    ids = ids.unionByName(nodes.where("id like 'com-%'").select(F.concat(F.lit("Q2"), number).alias("q"), "id"))
    return relation_edges(rows.select(answer.alias("answer")), ids, view(spark, sf_dir, "edges"))


@query(with_views("nodes") + """, l AS (SELECT id, name, CASE length(id) % 3 WHEN 0 THEN name WHEN 1 THEN upper(name) ELSE replace(name, '#', ' no. ') END AS label FROM nodes WHERE type = 'Company')
SELECT label AS alias, id AS node_id FROM l WHERE label <> name""")
def wikidata_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label that isn't the node's name becomes an alias of it."""
    k = F.length("id") % 3
    label = F.when(k == 0, F.col("name")).when(k == 1, F.upper("name")).otherwise(F.replace("name", F.lit("#"), F.lit(" no. ")))
    return view(spark, sf_dir, "nodes").where("type = 'Company'").select(label.alias("alias"), F.col("id").alias("node_id"), "name").where("alias <> name").drop("name")


def capped_roster(rows: DataFrame, cap: int) -> DataFrame:
    """One row a qid (the largest, then the least name), and of each country the `cap` largest; row numbers are limited map-side."""
    once = rows.withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("size"), "name"))).where("k = 1")
    return once.withColumn("k", F.row_number().over(Window.partitionBy("country").orderBy(F.desc("size"), "qid"))).where(F.col("k") <= cap)


@query("""WITH r AS (SELECT 'Q' || c_custkey % 700 AS qid, c_name AS name, n_name AS country, round(c_acctbal * 100)::BIGINT AS size FROM customer JOIN nation ON n_nationkey = c_nationkey),
o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY qid ORDER BY size DESC, name) = 1)
SELECT qid, name, country, row_number() OVER (PARTITION BY country ORDER BY size DESC, qid)::INT AS k FROM o QUALIFY k <= 12""")
def region_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country"))
    rows = join_dimension(table(spark, sf_dir, "customer").alias("c"), n.alias("n"), F.col("c.c_nationkey") == F.col("n.c_nationkey"))
    rows = rows.select(F.concat(F.lit("Q"), F.col("c_custkey") % 700).alias("qid"), F.col("c_name").alias("name"), "country", F.round(F.col("c_acctbal") * 100).cast("long").alias("size"))
    return capped_roster(rows, 12).select("qid", "name", "country", "k")


@query(with_views("nodes") + """ SELECT 'slug:' || regexp_replace(trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')), ' ', '-', 'g') AS id, s_name AS name, 'T' || s_suppkey || '.' || upper(substr(n_name, 1, 2)) AS ticker, n_name AS country
FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_name NOT IN (SELECT upper(name) FROM nodes)""")
def roster_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A foreign roster's rows as nodes under a slug, with the exchange's suffix on the ticker; names that the graph has go."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = join_dimension(table(spark, sf_dir, "supplier"), n, F.col("s_nationkey") == F.col("n_nationkey"))
    slug = F.regexp_replace(F.trim(F.regexp_replace(F.lower("s_name"), "[^a-z0-9]+", " ")), " ", "-")
    rows = rows.select(F.concat(F.lit("slug:"), slug).alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("T"), "s_suppkey", F.lit("."), F.upper(F.substr("n_name", F.lit(1), F.lit(2)))).alias("ticker"), F.col("n_name").alias("country"))
    return rows.join(view(spark, sf_dir, "nodes").select(F.upper("name").alias("name")), "name", "left_anti").select("id", "name", "ticker", "country")


def named_edges(articles: DataFrame, names: DataFrame) -> DataFrame:
    """source, target, word: articles (source, text) joined to names (node, word) by the words that stand in their text, found once each; a source doesn't name itself."""
    words = articles.select("source", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+"))).alias("word"))
    return words.join(names, "word").where("source <> node").select("source", F.col("node").alias("target"), "word").distinct()


@query("""WITH f AS (SELECT doc_id, lang, regexp_extract(lower(text), '[a-z]{8,}') AS word FROM documents), nm AS (SELECT 'doc-' || min(doc_id) AS node, word FROM f WHERE word <> '' GROUP BY word),
w AS (SELECT DISTINCT 'doc-' || doc_id AS source, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS word FROM documents WHERE doc_id IS NOT NULL)
SELECT DISTINCT w.source, node AS target, word FROM w JOIN nm USING (word) WHERE w.source <> node""")
def wikipedia_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from articles that name a node (here an article is named by its first long word); the word in the text is the evidence that the gate asks for."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null")
    names = docs.select("doc_id", F.regexp_extract(F.lower("text"), "[a-z]{8,}", 0).alias("word")).where("word <> ''").groupBy("word").agg(F.concat(F.lit("doc-"), F.min("doc_id")).alias("node"))
    return named_edges(docs.select(F.concat(F.lit("doc-"), "doc_id").alias("source"), "text"), names)


@query(with_views("nodes", "aliases", "candidates") + """, m AS (SELECT lower(alias) AS key, min(node_id) AS node_id FROM aliases GROUP BY 1), n AS (SELECT id, name FROM nodes),
p AS (SELECT DISTINCT lower(a.name) AS x, lower(CASE WHEN length(c.target) % 5 = 0 THEN a.name ELSE b.name END) AS y FROM candidates c JOIN n a ON a.id = c.source JOIN n b ON b.id = c.target)
SELECT u.node_id AS a, v.node_id AS b, count(*) AS n FROM p JOIN m u ON u.key = x JOIN m v ON v.key = y WHERE u.node_id <> v.node_id GROUP BY ALL""")
def inference_pair_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs written as one text are decoded and both names resolved; a pair that comes to one node goes."""
    n = view(spark, sf_dir, "nodes").select("id", "name")
    c = view(spark, sf_dir, "candidates").join(n.toDF("source", "x"), "source").join(n.toDF("target", "y"), "target")
    text = F.concat(F.lower("x"), F.lit(" || "), F.lower(F.when(F.length("target") % 5 == 0, F.col("x")).otherwise(F.col("y"))))
    pair = F.split(F.col("pair"), r" \|\| ", 2)
    pairs = c.select(text.alias("pair")).distinct().select(pair[0].alias("x"), pair[1].alias("y"))
    m = view(spark, sf_dir, "aliases").groupBy(F.lower("alias").alias("key")).agg(F.min("node_id").alias("node_id"))
    met = pairs.join(m.toDF("x", "a"), "x").join(m.toDF("y", "b"), "y").where("a <> b")
    return met.groupBy("a", "b").agg(F.count("*").alias("n"))


@query(with_views("headlines", "impacts") + """, t AS (SELECT node_id, event_id, magnitude, row_number() OVER (PARTITION BY node_id ORDER BY magnitude DESC, event_id) AS k FROM impacts WHERE direction <> 'no_effect')
SELECT node_id, string_agg(coalesce(url, '?') || ' ' || coalesce(feed, '?'), ', ' ORDER BY k) AS articles FROM t LEFT JOIN headlines USING (event_id) WHERE k <= 5 GROUP BY node_id""")
def article_meta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node's five strongest events with what is known of their articles, in order."""
    w = Window.partitionBy("node_id").orderBy(F.desc("magnitude"), "event_id")
    top = view(spark, sf_dir, "impacts").where("direction <> 'no_effect'").withColumn("k", F.row_number().over(w)).where("k <= 5")
    meta = view(spark, sf_dir, "headlines").select("event_id", "url", "feed")
    line = F.concat(F.coalesce("url", F.lit("?")), F.lit(" "), F.coalesce("feed", F.lit("?")))
    rows = top.join(meta, "event_id", "left").select("node_id", F.struct("k", line.alias("line")).alias("x"))
    return rows.groupBy("node_id").agg(F.array_join(F.sort_array(F.collect_list("x"))["line"], ", ").alias("articles"))  # five at most


@query(with_views("nodes") + """, s AS (SELECT event_id, unnest(['cus-' || user_id, CASE WHEN event_id % 3 = 0 THEN 'com-' || event_id % 900 ELSE 'reg-' || event_id % 40 END]) AS id FROM events)
SELECT event_id, bool_or(coalesce(type = 'Commodity', false)) AS any_commodity FROM s LEFT JOIN nodes USING (id) GROUP BY event_id""")
def any_commodity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is any of an event's seeds a commodity?"""
    seed = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("com-"), F.col("event_id") % 900)).otherwise(F.concat(F.lit("reg-"), F.col("event_id") % 40))
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(F.array(F.concat(F.lit("cus-"), "user_id"), seed)).alias("id"))
    kinds = view(spark, sf_dir, "nodes").select("id", (F.col("type") == "Commodity").alias("is_one"))
    return rows.join(kinds, "id", "left").groupBy("event_id").agg(F.bool_or(F.coalesce("is_one", F.lit(False))).alias("any_commodity"))


def confidence_of(hop: Column, weighted: Column) -> Column:
    """Less with each hop, more over a weighted edge, never above 0.9."""
    return F.least(F.lit(0.9), F.round(F.greatest(0.8 - 0.2 * hop, F.lit(0.2)) + F.when(weighted, 0.15).otherwise(0.0), 6))


@query(with_views("edges") + """, t AS (SELECT id, weight, length(id) % 4 AS hop FROM edges) SELECT id, hop, least(0.9, round(greatest(0.8 - 0.2 * hop, 0.2) + CASE WHEN weight IS NOT NULL THEN 0.15 ELSE 0.0 END, 6))::DOUBLE AS confidence FROM t""")
def heuristic_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    hop = F.length("id") % 4
    return view(spark, sf_dir, "edges").select("id", hop.alias("hop"), confidence_of(hop, F.col("weight").isNotNull()).alias("confidence"))


@query("""SELECT p_partkey, coalesce(CASE p_size WHEN 7 THEN 'Energy' WHEN 11 THEN 'Health Care' END, CASE WHEN contains(upper(p_type), 'STEEL') THEN 'Materials' WHEN contains(upper(p_type), 'COPPER') THEN 'Materials' WHEN contains(upper(p_type), 'TIN') THEN 'Materials'
 WHEN contains(upper(p_type), 'BRASS') THEN 'Industrials' WHEN contains(upper(p_type), 'NICKEL') THEN 'Industrials' END, 'Unclassified') AS sector FROM part""")
def gics_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sector mapped to a known code, else that of the first word found, else the default."""
    code = F.try_element_at(F.create_map(F.lit(7), F.lit("Energy"), F.lit(11), F.lit("Health Care")), F.col("p_size"))
    word = F.get(F.filter(F.array(*[F.when(F.contains(F.upper("p_type"), F.lit(w)), s) for w, s in SECTOR_WORDS]), lambda x: x.isNotNull()), F.lit(0))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(code, word, F.lit("Unclassified")).alias("sector"))


@query(with_views("edges", "impacts") + """, d AS (SELECT node_id, max(ts) AS last, sum(CASE direction WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END) AS net FROM impacts GROUP BY node_id)
SELECT node_id, CASE WHEN net > 0 THEN 'up' WHEN net < 0 THEN 'down' ELSE 'flat' END AS label, date_diff('day', last::DATE, DATE '2024-01-30') AS days_old, CASE WHEN date_diff('day', last::DATE, DATE '2024-01-30') > 3 THEN 'stale' ELSE 'fresh' END AS state FROM d""")
def node_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node's direction in words and how old its last event is."""
    sign = F.when(F.col("direction") == "positive", 1).when(F.col("direction") == "negative", -1).otherwise(0)
    d = view(spark, sf_dir, "impacts").groupBy("node_id").agg(F.max("ts").alias("last"), F.sum(sign).alias("net"))
    age = F.datediff(F.lit(TODAY).cast("date"), F.to_date("last")).cast("long")
    return d.select("node_id", F.when(F.col("net") > 0, "up").when(F.col("net") < 0, "down").otherwise("flat").alias("label"), age.alias("days_old"), F.when(age > 3, "stale").otherwise("fresh").alias("state"))


@query(with_views("candidates") + """, g AS (SELECT source, target, type, confidence, snippet, row_number() OVER (PARTITION BY source, target, type ORDER BY confidence DESC, snippet) AS k, count(*) OVER (PARTITION BY source, target, type) AS n FROM candidates)
SELECT source, target, string_agg(snippet, ' | ' ORDER BY k) FILTER (k BETWEEN 2 AND 6) AS folded FROM g GROUP BY source, target, type HAVING max(n) > 1""")
def folded_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of the next five candidates, in their order, folded into an edge that has more than one."""
    w = Window.partitionBy("source", "target", "type").orderBy(F.desc("confidence"), "snippet")
    rows = view(spark, sf_dir, "candidates").withColumn("k", F.row_number().over(w)).where("k between 2 and 6")
    folded = rows.groupBy("source", "target", "type").agg(F.array_join(F.sort_array(F.collect_list(F.struct("k", "snippet")))["snippet"], " | ").alias("folded"))
    return dedupe(view(spark, sf_dir, "candidates")).where("n_extra > 0").join(folded, ["source", "target", "type"]).select("source", "target", "folded")
