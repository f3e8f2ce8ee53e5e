"""Table upkeep and rule edges: appends by several keys, curated inserts, rotation, weights, rule catalogues and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplegraph.plans.catalog import query
from ripplegraph.plans.logical import CUTOFF, view, with_views
from ripplegraph.session import join_dimension, table


def append_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of `new` that share no non-null key with `old`, one for each first key (the least row)."""
    for k in keys:
        new = new.join(old.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_anti")
    rest = [c for c in new.columns if c != keys[0]]
    return new.groupBy(keys[0]).agg(F.min(F.struct(*rest)).alias("r")).select(keys[0], "r.*")


@query(with_views("nodes") + """, old AS (SELECT id, name FROM nodes WHERE length(id) % 2 = 0), new AS (SELECT id, name FROM nodes WHERE type IN ('Company', 'Commodity'))
SELECT id, min(name) AS name FROM new WHERE id NOT IN (SELECT id FROM old) AND name NOT IN (SELECT name FROM old) GROUP BY id""")
def append_dedupe_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = view(spark, sf_dir, "nodes").select("id", "name", "type")
    return append_new(nodes.where("length(id) % 2 = 0").select("id", "name"), nodes.where("type in ('Company', 'Commodity')").select("id", "name"), ["id", "name"]).select("id", "name")


def curated(rows: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (source, target, type) whose two ends exist and whose triple doesn't."""
    ids = nodes.select("id")
    for end in ("source", "target"):
        rows = rows.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return rows.join(edges.select("source", "target", "type").distinct(), ["source", "target", "type"], "left_anti").distinct()


@query(with_views("nodes", "edges") + """, new AS (SELECT DISTINCT 'sup-' || l_suppkey AS source, 'cus-' || (l_orderkey % 2000) AS target, 'supplies' AS type FROM lineitem WHERE l_quantity = 1)
SELECT source, target, type FROM new WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes) AND (source, target, type) NOT IN (SELECT (source, target, type) FROM edges)""")
def curated_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "lineitem").where("l_quantity = 1").select(F.concat(F.lit("sup-"), "l_suppkey").alias("source"), F.concat(F.lit("cus-"), F.col("l_orderkey") % 2000).alias("target"), F.lit("supplies").alias("type"))
    return curated(new, view(spark, sf_dir, "nodes"), view(spark, sf_dir, "edges")).select("source", "target", "type")


@query(with_views("nodes") + """, a AS (SELECT id, name, 0 AS pri FROM nodes WHERE type = 'Company' UNION ALL SELECT id, upper(name), 1 FROM nodes WHERE type IN ('Company', 'Region'))
SELECT id, arg_min(name, pri) AS name, count(*) AS n_sets FROM a GROUP BY id""")
def merge_node_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of one id the first set's row leads."""
    n = view(spark, sf_dir, "nodes")
    both = n.where("type = 'Company'").select("id", "name", F.lit(0).alias("pri")).unionByName(n.where("type in ('Company', 'Region')").select("id", F.upper("name").alias("name"), F.lit(1).alias("pri")))
    return both.groupBy("id").agg(F.min_by("name", "pri").alias("name"), F.count("*").alias("n_sets"))


def rotate(days: DataFrame, newest: int = 14, months: int = 12) -> DataFrame:
    """Of the days on file, the newest ones and the first of each of the last months. A row a day: one small window."""
    first = F.row_number().over(Window.partitionBy(F.date_trunc("month", "day")).orderBy("day")) == 1
    k = F.row_number().over(Window.orderBy(F.desc("day")))
    m = F.dense_rank().over(Window.orderBy(F.desc(F.date_trunc("month", "day"))))
    return days.withColumn("first", first).withColumn("k", k).withColumn("m", m).where((F.col("k") <= newest) | (F.col("first") & (F.col("m") <= months))).select("day")


@query("""SELECT day FROM (SELECT DISTINCT l_shipdate::DATE AS day FROM lineitem)
QUALIFY row_number() OVER (ORDER BY day DESC) <= 14 OR (row_number() OVER (PARTITION BY date_trunc('month', day) ORDER BY day) = 1 AND dense_rank() OVER (ORDER BY date_trunc('month', day) DESC) <= 12)""")
def backup_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("day")).distinct())


@query(with_views("candidates") + f" SELECT source, target, confidence, confidence < {CUTOFF} AS below_threshold FROM candidates")
def threshold_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "candidates").select("source", "target", "confidence", (F.col("confidence") < CUTOFF).alias("below_threshold"))


@query("""SELECT o_orderkey AS id, coalesce(try_cast(nullif(p, '') AS DATE), o_orderdate::DATE) AS day FROM (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'soon' ELSE strftime(o_orderdate + INTERVAL 9 DAY, '%Y-%m-%d') END AS p FROM orders)
WHERE coalesce(try_cast(nullif(p, '') AS DATE), o_orderdate::DATE) BETWEEN DATE '1999-06-01' AND DATE '1999-12-31'""")
def window_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row's day is its published text where that is a date, else the day it came in; the future and the old go."""
    k = F.col("o_orderkey") % 3
    p = F.when(k == 0, "").when(k == 1, "soon").otherwise(F.date_format(F.col("o_orderdate") + F.expr("interval 9 day"), "yyyy-MM-dd"))
    day = F.coalesce(F.nullif(p, F.lit("")).try_cast("date"), F.col("o_orderdate").cast("date"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), day.alias("day")).where("day between date'1999-06-01' and date'1999-12-31'")


#: Confidence floors of the tiers of evidence, ours.
_TIER = "CASE WHEN weight IS NOT NULL AND confidence >= 0.75 THEN 'measured' WHEN type = 'regulated_by' THEN 'rule' WHEN inferred THEN 'inferred' ELSE 'stated' END"
_FLOOR = "CASE {t} WHEN 'measured' THEN 0.9 WHEN 'rule' THEN 0.85 WHEN 'stated' THEN 0.7 ELSE 0.5 END"


@query(with_views("edges") + f", t AS (SELECT *, {_TIER} AS tier FROM edges) SELECT id, tier, greatest(confidence, {_FLOOR.format(t='tier')})::DOUBLE AS confidence FROM t")
def edge_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier by ordered rules; confidence never falls."""
    t = view(spark, sf_dir, "edges").withColumn("tier", F.expr(_TIER))
    return t.select("id", "tier", F.greatest("confidence", F.expr(_FLOOR.format(t="tier")).cast("double")).alias("confidence"))


@query(with_views("edges") + f" SELECT {_TIER} AS tier, count(*) AS n, count(weight) AS n_weighted FROM edges GROUP BY 1")
def tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "edges").groupBy(F.expr(_TIER).alias("tier")).agg(F.count("*").alias("n"), F.count("weight").alias("n_weighted"))


def percent(text: Column) -> Column:
    """The first percentage of 5 to 99 in a text."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)\s?%"), F.lit(1)), lambda x: x.cast("double"))
    return F.get(F.filter(found, lambda x: (x >= 5) & (x <= 99)), F.lit(0))


@query(r"""SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '(\d+(?:\.\d+)?)\s?%', 1), lambda x: x::DOUBLE), lambda x: x BETWEEN 5 AND 99)[1] AS pct, length(text) - length(replace(text, '%', '')) AS n_signs FROM documents""")
def pct_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", percent(F.col("text")).alias("pct"), (F.length("text") - F.length(F.replace("text", F.lit("%"), F.lit("")))).cast("long").alias("n_signs"))


def comention(candidates: DataFrame, least: int = 2) -> DataFrame:
    """source, a, b, n: pairs a < b of the targets that one snippet of a source names; a snippet names few."""
    g = candidates.groupBy("source", "snippet").agg(F.array_sort(F.collect_set("target")).alias("t")).where(F.size("t") >= least)
    first = g.select("source", "t", F.posexplode("t").alias("i", "a"))
    return first.select("source", "a", F.explode(F.slice("t", F.col("i") + 2, F.size("t"))).alias("b")).groupBy("source", "a", "b").agg(F.count("*").alias("n"))


@query(with_views("candidates") + """, g AS (SELECT DISTINCT source, substr(snippet, length(snippet) - 9, 4) AS snippet, target FROM candidates)
SELECT x.source, x.target AS a, y.target AS b, count(*) AS n FROM g x JOIN g y ON x.source = y.source AND x.snippet = y.snippet AND x.target < y.target GROUP BY ALL""")
def comention_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.substr("snippet", F.length("snippet") - 9, F.lit(4))
    return comention(view(spark, sf_dir, "candidates").withColumn("snippet", year))


@query("""SELECT s_nationkey * 10 + s_suppkey % 10 AS cik, arg_min(s_name, s_suppkey) AS name, string_agg('T' || s_suppkey, ',' ORDER BY s_suppkey) AS tickers, count(*) AS n FROM supplier GROUP BY 1""")
def cik_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share classes of one filer as one company: the first row leads, tickers in order. A filer has few classes."""
    s = table(spark, sf_dir, "supplier").withColumn("cik", F.col("s_nationkey") * 10 + F.col("s_suppkey") % 10)
    tickers = F.array_join(F.transform(F.array_sort(F.collect_list("s_suppkey")), lambda k: F.concat(F.lit("T"), k)), ",")
    return s.groupBy("cik").agg(F.min_by("s_name", "s_suppkey").alias("name"), tickers.alias("tickers"), F.count("*").alias("n"))


@query(with_views("nodes") + """, r AS (SELECT p_type AS industry, 'com-' || min(p_partkey) AS commodity FROM part GROUP BY p_type, p_size % 3), k AS (SELECT DISTINCT industry, row_number() OVER (ORDER BY industry) AS i FROM (SELECT DISTINCT p_type AS industry FROM part))
SELECT n.id AS source, commodity AS target FROM nodes n JOIN k ON n.industry = 'ind-' || (i % 7) JOIN r ON r.industry = k.industry WHERE n.type = 'Company'""")
def commodity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Industry to commodity edges from a rule table (an array of commodities an industry), exploded on the joined firms."""
    part = table(spark, sf_dir, "part")
    least = part.groupBy(F.col("p_type").alias("kind"), (F.col("p_size") % 3).alias("m")).agg(F.concat(F.lit("com-"), F.min("p_partkey")).alias("c"))
    # One row for each part type.
    rules = least.groupBy("kind").agg(F.collect_set("c").alias("commodities")).withColumn("i", F.row_number().over(Window.orderBy("kind")))
    rules = rules.select(F.concat(F.lit("ind-"), F.col("i") % 7).alias("rule"), "commodities")
    firms = view(spark, sf_dir, "nodes").where("type = 'Company'").select(F.col("id").alias("source"), "industry")
    return join_dimension(firms, rules, F.col("industry") == F.col("rule")).select("source", F.explode("commodities").alias("target"))


@query("""WITH l AS (SELECT c_custkey, c_nationkey < 5 AS home, ['r' || c_custkey % 4, 'r' || c_custkey % 6, 'r' || c_custkey % 9] AS i, ['r' || c_nationkey % 7, 'r' || c_nationkey % 5] AS c FROM customer),
n AS (SELECT c_custkey, home, list_filter(i, lambda v, k: list_position(i, v) = k) AS by_industry, list_filter(c, lambda v, k: list_position(c, v) = k) AS by_country FROM l),
x AS (SELECT *, list_filter(by_industry, lambda v: list_contains(by_country, v)) AS shared, list_filter(by_country, lambda v: NOT list_contains(by_industry, v)) AS rest FROM n)
SELECT c_custkey, array_to_string(CASE WHEN home THEN by_industry WHEN len(shared) = 0 THEN by_country ELSE list_concat(shared, rest) END, ',') AS retailers FROM x""")
def retail_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At home the industry's list; abroad what industry and country share, then the rest of the country's, which is all if they share none."""
    r = lambda c, m: F.concat(F.lit("r"), F.col(c) % m)
    by_industry = F.array_distinct(F.array(r("c_custkey", 4), r("c_custkey", 6), r("c_custkey", 9)))
    by_country = F.array_distinct(F.array(r("c_nationkey", 7), r("c_nationkey", 5)))
    both = F.array_intersect(by_industry, by_country)
    route = F.when(F.col("c_nationkey") < 5, by_industry).when(F.size(both) == 0, by_country).otherwise(F.concat(both, F.array_except(by_country, by_industry)))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(route, ",").alias("retailers"))


@query("""WITH p AS (SELECT l_suppkey AS a, l_partkey AS b, max(l_discount) AS pct FROM lineitem GROUP BY ALL), e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_returnflag = 'R')
SELECT a, b, pct, CASE WHEN (a, b) IN (SELECT (a, b) FROM e) THEN 'update' ELSE 'create' END AS action FROM p WHERE pct >= 0.05""")
def weight_update_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest share of a pair updates the edge that exists, else makes one."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), "l_discount", (F.col("l_returnflag") == "R").alias("known"))
    # Both sides come from one table: one aggregation serves for the join.
    g = li.groupBy("a", "b").agg(F.max("l_discount").alias("pct"), F.bool_or("known").alias("known")).where("pct >= 0.05")
    return g.select("a", "b", "pct", F.when(F.col("known"), "update").otherwise("create").alias("action"))


def grounded(snippet: Column, text: Column, target: Column) -> tuple[Column, Column]:
    """(does the normalised snippet stand in the normalised text?, does it hold a word of the target of four letters or more?)."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    words = F.filter(F.split(norm(target), " "), lambda w: F.length(w) >= 4)
    return (norm(snippet) != "") & F.contains(norm(text), norm(snippet)), F.size(F.array_intersect(words, F.split(norm(snippet), " "))) > 0


@query(r"""WITH s AS (SELECT doc_id, text, string_split(text, chr(10))[1] || CASE WHEN doc_id % 3 = 0 THEN ' unfounded' ELSE '' END AS snippet, CASE WHEN doc_id % 2 = 0 THEN substr(text, 1, 30) ELSE 'someone else' END AS target FROM documents),
n AS (SELECT doc_id, trim(regexp_replace(lower(snippet), '[^a-z0-9]+', ' ', 'g')) AS sn, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS tx, trim(regexp_replace(lower(target), '[^a-z0-9]+', ' ', 'g')) AS tg FROM s)
SELECT doc_id, sn <> '' AND contains(tx, sn) AS in_text, len(list_filter(string_split(tg, ' '), lambda w: length(w) >= 4 AND list_contains(string_split(sn, ' '), w))) > 0 AS has_token FROM n""")
def grounding_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines as snippets, every third of them with a word that the text doesn't have; targets from the text or from elsewhere."""
    third, even = F.col("doc_id") % 3 == 0, F.col("doc_id") % 2 == 0
    snippet = F.concat(F.split("text", "\n")[0], F.when(third, " unfounded").otherwise(""))
    target = F.when(even, F.substr("text", F.lit(1), F.lit(30))).otherwise("someone else")
    in_text, has_token = grounded(snippet, F.col("text"), target)
    return table(spark, sf_dir, "documents").select("doc_id", in_text.alias("in_text"), has_token.alias("has_token"))


def merge_spans(spots: DataFrame, around: int) -> DataFrame:
    """id, start, stop: windows of `around` on both sides of each spot, overlapping ones of an id merged (gaps and islands)."""
    w = Window.partitionBy("id").orderBy("off")
    fresh = F.coalesce((F.col("off") - F.lag("off").over(w) > 2 * around).cast("int"), F.lit(1))
    runs = spots.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("id", "run").agg(F.greatest(F.min("off") - around, F.lit(0)).alias("start"), (F.max("off") + around).alias("stop"), F.count("*").alias("n")).drop("run")


@query("""WITH s AS (SELECT l_orderkey AS id, (l_partkey * 7 % 3000)::BIGINT AS off FROM lineitem), f AS (SELECT *, CASE WHEN off - lag(off) OVER (PARTITION BY id ORDER BY off) <= 300 THEN 0 ELSE 1 END AS fresh FROM s),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY off ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT id, greatest(min(off) - 150, 0) AS start, max(off) + 150 AS stop, count(*) AS n FROM r GROUP BY id, run""")
def section_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_spans(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") * 7 % 3000).alias("off")), 150)


@query("""SELECT l_orderkey AS id, list_sort(list(l_partkey))[:3]::VARCHAR AS firsts, count(*) AS n FROM lineitem GROUP BY 1""".replace("::VARCHAR", "")
       .replace("list_sort(list(l_partkey))[:3]", "array_to_string(list_sort(list(l_partkey))[:3], ',')"))
def row_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three of each key: numbered, which limits map-side, so no key's rows are gathered."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_partkey")
    k = F.row_number().over(Window.partitionBy("id").orderBy("l_partkey"))
    first = li.withColumn("k", k).where("k <= 3").groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("l_partkey")), ",").alias("firsts"))
    return first.join(li.groupBy("id").agg(F.count("*").alias("n")), "id")
