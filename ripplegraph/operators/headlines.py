"""Headlines: what is material, what is no news, and how feeds are deduplicated, interleaved and capped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplegraph.operators.events import TODAY, signature
from ripplegraph.operators.graph import degrees, layer
from ripplegraph.plans.catalog import query
from ripplegraph.plans.logical import view, with_views
from ripplegraph.session import table

#: Tokens of a headline: numbers with what stands on them (a currency before, a per cent sign after), and words.
TOKEN = r"[$€£]?[0-9]+(?:[.,][0-9]+)*%?|[a-z]+"
#: Word lists by role, our own choice; a token has a role if it is in the list as it stands.
ROLES = {
    "unit": ("thousand", "million", "billion", "trillion", "mn", "bn", "tn"),
    "deal": ("acquire", "acquires", "acquired", "merger", "merge", "merges", "takeover", "buyout", "stake", "bid", "divest", "divests", "spinoff"),
    "law": ("lawsuit", "sues", "sued", "probe", "probes", "fined", "ruling", "verdict", "sanctions", "tariff", "tariffs", "patent", "antitrust"),
    "plant": ("recall", "recalls", "outage", "shortage", "strike", "halts", "delayed", "shutdown", "explosion", "shipments", "backlog", "rollout"),
    "staff": ("resigns", "appoints", "layoffs", "ousted", "hires"),
    "figure": ("revenue", "profit", "profits", "sales", "earnings", "output", "margin", "orders"),
    "move": ("rise", "rises", "rose", "climbs", "gains", "jumps", "grew", "grows", "growing", "doubles", "falls", "fell", "drops", "slips", "sinks", "shrinks"),
    "share": ("share", "shares", "stock", "stocks"),
    "calm": ("flat", "steady", "unchanged", "mixed", "little"),
    "reason": ("as", "after", "amid", "despite", "on", "before"),
    "opener": ("should", "how", "why", "what", "where"),
    "reader": ("you", "buy", "sell", "hold", "invest", "know", "watch", "expect"),
}
#: Roles that make a headline material by themselves.
ACTS = ("deal", "law", "plant", "staff")
#: Tokens between which two roles count as said of each other, by rule.
NEAR = {"amount": 1, "results": 4, "quote": 5, "calm": 4, "reason": 1, "advice": 3}
#: A prior that is kept unjudged (a filing), and the prior under which a headline goes unjudged.
AUTOKEEP, DROP = 99.0, 1.5


def tokens(headline: Column) -> Column:
    """The tokens in order; a missing headline has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(headline, F.lit(""))), F.lit(TOKEN), F.lit(0))


def places(words: Column, role: str) -> Column:
    """The positions at which a token has the role; numbers are the roles number, price and percent."""
    shape = {"number": "^[0-9]", "price": "^[$€£]", "percent": "%$"}
    has = (lambda t: F.regexp_like(t, F.lit(shape[role]))) if role in shape else (lambda t: t.isin(*ROLES[role]))
    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: has(F.get(words, i)))


def follows(words: Column, first: str, then: str, within: int) -> Column:
    """Does a token of one role come at most `within` tokens after one of another?"""
    last = places(words, then)
    return F.exists(places(words, first), lambda i: F.exists(last, lambda j: (j > i) & (j - i <= within)))


def findings(words: Column) -> dict[str, Column]:
    """What a headline tells: an amount of money, an act, results, or that it is a quote, a calm market or advice."""
    some = F.size(words) > 0
    has = lambda *roles: F.exists(words, lambda t: t.isin(*[w for r in roles for w in ROLES[r]]))
    quote = follows(words, "share", "move", NEAR["quote"]) & (F.size(places(words, "percent")) > 0)
    calm = follows(words, "share", "calm", NEAR["calm"]) & follows(words, "calm", "reason", NEAR["reason"])
    advice = F.get(words, F.lit(0)).isin(*ROLES["opener"]) & F.exists(F.slice(words, 2, NEAR["advice"]), lambda t: t.isin(*ROLES["reader"]))
    found = {
        "money": (F.size(places(words, "price")) > 0) | follows(words, "number", "unit", NEAR["amount"]),
        "act": has(*ACTS),
        "results": follows(words, "figure", "move", NEAR["results"]),
        "quote": quote,
        "calm": calm,
        "advice": advice,
    }
    return {k: F.when(some, c).otherwise(False) for k, c in found.items()}


def classify(rows: DataFrame) -> DataFrame:
    """rows with findings, material and nonnews: a quiet market is no news unless money or an act is told, quotes and advice unless anything is."""
    rows = rows.withColumn("__words", tokens(F.col("headline")))
    rows = rows.select("*", *[c.alias(k) for k, c in findings(F.col("__words")).items()]).drop("__words")
    strong = F.col("money") | F.col("act")
    rows = rows.withColumn("material", strong | F.col("results"))
    return rows.withColumn("nonnews", (F.col("calm") & ~strong) | ((F.col("quote") | F.col("advice")) & ~F.col("material")))


def _list(role: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in ROLES[role]) + "]"


def _at(role: str) -> str:
    shape = {"number": "^[0-9]", "price": "^[$€£]", "percent": "%$"}
    test = f"regexp_matches(w[i], '{shape[role]}')" if role in shape else f"list_contains({_list(role)}, w[i])"
    return f"list_filter(range(1, len(w) + 1), lambda i: {test})"


def _follows(first: str, then: str, within: int) -> str:
    return f"len(list_filter({_at(first)}, lambda a: len(list_filter({_at(then)}, lambda b: b > a AND b - a <= {within})) > 0)) > 0"


_HAS = f""", t AS (SELECT *, regexp_extract_all(lower(coalesce(headline, '')), '{TOKEN}') AS w FROM headlines),
g AS (SELECT *, len({_at("price")}) > 0 OR {_follows("number", "unit", NEAR["amount"])} AS money, len(list_filter(w, lambda x: {" OR ".join(f"list_contains({_list(r)}, x)" for r in ACTS)})) > 0 AS act,
 {_follows("figure", "move", NEAR["results"])} AS results, {_follows("share", "move", NEAR["quote"])} AND len({_at("percent")}) > 0 AS quote,
 {_follows("share", "calm", NEAR["calm"])} AND {_follows("calm", "reason", NEAR["reason"])} AS calm,
 coalesce(list_contains({_list("opener")}, w[1]), false) AND len(list_filter(w[2:{1 + NEAR["advice"]}], lambda x: list_contains({_list("reader")}, x))) > 0 AS advice FROM t),
nn AS (SELECT *, money OR act OR results AS material, (calm AND NOT (money OR act)) OR ((quote OR advice) AND NOT (money OR act OR results)) AS nonnews FROM g)"""


@query(with_views("headlines") + _HAS + " SELECT event_id, money, act, results, material FROM nn")
def materiality_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(view(spark, sf_dir, "headlines")).select("event_id", "money", "act", "results", "material")


@query(with_views("headlines") + _HAS + " SELECT event_id, quote, calm, advice, nonnews FROM nn")
def nonnews_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(view(spark, sf_dir, "headlines")).select("event_id", "quote", "calm", "advice", "nonnews")


@query(with_views("headlines") + _HAS + " SELECT event_id, CASE WHEN nonnews THEN 'non_news' WHEN prior = 99 THEN 'keep' WHEN prior < 1.5 THEN 'drop' ELSE 'judge' END AS band FROM nn")
def materiality_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-news goes first, then filings are kept, then low priors go; the rest, those without a prior too, await a verdict."""
    prior = F.col("prior")
    band = F.when(F.col("nonnews"), "non_news").when(prior == AUTOKEEP, "keep").when(prior < DROP, "drop").otherwise("judge")
    return classify(view(spark, sf_dir, "headlines")).select("event_id", band.alias("band"))


def three_layers(batch: DataFrame, stored: DataFrame, days: int = 7) -> DataFrame:
    """New rows of a batch, by layers: url neither stored nor earlier in the batch; story signature not stored within `days` before
    nor earlier; (seed, day, first six words) not earlier. Rows without a headline or signature opt out of the later layers.

    Row number 1 of a key is limited map-side before the shuffle, so a key that repeats often moves few rows.
    """
    sig = signature(F.col("seed"), F.col("headline"))
    first = lambda *key: F.row_number().over(Window.partitionBy(*key).orderBy("ts", "event_id")) == 1
    own = F.concat(F.lit("own-"), "event_id")
    rows = batch.join(stored.select("url").distinct(), "url", "left_anti").withColumn("__a", first("url")).where("__a")
    known = stored.select(sig.alias("__k"), "ts").where("__k is not null").groupBy("__k").agg(F.max("ts").alias("__seen"))
    rows = rows.withColumn("__sig", sig).join(known, F.col("__sig") == F.col("__k"), "left")
    rows = rows.where(F.col("__seen").isNull() | (F.col("__seen") < F.col("ts") - F.expr(f"interval {days} days")))
    rows = rows.withColumn("__key", F.coalesce("__sig", own)).withColumn("__b", first("__key")).where("__b")
    words = F.array_join(F.slice(F.filter(F.split(F.lower("headline"), "[^a-z0-9]+"), lambda w: w != ""), 1, 6), " ")
    rows = rows.withColumn("__key", F.coalesce(F.concat_ws("|", "seed", F.to_date("ts"), words), own)).withColumn("__key", F.when(F.col("headline").isNull(), own).otherwise(F.col("__key")))
    return rows.withColumn("__c", first("__key")).where("__c").drop("__a", "__k", "__seen", "__sig", "__key", "__b", "__c")


_SIG = """, w0 AS (SELECT *, list_filter(string_split_regex(lower(headline), '[^a-z0-9]+'), lambda w: w <> '') AS ws FROM headlines),
w1 AS (SELECT *, list_filter(ws, lambda w: length(w) >= 3 AND w NOT IN ('the', 'of', 'and', 'der', 'die', 'et', 'de')) AS wd FROM w0),
w2 AS (SELECT *, list_slice(list_filter(list_transform(range(1, len(wd) + 1), lambda i: CASE WHEN list_position(wd, wd[i]) = i THEN wd[i] END), lambda x: x IS NOT NULL), 1, 8) AS w8, list_slice(ws, 1, 6) AS w6 FROM w1),
sg AS (SELECT *, CASE WHEN len(w8) >= 3 THEN seed || '|' || array_to_string(w8, ' ') END AS sig FROM w2),
st AS (SELECT * FROM sg WHERE ts < TIMESTAMP '2024-01-25'), l0 AS (SELECT * FROM sg WHERE ts >= TIMESTAMP '2024-01-25' AND url NOT IN (SELECT url FROM st) QUALIFY row_number() OVER (PARTITION BY url ORDER BY ts, event_id) = 1),
kn AS (SELECT sig AS k, max(ts) AS seen FROM st WHERE sig IS NOT NULL GROUP BY sig), l1 AS (SELECT * FROM l0 LEFT JOIN kn ON sig = k WHERE seen IS NULL OR seen < ts - INTERVAL 7 DAYS),
l2 AS (SELECT * FROM l1 QUALIFY sig IS NULL OR row_number() OVER (PARTITION BY sig ORDER BY ts, event_id) = 1),
l3 AS (SELECT * FROM l2 QUALIFY headline IS NULL OR row_number() OVER (PARTITION BY seed, ts::DATE, w6 ORDER BY ts, event_id) = 1)"""


def _fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, start = view(spark, sf_dir, "headlines"), F.expr("timestamp_ntz'2024-01-25'")
    return three_layers(rows.where(F.col("ts") >= start), rows.where(F.col("ts") < start))


@query(with_views("headlines") + _SIG + " SELECT event_id, url FROM l3")
def three_layer_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fresh(spark, sf_dir).select("event_id", "url")


@query(with_views("headlines") + _SIG + " SELECT event_id, prior FROM l3 WHERE prior IS NOT NULL ORDER BY prior DESC, event_id LIMIT 40")
def precap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 new stories of the highest prior."""
    return _fresh(spark, sf_dir).where("prior is not null").select("event_id", "prior").orderBy(F.desc("prior"), "event_id").limit(40)


@query(with_views("headlines") + """, f AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY ts DESC, event_id) AS depth FROM headlines WHERE ts >= TIMESTAMP '2024-01-23'),
u AS (SELECT * FROM f WHERE depth <= 8 QUALIFY row_number() OVER (PARTITION BY url ORDER BY depth, feed) = 1) SELECT event_id, feed, depth::INT AS depth FROM u ORDER BY depth, feed LIMIT 60""")
def rss_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest eight of each feed that are not stale, feeds in turn, a url once, sixty in all."""
    fresh = view(spark, sf_dir, "headlines").where(F.col("ts") >= F.expr(f"timestamp_ntz'{TODAY}'") - F.expr("interval 7 days"))
    ranked = fresh.withColumn("depth", F.row_number().over(Window.partitionBy("feed").orderBy(F.desc("ts"), "event_id"))).where("depth <= 8")
    once = ranked.groupBy("url").agg(F.min(F.struct("depth", "feed", "event_id")).alias("r"))
    return once.select("r.event_id", "r.feed", "r.depth").orderBy("depth", "feed").limit(60)


@query(with_views("headlines", "nodes") + """ SELECT url, seed AS node_id, sentiment FROM headlines WHERE seed IN (SELECT id FROM nodes)
QUALIFY row_number() OVER (PARTITION BY url ORDER BY abs(sentiment) DESC, event_id) = 1""")
def top1_entity_per_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known entity of an article that its sentiment is strongest about."""
    known = view(spark, sf_dir, "nodes").select(F.col("id").alias("seed"))
    rows = view(spark, sf_dir, "headlines").join(known, "seed", "left_semi")
    best = rows.groupBy("url").agg(F.min_by(F.struct("seed", "sentiment"), F.struct(-F.abs("sentiment"), "event_id")).alias("b"))
    return best.select("url", F.col("b.seed").alias("node_id"), "b.sentiment")


@query(with_views("headlines", "nodes") + """, d AS (SELECT url, min(ts)::DATE AS pub FROM headlines GROUP BY url)
SELECT event_id, pub FROM headlines JOIN d USING (url) WHERE headline IS NOT NULL AND seed IN (SELECT id FROM nodes WHERE NOT provisional)""")
def graph_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines whose entity is settled in the graph, with the first date known for their url."""
    rows = view(spark, sf_dir, "headlines")
    known = view(spark, sf_dir, "nodes").where("not provisional").select(F.col("id").alias("seed"))
    dates = rows.groupBy("url").agg(F.to_date(F.min("ts")).alias("pub"))
    return rows.where("headline is not null").join(known, "seed", "left_semi").join(dates, "url").select("event_id", "pub")


def holds_token(text: Column, token: Column) -> Column:
    """Does the text have the token with neither letter nor digit beside it? The token is taken literally."""
    literal = F.regexp_replace(token, r"([^A-Za-z0-9\s])", r"\\$1")
    return F.regexp_like(F.lower(text), F.concat(F.lit("(^|[^a-z0-9])"), F.lower(literal), F.lit("([^a-z0-9]|$)")))


@query("""WITH t AS (SELECT doc_id, lower(text) AS x, regexp_extract(text, '[a-z]{4,}') AS word, regexp_extract(text, '[0-9]{2,}') AS num FROM documents)
SELECT doc_id, word <> '' AND regexp_matches(x, '(^|[^a-z0-9])' || word[:4] || '([^a-z0-9]|$)') AS named, num <> '' AND regexp_matches(x, '(^|[^a-z0-9])' || num[:2] || '([^a-z0-9]|$)') AS counted FROM t""")
def token_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    word, num = F.regexp_extract("text", "[a-z]{4,}", 0), F.regexp_extract("text", "[0-9]{2,}", 0)
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", word.alias("word"), num.alias("num"))
    grounded = lambda c, n: (F.col(c) != "") & holds_token(F.col("text"), F.substring(c, 1, n))
    return rows.select("doc_id", grounded("word", 4).alias("named"), grounded("num", 2).alias("counted"))


@query(with_views("impacts", "edges") + """, dg AS (SELECT id, count(*) AS reach FROM (SELECT source AS id FROM edges WHERE NOT audit UNION ALL SELECT target FROM edges WHERE NOT audit) GROUP BY id)
SELECT event_id, reach FROM impacts JOIN dg ON id = node_id WHERE hop = 0 AND ts >= TIMESTAMP '2024-01-16' AND magnitude < 0.35 ORDER BY reach DESC, event_id LIMIT 25""")
def backfill_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak seeds of the last two weeks, those of the widest reach (core degree) first."""
    reach = degrees(layer(view(spark, sf_dir, "edges"))).select(F.col("id").alias("node_id"), F.col("degree").alias("reach"))
    rows = view(spark, sf_dir, "impacts").where("hop = 0 and magnitude < 0.35 and ts >= timestamp_ntz'2024-01-16'")
    return rows.join(reach, "node_id").select("event_id", "reach").orderBy(F.desc("reach"), "event_id").limit(25)


@query(with_views("impacts") + " SELECT event_id, node_id, magnitude FROM impacts WHERE direction <> 'no_effect' AND magnitude >= 0.45 ORDER BY magnitude DESC, event_id LIMIT 24")
def verify_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "impacts").where("direction <> 'no_effect' and magnitude >= 0.45")
    return rows.select("event_id", "node_id", "magnitude").orderBy(F.desc("magnitude"), "event_id").limit(24)
