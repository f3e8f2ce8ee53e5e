"""News and impact operators: decayed roll-ups, deduplication, ranking, caps and table maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplegraph.plans.catalog import query
from ripplegraph.plans.logical import view, with_views
from ripplegraph.session import join_dimension, table

TODAY = "2024-01-30"
WINDOW, HALF_LIFE, HOP_WEIGHT, TOP = 7, 3.0, 0.5, 5
MIXED, FLOOR, LEAST = 0.6, 0.15, 0.05
ANSWER = ["node_id", "direction", "magnitude", "mixed_signals", "event_count", "driver_count", "direct_count", "top_events"]


def verdicts(nodes: DataFrame) -> DataFrame:
    """Direction, magnitude and mixed from the masses pos and neg of a node, for those that a vote moved."""
    nodes = nodes.withColumn("signed", F.tanh(F.col("pos") - F.col("neg")))
    low, high = F.least("pos", "neg"), F.greatest("pos", "neg")
    nodes = nodes.withColumn("mixed", (low > 0) & (F.abs("signed") > 0) & (low >= MIXED * high))
    damped = F.when(F.col("mixed"), F.abs("signed") * (1 - low / high)).otherwise(F.abs("signed"))
    nodes = nodes.withColumn("mag", damped).withColumn("mag", F.when(F.col("mixed") & (F.col("mag") > 0) & (F.col("mag") < FLOOR), FLOOR).otherwise(F.col("mag")))
    nodes = nodes.where((F.col("driver_count") > 0) & (F.col("mixed") | (F.col("mag") > LEAST)))
    direction = F.when(F.col("signed") > 0, "positive").when(F.col("signed") < 0, "negative").otherwise("no_effect")
    return nodes.withColumn("direction", direction).withColumn("magnitude", F.round("mag", 3)).withColumn("mixed_signals", F.col("mixed").cast("int"))


def in_ten_thousandths(weight: Column) -> Column:
    """What ranks a node's votes: the weight at four digits. The product is rounded, as SQL does it; round(weight, 4) rounds the decimal text, which puts halves elsewhere."""
    return F.round(weight * 10_000)


def aggregate(impacts: DataFrame, today: str = TODAY, window: int = WINDOW, multiplier: DataFrame | None = None) -> DataFrame:
    """The live verdict of each node: recency- and hop-weighted impacts, one vote per seed, day and direction.

    Votes of the same (node, seed, day, direction) count as the strongest, netted and squashed; opposing
    mass makes a verdict mixed and damps it; verdicts that no directional vote moved, or below the floor, go. A table of
    multipliers by hop and direction (a row for each class) scales the votes of the classes that it has.
    """
    day = F.to_date("ts")
    age = F.datediff(F.lit(today).cast("date"), day)
    sign = F.when(F.col("direction") == "positive", 1).when(F.col("direction") == "negative", -1).otherwise(0)
    weight = F.pow(F.lit(0.5), F.col("age") / HALF_LIFE) * F.least(F.lit(1.0), F.abs("magnitude")) * F.pow(F.lit(HOP_WEIGHT), F.col("hop"))
    rows = impacts.withColumn("day", day).withColumn("age", age).where(F.col("age").between(0, window))
    if multiplier is not None:
        m = multiplier.select(F.col("hop").alias("__hop"), F.col("direction").alias("__direction"), "multiplier")
        rows = join_dimension(rows, m, (F.col("hop") == F.col("__hop")) & (F.col("direction") == F.col("__direction")), "left")
        weight = weight * F.coalesce("multiplier", F.lit(1.0))
    rows = rows.withColumn("sign", sign).withColumn("contrib", F.when(F.col("sign") != 0, weight).otherwise(0.0))
    votes = rows.groupBy("node_id", "seed", "day", "sign").agg(
        F.count("*").alias("n"), F.max_by(F.struct("contrib", "hop", "event_id"), F.struct("contrib", -F.col("event_id"))).alias("best")
    )
    mass = lambda s: F.sum(F.when(F.col("sign") == s, F.col("best.contrib")).otherwise(0.0))
    moved = (F.col("sign") != 0) & (F.col("best.contrib") > 0)
    # A node's votes are numbered and only the first TOP collected, so a node with many is no long list.
    order = Window.partitionBy("node_id").orderBy(F.when(moved, 0).otherwise(1), F.desc(in_ten_thousandths(F.col("best.contrib"))), "best.event_id")
    votes = votes.withColumn("place", F.row_number().over(order))
    top = F.sort_array(F.collect_list(F.when(moved & (F.col("place") <= TOP), F.struct("place", F.col("best.event_id").alias("e")))))
    nodes = votes.groupBy("node_id").agg(
        mass(1).alias("pos"), mass(-1).alias("neg"), F.sum("n").alias("event_count"), F.count_if(moved).alias("driver_count"),
        F.count_if(moved & (F.col("best.hop") == 0)).alias("direct_count"), top.alias("top"),
    )
    return verdicts(nodes).withColumn("top_events", F.array_join(F.transform("top", lambda x: x["e"].cast("string")), ",")).select(*ANSWER)


@query(with_views("impacts") + """, r AS (SELECT *, CAST(ts AS DATE) AS day, date_diff('day', CAST(ts AS DATE), DATE '2024-01-30') AS age,
 CASE direction WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END AS sign FROM impacts),
c AS (SELECT *, CASE WHEN sign <> 0 THEN pow(0.5, age / 3.0) * least(1.0, abs(magnitude)) * pow(0.5, hop) ELSE 0.0 END AS contrib FROM r WHERE age BETWEEN 0 AND 7),
v AS (SELECT node_id, seed, day, sign, count(*) OVER w0 AS n, contrib, hop, event_id FROM c WINDOW w0 AS (PARTITION BY node_id, seed, day, sign)
 QUALIFY row_number() OVER (PARTITION BY node_id, seed, day, sign ORDER BY contrib DESC, event_id) = 1),
t AS (SELECT node_id, string_agg(event_id::VARCHAR, ',' ORDER BY round(contrib, 4) DESC, event_id) AS top_events FROM
 (SELECT * FROM v WHERE sign <> 0 AND contrib > 0 QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY round(contrib, 4) DESC, event_id) <= 5) GROUP BY node_id),
a AS (SELECT node_id, sum(CASE WHEN sign = 1 THEN contrib ELSE 0 END) AS pos, sum(CASE WHEN sign = -1 THEN contrib ELSE 0 END) AS neg, sum(n)::BIGINT AS event_count,
 count(*) FILTER (sign <> 0 AND contrib > 0) AS driver_count, count(*) FILTER (sign <> 0 AND contrib > 0 AND hop = 0) AS direct_count FROM v GROUP BY node_id),
s AS (SELECT *, tanh(pos - neg) AS signed, least(pos, neg) AS low, greatest(pos, neg) AS high FROM a),
m AS (SELECT *, low > 0 AND abs(signed) > 0 AND low >= 0.6 * high AS mixed FROM s),
g AS (SELECT *, CASE WHEN mixed THEN abs(signed) * (1 - low / high) ELSE abs(signed) END AS m0 FROM m),
h AS (SELECT *, CASE WHEN mixed AND m0 > 0 AND m0 < 0.15 THEN 0.15 ELSE m0 END AS mag FROM g)
SELECT node_id, CASE WHEN signed > 0 THEN 'positive' WHEN signed < 0 THEN 'negative' ELSE 'no_effect' END AS direction, round(mag, 3) AS magnitude,
 mixed::INT AS mixed_signals, event_count, driver_count, direct_count, top_events FROM h JOIN t USING (node_id) WHERE driver_count > 0 AND (mixed OR mag > 0.05)""")
def aggregate_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate(view(spark, sf_dir, "impacts"))


@query(with_views("impacts") + """
SELECT node_id, round(least(1.0, abs(p - n)), 6) AS magnitude, CASE WHEN least(p, n) > 0 AND least(p, n) >= 0.25 * greatest(p, n) THEN 1 ELSE 0 END AS mixed, hop, runs FROM (
 SELECT node_id, sum(CASE WHEN direction = 'positive' THEN round(magnitude * 10000)::BIGINT ELSE 0 END) / 10000.0 AS p,
  sum(CASE WHEN direction = 'negative' THEN round(magnitude * 10000)::BIGINT ELSE 0 END) / 10000.0 AS n, min(hop) AS hop, count(*) AS runs FROM impacts GROUP BY node_id)""")
def merge_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = F.round(F.col("magnitude") * 10000).cast("long")
    side = lambda d: F.sum(F.when(F.col("direction") == d, units).otherwise(0)) / 10000.0
    m = view(spark, sf_dir, "impacts").groupBy("node_id").agg(side("positive").alias("p"), side("negative").alias("n"), F.min("hop").alias("hop"), F.count("*").alias("runs"))
    low, high = F.least("p", "n"), F.greatest("p", "n")
    return m.select("node_id", F.round(F.least(F.lit(1.0), F.abs(F.col("p") - F.col("n"))), 6).alias("magnitude"), ((low > 0) & (low >= 0.25 * high)).cast("int").alias("mixed"), "hop", "runs")


@query(with_views("impacts") + """, c AS (SELECT node_id, direction, count(*) AS n, max(magnitude) AS magnitude FROM impacts GROUP BY ALL)
SELECT node_id, direction, n, magnitude FROM c QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY n DESC, direction) = 1""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "impacts").groupBy("node_id", "direction").agg(F.count("*").alias("n"), F.max("magnitude").alias("magnitude"))
    best = F.min_by(F.struct("direction", "n", "magnitude"), F.struct(-F.col("n"), "direction"))
    return c.groupBy("node_id").agg(best.alias("b")).select("node_id", "b.direction", "b.n", "b.magnitude")


@query("""SELECT date_trunc('hour', ts)::TIMESTAMP AS bucket, count(*) AS calls, count(DISTINCT user_id) AS users, round(sum(round(value * 100)::BIGINT) / 100.0, 2) AS cost,
 (floor((dayofyear(any_value(ts)) - 1 + 7 - (isodow(any_value(ts)) - 1)) / 7))::INT AS week FROM events GROUP BY 1""")
def usage_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    week = F.floor((F.dayofyear(F.min("ts")) - 1 + 7 - F.weekday(F.min("ts"))) / 7).cast("int")
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bucket")).agg(F.count("*").alias("calls"), F.countDistinct("user_id").alias("users"), F.round(cents / 100.0, 2).alias("cost"), week.alias("week"))


def signature(seed: Column, headline: Column, stop: tuple[str, ...] = ("the", "of", "and", "der", "die", "et", "de")) -> Column:
    """16 hex digits of the seed and the first 8 distinctive words; null with fewer than 3."""
    words = F.filter(F.split(F.lower(headline), "[^a-z0-9]+"), lambda w: (F.length(w) >= 3) & ~w.isin(*stop))
    first = F.slice(F.array_distinct(words), 1, 8)
    return F.when(F.size(first) >= 3, F.substring(F.sha1(F.concat_ws("|", seed, F.array_join(first, " "))), 1, 16))


@query("""SELECT doc_id, sha1(coalesce(source, '') || '|' || array_to_string(list_slice(w, 1, 8), ' '))[:16] AS story_sig FROM (
 SELECT doc_id, source, list_filter(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN list_position(a, a[i]) = i THEN a[i] END), lambda x: x IS NOT NULL) AS w FROM (
  SELECT doc_id, source, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ('the', 'of', 'and', 'der', 'die', 'et', 'de')) AS a FROM documents))
WHERE len(w) >= 3""")
def story_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", signature(F.coalesce("source", F.lit("")), F.col("text")).alias("story_sig")).where("story_sig is not null")


@query("""SELECT doc_id, substr(sha1(lower(trim(url))), 1, 16) AS event_id FROM (SELECT page_id AS doc_id, url FROM pages)""")
def event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.substring(F.sha1(F.lower(F.trim("url"))), 1, 16).alias("event_id"))


def story_dedupe(rows: DataFrame, key: list[str], days: int = 7) -> DataFrame:
    """Keep a row unless one with its key came within `days` before it (kept or not): a story that faded may come again."""
    w = Window.partitionBy(*key).orderBy("ts", "event_id")
    # In microseconds: whole seconds would lose a gap that is longer by a part of one.
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    return rows.withColumn("gap", gap).where(F.col("gap").isNull() | (F.col("gap") > days * 86_400_000_000)).drop("gap")


@query(with_views("impacts") + """
SELECT event_id, node_id, seed, ts FROM impacts QUALIFY lag(ts) OVER (PARTITION BY node_id, seed ORDER BY ts, event_id) IS NULL
 OR epoch(ts) - epoch(lag(ts) OVER (PARTITION BY node_id, seed ORDER BY ts, event_id)) > 7 * 86400""")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return story_dedupe(view(spark, sf_dir, "impacts"), ["node_id", "seed"]).select("event_id", "node_id", "seed", "ts")


@query(with_views("impacts") + """, d AS (SELECT node_id, count(*) AS n FROM impacts GROUP BY node_id), c AS (SELECT node_id, n / max(n) OVER () AS cen FROM d)
SELECT event_id, round(CASE category WHEN 'error' THEN 3.0 WHEN 'purchase' THEN 2.0 ELSE 1.0 END * (0.5 + 0.5 * cen) * pow(0.5, date_diff('day', CAST(ts AS DATE), DATE '2024-01-30') / 1.5), 9) AS priority
FROM impacts JOIN c USING (node_id) ORDER BY priority DESC, event_id LIMIT 25""")
def rank_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "impacts")
    d = rows.groupBy("node_id").agg(F.count("*").alias("n"))
    d = d.join(F.broadcast(d.agg(F.max("n").alias("most")))).select("node_id", (F.col("n") / F.col("most")).alias("cen"))
    source = F.when(F.col("category") == "error", 3.0).when(F.col("category") == "purchase", 2.0).otherwise(1.0)
    age = F.datediff(F.lit(TODAY).cast("date"), F.to_date("ts"))
    score = F.round(source * (0.5 + 0.5 * F.col("cen")) * F.pow(F.lit(0.5), age / 1.5), 9)
    return rows.join(d, "node_id").select("event_id", score.alias("priority")).orderBy(F.desc("priority"), "event_id").limit(25)


@query(with_views("impacts") + """
SELECT node_id, event_id, magnitude FROM impacts WHERE direction <> 'no_effect' AND magnitude > 0.1 AND hop > 0 QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY magnitude DESC, event_id) <= 5""")
def top5_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "impacts").where("direction <> 'no_effect' and magnitude > 0.1 and hop > 0")
    w = Window.partitionBy("node_id").orderBy(F.desc("magnitude"), "event_id")
    return rows.withColumn("k", F.row_number().over(w)).where("k <= 5").select("node_id", "event_id", "magnitude")


@query(with_views("impacts") + """, k AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY hop, hash_key) AS depth FROM (SELECT *, md5(event_id::VARCHAR) AS hash_key FROM impacts WHERE ts >= TIMESTAMP '2024-01-29'))
SELECT event_id, node_id, depth FROM k ORDER BY depth, node_id LIMIT 36""")
def round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "impacts").where("ts >= timestamp_ntz'2024-01-29'")
    w = Window.partitionBy("node_id").orderBy("hop", F.md5(F.col("event_id").cast("string")))
    return rows.withColumn("depth", F.row_number().over(w)).orderBy("depth", "node_id").limit(36).select("event_id", "node_id", "depth")


@query("""SELECT event_id, (props->>'k')::BIGINT AS k, CASE WHEN (props->>'k')::BIGINT % 2 = 0 THEN 'even' ELSE 'odd' END AS parity FROM events WHERE json_valid(props)""")
def known_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").where(F.get_json_object("props", "$").isNotNull()).select("event_id", k.alias("k"), F.when(k % 2 == 0, "even").otherwise("odd").alias("parity"))


@query(with_views("impacts") + """
SELECT event_id, CASE WHEN magnitude < 0.15 THEN 'low' WHEN magnitude < 0.35 THEN 'mid' WHEN magnitude < 0.6 THEN 'high' ELSE 'extreme' END AS band, least(0.9, round(0.8 - 0.2 * hop + CASE WHEN value > 50 THEN 0.15 ELSE 0 END, 6))::DOUBLE AS confidence FROM impacts""")
def magnitude_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.when(F.col("magnitude") < 0.15, "low").when(F.col("magnitude") < 0.35, "mid").when(F.col("magnitude") < 0.6, "high").otherwise("extreme")
    conf = F.least(F.lit(0.9), F.round(0.8 - 0.2 * F.col("hop") + F.when(F.col("value") > 50, 0.15).otherwise(0.0), 6))
    return view(spark, sf_dir, "impacts").select("event_id", band.alias("band"), conf.alias("confidence"))


# Table maintenance: each keyed change is a union and one aggregation, or an anti join; nothing is updated in place.


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both, the new one where a key is in both; of repeated new keys the greatest row."""
    cols = [c for c in old.columns if c not in key]
    both = old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)))
    return both.groupBy(*key).agg(F.max(F.struct("__v", *cols)).alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in cols])


def replace_groups(old: DataFrame, new: DataFrame, group: list[str]) -> DataFrame:
    """Drop the old rows of every group that the new rows have, then add those."""
    return old.join(new.select(*group).distinct(), group, "left_anti").unionByName(new)


def insert_new(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Add rows whose key is unknown; the first wins, so old rows stay."""
    return old.unionByName(new.join(old.select(*key), key, "left_anti").dropDuplicates(key))


_SPLIT = """, old AS (SELECT event_id, node_id, magnitude, ts FROM impacts WHERE event_id % 3 <> 0), new AS (SELECT event_id, node_id, round(magnitude / 2, 6) AS magnitude, ts FROM impacts WHERE event_id % 2 = 0)"""


def _old_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = view(spark, sf_dir, "impacts").select("event_id", "node_id", "magnitude", "ts")
    return rows.where("event_id % 3 <> 0"), rows.where("event_id % 2 = 0").withColumn("magnitude", F.round(F.col("magnitude") / 2, 6))


@query(with_views("impacts") + _SPLIT + " SELECT * FROM new UNION ALL SELECT * FROM old WHERE event_id NOT IN (SELECT event_id FROM new)")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert(*_old_new(spark, sf_dir), ["event_id"])


@query(with_views("impacts") + _SPLIT + " SELECT * FROM old UNION ALL SELECT * FROM new WHERE event_id NOT IN (SELECT event_id FROM old)")
def insert_ignore_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insert_new(*_old_new(spark, sf_dir), ["event_id"])


@query(with_views("impacts") + _SPLIT + " SELECT * FROM old WHERE node_id NOT IN (SELECT node_id FROM new WHERE event_id % 10 = 0) UNION ALL SELECT * FROM new WHERE event_id % 10 = 0")
def replace_event_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _old_new(spark, sf_dir)
    return replace_groups(old, new.where("event_id % 10 = 0"), ["node_id"])


@query(with_views("impacts") + """ SELECT event_id, node_id FROM impacts WHERE CAST(ts AS DATE) >= DATE '2024-01-30' - 10 AND CAST(ts AS DATE) <= DATE '2024-01-30'""")
def prune_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("ts")
    return view(spark, sf_dir, "impacts").where(day.between(F.date_sub(F.lit(TODAY).cast("date"), 10), F.lit(TODAY).cast("date"))).select("event_id", "node_id")
