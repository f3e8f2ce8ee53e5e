"""Names to nodes: the ordered chain of matches, blocked terms, tickers, and fuzzy matching over blocked candidates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ripplegraph.plans.catalog import query
from ripplegraph.plans.logical import view, with_views
from ripplegraph.session import join_dimension, materialize, table

GRAM, CONTAINS_FROM = 5, 5


def grams(text: Column, n: int = GRAM) -> Column:
    """The distinct substrings of n characters."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def held_in(asked: DataFrame, names: DataFrame) -> DataFrame:
    """(q, name) where name starts with q, or contains it (q of CONTAINS_FROM characters or more), as equi joins.

    A long q is joined on the one of its 5-grams that the fewest names hold, a short one on the names' prefixes; the
    pairs are then verified. So no pair is lost, and a common gram costs only where q has no rarer one.
    """
    long, short = asked.where(F.length("q") >= GRAM), asked.where(F.length("q") < GRAM)
    held = materialize(names.select("name", F.explode(grams(F.col("name"))).alias("g")))
    often = held.groupBy("g").agg(F.count("*").alias("n"))
    rare = long.select("q", F.explode(grams(F.col("q"))).alias("g")).join(often, "g", "left")
    # A gram that no name holds settles it: the inner join below then finds nothing.
    rare = rare.groupBy("q").agg(F.min_by("g", F.struct(F.coalesce("n", F.lit(0)), "g")).alias("g"))
    far = rare.join(held, "g").where(F.contains("name", F.col("q"))).select("q", "name")
    heads = names.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("name"), F.lit(GRAM - 1))), lambda k: F.substr("name", F.lit(1), k))).alias("q"))
    return far.unionByName(short.join(heads, "q").select("q", "name"))


def resolve_chain(asked: DataFrame, names: DataFrame, blocked: DataFrame) -> DataFrame:
    """q, node_id, how: exact name, exact alias, name prefix, alias prefix, contained; the shortest name then the least id of the first that matches.

    `names` is (name, node_id, is_alias), lower case; a q among the blocked terms stays unresolved.
    """
    q = asked.select(F.lower(F.trim("q")).alias("q")).where("q <> ''").distinct().join(blocked.select(F.col("term").alias("q")), "q", "left_anti")
    pairs = held_in(q, names.select("name").where("name <> ''").distinct()).join(names, "name")
    plain, alias = ~F.col("is_alias"), F.col("is_alias")
    exact, prefix = F.col("name") == F.col("q"), F.startswith("name", F.col("q"))
    rank = F.when(exact & plain, 1).when(exact & alias, 2).when(prefix & plain, 3).when(prefix & alias, 4).otherwise(5)
    best = pairs.withColumn("rank", rank).groupBy("q").agg(F.min(F.struct("rank", F.length("name").alias("len"), "node_id")).alias("b"))
    return best.select("q", "b.node_id", F.element_at(F.array(*[F.lit(x) for x in ("name", "alias", "name prefix", "alias prefix", "contains")]), F.col("b.rank")).alias("how"))


_NAMES = """, nm AS (SELECT lower(name) AS name, id AS node_id, false AS is_alias FROM nodes WHERE type = 'Company' UNION ALL SELECT lower(alias), node_id, true FROM aliases JOIN nodes ON id = node_id AND type = 'Company'),
aq AS (SELECT DISTINCT lower(trim(q)) AS q FROM (SELECT s_name AS q FROM supplier UNION ALL SELECT substr(s_name, 1, length(s_name) - 1) FROM supplier UNION ALL SELECT substr(s_name, 6) FROM supplier
 UNION ALL SELECT replace(s_name, '#', ' ') FROM supplier UNION ALL SELECT substr(n_name, 1, 4) FROM nation UNION ALL SELECT n_name FROM nation UNION ALL SELECT r_name FROM region)),
bl AS (SELECT lower(n_name) AS term FROM nation UNION SELECT lower(r_name) FROM region)"""


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    firms = view(spark, sf_dir, "nodes").where("type = 'Company'")
    also = view(spark, sf_dir, "aliases").join(firms.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    return firms.select(F.lower("name").alias("name"), F.col("id").alias("node_id"), F.lit(False).alias("is_alias")).unionByName(also.select(F.lower("alias").alias("name"), "node_id", F.lit(True).alias("is_alias")))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    name = F.col("s_name")
    forms = F.array(name, F.substr(name, F.lit(1), F.length(name) - 1), F.substr(name, F.lit(6)), F.replace(name, F.lit("#"), F.lit(" ")))
    return s.select(F.explode(forms).alias("q")).unionByName(n.select(F.explode(F.array(F.substr("n_name", F.lit(1), F.lit(4)), "n_name")).alias("q"))).unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("q")))


def _blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.lower("n_name").alias("term")).union(table(spark, sf_dir, "region").select(F.lower("r_name"))).distinct()


@query(with_views("nodes", "aliases") + _NAMES + """, pr AS (SELECT q, node_id, length(name) AS len, CASE WHEN name = q AND NOT is_alias THEN 1 WHEN name = q THEN 2 WHEN starts_with(name, q) AND NOT is_alias THEN 3 WHEN starts_with(name, q) THEN 4 ELSE 5 END AS rank
 FROM aq JOIN nm ON starts_with(name, q) OR (length(q) >= 5 AND contains(name, q)) WHERE q NOT IN (SELECT term FROM bl))
SELECT q, node_id, CASE rank WHEN 1 THEN 'name' WHEN 2 THEN 'alias' WHEN 3 THEN 'name prefix' WHEN 4 THEN 'alias prefix' ELSE 'contains' END AS how FROM pr QUALIFY row_number() OVER (PARTITION BY q ORDER BY rank, len, node_id) = 1""")
def entity_resolve_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_chain(_asked(spark, sf_dir), _names(spark, sf_dir), _blocked(spark, sf_dir))


@query(with_views("nodes", "aliases") + _NAMES + """ SELECT DISTINCT q FROM aq JOIN bl ON q = term OR starts_with(q, term || ' ') OR starts_with(term, q || ' ')""")
def macro_blocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked terms equal to a blocked one, or one a whole-word prefix of the other: joined on the shorter one's words."""
    heads = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, " "))), lambda k: F.array_join(F.slice(F.split(c, " "), 1, k), " "))
    q = _asked(spark, sf_dir).select(F.lower(F.trim("q")).alias("q")).distinct()
    b = _blocked(spark, sf_dir)
    down = join_dimension(q.select("q", F.explode(heads(F.col("q"))).alias("h")), b, F.col("h") == F.col("term"), "left_semi")
    up = join_dimension(q, b.select(F.explode(heads(F.col("term"))).alias("h")).distinct(), F.col("q") == F.col("h"), "left_semi")
    return down.select("q").union(up.select("q")).distinct()


@query(with_views("nodes") + " SELECT ticker, min(id) AS node_id, count(*) AS n FROM nodes WHERE ticker IS NOT NULL GROUP BY ticker")
def ticker_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "nodes").where("ticker is not null").groupBy("ticker").agg(F.min("id").alias("node_id"), F.count("*").alias("n"))


@query(with_views("nodes", "aliases") + """ SELECT lower(alias) AS key, arg_min(node_id, struct_pack(p := CASE WHEN node_id LIKE 'sup-%' THEN 0 ELSE 1 END, i := node_id)) AS node_id FROM aliases GROUP BY 1""")
def alias_priority_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct(F.when(F.startswith("node_id", F.lit("sup-")), 0).otherwise(1).alias("p"), "node_id")
    return view(spark, sf_dir, "aliases").groupBy(F.lower("alias").alias("key")).agg(F.min_by("node_id", order).alias("node_id"))


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * longest common subsequence / total length."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def _set_ratio(a: str, b: str) -> float:
    s, t = set(a.split()), set(b.split())
    if not s or not t:
        return 0.0
    both, left, right = " ".join(sorted(s & t)), " ".join(sorted(s - t)), " ".join(sorted(t - s))
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max(indel_ratio(one, two), indel_ratio(both, one) if both else 0.0, indel_ratio(both, two) if both else 0.0)


@F.pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness of two names as sets of words: 100 where one's words are all the other's."""
    return pd.Series([None if x is None or y is None else _set_ratio(x, y) for x, y in zip(a, b)])


def fuzzy_ladder(asked: DataFrame, names: DataFrame, accept: float = 90.0, review: float = 75.0, top: int = 5) -> DataFrame:
    """q, action, node_id, score: one hit of `accept` or more is taken, several or any of `review` or more go to review, else a new node is minted.

    Candidates share a word with q: the rarest of its words that any name holds, so that a word of every name, such as
    a legal form, is used only where there is no other. A name like q letter by letter with no word in common isn't found.
    """
    words = lambda c: F.explode(F.array_distinct(F.split(c, " ")))
    held = materialize(names.select("name", "node_id", words(F.col("name")).alias("w")))
    often = held.groupBy("w").agg(F.count("*").alias("n"))
    rare = asked.select("q", words(F.col("q")).alias("w")).join(often, "w").groupBy("q").agg(F.min_by("w", F.struct("n", "w")).alias("w"))
    scored = rare.join(held, "w").withColumn("score", F.round(token_set_ratio("q", "name"), 4))
    best = scored.groupBy("q", "node_id").agg(F.max("score").alias("score"))
    k = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "node_id"))
    sums = best.withColumn("k", k).where(F.col("k") <= top).groupBy("q").agg(F.count_if(F.col("score") >= accept).alias("n_high"), F.count_if(F.col("score") >= review).alias("n_near"), F.min_by(F.struct("node_id", "score"), "k").alias("b"))
    out = asked.join(sums, "q", "left")
    action = F.when(F.col("n_high") == 1, "accept").when((F.col("n_high") > 1) | (F.col("n_near") > 0), "review").otherwise("mint")
    slug = F.concat(F.lit("slug:"), F.regexp_replace("q", "[^a-z0-9]+", "-"))
    return out.select("q", action.alias("action"), F.when(action == "accept", F.col("b.node_id")).when(action == "mint", slug).alias("node_id"), F.col("b.score").alias("score"))


@query()
def fuzzy_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names, some with a word more or a letter less, against the distinct part names; no SQL for the similarity."""
    part = table(spark, sf_dir, "part")
    names = part.groupBy(F.lower("p_name").alias("name")).agg(F.concat(F.lit("com-"), F.min("p_partkey")).alias("node_id"))
    forms = F.array(F.lower("p_name"), F.concat(F.lower("p_name"), F.lit(" works")), F.concat(F.lower("p_name"), "p_brand"), F.lower("p_brand"))
    return fuzzy_ladder(part.select(F.explode(forms).alias("q")).distinct(), names)


def _partial(a: str, b: str) -> float:
    """The best likeness of the shorter text to a stretch of the longer of the same length (or less at its ends)."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0
    if a in b:
        return 100.0
    n = len(a)
    return max(indel_ratio(a, b[max(i, 0) : i + n]) for i in range(1 - n, len(b)))


@F.pandas_udf(DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_partial(x, y) for x, y in zip(a, b)], dtype=float)


@F.pandas_udf(DoubleType())
def plain_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x, y) for x, y in zip(a, b)], dtype=float)


#: Up to this length a text is looked up by its 2-grams, and up to half as much again it is found by them.
SHORT = 8


def _like(asked: DataFrame, names: DataFrame, form: Column, share: float, score) -> DataFrame:
    """(q, name, node_id, score) of pairs that share one of the rarest grams of either's form: 3-grams, for short texts 2-grams.

    A changed letter spoils three grams, and forms alike to 1 - share differ in share * length letters at about, so of one gram more than those spoil
    one is shared; common grams are not used where rare ones do. Which of the two is shorter isn't known before, so
    each side's rare grams meet all grams of the other. A test measures the recall against all pairs (no pair is lost there).
    """
    own = materialize(asked.select("q", F.col("q").alias("name")).select("q", form.alias("own")))
    named = materialize(names.select("name", "node_id", form.alias("form")))
    sides = {"q": (own, "own"), "name": (named, "form")}

    def meet(side: str, other: str) -> DataFrame:
        (rows, text), (found, its) = sides[side], sides[other]
        size = F.length(its)
        # A short text may be a piece of a long one, so what is asked is found by its 2-grams at any length.
        held = found.select("*", F.explode(F.when(F.lit(other == "q") | (size <= SHORT * 3 // 2), F.concat(grams(F.col(its), 2), grams(F.col(its), 3))).otherwise(grams(F.col(its), 3))).alias("g"))
        often = held.groupBy("g").agg(F.count("*").alias("n"))
        looked = rows.select("*", F.explode(F.when(F.length(text) <= SHORT, grams(F.col(text), 2)).otherwise(grams(F.col(text), 3))).alias("g"))
        order = Window.partitionBy(side).orderBy(F.coalesce("n", F.lit(0)), "g")
        rare = looked.join(often, "g", "left").withColumn("k", F.row_number().over(order)).where(F.col("k") <= 3 * F.ceil(2 * share * F.length(text)) + 1)
        return rare.join(held, "g").select("q", "own", "name", "node_id", "form")

    pairs = meet("q", "name").unionByName(meet("name", "q")).distinct()
    return pairs.withColumn("score", score("own", "form")).select("q", "name", "node_id", "score")


def weight_match(asked: DataFrame, names: DataFrame, partial: float = 90.0, sort: float = 80.0) -> DataFrame:
    """q, node_id, how: the equal name, else the shortest of those with the best partial likeness of `partial` or more, else the best as sorted words of `sort` or more.

    `names` is (name, node_id), lower case, a row a name; q without a match has a null node.
    """
    q = asked.select(F.lower(F.trim("q")).alias("q")).where("q <> ''").distinct()
    equal = q.join(names, q.q == names.name).select("q", "node_id", F.lit("equal").alias("how"))
    left = materialize(q.join(equal.select("q"), "q", "left_anti"))
    best = lambda rows, least, how: rows.where(F.col("score") >= least).groupBy("q").agg(F.min_by("node_id", F.struct(-F.col("score"), F.length("name"), "name")).alias("node_id")).withColumn("how", F.lit(how))
    near = materialize(best(_like(left, names, F.col("name"), 1 - partial / 100, partial_ratio), partial, "partial"))
    rest = left.join(near.select("q"), "q", "left_anti")
    in_order = F.array_join(F.array_sort(F.split("name", " +")), " ")
    turned = best(_like(rest, names, in_order, 1 - sort / 100, plain_ratio), sort, "words")
    found = equal.unionByName(near).unionByName(turned)
    return q.join(found, "q", "left")


@query()
def fuzzy_weight_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names cut, turned and misspelt against the distinct part names; no SQL for the similarity."""
    part = table(spark, sf_dir, "part")
    names = part.groupBy(F.lower("p_name").alias("name")).agg(F.concat(F.lit("com-"), F.min("p_partkey")).alias("node_id"))
    name = F.lower("p_name")
    words = F.split(name, " ")
    forms = F.array(name, F.array_join(F.reverse(words), " "), F.concat(F.lit("the "), name, F.lit(" mill")), F.regexp_replace(name, "e", "a"), F.lower("p_brand"))
    return weight_match(part.select(F.explode(forms).alias("q")).distinct(), names)
