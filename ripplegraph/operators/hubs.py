"""Betweenness over sampled pivots, and the lists that start from it or from degree."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplegraph.operators.graph import degrees, layer
from ripplegraph.plans.catalog import query
from ripplegraph.plans.logical import view, with_views
from ripplegraph.session import BROADCAST_ROWS, checkpoint_dir, remove_folder

PIVOTS, MOST_DEPTH = 500, 64
#: Pivots walked at once, and more where they cross fewer links than that together: what a walk keeps on disk is in proportion to the links, not to links times pivots.
PIVOTS_AT_ONCE, LINKS_AT_ONCE = 16, 8_000_000


def pivots(nodes: DataFrame, count: int = PIVOTS) -> DataFrame:
    """The `count` nodes first by hash of their id: a sample that reruns agree on; all nodes if there are no more."""
    return nodes.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(count)


def _store(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the write that made them ends, as what is written is read again and never computed twice."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _numbered_graph(nodes: DataFrame, edges: DataFrame, at: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(id, k: a number for each node; u, v: links both ways; leaf, at: nodes whose one neighbour has others; u, v, hung: the links without leaves, and the leaves at v)."""
    plain = edges.where("source <> target").select("source", "target")
    every = nodes.select("id").unionByName(plain.select(F.col("source").alias("id"))).unionByName(plain.select(F.col("target").alias("id"))).distinct()
    ids = _store(every.select("id", F.monotonically_increasing_id().alias("k")), f"{at}/ids")
    number = lambda end, to: ids.select(F.col("id").alias(end), F.col("k").alias(to))
    pairs = plain.join(number("source", "u"), "source").join(number("target", "v"), "target").select("u", "v")
    links = _store(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), f"{at}/links")
    degree = _store(links.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v")), f"{at}/degree")
    leaves = degree.where("n = 1").select(F.col("u").alias("leaf"), F.col("v").alias("at")).join(degree.where("n > 1").select(F.col("u").alias("at")), "at")
    leaves = _store(leaves.select("leaf", "at"), f"{at}/leaves")
    inner = links.join(leaves.select(F.col("leaf").alias("u")), "u", "left_anti").join(leaves.select(F.col("leaf").alias("v")), "v", "left_anti")
    core = inner.join(leaves.groupBy(F.col("at").alias("v")).agg(F.count("*").alias("hung")), "v", "left").select("u", "v", F.coalesce("hung", F.lit(0)).alias("hung"))
    return ids, links, leaves, _store(core, f"{at}/core")


def _next_to(rows: DataFrame, count: int, links: DataFrame, n_links: int) -> DataFrame:
    """Rows (u, ...) along the links of u. What is broadcast goes by counts: files of a few MB can hold millions of these rows."""
    if count > BROADCAST_ROWS >= n_links:
        return rows.join(F.broadcast(links), "u")
    return rows.hint("broadcast" if count <= BROADCAST_ROWS else "merge").join(links, "u")


def _walk(roots: DataFrame, links: DataFrame, n_links: int, at: str, most_depth: int) -> DataFrame:
    """id, delta: what the pivots of these roots (p, id, hung, own, below) add to each node. Rows are (p, node), a table for each level; leaves count where they hang."""
    levels = [_store(roots.select("p", "id", F.lit(1.0).alias("sigma"), "hung"), f"{at}/level-0")]
    counts = [levels[0].count()]
    for depth in range(1, most_depth + 1):
        reached = _next_to(levels[-1].select("p", F.col("id").alias("u"), "sigma"), counts[-1], links, n_links).select("p", F.col("v").alias("id"), "sigma", "hung", F.lit(False).alias("met"))
        # A node next to a level is in that level, the one before it or the next one, so two levels tell which nodes are new.
        for level in levels[-2:]:
            reached = reached.unionByName(level.withColumn("met", F.lit(True)))
        step = reached.groupBy("p", "id").agg(F.sum("sigma").alias("sigma"), F.max("hung").alias("hung"), F.max("met").alias("met"))
        level = _store(step.where(~F.col("met")).drop("met"), f"{at}/level-{depth}")
        count = level.count()
        if not count:
            break
        levels.append(level)
        counts.append(count)
    else:
        raise RuntimeError("paths are longer than most_depth")
    deltas = [levels[-1].select("p", "id", "sigma", F.col("hung").cast("double").alias("delta"))]
    for depth in range(len(levels) - 2, -1, -1):
        # Each node hands 1 + delta to those it was reached from, in proportion to their paths; what reaches a node of another level is dropped.
        share = deltas[-1].select("p", F.col("id").alias("u"), ((1 + F.col("delta")) / F.col("sigma")).alias("share"))
        share = _next_to(share, counts[depth + 1], links.select("u", "v"), n_links)
        both = share.select("p", F.col("v").alias("id"), "share").unionByName(levels[depth], allowMissingColumns=True)
        back = both.groupBy("p", "id").agg(F.max("sigma").alias("sigma"), F.max("hung").alias("hung"), F.coalesce(F.sum("share"), F.lit(0.0)).alias("back")).where("sigma is not null")
        deltas.append(_store(back.select("p", "id", "sigma", (F.col("hung") + F.col("sigma") * F.col("back")).alias("delta")), f"{at}/delta-{depth}"))
    # The root itself lies on the paths of the pivots that hang at it, to all it reaches but the pivot; its own paths don't pass it.
    by = F.broadcast(roots.select("p", "own", "below"))
    added = deltas[-1].join(by, "p").select("id", (F.col("below") * (F.col("delta") - 1)).alias("delta"))
    for delta in deltas[:-1]:
        added = added.unionByName(delta.join(by, "p").select("id", ((F.col("own") + F.col("below")) * F.col("delta")).alias("delta")))
    return added.groupBy("id").agg(F.sum("delta").alias("delta"))


def path_scores(nodes: DataFrame, edges: DataFrame, count: int = PIVOTS, most_depth: int = MOST_DEPTH, at_once: int | None = None) -> DataFrame:
    """id, betweenness: shortest paths from the pivots that pass each node, normalised to the pairs of all nodes.

    Pivots are walked so many at once, a level a round: rows are (pivot, node), paths are counted as they arrive and the
    dependencies are handed back level by level. Nothing is gathered, so no task holds the graph; a walk's tables are removed before the next.

    A leaf passes no path on: it is counted at its neighbour, and all pivots that hang at one node share the walk from there.
    """
    spark = nodes.sparkSession
    at = f"{checkpoint_dir(spark)}/paths-{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        ids, links, leaves, core = _numbered_graph(nodes, edges, f"{at}/graph")
        chosen = _store(pivots(nodes, count), f"{at}/graph/pivots")
        k, n = chosen.count(), nodes.select("id").distinct().count()
        from_ = chosen.join(ids, "id").select(F.col("k").alias("leaf")).join(links.select(F.col("u").alias("leaf")), "leaf", "left_semi").join(leaves, "leaf", "left")
        hung = leaves.groupBy(F.col("at").alias("id")).agg(F.count("*").alias("hung"))
        roots = from_.groupBy(F.coalesce("at", "leaf").alias("id")).agg(F.count_if(F.col("at").isNull()).alias("own"), F.count("at").alias("below")).join(hung, "id", "left")
        # At most `count` rows.
        p = (F.row_number().over(Window.orderBy("id")) - 1).alias("p")
        roots = _store(roots.select(p, "id", "own", "below", F.coalesce("hung", F.lit(0)).alias("hung")), f"{at}/graph/roots")
        n_links = core.count()
        at_once = at_once or max(PIVOTS_AT_ONCE, LINKS_AT_ONCE // max(n_links, 1))
        _store(ids.select(F.col("k").alias("id"), F.lit(0.0).alias("delta")), f"{at}/graph/totals/none")
        for number, first in enumerate(range(0, roots.count(), at_once)):
            some = roots.where(F.col("p").between(first, first + at_once - 1))
            _store(_walk(some, core, n_links, f"{at}/walk-{number}", most_depth), f"{at}/graph/totals/{number}")
            remove_folder(spark, f"{at}/walk-{number}")
        # Each unordered pair is met from both its ends when all nodes are pivots; (n - 1)(n - 2) ordered pairs in all.
        scale = n / k / max((n - 1) * (n - 2), 1) if k else 0.0
        total = spark.read.schema("id long, delta double").parquet(f"{at}/graph/totals/*")
        sums = total.groupBy(F.col("id").alias("k")).agg((F.sum("delta") * scale).alias("betweenness"))
        scores = _store(ids.join(sums, "k").select("id", "betweenness"), f"{at}/scores")
        remove_folder(spark, f"{at}/graph")
    return scores


@query()
def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top 60 by betweenness over core edges; tests hold it against every pair's shortest paths."""
    scores = path_scores(view(spark, sf_dir, "nodes"), layer(view(spark, sf_dir, "edges")))
    return scores.select("id", F.round("betweenness", 9).alias("betweenness")).orderBy(F.desc("betweenness"), "id").limit(60)


@query(with_views("nodes", "edges") + """, x AS (SELECT source AS id FROM edges WHERE NOT audit UNION ALL SELECT target FROM edges WHERE NOT audit), d AS (SELECT id, count(*) AS degree FROM x GROUP BY id)
SELECT n.type, d.id, degree FROM d JOIN nodes n USING (id) QUALIFY row_number() OVER (PARTITION BY n.type ORDER BY degree DESC, d.id) <= 10""")
def label_top_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = degrees(layer(view(spark, sf_dir, "edges"))).select("id", "degree").join(view(spark, sf_dir, "nodes").select("id", "type"), "id")
    return d.withColumn("k", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("degree"), "id"))).where("k <= 10").select("type", "id", "degree")


@query(with_views("nodes", "edges", "impacts") + """, x AS (SELECT source AS id FROM edges WHERE NOT audit UNION ALL SELECT target FROM edges WHERE NOT audit), d AS (SELECT id, count(*) AS reach FROM x GROUP BY id)
SELECT event_id, node_id, coalesce(reach, 0) AS reach FROM impacts LEFT JOIN d ON id = node_id WHERE hop = 0 AND magnitude BETWEEN 0.15 AND 0.6 ORDER BY coalesce(reach, 0) DESC, event_id LIMIT 25""")
def enrich_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 ambiguous seeds of widest reach."""
    d = degrees(layer(view(spark, sf_dir, "edges"))).select(F.col("id").alias("node_id"), F.col("degree").alias("reach"))
    rows = view(spark, sf_dir, "impacts").where("hop = 0 and magnitude between 0.15 and 0.6").join(d, "node_id", "left")
    return rows.select("event_id", "node_id", F.coalesce("reach", F.lit(0)).alias("reach")).orderBy(F.desc("reach"), "event_id").limit(25)


@query(with_views("nodes") + " SELECT id, type, name, coalesce(industry, type) AS category FROM nodes WHERE type IN ('Commodity', 'Region')")
def seed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "nodes").where("type in ('Commodity', 'Region')").select("id", "type", "name", F.coalesce("industry", "type").alias("category"))
