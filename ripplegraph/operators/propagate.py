"""Impact propagation: every event's trace through the graph at once, hop by hop, then refinement and verification.

A trace is a set of rows keyed by event, so one round of joins moves all events a hop; caps are per event.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplegraph.plans.catalog import query
from ripplegraph.plans.logical import view, with_views
from ripplegraph.session import materialize, table

HOPS, RING_CAP, STRANDED_CAP = 3, 36, 8
FRONTIER, NO_EFFECT = 0.15, 0.05
WEAK, NEAR, REFINE_CAP = 0.35, 0.20, 60
VERIFY, VERIFY_CAP = 0.45, 24

Scorer = Callable[[DataFrame], DataFrame]
TRACED = ["event_id", "id", "hop", "parent", "direction", "magnitude", "kind"]


def rule_scorer(ring: DataFrame) -> DataFrame:
    """A stand-in for a model: competitors move the other way, the weight (or one half) and 0.7 damp the parent's magnitude.

    Takes the columns parent_direction, parent_magnitude, type, weight and adds direction and magnitude; any function
    that does so can stand in its place.
    """
    flip = F.when(F.col("parent_direction") == "positive", "negative").otherwise("positive")
    raw = F.round(F.col("parent_magnitude") * F.coalesce("weight", F.lit(0.5)) * 0.7, 6)
    moved = F.when(F.col("type") == "competes_with", flip).otherwise(F.col("parent_direction"))
    return ring.withColumn("magnitude", F.when(raw < NO_EFFECT, 0.0).otherwise(raw)).withColumn("direction", F.when(raw < NO_EFFECT, "no_effect").otherwise(moved))


def _tier(kind: Column, type_: Column) -> Column:
    """Companies by supply, companies by competition, commodities and regions, the rest."""
    return F.when((kind == "Company") & (type_ == "supplies"), 0).when((kind == "Company") & (type_ == "competes_with"), 1).when(kind.isin("Commodity", "Region"), 2).otherwise(3)


def ways_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Both ways of every edge that doesn't end in a regulator: parent, child, type, weight, audit, kind (of the child), tier."""
    kinds = nodes.select(F.col("id").alias("child"), F.col("type").alias("kind"))
    cols = ["type", "weight", "audit"]
    ways = edges.select(F.col("source").alias("parent"), F.col("target").alias("child"), *cols).unionByName(edges.select(F.col("target").alias("parent"), F.col("source").alias("child"), *cols))
    return ways.join(kinds.where("kind <> 'Regulator'"), "child").withColumn("tier", _tier(F.col("kind"), F.col("type")))


def start_of(seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    """The seeds that are nodes, as the rows of hop 0."""
    start = seeds.join(nodes.select("id", F.col("type").alias("kind")), "id")
    return start.withColumn("hop", F.lit(0)).withColumn("parent", F.lit(None).cast("string")).select(*TRACED)


def next_ring(frontier: DataFrame, seen: DataFrame, ways: DataFrame, hop: int, scorer: Scorer = rule_scorer) -> DataFrame:
    """The scored rows of one hop, from the rows of the hop before and all rows so far."""
    alive = frontier.where((F.col("direction") != "no_effect") & (F.col("magnitude") >= FRONTIER) & (F.col("kind") != "Region"))
    alive = alive.select("event_id", F.col("id").alias("parent"), F.col("direction").alias("parent_direction"), F.col("magnitude").alias("parent_magnitude"))
    near = alive.join(ways, "parent").join(seen.select("event_id", F.col("id").alias("child")), ["event_id", "child"], "left_anti")
    has_core = F.max(~F.col("audit")).over(Window.partitionBy("event_id", "parent"))
    near = near.withColumn("has_core", has_core).where("not audit or not has_core")
    heavy = Window.partitionBy("event_id", "audit").orderBy(F.desc(F.coalesce("weight", F.lit(0.0))), "child", "parent", "type")
    near = near.withColumn("k", F.row_number().over(heavy)).where(~F.col("audit") | (F.col("k") <= STRANDED_CAP))
    first = F.struct("parent", "tier", -F.coalesce("weight", F.lit(-1.0)), "type")
    row = F.struct("parent", "parent_direction", "parent_magnitude", "type", "weight", "kind", "tier")
    ring = near.groupBy("event_id", "child").agg(F.min_by(row, first).alias("r")).select("event_id", "child", "r.*")
    turn = F.row_number().over(Window.partitionBy("event_id", "parent").orderBy("tier", F.md5("child")))
    place = F.row_number().over(Window.partitionBy("event_id").orderBy("turn", "parent"))
    ring = ring.withColumn("turn", turn).withColumn("place", place).where(F.col("place") <= RING_CAP)
    return scorer(ring).select("event_id", F.col("child").alias("id"), F.lit(hop).alias("hop"), "parent", "direction", "magnitude", "kind")


def propagate(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, hops: int = HOPS, scorer: Scorer = rule_scorer) -> DataFrame:
    """event_id, id, hop, parent, direction, magnitude of every node that a trace reaches.

    A ring is the unvisited neighbours, regulators excepted, over core edges; the parents that have none there use
    audit edges, the heaviest eight of an event. A child reached twice keeps its least parent. An event scores at
    most RING_CAP children a hop, taken from its parents in turn. A ring's directional children of magnitude
    FRONTIER or more, regions excepted, are the next frontier.
    """
    ways = materialize(ways_of(nodes, edges))
    seen = materialize(start_of(seeds, nodes))
    frontier = seen
    for hop in range(1, hops + 1):
        frontier = materialize(next_ring(frontier, seen, ways, hop, scorer))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.drop("kind")


def near_mass(trace: DataFrame, edges: DataFrame) -> DataFrame:
    """event_id, id, n, pos, neg: the directional neighbours of magnitude NEAR or more within the same trace."""
    both = edges.select(F.col("source").alias("id"), F.col("target").alias("near")).unionByName(edges.select(F.col("target").alias("id"), F.col("source").alias("near"))).distinct()
    strong = trace.where((F.col("direction") != "no_effect") & (F.col("magnitude") >= NEAR)).select("event_id", F.col("id").alias("near"), F.col("direction").alias("d"), F.col("magnitude").alias("m"))
    met = strong.join(both, "near").join(trace.select("event_id", "id"), ["event_id", "id"], "left_semi")
    units = F.round(F.col("m") * 1000000).cast("long")
    return met.groupBy("event_id", "id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") == "positive", units).otherwise(0)).alias("pos"), F.sum(F.when(F.col("d") == "negative", units).otherwise(0)).alias("neg"))


def refine_rows(trace: DataFrame, edges: DataFrame) -> DataFrame:
    """The weak rows (no effect, or below WEAK) with two or more strong neighbours: the REFINE_CAP best supported of an event, then id."""
    weak = trace.where((F.col("hop") > 0) & ((F.col("direction") == "no_effect") | (F.col("magnitude") < WEAK)))
    met = weak.join(near_mass(trace, edges).where("n >= 2"), ["event_id", "id"])
    w = Window.partitionBy("event_id").orderBy(F.desc("n"), "id")
    return met.withColumn("k", F.row_number().over(w)).where(F.col("k") <= REFINE_CAP).drop("k")


def apply_refinement(rows: DataFrame) -> DataFrame:
    """Take (new_direction, new_magnitude) only where it strengthens: from no effect 0.20, the same way 0.15 more, the other way 0.30."""
    none, same = F.col("direction") == "no_effect", F.col("direction") == F.col("new_direction")
    moved = F.col("new_direction") != "no_effect"
    take = moved & F.when(none, F.col("new_magnitude") >= 0.20).when(same, F.round(F.col("new_magnitude") - F.col("magnitude"), 6) >= 0.15).otherwise(F.col("new_magnitude") >= 0.30)
    # The decision is taken once, before the columns that it looks at change.
    return rows.withColumn("applied", take).withColumn("direction", F.when(F.col("applied"), F.col("new_direction")).otherwise(F.col("direction"))).withColumn("magnitude", F.when(F.col("applied"), F.col("new_magnitude")).otherwise(F.col("magnitude")))


def apply_verification(rows: DataFrame) -> DataFrame:
    """Of a verdict: refuted to nothing, weakened to a half."""
    factor = F.when(F.col("verdict") == "refuted", 0.0).when(F.col("verdict") == "weakened", 0.5).otherwise(1.0)
    return rows.withColumn("magnitude", F.round(F.col("magnitude") * factor, 6)).withColumn("direction", F.when(F.col("verdict") == "refuted", "no_effect").otherwise(F.col("direction")))


def _ring_sql(h: int) -> str:
    seen = " UNION ALL ".join(f"SELECT event_id, id FROM h{i}" for i in range(h))
    return f""", f{h} AS (SELECT event_id, id AS parent, direction AS pd, magnitude AS pm FROM h{h - 1} JOIN nodes USING (id) WHERE direction <> 'no_effect' AND magnitude >= 0.15 AND type <> 'Region'),
v{h} AS MATERIALIZED ({seen}), x{h} AS MATERIALIZED (SELECT f.*, child, w.type, weight, audit, tier FROM f{h} f JOIN ways w USING (parent) ANTI JOIN v{h} v ON v.event_id = f.event_id AND v.id = w.child),
c{h} AS MATERIALIZED (SELECT * FROM x{h} WHERE NOT audit),
s{h} AS (SELECT x.* FROM x{h} x ANTI JOIN c{h} c ON c.event_id = x.event_id AND c.parent = x.parent WHERE x.audit QUALIFY row_number() OVER (PARTITION BY x.event_id ORDER BY coalesce(x.weight, 0.0) DESC, x.child, x.parent, x.type) <= 8),
o{h} AS (SELECT * FROM (SELECT * FROM c{h} UNION ALL SELECT * FROM s{h}) QUALIFY row_number() OVER (PARTITION BY event_id, child ORDER BY parent, tier, -coalesce(weight, -1.0), type) = 1),
t{h} AS (SELECT *, row_number() OVER (PARTITION BY event_id, parent ORDER BY tier, md5(child)) AS turn FROM o{h}),
r{h} AS (SELECT *, round(pm * coalesce(weight, 0.5) * 0.7, 6) AS raw FROM t{h} QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY turn, parent) <= 36),
h{h} AS MATERIALIZED (SELECT event_id, child AS id, {h} AS hop, parent, CASE WHEN raw < 0.05 THEN 'no_effect' WHEN type <> 'competes_with' THEN pd WHEN pd = 'positive' THEN 'negative' ELSE 'positive' END AS direction,
 CASE WHEN raw < 0.05 THEN 0.0 ELSE raw END AS magnitude FROM r{h})"""


_TRACE = (
    with_views("nodes", "edges", "impacts")
    + """, ways AS MATERIALIZED (SELECT w.*, CASE WHEN n.type = 'Company' AND w.type = 'supplies' THEN 0 WHEN n.type = 'Company' AND w.type = 'competes_with' THEN 1 WHEN n.type IN ('Commodity', 'Region') THEN 2 ELSE 3 END AS tier
 FROM (SELECT source AS parent, target AS child, type, weight, audit FROM edges UNION ALL SELECT target, source, type, weight, audit FROM edges) w JOIN nodes n ON n.id = child WHERE n.type <> 'Regulator'),
h0 AS MATERIALIZED (SELECT event_id, id, 0 AS hop, NULL::VARCHAR AS parent, direction, magnitude FROM impacts JOIN nodes ON id = node_id WHERE hop = 0 AND direction <> 'no_effect')"""
    + "".join(_ring_sql(h) for h in (1, 2, 3))
    + ", trace AS MATERIALIZED (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3)"
)
_NEAR = """, b AS (SELECT source AS id, target AS near FROM edges UNION SELECT target, source FROM edges),
m AS (SELECT s.event_id, b.id, count(*) AS n, sum(CASE WHEN s.direction = 'positive' THEN round(s.magnitude * 1000000)::BIGINT ELSE 0 END)::BIGINT AS pos,
 sum(CASE WHEN s.direction = 'negative' THEN round(s.magnitude * 1000000)::BIGINT ELSE 0 END)::BIGINT AS neg
 FROM trace s JOIN b ON b.near = s.id WHERE s.direction <> 'no_effect' AND s.magnitude >= 0.2 GROUP BY ALL),
e AS (SELECT t.event_id, t.id, t.direction, t.magnitude, n, pos, neg FROM trace t JOIN m USING (event_id, id) WHERE hop > 0 AND n >= 2 AND (direction = 'no_effect' OR magnitude < 0.35)
 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY n DESC, id) <= 60)"""


def _trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = view(spark, sf_dir, "impacts").where("hop = 0 and direction <> 'no_effect'").select("event_id", F.col("node_id").alias("id"), "direction", "magnitude")
    return propagate(seeds, view(spark, sf_dir, "nodes"), view(spark, sf_dir, "edges"))


@query(_TRACE + " SELECT event_id, id, hop, parent, direction, magnitude FROM trace")
def run_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trace(spark, sf_dir)


#: News about several firms of a nation at once: every other one by its key, so that those between have strong neighbours.
_SECTOR_NEWS = _TRACE.replace(
    "FROM impacts JOIN nodes ON id = node_id WHERE hop = 0 AND direction <> 'no_effect')",
    "FROM (SELECT s_nationkey::BIGINT AS event_id, 'sup-' || s_suppkey AS id, CASE WHEN s_nationkey % 2 = 0 THEN 'positive' ELSE 'negative' END AS direction, 0.9::DOUBLE AS magnitude FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) % 2 = 1))",
)


def sector_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    firms = table(spark, sf_dir, "supplier").withColumn("k", k).where("k % 2 = 1")
    way = F.when(F.col("s_nationkey") % 2 == 0, "positive").otherwise("negative")
    return firms.select(F.col("s_nationkey").cast("long").alias("event_id"), F.concat(F.lit("sup-"), "s_suppkey").alias("id"), way.alias("direction"), F.lit(0.9).alias("magnitude"))


def _sector_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return propagate(sector_seeds(spark, sf_dir), view(spark, sf_dir, "nodes"), view(spark, sf_dir, "edges"))


@query(_SECTOR_NEWS + _NEAR + " SELECT event_id, id, n FROM e")
def refine_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refine_rows(_sector_trace(spark, sf_dir), view(spark, sf_dir, "edges")).select("event_id", "id", "n")


_REFINED = """, p AS (SELECT *, CASE WHEN pos > neg THEN 'positive' WHEN neg > pos THEN 'negative' ELSE 'no_effect' END AS nd, round(least(1.0, abs(pos - neg) / 1000000.0) * 0.5, 6) AS nm FROM e),
q AS (SELECT *, nd <> 'no_effect' AND CASE WHEN direction = 'no_effect' THEN nm >= 0.2 WHEN direction = nd THEN round(nm - magnitude, 6) >= 0.15 ELSE nm >= 0.3 END AS applied FROM p),
refined AS MATERIALIZED (SELECT event_id, id, applied, CASE WHEN applied THEN nd ELSE direction END AS direction, CASE WHEN applied THEN nm ELSE magnitude END AS magnitude FROM q)"""


def refine(trace: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows looked at again, with `applied`; the stand-in scorer gives half the net mass of the neighbours."""
    rows = refine_rows(trace, edges)
    way = F.when(F.col("pos") > F.col("neg"), "positive").when(F.col("neg") > F.col("pos"), "negative").otherwise("no_effect")
    size = F.round(F.least(F.lit(1.0), F.abs(F.col("pos") - F.col("neg")) / 1000000.0) * 0.5, 6)
    return apply_refinement(rows.withColumn("new_direction", way).withColumn("new_magnitude", size))


@query(_SECTOR_NEWS + _NEAR + _REFINED + " SELECT * FROM refined")
def refine_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in scorer: half the net mass of the neighbours."""
    return refine(_sector_trace(spark, sf_dir), view(spark, sf_dir, "edges")).select("event_id", "id", "applied", "direction", "magnitude")


_VERDICT = "CASE WHEN {high} < 0.7 THEN 'refuted' WHEN {high} < 0.85 THEN 'weakened' ELSE 'confirmed' END"
_VERIFIED = """, c AS (SELECT least(source, target) AS x, greatest(source, target) AS y, max(confidence) AS high FROM edges GROUP BY ALL),
k AS (SELECT t.*, coalesce(high, 1.0) AS high FROM {trace} t LEFT JOIN c ON x = least(id, parent) AND y = greatest(id, parent) WHERE direction <> 'no_effect' AND magnitude >= 0.45
 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY magnitude DESC, id) <= 24), w AS (SELECT *, """ + _VERDICT.format(high="high") + """ AS verdict FROM k),
verified AS MATERIALIZED (SELECT event_id, id, verdict, CASE WHEN verdict = 'refuted' THEN 'no_effect' ELSE direction END AS direction, round(magnitude * CASE verdict WHEN 'refuted' THEN 0.0 WHEN 'weakened' THEN 0.5 ELSE 1.0 END, 6) AS magnitude FROM w)"""


#: The checks of traces, refinement and verification, for other modules.
SECTOR_SQL, VERIFIED_SQL = _SECTOR_NEWS + _NEAR + _REFINED, _VERIFIED


def verify(trace: DataFrame, edges: DataFrame) -> DataFrame:
    """The VERIFY_CAP strongest directional rows of an event, with `verdict`; the stand-in judge goes by the confidence of the edge to the parent."""
    t = trace.where((F.col("direction") != "no_effect") & (F.col("magnitude") >= VERIFY))
    w = Window.partitionBy("event_id").orderBy(F.desc("magnitude"), "id")
    t = t.withColumn("k", F.row_number().over(w)).where(F.col("k") <= VERIFY_CAP)
    c = edges.groupBy(F.least("source", "target").alias("x"), F.greatest("source", "target").alias("y")).agg(F.max("confidence").alias("high"))
    # A seed has no parent; least() would skip the null.
    ends = F.col("parent").isNotNull() & (F.col("x") == F.least("id", "parent")) & (F.col("y") == F.greatest("id", "parent"))
    return apply_verification(t.join(c, ends, "left").withColumn("verdict", F.expr(_VERDICT.format(high="coalesce(high, 1.0)"))))


@query(_TRACE + _VERIFIED.format(trace="trace") + " SELECT * FROM verified")
def verify_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify(_trace(spark, sf_dir), view(spark, sf_dir, "edges")).select("event_id", "id", "verdict", "direction", "magnitude")


@query(_TRACE + """, g AS (SELECT event_id, count(*) AS n_scored, count(*) FILTER (direction <> 'no_effect') AS n_directional, count(*) FILTER (hop >= 1 AND direction <> 'no_effect') AS n_moved, max(hop)::INT AS hops FROM trace GROUP BY event_id)
SELECT *, CASE WHEN n_moved > 0 THEN 'traced' ELSE 'failed' END AS status FROM g""")
def scoring_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace is accepted with a seed and at least one directional row beyond it."""
    moved = F.col("direction") != "no_effect"
    g = _trace(spark, sf_dir).groupBy("event_id").agg(F.count("*").alias("n_scored"), F.count_if(moved).alias("n_directional"), F.count_if(moved & (F.col("hop") >= 1)).alias("n_moved"), F.max("hop").alias("hops"))
    return g.withColumn("status", F.when(F.col("n_moved") > 0, "traced").otherwise("failed"))


@query(_TRACE + """, d AS (SELECT event_id, id FROM trace WHERE direction <> 'no_effect')
SELECT a.event_id, e.id AS edge_id FROM edges e JOIN d a ON a.id = e.source JOIN d b ON b.id = e.target AND b.event_id = a.event_id""")
def impact_chain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges whose two ends both fired, by event."""
    d = _trace(spark, sf_dir).where("direction <> 'no_effect'").select("event_id", "id")
    e = view(spark, sf_dir, "edges").select(F.col("id").alias("edge_id"), "source", "target")
    at = e.join(d.withColumnRenamed("id", "source"), "source")
    return at.join(d.withColumnRenamed("id", "target"), ["event_id", "target"], "left_semi").select("event_id", "edge_id")
