"""Graph operators: derived edges, neighbourhoods, traversal, components, resolution, search and layer filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplegraph.plans.catalog import query
from ripplegraph.plans.logical import view, with_views
from ripplegraph.session import join_counted, materialize

TYPES = ["supplies", "competes_with", "regulated_by", "customer_of"]


def customer_of_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The reverse of each supplies edge between two nodes that aren't regions; derived, never stored."""
    regions = nodes.where("type = 'Region'").select(F.col("id").alias("region"))
    plain = edges.where("type = 'supplies'")
    for end in ("source", "target"):
        plain = plain.join(regions, F.col(end) == F.col("region"), "left_anti")
    return plain.select(F.concat(F.lit("customer_of:"), "id").alias("id"), F.col("target").alias("source"), F.col("source").alias("target"), F.lit("customer_of").alias("type"), "confidence", "weight", "audit", "inferred")


def layer(edges: DataFrame, core: bool = True, provisional: bool = False, inferred: bool = False) -> DataFrame:
    """Core edges, and of the audit layer the inferred and the other (provisional) ones by two switches."""
    keep = F.lit(False)
    if core:
        keep = keep | ~F.col("audit")
    if inferred:
        keep = keep | (F.col("audit") & F.col("inferred"))
    if provisional:
        keep = keep | (F.col("audit") & ~F.col("inferred"))
    return edges.where(keep)


def of_types(edges: DataFrame, types: list[str] | None) -> DataFrame:
    """Edges of the known types among those given; None means all, an empty or unknown list none."""
    return edges if types is None else edges.where(F.col("type").isin([t for t in types if t in TYPES]))


def touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, edge columns) for each edge at each node: two equi joins, not one on either end."""
    at = nodes.select(F.col("id").alias("node"))
    return edges.join(at, edges.source == at.node).unionByName(edges.where("source <> target").join(at, edges.target == at.node))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("u"), F.col("target").alias("v")).unionByName(edges.select(F.col("target").alias("u"), F.col("source").alias("v")))


def bfs(edges: DataFrame, seeds: DataFrame, hops: int, node_cap: int | None = None) -> DataFrame:
    """id, depth of what the seeds reach in at most `hops` undirected steps. A cap keeps the nearest nodes, by depth and id."""
    links = both_ways(edges).distinct()
    seen = materialize(seeds.select("id", F.lit(0).alias("depth")))
    frontier = seen
    for depth in range(1, hops + 1):
        step = links.join(frontier, links.u == frontier.id).select(F.col("v").alias("id")).distinct()
        frontier = materialize(step.join(seen, "id", "left_anti").select("id", F.lit(depth).alias("depth")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen if node_cap is None else seen.orderBy("depth", "id").limit(node_cap)


def capped_subgraph(edges: DataFrame, seeds: DataFrame, hops: int, node_cap: int) -> tuple[DataFrame, DataFrame, bool]:
    """(id, depth; the edges of every expanded node; truncated): nodes are expanded in the order in which they were met, a node's neighbours by id.

    Where the cap is reached, the node being expanded is the last one: its edges stay, also those to nodes that the cap keeps out. A level is one
    join of the frontier with the edges; at most `node_cap` nodes are ever numbered.
    """
    w = Window.orderBy("p", "id")
    seen = materialize(seeds.select("id", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("ord")))
    frontier, kept, total = seen, None, seen.count()
    for depth in range(1, hops + 1):
        at = touching(edges, frontier.select("id")).join(frontier.select(F.col("id").alias("node"), F.col("ord").alias("p")), "node")
        at = materialize(at)
        other = F.when(F.col("source") == F.col("node"), F.col("target")).otherwise(F.col("source"))
        fresh = at.select(other.alias("id"), "p").groupBy("id").agg(F.min("p").alias("p")).join(seen, "id", "left_anti")
        room = node_cap - total
        first = materialize(fresh.orderBy("p", "id").limit(room + 1))  # bounded by the cap
        over = first.orderBy(F.desc("p"), F.desc("id")).first() if first.count() > room else None
        if over is not None:
            at = at.where(F.col("p") <= over["p"])
        kept = at if kept is None else kept.unionByName(at)
        frontier = materialize(first.orderBy("p", "id").limit(room).select("id", F.lit(depth).alias("depth"), (F.row_number().over(w) + total).cast("long").alias("ord")))
        seen, total = seen.unionByName(frontier), total + min(first.count(), room)
        if over is not None or frontier.isEmpty():
            return seen.select("id", "depth"), kept.select(*edges.columns).dropDuplicates(["id"]), over is not None
    return seen.select("id", "depth"), (edges.limit(0) if kept is None else kept.select(*edges.columns).dropDuplicates(["id"])), False


def degrees(edges: DataFrame) -> DataFrame:
    """id, n_out, n_in, degree; an undirected edge counts as out on both ends."""
    ends = edges.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edges.select(F.col("target").alias("id"), (F.col("type") == "competes_with").cast("int").alias("o"), (F.col("type") != "competes_with").cast("int").alias("i"))
    )
    return ends.groupBy("id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"), F.count("*").alias("degree"))


def connected(nodes: DataFrame, edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """id, root (the least id of its component), isolated nodes included; labels jump along the root's root each round.

    The root of a large component, and a node with many neighbours, meet their rows by broadcast (join_counted).
    """
    links = materialize(both_ways(edges).where("u <> v").distinct())
    count = materialize(links.groupBy("v").agg(F.count("*").alias("n")))
    label = materialize(nodes.select("id", F.col("id").alias("root")))
    for _ in range(most_rounds):
        near = join_counted(links, label.join(count, label.id == count.v).select("v", "root", "n"), ["v"], "n").groupBy("u").agg(F.min("root").alias("m"))
        low = materialize(label.join(near, label.id == near.u, "left").select("id", "root", F.least("root", "m").alias("low")))
        # A root takes the least label that any of its members has found; members follow.
        best = materialize(low.groupBy("root").agg(F.min("low").alias("b"), F.count("*").alias("n")))
        fresh = materialize(join_counted(low, best, ["root"], "n").select("id", F.col("root").alias("old"), F.least("low", "b").alias("root")))
        if fresh.where("old <> root").isEmpty():
            return fresh.select("id", "root")
        label = fresh.select("id", "root")
    raise RuntimeError("components did not settle")


def resolve_ids(asked: DataFrame, nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """asked, node_id, how: an id, else an alias as it stands, else a normalised alias; the least id where several match."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))
    by_id = nodes.select(F.col("id").alias("i1"))
    raw = aliases.groupBy(F.col("alias").alias("a2")).agg(F.min("node_id").alias("i2"))
    soft = aliases.groupBy(norm(F.col("alias")).alias("a3")).agg(F.min("node_id").alias("i3"))
    out = asked.join(by_id, F.col("asked") == F.col("i1"), "left").join(raw, F.col("asked") == F.col("a2"), "left").join(soft, norm(F.col("asked")) == F.col("a3"), "left")
    how = F.when(F.col("i1").isNotNull(), "id").when(F.col("i2").isNotNull(), "alias").when(F.col("i3").isNotNull(), "normalised")
    return out.select("asked", F.coalesce("i1", "i2", "i3").alias("node_id"), how.alias("how"))


def match_score(alias: Column, wanted: str) -> Column:
    """100 equal, 95 prefix, 88 all tokens present, 45 contained, else null."""
    a, w = F.lower(alias), wanted.lower()
    tokens = [F.array_contains(F.split(a, r"[^a-z0-9]+"), t) for t in w.replace("#", " ").split()]
    every = tokens[0]
    for t in tokens[1:]:
        every = every & t
    return F.when(a == w, 100).when(F.startswith(a, F.lit(w)), 95).when(every, 88).when(F.contains(a, F.lit(w)), 45)


def search(aliases: DataFrame, wanted: str, limit: int, fuzzy: bool = False) -> DataFrame:
    """The best score of each node over its aliases; the top by score and id. With `fuzzy`, aliases that no rule scores count by their likeness as sets of words."""
    score = match_score(F.col("alias"), wanted)
    if fuzzy:
        from ripplegraph.operators.resolve import token_set_ratio  # that module uses this one

        like = token_set_ratio(F.lower("alias"), F.lit(wanted.lower().strip()))
        rules = aliases.select("node_id", "alias", score.alias("score"))
        aliases = rules.where("score is not null").select("node_id", "score").unionByName(rules.where("score is null").select("node_id", F.floor(like).cast("int").alias("score")))
        score = F.col("score")
    scored = aliases.select("node_id", score.alias("score")).where("score is not null")
    return scored.groupBy("node_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "node_id").limit(limit)


def dedupe(candidates: DataFrame, undirected: bool = False) -> DataFrame:
    """One edge per (source, target, type): the most confident candidate (then the least snippet) leads, the others' evidence is folded in."""
    ends = ["source", "target"]
    if undirected:
        candidates = candidates.select(F.least(*ends).alias("source"), F.greatest(*ends).alias("target"), "type", "confidence", "snippet")
    lead = F.min_by(F.struct("confidence", "snippet"), F.struct(-F.col("confidence"), "snippet"))
    out = candidates.groupBy("source", "target", "type").agg(lead.alias("lead"), F.count("*").alias("n"))
    return out.select("source", "target", "type", F.col("lead.confidence").alias("confidence"), F.col("lead.snippet").alias("snippet"), (F.col("n") - 1).alias("n_extra"))


def ring(edges: DataFrame, parents: DataFrame, visited: DataFrame, nodes: DataFrame, stranded_cap: int = 8) -> DataFrame:
    """child, parent, weight: unvisited neighbours over core edges; parents without any use all edges, their heaviest `stranded_cap` together.

    Regulators are never children; a child reached by several parents keeps the least one.
    """
    blocked = visited.select("id").unionByName(nodes.where("type = 'Regulator'").select("id")).distinct()
    ways = edges.select(F.col("source").alias("parent"), F.col("target").alias("child"), "weight", "audit").unionByName(edges.select(F.col("target").alias("parent"), F.col("source").alias("child"), "weight", "audit"))
    ways = ways.join(parents.select(F.col("id").alias("parent")), "parent").join(blocked.select(F.col("id").alias("child")), "child", "left_anti")
    core = ways.where("not audit")
    stranded = ways.where("audit").join(core.select("parent").distinct(), "parent", "left_anti").orderBy(F.desc(F.coalesce("weight", F.lit(0.0))), "child", "parent").limit(stranded_cap)
    return core.unionByName(stranded).groupBy("child").agg(F.min_by(F.struct("parent", "weight"), F.struct("parent", F.coalesce("weight", F.lit(-1.0)))).alias("p")).select("child", "p.parent", "p.weight")


@query(with_views("nodes", "edges") + """
SELECT 'customer_of:' || e.id AS id, target AS source, source AS target, 'customer_of' AS type, confidence, weight, audit, inferred FROM edges e
WHERE e.type = 'supplies' AND source NOT IN (SELECT id FROM nodes WHERE type = 'Region') AND target NOT IN (SELECT id FROM nodes WHERE type = 'Region')""")
def customer_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_of_edges(view(spark, sf_dir, "nodes"), view(spark, sf_dir, "edges"))


@query(with_views("nodes", "edges") + """
SELECT n.id AS node, count(*) AS n_edges, count(*) FILTER (NOT audit) AS n_core, count(DISTINCT CASE WHEN e.source = n.id THEN e.target ELSE e.source END) AS n_neighbours
FROM nodes n JOIN edges e ON n.id = e.source OR n.id = e.target WHERE n.type = 'Company' GROUP BY n.id""")
def node_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = touching(view(spark, sf_dir, "edges"), view(spark, sf_dir, "nodes").where("type = 'Company'"))
    other = F.when(F.col("source") == F.col("node"), F.col("target")).otherwise(F.col("source"))
    return at.groupBy("node").agg(F.count("*").alias("n_edges"), F.count_if(~F.col("audit")).alias("n_core"), F.countDistinct(other).alias("n_neighbours"))


@query(with_views("nodes", "edges") + """, e AS (SELECT * FROM edges WHERE NOT audit AND (source = 'sup-1' OR target = 'sup-1'))
SELECT n.id, n.type, n.name, n.id = 'sup-1' AS center FROM nodes n
WHERE n.id = 'sup-1' OR n.id IN (SELECT source FROM e UNION SELECT target FROM e)""")
def ego(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = view(spark, sf_dir, "nodes")
    near = touching(layer(view(spark, sf_dir, "edges")), nodes.where("id = 'sup-1'"))
    ids = near.select(F.explode(F.array("source", "target")).alias("id")).unionByName(nodes.where("id = 'sup-1'").select("id")).distinct()
    return nodes.join(ids, "id", "left_semi").select("id", "type", "name", (F.col("id") == "sup-1").alias("center"))


@query(with_views("nodes", "edges", recursive=True) + """, w AS (SELECT source u, target v FROM edges UNION SELECT target, source FROM edges),
r(id, depth) AS (SELECT 'sup-1', 0 UNION SELECT v, depth + 1 FROM r JOIN w ON u = id WHERE depth < 2)
SELECT id, min(depth) AS depth FROM r GROUP BY id""")
def bfs_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = view(spark, sf_dir, "nodes").where("id = 'sup-1'")
    return bfs(view(spark, sf_dir, "edges"), seeds, 2)


@query(with_views("edges") + """, x AS (SELECT source AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT target, CASE WHEN type = 'competes_with' THEN 1 ELSE 0 END, CASE WHEN type = 'competes_with' THEN 0 ELSE 1 END FROM edges)
SELECT id, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in, count(*) AS degree FROM x GROUP BY id""")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return degrees(view(spark, sf_dir, "edges"))


@query(with_views("edges") + """, x AS (SELECT source AS id FROM edges WHERE NOT audit UNION ALL SELECT target FROM edges WHERE NOT audit), d AS (SELECT id, count(*) AS degree FROM x GROUP BY id)
SELECT id, degree, degree / max(degree) OVER () AS centrality FROM d ORDER BY degree DESC, id LIMIT 60""")
def hubs_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = degrees(layer(view(spark, sf_dir, "edges"))).select("id", "degree")
    # The first of the order has the largest degree, so the degrees are counted once.
    top = materialize(d.orderBy(F.desc("degree"), "id").limit(60))
    most = top.agg(F.max("degree")).first()[0]
    return top.select("id", "degree", (F.col("degree") / F.lit(most)).alias("centrality"))


@query(with_views("nodes", "edges", recursive=True) + """, w AS (SELECT source u, target v FROM edges UNION SELECT target, source FROM edges),
r(id, root) AS (SELECT id, id FROM nodes UNION SELECT v, root FROM r JOIN w ON u = id AND root < v)
SELECT id, min(root) AS root FROM r GROUP BY id""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected(view(spark, sf_dir, "nodes"), view(spark, sf_dir, "edges"))


@query(with_views("edges") + """
SELECT type, count(*) AS n, count(*) FILTER (NOT audit) AS n_core, count(*) FILTER (audit) AS n_audit, count(*) FILTER (inferred) AS n_inferred, count(weight) AS n_weighted,
 min(confidence) AS low, max(confidence) AS high FROM edges GROUP BY type""")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "edges").groupBy("type").agg(F.count("*").alias("n"), F.count_if(~F.col("audit")).alias("n_core"), F.count_if("audit").alias("n_audit"), F.count_if("inferred").alias("n_inferred"), F.count("weight").alias("n_weighted"), F.min("confidence").alias("low"), F.max("confidence").alias("high"))


@query(with_views("nodes", "edges") + """
SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM nodes WHERE provisional) AS n_provisional, count(*) AS n_edges,
 count(*) FILTER (audit) AS n_audit, count(*) FILTER (type = 'customer_of') AS n_stored_derived, count(*) FILTER (source = target) AS n_loops FROM edges""")
def health_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = view(spark, sf_dir, "nodes").agg(F.count("*").alias("n_nodes"), F.count_if("provisional").alias("n_provisional"))
    e = view(spark, sf_dir, "edges").agg(F.count("*").alias("n_edges"), F.count_if("audit").alias("n_audit"), F.count_if(F.col("type") == "customer_of").alias("n_stored_derived"), F.count_if(F.col("source") == F.col("target")).alias("n_loops"))
    return n.join(F.broadcast(e))  # one row each


@query(with_views("candidates") + """
SELECT least(9, floor(confidence * 10 + 1e-9))::INT AS band, count(*) AS n FROM candidates GROUP BY 1""")
def confidence_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.least(F.lit(9), F.floor(F.col("confidence") * 10 + 1e-9)).cast("int")
    return view(spark, sf_dir, "candidates").groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@query(with_views("candidates") + """
SELECT source, target, type, confidence, snippet, n - 1 AS n_extra FROM (
 SELECT *, row_number() OVER (PARTITION BY source, target, type ORDER BY confidence DESC, snippet) AS k, count(*) OVER (PARTITION BY source, target, type) AS n FROM candidates) WHERE k = 1""")
def dedupe_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe(view(spark, sf_dir, "candidates"))


@query(with_views("candidates") + """, u AS (SELECT least(source, target) AS source, greatest(source, target) AS target, type, confidence, snippet FROM candidates)
SELECT source, target, type, confidence, snippet, n - 1 AS n_extra FROM (
 SELECT *, row_number() OVER (PARTITION BY source, target, type ORDER BY confidence DESC, snippet) AS k, count(*) OVER (PARTITION BY source, target, type) AS n FROM u) WHERE k = 1""")
def dedupe_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe(view(spark, sf_dir, "candidates"), undirected=True)


@query(with_views("candidates") + """, y AS (SELECT source, substr(snippet, length(snippet) - 9, 4) AS snippet, target FROM candidates), g AS (SELECT source, snippet, list_sort(list(DISTINCT target)) AS targets FROM y GROUP BY source, snippet)
SELECT source, snippet, len(targets)::BIGINT AS n_targets, targets[1] AS first_target FROM g WHERE len(targets) >= 3""")
def comention_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that one source names together, here in the orders of a year; three make a group."""
    year = F.substr("snippet", F.length("snippet") - 9, F.lit(4))
    g = view(spark, sf_dir, "candidates").groupBy("source", year.alias("snippet")).agg(F.array_sort(F.collect_set("target")).alias("targets"))
    return g.where(F.size("targets") >= 3).select("source", "snippet", F.size("targets").cast("long").alias("n_targets"), F.col("targets")[0].alias("first_target"))


@query(with_views("edges") + """
SELECT id, type, audit, inferred FROM edges WHERE NOT audit OR (audit AND inferred)""")
def layer_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layer(view(spark, sf_dir, "edges"), inferred=True).select("id", "type", "audit", "inferred")


@query(with_views("edges") + """ SELECT type, count(*) AS n FROM edges WHERE type IN ('supplies', 'regulated_by') GROUP BY type""")
def type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_types(view(spark, sf_dir, "edges"), ["supplies", "regulated_by", "unheard_of"]).groupBy("type").agg(F.count("*").alias("n"))


@query(with_views("nodes", "edges") + """, w AS (SELECT source u, target v FROM edges WHERE NOT audit UNION ALL SELECT target, source FROM edges WHERE NOT audit)
SELECT c.id FROM nodes c JOIN w ON u = c.id JOIN nodes o ON o.id = v WHERE c.type = 'Company' GROUP BY c.id HAVING bool_and(o.type IN ('Region', 'Regulator'))""")
def region_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = view(spark, sf_dir, "nodes")
    near = both_ways(layer(view(spark, sf_dir, "edges")))
    kinds = nodes.select(F.col("id").alias("v"), F.col("type").isin("Region", "Regulator").alias("sink"))
    return near.join(kinds, "v").join(nodes.where("type = 'Company'").select(F.col("id").alias("u")), "u").groupBy(F.col("u").alias("id")).agg(F.bool_and("sink").alias("all_sinks")).where("all_sinks").select("id")


@query(with_views("nodes", "edges") + """
SELECT e.type, least(a.sector, b.sector) AS sector_a, greatest(a.sector, b.sector) AS sector_b, count(*) AS n FROM edges e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target
WHERE a.sector <> b.sector GROUP BY ALL""")
def sector_meta_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    sector = view(spark, sf_dir, "nodes").select("id", "sector")
    e = view(spark, sf_dir, "edges").join(sector.toDF("source", "a"), "source").join(sector.toDF("target", "b"), "target").where("a <> b")
    return e.groupBy("type", F.least("a", "b").alias("sector_a"), F.greatest("a", "b").alias("sector_b")).agg(F.count("*").alias("n"))


@query(with_views("nodes", "edges") + """
SELECT source AS orphan, 'source' AS side, id AS edge_id FROM edges WHERE source NOT IN (SELECT id FROM nodes WHERE NOT provisional)
UNION ALL SELECT target, 'target', id FROM edges WHERE target NOT IN (SELECT id FROM nodes WHERE NOT provisional)""")
def referential_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, edges = view(spark, sf_dir, "nodes").where("not provisional").select(F.col("id").alias("known")), view(spark, sf_dir, "edges")
    ends = [edges.join(known, F.col(e) == F.col("known"), "left_anti").select(F.col(e).alias("orphan"), F.lit(e).alias("side"), F.col("id").alias("edge_id")) for e in ("source", "target")]
    return ends[0].unionByName(ends[1])


@query(with_views("nodes", "aliases") + """, asked AS (SELECT id AS asked FROM nodes WHERE type = 'Region' UNION ALL SELECT name FROM nodes WHERE type = 'Company' UNION ALL SELECT upper(replace(name, '#', '--')) FROM nodes WHERE id LIKE 'sup%'),
raw AS (SELECT alias, min(node_id) AS i2 FROM aliases GROUP BY alias), soft AS (SELECT trim(regexp_replace(lower(alias), '[^a-z0-9]+', ' ', 'g')) AS a3, min(node_id) AS i3 FROM aliases GROUP BY 1)
SELECT asked, coalesce(n.id, i2, i3) AS node_id, CASE WHEN n.id IS NOT NULL THEN 'id' WHEN i2 IS NOT NULL THEN 'alias' WHEN i3 IS NOT NULL THEN 'normalised' END AS how
FROM asked LEFT JOIN nodes n ON n.id = asked LEFT JOIN raw ON alias = asked LEFT JOIN soft ON a3 = trim(regexp_replace(lower(asked), '[^a-z0-9]+', ' ', 'g'))""")
def resolve_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = view(spark, sf_dir, "nodes")
    asked = nodes.where("type = 'Region'").select(F.col("id").alias("asked")).unionByName(nodes.where("type = 'Company'").select(F.col("name").alias("asked")))
    asked = asked.unionByName(nodes.where("id like 'sup%'").select(F.upper(F.replace("name", F.lit("#"), F.lit("--"))).alias("asked")))
    return resolve_ids(asked, nodes, view(spark, sf_dir, "aliases"))


@query(with_views("aliases") + """, s AS (SELECT node_id, CASE WHEN lower(alias) = 'supplier' THEN 100 WHEN starts_with(lower(alias), 'supplier') THEN 95
 WHEN list_contains(string_split_regex(lower(alias), '[^a-z0-9]+'), 'supplier') THEN 88 WHEN contains(lower(alias), 'supplier') THEN 45 END AS score FROM aliases)
SELECT node_id, max(score) AS score FROM s WHERE score IS NOT NULL GROUP BY node_id ORDER BY score DESC, node_id LIMIT 25""")
def search_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(view(spark, sf_dir, "aliases"), "supplier", 25)


@query(with_views("nodes") + """, g AS (SELECT id, CASE WHEN type <> 'Company' THEN 'ANY' WHEN sector IN ('EUROPE', 'ASIA') THEN sector ELSE 'OTHER' END AS market FROM nodes)
SELECT market, count(*) AS n FROM g GROUP BY market""")
def market_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    market = F.when(F.col("type") != "Company", "ANY").when(F.col("sector").isin("EUROPE", "ASIA"), F.col("sector")).otherwise("OTHER")
    return view(spark, sf_dir, "nodes").groupBy(market.alias("market")).agg(F.count("*").alias("n"))


@query(with_views("nodes", "edges") + """, p AS (SELECT id FROM nodes WHERE id LIKE 'sup-%' AND sector = 'ASIA'), b AS (SELECT id FROM p UNION SELECT id FROM nodes WHERE type = 'Regulator'),
w AS (SELECT source AS parent, target AS child, weight, audit FROM edges UNION ALL SELECT target, source, weight, audit FROM edges),
x AS (SELECT * FROM w WHERE parent IN (SELECT id FROM p) AND child NOT IN (SELECT id FROM b)), core AS (SELECT * FROM x WHERE NOT audit),
st AS (SELECT * FROM x WHERE audit AND parent NOT IN (SELECT parent FROM core) ORDER BY coalesce(weight, 0.0) DESC, child, parent LIMIT 8),
a AS (SELECT * FROM core UNION ALL SELECT * FROM st)
SELECT child, parent, weight FROM a QUALIFY row_number() OVER (PARTITION BY child ORDER BY parent, coalesce(weight, -1.0)) = 1""")
def ring_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = view(spark, sf_dir, "nodes")
    parents = nodes.where("id like 'sup-%' and sector = 'ASIA'")
    return ring(view(spark, sf_dir, "edges"), parents, parents, nodes)


@query(with_views("nodes", "edges") + """, p AS (SELECT least(source, target) AS x_id, greatest(source, target) AS y_id FROM edges)
SELECT DISTINCT x_id, y_id FROM p WHERE x_id IN (SELECT id FROM nodes WHERE type = 'Company') AND y_id IN (SELECT id FROM nodes WHERE type = 'Company')""")
def any_edge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    firms = view(spark, sf_dir, "nodes").where("type = 'Company'").select("id")
    p = view(spark, sf_dir, "edges").select(F.least("source", "target").alias("x_id"), F.greatest("source", "target").alias("y_id")).distinct()
    return p.join(firms.toDF("x_id"), "x_id", "left_semi").join(firms.toDF("y_id"), "y_id", "left_semi")


@query(with_views("edges") + """, l AS (
 SELECT source AS a_id, target AS b_id, 'customer' AS role, weight FROM edges WHERE type = 'supplies' UNION ALL SELECT target, source, 'supplier', weight FROM edges WHERE type = 'supplies'
 UNION ALL SELECT source, target, 'competitor', weight FROM edges WHERE type = 'competes_with' UNION ALL SELECT target, source, 'competitor', weight FROM edges WHERE type = 'competes_with')
SELECT a_id, b_id, role, max(weight) AS weight, count(*) AS n FROM l GROUP BY ALL""")
def link_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = view(spark, sf_dir, "edges").where("type in ('supplies', 'competes_with')")
    ways = F.array(
        F.struct(F.col("source").alias("a_id"), F.col("target").alias("b_id"), F.when(F.col("type") == "supplies", "customer").otherwise("competitor").alias("role")),
        F.struct(F.col("target").alias("a_id"), F.col("source").alias("b_id"), F.when(F.col("type") == "supplies", "supplier").otherwise("competitor").alias("role")),
    )
    return e.select("weight", F.inline(ways)).groupBy("a_id", "b_id", "role").agg(F.max("weight").alias("weight"), F.count("*").alias("n"))
