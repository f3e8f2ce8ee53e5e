"""Event-study and table-maintenance operators beyond the first set: controls, two-way clustering, bootstrap, weight updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplegraph.operators.market import _OUT, _OUTCOMES, _outcomes
from ripplegraph.plans.catalog import query
from ripplegraph.plans.logical import view, with_views
from ripplegraph.session import materialize, table


@query(with_views("nodes", "edges") + """, hit AS (SELECT id FROM nodes WHERE type = 'Company' AND NOT provisional)
SELECT id, source, target, type FROM edges WHERE source IN (SELECT id FROM hit) AND target IN (SELECT id FROM hit)""")
def impacted_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = view(spark, sf_dir, "nodes").where("type = 'Company' and not provisional").select(F.col("id").alias("hit"))
    edges = view(spark, sf_dir, "edges")
    return edges.join(hit, edges.source == hit.hit, "left_semi").join(hit, edges.target == hit.hit, "left_semi").select("id", "source", "target", "type")


@query(with_views("nodes", "edges") + " SELECT id, type FROM edges WHERE target NOT IN (SELECT id FROM nodes WHERE type = 'Region')")
def region_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = view(spark, sf_dir, "nodes").where("type = 'Region'").select(F.col("id").alias("target"))
    return view(spark, sf_dir, "edges").join(regions, "target", "left_anti").select("id", "type")


@query(with_views("nodes") + " SELECT sector, count(*) AS n FROM nodes WHERE type = 'Company' AND NOT provisional GROUP BY sector")
def sector_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "nodes").where("type = 'Company' and not provisional").groupBy("sector").agg(F.count("*").alias("n"))


def sync_weights(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows whose weight or tier the new file changes, null-safe, and the new rows of unknown id: id, weight, tier, action."""
    n = new.select("id", F.col("weight").alias("w1"), F.col("tier").alias("t1"))
    both = old.select("id", F.col("weight").alias("w0"), F.col("tier").alias("t0"), F.lit(True).alias("known")).join(n.withColumn("given", F.lit(True)), "id", "full").where("given")
    changed = ~(F.col("w0").eqNullSafe(F.col("w1")) & F.col("t0").eqNullSafe(F.col("t1")))
    action = F.when(F.col("known").isNull() & (F.col("t1") == "explicit"), "insert").when(F.col("known") & changed, "update")
    return both.withColumn("action", action).where("action is not null").select("id", F.col("w1").alias("weight"), F.col("t1").alias("tier"), "action")


@query(with_views("edges") + """, o AS (SELECT id, weight, CASE WHEN audit THEN 'guess' ELSE 'explicit' END AS tier FROM edges WHERE length(id) % 3 <> 0),
n AS (SELECT id, CASE WHEN length(id) % 2 = 0 THEN NULL ELSE weight END AS weight, CASE WHEN inferred THEN 'guess' ELSE 'explicit' END AS tier FROM edges)
SELECT n.id, n.weight, n.tier, CASE WHEN o.id IS NULL THEN 'insert' ELSE 'update' END AS action FROM n LEFT JOIN o ON o.id = n.id
WHERE (o.id IS NULL AND n.tier = 'explicit') OR (o.id IS NOT NULL AND (o.weight IS DISTINCT FROM n.weight OR o.tier IS DISTINCT FROM n.tier))""")
def weight_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = view(spark, sf_dir, "edges")
    tier = lambda c: F.when(F.col(c), "guess").otherwise("explicit").alias("tier")
    old = e.where("length(id) % 3 <> 0").select("id", "weight", tier("audit"))
    new = e.select("id", F.when(F.length("id") % 2 != 0, F.col("weight")).alias("weight"), tier("inferred"))
    return sync_weights(old, new)


def controls(pairs: DataFrame, firms: DataFrame, linked: DataFrame, most: int = 10, least: int = 2) -> DataFrame:
    """a_id, b_id, rank, c_id: firms of B's sector, neither A nor B nor tied to A, nearest to B in size, then in the order by size; pairs with fewer than `least` go.

    Firms are numbered by size in their sector. Of the firms nearest to B on a side only A's ties, A and B can be left out, so the
    `most` controls lie within most + ties + 2 numbers of B: a pair meets those few, not its sector.
    """
    numbered = firms.select("id", "sector", "size", F.row_number().over(Window.partitionBy("sector").orderBy("size", "id")).alias("r"))
    numbered = materialize(numbered)
    b = numbered.select(F.col("id").alias("b_id"), "sector", F.col("size").alias("size_b"), F.col("r").alias("r_b"))
    c = numbered.select(F.col("id").alias("c_id"), "sector", F.col("size").alias("size_c"), "r")
    ties = linked.select(F.col("x_id").alias("a_id"), F.col("y_id").alias("c_id")).unionByName(linked.select(F.col("y_id").alias("a_id"), F.col("x_id").alias("c_id"))).distinct()
    ties = materialize(ties.join(numbered.select(F.col("id").alias("c_id")), "c_id", "left_semi"))
    count = ties.groupBy("a_id").agg(F.count("*").alias("ties"))
    reach = (F.coalesce("ties", F.lit(0)) + most + 2).cast("int")
    near = pairs.join(b, "b_id").join(count, "a_id", "left").withColumn("r", F.explode(F.sequence(F.col("r_b") - reach, F.col("r_b") + reach)))
    met = near.join(c, ["sector", "r"]).where("c_id <> a_id and c_id <> b_id").join(ties, ["a_id", "c_id"], "left_anti")
    order = Window.partitionBy("a_id", "b_id").orderBy(F.abs(F.col("size_b") - F.col("size_c")), F.abs(F.col("r_b") - F.col("r")), "c_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.withColumn("n", F.count("*").over(Window.partitionBy("a_id", "b_id"))).where(F.col("n") >= least).select("a_id", "b_id", "rank", "c_id")


@query(with_views("edges") + """, f AS (SELECT 'sup-' || s_suppkey AS id, s_nationkey % 5 AS sector, s_acctbal AS size FROM supplier), fr AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY size, id) AS n FROM f),
p AS (SELECT source AS a_id, target AS b_id FROM edges WHERE type = 'competes_with'), t AS (SELECT source a, target c FROM edges UNION SELECT target, source FROM edges),
r AS (SELECT a_id, b_id, c.id AS c_id, row_number() OVER (PARTITION BY a_id, b_id ORDER BY abs(b.size - c.size), abs(b.n - c.n), c.id) AS rank FROM p JOIN fr b ON b.id = b_id JOIN fr c ON c.sector = b.sector
 WHERE c.id <> a_id AND c.id <> b_id AND NOT EXISTS (SELECT 1 FROM t WHERE t.a = a_id AND t.c = c.id))
SELECT a_id, b_id, rank, c_id FROM r WHERE rank <= 10 QUALIFY count(*) OVER (PARTITION BY a_id, b_id) >= 2""")
def matched_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    firms = table(spark, sf_dir, "supplier").select(F.concat(F.lit("sup-"), "s_suppkey").alias("id"), (F.col("s_nationkey") % 5).alias("sector"), F.col("s_acctbal").alias("size"))
    e = materialize(view(spark, sf_dir, "edges").select("source", "target", "type"))
    pairs = e.where("type = 'competes_with'").select(F.col("source").alias("a_id"), F.col("target").alias("b_id"))
    return controls(pairs, firms, e.select(F.col("source").alias("x_id"), F.col("target").alias("y_id")))


def period(day: Column) -> Column:
    return F.when(day < F.lit("1999-01-01").cast("date"), "exploration").when(day >= F.lit("2000-01-01").cast("date"), "holdout")


@query(with_views("signals") + " SELECT CASE WHEN pub < DATE '1999-01-01' THEN 'exploration' WHEN pub >= DATE '2000-01-01' THEN 'holdout' END AS period, count(*) AS n FROM signals GROUP BY 1")
def calendar_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "signals").groupBy(period(F.col("pub")).alias("period")).agg(F.count("*").alias("n"))


def _variance(rows: DataFrame, mean: float, *cluster: str) -> tuple[float, int]:
    """CR1 variance of a mean by clusters: one row to the driver."""
    g = rows.groupBy(*cluster).agg(F.sum(F.col("v") - mean).alias("u"), F.count("*").alias("m"))
    ss, n, count = g.agg(F.sum(F.col("u") * F.col("u")), F.sum("m"), F.count("*")).first()
    return count / (count - 1) * ss / n**2, count


@query(with_views(*_OUT) + _OUTCOMES + """, x AS (SELECT abn_ret AS v, pub AS c1, ticker AS c2 FROM o WHERE horizon = 5), m AS (SELECT avg(v) AS mean, count(*) AS n FROM x),
ga AS (SELECT sum(v - mean) AS u FROM x, m GROUP BY c1), gb AS (SELECT sum(v - mean) AS u FROM x, m GROUP BY c2), gc AS (SELECT sum(v - mean) AS u FROM x, m GROUP BY c1, c2),
s AS (SELECT (SELECT count(*) / (count(*) - 1) * sum(u * u) FROM ga) / (n * n) AS v1, (SELECT count(*) / (count(*) - 1) * sum(u * u) FROM gb) / (n * n) AS v2, (SELECT count(*) / (count(*) - 1) * sum(u * u) FROM gc) / (n * n) AS v12, mean, n FROM m)
SELECT n, round(mean, 6) AS mean, round(sqrt(CASE WHEN v1 + v2 - v12 > 0 THEN v1 + v2 - v12 ELSE greatest(v1, v2) END), 6) AS se FROM s""")
def clustered_mean_2way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1 + V2 - V12 by day and ticker, the larger of the two where that is not positive."""
    x = materialize(_outcomes(spark, sf_dir).where("horizon = 5").select(F.col("abn_ret").alias("v"), F.col("pub").alias("c1"), F.col("ticker").alias("c2")))
    mean, n = x.agg(F.avg("v"), F.count("*")).first()
    (v1, _), (v2, _), (v12, _) = _variance(x, mean, "c1"), _variance(x, mean, "c2"), _variance(x, mean, "c1", "c2")
    both = v1 + v2 - v12
    return spark.range(1).select(F.lit(n).cast("long").alias("n"), F.round(F.lit(mean), 6).alias("mean"), F.round(F.lit((both if both > 0 else max(v1, v2)) ** 0.5), 6).alias("se"))


REPS = 1000


def bootstrap_means(sums: DataFrame, reps: int = REPS) -> DataFrame:
    """rep, mean over resampled clusters (g = 0.., s, m): draws are hashes of (rep, place), so reruns agree.

    Every rep's draws are rows joined to the clusters by number; no rep is gathered in one task.
    """
    n = sums.count()
    drawn = sums.sparkSession.range(n).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    pick = F.conv(F.substring(F.md5(F.concat_ws("-", "rep", "id")), 1, 8), 16, 10).cast("long") % F.lit(max(n, 1))
    return drawn.withColumn("g", pick).join(sums, "g").groupBy("rep").agg((F.sum("s") / F.sum("m")).alias("mean"))


def bootstrap(sums: DataFrame, reps: int = REPS, alpha: float = 0.05) -> DataFrame:
    """low and high of the mean over resampled clusters."""
    ranked = bootstrap_means(sums, reps).agg(F.sort_array(F.collect_list("mean")).alias("a"))  # `reps` numbers
    at = lambda p: F.col("a")[min(int(p * reps), reps - 1)]
    return ranked.select(F.round(at(alpha / 2), 6).alias("ci_low"), F.round(at(1 - alpha / 2), 6).alias("ci_high"))


@query(with_views(*_OUT) + _OUTCOMES + f""", d AS (SELECT pub, sum(abn_ret) AS s, count(*) AS m FROM o WHERE horizon = 1 GROUP BY pub), k AS (SELECT *, row_number() OVER (ORDER BY pub) - 1 AS g FROM d),
r AS (SELECT rep, ('0x' || substr(md5(rep || '-' || id), 1, 8))::BIGINT % (SELECT count(*) FROM k) AS g FROM range({REPS}) a(rep), (SELECT g AS id FROM k)),
t AS (SELECT rep, sum(s) / sum(m) AS mean FROM r JOIN k USING (g) GROUP BY rep), l AS (SELECT list_sort(list(mean)) AS a FROM t)
SELECT round(a[{int(0.025 * REPS) + 1}], 6) AS ci_low, round(a[{min(int(0.975 * REPS), REPS - 1) + 1}], 6) AS ci_high FROM l""")
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _outcomes(spark, sf_dir).where("horizon = 1").groupBy("pub").agg(F.sum("abn_ret").alias("s"), F.count("*").alias("m"))
    # A row for each day of the calendar, so one small window.
    return bootstrap(materialize(d.withColumn("g", (F.row_number().over(Window.orderBy("pub")) - 1).cast("long"))))


@query(with_views("impacts") + """
SELECT event_id, CASE WHEN category = 'error' AND ts >= TIMESTAMP '2024-01-20' THEN 'queued' WHEN direction = 'no_effect' THEN 'dropped' ELSE 'traced' END AS status FROM impacts""")
def requeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = (F.col("category") == "error") & (F.col("ts") >= F.expr("timestamp_ntz'2024-01-20'"))
    return view(spark, sf_dir, "impacts").select("event_id", F.when(again, "queued").when(F.col("direction") == "no_effect", "dropped").otherwise("traced").alias("status"))
