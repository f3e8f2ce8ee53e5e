"""The logical model (nodes, edges, aliases, signals, prices) as projections of the driver's tables.

Each projection is SQL that Spark and DuckDB both read; {name} stands for a table or another projection.
"""

from __future__ import annotations

import atexit
import re
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from ripplegraph.session import checkpoint_dir, table

#: Confidence from which an edge is core; the others are the audit layer.
CUTOFF = 0.75

VIEWS: dict[str, str] = {
    "nodes": """
        SELECT concat('sup-', s_suppkey) AS id, 'Company' AS type, s_name AS name, concat('T', s_suppkey % 40) AS ticker,
               n_name AS country, r_name AS sector, concat('ind-', s_suppkey % 7) AS industry, s_acctbal < 0 AS provisional
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
        UNION ALL
        SELECT concat('cus-', c_custkey), 'Company', c_name, NULL, n_name, r_name, c_mktsegment, c_acctbal < 0
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
        UNION ALL
        SELECT concat('com-', p_partkey), 'Commodity', p_name, NULL, NULL, NULL, p_type, false FROM {part}
        UNION ALL
        SELECT concat('reg-', n_nationkey), 'Region', n_name, NULL, n_name, r_name, NULL, false
        FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
        UNION ALL
        SELECT concat('rgl-', r_regionkey), 'Regulator', concat('Regulator of ', r_name), NULL, NULL, r_name, NULL, false FROM {region}""",
    "candidates": """
        SELECT concat('sup-', l_suppkey) AS source, concat('cus-', o_custkey) AS target, 'supplies' AS type,
               round(0.5 + 5 * l_discount, 4) AS confidence, cast(round(l_extendedprice * 100) AS bigint) AS cents,
               concat('order ', l_orderkey, ' on ', cast(l_shipdate AS date)) AS snippet
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' AND l_quantity >= 48
        UNION ALL
        SELECT concat('com-', l_partkey), concat('sup-', l_suppkey), 'supplies', round(0.5 + 5 * l_discount, 4),
               cast(round(l_extendedprice * 100) AS bigint), concat('order ', l_orderkey, ' on ', cast(l_shipdate AS date))
        FROM {lineitem} WHERE l_quantity = 50 AND l_returnflag = 'A'""",
    # A firm competes with the eight that follow it in size in its nation, so edges grow with the firms, not with their square.
    "peers": """
        SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS k FROM {supplier}""",
    "edges": """
        SELECT concat('supplies:', source, '>', target) AS id, source, target, 'supplies' AS type, confidence,
               cents / sum(cents) OVER (PARTITION BY source) AS weight, confidence < 0.75 AS audit, weighted % 3 = 0 AS inferred
        FROM (SELECT source, target, max(confidence) AS confidence, sum(cents) AS cents, count(*) AS weighted FROM {candidates} GROUP BY source, target) t
        UNION ALL
        SELECT concat('supplies:cus-', c_custkey, '>reg-', c_nationkey), concat('cus-', c_custkey), concat('reg-', c_nationkey), 'supplies', 0.9, NULL, false, false
        FROM {customer}
        UNION ALL
        SELECT concat('competes_with:sup-', x, '>sup-', y), concat('sup-', x), concat('sup-', y), 'competes_with', 0.7 + (x + y) % 4 * 0.1, NULL, (x + y) % 4 = 0, (x + y) % 3 = 0
        FROM (SELECT least(a.s_suppkey, b.s_suppkey) AS x, greatest(a.s_suppkey, b.s_suppkey) AS y
              FROM {peers} a CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6), (7), (8)) AS v(d) JOIN {peers} b ON a.s_nationkey = b.s_nationkey AND b.k = a.k + v.d) t
        UNION ALL
        SELECT concat('regulated_by:sup-', s_suppkey, '>rgl-', n_regionkey), concat('sup-', s_suppkey), concat('rgl-', n_regionkey), 'regulated_by', 1.0, NULL, false, false
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "aliases": """
        SELECT id AS node_id, name AS alias FROM {nodes} WHERE type IN ('Company', 'Region')
        UNION ALL SELECT id, lower(name) FROM {nodes} WHERE type = 'Company'
        UNION ALL SELECT id, replace(name, '#', ' ') FROM {nodes} WHERE type = 'Company'""",
    "impacts": """
        SELECT event_id, concat('cus-', user_id) AS node_id, concat('seed-', event_id % 11) AS seed, ts, event_type AS category,
               CASE WHEN event_type IN ('purchase', 'signup') THEN 'positive' WHEN event_type = 'error' THEN 'negative' ELSE 'no_effect' END AS direction,
               round(least(1.0, abs(value) / 100), 4) AS magnitude, cast(event_id % 3 AS int) AS hop, value
        FROM {events}""",
    "headlines": """
        SELECT event_id, ts, concat(event_type, '-', user_id % 4) AS feed, concat('cus-', user_id) AS seed, value AS sentiment,
               concat('https://example.org/', user_id, '/', event_id % 97) AS url,
               CASE event_type WHEN 'signup' THEN NULL WHEN 'purchase' THEN cast(99 AS double) ELSE value / 40 END AS prior,
               CASE event_id % 10 WHEN 0 THEN concat('Customer ', user_id, ' agrees to acquire a rival for $', event_id % 50 + 1, ' million')
                    WHEN 1 THEN concat('Should you buy customer ', user_id, ' now, before quarter ', event_id % 4, ' ends?')
                    WHEN 2 THEN concat('Customer ', user_id, ' shares rise ', event_id % 9 + 1, '% after a quiet session')
                    WHEN 3 THEN concat('Customer ', user_id, ' stock trades flat as revenue keeps growing')
                    WHEN 4 THEN concat('Customer ', user_id, ' stock holds steady after recall of ', event_id % 90, ' units')
                    WHEN 5 THEN concat('Revenue of customer ', user_id, ' rose again in region ', event_id % 5)
                    WHEN 6 THEN concat('Shipments of customer ', user_id, ' delayed at port ', event_id % 6)
                    WHEN 7 THEN concat('How to invest in customer ', user_id) WHEN 8 THEN NULL
                    ELSE concat('Customer ', user_id, ' opens for the season in town ', event_id % 3) END AS headline
        FROM {events}""",
    # The mean price of a brand's lines of a day, in standard errors and cubed: returns with heavy tails at every size of the tables.
    "daily": """
        SELECT ticker, day, 0.004 * x * x * x AS r
        FROM (SELECT p_brand AS ticker, cast(l_shipdate AS date) AS day,
                     (sum(cast(round(l_extendedprice * 100) AS bigint)) / count(*) / 100.0 - 53000) / 30000 * sqrt(count(*)) AS x
              FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY p_brand, cast(l_shipdate AS date)) t
        WHERE {weekday} < 5""",
    "prices": """
        SELECT ticker, day, t_idx, r, 100 * exp(total) AS close, 100 * exp(total - r) * (1 + r / 2) AS open,
               CASE WHEN right(ticker, 1) IN ('1', '2', '3', '4') THEN concat('sector-', right(ticker, 1)) ELSE 'market' END AS bench
        FROM (SELECT ticker, day, r, sum(r) OVER (PARTITION BY ticker ORDER BY day) AS total, row_number() OVER (PARTITION BY ticker ORDER BY day) - 1 AS t_idx FROM {daily}) t""",
    "benchmark": """
        SELECT day, 100 * exp(total) AS close, 100 * exp(total - r) * (1 + r / 2) AS open
        FROM (SELECT day, r, sum(r) OVER (ORDER BY day) AS total FROM (SELECT day, avg(r) AS r FROM {daily} GROUP BY day) m) t""",
    # A sector's index (brands by the last figure of their number), and the market's for sectors without one of their own.
    "benchmarks": """
        SELECT 'market' AS bench, day, close, open FROM {benchmark}
        UNION ALL
        SELECT bench, day, 100 * exp(total), 100 * exp(total - r) * (1 + r / 2)
        FROM (SELECT bench, day, r, sum(r) OVER (PARTITION BY bench ORDER BY day) AS total
              FROM (SELECT concat('sector-', right(ticker, 1)) AS bench, day, avg(r) AS r FROM {daily} WHERE right(ticker, 1) IN ('1', '2', '3', '4') GROUP BY right(ticker, 1), day) m) t""",
    "signals": """
        SELECT o_orderkey AS event_id, ticker, cast(o_orderdate AS date) AS pub, cast(o_orderkey % 3 AS int) AS hop,
               CASE o_orderstatus WHEN 'F' THEN 'negative' ELSE 'positive' END AS direction, round(least(1.0, o_totalprice / 400000), 4) AS magnitude
        FROM {orders} JOIN (SELECT l_orderkey, min(l_partkey) AS part FROM {lineitem} GROUP BY l_orderkey) f ON o_orderkey = l_orderkey
        JOIN (SELECT p_partkey, p_brand AS ticker FROM {part}) p ON part = p_partkey WHERE o_orderstatus <> 'P'""",
}
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


def _fill(text: str, engine: str) -> str:
    return text.replace("{weekday}", {"spark": "weekday(day)", "duckdb": "(isodow(day) - 1)"}[engine])


#: Projections that many operators read over and over. Each is written once for a session, folder and content of its tables.
STORED = ("nodes", "edges", "daily", "prices", "benchmark", "benchmarks", "signals")
#: Copies kept of a projection whose tables change: the newest, and the one before it, which a query under way may still read.
KEPT = 2
_stored: dict[tuple[str, str, str], list[tuple[tuple, str]]] = {}


def _parts(name: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", VIEWS[name])) - {"weekday"})


def _tables(name: str) -> list[str]:
    """The tables that a projection reads, through other projections too."""
    found: set[str] = set()
    todo = [name]
    while todo:
        for part in _parts(todo.pop()):
            (todo.append if part in VIEWS else found.add)(part)
    return sorted(found)


def content_state(spark: SparkSession, paths: list[str]) -> tuple:
    """Name, length and time of change of every file under the paths, so that a file rewritten inside a folder is noticed. Stores without times of folders do."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    out = []
    for at in map(path, paths):
        files = at.getFileSystem(conf).listFiles(at, True)
        while files.hasNext():
            f = files.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def clear_stored(keep: int = 0) -> None:
    """Remove the stored copies but the newest `keep` of each; also called when Python ends."""
    from pyspark import SparkContext

    jvm = SparkContext._jvm
    for key, versions in _stored.items():
        for _, path in versions[: len(versions) - keep]:
            if jvm is not None:
                at = jvm.org.apache.hadoop.fs.Path(path).getParent()
                active = SparkContext._active_spark_context
                conf = active._jsc.hadoopConfiguration() if active is not None and active._jsc is not None else jvm.org.apache.hadoop.conf.Configuration()
                at.getFileSystem(conf).delete(at, True)
        _stored[key] = versions[len(versions) - keep :] if keep else []


@atexit.register
def _clear_at_exit() -> None:
    try:
        clear_stored()
    except (Py4JError, OSError):  # the JVM has gone; its folder is left
        pass


def _project(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    parts = {p: view(spark, sf_dir, p) if p in VIEWS else table(spark, sf_dir, p) for p in _parts(name)}
    return spark.sql(_fill(VIEWS[name], "spark"), **parts)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A projection over the tables of a folder; only the columns a query uses are read."""
    if name not in STORED:
        return _project(spark, sf_dir, name)
    state = content_state(spark, [f"{sf_dir}/{t}.parquet" for t in _tables(name)])
    versions = _stored.setdefault((spark.sparkContext.applicationId, sf_dir, name), [])
    if not versions or versions[-1][0] != state:
        path = f"{checkpoint_dir(spark)}/views-{uuid.uuid4().hex}/{name}"
        _project(spark, sf_dir, name).write.parquet(path)
        versions.append((state, path))
        clear_stored(KEPT)
    return spark.read.parquet(versions[-1][1])


def with_views(*names: str, recursive: bool = False) -> str:
    """The WITH prefix of a check in SQL for the projections named and those that they use."""
    order: list[str] = []

    def add(name: str) -> None:
        for part in _parts(name):
            if part in VIEWS:
                add(part)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    bodies = [f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', _fill(VIEWS[n], 'duckdb'))})" for n in order]
    return "WITH " + "RECURSIVE " * recursive + ",\n".join(bodies)
