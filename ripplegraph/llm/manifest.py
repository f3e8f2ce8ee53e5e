"""Operator 12: a Merkle manifest of a dataset, whose proofs are climbed by recursive queries.

Leaves are numbered by source and id, each level of the tree is stored as rows that know their parent and the digests of the other
nodes of their run, and WITH RECURSIVE walks upwards from every leaf, one stored row a step: it appends the siblings and folds the
(perhaps tampered) hash. The last levels, where all leaves have the same way, are walked once a node.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplegraph.session import checkpoint_dir, join_counted, remove_folder, shuffle_partitions, table

#: Children of a node.
FAN = 3
#: A node above more than this part of all leaves is heavy; a level has HEAVY of them at most, and they are broadcast.
HEAVY = 2_000
#: Bits of a node's id that hold its level.
LEVEL_BITS = 7


class Store:
    """Parquet tables in a folder of their own under the shared checkpoint folder."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, f"{checkpoint_dir(spark)}/manifest-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def all(self, names: list[str], schema: str) -> DataFrame:
        """Several tables as one scan."""
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{name}" for name in names])

    def drop(self, *names: str) -> None:
        for name in names:
            remove_folder(self.spark, f"{self.folder}/{name}")


def encoded(c: Column) -> Column:
    """A value as the hash takes it: - for null, else its length in UTF-8 bytes, a colon and the value."""
    text = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    """sha256 of the parts joined, as 32 bytes; digests among them are given as hex text."""
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def hex_text(c: Column) -> Column:
    return F.lower(F.hex(c))


def numbered(store: Store, df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """df with a gapless number from 0 in the given order; rows equal in it get neighbouring numbers.

    Rows are range-partitioned (with their place in the input as the last key, so that even one row repeated many times is
    dealt over tasks); a row's number is the rows of all earlier ranges plus its place in its own. Only the ranges'
    totals, one a shuffle partition, meet in one task.
    """
    keys = [*order, F.col("__at")]
    ranges = df.withColumn("__at", F.monotonically_increasing_id()).repartitionByRange(shuffle_partitions(df.sparkSession), *keys)
    ranges = store.put(ranges.withColumn("__part", F.spark_partition_id()), f"ranges-{out}")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("__part").agg(F.count("*").alias("__m")).select("__part", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*keys)) - 1
    return ranges.withColumn("__place", place).join(F.broadcast(starts), "__part").withColumn(out, F.col("__start") + F.col("__place")).drop("__at", "__part", "__place", "__start")


def node_id(tree: Column, pos: Column, level: int, top: bool) -> Column:
    """The number of a node's first leaf, and its level; in the tree of the roots these are negative."""
    at = F.shiftleft((tree + pos * FAN**level).cast("long"), LEVEL_BITS) + level
    return -1 - at if top else at


_NODES = "tree bigint, n bigint, pos bigint, id bigint, parent bigint, span bigint, left binary, right binary, up binary, up_span bigint"


def build(store: Store, leaves: DataFrame, most: int, top: bool = False) -> tuple[list[str], DataFrame]:
    """The names of a forest's levels, stored as node rows, and its roots (tree, id, hash, span).

    leaves: tree, pos (from 0 in its tree), n (leaves of the tree), id, hash, span (rows of the dataset below it); `most` is the
    largest n. A node row is id, parent, span, the digests of its run before and after it (left, right), and its parent's digest and span
    (up, up_span), from which the next level is read. A run has FAN rows at most and a level a third of the rows of the one below.
    """
    level, names = leaves, []
    while most > 1:
        k, most = len(names) + 1, -(-most // FAN)
        run = level.where("n > 1").groupBy("tree", F.expr(f"pos div {FAN}").alias("run"), "n")
        kids = run.agg(F.sort_array(F.collect_list(F.struct("pos", "id", "hash", "span"))).alias("kids"))
        texts = F.array_join(F.transform("kids", lambda c: hex_text(c["hash"])), "")
        kids = kids.select("tree", "n", "kids", node_id(F.col("tree"), F.col("run"), k, top).alias("parent"), digest(texts).alias("up"),
                           F.aggregate("kids", F.lit(0).cast("long"), lambda s, c: s + c["span"]).alias("up_span"))
        kid = F.posexplode("kids").alias("i", "kid")
        nodes = kids.select("*", kid).withColumn("texts", F.transform("kids", lambda c: hex_text(c["hash"])))
        left, right = F.slice("texts", F.lit(1), F.col("i")), F.slice("texts", F.col("i") + 2, F.lit(FAN))
        nodes = nodes.select("tree", "n", F.col("kid.pos").alias("pos"), F.col("kid.id").alias("id"), "parent", F.col("kid.span").alias("span"),
                             F.unhex(F.array_join(left, "")).alias("left"), F.unhex(F.array_join(right, "")).alias("right"), "up", "up_span")
        names.append(f"{'top' if top else 'level'}-{k}")
        nodes = store.put(nodes, names[-1])
        level = nodes.where(f"pos % {FAN} = 0").select("tree", F.expr(f"pos div {FAN}").alias("pos"), F.ceil(F.col("n") / FAN).alias("n"), F.col("parent").alias("id"), F.col("up").alias("hash"), F.col("up_span").alias("span"))
    roots = leaves.where("n = 1").select("tree", "id", "hash", "span")
    if names:
        last = store.all(names, _NODES).where(f"pos = 0 AND n <= {FAN}")
        roots = roots.unionByName(last.select("tree", F.col("parent").alias("id"), F.col("up").alias("hash"), F.col("up_span").alias("span")))
    return names, store.put(roots, "top" if top else "roots")


@contextmanager
def unlimited_recursion(spark: SparkSession):
    """Let recursive queries return as many rows as they have; depth stays limited, at 3 ** 200 leaves."""
    wanted = {"spark.sql.cteRecursionRowLimit": "-1", "spark.sql.cteRecursionLevelLimit": "200"}
    old = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: From every leaf upwards through the light nodes: a row a step, with the siblings met in it and the hash folded so far.
_CLIMB = """
WITH RECURSIVE climb(leaf, node, folded, siblings, step) AS (
  SELECT leaf, node, folded, CAST(NULL AS BINARY), 0 FROM {start}
  UNION ALL
  SELECT c.leaf, n.parent, unhex(sha2(cast(concat(lower(hex(n.left)), lower(hex(c.folded)), lower(hex(n.right))) AS binary), 256)), concat(n.left, n.right), c.step + 1
  FROM climb c JOIN {nodes} n ON c.node = n.id)
SELECT leaf, node, folded, siblings, step FROM climb"""
#: From every heavy node to the root: the siblings of each run on the way, appended.
_PATHS = """
WITH RECURSIVE paths(start, node, path, step) AS (
  SELECT id, id, CAST(array() AS array<struct<left: binary, right: binary>>), 0 FROM {nodes}
  UNION ALL
  SELECT p.start, n.parent, concat(p.path, array(named_struct('left', n.left, 'right', n.right))), p.step + 1
  FROM paths p JOIN {nodes} n ON p.node = n.id)
SELECT start, max_by(path, step) AS path FROM paths GROUP BY start"""


def climb(store: Store, start: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """leaf, folded (the hash at the root), proof (sha256 of the siblings from below, left to right, as hex text), for start: leaf, node, folded.

    A recursive query ascends from every leaf through the light nodes, each of which stands above a HEAVY-th part of the leaves at
    most, so no key of its joins is hot. All leaves meet in the heavy nodes, where their ways are the same: another one ascends once
    from each heavy node, and a leaf folds its hash through the way of the node it arrives at, which is broadcast.
    """
    spark = start.sparkSession
    heavy = F.col("span") * HEAVY > F.lit(total)
    links = nodes.select("id", "parent", "left", "right", "span")
    high = store.put(links.where(heavy).repartition(1), "heavy")  # a few thousand rows
    with unlimited_recursion(spark):
        paths = store.put(spark.sql(_PATHS, nodes=high), "paths")
        if total > HEAVY:
            steps = F.sort_array(F.collect_list(F.struct("step", "siblings")))
            here = F.array_join(F.transform(steps, lambda s: F.coalesce(hex_text(s["siblings"]), F.lit(""))), "")
            met = spark.sql(_CLIMB, start=start, nodes=links.where(~heavy)).groupBy("leaf").agg(F.max_by(F.struct("node", "folded"), "step").alias("last"), here.alias("proof"))
            met = met.select("leaf", "last.node", "last.folded", "proof")
        else:
            met = start.withColumn("proof", F.lit(""))
        met = met.join(F.broadcast(paths), F.col("node") == F.col("start"), "left")  # the root has no way to go
        root = F.aggregate(F.coalesce("path", F.array().cast(paths.schema["path"].dataType)), F.col("folded"), lambda h, s: digest(hex_text(s["left"]), hex_text(h), hex_text(s["right"])))
        rest = F.coalesce(F.array_join(F.transform("path", lambda s: F.concat(hex_text(s["left"]), hex_text(s["right"]))), ""), F.lit(""))
        return store.put(met.select("leaf", root.alias("folded"), digest(F.concat("proof", rest)).alias("proof")), "climbed")


def manifest(rows: DataFrame) -> tuple[DataFrame, str | None]:
    """doc_id, leaf, subroot, folded_root, proof_sha256 (digests as hex text) of rows doc_id, source, leaf, tampered, and the root.

    leaf and tampered are digests of 32 bytes. Leaves of a source ascend by doc_id (null first, equal ids by digest), sources by their UTF-8 bytes (null first).
    No rows give no rows and no root; one row is its own subroot and root, with an empty proof. Repeated rows are leaves of their own.
    """
    spark = rows.sparkSession
    store = Store(spark)
    nulls_first = [F.col(c).asc_nulls_first() for c in ("source", "doc_id", "leaf", "tampered")]
    rows = numbered(store, store.put(rows, "leaves"), nulls_first, "number")
    rows = rows.withColumn("source_key", encoded(F.col("source")))
    rows = store.put(rows, "numbered")
    store.drop("leaves", "ranges-number")
    sources = rows.groupBy("source", "source_key").agg(F.min("number").alias("tree"), F.count("*").alias("n"))
    sources = store.put(numbered(store, store.put(sources, "counts"), [F.col("source").asc_nulls_first()], "place"), "sources")
    most, total, count = sources.agg(F.max("n"), F.sum("n"), F.count("*")).first()
    if not total:
        return rows.select("doc_id", *[hex_text(F.col("leaf")).alias(c) for c in ("leaf", "subroot", "folded_root", "proof_sha256")]), None
    placed = join_counted(rows, sources.select("source_key", "tree", "n", F.col("n").alias("m")), ["source_key"], "m")
    placed = placed.withColumn("pos", F.col("number") - F.col("tree"))
    placed = store.put(placed.select("doc_id", "source_key", "leaf", "tampered", "tree", "pos", "n", node_id(F.col("tree"), F.col("pos"), 0, False).alias("id")), "placed")
    levels, roots = build(store, placed.select("tree", "pos", "n", "id", F.col("leaf").alias("hash"), F.lit(1).cast("long").alias("span")), most)
    under = sources.join(roots, "tree").select(F.lit(0).cast("long").alias("tree"), F.col("place").alias("pos"), F.lit(count).cast("long").alias("n"), "id", "hash", "span", "source_key", F.col("n").alias("m"))
    under = store.put(under, "subroots")
    tops, root = build(store, under.drop("source_key", "m"), count, top=True)
    root = root.select(hex_text(F.col("hash"))).first()[0]
    start = placed.select(F.col("id").alias("leaf"), F.col("id").alias("node"), F.col("tampered").alias("folded"))
    found = start.select("leaf", "folded", digest(F.lit("")).alias("proof"))
    if levels or tops:
        found = climb(store, start, store.all([*levels, *tops], _NODES), total)
    found = found.select(F.col("leaf").alias("id"), "folded", "proof")
    whole = join_counted(placed, under.select("source_key", F.col("hash").alias("subroot"), "m"), ["source_key"], "m").join(found, "id")
    return whole.select("doc_id", hex_text(F.col("leaf")).alias("leaf"), hex_text(F.col("subroot")).alias("subroot"), hex_text(F.col("folded")).alias("folded_root"), hex_text(F.col("proof")).alias("proof_sha256")), root


def document_leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf and tampered of documents; columns besides doc_id, source, lang, n_chars, text don't count. Null and empty values have digests of their own."""
    odd = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 != 0, F.lit(True))
    head = [encoded(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = digest(*head, encoded(F.col("text")))
    cut = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    same = odd | F.col("text").isNull() | (F.instr("text", "\n") == 0)
    rows = docs.select("doc_id", "source", leaf.alias("leaf"), F.when(~same, digest(*head, encoded(cut))).alias("tampered"))
    return rows.withColumn("tampered", F.coalesce("tampered", "leaf"))


def op12_merkle_recursive_climb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document. Every second document (by the hash of its id) climbs without its newlines."""
    rows, root = manifest(document_leaves(table(spark, sf_dir, "documents")))
    rows = rows.withColumn("root", F.lit(root).cast("string"))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
