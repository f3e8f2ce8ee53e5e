"""Sharding by a hierarchical weighted hash tree (region, rack, shard).

A row descends the tree. At each level every child makes a draw -ln(u) / weight, with u a hash of
the child's path and the row's key, and the least draw wins: a child wins in proportion to its weight, and
changing one child's weight moves rows only to or from that child. An added shard opens a region of
its own, so every existing subtree keeps its weights and the new shard only takes rows into itself.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.llm.ranks import gapless_rank
from ripplegraph.session import materialize, table


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(shards: int = 24, regions: int = 3, racks: int = 2) -> list[Shard]:
    """An even tree: shards are dealt over regions, then over the racks of a region."""
    return [Shard(s % regions, s // regions % racks, s) for s in range(shards)]


def grow(shards: list[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, in a region and rack of its own."""
    return [*shards, Shard(max(s.region for s in shards) + 1, 0, max(s.shard for s in shards) + 1, weight)]


def _draw(path: str, weight: float, key: Column) -> Column:
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(path), key), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    return -F.log(unit) / F.lit(float(weight))


def _least(children: list[tuple[int, str, float]], key: Column) -> Column:
    """The number of the child with the least draw; ties go to the lower number."""
    draws = [F.struct(_draw(path, weight, key).alias("d"), F.lit(n).alias("n")) for n, path, weight in children if weight > 0]
    return F.array_min(F.array(*draws))["n"]


def _branch(pick: Column, options: dict[int, Column]) -> Column:
    first, *rest = options.items()
    return reduce(lambda c, o: c.when(pick == o[0], o[1]), rest, F.when(pick == first[0], first[1]))


def place(df: DataFrame, key: Column, shards: list[Shard], out: str) -> DataFrame:
    """Add the shard number of each row's key. Weights must not be negative and not all zero."""
    if not any(s.weight > 0 for s in shards) or any(s.weight < 0 for s in shards):
        raise ValueError("weights must not be negative, and one must be positive")
    shards = [s for s in shards if s.weight > 0]

    def total(*at: int) -> float:
        return sum(s.weight for s in shards if (s.region, s.rack)[: len(at)] == at)

    regions = sorted({s.region for s in shards})
    df = df.withColumn("__region", _least([(r, f"r{r}", total(r)) for r in regions], key))
    racks = {r: sorted({s.rack for s in shards if s.region == r}) for r in regions}
    df = df.withColumn("__rack", _branch(F.col("__region"), {r: _least([(k, f"r{r}/k{k}", total(r, k)) for k in racks[r]], key) for r in regions}))
    leaf = {}
    for i, (r, k) in enumerate((r, k) for r in regions for k in racks[r]):
        leaf[i] = ((F.col("__region") == r) & (F.col("__rack") == k), _least([(s.shard, f"r{r}/k{k}/s{s.shard}", s.weight) for s in shards if (s.region, s.rack) == (r, k)], key))
    pick = reduce(lambda c, o: c.when(*o), list(leaf.values())[1:], F.when(*leaf[0]))
    return df.withColumn(out, pick.cast("int")).drop("__region", "__rack")


def shard_documents(docs: DataFrame, shards: list[Shard] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document.

    Null text: size 8 and the checksum of no bytes (0). Null doc_id: keyed as the empty string.
    Repeated rows share a shard and get a slot each. An empty table gives an empty result. Extra
    columns are not read.
    """
    shards = shards or tree()
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("__key"))
    rows = place(rows, F.col("__key"), shards, "shard")
    rows = place(rows, F.col("__key"), grow(shards), "grown_shard").drop("__key")
    rows = gapless_rank(materialize(rows), "shard", ["doc_id", "size", "text_crc32"], "slot")
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
