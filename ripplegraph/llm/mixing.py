"""Mixing sources to target weights by balanced (cube method) sampling.

Every document of a source should be taken target / source size times on average. The whole part is
taken outright; the fraction is an inclusion probability, and the cube method (Deville and Tille,
2004; fast flight of Chauvet and Tille, 2006) rounds all fractions to 0 or 1 while keeping two totals,
documents and words, exact: it walks in the null space of those constraints until at most two
fractions of a block are left. Blocks are hashed parts of a source of bounded size, so a hot
source is spread over many tasks; what the blocks leave is pooled into new blocks, and the last one
or two documents of a source are landed on the choice nearest to its word total.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplegraph.llm.ranks import copies
from ripplegraph.session import join_dimension, materialize, table

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a block of the flight.
BLOCK = 4096
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
_TINY = 1e-9


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, documents -> with target: water-filling of share * total by weight, each at most `most` times its size.

    Targets are min(most * size, level * weight). With sources sorted by most * size / weight, the
    level is found from running sums: the first source at which the level, were all before it capped,
    does not exceed its own ratio. One row per source, so the unpartitioned windows are small.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int"))
    sizes = sizes.withColumn("__w", weight).withColumn("__cap", F.lit(most) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last())
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    rest = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    open_weight = F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))
    sizes = sizes.withColumn("__level", rest / open_weight)
    level = F.min(F.when(F.col("__level") <= F.col("__cap") / F.col("__w"), F.struct(F.col("__cap") / F.col("__w"), F.col("__level").alias("level")))).over(everything)["level"]
    target = F.least(F.col("__cap"), F.coalesce(level * F.col("__w"), F.col("__cap"))).cast("double")
    return sizes.withColumn("target", target).drop("__w", "__cap", "__level")


def flight(p: list[float], size: list[float], rng: random.Random) -> list[float]:
    """Round fractions to 0 or 1 with their sum and their size-weighted sum unchanged; at most two stay open."""
    p = list(p)
    active, following, n = [], 0, len(p)
    while True:
        active = [i for i in active if _TINY < p[i] < 1 - _TINY]
        while len(active) < 3 and following < n:
            if _TINY < p[following] < 1 - _TINY:
                active.append(following)
            following += 1
        if len(active) == 3:
            a, b, c = active
            u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
            if u == (0, 0, 0):
                u = (1.0, -1.0, 0.0)
        elif len(active) == 2 and size[active[0]] == size[active[1]]:
            u = (1.0, -1.0)
        else:
            return p
        up = min(((1 - p[i]) / v if v > 0 else p[i] / -v) for i, v in zip(active, u) if v)
        down = min((p[i] / v if v > 0 else (1 - p[i]) / -v) for i, v in zip(active, u) if v)
        step = up if rng.random() * (up + down) < down else -down
        for i, v in zip(active, u):
            x = p[i] + step * v
            p[i] = 0.0 if x < _TINY else 1.0 if x > 1 - _TINY else x


def landing(p: list[float], size: list[float]) -> list[float]:
    """Close the last open fractions (two at most) by the choice whose words come nearest to what they stood for."""
    left = [i for i, x in enumerate(p) if 0 < x < 1]
    due = sum(p[i] * size[i] for i in left)
    best = min(range(1 << len(left)), key=lambda m: (abs(sum(size[i] for k, i in enumerate(left) if m >> k & 1) - due), m))
    p = list(p)
    for k, i in enumerate(left):
        p[i] = float(best >> k & 1)
    return p


def _settle_block(pdf: pd.DataFrame, last: bool, seed: int, turn: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["size", "__h", "__h2", "__copy"], ascending=[False, True, True, True], kind="stable")
    source = pdf["source"].iloc[0]
    rng = random.Random(f"{seed}/{turn}/{source!r}/{pdf['__block'].iloc[0]}")
    size = pdf["size"].astype(float).tolist()
    p = flight(pdf["__p"].tolist(), size, rng)
    return pdf.assign(__p=landing(p, size) if last else p)


def _settler(last: bool, seed: int, turn: int):
    return lambda pdf: _settle_block(pdf, last, seed, turn).drop(columns=["__block", "__parts"])


def row_hash(docs: DataFrame, columns: list[str]) -> list[Column]:
    """128 bits over the columns of a row (__h, __h2), nulls told apart from empty values and from their neighbours."""
    nulls = F.concat(*[F.isnull(c).cast("int").cast("string") for c in columns])
    return [F.xxhash64(nulls, *columns).alias("__h"), F.xxhash64(F.lit(1), nulls, *columns).alias("__h2")]


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 17, key: list[str] | None = None) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken, __h and __h2 (a hash of the `key` columns) for every row of docs.

    Null source: a source of its own, last in order. Null or wordless text: size 0, never taken.
    Rows that agree in the key (doc_id, source and text) are drawn each for itself, told apart by their number. Equal sizes: any
    pair of them keeps both totals, and ties in order fall to the hash, so reruns agree. An empty table gives an empty result; extra
    columns are not read.
    """
    key = key or ["doc_id", "source", "text"]
    # Ids travel as text: pandas would turn integers beside nulls into floats.
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "source", word_count().alias("size"), *row_hash(docs, key))
    rows = materialize(copies(rows, "__copy"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("__docs"))
    targets = materialize(source_targets(sizes, weights, share, most))
    dim = targets.select(F.col("source").alias("__s"), "source_size", "target", "__docs")
    rows = join_dimension(rows, dim, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    # A third of a corpus in one source is many blocks; one row for each source says how many.
    times = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("__times", times).withColumn("__whole", F.floor(F.col("__times") + _TINY).cast("long"))
    fraction = F.greatest(F.col("__times") - F.col("__whole"), F.lit(0.0))
    rows = rows.withColumn("__p", F.when(fraction < _TINY, 0.0).otherwise(fraction))
    rows = rows.withColumn("__parts", F.greatest(F.ceil(F.col("__docs") / BLOCK), F.lit(1)))
    open_rows = rows.where(F.col("__p") > 0).select("doc_id", "source", "size", "__h", "__h2", "__copy", "source_size", "target", "__whole", "__p", "__parts")
    done = rows.where(F.col("__p") == 0).select("doc_id", "source", "size", "__h", "__h2", "__copy", "source_size", "target", "__whole", "__p")
    most_docs = targets.agg(F.max("__docs")).first()[0] or 0  # one number
    turn, schema = 0, "doc_id string, source string, size long, __h long, __h2 long, __copy long, source_size long, target double, __whole long, __p double"
    while True:
        blocks = -(-most_docs // BLOCK)
        last = blocks <= 1
        dealt = open_rows.withColumn("__block", F.pmod(F.xxhash64("__h", "__copy", F.lit(turn)), F.col("__parts")))

        settled = dealt.groupBy("source", "__block").applyInPandas(_settler(last, seed, turn), schema)
        if last:
            done = done.unionByName(settled)
            break
        settled = materialize(settled)
        done = done.unionByName(settled.where((F.col("__p") == 0) | (F.col("__p") == 1)))
        # Each block leaves two rows at most, so a source with b blocks has 2 b left.
        open_rows = settled.where((F.col("__p") > 0) & (F.col("__p") < 1))
        left = materialize(open_rows.groupBy("source").agg(F.count("*").alias("__left")))
        most_docs = left.agg(F.max("__left")).first()[0] or 0
        parts = left.select(F.col("source").alias("__s"), F.greatest(F.ceil(F.col("__left") / BLOCK), F.lit(1)).alias("__parts"))
        open_rows = join_dimension(open_rows, parts, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
        turn += 1
    done = done.withColumn("copies", (F.col("__whole") + F.col("__p")).cast("long"))
    return done.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "__h", "__h2")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: each row as often as the mix takes it; columns as they came.

    Nulls, empty texts, repeated rows and empty tables as in mix. Rows that agree in all their columns are drawn each for itself, and
    what they took together is written for one of them.
    """
    own = docs.columns
    taken = mix(docs, key=own).where("copies > 0").groupBy("__h", "__h2").agg(F.sum("copies").alias("__copies"))
    rows = docs.select("*", *row_hash(docs, own)).dropDuplicates(["__h", "__h2"]).join(taken, ["__h", "__h2"])
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*own)


def op1_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")
