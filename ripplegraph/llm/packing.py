"""Packing into optimal length buckets.

The histogram of lengths over all documents is one aggregation; a dynamic program over it chooses
the bucket bounds that make the least padding, and inside each bucket documents are dealt, in a fixed
shuffled order, to batches of as many as the token budget holds at the bucket's bound.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.llm.mixing import word_count
from ripplegraph.llm.ranks import gapless_rank
from ripplegraph.session import materialize, table

BUCKETS = 12
#: Padded words of a batch.
BUDGET = 16_384
#: Lengths up to this have a histogram bin each; longer ones share bins of 1/1024 of their size, whose bound is the longest in them.
EXACT = 1 << 15


def histogram(lengths: DataFrame, exact: int | None = None) -> list[tuple[int, int, int]]:
    """(bound, documents, words) by rising bound. At most `exact` (EXACT) + 1024 per doubling rows, whatever the corpus; 0 gives every length its own bin."""
    exact = EXACT if exact is None else exact
    step = F.greatest(F.shiftright(F.lit(1).cast("long") * F.pow(F.lit(2), F.floor(F.log2(F.col("length")))).cast("long"), 10), F.lit(1))
    coarse = F.ceil(F.col("length") / step) * step
    bins = lengths.withColumn("__bin", F.col("length") if exact == 0 else F.when(F.col("length") <= exact, F.col("length")).otherwise(coarse))
    rows = bins.groupBy("__bin").agg(F.max("length").alias("bound"), F.count("*").alias("n"), F.sum("length").alias("words"))
    return sorted((r.bound, r.n, r.words) for r in rows.select("bound", "n", "words").collect())


def optimal_bounds(hist: list[tuple[int, int, int]], buckets: int = BUCKETS) -> tuple[list[int], int]:
    """The bounds of at most `buckets` buckets with the least padding, and that padding.

    With N(i) documents and W(i) words in the first i bins, a bucket over bins i+1..j pads
    bound(j) * (N(j) - N(i)) - (W(j) - W(i)). For fixed j that is a line in bound(j) with slope -N(i):
    slopes fall and queries rise, so each layer is one pass over a convex hull of lines.
    """
    m = len(hist)
    if not m:
        return [], 0
    count, total = [0], [0]
    for _, n, w in hist:
        count.append(count[-1] + n)
        total.append(total[-1] + w)
    bound = [0] + [b for b, _, _ in hist]
    # cost[j]: least padded size (padding plus words) of the first j bins
    cost = [0] + [bound[j] * count[j] for j in range(1, m + 1)]
    back = [[0] * (m + 1)]
    for _ in range(1, min(buckets, m)):
        fresh, from_ = [0] * (m + 1), [0] * (m + 1)
        hull: list[int] = []
        head = 0

        def worse(a: int, b: int, c: int, cost: list[int] = cost) -> bool:  # is line b nowhere below both a and c?
            return (cost[c] - cost[a]) * (count[b] - count[a]) <= (cost[b] - cost[a]) * (count[c] - count[a])

        for j in range(1, m + 1):
            i = j - 1
            while len(hull) - head >= 2 and worse(hull[-2], hull[-1], i):
                hull.pop()
            hull.append(i)
            x = bound[j]
            while len(hull) - head >= 2 and cost[hull[head + 1]] - x * count[hull[head + 1]] <= cost[hull[head]] - x * count[hull[head]]:
                head += 1
            i = hull[head]
            fresh[j], from_[j] = cost[i] + x * (count[j] - count[i]), i
        if fresh[m] >= cost[m]:
            break
        cost = fresh
        back.append(from_)
    bounds, j = [], m
    for from_ in reversed(back):
        if j == 0:
            break
        bounds.append(bound[j])
        j = from_[j]
    return sorted(bounds), cost[m] - total[m]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, exact: int | None = None) -> DataFrame:
    """doc_id, n_words, bucket_bound, padding, batch (in its bucket, from 0) and slot (in its batch) of every row.

    Null, empty or wordless text packs as length 1 (n_words 0). A document longer than the budget is a
    batch of its own. Repeated rows are packed each. An empty table gives an empty result; extra
    columns are not read. Bounds are optimal over the histogram's bins: for all lengths with `exact` = 0, whose histogram then has a row
    for each length that occurs.
    """
    n = word_count()
    rows = materialize(docs.select("doc_id", n.alias("n_words"), F.greatest(n, F.lit(1)).alias("length"), F.xxhash64("doc_id", "text").alias("__h")))
    bounds, _ = optimal_bounds(histogram(rows, exact), buckets)
    if not bounds:
        bounds = [1]
    bound = F.array_min(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b >= F.col("length")))
    rows = gapless_rank(rows.withColumn("bucket_bound", bound), "bucket_bound", ["__h", "doc_id", "n_words"], "__rank")
    per_batch = F.greatest(F.floor(F.lit(budget) / F.col("bucket_bound")), F.lit(1))
    rows = rows.withColumn("batch", F.floor(F.col("__rank") / per_batch)).withColumn("slot", F.pmod(F.col("__rank"), per_batch))
    return rows.select("doc_id", "n_words", "bucket_bound", (F.col("bucket_bound") - F.col("length")).alias("padding"), "batch", "slot")


def bucket_of(length: int, bounds: list[int]) -> int:
    return bounds[bisect_left(bounds, length)]


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bucket, batch and slot of each document: the columns of pack, which says what becomes of nulls, empty texts, repeated rows and empty tables."""
    return pack(docs)


def op2_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
