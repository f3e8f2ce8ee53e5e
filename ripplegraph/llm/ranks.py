"""Gapless numbering inside groups of any size, repeated rows included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplegraph.session import join_dimension, shuffle_partitions

#: Repeated rows that one task writes for a row and its count.
PIECE = 10_000


def repeat(df: DataFrame, first: Column, n: Column, out: str, piece: int = PIECE) -> DataFrame:
    """Each row n times, numbered from `first` in `out`; a row that repeats more than `piece` times is dealt over many tasks."""
    df = df.withColumn("__first", first.cast("long")).withColumn("__times", n.cast("long"))
    few = df.where(F.col("__times") <= piece).withColumn(out, F.explode(F.sequence(F.col("__first"), F.col("__first") + F.col("__times") - 1)))
    many = df.where(F.col("__times") > piece).withColumn("__at", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__times") - 1) / piece))))
    many = many.repartition(shuffle_partitions(df.sparkSession)).withColumn("__from", F.col("__first") + F.col("__at") * piece)
    many = many.withColumn(out, F.explode(F.sequence("__from", F.least(F.col("__from") + piece, F.col("__first") + F.col("__times")) - 1)))
    return few.unionByName(many.drop("__at", "__from")).drop("__first", "__times")


def copies(df: DataFrame, out: str) -> DataFrame:
    """df with its repeated rows numbered from 0; they are counted map-side, so none brings them together."""
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    return repeat(counted, F.lit(0), F.col("__n"), out).drop("__n")


def gapless_rank(df: DataFrame, group: str, order: list[str], out: str, cells: int = 256) -> DataFrame:
    """Number the rows of each group from 0, in a fixed pseudo-random order of the `order` columns.

    Equal rows are counted first (map-side combined). Each group is dealt into `cells` by hash, the cells are counted, and a row's
    number is the rows of its group's earlier cells plus its place in its own cell. So no task holds
    a whole group. `df` is read more than once: give a materialised one. Rows that agree in all of `order` are
    interchangeable. Null groups are a group of their own.
    """
    cell = F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int")
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("__n")).withColumn("__cell", cell)
    before = Window.partitionBy(group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(group, cell.alias("__cell")).agg(F.count("*").alias("__m"))
    starts = counts.select(F.col(group).alias("__g"), F.col("__cell").alias("__c"), F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(group, "__cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("__place", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    on = F.col(group).eqNullSafe(F.col("__g")) & (F.col("__cell") == F.col("__c"))
    joined = join_dimension(ranked, starts, on)
    return repeat(joined, F.col("__start") + F.col("__place"), F.col("__n"), out).drop("__cell", "__n", "__g", "__c", "__start", "__place")
