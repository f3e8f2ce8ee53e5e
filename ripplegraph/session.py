"""Session helpers shared by every operator: tables, lineage cuts and size-checked joins."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a dimension is broadcast; beyond it the join shuffles (and AQE splits skew).
BROADCAST_ROWS = 50_000
#: At most so many keys can each hold the HOT_KEYS-th part of all rows; these are broadcast by join_counted.
HOT_KEYS = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. Without one, a temporary folder in local mode; on a cluster that fails, as other machines would not see it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="ripplegraph-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that two readers share one computation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_dimension(df: DataFrame, dim: DataFrame, on: Column, how: str = "inner", rows: int | None = None) -> DataFrame:
    """Join a small table: broadcast if its row count is within BROADCAST_ROWS, else shuffle both sides."""
    rows = dim.count() if rows is None else rows
    return df.join(F.broadcast(dim) if rows <= BROADCAST_ROWS else dim, on, how)


def join_counted(rows: DataFrame, keyed: DataFrame, key: list[str], n: str) -> DataFrame:
    """rows joined to `keyed`, which has one row for each key with the number `n` of the rows that the key has; n is dropped.

    A key with at least the HOT_KEYS-th part of all rows meets them by broadcast, so its rows are not brought together; such keys are
    HOT_KEYS at most. Every other key has fewer rows than that and is shuffled. Where `keyed` is no longer than HOT_KEYS it is
    broadcast whole, and where no key fills a task's share of the rows the join is a plain one. Both inputs may be read twice: give materialised ones.
    """
    keys, total, most = keyed.agg(F.count("*"), F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    if keys <= HOT_KEYS:
        return rows.join(F.broadcast(keyed.drop(n)), key)
    if most * shuffle_partitions(rows.sparkSession) <= total:
        return rows.join(keyed.drop(n), key)
    hot = F.col(n) * HOT_KEYS >= F.lit(total)
    met = rows.join(F.broadcast(keyed.where(hot).drop(n)), key)
    others = rows.join(F.broadcast(keyed.where(hot).select(*key)), key, "left_anti")
    return met.unionByName(others.join(keyed.where(~hot).drop(n), key))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session, for clusters where it isn't installed."""
    import shutil
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_ripplegraph_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="ripplegraph-")
    sc.addPyFile(shutil.make_archive(f"{folder}/ripplegraph", "zip", package.parent, package.name))
    sc._ripplegraph_shipped = True
