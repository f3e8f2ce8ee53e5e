"""Line deduplication over levelled sorted runs of line hashes. DataFrame functions only.

A run is a table of line keys (128-bit hashes), dealt into buckets and sorted by key, with the number of documents
that hold the line, the largest doc_id of them and the number of places. Each new batch is merge-anti-joined with
every run, bucket by bucket and without a shuffle of the runs: keys that no run has become a run of level 0, so
every key has its home in one run, and what the batch adds to known keys is kept beside that run as its
updates. As soon as a level has `fanout` runs they are merged, updates included, into one of the next level.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.session import checkpoint_dir, join_counted, materialize, remove_folder, shuffle_partitions, table

#: Shortest key considered, in code points, and documents that must hold it.
LEAST, COPIES = 20, 3
BATCHES, FANOUT = 4, 4
_SPACE = " \t\n\x0b\x0c\r"
_KEY = ["k1", "k2"]


def _lower(text: Column) -> Column:
    """A-Z in lower case; ASCII takes Spark's faster function, with the same result."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def _row(doc_id: str, text: str) -> list[Column]:
    """128 bits that tell apart the texts of one doc_id (r1, r2)."""
    return [F.xxhash64(doc_id, text).alias("r1"), F.xxhash64(F.lit(1), text).alias("r2")]


def _with(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that is computed once; a plain projection would be inlined wherever it is used."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def hashed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, r1, r2 (the row), pos, k1 and k2 of each line whose key is long enough.

    A line's key is the line without white space at its ends, A-Z in lower case.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = docs.select("doc_id", *_row("doc_id", "text"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    bare = _with(lines.where(F.octet_length("line") >= LEAST), "bare", F.btrim("line", F.lit(_SPACE))).where(F.char_length("bare") >= LEAST)
    keys = _with(bare, "key", _lower(F.col("bare")))
    return keys.select("doc_id", "r1", "r2", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2"))


class LineRuns:
    """The levels of runs: bucketed tables whose files lie under a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, fanout: int = FANOUT):
        self.spark, self.folder, self.fanout = spark, folder, fanout
        self.buckets = shuffle_partitions(spark)
        #: Of each level, the runs as (table of the keys' home, tables of their updates).
        self.levels: list[list[tuple[str, list[str]]]] = [[]]
        self._prefix, self._made = f"line_runs_{uuid.uuid4().hex}", 0

    def _write(self, keys: DataFrame) -> str:
        name = f"{self._prefix}_{self._made}"
        self._made += 1
        keys.write.bucketBy(self.buckets, *_KEY).sortBy(*_KEY).option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_folder(self.spark, f"{self.folder}/{name}")

    def _runs(self) -> list[tuple[str, list[str]]]:
        return [run for level in reversed(self.levels) for run in level]

    def _merged(self, runs: list[tuple[str, list[str]]]) -> DataFrame:
        # The files are read by path: a union of bucketed tables would pass for bucketed, which Spark 4.1 then groups without bringing equal keys together.
        parts = self.spark.read.schema("k1 long, k2 long, docs long, latest long, places long").parquet(*[f"{self.folder}/{t}" for home, updates in runs for t in (home, *updates)])
        return parts.groupBy(*_KEY).agg(F.sum("docs").alias("docs"), F.max("latest").alias("latest"), F.sum("places").alias("places"))

    def unseen(self, lines: DataFrame) -> DataFrame:
        """The lines or keys that no run holds yet: a merge anti-join with each run in turn."""
        for home, _ in self._runs():
            lines = lines.join(self.spark.table(home).select(*_KEY).hint("merge"), _KEY, "left_anti")
        return lines

    def add(self, lines: DataFrame) -> None:
        """Add a batch of hashed lines, whose documents no other batch has, and compact each level that is then full."""
        # A document counts once for a key, however often it or its rows repeat the line; counts combine before each shuffle.
        own = lines.groupBy(*_KEY, "doc_id").agg(F.count("*").alias("places"))
        own = own.groupBy(*_KEY).agg(F.count("doc_id").alias("docs"), F.max("doc_id").alias("latest"), F.sum("places").alias("places"))
        if self._runs():
            own = own.persist(StorageLevel.DISK_ONLY)
            fresh = self._write(self.unseen(own))
            # Updates wait beside the newest run; sums and maxima are the same whichever run they are merged with.
            updates = own.join(self.spark.table(fresh).select(*_KEY).hint("merge"), _KEY, "left_anti")
            self._runs()[-1][1].append(self._write(updates))
            own.unpersist()
        else:
            fresh = self._write(own)
        self.levels[0].append((fresh, []))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            if len(self.levels) == level + 1:
                self.levels.append([])
            self.levels[level + 1].append((self._write(self._merged(full)), []))
            for home, updates in full:
                for name in (home, *updates):
                    self._drop(name)
            level += 1

    def keys(self) -> DataFrame | None:
        """All keys with their counts over all runs and updates, or None before the first batch."""
        runs = self._runs()
        if not runs:
            return None
        return self.spark.table(runs[0][0]) if len(runs) == 1 and not runs[0][1] else self._merged(runs)

    def drop(self) -> None:
        for home, updates in self._runs():
            for name in (home, *updates):
                self._drop(name)
        self.levels = [[]]


def _doomed(docs: DataFrame, batches: int, fanout: int) -> DataFrame:
    """doc_id, r1, r2 and drop (the positions of the lines to drop) of each text that loses any."""
    spark = docs.sparkSession
    folder = f"{checkpoint_dir(spark)}/line-runs-{uuid.uuid4().hex}"
    # The one pass that splits and hashes the texts; everything after it reads slim rows.
    hashed_lines(docs).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches))).write.partitionBy("batch").parquet(f"{folder}/lines")
    lines = spark.read.schema("doc_id long, r1 long, r2 long, pos int, k1 long, k2 long, batch int").parquet(f"{folder}/lines")
    runs = LineRuns(spark, folder, fanout)
    for b in range(batches):
        runs.add(lines.where(F.col("batch") == b))
    common = materialize(runs.keys().where(F.col("docs") >= COPIES).select(*_KEY, "latest", "places"))
    runs.drop()
    met = join_counted(lines.drop("batch"), common, _KEY, "places")
    gone = met.where(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("latest")))
    # A text's lines at most meet here: rows that repeat a doc_id and text share their positions.
    gone = materialize(gone.groupBy("doc_id", "r1", "r2").agg(F.collect_set("pos").alias("drop")))
    remove_folder(spark, folder)
    return gone


def _kept(lines: Column, drop: Column) -> Column:
    """The other lines, joined; in time linear in the lines, with the split text bound once."""
    whole = F.transform(F.array(lines), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), drop), lambda i: F.get(x, i)), "\n"))
    return F.get(whole, F.lit(0))


def _cleaned(docs: DataFrame, batches: int, fanout: int) -> DataFrame:
    """docs with __n_lines, __n_dropped and __kept."""
    doomed = _doomed(docs.select("doc_id", "text"), batches, fanout).toDF("__id", "__r1", "__r2", "__drop")
    docs = docs.withColumn("__text", F.coalesce("text", F.lit("")))
    r1, r2 = _row("doc_id", "__text")
    docs = docs.join(doomed, F.col("doc_id").eqNullSafe(F.col("__id")) & (r1 == F.col("__r1")) & (r2 == F.col("__r2")), "left")
    kept = F.when(F.col("__drop").isNull(), F.col("__text")).otherwise(_kept(F.split("__text", "\n", -1), F.col("__drop")))
    n_lines = F.length("__text") - F.length(F.replace("__text", F.lit("\n"))) + 1
    docs = docs.withColumn("__kept", kept).withColumn("__n_lines", n_lines.cast("long"))
    return docs.withColumn("__n_dropped", F.coalesce(F.size("__drop"), F.lit(0)).cast("long")).drop("__text", "__drop", "__id", "__r1", "__r2")


def drop_common_lines(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept (the text without its dropped lines) of every row.

    A document is a doc_id: rows that share one count once for a key, and all rows of the largest doc_id that holds
    a key keep its lines. Rows without an id are no document: they count for no key and lose the lines of every common one. Null
    text counts as one empty line. Repeated rows are treated alike. An empty table gives an empty result; extra columns are not read.
    """
    rows = _cleaned(docs.select("doc_id", "text"), batches, fanout)
    return rows.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.col("__kept").alias("kept"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the common lines taken out of their texts; n_chars follows, all other columns stay.

    Nulls, empty texts, repeated rows and ids as in drop_common_lines: a text that loses nothing stays as it is, null
    included. Every row stays, also one that loses all its lines (its text is then empty). An empty table gives an empty result.
    """
    own = docs.columns
    changed = F.col("__n_dropped") > 0
    out = _cleaned(docs, BATCHES, FANOUT).withColumn("text", F.when(changed, F.col("__kept")).otherwise(F.col("text")))
    if "n_chars" in own:
        out = out.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*own)


def op8_levelled_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = drop_common_lines(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (
  SELECT k, max(doc_id) AS latest FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT keyed.doc_id, pos, line, latest IS NOT NULL AND coalesce(keyed.doc_id < latest, true) AS gone FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
