"""Document fingerprints: threshold-scaled sketches.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so its size follows the text,
the union of two sketches is the sketch of the union, and the share of one found in the other estimates
containment even between a page and a book (FracMinHash; Irber and others, 2022).
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.llm import textbytes as tb
from ripplegraph.session import join_dimension, table

#: Share of all shingle hashes that a sketch keeps, and words of a shingle.
FRACTION = 0.25
WIDTH = 5
#: Bytes kept of a retained hash.
DIGITS = 6


class Sketch:
    """Retained hashes (sorted), with the sum of all distinct shingle hashes for texts too short to retain any."""

    __slots__ = ("kept", "total")

    def __init__(self, kept: np.ndarray, total: int):
        self.kept, self.total = kept, total

    def encode(self) -> str:
        whole = self.kept.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :DIGITS]
        return f"{self.total:016x}:" + base64.b64encode(whole.tobytes()).decode()

    @classmethod
    def decode(cls, text: str) -> Sketch:
        total, _, kept = text.partition(":")
        raw = np.frombuffer(base64.b64decode(kept), np.uint8).reshape(-1, DIGITS)
        whole = np.zeros((len(raw), 8), np.uint8)
        whole[:, :DIGITS] = raw
        return cls(whole.view(">u8").ravel().astype(np.uint64), int(total, 16))

    def merge(self, other: Sketch) -> Sketch:
        """The sketch of both texts' shingles together; the sum then stands for the pair alone."""
        return Sketch(np.union1d(self.kept, other.kept), (self.total + other.total) % (1 << 64))

    def contained_in(self, other: Sketch) -> float:
        """Estimated share of this text's shingles that the other has; with none retained, 1 only for equal shingles."""
        if not len(self.kept):
            return float(self.total == other.total and not len(other.kept))
        return len(np.intersect1d(self.kept, other.kept, assume_unique=True)) / len(self.kept)


def sketches(texts: list[str], fraction: float = FRACTION) -> list[Sketch]:
    limit = np.uint64(min(int(fraction * 2.0**64), (1 << 64) - 1))
    cut = np.uint64(((1 << (8 * DIGITS)) - 1) << (64 - 8 * DIGITS))
    out: list[Sketch] = []
    for _, data, offsets in tb.chunks(pa.array(texts, pa.large_string())):
        n = len(offsets) - 1
        grams, owner = tb.shingles(*tb.words(data, offsets), WIDTH)
        at = tb.bounds(owner, n)
        for i in range(n):
            own = np.unique(grams[at[i] : at[i + 1]])
            kept = own[: np.searchsorted(own, limit)] & cut
            out.append(Sketch(kept[np.r_[True, kept[1:] != kept[:-1]]] if len(kept) else kept, int(own.sum(dtype=np.uint64))))
    return out


#: Bounds looked up at once; parts are found in two steps, so there may be FAN * FAN of them.
FAN = 1024
#: A text counts once in the quantiles for each so many bytes.
_UNIT = 1 << 16


def part_bytes(spark: SparkSession) -> int:
    """Bytes of text of a part: what the session lets its scans read in a task."""
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get("spark.sql.files.maxPartitionBytes").strip().lower()).groups()
    return int(number) * 1024 ** " kmgtp".index(unit or " ")


def ranges(docs: DataFrame, parts: int) -> list[int]:
    """Bounds that cut the ids into parts of about equal bytes: `parts` - 1 numbers, from a mergeable quantile summary. An id that fills several parts is there as often."""
    if parts < 2:
        return []
    weighed = docs.select("id", F.explode(F.sequence(F.lit(0), F.floor(F.col("size") / _UNIT).cast("int"))))
    row = weighed.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], max(10_000, 20 * parts)).alias("q")).first()
    return list(row.q or [])


def part_of(bounds: list[int], id_: Column, h: Column) -> Column:
    """The number of bounds below the id, and inside an id that several bounds share a part by the hash of the text.

    Parts rise with (id, h). Bounds are looked up in two steps, first among every FAN-th.
    """
    distinct = sorted(set(bounds))
    if not distinct:
        return F.lit(0)
    times = {b: bounds.count(b) for b in distinct} if len(distinct) < len(bounds) else {}
    literal = lambda x, kind: F.from_json(F.lit(json.dumps(x)), F.lit(kind))  # noqa: E731 one constant, not an expression for each number
    heads = distinct[::FAN]
    groups = [distinct[i : i + FAN] for i in range(0, len(distinct), FAN)]
    head = F.greatest(F.size(F.filter(literal(heads, "array<bigint>"), lambda b: b < id_)), F.lit(1))
    inside = F.size(F.filter(F.element_at(literal(groups, "array<array<bigint>>"), head), lambda b: b < id_))
    below = (head - 1) * FAN + inside
    heavy = {b: n for b, n in times.items() if n > 1}
    if not heavy:
        return below
    # An id with n bounds has n parts of its own; all later parts move up by as many as came before.
    extra = list(itertools.accumulate((times[b] - 1 for b in distinct), initial=0))
    at = F.element_at(literal(extra, "array<bigint>"), below + 1)
    n = F.coalesce(F.try_element_at(literal({str(b): n for b, n in heavy.items()}, "map<string,bigint>"), id_.cast("string")), F.lit(1))
    unit = F.shiftright(h, 10).cast("double") * F.lit(2.0**-53)  # of 63 bits, the upper 53
    return (below + at + F.floor(unit * n)).cast("int")


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, text and part, sorted inside parts of rising doc_id; the row that follows a part ends it, marked __after = 1.

    One shuffle of the texts, of a part to a task: the first row of each part, one of equal id and text where rows repeat, also goes to
    the part before it, and the first of all to the last. Null ids come first. Rows of one id are dealt by the hash of their
    text where they are more than a part, so only rows that agree in both stay together.
    """
    spark = docs.sparkSession
    # Null ids stand at the least long.
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("id", F.coalesce("doc_id", F.lit(-(2**63))))
    sized = rows.select("id", F.octet_length("text").alias("size"))
    if parts is None:
        parts = max(-(-(sized.agg(F.sum("size")).first()[0] or 0) // part_bytes(spark)), spark.sparkContext.defaultParallelism)
    bounds = ranges(sized, parts)
    h = F.shiftrightunsigned(F.xxhash64("text"), 1)  # not negative
    rows = rows.withColumn("h", h).withColumn("part", part_of(bounds, F.col("id"), F.col("h")))
    heads = rows.groupBy("part").agg(F.min(F.struct("id", "h")).alias("first")).select("part", "first.id", "first.h").collect()  # a row a part
    heads = sorted(heads, key=lambda r: r.part)
    before = [(heads[i].id, heads[i].h, heads[i].part, heads[i - 1].part) for i in range(len(heads))]
    table_of = spark.createDataFrame(before or [(0, 0, -1, -1)], "i long, x long, of int, to int")
    on = (F.col("part") == F.col("of")) & (F.col("id") == F.col("i")) & (F.col("h") == F.col("x"))
    firsts = join_dimension(rows, table_of, on, rows=len(before)).groupBy("to").agg(F.first(F.struct("doc_id", "text", "id", "h")).alias("r"))
    firsts = firsts.select("r.doc_id", "r.text", "r.id", "r.h", F.col("to").alias("part"), F.lit(1).alias("__after"))
    every = rows.select("doc_id", "text", "id", "h", "part", F.lit(0).alias("__after")).unionByName(firsts)
    return every.repartitionById(len(bounds) + 1, F.col("part").cast("int")).sortWithinPartitions("part", "__after", "id", "h").drop("id", "h")


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Rows sketched together.
_AT_ONCE = 512


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair each row with the next one of its part, across batches, and sketch a few hundred rows at a time."""
    last: tuple | None = None

    def finish(rows: list[tuple]) -> pa.RecordBatch | None:
        pairs = [(a, b) for a, b in zip(rows, rows[1:]) if a[2] == b[2] and not a[3]]
        if not pairs:
            return None
        edited = []
        for (_, text, _, _), (_, after, _, _) in pairs:
            q = len(text) // 4
            edited.append(text[: len(text) - q] + after[:q] if q else text)
        own, other = sketches([r[1] for r in rows]), sketches(edited)
        place = [i for i, (a, b) in enumerate(zip(rows, rows[1:])) if a[2] == b[2] and not a[3]]
        columns = [
            [rows[i][0] for i in place],
            [len(rows[i][1]) for i in place],
            [hashlib.sha256(e.encode()).hexdigest() for e in edited],
            [own[i].encode() for i in place],
            [s.encode() for s in other],
            [own[i].contained_in(s) for i, s in zip(place, other)],
            [own[i].contained_in(own[i + 1]) for i in place],
        ]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text", "part", "__after")]
        for at in range(0, batch.num_rows, _AT_ONCE):
            rows = list(zip(*[c.slice(at, _AT_ONCE).to_pylist() for c in columns]))
            if last is not None:
                rows.insert(0, last)
            last = rows[-1]
            if (out := finish(rows)) is not None:
                yield out


def fingerprint_documents(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and its edited text (its last quarter replaced by the start of the next document).

    Null text counts as empty: no shingles, sum 0, and like (1) only another such text. A text of fewer
    than five words has one shingle. A single row is its own next one. Repeated rows follow each other.
    An empty table gives an empty result; extra columns are not read.
    """
    return with_next(docs, parts).mapInArrow(_follow, _SCHEMA)


def op5_scaled_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
