"""Operator 13: hard negatives by best-first search in an R-tree that is packed by sort-tile-recursive.

Spark cuts the vectors into slabs along the coordinate of the widest spread; inside a slab a task tiles the rest and stores leaves.
Anchors come in blocks of bounded size; each search task builds the boxes over the leaves it reads and runs a queue per
anchor over them. Scores are exact integers.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplegraph.session import checkpoint_dir, table

#: Rows of a slab (about), rows of a leaf, boxes under a box and leaves of a tree (at most), and anchors that are sent to the tasks at once (about).
SLAB, LEAF, FAN, TREE, BLOCK = 16_384, 128, 16, 256, 4_096
#: Coordinates that tiling goes through, by falling spread.
TILED = 8
POSITIVES, NEGATIVES = 5, 5
#: A negative's score lies between these hundredths of the positive's.
WINDOW = (80, 100)
_LONG = (1 << 63) - 1
_LEAVES = "ids array<bigint>, labels array<int>, vectors binary"
_FOUND = "anchor int, top bigint, score bigint, id bigint"
_ROWS = "id bigint, label int, vector array<double>"
_PAIRS = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def usable(rows: DataFrame) -> DataFrame:
    """id, label, vector of the rows that take part, equal ones once: those with an id, a label and a vector whose components are all finite."""
    odd = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull())
    return whole.select("id", "label", F.col("vector").cast("array<double>").alias("vector")).where(~odd).dropDuplicates()


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of integers floor(256 * x); shorter vectors are filled up with zeros. Components beyond a long saturate."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.asarray(lists.value_lengths())
    out = np.zeros((len(sizes), width))
    flat = np.asarray(lists.flatten())
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(flat * 256.0)
    return np.clip(out, -float(1 << 62), float(1 << 62)).astype(np.int64)


def _bytes(x: np.ndarray) -> bytes:
    """Integers in the narrowest of 2, 4 and 8 bytes that holds them all; a reader sees from the length which that is."""
    most = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    return x.astype(next(t for t in ("<i2", "<i4", "<i8") if most < 1 << (8 * np.dtype(t).itemsize - 1))).tobytes()


def _integers(data: bytes, rows: int, width: int) -> np.ndarray:
    if not rows * width:
        return np.zeros((rows, width), np.int64)
    return np.frombuffer(data, f"<i{len(data) // (rows * width)}").astype(np.int64).reshape(rows, width)


def tiles(x: np.ndarray, ids: np.ndarray, order: list[int], leaf: int = LEAF) -> Iterator[np.ndarray]:
    """Row numbers of each leaf. Rows are sorted by a coordinate and cut into as many slabs as the leaves need over the coordinates left; each slab goes on with the next."""
    todo = [(np.arange(len(x)), 0)]
    while todo:
        rows, depth = todo.pop()
        leaves = -(-len(rows) // leaf)
        if leaves <= 1:
            yield rows
            continue
        left = max(len(order) - depth, 1)
        slabs = max(2, int(np.ceil(leaves ** (1 / left) - 1e-9)))
        by = x[rows, order[depth % len(order)]] if order else ids[rows]
        rows = rows[np.lexsort((ids[rows], by))]
        size = -(-leaves // slabs) * leaf
        todo.extend((rows[at : at + size], depth + 1) for at in reversed(range(0, len(rows), size)))


def pack(rows: DataFrame, path: str) -> int:
    """Write the leaves of rows (id, label, vector) to `path` and return the width of the vectors (0 where there are no rows).

    The id is the last key of the slabs, so vectors that very many rows share are cut too, and a slab holds about SLAB rows.
    """
    spark = rows.sparkSession
    count, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    order: list[int] = []
    if width:
        spread = rows.select(F.posexplode("vector").alias("c", "x")).groupBy("c").agg(F.stddev("x").alias("s")).collect()  # a row a coordinate
        order = [r["c"] for r in sorted(spread, key=lambda r: (-(r["s"] or 0.0), r["c"]))][:TILED]

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        slab = pa.Table.from_batches(held)
        ids, labels = slab["id"].to_numpy(), slab["label"].to_numpy()
        x = _matrix(slab["vector"], width)
        for rows in tiles(x, ids, order[1:] or order):
            yield pa.RecordBatch.from_arrays([pa.array([ids[rows]], pa.list_(pa.int64())), pa.array([labels[rows]], pa.list_(pa.int32())), pa.array([_bytes(x[rows])], pa.binary())], ["ids", "labels", "vectors"])

    first = F.get("vector", F.lit(order[0])) if order else F.lit(0.0)
    slabs = rows.repartitionByRange(max(1, -(-count // SLAB)), first, F.col("id"), F.col("label"))
    slabs.mapInArrow(leaves, _LEAVES).write.parquet(path)
    return width


def _saturated(scores: np.ndarray) -> np.ndarray:
    """Scores beyond a long count as the largest or least one; doubles are exact and far from that."""
    return np.clip(scores, -_LONG, _LONG) if scores.dtype == object else scores


class Boxes:
    """Leaves with the boxes above them: levels[0] are the leaves' boxes, and each box of a level covers FAN of the level below."""

    def __init__(self, leaves: pa.Table, width: int) -> None:
        sizes = np.asarray(leaves["ids"].combine_chunks().value_lengths())
        self.at = np.r_[0, np.cumsum(sizes)]
        self.ids, self.labels = (np.asarray(leaves[c].combine_chunks().flatten()) for c in ("ids", "labels"))
        self.x = np.concatenate([_integers(v.as_py(), n, width) for v, n in zip(leaves["vectors"], sizes.tolist())])
        low, high = np.minimum.reduceat(self.x, self.at[:-1], axis=0), np.maximum.reduceat(self.x, self.at[:-1], axis=0)
        self.levels = [(low, high)]
        while len(low) > 1:
            begin = np.arange(0, len(low), FAN)
            low, high = np.minimum.reduceat(low, begin, axis=0), np.maximum.reduceat(high, begin, axis=0)
            self.levels.append((low, high))

    def exact(self, anchors: np.ndarray) -> type:
        """The type in which inner products are exact: doubles where all sums stay below 2 ** 53, else whole numbers of any size."""
        reach = [max(abs(int(m.min(initial=0))), abs(int(m.max(initial=0)))) for m in (self.x, anchors)]
        return float if reach[0] * reach[1] * max(1, self.x.shape[1]) < 1 << 53 else object

    def intervals(self, anchors: np.ndarray, kind: type) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each level the least and the largest inner product that an anchor can have with a point of each box."""
        above, below = np.maximum(anchors, 0).astype(kind), np.minimum(anchors, 0).astype(kind)
        out = []
        for low, high in self.levels:
            low, high = low.T.astype(kind), high.T.astype(kind)
            out.append((_saturated(above @ low + below @ high), _saturated(above @ high + below @ low)))
        return out


class Search:
    """One anchor's best-first searches over the boxes; the scores of an opened leaf are kept for the next window."""

    def __init__(self, boxes: Boxes, points: np.ndarray, spans: list[tuple[np.ndarray, np.ndarray]], row: int, id: int, label: int, vector: np.ndarray) -> None:
        self.boxes, self.points, self.spans, self.row = boxes, points, spans, row
        self.id, self.label, self.vector = id, label, vector.astype(points.dtype)
        self.opened: dict[int, np.ndarray] = {}

    def scores(self, leaf: int) -> np.ndarray:
        if leaf not in self.opened:
            self.opened[leaf] = _saturated(self.points[self.boxes.at[leaf] : self.boxes.at[leaf + 1]] @ self.vector)
        return self.opened[leaf]

    def first(self, k: int, same: bool, low: int | None = None, high: int | None = None, floor: int | None = None, best: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
        """The first k (-score, id) of the anchor's label, or of the others, with scores from low to high, those in `best` among them. What scores below `floor` isn't wanted."""
        b, best = self.boxes, best or []
        queue = [(-self.spans[-1][1][self.row, i], len(b.levels) - 1, i) for i in range(len(b.levels[-1][0]))]
        while queue:
            upper, level, i = heapq.heappop(queue)
            upper = -upper
            bound = -best[-1][0] if len(best) == k else floor
            if (bound is not None and (upper if high is None else min(upper, high)) < bound) or (low is not None and upper < low):
                break  # all other boxes reach no higher; boxes that only equal the kth score are opened, as they may hold smaller ids
            if high is not None and self.spans[level][0][self.row, i] > high:
                continue
            if level:
                below = self.spans[level - 1][1]
                for kid in range(i * FAN, min((i + 1) * FAN, below.shape[1])):
                    heapq.heappush(queue, (-below[self.row, kid], level - 1, kid))
                continue
            s, at = self.scores(i), slice(b.at[i], b.at[i + 1])
            fits = (b.labels[at] == self.label) == same
            for least in (low, bound):
                if least is not None:
                    fits = fits & (s >= least).astype(bool)
            if high is not None:
                fits = fits & (s <= high).astype(bool)
            hits = np.flatnonzero(fits)
            if same:  # not the anchor itself
                hits = [h for h in hits if b.ids[at][h] != self.id or (b.x[at][h] != self.vector).any()]
            best = sorted(best + [(-int(s[h]), int(b.ids[at][h])) for h in hits])[:k]
        return best


#: A search that is asked for: the anchor's place in its block, the positive's score (None for positives), low, high, floor.
Ask = tuple[int, int | None, int | None, int | None, int | None]


def search(leaves: DataFrame, width: int, anchors: dict[str, np.ndarray], asked: list[Ask], k: int, same: bool, home: bool = False) -> DataFrame:
    """anchor, top, score, id: for each search asked the first k among the leaves that a task reads; with `home` only in trees that hold the anchor's own row.

    A task takes TREE leaves at a time, so its memory is bounded, and goes on with what it has found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[Ask, list[tuple[int, int]]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, TREE):
                boxes = Boxes(pa.Table.from_batches([batch.slice(at, TREE)]), width)
                here = np.isin(anchors["id"], boxes.ids) if home else np.ones(len(anchors["id"]), bool)
                mine = sorted((a for a in asked if here[a[0]]), key=lambda a: a[0])
                if not mine:
                    continue
                places = sorted({a[0] for a in mine})
                kind = boxes.exact(anchors["x"])
                points, spans = boxes.x.astype(kind), boxes.intervals(anchors["x"][places], kind)
                row, now = {p: i for i, p in enumerate(places)}, None
                for ask in mine:
                    place, _, low, high, floor = ask
                    if now is None or now[0] != place:
                        now = place, Search(boxes, points, spans, row[place], int(anchors["id"][place]), int(anchors["label"][place]), anchors["x"][place])
                    found[ask] = now[1].first(k, same, low, high, floor, found.get(ask))
        out = [(ask[0], ask[1], -s, i) for ask, best in found.items() for s, i in best]
        cols = list(zip(*out)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[1:]]], ["anchor", "top", "score", "id"])

    return leaves.mapInArrow(run, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The first k of each search, numbered from 1."""
    order = Window.partitionBy("anchor", "top").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _floors(found: DataFrame, k: int) -> dict[tuple[int, int | None], int]:
    """The kth score of each search that has found k already: at most a row for each search of a block."""
    rows = _best(found, k).where(F.col("rank") == k).select("anchor", "top", "score").collect()
    return {(r["anchor"], r["top"]): r["score"] for r in rows}


def hard_negatives(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows (id, label, vector, anchor: boolean).

    A positive is one of the anchor's first other rows of its label; a negative has another label and a score within the window (in
    hundredths of the positive's score). Higher scores come first, then smaller ids. Rows without an id, a label or a whole vector
    take no part, equal rows count once, rows that share an id but differ are rows of their own, and a short vector counts as filled up
    with zeros. An anchor without positives, or a positive without negatives, gives no row. Components beyond 2**62 count as that, scores beyond a long as the largest long.

    Each search first runs in the tree that holds the anchor, whose kth score then prunes it in all others.
    """
    spark = rows.sparkSession
    folder = f"{checkpoint_dir(spark)}/negatives-{uuid.uuid4().hex}"
    usable(rows).write.parquet(f"{folder}/rows")
    kept = spark.read.schema(_ROWS).parquet(f"{folder}/rows")
    width = pack(kept, f"{folder}/leaves")
    leaves = spark.read.schema(_LEAVES).parquet(f"{folder}/leaves")
    anchors = usable(rows.where("anchor"))
    blocks = max(1, -(-anchors.count() // block))
    anchors.withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)).cast("int")).write.partitionBy("block").parquet(f"{folder}/anchors")
    anchors = spark.read.schema(f"{_ROWS}, block int").parquet(f"{folder}/anchors")
    spark.createDataFrame([], _PAIRS).write.parquet(f"{folder}/pairs")
    for n in range(blocks):
        held = anchors.where(F.col("block") == n).select("id", "label", "vector").toArrow()
        if not held.num_rows:
            continue
        these = {"id": held["id"].to_numpy(), "label": held["label"].to_numpy(), "x": _matrix(held["vector"], width)}
        asked: list[Ask] = [(p, None, None, None, None) for p in range(held.num_rows)]
        floors = _floors(search(leaves, width, these, asked, positives, True, home=True), positives)
        asked = [(*a[:4], floors.get(a[:2])) for a in asked]
        _best(search(leaves, width, these, asked, positives, True), positives).write.parquet(f"{folder}/positives-{n}")
        found = spark.read.parquet(f"{folder}/positives-{n}").select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("top"))
        tops = [(r["anchor"], r["top"]) for r in found.select("anchor", "top").distinct().collect()]  # `positives` for each anchor of the block at most
        asked = [(a, p, -(-window[0] * p // 100), window[1] * p // 100, None) for a, p in tops]
        asked = [a for a in asked if a[2] <= a[3]]
        floors = _floors(search(leaves, width, these, asked, negatives, False, home=True), negatives)
        asked = [(*a[:4], floors.get(a[:2])) for a in asked]
        best = _best(search(leaves, width, these, asked, negatives, False), negatives)
        names = F.broadcast(spark.createDataFrame([(i, int(v)) for i, v in enumerate(these["id"])], "anchor int, anchor_id bigint"))
        pairs = found.join(best.select("anchor", "top", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor", "top"]).join(names, "anchor")
        pairs.select("anchor_id", "positive_id", "rank", "negative_id", F.col("top").alias("positive_score"), "negative_score").write.mode("append").parquet(f"{folder}/pairs")
    return spark.read.schema(_PAIRS).parquet(f"{folder}/pairs")


def op13_str_rtree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of `embeddings` for the anchors whose vec_id is divisible by 100; rows whose vec_id is divisible by 7 have the next label."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select(F.col("vec_id").cast("bigint").alias("id"), label.cast("int").alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives(rows.withColumn("anchor", F.col("id") % 100 == 0))
