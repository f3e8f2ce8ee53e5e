"""N-gram Jaccard join: MinHash banding, verified on full n-gram sets.

1. Equal texts are one class of copies; everything below handles each different text once.
2. A text's MinHash signature over its five-word shingles is cut into bands; band and row counts are chosen
   for a target recall at the threshold. Band hashes are shuffled, and each text of a bucket is tied to the
   bucket's least text: a star, never all pairs.
3. Connected texts (usually a handful) form a group. A large group is cut into classes by the number of shingles, of
   which only neighbours can hold links, and the classes into blocks of bounded size. Blocks are compared on the
   full shingle sets, so links that banding saw only through a third text are found too.
   A task holds two blocks; no pair of a block leaves it, only each text's number of links and a
   spanning forest of the verified links.
4. The components of the verified links are the classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplegraph.llm import textbytes as tb
from ripplegraph.session import join_counted, materialize, table

WIDTH, THRESHOLD = 5, 0.8
RECALL, MOST_HASHES = 0.9995, 128
#: Most texts of a block, and shingles that it holds at about; a task compares two. Each text of a group of m meets about m / BLOCK blocks.
BLOCK, BLOCK_SHINGLES = 256, 1 << 18
#: Edges or nodes, of about 100 bytes each, that a task of the components reads.
ROWS_IN_TASK = 100_000


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest false candidates, that reach the recall at the threshold within the hash budget."""
    best = None
    for rows in range(1, most_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows > most_hashes:
            break
        best = bands, rows
    if best is None:
        raise ValueError("no banding reaches the recall within the hash budget")
    return best


def band_hashes(column: pa.Array, bands: int, rows: int, width: int = WIDTH) -> np.ndarray:
    """A bands-wide array of band hashes for each text; texts without words get zeros."""
    k = bands * rows
    factor, offset = tb.constants(k, 11) | np.uint64(1), tb.constants(k, 12)
    out = np.zeros((len(column), bands), np.uint64)
    mark = tb.constants(bands, 13)
    for first, data, offsets in tb.chunks(column):
        n = len(offsets) - 1
        grams, owner = tb.shingles(*tb.words(data, offsets), width)
        if not len(grams):
            continue
        begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        least = np.empty((len(begin), k), np.uint64)
        for j in range(k):
            least[:, j] = np.minimum.reduceat(grams * factor[j] + offset[j], begin)
        hashed = np.zeros((len(begin), bands), np.uint64) + mark
        for r in range(rows):
            hashed = tb.mix64(hashed ^ least[:, r::rows][:, :bands])
        out[first + owner[begin]] = hashed
    return out


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, node (the MD5 of the text, null without words) and bands of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed = band_hashes(batch.column(2), bands, rows)
            some = (hashed != 0).any(axis=1)
            size = np.where(some, bands, 0)
            lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(size)].astype(np.int32), pa.array(hashed[some].ravel().view(np.int64)))
            node = pa.array(batch.column(1).to_numpy(zero_copy_only=False), pa.string(), mask=~some)
            yield pa.RecordBatch.from_arrays([batch.column(0), node, lists], ["doc_id", "node", "bands"])

    return docs.select("doc_id", F.md5("text").alias("md5"), "text").mapInArrow(run, "doc_id long, node string, bands array<long>")


def _gathered(df: DataFrame, rows: int) -> DataFrame:
    """A materialised table of at most `rows` rows in as many parts as it needs: one for each core, or each ROWS_IN_TASK rows if those are more."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_IN_TASK)))


def components(edges: DataFrame, left: str = "a", right: str = "b", most_rounds: int = 40) -> DataFrame:
    """node, root (its component's least node) for every node of the edges: alternating large and small stars (Kiveris and others, 2014).

    Each round is two aggregations, whose minima combine before the shuffle, and two joins, in which the centre of a large star
    meets its rows by broadcast (join_counted), so none brings them together. Rounds grow as the logarithm of the components; they
    end as soon as every component is a star. The driver keeps a record of each task, so tables are read in no more parts than their rows need.
    """
    spark = edges.sparkSession
    edges = materialize(edges.where(F.col(left) != F.col(right)).select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).distinct())
    for _ in range(most_rounds):
        # Of each node: its least neighbour, and how many are larger and how many smaller than it.
        both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        larger = F.col("v") > F.col("u")
        nodes = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(larger).alias("n"), F.count_if(~larger).alias("below")))
        # In a star the centre has no smaller node beside it and every other node has the centre alone.
        open_nodes, n_edges = nodes.agg(F.count_if((F.col("below") > 1) | ((F.col("below") > 0) & (F.col("n") > 0))), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not open_nodes:
            return nodes.select(F.col("u").alias("node"), F.least("u", "m").alias("root"))
        # No table of the round has more rows than the edges, but for the nodes.
        nodes, edges = _gathered(nodes, 2 * n_edges), _gathered(edges, n_edges)
        # Large star: every larger neighbour of u is tied to the least of u and its neighbours.
        least = nodes.where("n > 0").select("u", F.least("u", "m").alias("m"), "n")
        large = join_counted(edges.select(F.col("v").alias("u"), F.col("u").alias("v")), least, ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours are tied to the least of them.
        large = _gathered(materialize(large), n_edges)
        least = _gathered(materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))), n_edges)
        small = join_counted(large, least, ["u"], "n").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = _gathered(materialize(small), n_edges)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds on {spark.sparkContext.appName}")


def shingle_sets(column: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    out = []
    for _, data, offsets in tb.chunks(column):
        grams, owner = tb.shingles(*tb.words(data, offsets), width)
        at = tb.bounds(owner, len(offsets) - 1)
        out += [np.unique(grams[at[i] : at[i + 1]]) for i in range(len(offsets) - 1)]
    return out


def linked(sets: list[np.ndarray], threshold: float = THRESHOLD) -> np.ndarray:
    """A boolean matrix: is the Jaccard similarity of two sets at least the threshold? The diagonal is False.

    Shingles that one set alone has count in its size; the others make a 0/1 matrix, multiplied in
    slices of bounded width.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], float)
    owner = np.repeat(np.arange(n), size.astype(int))
    every = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.r_[True, every[1:] != every[:-1]] if len(every) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    shared = np.bincount(group)[group] > 1 if len(every) else new
    owner, group = owner[shared], group[shared]
    _, group = np.unique(group, return_inverse=True)
    both = np.zeros((n, n))
    step, top = 4096, int(group.max()) + 1 if len(group) else 0
    edge = np.searchsorted(group, np.arange(0, top + step, step))
    for i in range(len(edge) - 1):
        g, o = group[edge[i] : edge[i + 1]] - i * step, owner[edge[i] : edge[i + 1]]
        m = np.zeros((n, step), np.float32)
        m[o, g] = 1
        both += m @ m.T
    # J >= t, without division: |A and B| >= t (|A| + |B| - |A and B|).
    out = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
    np.fill_diagonal(out, False)
    return out


def _forest(link: np.ndarray) -> list[tuple[int, int]]:
    parent = list(range(len(link)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = []
    for i, j in zip(*np.nonzero(np.triu(link))):
        a, b = find(i), find(j)
        if a != b:
            parent[b] = a
            edges.append((int(i), int(j)))
    return edges


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """One pair of blocks of a group: each text's links in it, and a spanning forest (links 0, with the other's node)."""
    pdf = pdf.sort_values("node", kind="stable").reset_index(drop=True)
    link = linked([np.frombuffer(s, np.uint64) for s in pdf["grams"]])
    if pdf["across"].iloc[0]:  # pairs inside a block are counted where it meets itself
        side = pdf["block"].to_numpy()
        link &= side[:, None] != side[None, :]
    node = pdf["node"].tolist()
    rows = [(node[i], int(d), None) for i, d in enumerate(link.sum(axis=1)) if d]
    rows += [(node[i], 0, node[j]) for i, j in _forest(link)]
    return pd.DataFrame(rows, columns=["node", "links", "other"]).astype({"links": "int64"})


def verify(texts: DataFrame, block: int | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """node, links, other from (node, root, text): block by block inside each root's group.

    Sets whose sizes differ by more than the factor 1 / threshold can't be linked, so with size classes of that width a text
    meets the blocks of its own class and of the two beside it. A group that fits one block is not cut.
    """
    block, width = block or BLOCK, -math.log(threshold) + 1e-9

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shingle_sets(batch.column(2))
            size = pa.array([int(math.log(max(len(s), 1)) / width) for s in found], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), size, pa.array([s.tobytes() for s in found], pa.binary())], ["node", "root", "size", "grams"])

    made = materialize(texts.select("node", "root", "text").mapInArrow(sets, "node string, root string, size int, grams binary"))
    # A row for each root and size class: at most a hundred or so for each group, whatever its texts.
    counts = made.groupBy("root", "size").agg(F.count("*").alias("n"))
    group, by_size = Window.partitionBy("root"), Window.partitionBy("root").orderBy("size")
    each = F.least(F.lit(block), F.greatest(F.floor(BLOCK_SHINGLES / F.exp(width * (F.col("size") + 1))), F.lit(16)))
    counts = counts.withColumn("whole", F.sum(F.col("n") / each).over(group) <= 1).withColumn("parts", F.when(F.col("whole"), 1).otherwise(F.ceil(F.col("n") / each)).cast("int"))
    beside = lambda move, d: F.when((move("size").over(by_size) - F.col("size") == d) & ~F.col("whole"), move("parts").over(by_size)).otherwise(0)
    counts = counts.withColumn("below", beside(F.lag, -1)).withColumn("above", beside(F.lead, 1)).withColumn("share", F.col("n"))
    placed = join_counted(made, materialize(counts), ["root", "size"], "share")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("mine")
    placed = placed.select("node", "root", F.when(F.col("whole"), 0).otherwise(F.col("size")).alias("size"), own, "parts", "below", "above", "grams")
    # (class and block) of the lower and the upper of the two blocks that meet.
    blocks = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    cell = lambda s1, b1, s2, b2: F.struct(s1.alias("s1"), b1.alias("b1"), s2.alias("s2"), b2.alias("b2"))
    size, mine = F.col("size"), F.col("mine")
    meets = F.concat(
        F.transform(blocks(F.col("parts")), lambda o: cell(size, F.least(o, mine), size, F.greatest(o, mine))),
        F.transform(blocks(F.col("below")), lambda o: cell(size - 1, o, size, mine)),
        F.transform(blocks(F.col("above")), lambda o: cell(size, mine, size + 1, o)),
    )
    side = F.concat_ws(":", "size", "mine").alias("block")
    met = placed.select("node", "root", side, "grams", F.inline(meets))
    # One column for the whole key, as each column costs a conversion for each small group.
    across = ((F.col("s1") != F.col("s2")) | (F.col("b1") != F.col("b2"))).alias("across")
    met = met.select(F.concat_ws(":", "root", "s1", "b1", "s2", "b2").alias("cell"), "node", "block", "grams", across)
    return met.groupBy("cell").applyInPandas(_compare, "node string, links long, other string")


def join_ngrams(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), n_links (other texts with similarity >= the threshold), copies (rows with its text), node and keeper of every row.

    Texts without words (null, empty, white space) link to nothing: each row is its own class, node null.
    A text of fewer than five words has one shingle, of all its words. Null ids count as none: a class with
    no other id has class_id null; keeper is the node of its text with the least id, then the least node. Repeated rows are copies of each other. An empty table gives an
    empty result; extra columns are not read.
    """
    bands, rows = choose_bands(THRESHOLD, recall)
    found = materialize(signatures(docs, bands, rows))
    copies = found.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"))
    # Equal texts have equal bands: any row of a text speaks for it.
    spoken = found.where("node is not null").select("node", F.explode("bands").alias("band"))
    buckets = materialize(spoken.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("n")).where("least < most").select("band", "least", "n"))
    stars = join_counted(spoken, buckets, ["band"], "n").where("node > least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    groups = materialize(components(stars))
    # One row speaks for a text, so copies don't meet in one task: the join is on the least id, the text's hash a check.
    reps = groups.join(copies, "node").select("node", "root", "id")
    own = docs.select("doc_id", "text")
    texts = own.join(reps, F.col("doc_id").eqNullSafe(F.col("id")) & (F.md5("text") == F.col("node"))).groupBy("node", "root").agg(F.first("text").alias("text"))
    checked = materialize(verify(texts))
    links = checked.where("other is null").groupBy("node").agg(F.sum("links").alias("n_links"))
    roots = components(checked.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    known = copies.join(roots, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = materialize(known)
    least = known.groupBy("root").agg(F.min("id").alias("class_id"), F.min(F.struct(F.col("id").isNull(), "id", "node"))["node"].alias("keeper"))
    known = known.join(least, "root").select(F.col("node").alias("__n"), "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "copies", "keeper")
    out = found.select("doc_id", "node").join(known, F.col("node") == F.col("__n"), "left")
    return out.select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), "node", "keeper")


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, its keeper with the least doc_id; columns as they came.

    Rows that repeat the kept id and text are one document. A class without ids keeps one row of its least text, and
    rows without words (null, empty or blank texts), each its own class, all stay. An empty table gives an empty result.
    """
    own = docs.columns
    joined = join_ngrams(docs.select("doc_id", "text"))
    kept = joined.where((F.col("node") == F.col("keeper")) & F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("__id"), F.col("node").alias("__node")).distinct()
    rows = docs.withColumn("__own", F.when(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")), F.md5("text")))
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__node"))
    matched = rows.join(kept, on).dropDuplicates(["__node"]).select(*own)
    return matched.unionByName(rows.where("__own is null").select(*own))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_ngrams(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "copies")
