"""Chat formatting: a hidden Markov model recovers the turns of a transcript.

A transcript is a sequence of lines. The hidden state of a line is its speaker's role and whether the line
begins a turn; what is seen is the kind of speaker marker at its start, its length and whether it ends in a
question mark. Start, transition and emission probabilities are counted on conversations with known
roles. Viterbi runs in blocks: each block of lines becomes one max-plus matrix (best score from the state before
it to its last state), the matrices of a conversation are chained for the best states between blocks, and
each block then decodes alone. That is the exact Viterbi path, and no task holds a long transcript.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplegraph.session import materialize, shuffle_partitions, table

ROLES = ["user", "assistant", "system"]
#: State 2 r: a line that begins a turn of role r; 2 r + 1: a later line of it. START stands before the first line.
STATES, START = 2 * len(ROLES), 2 * len(ROLES)
#: Messages of a block, and blocks (or groups of blocks) chained in one task.
BLOCK, CHAIN = 64, 2048
#: Speaker names by role, our own choice of what chat logs use.
NAMES = {"user": "user|human|prompter|question|customer|q", "assistant": "assistant|ai|bot|model|answer|agent|a", "system": "system|instructions|context|note"}
MARK = r"(?i)^\s*(?:#+\s*|\*\*|\[|<\|)?(?:%s)(?:\|>|\]|\*\*)?(?::|\s*$|(?<=\|>)|(?<=\]))"
#: What goes with an opening marker: closing stars and one blank; further white space is the message's own.
AFTER = r"(?:\*\*)?[ \t]?"
ANY = "|".join(NAMES.values())
_LENGTHS = [1, 40, 120, 400]
LENGTHS, SYMBOLS = len(_LENGTHS) + 1, (len(ROLES) + 1) * (len(_LENGTHS) + 1) * 2

#: How the query writes raw transcripts: a marker style for each conversation, one for each role.
STYLES = [
    ("User: ", "Assistant: ", "System: "),
    ("Human: ", "AI: ", "Instructions: "),
    ("Q: ", "A: ", "Note: "),
    ("### User\n", "### Assistant\n", "### System\n"),
    ("<|user|>", "<|assistant|>", "<|system|>"),
    ("[user] ", "[bot] ", "[system] "),
]
#: One message in this many is written without its marker.
UNMARKED = 8


def ordered_index(df: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """Number the rows of each group from 0 by the order columns, a large group being spread over many range partitions."""
    ranged = df.repartitionByRange(shuffle_partitions(df.sparkSession), group, *order)
    ranged = materialize(ranged.withColumn("__part", F.spark_partition_id()))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(group, "__part").agg(F.count("*").alias("__n"))
    starts = counts.select(F.col(group).alias("__g"), F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy(group, "__part").orderBy(*order)) - 1
    joined = ranged.withColumn("__place", place).join(starts, (F.col(group) == F.col("__g")) & (F.col("__part") == F.col("__p")))
    return joined.withColumn(out, (F.col("__start") + F.col("__place")).cast("long")).drop("__part", "__place", "__g", "__p", "__start")


def write_transcripts(messages: DataFrame) -> DataFrame:
    """conv, k (message order), source_role and text of each message as it stands in its raw transcript."""
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    rows = messages.select(conv.alias("conv"), "turn", F.col("role").alias("source_role"), F.coalesce("text", F.lit("")).alias("body"))
    rows = rows.withColumn("h", F.xxhash64("source_role", "body"))
    rows = ordered_index(rows, "conv", ["turn", "h"], "k")
    style = F.pmod(F.xxhash64("conv"), F.lit(len(STYLES)))
    pick = F.lit("")
    for i, marks in enumerate(STYLES):
        for role, mark in zip(ROLES, marks):
            pick = F.when((style == i) & (F.col("source_role") == role), F.lit(mark)).otherwise(pick)
    marked = F.pmod(F.xxhash64("conv", "k"), F.lit(UNMARKED)) != 0
    return rows.select("conv", "k", "source_role", F.concat(F.when(marked, pick).otherwise(F.lit("")), "body").alias("text"))


def _kind(line: Column) -> Column:
    kind = F.lit(len(ROLES))
    for i, role in reversed(list(enumerate(ROLES))):
        kind = F.when(F.regexp_like(line, F.lit(MARK % NAMES[role])), F.lit(i)).otherwise(kind)
    return kind


def symbol(line: Column) -> Column:
    """What the model sees of a line: marker kind, length class and question mark, as one number."""
    size = F.char_length(line)
    length = sum(((size >= b).cast("int") for b in _LENGTHS), F.lit(0))
    return ((_kind(line) * LENGTHS + length) * 2 + F.rtrim(line).endswith("?").cast("int")).cast("int")


def lines_of(transcripts: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv, block, k, n, line, symbol and source_role of every line; blocks are runs of messages, for the work's sake alone."""
    rows = transcripts.select("conv", F.floor(F.col("k") / block).alias("block"), "k", "source_role", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    return rows.withColumn("symbol", symbol(F.col("line")))


def learn(lines: DataFrame) -> dict[str, np.ndarray]:
    """Log start, transition and emission tables, counted with add-one smoothing on lines whose role is known; three bounded counts.

    Transitions inside a block come from its lines in order, those between blocks from one row for each.
    """
    role = F.lit(None).cast("int")
    for i, r in enumerate(ROLES):
        role = F.when(F.col("source_role") == r, F.lit(i)).otherwise(role)
    own = lines.withColumn("state", 2 * role + F.when(F.col("n") == 0, 0).otherwise(1)).where("state is not null")
    own = own.withColumn("next", F.lead("state").over(Window.partitionBy("conv", "block").orderBy("k", "n")))
    rows = own.groupBy("state", "next", "symbol", ((F.col("k") == 0) & (F.col("n") == 0)).alias("first")).count().collect()
    place = F.struct("k", "n")
    ends = own.groupBy("conv", "block").agg(F.min_by("state", place).alias("head"), F.max_by("state", place).alias("tail"))
    after = ends.select("conv", (F.col("block") - 1).alias("block"), F.col("head").alias("next"))
    between = ends.join(after, ["conv", "block"]).groupBy("tail", "next").count().collect()
    start, move = np.ones(STATES), np.full((STATES, STATES), 0.1)
    kind, length, question = np.ones((STATES, len(ROLES) + 1)), np.ones((STATES, LENGTHS)), np.ones((STATES, 2))
    for r in rows:
        if r["first"]:
            start[r["state"]] += r["count"]
        if r["next"] is not None:
            move[r["state"], r["next"]] += r["count"]
        seen = r["symbol"]
        kind[r["state"], seen // (2 * LENGTHS)] += r["count"]
        length[r["state"], seen // 2 % LENGTHS] += r["count"]
        question[r["state"], seen % 2] += r["count"]
    for r in between:
        move[r["tail"], r["next"]] += r["count"]
    share = lambda t: np.log(t / t.sum(axis=-1, keepdims=True))
    emit = (share(kind)[:, :, None, None] + share(length)[:, None, :, None] + share(question)[:, None, None, :]).reshape(STATES, -1)
    full = np.full((STATES + 1, STATES + 1), -np.inf)
    full[:STATES, :STATES], full[START, :STATES] = share(move), share(start)
    return {"move": full, "emit": np.vstack([emit, np.full(emit.shape[1], -np.inf)])}


def block_matrix(symbols: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    """Best log score from each state before the block to each state of its last line."""
    best = None
    for s in symbols:
        step = model["move"] + model["emit"][:, s][None, :]
        best = step if best is None else (best[:, :, None] + step[None, :, :]).max(axis=1)
    return best


def decode(symbols: np.ndarray, enter: int, leave: int, model: dict[str, np.ndarray]) -> list[int]:
    """The best states of a block's lines, with the state before it and its last state given."""
    score = np.full(STATES + 1, -np.inf)
    score[enter] = 0.0
    back = []
    for s in symbols:
        step = score[:, None] + model["move"] + model["emit"][:, s][None, :]
        back.append(step.argmax(axis=0))
        score = step.max(axis=0)
    path = [leave]
    for b in reversed(back[1:]):
        path.append(int(b[path[-1]]))
    return path[::-1]


def chain(mats: np.ndarray, enter: int, leave: int | None) -> list[int]:
    """The best last state of each matrix in a chain."""
    score = np.full(STATES + 1, -np.inf)
    score[enter] = 0.0
    back = []
    for m in mats:
        step = score[:, None] + m
        back.append(step.argmax(axis=0))
        score = step.max(axis=0)
    path = [int(score.argmax()) if leave is None else leave]
    for b in reversed(back[1:]):
        path.append(int(b[path[-1]]))
    return path[::-1]


_M = (STATES + 1) ** 2


def _mats(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["m"].to_list()).reshape(-1, STATES + 1, STATES + 1)


def chain_states(mats: DataFrame, most: int | None = None, fan: int = CHAIN) -> DataFrame:
    """conv, i, enter, leave from conv, i (0, 1, ...), m: long chains are first multiplied in groups of `fan`, level by level."""
    if most is None:
        most = mats.agg(F.max("i")).first()[0] or 0
    if most < fan:

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("i")
            leave = chain(_mats(pdf), START, None)
            return pd.DataFrame({"conv": pdf["conv"], "i": pdf["i"], "enter": [START, *leave[:-1]], "leave": leave})

        return mats.groupBy("conv").applyInPandas(whole, "conv string, i long, enter int, leave int")
    grouped = mats.withColumn("up", F.floor(F.col("i") / fan))

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        out = None
        for m in _mats(pdf.sort_values("i")):
            out = m if out is None else (out[:, :, None] + m[None, :, :]).max(axis=1)
        return pd.DataFrame({"conv": [pdf["conv"].iloc[0]], "i": [pdf["up"].iloc[0]], "m": [out.ravel()]})

    upper = materialize(grouped.groupBy("conv", "up").applyInPandas(product, "conv string, i long, m array<double>"))
    ends = chain_states(upper, most // fan, fan).withColumnRenamed("i", "up")

    def inner(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        enter = int(pdf["enter"].iloc[0])
        leave = chain(_mats(pdf), enter, int(pdf["leave"].iloc[0]))
        return pd.DataFrame({"conv": pdf["conv"], "i": pdf["i"], "enter": [enter, *leave[:-1]], "leave": leave})

    return grouped.join(ends, ["conv", "up"]).groupBy("conv", "up").applyInPandas(inner, "conv string, i long, enter int, leave int")


def parse(lines: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """conv, turn (recovered, from 0), role, n_lines, text (opening markers stripped) and source_role (of the turn's first line)."""
    item = F.struct("k", "n", "symbol", "line", "source_role")
    blocks = materialize(lines.groupBy("conv", "block").agg(F.sort_array(F.collect_list(item)).alias("items")))
    seen = blocks.select("conv", "block", F.col("items.symbol").alias("symbols"))

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            mats = [block_matrix(s, model) for s in pdf["symbols"]]
            yield pd.DataFrame({"conv": pdf["conv"], "i": pdf["block"], "m": [m.ravel() for m in mats], "alone": [int(m[START].argmax()) for m in mats]})

    # Dealt by number of blocks, not by bytes: a block costs the same whatever the bytes of its symbols.
    tasks = shuffle_partitions(lines.sparkSession)
    mats = materialize(seen.repartition(tasks, "conv", "block").mapInPandas(matrices, "conv string, i long, m array<double>, alone int"))
    # Most conversations are one block, which ends in its own best state; only the others are chained.
    lasts = materialize(mats.groupBy("conv").agg(F.max("i").alias("last")))
    mats = mats.join(lasts, "conv")
    alone = mats.where("last = 0").select("conv", "i", F.lit(START).alias("enter"), F.col("alone").alias("leave"))
    most = lasts.agg(F.max("last")).first()[0] or 0  # one number
    ends = alone if most == 0 else alone.unionByName(chain_states(mats.where("last > 0").select("conv", "i", "m"), most))
    ends = ends.withColumnRenamed("i", "block")

    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            path = [decode(s, e, z, model) for s, e, z in zip(pdf["symbols"], pdf["enter"], pdf["leave"])]
            begins = []
            for p, e in zip(path, pdf["enter"]):
                before = [int(e), *p[:-1]]
                begins.append([int(b == START or s % 2 == 0 or s // 2 != b // 2) for s, b in zip(p, before)])
            yield pd.DataFrame({"conv": pdf["conv"], "block": pdf["block"], "path": path, "begins": begins})

    decoded = seen.join(ends, ["conv", "block"]).repartition(tasks, "conv", "block").mapInPandas(states, "conv string, block long, path array<int>, begins array<int>")
    decoded = materialize(decoded.withColumn("opened", F.aggregate("begins", F.lit(0), lambda a, b: a + b)))
    # Turns opened before a block, summed over spans of blocks first, so no window holds a long conversation's blocks.
    before = lambda *by: F.coalesce(F.sum("opened").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slim = decoded.select("conv", "block", "opened", F.floor(F.col("block") / CHAIN).alias("span"))
    spans = slim.groupBy("conv", "span").agg(F.sum("opened").alias("opened")).select("conv", "span", before("conv", "span").alias("base"))
    earlier = slim.withColumn("inner", before("conv", "span", "block")).join(spans, ["conv", "span"]).select("conv", "block", (F.col("base") + F.col("inner")).alias("earlier"))
    decoded = decoded.join(earlier, ["conv", "block"])
    rows = blocks.join(decoded, ["conv", "block"]).select("conv", "block", "earlier", F.posexplode(F.arrays_zip("items", "path", "begins")).alias("at", "x"))
    inside = Window.partitionBy("conv", "block").orderBy("at")
    turn = (F.col("earlier") + F.sum("x.begins").over(inside) - 1).cast("long")
    rows = rows.select("conv", turn.alias("turn"), "x.path", "x.begins", "x.items.k", "x.items.n", "x.items.symbol", "x.items.line", "x.items.source_role")
    # Only a marker that opens the turn is one; the same words elsewhere are content.
    opens = (F.col("begins") == 1) & (F.floor(F.col("symbol") / (2 * LENGTHS)) == F.floor(F.col("path") / 2))
    rows = rows.withColumn("line", F.when(opens, F.regexp_replace("line", F.lit(MARK % ANY + AFTER), F.lit(""))).otherwise(F.col("line")))
    rows = rows.withColumn("bare", opens & (F.col("line") == ""))
    turns = rows.groupBy("conv", "turn").agg(F.sort_array(F.collect_list(F.struct("k", "n", "path", "line", "source_role", "bare"))).alias("l"))
    first = F.col("l")[0]
    # A line that held a marker alone is no line of the message.
    text = F.array_join(F.transform(F.filter("l", lambda x: ~x["bare"]), lambda x: x["line"]), "\n")
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), (F.floor(first["path"] / 2) + 1).cast("int"))
    return turns.select("conv", "turn", role.alias("role"), F.size("l").cast("long").alias("n_lines"), text.alias("text"), first["source_role"].alias("source_role"))


def format_conversations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, n_lines, rendered, source_role: the turns recovered from each conversation's raw transcript.

    Null conv_id: one conversation of all such messages. Null text: one empty line. Null or unknown roles
    are written without a marker and taught nothing. Messages that share a turn follow by the hash of role
    and text; repeated rows are repeated messages. An empty table gives an empty result; extra
    columns are not read.
    """
    lines = materialize(lines_of(write_transcripts(messages)))
    turns = parse(lines, learn(lines))
    conv_id = F.when(F.col("conv") == "", None).otherwise(F.col("conv")).cast("long")
    rendered = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>"))
    return turns.select(conv_id.alias("conv_id"), "turn", "role", "n_lines", rendered.alias("rendered"), "source_role")


def op10_hmm_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(table(spark, sf_dir, "conversations"))
