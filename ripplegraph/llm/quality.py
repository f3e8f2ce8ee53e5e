"""Quality rules with risk-controlled thresholds.

A rule rejects a document when a statistic exceeds a cutoff; a document is rejected if any rule rejects it. The cutoffs of all
rules form one ladder, fixed beforehand, from mild to strict. For each stratum (language) the labelled holdout
says how many good documents each step would reject, and steps are tested in order with the exact binomial
bound until the first that can't be certified (fixed-sequence testing, so the steps share no confidence);
the strata share it equally (Bonferroni). With chance 1 - delta no stratum loses more than the limit of its good
documents to the rules together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.llm import textbytes as tb
from ripplegraph.session import join_dimension, materialize, table

#: Most of a stratum's good documents that the rules together may reject, and the chance that this fails in any stratum.
LIMIT, DELTA = 0.01, 0.05
#: The statistics, each rejecting above a cutoff, and their cutoffs from mild to strict; a shorter list stays at its last.
RULES = {
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "duplicate_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "loud_share": "n_loud / greatest(n_words, 1)",
}
GRID = {
    "symbol_share": [2.0, 1.2, 0.8, 0.5, 0.3, 0.2, 0.1, 0.05, 0.02],
    "duplicate_line_share": [0.7, 0.5, 0.3, 0.2, 0.1, 0.05],
    "repeat_share": [0.3, 0.25, 0.2, 0.15, 0.1, 0.05],
    "word_length": [20.0, 15.0, 12.0, 10.0, 9.0, 8.0, 7.0, 6.0],
    "loud_share": [0.8, 0.5, 0.3, 0.2, 0.1, 0.05, 0.02],
}
STEPS = max(len(g) for g in GRID.values())
_SYMBOLS = tb.lookup(b"#*$%&|<>")
_LINE = tb.lookup(b"\n", inside=False)
_SCHEMA = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_loud long"


def _again(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur more than once, and has it occurred before?"""
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    more, before = np.empty(len(key), bool), np.empty(len(key), bool)
    more[order] = same[:-1] | same[1:]
    before[order] = same[:-1]
    return more, before


def base_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The base counts of each text of a column."""
    out = {c.split()[0]: np.zeros(len(column), np.int64) for c in _SCHEMA.split(", ")}
    for first, data, offsets in tb.chunks(column):
        n = len(offsets) - 1
        here = slice(first, first + n)
        running = tb.prefix(data)
        start, end, row = tb.spans(data, offsets, tb.WORD)
        per_row = lambda where: np.bincount(where, minlength=n)
        out["n_words"][here] = per_row(row)
        points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        out["word_chars"][here] = np.bincount(row, weights=points[end] - points[start], minlength=n).astype(np.int64)
        symbols = np.r_[0, np.cumsum(_SYMBOLS[data])]
        out["n_symbols"][here] = symbols[offsets[1:]] - symbols[offsets[:-1]]
        # Words of at least two ASCII capitals and no small letter.
        capitals = np.r_[0, np.cumsum((data >= 65) & (data <= 90))]
        small = np.r_[0, np.cumsum((data >= 97) & (data <= 122))]
        loud = (capitals[end] - capitals[start] >= 2) & (small[end] == small[start])
        out["n_loud"][here] = per_row(row[loud])
        # Lines with a word, equal to an earlier one of the same text.
        ls, le, lrow = tb.spans(data, offsets, _LINE)
        has = np.searchsorted(start, le) > np.searchsorted(start, ls)
        out["n_lines"][here] = per_row(lrow[has])
        ls, le, lrow = ls[has], le[has], lrow[has]
        salt = tb.constants(n, 5)
        _, before = _again(tb.span_hash(running, ls, le) ^ salt[lrow])
        out["n_dup_lines"][here] = per_row(lrow[before])
        # Words inside 8-word windows that the text has twice or more.
        grams, owner, at = tb.windows(tb.span_hash(running, start, end), row, 8)
        more, _ = _again(grams ^ salt[owner])
        cover = np.zeros(len(row) + 9, np.int64)
        np.add.at(cover, at[more], 1)
        np.add.at(cover, at[more] + 8, -1)
        out["n_repeat_words"][here] = per_row(row[np.cumsum(cover)[: len(row)] > 0])
    return out


def measure(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, __stratum and the base counts of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = base_counts(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(v) for v in counts.values()]], ["doc_id", "__stratum", *counts])

    rows = docs.select("doc_id", F.col(stratum).alias("__stratum"), "text")
    return rows.mapInArrow(run, f"doc_id long, __stratum string, {_SCHEMA}")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of the binomial distribution."""
    if p <= 0:
        return 1.0
    if p >= 1:
        return float(k >= n)
    lp, lq, base = math.log(p), math.log1p(-p), math.lgamma(n + 1)
    x = np.arange(k + 1)
    logs = base - np.array([math.lgamma(i + 1) + math.lgamma(n - i + 1) for i in x]) + x * lp + (n - x) * lq
    return float(min(1.0, np.exp(logs).sum()))


def upper_bound(k: int, n: int, delta: float) -> float:
    """The exact one-sided Clopper-Pearson upper bound of a rate, k of n seen, at confidence 1 - delta."""
    if n == 0 or k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if binomial_tail(k, n, mid) > delta else (lo, mid)
    return hi


def cutoff(rule: str, step: int) -> float:
    return GRID[rule][min(step, len(GRID[rule]) - 1)]


def choose_steps(counts: pd.DataFrame, limit: float = LIMIT, delta: float = DELTA) -> pd.DataFrame:
    """From stratum, step, good, good_above: the strictest certified step of each stratum, if any, and the bound of its false rejections."""
    share = delta / max(counts["stratum"].nunique(dropna=False), 1)
    rows = []
    for stratum, g in counts.groupby("stratum", dropna=False):
        best = None
        for r in g.sort_values("step").itertuples():
            # The bound is within the limit exactly if so few false rejections would be unlikely at the limit.
            if not r.good or binomial_tail(int(r.good_above), int(r.good), limit) > share:
                break
            best = r
        if best is not None:
            rows.append((stratum, int(best.step), upper_bound(int(best.good_above), int(best.good), share)))
    return pd.DataFrame(rows, columns=["stratum", "step", "bound"])


def rejected(step: int | None = None):
    """Does any rule reject at the step, or at the one in the column __step?"""
    out = F.lit(False)
    for rule, expression in RULES.items():
        limit = F.lit(cutoff(rule, step)) if step is not None else F.element_at(F.array(*[F.lit(cutoff(rule, i)) for i in range(STEPS)]), F.col("__step") + 1)
        out = out | (F.expr(expression) > limit)
    return out


def holdout_counts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum, good, step, good_above, bad_above over the labelled rows; one aggregation, a row per stratum out of it."""
    labels = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").alias("__good"))
    rows = rows.join(labels, F.col("doc_id") == F.col("__id"))
    above = lambda i, good: F.count_if(rejected(i) & (F.col("__good") == good))
    steps = [F.struct(F.lit(i).alias("step"), above(i, 1).alias("good_above"), above(i, 0).alias("bad_above")) for i in range(STEPS)]
    stats = rows.groupBy(F.col("__stratum").alias("stratum")).agg(F.count_if(F.col("__good") == 1).alias("good"), F.array(*steps).alias("t"))
    return stats.select("stratum", "good", F.inline("t"))


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", limit: float = LIMIT, delta: float = DELTA) -> DataFrame:
    """doc_id, n_words, the base counts, base_failed, kept and rule_failed of every row.

    Null text: no words, so base_failed. Null stratum: a stratum of its own. Of contradicting labels of an
    id the lower counts; labels other than 0 and 1 and ids without a row are not used. Repeated rows
    count each. Without labels, or with too few of a stratum, no step is certified and base_failed alone
    decides. An empty table gives an empty result; extra columns are not read.
    """
    rows = materialize(measure(docs, stratum))
    # A row for each stratum and step; languages, not documents.
    chosen = choose_steps(holdout_counts(rows, labels).toPandas(), limit, delta)
    table_rows = [(r.stratum if isinstance(r.stratum, str) else None, int(r.step)) for r in chosen.itertuples()]
    steps = docs.sparkSession.createDataFrame(table_rows, "__s string, __step int")
    rows = join_dimension(rows, steps, F.col("__stratum").eqNullSafe(F.col("__s")), "left", rows=len(table_rows))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = rows.withColumn("base_failed", base).withColumn("rule_failed", F.when(F.col("__step").isNull(), False).otherwise(rejected()))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.col("rule_failed")).alias("kept"), "rule_failed")


def op6_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
