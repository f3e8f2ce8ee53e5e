"""Toxicity: a counterfactual-regularised linear classifier.

A logistic model over the words that a text has and the stems (word beginnings) of its longer words, so that forms of
a word that training never saw still count. Identity terms in labelled sentences are swapped
for others of their group, and the squared change of the sentence's score is penalised (counterfactual logit
pairing; Garg and others, 2019), so that naming a group says little about toxicity by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.session import materialize, table

#: The documented bounds of training: labelled rows used (the first by hash of their id) and words and stems of the model.
MOST_ROWS, MOST_WORDS = 12_000, 1_500
THRESHOLD = 0.3
PAIRING, RIDGE = 2.0, 2e-4

#: Identity terms by group, in the languages of the corpus; a swap stays in its group. Our own list, replaceable.
IDENTITY = [
    ["people", "women", "men", "girls", "boys"],
    ["person", "woman", "man", "girl", "boy"],
    ["christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist"],
    ["christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists"],
    ["straight", "gay", "lesbian", "bisexual", "transgender", "queer"],
    ["black", "white", "asian", "latino", "arab", "african", "european"],
    ["immigrants", "refugees", "foreigners", "citizens", "neighbours"],
    ["disabled", "deaf", "blind", "autistic", "elderly", "young"],
    ["femmes", "hommes", "chrétiens", "musulmans", "juifs", "étrangers", "immigrés"],
    ["frauen", "männer", "christen", "muslime", "juden", "ausländer", "flüchtlinge"],
    ["mujeres", "hombres", "cristianos", "musulmanes", "judíos", "extranjeros", "inmigrantes"],
]
_SWAP = {w: (g, i) for g, group in enumerate(IDENTITY) for i, w in enumerate(group)}
#: Lengths of stems. Identity terms have none, so a swap changes the term's own weight alone.
STEMS = (5, 6, 7, 8)
#: Words whose features a task remembers.
_REMEMBERED = 200_000
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def text_words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def word_features(word: str) -> list[str]:
    """The word, and each stem that it goes on from, written stem+."""
    return [word] if word in _SWAP else [word, *(word[:k] + "+" for k in STEMS if len(word) > k)]


def text_features(text: str | None) -> set[str]:
    return {f for w in text_words(text) for f in word_features(w)}


def swaps(text: str | None) -> list[tuple[str, str]]:
    """(term, what stands for it in the swapped sentence) for each identity term of each sentence.

    Each sentence swaps a term for every other of its group; where the sentence has that one already, swapping removes the term ("").
    """
    out = []
    for sentence in _SENTENCE.split((text or "").lower()):
        have = set(_WORD.findall(sentence))
        for word in have & _SWAP.keys():
            group = IDENTITY[_SWAP[word][0]]
            out += [(word, "" if other in have else other) for other in group if other != word]
    return out


def held_out(doc_id="doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float]

    def score(self, text: str | None) -> float:
        z = self.bias + sum(self.weights[f] for f in text_features(text) & self.weights.keys())
        return float(1 / (1 + np.exp(-z)))


def fit(x: np.ndarray, y: np.ndarray, pairs: list[tuple[int, int, float]], pairing: float = PAIRING, ridge: float = RIDGE, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of least mean log loss + ridge/2 |w|^2 + pairing * sum n (w_a - w_b)^2 / rows; index -1 stands for no word. Accelerated gradient steps."""
    n, m = x.shape
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    pair = np.zeros((m + 1, m + 1))
    for i, j, count in pairs:
        c = 2 * pairing * count / n
        pair[i, i] += c
        pair[j, j] += c
        pair[i, j] -= c
        pair[j, i] -= c
    touched = np.flatnonzero(pair.any(axis=0)[:m])
    small = pair[np.ix_(touched, touched)]
    v = np.full(m, 1 / np.sqrt(max(m, 1)), x.dtype)
    for _ in range(20):
        v = (x @ v) @ x
        v /= max(np.linalg.norm(v), 1e-12)
    curve = 0.25 * (np.linalg.norm(x @ v) ** 2 / n + 1) + ridge + (np.abs(small).sum(axis=1).max() if len(touched) else 0)
    # The bias sees every row: bound the joint curvature by the sum.
    last_w, last_b = w.copy(), b
    for t in range(1, steps + 1):
        k = (t - 1) / (t + 2)
        yw, yb = w + k * (w - last_w), b + k * (b - last_b)
        # Products in the matrix's own precision: numpy would else copy the matrix for each.
        g = (1 / (1 + np.exp(-((x @ yw.astype(x.dtype)).astype(float) + yb))) - y) / n
        gw = (g.astype(x.dtype) @ x).astype(float) + ridge * yw
        if len(touched):
            gw[touched] += small @ yw[touched]
        last_w, last_b = w, b
        w, b = yw - gw / curve, yb - g.sum() / curve
    return w, b


def _prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pairs = [swaps(t) for t in pdf["text"]]
        yield pd.DataFrame({"y": pdf["y"], "words": [sorted(text_features(t)) for t in pdf["text"]], "a": [[p[0] for p in x] for x in pairs], "b": [[p[1] for p in x] for x in pairs]})


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_words: int = MOST_WORDS, pairing: float = PAIRING) -> Model:
    """Fit on at most most_rows labelled rows outside the held-out fold.

    Of contradicting labels of an id the higher counts; labels other than 0 and 1, and ids without a
    document, are not used. Without labels of both kinds the model scores the share of 1 (0 without any).
    """
    chosen = labels.where(F.col("toxic").isin(0, 1) & ~held_out()).groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").alias("y"))
    # Bounded by most_rows, so it may be broadcast.
    chosen = materialize(chosen.orderBy(F.xxhash64("__id"), "__id").limit(most_rows))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select(F.col("y").cast("int").alias("y"), "text")
    rows = materialize(rows.mapInPandas(_prepare, "y int, words array<string>, a array<string>, b array<string>"))
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < positive < n:
        share = positive / n if n else 0.0
        return Model(float(np.log((share + 1e-6) / (1 - share + 1e-6))), {})
    # Words by the size of their smoothed log odds ratio in standard errors.
    seen = rows.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.sum("y").cast("double").alias("p"), F.sum(1 - F.col("y")).cast("double").alias("q"))
    p, q, rp, rq = F.col("p") + 0.5, F.col("q") + 0.5, F.lit(positive + 0.5) - F.col("p"), F.lit(n - positive + 0.5) - F.col("q")
    z = (F.log(p / rp) - F.log(q / rq)) / F.sqrt(1 / p + 1 / q + 1 / rp + 1 / rq)
    known = F.col("word").isin(*_SWAP)
    ranked = seen.where((F.col("p") + F.col("q") >= 4) | known).withColumn("z", F.when(known, F.lit(1e9)).otherwise(F.abs(z)))
    vocab = [r.word for r in ranked.orderBy(F.desc("z"), "word").limit(most_words).collect()]
    number = {w: i for i, w in enumerate(vocab)}
    width = len(vocab)

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.zeros((len(pdf), width), bool)
            for i, have in enumerate(pdf["words"]):
                x[i, [number[w] for w in have if w in number]] = True
            yield pd.DataFrame({"y": pdf["y"], "x": [r.tobytes() for r in np.packbits(x, axis=1)]})

    # At most most_rows * most_words bits reach the driver.
    table_of = rows.select("y", "words").mapInPandas(bits, "y int, x binary").toPandas().sort_values(["x", "y"])
    x = np.unpackbits(np.frombuffer(b"".join(table_of["x"]), np.uint8).reshape(len(table_of), -1), axis=1)[:, :width].astype(np.float32)
    pairs = rows.select(F.explode(F.arrays_zip("a", "b")).alias("s")).groupBy("s.a", "s.b").count().collect()
    # A term that the sample doesn't have weighs nothing in the swapped sentence's score, like a removed one.
    pairs = sorted((number[a], number.get(b, -1), c) for a, b, c in pairs if a in number)
    w, b = fit(x, table_of["y"].to_numpy(float), [(i, j, float(c)) for i, j, c in pairs], pairing)
    return Model(b, {word: float(v) for word, v in zip(vocab, w)})


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """docs with a score (0 to 1) from every whole text; null and empty texts score the bias."""
    weights, bias = model.weights, model.bias

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, list[str]] = {}  # word -> its features that the model has; most words have none
        for texts in batches:
            z = np.full(len(texts), bias)
            for i, t in enumerate(texts):
                found: set[str] = set()
                for w in text_words(t):
                    has = known.get(w)
                    if has is None:
                        if len(known) >= _REMEMBERED:
                            known.clear()
                        has = known[w] = [f for f in word_features(w) if f in weights]
                    if has:
                        found.update(has)
                z[i] += sum(weights[f] for f in sorted(found))
            yield pd.Series(1 / (1 + np.exp(-z)))

    return docs.withColumn(out, of("text"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null doc_id: not held out. Null or empty text: the score of a text without words. Repeated rows score
    alike. An empty table gives an empty result; extra columns are not read.
    """
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier does not reject; columns as they came.

    Null ids, null or empty texts, repeated rows and empty tables as in classify: rows are kept or dropped by their text alone. Without
    usable labels in sf_dir every row has the same score, and with none of label 1 all stay.
    """
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, "__toxic_score").where(F.col("__toxic_score") < THRESHOLD).drop("__toxic_score")


def op3_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
