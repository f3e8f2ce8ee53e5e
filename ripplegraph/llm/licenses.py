"""License scans with a positional index of rare words.

Templates of licences are indexed by word: a posting is a template and the word's place in it. One pass counts in how many
texts each word of the templates stands, which gives its IDF. Of a template's mandatory phrase only the
rarest word keeps its postings, since a copy must have it; so of each file's licence words just the rare
ones lead anywhere, and the work grows with those, not with the templates. A second pass looks the words of each
file up: every posting met proposes where the template would begin, the mandatory phrase must stand there
word for word, and the other words are intersected by relative position.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.llm import textbytes as tb
from ripplegraph.llm.license_texts import TEXTS
from ripplegraph.session import table


def split_words(text: str) -> list[str]:
    """The words of the contract: A-Z lower-cased, runs of digits, letters and everything beyond ASCII."""
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


@dataclass(frozen=True)
class Template:
    """A licence's words, its mandatory phrase and its label. Base templates are the phrase alone."""

    label: str
    text: str
    phrase: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return split_words(self.text)

    @property
    def at(self) -> int:
        w, p = self.words, self.phrase.split()
        return next(i for i in range(len(w)) if w[i : i + len(p)] == p)


# The phrases and labels that every scan must find.
BASE = [
    Template("mit", "under the mit license", "under the mit license", True),
    Template("apache-2", "apache license version 2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", "cc by nc", True),
]
HEADERS = [Template(label, text, phrase) for label, phrase, text in TEXTS]
#: IDF-weighted share of a template's words that must stand at their relative positions, give or take SLACK words.
COVERAGE, SLACK = 0.6, 2

_INSIDE = tb.lookup(bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def vocabulary(templates: list[Template]) -> list[str]:
    return sorted({w for t in templates for w in t.words})


class Vocabulary:
    """Numbers of the templates' words in a text, found by hash."""

    def __init__(self, words: list[str]):
        joined = "\n".join(words).encode()
        self.data, self.offsets = np.frombuffer(joined, np.uint8), np.r_[0, len(joined)].astype(np.int64)
        hashes, _ = tb.words(self.data, self.offsets, _INSIDE)
        self.order = np.argsort(hashes)
        self.ranked = hashes[self.order]
        self.words = words

    def numbers(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, row) of each word."""
        data = _LOWER[data]
        start, end, row = tb.spans(data, offsets, _INSIDE)
        hashes = tb.span_hash(tb.prefix(data), start, end)
        at = np.searchsorted(self.ranked, hashes).clip(max=len(self.ranked) - 1)
        return np.where(self.ranked[at] == hashes, self.order[at], -1).astype(np.int32), row


def document_frequencies(docs: DataFrame, vocab: Vocabulary) -> tuple[int, np.ndarray]:
    """Rows, and of each word of the vocabulary the rows that have it: a few numbers from each task."""
    size = len(vocab.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, df = 0, np.zeros(size, np.int64)
        for batch in batches:
            rows += batch.num_rows
            for _, data, off in tb.chunks(batch.column(0)):
                wid, row = vocab.numbers(data, off)
                hit = wid >= 0
                df += np.bincount(np.unique(row[hit] * size + wid[hit]) % size, minlength=size)
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, seen]), pa.array(np.r_[rows, df[seen]])], ["wid", "n"])

    found = docs.select("text").mapInArrow(run, "wid long, n long").groupBy("wid").agg(F.sum("n").alias("n")).collect()  # a row a word
    got = {r.wid: r.n for r in found}
    return got.get(-1, 0), np.array([got.get(i, 0) for i in range(size)], np.int64)


class Index:
    """Postings by word, phrases and words of the templates, as arrays."""

    def __init__(self, templates: list[Template], number: dict[str, int], idf: np.ndarray):
        self.templates, self.idf = templates, idf
        phrases = [[number[w] for w in t.phrase.split()] for t in templates]
        words = [[number[w] for w in t.words] for t in templates]
        self.at = np.array([t.at for t in templates])
        self.base = np.array([t.base for t in templates])
        self.phrase_size = np.array([len(p) for p in phrases])
        self.phrase = np.full((len(templates), self.phrase_size.max()), -2)
        for i, p in enumerate(phrases):
            self.phrase[i, : len(p)] = p
        self.size = np.array([len(w) for w in words])
        self.begin = np.r_[0, np.cumsum(self.size)]
        self.words = np.concatenate([np.array(w) for w in words])
        self.weight = np.array([idf[w].sum() for w in words])
        # The rarest word of each phrase, and of these the postings (template, place), in order of the word.
        rarest = [max(range(len(p)), key=lambda i: (idf[p[i]], -i)) for p in phrases]
        postings = sorted((p[r], t, self.at[t] + r) for t, (p, r) in enumerate(zip(phrases, rarest)))
        self.posted_template, self.posted_place = np.array([p[1] for p in postings]), np.array([p[2] for p in postings])
        self.posted = np.searchsorted([p[0] for p in postings], np.arange(len(idf) + 1))

    def candidates(self, wid: np.ndarray, row: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(template, row, first word, coverage) of each place where a template's mandatory phrase stands; words by their number in the chunk."""
        count = np.where(wid >= 0, self.posted[wid + 1] - self.posted[wid], 0)
        hit = np.flatnonzero(count)
        many = count[hit]
        place = np.repeat(self.posted[wid[hit]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        t, first, r = self.posted_template[place], np.repeat(hit, many) - self.posted_place[place], np.repeat(row[hit], many)
        ok = np.ones(len(t), bool)
        for i in range(self.phrase.shape[1]):
            ok &= (i >= self.phrase_size[t]) | self._stands(wid, begin, r, first + self.at[t] + i, self.phrase[t, i])
        t, first, r = t[ok], first[ok], r[ok]
        size = self.size[t]
        owner = np.repeat(np.arange(len(t)), size)
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        word, at = self.words[self.begin[t[owner]] + inner], first[owner] + inner
        found = np.zeros(len(owner), bool)
        for shift in range(-SLACK, SLACK + 1):
            found |= self._stands(wid, begin, r[owner], at + shift, word)
        share = np.bincount(owner, self.idf[word] * found, len(t)) / self.weight[t]
        return t, r, first, np.minimum(share, 1.0)

    @staticmethod
    def _stands(wid: np.ndarray, begin: np.ndarray, row: np.ndarray, at: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Is the word at that place of that row?"""
        inside = (at >= begin[row]) & (at < begin[row + 1])
        return inside & (wid[np.where(inside, at, 0)] == word)


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, headers: list[Template] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every whole text.

    Null text: no words, no labels (empty strings), score 0, null places. Overlapping places all count. The score is the best
    coverage of a label given. Repeated rows are scanned each. An empty table gives an empty result; extra columns are not read.
    """
    templates = BASE + (HEADERS if headers is None else headers)
    words = vocabulary(templates)
    vocab, number = Vocabulary(words), {w: i for i, w in enumerate(words)}
    total, df = document_frequencies(docs, vocab)
    index = Index(templates, number, np.log((total + 1) / (df + 0.5)).clip(min=1e-6))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, off in tb.chunks(batch.column(1)):
                n = len(off) - 1
                wid, row = vocab.numbers(data, off)
                count = np.bincount(row, minlength=n)
                begin = np.r_[0, np.cumsum(count)]
                n_base, score = np.zeros(n, np.int64), np.zeros(n)
                first, last = [None] * n, [None] * n
                base_labels, labels = [""] * n, [""] * n
                t, r, start, share = index.candidates(wid, row, begin)
                keep = index.base[t] | (share >= coverage)
                found: dict[int, list[tuple[int, int, float]]] = {}
                for x in zip(r[keep].tolist(), t[keep].tolist(), (start - begin[r])[keep].tolist(), share[keep].tolist()):
                    found.setdefault(x[0], []).append(x[1:])
                for i, places in found.items():
                    base = [(templates[k].label, p) for k, p, _ in places if templates[k].base]
                    if base:
                        n_base[i], first[i], last[i] = len(base), min(p for _, p in base), max(p for _, p in base)
                    base_labels[i] = ",".join(sorted({label for label, _ in base}))
                    labels[i] = ",".join(sorted({templates[k].label for k, _, _ in places}))
                    score[i] = max(s for _, _, s in places)
                arrays = [batch.column(0).slice(at, n), pa.array(count, pa.int64()), pa.array(n_base), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(base_labels), pa.array(labels), pa.array(score)]
                yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in _SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, _SCHEMA)


def op9_rare_token_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
