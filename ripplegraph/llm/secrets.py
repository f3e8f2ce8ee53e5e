"""Operator 11: secrets by fixed patterns, and by the bytes they add to a compressor that knows the code around them.

A string that stands in a sensitive context is compressed with its surroundings and without, by zstandard primed with the corpus's own
identifiers. Names, words and repeated settings cost a few bytes each; a string that costs nearly as many bytes as random
characters of its alphabet do in its place is reported.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.session import table

#: Words of the identifier dictionary, the most frequent of the corpus; the commonest stand last, where a match costs least.
DICTIONARY = 4_096
#: Bytes before and after a candidate that count as its surroundings, and those before it that may hold a sensitive word on its line.
BEFORE, AFTER, NEAR = 256, 128, 48
#: A candidate's least length, and the least share of the bytes of its random control that it must add.
LEAST, NOVEL = 16, 0.9
#: zstandard's level with an optimal parse and matches from 3 bytes on, and the bytes of the dictionary's end that every input begins with: they cost one match and make the block worth compressing.
LEVEL, LEAD = 19, 1_024

# The kinds of the base, in their order, with the pattern and the least length of a group.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
LEAST_ASSIGNED = 6
#: Words that make a context sensitive.
SENSITIVE = ("password", "passwd", "passphrase", "secret", "token", "apikey", "api key", "api_key", "api-key", "access key", "access_key", "private key", "private_key",
             "credential", "bearer", "authorization", "signature", "signing", "session_id", "cookie")
#: Words of names and placeholders in settings, beside those that the corpus teaches.
NAMES = """access account admin app application auth authorization bearer bucket build cache callback cert certificate change client code config connection content cookie create
credential current data database default delete deploy dev device digest domain email enabled endpoint env environment error example expired expires field file from get hash header
here host http https id identity instance key kind label length license local login manager master message method mode model module name namespace nonce number object option output
param parameter passphrase password path payload permission place placeholder policy port prefix private prod production profile project protocol provider proxy public query random refresh
region remote replace request required reset resource response rest role root salt sandbox schema scope secret security server service session setting signature signing source staging
state status storage string suffix system table template test text timeout timestamp token type update upload url user username validate value variable verify version webhook with your"""
_CONTEXT = re.compile(b"(?i:" + b"|".join(re.escape(w).encode() for w in SENSITIVE) + rb")")
_CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
#: A row that holds neither has no span of any kind: candidates stand after a sensitive word, and the base's first kind is one.
_ANY = "(?i:" + "|".join(re.escape(w) for w in SENSITIVE) + ")|AKIA|[0-9a-f]{24}"
# Alphabets, the narrowest first.
_ALPHABETS = ("0123456789", "0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz_-", "ABCDEFGHIJKLMNOPQRSTUVWXYZ_-", "abcdefghijklmnopqrstuvwxyz0123456789_-", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-",
              "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")


def identifiers(docs: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The most frequent words (letters and _, 4 to 24 of them, in lower case) of all texts, the commonest first. Words with digits are left out, so copies of a key don't teach it."""
    words = docs.select(F.explode(F.split(F.lower("text"), "[^a-z0-9_]+")).alias("word"))
    words = words.where((F.length("word") >= 4) & (F.length("word") <= 24) & ~F.col("word").rlike("[0-9]"))
    top = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(size)
    return [r["word"] for r in top.collect()]


@lru_cache(maxsize=2)
def _primed(words: tuple[str, ...]) -> tuple[Callable[[bytes], bytes], bytes]:
    """Compression primed with the identifiers, and the text that its inputs begin with."""
    more = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    text = " ".join([*reversed(words), *NAMES.split()]).encode()
    primer = zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primer.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=primer, **more).compress, text[-LEAD:]


def control(candidate: bytes) -> bytes:
    """Random characters, fixed by the candidate, of its length and of the narrowest alphabet that holds it."""
    chars = next((a for a in _ALPHABETS if not candidate.translate(None, a.encode())), _ALPHABETS[-1]).encode()
    drawn = hashlib.shake_128(candidate).digest(2 * len(candidate))
    return bytes(chars[(drawn[2 * i] << 8 | drawn[2 * i + 1]) % len(chars)] for i in range(len(candidate)))


def _without(text: bytes, start: int, end: int, part: bytes) -> bytes:
    """text[start:end] without copies of the part, those that an end cuts included."""
    n = len(part)
    head, tail = text.find(part, max(0, start - n + 1), start + n - 1), text.find(part, max(start, end - n + 1), end + n - 1)
    return text[head + n if 0 <= head < start else start : tail if tail >= 0 else end].replace(part, b"")


def novelty(text: bytes, start: int, end: int, words: tuple[str, ...]) -> float:
    """Bytes that text[start:end] adds to its compressed surroundings, as a share of those that its random control adds. Other copies of it there don't count."""
    candidate = text[start:end]
    before, after = _without(text, max(0, start - BEFORE), start, candidate), _without(text, end, min(len(text), end + AFTER), candidate)
    pack, lead = _primed(words)
    alone, own, drawn = (len(pack(lead + before + middle + after)) for middle in (b"", candidate, control(candidate)))
    return (own - alone) / max(1, drawn - alone)


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping within a kind; by start, then kind. Offsets are bytes."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_ASSIGNED]
    found += [(m.start(), kind, m.end()) for kind, pattern in ((1, ACCESS), (2, HEX)) for m in pattern.finditer(text)]
    return sorted(found)


def novel_spans(text: bytes, base: list[tuple[int, int, int]], words: tuple[str, ...], least: float = NOVEL) -> list[tuple[int, int, int]]:
    """(start, kind, end) of incompressible strings that follow a sensitive word on their line and lie in no span of the base."""
    out, heads = [], np.array([b[0] for b in base], np.int64)
    reach = np.maximum.accumulate(np.array([b[2] for b in base], np.int64)) if base else heads
    done = 0
    for word in _CONTEXT.finditer(text):
        stop = text.find(b"\n", word.end(), word.end() + NEAR)
        at = max(done, word.end())
        while (m := _CANDIDATE.search(text, at)) and m.start() <= (stop if stop >= 0 else word.end() + NEAR):
            at = done = m.end()
            k = int(np.searchsorted(heads, m.start(), "right")) - 1
            if (k < 0 or reach[k] < m.end()) and novelty(text, m.start(), m.end(), words) >= least:
                out.append((m.start(), 3, m.end()))
    return out


def _report(text: bytes, words: tuple[str, ...]) -> tuple[int, int, int, str, str, int]:
    base = base_spans(text)
    every = sorted(base + novel_spans(text, base, words))
    if not every:
        return _NONE
    place = None if text.isascii() else np.r_[0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)]
    at = (lambda b: b) if place is None else (lambda b: int(place[b]))
    show = lambda spans: ",".join(f"{KINDS[k]}:{at(s)}:{at(e)}" for s, k, e in spans)
    count = [sum(k == kind for _, k, _ in every) for kind in range(4)]
    return (*count[:3], hashlib.sha256(show(base).encode()).hexdigest(), show(every), count[3])


_NONE = (0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0)
_COLUMNS = {"n_assign": pa.int64(), "n_access": pa.int64(), "n_hex": pa.int64(), "base_sha256": pa.string(), "spans": pa.string(), "n_novel": pa.int64()}


def find_secrets(docs: DataFrame, words: list[str]) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel of every document (doc_id, text), whole texts.

    spans lists kind:start:end in code points, by start, then kind. A null or empty text has none. Repeated rows and ids are reported row by row.
    """
    known = tuple(words)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string())
            rows = [_NONE] * batch.num_rows
            maybe = pc.match_substring_regex(texts, _ANY).fill_null(False).to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(maybe):
                rows[i] = _report(texts[i].as_buffer().to_pybytes(), known)
            columns = list(zip(*rows)) or [[] for _ in _COLUMNS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, _COLUMNS.values())]], ["doc_id", *_COLUMNS])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_novel bigint")


def op11_zstd_novelty_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of all documents, the compressor primed with the words of all documents."""
    docs = table(spark, sf_dir, "documents")
    return find_secrets(docs, identifiers(docs))
