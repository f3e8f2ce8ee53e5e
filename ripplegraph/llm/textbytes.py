"""Vectorised text primitives over Arrow string columns.

Python tasks see a batch of texts as one byte array with offsets, so tokenising, hashing and
shingling cost a few numpy passes per batch and nothing per word. Hashes are polynomials over the
bytes modulo the prime 2**61 - 1 followed by a bit mix; they depend on the bytes of a word alone. (Modulo 2**64
there are texts, such as the Thue-Morse sequence and its mirror, that collide at every base.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer single text is handled on its own.
CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15 % ((1 << 61) - 1)
_powers: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of the public-domain SplitMix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n reproducible 64-bit constants."""
    return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(0x9E3779B97F4A7C15))


_PLACE = constants(16, 2) | np.uint64(1)
_P = (1 << 61) - 1
_BYTE = (constants(256, 1) >> np.uint64(32)).astype(np.uint64)
_LOW31, _LOW30, _PRIME = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1), np.uint64(_P)


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for any 64-bit x."""
    x = (x & _PRIME) + (x >> np.uint64(61))
    return np.where(x >= _PRIME, x - _PRIME, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, for a and b below it."""
    ah, al, bh, bl = a >> np.uint64(31), a & _LOW31, b >> np.uint64(31), b & _LOW31
    mid = ah * bl + al * bh  # below 2**62
    # 2**62 = 2 and mid * 2**31 = (mid >> 30) * 2**61 + (mid & low) * 2**31
    return _mod(((ah * bh) << np.uint64(1)) + (mid >> np.uint64(30)) + ((mid & _LOW30) << np.uint64(31)) + _mod(al * bl))


def _pow(n: int, base: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo the prime."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.ones(1, np.uint64)
        step = base % _P
        while len(out) < max(n, CHUNK + 1):  # doubling: the second half is the first, times a power
            out = np.r_[out, _times(out, np.full(len(out), step, np.uint64))]
            step = step * step % _P
        _powers[base] = have = out[: max(n, CHUNK + 1)].copy()
        if len(have) > 16 * CHUNK:  # one very long text; don't keep its table
            _powers.pop(base)
    return have[:n]


def lookup(chars: bytes, inside: bool = True) -> np.ndarray:
    """A boolean table over bytes: True for those given, or for all others."""
    out = np.full(256, not inside)
    out[list(chars)] = inside
    return out


#: Words of the text contracts: runs of anything but space, \t, \n, \v, \f, \r.
WORD = lookup(b" \t\n\x0b\x0c\r", inside=False)


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of about CHUNK bytes; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial of the bytes, one longer than the data: sums of the terms' lower 31 bits and of the bits above."""
    power = _pow(len(data), _BASE)
    byte = _BYTE[data]  # of 32 bits, so its product with a power's half stays in 63
    high = power >> np.uint64(31)
    high *= byte
    term = power & _LOW31
    term *= byte
    # high * 2**31 = (high >> 30) * 2**61 + (high & low) * 2**31; the sum stays below 2**64 and needs no reduction here
    term += high >> np.uint64(30)
    high &= _LOW30
    high <<= np.uint64(31)
    term += high
    low, upper = np.zeros(len(data) + 1, np.uint64), np.zeros(len(data) + 1, np.uint64)
    np.cumsum(term & _LOW31, dtype=np.uint64, out=low[1:])
    term >>= np.uint64(31)
    np.cumsum(term, dtype=np.uint64, out=upper[1:])
    return low, upper


def span_hash(running: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    low, upper = running
    inverse = _pow(len(low), pow(_BASE, -1, _P))
    low, upper = low[end] - low[start], _mod(upper[end] - upper[start])
    # upper * 2**31, as in _times
    total = _mod((upper >> np.uint64(30)) + ((upper & _LOW30) << np.uint64(31)) + _mod(low))
    return mix64(_times(total, inverse[start]) + ((end - start).astype(np.uint64) << np.uint64(40)))


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of bytes of the class, never across rows."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    ins = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = ins.copy()
    first[1:] &= ~ins[:-1] | edge[1:n]
    last = ins.copy()
    last[:-1] &= ~ins[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word."""
    start, end, row = spans(data, offsets, inside)
    return span_hash(prefix(data), start, end), row


def windows(hashes: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, index of the first word) of each run of `width` words within a row."""
    m = len(hashes) - width + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[:m] == row[width - 1 :])
    total = np.zeros(len(at), np.uint64)
    for k in range(width):
        total += hashes[at + k] * _PLACE[k]
    return mix64(total), row[at], at


def shingles(hashes: np.ndarray, row: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row), by row, of the word n-grams; a shorter text with words has one, of all its words."""
    grams, owner, _ = windows(hashes, row, width)
    if not len(row):
        return grams, owner
    begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    count = np.diff(np.r_[begin, len(row)])
    short = count < width
    if short.any():
        keep = np.repeat(short, count)
        place = (np.arange(len(row)) - np.repeat(begin, count))[keep]
        part = hashes[keep] * _PLACE[place] + constants(width, 3)[np.repeat(count, count)[keep]]
        heads = np.r_[0, np.cumsum(count[short])[:-1]]
        grams = np.r_[grams, mix64(np.add.reduceat(part, heads))]
        owner = np.r_[owner, row[begin[short]]]
        order = np.argsort(owner, kind="stable")
        grams, owner = grams[order], owner[order]
    return grams, owner


def bounds(owner: np.ndarray, rows: int) -> np.ndarray:
    """Offsets of each row's stretch in an array sorted by row."""
    return np.searchsorted(owner, np.arange(rows + 1))
