"""Words, shingles and byte statistics of whole texts, a batch at a time in numpy.

A word is a run of ``[^\\x20\\x09-\\x0D]``, with A-Z read as a-z. It is known by a 64-bit hash: a
polynomial in an odd base over random 64-bit codes of its bytes, then mixed. The hash of every
word comes from one running sum over the batch. With ``NO_WORD`` in place of ``WHITE_SPACE``
all ASCII characters but letters and digits part words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
SLICE_ROWS = 1 << 16
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.default_rng(20260).integers(0, 1 << 64, 256, dtype=_U, endpoint=False)
_CODES[65:91] = _CODES[97:123]
WHITE_SPACE = np.zeros(256, bool)
WHITE_SPACE[[0x20, *range(0x09, 0x0E)]] = True
NO_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_powers: dict[int, np.ndarray] = {}


@dataclass
class Slice:
    """Some consecutive documents: bytes end to end, and where each begins (and the last ends)."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def size(self) -> int:
        return len(self.bounds) - 1


def slices(texts: pa.Array, most_bytes: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a column of strings into slices of about ``most_bytes``; null counts as empty.

    A slice has ``SLICE_ROWS`` documents at most, and one at least, however long.
    """
    texts = pc.fill_null(texts, "" if not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1
        to = min(max(to, at + 1), at + SLICE_ROWS, len(texts))
        yield Slice(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1 modulo 2 ** 64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, SLICE_BYTES), base, _U)
        steps[0] = 1
        known = _powers[base] = np.cumprod(steps, dtype=_U)
    return known[:n]


def word_bounds(part: Slice, gaps: np.ndarray = WHITE_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; ``gaps`` says which bytes are between words."""
    inside = ~gaps[part.data]
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = part.bounds[(part.bounds > 0) & (part.bounds < len(inside))]
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, _U)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_CODES[data] * _power(_BASE, len(data)), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _power(_INVERSE, len(data) + 1)[starts]
    return mix64(raw + (ends - starts).astype(_U))


def word_hashes(part: Slice, gaps: np.ndarray = WHITE_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and how many words precede each document."""
    starts, ends = word_bounds(part, gaps)
    return span_hashes(part.data, starts, ends), np.searchsorted(starts, part.bounds)


def shingle_hashes(words: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``width`` words inside documents; a shorter document is one run of all its words.

    Returns the hashes and how many precede each document; repeats are kept.
    """
    counts = np.diff(firsts)
    runs = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    before = np.concatenate([[0], np.cumsum(runs)])
    start = np.repeat(firsts[:-1] - before[:-1], runs) + np.arange(before[-1])
    length = np.minimum(np.repeat(counts, runs), width)
    out = np.zeros(len(start), _U)
    for k in range(width):
        there = length > k
        nxt = words[np.minimum(start + k, max(len(words) - 1, 0))] if len(words) else out
        out = np.where(there, mix64(out * _U(_BASE) + nxt), out)
    return mix64(out + length.astype(_U)), before


def distinct_sorted(values: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document: its distinct values in order."""
    owner = np.repeat(np.arange(len(before) - 1, dtype=np.uint16), np.diff(before))
    order = np.argsort(values)
    order = order[np.argsort(owner[order], kind="stable")]
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    kept = owner[fresh]
    return values[fresh], np.searchsorted(kept, np.arange(len(before)))
