"""Words and word n-grams of whole Arrow string columns as numpy arrays.

All separators used here are ASCII bytes, which never occur inside a multi-byte
UTF-8 character, so texts are cut on their bytes.  A batch is handled in slices
of about ``SLICE`` bytes of text, which bounds the memory of a task; one text
that is longer is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20

_U = np.uint64
#: Odd bases of the two rolling hashes, 3 modulo 8 so that few low bits are lost in powers.
_BYTE_BASE, _GRAM_BASE = _U(0x9E3779B97F4A7C13), _U(0xC2B2AE3D27D4EB4B)
_BYTE_VALUE = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)


def _table(pairs: list[tuple[int, int]], inside: bool) -> np.ndarray:
    out = np.full(256, not inside)
    for lo, hi in pairs:
        out[lo:hi + 1] = inside
    return out


#: Bytes that belong to words: all but white space, or all but ASCII other than digits and letters.
SPACED = _table([(0x20, 0x20), (0x09, 0x0D)], False)
ALNUM = _table([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)], True)
NOT_LF = _table([(0x0A, 0x0A)], False)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
SAME = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finisher of 64-bit hashes."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=8)
def _powers_upto(base: int, size: int) -> np.ndarray:
    out = np.full(size + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """Powers 0 to n of an odd base modulo 2^64; only tables for whole slices are kept."""
    return (_powers_upto(int(base), SLICE) if n <= SLICE else _powers_upto.__wrapped__(int(base), n))[: n + 1]


def _inverse(base: np.uint64) -> np.uint64:
    return _U(pow(int(base), -1, 2**64))


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``SLICE`` bytes of text."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes)
    begin, done = 0, 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(total, done + SLICE, side="right")))
        yield batch.slice(begin, end - begin)
        begin, done = end, int(total[end - 1])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of n texts: byte positions, the text of each word, the first word of each text."""

    raw: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray       # n + 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @cached_property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    @cached_property
    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        n = len(self.raw)
        power = _powers(_BYTE_BASE, n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUE[self.raw] * power[:n], out=sums[1:])
        back = _powers(_inverse(_BYTE_BASE), n)
        return mix((sums[self.ends] - sums[self.starts]) * back[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the k words from each word on, and whether those lie in one text."""
        return unit_grams(self.hashes, self.doc, k)


def unit_grams(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive units from each position on, and whether they belong to one document."""
    n = len(hashes)
    m = max(0, n - k + 1)
    if not m:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    power = _powers(_GRAM_BASE, n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * power[:n], out=sums[1:])
    return mix((sums[k:] - sums[:m]) * _powers(_inverse(_GRAM_BASE), n)[:m] + _U(k)), doc[:m] == doc[k - 1:]


def words_of(texts: pa.Array, member: np.ndarray = SPACED, fold: np.ndarray = SAME) -> Words:
    """Cut each text into maximal runs of ``member`` bytes after mapping bytes by ``fold``."""
    raw, offsets = text_bytes(texts)
    if fold is not SAME:
        raw = fold[raw]
    inside = member[raw]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(raw))]     # words do not run on into the next text
    begin[edge] = inside[edge]
    end[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(begin)
    return Words(raw, offsets, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets))


def lines_of(texts: pa.Array) -> Words:
    """Lines between line feeds, without those that hold white space only."""
    lines = words_of(texts, NOT_LF)
    filled = np.concatenate([[0], np.cumsum(SPACED[lines.raw])])
    keep = filled[lines.ends] > filled[lines.starts]
    starts = lines.starts[keep]
    return Words(lines.raw, lines.offsets, starts, lines.ends[keep], np.searchsorted(starts, lines.offsets))


def list_parts(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def winnow(grams: np.ndarray, inside: np.ndarray, doc: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of w consecutive grams in one document, and the position of each one's least gram.

    The leftmost of equal grams is taken, so equal windows select the same gram.
    """
    m = len(grams) - w + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least, at = grams[:m].copy(), np.zeros(m, np.int64)
    for j in range(1, w):
        other = grams[j:j + m]
        smaller = other < least
        least[smaller] = other[smaller]
        at[smaller] = j
    starts = np.flatnonzero(inside[:m] & inside[w - 1:] & (doc[:m] == doc[w - 1:w - 1 + m]))
    return starts, starts + at[starts]


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))
