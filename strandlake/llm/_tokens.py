"""Vectorised tokenising of Arrow string batches: word bounds and 64-bit word hashes straight from UTF-8 bytes.

A word's hash is a polynomial over random byte values, taken from one cumulative sum over the batch, so the cost does not
depend on how many distinct words there are and no dictionary is kept.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer single document is handled alone.
SLICE_BYTES = 1 << 20



def _give_back_freed_memory() -> None:
    """Python workers live through many stages: what a stage frees goes back to the system at once, arrays and Arrow
    batches alike, else each worker keeps its largest moment."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):
        return
    pa.set_memory_pool(pa.system_memory_pool())


_give_back_freed_memory()

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_pow: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _pow or len(_pow[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        out = []
        for base in (_P, _P_INV):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        if size > 4 * SLICE_BYTES:  # a rare huge document: do not keep its tables
            return out[0], out[1]
        _pow[:] = out
    return _pow[0][:n], _pow[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def table(chars: str = " \t\n\x0b\x0c\r") -> np.ndarray:
    """Byte table that is true for the given ASCII characters."""
    out = np.zeros(256, dtype=bool)
    out[list(chars.encode())] = True
    return out


#: Word separators of the contracts: space and U+0009 to U+000D.
SPACES = table()
#: Separators of loose matching: ASCII white space and punctuation.
LOOSE = table(" \t\n\x0b\x0c\r!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def fold_az() -> np.ndarray:
    """Byte values with A-Z lower-cased."""
    b = np.arange(256)
    b[65:91] += 32
    return b


@dataclass
class Words:
    """Words of a slice of documents. bounds: documents' first words, with the end; starts, ends: bytes in data."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray

    @property
    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows; null texts are empty. lower: letters of any script are
    lower-cased first."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None and buffer.size else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def prefix(data: np.ndarray, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Cumulative polynomial sums (with a leading 0) and inverse powers, for span_hashes."""
    pw, inv = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    values = _BYTE if fold is None else _BYTE[fold]
    np.cumsum(values[data] * pw[: len(data)], out=sums[1:])
    return sums, inv


def span_hashes(sums: np.ndarray, inv: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES, fold: np.ndarray | None = None) -> Words:
    inside = ~separators[data]
    n = len(data)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    sums, inv = prefix(data, fold)
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets), span_hashes(sums, inv, starts, ends))


_Q = np.uint64(0xD6E8FEB86659FD93)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k consecutive words from each place; those over a document's end are for the caller to drop."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out = out * _Q + hashes[j : j + n]
    return mix(out + np.uint64(k))


def per_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values (bools or ints) between offsets."""
    sums = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
