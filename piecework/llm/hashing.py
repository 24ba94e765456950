"""64-bit hashes of words and of runs of words, for whole Arrow batches at a time.

Equal words have equal hashes on every worker. Words of different spelling share a hash with a chance of about
2**-64 a pair, which is what results that go by these hashes rest on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SEED = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_STEP = 0x9E3779B97F4A7C15
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text worked on at a time.
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in this order."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + b * np.uint64(0xA0761D6478BD642F) + np.uint64(1))


def _powers(n: int) -> np.ndarray:
    p = np.full(n, np.uint64(_STEP))
    p[0] = 1
    return np.cumprod(p)


def _block(data: np.ndarray, first: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and word starts of a byte block; `first` marks bytes at which a document begins."""
    inside = ~_WHITE[data]
    begins = inside.copy()
    begins[1:] &= _WHITE[data[:-1]] | first[1:]
    at = np.flatnonzero(inside)
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    where = np.searchsorted(at, starts)  # of the starts among the inside bytes
    lengths = np.diff(np.append(where, len(at)))
    place = np.arange(len(at)) - np.repeat(where, lengths)
    value = (_LOWER if lower else _BYTE)[data[at]] * _powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(value, where) + lengths.astype(np.uint64)), starts


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the number of words of each text (0 for null)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    hashes, counts, at = [], np.zeros(len(texts), np.int64), 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        while end < len(data) and not (_WHITE[data[end]] or first[end]):
            end += 1
        h, starts = _block(data[at:end], first[at:end], lower)
        hashes.append(h)
        counts += np.bincount(np.searchsorted(offsets, starts + at, "right") - 1, minlength=len(texts))
        at = end
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 * BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `most` bytes of text, at least a row each."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // most
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
