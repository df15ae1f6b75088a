"""Vectorised text work on Arrow string arrays: words, hashes and n-grams straight from the UTF-8 bytes.

All functions take whole texts. Work goes block by block (about a quarter of a megabyte of whole documents at a time), so
that the intermediate arrays stay small however large an Arrow batch is.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18
U = np.uint64


def trim() -> None:
    """Return freed memory to the system: Python workers stay for later tasks, beside others of their executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not the GNU C library
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: A value for each byte, from the mixer.
BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_BASE = U(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = True
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and n + 1 offsets; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(at: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most limit bytes, or of one row."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(data: np.ndarray, at: np.ndarray, inside: np.ndarray, fold: np.ndarray | None = LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words are runs of bytes for which inside holds, within one text.

    Returns the hash of each word, where it starts, and n + 1 offsets of the texts' words.
    """
    if not len(data):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    if fold is not None:
        data = fold[data]
    used = inside[data]
    first = used.copy()
    first[1:] &= ~used[:-1]
    edge = at[(at > 0) & (at < len(data))]
    first[edge] = used[edge]
    starts = np.flatnonzero(first)
    bounds = np.searchsorted(starts, at)
    if not len(starts):
        return np.zeros(0, U), starts, bounds
    which = np.cumsum(first) - 1
    place = np.arange(len(data)) - starts[np.maximum(which, 0)]
    place[~used] = 0
    power = np.full(int(place.max()) + 1, _BASE, U)
    power[0] = 1
    power = np.cumprod(power, dtype=U)
    value = BYTE[data] * power[place]
    value[~used] = 0
    return mix(np.add.reduceat(value, starts)), starts, bounds


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words; of the whole sequence where a text has 1 to k - 1 words.

    Returns them (with repeats, in order) and n + 1 offsets.
    """
    counts = np.diff(bounds)
    number = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_at = np.concatenate([[0], np.cumsum(number)])
    if not len(words):
        return np.zeros(0, U), out_at
    padded = np.concatenate([words, np.zeros(k, U)])
    n = len(words)
    end = np.repeat(bounds[1:], counts)
    index = np.arange(n)
    total = np.zeros(n, U)
    for j in range(k):
        term = mix(padded[j : j + n] + U((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        if j:
            term = np.where(index + j < end, term, U(0))
        total = total * U(0xD6E8FEB86659FD93) + term
    keep = index + k <= end
    short = np.flatnonzero((counts > 0) & (counts < k))
    keep[bounds[:-1][short]] = True
    # one hash for each kept start; the starts of short texts are the only ones there
    return mix(total[keep] ^ U(k)), out_at
