"""Vectorised word and shingle hashes of Arrow text batches.

A slice of documents is taken as one byte buffer. Word boundaries come from a byte class table,
word hashes from a polynomial prefix sum modulo 2**64, shingle hashes from a weighted sum of the
hashes of consecutive words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that are hashed at a time (a longer document is taken whole).
SLICE_BYTES = 1 << 20


def _splitmix(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with full avalanche."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U64(27))
        x = x * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_TABLE = _splitmix(256, 11)
_BASE = 0x9FB21C651E98DF25
_UNBASE = pow(_BASE, -1, 1 << 64)
#: Weights of the 1st, 2nd, ... word of a shingle; odd.
_WEIGHTS = _splitmix(64, 77) | U64(1)
_POWERS = {"n": 0, "up": np.ones(1, U64), "down": np.ones(1, U64)}

#: White space separates words: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: All ASCII but letters and digits separates words.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = True
NOT_ALNUM[0x30:0x3A] = False
NOT_ALNUM[0x41:0x5B] = False
NOT_ALNUM[0x61:0x7B] = False


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > _POWERS["n"]:
        m = max(n, SLICE_BYTES)
        with np.errstate(over="ignore"):
            _POWERS["up"] = np.cumprod(np.append(U64(1), np.full(m, _BASE, U64)), dtype=U64)
            _POWERS["down"] = np.cumprod(np.append(U64(1), np.full(m, _UNBASE, U64)), dtype=U64)
        _POWERS["n"] = m
    return _POWERS["up"], _POWERS["down"]


def slices(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, byte offsets of the rows) of about SLICE_BYTES each; null text is empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if text.null_count:
        text = text.fill_null("")
    if len(text) == 0:
        return
    wide = np.int64 if pa.types.is_large_string(text.type) else np.int32
    offsets = np.frombuffer(text.buffers()[1], wide)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = text.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(text):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word with A-Z lower-cased, index of each document's first word and the end)."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    upper = (raw - np.uint8(65)) < np.uint8(26)
    low = raw + (upper.astype(np.uint8) << np.uint8(5))
    inside = ~separators[raw]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    up, down = _powers(n)
    with np.errstate(over="ignore"):
        sums = np.cumsum(_TABLE[low] * up[:n], dtype=U64)
        total = sums[ends]
        before = np.where(starts > 0, sums[starts - 1], U64(0))
        hashes = mix64((total - before) * down[starts])
    return hashes, np.searchsorted(starts, offsets).astype(np.int64)


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``width`` words, each document's bounds); a shorter document is one whole run."""
    counts = np.diff(bounds)
    runs = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(runs)])
    if out_bounds[-1] == 0:
        return np.zeros(0, U64), out_bounds
    doc = np.repeat(np.arange(len(counts)), runs)
    at = np.arange(out_bounds[-1]) - out_bounds[doc] + bounds[doc]
    held = np.minimum(counts[doc], width)
    total = np.zeros(len(at), U64)
    with np.errstate(over="ignore"):
        for j in range(width):
            part = hashes[np.minimum(at + j, len(hashes) - 1)] * _WEIGHTS[j]
            total += np.where(held > j, part, U64(0))
        total = mix64(total + held.astype(U64))
    return total, out_bounds
