"""Sets of hashed word shingles, computed with numpy over the bytes of whole Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once, unless one text is longer.
PIECE = 1 << 19
_INK = np.ones(256, bool)
_INK[[9, 10, 11, 12, 13, 32]] = False
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_PLACE = mix(np.arange(1001, 1065, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
_powers = {"n": 0}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if _powers["n"] < n:
        n = max(n, PIECE)
        up = np.full(n, np.uint64(_BASE))
        down = np.full(n, np.uint64(pow(_BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        _powers.update(n=n, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _powers["up"], _powers["down"]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow column of strings; nulls are empty."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    if column.null_count:  # what a null's slot holds isn't defined
        filled = column.fill_null("")
        return texts(filled)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def shingle_sets(column: pa.Array, size: int, *, fold_case: bool = True) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of so many words; the whole text is one if it has fewer."""
    data, offsets = texts(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
        j = min(j, n)
        yield from _piece(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size, _FOLDED if fold_case else _BYTES)
        i = j


def _piece(data: np.ndarray, bounds: np.ndarray, size: int, table: np.ndarray) -> Iterator[np.ndarray]:
    n_docs = len(bounds) - 1
    ink = _INK[data]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    first[inner] = ink[inner]
    last[inner - 1] = ink[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_BASE))
    doc = np.searchsorted(bounds, starts, "right") - 1
    count = np.bincount(doc, minlength=n_docs) if len(doc) else np.zeros(n_docs, np.int64)
    at = np.concatenate([[0], np.cumsum(count)])
    m = max(0, len(words) - size + 1)
    rolled = np.zeros(m, np.uint64)
    for k in range(size):
        rolled += words[k : k + m] * _PLACE[k]
    rolled = mix(rolled)
    for d in range(n_docs):
        a, c = at[d], count[d]
        if c >= size:
            yield np.unique(rolled[a : a + c - size + 1])
        elif c:
            yield mix((words[a : a + c] * _PLACE[:c]).sum(dtype=np.uint64, keepdims=True) + np.uint64((int(c) * _BASE) % (1 << 64)))
        else:
            yield np.zeros(0, np.uint64)
