"""Words of Arrow text batches as byte runs with 64-bit hashes, vectorised over a slice of documents.

A word is a maximal run of the bytes that ``is_word`` marks, after ``lower`` mapped A-Z.  UTF-8 bytes of 0x80 and above
belong to words in both classes, so runs of bytes are runs of characters.  Hashes are polynomials over random byte
values (mod 2^64, from prefix sums) that go through a bijective mixer; all constants are fixed, so every task agrees.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.RandomState(20240501).randint(0, 2**63, 256).astype(_U) * _U(2) + _U(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE

ALNUM = np.zeros(256, bool)
ALNUM[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True


class Words(NamedTuple):
    doc: np.ndarray  # index of the document in the slice, ascending
    start: np.ndarray  # byte offsets in the slice
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray  # words of document i: bounds[i]:bounds[i + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits depend on all input bits."""
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


class _Powers:
    """base^i and base^-i for i below a size that grows on demand."""

    up = np.ones(1, _U)
    down = np.ones(1, _U)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            out = []
            for base in (_BASE, _BASE_INV):
                p = np.full(n, base, _U)
                p[0] = 1
                out.append(np.multiply.accumulate(p))
            cls.up, cls.down = out
        return cls.up[:n], cls.down[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of which ``run_hash`` takes the hash of any byte run."""
    up, _ = _Powers.get(len(data) + 1)
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=out[1:])
    return out


def run_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _Powers.get(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of rows with about ``limit`` bytes, one row at least; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words_of(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lower: np.ndarray = LOWER) -> Words:
    data = lower[data]
    flag = np.zeros(len(data) + 2, bool)
    flag[1:-1] = is_word[data]
    edge = np.zeros(len(data) + 1, bool)  # a document ends and the next one begins
    edge[offsets] = True
    inside, before, after = flag[1:-1], flag[:-2], flag[2:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    bounds = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    return Words(doc, start, end, run_hash(prefix_sums(data), start, end), bounds)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes (runs over a document's end too: mask them)."""
    m = max(0, len(hashes) - n + 1)
    out = hashes[:m] + _U(n)
    for k in range(1, n):
        out ^= out >> _U(29)
        out *= _U(0xBF58476D1CE4E5B9)
        out += hashes[k : k + m]
    return mix(out)


def ids(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit hashes as the bigint that Spark knows."""
    return pa.array(x.view(np.int64))
