"""Periodic runs of words: stretches that repeat with a period, at least three times.

Seeds come from minimizers at several scales.  At scale t the grams of t words are hashed, and the smallest gram of every
window of t grams is a minimizer.  Inside a run of period p >= 2 t some window in the first period has a minimizer, and the
same window one period later has the same one, so a pair of equal minimizers at distance p exists; scale t looks at pairs
at distances in [2 t, 4 t).  Grams that themselves have a period of t / 3 or less lie in runs of lower scales and are left
out, so equal minimizers are more than t / 3 apart and a minimizer has at most a dozen partners: work is linear in the words
of each scale.  Each pair is extended to both sides by binary search on prefix hashes, and what comes out is compared word
by word.  Periods below 16 are too short for minimizers and are found by direct scans of each lag.

Scale: one pass over the rows without a shuffle; a task holds a slice of about a megabyte of texts, or one longer text.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.bytewords import NOT_SPACE, mix, text_slices, words_of
from plumbline.llm.registry import ship

SHORT = 16  # periods below are scanned lag by lag; a power of two, twice the lowest scale
RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())])

_U = np.uint64
_TOP = _U(0xFFFFFFFFFFFFFFFF)
_KEEP = np.arange(256, dtype=np.uint8)
_BASE = 0xD1342543DE82EF95


class _Prefix:
    """Hashes of runs of words, from prefix sums over powers of an odd base (modulo 2^64)."""

    def __init__(self, x: np.ndarray):
        up, down = np.full(len(x) + 1, _BASE, _U), np.full(len(x) + 1, pow(_BASE, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        self.down = np.multiply.accumulate(down)
        self.sums = np.zeros(len(x) + 1, _U)
        np.cumsum(mix(x.astype(_U)) * np.multiply.accumulate(up)[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` (minimum or maximum) of every ``width`` neighbours, by running values inside blocks of ``width``."""
    n = len(x) - width + 1
    padded = np.concatenate([x, np.full(-len(x) % width, x[-1], x.dtype)]).reshape(-1, width)
    ahead = best.accumulate(padded, axis=1).ravel()
    behind = best.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[:n], ahead[width - 1 : width - 1 + n])


def _stretches(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last + 1) of the maximal runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flag, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) sorted, each interval once with its smallest period (all its periods are multiples of it)."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, 0] != runs[:-1, 0]) | (runs[1:, 1] != runs[:-1, 1])
    return runs[first]


def _by_lag(x: np.ndarray, lag: int) -> np.ndarray:
    """All runs of period ``lag`` that hold it three times."""
    if len(x) <= lag:
        return np.zeros((0, 3), np.int64)
    a, b = _stretches(x[:-lag] == x[lag:])
    long = b - a >= 2 * lag
    return np.stack([a[long], b[long] + lag, np.full(int(long.sum()), lag)], axis=1)


def minimizer_pairs(prefix: _Prefix, n: int, scale: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of equal minimizers of ``scale`` at distances from 2 to 4 scales, outside of shorter periods."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = n - scale + 1
    if m < scale:
        return none
    at = np.arange(m)
    g = np.minimum(mix(prefix.of(at, at + scale)), _TOP - _U(1))
    low = known[(3 * known[:, 2] <= scale) & (known[:, 1] - known[:, 0] >= scale)]
    marks = np.zeros(m + 1, np.int64)
    np.add.at(marks, low[:, 0], 1)
    np.add.at(marks, low[:, 1] - scale + 1, -1)
    g[np.cumsum(marks[:-1]) > 0] = _TOP
    least = _sliding(g, scale, np.minimum)  # of the windows
    edge = np.zeros(scale - 1, _U)
    reach = np.where(least == _TOP, _U(0), least)
    chosen = np.flatnonzero(_sliding(np.concatenate([edge, reach, edge]), scale, np.maximum) == g)
    chosen = chosen[np.lexsort((chosen, g[chosen]))]
    value = g[chosen]
    positions, distances, step = [], [], 1
    while step < len(chosen):
        gap = chosen[step:] - chosen[:-step]
        near = (value[step:] == value[:-step]) & (gap < 4 * scale)
        if not near.any():
            break
        pair = near & (gap >= 2 * scale)
        positions.append(chosen[:-step][pair])
        distances.append(gap[pair])
        step += 1
    return (np.concatenate(positions), np.concatenate(distances)) if positions else none


def _extended(x: np.ndarray, prefix: _Prefix, at: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """The maximal stretches around words ``at`` that equal those ``lag`` later, as (start, end, period)."""
    n = len(x)

    def reach(limit: np.ndarray, same) -> np.ndarray:
        lo, hi = np.zeros(len(at), np.int64), limit.copy()
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            ok = same(mid)
            lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid - 1)
        return lo

    right = reach(n - lag - at, lambda k: prefix.of(at, at + k) == prefix.of(at + lag, at + lag + k))
    left = reach(at, lambda k: prefix.of(at - k, at) == prefix.of(at + lag - k, at + lag))
    return np.stack([at - left, at + right + lag, lag], axis=1)


def _exact(x: np.ndarray, runs: np.ndarray) -> bool:
    """Whether hashes told the truth: every run repeats word by word and ends where it ends."""
    n = len(x)
    for a, b, p in runs.tolist():
        if not np.array_equal(x[a : b - p], x[a + p : b]) or (a and x[a - 1] == x[a - 1 + p]) or (b < n and x[b] == x[b - p]):
            return False
    return True


def all_runs(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Runs (start, end, smallest period) that hold their period three times in documents laid end to end.

    ``x`` numbers the words, with a value of its own after each document (counted in ``lengths``), so no run crosses it.
    """
    runs = _smallest(np.concatenate([np.zeros((0, 3), np.int64), *(_by_lag(x, lag) for lag in range(1, SHORT))]))
    start = np.concatenate([[0], np.cumsum(lengths)])
    scale = SHORT // 2
    while True:
        # documents too short for three periods of this scale drop out, here and at all scales above
        deep = lengths - 1 >= 6 * scale
        if not deep.any():
            return runs
        inside = np.repeat(deep, lengths)
        back = np.flatnonzero(inside)
        mine = runs[inside[runs[:, 0]]]
        shift = np.cumsum(np.where(deep, 0, lengths))
        moved = mine - np.stack([shift[np.searchsorted(start, mine[:, 0], "right") - 1]] * 2 + [np.zeros(len(mine), np.int64)], axis=1)
        y = x[back]
        prefix = _Prefix(y)
        found = _extended(y, prefix, *minimizer_pairs(prefix, len(y), scale, moved))
        found = _smallest(found[found[:, 1] - found[:, 0] >= 3 * found[:, 2]])
        if not _exact(y, found):  # two unequal passages with one 64-bit hash: scan the lags of this scale
            found = np.concatenate([_by_lag(y, lag) for lag in range(2 * scale, 4 * scale)])
        found[:, 1] = back[found[:, 1] - 1] + 1
        found[:, 0] = back[found[:, 0]]
        runs = _smallest(np.concatenate([runs, found]))
        scale *= 2


def runs_of(hashes: np.ndarray, bounds: np.ndarray, least: int, times: int) -> list[np.ndarray]:
    """(start, length, period) of the runs of each document, by start and period."""
    n = len(bounds) - 1
    lengths = np.diff(bounds) + 1
    x = np.zeros(int(lengths.sum()), np.int64)
    last = np.cumsum(lengths) - 1
    word = np.ones(len(x), bool)
    word[last] = False
    x[word] = np.unique(hashes, return_inverse=True)[1]
    x[last] = -1 - np.arange(n)
    runs = all_runs(x, lengths)
    size = runs[:, 1] - runs[:, 0]
    runs = runs[size >= np.maximum(least, times * runs[:, 2])]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    first = last - lengths + 1
    doc = np.searchsorted(first, runs[:, 0], "right") - 1
    rows = np.stack([runs[:, 0] - first[doc], runs[:, 1] - runs[:, 0], runs[:, 2]], axis=1)
    return np.split(rows, np.searchsorted(doc, np.arange(1, n)))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, times: int = 3, carry: Sequence[str] = ()) -> DataFrame:
    """Runs of words that repeat with a period, and the texts with each run cut to its first period.

    A run is a maximal stretch of words with smallest period q and a length of at least ``least`` words and ``times`` periods
    (three or more).  Returns one row per input row: ``id_col``, n_words, runs (array of start, length, period in words, by
    start and period), collapsed (the words outside of every run's later periods, joined by one space).  Null and empty texts
    have no words and collapse to the empty string.  Rows that repeat an id, or have none, are each judged by their own
    text.  The columns named in ``carry`` come back unchanged, others are not read.
    """
    if times < 3:
        raise ValueError("runs of fewer than three periods are not searched")
    ship(docs.sparkSession)
    carried = [f"_carry{i}" for i in range(len(carry))]
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(x) for c, x in zip(carry, carried)])
    schema = T.StructType([base.schema["id"], *(base.schema[c] for c in carried), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    arrow_run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column("text")):
                words = words_of(data, offsets, NOT_SPACE, _KEEP)
                found = runs_of(words.hash, words.bounds, least, times)
                collapsed = []
                for i, rows in enumerate(found):
                    own = data[offsets[i] : offsets[i + 1]].tobytes().split()
                    if len(rows):
                        keep = np.ones(len(own), bool)
                        for start, length, period in rows.tolist():
                            keep[start + period : start + length] = False
                        own = [own[j] for j in np.flatnonzero(keep).tolist()]
                    collapsed.append(b" ".join(own).decode())
                flat = np.concatenate(found)
                spans = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(arrow_run))
                ends = np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(first, last - first) for c in ["id", *carried]), pa.array(np.diff(words.bounds)), pa.ListArray.from_arrays(pa.array(ends), spans), pa.array(collapsed, pa.string())],
                    ["id", *carried, "n_words", "runs", "collapsed"],
                )

    out = base.mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), "n_words", "runs", "collapsed", *[F.col(x).alias(c) for x, c in zip(carried, carry)])
