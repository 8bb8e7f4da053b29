"""Quality classifier: a generalised additive model with pairwise interactions, fitted by cyclic boosting.

Each feature is cut into bins.  Boosting goes round the features; in each turn a tree of at most three leaves on one
feature's bins fits the current gradient and is added to that feature's lookup table.  Pairs whose two-dimensional
gradient tables leave the most to gain then get tables of their own, by trees that cut one feature and then the other.
A score is the sigmoid of a few table entries, added for a whole batch at once.

The fit uses at most ``sample`` labelled rows (those with the smallest hash of the id), of which only the features reach
the driver; the model is a few kilobytes.  Scoring is one pass over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.bytewords import NOT_SPACE, mix, text_slices, words_of
from plumbline.llm.labelled import fold, training_labels
from plumbline.llm.scratch import Scratch

FEATURES = ("log_words", "word_length", "symbols", "upper", "digits", "exclaim", "bars", "stops", "beyond_ascii", "dup_lines", "distinct_words", "same_neighbours", "line_length")
NOT_NEWLINE = np.ones(256, bool)
NOT_NEWLINE[10] = False
SAME = np.arange(256, dtype=np.uint8)


def _distinct(words) -> np.ndarray:
    """Distinct words of each document."""
    key, first = np.unique(mix(words.hash ^ mix(words.doc.astype(np.uint64))), return_index=True)
    return np.bincount(words.doc[first], minlength=len(words.bounds) - 1)


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[documents, FEATURES] of a slice, from whole texts."""
    size = np.diff(offsets).astype(float)

    def count(flag: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flag)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

    def among(chars: str) -> np.ndarray:
        table = np.zeros(256, bool)
        table[list(chars.encode())] = True
        return count(table[data])

    words, lines = words_of(data, offsets, NOT_SPACE), words_of(data, offsets, NOT_NEWLINE, SAME)
    n, n_lines = np.diff(words.bounds).astype(float), np.diff(lines.bounds).astype(float)
    w, c, ln = np.maximum(n, 1), np.maximum(size, 1), np.maximum(n_lines, 1)
    same = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    neighbours = np.bincount(words.doc[1:][same], minlength=len(n)).astype(float)
    beyond = count(data >= 0x80)
    columns = [
        np.log1p(n), (size - among(" \t\n\x0b\x0c\r")) / w, among("#*$%&<>") / w, count((data >= 65) & (data <= 90)) / c, among("0123456789") / c, among("!?") / w, among("|") / w,
        among(".,;:") / w, beyond / c, 1 - _distinct(lines) / ln, _distinct(words) / w, neighbours / w, np.log1p(size / ln),
    ]
    return np.stack(columns, axis=1)


class AdditiveModel:
    """Lookup tables of single features and of pairs."""

    def __init__(self, bins: int = 32, pair_bins: int = 8, pairs: int = 6, rate: float = 0.15, rounds: int = 60, pair_rounds: int = 30, min_rows: float = 8.0):
        self.bins, self.pair_bins, self.n_pairs, self.rate, self.rounds, self.pair_rounds, self.min_rows = bins, pair_bins, pairs, rate, rounds, pair_rounds, min_rows
        self.base, self.cuts, self.pair_cuts, self.tables, self.pairs, self.pair_tables = 0.0, [], [], [], [], []

    @staticmethod
    def _edges(x: np.ndarray, bins: int) -> np.ndarray:
        return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)

    @staticmethod
    def _leaf(g, h):
        return g / (h + 1.0)

    @staticmethod
    def _gain(g, h):
        return g * g / (h + 1.0)

    def _tree(self, g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
        """Values by bin of a tree of at most ``leaves`` leaves on sums of gradients and weights by bin."""
        ends = [0, len(g)]
        sg, sh = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
        for _ in range(leaves - 1):
            best = (1e-9, None)
            for a, b in zip(ends, ends[1:]):
                at = np.arange(a + 1, b)
                if not len(at):
                    continue
                lg, lh, rg, rh = sg[at] - sg[a], sh[at] - sh[a], sg[b] - sg[at], sh[b] - sh[at]
                gain = self._gain(lg, lh) + self._gain(rg, rh) - self._gain(sg[b] - sg[a], sh[b] - sh[a])
                i = int(np.argmax(gain))
                best = max(best, (float(gain[i]), int(at[i])), key=lambda x: x[0])
            if best[1] is None:
                break
            ends = sorted([*ends, best[1]])
        out = np.zeros(len(g))
        for a, b in zip(ends, ends[1:]):
            out[a:b] = self._leaf(sg[b] - sg[a], sh[b] - sh[a])
        return out

    def _pair_tree(self, g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        """(gain, values) of the best tree that cuts the first feature, then each side at the second."""
        best = (-1.0, np.zeros(g.shape))
        for cut in range(1, g.shape[0]):
            values, gain = np.zeros(g.shape), 0.0
            for side in (slice(0, cut), slice(cut, None)):
                sg, sh = g[side].sum(0), h[side].sum(0)
                tree = self._tree(sg, sh, 2)
                values[side] = tree
                gain += float((tree * (2 * sg - tree * (sh + 1.0))).sum())
            best = max(best, (gain, values), key=lambda x: x[0])
        return best

    def _binned(self, x: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)]

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
        self.base = float(np.log(rate / (1 - rate)))
        if not len(y):
            return self
        d = x.shape[1]
        self.cuts = [self._edges(x[:, j], self.bins) for j in range(d)]
        self.pair_cuts = [self._edges(x[:, j], self.pair_bins) for j in range(d)]
        at, coarse = self._binned(x, self.cuts), self._binned(x, self.pair_cuts)
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        raw = np.full(len(y), self.base)

        def gradient():
            p = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
            return y - p, p * (1 - p)

        for _ in range(self.rounds):
            for j in range(d):
                g, h = gradient()
                size = len(self.tables[j])
                step = self.rate * np.clip(self._tree(np.bincount(at[j], g, size), np.bincount(at[j], h, size)), -4, 4)
                self.tables[j] += step
                raw += step[at[j]]
        g, h = gradient()
        shapes = [len(c) + 1 for c in self.pair_cuts]
        cell = {(i, j): coarse[i] * shapes[j] + coarse[j] for i, j in combinations(range(d), 2)}
        table = lambda p, v: np.bincount(cell[p], v, shapes[p[0]] * shapes[p[1]]).reshape(shapes[p[0]], shapes[p[1]])
        ranked = sorted(cell, key=lambda p: (-self._pair_tree(table(p, g), table(p, h))[0], p))
        self.pairs = ranked[: self.n_pairs]
        self.pair_tables = [np.zeros((shapes[i], shapes[j])) for i, j in self.pairs]
        for _ in range(self.pair_rounds):
            for k, p in enumerate(self.pairs):
                g, h = gradient()
                step = self.rate * np.clip(self._pair_tree(table(p, g), table(p, h))[1], -4, 4)
                self.pair_tables[k] += step
                raw += step.ravel()[cell[p]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        if self.tables:
            for table, at in zip(self.tables, self._binned(x, self.cuts)):
                raw += table[at]
            coarse = self._binned(x, self.pair_cuts)
            for (i, j), table in zip(self.pairs, self.pair_tables):
                raw += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def _featured(rows: DataFrame) -> DataFrame:
    """(id, y, x) of labelled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, last - first) for c in ("id", "y")), pa.array(list(text_features(data, offsets)), pa.list_(pa.float64()))], ["id", "y", "x"])

    return rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("y", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))]))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, held_out: int = 2, sample: int = 12_000) -> DataFrame:
    """Probability that a document is of good quality (label 1).

    Returns ``id_col``, held_out and score (0 to 1), a row for each input row, rows that repeat an id included.  Null and
    empty texts are scored on the features of an empty text.  Labels that are null, have no id or no document are not
    used; without any usable label every score is 0.5.  A row without id is not held out.  Labels are ``doc_id`` and
    ``label_col``; other columns of either table are not read.
    """
    scratch = Scratch(docs.sparkSession, "quality-gam")
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = training_labels(labels, scratch, label_col, folds, held_out, sample)
    rows = _featured(base.join(chosen, "id").dropDuplicates(["id"]).select("id", "y", "text")).orderBy(F.xxhash64("id"), "id").collect()  # at most ``sample`` short rows
    model = AdditiveModel().fit(np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r["y"] for r in rows], float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, last - first), pa.array(model.score(text_features(data, offsets)))], ["id", "score"])

    scored = base.mapInArrow(run, T.StructType([base.schema["id"], T.StructField("score", T.DoubleType())]))
    return scored.select(F.col("id").alias(id_col), F.coalesce(fold("id", folds) == held_out, F.lit(False)).alias("held_out"), "score")
