"""Toxicity by a factorization machine over hashed terms.

Terms are words and the first bytes of longer words, hashed into ``buckets``.  The machine learns a weight and a vector
for every bucket, without a screen by single terms, so a pair of terms (an insult with the mention of a group) can add
what neither has alone: score = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j).

Rows have length 1, so a long text is not louder than a short one.  Within a row, terms that are associated with the
label alone are up to ``1 / LEAST`` times as large as neutral ones, which stay in.

The fit uses at most ``sample`` labelled rows (those with the smallest hash of the id) as sparse rows on the driver; the
model is a table of ``buckets``.  Scoring is one pass over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.bytewords import ALNUM, LOWER, mix, prefix_sums, run_hash, text_slices, words_of
from plumbline.llm.labelled import fold, training_labels
from plumbline.llm.scratch import Scratch

PREFIX = 5
#: size of a neutral term, and the deviations at which a term has size 1: by ``cross_validated`` on the training rows alone
#: (3155 rows outside the held-out fold, three parts) log loss 0.058; (0.1, 4) had 0.074 and (0.3, 8) 0.090
LEAST, FULL = 0.1, 8.0


def _terms(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, term) of the words and word beginnings of a slice, repeats included."""
    words = words_of(data, offsets, ALNUM)
    sums = prefix_sums(LOWER[data])
    long = np.flatnonzero(words.end - words.start > PREFIX)
    begin = mix(run_hash(sums, words.start[long], words.start[long] + PREFIX) + np.uint64(1))
    return np.concatenate([words.doc, words.doc[long]]), (np.concatenate([words.hash, begin]) % np.uint64(buckets)).astype(np.int64)


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by their index ``at``."""
    return np.column_stack([np.bincount(at, x, n) for x in values.T])


class FactorizationMachine:
    """Second-order machine on sparse rows, fitted by stochastic gradient descent on log loss."""

    def __init__(self, size: int, rank: int = 8, seed: int = 7, least: float = LEAST, full: float = FULL):
        self.least, self.full = least, full
        self.bias = 0.0
        self.scale = np.ones(size)
        self.w = np.zeros(size)
        self.v = np.random.RandomState(seed).normal(0, 0.1, (size, rank))

    def _sizes(self, rows: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        """Size of each term in its row, of which the squares add to 1."""
        own = self.scale[terms]
        return own / np.sqrt(np.bincount(rows, own * own, n))[rows]

    def raw(self, rows: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        """Log odds of ``n`` rows whose features are the distinct pairs (rows, terms)."""
        x = self._sizes(rows, terms, n)
        linear = np.bincount(rows, self.w[terms] * x, n)
        both = np.zeros(n)
        for f in range(self.v.shape[1]):
            own = self.v[terms, f] * x
            both += np.bincount(rows, own, n) ** 2 - np.bincount(rows, own * own, n)
        return self.bias + linear + 0.5 * both

    def fit(self, terms: np.ndarray, bounds: np.ndarray, y: np.ndarray, epochs: int = 20, batch: int = 256, rate: float = 0.1, l2: float = 1e-4) -> FactorizationMachine:
        """Row i of the bounded sample has the distinct features terms[bounds[i]:bounds[i + 1]].

        A step moves the features of its batch only, so its cost follows the batch and not the number of buckets.
        """
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
        self.bias = float(np.log(mean / (1 - mean)))
        self.v[np.bincount(terms, minlength=len(self.w)) == 0] = 0  # terms without a training row add nothing
        if not len(terms):
            return self
        sizes, n_buckets = np.diff(bounds), len(self.w)
        # how far the positive rows of a term lie from their expectation, in standard deviations
        n, p = np.bincount(terms, minlength=n_buckets), np.bincount(terms, np.repeat(y, sizes), n_buckets)
        z = np.abs(p - n * mean) / np.sqrt(np.maximum(n, 1) * mean * (1 - mean))
        self.scale = np.clip(np.where(n < 3, 0, z) / self.full, self.least, 1)
        rng = np.random.RandomState(11)
        params = np.column_stack([self.w, self.v])  # weight, then vector
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), batch):
                at = order[lo : lo + batch]
                n = sizes[at]
                row = np.repeat(np.arange(len(at)), n)
                own = terms[np.repeat(bounds[at] - (np.cumsum(n) - n), n) + np.arange(len(row))]
                used, col = np.unique(own, return_inverse=True)
                p, x = params[used], self._sizes(row, own, len(at))
                moved = p[col] * x[:, None]
                total = _sums(row, moved, len(at))
                s = total[:, 1:]
                raw = self.bias + total[:, 0] + 0.5 * ((s * s).sum(1) - np.bincount(row, (moved[:, 1:] ** 2).sum(1), len(at)))
                g = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[at]
                grad = _sums(col, np.column_stack([g, g[:, None] * s])[row] * x[:, None], len(used))
                grad[:, 1:] -= p[:, 1:] * np.bincount(col, g[row] * x * x, len(used))[:, None]
                params[used] = p - rate * (grad + l2 * p)
        self.w, self.v = params[:, 0].copy(), params[:, 1:].copy()
        return self


def cross_validated(terms: np.ndarray, bounds: np.ndarray, y: np.ndarray, size: int, settings: list[tuple[float, float]], parts: int = 3) -> dict[tuple[float, float], float]:
    """Mean log loss of settings (least, full) on parts of the training rows that the fit did not see."""
    sizes, out = np.diff(bounds), {}
    part = np.arange(len(y)) % parts  # the rows come in the order of a hash
    row = np.repeat(np.arange(len(y)), sizes)
    for least, full in settings:
        loss = 0.0
        for k in range(parts):
            seen = part != k
            machine = FactorizationMachine(size, least=least, full=full).fit(terms[seen[row]], np.concatenate([[0], np.cumsum(sizes[seen])]), y[seen])
            place = np.cumsum(~seen) - 1
            raw = machine.raw(place[row[~seen[row]]], terms[~seen[row]], int((~seen).sum()))
            loss += np.logaddexp(0, np.where(y[~seen] == 1, -raw, raw)).sum()
        out[least, full] = float(loss / len(y))
    return out


def _sampled_terms(docs: DataFrame, chosen: DataFrame, buckets: int) -> DataFrame:
    """(id, y, terms): distinct hashed terms of the training rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column("text")):
                doc, term = _terms(data, offsets, buckets)
                key = np.unique(doc * buckets + term)
                bounds = np.searchsorted(key // buckets, np.arange(last - first + 1)).astype(np.int32)
                terms = pa.ListArray.from_arrays(pa.array(bounds), pa.array((key % buckets).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(first, last - first) for c in ("id", "y")] + [terms], ["id", "y", "terms"])

    joined = docs.select("id", "text").join(chosen, "id").dropDuplicates(["id"])
    return joined.select("id", "y", "text").mapInArrow(run, T.StructType([docs.schema["id"], T.StructField("y", T.IntegerType()), T.StructField("terms", T.ArrayType(T.IntegerType()))]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, scratch: Scratch, label_col: str, folds: int, held_out: int, sample: int, buckets: int) -> FactorizationMachine:
    chosen = training_labels(labels, scratch, label_col, folds, held_out, sample)
    rows = scratch.save(_sampled_terms(docs, chosen, buckets), "training-terms")
    table = rows.orderBy(F.xxhash64("id"), "id").select("y", "terms").toArrow()  # at most ``sample`` rows of at most ``buckets``
    y = table["y"].to_numpy().astype(float)
    terms = table["terms"].combine_chunks()
    terms = pa.concat_arrays(terms.chunks) if isinstance(terms, pa.ChunkedArray) else terms
    return FactorizationMachine(buckets).fit(terms.flatten().to_numpy(), np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy())]).astype(np.int64), y)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held_out: int = 0, sample: int = 12_000, buckets: int = 1 << 18) -> DataFrame:
    """Probability that a document is toxic.

    Returns ``id_col``, held_out and score (0 to 1), a row for each input row, rows that repeat an id included.  Null and
    empty texts get the score of the bias.  Labels that are null, have no id or no
    document are not used; without any usable label every score is 0.5.  A row without id is not held out.  Labels are
    ``doc_id`` and ``label_col``; other columns of either table are not read.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    machine = fit_toxicity(base, labels, scratch, label_col, folds, held_out, sample, buckets)
    model = base.sparkSession.sparkContext.broadcast((machine.bias, *(x.astype(np.float32) for x in (machine.scale, machine.w, machine.v))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = FactorizationMachine(0)
        machine.bias, machine.scale, machine.w, machine.v = model.value
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column("text")):
                doc, term = _terms(data, offsets, buckets)
                key = np.unique(doc * buckets + term)
                raw = machine.raw(key // buckets, key % buckets, last - first)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, last - first), pa.array(1 / (1 + np.exp(-np.clip(raw, -30, 30))))], ["id", "score"])

    scored = base.mapInArrow(run, T.StructType([base.schema["id"], T.StructField("score", T.DoubleType())]))
    return scored.select(F.col("id").alias(id_col), F.coalesce(fold("id", folds) == held_out, F.lit(False)).alias("held_out"), "score")
