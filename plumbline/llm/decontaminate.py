"""Benchmark decontamination by winnowing.

A text's fingerprints are the smallest k-gram hash of every sliding window of ``window - k + 1`` consecutive k-grams, so
two texts that share ``window`` words in a row always share a fingerprint.  Fingerprints of documents and items are
joined; each hit names a (document, item) pair, whose windows are then compared along the whole document, which extends
the hit to every occurrence.  Items shorter than a window are one window of their own length; for these lengths the
documents' runs of that length are fingerprints as well.

Scale: the items' fingerprints are written first, so Spark plans the join from their true size (a broadcast below its
threshold, else a sorted join that adaptive execution splits).  Documents are shuffled at most once, for the check.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.bytewords import ALNUM, Words, grams, ids, text_slices, words_of
from plumbline.llm.scratch import Scratch


def winnow(words: Words, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, documents) of the k-grams that are smallest in a window of ``window`` words that holds them."""
    g = grams(words.hash, k)
    span = window - k + 1
    n = max(0, len(g) - span + 1)
    whole = words.doc[:n] == words.doc[window - 1 : window - 1 + n]
    low = g[:n].copy()
    for j in range(1, span):
        np.minimum(low, g[j : j + n], out=low)
    chosen = np.zeros(len(g), bool)
    for j in range(span):
        chosen[j : j + n] |= whole & (g[j : j + n] == low)
    at = np.flatnonzero(chosen)
    return g[at], words.doc[at]


def _runs(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, documents) of every run of ``width`` words."""
    g = grams(words.hash, width)
    inside = words.doc[: len(g)] == words.doc[width - 1 : width - 1 + len(g)]
    return g[inside], words.doc[: len(g)][inside]


def _items(benchmark: DataFrame, k: int, window: int) -> DataFrame:
    """(key, item, width, windows, prints) of items that have words."""
    schema = T.StructType([benchmark.schema["key"], benchmark.schema["item"], T.StructField("width", T.IntegerType()), T.StructField("windows", T.ArrayType(T.LongType())), T.StructField("prints", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            rows = []
            for first, last, data, offsets in text_slices(batch.column("text"), 1):  # one item at a time
                words = words_of(data, offsets, ALNUM)
                width = min(window, len(words.hash))
                if width:
                    windows = _runs(words, width)[0]
                    prints = windows if width < window else winnow(words, k, window)[0]
                    rows.append((first, width, np.unique(windows).view(np.int64).tolist(), np.unique(prints).view(np.int64).tolist()))
            at, widths, windows, prints = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at, pa.int64())) for c in ("key", "item")), pa.array(widths, pa.int32()), pa.array(windows, pa.list_(pa.int64())), pa.array(prints, pa.list_(pa.int64()))], ["key", "item", "width", "windows", "prints"])

    return benchmark.select("key", "item", "text").mapInArrow(run, schema)


def _prints(docs: DataFrame, k: int, window: int, short: list[int]) -> DataFrame:
    """(id, print): fingerprints of the documents, and all runs of the lengths ``short``."""
    schema = T.StructType([docs.schema["id"], T.StructField("print", T.LongType())])

    def run(batches):
        for batch in batches:
            column = batch.column("id")
            for first, _, data, offsets in text_slices(batch.column("text")):
                words = words_of(data, offsets, ALNUM)
                for found, doc in [winnow(words, k, window), *(_runs(words, width) for width in short)]:
                    yield pa.RecordBatch.from_arrays([column.take(pa.array(doc + first)), ids(found)], ["id", "print"])

    return docs.select("id", "text").mapInArrow(run, schema)


def _extended(joined: DataFrame, kept: list[str]) -> DataFrame:
    """(kept columns, n_words, spans, items) of each document from the windows of its candidate items."""
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    item = joined.schema["found"].dataType.elementType["item"].dataType
    schema = T.StructType([*(joined.schema[c] for c in kept), T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(span)), T.StructField("items", T.ArrayType(item))])
    arrow_span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def check(hashes: np.ndarray, found: list) -> tuple[list, list]:
        covered = np.zeros(len(hashes) + 1, np.int64)
        matched = []
        for width in sorted({x["width"] for x in found}):
            own = grams(hashes, width)
            mine = [x for x in found if x["width"] == width]
            windows = np.unique(np.concatenate([np.array(x["windows"], np.int64) for x in mine]).view(np.uint64))
            at = np.flatnonzero(np.isin(own, windows))
            np.add.at(covered, at, 1)
            np.add.at(covered, at + width, -1)
            there = set(own[at].view(np.int64).tolist())
            matched += [x["item"] for x in mine if x["item"] is not None and not there.isdisjoint(x["windows"])]
        inside = np.concatenate([[False], np.cumsum(covered) > 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])], sorted(set(matched), key=str)

    def run(batches):
        for batch in batches:
            candidates = batch.column("found")
            for first, last, data, offsets in text_slices(batch.column("text")):
                words = words_of(data, offsets, ALNUM)
                spans, items = [], []
                for i in range(last - first):
                    found = candidates[first + i].as_py()
                    s, m = check(words.hash[words.bounds[i] : words.bounds[i + 1]], found) if found else ([], [])
                    spans.append(s)
                    items.append(m)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, last - first) for c in kept), pa.array(np.diff(words.bounds)), pa.array(spans, pa.list_(arrow_span)), pa.array(items, pa.list_(batch.schema.field("found").type.value_type.field("item").type))], [*kept, "n_words", "spans", "items"])

    return joined.select(*kept, "text", "found").mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, k: int = 5, carry: Sequence[str] = ()) -> DataFrame:
    """Benchmark passages in documents.

    Returns ``id_col``, n_words, spans (array of (start, end) in words, merged, end exclusive), items (distinct ids of the
    items that occur), a row for each input row.  Words are runs of a-z, 0-9 and characters beyond ASCII, A-Z
    lower-cased.  Null and empty texts have no words; items without words match nothing, and rows of one item id count as
    one item.  An item without id marks spans like others and is not among the items.  Every row is checked on its own text, also rows that repeat an id or have none.  An empty benchmark leaves
    all documents clean.  The columns named in ``carry`` come back unchanged, others are not read.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry)])
    carried = [f"_carry{i}" for i in range(len(carry))]
    named = F.coalesce(F.concat(F.lit("="), F.col(item_col).cast("string")), F.lit("none")).alias("key")
    items = scratch.save(_items(benchmark.select(named, F.col(item_col).alias("item"), F.col(item_text_col).alias("text")), k, window), "items")
    prints = scratch.save(items.select("key", F.explode("prints").alias("print")).distinct(), "prints")
    short = sorted(r["width"] for r in items.filter(F.col("width") < window).select("width").distinct().collect())  # below ``window`` values
    hits = scratch.save(_prints(base, k, window, short).join(prints, "print").select("id", "key").distinct(), "hits")
    found = hits.join(items, "key").groupBy("id").agg(F.collect_list(F.struct("item", "width", "windows")).alias("found"))
    found = scratch.save(found.withColumnRenamed("id", "found_id"), "found")
    # a merge join at every size: texts are shuffled once, however many documents are hit
    out = _extended(base.hint("merge").join(found, F.col("id").eqNullSafe(F.col("found_id")), "left"), ["id", *carried])
    return out.select(F.col("id").alias(id_col), "n_words", "spans", "items", *[F.col(x).alias(c) for x, c in zip(carried, carry)])
