"""Removal of byte strings that occur in an earlier document, with run-compressed Burrows-Wheeler columns.

Strings of ``length`` bytes are found where they must share a fingerprint: the smallest ``anchor``-gram hash of every
``length``-byte window is an anchor, so equal windows have the same anchor at the same place.  Anchors that occur once
are dropped; the others carry their context, all bytes that a window around them can reach, to the bucket of their hash.

A bucket's contexts are aligned at the anchor, so its index is a positional Burrows-Wheeler transform: columns are taken
from right to left, each a stable sort by one byte of the order before it.  Rows whose next ``length`` bytes agree form a
run of a column; runs are found from matching statistics of neighbouring rows, kept as run ends, and sampled by their
smallest document.  A row whose run holds a smaller document has a long match there.  The plain transform of all texts
would order every suffix of the corpus; only aligned rows can match here, and columns of runs grow with distinct contexts.

Scale: documents travel as compressed slices of about ``slice_bytes``.  Equal contexts of a slice travel once, so a passage
in a third of all documents adds one row for each slice to a bucket, and copies inside a slice are settled there.
Buckets follow the number of slices.  Every step is written to the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.bytewords import mix, prefix_sums, run_hash, text_slices
from plumbline.llm.scratch import Scratch

_U = np.uint64
NO_ID = np.iinfo(np.int64).max  # rows without id come last
ANCHOR = 24
PRINT_BYTES = 5  # of an anchor's hash, enough within a bucket: a false match only carries a context for nothing


def _squeeze(data: bytes | np.ndarray) -> bytes:
    raw = data.tobytes() if isinstance(data, np.ndarray) else data
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def _expand(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.Codec("zstd").decompress(data[8:], decompressed_size=size, asbytes=True), np.uint8)


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over x[i:i + width] for every full window."""
    out, span = x, 1
    while span * 2 <= width:
        out = pick(out[: len(out) - span], out[span:])
        span *= 2
    rest = width - span
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the smallest anchor-gram of every window of ``length`` bytes inside a document."""
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, _U)]
    first, n = 0, len(offsets) - 1
    while first < n:  # pieces that stay in the processor's cache
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + (1 << 19), "right")) - 1)
        own, edges = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        if len(own) >= length:
            sums = prefix_sums(own)
            at = np.arange(len(own) - ANCHOR + 1)
            h = run_hash(sums, at, at + ANCHOR)
            low = _sliding(h, length - ANCHOR + 1, np.minimum)
            doc = np.repeat(np.arange(last - first), np.diff(edges))
            low[doc[: len(low)] != doc[length - 1 :]] = 0
            # an anchor equals the largest of the minima of the windows that hold it
            pad = np.zeros(length - ANCHOR, _U)
            found = np.flatnonzero(_sliding(np.concatenate([pad, low, pad]), length - ANCHOR + 1, np.maximum) == h)
            places.append(found + offsets[first])
            hashes.append(h[found])
        first = last
    return np.concatenate(places), np.concatenate(hashes)


def _slices(docs: DataFrame, slice_bytes: int) -> DataFrame:
    """(slice, ids, sizes, text): documents in groups, their bytes compressed."""
    schema = "slice long, ids binary, sizes binary, text binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n = TaskContext.get().partitionId() << 32
        ids: list = []
        sizes: list = []
        texts: list = []
        held = 0

        def row() -> pa.RecordBatch:
            columns = [_squeeze(np.concatenate(x)) for x in (ids, sizes, texts)]
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *(pa.array([c], pa.binary()) for c in columns)], ["slice", "ids", "sizes", "text"])

        for batch in batches:
            keys = batch.column("id").fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, last, data, offsets in text_slices(batch.column("text"), slice_bytes // 4):
                ids.append(keys[first:last])
                sizes.append(np.diff(offsets).astype(np.int64))
                texts.append(data)
                held += len(data)
                if held >= slice_bytes:
                    yield row()
                    n, held = n + 1, 0
                    ids, sizes, texts = [], [], []
        if ids:
            yield row()

    return docs.mapInArrow(run, schema)


class _Slice:
    """A slice's documents with their anchors."""

    def __init__(self, ids: bytes, sizes: bytes, text: bytes, length: int):
        self.ids = _expand(ids).view(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(_expand(sizes).view(np.int64))])
        self.text = _expand(text)
        self.at, self.hash = anchors(self.text, self.offsets, length) if length else (None, None)

    def prints(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct anchor hashes, by bucket and hash, and how many each bucket has."""
        distinct = np.unique(self.hash)
        bucket = (distinct >> _U(40)) % _U(buckets)
        order = np.argsort(bucket, kind="stable")
        return distinct[order], np.bincount(bucket.astype(np.int64), minlength=buckets)


def _repeated_prints(slices: DataFrame, length: int, buckets: int) -> DataFrame:
    """(slice, bucket, mask): which of a slice's anchor hashes in a bucket occur in another slice too."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                distinct, counts = _Slice(row["ids"], row["sizes"], row["text"], length).prints(buckets)
                cut = np.concatenate([[0], np.cumsum(counts)])
                short = np.ascontiguousarray(distinct.view(np.uint8).reshape(-1, 8)[:, :PRINT_BYTES])
                some = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([row["slice"]] * len(some), pa.int64()), pa.array([short[cut[b] : cut[b + 1]].tobytes() for b in some], pa.binary())], ["bucket", "slice", "prints"])

    def find(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(p, np.uint8).reshape(-1, PRINT_BYTES) for p in table.column("prints").to_pylist()]
        wide = np.zeros((sum(map(len, parts)), 8), np.uint8)
        wide[:, :PRINT_BYTES] = np.concatenate(parts)
        value = wide.view(_U).ravel()
        order = np.argsort(value)
        equal = value[order][1:] == value[order][:-1]
        again = np.zeros(len(value), bool)
        again[order[1:]] |= equal
        again[order[:-1]] |= equal
        cut = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        masks = [np.packbits(again[a:b]).tobytes() for a, b in zip(cut, cut[1:])]
        return pa.table([table.column("slice"), table.column("bucket"), pa.array(masks, pa.binary())], ["slice", "bucket", "mask"])

    return slices.mapInArrow(emit, "bucket int, slice long, prints binary").groupBy("bucket").applyInArrow(find, "slice long, bucket int, mask binary")


def window_matches(rows: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """[contexts, places] whether the window at a place of a context also occurs in a context of a smaller document.

    ``rows`` [contexts, width] are aligned contexts; ``left`` and ``right`` say how many bytes beside the anchor exist.
    """
    reach = length - ANCHOR
    columns = np.ascontiguousarray(rows.T)
    n = len(doc)
    out = np.zeros((n, reach + 1), bool)
    values = mix(np.arange(256, dtype=_U) + _U(1))
    power = _U(pow(0x9E3779B97F4A7C15, length, 1 << 64))
    order = np.arange(n)
    rolled = np.zeros(n, _U)  # hash of the next ``length`` bytes of each row
    for c in range(columns.shape[0] - 1, -1, -1):
        order = order[np.argsort(columns[c][order], kind="stable")]
        rolled = rolled * _U(0x9E3779B97F4A7C15) + values[columns[c]]
        if c + length < columns.shape[0]:
            rolled -= values[columns[c + length]] * power
        if c > reach:
            continue
        there = (left >= reach - c) & (right >= c)
        statistics = rolled[order]
        start = np.flatnonzero(np.concatenate([[True], statistics[1:] != statistics[:-1]]))  # run ends
        sample = np.minimum.reduceat(np.where(there, doc, NO_ID)[order], start)
        smallest = np.repeat(sample, np.diff(np.append(start, n)))
        out[order, c] = smallest < doc[order]
        out[:, c] &= there
    return out


def _first_of_equal(context: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, group): the member with the smallest (document, place) of each group of equal contexts; group by row."""
    order = np.lexsort((at, doc, context))
    head = np.concatenate([[True], context[order][1:] != context[order][:-1]]) if len(order) else np.zeros(0, bool)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(head) - 1
    return order[head], group


def _marks(slices: DataFrame, masks: DataFrame, length: int, buckets: int) -> DataFrame:
    """(slice, kind, data): (place, window bits) of long matches, and (place, place) of equal contexts of a document."""
    reach = length - ANCHOR
    width = length + reach
    record = np.dtype([("at", "<i4"), ("doc", "<i8"), ("left", "u1"), ("right", "u1"), ("row", "u1", (width,))])
    every = (1 << (reach + 1)) - 1

    def bits_that_exist(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Bit j: the window that starts ``reach - j`` bytes before the anchor."""
        left, right = left.astype(np.int64), right.astype(np.int64)
        return (every << (reach - left)) & ((1 << (right + 1)) - 1) & every

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = _Slice(row["ids"], row["sizes"], row["text"], length)
                distinct, counts = s.prints(buckets)
                cut = np.concatenate([[0], np.cumsum(counts)])
                shared = np.zeros(len(distinct), bool)
                for m in row["masks"] or []:
                    a, b = cut[m["bucket"]], cut[m["bucket"] + 1]
                    shared[a:b] = np.unpackbits(np.frombuffer(m["mask"], np.uint8), count=b - a).astype(bool)
                by_hash = np.argsort(distinct)
                place = by_hash[np.searchsorted(distinct, s.hash, sorter=by_hash)]
                use = shared[place] | (np.bincount(place, minlength=len(distinct)) > 1)[place]
                at, hashes = s.at[use], s.hash[use]
                if not len(at):
                    continue
                doc = np.searchsorted(s.offsets, at, "right") - 1
                left = np.minimum(at - s.offsets[doc], reach)
                right = np.minimum(s.offsets[doc + 1] - at - ANCHOR, reach)
                sums = prefix_sums(s.text)
                context = mix(run_hash(sums, at - left, at + ANCHOR + right) ^ (left * 256 + right).astype(_U))
                first, group = _first_of_equal(context, s.ids[doc], at)
                head = first[group]
                same = (s.ids[doc] == s.ids[doc[head]]) & (np.arange(len(at)) != head)
                later = s.ids[doc] > s.ids[doc[head]]
                out: list[tuple[int, int, bytes]] = []
                home = int(mix(np.array([row["slice"]], _U))[0] % _U(buckets))  # slice ids are multiples of a power of two
                if later.any():
                    out.append((home, 0, np.stack([at[later], bits_that_exist(left[later], right[later])]).astype(np.int64).tobytes()))
                if same.any():
                    out.append((home, 1, np.stack([at[same], at[head[same]]]).astype(np.int64).tobytes()))
                padded = np.concatenate([np.zeros(reach, np.uint8), s.text, np.zeros(width, np.uint8)])
                bucket = ((hashes[first] >> _U(40)) % _U(buckets)).astype(np.int64)
                order = np.lexsort((hashes[first], bucket))
                first, bucket = first[order], bucket[order]
                sent = np.zeros(len(first), record)
                sent["at"], sent["doc"], sent["left"], sent["right"] = at[first], s.ids[doc[first]], left[first], right[first]
                for lo in range(0, len(first), 1 << 16):
                    some = first[lo : lo + (1 << 16)]
                    places = np.arange(width)[None, :]
                    chars = padded[at[some, None] + places]
                    chars[(places < reach - left[some, None]) | (places >= reach + ANCHOR + right[some, None])] = 0
                    sent["row"][lo : lo + (1 << 16)] = chars
                edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
                for a, b in zip(edge, edge[1:]):
                    out.append((int(bucket[a]), 2, _squeeze(sent[a:b].tobytes())))
                b, kind, data = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array([row["slice"]] * len(b), pa.int64()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], ["bucket", "slice", "kind", "data"])

    def match(table: pa.Table) -> pa.Table:
        out: list[tuple[int, int, bytes]] = []
        parts, names = [], []
        for name, kind, data in zip(table.column("slice").to_pylist(), table.column("kind").to_pylist(), table.column("data").to_pylist()):
            if kind == 2:
                parts.append(np.frombuffer(_expand(data).tobytes(), record))
                names.append(name)
            else:
                out.append((name, kind, data))
        if parts:
            sent = np.concatenate(parts)
            flat = np.ascontiguousarray(sent["row"]).ravel()
            edges = np.arange(len(sent) + 1) * width
            context = np.empty(len(sent), _U)
            for lo in range(0, len(sent), 1 << 15):
                hi = min(len(sent), lo + (1 << 15))
                sums = prefix_sums(flat[edges[lo] : edges[hi]])
                context[lo:hi] = run_hash(sums, edges[lo:hi] - edges[lo], edges[lo + 1 : hi + 1] - edges[lo])
            context = mix(context ^ (sent["left"].astype(_U) * _U(256) + sent["right"]))
            first, group = _first_of_equal(context, sent["doc"], np.arange(len(sent)))
            found = window_matches(sent["row"][first], sent["left"][first].astype(np.int64), sent["right"][first].astype(np.int64), sent["doc"][first], length)
            bits = (found.astype(np.int64) << np.arange(reach + 1)).sum(axis=1)[group]
            later = sent["doc"] > sent["doc"][first][group]
            bits[later] = bits_that_exist(sent["left"][later], sent["right"][later])
            cut = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            for name, a, b in zip(names, cut, cut[1:]):
                some = np.flatnonzero(bits[a:b]) + a
                if len(some):
                    out.append((name, 0, np.stack([sent["at"][some], bits[some]]).astype(np.int64).tobytes()))
        name, kind, data = zip(*out) if out else ((), (), ())
        return pa.table([pa.array(name, pa.int64()), pa.array(kind, pa.int32()), pa.array([_squeeze(x) for x in data], pa.binary())], ["slice", "kind", "data"])

    joined = slices.join(masks, "slice", "left")
    return joined.mapInArrow(emit, "bucket int, slice long, kind int, data binary").groupBy("bucket").applyInArrow(match, "slice long, kind int, data binary")


def _removed(joined: DataFrame, length: int) -> DataFrame:
    """(id, n_bytes, spans, kept) of the documents of each slice."""
    reach = length - ANCHOR
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType())])
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = _Slice(row["ids"], row["sizes"], row["text"], 0)
                marks: list[list[np.ndarray]] = [[], []]
                for m in row["marks"] or []:
                    marks[m["kind"]].append(_expand(m["data"]).view(np.int64).reshape(2, -1))
                at, bits = np.concatenate(marks[0], axis=1) if marks[0] else np.zeros((2, 0), np.int64)
                if marks[1]:  # places of the same context in the same document share the verdict
                    place, head = np.concatenate(marks[1], axis=1)
                    order = np.argsort(at, kind="stable")
                    found = np.searchsorted(at[order], head)
                    hit = found < len(at)
                    hit[hit] = at[order][found[hit]] == head[hit]
                    at, bits = np.concatenate([at, place[hit]]), np.concatenate([bits, bits[order][found[hit]]])
                change = np.zeros(len(s.text) + 1, np.int64)
                for j in range(reach + 1):
                    start = at[(bits >> j) & 1 == 1] - reach + j
                    np.add.at(change, start, 1)
                    np.add.at(change, start + length, -1)
                covered = np.cumsum(change)[:-1] > 0
                before = np.concatenate([[False], covered])
                fresh = covered & ~before[:-1]
                inner = s.offsets[(s.offsets > 0) & (s.offsets < len(covered))]
                fresh[inner] = covered[inner]
                after = np.concatenate([covered[1:], [False]])
                last = covered & ~after
                last[inner - 1] = covered[inner - 1]
                starts, ends = np.flatnonzero(fresh), np.flatnonzero(last) + 1
                spans, kept = [], []
                cut = np.searchsorted(starts, s.offsets)
                for i, (a, b) in enumerate(zip(s.offsets.tolist(), s.offsets[1:].tolist())):
                    lo, hi = cut[i], cut[i + 1]
                    spans.append([{"start": x - a, "end": y - a} for x, y in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist())])
                    own = s.text[a:b]
                    kept.append((own[~covered[a:b]] if hi > lo else own).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(s.ids, mask=s.ids == NO_ID), pa.array(np.diff(s.offsets)), pa.array(spans, span), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, slice_bytes: int = 4 << 20) -> DataFrame:
    """Texts without the bytes covered by a ``length``-byte string that also starts in a document with a smaller id.

    Returns ``id_col`` (long), n_bytes, spans (array of (start, end): maximal removed runs, in UTF-8 bytes) and kept
    (binary: the remaining bytes), one row for each input row.  Ids are integers.  A null text is empty; texts shorter
    than ``length`` stay whole, and very long ones are slices of their own.  Rows that repeat an id are not earlier than
    each other, and rows without id come after all others.  An empty table gives no rows.  Other columns are not read.
    """
    if length < ANCHOR or length - ANCHOR > 60:
        raise ValueError(f"length must be {ANCHOR} to {ANCHOR + 60}")
    scratch = Scratch(docs.sparkSession, "repeats")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    slices = scratch.save(_slices(base, slice_bytes), "slices")
    buckets = max(12, slices.count() // 2)
    masks = scratch.save(_repeated_prints(slices, length, buckets), "masks")
    by_slice = masks.groupBy("slice").agg(F.collect_list(F.struct("bucket", "mask")).alias("masks"))
    marks = scratch.save(_marks(slices, by_slice, length, buckets), "marks")
    scratch.drop("masks")
    per_slice = marks.groupBy("slice").agg(F.collect_list(F.struct("kind", "data")).alias("marks"))
    return _removed(slices.join(per_slice, "slice", "left"), length).withColumnRenamed("id", id_col)
