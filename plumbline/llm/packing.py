"""Packing of tokenised documents into windows of fixed capacity, by multiway differencing.

Every task packs the documents it reads, in rounds of about ``windows_per_round`` windows, so nothing is shuffled and
memory is bounded by a round.  A document longer than a window gives whole windows and one remainder.  The remainders of
a round are partitioned by Karmarkar-Karp multiway differencing: each starts as a partial partition with one loaded
part; the two partial partitions with the largest imbalance are merged, the fullest part of one with the emptiest of
the other, until one partition is left.  Its parts are near-equal windows.  Where one exceeds the capacity, the window
count rises and the round is packed again.
"""

from __future__ import annotations

import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumbline.llm.registry import ship

#: words remembered by each Python worker in either of two generations
CACHE_WORDS = 1_000_000
#: characters that form tokens of their own after the letters of a word
TAILS = ".,;:!?*#$%&"


class WordTokens:
    """Token ids of texts as little-endian 32-bit bytes; words that were seen are remembered.

    Holds for BPE vocabularies with word ends, whose tokens reach neither over white space nor from a letter to another
    kind of character.  Words between ASCII white space are looked up one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.new: dict[bytes, bytes] = {}  # two generations of remembered words
        self.old: dict[bytes, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _one(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of letters only: many at once, as each has exactly one token that ends a word."""
        out = {}
        for first in range(0, len(words), 5000):
            part = words[first : first + 5000]
            found = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            stops = np.flatnonzero(self.ends[found]) + 1
            if len(stops) == len(part):
                data, stops = found.tobytes(), [0, *(4 * stops).tolist()]
                out |= {w: data[a:b] for w, a, b in zip(part, stops, stops[1:])}
            else:
                out |= {w: self._one(w) for w in part}
        return out

    def _learn(self, missing: set[bytes]) -> None:
        cores: dict[bytes, tuple[str, str]] = {}
        for raw in missing:
            word = raw.decode()
            core = word.rstrip(TAILS)
            # lower-casing can leave a combining mark, which belongs to the tail's run: only letters that stay letters are split
            if unicodedata.normalize("NFC", core).lower().isalpha():
                cores[raw] = core, word[len(core) :]
            else:
                self.new[raw] = self._one(word)
        letters = self._letters(list({core for core, _ in cores.values()}))
        for raw, (core, tail) in cores.items():
            ids = letters[core]
            if tail:
                if tail not in self.tails:
                    self.tails[tail] = self._one(tail)
                ids += self.tails[tail]
            self.new[raw] = ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        raw = [(t or "").encode() for t in texts]
        # the vocabulary is lower case; only texts that may hold a special token keep theirs
        split = [(r if b"<|" in r else r.lower()).split() for r in raw]
        missing = set()
        for word in set().union(*split):  # set differences with the remembered words would walk all of them
            if word not in self.new:
                if word in self.old:  # what is still in use moves on
                    self.new[word] = self.old[word]
                else:
                    missing.add(word)
        if missing:
            self._learn(missing)
        out = [b"".join(map(self.new.__getitem__, words)) for words in split]
        if len(self.new) > CACHE_WORDS:
            self.old, self.new = self.new, {}
        return out


@lru_cache(maxsize=2)
def _word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def differencing(sizes: list[int], parts: int) -> list[list[int]]:
    """Indexes of ``sizes`` in ``parts`` lists whose sums are near-equal (Karmarkar-Karp)."""
    if not sizes:
        return [[] for _ in range(parts)]
    heap: list = []
    for i, size in enumerate(sizes):
        loads = np.zeros(parts, np.int64)
        loads[0] = size
        heap.append((-size, i, loads, [[i]] + [None] * (parts - 1)))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, loads, members = heapq.heappop(heap)
        _, _, other, others = heapq.heappop(heap)
        loads = loads + other[::-1]
        joined = [a if not b else b if not a else a + b for a, b in zip(members, reversed(others))]
        order = np.argsort(-loads, kind="stable")
        loads = loads[order]
        heapq.heappush(heap, (int(loads[-1] - loads[0]), i, loads - loads[-1], [joined[x] for x in order]))
    return [m or [] for m in heap[0][3]]


def windows_for(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``, as few as differencing reaches."""
    parts = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, parts)
        if max(sum(sizes[i] for i in part) for part in found) <= capacity:
            return [part for part in found if part]
        parts += 1


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 2, windows_per_round: int = 96) -> DataFrame:
    """Pieces of documents with their place in a sequence.

    Returns ``id_col``, start (ids of the document before the piece), length, ids (little-endian unsigned 32-bit token
    ids of the piece), doc_tokens, sequence_id and offset (long), one row for each piece.  Each document is its token ids
    followed by ``end_id``; a null or empty text is ``end_id`` alone.  The pieces of a sequence follow each other without
    gaps and hold at most ``capacity`` ids; each id of a document lies in exactly one piece.  Rows that repeat an id, or
    have none, are documents of their own.  sequence_id is (task, number in the task), so it is the same when a task is
    run again.  An empty table gives no rows.  Other columns are not read.
    """
    ship(docs.sparkSession)
    base = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    whole = [T.StructField(n, T.LongType()) for n in ("start", "length")]
    rest = [T.StructField(n, T.LongType()) for n in ("doc_tokens", "sequence_id", "offset")]
    schema = T.StructType([base.schema["id"], *whole, T.StructField("ids", T.BinaryType()), *rest])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() << 33
        tokens = _word_tokens(tokenizer_path)
        sequence = 0
        pieces: list[tuple] = []  # (id, start, ids, doc_tokens) of the round
        held = 0
        id_type = None

        def rows(windows: list[list[tuple]]) -> pa.RecordBatch:
            nonlocal sequence
            out: list[list] = [[] for _ in range(7)]
            for window in windows:
                offset = 0
                for key, start, data, total in window:
                    n = len(data) // 4
                    for column, value in zip(out, (key, start, n, data, total, task + sequence, offset)):
                        column.append(value)
                    offset += n
                sequence += 1
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], schema.names)

        def flush() -> pa.RecordBatch:
            nonlocal pieces, held
            found = windows_for([len(p[2]) // 4 for p in pieces], capacity)
            batch = rows([[pieces[i] for i in part] for part in found])
            pieces, held = [], 0
            return batch

        for batch in batches:
            id_type = batch.schema.field("id").type
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                full = []
                for key, data in zip(part.column("id").to_pylist(), tokens.encode(part.column("text").to_pylist())):
                    data += end
                    n = len(data) // 4
                    cut = n - n % capacity
                    full += [[(key, s, data[4 * s : 4 * (s + capacity)], n)] for s in range(0, cut, capacity)]
                    if cut < n:
                        pieces.append((key, cut, data[4 * cut :], n))
                        held += n - cut
                        if held >= windows_per_round * capacity:
                            yield flush()
                if full:
                    yield rows(full)
        if pieces:
            yield flush()

    return base.mapInArrow(run, schema).withColumnRenamed("id", id_col)
