"""Collocations: multi-word phrases whose words occur together more than their parts would by chance.

Counts are held in weighted acyclic automata over words.  Each shard (some megabytes of texts) counts its sorted n-grams and
builds a transducer from them, depth by depth, in which the states behind which a single word ends are shared.  Shards are cut
into ranges of the ordered (hashed) two-word prefix, so a very frequent first word is spread over ranges; all pieces of a
range are united and their weights summed.  Sequences below the threshold are then cut off, as no part of a candidate
can be rarer than the candidate.  Part lookups are compositions: a range sends a transducer of the parts its candidates need
to the ranges that count them, which send it back with the counts as weights.  A part is asked for once by each range.

Scale: the number of ranges follows the bytes of the texts, so a range stays at some megabytes of text whatever the corpus.
The ranking cuts each language to its first rows before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.bytewords import LOWER, mix, prefix_sums, run_hash, text_slices
from plumbline.llm.scratch import Scratch

SHARD_BYTES = 4 << 20
RANGE_BYTES = 16 << 20

_U = np.uint64
_BREAK = np.zeros(256, bool)  # ends a piece
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False
_LOW = 0xFFFFFFFF


def _grouped(keys: np.ndarray, values: np.ndarray, combine: np.ufunc) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, combined values, place of each row's key among them)."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = sorted_keys[1:] != sorted_keys[:-1]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(fresh) - 1
    at = np.flatnonzero(fresh)
    return sorted_keys[at], combine.reduceat(values[order], at) if len(at) else values[:0], place


def _laid_out(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the words, end to end."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    blob = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return blob, offsets - offsets[0]


def _write(arrays: list[np.ndarray]) -> bytes:
    """Non-negative integer arrays, each in the narrowest width that holds it."""
    out = [np.array([len(arrays)], "<u8").tobytes()]
    for a in arrays:
        width = next(w for w in (1, 2, 4, 8) if not len(a) or int(a.max()) < 1 << (8 * w - (w == 8)))
        out += [np.array([len(a), width], "<u8").tobytes(), a.astype(f"<u{width}").tobytes()]
    return b"".join(out)


def _read(raw: bytes) -> list[np.ndarray]:
    out, at = [], 8
    for _ in range(int(np.frombuffer(raw, "<u8", 1)[0])):
        n, width = np.frombuffer(raw, "<u8", 2, at).tolist()
        out.append(np.frombuffer(raw, f"<u{width}", n, at + 16))
        at += 16 + n * width
    return out


class Transducer:
    """Word sequences with weights.  Arc i of depth d continues arc ``source[d][i]`` of depth d - 1 with the word
    ``label[d][i]`` and has ``weight[d][i]``, the weight of the sequence that ends there (0: a prefix only).  Arcs of a depth
    are sorted by (source, label) and distinct."""

    def __init__(self, words: pa.Array, source: list[np.ndarray], label: list[np.ndarray], weight: list[np.ndarray]):
        self.words, self.source, self.label, self.weight = words, source, label, weight

    @property
    def depth(self) -> int:
        return len(self.label)

    def keys(self, d: int) -> np.ndarray:
        return self.source[d] << 32 | self.label[d]

    def to_bytes(self) -> bytes:
        blob, offsets = _laid_out(self.words)
        arrays = [np.array([self.depth]), np.diff(offsets), blob, self.label[0], self.weight[0]]
        for d in range(1, self.depth):
            fan = np.bincount(self.source[d], minlength=len(self.label[d - 1]))
            if d < self.depth - 1:
                arrays += [fan, self.label[d], self.weight[d]]
                continue
            # arcs of the last depth: a state with one arc is shared by all that have the same word and weight
            single = fan[self.source[d]] == 1
            pair, _, place = _grouped(self.label[d][single] << 32 | np.minimum(self.weight[d][single], _LOW), self.weight[d][single], np.maximum)
            one = np.zeros(len(fan), np.int64)
            one[self.source[d][single]] = place + 1
            wide = self.weight[d] > _LOW  # weights that do not fit keep a state of their own
            if wide.any():
                one[self.source[d][single & wide]] = 0
                single &= ~wide
            arrays += [one, np.where(one > 0, 0, fan), pair >> 32, pair & _LOW, self.label[d][~single], self.weight[d][~single]]
        return _write(arrays)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Transducer:
        parts = iter([a.astype(np.int64) if a.dtype != np.uint8 or i != 2 else a for i, a in enumerate(_read(raw))])
        depth, lengths, blob = int(next(parts)[0]), next(parts), next(parts)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(blob.tobytes())])
        label, weight = [next(parts)], [next(parts)]
        source = [np.zeros(len(label[0]), np.int64)]
        for d in range(1, depth):
            if d < depth - 1:
                fan = next(parts)
                source.append(np.repeat(np.arange(len(fan)), fan))
                label.append(next(parts))
                weight.append(next(parts))
                continue
            one, fan, shared_label, shared_weight, own_label, own_weight = (next(parts) for _ in range(6))
            at = np.repeat(np.arange(len(fan)), np.where(one > 0, 1, fan))
            shared = one[at] > 0
            here_label, here_weight = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
            here_label[shared], here_weight[shared] = shared_label[one[at[shared]] - 1], shared_weight[one[at[shared]] - 1]
            here_label[~shared], here_weight[~shared] = own_label, own_weight
            source.append(at)
            label.append(here_label)
            weight.append(here_weight)
        return cls(words, source, label, weight)

    @classmethod
    def of_sequences(cls, words: pa.Array, paths: list[tuple[np.ndarray, np.ndarray]], depth: int, combine: np.ufunc) -> Transducer:
        """From word numbers (rows: first word, second word, ...) with weights; equal sequences are combined, 0 is no weight."""
        source, label, weight = [], [], []
        places = [np.zeros(m.shape[1], np.int64) for m, _ in paths]
        for d in range(depth):
            through = [i for i, (m, _) in enumerate(paths) if len(m) > d]
            keys = np.concatenate([places[i] << 32 | paths[i][0][d] for i in through] or [np.zeros(0, np.int64)])
            own = np.concatenate([paths[i][1] if len(paths[i][0]) == d + 1 else np.zeros_like(paths[i][1]) for i in through] or [np.zeros(0, np.int64)])
            keys, own, place = _grouped(keys, own, combine)
            source.append(keys >> 32)
            label.append(keys & _LOW)
            weight.append(own)
            for i, p in zip(through, np.split(place, np.cumsum([paths[i][0].shape[1] for i in through])[:-1]) if through else []):
                places[i] = p
        return cls(words, source, label, weight)

    @classmethod
    def union(cls, many: list[Transducer], combine: np.ufunc = np.add) -> Transducer:
        """All sequences of all, equal ones with their weights combined."""
        alphabet = pa.chunked_array([t.words for t in many], pa.binary()).combine_chunks().dictionary_encode()
        rank = np.empty(len(alphabet.dictionary), np.int64)
        by_bytes = np.asarray(pc.sort_indices(alphabet.dictionary)).astype(np.int64)
        rank[by_bytes] = np.arange(len(rank))
        renamed = np.split(rank[np.asarray(alphabet.indices).astype(np.int64)], np.cumsum([len(t.words) for t in many])[:-1])
        source, label, weight = [], [], []
        places = [np.zeros(1, np.int64)] * len(many)
        for d in range(max(t.depth for t in many)):
            keys = np.concatenate([places[i][t.source[d]] << 32 | renamed[i][t.label[d]] for i, t in enumerate(many)])
            keys, own, place = _grouped(keys, np.concatenate([t.weight[d] for t in many]), combine)
            source.append(keys >> 32)
            label.append(keys & _LOW)
            weight.append(own)
            places = np.split(place, np.cumsum([len(t.label[d]) for t in many])[:-1])
        return cls(alphabet.dictionary.take(pa.array(by_bytes)), source, label, weight)

    def restricted(self, keep: list[np.ndarray], weight: list[np.ndarray] | None = None) -> Transducer:
        """The arcs marked in ``keep`` and those that lead to them, with an alphabet of the words left."""
        weight = weight or self.weight
        marks = [k.copy() for k in keep]
        for d in range(self.depth - 1, 0, -1):
            marks[d - 1][self.source[d][marks[d]]] = True
        used = np.unique(np.concatenate([lab[m] for lab, m in zip(self.label, marks)]))
        source, label, out = [], [], []
        before = np.zeros(1, np.int64)
        for d, m in enumerate(marks):
            source.append(before[self.source[d][m]])
            label.append(np.searchsorted(used, self.label[d][m]))
            out.append(np.where(keep[d], weight[d], 0)[m])
            before = np.cumsum(m) - 1
        return Transducer(self.words.take(pa.array(used)), source, label, out)

    def paths(self, d: int, at: np.ndarray) -> np.ndarray:
        """Word numbers of the sequences that end with arcs ``at`` of depth d: one row for each place."""
        rows = []
        for k in range(d, -1, -1):
            rows.append(self.label[k][at])
            at = self.source[k][at]
        return np.stack(rows[::-1])

    def lookup(self, words: pa.Array, paths: np.ndarray) -> np.ndarray:
        """Weights of sequences given over another alphabet (composition), 0 where there is none."""
        known = np.asarray(pc.fill_null(pc.index_in(words, self.words), -1)).astype(np.int64)
        at = np.zeros(paths.shape[1], np.int64)
        there = np.ones(paths.shape[1], bool)
        for d, row in enumerate(paths):
            if d >= self.depth or not len(self.label[d]):
                return np.zeros(len(at), np.int64)
            names = known[row]
            keys = self.keys(d)
            wanted = at << 32 | np.maximum(names, 0)
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            there &= (names >= 0) & (keys[at] == wanted)
        return np.where(there, self.weight[len(paths) - 1][at], 0)

    def ranges(self, n: int) -> list[np.ndarray]:
        """The range of every sequence: by its first two words, in the order of their hashes."""
        blob, offsets = _laid_out(self.words)
        h = run_hash(prefix_sums(blob), offsets[:-1], offsets[1:])
        place = lambda x: ((mix(x) >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)
        out = [place(h[self.label[0]])]
        for d in range(1, self.depth):
            out.append(place(h[self.label[0]][self.source[1]] * _U(0x9FB21C651E98DF25) + h[self.label[1]]) if d == 1 else out[d - 1][self.source[d]])
        return out

    def pieces(self, n: int) -> Iterator[tuple[int, Transducer]]:
        """(range, its sequences) of the ranges that have some."""
        ranges = self.ranges(n)
        marked = [w > 0 for w in self.weight]
        orders = [np.argsort(np.where(m, r, n), kind="stable") for m, r in zip(marked, ranges)]
        edges = [np.searchsorted(np.where(m, r, n)[o], np.arange(n + 1)) for m, r, o in zip(marked, ranges, orders)]
        for r in range(n):
            at = [np.sort(o[e[r] : e[r + 1]]) for o, e in zip(orders, edges)]
            if any(len(a) for a in at):
                yield r, self._picked(at)

    def _picked(self, at: list[np.ndarray]) -> Transducer:
        """As ``restricted``, from sorted arc numbers: costs what is picked, not the whole."""
        full = list(at)
        for d in range(self.depth - 1, 0, -1):
            full[d - 1] = np.union1d(full[d - 1], self.source[d][full[d]])
        used = np.unique(np.concatenate([self.label[d][a] for d, a in enumerate(full)]))
        source = [np.zeros(len(full[0]), np.int64)] + [np.searchsorted(full[d - 1], self.source[d][full[d]]) for d in range(1, self.depth)]
        weight = []
        for d, a in enumerate(full):
            w = self.weight[d][a]
            if len(a) != len(at[d]):
                w = np.where(np.isin(a, at[d], assume_unique=True), w, 0)
            weight.append(w)
        return Transducer(self.words.take(pa.array(used)), source, [np.searchsorted(used, self.label[d][a]) for d, a in enumerate(full)], weight)


def count_shard(column: pa.Array, langs: np.ndarray, n_langs: int, depth: int) -> Iterator[tuple[int, Transducer]]:
    """(language, counts of all n-grams of up to ``depth`` words inside pieces) of some texts."""
    for first, last, data, offsets in text_slices(column, 1 << 62):
        data = LOWER[data]
        flag = np.zeros(len(data) + 2, bool)
        flag[1:-1] = _WORD[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        start = np.flatnonzero(flag[1:-1] & (~flag[:-2] | edge[:-1]))
        end = np.flatnonzero(flag[1:-1] & (~flag[2:] | edge[1:])) + 1
        if not len(start):
            return
        compact = pa.py_buffer(data[flag[1:-1]].tobytes())
        places = np.concatenate([[0], np.cumsum(end - start)])
        wide = places[-1] >= 1 << 31
        found = pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), len(start), [None, pa.py_buffer(places.astype(np.int64 if wide else np.int32).tobytes()), compact])
        coded = found.dictionary_encode()
        words, ids = coded.dictionary.cast(pa.binary()), np.asarray(coded.indices).astype(np.int64)
        breaks = np.cumsum(_BREAK[data])[start]
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
        fresh = np.ones(len(start), bool)
        fresh[1:] = (breaks[1:] != breaks[:-1]) | (doc[1:] != doc[:-1])
        piece = np.cumsum(fresh)
        spoken = langs[first:last][doc]
        for lang in range(n_langs):
            mine = np.flatnonzero(spoken == lang)
            if len(mine):
                yield lang, _counted(words, ids[mine], piece[mine], depth)


def _counted(words: pa.Array, ids: np.ndarray, piece: np.ndarray, depth: int) -> Transducer:
    keys, counts, place = _grouped(ids, np.ones(len(ids), np.int64), np.add)
    source, label, weight = [np.zeros(len(keys), np.int64)], [keys], [counts]
    for d in range(1, depth):
        n = max(0, len(ids) - d)
        inside = np.flatnonzero((piece[d:] == piece[:n]) & (place[:n] >= 0))
        keys, counts, found = _grouped(place[inside] << 32 | ids[inside + d], np.ones(len(inside), np.int64), np.add)
        source.append(keys >> 32)
        label.append(keys & _LOW)
        weight.append(counts)
        place = np.full(n, -1)
        place[inside] = found
    return Transducer(words, source, label, weight)


def _shards(docs: DataFrame, depth: int, n_ranges: int) -> DataFrame:
    """(lang, range, counts) of each shard."""

    def flush(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches).combine_chunks()
        coded = rows.column("lang").combine_chunks().dictionary_encode() if rows.num_rows else pa.array([], pa.string()).dictionary_encode()
        out = []
        for lang, counts in count_shard(rows.column("text"), np.asarray(coded.indices), len(coded.dictionary), depth):
            out += [(coded.dictionary[lang].as_py(), r, piece.to_bytes()) for r, piece in counts.pieces(n_ranges)]
        langs, ranges, counts = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(ranges, pa.int32()), pa.array(counts, pa.binary())], ["lang", "range", "counts"])

    def run(batches):
        waiting, size = [], 0
        for batch in batches:
            at = 0
            for first, last, data, _ in text_slices(batch.column("text"), SHARD_BYTES):
                if waiting and size + len(data) > SHARD_BYTES:
                    yield flush(waiting)
                    waiting, size = [], 0
                waiting.append(batch.slice(first, last - first))
                size, at = size + len(data), last
        if waiting:
            yield flush(waiting)

    return docs.select("lang", "text").mapInArrow(run, "lang string, range int, counts binary")


def _decoded(table: pa.Table, column: str) -> list[Transducer]:
    return [Transducer.from_bytes(x.as_py()) for x in table.column(column)]


def _united(shards: DataFrame, least: int, n_ranges: int) -> DataFrame:
    """(lang, range, words, counts): weights of all shards summed, sequences below ``least`` cut off."""

    def run(key, rows):
        total = Transducer.union(_decoded(rows, "counts"))
        frequent = total.restricted([w >= least for w in total.weight])
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "range": pa.array([key[1].as_py()], pa.int32()), "n": pa.array([int(total.weight[0].sum())]), "counts": pa.array([frequent.to_bytes()], pa.binary())})

    # as many partitions as ranges, so that a task does not grow with the corpus
    return shards.repartition(max(8, n_ranges), "lang", "range").groupBy("lang", "range").applyInArrow(run, "lang string, range int, n long, counts binary")


def _candidates(counts: Transducer) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, counts) of the phrases of each length from two words on."""
    for d in range(1, counts.depth):
        at = np.flatnonzero(counts.weight[d] > 0)
        if len(at):
            yield counts.paths(d, at), counts.weight[d][at]


def _asked(united: DataFrame, n_ranges: int) -> DataFrame:
    """(lang, range, home, parts): parts that the candidates of ``home`` need; weights are the largest candidate's around them."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                counts = Transducer.from_bytes(batch.column("counts")[row].as_py())
                paths = []
                for m, a in _candidates(counts):
                    size = len(m)
                    spans = [(i, j) for i in range(size) for j in range(i + 1, size + 1) if j - i < size and (i == 0 or j == size or j - i > 1)]
                    paths += [(m[i:j], a) for i, j in spans]
                if not paths:
                    continue
                wanted = Transducer.of_sequences(counts.words, paths, counts.depth, np.maximum)
                out = [(r, piece.to_bytes()) for r, piece in wanted.pieces(n_ranges)]
                n = len(out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("lang")[row].as_py()] * n, pa.string()), pa.array([r for r, _ in out], pa.int32()), pa.array([batch.column("range")[row].as_py()] * n, pa.int32()), pa.array([b for _, b in out], pa.binary())],
                    ["lang", "range", "home", "parts"],
                )

    return united.select("lang", "range", "counts").mapInArrow(run, "lang string, range int, home int, parts binary")


def _answered(united: DataFrame, asked: DataFrame) -> DataFrame:
    """(lang, range, longer, parts): the parts that a range asked for with their counts, and (longer) the count of the largest
    candidate around each phrase of the range itself."""

    def run(key, counts, wanted):
        rows = []
        known = _decoded(counts, "counts")
        if known and wanted.num_rows:
            parts = _decoded(wanted, "parts")
            for home, part in zip(wanted.column("home").to_pylist(), parts):
                weight = [np.where(w > 0, known[0].lookup(part.words, part.paths(d, np.arange(len(w)))), 0) for d, w in enumerate(part.weight)]
                rows.append((home, False, Transducer(part.words, part.source, part.label, weight).to_bytes()))
            around = Transducer.union(parts, np.maximum)
            rows.append((key[1].as_py(), True, around.restricted([(w > 0) & (d > 0) for d, w in enumerate(around.weight)]).to_bytes()))
        n = len(rows)
        return pa.table({"lang": pa.array([key[0].as_py()] * n, pa.string()), "range": pa.array([r[0] for r in rows], pa.int32()), "longer": pa.array([r[1] for r in rows], pa.bool_()), "parts": pa.array([r[2] for r in rows], pa.binary())})

    return united.groupBy("lang", "range").cogroup(asked.groupBy("lang", "range")).applyInArrow(run, "lang string, range int, longer boolean, parts binary")


def _with_parts(united: DataFrame, answers: DataFrame) -> DataFrame:
    """(lang, phrase, a, longer, cuts): candidates with the counts of the two parts of every cut."""
    cut = pa.struct([("k", pa.int32()), ("l", pa.int64()), ("r", pa.int64())])
    names = ["lang", "phrase", "a", "longer", "cuts"]
    types = [pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.list_(cut)]

    def run(key, counts, found):
        tables = []
        if counts.num_rows and found.num_rows:
            mine = _decoded(counts, "counts")[0]
            flags = found.column("longer").to_pylist()
            parts = _decoded(found, "parts")
            count = Transducer.union([p for p, f in zip(parts, flags) if not f] or [mine])
            around = [p for p, f in zip(parts, flags) if f]
            for m, a in _candidates(mine):
                size, n = m.shape
                longer = around[0].lookup(mine.words, m) if around else np.zeros(n, np.int64)
                left = np.stack([count.lookup(mine.words, m[:k]) for k in range(1, size)], axis=1)
                right = np.stack([count.lookup(mine.words, m[k:]) for k in range(1, size)], axis=1)
                k = np.tile(np.arange(1, size, dtype=np.int32), n)
                cuts = pa.StructArray.from_arrays([pa.array(k), pa.array(left.ravel()), pa.array(right.ravel())], fields=list(cut))
                phrase = pc.binary_join_element_wise(*[mine.words.take(pa.array(row)) for row in m], b" ")
                columns = [pa.array([key[0].as_py()] * n, pa.string()), phrase, pa.array(a), pa.array(longer), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (size - 1)), cuts)]
                tables.append(pa.table(dict(zip(names, columns))))
        return pa.concat_tables(tables) if tables else pa.table({c: pa.array([], t) for c, t in zip(names, types)})

    return united.groupBy("lang", "range").cogroup(answers.groupBy("lang", "range")).applyInArrow(run, "lang string, phrase binary, a long, longer long, cuts array<struct<k:int,l:long,r:long>>")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 3, least: int = 10, share: int = 50, top: int = 2000, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The first ``top`` phrases of every language, by how far their words attract each other.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line breaks and into words at spaces and tabs.  Candidates
    are phrases of 2 to ``max_words`` words inside a piece that occur ``least`` times (a) or more, overlaps included.  A cut after k words
    gives l and r, the counts of both parts, and the score floor(1000000 a a / (l r)) (exact decimals); the lowest score counts,
    ties to the smallest k.  A candidate is dropped if a longer one that holds it has ``share`` percent of its count or more.
    Returns lang, rank, phrase, a, l, r, k, n (all words of the language), score; ordered by score and a descending, phrase
    ascending in UTF-8 bytes.  Null text: no words.  Null language: ``und``.  Repeated rows count each time; ids are not read.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    base = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_ranges = max(1, -(-size // range_bytes))
    united = scratch.save(_united(_shards(base, max_words, n_ranges), least, n_ranges), "united")
    answers = _answered(united, _asked(united, n_ranges))
    found = _with_parts(united, answers).filter(100 * F.col("longer") < share * F.col("a"))
    score = "cast(1000000 as decimal(7,0)) * (cast(a as decimal(16,0)) * cast(a as decimal(16,0))) div (cast(c.l as decimal(16,0)) * cast(c.r as decimal(16,0)))"
    scored = found.select("lang", F.col("phrase").cast("string").alias("phrase"), "a", F.expr(f"array_min(transform(cuts, c -> struct({score} as score, c.k as k, c.l as l, c.r as r)))").alias("cut"))
    scored = scratch.save(scored.select("lang", "phrase", "a", "cut.*"), "scored")
    # scores that cannot be among the first leave before a language meets in one task: counts of 1,001 score steps tell
    step = F.expr("score div 1000")
    steps = scored.groupBy("lang", step.alias("step")).agg(F.count(F.lit(1)).alias("m"))
    above = F.sum("m").over(Window.partitionBy("lang").orderBy(F.desc("step"))) - F.col("m")
    lowest = scratch.save(steps.withColumn("above", above).filter(F.col("above") < top).groupBy("lang").agg(F.min("step").alias("lowest")), "lowest")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = scored.join(lowest, "lang").filter(step >= F.col("lowest")).drop("lowest")
    ranked = first.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    totals = united.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "k", "n", "score")
