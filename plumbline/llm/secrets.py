"""Secret scan: fixed patterns, and formats learned by grammar inference.

The values that the patterns find are labelled credentials.  For each kind a probabilistic automaton is inferred from
them: a prefix tree of their character classes whose states are merged while their outgoing and ending frequencies are
compatible (ALERGIA, red and blue states, Hoeffding bound).  Every other token of every text over the same alphabet and of
the same length (8 characters and more) is then scored by its likelihood under the automata against that under ordinary
tokens, words among them; a token whose format is far likelier as a credential is added as a span of the kind ``format``.
Its characters must be as likely as those of labelled values, and tokens of which that is true are left out where the
ordinary ones are learned.  An automaton of few values needs a larger margin, which falls with their number.

The fit uses at most ``sample`` distinct values of each kind and as many ordinary tokens, those with the smallest hash, on
the driver; tasks send no more than that for a batch.  The automata are a few kilobytes.  Scanning is one pass over all texts for the fit and one for the result.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.scratch import Scratch

# fixed values: the base patterns
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # maximal runs, as a run of 32 or more starts where the run starts
KINDS = ("assign", "access", "hex")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: alphabet and least length of the labelled values; a full stop at the end ends the sentence
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{7,}[A-Za-z0-9+/_=-]")
#: values of a kind at which its margin is twice the usual one
FEW = 20
#: tokens whose verdict a task remembers
REMEMBERED = 200_000


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base patterns, in code points, sorted."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, token) of tokens that touch no base span."""
    out, taken, at = [], [(s, e) for s, _, e, _ in base], 0
    reach = 0
    for m in CANDIDATE.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= m.start():
            out.append((m.start(), m.end(), m[0]))
    return out


def char_class(c: str) -> str:
    """Digits, hex letters, other lower case, upper case; other characters stand for themselves."""
    return "0" if c.isdigit() else "a" if c in "abcdef" else "z" if c.islower() else "Z" if c.isupper() else c


class Automaton:
    """Probabilistic automaton of strings, inferred from a sample by state merging."""

    def __init__(self, alpha: float = 0.05):
        self.alpha = alpha
        self.ends: list[int] = []
        self.next: list[dict[str, tuple[int, int]]] = []  # state -> symbol -> (state, count)

    def _tree(self, values: list[str]) -> None:
        self.ends, self.next = [0], [{}]
        for value in values:
            state = 0
            for c in map(char_class, value):
                to, n = self.next[state].get(c, (len(self.ends), 0))
                if n == 0:
                    self.ends.append(0)
                    self.next.append({})
                self.next[state][c] = (to, n + 1)
                state = to
            self.ends[state] += 1

    def _total(self, s: int) -> int:
        return self.ends[s] + sum(n for _, n in self.next[s].values())

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, red: int, blue: int) -> bool:
        todo = [(red, blue)]
        while todo:
            a, b = todo.pop()
            na, nb = self._total(a), self._total(b)
            if not na or not nb:
                continue
            if self._differ(self.ends[a], na, self.ends[b], nb):
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                ta, fa = self.next[a].get(c, (-1, 0))
                tb, fb = self.next[b].get(c, (-1, 0))
                if self._differ(fa, na, fb, nb):
                    return False
                if ta >= 0 and tb >= 0:
                    todo.append((ta, tb))
        return True

    def _fold(self, red: int, blue: int) -> None:
        todo = [(red, blue)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            for c, (tb, fb) in self.next[b].items():
                if c in self.next[a]:
                    ta, fa = self.next[a][c]
                    self.next[a][c] = (ta, fa + fb)
                    if ta != tb:
                        todo.append((ta, tb))
                else:
                    self.next[a][c] = (tb, fb)

    def fit(self, values: list[str]) -> Automaton:
        self._tree(values)
        red, n_values = [0], len(values)
        while True:
            known = set(red)
            blue = sorted({(-n, t, s, c) for s in red for c, (t, n) in self.next[s].items() if t not in known})
            if not blue:
                break
            _, b, parent, symbol = blue[0]  # the one seen most often
            for r in red:
                if self._compatible(r, b):
                    count = self.next[parent][symbol][1]
                    self.next[parent][symbol] = (r, count)
                    self._fold(r, b)
                    break
            else:
                red.append(b)
        number = {s: i for i, s in enumerate(red)}
        self.ends = [self.ends[s] for s in red]
        self.next = [{c: (number[t], n) for c, (t, n) in self.next[s].items()} for s in red]
        self.values = n_values
        return self

    def steps(self, value: str, symbols: int = 64) -> list[float]:
        """Log probability of each character and of the end; what was never seen has a small share."""
        state, out = 0, []
        for c in map(char_class, value):
            n = self._total(state) if state is not None else 0
            to, f = self.next[state].get(c, (None, 0)) if state is not None else (None, 0)
            out.append(math.log((f + 0.1) / (n + 0.1 * symbols)))
            state = to
        end = self.ends[state] if state is not None else 0
        n = self._total(state) if state is not None else 0
        return [*out, math.log((end + 0.1) / (n + 0.1 * symbols))]

    def log_likelihood(self, value: str) -> float:
        """Mean log probability by character, the end included."""
        steps = self.steps(value)
        return sum(steps) / len(steps)


class FormatModel:
    """Automata of the credential kinds and of ordinary tokens."""

    def __init__(self, kinds: dict[str, list[str]], ordinary: list[str], margin: float):
        self.margin = margin
        self.kinds = {k: Automaton().fit(sorted(v)) for k, v in kinds.items() if v}
        self.spread, self.needed = {}, {}
        for k, a in self.kinds.items():
            classes = Counter(c for v in kinds[k] for c in set(map(char_class, v)))
            self.needed[k] = {c for c, n in classes.items() if 100 * n >= 99 * len(kinds[k])}
            steps = [x for v in kinds[k] for x in a.steps(v)[:-1]]
            mean = sum(steps) / len(steps)
            self.spread[k] = mean, math.sqrt(sum((x - mean) ** 2 for x in steps) / len(steps))
        # unlabelled credentials among the ordinary tokens would teach their format to the other side
        self.ordinary = Automaton().fit(sorted(t for t in ordinary if not self.typical(t)))
        self.known: dict[str, float] = {}

    def typical(self, token: str) -> bool:
        """Whether a token has the kinds of characters that all values of an automaton have, and is as likely as they are, up to
        chance.  A number is not, where all values mix digits and letters."""
        for k, a in self.kinds.items():
            mean, deviation = self.spread[k]
            steps = a.steps(token)[:-1]
            if self.needed[k] <= set(map(char_class, token)) and abs(sum(steps) / len(steps) - mean) <= 4 * deviation / math.sqrt(len(steps)) + 1e-9:
                return True
        return False

    def score(self, token: str) -> float | None:
        """How much likelier (mean log by character) the token is as a credential, less what its automaton lacks in values."""
        if not self.kinds:
            return None
        usual = self.ordinary.log_likelihood(token)
        return max(a.log_likelihood(token) - usual - self.margin * FEW / a.values for a in self.kinds.values())

    def is_secret(self, token: str) -> bool:
        if token not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[token] = self.score(token) if self.typical(token) else -math.inf
        return self.known[token] > self.margin


def _values(docs: DataFrame, sample: int, longest: int) -> DataFrame:
    """(kind, value, h) of base matches and of ordinary tokens: of each batch the ``sample`` distinct ones of a kind with the
    smallest hash, among which are all that can be among the smallest of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, set[str]] = {k: set() for k in (*KINDS, "ordinary")}
            for text in batch.column("text").to_pylist():
                if text:
                    base = base_spans(text)
                    for _, k, _, v in base:
                        found[KINDS[k]].add(v)
                    found["ordinary"].update([t for _, _, t in candidates(text, base)])
            rows = []
            for kind, values in found.items():
                hashed = [(zlib.crc32(v.encode()), v) for v in values if len(v) <= longest]
                rows += [(kind, v, h) for h, v in heapq.nsmallest(sample, hashed)]
            kind, value, h = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(value, pa.string()), pa.array(h, pa.int64())], ["kind", "value", "h"])

    return docs.select("text").mapInArrow(run, "kind string, value string, h long")


def fit_formats(docs: DataFrame, scratch: Scratch, sample: int, longest: int, margin: float) -> FormatModel:
    distinct = scratch.save(_values(docs, sample, longest).distinct(), "values")
    groups = {k: [r["value"] for r in distinct.filter(F.col("kind") == k).orderBy("h", "value").limit(sample).select("value").collect()] for k in (*KINDS, "ordinary")}
    return FormatModel({k: groups[k] for k in KINDS}, groups["ordinary"], margin)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 2000, longest: int = 128, margin: float = 0.7) -> DataFrame:
    """Spans of secrets in every text.

    Returns ``id_col`` and spans: array of (kind, start, end, base, score) by start, then kind in the order assign, access, hex,
    format; code points, end exclusive; base marks those of the fixed patterns.  A row for each input row, rows that
    repeat an id included; score is the log likelihood ratio of the value's format by character, null where nothing could be
    learned.  Null and empty texts have no spans.  Without any labelled value only the fixed patterns are looked for.  Values of up to ``longest`` characters are learned from,
    tokens of any length are scored.  Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = fit_formats(base, scratch, sample, longest, margin)
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType()), T.StructField("score", T.DoubleType())])
    arrow_span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                found = base_spans(text) if text else []
                spans = found + [(s, 3, e, t) for s, e, t in candidates(text or "", found) if model.is_secret(t)]
                rows.append([{"kind": (*KINDS, "format")[k], "start": s, "end": e, "base": k < 3, "score": model.score(v)} for s, k, e, v in sorted(spans)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, arrow_span)], ["id", "spans"])

    return base.mapInArrow(run, T.StructType([base.schema["id"], T.StructField("spans", T.ArrayType(span))])).withColumnRenamed("id", id_col)
