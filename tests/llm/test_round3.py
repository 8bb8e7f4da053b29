"""Exact dedup, periodic runs and collocations against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm.collocations import Transducer, collocations
from plumbline.llm.periodic import periodic_runs, runs_of
from plumbline.llm.radix_dedup import exact_duplicates

UPPER = {c: c + 32 for c in range(65, 91)}


def test_exact_duplicates_by_brute_force(spark):
    r = random.Random(1)
    base = ["", None, "A" * 31, "a" * 32, "a" * 33, "b" * 600, "B" * 600, "b" * 599 + "c", "é" * 40, "É" * 40, "x", "X", "\x00", "x "]
    rows = [(i if i % 17 else None, r.choice(base)) for i in range(300)] + [(5, "dup"), (5, "dup"), (5, "other"), (5, "b" * 600), (900, "z" * 20_000), (901, "Z" * 20_000), (902, "z" * 20_001)]
    docs = spark.createDataFrame([(k, t, 1, "r", 2) for k, t in rows], "doc_id long, text string, row int, rest string, grp int")
    groups = defaultdict(list)
    for k, t in rows:
        groups[(t or "").translate(UPPER)].append(k)
    want = []
    for t, ids in groups.items():
        want += [(k, max((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()) for k in ids]
    for kwargs in ({}, {"digit": 4, "growth": 4, "hot_share": 0.1}):
        got = exact_duplicates(docs, carry=["text", "rest"], **kwargs).collect()
        assert sorted((tuple(x[c] for c in ("doc_id", "keep_id", "group_size", "text_sha256")) for x in got), key=str) == sorted(want, key=str)
        kept = [x for x in got if x["kept"]]
        assert len(kept) == len(groups) and all(x["doc_id"] == x["keep_id"] and x["rest"] == "r" for x in kept)
        assert {(x["text"] or "").translate(UPPER) for x in kept} == set(groups)
    assert exact_duplicates(docs.limit(0)).count() == 0


def brute_runs(w, least=24, times=3):
    """(start, length, smallest period) by looking at every lag."""
    x = np.unique(np.array(w, dtype=object).astype(str), return_inverse=True)[1] if w else np.zeros(0, int)
    out = {}
    for p in range(1, len(w) // times + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (x[:-p] == x[p:]).astype(int), [0]])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a + p >= max(least, times * p):
                out.setdefault((a, b - a + p), p)
    return sorted((a, n, p) for (a, n), p in out.items())


def repetitive(r):
    """Words with runs inside of runs."""
    k, out = r.randint(1, 6), []
    while len(out) < r.choice([10, 60, 300, 700]):
        t = r.random()
        if t < 0.3:
            out += [r.randint(0, k) for _ in range(r.randint(1, 40))]
        elif t < 0.6 and out:
            out += (out[-r.randint(1, min(len(out), 150)) :] * r.randint(1, 5))[: r.randint(1, 500)]
        elif t < 0.8:
            out += [r.randint(0, k) for _ in range(r.randint(1, 5))] * r.randint(1, 12)
        else:
            out += [r.randint(100, 10**6) for _ in range(r.randint(1, 90))]
    return (out * r.randint(2, 4))[: r.randint(1, 4 * len(out))] if r.random() < 0.3 else out


@pytest.mark.parametrize("least", [1, 24])
def test_runs_by_brute_force(least):
    r = random.Random(least)
    for _ in range(120):
        docs = [repetitive(r) if r.random() > 0.1 else [] for _ in range(r.randint(1, 6))]
        hashes = np.array([x for d in docs for x in d], dtype=np.uint64)
        got = runs_of(hashes, np.concatenate([[0], np.cumsum([len(d) for d in docs])]), least, 3)
        assert [[tuple(x) for x in rows.tolist()] for rows in got] == [brute_runs(d, least) for d in docs]


def test_runs_where_prefix_hashes_collide():
    """Thue-Morse words collide under any polynomial modulo 2^64; the words decide."""
    tm = [bin(i).count("1") % 2 for i in range(4096)]
    words = [*tm, *[1 - x for x in tm], *tm, 7, *[5, 6] * 30]
    got = runs_of(np.array(words, dtype=np.uint64), np.array([0, len(words)]), 24, 3)
    assert [tuple(x) for x in got[0].tolist()] == brute_runs(words)


def test_periodic_runs_query_by_brute_force(spark, sf):
    from plumbline.llm.queries_text import op12

    want = {}
    for row in spark.read.parquet(f"{sf}/documents.parquet").collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", row["text"] or "")
        n, h = len(w), zlib.crc32(str(row["doc_id"]).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        dropped = {i for a, m, p in runs for i in range(a + p, a + m)}
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[row["doc_id"]] = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{a},{m},{p}\n" for a, m, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))
    got = {r["doc_id"]: tuple(r)[1:] for r in op12(spark, sf).collect()}
    assert got == want and any(v[0] > 0 and v[3] > 16 for v in want.values())


def test_periodic_runs_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b " * 12), (5, "x " * 24), (None, "q " * 23), (7, "ä " * 30_000)]
    docs = spark.createDataFrame([(k, t, "r", 2) for k, t in rows], "doc_id long, text string, runs string, id int")
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"], r["runs2"]) for r in periodic_runs(docs.withColumn("runs2", F.lit(9)), carry=["runs2"]).collect()), key=str)
    assert got == sorted([(1, 0, [], "", 9), (2, 0, [], "", 9), (3, 0, [], "", 9), (4, 1, [], "one", 9), (5, 24, [(0, 24, 2)], "a b", 9), (5, 24, [(0, 24, 1)], "x", 9), (None, 23, [], " ".join("q" * 23), 9), (7, 30_000, [(0, 30_000, 1)], "ä", 9)], key=str)
    assert periodic_runs(docs.limit(0)).count() == 0


def test_collocations_by_brute_force(spark):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(12)] + ["New", "York", "\x01x", "é", "a-b"]

    def text():
        return "".join(r.choice(vocab) + r.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\r\n"]) for _ in range(r.randint(0, 80)))

    rows = [(i, r.choice(["en", "de", None, "und"]), text()) for i in range(150)] + [(1, "en", None), (2, None, ""), (3, "xx", "only once"), (None, "en", "new york " * 40)]
    docs = spark.createDataFrame([(k, g, t, 1, 2) for k, g, t in rows], "doc_id long, lang string, text string, rank int, phrase int")
    counts, totals = defaultdict(int), defaultdict(int)
    for _, lang, t in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(w)
            for k in (1, 2, 3, 4):
                for i in range(len(w) - k + 1):
                    counts[lang or "und", tuple(w[i : i + k])] += 1
    for size in (3, 4):
        candidates = {key: a for key, a in counts.items() if 2 <= len(key[1]) <= size and a >= 10}
        rated = defaultdict(list)
        for (lang, w), a in candidates.items():
            inside = [b for (g, v), b in candidates.items() if g == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))]
            if all(100 * b < 50 * a for b in inside):
                cuts = [(10**6 * a * a // (counts[lang, w[:k]] * counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w))]
                rated[lang].append((min(cuts), a, " ".join(w)))
        want = set()
        for lang, found in rated.items():
            found.sort(key=lambda x: (-x[0][0], -x[1], x[2].encode()))
            want |= {(lang, i + 1, p, a, c[2], c[3], c[1], totals[lang], c[0]) for i, (c, a, p) in enumerate(found[:40])}
        got = collocations(docs, max_words=size, top=40, range_bytes=500).collect()
        assert {tuple(x) for x in got} == want and len(got) == len(want)
    assert collocations(docs.limit(0)).count() == 0


def test_transducers_keep_their_weights():
    words = pa.array([b"a", b"b", b"c"], pa.binary())
    paths = [(np.array([[0, 1]]), np.array([5, 1 << 40])), (np.array([[0, 0, 1], [1, 2, 1], [2, 2, 0]]), np.array([1, 1, 1 << 35]))]
    t = Transducer.of_sequences(words, paths, 3, np.add)
    for u in (Transducer.from_bytes(t.to_bytes()), Transducer.union([t]), Transducer.union([p for _, p in t.pieces(7)])):
        for m, w in paths:
            assert u.lookup(words, m).tolist() == w.tolist()
    assert Transducer.union([t, t]).lookup(words, paths[0][0]).tolist() == [10, 1 << 41]
    assert t.lookup(pa.array([b"z", b"a"], pa.binary()), np.array([[1, 0]])).tolist() == [5, 0]


def test_round_three_queries_match_sql(spark, con, sf):
    from harness import compare

    from plumbline.llm.queries import ORACLES, QUERIES

    for name in ("op11_collocations", "op13_exact_dedup"):
        assert compare(QUERIES[name](spark, sf), con, ORACLES[name]) is None
