"""Registered queries against their SQL, brute force or held-out labels."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
from harness import compare, connect

from plumbline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, spark):
    assert compare(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) is None


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


def documents(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_quality_statistics_by_brute_force(spark):
    got = {r["doc_id"]: r for r in QUERIES["op4_quality_rules"](spark, SF).collect()}
    for key, text in documents(spark).items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(zip(words, words[1:], words[2:]))
        again = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed)
        r = got[key]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert not (failed and r["kept"])


def test_secret_spans_by_brute_force(spark):
    got = {r["doc_id"]: r for r in QUERIES["op7_secret_scan"](spark, SF).collect()}
    patterns = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 8, 2),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 16, 0),
        ("hex", re.compile(r"[0-9a-f]+"), 32, 0),
    ]
    for key, text in documents(spark).items():
        found = sorted((m.start(), k, m.end()) for k, (_, p, least, group) in enumerate(patterns) for m in p.finditer(text) if len(m[group]) >= least)
        written = ",".join(f"{patterns[k][0]}:{a}:{b}" for a, k, b in found)
        assert got[key]["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert set(filter(None, written.split(","))) <= set(got[key]["spans"].split(","))


def test_packing_round_trip(spark):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = QUERIES["op8_packing"](spark, SF).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for key, text in documents(spark).items():
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(pieces[key], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096


def test_licenses_by_text_search(spark):
    rows = QUERIES["op2_license_scan"](spark, SF).collect()
    phrases = {"apache-2.0": "licensed under the apache license, version 2.0", "mit": "released under the mit license", "cc-by-nc-4.0": "licensed under cc by-nc 4.0"}
    for name, phrase in phrases.items():
        assert {r["doc_id"] for r in rows if r["license"] == name} == {k for k, t in documents(spark).items() if phrase in t.lower()}


@pytest.mark.parametrize("name,label", [("op5_quality_classifier", "quality"), ("op10_toxicity", "toxic")])
def test_held_out_accuracy(name, label, spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES[name](spark, sf).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.93 * len(held) > 0
