"""Formats learned from labelled values decide on values without a label."""

import random
import re

from plumbline.llm.secrets import CANDIDATE, FormatModel, base_spans, scan_secrets

r = random.Random(11)
HEX = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
PROSE = lambda n: " ".join("".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 14))) for _ in range(n))


def documents():
    rows = [(i, f"{PROSE(40)} token: {HEX(40)} {PROSE(5)}") for i in range(40)] + [(100 + i, PROSE(60)) for i in range(120)]
    rows += [(300 + i, f"{PROSE(10)} {HEX(26)} {PROSE(10)}, {HEX(20)}.") for i in range(15)] + [(400, None), (401, ""), (402, "x" * 100_000)]
    return rows


def test_unlabelled_values_of_a_learned_format_are_found(spark):
    rows = documents()
    got = {x["doc_id"]: x["spans"] for x in scan_secrets(spark.createDataFrame([(k, t, "s") for k, t in rows], "doc_id long, text string, spans string")).collect()}
    text = dict(rows)
    hits = [text[k][s["start"] : s["end"]] for k, spans in got.items() for s in spans if s["kind"] == "format"]
    planted = [x for k, t in rows if 300 <= k < 400 for x in re.findall(r"[0-9a-f]{20,26}", t)]
    assert len(planted) == 30 and sum(any(p in h for h in hits) for p in planted) >= 27
    assert not any(s["kind"] == "format" for k, spans in got.items() if k < 300 or k >= 400 for s in spans)
    assert all(s["score"] > 0.7 for k, spans in got.items() for s in spans if s["kind"] == "format") and got[400] == got[401] == got[402] == []


def test_scan_equals_scoring_every_candidate(spark):
    rows = documents()
    labelled, ordinary = {"assign": set(), "access": set(), "hex": set()}, set()
    free = {}
    for k, t in rows:
        base = base_spans(t or "")
        for _, kind, _, v in base:
            labelled[("assign", "access", "hex")[kind]].add(v)
        free[k] = [(m.start(), m.end(), m[0]) for m in CANDIDATE.finditer(t or "") if not any(s < m.end() and m.start() < e for s, _, e, _ in base)]
        ordinary |= {x for _, _, x in free[k] if len(x) <= 128}
    model = FormatModel({k: sorted(v) for k, v in labelled.items()}, sorted(ordinary), 0.7)
    want = {k: [(a, b) for a, b, x in spans if model.typical(x) and model.score(x) > 0.7] for k, spans in free.items()}
    got = scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"), sample=20_000).collect()
    assert {x["doc_id"]: [(s["start"], s["end"]) for s in x["spans"] if not s["base"]] for x in got} == want and any(want.values())


def test_few_values_need_a_larger_margin():
    usual = [PROSE(1) + "abcdefgh" for _ in range(200)]
    few, many = FormatModel({"hex": [HEX(40) for _ in range(2)]}, usual, 0.7), FormatModel({"hex": [HEX(40) for _ in range(400)]}, usual, 0.7)
    value = HEX(40)
    assert not few.is_secret(value) and many.is_secret(value) and few.score(value) < many.score(value)
    assert FormatModel({}, usual, 0.7).score(value) is None
