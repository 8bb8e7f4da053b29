"""Edge cases of the operators: nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import random

import pytest

from plumbline.llm.components import components
from plumbline.llm.decontaminate import contamination
from plumbline.llm.licenses import license_scan
from plumbline.llm.line_dedup import line_dedup
from plumbline.llm.near_dedup import near_duplicates
from plumbline.llm.packing import differencing, pack, windows_for
from plumbline.llm.quality_gam import AdditiveModel, quality_scores
from plumbline.llm.quality_rules import quality_rules
from plumbline.llm.repeats import remove_repeats
from plumbline.llm.scratch import Scratch
from plumbline.llm.secrets import Automaton, FormatModel, scan_secrets
from plumbline.llm.toxicity import toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, pos int, label int, word int"


def docs(spark, rows):
    """Documents with extra columns whose names operators use inside."""
    return spark.createDataFrame([(k, t, "en", "s", 0, "x", 1, 2, 3) for k, t in rows], SCHEMA)


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(n))


EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, words(5, 30_000)), (6, "ä" * 200), (7, words(7, 80)), (7, words(7, 80)), (None, words(8, 80)), (9, words(7, 80))]


def by_id(df, *columns):
    out = {}
    for r in df.collect():
        out.setdefault(r[0], []).append(tuple(r[c] for c in columns))
    return out


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int, text string")


def every_operator(spark, d):
    import public_tokenizers

    bench = spark.createDataFrame([(1, words(5, 40)), (2, None), (3, "")], "item_id long, text string")
    return {
        "lines": line_dedup(d), "near": near_duplicates(d), "contamination": contamination(d, bench), "rules": quality_rules(d), "repeats": remove_repeats(d), "secrets": scan_secrets(d),
        "gam": quality_scores(d, labels(spark)), "toxicity": toxicity(d, labels(spark)), "licenses": license_scan(d), "pack": pack(d, public_tokenizers.path("word_bpe_49k.json")),
    }


def test_edge_rows_and_empty_tables(spark):
    counts = {k: df.count() for k, df in every_operator(spark, docs(spark, EDGE)).items()}
    assert counts.pop("licenses") == 0
    assert counts.pop("pack") >= len(EDGE)
    assert set(counts.values()) == {len(EDGE)}
    empty = docs(spark, EDGE).limit(0)
    assert {k: df.count() for k, df in every_operator(spark, empty).items()} == dict.fromkeys([*counts, "licenses", "pack"], 0)


def test_line_dedup(spark):
    got = by_id(line_dedup(docs(spark, [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\nd\ny"), (3, "a\nb"), (4, None), (5, ""), (6, "q\nq\nq\nq"), (None, "a\nb\nc")])), "text", "n_lines", "n_removed")
    assert got[1] == [("a\nb\nc\nd", 4, 0)]
    assert got[2] == [("x\ny", 6, 4)]
    assert got[3] == [("a\nb", 2, 0)] and got[4] == [(None, 0, 0)] and got[5] == [("", 1, 0)]
    assert got[6] == [("q", 4, 3)] and got[None] == [("a\nb\nc", 3, 0)]
    carried = line_dedup(docs(spark, [(1, "a")]), carry=["lang", "pos"]).first()
    assert carried["lang"] == "en" and carried["pos"] == 1


def test_near_duplicates_by_brute_force(spark):
    r = random.Random(3)
    base = words(1, 120).split()
    rows = [(i, " ".join(w if r.random() > 0.04 * (i % 4) else f"z{r.random()}" for w in base)) for i in range(60)]
    rows += [(100 + i, words(100 + i, 60)) for i in range(10)] + [(200, " ".join(base)), (201, ""), (202, "lone"), (203, "LONE")]
    got = by_id(near_duplicates(docs(spark, rows), shingle=2, block=16), "component_id", "kept")

    def shingles(t):
        w = t.lower().split()
        return set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set()

    sets = {k: shingles(t) for k, t in rows}
    label = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and label[a] < label[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[b], changed = label[a], True
    assert {k: v[0][0] for k, v in got.items()} == label
    assert all(v[0][1] == (k == label[k]) for k, v in got.items())


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)]
    got = dict(components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test")).collect())
    assert all(v == (1 if k < 100 else 100) for k, v in got.items()) and len(got) == 100


def test_contamination_of_short_and_long_items(spark):
    item = words(50, 25)
    rows = [(1, "x y " + item.upper() + " z"), (2, " ".join(item.split()[:9])), (3, "say Hello, big world now"), (4, words(51, 60)), (5, " ".join(item.split()[3:13]))]
    bench = spark.createDataFrame([(10, item, "e"), (11, "hello big world", "e"), (12, None, "e")], "item_id long, text string, doc_id string")
    got = {r["doc_id"]: r for r in contamination(docs(spark, rows), bench).collect()}
    assert [(s["start"], s["end"]) for s in got[1]["spans"]] == [(2, 27)] and got[1]["items"] == [10]
    assert got[2]["spans"] == [] and got[4]["spans"] == []
    assert [(s["start"], s["end"]) for s in got[3]["spans"]] == [(1, 4)] and got[3]["items"] == [11]
    assert [(s["start"], s["end"]) for s in got[5]["spans"]] == [(0, 10)]


@pytest.mark.parametrize("slice_bytes", [300, 1 << 20])
def test_repeats_by_brute_force(spark, slice_bytes):
    r = random.Random(9)
    passages = [words(i, 30) for i in range(4)]
    rows = [(i, f"{words(1000 + i, 8)} {r.choice(passages)[r.randint(0, 40):]} ünï {words(2000 + i, 3)} {r.choice(passages)}") for i in range(40)]
    rows += [(50, None), (51, "ab" * 120), (52, "ab" * 120)]
    got = {r["doc_id"]: r for r in remove_repeats(docs(spark, rows), slice_bytes=slice_bytes).collect()}
    first = {}
    for k, text in sorted(rows):
        raw = (text or "").encode()
        covered = [False] * len(raw)
        for i in range(len(raw) - 49):
            if first.setdefault(raw[i : i + 50], k) < k:
                covered[i : i + 50] = [True] * 50
        assert bytes(got[k]["kept"]) == bytes(b for b, c in zip(raw, covered) if not c)
        assert sum(s["end"] - s["start"] for s in got[k]["spans"]) == sum(covered)


def test_differencing_is_near_equal_and_complete():
    r = random.Random(1)
    sizes = [r.randint(1, 4000) for _ in range(300)]
    parts = differencing(sizes, 200)
    assert sorted(i for p in parts for i in p) == list(range(300))
    windows = windows_for(sizes, 4096)
    assert sorted(i for p in windows for i in p) == list(range(300)) and max(sum(sizes[i] for i in p) for p in windows) <= 4096
    assert windows_for([4096], 4096) == [[0]] and differencing([], 2) == [[], []]


def test_quality_rules_reject_another_kind_of_text(spark):
    r = random.Random(2)
    good = [(i, ". ".join(words(i, 12).capitalize() for i in range(i * 10, i * 10 + r.randint(6, 20)))) for i in range(300)]
    bad = [(1000 + i, " ".join(w.upper() + "!!###" for w in words(5000 + i, 100).split())) for i in range(20)]
    got = by_id(quality_rules(docs(spark, good + bad)), "base_failed", "kept")
    assert sum(v[0][1] for k, v in got.items() if k < 1000) >= 298
    assert not any(v[0][1] for k, v in got.items() if k >= 1000)


def test_quality_rules_reject_by_one_statistic_of_repetition(spark):
    good = [(i, "\n".join(words(i * 100 + k, 8) for k in range(10 + i % 30))) for i in range(300)]
    menu = [(1000 + i, "\n".join(x for k in range(30) for x in (words(90_000 + i * 100 + k, 8), "next page"))) for i in range(5)]
    said = [(2000 + i, "\n".join([f"{words(i, 45)} {words(95_000 + i, 60)} {words(i, 45)}", *(words(97_000 + i * 100 + k, 8) for k in range(5))])) for i in range(5)]
    # one line of four comes twice: too few lines to tell
    short = [(3000 + i, "\n".join([*(words(99_000 + i * 10 + k, 25) for k in range(3)), "next page", "next page"])) for i in range(5)]
    rows = {r["doc_id"]: r for r in quality_rules(docs(spark, good + menu + said + short)).collect()}
    assert sum(r["kept"] for k, r in rows.items() if k < 1000) == 300
    for k, r in rows.items():
        if k >= 1000:
            assert not r["base_failed"] and r["kept"] == (k >= 3000)
        if 1000 <= k < 2000:
            assert r["n_dup_lines"] == 29 and r["n_repeat_words"] == 0
        if 2000 <= k < 3000:
            assert r["n_dup_lines"] == 0 and r["n_repeat_words"] > 0


def test_toxicity_learns_a_pair_of_neutral_terms(spark):
    r = random.Random(6)
    rows, marks = [], []
    for i in range(2400):
        # each term is in half of the toxic and half of the clean texts; both or none are toxic
        one, two = r.random() < 0.5, r.random() < 0.5
        body = [r.choice(words(1, 300).split()) if k < 2 else f"w{r.randint(0, 60)}" for k in range(12)] + ["mild"] * one + ["group"] * two
        r.shuffle(body)
        rows.append((i, " ".join(body)))
        marks.append((i, 0, int(one == two), ""))
    scored = toxicity(docs(spark, rows), labels(spark, marks)).collect()
    held = [(x["score"] >= 0.5) == marks[x["doc_id"]][2] for x in scored if x["held_out"]]
    assert sum(held) >= 0.9 * len(held) > 0
    assert {x["score"] for x in toxicity(docs(spark, rows[:20]), labels(spark)).collect()} == {0.5}


def test_automata_know_formats():
    r = random.Random(4)
    token = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    hexes = [token("0123456789abcdef", 40) for _ in range(300)]
    keys = ["AKIA" + token("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16) for _ in range(300)]
    ordinary = [f"{token('aeioubcdfg', 9)}-{token('aeioubcdfg', 7)}-{r.randint(1, 99)}" for _ in range(300)]
    model = FormatModel({"hex": hexes, "access": keys}, ordinary, 0.7)
    assert len(model.kinds["hex"].ends) < 200
    assert all(model.is_secret(token("0123456789abcdef", 40)) for _ in range(20))
    assert not any(model.is_secret(f"{token('aeioubcdfg', 9)}-{token('aeioubcdfg', 7)}-{r.randint(1, 99)}") for _ in range(20))
    assert Automaton().fit([]).log_likelihood("a1") < 0


def test_pairwise_tables_learn_an_interaction():
    import numpy as np

    r = np.random.RandomState(5)
    x = r.rand(2000, 3)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    score = AdditiveModel().fit(x, y).score(x)
    assert ((score > 0.5) == (y == 1)).mean() > 0.9


def test_pipeline_applies_every_decision(spark, tmp_path):
    import corpus_pipeline

    prose = lambda i: "\n".join(words(i * 100 + k, 14).capitalize() + "." for k in range(8))
    item = words(77, 30)
    rows = [(i, prose(i)) for i in range(150)]
    near = [f"{line[:-1].rsplit(' ', 1)[0]} changed{i}." if i in (2, 5) else line for i, line in enumerate(prose(4).split("\n"))]
    rows += [(200, prose(3)), (201, "\n".join(near)), (202, prose(202) + "\n" + item), (203, "too short"), (204, None)]
    docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == set(range(150))
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, at, str(tmp_path)).columns == at.columns, name
