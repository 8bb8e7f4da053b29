"""Rows that share an id and differ in text, items without id, and token ids of unusual letters."""

import random

import corpus_pipeline
from plumbline.llm.decontaminate import contamination
from plumbline.llm.line_dedup import line_dedup
from plumbline.llm.packing import WordTokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], SCHEMA)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(n))


def test_line_dedup_keeps_lines_that_occur_once(spark):
    rows = [(1, "a\nb\nc"), (5, "a\nb\nc\nd"), (5, "x\ny\nz\nw"), (5, "x\ny\nz\nw"), (6, "x\ny\nz\nv"), (7, None), (7, "")]
    got = sorted(((r["doc_id"], r["text"]) for r in line_dedup(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(1, "a\nb\nc"), (5, "d"), (5, "x\ny\nz\nw"), (5, "x\ny\nz\nw"), (6, "v"), (7, None), (7, "")], key=str)


def brute_lines(rows):
    """Kept lines of each (id, text hash) document, in the order that ``line_dedup`` states, by a dictionary of windows."""
    seen, out = set(), []
    for k, text in rows:
        lines = text.split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if w in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(w)
        out.append((k, "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return out


def test_line_dedup_by_brute_force_with_shared_ids(spark):
    r = random.Random(8)
    rows = [(i // 2, "\n".join(r.choice("abcdefg") for _ in range(r.randint(1, 9)))) for i in range(80)]
    df = docs(spark, rows).selectExpr("doc_id", "text", "xxhash64(text) own").distinct()
    ordered = [(x["doc_id"], x["text"]) for x in df.orderBy("doc_id", "own").collect()]
    want = dict(zip(ordered, (t for _, t in brute_lines(ordered))))
    got = line_dedup(docs(spark, rows).withColumnRenamed("n_chars", "own"), carry=["own"]).collect()
    assert sorted((x["doc_id"], x["text"]) for x in got) == sorted((k, want[k, t]) for k, t in rows)


def test_pipeline_stages_judge_rows_not_ids(spark, sf):
    long = [prose(i, 80) for i in range(4)]
    table = docs(spark, [(1, long[0]), (1, "too short"), (2, long[1]), (2, long[2]), (3, long[2] + " more"), (None, long[3]), (None, "short"), (4, None), (5, "")])
    first = corpus_pipeline.quality(spark, table, sf).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in first) == sorted([(1, long[0]), (2, long[1]), (2, long[2]), (3, long[2] + " more"), (0, long[3])])
    second = corpus_pipeline.near(spark, spark.createDataFrame(first, SCHEMA), sf).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in second) == sorted([(1, long[0]), (2, long[1]), (2, long[2]), (0, long[3])])


def test_pipeline_stages_of_empty_tables(spark, sf):
    empty = docs(spark, [(1, "x")]).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, sf)
        assert out.count() == 0 and (name == "packing" or out.columns == empty.columns)


def test_items_without_id_still_contaminate(spark):
    item, other = prose(50, 25), prose(51, 25)
    bench = spark.createDataFrame([(None, item), (7, other), (None, None)], "item_id long, text string")
    got = {r["doc_id"]: r for r in contamination(docs(spark, [(1, "x " + item), (2, other), (3, prose(52, 30)), (4, item + " " + other)]), bench).collect()}
    assert [(s["start"], s["end"]) for s in got[1]["spans"]] == [(1, 26)] and got[1]["items"] == []
    assert got[2]["items"] == [7] and got[3]["spans"] == [] and got[4]["items"] == [7] and got[4]["spans"][0]["end"] == 50


def test_token_ids_of_fuzzed_texts():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    tokens, r = WordTokens(path), random.Random(6)
    letters = list("abzABZ019.,;:!?*#$%&'-_()<|>/ \t\n") + list("\u0130\u0131\u00e9\u00c9\u00df\u01c5\u0301\u0307\u0345\u03a3\u03c2\u4e2d\u00aa\u2160\u1e9e\ufb01\u212b\u00a0\u0e33")
    texts = ["".join(r.choice(letters) for _ in range(r.randint(1, 12))) for _ in range(20_000)] + ["\u0130.", "A\u0130!x", "I\u0307.", "\u01c5;"]
    import numpy as np

    got = [np.frombuffer(x, "<u4").tolist() for x in tokens.encode(texts)]
    wrong = [(t, g) for t, g in zip(texts, got) if g != tokens.tokenizer.encode(t, add_special_tokens=False).ids]
    assert wrong == []
