"""Cases of the findings of round 3."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from harness import compare, connect
from pyspark.sql import functions as F

from plumbline.catalog import load_all
from plumbline.operators import graph as G
from plumbline.operators import resolve as R

QUERIES, ORACLES = load_all()


@pytest.mark.parametrize("name", ["ex10_document_signals", "ag22_evidence_rollup"])
def test_snippets_count_whole_characters(name, spark, sf, tmp_path):
    # characters outside of the basic plane before the match, and a word that spells the matched text
    texts = ["\U0001F600" * 60 + " a. b. c. Install a new fence here. d", "Das ingates. Ein", None, ""]
    for f in os.listdir(sf):
        if f != "documents.parquet":
            os.symlink(f"{sf}/{f}", tmp_path / f)
    rows = [{"doc_id": i, "text": texts[i % 4], "lang": "en", "source": "s", "n_chars": 9} for i in range(48)]
    pq.write_table(pa.Table.from_pylist(rows), tmp_path / "documents.parquet")
    assert compare(QUERIES[name](spark, str(tmp_path)), connect(str(tmp_path)), ORACLES[name]) is None


def test_neighbours_of_a_node_are_one_row_over_all_pages(spark):
    edges = spark.range(25).select(F.concat(F.lit("s:"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("src"), F.lit("f").alias("dst"))
    rows = G.neighbor_text(edges, page=4).filter("dir = 'in'").collect()
    assert [(r["degree"], r["neighbors"]) for r in rows] == [(25, "|".join(f"s:{i:02d}" for i in range(25)))]


def test_short_names_inside_of_short_names_are_linked(spark):
    rows = [(str(i), "parcel", n, 0.9) for i, n in enumerate(["a", "ab", "abc", "xabcx", "longer name abc", "zz"])]
    links = R.link_entities(spark.createDataFrame(rows, "eid string, type string, norm string, confidence double")).collect()
    assert {(r["a"], r["b"]) for r in links} >= {("0", "1"), ("0", "2"), ("1", "2"), ("2", "3"), ("2", "4"), ("0", "4")}
    assert not any("5" in (r["a"], r["b"]) for r in links)


@pytest.mark.parametrize("name", ["er06_hypothesis_values", "er06_hypothesis_why"])
def test_records_are_linked_once(name, spark, sf, monkeypatch):
    calls, cluster = [], R.cluster_records
    monkeypatch.setattr(R, "cluster_records", lambda *a: calls.append(1) or cluster(*a))
    QUERIES[name](spark, sf)
    assert len(calls) == 1


def test_merged_elements_read_their_writes_once(spark):
    from plumbline.operators import properties as P

    rows = spark.createDataFrame([("a", "x", "one", 1, {"k": "1", "l": "1"}), ("a", "x", "two", 2, {"k": None}), ("b", "x", None, 3, {})],
                                 "id string, type string, label string, at int, props map<string,string>")
    merged = P._merged(rows, ["id", "type"])
    assert "Join" not in merged._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["id"], r["label"], tuple(sorted(r["props"].items()))) for r in merged.collect()} == {("a", "two", (("k", None), ("l", "1"))), ("b", None, ())}
    edges = P._merged(rows.drop("label"), ["id", "type"])
    assert {(r["id"], len(r["props"])) for r in edges.collect()} == {("a", 2), ("b", 0)}


def test_combined_search_ranks_its_corpus_once(spark, sf):
    from plumbline.operators import search as S

    seen, search = [], S.semantic_search
    try:
        S.semantic_search = lambda docs, *a: seen.append(docs) or search(docs, *a)
        QUERIES["sr11_combined_search"](spark, sf)
    finally:
        S.semantic_search = search
    assert "ExistingRDD" in seen[0]._jdf.queryExecution().executedPlan().toString() and "FileScan" not in seen[0]._jdf.queryExecution().executedPlan().toString()
