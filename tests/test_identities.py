"""Identity terms and property maps by brute force."""

import random

import pytest
from harness import compare
from pyspark.sql import functions as F

from plumbline.catalog import load_all
from plumbline.operators import evidence_match as E
from plumbline.operators import properties as P

QUERIES, ORACLES = load_all()


@pytest.mark.parametrize("name", ["jn10_identity_terms", "gr01_node_properties", "gr04_node_metadata"])
def test_query_matches_sql(name, spark, con, sf):
    assert compare(QUERIES[name](spark, sf), con, ORACLES[name]) is None


def test_identity_rows_exercise_every_kind(spark, sf):
    r = QUERIES["jn10_identity_terms"](spark, sf).agg(F.sum("documents"), F.sum("own_documents"), F.sum("strong_documents"), F.max("best")).first()
    assert r[0] > r[2] > 0 and r[1] > 0 and r[3] >= 104


def test_terms_in_texts_by_brute_force(spark):
    r = random.Random(5)
    piece = lambda: "".join(r.choice("ab1-/ .") for _ in range(r.randint(1, 9)))
    terms = list({piece() for _ in range(150)})
    texts = [(i, "".join(piece() for _ in range(r.randint(0, 12)))) for i in range(40)]
    got = {tuple(x) for x in E.terms_in_texts(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame(texts, "did int, text string")).collect()}
    assert got == {(t, i) for t in terms for i, text in texts if t in text and any(c.isalnum() for c in t)}


def test_graph_has_all_kinds(spark, sf):
    from plumbline.catalog.base import Tables
    from plumbline.catalog.identities import full_graph

    nodes, edges = full_graph(Tables(spark, sf))
    assert {x[0] for x in nodes.select("type").distinct().collect()} == {"Project", "City", "County", "Property", "Company", "Developer", "Contact", "Permit", "Document", "Parcel", "Agency", "Trade"}
    assert {x[0] for x in edges.select("type").distinct().collect()} == {"LOCATED_IN", "INVOLVED_IN", "DESIGNED", "OWNS", "WORKS_FOR", "EMPLOYS", "REFERENCES", "DISCOVERED_FROM", "REQUIRES"}


def test_later_nulls_replace_and_absent_keys_stay(spark):
    rows = spark.createDataFrame([("a", 1, {"x": "1", "y": "2"}), ("a", 2, {"x": None}), ("a", 3, {"z": "3"}), ("b", 1, {}), ("c", 1, None)], "id string, seq int, props map<string,string>")
    got = {r["id"]: r["props"] for r in P.merge_properties(rows, ["id"], "seq").collect()}
    assert got == {"a": {"x": None, "y": "2", "z": "3"}, "b": {}, "c": {}}
