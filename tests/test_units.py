"""Literal cases of single rules, and properties of the keyed operators."""

import itertools

import pytest
from pyspark.sql import functions as F

from plumbline.functions import contacts as C
from plumbline.functions import text as X
from plumbline.operators import keyed as K
from plumbline.operators import resolve as R
from plumbline.plans import access as A
from plumbline.plans import permits as P
from plumbline.plans import scope as S


def one(spark, expr, **values):
    cols = [F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("_")]
    return spark.range(1).select(*cols).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("raw,want", [("$1,234.50", 1234.5), ("", None), ("abc", None)])
def test_parse_money(spark, raw, want):
    assert one(spark, X.parse_money("v"), v=raw) == want


@pytest.mark.parametrize("raw,want", [("1-916-000-1234", "(916) 000-1234"), ("9160001234", "(916) 000-1234"), ("12", "12"), ("", None)])
def test_format_phone(spark, raw, want):
    assert one(spark, C.format_phone("v"), v=raw) == want


@pytest.mark.parametrize("v,want", [(24999, "Under $25k"), (25000, "$25k-$75k"), (1000000, "$1M+"), (0, "Not estimated")])
def test_value_band(spark, v, want):
    assert one(spark, X.value_band("v"), v=v) == want


@pytest.mark.parametrize("v,want", [("To Be Determined", True), ("owner-builder", True), ("Delta Fence Co", False)])
def test_placeholder(spark, v, want):
    assert one(spark, C.is_placeholder("v"), v=v) is want


def test_names_and_hash(spark):
    assert one(spark, X.normalize_name_v1("v"), v="Acme Co. LLC, The Inc") == "acme"
    assert one(spark, X.title_case("v"), v="o'neil FOO-bar llc, inc") == "O'Neil Foo-Bar LLC, Inc."
    assert one(spark, X.hash31("v"), v="atom:x|atom:y") == "342c49d"


def test_street_names_are_not_fences(spark):
    assert one(spark, P.permit_trades(F.lower("v")), v="Southgate Dr reroof") == ["Roofing"]
    assert one(spark, S.intentional_gate("v"), v="permit at 100 GOLDEN GATE AVE") is False


def test_final_date_wins(spark):
    status = P.permit_status_a("s", F.lit(None).cast("date"), F.lit("2026-01-01").cast("date"))
    assert one(spark, status, s="Issued") == "Completed"


def test_stage_modes(spark):
    assert one(spark, P.planning_stage("v"), v="their homes") == "ceqa"
    assert one(spark, P.planning_stage("v", whole_words=True), v="their homes") == "unknown"


def test_gate_job_is_primary(spark):
    text = "NEW (GATES). Supply and install automated slide gates, ADA ped gate and fencing with gate operators"
    df = spark.createDataFrame([(1, text, "NEW (GATES)", "")], "seq INT, text STRING, name STRING, tags STRING")
    row = S.scope_rows(df, "text", "name", "tags").first()
    assert (row.fence_scope_confidence, row.fence_score, row.bidable) == ("Primary Opportunity", 100, True)


def test_scores(spark):
    t, f = F.lit(True), F.lit(False)
    assert one(spark, A.qualification_score(t, t, f, t, f, f, F.lit("Active"), F.lit("High"), F.lit("High"))) == 74
    assert one(spark, P.signal_importance_a(F.lit("Permit"), F.lit(600000.0), F.lit(""))) == 100
    w = one(spark, P.revenue_window(F.lit(1000000.0), F.lit("Fencing")))
    assert (w.low, w.high) == (15000, 45000)
    assert abs(one(spark, R.pair_weight(F.lit("a b"), F.lit("a b"), F.lit(0.9), F.lit(0.86), t)) - 0.9732) < 1e-9


def test_first_per_key_ignores_partitioning(spark):
    rows = [(k, s, f"{k}{s}") for k in "abc" for s in range(20)]
    for n in (1, 7):
        df = spark.createDataFrame(rows[::-1], "k STRING, s INT, v STRING").repartition(n)
        assert sorted(r.v for r in K.first_per_key(df, ["k"], ["s"]).collect()) == ["a0", "b0", "c0"]


def test_selection_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    plan = K.top_n_per_group(df, ["k"], ["id"], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_upsert_twice_equals_once(spark):
    base = spark.createDataFrame([("a", "1", None), ("b", None, "x")], "k STRING, p STRING, e STRING")
    delta = spark.createDataFrame([("b", "2", None), ("c", "3", "y")], "k STRING, p STRING, e STRING")
    once = K.upsert(base, delta, ["k"])
    twice = K.upsert(once, delta, ["k"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("a", "1", None), ("b", "2", "x"), ("c", "3", "y")]


def levenshtein(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


@pytest.mark.parametrize("block", [2_000_000, 0])
def test_near_pairs_lose_nothing(spark, block):
    """Both block levels against brute force; 0 sends every key through the second level."""
    names = ["summit fence", "sumit fence", "summit fences co", "delta roof", "delta roofs", "dlta rof", "x", "xy", "granite valley builders of the north", "granit valley bilders of the north", "harbor"]
    df = spark.createDataFrame([(n,) for n in names], "norm STRING")
    got = {(r.probe, r.known, r.distance) for r in R.near_pairs(df, df, block).collect()}
    want = {(a, b, levenshtein(a, b)) for a, b in itertools.product(names, names) if levenshtein(a, b) <= max(2, len(a) * 12 // 100)}
    assert got == want


def test_components_hub_and_chain(spark):
    edges = [("h", f"n{i:03d}") for i in range(200)] + [("p", "q"), ("q", "r")]
    out = R.connected_components(spark.createDataFrame(edges, "src STRING, dst STRING")).collect()
    assert {r.component for r in out if r.node.startswith("n") or r.node == "h"} == {"h"}
    assert {r.component for r in out if r.node in "pqr"} == {"p"}


def test_weak_links_need_two(spark):
    """One weak link leaves records apart, two of them (best at .62 or more) join them."""
    rows = [
        (1, "developer", "alpha beta gamma", 0.9), (2, "developer", "alpha beta delta", 0.9),
        (3, "developer", "red green blue pink", 0.9), (3, "address", "one two three four", 0.9), (4, "developer", "red green blue gold", 0.9), (4, "address", "one two three five", 0.9),
    ]
    rec = spark.createDataFrame(rows, "key INT, type STRING, norm STRING, confidence DOUBLE")
    w = lambda a, b: one(spark, R.pair_weight(F.lit(a), F.lit(b), F.lit(0.9), F.lit(0.9), F.lit(True)))
    assert w("alpha beta gamma", "alpha beta delta") < 0.55
    cluster = {r.key: r.cluster for r in R.cluster_records(rec, rec.select("key").distinct()).collect()}
    assert cluster[1] != cluster[2]
    linked = 0.55 <= w("red green blue pink", "red green blue gold") < 0.78 and w("red green blue pink", "red green blue gold") >= 0.62
    assert (cluster[3] == cluster[4]) is linked


def test_children_are_paged_not_cut(spark):
    from plumbline.operators.relational import attach_children

    parent = spark.createDataFrame([(1,), (2,)], "id int")
    child = spark.createDataFrame([(1, i) for i in range(7)], "id int, n int")
    rows = sorted(attach_children(parent, child, ["id"], ["n"], ["n"], "kids", page=3).collect(), key=lambda r: (r["id"], r["page"]))
    assert [[k["n"] for k in r["kids"]] for r in rows if r["id"] == 1] == [[0, 1, 2], [3, 4, 5], [6]]
    assert [(r["page"], r["kids"], r["kids_count"]) for r in rows if r["id"] == 2] == [(0, None, 0)]


def test_trade_search_returns_only_rows_with_that_evidence(spark, sf):
    from pyspark.sql import functions as F

    from plumbline.catalog.base import Tables
    from plumbline.catalog.packages import SEARCH_TEXT, search_rows
    from plumbline.plans import packages as PK

    found = PK.contractor_search(search_rows(Tables(spark, sf)), "roofing", SEARCH_TEXT, "seq")
    bad = found.filter((F.col("search_trade") != "Roofing") | ~PK.has_trade_evidence("evidence_text", "trade", "Roofing"))
    assert found.count() > 0 and bad.count() == 0


def test_all_names_of_a_role(spark):
    from plumbline.operators.aggregate import names_of_role

    rows = [(1, "Developer", f"d{i}", i) for i in range(30)] + [(1, "Architect", "a", 40), (2, "Architect", "b", 1)]
    contacts = spark.createDataFrame(rows, "opportunity_id int, role string, company string, contact_seq int")
    got = {r[0]: r[1] for r in contacts.groupBy("opportunity_id").agg(names_of_role("role", "company", "contact_seq", "Developer")).collect()}
    assert got == {1: ", ".join(f"d{i}" for i in range(30)), 2: None}
