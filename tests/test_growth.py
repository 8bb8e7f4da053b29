"""Steps whose work must not grow with the square of their rows."""

import itertools
import random

from pyspark.sql import functions as F
from test_units import levenshtein

from plumbline.operators import graph as G
from plumbline.operators import resolve as R
from plumbline.plans import companies as CO
from plumbline.sources import normalize as N


def names(spark, values):
    return spark.createDataFrame([(v,) for v in values], "norm string")


def test_names_with_the_same_words_do_not_all_meet(spark):
    r = random.Random(3)
    known = sorted({f"{w} fence {''.join(r.choice('abcdefghij') for _ in range(6))}" for w in ("summit", "granite") for _ in range(400)})
    df = names(spark, known)
    all_pairs = df.select(F.col("norm").alias("probe")).crossJoin(df.select(F.col("norm").alias("known")))
    assert R.near_pairs(df, df).count() == all_pairs.filter(F.levenshtein("probe", "known") <= 2).count()
    assert R.candidate_pairs(df, df).distinct().count() < 20_000  # all pairs of the same words: about 320,000


def test_near_pairs_of_each_budget(spark):
    r = random.Random(4)
    some = ["pacific engineering", "delta co", "sierra builders of the far north", "iron"]

    def edited(n):
        for _ in range(r.randint(0, 5)):
            i = r.randint(0, len(n))
            n = r.choice([n[:i] + r.choice("abé ") + n[i:], n[:i] + n[i + 1:], n[:i] + "z" + n[i + 1:]])
        return n

    all_names = sorted({edited(f"{n} {r.choice('abc') * r.randint(0, 7)}") for n in some for _ in range(25)} - {""})
    got = {tuple(x) for x in R.near_pairs(names(spark, all_names), names(spark, all_names)).select("probe", "known", "distance").collect()}
    dist = {(a, b): levenshtein(a, b) for a, b in itertools.product(all_names, all_names)}
    assert got == {(a, b, d) for (a, b), d in dist.items() if d <= max(2, len(a) * 12 // 100)}
    assert {max(2, len(a) * 12 // 100) for a in all_names} >= {2, 3, 4}


def test_graph_spells_shared_names_once(spark):
    """Companies and trades become ids by distinct name, and an id is the slug of the written name."""
    rows = lambda v, c: spark.createDataFrame(v, c)
    projects = rows([("A 1", "n", "Folsom", "Placer", "1 Elm", 1)], "id string, name string, city string, county string, address string, seq long")
    firms = ["acme, inc", "ACME INC.", " Acme Inc ", "o'neil-smith llc"]
    companies = rows([("A 1", f, "developer", i) for i, f in enumerate(firms)], "project_id string, name string, role string, seq long")
    permits = rows([("A 1", "p", "p", 1)], "project_id string, id string, number string, seq long")
    signals = rows([("A 1", "s", "k", "County", 1)], "project_id string, id string, kind string, source string, seq long")
    trades = rows([("A 1", "Roofing", i) for i in range(3)], "project_id string, trade string, seq long")
    nodes, edges = G.property_graph(projects, companies, permits, signals, trades)
    assert {(r.id, r.label) for r in nodes.collect() if r.type == "Developer"} == {("Developer:acme-inc", "Acme Inc."), ("Developer:o-neil-smith-llc", "O'Neil-Smith LLC")}
    assert {r.src for r in edges.collect() if r.type == "OWNS"} == {"Developer:acme-inc", "Developer:o-neil-smith-llc"}
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert "\\bInc" not in plan  # titles are for labels only


def test_graph_is_built_once_for_an_export(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(v):
        seen.add(1)
        return v

    nodes = spark.createDataFrame([("Company:a", "Company", "a")], "id string, type string, label string")
    edges = spark.createDataFrame([("Company:a", "INVOLVED_IN", f"Project:{i}") for i in range(3)], "src string, type string, dst string").withColumn("src", counted("src"))
    G.write_graph(nodes, edges, str(tmp_path))
    assert seen.value == 3
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/insights").select("id", "n").collect()] == [("Company:a", 3)]


def test_project_detail_names_a_company_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(v):
        seen.add(1)
        return v

    projects = spark.createDataFrame([("p", "n")], "id string, name string")
    permits = spark.createDataFrame([("p", "2001-01-01", "1")], "project_id string, permit_date string, permit_number string")
    signals = spark.createDataFrame([("p", "s", "k", 1)], "project_id string, id string, signal_type string, importance_score int")
    names = ["Acme", "TBD", "", None, "Delta", "Contact 12", "none such", "x@example.org"]
    companies = spark.createDataFrame([("p", n, "r") for n in names], "project_id string, name string, role string").withColumn("name", counted("name"))
    got = N.project_detail(projects, permits, signals, companies).select("companies.name", "companies_count").collect()
    assert [tuple(r) for r in got] == [(["Acme", "Delta"], 2)]
    assert seen.value == len(names)


def test_company_discovery_reads_a_name_twice_at_most(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(v):
        seen.add(1)
        return v

    rows = [("Acme Inc", "b", 3), ("ACME", "a", 2), ("Unknown", "a", 1), ("Acme Inc", "a", 5), (None, "a", 6)] + [("Delta LLC", None, 10 + i) for i in range(30)]
    m = spark.createDataFrame(rows, "name string, role string, seq int").withColumn("name", counted("name"))
    m = m.select("*", F.lit("s").alias("source_name"), F.lit("u").alias("source_url"), F.col("seq").cast("string").alias("project_name"))
    got = {r.normalized_name: r for r in CO.discover_companies(m).collect()}
    assert set(got) == {"acme", "delta"}
    assert (got["acme"].company_name, got["acme"].roles, got["acme"].project_count) == ("ACME", ["a", "b"], 3)
    assert [r.project_name for r in got["acme"].source_records] == ["2", "3", "5"]
    assert [r.project_name for r in got["delta"].source_records] == [str(10 + i) for i in range(25)] and got["delta"].project_count == 30
    assert seen.value <= 2 * len(rows)
