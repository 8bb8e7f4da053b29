"""Cases of the findings of round 4."""

import random
import re

from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import extract as E
from plumbline.plans import vocab as V


def test_signals_read_a_text_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(v):
        seen.add(1)
        return v

    rows = [(1, "Install a new fence. Creek work."), (2, "Creek work."), (3, None), (4, "A gate. Roof repair.")]
    docs = spark.createDataFrame(rows, "seq int, text string").withColumn("text", counted("text"))
    got = E.signal_summary(E.document_signals(docs, "text", "seq"), "seq").collect()
    assert {tuple(r)[:4] for r in got} == {(1, 2, 0, 0), (2, 0, 0, 1), (4, 0, 1, 1)}
    assert seen.value == len(rows)


def test_cues_hide_no_match(spark):
    r = random.Random(6)
    words = ["install", "Building a", "fence", "FENCING", "gate", "gates)", "new", "new (", "   ", "\n", "detention basin", "ada ped", "supply and install", "installation of", "Construct", "pv", "reroof", ".",
             "İ", "K", "\U0001F600", "chain\tlink", "x" * 39, "y" * 60, "automatic slide", "school fencing", "sewer", "energy storage", "regate"]
    texts = [(i, r.choice(["", " "]).join(r.choice(words) for _ in range(r.randint(0, 14)))) for i in range(600)]
    texts += [(1000, "construct" + "z" * 40 + " fence"), (1001, "supply and install" + "z" * 60 + "gate"), (1002, "new" + " " * 200 + "(gates) "), (1003, "fencing" + "z" * 80 + "detention basin"), (1004, "İ" * 30 + " pool safety fencing")]
    d = spark.createDataFrame(texts, "seq int, text string")
    kept = E.document_signals(d, "text", "seq").groupBy("seq").agg(F.collect_set(F.struct("signal", "snippet")).alias("s"))
    got = {(x["seq"], s["signal"], s["snippet"]) for x in kept.collect() for s in x["s"]}
    at = lambda p: F.instr(F.col("text"), F.regexp_extract("text", f"(?i){p}", 0))
    all_of = d.select("seq", *[F.when(F.col("text").rlike(f"(?i){p}"), X.sentence_snippet("text", at(p))).alias(label) for _, label, p, _ in V.EVIDENCE_SIGNALS]).collect()
    strong = {x["seq"]: [label for g, label, p, c in V.EVIDENCE_SIGNALS if g == "strong" and c == "" and x[label] is not None] for x in all_of}
    want = {(x["seq"], label, x[label]) for x in all_of for label in strong[x["seq"]]}
    assert {g for g in got if g[1] in {label for g, label, _, c in V.EVIDENCE_SIGNALS if g == "strong" and c == ""}} == want and len(want) > 100
    # the checked ones: each kept one is a match, and each match that the check lets pass is kept
    from plumbline.plans import scope as S

    for label, ok in (("Fence installation reference", S.intentional_fence), ("Gate installation reference", S.intentional_gate)):
        pattern = next(p for _, n, p, _ in V.EVIDENCE_SIGNALS if n == label)
        hit = d.filter(F.col("text").rlike(f"(?i){pattern}")).withColumn("snippet", X.sentence_snippet("text", at(pattern))).filter(ok("snippet"))
        assert {(x[0], x[1]) for x in got if x[1] == label} == {(x["seq"], label) for x in hit.collect()}
        assert any(x[1] == label for x in got)


def test_every_signal_has_cues():
    assert set(V.EVIDENCE_CUES) == {label for _, label, _, _ in V.EVIDENCE_SIGNALS}
    for _, label, pattern, _ in V.EVIDENCE_SIGNALS:
        plain = [w for w, reach in V.EVIDENCE_CUES[label] if reach == 0]
        if re.fullmatch(r"[a-z |-]+", pattern):  # a list of words: each of them starts with a cue
            assert all(any(w.startswith(c) or c in w for c in plain) for w in pattern.split("|"))


def graph_tables(spark, contacts):
    t = lambda rows, c: spark.createDataFrame(rows, c)
    text = lambda names: ", ".join(f"{n} string" for n in names.split())
    projects = t([("A 1", 1, "one", "open", "x", "Folsom", "", "1 Elm", None, "2"), ("a-1", 2, "two", None, "x", "folsom", None, "1 ELM", "7", None), (None, 3, "lost", "s", "t", "Rocklin", None, "", None, None)],
                 "id string, seq long, " + text("name status project_type city county address latitude longitude"))
    companies = t([("A 1", 5, "Acme, Inc", "developer", "D", "b", "CA", None, "1", None), ("A 1", 5, "ACME inc.", "developer", "D", "a", "CA", "w", None, None), ("gone", 9, "Acme Inc", "developer", "Z", "z", "z", "z", "z", "z")],
                  "project_id string, seq long, " + text("name role company_type city state website phone email"))
    permits = t([("A 1", 1, "p", "n", "t", None, "d", "v")], "project_id string, seq long, " + text("id permit_number permit_type permit_status permit_date permit_value"))
    documents = t([("a-1", 1, "d", "title", "en", None, None)], "project_id string, seq long, " + text("id title document_type source_url created_at"))
    signals = t([("a-1", 1, "d", "kind", "day", "", "3", "PN 1", None)], "project_id string, seq long, " + text("id signal_type signal_date source importance_score parcel_number jurisdiction"))
    trades = t([("A 1", i, v) for i, v in enumerate(["Roofing", "roofing", "", None])], "project_id string, seq long, trade string")
    return projects, companies, contacts, permits, documents, signals, trades


def contact_rows(spark, rows):
    return spark.createDataFrame(rows, "project_id string, seq long, name string, role string, company string, confidence string, source string, website string, phone string, email string")


def test_graph_of_projects_that_share_a_node(spark):
    from plumbline.operators import properties as P

    contacts = contact_rows(spark, [("A 1", 1, "Jo", "r1", "ACME INC", "0.5", "s", None, "2", "e"), ("a-1", 1, "jo", None, "acme inc", None, None, "v", None, None), ("a-1", 2, "", "r3", "Delta", "0.1", "s", "w", "3", "f")])
    nodes, edges = P.property_graph_full(*graph_tables(spark, contacts))
    n = {(r["id"], r["type"]): (r["label"], r["props"]) for r in nodes.collect()}
    assert n[("Project:a-1", "Project")] == ("two", {"status": None, "project_type": "x", "city": "folsom", "county": None})
    assert n[("Property:1-elm", "Property")] == ("1 ELM", {"address": "1 ELM", "latitude": "7", "longitude": None})
    assert n[("Developer:acme-inc", "Developer")] == ("Acme, Inc.", {"company_type": "D", "city": "b", "state": "CA", "website": "w", "phone": "1", "email": None})  # two writes at one place
    assert n[("Company:acme-inc", "Company")] == ("Acme Inc.", {"website": "v", "phone": None, "email": None})
    assert n[("Contact:jo", "Contact")] == ("jo", {"role": None, "confidence": None, "source": None})
    assert n[("Document:d", "Document")] == ("kind", {"document_type": "en", "source_url": None, "created_at": None, "signal_type": "kind", "signal_date": "day", "source": "", "importance_score": "3"})
    assert n[("City:folsom", "City")] == ("folsom", {}) and n[(None, "Project")][0] == "lost"
    assert len(n) == 13
    rows = [(r["src"], r["type"], r["dst"], r["props"]) for r in edges.collect()]
    e = {r[:3]: r[3] for r in rows}
    assert len(e) == len(rows) == 13
    assert e[("Company:acme-inc", "INVOLVED_IN", "Project:a-1")] == {"role": None, "contact_confidence": None}
    assert e[("Developer:acme-inc", "INVOLVED_IN", "Project:a-1")] == {"role": "developer"} and e[("Developer:acme-inc", "OWNS", "Project:a-1")] == {}
    assert e[("Contact:jo", "WORKS_FOR", "Company:acme-inc")] == e[("Company:acme-inc", "EMPLOYS", "Contact:jo")] == {"confidence": None}
    assert e[("Project:a-1", "REFERENCES", "Document:d")] == {"signal_type": "kind"} and (None, "LOCATED_IN", "City:rocklin") in e


def test_graph_reads_a_table_once_for_all_it_writes(spark):
    from plumbline.operators import properties as P

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(v):
        seen.add(1)
        return v

    rows = [("A 1", i, "Jo", "r", f"Firm {i}", "1", "s", "w", "p", "e") for i in range(9)]
    nodes, edges = P.property_graph_full(*graph_tables(spark, contact_rows(spark, rows).withColumn("company", counted("company"))))
    assert nodes.filter("type = 'Company'").count() == 9 and seen.value == 9  # before: once for companies, once for people
    seen.value = 0
    edges.collect()
    assert seen.value <= 2 * len(rows)  # people are merged apart


def test_deleted_strings_of_a_name_are_few_and_numbers(spark, monkeypatch):
    from plumbline.operators import resolve as R

    seen, deleted = [], R._deleted
    monkeypatch.setattr(R, "_deleted", lambda *a: seen.append(deleted(*a)) or seen[-1])
    known = spark.createDataFrame([("summit engineering abcd",)], "norm string")  # 23 characters, a budget of two
    probes = spark.createDataFrame([("summit engineering abcdefg"[: 23 + n],) for n in range(4)], "norm string")
    got = {(r["probe"], r["distance"]) for r in R.near_pairs(probes, known).collect()}
    assert got == {("summit engineering abcdefg"[: 23 + n], n) for n in range(4)}  # 26 characters: three
    assert all(t == "bigint" for d in seen for _, t in d.dtypes)
    assert min(d.count() for d in seen) == 1 + 23 + 23 * 22 // 2
