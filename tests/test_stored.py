"""Snapshot tables, stored search index, and streaming state."""

import tempfile

import pytest
from harness import compare
from pyspark.sql import functions as F

from plumbline.catalog import load_all
from plumbline.operators.search_index import SearchIndex
from plumbline.sources.snapshots import ConcurrentWrite, Snapshots
from plumbline.streaming import ingest as S

QUERIES, ORACLES = load_all()


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


@pytest.mark.parametrize("name", ["sr05_filtered_search", "sr05_city_query", "sk01_rewrite_own_table", "ss01_compacted_ingest", "ss02_recent_activity"])
def test_stored_query_matches_sql(name, spark, con, sf):
    assert compare(QUERIES[name](spark, sf), con, ORACLES[name]) is None


def test_snapshots_survive_a_crash_and_tell_a_second_writer(spark):
    t = Snapshots(spark, folder())
    rows = lambda n: spark.range(n).select(F.col("id"))
    assert t.write(rows(3)) == 0
    t.stage(rows(9))  # a writer died before it committed
    open(f"{t.root}/versions/{1:012d}", "w").close()  # another while it wrote the manifest
    assert t.current()[0] == 0 and t.read().count() == 3
    base, manifest = t.current()
    assert t.commit(manifest["tables"] | {"data": [t.stage(rows(4))]}, base) == 2
    with pytest.raises(ConcurrentWrite):
        t.commit(manifest["tables"] | {"data": [t.stage(rows(5))]}, base)
    assert t.write(t.read().union(rows(1))) == 3 and t.read().count() == 5
    assert t.read(number=2).count() == 4  # the version before stays readable until it expires
    t.write(rows(1))
    assert [n for n in t.numbers() if n > 1] == [3, 4]


def test_index_by_deltas_equals_one_build_and_reads_its_buckets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("lang2", F.col("lang"))
    one, two = SearchIndex(spark, folder()), SearchIndex(spark, folder())
    one.add(docs, "doc_id", "source", "text", {"city": "lang2"})
    for part in docs.randomSplit([0.5, 0.3, 0.2], 7):
        two.add(part, "doc_id", "source", "text", {"city": "lang2"})
    q = "heron und erthan tion"
    hits = [sorted(map(tuple, i.search(q, 15, {"city": "DE"}).collect())) for i in (one, two)]
    assert hits[0] == hits[1] and hits[0]
    assert {r["city"] for r in two.search(q, 15, {"city": "DE"}).collect()} == {"de"}
    plan = one.postings(["und", "tion"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert one.postings(["und", "tion"]).select(F.input_file_name()).distinct().count() <= 2 * one.spread


def test_compacted_ingest_is_bounded_and_replay_changes_nothing(spark):
    t = Snapshots(spark, folder())
    sink = S.compacting_sink(t, "id", "ts", compact_after=4)
    batch = lambda n: spark.createDataFrame([(i % 5, n * 10 + i, f"{n}") for i in range(7)], "id long, ts long, v string")
    for n in range(12):
        sink(batch(n), n)
        assert len(t.current()[1]["tables"]["data"]) <= 4 + 1
    before = sorted(map(tuple, S.newest_rows(t, "id").collect()))
    assert before == sorted([(0, 115, "11"), (1, 116, "11"), (2, 112, "11"), (3, 113, "11"), (4, 114, "11")])
    sink(batch(3), 11)  # a replay of the last batch
    assert sorted(map(tuple, S.newest_rows(t, "id").collect())) == before
    assert len(t.numbers()) <= 6


def test_recent_rows_of_a_stream_equal_those_of_all_rows(spark):
    t = Snapshots(spark, folder())
    sink = S.recent_sink(t, "id", [F.desc("at"), F.asc("id")], k=5)
    rows = [(i, (i * 37) % 101) for i in range(60)] + [(100, 100), (101, 1)]  # late rows come in every batch
    for n in range(6):
        sink(spark.createDataFrame(rows[n * 11 : n * 11 + 11] or rows[:1], "id long, at long"), n)
    sink(spark.createDataFrame([(999, 999)], "id long, at long"), 5)
    assert sorted(map(tuple, t.read("recent").collect())) == sorted(sorted(rows, key=lambda r: (-r[1], r[0]))[:5])
