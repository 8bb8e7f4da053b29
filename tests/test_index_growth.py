"""What search and its stored index shuffle must follow their postings, each once (F24, F25, F26, F29)."""

import math
import random
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.operators import search as SE
from plumbline.operators.search_index import SearchIndex

WORDS = [f"w{i}" for i in range(100)]


def corpus(spark, n=400, size=60):
    r = random.Random(5)
    rows = [(i, "t", " ".join(r.choice(WORDS) for _ in range(size)) + f" only{i}") for i in range(n)]
    return spark.createDataFrame(rows, "id long, title string, text string").repartition(2, "id"), rows


def shuffled_records(spark, job):
    """Records that the stages of a job write to shuffles."""
    sc = spark.sparkContext

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._gateway.jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    job()
    return sum(n for stage, n in stages().items() if stage not in before)


def postings_of(rows):
    return sum(len(set(f"{title} {text}".split()) - {"t"}) for _, title, text in rows)


def test_an_index_shuffles_its_postings_once(spark):
    docs, rows = corpus(spark)
    index = SearchIndex(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    written = shuffled_records(spark, lambda: index.add(docs, "id", "title", "text"))
    assert postings_of(rows) == index.tables.read("postings").count()
    assert written < 1.5 * postings_of(rows)  # each posting to its bucket, then frequencies, norms and ids


def test_norms_are_those_of_the_postings(spark):
    docs, rows = corpus(spark, 60)
    index = SearchIndex(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp"), spread=3, per_file=500)
    for part in (docs.filter("id < 20"), docs.filter("id >= 20")):
        index.add(part, "id", "title", "text")
    tokens = [*WORDS, *(f"only{i}" for i in range(60))]
    sums = index.postings(tokens).groupBy("doc").agg(F.count(F.lit(1)), F.max("weight"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))))
    both = [sorted(map(tuple, x.collect())) for x in (sums, index.norms().select("doc", "terms", "top", "magnitude"))]
    assert len(both[0]) == len(both[1]) == 60
    for a, b in zip(*both):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-12)
    assert index.tables.read("postings").select(F.input_file_name()).distinct().count() > 3  # dealt by their number


@pytest.mark.parametrize("head", [0, 40, 150, 10_000])
def test_idf_of_frequent_and_rare_tokens(spark, head):
    docs, rows = corpus(spark, 80, 20)
    counts = SE.token_counts(docs, "id", F.concat_ws(" ", "title", "text")).cache()
    df = SE.token_frequencies(counts).cache()
    got = {(r.doc, r.token): (r.len, r.n, r.idf) for r in SE.with_idf(counts, df, len(rows), head).collect()}
    texts = {i: [w for w in f"{title} {text}".split() if len(w) > 1] for i, title, text in rows}
    seen = Counter(w for t in texts.values() for w in set(t))
    assert got.keys() == {(i, w) for i, t in texts.items() for w in t}
    for (i, w), (size, n, idf) in got.items():
        assert (size, n) == (len(texts[i]), texts[i].count(w)) and idf == pytest.approx(math.log((len(rows) + 1) / (seen[w] + 1)) + 1)


def test_counts_of_odd_rows(spark):
    rows = [(1, "bb aa bb"), (1, "aa bb bb"), (1, "aa"), (2, ""), (3, None), (4, "x ! y"), (None, "cc cc")]
    docs = spark.createDataFrame(rows, "id long, text string")
    got = sorted((tuple(r) for r in SE.token_counts(docs, "id", "text").collect()), key=str)
    assert got == sorted([(1, 3, "aa", 2), (1, 3, "bb", 4), (1, 1, "aa", 1), (None, 2, "cc", 2)], key=str)  # as grouped by id, length and token
    alone = SE.token_counts(docs.filter("id > 1 OR id IS NULL"), "id", "text")
    assert [tuple(r) for r in alone.collect()] == [(None, 2, "cc", 2)]
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()


def joined_columns(df):
    """Columns of the left side of the first left outer join below."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop(0)
        if node.nodeName() == "Join" and node.joinType().toString() == "LeftOuter":
            return node.children().apply(0).output().mkString(" ")
        todo += [node.children().apply(i) for i in range(node.children().size())]


def test_stored_search_moves_a_text_only_for_its_snippet(spark):
    docs, _ = corpus(spark, 60)
    index = SearchIndex(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    index.add(docs, "id", "title", "text")
    hits = index.search("w10 w20", 5)
    assert "text#" in joined_columns(hits) and hits.first()["snippet"]
    assert "text#" not in joined_columns(hits.select("doc", "score", "lexical_score", "metadata_score"))


def test_search_shuffles_no_postings_of_frequent_tokens(spark):
    docs, rows = corpus(spark)
    hits = []
    written = shuffled_records(spark, lambda: hits.extend(SE.semantic_search(docs, "id", "title", "text", "w10 w20", 5).select("doc", "score").collect()))
    assert len(hits) == 5 and written < 0.5 * postings_of(rows)
    assert "text#" not in joined_columns(SE.semantic_search(docs, "id", "title", "text", "w10 w20", 5).select("doc", "score"))
