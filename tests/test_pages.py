"""Pages of children where one key holds a third of all rows."""

import random

from pyspark.sql import functions as F

from plumbline.operators import relational as L


def test_hot_key_is_numbered_by_several_tasks(spark):
    r = random.Random(1)
    rows = [("hot" if i % 3 == 0 else f"k{i % 50}", r.randint(0, 10**6), i) for i in range(3000)] + [(None, 1, -1), (None, 2, -2)]
    child = spark.createDataFrame(rows, "k string, at int, v int").repartition(8)
    got = L.child_pages(child, ["k"], ["at", "v"], ["v"], "kids", page=100).collect()
    pages = {(x["k"], x["page"]): [c["v"] for c in x["kids"]] for x in got}
    want = {}
    for key in {k for k, _, _ in rows}:
        ordered = [v for _, v in sorted((at, v) for k, at, v in rows if k == key)]
        want |= {(key, i // 100): ordered[i : i + 100] for i in range(0, len(ordered), 100)}
    assert pages == want and len(got) == len(want)


def test_ranges_of_a_hot_key_lie_in_several_partitions(spark):
    child = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("k"), F.col("id").alias("at"))
    numbered = L._numbered_by_range(child, ["k"], [F.col("at")])
    parts = {x["_part"]: x["n"] for x in numbered.filter("k = 'hot'").groupBy("_part").agg(F.count("*").alias("n")).collect()}
    assert len(parts) > 1 and max(parts.values()) < 1000
    assert numbered.filter("k = 'hot'").selectExpr("min(_pos) = 1 AND max(_pos) = 1000 AND count(DISTINCT _pos) = 1000").first()[0]
    assert numbered.filter("k = 'hot' AND _pos <> at / 3 + 1").count() == 0
