"""Similarity links where one block holds a third of all names."""

import random

from pyspark.sql import functions as F

from plumbline.operators import resolve as R


def test_grid_join_equals_a_join_and_spreads_a_hot_block(spark):
    left = spark.range(900).select(F.col("id").alias("a"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    right = spark.range(900).select(F.col("id").alias("b"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    got = R.grid_join(left, right, ["k"], cell=50).select("a", "b")
    want = left.join(right, "k").select("a", "b")
    assert got.count() == want.count() == 300 * 300 + 600 and got.exceptAll(want).count() == 0


def test_links_of_a_hot_token_by_brute_force(spark):
    r = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "creek", "oak", "hill", "park"]
    names = list({" ".join(["summit"] * (i % 3 == 0) + r.sample(words, r.randint(1, 4))) for i in range(160)})
    rows = [(f"e{i}", r.choice(["developer", "company", "city"]), n, r.choice([0.6, 0.8, 0.95])) for i, n in enumerate(names + names[:20])]
    e = spark.createDataFrame(rows, "eid string, type string, norm string, confidence double")
    fam = lambda t: "developer" if t == "company" else t
    pairs = [(min(x[0], y[0]), max(x[0], y[0]), x, y) for i, x in enumerate(rows) for y in rows[i + 1 :] if fam(x[1]) == fam(y[1])]
    table = spark.createDataFrame([(a, b, x[2], y[2], x[3], y[3], x[1] == y[1]) for a, b, x, y in pairs], "a string, b string, an string, bn string, ac double, bc double, same boolean")
    want = table.withColumn("weight", R.pair_weight("an", "bn", "ac", "bc", F.col("same"))).filter(F.col("weight") >= R.LINK_FLOOR).select("a", "b")
    got = R.link_entities(e).select("a", "b")
    assert got.count() == want.count() > 100 and got.exceptAll(want).count() == 0
