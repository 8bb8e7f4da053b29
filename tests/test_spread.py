"""Costly columns are computed by all cores and once a row."""

import re

from plumbline.catalog import packages, resolution
from plumbline.catalog.base import Tables
from plumbline.operators import resolve as R


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_entities_and_search_rows_are_dealt_out(spark, sf):
    for rows, key in ((resolution.atoms(Tables(spark, sf)), "c_custkey"), (packages.search_rows(Tables(spark, sf)), "o_orderkey")):
        assert re.search(rf"RepartitionByExpression \[{key}", optimized(rows))
    assert packages.search_rows(Tables(spark, sf)).rdd.getNumPartitions() > 1


def test_components_in_the_order_of_node_names(spark):
    edges = spark.createDataFrame([("r:10", "e:b"), ("r:9", "e:b"), ("e:b", "e:a"), ("z", "z"), ("é", "f"), ("r:7", "r:70")], "src string, dst string")
    got = {tuple(r) for r in R.connected_components(edges).collect()}
    assert got == {("r:10", "e:a"), ("r:9", "e:a"), ("e:b", "e:a"), ("e:a", "e:a"), ("z", "z"), ("é", "f"), ("f", "f"), ("r:7", "r:7"), ("r:70", "r:7")}
