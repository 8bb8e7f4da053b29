"""Aggregations (AG-*).  All are partial-aggregating groupBys; long lists stay long tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.rules import ColumnOrName, case, col
from plumbline.operators.relational import PAGE, child_pages


# AG-02
def count_by(df: DataFrame, key: ColumnOrName, n: int | None = None, name: str = "name") -> DataFrame:
    out = df.groupBy(col(key).alias(name)).agg(F.count(F.lit(1)).alias("count"))
    return out.orderBy(F.desc("count"), name).limit(n) if n else out


# AG-03
def value_counts(df: DataFrame, group: Sequence[str], value: ColumnOrName, name: str = "name") -> DataFrame:
    """Long frequency table (group, name, count); NULL and empty names are dropped.

    The list order is (count desc, name); :func:`frequency_lists` nests the top.
    """
    v = df.withColumn(name, col(value)).filter(F.col(name).isNotNull() & (F.col(name) != ""))
    return v.groupBy(*group, name).agg(F.count(F.lit(1)).alias("count"))


def frequency_lists(df: DataFrame, group: Sequence[str], value: ColumnOrName, as_name: str, page: int = PAGE) -> DataFrame:
    """All {name, count} of each group as ordered arrays of at most ``page``, one row per group and page."""
    counts = value_counts(df, group, value)
    return child_pages(counts, group, [F.desc("count"), "name"], ["name", "count"], as_name, page)


# AG-04
CONFIDENCE_BUCKETS = ["0-49", "50-64", "65-79", "80-100"]


def confidence_bucket(c: ColumnOrName) -> Column:
    percent = F.floor(col(c) * 100 + 0.5)
    return case([(percent < 50, "0-49"), (percent < 65, "50-64"), (percent < 80, "65-79")], "80-100")


def confidence_buckets(df: DataFrame, c: ColumnOrName) -> DataFrame:
    """Zero-filled histogram over the four fixed buckets."""
    spark = df.sparkSession
    vocab = spark.createDataFrame([(b,) for b in CONFIDENCE_BUCKETS], "bucket STRING")
    counts = df.groupBy(confidence_bucket(c).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return vocab.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


# AG-05 / AG-18
def conditional_counts(df: DataFrame, metrics: dict[str, Column], group: Sequence[str] = ()) -> DataFrame:
    """Many count_if metrics in one scan."""
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in metrics.items()])


def metric_rows(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """The same metrics as (metric, value) rows."""
    wide = conditional_counts(df, metrics)
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in ["total", *metrics]])
    return wide.select(F.explode(pairs).alias("p")).select("p.metric", "p.value")


# AG-06
def facet_counts(df: DataFrame, facets: dict[str, ColumnOrName], vocab: dict[str, Sequence[str]], top: dict[str, int] | None = None,
                 skip: dict[str, str] | None = None) -> DataFrame:
    """(facet, value, count) in one pass; vocabulary facets are zero-filled, open ones may be cut to top k."""
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), col(c).alias("value")) for f, c in facets.items()])
    long = df.select(F.explode(pairs).alias("p")).select("p.facet", "p.value").filter("value IS NOT NULL")
    for f, v in (skip or {}).items():
        long = long.filter(~((F.col("facet") == f) & (F.col("value") == v)))
    counts = long.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("count"))
    spark = df.sparkSession
    fixed = spark.createDataFrame([(f, v) for f, vs in vocab.items() for v in vs], "facet STRING, value STRING")
    closed = fixed.join(counts, ["facet", "value"], "left").select("facet", "value", F.coalesce("count", F.lit(0)).alias("count"))
    open_facets = [f for f in facets if f not in vocab]
    out = closed
    for f in open_facets:
        part = counts.filter(F.col("facet") == f)
        if top and f in top:
            part = part.orderBy(F.desc("count"), "value").limit(top[f])
        out = out.unionByName(part)
    return out


# AG-08
def filter_options(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values per column as (field, value) rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.field", "p.value").filter("value IS NOT NULL").distinct()


# AG-19
def role_coverage(df: DataFrame, project: str, role: str, company: str, seq: str, roles: Sequence[str]) -> DataFrame:
    """Project x role -> company, last one wins, "Unknown" where no company is known."""
    aggs = [F.max_by(F.when(F.col(role) == r, F.col(company)), F.when(F.col(role) == r, F.col(seq))).alias(r) for r in roles]
    out = df.groupBy(project).agg(*aggs)
    return out.select(project, *[F.coalesce(F.col(f"`{r}`"), F.lit("Unknown")).alias(r) for r in roles])


# AG-23
def names_of_role(role: ColumnOrName, name: ColumnOrName, order: ColumnOrName, wanted: str) -> Column:
    """Aggregate: all names of ``wanted`` in order, joined by commas; null without one."""
    found = F.array_sort(F.collect_list(F.when(col(role) == wanted, F.struct(col(order).alias("o"), col(name).alias("n")))))
    return F.nullif(F.array_join(F.transform(found, lambda s: s["n"]), ", "), F.lit(""))


# AG-20
def term_audit(df: DataFrame, text: ColumnOrName, terms: Sequence[str], row_id: str) -> DataFrame:
    """Per term: total occurrences, rows hit and the lowest row id hit.

    The terms are columns of one scan, unpivoted after the aggregation; texts are
    never multiplied by the term list.
    """
    from plumbline.functions.text import count_term

    aggs = []
    for i, term in enumerate(terms):
        n = count_term(text, F.lit(term))
        aggs += [F.sum(n).alias(f"s{i}"), F.count_if(n > 0).alias(f"r{i}"), F.min(F.when(n > 0, F.col(row_id))).alias(f"f{i}")]
    wide = df.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(term).alias("term"), F.coalesce(F.col(f"s{i}"), F.lit(0)).alias("occurrences"),
                 F.col(f"r{i}").alias("rows_hit"), F.col(f"f{i}").alias("first_row"))
        for i, term in enumerate(terms)
    ])
    return wide.select(F.explode(rows).alias("x")).select("x.*")


def zero(c: ColumnOrName) -> Column:
    return F.coalesce(col(c), F.lit(0))


def combine_or(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
