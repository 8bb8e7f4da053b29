"""Filters, joins and set operations (FL-01..06, JN-*, ST-*)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.functions.rules import ColumnOrName, col
from plumbline.session import ensure_checkpoint_dir


def contains_ci(columns: Sequence[ColumnOrName], q: str) -> Column:
    """Case-insensitive substring in any of the columns."""
    needle = q.lower()
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(col(c).cast("string")).contains(needle), F.lit(False)) for c in columns])


def filter_once(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on costly derived columns without evaluating them a second time.

    A filter is normally pushed below the projection that computes its columns,
    which repeats the expressions there.  Spark does not push past a
    nondeterministic column, so the partition id keeps the filter where it is.
    Use it only above derived columns: plain column filters should reach the scan.
    """
    return df.withColumn("_part", F.spark_partition_id()).filter(condition & (F.col("_part") >= 0)).drop("_part")


def dealt(df: DataFrame, key: ColumnOrName) -> DataFrame:
    """Rows by key over all cores, for costly columns above a table that has few files: those would be computed in as few tasks."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


# FL-01 .. FL-05
def filter_rows(df: DataFrame, equals: dict[str, object] | None = None, q: str | None = None, q_columns: Sequence[str] = ()) -> DataFrame:
    """Equality filters (pushed to the scan) plus an optional text filter; empty values are ignored."""
    for name, value in (equals or {}).items():
        if value not in (None, ""):
            df = df.filter(F.col(name) == F.lit(value))
    return df.filter(contains_ci(q_columns, q)) if q else df


# FL-06
def lookup_by_alternates(df: DataFrame, alternates: Sequence[tuple[Column, object]], order: Sequence[ColumnOrName]) -> DataFrame:
    """Point lookup: the first alternate (column, value) that any row matches wins."""
    rank = reduce(
        lambda acc, p: acc.when(p[1][0] == F.lit(p[1][1]), F.lit(p[0])),
        list(enumerate(alternates))[1:],
        F.when(alternates[0][0] == F.lit(alternates[0][1]), F.lit(0)),
    )
    hit = df.withColumn("_rank", rank).filter(F.col("_rank").isNotNull())
    return hit.orderBy("_rank", *[col(o) for o in order]).limit(1).drop("_rank")


# JN-02 / JN-05
PAGE = 10_000


def _paged(numbered: DataFrame, on: Sequence[str], fields: Sequence[str], as_name: str, page: int) -> DataFrame:
    lists = numbered.withColumn("page", F.floor((F.col("_pos") - 1) / page).cast("int")).groupBy(*on, "page").agg(F.array_sort(F.collect_list(F.struct("_pos", *fields))).alias(as_name))
    return lists.withColumn(as_name, F.transform(as_name, lambda s: F.struct(*[s[f].alias(f) for f in fields])))


def _numbered_by_range(rows: DataFrame, on: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Numbers of rows inside their key without a task that holds a key: ranges of (key, order) are numbered each, and the
    sizes of a key's earlier ranges are added.  The ranges are written first, so that both steps see the same ones."""
    ensure_checkpoint_dir(rows.sparkSession)
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(ranges, *[col(c) for c in on], *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    earlier = W.partitionBy(*on).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = placed.groupBy(*on, "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    inside = placed.withColumn("_in", F.row_number().over(W.partitionBy(*on, "_part").orderBy(*order)))
    return inside.join(before.drop("_n"), [*on, "_part"]).withColumn("_pos", F.col("_in") + F.col("_before")).drop("_in", "_before")


def child_pages(child: DataFrame, on: Sequence[str], order: Sequence[ColumnOrName], fields: Sequence[str], as_name: str, page: int = PAGE,
                among: DataFrame | None = None) -> DataFrame:
    """(on, page, array): all children of a key in order, in arrays of at most ``page``; pages are numbered from 0.

    No child is left out, and no array grows with its key.  Keys of one page are numbered by a window, which holds ``page``
    rows at most; keys of more pages (a share of the rows at most, as each has more than ``page``) by ranges.  Where ``child``
    is a costly selection, ``among`` is the rows it was made from: a key of few of them has few children too.
    """
    by = [col(o) for o in order]
    by_window = lambda df: df.withColumn("_pos", F.row_number().over(W.partitionBy(*on).orderBy(*by)))
    long = (child if among is None else among).groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") > page) & reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])).select(*on)
    if long.isEmpty():
        return _paged(by_window(child), on, fields, as_name, page)
    short = _paged(by_window(child.join(long, list(on), "left_anti")), on, fields, as_name, page)
    return short.unionByName(_paged(_numbered_by_range(child.join(long, list(on), "left_semi"), on, by), on, fields, as_name, page))


def attach_pages(parent: DataFrame, lists: Sequence[tuple[str, DataFrame]], on: Sequence[str]) -> DataFrame:
    """Parents with the pages of several child tables side by side: one row per parent and page, page 0 without children.

    ``<name>_count`` is the number of children on the row's page.
    """
    pages = reduce(lambda x, y: x.join(y, [*on, "page"], "full"), [df for _, df in lists])
    out = parent.join(pages, list(on), "left").withColumn("page", F.coalesce("page", F.lit(0)))
    return out.withColumns({f"{n}_count": F.when(F.col(n).isNull(), 0).otherwise(F.size(n)).cast("long") for n, _ in lists})


def attach_children(parent: DataFrame, child: DataFrame, on: Sequence[str], order: Sequence[ColumnOrName], fields: Sequence[str],
                    as_name: str, page: int = PAGE) -> DataFrame:
    """1:N attach of all children as ordered arrays, one row per parent and page (a single one up to ``page`` children)."""
    return attach_pages(parent, [(as_name, child_pages(child, on, order, fields, as_name, page))], on)


# JN-03
def join_on_either(left: DataFrame, right: DataFrame, left_id: str, right_id: str, pairs: Sequence[tuple[ColumnOrName, ColumnOrName]]) -> DataFrame:
    """Disjunctive equi join: one equi join per key pair, union, distinct by both ids.

    An OR condition would become a nested loop; the union keeps every branch a
    hash or merge join.
    """
    parts = []
    for lk, rk in pairs:
        l = left.withColumn("_k", col(lk)).filter("_k IS NOT NULL AND _k <> ''")
        r = right.withColumn("_k", col(rk)).filter("_k IS NOT NULL AND _k <> ''").select("_k", right_id)
        parts.append(l.join(r, "_k").select(left_id, right_id))
    ids = reduce(lambda a, b: a.unionByName(b), parts).distinct()
    return ids


# JN-04
def override_chain(base: DataFrame, layers: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Left-join layers in order; a later layer's non-NULL field overrides the row."""
    out = base
    for i, layer in enumerate(layers):
        fields = [c for c in layer.columns if c not in on]
        renamed = layer.select(*on, *[F.col(c).alias(f"_l{i}_{c}") for c in fields])
        out = out.join(renamed, list(on), "left")
        for c in fields:
            new = F.col(f"_l{i}_{c}")
            out = out.withColumn(c, F.coalesce(new, F.col(c)) if c in out.columns else new).drop(f"_l{i}_{c}")
    return out


# JN-08
def co_members(facts: DataFrame, group: str, member: str, types: dict[str, str] | None = None, keep: Column | None = None,
               carry: Sequence[str] = (), block: int = 64, opens: Column | None = None) -> DataFrame:
    """Ordered member pairs of a group that a relation rule keeps.

    Memberships are made distinct first.  Groups are then split into blocks of
    about ``block`` members and the join runs per (group, block, block), so one
    large group is spread over many tasks instead of one.  ``keep`` should be the
    relation rule: only pairs that carry a relation leave the join.  ``opens`` keeps
    members that cannot open a relation out of the left side.
    """
    extra = [c for c in facts.columns if c not in (group, member)]
    sizes = facts.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    m = facts.join(sizes, group).withColumn("_blocks", F.ceil(F.col("_n") / F.lit(block)).cast("int"))
    b = F.pmod(F.xxhash64(F.col(member).cast("string")), F.col("_blocks")).cast("int")
    left = (m if opens is None else m.filter(opens)).withColumn("_b", b).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    left = left.select(F.col(group), F.col("_b").alias("_bl"), F.col("_o").alias("_br"), *[F.col(c).alias(f"a_{c}") for c in [member, *extra]])
    right = m.withColumn("_br", b).withColumn("_bl", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    right = right.select(F.col(group), "_bl", "_br", *[F.col(c).alias(f"b_{c}") for c in [member, *extra]])
    out = left.join(right, [group, "_bl", "_br"]).filter(F.col(f"a_{member}") != F.col(f"b_{member}"))
    if keep is not None:
        out = out.filter(keep)
    return out.drop("_bl", "_br")


# JN-14
def flag_semi(left: DataFrame, matches: DataFrame, on: str, flag: str) -> DataFrame:
    """Semi join as a boolean column."""
    ids = matches.select(on).distinct().withColumn(flag, F.lit(True))
    return left.join(ids, on, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


# JN-17
def edge_labels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.select(F.col("id").alias("_id"), F.col("label").alias("_label"))
    out = edges.join(n, F.col("src") == F.col("_id"), "left").drop("_id").withColumnRenamed("_label", "src_label")
    return out.join(n, F.col("dst") == F.col("_id"), "left").drop("_id").withColumnRenamed("_label", "dst_label")


# ST-01
def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
