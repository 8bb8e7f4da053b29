"""Per-key selection, merge and upsert (WN-*, SK-02..05).

Selections are ``row_number() <= n`` filters.  Spark turns that pattern into a
WindowGroupLimit on both sides of the exchange, so each map task forwards at
most ``n`` rows per key: a key that holds a third of all rows is cut down before
the shuffle and never lands whole in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.functions.rules import ColumnOrName, col


def _order(order: Sequence[ColumnOrName]) -> list[Column]:
    return [col(o) for o in order]


# WN-03
def top_n_per_group(df: DataFrame, keys: Sequence[ColumnOrName], order: Sequence[ColumnOrName], n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows of each group in a total order (end it with a unique id)."""
    w = W.partitionBy(*[col(k) for k in keys]).orderBy(*_order(order))
    out = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    return out.withColumnRenamed("_rn", rank) if rank else out.drop("_rn")


# WN-01
def first_per_key(df: DataFrame, keys: Sequence[ColumnOrName], order: Sequence[ColumnOrName]) -> DataFrame:
    """First-seen-wins dedupe: the row with the lowest order per key."""
    return top_n_per_group(df, keys, order, 1)


# WN-02
def best_per_key(df: DataFrame, keys: Sequence[ColumnOrName], order: Sequence[ColumnOrName]) -> DataFrame:
    """Best row per key, e.g. ``[desc(rank), desc(confidence), "seq"]``."""
    return top_n_per_group(df, keys, order, 1)


# WN-07
def merge_groups(df: DataFrame, key: str, latest_by: Sequence[str], keep_latest: Sequence[str], maxima: Sequence[str] = (),
                 sums: Sequence[str] = (), sets: Sequence[str] = ()) -> DataFrame:
    """One row per key: latest values, maxima, sums and the union of label sets.

    All parts are partial aggregates, so a hot key is combined map-side.  Use
    ``sets`` only for columns with a small vocabulary (trades, roles, types).
    """
    stamp = F.struct(*latest_by)
    aggs = [F.max_by(F.struct(*keep_latest), stamp).alias("_latest")]
    aggs += [F.max(c).alias(c) for c in maxima]
    aggs += [F.sum(c).alias(c) for c in sums]
    aggs += [F.array_sort(F.collect_set(c)).alias(c) for c in sets]
    aggs.append(F.count(F.lit(1)).alias("merged_rows"))
    out = df.groupBy(key).agg(*aggs)
    return out.select(key, *[F.col(f"_latest.{c}").alias(c) for c in keep_latest], *maxima, *sums, *sets, "merged_rows")


# WN-10
def collapse_packages(df: DataFrame, scale: str, package_key: str, row_id: str, order: Sequence[ColumnOrName], min_scale: int = 3,
                      always: Column | None = None) -> DataFrame:
    """Keep one row per package key for large packages, every other row as it is."""
    big = F.coalesce(F.col(scale) >= min_scale, F.lit(False))
    if always is not None:
        big = big | always
    key = F.when(big, F.concat(F.lit("pkg:"), F.col(package_key))).otherwise(F.concat(F.lit("row:"), F.col(row_id).cast("string")))
    return first_per_key(df.withColumn("_collapse", key), ["_collapse"], order).drop("_collapse")


# SK-02 / SK-03
def upsert(base: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Field-level merge: a non-NULL delta value replaces the base value.

    ``delta`` must be unique per key (see :func:`latest_per_key`).
    """
    fields = [c for c in base.columns if c not in keys]
    d = delta.select(*keys, *[F.col(c).alias(f"_d_{c}") for c in fields if c in delta.columns])
    joined = base.join(d, list(keys), "full_outer")
    value = lambda c: F.coalesce(F.col(f"_d_{c}"), F.col(c)).alias(c) if c in delta.columns else F.col(c)
    return joined.select(*keys, *[value(c) for c in fields])


def latest_per_key(df: DataFrame, keys: Sequence[str], seq: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Last non-NULL value of each field per key, in ``seq`` order."""
    stamp = F.struct(*seq)
    aggs = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), stamp)).alias(f) for f in fields]
    return df.groupBy(*keys).agg(*aggs)


# SK-04
def seed_missing(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert-if-absent: rows of ``new`` whose key the base does not have."""
    return base.unionByName(new.join(base.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)


# SK-05
def last_wins_properties(df: DataFrame, id_cols: Sequence[str], seq: str, props: Sequence[str]) -> DataFrame:
    """Node / edge upsert: each property keeps the last value written for the id."""
    return latest_per_key(df, id_cols, [seq], props)


def edges_with_both_ends(edges: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst", node_id: str = "id") -> DataFrame:
    ids = nodes.select(F.col(node_id).alias("_n")).distinct()
    return edges.join(ids, F.col(src) == F.col("_n"), "left_semi").join(ids, F.col(dst) == F.col("_n"), "left_semi")
