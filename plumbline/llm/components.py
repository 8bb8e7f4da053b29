"""Connected components of a link table, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.scratch import Scratch


def components(links: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """(id, label) for every id in ``links`` (a, b): label is the smallest id reachable.

    Each round hooks every label to its smallest neighbour, follows the hooks to their end and contracts the links to
    labels, so links shrink fast.  Tables of a round are written, and read sides are joined from files: a hub with many
    links is a size-checked broadcast or a join that adaptive execution splits.
    """
    edges = scratch.save(links.select("a", "b").filter("a <> b").distinct(), f"{tag}-edges-0")
    nodes = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    labels = scratch.save(nodes.select("id", F.col("id").alias("label")), f"{tag}-labels-0")
    n = 0
    while not edges.isEmpty():
        n += 1
        both = edges.union(edges.select("b", "a"))
        up = scratch.save(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("top")), f"{tag}-up-{n}-0")
        jumps = 0
        while True:  # pointer jumping: chains of hooks halve each time
            far = up.select(F.col("id").alias("top"), F.col("top").alias("far"))
            jumped = up.join(far, "top").select("id", F.col("far").alias("new"), (F.col("far") != F.col("top")).alias("moved"))
            jumps += 1
            saved = scratch.save(jumped, f"{tag}-up-{n}-{jumps}")
            scratch.drop(f"{tag}-up-{n}-{jumps - 1}")
            moved = not saved.filter("moved").isEmpty()
            up = saved.select("id", F.col("new").alias("top"))
            if not moved:
                break
        step = up.select(F.col("id").alias("label"), "top")
        labels = scratch.save(labels.join(step, "label", "left").select("id", F.coalesce("top", "label").alias("label")), f"{tag}-labels-{n}")
        renamed = edges.join(up.select(F.col("id").alias("a"), F.col("top").alias("x")), "a").join(up.select(F.col("id").alias("b"), F.col("top").alias("y")), "b")
        edges = scratch.save(renamed.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{tag}-edges-{n}")
        scratch.drop(f"{tag}-edges-{n - 1}", f"{tag}-labels-{n - 1}", f"{tag}-up-{n}-{jumps}")
    return labels
