"""Exact dedup by distributed most-significant-digit radix partitioning, in DataFrame functions only.

All rows start in one group.  A round splits every group by the next bytes of its texts: rows with the same group and the
same bytes form a group of the next round, a row alone in its group is unique and leaves, and a group whose texts ended
inside the digit holds equal texts and leaves with its largest id.  The bytes themselves are compared, no digest is.
A digit is a run of successive bytes that grows by ``growth`` each round, so the number of rounds is the logarithm of the
longest text, and a text is read on only as long as another one shares its prefix.

Scale: groups are counted with map-side combine, so a group that holds a third of all rows sends one row a task.  Rows learn
their group's number by a join with the groups of two rows and more.  At most 1 / ``hot_share`` groups can be larger than
that share of the rows: these are broadcast, and their rows are dealt by row number instead of by group.  Every round's rows
are written, finished ones without their text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _numbered(split: DataFrame, groups: DataFrame, limit: float, plain: list[str], length: int) -> DataFrame:
    """Rows with the number of their next group, or finished: alone in their group, or of a group that ended."""
    big = groups.filter(F.col("size") > limit).select("grp", "digit", F.struct("size", "top", "ended", "next").alias("big"))
    small = groups.filter(F.col("size") <= limit).select(F.col("grp").alias("dealt"), "digit", F.struct("size", "top", "ended", "next").alias("small"))
    found = split.join(F.broadcast(big), ["grp", "digit"], "left")  # at most 1 / hot_share groups
    found = found.withColumn("dealt", F.when(F.col("big").isNull(), F.col("grp")).otherwise(-1 - F.col("row")))
    found = found.join(small.hint("merge"), ["dealt", "digit"], "left").withColumn("g", F.coalesce("big", "small"))
    alone, going = F.col("g").isNull(), F.coalesce(~F.col("g.ended"), F.lit(False))
    return found.select(
        *plain,
        "row",
        F.when(going, F.col("g.next")).alias("grp"),
        F.when(going, F.expr(f"substring(rest, {length + 1})")).alias("rest"),
        F.when(alone, F.col("id")).otherwise(F.col("g.top.id")).alias("keep_id"),
        F.coalesce("g.size", F.lit(1)).cast("long").alias("size"),
        (alone | F.coalesce(F.col("g.top.row") == F.col("row"), F.lit(False))).alias("kept"),
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digit: int = 32, growth: int = 16, hot_share: float = 0.001, carry: Sequence[str] = ()) -> DataFrame:
    """Groups of texts that are equal after A-Z is lower-cased.

    Returns one row per input row: ``id_col``, keep_id (largest id of the group), group_size, kept, text_sha256 (of the
    normalised text in UTF-8).  A null text counts as empty.  A null id is smaller than all others; keep_id is null where a
    group has no other.  Of rows that repeat id and text one is kept, so every group keeps one row.  The columns named in
    ``carry`` (the text may be one) come back unchanged, others are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "radix")
    carried = [f"_carry{i}" for i in range(len(carry))]
    norm = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    base = docs.select(F.col(id_col).alias("id"), norm.alias("text"), *[F.col(c).alias(x) for c, x in zip(carry, carried)])
    plain = ["id", *carried, "sha"]
    # the row number lives from the first write on; until then it only spreads rows
    rows = base.select("id", *carried, F.sha2("text", 256).alias("sha"), F.monotonically_increasing_id().alias("row"), F.lit(0).cast("long").alias("grp"), F.col("text").cast("binary").alias("rest"))
    total = docs.count()
    done, n, length = [], 0, digit
    while True:
        split = rows.withColumn("digit", F.substring("rest", 1, length))
        groups = split.groupBy("grp", "digit").agg(F.count("*").alias("size"), F.max(F.struct("id", "row")).alias("top")).filter("size > 1")
        ended = F.octet_length("digit") < length
        if n == 0:  # row numbers are not fixed yet: an ended group takes its top in the next round
            groups = groups.withColumn("top", F.lit(None).cast(groups.schema["top"].dataType))
            ended = F.lit(False)
        groups = groups.select("grp", "digit", "size", "top", ended.alias("ended"), F.monotonically_increasing_id().alias("next"))
        groups = scratch.save(groups, f"groups-{n}")
        rows = scratch.save(_numbered(split, groups, total * hot_share, plain, length), f"rows-{n}")
        scratch.drop(f"groups-{n}")
        done.append(rows.filter("grp IS NULL").select(*plain, "keep_id", "size", "kept"))
        going = rows.filter("grp IS NOT NULL").select(*plain, "row", "grp", "rest")
        if going.isEmpty():
            break
        rows, n, length = going, n + 1, length * growth
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out.select(F.col("id").alias(id_col), "keep_id", F.col("size").alias("group_size"), "kept", F.col("sha").alias("text_sha256"), *[F.col(x).alias(c) for x, c in zip(carried, carry)])
