"""Line dedup over overlapping windows of consecutive lines, in DataFrame functions only.

Every window of three consecutive lines is hashed (two independent 64-bit hashes).  A window that occurred before,
in an earlier document or earlier in the same one, is a later occurrence; the lines of all later occurrences are
merged and removed.

A document is an id with a text: rows that repeat both are one document, rows that share an id and differ in text are
documents of their own, in the order of a hash of the text.

Scale: the shuffled rows are window hashes, not texts.  The earliest occurrence is found in two steps, first within
(hash, salt), then among the earliest of each salt, so a passage held by a third of all documents is ranked by
``salts`` tasks.  The last step joins the removed positions to the texts by document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _once(array: Column) -> Column:
    """One row that carries ``array`` as a column of its own, so that lambdas read it instead of computing it again."""
    return F.explode(F.array(array))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3, salts: int = 64) -> DataFrame:
    """(id, own, pos): start lines of windows whose text occurred before, in the order (id, own, pos); own is a hash of the text."""
    line_hashes = F.transform(F.split(text_col, "\n"), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(window), x).alias("b")))
    lines = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("own"), _once(line_hashes).alias("h"))

    def key(i: Column) -> Column:
        at = [F.get("h", i + k) for k in range(window)]
        return F.struct(F.xxhash64(*[x["a"] for x in at]).alias("k1"), F.xxhash64(*[x["b"] for x in at]).alias("k2"))

    windows = (
        lines.filter(F.size("h") >= window)
        .select("id", "own", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("h") - window), key)).alias("pos", "k"))
        .select("id", "own", "pos", "k.k1", "k.k2", F.pmod(F.xxhash64("id", "own"), F.lit(salts)).alias("salt"))
    )
    # rank, not row_number: rows that repeat a document are the same occurrence
    ranked = windows.withColumn("r", F.rank().over(Window.partitionBy("k1", "k2", "salt").orderBy("id", "own", "pos")))
    heads = ranked.filter("r = 1").withColumn("r", F.rank().over(Window.partitionBy("k1", "k2").orderBy("id", "own", "pos")))
    return ranked.filter("r > 1").select("id", "own", "pos").union(heads.filter("r > 1").select("id", "own", "pos"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3, salts: int = 64, carry: Sequence[str] = ()) -> DataFrame:
    """Remove the lines of every later occurrence of a repeated window.

    Returns one row per input row: ``id_col``, ``text_col`` (remaining lines), ``n_lines``, ``n_removed`` (long).
    Null text: null, 0 and 0.  Empty text: one empty line.  A text of fewer lines than the window is left as it is, and
    so is a row without id.  Rows that repeat an id and its text get the same result each; of rows that share an id and
    differ in text, each is judged by its own text.  The columns named in ``carry`` come
    back unchanged, others are not read.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry)])
    carried = [f"_carry{i}" for i in range(len(carry))]
    later = repeated_windows(base, "id", "text", window, salts).groupBy("id", "own").agg(F.collect_set("pos").alias("starts"))
    joined = base.withColumn("own", F.xxhash64("text")).join(later, ["id", "own"], "left").select("id", "text", *carried, "starts", _once(F.split("text", "\n")).alias("lines"))
    covered = F.flatten(F.transform("starts", lambda p: F.sequence(p, p + (window - 1))))
    left = joined.select("id", "text", *carried, "lines", _once(F.when(F.col("starts").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), covered))).alias("left"))
    return left.select(
        F.col("id").alias(id_col),
        F.when(F.col("left").isNull(), F.col("text")).otherwise(F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n")).alias(text_col),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(F.col("left").isNull(), 0).otherwise(F.size("lines") - F.size("left")).cast("long").alias("n_removed"),
        *[F.col(x).alias(c) for x, c in zip(carried, carry)],
    )
