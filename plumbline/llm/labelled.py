"""A bounded sample of labelled documents for fitting a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.scratch import Scratch


def fold(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null without id."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(column.cast("string").cast("binary")) % folds


def training_labels(labels: DataFrame, scratch: Scratch, label_col: str, folds: int, held_out: int, limit: int, id_col: str = "doc_id") -> DataFrame:
    """(id, y) of at most ``limit`` labelled ids outside the held-out fold, those with the smallest hash; an id that repeats counts once."""
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id IS NOT NULL AND y IS NOT NULL").filter(fold("id", folds) != held_out)
    one = rows.groupBy("id").agg(F.max("y").alias("y"))
    return scratch.save(one.orderBy(F.xxhash64("id"), "id").limit(limit), "training-labels")
