"""Research atoms and semantic documents (ER-07, SR-06)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as X


def opportunity_atoms(opps: DataFrame, text_cols: Sequence[str]) -> DataFrame:
    return opps.select(
        F.concat(F.lit("atom:"), "id").alias("id"), F.lit("opportunity").alias("kind"), F.col("id").alias("source_id"), F.col(text_cols[0]).alias("title"),
        X.text_blob(*text_cols, lower=False).alias("text"), "city", "county", F.split("trade", r"\s*[,/|]\s*").alias("trade_hints"))


def planning_atoms(signals: DataFrame, sid: str, text_cols: Sequence[str]) -> DataFrame:
    return signals.select(
        F.concat(F.lit("atom:planning:"), F.col(sid)).alias("id"), F.lit("signal").alias("kind"), F.col(sid).alias("source_id"), F.col(text_cols[0]).alias("title"),
        X.text_blob(*text_cols, lower=False).alias("text"))


# SR-06
def semantic_documents(opps: DataFrame, text_cols: Sequence[str], phone: str) -> DataFrame:
    """(id, title, text) with the metadata columns the hybrid search filters on."""
    return opps.select(
        "id", F.col("project_name").alias("title"), X.text_blob(*text_cols, lower=False).alias("text"), F.nullif("trade", F.lit("")).alias("trade"), "city", "county",
        F.col("project_stage").alias("stage"), F.col(phone).isNotNull().alias("has_phone"))
