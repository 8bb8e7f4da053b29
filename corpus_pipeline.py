"""Corpus pipeline: from raw documents to packed training sequences.

Stages, in this order: quality rules, line dedup, near-dedup, benchmark decontamination, packing.  Each takes what the one
before kept, as Parquet in the shared checkpoint folder, and its decisions take effect.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.decontaminate import contamination
from plumbline.llm.line_dedup import line_dedup
from plumbline.llm.near_dedup import near_duplicates
from plumbline.llm.packing import pack
from plumbline.llm.quality_rules import quality_rules
from plumbline.llm.registry import ship
from plumbline.llm.scratch import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; a row's own verdict counts, also where ids repeat."""
    return quality_rules(docs, carry=[c for c in docs.columns if c != "doc_id"]).filter("kept").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows go, and with them documents of which no line is left."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cut = line_dedup(docs, carry=[*rest, "n_chars"]).filter("n_removed = 0 OR n_removed < n_lines")
    length = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.withColumn("n_chars", length).select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id, once.

    A document is an id with its text, so rows that share an id and differ in text are told apart.  Shingles are of two
    words, as in ``op9_minhash_near_dedup``: five words would miss copies in which every tenth word differs.
    """
    own = F.struct(F.col("doc_id"), F.xxhash64("text").alias("own"))
    keyed = docs.select("*", own.alias("_document"))
    kept = near_duplicates(keyed, id_col="_document", shingle=2).filter("kept").select(F.col("_document.doc_id").alias("_id"), F.col("_document.own").alias("_own")).distinct()
    same = docs["doc_id"].eqNullSafe(kept["_id"]) & (F.xxhash64(docs["text"]) == kept["_own"])
    return docs.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=[c for c in docs.columns if c != "doc_id"])
    return found.filter(F.size("spans") == 0).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their token ids and their place in a sequence."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near), ("decontamination", decontaminate), ("packing", packing)]

#: the outlier estimates and the token ids are beyond SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; the last one's rows are computed when they are read."""
    ship(spark)
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES[:-1]):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if n:
            scratch.drop(STAGES[n - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)
