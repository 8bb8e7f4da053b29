"""Packing query."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.llm.packing import pack
from plumbline.llm.registry import query, table


def packed(docs):
    """Pieces with a digest of their ids in place of the ids."""
    import public_tokenizers

    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op8_packing")
def op8(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"))
