"""Quality, toxicity, secret and licence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.llm.licenses import license_scan
from plumbline.llm.quality_gam import quality_scores
from plumbline.llm.quality_rules import quality_rules
from plumbline.llm.registry import query, table
from plumbline.llm.secrets import scan_secrets
from plumbline.llm.toxicity import toxicity


@query("op4_quality_rules")
def op4(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"))


@query("op10_toxicity")
def op10(spark, sf_dir):
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op5_quality_classifier")
def op5(spark, sf_dir):
    scored = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query("op7_secret_scan")
def op7(spark, sf_dir):
    found = scan_secrets(table(spark, sf_dir, "documents"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), F.transform("spans", lambda s: F.round(s["score"], 3)).alias("scores"))


@query("op2_license_scan")
def op2(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"))
