"""Bulk import: reading, column mapping, coercion and all-or-nothing validation (SC-09, NR-11, SK-07, FL-20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import contacts as C
from plumbline.functions import rules as R
from plumbline.functions import text as X
from plumbline.plans import vocab as V

IMPORT_COLUMNS = [
    "name", "description", "project_type", "status", "city", "county", "state", "address", "latitude", "longitude",
    "estimated_units", "estimated_value", "source_url", "source_name",
]
IMPORT_DEFAULTS = {"description": "Imported project record.", "state": "CA", "source_name": "Bulk Import"}
IMPORT_NUMBERS = ["latitude", "longitude", "estimated_units", "estimated_value"]


def map_columns(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Rename source columns to the import schema: explicit mapping first, then
    names that are equal once case and punctuation are dropped."""
    norm = lambda s: "".join(ch for ch in s.lower() if ch.isalnum())
    by_norm = {norm(c): c for c in df.columns}
    pick = {dst: (mapping or {}).get(dst) or by_norm.get(norm(dst)) for dst in IMPORT_COLUMNS}
    return df.select(*[(F.col(f"`{src}`") if src else F.lit(None).cast("string")).alias(dst) for dst, src in pick.items()])


def read_import(spark: SparkSession, path: str, fmt: str, mapping: dict[str, str] | None = None) -> DataFrame:
    """CSV with a header, JSON lines / arrays, or a JSON object with ``records``."""
    if fmt == "csv":
        raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    else:
        raw = spark.read.json(path, multiLine=True)
        if raw.columns == ["records"]:
            raw = raw.select(F.explode("records").alias("r")).select("r.*")
    return map_columns(raw, mapping)


def coerce_import(df: DataFrame) -> DataFrame:
    """Trim, apply defaults and parse money-like numbers."""
    out = []
    for c in df.columns:
        if c in IMPORT_NUMBERS:
            out.append(X.parse_money(F.col(c).cast("string")).alias(c))
        elif c in IMPORT_COLUMNS:
            out.append(X.text_or(F.col(c).cast("string"), IMPORT_DEFAULTS.get(c, "")).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def import_errors() -> Column:
    missing = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    outside = lambda c, allowed: ~F.coalesce(F.col(c).isin(allowed), F.lit(False))
    return R.labels_where(
        [
            (missing("name"), "missing name"),
            (outside("project_type", V.PROJECT_TYPES), "invalid project_type"),
            (outside("status", V.STATUS_TYPES), "invalid status"),
            (missing("city"), "missing city"),
            (missing("county"), "missing county"),
            (missing("address"), "missing address"),
        ]
    )


def validate_import(df: DataFrame) -> DataFrame:
    return df.withColumn("errors", import_errors())


def import_batch(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, row errors): one bad row rejects the whole batch.

    The gate is a semi join on "no error exists", so nothing is collected.
    """
    checked = validate_import(coerce_import(df))
    errors = checked.filter(F.size("errors") > 0)
    bad = errors.select(F.lit(1).alias("_bad")).limit(1)
    valid = checked.withColumn("_bad", F.lit(1)).join(F.broadcast(bad), "_bad", "left_anti").drop("_bad", "errors")
    return valid, errors


# FL-20
def with_document_errors(docs: DataFrame, key: str = "id") -> DataFrame:
    """Adds ``errors``: a missing id, title or URL, or an id that occurs more than once."""
    counts = docs.groupBy(key).agg(F.count(F.lit(1)).alias("_copies"))
    errors = R.labels_where(
        [
            (C.safe_text(key).isNull(), "missing id"),
            (F.col("_copies") > 1, "duplicate id"),
            (C.safe_text("title").isNull(), "missing title"),
            (C.safe_url("source_url").isNull(), "missing source_url"),
        ]
    )
    return docs.join(counts, key, "left").withColumn("errors", errors).drop("_copies")


def document_errors(docs: DataFrame, key: str = "id") -> DataFrame:
    return with_document_errors(docs, key).filter(F.size("errors") > 0)


def require_valid(docs: DataFrame, key: str = "id") -> DataFrame:
    """Pass valid rows through; the first bad row fails the job with its errors."""
    message = F.concat(F.lit("bad evidence document: "), F.coalesce(F.col(key), F.lit("?")), F.lit(" "), F.array_join("errors", ", "))
    ok = F.when(F.size("errors") > 0, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return with_document_errors(docs, key).filter(ok).drop("errors")
