"""Sources and extracts over landed data (SC-*)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import rules as R
from plumbline.functions import text as X
from plumbline.functions.rules import ColumnOrName, col
from plumbline.operators.keyed import first_per_key
from plumbline.operators.relational import union_all

CACHE_SCHEMA = (
    "sourceName STRING, sourceType STRING, sourceUrl STRING, capturedAt TIMESTAMP, "
    "records ARRAY<STRUCT<sourceId STRING, sourceName STRING, sourceUrl STRING, capturedAt TIMESTAMP, payload STRING>>"
)
REGISTRY_SCHEMA = "id STRING, name STRING, source_type STRING, url STRING, active BOOLEAN"


# SC-01
def read_source_caches(spark: SparkSession, paths: Sequence[str], schema: str = CACHE_SCHEMA) -> DataFrame:
    """Rows of ``records[]`` over several cache files; a missing file adds nothing."""
    frames = []
    for path in paths:
        try:
            raw = spark.read.schema(schema).json(path, multiLine=True)
            frames.append(raw.select(F.explode("records").alias("r")).select("r.*"))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    empty = spark.createDataFrame([], schema).select(F.explode("records").alias("r")).select("r.*")
    return union_all(*frames) if frames else empty


# SC-02
def read_table(spark: SparkSession, path: str, schema: str | None = None, fmt: str = "parquet") -> DataFrame:
    """A derived table; an absent optional input becomes an empty frame of its schema."""
    try:
        if fmt == "json":
            return (spark.read.schema(schema) if schema else spark.read).json(path, multiLine=True)
        return spark.read.format(fmt).load(path)
    except AnalysisException as e:
        if schema is None or "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


# SC-03
def permit_extract(df: DataFrame, applied: ColumnOrName, valuation: ColumnOrName, as_of: str, months: int, minimum: float, n: int, tie: str) -> DataFrame:
    """Recent and valuable permits, newest first."""
    since = F.add_months(F.lit(as_of).cast("date"), -months)
    return df.filter((col(applied) >= since) & (col(valuation) >= minimum)).orderBy(F.desc(applied), tie).limit(n)


# SC-04
def keyword_predicate(columns: Sequence[str], keywords: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.upper(c).like(f"%{k.upper()}%") for c in columns for k in keywords])


def merge_extracts(first: DataFrame, second: DataFrame, key: str, order: Sequence[ColumnOrName]) -> DataFrame:
    """Union of two extracts; the first extract's row wins for a key."""
    rows = first.withColumn("_part", F.lit(0)).unionByName(second.withColumn("_part", F.lit(1)))
    return first_per_key(rows, [key], ["_part", *order]).drop("_part")


# SC-05
def newest_by(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(key)).limit(n)


# SC-06
def bid_notice_extract(df: DataFrame, text: ColumnOrName, posted: ColumnOrName, keywords: Sequence[str], as_of: str, days: int, notice_id: str, seq: str) -> DataFrame:
    """Notices of the window tagged with the first keyword that occurs, one row per notice.

    The first keyword wins for a notice, so a CASE over the list replaces one scan per keyword.
    """
    body = F.lower(col(text))
    keyword = R.case([(body.contains(k.lower()), k) for k in keywords])
    position = R.case([(body.contains(k.lower()), i) for i, k in enumerate(keywords)])
    window = col(posted).cast("date").between(F.date_sub(F.lit(as_of).cast("date"), days), F.lit(as_of).cast("date"))
    rows = df.filter(window).withColumn("keyword", keyword).withColumn("_pos", position).filter(F.col("keyword").isNotNull())
    return first_per_key(rows, [notice_id], ["_pos", seq]).drop("_pos")


# SC-07
def planning_extract(layers: dict[str, tuple[DataFrame, Column | None]]) -> DataFrame:
    """Several planning layers, each with its own status filter, in one frame."""
    return union_all(*[(df.filter(cond) if cond is not None else df).withColumn("layer", F.lit(name)) for name, (df, cond) in layers.items()])


# SC-08
LICENSE_SCHEMA = "LicenseNo STRING, BusinessName STRING, FullBusinessName STRING, BusinessPhone STRING, PrimaryStatus STRING, City STRING, County STRING, MailingAddress STRING"


def read_license_master(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, quote='"', escape='"').select(*[c.split()[0] for c in LICENSE_SCHEMA.split(", ")])


# SC-11
def source_registry(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), REGISTRY_SCHEMA)


# SC-12
def source_metadata(df: DataFrame, captured: str, source: str) -> DataFrame:
    return df.groupBy(source).agg(F.max(captured).alias("last_captured"), F.count(F.lit(1)).alias("records"))


# SK-01
def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite").format(fmt)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def label(c: ColumnOrName) -> Column:
    return X.text_or(c, "Unknown")
