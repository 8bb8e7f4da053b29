"""Reads against a declared schema: good rows, and a table of what could not be read (SC-01, SC-02, SC-08)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.relational import union_all

ERRORS = "file STRING, reason STRING, record STRING"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def read_checked(spark: SparkSession, paths: Sequence[str], schema: str, fmt: str = "json", required: Sequence[str] = (), **options) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of JSON or CSV files.

    A path that does not exist adds no rows and one error, so an optional input becomes an empty typed table.  Records that
    do not parse under ``schema``, and rows without a ``required`` column, go to errors(file, reason, record).
    """
    declared = T._parse_datatype_string(schema)
    wide = T.StructType([*declared.fields, T.StructField("_corrupt_record", T.StringType())])
    there = [p for p in paths if _exists(spark, p)]
    absent = spark.createDataFrame([(p, "absent", None) for p in paths if p not in there], ERRORS)
    if not there:
        return spark.createDataFrame([], declared), absent
    read = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").options(**options)
    rows = getattr(read, fmt)(there).withColumn("_file", F.input_file_name())
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required])) if required else F.array().cast("array<string>")
    reason = F.when(F.col("_corrupt_record").isNotNull(), F.lit("does not parse")).when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))
    judged = rows.withColumn("_reason", reason)
    whole = F.to_json(F.struct(*[F.col(f.name) for f in declared.fields]))
    bad = judged.filter("_reason IS NOT NULL").select(F.col("_file").alias("file"), F.col("_reason").alias("reason"), F.coalesce("_corrupt_record", whole).alias("record"))
    return judged.filter("_reason IS NULL").select(*declared.fieldNames()), union_all(bad, absent)
