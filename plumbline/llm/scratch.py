"""Intermediate tables in the shared checkpoint folder.

A written table cuts lineage, survives the loss of executors, and has a size that Spark knows when it plans the joins
that read it: small ones are broadcast below ``spark.sql.autoBroadcastJoinThreshold``, others are joined by sorted
shuffles that adaptive execution can split where a key is hot.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.registry import ship
from plumbline.session import ensure_checkpoint_dir


class Scratch:
    """A folder of its own for one operator run.  ``drop`` removes tables that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)  # an operator that writes tables also runs its functions on the executors
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
