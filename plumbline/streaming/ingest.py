"""Incremental ingest and rolling activity (SS-01, SS-02)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.keyed import first_per_key
from plumbline.sources.snapshots import Snapshots


# SS-01
def dedupe_stream(stream: DataFrame, key: str, event_time: str, delay: str) -> DataFrame:
    """First arrival per key within the watermark delay; state older than it is dropped."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def upsert_sink(table_path: str, key: str, seq: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: each batch is one versioned folder, so a replayed batch
    overwrites itself; :func:`read_latest` gives the newest row per key."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_seq", F.col(seq)).write.mode("overwrite").parquet(f"{table_path}/batch_id={batch_id}")

    return write


def ingest(stream: DataFrame, normalizer: Callable[[DataFrame], DataFrame], key: str, event_time: str, delay: str, table_path: str, checkpoint: str) -> StreamingQuery:
    rows = dedupe_stream(normalizer(stream), key, event_time, delay)
    return rows.writeStream.foreachBatch(upsert_sink(table_path, key, event_time)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, table_path: str, key: str) -> DataFrame:
    rows = spark.read.parquet(table_path)
    fields = [c for c in rows.columns if c not in (key, "_seq", "batch_id")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct("_seq", "batch_id")).alias("r")).select(key, "r.*")


def _newest(rows: DataFrame, key: str) -> DataFrame:
    fields = [c for c in rows.columns if c not in (key, "_bucket")]
    return rows.groupBy("_bucket", key).agg(F.max_by(F.struct(*fields), F.struct("_seq", "_batch")).alias("r")).select(key, "r.*", "_bucket")


def compacting_sink(table: Snapshots, key: str, seq: str, compact_after: int = 16, buckets: int = 32) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: a batch is a segment in buckets of its key, made visible by the next version of the manifest.

    The manifest carries the number of the last batch, so a replayed batch changes nothing.  Beyond ``compact_after`` segments
    they are merged into one with the newest row of each key; old versions expire.  Reading costs the same however many batches came.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        base, manifest = table.current()
        if batch_id <= manifest["note"].get("batch", -1):
            return
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        rows = batch.select("*", F.col(seq).alias("_seq"), F.lit(batch_id).cast("long").alias("_batch"), bucket.alias("_bucket"))
        parts = [*manifest["tables"].get("data", []), table.stage(rows.repartition("_bucket"), ("_bucket",))]
        table.commit({"data": parts}, base, {"batch": batch_id})
        if len(parts) > compact_after:
            compact(table, key)

    return write


def compact(table: Snapshots, key: str) -> None:
    """Merge all segments into one; the batch number stays."""
    base, manifest = table.current()
    table.commit({"data": [table.stage(_newest(table.read(), key), ("_bucket",))]}, base, manifest["note"])
    table.expire(2)


def newest_rows(table: Snapshots, key: str) -> DataFrame:
    """The newest row of every key."""
    return _newest(table.read(), key).drop("_seq", "_batch", "_bucket")


def ingest_compacted(stream: DataFrame, normalizer: Callable[[DataFrame], DataFrame], key: str, event_time: str, delay: str, table: Snapshots, checkpoint: str, compact_after: int = 16) -> StreamingQuery:
    """As :func:`ingest`, into a table whose size and number of folders follow its keys, not its batches."""
    rows = dedupe_stream(normalizer(stream), key, event_time, delay)
    return rows.writeStream.foreachBatch(compacting_sink(table, key, event_time, compact_after)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# SS-02
def recent_sink(table: Snapshots, key: str, order: list[Column], k: int = 25) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink that keeps the first ``k`` rows of all batches by ``order``, one for each key.

    The first k of a union are among the first k of its parts, so the stored k rows are all the state; late rows take the
    place that their order gives them, and a replayed batch changes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        base, manifest = table.current()
        if batch_id <= manifest["note"].get("batch", -1):
            return
        rows = batch.unionByName(table.read("recent")) if manifest["tables"] else batch
        top = first_per_key(rows, [key], order).orderBy(*order).limit(k)
        table.commit({"recent": [table.stage(top)]}, base, {"batch": batch_id})
        table.expire(2)

    return write


def rolling_activity(df: DataFrame, event_time: str, kind: str, window: str = "1 day", delay: str | None = None) -> DataFrame:
    """Counts per tumbling window and kind; the same code serves a stream (with a delay) and a batch."""
    src = df.withWatermark(event_time, delay) if delay else df
    return src.groupBy(F.window(event_time, window).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")
