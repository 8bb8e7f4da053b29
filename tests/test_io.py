"""Files, imports and streaming on small fixtures."""

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from plumbline.sources import imports as I
from plumbline.sources import readers as RD
from plumbline.streaming import ingest as S


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_source_caches_tolerate_missing_files(spark):
    d = folder()
    with open(f"{d}/a.json", "w") as f:
        json.dump({"sourceName": "A", "records": [{"sourceId": "1", "payload": {"x": 1}}, {"sourceId": "2"}]}, f)
    rows = RD.read_source_caches(spark, [f"{d}/a.json", f"{d}/absent.json"])
    assert sorted(r.sourceId for r in rows.collect()) == ["1", "2"]


def test_license_csv_quotes(spark):
    d = folder()
    with open(f"{d}/l.csv", "w") as f:
        f.write("LicenseNo,BusinessName,FullBusinessName,BusinessPhone,PrimaryStatus,City,County,MailingAddress\n")
        f.write('1,"Acme, Inc","Acme, Inc",9160001234,CLEAR,Folsom,Sacramento,"1 Main, Suite 2"\n')
    assert RD.read_license_master(spark, f"{d}/l.csv").first().BusinessName == "Acme, Inc"


@pytest.mark.parametrize("status,kept,errors", [("Planning", 2, 0), ("Nope", 0, 1)])
def test_import_is_all_or_nothing(spark, status, kept, errors):
    row = lambda n, s: (n, "Residential", s, "Folsom", "Sacramento County", "1 Main", "$5,000")
    df = spark.createDataFrame([row("a", "Planning"), row("b", status)], "name STRING, project_type STRING, status STRING, city STRING, county STRING, address STRING, estimated_value STRING")
    valid, bad = I.import_batch(df)
    assert (valid.count(), bad.count()) == (kept, errors)


def test_require_valid_raises(spark):
    docs = spark.createDataFrame([("d1", "T", "https://a.test"), ("d1", "T", "https://a.test")], "id STRING, title STRING, source_url STRING")
    with pytest.raises(Exception, match="duplicate id"):
        I.require_valid(docs).collect()


def test_stream_ingest_keeps_first_and_survives_replay(spark):
    d = folder()
    spark.createDataFrame([("a", "2024-01-01 00:00:00", 1), ("a", "2024-01-01 00:01:00", 2), ("b", "2024-01-01 00:02:00", 3)], "id STRING, t STRING, v INT").coalesce(1).write.json(f"{d}/in")
    stream = spark.readStream.schema("id STRING, t STRING, v INT").json(f"{d}/in")
    q = S.ingest(stream, lambda x: x.withColumn("ts", F.to_timestamp("t")), "id", "ts", "1 hour", f"{d}/table", f"{d}/ck")
    q.awaitTermination(60)
    out = S.read_latest(spark, f"{d}/table", "id")
    assert sorted((r.id, r.v) for r in out.collect()) == [("a", 1), ("b", 3)]


def test_rolling_activity_stream_equals_batch(spark, sf):
    d = folder()
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    events.coalesce(1).write.parquet(f"{d}/in")
    stream = S.rolling_activity(spark.readStream.schema(events.schema).parquet(f"{d}/in"), "ts", "event_type", delay="1 hour")
    q = stream.writeStream.format("memory").queryName("rolling").outputMode("complete").option("checkpointLocation", f"{d}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("rolling").collect())) == sorted(map(tuple, S.rolling_activity(events, "ts", "event_type").collect()))
