"""Registered queries on checked reads and written tables (SC-01, SC-02, SC-08, SK-08) and on parts of other results (CL-44)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.base import query
from plumbline.catalog.resolution import HYP_SQL, PE, hypothesis_rows, property_graph
from plumbline.catalog.stored import folder
from plumbline.operators import graph as G
from plumbline.sources import readers as RD
from plumbline.sources.checked import read_checked

RECORD = "sourceId STRING, sourceName STRING, sourceUrl STRING, capturedAt TIMESTAMP, payload STRING"
CACHE = f"sourceName STRING, records ARRAY<STRUCT<{RECORD.replace(' STRING', ': STRING').replace(' TIMESTAMP', ': TIMESTAMP')}>>"


@query("sc01_source_caches", "SELECT doc_id, source, text FROM documents")
def _(t):
    path = folder(t, "caches")
    record = F.struct(F.col("doc_id").cast("string").alias("sourceId"), F.col("source").alias("sourceName"), F.col("text").alias("payload"))
    caches = t.documents.groupBy("source", F.pmod("doc_id", F.lit(64)).alias("part"), F.expr("doc_id div 6400").alias("block")).agg(F.collect_list(record).alias("records"))  # a hundred records a cache
    caches.select(F.col("source").alias("sourceName"), "records").write.json(path)
    rows, _ = read_checked(t.spark, [path, f"{path}-absent"], CACHE, required=["sourceName"])
    r = rows.select(F.explode("records").alias("r")).select("r.*")
    return r.select(F.col("sourceId").cast("long").alias("doc_id"), F.col("sourceName").alias("source"), F.col("payload").alias("text"))


@query("sc01_read_errors", """
SELECT reason, count(*) AS records FROM (SELECT CASE WHEN doc_id % 9 = 0 THEN 'does not parse' WHEN doc_id % 9 = 1 THEN 'missing lang' END AS reason FROM documents) WHERE reason IS NOT NULL GROUP BY 1 UNION ALL SELECT 'absent', 1""")
def _(t):
    path = folder(t, "broken")
    line = F.to_json(F.struct("doc_id", F.when(F.col("doc_id") % 9 != 1, F.col("lang")).alias("lang")))
    t.documents.select(F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("{"), line)).otherwise(line).alias("value")).write.text(path)
    _, errors = read_checked(t.spark, [path, f"{path}-absent"], "doc_id LONG, lang STRING", required=["lang"])
    return errors.groupBy("reason").agg(F.count(F.lit(1)).alias("records"))


@query("sc02_derived_table", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer")
def _(t):
    path = folder(t, "derived")
    schema = "id LONG, name STRING, segment STRING"
    t.customer.select(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).write.json(path)
    rows, _ = read_checked(t.spark, [path], schema)
    optional = RD.read_table(t.spark, f"{path}-absent", schema, "json")  # an optional input that is not there
    return rows.unionByName(optional)


@query("sc08_license_master", "SELECT license_no, business_name, primary_status, county FROM licences")
def _(t):
    path = folder(t, "licences")
    names = {"LicenseNo": "license_no", "BusinessName": "business_name", "FullBusinessName": "full_business_name", "BusinessPhone": "business_phone", "PrimaryStatus": "primary_status", "City": "county", "County": "county", "MailingAddress": "business_name"}
    t.licences.select(*[F.col(c).alias(n) for n, c in names.items()]).write.csv(path, header=True, quote='"', escape='"')
    out = RD.read_license_master(t.spark, path)
    return out.select(F.col("LicenseNo").alias("license_no"), F.col("BusinessName").alias("business_name"), F.col("PrimaryStatus").alias("primary_status"), F.col("County").alias("county"))


@query("sk08_graph_export", PE + " SELECT type, count(*) AS edges, count(DISTINCT src) AS sources FROM e GROUP BY 1")
def _(t):
    path = folder(t, "graph")
    G.write_graph(*property_graph(t), path)
    return t.spark.read.parquet(f"{path}/edges").groupBy("type").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("src").alias("sources"))


@query("cl44_hypothesis_size", HYP_SQL + " SELECT package_size, members > 1 AS linked, count(*) AS hypotheses FROM h WHERE NOT (members = 1 AND package_size = 'small') AND NOT (members = 1 AND confidence < 0.4) GROUP BY 1, 2")
def _(t):
    return hypothesis_rows(t)[1].groupBy("package_size", (F.col("members") > 1).alias("linked")).agg(F.count(F.lit(1)).alias("hypotheses"))
