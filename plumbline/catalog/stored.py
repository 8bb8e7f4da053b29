"""Registered queries on stored tables: search index, snapshot writes, streaming state (SR-03, SR-05, SK-01, SS-01, SS-02)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.catalog.base import q, query, sql_hits
from plumbline.catalog.scalar import STOPS
from plumbline.catalog.searching import TFIDF
from plumbline.operators.search_index import SearchIndex
from plumbline.session import ensure_checkpoint_dir
from plumbline.sources.snapshots import Snapshots
from plumbline.streaming import ingest as S


def folder(t, name: str) -> str:
    """A new shared folder for the tables of one run."""
    return f"{ensure_checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("sr03_stored_index", TFIDF + " SELECT doc, count(*) AS terms, CAST(floor(max(weight) * 1000000 + 0.5) AS BIGINT) AS top_micro, CAST(floor(sqrt(sum(weight * weight)) * 1000000 + 0.5) AS BIGINT) AS magnitude_micro FROM v GROUP BY 1")
def _(t):
    index = SearchIndex(t.spark, folder(t, "index"))
    index.add(t.documents, "doc_id", "source", "text")
    micro = lambda c: F.floor(c * 1000000 + 0.5)
    return index.norms().select("doc", "terms", micro(F.col("top")).alias("top_micro"), micro(F.col("magnitude")).alias("magnitude_micro"))


FQ = "roofing permit summit"
OPP_TEXT = "concat_ws(' ', project_description, nullif(developer, ''), nullif(general_contractor, ''), trade, city, county)"


def filtered_sql(trade: str, where: str, query_text: str = FQ) -> str:
    terms = query_text.split()
    meta = " + ".join(f"CASE WHEN contains(lower(coalesce({c}, '')), {q(query_text)}) THEN {p} ELSE 0 END" for c, p in (("city", 0.2), ("county", 0.15), ("trade", 0.25), ("project_stage", 0.1)))
    return f"""
WITH src AS (SELECT *, project_name || ' ' || {OPP_TEXT} AS whole FROM opps),
tk AS (SELECT seq AS doc, list_filter(regexp_split_to_array(lower(whole), '[^a-z0-9]+'), lambda w: length(w) >= 2 AND w NOT IN ({STOPS})) AS t FROM src),
cn AS (SELECT doc, len(t) AS len, unnest(t) AS token FROM tk), c AS (SELECT doc, len, token, count(*) AS n FROM cn GROUP BY 1, 2, 3), df AS (SELECT token, count(*) AS df FROM c GROUP BY 1), n AS (SELECT count(*) AS n FROM src),
v AS (SELECT doc, token, c.n / len * (ln((n.n + 1) / (df.df + 1)) + 1) AS weight FROM c JOIN df USING (token), n),
qw AS (SELECT token, CAST(1 AS DOUBLE) / {len(terms)} * coalesce((SELECT ln((n.n + 1) / (df.df + 1)) + 1 FROM df, n WHERE df.token = z.token), 0.5) AS w FROM (VALUES {', '.join(f'({q(w)})' for w in terms)}) z(token)), qm AS (SELECT sqrt(sum(w * w)) AS m FROM qw),
sm AS (SELECT doc, sum(weight * coalesce(w, 0)) AS dot, sqrt(sum(weight * weight)) AS mag FROM v LEFT JOIN qw USING (token) GROUP BY 1),
sc AS (SELECT seq AS doc, coalesce(dot / (mag * m), 0) AS lex, least(1.0, {0.35 if trade else 0} + {meta})::DOUBLE AS meta, {sql_hits('lower(whole)', [w for w in terms if len(w) > 2])} / {len(terms)} AS ph
 FROM src LEFT JOIN sm ON sm.doc = seq, qm WHERE {where})
SELECT doc, CAST(floor((lex * 0.62::DOUBLE + meta * 0.28::DOUBLE + ph * 0.1::DOUBLE) * 1000 + 0.5) / 1000 AS DOUBLE) AS score, CAST(floor(lex * 1000 + 0.5) / 1000 AS DOUBLE) AS lexical_score, CAST(floor(meta * 1000 + 0.5) / 1000 AS DOUBLE) AS metadata_score
FROM sc WHERE NOT (lex * 0.62 + meta * 0.28 + ph * 0.1 < 0.04 AND lex < 0.02) ORDER BY 2 DESC, 1 LIMIT 20"""


def opportunity_index(t) -> SearchIndex:
    index = SearchIndex(t.spark, folder(t, "opp-index"))
    docs = t.opps.withColumn("_text", F.concat_ws(" ", "project_description", F.nullif("developer", F.lit("")), F.nullif("general_contractor", F.lit("")), "trade", "city", "county")).withColumn("_phone", F.col("phone").isNotNull())
    index.add(docs, "seq", "project_name", "_text", {"trade": "trade", "city": "city", "county": "county", "stage": "project_stage", "package_size": "fast_money_potential", "valuation": "qualification_score", "has_phone": "_phone"})
    return index


@query("sr05_filtered_search", filtered_sql("roof", "contains(lower(trade), 'roof') AND contains(lower(county), 'placer') AND contains(lower(project_stage), 'a') AND qualification_score >= 40 AND phone IS NOT NULL"))
def _(t):
    hits = opportunity_index(t).search(FQ, 20, {"trade": "Roof", "county": "placer", "stage": "A"}, minimum={"valuation": 40}, flags={"has_phone": True})
    return hits.select("doc", "score", "lexical_score", "metadata_score")


@query("sr05_city_query", filtered_sql("", "fast_money_potential = 'High' AND phone IS NULL", "folsom"))
def _(t):
    return opportunity_index(t).search("folsom", 20, equals={"package_size": "High"}, flags={"has_phone": False}).select("doc", "score", "lexical_score", "metadata_score")


@query("sk01_rewrite_own_table", "SELECT c_custkey AS id, c_mktsegment AS segment, 3 AS seen, c_acctbal > 0 AS positive FROM customer")
def _(t):
    table = Snapshots(t.spark, folder(t, "table"))
    table.write(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.lit(1).alias("seen")))
    table.write(table.read().withColumn("seen", F.col("seen") + 1))  # reads what it replaces
    table.write(table.read().withColumn("seen", F.col("seen") + 1).join(t.customer.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 0).alias("positive")), "id"))
    return table.read()


@query("ss01_compacted_ingest", "SELECT event_id AS id, event_type, CAST(floor(value) AS BIGINT) AS value FROM events")
def _(t):
    table = Snapshots(t.spark, folder(t, "ingest"))
    stream = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    rows = lambda df: df.select(F.col("event_id").alias("id"), "event_type", F.floor("value").cast("long").alias("value"), F.col("ts").cast("timestamp").alias("ts"))
    S.ingest_compacted(stream, rows, "id", "ts", "365 days", table, folder(t, "ingest-checkpoint")).awaitTermination()
    return S.newest_rows(table, "id").select("id", "event_type", "value")


@query("ss02_recent_activity", "SELECT event_id AS id, event_type, epoch_us(CAST(ts AS TIMESTAMP)) AS at_us FROM events ORDER BY at_us DESC, id LIMIT 25")
def _(t):
    table = Snapshots(t.spark, folder(t, "recent"))
    stream = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    rows = stream.select(F.col("event_id").alias("id"), "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))
    sink = S.recent_sink(table, "id", [F.desc("at_us"), F.asc("id")])
    rows.writeStream.foreachBatch(sink).option("checkpointLocation", folder(t, "recent-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return table.read("recent")
