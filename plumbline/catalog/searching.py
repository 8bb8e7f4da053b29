"""Registered queries: search and ranking (SR-*, CL-49, FL-17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.scoring_projects import FIT_SCORE, ONE, fitted, projects
from plumbline.catalog.base import q, query, rx, sql_first, sql_hits, sql_multi
from plumbline.catalog.classify_permits import PLAN_TEXT, STAGE_TEXT
from plumbline.catalog.scalar import STOPS
from plumbline.functions import text as X
from plumbline.operators import search as S
from plumbline.plans import permits as P
from plumbline.plans import vocab as V

KW = "fencing jobs roseville"
KT = S.query_terms(KW, V.KEYWORD_SYNONYMS)
PCOLS = ["project_name", "project_description", "city", "county", "project_stage", "trade"]
PBLOB = "lower(concat_ws(' ', " + ", ".join(f"nullif({c}, '')" for c in PCOLS) + "))"


@query("sr01_keyword_search", f"""
WITH c AS (SELECT DISTINCT opp_seq AS seq FROM contacts WHERE {sql_hits("lower(company || ' ' || role)", KT)} > 0), s AS (SELECT DISTINCT project_seq AS seq FROM signals WHERE {sql_hits("lower(signal_type || ' ' || source)", KT)} > 0),
p AS (SELECT DISTINCT seq FROM permits_a WHERE {sql_hits("lower(application || ' ' || application_type || ' ' || application_status)", KT)} > 0)
SELECT seq, sc AS search_score FROM (SELECT o.seq, {sql_hits(PBLOB, KT)} * 3 + CASE WHEN c.seq IS NOT NULL THEN 4 ELSE 0 END + CASE WHEN s.seq IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN p.seq IS NOT NULL THEN 2 ELSE 0 END AS sc, applied_ms
 FROM opps o LEFT JOIN c ON c.seq = o.seq LEFT JOIN s ON s.seq = o.seq LEFT JOIN p ON p.seq = o.seq) WHERE sc > 0 ORDER BY sc DESC, applied_ms DESC, seq LIMIT 25""")
def _(t):
    part = lambda df, i, *cols: df.select(F.col(i).alias("seq"), F.concat_ws(" ", *cols).alias("text"))
    return S.keyword_search(
        t.opps, PCOLS, KW, 25, "seq", "applied_ms", companies=part(t.contacts, "opp_seq", "company", "role"), signals=part(t.signals, "project_seq", "signal_type", "source"),
        permits=part(t.permits_a, "seq", "application", "application_type", "application_status")).select("seq", "search_score")


def group_sql(entity, table, cols, key, k):
    blob = "lower(concat_ws(' ', " + ", ".join(f"nullif({c}, '')" for c in cols) + "))"
    return f"(SELECT {q(entity)} AS entity, CAST({key} AS VARCHAR) AS id, s AS score FROM (SELECT {key}, {sql_hits(blob, KT)} AS s FROM {table}) WHERE s > 0 ORDER BY s DESC, {key} LIMIT {k})"


GROUPS = [("project", "opps", PCOLS, "seq", 25), ("company", "web", ["company_name", "company_type"], "seq", 8), ("permit", "permits_a", ["application_type", "application_status"], "seq", 8), ("signal", "signals", ["signal_type", "source"], "seq", 12)]


@query("sr02_global_search", " UNION ALL ".join(group_sql(*g) for g in GROUPS))
def _(t):
    return S.global_search({e: (getattr(t, table), cols, key, k) for e, table, cols, key, k in GROUPS}, KW)


TFIDF = f"""
WITH tk AS (SELECT doc_id AS doc, list_filter(regexp_split_to_array(lower(source || ' ' || text), '[^a-z0-9]+'), lambda w: length(w) >= 2 AND w NOT IN ({STOPS})) AS t FROM documents),
cn AS (SELECT doc, len(t) AS len, unnest(t) AS token FROM tk), c AS (SELECT doc, len, token, count(*) AS n FROM cn GROUP BY 1, 2, 3), df AS (SELECT token, count(*) AS df FROM c GROUP BY 1), n AS (SELECT count(*) AS n FROM documents),
v AS (SELECT doc, token, c.n / len * (ln((n.n + 1) / (df.df + 1)) + 1) AS weight FROM c JOIN df USING (token), n)"""


@query("sr03_tfidf_index", TFIDF + " SELECT doc, count(*) AS terms, CAST(floor(max(weight) * 1000000 + 0.5) AS BIGINT) AS top_micro FROM v GROUP BY 1")
def _(t):
    vectors, _, _ = S.build_tfidf(t.documents, "doc_id", F.concat_ws(" ", "source", "text"))
    return vectors.groupBy("doc").agg(F.count(F.lit(1)).alias("terms"), F.floor(F.max("weight") * 1000000 + 0.5).alias("top_micro"))


WQ = "gate slide"


@query("sr04_weighted_text_search", """
SELECT seq, CAST(floor((g + s) * 10000 + 0.5) / 10000 AS DOUBLE) AS rank FROM (SELECT seq, greatest(CASE WHEN list_contains(a, 'gate') THEN 1.0 ELSE 0 END, CASE WHEN list_contains(b, 'gate') THEN 0.4 ELSE 0 END, CASE WHEN list_contains(c, 'gate') THEN 0.2 ELSE 0 END)::DOUBLE AS g,
  greatest(CASE WHEN list_contains(a, 'slide') THEN 1.0 ELSE 0 END, CASE WHEN list_contains(b, 'slide') THEN 0.4 ELSE 0 END, CASE WHEN list_contains(c, 'slide') THEN 0.2 ELSE 0 END)::DOUBLE AS s
 FROM (SELECT seq, regexp_split_to_array(lower(project_name), '[^a-z0-9]+') AS a, regexp_split_to_array(lower(project_description), '[^a-z0-9]+') AS b, regexp_split_to_array(lower(city), '[^a-z0-9]+') AS c FROM opps)) WHERE g > 0 AND s > 0 ORDER BY 2 DESC, 1 LIMIT 20""")
def _(t):
    return S.weighted_text_search(t.opps, {"project_name": "A", "project_description": "B", "city": "C"}, WQ, 20, "seq").select("seq", "rank")


HQ = "heron und erthan tion"
HTOK = [w for w in HQ.split()]
QW = f"(SELECT token, CAST(k AS DOUBLE) / {len(HTOK)} * coalesce((SELECT ln((n.n + 1) / (df.df + 1)) + 1 FROM df, n WHERE df.token = z.token), 0.5) AS w FROM (VALUES {', '.join(f'({q(w)}, 1)' for w in HTOK)}) z(token, k))"
HYBRID = TFIDF + f""", qw AS {QW}, qm AS (SELECT sqrt(sum(w * w)) AS m FROM qw),
sm AS (SELECT doc, sum(weight * coalesce(w, 0)) AS dot, sum(weight * weight) AS mag FROM v LEFT JOIN qw USING (token) GROUP BY 1),
sc AS (SELECT doc_id AS doc, coalesce(CASE WHEN mag > 0 THEN dot / (sqrt(mag) * m) END, 0) AS lex, {sql_hits("lower(source || ' ' || text)", [w for w in HTOK if len(w) > 2])} / {len(HTOK)} AS ph FROM documents LEFT JOIN sm ON sm.doc = doc_id, qm)"""


@query("sr05_semantic_search", HYBRID + " SELECT doc, CAST(floor((lex * 0.62::DOUBLE + ph * 0.1::DOUBLE) * 1000 + 0.5) / 1000 AS DOUBLE) AS score, CAST(floor(lex * 1000 + 0.5) / 1000 AS DOUBLE) AS lexical_score FROM sc WHERE NOT (lex * 0.62 + ph * 0.1 < 0.04 AND lex < 0.02) ORDER BY 2 DESC, 1 LIMIT 20")
def _(t):
    return S.semantic_search(t.documents, "doc_id", "source", "text", HQ, 20).select("doc", "score", "lexical_score")


@query("sr06_semantic_documents", "SELECT id, project_name AS title, concat_ws(' ', project_description, nullif(developer, ''), nullif(general_contractor, ''), trade, city, county) AS text, phone IS NOT NULL AS has_phone FROM opps")
def _(t):
    from plumbline.plans.research import semantic_documents

    return semantic_documents(t.opps, ["project_description", "developer", "general_contractor", "trade", "city", "county"], "phone").select("id", "title", "text", "has_phone")


LEADS = f"""
WITH b AS (SELECT *, trim(regexp_extract(address, ',\\s*([A-Za-z .''-]+),\\s*CA\\b', 1)) AS pcity, {sql_first(STAGE_TEXT, V.PLANNING_STAGES, 'unknown')} AS stage, CASE WHEN {rx(PLAN_TEXT, V.PACKAGE_SMALL)} AND NOT {rx(PLAN_TEXT, V.PACKAGE_SMALL_UNLESS)} THEN 'small' ELSE {sql_first(PLAN_TEXT, V.PACKAGE_HINTS, 'unknown')} END AS hint,
  list_distinct(list_concat(string_split({sql_multi(PLAN_TEXT, V.PLANNING_TRADES)}, '|'), CASE WHEN {rx(PLAN_TEXT, V.HOUSING_CUE)} THEN ['Fencing', 'Concrete', 'Site work', 'Landscaping'] ELSE [] END)) AS trades FROM planning),
l AS (SELECT *, lower(concat_ws(' ', nullif(title, ''), nullif(description, ''), pcity, jurisdiction, stage, hint, array_to_string(trades, ' '))) AS blob FROM b),
s AS (SELECT seq, hint, CASE hint WHEN 'development' THEN 28 WHEN 'commercial' THEN 18 ELSE 0 END + 10 + CASE WHEN contains(blob, 'placer') THEN 16 ELSE 0 END + CASE WHEN contains('fencing placer roseville planning', lower(pcity)) THEN 10 ELSE 0 END
  + CASE WHEN list_contains(trades, 'Fencing') THEN 24 WHEN contains(blob, 'fencing') THEN 12 ELSE 0 END + 3 * {sql_hits('blob', ['fencing', 'placer', 'roseville', 'planning'])} + CASE WHEN planner_phone <> '' THEN 8 WHEN planner_email <> '' THEN 4 ELSE 0 END AS relevance_score FROM l)"""


@query("sr07_planning_leads", LEADS + " SELECT seq, relevance_score FROM s WHERE relevance_score >= 20 ORDER BY relevance_score DESC, CASE hint WHEN 'development' THEN 3 WHEN 'commercial' THEN 2 ELSE 1 END DESC, seq LIMIT 12")
def _(t):
    return S.planning_leads(S.planning_rows(t.planning), "fencing placer roseville planning", "Fencing", 12, "seq").select("seq", "relevance_score")


ACC = "fence jobs sacramento"
AT = S.query_terms(ACC, V.ACCESS_SYNONYMS)
ACOLS = ["project_name", "project_location", "city", "county", "trade", "developer", "general_contractor", "procurement_route", "entry_method", "access_route", "opportunity_state", "evidence_quality"]
ABLOB = "lower(concat_ws(' ', " + ", ".join(f"nullif({c}, '')" for c in ACOLS) + "))"


@query("sr08_access_search", f"""
SELECT seq, s AS search_score FROM (SELECT seq, access_score, qualification_score, {sql_hits(ABLOB, AT)} * 6 + CASE WHEN fence_probability >= 50 THEN 30 ELSE 0 END + CASE WHEN regexp_matches(project_location || ' ' || county, 'sacramento', 'i') THEN 20 ELSE 0 END
  + CASE opportunity_state WHEN 'Actionable Opportunity' THEN 18 WHEN 'Research Required' THEN 10 ELSE 0 END + CAST(floor(access_score * 2 / 10 + 0.5) AS INT) + CAST(floor(qualification_score * 12 / 100 + 0.5) AS INT) AS s FROM opps) WHERE s > 0 ORDER BY s DESC, access_score DESC, qualification_score DESC, seq LIMIT 30""")
def _(t):
    return S.access_search(t.opps, ACOLS, ACC, 30, "seq").select("seq", "search_score")


@query("sr10_similar_items", """
SELECT seq, s AS similarity FROM (SELECT seq, 50 + CASE WHEN lower(city) = 'folsom' THEN 30 WHEN lower(county) = 'placer county' THEN 12 ELSE 0 END + CASE WHEN lower(project_stage) = 'planning' THEN 15 ELSE 0 END
 + least(25, 5 * (CAST(contains(lower(application_type), 'residential') AS INT) + CAST(contains(lower(application_type), 'building') AS INT))) AS s FROM opps WHERE trade = 'Roofing' AND seq <> 10) ORDER BY s DESC, seq LIMIT 4""")
def _(t):
    seed = {"seq": 10, "trade": "Roofing", "city": "Folsom", "county": "Placer County", "project_type": "Residential Building", "project_stage": "Planning"}
    return S.similar_items(t.opps.withColumn("project_type", F.col("application_type")), seed, 4, "seq").select("seq", "similarity")


@query("sr10_dense_similar", """
WITH s AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7), d AS (SELECT vec_id, list_sum(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::DOUBLE * e[i]::DOUBLE)) / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(e, lambda x: x::DOUBLE * x::DOUBLE)))) AS c FROM embeddings, s)
SELECT vec_id, CAST(floor(c * 1000 + 0.5) AS BIGINT) AS milli FROM d ORDER BY floor(c * 1000000 + 0.5) DESC, vec_id LIMIT 10""")
def _(t):
    seed = t.embeddings.filter("vec_id = 7").select("embedding").first()[0]
    return S.dense_search(t.embeddings, "vec_id", "embedding", seed, 10).select("vec_id", F.floor(F.col("score") * 1000 + 0.5).alias("milli"))


@query("sr12_assist_rank", ONE + f""", k AS (SELECT seq, s AS search_score FROM (SELECT seq, applied_ms, {sql_hits(PBLOB, KT)} * 3 AS s FROM opps) WHERE s > 0 ORDER BY s DESC, applied_ms DESC, seq LIMIT 8)
SELECT seq, search_score, {FIT_SCORE} AS fit_score FROM o JOIN k USING (seq) ORDER BY fit_score DESC, seq""")
def _(t):
    top = S.keyword_search(t.opps, PCOLS, KW, 8, "seq", "applied_ms").select("seq", "search_score")
    scored = projects(t).join(top, "seq").select("seq", "search_score", fitted().alias("fit_score"))
    return scored.orderBy(F.desc("fit_score"), "seq")


@query("cl49_query_terms", """
SELECT page_id, term FROM (SELECT DISTINCT page_id, unnest(list_filter(regexp_split_to_array(lower(url), '[^a-z0-9]+'), lambda w: length(w) >= 2)) AS term FROM pages) UNION SELECT page_id, s FROM (SELECT DISTINCT page_id, unnest(list_filter(regexp_split_to_array(lower(url), '[^a-z0-9]+'), lambda w: length(w) >= 2)) AS term FROM pages) t JOIN (VALUES ('http', 'https'), ('com', 'net'), ('fr', 'french')) a(k, s) ON k = term""")
def _(t):
    return S.terms_from_table(t.pages.select("page_id", "url"), "url", {"http": ["https"], "com": ["net"], "fr": ["french"]}).select("page_id", "term")


@query("fl17_metadata_filter", "SELECT seq FROM opps WHERE contains(lower(trade), 'electr') AND fast_money_potential = 'High' AND access_score >= 40 AND phone IS NOT NULL")
def _(t):
    o = t.opps.withColumn("has_phone", F.col("phone").isNotNull())
    return S.metadata_filter(o, {"trade": "Electr"}, {"fast_money_potential": "High"}, {"access_score": 40}, {"has_phone": True}).select("seq")
