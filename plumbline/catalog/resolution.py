"""Registered queries: entity resolution, linkage and graphs (ER-*, GR-*, JN-09, JN-10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.aggregates import PATHS_SQL
from plumbline.catalog.base import q, query, rx
from plumbline.catalog.scalar import RAISE, strip
from plumbline.catalog.relational import RELATION
from plumbline.functions import text as X
from plumbline.operators import extract as E
from plumbline.operators import graph as G
from plumbline.operators import resolve as R
from plumbline.operators.relational import dealt
from plumbline.plans import companies as CO
from plumbline.plans import vocab as V
from plumbline.session import ensure_checkpoint_dir

N3 = lambda e: strip(e, X.SUFFIXES_V3)
TITLE = lambda e: f"regexp_replace(regexp_replace({RAISE.format(f'lower(trim({e}))')}, '\\bLlc\\b', 'LLC', 'g'), '\\bInc\\b\\.?', 'Inc.', 'g')"


@query("er01_resolve_names", f"""
WITH k AS (SELECT {N3('business_name')} AS norm, min_by(business_name, seq) AS known_name, min(seq) AS known_seq FROM licences GROUP BY 1 HAVING {N3('business_name')} <> ''),
n AS (SELECT name, {N3('name')} AS norm FROM (SELECT DISTINCT applicant AS name FROM planning WHERE applicant <> '' UNION SELECT DISTINCT p_name || ' ' || lower(p_type) FROM part UNION SELECT DISTINCT company_name FROM web)),
c AS (SELECT name, known_name, known_seq, levenshtein(n.norm, k.norm) AS d FROM n JOIN k ON abs(length(n.norm) - length(k.norm)) <= greatest(2, length(n.norm) * 12 // 100) WHERE levenshtein(n.norm, k.norm) <= greatest(2, length(n.norm) * 12 // 100)),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY name ORDER BY d, known_seq) = 1)
SELECT n.name, {TITLE('coalesce(b.known_name, n.name)')} AS canonical, d AS distance, CAST(CASE WHEN d = 0 THEN 0.98 WHEN d IS NOT NULL THEN 0.82 ELSE 0.72 END AS DOUBLE) AS confidence FROM n LEFT JOIN b USING (name)""")
def _(t):
    names = t.planning.filter("applicant <> ''").select(F.col("applicant").alias("name")).union(
        t.part.select(F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("name"))).union(t.web.select(F.col("company_name").alias("name"))).distinct()
    return R.resolve_names(names, t.licences, known_name="business_name")


def atoms(t):
    """Entities of the planning records: developer, subdivision and parcel."""
    t.customer = dealt(t.customer, "c_custkey")
    p = t.planning.withColumn("none", F.lit(None).cast("string"))
    e = E.research_entities(p, "seq", "title", "description", "applicant", "none", "none", "none", "none").select("seq", "type", "canonical", "norm", "confidence")
    parcel = p.select("seq", F.lit("parcel").alias("type"), F.col("apn").alias("canonical"), X.normalize_entity_name("apn").alias("norm"), F.lit(0.9).alias("confidence"))
    return e.filter(F.col("type").isin("developer", "subdivision")).unionByName(parcel).withColumnRenamed("seq", "key")


ENTS = f"""
WITH raw AS (SELECT seq AS key, 'developer' AS type, applicant AS value, 0.9::DOUBLE AS confidence FROM planning UNION ALL
  SELECT seq, 'subdivision', CASE WHEN {rx("title || ' ' || description", V.ENTITY_SUBDIVISION_CUE)} THEN trim(coalesce(nullif(regexp_extract(title || ' ' || description, {q(V.ENTITY_VILLAGE)}, 0), ''), nullif(regexp_extract(title || ' ' || description, {q(V.ENTITY_SUBDIVISION)}, 0), ''))) END, 0.72 FROM planning
  UNION ALL SELECT seq, 'parcel', apn, 0.9 FROM planning),
ents AS (SELECT DISTINCT key, type, {N3('trim(value)')} AS norm, confidence FROM raw WHERE value IS NOT NULL AND trim(value) <> '' AND {N3('trim(value)')} <> ''),
d AS (SELECT DISTINCT type, norm, confidence, list_distinct(string_split(norm, ' ')) AS tk FROM ents),
pw AS (SELECT a.type, a.norm AS an, a.confidence AS ac, b.norm AS bn, b.confidence AS bc, CASE WHEN a.norm = b.norm THEN least(0.99::DOUBLE, 0.85::DOUBLE + a.confidence * 0.07::DOUBLE + b.confidence * 0.07::DOUBLE) ELSE
   least(0.98::DOUBLE, (CASE WHEN contains(a.norm, b.norm) OR contains(b.norm, a.norm) THEN greatest(j * 0.7::DOUBLE, 0.82::DOUBLE) ELSE j * 0.7::DOUBLE END + 0.08::DOUBLE) * ((a.confidence + b.confidence) / 2 + 0.15::DOUBLE)) END AS weight
  FROM (SELECT a, b, len(list_intersect(a.tk, b.tk)) / len(list_distinct(list_concat(a.tk, b.tk))) AS j FROM d a JOIN d b ON a.type = b.type) AS z)"""


@query("er02_pair_weight", """
SELECT seq, CAST(floor(CASE WHEN a = '' OR b = '' THEN 0 WHEN a = b THEN least(0.99::DOUBLE, 0.85::DOUBLE + 0.9::DOUBLE * 0.07::DOUBLE + 0.86::DOUBLE * 0.07::DOUBLE) ELSE least(0.98::DOUBLE, (CASE WHEN contains(a, b) OR contains(b, a) THEN greatest(j * 0.7::DOUBLE, 0.82::DOUBLE) ELSE j * 0.7::DOUBLE END + 0.08::DOUBLE) * ((0.9::DOUBLE + 0.86::DOUBLE) / 2 + 0.15::DOUBLE)) END * 10000 + 0.5) AS BIGINT) AS weight
FROM (SELECT seq, a, b, len(list_intersect(list_distinct(string_split(a, ' ')), list_distinct(string_split(b, ' ')))) / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' ')))) AS j FROM (SELECT seq, """ + N3("applicant") + " AS a, " + N3("owner") + " AS b FROM planning))")
def _(t):
    p = t.planning.select("seq", X.normalize_entity_name("applicant").alias("a"), X.normalize_entity_name("owner").alias("b"))
    return p.select("seq", F.floor(R.pair_weight("a", "b", F.lit(0.9), F.lit(0.86), F.lit(True)) * 10000 + 0.5).alias("weight"))


def distinct_entities(t):
    e = atoms(t).filter("norm <> ''").select("type", "norm", "confidence").distinct()
    e = e.withColumn("eid", F.sha2(F.concat_ws("|", "type", "norm", F.col("confidence").cast("string")), 256))
    # each block of the links reads it again, so it is written once
    ensure_checkpoint_dir(t.spark)
    return e.checkpoint()


@query("er03_link_entities", ENTS + " SELECT type, an, bn, CAST(floor(weight * 10000 + 0.5) AS BIGINT) AS weight FROM pw WHERE an < bn AND weight >= 0.55".replace("FROM pw", "FROM pw"))
def _(t):
    e = distinct_entities(t)
    links = R.link_entities(e)
    side = lambda s: e.select(F.col("eid").alias(s), F.col("type").alias(f"{s}t"), F.col("norm").alias(f"{s}n"))
    j = links.join(side("a"), "a").join(side("b"), "b").filter(F.col("an") != F.col("bn"))
    return j.select(F.col("at").alias("type"), F.least("an", "bn").alias("an"), F.greatest("an", "bn").alias("bn"), F.floor(F.col("weight") * 10000 + 0.5).alias("weight"))


# records meet through their entities; weak links count per pair of records, so the check pairs the few records that have any
CLUSTERS = ENTS + """,
strong AS (SELECT DISTINCT ea.key AS a, 'x' || pw.type || pw.bn AS b FROM ents ea JOIN pw ON pw.type = ea.type AND pw.an = ea.norm AND pw.ac = ea.confidence WHERE weight >= 0.78),
wk AS (SELECT ea.key AS a, eb.key AS b, count(*) AS n, max(weight) AS w FROM pw JOIN ents ea ON ea.type = pw.type AND ea.norm = an AND ea.confidence = ac JOIN ents eb ON eb.type = pw.type AND eb.norm = bn AND eb.confidence = bc WHERE weight >= 0.55 AND weight < 0.78 GROUP BY 1, 2),
ed AS (SELECT CAST(a AS VARCHAR) AS s, b AS t FROM strong UNION SELECT b, CAST(a AS VARCHAR) FROM strong UNION SELECT CAST(a AS VARCHAR), CAST(b AS VARCHAR) FROM wk WHERE n >= 2 AND w >= 0.62 UNION SELECT CAST(b AS VARCHAR), CAST(a AS VARCHAR) FROM wk WHERE n >= 2 AND w >= 0.62),
nodes AS (SELECT CAST(seq AS VARCHAR) AS node, seq AS label FROM planning UNION ALL SELECT DISTINCT b, 9000000000000 FROM strong),"""
CLUSTERS = CLUSTERS.replace("WITH raw", "WITH RECURSIVE raw", 1) + """
cc(node, label) USING KEY (node) AS (SELECT node, label FROM nodes UNION SELECT e.t, min(cc.label) FROM cc JOIN ed e ON e.s = cc.node JOIN recurring.cc AS cur ON cur.node = e.t WHERE cc.label < cur.label GROUP BY e.t)"""


@query("er05_cluster_records", CLUSTERS + " SELECT CAST(node AS BIGINT) AS key, label AS cluster FROM cc WHERE node NOT LIKE 'x%'")
def _(t):
    keys = t.planning.select(F.col("seq").alias("key"))
    return R.cluster_records(atoms(t), keys)


@query("er04_linked_record_count", CLUSTERS + " SELECT count(*) AS records, count(DISTINCT label) AS clusters FROM cc WHERE node NOT LIKE 'x%'")
def _(t):
    keys = t.planning.select(F.col("seq").alias("key"))
    return R.cluster_records(atoms(t), keys).agg(F.count(F.lit(1)).alias("records"), F.count_distinct("cluster").alias("clusters"))


@query("er05_duplicate_document_components", """
SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS component FROM documents""")
def _(t):
    # documents are tied to the hash of their text, so copies form a star, not a clique
    edges = t.documents.select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 15, "0")).alias("src"), F.concat(F.lit("t"), F.sha2("text", 256)).alias("dst"))
    comp = R.connected_components(edges).filter(F.col("node").startswith("d"))
    number = lambda c: F.substr(c, F.lit(2)).cast("bigint")
    return comp.select(number("node").alias("doc_id"), number("component").alias("component"))


HYP_SQL = CLUSTERS + f""", lab AS (SELECT CAST(node AS BIGINT) AS key, label AS cluster FROM cc WHERE node NOT LIKE 'x%'),
m AS (SELECT l.cluster, count(*) AS members, bool_or({rx("title || ' ' || description", R.COMMERCIAL_CUES)}) AS com, bool_or({rx("title || ' ' || description", R.SMALL_CUES)}) AS sm, count(DISTINCT split_part(entitlement, ' ', 1)) FILTER (entitlement <> '') AS trades FROM planning p JOIN lab l ON l.key = p.seq GROUP BY 1),
en AS (SELECT l.cluster, count(DISTINCT norm) FILTER (type = 'developer') AS devs, count(DISTINCT norm) FILTER (type = 'subdivision') AS subs FROM ents JOIN lab l USING (key) GROUP BY 1),
h AS (SELECT cluster, members, coalesce(devs, 0) AS devs, coalesce(subs, 0) AS subs, CASE WHEN coalesce(subs, 0) > 0 THEN 'development' WHEN com THEN 'commercial' WHEN members >= 3 THEN 'commercial' WHEN sm THEN 'small' WHEN members > 1 THEN 'commercial' ELSE 'unknown' END AS package_size,
  CAST(least(97, 28 + least(35, members * 8) + CASE WHEN coalesce(devs, 0) > 0 THEN 18 ELSE 0 END + CASE WHEN coalesce(subs, 0) > 0 THEN 20 ELSE 0 END + CASE WHEN trades >= 2 THEN 8 ELSE 0 END + 10) AS DOUBLE) / 100 AS confidence FROM m LEFT JOIN en USING (cluster))"""


def hypothesis_parts(t):
    """(records, entities, clusters): the inputs of a hypothesis; the records are linked once."""
    e = atoms(t)
    clusters = R.cluster_records(e, t.planning.select(F.col("seq").alias("key")))
    word = F.split("entitlement", " ")[0]
    a = t.planning.select(F.col("seq").alias("key"), "title", F.concat_ws(" ", "title", "description").alias("text"), F.lit("c").alias("city"), F.lit("c").alias("county"),
                          F.when(F.col("entitlement") != "", F.array(word)).otherwise(F.array().cast("array<string>")).alias("trades"))
    return a, e, clusters


def hypothesis_rows(t):
    parts = hypothesis_parts(t)
    return parts[0], R.hypotheses(*parts)


VALUES_SQL = HYP_SQL + """, vals AS (SELECT cluster, kind, value, min(key) AS first_key FROM (
  SELECT key, type AS kind, trim(value) AS value FROM raw WHERE type IN ('developer', 'subdivision') AND trim(coalesce(value, '')) <> ''
  UNION ALL SELECT seq, 'city', 'c' FROM planning UNION ALL SELECT seq, 'county', 'c' FROM planning UNION ALL SELECT seq, 'member', CAST(seq AS VARCHAR) FROM planning
  UNION ALL SELECT seq, 'trade', split_part(entitlement, ' ', 1) FROM planning WHERE entitlement <> '') JOIN lab USING (key) GROUP BY 1, 2, 3)"""


@query("er06_hypothesis_values", VALUES_SQL + " SELECT cluster, kind, lower(value) AS value, first_key FROM vals")
def _(t):
    return hypothesis_lists(t).withColumn("value", F.lower("value"))


def hypothesis_lists(t):
    return R.hypothesis_values(*hypothesis_parts(t))


TOP = lambda kind, n: f"(SELECT string_agg(value, ', ' ORDER BY first_key, value) FROM (SELECT * FROM vals v WHERE v.cluster = h.cluster AND v.kind = {q(kind)} ORDER BY first_key, value LIMIT {n}))"


@query("er06_hypothesis_why", VALUES_SQL + f""" SELECT cluster, lower(coalesce(nullif(concat_ws('|', CASE WHEN members > 1 THEN members || ' linked public-record breadcrumbs reinforce the same package.' END, 'Developer signal: ' || dv || '.', 'Subdivision / community cue: ' || sb || '.', 'Trade breadcrumbs: ' || td || '.',
  CASE WHEN package_size = 'development' THEN 'Looks like a housing / development package worth early pursuit.' END), ''), 'Single-source signal with extractable entities.')) AS why
FROM (SELECT *, {TOP('developer', 2)} AS dv, {TOP('subdivision', 2)} AS sb, {TOP('trade', 4)} AS td FROM h WHERE NOT (members = 1 AND package_size = 'small') AND NOT (members = 1 AND confidence < 0.4))""")
def _(t):
    parts = hypothesis_parts(t)
    return R.hypothesis_reasons(R.hypotheses(*parts), R.hypothesis_values(*parts)).select("cluster", F.lower(F.array_join("why", "|")).alias("why"))


@query("er06_hypotheses", HYP_SQL + " SELECT cluster, members, package_size, confidence FROM h WHERE NOT (members = 1 AND package_size = 'small') AND NOT (members = 1 AND confidence < 0.4)")
def _(t):
    return hypothesis_rows(t)[1].select("cluster", "members", "package_size", "confidence")


@query("er07_atoms", f"""
SELECT 'atom:' || id AS id, concat_ws(' ', nullif(project_name, ''), project_description) AS text FROM opps UNION ALL SELECT 'atom:planning:' || cap_number || '-' || CAST(seq AS VARCHAR), concat_ws(' ', nullif(title, ''), nullif(description, ''), nullif(applicant, ''), nullif(status, '')) FROM planning""")
def _(t):
    from plumbline.plans.research import opportunity_atoms, planning_atoms

    o = opportunity_atoms(t.opps, ["project_name", "project_description"])
    p = planning_atoms(t.planning.withColumn("pid", F.concat_ws("-", "cap_number", F.col("seq").cast("string"))), "pid", ["title", "description", "applicant", "status"])
    return o.select("id", "text").unionByName(p.select("id", "text"))


@query("er08_snapshot", HYP_SQL + " SELECT 'atoms' AS metric, (SELECT count(*) FROM planning) AS value UNION ALL SELECT 'hypotheses', count(*) FROM h WHERE NOT (members = 1 AND package_size = 'small') AND NOT (members = 1 AND confidence < 0.4)")
def _(t):
    return R.snapshot(*hypothesis_rows(t))


LN = lambda e: f"trim(regexp_replace(regexp_replace(regexp_replace(replace(lower({e}), '&', ' and '), '[^a-z0-9\\s]', ' ', 'g'), {q(X.SUFFIXES_V4)}, ' ', 'g'), '\\s+', ' ', 'g'))"
TOK = lambda e: f"list_filter(string_split({e}, ' '), lambda w: length(w) > 1 AND w NOT IN ('and', 'of', 'dba'))"
LIC = f"""
WITH tg AS (SELECT DISTINCT name, {LN('name')} AS k, {TOK(LN('name'))} AS tk FROM (SELECT DISTINCT applicant AS name FROM planning WHERE applicant <> '')),
lc AS (SELECT license_no, full_business_name AS cand, primary_status, county FROM licences UNION ALL SELECT license_no, business_name, primary_status, county FROM licences),
ck AS (SELECT *, {LN('cand')} AS ck, string_split({LN('cand')}, ' ') AS words FROM lc),
ex AS (SELECT name, tk, license_no, cand, words, primary_status, county, true AS exact FROM tg JOIN ck ON k = ck),
fz AS (SELECT name, tk, license_no, cand, words, primary_status, county, false AS exact FROM tg JOIN (SELECT * FROM ck WHERE ck NOT IN (SELECT k FROM tg)) c ON list_has_all(c.words, tk) WHERE len(tk) >= 2 AND NOT (len(tk) = 2 AND len(list_filter(tk, lambda w: length(w) > 5)) = 0) AND NOT (len(tk) <= 2 AND len(list_distinct(c.words)) - len(tk) >= 2)),
al AS (SELECT *, CASE WHEN exact THEN 100 ELSE 70 END + least(20, length(array_to_string(tk, ' '))) + CASE WHEN regexp_matches(primary_status, 'CLEAR', 'i') THEN 15 ELSE 0 END + CASE WHEN regexp_matches(county, 'sacramento|placer|el dorado|yolo|sutter|butte', 'i') THEN 20 ELSE 0 END
  - CASE WHEN len(words) - len(tk) > 3 THEN 10 ELSE 0 END AS score FROM (SELECT * FROM ex UNION ALL SELECT * FROM fz))"""


@query("jn09_license_candidates", LIC + " SELECT DISTINCT name, license_no, cand AS candidate, exact FROM al")
def _(t):
    targets = t.planning.filter("applicant <> ''").select(F.col("applicant").alias("name"))
    return R.license_candidates(targets, t.licences, "name", ["full_business_name", "business_name"], "license_no").select("name", "license_no", "candidate", "exact").distinct()


@query("er09_match_licenses", LIC + " SELECT name, license_no, score FROM al QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, license_no, cand) = 1")
def _(t):
    targets = t.planning.filter("applicant <> ''").select(F.col("applicant").alias("name"))
    return R.match_licenses(targets, t.licences, "name", ["full_business_name", "business_name"], "license_no", "primary_status", "county").select("name", "license_no", "score")


PK = lambda e: strip(e, X.PROJECT_KEY_NOISE, " ")
MT = lambda e: f"list_distinct(list_filter(regexp_split_to_array(lower({e}), '[^a-z0-9]+'), lambda w: length(w) > 3 AND w NOT IN ('area', 'solar', 'digital', 'submittal', 'paper', 'review')))"


@query("jn10_match_evidence", f"""
WITH i AS (SELECT DISTINCT project_name, {PK('project_name')} AS k, {MT('project_name')} AS tk FROM opps), d AS (SELECT DISTINCT title AS d_name, status AS title, {PK('title')} AS dk, {MT("title || ' ' || status")} AS dt FROM planning),
s AS (SELECT project_name, d_name, title, len(list_intersect(tk, dt)) AS overlap, CASE WHEN k = dk AND k <> '' THEN 80 ELSE 0 END + len(list_intersect(tk, dt)) * 8 + CASE WHEN length(project_name) > 4 AND contains(lower(d_name || ' ' || title), lower(project_name)) THEN 24 ELSE 0 END AS score FROM i, d)
SELECT * FROM s WHERE score >= 20 AND overlap > 0""")
def _(t):
    ids = t.opps.select("project_name", X.project_key("project_name").alias("norm_key"))
    docs = t.planning.select(F.col("title").alias("project_name"), F.col("status").alias("title"), X.project_key("title").alias("norm_key"))
    return R.match_evidence(ids, docs).filter("overlap > 0").select("project_name", "d_name", "title", "overlap", "score")


# --- graphs ------------------------------------------------------------------------------------
def property_graph(t):
    projects = t.permits_a.select(F.col("application").alias("id"), F.col("project_name").alias("name"), X.infer_city("address").alias("city"), F.lit("Sacramento County").alias("county"), "address", "seq")
    companies = t.facts.select(F.concat(F.lit("APP-"), F.col("project_seq").cast("string")).alias("project_id"), F.col("company_name").alias("name"),
                               F.when(F.col("company_type") == "Developer", "developer").when(F.col("company_type") == "Architect", "architect").otherwise("contractor").alias("role"), F.col("project_seq").alias("seq"))
    permits = t.permits_a.select(F.col("application").alias("project_id"), F.col("application").alias("id"), F.col("application").alias("number"), "seq")
    signals = t.signals.select(F.concat(F.lit("APP-"), F.col("project_seq").cast("string")).alias("project_id"), "id", F.col("signal_type").alias("kind"), "source", "seq")
    trades = t.facts.select(F.concat(F.lit("APP-"), F.col("project_seq").cast("string")).alias("project_id"), "trade", F.col("project_seq").alias("seq"))
    return G.property_graph(projects, companies, permits, signals, trades)


SLUG = lambda e: f"regexp_replace(regexp_replace(lower({e}), '[^a-z0-9]+', '-', 'g'), '(^-|-$)', '', 'g')"
CITY = "(CASE WHEN len(ps) >= 2 THEN coalesce(nullif(trim(regexp_replace(ps[2], '\\s+CA\\s+\\d+.*', '')), ''), 'Sacramento') ELSE 'Sacramento' END)"
CK = "CASE WHEN company_type = 'Developer' THEN 'Developer:' ELSE 'Company:' END || " + SLUG("company_name")
PE = f"""
WITH p AS (SELECT *, list_filter(list_transform(string_split(address, ','), lambda x: trim(x)), lambda x: x <> '') AS ps FROM permits_a),
e AS (SELECT DISTINCT src, type, dst FROM (SELECT 'Project:' || {SLUG('application')} AS src, 'LOCATED_IN' AS type, 'City:' || {SLUG(CITY)} AS dst FROM p UNION ALL SELECT 'Project:' || {SLUG('application')}, 'LOCATED_IN', 'County:sacramento-county' FROM p
 UNION ALL SELECT 'Project:' || {SLUG('application')}, 'LOCATED_IN', 'Property:' || {SLUG('address')} FROM p UNION ALL SELECT 'Project:' || {SLUG('application')}, 'REFERENCES', 'Permit:' || {SLUG('application')} FROM p
 UNION ALL SELECT {CK}, CASE WHEN company_type = 'Architect' THEN 'DESIGNED' ELSE 'INVOLVED_IN' END, 'Project:app-' || CAST(project_seq AS VARCHAR) FROM facts UNION ALL SELECT {CK}, 'OWNS', 'Project:app-' || CAST(project_seq AS VARCHAR) FROM facts WHERE company_type = 'Developer'
 UNION ALL SELECT 'Project:app-' || CAST(project_seq AS VARCHAR), 'REFERENCES', 'Document:' || id FROM signals UNION ALL SELECT 'Agency:' || {SLUG('source')}, 'DISCOVERED_FROM', 'Project:app-' || CAST(project_seq AS VARCHAR) FROM signals
 UNION ALL SELECT 'Project:app-' || CAST(project_seq AS VARCHAR), 'REQUIRES', 'Trade:' || {SLUG('trade')} FROM facts))"""


@query("gr01_property_graph_edges", PE + " SELECT split_part(src, ':', 1) AS src_kind, type, split_part(dst, ':', 1) AS dst_kind, count(*) AS edges FROM e GROUP BY ALL")
def _(t):
    edges = property_graph(t)[1]
    kind = lambda c: F.substring_index(c, ":", 1)
    return edges.groupBy(kind("src").alias("src_kind"), "type", kind("dst").alias("dst_kind")).agg(F.count(F.lit(1)).alias("edges"))


@query("gr01_property_graph_nodes", PE + """ SELECT split_part(id, ':', 1) AS type, count(*) AS nodes FROM (SELECT src AS id FROM e UNION SELECT dst FROM e) WHERE NOT (id LIKE 'Project:%' AND NOT EXISTS (SELECT 1 FROM permits_a WHERE 'Project:' || regexp_replace(lower(application), '[^a-z0-9]+', '-', 'g') = id)) GROUP BY 1""")
def _(t):
    return property_graph(t)[0].groupBy("type").agg(F.count(F.lit(1)).alias("nodes"))


@query("gr02_graph_insights", PE + """, r AS (SELECT src AS id, count(*) AS n, 'Repeat developer or company' AS title FROM e WHERE type IN ('INVOLVED_IN', 'OWNS', 'DESIGNED') GROUP BY 1 HAVING count(*) >= 3 UNION ALL SELECT dst, count(*), 'Common trade pattern' FROM e WHERE type = 'REQUIRES' GROUP BY 1 HAVING count(*) >= 5)
SELECT id, n, title, least(100, CASE WHEN title LIKE 'Repeat%' THEN 50 + n * 8 ELSE 45 + n * 3 END) AS score FROM r""")
def _(t):
    return G.graph_insights(*property_graph(t)).select("id", "n", "title", "score")


@query("gr03_entities_with_projects", PE + " SELECT src AS id, count(*) AS projects FROM e WHERE type IN ('INVOLVED_IN', 'OWNS', 'DESIGNED') GROUP BY 1 HAVING count(*) >= 4")
def _(t):
    return G.entities_with_projects(*property_graph(t), at_least=4).select("id", "projects")


@query("gr03_common_trades", PE + " SELECT dst AS id, count(*) AS count FROM e WHERE type = 'REQUIRES' GROUP BY 1")
def _(t):
    out = G.common_trades(*property_graph(t))
    return out.select(F.concat(F.lit("Trade:"), X.slug("trade")).alias("id"), "count")


@query("gr03_active_in_county", PE + " SELECT DISTINCT src AS id FROM e WHERE type IN ('INVOLVED_IN', 'OWNS') AND dst IN (SELECT src FROM e WHERE type = 'LOCATED_IN' AND dst = 'County:sacramento-county')")
def _(t):
    return G.active_in_county(property_graph(t)[1], "Sacramento County")


@query("gr03_verified_contacts", "SELECT DISTINCT opportunity_id AS id FROM contacts WHERE confidence >= 0.65")
def _(t):
    e = t.contacts.select(F.lit("INVOLVED_IN").alias("type"), F.col("opportunity_id").alias("dst"), F.col("confidence").alias("contact_confidence"))
    return G.projects_with_verified_contacts(e)


OBS = f"""
WITH m AS (SELECT project_id, company_id, company_type, min(seen_at) AS seen_at, min(source_url) AS url FROM facts GROUP BY 1, 2, 3),
o AS (SELECT * FROM (SELECT a.company_id AS src, b.company_id AS dst, {RELATION} AS type, a.project_id, a.url, least(a.seen_at, b.seen_at) AS seen_at, CAST(floor((60 + a.company_id % 30)) AS BIGINT) AS cents FROM m a JOIN m b ON a.project_id = b.project_id AND a.company_id <> b.company_id) WHERE type IS NOT NULL),
ed AS (SELECT src, dst, type, count(DISTINCT project_id || url) AS relationship_count, count(DISTINCT project_id) AS project_count, min(seen_at) AS first_seen, max(seen_at) AS last_seen, CAST(floor(sum(cents) / count(*) + 0.5) / 100 AS DOUBLE) AS confidence FROM o GROUP BY 1, 2, 3)"""


def relation_observations(t):
    m = t.facts.groupBy("project_id", "company_id", "company_type").agg(F.min("seen_at").alias("seen_at"), F.min("source_url").alias("source_url"))
    pairs = CO.project_pairs(t.facts)
    info = lambda s: m.select("project_id", F.col("company_id").alias(f"{s}_company_id"), F.col("seen_at").alias(f"{s}_seen"), F.col("source_url").alias(f"{s}_url"))
    o = pairs.join(info("a"), ["project_id", "a_company_id"]).join(info("b"), ["project_id", "b_company_id"])
    obs = o.select(F.col("a_company_id").alias("src"), F.col("b_company_id").alias("dst"), F.col("relation").alias("type"), F.col("project_id").alias("project_name"), F.col("a_url").alias("source_url"),
                   F.lit(1).alias("evidence_count"), ((F.lit(60) + F.col("a_company_id") % 30) / 100).alias("confidence"), F.least("a_seen", "b_seen").alias("seen_at"), F.lit(0).alias("seq"))
    return obs


def relation_edges(t):
    return G.relationship_edges(relation_observations(t))


@query("gr04_relationship_edges", OBS + " SELECT * FROM ed")
def _(t):
    return relation_edges(t).select("src", "dst", "type", "relationship_count", "project_count", "first_seen", "last_seen", "confidence")


@query("gr04_edge_projects", OBS + " SELECT src, dst, type, project_id AS project_name, max(url) AS source_url FROM o GROUP BY 1, 2, 3, 4")
def _(t):
    return G.relationship_edge_projects(relation_observations(t))


@query("gr04_edge_urls", OBS + " SELECT DISTINCT src, dst, type, url AS source_url FROM o")
def _(t):
    return G.relationship_edge_urls(relation_observations(t))


@query("gr04_relationship_nodes", "SELECT company_id AS id, company_type AS type, count(*) AS evidence_count, min(seen_at) AS first_seen, max(seen_at) AS last_seen FROM facts GROUP BY 1, 2")
def _(t):
    obs = t.facts.select(F.col("company_id").alias("id"), F.col("company_type").alias("type"), F.col("company_name").alias("name"), F.lit(1).alias("evidence_count"), F.lit(1).alias("project_count"),
                         F.lit(0.7).alias("confidence"), "seen_at", F.col("project_seq").alias("seq"))
    return G.relationship_nodes(obs).select("id", "type", "evidence_count", "first_seen", "last_seen")


@query("gr05_node_degrees", OBS + " SELECT id, sum(relationship_count)::BIGINT AS relationship_count FROM (SELECT src AS id, relationship_count FROM ed UNION ALL SELECT dst, relationship_count FROM ed) GROUP BY 1")
def _(t):
    return G.node_degrees(relation_edges(t))


@query("fl24_org_edges", OBS + " SELECT src, dst, type FROM ed WHERE project_count > 1")
def _(t):
    return G.repeated_edges(relation_edges(t)).select("src", "dst", "type")


@query("cl40_project_relation", """
SELECT DISTINCT company_id, CASE company_type WHEN 'Developer' THEN 'project_developer' WHEN 'General Contractor' THEN 'project_gc' WHEN 'Architect' THEN 'project_architect' WHEN 'Engineer' THEN 'project_engineer' ELSE 'project_company' END AS relation FROM facts""")
def _(t):
    return t.facts.select("company_id", CO.project_relation("company_type").alias("relation")).distinct()


@query("cl41_outsourcing_status", """
SELECT company_id, CASE WHEN n = 0 THEN 'Unknown' WHEN company_type = 'Developer' AND n >= 3 THEN 'Frequently Outsources' WHEN company_type = 'Developer' THEN 'Sometimes Outsources' WHEN company_type = 'General Contractor' AND n >= 8 THEN 'Self Performs' WHEN company_type = 'General Contractor' AND n >= 3 THEN 'Rarely Outsources' ELSE 'Unknown' END AS status
FROM (SELECT company_id, company_type, count(DISTINCT project_id) % 11 AS n FROM facts GROUP BY 1, 2)""")
def _(t):
    g = t.facts.groupBy("company_id", "company_type").agg((F.count_distinct("project_id") % 11).alias("n"))
    return g.select("company_id", CO.outsourcing_status("company_type", "n").alias("status"))


@query("cl51_path_value", f"SELECT seq, path_type, CASE WHEN path_type = 'general_contact' THEN 'No' ELSE 'Yes' END AS answer FROM ({PATHS_SQL})")
def _(t):
    p = CO.procurement_paths(t.web, "seq")
    return p.select("seq", "path_type", CO.value_answer("contractor_value").alias("answer"))


@query("fl19_valid_paths", """
SELECT seq, path_url FROM (SELECT seq, CASE seq % 4 WHEN 0 THEN 'bid_portal' WHEN 1 THEN 'mystery' WHEN 2 THEN 'trade_partner' ELSE 'general_contact' END AS path_type, official_website AS path_url, CASE seq % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Low' ELSE 'None' END AS v FROM web) WHERE path_type <> 'mystery' AND v <> 'None' AND path_url IS NOT NULL""")
def _(t):
    m = F.col("seq")
    p = t.web.select("seq", F.when(m % 4 == 0, "bid_portal").when(m % 4 == 1, "mystery").when(m % 4 == 2, "trade_partner").otherwise("general_contact").alias("path_type"), F.col("official_website").alias("path_url"),
                     F.when(m % 3 == 0, "High").when(m % 3 == 1, "Low").otherwise("None").alias("contractor_value"), F.lit(1.4).alias("confidence"))
    return CO.valid_paths(p).select("seq", "path_url")
