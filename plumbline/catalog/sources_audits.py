"""Registered queries: extracts, normalisers, audits and windowed activity (SC-*, NR-*, DQ-*, CL-43, SS-02)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.base import q, query, rx, sql_first, sql_multi
from plumbline.catalog.classify_permits import A_STATUS_ROWS, A_TEXT, B_TEXT, MONEY, PLAN_TEXT, SIGNAL_A, STAGE_TEXT, STATUS_A, STATUS_B, TYPE_A, TYPE_B, or_general
from plumbline.catalog.classify_scope import placeholder
from plumbline.catalog.relational import V1
from plumbline.functions import contacts as C
from plumbline.functions import text as X
from plumbline.operators import audit as D
from plumbline.operators.aggregate import metric_rows
from plumbline.plans import companies as CO
from plumbline.plans import vocab as V
from plumbline.sources import imports as I
from plumbline.sources import normalize as N
from plumbline.sources import readers as RD
from plumbline.streaming.ingest import rolling_activity

DAY = "2001-08-01"


@query("sc03_permit_extract", f"SELECT o_orderkey, o_totalprice FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '{DAY}' - INTERVAL 12 MONTH AND o_totalprice >= 50000 ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def _(t):
    return RD.permit_extract(t.orders, "o_orderdate", "o_totalprice", DAY, 12, 50000, 50, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("sc04_keyword_extract", """
SELECT seq FROM permits_a WHERE upper(project_name) LIKE '%FENCE%' OR upper(project_name) LIKE '%GATE%' OR upper(work_description) LIKE '%FENCE%' OR upper(work_description) LIKE '%GATE%' UNION SELECT seq FROM (SELECT seq FROM permits_a ORDER BY applied_ms DESC, seq LIMIT 50)""")
def _(t):
    newest = t.permits_a.orderBy(F.desc("applied_ms"), "seq").limit(50).select("seq", "application")
    hits = t.permits_a.filter(RD.keyword_predicate(["project_name", "work_description"], ["FENCE", "GATE"])).select("seq", "application")
    return RD.merge_extracts(newest, hits, "application", ["seq"]).select("seq")


@query("sc05_newest_permits", "SELECT seq, number FROM permits_b ORDER BY objectid DESC LIMIT 75")
def _(t):
    return RD.newest_by(t.permits_b, "objectid", 75).select("seq", "number")


KW = ["fencing", "site work", "concrete", "roof", "HVAC", "electrical", "utility"]
NB = "lower(title || ' ' || description)"


@query("sc06_bid_notice_extract", f"""
SELECT notice_id, keyword FROM (SELECT *, {sql_first(NB, [(k, k.lower()) for k in KW])} AS keyword, CASE {' '.join(f"WHEN contains({NB}, {q(k.lower())}) THEN {i}" for i, k in enumerate(KW))} END AS p FROM notices WHERE CAST(posted_date AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-25')
WHERE keyword IS NOT NULL QUALIFY row_number() OVER (PARTITION BY notice_id ORDER BY p, seq) = 1""")
def _(t):
    n = t.notices.withColumn("body", F.concat_ws(" ", "title", "description"))
    return RD.bid_notice_extract(n, "body", "posted_date", KW, "2024-01-25", 20, "notice_id", "seq").select("notice_id", "keyword")


@query("sc07_planning_extract", "SELECT seq, 'a' AS layer FROM planning WHERE status <> 'Closed' AND status <> 'Withdrawn' UNION ALL SELECT seq, 'b' FROM planning WHERE status = 'Open' UNION ALL SELECT seq, 'major' FROM planning")
def _(t):
    p, s = t.planning, F.col("status")
    return RD.planning_extract({"a": (p, (s != "Closed") & (s != "Withdrawn")), "b": (p, s == "Open"), "major": (p, None)}).select("seq", "layer")


REGISTERED = [(f"src{i}", f"Source {i}", ("county", "city", "federal")[i % 3], f"https://src{i}.test", i % 5 != 0) for i in range(16)]


@query("sc11_source_registry", "WITH r(id, name, source_type, url, active) AS (VALUES " + ", ".join(f"({q(a)}, {q(b)}, {q(c)}, {q(u)}, {str(v).lower()})" for a, b, c, u, v in REGISTERED) + """)
SELECT coalesce(r.id, n.source) AS id, r.name, r.source_type, r.url, r.active, coalesce(n.records, 0) AS records FROM r FULL JOIN (SELECT source, count(*) AS records FROM documents GROUP BY 1) n ON n.source = r.id""")
def _(t):
    registry = RD.source_registry(t.spark, REGISTERED)
    records = t.documents.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("records"))
    return registry.join(records, "id", "full").select("id", "name", "source_type", "url", "active", F.coalesce("records", F.lit(0)).alias("records"))


@query("sc12_source_metadata", "SELECT source, max(signal_date) AS last_captured, count(*) AS records FROM signals GROUP BY 1")
def _(t):
    return RD.source_metadata(t.signals, "signal_date", "source")


@query("nr01_normalize_permit_a", f"""
SELECT seq, 'sac-' || lower(application) AS id, {TYPE_A} AS project_type, status, amount AS value, {SIGNAL_A} AS signal_type, {or_general(sql_multi(A_TEXT, V.PERMIT_A_TRADES))} AS trades,
  CASE WHEN coalesce(contractor, '') <> '' AND NOT {placeholder('contractor')} THEN contractor END AS company FROM {A_STATUS_ROWS}""")
def _(t):
    n = N.normalize_permit_a(t.permits_a, "2001-08-01")
    return n.select("seq", F.col("project.id").alias("id"), "project.project_type", "project.status", F.col("project.estimated_value").alias("value"), "signal.signal_type", F.array_join("inferred_trades", "|").alias("trades"), F.col("contact_company.name").alias("company"))


@query("nr02_normalize_permit_b", f"""
SELECT seq, 'placer-' || lower(number) || '-' || CAST(objectid AS VARCHAR) AS id, {TYPE_B} AS project_type, {STATUS_B} AS project_status, {or_general(sql_multi(B_TEXT, V.PERMIT_B_TRADES))} AS trades, CASE WHEN jurisdiction <> 'Placer County' THEN jurisdiction ELSE 'Placer County' END AS city FROM permits_b""")
def _(t):
    n = N.normalize_permit_b(t.permits_b, "2001-08-01")
    return n.select("seq", F.col("project.id").alias("id"), "project.project_type", F.col("project.status").alias("project_status"), F.array_join("inferred_trades", "|").alias("trades"), "project.city")


@query("nr03_normalize_notice", f"""
SELECT seq, 'samgov-' || lower(notice_id) AS id, json_extract_string(place_json, '$.city.name') AS city, {sql_first("lower(title || ' ' || description || ' ' || notice_type)", V.TRADE_SUBSTRINGS_NOTICE, 'General')} AS trade,
  concat_ws(' - ', title, notice_type, nullif(agency_path, '')) AS description, nullif(agency_path, '') AS agency FROM notices""")
def _(t):
    n = N.normalize_notice(t.notices, "2024-01-31")
    return n.select("seq", F.col("project.id").alias("id"), "project.city", F.get("inferred_trades", F.lit(0)).alias("trade"), "project.description", F.col("contact_company.name").alias("agency"))


@query("nr04_normalize_generic", """
SELECT seq, coalesce(nullif(title, ''), 'Unnamed project') AS name, coalesce(nullif(description, ''), 'No description provided by source.') AS description, CASE WHEN entitlement <> '' THEN 1 ELSE 0 END AS signals FROM planning""")
def _(t):
    p = t.planning.withColumn("name", F.col("title")).withColumn("project_type", F.lit("")).withColumn("state", F.lit("")).withColumn("estimated_value", F.lit("")).withColumn("signal_type", F.col("entitlement"))
    p = p.withColumn("signal_date", F.lit("")).withColumn("importance_score", F.lit(None).cast("int"))
    return N.normalize_generic(p, "2024-01-01").select("seq", "name", "description", F.coalesce(F.size("signals"), F.lit(0)).alias("signals"))


NOISY = rx("title || ' ' || description || ' ' || entitlement || ' ' || status || ' ' || address", V.PLANNING_NOISE)


@query("nr05_normalize_planning", f"""
SELECT seq, title, stage, package_hint FROM (SELECT seq, jurisdiction, cap_number, coalesce(nullif(title, ''), cap_number) AS title, {sql_first(STAGE_TEXT, V.PLANNING_STAGES, 'unknown')} AS stage,
  CASE WHEN {rx(PLAN_TEXT, V.PACKAGE_SMALL)} AND NOT {rx(PLAN_TEXT, V.PACKAGE_SMALL_UNLESS)} THEN 'small' ELSE {sql_first(PLAN_TEXT, V.PACKAGE_HINTS, 'unknown')} END AS package_hint FROM planning WHERE NOT {NOISY})
QUALIFY row_number() OVER (PARTITION BY jurisdiction, lower(cap_number) ORDER BY seq) = 1""")
def _(t):
    return N.dedupe_planning(N.normalize_planning(t.planning, "a")).select("seq", "title", "stage", "package_hint")


@query("nr06_run_collector", "SELECT seq FROM planning WHERE applicant <> ''")
def _(t):
    return N.run_collector(t.planning, lambda d: d.select("seq", F.nullif("applicant", F.lit("")).alias("developer")), "developer").select("seq")


@query("nr07_explode_records", f"SELECT 'projects' AS view, count(*) AS rows FROM permits_a UNION ALL SELECT 'permits', count(*) FROM permits_a UNION ALL SELECT 'signals', count(*) FROM permits_a UNION ALL SELECT 'evidence', count(*) FROM permits_a")
def _(t):
    views = N.explode_records(N.normalize_permit_a(t.permits_a, "2001-08-01"))
    rows = [df.groupBy(F.lit(name).alias("view")).agg(F.count("id").alias("rows")) for name, df in views.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query("nr08_project_detail", f"""
SELECT 'sac-app-' || CAST(p.seq AS VARCHAR) AS project_id, (SELECT count(*) FROM contacts c WHERE c.opp_seq = p.seq AND NOT {placeholder('c.company')}) AS companies_count, (SELECT count(*) FROM signals s WHERE s.project_seq = p.seq) AS signals_count,
  coalesce((SELECT string_agg(c.company, '|' ORDER BY c.company, c.role) FROM contacts c WHERE c.opp_seq = p.seq AND NOT {placeholder('c.company')}), '') AS companies FROM permits_a p""")
def _(t):
    v = N.explode_records(N.normalize_permit_a(t.permits_a, "2001-08-01"))
    sig = t.signals.withColumn("project_id", F.concat(F.lit("sac-app-"), F.col("project_seq").cast("string")))
    com = t.contacts.select(F.col("opportunity_id").alias("project_id"), F.col("company").alias("name"), "role")
    return N.project_detail(v["projects"].select("id", "name"), v["permits"], sig, com).select("project_id", "companies_count", "signals_count", F.coalesce(F.array_join(F.col("companies.name"), "|"), F.lit("")).alias("companies"))


@query("nr09_source_documents", "SELECT 'sac-app-' || CAST(seq AS VARCHAR) AS id, 'permit_record' AS source_type FROM permits_a UNION ALL SELECT 'opportunity-source-' || id, 'opportunity_record' FROM opps")
def _(t):
    return N.source_documents(N.normalize_permit_a(t.permits_a, "2001-08-01"), t.opps).select("id", "source_type")


@query("nr11_import_coercion", f"SELECT seq, coalesce(nullif(trim(project_name), ''), '') AS name, coalesce({MONEY}, 0) AS value FROM permits_a")
def _(t):
    d = t.permits_a.select("seq", F.col("project_name").alias("name"), F.col("valuation").alias("estimated_value"))
    return I.coerce_import(d).select("seq", "name", F.coalesce("estimated_value", F.lit(0.0)).alias("value"))


@query("nr12_contact_company", f"SELECT seq, 'sac-company-' || regexp_replace(regexp_replace(lower(contractor), '[^a-z0-9]+', '-', 'g'), '(^-|-$)', '', 'g') AS id FROM permits_a WHERE coalesce(contractor, '') <> '' AND NOT {placeholder('contractor')}")
def _(t):
    n = N.normalize_permit_a(t.permits_a, "2001-08-01")
    return n.filter("contact_company IS NOT NULL").select("seq", F.col("contact_company.id").alias("id"))


@query("nr13_evidence_refs", "SELECT opportunity_id, string_agg(source || ': ' || company, '|' ORDER BY contact_seq) AS refs FROM contacts GROUP BY 1")
def _(t):
    c = t.contacts.select("opportunity_id", F.col("contact_seq").alias("seq"), F.col("source").alias("source_name"), F.col("company").alias("title"))
    return N.evidence_ref(c, "opportunity_id").select("opportunity_id", F.array_join("refs", "|").alias("refs"))


# --- audits -----------------------------------------------------------------------------------------
DK = V1.format("concat_ws(' ', nullif(project_name, ''), contractor)")


@query("dq01_duplicate_audit", f"SELECT count(*) AS groups, count(*) FILTER (n > 1) AS duplicate_groups, sum(n - 1)::BIGINT AS collapsed FROM (SELECT {DK} AS k, count(*) AS n FROM opps GROUP BY 1)")
def _(t):
    return D.duplicate_audit(t.opps, X.normalize_name_v1(F.concat_ws(" ", F.nullif("project_name", F.lit("")), "contractor")))


@query("dq01_duplicate_texts", "SELECT min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
def _(t):
    d = t.documents.withColumn("k", F.sha2("text", 256))
    return d.groupBy("k").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("first_doc", "copies")


@query("dq02_completeness", f"""
SELECT 'total' AS metric, count(*) AS value FROM opps UNION ALL SELECT 'missing_contact', count(*) FILTER (phone IS NULL AND email IS NULL AND website IS NULL) FROM opps UNION ALL SELECT 'missing_name', count(*) FILTER (project_name = '') FROM opps
UNION ALL SELECT 'placeholder', count(*) FILTER ({placeholder("concat_ws(' ', contractor, contact_name)")}) FROM opps""")
def _(t):
    none = F.col("phone").isNull() & F.col("email").isNull() & F.col("website").isNull()
    return D.completeness(t.opps, {"missing_contact": none, "missing_name": F.col("project_name") == "", "placeholder": C.is_placeholder("contractor", "contact_name")})


@query("dq02_placeholder_rows", f"SELECT seq FROM planning WHERE {placeholder('''planner_email || ' ' || planner_phone || ' ' || applicant''')}")
def _(t):
    return D.placeholder_rows(t.planning, ["planner_email", "planner_phone", "applicant"]).select("seq")


AUTH = f"CASE WHEN seq % 5 = 0 THEN 'Public Agency' WHEN coalesce(contractor, '') <> '' AND NOT {placeholder('contractor')} THEN 'General Contractor Candidate' WHEN seq % 7 = 0 THEN 'Public Agency Candidate' ELSE 'Unknown' END"
AVAIL = f"""CASE WHEN regexp_matches(application_status, 'final|complete', 'i') THEN 'Likely Awarded' WHEN coalesce(contractor, '') <> '' AND NOT {placeholder('contractor')} AND regexp_matches(application_status, 'issued|permitted|under construction', 'i') THEN 'Likely Awarded'
  WHEN regexp_matches(application_status, 'submitted|review|received|planning|proposed|approved', 'i') AND evidence_count >= 2 AND trade <> 'General' THEN 'Likely Available' ELSE 'Unknown' END"""


def audited(t):
    o = t.opps
    agency = F.when(F.col("seq") % 5 == 0, "City of Folsom")
    o = o.withColumn("authority", D.awarding_authority(agency, "contractor", F.lit("contractor"), F.when(F.col("seq") % 7 == 0, "Government")))
    o = o.withColumn("availability", D.package_availability("trade", "evidence_count", F.lit(""), "application_status", "contractor"))
    contact = F.col("phone").isNotNull()
    return o.withColumn("trust_missing", D.trust_failures(F.col("project_name") != "", F.lit(True), F.col("evidence_count") > 0, contact, "authority", (F.col("evidence_count") >= 2) & (F.col("trade") != "General")))


@query("cl43_authority_availability", f"SELECT seq, {AUTH} AS authority, {AVAIL} AS availability FROM opps")
def _(t):
    return audited(t).select("seq", "authority", "availability")


MISS = f"""concat_ws('|', CASE WHEN project_name = '' THEN 'Missing project identity' END, CASE WHEN evidence_count = 0 THEN 'Missing source evidence' END, CASE WHEN phone IS NULL THEN 'No actionable contact route' END,
  CASE WHEN {AUTH} = 'Unknown' THEN 'Unknown awarding authority' END, CASE WHEN NOT (evidence_count >= 2 AND trade <> 'General') THEN 'Insufficient package availability evidence' END)"""


@query("dq03_trust_audit", f"SELECT seq, {MISS} AS missing FROM opps")
def _(t):
    return audited(t).select("seq", F.array_join("trust_missing", "|").alias("missing"))


@query("dq04_coverage_views", f"""
SELECT 'total' AS metric, count(*) AS value FROM opps UNION ALL SELECT 'visible', count(*) FILTER ({MISS} = '') FROM opps UNION ALL SELECT 'hidden', count(*) FILTER ({MISS} <> '') FROM opps UNION ALL SELECT 'authority_known', count(*) FILTER ({AUTH} <> 'Unknown') FROM opps UNION ALL SELECT 'no_contact_route', count(*) FILTER (phone IS NULL) FROM opps""")
def _(t):
    return D.coverage_views(audited(t))


@query("dq05_company_coverage", """
SELECT 'total' AS metric, count(*) AS value FROM web UNION ALL SELECT 'with_website', count(official_website) FROM web UNION ALL SELECT 'with_contact_page', count(contact_page_url) FROM web UNION ALL SELECT 'with_bid_route', count(*) FILTER (bid_opportunities_page_url IS NOT NULL OR plan_room_url IS NOT NULL OR vendor_registration_page_url IS NOT NULL OR trade_partner_portal_url IS NOT NULL) FROM web""")
def _(t):
    n = lambda c: F.col(c).isNotNull()
    p = CO.company_profiles(t.web, F.lit(1))
    return metric_rows(p, {"with_website": n("official_website"), "with_contact_page": n("contact_page_url"),
                           "with_bid_route": n("bid_opportunities_page_url") | n("plan_room_url") | n("vendor_registration_page_url") | n("trade_partner_portal_url")})


@query("dq06_contact_baseline", """
SELECT o.fencing_signal_presence AS fencing, count(*) AS total, count(phone) AS with_phone, count(email) AS with_email, CAST(floor(count(phone) * 1000.0::DOUBLE / count(*) + 0.5) / 10 AS DOUBLE) AS pct_phone FROM opps o GROUP BY 1""")
def _(t):
    g = t.opps.groupBy(F.col("fencing_signal_presence").alias("fencing")).agg(F.count(F.lit(1)).alias("total"), F.count("phone").alias("with_phone"), F.count("email").alias("with_email"))
    return g.withColumn("pct_phone", X.pct(F.col("with_phone"), F.col("total")))


@query("dq07_repeated_candidates", "SELECT project_name, trade, count(*) AS documents FROM opps GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return D.repeated_candidates(t.opps, ["project_name", "trade"])


@query("fl20_document_errors", "SELECT doc_id, 'duplicate id' AS errors FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 1")
def _(t):
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("id"), F.lit("A title").alias("title"), F.lit("https://county.test/x").alias("source_url"))
    return I.document_errors(d).select("doc_id", F.array_join("errors", "|").alias("errors"))


@query("sc09_import_mapping", "SELECT c_name AS name, c_mktsegment AS project_type, 'CA' AS state FROM customer")
def _(t):
    raw = t.customer.select(F.col("c_name").alias("Project Name"), F.col("c_mktsegment").alias("Project_Type"))
    return I.coerce_import(I.map_columns(raw, {"name": "Project Name"})).select("name", "project_type", "state")


# --- rolling activity ------------------------------------------------------------------------------------
@query("ss02_rolling_activity", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rolling_activity(e, "ts", "event_type").select(F.to_date("window_start").cast("string").alias("day"), "event_type", "n")


@query("ss01_batch_dedupe", "SELECT notice_id, min(seq) AS first_seq FROM notices GROUP BY 1")
def _(t):
    from plumbline.operators.keyed import first_per_key

    return first_per_key(t.notices, ["notice_id"], ["seq"]).select("notice_id", F.col("seq").alias("first_seq"))
