"""Registered queries: project and report scores (SM-01..05, SM-18..20, EX-18, CL-48, CL-54, NR-10, WN-08)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.base import q, query, rx, sql_hits, sql_multi
from plumbline.catalog.classify_permits import A_COLS, A_COLS4, A_TEXT, A_TEXT4, MONEY, STATUS_A, TYPE_A, or_general, with_status
from plumbline.catalog.classify_scope import placeholder
from plumbline.functions import text as X
from plumbline.operators.keyed import first_per_key
from plumbline.plans import opportunities as O
from plumbline.plans import permits as P
from plumbline.plans import vocab as V

# one row per (permit record, trade), with signal flags of the project
SIG = """SELECT project_seq, bool_or(signal_type = 'Permit') AS s_permit, bool_or(signal_type = 'Construction Start') AS s_start, bool_or(signal_type IN ('Planning Application', 'Subdivision Filing')) AS s_pipe,
  bool_or(signal_type = 'Rezoning') AS s_early, count(DISTINCT source) AS n_sources FROM signals GROUP BY 1"""
REASON_SQL = "least(5, " + " + ".join(f"CASE WHEN trade = {q(t)} AND {sql_hits('blob', terms)} > 0 THEN 1 ELSE 0 END" for t, terms, _, _ in V.TRADE_REASONS) + ")"
ROWS = f"""
WITH s AS ({SIG}), p AS (SELECT seq, {STATUS_A} AS status, {TYPE_A} AS ptype, {MONEY} * 300 AS amount, contractor, {A_TEXT4} AS blob, project_name, address, parcel_number, unnest(string_split({or_general(sql_multi(A_TEXT, V.PERMIT_A_TRADES))}, '|')) AS raw FROM permits_a),
u AS (SELECT DISTINCT * REPLACE (CASE WHEN raw IN ('Painting', 'Carpentry', 'General') THEN 'General' ELSE raw END AS raw) FROM p),
j AS (SELECT seq, raw AS trade, status, ptype, amount, contractor, blob, project_name, address, parcel_number, coalesce(s_permit, false) AS s_permit, coalesce(s_start, false) AS s_start, coalesce(s_pipe, false) AS s_pipe, coalesce(s_early, false) AS s_early, coalesce(n_sources, 0) AS n_sources,
  CAST(coalesce(contractor, '') <> '' AND contractor NOT IN ('Owner Builder', 'To Be Determined') AS INT) AS gc FROM u LEFT JOIN s ON project_seq = seq),
h AS (SELECT *, CASE WHEN status = 'Permitted' OR s_permit OR s_start THEN 'Fast Money' WHEN status = 'Approved' OR s_pipe THEN 'Pipeline' WHEN s_early THEN 'Early Signals' WHEN status IN ('Planning', 'Proposed') THEN 'Pipeline' ELSE 'Early Signals' END AS horizon,
  CASE WHEN coalesce(amount, 0) >= 150000000 THEN 'Mega Project' WHEN coalesce(amount, 0) >= 40000000 THEN 'Large' WHEN coalesce(amount, 0) >= 10000000 THEN 'Medium' ELSE 'Small' END AS size, {REASON_SQL} AS reasons FROM j)"""


def rows(t):
    from plumbline.functions import contacts as C

    sig = t.signals.groupBy(F.col("project_seq").alias("seq")).agg(F.collect_set("signal_type").alias("kinds"), F.count_distinct("source").alias("n_sources"))
    p = with_status(t).withColumn("ptype", P.project_type_a(P.blob(*A_COLS4))).withColumn("amount", X.parse_money("valuation") * 300).withColumn("blob", P.blob(*A_COLS4))
    p = p.withColumn("trade", F.explode(P.normalize_trades(P.permit_trades(P.blob(*A_COLS)))))
    p = p.join(sig, "seq", "left").withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>"))).withColumn("n_sources", F.coalesce("n_sources", F.lit(0)))
    p = p.withColumn("h", P.opportunity_horizon("status", F.col("kinds"))).withColumn("horizon", F.col("h.horizon")).withColumn("size", P.project_size(F.lit(0), "amount"))
    p = p.withColumn("reasons", F.size(O.trade_reasons("blob", "trade"))).withColumn("gc", C.is_source_backed("contractor").cast("int"))
    has = lambda *k: F.coalesce(F.arrays_overlap("kinds", F.array(*[F.lit(x) for x in k])), F.lit(False))
    return p.withColumn("planning", has(*V.PIPELINE_SIGNALS, *V.EARLY_SIGNALS)).withColumn("permit", F.lit(True))


@query("ex18_trade_reasons", ROWS + " SELECT seq, trade, reasons FROM h")
def _(t):
    return rows(t).select("seq", "trade", "reasons")


@query("sm01_opportunity_score", ROWS + """
SELECT seq, trade, horizon, greatest(0, least(100, 30 + CASE horizon WHEN 'Fast Money' THEN 20 WHEN 'Pipeline' THEN 12 ELSE 5 END + 15 + 10 + CASE WHEN s_pipe OR s_early THEN 12 ELSE 0 END + CASE size WHEN 'Mega Project' THEN 12 WHEN 'Large' THEN 9 ELSE 0 END
  + CASE WHEN trade = 'General' THEN -10 WHEN reasons > 1 THEN 12 WHEN reasons = 1 THEN 8 ELSE 3 END + CASE WHEN gc = 0 THEN 10 ELSE -8 END - CASE WHEN status = 'Completed' THEN 55 ELSE 0 END)) AS score FROM h""")
def _(t):
    r = rows(t)
    s = O.opportunity_score("horizon", "status", "size", "trade", "reasons", F.col("permit"), F.lit(True), F.col("planning"), "gc")
    return r.select("seq", "trade", "horizon", s["score"].alias("score"))


@query("sm01_factor_rows", ROWS + """
SELECT seq, trade, 6 + CAST(s_pipe OR s_early AS INT) + CAST(size IN ('Mega Project', 'Large') AS INT) + CASE WHEN status = 'Completed' THEN 2 ELSE 0 END AS factors FROM h""")
def _(t):
    s = O.opportunity_score("horizon", "status", "size", "trade", "reasons", F.col("permit"), F.lit(True), F.col("planning"), "gc")
    return rows(t).select("seq", "trade", F.size(s["factors"]).alias("factors"))


ONE = ROWS + ", o AS (SELECT DISTINCT seq, status, ptype, amount, size, gc, s_permit, s_start, s_pipe, s_early, n_sources, horizon, address, parcel_number, project_name, contractor FROM h)"


def projects(t):
    return first_per_key(rows(t), ["seq"], ["trade"])


FIT_SCORE = """greatest(0, least(100, 40 + CASE status WHEN 'Completed' THEN -30 ELSE 16 END + CASE size WHEN 'Mega Project' THEN 14 WHEN 'Large' THEN 10 ELSE 0 END + CASE WHEN ptype = 'Residential' AND seq % 60 >= 25 THEN 12 ELSE 0 END + CASE WHEN ptype = 'Commercial' THEN 8 ELSE 0 END
  + CASE WHEN ptype = 'Infrastructure' THEN 8 ELSE 0 END + CASE WHEN s_early OR s_pipe THEN 12 ELSE 0 END + CASE WHEN s_permit OR status = 'Permitted' THEN 7 ELSE 0 END + CASE WHEN gc = 0 THEN 10 ELSE -8 END))"""


@query("sm02_fit_score", ONE + f" SELECT seq, {FIT_SCORE} AS score FROM o")
def _(t):
    return projects(t).select("seq", fitted().alias("score"))


def fitted():
    return O.fit_score("status", "size", "ptype", F.col("seq") % 60, F.col("kinds"), "gc")["score"]


@query("sm03_confidence_breakdown", ONE + """
SELECT seq, 0.86::DOUBLE AS permit_evidence, CASE WHEN s_pipe OR s_early THEN 0.76::DOUBLE ELSE 0 END AS planning_evidence, least(0.95::DOUBLE, n_sources * 0.25::DOUBLE) AS source_agreement,
  CAST(least(95, 45 + CASE WHEN address <> '' THEN 15 ELSE 0 END + CASE WHEN parcel_number IS NOT NULL THEN 20 ELSE 0 END + 15 + CASE WHEN n_sources > 1 THEN 5 ELSE 0 END) AS DOUBLE) / 100 AS resolution FROM o""")
def _(t):
    b = O.confidence_breakdown(F.lit(1), F.col("planning"), F.lit(False), "n_sources")
    r = O.resolution_confidence(F.col("address") != "", F.when(F.col("parcel_number").isNotNull(), 1).otherwise(0), F.lit(1), "n_sources")
    return projects(t).select("seq", *[b[k].alias(k) for k in ("permit_evidence", "planning_evidence", "source_agreement")], r.alias("resolution"))


@query("sm04_structured_contacts", f"""
WITH a AS (SELECT opportunity_id AS project_id, company, nullif(phone, '') AS phone, nullif(email, '') AS email, CASE role WHEN 'Developer' THEN 'Developer' WHEN 'General Contractor' THEN 'General Contractor' WHEN 'Architect' THEN 'Architect' WHEN 'Engineer' THEN 'Engineer' ELSE 'Applicant' END AS role,
   CAST(CASE WHEN phone <> '' OR email <> '' THEN 0.78 ELSE 0.62 END AS DOUBLE) AS confidence, source, 0 AS part, contact_seq AS seq FROM contacts
 UNION ALL SELECT id, trim(contractor), NULL, NULL, CASE WHEN contains(lower(contractor), 'owner') THEN 'Property Owner' ELSE 'General Contractor' END, 0.74, 'County permits', 1, seq FROM opps WHERE coalesce(contractor, '') <> '' AND NOT {placeholder('contractor')})
SELECT project_id, company, role, confidence FROM a WHERE NOT {placeholder("concat_ws(' ', company, phone, email, source)")} QUALIFY row_number() OVER (PARTITION BY project_id, lower(company || '-' || role || '-' || source) ORDER BY part, seq) = 1""")
def _(t):
    none = F.lit(None).cast("string")
    companies = t.contacts.select(
        F.col("opportunity_id").alias("project_id"), F.col("company").alias("name"), F.when(F.col("role") == "General Contractor", "contractor").otherwise(F.lower("role")).alias("role"),
        F.nullif("phone", F.lit("")).alias("phone"), F.nullif("email", F.lit("")).alias("email"), none.alias("website"), F.col("source").alias("notes"), F.col("contact_seq").alias("seq"))
    sources = t.opps.select(F.col("id").alias("project_id"), "contractor", none.alias("agency"), F.lit("County permits").alias("source_name"), "source_url", "seq")
    return O.structured_contacts(companies, sources).select("project_id", "company", "role", "confidence")


@query("sm05_fast_money_score", ONE + """
SELECT seq, least(100, CASE horizon WHEN 'Fast Money' THEN 70 WHEN 'Pipeline' THEN 45 ELSE 25 END + CASE WHEN horizon = 'Fast Money' THEN 24 ELSE 0 END + CASE WHEN gc = 1 THEN 6 ELSE 0 END) AS fast_money,
  least(100, CASE WHEN gc = 1 THEN 45 ELSE 0 END + CASE WHEN n_sources > 0 THEN least(25, n_sources * 8) ELSE 0 END + 15 + CASE WHEN s_pipe OR s_permit THEN 10 ELSE 0 END + 5) AS access FROM o""")
def _(t):
    live = F.coalesce(F.arrays_overlap("kinds", F.array(*[F.lit(x) for x in ("Planning Application", "Subdivision Filing", "Permit")])), F.lit(False))
    return projects(t).select(
        "seq", O.fast_money_score("horizon", F.col("h.start_months"), F.col("h.completion_months"), F.col("gc") == 1).alias("fast_money"),
        O.project_access_score(F.col("gc") == 1, "n_sources", F.lit(True), live, F.lit(True)).alias("access"))


@query("cl54_next_action", ONE + """
SELECT seq, CASE WHEN horizon = 'Fast Money' AND coalesce(contractor, '') <> '' THEN 'Contact ' || contractor || ' and verify whether the trade package is still open.' WHEN horizon = 'Fast Money' THEN 'Pull the permit packet and identify the applicant, owner, or listed contractor.'
  WHEN horizon = 'Pipeline' THEN 'Save the opportunity, monitor permit conversion, and contact the developer before bid packages close.' ELSE 'Track parcel, planning, CEQA, and utility activity until a project application or permit appears.' END AS action FROM o""")
def _(t):
    return projects(t).select("seq", O.opportunity_action("horizon", "contractor").alias("action"))


@query("sm18_resolution_score", """
SELECT seq, CAST(least(100, 55 + CASE WHEN official_website IS NOT NULL THEN 12 ELSE 0 END + CASE WHEN phone IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN contact_page_url IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN plan_room_url IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN email IS NOT NULL THEN 25 ELSE 0 END) AS DOUBLE) / 100 AS score,
  3 + CAST(official_website IS NOT NULL AS INT) + CAST(phone IS NOT NULL AS INT) + CAST(contact_page_url IS NOT NULL AS INT) + CAST(plan_room_url IS NOT NULL AS INT) AS factors FROM web""")
def _(t):
    n = lambda c: F.col(c).isNotNull()
    s = O.resolution_score(F.lit(True), n("official_website"), F.lit(False), n("phone"), n("contact_page_url"), n("plan_room_url"), n("email"))
    return t.web.withColumn("s", s).select("seq", (F.col("s.score") / 100).alias("score"), F.size("s.factors").alias("factors"))


RR = " + ".join(f"CAST(trade = {q(t)} AND {rx('blob', p)} AS INT)" for t, p in O.REPORT_REASONS)
REPORT = ROWS + f""", r AS (SELECT *, {RR} AS rr, CASE WHEN status = 'Permitted' THEN 'Fast Money' WHEN status IN ('Planning', 'Approved', 'Proposed') THEN 'Pipeline' ELSE 'Early Signals' END AS rh, seq % 101 AS imp FROM h),
sc AS (SELECT *, CAST(least(95, 65 + CASE WHEN imp >= 80 THEN 15 ELSE 0 END + CASE WHEN rr > 0 THEN 15 ELSE 0 END + CASE WHEN gc = 1 THEN 5 ELSE 0 END) AS DOUBLE) / 100 AS conf,
  CASE rh WHEN 'Fast Money' THEN 25 WHEN 'Pipeline' THEN 15 ELSE 0 END + 10 + CASE WHEN trade <> 'General' THEN 10 ELSE 0 END + CASE WHEN gc = 1 THEN 8 ELSE 0 END + CAST(floor(imp / 10.0 + 0.5) AS INT) AS shared FROM r)"""


def reported(t):
    r = rows(t).withColumn("rr", O.report_reason_count("blob", "trade")).withColumn("imp", F.col("seq") % 101)
    r = r.withColumn("rh", O.report_horizon(F.lit("County"), "status", F.lit(""), []))
    return r.withColumn("conf", O.report_confidence(F.lit(True), "imp", "rr", F.col("gc") == 1))


@query("sm19_report_scores", REPORT + """
SELECT seq, trade, least(100, 40 + shared) AS summary_score, greatest(0, least(100, 35 + shared + CASE WHEN rr > 0 THEN 12 ELSE 0 END - CASE WHEN status = 'Completed' THEN 30 ELSE 0 END)) AS contractor_score, conf AS confidence FROM sc""")
def _(t):
    args = ("rh", "trade", F.lit(True), "rr", F.col("gc") == 1, "imp", "status")
    return reported(t).select("seq", "trade", O.report_score(*args, variant="summary").alias("summary_score"), O.report_score(*args).alias("contractor_score"), F.col("conf").alias("confidence"))


@query("cl48_false_positive_risk", REPORT + " SELECT seq, trade, CASE WHEN status = 'Completed' THEN 'High' WHEN rr = 0 OR conf < 0.65 THEN 'Medium' ELSE 'Low' END AS risk FROM sc")
def _(t):
    return reported(t).select("seq", "trade", O.false_positive_risk("status", "rr", "conf").alias("risk"))


@query("dq08_validation_summary", REPORT + """
SELECT rh AS horizon, trade, count(*) AS total, count(*) FILTER (gc = 1) AS with_contact, count(*) FILTER (amount > 0) AS with_value, count(*) FILTER (rr > 0) AS with_reasons FROM sc GROUP BY 1, 2""")
def _(t):
    from plumbline.operators.aggregate import conditional_counts

    r = reported(t).withColumn("horizon", F.col("rh"))
    return conditional_counts(r, {"with_contact": F.col("gc") == 1, "with_value": F.col("amount") > 0, "with_reasons": F.col("rr") > 0}, ["horizon", "trade"])


@query("sm20_contact_confidence", f"""
SELECT contact_seq, CAST(greatest(0, least(100, 45 + CASE WHEN phone <> '' THEN 15 ELSE 0 END + CASE WHEN email <> '' THEN 15 ELSE 0 END + CASE WHEN name <> '' THEN 10 ELSE 0 END - CASE WHEN {placeholder("concat_ws(' ', nullif(name, ''), nullif(phone, ''), nullif(email, ''), source)")} THEN 40 ELSE 0 END)) AS DOUBLE) / 100 AS audit,
  CAST(CASE WHEN company <> '' AND NOT {placeholder('company')} THEN least(90, 45 + 10 + CASE WHEN phone <> '' OR email <> '' THEN 25 ELSE 0 END + CASE WHEN role <> '' THEN 5 ELSE 0 END) ELSE 0 END AS DOUBLE) / 100 AS trust FROM contacts""")
def _(t):
    none = F.lit(None).cast("string")
    route = (F.col("phone") != "") | (F.col("email") != "")
    return t.contacts.select("contact_seq", O.audit_contact_confidence("name", "phone", "email", none, "source").alias("audit"), O.trust_contact_confidence("company", "source", route, "role").alias("trust"))


@query("nr10_evidence_panel", """
SELECT project_id, count(*) AS evidence, count(DISTINCT record_type) AS kinds, CAST(max(confidence) AS DOUBLE) AS top FROM (
  SELECT seq AS project_id, 'project' AS record_type, 0.72 AS confidence FROM permits_a UNION ALL SELECT seq, 'permit', 0.86 FROM permits_a UNION ALL SELECT project_seq, 'signal', greatest(0.35::DOUBLE, least(0.98::DOUBLE, importance_score / 100)) FROM signals
  UNION ALL SELECT seq, 'document', 0.76 FROM docs UNION ALL SELECT seq, 'source_record', 0.9 FROM permits_a) GROUP BY 1""")
def _(t):
    url = F.lit("https://county.test").alias("source_url")
    p = t.permits_a.select(F.col("seq").alias("project_id"), F.col("application").alias("id"), F.lit("County permits").alias("source_name"), url, F.col("project_name").alias("name"),
                           F.col("work_description").alias("description"), F.col("application_type").alias("permit_type"), F.col("application").alias("permit_number"),
                           F.col("application_status").alias("permit_status"), X.millis_to_date("applied_ms").cast("string").alias("permit_date"), F.col("project_name").alias("title"), F.col("work_description").alias("summary"))
    s = t.signals.select(F.col("project_seq").alias("project_id"), "id", "source", url, "signal_type", F.col("signal_type").alias("description"), "importance_score")
    d = t.docs.select(F.col("seq").alias("project_id"), "id", F.lit("page").alias("document_type"), url, F.col("project_name").alias("title"), F.lit(None).cast("string").alias("summary"))
    panel = O.evidence_panel(p, p, s, d, p)
    return panel.groupBy("project_id").agg(F.count(F.lit(1)).alias("evidence"), F.count_distinct("record_type").alias("kinds"), F.max("confidence").alias("top"))
