"""Registered queries: permit, notice and planning classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.base import q, query, rx, sql_first, sql_multi
from plumbline.functions import text as X
from plumbline.plans import permits as P
from plumbline.plans import vocab as V

A_TEXT = "lower(application_type || ' ' || application_subtype || ' ' || project_name || ' ' || activity_code || ' ' || work_description)"
A_TEXT4 = "lower(application_type || ' ' || application_subtype || ' ' || project_name || ' ' || work_description)"
A_COLS = ["application_type", "application_subtype", "project_name", "activity_code", "work_description"]
A_COLS4 = [c for c in A_COLS if c != "activity_code"]
B_TEXT = "lower(scope || ' ' || project || ' ' || description)"
B_COLS = ["scope", "project", "description"]
PLAN_TEXT = "lower(title || ' ' || description || ' ' || entitlement || ' ' || status || ' ' || address)"
PLAN_COLS = ["title", "description", "entitlement", "status", "address"]
MONEY = "TRY_CAST(nullif(trim(regexp_replace(valuation, '[$,]', '', 'g')), '') AS DOUBLE)"
FINALED = "(finaled_ms IS NOT NULL AND finaled_ms <> 0)"
STATUS_A = f"""CASE WHEN {FINALED} OR regexp_matches(lower(application_status), 'complete|final') THEN 'Completed'
  WHEN issued_ms IS NOT NULL OR regexp_matches(lower(application_status), 'issued') THEN 'Permitted'
  WHEN regexp_matches(lower(application_status), 'received|review|incomplete') THEN 'Planning'
  WHEN regexp_matches(lower(application_status), 'approved') THEN 'Approved' ELSE 'Proposed' END"""
STATUS_B = sql_first("status", [("Permitted", "issued"), ("Planning", "review"), ("Approved", "approved"), ("Completed", "complete|final")], "Proposed")


def joined(c):
    return F.array_join(c, "|")


def or_general(expr):
    return f"coalesce(nullif({expr}, ''), 'General')"


@query("cl01_permit_trades", f"SELECT seq, {or_general(sql_multi(A_TEXT, V.PERMIT_A_TRADES))} AS trades FROM permits_a")
def _(t):
    return t.permits_a.select("seq", joined(P.permit_trades(P.blob(*A_COLS))).alias("trades"))


@query("cl02_permit_b_trades", f"SELECT seq, {or_general(sql_multi(B_TEXT, V.PERMIT_B_TRADES))} AS trades FROM permits_b")
def _(t):
    return t.permits_b.select("seq", joined(P.permit_trades(P.blob(*B_COLS), V.PERMIT_B_TRADES)).alias("trades"))


@query("cl03_trade_by_substring", f"""
SELECT seq, {sql_first(A_TEXT, V.TRADE_SUBSTRINGS_A, 'General')} AS trade, 'A' AS source FROM permits_a
UNION ALL SELECT seq, {sql_first(B_TEXT, V.TRADE_SUBSTRINGS_B, 'General')}, 'B' FROM permits_b
UNION ALL SELECT seq, {sql_first("lower(title || ' ' || description || ' ' || notice_type)", V.TRADE_SUBSTRINGS_NOTICE, 'General')}, 'N' FROM notices""")
def _(t):
    a = t.permits_a.select("seq", P.trade_by_substring(P.blob(*A_COLS)).alias("trade"), F.lit("A").alias("source"))
    b = t.permits_b.select("seq", P.trade_by_substring(P.blob(*B_COLS), V.TRADE_SUBSTRINGS_B).alias("trade"), F.lit("B").alias("source"))
    n = t.notices.select("seq", P.trade_by_substring(P.blob("title", "description", "notice_type"), V.TRADE_SUBSTRINGS_NOTICE).alias("trade"), F.lit("N").alias("source"))
    return a.unionByName(b).unionByName(n)


def with_status(t):
    return t.permits_a.withColumn(
        "status", P.permit_status_a("application_status", X.millis_to_date("issued_ms"), X.millis_to_date("finaled_ms"))
    )


@query("cl04_project_status", f"""
SELECT seq, {STATUS_A} AS status, 'A' AS source FROM permits_a UNION ALL SELECT seq, {STATUS_B}, 'B' FROM permits_b""")
def _(t):
    a = with_status(t).select("seq", "status", F.lit("A").alias("source"))
    return a.unionByName(t.permits_b.select("seq", P.permit_status_b("status").alias("status"), F.lit("B").alias("source")))


TYPE_A = sql_first(A_TEXT4, [("Commercial", "commercial|tenant improvement"), ("Residential", "production home|single family|residential|duplex"), ("Industrial", "warehouse|industrial"), ("Infrastructure", "utility|road|bridge")], "Residential")
TYPE_B = sql_first(B_TEXT, [("Commercial", "commercial|wireless"), ("Residential", "townhome|residential"), ("Infrastructure", "sewer|utility")], "Commercial")
DOC_TYPE = sql_first("lower(text)", [("Residential", "residential|homes|subdivision"), ("Infrastructure", "drainage|utilities")], "Unknown")


@query("cl05_project_type", f"""
SELECT seq, {TYPE_A} AS project_type, 'A' AS source FROM permits_a UNION ALL SELECT seq, {TYPE_B}, 'B' FROM permits_b
UNION ALL SELECT seq, {sql_first(PLAN_TEXT, V.PLANNING_PROJECT_TYPES, 'unknown')}, 'P' FROM planning
UNION ALL SELECT seq, {DOC_TYPE}, 'D' FROM docs""")
def _(t):
    rows = [
        t.permits_a.select("seq", P.project_type_a(P.blob(*A_COLS4)).alias("project_type"), F.lit("A").alias("source")),
        t.permits_b.select("seq", P.project_type_b(P.blob(*B_COLS)).alias("project_type"), F.lit("B").alias("source")),
        t.planning.select("seq", P.planning_project_type(P.blob(*PLAN_COLS)).alias("project_type"), F.lit("P").alias("source")),
        t.docs.select("seq", P.document_project_type(F.lower("text")).alias("project_type"), F.lit("D").alias("source")),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


SIGNAL_A = f"""CASE WHEN status = 'Permitted' THEN 'Permit' WHEN regexp_matches(blob, 'production home|subdivision|master plan') THEN 'Subdivision Filing'
  WHEN regexp_matches(blob, 'utility|solar|pv|battery') THEN 'Utility Expansion' ELSE 'Planning Application' END"""
A_STATUS_ROWS = f"(SELECT *, {STATUS_A} AS status, {A_TEXT4} AS blob, {MONEY} AS amount FROM permits_a)"


@query("cl06_signal_type", f"""
SELECT seq, {SIGNAL_A} AS signal_type, 'A' AS source FROM {A_STATUS_ROWS}
UNION ALL SELECT seq, CASE WHEN st = 'Permitted' THEN 'Permit' WHEN regexp_matches(lower(scope || ' ' || description), 'sewer|utility') THEN 'Utility Expansion' ELSE 'Planning Application' END, 'B'
FROM (SELECT *, {STATUS_B} AS st FROM permits_b)""")
def _(t):
    a = with_status(t).select("seq", P.signal_type_a(P.blob(*A_COLS4), "status").alias("signal_type"), F.lit("A").alias("source"))
    b = t.permits_b.select("seq", P.signal_type_b(P.blob("scope", "description"), P.permit_status_b("status")).alias("signal_type"), F.lit("B").alias("source"))
    return a.unionByName(b)


@query("sm15_signal_importance", f"""
SELECT seq, least(100, CASE sig WHEN 'Permit' THEN 82 WHEN 'Subdivision Filing' THEN 76 ELSE 65 END + CASE WHEN coalesce(amount, 0) >= 500000 THEN 10 ELSE 0 END
  + CASE WHEN coalesce(amount, 0) >= 100000 THEN 5 ELSE 0 END + CASE WHEN coalesce(contractor, '') = '' OR contains(lower(contractor), 'owner builder') THEN 6 ELSE 0 END) AS importance, 'A' AS source
FROM (SELECT *, {SIGNAL_A} AS sig FROM {A_STATUS_ROWS})
UNION ALL SELECT seq, least(100, CASE WHEN {STATUS_B} = 'Permitted' THEN 80 ELSE 66 END + CASE WHEN apn <> '' THEN 5 ELSE 0 END + CASE WHEN length(scope) > 80 THEN 4 ELSE 0 END), 'B' FROM permits_b""")
def _(t):
    a = with_status(t).withColumn("sig", P.signal_type_a(P.blob(*A_COLS4), "status")).select(
        "seq", P.signal_importance_a("sig", X.parse_money("valuation"), "contractor").cast("int").alias("importance"), F.lit("A").alias("source")
    )
    b = t.permits_b.withColumn("st", P.permit_status_b("status")).select(
        "seq", P.signal_importance_b("st", "apn", "scope").cast("int").alias("importance"), F.lit("B").alias("source")
    )
    return a.unionByName(b)


STAGE_TEXT = "lower(status || ' ' || entitlement || ' ' || description || ' ' || title)"
LABELS = "CASE stage " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in V.PLANNING_STAGE_LABELS.items()) + " END"


@query("cl07_planning_stage", f"SELECT seq, stage, {LABELS} AS label FROM (SELECT seq, {sql_first(STAGE_TEXT, V.PLANNING_STAGES, 'unknown')} AS stage FROM planning)")
def _(t):
    staged = t.planning.withColumn("stage", P.planning_stage(P.blob("status", "entitlement", "description", "title")))
    return staged.select("seq", "stage", P.planning_stage_label("stage").alias("label"))


HOUSING = "['" + "', '".join(V.HOUSING_STACK) + "']"


@query("cl08_planning_trades", f"""
SELECT seq, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN named = '' THEN [] ELSE string_split(named, '|') END, CASE WHEN {rx('blob', V.HOUSING_CUE)} THEN {HOUSING} ELSE [] END))), '|') AS trades
FROM (SELECT seq, {PLAN_TEXT} AS blob, {sql_multi(PLAN_TEXT, V.PLANNING_TRADES)} AS named FROM planning)""")
def _(t):
    return t.planning.select("seq", joined(F.array_sort(P.planning_trades(P.blob(*PLAN_COLS)))).alias("trades"))


@query("cl09_package_hint", f"""
SELECT seq, CASE WHEN {rx(PLAN_TEXT, V.PACKAGE_SMALL)} AND NOT {rx(PLAN_TEXT, V.PACKAGE_SMALL_UNLESS)} THEN 'small' ELSE {sql_first(PLAN_TEXT, V.PACKAGE_HINTS, 'unknown')} END AS hint FROM planning""")
def _(t):
    return t.planning.select("seq", P.package_hint(P.blob(*PLAN_COLS)).alias("hint"))


PIPE = "('Planning Application', 'Subdivision Filing', 'Environmental Review', 'Utility Expansion')"


@query("cl10_opportunity_horizon", f"""
WITH s AS (SELECT project_seq, bool_or(signal_type = 'Permit') AS permit, bool_or(signal_type = 'Construction Start') AS started,
    bool_or(signal_type IN {PIPE}) AS pipe, bool_or(signal_type = 'Rezoning') AS early FROM signals GROUP BY 1),
p AS (SELECT seq, {STATUS_A} AS status FROM permits_a),
j AS (SELECT seq, status, coalesce(permit, false) AS permit, coalesce(started, false) AS started, coalesce(pipe, false) AS pipe, coalesce(early, false) AS early FROM p LEFT JOIN s ON project_seq = seq)
SELECT seq, CASE WHEN status = 'Permitted' OR permit OR started THEN 'Fast Money' WHEN status = 'Approved' OR pipe THEN 'Pipeline' WHEN early THEN 'Early Signals'
  WHEN status IN ('Approved', 'Planning', 'Proposed') THEN 'Pipeline' ELSE 'Early Signals' END AS horizon,
  CASE WHEN status = 'Permitted' OR permit OR started THEN 0 WHEN status = 'Approved' OR pipe THEN 6 WHEN early THEN 18 WHEN status IN ('Planning', 'Proposed') THEN 6 ELSE 18 END AS start_months FROM j""")
def _(t):
    kinds = t.signals.groupBy(F.col("project_seq").alias("seq")).agg(F.collect_set("signal_type").alias("kinds"))
    rows = with_status(t).select("seq", "status").join(kinds, "seq", "left")
    h = P.opportunity_horizon("status", F.coalesce("kinds", F.array().cast("array<string>")))
    return rows.withColumn("h", h).select("seq", F.col("h.horizon").alias("horizon"), F.col("h.start_months").alias("start_months"))


@query("cl11_contractor_categories", f"""
SELECT seq, array_to_string(list_slice(list_concat(first, list_filter(rest, lambda x: NOT list_contains(first, x))), 1, 5), '|') AS categories FROM (
  SELECT seq, CASE WHEN pt = 'Residential' OR contains(lower(project_name), 'subdivision') THEN ['Fencing', 'Concrete', 'Landscaping', 'Roofing'] ELSE [] END AS first,
    CASE WHEN pt = 'Commercial' THEN ['HVAC', 'Roofing', 'Concrete', 'Fencing'] WHEN pt IN ('Industrial', 'Infrastructure') THEN ['Fencing', 'Concrete', 'Electrical', 'Site work'] ELSE [] END AS rest
  FROM (SELECT *, {TYPE_A} AS pt FROM permits_a))""")
def _(t):
    return t.permits_a.withColumn("pt", P.project_type_a(P.blob(*A_COLS4))).select(
        "seq", joined(P.contractor_categories("pt", "project_name")).alias("categories")
    )


@query("cl12_normalize_trades", f"""
SELECT seq, array_to_string(list_sort(list_distinct(list_transform(string_split({or_general(sql_multi(A_TEXT, V.PERMIT_A_TRADES))}, '|'),
  lambda x: CASE WHEN x IN ('Painting', 'Carpentry', 'General') THEN 'General' ELSE x END))), '|') AS trades FROM permits_a""")
def _(t):
    return t.permits_a.select("seq", joined(F.array_sort(P.normalize_trades(P.permit_trades(P.blob(*A_COLS))))).alias("trades"))


@query("cl13_project_size", """
SELECT o_orderkey, CASE WHEN u >= 500 OR v >= 150000000 THEN 'Mega Project' WHEN u >= 100 OR v >= 40000000 THEN 'Large' WHEN u >= 25 OR v >= 10000000 THEN 'Medium' ELSE 'Small' END AS size
FROM (SELECT o_orderkey, o_totalprice * 400 AS v, o_custkey % 120 AS u FROM orders)""")
def _(t):
    return t.orders.select("o_orderkey", P.project_size(F.col("o_custkey") % 120, F.col("o_totalprice") * 400).alias("size"))


@query("cl14_timeline_and_fit", f"""
SELECT seq, CASE status WHEN 'Planning' THEN '6-18 months' WHEN 'Proposed' THEN '6-18 months' WHEN 'Approved' THEN '3-9 months' WHEN 'Permitted' THEN '0-6 months' ELSE 'Completed' END AS timeline,
  CASE status WHEN 'Permitted' THEN 'Likely 0-6 months' WHEN 'Approved' THEN 'Likely 3-9 months' WHEN 'Planning' THEN 'Early, monitor approvals' WHEN 'Proposed' THEN 'Early, monitor approvals' ELSE 'Low timing fit' END AS timing_fit,
  CASE WHEN seq % 101 >= 82 THEN 'Strong match' WHEN seq % 101 >= 68 THEN 'Worth pursuing' WHEN seq % 101 >= 52 THEN 'Monitor' ELSE 'Weak fit' END AS fit
FROM (SELECT seq, {STATUS_A} AS status FROM permits_a)""")
def _(t):
    return with_status(t).select("seq", P.timeline("status").alias("timeline"), P.timing_fit("status").alias("timing_fit"), P.fit_label(F.col("seq") % 101).alias("fit"))


@query("cl15_company_role", f"""
SELECT contact_seq, {sql_first("lower(role || ' ' || title)", V.ROLE_FROM_TEXT, 'General Contractor')} AS role_label FROM contacts""")
def _(t):
    return t.contacts.select("contact_seq", P.company_role("role", "title").alias("role_label"))


@query("cl16_stage_from_status", f"""
SELECT seq, {sql_first("lower(status || ' ' || application_status)", [('Active', 'issued|active|approved'), ('Planning', 'application|received|planning|review'), ('Early', 'agenda|filed|proposed'), ('Internal Only', 'final|complete|closed')], 'Unknown')} AS stage
FROM (SELECT *, {STATUS_A} AS status FROM permits_a)""")
def _(t):
    return with_status(t).select("seq", P.stage_from_status("status", "application_status").alias("stage"))


@query("cl17_evidence_quality", """
SELECT seq, CASE WHEN evidence_count >= 5 AND conf >= 0.8 AND (phone IS NOT NULL OR contractor_value IS NOT NULL) THEN 'High' WHEN evidence_count >= 3 AND conf >= 0.7 THEN 'Medium' ELSE 'Low' END AS record_quality,
  CASE WHEN evidence_count >= 6 AND phone IS NOT NULL THEN 'High' WHEN evidence_count >= 4 THEN 'Medium' ELSE 'Low' END AS document_quality
FROM (SELECT *, CAST(60 + seq % 40 AS DOUBLE) / 100 AS conf FROM opps)""")
def _(t):
    o = t.opps.withColumn("conf", (F.lit(60) + F.col("seq") % 40).cast("double") / 100)
    return o.select(
        "seq", P.evidence_quality("evidence_count", "conf", F.col("phone").isNotNull() | F.col("contractor_value").isNotNull()).alias("record_quality"),
        P.document_evidence_quality("evidence_count", F.col("phone").isNotNull()).alias("document_quality"),
    )


@query("cl18_fast_money", f"""
SELECT seq, CASE WHEN fit AND access THEN 'High' WHEN fit THEN 'Medium' ELSE 'Low' END AS potential FROM (
  SELECT seq, {rx('trade', P.FAST_TRADES)} OR {rx("lower(project_name || ' ' || project_description || ' ' || project_stage)", P.FAST_TEXT)} AS fit,
    phone IS NOT NULL OR coalesce(contractor_value IN ('High', 'Medium'), false) AS access FROM opps)""")
def _(t):
    o = t.opps
    access = F.col("phone").isNotNull() | F.coalesce(F.col("contractor_value").isin("High", "Medium"), F.lit(False))
    return o.select("seq", P.fast_money_potential(P.blob("project_name", "project_description", "project_stage"), F.split("trade", ", "), access).alias("potential"))


@query("cl19_opportunity_state", """
SELECT seq, CASE WHEN qualification_score >= 70 AND phone IS NOT NULL THEN 'Qualified' WHEN qualification_score >= 45 THEN 'Needs Research'
  WHEN project_stage = 'Early' OR coalesce(developer, 'Unknown') <> 'Unknown' OR fencing_signal_presence THEN 'Early Signal' WHEN qualification_score >= 20 THEN 'Low Confidence' ELSE 'Internal Only' END AS state FROM opps""")
def _(t):
    known = F.coalesce(F.col("developer"), F.lit("Unknown")) != "Unknown"
    return t.opps.select("seq", P.opportunity_state("qualification_score", F.col("phone").isNotNull(), "project_stage", known, F.col("fencing_signal_presence")).alias("state"))


SHARES = ", ".join(f"({q(k)}, {lo}, {hi})" for k, (lo, hi) in V.REVENUE_SHARES.items())


@query("ag17_revenue_windows", f"""
SELECT seq, trade, CAST(CASE WHEN amount > 0 THEN floor(amount * coalesce(lo, 0.02::DOUBLE) + 0.5) END AS DOUBLE) AS low, CAST(CASE WHEN amount > 0 THEN floor(amount * coalesce(hi, 0.08::DOUBLE) + 0.5) END AS DOUBLE) AS high
FROM (SELECT seq, {MONEY} AS amount, unnest(string_split({or_general(sql_multi(A_TEXT, V.PERMIT_A_TRADES))}, '|')) AS trade FROM permits_a)
LEFT JOIN (SELECT k, lo::DOUBLE AS lo, hi::DOUBLE AS hi FROM (VALUES {SHARES}) AS s(k, lo, hi)) ON k = trade""")
def _(t):
    rows = t.permits_a.select("seq", P.revenue_windows(X.parse_money("valuation"), P.permit_trades(P.blob(*A_COLS))).alias("w"))
    return rows.select("seq", F.explode("w").alias("trade", "win")).select(
        "seq", "trade", F.col("win.low").cast("double").alias("low"), F.col("win.high").cast("double").alias("high")
    )


@query("cl50_class_variants", f"""
SELECT seq, CASE WHEN regexp_matches(project_name || ' ' || work_description, '\\((\\d{{3,5}})\\)\\s*S\\.?F', 'i') THEN 1 ELSE 0 END AS units,
  {sql_first(A_TEXT, V.TRADE_SUBSTRINGS_A, 'General')} AS trade, {STATUS_A} AS status, {TYPE_A} AS project_type FROM permits_a""")
def _(t):
    units = F.when(F.concat_ws(" ", "project_name", "work_description").rlike(r"(?i)\((\d{3,5})\)\s*S\.?F"), 1).otherwise(0)
    return with_status(t).select(
        "seq", units.alias("units"), P.trade_by_substring(P.blob(*A_COLS)).alias("trade"), "status", P.project_type_a(P.blob(*A_COLS4)).alias("project_type")
    )
