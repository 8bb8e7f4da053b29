"""Registered queries: trade matrix, ladders and access scoring (CL-20..45, SM-06..14, WN-04..06, WN-15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.base import q, query, rx, sql_hits
from plumbline.functions import contacts as C
from plumbline.functions import rules as R
from plumbline.functions import text as X
from plumbline.operators.keyed import first_per_key
from plumbline.plans import access as AC
from plumbline.plans import companies as CO
from plumbline.plans import trades as T
from plumbline.plans import vocab as V

BLOB_COLS = ["project_name", "project_description", "project_location", "trade", "developer", "general_contractor", "architect", "procurement_route",
             "entry_method", "access_route", "opportunity_state", "evidence_quality", "fast_money_potential"]
BLOB = "lower(concat_ws(' ', " + ", ".join(f"nullif({c}, '')" for c in BLOB_COLS) + "))"
GC = "coalesce(general_contractor, '')"


def blobbed(t):
    return t.opps.withColumn("text", X.text_blob(*BLOB_COLS))


SIZE = f"""CASE WHEN {rx('text', V.SCOPE_SIZE_LARGE)} THEN (CASE WHEN {rx('text', V.SCOPE_SIZE_MAJOR)} THEN 'Major' ELSE 'Large' END) WHEN {rx('text', V.SCOPE_SIZE_SMALL)} THEN 'Small'
  WHEN {rx('text', V.SCOPE_SIZE_TINY)} THEN 'Tiny' WHEN evidence_count >= 5 OR qualification_score >= 70 THEN 'Medium' ELSE 'Small' END"""
LADDER_SQL = f"""
WITH b AS (SELECT *, {BLOB} AS text FROM opps), s AS (SELECT *, {SIZE} AS size FROM b),
l AS (SELECT *, CASE size WHEN 'Major' THEN 100 WHEN 'Large' THEN 82 WHEN 'Small' THEN 35 WHEN 'Tiny' THEN 10 ELSE 58 END AS size_s,
  CASE WHEN size IN ('Major', 'Large') THEN 'High' WHEN {rx('text', V.SUBCONTRACT_MEDIUM)} THEN 'Medium' WHEN {rx('text', V.SUBCONTRACT_LOW)} THEN 'Low' WHEN opportunity_state = 'Actionable Opportunity' THEN 'MediumA' ELSE 'Unknown' END AS sub,
  CASE WHEN size = 'Major' THEN 'Very High' WHEN size = 'Large' THEN 'High' WHEN {rx('text', V.SIZE_MEDIUM)} THEN 'Medium' WHEN size = 'Tiny' THEN 'Very Low' WHEN qualification_score >= 70 THEN 'MediumQ' ELSE 'Low' END AS osz,
  CASE WHEN {rx('text', V.STAGE_OPEN)} THEN 'Open' WHEN {rx('text', V.STAGE_LATE)} THEN 'Late' WHEN opportunity_state IN ('Actionable Opportunity', 'Research Required') THEN 'OpenS' ELSE 'Unknown' END AS stg,
  CASE WHEN {GC} IN ('', 'Unknown') THEN 0 WHEN {rx(GC, V.GENERAL_CONTRACTOR_NAMES)} THEN 0 ELSE 12 END AS sat FROM s),
n AS (SELECT *, CASE sub WHEN 'High' THEN 90 WHEN 'Medium' THEN 62 WHEN 'Low' THEN 18 WHEN 'MediumA' THEN 58 ELSE 35 END AS sub_s,
  CASE osz WHEN 'Very High' THEN 95 WHEN 'High' THEN 78 WHEN 'Medium' THEN 58 WHEN 'Very Low' THEN 8 WHEN 'MediumQ' THEN 52 ELSE 25 END AS osz_s,
  CASE stg WHEN 'Open' THEN 82 WHEN 'Late' THEN 18 WHEN 'OpenS' THEN 75 ELSE 45 END AS stg_s FROM l)"""


@query("cl32_size_ladders", LADDER_SQL + """
SELECT seq, size AS scope_size, size_s AS scope_score, sub_s AS subcontractor_score, osz_s AS size_score, stg_s AS stage_score, sat AS saturation FROM n""")
def _(t):
    r = T.with_ladders(blobbed(t), "text")
    return r.select("seq", F.col("scope_size.label").alias("scope_size"), F.col("scope_size.score").alias("scope_score"), F.col("subcontractor.score").alias("subcontractor_score"),
                    F.col("opp_size.score").alias("size_score"), F.col("stage.score").alias("stage_score"), F.col("saturation.score").alias("saturation"))


def noise_sql(trade):
    parts = [rx("text", p) for p in V.TRADE_NOISE.get(trade, [])]
    if trade == "Fencing":
        parts.append(f"({rx('text', V.FENCE_ELECTRICAL_NOISE)} AND NOT {rx('text', V.FENCE_ELECTRICAL_NOISE_UNLESS)})")
    return "(" + " OR ".join(parts) + ")" if parts else "false"


def model_sql(trade, m):
    return f"""SELECT seq, {q(trade)} AS model, {sql_hits('text', m['terms'])} AS direct, {sql_hits('text', m['adjacent'])} AS adjacent, contains(lower(trade), {q(trade.lower())}) AS tagged, NOT contains(trade, ',') AS single,
  {GC} NOT IN ('', 'Unknown') AND {sql_hits(f'lower({GC})', m['saturation'])} > 0 AS saturated, {noise_sql(trade)} AS noise, fencing_signal_presence AS fsp, fence_probability AS prob, access_score, size, size_s, sub, sub_s, osz_s, stg, stg_s, sat FROM n"""


CAP = ", ".join(q(x) for x in V.ADJACENT_CAPPED_TRADES)
MATRIX = LADDER_SQL + f""", x AS ({" UNION ALL ".join(model_sql(k, m) for k, m in V.TRADE_MODELS.items())}),
r0 AS (SELECT *, least(100, direct * 28 + adjacent * 8) AS r FROM x), r1 AS (SELECT * REPLACE (CASE WHEN model = 'Fencing' AND fsp THEN greatest(r, 65) ELSE r END AS r) FROM r0),
r2 AS (SELECT * REPLACE (CASE WHEN model = 'Fencing' AND prob >= 50 THEN greatest(r, prob) ELSE r END AS r) FROM r1),
r3 AS (SELECT * REPLACE (CASE WHEN tagged THEN greatest(r, CASE WHEN single OR direct > 0 THEN 70 ELSE 48 END) ELSE r END AS r) FROM r2),
r4 AS (SELECT * REPLACE (CASE WHEN direct = 0 AND adjacent > 0 AND model IN ({CAP}) THEN least(r, 42) ELSE r END AS r), CASE WHEN saturated THEN 42 ELSE sat END AS satp, CASE WHEN noise THEN 28 ELSE 0 END AS noisep FROM r3),
m AS (SELECT *, greatest(0, least(100, CAST(floor((r * 28 + size_s * 18 + sub_s * 22 + osz_s * 14 + stg_s * 12 + least(access_score, 100) * 6 - satp * 100 - noisep * 100 + 50) / 100.0) AS INT))) AS score FROM r4)"""


@query("sm10_trade_matrix", MATRIX + " SELECT seq, model, r AS trade_relevance, satp AS saturation_penalty, noisep AS noise_penalty, score AS trade_score FROM m")
def _(t):
    return T.trade_scores(T.with_ladders(blobbed(t), "text"), "text").select("seq", "model", "trade_relevance", "saturation_penalty", "noise_penalty", "trade_score")


BEST = ", best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY seq ORDER BY score DESC, (direct > 0) DESC, model = 'Fencing', model) = 1)"


@query("wn15_best_trade", MATRIX + BEST + " SELECT seq, model, score AS trade_score FROM best")
def _(t):
    return T.best_trade(T.with_trade_scores(T.with_ladders(blobbed(t), "text"), "text")).select("seq", "model", "trade_score")


SUPPRESS = """concat_ws('|', CASE WHEN size = 'Tiny' THEN 'Tiny scope' END, CASE WHEN sub = 'Low' THEN 'Low subcontractor likelihood' END, CASE WHEN stg = 'Late' THEN 'Late or closed stage' END,
  CASE WHEN satp >= 40 THEN 'Existing GC appears to be the searched trade contractor' END, CASE WHEN r < 25 THEN 'Weak trade relevance' END, CASE WHEN noisep > 0 THEN 'Likely noise match' END)"""


@query("cl33_suppression", MATRIX + BEST + f" SELECT seq, {SUPPRESS} AS reasons, score >= 35 AND {SUPPRESS} = '' AS visible FROM best")
def _(t):
    return T.contractor_opportunities(blobbed(t), "text").select("seq", F.array_join("suppress_reasons", "|").alias("reasons"), F.col("contractor_visible").alias("visible"))


@query("cl52_score_reason", MATRIX + BEST + f""" SELECT seq, model || ' score ' || CAST(score AS VARCHAR) || ': ' || size || ' scope, ' || lower(CASE sub WHEN 'MediumA' THEN 'Medium' ELSE sub END) || ' subcontractor likelihood, '
  || (CASE osz_s WHEN 95 THEN 'very high' WHEN 78 THEN 'high' WHEN 58 THEN 'medium' WHEN 52 THEN 'medium' WHEN 8 THEN 'very low' ELSE 'low' END) || ' opportunity size, ' || lower(CASE stg WHEN 'OpenS' THEN 'Open' ELSE stg END) || ' stage.'
  || CASE WHEN {SUPPRESS} <> '' THEN ' Suppressed: ' || replace({SUPPRESS}, '|', ', ') || '.' ELSE '' END AS reason FROM best""")
def _(t):
    return T.contractor_opportunities(blobbed(t), "text").select("seq", F.col("qualification_reason").alias("reason"))


# --- access paths ------------------------------------------------------------------------------
A_TEXT_COLS = ["project_name", "project_description", "trade", "project_stage"]
A_TEXT = "concat_ws(' ', nullif(project_name, ''), project_description, trade, project_stage)"
KNOWN = lambda c: f"(coalesce({c}, '') NOT IN ('', 'Unknown'))"
ER = "concat_ws(' ', entry_method, procurement_route)"
SITE = "(seq % 4 = 0)"
PATH = f"""CASE WHEN {rx(f"{ER} || ' ' || text", AC.PUBLIC_ROUTE)} AND {rx('text', AC.PUBLIC_TEXT)} THEN 'Municipality-driven' WHEN {SITE} AND NOT {KNOWN('general_contractor')} AND NOT {KNOWN('developer')} THEN 'Owner-driven'
  WHEN {SITE} AND {rx('text', AC.OWNER_TEXT)} AND NOT {KNOWN('developer')} THEN 'Owner-driven' WHEN {KNOWN('developer')} AND {rx(ER, AC.DEVELOPER_ROUTE)} THEN 'Developer-driven'
  WHEN {KNOWN('developer')} AND NOT {KNOWN('general_contractor')} THEN 'Developer-driven' WHEN {KNOWN('general_contractor')} THEN 'GC-driven' WHEN {rx('text', AC.MUNICIPAL_TEXT)} THEN 'Municipality-driven' WHEN {SITE} THEN 'Owner-driven' ELSE 'Unknown' END"""
STAGE_BLOB = "(lower(project_stage) || ' ' || lower(opportunity_state) || ' ' || text)"
STAGE = f"""CASE WHEN {rx(STAGE_BLOB, AC.LATE_STAGE)} THEN 'Awarded / late' WHEN {rx(STAGE_BLOB, AC.ISSUED_STAGE)} THEN 'Permit issued / construction' WHEN {rx(STAGE_BLOB, AC.PLAN_STAGE)} THEN 'Plan check / design'
  WHEN {rx(STAGE_BLOB, AC.EARLY_STAGE)} THEN 'Pre-bid / early' WHEN {rx('text', AC.WORK_TEXT)} AND {rx("lower(project_stage) || ' ' || text", 'issued|permit')} THEN 'Permit issued / construction'
  ELSE upper(project_stage[1]) || lower(project_stage[2:]) END"""
AC_SQL = f"(SELECT *, {PATH} AS path_type, {STAGE} AS pstage FROM (SELECT *, {A_TEXT} AS text FROM opps))"


def pathed(t):
    o = t.opps.withColumn("text", X.text_blob(*A_TEXT_COLS, lower=False))
    o = o.withColumn("path_type", AC.access_path_type("general_contractor", "developer", "entry_method", "procurement_route", "text", F.col("seq") % 4 == 0))
    return o.withColumn("pstage", AC.procurement_stage("project_stage", "opportunity_state", "text"))


@query("cl34_access_path_type", f"SELECT seq, path_type FROM {AC_SQL}")
def _(t):
    return pathed(t).select("seq", "path_type")


@query("cl35_procurement_stage", f"SELECT seq, pstage FROM {AC_SQL}")
def _(t):
    return pathed(t).select("seq", "pstage")


AWARD = f"""greatest(0, least(100, 45 + CASE path_type WHEN 'Owner-driven' THEN -15 WHEN 'GC-driven' THEN 10 WHEN 'Developer-driven' THEN 5 WHEN 'Municipality-driven' THEN 8 ELSE 0 END
  + CASE WHEN {rx('pstage', 'permit issued|construction')} THEN 20 ELSE 0 END - CASE WHEN {rx('pstage', 'pre-bid|early|plan check|design')} THEN 15 ELSE 0 END + CASE WHEN {rx('pstage', 'awarded|late')} THEN 30 ELSE 0 END
  + CASE WHEN seq % 50 >= 30 THEN 25 ELSE 0 END + CASE WHEN {rx('text', 'new [(]gates[)]|new fence|raise fence|pool safety fencing|chain[-' + chr(92) + 's]?link')} THEN 5 ELSE 0 END))"""


@query("sm14_award_probability", f"""
SELECT seq, a AS score, CASE WHEN a >= 75 THEN 'High' WHEN a >= 50 THEN 'Medium' WHEN a >= 25 THEN 'Low' ELSE 'Very Low' END AS label,
  greatest(0, least(100, CASE WHEN phone IS NOT NULL THEN 40 ELSE 0 END + CASE WHEN email IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN contact_name IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN path_type <> 'Unknown' THEN 10 ELSE 0 END
   + CASE WHEN a < 50 THEN 10 ELSE 0 END - CASE WHEN a >= 75 THEN 5 ELSE 0 END)) AS readiness FROM (SELECT *, {AWARD} AS a FROM {AC_SQL})""")
def _(t):
    o = pathed(t).withColumn("a", AC.award_probability("path_type", "pstage", F.col("seq") % 50, "text")["score"])
    o = o.withColumn("label", AC.award_label("a"))
    return o.select("seq", F.col("a").alias("score"), "label", AC.call_readiness("phone", "email", "contact_name", F.lit(""), "path_type", "label").alias("readiness"))


@query("cl45_first_call", f"""
SELECT seq, CASE WHEN phone IS NULL AND email IS NULL THEN 'Research a direct phone for ' || who || ' before calling about ' || nm || '.' WHEN self THEN 'Call ' || who || att || ' only to confirm self-perform vs overflow subcontract need on ' || nm || '; this may already be their package.'
  WHEN a >= 75 THEN 'Call ' || who || att || ' tomorrow morning and ask whether the fence/gate package on ' || nm || ' is still open or already awarded.' WHEN path_type = 'Owner-driven' THEN 'Call ' || who || att || ' tomorrow morning and ask who is handling the fence/gate work for ' || nm || ' and whether they want a fencing bid.'
  ELSE 'Call ' || who || att || ' tomorrow morning and ask for estimating/purchasing regarding the fence/gate package on ' || nm || '.' END AS first_call,
  CASE path_type WHEN 'Owner-driven' THEN 'Site owner / named business' WHEN 'Developer-driven' THEN coalesce(nullif(developer, 'Unknown'), 'Developer procurement') WHEN 'Municipality-driven' THEN 'Public agency / procurement officer'
    WHEN 'GC-driven' THEN coalesce(nullif(general_contractor, 'Unknown'), 'General contractor') ELSE 'Unknown' END AS controls
FROM (SELECT *, {AWARD} AS a, coalesce(contact_name, 'the project decision maker') AS who, CASE WHEN phone IS NOT NULL THEN ' at ' || phone ELSE '' END AS att, trim(project_name) AS nm, {rx('contractor', C.SELF_PERFORMING_FENCE)} AS self FROM {AC_SQL})""")
def _(t):
    o = pathed(t).withColumn("award", AC.award_label(AC.award_probability("path_type", "pstage", F.col("seq") % 50, "text")["score"]))
    call = AC.first_call("contact_name", "phone", "email", "project_name", R.matches("contractor", C.SELF_PERFORMING_FENCE), "award", "path_type")
    return o.select("seq", call.alias("first_call"), AC.who_controls("path_type", "developer", "general_contractor", F.lit("")).alias("controls"))


PM = rx("concat_ws(' ', title, name, contact_type)", C.PROJECT_MANAGER_TITLES)
EST = rx("concat_ws(' ', title, name)", C.ESTIMATOR_TITLES)
HUMAN = """CASE WHEN name <> '' AND phone <> '' THEN 100 WHEN name <> '' AND email <> '' THEN 95 WHEN phone <> '' THEN (CASE contact_type WHEN 'construction' THEN 85 WHEN 'corporate' THEN 65 ELSE 60 END) WHEN email <> '' THEN 55 WHEN company <> '' THEN 30 ELSE 25 END"""
ACTION = "CASE WHEN name <> '' AND phone <> '' THEN 100 WHEN name <> '' AND email <> '' THEN 92 WHEN phone <> '' THEN 82 WHEN email <> '' THEN 74 WHEN company <> '' THEN 50 ELSE 45 END"
ACCESS = f"""(CASE WHEN name <> '' AND phone <> '' THEN 100 WHEN name <> '' AND email <> '' THEN 90 WHEN phone <> '' THEN 80 WHEN email <> '' THEN 70 WHEN company <> '' THEN 30 ELSE 0 END + CASE WHEN {PM} THEN 25 ELSE 0 END + CASE WHEN {EST} THEN 18 ELSE 0 END
  + CASE contact_type WHEN 'construction' THEN 8 WHEN 'direct' THEN 12 ELSE 0 END)"""
KEY = "trim(regexp_replace(lower(company || '|' || name || '|' || phone || '|' || email), '[^a-z0-9]+', ' ', 'g'))"
ONCE = f"(SELECT * FROM contacts QUALIFY row_number() OVER (PARTITION BY opportunity_id, {KEY} ORDER BY contact_seq) = 1)"


@query("wn04_rank_contacts", " UNION ALL ".join(
    f"SELECT opportunity_id, '{v}' AS variant, contact_seq, {r} AS rank FROM {ONCE} QUALIFY row_number() OVER (PARTITION BY opportunity_id ORDER BY {r} DESC, confidence DESC, contact_seq) = 1"
    for v, r in (("human", HUMAN), ("action", ACTION), ("access", ACCESS))))
def _(t):
    parts = [AC.rank_contacts(t.contacts, "opportunity_id", v, "contact_seq").select("opportunity_id", F.lit(v).alias("variant"), "contact_seq", "rank") for v in ("human", "action", "access")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("wn05_primary_contact", """
SELECT opportunity_id, company FROM contacts QUALIFY row_number() OVER (PARTITION BY opportunity_id ORDER BY CASE role WHEN 'Developer' THEN 0 WHEN 'General Contractor' THEN 2 ELSE 3 END, contact_seq) = 1""")
def _(t):
    role = F.when(F.col("role") == "Developer", "developer").when(F.col("role") == "General Contractor", "contractor").otherwise(F.lower("role"))
    return AC.primary_contact(t.contacts.withColumn("role", role), "opportunity_id", "role", "contact_seq").select("opportunity_id", "company")


NK = lambda c: f"trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'))"
DM = f"""
WITH j AS (SELECT c.*, o.path_type, o.developer, o.general_contractor FROM contacts c JOIN (SELECT id, path_type, developer, contractor AS general_contractor FROM {AC_SQL}) o ON o.id = c.opportunity_id),
p AS (SELECT *, CASE WHEN {PM} AND (phone <> '' OR email <> '') THEN 0 WHEN {EST} AND (phone <> '' OR email <> '') THEN 1 WHEN path_type = 'Developer-driven' AND {NK('company')} = {NK('developer')} AND (phone <> '' OR email <> '') THEN 2
  WHEN (path_type = 'GC-driven' OR {KNOWN('general_contractor')}) AND {NK('company')} = {NK('general_contractor')} AND (phone <> '' OR email <> '') THEN 3 WHEN (path_type = 'GC-driven' OR {KNOWN('general_contractor')}) AND phone <> '' THEN 4 ELSE 5 END AS priority, {ACCESS} AS rank FROM j),
d AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY opportunity_id ORDER BY priority, rank DESC, confidence DESC, contact_seq) = 1)"""


def deciders(t):
    o = pathed(t).select(F.col("id").alias("opportunity_id"), "path_type", "developer", F.col("contractor").alias("general_contractor"))
    return AC.decision_makers(t.contacts, o, "opportunity_id", "contact_seq")


@query("wn06_decision_maker", DM + " SELECT opportunity_id, contact_seq, priority FROM d")
def _(t):
    return deciders(t).select("opportunity_id", "contact_seq", "priority")


@query("wn06_all_decisions", DM + f""" SELECT o.id AS opportunity_id, d.contact_seq, coalesce(d.company, CASE WHEN {KNOWN('o.general_contractor')} THEN o.general_contractor WHEN {KNOWN('o.developer')} THEN o.developer END) AS company,
  CASE WHEN d.contact_seq IS NOT NULL THEN d.confidence ELSE 0.2 END AS confidence, CASE WHEN d.contact_seq IS NOT NULL THEN 'contact' WHEN {KNOWN('o.general_contractor')} THEN 'General Contractor (no phone yet)' ELSE 'Unknown' END AS role
FROM (SELECT id, developer, contractor AS general_contractor FROM {AC_SQL}) o LEFT JOIN d ON d.opportunity_id = o.id""")
def _(t):
    o = pathed(t).select(F.col("id").alias("opportunity_id"), "path_type", "developer", F.col("contractor").alias("general_contractor"), "source_url")
    r = AC.all_decisions(t.contacts, o, "opportunity_id", "contact_seq")
    return r.select("opportunity_id", "contact_seq", "company", "confidence", F.when(F.col("contact_seq").isNotNull(), "contact").otherwise(F.col("role")).alias("role"))


@query("wn06_second_contact", DM + f""", r AS (SELECT p.*, {PM.replace('title', 'p.title').replace('name', 'p.name').replace('contact_type', 'p.contact_type')} AS pm FROM p JOIN d ON d.opportunity_id = p.opportunity_id
  WHERE NOT ({NK('p.company')} = {NK('d.company')} AND ((p.phone <> '' AND p.phone = d.phone) OR (p.name <> '' AND d.name <> '' AND {NK('p.name')} = {NK('d.name')}) OR (p.name = '' AND d.name = ''))))
SELECT opportunity_id, contact_seq FROM r QUALIFY row_number() OVER (PARTITION BY opportunity_id ORDER BY CASE WHEN pm THEN 0 ELSE 1 END, rank DESC, confidence DESC, contact_seq) = 1""")
def _(t):
    return AC.second_contacts(t.contacts, deciders(t), "opportunity_id", "contact_seq").select("opportunity_id", "contact_seq")


TYPES = "['vendor_registration', 'subcontractor_registration', 'trade_partner', 'bid_portal', 'plan_room', 'general_contact']"
COLS = {"vendor_registration": "vendor_registration_page_url", "subcontractor_registration": "subcontractor_registration_page_url", "trade_partner": "trade_partner_portal_url",
        "bid_portal": "bid_opportunities_page_url", "plan_room": "plan_room_url", "general_contact": "contact_page_url"}
NN = lambda k: f"({COLS[k]} IS NOT NULL)"
SM09 = f"""least(100, CASE WHEN {NN('vendor_registration')} OR {NN('subcontractor_registration')} THEN 28 ELSE 0 END + CASE WHEN {NN('trade_partner')} THEN 28 ELSE 0 END + CASE WHEN {NN('bid_portal')} OR {NN('plan_room')} THEN 28 ELSE 0 END
  + CASE WHEN {NN('general_contact')} THEN 14 ELSE 0 END + CASE WHEN {' OR '.join(NN(k) for k in COLS)} THEN 18 ELSE 0 END + CASE WHEN {' OR '.join(NN(k) for k in COLS if k != 'general_contact')} THEN 12 ELSE 0 END + CASE WHEN phone IS NOT NULL THEN 10 ELSE 0 END)"""


@query("sm09_access_score", f"""
SELECT seq, s AS access_score, CASE WHEN s >= 70 AND ({' OR '.join(NN(k) for k in COLS)}) THEN 'Actionable Opportunity' WHEN s >= 30 OR {' OR '.join(NN(k) for k in COLS if k != 'general_contact')} THEN 'Research Required' ELSE 'Opportunity' END AS state FROM (SELECT *, {SM09} AS s FROM web)""")
def _(t):
    types = CO.procurement_paths(t.web, "seq").groupBy("seq").agg(F.collect_set("path_type").alias("types"))
    w = t.web.join(types, "seq", "left").withColumn("types", F.coalesce("types", F.array().cast("array<string>")))
    has = F.size("types") > 0
    avail = F.size(F.array_except("types", F.array(F.lit("general_contact")))) > 0
    w = w.withColumn("s", AC.access_score("types", has, avail, F.col("phone").isNotNull(), F.lit(False)))
    return w.select("seq", F.col("s").alias("access_score"), AC.access_state("s", has, avail).alias("state"))


BEST_TYPE = f"""CASE WHEN {NN('bid_portal')} THEN 'bid_portal' WHEN {NN('plan_room')} THEN 'plan_room' WHEN {NN('subcontractor_registration')} THEN 'subcontractor_registration' WHEN {NN('trade_partner')} THEN 'trade_partner' WHEN {NN('vendor_registration')} THEN 'vendor_registration' WHEN {NN('general_contact')} THEN 'general_contact' END"""


@query("cl21_entry_method", f"""
SELECT seq, CASE WHEN b = 'trade_partner' THEN 'Trade Partner Registration' WHEN b IN ('vendor_registration', 'subcontractor_registration') THEN 'Vendor Registration' WHEN b IN ('bid_portal', 'plan_room') THEN 'Bid Portal' WHEN b = 'general_contact' OR official_website IS NOT NULL THEN 'General Contact Route'
  WHEN company_type = 'Developer' THEN 'Developer Procurement Research' WHEN company_type = 'General Contractor' THEN 'Subcontractor Intake Research' ELSE 'Unknown' END AS entry_method,
  CASE WHEN company_type IN ('Developer', 'General Contractor') AND b IN ('trade_partner', 'vendor_registration', 'subcontractor_registration') THEN 'true' WHEN b = 'bid_portal' THEN 'Often' ELSE 'false' END AS approval,
  CASE company_type WHEN 'Developer' THEN 'Subdivision Trades' WHEN 'General Contractor' THEN 'Subcontracted Trade Packages' WHEN 'Architect' THEN 'Design-Led Project Intelligence' WHEN 'Engineer' THEN 'Infrastructure and Site Work' ELSE 'Unknown' END AS typical
FROM (SELECT *, {BEST_TYPE} AS b FROM web)""")
def _(t):
    best = CO.best_path(CO.procurement_paths(t.web, "seq"), "seq").select("seq", F.col("path_type").alias("b"))
    w = t.web.join(best, "seq", "left")
    return w.select("seq", AC.entry_method("b", "company_type", F.col("official_website").isNotNull() | F.col("contact_page_url").isNotNull()).alias("entry_method"),
                    AC.approval_required("b", "company_type").alias("approval"), AC.typical_opportunity("company_type").alias("typical"))


@query("cl20_project_access_state", """
SELECT seq, CASE WHEN phone IS NOT NULL OR access_score >= 70 THEN 'Actionable Opportunity' WHEN access_score >= 35 THEN 'Research Required' ELSE 'Opportunity' END AS state,
  CASE WHEN NOT fencing_signal_presence THEN 8 ELSE greatest(0, least(100, 40 + CASE WHEN regexp_matches(project_name, '\\b(fence|fencing|new\\s*\\(?gates?|sliding gate|automatic gate|steel gate|security gate)\\b', 'i') THEN 30 ELSE 0 END
   - CASE WHEN regexp_matches(trade || ' ' || project_name, 'electrical|solar|hvac|roof|landscape lighting', 'i') THEN 25 ELSE 0 END)) END AS fence_probability FROM opps""")
def _(t):
    return t.opps.select("seq", AC.project_access_state(F.col("phone").isNotNull(), "access_score").alias("state"),
                         AC.fence_probability(F.col("fencing_signal_presence"), "project_name", "trade").alias("fence_probability"))


@query("cl42_contact_coverage", """
SELECT seq, CASE WHEN seq % 7 = 0 THEN (CASE WHEN procurement_route <> 'Unknown' THEN 'Access Route Only' ELSE 'Unknown' END) WHEN contact_name IS NOT NULL AND (phone IS NOT NULL OR email IS NOT NULL) THEN 'Known Human Contact'
  WHEN phone IS NOT NULL OR email IS NOT NULL THEN 'Company Office Contact' WHEN coalesce(contractor, '') <> '' THEN 'Named Company Lead' WHEN procurement_route <> 'Unknown' THEN 'Access Route Only' ELSE 'Unknown' END AS coverage FROM opps""")
def _(t):
    return t.opps.select("seq", AC.contact_coverage(F.col("seq") % 7 != 0, "contact_name", "phone", "email", "contractor", "procurement_route").alias("coverage"))


@query("sm08_dossier_actionability", """
SELECT seq, least(100, CASE WHEN contractor_value IN ('High', 'Medium') THEN 24 ELSE 0 END + CASE WHEN phone IS NOT NULL THEN 22 ELSE 0 END + CASE evidence_quality WHEN 'High' THEN 16 WHEN 'Medium' THEN 10 ELSE 0 END + CASE WHEN evidence_count > 0 THEN least(14, evidence_count * 3) ELSE 0 END
  + CASE WHEN qualification_score >= 70 THEN 12 ELSE 0 END + CASE WHEN fencing_signal_presence THEN 8 ELSE 0 END + CASE fast_money_potential WHEN 'High' THEN 12 WHEN 'Medium' THEN 6 ELSE 0 END) AS actionability FROM opps""")
def _(t):
    state = F.when(F.col("qualification_score") >= 70, "Qualified").otherwise("Needs Research")
    return t.opps.select("seq", AC.dossier_actionability("contractor_value", F.col("phone").isNotNull(), "evidence_quality", F.col("evidence_count") * 3, state, F.col("fencing_signal_presence"), "fast_money_potential").alias("actionability"))


@query("cl45_recommended_action", """
SELECT seq, CASE WHEN phone IS NOT NULL AND contact_name IS NOT NULL AND contractor = developer THEN 'Call Developer' WHEN phone IS NOT NULL AND contact_name IS NOT NULL AND gc <> 'Unknown' THEN 'Research General Contractor' WHEN p = 'vendor_registration' THEN 'Register Vendor'
  WHEN p = 'trade_partner' THEN 'Register Trade Partner' WHEN p = 'bid_portal' THEN 'Monitor Bid Portal' WHEN gc <> 'Unknown' AND phone IS NULL THEN 'Research General Contractor' WHEN dv <> 'Unknown' AND p IS NULL AND phone IS NULL THEN 'Research Developer'
  WHEN evidence_count > 4 AND p IS NULL AND phone IS NULL THEN 'Wait For Additional Evidence' WHEN p IS NOT NULL OR contact_name IS NOT NULL THEN 'Research General Contractor' ELSE 'Not Actionable' END AS action
FROM (SELECT *, coalesce(general_contractor, '') AS gc, coalesce(developer, '') AS dv, CASE seq % 5 WHEN 0 THEN 'vendor_registration' WHEN 1 THEN 'trade_partner' WHEN 2 THEN 'bid_portal' END AS p FROM opps)""")
def _(t):
    p = F.when(F.col("seq") % 5 == 0, "vendor_registration").when(F.col("seq") % 5 == 1, "trade_partner").when(F.col("seq") % 5 == 2, "bid_portal")
    o = t.opps.withColumn("p", p)
    return o.select("seq", AC.recommended_action("phone", "contact_name", "contractor", "developer", "general_contractor", "p", F.col("evidence_count") > 4, F.col("contact_name").isNotNull()).alias("action"))


@query("sm13_actionability", f"""
SELECT seq, path, least(100, s) AS score, concat_ws('|', CASE WHEN NOT {KNOWN('developer')} THEN 'developer' END, CASE WHEN NOT {KNOWN('general_contractor')} THEN 'general contractor' END, CASE WHEN contact_name IS NULL THEN 'human contact' END,
  CASE WHEN phone IS NULL THEN 'phone' END, CASE WHEN path = 'Unknown' THEN 'access path' END) AS missing FROM (
 SELECT *, CASE WHEN {KNOWN('developer')} THEN 14 ELSE 0 END + CASE WHEN {KNOWN('general_contractor')} THEN 16 ELSE 0 END + CASE WHEN {KNOWN('architect')} THEN 6 ELSE 0 END + CASE WHEN contact_name IS NOT NULL THEN 18 ELSE 0 END + CASE WHEN phone IS NOT NULL THEN 22 ELSE 0 END
  + CASE WHEN email IS NOT NULL THEN 14 ELSE 0 END + CASE WHEN path IN ('Bid portal', 'Public works', 'Plan room') THEN 16 ELSE 0 END + CASE WHEN path <> 'Unknown' THEN 10 ELSE 0 END + CASE WHEN {KNOWN('procurement_route')} THEN 8 ELSE 0 END + 8 AS s FROM (
 SELECT *, CASE WHEN {NK('contractor')} <> '' AND {NK('contractor')} = {NK('general_contractor')} THEN 'Direct GC' WHEN {NK('contractor')} <> '' AND {NK('contractor')} = {NK('developer')} THEN 'Developer' WHEN {rx('procurement_route', 'public|procurement')} THEN 'Public works'
  WHEN {rx('procurement_route', 'trade_partner|trade partner|subcontractor')} THEN 'Subcontractor network' WHEN procurement_route <> 'Unknown' THEN 'Developer' ELSE 'Unknown' END AS path FROM opps))""")
def _(t):
    o = t.opps.withColumn("path", AC.action_path_type("procurement_route", "contractor", "general_contractor", "developer"))
    score = AC.actionability("developer", "general_contractor", "architect", F.col("contact_name").isNotNull(), "phone", "email", "path", "procurement_route", "source_url")
    return o.select("seq", "path", score.alias("score"), F.array_join(AC.missing_intelligence("developer", "general_contractor", F.col("contact_name").isNotNull(), "phone", "path"), "|").alias("missing"))


@query("sm06_qualification_score", f"""
SELECT seq, least(100, CASE WHEN phone IS NOT NULL THEN 18 ELSE 0 END + CASE WHEN contractor_value IN ('High', 'Medium') THEN 18 ELSE 0 END + CASE WHEN {KNOWN('developer')} THEN 12 ELSE 0 END + CASE WHEN {KNOWN('general_contractor')} THEN 12 ELSE 0 END + CASE WHEN evidence_count > 4 THEN 10 ELSE 0 END
  + CASE WHEN fencing_signal_presence THEN 14 ELSE 0 END + CASE WHEN project_stage IN ('Active', 'Planning') THEN 8 ELSE 0 END + CASE evidence_quality WHEN 'High' THEN 8 WHEN 'Medium' THEN 5 ELSE 0 END + CASE fast_money_potential WHEN 'High' THEN 10 WHEN 'Medium' THEN 5 ELSE 0 END) AS score FROM opps""")
def _(t):
    path = F.coalesce(F.col("contractor_value").isin("High", "Medium"), F.lit(False))
    return t.opps.select("seq", AC.qualification_score(F.col("phone").isNotNull(), path, AC.is_set("developer"), AC.is_set("general_contractor"), F.col("evidence_count") > 4,
                                                       F.col("fencing_signal_presence"), "project_stage", "evidence_quality", "fast_money_potential").alias("score"))


@query("sm07_evidence_count", """
SELECT o.seq, 1 + CAST(coalesce(contractor, '') <> '' AS INT) + len(string_split(trade, ', ')) + coalesce(n, 0) AS evidence FROM opps o LEFT JOIN (SELECT opportunity_id, count(*) AS n FROM contacts GROUP BY 1) c ON c.opportunity_id = o.id""")
def _(t):
    n = t.contacts.groupBy(F.col("opportunity_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    named = (F.coalesce("contractor", F.lit("")) != "").cast("int")
    return t.opps.join(n, "id", "left").select("seq", (F.lit(1) + named + F.size(F.split("trade", ", ")) + F.coalesce("n", F.lit(0))).alias("evidence"))
