"""Registered queries: scope rules, evidence reconciliation and their validators."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.base import q, query, rx, sql_first, sql_multi
from plumbline.functions import contacts as C
from plumbline.functions import rules as R
from plumbline.functions import text as X
from plumbline.plans import permits as P
from plumbline.plans import scope as S
from plumbline.plans import vocab as V

TEXT = "project_name || '. ' || project_description || '. ' || project_location"
SCOPE_TEXT = f"({TEXT} || ' ' || trade)"


def texted(t):
    return t.opps.withColumn("text", F.concat_ws(". ", "project_name", "project_description", "project_location"))


def rows(t):
    return S.scope_rows(texted(t), "text", "project_name", "trade")


SCOPE = sql_first(SCOPE_TEXT, [(l, p) for l, p, _ in V.PRIMARY_SCOPES], "Unknown")
CONF = f"CASE {SCOPE} " + " ".join(f"WHEN {q(l)} THEN {c}" for l, _, c in V.PRIMARY_SCOPES) + " ELSE 20 END"
CATS = sql_multi("text", V.PROJECT_CATEGORIES)
WORK = f"coalesce(nullif({sql_multi('text', V.WORK_CATEGORIES)}, ''), replace(trade, ', ', '|'))"
BASE = f"(SELECT *, {TEXT} AS text, {SCOPE} AS scope FROM opps)"


@query("cl22_primary_scope", f"SELECT seq, {SCOPE} AS scope, {CONF} AS confidence FROM opps")
def _(t):
    s = S.primary_scope(F.concat_ws(" ", "text", "trade"))
    return texted(t).withColumn("s", s).select("seq", F.col("s.label").alias("scope"), F.col("s.confidence").alias("confidence"))


@query("cl23_project_categories", f"SELECT seq, {CATS} AS categories FROM {BASE}")
def _(t):
    return texted(t).select("seq", F.array_join(S.project_categories("text"), "|").alias("categories"))


@query("cl24_work_categories", f"SELECT seq, {WORK} AS categories FROM {BASE}")
def _(t):
    return texted(t).select("seq", F.array_join(S.work_categories("text", F.array().cast("array<string>"), "trade"), "|").alias("categories"))


PRIMARY_WORK = f"CASE WHEN scope <> 'Unknown' THEN scope ELSE coalesce({sql_first('text', V.PRIMARY_WORK)}, string_split(work, '|')[1], 'Unknown') END"
PTYPE = f"""CASE WHEN scope = 'Fence / gate installation' THEN 'Fence / Gate Installation' WHEN scope = 'Electrical / landscape lighting' THEN 'Electrical / Landscape Lighting'
  ELSE coalesce({sql_first('text', V.SCOPE_PROJECT_TYPES)}, CASE WHEN pw <> 'Unknown' THEN pw ELSE trim(project_name) END) END"""


@query("cl25_primary_work", f"""
SELECT seq, pw AS primary_work, {PTYPE} AS project_type, CASE WHEN {rx('text', V.DIRECT_WORK)} THEN 85 WHEN work <> '' THEN 65 ELSE 35 END AS trade_confidence
FROM (SELECT *, {PRIMARY_WORK} AS pw FROM (SELECT *, {WORK} AS work FROM {BASE}))""")
def _(t):
    return rows(t).select("seq", "primary_work", F.col("scope_project_type").alias("project_type"), "trade_confidence")


GROUPS = ", ".join("CASE WHEN " + rx("text", p) + " THEN [" + ", ".join(q(x) for x in ts) + "] ELSE [] END" for ts, p in V.LIKELY_TRADE_GROUPS)


@query("cl25_likely_trades", f"""
SELECT seq, array_to_string(list_slice(list_transform(list_filter(list_transform(l, lambda x, i: CASE WHEN list_position(l, x) = i THEN x END), lambda x: x IS NOT NULL), lambda x: x), 1, 8), '|') AS trades
FROM (SELECT seq, flatten([{GROUPS}, CASE WHEN {rx('text', V.FENCE_INSTALL_LANGUAGE)} OR scope = 'Fence / gate installation' THEN ['Fencing'] ELSE [] END,
  list_transform(string_split(work, '|'), lambda c: regexp_replace(c, ' improvements$', ''))]) AS l FROM (SELECT *, {WORK} AS work FROM {BASE}))""")
def _(t):
    return rows(t).select("seq", F.array_join("likely_trades", "|").alias("trades"))


N = lambda rules: "(" + " + ".join(f"CAST({rx('text', p)} AS INT)" for _, p in rules) + ")"
OFF = "(scope NOT IN ('Unknown', 'Fence / gate installation'))"
SIGNALS = f"""SELECT *, {N(V.FENCE_STRONG)} AS ns, {N(V.FENCE_WEAK)} AS nw, {N(V.FENCE_CONTEXT)} AS nc, CASE WHEN scope = 'Fence / gate installation' THEN 0 ELSE {N(V.FENCE_NEGATIVE)} END AS nn,
  {OFF} AS off, {rx("'|' || " + CATS, '[|](Schools|Parks|Industrial|Housing)')} AS bonus FROM {BASE}"""
SCORED = f"""SELECT *, greatest(0, least(100, ns * 30 + nw * 8 + nc * 10 - nn * 18 - CASE WHEN ns = 0 AND nn > 0 THEN 22 ELSE 0 END - CASE WHEN ns = 0 AND off THEN 30 ELSE 0 END
  + CASE WHEN ns > 0 AND bonus THEN 12 ELSE 0 END)) AS score FROM ({SIGNALS})"""


def quoted(label: str, pattern: str) -> str:
    """The sentence around the first hit of a strong rule, as ``label=sentence``; NULL without one."""
    pos = f"(length(regexp_extract(text, {q('^((?:.|' + chr(10) + ')*?)(?:' + pattern + ')')}, 1, 'i')) + 1)"
    start = f"(CASE WHEN contains(substr(text, 1, {pos} - 1), '.') THEN {pos} - length(split_part(reverse(substr(text, 1, {pos} - 1)), '.', 1)) ELSE 1 END)"
    stop = f"(CASE WHEN strpos(substr(text, {pos}), '.') > 0 THEN {pos} + strpos(substr(text, {pos}), '.') - 1 ELSE least(length(text), {pos} - 1 + 180) END)"
    return f"CASE WHEN {rx('text', pattern)} THEN {q(label)} || '=' || trim(regexp_replace(substr(text, {start}, {stop} - {start} + 1), '\\s+', ' ', 'g')) END"


@query("cl26_fence_signals", f"""
SELECT seq, concat_ws('|', {', '.join(quoted(*rule) for rule in V.FENCE_STRONG)}) AS snippets, ns AS strong, nw AS weak, nc AS context, nn AS negative, score, CASE WHEN ns > 0 THEN 'direct' WHEN nw > 0 THEN 'weak' WHEN nc > 0 THEN 'contextual' ELSE 'none' END AS tier FROM ({SCORED})""")
def _(t):
    n = lambda c: F.size(c).alias(c)
    said = F.array_join(F.transform("fence_snippets", lambda s: F.concat(s["signal"], F.lit("="), s["snippet"])), "|").alias("snippets")
    return rows(t).select("seq", said, n("strong"), n("weak"), n("context"), n("negative"), F.col("fence_score").alias("score"), F.col("fence_tier").alias("tier"))


BLOCK = [(l, p) for l, p in V.FENCE_NEGATIVE if any(x in l for x in S.BLOCKING_NEGATIVES.split("|"))]
LADDER = f"""CASE WHEN off AND ns = 0 THEN 'No Evidence' WHEN ns = 0 AND scope <> 'Fence / gate installation' AND {N(BLOCK)} > 0 THEN 'No Evidence' WHEN ns > 0 AND score >= 78 THEN 'Primary Opportunity'
  WHEN ns > 0 AND score >= 54 THEN 'Secondary Opportunity' WHEN ns > 0 THEN 'Possible Opportunity' WHEN nw > 0 THEN 'Weak Opportunity' WHEN nc > 0 AND NOT off THEN 'Weak Opportunity' ELSE 'No Evidence' END"""
LADDERED = f"SELECT *, {LADDER} AS ladder FROM ({SCORED})"


@query("cl27_scope_confidence", f"""
SELECT seq, ladder AS confidence, CASE ladder WHEN 'Primary Opportunity' THEN 90 WHEN 'Secondary Opportunity' THEN 72 WHEN 'Possible Opportunity' THEN 52 WHEN 'Weak Opportunity' THEN (CASE WHEN nw > 0 THEN 20 ELSE 24 END) ELSE 5 END AS score FROM ({LADDERED})""")
def _(t):
    return rows(t).select("seq", F.col("fence_scope_confidence").alias("confidence"), F.col("fence_scope_score").alias("score"))


BIDABLE = "(ladder IN ('Primary Opportunity', 'Secondary Opportunity') OR (ladder = 'Possible Opportunity' AND NOT off))"


@query("cl28_bidability", f"""
SELECT seq, {BIDABLE} AS bidable, CASE WHEN ladder = 'Primary Opportunity' THEN 'Strong direct fencing evidence; primary fencing opportunity.' WHEN ladder = 'Secondary Opportunity' THEN 'Direct fencing evidence supports bidding as a secondary scope.'
  WHEN ladder = 'Possible Opportunity' AND off THEN 'Primary scope is ' || scope || '; fencing is incidental and not bidable.' WHEN ladder = 'Possible Opportunity' THEN 'Possible fencing scope; consider bidding with qualification.'
  WHEN ladder = 'Weak Opportunity' THEN 'Weak or contextual fencing signals only; not bidable without additional confirmation.' WHEN off THEN 'Primary scope is ' || scope || '; no fencing evidence found.' ELSE 'No fencing evidence found; not bidable.' END AS reason FROM ({LADDERED})""")
def _(t):
    return rows(t).select("seq", "bidable", F.col("bid_reason").alias("reason"))


HAS = lambda *c: "(" + " OR ".join(f"list_contains(cats, {q(x)})" for x in c) + ")"


@query("cl29_potential_scope", f"""
SELECT seq, CASE WHEN ns > 0 AND NOT off THEN array_to_string(list_slice(list_filter(list_transform(l, lambda x, i: CASE WHEN list_position(l, x) = i THEN x END), lambda x: x IS NOT NULL), 1, 5), '|') ELSE '' END AS packages FROM (
  SELECT seq, ns, off, flatten([CASE WHEN {HAS('Housing')} THEN ['Perimeter fencing', 'Community fencing', 'Construction fencing'] ELSE [] END, CASE WHEN {HAS('Parks', 'Schools')} THEN ['Public access separation', 'Decorative fencing'] ELSE [] END,
    CASE WHEN {HAS('Utilities', 'Drainage', 'Infrastructure')} THEN ['Construction fencing', 'Access control gates'] ELSE [] END, CASE WHEN {HAS('Industrial', 'Security')} THEN ['Security fencing', 'Access control gates'] ELSE [] END]) AS l
  FROM (SELECT *, string_split({CATS}, '|') AS cats FROM ({SIGNALS})))""")
def _(t):
    return rows(t).select("seq", F.array_join("potential_scope", "|").alias("packages"))


@query("cl30_contradictions", f"""
WITH r AS (SELECT *, {BIDABLE} AS bid, evidence_count % 3 AS pos, access_score % 2 AS wk, qualification_score % 2 AS neg, greatest(0, least(100, (evidence_count % 3) * 34)) AS sig FROM ({LADDERED})),
c AS (SELECT *, CASE WHEN neg > 0 AND pos = 0 THEN 'No Evidence' WHEN pos = 0 AND (NOT bid OR scope IN ({", ".join(q(x) for x in V.VETO_SCOPES)})) THEN 'No Evidence'
  WHEN pos > 0 AND (sig >= 72 OR pos >= 2) THEN (CASE WHEN ladder = 'Primary Opportunity' THEN ladder ELSE 'Secondary Opportunity' END) WHEN pos > 0 AND ladder NOT IN ('Primary Opportunity', 'Secondary Opportunity') THEN 'Possible Opportunity' WHEN pos > 0 THEN ladder
  WHEN wk > 0 THEN 'Weak Opportunity' ELSE ladder END AS fin FROM r)
SELECT seq, fin AS final_confidence, pos > 0 AND fin IN ('Primary Opportunity', 'Secondary Opportunity', 'Possible Opportunity') AS evidence_bidable,
  CASE WHEN fin = 'Weak Opportunity' THEN 'Insufficient evidence to determine likely fencing scope.' WHEN fin = 'No Evidence' THEN 'No fencing scope generated.' ELSE 'Unknown' END AS likely_fence_scope,
  CAST(pos = 0 AND NOT bid AS INT) + CAST(pos = 0 AND bid AND scope IN ({", ".join(q(x) for x in V.VETO_SCOPES)}) AS INT) + CAST(pos > 0 AS INT) + CAST(pos = 0 AND bid AND scope NOT IN ({", ".join(q(x) for x in V.VETO_SCOPES)}) AND wk > 0 AS INT)
  + CAST(neg > 0 AND pos = 0 AS INT) + CAST(fin = 'Weak Opportunity' AS INT) + CAST(fin = 'No Evidence' AS INT) AS notes FROM c""")
def _(t):
    r = rows(t).withColumn("pos", F.col("evidence_count") % 3).withColumn("wk", F.col("access_score") % 2).withColumn("neg", F.col("qualification_score") % 2)
    r = r.withColumn("sig", R.clamp(F.col("pos") * 34)).withColumn("none", F.lit(""))
    out = S.with_contradictions(r, "fence_scope_confidence", "bidable", "bid_reason", "primary_scope", "pos", "wk", "neg", "sig", "none")
    return out.select("seq", "final_confidence", "evidence_bidable", "likely_fence_scope", F.size("notes").alias("notes"))


@query("cl31_improvements_objective", f"""
SELECT seq, {sql_multi('text', V.ASSOCIATED_IMPROVEMENTS)} AS improvements, CASE WHEN u <> '' THEN u WHEN {rx('text', 'subdivision|village|residential|homes|lots')} THEN 'Related residential development identified' ELSE 'Unknown' END AS related,
  {sql_first('text', V.PRIMARY_OBJECTIVES, 'Unknown')} AS objective FROM (SELECT seq, text, regexp_extract(text, '\\b\\d{{2,5}}\\s+(?:planned\\s+)?(?:residential\\s+)?(?:units|homes|lots)\\b', 0, 'i') AS u FROM docs)""")
def _(t):
    return t.docs.select(
        "seq", F.array_join(S.associated_improvements("text", F.array().cast("array<string>")), "|").alias("improvements"),
        S.related_development("text").alias("related"), S.primary_objective("text", F.lit("")).alias("objective"))


S_SQL = "lower(work_description || ' ' || project_name)"
FENCE_OK = f"""CASE WHEN NOT {rx('s', chr(92) + 'bfenc(?:e|es|ing)' + chr(92) + 'b')} THEN false WHEN {rx('s', V.FENCE_INTENT)} THEN true WHEN {rx('s', V.FENCE_INCIDENTAL)} THEN false
  WHEN {rx('s', V.FENCE_OTHER_WORK)} AND NOT {rx('s', V.FENCE_OTHER_WORK_UNLESS)} THEN false ELSE {rx('s', V.FENCE_WORDS)} AND {rx('s', V.FENCE_ACTIONS)} END"""
GATE_OK = f"""CASE WHEN {rx('s', 'golden' + chr(92) + 's+gate')} THEN false WHEN {rx('s', 'a-gate')} THEN false WHEN {rx('s', V.GATE_STREET)} AND NOT {rx('s', V.GATE_ACTION)} AND NOT {rx('s', V.GATE_DIRECT)} THEN false
  WHEN {rx('s', V.GATE_OTHER_WORK)} AND NOT {rx('s', V.GATE_OTHER_WORK_UNLESS)} THEN false ELSE {rx('s', chr(92) + 'bgates?' + chr(92) + 'b')} END"""


@query("fl12_intentional_mentions", f"SELECT seq, {FENCE_OK} AS fence, {GATE_OK} AS gate FROM (SELECT seq, {S_SQL} AS s FROM permits_a)")
def _(t):
    s = F.concat_ws(" ", "work_description", "project_name")
    return t.permits_a.select("seq", S.intentional_fence(s).alias("fence"), S.intentional_gate(s).alias("gate"))


@query("sm17_evidence_strength", """
SELECT opportunity_id, greatest(0, least(100, least(40, count(*) * 10) + count(DISTINCT source) * 8 + least(35, count(*) FILTER (phone <> '') * 5) - least(30, count(*) FILTER (email = '') * 10))) AS strength FROM contacts GROUP BY 1""")
def _(t):
    g = t.contacts.groupBy("opportunity_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("k"), F.count_if(F.col("phone") != "").alias("p"), F.count_if(F.col("email") == "").alias("m"))
    return g.select("opportunity_id", S.evidence_strength("n", "k", "p", "m").alias("strength"))


# --- predicates -----------------------------------------------------------------------------
def placeholder(expr: str) -> str:
    return "(" + " OR ".join(rx(expr, p) for p in C.PLACEHOLDER_PATTERNS) + ")"


@query("fl07_placeholder", f"SELECT seq, {placeholder('''concat_ws(' ', nullif(contractor, ''), nullif(project_name, ''))''')} AS placeholder FROM permits_a")
def _(t):
    return t.permits_a.select("seq", C.is_placeholder("contractor", "project_name").alias("placeholder"))


@query("fl07_placeholder_documents", f"SELECT doc_id FROM documents WHERE {placeholder('lower(text)')}")
def _(t):
    # ASCII-only word edges: letters outside a-z are blanked first, so \b agrees everywhere
    return t.documents.filter(C.is_placeholder(F.lower("text"))).select("doc_id")


@query("fl08_human_name", """
SELECT contact_seq, name <> '' AND NOT regexp_matches(name, '\\d|@') AND len(list_filter(string_split(name, ' '), lambda w: w <> '')) BETWEEN 2 AND 4
  AND len(list_filter(string_split(name, ' '), lambda w: NOT regexp_full_match(w, '[A-Z][A-Za-z''.-]+'))) = 0 AS human FROM contacts""")
def _(t):
    return t.contacts.select("contact_seq", C.is_human_name("name").alias("human"))


@query("fl09_looks_like_org", f"SELECT seq, {rx('applicant', chr(92) + 'b(llc|inc|corp|company|homes|developers?|builders?|partners|group|holdings)' + chr(92) + 'b')} AS org FROM planning")
def _(t):
    return t.planning.select("seq", C.looks_like_org("applicant").alias("org"))


@query("fl10_actionable_contact", f"""
SELECT contact_seq, company <> '' AND confidence >= 0.65 AND NOT {placeholder("concat_ws(' ', nullif(company, ''), nullif(name, ''), nullif(phone, ''), nullif(email, ''), source)")} AND (phone <> '' OR email <> '') AS actionable FROM contacts""")
def _(t):
    none = F.lit(None).cast("string")
    return t.contacts.select("contact_seq", C.is_actionable_contact("company", "name", "phone", "email", none, "source", "confidence").alias("actionable"))


@query("fl11_planning_noise", f"SELECT seq FROM planning WHERE NOT ({rx('b', V.PLANNING_NOISE)} AND NOT {rx('b', V.PLANNING_NOISE_KEEP)})".replace("FROM planning", "FROM (SELECT seq, title || ' ' || description || ' ' || entitlement AS b FROM planning)"))
def _(t):
    b = F.concat_ws(" ", "title", "description", "entitlement")
    return t.planning.filter(~(P.is_planning_noise(b) & ~R.matches(b, V.PLANNING_NOISE_KEEP))).select("seq")


@query("fl18_fetchable_url", """
SELECT page_id AS id, regexp_matches(url, '^https?://', 'i') AND NOT regexp_matches(url, '/datasets|maps\\.arcgis|arcgis\\.com/apps', 'i') AS fetchable FROM pages UNION ALL
SELECT seq, regexp_matches(ui_link, '^https?://', 'i') FROM notices""")
def _(t):
    return t.pages.select(F.col("page_id").alias("id"), C.is_fetchable("url").alias("fetchable")).unionByName(
        t.notices.select(F.col("seq").alias("id"), C.is_fetchable("ui_link").alias("fetchable")))


@query("fl25_contact_flags", f"""
SELECT contact_seq, {rx("concat_ws(' ', title, name, contact_type)", C.PROJECT_MANAGER_TITLES)} AS pm, {rx("concat_ws(' ', title, name)", C.ESTIMATOR_TITLES)} AS estimator, {rx('company', C.SELF_PERFORMING_FENCE)} AS self_performing,
  CASE WHEN {rx("concat_ws(' ', title, name, contact_type)", C.PROJECT_MANAGER_TITLES)} THEN 'Project Manager' WHEN {rx("concat_ws(' ', title, name)", C.ESTIMATOR_TITLES)} THEN 'Estimator / Purchasing' WHEN title = 'Named site business' THEN 'Owner / Site Business'
  WHEN contact_type = 'construction' THEN 'General Contractor Office' ELSE coalesce(nullif(title, ''), 'Company Office') END AS role_label FROM contacts""")
def _(t):
    return t.contacts.select(
        "contact_seq", C.project_manager_like("title", "name", "contact_type").alias("pm"), C.estimator_like("title", "name").alias("estimator"),
        C.self_performing_trade("company", F.lit(""), F.lit(0)).alias("self_performing"), C.contact_role_label("title", "name", "contact_type", F.lit("")).alias("role_label"))
