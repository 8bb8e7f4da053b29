"""Registered queries: search-time facets, gates and pursuit scores (CL-36..38, CL-46, CL-47, CL-53, FL-11..23, SM-11, SM-12, SR-09, SR-11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.base import q, query, rx, sql_first, sql_hits
from plumbline.catalog.classify_scope import texted
from plumbline.catalog.scalar import STOPS
from plumbline.catalog.scoring_trades import BEST, BLOB_COLS, MATRIX
from plumbline.functions import text as X
from plumbline.operators import relational as R
from plumbline.operators import search as S
from plumbline.plans import access as AC
from plumbline.plans import packages as PK
from plumbline.plans import scope as SC
from plumbline.plans import trades as TR
from plumbline.plans import vocab as V
from plumbline.session import ensure_checkpoint_dir

KNOWN = "(coalesce({0}, '') <> '' AND NOT regexp_matches(lower({0}), '^unknown\\b'))"
CUES = f"""
WITH b AS (SELECT *, project_name || ' ' || project_description AS text, project_description AS summary, CASE seq % 5 WHEN 0 THEN 'Primary Opportunity' WHEN 1 THEN 'Secondary Opportunity' WHEN 2 THEN 'Weak Opportunity' WHEN 3 THEN 'No Evidence' ELSE 'Other' END AS conf,
  CASE seq % 4 WHEN 0 THEN 'Major Very High' WHEN 1 THEN 'Large High' WHEN 2 THEN 'Medium Medium' ELSE 'Small Low' END AS sizes, seq % 3 AS pos FROM opps),
c AS (SELECT *, NOT {rx('project_name', V.NOT_HOUSING_NAMES)} AND (({rx("text || ' ' || lower(coalesce(developer, ''))", V.PRODUCTION_BUILDERS)} AND ({rx('text', V.SUBDIVISION_CUES)} OR {rx('text', V.HOUSING_NAMES)})) OR ({rx('text', V.SUBDIVISION_CUES)} AND ({rx('text', V.HOUSING_NAMES)} OR {KNOWN.format('developer')}))) AS housing,
  NOT (({rx('text', V.SIDE_SCOPE_PRIMARY)} OR {rx('project_name', V.SIDE_SCOPE_PRIMARY_NAME)}) AND NOT {rx('project_name', V.SIDE_SCOPE_NAME)}) AND {rx('text', V.SIDE_SCOPE)} AS side_scope FROM b),
d AS (SELECT *, NOT housing AND NOT {rx('text', V.TINY_KEEP)} AND ({' OR '.join(rx('text', p) for p in V.TINY_RESIDENTIAL)}) AS tiny, CASE WHEN conf IN ('Weak Opportunity', 'No Evidence') THEN false WHEN conf IN ('Primary Opportunity', 'Secondary Opportunity') THEN true ELSE pos > 0 END AS direct FROM c),
s0 AS (SELECT *, greatest(1, CASE WHEN housing THEN 4 ELSE 0 END, CASE WHEN {rx('text', V.PACKAGE_CUES)} OR {rx('text', V.LONG_RUN)} THEN 3 ELSE 0 END, CASE WHEN {rx('sizes', 'major|very high')} THEN 4 WHEN {rx('sizes', 'large|high')} THEN 3 WHEN {rx('sizes', 'medium')} THEN 2 ELSE 0 END) AS s,
  direct AND conf IN ('Primary Opportunity', 'Secondary Opportunity') AND {rx('project_name', 'gate|fence|fencing')} AS strong FROM d),
s1 AS (SELECT * REPLACE (CASE WHEN side_scope AND NOT strong THEN least(s, 1) ELSE s END AS s) FROM s0),
sc AS (SELECT *, CASE WHEN tiny THEN 0 WHEN direct AND {rx('text', 'fence|fencing|security fence|chain[-' + chr(92) + 's]?link')} AND s < 2 THEN 2 ELSE s END AS scale FROM s1)"""


def cued(t):
    m = lambda n, vals, other: F.when(F.col("seq") % n == 0, vals[0]).when(F.col("seq") % n == 1, vals[1]).when(F.col("seq") % n == 2, vals[2]).otherwise(other)
    conf = F.when(F.col("seq") % 5 == 3, "No Evidence").otherwise(m(5, ["Primary Opportunity", "Secondary Opportunity", "Weak Opportunity"], "Other"))
    o = t.opps.withColumn("text", F.concat_ws(" ", "project_name", "project_description")).withColumn("summary", F.col("project_description"))
    o = o.withColumn("conf", conf).withColumn("sizes", m(4, ["Major Very High", "Large High", "Medium Medium"], "Small Low")).withColumn("pos", F.col("seq") % 3)
    o = PK.with_package_cues(o, "text")
    o = o.withColumn("direct", PK.direct_pursuit("conf", "pos"))
    return o.withColumn("scale", PK.package_scale("text", "project_name", "sizes", F.col("direct"), "conf"))


@query("cl36_package_scale", CUES + " SELECT seq, housing, side_scope, tiny, scale FROM sc")
def _(t):
    return cued(t).select("seq", "housing", "side_scope", "tiny", "scale")


SIZE_F = f"""CASE WHEN housing OR {rx('sizes', 'major|very high')} THEN 'development' WHEN {rx('sizes', 'large|high')} AND NOT {rx('sizes', 'tiny|small|low')} THEN 'commercial' WHEN scale >= 3 THEN 'development' WHEN scale >= 2 THEN 'commercial' WHEN {rx('text', V.COMMERCIAL_TEXT)} THEN 'commercial' ELSE 'small' END"""
TYPE_F = f"CASE WHEN side_scope THEN 'side_scope' WHEN housing THEN 'subdivision' WHEN {rx('text', V.PUBLIC_SITE)} THEN 'public_site' ELSE 'commercial_package' END"
FACETS = CUES + f""", f AS (SELECT *, {SIZE_F} AS package_size, CASE WHEN phone IS NOT NULL THEN 'phone' ELSE 'research' END AS contact_status, {TYPE_F} AS job_type FROM sc)"""


def faceted(t):
    o = cued(t)
    o = o.withColumn("package_size", PK.package_size_facet("sizes", "scale", "text")).withColumn("contact_status", F.when(PK.has_phone("phone"), "phone").otherwise("research"))
    return o.withColumn("job_type", PK.job_type_facet("text")).withColumn("facet_trade", F.col("trade")).withColumn("facet_location", X.location_label("city", "county"))


@query("cl36_search_facets", FACETS + " SELECT seq, package_size, contact_status, job_type FROM f")
def _(t):
    return faceted(t).select("seq", "package_size", "contact_status", "job_type")


@query("ag06_search_facet_counts", FACETS + """ SELECT k.facet, k.value, count(f.seq) AS count FROM (VALUES ('size', 'development'), ('size', 'commercial'), ('size', 'small'), ('contact', 'phone'), ('contact', 'research'), ('type', 'subdivision'), ('type', 'commercial_package'), ('type', 'public_site'), ('type', 'side_scope')) k(facet, value)
  LEFT JOIN f ON (k.facet = 'size' AND package_size = k.value) OR (k.facet = 'contact' AND contact_status = k.value) OR (k.facet = 'type' AND job_type = k.value) GROUP BY 1, 2
UNION ALL (SELECT 'location', city || ', ' || county, count(*) FROM f GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 12)""")
def _(t):
    from plumbline.operators.aggregate import facet_counts

    return facet_counts(faceted(t), {"size": "package_size", "contact": "contact_status", "type": "job_type", "location": "facet_location"}, V.FACET_VALUES, {"location": 12})


@query("fl16_facet_filter", FACETS + " SELECT seq FROM f WHERE package_size IN ('development', 'small') AND contact_status = 'phone' AND lower(trade) = 'roofing' AND contains(lower(city || ', ' || county), 'el dorado')")
def _(t):
    params = PK.facet_params({"size": "development,small,huge", "contact": "phone", "trade": "roofing", "location": "el dorado"})
    return PK.facet_filter(faceted(t), params).select("seq")


@query("cl37_csi_divisions", "SELECT seq, CASE trade " + " ".join(f"WHEN {q(k)} THEN {q('|'.join(v))}" for k, v in V.CSI_DIVISIONS.items()) + " ELSE '' END AS divisions FROM opps")
def _(t):
    return t.opps.select("seq", F.array_join(PK.csi_divisions("trade"), "|").alias("divisions"))


CONC = PK.SCOPE_TEXTS["Concrete"]
ACT = sql_first("txt", PK.ACTION_SCOPES, "Construction fencing")


@query("cl38_likely_scope", f"""
SELECT seq, coalesce({sql_first('txt', CONC)}, 'Concrete work') AS concrete, CASE WHEN {rx('txt', PK.ACTION_FENCE)} THEN {ACT} ELSE 'Fencing scope' END AS action FROM (SELECT seq, lower(project_name || ' ' || project_description) AS txt FROM opps)""")
def _(t):
    o = t.opps.withColumn("txt", F.lower(F.concat_ws(" ", "project_name", "project_description"))).withColumn("housing", F.lit(False))
    none = F.lit(None).cast("string")
    return o.select("seq", PK.likely_scope("Concrete", "txt", none, F.lit(True), F.lit(False), none, none).alias("concrete"), PK.action_scope(F.lit("Fencing"), "txt").alias("action"))


LIMITED = [(l, t) for l, t, tr in PK.SCOPE_CATEGORY_RULES if not tr or "Fencing" in tr]


@query("cl46_scope_categories", "SELECT seq, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {sql_hits('txt', t)} > 0 THEN {q(l)} END" for l, t in LIMITED) + "], lambda x: x IS NOT NULL)[1:8], '|') AS labels FROM (SELECT seq, lower(project_name || ' ' || project_description) AS txt FROM opps)")
def _(t):
    return t.opps.withColumn("txt", F.lower(F.concat_ws(" ", "project_name", "project_description"))).select("seq", F.array_join(PK.scope_categories("txt", "Fencing"), "|").alias("labels"))


@query("cl47_outreach_timing", """
SELECT seq, CASE WHEN regexp_matches(project_stage, 'permit issued|construction|open|active', 'i') THEN (CASE WHEN phone IS NOT NULL THEN 'Call this week' ELSE 'Find a phone and call within a few days' END) WHEN regexp_matches(project_stage, 'planning|entitlement|design', 'i') THEN 'Early intro call before bidding starts' ELSE 'Confirm a contact before calling' END AS timing,
  CASE WHEN contractor_value IS NOT NULL THEN contractor_value WHEN fast_money_potential = 'High' THEN 'Likely still open to subcontractors' WHEN fast_money_potential = 'Low' THEN 'May already be covered' ELSE 'Bid window not confirmed' END AS bid_status FROM opps""")
def _(t):
    return t.opps.select("seq", PK.outreach_timing("project_stage", F.col("phone").isNotNull()).alias("timing"), PK.bid_status("contractor_value", "fast_money_potential").alias("bid_status"))


@query("cl53_result_explanations", f"""
SELECT seq, CASE WHEN project_description <> '' AND NOT {rx('project_description', PK.CONTAMINATION)} THEN (CASE WHEN length(project_description) <= 110 THEN project_description ELSE trim(substr(project_description, 1, 109)) || '…' END) ELSE 'Roofing work indicated in source records' END AS line,
  CASE opportunity_state WHEN 'Actionable Opportunity' THEN 'Ready to call' WHEN 'Research Required' THEN 'Needs research' ELSE 'Worth pursuing' END AS readiness,
  CASE WHEN phone IS NOT NULL AND contact_name IS NOT NULL THEN contact_name || coalesce(' (' || contact_title || ')', '') || ' has a phone on file for this project.' WHEN coalesce(contractor, '') <> '' THEN contractor || ' is the company listed on the project record.' WHEN coalesce(developer, '') <> '' THEN developer || ' is the developer listed on the project record.' ELSE 'No direct contact is confirmed in the source records yet.' END AS why FROM opps""")
def _(t):
    conf = F.when(F.col("opportunity_state") == "Actionable Opportunity", "High Confidence").when(F.col("opportunity_state") == "Research Required", "x").otherwise("Medium Confidence")
    none = F.lit(None).cast("string")
    return t.opps.select("seq", PK.scope_line("project_description", F.array().cast("array<string>"), "Roofing").alias("line"), PK.readiness_label(conf).alias("readiness"),
                         PK.why_contact(none, "contact_name", "contact_title", "phone", none, "contractor", "developer", "Roofing").alias("why"))


@query("fl11_package_noise", CUES + f" SELECT seq, tiny, side_scope, {' OR '.join(rx('project_name', p) for p in V.NON_FENCE_PERMIT)} AS non_fence_permit FROM sc")
def _(t):
    return cued(t).select("seq", "tiny", "side_scope", "non_fence_permit")


@query("fl13_trade_evidence", f"""
SELECT seq, {sql_hits('txt', V.TRADE_EVIDENCE_TERMS['Roofing'])} > 0 OR (NOT contains(trade, ',') AND contains(lower(trade), 'roofing')) AS roofing FROM (SELECT *, regexp_replace(lower(project_name || ' ' || project_description), {q(V.BOILERPLATE)}, ' ', 'g') AS txt FROM opps)""")
def _(t):
    o = t.opps.withColumn("txt", F.concat_ws(" ", "project_name", "project_description"))
    return o.select("seq", PK.has_trade_evidence("txt", "trade", "Roofing").alias("roofing"))


@query("fl14_search_gates", CUES + """ SELECT seq, NOT (seq % 2 = 0) AND NOT housing AS suppressed, CASE WHEN NOT (seq % 2 = 0) AND NOT housing THEN false ELSE direct OR housing END AS matches FROM sc""")
def _(t):
    o = cued(t).withColumn("bid", F.col("seq") % 2 == 0)
    return o.select("seq", PK.suppress_fencing(["Fencing"], F.col("bid"), "conf", "pos").alias("suppressed"), PK.scope_matches(["Fencing"], F.col("bid"), "conf", "pos", "text", "trade", {}, {}).alias("matches"))


SIG = "[" + ", ".join(f"CASE WHEN {rx('text', p)} THEN {q(l)} END" for l, p in V.FENCE_STRONG + V.FENCE_WEAK) + "]"


@query("fl15_positive_evidence", f"""
SELECT seq, len(list_filter(list_filter({SIG}, lambda x: x IS NOT NULL), lambda s: (regexp_matches(s, {q(V.POSITIVE_FENCE_STRONG)}, 'i') OR regexp_matches(s, {q(V.POSITIVE_FENCE)}, 'i')) AND NOT regexp_matches(s, {q(V.INCIDENTAL_FENCE)}, 'i'))) AS positives
FROM (SELECT seq, concat_ws('. ', project_name, project_description, project_location) AS text FROM opps)""")
def _(t):
    from plumbline.functions.rules import multi_label

    o = texted(t).withColumn("labels", multi_label("text", V.FENCE_STRONG + V.FENCE_WEAK))
    return o.select("seq", F.size(PK.positive_evidence(F.col("labels"))).cast("bigint").alias("positives"))


@query("fl21_trade_safe_text", f"SELECT seq, CASE WHEN NOT {rx('project_description', PK.CONTAMINATION)} THEN project_description END AS safe FROM opps")
def _(t):
    return t.opps.select("seq", PK.trade_safe("project_description", "Roofing").alias("safe"))


@query("fl22_visible_projects", "SELECT seq FROM opps WHERE opportunity_state <> 'Opportunity' OR evidence_count > 3")
def _(t):
    return PK.visible_projects(t.opps, "opportunity_state", "evidence_count", 3).select("seq")


@query("fl23_callable_contact", "SELECT o.seq, o.phone IS NOT NULL OR max(nullif(c.phone, '')) IS NOT NULL AS callable, NOT regexp_matches(lower(procurement_route), '^unknown') AS has_path FROM opps o LEFT JOIN contacts c ON c.opportunity_id = o.id GROUP BY o.seq, o.phone, o.procurement_route")
def _(t):
    c = t.contacts.groupBy(F.col("opportunity_id").alias("id")).agg(F.max(F.nullif("phone", F.lit(""))).alias("other_phone"))
    return t.opps.join(c, "id", "left").select("seq", PK.has_phone("phone", "other_phone").alias("callable"), PK.has_access_path("procurement_route").alias("has_path"))


PQ = """SELECT *, greatest(0, least(100, 42 + CASE WHEN dm THEN 18 ELSE -10 END + CASE WHEN ph THEN 26 ELSE -14 END + CASE WHEN co THEN 14 ELSE -8 END + CASE WHEN pa THEN 16 ELSE -12 END + CASE WHEN ro THEN 12 ELSE -8 END + 8 + CASE WHEN access_score >= 70 THEN 6 ELSE 0 END)) AS pursuit
FROM (SELECT *, contact_name IS NOT NULL AS dm, phone IS NOT NULL AS ph, coalesce(contractor, '') NOT IN ('', 'To Be Determined') AS co, access_route <> 'Unknown' AS pa, procurement_route <> 'Unknown' AS ro FROM opps)"""


@query("sm12_pursuit_quality", f"""
SELECT seq, pursuit, CASE WHEN ph AND (dm OR co) AND (pa OR ro) THEN 'High Confidence' WHEN (ph OR dm OR pa OR ro) AND ((ph AND co) OR (co AND pa) OR (ph AND pa) OR pursuit >= 60) THEN 'Medium Confidence' ELSE 'Research Required' END AS confidence FROM ({PQ})""")
def _(t):
    return pursued(t.opps).select("seq", "pursuit", F.col("pursuit_confidence").alias("confidence"))


def pursued(o):
    from plumbline.functions import contacts as C

    k = {"dm": C.is_known("contact_name"), "ph": C.is_known("phone"), "co": C.is_known("contractor"), "pa": PK.has_access_path("access_route"), "ro": C.is_known("procurement_route")}
    for name, c in k.items():
        o = o.withColumn(name, c)
    b = [F.col(n) for n in ("dm", "ph", "co", "pa", "ro")]
    o = o.withColumn("pursuit", PK.pursuit_quality(*b, F.lit(True), F.col("access_score") >= 70, F.lit(False)))
    return o.withColumn("pursuit_confidence", PK.pursuit_confidence("pursuit", *b))


@query("sm11_search_score", CUES + """ SELECT seq, greatest(0, least(100, CAST(floor((CASE conf WHEN 'Primary Opportunity' THEN 5 WHEN 'Secondary Opportunity' THEN 4 WHEN 'Weak Opportunity' THEN 1 ELSE 0 END * 1400 + fence_probability * 32 + least(100, pos * 30) * 24 + least(qualification_score, 100) * 18 + access_score * 12 + 50) / 100) AS INT))) AS fencing_score,
  CASE WHEN housing THEN greatest(qualification_score, 58) WHEN pos > 0 THEN greatest(qualification_score, least(100, 55 + pos * 15)) WHEN conf = 'No Evidence' THEN 0 WHEN conf = 'Weak Opportunity' THEN least(qualification_score, 25) ELSE least(qualification_score, 45) END AS relevance FROM sc""")
def _(t):
    return cued(t).select("seq", PK.fencing_score("conf", "fence_probability", "pos", "qualification_score", "access_score").alias("fencing_score"), PK.fencing_relevance("conf", "pos", "qualification_score").alias("relevance"))


def search_rows(t):
    """Wide rows with every input of the contractor search, scored from the derived opportunities."""
    t.orders = R.dealt(t.orders, "o_orderkey")
    o = TR.contractor_opportunities(faceted(t).withColumn("blob", X.text_blob(*BLOB_COLS)), "blob")
    o = pursued(o.withColumn("fence_confidence", F.col("conf")).withColumn("positives", F.col("pos")).withColumn("fence_signal", F.col("fence_probability")).withColumn("package_scale", F.col("scale")))
    o = o.withColumn("bidable", F.col("seq") % 2 == 0).withColumn("subcontractor_score", F.col("subcontractor.score")).withColumn("evidence_text", F.col("text"))
    quality = PK.contact_quality(F.col("ph"), F.col("email").isNotNull(), F.col("co"), F.col("pa"))
    o = o.withColumn("contact_quality", quality).withColumn("actionability", AC.actionability("developer", "general_contractor", "architect", F.col("dm"), "phone", "email", F.lit("Unknown"), "procurement_route", "source_url"))
    return o.withColumn("package_key", X.package_key("project_name", "developer", "city"))


SEARCH_TEXT = ["project_name", "project_location", "trade", "developer", "general_contractor"]
SEARCHED_OF = lambda columns: "lower(concat_ws(' ', " + ", ".join(f"nullif({c}, '')" for c in columns) + "))"
SEARCHED = SEARCHED_OF(SEARCH_TEXT)
OTHER_REASONS = """concat_ws('|', CASE WHEN size = 'Tiny' THEN 'x' END, CASE WHEN sub = 'Low' THEN 'x' END, CASE WHEN stg = 'Late' THEN 'x' END, CASE WHEN satp >= 40 THEN 'x' END, CASE WHEN noisep > 0 THEN 'x' END)"""
ROUTED = """CASE WHEN ph AND (dm OR co) AND (pa OR ro) THEN 'High Confidence' WHEN (ph OR dm OR pa OR ro) AND ((ph AND co) OR (co AND pa) OR (ph AND pa) OR pursuit >= 60) THEN 'Medium Confidence' ELSE 'Research Required' END"""
KNOWN_POINTS = " + ".join(f"CASE WHEN {KNOWN.format(c)} THEN {n} ELSE 0 END" for c, n in (("developer", 14), ("general_contractor", 16), ("architect", 6), ("procurement_route", 8)))
ACTIONABLE = f"least(100, {KNOWN_POINTS} + CASE WHEN dm THEN 18 ELSE 0 END + CASE WHEN phone IS NOT NULL THEN 22 ELSE 0 END + CASE WHEN email IS NOT NULL THEN 14 ELSE 0 END + 8)"


def search_sql(trade: str) -> str:
    """Every row with its score for ``trade`` and the inputs of the search."""
    return f"""
WITH mm AS ({MATRIX} SELECT * FROM m), own AS ({MATRIX}{BEST} SELECT seq, {OTHER_REASONS} AS reasons FROM best), ff AS ({FACETS} SELECT * FROM f), pp AS ({PQ}),
pr AS (SELECT seq, pursuit, ph, dm, co, pa, {ROUTED} AS pursuit_confidence FROM pp),
x AS (SELECT ff.*, mm.r, mm.satp, mm.noisep, mm.score AS tscore, mm.sub_s, own.reasons, pr.* EXCLUDE (seq), {ACTIONABLE} AS act,
  CASE WHEN ph THEN 100 WHEN email IS NOT NULL THEN 70 WHEN co THEN 40 WHEN pa THEN 25 ELSE 0 END AS cq, {SEARCHED} AS searched,
  CASE WHEN ff.access_score >= 70 THEN 5 ELSE 0 END + CASE pr.pursuit_confidence WHEN 'High Confidence' THEN 10 WHEN 'Research Required' THEN -18 ELSE 0 END - CASE WHEN mm.r < 35 THEN 30 ELSE 0 END AS adj
  FROM ff JOIN mm USING (seq) JOIN own USING (seq) JOIN pr USING (seq) WHERE mm.model = {q(trade)})"""


TRADE_ROWS = f""",
y AS (SELECT *, greatest(0, least(100, CAST(floor((r * 28 + tscore * 24 + pursuit * 36 + act * 8 + cq * 4 + 50) / 100.0) AS INT) + 3 * CAST(contains(searched, 'roofing') AS INT) + adj)) AS search_score,
  {sql_hits('txt', V.TRADE_EVIDENCE_TERMS['Roofing'])} > 0 OR (NOT contains(trade, ',') AND contains(lower(trade), 'roofing')) AS evidence
  FROM (SELECT *, regexp_replace(lower(project_name || ' ' || project_description), {q(V.BOILERPLATE)}, ' ', 'g') AS txt FROM x))"""
TRADE_GATE = """WHERE search_score >= 35 AND reasons = '' AND r >= 50 AND satp < 40 AND noisep = 0 AND tscore >= 35 AND evidence AND pursuit >= 18"""
TRADE_ORDER = "ORDER BY CASE pursuit_confidence WHEN 'High Confidence' THEN 3 WHEN 'Medium Confidence' THEN 2 ELSE 1 END DESC, pursuit DESC, r DESC, tscore DESC, search_score DESC, act DESC, cq DESC, seq LIMIT 30"


@query("sr09_trade_search", search_sql("Roofing") + TRADE_ROWS + f" SELECT seq, pursuit_confidence, r AS trade_relevance, tscore AS contractor_score, search_score FROM y {TRADE_GATE} {TRADE_ORDER}")
def _(t):
    out = PK.contractor_search(search_rows(t), "roofing", SEARCH_TEXT, "seq")
    return out.select("seq", "pursuit_confidence", "trade_relevance", "contractor_score", "search_score")


FENCE_RANK = "CASE conf WHEN 'Primary Opportunity' THEN 5 WHEN 'Secondary Opportunity' THEN 4 WHEN 'Weak Opportunity' THEN 1 ELSE 0 END"
FENCE_ROWS = search_sql("Fencing") + f""",
g0 AS (SELECT *, {FENCE_RANK} AS frank, CASE WHEN housing THEN greatest(r, 58) WHEN pos > 0 THEN greatest(r, least(100, 55 + pos * 15)) WHEN conf = 'No Evidence' THEN 0 WHEN conf = 'Weak Opportunity' THEN least(r, 25) ELSE least(r, 45) END AS rel FROM x),
g AS (SELECT *, greatest(0, least(100, CAST(floor((frank * 1400 + fence_probability * 32 + least(100, pos * 30) * 24 + least(tscore, 100) * 18 + sub_s * 12 + 50) / 100.0) AS INT))) AS fscore,
  CAST(floor((scale * 1800 + frank * 1000 + fence_probability * 18 + tscore * 16 + pursuit * 16 + cq * 12 + act * 6 + 50) / 100.0) AS INT) AS b0 FROM g0),
h AS (SELECT *, CASE WHEN contact_status = 'phone' THEN b0 + 6 ELSE greatest(26, CAST(floor((b0 * 55 + 50) / 100.0) AS INT)) END AS b1 FROM g),
k AS (SELECT *, greatest(0, least(100, CASE WHEN scale < 2 THEN greatest(26, least(b1, 58)) ELSE b1 END + 3 * (CAST(contains(searched, 'fence') AS INT) + CAST(contains(searched, 'sacramento') AS INT))
  + CASE WHEN contains(searched, 'sacramento') THEN 8 ELSE 0 END + adj)) AS search_score FROM h
  WHERE (seq % 2 = 0 OR housing))"""
FENCE_SORT = "CASE package_size WHEN 'development' THEN 3 WHEN 'commercial' THEN 2 ELSE 1 END DESC, contact_status = 'phone' DESC, scale DESC, frank DESC, cq DESC, fence_probability DESC, fscore DESC, search_score DESC, seq"


LABEL = "name"
for tag in X.LOT_TAGS:
    LABEL = f"regexp_replace({LABEL}, {q(tag)}, ' ', 'g')"
PACKAGE = f"""trim(regexp_replace(lower(concat_ws(' ', CASE WHEN community <> '' THEN CASE WHEN starts_with(cue, 'village') THEN 'villages at ' ELSE 'the lakes at ' END || community
 ELSE substr(trim(regexp_replace({LABEL}, '\\s+', ' ', 'g')), 1, 60) END, coalesce(developer, ''), coalesce(city, ''))), '[^a-z0-9]+', ' ', 'g'))"""


def fencing_sql(where: str) -> str:
    """Rows of the fencing search after its gates; large packages and housing keep one row for each package key."""
    return FENCE_ROWS + f""",
n AS (SELECT *, lower(project_name) AS name, regexp_extract(lower(project_name), {q(X.COMMUNITY_CUE)}, 2) AS community, regexp_extract(lower(project_name), {q(X.COMMUNITY_CUE)}, 1) AS cue FROM k
 WHERE search_score >= 25 AND reasons = '' AND rel >= 25 AND satp < 40 AND noisep = 0 AND (direct OR housing) AND {where}),
z AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY CASE WHEN scale >= 3 OR housing THEN 'pkg:' || {PACKAGE} ELSE 'row:' || CAST(seq AS VARCHAR) END ORDER BY {FENCE_SORT}) = 1)
SELECT seq, package_size, scale AS package_scale, fscore AS contractor_score, search_score FROM z ORDER BY {FENCE_SORT} LIMIT 50"""


@query("wn09_fencing_sort", fencing_sql("true"))
def _(t):
    return PK.contractor_search(search_rows(t), "fence sacramento", SEARCH_TEXT, "seq").select("seq", "package_size", "package_scale", "contractor_score", "search_score")


@query("sr09_contractor_search", fencing_sql("contact_status = 'phone'"))
def _(t):
    out = PK.contractor_search(search_rows(t), "fence sacramento", SEARCH_TEXT, "seq", {"contact": ["phone"]})
    return out.select("seq", "package_size", "package_scale", "contractor_score", "search_score")


COMBINED_TEXT = ["project_name", "project_location", "trade"]
COMBINED = "roofing sacramento"
CW = COMBINED.split()
COMBINED_META = " + ".join(f"CASE WHEN contains(lower(coalesce({c}, '')), {q(COMBINED)}) THEN {n} ELSE 0 END" for c, n in (("city", 0.2), ("county", 0.15), ("trade", 0.25)))


@query("sr11_combined_search", search_sql("Roofing").replace(SEARCHED, SEARCHED_OF(COMBINED_TEXT)) + TRADE_ROWS + f""",
hits AS (SELECT seq FROM y {TRADE_GATE} {TRADE_ORDER}), src AS (SELECT o.seq AS doc, o.project_name || ' ' || concat_ws(' ', o.project_description, o.trade, o.city, o.county) AS whole, o.city, o.county, o.trade FROM opps o JOIN hits USING (seq)),
tk AS (SELECT doc, list_filter(regexp_split_to_array(lower(whole), '[^a-z0-9]+'), lambda w: length(w) >= 2 AND w NOT IN ({STOPS})) AS t FROM src),
cn AS (SELECT doc, len(t) AS len, unnest(t) AS token FROM tk), c AS (SELECT doc, len, token, count(*) AS n FROM cn GROUP BY 1, 2, 3), df AS (SELECT token, count(*) AS df FROM c GROUP BY 1), n AS (SELECT count(*) AS n FROM src),
v AS (SELECT doc, token, c.n / len * (ln((n.n + 1) / (df.df + 1)) + 1) AS weight FROM c JOIN df USING (token), n),
qw AS (SELECT token, CAST(1 AS DOUBLE) / {len(CW)} * coalesce((SELECT ln((n.n + 1) / (df.df + 1)) + 1 FROM df, n WHERE df.token = z.token), 0.5) AS w FROM (VALUES {', '.join(f'({q(w)})' for w in CW)}) z(token)), qm AS (SELECT sqrt(sum(w * w)) AS m FROM qw),
sm AS (SELECT doc, sum(weight * coalesce(w, 0)) AS dot, sqrt(sum(weight * weight)) AS mag FROM v LEFT JOIN qw USING (token) GROUP BY 1),
sc AS (SELECT src.doc, coalesce(dot / (mag * m), 0) AS lex, least(1.0, {COMBINED_META} + CASE WHEN contains(lower(trade), 'roofing') THEN 0.35 ELSE 0 END)::DOUBLE AS meta, {sql_hits('lower(whole)', CW)} / {len(CW)} AS ph FROM src LEFT JOIN sm ON sm.doc = src.doc, qm)
SELECT doc, CAST(floor((lex * 0.62::DOUBLE + meta * 0.28::DOUBLE + ph * 0.1::DOUBLE) * 1000 + 0.5) / 1000 AS DOUBLE) AS score, CAST(floor(lex * 1000 + 0.5) / 1000 AS DOUBLE) AS lexical_score, CAST(floor(meta * 1000 + 0.5) / 1000 AS DOUBLE) AS metadata_score
FROM sc WHERE NOT (lex * 0.62 + meta * 0.28 + ph * 0.1 < 0.04 AND lex < 0.02) ORDER BY 2 DESC, 1 LIMIT 20""")
def _(t):
    corpus = PK.contractor_search(search_rows(t), "roofing", ["project_name", "project_location", "trade"], "seq").withColumn("body", F.concat_ws(" ", "project_description", "trade", "city", "county"))
    # the index reads its corpus several times, so the ranked rows are written once
    ensure_checkpoint_dir(t.spark)
    corpus = corpus.select("seq", "project_name", "body", "city", "county", "trade").checkpoint()
    return S.semantic_search(corpus, "seq", "project_name", "body", "roofing sacramento", 20, {"city": "city", "county": "county", "trade": "trade"}, "Roofing").select("doc", "score", "lexical_score", "metadata_score")


@query("jn04_scope_stage")
def _(t):
    r = SC.scope_rows(texted(t), "text", "project_name", "trade")
    return r.select("seq", "primary_scope", "primary_work", "scope_project_type", "trade_confidence", "fence_scope_confidence", "bidable")
