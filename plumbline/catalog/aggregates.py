"""Registered queries: aggregations, windows, keyed merges and sinks (AG-*, WN-*, SK-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.base import q, query
from plumbline.functions import rules as R
from plumbline.functions import text as X
from plumbline.operators import aggregate as A
from plumbline.operators import keyed as K
from plumbline.operators.relational import attach_children
from plumbline.plans import companies as CO
from plumbline.plans import vocab as V
from plumbline.catalog.relational import RELATION, V1


@query("ag01_group_list", """
SELECT conv_id, count(*) AS turns_count, string_agg(role || ':' || CAST(length(text) AS VARCHAR), '|' ORDER BY turn) AS turns FROM conversations GROUP BY 1""")
def _(t):
    c = t.conversations.withColumn("item", F.concat_ws(":", "role", F.length("text").cast("string")))
    out = attach_children(c.select("conv_id").distinct(), c, ["conv_id"], ["turn"], ["item"], "turns")
    return out.select("conv_id", "turns_count", F.array_join(F.col("turns.item"), "|").alias("turns"))


@query("ag02_count_by_key", "SELECT source AS name, count(*) AS count FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(t):
    return A.count_by(t.documents, "source", 10)


@query("ag03_value_counts", "SELECT user_id, event_type AS name, count(*) AS count FROM events GROUP BY 1, 2")
def _(t):
    return A.value_counts(t.events, ["user_id"], "event_type")


@query("ag03_frequency_lists", """
SELECT user_id, string_agg(event_type || '=' || CAST(n AS VARCHAR), '|' ORDER BY n DESC, event_type) AS kinds
FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    lists = A.frequency_lists(t.events, ["user_id"], "event_type", "kinds")
    return lists.select("user_id", F.array_join(F.transform("kinds", lambda s: F.concat_ws("=", s["name"], s["count"].cast("string"))), "|").alias("kinds"))


@query("ag04_confidence_buckets", """
SELECT b AS bucket, count(p) AS n FROM (VALUES ('0-49'), ('50-64'), ('65-79'), ('80-100')) v(b) LEFT JOIN (SELECT CASE WHEN p < 50 THEN '0-49' WHEN p < 65 THEN '50-64' WHEN p < 80 THEN '65-79' ELSE '80-100' END AS k, p
  FROM (SELECT floor(confidence * 100 + 0.5) AS p FROM contacts)) ON k = b GROUP BY 1""")
def _(t):
    return A.confidence_buckets(t.contacts, "confidence")


@query("ag05_conditional_counts", """
SELECT 'total' AS metric, count(*) AS value FROM contacts UNION ALL SELECT 'with_phone', count(*) FILTER (phone <> '') FROM contacts UNION ALL SELECT 'with_email', count(*) FILTER (email <> '') FROM contacts
UNION ALL SELECT 'direct_high', count(*) FILTER (contact_type = 'direct' AND confidence >= 0.65) FROM contacts UNION ALL SELECT 'no_route', count(*) FILTER (phone = '' AND email = '') FROM contacts""")
def _(t):
    c = F.col
    return A.metric_rows(t.contacts, {
        "with_phone": c("phone") != "", "with_email": c("email") != "",
        "direct_high": (c("contact_type") == "direct") & (c("confidence") >= 0.65), "no_route": (c("phone") == "") & (c("email") == ""),
    })


@query("ag06_facet_counts", """
SELECT 'segment' AS facet, s AS value, count(c_custkey) AS count FROM (VALUES ('BUILDING'), ('MACHINERY'), ('SHIPS')) v(s) LEFT JOIN customer ON c_mktsegment = s GROUP BY 2
UNION ALL (SELECT 'nation', CAST(c_nationkey AS VARCHAR), count(*) FROM customer GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 12)""")
def _(t):
    return A.facet_counts(t.customer, {"segment": "c_mktsegment", "nation": F.col("c_nationkey").cast("string")}, {"segment": ["BUILDING", "MACHINERY", "SHIPS"]}, {"nation": 12})


@query("ag07_dashboard_totals", """
SELECT (SELECT count(*) FROM orders) AS projects, (SELECT count(*) FROM lineitem) AS permits, (SELECT count(*) FROM customer) AS companies, (SELECT count(*) FILTER (s_acctbal > 0) FROM supplier) AS active_sources""")
def _(t):
    one = lambda df, name, cond=None: df.agg((F.count_if(cond) if cond is not None else F.count(F.lit(1))).alias("value")).withColumn("metric", F.lit(name))
    rows = one(t.orders, "projects").unionByName(one(t.lineitem, "permits")).unionByName(one(t.customer, "companies")).unionByName(
        one(t.supplier, "active_sources", F.col("s_acctbal") > 0))
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m)
    return rows.agg(*[pick(m) for m in ("projects", "permits", "companies", "active_sources")])


@query("ag08_filter_options", """
SELECT DISTINCT 'o_orderstatus' AS field, o_orderstatus AS value FROM orders UNION SELECT 'o_orderpriority', o_orderpriority FROM orders""")
def _(t):
    return A.filter_options(t.orders, ["o_orderstatus", "o_orderpriority"])


V2 = "trim(regexp_replace(regexp_replace(lower({0}), '\\b(llc|inc|corp|corporation|incorporated|company|co|limited|the)\\b', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@query("ag09_discover_companies", f"""
WITH m AS (SELECT *, {V2.format('name')} AS k FROM (SELECT company AS name, role, contact_seq AS seq FROM contacts) WHERE name IS NOT NULL)
SELECT k AS normalized_name, min_by(name, seq) AS company_name, string_agg(DISTINCT role, '|' ORDER BY role) AS roles, count(*) AS project_count, least(25, count(*)) AS kept FROM m GROUP BY 1""")
def _(t):
    m = t.contacts.select(F.col("company").alias("name"), "role", F.col("contact_seq").alias("seq"), F.col("source").alias("source_name"),
                          F.col("opportunity_id").alias("source_url"), F.col("opportunity_id").alias("project_name"))
    out = CO.discover_companies(m)
    return out.select("normalized_name", "company_name", F.array_join("roles", "|").alias("roles"), "project_count", F.size("source_records").cast("bigint").alias("kept"))


def safe_url(c):
    return f"regexp_matches(coalesce({c}, ''), '^https?://', 'i')"


PROFILE_SQL = f"""SELECT *, CASE WHEN regexp_matches(phone, '\\d{{3}}[-.\\s)]*\\d{{3}}[-.\\s]*\\d{{4}}') AND NOT regexp_matches(phone, '\\b555[-\\s]?\\d{{4}}\\b') THEN phone END AS p2,
  CASE WHEN email IS NOT NULL AND NOT contains(email, 'example.com') THEN email END AS e2 FROM web"""
CONF_SQL = """least(1.0, floor((0.35::DOUBLE + CASE WHEN official_website IS NOT NULL THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN p2 IS NOT NULL THEN 0.18 ELSE 0 END::DOUBLE + CASE WHEN e2 IS NOT NULL THEN 0.1 ELSE 0 END::DOUBLE
  + CASE WHEN contact_page_url IS NOT NULL THEN 0.08 ELSE 0 END::DOUBLE + CASE WHEN bid_opportunities_page_url IS NOT NULL OR vendor_registration_page_url IS NOT NULL THEN 0.08 ELSE 0 END::DOUBLE
  + CASE WHEN subcontractor_registration_page_url IS NOT NULL OR trade_partner_portal_url IS NOT NULL THEN 0.08 ELSE 0 END::DOUBLE + CASE WHEN plan_room_url IS NOT NULL THEN 0.1 ELSE 0 END::DOUBLE) * 100 + 0.5) / 100)"""
MISSING_SQL = "concat_ws('|', " + ", ".join(
    f"CASE WHEN {c if c not in ('phone', 'email') else {'phone': 'p2', 'email': 'e2'}[c]} IS NULL THEN {q(label)} END" for label, c in CO.PROFILE_FIELDS) + ")"


@query("ag10_company_profiles", f"SELECT seq, CAST({CONF_SQL} AS DOUBLE) AS profile_confidence, {MISSING_SQL} AS missing_fields FROM ({PROFILE_SQL})")
def _(t):
    return CO.company_profiles(t.web, F.lit(1)).select("seq", "profile_confidence", F.array_join("missing_fields", "|").alias("missing_fields"))


PATHS_SQL = " UNION ALL ".join(
    f"SELECT seq, {q(p)} AS path_type, {c} AS path_url FROM web WHERE {c} IS NOT NULL" for p, c in CO.FALLBACK_PATHS)
VALUE_SQL = "CASE WHEN path_type IN ('vendor_registration', 'subcontractor_registration', 'trade_partner', 'bid_portal', 'public_procurement', 'plan_room') THEN 'High' WHEN path_type = 'estimating_contact' THEN 'Medium' ELSE 'Low' END"


@query("ag11_procurement_paths", f"""
SELECT seq, path_type, path_url, {VALUE_SQL} AS contractor_value, CAST(CASE WHEN path_type = 'general_contact' THEN 0.58 ELSE 0.72 END AS DOUBLE) AS confidence FROM ({PATHS_SQL})""")
def _(t):
    return CO.procurement_paths(t.web, "seq").select("seq", "path_type", "path_url", "contractor_value", "confidence")


@query("ag12_company_intelligence", f"""
WITH prof AS (SELECT seq, company_type, official_website, p2, contact_page_url, CAST({CONF_SQL} AS DOUBLE) AS conf, {MISSING_SQL} AS missing,
    official_website IS NOT NULL OR p2 IS NOT NULL OR contact_page_url IS NOT NULL OR bid_opportunities_page_url IS NOT NULL OR vendor_registration_page_url IS NOT NULL
    OR subcontractor_registration_page_url IS NOT NULL OR trade_partner_portal_url IS NOT NULL OR plan_room_url IS NOT NULL AS actionable FROM ({PROFILE_SQL})),
ps AS (SELECT *, {VALUE_SQL} AS val, CASE WHEN path_type = 'general_contact' THEN 0.58 ELSE 0.72 END AS pc FROM ({PATHS_SQL})),
g AS (SELECT seq, count(*) AS n, bool_or(val = 'High') AS dedicated, bool_or(path_type IN ('vendor_registration', 'trade_partner', 'bid_portal', 'plan_room')) AS vendor,
    bool_or(path_type IN ('subcontractor_registration', 'trade_partner')) AS sub, CAST(max(pc) AS DOUBLE) AS best FROM ps GROUP BY 1)
SELECT seq, 'coverage_summary' AS kind, CASE WHEN coalesce(dedicated, false) THEN greatest(conf, 0.7) ELSE conf END AS confidence FROM prof LEFT JOIN g USING (seq)
UNION ALL SELECT seq, 'company_type_evidence', 0.7 FROM prof UNION ALL SELECT seq, 'missing_fields', 0.8 FROM prof
UNION ALL SELECT seq, 'web_presence', conf FROM prof WHERE official_website IS NOT NULL OR p2 IS NOT NULL OR contact_page_url IS NOT NULL
UNION ALL SELECT seq, 'vendor_access', 0.85 FROM prof JOIN g USING (seq) WHERE vendor UNION ALL SELECT seq, 'procurement_access', best FROM prof JOIN g USING (seq)
UNION ALL SELECT seq, 'subcontractor_access', 0.85 FROM prof JOIN g USING (seq) WHERE sub""")
def _(t):
    profiles = CO.company_profiles(t.web, F.lit(1))
    paths = CO.procurement_paths(t.web, "seq")
    types = paths.groupBy("seq").agg(F.collect_set("path_type").alias("path_types"))
    best = CO.best_path(paths, "seq").select("seq", F.col("path_type").alias("best_type"), F.col("confidence").alias("best_confidence"))
    rows = profiles.join(types, "seq", "left").join(best, "seq", "left").withColumn("path_types", F.coalesce("path_types", F.array().cast("array<string>")))
    return CO.company_intelligence(rows).select("seq", "kind", "confidence")


FACTS = "SELECT DISTINCT company_id, project_id, trade FROM facts"


BEHAVIOR_SQL = f"""
WITH per AS (SELECT company_id, count(DISTINCT project_id) AS n, count(DISTINCT CASE WHEN trade = 'Fencing' THEN project_id END) AS f FROM facts GROUP BY 1),
pt AS (SELECT seq AS company_id, count(*) AS paths, count(*) FILTER (val = 'High') AS high, count(*) FILTER (val = 'Medium') AS med FROM (SELECT *, {VALUE_SQL} AS val FROM ({PATHS_SQL})) GROUP BY 1),
j AS (SELECT w.seq AS company_id, w.company_type, coalesce(n, 0) AS n, coalesce(f, 0) AS f, coalesce(paths, 0) AS paths, coalesce(high, 0) AS high, coalesce(med, 0) AS med FROM web w LEFT JOIN per ON per.company_id = w.seq LEFT JOIN pt ON pt.company_id = w.seq),
s AS (SELECT *, CASE WHEN f = 0 THEN 'Unknown' WHEN company_type = 'Developer' AND f >= 3 THEN 'Frequently Outsources' WHEN company_type = 'Developer' THEN 'Sometimes Outsources'
  WHEN company_type = 'General Contractor' AND f >= 8 THEN 'Self Performs' WHEN company_type = 'General Contractor' AND f >= 3 THEN 'Rarely Outsources' ELSE 'Unknown' END AS status FROM j)"""
LIKELIHOOD_SQL = """CAST(greatest(0.0, least(1.0, floor((least(0.35::DOUBLE, n * 0.035::DOUBLE) + least(0.2::DOUBLE, paths * 0.08::DOUBLE)
  + CASE WHEN high > 0 THEN 0.18::DOUBLE WHEN med > 0 THEN 0.1::DOUBLE ELSE 0::DOUBLE END + CASE WHEN status IN ('Frequently Outsources', 'Sometimes Outsources') THEN 0.22::DOUBLE ELSE 0::DOUBLE END
  + CASE WHEN company_type = 'Developer' THEN 0.08::DOUBLE ELSE 0::DOUBLE END - CASE WHEN company_type = 'General Contractor' AND status = 'Self Performs' THEN 0.12::DOUBLE ELSE 0::DOUBLE END) * 100 + 0.5) / 100)) AS DOUBLE)"""


def company_behavior(t):
    companies = t.web.select(F.col("seq").alias("company_id"), "company_type")
    paths = CO.procurement_paths(t.web, "seq").withColumnRenamed("seq", "company_id")
    return CO.company_behavior(t.facts, paths, companies)


@query("ag13_company_behavior", BEHAVIOR_SQL + f" SELECT company_id, n AS project_count, f AS fencing_projects, status AS fencing_outsourcing, {LIKELIHOOD_SQL} AS opportunity_likelihood FROM s")
def _(t):
    return company_behavior(t).select("company_id", "project_count", "fencing_projects", "fencing_outsourcing", "opportunity_likelihood")


@query("sm16_opportunity_likelihood", BEHAVIOR_SQL + f" SELECT company_type, status AS fencing_outsourcing, {LIKELIHOOD_SQL} AS opportunity_likelihood, count(*) AS companies FROM s GROUP BY ALL")
def _(t):
    return company_behavior(t).groupBy("company_type", "fencing_outsourcing", "opportunity_likelihood").agg(F.count(F.lit(1)).alias("companies"))


@query("ag13_behavior_counts", """
WITH o AS (SELECT DISTINCT company_id, project_id, project_type, city, county FROM facts)
SELECT company_id, project_type AS name, count(*) AS count, 'project_type' AS list FROM o WHERE project_type <> '' GROUP BY 1, 2
UNION ALL SELECT company_id, city, count(*), 'city' FROM o GROUP BY 1, 2 UNION ALL SELECT company_id, county, count(*), 'county' FROM o GROUP BY 1, 2
UNION ALL SELECT company_id, trade, count(*), 'trade' FROM (SELECT DISTINCT company_id, project_id, trade FROM facts WHERE trade <> 'Painting') GROUP BY 1, 2""")
def _(t):
    return CO.behavior_counts(t.facts)


@query("ag13_outsourcing_map", """
WITH f AS (SELECT company_id, count(DISTINCT project_id) AS n FROM facts WHERE trade = 'Roofing' GROUP BY 1)
SELECT w.seq AS company_id, coalesce(n, 0) AS roofing_projects, CAST(CASE WHEN coalesce(n, 0) > 0 THEN least(0.85::DOUBLE, floor((0.45::DOUBLE + n * 0.08::DOUBLE) * 100 + 0.5) / 100) ELSE 0.15 END AS DOUBLE) AS confidence FROM web w LEFT JOIN f ON f.company_id = w.seq""")
def _(t):
    out = CO.outsourcing_map(t.facts, t.web.select(F.col("seq").alias("company_id"), "company_type"))
    r = F.col("outsourcing_by_trade")["Roofing"]
    return out.select("company_id", r["evidence_count"].alias("roofing_projects"), r["confidence"].alias("confidence"))


@query("ag14_developer_profiles", """
SELECT w.seq AS company_id, count(DISTINCT project_id) AS project_count FROM web w LEFT JOIN facts f ON f.company_id = w.seq WHERE w.company_type = 'Developer' GROUP BY 1""")
def _(t):
    companies = t.web.select(F.col("seq").alias("company_id"), "company_type")
    behavior = CO.company_behavior(t.facts, CO.procurement_paths(t.web, "seq").withColumnRenamed("seq", "company_id"), companies)
    return CO.profiles_of_type(behavior, "Developer").select("company_id", "project_count")


@query("ag15_relationships", f"""
WITH p AS (SELECT * FROM (SELECT a.project_id, a.company_id AS from_id, b.company_id AS to_id, {RELATION} AS relation
  FROM (SELECT DISTINCT project_id, company_id, company_type FROM facts) a JOIN (SELECT DISTINCT project_id, company_id, company_type FROM facts) b ON a.project_id = b.project_id AND a.company_id <> b.company_id) WHERE relation IS NOT NULL),
tr AS (SELECT from_id, to_id, relation, string_agg(DISTINCT trade, '|' ORDER BY trade) AS trades FROM p JOIN (SELECT DISTINCT project_id, trade FROM facts WHERE trade <> 'Painting') USING (project_id) GROUP BY 1, 2, 3)
SELECT c.from_id, c.to_id, c.relation, n AS project_count, CAST(least(0.9, floor((0.35::DOUBLE + n * 0.15::DOUBLE) * 100 + 0.5) / 100) AS DOUBLE) AS confidence, coalesce(trades, '') AS trades
FROM (SELECT from_id, to_id, relation, count(*) AS n FROM p GROUP BY 1, 2, 3) c LEFT JOIN tr USING (from_id, to_id, relation)""")
def _(t):
    r = CO.relationships(t.facts)
    return r.select("from_id", "to_id", "relation", "project_count", "confidence", F.coalesce(F.array_join("trades", "|"), F.lit("")).alias("trades"))


@query("ag15_relationship_projects", f"""
SELECT * FROM (SELECT a.company_id AS from_id, b.company_id AS to_id, {RELATION} AS relation, a.project_id
  FROM (SELECT DISTINCT project_id, company_id, company_type FROM facts) a JOIN (SELECT DISTINCT project_id, company_id, company_type FROM facts) b ON a.project_id = b.project_id AND a.company_id <> b.company_id) WHERE relation IS NOT NULL""")
def _(t):
    return CO.relationship_projects(t.facts)


@query("ag16_top_companies", """
SELECT s_suppkey AS company_id, s_name AS company_name, count(DISTINCT l_orderkey) AS project_count, count(l_orderkey) AS evidence_count, count(l_orderkey) FILTER (l_returnflag = 'A') AS path_count,
  count(l_orderkey) FILTER (l_returnflag = 'R') AS fencing_signals, count(l_orderkey) FILTER (l_linestatus = 'O') AS qualified FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2
ORDER BY 3 DESC, 4 DESC, 5 DESC, 6 DESC, 7 DESC, 2, 1 LIMIT 20""")
def _(t):
    counts = t.lineitem.groupBy(F.col("l_suppkey").alias("company_id")).agg(
        F.count_distinct("l_orderkey").alias("project_count"), F.count(F.lit(1)).alias("evidence_count"), F.count_if(F.col("l_returnflag") == "A").alias("path_count"),
        F.count_if(F.col("l_returnflag") == "R").alias("fencing_signals"), F.count_if(F.col("l_linestatus") == "O").alias("qualified"))
    return CO.top_companies(counts.join(t.supplier.select(F.col("s_suppkey").alias("company_id"), F.col("s_name").alias("company_name")), "company_id"))


@query("ag18_average_confidence", """
SELECT opportunity_id, CAST(floor(sum(floor(confidence * 100 + 0.5)) / count(*) + 0.5) / 100 AS DOUBLE) AS confidence FROM contacts GROUP BY 1""")
def _(t):
    # hundredths are summed as integers, so the mean does not depend on row order
    cents = F.floor(F.col("confidence") * 100 + 0.5)
    return t.contacts.groupBy("opportunity_id").agg((F.floor(F.sum(cents) / F.count(F.lit(1)) + 0.5) / 100).alias("confidence"))


ROLES = ["Developer", "General Contractor", "Architect", "Property Owner", "Applicant", "Engineer"]
ROLE_SQL = ", ".join(f"coalesce(max_by(company, contact_seq) FILTER (role = {q(r)}), 'Unknown') AS {q(r).replace(chr(39), chr(34))}" for r in ROLES)


@query("ag19_role_coverage", f"SELECT opportunity_id, {ROLE_SQL} FROM contacts GROUP BY 1")
def _(t):
    return A.role_coverage(t.contacts, "opportunity_id", "role", "company", "contact_seq", ROLES)


TERMS = ["the", "fence", "tion", "gate", "zzz"]


@query("ag20_term_audit", " UNION ALL ".join(
    f"SELECT {q(x)} AS term, coalesce(sum(n), 0)::BIGINT AS occurrences, count(*) FILTER (n > 0) AS rows_hit, min(seq) FILTER (n > 0) AS first_row FROM (SELECT seq, (length(text) - length(replace(lower(text), {q(x)}, ''))) / {len(x)} AS n FROM docs)"
    for x in TERMS))
def _(t):
    return A.term_audit(t.docs, "text", TERMS, "seq")


@query("ag23_names_by_role", """
SELECT opportunity_id, string_agg(company, ', ' ORDER BY contact_seq) FILTER (role = 'Developer') AS developers, min_by(company, contact_seq) FILTER (role = 'Architect') AS architect
FROM contacts GROUP BY 1""")
def _(t):
    architect = F.min_by("company", F.when(F.col("role") == "Architect", F.col("contact_seq")))
    return t.contacts.groupBy("opportunity_id").agg(A.names_of_role("role", "company", "contact_seq", "Developer").alias("developers"), architect.alias("architect"))


# --- windows and keyed merges ----------------------------------------------------------------
@query("wn01_first_per_key", "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def _(t):
    # the whole text is the key; only its hash pair travels
    d = t.documents.withColumn("k", F.sha2("text", 256)).select("doc_id", "source", "k")
    return K.first_per_key(d, ["k"], ["doc_id"]).select("doc_id", "source")


@query("wn02_best_per_key", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def _(t):
    return K.best_per_key(t.orders, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("wn03_top_n_per_group", "SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 12")
def _(t):
    return K.top_n_per_group(t.events, ["event_type"], [F.desc("value"), "event_id"], 12).select("event_type", "event_id", "value")


@query("wn07_merge_groups", f"""
SELECT k, max_by(seq, seq) AS latest_seq, max_by(project_stage, seq) AS project_stage, max(qualification_score) AS qualification_score, sum(evidence_count)::BIGINT AS evidence_count,
  string_agg(DISTINCT fast_money_potential, '|' ORDER BY fast_money_potential) AS labels, count(*) AS merged_rows
FROM (SELECT *, {V1.format("concat_ws('|', project_name, city, contractor)")} AS k FROM opps) GROUP BY 1""")
def _(t):
    o = t.opps.withColumn("k", X.normalize_name_v1(F.concat_ws("|", "project_name", "city", "contractor"))).withColumn("latest_seq", F.col("seq")).withColumn("labels", F.col("fast_money_potential"))
    out = K.merge_groups(o, "k", ["seq"], ["latest_seq", "project_stage"], maxima=["qualification_score"], sums=["evidence_count"], sets=["labels"])
    return out.withColumn("labels", F.array_join("labels", "|"))


@query("wn08_multi_key_sort", "SELECT seq, qualification_score, evidence_count FROM opps ORDER BY qualification_score DESC, evidence_count DESC, project_name, seq LIMIT 100")
def _(t):
    return t.opps.orderBy(F.desc("qualification_score"), F.desc("evidence_count"), "project_name", "seq").limit(100).select("seq", "qualification_score", "evidence_count")


@query("wn10_collapse_packages", """
SELECT seq FROM (SELECT seq, CASE WHEN seq % 5 >= 3 THEN 'p' || lower(project_name) || '|' || city ELSE 'r' || CAST(seq AS VARCHAR) END AS k, qualification_score FROM opps)
QUALIFY row_number() OVER (PARTITION BY k ORDER BY qualification_score DESC, seq) = 1""")
def _(t):
    o = t.opps.withColumn("scale", F.col("seq") % 5).withColumn("pk", F.concat(F.lower("project_name"), F.lit("|"), "city"))
    return K.collapse_packages(o, "scale", "pk", "seq", [F.desc("qualification_score"), "seq"]).select("seq")


@query("wn11_global_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(t):
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("wn12_user_sort", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority ASC, o_orderkey LIMIT 40")
def _(t):
    from plumbline.operators.search import sort_by

    return sort_by(t.orders, "o_orderpriority", "asc", tie="o_orderkey").limit(40).select("o_orderkey", "o_orderpriority")


@query("wn13_horizon_feed", "SELECT fast_money_potential, seq FROM opps QUALIFY row_number() OVER (PARTITION BY fast_money_potential ORDER BY qualification_score DESC, seq) <= 4")
def _(t):
    return K.top_n_per_group(t.opps, ["fast_money_potential"], [F.desc("qualification_score"), "seq"], 4).select("fast_money_potential", "seq")


@query("wn14_top_by_trade", """
SELECT trade, seq, qualification_score FROM (SELECT seq, qualification_score, unnest(string_split(trade, ', ')) AS trade FROM opps) QUALIFY row_number() OVER (PARTITION BY trade ORDER BY qualification_score DESC, seq) <= 25""")
def _(t):
    rows = t.opps.select("seq", "qualification_score", F.explode(F.split("trade", ", ")).alias("trade"))
    return K.top_n_per_group(rows, ["trade"], [F.desc("qualification_score"), "seq"], 25)


@query("wn16_dedupe_contacts", """
SELECT contact_seq FROM contacts QUALIFY row_number() OVER (PARTITION BY opportunity_id, trim(regexp_replace(lower(company || '|' || name || '|' || phone || '|' || email), '[^a-z0-9]+', ' ', 'g')) ORDER BY contact_seq) = 1""")
def _(t):
    key = X.normalize_key(F.concat_ws("|", "company", "name", "phone", "email"))
    return K.first_per_key(t.contacts.withColumn("k", key), ["opportunity_id", "k"], ["contact_seq"]).select("contact_seq")


@query("wn17_top_entities", """
SELECT company_id, count(DISTINCT project_id) AS project_count, count(*) AS evidence_count FROM facts WHERE company_type = 'Developer' GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 25""")
def _(t):
    g = t.facts.filter("company_type = 'Developer'").groupBy("company_id").agg(F.count_distinct("project_id").alias("project_count"), F.count(F.lit(1)).alias("evidence_count"))
    return g.orderBy(F.desc("project_count"), F.desc("evidence_count"), "company_id").limit(25)


# --- upserts -----------------------------------------------------------------------------------
UPSERT_SQL = f"""
WITH base AS (SELECT {V1.format('company_name')} AS k, max_by(official_website, seq) FILTER (official_website IS NOT NULL) AS website, max_by(phone, seq) FILTER (phone IS NOT NULL) AS phone FROM web GROUP BY 1),
delta AS (SELECT {V1.format('business_name')} AS k, max_by(nullif(business_phone, ''), seq) FILTER (business_phone <> '') AS phone FROM licences GROUP BY 1)
SELECT coalesce(base.k, delta.k) AS k, website, coalesce(delta.phone, base.phone) AS phone FROM base FULL JOIN delta ON base.k = delta.k"""


@query("sk02_upsert_fields", UPSERT_SQL)
def _(t):
    base = K.latest_per_key(t.web.withColumn("k", X.normalize_name_v1("company_name")).withColumn("website", F.col("official_website")), ["k"], ["seq"], ["website", "phone"])
    lic = t.licences.withColumn("k", X.normalize_name_v1("business_name")).withColumn("phone", F.nullif("business_phone", F.lit("")))
    return K.upsert(base, K.latest_per_key(lic, ["k"], ["seq"], ["phone"]), ["k"])


@query("sk03_upsert_contact_sources", """
SELECT opportunity_id, source, max_by(phone, contact_seq) FILTER (phone <> '') AS phone, max_by(email, contact_seq) FILTER (email <> '') AS email FROM contacts GROUP BY 1, 2""")
def _(t):
    c = t.contacts.withColumn("phone", F.nullif("phone", F.lit(""))).withColumn("email", F.nullif("email", F.lit("")))
    old, new = c.filter("line <= 2"), c.filter("line > 2")
    keys, fields = ["opportunity_id", "source"], ["phone", "email"]
    return K.upsert(K.latest_per_key(old, keys, ["contact_seq"], fields), K.latest_per_key(new, keys, ["contact_seq"], fields), keys)


@query("sk04_seed_missing", f"""
SELECT k FROM (SELECT DISTINCT {V1.format('company_name')} AS k FROM web) UNION SELECT DISTINCT {V1.format('business_name')} FROM licences""")
def _(t):
    base = t.web.select(X.normalize_name_v1("company_name").alias("k")).distinct()
    return K.seed_missing(base, t.licences.select(X.normalize_name_v1("business_name").alias("k")).distinct(), ["k"])


@query("sk05_merge_graph_properties", """
SELECT company_id, max_by(city, project_seq * 1000 + company_id) AS city, max_by(nullif(project_type, ''), project_seq * 1000 + company_id) FILTER (project_type <> '') AS project_type FROM facts GROUP BY 1""")
def _(t):
    f = t.facts.withColumn("seq", F.col("project_seq") * 1000 + F.col("company_id")).withColumn("project_type", F.nullif("project_type", F.lit("")))
    return K.last_wins_properties(f, ["company_id"], "seq", ["city", "project_type"])


@query("sk06_node_neighborhood", """
WITH e AS (SELECT DISTINCT 's:' || CAST(l_suppkey AS VARCHAR) AS src, 'f:' || l_returnflag AS dst FROM lineitem),
b AS (SELECT src AS id, dst AS other, 'out' AS dir FROM e UNION ALL SELECT dst, src, 'in' FROM e)
SELECT id, dir, count(*) AS degree, string_agg(other, '|' ORDER BY other) AS neighbors FROM b GROUP BY 1, 2""")
def _(t):
    from plumbline.operators.graph import neighbor_text

    e = t.lineitem.select(F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("f:"), "l_returnflag").alias("dst")).distinct()
    return neighbor_text(e)


@query("sk07_validate_import", """
SELECT c_custkey, concat_ws('|', CASE WHEN name = '' THEN 'missing name' END, CASE WHEN ptype NOT IN ('Residential', 'Commercial', 'Industrial', 'Government', 'Mixed Use', 'Infrastructure') THEN 'invalid project_type' END,
  CASE WHEN status NOT IN ('Planning', 'Proposed', 'Approved', 'Permitted', 'Under Construction', 'Completed') THEN 'invalid status' END, CASE WHEN city = '' THEN 'missing city' END) AS errors
FROM (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_name END AS name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Residential' WHEN c_mktsegment = 'MACHINERY' THEN 'Industrial' ELSE c_mktsegment END AS ptype,
  CASE WHEN c_custkey % 3 = 0 THEN 'Planning' WHEN c_custkey % 3 = 1 THEN 'Approved' ELSE 'Open' END AS status, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'Rocklin' END AS city FROM customer)""")
def _(t):
    from plumbline.sources.imports import validate_import

    k = F.col("c_custkey")
    rows = t.customer.select(
        "c_custkey", F.when(k % 11 == 0, "").otherwise(F.col("c_name")).alias("name"),
        F.when(F.col("c_mktsegment") == "BUILDING", "Residential").when(F.col("c_mktsegment") == "MACHINERY", "Industrial").otherwise(F.col("c_mktsegment")).alias("project_type"),
        F.when(k % 3 == 0, "Planning").when(k % 3 == 1, "Approved").otherwise("Open").alias("status"),
        F.when(k % 7 == 0, "").otherwise("Rocklin").alias("city"), F.lit("Placer County").alias("county"), F.lit("1 Main St").alias("address"))
    return validate_import(rows).select("c_custkey", F.array_join("errors", "|").alias("errors"))
