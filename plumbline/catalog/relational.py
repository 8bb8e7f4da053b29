"""Registered queries: filters, joins, set operations (FL-01..06, JN-*, ST-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.base import query
from plumbline.functions import text as X
from plumbline.operators import relational as R
from plumbline.operators.keyed import first_per_key
from plumbline.plans import vocab as V


@query("fl01_filter_projects", """
SELECT seq, project_name, city FROM opps WHERE city = 'Roseville' AND project_stage = 'Active'
  AND (contains(lower(project_name), 'gate') OR contains(lower(project_description), 'gate') OR contains(lower(city), 'gate') OR contains(lower(county), 'gate'))""")
def _(t):
    return R.filter_rows(t.opps, {"city": "Roseville", "project_stage": "Active", "county": ""}, "gate", ["project_name", "project_description", "city", "county"]).select(
        "seq", "project_name", "city"
    )


@query("fl02_filter_permits", """
SELECT o_orderkey, c_name, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND n_name = 'NATION_3' AND contains(lower(c_name), '1') ORDER BY o_orderdate DESC, o_orderkey LIMIT 50""")
def _(t):
    permits = R.filter_rows(t.orders, {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})
    projects = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).filter("n_name = 'NATION_3'")
    rows = permits.join(projects, F.col("o_custkey") == F.col("c_custkey")).filter(R.contains_ci(["c_name"], "1"))
    return rows.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "c_name", F.to_date("o_orderdate").cast("string").alias("day"))


@query("fl03_filter_companies", """
SELECT seq, company_name FROM web WHERE contains(lower(company_name), 'fence') OR contains(lower(company_type), 'fence') ORDER BY company_name, seq""")
def _(t):
    return R.filter_rows(t.web, q="FENCE", q_columns=["company_name", "company_type"]).orderBy("company_name", "seq").select("seq", "company_name")


@query("fl04_filter_opportunities", """
SELECT seq, trade, qualification_score FROM (SELECT seq, county, fast_money_potential, qualification_score, project_name, unnest(string_split(trade, ', ')) AS trade FROM opps)
WHERE trade = 'Electrical' AND county = 'Placer County' AND fast_money_potential = 'High' AND contains(lower(project_name), 'oak')""")
def _(t):
    rows = t.opps.select("seq", "county", "fast_money_potential", "qualification_score", "project_name", F.explode(F.split("trade", ", ")).alias("trade"))
    return R.filter_rows(rows, {"trade": "Electrical", "county": "Placer County", "fast_money_potential": "High"}, "oak", ["project_name"]).select(
        "seq", "trade", "qualification_score"
    )


@query("fl05_filter_signals", "SELECT id, signal_type, importance_score FROM signals WHERE project_seq = 7 ORDER BY importance_score DESC, seq")
def _(t):
    return R.filter_rows(t.signals, {"project_seq": 7}).orderBy(F.desc("importance_score"), "seq").select("id", "signal_type", "importance_score")


@query("fl06_lookup_alternates", """
SELECT seq, id FROM (SELECT *, CASE WHEN id = 'app-11' THEN 0 WHEN id = 'sac-app-11' THEN 1 WHEN trim(regexp_replace(lower(project_name), '[^a-z0-9]+', ' ', 'g')) = 'northgate business park' THEN 2 END AS r FROM opps)
WHERE r IS NOT NULL ORDER BY r, seq LIMIT 1""")
def _(t):
    alternates = [(F.col("id"), "app-11"), (F.col("id"), "sac-app-11"), (X.normalize_key("project_name"), "northgate business park")]
    return R.lookup_by_alternates(t.opps, alternates, ["seq"]).select("seq", "id")


# --- joins -----------------------------------------------------------------------------
V1 = "trim(regexp_replace(regexp_replace(lower({0}), '\\b(llc|inc|corp|corporation|company|co|limited|the)\\b', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@query("jn01_profile_by_name", f"""
SELECT p.seq, w.seq AS profile_seq, coalesce(w.company_type, 'Unknown') AS company_type FROM permits_a p
LEFT JOIN (SELECT *, {V1.format('company_name')} AS k FROM web QUALIFY row_number() OVER (PARTITION BY {V1.format('company_name')} ORDER BY seq) = 1) w ON w.k = {V1.format('p.contractor')}""")
def _(t):
    profiles = first_per_key(t.web.withColumn("k", X.normalize_name_v1("company_name")), ["k"], ["seq"]).select("k", F.col("seq").alias("profile_seq"), "company_type")
    p = t.permits_a.withColumn("k", X.normalize_name_v1("contractor"))
    return p.join(profiles, "k", "left").select("seq", "profile_seq", F.coalesce("company_type", F.lit("Unknown")).alias("company_type"))


@query("jn02_attach_contacts", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY opportunity_id ORDER BY confidence DESC, contact_seq) AS rn, count(*) OVER (PARTITION BY opportunity_id) AS n FROM contacts),
g AS (SELECT opportunity_id, max(n) AS n, string_agg(company, '|' ORDER BY rn) AS companies FROM r GROUP BY 1)
SELECT o.seq, coalesce(g.n, 0) AS contacts_count, coalesce(companies, '') AS companies FROM opps o LEFT JOIN g ON g.opportunity_id = o.id""")
def _(t):
    out = R.attach_children(
        t.opps.select("seq", F.col("id").alias("opportunity_id")), t.contacts, ["opportunity_id"], [F.desc("confidence"), "contact_seq"], ["company"], "contacts"
    )
    return out.select("seq", "contacts_count", F.coalesce(F.array_join(F.col("contacts.company"), "|"), F.lit("")).alias("companies"))


@query("jn03_match_on_either_key", f"""
SELECT DISTINCT o.seq, l.license_no FROM opps o JOIN licences l ON {V1.format('o.contractor')} = {V1.format('l.business_name')} AND {V1.format('o.contractor')} <> ''
UNION SELECT o.seq, l.license_no FROM opps o JOIN licences l ON o.application = 'APP-' || CAST(l.seq AS VARCHAR)""")
def _(t):
    left = t.opps.select("seq", X.normalize_name_v1("contractor").alias("name_key"), "application")
    right = t.licences.select("license_no", X.normalize_name_v1("business_name").alias("r_name"), F.concat(F.lit("APP-"), F.col("seq").cast("string")).alias("r_app"))
    return R.join_on_either(left, right, "seq", "license_no", [("name_key", "r_name"), ("application", "r_app")])


@query("jn04_override_chain", """
SELECT o.seq, coalesce(d.scope, a.scope, o.scope) AS scope, a.action_score FROM (SELECT seq, project_description AS scope FROM opps) o
LEFT JOIN (SELECT seq, scope, objectid % 100 AS action_score FROM permits_b) a ON a.seq = o.seq
LEFT JOIN (SELECT seq, CASE WHEN lang <> 'en' THEN id END AS scope FROM docs) d ON d.seq = o.seq""")
def _(t):
    base = t.opps.select("seq", F.col("project_description").alias("scope"))
    actions = t.permits_b.select("seq", "scope", (F.col("objectid") % 100).alias("action_score"))
    dossiers = t.docs.select("seq", F.when(F.col("lang") != "en", F.col("id")).alias("scope"))
    return R.override_chain(base, [actions, dossiers], ["seq"]).select("seq", "scope", "action_score")


@query("jn05_project_children", """
WITH l AS (SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem)
SELECT o_orderkey, count(l_partkey) AS permits_count, coalesce(string_agg(CAST(l_partkey AS VARCHAR), '|' ORDER BY rn), '') AS permits FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1""")
def _(t):
    child = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    out = R.attach_children(
        t.orders.select("o_orderkey"), child, ["o_orderkey"], [F.desc("l_shipdate"), "l_linenumber", "l_partkey", "l_suppkey"], ["l_partkey"], "permits"
    )
    return out.select("o_orderkey", "permits_count", F.coalesce(F.array_join(F.transform("permits", lambda s: s["l_partkey"].cast("string")), "|"), F.lit("")).alias("permits"))


@query("jn06_permit_with_project", """
SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def _(t):
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")
    return t.orders.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "n_name")


@query("jn07_company_membership", "SELECT DISTINCT s_suppkey, l_orderkey FROM supplier JOIN lineitem ON l_suppkey = s_suppkey")
def _(t):
    facts = t.lineitem.select("l_orderkey", "l_suppkey").distinct()
    return facts.join(t.supplier.select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey")).select("s_suppkey", "l_orderkey")


RELATION = """CASE WHEN a.company_type = 'Developer' AND b.company_type = 'General Contractor' THEN 'developer_gc' WHEN a.company_type = 'Developer' AND b.company_type = 'Architect' THEN 'developer_architect'
  WHEN a.company_type = 'Developer' AND b.company_type = 'Engineer' THEN 'developer_engineer' WHEN a.company_type = 'Developer' AND b.company_type <> 'Developer' THEN 'developer_trade_contractor'
  WHEN a.company_type = 'General Contractor' AND b.company_type <> 'Developer' THEN 'gc_trade_contractor' END"""


@query("jn08_company_pairs_in_project", f"""
SELECT * FROM (SELECT a.project_id, a.company_id AS from_id, b.company_id AS to_id, {RELATION} AS relation
FROM (SELECT DISTINCT project_id, company_id, company_type FROM facts) a JOIN (SELECT DISTINCT project_id, company_id, company_type FROM facts) b ON a.project_id = b.project_id AND a.company_id <> b.company_id) WHERE relation IS NOT NULL""")
def _(t):
    from plumbline.plans.companies import project_pairs

    return project_pairs(t.facts).select("project_id", F.col("a_company_id").alias("from_id"), F.col("b_company_id").alias("to_id"), "relation")


@query("jn11_document_by_id_or_name", """
SELECT o.seq, coalesce(d1.seq, d2.first_seq) AS doc_seq FROM opps o LEFT JOIN docs d1 ON d1.seq = o.seq
LEFT JOIN (SELECT trim(regexp_replace(lower(project_name), '[^a-z0-9]+', ' ', 'g')) AS k, min(seq) AS first_seq FROM docs GROUP BY 1) d2 ON d2.k = trim(regexp_replace(lower(o.project_name), '[^a-z0-9]+', ' ', 'g'))""")
def _(t):
    by_id = t.docs.select("seq", F.col("seq").alias("id_hit"))
    by_name = t.docs.groupBy(X.normalize_key("project_name").alias("k")).agg(F.min("seq").alias("name_hit"))
    o = t.opps.select("seq", X.normalize_key("project_name").alias("k"))
    return o.join(by_id, "seq", "left").join(by_name, "k", "left").select("seq", F.coalesce("id_hit", "name_hit").alias("doc_seq"))


@query("jn12_contact_seed_union", """
SELECT key, source, count(*) AS n FROM (SELECT company AS key, 'resolution' AS source FROM contacts WHERE phone <> '' OR email <> '' OR name <> ''
 UNION ALL SELECT company_name, 'web' FROM web WHERE phone IS NOT NULL OR email IS NOT NULL UNION ALL SELECT business_name, 'licence' FROM licences WHERE business_phone <> ''
 UNION ALL SELECT applicant, 'planning' FROM planning WHERE applicant <> '' UNION ALL SELECT company_name, 'trade_partner' FROM web WHERE trade_partner_portal_url IS NOT NULL) GROUP BY ALL""")
def _(t):
    part = lambda df, c, s: df.select(F.col(c).alias("key"), F.lit(s).alias("source"))
    rows = R.union_all(
        part(t.contacts.filter("phone <> '' OR email <> '' OR name <> ''"), "company", "resolution"),
        part(t.web.filter("phone IS NOT NULL OR email IS NOT NULL"), "company_name", "web"),
        part(t.licences.filter("business_phone <> ''"), "business_name", "licence"),
        part(t.planning.filter("applicant <> ''"), "applicant", "planning"),
        part(t.web.filter("trade_partner_portal_url IS NOT NULL"), "company_name", "trade_partner"),
    )
    return rows.groupBy("key", "source").agg(F.count(F.lit(1)).alias("n"))


@query("jn13_enrichment_precedence", f"""
WITH lic AS (SELECT {V1.format('business_name')} AS k, min_by(business_phone, seq) AS lp, min_by(license_no, seq) AS license_no FROM licences WHERE business_phone <> '' GROUP BY 1),
con AS (SELECT {V1.format('company')} AS k, min_by(phone, contact_seq) AS cp FROM contacts WHERE phone <> '' GROUP BY 1)
SELECT w.seq, coalesce(lic.lp, w.phone, con.cp) AS phone, license_no, CAST(CASE WHEN coalesce(lic.lp, w.phone, con.cp) IS NOT NULL THEN (CASE WHEN license_no IS NOT NULL THEN 0.92 WHEN w.phone IS NOT NULL THEN 0.75 ELSE 0.7 END)
  WHEN w.email IS NOT NULL THEN 0.65 ELSE 0.2 END AS DOUBLE) AS confidence FROM (SELECT *, {V1.format('company_name')} AS k FROM web) w LEFT JOIN lic ON lic.k = w.k LEFT JOIN con ON con.k = w.k""")
def _(t):
    lic = t.licences.filter("business_phone <> ''").groupBy(X.normalize_name_v1("business_name").alias("k")).agg(
        F.min_by("business_phone", "seq").alias("lp"), F.min_by("license_no", "seq").alias("license_no"))
    con = t.contacts.filter("phone <> ''").groupBy(X.normalize_name_v1("company").alias("k")).agg(F.min_by("phone", "contact_seq").alias("cp"))
    w = t.web.withColumn("k", X.normalize_name_v1("company_name")).join(lic, "k", "left").join(con, "k", "left")
    phone = F.coalesce("lp", "phone", "cp")
    conf = F.when(phone.isNotNull(), F.when(F.col("license_no").isNotNull(), 0.92).when(F.col("phone").isNotNull(), 0.75).otherwise(0.7)).when(
        F.col("email").isNotNull(), 0.65).otherwise(0.2)
    return w.select("seq", phone.alias("phone"), "license_no", conf.alias("confidence"))


@query("jn14_semi_flags", """
SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS has_return,
  o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AS building FROM orders""")
def _(t):
    returned = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    building = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    out = R.flag_semi(R.flag_semi(t.orders, returned, "o_orderkey", "has_return"), building, "o_custkey", "building")
    return out.select("o_orderkey", "has_return", "building")


@query("jn15_missing_labels", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def _(t):
    return t.documents.select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti")


@query("jn16_bidable_contacts", "SELECT contact_seq FROM contacts WHERE opportunity_id IN (SELECT id FROM opps WHERE fencing_signal_presence)")
def _(t):
    ids = t.opps.filter("fencing_signal_presence").select(F.col("id").alias("opportunity_id"))
    return t.contacts.join(ids, "opportunity_id", "left_semi").select("contact_seq")


@query("jn17_edge_labels", """
SELECT s_suppkey, s_name AS src_label, n_name AS dst_label FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def _(t):
    nodes = t.supplier.select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("label")).unionByName(
        t.nation.select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("label")))
    edges = t.supplier.select("s_suppkey", F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("src"), F.concat(F.lit("n:"), F.col("s_nationkey").cast("string")).alias("dst"))
    return R.edge_labels(edges, nodes).select("s_suppkey", "src_label", "dst_label")


@query("jn18_two_hop", """
SELECT DISTINCT company_id FROM facts WHERE county = 'Placer County' AND company_type IN ('Developer', 'General Contractor')""")
def _(t):
    located = t.facts.select("project_id", "county").distinct().filter("county = 'Placer County'").select("project_id")
    involved = t.facts.filter(F.col("company_type").isin("Developer", "General Contractor")).select("project_id", "company_id").distinct()
    return involved.join(located, "project_id", "left_semi").select("company_id").distinct()


@query("jn19_slug_to_edges", """
SELECT w.seq, count(f.project_id) AS edges FROM web w LEFT JOIN facts f ON regexp_replace(lower(f.company_name), '[^a-z0-9]+', '-', 'g') = regexp_replace(lower(w.company_name), '[^a-z0-9]+', '-', 'g') GROUP BY 1""")
def _(t):
    counts = t.facts.groupBy(X.slug("company_name").alias("k")).agg(F.count(F.lit(1)).alias("edges"))
    return t.web.select("seq", X.slug("company_name").alias("k")).join(counts, "k", "left").select("seq", F.coalesce("edges", F.lit(0)).alias("edges"))


@query("jn20_expand_top_companies", """
SELECT s_suppkey, count(l_orderkey) FILTER (l_returnflag = 'A') AS actionable, count(l_orderkey) FILTER (l_returnflag = 'R') AS research, count(l_orderkey) AS total
FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1""")
def _(t):
    counts = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.count_if(F.col("l_returnflag") == "A").alias("actionable"), F.count_if(F.col("l_returnflag") == "R").alias("research"), F.count(F.lit(1)).alias("total"))
    return t.supplier.select("s_suppkey").join(counts, "s_suppkey", "left").na.fill(0)


# --- set operations -----------------------------------------------------------------------
@query("st01_union_all", """
SELECT seq, 'A' AS source, project_name AS name, CAST(NULL AS VARCHAR) AS jurisdiction FROM permits_a UNION ALL SELECT seq, 'B', project, jurisdiction FROM permits_b UNION ALL SELECT seq, 'P', title, jurisdiction FROM planning""")
def _(t):
    a = t.permits_a.select("seq", F.lit("A").alias("source"), F.col("project_name").alias("name"))
    b = t.permits_b.select("seq", F.lit("B").alias("source"), F.col("project").alias("name"), "jurisdiction")
    p = t.planning.select("seq", F.lit("P").alias("source"), F.col("title").alias("name"), "jurisdiction")
    return R.union_all(a, b, p).select("seq", "source", "name", "jurisdiction")


@query("st02_distinct_union_of_arrays", """
SELECT seq, array_to_string(list_sort(list_distinct(list_concat(string_split(trade, ', '), [project_stage, fast_money_potential]))), '|') AS labels FROM opps""")
def _(t):
    labels = F.array_union(F.split("trade", ", "), F.array("project_stage", "fast_money_potential"))
    return t.opps.select("seq", F.array_join(F.array_sort(labels), "|").alias("labels"))


@query("st03_set_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def _(t):
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey").join(urgent, "c_custkey", "left_anti")


@query("st04_token_overlap", """
SELECT seq, len(list_intersect(list_distinct(string_split(lower(project_name), ' ')), list_distinct(string_split(lower(project_description), ' ')))) AS shared FROM opps""")
def _(t):
    return t.opps.select("seq", F.size(F.array_intersect(F.split(F.lower("project_name"), " "), F.split(F.lower("project_description"), " "))).cast("bigint").alias("shared"))
