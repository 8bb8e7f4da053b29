"""Registered queries: text extraction over whole texts (EX-*, SC-10, AG-21, AG-22)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.base import q, query, rx, sql_first, sql_multi
from plumbline.catalog.classify_scope import FENCE_OK, GATE_OK, placeholder
from plumbline.catalog.relational import V1
from plumbline.functions import text as X
from plumbline.operators import extract as E
from plumbline.operators.keyed import first_per_key
from plumbline.plans import vocab as V

SQ = lambda e: f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"


def scope_sql(i, kind, category, label, p):
    first = f"regexp_extract(text, {q(p)}, 0, 'i')"
    pos = f"strpos(text, {first})"
    win = f"substr(text, greatest(1, {pos} - 60), {pos} + length({first}) + 60 - greatest(1, {pos} - 60))"
    return f"""SELECT seq, {q(kind)} AS kind, len(regexp_extract_all(text, {q(p)}, 0, 'i')) AS mentions, nullif({SQ(f"regexp_extract({win}, {q(V.NEARBY_QUANTITY)}, 0, 'i')")}, '') AS quantity FROM docs WHERE regexp_matches(text, {q(p)}, 'i')"""


@query("ex01_scope_items", " UNION ALL ".join(scope_sql(i, *r) for i, r in enumerate(V.SCOPE_ITEMS)).replace("nullif(trim", "nullif(trim").replace("AS quantity", "AS quantity"))
def _(t):
    return E.scope_items(t.docs, "text", "seq").select("seq", "kind", "mentions", "quantity")


def quantity_sql(i, kind, p):
    return f"""SELECT seq, text, {i} AS position, {q(kind)} AS kind, split_part(pieces[j], chr(2), 1) AS raw, length(replace(array_to_string(pieces[1:j - 1], ''), chr(2), '')) + 1 AS pos FROM
 (SELECT seq, text, pieces, unnest(range(2, len(pieces) + 1)) AS j FROM (SELECT seq, text, string_split(regexp_replace(text, {q('(' + p + ')')}, chr(1) || '\\1' || chr(2), 'gi'), chr(1)) AS pieces FROM docs))"""


QUANT = f"""
WITH f AS ({" UNION ALL ".join(quantity_sql(i, k, p) for i, (k, p) in enumerate(V.QUANTITIES))}),
c AS (SELECT seq, position, kind, pos, {SQ('raw')} AS quantity, {SQ("substr(text, greatest(1, pos - 90), least(length(text), pos - 1 + 90) - greatest(1, pos - 90) + 1)")} AS context FROM f),
o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY seq, kind, quantity, substr(context, 1, 40) ORDER BY pos) = 1)
SELECT seq, kind, quantity, context, CASE WHEN {rx('context', V.QUANTITY_CONTEXT)} THEN 'high' ELSE 'medium' END AS confidence FROM o QUALIFY row_number() OVER (PARTITION BY seq ORDER BY position, pos) <= 12"""


@query("ex02_quantities", QUANT)
def _(t):
    return E.quantities(t.docs, "text", "seq").select("seq", "kind", "quantity", "context", "confidence")


@query("ex03_nearby_quantity", scope_sql(0, *V.SCOPE_ITEMS[0]).replace(f"{q('chain_link_fence')} AS kind, ", "").replace("len(regexp_extract_all(text, " + q(V.SCOPE_ITEMS[0][3]) + ", 0, 'i')) AS mentions, ", ""))
def _(t):
    p = V.SCOPE_ITEMS[0][3]
    return t.docs.filter(F.col("text").rlike(f"(?i){p}")).select("seq", E.nearby_quantity("text", p).alias("quantity"))


TL = " UNION ALL ".join(f"SELECT seq, {i} AS position, {q(k)} AS kind, unnest(vals) AS v, unnest(range(1, len(vals) + 1)) AS pos FROM (SELECT seq, regexp_extract_all(text, {q(p)}, 1, 'i') AS vals FROM docs)" for i, (k, l, p) in enumerate(V.TIMELINE))


@query("ex04_timeline", f"""
WITH f AS (SELECT seq, position, kind, pos, {SQ('v')} AS value FROM ({TL})), o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY seq, kind, value ORDER BY pos) = 1)
SELECT seq, kind, value FROM o QUALIFY row_number() OVER (PARTITION BY seq ORDER BY position, pos) <= 10""")
def _(t):
    return E.timeline_signals(t.docs, "text", "seq").select("seq", "kind", "value")


PROC = " + ".join(f"len(regexp_extract_all(text, {q(p)}, 0, 'i'))" for _, p in V.PROCUREMENT_PATHS)


@query("ex05_procurement", f"""
SELECT seq, coalesce({sql_first('text', V.PROCUREMENT_PATHS)}, CASE WHEN regexp_matches(text, '\\bpermit\\b', 'i') THEN 'Permit / GC Relationship' ELSE 'Unknown' END) AS path, {PROC} AS mentions FROM docs""")
def _(t):
    d = t.docs.withColumn("p", E.procurement("text"))
    total = F.aggregate("p.signals", F.lit(0), lambda a, s: a + s["mentions"])
    return d.select("seq", F.col("p.path").alias("path"), total.alias("mentions"))


CLEAN = lambda e: f"CASE WHEN length({e}) BETWEEN 3 AND 80 AND NOT regexp_matches({e}, '^(the|and|for|with|from)$', 'i') THEN {e} END"
LAB = " UNION ALL ".join(f"SELECT seq, {i} AS position, {q(r)} AS role, unnest(vals) AS v, unnest(range(1, len(vals) + 1)) AS pos FROM (SELECT seq, regexp_extract_all(text, {q(p)}, 1) AS vals FROM docs)" for i, (r, p) in enumerate(V.ROLE_LABELS))
LABELLED = f"""
WITH f AS (SELECT seq, position, role, pos, trim(regexp_replace({SQ('v')}, '[.,;:]+$', '')) AS c FROM ({LAB})), n AS (SELECT seq, position, role, pos, {CLEAN('c')} AS name FROM f),
o AS (SELECT * FROM n WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY seq, role, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) ORDER BY position, pos) = 1),
k AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY seq ORDER BY position, pos) <= 12)"""


@query("ex06_labelled_contacts", LABELLED + " SELECT seq, role, name FROM k")
def _(t):
    return E.labelled_contacts(t.docs, "text", "seq").select("seq", "role", "name")


@query("ex06_best_contact", LABELLED + " SELECT seq, role, name FROM k QUALIFY row_number() OVER (PARTITION BY seq ORDER BY CASE role WHEN 'General Contractor' THEN 0 WHEN 'Developer' THEN 1 ELSE 2 END, position, pos) = 1")
def _(t):
    return E.best_labelled_contact(E.labelled_contacts(t.docs, "text", "seq"), "seq").select("seq", "role", "name")


def win(term, r=110):
    pos = f"strpos(lower(text), {q(term)})"
    return f"CASE WHEN {pos} > 0 THEN {SQ(f'substr(text, greatest(1, {pos} - {r}), least(length(text), {pos} - 1 + {r}) - greatest(1, {pos} - {r}) + 1)')} END"


@query("ex07_trade_evidence", f"SELECT seq, list_filter([{', '.join(win(x) for x in V.DOCUMENT_TRADE_TERMS['Concrete'])}], lambda x: x IS NOT NULL)[1:5] AS s FROM docs".join(
    ["SELECT seq, len(s) AS hits, coalesce(s[1], '') AS first_snippet FROM (", ")"]))
def _(t):
    d = t.docs.withColumn("e", E.trade_evidence("text", "Concrete"))
    return d.select("seq", F.size("e").cast("bigint").alias("hits"), F.coalesce(F.get(F.col("e"), F.lit(0))["snippet"], F.lit("")).alias("first_snippet"))


@query("ex08_risk_signals", f"SELECT seq, {sql_multi('text', V.RISKS)} AS risks FROM docs")
def _(t):
    return t.docs.select("seq", F.array_join(E.risk_signals("text"), "|").alias("risks"))


@query("ex09_evidence_quotes", f"""
WITH s AS (SELECT seq, list_filter([{', '.join(win(x) for x in V.DOCUMENT_TRADE_TERMS['Fencing'])}], lambda x: x IS NOT NULL)[1:3] AS a, list_filter([{', '.join(win(x, 90) for x in ('square feet', 'linear feet'))}], lambda x: x IS NOT NULL)[1:2] AS b,
  list_filter([{', '.join(win(x, 100) for x in ('gate', 'concrete'))}], lambda x: x IS NOT NULL)[1:2] AS c FROM docs)
SELECT seq, least(6, len(list_distinct(list_transform(list_concat(a, b, c), lambda x: substr(x, 1, 80))))) AS quotes FROM s""")
def _(t):
    lower = F.lower("text")
    at = lambda term, r: F.when(F.instr(lower, term) > 0, F.struct(X.window_snippet("text", F.instr(lower, term), r).alias("text"), F.lit(term).alias("signal")))
    pack = lambda terms, r: F.array_compact(F.array(*[at(x, r) for x in terms]))
    d = t.docs.withColumn("a", pack(V.DOCUMENT_TRADE_TERMS["Fencing"], 110)).withColumn("b", pack(["square feet", "linear feet"], 90)).withColumn("c", pack(["gate", "concrete"], 100))
    return d.select("seq", F.size(E.evidence_quotes("a", "b", "c")).cast("bigint").alias("quotes"))


def signal_sql(i, group, label, p, check):
    pos = f"strpos(text, regexp_extract(text, {q(p)}, 0, 'i'))"
    return f"SELECT seq, text, {i} AS position, {q(group)} AS grp, {q(label)} AS signal, {q(check)} AS chk, {pos} AS pos FROM docs WHERE regexp_matches(text, {q(p)}, 'i')"


SIGNAL_SQL = f"""
WITH f AS ({" UNION ALL ".join(signal_sql(i, *s) for i, s in enumerate(V.EVIDENCE_SIGNALS))}),
b AS (SELECT *, CASE WHEN contains(substr(text, 1, pos - 1), '.') THEN pos - length(split_part(reverse(substr(text, 1, pos - 1)), '.', 1)) ELSE 1 END AS st, strpos(substr(text, pos), '.') AS rel FROM f),
n AS (SELECT seq, position, grp, signal, chk, {SQ("substr(text, st, (CASE WHEN rel > 0 THEN pos + rel - 1 ELSE least(length(text), pos - 1 + 180) END) - st + 1)")} AS snippet FROM b),
v AS (SELECT *, substr({SQ('lower(snippet)')}, 1, 160) AS k FROM (SELECT *, lower(snippet) AS s FROM n) WHERE CASE chk WHEN 'fence' THEN ({FENCE_OK}) WHEN 'gate' THEN ({GATE_OK}) ELSE true END),
o AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY seq, grp, signal, k ORDER BY position) = 1),
r AS (SELECT * FROM o WHERE grp = 'strong' UNION ALL SELECT * FROM o w WHERE grp = 'weak' AND NOT EXISTS (SELECT 1 FROM o s WHERE s.grp = 'strong' AND s.seq = w.seq AND s.k = w.k)
  UNION ALL SELECT * FROM o w WHERE grp = 'negative' AND NOT EXISTS (SELECT 1 FROM o s WHERE s.grp = 'strong' AND s.seq = w.seq))"""


@query("ex10_document_signals", SIGNAL_SQL + " SELECT seq, signal, snippet FROM r")
def _(t):
    return E.document_signals(t.docs, "text", "seq").select("seq", "signal", "snippet")


@query("ag22_evidence_rollup", SIGNAL_SQL + """ SELECT seq, count(*) FILTER (grp = 'strong') AS strong, count(*) FILTER (grp = 'weak') AS weak, count(*) FILTER (grp = 'negative') AS negative,
  greatest(0, least(100, count(*) FILTER (grp = 'strong') * 34 - count(*) FILTER (grp = 'negative') * 18)) AS signal_score FROM r GROUP BY 1""")
def _(t):
    return E.signal_summary(E.document_signals(t.docs, "text", "seq"), "seq")


IDS = ", ".join(f"nullif(regexp_extract(text, {q(p)}, 0), '') AS {n}" for n, p in V.IDENTIFIERS.items() if n != "address")


@query("ex11_identifiers", f"SELECT seq, {IDS} FROM docs")
def _(t):
    ids = E.identifiers("text")
    return t.docs.select("seq", *[c.alias(n) for n, c in ids.items() if n != "address"])


ENT = f"""
WITH b AS (SELECT *, project_name || ' ' || project_description AS blob FROM opps),
e AS (SELECT seq, 'developer' AS type, developer AS value, 0.9 AS confidence, 0 AS pos FROM b UNION ALL SELECT seq, 'gc', contractor, 0.88, 1 FROM b UNION ALL SELECT seq, 'city', city, 0.72, 2 FROM b UNION ALL SELECT seq, 'county', county, 0.72, 3 FROM b
 UNION ALL SELECT seq, 'trade', string_split(trade, ',')[1], 0.7, 4 FROM b UNION ALL SELECT seq, 'subdivision', CASE WHEN {rx('blob', V.ENTITY_SUBDIVISION_CUE)} THEN coalesce(nullif(regexp_extract(blob, {q(V.ENTITY_VILLAGE)}, 0), ''), nullif(regexp_extract(blob, {q(V.ENTITY_SUBDIVISION)}, 0), '')) END, 0.72, 6 FROM b
 UNION ALL SELECT seq, 'address', nullif(regexp_extract(blob, {q(V.ENTITY_ADDRESS)}, 0), ''), 0.72, 7 FROM b),
n AS (SELECT *, trim(regexp_replace(regexp_replace(lower(trim(value)), {q(X.SUFFIXES_V3)}, '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS norm FROM e WHERE value IS NOT NULL AND trim(value) <> '' AND NOT regexp_matches(value, '^(unknown|n/a|none)$', 'i'))
SELECT seq, type, norm, CAST(confidence AS DOUBLE) AS confidence FROM n QUALIFY row_number() OVER (PARTITION BY seq, type, norm ORDER BY pos) = 1"""


@query("ex12_research_entities", ENT)
def _(t):
    e = E.research_entities(t.opps, "seq", "project_name", "project_description", "developer", "contractor", "city", "county", "trade")
    return e.select("seq", "type", "norm", "confidence")


BIZ = "'Work for ' || first || ' Academy and (' || first || ' Homes) near ' || first || ' ' || second || ' Daycare. ' || work_description"
BIZ_SQL = f"(SELECT seq, contractor, {BIZ} AS text FROM (SELECT seq, work_description, contractor, split_part(contractor, ' ', 1) AS first, split_part(contractor, ' ', 2) AS second FROM permits_a WHERE contractor IS NOT NULL))"


@query("ex13_described_businesses", " UNION ".join(
    f"SELECT seq, {SQ('v')} AS business_name FROM (SELECT seq, contractor, unnest(regexp_extract_all(text, {q(p)}, 1)) AS v FROM {BIZ_SQL}) WHERE length({SQ('v')}) BETWEEN 4 AND 80" for p in E.BUSINESS_PATTERNS))
def _(t):
    p = t.permits_a.filter("contractor IS NOT NULL").withColumn("first", F.split("contractor", " ")[0]).withColumn("second", F.coalesce(F.get(F.split("contractor", " "), F.lit(1)), F.lit("")))
    p = p.withColumn("text", F.expr("concat('Work for ', first, ' Academy and (', first, ' Homes) near ', first, ' ', second, ' Daycare. ', work_description)"))
    return E.described_businesses(p, "text", "contractor", "seq").distinct()


def payloads(t):
    return t.planning.withColumn("payload", F.to_json(F.struct(F.col("applicant").alias("Applicant_Name"), F.col("owner").alias("Property_Owner"), F.col("owner").alias("ProjectManager"), "status", "apn")))


@query("ex14_harvest_companies", f"""
SELECT seq, name, role FROM (SELECT seq, trim(applicant) AS name, 'Applicant' AS role, 1 AS o FROM planning UNION ALL SELECT seq, trim(owner), 'Property Owner', 2 FROM planning) WHERE name <> '' AND NOT {placeholder('name')}""")
def _(t):
    return E.harvest_companies(payloads(t), "payload", "seq").select("seq", "name", "role")


@query("ex15_harvest_people", """
SELECT seq, owner AS person, CASE WHEN true THEN 'Project Manager' END AS role FROM planning WHERE NOT regexp_matches(owner, '\\d|@') AND len(string_split(owner, ' ')) BETWEEN 2 AND 4
 AND len(list_filter(string_split(owner, ' '), lambda w: NOT regexp_full_match(w, '[A-Z][A-Za-z''.-]+'))) = 0""")
def _(t):
    return E.harvest_people(payloads(t), "payload", "seq").select("seq", "person", F.lit("Project Manager").alias("role"))


PHONES = f"list_transform(regexp_extract_all(text, {q(V.PHONE_TEXT)}), lambda v: regexp_replace(v, '\\D', '', 'g'))"


@query("ex16_page_contacts", f"""
SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter({PHONES}, lambda d: length(d) IN (10, 11)), lambda d: CASE WHEN length(d) = 11 THEN d[2:11] ELSE d END), lambda d: d[1:3] <> '555'))), '|') AS phones,
  array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, {q(V.EMAIL_TEXT)}, 0, 'i'), lambda e: lower(e)), lambda e: NOT regexp_matches(e, {q(V.SCRAPE_BLOCKED_EMAILS)}) AND NOT regexp_matches(e, '^(user|test|name)@')))), '|') AS emails
FROM (SELECT doc_id AS id, text FROM documents UNION ALL SELECT page_id + 1000000000, html FROM pages)""")
def _(t):
    rows = t.documents.select(F.col("doc_id").alias("id"), "text").unionByName(t.pages.select((F.col("page_id") + 1000000000).alias("id"), F.col("html").alias("text")))
    digits = F.transform(E.page_phones("text"), lambda p: F.regexp_replace(p, r"\D", ""))
    return rows.select("id", F.array_join(F.array_sort(digits), "|").alias("phones"), F.array_join(F.array_sort(E.page_emails("text")), "|").alias("emails"))


ETYPE = sql_first("lower(role)", [(l, n) for l, n in V.EXTRACTION_TYPES], "known_contractor")


@query("ex17_extraction_rows", f"""
SELECT opportunity_id, extraction_type, entity_name FROM (SELECT opportunity_id, {ETYPE} AS extraction_type, company AS entity_name FROM contacts
 UNION ALL SELECT id, 'trade_reference', unnest(string_split(trade, ', ')) FROM opps UNION ALL SELECT id, 'award_information', procurement_route FROM opps WHERE procurement_route <> 'Unknown')""")
def _(t):
    docs = t.opps.select(F.col("id").alias("opportunity_id"), F.col("procurement_route").alias("award_information"))
    companies = t.contacts.select("opportunity_id", F.col("company").alias("name"), "role")
    trades = t.opps.select(F.col("id").alias("opportunity_id"), F.explode(F.split("trade", ", ")).alias("trade"))
    return E.extraction_rows(docs, companies, trades, "opportunity_id").select("opportunity_id", "extraction_type", "entity_name")


@query("cl39_extraction_type", f"SELECT contact_seq, {ETYPE} AS kind FROM contacts")
def _(t):
    return t.contacts.select("contact_seq", E.extraction_type("role").alias("kind"))


@query("ex19_evidence_phrases", """
SELECT seq, concat_ws('|', CASE WHEN regexp_matches(lower(project_name), 'gate|roof|solar') THEN trim(regexp_replace(project_name, '\\s+', ' ', 'g')) END, CASE WHEN regexp_matches(lower(project_description), 'gate|roof|solar') AND lower(project_description) <> lower(project_name) THEN trim(regexp_replace(project_description, '\\s+', ' ', 'g')) END) AS phrases FROM opps""")
def _(t):
    return t.opps.select("seq", F.array_join(E.evidence_phrases(F.array("project_name", "project_description"), ["gate", "roof", "solar"]), "|").alias("phrases"))


@query("ex20_discover_sources", """
WITH l AS (SELECT seq, 'local-' || id AS source_id, project_name || chr(10) || project_description AS seed, 0 AS p FROM opps UNION ALL SELECT o.seq, 'doc-' || CAST(d.seq AS VARCHAR), d.project_name, 1 FROM opps o JOIN docs d ON d.seq = o.seq
 UNION ALL SELECT seq, 'source-' || id, '', 2 FROM opps UNION ALL SELECT seq, 'local-' || id, 'later copy', 3 FROM opps)
SELECT seq, source_id, p AS priority, CASE WHEN length(trim(seed)) >= 40 AND p <> 2 THEN 'local_record' WHEN trim(seed) <> '' THEN 'local_summary' ELSE 'none' END AS text_source FROM l QUALIFY row_number() OVER (PARTITION BY seq, source_id ORDER BY p) = 1""")
def _(t):
    none = F.lit(None).cast("string")
    layer = lambda df, sid, seed, url: df.select("seq", sid.alias("source_id"), F.lit("x").alias("label"), F.lit("y").alias("source_type"), url.alias("source_url"), seed.alias("seed_text"))
    o = t.opps
    local = F.concat(F.lit("local-"), "id")
    d = t.docs.select("seq", "project_name").join(o.select("seq"), "seq")
    layers = [
        layer(o, local, F.concat("project_name", F.lit("\n"), "project_description"), none), layer(d, F.concat(F.lit("doc-"), F.col("seq").cast("string")), F.col("project_name"), none),
        layer(o, F.concat(F.lit("source-"), "id"), F.lit(""), F.col("source_url")), layer(o, local, F.lit("later copy"), none),
    ]
    return E.discover_sources(layers, "seq").select("seq", "source_id", "priority", "text_source")


LABELS_SQL = "list_filter([" + ", ".join(f"CASE WHEN {rx('text', p)} THEN {q(l)} END" for _, _, l, p in V.SCOPE_ITEMS) + "], lambda x: x IS NOT NULL)"


@query("ex21_summaries", f"""
SELECT seq, CASE WHEN len(l) > 0 THEN 'Identified work: ' || array_to_string(l[1:4], ', ') || '.' ELSE 'Construction details are limited to the available source records.' END AS construction, CASE WHEN len(l) > 0 THEN array_to_string(l[1:3], ', ') ELSE project_name END AS built
FROM (SELECT seq, project_name, {LABELS_SQL} AS l FROM docs)""")
def _(t):
    from plumbline.functions.rules import multi_label

    d = t.docs.withColumn("l", multi_label("text", [(label, p) for _, _, label, p in V.SCOPE_ITEMS]))
    none = F.array().cast("array<string>")
    return d.select("seq", E.construction_summary(F.col("l"), none).alias("construction"), E.what_is_built(F.lit("Unknown"), F.col("l"), "project_name").alias("built"))


@query("ex22_evidence_trades", """
SELECT DISTINCT seq, trade FROM (SELECT seq, unnest(string_split(trade, ', ')) AS trade FROM opps) WHERE trade IN ('Fencing', 'Concrete', 'HVAC', 'Roofing', 'Electrical', 'Landscaping', 'Site work', 'Security fencing')""")
def _(t):
    meta = F.to_json(F.struct(F.split("trade", ", ").alias("inferred_trades")))
    return E.evidence_trades(t.opps.withColumn("metadata", meta), "seq", "metadata", V.OPPORTUNITY_TRADES)


@query("ex23_resolve_fields", f"""
WITH w AS (SELECT {V1.format('company_name')} AS k, official_website, phone, email, contact_page_url FROM web QUALIFY row_number() OVER (PARTITION BY {V1.format('company_name')} ORDER BY seq) = 1)
SELECT p.seq, w.official_website AS resolved_website, CASE WHEN regexp_matches(w.phone, '\\d{{3}}[-.\\s)]*\\d{{3}}[-.\\s]*\\d{{4}}') AND NOT regexp_matches(w.phone, '\\b555[-\\s]?\\d{{4}}\\b') THEN w.phone END AS resolved_phone,
  CASE WHEN NOT contains(w.email, 'example.com') THEN w.email END AS resolved_email, w.contact_page_url AS resolved_contact_page FROM permits_a p LEFT JOIN w ON w.k = {V1.format('p.contractor')}""")
def _(t):
    w = first_per_key(t.web.withColumn("k", X.normalize_name_v1("company_name")), ["k"], ["seq"])
    p = t.permits_a.select("seq", X.normalize_name_v1("contractor").alias("k"))
    return E.resolve_fields(p, w, "k").select("seq", "resolved_website", "resolved_phone", "resolved_email", "resolved_contact_page")


@query("ag21_contact_harvest", f"""
WITH c AS (SELECT seq, trim(applicant) AS name, 'Applicant' AS role FROM planning WHERE applicant <> '' AND NOT {placeholder('applicant')} UNION ALL SELECT seq, trim(owner), 'Property Owner' FROM planning WHERE NOT {placeholder('owner')}),
w AS (SELECT {V1.format('company_name')} AS k, official_website, phone FROM web QUALIFY row_number() OVER (PARTITION BY {V1.format('company_name')} ORDER BY seq) = 1)
SELECT role, count(*) AS rows, count(official_website) AS with_website, count(*) FILTER (phone NOT LIKE '555%') AS with_phone FROM c LEFT JOIN w ON w.k = {V1.format('c.name')} GROUP BY 1""")
def _(t):
    c = E.harvest_companies(payloads(t), "payload", "seq").withColumn("k", X.normalize_name_v1("name"))
    w = first_per_key(t.web.withColumn("k", X.normalize_name_v1("company_name")), ["k"], ["seq"])
    r = E.resolve_fields(c, w, "k")
    return r.groupBy("role").agg(F.count(F.lit(1)).alias("rows"), F.count("resolved_website").alias("with_website"), F.count("resolved_phone").alias("with_phone"))


TAGS = "script|style|noscript|nav|footer|header|iframe|svg"
NOTAGS = "regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
for _tag in TAGS.split("|"):
    NOTAGS = f"regexp_replace({NOTAGS}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}\\s*>', ' ', 'g')"
CHOSEN = "coalesce(nullif(regexp_extract(h, '(?is)<main\\b[^>]*>(.*)</main\\s*>', 1), ''), nullif(regexp_extract(h, '(?is)<article\\b[^>]*>(.*)</article\\s*>', 1), ''), nullif(regexp_extract(h, '(?is)<body\\b[^>]*>(.*?)(</body\\s*>|$)', 1), ''), h)"
DECODE = "regexp_replace(c, '(?s)<[^>]*>', ' ', 'g')"
for _k, _v in E.ENTITIES.items():
    DECODE = f"replace({DECODE}, {q(_k)}, {q(_v)})"


@query("sc10_html_to_text", f"SELECT page_id, {SQ(DECODE)} AS text FROM (SELECT page_id, {CHOSEN} AS c FROM (SELECT page_id, {NOTAGS} AS h FROM pages))")
def _(t):
    return t.pages.select("page_id", E.html_to_text("html").alias("text"))
