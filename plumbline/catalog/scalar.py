"""Registered queries for the scalar functions (FN-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.base import query, q, rx
from plumbline.functions import contacts as C
from plumbline.functions import text as X


def strip(expr: str, suffixes: str, fill: str = "") -> str:
    return f"trim(regexp_replace(regexp_replace(lower({expr}), {q(suffixes)}, '{fill}', 'g'), '[^a-z0-9]+', ' ', 'g'))"


MONEY = "TRY_CAST(nullif(trim(regexp_replace(valuation, '[$,]', '', 'g')), '') AS DOUBLE)"


@query("fn01_text_or_default", "SELECT seq, coalesce(nullif(trim(project_name), ''), 'Unnamed') AS name FROM permits_a")
def _(t):
    return t.permits_a.select("seq", X.text_or("project_name", "Unnamed").alias("name"))


@query("fn02_parse_money", f"SELECT seq, coalesce({MONEY}, -1) AS amount FROM permits_a")
def _(t):
    return t.permits_a.select("seq", F.coalesce(X.parse_money("valuation"), F.lit(-1.0)).alias("amount"))


@query("fn03_millis_to_date", """
SELECT seq, CAST(CAST(epoch_ms(nullif(finaled_ms, 0)) AS DATE) AS VARCHAR) AS finaled,
       CAST(CAST(epoch_ms(issued_ms) AS DATE) AS VARCHAR) AS issued FROM permits_a""")
def _(t):
    return t.permits_a.select(
        "seq",
        X.millis_to_date("finaled_ms").cast("string").alias("finaled"),
        X.millis_to_date("issued_ms").cast("string").alias("issued"),
    )


@query("fn04_relative_dates", """
SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) - INTERVAL 12 MONTH, '%Y-%m-%d') AS months_ago,
       strftime(CAST(o_orderdate AS DATE) - INTERVAL 30 DAY, '%m/%d/%Y') AS days_ago FROM orders""")
def _(t):
    return t.orders.select(
        "o_orderkey", X.months_ago("o_orderdate", 12).alias("months_ago"), X.days_ago("o_orderdate", 30).alias("days_ago")
    )


@query("fn05_normalize_name_v1", f"SELECT seq, {strip('contractor', X.SUFFIXES_V1)} AS name_key FROM permits_a")
def _(t):
    return t.permits_a.select("seq", X.normalize_name_v1("contractor").alias("name_key"))


ALIASES = [("summit fence", "summit fence group"), ("delta", "delta family")]


@query("fn06_normalize_name_v2", f"""
SELECT seq, CASE WHEN contains(k, 'summit fence') THEN 'summit fence group' WHEN contains(k, 'delta') THEN 'delta family' ELSE k END AS name_key
FROM (SELECT seq, {strip("coalesce(contractor, '')", X.SUFFIXES_V2)} AS k FROM permits_a)""")
def _(t):
    return t.permits_a.select("seq", X.normalize_name_v2("contractor", ALIASES).alias("name_key"))


@query("fn07_normalize_entity_name", f"SELECT seq, {strip('applicant', X.SUFFIXES_V3)} AS name_key FROM planning")
def _(t):
    return t.planning.select("seq", X.normalize_entity_name("applicant").alias("name_key"))


@query("fn08_normalize_license_name", f"""
SELECT seq, trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(full_business_name), '&', ' and '), '[^a-z0-9\\s]', ' ', 'g'),
  {q(X.SUFFIXES_V4)}, ' ', 'g'), '\\s+', ' ', 'g')) AS name_key FROM licences""")
def _(t):
    return t.licences.select("seq", X.normalize_license_name("full_business_name").alias("name_key"))


@query("fn09_normalize_key", "SELECT seq, trim(regexp_replace(lower(coalesce(project_name, '')), '[^a-z0-9]+', ' ', 'g')) AS k FROM permits_a")
def _(t):
    return t.permits_a.select("seq", X.normalize_key("project_name").alias("k"))


@query("fn10_slug_and_stable_id", f"""
SELECT seq, substr(regexp_replace(regexp_replace(lower(company), '[^a-z0-9]+', '-', 'g'), '(^-|-$)', '', 'g'), 1, 80) AS slug,
  substr(regexp_replace({strip("concat_ws('-', nullif(opportunity_id, ''), nullif(role, ''), nullif(company, ''))", X.SUFFIXES_V1)}, '\\s+', '-', 'g'), 1, 180) AS stable_id
FROM (SELECT contact_seq AS seq, * FROM contacts)""")
def _(t):
    return t.contacts.select(
        F.col("contact_seq").alias("seq"), X.slug("company", 80).alias("slug"), X.stable_id("opportunity_id", "role", "company").alias("stable_id")
    )


@query("fn11_project_key", f"SELECT seq, {strip('''coalesce(nullif(project_name, ''), nullif(work_description, ''), '')''', X.PROJECT_KEY_NOISE, ' ')} AS k FROM permits_a")
def _(t):
    return t.permits_a.select("seq", X.project_key("project_name", "work_description").alias("k"))


@query("fn12_package_key", f"""
SELECT seq, trim(regexp_replace(lower(concat_ws(' ', label, coalesce(developer, ''), coalesce(city, ''))), '[^a-z0-9]+', ' ', 'g')) AS k FROM (
  SELECT *, CASE WHEN community <> '' THEN (CASE WHEN starts_with(cue, 'village') THEN 'villages at ' ELSE 'the lakes at ' END) || community
    ELSE substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name,
      '\\blot\\s+\\d+[a-z]?\\b', ' ', 'g'), '\\belevation\\s+[a-z0-9-]+\\b', ' ', 'g'), '\\bplan\\s+\\d+[a-z]?\\b', ' ', 'g'),
      '\\bunit\\s*\\d+\\b', ' ', 'g'), '\\b\\d{{3,5}}\\b', ' ', 'g'), '\\s+', ' ', 'g')), 1, 60) END AS label
  FROM (SELECT *, lower(project_name) AS name, regexp_extract(lower(project_name), {q(X.COMMUNITY_CUE)}, 2) AS community,
        regexp_extract(lower(project_name), {q(X.COMMUNITY_CUE)}, 1) AS cue FROM opps))""")
def _(t):
    return t.opps.select("seq", X.package_key("project_name", "developer", "city").alias("k"))


@query("fn13_normalize_project_id", "SELECT seq, regexp_replace(lower(id), '^(sac|placer|sam)-', '') AS project_id FROM opps")
def _(t):
    return t.opps.select("seq", X.normalize_project_id("id").alias("project_id"))


RAISE = """array_to_string(list_transform(string_split(regexp_replace({0}, '\\b(\\w)', chr(1) || '\\1', 'g'), chr(1)),
  lambda p, i: CASE WHEN i = 1 THEN p ELSE upper(p[1]) || p[2:] END), '')"""


@query("fn14_title_case", f"""
SELECT seq, regexp_replace(regexp_replace({RAISE.format('lower(trim(company_name))')}, '\\bLlc\\b', 'LLC', 'g'), '\\bInc\\b\\.?', 'Inc.', 'g') AS title
FROM (SELECT seq, company_name FROM web UNION ALL SELECT seq, contractor FROM permits_a WHERE contractor IS NOT NULL)""")
def _(t):
    rows = t.web.select("seq", "company_name").unionByName(
        t.permits_a.filter("contractor IS NOT NULL").select("seq", F.col("contractor").alias("company_name"))
    )
    return rows.select("seq", X.title_case("company_name").alias("title"))


@query("fn15_levenshtein", "SELECT p_partkey, levenshtein(p_name, lower(p_type)) AS distance FROM part")
def _(t):
    return t.part.select("p_partkey", F.levenshtein("p_name", F.lower("p_type")).alias("distance"))


@query("fn16_token_jaccard", """
SELECT seq, CASE WHEN len(u) > 0 THEN CAST(floor(len(list_intersect(a, b)) * 1000.0 / len(u) + 0.5) AS BIGINT) ELSE 0 END AS jaccard_milli FROM (
  SELECT seq, a, b, list_distinct(list_concat(a, b)) AS u FROM (
    SELECT seq, list_distinct(string_split(trim(regexp_replace(lower(applicant), '[^a-z0-9]+', ' ', 'g')), ' ')) AS a,
           list_distinct(string_split(trim(regexp_replace(lower(owner), '[^a-z0-9]+', ' ', 'g')), ' ')) AS b FROM planning))""")
def _(t):
    a, b = (F.array_distinct(F.split(X.normalize_key(c), " ")) for c in ("applicant", "owner"))
    return t.planning.select("seq", F.floor(X.jaccard(a, b) * 1000 + 0.5).alias("jaccard_milli"))


STOPS = ", ".join(q(s) for s in X.SEARCH_STOP_WORDS)


@query("fn17_tokenize", f"""
SELECT doc_id, len(tok) AS n_tokens, array_to_string(list_slice(tok, 1, 5), ' ') AS first_tokens FROM (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 2 AND w NOT IN ({STOPS})) AS tok FROM documents)""")
def _(t):
    tok = X.tokenize("text")
    return t.documents.select(
        "doc_id", F.size(tok).cast("bigint").alias("n_tokens"), F.array_join(F.slice(tok, 1, 5), " ").alias("first_tokens")
    )


@query("fn18_infer_city", """
SELECT seq, CASE WHEN len(parts) >= 2 THEN coalesce(nullif(trim(regexp_replace(parts[2], '\\s+CA\\s+\\d+.*', '')), ''), 'Sacramento') ELSE 'Sacramento' END AS city
FROM (SELECT seq, list_filter(list_transform(string_split(address, ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM permits_a)""")
def _(t):
    return t.permits_a.select("seq", X.infer_city("address").alias("city"))


@query("fn18_city_before_state", "SELECT seq, nullif(trim(regexp_extract(address, ',\\s*([A-Za-z .''-]+),\\s*CA\\b', 1, 'i')), '') AS city FROM planning")
def _(t):
    return t.planning.select("seq", X.city_before_state("address").alias("city"))


@query("fn19_location_parts", """
SELECT seq, coalesce(parts[1], 'Unknown') AS city, coalesce(list_filter(parts, lambda x: regexp_matches(x, 'county', 'i'))[1], 'Unknown') AS county
FROM (SELECT seq, list_filter(list_transform(string_split(project_location, ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM opps)""")
def _(t):
    p = X.location_parts("project_location")
    return t.opps.select("seq", p["city"].alias("city"), p["county"].alias("county"))


@query("fn20_place_field", """
SELECT seq, json_extract_string(place_json, '$.city.name') AS city, json_extract_string(place_json, '$.state.code') AS state FROM notices""")
def _(t):
    return t.notices.select("seq", X.place_field("place_json", "city.name").alias("city"), X.place_field("place_json", "state.code").alias("state"))


@query("fn20_json_number", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    return t.events.select("event_id", X.place_field("props", "k").cast("bigint").alias("k"))


@query("fn21_format_phone", """
SELECT seq, CASE WHEN d IS NULL THEN NULL WHEN length(d) = 11 AND d[1] = '1' THEN '(' || d[2:4] || ') ' || d[5:7] || '-' || d[8:11]
  WHEN length(d) = 10 THEN '(' || d[1:3] || ') ' || d[4:6] || '-' || d[7:10] ELSE nullif(trim(raw), '') END AS phone
FROM (SELECT seq, business_phone AS raw, regexp_replace(business_phone, '\\D', '', 'g') AS d FROM licences)""")
def _(t):
    return t.licences.select("seq", C.format_phone("business_phone").alias("phone"))


def placeholder(expr: str) -> str:
    return "(" + " OR ".join(rx(expr, p) for p in C.PLACEHOLDER_PATTERNS) + ")"


@query("fn22_safe_values", f"""
SELECT seq, CASE WHEN regexp_matches(trim(phone), '\\d{{3}}[-.\\s)]*\\d{{3}}[-.\\s]*\\d{{4}}') AND NOT regexp_matches(phone, '\\b555[-\\s]?\\d{{4}}\\b') THEN trim(phone) END AS phone,
  CASE WHEN regexp_matches(lower(email), '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') AND NOT {rx('email', C.BLOCKED_EMAIL_HOSTS)} THEN lower(email) END AS email,
  CASE WHEN regexp_matches(website, '^https?://', 'i') AND NOT {placeholder('website')} THEN website END AS website,
  CASE WHEN trim(coalesce(contact_name, '')) <> '' AND NOT {placeholder('contact_name')} THEN trim(contact_name) END AS contact
FROM opps""")
def _(t):
    return t.opps.select(
        "seq", C.safe_phone("phone").alias("phone"), C.safe_email("email").alias("email"),
        C.safe_url("website").alias("website"), C.safe_text("contact_name").alias("contact"),
    )


KNOWN = "(lower(trim({0})) NOT IN ('', 'unknown', 'not identified', 'not available', 'no contact information available', 'n/a', 'none') AND NOT regexp_matches(lower(trim({0})), '^unknown\\b|not (yet )?identified|no (known )?contact|to be determined|\\btbd\\b'))"


@query("fn23_first_known", f"""
SELECT seq, CASE WHEN {KNOWN.format('general_contractor')} THEN general_contractor WHEN {KNOWN.format('developer')} THEN developer
  WHEN {KNOWN.format('architect')} THEN architect END AS who FROM opps""")
def _(t):
    return t.opps.select("seq", C.first_known("general_contractor", "developer", "architect").alias("who"))


@query("fn24_sentence_snippet", """
WITH m AS (SELECT seq, text, strpos(lower(text), 'fence') AS pos FROM docs WHERE strpos(lower(text), 'fence') > 0),
s AS (SELECT *, CASE WHEN contains(substr(text, 1, pos - 1), '.') THEN pos - length(split_part(reverse(substr(text, 1, pos - 1)), '.', 1)) ELSE 1 END AS st,
  strpos(substr(text, pos), '.') AS rel FROM m)
SELECT seq, trim(regexp_replace(substr(text, st, (CASE WHEN rel > 0 THEN pos + rel - 1 ELSE least(length(text), pos - 1 + 180) END) - st + 1), '\\s+', ' ', 'g')) AS snippet FROM s""")
def _(t):
    pos = F.locate("fence", F.lower("text"))
    return t.docs.filter(pos > 0).select("seq", X.sentence_snippet("text", pos).alias("snippet"))


@query("fn25_window_snippet", """
SELECT seq, trim(regexp_replace(substr(text, greatest(1, pos - 90), least(length(text), pos - 1 + 90) - greatest(1, pos - 90) + 1), '\\s+', ' ', 'g')) AS around,
  trim(regexp_replace(substr(text, greatest(1, pos - 50), least(length(text), pos - 1 + 110) - greatest(1, pos - 50) + 1), '\\s+', ' ', 'g')) AS hit
FROM (SELECT seq, text, strpos(lower(text), 'concrete') AS pos FROM docs) WHERE pos > 0""")
def _(t):
    pos = F.locate("concrete", F.lower("text"))
    return t.docs.filter(pos > 0).select(
        "seq", X.window_snippet("text", pos, 90).alias("around"), X.window_snippet("text", pos, 50, 110).alias("hit")
    )


SQUASH = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


@query("fn26_clean_and_truncate", f"""
SELECT turn_id, CASE WHEN length(c) <= 180 THEN c ELSE trim(substr(c, 1, 179)) || '…' END AS short, length(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r', chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]{{2,}}', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) AS clean_len
FROM (SELECT conv_id * 1000 + turn AS turn_id, text, {SQUASH.format('text')} AS c FROM conversations)""")
def _(t):
    return t.conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), X.truncate("text").alias("short"),
        F.length(X.clean_text("text")).cast("bigint").alias("clean_len"),
    )


@query("fn26_clean_description", f"""
SELECT seq, trim(regexp_replace(regexp_replace({SQUASH.format("d")}, '\\s+-\\s+New Building or Addition.*$', '', 'i'), '\\s+-\\s+Miscellaneous,.*$', '', 'i')) AS description
FROM (SELECT seq, work_description || '  - ' || application_subtype || ' - ' || application_type AS d FROM permits_a)""")
def _(t):
    d = F.concat("work_description", F.lit("  - "), "application_subtype", F.lit(" - "), "application_type")
    return t.permits_a.select("seq", X.clean_description(d).alias("description"))


@query("fn27_hash31", """
WITH RECURSIVE w AS (SELECT p_partkey, p_name || '|' || p_brand AS s, 0::BIGINT AS h, 1 AS i FROM part
  UNION ALL SELECT p_partkey, s, (h * 31 + ascii(s[i])) % 4294967296, i + 1 FROM w WHERE i <= length(s))
SELECT p_partkey, lower(printf('%x', h)) AS h FROM w WHERE i = length(s) + 1""")
def _(t):
    return t.part.select("p_partkey", X.hash31(F.concat_ws("|", "p_name", "p_brand")).alias("h"))


@query("fn28_url_key", "SELECT page_id, sha1(url) AS url_key FROM pages")
def _(t):
    return t.pages.select("page_id", X.url_key("url").alias("url_key"))


@query("fn29_date_bounds", """
SELECT seq, CAST(CAST(epoch_ms(least(applied_ms, issued_ms, nullif(finaled_ms, 0))) AS DATE) AS VARCHAR) AS first_seen,
  CAST(CAST(epoch_ms(greatest(applied_ms, issued_ms, nullif(finaled_ms, 0))) AS DATE) AS VARCHAR) AS last_seen FROM permits_a""")
def _(t):
    d = [X.millis_to_date(c) for c in ("applied_ms", "issued_ms", "finaled_ms")]
    return t.permits_a.select("seq", F.least(*d).cast("string").alias("first_seen"), F.greatest(*d).cast("string").alias("last_seen"))


@query("fn30_value_band", f"""
SELECT seq, CASE WHEN v IS NULL OR v = 0 THEN 'Not estimated' WHEN v < 25000 THEN 'Under $25k' WHEN v < 75000 THEN '$25k-$75k' WHEN v < 250000 THEN '$75k-$250k'
  WHEN v < 1000000 THEN '$250k-$1M' ELSE '$1M+' END AS band FROM (SELECT seq, {MONEY} AS v FROM permits_a)""")
def _(t):
    return t.permits_a.select("seq", X.value_band(X.parse_money("valuation")).alias("band"))


@query("fn31_sentence_list", """
SELECT seq, CASE len(a) WHEN 0 THEN '' WHEN 1 THEN a[1] WHEN 2 THEN a[1] || ' and ' || a[2] ELSE array_to_string(a[1:len(a)-1], ', ') || ', and ' || a[len(a)] END AS who,
  concat_ws(' - ', nullif(trim(project_name), ''), nullif(trim(project_description), '')) AS description
FROM (SELECT seq, project_name, project_description, list_filter([developer, general_contractor, architect], lambda x: x IS NOT NULL AND x <> 'Unknown') AS a FROM opps)""")
def _(t):
    who = F.transform(F.array("developer", "general_contractor", "architect"), lambda x: F.nullif(x, F.lit("Unknown")))
    return t.opps.select(
        "seq", X.sentence_list(who).alias("who"), X.build_description("project_name", "project_description", default="").alias("description")
    )


@query("fn32_count_term", """
SELECT seq, CAST((length(text) - length(replace(lower(text), 'con', ''))) / 3 AS BIGINT) AS n FROM docs""")
def _(t):
    return t.docs.select("seq", X.count_term("text", F.lit("con")).alias("n"))


@query("fn33_labels", """
SELECT o_orderkey, '$' || format('{:,}', CAST(floor(o_totalprice + 0.5) AS BIGINT)) AS money, strftime(o_orderdate, '%b %-d, %Y') AS day,
  '$' || format('{:,}', CAST(floor(o_totalprice * 0.5 + 0.5) AS BIGINT)) || ' - $' || format('{:,}', CAST(floor(o_totalprice + 0.5) AS BIGINT)) AS win FROM orders""")
def _(t):
    o = t.orders.withColumn("half", F.col("o_totalprice") * 0.5)
    return o.select("o_orderkey", X.fmt_money("o_totalprice").alias("money"), X.fmt_date("o_orderdate").alias("day"), X.fmt_window("half", "o_totalprice").alias("win"))


@query("fn34_infer_units", """
SELECT seq, CASE WHEN regexp_matches(project_name || ' ' || work_description, 'production home|single[ -]family|sfd', 'i') THEN 1 ELSE 0 END AS units FROM permits_a""")
def _(t):
    return t.permits_a.select("seq", F.coalesce(X.infer_units("project_name", "work_description"), F.lit(0)).alias("units"))


@query("fn35_location_label", "SELECT seq, coalesce(nullif(concat_ws(', ', nullif(city, ''), nullif(county, ''), nullif(architect, '')), ''), 'Unknown') AS label FROM opps")
def _(t):
    return t.opps.select("seq", X.location_label("city", "county", "architect").alias("label"))


@query("fn36_text_blob", """
SELECT seq, lower(concat_ws(' ', nullif(project_name, ''), project_description, developer, general_contractor, city)) AS blob FROM opps""")
def _(t):
    return t.opps.select("seq", X.text_blob("project_name", "project_description", "developer", "general_contractor", "city").alias("blob"))


@query("fn37_contact_label", """
SELECT contact_seq, concat_ws(' | ', coalesce(nullif(name, ''), nullif(title, ''), nullif(company, ''), 'Unknown'), company,
  coalesce(nullif(phone, ''), nullif(email, ''), source), contact_type, CAST(CAST(floor(confidence * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%') AS label FROM contacts""")
def _(t):
    return t.contacts.select("contact_seq", X.contact_label("name", "title", "company", "phone", "email", "source", "contact_type", "confidence").alias("label"))


@query("fn38_titleize_alias", f"""
SELECT seq, {RAISE.format("replace(regexp_replace('company:' || slug, '^[^:]+:', ''), '-', ' ')")} AS titled,
  CASE WHEN contains(k, 'summit fence') THEN 'Summit Fence Group' ELSE trim(company_name) END AS canonical
FROM (SELECT seq, company_name, regexp_replace(regexp_replace(lower(company_name), '[^a-z0-9]+', '-', 'g'), '(^-|-$)', '', 'g') AS slug, {strip('company_name', X.SUFFIXES_V2)} AS k FROM web)""")
def _(t):
    return t.web.select(
        "seq", X.titleize(F.concat(F.lit("company:"), X.slug("company_name"))).alias("titled"),
        X.canonical_company("company_name", [("summit fence", "Summit Fence Group")]).alias("canonical"),
    )


@query("fn39_clean_name", """
SELECT contact_seq, CASE WHEN length(c) BETWEEN 3 AND 80 AND NOT regexp_matches(c, '^(the|and|for|with|from)$', 'i') THEN c END AS clean
FROM (SELECT contact_seq, trim(regexp_replace(trim(regexp_replace(name || ' ' || company || '.;', '\\s+', ' ', 'g')), '[.,;:]+$', '')) AS c FROM contacts)""")
def _(t):
    return t.contacts.select("contact_seq", X.clean_name(F.concat("name", F.lit(" "), "company", F.lit(".;"))).alias("clean"))
