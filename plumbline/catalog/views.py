"""Derived views: record-shaped inputs computed from the given tables.

Each view is one SELECT in SQL that Spark and DuckDB both accept.  The phrase
lists below only give the derived records a vocabulary that the rule tables can
meet; the number of rows always follows the table a view reads.
"""

from __future__ import annotations


def pick(expr: str, values: list[str | None]) -> str:
    whens = " ".join(
        f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'") for i, v in enumerate(values)
    )
    return f"CASE ({expr}) % {len(values)} {whens} END"


def code(expr: str) -> str:
    """Digits of a key spelled with letters, so names differ without numbers."""
    return f"translate(CAST({expr} AS STRING), '0123456789', 'abcdefghij')"


def millis(expr: str, dialect: str) -> str:
    return f"unix_millis(CAST({expr} AS TIMESTAMP))" if dialect == "spark" else f"epoch_ms(CAST({expr} AS TIMESTAMP))"


def plus_days(expr: str, days: str) -> str:
    return f"CAST(CAST({expr} AS DATE) + INTERVAL {days} DAY AS DATE)"


def third(expr: str, n: int) -> str:
    return f"CAST(floor(({expr}) / {n}) AS BIGINT)"


CITIES = ["Sacramento", "Roseville", "Rocklin", "Folsom", "Elk Grove", "Lincoln", "Auburn"]
COUNTIES = ["Sacramento County", "Placer County", "El Dorado County", "Yolo County"]

WORK = [
    "Supply and install automated slide gates, ADA ped gate and fencing with gate operators",
    "Reroof 26 squares with TPO membrane and capsheet",
    "Install new package unit HVAC like for like",
    "Commercial electrical service pedestal for landscape lighting",
    "Ground mount solar photovoltaic system with battery energy storage",
    "Grading and drainage improvements for subdivision lots with storm drain and creek channel work",
    "New production home single family residence, lot 12 plan 3",
    "Tenant improvement of retail office with interior remodel and flooring",
    "Concrete slab on grade, foundation and footing for industrial warehouse",
    "Install chain-link fence 450 LF along the detention basin. Fence height 6 feet",
    "Sewer and water main replacement, utility relocation in public road",
    "School campus classroom addition with security fence and access control",
    "Park trail and playground improvements, irrigation and planting",
    "Demo (shed) and patio cover repair in backyard",
    "Interior painting and cabinets for apartment unit",
    "Building a wood gate at 100 GOLDEN GATE AVE",
    "Electrical panel upgrade, like for like",
    "Parking lot asphalt paving 12,000 square feet with curb and gutter",
    "Retaining walls 85 linear feet and 40 cubic yards of concrete",
    "Mechanical heat pump replacement for commercial building",
    "Installation of steel gate and ornamental iron fencing",
    "Pool safety fencing for single family home",
    "Framing and rough carpentry for duplex addition",
    "Repair of siding",
]
PROJECTS = [
    "Villages at Willow Creek Unit {n}",
    "Southgate Dr reroof",
    "Northgate Business Park",
    "The Lakes at Antelope - Lot {n}",
    "New (Gates)",
    "Riverside School campus {n}",
    "Oak Meadow Subdivision Phase {n}",
    "Elm Street duplex",
    "Logistics warehouse yard {n}",
    "",
    "PLN22-0{n} Creek Realignment",
    "Golden Gate Ave repair",
    "Sunrise Solar {n}",
]
FIRST = ["Summit", "Delta", "Granite", "Valley", "Pacific", "Sierra", "Cedar", "Harbor", "Copper", "Meadow", "Iron", "Quail"]
SECOND = ["Fence", "Builders", "Roofing", "Electric", "Homes", "Engineering", "Concrete"]
SUFFIX = [" LLC", ", Inc.", " Co", ""]


def company(expr: str) -> str:
    """A company name per key; suffix variants of one name share a normal form."""
    return (
        f"{pick(expr, FIRST)} || ' ' || {pick(third(expr, 3), SECOND)} || ' ' || {code(third(expr, 4))} || {pick(expr + ' + 1', SUFFIX)}"
    )


def project_name(key: str, n: str) -> str:
    return f"replace({pick(key, PROJECTS)}, '{{n}}', CAST(1 + ({n}) % 9 AS STRING))"


def permits_a(d: str) -> str:
    k = "o_orderkey"
    return f"""
SELECT {k} AS seq,
  'APP-' || CAST({k} AS STRING) AS application,
  {pick(k + ' + o_custkey', ['Residential Building', 'Commercial Building', 'Electrical', 'Miscellaneous', 'Utility'])} AS application_type,
  {pick(third(k, 7), ['New Building or Addition', 'Single Family', 'Tenant Improvement', '', 'Ground Mount Solar'])} AS application_subtype,
  CASE WHEN o_orderstatus = 'F' AND {k} % 4 = 0 THEN 'Final' WHEN o_orderstatus = 'F' THEN 'Issued' WHEN o_orderstatus = 'O'
       THEN {pick(k, ['In Review', 'Received', 'Approved', 'Pending', ''])} ELSE 'Plan Review Incomplete' END AS application_status,
  {project_name(k, 'o_custkey')} AS project_name,
  {pick(third(k, 2), WORK)} AS work_description,
  {pick('o_custkey', ['FENCE', 'RES', 'COM', 'MECH', ''])} AS activity_code,
  {pick(k, ['', 'x', 'x', 'x', 'x', 'x'])} AS addr_flag,
  CAST(100 + o_custkey % 900 AS STRING) || ' ' || {pick('o_custkey', ['Main St', 'Oak Ave', 'Elm Rd', 'Harbor Blvd'])}
    || CASE WHEN {k} % 6 = 0 THEN '' ELSE ', ' || {pick('o_custkey', CITIES)} || ' CA 95' || CAST(600 + o_custkey % 300 AS STRING) END AS address,
  CASE WHEN o_custkey % 10 = 0 THEN NULL WHEN o_custkey % 10 = 1 THEN 'Owner Builder' WHEN o_custkey % 10 = 2 THEN 'To Be Determined'
       ELSE {company('o_custkey')} END AS contractor,
  CASE WHEN {k} % 5 = 0 THEN NULL ELSE CAST(100 + o_custkey % 900 AS STRING) || '-0' || CAST(10 + {k} % 80 AS STRING) || '-123' END AS parcel_number,
  CASE WHEN {k} % 9 = 0 THEN '' WHEN {k} % 9 = 1 THEN '0'
       ELSE '$' || CAST(CAST(floor(o_totalprice) AS BIGINT) * (1 + {k} % 4) AS STRING) || '.50' END AS valuation,
  {millis('o_orderdate', d)} AS applied_ms,
  CASE WHEN o_orderstatus = 'F' THEN {millis('o_orderdate', d)} + 2592000000 ELSE NULL END AS issued_ms,
  CASE WHEN {k} % 11 = 0 THEN {millis('o_orderdate', d)} + 7776000000 ELSE 0 END AS finaled_ms,
  CAST(o_custkey % 90 AS DOUBLE) / 100 + 38 AS latitude,
  0 - (121 + CAST(o_custkey % 90 AS DOUBLE) / 100) AS longitude
FROM orders"""


def permits_b(d: str) -> str:
    k = "p_partkey"
    return f"""
SELECT {k} AS seq, 'PB-' || CAST({k} AS STRING) AS number,
  {pick(k, WORK)} AS scope, {project_name(k, 'p_size')} AS project, p_name || ' ' || lower(p_type) AS description,
  {pick(third(k, 3), ['Issued', 'Finaled', 'In Review', 'Approved', 'Applied'])} AS status,
  CAST(100 + p_size AS STRING) || ' Ridge Rd, ' || {pick(k, CITIES)} || ', CA' AS address,
  CAST(100 + p_size AS STRING) || '-200-' || CAST(100 + {k} % 800 AS STRING) AS apn,
  {pick(k, COUNTIES)} AS jurisdiction, {k} AS objectid
FROM part"""


def notices(d: str) -> str:
    k = "event_id"
    return f"""
SELECT {k} AS seq, 'N-' || CAST({third(k, 2)} AS STRING) AS notice_id, 'SOL-' || CAST({k} AS STRING) AS solicitation_number,
  {pick(third(k, 2), ['Perimeter fence replacement', 'Roof repair at federal building', 'HVAC chiller overhaul', 'Grading and site utility work', 'Office furniture', 'Concrete sidewalk and fence'])} AS title,
  {pick(third(k, 5), WORK)} AS description,
  {pick(k, ['Solicitation', 'Award Notice', 'Sources Sought', 'Presolicitation'])} AS notice_type,
  CASE WHEN {k} % 7 = 0 THEN 'No' ELSE 'Yes' END AS active,
  CAST(CAST(ts AS DATE) AS STRING) AS posted_date,
  {pick('user_id', ['DEPT OF DEFENSE.ARMY', 'DEPT OF INTERIOR.PARKS', 'GENERAL SERVICES', ''])} AS agency_path,
  '{{"city":{{"name":"' || {pick(k, CITIES)} || '"}},"state":{{"code":"' || {pick(k, ['CA', 'CA', 'NV'])} || '"}},"k":' || CAST({k} % 5 AS STRING) || '}}' AS place_json,
  {pick(k, ['https://sam.gov/opp/', 'http://data.example.org/', '', 'https://agency.gov/doc.pdf?id='])} || CAST({k} AS STRING) AS ui_link,
  value
FROM events"""


def planning(d: str) -> str:
    k = "c_custkey"
    return f"""
SELECT {k} AS seq, 'PLNP' || CAST({third(k, 2)} AS STRING) AS cap_number,
  {project_name(k, 'c_nationkey')} AS title,
  {pick(k, ['Tentative subdivision map for 120 residential lots', 'Rezone and general plan amendment for retail center', 'Short-term rental permit', 'Design review of apartment building with landscape and irrigation', 'Mitigated negative declaration for warehouse', 'Conditional use for self storage; fencing and lighting', 'Pre-application meeting', '', 'Planning commission agenda item for commerce center', 'Specific plan with utilities, grading and concrete sidewalk'])} AS description,
  {pick(third(k, 3), ['Tentative Map;', 'Rezone', 'Design Review', 'Conditional Use Permit', ''])} AS entitlement,
  {pick('c_nationkey', ['Open', 'Closed', 'Withdrawn', 'In Review', 'Approved'])} AS status,
  CAST(100 + {k} % 900 AS STRING) || ' Creek Rd, ' || {pick(k, CITIES)} || ', CA' AS address,
  CASE WHEN {k} % 4 = 0 THEN '' ELSE {company(k)} END AS applicant,
  CASE WHEN {k} % 3 = 0 THEN 'Jane Roe' ELSE {company(third(k, 2))} END AS owner,
  CAST(200 + {k} % 700 AS STRING) || '-011-' || CAST(100 + c_nationkey AS STRING) AS apn,
  {pick(k, ['', '916-000-1234', '(916) 000 4321', '555-1234'])} AS planner_phone,
  {pick(k, ['planner@county.gov', '', 'x@example.com'])} AS planner_email,
  {pick(k, COUNTIES)} AS jurisdiction
FROM customer"""


def opps(d: str) -> str:
    """One wide opportunity row per order: the inputs of the scoring stages."""
    k = "seq"
    return f"""
SELECT {k}, 'sac-app-' || CAST({k} AS STRING) AS id, application, project_name, work_description AS project_description,
  application_type, application_status, contractor, valuation,
  {pick(k, CITIES)} AS city, {pick(third(k, 2), COUNTIES)} AS county,
  {pick(k, CITIES)} || ', ' || {pick(third(k, 2), COUNTIES)} AS project_location,
  {pick(third(k, 4), ['Fencing', 'Roofing', 'Electrical, Solar', 'HVAC', 'Concrete, Site work', 'General', 'Plumbing', 'Landscaping'])} AS trade,
  {pick(third(k, 3), ['Unknown', None, 'Summit Homes LLC', 'Delta Development Partners', 'Kenwood Communities'])} AS developer,
  {pick(third(k, 5), ['Unknown', 'Marl Construction Co', 'Sierra Builders', 'Ace Fence and Gates Inc', None, 'Valley Roofing'])} AS general_contractor,
  {pick(third(k, 6), ['Unknown', 'K Cook Architect', None])} AS architect,
  {pick(third(k, 2), ['Public bid through city portal', 'GC bid list', 'Developer trade partner program', 'Unknown', 'Permit follow-up'])} AS procurement_route,
  {pick(k, ['Register as vendor', 'Call estimating', 'Unknown'])} AS entry_method,
  {pick(third(k, 7), ['County permit desk', 'Vendor registration', 'Unknown'])} AS access_route,
  {pick(k, ['Actionable Opportunity', 'Research Required', 'Opportunity'])} AS opportunity_state,
  {pick(third(k, 2), ['High', 'Medium', 'Low'])} AS evidence_quality,
  {pick(third(k, 3), ['High', 'Medium', 'Low'])} AS fast_money_potential,
  {pick(third(k, 4), ['Active', 'Planning', 'Completed', 'Permitting'])} AS project_stage,
  {k} * 7 % 101 AS qualification_score, {k} * 13 % 101 AS access_score, {k} % 9 AS evidence_count,
  {k} * 11 % 97 AS fence_probability, CASE WHEN {k} % 5 = 0 THEN true ELSE false END AS fencing_signal_presence,
  CASE WHEN {k} % 4 = 0 THEN NULL ELSE {pick(k, ['(916) 000-1234', '916-555-1234', '(530) 000-9999'])} END AS phone,
  CASE WHEN {k} % 3 = 0 THEN {pick(k, ['bids@lund.test', 'info@example.com', 'est@valley.test'])} ELSE NULL END AS email,
  CASE WHEN {k} % 5 < 2 THEN {pick(k, ['https://lund.test', 'http://valley.test', 'ftp://x'])} ELSE NULL END AS website,
  {pick(third(k, 3), ['Jane Roe', 'John Q. Public', 'Estimating Department', None, 'contact 12'])} AS contact_name,
  {pick(third(k, 2), ['Project Manager', 'Estimator', 'Purchasing Agent', 'Owner', 'Named site business', None])} AS contact_title,
  {pick(third(k, 5), ['construction', 'direct', 'general', 'procurement'])} AS contact_type,
  {pick(k, ['High', 'Medium', 'Low', None])} AS contractor_value,
  'https://county.test/record/' || CAST({k} AS STRING) AS source_url,
  latitude, longitude, parcel_number, applied_ms
FROM permits_a"""


def docs(d: str) -> str:
    """Whole document texts followed by a records paragraph."""
    k = "doc_id"
    return f"""
SELECT {k} AS seq, 'doc-' || CAST({k} AS STRING) AS id, lang, source,
  {project_name(k, 'n_chars')} AS project_name,
  text || ' ' || {pick(k, WORK)} || '. ' || {pick(third(k, 3), WORK)} || '. ' ||
  {pick(k, ['Bid due: July 4, 2026.', 'Hearing date: 08/12/2026.', 'Construction start: Q3 2026.', 'Permit issued: 1/2/2026. Expected completion: March 3 2027.', 'No dates given.', 'Approved: June 1, 2026.'])} || ' ' ||
  {pick(third(k, 2), ['Architect: Kevin Cook Studio.', 'General Contractor: Lund Works', 'Developer: Summit Homes, LLC', 'Civil Engineer: Delta Group.', 'Sealed bid and request for proposal; general contractor or subcontractor welcome.', 'Design-build RFQ. Trade partner list.', 'no contacts', 'architect: Kevin Cook Studio.', 'general contractor: Lund Works', 'developer: Summit Homes'])} || ' ' ||
  {pick(third(k, 5), ['APN 123-456-789, lot 12', 'DRS 2024 hearing', '120 planned residential lots', 'fencing not required', 'GC will self-perform; closed permit', 'PLN-22-00123'])} AS text
FROM documents"""


def web(d: str) -> str:
    k = "s_suppkey"
    return f"""
SELECT {k} AS seq, {company(k)} AS company_name,
  CASE WHEN {k} % 5 = 0 THEN NULL ELSE 'https://' || {code(k)} || '.test' END AS official_website,
  {pick(k, ['916-000-1234', '1-530-000-7777', None, '555-1212'])} AS phone,
  {pick(third(k, 2), ['bids@x.test', None, 'a@example.com'])} AS email,
  CASE WHEN {k} % 3 = 0 THEN 'https://' || {code(k)} || '.test/contact' ELSE NULL END AS contact_page_url,
  CASE WHEN {k} % 4 = 0 THEN 'https://' || {code(k)} || '.test/vendor' ELSE NULL END AS vendor_registration_page_url,
  CASE WHEN {k} % 4 = 1 THEN 'https://' || {code(k)} || '.test/subs' ELSE NULL END AS subcontractor_registration_page_url,
  CASE WHEN {k} % 6 = 0 THEN 'https://' || {code(k)} || '.test/trade' ELSE NULL END AS trade_partner_portal_url,
  CASE WHEN {k} % 7 = 0 THEN 'https://' || {code(k)} || '.test/bids' ELSE NULL END AS bid_opportunities_page_url,
  CASE WHEN {k} % 9 = 0 THEN 'https://' || {code(k)} || '.test/plans' ELSE NULL END AS plan_room_url,
  {pick(k, ['Developer', 'General Contractor', 'Architect', 'Engineer', 'Known Contractor'])} AS company_type,
  s_nationkey AS nation_key, s_acctbal AS balance
FROM supplier"""


def licences(d: str) -> str:
    k = "c_custkey"
    return f"""
SELECT {k} AS seq, CAST(500000 + {k} AS STRING) AS license_no,
  {company(third(k, 2))} AS business_name,
  CASE WHEN {k} % 5 = 0 THEN {company(third(k, 2))} || ' and Sons Group' ELSE {company(third(k, 2))} END AS full_business_name,
  {pick(k, ['9160001234', '1 (530) 000-7777', '', '7075551234'])} AS business_phone,
  {pick(k, ['CLEAR', 'EXPIRED', 'Work Comp Susp'])} AS primary_status,
  {pick(k, CITIES)} AS city, {pick(third(k, 2), ['Sacramento', 'Placer', 'Kern', 'Butte'])} AS county
FROM customer"""


def contacts(d: str) -> str:
    """One to four contact rows per opportunity (its order lines)."""
    return f"""
SELECT l_orderkey AS opp_seq, 'sac-app-' || CAST(l_orderkey AS STRING) AS opportunity_id,
  ((l_orderkey * 8 + l_linenumber) * 1000003 + l_partkey % 1000003) * 1009 + l_suppkey % 1009 AS contact_seq, l_linenumber AS line,
  {pick('l_partkey', ['Jane Roe', 'John Q. Public', 'Estimating Department', 'Pat Doe', ''])} AS name,
  {pick('l_suppkey', ['Project Manager', 'Estimator', 'Purchasing Agent', 'Owner', 'Named site business', ''])} AS title,
  {company('l_suppkey')} AS company,
  {pick('l_partkey', ['(916) 000-1234', '', '530-000-7777'])} AS phone,
  {pick('l_suppkey', ['bids@lund.test', '', '', 'e@valley.test'])} AS email,
  {pick('l_linenumber', ['construction', 'direct', 'general', 'procurement', 'development'])} AS contact_type,
  {pick('l_linenumber + l_suppkey', ['Developer', 'General Contractor', 'Architect', 'Property Owner', 'Applicant', 'Engineer'])} AS role,
  CAST(35 + (l_partkey * 7 + l_linenumber) % 60 AS DOUBLE) / 100 AS confidence,
  {pick('l_suppkey', ['permit', 'web', 'licence'])} AS source
FROM lineitem"""


def facts(d: str) -> str:
    """Company-in-project facts: the suppliers of an order, typed by supplier key."""
    return f"""
SELECT l_orderkey AS project_seq, 'p' || CAST(l_orderkey AS STRING) AS project_id, l_suppkey AS company_id,
  {company('l_suppkey')} AS company_name,
  {pick('l_suppkey', ['Developer', 'General Contractor', 'Architect', 'Engineer', 'Known Contractor'])} AS company_type,
  {pick('l_orderkey', ['Residential', 'Commercial', 'Industrial', 'Infrastructure', ''])} AS project_type,
  {pick('l_orderkey', CITIES)} AS city, {pick('l_orderkey', COUNTIES)} AS county,
  {pick('l_partkey', ['Fencing', 'Concrete', 'HVAC', 'Roofing', 'Electrical', 'Landscaping', 'Site work', 'General', 'Painting'])} AS trade,
  CAST(CAST(l_shipdate AS DATE) AS STRING) AS seen_at,
  'https://county.test/p/' || CAST(l_orderkey AS STRING) AS source_url
FROM lineitem"""


def signals(d: str) -> str:
    """Dated signals: one per event, attached to a project by user."""
    return f"""
SELECT event_id AS seq, 's' || CAST(event_id AS STRING) AS id, user_id AS project_seq,
  CASE event_type WHEN 'view' THEN 'Planning Application' WHEN 'click' THEN 'Permit' WHEN 'signup' THEN 'Subdivision Filing'
     WHEN 'purchase' THEN 'Construction Start' ELSE 'Rezoning' END AS signal_type,
  CAST(CAST(ts AS DATE) AS STRING) AS signal_date, ts,
  CAST(floor(value) AS BIGINT) % 101 AS importance_score,
  {pick('event_id', ['County Permits', 'Planning Viewer', 'Notices'])} AS source
FROM events"""


VIEWS = {f.__name__: f for f in (permits_a, permits_b, notices, planning, opps, docs, web, licences, contacts, facts, signals)}
