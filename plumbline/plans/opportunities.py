"""Opportunity generation and scores per (project, trade) (SM-01..05, SM-18..20, EX-18, CL-48, CL-54, NR-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import contacts as C
from plumbline.functions import rules as R
from plumbline.functions import text as X
from plumbline.functions.rules import ColumnOrName, case, col, contains_any, factor, matches
from plumbline.plans import vocab as V


# EX-18
def trade_reasons(text: ColumnOrName, trade: ColumnOrName, inferred: Column | None = None) -> Column:
    """ARRAY<struct(reason, confidence)> of at most five reasons for the row's trade."""
    rows = [
        F.when((col(trade) == t) & contains_any(text, terms), F.struct(F.lit(reason).alias("reason"), F.lit(conf).alias("confidence")))
        for t, terms, reason, conf in V.TRADE_REASONS
    ]
    found = F.slice(F.array_compact(F.array(*rows)), 1, 5)
    if inferred is None:
        return found
    guess = F.array(F.struct(F.concat(col(trade), F.lit(" was selected from source-record trade inference.")).alias("reason"), F.lit(0.6).alias("confidence")))
    return F.when((F.size(found) == 0) & (col(trade) != "General") & inferred, guess).otherwise(found)


# SM-01 (factor names, points and sentences are fixed values)
def opportunity_score(horizon: ColumnOrName, status: ColumnOrName, size: ColumnOrName, trade: ColumnOrName, reasons: ColumnOrName, has_permit: Column,
                      has_source: Column, planning: Column, contractors: ColumnOrName) -> Column:
    """struct(score, factors) with one factor row per applying slot."""
    h, st, sz, tr, n = col(horizon), col(status), col(size), col(trade), col(reasons)
    specific = tr != "General"
    return R.score(
        [
            factor("Base opportunity", F.lit(True), 30, "A normalized public project record exists."),
            factor("Near-term horizon", h == "Fast Money", 20, "Timing evidence places this in the 0-6 month Fast Money window."),
            factor("Pipeline horizon", h == "Pipeline", 12, "Planning or approval evidence places this in the 6-18 month pipeline."),
            factor("Early signal", ~h.isin("Fast Money", "Pipeline"), 5, "Evidence is upstream and useful for monitoring, but bid timing is not yet mature."),
            factor("Permit evidence", has_permit, 15, "Permit records increase confidence that work is moving toward execution."),
            factor("Real source record", has_source, 10, "This recommendation is backed by a collected public source record, not only synthetic project data."),
            factor("Planning evidence", planning, 12, "Planning, land, parcel, CEQA, or utility records support the recommendation."),
            factor("Project scale", sz.isin("Large", "Mega Project"), F.when(sz == "Mega Project", 12).otherwise(9), F.concat(sz, F.lit(" scale suggests multiple trade packages."))),
            factor("Trade fit", specific & (n > 0), F.when(n > 1, 12).otherwise(8), F.concat(tr, F.lit(" is supported by "), n.cast("string"), F.lit(" source-backed trade signal(s)."))),
            factor("Trade fit", specific & (n == 0), 3, F.concat(tr, F.lit(" appears relevant, but supporting trade evidence is limited."))),
            factor("Weak trade specificity", ~specific, -10, "The source record did not support a specific trade match."),
            factor("Open contractor slot", col(contractors) == 0, 10, "No general contractor is attached in the available public evidence."),
            factor("Known contractor", col(contractors) > 0, -8, "A contractor is already named, so outreach should verify whether this scope remains open."),
            factor("Completed project", st == "Completed", -35, "Completed status substantially reduces new-work potential."),
            factor("False-positive control", (st == "Completed") & has_source, -20, "Collected source indicates completed work; only pursue if a related follow-on scope exists."),
        ]
    )


# SM-02 (factor names, points and sentences are fixed values)
def fit_score(status: ColumnOrName, size: ColumnOrName, project_type: ColumnOrName, units: ColumnOrName, signals: Column, contractors: ColumnOrName) -> Column:
    st, sz, pt = col(status), col(size), col(project_type)
    has = lambda *k: F.coalesce(F.arrays_overlap(signals, F.array(*[F.lit(x) for x in k])), F.lit(False))
    return R.score(
        [
            factor("base", F.lit(True), 40),
            factor("reachable stage", st.isin("Planning", "Proposed", "Approved", "Permitted"), 16, F.concat(F.lit("Project is still in a reachable stage: "), st, F.lit("."))),
            factor("underway", st == "Under Construction", -12, "Construction is already underway, so some contracts may be awarded."),
            factor("completed", st == "Completed", -30, "Project appears completed, reducing new-work opportunity."),
            factor("scale", sz.isin("Large", "Mega Project"), F.when(sz == "Mega Project", 14).otherwise(10), F.concat(sz, F.lit(" scale suggests multiple trade opportunities."))),
            factor("residential units", (pt == "Residential") & (F.coalesce(col(units), F.lit(0)) >= 25), 12, "Residential units may require several exterior trades."),
            factor("commercial", pt.isin("Commercial", "Mixed Use"), 8, F.concat(pt, F.lit(" work may create HVAC, roofing, concrete, and buildout opportunities."))),
            factor("infrastructure", (pt == "Infrastructure") | has("Utility Expansion", "Infrastructure Project"), 8, "Infrastructure or utility activity can create site work, fencing, concrete, and electrical demand."),
            factor("early planning", has("Rezoning", "Planning Application", "Subdivision Filing"), 12, "Early planning signals suggest contractor selection may still be open."),
            factor("permit activity", has("Permit") | (st == "Permitted"), 7, "Permit activity suggests work may be approaching start."),
            factor("open slot", col(contractors) == 0, 10, "No known general contractor is attached in public records."),
            factor("contractor named", col(contractors) > 0, -8, "A contractor is already identified in public records."),
        ]
    )


# SM-03
def confidence_breakdown(permits: ColumnOrName, planning: Column, bid_source: Column, sources: ColumnOrName) -> dict[str, Column]:
    return {
        "permit_evidence": F.when(col(permits) > 0, 0.86).otherwise(0.0),
        "planning_evidence": F.when(planning, 0.76).otherwise(0.0),
        "bid_evidence": F.when(bid_source, 0.88).otherwise(0.0),
        "source_agreement": F.least(F.lit(0.95), col(sources) * 0.25),
    }


def resolution_confidence(address: Column, parcels: ColumnOrName, applications: ColumnOrName, evidence: ColumnOrName) -> Column:
    total = R.points([(address, 0.15), (col(parcels) == 1, 0.2), (col(applications) == 1, 0.15), (col(evidence) > 1, 0.05)], 0.45)
    return F.least(F.lit(0.95), R.round_half_up(total, 2))


# SM-04
def structured_contacts(companies: DataFrame, sources: DataFrame, key: str = "project_id") -> DataFrame:
    """Contacts from company rows and source records, placeholders out, first per (company, role, source).

    companies(key, name, role, phone, email, website, notes, seq); sources(key, contractor, agency, source_name, source_url, seq).
    """
    from plumbline.operators.keyed import first_per_key
    from plumbline.plans.permits import contact_role

    none = lambda: F.lit(None).cast("string")
    route = F.coalesce(F.col("phone"), F.col("email"), F.col("website")).isNotNull()
    a = companies.select(
        key, F.col("name").alias("company"), "phone", "email", "website", contact_role("role").alias("role"), F.when(route, 0.78).otherwise(0.62).alias("confidence"),
        F.coalesce("notes", F.lit("Project company record")).alias("source"), F.lit(0).alias("_part"), "seq")
    who = F.lower("contractor")
    b = sources.filter(C.is_source_backed("contractor")).select(
        key, F.trim("contractor").alias("company"), none().alias("phone"), none().alias("email"), none().alias("website"),
        F.when(who.contains("owner"), "Property Owner").otherwise("General Contractor").alias("role"), F.when(who.contains("owner builder"), 0.55).otherwise(0.74).alias("confidence"),
        F.col("source_name").alias("source"), F.lit(1).alias("_part"), "seq")
    g = sources.filter(X.text_or("agency") != "").select(
        key, F.trim("agency").alias("company"), none().alias("phone"), none().alias("email"), F.col("source_url").alias("website"), F.lit("Government Contact").alias("role"),
        F.lit(0.72).alias("confidence"), F.col("source_name").alias("source"), F.lit(2).alias("_part"), "seq")
    rows = a.unionByName(b).unionByName(g).filter(~C.is_placeholder("company", "phone", "email", "website", "source"))
    rows = rows.withColumn("_k", F.lower(F.concat_ws("-", "company", "role", "source")))
    return first_per_key(rows, [key, "_k"], ["_part", "seq"]).drop("_k", "_part")


# SM-05
def fast_money_score(horizon: ColumnOrName, start: ColumnOrName, completion: ColumnOrName, actionable: Column) -> Column:
    base = case([(col(horizon) == "Fast Money", 70), (col(horizon) == "Pipeline", 45)], 25)
    return F.least(F.lit(100), base + R.points([(F.coalesce(col(start), F.lit(99)) <= 3, 12), (F.coalesce(col(completion), F.lit(99)) <= 6, 12), (actionable, 6)], 0))


def project_access_score(has_contact: Column, evidence: ColumnOrName, has_company: Column, live_signal: Column, has_url: Column) -> Column:
    return F.least(F.lit(100), R.points(
        [(has_contact, 45), (col(evidence) > 0, F.least(F.lit(25), col(evidence) * 8)), (has_company, 15), (live_signal, 10), (has_url, 5)], 0))


# CL-54
def opportunity_action(horizon: ColumnOrName, contact: ColumnOrName) -> Column:
    named = F.coalesce(col(contact), F.lit("")) != ""
    return case(
        [
            ((col(horizon) == "Fast Money") & named, F.concat(F.lit("Contact "), col(contact), F.lit(" and verify whether the trade package is still open."))),
            (col(horizon) == "Fast Money", "Pull the permit packet and identify the applicant, owner, or listed contractor."),
            (col(horizon) == "Pipeline", "Save the opportunity, monitor permit conversion, and contact the developer before bid packages close."),
        ],
        "Track parcel, planning, CEQA, and utility activity until a project application or permit appears.",
    )


# SM-18
def resolution_score(role: Column, website: Column, linkedin: Column, phone: Column, contact_page: Column, staff_directory: Column, person: Column) -> Column:
    """struct(score, factors) in hundredths, so the total is exact; divide by 100 for the confidence."""
    return R.score(
        [
            factor("source_backed_company", F.lit(True), 45, "Company name appears in a public source record."),
            factor("project_role", role, 10, "Role is source-derived."),
            factor("website", website, 12, "Website is present in source-backed data."),
            factor("linkedin", linkedin, 8, "Profile URL is present in source-backed data."),
            factor("phone", phone, 15, "Phone is present in source-backed data."),
            factor("contact_page", contact_page, 10, "Contact page is present in source-backed data."),
            factor("staff_directory", staff_directory, 10, "Staff directory is present in source-backed data."),
            factor("person_contact", person, 25, "Person-level contact is source-backed."),
            factor("person_contact_missing", ~person, 0, "No source-backed person-level contact found."),
        ]
    )


# SM-19
def report_horizon(source: ColumnOrName, status: ColumnOrName, signal: ColumnOrName, bid_sources: list[str]) -> Column:
    return case(
        [
            (col(source).isin(bid_sources) | (col(status) == "Permitted") | (col(signal) == "Permit"), "Fast Money"),
            (col(status).isin("Planning", "Approved", "Proposed"), "Pipeline"),
        ],
        "Early Signals",
    )


def report_score(horizon: ColumnOrName, trade: ColumnOrName, has_evidence: Column, reasons: ColumnOrName, has_company: Column, importance: ColumnOrName, status: ColumnOrName,
                 variant: str = "contractor") -> Column:
    tenth = F.floor(F.coalesce(col(importance), F.lit(50)) / 10 + 0.5).cast("int")
    shared = [(col(horizon) == "Fast Money", 25), (col(horizon) == "Pipeline", 15), (has_evidence, 10), (col(trade) != "General", 10), (has_company, 8)]
    if variant == "summary":
        return F.least(F.lit(100), R.points(shared, 40) + tenth)
    return R.clamp(R.points(shared + [(col(reasons) > 0, 12), (col(status) == "Completed", -30)], 35) + tenth)


def report_confidence(has_evidence: Column, importance: ColumnOrName, reasons: ColumnOrName, has_company: Column) -> Column:
    total = R.points([(has_evidence, 0.2), (col(importance) >= 80, 0.15), (col(reasons) > 0, 0.15), (has_company, 0.05)], 0.45)
    return F.least(F.lit(0.95), R.round_half_up(total, 2))


# CL-48
def false_positive_risk(status: ColumnOrName, reasons: ColumnOrName, confidence: ColumnOrName) -> Column:
    return case([(col(status) == "Completed", "High"), ((col(reasons) == 0) | (col(confidence) < 0.65), "Medium")], "Low")


REPORT_REASONS = [
    # Fixed values: (trade, pattern)
    ("Fencing", r"subdivision|production home|master plan"), ("Fencing", r"industrial|warehouse|logistics|outdoor|storage"), ("Fencing", r"demo|demolition"),
    ("Concrete", r"foundation|footing|slab|pool|spa|site"), ("Roofing", r"roof|tpo"), ("Electrical", r"electric|solar|pv|battery|service"),
    ("HVAC", r"hvac|mechanical|heat pump"),
]


def report_reason_count(text: ColumnOrName, trade: ColumnOrName) -> Column:
    total = F.lit(0)
    for t, p in REPORT_REASONS:
        total = total + ((col(trade) == t) & matches(text, p)).cast("int")
    return total


# SM-20
def audit_contact_confidence(name: ColumnOrName, phone: ColumnOrName, email: ColumnOrName, website: ColumnOrName, notes: ColumnOrName) -> Column:
    has = lambda c: F.coalesce(col(c), F.lit("")) != ""
    total = R.points([(has(phone), 0.15), (has(email), 0.15), (has(website), 0.1), (has(name), 0.1), (C.is_placeholder(name, phone, email, website, notes), -0.4)], 0.45)
    return R.clamp(R.round_half_up(total, 2), 0.0, 1.0)


def trust_contact_confidence(name: ColumnOrName, notes: ColumnOrName, has_route: Column, role: ColumnOrName) -> Column:
    has = lambda c: F.coalesce(col(c), F.lit("")) != ""
    total = F.least(F.lit(0.9), R.round_half_up(R.points([(has(notes), 0.1), (has_route, 0.25), (has(role), 0.05)], 0.45), 2))
    return F.when(C.is_source_backed(name), total).otherwise(F.lit(0.0))


# NR-10
def evidence_panel(projects: DataFrame, permits: DataFrame, signals: DataFrame, documents: DataFrame, sources: DataFrame) -> DataFrame:
    """One evidence row per project, permit, signal, document and source record.

    Each input has project_id, id and its own columns; the panel is a union of
    five projections, keyed by project_id.
    """
    row = lambda df, kind, src, url, title, summary, conf: df.select(
        "project_id", F.concat(F.lit(f"ev-{kind}-"), F.col("id").cast("string")).alias("id"), F.lit(kind).alias("record_type"), F.col("id").cast("string").alias("record_id"),
        src.alias("source_name"), url.alias("source_url"), title.alias("title"), summary.alias("summary"), conf.cast("double").alias("confidence"))
    c, lit = F.col, F.lit
    parts = [
        row(projects, "project", c("source_name"), c("source_url"), c("name"), c("description"), lit(0.72)),
        row(permits, "permit", lit("Permit record"), c("source_url"), F.concat_ws(" ", "permit_type", "permit_number"),
            F.concat(c("permit_status"), lit(" permit dated "), c("permit_date"), lit(".")), lit(0.86)),
        row(signals, "signal", c("source"), c("source_url"), c("signal_type"), c("description"), F.greatest(lit(0.35), F.least(lit(0.98), c("importance_score") / 100))),
        row(documents, "document", c("document_type"), c("source_url"), c("title"), F.coalesce("summary", lit("Source document attached to this project.")), lit(0.76)),
        row(sources, "source_record", c("source_name"), c("source_url"), c("title"), c("summary"), lit(0.9)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
