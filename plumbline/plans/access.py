"""Access paths, contacts and call plans (CL-20/21/34/35/42/45, SM-08/09/13/14, WN-04..06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import contacts as C
from plumbline.functions import rules as R
from plumbline.functions import text as X
from plumbline.functions.rules import ColumnOrName, case, col, matches
from plumbline.operators.keyed import best_per_key, first_per_key
from plumbline.plans import vocab as V

# Access-path patterns.
PUBLIC_ROUTE = r"bid_portal|public_procurement|plan_room|public works|municip|school district|city of|county of"
PUBLIC_TEXT = r"school|park|trail|public works|city |county |district"
OWNER_TEXT = r"childcare|child care|daycare|church|clinic|owner|tenant"
DEVELOPER_ROUTE = r"trade_partner|vendor_registration|subcontractor_registration|developer"
MUNICIPAL_TEXT = r"school|park|public|municip|city of|county of"
LATE_STAGE = r"finaled|completed|closed|certificate of occupancy"
ISSUED_STAGE = r"issued|permitted|under construction|active construction"
PLAN_STAGE = r"plan check|review|submitted|planning"
EARLY_STAGE = r"early|preconstruction|pre-bid|bidding|rfp|rfq"
WORK_TEXT = r"tenant improvement|ti\b|remodel|repair|gate|fence"


def known(c: ColumnOrName) -> Column:
    """Value unless empty or the word Unknown."""
    return F.nullif(F.nullif(col(c), F.lit("Unknown")), F.lit(""))


def is_set(c: ColumnOrName) -> Column:
    return known(c).isNotNull()


# CL-34
def access_path_type(gc: ColumnOrName, developer: ColumnOrName, entry: ColumnOrName, route: ColumnOrName, text: ColumnOrName, site_business: Column) -> Column:
    has_gc, has_dev = is_set(gc), is_set(developer)
    er = F.concat_ws(" ", col(entry), col(route))
    return case(
        [
            (matches(F.concat_ws(" ", er, col(text)), PUBLIC_ROUTE) & matches(text, PUBLIC_TEXT), "Municipality-driven"),
            (site_business & ~has_gc & ~has_dev, "Owner-driven"),
            (site_business & matches(text, OWNER_TEXT) & ~has_dev, "Owner-driven"),
            (has_dev & matches(er, DEVELOPER_ROUTE), "Developer-driven"),
            (has_dev & ~has_gc, "Developer-driven"),
            (has_gc, "GC-driven"),
            (has_dev, "Developer-driven"),
            (matches(text, MUNICIPAL_TEXT), "Municipality-driven"),
            (site_business, "Owner-driven"),
        ],
        "Unknown",
    )


# CL-35
def procurement_stage(stage: ColumnOrName, status: ColumnOrName, text: ColumnOrName) -> Column:
    s = F.lower(F.coalesce(col(stage), F.lit("")))
    blob = F.concat_ws(" ", s, F.lower(F.coalesce(col(status), F.lit(""))), col(text))
    return case(
        [
            (matches(blob, LATE_STAGE), "Awarded / late"),
            (matches(blob, ISSUED_STAGE), "Permit issued / construction"),
            (matches(blob, PLAN_STAGE), "Plan check / design"),
            (matches(blob, EARLY_STAGE), "Pre-bid / early"),
            (matches(text, WORK_TEXT) & matches(F.concat_ws(" ", s, col(text)), "issued|permit"), "Permit issued / construction"),
            (s == "open", "Open / active"),
            (s != "", F.concat(F.upper(F.substring(F.trim(s), 1, 1)), F.substr(F.trim(s), F.lit(2)))),
        ],
        "Unknown",
    )


# SM-14
def award_probability(path_type: ColumnOrName, stage: ColumnOrName, saturation: ColumnOrName, text: ColumnOrName) -> Column:
    """struct(score, factors): each applying signal is a factor row with its reason."""
    p = col(path_type)
    f = R.factor
    return R.score(
        [
            f("base", F.lit(True), 45),
            f("owner", p == "Owner-driven", -15, "Owner/site business appears to control the work directly."),
            f("gc", p == "GC-driven", 10, "Named GC typically awards trade packages."),
            f("developer", p == "Developer-driven", 5, "Developer-driven path; fence package may go through GC or trade partner network."),
            f("public", p == "Municipality-driven", 8, "Public procurement often still open until bid award."),
            f("issued", matches(stage, "permit issued|construction"), 20, "Permit/construction stage increases chance fence subs are already selected."),
            f("early", matches(stage, "pre-bid|early|plan check|design"), -15, "Earlier stage means award is less likely complete."),
            f("late", matches(stage, "awarded|late"), 30, "Late/awarded stage strongly suggests packages may already be placed."),
            f("saturated", F.coalesce(col(saturation), F.lit(0)) >= 30, 25, "Listed contractor already appears to be the fencing/gate trade."),
            f("tbd", matches(text, "to be determined|tbd|select edit below"), -10, "Contractor still TBD on permit."),
            f("explicit", matches(text, r"new \(gates\)|new fence|raise fence|pool safety fencing|chain[-\s]?link"), 5, "Explicit fence/gate install language present."),
        ]
    )


def award_label(score: ColumnOrName) -> Column:
    s = col(score)
    return case([(s >= 75, "High"), (s >= 50, "Medium"), (s >= 25, "Low")], "Very Low")


def call_readiness(phone: ColumnOrName, email: ColumnOrName, name: ColumnOrName, second_phone: ColumnOrName, path_type: ColumnOrName, label: ColumnOrName) -> Column:
    present = lambda c: F.coalesce(col(c), F.lit("")) != ""
    return R.clamp(R.points(
        [
            (present(phone), 40), (present(email), 15), (present(name), 10), (present(second_phone), 10), (col(path_type) != "Unknown", 10),
            (col(label).isin("Low", "Very Low"), 10), (col(label) == "High", -5),
        ], 0))


# WN-04: three rank tables
def contact_rank(variant: str, name: ColumnOrName = "name", phone: ColumnOrName = "phone", email: ColumnOrName = "email", company: ColumnOrName = "company",
                 contact_type: ColumnOrName = "contact_type", title: ColumnOrName = "title", source: ColumnOrName = "source") -> Column:
    has = lambda c: F.coalesce(col(c), F.lit("")) != ""
    n, p, e, k = has(name), has(phone), has(email), has(company)
    kind = lambda v: F.coalesce(col(contact_type) == v, F.lit(False))
    if variant == "human":
        return case(
            [
                (n & p, 100), (n & e, 95), (p & kind("construction"), 85), (p & kind("sales"), 75), (p & kind("regional"), 70), (p & kind("corporate"), 65), (p, 60),
                (e, 55), (kind("trade_partner"), 40), (kind("vendor"), 35), (k, 30),
            ], 25)
    if variant == "action":
        return case([(n & p, 100), (n & e, 92), (p, 82), (e, 74), (k, 50), (C.is_known(source), 45)], 0)
    if variant == "access":
        base = case([(n & p, 100), (n & e, 90), (p, 80), (e, 70), (k, 30)], 0)
        return base + R.points(
            [(C.project_manager_like(title, name, contact_type), 25), (C.estimator_like(title, name), 18), (kind("construction"), 8), (kind("direct"), 12)])
    raise ValueError(f"unknown variant {variant}")


def rank_contacts(contacts: DataFrame, key: str, variant: str, seq: str, dedupe: list[str] = ("company", "name", "phone", "email")) -> DataFrame:
    """Best contact per key after ordered dedupe on the chosen columns."""
    k = X.normalize_key(F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in dedupe]))
    once = first_per_key(contacts.withColumn("_k", k), [key, "_k"], [seq]).drop("_k")
    return best_per_key(once.withColumn("rank", contact_rank(variant)), [key], [F.desc("rank"), F.desc("confidence"), seq])


# WN-05
def primary_contact(companies: DataFrame, key: str, role: str, seq: str) -> DataFrame:
    order = case([(F.col(role) == "developer", 0), (F.col(role) == "builder", 1), (F.col(role) == "contractor", 2)], 3)
    return best_per_key(companies, [key], [order, seq])


# WN-06
def decision_makers(contacts: DataFrame, opps: DataFrame, key: str, seq: str) -> DataFrame:
    """Selection cascade as one priority column, then the best row per key.

    ``opps`` carries path_type, developer and general_contractor per key.
    """
    c = contacts.join(opps.select(key, "path_type", "developer", "general_contractor"), key)
    reach = (F.coalesce(F.col("phone"), F.lit("")) != "") | (F.coalesce(F.col("email"), F.lit("")) != "")
    same = lambda who: F.coalesce(X.normalize_key("company") == X.normalize_key(who), F.lit(False))
    gc_path = (F.col("path_type") == "GC-driven") | is_set("general_contractor")
    priority = case(
        [
            (C.project_manager_like("title", "name", "contact_type") & reach, 0),
            (C.estimator_like("title", "name") & reach, 1),
            ((F.col("path_type") == "Developer-driven") & same("developer") & reach, 2),
            (gc_path & same("general_contractor") & reach, 3),
            (gc_path & (F.coalesce(F.col("phone"), F.lit("")) != ""), 4),
        ], 5)
    role = case(
        [
            (F.col("priority") == 0, "Project Manager"), (F.col("priority") == 1, "Estimator / Purchasing"), (F.col("priority") == 2, "Developer Procurement"),
            (F.col("priority").isin(3, 4), F.when(C.self_performing_trade("company", "general_contractor", F.lit(0)), F.lit("Gate / Fence Contractor (self-perform risk)")).otherwise(F.lit("General Contractor Office"))),
        ],
        C.contact_role_label("title", "name", "contact_type", "path_type"))
    ranked = c.withColumn("priority", priority).withColumn("rank", contact_rank("access"))
    best = best_per_key(ranked, [key], ["priority", F.desc("rank"), F.desc("confidence"), seq])
    return best.withColumn("decision_role", role)


def all_decisions(contacts: DataFrame, opps: DataFrame, key: str, seq: str, sites: DataFrame | None = None) -> DataFrame:
    """One decision per opportunity, with or without a contact.

    ``opps`` carries path_type, developer, general_contractor and source_url per key, ``sites`` (key, business_name,
    business_phone, site_order) the businesses named on the site.  An owner-driven opportunity goes to its first site
    business unless a project manager or estimator can be reached; without any contact the site business, the general
    contractor or the developer is named (confidence 0.7 or 0.35 with or without a phone of the site business, else 0.2).
    """
    chosen = decision_makers(contacts, opps, key, seq).select(key, seq, "priority", F.col("company").alias("_company"), F.col("name").alias("_name"), F.col("phone").alias("_phone"), F.col("email").alias("_email"),
                                                               F.col("confidence").alias("_confidence"), F.col("source").alias("_source"), F.col("decision_role").alias("_role"))
    out = opps.select(key, "path_type", "developer", "general_contractor", "source_url").join(chosen, key, "left")
    if sites is None:
        out = out.withColumns({"business_name": F.lit(None).cast("string"), "business_phone": F.lit(None).cast("string")})
    else:
        out = out.join(first_per_key(sites, [key], ["site_order", "business_name"]).select(key, "business_name", "business_phone"), key, "left")
    site = F.col("business_name").isNotNull() & (F.col("priority").isNull() | ((F.col("path_type") == "Owner-driven") & (F.col("priority") > 1)))
    person = ~site & F.col("priority").isNotNull()
    gc, developer = is_set("general_contractor"), is_set("developer")
    named = case([(gc, F.col("general_contractor")), (developer, F.col("developer"))])
    pick = lambda at_site, contact, none: F.when(site, at_site).when(person, contact).otherwise(none)
    nothing = F.lit(None).cast("string")
    company = pick(F.col("business_name"), F.col("_company"), named)
    display = pick(F.col("business_name"), F.coalesce(F.nullif("_name", F.lit("")), "_company"), F.coalesce(named, F.lit("Unknown decision maker")))
    role = pick(F.lit("Owner / Site Business"), F.col("_role"), F.when(gc, F.lit("General Contractor (no phone yet)")).otherwise(F.lit("Unknown")))
    return out.select(
        key, F.when(person, F.col(seq)).alias(seq), display.alias("display_name"), role.alias("role"), company.alias("company"), pick(F.col("business_phone"), F.col("_phone"), nothing).alias("phone"),
        pick(nothing, F.col("_email"), nothing).alias("email"), pick(F.col("source_url"), F.col("_source"), F.col("source_url")).alias("source"),
        pick(F.when(F.col("business_phone").isNotNull(), 0.7).otherwise(0.35), F.col("_confidence"), F.lit(0.2)).alias("confidence"))


def second_contacts(contacts: DataFrame, chosen: DataFrame, key: str, seq: str) -> DataFrame:
    """Best remaining contact: not the chosen person or desk."""
    d = chosen.select(key, F.col("company").alias("_dc"), F.col("phone").alias("_dp"), F.col("name").alias("_dn"))
    c = contacts.join(d, key)
    blank = lambda x: F.coalesce(F.col(x), F.lit("")) == ""
    same_company = X.normalize_key("company") == X.normalize_key("_dc")
    same_phone = ~blank("phone") & (F.col("phone") == F.col("_dp"))
    same_name = ~blank("name") & ~blank("_dn") & (X.normalize_key("name") == X.normalize_key("_dn"))
    left = c.filter(~F.coalesce(same_company & (same_phone | same_name | (blank("name") & blank("_dn"))), F.lit(False)))
    pm = F.when(C.project_manager_like("title", "name", "contact_type"), 0).otherwise(1)
    ranked = left.withColumn("rank", contact_rank("access"))
    return best_per_key(ranked, [key], [pm, F.desc("rank"), F.desc("confidence"), seq]).drop("_dc", "_dp", "_dn")


# SM-09
def access_score(paths: ColumnOrName, has_routes: Column, available: Column, dossier_phone: Column, dossier_path: Column) -> Column:
    """paths: array of path types of the row's companies."""
    has = lambda *types: F.coalesce(F.arrays_overlap(col(paths), F.array(*[F.lit(t) for t in types])), F.lit(False))
    return F.least(F.lit(100), R.points(
        [
            (has(*V.REGISTRATION_PATHS), 28), (has("trade_partner"), 28), (has(*V.BID_PATHS), 28), (has("general_contact"), 14),
            (has_routes, 18), (available, 12), (dossier_phone, 10), (dossier_path, 10),
        ], 0))


# CL-20
def access_state(score: ColumnOrName, has_route: Column, available: Column) -> Column:
    return case([((col(score) >= 70) & has_route, "Actionable Opportunity"), ((col(score) >= 30) | available, "Research Required")], "Opportunity")


def project_access_state(has_contact: Column, score: ColumnOrName) -> Column:
    return case([(has_contact | (col(score) >= 70), "Actionable Opportunity"), (col(score) >= 35, "Research Required")], "Opportunity")


# CL-21
def entry_method(best_type: ColumnOrName, company_type: ColumnOrName, has_page: Column) -> Column:
    b, k = col(best_type), col(company_type)
    t = lambda *v: F.coalesce(b.isin(*v), F.lit(False))
    return case(
        [
            (t("trade_partner"), "Trade Partner Registration"), (t(*V.REGISTRATION_PATHS), "Vendor Registration"), (t(*V.BID_PATHS), "Bid Portal"),
            (t("estimating_contact"), "Estimating Department"), (t("general_contact") | has_page, "General Contact Route"),
            (k == "Developer", "Developer Procurement Research"), (k == "General Contractor", "Subcontractor Intake Research"),
        ],
        "Unknown",
    )


def approval_required(best_type: ColumnOrName, company_type: ColumnOrName) -> Column:
    """Tri-state text: true, Often or false."""
    b = col(best_type)
    gated = col(company_type).isin("Developer", "General Contractor") & b.isin("trade_partner", *V.REGISTRATION_PATHS)
    return case([(F.coalesce(gated, F.lit(False)), "true"), (F.coalesce(b.isin("public_procurement", "bid_portal"), F.lit(False)), "Often")], "false")


def typical_opportunity(company_type: ColumnOrName) -> Column:
    return case([(col(company_type) == k, v) for k, v in V.TYPICAL_OPPORTUNITY.items()], "Unknown")


def access_confidence(profile_confidence: ColumnOrName, valued: Column, has_routes: Column, dedicated: Column) -> Column:
    total = F.coalesce(col(profile_confidence), F.lit(0.35)) + R.points([(valued, 0.2), (has_routes, 0.15), (dedicated, 0.2)], 0.0)
    return F.least(F.lit(1.0), R.round_half_up(total, 2))


def fence_probability(signal: Column, name: ColumnOrName, trade: ColumnOrName) -> Column:
    named = matches(name, r"\b(fence|fencing|new\s*\(?gates?|sliding gate|automatic gate|steel gate|security gate)\b")
    other = matches(F.concat_ws(" ", col(trade), col(name)), "electrical|solar|hvac|roof|landscape lighting")
    return F.when(~signal, 8).otherwise(R.clamp(F.lit(40) + F.when(named, 30).otherwise(0) - F.when(other, 25).otherwise(0)))


# CL-42
def contact_coverage(has_contact: Column, name: ColumnOrName, phone: ColumnOrName, email: ColumnOrName, company: ColumnOrName, backup: ColumnOrName) -> Column:
    has = lambda c: F.coalesce(col(c), F.lit("")) != ""
    route = F.when(is_set(backup), F.lit("Access Route Only")).otherwise(F.lit("Unknown"))
    return case(
        [
            (~has_contact, route), (has(name) & (has(phone) | has(email)), "Known Human Contact"), (has(phone) | has(email), "Company Office Contact"),
            (has(company), "Named Company Lead"),
        ],
        route,
    )


def office_title(company_type: ColumnOrName) -> Column:
    return case([(col(company_type) == "General Contractor", "Construction Office"), (col(company_type) == "Developer", "Regional Office")], "Corporate Office")


def office_contact_type(company_type: ColumnOrName) -> Column:
    return case([(col(company_type) == "General Contractor", "construction"), (col(company_type) == "Developer", "regional")], "corporate")


# SM-08
def dossier_actionability(path_value: ColumnOrName, reachable: Column, quality: ColumnOrName, relation_points: ColumnOrName, state: ColumnOrName, fencing: Column, fast: ColumnOrName) -> Column:
    return F.least(F.lit(100), R.points(
        [
            (F.coalesce(col(path_value).isin("High", "Medium"), F.lit(False)), 24), (reachable, 22), (col(quality) == "High", 16), (col(quality) == "Medium", 10),
            (col(relation_points) > 0, F.least(F.lit(14), col(relation_points))), (col(state) == "Qualified", 12), (fencing, 8), (col(fast) == "High", 12), (col(fast) == "Medium", 6),
        ], 0))


# CL-45
def recommended_action(phone: ColumnOrName, name: ColumnOrName, company: ColumnOrName, developer: ColumnOrName, gc: ColumnOrName, path_type: ColumnOrName, relations: Column, has_contact: Column) -> Column:
    has = lambda c: F.coalesce(col(c), F.lit("")) != ""
    p = col(path_type)
    t = lambda *v: F.coalesce(p.isin(*v), F.lit(False))
    person = has(phone) & has(name)
    gc_known = F.coalesce(col(gc), F.lit("")) != "Unknown"
    dev_known = F.coalesce(col(developer), F.lit("")) != "Unknown"
    return case(
        [
            (person & F.coalesce(col(company) == col(developer), F.lit(False)), "Call Developer"),
            (person & gc_known, "Research General Contractor"),
            (t("vendor_registration"), "Register Vendor"), (t("trade_partner"), "Register Trade Partner"), (t(*V.BID_PATHS), "Monitor Bid Portal"),
            (gc_known & ~has(phone), "Research General Contractor"),
            (dev_known & p.isNull() & ~has(phone), "Research Developer"),
            (relations & p.isNull() & ~has(phone), "Wait For Additional Evidence"),
            (p.isNotNull() | has_contact, "Research General Contractor"),
        ],
        "Not Actionable",
    )


def first_call(target: ColumnOrName, phone: ColumnOrName, email: ColumnOrName, project: ColumnOrName, self_perform: Column, award: ColumnOrName, path_type: ColumnOrName) -> Column:
    has = lambda c: F.coalesce(col(c), F.lit("")) != ""
    who = F.coalesce(F.nullif(col(target), F.lit("")), F.lit("the project decision maker"))
    at = F.when(has(phone), F.concat(F.lit(" at "), col(phone))).otherwise(F.lit(""))
    name = X.collapse_ws(F.coalesce(col(project), F.lit("")))
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return case(
        [
            (~has(phone) & ~has(email), say("Research a direct phone for ", who, " before calling about ", name, ".")),
            (self_perform, say("Call ", who, at, " only to confirm self-perform vs overflow subcontract need on ", name, "; this may already be their package.")),
            (col(award) == "High", say("Call ", who, at, " tomorrow morning and ask whether the fence/gate package on ", name, " is still open or already awarded.")),
            (col(path_type) == "Owner-driven", say("Call ", who, at, " tomorrow morning and ask who is handling the fence/gate work for ", name, " and whether they want a fencing bid.")),
        ],
        say("Call ", who, at, " tomorrow morning and ask for estimating/purchasing regarding the fence/gate package on ", name, "."),
    )


def who_controls(path_type: ColumnOrName, developer: ColumnOrName, gc: ColumnOrName, site_business: ColumnOrName) -> Column:
    p = col(path_type)
    return case(
        [
            (p == "Owner-driven", F.coalesce(known(site_business), F.lit("Site owner / named business"))),
            (p == "Developer-driven", F.coalesce(known(developer), F.lit("Developer procurement"))),
            (p == "Municipality-driven", "Public agency / procurement officer"),
            (p == "GC-driven", F.coalesce(known(gc), F.lit("General contractor"))),
        ],
        "Unknown",
    )


# SM-13
def action_path_type(route: ColumnOrName, company: ColumnOrName, gc: ColumnOrName, developer: ColumnOrName) -> Column:
    r = F.coalesce(known(route), F.lit("Unknown"))
    same = lambda who: F.coalesce((F.coalesce(col(company), F.lit("")) != "") & (X.normalize_key(company) == X.normalize_key(who)), F.lit(False))
    return case(
        [
            (same(gc), "Direct GC"), (same(developer), "Developer"), (matches(r, "bid_portal|bid portal"), "Bid portal"), (matches(r, "public|procurement"), "Public works"),
            (matches(r, "plan.?room"), "Plan room"), (matches(r, "trade_partner|trade partner|subcontractor"), "Subcontractor network"), (r != "Unknown", "Developer"),
        ],
        "Unknown",
    )


def actionability(developer: ColumnOrName, gc: ColumnOrName, architect: ColumnOrName, has_contact: Column, phone: ColumnOrName, email: ColumnOrName, path: ColumnOrName,
                  route: ColumnOrName, source: ColumnOrName, readiness: ColumnOrName | None = None) -> Column:
    has = lambda c: F.coalesce(col(c), F.lit("")) != ""
    score = R.points(
        [
            (is_set(developer), 14), (is_set(gc), 16), (is_set(architect), 6), (has_contact, 18), (has(phone), 22), (has(email), 14),
            (col(path).isin("Bid portal", "Public works", "Plan room", "Municipality-driven"), 16), (col(path) != "Unknown", 10), (is_set(route), 8), (is_set(source), 8),
        ], 0)
    if readiness is not None:
        blended = F.least(F.lit(100), F.floor((score * 7 + col(readiness) * 3) / 10 + 0.5).cast("int"))
        score = F.when(F.coalesce(col(readiness), F.lit(0)) > 0, F.greatest(score, blended)).otherwise(score)
    return F.least(F.lit(100), score)


def missing_intelligence(developer: ColumnOrName, gc: ColumnOrName, has_contact: Column, phone: ColumnOrName, path: ColumnOrName) -> Column:
    return R.labels_where(
        [
            (~is_set(developer), "developer"), (~is_set(gc), "general contractor"), (~has_contact, "human contact"),
            (F.coalesce(col(phone), F.lit("")) == "", "phone"), (col(path) == "Unknown", "access path"),
        ])


# SM-06
def qualification_score(contact: Column, path: Column, developer: Column, gc: Column, relations: Column, fencing: Column, stage: ColumnOrName, quality: ColumnOrName, fast: ColumnOrName) -> Column:
    return F.least(F.lit(100), R.points(
        [
            (contact, 18), (path, 18), (developer, 12), (gc, 12), (relations, 10), (fencing, 14), (col(stage).isin("Active", "Planning"), 8), (col(stage) == "Early", 4),
            (col(quality) == "High", 8), (col(quality) == "Medium", 5), (col(fast) == "High", 10), (col(fast) == "Medium", 5),
        ], 0))
