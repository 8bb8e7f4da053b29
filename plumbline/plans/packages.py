"""Search-time facets, gates and scores of wide opportunity rows (CL-36..38, CL-46, CL-47, CL-53, FL-11, FL-13..16, FL-21..23, SM-11, SM-12, SR-09)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import contacts as C
from plumbline.functions import rules as R
from plumbline.functions import text as X
from plumbline.functions.rules import ColumnOrName, case, col, contains_any, matches
from plumbline.operators.keyed import collapse_packages
from plumbline.operators.relational import filter_once
from plumbline.operators.search import query_terms, query_trades, with_term_hits
from plumbline.plans import vocab as V
from plumbline.plans.trades import requested_trade


# --- package cues: computed once as boolean columns ------------------------------------------
def with_package_cues(df: DataFrame, text: str, name: str = "project_name", summary: str = "summary", developer: str = "developer") -> DataFrame:
    """Adds housing, tiny, side_scope, non_fence_permit and the size-text cues used below."""
    who = F.concat_ws(" ", F.col(text), F.lower(F.coalesce(F.col(developer), F.lit(""))))
    cue = matches(text, V.SUBDIVISION_CUES)
    named = matches(F.concat_ws(" ", F.col(name), F.col(summary)), V.HOUSING_NAMES)
    out = df.withColumn("_cue", cue).withColumn("_named", named).withColumn("_builder", matches(who, V.PRODUCTION_BUILDERS))
    housing = ~matches(name, V.NOT_HOUSING_NAMES) & ((F.col("_builder") & (F.col("_cue") | F.col("_named"))) | (F.col("_cue") & (F.col("_named") | C.is_known(developer))))
    out = out.withColumn("housing", housing).drop("_cue", "_named", "_builder")
    primary = (matches(text, V.SIDE_SCOPE_PRIMARY) | matches(name, V.SIDE_SCOPE_PRIMARY_NAME)) & ~matches(name, V.SIDE_SCOPE_NAME)
    out = out.withColumn("side_scope", ~primary & matches(text, V.SIDE_SCOPE))
    tiny = ~F.col("housing") & ~matches(text, V.TINY_KEEP) & R.any_of(matches(text, p) for p in V.TINY_RESIDENTIAL)
    out = out.withColumn("tiny", tiny)
    return out.withColumn("non_fence_permit", R.any_of(matches(name, p) for p in V.NON_FENCE_PERMIT))


# FL-15
def positive_evidence(signals: Column) -> Column:
    """Evidence labels that name real fence or gate work; incidental ones are dropped."""
    keep = lambda s: (s.rlike(f"(?i){V.POSITIVE_FENCE_STRONG}") | s.rlike(f"(?i){V.POSITIVE_FENCE}")) & ~s.rlike(f"(?i){V.INCIDENTAL_FENCE}")
    return F.filter(signals, keep)


def direct_pursuit(scope_confidence: ColumnOrName, positives: ColumnOrName) -> Column:
    c = col(scope_confidence)
    return case([(c.isin(V.WEAK_FENCE_SCOPES), False), (c.isin(V.STRONG_FENCE_SCOPES), True)], col(positives) > 0)


# CL-36
def package_scale(text: ColumnOrName, name: ColumnOrName, sizes: ColumnOrName, direct: Column, scope_confidence: ColumnOrName) -> Column:
    """0 noise .. 4 major; needs the cue columns."""
    s = F.lit(1)
    up = lambda acc, cond, level: F.when(cond, F.greatest(acc, F.lit(level))).otherwise(acc)
    s = up(s, F.col("housing"), 4)
    s = up(s, matches(text, V.PACKAGE_CUES), 3)
    s = up(s, matches(text, V.LONG_RUN), 3)
    size_level = case([(matches(sizes, r"\b(major|very high)\b"), 4), (matches(sizes, r"\b(large|high)\b"), 3), (matches(sizes, r"\b(medium)\b"), 2)], 0)
    s = F.greatest(s, size_level)
    strong_gate = direct & col(scope_confidence).isin(V.STRONG_FENCE_SCOPES) & matches(name, "gate|fence|fencing")
    lone_gate = matches(name, r"^\s*(new\s*)?\(?gates?\)?\s*-") & (s < 3) & ~matches(text, r"\bfence|fencing|perimeter|security fence\b")
    s = F.when(lone_gate, F.when(strong_gate, F.greatest(s, F.lit(2))).otherwise(F.least(s, F.lit(1)))).otherwise(s)
    s = F.when(F.col("side_scope") & ~strong_gate, F.least(s, F.lit(1))).otherwise(s)
    s = F.when(direct & matches(text, r"fence|fencing|security fence|chain[-\s]?link") & (s < 2), F.lit(2)).otherwise(s)
    return F.when(F.col("tiny"), F.lit(0)).otherwise(s)


def package_size_facet(sizes: ColumnOrName, scale: ColumnOrName, text: ColumnOrName) -> Column:
    big, large, small = matches(sizes, r"\b(major|very high)\b"), matches(sizes, r"\b(large|high)\b"), matches(sizes, r"\b(tiny|small|low)\b")
    return case(
        [
            (F.col("housing"), "development"), (big, "development"), (large & ~small, "commercial"), (col(scale) >= 3, "development"), (col(scale) >= 2, "commercial"),
            (matches(text, V.COMMERCIAL_TEXT), "commercial"),
        ],
        "small",
    )


def job_type_facet(text: ColumnOrName) -> Column:
    return case([(F.col("side_scope"), "side_scope"), (F.col("housing"), "subdivision"), (matches(text, V.PUBLIC_SITE), "public_site")], "commercial_package")


# FL-23
def has_phone(*phones: ColumnOrName) -> Column:
    return R.any_of(C.is_known(p) for p in phones)


def has_access_path(path_type: ColumnOrName) -> Column:
    return C.is_known(path_type)


# CL-37
def csi_divisions(trade: ColumnOrName) -> Column:
    return case([(col(trade) == t, F.array(*[F.lit(x) for x in d])) for t, d in V.CSI_DIVISIONS.items()], F.array().cast("array<string>"))


def facet_label(value: ColumnOrName) -> Column:
    return case([(col(value) == k, v) for k, v in V.FACET_LABELS.items()])


# FL-16
def facet_params(params: dict[str, str]) -> dict[str, list[str]]:
    """URL parameters to facet lists; unknown values are dropped."""
    out: dict[str, list[str]] = {}
    for name, allowed in V.FACET_VALUES.items():
        values = [v.strip() for v in (params.get(name) or "").split(",") if v.strip()]
        values = ["commercial_package" if v == "commercial_fence_gate" else v for v in values]
        if kept := [v for v in values if v in allowed]:
            out[name] = kept
    for name, sep in (("trade", ","), ("location", "|")):
        if kept := [v.strip() for v in (params.get(name) or "").split(sep) if v.strip()]:
            out[name] = kept
    return out


FACET_COLUMNS = {"size": "package_size", "contact": "contact_status", "type": "job_type", "trade": "facet_trade", "location": "facet_location"}


def facet_filter(df: DataFrame, filters: dict[str, list[str]]) -> DataFrame:
    tests = []
    for name, values in filters.items():
        c = F.col(FACET_COLUMNS[name])
        if name in ("size", "contact", "type"):
            tests.append(c.isin(values))
        elif name == "trade":
            tests.append(F.lower(c).isin([v.lower() for v in values]))
        else:
            tests.append(contains_any(F.lower(c), [v.lower() for v in values]))
    return filter_once(df, reduce(lambda a, b: a & b, tests)) if tests else df


# FL-13
def has_trade_evidence(text: ColumnOrName, tags: ColumnOrName, trade: str) -> Column:
    """A direct trade term outside boilerplate, or the trade as the row's only tag."""
    cleaned = F.regexp_replace(F.lower(col(text)), V.BOILERPLATE, " ")
    parts = F.filter(F.transform(F.split(F.lower(F.coalesce(col(tags), F.lit(""))), "[,/|]+"), lambda x: F.trim(x)), lambda x: x != "")
    only = (F.size(parts) == 1) & F.coalesce(F.get(parts, F.lit(0)).contains(trade.lower()), F.lit(False))
    return contains_any(cleaned, V.TRADE_EVIDENCE_TERMS.get(trade, [trade.lower()])) | only


# FL-14
def suppress_fencing(trades: list[str], bidable: Column, confidence: ColumnOrName, positives: ColumnOrName) -> Column:
    if "Fencing" not in trades:
        return F.lit(False)
    if trades == ["Fencing"]:
        return ~bidable & ~F.col("housing")
    return ~bidable | col(confidence).isin(V.WEAK_FENCE_SCOPES) | (col(positives) == 0)


def scope_matches(trades: list[str], bidable: Column, confidence: ColumnOrName, positives: ColumnOrName, text: ColumnOrName, tags: ColumnOrName, relevance: dict[str, Column],
                  scores: dict[str, Column]) -> Column:
    """Fencing-only searches need a pursuit signal or a housing package; others direct evidence of a requested trade."""
    if not trades:
        return F.lit(True)
    direct = direct_pursuit(confidence, positives)
    if trades == ["Fencing"]:
        return F.when(~bidable & ~F.col("housing"), F.lit(False)).otherwise(direct | F.col("housing"))
    parts = []
    for t in trades:
        if t == "Fencing":
            parts.append(bidable & ~col(confidence).isin(V.WEAK_FENCE_SCOPES) & (col(positives) > 0))
        else:
            parts.append((relevance[t] >= 50) & (scores[t] >= 35) & has_trade_evidence(text, tags, t))
    return R.any_of(parts)


# FL-21
CONTAMINATION = r"\bfenc(?:e|ing)\b|\b(?:new\s+)?gates?\b|fence package|who awards fence|perimeter fencing|security fencing"


def trade_safe(c: ColumnOrName, trade: str) -> Column:
    v = F.nullif(col(c), F.lit(""))
    return v if trade.lower() == "fencing" else F.when(~matches(v, CONTAMINATION), v)


# FL-22
def visible_projects(df: DataFrame, state: str, evidence: str, floor: int = 0) -> DataFrame:
    return df.filter((F.col(state) != "Opportunity") | (F.col(evidence) > floor))


# CL-38
# fixed values: sentences shown for a trade
SCOPE_TEXTS = {
    # Trade -> ordered (label, pattern)
    "Concrete": [("Foundation / stemwall concrete", r"stem\s*wall|foundation|footing"), ("Flatwork", r"flatwork|sidewalk|curb|gutter"), ("Driveway concrete", "driveway"),
                 ("Retaining wall concrete", "retaining"), ("Slab work", "slab")],
    "HVAC": [("HVAC equipment changeout", r"package unit|rtu|heat pump|hvac|split system")],
    "Roofing": [("Roofing work", r"reroof|re-roof|roofing|roof geometry")],
    "Electrical": [("Electrical / solar work", r"solar|pv|panel|electrical")],
}
FENCE_TEXTS = [("Gate installation", r"new\s*\(?gates?|sliding gate|automatic gate|steel gate|security gate|install(?:ation)? of .{0,40}gate"), ("Park fencing", "park"),
               ("School perimeter fencing", "school"), ("Fence installation", "fence|fencing")]
ACTION_FENCE = r"\b(fence|fencing|perimeter|security\s+fence|chain[-\s]?link)\b|\b(new\s*\(?gates?\)?|sliding\s+gate|steel\s+gate|security\s+gate|vehicle\s+gate|pedestrian\s+gate)\b"
ACTION_SCOPES = [
    ("Park fencing", r"\bpark\b"), ("School perimeter fencing", r"\bschool\b"), ("Utility corridor fencing", r"\butility|drainage|trunk|corridor\b"), ("Security fencing", r"\bindustrial|security|warehouse\b"),
    ("Residential perimeter fencing", r"\bsubdivision|village|master plan|lot|unit|homes|residential\b"), ("Gates", r"\b(new\s*\(?gates?\)?|sliding\s+gate|steel\s+gate|security\s+gate)\b"), ("Retaining wall interface", r"\bretaining|wall\b"),
]


def likely_scope(trade: str, text: ColumnOrName, confidence: ColumnOrName, bidable: Column, direct: Column, evidence_scope: ColumnOrName, primary_scope: ColumnOrName) -> Column:
    t = F.lower(col(text))
    if trade == "Fencing":
        return case(
            [
                (F.col("housing") & ~direct, "Likely subdivision / housing-development fence package (contact developer or GC)"),
                (col(confidence).isin("Weak Signal", "Weak Opportunity"), "Insufficient evidence to determine likely fencing scope."),
                (col(confidence).isin("No Meaningful Fence Opportunity", "No Evidence"), "No fencing scope generated."),
                (~bidable, "No bid-able fencing scope generated."),
                (F.coalesce(col(evidence_scope), F.lit("")) != "", col(evidence_scope)),
            ],
            R.first_match(t, FENCE_TEXTS, "Source-backed fencing scope"),
        )
    named = R.first_match(t, SCOPE_TEXTS[trade]) if trade in SCOPE_TEXTS else F.lit(None).cast("string")
    scope = F.when((F.coalesce(col(primary_scope), F.lit("")) != "") & ~matches(primary_scope, "fence|gate"), col(primary_scope))
    return F.coalesce(named, scope, F.lit(f"{trade} work"))


def action_scope(trade: ColumnOrName, text: ColumnOrName) -> Column:
    relevant = (col(trade) == "Fencing") & matches(text, ACTION_FENCE)
    return F.when(relevant, R.first_match(text, ACTION_SCOPES, "Construction fencing")).otherwise(F.concat(col(trade), F.lit(" scope")))


# CL-46: (label, terms, trades it is limited to)
SCOPE_CATEGORY_RULES = [
    ("Foundation", ["foundation", "footing", "stem wall", "stemwall"], []), ("Flatwork", ["flatwork", "sidewalk", "curb", "gutter"], []),
    ("Site Prep", ["site prep", "grading", "earthwork", "excavation", "clearing"], []), ("Driveways", ["driveway"], []),
    ("Utilities", ["utility", "utilities", "sewer", "water main", "storm drain", "drainage"], []), ("Structural Concrete", ["structural concrete", "concrete wall", "tilt-up"], []),
    ("Retaining Walls", ["retaining wall", "retaining walls"], []), ("Gates", ["gate", "gates", "sliding gate", "vehicle gate"], ["Fencing", "Security"]),
    ("Fencing", ["fence", "fencing", "chain link", "perimeter fence"], ["Fencing", "Security"]), ("Roofing", ["roofing", "reroof", "re-roof", "shingle", "tpo", "membrane", "capsheet"], ["Roofing"]),
    ("HVAC", ["hvac", "heat pump", "package unit", "rtu", "split system", "air conditioning"], ["HVAC"]), ("Electrical", ["electrical", "solar", "photovoltaic", "service panel", "panel upgrade"], ["Electrical", "Solar"]),
    ("Plumbing", ["plumbing", "repipe", "backflow", "gas line"], ["Plumbing"]), ("Demolition", ["demolition", "demo "], []), ("Landscaping", ["landscape", "landscaping", "irrigation", "planting"], ["Landscaping"]),
    ("Asphalt", ["asphalt", "paving"], ["Asphalt", "Site work"]), ("Slab", ["slab"], []),
]


def scope_categories(text: ColumnOrName, trade: str, limit: int = 8) -> Column:
    rules = [(label, terms) for label, terms, trades in SCOPE_CATEGORY_RULES if not trades or trade.lower() in [t.lower() for t in trades]]
    return F.slice(R.labels_where([(contains_any(text, terms), label) for label, terms in rules]), 1, limit)


# CL-47
def outreach_timing(stage: ColumnOrName, phone: Column) -> Column:
    live = matches(stage, "permit issued|construction|open|active")
    return case(
        [
            (live & phone, "Call this week"), (live, "Find a phone and call within a few days"), (matches(stage, "planning|entitlement|design"), "Early intro call before bidding starts"),
        ],
        "Confirm a contact before calling",
    )


def bid_status(award: ColumnOrName, likelihood: ColumnOrName) -> Column:
    return case(
        [
            (C.is_known(award), col(award)), (col(likelihood) == "High", "Likely still open to subcontractors"), (col(likelihood) == "Low", "May already be covered"),
        ],
        "Bid window not confirmed",
    )


# CL-53
def readiness_label(confidence: ColumnOrName) -> Column:
    return case([(col(confidence) == "High Confidence", "Ready to call"), (col(confidence) == "Medium Confidence", "Worth pursuing")], "Needs research")


def scope_line(scope: ColumnOrName, categories: Column, trade: str) -> Column:
    safe = trade_safe(scope, trade)
    return case(
        [
            (safe.isNotNull(), X.truncate(safe, 110)), (F.size(categories) > 0, F.concat(F.lit(f"{trade}: "), F.array_join(F.slice(categories, 1, 3), ", "))),
        ],
        f"{trade} work indicated in source records",
    )


def why_contact(first_call: ColumnOrName, person: ColumnOrName, role: ColumnOrName, phone: ColumnOrName, path: ColumnOrName, company: ColumnOrName, developer: ColumnOrName, trade: str) -> Column:
    has = lambda c: F.coalesce(col(c), F.lit("")) != ""
    who = F.concat(col(person), F.when(has(role), F.concat(F.lit(" ("), col(role), F.lit(")"))).otherwise(F.lit("")))
    p = F.lower(F.coalesce(col(path), F.lit("")))
    reach = has(phone) & has(person)
    return case(
        [
            (trade_safe(first_call, trade).isNotNull(), col(first_call)),
            (reach & p.contains("owner"), F.concat(who, F.lit(" is listed as the owner/site contact with a phone on file."))),
            (reach & p.contains("developer"), F.concat(who, F.lit(" is the developer-side contact with a phone on file."))),
            (reach & p.contains("gc"), F.concat(who, F.lit(" is the GC-side contact with a phone on file."))),
            (reach, F.concat(who, F.lit(" has a phone on file for this project."))),
            (has(company), F.concat(col(company), F.lit(" is the company listed on the project record"), F.when(has(path), F.concat(F.lit(" ("), col(path), F.lit(")"))).otherwise(F.lit("")), F.lit("."))),
            (has(developer), F.concat(col(developer), F.lit(" is the developer listed on the project record."))),
        ],
        "No direct contact is confirmed in the source records yet.",
    )


# SM-12
def pursuit_quality(decision_maker: Column, phone: Column, company: Column, path: Column, route: Column, stage: Column, readiness: Column, first_call: Column) -> Column:
    pm = lambda cond, plus, minus: F.when(cond, plus).otherwise(-minus)
    score = F.lit(42) + pm(decision_maker, 18, 10) + pm(phone, 26, 14) + pm(company, 14, 8) + pm(path, 16, 12) + pm(route, 12, 8) + pm(stage, 8, 6) + pm(readiness, 6, 0) + pm(first_call, 4, 0)
    return R.clamp(score)


def pursuit_confidence(score: ColumnOrName, decision_maker: Column, phone: Column, company: Column, path: Column, route: Column) -> Column:
    thin = ~phone & ~decision_maker & ~path & ~route
    return case(
        [
            (~thin & phone & (decision_maker | company) & (path | route), "High Confidence"),
            (~thin & ((phone & company) | (company & path) | (phone & path) | (col(score) >= 60)), "Medium Confidence"),
        ],
        "Research Required",
    )


def contact_quality(phone: Column, email: Column, named: Column, path: Column) -> Column:
    return case([(phone, 100), (email, 70), (named, 40), (path, 25)], 0)


def fence_scope_rank(confidence: ColumnOrName) -> Column:
    return case([(col(confidence) == k, v) for k, v in V.FENCE_SCOPE_RANKS.items()], 0)


# SM-11
def fencing_score(confidence: ColumnOrName, signal: ColumnOrName, positives: ColumnOrName, trade_score: ColumnOrName, subcontractor: ColumnOrName) -> Column:
    hundredths = fence_scope_rank(confidence) * 1400 + col(signal) * 32 + F.least(F.lit(100), col(positives) * 30) * 24 + F.least(col(trade_score), F.lit(100)) * 18 + col(subcontractor) * 12
    return R.clamp(F.floor((hundredths + 50) / 100).cast("int"))


def fencing_relevance(confidence: ColumnOrName, positives: ColumnOrName, relevance: ColumnOrName) -> Column:
    r, n, c = col(relevance), col(positives), col(confidence)
    return case(
        [
            (F.col("housing"), F.greatest(r, F.lit(58))), (n > 0, F.greatest(r, F.least(F.lit(100), F.lit(55) + n * 15))), (c.isin("No Evidence", "No Meaningful Fence Opportunity"), 0),
            (c.isin("Weak Opportunity", "Weak Signal"), F.least(r, F.lit(25))),
        ],
        F.least(r, F.lit(45)),
    )


def search_score(mode: str, actionability: ColumnOrName, trade_score: ColumnOrName, relevance: ColumnOrName, pursuit: ColumnOrName, contact: ColumnOrName, scale: ColumnOrName, rank: ColumnOrName, signal: ColumnOrName,
                 reachable: Column) -> Column:
    """Weighted sum in hundredths, rounded half up; modes are fencing, trade and general."""
    half = lambda e: F.floor((e + 50) / 100).cast("int")
    if mode == "fencing":
        s = half(col(scale) * 1800 + col(rank) * 1000 + col(signal) * 18 + col(trade_score) * 16 + col(pursuit) * 16 + col(contact) * 12 + col(actionability) * 6)
        s = F.when(reachable, s + 6).otherwise(F.greatest(F.lit(26), half(s * 55)))
        return F.when(col(scale) < 2, F.greatest(F.lit(26), F.least(s, F.lit(58)))).otherwise(s)
    if mode == "trade":
        return half(col(relevance) * 28 + col(trade_score) * 24 + col(pursuit) * 36 + col(actionability) * 8 + col(contact) * 4)
    return half(col(actionability) * 35 + col(trade_score) * 25 + col(pursuit) * 40)


def searched_reasons(reasons: ColumnOrName, relevance: ColumnOrName, saturation: ColumnOrName, noise: ColumnOrName) -> Column:
    """Suppression reasons of a row, with those of its own trade replaced by those of the searched one."""
    own = R.labels_where([
        (col(relevance) < 25, "Weak trade relevance"), (col(saturation) >= 40, "Existing GC appears to be the searched trade contractor"), (col(noise) > 0, "Likely noise match")])
    return F.array_union(F.array_remove(col(reasons), "Weak trade relevance"), own)


def contractor_search(df: DataFrame, q: str, text_cols: list[str], id_col: str, filters: dict[str, list[str]] | None = None) -> DataFrame:
    """SR-09: suppress, score the requested trade, gate, facet, sort, collapse packages, limit.

    ``df`` carries the cue columns, the four facet columns and: trade_scores (all models, see ``with_trade_scores``),
    evidence_text and trade, bidable, fence_confidence, positives, fence_signal, pursuit, pursuit_confidence,
    contact_quality, package_scale, actionability, suppress_reasons, subcontractor_score, access_score, package_key.
    The score is that of the best requested trade; a row without direct evidence of a requested trade is no result.
    """
    terms, trades = query_terms(q), query_trades(q)
    fencing = trades == ["Fencing"]
    out = filter_once(df, ~suppress_fencing(trades, F.col("bidable"), "fence_confidence", "positives"))
    out = out.withColumn("_asked", requested_trade(trades))
    asked = F.col("_asked")
    as_fence = asked["model"] == "Fencing"
    own_score, own_relevance = asked["trade_score"], asked["trade_relevance"]
    out = out.withColumns({
        "search_trade": asked["model"],
        "trade_score": own_score,
        "asked_relevance": own_relevance,
        "trade_relevance": F.when(as_fence, fencing_relevance("fence_confidence", "positives", own_relevance)).otherwise(own_relevance),
        "contractor_score": F.when(as_fence, fencing_score("fence_confidence", "fence_signal", "positives", own_score, "subcontractor_score")).otherwise(own_score),
    })
    out = out.withColumn("suppress_reasons", searched_reasons("suppress_reasons", "trade_relevance", asked["saturation_penalty"], asked["noise_penalty"]))
    out = out.withColumn("_rank", fence_scope_rank("fence_confidence"))
    base = search_score("fencing" if fencing else "trade" if trades else "general", "actionability", "trade_score", "asked_relevance", "pursuit", "contact_quality", "package_scale", "_rank", "fence_signal",
                        F.col("contact_status") == "phone")
    out = with_term_hits(out, text_cols, terms)
    in_sacramento = F.lit("sacramento" in terms) & contains_any(F.lower(F.concat_ws(" ", *text_cols)), ["sacramento"])
    adjust = R.points(
        [
            (F.lit(bool(trades)) & (F.col("asked_relevance") < 35), -30), (F.size("suppress_reasons") > 0, F.size("suppress_reasons") * -22), (in_sacramento, 8), (F.col("access_score") >= 70, 5),
            (F.col("pursuit_confidence") == "High Confidence", 10), (F.col("pursuit_confidence") == "Research Required", -18),
        ], 0)
    out = out.withColumn("search_score", R.clamp(base + F.col("_hits") * 3 + adjust)).drop("_hits")

    def of_trade(field: str) -> dict[str, Column]:
        one = lambda t: F.coalesce(F.get(F.filter("trade_scores", lambda m: m["model"] == t), F.lit(0))[field], F.lit(0))
        return {t: one(t) for t in trades}

    keep = (F.col("search_score") >= (25 if fencing else 35)) & (F.size("suppress_reasons") == 0)
    keep = keep & scope_matches(trades, F.col("bidable"), "fence_confidence", "positives", "evidence_text", "trade", of_trade("trade_relevance"), of_trade("trade_score"))
    if not fencing:
        keep = keep & (F.col("pursuit") >= 18)
    out = filter_once(out, keep)
    out = facet_filter(out, filters or {}).drop("_asked")
    order = search_order(fencing, id_col)
    if fencing:
        out = collapse_packages(out, "package_scale", "package_key", id_col, order, 3, always=F.col("housing"))
        return out.orderBy(*order).limit(50).drop("_rank")
    return out.orderBy(*order).limit(30).drop("_rank")


# WN-09
def search_order(fencing: bool, id_col: str) -> list[Column]:
    """Sort keys of the search: eight and the id for a fencing search, seven and the id for others."""
    size_rank = case([(F.col("package_size") == "development", 3), (F.col("package_size") == "commercial", 2)], 1)
    conf_rank = case([(F.col("pursuit_confidence") == "High Confidence", 3), (F.col("pursuit_confidence") == "Medium Confidence", 2)], 1)
    if fencing:
        return [F.desc(size_rank), F.desc((F.col("contact_status") == "phone").cast("int")), F.desc("package_scale"), F.desc("_rank"), F.desc("contact_quality"), F.desc("fence_signal"),
                F.desc("contractor_score"), F.desc("search_score"), F.col(id_col)]
    return [F.desc(conf_rank), F.desc("pursuit"), F.desc("trade_relevance"), F.desc("contractor_score"), F.desc("search_score"), F.desc("actionability"), F.desc("contact_quality"), F.col(id_col)]
