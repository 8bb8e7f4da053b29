"""Permit, notice and planning classifiers (CL-01..CL-16, CL-50) and their record rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import rules as R
from plumbline.functions import text as X
from plumbline.functions.rules import ColumnOrName, case, col, contains_any, labels_where, matches
from plumbline.plans import vocab as V


def blob(*cols: ColumnOrName) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.trim(col(c)), F.lit("")) for c in cols]))


# CL-01 / CL-02: every trade whose whole-word rule hits
def permit_trades(text: ColumnOrName, rules: Sequence[tuple[str, str]] = V.PERMIT_A_TRADES) -> Column:
    return R.or_default(R.multi_label(text, rules), "General")


# CL-03 / CL-50: one label, plain substrings
def trade_by_substring(text: ColumnOrName, rules: Sequence[tuple[str, str]] = V.TRADE_SUBSTRINGS_A) -> Column:
    return case([(contains_any(text, terms.split("|")), label) for label, terms in rules], "General")


# CL-04
def permit_status_a(status: ColumnOrName, issued: Column, finaled: Column) -> Column:
    """A final date wins over everything, an issue date over the status text."""
    s = F.lower(F.coalesce(col(status), F.lit("")))
    return case(
        [
            (finaled.isNotNull() | contains_any(s, ["complete", "final"]), "Completed"),
            (issued.isNotNull() | s.contains("issued"), "Permitted"),
            (contains_any(s, ["received", "review", "incomplete"]), "Planning"),
            (s.contains("approved"), "Approved"),
        ],
        "Proposed",
    )


def permit_status_b(status: ColumnOrName) -> Column:
    s = F.lower(F.coalesce(col(status), F.lit("")))
    return case(
        [
            (s.contains("issued"), "Permitted"),
            (s.contains("review"), "Planning"),
            (s.contains("approved"), "Approved"),
            (contains_any(s, ["complete", "final"]), "Completed"),
        ],
        "Proposed",
    )


# CL-05
def project_type_a(text: ColumnOrName) -> Column:
    return case(
        [
            (contains_any(text, ["commercial", "tenant improvement"]), "Commercial"),
            (contains_any(text, ["production home", "single family", "residential", "duplex"]), "Residential"),
            (contains_any(text, ["warehouse", "industrial"]), "Industrial"),
            (contains_any(text, ["utility", "road", "bridge"]), "Infrastructure"),
        ],
        "Residential",
    )


def project_type_b(text: ColumnOrName) -> Column:
    return case(
        [
            (contains_any(text, ["commercial", "wireless"]), "Commercial"),
            (contains_any(text, ["townhome", "residential"]), "Residential"),
            (contains_any(text, ["sewer", "utility"]), "Infrastructure"),
        ],
        "Commercial",
    )


def planning_project_type(text: ColumnOrName) -> Column:
    return R.first_match(text, V.PLANNING_PROJECT_TYPES, "unknown")


def document_project_type(text: ColumnOrName) -> Column:
    return case(
        [
            (contains_any(text, ["residential", "homes", "subdivision"]), "Residential"),
            (contains_any(text, ["drainage", "utilities"]), "Infrastructure"),
        ],
        "Unknown",
    )


# CL-06
def signal_type_a(text: ColumnOrName, status: ColumnOrName) -> Column:
    return case(
        [
            (col(status) == "Permitted", "Permit"),
            (contains_any(text, ["production home", "subdivision", "master plan"]), "Subdivision Filing"),
            (contains_any(text, ["utility", "solar", "pv", "battery"]), "Utility Expansion"),
        ],
        "Planning Application",
    )


def signal_type_b(text: ColumnOrName, status: ColumnOrName) -> Column:
    return case(
        [(col(status) == "Permitted", "Permit"), (contains_any(text, ["sewer", "utility"]), "Utility Expansion")],
        "Planning Application",
    )


# SM-15
def signal_importance_a(signal_type: ColumnOrName, valuation: ColumnOrName, contractor: ColumnOrName) -> Column:
    value = F.coalesce(col(valuation), F.lit(0.0))
    who = F.lower(F.coalesce(F.trim(col(contractor)), F.lit("")))
    base = case([(col(signal_type) == "Permit", 82), (col(signal_type) == "Subdivision Filing", 76)], 65)
    return F.least(
        F.lit(100),
        base + R.points([(value >= 500_000, 10), (value >= 100_000, 5), ((who == "") | who.contains("owner builder"), 6)]),
    )


def signal_importance_b(status: ColumnOrName, apn: ColumnOrName, description: ColumnOrName) -> Column:
    return F.least(
        F.lit(100),
        F.when(col(status) == "Permitted", 80).otherwise(66)
        + R.points([(X.text_or(apn) != "", 5), (F.length(X.text_or(description)) > 80, 4)]),
    )


def _grouped(pattern: str) -> str:
    inner = pattern.removeprefix(r"\b").removesuffix(r"\b")
    return rf"\b(?:{inner})\b"


# CL-07
def planning_stage(text: ColumnOrName, whole_words: bool = False) -> Column:
    """``whole_words=True`` groups the alternatives, so "their" no longer hits ``eir``."""
    table = [(label, _grouped(p) if whole_words else p) for label, p in V.PLANNING_STAGES]
    return R.first_match(F.lower(col(text)), table, "unknown")


def planning_stage_label(stage: ColumnOrName) -> Column:
    return case([(col(stage) == k, v) for k, v in V.PLANNING_STAGE_LABELS.items()], "Planning signal")


# CL-08
def planning_trades(text: ColumnOrName) -> Column:
    named = R.multi_label(text, V.PLANNING_TRADES)
    stack = F.when(matches(text, V.HOUSING_CUE), F.array(*[F.lit(x) for x in V.HOUSING_STACK])).otherwise(F.array().cast("array<string>"))
    return F.array_union(named, stack)


# CL-09
def package_hint(text: ColumnOrName) -> Column:
    small = matches(text, V.PACKAGE_SMALL) & ~matches(text, V.PACKAGE_SMALL_UNLESS)
    return case([(small, "small")] + [(matches(text, p), label) for label, p in V.PACKAGE_HINTS], "unknown")


def is_planning_noise(text: ColumnOrName) -> Column:
    return matches(text, V.PLANNING_NOISE)


# CL-10
def opportunity_horizon(status: ColumnOrName, signal_types: Column) -> Column:
    """struct(horizon, start_months, completion_months, reason) from status and signal set."""
    has = lambda *types: F.coalesce(F.arrays_overlap(signal_types, F.array(*[F.lit(x) for x in types])), F.lit(False))
    st = col(status)

    def row(horizon: str, start: int, end: int | None, reason: Column | str) -> Column:
        return F.struct(
            F.lit(horizon).alias("horizon"),
            F.lit(start).alias("start_months"),
            F.lit(end).cast("int").alias("completion_months"),
            (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"),
        )

    early = "Land, parcel, rezoning, or CEQA evidence indicates upstream activity before bid timing is clear."
    return case(
        [
            ((st == "Permitted") | has("Permit"),
             row("Fast Money", 0, 6, "Permit activity suggests near-term work that may start, finish, and invoice inside six months.")),
            ((st == "Under Construction") | has("Construction Start", "Groundbreaking"),
             row("Fast Money", 0, 6, "Construction activity is active now; only open or late specialty scopes should be pursued.")),
            ((st == "Approved") | has(*V.PIPELINE_SIGNALS),
             row("Pipeline", 6, 18, "Planning or approval evidence indicates a real project, but timing likely requires follow-up.")),
            (has(*V.EARLY_SIGNALS), row("Early Signals", 18, None, early)),
            (st.isin("Approved", "Planning", "Proposed"),
             row("Pipeline", 6, 18, F.concat(st, F.lit(" status implies a medium-term opportunity watch.")))),
        ],
        row("Early Signals", 18, None, "Insufficient near-term evidence; keep only as an early watch item."),
    )


# CL-11
CATEGORY_STACKS = [
    # Fixed values: (project types, trades)
    (["Residential"], ["Fencing", "Concrete", "Landscaping", "Roofing"]),
    (["Commercial", "Mixed Use"], ["HVAC", "Roofing", "Concrete", "Fencing"]),
    (["Industrial", "Infrastructure"], ["Fencing", "Concrete", "Electrical", "Site work"]),
    (["Government"], ["HVAC", "Roofing", "Concrete", "Security fencing"]),
]


def contractor_categories(project_type: ColumnOrName, name: ColumnOrName) -> Column:
    """Trades a project type usually needs, at most five."""
    subdivision = F.lower(F.coalesce(col(name), F.lit(""))).contains("subdivision")
    out = F.array().cast("array<string>")
    for i, (types, trades) in enumerate(CATEGORY_STACKS):
        applies = F.coalesce(col(project_type).isin(types), F.lit(False)) | (subdivision if i == 0 else F.lit(False))
        out = F.array_union(out, F.when(applies, F.array(*[F.lit(x) for x in trades])).otherwise(F.array().cast("array<string>")))
    return F.slice(out, 1, 5)


# CL-12
def normalize_trades(trades: Column) -> Column:
    keep = F.transform(trades, lambda x: F.when(x.isin(V.OPPORTUNITY_TRADES), x).otherwise(F.lit("General")))
    return R.or_default(F.array_distinct(keep), "General")


# CL-13
def project_size(units: ColumnOrName, value: ColumnOrName) -> Column:
    u, v = F.coalesce(col(units), F.lit(0)), F.coalesce(col(value), F.lit(0.0))
    return case(
        [
            ((u >= 500) | (v >= 150_000_000), "Mega Project"),
            ((u >= 100) | (v >= 40_000_000), "Large"),
            ((u >= 25) | (v >= 10_000_000), "Medium"),
        ],
        "Small",
    )


# CL-14: fixed label tables
TIMELINES = {"Planning": "6-18 months", "Proposed": "6-18 months", "Approved": "3-9 months", "Permitted": "0-6 months", "Under Construction": "Active now"}
TIMING_FIT = {
    "Permitted": "Likely 0-6 months", "Approved": "Likely 3-9 months", "Under Construction": "Active, verify open scopes",
    "Planning": "Early, monitor approvals", "Proposed": "Early, monitor approvals",
}


def lookup(c: ColumnOrName, table: dict[str, object], default: object = None) -> Column:
    return case([(col(c) == k, v) for k, v in table.items()], default)


def timeline(status: ColumnOrName) -> Column:
    return lookup(status, TIMELINES, "Completed")


def timing_fit(status: ColumnOrName) -> Column:
    return lookup(status, TIMING_FIT, "Low timing fit")


def fit_label(score: ColumnOrName) -> Column:
    s = col(score)
    return case([(s >= 82, "Strong match"), (s >= 68, "Worth pursuing"), (s >= 52, "Monitor")], "Weak fit")


# CL-15
def company_role(role: ColumnOrName, company_type: ColumnOrName) -> Column:
    text = F.lower(F.concat_ws(" ", col(role), col(company_type)))
    return case([(contains_any(text, terms.split("|")), label) for label, terms in V.ROLE_FROM_TEXT], "General Contractor")


CONTACT_ROLES = {"developer": "Developer", "builder": "Builder", "contractor": "General Contractor", "architect": "Architect", "engineer": "Engineer"}


def contact_role(role: ColumnOrName) -> Column:
    return lookup(role, CONTACT_ROLES, "Applicant")


# CL-16
def stage_from_status(project_status: ColumnOrName, permit_status: ColumnOrName) -> Column:
    text = F.lower(F.concat_ws(" ", col(project_status), col(permit_status)))
    return R.first_match(
        text,
        [
            ("Active", "issued|active|approved"), ("Planning", "application|received|planning|review"),
            ("Early", "agenda|filed|proposed"), ("Internal Only", "final|complete|closed"),
        ],
        "Unknown",
    )


def stage_from_document(source_type: ColumnOrName) -> Column:
    early = ["board_agenda", "meeting_minutes", "environmental_document", "planning_application", "construction_news"]
    return case([(col(source_type).isin(early), "Early"), (col(source_type) == "project_website", "Active")], "Unknown")


# CL-17 / CL-18 / CL-19
def evidence_quality(count: ColumnOrName, source_confidence: ColumnOrName, has_route: Column) -> Column:
    n, conf = col(count), F.coalesce(col(source_confidence), F.lit(0.5))
    return case([((n >= 5) & (conf >= 0.8) & has_route, "High"), ((n >= 3) & (conf >= 0.7), "Medium")], "Low")


def document_evidence_quality(count: ColumnOrName, has_route: Column) -> Column:
    return case([((col(count) >= 6) & has_route, "High"), (col(count) >= 4, "Medium")], "Low")


FAST_TRADES = r"fenc|gate|repair|roofing|site work|earthwork|utilities"
FAST_TEXT = r"repair|gate|fenc|roof|overlay|patio|deck|drainage|site"


def fast_money_potential(text: ColumnOrName, trades: Column, has_access: Column) -> Column:
    fit = F.exists(trades, lambda x: x.rlike(f"(?i){FAST_TRADES}")) | matches(text, FAST_TEXT)
    return case([(has_access & fit, "High"), (fit, "Medium")], "Low")


def opportunity_state(score: ColumnOrName, reachable: Column, stage: ColumnOrName, developer_known: Column, fencing: Column) -> Column:
    s = col(score)
    return case(
        [
            ((s >= 70) & reachable, "Qualified"),
            (s >= 45, "Needs Research"),
            ((col(stage) == "Early") | developer_known | fencing, "Early Signal"),
            (s >= 20, "Low Confidence"),
        ],
        "Internal Only",
    )


# AG-17
def revenue_window(valuation: ColumnOrName, trade: ColumnOrName, shares: dict[str, tuple[float, float]] = V.REVENUE_SHARES) -> Column:
    """struct(low, high) of the trade's share of a valuation; NULLs when there is none."""
    v = col(valuation)
    low = lookup(trade, {k: s[0] for k, s in shares.items()}, shares.get("General", V.OTHER_REVENUE_SHARE)[0])
    high = lookup(trade, {k: s[1] for k, s in shares.items()}, shares.get("General", V.OTHER_REVENUE_SHARE)[1])
    has = F.coalesce(v > 0, F.lit(False))
    return F.struct(
        F.when(has, R.round_half_up(v * low)).alias("low"), F.when(has, R.round_half_up(v * high)).alias("high")
    )


def revenue_windows(valuation: ColumnOrName, trades: Column) -> Column:
    """MAP<trade, struct(low, high)> over a row's trades."""
    return F.map_from_entries(F.transform(trades, lambda t: F.struct(t.alias("key"), revenue_window(valuation, t).alias("value"))))


def project_revenue_window(value: ColumnOrName, trade: ColumnOrName, project_type: ColumnOrName) -> Column:
    heavy = (col(trade) == "Fencing") & col(project_type).isin("Industrial", "Infrastructure", "Government")
    plain = revenue_window(value, trade, V.PROJECT_REVENUE_SHARES)
    v = col(value)
    lo, hi = V.HEAVY_FENCE_SHARE
    return F.when(heavy & (v > 0), F.struct(R.round_half_up(v * lo).alias("low"), R.round_half_up(v * hi).alias("high"))).otherwise(plain)
