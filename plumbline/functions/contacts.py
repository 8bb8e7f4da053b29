"""Contact-quality predicates and canonical forms (FN-21..23, FL-07..10, FL-18, FL-25)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.rules import ColumnOrName, any_of, case, col, matches

# Patterns that mark a value as a placeholder, and blocked mail hosts.
PLACEHOLDER_PATTERNS = [
    r"example\.(com|gov|org)",
    r"\b555[-\s]?\d{4}\b",
    r"\b(to be determined|tbd|unknown|n/a|none)\b",
    r"select edit below",
    r"enter name",
    r"\b(owner builder|owner-builder)\b",
    r"\b(contact|developer|project manager)\s+\d+\b",
    r"\b\w+\s+(construction|development|builders|contractor|developer)\s+\d+\b",
]
BLOCKED_EMAIL_HOSTS = r"(example\.com|sentry\.|wixpress|cloudflare|schema\.org)"
CONTACT_CONFIDENCE_FLOOR = 0.65


# FN-21
def format_phone(c: ColumnOrName) -> Column:
    digits = F.regexp_replace(col(c), r"\D", "")
    ten = case([((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)), (F.length(digits) == 10, digits)])
    shaped = F.concat(F.lit("("), F.substring(ten, 1, 3), F.lit(") "), F.substring(ten, 4, 3), F.lit("-"), F.substring(ten, 7, 4))
    return F.coalesce(shaped, F.nullif(F.trim(col(c)), F.lit("")))


# FL-07
def is_placeholder(*values: ColumnOrName) -> Column:
    blob = F.lower(F.concat_ws(" ", *[F.nullif(col(v), F.lit("")) for v in values]))
    return blob.rlike("|".join(f"(?:{p})" for p in PLACEHOLDER_PATTERNS))


def is_source_backed(c: ColumnOrName) -> Column:
    """Non-empty and not a placeholder."""
    return (F.coalesce(F.trim(col(c)), F.lit("")) != "") & ~is_placeholder(c)


# FN-22
def safe_phone(c: ColumnOrName) -> Column:
    v = F.trim(col(c))
    return F.when(v.rlike(r"\d{3}[-.\s)]*\d{3}[-.\s]*\d{4}") & ~v.rlike(r"\b555[-\s]?\d{4}\b"), v)


def safe_email(c: ColumnOrName) -> Column:
    v = F.lower(F.trim(col(c)))
    return F.when(v.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$") & ~v.rlike(BLOCKED_EMAIL_HOSTS), v)


def safe_url(c: ColumnOrName) -> Column:
    v = F.trim(col(c))
    return F.when(v.rlike(r"(?i)^https?://") & is_source_backed(v), v)


def safe_text(c: ColumnOrName) -> Column:
    return F.when(is_source_backed(c), F.trim(col(c)))


# FN-23
# Texts that stand for "not known".
UNKNOWN_VALUES = ["", "unknown", "not identified", "not available", "no contact information available", "n/a", "none"]
UNKNOWN_PATTERNS = [r"^unknown\b", r"not (yet )?identified|no (known )?contact|to be determined|\btbd\b"]


def is_known(c: ColumnOrName) -> Column:
    v = F.lower(F.trim(col(c)))
    return F.coalesce(~v.isin(UNKNOWN_VALUES) & ~any_of(v.rlike(p) for p in UNKNOWN_PATTERNS), F.lit(False))


def first_known(*c: ColumnOrName) -> Column:
    return F.coalesce(*[F.when(is_known(x), col(x)) for x in c])


# FL-08
def is_human_name(c: ColumnOrName) -> Column:
    v = F.trim(col(c))
    words = F.filter(F.split(v, r"\s+"), lambda w: w != "")
    shaped = F.forall(words, lambda w: w.rlike(r"^[A-Z][A-Za-z'.-]+$"))
    return F.coalesce(is_source_backed(c) & ~v.rlike(r"(?i)\d|@|https?://") & F.size(words).between(2, 4) & shaped, F.lit(False))


# FL-09
def looks_like_org(c: ColumnOrName) -> Column:
    return matches(c, r"\b(llc|inc|corp|company|homes|developers?|builders?|partners|group|holdings)\b")


# FL-10
def is_actionable_contact(company: ColumnOrName, name: ColumnOrName, phone: ColumnOrName, email: ColumnOrName,
                          website: ColumnOrName, source: ColumnOrName, confidence: ColumnOrName) -> Column:
    present = lambda c: F.coalesce(col(c), F.lit("")) != ""
    return (
        present(company)
        & (F.coalesce(col(confidence), F.lit(0.0)) >= CONTACT_CONFIDENCE_FLOOR)
        & ~is_placeholder(company, name, phone, email, website, source)
        & (present(phone) | present(email) | present(website))
    )


# FL-18
def is_fetchable(c: ColumnOrName) -> Column:
    """Plain http(s) page; map-explorer front ends have no document body."""
    v = F.coalesce(col(c), F.lit(""))
    return matches(v, r"^https?://") & ~matches(v, r"/datasets|maps\.arcgis|arcgis\.com/apps")


# FL-25
# Title patterns and the self-performing trade pattern.
PROJECT_MANAGER_TITLES = r"project manager|\bpm\b|superintendent|construction manager|project executive"
ESTIMATOR_TITLES = r"estimat|purchasing|procurement|bid coordin|subcontract"
SELF_PERFORMING_FENCE = r"gate|fenc|entry control|ornamental|barrier"


def project_manager_like(title: ColumnOrName, name: ColumnOrName, contact_type: ColumnOrName) -> Column:
    return matches(F.concat_ws(" ", col(title), col(name), col(contact_type)), PROJECT_MANAGER_TITLES)


def estimator_like(title: ColumnOrName, name: ColumnOrName) -> Column:
    return matches(F.concat_ws(" ", col(title), col(name)), ESTIMATOR_TITLES)


def self_performing_trade(company: ColumnOrName, general_contractor: ColumnOrName, saturation: ColumnOrName) -> Column:
    """The company is a fence trade itself, or the saturated trade's own contractor."""
    same = _key(company) == _key(general_contractor)
    return F.coalesce((F.coalesce(col(saturation), F.lit(0)) >= 30) & same, F.lit(False)) | matches(company, SELF_PERFORMING_FENCE)


def contact_role_label(title: ColumnOrName, name: ColumnOrName, contact_type: ColumnOrName, path_type: ColumnOrName) -> Column:
    return case(
        [
            (project_manager_like(title, name, contact_type), "Project Manager"),
            (estimator_like(title, name), "Estimator / Purchasing"),
            (F.coalesce(col(title) == "Named site business", F.lit(False)), "Owner / Site Business"),
            (F.coalesce(col(contact_type) == "construction", F.lit(False)), "General Contractor Office"),
            (F.coalesce(col(path_type) == "Developer-driven", F.lit(False)), "Developer Office"),
        ],
        F.coalesce(F.nullif(col(title), F.lit("")), F.lit("Company Office")),
    )


def _key(c: ColumnOrName) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"[^a-z0-9]+", " "))
