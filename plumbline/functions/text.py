"""Scalar text functions (FN-*): pure Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.rules import ColumnOrName, case, col, matches

# Stop words and suffix patterns the results depend on.
SEARCH_STOP_WORDS = [
    "the", "and", "for", "with", "from", "that", "this", "into", "jobs", "job",
    "in", "of", "to", "a", "an", "or", "on", "at",
]
SUFFIXES_V1 = r"\b(llc|inc|corp|corporation|company|co|limited|the)\b"
SUFFIXES_V2 = r"\b(llc|inc|corp|corporation|incorporated|company|co|limited|the)\b"
SUFFIXES_V3 = (
    r"\b(the|llc|l\.l\.c\.|inc|inc\.|corporation|corp|corp\.|company|co|co\.|"
    r"limited|ltd|lp|partners|development|developers)\b"
)
SUFFIXES_V4 = r"\b(inc|incorporated|llc|corp|corporation|co|company|ltd|the)\b"
PROJECT_KEY_NOISE = r"\b(area|r\d{2}|solar|digital|submittal|paper|review|lot|unit|phase)\b"


# FN-01
def text_or(c: ColumnOrName, default: str | Column = "") -> Column:
    value = F.nullif(F.trim(col(c)), F.lit(""))
    return F.coalesce(value, default if isinstance(default, Column) else F.lit(default))


# FN-02
def parse_money(c: ColumnOrName) -> Column:
    return F.nullif(F.trim(F.regexp_replace(col(c), r"[$,]", "")), F.lit("")).try_cast("double")


# FN-03
def millis_to_date(c: ColumnOrName) -> Column:
    ms = col(c).cast("bigint")
    return F.when(ms != 0, F.to_date(F.timestamp_millis(ms)))


# FN-04
def months_ago(as_of: ColumnOrName, months: int) -> Column:
    return F.date_format(F.add_months(col(as_of).cast("date"), -months), "yyyy-MM-dd")


def days_ago(as_of: ColumnOrName, days: int) -> Column:
    return F.date_format(F.date_sub(col(as_of).cast("date"), days), "MM/dd/yyyy")


def _squash(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[^a-z0-9]+", " "))


# FN-05
def normalize_name_v1(c: ColumnOrName) -> Column:
    return _squash(F.regexp_replace(F.lower(col(c)), SUFFIXES_V1, ""))


# FN-06
def normalize_name_v2(c: ColumnOrName, aliases: Sequence[tuple[str, str]] = ()) -> Column:
    """Suffix-stripped key; an alias whose needle is contained replaces the key."""
    base = _squash(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), SUFFIXES_V2, ""))
    return case([(base.contains(needle), target) for needle, target in aliases], base) if aliases else base


# FN-07
def normalize_entity_name(c: ColumnOrName) -> Column:
    return _squash(F.regexp_replace(F.lower(col(c)), SUFFIXES_V3, ""))


# FN-08
def normalize_license_name(c: ColumnOrName) -> Column:
    spaced = F.regexp_replace(F.regexp_replace(F.lower(col(c)), "&", " and "), r"[^a-z0-9\s]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, SUFFIXES_V4, " "), r"\s+", " "))


# FN-09
def normalize_key(c: ColumnOrName) -> Column:
    return _squash(F.lower(F.coalesce(col(c), F.lit(""))))


# FN-10
def slug(c: ColumnOrName, max_len: int | None = None) -> Column:
    out = F.btrim(F.regexp_replace(F.lower(col(c)), r"[^a-z0-9]+", "-"), F.lit("-"))
    return F.substring(out, 1, max_len) if max_len else out


def stable_id(*parts: ColumnOrName) -> Column:
    joined = F.concat_ws("-", *[F.nullif(col(p).cast("string"), F.lit("")) for p in parts])
    return F.substring(F.regexp_replace(normalize_name_v1(joined), r"\s+", "-"), 1, 180)


# FN-11
def project_key(*candidates: ColumnOrName) -> Column:
    first = F.coalesce(*[F.nullif(col(c), F.lit("")) for c in candidates], F.lit(""))
    return _squash(F.regexp_replace(F.lower(first), PROJECT_KEY_NOISE, " "))


# FN-12
# Community cue and the lot-level tags that are dropped from a key.
COMMUNITY_CUE = r"\b(villages?|the\s+lakes)\s+at\s+([a-z0-9' ]+?)(\s*-?\s*unit\b|\s+lot\b|\s*$)"
LOT_TAGS = [
    r"\blot\s+\d+[a-z]?\b",
    r"\belevation\s+[a-z0-9-]+\b",
    r"\bplan\s+\d+[a-z]?\b",
    r"\bunit\s*\d+\b",
    r"\b\d{3,5}\b",
]


def package_key(project_name: ColumnOrName, developer: ColumnOrName, city: ColumnOrName,
                overrides: Sequence[tuple[str, str, str]] = ()) -> Column:
    """Key of a housing package: community + developer + city.

    ``overrides`` are (name regex, developer regex, key) rows that come first.
    The terminator is an explicit group, so no lookahead is needed.
    """
    name = F.lower(F.coalesce(col(project_name), F.lit("")))
    dev = F.coalesce(col(developer), F.lit(""))
    community = F.regexp_extract(name, COMMUNITY_CUE, 2)
    prefix = F.when(F.regexp_extract(name, COMMUNITY_CUE, 1).startswith("village"), F.lit("villages at ")).otherwise(F.lit("the lakes at "))
    stripped = reduce(lambda acc, p: F.regexp_replace(acc, p, " "), LOT_TAGS, name)
    label = F.when(community != "", F.concat(prefix, community)).otherwise(F.substring(collapse_ws(stripped), 1, 60))
    key = normalize_key(F.concat_ws(" ", label, dev, F.coalesce(col(city), F.lit(""))))
    special = [(matches(project_name, n) & matches(developer, d), normalize_key(F.lit(k))) for n, d, k in overrides]
    return case(special, key) if special else key


# FN-13
def normalize_project_id(c: ColumnOrName, prefixes: Sequence[str] = ("sac", "placer", "sam")) -> Column:
    return F.lower(F.regexp_replace(F.lower(col(c)), rf"^({'|'.join(prefixes)})-", ""))


# FN-14
def raise_word_starts(c: Column) -> Column:
    """Upper-case the first letter of every run of word characters.

    ``initcap`` only breaks on blanks; here a letter after ``-`` or ``'`` counts
    too, so the string is split before each word start and each piece is raised.
    """
    pieces = F.split(F.regexp_replace(c, r"\b(\w)", "\u0001$1"), "\u0001")
    raised = F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))))
    return F.array_join(raised, "")


def title_case(c: ColumnOrName) -> Column:
    """Title case with the LLC / Inc. fix-ups (a full stop is never doubled)."""
    fixed = F.regexp_replace(raise_word_starts(F.lower(F.trim(col(c)))), r"\bLlc\b", "LLC")
    return F.regexp_replace(fixed, r"\bInc\b\.?", "Inc.")


# FN-15 is F.levenshtein
# FN-16
def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two token arrays; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


# FN-17
def tokenize(c: ColumnOrName, min_len: int = 2, stop: Sequence[str] = SEARCH_STOP_WORDS) -> Column:
    tokens = F.split(F.lower(col(c)), r"[^a-z0-9]+")
    keep = F.filter(tokens, lambda t: F.length(t) >= min_len)
    return F.filter(keep, lambda t: ~t.isin(list(stop))) if stop else keep


# FN-18
def infer_city(c: ColumnOrName, default: str = "Sacramento") -> Column:
    parts = F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")
    second = F.trim(F.regexp_replace(F.get(parts, F.lit(1)), r"\s+CA\s+\d+.*", ""))
    return F.when(F.size(parts) >= 2, F.coalesce(F.nullif(second, F.lit("")), F.lit(default))).otherwise(F.lit(default))


def city_before_state(c: ColumnOrName) -> Column:
    return F.nullif(F.trim(F.regexp_extract(col(c), r"(?i),\s*([A-Za-z .'-]+),\s*CA\b", 1)), F.lit(""))


# FN-19
def location_parts(c: ColumnOrName) -> Column:
    """struct(city, county): first label part, and the part that names a county."""
    parts = F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")
    county = F.get(F.filter(parts, lambda p: p.rlike("(?i)county")), F.lit(0))
    return F.struct(
        F.coalesce(F.get(parts, F.lit(0)), F.lit("Unknown")).alias("city"),
        F.coalesce(county, F.get(parts, F.lit(1)), F.lit("Unknown")).alias("county"),
    )


# FN-20
def place_field(c: ColumnOrName, key: str) -> Column:
    return F.get_json_object(col(c), f"$.{key}")


# FN-24
def sentence_snippet(text: ColumnOrName, pos: Column) -> Column:
    """Sentence around a 1-based position: previous full stop to the next (or +180)."""
    t = col(text)
    before = F.substr(t, F.lit(1), F.greatest(pos - 1, F.lit(0)))
    last_stop = F.length(before) - F.length(F.substring_index(before, ".", -1))
    start = F.when(before.contains("."), last_stop + 1).otherwise(F.lit(1))
    tail = F.substr(t, pos, F.length(t))
    rel = F.instr(tail, ".")
    end = F.when(rel > 0, pos + rel - 1).otherwise(F.least(F.length(t), pos - 1 + 180))
    return collapse_ws(F.substr(t, start, end - start + 1))


# FN-25
def window_snippet(text: ColumnOrName, pos: Column, before: int, after: int | None = None) -> Column:
    """Text from ``before`` characters ahead of a 1-based position to ``after`` past it."""
    t = col(text)
    start = F.greatest(F.lit(1), pos - before)
    end = F.least(F.length(t), pos - 1 + (after if after is not None else before))
    return collapse_ws(F.substr(t, start, end - start + 1))


# FN-26
def collapse_ws(c: ColumnOrName) -> Column:
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def truncate(c: ColumnOrName, max_len: int = 180) -> Column:
    clean = collapse_ws(F.coalesce(col(c), F.lit("")))
    cut = F.concat(F.trim(F.substring(clean, 1, max_len - 1)), F.lit("…"))
    return F.when(F.length(clean) <= max_len, clean).otherwise(cut)


def clean_text(c: ColumnOrName) -> Column:
    """Keep line structure: drop NULs, trailing blanks, blank runs and long gaps."""
    steps = [("\u0000", " "), ("\r", "\n"), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " ")]
    out = reduce(lambda acc, s: F.regexp_replace(acc, s[0], s[1]), steps, F.coalesce(col(c), F.lit("")))
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def clean_description(c: ColumnOrName) -> Column:
    out = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\s+", " ")
    out = F.regexp_replace(out, r"(?i)\s+-\s+New Building or Addition.*$", "")
    return F.trim(F.regexp_replace(out, r"(?i)\s+-\s+Miscellaneous,.*$", ""))


# FN-27
def hash31(c: ColumnOrName) -> Column:
    chars = F.filter(F.split(col(c), ""), lambda ch: ch != "")
    h = F.aggregate(chars, F.lit(0).cast("bigint"), lambda acc, ch: (acc * 31 + F.ascii(ch)) % F.lit(4294967296))
    return F.lower(F.hex(h))


# FN-28
def url_key(c: ColumnOrName) -> Column:
    return F.sha1(col(c))


# FN-30
def value_band(c: ColumnOrName) -> Column:
    v = col(c)
    return case(
        [
            (v.isNull() | (v == 0), "Not estimated"),
            (v < 25_000, "Under $25k"),
            (v < 75_000, "$25k-$75k"),
            (v < 250_000, "$75k-$250k"),
            (v < 1_000_000, "$250k-$1M"),
        ],
        "$1M+",
    )


def pct(part: Column, whole: Column) -> Column:
    """Percent with one decimal, 0 for an empty whole."""
    return F.when(whole > 0, F.floor(part * F.lit(1000.0) / whole + F.lit(0.5)) / F.lit(10.0)).otherwise(F.lit(0.0))


# FN-31
def sentence_list(arr: Column) -> Column:
    clean = F.array_distinct(F.filter(arr, lambda x: x.isNotNull() & (x != "")))
    n = F.size(clean)
    head = F.array_join(F.slice(clean, 1, F.greatest(n - 1, F.lit(0))), ", ")
    last = F.try_element_at(clean, F.lit(-1))
    return case(
        [
            (n == 0, ""),
            (n == 1, last),
            (n == 2, F.concat(F.get(clean, F.lit(0)), F.lit(" and "), last)),
        ],
        F.concat(head, F.lit(", and "), last),
    )


def build_description(*parts: ColumnOrName, default: str) -> Column:
    joined = F.concat_ws(" - ", *[F.nullif(F.trim(col(p)), F.lit("")) for p in parts])
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit(default))


# FN-32
def count_term(c: ColumnOrName, term: ColumnOrName) -> Column:
    """Case-insensitive literal occurrences of ``term`` (a column) in the text."""
    t, needle = F.lower(col(c)), F.lower(col(term))
    gone = F.length(t) - F.length(F.replace(t, needle, F.lit("")))
    return F.when(F.length(needle) > 0, (gone / F.length(needle)).cast("bigint")).otherwise(F.lit(0))


# FN-33
def fmt_money(c: ColumnOrName) -> Column:
    empty = col(c).isNull() | (col(c) == 0)
    return F.when(empty, F.lit("Undisclosed")).otherwise(F.concat(F.lit("$"), F.format_number(F.floor(col(c) + 0.5), 0)))


def fmt_date(c: ColumnOrName) -> Column:
    return F.coalesce(F.date_format(col(c), "MMM d, yyyy"), F.lit("Never"))


def fmt_window(low: ColumnOrName, high: ColumnOrName) -> Column:
    return F.when(col(low).isNull() & col(high).isNull(), F.lit("Not estimated")).otherwise(
        F.concat(fmt_money(low), F.lit(" - "), fmt_money(high))
    )


# FN-34
def infer_units(*c: ColumnOrName) -> Column:
    return F.when(matches(F.concat_ws(" ", *[col(x) for x in c]), r"production home|single[ -]family|sfd"), F.lit(1))


# FN-35
def location_label(*parts: ColumnOrName, default: str = "Unknown") -> Column:
    joined = F.concat_ws(", ", *[F.nullif(F.trim(col(p)), F.lit("")) for p in parts])
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit(default))


# FN-36
def text_blob(*cols: ColumnOrName, sep: str = " ", lower: bool = True) -> Column:
    """Search blob; arrays are flattened in place, NULL and empty parts are skipped."""
    joined = F.concat_ws(sep, *[F.nullif(col(c).cast("string"), F.lit("")) if isinstance(c, str) else c for c in cols])
    return F.lower(joined) if lower else joined


# FN-37
def contact_label(name: ColumnOrName, title: ColumnOrName, company: ColumnOrName, phone: ColumnOrName, email: ColumnOrName,
                  source: ColumnOrName, contact_type: ColumnOrName, confidence: ColumnOrName) -> Column:
    """``name | company | route | type | 85%`` with the usual fallbacks."""
    some = lambda *cs: F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cs], F.lit("Unknown"))
    share = F.concat(F.floor(F.coalesce(col(confidence), F.lit(0.0)) * 100 + 0.5).cast("string"), F.lit("%"))
    return F.concat_ws(" | ", some(name, title, company), col(company), some(phone, email, source), col(contact_type), share)


# FN-38
def titleize(c: ColumnOrName) -> Column:
    """``some-slug`` -> ``Some Slug``; the part after a ``type:`` prefix is used."""
    raw = F.regexp_replace(F.regexp_replace(F.coalesce(col(c), F.lit("Unknown")), r"^[^:]+:", ""), "-", " ")
    return raise_word_starts(raw)


def canonical_company(c: ColumnOrName, aliases: Sequence[tuple[str, str]]) -> Column:
    key = normalize_name_v2(c)
    return case([(key.contains(needle), display) for needle, display in aliases], F.trim(col(c)))


# FN-39
def clean_name(c: ColumnOrName) -> Column:
    out = F.trim(F.regexp_replace(collapse_ws(c), r"[.,;:]+$", ""))
    bad = (F.length(out) < 3) | (F.length(out) > 80) | out.rlike(r"(?i)^(the|and|for|with|from)$")
    return F.when(~bad, out)
