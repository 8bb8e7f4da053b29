"""Scope intelligence and evidence reconciliation (CL-22..CL-31, FL-12, SM-17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import rules as R
from plumbline.functions import text as X
from plumbline.functions.rules import ColumnOrName, case, col, labels_where, matches
from plumbline.plans import vocab as V



def _empty() -> Column:
    return F.array().cast("array<string>")


# CL-22
def primary_scope(text: ColumnOrName) -> Column:
    """struct(label, confidence) of the first scope rule that hits."""
    row = lambda label, conf: F.struct(F.lit(label).alias("label"), F.lit(conf).alias("confidence"))
    return case([(matches(text, p), row(label, conf)) for label, p, conf in V.PRIMARY_SCOPES], row("Unknown", 20))


# CL-23
def project_categories(text: ColumnOrName) -> Column:
    return R.multi_label(text, V.PROJECT_CATEGORIES)


# CL-24
def work_categories(text: ColumnOrName, seed_trades: Column, tags: ColumnOrName) -> Column:
    """Seed trades, then work rules; the comma-separated tags only if nothing else hit."""
    found = F.array_union(F.coalesce(seed_trades, _empty()), R.multi_label(text, V.WORK_CATEGORIES))
    fallback = F.filter(F.transform(F.split(F.coalesce(col(tags), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array_distinct(fallback))


# CL-25
def primary_work(text: ColumnOrName, scope_label: ColumnOrName, categories: Column) -> Column:
    by_text = R.first_match(text, V.PRIMARY_WORK)
    return F.when(col(scope_label) != "Unknown", col(scope_label)).otherwise(F.coalesce(by_text, F.get(categories, F.lit(0)), F.lit("Unknown")))


def scope_project_type(text: ColumnOrName, scope_label: ColumnOrName, work: ColumnOrName, name: ColumnOrName) -> Column:
    return case(
        [
            (col(scope_label) == V.FENCE_SCOPE, "Fence / Gate Installation"),
            (col(scope_label) == "Electrical / landscape lighting", "Electrical / Landscape Lighting"),
            *[(matches(text, p), label) for label, p in V.SCOPE_PROJECT_TYPES],
            (col(work) != "Unknown", col(work)),
        ],
        X.collapse_ws(F.coalesce(col(name), F.lit(""))),
    )


def likely_trades(text: ColumnOrName, scope_label: ColumnOrName, work: ColumnOrName, categories: Column) -> Column:
    """Trades implied by the text, the scope and the work categories, at most eight."""
    groups = _empty()
    for trades, pattern in V.LIKELY_TRADE_GROUPS:
        groups = F.array_union(groups, F.when(matches(text, pattern), F.array(*[F.lit(x) for x in trades])).otherwise(_empty()))
    fence = matches(text, V.FENCE_INSTALL_LANGUAGE) | (col(scope_label) == V.FENCE_SCOPE)
    out = F.array_union(groups, F.when(fence, F.array(F.lit("Fencing"))).otherwise(_empty()))
    out = F.array_union(out, F.transform(categories, lambda c: F.regexp_replace(c, r"(?i) improvements$", "")))
    out = F.when((F.size(out) == 0) & (col(work) != "Unknown"), F.array(col(work))).otherwise(out)
    return F.slice(out, 1, 8)


def trade_confidence(text: ColumnOrName, categories: Column) -> Column:
    return case([(matches(text, V.DIRECT_WORK), 85), (F.size(categories) > 0, 65)], 35)


def non_fence_primary(scope_label: ColumnOrName) -> Column:
    return ~F.coalesce(col(scope_label), F.lit("Unknown")).isin("Unknown", V.FENCE_SCOPE)


# CL-26
def with_fence_signals(df: DataFrame, text: str, scope_label: str, categories: str) -> DataFrame:
    """Adds strong / weak / context / negative label arrays, score, tier and a snippet for every strong rule that hits.

    Each strong rule is located once: its position decides the hit and gives the
    snippet.  Score and tier are plain arithmetic over the label arrays in a later
    projection, which keeps each generated method small.
    """
    fence_scope = F.col(scope_label) == V.FENCE_SCOPE
    located = F.array(*[F.coalesce(F.regexp_instr(F.col(text), F.lit(f"(?i){p}")), F.lit(0)) for _, p in V.FENCE_STRONG])
    out = df.withColumn("_strong_at", located)
    at = [F.get("_strong_at", F.lit(i)) for i in range(len(V.FENCE_STRONG))]
    out = out.withColumn("strong", R.labels_where([(x > 0, label) for x, (label, _) in zip(at, V.FENCE_STRONG)]))
    out = out.withColumn("weak", R.multi_label(text, V.FENCE_WEAK)).withColumn("context", R.multi_label(text, V.FENCE_CONTEXT))
    out = out.withColumn("negative", F.when(fence_scope, _empty()).otherwise(R.multi_label(text, V.FENCE_NEGATIVE)))
    strong, weak, ctx, neg = (F.size(c) for c in ("strong", "weak", "context", "negative"))
    bonus = F.arrays_overlap(F.col(categories), F.array(*[F.lit(x) for x in V.FENCE_BONUS_CATEGORIES]))
    raw = (
        strong * 30 + weak * 8 + ctx * 10 - neg * 18
        - F.when((strong == 0) & (neg > 0), 22).otherwise(0)
        - F.when((strong == 0) & non_fence_primary(scope_label), 30).otherwise(0)
        + F.when((strong > 0) & F.coalesce(bonus, F.lit(False)), 12).otherwise(0)
    )
    out = out.withColumn("fence_score", R.clamp(raw))
    out = out.withColumn("fence_tier", case([(strong > 0, "direct"), (weak > 0, "weak"), (ctx > 0, "contextual")], "none"))
    quoted = R.labels_where([(x > 0, F.struct(F.lit(label).alias("signal"), X.sentence_snippet(text, x).alias("snippet"))) for x, (label, _) in zip(at, V.FENCE_STRONG)])
    return out.withColumn("fence_snippets", quoted).drop("_strong_at")


# CL-27
BLOCKING_NEGATIVES = "Tiny demolition|Interior remodel|Roofing-only|HVAC-only|Electrical or solar|Primary work is electrical"


def scope_confidence(scope_label: ColumnOrName) -> Column:
    """struct(label, score) from the fence-signal columns."""
    row = lambda label, score: F.struct(F.lit(label).alias("label"), F.lit(score).alias("score"))
    strong, weak, ctx = F.size("strong") > 0, F.size("weak") > 0, F.size("context") > 0
    off = non_fence_primary(scope_label)
    blocked = F.exists("negative", lambda x: x.rlike(BLOCKING_NEGATIVES))
    return case(
        [
            (off & ~strong, row("No Evidence", 5)),
            (blocked & ~strong, row("No Evidence", 5)),
            (strong & (F.col("fence_score") >= 78), row("Primary Opportunity", 90)),
            (strong & (F.col("fence_score") >= 54), row("Secondary Opportunity", 72)),
            (strong, row("Possible Opportunity", 52)),
            (weak, row("Weak Opportunity", 20)),
            (ctx & ~off, row("Weak Opportunity", 24)),
        ],
        row("No Evidence", 5),
    )


# CL-28
def bidability(confidence_label: ColumnOrName, scope_label: ColumnOrName) -> Column:
    """struct(bidable, reason)."""
    row = lambda ok, why: F.struct(F.lit(ok).alias("bidable"), (why if isinstance(why, Column) else F.lit(why)).alias("reason"))
    label, off = col(confidence_label), non_fence_primary(scope_label)
    primary = F.concat(F.lit("Primary scope is "), col(scope_label))
    return case(
        [
            (label == "Primary Opportunity", row(True, "Strong direct fencing evidence; primary fencing opportunity.")),
            (label == "Secondary Opportunity", row(True, "Direct fencing evidence supports bidding as a secondary scope.")),
            ((label == "Possible Opportunity") & off, row(False, F.concat(primary, F.lit("; fencing is incidental and not bidable.")))),
            (label == "Possible Opportunity", row(True, "Possible fencing scope; consider bidding with qualification.")),
            (label == "Weak Opportunity", row(False, "Weak or contextual fencing signals only; not bidable without additional confirmation.")),
            (off, row(False, F.concat(primary, F.lit("; no fencing evidence found.")))),
        ],
        row(False, "No fencing evidence found; not bidable."),
    )


# CL-29
SCOPE_PACKAGES = [
    # Fixed values: (categories, packages)
    (["Housing"], ["Perimeter fencing", "Community fencing", "Construction fencing"]),
    (["Parks", "Schools"], ["Public access separation", "Decorative fencing"]),
    (["Utilities", "Drainage", "Infrastructure"], ["Construction fencing", "Access control gates"]),
    (["Industrial", "Security"], ["Security fencing", "Access control gates"]),
]


def potential_scope(categories: Column, strong: Column, scope_label: ColumnOrName) -> Column:
    out = _empty()
    for cats, packages in SCOPE_PACKAGES:
        hit = F.coalesce(F.arrays_overlap(categories, F.array(*[F.lit(c) for c in cats])), F.lit(False))
        out = F.array_union(out, F.when(hit, F.array(*[F.lit(p) for p in packages])).otherwise(_empty()))
    return F.when((F.size(strong) > 0) & ~non_fence_primary(scope_label), F.slice(out, 1, 5)).otherwise(_empty())


# CL-30
def normalize_confidence(label: ColumnOrName) -> Column:
    return case([(col(label) == k, v) for k, v in V.CONFIDENCE_RENAMES.items()], col(label))


def with_contradictions(df: DataFrame, confidence: str, bidable: str, reason: str, scope_label: str, positives: str, weak: str, negatives: str,
                        signal_score: str, likely: str) -> DataFrame:
    """Reconciles the scope verdict with document evidence: final confidence, likely scope, bid-ability and notes."""
    strong = F.col(positives) > 0
    start = normalize_confidence(confidence)
    veto = F.col(scope_label).isin(V.VETO_SCOPES)
    b1 = (F.col(bidable) == F.lit(False)) & ~strong
    b2 = ~b1 & veto & ~strong
    b3 = strong
    b4 = ~b1 & ~b2 & ~strong & (F.col(weak) > 0)
    raised = case(
        [
            ((F.col(signal_score) >= 72) | (F.col(positives) >= 2), F.when(start == "Primary Opportunity", start).otherwise(F.lit("Secondary Opportunity"))),
            (~start.isin("Primary Opportunity", "Secondary Opportunity"), "Possible Opportunity"),
        ],
        start,
    )
    blocked = (F.col(negatives) > 0) & ~strong
    out = df.withColumn("_c", case([(blocked, "No Evidence"), (b1 | b2, "No Evidence"), (b3, raised), (b4, "Weak Opportunity")], start))
    notes = labels_where(
        [
            (b1, F.coalesce(F.col(reason), F.lit("Primary scope is not fencing; incidental mentions are not bid-able."))),
            (b2, F.concat(F.lit('Primary scope "'), F.col(scope_label), F.lit('" vetoes weak/incidental gate or fence mentions.'))),
            (b3, "Strong fence/gate installation evidence supports bid-able fencing scope."),
            (b4, "Only weak/incidental fence or gate mentions found; not treated as bid-able fencing scope."),
            (blocked, "Negative primary-work evidence without strong fence evidence suppresses fence scope."),
            (F.col("_c") == "Weak Opportunity", "Weak Opportunity cannot generate a specific fencing scope."),
            (F.col("_c") == "No Evidence", "No Evidence suppresses fencing scope generation."),
        ]
    )
    likely_scope = case(
        [
            (F.col("_c") == "Weak Opportunity", "Insufficient evidence to determine likely fencing scope."),
            (F.col("_c") == "No Evidence", "No fencing scope generated."),
        ],
        F.coalesce(F.nullif(F.col(likely), F.lit("")), F.lit("Unknown")),
    )
    return (
        out.withColumn("notes", notes).withColumn("likely_fence_scope", likely_scope)
        .withColumn("evidence_bidable", strong & F.col("_c").isin("Primary Opportunity", "Secondary Opportunity", "Possible Opportunity"))
        .withColumnRenamed("_c", "final_confidence")
    )


# CL-31
def associated_improvements(text: ColumnOrName, work: Column) -> Column:
    return F.array_union(F.coalesce(work, _empty()), R.multi_label(text, V.ASSOCIATED_IMPROVEMENTS))


def related_development(text: ColumnOrName) -> Column:
    units = F.regexp_extract(col(text), r"(?i)\b\d{2,5}\s+(?:planned\s+)?(?:residential\s+)?(?:units|homes|lots)\b", 0)
    return case([(units != "", units), (matches(text, "subdivision|village|residential|homes|lots"), "Related residential development identified")], "Unknown")


def primary_objective(text: ColumnOrName, fallback: ColumnOrName) -> Column:
    return F.coalesce(R.first_match(text, V.PRIMARY_OBJECTIVES), F.nullif(col(fallback), F.lit("")), F.lit("Unknown"))


# FL-12
def intentional_fence(snippet: ColumnOrName) -> Column:
    s = F.lower(col(snippet))
    return case(
        [
            (~matches(s, r"\bfenc(?:e|es|ing)\b"), False),
            (matches(s, V.FENCE_INTENT), True),
            (matches(s, V.FENCE_INCIDENTAL), False),
            (matches(s, V.FENCE_OTHER_WORK) & ~matches(s, V.FENCE_OTHER_WORK_UNLESS), False),
        ],
        matches(s, V.FENCE_WORDS) & matches(s, V.FENCE_ACTIONS),
    )


def intentional_gate(snippet: ColumnOrName) -> Column:
    s = F.lower(col(snippet))
    return case(
        [
            (matches(s, r"golden\s+gate"), False),
            (matches(s, "a-gate"), False),
            (matches(s, V.GATE_STREET) & ~matches(s, V.GATE_ACTION) & ~matches(s, V.GATE_DIRECT), False),
            (matches(s, V.GATE_OTHER_WORK) & ~matches(s, V.GATE_OTHER_WORK_UNLESS), False),
        ],
        matches(s, r"\bgates?\b"),
    )


# SM-17
def evidence_strength(sources: ColumnOrName, source_types: ColumnOrName, positives: ColumnOrName, negatives: ColumnOrName) -> Column:
    return R.clamp(
        F.least(F.lit(40), col(sources) * 10) + col(source_types) * 8 + F.least(F.lit(35), col(positives) * 5) - F.least(F.lit(30), col(negatives) * 10)
    )


def scope_rows(df: DataFrame, text: str, name: str, tags: str, seed_trades: str | None = None) -> DataFrame:
    """The whole scope stage for one text column."""
    seed = F.col(seed_trades) if seed_trades else _empty()
    out = df.withColumn("_s", primary_scope(F.concat_ws(" ", F.col(text), F.col(tags))))
    out = out.withColumn("primary_scope", F.col("_s.label")).withColumn("primary_scope_confidence", F.col("_s.confidence")).drop("_s")
    out = out.withColumn("categories", project_categories(text)).withColumn("work_categories", work_categories(text, seed, tags))
    out = out.withColumn("primary_work", primary_work(text, "primary_scope", F.col("work_categories")))
    out = out.withColumn("scope_project_type", scope_project_type(text, "primary_scope", "primary_work", name))
    out = out.withColumn("likely_trades", likely_trades(text, "primary_scope", "primary_work", F.col("work_categories")))
    out = out.withColumn("trade_confidence", trade_confidence(text, F.col("work_categories")))
    out = with_fence_signals(out, text, "primary_scope", "categories")
    out = out.withColumn("_f", scope_confidence("primary_scope")).withColumn("fence_scope_confidence", F.col("_f.label")).withColumn("fence_scope_score", F.col("_f.score"))
    out = out.withColumn("_b", bidability("fence_scope_confidence", "primary_scope")).withColumn("bidable", F.col("_b.bidable")).withColumn("bid_reason", F.col("_b.reason"))
    return out.withColumn("potential_scope", potential_scope(F.col("categories"), F.col("strong"), "primary_scope")).drop("_f", "_b")
