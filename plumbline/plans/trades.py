"""Trade score matrix and its size / stage ladders (SM-10, CL-32, CL-33, WN-15)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import rules as R
from plumbline.functions.rules import ColumnOrName, case, col, contains_any, labels_where, matches
from plumbline.plans import vocab as V


def _ls(label: str, score: int) -> Column:
    return F.struct(F.lit(label).alias("label"), F.lit(score).alias("score"))


# CL-32
def scope_size(text: ColumnOrName, evidence: ColumnOrName, qualification: ColumnOrName) -> Column:
    return case(
        [
            (matches(text, V.SCOPE_SIZE_LARGE) & matches(text, V.SCOPE_SIZE_MAJOR), _ls("Major", 100)),
            (matches(text, V.SCOPE_SIZE_LARGE), _ls("Large", 82)),
            (matches(text, V.SCOPE_SIZE_SMALL), _ls("Small", 35)),
            (matches(text, V.SCOPE_SIZE_TINY), _ls("Tiny", 10)),
            ((col(evidence) >= 5) | (col(qualification) >= 70), _ls("Medium", 58)),
        ],
        _ls("Small", 35),
    )


def subcontractor_likelihood(size_label: ColumnOrName, text: ColumnOrName, state: ColumnOrName) -> Column:
    return case(
        [
            (col(size_label).isin("Major", "Large"), _ls("High", 90)),
            (matches(text, V.SUBCONTRACT_MEDIUM), _ls("Medium", 62)),
            (matches(text, V.SUBCONTRACT_LOW), _ls("Low", 18)),
            (col(state) == "Actionable Opportunity", _ls("Medium", 58)),
        ],
        _ls("Unknown", 35),
    )


def opportunity_size(size_label: ColumnOrName, text: ColumnOrName, qualification: ColumnOrName) -> Column:
    return case(
        [
            (col(size_label) == "Major", _ls("Very High", 95)),
            (col(size_label) == "Large", _ls("High", 78)),
            (matches(text, V.SIZE_MEDIUM), _ls("Medium", 58)),
            (col(size_label) == "Tiny", _ls("Very Low", 8)),
            (col(qualification) >= 70, _ls("Medium", 52)),
        ],
        _ls("Low", 25),
    )


def project_stage(text: ColumnOrName, state: ColumnOrName) -> Column:
    return case(
        [
            (matches(text, V.STAGE_OPEN), _ls("Open", 82)),
            (matches(text, V.STAGE_LATE), _ls("Late", 18)),
            (col(state).isin("Actionable Opportunity", "Research Required"), _ls("Open", 75)),
        ],
        _ls("Unknown", 45),
    )


def saturation(general_contractor: ColumnOrName) -> Column:
    gc = F.coalesce(col(general_contractor), F.lit(""))
    return case(
        [
            ((gc == "") | (gc == "Unknown"), _ls("Unknown", 0)),
            (matches(gc, V.GENERAL_CONTRACTOR_NAMES), _ls("General Contractor", 0)),
        ],
        _ls("Possible Trade Contractor", 12),
    )


# CL-51
def saturated_by_trade(general_contractor: ColumnOrName, terms: list[str]) -> Column:
    gc = F.lower(F.coalesce(col(general_contractor), F.lit("")))
    return ~gc.isin("", "unknown") & contains_any(gc, terms)


# FL-11
def is_trade_noise(text: ColumnOrName, trade: str) -> Column:
    hit = R.any_of(matches(text, p) for p in V.TRADE_NOISE.get(trade, []))
    if trade == "Fencing":
        hit = hit | (matches(text, V.FENCE_ELECTRICAL_NOISE) & ~matches(text, V.FENCE_ELECTRICAL_NOISE_UNLESS))
    return hit


# SM-10
def with_trade_scores(df: DataFrame, text: str, models: dict[str, dict] = V.TRADE_MODELS) -> DataFrame:
    """Adds ``trade_scores``: for every trade model a struct with relevance, penalties and the weighted score.

    Needs general_contractor, trade, fencing_signal_presence, fence_probability,
    access_score and the four label/score structs from :func:`with_ladders`.
    The models are literals, so all of it is a projection.  Each distinct term is
    looked for once; models that share terms add up the same flags.
    """
    terms = list(dict.fromkeys(t for m in models.values() for t in [*m["terms"], *m["adjacent"]]))
    place = {t: i for i, t in enumerate(terms)}
    out = df.withColumn("_hit", F.array(*[F.coalesce(col(text).contains(t), F.lit(False)).cast("int") for t in terms]))

    def hits(wanted: list[str]) -> Column:
        return reduce(lambda a, b: a + b, [F.get("_hit", F.lit(place[t])) for t in wanted], F.lit(0))

    tags = F.lower(F.coalesce(F.col("trade"), F.lit("")))
    out = out.withColumn("_single", F.size(F.filter(F.split(tags, "[,/|]+"), lambda x: F.trim(x) != "")) == 1)
    names = sorted(models)
    per_trade = [
        F.struct(
            F.lit(trade).alias("model"),
            F.lit(names.index(trade)).alias("place"),
            hits(m["terms"]).alias("direct_hits"),
            hits(m["adjacent"]).alias("adjacent"),
            tags.contains(trade.lower()).alias("tagged"),
            F.when(saturated_by_trade("general_contractor", m["saturation"]), 42).otherwise(F.col("saturation.score")).alias("saturation_penalty"),
            F.when(is_trade_noise(text, trade) if trade in V.TRADE_NOISE else F.lit(False), 28).otherwise(0).alias("noise_penalty"),
        )
        for trade, m in models.items()
    ]
    out = out.withColumn("_models", F.array(*per_trade))
    prob = F.col("fence_probability")

    def relevance(m: Column) -> Column:
        fencing = m["model"] == "Fencing"
        base = F.least(F.lit(100), m["direct_hits"] * 28 + m["adjacent"] * 8)
        base = F.when(fencing & F.col("fencing_signal_presence"), F.greatest(base, F.lit(65))).otherwise(base)
        base = F.when(fencing & (prob >= 50), F.greatest(base, prob.cast("int"))).otherwise(base)
        floor_ = F.when(F.col("_single") | (m["direct_hits"] > 0), 70).otherwise(48)
        base = F.when(m["tagged"], F.greatest(base, floor_)).otherwise(base)
        capped = (m["direct_hits"] == 0) & (m["adjacent"] > 0) & m["model"].isin(V.ADJACENT_CAPPED_TRADES)
        return F.when(capped, F.least(base, F.lit(42))).otherwise(base)

    kept = ("model", "place", "direct_hits", "saturation_penalty", "noise_penalty")
    out = out.withColumn("_models", F.transform("_models", lambda m: F.struct(*[m[k].alias(k) for k in kept], relevance(m).alias("trade_relevance"))))
    # weights are hundredths, so the sum is exact before rounding
    shared = (
        F.col("scope_size.score") * 18 + F.col("subcontractor.score") * 22 + F.col("opp_size.score") * 14 + F.col("stage.score") * 12
        + F.least(F.coalesce(F.col("access_score"), F.lit(0)), F.lit(100)) * 6
    )
    out = out.withColumn("_shared", shared)

    def scored(m: Column) -> Column:
        weighted = m["trade_relevance"] * 28 + F.col("_shared") - (m["saturation_penalty"] + m["noise_penalty"]) * 100
        return F.struct(*[m[k].alias(k) for k in (*kept, "trade_relevance")], R.clamp(F.floor((weighted + 50) / 100).cast("int")).alias("trade_score"))

    return out.withColumn("trade_scores", F.transform("_models", scored)).drop("_hit", "_single", "_models", "_shared")


TRADE_FIELDS = ("model", "direct_hits", "trade_relevance", "saturation_penalty", "noise_penalty", "trade_score")


def trade_scores(df: DataFrame, text: str, models: dict[str, dict] = V.TRADE_MODELS) -> DataFrame:
    """One row per (row, trade) with relevance, penalties and the weighted score."""
    rows = with_trade_scores(df, text, models)
    return rows.select(*[c for c in rows.columns if c != "trade_scores"], F.inline_outer("trade_scores")).drop("place")


def with_ladders(df: DataFrame, text: str) -> DataFrame:
    out = df.withColumn("scope_size", scope_size(text, "evidence_count", "qualification_score"))
    out = out.withColumn("subcontractor", subcontractor_likelihood(F.col("scope_size.label"), text, "opportunity_state"))
    out = out.withColumn("opp_size", opportunity_size(F.col("scope_size.label"), text, "qualification_score"))
    return out.withColumn("stage", project_stage(text, "opportunity_state")).withColumn("saturation", saturation("general_contractor"))


# WN-15
def best_trade(df: DataFrame) -> DataFrame:
    """The fields of the best trade of each row: highest score; direct evidence first, fencing last on a pure tie, then name.

    Chosen inside the row's ``trade_scores``: no explode, sort or shuffle.
    """
    order = lambda m: F.struct(m["trade_score"].alias("s"), (m["direct_hits"] > 0).alias("d"), (m["model"] != "Fencing").alias("f"), (-m["place"]).alias("p"), m.alias("m"))
    out = df.withColumn("_best", F.array_max(F.transform("trade_scores", order)))
    return out.withColumns({k: F.col("_best.m")[k] for k in TRADE_FIELDS}).drop("_best")


def requested_trade(trades: list[str]) -> Column:
    """Struct of the best score among the requested trades (all trades without a request), ties in the order of the request; NULL without one."""
    pool = F.filter("trade_scores", lambda m: m["model"].isin(trades)) if trades else F.col("trade_scores")
    place = (lambda m: F.array_position(F.array(*[F.lit(t) for t in trades]), m["model"])) if trades else (lambda m: m["place"].cast("long"))
    return F.array_max(F.transform(pool, lambda m: F.struct(m["trade_score"].alias("s"), (-place(m)).alias("p"), m.alias("m"))))["m"]


# CL-33
def suppression_reasons() -> Column:
    return labels_where(
        [
            (F.col("scope_size.label") == "Tiny", "Tiny scope"),
            (F.col("subcontractor.label") == "Low", "Low subcontractor likelihood"),
            (F.col("stage.label") == "Late", "Late or closed stage"),
            (F.col("saturation_penalty") >= 40, "Existing GC appears to be the searched trade contractor"),
            (F.col("trade_relevance") < 25, "Weak trade relevance"),
            (F.col("noise_penalty") > 0, "Likely noise match"),
        ]
    )


def score_reason() -> Column:
    base = F.concat(
        F.col("model"), F.lit(" score "), F.col("trade_score").cast("string"), F.lit(": "), F.col("scope_size.label"), F.lit(" scope, "),
        F.lower("subcontractor.label"), F.lit(" subcontractor likelihood, "), F.lower("opp_size.label"), F.lit(" opportunity size, "), F.lower("stage.label"), F.lit(" stage."))
    return F.when(F.size("suppress_reasons") > 0, F.concat(base, F.lit(" Suppressed: "), F.array_join("suppress_reasons", ", "), F.lit("."))).otherwise(base)


def contractor_opportunities(df: DataFrame, text: str) -> DataFrame:
    """Best trade per row with its score, visibility and reason."""
    best = best_trade(with_trade_scores(with_ladders(df, text), text))
    out = best.withColumn("suppress_reasons", suppression_reasons())
    out = out.withColumn("qualification_reason", score_reason())
    return out.withColumn("contractor_visible", (F.col("trade_score") >= 35) & (F.size("suppress_reasons") == 0))
