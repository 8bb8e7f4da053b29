"""Company discovery, profiles, behaviour and relationships (AG-09..AG-16, SM-16, CL-40/41/51)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import contacts as C
from plumbline.functions import rules as R
from plumbline.functions import text as X
from plumbline.functions.rules import ColumnOrName, case, col
from plumbline.operators.aggregate import value_counts
from plumbline.operators.keyed import best_per_key, top_n_per_group
from plumbline.operators.relational import co_members, filter_once
from plumbline.plans import vocab as V


# CL-40
OPENING_TYPES = ("Developer", "General Contractor")  # the only ones on the left of a relation


def relation_type(from_type: ColumnOrName, to_type: ColumnOrName) -> Column:
    a, b = col(from_type), col(to_type)
    return case(
        [
            ((a == "Developer") & (b == "General Contractor"), "developer_gc"),
            ((a == "Developer") & (b == "Architect"), "developer_architect"),
            ((a == "Developer") & (b == "Engineer"), "developer_engineer"),
            ((a == "Developer") & (b != "Developer"), "developer_trade_contractor"),
            ((a == "General Contractor") & (b != "Developer"), "gc_trade_contractor"),
        ]
    )


PROJECT_RELATIONS = {
    "Developer": "project_developer", "General Contractor": "project_gc", "Architect": "project_architect",
    "Engineer": "project_engineer", "Property Owner": "project_property_owner",
}


def project_relation(company_type: ColumnOrName) -> Column:
    return case([(col(company_type) == k, v) for k, v in PROJECT_RELATIONS.items()], "project_company")


# JN-08
def project_pairs(facts: DataFrame) -> DataFrame:
    """Ordered company pairs of a project that carry a relation.

    Only types that can open a relation (developer, general contractor) enter the
    left side, so companies that relate to nobody are never paired.
    """
    members = facts.select("project_id", "company_id", "company_type").distinct()
    relation = relation_type("a_company_type", "b_company_type")
    pairs = co_members(members, "project_id", "company_id", keep=relation.isNotNull(), opens=F.col("company_type").isin(*OPENING_TYPES))
    return pairs.withColumn("relation", relation)


# AG-15
def relationship_projects(facts: DataFrame) -> DataFrame:
    """(from_id, to_id, relation, project_id): the project list of every relation edge, as a long table."""
    return project_pairs(facts).select(F.col("a_company_id").alias("from_id"), F.col("b_company_id").alias("to_id"), "relation", "project_id")


def relationships(facts: DataFrame) -> DataFrame:
    """Relation edges: projects shared, trades seen, confidence min(.9, .35 + .15 n).

    Pairs are made once: a project's trades, from a small vocabulary, join as one
    row and become flags, so counts and trades come from one partial aggregate.
    The project list is the long table of :func:`relationship_projects`.
    """
    trades = facts.filter(F.col("trade").isin(V.BEHAVIOR_TRADES)).groupBy("project_id").agg(F.collect_set("trade").alias("_trades"))
    pairs = relationship_projects(facts).join(trades, "project_id", "left")
    seen = {t: F.coalesce(F.max(F.array_contains("_trades", t)), F.lit(False)) for t in sorted(V.BEHAVIOR_TRADES)}
    edges = pairs.groupBy("from_id", "to_id", "relation").agg(
        F.count(F.lit(1)).alias("project_count"), F.array_compact(F.array(*[F.when(hit, t) for t, hit in seen.items()])).alias("trades"))
    conf = F.least(F.lit(0.9), R.round_half_up(F.lit(0.35) + F.col("project_count") * 0.15, 2))
    return edges.withColumn("confidence", conf)


# AG-09
def discover_companies(mentions: DataFrame, records_kept: int = 25) -> DataFrame:
    """mentions(name, role, source_name, source_url, project_name, seq) -> one row per normalised name."""
    named = lambda df: filter_once(df, C.is_source_backed("name")).withColumn("normalized_name", X.normalize_name_v2("name"))
    # by written name first: a name is judged and normalised once, not for each mention
    written = mentions.groupBy("name").agg(F.min("seq").alias("seq"), F.collect_set("role").alias("roles"), F.count(F.lit(1)).alias("n"))
    base = named(written).groupBy("normalized_name").agg(
        F.min_by("name", "seq").alias("company_name"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("roles")))).alias("roles"), F.sum("n").alias("project_count"))
    first = named(top_n_per_group(mentions, ["name"], ["seq"], records_kept))
    kept = top_n_per_group(first, ["normalized_name"], ["seq"], records_kept, rank="_pos").groupBy("normalized_name").agg(
        F.array_sort(F.collect_list(F.struct("_pos", "source_name", "source_url", "project_name", "role"))).alias("source_records"))
    return base.join(kept, "normalized_name")


PROFILE_FIELDS = [
    # Fixed values: (label, column)
    ("Official Website", "official_website"), ("Phone", "phone"), ("Email", "email"), ("Contact Page", "contact_page_url"),
    ("Bid Opportunities Page", "bid_opportunities_page_url"), ("Vendor Registration Page", "vendor_registration_page_url"),
    ("Subcontractor Registration Page", "subcontractor_registration_page_url"), ("Trade Partner Portal", "trade_partner_portal_url"),
    ("Plan Room", "plan_room_url"),
]


# AG-10
def company_profiles(web: DataFrame, sources: ColumnOrName, best_value: ColumnOrName | None = None) -> DataFrame:
    """Safe fields, confidence and the list of missing fields per company row."""
    out = web
    for _, c in PROFILE_FIELDS:
        safe = {"phone": C.safe_phone, "email": C.safe_email}.get(c, C.safe_url)
        out = out.withColumn(c, safe(c))
    has = lambda *cs: reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in cs])
    score = R.points(
        [
            (col(sources) > 0, 0.35),
            (has("official_website"), 0.2), (has("phone"), 0.18), (has("email"), 0.1), (has("contact_page_url"), 0.08),
            (has("bid_opportunities_page_url", "vendor_registration_page_url"), 0.08),
            (has("subcontractor_registration_page_url", "trade_partner_portal_url"), 0.08), (has("plan_room_url"), 0.1),
        ],
        0.0,
    )
    if best_value is not None:
        v = col(best_value)
        score = score + case([(v == "High", 0.12), (v == "Medium", 0.08), (v.isNotNull(), 0.04)], 0.0)
    missing = R.labels_where([(F.col(c).isNull(), label) for label, c in PROFILE_FIELDS])
    return (
        out.withColumn("profile_confidence", F.least(F.lit(1.0), R.round_half_up(score, 2)))
        .withColumn("missing_fields", missing)
        .withColumn("actionable", has("official_website", "phone", "contact_page_url", "bid_opportunities_page_url", "vendor_registration_page_url",
                                      "subcontractor_registration_page_url", "trade_partner_portal_url", "plan_room_url"))
    )


# CL-51
def path_value(path_type: ColumnOrName) -> Column:
    high = V.REGISTRATION_PATHS + ["trade_partner"] + V.BID_PATHS
    return case([(col(path_type).isin(high), "High"), (col(path_type) == "estimating_contact", "Medium")], "Low")


def value_answer(value: ColumnOrName) -> Column:
    return case([(col(value) == "High", "Yes"), (col(value) == "Medium", "Maybe")], "No")


FALLBACK_PATHS = [
    # Fixed values: (path type, URL column)
    ("vendor_registration", "vendor_registration_page_url"), ("subcontractor_registration", "subcontractor_registration_page_url"),
    ("trade_partner", "trade_partner_portal_url"), ("bid_portal", "bid_opportunities_page_url"), ("plan_room", "plan_room_url"),
    ("general_contact", "contact_page_url"),
]


# AG-11 / FL-19
def valid_paths(paths: DataFrame) -> DataFrame:
    """Explicit paths with a known type and value and safe URLs; confidence clamped to 0..1."""
    types = [p for p, _ in FALLBACK_PATHS] + ["public_procurement", "estimating_contact"]
    ok = F.col("path_type").isin(types) & F.col("contractor_value").isin("High", "Medium", "Low") & C.safe_url("path_url").isNotNull()
    return paths.filter(ok).withColumn("confidence", R.clamp(F.coalesce(F.col("confidence"), F.lit(0.5)), 0.0, 1.0))


def procurement_paths(profiles: DataFrame, key: str, explicit: DataFrame | None = None) -> DataFrame:
    """Explicit paths plus the URL columns unpivoted, minus (type, url) already explicit."""
    pairs = F.array(*[F.struct(F.lit(t).alias("path_type"), F.col(c).alias("path_url"), F.lit(i).alias("position")) for i, (t, c) in enumerate(FALLBACK_PATHS)])
    long = profiles.select(key, F.explode(pairs).alias("p")).select(key, "p.*").filter("path_url IS NOT NULL")
    conf = F.when(F.col("path_type").isin(V.REGISTRATION_PATHS + ["trade_partner"] + V.BID_PATHS), 0.72).otherwise(0.58)
    fallback = long.withColumn("contractor_value", path_value("path_type")).withColumn("confidence", conf)
    if explicit is None:
        return fallback
    extra = fallback.join(explicit.select(key, "path_type", "path_url"), [key, "path_type", "path_url"], "left_anti")
    return explicit.unionByName(extra, allowMissingColumns=True)


def best_path(paths: DataFrame, key: str) -> DataFrame:
    rank = case([(F.col("contractor_value") == k, v) for k, v in V.PATH_VALUE_RANK.items()], 0)
    return best_per_key(paths, [key], [F.desc(rank), F.desc("confidence"), "path_type", "path_url"])


# AG-12
def company_intelligence(profiles: DataFrame, path_types: str = "path_types", best_type: str = "best_type") -> DataFrame:
    """Three always-present rows and up to four conditional ones per company."""
    has = lambda *types: F.coalesce(F.arrays_overlap(F.col(path_types), F.array(*[F.lit(x) for x in types])), F.lit(False))
    row = lambda kind, summary, conf: F.struct(F.lit(kind).alias("kind"), summary.alias("summary"), conf.cast("double").alias("confidence"))
    any_path = F.size(path_types) > 0
    dedicated = has("estimating_contact", "trade_partner", *V.REGISTRATION_PATHS, *V.BID_PATHS)
    conf = F.col("profile_confidence")
    coverage = case(
        [
            (dedicated, "Procurement path intelligence exists for this company."),
            (F.col("actionable"), "Company has general contact intelligence, but no dedicated procurement path has been verified."),
        ],
        "Company is source-backed by collector records, but actionable company web intelligence is incomplete.",
    )
    missing = F.when(F.size("missing_fields") > 0, F.concat(F.lit("Missing: "), F.array_join("missing_fields", ", "), F.lit("."))).otherwise(
        F.lit("No requested company web fields are missing."))
    rows = [
        row("coverage_summary", coverage, F.when(dedicated, F.greatest(conf, F.lit(0.7))).otherwise(conf)),
        row("company_type_evidence", F.concat(F.lit("Company type resolved as "), F.col("company_type"), F.lit(" from collector role evidence.")), F.lit(0.7)),
        row("missing_fields", missing, F.lit(0.8)),
        F.when(F.col("official_website").isNotNull() | F.col("phone").isNotNull() | F.col("contact_page_url").isNotNull(),
               row("web_presence", F.lit("Company has source-backed web or phone presence."), conf)),
        F.when(has("vendor_registration", "trade_partner", *V.BID_PATHS),
               row("vendor_access", F.lit("Company has a source-backed vendor, trade partner, bid, procurement, or plan-room route."), F.lit(0.85))),
        F.when(any_path, row("procurement_access", F.concat(F.lit("Best procurement path: "), F.replace(F.col(best_type), F.lit("_"), F.lit(" ")), F.lit(".")), F.col("best_confidence"))),
        F.when(has("subcontractor_registration", "trade_partner"),
               row("subcontractor_access", F.lit("Company has a source-backed subcontractor or trade partner access route."), F.lit(0.85))),
    ]
    return profiles.select("seq", F.explode_outer(F.array_compact(F.array(*rows))).alias("r")).filter("r IS NOT NULL").select("seq", "r.*")


# CL-41
def outsourcing_status(company_type: ColumnOrName, projects: ColumnOrName) -> Column:
    n, kind = col(projects), col(company_type)
    return case(
        [
            (n == 0, "Unknown"),
            ((kind == "Developer") & (n >= 3), "Frequently Outsources"),
            (kind == "Developer", "Sometimes Outsources"),
            ((kind == "General Contractor") & (n >= 8), "Self Performs"),
            ((kind == "General Contractor") & (n >= 3), "Rarely Outsources"),
        ],
        "Unknown",
    )


# AG-13 / SM-16
def company_behavior(facts: DataFrame, paths: DataFrame, companies: DataFrame, key: str = "company_id") -> DataFrame:
    """Project count, fencing outsourcing and opportunity likelihood per company.

    ``facts`` are (company, project, trade) rows; the per-value frequency lists
    are :func:`behavior_counts`.
    """
    per = facts.groupBy(key).agg(
        F.count_distinct("project_id").alias("project_count"),
        F.count_distinct(F.when(F.col("trade") == "Fencing", F.col("project_id"))).alias("fencing_projects"))
    route = paths.groupBy(key).agg(
        F.count(F.lit(1)).alias("path_count"), F.count_if(F.col("contractor_value") == "High").alias("high_paths"),
        F.count_if(F.col("contractor_value") == "Medium").alias("medium_paths"))
    base = companies.select(key, "company_type").join(per, key, "left").join(route, key, "left").na.fill(0)
    status = outsourcing_status("company_type", "fencing_projects")
    out = base.withColumn("fencing_outsourcing", status)
    score = (
        F.least(F.lit(0.35), F.col("project_count") * 0.035)
        + F.least(F.lit(0.2), F.col("path_count") * 0.08)
        + case([(F.col("high_paths") > 0, 0.18), (F.col("medium_paths") > 0, 0.1)], 0.0)
        + F.when(F.col("fencing_outsourcing").isin("Frequently Outsources", "Sometimes Outsources"), 0.22).otherwise(0.0)
        + F.when(F.col("company_type") == "Developer", 0.08).otherwise(0.0)
        - F.when((F.col("company_type") == "General Contractor") & (F.col("fencing_outsourcing") == "Self Performs"), 0.12).otherwise(0.0)
    )
    return out.withColumn("opportunity_likelihood", R.clamp(R.round_half_up(score, 2), 0.0, 1.0))


def behavior_counts(facts: DataFrame, key: str = "company_id") -> DataFrame:
    """Long frequency lists: (company, list, name, projects) for type, city, county and trade."""
    once = facts.select(key, "project_id", "project_type", "city", "county").distinct()
    lists = [value_counts(once, [key], c).withColumn("list", F.lit(c)) for c in ("project_type", "city", "county")]
    trades = facts.filter(F.col("trade").isin(V.BEHAVIOR_TRADES)).select(key, "project_id", "trade").distinct()
    lists.append(value_counts(trades, [key], "trade").withColumn("list", F.lit("trade")))
    return reduce(lambda a, b: a.unionByName(b), lists)


def outsourcing_map(facts: DataFrame, companies: DataFrame, key: str = "company_id") -> DataFrame:
    """MAP<trade, struct(status, evidence_count, confidence)> over the fixed trade list."""
    aggs = [F.count_distinct(F.when(F.col("trade") == t, F.col("project_id"))).alias(f"t{i}") for i, t in enumerate(V.BEHAVIOR_TRADES)]
    wide = companies.select(key, "company_type").join(facts.groupBy(key).agg(*aggs), key, "left").na.fill(0)
    conf = lambda n: F.when(n > 0, F.least(F.lit(0.85), R.round_half_up(F.lit(0.45) + n * 0.08, 2))).otherwise(F.lit(0.15))
    entries = []
    for i, t in enumerate(V.BEHAVIOR_TRADES):
        n = F.col(f"t{i}")
        entries += [F.lit(t), F.struct(outsourcing_status("company_type", n).alias("status"), n.alias("evidence_count"), conf(n).alias("confidence"))]
    return wide.select(key, "company_type", F.create_map(*entries).alias("outsourcing_by_trade"))


# AG-14
def profiles_of_type(behavior: DataFrame, company_type: str) -> DataFrame:
    return behavior.filter(F.col("company_type") == company_type)


# AG-16
def top_companies(companies: DataFrame, n: int = 20) -> DataFrame:
    return companies.orderBy(
        F.desc("project_count"), F.desc("evidence_count"), F.desc("path_count"), F.desc("fencing_signals"), F.desc("qualified"), "company_name", "company_id"
    ).limit(n)
