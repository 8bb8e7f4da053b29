"""Record normalisers (NR-*): raw rows to typed project / permit / signal / evidence structs in one projection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import contacts as C
from plumbline.functions import text as X
from plumbline.operators.keyed import first_per_key
from plumbline.operators.relational import PAGE, attach_pages, child_pages, filter_once
from plumbline.plans import permits as P
from plumbline.plans import vocab as V


@dataclass(frozen=True)
class Source:
    """Names and defaults of one record source."""

    prefix: str
    name: str
    county: str
    state: str = "CA"
    latitude: float = 38.5816
    longitude: float = -121.4944
    url: str = ""


COUNTY_A = Source("sac", "Sacramento County Permits", "Sacramento County")
COUNTY_B = Source("placer", "Placer County Active Building Permits", "Placer County", latitude=38.8966, longitude=-121.0769)
NOTICES = Source("samgov", "SAM.gov Contract Opportunities", "Federal", state="US", url="https://sam.gov/opportunities")


def _lit(v: object) -> Column:
    return F.lit(v)


# NR-12
def contact_company(name: Column, source: Source, city: Column, kind: str, role: str, note: Column) -> Column:
    """struct of the named company, NULL for a placeholder."""
    s = F.struct(
        F.concat(_lit(f"{source.prefix}-company-"), X.slug(name)).alias("id"), F.trim(name).alias("name"), _lit(kind).alias("company_type"), city.alias("city"),
        _lit(source.state).alias("state"), note.alias("notes"), _lit(role).alias("role"))
    return F.when(C.is_source_backed(name), s)


def _normalized(df: DataFrame, source: Source, *, key: Column, external: Column, name: Column, description: Column, kind: Column, status: Column, city: Column, address: Column, lat: Column, lon: Column,
                units: Column, value: Column, url: Column, permit_type: Column, permit_status: Column, permit_date: Column, signal_type: Column, signal_text: Column, parcel: Column, jurisdiction: Column,
                importance: Column, title: Column, confidence: float, company: Column, trades: Column, windows: Column | None = None) -> DataFrame:
    pid = F.concat(_lit(f"{source.prefix}-"), key)
    part = lambda what: F.concat(_lit(f"{source.prefix}-{what}-"), key)
    return df.select(
        "seq",
        F.struct(pid.alias("id"), external.alias("external_id"), name.alias("name"), description.alias("description"), kind.alias("project_type"), status.alias("status"), city.alias("city"),
                 _lit(source.county).alias("county"), _lit(source.state).alias("state"), address.alias("address"), lat.alias("latitude"), lon.alias("longitude"), units.cast("int").alias("estimated_units"),
                 value.cast("double").alias("estimated_value"), url.alias("source_url"), _lit(source.name).alias("source_name")).alias("project"),
        F.struct(part("permit").alias("id"), external.alias("permit_number"), permit_type.alias("permit_type"), permit_status.alias("permit_status"), permit_date.alias("permit_date"),
                 value.cast("double").alias("permit_value"), url.alias("source_url")).alias("permit"),
        F.struct(part("signal").alias("id"), signal_type.alias("signal_type"), permit_date.alias("signal_date"), signal_text.alias("description"), _lit(source.name).alias("source"), external.alias("external_id"),
                 parcel.alias("parcel_number"), jurisdiction.alias("jurisdiction"), importance.cast("int").alias("importance_score")).alias("signal"),
        F.struct(part("evidence").alias("id"), _lit("source_record").alias("record_type"), external.alias("record_id"), _lit(source.name).alias("source_name"), url.alias("source_url"), title.alias("title"),
                 description.alias("summary"), _lit(confidence).alias("confidence")).alias("evidence"),
        company.alias("contact_company"), trades.alias("inferred_trades"), *([windows.alias("revenue_windows")] if windows is not None else []))


# NR-01
def normalize_permit_a(df: DataFrame, captured: str, source: Source = COUNTY_A) -> DataFrame:
    """Permit layer A; derived columns are built in stages, then one struct projection."""
    t = X.text_or
    d = df.withColumn("_issued", X.millis_to_date("issued_ms")).withColumn("_finaled", X.millis_to_date("finaled_ms"))
    d = d.withColumn("_date", F.coalesce("_issued", X.millis_to_date("applied_ms"), F.lit(captured).cast("date")).cast("string"))
    d = d.withColumn("_value", X.parse_money("valuation")).withColumn("_status", P.permit_status_a("application_status", F.col("_issued"), F.col("_finaled")))
    d = d.withColumn("_blob4", P.blob("application_type", "application_subtype", "project_name", "work_description"))
    d = d.withColumn("_trades", P.permit_trades(P.blob("application_type", "application_subtype", "project_name", "activity_code", "work_description")))
    d = d.withColumn("_desc", X.build_description("project_name", "work_description", "application_subtype", default=f"{source.county} permit record."))
    d = d.withColumn("_signal", P.signal_type_a("_blob4", "_status")).withColumn("_city", X.infer_city("address"))
    app, kind = F.col("application"), t("application_type", "Permit")
    return _normalized(
        d, source, key=F.lower(app), external=app, name=t("project_name", F.concat(kind, _lit(" at "), t("address", source.county))), description=F.col("_desc"), kind=P.project_type_a("_blob4"),
        status=F.col("_status"), city=F.col("_city"), address=t("address", f"{source.county}, {source.state}"), lat=F.coalesce("latitude", _lit(source.latitude)), lon=F.coalesce("longitude", _lit(source.longitude)),
        units=X.infer_units("project_name", "work_description"), value=F.col("_value"), url=_lit(source.url), permit_type=kind, permit_status=t("application_status", "Unknown"), permit_date=F.col("_date"),
        signal_type=F.col("_signal"), signal_text=F.concat(F.col("_signal"), _lit(f" from {source.county} permit "), app, _lit(": "), F.col("_desc")), parcel=F.nullif(t("parcel_number"), _lit("")),
        jurisdiction=_lit(source.county), importance=P.signal_importance_a("_signal", "_value", "contractor"), title=F.concat_ws(" ", app, kind), confidence=0.9,
        company=contact_company(F.col("contractor"), source, F.col("_city"), "Contractor", "contractor", F.concat(_lit(f"Contractor listed on {source.county} permit "), app, _lit("."))),
        trades=F.col("_trades"), windows=P.revenue_windows("_value", F.col("_trades")))


# NR-02
def normalize_permit_b(df: DataFrame, captured: str, source: Source = COUNTY_B) -> DataFrame:
    t = X.text_or
    d = df.withColumn("_status", P.permit_status_b("status")).withColumn("_blob", P.blob("scope", "project", "description"))
    d = d.withColumn("_desc", X.build_description("project", "description", "scope", default=f"{source.county} active building permit."))
    key = F.concat_ws("-", F.lower("number"), F.col("objectid").cast("string"))
    j = t("jurisdiction")
    city = F.when((j != "") & (j != source.county), F.regexp_replace(j, r"(?i)^City of\s+", "")).when(F.lower("address").contains("northstar"), "Truckee").otherwise(source.county)
    none = F.lit(None).cast("string")
    return _normalized(
        d, source, key=key, external=F.col("number"), name=t("project", F.concat(t("scope", "Permit"), _lit(" at "), t("address", source.county))), description=F.col("_desc"), kind=P.project_type_b("_blob"),
        status=F.col("_status"), city=city, address=t("address", f"{source.county}, {source.state}"), lat=_lit(source.latitude), lon=_lit(source.longitude), units=F.lit(None), value=F.lit(None),
        url=_lit(source.url), permit_type=t("scope", "Building Permit"), permit_status=t("status", "Active"), permit_date=_lit(captured), signal_type=P.signal_type_b(P.blob("scope", "description"), "_status"),
        signal_text=F.concat(_lit(f"{source.county} active permit "), F.col("number"), _lit(": "), F.col("_desc")), parcel=F.nullif(t("apn"), _lit("")), jurisdiction=t("jurisdiction", source.county),
        importance=P.signal_importance_b("_status", "apn", "description"), title=F.concat_ws(" ", F.col("number"), t("scope", "Building Permit")), confidence=0.82,
        company=F.struct(none.alias("name")), trades=P.permit_trades("_blob", V.PERMIT_B_TRADES))


# NR-03
def normalize_notice(df: DataFrame, captured: str, source: Source = NOTICES) -> DataFrame:
    """Bid notices; the buying agency is the company, with role developer."""
    t = X.text_or
    d = df.withColumn("_id", F.coalesce(F.nullif(t("notice_id"), _lit("")), "solicitation_number"))
    d = d.withColumn("_desc", F.concat_ws(" - ", *[F.nullif(t(c), _lit("")) for c in ("title", "notice_type", "agency_path")]))
    city = F.coalesce(X.place_field("place_json", "city.name"), X.place_field("place_json", "city"), _lit("Federal"))
    trade = P.trade_by_substring(P.blob("title", "description", "notice_type"), V.TRADE_SUBSTRINGS_NOTICE)
    note = F.concat(_lit("Buyer/agency listed on notice "), F.col("_id"), _lit("."))
    out = _normalized(
        d, source, key=X.slug("_id"), external=F.col("_id"), name=t("title", "Contract opportunity"), description=F.col("_desc"), kind=_lit("Government"), status=_lit("Permitted"), city=city,
        address=F.coalesce("place_json", _lit("Federal opportunity")), lat=_lit(source.latitude), lon=_lit(source.longitude), units=F.lit(None), value=F.lit(None), url=t("ui_link", source.url),
        permit_type=t("notice_type", "Contract Opportunity"), permit_status=t("active", "Active"), permit_date=t("posted_date", captured), signal_type=_lit("Permit"),
        signal_text=F.concat(t("notice_type", "opportunity"), _lit(" notice: "), F.col("_desc")), parcel=F.lit(None).cast("string"), jurisdiction=_lit(source.county), importance=_lit(88), title=t("title", "Contract opportunity"),
        confidence=0.88, company=contact_company(F.nullif(t("agency_path"), _lit("")), source, city, "Government buyer", "developer", note), trades=F.array(trade))
    return out


# NR-04
def normalize_generic(df: DataFrame, captured: str) -> DataFrame:
    """Generic planning rows with defaults; the signal is there only when its type is."""
    t = X.text_or
    kind = F.nullif(t("signal_type"), _lit(""))
    return df.select(
        "seq", t("name", "Unnamed project").alias("name"), t("description", "No description provided by source.").alias("description"), t("project_type", "Commercial").alias("project_type"),
        t("status", "Planning").alias("status"), t("state", "CA").alias("state"), F.coalesce(X.parse_money("estimated_value"), _lit(0.0)).alias("estimated_value"),
        F.when(kind.isNotNull(), F.array(F.struct(kind.alias("signal_type"), t("signal_date", captured).alias("signal_date"), F.coalesce(F.col("importance_score"), _lit(50)).alias("importance_score")))).alias("signals"))


# NR-05
def normalize_planning(df: DataFrame, kind: str) -> DataFrame:
    """Planning applications to planning signals; ``kind`` is a, b or major (noise rules differ)."""
    t = X.text_or
    d = df.withColumn("_blob", F.concat_ws(" ", *[t(c) for c in ("title", "description", "entitlement", "status", "address")]))
    noise = P.is_planning_noise("_blob")
    if kind == "a":
        d = d.filter(~noise)
    elif kind == "b":
        d = d.filter(~(noise & ~F.col("_blob").rlike(f"(?i){V.PLANNING_NOISE_KEEP}")))
    hint = P.package_hint("_blob")
    if kind == "major":
        hint = F.when(F.col("_blob").rlike(f"(?i){V.PLANNING_MAJOR}"), "development").otherwise(hint)
    orgs = F.filter(F.array(t("applicant"), t("owner")) if kind == "a" else F.array(t("applicant")), lambda x: (x != "") & (C.looks_like_org(x) if kind == "a" else F.lit(True)))
    about = F.concat_ws(
        " ", F.concat(F.col("title"), _lit(" is an early-stage planning record in "), F.col("jurisdiction")), F.when(t("status") != "", F.concat(_lit("("), F.col("status"), _lit(")"))),
        F.when(t("entitlement") != "", F.concat(_lit("covering "), F.regexp_replace("entitlement", r";\s*$", ""))),
        F.when(t("description") != "", F.concat(_lit("— "), X.truncate("description", 160))).otherwise(_lit("— details still thin, which often means contractors are not locked yet.")))
    return d.select(
        "seq", F.concat(_lit(f"{kind}-plan-"), X.slug(t("cap_number", F.col("title")), 80)).alias("id"), t("title", F.col("cap_number")).alias("title"), "jurisdiction",
        P.planning_stage(F.concat_ws(" ", "status", "entitlement", "description", "title")).alias("stage"), P.planning_project_type("_blob").alias("project_type"), F.array_distinct(orgs).alias("developers"),
        X.city_before_state("address").alias("city"), about.alias("summary"), P.planning_trades(F.lower("_blob")).alias("trades_likely"), hint.alias("package_hint"),
        F.nullif(t("apn"), _lit("")).alias("parcel"), F.nullif(t("planner_phone"), _lit("")).alias("contact_phone"), F.nullif(t("cap_number"), _lit("")).alias("external_id"))


def dedupe_planning(df: DataFrame) -> DataFrame:
    key = F.concat_ws("|", "jurisdiction", F.lower(F.coalesce("external_id", "title")))
    return first_per_key(df.withColumn("_k", key), ["_k"], ["seq"]).drop("_k")


# NR-06
def run_collector(raw: DataFrame, normalizer: Callable[[DataFrame], DataFrame], required: str) -> DataFrame:
    return raw.transform(normalizer).filter(F.col(required).isNotNull())


# NR-07
def explode_records(df: DataFrame) -> dict[str, DataFrame]:
    """Project, permit, signal and evidence views of normalised records."""
    link = F.col("project.id").alias("project_id")
    return {
        "projects": df.select("project.*"),
        "permits": df.select("permit.*", link, F.col("project.city").alias("city"), F.col("project.county").alias("county"), F.col("project.name").alias("project_name")),
        "signals": df.select("signal.*", link),
        "evidence": df.select("evidence.*", link),
    }


# NR-08
def project_detail(projects: DataFrame, permits: DataFrame, signals: DataFrame, companies: DataFrame, page: int = PAGE) -> DataFrame:
    """Projects with all nested children (permits newest first, signals by importance), one row per project and page of
    children; placeholder companies are left out."""
    on = ["project_id"]
    p = projects.withColumnRenamed("id", "project_id")
    real = filter_once(companies, C.is_source_backed("name"))
    lists = [
        ("permits", child_pages(permits, on, [F.desc("permit_date"), "permit_number"], ["permit_number", "permit_date"], "permits", page)),
        ("signals", child_pages(signals, on, [F.desc("importance_score"), "id"], ["signal_type", "importance_score"], "signals", page)),
        ("companies", child_pages(real, on, ["name", "role"], ["name", "role"], "companies", page, companies)),
    ]
    return attach_pages(p, lists, on)


# NR-09
def source_documents(records: DataFrame, opps: DataFrame) -> DataFrame:
    """Permit rows and opportunity rows as searchable documents; an opportunity is skipped when its permit document exists."""
    row = lambda df, did, kind, name, text: df.select(did.alias("id"), _lit(kind).alias("source_type"), name.alias("project_name"), X.clean_description(text).alias("summary"), F.concat_ws(". ", F.nullif(name, _lit("")), text).alias("full_text"))
    a = row(records, F.col("project.id"), "permit_record", F.col("project.name"), F.col("project.description"))
    b = row(opps, F.concat(_lit("opportunity-source-"), "id"), "opportunity_record", F.col("project_name"), F.col("project_description"))
    return a.unionByName(b.join(a.select("id"), "id", "left_anti"))


# NR-13
def evidence_ref(df: DataFrame, key: str, page: int = PAGE) -> DataFrame:
    """References of all evidence rows per key, in order, as label strings (one row per key and page)."""
    labelled = df.withColumn("label", F.concat_ws(": ", "source_name", "title"))
    return child_pages(labelled, [key], ["seq"], ["label"], "refs", page).withColumn("refs", F.col("refs.label"))
