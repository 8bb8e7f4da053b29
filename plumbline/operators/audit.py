"""Data-quality audits (DQ-*): grouped counts and condition counters over one scan each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import contacts as C
from plumbline.functions import rules as R
from plumbline.functions.rules import ColumnOrName, case, col, matches
from plumbline.operators.aggregate import metric_rows


# DQ-01
def duplicate_groups(df: DataFrame, key: ColumnOrName) -> DataFrame:
    return df.groupBy(col(key).alias("key")).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def duplicate_audit(df: DataFrame, key: ColumnOrName) -> DataFrame:
    g = df.groupBy(col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n") > 1).alias("duplicate_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("collapsed"))


# DQ-02
def placeholder_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose JSON form, over the given columns, contains a placeholder."""
    return df.filter(C.is_placeholder(F.to_json(F.struct(*columns))))


def completeness(df: DataFrame, missing: dict[str, Column]) -> DataFrame:
    return metric_rows(df, missing)


# CL-43 / DQ-03
def awarding_authority(agency: ColumnOrName, company: ColumnOrName, role: ColumnOrName, project_type: ColumnOrName) -> Column:
    contractor = C.is_source_backed(company) & F.lower(F.coalesce(col(role), F.lit(""))).isin("contractor", "general contractor")
    return case(
        [(C.is_source_backed(agency), "Public Agency"), (contractor, "General Contractor Candidate"), (F.coalesce(col(project_type) == "Government", F.lit(False)), "Public Agency Candidate")], "Unknown")


def package_availability(trade: ColumnOrName, evidence: ColumnOrName, status: ColumnOrName, permit_status: ColumnOrName, company: ColumnOrName) -> Column:
    enough = (col(evidence) >= 2) & (col(trade) != "General")
    both = F.concat_ws(" ", col(status), col(permit_status))
    return case(
        [
            (col(status).isin("Completed", "Finaled") | matches(permit_status, "final|complete"), "Likely Awarded"),
            (C.is_source_backed(company) & matches(both, "issued|permitted|under construction"), "Likely Awarded"),
            (matches(both, "submitted|review|received|planning|proposed|approved") & enough, "Likely Available"),
        ],
        "Unknown",
    )


def trust_failures(identity: Column, location: Column, evidence: Column, contact: Column, authority: ColumnOrName, package: Column) -> Column:
    return R.labels_where(
        [
            (~identity, "Missing project identity"), (~location, "Missing usable location"), (~evidence, "Missing source evidence"), (~contact, "No actionable contact route"),
            (col(authority) == "Unknown", "Unknown awarding authority"), (~package, "Insufficient package availability evidence"),
        ])


# DQ-04
def coverage_views(df: DataFrame, missing: str = "trust_missing", authority: str = "authority") -> DataFrame:
    return metric_rows(df, {
        "visible": F.size(missing) == 0, "hidden": F.size(missing) > 0, "authority_known": F.col(authority) != "Unknown",
        "no_contact_route": F.array_contains(missing, "No actionable contact route"),
    })


# DQ-07
def repeated_candidates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("documents")).filter("documents > 1")
