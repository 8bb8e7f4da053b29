"""Registry of queries bound to the shared tables, each with an optional SQL check.

``Tables`` resolves a table or a derived view lazily.  A derived view is one
portable SELECT over the given tables (see ``views.py``); Spark runs it with the
tables bound by name, and the SQL check prepends the same SELECT as a CTE, so
both sides start from identical rows and only the operator differs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.catalog import views

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Attribute access to the given tables and the derived views."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in views.VIEWS:
            sql = views.VIEWS[name]("spark")
            needed = referenced(sql)
            return self.spark.sql(as_template(sql, needed), **{n: getattr(self, n) for n in needed})
        raise AttributeError(name)


def referenced(sql: str) -> list[str]:
    """Tables and views a statement reads: the names after FROM / JOIN."""
    names = dict.fromkeys(re.findall(r"(?i)\b(?:from|join)\s+([a-z_]+)\b", sql))
    return [n for n in names if n in BASE_TABLES or n in views.VIEWS]


def as_template(sql: str, names: list[str]) -> str:
    """Escape braces, then mark each table so ``spark.sql`` binds the DataFrame."""
    out = sql.replace("{", "{{").replace("}", "}}")
    for n in names:
        out = re.sub(rf"(?i)\b(from|join)\s+{n}\b", rf"\1 {{{n}}}", out)
    return out


def with_views(sql: str) -> str:
    """Prepend the derived views a check reads, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for n in referenced(text):
            if n in views.VIEWS and n not in order:
                visit(views.VIEWS[n]("duckdb"))
                order.append(n)

    visit(sql)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS (\n{views.VIEWS[n]('duckdb')}\n)" for n in order)
    body = sql.strip()
    if re.match(r"(?i)with\s+recursive\b", body):
        return f"WITH RECURSIVE {ctes},\n{re.sub(r'(?i)^with\s+recursive', '', body)}"
    if re.match(r"(?i)with\b", body):
        return f"WITH {ctes},\n{re.sub(r'(?i)^with', '', body)}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None):
    """Register ``fn(t: Tables) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


# --- helpers for writing the SQL checks -------------------------------------------------

def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_first(expr: str, rules, default: str | None = None) -> str:
    """(label, regex) table -> CASE with RE2 matching, ignoring case."""
    whens = " ".join(f"WHEN regexp_matches({expr}, {q(p)}, 'i') THEN {q(l)}" for l, p in rules)
    return f"CASE {whens} {'ELSE ' + q(default) if default is not None else ''} END"


def sql_multi(expr: str, rules) -> str:
    parts = ", ".join(f"CASE WHEN regexp_matches({expr}, {q(p)}, 'i') THEN {q(l)} END" for l, p in rules)
    return f"concat_ws('|', {parts})"


def sql_hits(expr: str, terms) -> str:
    return "(" + " + ".join(f"CAST(contains({expr}, {q(t)}) AS INT)" for t in terms) + ")"


def rx(expr: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({expr}, {q(pattern)}, 'i'), false)"
