"""Rule tables compiled to Column expressions.

A rule table is plain data.  ``first_match`` turns an ordered table into one CASE
expression, ``multi_label`` into an array of the labels that apply, and
``score`` into a total with the factor rows that explain it.  Everything stays
inside Catalyst, so a classifier is a projection: no shuffle, no Python worker.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def matches(c: ColumnOrName, pattern: str) -> Column:
    """Case-insensitive regex test; NULL text never matches."""
    return F.coalesce(col(c).rlike(f"(?i){pattern}"), F.lit(False))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(c: ColumnOrName, terms: Iterable[str]) -> Column:
    """Plain substring test against a term list (lower-case text expected)."""
    return any_of(F.coalesce(col(c).contains(t), F.lit(False)) for t in terms)


def case(branches: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """Ordered decision table: the first true condition gives the value."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = None
    for cond, value in branches:
        out = F.when(cond, as_col(value)) if out is None else out.when(cond, as_col(value))
    if out is None:
        return as_col(default)
    return out if default is None else out.otherwise(as_col(default))


def first_match(c: ColumnOrName, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """First (label, regex) rule that hits wins."""
    return case([(matches(c, pattern), label) for label, pattern in rules], default)


def multi_label(c: ColumnOrName, rules: Sequence[tuple[str, str]]) -> Column:
    """All labels whose regex hits, in table order."""
    return labels_where([(matches(c, pattern), label) for label, pattern in rules])


def labels_where(branches: Sequence[tuple[Column, object]]) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.array_compact(F.array(*[F.when(cond, as_col(v)) for cond, v in branches]))


def or_default(labels: Column, default: str) -> Column:
    return F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit(default)))


def hits(c: ColumnOrName, terms: Sequence[str]) -> Column:
    """Number of distinct terms that occur in the text."""
    return reduce(
        lambda a, b: a + b,
        [F.coalesce(col(c).contains(t), F.lit(False)).cast("int") for t in terms],
        F.lit(0),
    )


def clamp(c: ColumnOrName, lo: float = 0, hi: float = 100) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col(c)))


def round_half_up(c: ColumnOrName, digits: int = 0) -> Column:
    """floor(x * 10^d + 0.5) / 10^d, the rounding the scores are defined with."""
    scale = 10**digits
    out = F.floor(col(c) * F.lit(float(scale)) + F.lit(0.5))
    return out if digits == 0 else out / F.lit(float(scale))


def factor(name: str, condition: Column, points: object, reason: object = "") -> Column:
    """One explanation row, NULL when the condition does not hold."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(
        condition,
        F.struct(
            F.lit(name).alias("factor"),
            as_col(points).cast("double").alias("points"),
            as_col(reason).cast("string").alias("reason"),
        ),
    )


def score(factors: Sequence[Column], lo: float | None = 0, hi: float | None = 100) -> Column:
    """struct(score, factors): additive total, clamped, with its explanation rows."""
    rows = F.array_compact(F.array(*factors))
    total = F.aggregate(rows, F.lit(0.0), lambda acc, x: acc + x["points"])
    if hi is not None:
        total = F.least(F.lit(float(hi)), total)
    if lo is not None:
        total = F.greatest(F.lit(float(lo)), total)
    return F.struct(total.alias("score"), rows.alias("factors"))


def points(terms: Sequence[tuple[Column, object]], base: float = 0) -> Column:
    """Sum of points whose condition holds, without explanation rows."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return reduce(
        lambda acc, t: acc + F.when(t[0], as_col(t[1])).otherwise(F.lit(0)),
        terms,
        F.lit(base),
    )
