"""What counts as a wrong output row: SQL predicates, and thresholds taken once from the
original output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: A SQL predicate, a column, or a Python function of an output row.
Wrong = str | Column | Callable[[Row], bool]


def condition(out: DataFrame, wrong: Wrong) -> Column:
    """What counts as wrong as a column over out."""
    if isinstance(wrong, str):
        return F.expr(wrong)
    if isinstance(wrong, Column):
        return wrong
    make = Row(*out.columns)
    return F.udf(lambda *values: bool(wrong(make(*values))), "boolean")(*[F.col(f"`{c}`") for c in out.columns])


def at_least_max(out: DataFrame, column: str) -> Column:
    return F.col(column) >= F.lit(out.agg(F.max(column)).first()[0])


def at_most_min(out: DataFrame, column: str) -> Column:
    return F.col(column) <= F.lit(out.agg(F.min(column)).first()[0])


def nan_or_null(column: str) -> Column:
    return F.col(column).isNull() | F.isnan(F.col(column).cast("double"))


def upper_median(out: DataFrame, column: str) -> float | None:
    """The element at floor(n / 2) of the sorted values: by percentile_disc, exact and
    without collecting them."""
    n = out.where(F.col(column).isNotNull()).count()
    if not n:
        return None
    at = min(n // 2, n - 1)
    # The discrete percentile p is the value at position ceil(p * n), counted from 1.
    p = (at + 0.5) / n
    return out.where(F.col(column).isNotNull()).agg(F.expr(f"percentile_disc({p}D) WITHIN GROUP (ORDER BY {column})")).first()[0]


def beyond_sigmas(out: DataFrame, column: str, k: float) -> Column:
    """Strictly outside median +- k population standard deviations of the original output."""
    mid = upper_median(out, column)
    if mid is None:
        return F.lit(False)
    s = out.agg(F.stddev_pop(column)).first()[0] or 0.0
    return (F.col(column) < F.lit(mid - k * s)) | (F.col(column) > F.lit(mid + k * s))


def differential(out: DataFrame, right: DataFrame) -> DataFrame:
    """Output rows that the correct query doesn't produce, nulls compared as values."""
    on = None
    for c in out.columns:
        one = out[c].eqNullSafe(right[c])
        on = one if on is None else on & one
    return out.join(right.distinct(), on, "left_anti")
