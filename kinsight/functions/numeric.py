"""Exact arithmetic helpers. Scores are decimals; they are rounded once, half away from zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_if(condition: Column) -> Column:
    """Conditional count that stays a plain hash aggregate (0 for empty or NULL)."""
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("bigint")


def count_where(name: str, condition: str) -> Column:
    """``count_if`` from SQL text, named."""
    return F.expr(f"coalesce(sum(CASE WHEN {condition} THEN 1 ELSE 0 END), 0L) AS {name}")


def ratio(numerator: Column, denominator: Column, digits: int | None = None) -> Column:
    """numerator / denominator as an exact decimal, NULL when the denominator is 0."""
    value = F.try_divide(numerator.cast("decimal(18,0)"), denominator.cast("decimal(18,0)"))
    return value if digits is None else F.round(value, digits)


def ordinal(value: Column, order: tuple[str, ...]) -> Column:
    """Position of ``value`` in ``order``; anything else sorts with the last entry."""
    rank = F.lit(len(order))
    for i, name in reversed(list(enumerate(order[:-1], start=1))):
        rank = F.when(value == name, F.lit(i)).otherwise(rank)
    return rank
