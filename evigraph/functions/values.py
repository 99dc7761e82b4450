"""Scalar helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def present(value: Column) -> Column:
    """Trimmed text, NULL when blank."""
    return F.nullif(F.trim(value), F.lit(""))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Six-decimal ratio, NULL when undefined."""
    return F.round(F.try_divide(numerator.cast("double"), denominator.cast("double")), 6)


def f1(precision: Column, recall: Column) -> Column:
    """Harmonic mean of two already rounded ratios."""
    total = precision + recall
    return F.when(total != 0, F.round(F.lit(2.0) * precision * recall / total, 6))


def count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def padded(prefix: str, number: Column, width: int) -> Column:
    """Zero-padded id; numbers wider than the pad keep all their digits."""
    text = number.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0")))


def contains_any(text: Column, words: list[str]) -> Column:
    """True when any word occurs as a substring."""
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def within(rows: DataFrame, number: str, limit: int | None) -> DataFrame:
    """Rows numbered up to ``limit``; all of them where no limit is asked for."""
    return rows if limit is None else rows.filter(F.col(number) <= limit)
