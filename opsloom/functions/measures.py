"""Conditional aggregates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TOP_TWO = (4, 5)
SCORES = (5, 4, 3, 2, 1)


def count_when(condition: Column, value: Column | None = None) -> Column:
    """Rows where ``condition`` holds (and ``value``, if given, is not NULL)."""
    return F.count(F.when(condition, F.lit(1) if value is None else value))


def sum_when(condition: Column, value: Column) -> Column:
    """Sum of ``value`` where ``condition`` holds; 0 when rows exist but none match."""
    return F.sum(F.when(condition, value).otherwise(F.lit(0)))


def avg_when(condition: Column, value: Column) -> Column:
    return F.avg(F.when(condition, value))


def distinct_when(condition: Column, value: Column) -> Column:
    return F.count_distinct(F.when(condition, value))


def share(part: Column, whole: Column) -> Column:
    """Ratio that is NULL for a zero denominator."""
    return F.try_divide(part, whole)


def score_histogram(score: Column, prefix: str) -> list[Column]:
    """Responses, top-two box and one count per score, named ``<prefix>_...``."""
    return [
        F.count(score).alias(f"{prefix}_responses"),
        count_when(score.isin(list(TOP_TWO))).alias(f"{prefix}_top2"),
        *[count_when(score == s).alias(f"{prefix}_{s}") for s in SCORES],
    ]


def histogram_names(prefix: str) -> list[str]:
    return [f"{prefix}_responses", f"{prefix}_top2", *[f"{prefix}_{s}" for s in SCORES]]


def top_two_rate(score: Column, scope: Column | None = None) -> Column:
    """Top-two answers over all answers, within ``scope``."""
    top = score.isin(list(TOP_TWO))
    if scope is None:
        return share(count_when(top), F.count(score))
    return share(count_when(scope & top), count_when(scope, score))
