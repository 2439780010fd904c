"""Small relational patterns shared by the datasets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F



def zero_fill(columns: Sequence[str], source: str | None = None) -> list[Column]:
    """Measures with 0 in place of NULL, names kept."""
    prefix = f"{source}." if source else ""
    return [F.coalesce(F.col(prefix + c), F.lit(0)).alias(c) for c in columns]


def same_key(left: str, right: str, columns: Sequence[str], *, never_null: Sequence[str] = ()) -> Column:
    """Null-safe equality of all ``columns`` of two aliased relations.

    Null-safe keys are hashed and sorted as two columns each, so those known to hold no NULL are
    compared plainly.
    """
    condition = F.lit(True)
    for c in columns:
        mine, theirs = F.col(f"{left}.{c}"), F.col(f"{right}.{c}")
        condition = condition & (mine == theirs if c in never_null else mine.eqNullSafe(theirs))
    return condition


def with_group_values(
    df: DataFrame, keys: Sequence[str], values: Mapping[str, Column]
) -> DataFrame:
    """Add per-group aggregates to every row, like a window without an order.

    Grouped with map-side combine and joined back null-safely instead of ``over(partitionBy)``: a
    group with a large share of the rows is never gathered and sorted in one task, and distinct
    counts, which windows do not offer, work the same way.
    """
    totals = df.groupBy(*keys).agg(*[v.alias(name) for name, v in values.items()])
    return df.alias("l").join(totals.alias("r"), same_key("l", "r", keys), "left").select(
        "l.*", *[F.col(f"r.{name}").alias(name) for name in values]
    )


def clone_rows(df: DataFrame, matching: Column, overrides: Mapping[str, object]) -> DataFrame:
    """All rows plus a copy of the ``matching`` ones with some columns overwritten.

    The copies are made by exploding inside the one pass, so the input is not computed twice.
    """
    copies = F.when(matching, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    doubled = df.withColumn("_copy", F.explode(copies))
    changed = [
        F.when(F.col("_copy"), F.lit(overrides[c])).otherwise(F.col(c)).alias(c) if c in overrides else F.col(c)
        for c in df.columns
    ]
    return doubled.select(*changed)


def union_by_position(first: DataFrame, *others: DataFrame) -> DataFrame:
    """UNION ALL by column position; names come from ``first`` and numeric types widen."""
    for other in others:
        first = first.union(other)
    return first


def tagged(df: DataFrame, **tags: object) -> DataFrame:
    """All columns plus literal tag columns."""
    return df.select("*", *[F.lit(v).alias(k) for k, v in tags.items()])


def keep_only(df: DataFrame, allowed: Sequence[str], *, may_lack: Sequence[str] = ()) -> DataFrame:
    """Allow-list projection: columns not named never leave the source.

    A name the source does not have is an error, unless it is listed in ``may_lack`` too.
    """
    unknown = [c for c in allowed if c not in df.columns and c not in may_lack]
    if unknown:
        raise ValueError(f"the source has no column {', '.join(unknown)}")
    return df.select(*[c for c in allowed if c in df.columns])
