"""Dense time panels and the window measures over them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from opsloom.functions.calendar import month_of, months_before
from opsloom.operators.generators import months_between


def month_arrays(
    sparse: DataFrame, entity: Sequence[str], month: str, measures: Sequence[str], keep: Sequence[Column],
    start: date, as_of: date,
) -> DataFrame:
    """One row per entity: for each measure an array with one element per month, NULL where the entity was silent.

    ``sparse`` has at most one row per entity and month. The active months are gathered in a map, whose
    size is bounded by the number of months in the range; one shuffle brings them together.
    """
    in_range = F.col(month).between(month_of(F.lit(start)), month_of(F.lit(as_of)))
    entry = F.when(in_range, F.struct(F.col(month).alias("k"), F.struct(*measures).alias("v")))
    entities = sparse.groupBy(*entity).agg(F.map_from_entries(F.collect_list(entry)).alias("_active"), *keep)
    found = F.transform(months_between(start, as_of), lambda m: F.try_element_at(F.col("_active"), m))
    others = [c for c in entities.columns if c != "_active"]
    arrays = entities.select(*others, found.alias("_found"))
    return arrays.select(*others, *[F.col("_found").getField(m).alias(m) for m in measures])


def dense_months(
    sparse: DataFrame, entity: Sequence[str], month: str, measures: Sequence[str], keep: Sequence[Column],
    start: date, as_of: date,
) -> DataFrame:
    """Every entity in every month of the range, measures NULL where the entity was silent.

    The months are exploded beside the entity, so the full panel is made without a cross join or a join
    and comes out partitioned by entity.
    """
    arrays = month_arrays(sparse, entity, month, measures, keep, start, as_of)
    others = [c for c in arrays.columns if c not in measures]
    panel = arrays.select(*others, *measures, F.posexplode(months_between(start, as_of)).alias("_pos", "index_month"))
    return panel.select(*others, "index_month", *[F.get(m, F.col("_pos")).alias(m) for m in measures])


def running_totals(values: Column) -> Column:
    """Totals before each element and, last, of all elements; silent elements add nothing.

    An array scan inside one row: measures over an entity's months read two of its elements instead of
    sorting and framing the exploded rows.
    """
    first = F.array(F.lit(0).cast("bigint"))
    return F.aggregate(values, first, lambda found, v: F.array_append(found, F.element_at(found, -1) + F.coalesce(v, F.lit(0))))


def through(totals: Column, pos: Column) -> Column:
    """Total of the elements up to and with ``pos``."""
    return F.get(totals, pos + 1)


def one_before(values: Column, pos: Column) -> Column:
    """Element before ``pos``; 0 where there is none or it is silent."""
    return F.coalesce(F.get(values, pos - 1), F.lit(0))


def next_elements(totals: Column, pos: Column, n: int) -> Column:
    """Total of the ``n`` elements after ``pos``, as far as there are so many."""
    return F.get(totals, F.least(pos + 1 + n, F.size(totals) - 1)) - through(totals, pos)


def elapsed(month: Column, as_of: date, n: int) -> Column:
    """Whether the whole ``n``-month horizon after a month has begun by ``as_of``."""
    return month <= months_before(month_of(F.lit(as_of)), n)


def running(value: Column, window: WindowSpec) -> Column:
    """Running total in window order; rows with equal order values share it."""
    return F.coalesce(F.sum(value).over(window), F.lit(0))


def previous(value: Column, window: WindowSpec) -> Column:
    """Value of the row before; 0 where that row is missing or silent."""
    return F.coalesce(F.lag(value, 1).over(window), F.lit(0))


def total(value: Column, keys: Sequence[str]) -> Column:
    return F.coalesce(F.sum(value).over(Window.partitionBy(*keys)), F.lit(0))


def next_rows(value: Column, window: WindowSpec, n: int) -> Column:
    """Sum over the next ``n`` rows; NULL when there are none."""
    return F.sum(value).over(window.rowsBetween(1, n))
