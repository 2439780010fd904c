"""Distinct counts that roll up: exact bitmaps over blocks of 32,768 dense integer ids.

A distinct count cannot be added up from days to weeks or from arms to experiments; its bitmaps can. They are built
once at the finest grain, with map-side combine and without expanding rows, may be stored, and are merged by OR for
every coarser grain. A group holds one bitmap of 4 KB per block in which it has ids, however often an id stands in it,
so ids should be dense (numbered from 1, as surrogate keys are); for groups of a few scattered ids a plain distinct
count is smaller. NULL ids count as nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

BLOCK, BITS = "id_block", "id_bits"


def id_bitmaps(rows: DataFrame, keys: Sequence[str | Column], id_column: str) -> DataFrame:
    """One row per group and block of ids: the keys, ``id_block`` and ``id_bits``."""
    number = F.col(id_column).cast("bigint")
    return (
        rows.filter(number.isNotNull())
        .groupBy(*keys, F.bitmap_bucket_number(number).alias(BLOCK))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias(BITS))
    )


def rolled_up(bitmaps: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """Bitmaps of coarser groups; ``keys`` are columns of the finer ones or made from them."""
    return bitmaps.groupBy(*keys, BLOCK).agg(F.bitmap_or_agg(BITS).alias(BITS))


def distinct_ids(bitmaps: DataFrame, keys: Sequence[str | Column], name: str) -> DataFrame:
    """Number of different ids per group of ``keys``, from bitmaps of these or finer groups."""
    merged = rolled_up(bitmaps, [F.col(k) if isinstance(k, str) else k for k in keys])
    columns = [c for c in merged.columns if c not in (BLOCK, BITS)]
    return merged.groupBy(*columns).agg(F.sum(F.bitmap_count(BITS)).alias(name))
