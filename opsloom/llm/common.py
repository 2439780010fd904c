"""What several text operators share: session settings, column names, and byte-level word hashing in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom.session import prepare

#: Texts of a batch are worked on in slices of at most this many bytes (one longer text is a slice of its own).
SLICE_BYTES = 512 << 10


def ready(spark: SparkSession) -> SparkSession:
    """Library settings, and batches to Python that stay small when texts are long."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def own_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not use, upper and lower case alike."""
    used = {c.lower() for c in df.columns}
    while wanted.lower() in used:
        wanted = f"_{wanted}"
    return wanted


def widened(df: DataFrame, **columns: str) -> T.StructType:
    """The schema of ``df`` with further columns: name=type."""
    return T.StructType([*df.schema.fields, *[T.StructField(n, T._parse_datatype_string(t)) for n, t in columns.items()]])


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row exclusive, bytes, offsets) of a string column, null as empty, in bounded slices."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def _byte_values() -> np.ndarray:
    """A fixed odd-looking 64-bit value per byte; A-Z count as a-z, word separators as nothing."""
    values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    values[65:91] = values[97:123]
    values[[32, *range(9, 14)]] = 0
    return values


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a 64-bit value over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = _byte_values()
_BASE = np.uint64(0x9DDFEA08EB382D69)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base (kept, as they are the same for every slice)."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 2 * len(_powers)), _BASE, np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers[:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased: (hash of each word, offsets of words per text)."""
    values = BYTE_VALUES[data]
    inside = values != 0
    begins = inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1]
        at = offsets[:-1][offsets[:-1] < len(data)]
        begins[at] = inside[at]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    length = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, length)
    hashes = np.add.reduceat(values[starts[0] :] * powers(int(length.max()))[place], starts - starts[0])
    return mixed(hashes), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, ends: np.ndarray, size: int) -> list[np.ndarray]:
    """Per text its sorted distinct hashes of ``size`` consecutive words; all words as one when there are fewer."""
    factors = mixed(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    n = len(words) - size + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        rolled += words[k : k + n] * factors[k]
    rolled = mixed(rolled)
    found = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if b - a >= size:
            found.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            short = (words[a:b] * factors[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            found.append(mixed(np.array([short], np.uint64)))
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def summed_cells(parts: DataFrame, cells: int) -> np.ndarray:
    """Sum of rows (cell, value) as one array. ``cells`` is a parameter, so what reaches the driver is bounded."""
    total = np.zeros(cells, np.int64)
    rows = parts.groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    total[rows["cell"].to_numpy()] = rows["value"].to_numpy()
    return total


def cell_batches(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The cells of one task that are not zero, for ``summed_cells``."""
    at = np.flatnonzero(total)
    for k in range(0, len(at), 1 << 16):
        part = at[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(total[part], pa.int64())], ["cell", "value"])
