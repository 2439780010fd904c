"""Exact dedup by two-pass Bloom filtering, with DataFrame functions only.

First pass: every text sets ``PROBES`` positions of a bit space that its hash names; the positions that were set at
least twice are kept as bitmaps. Second pass: a text all of whose positions were set twice may have an equal; only
such rows shuffle, grouped by SHA-256. All other rows are certainly alone and pass straight through.

The bit space follows the number of rows (16 bits each). Its bitmaps are broadcast while the whole space is at most
``BROADCAST_BITS`` (32 MB); beyond, the hashes are matched with them by a shuffled join, and the answers are the same.

Null texts count as empty. Rows that repeat another row altogether belong to the same group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.llm.common import own_name, text_of
from opsloom.session import settle

PROBES = 2
BITS_PER_ROW = 16
#: Bits of one bitmap row (4 KB), fixed by Spark's bitmap functions.
BLOCK = 32768
BROADCAST_BITS = 1 << 28


def _positions(key: Column, bits: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(k)), F.lit(bits)) for k in range(PROBES)])


def repeated_blocks(keys: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """Bitmaps (block, bitmap) of the positions that the column ``key`` sets twice or more, and the bits of the space."""
    bits = max(BLOCK, 1 << (max(rows, 1) * BITS_PER_ROW - 1).bit_length())
    twice = (keys.select(F.explode(_positions(F.col("key"), bits)).alias("position"))
             .groupBy("position").agg(F.count("*").alias("n")).where("n > 1"))
    blocks = (twice.groupBy(F.expr(f"position div {BLOCK}").alias("block"))
              .agg(F.expr(f"bitmap_construct_agg(position % {BLOCK})").alias("bitmap")))
    return blocks, bits


def maybe_repeated(df: DataFrame, key: str, blocks: DataFrame, bits: int, flag: str) -> DataFrame:
    """``df`` with a boolean ``flag``: false means that no other row has this key."""
    found = df
    for k in range(PROBES):
        at, mine = own_name(df, f"position{k}"), own_name(df, f"block{k}")
        side = blocks.select(F.col("block").alias(mine), F.col("bitmap").alias(f"{mine}_bits"))
        side = F.broadcast(side) if bits <= BROADCAST_BITS else side
        found = found.withColumn(at, F.pmod(F.xxhash64(F.col(key), F.lit(k)), F.lit(bits)))
        found = found.join(side, F.expr(f"`{at}` div {BLOCK}") == F.col(mine), "left")
    tests = [F.expr(f"`{mine}_bits` is not null and cast(conv(hex(substring(`{mine}_bits`, cast((`{at}` % {BLOCK}) div 8 as int) + 1, 1)), 16, 10) as int)"
                    f" & shiftleft(1, cast(`{at}` % 8 as int)) != 0")
             for at, mine in ((own_name(df, f"position{k}"), own_name(df, f"block{k}")) for k in range(PROBES))]
    return found.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(tests[0] & tests[1], F.lit(False)).alias(flag))


def _flagged(docs: DataFrame, text: str) -> tuple[DataFrame, str, str]:
    sha, flag = own_name(docs, "text_sha256"), own_name(docs, "maybe_repeated")
    # the hash of the digest, not of the text, so that both passes name positions alike
    keyed = docs.withColumn(sha, F.sha2(text_of(text).cast("binary"), 256))
    blocks, bits = repeated_blocks(keyed.select(F.col(sha).alias("key")), docs.count())
    return maybe_repeated(keyed, sha, blocks, bits, flag), sha, flag


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id (largest doc_id of the equal texts), group_size, kept, text_sha256."""
    narrow = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    flagged, sha, flag = _flagged(narrow, "text")
    flagged = flagged.select("doc_id", F.col(sha).alias("text_sha256"), F.col(flag).alias("maybe"))
    alone = flagged.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                                             F.lit(True).alias("kept"), "text_sha256")
    shared = flagged.where("maybe").select("doc_id", "text_sha256")
    # written first, so that the join shuffles two plain relations, of which Spark splits a hot text's rows
    groups = settle(shared.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"), "groups")
    joined = shared.join(groups, "text_sha256", "left").withColumns({
        "keep_id": F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})
    joined = joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return alone.unionByName(joined)


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The columns of ``docs``, one row per distinct text: that with the largest ``key``.

    Only rows that may be repeated shuffle, pre-aggregated per task, so a text that a third of all rows share reaches
    the shuffle as one row of each task.
    """
    flagged, sha, flag = _flagged(docs, text)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    shared = (flagged.where(F.col(flag)).groupBy(sha)
              .agg(F.coalesce(F.max_by(row, F.col(key)), F.first(row)).alias("kept")).select("kept.*"))
    return flagged.where(~F.col(flag)).select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(shared)
