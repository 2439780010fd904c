"""Mixing sources to target weights with a splitting tree of block quotas.

Every source is cut into blocks of rows by a hash of doc_id. A source that is to give ``r`` times its size gives all
its blocks ``floor(r)`` times and, once more, a permuted run of blocks up to the rest of its target; inside the block
where the rest ends, rows are taken, large ones first, as they fit. Which shard gets how many blocks of which source is
decided by a tree: the shards are halved again and again, and each half's share of every source's quota is one draw
from the multivariate hypergeometric distribution. A shard then takes the next blocks of each source's permuted order,
so shards are disjoint, and orders its rows by a hash.

Sizes are counted once and written with key and source; all planning reads that small table. The permutation of a
source's blocks is an affine map, so a row's place in the mix follows from its key and its source's row of the plan.

Null sources form a source of their own, the last one. Null and empty texts have size 0. Rows with the same doc_id are
drawn together; a null doc_id is not taken from the block where the rest ends. What reaches the driver is one row per
source, never anything per document.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opsloom.llm.common import own_name, text_of
from opsloom.session import settle

BLOCK_ROWS = 64
#: Blocks of a source; larger sources get larger blocks, so windows over one source's blocks stay bounded.
MOST_BLOCKS = 65536
#: Parts of a shard that tasks take one by one.
SLICES = 256


def source_targets(sizes: list[float], weights: list[float], limit: float = 3.0) -> list[float]:
    """Shares of the sum of all sizes by weight, at most ``limit`` times a source's size, the excess reshared."""
    total, targets, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = total - sum(targets[i] for i in range(len(sizes)) if i not in open_)
        weight = sum(weights[i] for i in open_)
        share = {i: left * weights[i] / weight for i in open_}
        over = {i for i in open_ if share[i] > limit * sizes[i]}
        for i in over or open_:
            targets[i] = limit * sizes[i] if over else share[i]
        open_ = open_ - over if over else set()
    return targets


def splitting_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources) counts that sum to ``quotas``: each half of the shards draws its share without replacement."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    total = int(quotas.sum())
    drawn, open_, take = np.zeros_like(quotas), total, total * left // shards
    for i, n in enumerate(quotas.tolist()):  # the multivariate draw, source after source
        # numpy draws from up to 10**9 items; above, the expected number is as good as the draw
        drawn[i] = rng.hypergeometric(n, open_ - n, take) if 0 < open_ < 10**9 and take else (n * take // open_ if open_ else 0)
        open_, take = open_ - n, take - int(drawn[i])
    return np.vstack([splitting_tree(drawn, left, rng), splitting_tree(quotas - drawn, shards - left, rng)])


def _sized(docs: DataFrame, text: str, source: str, names: dict[str, str]) -> DataFrame:
    """``docs`` with its sizes, and its sources as text that sorts by code point, null last."""
    words = F.regexp_count(text_of(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.withColumn(names["size"], words).withColumn(names["mix_source"], _source_of(source))


def _source_of(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("~"))


def _block(key: str, blocks: Column, factor: Column, shift: Column, seed: int) -> Column:
    """Place of a row's block in the permuted order of its source's blocks."""
    return F.pmod(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), blocks) * factor + shift, blocks)


def _mix_plan(sizes: DataFrame, weights: tuple[int, ...], limit: float, shards: int, seed: int) -> DataFrame:
    """One row per source from ``sizes`` (key, source, size): what it gives and where its blocks go."""
    spark = sizes.sparkSession
    found = sizes.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    found = sorted(found, key=lambda r: r["source"])  # "=" before "~": the null source is last; Python compares code points
    targets = source_targets([r["s"] for r in found], [weights[i % len(weights)] for i in range(len(found))], limit)
    rng, rows = np.random.default_rng(seed), []
    for r, target in zip(found, targets):
        ratio = target / r["s"] if r["s"] else 0.0
        passes = min(int(math.floor(ratio + 1e-12)), int(limit))
        blocks = max(1, min(MOST_BLOCKS, math.ceil(r["n"] / BLOCK_ROWS)))
        factor = next(f for f in rng.integers(1, blocks + 1, 1000).tolist() + [1] if math.gcd(f, blocks) == 1)
        rows.append((r["source"], int(r["s"]), float(target), passes, float(target - passes * r["s"]), blocks, factor, int(rng.integers(blocks))))
    plan = spark.createDataFrame(rows, "source string, source_size long, target double, passes int, rest double, blocks long, factor long, shift long")
    plan = settle(plan, "mix-sources")
    # the block where the rest of each source ends: cumulated sizes of its blocks, in permuted order
    placed = sizes.join(plan.select("source", "rest", "blocks", "factor", "shift"), "source")
    placed = placed.withColumn("rank", _block("key", F.col("blocks"), F.col("factor"), F.col("shift"), seed))
    upto = F.sum("s").over(Window.partitionBy("source").orderBy("rank"))
    by_block = placed.groupBy("source", "rank").agg(F.sum("size").alias("s"), F.first("rest").alias("rest")).withColumn("upto", upto)
    edge = by_block.where("upto > rest").groupBy("source").agg(F.min(F.struct("rank", F.expr("rest - (upto - s)").alias("room"))).alias("e"))
    edge = settle(edge.select("source", F.col("e.rank").alias("edge"), F.col("e.room").alias("room")), "mix-edges")
    # rows of that block, large ones first, each as long as it still fits: one block a source, of bounded size
    rows_there = placed.join(edge.where("room > 0"), "source").where("rank = edge").groupBy("source", "key", "room").agg(F.sum("size").alias("s"))
    largest = F.sort_array(F.collect_list(F.struct("s", "key")), asc=False)
    empty = F.struct(F.col("room").alias("room"), F.slice(F.col("rows.key"), 1, 0).alias("taken"))
    fitted = F.aggregate("rows", empty, lambda kept, row: F.when(
        row["s"] <= kept["room"], F.struct((kept["room"] - row["s"]).alias("room"), F.concat(kept["taken"], F.array(row["key"])).alias("taken"))).otherwise(kept))
    taken = rows_there.groupBy("source", "room").agg(largest.alias("rows")).select("source", fitted["taken"].alias("taken"))
    quota = {r["source"]: r["q"] for r in edge.select("source", F.expr("edge + cast(room > 0 as long)").alias("q")).collect()}
    quotas = np.array([r[3] * r[5] + (quota.get(r[0], r[5]) if r[4] > 0 else 0) for r in rows], np.int64)
    dealt = splitting_tree(quotas, shards, rng) if len(rows) else np.zeros((shards, 0), np.int64)
    ends = np.cumsum(dealt, axis=0)
    bounds = spark.createDataFrame([(r[0], [int(x) for x in ends[:, i]]) for i, r in enumerate(rows)], "source string, bounds array<bigint>")
    whole = plan.join(edge.drop("room"), "source", "left").join(taken, "source", "left").join(bounds, "source")
    # settled, so that its size decides whether it is broadcast
    return settle(whole.withColumn("edge", F.expr("case when rest > 0 then coalesce(edge, blocks) else 0 end")), "mix-plan")


def _drawn(docs: DataFrame, plan: DataFrame, names: dict[str, str], key: str, seed: int) -> DataFrame:
    """``docs`` with the columns of its source's plan and ``draws``."""
    mine = plan.select(*[F.col(c).alias(f"_plan_{c}") for c in plan.columns])
    full = docs.join(mine, F.col(names["mix_source"]) == F.col("_plan_source"), "left")
    full = full.withColumn("_rank", _block(key, F.col("_plan_blocks"), F.col("_plan_factor"), F.col("_plan_shift"), seed))
    fits = (F.col("_rank") == F.col("_plan_edge")) & F.coalesce(F.array_contains("_plan_taken", F.col(key)), F.lit(False))
    copies = F.col("_plan_passes") + F.when((F.col("_rank") < F.col("_plan_edge")) | fits, 1).otherwise(0)
    draws = F.transform(
        F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(i.alias("copy"), F.size(F.filter("_plan_bounds", lambda b: b <= i * F.col("_plan_blocks") + F.col("_rank"))).alias("shard")))
    return full.withColumn(names["draws"], draws)


def _sizes(docs: DataFrame, text: str, key: str, source: str, names: dict[str, str]) -> DataFrame:
    sized = _sized(docs, text, source, names)
    return settle(sized.select(F.col(key).alias("key"), F.col(names["mix_source"]).alias("source"), F.col(names["size"]).alias("size")), "mix-sizes")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: float = 3.0, shards: int = 16, seed: int = 11,
        text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """One row per row of ``docs``: its columns, ``size``, ``source_size``, ``target`` and ``draws``, an array of
    (copy, shard) with one entry for each time the mix takes it. Clashing names get a leading underscore."""
    names = {n: own_name(docs, n) for n in ("size", "source_size", "target", "draws", "mix_source")}
    plan = _mix_plan(_sizes(docs, text, key, source, names), weights, limit, shards, seed)
    drawn = _drawn(_sized(docs, text, source, names), plan, names, key, seed)
    return drawn.select(*[F.col(f"`{x}`") for x in docs.columns], names["size"], F.col("_plan_source_size").alias(names["source_size"]),
                        F.col("_plan_target").alias(names["target"]), names["draws"])


def mix_sizes(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: float = 3.0, shards: int = 16, seed: int = 11,
              text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """What ``mix`` says of each row without the row itself: key, size, source_size, target and draws. Texts are read once."""
    names = {n: own_name(docs, n) for n in ("size", "draws", "mix_source")}
    sizes = _sizes(docs, text, key, source, names)
    drawn = _drawn(sizes.withColumnRenamed("source", names["mix_source"]), _mix_plan(sizes, weights, limit, shards, seed), names, "key", seed)
    return drawn.select(F.col("key").alias(key), "size", F.col("_plan_source_size").alias("source_size"), F.col("_plan_target").alias("target"), F.col(names["draws"]).alias("draws"))


def mixed_rows(docs: DataFrame, shards: int = 16, seed: int = 11, text: str = "text", key: str = "doc_id", source: str = "source",
               weights: tuple[int, ...] = (1, 2, 3), limit: float = 3.0) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each time it is taken, dealt to shards and shuffled there.

    A shard is dealt over ``SLICES`` parts by a hash, so that tasks stay small whatever the number of shards.
    """
    names = {n: own_name(docs, n) for n in ("size", "draws", "mix_source", "draw")}
    plan = _mix_plan(_sizes(docs, text, key, source, names), weights, limit, shards, seed)
    drawn = _drawn(docs.withColumn(names["mix_source"], _source_of(source)), plan, names, key, seed)
    at = names["draw"]
    out = drawn.select(*[F.col(f"`{x}`") for x in docs.columns], F.explode(names["draws"]).alias(at))
    order = F.xxhash64(F.lit(seed), F.col(key), F.col(f"{at}.copy"))
    out = out.repartition(F.col(f"{at}.shard"), F.pmod(order, F.lit(SLICES))).sortWithinPartitions(F.col(f"{at}.shard"), order)
    return out.select(*[F.col(f"`{x}`") for x in docs.columns])
