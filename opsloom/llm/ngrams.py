"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document is the set of its five-word shingles. All documents' shingles are counted in a sketch of ``CELLS`` cells, and
each set is ordered by that count, rare first: any order that is the same for all sets keeps prefix filtering exact. Two
sets of Jaccard 0.8 or more share a shingle of their prefixes (the first fifth). Documents with equal sets form one
class, and only the class joins, under a number of its own: a doc_id may name several classes.

Links are wanted, not pairs. So a prefix shingle first links its holders to one of them (a star), verified on the whole
sets; a shingle whose holders are then all in one component is done. After ``STARS`` such rounds, with another centre
each time, the shingles that still join different components give all their pairs across components. No link is lost:
every pair that shares a prefix shingle is either in one component already or verified.

Candidates pass the length filter and the positional filter in the join, and for all pairs a bitmap filter as well (one
parity bit per hash bucket: the bits in which two sets differ are at most the shingles in which they do); then the
suffix filter (counts of the rest of both sets by hash range bound their difference), and are verified once per pair.
A shingle with many open holders is dealt over several tasks. Near texts share most of their prefix, so of all pairs
only those are put out that share none of the first ``EARLIER`` open shingles of both before the one they meet at: the
shingle they share first has them as well, and there the positional filter may take the shingles before it as different.

Null, empty and wordless texts have no shingles and link with nothing. Rows with shingles and the same doc_id count as
one document for links; all rows are returned. Documents of fewer than five words are one shingle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.common import cell_batches, shingle_hashes, slices, summed_cells, word_hashes
from opsloom.llm.exact import maybe_repeated, repeated_blocks
from opsloom.session import settle

#: Cells of the sketch of shingle counts (2 MB on the driver, whatever the input).
CELLS = 1 << 18
STARS = 2
#: Long values of the bitmap, 64 parity bits each, and open holders of a shingle that one task pairs with all others.
BITMAP = [f"s{i}" for i in range(8)]
PAIRED = 512
#: Of the open shingles before one in its prefix, so many go with it (the rarest) to tell whether a pair has met before.
EARLIER = 8


def _sets(batch: pa.RecordBatch, column: int, size: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    for first, last, data, offsets in slices(batch.column(column)):
        yield first, last, shingle_hashes(*word_hashes(data, offsets), size)


def _digest(found: np.ndarray) -> str:
    return hashlib.blake2b(found.tobytes(), digest_size=16).hexdigest()


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - 18)).astype(np.int64)


def shingle_counts(docs: DataFrame, size: int) -> np.ndarray:
    """Sketch: number of documents per cell of shingle hashes, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for _, _, sets in _sets(batch, 0, size):
                total += np.bincount(_cell(np.concatenate(sets)), minlength=CELLS)
        yield from cell_batches(total)

    return summed_cells(docs.select("text").mapInArrow(run, "cell long, value long"), CELLS)


def _ranges(hashes: np.ndarray) -> np.ndarray:
    """Counts by hash range, about eight shingles a range, saturated (which only weakens the filter)."""
    ranges = 1 << max(len(hashes) // 8, 1).bit_length() - 1
    return np.minimum(np.bincount((hashes >> np.uint64(32)).astype(np.int64) * ranges >> 32, minlength=ranges), 255).astype(np.uint8)


def _parities(hashes: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles per hash bucket, as 64-bit values."""
    odd = np.bincount((hashes >> np.uint64(8)).astype(np.int64) & (64 * len(BITMAP) - 1), minlength=64 * len(BITMAP)) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def range_difference(a: bytes, b: bytes) -> int:
    """Lower bound of the size of the symmetric difference, from counts by hash range."""
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    while len(x) > len(y):
        x = x.reshape(-1, 2).sum(1) if x.max(initial=0) < 255 else np.zeros(len(y), np.int64)
    while len(y) > len(x):
        y = y.reshape(-1, 2).sum(1) if y.max(initial=0) < 255 else np.zeros(len(x), np.int64)
    full = (x >= 255) | (y >= 255)
    return int(np.abs(x - y)[~full].sum())


def prefixes(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Per document: n (size of its set), digest of the set, prefix (rare-first shingles), ranges."""
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, sets in _sets(batch, 1, size):
                rows = []
                for found in sets:
                    n = len(found)
                    keep = n - (percent * n + 99) // 100 + 1 if n else 0
                    rare = np.argsort(counts.value[_cell(found)], kind="stable")[:keep]  # ties by hash
                    rows.append((n, _digest(found), found[rare].view(np.int64), _ranges(found).tobytes(), _parities(found)))
                n, digests, prefix, ranges, parities = zip(*rows)
                lengths = np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(prefix)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(n, pa.int64()), pa.array(digests), listed, pa.array(ranges, pa.binary()), *map(pa.array, np.stack(parities).T)],
                                                 ["doc_id", "n", "digest", "prefix", "ranges", *BITMAP])

    return docs.mapInArrow(run, "doc_id long, n long, digest string, prefix array<bigint>, ranges binary, " + ", ".join(f"{s} long" for s in BITMAP))


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of edges (a, b): root is the smallest vertex reachable.

    Alternates large-star and small-star steps until nothing changes; every step is a grouped minimum and a join on
    vertices, written to the shared folder. What does not change any more is a star per component. Steps are compared by
    their number of edges and two 64-bit checksums.
    """

    def state(step: DataFrame) -> tuple:
        return tuple(step.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "u")), F.bit_xor(F.xxhash64("u", "v", F.lit(1)))).first())

    current = settle(edges.where("a != b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges")
    before = state(current)
    while before[0]:
        both = current.unionByName(current.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v != u").distinct()
        # small star: of the edges to smaller vertices, all hang on the smallest
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u")).where("v != u").distinct()
        current = settle(small, "edges")
        after = state(current)
        if after == before:
            break
        before = after
    return current.select("v", F.col("u").alias("root"))


def _whole_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(digest, found) of the documents in ``ids``. A bitmap of the ids keeps other documents' texts from shuffling."""
    total = ids.count()
    blocks, bits = repeated_blocks(ids.select(F.col("doc_id").alias("key")).union(ids.select("doc_id")), total)
    likely = maybe_repeated(docs, "doc_id", blocks, bits, "_likely").where("_likely").select("doc_id", "text").join(ids, "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, sets in _sets(batch, 1, size):
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.string()), pa.array([s.tobytes() for s in sets], pa.binary())], ["digest", "found"])

    return likely.mapInArrow(run, "digest string, found binary")


def verified(docs: DataFrame, pairs: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach ``percent`` per cent; suffix filter first, then the sets themselves."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y, nx, ny = (batch.column(i).to_pylist() for i in range(6))
            keep = [(100 + percent) * range_difference(p, q) <= (100 - percent) * (i + j) for p, q, i, j in zip(x, y, nx, ny)]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, k in zip(a, keep) if k], pa.int64()), pa.array([v for v, k in zip(b, keep) if k], pa.int64())], ["a", "b"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for a, b, x, y in zip(*(batch.column(i) for i in range(4))):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * shared >= percent * (len(s) + len(t) - shared):
                    kept.append((a.as_py(), b.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.int64())], ["a", "b"])

    x, y = reps.select(F.col("class").alias("a"), F.col("ranges").alias("x"), F.col("n").alias("nx")), reps.select(F.col("class").alias("b"), F.col("ranges").alias("y"), F.col("n").alias("ny"))
    near_pairs = settle(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y", "nx", "ny").mapInArrow(near, "a long, b long"), "near")
    ids = settle(near_pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(reps.select("class", "doc_id", "digest"), "class"), "ids")
    sets = _whole_sets(docs, ids.select("doc_id").distinct(), size).dropDuplicates(["digest"])
    found = settle(sets.join(ids.select("class", "digest"), "digest").select("class", "found"), "sets")
    s, t = found.select(F.col("class").alias("a"), F.col("found").alias("x")), found.select(F.col("class").alias("b"), F.col("found").alias("y"))
    return near_pairs.join(s, "a").join(t, "b").select("a", "b", "x", "y").mapInArrow(exact, "a long, b long")


def _fits(percent: int, n: str, place: str, n2: str, place2: str, before: str) -> str:
    """Length and positional filter of two sets that share a shingle and at most ``before`` shingles ahead of it."""
    return (f"100 * least({n}, {n2}) >= {percent} * greatest({n}, {n2}) and"
            f" ({100 + percent}) * ({before} + least({n} - {place}, {n2} - {place2})) >= {percent} * ({n} + {n2})")


def met_across(rows: DataFrame, open_: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes of different components that share an open shingle and pass the filters.

    A pair is met at the first open shingle that both share, and at a later one only if ``EARLIER`` open shingles do
    not reach back to the first.
    """
    differ = " + ".join(f"bit_count({s} ^ other.{s})" for s in BITMAP)
    alike = f"{100 + percent} * ({differ}) <= {100 - percent} * (n + n2)"
    before = "least(rank, rank2, rank - size(early) + rank2 - size(early2))"  # shared ones that the arrays do not tell
    live = rows.join(open_.select("token", F.expr(f"holders div {PAIRED}").alias("parts")), "token")
    live = live.groupBy("class", "n", "root").agg(F.array_sort(F.collect_list(F.struct("place", "token", "parts"))).alias("open"))  # at most a prefix
    live = (live.join(reps.select("class", *BITMAP), "class").select("*", F.slice("open.token", 1, EARLIER).alias("early"), F.posexplode("open").alias("rank", "o"))
            .select("class", "n", "root", *BITMAP, "rank", "o.*", F.expr(f"slice(early, 1, least(rank, {EARLIER}))").alias("early")))
    mine = live.withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts") + 1))
    other = live.select("token", F.explode(F.sequence(F.lit(0).cast("long"), "parts")).alias("part"), F.col("class").alias("d2"), F.col("n").alias("n2"),
                        F.col("place").alias("p2"), F.col("root").alias("r2"), F.col("rank").alias("rank2"), F.col("early").alias("early2"), F.struct(*BITMAP).alias("other"))
    met = mine.join(other, (mine["token"] == other["token"]) & (mine["part"] == other["part"]) & F.expr("root < r2")
                    & F.expr(_fits(percent, "n", "place", "n2", "p2", before)) & F.expr(alike) & F.expr("not arrays_overlap(early, early2)"))
    return met.select(F.least("class", "d2").alias("a"), F.greatest("class", "d2").alias("b"))


def near_components(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    made = settle(prefixes(docs, size, percent), "prefixes")
    known = made.where("doc_id is not null and n > 0")
    # classes: one per distinct set, grouped with the sets' prefixes so that equal ones merge per task, numbered as written
    reps = known.groupBy("digest").agg(F.min_by(F.struct("doc_id", "n", "prefix", "ranges", *BITMAP), "doc_id").alias("r")).select("digest", "r.*")
    reps = settle(reps.withColumn("class", F.monotonically_increasing_id()), "classes")
    entries = reps.select("class", "n", F.posexplode("prefix").alias("place", "token")).repartition("token")
    shared = entries.groupBy("token").agg(F.count("*").alias("holders")).where("holders > 1").select("token")
    held = settle(entries.join(shared, "token"), "held")  # one shuffle by token serves both sides
    # equal doc_ids with different texts are one document: their classes are linked
    several = known.groupBy("doc_id").agg(F.min("digest").alias("d0"), F.max("digest").alias("d1")).where("d0 != d1").select("doc_id")
    owned = settle(known.join(several, "doc_id").select("doc_id", "digest").distinct().join(reps.select("digest", "class"), "digest").select("doc_id", "class"), "owned")
    edges = owned.join(owned.groupBy("doc_id").agg(F.min("class").alias("b")), "doc_id").select(F.col("class").alias("a"), "b")
    tried = None
    roots = components(edges)

    def labelled() -> DataFrame:
        return held.join(roots.withColumnRenamed("v", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))

    for turn in range(STARS + 1):
        rows = labelled()
        open_ = rows.groupBy("token").agg(F.count("*").alias("holders"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.min_by(F.struct("class", "n", "place", "root"), F.xxhash64("class", F.lit(turn))).alias("centre")).where("r0 != r1")
        if turn < STARS:
            pairs = (rows.join(open_.select("token", "centre"), "token").where("root != centre.root").where(_fits(percent, "n", "place", "centre.n", "centre.place", "least(place, centre.place)"))
                     .select(F.least("class", "centre.class").alias("a"), F.greatest("class", "centre.class").alias("b")))
        else:
            pairs = met_across(rows, open_, reps, percent)
        pairs = pairs.distinct()
        pairs = settle(pairs.join(tried, ["a", "b"], "left_anti") if tried is not None else pairs, "pairs")
        if pairs.isEmpty():
            continue
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = settle(verified(docs, pairs, reps, size, percent), "links")
        roots = components(links.unionByName(roots.select(F.col("v").alias("a"), F.col("root").alias("b"))))
    rooted = settle(reps.select("digest", "doc_id", "class").join(roots.withColumnRenamed("v", "class"), "class", "left").select("digest", "doc_id", F.coalesce("root", "class").alias("root")), "rooted")
    found = settle(rooted.join(rooted.groupBy("root").agg(F.min("doc_id").alias("component")), "root").select("digest", "component"), "found")
    return made.join(found, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
