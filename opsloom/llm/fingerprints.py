"""Document fingerprints from spot signatures, with DataFrame functions only.

A spot is a common word (an anchor) with the chain of the next two content words after it; the fingerprint of a text is
the sorted set of its spots' 64-bit hashes, and of about ``PAIRS`` pairs of neighbouring words (all pairs of a short
text) that their first word's hash picks. The pairs stand for texts in which anchors are rare; as the share that is
picked follows the number of different words, an edit changes the set in proportion, never all of it. Fingerprints are compared by
Jaccard, pruned by set length: sets whose lengths alone exclude the wanted likeness are never laid side by side.

Null texts count as empty; an empty text has the empty fingerprint, which is like another empty one (1) and nothing
else (0). Rows that repeat a doc_id are all kept; the row after them is that of the next larger doc_id. A null doc_id is
one more id, smaller than all others: the smallest id follows it, and it follows the largest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from opsloom.llm.common import own_name, text_of
from opsloom.session import settle

#: Common words that start a spot: a few of each language of the corpus.
ANCHORS = ["the", "is", "was", "for", "with", "der", "die", "ist", "mit", "le", "la", "est", "pour", "el", "los", "con", "es"]
#: Common words that are neither anchors nor content.
SKIPPED = ["of", "and", "to", "in", "a", "that", "it", "on", "und", "das", "von", "zu", "den", "et", "les", "des", "un", "une", "en", "de", "que", "y", "las", "por"]
CHAIN = 2
#: Pairs of neighbouring words in a fingerprint, about; a shorter text has all of its own.
PAIRS = 64
#: Words after an anchor among which its chain is sought.
REACH = 8


def with_spots(df: DataFrame, text: str, spots: str) -> DataFrame:
    """``df`` and the sorted distinct hashes of the spots of a text column. One step a column, so that none is repeated."""
    t = {n: own_name(df, f"{spots}_{n}") for n in ("words", "kinds", "starts", "found")}
    words = F.col(t["words"])
    anchors, common = F.array(*map(F.lit, ANCHORS)), F.array(*map(F.lit, ANCHORS + SKIPPED))

    def spot(i: Column) -> Column:
        chain = F.slice(F.filter(F.slice(words, i + 2, F.lit(REACH)), lambda w: ~F.array_contains(common, w)), 1, CHAIN)
        return F.when(F.size(chain) == CHAIN, F.xxhash64(F.get(words, i), F.concat_ws(" ", chain)))

    kinds = F.col(t["kinds"])  # read twice, so that the optimizer does not move its computation into the loop over the words
    picked = F.transform(words, lambda w, i: F.when((kinds <= PAIRS) | (F.pmod(F.xxhash64(w), F.lit(1 << 20)) * kinds < F.lit(PAIRS << 20)), i))
    pairs = F.transform(F.filter(picked, lambda i: i.isNotNull()), lambda i: F.xxhash64(F.lit(""), F.get(words, i), F.coalesce(F.get(words, i + 1), F.lit(""))))
    out = df.withColumn(t["words"], F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+", -1), lambda w: w != ""))
    out = out.withColumn(t["kinds"], F.size(F.array_distinct(words)).cast("long"))
    out = out.withColumn(t["starts"], F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(anchors, w), i)), lambda i: i.isNotNull()))
    out = out.withColumn(t["found"], F.filter(F.transform(t["starts"], spot), lambda h: h.isNotNull()))
    out = out.withColumn(spots, F.array_sort(F.array_distinct(F.concat(F.col(t["found"]), pairs))))
    return out.drop(*t.values())


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two sets; 0 without looking inside where their lengths keep it below ``least`` or one is empty."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    return (F.when(large == 0, F.lit(1.0)).when((small == 0) | (small < F.lit(least) * large), F.lit(0.0))
            .otherwise(both / (F.size(a) + F.size(b) - both)))


def near_pairs(sets: DataFrame, least: float = 0.8, key: str = "doc_id") -> DataFrame:
    """Pairs (a, b, likeness) of different keys whose sets reach ``least``; ``sets`` has the key and ``spots``.

    Sets are partitioned by length class; a set meets only sets of its own and the next class, where length lets them
    be alike, and only through one of its rarest spots (so many that like sets must share one). Empty sets pair with none.
    """
    base = sets.where(F.size("spots") > 0).select(F.col(key).alias("k"), "spots", F.size("spots").alias("n"),
                                                  F.floor(F.log(F.size("spots").cast("double")) / F.lit(-1.0) / F.log(F.lit(least))).alias("c"))
    spots = base.select("k", "n", "c", F.explode("spots").alias("spot"))
    counts = spots.groupBy("spot").agg(F.count("*").alias("df"))
    ordered = spots.join(counts, "spot").groupBy("k", "n", "c").agg(F.array_sort(F.collect_list(F.struct("df", "spot"))).alias("o"))  # one set a group
    rare = ordered.select("k", "n", "c", F.explode(F.slice("o", F.lit(1), F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9).cast("int") + 1)).alias("x")).select("k", "n", "c", F.col("x.spot").alias("spot"))
    other = rare.select(F.col("k").alias("k2"), F.col("n").alias("n2"), F.col("c").alias("c1"), F.col("spot").alias("s2")).withColumn("c2", F.explode(F.array("c1", F.col("c1") + 1, F.col("c1") - 1)))
    pairs = rare.join(other, (F.col("c") == F.col("c2")) & (F.col("spot") == F.col("s2")) & (F.col("k") < F.col("k2")) & (F.least("n", "n2") >= F.lit(least) * F.greatest("n", "n2"))).select("k", "k2").distinct()
    a, b = base.select("k", F.col("spots").alias("a")), base.select(F.col("k").alias("k2"), F.col("spots").alias("b"))
    return pairs.join(a, "k").join(b, "k2").select(F.col("k").alias("a"), F.col("k2").alias("b"), likeness(F.col("a"), F.col("b"), least).alias("likeness")).where(F.col("likeness") >= least)


def next_keys(keys: DataFrame) -> DataFrame:
    """(doc_id, next_id) for distinct ``doc_id`` without null: the next larger one, and the smallest after the largest.

    Keys are dealt into ranges; a key's successor is found within its range, and that of a range's last key is the
    first key of the next range. The only window over all is over one row per range.
    """
    ranged = settle(keys.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "ranges")
    inside = ranged.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id")))
    firsts = ranged.groupBy("part").agg(F.min("doc_id").alias("least"))
    following = firsts.select("part", F.lead("least").over(Window.orderBy("part")).alias("after"), F.min("least").over(Window.partitionBy()).alias("first"))
    return inside.join(following, "part").select("doc_id", F.coalesce("next_id", "after", "first").alias("next_id"))


def edited_fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    base = docs.select(F.struct(F.col(key).alias("id")).alias("doc_id"), text_of(text).alias("text"))  # a struct of null is a key like others
    spotted = with_spots(base, "text", "spots")
    keys = base.select("doc_id", F.length("text").alias("n")).groupBy("doc_id").agg(F.max("n").alias("n"))
    links = settle(next_keys(keys.select("doc_id")).join(keys, "doc_id").select(F.col("doc_id").alias("of"), "next_id", "n"), "links")
    found = (links.join(spotted, links.next_id == spotted.doc_id)
             .select("of", F.struct(F.expr("substring(text, 1, cast(n div 4 as int))").alias("head"), "spots").alias("next")))
    heads = found.groupBy("of").agg(F.max("next").alias("next")).select("of", F.col("next.head").alias("head"), F.col("next.spots").alias("next_spots"))  # rows that repeat a doc_id count once as a next document
    both = spotted.join(heads, spotted.doc_id == heads.of).select("doc_id", "text", F.col("spots").alias("a"), "head", "next_spots", F.length("text").cast("long").alias("n_chars"))
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - n_chars div 4 as int))"), F.expr("substring(head, 1, cast(n_chars div 4 as int))"))
    out = with_spots(both.withColumn("edited", edited).drop("text", "head"), "edited", "b")
    named = lambda c: F.concat_ws(" ", F.transform(c, F.hex))
    return out.select(F.col("doc_id.id").alias("doc_id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), named("a").alias("fingerprint"), named("b").alias("edited_fingerprint"),
                      likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("next_spots")).alias("near_next"))
