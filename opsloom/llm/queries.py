"""One query per operator of this folder, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm.alignment import aligned_tokens
from opsloom.llm.archives import read_arc, read_warc, write_arc, write_warc
from opsloom.llm.benchmarks import decontaminate
from opsloom.llm.bpe import bpe_encode
from opsloom.llm.common import table
from opsloom.llm.conversations import repair_conversations
from opsloom.llm.exact import exact_groups
from opsloom.llm.fingerprints import edited_fingerprints
from opsloom.llm.licences import scan_licences
from opsloom.llm.mixing import mix_sizes
from opsloom.llm.ngrams import near_components
from opsloom.llm.personal import find_personal
from opsloom.llm.quality import with_quality
from opsloom.llm.substrings import remove_repeats
from opsloom.session import fresh_dir


def vocabulary(spark: SparkSession, name: str = "word_bpe_49k.json") -> str:
    """A public vocabulary; the session's ``opsloom.tokenizers`` names the folder where it lies elsewhere."""
    folder = spark.conf.get("opsloom.tokenizers", None)
    return os.path.join(folder, name) if folder else public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(spark)).drop("text")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = with_quality(docs.select("doc_id", "text"), labels)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("removed")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mix_sizes(table(spark, sf_dir, "documents"))
    return drawn.select("doc_id", "size", "source_size", "target", (F.size("draws") * F.col("size")).alias("taken"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, folder = table(spark, sf_dir, "pages"), fresh_dir(spark, f"warc-{uuid.uuid4().hex[:6]}")
    write_arc(pages, f"{folder}/arc")
    write_warc(read_arc(spark, f"{folder}/arc"), f"{folder}/warc", least_bytes=0)
    return read_warc(spark, f"{folder}/warc").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return aligned_tokens(docs, vocabulary(spark, "byte_bpe_50k.json"), vocabulary(spark, "piece_bpe_32k.model"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).drop("text", "hits")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_bpe, op3_quality, op4_licences, op5_ngram_join, op6_suffix_dedup, op7_mixing, op8_fingerprints, op9_warc, op10_personal, op11_alignment,
                                    op12_decontamination, op13_conversations)}

ORACLES = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    # windows of up to ten words per place of a document, looked up among the items' windows of the same length
    "op12_decontamination": r"""
        WITH words AS (
            SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
            UNION ALL
            SELECT 'b', item_id, row_number() OVER (), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
        places AS (SELECT kind, id, r, unnest(w) AS word, generate_subscripts(w, 1) AS pos, len(w) AS n FROM words),
        tens AS (SELECT kind, id, r, pos, n, list(word) OVER (PARTITION BY kind, r ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ten FROM places),
        windows AS (SELECT DISTINCT id AS item_id, array_to_string(ten, ' ') AS win, len(ten) AS size FROM tens WHERE kind = 'b' AND (len(ten) = 10 OR pos = 1)),
        sizes AS (SELECT DISTINCT size FROM windows),
        found AS (
            SELECT t.r, t.pos, s.size, w.item_id FROM tens t JOIN sizes s ON len(t.ten) >= s.size
            JOIN windows w ON w.size = s.size AND w.win = array_to_string(t.ten[1:s.size], ' ') WHERE t.kind = 'd'),
        hit AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT DISTINCT r, unnest(range(pos, pos + size)) AS place FROM found) GROUP BY r),
        items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY r)
        SELECT id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(listed, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM words LEFT JOIN hit USING (r) LEFT JOIN items USING (r) WHERE kind = 'd'""",
}
