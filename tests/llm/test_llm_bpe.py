"""The word encoder against the tokenizers library on every assigned character, and the registered query."""

import hashlib
import json
import random
import unicodedata

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from opsloom.llm import bpe, queries
from opsloom.llm.common import ready

PATH = public_tokenizers.path("word_bpe_49k.json")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pair():
    source = bpe.read_source(PATH)
    return bpe.Tokenizer(json.loads(source), *bpe.newer_characters(source)), Tokenizer.from_file(PATH)


def test_every_character_alone_and_between_letters(pair):
    own, library = pair
    texts = [f"{c} a{c}b 1{c}{c}2" for c in map(chr, range(1, 0x32000)) if not 0xD800 <= ord(c) < 0xE000]
    wrong = [t for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)) if own.encode(t) != e.ids]
    assert not wrong, [hex(ord(t[0])) for t in wrong[:20]]


def test_random_texts_over_assigned_characters(pair):
    own, library = pair
    rng = random.Random(3)
    assigned = [chr(c) for c in range(1, 0x20000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co") and not unicodedata.combining(chr(c))]
    texts = ["".join(rng.choices(assigned, k=20)) for _ in range(5000)] + ["".join(rng.choices("abcdeéßñ日 's.!?0123<|>\n\t\x1c", k=30)) for _ in range(5000)]
    wrong = [t for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)) if own.encode(t) != e.ids]
    assert not wrong, wrong[:5]


def test_long_words_take_time_in_proportion(pair):
    own, library = pair
    for text in ("x" * 50_000, "ab" * 20_000, "é" * 20_000, "!" * 20_000, "<|endoftext|>" * 500):
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_words_of_letters_need_no_pattern_and_share_their_numbers(pair):
    _, library = pair
    own = bpe.Tokenizer(json.loads(bpe.read_source(PATH)))
    text = "visitqq größer visitqq ñandú"
    want = library.encode(text, add_special_tokens=False).ids
    own.words = own.split_words = None  # would fail if they were asked
    assert own.encode(text) == want and own.encode(text) == want
    assert {type(i) for ids in own.known.values() for i in ids} == {int} and set(own.known) == set(text.split())


def test_words_kept_are_bounded_in_number_and_size(pair):
    _, library = pair
    own = bpe.Tokenizer(json.loads(bpe.read_source(PATH)), kept_words=20)
    for k in range(0, 400, 40):
        text = " ".join(f"qq{i},x" for i in range(k, k + 40)) + " " + "日本" * 500 + f"{k}"
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
        held = [*own.known, *own.older]
        assert len(held) <= 4 * 20 * 3 and max(map(len, held)) <= bpe.KEPT_SIZE


def test_registered_query(spark, pair):
    _, library = pair
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.op2_bpe(spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_encode_stage_leaves_no_words_in_the_workers(spark):
    """Python workers outlive the stage; what it learned must not stay in them."""
    docs = ready(spark).createDataFrame([(i, "s", f"qqvisit{i} left behind") for i in range(64)], "doc_id long, source string, text string").repartition(8)
    want = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in bpe.bpe_encode(docs, PATH).collect()}

    def held(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(w.startswith("qqstage") for t in bpe._built.values() for words in (t.known, t.older) for w in words)])], ["n"])

    other = docs.withColumn("text", F.regexp_replace("text", "qqvisit", "qqstage"))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.encode(spark, docs, "").collect()}
    assert got == want and len(corpus_pipeline.encode(spark, other, "").collect()) == 64
    assert docs.mapInArrow(held, "n long").agg(F.sum("n")).first()[0] == 0
