"""Licence scan with a positional index of rare licence words, with DataFrame functions only.

Each template is a phrase of licence wording with a mandatory key phrase inside. The document frequency of every
template word is counted over all documents. A template is posted in the index under the highest-IDF word of its key
phrase and under its own highest-IDF word. A document looks up its words that have postings; a posting and the word's
place name the place where the template would start, the words around are laid against the template there, and the
label is given if the key phrase stands at its place word for word. ``score`` is the largest share of a template's
words found at their places. No row shuffles: hits stay within their document's row.

Null and empty texts have no words, no places, no labels and score 0. Every row gives one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.llm.common import own_name, text_of

#: (label, key phrase, whole phrase) of the contract, in which the whole phrase is the key phrase.
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
#: (label, mandatory key phrase, template). The key phrase stands inside the template.
TEMPLATES = [
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("apache-2", "apache license version 2", "licensed under the apache license version 2 0"),
    ("gpl-3", "gnu general public license version 3", "licensed under the gnu general public license version 3"),
    ("gpl", "gnu general public license", "this work is licensed under the gnu general public license"),
    ("lgpl", "gnu lesser general public license", "licensed under the gnu lesser general public license"),
    ("mpl-2", "mozilla public license", "subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistributions of source code must retain", "redistributions of source code must retain the above copyright notice"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def licence_words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), BETWEEN_WORDS, -1), lambda w: w != "")


def word_rarity(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, int]:
    """Document frequency of each template word over all documents (one row a word reaches the driver)."""
    words = F.array(*[F.lit(w) for w in vocabulary])
    found = docs.select(F.explode(F.array_intersect(licence_words(text_of(text)), words)).alias("word"))
    return {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}


def scan_licences(docs: DataFrame, text: str = "text", templates: list[tuple[str, str, str]] = TEMPLATES,
                  base: list[tuple[str, str]] = BASE) -> DataFrame:
    """All columns of ``docs`` and: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    everything = [(label, key, key, True) for label, key in base] + [(*t, False) for t in templates]
    vocabulary = sorted({w for _, _, whole, _ in everything for w in whole.split()})
    rarity = word_rarity(docs, vocabulary, text)
    rows, reach = [], max(len(whole.split()) for _, _, whole, _ in everything)
    for number, (label, key, whole, is_base) in enumerate(everything):
        words, key_words = whole.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key_words)] == key_words)
        rarest = lambda ws: min(range(len(ws)), key=lambda i: (rarity.get(ws[i], 0), i))
        for offset in {at + rarest(key_words), rarest(words)}:
            rows.append((words[offset], number, label, is_base, offset, at, key_words, words))
    lit = lambda ws: F.array(*[F.lit(w) for w in ws])
    postings = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(n).alias("number"), F.lit(label).alias("label"), F.lit(b).alias("base"),
                                  F.lit(o).alias("offset"), F.lit(a).alias("at"), lit(k).alias("key"), lit(ws).alias("whole"))
                         for w, n, label, b, o, a, k, ws in rows])
    looked_up = lit(sorted({r[0] for r in rows}))
    n = {c: own_name(docs, c) for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "words", "hits", "found")}
    out = docs.withColumn(n["words"], licence_words(text_of(text)))
    words = F.col(n["words"])
    hits = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(looked_up, w), F.struct(i.alias("i"), w.alias("w")))), lambda h: h.isNotNull())
    # the words around each hit, as far as any template reaches; "from" is the place of the first of them
    hits = F.when(F.arrays_overlap(words, looked_up), hits).otherwise(F.array().cast("array<struct<i:int,w:string>>"))
    around = F.transform(hits, lambda h: F.struct(h["i"].alias("i"), h["w"].alias("w"), F.greatest(h["i"] - reach, F.lit(0)).alias("from"),
                                                  F.slice(words, F.greatest(h["i"] - reach, F.lit(0)) + 1, F.lit(2 * reach + 1)).alias("near")))
    out = out.withColumn(n["hits"], around)

    def laid(h: Column, p: Column) -> Column:
        start = h["i"] - p["offset"]
        at = start - h["from"]  # place of the template's start among the words around
        key_at = at + p["at"] + 1
        key_there = F.when(key_at >= 1, F.slice(h["near"], F.greatest(key_at, F.lit(1)), F.size(p["key"])) == p["key"]).otherwise(F.lit(False))
        same = F.size(F.filter(p["whole"], lambda w, i: F.coalesce(F.get(h["near"], at + i) == w, F.lit(False))))
        return F.struct(p["number"].alias("number"), p["label"].alias("label"), p["base"].alias("base"), (start + p["at"]).alias("start"),
                        F.coalesce(key_there, F.lit(False)).alias("key_there"), (same / F.size(p["whole"])).alias("share"))

    found = F.flatten(F.transform(n["hits"], lambda h: F.transform(F.filter(postings, lambda p: p["word"] == h["w"]), lambda p: laid(h, p))))
    out = out.withColumn(n["found"], found)
    base_found = F.array_distinct(F.transform(F.filter(n["found"], lambda x: x["base"] & x["key_there"]), lambda x: F.struct(x["start"].alias("start"), x["label"].alias("label"))))
    named = lambda keep: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(F.filter(n["found"], keep), lambda x: x["label"]))))
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns], F.size(words).cast("long").alias(n["n_words"]), F.size(base_found).cast("long").alias(n["n_base"]),
        F.array_min(F.transform(base_found, lambda x: x["start"])).cast("long").alias(n["first_word"]),
        F.array_max(F.transform(base_found, lambda x: x["start"])).cast("long").alias(n["last_word"]),
        named(lambda x: x["base"] & x["key_there"]).alias(n["base_labels"]), named(lambda x: x["key_there"]).alias(n["labels"]),
        F.coalesce(F.array_max(F.transform(n["found"], lambda x: x["share"])), F.lit(0.0)).alias(n["score"]))
