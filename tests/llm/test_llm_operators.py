"""Text operators against brute force on small tables with nulls, empty texts, ties, repeats and clashing names."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from opsloom.llm import bpe, exact, fingerprints, licences, mixing, ngrams, personal, quality, substrings
from opsloom.llm.archives import arc_records, read_arc, read_warc, write_arc, write_warc
from opsloom.llm.common import ready
from opsloom.llm.substrings import LENGTH

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, source string, size int, maybe_repeated string, draws int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(n, seed, letters="abcdefgh"):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choices(letters, k=rng.randint(1, 5))) for _ in range(n))]


def corpus():
    base = words_of(80, 1)[0]
    near = base.split()
    near[40] = "changed"
    far = base.split()[:40] + words_of(60, 2)[0].split()
    texts = [base, base, " ".join(near), " ".join(far), None, "", "   ", "one two", "One  TWO", "É ß 日本 😀 É", words_of(300, 3)[0], "x" * 5000, "the the the the the the",
             "Released under the MIT License. Apache License, Version 2.0", "CC BY-NC 4.0", "mail a.b@c.example.org now +1 (212) 555-1234 or 10.0.0.255 or 4111111111111111 password=0a1b2c3d4e5f6a7b8c",
             "<|endoftext|>tail", words_of(80, 4)[0] + " " + base]
    rows = [(i, t, None if i % 5 == 0 else f"s{i % 3}", 7, "clash", 9) for i, t in enumerate(texts)]
    return rows + [rows[0], rows[4]]


@pytest.fixture(scope="module")
def docs(spark):
    return ready(spark).createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return ready(spark).createDataFrame([], SCHEMA)


def text(row):
    return row[1] or ""


def test_exact_groups(docs, none):
    groups = {}
    for r in corpus():
        groups.setdefault(text(r), []).append(r[0])
    want = sorted((r[0], max(groups[text(r)]), len(groups[text(r)]), r[0] == max(groups[text(r)]), hashlib.sha256(text(r).encode()).hexdigest()) for r in corpus())
    assert sorted(map(tuple, exact.exact_groups(docs).collect())) == want
    kept = exact.exact_dedup(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(max(v) for v in groups.values())
    assert exact.exact_groups(none).isEmpty() and exact.exact_dedup(none).isEmpty()


def test_filter_beyond_the_broadcast_bound_gives_the_same(docs, monkeypatch):
    want = sorted(map(tuple, exact.exact_groups(docs).collect()))
    monkeypatch.setattr(exact, "BROADCAST_BITS", 1)
    assert sorted(map(tuple, exact.exact_groups(docs).collect())) == want


def test_bpe_equals_the_tokenizers_library(docs, none):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(PATH)
    got = bpe.bpe_encode(docs, PATH, with_ids=True).collect()
    assert len(got) == len(corpus())
    for r in got:
        ids = reference.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["token_ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.bpe_encode(none, PATH).isEmpty()


def test_automaton_equals_merging():
    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("b", "ab"), ("ab", "a"), ("aab", "aa")]
    vocab = {t: i for i, t in enumerate(dict.fromkeys(["a", "b", *[x + y for x, y in merges]]))}
    automaton = bpe.Automaton(vocab, merges, "")
    for n in range(1, 9):
        for word in map("".join, itertools.product("ab", repeat=n)):
            assert [automaton.labels[i] for i in automaton.encode(word)] == _merged(word, merges)


def _merged(word, merges):
    parts = list(word)
    while True:
        ranked = [(merges.index(p), i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges]
        if not ranked:
            return parts
        _, i = min(ranked)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_quality_separates_held_out_rows_and_never_drops_rows(spark, none):
    rng = random.Random(9)
    rows = [(i, (" ".join(w.upper() + "!!" for w in words_of(60, i)[0].split()) if i % 3 == 0 else words_of(60, i)[0])) for i in range(400)]
    docs = ready(spark).createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400) if rng.random() < 0.6], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in quality.with_quality(docs, labels).collect()}
    assert len(got) == 402 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.3) == (i % 3 > 0) for i in range(400)]) > 0.98
    assert {r["score"] for r in quality.with_quality(docs, labels.limit(0)).collect()} == {1.0}
    assert quality.with_quality(none, labels).isEmpty()


def test_licences(docs, none):
    phrases = [(label, phrase.split()) for label, phrase in licences.BASE]
    for r in licences.scan_licences(docs).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r["text"] or "").translate(LOWER))
        found = [(i, label) for label, p in phrases for i in range(len(w)) if w[i : i + len(p)] == p]
        starts = [i for i, _ in found]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(found), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in found})) and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
    assert licences.scan_licences(none).isEmpty()


def test_ngram_components(docs, none):
    sets = {}
    for r in corpus():
        w = re.findall(r"[^\x20\x09-\x0D]+", text(r).translate(LOWER))
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
    root = {k: k for k in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root[a], root[b]))
            root = {k: x if v == y else v for k, v in root.items()}
    got = sorted(map(tuple, ngrams.near_components(docs).collect()))
    assert got == sorted((r[0], len(sets[r[0]]), root[r[0]]) for r in corpus())
    assert ngrams.near_components(none).isEmpty()


def test_ngram_links_of_a_large_near_group(spark):
    """Sixty edits of one text, many of them too far from each other to link directly."""
    rng, base = random.Random(3), words_of(120, 8)[0].split()
    rows = []
    for i in range(60):
        w = list(base)
        for k in rng.sample(range(len(w)), 1 + i % 4):
            w[k] = f"w{i}x{k}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    root = list(range(60))
    for a, b in itertools.combinations(range(60), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root[a], root[b]))
            root = [x if v == y else v for v in root]
    got = {r["doc_id"]: r["component_id"] for r in ngrams.near_components(ready(spark).createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(60)] == root


def test_ngram_pairs_meet_at_their_first_shared_shingle(spark):
    """Edits of one text share most of their prefix: a pair is put out once, not per shared shingle, and no link is lost."""
    rng, base = random.Random(5), words_of(150, 9)[0].split()
    rows = []
    for i in range(40):
        w = list(base)
        for k in rng.sample(range(len(w)), 1 + i % 5):
            w[k] = f"w{i}x{k}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    links = {(a, b) for a, b in itertools.combinations(range(40), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    reps = ngrams.prefixes(ready(spark).createDataFrame(rows, "doc_id long, text string"), 5, 80).withColumn("class", F.col("doc_id"))
    held = reps.select("class", "n", F.posexplode("prefix").alias("place", "token"), F.col("class").alias("root"))
    open_ = held.groupBy("token").agg(F.count("*").alias("holders")).where("holders > 1")
    met = [tuple(r) for r in ngrams.met_across(held, open_, reps, 80).collect()]
    shared = held.alias("x").join(held.alias("y"), "token").where("x.class < y.class").count()
    assert links and links <= set(met)
    assert len(met) == len(set(met)) and shared > 40 * len(met)


def test_ngram_links_of_a_doc_id_with_several_texts(spark):
    """Document 1 carries three texts that each name a class, and each has a near copy elsewhere."""
    texts = [words_of(80, 30 + i)[0] for i in range(4)]
    rows = [*[(1, t) for t in texts[:3]], *[(2 + i, t.rsplit(" ", 1)[0] + " changed") for i, t in enumerate(texts)], (9, texts[3])]
    got = sorted((r["doc_id"], r["component_id"]) for r in ngrams.near_components(ready(spark).createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (9, 5)]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 50), (100, 100)], "a long, b long")
    got = {r["v"]: r["root"] for r in ngrams.components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[100] == 50


def test_range_filter_never_exceeds_the_difference():
    rng = np.random.default_rng(1)
    for n, m in ((5, 9), (100, 300), (64, 64), (5000, 40)):
        a, b = (np.unique(rng.integers(0, 1 << 63, k).astype(np.uint64)) for k in (n, m))
        b = np.union1d(a[: n // 2], b)
        assert ngrams.range_difference(ngrams._ranges(a).tobytes(), ngrams._ranges(b).tobytes()) <= len(np.setxor1d(a, b))


def removed(rows):
    data = [text(r).encode() for r in rows]
    count = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for r, d in zip(rows, data):
        covered = bytearray(len(d))
        for i in range(len(d) - 199):
            if count[d[i : i + 200]] > 1:
                covered[i : i + 200] = b"\1" * 200
        spans = sum(1 for i, c in enumerate(covered) if c and not (i and covered[i - 1]))
        out.append((r[0], len(d), sum(covered), spans, hashlib.sha256(bytes(x for x, c in zip(d, covered) if not c)).hexdigest()))
    return sorted(out)


def test_small_and_large_groups_agree(monkeypatch):
    rng = random.Random(6)
    core = "".join(rng.choices("abcd", k=80)).encode()
    before = "".join(rng.choices("ab", k=90)).encode()
    left = [before + bytes([65 + i % 4]) * (20 + i) for i in range(12)]
    right = [core + bytes([65 + i % 3]) * (40 + i) + core + core for i in range(12)]
    low, high = [max(0, LENGTH - len(r)) for r in right], [len(x) for x in left]
    want = substrings.repeated_starts(left, right, low, high, [False] * 12)
    monkeypatch.setattr(substrings, "PAIRED", 0)
    got = substrings.repeated_starts(left, right, low, high, [False] * 12)
    assert [w.tolist() for w in want] == [g.tolist() for g in got] and any(map(len, want))


@pytest.mark.parametrize("group", [2000, 1])
def test_repeated_bytes(docs, none, monkeypatch, group):
    monkeypatch.setattr(substrings, "GROUP", group)
    assert sorted(tuple(r)[:5] for r in substrings.remove_repeats(docs).collect()) == removed(corpus())
    assert substrings.remove_repeats(none).isEmpty()


def test_passage_of_a_large_group_is_not_dealt_string_by_string(spark, monkeypatch):
    """60 texts hold one passage, some go on alike after it: blocks of distances are dealt, all strings are found."""
    rng, passage = random.Random(8), words_of(120, 50)[0][:330]
    texts = ["".join(rng.choices("xyz", k=150)) + passage + "uvw"[i % 3] * (i % 7) + "".join(rng.choices("xyz", k=150)) for i in range(60)]
    rows = [(i, t) for i, t in enumerate([*texts, texts[0], texts[1][100:500], texts[2][:349] + "q" * 90, None])]
    settled, made = substrings.settle, Counter()

    def counted(df, label):
        out = settled(df, label)
        made[label] += out.count()
        if label == "merged" and not made["strings"]:  # of all groups; those that are not large have few
            made["strings"] = out.agg(F.sum(F.expr("far - near + 1"))).first()[0]
        return out

    monkeypatch.setattr(substrings, "settle", counted)
    monkeypatch.setattr(substrings, "GROUP", 8)
    docs = ready(spark).createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r)[:5] for r in substrings.remove_repeats(docs).collect()) == removed(rows)
    assert 0 < 5 * made["pieces"] < made["strings"], made


def test_deep_shallow_order():
    rng = random.Random(2)
    strings = ["".join(rng.choices("ab", k=rng.randint(0, 60))).encode() for _ in range(300)] + [b"ab" * 40 + bytes([i % 7]) * (i % 5) for i in range(200)]
    assert [strings[i] for i in substrings.deep_shallow(strings)] == sorted(strings)


def test_mix(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(corpus())
    sizes, targets, taken = {}, {}, Counter()
    for r in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        assert r["_size"] == n and len(r["_draws"]) <= 3
        sizes[r["source"]] = sizes.get(r["source"], 0) + n
        targets[r["source"]] = r["target"]
        taken[r["source"]] += n * len(r["_draws"])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = mixing.source_targets([sizes[s] for s in order], [1, 2, 3, 1])
    assert [targets[s] for s in order] == pytest.approx(want) and sum(want) == pytest.approx(sum(sizes.values()))
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))
    drawn = mixing.mixed_rows(docs)
    assert drawn.columns == docs.columns and drawn.count() == sum(len(r["_draws"]) for r in rows)
    assert mixing.mix(none).isEmpty() and mixing.mixed_rows(none).isEmpty()


def test_splitting_tree_keeps_quotas():
    dealt = mixing.splitting_tree(np.array([10, 0, 77, 3]), 7, np.random.default_rng(1))
    assert dealt.sum(0).tolist() == [10, 0, 77, 3] and (dealt >= 0).all() and np.ptp(dealt.sum(1)) <= 3


def test_targets_stop_at_the_limit():
    assert mixing.source_targets([10, 1000], [3, 1]) == [30, 980] and mixing.source_targets([], []) == []


def test_fingerprints(docs, spark, none):
    unique = {r[0]: text(r) for r in corpus()}
    order = sorted(unique)
    got = fingerprints.edited_fingerprints(docs).collect()
    assert len(got) == len(corpus())
    prints = {}
    for r in got:
        t, following = unique[r["doc_id"]], unique[order[(order.index(r["doc_id"]) + 1) % len(order)]]
        m = len(t) // 4
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256((t[: len(t) - m] + following[:m]).encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
    assert fingerprints.edited_fingerprints(none).isEmpty()
    sets = spark.createDataFrame([(1, list(range(100))), (2, list(range(95))), (3, list(range(50))), (4, [])], "doc_id long, spots array<int>")
    assert [(r["a"], r["b"]) for r in fingerprints.near_pairs(sets).collect()] == [(1, 2)]


@pytest.mark.parametrize("ids", [[None, 3, None, 8, 5, None], [None], [None, None], [4]])
def test_fingerprints_of_null_ids(spark, ids):
    rows = [(k, words_of(30, 20 + (k or 0))[0]) for k in ids]
    order = sorted(set(ids), key=lambda k: (k is not None, k or 0))
    texts, want = dict(rows), []
    for k, t in rows:
        following, m = texts[order[(order.index(k) + 1) % len(order)]], len(t) // 4
        want.append((k, len(t), hashlib.sha256((t[: len(t) - m] + following[:m]).encode()).hexdigest()))
    got = fingerprints.edited_fingerprints(ready(spark).createDataFrame(rows, "doc_id long, text string"))
    assert got.schema["doc_id"].dataType.simpleString() == "bigint"
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:3]) for r in got.collect())


def test_archives(spark, tmp_path):
    rows = [(1, "http://a/x y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b", None), (4, "http://c", ""), (5, "http://d", "a\r\n\r\nWARC/1.1\n"), (6, "u", "<p>é</p>"), (6, "u", "<p>é</p>")]
    pages = ready(spark).createDataFrame(rows, "page_id long, url string, html string")
    write_arc(pages, f"{tmp_path}/arc")
    records = read_arc(spark, f"{tmp_path}/arc")
    assert sorted((r["key"], r["payload"]) for r in records.collect()) == sorted((k, h or "") for k, _, h in rows)
    write_warc(records, f"{tmp_path}/warc")
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in read_warc(spark, f"{tmp_path}/warc").collect())
    assert got == [(1, 9, "revisit", 6), (2, 9, "revisit", 6), (3, 0, "revisit", 4), (4, 0, "response", None), (5, 14, "response", None), (6, 9, "response", None), (6, 9, "response", None)]
    with pytest.raises(ValueError):
        list(arc_records(b"http://a 0.0.0.0 20010101000000 text/html 99\nshort\n"))
    write_arc(pages.limit(0), f"{tmp_path}/arc0")
    assert read_arc(spark, f"{tmp_path}/arc0").isEmpty()


def test_personal(docs, none):
    for r in personal.find_personal(docs).collect():
        base = personal.base_spans(r["text"] or "")
        assert [r[f"n_{k}"] for k in personal.KINDS[:4]] == [len(base[k]) for k in personal.KINDS[:4]]
        spans = [(k, *s) for k in personal.KINDS[:4] for s in base[k]]
        assert r["base_sha256"] == hashlib.sha256(personal.listed(spans).encode()).hexdigest()
        assert set(personal.listed(spans).split(",")) <= set(r["spans"].split(",")) | {""}
        if r["doc_id"] == 15:
            assert [len(base[k]) for k in personal.KINDS[:4]] == [1, 1, 1, 1] and "secret:" in r["spans"]
    assert personal.find_personal(none).isEmpty()


def test_field_on_rows_it_has_not_seen():
    field = personal.train_field(personal.labelled_table())
    runs = personal.labelled_table(rows=180, seed=99)
    paths = field.decode([run for run, _ in runs])
    right = [personal.LABELS[p] == w for path, (_, want) in zip(paths, runs) for p, w in zip(path, want)]
    assert np.mean(right) > 0.97


def test_base_patterns_drop_without_retry():
    found = personal.base_spans("1.2.3.4.5 and 300.1.1.1 or 4111 1111 1111 1111, 4111111111111112 at +12 a@b x@y.z.")
    assert found == {"email": [(76, 81)], "ip": [(0, 7)], "card": [(27, 46)], "phone": []}
