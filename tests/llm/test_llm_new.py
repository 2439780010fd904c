"""Tokenizer alignment, benchmark decontamination and conversation repair against brute force."""

import hashlib
import itertools
import random
import re
import sys
import zlib
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from opsloom.llm import alignment, benchmarks, conversations, queries
from opsloom.llm.common import ready

SMALL = "/root/testdata/sf0.001"
A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# alignment


def brute_alignment(texts):
    """Rows (n_a, n_b, n_groups, n_links, n_best, count_sum, groups) by the two libraries and loops over all pairs of tokens."""
    slow = Tokenizer.from_file(A_FILE)
    slow.encode_special_tokens = True
    pieces = SentencePieceProcessor(model_file=B_FILE)
    entry = alignment.byte_entries(slow.get_vocab())
    seen = []
    for text in texts:
        a = [(i, entry[i]) for i in slow.encode(" " + (text or ""), add_special_tokens=False).ids] if text else []
        b = [(i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p := pieces.id_to_piece(i)) else p.replace("▁", " ").encode()) for i in pieces.encode(text)] if text else []
        whole = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            seen.append(None)
            continue
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        links = [(x[0], y[0]) for x in spans[0] for y in spans[1] if x[1] < y[2] and y[1] < x[2]]
        cuts = sorted({x[2] for x in spans[0]} & {y[2] for y in spans[1]})
        groups, last = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(x[0]) for x in side if last <= x[1] < cut) for side in spans))
            last = cut
        seen.append((len(a), len(b), ";".join(groups), len(groups), links))
    counts = Counter(pair for s in seen if s for pair in s[4])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(0, 0, 0, 0, 0, 0, "") if s is None else (s[0], s[1], s[3], len(s[4]), sum(counts[p] == most[p[1]] for p in s[4]), sum(counts[p] for p in s[4]), s[2]) for s in seen]


TEXTS = [None, "", " ", "a", "The quick brown fox, 1234567 times; don't!", "The quick brown fox, 1234567 times; don't!", "<|endoftext|> <s></s> <0x41> <unk>", "日本語のテキスト 😀 é é ﬁ", "a▁b",
         "   spaces  \t tabs\n\n\nlines \r\n", "\x00\x01 control", "x" * 30000, "ab " * 3000, "ñandú ção ß Straße", "　full width", "​zero", "the the the the"]


def test_alignment_against_all_pairs(spark):
    texts = TEXTS[:11] + TEXTS[13:] + ["".join(random.Random(s).choices("abc é\n▁1😀.'<>|", k=40)) for s in range(60)]
    docs = ready(spark).createDataFrame([(i % 50, t, "x", 5) for i, t in enumerate(texts)], "doc_id long, text string, n_a string, chunk int").repartition(3)
    got = alignment.aligned_tokens(docs, A_FILE, B_FILE, with_groups=True)
    assert got.columns == ["doc_id", "n_a", "chunk", "_n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    want = [(i % 50, "x", 5, *row[:6], sha(row[6]) if row[6] else "", row[6]) for i, row in enumerate(brute_alignment(texts))]
    assert collected(got) == sorted(want, key=str)


def test_alignment_of_long_texts_and_of_nothing(spark):
    docs = ready(spark).createDataFrame([(1, TEXTS[11]), (2, TEXTS[12]), (3, " " * 30000), (None, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in alignment.aligned_tokens(docs, A_FILE, B_FILE).collect()}
    local = alignment.Aligner(open(A_FILE, encoding="utf-8").read(), open(B_FILE, "rb").read())
    for i, text in ((1, TEXTS[11]), (2, TEXTS[12]), (3, " " * 30000)):
        assert rows[i]["n_a"] == len(local.a.slow.encode(" " + text, add_special_tokens=False).ids)
    assert rows[None]["n_a"] == 0 and rows[None]["groups_sha256"] == ""
    none = alignment.aligned_tokens(docs.where("doc_id > 5"), A_FILE, B_FILE)
    assert none.isEmpty()


def test_both_byte_level_encoders_agree():
    local = alignment.ByteLevel(open(A_FILE, encoding="utf-8").read())
    texts = ["".join(chr(c) for c in range(at, at + 64) if not 0xD800 <= c < 0xE000) for at in range(0, 0x30000, 64)]
    for text in texts:
        assert local.fast.encode_ordinary(text) == local.slow.encode(text, add_special_tokens=False).ids


def test_registered_alignment(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    short = [(r["doc_id"], r["text"]) for r in docs]
    got = {r["doc_id"]: r for r in queries.op11_alignment(spark, SMALL).collect()}
    assert len(got) == len(short)
    local = alignment.Aligner(open(A_FILE, encoding="utf-8").read(), open(B_FILE, "rb").read())
    counts, links = Counter(), {}
    for i, text in short:  # merge walk over both tilings
        a, b = (x.tolist() for x in local.whole(text))
        at_a = at_b = x = y = 0
        links[i] = []
        while x < len(a) and y < len(b):
            links[i].append((a[x], b[y]))
            end_a, end_b = at_a + len(local.a.bytes[a[x]]), at_b + len(local.b.bytes[b[y]])
            if end_a <= end_b:
                x, at_a = x + 1, end_a
            if end_b <= end_a:
                y, at_b = y + 1, end_b
        counts.update(links[i])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    for i, found in links.items():
        assert (got[i]["n_links"], got[i]["n_best"], got[i]["count_sum"]) == (len(found), sum(counts[p] == most[p[1]] for p in found), sum(counts[p] for p in found))


# decontamination


def brute_decontamination(texts, items, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = set()
    for item, text in items:
        w = words(text)
        windows |= {(tuple(w[k : k + size]), "" if item is None else str(item)) for k in range(max(len(w) - size, 0) + 1) if w}
    out = []
    for text in texts:
        w = words(text)
        hit, found = set(), set()
        for window, item in windows:
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    found.add(item)
        out.append((len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def contaminated_corpus():
    rng = random.Random(5)
    pick = lambda n: " ".join(rng.choice(["Alpha", "beta", "gamma", "Ünder", "d1", "日本"]) for _ in range(n))
    items = [(1, pick(25)), (2, pick(10)), (10, "Short answer!"), (3, "short, answer"), (4, ""), (5, None), (None, "no id here"), (1, pick(12)), (6, "  ...  ")]
    texts = [None, "", "...", "x " + items[0][1] + " y", items[0][1][:60], "the SHORT answer is short-answer", f"É {items[1][1]}, {items[1][1]} short answer", pick(400), "no-id HERE", "short", " ".join(items[0][1].split()[3:16]).upper()]
    return [*texts, texts[3]], items


def test_decontamination_against_brute_force(spark):
    texts, items = contaminated_corpus()
    docs = ready(spark).createDataFrame([(i % 5, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_hit int").repartition(3)
    bench = spark.createDataFrame([(*i, "q") for i in items], "item_id long, text string, doc_id string")
    want = collected(spark.createDataFrame([(i % 5, t, 7, *row) for (i, t), row in zip(enumerate(texts), brute_decontamination(texts, items))],
                                           "doc_id long, text string, n_hit int, n_words long, _n_hit long, n_items long, items_sha256 string, contaminated boolean"))
    for most in (250_000, 20):  # one automaton, several
        got = benchmarks.decontaminate(docs, bench, most_words=most)
        assert got.columns == ["doc_id", "text", "n_hit", "n_words", "_n_hit", "n_items", "items_sha256", "contaminated", "hits"]
        assert collected(got.drop("hits")) == want


def test_hits_are_places_in_the_original_text(spark):
    docs = ready(spark).createDataFrame([("É;Short--ANSWER! and 日本 short answer",)], "text string")
    bench = spark.createDataFrame([("a", "short answer")], "item_id string, text string")
    row = benchmarks.decontaminate(docs, bench).first()
    assert [row["text"][h["start"] : h["end"]] for h in row["hits"]] == ["Short--ANSWER", "short answer"]


def test_pieces_keep_every_window(spark):
    rng = random.Random(2)
    words = [str(rng.randint(0, 10**9)) for _ in range(3 * benchmarks.PIECE_WORDS)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    at = benchmarks.PIECE_WORDS
    docs = ready(spark).createDataFrame([(k, " ".join(words[k : k + 10])) for k in (0, at - 9, at - 1, at, 2 * at - 5, len(words) - 10)] + [(-1, " ".join(words[5:14]))], "doc_id long, text string")
    got = {r["doc_id"]: r["n_hit"] for r in benchmarks.decontaminate(docs, bench).collect()}
    assert got.pop(-1) == 0 and set(got.values()) == {10}


def test_decontamination_without_items_or_documents(spark):
    docs, bench = ready(spark).createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    row = benchmarks.decontaminate(docs, bench).first()
    assert (row["n_words"], row["n_hit"], row["contaminated"], row["items_sha256"]) == (2, 0, False, sha(""))
    assert benchmarks.decontaminate(docs.where("doc_id > 1"), spark.createDataFrame([(1, "a")], "item_id long, text string")).isEmpty()


# conversations


def least(rows, i=0, before="0", memo=None):
    """(cost, audit) by trying every edit: rows are (mark, fault); tuples compare by cost, then ASCII."""
    memo = {} if memo is None else memo
    key = (i, before)
    if key not in memo:
        options = [(0, "")] if i == len(rows) and before in "0a" else []
        fits = {"0": "u", "s": "u", "u": "a", "a": "u"}[before]
        if i < len(rows):
            mark, fault = rows[i]
            ways = [("D", 2, before)]
            if fault not in "bd":
                more = 5 if fault == "t" else 0
                ways += [("K", more, mark)] if mark == fits or mark == "s" and before == "0" else []
                ways += [("R", 1 + more, fits)]
            options += [(c + rest[0], edit + rest[1]) for edit, c, to in ways for rest in [least(rows, i + 1, to, memo)]]
        if i == len(rows) or memo.get("inserted") != key:
            # an insertion may stand anywhere; two in a row bring the grammar back to where it was
            options += inserted(rows, i, fits, memo, 1) + (inserted(rows, i, "a" if fits == "u" else "u", memo, 2) if before in "0s" else [])
        memo[key] = min(options)
    return memo[key]


def inserted(rows, i, before, memo, times):
    """What follows ``times`` insertions before turn i, the next edit being none."""
    if i == len(rows):
        return [(5 * times, "I" * times)] if before == "a" else []
    mark, fault = rows[i]
    fits = {"u": "a", "a": "u"}[before]
    ways = [("D", 2, before)]
    if fault not in "bd":
        more = 5 if fault == "t" else 0
        ways += [("K", more, mark)] if mark == fits else []
        ways += [("R", 1 + more, fits)]
    return [(5 * times + c + rest[0], "I" * times + edit + rest[1]) for edit, c, to in ways for rest in [least(rows, i + 1, to, memo)]]


def brute_repair(rows):
    """Per conv_id the contract's columns. ``rows`` are (conv_id, turn, role, text), no two with one turn but equal ones."""
    space = " \t\n\x0b\x0c\r"
    by_conv = {}
    for conv, turn, role, text in rows:
        kept = by_conv.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, kept in by_conv.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1][:1]))
        seen, marks = set(), []
        for _, role, text in kept:
            end = text.rstrip(space)
            fault = "b" if not end else "d" if (role, text) in seen else "-" if end[-1] in ".!?" else "t"
            seen.add((role, text))
            marks.append((role[:1] or "-", fault))
        cost, audit = least(marks)
        turns = [t for t, _, _ in kept if t is not None]
        lines, before, at = [], "0", iter(kept)
        for edit in audit:
            fits = {"0": "u", "s": "u", "u": "a", "a": "u"}[before]
            name = "user" if fits == "u" else "assistant"
            if edit == "I":
                lines, before = [*lines, f"{name}:"], fits
                continue
            _, role, text = next(at)
            if edit == "K":
                lines, before = [*lines, f"{role}:{text}"], role[0]
            elif edit == "R":
                lines, before = [*lines, f"{name}:{text}"], fits
        faults = [f for _, f in marks]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(marks))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, sha("\n".join(lines)))
    return out


def test_alignments_against_every_edit():
    rng = random.Random(8)
    for _ in range(1500):
        rows = [(rng.choice("suaua-"), rng.choice("---btd")) for _ in range(rng.randint(0, 9))]
        block = ["".join(r[k] for r in rows) for k in (0, 1)]
        want = least(rows)
        assert conversations.chained([conversations.align(*block, conversations.PAIRS[:4])]) == want, rows
        for cut in (1, len(rows) // 2, len(rows) - 1):  # in blocks
            if 0 < cut < len(rows):
                parts = [[b[:cut] for b in block], [b[cut:] for b in block]]
                assert conversations.chained([conversations.align(*p) for p in parts]) == want, (rows, cut)


def chats(seed, n):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(0, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown"])
            text = rng.choice(["Hello there.", "Fine!", "cut off", "  ", "", None, "What?\n", "Yes. \x0b", f"{conv} {turn}."])
            rows.append((conv if conv else None, turn * rng.choice([1, 1, 2]) if rng.random() < 0.95 or turn else None, role, text))
    unique = {}
    for row in rows:
        unique.setdefault(row[:2], row)
    rows = list(unique.values())
    return rows + [r for r in rows if r[0] and r[0] % 11 == 0]  # repeated rows


def test_repair_against_brute_force(spark):
    rows = chats(1, 150)
    df = ready(spark).createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, audit string").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in conversations.repair_conversations(df).collect()}
    assert got == brute_repair(rows)


def test_long_conversations_are_cut_into_blocks(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(7, t, rng.choice(["user", "assistant"]) if rng.random() < 0.2 else ("user", "assistant")[t % 2], rng.choice(["So.", "No?", f"{t}!", "open end", f"{t} and"])) for t in range(700)]
    rows += [(8, t, "user", "same.") for t in range(60)] + [(9, None, "user", "again.")] * 40
    monkeypatch.setattr(conversations, "BLOCK", 16)
    df = ready(spark).createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r[0]: tuple(r)[1:] for r in conversations.repair_conversations(df).collect()}
    sys.setrecursionlimit(10000)
    assert got == brute_repair(rows)


def test_conversations_without_rows(spark):
    assert conversations.repair_conversations(ready(spark).createDataFrame([], "conv_id long, turn long, role string, text string")).isEmpty()
    dropped = next(t for t in range(1000) if zlib.crc32(f"3:{t}".encode()) % 20 == 0)
    row = conversations.repair_conversations(spark.createDataFrame([(3, dropped, "user", "Gone.")], "conv_id long, turn long, role string, text string")).first()
    assert tuple(row) == (3, 0, 0, 0, 0, 0, 0, "", sha(""))


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_registered_repair(spark, name):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{name}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in queries.op13_conversations(spark, f"/root/testdata/{name}").collect()}
    assert got == brute_repair(rows)


def test_registered_decontamination(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    keep = sorted(docs, key=lambda r: len(r["text"] or ""))[:120]
    want = brute_decontamination([r["text"] for r in keep], items)
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_decontamination(spark, SMALL).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()}
    assert [got[r["doc_id"]] for r in keep] == want


def test_texts_put_together_from_words_equal_texts_encoded_whole():
    local = alignment.Aligner(open(A_FILE, encoding="utf-8").read(), open(B_FILE, "rb").read())
    assert local.by_words
    rng = random.Random(12)
    parts = ["a", "the", "don't", "I'll", " ", " ", " ", "\n", "\t", " ", "　", "\x1c", "é", "日本", "1", "23", ".", "...", "▁", "<s>", "ing", "\x85", "s", "'", "😀", "A", "​", "ﬁ"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(6000)] + ["w" * 30000 + " a b", " ".join(["x"] * 30000)]
    for k in range(0, len(texts), 500):
        (a, b), (n_a, n_b) = local.tokens([None, "", *texts[k : k + 500]])
        assert n_a[:2].tolist() == n_b[:2].tolist() == [0, 0]
        at_a = at_b = 0
        for text, x, y in zip(texts[k : k + 500], n_a[2:], n_b[2:]):
            want = local.whole(text)
            assert (a[at_a : at_a + x].tolist(), b[at_b : at_b + y].tolist()) == (want[0].tolist(), want[1].tolist()), text
            at_a, at_b = at_a + x, at_b + y
