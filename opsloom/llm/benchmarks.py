"""Benchmark decontamination: one Aho-Corasick automaton over the words of test questions and answers.

Texts are normalised to words (A-Z as a-z, ASCII other than letters and digits separates). Every window of ten words
of an item, or the whole of a shorter item, is a pattern of the automaton, whose symbols are numbers of the benchmark's
words; all other words are symbol 0. Each document is read once, and the words inside occurrences are mapped back to
character offsets of the text as it was.

Null and empty texts have no words and hit nothing; items without words have no window; items of a null id count as
one item with the id ''. Rows of one item id are one item. Repeated, tied and null doc_ids do not matter, as every row
is worked on by itself. Added columns whose names ``docs`` uses get a leading underscore. Texts of any length are
scanned whole, one after the other.

An automaton holds at most about ``most_words`` benchmark words. A larger benchmark is dealt, by a hash of its pieces,
to several automata, and the documents are scanned by one after the other; the words found add up.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.common import own_name, text_of, widened
from opsloom.session import settle

#: Words of an item that stay together, besides the overlap that keeps every window whole.
PIECE_WORDS = 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of words as they count, all others as a space; bytes from 128 on belong to characters that are in words.
PLAIN = bytes(b if b > 127 else ord(c.lower()) if (c := chr(b)).isalnum() else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def item_pieces(items: DataFrame, window: int, key: str, text: str) -> DataFrame:
    """(item, words, n): pieces of the items' words, joined by spaces, that together hold every window once or more."""
    words = F.regexp_extract_all(F.translate(text_of(text), _UPPER, _LOWER), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))
    listed = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), words.alias("words"))
    listed = listed.where(F.size("words") > 0).withColumn("start", F.explode(F.expr(f"sequence(0, greatest(size(words) - {window}, 0), {PIECE_WORDS})")))
    piece = F.slice("words", F.col("start") + 1, PIECE_WORDS + window - 1)
    return listed.select("item", F.array_join(piece, " ").alias("words"), F.size(piece).alias("n")).distinct()


class Windows:
    """The automaton of some items. ``pieces`` are (item, words joined by spaces)."""

    def __init__(self, pieces: list[tuple[str, str]], size: int):
        self.numbers: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, joined in pieces:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in joined.encode().split(b" ")]
            for at in range(max(len(ids) - size, 0) + 1):
                found.setdefault(tuple(ids[at : at + size]), set()).add(item)
        self.lengths, self.items = [len(w) for w in found], list(found.values())
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for number, window in enumerate(found):
            self.automaton.add_word(window, number)
        if found:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs of words inside occurrences (first, last exclusive), and the items that occur."""
        number = self.numbers.get
        symbols = tuple([number(w, 0) for w in words])
        if not any(symbols):
            return [], set()
        hits, seen, lengths = [], set(), self.lengths
        for end, window in self.automaton.iter(symbols):
            hits.append((end + 1 - lengths[window], end + 1))
            seen.add(window)
        return joined_runs(hits), set().union(*[self.items[w] for w in seen])


def joined_runs(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint runs that cover the same places; runs that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def character_spans(data: bytes, plain: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text of runs of words; ``plain`` is the normalised text, byte for byte."""
    if not runs:
        return []
    ends, spans = {}, []
    wanted = {w for a, b in runs for w in (a, b - 1)}
    for k, m in enumerate(_WORD.finditer(plain)):
        if k in wanted:
            ends[k] = m.span()
        if k >= runs[-1][1]:
            break
    at = characters = 0
    for a, b in runs:
        place = []
        for byte in (ends[a][0], ends[b - 1][1]):
            characters += len(data[at:byte].decode())
            at = byte
            place.append(characters)
        spans.append(tuple(place))
    return spans


_built: dict[str, Windows] = {}


def _windows(key: str, pieces: list[tuple[str, str]], size: int) -> Windows:
    """The automaton of the running pass; a Python worker keeps one."""
    if key not in _built:
        _built.clear()
        _built[key] = Windows(pieces, size)
    return _built[key]


def _pass(docs: DataFrame, pieces: list[tuple[str, str]], window: int, names: dict[str, str], text: str, first: bool) -> DataFrame:
    """Scan by one automaton; word runs and items found so far are carried along."""
    shared, key = docs.sparkSession.sparkContext.broadcast(pieces), uuid.uuid4().hex
    runs_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    schema = docs.schema if not first else widened(docs, **{names["runs"]: "array<struct<first:long,last:long>>", names["found"]: "array<string>"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _windows(key, shared.value, window)
        for batch in batches:
            all_runs, all_items = [], []
            for row in range(batch.num_rows):
                runs, items = windows.scan((batch.column(text)[row].as_py() or "").encode().translate(PLAIN).split())
                if not first:
                    runs = joined_runs(runs + [(r["first"], r["last"]) for r in batch.column(names["runs"])[row].as_py()])
                    items |= set(batch.column(names["found"])[row].as_py())
                all_runs.append([{"first": a, "last": b} for a, b in runs])
                all_items.append(sorted(items))
            kept = [batch.column(n) for n in batch.schema.names if n not in (names["runs"], names["found"])]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(all_runs, runs_type), pa.array(all_items, pa.list_(pa.string()))], [f.name for f in schema])

    return docs.mapInArrow(run, schema)


def _told(docs: DataFrame, names: dict[str, str], text: str) -> DataFrame:
    """Word runs and items as results: counts, digest and character spans."""
    made = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hits")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
    kept = docs.drop(names["runs"], names["found"])
    carried = kept.columns
    schema = widened(kept, **{names[n]: t for n, t in zip(made, ("long", "long", "long", "string", "boolean", "array<struct<start:long,end:long>>"))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in made]
            for row in range(batch.num_rows):
                data = (batch.column(text)[row].as_py() or "").encode()
                plain = data.translate(PLAIN)
                runs = [(r["first"], r["last"]) for r in batch.column(names["runs"])[row].as_py()]
                items = batch.column(names["found"])[row].as_py()
                hit = sum(b - a for a, b in runs)
                spans = [{"start": a, "end": b} for a, b in character_spans(data, plain, runs)]
                values = (len(plain.split()), hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0, spans)
                for column, value in zip(columns, values):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in carried], *[pa.array(c, t) for c, t in zip(columns, kinds)]], [f.name for f in schema])

    return docs.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, key: str = "item_id", text: str = "text", item_text: str = "text", most_words: int = 250_000) -> DataFrame:
    """All columns of ``docs`` and: n_words, n_hit (words inside occurrences), n_items (items with occurring windows),
    items_sha256 (their ids, sorted as strings, comma-joined), contaminated, hits (character spans in the text)."""
    names = {n: own_name(docs, n) for n in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hits", "runs", "found")}
    pieces = settle(item_pieces(items, window, key, item_text), "pieces")
    passes = max(1, math.ceil((pieces.agg(F.sum("n")).first()[0] or 0) / most_words))
    scanned = docs
    for number in range(passes):
        part = pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(passes)) == number)
        rows = [(r["item"], r["words"]) for r in part.collect()]  # about most_words words
        scanned = _pass(scanned, rows, window, names, text, first=number == 0)
        if number < passes - 1:
            scanned = settle(scanned, "scanned")
    return _told(scanned, names, text)
