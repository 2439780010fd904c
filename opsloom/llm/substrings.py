"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` bytes that also starts elsewhere are removed.

Sorting all suffixes of the corpus would move every byte many times. Instead every string of ``LENGTH`` bytes names an
anchor inside it, the ``GRAM`` bytes with the smallest hash (the leftmost of equals); equal strings name the same anchor
at the same place, so only suffixes at anchors whose bytes occur more than once are sorted, together with the text
before them. Suffixes are partitioned by their first bytes (the anchor), equal surroundings are merged beforehand, and
each group is sorted by deep-shallow sorting: multikey quicksort to a shallow depth, then blind tries for the groups
that still share a prefix. Common prefixes to the right and to the left of neighbours in the two orders tell which
strings are repeated.

A group with more than ``GROUP`` different surroundings is not brought into one task. It is cut up by blocks of
distances: equal strings at the distances of a block have the text in common that all strings of the block cover, so
surroundings are dealt by that text, and those that agree in all that the block's strings reach become one. What is
still too large is cut up again by the next width; at the last one a group is a single string.

Null texts count as empty; texts shorter than ``LENGTH`` bytes lose nothing. Rows that repeat a row wholly are copies
of each other; rows that share a doc_id with other texts are kept apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.common import mixed, powers, slices
from opsloom.llm.exact import maybe_repeated, repeated_blocks
from opsloom.session import settle

LENGTH, GRAM = 200, 40
GROUP = 2000
#: Distances of a block, one cut after another.
WIDTHS = (16, 4, 1)
SHALLOW = 12
#: Groups of at most so many surroundings are answered for all their pairs at once, from the two orders.
PAIRED = 200
_STARTS = 1 << 19
_RAW = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_INVERSE = pow(0x9DDFEA08EB382D69, -1, 1 << 64)
_inverse_powers = np.ones(1, np.uint64)


def _inverses(n: int) -> np.ndarray:
    global _inverse_powers
    if len(_inverse_powers) < n:
        grown = np.full(max(n, 2 * len(_inverse_powers)), _INVERSE, np.uint64)
        grown[0] = 1
        _inverse_powers = np.multiply.accumulate(grown)
    return _inverse_powers[:n]


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` bytes of ``data``."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_RAW[data] * powers(len(data)), out=total[1:])
    n = len(data) - size + 1
    return mixed((total[size:] - total[:n]) * _inverses(n)) if n > 0 else np.zeros(0, np.uint64)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by block-wise minima from both ends."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, place, first start, last start, hash): each anchor with the starts of the strings that name it."""
    width, found = LENGTH - GRAM + 1, []
    for begin in range(0, max(len(data) - LENGTH + 1, 0), _STARTS):
        part = data[begin : begin + _STARTS + LENGTH - 1]
        hashes = rolling(part, GRAM)
        packed = (hashes & ~np.uint64((1 << 20) - 1)) | np.arange(len(hashes), dtype=np.uint64)
        place = (sliding_least(packed, width) & np.uint64((1 << 20) - 1)).astype(np.int64)
        start = np.arange(len(place)) + begin
        text = np.searchsorted(offsets, start, side="right") - 1
        inside = start + LENGTH <= offsets[text + 1]
        start, place, text = start[inside], place[inside], text[inside]
        if len(start):
            first = np.flatnonzero(np.r_[True, (np.diff(place) != 0) | (np.diff(text) != 0)])
            last = np.r_[first[1:], len(start)] - 1
            base = offsets[text[first]]
            found.append((text[first], place[first] + begin - base, start[first] - base, start[last] - base, hashes[place[first]].view(np.int64)))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(c) for c in zip(*found))


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    different = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (different.bit_length() + 7) // 8


class BlindTrie:
    """Orders strings by branching bytes alone: a descent skips what lies between branches, one comparison at the leaf
    tells where the string belongs."""

    def __init__(self):
        self.root: list | None = None  # [depth, {byte: child}] inside, (string, members) at a leaf

    def add(self, string: bytes, member: int) -> None:
        if self.root is None:
            self.root = [None, (string, [member])]
            return
        node = self.root
        while node[0] is not None:
            node = node[1].get(string[node[0] : node[0] + 1]) or next(iter(node[1].values()))
        leaf, members = node[1]
        depth = common(string, leaf)
        if depth == len(string) == len(leaf):
            members.append(member)
            return
        node, holder, mark = self.root, None, b""
        while node[0] is not None and node[0] < depth:
            holder, mark = node, string[node[0] : node[0] + 1]
            node = node[1][mark]
        new = [None, (string, [member])]
        if node[0] == depth:
            node[1][string[depth : depth + 1]] = new
            return
        branch = [depth, {leaf[depth : depth + 1]: node, string[depth : depth + 1]: new}]
        if holder is None:
            self.root = branch
        else:
            holder[1][mark] = branch

    def ordered(self) -> list[int]:
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] is None:
                out += node[1][1]
            else:
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
        return out


def deep_shallow(strings: list[bytes], begin: int = 0, shallow: int = SHALLOW) -> list[int]:
    """Order of ``strings`` that agree in their first ``begin`` bytes."""
    out: list[int] = []
    stack = [(list(range(len(strings))), begin)]
    while stack:
        members, depth = stack.pop()
        if len(members) < 2:
            out += members
        elif depth >= begin + shallow:
            trie = BlindTrie()
            for m in members:
                trie.add(strings[m], m)
            out += trie.ordered()
        else:
            middle = sorted(strings[m][depth : depth + 1] for m in (members[0], members[len(members) // 2], members[-1]))[1]
            less, same, more = [], [], []
            for m in members:
                c = strings[m][depth : depth + 1]
                (less if c < middle else more if c > middle else same).append(m)
            if middle == b"":  # these strings end here: equal
                stack.append((more, depth))
                out += same
            else:
                stack += [(more, depth), (same, depth + 1), (less, depth)]
    return out


def _shared(order: np.ndarray, neighbours: np.ndarray) -> np.ndarray:
    """Common prefix of every two strings: the least among neighbours between them in the order."""
    m = len(order)
    out = np.zeros((m, m), np.int64)
    for i in range(m - 1):
        out[order[i], order[i + 1 :]] = out[order[i + 1 :], order[i]] = np.minimum.accumulate(neighbours[i:])
    return out


def _paired(left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray, found: list[np.ndarray]) -> list[np.ndarray]:
    """Distances repeated by any two surroundings of a small group, from their common text on both sides."""
    begin = np.maximum(LENGTH - right, np.maximum(low[:, None], low))
    end = np.minimum(left, np.minimum(high[:, None], high))
    a, b = np.nonzero((begin <= end) & ~np.eye(len(low), dtype=bool))
    marks = np.zeros((len(low), LENGTH + 2), np.int64)
    np.add.at(marks, (a, begin[a, b]), 1)
    np.add.at(marks, (a, end[a, b] + 1), -1)
    covered = np.cumsum(marks, axis=1)[:, : LENGTH + 1] > 0
    return [np.flatnonzero(f | c) for f, c in zip(found, covered)]


def repeated_starts(left: list[bytes], right: list[bytes], low: list[int], high: list[int], many: list[bool]) -> list[np.ndarray]:
    """For each surrounding of one anchor the distances (from string start to anchor) of its repeated strings.

    ``left`` holds the text before the anchor backwards, ``right`` the text from it on; a surrounding owns the distances
    from ``low`` to ``high``; ``many`` marks those that occur more than once as they are.
    """
    m = len(left)
    found = [np.zeros(LENGTH + 1, bool) for _ in range(m)]
    for i in range(m):
        if many[i]:
            found[i][low[i] : high[i] + 1] = True
    if m > 1:
        classes = []
        for strings, begin in ((left, 0), (right, GRAM)):
            order = deep_shallow(strings, begin)
            shared = np.array([common(strings[a], strings[b]) for a, b in zip(order, order[1:])])
            classes.append((np.array(order), shared))
        (lo, ls), (ro, rs) = classes
        if m <= PAIRED:
            return _paired(_shared(lo, ls), _shared(ro, rs), np.array(low), np.array(high), found)
        low_, high_ = np.array(low), np.array(high)
        for d in range(int(low_.min()), int(high_.max()) + 1):
            owns = (low_ <= d) & (d <= high_)
            if owns.sum() < 2:
                continue
            a, b = np.empty(m, np.int64), np.empty(m, np.int64)
            a[lo], b[ro] = np.r_[0, np.cumsum(ls < d)], np.r_[0, np.cumsum(rs < LENGTH - d)]
            pair = (a * m + b)[owns]
            _, inverse, counts = np.unique(pair, return_inverse=True, return_counts=True)
            for i in np.flatnonzero(owns)[counts[inverse] > 1]:
                found[i][d] = True
    return [np.flatnonzero(f) for f in found]


def _two(left: list[bytes], right: list[bytes], low: list[int], high: list[int], many: list[bool]) -> list[np.ndarray]:
    """``repeated_starts`` of two surroundings, whose order is one comparison."""
    both = np.arange(max(low[0], low[1], LENGTH - common(right[0], right[1])), min(high[0], high[1], common(left[0], left[1])) + 1)
    return [np.arange(low[i], high[i] + 1) if many[i] else both for i in range(2)]


def _keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    base = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return base.withColumn("k", F.xxhash64("doc_id", "text"))


def _anchor_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(1)):
                text, *columns = anchors(data, offsets)
                if len(text):
                    own = batch.column(0).slice(first, last - first).take(pa.array(text))
                    yield pa.RecordBatch.from_arrays([own, *[pa.array(c) for c in columns]], ["k", "place", "low", "high", "h"])

    return docs.select("k", "text").mapInArrow(run, "k long, place long, low long, high long, h long")


def _name(left: bytes, right: bytes, *numbers: int) -> int:
    digest = hashlib.blake2b(left + b"\xff" + right + b"".join(b"\xff%d" % x for x in numbers), digest_size=8)
    return int.from_bytes(digest.digest(), "big", signed=True)


def _surroundings(texts: DataFrame) -> DataFrame:
    """Text around each anchor; ``c`` names equal surroundings."""
    schema = "h long, c long, k long, place long, near long, far long, left binary, right binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                data, columns = text.as_buffer().to_pybytes(), [[] for _ in range(8)]
                for x in places.as_py():
                    p = x["place"]
                    left, right = data[x["low"] : p][::-1], data[p : x["high"] + LENGTH]
                    for column, value in zip(columns, (x["h"], _name(left, right), k, p, p - x["high"], p - x["low"], left, right)):
                        column.append(value)
                kinds = [pa.int64()] * 6 + [pa.binary()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [f.split(" ")[0] for f in schema.split(", ")])

    return texts.mapInArrow(run, schema)


def _sorted_groups(rows: DataFrame) -> DataFrame:
    """Repeated distances of every surrounding; ``rows`` of one anchor stand together."""
    schema = "h long, c long, runs array<struct<a:long,b:long>>"
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def solved(group: list[tuple]) -> Iterator[tuple]:
        h, names, left, right, low, high, n = zip(*group)
        if len(group) == 1:
            if n[0] > 1:
                yield h[0], names[0], [{"a": low[0], "b": high[0]}]
            return
        many = [x > 1 for x in n]
        solve = _two if len(group) == 2 else repeated_starts
        for c, d in zip(names, solve(list(left), list(right), list(low), list(high), many)):
            if len(d):
                cut = np.flatnonzero(np.diff(d) > 1)
                yield h[0], c, [{"a": int(x), "b": int(y)} for x, y in zip(d[np.r_[0, cut + 1]], d[np.r_[cut, len(d) - 1]])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if group and group[0][0] != row[0]:
                    out += solved(group)
                    group = []
                group.append(row)
            if out:
                yield _rows(out)
        if group and (out := list(solved(group))):
            yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), kind))], ["h", "c", "runs"])

    return rows.select("h", "c", "left", "right", "near", "far", "n").mapInArrow(run, schema)


def _pieces(rows: DataFrame, width: int) -> DataFrame:
    """Surroundings cut to blocks of ``width`` distances: ``g`` names the text that all strings of a block cover, with
    the anchor and the block, and ``e`` the text that they reach."""
    schema = "h long, c long, g long, e long, near long, far long, left binary, right binary, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[] for _ in range(9)]
            for h, c, left, right, near, far, n in zip(*(batch.column(i).to_pylist() for i in range(7))):
                for first in range(near - near % width, far + 1, width):
                    low, high = max(near, first), min(far, first + width - 1)
                    l, r = left[:high], right[: LENGTH - low]
                    g = _name(left[:first], right[: LENGTH - first - width + 1], h, first)
                    for column, value in zip(columns, (h, c, g, _name(l, r), low, high, l, r, n)):
                        column.append(value)
            kinds = [pa.int64()] * 6 + [pa.binary()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [f.split(" ")[0] for f in schema.split(", ")])

    return rows.select("h", "c", "left", "right", "near", "far", "n").mapInArrow(run, schema)


def _merged(rows: DataFrame, n: str) -> DataFrame:
    """Equal surroundings (h, c) as one, with the sum of ``n``."""
    texts = [F.first(c).alias(c) for c in ("left", "right", "near", "far")]
    return settle(rows.groupBy("h", "c").agg(F.sum(n).alias("n"), *texts), "merged")


def _solved(merged: DataFrame, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """(h, c, runs): the repeated distances of every surrounding, one row or, for groups that were cut up, several."""
    if not widths:
        return _sorted_groups(merged.repartition("h").sortWithinPartitions("h"))
    sizes = merged.groupBy("h").agg(F.count("*").alias("different"))
    large = settle(sizes.where(F.col("different") > GROUP).select("h"), "large")
    small = merged.join(sizes.where(F.col("different") <= GROUP).select("h"), "h")
    found = _sorted_groups(small.repartition("h").sortWithinPartitions("h"))
    if large.isEmpty():
        return found
    pieces = settle(_pieces(merged.join(large, "h"), widths[0]), "pieces")
    parts = _merged(pieces.select(F.col("g").alias("h"), F.col("e").alias("c"), "n", "left", "right", "near", "far"), "n")
    inner = settle(_solved(parts, widths[1:]), "solved").withColumnsRenamed({"h": "g", "c": "e"})
    return found.unionByName(pieces.select("h", "c", "g", "e").join(inner, ["g", "e"]).select("h", "c", "runs"))


def repeated_spans(keyed: DataFrame) -> DataFrame:
    """(k, spans): the byte intervals of each text that repeated strings cover, not yet merged."""
    found = settle(_anchor_rows(keyed), "anchors")
    twice = found.groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select("h")
    places = settle(found.join(twice, "h").groupBy("k").agg(F.collect_set(F.struct("h", "place", "low", "high")).alias("places")), "places")
    blocks, bits = repeated_blocks(places.select(F.col("k").alias("key")).unionAll(places.select("k")), places.count())
    # a bitmap of the texts with repeated anchors keeps other texts from shuffling; equal rows are one text here
    texts = maybe_repeated(keyed.select("k", "text"), "k", blocks, bits, "_likely").where("_likely").select("k", "text")
    texts = texts.groupBy("k").agg(F.first("text").alias("text"), F.count("*").alias("copies")).join(places, "k")
    around = settle(_surroundings(texts.select("k", F.col("text").cast("binary").alias("text"), "places")), "surroundings")
    copies = settle(texts.where("copies > 1").select("k", "copies"), "copies")
    around_n = around.join(copies, "k", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    solved = _solved(_merged(around_n, "copies"))
    spans = around.select("h", "c", "k", "place").join(solved, ["h", "c"])
    spans = spans.select("k", F.explode("runs").alias("r"), "place").select("k", F.struct((F.col("place") - F.col("r.b")).alias("a"), (F.col("place") - F.col("r.a") + LENGTH).alias("b")).alias("s"))
    return spans.groupBy("k").agg(F.collect_set("s").alias("spans"))


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (merged byte intervals)."""
    keyed = _keyed(docs, text, key)
    spans = settle(repeated_spans(keyed), "spans")
    blocks, bits = repeated_blocks(spans.select(F.col("k").alias("key")).unionAll(spans.select("k")), spans.count())
    flagged = maybe_repeated(keyed, "k", blocks, bits, "_likely")
    empty = F.array().cast("array<struct<a:bigint,b:bigint>>")
    whole = flagged.where("not _likely").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
                                                F.lit(0).cast("long").alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), empty.alias("removed"))
    cut = flagged.where("_likely").join(spans, "k", "left").select("doc_id", F.col("text").cast("binary").alias("text"), F.coalesce("spans", empty).alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<a:long,b:long>>"
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own, text, spans in zip(*(batch.column(i) for i in range(3))):
                data, merged = text.as_buffer().to_pybytes(), []
                for a, b in sorted((s["a"], s["b"]) for s in spans.as_py()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                kept, at = hashlib.sha256(), 0
                for a, b in merged:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                rows.append((own.as_py(), len(data), sum(b - a for a, b in merged), len(merged), kept.hexdigest(), [{"a": a, "b": b} for a, b in merged]))
            if rows:
                kinds = (pa.int64(),) * 4 + (pa.string(), kind)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [f.strip().split(" ")[0] for f in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed")])

    return whole.unionByName(cut.mapInArrow(run, schema))
