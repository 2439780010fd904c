"""Conversation structure repair: Wagner-Fischer alignment of turns with the alternating grammar ``(s?(ua)+)?``.

For every length that the grammar allows there is one target string (``uaua..`` or ``suaua..``). Turns are aligned
with each of them: keep 0, change the role to user or assistant 1, delete 2, insert an empty turn 5, and 5 more for a
truncated turn that stays; blank and repeated turns must go. Targets that end alike share their last letters, so one
table, indexed by turns and letters that are left, holds the alignments with all lengths; it is filled only inside the
Ukkonen band that the cost of a plain repair, the incumbent, leaves open. For every length of least cost the audit that
is least in ASCII order is traced back, and the audits are compared.

Long conversations are cut into blocks of consecutive turns, so that tables stay small and blocks are aligned in
parallel: a block is aligned for each letter that may stand before it and after it, and the blocks of a conversation
are then chained by cost and, where costs tie, by audit. An insertion belongs to the turn that follows it; so audits
of one block that end after different letters differ before either ends, and the comparison is never left open.

Order: turns ascending, nulls first; rows of one turn by the first letter of their role, then by a digest of role and
text. Null roles and texts count as one space; a null conv_id is a conversation of its own. Equal rows count as often
as they stand. Only per-turn marks are sorted and aligned; texts are shuffled once, by conversation, and read as a
stream to hash what is kept. Further columns of ``conversations`` do not matter. No rows give no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom.session import settle

KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: Turns of a block.
BLOCK = 1000
#: Alignments a worker remembers, by the marks and faults of a block.
REMEMBERED = 50_000
_SPACE = " \t\n\x0b\x0c\r"
_FAR = 1 << 40
#: What may stand before a block (nothing, s, u, a), and after it.
PAIRS = ("00", "0s", "0u", "0a", "ss", "su", "sa", "uu", "ua", "au", "aa")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage: conv_id, turn, role, text, times (0, 1 or 2), mark (first letter of the role), digest and fault."""
    known = {n: F.coalesce(F.col(n).cast("string"), F.lit(" ")) for n in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(known["conv_id"], F.lit(":"), known["turn"]).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(known["text"], ".!?", "")).otherwise(known["text"])
    rows = conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(known["role"]).alias("role"), text.alias("text"),
                                F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("times"))
    ended = F.rtrim(F.col("text"), F.lit(_SPACE))
    fault = F.when(ended == "", "b").when(F.right(ended, F.lit(1)).isin(".", "!", "?"), "-").otherwise("t")
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    return rows.withColumns({"mark": F.substring("role", 1, 1), "digest": digest, "fault": fault})


def marked(rows: DataFrame) -> DataFrame:
    """One row per conversation, turn and text: mark, fault, times, and ``later`` where role and text were seen in an earlier turn."""
    keys = ["conv_id", "turn", "mark", "digest", "fault"]
    found = rows.groupBy(*keys).agg(F.sum("times").alias("times"))
    first = found.where("times > 0").groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("turn").isNotNull().alias("k"), F.col("turn").alias("t"))).alias("f"))
    again = first.where("n > 1").select("c", "d", "f")
    joined = found.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    return joined.select(*keys, "times", (F.col("f").isNotNull() & ~F.col("turn").eqNullSafe(F.col("f.t"))).alias("later"))


def _table(marks: str, faults: str, last: str, most: int) -> tuple[np.ndarray, int]:
    """(T, width of the band below): T[i, k - (n - i) + below] is the least cost of aligning the turns from i on with the
    k last letters of the alternating string that ends in ``last``, for all alignments that cost up to ``most``."""
    n, below, above = len(marks), most // DELETE, most // INSERT
    table = np.full((n + 1, below + above + 1), _FAR, np.int64)
    table[n, below] = 0  # an insertion belongs to the turn that follows it: none after the last
    shift = np.arange(below + above + 1)
    stay = np.array([[_FAR if f in "bd" else (KEEP if m == letter else REROLE) + (CUT if f == "t" else 0) for m, f in zip(marks, faults)] for letter in "ua"])
    odd, even = (0, 1) if last == "u" else (1, 0)  # row of ``stay`` for an odd and an even number of letters left
    for i in range(n - 1, -1, -1):
        left = shift + (n - i - below)
        cost = np.where(left >= 1, table[i + 1] + np.where(left & 1, stay[odd, i], stay[even, i]), _FAR)
        cost[:-1] = np.minimum(cost[:-1], table[i + 1, 1:] + DELETE)
        cost[left < 0] = _FAR
        table[i] = np.minimum(np.minimum.accumulate(cost - INSERT * shift) + INSERT * shift, _FAR)
    return table, below


def _traced(tables: dict, marks: str, faults: str, last: str, i: int, k: int) -> str:
    """The ASCII-least audit of least cost for the turns from i on and the k last letters."""
    (table, below), n, out = tables[last], len(marks), []
    other = "a" if last == "u" else "u"

    def at(i: int, k: int) -> int:
        d = k - (n - i) + below
        return int(table[i, d]) if 0 <= d < table.shape[1] else _FAR

    while i < n or k:
        here = at(i, k)
        if i < n and at(i + 1, k) + DELETE == here:
            out.append("D")
            i += 1
        elif k and at(i, k - 1) + INSERT == here:
            out.append("I")
            k -= 1
        else:
            out.append("K" if marks[i] == (last if k & 1 else other) else "R")
            i, k = i + 1, k - 1
    return "".join(out)


def _plain_repair(marks: str, faults: str) -> int:
    """Cost of one allowed repair: faulty turns go, other roles are made to fit, a missing answer is added."""
    cost, before = 0, "0"
    for m, f in zip(marks, faults):
        if f != "-":
            cost += DELETE
        elif m == "s" and before == "0":
            before = "s"
        else:
            fits = "a" if before == "u" else "u"
            cost, before = cost + (KEEP if m == fits else REROLE), fits
    return cost + {"0": 0, "s": 2 * INSERT, "u": INSERT, "a": 0}[before]


def align(marks: str, faults: str, pairs: tuple[str, ...] = PAIRS) -> dict[str, tuple[int, str]]:
    """Per pair of letters before and after: (least cost, ASCII-least audit), for the pairs that any alignment has."""
    n, most = len(marks), _plain_repair(marks, faults)
    limit = DELETE * n + 2 * INSERT
    if len(pairs) > 4:
        most += 2 * INSERT
    while True:
        most = min(most, limit)
        tables = {q: _table(marks, faults, q, most) for q in "ua"}
        found = {p: _best(tables, marks, faults, p[0], p[1]) for p in pairs}
        if len(pairs) <= 4 or most == limit or max(c for c, _ in found.values() if c < _FAR) <= most:
            break  # all alignments that cost up to ``most`` stay inside the band
        most *= 2
    return {p: (c, min(tell() for tell in audits)) for p, (c, audits) in found.items() if c < _FAR}


def _best(tables: dict, marks: str, faults: str, before: str, after: str) -> tuple[int, list]:
    """Least cost over all feasible lengths, and how to trace each alignment that has it."""
    n, options = len(marks), []
    if before == after:
        options.append((DELETE * n, lambda: "D" * n))

    def lengths(i: int, from_letter: str, prefix: str, cost: int) -> None:
        if after not in tables:
            return
        table, below = tables[after]
        left = np.arange(table.shape[1]) + (n - i - below)
        fits = (left >= 1) & ((left & 1) == (1 if from_letter == after else 0))
        costs = table[i][fits]
        if len(costs) and costs.min() < _FAR:
            for k in left[fits][costs == costs.min()].tolist():
                options.append((cost + int(costs.min()), lambda k=k: prefix + _traced(tables, marks, faults, after, i, k)))

    lengths(0, "a" if before == "u" else "u", "", 0)
    if before == "0":
        for i in [i for i in range(n) if marks[i] == "s" and faults[i] in "-t"]:
            cost = DELETE * i + KEEP + (CUT if faults[i] == "t" else 0)
            if after == "s":
                options.append((cost + DELETE * (n - i - 1), lambda i=i: "D" * i + "K" + "D" * (n - i - 1)))
            lengths(i + 1, "u", "D" * i + "K", cost)
    best = min((c for c, _ in options), default=_FAR)
    return best, [tell for c, tell in options if c == best]


def chained(blocks: list[dict[str, tuple[int, str]]]) -> tuple[int, str]:
    """Least cost and ASCII-least audit of the blocks of a conversation, one after the other."""
    reached, back = {"0": (0, 0)}, []  # letter -> (cost, rank of its audit among the audits up to here)
    for block in blocks:
        come: dict[str, tuple[int, int, str]] = {}
        for pair, (cost, _) in block.items():
            if pair[0] in reached:
                way = (reached[pair[0]][0] + cost, reached[pair[0]][1], pair[0])
                come[pair[1]] = min(come.get(pair[1], way), way)
        order = sorted(come, key=lambda q: (come[q][1], block[come[q][2] + q][1]))
        reached = {q: (come[q][0], rank) for rank, q in enumerate(order)}
        back.append({q: come[q][2] for q in come})
    ends = {"0": (0, ""), "s": (2 * INSERT, "II"), "u": (INSERT, "I"), "a": (0, "")}
    cost, _, at = min((c + ends[q][0], rank, q) for q, (c, rank) in reached.items())
    audit = [ends[at][1]]
    for block, came in zip(reversed(blocks), reversed(back)):
        audit.append(block[came[at] + at][1])
        at = came[at]
    return cost, "".join(reversed(audit))


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows in order, range partitioned, as one row per block of turns: its counts and its alignments."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "turn", "mark", "digest"]
    placed = rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).select("conv_id", "turn", "mark", "fault", "times", "later")
    schema = T._parse_datatype_string(f"conv_id {kind}, part int, place long, payload string")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, remembered = TaskContext.get().partitionId(), 0, {}
        out: list[tuple] = []
        block, key, whole, kinds = _Block(), None, False, None

        def close(ends: bool) -> None:
            nonlocal place, block, whole
            out.append((key[0], part, place, block.payload(remembered, whole and ends)))
            place, block, whole = place + 1, _Block(), ends

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((),) * 4, kinds)], names)

        for batch in batches:
            kinds = (batch.schema.field("conv_id").type, pa.int32(), pa.int64(), pa.string())
            for conv, turn, mark, fault, times, later in zip(*[c.to_pylist() for c in batch.columns]):
                if key is not None and key[0] != conv:
                    close(True)
                if key is None or key[0] != conv:
                    key = (conv,)
                for copy in range(times):
                    if len(block.marks) == BLOCK:
                        close(False)
                    block.add(turn, mark, fault if fault == "b" or not (later or copy) else "d")
            yield told()
            out.clear()
        if key is not None:
            close(False)
            yield told()

    return placed.mapInArrow(run, schema)


class _Block:
    """Consecutive turns of one conversation."""

    def __init__(self):
        self.marks: list[str] = []
        self.faults: list[str] = []
        self.turns: list[int | None] = [None, None, 0]  # first, last, number of different ones; nulls left out

    def add(self, turn: int | None, mark: str, fault: str) -> None:
        self.marks.append(mark if mark in ("s", "u", "a") else "-")
        self.faults.append(fault)
        if turn is not None and turn != self.turns[1]:
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn, self.turns[2] + 1]

    def payload(self, remembered: dict, whole: bool) -> str:
        marks, faults = "".join(self.marks), "".join(self.faults)
        found = remembered.get((marks, faults, whole))
        if found is None:
            if len(remembered) >= REMEMBERED:
                remembered.clear()
            illegal = sum(1 for a, b in zip(marks, marks[1:]) if a + b not in ("su", "ua", "au"))
            counts = [faults.count("b"), faults.count("d"), faults.count("t"), illegal]
            found = remembered[marks, faults, whole] = json.dumps([marks[:1], marks[-1:], counts, align(marks, faults, PAIRS[:4] if whole else PAIRS)])[1:]
        return "[" + json.dumps(self.turns) + ", " + found


class _Repair:
    """One conversation: its blocks, then its turns in the same order."""

    def __init__(self, conv):
        self.conv, self.blocks, self.hash, self.audit, self.at = conv, [], hashlib.sha256(), None, 0
        self.before, self.any = "0", False

    def begin(self) -> None:
        counts, first, last, number, before = [0, 0, 0, 0], None, None, 0, ""
        for (low, high, different), begins, ends, inside, _ in self.blocks:
            counts = [a + b for a, b in zip(counts, inside)]
            counts[3] += bool(before and begins) and before + begins not in ("su", "ua", "au")
            before = ends or before
            if low is not None:
                number += different - (last == low)
                first, last = (low if first is None else first), high
        self.row = [0 if first is None else last - first + 1 - number, *counts]
        self.cost, self.audit = chained([{p: tuple(v) for p, v in b[4].items()} for b in self.blocks])
        self.blocks = []

    def _say(self, line: str) -> None:
        self.hash.update((("\n" if self.any else "") + line).encode())
        self.any = True

    def _insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.before, self.at = "a" if self.before == "u" else "u", self.at + 1
            self._say("user:" if self.before == "u" else "assistant:")

    def turn(self, role: str, text: str) -> None:
        self._insert()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.before = role[0]
            self._say(f"{role}:{text}")
        elif edit == "R":
            self.before = "a" if self.before == "u" else "u"
            self._say(f"{'user' if self.before == 'u' else 'assistant'}:{text}")

    def told(self) -> tuple:
        self._insert()
        return (self.conv, *self.row, self.cost, self.audit, self.hash.hexdigest())


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of the damaged and repaired rows."""
    rows = damaged(conversations)
    blocks = settle(_blocks(settle(marked(rows), "marked")), "blocks")
    # where two blocks of a conversation come from two partitions, the partitions are in order too
    kind, turn_kind = rows.schema["conv_id"].dataType.simpleString(), rows.schema["turn"].dataType.simpleString()
    no = lambda t: F.lit(None).cast(t)
    told = blocks.select("conv_id", F.lit(0).alias("kind"), "part", "place", no(turn_kind).alias("turn"), no("string").alias("mark"), no("binary").alias("digest"),
                         no("long").alias("times"), no("string").alias("role"), F.col("payload").alias("text"))
    turns = rows.where("times > 0").select("conv_id", F.lit(1).alias("kind"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("place"), "turn", "mark", "digest", "times", "role", "text")
    order = ["conv_id", "kind", "part", "place", "turn", "mark", "digest"]
    both = told.unionByName(turns).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "kind", "times", "role", "text")
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = T._parse_datatype_string(f"conv_id {kind}, {', '.join(f'{n} long' for n in names)}, audit string, repaired_sha256 string")
    columns = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kinds, out = None, (), []

        def close() -> None:
            if now.audit is None:
                now.begin()
            out.append(now.told())

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], columns)

        for batch in batches:
            kinds = (batch.schema.field("conv_id").type, *(pa.int64(),) * 6, pa.string(), pa.string())
            for conv, is_turn, times, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                if now is None or now.conv != conv:
                    if now is not None:
                        close()
                    now = _Repair(conv)
                if not is_turn:
                    now.blocks.append(json.loads(text))
                    continue
                if now.audit is None:
                    now.begin()
                for _ in range(times):
                    now.turn(role, text)
            if out:
                yield told()
                out.clear()
        if now is not None:
            close()
            yield told()

    return both.mapInArrow(run, schema)
