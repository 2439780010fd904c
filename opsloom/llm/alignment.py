"""Cross-tokenizer alignment by interval coalescing.

Tokenizer A is a byte-level BPE over a space and the text, tokenizer B a sentencepiece model that adds the space by
itself; strings of special tokens inside a text are plain text. Both give every token a range of bytes. The tokens of A
and B are sorted together by start (``lexsort``); the running maximum of their ends shows where a group breaks: where a
start has reached it. Inside a group each A token is expanded to the B tokens whose ranges it overlaps, the links.

Null and empty texts, and texts whose A or B tokens do not spell the space and the text byte for byte, have no tokens:
counts of zero and '' for the groups. Every row gives one row, repeated rows and doc_ids included. All columns of
``docs`` but the text are kept; added columns whose names they use get a leading underscore.

How often two ids are linked is counted over all rows: rows are cut into chunks (some hundred rows, some megabytes of text, or
one longer text), each chunk gives every pair of ids once with a count, the counts are summed and the sums joined back
to the chunks' pairs. So nothing the size of the vocabularies' product is sent around, and no row of the joins belongs
to a single document or a single frequent pair. Between the passes a chunk keeps its links as compressed numbers of its
pairs; texts are encoded and aligned once.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.common import own_name, widened
from opsloom.session import fresh_dir

#: Words of more characters go to the encoder whose time stays in proportion to them; both give the same ids.
LONG_WORD = 20_000
#: Words whose tokens a Python worker keeps, and new words that are encoded as one text.
KEPT_WORDS, TOGETHER = 200_000, 500
#: Rows of a chunk at most; a chunk is a part of one batch.
CHUNK_ROWS = 400
_TWO_SPACES = re.compile(r"\s\s")
#: The sign that pieces have for a space.
_MARK = "▁"
_NONE = np.zeros(0, np.int64)
#: What follows an id in the list of groups: another of its side, the other side, the next group, nothing.
SIGNS = (",", "|", ";", "")


class ByteLevel:
    """Tokenizer A: a ``tokenizers`` JSON file with byte-level BPE."""

    def __init__(self, source: str):
        import tiktoken

        told = json.loads(source)
        self.source, self.exact = source, None
        self.bytes = byte_entries(told["model"]["vocab"])
        special = {t["id"] for t in told["added_tokens"]}
        # the pattern of byte-level pre-tokenization, a fixed value of the format
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        ranks = {b: i for i, b in enumerate(self.bytes) if b and i not in special}
        self.fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @property
    def slow(self):
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_str(self.source)
            self.exact.encode_special_tokens = True
        return self.exact

    def encode(self, text: str) -> np.ndarray:
        if len(text) > LONG_WORD and max(map(len, text.split()), default=LONG_WORD + 1) > LONG_WORD:
            return np.array(self.slow.encode(f" {text}", add_special_tokens=False).ids, np.int64)
        return self.fast.encode_to_numpy(f" {text}", disallowed_special=()).astype(np.int64)


def byte_entries(vocab: dict[str, int]) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    code = {chr(b): b for b in plain}
    code.update({chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)})
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(code[c] for c in token)
    return out


class Pieces:
    """Tokenizer B: a sentencepiece model."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(self.model.get_piece_size())
        self.bytes = [bytes([int(self.model.id_to_piece(i)[3:5], 16)]) if self.model.is_byte(i) else self.model.id_to_piece(i).replace(_MARK, " ").encode() for i in ids]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


class Aligner:
    """Both tokenizers, what is looked up by id, and the tokens of words seen before.

    No token of either side reaches over a single space between two other characters: A splits before such a space, and
    the pieces of B have the space's sign only in front. So texts whose spaces are all of that kind are put together
    from the tokens of their words, each encoded once with the space before it; other texts are encoded whole.
    """

    def __init__(self, source: str, model: bytes):
        self.a, self.b = ByteLevel(source), Pieces(model)
        self.lengths_a = np.array([len(x) for x in self.a.bytes], np.int64)
        self.lengths_b = np.array([len(x) for x in self.b.bytes], np.int64)
        self.first_b = len(self.a.bytes)
        # "id and what follows it" by 4 * entry + sign, entries of B after those of A: eight bytes, filled up with zeros
        said = [f"{i}{sign}".encode() for n in (len(self.a.bytes), len(self.b.bytes)) for i in range(n) for sign in SIGNS]
        self.said = np.array(said, "S8").view(np.uint64)
        self.said_length = np.array([len(s) for s in said], np.int64)
        self.by_words = all(b" " not in x.lstrip(b" ") for x in self.b.bytes)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pools, self.sizes = [_NONE, _NONE], [_NONE, _NONE]  # tokens of all words, one behind the other; tokens per word

    def whole(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and of B, none where either does not spell the text."""
        spelled = f" {text}".encode()
        a, b = self.a.encode(text), self.b.encode(text)
        # A is over bytes: its tokens spell what they were made from if they are as long
        if self.lengths_a[a].sum() != len(spelled) or b"".join(map(self.b.bytes.__getitem__, b)) != spelled:
            return _NONE, _NONE
        return a, np.array(b, np.int64)

    def _learn(self, words: list[str]) -> None:
        """Encode new words, some in one text; where such a text is not spelled, one by one."""
        found, sizes = ([self.pools[0]], [self.pools[1]]), ([self.sizes[0]], [self.sizes[1]])
        for k in range(0, len(words), TOGETHER):
            part = words[k : k + TOGETHER]
            ids = self.whole(" ".join(part))
            if len(ids[0]):
                ends = np.cumsum([1 + len(w.encode()) for w in part])
                new = [np.diff(np.searchsorted(np.cumsum(n[i]), ends) + 1, prepend=0) for i, n in zip(ids, (self.lengths_a, self.lengths_b))]
            else:
                each = [self.whole(w) for w in part]
                ids = [np.concatenate([x[side] for x in each]) for side in (0, 1)]
                new = [np.array([len(x[side]) for x in each], np.int64) for side in (0, 1)]
            for side in (0, 1):
                found[side].append(ids[side])
                sizes[side].append(new[side])
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.pools, self.sizes = [np.concatenate(x) for x in found], [np.concatenate(x) for x in sizes]

    def _separable(self, text: str) -> bool:
        """Whether all its spaces stand between two other characters, of which none is white space or the sign of a space."""
        if not self.by_words or _MARK in text or text[0].isspace() or text[-1].isspace() or _TWO_SPACES.search(text):
            return False
        return len(text) <= LONG_WORD or max(map(len, text.split(" "))) <= LONG_WORD

    def tokens(self, texts: list[str | None]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Ids of all texts one behind the other, and their numbers per text; of A and of B."""
        if len(self.known) > KEPT_WORDS:
            self.forget()
        by_words = [bool(t) and self._separable(t) for t in texts]
        words = [t.split(" ") if by else [] for t, by in zip(texts, by_words)]
        self._learn([w for w in set().union(*words) if w not in self.known])
        others = [self.whole(t) if t and not by else (_NONE, _NONE) for t, by in zip(texts, by_words)]
        begun = len(self.known)
        numbers = np.fromiter(itertools.chain.from_iterable(map(self.known.__getitem__, w) if by else (begun + i,) for i, (w, by) in enumerate(zip(words, by_words))), np.int64)
        per_text = np.array([len(w) if by else 1 for w, by in zip(words, by_words)], np.int64)
        owner = np.repeat(np.arange(len(texts)), per_text)
        spelled = np.ones(len(texts), bool)
        spelled[owner[np.concatenate([self.sizes[0], np.ones(len(texts), np.int64)])[numbers] == 0]] = False
        numbers, owner = numbers[spelled[owner]], owner[spelled[owner]]
        found, counts = [], []
        for side in (0, 1):
            pool = np.concatenate([self.pools[side], *[x[side] for x in others]])
            sizes = np.concatenate([self.sizes[side], np.array([len(x[side]) for x in others], np.int64)])
            begins = np.cumsum(sizes) - sizes
            taken = sizes[numbers]
            found.append(pool[np.arange(taken.sum()) + np.repeat(begins[numbers] - (np.cumsum(taken) - taken), taken)])
            counts.append(np.bincount(owner, taken, len(texts)).astype(np.int64))
        return tuple(found), tuple(counts)


def coalesced(lengths_a: np.ndarray, lengths_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(group of each A token, group of each B token, number of groups).

    Texts may stand one behind the other: where one ends, all tokens end, so groups do not cross."""
    ends = np.concatenate([np.cumsum(lengths_a), np.cumsum(lengths_b)])
    starts = ends - np.concatenate([lengths_a, lengths_b])
    side = np.repeat(np.array([0, 1], np.int8), [len(lengths_a), len(lengths_b)])
    order = np.lexsort((side, starts))
    reach = np.maximum.accumulate(ends[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = starts[order][1:] >= reach[:-1]
    group = np.cumsum(breaks) - 1
    of_b = side[order] == 1
    return group[~of_b], group[of_b], int(group[-1]) + 1 if len(group) else 0


def linked(lengths_a: np.ndarray, lengths_b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Links as (A token, B token): inside its group, each A token is expanded to the B tokens it overlaps."""
    in_group = np.bincount(of_b, minlength=groups)
    last = np.cumsum(in_group) - 1
    low, high = (last - in_group + 1)[of_a], last[of_a]
    # one A token overlaps all of its group; several share its B tokens by their ranges
    several = np.flatnonzero((np.bincount(of_a, minlength=groups) > 1)[of_a])
    end_a, end_b = np.cumsum(lengths_a), np.cumsum(lengths_b)
    low[several] = np.searchsorted(end_b, end_a[several] - lengths_a[several], side="right")
    high[several] = np.searchsorted(end_b, end_a[several], side="left")
    count = high - low + 1
    return np.repeat(np.arange(len(of_a)), count), np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - low, count)


def listed_groups(aligner: Aligner, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, groups: int, sizes: np.ndarray) -> list[bytes]:
    """The groups of each text, ``a1,a2|b1;a3|b2``; ``sizes`` are the numbers of tokens of both sides per text."""
    in_a, in_b = np.cumsum(np.bincount(of_a, minlength=groups)), np.cumsum(np.bincount(of_b, minlength=groups))
    at_a = np.arange(len(a)) + np.concatenate([[0], in_b])[of_a]
    at_b = np.arange(len(b)) + in_a[of_b]
    entry = np.empty(len(a) + len(b), np.int64)
    entry[at_a], entry[at_b] = 4 * a, 4 * (b + aligner.first_b)
    entry[at_a[in_a - 1]] += 1
    entry[at_b[in_b - 1]] += 2
    ends = np.cumsum(sizes)
    entry[ends[sizes > 0] - 1] += 1
    said = aligner.said[entry].view(np.uint8)
    flat = said[said != 0].tobytes()
    cuts = np.concatenate([[0], np.cumsum(aligner.said_length[entry])])[np.concatenate([[0], ends])].tolist()
    return [flat[x:y] for x, y in zip(cuts, cuts[1:])]


_built: dict[str, Aligner] = {}


def _aligner(key: str, source: str, model: bytes) -> Aligner:
    """One pair of tokenizers per Python worker."""
    if key not in _built:
        _built[key] = Aligner(source, model)
    return _built[key]


def _packed(values: np.ndarray) -> bytes:
    """Numbers byte by byte (all lowest bytes, then the next ones), compressed."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1).astype(np.int64)


def aligned_tokens(docs: DataFrame, byte_level: str, pieces: str, text: str = "text", with_groups: bool = False) -> DataFrame:
    """All columns of ``docs`` but the text, and: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and
    with ``with_groups`` the groups themselves, as ``a1,a2|b1;a3|b2``."""
    spark = docs.sparkSession
    with open(byte_level, encoding="utf-8") as a_file, open(pieces, "rb") as b_file:
        source, model = a_file.read(), b_file.read()
    shared = spark.sparkContext.broadcast((source, model))  # the vocabulary files, some megabytes
    kept = docs.drop(text)
    told = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    names = {n: own_name(kept, n) for n in (*told, "groups", "chunk", "place", "links", "pairs", "counts")}
    path = fresh_dir(spark, "aligned")
    encoded = _encoded(docs, kept, shared, hashlib.sha256(source.encode() + model).hexdigest(), names, text, with_groups)
    encoded.write.parquet(path)
    encoded = spark.read.schema(encoded.schema).parquet(path)
    chunk = encoded.where(F.col(names["pairs"]).isNotNull()).select(F.col(names["chunk"]).alias("chunk"), F.col(names["pairs"]).alias("pairs"), F.col(names["counts"]).alias("counts"))
    counts = pair_counts(chunk.mapInArrow(_chunk_pairs, "chunk long, pair long, n long"))
    looked_up = chunk.mapInArrow(_chunk_pairs, "chunk long, pair long, n long").select("chunk", "pair").join(counts, "pair")
    done = _counted(encoded.drop(names["pairs"], names["counts"]), looked_up, names)
    out = [*kept.columns, *[names[n] for n in told], *([names["groups"]] if with_groups else [])]
    return done.select(*[F.col(f"`{c}`") for c in out])


def _encoded(docs, kept, shared, key: str, names: dict[str, str], text: str, with_groups: bool) -> DataFrame:
    """The rows with all that does not depend on other rows; the first of a chunk has the chunk's links and pairs."""
    types = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string", **({"groups": "string"} if with_groups else {}),
             "chunk": "long", "place": "long", "links": "binary", "pairs": "binary", "counts": "binary"}
    schema = widened(kept, **{names[n]: t for n, t in types.items()})
    arrow = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    carried = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, task = _aligner(key, *shared.value), TaskContext.get().partitionId()
        parts = (batch.slice(k, CHUNK_ROWS) for batch in batches for k in range(0, batch.num_rows, CHUNK_ROWS))
        for number, batch in enumerate(parts):
            rows = batch.num_rows
            (a, b), (n_a, n_b) = aligner.tokens(batch.column(text).to_pylist())
            lengths_a, lengths_b = aligner.lengths_a[a], aligner.lengths_b[b]
            of_a, of_b, groups = coalesced(lengths_a, lengths_b)
            texts = listed_groups(aligner, a, b, of_a, of_b, groups, n_a + n_b) if groups else [b""] * rows
            ends = np.concatenate([[-1], of_b])[np.cumsum(n_b)] + 1  # groups up to the end of each text
            n_groups = np.diff(ends, prepend=0)
            at, to = linked(lengths_a, lengths_b, of_a, of_b, groups)
            pair = (b[to] << 32) | a[at]
            pairs, counts = np.unique(pair, return_counts=True)
            first = [None] * (rows - 1)
            columns = {
                "n_a": n_a, "n_b": n_b, "n_groups": n_groups,
                "n_links": n_a + n_b - n_groups,  # the tokens of a group overlap as a path, one link shorter than their number
                "groups_sha256": [hashlib.sha256(t).hexdigest() if t else "" for t in texts], "groups": [t.decode() for t in texts] if with_groups else None,
                "chunk": np.full(rows, (task << 32) | number), "place": np.arange(rows), "links": [_packed(np.searchsorted(pairs, pair)), *first],
                "pairs": [_packed(np.diff(pairs, prepend=0)), *first], "counts": [_packed(counts), *first],
            }
            arrays = [pa.array(columns[n], arrow[t]) for n, t in types.items()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], *arrays], [f.name for f in schema])

    return docs.mapInArrow(run, schema)


def _chunk_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, pair, n): each pair of ids that a chunk links."""
    for batch in batches:
        for chunk, pairs, counts in zip(*[c.to_pylist() for c in batch.columns]):
            pair, n = np.cumsum(_unpacked(pairs)), _unpacked(counts)
            for k in range(0, len(pair), 1 << 16):
                part = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair[part]), chunk)), pa.array(pair[part]), pa.array(n[part])], ["chunk", "pair", "n"])


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, count, best): links of all rows per pair of ids, and whether no pair of the same B id has more."""
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count"))
    most = counts.groupBy(F.shiftright("pair", 32).alias("b")).agg(F.max("count").alias("most"))
    return counts.join(most, F.shiftright("pair", 32) == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _counted(encoded: DataFrame, looked_up: DataFrame, names: dict[str, str]) -> DataFrame:
    """The rows of each chunk with n_best and count_sum, from the counts of the chunk's pairs."""
    schema = widened(encoded.drop(names["links"], names["place"]), **{names["n_best"]: "long", names["count_sum"]: "long"})
    place, links, n_links = names["place"], names["links"], names["n_links"]
    added = names["n_best"], names["count_sum"]

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        rows = rows.sort_by(place)
        order = np.argsort(found.column("pair").to_numpy())
        number = _unpacked(rows.column(links)[0].as_py())
        ends = np.concatenate([[0], np.cumsum(rows.column(n_links).to_numpy())])
        rows = rows.drop_columns([place, links])
        for name, column in zip(added, ("best", "count")):
            value = found.column(column).to_numpy()[order].astype(np.int64)[number]
            rows = rows.append_column(name, pa.array(np.diff(np.concatenate([[0], np.cumsum(value)])[ends])))
        return rows

    return encoded.groupBy(names["chunk"]).cogroup(looked_up.groupBy("chunk")).applyInArrow(run, schema)
