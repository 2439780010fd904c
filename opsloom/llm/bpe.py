"""BPE encoding and decoding with a tokenization automaton.

The merges are compiled, in their order, into a deterministic automaton over tokens. It begins with one state in
which every single symbol may follow. The gadget of a merge ``(a, b)`` gives the state reached by ``a`` a successor
without the arc ``b``, and adds the arc ``ab`` wherever ``a`` could be taken, leading to the state that ``b`` led to
at that time. What the automaton accepts is exactly the token sequences that merging would produce, one per word, so
a word is encoded by following table entries; no merge is replayed. Decoding emits the labels of the arcs.

A state that a gadget makes differs from its origin by one arc, so states are kept as chains of cuts and an arc is
resolved along the chain when it is first taken; the answer goes into the transition table.

Words are read once, symbol by symbol, by a trie of all arcs' labels with failure links, which gives the arcs that end
at each place. As the path of a word's beginning is the beginning of some path, each place has one last arc: the one
that the state before it lets through. The word's path is read off from its end; nothing is tried twice.

Null texts count as empty and give no tokens. Added tokens (``<|endoftext|>``) are recognised in the raw text.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from opsloom.llm.common import own_name, widened

#: Words that a Python worker keeps, alone and with what stands beside them without a space, and their most characters.
KEPT_WORDS, KEPT_SIZE = 200_000, 48
#: The same where the executor's memory is wanted by other stages.
FEW_WORDS = 50_000
#: Entries of the transition table that are kept.
KEPT_ARCS = 200_000
#: Separators that ``str.split`` takes for white space and the pattern does not.
_NO_SPACE = "\x1c\x1d\x1e\x1f"


def _byte_symbols() -> list[str]:
    """The printable symbol of each byte: itself where it is printable, else the next code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in symbols:
            symbols[b], extra = chr(extra), extra + 1
    return [symbols[b] for b in range(256)]


#: Stands for the end of a word; no byte has it as its symbol.
END = "\0"


class Automaton:
    """Compiled merges. ``vocab`` maps token strings to ids, ``merges`` are pairs of token strings in rank order."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        self.labels = {i: t for t, i in vocab.items()}
        self.end, self.table = end, {}
        self.born: dict[int, int] = {}  # token -> number of the gadget that added its arc
        self.parts: dict[int, tuple[int, int]] = {}
        self.cut: dict[tuple[int, int], int] = {}  # (token a, token b) -> gadget that took arc b out of the state after a
        made = {a + b for a, b in merges}
        self.inner: dict[str, int] = {}
        self.last: dict[str, int] = {} if end else self.inner  # tokens at the end of a word
        for token, i in vocab.items():
            if token not in made:
                self._arc(token, i)
        for number, (a, b) in enumerate(merges, 1):
            self._gadget(number, vocab[a], vocab[b], a + b, vocab[a + b])
        # labels of the arcs, those at the end of a word with a sign for the end, read by failure links
        self.trie = ahocorasick.Automaton()
        self.sign = END if end else ""
        self.ids = [*range(-1, max(self.labels, default=-1) + 1)]  # by arc: words share these numbers
        for token, i in self.inner.items():
            self.trie.add_word(token, (len(token), i + 1))
        for token, i in self.last.items() if end else ():
            self.trie.add_word(token + END, (len(token) + 1, i + 1))
        if len(self.trie):
            self.trie.make_automaton()

    def _arc(self, token: str, i: int) -> None:
        self.born.setdefault(i, 0)
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            self.last[token.removesuffix(self.end)] = i
        else:
            self.inner[token] = i

    def _gadget(self, number: int, a: int, b: int, token: str, i: int) -> None:
        if a not in self.born or b not in self.born or not self._open(a, b, number - 1):
            return  # no state has the arc b after a: the merge can never apply
        self.cut.setdefault((a, b), number)
        if i not in self.born:
            self.born[i], self.parts[i] = number, (a, b)
            self._arc(token, i)

    def _open(self, a: int, b: int, upto: int) -> bool:
        """Whether the state after ``a`` has the arc ``b`` once the gadgets up to ``upto`` are in place."""
        while True:
            if self.cut.get((a, b), upto + 1) <= upto:
                return False
            since_a, since_b = self.born[a], self.born[b]
            if since_a == since_b == 0:
                return True
            if since_a > since_b:  # the state after a began as the state after its right part, before that gadget
                upto, a = since_a - 1, self.parts[a][1]
            else:  # the arc b was added where its left part could be taken, with that gadget's cut
                upto, b = since_b, self.parts[b][0]

    def follows(self, a: int, b: int) -> bool:
        """Fill a transition table entry, one number for two arcs (numbered from 1): whether the second may follow."""
        if len(self.table) >= KEPT_ARCS:
            self.table.clear()
        known = self.table[a << 32 | b] = self._open(a - 1, b - 1, 1 << 60)
        return known

    def encode(self, word: str) -> list[int]:
        """Tokens of one word of byte symbols: the only path of the automaton that spells it."""
        if not word:
            return []
        word += self.sign
        known, follows, ids = self.table.get, self.follows, self.ids
        arc: list[int] = [0] * (len(word) + 1)  # the last arc of the path up to each place, numbered from 1; 0 is none
        size = [0] * (len(word) + 1)
        for end, (length, token) in self.trie.iter(word):
            end += 1
            if arc[end]:
                continue
            if length != end:
                before = arc[end - length]
                if not before:
                    continue
                open_ = known(before << 32 | token)
                if not (follows(before, token) if open_ is None else open_):
                    continue
            arc[end], size[end] = token, length
        path, at = [], len(word)
        while at:
            if not arc[at]:
                raise ValueError(f"a symbol of {word!r} is not in the vocabulary")
            path.append(ids[arc[at]])
            at -= size[at]
        return path[::-1]


class Known(dict):
    """Ids by what stands between two spaces; one that is missing is asked from its tokenizer."""

    def __init__(self, tokenizer: Tokenizer):
        self.ids_of = tokenizer.chunk_ids

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        return self.ids_of(chunk)


class Tokenizer:
    """A ``tokenizers`` JSON file with byte-level BPE, word ends, lower case and dropped white space."""

    def __init__(self, source: dict, lower: dict[int, str] | None = None, classed: dict[int, str] | None = None, kept_words: int = KEPT_WORDS):
        self.lower, self.classed = lower or {}, classed or {}
        model = source["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.labels = dict(self.automaton.labels)
        self.kept_words = kept_words
        self.added = {t["content"]: t["id"] for t in source.get("added_tokens", [])}
        self.labels.update({i: t for t, i in self.added.items()})
        pattern = source["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.symbols = dict(enumerate(_byte_symbols()))
        # what stood between two spaces, and single words: two generations, those seen last stay
        self.known = Known(self)
        self.older: dict[str, tuple[int, ...]] = {}
        self.numbers = [str(i) for i in range(max(self.labels) + 1)]
        self.listed = [self.labels.get(i, "") for i in range(len(self.numbers))]

    def spelled(self, word: str) -> str:
        if word.isascii() and word.isprintable():
            return word
        return word.encode("utf-8").decode("latin-1").translate(self.symbols)

    @staticmethod
    def normal(text: str) -> str:
        if text.isascii():
            return text.lower()
        # lower case by single characters, so that a final sigma is no special case
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def split_words(self, chunk: str) -> list[str]:
        """Words by the classes of the library: characters that Python's tables class otherwise stand in for their class."""
        chunk = chunk.translate(self.lower)
        return [chunk[a:b] for a, b in (m.span() for m in self.words.finditer(chunk.translate(self.classed)))]

    def word_ids(self, word: str) -> tuple[int, ...]:
        return tuple(self.automaton.encode(self.spelled(word)))

    def chunk_ids(self, chunk: str) -> tuple[int, ...]:
        """Tokens of what stands between two spaces and is not among the words seen last."""
        found = self.older.get(chunk)
        if found is None:
            if chunk.isalpha():  # letters that Python knows: one word
                found = self.word_ids(chunk)
            else:
                words = self.words.findall(chunk) if chunk.isascii() else self.split_words(chunk)
                # a word that is split again is itself
                found = self.word_ids(words[0]) if len(words) == 1 else tuple(chain.from_iterable([self.known[w] for w in words]))
        if len(chunk) <= KEPT_SIZE:
            self.known[chunk] = found
        return found

    def encode(self, text: str | None) -> list[int]:
        """Tokens of a text. No word holds white space, so chunks between spaces are split alone."""
        text = text or ""
        pieces = self.split_added.split(text) if self.split_added and "<" in text else [text]
        found: list[int] = []
        for piece in pieces:
            if piece in self.added:
                found.append(self.added[piece])
                continue
            piece = self.normal(piece)
            chunks = piece.split(" ") if any([c in piece for c in _NO_SPACE]) else piece.split()
            for k in range(0, len(chunks), self.kept_words):
                found.extend(chain.from_iterable(map(self.known.__getitem__, chunks[k : k + self.kept_words])))
                if len(self.known) >= self.kept_words:
                    self.older, self.known = self.known, Known(self)
        return found

    def written(self, ids: list[int]) -> str:
        return " ".join(map(self.numbers.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs that the ids stand for."""
        return " ".join(map(self.listed.__getitem__, ids))


def read_source(path: str) -> str:
    """The vocabulary file, read on the driver and sent with the tasks (about 2 MB for 49,000 tokens)."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def newer_characters(source: str) -> tuple[dict[int, str], dict[int, str]]:
    """How the ``tokenizers`` library takes characters that Python's own Unicode tables do not have yet.

    (lower case, character of the same class) by code point, asked from the library once, on the driver, for those
    characters that the ``regex`` module calls letters or numbers and ``unicodedata`` does not know.
    """
    from tokenizers import Tokenizer as Library

    library, letter, number = Library.from_str(source), regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
    doubtful = [c for c in map(chr, range(128, 0x110000)) if unicodedata.category(c) == "Cn" and (letter.match(c) or number.match(c))]
    lower = {ord(c): low for c in doubtful if (low := library.normalizer.normalize_str(c)) != Tokenizer.normal(c) and len(low) == 1}
    classed = {}
    # between two x a letter joins them; twice between two x, a number gives two words and any other character one
    for c, (begin, between) in zip(doubtful, _boundaries(library, doubtful)):
        kind = "a" if not begin else "1" if between else "!"
        if kind != ("a" if letter.match(c) else "1"):
            classed[ord(c)] = kind
    return lower, classed


def _boundaries(library, characters: list[str]) -> list[tuple[bool, bool]]:
    """Whether a word begins at the first, and at the second of two equal characters after an x."""
    begun = {a for _, (a, _) in library.pre_tokenizer.pre_tokenize_str("".join(f"x{c}{c}" for c in characters) + "x")}
    return [(3 * i + 1 in begun, 3 * i + 2 in begun) for i in range(len(characters))]


_built: dict[str, Tokenizer] = {}


def tokenizer_of(source: str, key: str, lower: dict[int, str], classed: dict[int, str], kept_words: int = KEPT_WORDS) -> Tokenizer:
    """One automaton per Python worker and vocabulary."""
    if key not in _built:
        _built[key] = Tokenizer(json.loads(source), lower, classed)
    _built[key].kept_words = kept_words
    return _built[key]


def forget(key: str) -> None:
    """Let go of this worker's automaton and words, and of the memory that Arrow holds for more batches."""
    tokenizer = _built.pop(key, None)
    if tokenizer:
        tokenizer.known = tokenizer.older = {}  # they name each other
    pa.default_memory_pool().release_unused()


def bpe_encode(docs: DataFrame, path: str, text: str = "text", with_ids: bool = False, keep_words: bool = True) -> DataFrame:
    """All columns of ``docs`` and, per row: n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` the ids.

    Output columns whose names ``docs`` already uses get a leading underscore. No row is dropped; repeated rows give
    repeated results. Texts are worked on one by one; only the tokens of single words are kept between them. Python
    workers outlive a task: without ``keep_words`` a task keeps ``FEW_WORDS`` instead of ``KEPT_WORDS`` words, and lets go
    of them and of its automaton at its end, so that jobs that follow do not find the executor's memory taken.
    """
    source = read_source(path)
    key = hashlib.sha256(source.encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast((source, key, *newer_characters(source)))
    names = [own_name(docs, n) for n in ("n_tokens", "ids_sha256", "decoded_sha256", "token_ids")[: 4 if with_ids else 3]]
    schema = widened(docs, **dict(zip(names, ("long", "string", "string", "array<int>"))))
    types = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()))

    def coded(batches: Iterator[pa.RecordBatch], tokenizer: Tokenizer) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[] for _ in names]
            for value in batch.column(text):
                ids = tokenizer.encode(value.as_py())
                columns[0].append(len(ids))
                columns[1].append(hashlib.sha256(tokenizer.written(ids).encode()).hexdigest())
                columns[2].append(hashlib.sha256(tokenizer.decode(ids).encode()).hexdigest())
                if with_ids:
                    columns[3].append(np.array(ids, np.int32))
            made = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from coded(batches, tokenizer_of(*shared.value, KEPT_WORDS if keep_words else FEW_WORDS))
        finally:
            if not keep_words:
                forget(key)

    return docs.mapInArrow(run, schema)
