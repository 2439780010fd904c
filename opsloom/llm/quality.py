"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word falls into one of ``WORD_CELLS`` cells (a lower-case word by its hash; any other word by its character
classes, its length class and whether it repeats one of the words before it). Each cell owns a sparse random index
vector; the vector of a cell is the sum of the index vectors of the words around its occurrences in the whole corpus.
A document is the mean of its words' vectors. The network is trained on at most ``max_labelled`` labelled rows (the
ones with the smallest hash of doc_id) and its temperature is fitted on a fifth of them.

Null and empty texts are the zero vector and get the network's score for it. Without labelled rows of both kinds every
score is 1. Rows keep all their columns; names that clash get a leading underscore.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.common import cell_batches, mixed, own_name, slices, summed_cells, widened, word_hashes

WORD_CELLS = 8192
WIDTH = 32
#: Neighbours on each side whose index vectors a word collects, and entries of an index vector that are not zero.
REACH, ENTRIES = 2, 2


def _byte_classes() -> np.ndarray:
    classes = np.full(256, 8, np.uint8)
    for codes, bit in ((range(97, 123), 1), (range(65, 91), 2), (range(48, 58), 4), (map(ord, "!?"), 16),
                       (map(ord, "%$#&*@^~"), 32), (map(ord, "|<>/\\=_{}[]"), 64), (range(128, 256), 128)):
        classes[list(codes)] = bit
    return classes


CLASSES = _byte_classes()


def word_cells(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each word, and the offsets of words per text."""
    hashes, ends = word_hashes(data, offsets)
    if not len(hashes):
        return np.zeros(0, np.int64), ends
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begins = ~space
    begins[1:] &= space[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    begins[at] = ~space[at]
    starts = np.flatnonzero(begins)
    classes = np.where(space, 0, CLASSES[data])
    mask = np.bitwise_or.reduceat(classes[starts[0] :], starts - starts[0]).astype(np.int64)
    length = np.add.reduceat((~space)[starts[0] :], starts - starts[0], dtype=np.int64)
    again = np.zeros(len(hashes), np.int64)
    again[1:] = hashes[1:] == hashes[:-1]
    plain = ((mask & 0b01110110) == 0) & (again == 0)
    shape = mask | (np.minimum(length // 4, 3) << 8) | (again << 10)
    return np.where(plain, 4096 + (hashes & np.uint64(4095)).astype(np.int64), shape), ends


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(positions, signs) of the entries of each cell's index vector."""
    seeds = mixed(np.arange(WORD_CELLS * ENTRIES, dtype=np.uint64).reshape(WORD_CELLS, ENTRIES) + np.uint64(77))
    return (seeds % np.uint64(WIDTH)).astype(np.int64), np.where(seeds >> np.uint64(63), 1, -1).astype(np.int64)


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Vector of each cell from all texts. Integer sums, so the result does not depend on how rows are dealt."""
    cells = WORD_CELLS * WIDTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positions, signs = index_vectors()
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                words, ends = word_cells(data, offsets)
                owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
                for step in range(1, REACH + 1):
                    same = owner[step:] == owner[:-step]
                    left, right = words[:-step][same], words[step:][same]
                    for a, b in ((left, right), (right, left)):
                        for k in range(ENTRIES):
                            total += np.bincount(a * WIDTH + positions[b, k], signs[b, k], cells).astype(np.int64)
        yield from cell_batches(total)

    parts = docs.select(F.col(text).cast("string")).mapInArrow(run, "cell long, value long")
    vectors = summed_cells(parts, cells).reshape(WORD_CELLS, WIDTH).astype(np.float32)
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1)


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    words, ends = word_cells(data, offsets)
    means = np.zeros((len(offsets) - 1, WIDTH), np.float32)
    filled = np.flatnonzero(np.diff(ends) > 0)
    if len(filled):
        means[filled] = np.add.reduceat(vectors[words], ends[filled], axis=0) / np.diff(ends)[filled, None]
    return means


@dataclass
class Network:
    """Two layers with a temperature; ``score`` is the probability of label 1."""

    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(((x - self.center) / self.scale) @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 250, seed: int = 5) -> Network:
    """Adam on the log loss over four fifths of the rows; the temperature minimises it over the others."""
    rng = np.random.default_rng(seed)
    fit = np.arange(len(y)) % 5 > 0 if len(y) >= 50 else np.ones(len(y), bool)
    net = Network(x[fit].mean(0), x[fit].std(0) + 1e-3, rng.normal(0, WIDTH**-0.5, (x.shape[1], hidden)),
                  np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0)
    z, t = (x[fit] - net.center) / net.scale, y[fit]
    moments = [[0.0, 0.0] for _ in range(4)]
    for step in range(1, epochs + 1):
        before = z @ net.w1 + net.b1
        layer = np.maximum(before, 0)
        error = (1 / (1 + np.exp(-np.clip(layer @ net.w2 + net.b2, -30, 30))) - t) / len(t)
        back = np.outer(error, net.w2) * (before > 0)
        slopes = [z.T @ back + 1e-4 * net.w1, back.sum(0), layer.T @ error + 1e-4 * net.w2, error.sum()]
        for name, slope, m in zip(("w1", "b1", "w2", "b2"), slopes, moments):
            m[0], m[1] = 0.9 * m[0] + 0.1 * slope, 0.999 * m[1] + 0.001 * slope**2
            change = 0.02 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
            setattr(net, name, getattr(net, name) - change)
    rest = ~fit if (~fit).any() else fit
    logits, t = net.logits(x[rest]), y[rest]
    losses = {c: np.mean(np.logaddexp(0, logits / c) - t * logits / c) for c in np.geomspace(0.25, 4, 33)}
    net.temperature = float(min(losses, key=losses.get))
    return net


def fit_quality(docs: DataFrame, labels: DataFrame, text: str = "text", max_labelled: int = 8000) -> tuple[np.ndarray, Network | None]:
    """(word vectors, network) from all texts and the labelled rows with crc32(doc_id) mod 5 other than 0."""
    vectors = word_vectors(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # WORD_CELLS x WIDTH numbers, 1 MB
    known = (labels.where("quality is not null and doc_id is not null and crc32(cast(doc_id as string)) % 5 != 0")
             .groupBy("doc_id").agg(F.max("quality").alias("quality"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(2)):
                part = batch.slice(first, last - first)
                x = pooled(data, offsets, shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "quality", "x"])

    rows = docs.select("doc_id", F.col(text).cast("string").alias("t")).join(known, "doc_id").select("doc_id", F.col("quality").cast("int"), "t")
    got = rows.mapInArrow(run, "doc_id long, quality int, x array<float>").toPandas().sort_values(["doc_id"], kind="stable")
    y = got["quality"].to_numpy(float)
    if len(set(y)) < 2:
        return vectors, None
    return vectors, train(np.stack(got["x"].to_numpy()).astype(float), y)


def with_quality(docs: DataFrame, labels: DataFrame, text: str = "text", max_labelled: int = 8000) -> DataFrame:
    """All columns of ``docs`` and ``score``."""
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, text, max_labelled))
    name = own_name(docs, "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = model.value
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(text)):
                part = batch.slice(first, last - first)
                score = np.ones(last - first) if network is None else network.score(pooled(data, offsets, vectors).astype(float))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*batch.schema.names, name])

    return docs.mapInArrow(run, widened(docs, **{name: "double"}))
