"""Quality classifier: random-indexing word vectors, pooled per document, into a two-layer network.

Random indexing: every word has a fixed sparse vector of +1 and -1 that follows from its hash. A word's own vector is the
sum of those of its neighbours, up to ``REACH`` places away, over all documents of the corpus. Words are hashed into
``WORDS`` rows, so vectors of any corpus take the same room. A document is the mean of its words' vectors, with its
length and its shares of distinct words and lines beside it. A network with one hidden layer is fitted to labels;
a temperature fitted on labels kept aside makes its outputs probabilities.

Partial vector sums meet in an aggregation on the row; the network is fitted on at most ``TRAIN_ROWS`` labelled
documents (those with the lowest hash of the id), whose pooled vectors alone come to the driver.

Defined results: a null or empty text has no words and is scored from its counts; without labels every score is 0.5; a
document with several labels is learned with each; a null id counts as the empty text in the fold; an empty table
gives no rows.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import column, slices, sums_of, texts, words
from passagemill.llm.language import remainder

WORDS = 1 << 14
_BITS = 15
SIZE = 32
NONZERO = 4
REACH = 2
TRAIN_ROWS = 20_000
FOLDS = 3
HIDDEN = 32
_SLICE = 4 << 20
#: Vectors gathered at once, and words whose rows a task keeps.
_GATHERED, _KEPT_WORDS = 300_000, 300_000
#: Characters that are cut off a word's ends as words of their own.
MARKS = string.punctuation + "…—–‘’“”«»„¿¡·•"


def index_vectors() -> np.ndarray:
    """(places, signs) of the fixed vectors: ``NONZERO`` places in ``SIZE`` for each row."""
    rng = np.random.default_rng(20)
    places = np.argsort(rng.random((WORDS, SIZE)), axis=1)[:, :NONZERO]
    signs = np.where(rng.random((WORDS, NONZERO)) < 0.5, -1, 1)
    return np.stack((places, signs))


class Rows(dict):
    """Word -> its rows, four numbers of ``_BITS`` bits counted from 1 (0 for none) in one: the marks before a word, the
    word, the sign for capitals, and the marks after it. Kept by a task for the words it meets."""

    def __missing__(self, word: str) -> int:
        h, last = xxhash.xxh64_intdigest, WORDS - 1
        core = word.strip(MARKS)
        found = 0
        if core:
            found = h(core.lower().encode()) % last + 1 << _BITS
            if core.isupper() and len(core) > 1:
                found |= WORDS << 2 * _BITS
        if len(core) != len(word):
            before = word[: len(word) - len(word.lstrip(MARKS))]
            if before:
                found |= h(before.encode()) % last + 1
            after = word[len(word.rstrip(MARKS)) :] if core else ""
            if after:
                found |= h(after.encode()) % last + 1 << 3 * _BITS
        self[word] = found
        return found


def _distinct(owner: np.ndarray, codes: np.ndarray, n: int, owners: int) -> np.ndarray:
    """How many different codes below ``n`` each owner has."""
    pairs = np.sort(owner * np.int64(n) + codes)
    return np.bincount(pairs[np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]] // n, minlength=owners)


def units(text: pa.Array, known: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of all words in order, how many each text has, and how many different ones. ``known`` is the task's own.

    A word in marks is the marks, the word in lower case, and the marks; one in capitals has a sign for that.
    """
    coded, counts = words(text)
    n = len(coded.dictionary)
    if not n:
        none = np.zeros(len(text), np.int64)
        return np.zeros(0, np.int64), none, none
    if len(known) > _KEPT_WORDS:
        known.clear()
    packed = np.fromiter(map(known.__getitem__, coded.dictionary.to_pylist()), np.int64, n)
    row = (packed[:, None] >> np.arange(0, 4 * _BITS, _BITS) & (1 << _BITS) - 1) - 1
    at = coded.indices.to_numpy()
    flat = row[at].ravel()
    full = flat >= 0
    owner = np.repeat(np.arange(len(text)), counts)
    used = np.bincount(np.repeat(owner, 4)[full], minlength=len(text))
    return flat[full], used, _distinct(owner, at, n, len(text))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places, signs = index_vectors()
    total, known = np.zeros(WORDS * SIZE), Rows()
    for batch in slices(batches, "text", _SLICE):
        flat, counts, _ = units(texts(batch), known)
        owner = np.repeat(np.arange(len(counts)), counts)
        for step in range(1, REACH + 1):
            same = owner[step:] == owner[:-step]
            left, right = flat[:-step][same], flat[step:][same]
            for a, b in ((left, right), (right, left)):
                for k in range(NONZERO):
                    total += np.bincount(a * SIZE + places[b, k], weights=signs[b, k], minlength=WORDS * SIZE)
    table = total.reshape(WORDS, SIZE)
    full = np.flatnonzero(table.any(axis=1))
    if len(full):
        yield pa.RecordBatch.from_arrays(
            [pa.array(full), *(pa.array(np.ascontiguousarray(table[full, i])) for i in range(SIZE))], ["row", *(f"v{i}" for i in range(SIZE))]
        )


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(WORDS, SIZE) of unit length, from the neighbours in all documents."""
    names = [f"v{i}" for i in range(SIZE)]
    sums = docs.select("text").mapInArrow(_contexts, "row long, " + ", ".join(f"{c} double" for c in names))
    table = sums.groupBy("row").agg(*(F.sum(c).alias(c) for c in names)).toArrow()  # at most WORDS rows
    vectors = np.zeros((WORDS, SIZE), np.float32)
    if table.num_rows:
        found = np.stack([table[c].to_numpy() for c in names], axis=1)
        vectors[table["row"].to_numpy()] = found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)
    return vectors


def pooled(text: pa.Array, vectors: np.ndarray, known: Rows) -> np.ndarray:
    """(texts, SIZE + 3): mean vector, log of the number of words, shares of distinct words and lines."""
    flat, counts, distinct = units(text, known)
    out = np.zeros((len(text), SIZE + 3), np.float32)
    some = np.flatnonzero(counts)
    ends = np.cumsum(counts[some])
    at = 0
    while at < len(some):
        begin = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, begin + _GATHERED, side="right")))
        first = np.concatenate(([0], ends[at : stop - 1] - begin))
        part = some[at:stop]
        out[part, :SIZE] = np.add.reduceat(vectors[flat[begin : ends[stop - 1]]], first, axis=0) / counts[part, None]
        at = stop
    out[:, SIZE] = np.log1p(counts)
    out[:, SIZE + 1] = distinct / np.maximum(counts, 1)
    lines = pc.split_pattern(text, "\n")
    n_lines = np.diff(lines.offsets.to_numpy())
    coded = pc.dictionary_encode(lines.flatten())
    owner = np.repeat(np.arange(len(text)), n_lines)
    different = _distinct(owner, coded.indices.to_numpy(), max(1, len(coded.dictionary)), len(text))
    out[:, SIZE + 2] = different / np.maximum(n_lines, 1)
    return out


class Network:
    """Two layers, fitted by Adam on the log loss; ``temperature`` divides its output."""

    def __init__(self, x: np.ndarray, y: np.ndarray, kept_aside: np.ndarray, epochs: int = 40, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = (x - self.mean) / self.scale
        n = x.shape[1]
        self.w = [rng.normal(0, np.sqrt(2 / n), (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
        a, b = x[~kept_aside], y[~kept_aside]
        first, second, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            order = rng.permutation(len(a))
            for at in range(0, len(a), 128):
                rows = order[at : at + 128]
                t += 1
                for i, g in enumerate(self._slopes(a[rows], b[rows])):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - 0.003 * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
        self.temperature = 1.0
        z = self._output(x[kept_aside])
        if len(z):
            loss = lambda s: np.mean(np.logaddexp(0, np.where(y[kept_aside] == 1, -z, z) / s))
            self.temperature = float(min(np.geomspace(0.25, 16, 200), key=loss))

    def _slopes(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        h = np.maximum(x @ self.w[0] + self.w[1], 0)
        d = (1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3], -30, 30))) - y) / len(x)
        e = np.outer(d, self.w[2]) * (h > 0)
        return [x.T @ e + 1e-4 * self.w[0], e.sum(axis=0), h.T @ d + 1e-4 * self.w[2], np.array([d.sum()])]

    def state(self) -> tuple:
        """Arrays and numbers alone: a broadcast names classes by their module, which workers need not have."""
        return self.mean, self.scale, self.w, self.temperature

    @classmethod
    def of(cls, state: tuple | None) -> Network | None:
        if state is None:
            return None
        network = cls.__new__(cls)
        network.mean, network.scale, network.w, network.temperature = state
        return network

    def _output(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self._output((x - self.mean) / self.scale) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _pooled_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Rows()
        for batch in slices(batches, "text", _SLICE):
            raw = [row.tobytes() for row in pooled(texts(batch), shared.value, known)]
            yield pa.RecordBatch.from_arrays([column(batch, "_key"), column(batch, "quality"), pa.array(raw, pa.binary())], ["_key", "quality", "pooled"])

    return run


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (vectors, state), known = shared.value, Rows()
        network = Network.of(state)
        for batch in slices(batches, "text", _SLICE):
            score = np.full(batch.num_rows, 0.5) if network is None else network.scores(pooled(texts(batch), vectors, known))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return run


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, train_rows: int = TRAIN_ROWS) -> Network | None:
    """The network, from at most ``train_rows`` rows of ``labels`` (doc_id, quality)."""
    spark = docs.sparkSession
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select(
        F.xxhash64("doc_id").alias("_key"), F.col("doc_id").alias("_label_id"), F.col("quality").cast("int").alias("quality")
    )
    # lowest places of a hash first; those far above the bound are left out before any row is sorted
    place = F.pmod(F.col("_key"), F.lit(1 << 31))
    some = known.where(place < int((1 << 31) * min(1.0, (1.5 * train_rows + 1000) / max(known.count(), 1))))
    sample = some.orderBy(place, "_key", "_label_id", "quality").limit(train_rows)
    # bounded by train_rows
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_label_id"))
    rows = joined.select("_key", "quality", "text").mapInArrow(_pooled_rows(spark.sparkContext.broadcast(vectors)), "_key long, quality int, pooled binary")
    found = sorted((r["_key"], r["quality"], r["pooled"]) for r in rows.collect())
    if not found:
        return None
    x = np.stack([np.frombuffer(p, np.float32) for _, _, p in found]).astype(np.float64)
    y = np.array([q for _, q, _ in found], np.float64)
    aside = np.array([k % 5 == 0 for k, _, _ in found])
    if aside.all():
        aside[:] = False
    return Network(x, y, aside)


def score(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; labels of held-out rows are not read."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", (remainder("doc_id", folds) == 1).alias("held_out"))
    vectors = word_vectors(rows)
    known = labels.select(F.col("doc_id").cast("long"), "quality").where(remainder("doc_id", folds) != 1)
    network = fit(rows, known, vectors, train_rows)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network and network.state()))
    return rows.mapInArrow(_scored(shared), "doc_id long, held_out boolean, score double, predicted int")
