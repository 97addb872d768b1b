"""Packing of documents into sequences of at most ``capacity`` tokens by patterns of few documents.

Every document is its token ids and an end id. One longer than a sequence is cut into full pieces and a rest.
Only the histogram of piece lengths, at most ``capacity`` numbers, is planned with, so the plan costs the same at any
number of documents:

1. Lengths are put in bins (rounded up). All patterns of up to three long pieces that fill a sequence so far that no
   further long piece fits are listed; non-negative least squares fits repeat counts to the bins; counts are rounded down.
2. What is left, the short pieces among it, goes by best fit, longest first, into the gaps of the patterns and then
   into new sequences. This also works on whole classes of equal sequences, not on single pieces.

A piece finds its sequence from its length and its rank among the pieces of that length.

Defined results: a null text is an empty one and yields the end id alone; repeated rows are packed as often as they
come; an empty table gives no rows. Ids of a word-wise tokenizer are those of the plain call.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import column, ranked, slices, starts_of, texts
from passagemill.llm.tokens import Encoder, default_tokenizer
from passagemill.plans.session import cut_lineage

CAPACITY = 4096
END_ID = 1
_BINS = 128
_SHORT_SHARE = 4  # pieces below capacity / 4 are short: they fill gaps


# ---- pieces ---------------------------------------------------------------------------------


def _cut(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, "text"):
            ids, counts = encoder.ids(texts(batch))
            places = np.concatenate((starts_of(counts), [len(ids)])).tolist()
            raw = ids.astype("<u4", copy=False).tobytes()
            rows: list[tuple[int, int, int, int]] = []
            for i, (a, b) in enumerate(zip(places, places[1:])):
                whole, n = raw[4 * a : 4 * b] + end, b - a + 1
                for start in range(0, n, capacity):
                    part = whole[4 * start : 4 * (start + capacity)]
                    rows.append((i, start, len(part) // 4, zlib.crc32(part)))
            table = np.array(rows, np.int64)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id").take(pa.array(table[:, 0])), pa.array(table[:, 1] // capacity, pa.int32())]
                + [pa.array(np.ascontiguousarray(table[:, i])) for i in (1, 2, 3)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; nothing is shuffled."""
    run = _cut(tokenizer or default_tokenizer(), capacity, end_id)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


# ---- plan -----------------------------------------------------------------------------------


def non_negative_least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 with the least ``|a x - b|``, by active sets."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    for _ in range(3 * n):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        active[best] = True
        while True:
            s = np.zeros(n)
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            low = active & (s <= 1e-12)
            if not low.any():
                x = s
                break
            step = np.min(x[low] / np.maximum(x[low] - s[low], 1e-300))
            x = x + step * (s - x)
            active &= x > 1e-12
            x[~active] = 0
            if not active.any():
                break
    return x


def patterns(bins: int, short: int) -> list[tuple[int, ...]]:
    """Up to three bins above ``short``, largest first, whose rest of the sequence is no more than ``short`` bins."""
    found = [(i,) for i in range(bins - short, bins + 1)]
    for i in range(short + 1, bins + 1):
        for j in range(short + 1, min(i, bins - i) + 1):
            if i + j >= bins - short:
                found.append((i, j))
            found += [(i, j, k) for k in range(short + 1, min(j, bins - i - j) + 1) if i + j + k >= bins - short]
    return found


class Plan:
    """Where the pieces of each length go: classes of equal sequences, cut as pieces are added to a part of them."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        self.left = {int(k): int(v) for k, v in histogram.items() if v}
        self.rank = dict.fromkeys(self.left, 0)
        self.steps: list[tuple[int, int, int, int, int, int]] = []  # length, rank, pieces, sequence, copies, offset
        self.open: dict[int, list[tuple[int, int]]] = {}  # room -> [(first sequence, how many)]
        self.rooms: list[int] = []
        self.sequences = 0
        self._fill_patterns()
        self._fill_gaps()

    def _put(self, length: int, sequence: int, many: int, copies: int, offset: int) -> None:
        n = many * copies
        self.steps.append((length, self.rank[length], n, sequence, copies, offset))
        self.rank[length] += n
        self.left[length] -= n

    def _keep_open(self, room: int, sequence: int, many: int) -> None:
        if room and many:
            if room not in self.open:
                self.open[room] = []
                bisect.insort(self.rooms, room)
            self.open[room].append((sequence, many))

    def _fill_patterns(self) -> None:
        width = -(-self.capacity // _BINS)
        bins, short = self.capacity // width, max(1, _BINS // _SHORT_SHARE)
        in_bin: dict[int, list[int]] = {}
        for length in sorted(self.left, reverse=True):
            if -(-length // width) <= bins:
                in_bin.setdefault(-(-length // width), []).append(length)
        counts = np.array([sum(self.left[x] for x in in_bin.get(i, [])) for i in range(1, bins + 1)], float)
        counts[:short] = 0  # the short ones are for the gaps
        if not counts.any():
            return
        listed = patterns(bins, short)
        a = np.zeros((bins, len(listed)))
        for c, pattern in enumerate(listed):
            for i in pattern:
                a[i - 1, c] += 1
        repeats = np.floor(non_negative_least_squares(a, counts) + 1e-6).astype(int)
        for c in np.argsort(-repeats, kind="stable"):
            have = {i: sum(self.left[x] for x in in_bin.get(i, [])) // listed[c].count(i) for i in set(listed[c])}
            self._repeat(listed[c], min(int(repeats[c]), *have.values()), in_bin)

    def _repeat(self, pattern: tuple[int, ...], times: int, in_bin: dict[int, list[int]]) -> None:
        """``times`` sequences of the pattern, with the true lengths of its bins, in runs of equal ones."""
        while times > 0:
            lengths: list[int] = []
            for i in pattern:
                need = lambda x: self.left[x] - lengths.count(x)  # noqa: E731, B023
                lengths.append(next(x for x in in_bin[i] if need(x) > 0))
            run = min(times, *(self.left[x] // lengths.count(x) for x in set(lengths)))
            offset = 0
            for x in dict.fromkeys(lengths):
                self._put(x, self.sequences, run, lengths.count(x), offset)
                offset += x * lengths.count(x)
            self._keep_open(self.capacity - offset, self.sequences, run)
            self.sequences += run
            times -= run

    def _fill_gaps(self) -> None:
        for length in sorted((x for x, n in self.left.items() if n), reverse=True):
            while self.left[length]:
                at = bisect.bisect_left(self.rooms, length)
                if at == len(self.rooms):
                    break
                room = self.rooms[at]
                classes = self.open[room]
                sequence, many = classes.pop()
                take = min(many, self.left[length])
                self._put(length, sequence, take, 1, self.capacity - room)
                if many > take:
                    classes.append((sequence + take, many - take))
                elif not classes:
                    del self.open[room]
                    self.rooms.pop(at)
                self._keep_open(room - length, sequence, take)
            n = self.left[length]
            each = self.capacity // length
            for many, copies in ((n // each, each), (1, n % each)):
                if many and copies:
                    self._put(length, self.sequences, many, copies, 0)
                    self._keep_open(self.capacity - length * copies, self.sequences, many)
                    self.sequences += many

    def arrays(self) -> np.ndarray:
        """Steps by length and rank. Their number depends on the capacity, not on the number of pieces."""
        table = np.array(sorted(self.steps), np.int64).reshape(-1, 6)
        return table


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = shared.value
        width = int(steps[:, 1].max()) + int(steps[:, 2].max()) + 1 if len(steps) else 1
        keys = steps[:, 0] * width + steps[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = column(batch, "length").to_numpy(), column(batch, "_rank").to_numpy()
            step = steps[np.searchsorted(keys, length * width + rank, side="right") - 1]
            within = rank - step[:, 1]
            sequence, offset = step[:, 3] + within // step[:, 4], step[:, 5] + (within % step[:, 4]) * length
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [column(batch, c) for c in names] + [pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"]
            )

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for every piece."""
    cut = cut_lineage(pieces(docs, tokenizer, capacity, end_id), "pieces")
    # at most ``capacity`` rows
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(Plan(histogram, capacity).arrays())
    places = ranked(cut, "length", ["doc_id", "piece", "start", "ids_crc32"], "_rank")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return places.mapInArrow(_place(shared), schema)
