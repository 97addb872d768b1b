"""Stretches of words that repeat with a period, found online by catchers over dyadic blocks.

A run is a stretch of words with smallest period q (words q apart are equal) that no neighbour prolongs and that holds a
given number of periods. While words are appended, every completed block of a power-of-two length waits as a catcher: the
block that ends with the newest word is compared with the one catcher of its level that lies a period in [B, 2B) back. Where
the two are equal, a square may be starting or going on. The comparison of its words is then carried to the left, and to the
right with every word that comes, until the two copies differ; squares of one period that touch are one run. Level by level the periods
double, so that every word is compared once or twice a level, and multiples of a run's period are left out by the runs of the
levels below.

The comparison of blocks is one of 64-bit hashes of words, built by doubling; what they find is verified word by word.

All work on a text happens inside its row: nothing is shuffled. Texts of an Arrow slice are appended one after another, each closed
by a word of its own that nothing equals. A very long text is a slice alone and is appended in parts.

Defined results: a null or empty text has no words, no run and an empty collapsed text; rows that repeat an id or a text are
answered one by one; an empty table gives no rows. Columns other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import column, slices, starts_of, texts, words
from passagemill.llm.quality_rules import let
from passagemill.llm.quality_rules import words as words_of

MIN_LENGTH = 6
MIN_PERIODS = 4
#: Words appended at a time.
PART = 1 << 18

_SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _same_right(w: np.ndarray, i: int, j: int, n: int) -> int:
    """How many words from ``i`` and from ``j`` on are equal, ``j`` being the later one."""
    done, size = 0, 32
    while j + done < n:
        m = min(size, n - j - done)
        differ = w[i + done : i + done + m] != w[j + done : j + done + m]
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done, size = done + m, min(size * 4, 1 << 16)
    return done


def _same_left(w: np.ndarray, i: int, j: int) -> int:
    """How many words before ``i`` and before ``j`` are equal, ``i`` being the earlier one."""
    done, size = 0, 32
    while done < i:
        m = min(size, i - done)
        differ = (w[i - done - m : i - done] != w[j - done - m : j - done])[::-1]
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done, size = done + m, min(size * 4, 1 << 16)
    return done


def _is_power(w: np.ndarray) -> bool:
    """Is the stretch two or more copies of a shorter one?"""
    q = rest = len(w)
    r = 2
    while rest > 1:
        if r * r > rest:
            r = rest
        if rest % r == 0:
            while rest % r == 0:
                rest //= r
            if (w[q // r :] == w[: q - q // r]).all():
                return True
        r += 1
    return False


class Level:
    """The catchers of the periods from ``low`` to ``2 * low - 1``: completed blocks of ``block`` words."""

    def __init__(self, low: int, min_length: int, min_periods: int):
        self.low = low
        # equal words in a row that every run of this level has, and the longest block that fits into them wherever they start
        shortest = min(max(min_length - q, (min_periods - 1) * q) for q in range(low, min(2 * low, low + min_length + 1)))
        self.block = 1
        while 4 * self.block - 1 <= shortest:
            self.block *= 2


class SquareCatchers:
    """Runs of a sequence of word numbers that grows by ``append``; ``runs`` tells those of all words so far."""

    def __init__(self, max_period: int, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS):
        if min_periods < 2:
            raise ValueError("a run has two periods at least")
        self.min_length, self.min_periods = min_length, min_periods
        self.levels = [Level(1 << k, min_length, min_periods) for k in range(max(0, max_period).bit_length())]
        self.n = 0
        self.words = np.zeros(1 << 10, np.int64)
        blocks = max((x.block for x in self.levels), default=1)
        # hashes of windows of 1, 2, 4, ... words, from a first window on: older ones no catcher can meet
        self.hashes = {1 << k: (0, np.zeros(0, np.uint64)) for k in range(blocks.bit_length())}
        self.reach = {b: 3 * b + 3 * max((x.low for x in self.levels if x.block == b), default=b) for b in self.hashes}
        self.closed: list[tuple[int, int, int]] = []
        #: (start, end, period) of equal stretches that the last word still belongs to.
        self.open: list[tuple[int, int, int]] = []

    def append(self, part: np.ndarray) -> None:
        before, self.n = self.n, self.n + len(part)
        if self.n > len(self.words):
            self.words = np.concatenate((self.words[:before], np.zeros(max(self.n, 2 * before) - before, np.int64)))
        self.words[before : self.n] = part
        grown, self.open = self.open, []
        for start, end, q in grown:
            self._place(start, end + _same_right(self.words, end - q, end, self.n), q)
        self._hash(before)
        for level in self.levels:
            self._catch(level, before)

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) by start, then period."""
        found = self.closed + [x for x in self.open if self._is_run(*x)]
        return sorted((s, e - s, q) for s, e, q in found)

    def _is_run(self, start: int, end: int, q: int) -> bool:
        return end - start >= max(self.min_length, self.min_periods * q) and not _is_power(self.words[start : start + q])

    def _place(self, start: int, end: int, q: int) -> None:
        if end == self.n:
            self.open.append((start, end, q))
        elif self._is_run(start, end, q):
            self.closed.append((start, end, q))

    def _hash(self, before: int) -> None:
        """Hashes of the windows that the new words complete."""
        half: tuple[int, np.ndarray] | None = None
        for size, (low, kept) in self.hashes.items():
            first = max(0, before - size + 1)
            count = self.n - size + 1 - first
            if count > 0:
                if half is None:
                    new = _mixed(self.words[first : self.n].astype(np.uint64) + np.uint64(1))
                else:
                    at, h = first - half[0], half[1]
                    left, right = h[at : at + count], h[at + size // 2 : at + size // 2 + count]
                    new = _mixed(left * np.uint64(0xD6E8FEB86659FD93) + (right ^ (right >> np.uint64(32))))
                kept = np.concatenate((kept[: first - low], new))
            self.hashes[size] = half = (low, kept)
        for size, (low, kept) in self.hashes.items():
            old = max(0, len(kept) - self.reach[size] - PART)
            if old > PART:  # cut now and then, not with every word
                self.hashes[size] = (low + old, kept[old:].copy())

    def _hits(self, level: Level, before: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(start of a caught block, start of the equal window a period later) for windows that the new words complete."""
        low, b = level.low, level.block
        base, h = self.hashes[b]
        x0, x1 = max(0, before - b + 1), self.n - b + 1
        if b > low:
            for q in range(low, 2 * low):
                s = np.arange(-(-max(0, x0 - q) // b) * b, x1 - q, b)
                hit = s[h[s + q - base] == h[s - base]]
                yield hit, hit + q
            return
        for near in range(low, 2 * low, b):  # one catcher of each window for every block length within the level's periods
            at = np.arange(max(x0 - near, 0), x1 - near)
            s = at & ~(b - 1)
            hit = np.flatnonzero(h[at + (near - base)] == h[s - base])
            yield s[hit], at[hit] + near

    def _catch(self, level: Level, before: int) -> None:
        b, x0 = level.block, max(0, before - level.block + 1)
        caught = [x for x in self._hits(level, before) if len(x[0])]
        if not caught:
            return
        s, x = (np.concatenate(part) for part in zip(*caught))
        fresh = self._unknown(s, x, level)
        s, q = s[fresh], (x - s)[fresh]
        if not len(s):
            return
        order = np.lexsort((s, q))
        s, q = s[order], q[order]
        first = np.flatnonzero(np.concatenate(([True], (q[1:] != q[:-1]) | (s[1:] != s[:-1] + b))))
        last = np.concatenate((first[1:], [len(s)])).astype(np.int64) - 1
        # a run covers so many whole blocks that most chance meetings are told from it at once
        equal = np.maximum(self.min_length - q[first], (self.min_periods - 1) * q[first])
        short = (last - first + 1 < (equal - b + 1) // b) & (s[first] + q[first] - b >= x0) & (s[last] + q[last] + 2 * b <= self.n)
        found: dict[int, int] = {}
        for i in first[~short].tolist():
            start, period = int(s[i]), int(q[i])
            if found.get(period, -1) >= start + period + b:
                continue  # the stretch before, met again after blocks that older words had shown
            end = start + period + _same_right(self.words, start, start + period, self.n)
            found[period] = end
            self._place(start - _same_left(self.words, start, start + period), end, period)

    def _unknown(self, s: np.ndarray, x: np.ndarray, level: Level) -> np.ndarray:
        """False for hits inside a stretch whose period divides theirs."""
        fresh = np.ones(len(s), bool)
        recent = [r for r in self.closed if r[1] - r[0] >= level.low + level.block and r[1] > int(x.min())] + self.open
        if not recent:
            return fresh
        order = np.argsort(x, kind="stable")
        starts, ends, periods = np.array(recent, np.int64).T
        lows = np.searchsorted(x, starts + level.low, sorter=order)
        highs = np.searchsorted(x, ends - level.block, side="right", sorter=order)
        for i in np.flatnonzero(highs > lows).tolist():
            at = order[lows[i] : highs[i]]
            fresh[at[(s[at] >= starts[i]) & ((x[at] - s[at]) % periods[i] == 0)]] = False
        return fresh


def runs_of(codes: np.ndarray, counts: np.ndarray, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> np.ndarray:
    """Rows (text, start, length, period) of many texts' words, by text, start and period.

    Texts of like length share their catchers, so that short ones are not compared over the periods of long ones.
    """
    starts, found = starts_of(counts), []
    groups: dict[int, list[int]] = defaultdict(list)
    for i, n in enumerate(counts.tolist()):
        if n >= max(min_length, min_periods):
            groups[n.bit_length()].append(i)
    closing = int(codes.max(initial=0)) + 1
    for members in groups.values():
        # each text is closed by a number of its own
        lengths = counts[members] + 1
        at, places = starts_of(lengths), np.full(int(lengths.sum()), -1, np.int64)
        joined = np.empty(len(places), np.int64)
        for i, a in zip(members, at.tolist()):
            joined[a : a + counts[i]] = codes[starts[i] : starts[i] + counts[i]]
            joined[a + counts[i]] = closing
            closing += 1
        catchers = SquareCatchers(int(lengths.max()) // min_periods, min_length, min_periods)
        for a in range(0, len(joined), PART):
            catchers.append(joined[a : a + PART])
        rows = np.array(catchers.runs(), np.int64).reshape(-1, 3)
        text = np.searchsorted(at, rows[:, 0], side="right") - 1
        found.append(np.column_stack((np.array(members, np.int64)[text], rows[:, 0] - at[text], rows[:, 1:])))
    rows = np.concatenate([np.zeros((0, 4), np.int64), *found])
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def dropped(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """True for words that some run holds after its first period."""
    starts, change = starts_of(counts), np.zeros(int(counts.sum()) + 1, np.int64)
    first = starts[rows[:, 0]] + rows[:, 1]
    np.add.at(change, first + rows[:, 3], 1)
    np.add.at(change, first + rows[:, 2], -1)
    return np.cumsum(change[:-1]) > 0


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of ``docs`` (doc_id, text).

    ``runs`` lists (start, length, period) in words by start, then period. ``collapsed`` is the text without the words that
    a run holds after its first period, joined by single blanks.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            coded, counts = words(texts(batch))
            codes = coded.indices.to_numpy().astype(np.int64)
            rows = runs_of(codes, counts, min_length, min_periods)
            per_text = np.bincount(rows[:, 0], minlength=len(counts))
            listed = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in (1, 2, 3)], names=["start", "length", "period"])
            gone = dropped(rows, counts)
            left = counts - np.bincount(np.repeat(np.arange(len(counts)), counts)[gone], minlength=len(counts))
            kept = coded.dictionary.take(pa.array(codes[~gone]))
            collapsed = pc.binary_join(pa.ListArray.from_arrays(_offsets(left), kept), " ")
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(counts), pa.ListArray.from_arrays(_offsets(per_text), listed), collapsed],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, _SCHEMA)


def _offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))


def with_loops(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which one document in ten, by the checksum of its id, goes round in a circle from some word on."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def circle(w: Column) -> Column:
        n = F.size(w)
        start = F.pmod(g, n)
        around = F.lit(1) + F.floor((n - start) / (F.pmod(g, F.lit(8)) + 3))
        place = lambda i: F.when(i < start, i).otherwise(start + F.pmod(i - start, around)).cast("int")
        return F.array_join(F.transform(w, lambda _, i: F.get(w, place(i))), " ")

    text = F.coalesce("text", F.lit(""))
    looped = let(words_of(text), lambda w: F.when(F.size(w) > 0, circle(w)).otherwise(F.lit("")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.pmod(h, F.lit(10)) == 0, looped).otherwise(text).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """One row a document: its number of runs, the one with the most periods, and checksums of all runs and of what is left."""
    runs = F.col("runs")
    # lists are in the order that settles ties, so only more periods win
    longer = lambda a, b: F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    line = lambda r: F.concat_ws("", F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = found.withColumn("best", F.aggregate(runs, none, longer))
    return best.select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(runs, line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
