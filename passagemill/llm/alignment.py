"""Which tokens of two tokenizers cover the same bytes, and how often the corpus links their ids.

Both tokenizers cut the same bytes: a blank and the text. Where a token of each ends at the same byte is a shared cut. Cuts are found
by divide and conquer: the end nearest the middle of a stretch that a bisection of the other tokenizer's ends meets splits the
stretch, and both halves go on; a stretch without a cut inside is a group. All stretches of an Arrow slice are halved together,
so a round is a few array operations however many texts there are.

Most texts are made of few different words. A blank between two characters that are no white space always begins a token
of both tokenizers (this is checked: the first cuts words in front of blanks, no piece of the second has a blank after anything
else), so it is a shared cut that needs no search. The stretches between such blanks are encoded and halved once a slice, and texts are put
together from them. For other tokenizer files every text is one stretch.

Every pair of tokens within a group is a link. Documents of a slice are a block: a block stores its different id pairs, the number of
its documents that hold each, and its documents' links. Counts of the corpus are sums over blocks, and each block asks for the
counts of its pairs once, so that neither a common pair nor a large group of copies meets in one task.

Defined results: a text that is null or empty, or that a tokenizer does not give back byte by byte, has no tokens, groups or links
and an empty ``groups``; rows that repeat an id or a text are answered one by one and count as documents of their own; an empty
table gives no rows; a very long text is a block alone. Columns other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import column, slices, starts_of, sums_of, texts
from passagemill.plans.session import cut_lineage

#: Bytes of units that are encoded as one text.
_AT_ONCE = 1 << 14
#: Bytes of texts in a block.
_BLOCK_BYTES = 1 << 20
#: Groups with more links than this are counted by their different ids first.
_WIDE = 1024
# Fixed value: the pattern by which byte-level tokenizer files cut words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PROBE = "a  b\n \tÅ é ﬁ １ c"

_SCHEMA = (
    "block long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
    "pairs array<long>, n_docs array<int>, docs binary, pair binary, times binary"
)


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_of_letter() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, others from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Two tokenizers: a byte-level file of the ``tokenizers`` library (a) and a ``sentencepiece`` model (b)."""

    def __init__(self, a_path: str, b_path: str):
        # one task is one thread: the tokenizer's own threads would take other tasks' cores
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters, vocabulary = _byte_of_letter(), self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.size_a, self.size_b = (np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        config = json.loads(self.a.to_str())
        before, model = config["pre_tokenizer"] or {}, config["model"]
        self.word_wise = (
            config["normalizer"] is None
            and (before.get("type"), before.get("add_prefix_space"), before.get("use_regex")) == ("ByteLevel", False, True)
            and not any("▁" in p.lstrip("▁") for p in pieces)
            and b"".join(self.b_bytes[i] for i in self.b.encode(_PROBE)) == f" {_PROBE}".encode()
        )
        # merges in the order of their ids are ranks: a second library encodes by those, several times faster
        merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
        made = [vocabulary.get("".join(m), -1) for m in merges]
        self.ranked = self.word_wise and len(made) + 256 == len(vocabulary) and made == sorted(set(made)) and not model.get("ignore_merges")
        if self.ranked:
            import tiktoken

            ranks = {self.a_bytes[i]: i for i in vocabulary.values()}
            self.fast_a = tiktoken.Encoding("ranks", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.a = None

    def _ids_a(self, text: str) -> list[int]:
        return self.fast_a.encode_ordinary(text) if self.ranked else self.a.encode(text, add_special_tokens=False).ids

    def _one_by_one(self, units: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for unit in units:
            a, b, raw = self._ids_a(unit), self.b.encode(unit[1:]), unit.encode()
            same = b"".join([self.a_bytes[i] for i in a]) == raw == b"".join([self.b_bytes[i] for i in b])
            yield (np.array(a, np.int64), np.array(b, np.int64)) if same else (np.zeros(0, np.int64),) * 2

    def _together(self, units: list[str], ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Ids and counts of units that make one text; None where they are not given back or a token spans two."""
        text, found = "".join(units), []
        raw = text.encode()
        for ids, table, sizes in ((self._ids_a(text), self.a_bytes, self.size_a), (self.b.encode(text[1:]), self.b_bytes, self.size_b)):
            if b"".join([table[i] for i in ids]) != raw:
                return None
            ids = np.array(ids, np.int64)
            stops = np.cumsum(sizes[ids])
            last = np.searchsorted(stops, ends)
            if (stops[last] != ends).any():
                return None
            found.append((ids, np.diff(last, prepend=-1)))
        return found

    def encode(self, units: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """For both tokenizers: ids of the units, each of which begins with a blank, and how many each has.

        A unit has none where its tokens do not give it back.
        """
        parts: list[list[tuple[np.ndarray, np.ndarray]]] = []
        ends = np.cumsum(pc.binary_length(units).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(units):
            base = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + _AT_ONCE, side="right"))) if self.word_wise else at + 1
            listed = units.slice(at, stop - at).to_pylist()
            joined = self._together(listed, ends[at:stop] - base)
            if joined is None:
                joined = [(np.concatenate(x), np.array([len(y) for y in x], np.int64)) for x in zip(*self._one_by_one(listed))]
            parts.append(joined)
            at = stop
        none = (np.zeros(0, np.int64),) * 2
        return [tuple(np.concatenate(x) for x in zip(none, *(part[k] for part in parts))) for k in (0, 1)]


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All places ``start, start + 1, ...`` of each stretch, one after another."""
    return np.repeat(starts - starts_of(counts), counts) + np.arange(int(counts.sum()))


def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray, a_last: np.ndarray, b_last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a_ends`` and in ``b_ends`` of all common values, by divide and conquer.

    Both arrays rise. ``a_last`` and ``b_last`` are the places where each unit's last tokens end, which are common.
    """
    cuts_a, cuts_b = [a_last], [b_last]
    # open stretches: places of ends strictly inside, in both arrays
    low, high = np.concatenate(([0], a_last[:-1] + 1)).astype(np.int64), a_last.astype(np.int64)
    low_b, high_b = np.concatenate(([0], b_last[:-1] + 1)).astype(np.int64), b_last.astype(np.int64)
    width = np.zeros(len(low), np.int64)
    while True:
        live = (low < high) & (low_b < high_b)
        if not live.any():
            break
        low, high, low_b, high_b, width = (x[live] for x in (low, high, low_b, high_b, width))
        middle = (low + high) // 2
        first, stop = np.maximum(low, middle - width), np.minimum(high, middle + width + 1)
        counts = stop - first
        at = _ranges(first, counts)
        met = np.searchsorted(b_ends, a_ends[at])
        far = np.abs(at - np.repeat(middle, counts)) * 2 + (at > np.repeat(middle, counts))
        far[b_ends[met] != a_ends[at]] = np.iinfo(np.int64).max
        nearest = np.minimum.reduceat(far, starts_of(counts))
        found = nearest < np.iinfo(np.int64).max
        cut = (middle + np.where(nearest % 2 == 1, 1, -1) * (nearest // 2))[found]
        cut_b = np.searchsorted(b_ends, a_ends[cut])
        cuts_a.append(cut)
        cuts_b.append(cut_b)
        # no end of a found stretch's halves was looked at twice; a window without a cut widens until it is the stretch
        again = ~found & ((first > low) | (stop < high))
        low, high, low_b, high_b, width = (
            np.concatenate(x)
            for x in (
                (low[found], cut + 1, low[again]),
                (cut, high[found], high[again]),
                (low_b[found], cut_b + 1, low_b[again]),
                (cut_b, high_b[found], high_b[again]),
                (np.zeros(2 * len(cut), np.int64), 4 * width[again] + 2),
            )
        )
    a, b = np.concatenate(cuts_a), np.concatenate(cuts_b)
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


def _unit_offsets(raw: np.ndarray, text_ends: np.ndarray) -> np.ndarray:
    """Where units start in ``raw`` (texts, each after a blank), and its end: at texts, and at blanks between two other characters.

    Next to a blank anything that may belong to white space counts as such; that only makes a unit longer.
    """
    starts = np.concatenate(([0], text_ends[:-1]))[np.diff(text_ends, prepend=0) > 0]
    at = np.flatnonzero(raw == 32)
    at = at[(at >= 2) & (at + 2 < len(raw))]
    narrow = lambda x: (x > 32) | (x < 9) | ((x > 13) & (x < 28))
    before, ahead = raw[at - 1], raw[at + 1]
    # white space beyond ASCII: U+0085, U+00A0, U+1680, U+2000-200A, U+2028-2029, U+202F, U+205F, U+3000
    clear = (before < 128) | ~np.isin(raw[at - 2], (0xC2, 0x80, 0x81, 0x9A))
    open_ = (ahead < 128) | ~((ahead == 0xC2) & np.isin(raw[at + 2], (0x85, 0xA0)) | np.isin(ahead, (0xE1, 0xE2, 0xE3)))
    cuts = at[narrow(before) & narrow(ahead) & clear & open_]
    inside = np.searchsorted(text_ends, cuts, side="right")
    # the blank before a text and the byte before it belong to no common text
    cuts = cuts[cuts > np.concatenate(([0], text_ends))[inside]]
    return np.concatenate((np.sort(np.concatenate((starts, cuts))), [len(raw)])).astype(np.int64)


def _units(text: pa.Array, word_wise: bool) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Units of all texts, coded, and the number of them in each text."""
    spaced = pc.if_else(pc.equal(text, ""), "", pc.binary_join_element_wise(pa.scalar(" "), text, pa.scalar("")))
    if not word_wise:
        full = pc.not_equal(spaced, "")
        return pc.dictionary_encode(spaced.filter(full)), full.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(pc.binary_length(spaced).to_numpy(zero_copy_only=False).astype(np.int64))
    data = pa.concat_arrays([spaced]).buffers()[2]
    if not len(ends) or not ends[-1]:
        return pc.dictionary_encode(pa.array([], pa.string())), np.zeros(len(text), np.int64)
    offsets = _unit_offsets(np.frombuffer(data, np.uint8)[: ends[-1]], ends)
    units = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), data)
    return pc.dictionary_encode(units), np.diff(np.searchsorted(offsets[:-1], np.concatenate(([0], ends))))


def _listed(ids: np.ndarray, closes: np.ndarray, mark: str, size: int) -> pa.Array:
    """Each id in decimal, with ``mark`` behind the last one of its group and a comma behind any other."""
    table = pa.array([f"{i}," for i in range(size)] + [f"{i}{mark}" for i in range(size)])
    return table.take(pa.array(ids + size * closes))


class Units:
    """Tokens, groups and links of different units."""

    def __init__(self, pair: Pair, units: pa.Array):
        (self.a, self.n_a), (self.b, self.n_b) = pair.encode(units)
        self.whole = self.n_a > 0
        size_a, size_b = pair.size_a, pair.size_b
        full_a, full_b = (np.cumsum(n)[self.whole] - 1 for n in (self.n_a, self.n_b))
        cut_a, cut_b = shared_cuts(np.cumsum(size_a[self.a]), np.cumsum(size_b[self.b]), full_a, full_b)
        in_a, in_b = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)
        unit = np.repeat(np.arange(len(self.n_a)), self.n_a)[cut_a]
        self.n_groups = np.bincount(unit, minlength=len(self.n_a))
        self.n_links = sums_of(in_a * in_b, self.n_groups)
        self.text = self._text(cut_a, cut_b, in_a, in_b, unit, len(size_a), len(size_b))
        self.pair, self.times, self.n_pairs = self._links(cut_a, cut_b, in_a, in_b, unit, len(size_b))
        del self.a, self.b

    def _text(self, cut_a, cut_b, in_a, in_b, unit, size_a: int, size_b: int) -> pa.Array:
        """``a1,a2|b1;a3|b2`` of each unit."""
        last_a, last_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        last_a[cut_a], last_b[cut_b] = 1, 1
        parts = pa.concat_arrays([_listed(self.a, last_a, "|", size_a), _listed(self.b, last_b, ";", size_b)])
        order = np.empty(len(parts), np.int64)
        begin = starts_of(in_a + in_b)
        order[_ranges(begin, in_a)] = np.arange(len(self.a))
        order[_ranges(begin + in_a, in_b)] = len(self.a) + np.arange(len(self.b))
        joined = parts.take(pa.array(order))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(self.n_a + self.n_b))).astype(np.int32)), joined)
        text = pc.binary_join(lists, "")
        return pc.utf8_rtrim(text, ";")

    def _links(self, cut_a, cut_b, in_a, in_b, unit, size_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different id pairs of each unit (a * size of b + b), how often each is linked, and how many each unit has."""
        narrow = in_a * in_b <= _WIDE
        n, m = in_a[narrow], in_b[narrow]
        rows = _ranges((cut_a - in_a + 1)[narrow], n)
        per_row = np.repeat(m, n)
        a = np.repeat(self.a[rows], per_row)
        b = self.b[_ranges(np.repeat((cut_b - in_b + 1)[narrow], n), per_row)]
        found = [(np.repeat(unit[narrow], n * m), a * size_b + b, np.ones(len(a), np.int64))]
        for i in np.flatnonzero(~narrow).tolist():
            x, nx = np.unique(self.a[cut_a[i] - in_a[i] + 1 : cut_a[i] + 1], return_counts=True)
            y, ny = np.unique(self.b[cut_b[i] - in_b[i] + 1 : cut_b[i] + 1], return_counts=True)
            found.append((np.full(len(x) * len(y), unit[i]), (x[:, None] * size_b + y).ravel(), (nx[:, None] * ny).ravel()))
        unit, pair, times = (np.concatenate(x) for x in zip(*found))
        unit, pair, times = summed(unit, pair, times)
        return pair, times, np.bincount(unit, minlength=len(self.n_a))


def summed(first: np.ndarray, second: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum of ``values`` for each different (first, second), in order; all are 0 or more."""
    bits = [int(x.max(initial=0)).bit_length() for x in (first, second, values)]
    if sum(bits) <= 63:  # one number holds all three, and numbers are sorted fastest
        packed = np.sort(((first << bits[1] | second) << bits[2]) | values)
        first, second = packed >> (bits[1] + bits[2]), packed >> bits[2] & ((1 << bits[1]) - 1)
        values = packed & ((1 << bits[2]) - 1)
    else:
        order = np.lexsort((second, first))
        first, second, values = first[order], second[order], values[order]
    new = np.flatnonzero(np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1]))))[: len(first)]
    return first[new], second[new], np.add.reduceat(values, new) if len(new) else values


def _coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and the place of each value among them."""
    bits = len(values).bit_length()
    if int(values.max(initial=0)).bit_length() + bits > 63:
        return np.unique(values, return_inverse=True)
    packed = np.sort(values << bits | np.arange(len(values)))
    ordered, at = packed >> bits, packed & ((1 << bits) - 1)
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))[: len(values)]
    places = np.empty(len(values), np.int64)
    places[at] = np.cumsum(new) - 1
    return ordered[new], places


def _blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each document and one for each block of documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, task, names = Pair(a_path, b_path), TaskContext.get().partitionId(), [f.split()[0] for f in _SCHEMA.split(", ")]
        for number, batch in enumerate(slices(batches, "text", _BLOCK_BYTES)):
            coded, counts = _units(texts(batch), pair.word_wise)
            codes = coded.indices.to_numpy().astype(np.int64)
            units = Units(pair, coded.dictionary)
            # a document with a unit that is not given back has no tokens at all
            fine = (counts > 0) & (sums_of((~units.whole[codes]).astype(np.int64), counts) == 0)
            codes, counts = codes[np.repeat(fine, counts)], np.where(fine, counts, 0)
            n, sums = len(counts), {k: sums_of(getattr(units, k)[codes], counts) for k in ("n_a", "n_b", "n_groups", "n_links")}
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), units.text.take(pa.array(codes)))
            block = np.full(n + 1, (task << 32) + number)
            doc, unit, often = summed(np.repeat(np.arange(n), counts), codes, np.ones(len(codes), np.int64))
            here = units.n_pairs[unit]
            at = _ranges(starts_of(units.n_pairs)[unit], here)
            different, coded_pair = _coded(units.pair)
            doc, place, times = summed(np.repeat(doc, here), coded_pair[at], units.times[at] * np.repeat(often, here))
            n_docs = np.bincount(place, minlength=len(different))
            held = np.flatnonzero(n_docs)
            place = (np.cumsum(n_docs > 0) - 1)[place]
            none = lambda kind, k=n: pa.nulls(k, kind)
            values = {
                "block": pa.array(block),
                "place": pa.concat_arrays([pa.array(np.arange(n, dtype=np.int32)), none(pa.int32(), 1)]),
                "doc_id": pa.concat_arrays([column(batch, "doc_id"), none(pa.int64(), 1)]),
                **{k: pa.concat_arrays([pa.array(v.astype(np.int64)), none(pa.int64(), 1)]) for k, v in sums.items()},
                "groups": pa.concat_arrays([pc.binary_join(lists, ";"), none(pa.string(), 1)]),
                "pairs": pa.concat_arrays([none(pa.list_(pa.int64())), pa.array([different[held]], pa.list_(pa.int64()))]),
                "n_docs": pa.concat_arrays([none(pa.list_(pa.int32())), pa.array([n_docs[held].astype(np.int32)], pa.list_(pa.int32()))]),
                "docs": pa.array([None] * n + [doc.astype("<u4").tobytes()], pa.binary()),
                "pair": pa.array([None] * n + [place.astype("<u4").tobytes()], pa.binary()),
                "times": pa.array([None] * n + [times.astype("<u8" if times.max(initial=0) >> 16 else "<u2").tobytes()], pa.binary()),
            }
            made = pa.RecordBatch.from_arrays([values[k] for k in names], names=names)
            del values, lists, coded, codes, units, doc, unit, often, here, at, place, times
            yield made
            del made
            pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, _SCHEMA)


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups) of every row; ``groups`` reads ``a1,a2|b1;a3|b2,b3``: ids of each group in order."""
    a, b = default_files()
    found = _blocks(docs, a_path or a, b_path or b).where(F.col("place").isNotNull())
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")


def link_counts(asked: DataFrame, b_size: int) -> DataFrame:
    """(pair, n, best): how many documents hold each linked id pair, and whether no other pair of its a id is in more."""
    counts = cut_lineage(asked.groupBy("pair").agg(F.sum("n").alias("n")), "counts")
    a = F.floor(F.col("pair") / F.lit(b_size)).alias("a")
    top = counts.groupBy(a).agg(F.max("n").alias("top"))
    return counts.withColumn("a", a).join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def link_scores(docs: DataFrame, derived: dict[str, Column] | None = None, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """What ``align`` returns, with ``n_best`` and ``count_sum`` of every row's links.

    A pair's count is the number of documents that hold it linked. ``n_best`` counts links whose pair has the highest count of its a
    id, ``count_sum`` adds the counts of all links. ``derived`` replaces ``groups`` by columns worked out from it, so that
    the long strings need not be stored.
    """
    import sentencepiece

    a, b = default_files()
    b_size = sentencepiece.SentencePieceProcessor(model_file=b_path or b).get_piece_size()
    derived = {"groups": F.col("groups")} if derived is None else derived
    kept = ["block", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "pairs", "n_docs", "docs", "pair", "times"]
    made = cut_lineage(_blocks(docs, a_path or a, b_path or b).select(*kept, *[v.alias(k) for k, v in derived.items()]), "aligned")
    rows = made.where(F.col("place").isNotNull()).drop("pairs", "n_docs", "docs", "pair", "times")
    blocks = made.where(F.col("place").isNull())
    listed = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "n_docs")).alias("at", "x"))
    asked = listed.select("block", "at", F.col("x.pairs").alias("pair"), F.col("x.n_docs").cast("long").alias("n"))
    counts = cut_lineage(link_counts(asked, b_size), "links")
    answers = asked.drop("n").join(counts, "pair").select(F.col("block").alias("asking"), "at", "n", "best")

    def score(mine: pa.Table, told: pa.Table) -> pa.Table:
        got: dict[str, list] = {"block": [], "place": [], "n_best": [], "count_sum": []}
        for row in mine.to_pylist():
            n, best = np.zeros(told.num_rows, np.int64), np.zeros(told.num_rows, np.int64)
            at = told.column("at").to_numpy()
            n[at], best[at] = told.column("n").to_numpy(), told.column("best").to_numpy()
            doc, pair = (np.frombuffer(row[k], "<u4").astype(np.int64) for k in ("docs", "pair"))
            times = np.frombuffer(row["times"], "<u2" if 2 * len(doc) == len(row["times"]) else "<u8").astype(np.int64)
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            got["block"] += [row["block"]] * len(first)
            got["place"] += doc[first].tolist()
            for k, values in (("n_best", best), ("count_sum", n)):
                got[k] += np.add.reduceat(values[pair] * times, first).tolist() if len(first) else []
        kinds = {"block": pa.int64(), "place": pa.int32(), "n_best": pa.int64(), "count_sum": pa.int64()}
        return pa.table({k: pa.array(got[k], kind) for k, kind in kinds.items()})

    packed = blocks.select("block", "docs", "pair", "times").groupBy("block")
    scores = packed.cogroup(answers.groupBy("asking")).applyInArrow(score, "block long, place int, n_best long, count_sum long")
    zero = {k: F.coalesce(k, F.lit(0).cast("long")) for k in ("n_best", "count_sum")}
    return rows.join(scores, ["block", "place"], "left").withColumns(zero).drop("block", "place")


def digests(docs: DataFrame) -> DataFrame:
    """``link_scores`` with the checksum of the groups in place of the groups."""
    hashed = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return link_scores(docs, {"groups_sha256": hashed})
