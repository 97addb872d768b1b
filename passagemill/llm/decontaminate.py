"""Benchmark decontamination with spaced seeds.

A seed is a mask over neighbouring tokens; positions where it has 0 are ignored, so a substituted token only breaks the
seeds that look at it. Hashes of all masks at all positions are compared between test items and documents, and around
every hit the two are laid side by side: an item is in a document where a stretch of ``WINDOW`` tokens (the whole item if
it is shorter) agrees in at least ``SHARE`` of its places. Tokens are words without marks at their ends, in lower case.

At scale only hashes that a Bloom filter of the test hashes lets through leave a task. The filter has a fixed size;
with more test items it lets more through, and the equi-join on the hash decides. Hits of a document close to each other
are one region with its tokens. Regions with the same hits in the same places, such as those of a passage in a
third of all documents, ask for their items only once.

Items shorter than the widest mask are looked for as a run of exactly their tokens. Defined results: a null or empty
text, of a document or an item, holds nothing and is in nothing; items with equal tokens are named by the lowest id;
null document ids come out as null; rows equal in id and text are one; an empty table on either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import NO_ID, column, id_or_lowest, slices, starts_of, sums_of, texts, unused, words
from passagemill.plans.session import cut_lineage

MASKS = ("110110101", "1110010011", "11010001011", "101100100011")
WINDOW = 20
SHARE = 0.8
FILTER_BYTES = 1 << 22

_EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the tokens of all texts, and how many each text has."""
    coded, counts = words(text)
    low = pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), _EDGES, "").to_pylist()
    h = xxhash.xxh64_intdigest
    # 0 marks a word that is nothing but marks
    table = np.array([h(w.encode()) | 1 if w else 0 for w in low], np.uint64)
    flat = table[coded.indices.to_numpy()] if len(table) else np.zeros(0, np.uint64)
    there = flat != 0
    return flat[there], sums_of(there.astype(np.int64), counts)


def seeds(masks: tuple[str, ...], lengths: list[int]) -> list[np.ndarray]:
    """Offsets of each mask; then whole runs for items of the given lengths, which are too short for the masks."""
    return [np.flatnonzero([c == "1" for c in m]) for m in masks] + [np.arange(n) for n in lengths]


def _factor(seed: int, place: int) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(f"{seed} {place}".encode()) | 1)


def seed_hashes(flat: np.ndarray, seed: np.ndarray, number: int) -> np.ndarray:
    """Hash of the seed at every position of ``flat`` where it fits."""
    n = len(flat) - int(seed[-1])
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, _factor(number, -1), np.uint64)
    for at in seed.tolist():
        total += flat[at : at + n] * _factor(number, at)
    return total ^ (total >> np.uint64(29))


def _places(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    bits = np.uint64(size * 8 - 1)  # size is a power of 2
    return hashes & bits, (hashes >> np.uint64(32)) * np.uint64(0x9E3779B1) & bits


def _item_seeds(all_seeds: list[np.ndarray], n_masks: int):
    """Rows (hash, item, at) of the items, by mask, or by the item's own length where that is too short."""
    widest = max(int(s[-1]) + 1 for s in all_seeds[:n_masks])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int, int]] = []
            for item, raw in zip(column(batch, "item").to_pylist(), column(batch, "tokens").to_pylist()):
                flat = np.frombuffer(raw, "<u8")
                for number, seed in enumerate(all_seeds):
                    if (number < n_masks) == (len(flat) >= widest) and (number < n_masks or len(seed) == len(flat)):
                        hashes = seed_hashes(flat, seed, number).view(np.int64).tolist()
                        found += [(h, item, at) for at, h in enumerate(hashes)]
            rows = np.array(found, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(3)], ["hash", "item", "at"])

    return run


def _item_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        flat, counts = tokens(texts(batch))
        raw = [flat[s : s + n].astype("<u8").tobytes() for s, n in zip(starts_of(counts), counts)]
        yield pa.RecordBatch.from_arrays([column(batch, "item"), pa.array(raw, pa.binary()), pa.array(counts)], ["item", "tokens", "n"])


_REGION = "doc long, text_key long, first long, margin long, hits binary, tokens binary"


def _regions(shared, all_seeds: list[np.ndarray], reach: int):
    """Stretches of documents around hashes that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        spans = [int(s[-1]) + 1 for s in all_seeds]
        for batch in slices(batches, "text"):
            flat, counts = tokens(texts(batch))
            start = starts_of(counts)
            ends = start + counts
            at_all, hash_all, stop_all = [], [], []
            for number, seed in enumerate(all_seeds):
                hashes = seed_hashes(flat, seed, number)
                one, two = _places(hashes, len(table))
                bit = lambda p: table[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8) & 1
                at = np.flatnonzero(bit(one))
                at = at[bit(two[at]).astype(bool)]
                at_all.append(at)
                hash_all.append(hashes[at])
                stop_all.append(at + spans[number])
            at, hashes, stop = np.concatenate(at_all), np.concatenate(hash_all), np.concatenate(stop_all)
            if not len(at):
                continue
            doc = np.searchsorted(ends, at, side="right")
            inside = stop <= ends[doc]
            order = np.lexsort((hashes[inside], at[inside]))
            at, hashes, stop, doc = (x[inside][order] for x in (at, hashes, stop, doc))
            if not len(at):
                continue
            new = np.ones(len(at), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > reach)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at))
            rows: dict[str, list] = {"i": [], "first": [], "margin": [], "hits": [], "tokens": []}
            for a, b in zip(first.tolist(), last.tolist()):
                d, lead = int(doc[a]), int(at[a])
                low, high = max(int(start[d]), lead - reach), min(int(ends[d]), int(stop[a:b].max()) + reach)
                pairs = np.stack((hashes[a:b], (at[a:b] - lead).astype(np.uint64)), axis=1)
                rows["i"].append(d)
                rows["first"].append(low - int(start[d]))
                rows["margin"].append(lead - low)
                rows["hits"].append(pairs.astype("<u8").tobytes())
                rows["tokens"].append(flat[low:high].astype("<u8").tobytes())
            pick = pa.array(rows["i"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc").take(pick), column(batch, "text_key").take(pick)]
                + [pa.array(rows[c], pa.int64()) for c in ("first", "margin")]
                + [pa.array(rows[c], pa.binary()) for c in ("hits", "tokens")],
                [c.split()[0] for c in _REGION.split(", ")],
            )

    return run


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, raws = column(batch, "kind").to_pylist(), column(batch, "hits").to_pylist()
        pairs = [np.frombuffer(r, "<i8").reshape(-1, 2) for r in raws]
        if pairs:
            both = np.concatenate(pairs)
            kind = np.repeat(np.array(kinds, np.int64), [len(p) for p in pairs])
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind), pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))],
                ["kind", "hash", "place"],
            )


_MATCH = "doc long, text_key long, item long, matched long, width long, start long"


def best_stretch(doc: np.ndarray, item: np.ndarray, shift: int, window: int) -> tuple[int, int, int]:
    """(equal tokens, width, start in ``doc``) of the best stretch with item token i beside document token i + shift."""
    width = min(window, len(item))
    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    if high - low < width or not width:
        return 0, width, 0
    same = np.concatenate(([0], np.cumsum(doc[low + shift : high + shift] == item[low:high])))
    sums = same[width:] - same[:-width]
    at = int(np.argmax(sums))
    return int(sums[at]), width, low + shift + at


def _verified(window: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ("doc", "text_key", "item", "first", "margin", "shift", "tokens", "item_tokens")
            rows = []
            for doc, key, item, first, margin, shift, raw, other in zip(*(column(batch, c).to_pylist() for c in names)):
                a, b = np.frombuffer(raw, "<u8"), np.frombuffer(other, "<u8")
                equal, width, start = best_stretch(a, b, shift + margin, window)
                if width and equal >= share * width - 1e-9:
                    rows.append((doc, key, item, equal, width, first + start))
            table = np.array(rows, np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(table[:, i])) for i in range(6)], [c.split()[0] for c in _MATCH.split(", ")]
            )

    return run


def _filter(item_seeds: DataFrame, size: int) -> np.ndarray:
    """The Bloom filter of all test hashes: ``size`` bytes, however many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.concatenate(_places(column(batch, "hash").to_numpy().view(np.uint64), size)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(places >> 6), pa.array(np.int64(1) << (places & 63))], ["at", "bit"])

    table = np.zeros(size // 8, np.int64)
    for r in item_seeds.mapInArrow(run, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        table[r["at"]] = r["bits"]
    return table.view(np.uint8)


def _matches(docs: DataFrame, items: DataFrame, masks: tuple[str, ...], window: int, share: float, filter_bytes: int) -> DataFrame:
    """(doc, text_key, item, matched, width, start): the best stretch of each document and item."""
    spark = docs.sparkSession
    named = items.select(id_or_lowest("item_id").alias("item"), "text").mapInArrow(_item_tokens, "item long, tokens binary, n long")
    tests = cut_lineage(named.where("n > 0").groupBy("tokens", "n").agg(F.min("item").alias("item")), "tests")
    widest = max(map(len, masks))
    # fewer than the widest mask has places
    lengths = sorted(r["n"] for r in tests.where(F.col("n") < widest).select("n").distinct().collect())
    all_seeds = seeds(masks, lengths)
    item_seeds = cut_lineage(tests.mapInArrow(_item_seeds(all_seeds, len(masks)), "hash long, item long, at long"), "seeds")
    shared = spark.sparkContext.broadcast(_filter(item_seeds, filter_bytes))
    keyed = docs.select(id_or_lowest("doc_id").alias("doc"), F.xxhash64("text").alias("text_key"), "text")
    found = keyed.mapInArrow(_regions(shared, all_seeds, window), _REGION).withColumn("kind", F.xxhash64("hits"))
    regions = cut_lineage(found, "regions")
    kinds = regions.groupBy("kind").agg(F.first("hits").alias("hits"))
    hits = kinds.mapInArrow(_exploded, "kind long, hash long, place long").join(item_seeds, "hash")
    wanted = cut_lineage(hits.select("kind", "item", (F.col("place") - F.col("at")).alias("shift")).distinct(), "wanted")
    sides = regions.drop("hits").join(wanted, "kind").join(tests.select("item", F.col("tokens").alias("item_tokens")), "item")
    matched = sides.drop("kind").mapInArrow(_verified(window, share), _MATCH)
    best = F.max(F.struct((F.col("matched") / F.col("width")).alias("share"), (-F.col("start")).alias("place"), "matched", "width"))
    return matched.groupBy("doc", "text_key", "item").agg(best.alias("b")).select(
        "doc", "text_key", "item", F.col("b.matched").alias("matched"), F.col("b.width").alias("width"), (-F.col("b.place")).alias("start")
    )


def contaminated(
    docs: DataFrame, items: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW, share: float = SHARE, filter_bytes: int = FILTER_BYTES
) -> DataFrame:
    """(doc_id, item_id, matched_tokens, window_tokens, share, start_token): a row for each document and item found in it."""
    found = _matches(docs, items, masks, window, share, filter_bytes)
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return found.select(
        real("doc").alias("doc_id"),
        real("item").alias("item_id"),
        F.col("matched").alias("matched_tokens"),
        F.col("width").alias("window_tokens"),
        (F.col("matched") / F.col("width")).alias("share"),
        F.col("start").alias("start_token"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """``docs`` without the rows that hold an item."""
    doc, text = unused(docs, "_found_doc", "_found_text")
    found = _matches(docs, items, masks, window, share, FILTER_BYTES).select(F.col("doc").alias(doc), F.col("text_key").alias(text))
    this = (id_or_lowest("doc_id") == F.col(doc)) & (F.xxhash64("text") == F.col(text))
    return docs.join(found.distinct(), this, "left_anti")
