"""SimHash near-duplicates through a hierarchical index in Gray order.

A fingerprint bit is set when it is set in over half the hashes of a text's word shingles. Two texts are linked when
one of their fingerprints differs in at most ``max_bits`` of 64 bits; groups are what links connect.

The index. Cut into b blocks, two fingerprints that differ in at most d bits agree in b - d blocks at least. For every
choice of b - d blocks these bits are moved to the front and the fingerprints sorted by the Gray rank of the
result, so that those which agree there form one bucket, in an order where neighbours differ in few bits. Runs of 32
are leaves, 16 leaves an upper node; each node holds the bits that all below it share, as a mask and a value. Two nodes
whose shared bits already differ in more than d places are left out with all that is below them. No pair is
lost in any bucket, whatever its size.

Where a similarity is asked for, links that fail it connect nothing: a first search takes a forest of all candidates, and
those of its groups in which a link failed are searched again with all fingerprints at hand, where two entries join only
when their own similarity is verified. In the other groups every link of the forest holds, so nothing is left to find.

At scale. Equal fingerprints are one entry. Buckets are range-partitioned with the rank and the entry in the key, so a
bucket of any size is spread over tasks; where the end of a range cuts a bucket, the leaves of its parts meet in an
equi-join that compares masks first. A task puts out a forest of links, fewer than it has entries, never all pairs of a
group. b grows with the number of entries so that buckets stay small; every choice
finds all links.

Defined results: a null or empty text has the fingerprint 0, which is linked like any other; a text with fewer words
than a shingle is one shingle; null ids come out as null and are lower than all others; rows with equal ids are
separate entries that may be in different groups; an empty table gives no rows. A very long text is a slice alone. Columns of any
name are passed on: those that a join adds take names that are free.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import NO_ID, column, components, id_or_lowest, slices, texts, unused
from passagemill.plans.session import cut_lineage

SEED = 42
MAX_BITS = 4
#: Fingerprints to a text where a similarity is asked for, the bits in which any may differ, and what the estimate of
#: the similarity may be off by. 88 of 100 pairs with a similarity of 0.8 become candidates, 99.5 of 100 with 0.85.
FAMILIES = 32
NEAR_BITS = 5
MARGIN = 0.03
_LEAF, _FAN = 32, 16
_CHUNK = 1 << 17
_BLOCK = 2048
_HELD_GROUPS = 1_000_000
#: Pairs whose similarity is told at once.
_TOLD = 1 << 15
#: Entries that a bucket may have on average before a finer cut is taken.
_BUCKET = 1024


# ---- fingerprints ---------------------------------------------------------------------------


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words, A-Z lower-cased; lower and split of bytes are the ASCII ones."""
    parts = text.encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    line, h = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([h(line, SEED)], np.uint64)
    ends = (np.cumsum([len(p) + 1 for p in parts]) - 1).tolist()
    starts = [0] + [e + 1 for e in ends]
    return np.array([h(line[s:e], SEED) for s, e in zip(starts, ends[words - 1 :])], np.uint64)


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash family: the hash itself, then well mixed functions of it."""
    if not k:
        return hashes
    x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints_of(hashes: np.ndarray, families: int = 1) -> np.ndarray:
    """``families`` fingerprints of one text."""
    n = len(hashes)
    if not n:
        return np.zeros(families, np.uint64)
    counts = np.zeros(64 * families, np.int64)
    for at in range(0, n, 255):  # a byte holds the count of that many
        part = hashes[at : at + 255]
        mixed = np.stack([_mixed(part, k) for k in range(families)], axis=1).astype("<u8", copy=False)
        bits = np.unpackbits(mixed.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > n, bitorder="little").view("<u8")


def _fingerprint_rows(words: int, families: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [fingerprints_of(shingle_hashes(t, words), families) for t in texts(batch).to_pylist()]
            raw = [p.astype("<u8").tobytes() for p in found]
            entry = np.array([p[0] if families == 1 else xxhash.xxh64_intdigest(r, SEED) for p, r in zip(found, raw)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc"), column(batch, "text_key"), pa.array(raw, pa.binary()), pa.array(entry.view(np.int64))],
                ["doc", "text_key", "prints", "entry"],
            )

    return run


def fingerprints(docs: DataFrame, words: int, families: int = 1) -> DataFrame:
    """(doc, text_key, prints, entry): ``entry`` is the fingerprint, or the hash of several."""
    named = docs.select(id_or_lowest("doc_id").alias("doc"), F.xxhash64("text").alias("text_key"), "text")
    return named.mapInArrow(_fingerprint_rows(words, families), "doc long, text_key long, prints binary, entry long")


# ---- index ----------------------------------------------------------------------------------


def block_choices(entries: int, max_bits: int) -> list[list[tuple[int, int]]]:
    """For each table, the (shift, width) of all blocks, those that must agree first, and how many bits they have."""
    for more in range(1, 5):
        blocks = max_bits + more
        edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
        cut = [(a, b - a) for a, b in zip(edges, edges[1:])]
        if entries <= _BUCKET << (64 * more // blocks):
            break
    chosen = []
    for first in combinations(range(blocks), more):
        order = [*first, *(i for i in range(blocks) if i not in first)]
        chosen.append([cut[i] for i in order] + [(sum(cut[i][1] for i in first), 0)])
    return chosen


def _gray_rank(value: np.ndarray) -> np.ndarray:
    for shift in (1, 2, 4, 8, 16, 32):
        value = value ^ (value >> np.uint64(shift))
    return value


def _index_rows(choices: list, families: int, carries: bool):
    step = 256 if carries else 4096

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                entry = column(batch, "entry").to_numpy()
                prints = np.frombuffer(b"".join(column(batch, "prints").to_pylist()), "<u8").reshape(-1, families)
                tables, ranks = [], []
                for k in range(families):
                    for c, blocks in enumerate(choices):
                        moved = np.zeros(len(prints), np.uint64)
                        for shift, width in blocks[:-1]:
                            mask = np.uint64((1 << width) - 1)
                            moved = (moved << np.uint64(width)) | ((prints[:, k] >> np.uint64(shift)) & mask)
                        tables.append(np.full(len(moved), k * len(choices) + c, np.int32))
                        ranks.append((_gray_rank(moved) ^ np.uint64(1 << 63)).view(np.int64))
                columns = [pa.array(np.concatenate(tables)), pa.array(np.concatenate(ranks)), pa.array(np.tile(entry, len(tables)))]
                if carries:
                    columns.append(pa.concat_arrays([column(batch, "prints")] * len(tables)))
                yield pa.RecordBatch.from_arrays(columns, ["table", "rank", "entry", "prints"][: len(columns)])

    return run


def _join_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray, used: list | None = None) -> np.ndarray:
    """Local groups with the links (a, b) added; ``root`` names the first member of each group.

    ``used`` gets the links that were needed for it: no more than there are members.
    """
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return root
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        low, high = np.minimum(x, y), np.maximum(x, y)
        order = np.lexsort((low, high))
        pick = order[np.append(True, high[order][1:] != high[order][:-1])]
        root = root.copy()
        root[high[pick]] = low[pick]
        if used is not None:
            used.append((a[pick], b[pick]))
        while True:
            shorter = root[root]
            if (shorter == root).all():
                break
            root = shorter


def _join_by_distance(root: np.ndarray, a: np.ndarray, b: np.ndarray, distance: np.ndarray, used: list) -> np.ndarray:
    for d in np.unique(distance):
        root = _join_roots(root, a[distance == d], b[distance == d], used)
    return root


def _alike(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the texts of two rows of fingerprints share ``similarity`` of their shingles, as all of them tell it."""
    cosine = np.cos(np.pi * np.bitwise_count(a ^ b).sum(axis=1) / (64 * a.shape[1]))
    return cosine / (2 - cosine) >= similarity - MARGIN


def _join_alike(root: np.ndarray, a: np.ndarray, b: np.ndarray, prints: np.ndarray, similarity: float, used: list) -> np.ndarray:
    for at in range(0, len(a), _TOLD):
        x, y = a[at : at + _TOLD], b[at : at + _TOLD]
        open_ = root[x] != root[y]
        x, y = x[open_], y[open_]
        good = _alike(prints[x], prints[y], similarity)
        root = _join_roots(root, x[good], y[good], used)
    return root


def _rows_of(raw: pa.Array, families: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw.to_pylist()), "<u8").reshape(-1, families)


class _Leaves:
    """The hierarchy over one stretch of sorted entries: leaves and upper nodes with the bits they share."""

    def __init__(self, bucket: np.ndarray, value: np.ndarray):
        n = len(value)
        first = np.ones(n, bool)
        first[1:] = bucket[1:] != bucket[:-1]
        place = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
        self.start = np.flatnonzero(place % _LEAF == 0)
        self.size = np.diff(np.append(self.start, n))
        self.same, self.bits = self._shared(value, value, self.start)
        self.bucket = bucket[self.start]
        slot = np.arange(_LEAF)
        self.valid = slot < self.size[:, None]
        self.value = value[np.minimum(self.start[:, None] + slot, n - 1)]
        top = place[self.start] // _LEAF % _FAN == 0
        self.up_start = np.flatnonzero(top)
        self.up_size = np.diff(np.append(self.up_start, len(self.start)))
        self.up_same, self.up_bits = self._shared(np.bitwise_and.reduceat(value, self.start), np.bitwise_or.reduceat(value, self.start), self.up_start)
        self.up_bucket = self.bucket[self.up_start]

    @staticmethod
    def _shared(low: np.ndarray, high: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        every, some = np.bitwise_and.reduceat(low, start), np.bitwise_or.reduceat(high, start)
        return ~(every ^ some), every

    def pairs(self, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaves of one bucket (a leaf with itself too) whose shared bits leave a link possible."""
        step = 0
        while True:
            a = np.flatnonzero(self.up_bucket[: len(self.up_bucket) - step] == self.up_bucket[step:]) if step < len(self.up_bucket) else []
            if not len(a):
                return
            b = a + step
            near = np.bitwise_count((self.up_bits[a] ^ self.up_bits[b]) & self.up_same[a] & self.up_same[b]) <= max_bits
            yield from self._leaf_pairs(a[near], b[near], max_bits)
            step += 1

    def _leaf_pairs(self, a: np.ndarray, b: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        fan = np.arange(_FAN)
        for at in range(0, len(a), _BLOCK):
            x, y = a[at : at + _BLOCK], b[at : at + _BLOCK]
            i = (self.up_start[x][:, None] + fan)[:, :, None]
            j = (self.up_start[y][:, None] + fan)[:, None, :]
            there = (fan < self.up_size[x][:, None])[:, :, None] & (fan < self.up_size[y][:, None])[:, None, :] & (i <= j)
            p, q, r = np.nonzero(there)
            i, j = i[p, q, 0], j[p, 0, r]
            near = np.bitwise_count((self.bits[i] ^ self.bits[j]) & self.same[i] & self.same[j]) <= max_bits
            i, j = i[near], j[near]
            for k in range(0, len(i), _BLOCK):
                yield i[k : k + _BLOCK], j[k : k + _BLOCK]

    def forest(self, max_bits: int, prints: np.ndarray | None = None, similarity: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Links between entries that connect all that are within ``max_bits``, the closest first where there is a
        choice, and the first entry of each one's group. Leaves that are already in one group are not compared.
        With ``prints``, only pairs that all fingerprints tell to be similar join two groups."""
        root, used = np.arange(int(self.size.sum())), []
        for i, j in self.pairs(max_bits):
            low, high = np.minimum.reduceat(root, self.start), np.maximum.reduceat(root, self.start)
            open_ = (low[i] != high[j]) | (high[i] != low[j])
            i, j = i[open_], j[open_]
            apart = np.bitwise_count(self.value[i][:, :, None] ^ self.value[j][:, None, :])
            p, q, r = np.nonzero((apart <= max_bits) & self.valid[i][:, :, None] & self.valid[j][:, None, :])
            one, two = self.start[i[p]] + q, self.start[j[p]] + r
            if prints is None:
                root = _join_by_distance(root, one, two, apart[p, q, r], used)
            else:
                root = _join_alike(root, one, two, prints, similarity, used)
        return *_joined(used), root


def _joined(used: list) -> tuple[np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(a for a, _ in used)]), np.concatenate([none, *(b for _, b in used)])


_FOUND = "u long, v long, bucket_table int, bucket long, part long, part_entry long, same long, bits long, ranks binary, entries binary, groups binary"


def _found(similarity: float | None) -> str:
    return _FOUND if similarity is None else _FOUND + ", all_prints binary"


def _search(choices: list, max_bits: int, families: int, similarity: float | None):
    names = ["table", "rank", "entry"] + ["prints"] * (similarity is not None)
    front = np.array([blocks[-1][0] for blocks in choices], np.uint64)

    def buckets(table: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ordered = rank.view(np.uint64) ^ np.uint64(1 << 63)
        value = ordered ^ (ordered >> np.uint64(1))
        key = (value >> (np.uint64(64) - front[table % len(front)])).astype(np.int64)
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (table[1:] != table[:-1])
        return np.cumsum(new), key, value

    def search(rows: list[np.ndarray], opens: bool, closes: bool) -> pa.RecordBatch:
        """Links inside this stretch; leaves of its first (``opens``) or last (``closes``) bucket if others hold more."""
        table, rank, entry, *prints = rows
        bucket, key, value = buckets(table, rank)
        leaves = _Leaves(bucket, value)
        one, two, root = leaves.forest(max_bits, *prints, *[similarity] * len(prints))
        group = entry[root]
        cut = np.flatnonzero((leaves.bucket == bucket[0]) & opens | (leaves.bucket == bucket[-1]) & closes)
        at, n = leaves.start[cut], len(one)
        none = [None] * n
        ends = at + leaves.size[cut]
        columns = [
            pa.array([*entry[one].tolist(), *[None] * len(cut)], pa.int64()),
            pa.array([*entry[two].tolist(), *[None] * len(cut)], pa.int64()),
            pa.array([*none, *table[at].tolist()], pa.int32()),
            pa.array([*none, *key[at].tolist()], pa.int64()),
            # the first row names this stretch among those of one bucket
            pa.array([*none, *[int(rank[0])] * len(cut)], pa.int64()),
            pa.array([*none, *[int(entry[0])] * len(cut)], pa.int64()),
            pa.array([*none, *leaves.same[cut].view(np.int64).tolist()], pa.int64()),
            pa.array([*none, *leaves.bits[cut].view(np.int64).tolist()], pa.int64()),
            pa.array([*none, *[value[s:e].tobytes() for s, e in zip(at, ends)]], pa.binary()),
            pa.array([*none, *[entry[s:e].tobytes() for s, e in zip(at, ends)]], pa.binary()),
            pa.array([*none, *[group[s:e].tobytes() for s, e in zip(at, ends)]], pa.binary()),
            *(pa.array([*none, *[p[s:e].tobytes() for s, e in zip(at, ends)]], pa.binary()) for p in prints),
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _found(similarity).split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        many, opens = 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([_rows_of(column(batch, c), families) if c == "prints" else column(batch, c).to_numpy() for c in names])
            many += batch.num_rows
            if many < _CHUNK:
                continue
            rows = [np.concatenate(x) for x in zip(*held)]
            bucket = buckets(rows[0], rows[1])[0]
            cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on in the next batch
            through = cut == 0
            cut = many if through else cut
            yield search([x[:cut] for x in rows], opens, through)
            # a bucket cut here goes on, unless the next rows are another's; then its leaves only meet each other
            held, many, opens = ([], 0, True) if through else ([[x[cut:] for x in rows]], many - cut, False)
        if many:
            yield search([np.concatenate(x) for x in zip(*held)], opens, True)

    return run


def _across(max_bits: int, families: int, similarity: float | None):
    """Links between leaves of different parts of one bucket, fewer than they have groups; only similar ones if asked for.

    What a task has linked once, in this or another bucket, it neither compares nor links again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        for batch in batches:
            u, v = [], []
            sides = [column(batch, f"{c}{n}").to_pylist() for n in ("", "2") for c in ("ranks", "entries", "groups")]
            told = [column(batch, f"all_prints{n}") for n in ("", "2")] if similarity is not None else []
            for at, (x, xe, xg, y, ye, yg) in enumerate(zip(*sides)):
                xg, yg = np.frombuffer(xg, np.int64), np.frombuffer(yg, np.int64)
                tops = {top(g) for g in {*xg.tolist(), *yg.tolist()}}
                if len(tops) == 1:
                    continue
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                apart = np.bitwise_count(x[:, None] ^ y[None, :])
                i, j = np.nonzero(apart <= max_bits)
                if told and len(i):
                    one, two = (np.frombuffer(t[at].as_buffer(), "<u8").reshape(-1, families) for t in told)
                    good = _alike(one[i], two[j], similarity)
                    i, j = i[good], j[good]
                if not len(i):
                    continue
                order = np.lexsort((apart[i, j], yg[j], xg[i]))  # the closest of each pair of groups
                i, j = i[order], j[order]
                new = np.append(True, (xg[i][1:] != xg[i][:-1]) | (yg[j][1:] != yg[j][:-1]))
                xe, ye = np.frombuffer(xe, np.int64), np.frombuffer(ye, np.int64)
                for a, b in zip(i[new].tolist(), j[new].tolist()):
                    one, two = top(int(xg[a])), top(int(yg[b]))
                    if one != two:
                        parent[max(one, two)] = min(one, two)
                        u.append(int(xe[a]))
                        v.append(int(ye[b]))
            if len(parent) > _HELD_GROUPS:
                parent = {}
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def links(entries: DataFrame, families: int = 1, max_bits: int = MAX_BITS, similarity: float | None = None) -> DataFrame:
    """(u, v): links that connect exactly what all pairs within ``max_bits`` would connect; with ``similarity``, what those
    pairs among them would that are similar. ``entries``: (entry, prints)."""
    choices = block_choices(entries.count(), max_bits)
    carries = similarity is not None
    kind = "table int, rank long, entry long" + ", prints binary" * carries
    rows = entries.select("entry", "prints").mapInArrow(_index_rows(choices, families, carries), kind)
    order = ["table", "rank", "entry"]
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = cut_lineage(ranges.mapInArrow(_search(choices, max_bits, families, similarity), _found(similarity)), "leaves")
    leaves = found.where("u IS NULL").drop("u", "v")
    sides = ["ranks", "entries", "groups", *["all_prints"] * carries]
    other = leaves.select("bucket_table", "bucket", *(F.col(c).alias(f"{c}2") for c in ("part", "part_entry", "same", "bits", *sides)))
    apart = F.bit_count(F.expr("(bits ^ bits2) & same & same2"))
    later = F.struct("part", "part_entry") < F.struct("part2", "part_entry2")
    met = leaves.join(other, ["bucket_table", "bucket"]).where(later & (apart <= max_bits))
    across = met.select(*(f"{c}{n}" for c in sides for n in ("", "2"))).mapInArrow(_across(max_bits, families, similarity), "u long, v long")
    return found.where("u IS NOT NULL").select("u", "v").unionByName(across)


# ---- groups ---------------------------------------------------------------------------------


def _similar(families: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near = _alike(*(_rows_of(column(batch, c), families) for c in ("prints", "prints2")), similarity)
            yield pa.RecordBatch.from_arrays([column(batch, "u"), column(batch, "v"), pa.array(near)], ["u", "v", "near"])

    return run


def similar(found: DataFrame, entries: DataFrame, families: int, similarity: float) -> DataFrame:
    """(u, v, near): whether the ends of each link are similar."""
    other = entries.select(F.col("entry").alias("v"), F.col("prints").alias("prints2"))
    sides = found.join(entries.select(F.col("entry").alias("u"), "prints"), "u").join(other, "v")
    return sides.select("u", "v", "prints", "prints2").mapInArrow(_similar(families, similarity), "u long, v long, near boolean")


def similar_links(entries: DataFrame, families: int, max_bits: int, similarity: float) -> DataFrame:
    """(u, v): links that connect exactly what all similar pairs within ``max_bits`` would connect."""
    candidates = cut_lineage(links(entries, families, max_bits).distinct(), "candidates")
    told = cut_lineage(similar(candidates, entries, families, similarity), "told")
    good, bad = told.where("near").select("u", "v"), told.where("NOT near")
    if bad.isEmpty():
        return good
    roots = cut_lineage(components(candidates), "candidate-groups")
    # stored, so that adaptive execution may split the join for a large group
    open_ = cut_lineage(bad.select(F.col("u").alias("node")).distinct().join(roots, "node").select("root").distinct(), "open")
    inside = roots.join(open_, "root", "left_semi").select(F.col("node").alias("entry"))
    again = cut_lineage(entries.join(inside, "entry", "left_semi"), "open-entries")
    return good.unionByName(links(again, families, max_bits, similarity))


def grouped(docs: DataFrame, words: int, families: int = 1, max_bits: int = MAX_BITS, similarity: float | None = None) -> DataFrame:
    """(doc, text_key, entry, root): the group of each row, named by one of its entries."""
    rows = cut_lineage(fingerprints(docs, words, families), "prints")
    entries = cut_lineage(rows.groupBy("entry").agg(F.first("prints").alias("prints")), "entries")
    linked = links(entries, families, max_bits) if similarity is None else similar_links(entries, families, max_bits, similarity)
    found = components(linked).withColumnRenamed("node", "entry")
    # only entries with a link are in it; a heavy fingerprint is split by adaptive execution
    return rows.drop("prints").join(found, "entry", "left").withColumn("root", F.coalesce("root", "entry"))


def near_duplicate_classes(docs: DataFrame, words: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row: the hexadecimal fingerprint and the lowest id of its group."""
    rows = cut_lineage(grouped(docs, words, 1, max_bits), "grouped")
    lowest = rows.groupBy("root").agg(F.min("doc").alias("lowest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # stored, so that adaptive execution may split the join for a large group
    named = rows.join(cut_lineage(lowest, "lowest"), "root", "left")
    real = lambda c: F.when(c != NO_ID, c)
    return named.select(
        real(F.col("doc")).alias("doc_id"),
        F.lower(F.lpad(F.hex("entry"), 16, "0")).alias("fingerprint"),
        real(F.coalesce("lowest", "doc")).alias("component_id"),
    )


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, families: int = FAMILIES, max_bits: int = NEAR_BITS) -> DataFrame:
    """``docs`` with one row of each group: that of the lowest id (by the hash of the text where ids are equal).

    Each text has ``families`` fingerprints. Any one within ``max_bits`` makes a candidate, which happens with a
    probability that rises steeply about the similarity; all of them together tell the share of common shingles
    of a candidate, and it is a link from ``similarity`` less ``MARGIN`` on.
    """
    rows = cut_lineage(grouped(docs, words, families, max_bits, similarity), "grouped")
    first = rows.groupBy("root").agg(F.min(F.struct("doc", "text_key")).alias("kept"), F.count(F.lit(1)).alias("n"))
    named = rows.join(cut_lineage(first.where("n > 1"), "first"), "root")
    doc, text = unused(docs, "_group_doc", "_group_text")
    lost = named.where(F.struct("doc", "text_key") != F.col("kept")).select(F.col("doc").alias(doc), F.col("text_key").alias(text))
    this = (id_or_lowest("doc_id") == F.col(doc)) & (F.xxhash64("text") == F.col(text))
    left = docs.join(lost.distinct(), this, "left_anti")
    again = cut_lineage(rows.groupBy("doc", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "again")
    if again.isEmpty():
        return left
    # rows that repeat both id and text: the first of each stays
    again = again.select(F.col("doc").alias(doc), F.col("text_key").alias(text))
    twice = (id_or_lowest("doc_id") == F.col(doc)) & (F.xxhash64("text") == F.col(text))
    single = left.join(again, twice, "left_anti")
    repeated = left.join(again, twice, "left_semi").withColumns({doc: id_or_lowest("doc_id"), text: F.xxhash64("text")})
    return single.unionByName(repeated.dropDuplicates([doc, text]).drop(doc, text))
