"""URL rules by a cascade of Bloom filters: exact membership for all keys of the corpus, without a join.

A rule is a host and a path prefix; it fits its host and all subdomains. The keys of a url are its host and every parent
of it, each with every path prefix as long as some rule's. All keys of all urls are the universe. Level 1 encodes the
listed keys; level 2 the keys of the universe that level 1 takes for listed but are not; level 3 the listed
keys that level 2 takes for those; and so on until a level has no false positive left. A key of the universe is listed
exactly if the first level that denies it is an even one, so the answer is exact for every url of the corpus.

The universe is read once, in tasks, to find the false positives of level 1; only those are shuffled. With p1 =
|listed| / (sqrt(2) |universe|) at level 1 and 1/2 after it, the levels shrink geometrically. Filters of all levels
together may take ``MAX_BYTES``; what would not fit stays a table, and urls that hold such a key are told apart by an
equi-join.

Defined results: a null url or one without ``://`` has an empty host and path, no rule, and is allowed; repeated rows are
judged one by one; an empty table gives no rows. A url without a rule is allowed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.llm.common import column
from passagemill.plans.session import cut_lineage

# The rules of the registered query.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: For all filters of a cascade together.
MAX_BYTES = 64 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def keys_of(host: str, path: str, lengths: list[int]) -> list[str]:
    """The host and its parents, each with the path's prefixes of the given lengths; longest first."""
    if not host:
        return []
    parts = host.split(".")
    hosts = [".".join(parts[i:]) for i in range(len(parts))]
    found = [h + path[:n] for h in hosts for n in lengths if n <= len(path)]
    return sorted(set(found), key=lambda k: (-len(k), k))


class Bloom:
    """One level: ``bits`` bits, ``hashes`` places for each key; places come from one 128-bit hash seeded by the level."""

    def __init__(self, n: int, rate: float, level: int):
        self.bits = max(64, math.ceil(n * math.log(1 / rate) / math.log(2) ** 2))
        self.hashes = max(1, round(self.bits / max(n, 1) * math.log(2)))
        self.hashes = min(self.hashes, 32)
        self.level = level
        self.table = np.zeros(-(-self.bits // 8), np.uint8)

    def state(self) -> tuple:
        """Numbers and an array alone: a broadcast names classes by their module, which workers need not have."""
        return self.bits, self.hashes, self.level, self.table

    @classmethod
    def of(cls, state: tuple) -> Bloom:
        one = cls.__new__(cls)
        one.bits, one.hashes, one.level, one.table = state
        return one

    def places(self, key: str) -> list[int]:
        h = xxhash.xxh3_128_intdigest(key.encode(), self.level)
        a, b = h >> 64, (h & ((1 << 64) - 1)) | 1
        return [(a + i * b) % self.bits for i in range(self.hashes)]

    def __contains__(self, key: str) -> bool:
        return all(self.table[p >> 3] >> (p & 7) & 1 for p in self.places(key))


def _filled(keys: DataFrame, level: Bloom) -> Bloom:
    """The filter with all ``keys`` in it: tasks work out the places, bytes are put together by OR."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.array([p for k in column(batch, "key").to_pylist() for p in level.places(k)], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(places >> 3), pa.array(1 << (places & 7))], ["at", "bit"])

    # at most one row for each byte of the filter, whose size the caller has checked
    for r in keys.mapInArrow(run, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        level.table[r["at"]] = r["bits"]
    return level


class Cascade:
    """Levels, and the keys that had no room in them (a table, or None)."""

    def __init__(self, levels: list[Bloom], rest: DataFrame | None):
        self.levels, self.rest = levels, rest

    @staticmethod
    def answer(levels: list[Bloom], key: str) -> bool:
        for depth, level in enumerate(levels):
            if key not in level:
                return depth % 2 == 1
        return len(levels) % 2 == 1


def build(universe: DataFrame, listed: DataFrame, max_bytes: int = MAX_BYTES) -> Cascade:
    """Exact for every key of ``universe`` (key). ``listed``: (key)."""
    spark = universe.sparkSession
    listed = cut_lineage(listed.select("key").distinct(), "listed")
    n = listed.count()
    size = universe.agg(F.approx_count_distinct("key")).first()[0] or 1
    rate = min(0.5, max(n, 1) / (math.sqrt(2) * max(size, 1)))
    levels: list[Bloom] = []
    used, inside, outside = 0, listed, universe
    while n:
        level = Bloom(n, rate if not levels else 0.5, len(levels))
        used += len(level.table)
        if used > max_bytes:
            # keys that the levels so far take wrongly: those of the side that was to be encoded
            return Cascade(levels, inside)
        level = _filled(inside, level)
        levels.append(level)
        shared = spark.sparkContext.broadcast(level.state())

        def taken(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            one = Bloom.of(shared.value)
            for batch in batches:
                keys = [k for k in dict.fromkeys(column(batch, "key").to_pylist()) if k in one]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())], ["key"])

        wrong = outside.select("key").mapInArrow(taken, "key string").distinct()
        if len(levels) == 1:
            wrong = wrong.join(listed, "key", "left_anti")
        wrong = cut_lineage(wrong, "wrong")
        inside, outside = wrong, inside
        n = inside.count()
    return Cascade(levels, None)


def _keys(lengths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = dict.fromkeys(zip(column(batch, "host").to_pylist(), column(batch, "path").to_pylist()))
            keys = dict.fromkeys(k for h, p in pairs for k in keys_of(h, p, lengths))
            yield pa.RecordBatch.from_arrays([pa.array(list(keys), pa.string())], ["key"])

    return run


def _judged(shared, lengths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = [Bloom.of(state) for state in shared.value]
        for batch in batches:
            hits = []
            for host, path in zip(column(batch, "host").to_pylist(), column(batch, "path").to_pylist()):
                hits.append([k for k in keys_of(host, path, lengths) if Cascade.answer(levels, k)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, pa.list_(pa.string()))], [*batch.schema.names, "hits"])

    return run


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row: the longest rule that fits, and what it says.

    Block rules and allow rules are two cascades over the same keys.
    """
    spark: SparkSession = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    parsed = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    lengths = sorted({len(p) for _, _, p in rules})
    universe = parsed.select("host", "path").mapInArrow(_keys(lengths), "key string")
    out, names = parsed, []
    for verdict in ("block", "allow"):
        keys = [(h + p,) for v, h, p in rules if v == verdict]
        cascade = build(universe, spark.createDataFrame(keys, "key string"), max_bytes)
        shared = spark.sparkContext.broadcast([level.state() for level in cascade.levels])
        schema = ", ".join(f"{n} {t}" for n, t in out.dtypes) + ", hits array<string>"
        out = out.mapInArrow(_judged(shared, lengths), schema)
        if cascade.rest is not None:
            out = _corrected(out, cascade, lengths)
        name = f"{verdict}_key"
        # keys come longest first
        out = out.withColumn(name, F.get("hits", F.lit(0))).drop("hits")
        names.append(name)
    block, allow = F.col("block_key"), F.col("allow_key")
    blocked = block.isNotNull() & (allow.isNull() | (F.length(block) > F.length(allow)))
    return out.select(
        "page_id",
        "host",
        "path",
        F.when(blocked, block).otherwise(allow).alias("rule"),
        F.when(blocked, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"),
    )


def _corrected(out: DataFrame, cascade: Cascade, lengths: list[int]) -> DataFrame:
    """``hits`` put right for the keys that had no room in a filter, by an equi-join on (url key)."""
    listed = len(cascade.levels) % 2 == 0  # the side that was to be encoded next
    wrong = cascade.rest.withColumn("odd", F.lit(True))
    pairs = out.select("host", "path").distinct()

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, p, k) for h, p in zip(column(batch, "host").to_pylist(), column(batch, "path").to_pylist()) for k in keys_of(h, p, lengths)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["host", "path", "key"])

    odd = pairs.mapInArrow(exploded, "host string, path string, key string").join(wrong, "key")
    odd = odd.groupBy("host", "path").agg(F.collect_list("key").alias("odd_keys"))
    joined = out.join(odd, ["host", "path"], "left")
    none = F.array().cast("array<string>")
    mended = F.array_union("hits", F.coalesce("odd_keys", none)) if listed else F.array_except("hits", F.coalesce("odd_keys", none))
    by_length = F.array_sort(mended, lambda a, b: F.length(b) - F.length(a))
    return joined.withColumn("hits", by_length).drop("odd_keys").select(*out.columns)
