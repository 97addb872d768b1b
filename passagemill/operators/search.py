"""Exact vector search.

Queries are packed into rows of at most ``QUERY_ROWS`` vectors and stored, so that the planner knows their size; items
are packed into rows of an Arrow batch, and the two meet in an equi-join on the number of the query block. One block of queries
is broadcast and the items scanned in place; many meet groups of items, each pair of a block and a group in one task. Scores come from matrix
products, and only the best ``k`` per query leave a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.functions import vectors as V
from passagemill.plans.session import cut_lineage

DIGITS = 6
QUERY_ROWS = 16384
BLOCK_ROWS = 8192
#: Queries and items scored at once.
TILE = (1024, 4096)
#: Hits that wait before they are sorted in.
MERGED = 4096
#: As many queries at least make a block of their own, where there are more cores than blocks.
FEW_QUERIES = 1024
#: Bytes of item vectors that a block of queries meets in one task.
GROUP_BYTES = 64 << 20
_ARROW = {"long": pa.int64(), "integer": pa.int32(), "string": pa.string(), "double": pa.float64()}


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors as rows. All must have the same length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    packed = pa.types.is_binary(column.type)  # float32 numbers
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    widths = np.diff(ends)
    if (widths != widths[0]).any():
        raise ValueError(f"vectors of different lengths: {sorted(set((widths // (4 if packed else 1)).tolist()))[:5]}")
    if packed:
        raw = np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]
        return raw.view(np.float32).reshape(len(column), -1).astype(np.float64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _scale(m: np.ndarray, metric: str) -> np.ndarray:
    if metric == "dot":
        return m
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(length > 0, m / length, np.nan)


def _rough(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows in 32 bits, and their lengths (0 for one that has none)."""
    with np.errstate(over="ignore", invalid="ignore"):
        length = np.sqrt((m * m).sum(axis=1))
        return m.astype(np.float32), np.where(np.isnan(length), 0.0, length)


class Best:
    """Running best ``k`` per query over batches, in the order score down, id up. What comes in is sorted in when it is worth a pass."""

    def __init__(self, k: int, n_queries: int):
        self.k, self.floor = k, np.full(n_queries, -np.inf)
        self.q = np.zeros(0, dtype=np.int64)
        self.score = np.zeros(0)
        self.ids: np.ndarray | None = None
        self.waiting: list[tuple] = []

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if len(q):
            self.waiting.append((q, score, ids))
            if self.ids is None or sum(len(x[0]) for x in self.waiting) > max(MERGED, len(self.q) // 2):
                self.merge()

    def merge(self) -> None:
        if not self.waiting:
            return
        own = [] if self.ids is None else [(self.q, self.score, self.ids)]
        q, score, ids = (np.concatenate(x) for x in zip(*own, *self.waiting))
        self.waiting = []
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        first = np.r_[0, np.flatnonzero(np.diff(q)) + 1] if len(q) else np.zeros(0, dtype=np.int64)
        size = np.diff(np.r_[first, len(q)])
        place = np.arange(len(q)) - np.repeat(first, size)
        keep = place < self.k
        self.q, self.score, self.ids = q[keep], score[keep], ids[keep]
        full = place == self.k - 1
        self.floor[q[full]] = score[full]


def _ids(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = column.to_numpy(zero_copy_only=False)
    return out.astype(str) if out.dtype == object else out


class Scan:
    """Best items for one block of queries while item batches go by: (query id, item id, score, lane).

    Items may carry a lane; the best ``k`` are then kept for each query and lane. With ``books`` (parts, centres, width) the
    items are product codes: each query has the products with all centres in a table, and an item's score is a
    sum of entries looked up there.
    """

    def __init__(
        self, q_ids: np.ndarray, queries: np.ndarray, k: int | None, metric: str, skip_self: bool, low: float | None, books: np.ndarray | None = None
    ):
        self.q_ids, self.queries, self.k = q_ids, _scale(queries, metric), k
        self.metric, self.skip_self, self.low = metric, skip_self, low
        self.kept: dict = {}
        self.tables = None
        if books is not None:
            self.tables = np.einsum("qpw,pcw->qpc", self.queries.reshape(len(q_ids), books.shape[0], -1), books)
        else:
            self.rough, self.length = _rough(self.queries)

    def _scores(self, rows: slice, items: np.ndarray) -> np.ndarray:
        if self.tables is None:
            return self.queries[rows] @ items.T
        tables, codes = self.tables[rows], items.astype(np.int64)
        return sum(tables[:, p, codes[:, p]] for p in range(codes.shape[1]))

    def _apart(self, rows: slice, ids: np.ndarray, items: np.ndarray) -> np.ndarray | None:
        """(queries, items): pairs that are not looked at, if any."""
        return None

    def _found(self, best: Best | None, rows: slice, ids: np.ndarray, items: np.ndarray, rough: np.ndarray | None, longest: float):
        """(query, item, score) of one tile, by place, that may matter: at or above the floor of their query.

        Products of 32-bit numbers tell which pairs these can be, up to what rounding may change; those are worked out in 64 bits.
        """
        reach = self.length[rows] * longest if rough is not None else None
        # numbers too large for 32 bits, and searches that return everything
        whole = rough is None or not (reach < 1e30).all() or (best is None and self.low is None)
        scores = self._scores(rows, items) if whole else self.rough[rows] @ rough.T
        slack = 1e-6 if whole else 1e-6 + 1.2e-7 * (items.shape[1] + 8) * reach
        apart = self._apart(rows, ids, items)
        if apart is not None:
            np.copyto(scores, np.nan, where=apart)
        least = np.full(len(scores), -np.inf if self.low is None else self.low)
        limit = least
        if best is not None:
            limit = least = np.maximum(least, best.floor)
            if best.k < scores.shape[1] and np.isneginf(best.floor).any():
                out = np.isnan(scores)
                if self.skip_self:
                    out |= self.q_ids[rows][:, None] == ids[None, :]
                filled = np.where(out, -np.inf, scores)
                limit = np.maximum(least, -np.partition(-filled, best.k - 1, axis=1)[:, best.k - 1] - slack)
        at, item = np.nonzero(scores >= (limit - slack)[:, None])
        if whole:
            exact = scores[at, item]
        elif len(at) * 8 > scores.size:
            exact = self._scores(rows, items)[at, item]
        else:
            exact, step = np.empty(len(at)), max(1, (4 << 20) // items.shape[1])
            for i in range(0, len(at), step):
                part = slice(i, i + step)
                exact[part] = np.einsum("ij,ij->i", self.queries[rows][at[part]], items[item[part]])
        exact = np.round(exact, DIGITS) + 0.0
        keep = exact >= least[at]
        if self.skip_self:
            keep &= self.q_ids[rows][at] != ids[item]
        return at[keep], item[keep], exact[keep]

    def add(self, all_ids: np.ndarray, all_items: np.ndarray, lanes: np.ndarray):
        """Without ``k``, everything that counts comes out at once."""
        if self.tables is None and self.queries.shape[1] != all_items.shape[1]:
            raise ValueError(f"queries have {self.queries.shape[1]} dimensions, items {all_items.shape[1]}")
        present = np.unique(lanes)
        for lane in present:
            mine = lanes == lane if len(present) > 1 else slice(None)  # no copy for a single lane
            lane_ids, lane_items = all_ids[mine], all_items[mine]
            for start in range(0, len(lane_ids), TILE[1]):
                ids, items = lane_ids[start : start + TILE[1]], lane_items[start : start + TILE[1]]
                rough, longest = None, 0.0
                if self.tables is None:
                    items = _scale(items.astype(np.float64), self.metric)
                    rough, length = _rough(items)
                    longest = length.max()
                for first in range(0, len(self.q_ids), TILE[0]):
                    rows = slice(first, first + TILE[0])
                    q_ids = self.q_ids[rows]
                    best = self.kept.setdefault((lane, first), Best(self.k, len(q_ids))) if self.k else None
                    at, item, score = self._found(best, rows, ids, items, rough, longest)
                    if best is not None:
                        best.add(at, score, ids[item])
                    else:
                        yield q_ids[at], ids[item], score, np.repeat(lane, len(at))

    def rest(self):
        for (lane, first), best in self.kept.items():
            best.merge()
            if best.ids is not None:
                yield self.q_ids[first + best.q], best.ids, best.score, np.repeat(lane, len(best.q))


def _sides(queries: DataFrame, items: DataFrame, lane: str | None = None, scanned: str | None = None):
    """Both sides with an id, float or packed vectors and a lane, and the schema of their hits.

    A lane travels as text behind a mark, and a NULL one as the empty text: it is a lane of its own. The side whose id is ``scanned`` keeps its
    rows without a vector: ``_parts`` leaves them out, since Spark would run the encoder once more for a filter on what it returns.
    """

    def side(df: DataFrame, *columns) -> DataFrame:
        rows = (V.as_floats(df) if columns[0] == scanned else V.as_vectors(df)).where(F.col(columns[0]).isNotNull())
        return rows.select(*columns, "vec")

    lane_column = F.coalesce(F.concat(F.lit("="), F.col(lane).cast("string")), F.lit("")) if lane else F.lit("")
    extra = ["cell"] if "cell" in queries.columns else []
    q = side(queries, "query_id", *extra)
    d = side(items, "item_id", lane_column.alias("lane"), *extra)
    schema = T.StructType(
        [
            T.StructField("query_id", q.schema["query_id"].dataType),
            T.StructField("item_id", d.schema["item_id"].dataType),
            T.StructField("score", T.DoubleType()),
            T.StructField("lane", d.schema["lane"].dataType),
        ]
    )
    return q, d, schema, pa.schema([(f.name, _ARROW[f.dataType.typeName()]) for f in schema.fields])


def _tabled(arrow: pa.Schema) -> Callable:
    def table(found) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x).cast(t) for x, t in zip(found, arrow.types)], schema=arrow)

    return table


def knn_in_cells(queries: DataFrame, items: DataFrame, k: int, metric: str = "dot", skip_self: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Best ``k`` among the items that share a cell with the query; both sides carry ``cell``."""
    q, d, schema, arrow = _sides(queries, items)
    found = _in_blocks(q, d, _meeting((k, metric, skip_self, None), _tabled(arrow), arrow), schema, block_rows).drop("lane")
    # a pair may share several cells
    return ranked(found.groupBy("query_id", "item_id").agg(F.max("score").alias("score")), k)


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _stored_blocks(df: DataFrame, key: str, rows: int, least: int = 0, cut: int | None = None) -> tuple[DataFrame, int]:
    """(block, ids, lanes, vecs): ``df`` in stored rows of about ``rows`` vectors, and how many blocks there are; up to ``least`` where there are
    vectors for as many. With ``cut`` a block is in rows of so many vectors."""
    n = df.count()
    blocks = max(1, -(-n // rows), min(least, -(-n // FEW_QUERIES)))
    lane = F.col("lane") if "lane" in df.columns else F.lit("").alias("lane")
    placed = df.select(F.pmod(F.xxhash64(key, "vec"), F.lit(blocks)).cast("int").alias("block"), F.col(key).alias("id"), lane, "vec")

    def pack(group: pa.Table) -> pa.Table:
        parts = [group.slice(at, cut or len(group)) for at in range(0, len(group), cut or len(group))]
        return pa.concat_tables([pa.table({"block": x["block"].slice(0, 1), **_packed_row(x["id"], x["lane"], x["vec"])}) for x in parts])

    schema = f"block int, ids array<{_kind(df, key)}>, lanes array<string>, vecs binary"
    return cut_lineage(placed.groupBy("block").applyInArrow(pack, schema), "blocks"), blocks


def _packed_row(ids, lanes, vecs) -> dict:
    ids, lanes = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (ids, lanes))
    ends = pa.array([0, len(ids)], pa.int32())
    raw = _matrix(vecs).astype("<f4").tobytes()
    return {"ids": pa.ListArray.from_arrays(ends, ids), "lanes": pa.ListArray.from_arrays(ends, lanes), "vecs": pa.array([raw], pa.binary())}


def _parts(df: DataFrame, key: str, rows: int) -> DataFrame:
    """(ids, lanes, vecs): ``df`` packed where it is, batch by batch; rows without a vector are left out."""
    lane = F.col("lane") if "lane" in df.columns else F.lit("").alias("lane")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column(2)
            size = pc.binary_length(vecs) if pa.types.is_binary(vecs.type) else pc.list_value_length(vecs)
            batch = batch.filter(pc.greater(size, 0))
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                row = _packed_row(*(part.column(i) for i in range(3)))
                yield pa.RecordBatch.from_arrays(list(row.values()), list(row))

    return df.select(F.col(key).alias("id"), lane, "vec").mapInArrow(pack, f"ids array<{_kind(df, key)}>, lanes array<string>, vecs binary")


HELD_BLOCKS = 4


def _scored(
    queries: DataFrame,
    items: DataFrame,
    scan: tuple,
    query_rows: int,
    block_rows: int,
    lane: str | None = None,
    move_items: bool = False,
) -> DataFrame:
    """``scan``: (k, metric, skip_self, low) and code books, if any. With ``move_items`` the items are the side in stored blocks, for few items
    and many queries; the queries are then scanned in place."""
    q, d, schema, arrow = _sides(queries, items, lane, "query_id" if move_items else "item_id")
    table = _tabled(arrow)
    if move_items:
        moved, blocks = _stored_blocks(d, "item_id", query_rows)
        parts = _parts(q, "query_id", block_rows)
    else:
        moved, blocks = _stored_blocks(q, "query_id", query_rows, 2 * q.sparkSession.sparkContext.defaultParallelism)
        parts = _parts(d, "item_id", block_rows)
    if blocks == 1:
        moved = F.broadcast(moved)  # one row of at most ``query_rows`` vectors
    elif scan[0] is not None and not move_items:
        return _laned(_grid(moved, blocks, parts, lambda ids, vecs, _: Scan(ids, vecs, *scan), schema, arrow), items, lane)
    numbered = parts.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = numbered.join(moved.select("block", *(F.col(c).alias(f"m_{c}") for c in ("ids", "lanes", "vecs"))), "block")

    def side(row: dict, prefix: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = _ids(row[f"{prefix}ids"].values)
        return ids, np.frombuffer(row[f"{prefix}vecs"].as_buffer(), "<f4").reshape(len(ids), -1).astype(np.float64), _ids(row[f"{prefix}lanes"].values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Scan] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i] for j, name in enumerate(batch.schema.names)}
                here, there = side(row, ""), side(row, "m_")
                if move_items:
                    one = Scan(here[0], here[1], *scan)
                    for found in one.add(*there):
                        yield table(found)
                    for found in one.rest():
                        yield table(found)
                    continue
                block = row["block"].as_py()
                if block not in held:
                    if len(held) >= HELD_BLOCKS:  # what is put out early is ranked with the rest
                        yield from (table(found) for one in held.values() for found in one.rest())
                        held = {}
                    held[block] = Scan(there[0], there[1], *scan)
                for found in held[block].add(*here):
                    yield table(found)
        yield from (table(found) for one in held.values() for found in one.rest())

    return _laned(met.mapInArrow(run, schema), items, lane)


def _grid(moved: DataFrame, blocks: int, parts: DataFrame, scan: Callable, schema: T.StructType, arrow: pa.Schema) -> DataFrame:
    """Every block of queries against every group of items, a task's work each; a group has about ``GROUP_BYTES`` of vectors, or fewer where
    there are more cores than blocks. ``scan`` makes a ``Scan`` for ids, vectors and lanes of queries."""
    parts, table = cut_lineage(parts, "parts"), _tabled(arrow)
    n, size = parts.agg(F.count(F.lit(1)), F.sum(F.octet_length("vecs"))).first()
    groups = max(1, -(-(size or 0) // GROUP_BYTES), min(n, 2 * parts.sparkSession.sparkContext.defaultParallelism // blocks))
    left = moved.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = parts.withColumn("group", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))
    right = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(one: pa.Table, many: pa.Table) -> pa.Table:
        found = []
        for here in _rows(one):
            held = scan(here[0], here[1].astype(np.float64), here[2])
            for there in _rows(many):
                found += [table(x) for x in held.add(*there)]
            found += [table(x) for x in held.rest()]
        return pa.Table.from_batches(found, schema=arrow)

    return left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(meet, schema)


def _rows(packed: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, vectors of 32 bits and lanes of each packed row."""
    for batch in packed.to_batches():
        for i in range(batch.num_rows):
            ids, lanes, vecs = (batch.column(c)[i] for c in ("ids", "lanes", "vecs"))
            keys = _ids(ids.values)
            yield keys, np.frombuffer(vecs.as_buffer(), "<f4").reshape(len(keys), -1), _ids(lanes.values)


def _laned(out: DataFrame, items: DataFrame, lane: str | None) -> DataFrame:
    if not lane:
        return out.drop("lane")
    return out.withColumn("lane", F.expr("CASE WHEN lane <> '' THEN substr(lane, 2) END").cast(items.schema[lane].dataType)).withColumnRenamed("lane", lane)


def _meeting(scan: tuple, table: Callable, arrow: pa.Schema) -> Callable:
    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            one = Scan(_ids(left["query_id"]), _matrix(left["vec"]), *scan)
            parts = [table(x) for x in one.add(_ids(right["item_id"]), _matrix(right["vec"]), _ids(right["lane"]))]
            parts += [table(x) for x in one.rest()]
        return pa.Table.from_batches(parts, schema=arrow)

    return meet


def _in_blocks(
    q: DataFrame, d: DataFrame, meet: Callable, schema: T.StructType, q_rows: int, d_rows: int | None = None, whole: tuple[str, str] | None = None
) -> DataFrame:
    """Every query of a cell meets every item of that cell, in blocks of bounded size.

    Both sides carry ``cell``. A cell is cut into as many query and item blocks as its two counts
    ask for, each query block is sent to all item blocks of its cell and the other way round, and an
    equi-join on (cell, query block, item block) brings them together. A cell that holds a third of
    all rows becomes many equal blocks. ``whole`` names a column of either side whose equal rows stay in one block.
    """

    def parts(df: DataFrame, rows: int, name: str) -> DataFrame:
        return df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))

    # stored, so that the planner knows it for the small table it is
    shape = cut_lineage(parts(q, q_rows, "q_parts").join(parts(d, d_rows or q_rows, "d_parts"), "cell"), "shape")

    def laid_out(df: DataFrame, own: str, other: str, own_parts: str, other_parts: str, together: str | None) -> DataFrame:
        # hashing the whole row spreads equal ids as well
        row = F.xxhash64(*([together] if together else [c for c in df.columns if c != "cell"]))
        return (
            df.join(shape, "cell")
            .withColumn(own, F.pmod(row, F.col(own_parts)).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_parts) - 1)))
            .drop("q_parts", "d_parts")
        )

    keys = ["cell", "q_block", "d_block"]
    q_side = laid_out(q, "q_block", "d_block", "q_parts", "d_parts", whole[0] if whole else None)
    d_side = laid_out(d, "d_block", "q_block", "d_parts", "q_parts", whole[1] if whole else None)
    return q_side.groupBy(*keys).cogroup(d_side.groupBy(*keys)).applyInArrow(meet, schema)


def ranked(scored: DataFrame, k: int | None, *by: str) -> DataFrame:
    """Rank by score down, id up; with ``k`` every task keeps its own best ``k`` before the shuffle."""
    w = Window.partitionBy(*(by or ("query_id",))).orderBy(F.desc("score"), F.asc("item_id"))
    out = scored.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.where(F.col("rank") <= k)


def knn_exact(
    queries: DataFrame,
    items: DataFrame,
    k: int = 5,
    metric: str = "dot",
    skip_self: bool = False,
    lane: str | None = None,
    query_rows: int = QUERY_ROWS,
    block_rows: int = BLOCK_ROWS,
    move_items: bool = False,
) -> DataFrame:
    """Best ``k`` items per query: (query_id, item_id, score, rank). More than there are gives all.

    With ``lane``, a column of the items, the best ``k`` per query and lane in the same one pass; a NULL lane is a
    lane of its own. ``move_items`` is for few items (classes, centres) and many queries, which then stay in
    place. Rows without an id or a vector are not searched; vectors of different lengths raise.
    """
    scored = _scored(queries, items, (k, metric, skip_self, None), query_rows, block_rows, lane, move_items)
    return ranked(scored, k, "query_id", *([lane] if lane else []))


def knn_codes(queries: DataFrame, coded: DataFrame, books: np.ndarray, k: int = 5, skip_self: bool = False) -> DataFrame:
    """Best ``k`` by the asymmetric product: exact queries against ``coded(item_id, codes)``, which are never decoded."""
    items = coded.where("codes IS NOT NULL").select("item_id", F.col("codes").cast(V.VECTOR).alias("vec"))
    return ranked(_scored(queries, items, (k, "dot", skip_self, None, books), QUERY_ROWS, BLOCK_ROWS), k)


def score_all_pairs(
    queries: DataFrame, items: DataFrame, metric: str = "dot", query_rows: int = QUERY_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The whole score matrix in long form, for callers that want it; searches keep the best k only."""
    return _scored(queries, items, (None, metric, False, None), query_rows, block_rows)


def pairs_above(
    queries: DataFrame, items: DataFrame, low: float, metric: str = "cosine", query_rows: int = QUERY_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Pairs scoring at least ``low``, a row never paired with itself."""
    return _scored(queries, items, (None, metric, True, low), query_rows, block_rows)


def hits_with_text(hits: DataFrame, items: DataFrame, item: str = "item_id") -> DataFrame:
    """Attach stored columns to hits.

    The hits are stored first: k rows per query are mostly few, and with their true size known the
    planner broadcasts them and leaves the items where they are; many hits are joined by key.
    """
    return cut_lineage(hits, "hits").join(items, item)


def hit_page_lookup(hits: DataFrame, pages: DataFrame, page_offset: int = 0) -> DataFrame:
    """Source page of a hit, the front-matter shift undone."""
    source = hits.withColumn("source_page", F.col("page_number") + page_offset)
    return source.join(pages, ["doc_id", "source_page"])


def search_report(hits: DataFrame, chunks: DataFrame, digits: int = 4) -> DataFrame:
    """Hits with score, text and page, ready to print."""
    rows = hits_with_text(hits, chunks.withColumnRenamed("chunk_id", "item_id"))
    # scores carry six decimals; a nudge below that sends every half up, whatever prints it
    rows = rows.withColumn("score", F.round(F.col("score") + 1e-9, digits))
    shown = F.format_string("[%.4f] p. %d: %s", "score", "page_number", "sentence_chunk")
    return rows.select("query_id", "rank", "item_id", "score", "page_number", "sentence_chunk", shown.alias("line"))


def random_vectors_like(df: DataFrame, key: str, times: int, dim: int, seed: str = "load") -> DataFrame:
    """``times`` vectors for every row of ``df``, their numbers drawn from a hash of key and place."""
    span = float(2**63)
    rows = df.select(F.col(key).alias("vec_id"), F.explode(F.sequence(F.lit(1), F.lit(times))).alias("copy"))
    draw = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: (F.xxhash64(F.lit(seed), F.col("vec_id"), F.col("copy"), i) / span).cast("float"),
    )
    return rows.withColumn("vec", draw)


# ---- class labels, modalities, expansion ----------------------------------------------------


def zero_shot_label(items: DataFrame, classes: DataFrame) -> DataFrame:
    """Label of the nearest class vector: classes(label, vec)."""
    hits = knn_exact(items.withColumnRenamed("item_id", "query_id"), classes.withColumnRenamed("label", "item_id"), 1, "cosine", move_items=True)
    return hits.select(F.col("query_id").alias("item_id"), F.col("item_id").alias("label"), "score")


def class_vectors(items: DataFrame, label: str) -> DataFrame:
    return V.as_vectors(V.as_arrays(items)).groupBy(F.col(label).alias("label")).agg(V.mean_vector("vec").cast(V.VECTOR).alias("vec"))


def cross_modal_knn(queries: DataFrame, items: DataFrame, modality: Column, k: int = 5) -> DataFrame:
    """Search restricted to items of another modality; the filter reaches the scan."""
    return knn_exact(queries, items.where(modality), k)


def expanded_query_vector(queries: DataFrame, drafts: DataFrame) -> DataFrame:
    """Query vector = mean of its own vector and those of its supplied draft answers."""
    together = queries.select("query_id", "vec").unionByName(drafts.select("query_id", "vec"))
    return V.as_vectors(V.as_arrays(together)).groupBy("query_id").agg(V.mean_vector("vec").cast(V.VECTOR).alias("vec"))


# ---- reranking and cuts ---------------------------------------------------------------------


def rerank(hits: DataFrame, queries: DataFrame, items: DataFrame, k: int = 5, scorer: Callable[[Column, Column], Column] = V.cosine_similarity) -> DataFrame:
    """Reorder candidate hits by a second scorer; only the candidates are read and scored."""
    pairs = (
        cut_lineage(hits.select("query_id", "item_id", F.col("rank").alias("first_rank")), "hits")
        .join(V.as_arrays(items).select("item_id", F.col("vec").alias("d_vec")), "item_id")
        .join(V.as_arrays(queries).select("query_id", F.col("vec").alias("q_vec")), "query_id")
    )
    rescored = pairs.withColumn("score", F.round(scorer(F.col("q_vec"), F.col("d_vec")), DIGITS)).drop("q_vec", "d_vec")
    return ranked(rescored, k)


def multi_store_search(queries: DataFrame, stores: DataFrame, store: str, per_store: int = 3, k: int = 5) -> DataFrame:
    """Best ``per_store`` from every store, then the best ``k`` of those; one pass over the items."""
    firsts = knn_exact(queries, stores, per_store, lane=store)
    return ranked(firsts.withColumnRenamed("rank", "store_rank"), k)


def gap_cut(hits: DataFrame) -> DataFrame:
    """Keep each query's hits down to its largest score drop (the first one when drops tie)."""
    w = Window.partitionBy("query_id").orderBy("rank")
    drop = F.round(F.col("score") - F.lead("score").over(w), DIGITS)
    best = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("drop"), "rank").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    cut = hits.withColumn("drop", drop).withColumn("cut", F.first("rank").over(best))
    return cut.where(F.col("rank") <= F.col("cut")).drop("drop", "cut")


def mixture_cut(hits: DataFrame, rounds: int = 50) -> DataFrame:
    """Keep the hits that a two-part normal mixture over the query's scores puts in its upper part.

    Works on the candidates of one query, which are at most the search's k.
    """
    schema = T.StructType([f for f in hits.schema.fields])

    def solve(pdf):
        x = pdf["score"].to_numpy(dtype=float)
        if len(x) < 3 or np.ptp(x) == 0:
            return pdf
        mean = np.array([x.min(), x.max()])
        var = np.full(2, max(x.var(), 1e-9))
        share = np.full(2, 0.5)
        for _ in range(rounds):
            dens = share * np.exp(-((x[:, None] - mean) ** 2) / (2 * var)) / np.sqrt(2 * np.pi * var)
            resp = dens / np.maximum(dens.sum(axis=1, keepdims=True), 1e-300)
            weight = np.maximum(resp.sum(axis=0), 1e-9)
            mean = (resp * x[:, None]).sum(axis=0) / weight
            var = np.maximum((resp * (x[:, None] - mean) ** 2).sum(axis=0) / weight, 1e-9)
            share = weight / len(x)
        keep = (resp[:, int(np.argmax(mean))] >= 0.5) | (x >= x.max())
        return pdf[keep]

    return hits.groupBy("query_id").applyInPandas(solve, schema)


def dynamic_k(hits: DataFrame, method: str = "mixture") -> DataFrame:
    return gap_cut(hits) if method == "gap" else mixture_cut(hits)
