"""Items made of many vectors: late interaction, batched encoding and late chunking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.functions import vectors as V
from passagemill.operators import cells
from passagemill.operators.search import _ARROW, DIGITS, Best, _ids, _matrix, ranked
from passagemill.plans.session import cut_lineage
from passagemill.plans.skew import salted_join

#: Vectors to a row while items are moved and packed.
RUN = 256
#: Vectors of queries and of items that meet in one task.
BLOCK_VECTORS = (32768, 65536)
#: As few vectors of queries are a block where there are more cores than blocks.
FEW_VECTORS = 2048
#: Vectors of queries and of items whose products are held at once, or one item's.
TILE_VECTORS = (512, 1024)


def batch_encode(df: DataFrame, key: str, text: str, load: Callable | None = None, batch: int = 32) -> DataFrame:
    """(key, vec) for every row. Rows keep their key, so batch order does not matter."""
    return V.embed_text(df.select(key, text), text, "vec", load, batch).select(key, "vec")


def packed(tokens: DataFrame, key: str) -> DataFrame:
    """(key, run, flat, n): runs of at most RUN vectors in the order of ``pos``. Rows without a vector are left out."""
    full = V.as_vectors(V.as_arrays(tokens)).where(F.col(key).isNotNull())
    rows = full.select(key, F.floor(F.col("pos") / RUN).alias("run"), F.struct("pos", "vec").alias("x"))
    runs = rows.groupBy(key, "run").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return runs.select(key, "run", F.flatten(F.col("x.vec")).alias("flat"), F.size("x").alias("n"))


def _vectors(side: pa.Table, key: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in order, where the vectors of each begin, and the vectors. All must have the same length."""
    ids, n = _ids(side[key]), _ids(side["n"])
    flat = side["flat"].combine_chunks()
    sizes = np.diff(flat.offsets.to_numpy())
    width = sizes[0] // n[0]
    if (sizes != n * width).any():
        raise ValueError("vectors of different lengths")
    matrix = flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)
    order = np.argsort(ids, kind="stable")
    rows = np.concatenate([np.arange(s, s + m) for s, m in zip((np.cumsum(n) - n)[order], n[order])])
    names, first = np.unique(ids[order], return_index=True)
    return names, (np.cumsum(n[order]) - n[order])[first], matrix[rows]


def _sums(queries: np.ndarray, q_at: np.ndarray, items: np.ndarray, d_at: np.ndarray) -> np.ndarray:
    """(queries, items): the best of the item's vectors for each of the query's, summed."""
    if queries.shape[1] != items.shape[1]:
        raise ValueError(f"queries have {queries.shape[1]} dimensions, items {items.shape[1]}")
    return np.round(np.add.reduceat(np.maximum.reduceat(queries @ items.T, d_at, axis=1), q_at, axis=0), DIGITS)


def _hit_schema(q_type: T.DataType, d_type: T.DataType) -> tuple[T.StructType, pa.Schema]:
    fields = (("query_id", q_type), ("item_id", d_type), ("score", T.DoubleType()))
    return T.StructType([T.StructField(n, t) for n, t in fields]), pa.schema([(n, _ARROW[t.typeName()]) for n, t in fields])


def _tiles(first: np.ndarray, n: int, most: int) -> Iterator[slice]:
    """Runs of items with at most ``most`` of the ``n`` vectors, or one item; ``first`` are the places of their first vectors."""
    ends, start = np.append(first, n), 0
    while start < len(first):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, side="right")) - 1)
        yield slice(start, stop)
        start = stop


def shape_of(asked: int, items: int, cores: int) -> tuple[int, int]:
    """Blocks of query vectors and of item vectors: what is moved is each vector once for every block of the other side."""
    d = max(1, -(-items // BLOCK_VECTORS[1]))
    return max(1, -(-asked // BLOCK_VECTORS[0]), min(2 * cores // d, -(-asked // FEW_VECTORS))), d


def maxsim(queries: DataFrame, items: DataFrame, k: int | None = 5, block_runs: int | None = None) -> DataFrame:
    """Late interaction: for each query vector the best of the item's vectors, summed.

    ``queries(query_id, pos, vec)`` and ``items(item_id, pos, vec)``. Blocks are dealt by a hash of the id, so an item of
    any number of vectors is whole in its block, and only each block's best ``k`` leave it. ``block_runs`` sets the size of a block in runs.
    """
    q, d = cut_lineage(packed(queries, "query_id"), "queries"), cut_lineage(packed(items, "item_id"), "items")
    schema, arrow = _hit_schema(q.schema["query_id"].dataType, d.schema["item_id"].dataType)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        q_ids, q_at, q_rows = _vectors(left, "query_id")
        d_ids, d_at, d_rows = _vectors(right, "item_id")
        best = Best(k or len(d_ids), len(q_ids))
        for items in _tiles(d_at, len(d_rows), TILE_VECTORS[1]):
            of_items = slice(d_at[items.start], d_at[items.stop] if items.stop < len(d_at) else None)
            for some in _tiles(q_at, len(q_rows), TILE_VECTORS[0]):
                of_some = slice(q_at[some.start], q_at[some.stop] if some.stop < len(q_at) else None)
                scores = _sums(q_rows[of_some], q_at[some] - of_some.start, d_rows[of_items], d_at[items] - of_items.start)
                least = best.floor[some, None]
                if k and k < scores.shape[1] and not np.isnan(scores).any():
                    least = np.maximum(least, -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k])
                at, item = np.nonzero(~(scores < least))
                best.add(some.start + at, scores[at, item], d_ids[items][item])
        best.merge()
        found = (q_ids[best.q], best.ids, best.score)
        return pa.table([pa.array(x).cast(t) for x, t in zip(found, arrow.types)], schema=arrow)

    (asked, q_runs), (held, d_runs) = (df.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first() for df in (q, d))
    q_blocks, d_blocks = shape_of(asked, held, q.sparkSession.sparkContext.defaultParallelism)
    if block_runs:
        q_blocks, d_blocks = (max(1, -(-n // block_runs)) for n in (q_runs, d_runs))

    def dealt(df: DataFrame, key: str, own: str, blocks: int, other: str, others: int) -> DataFrame:
        placed = df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    left = dealt(q, "query_id", "q_block", q_blocks, "d_block", d_blocks).groupBy("q_block", "d_block")
    right = dealt(d, "item_id", "d_block", d_blocks, "q_block", q_blocks).groupBy("q_block", "d_block")
    return ranked(left.cogroup(right).applyInArrow(meet, schema), k)


def maxsim_rerank(hits: DataFrame, queries: DataFrame, items: DataFrame, k: int = 5) -> DataFrame:
    """The hits of a first stage, such as a search over cells or codes, in the order of their late-interaction score.

    Only the vectors of the hits' items are read and scored.
    """
    pairs = cut_lineage(hits.select("query_id", "item_id").distinct(), "hits")
    q = packed(queries, "query_id").select("query_id", F.col("flat").alias("q_flat"), F.col("n").alias("q_n"), F.col("run").alias("q_run"))
    d = packed(items, "item_id").select("item_id", "flat", "n", "run")
    schema, arrow = _hit_schema(q.schema["query_id"].dataType, d.schema["item_id"].dataType)

    def score(group: pa.Table) -> pa.Table:
        # every run of the query stands beside every run of the item
        one = {c: group[c].to_numpy() for c in ("q_run", "run")}
        left = group.filter(pa.array(one["run"] == one["run"].min())).select(["query_id", "q_flat", "q_n"]).rename_columns(["query_id", "flat", "n"])
        right = group.filter(pa.array(one["q_run"] == one["q_run"].min())).select(["item_id", "flat", "n"])
        q_ids, q_at, q_rows = _vectors(left, "query_id")
        d_ids, d_at, d_rows = _vectors(right, "item_id")
        found = (q_ids, d_ids, _sums(q_rows, q_at, d_rows, d_at).ravel())
        return pa.table([pa.array(x).cast(t) for x, t in zip(found, arrow.types)], schema=arrow)

    together = pairs.join(d, "item_id").join(q, "query_id").groupBy("query_id", "item_id")
    return ranked(together.applyInArrow(score, schema), k)


# ---- late interaction over an index ---------------------------------------------------------


def store_centroids(items: DataFrame, tree: cells.Tree, path: str) -> None:
    """(item_id, cell): which cells of ``tree`` an item's vectors lie in, each once, laid out by cell. No vector is stored."""
    cells.file_items(items.select("item_id", "vec"), tree, 1).select("item_id", "cell").distinct().hint("rebalance", "cell").write.partitionBy("cell").parquet(path)


def _interacting(queries: DataFrame, tree: cells.Tree, n_probe: int) -> DataFrame:
    """(query_id, pos, cell, gain): each query vector's ``n_probe`` nearest cells; ``gain`` is the product with the
    centre, above that of the last of them."""
    source = V.as_vectors(V.as_arrays(queries)).where("query_id IS NOT NULL").select("query_id", F.col("pos").cast("long").alias("pos"), "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(2))
                near, _ = cells._nearest(x, tree, n_probe, len(tree.top))
                product = np.einsum("qd,qpd->qp", x, tree.cells[near])
                at = pa.array(np.repeat(np.arange(len(x)), near.shape[1]))
                gain = product - product.min(axis=1, keepdims=True)
                columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(near.ravel().astype(np.int32)), pa.array(gain.ravel())]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "pos", "cell", "gain"])

    return source.mapInArrow(run, f"query_id {source.schema['query_id'].dataType.simpleString()}, pos long, cell int, gain double")


def maxsim_candidates(queries: DataFrame, index: DataFrame, tree: cells.Tree, keep: int, n_probe: int = 16) -> DataFrame:
    """(query_id, item_id, score, rank): the ``keep`` best items by centres alone: for each query vector the best centre among the item's cells.

    ``index`` is what ``store_centroids`` wrote; ids and cells are all that is read, and only of the cells asked for.
    """
    asked = cut_lineage(_interacting(queries, tree, n_probe), "interacting")
    found = index.where(F.col("cell").isin([r["cell"] for r in asked.select("cell").distinct().collect()]))  # at most the model's cells
    met = salted_join(found.select("cell", "item_id"), asked, "cell").groupBy("query_id", "item_id", "pos").agg(F.max("gain").alias("gain"))
    return ranked(met.groupBy("query_id", "item_id").agg(F.round(F.sum("gain"), DIGITS).alias("score")), keep)


def maxsim_search(queries: DataFrame, items: DataFrame, index: DataFrame, tree: cells.Tree, k: int = 5, n_probe: int = 16, short: int = 12) -> DataFrame:
    """Late interaction without a scan: ``k * short`` candidates a query by centres, scored by their own vectors."""
    return maxsim_rerank(maxsim_candidates(queries, index, tree, k * short, n_probe), queries, items, k)


# ---- late chunking --------------------------------------------------------------------------


def late_chunk_pool(tokens: DataFrame, spans: DataFrame, block: int = 256) -> DataFrame:
    """Chunk vector = mean of the token vectors in its span.

    ``tokens(doc_id, pos, vec)``, ``spans(doc_id, span_no, start, stop)`` with ``stop`` exclusive.
    Spans are listed under the position blocks they touch, so the join key is (document, block) and
    a very long document is spread over many keys.
    """
    at = spans.where("stop > start").withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block)))
    )
    placed = V.as_vectors(V.as_arrays(tokens)).select("doc_id", "pos", "vec", F.floor(F.col("pos") / block).alias("block"))
    inside = placed.join(at, ["doc_id", "block"]).where("pos >= start AND pos < stop")
    return inside.groupBy("doc_id", "span_no").agg(V.mean_vector("vec").cast(V.VECTOR).alias("vec"))


def macro_segments(length: Column, size: int, stride: int) -> Column:
    """Starts of overlapping segments that together cover ``length`` tokens."""
    return F.sequence(F.lit(0), F.greatest(F.lit(0), length - 1 - (size - stride)), F.lit(stride))


def late_chunk_long(segment_tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """As above for texts encoded in overlapping segments: a token's vectors are averaged first.

    ``segment_tokens(doc_id, segment, pos, vec)`` with ``pos`` counted over the whole document.
    """
    full = V.as_vectors(V.as_arrays(segment_tokens))
    merged = full.groupBy("doc_id", "pos").agg(V.mean_vector("vec").cast(V.VECTOR).alias("vec"))
    return late_chunk_pool(merged, spans)
