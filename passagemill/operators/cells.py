"""Trained cells in two levels, and residual product codes inside them.

Centres are fitted by Lloyd rounds: tasks send the sum and number of their rows for each centre, which are added up before and after
the shuffle, and the driver holds the centres alone. Fitting reads a share of the rows that keeps ``PER_CENTRE`` rows
a centre; every row is indexed. A row near a border is filed in its second cell too. Stored by cell, a search reads the
folders that its queries look into, and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemill.functions import vectors as V
from passagemill.operators.search import _ARROW, BLOCK_ROWS, DIGITS, Best, _ids, _in_blocks, _kind, _matrix, knn_in_cells, ranked, rerank
from passagemill.plans.session import cut_lineage
from passagemill.sources.stores import write_vectors_parquet

#: Rows to fit on for every centre of the model, at most.
PER_CENTRE = 256
#: A row goes to a further cell whose centre is at most this much farther (squared distance) than the nearest one's.
BORDER = 0.15
ROUNDS = 8


class Tree(NamedTuple):
    """``top``: (n, dim) centres; ``leaves``: (n, m, dim) centres of the cells below each. Cell ``i * m + j`` is leaf j of centre i."""

    top: np.ndarray
    leaves: np.ndarray

    @property
    def cells(self) -> np.ndarray:
        return self.leaves.reshape(-1, self.leaves.shape[2])


def _far(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, but for the length of ``x``."""
    return (centres * centres).sum(axis=1) - 2 * x @ centres.T


Split = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]


def _lloyd(rows: DataFrame, centres: np.ndarray, split: Split, rounds: int = ROUNDS) -> np.ndarray:
    """Centres (groups, k, width) after ``rounds``; ``split`` gives a batch's vectors and the group of each."""
    k = centres.shape[1]
    for _ in range(rounds):
        now = centres

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros(now.shape[:2], np.int64), np.zeros(now.shape)
            for batch in batches:
                if batch.num_rows:
                    x, group = split(batch)
                    for g in np.unique(group).tolist():
                        mine = x[group == g]
                        near = _far(mine, now[g]).argmin(axis=1)
                        n[g] += np.bincount(near, minlength=k)
                        np.add.at(total[g], near, mine)
            at = np.flatnonzero(n.ravel())
            sums = pa.array(list(total.reshape(-1, total.shape[2])[at]), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.ravel()[at]), sums], names=["centre", "n", "total"])

        parts = rows.mapInArrow(add, "centre long, n long, total array<double>")
        summed = parts.groupBy("centre").agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total"))
        flat = centres.reshape(-1, centres.shape[2]).copy()
        for r in summed.collect():  # one row a centre
            flat[r["centre"]] = np.array(r["total"]) / r["n"]
        if np.allclose(flat, centres.reshape(flat.shape)):
            break
        centres = flat.reshape(centres.shape)
    return centres


def _firsts(rows: DataFrame, k: int, groups: int, group: str) -> np.ndarray:
    """``k`` rows of each group, in the order of a hash of their ids, as first centres; a short group repeats its rows."""
    w = Window.partitionBy(group).orderBy(F.xxhash64("item_id"), "item_id")
    some = rows.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= k).select(group, "_at", "vec").orderBy(group, "_at").collect()
    found: dict[int, list] = {}
    for r in some:
        found.setdefault(r[group], []).append(r["vec"])
    anywhere = some[0]["vec"] if some else [0.0]
    return np.array([[(found.get(g) or [anywhere])[i % len(found.get(g) or [0])] for i in range(k)] for g in range(groups)], np.float64)


def sample_to_fit(items: DataFrame, centres: int, per_centre: int = PER_CENTRE) -> DataFrame:
    """All rows up to ``per_centre`` for each centre, beyond that about as many by a hash of the id. Stored."""
    rows = V.as_arrays(V.as_vectors(items)).select("item_id", "vec")
    share = min(1.0, centres * per_centre / max(1, items.count()))
    some = rows if share >= 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(1_000_000)) < int(1_000_000 * share))
    return cut_lineage(some, "fit")


def fit_tree(items: DataFrame, branch: tuple[int, int] = (8, 8), per_centre: int = PER_CENTRE, rounds: int = ROUNDS) -> Tree:
    """Cells of ``items(item_id, vec)``: ``branch[0]`` centres, and ``branch[1]`` below each of them."""
    n, m = branch
    rows = sample_to_fit(items, n * m, per_centre).withColumn("group", F.lit(0))

    def whole(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return _matrix(batch.column("vec")), np.zeros(batch.num_rows, np.int64)

    def grouped(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return _matrix(batch.column("vec")), batch.column("group").to_numpy()

    top = _lloyd(rows, _firsts(rows, n, 1, "group"), whole, rounds)[0]
    below = cut_lineage(_filed(rows.drop("group"), Tree(top, top[:, None, :]), 1, 0.0, "item_id").withColumnRenamed("cell", "group"), "below")
    return Tree(top, _lloyd(below, _firsts(below, m, n, "group"), grouped, rounds))


def _nearest(x: np.ndarray, tree: Tree, most: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, most) nearest cells below the ``beam`` nearest top centres, nearest first, and their squared distances."""
    m, beam = tree.leaves.shape[1], min(beam, len(tree.top))
    parents = np.argsort(_far(x, tree.top), axis=1, kind="stable")[:, :beam]
    far = np.empty((len(x), beam * m))
    for p in np.unique(parents).tolist():
        at, place = np.nonzero(parents == p)
        far[at[:, None], place[:, None] * m + np.arange(m)] = _far(x[at], tree.leaves[p])
    order = np.argsort(far, axis=1, kind="stable")[:, :most]
    cells = np.take_along_axis(parents, order // m, axis=1) * m + order % m
    return cells, np.take_along_axis(far, order, axis=1) + (x * x).sum(axis=1, keepdims=True)


def _filed(rows: DataFrame, tree: Tree, most: int, border: float | None, key: str, beam: int = 4) -> DataFrame:
    """(key, vec, cell): each row in its nearest cell and in up to ``most - 1`` further ones within the border (all of them without one)."""
    source = V.as_vectors(rows).where(F.col(key).isNotNull()).select(key, "vec")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells, far = _nearest(_matrix(batch.column(1)), tree, most, max(beam, -(-most // tree.leaves.shape[1])))
                near = np.ones(far.shape, bool) if border is None else far <= np.maximum(far[:, :1], 0) * (1 + border) + 1e-12
                near[:, 0] = True
                at, _ = np.nonzero(near)
                picked = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(cells[near].astype(np.int32))], names=[key, "vec", "cell"])

    return source.mapInArrow(place, f"{key} {_kind(source, key)}, vec {_kind(source, 'vec')}, cell int")


def file_items(items: DataFrame, tree: Tree, copies: int = 2, border: float = BORDER) -> DataFrame:
    """(item_id, vec, cell): every item in its cell, border items in up to ``copies`` cells."""
    return _filed(items, tree, copies, border, "item_id")


def probes(queries: DataFrame, tree: Tree, n_probe: int) -> DataFrame:
    """(query_id, vec, cell): each query once for each of the ``n_probe`` cells nearest to it."""
    return _filed(queries, tree, n_probe, None, "query_id", beam=max(4, -(-2 * n_probe // tree.leaves.shape[1])))


def store_index(items: DataFrame, tree: Tree, path: str, copies: int = 2, border: float = BORDER) -> None:
    write_vectors_parquet(file_items(items, tree, copies, border), path, cell="cell")


def _asked(stored: DataFrame, asked: DataFrame) -> DataFrame:
    """The folders of the cells that are asked for: literals, at most as many as the model has cells."""
    return stored.where(F.col("cell").isin([r["cell"] for r in asked.select("cell").distinct().collect()]))


def knn_tree(queries: DataFrame, stored: DataFrame, tree: Tree, k: int = 5, n_probe: int = 8, skip_self: bool = False) -> DataFrame:
    """Best ``k`` by product among the items of each query's nearest cells; ``stored`` is what ``store_index`` wrote."""
    asked = cut_lineage(probes(queries, tree, n_probe), "probes")
    return knn_in_cells(asked, _asked(stored, asked), k, "dot", skip_self)


def read_share(queries: DataFrame, stored: DataFrame, tree: Tree, n_probe: int) -> float:
    """Mean share of the stored rows that a query's cells hold."""
    sizes = stored.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    met = probes(queries, tree, n_probe).join(sizes, "cell").groupBy("query_id").agg(F.sum("n").alias("n"))
    return met.agg(F.avg("n")).first()[0] / stored.count()


# ---- residual codes -------------------------------------------------------------------------


def _residuals(batch: pa.RecordBatch, cells: np.ndarray, parts: int) -> np.ndarray:
    """(rows, parts, width): what is left of each vector after its cell's centre is taken away."""
    x = _matrix(batch.column("vec")) - cells[batch.column("cell").to_numpy()]
    return x.reshape(len(x), parts, -1)


def fit_residual_books(items: DataFrame, tree: Tree, parts: int = 16, centres: int = 16, per_centre: int = PER_CENTRE, rounds: int = ROUNDS) -> np.ndarray:
    """(parts, centres, width): a codebook for each slice of the residuals of all cells. Residuals of a row from its nearest cell."""
    cells = tree.cells
    if cells.shape[1] % parts:
        raise ValueError(f"{cells.shape[1]} dimensions are not cut into {parts} equal parts")
    rows = cut_lineage(_filed(sample_to_fit(items, parts * centres, per_centre), tree, 1, 0.0, "item_id"), "residuals")

    def split(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = _residuals(batch, cells, parts)
        return x.reshape(-1, x.shape[2]), np.tile(np.arange(parts), len(x))

    some = rows.withColumn("group", F.lit(0)).select("item_id", "cell", "vec", "group")
    first = _firsts(some.withColumn("vec", F.concat(F.array(F.col("cell").cast("float")), "vec")), centres, 1, "group")[0]
    left = (first[:, 1:] - cells[first[:, 0].astype(int)]).reshape(centres, parts, -1)
    return _lloyd(rows, left.transpose(1, 0, 2).copy(), split, rounds)


def residual_codes(filed: DataFrame, tree: Tree, books: np.ndarray) -> DataFrame:
    """(item_id, codes, cell): the nearest residual centre of every slice, a byte each."""
    cells, (parts, centres, _) = tree.cells, books.shape
    if centres > 256:
        raise ValueError("a code is one byte")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _residuals(batch, cells, parts)
                near = np.stack([_far(x[:, p], books[p]).argmin(axis=1) for p in range(parts)], axis=1).astype(np.uint8)
                codes = pa.array([row.tobytes() for row in near], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("item_id"), codes, batch.column("cell")], names=["item_id", "codes", "cell"])

    source = filed.select("item_id", "vec", "cell")
    return source.mapInArrow(code, f"item_id {_kind(source, 'item_id')}, codes binary, cell int")


def knn_residual(
    queries: DataFrame,
    coded: DataFrame,
    items: DataFrame,
    tree: Tree,
    books: np.ndarray,
    k: int = 5,
    n_probe: int = 8,
    short: int = 20,
    skip_self: bool = False,
) -> DataFrame:
    """Best ``k`` by product: codes of the nearest cells by look-up tables, then the true vectors of ``k * short`` candidates a query.

    ``coded`` is a stored table of ``residual_codes`` laid out by cell; ``items(item_id, vec)`` hold the vectors.
    """
    asked = cut_lineage(probes(queries, tree, n_probe), "probes")
    found = _asked(coded, asked)
    cells, keep, parts = tree.cells, k * short, len(books)
    kinds = [_ARROW[df.schema[c].dataType.typeName()] for df, c in ((asked, "query_id"), (found, "item_id"))]
    arrow = pa.schema([("query_id", kinds[0]), ("item_id", kinds[1]), ("score", pa.float64())])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([], schema=arrow)
        q_ids, ids, q = _ids(left["query_id"]), _ids(right["item_id"]), _matrix(left["vec"])
        codes = np.frombuffer(b"".join(right["codes"].to_pylist()), np.uint8).reshape(len(ids), parts)
        tables = np.einsum("qpw,pcw->qpc", q.reshape(len(q), parts, -1), books)
        base, best = q @ cells[left["cell"][0].as_py()], Best(keep, len(q))
        step = max(1, 4_000_000 // len(q))
        for at in range(0, len(ids), step):
            scores = base[:, None] + sum(tables[:, p, codes[at : at + step, p]] for p in range(parts))
            may = scores >= best.floor[:, None]
            if skip_self:
                may &= q_ids[:, None] != ids[None, at : at + step]
            of_q, of_i = np.nonzero(may)
            best.add(of_q, scores[of_q, of_i], ids[at : at + step][of_i])
        columns = [pa.array(c).cast(t) for c, t in zip((q_ids[best.q], best.ids, best.score), arrow.types)]
        return pa.Table.from_arrays(columns, schema=arrow)

    schema = f"query_id {_kind(asked, 'query_id')}, item_id {_kind(found, 'item_id')}, score double"
    met = _in_blocks(asked, found.select("item_id", "codes", "cell"), meet, schema, BLOCK_ROWS)
    # a border item is met in both its cells, with codes of its own in each
    one = met.groupBy("query_id", "item_id").agg(F.max("score").alias("score"))
    return rerank(ranked(one, keep), queries, items, k, lambda a, b: F.round(V.dot_product(a, b), DIGITS)).drop("first_rank")
