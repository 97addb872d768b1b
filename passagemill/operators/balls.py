"""Exact threshold join of vectors by angle: balls about pivots, pruned by the triangle inequality.

Every vector belongs to the ball of its nearest pivot. Angles obey the triangle inequality, so a vector can have a partner within the
asked angle in another ball only if its angle to that ball's pivot is at most the asked angle and the ball's radius
together; it is scored against those balls and no others. Of two balls only the vectors of the earlier one look into the later one, so that no
pair is scored twice. Neighbouring balls are stored together in groups of about ``block_rows`` vectors, and what moves is groups: two meet in
a row of a join if a vector of the earlier one looks into a ball of the later one, however many vectors do. Vectors that resemble nothing look into few balls;
where all angles are alike, as between random directions, nothing can be left out and every pair is scored once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.functions import vectors as V
from passagemill.operators.search import _ARROW, BLOCK_ROWS, DIGITS, _ids, _kind, _matrix, _scale
from passagemill.plans.session import cut_lineage

#: Most pivots; their vectors are sent to every task.
MAX_PIVOTS = 2048
#: What rounding of 32-bit numbers may change in an angle, and half a unit of the last digit of a score.
_SLACK = 1e-3
#: Vectors whose angles to all pivots are held at once, and scores held at once.
_ANGLE_ROWS, _SCORES = 1024, 1 << 20
#: Groups of fewer vectors are not worth a task of their own.
_FEW_ROWS = 256


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))


def _unit(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return _scale(_matrix(batch.column("vec")), "cosine")


def _with_length(items: DataFrame) -> DataFrame:
    rows = V.as_vectors(V.as_arrays(items)).where("item_id IS NOT NULL").select("item_id", "vec")
    return rows.where(F.exists("vec", lambda x: x != 0))


def pivots_of(rows: DataFrame, n: int | None = None) -> np.ndarray:
    """About the root of the number of rows, taken by a hash of their vectors; unit length."""
    n = n or min(MAX_PIVOTS, math.isqrt(max(1, rows.count())) + 1)
    taken = rows.select("vec").orderBy(F.xxhash64("vec"), F.xxhash64("item_id")).limit(n).collect()
    return _scale(np.array([r["vec"] for r in taken], np.float64), "cosine") if taken else np.zeros((0, 0))


def _members(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(item_id, vec, ball, far) stored; ``far`` is the angle to the ball's pivot."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ANGLE_ROWS):
                part = batch.slice(at, _ANGLE_ROWS)
                far = _angles(_unit(part), pivots)
                near = far.argmin(axis=1)
                columns = [*part.columns, pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(near)), near])]
                yield pa.RecordBatch.from_arrays(columns, names=["item_id", "vec", "ball", "far"])

    return cut_lineage(rows.mapInArrow(place, f"item_id {_kind(rows, 'item_id')}, vec array<float>, ball int, far double"), "balls")


def _shape(members: DataFrame, n: int, low: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each of ``n`` balls the number of vectors, and the angle up to which others look into it: at most ``MAX_PIVOTS`` rows are read."""
    size, reach = np.zeros(n, np.int64), np.full(n, -np.inf)  # nobody looks into balls without members
    for r in members.groupBy("ball").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).collect():
        size[r["ball"]] = r["n"]
        reach[r["ball"]] = r["radius"] + math.acos(max(-1.0, min(1.0, low))) + _SLACK
    return size, reach


def _packed(members: DataFrame, pivots: np.ndarray, size: np.ndarray, reach: np.ndarray, rows: int) -> DataFrame:
    """(group, ids, balls, vecs, to) stored: vectors of neighbouring balls by ball, and the groups that some of them look into, their own
    first. A ball begins in the group in which the one before it ends, and a large one goes on through many."""
    start = np.cumsum(size) - size
    first, last = start // rows, np.maximum(start + size - 1, start) // rows
    held = members.sparkSession.createDataFrame([(i, int(start[i]), int(size[i])) for i in np.flatnonzero(size).tolist()], "ball int, start long, n long")
    place = F.col("start") + F.pmod(F.xxhash64("item_id", "vec"), F.col("n"))
    grouped = members.join(F.broadcast(held), "ball").select(F.floor(place / rows).cast("int").alias("group"), "item_id", "ball", "vec")

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("ball").combine_chunks()
        x, home, mine = _unit(group), group["ball"].to_numpy(), group["group"][0].as_py()
        seen = np.zeros(len(pivots), bool)
        for at in range(0, len(x), _ANGLE_ROWS):
            part = slice(at, at + _ANGLE_ROWS)
            seen |= ((_angles(x[part], pivots) <= reach) & (np.arange(len(pivots)) >= home[part, None])).any(axis=0)
        to = {mine}.union(*(range(max(mine, int(first[b])), int(last[b]) + 1) for b in np.flatnonzero(seen)))
        ends = pa.array([0, len(x)], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, group[c].combine_chunks()) for c in ("item_id", "ball")]
        raw = _matrix(group["vec"]).astype("<f4").tobytes()
        columns = [pa.array([mine], pa.int32()), *lists, pa.array([raw], pa.binary()), pa.array([sorted(to)], pa.list_(pa.int32()))]
        return pa.Table.from_arrays(columns, names=["group", "ids", "balls", "vecs", "to"])

    schema = f"group int, ids array<{_kind(members, 'item_id')}>, balls array<int>, vecs binary, to array<int>"
    return cut_lineage(grouped.groupBy("group").applyInArrow(pack, schema), "groups")


def pairs_by_angle(items: DataFrame, low: float, block_rows: int = BLOCK_ROWS, n_pivots: int | None = None) -> DataFrame:
    """(query_id, item_id, score): every pair with a cosine of ``low`` or more once, the lower id first.

    Ids must differ. Rows without an id or with a vector of no length have no pairs. A task holds two groups and about a million scores.
    """
    rows = _with_length(items)
    kind = _ARROW[rows.schema["item_id"].dataType.typeName()]
    arrow = pa.schema([("query_id", kind), ("item_id", kind), ("score", pa.float64())])
    schema = f"query_id {_kind(rows, 'item_id')}, item_id {_kind(rows, 'item_id')}, score double"
    pivots = pivots_of(rows, n_pivots)
    if not len(pivots):
        return rows.select(F.col("item_id").alias("query_id"), "item_id", F.lit(0.0).alias("score"))
    members = _members(rows, pivots)
    size, reach = _shape(members, len(pivots), low)
    # smaller groups where there would be fewer meetings than cores
    least = math.isqrt(8 * rows.sparkSession.sparkContext.defaultParallelism) + 1
    packed = _packed(members, pivots, size, reach, min(block_rows, max(_FEW_ROWS, -(-int(size.sum()) // least))))

    def side(row: dict, prefix: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = _ids(row[f"{prefix}ids"].values)
        x = np.frombuffer(row[f"{prefix}vecs"].as_buffer(), "<f4").reshape(len(ids), -1)
        return ids, row[f"{prefix}balls"].values.to_numpy(), _scale(x.astype(np.float64), "cosine")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i] for j, name in enumerate(batch.schema.names)}
                same = row["group"].as_py() == row["other"].as_py()
                a, home, x = side(row, "")
                b, theirs, y = (a, home, x) if same else side(row, "m_")
                for ball in np.unique(theirs):
                    here = slice(*np.searchsorted(theirs, [ball, ball + 1]))
                    early = np.searchsorted(home, ball + 1)
                    close = np.zeros(early, bool)
                    for at in range(0, early, _ANGLE_ROWS):
                        part = slice(at, min(early, at + _ANGLE_ROWS))
                        close[part] = _angles(x[part], pivots[ball : ball + 1])[:, 0] <= reach[ball]
                    yield from found(a, x, np.flatnonzero(close), home == ball if same else None, b[here], y[here])

    def found(a: np.ndarray, x: np.ndarray, near: np.ndarray, own: np.ndarray | None, b: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        for low_b in range(0, len(b), BLOCK_ROWS):
            ids, step = b[low_b : low_b + BLOCK_ROWS], max(1, _SCORES // min(len(b), BLOCK_ROWS))
            for at in range(0, len(near), step):
                taken = near[at : at + step]
                scores = x[taken] @ y[low_b : low_b + BLOCK_ROWS].T
                i, j = np.nonzero(scores >= low - 10.0**-DIGITS)
                score, one, two = np.round(scores[i, j], DIGITS) + 0.0, a[taken[i]], ids[j]
                keep = score >= low
                if own is not None:
                    keep &= ~own[taken[i]] | (one < two)
                if keep.any():
                    one, two = one[keep], two[keep]
                    pairs = (np.where(one < two, one, two), np.where(one < two, two, one), score[keep])
                    yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(pairs, arrow.types)], schema=arrow)

    met = cut_lineage(packed.select("group", F.explode("to").alias("other")), "meetings")
    left = met.join(packed.select("group", "ids", "balls", "vecs"), "group")
    right = met.join(packed.select(F.col("group").alias("other"), *(F.col(c).alias(f"m_{c}") for c in ("ids", "balls", "vecs"))), "other")
    return left.join(right.hint("merge"), ["group", "other"]).mapInArrow(meet, schema)


def share_scored(items: DataFrame, low: float, block_rows: int = BLOCK_ROWS, n_pivots: int | None = None) -> float:
    """Scored pairs over all pairs of different items; the size of groups (``block_rows``) does not change it."""
    rows = _with_length(items)
    pivots = pivots_of(rows, n_pivots)
    members = _members(rows, pivots)
    size, reach = _shape(members, len(pivots), low)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ANGLE_ROWS):
                part = batch.slice(at, _ANGLE_ROWS)
                home = part.column("ball").to_numpy()
                later = (_angles(_unit(part), pivots) <= reach) & (np.arange(len(pivots)) > home[:, None])
                yield pa.RecordBatch.from_arrays([pa.array([float((later @ size).sum() + size[home].sum() / 2)])], names=["n"])

    n = rows.count()
    return (members.mapInArrow(count, "n double").agg(F.sum("n")).first()[0] or 0.0) / max(1.0, n * (n - 1) / 2)
