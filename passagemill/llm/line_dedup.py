"""Line dedup over all documents: sorted line hashes in, compressed keep bitmaps out.

The key of a line is the line without ``[\\x20\\x09-\\x0D]`` at its ends, A-Z lower-cased. A key of at least
``min_chars`` code points that is in at least ``min_docs`` documents keeps its lines in the largest ``doc_id`` holding
it and loses all others. Everything else stays.

Hashes (128 bits), ids and positions are range-partitioned and sorted by hash, then by document from the largest down
and by position; no text is shuffled for that. The ranges include the document, so a line that a third of all
documents share is spread over as many tasks as it needs. A task streams its groups: the first document of a
group keeps its lines. Only the first and last group of a range can be cut by its ends; their rows are settled
together afterwards (at most two keys a range, which is what makes their broadcast bounded).

Defined results: a null or empty text is one empty line; null ids count as one document, lower than all others; rows
with the same id are one document for the counting, each with its own bitmap; an empty table gives no rows. A very long text
is a slice alone. Columns of any name are passed on: those that a join adds take names that are free.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import NO_ID, column, id_or_lowest, slices, texts, unused
from passagemill.plans.session import cut_lineage

MIN_CHARS = 20
MIN_DOCS = 3

_ROW = ["hi", "lo", "doc", "text_key", "pos", "n_lines"]


def _line_rows(min_chars: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, whole = xxhash.xxh3_128_digest, xxhash.xxh64_intdigest
        for batch in slices(batches, "text"):
            found, hashes = [], []
            for doc, text in zip(column(batch, "doc").to_pylist(), texts(batch).to_pylist()):
                raw = text.encode()
                if len(raw) < min_chars:
                    continue
                lines = raw.split(b"\n")
                n, text_key = len(lines), None
                for pos, line in enumerate(lines):
                    # strip and lower of bytes are the ASCII ones of the definition
                    line = line.strip()
                    if len(line) >= min_chars and (line.isascii() or len(line.decode()) >= min_chars):
                        if text_key is None:
                            text_key = whole(raw, 42)
                            text_key -= (text_key >> 63) << 64
                        hashes.append(digest(line.lower()))
                        found.append((doc, text_key, pos, n))
            if found:
                key = np.frombuffer(b"".join(hashes), ">i8").reshape(-1, 2).astype(np.int64)
                rest = np.array(found, np.int64)
                yield _batch(np.hstack((key, rest)), _ROW)

    return rows


def _batch(rows: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(len(names))], names)


def _settle(rows: np.ndarray, min_docs: int) -> np.ndarray:
    """Rows to drop, out of whole groups sorted by key and by document downwards."""
    new_key = np.ones(len(rows), bool)
    new_key[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    new_doc = new_key.copy()
    new_doc[1:] |= rows[1:, 2] != rows[:-1, 2]
    starts = np.flatnonzero(new_key)
    group = np.cumsum(new_key) - 1
    docs = np.add.reduceat(new_doc.astype(np.int64), starts)
    return rows[(docs[group] >= min_docs) & (rows[:, 2] != rows[starts[group], 2])]


def _stream(min_docs: int):
    """Sorted rows of one range: rows to drop (state 0), and all rows of the groups that its ends may cut (state 1)."""

    def out(rows: np.ndarray, state: int) -> pa.RecordBatch:
        if not state:
            rows = np.hstack((np.zeros((len(rows), 2), np.int64), rows[:, 2:]))
        return _batch(np.hstack((rows, np.full((len(rows), 1), state))), [*_ROW, "state"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the open group; a range, and so this list, has a bounded size
        at_start = True
        for batch in batches:
            rows = np.stack([column(batch, name).to_numpy() for name in _ROW], axis=1)
            if not len(rows):
                continue
            cuts = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            head = 0
            if held and (held[-1][-1, :2] == rows[0, :2]).all():
                if not len(cuts):
                    held.append(rows)
                    continue
                head = int(cuts[0])
                held.append(rows[:head])
            if held:
                group = np.concatenate(held)
                yield out(group, 1) if at_start else out(_settle(group, min_docs), 0)
                at_start, held = False, []
            last = int(cuts[-1]) if len(cuts) else 0
            if at_start and head < last:
                first = int(cuts[0])
                yield out(rows[:first], 1)
                at_start, head = False, first
            if head < last:
                yield out(_settle(rows[head:last], min_docs), 0)
            held = [rows[max(head, last) :]]
        if held:
            yield out(np.concatenate(held), 1)

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for n, dropped in zip(column(batch, "n_lines").to_pylist(), column(batch, "dropped").to_pylist()):
            keep = np.ones(n, bool)
            keep[dropped] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [column(batch, "doc"), column(batch, "text_key"), column(batch, "n_lines"), column(batch, "n_dropped"), pa.array(maps, pa.binary())],
            ["doc", "text_key", "n_lines", "n_dropped", "keep_bits"],
        )


def kept_lines(bits: bytes, n_lines: int) -> np.ndarray:
    """The places of the lines that a keep bitmap leaves."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=n_lines))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, text_key, n_lines, n_dropped, keep_bits) for every document that loses a line.

    ``doc`` is the id (the lowest 64-bit number for a null one), ``text_key`` the 64-bit hash of the text,
    ``keep_bits`` a deflated row of bits, one a line, set where the line stays. Documents not listed keep everything.
    """
    number = "long"
    lines = docs.select(id_or_lowest("doc_id").alias("doc"), F.col("text")).mapInArrow(
        _line_rows(min_chars), ", ".join(f"{c} {number}" for c in _ROW)
    )
    order = ["hi", "lo", F.desc("doc"), "text_key", "pos"]
    ranges = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    found = cut_lineage(ranges.mapInArrow(_stream(min_docs), ", ".join(f"{c} {number}" for c in [*_ROW, "state"])), "lines")
    cut = found.where("state = 1")
    edges = cut.groupBy("hi", "lo").agg(F.max("doc").alias("top"), F.countDistinct("doc").alias("docs")).where(F.col("docs") >= min_docs)
    settled = cut.join(F.broadcast(edges.drop("docs")), ["hi", "lo"]).where("doc < top")
    dropped = found.where("state = 0").select(*_ROW[2:]).unionByName(settled.select(*_ROW[2:])).distinct()
    by_text = dropped.groupBy("doc", "text_key", "n_lines").agg(
        F.count(F.lit(1)).alias("n_dropped"), F.collect_list("pos").alias("dropped")
    )
    return by_text.mapInArrow(_pack, "doc long, text_key long, n_lines long, n_dropped long, keep_bits binary")


def _with_bitmaps(docs: DataFrame, min_chars: int, min_docs: int) -> tuple[DataFrame, str]:
    """``docs`` and their bitmaps, in a column whose name comes second."""
    doc, text, bits = unused(docs, "_map_doc", "_map_text", "_keep_bits")
    maps = keep_bitmaps(docs, min_chars, min_docs).select(F.col("doc").alias(doc), F.col("text_key").alias(text), F.col("keep_bits").alias(bits))
    on = (id_or_lowest("doc_id") == F.col(doc)) & (F.xxhash64("text") == F.col(text))
    return docs.join(maps, on, "left").drop(doc, text), bits


def _applied(text: str, bits: bytes | None) -> tuple[bytes, int, int]:
    raw = text.encode()
    n = raw.count(b"\n") + 1
    if bits is None:
        return raw, n, 0
    lines = raw.split(b"\n")
    kept = kept_lines(bits, n)
    return b"\n".join([lines[i] for i in kept]), n, n - len(kept)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        done = [_applied(t, b) for t, b in zip(texts(batch).to_pylist(), column(batch, "_keep_bits").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [
                column(batch, "doc_id"),
                pa.array([n for _, n, _ in done], pa.int64()),
                pa.array([n for _, _, n in done], pa.int64()),
                pa.array([hashlib.sha256(raw).hexdigest() for raw, _, _ in done], pa.string()),
            ],
            ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        )


def line_digests(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256), a row for every row of ``docs``."""
    joined, _ = _with_bitmaps(docs.select(F.col("doc_id").cast("long"), "text"), min_chars, min_docs)
    return joined.mapInArrow(_digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the lines gone from ``text``. A text that loses nothing, a null one too, is passed on as it is."""
    names = docs.columns
    joined, kept = _with_bitmaps(docs, min_chars, min_docs)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            bits = column(batch, kept).to_pylist()
            text = [t if b is None else _applied(t, b)[0].decode() for t, b in zip(column(batch, "text").to_pylist(), bits)]
            parts = [pa.array(text, pa.string()) if c == "text" else column(batch, c) for c in names]
            yield pa.RecordBatch.from_arrays(parts, names)

    return joined.mapInArrow(apply, docs.schema)


__all__ = ["MIN_CHARS", "MIN_DOCS", "NO_ID", "drop_lines", "keep_bitmaps", "kept_lines", "line_digests"]
