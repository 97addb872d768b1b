"""Column helpers for vectors and the encoder plug-ins."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTOR = T.ArrayType(T.FloatType())


def dot_product(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot_product(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """NULL when either vector has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot_product(a, b) / lengths)


def l2_normalize(a: Column) -> Column:
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: (x.cast("double") / length).cast("float")))


def project(a: Column, matrix: list[list[float]]) -> Column:
    """Linear map by a fixed matrix, one row per output dimension."""
    rows = [F.array(*[F.lit(float(x)) for x in row]) for row in matrix]
    return F.array(*[dot_product(a, row) for row in rows])


def mean_vector(vec: str | Column, weight: Column | None = None) -> Column:
    """Aggregate: mean of all dimensions in one buffer, combined before the shuffle. Vectors may have any length."""
    v = F.col(vec) if isinstance(vec, str) else vec
    features = array_to_vector(v.cast("array<double>"))
    mean = Summarizer.mean(features) if weight is None else Summarizer.mean(features, weight)
    return vector_to_array(mean)


def pack(a: Column) -> Column:
    """Vector as packed float32 bytes. A stored packed vector is read as one block instead of number
    by number, which is what a scan over many vectors spends its time on."""

    @F.pandas_udf("binary")
    def run(part: pd.Series) -> pd.Series:
        return part.map(lambda x: None if x is None else np.asarray(x, dtype="<f4").tobytes())

    return run(a)


def unpack(a: Column) -> Column:
    @F.pandas_udf(VECTOR)
    def run(part: pd.Series) -> pd.Series:
        return part.map(lambda x: None if x is None else np.frombuffer(x, dtype="<f4"))

    return run(a)


def as_vectors(df: DataFrame, vec: str = "vec") -> DataFrame:
    """Rows that have a vector, as arrays of floats or packed as they are stored."""
    if isinstance(df.schema[vec].dataType, T.BinaryType):
        return df.where(F.col(vec).isNotNull() & (F.octet_length(vec) > 0))
    return df.where(F.col(vec).isNotNull() & (F.size(vec) > 0)).withColumn(vec, F.col(vec).cast(VECTOR))


def as_floats(df: DataFrame, vec: str = "vec") -> DataFrame:
    """As ``as_vectors``, with the rows that have no vector."""
    return df if isinstance(df.schema[vec].dataType, T.BinaryType) else df.withColumn(vec, F.col(vec).cast(VECTOR))


def as_arrays(df: DataFrame, vec: str = "vec") -> DataFrame:
    """``df`` with packed vectors as arrays, for functions that work on numbers one by one."""
    return df.withColumn(vec, unpack(F.col(vec))) if isinstance(df.schema[vec].dataType, T.BinaryType) else df


def to_text(a: Column) -> Column:
    """Bracketed text with blanks between the numbers."""
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), " "), F.lit("]"))


def from_text(text: Column) -> Column:
    inner = F.btrim(text, F.lit("[] \n\t"))
    return F.when(inner == "", F.array().cast(VECTOR)).otherwise(
        F.transform(F.split(inner, r"[ \n]+"), lambda x: x.cast("float"))
    )


# ---- encoders -------------------------------------------------------------------------------

Encoder = Callable[[pd.Series], list[np.ndarray]]

#: Characters whose words are held at once (or one text's), and words whose buckets a worker keeps, in each of two generations.
HELD_CHARS, KEPT_WORDS = 1 << 18, 50_000


class _Buckets(dict):
    """Bucket of each word, hashed when it is first asked for. Two generations of ``KEPT_WORDS`` are held, so that frequent words stay."""

    def __init__(self, dim: int):
        self.dim, self.older = dim, {}

    def __missing__(self, t: str) -> int:
        at = self.older.get(t)
        if at is None:
            at = int.from_bytes(hashlib.md5(t.encode()).digest()[:4], "big") % self.dim
        self[t] = at
        return at

    def age(self) -> None:
        if len(self) > KEPT_WORDS:
            self.older = dict(self)
            self.clear()


def hashing_encoder(dim: int = 64) -> Callable[[], Encoder]:
    """Default encoder: word counts by md5 bucket, 1 + ln(count), scaled to unit length.

    Counts of all texts are one matrix; a word is hashed when it is not among those that came lately.
    """

    def load() -> Encoder:
        word = re.compile(r"[^\W_]+")
        buckets = _Buckets(dim)

        def encode(texts: pd.Series) -> list[np.ndarray]:
            out, part, held = [], [], 0
            for t in texts:
                if part and held + len(t or "") > HELD_CHARS:
                    out += counted(part)
                    part, held = [], 0
                part.append(t)
                held += len(t or "")
            return out + counted(part) if part else out

        def counted(texts: list) -> list[np.ndarray]:
            found = [word.findall(t.lower()) if t else [] for t in texts]
            size = [len(ws) for ws in found]
            at = np.fromiter(map(buckets.__getitem__, chain.from_iterable(found)), np.int64, sum(size))
            buckets.age()
            owner = np.repeat(np.arange(len(found)), size)
            counts = np.bincount(owner * dim + at, minlength=len(found) * dim).reshape(len(found), dim)
            weights = np.where(counts > 0, 1.0 + np.log(np.maximum(counts, 1)), 0.0)
            length = np.sqrt((weights * weights).sum(axis=1, keepdims=True))
            return list((weights / np.where(length > 0, length, 1)).astype(np.float32))

        return encode

    return load


def embed(text: Column, load: Callable[[], Encoder] | None = None, batch: int = 256) -> Column:
    """Vector column from an encoder. ``load`` runs once per Python worker, then texts go in batches."""
    load = load or hashing_encoder()

    @F.pandas_udf(VECTOR)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for part in parts:
            vectors: list = []
            for start in range(0, len(part), batch):
                vectors.extend(encode(part.iloc[start : start + batch]))
            yield pd.Series(vectors, dtype=object)

    return run(text)


def embed_text(
    df: DataFrame, text: str, out: str = "vec", load: Callable[[], Encoder] | None = None, batch: int = 256
) -> DataFrame:
    return df.withColumn(out, embed(F.col(text), load, batch))
