"""Pages to sentences to chunks. Everything here is a projection or a generate: no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.functions import text as X


def page_stats(pages: DataFrame) -> DataFrame:
    t = F.col("text")
    return pages.select(
        "*",
        X.char_count(t).alias("page_char_count"),
        X.word_count(t).alias("page_word_count"),
        X.raw_sentence_count(t).alias("page_sentence_count_raw"),
        X.token_count(t).alias("page_token_count"),
    )


def split_sentences(pages: DataFrame) -> DataFrame:
    return pages.withColumn("sentences", X.sentences(F.col("text"))).withColumn(
        "page_sentence_count", F.size("sentences")
    )


def split_paragraphs(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("paragraphs", X.paragraphs(F.col(text)))


def group_sentences(pages: DataFrame, size: int = 10) -> DataFrame:
    return pages.withColumn("sentence_chunks", X.grouped(F.col("sentences"), size)).withColumn(
        "num_chunks", F.size("sentence_chunks")
    )


def chunk_stats(df: DataFrame) -> DataFrame:
    t = F.col("sentence_chunk")
    return df.select(
        "*",
        X.char_count(t).alias("chunk_char_count"),
        X.word_count(t).alias("chunk_word_count"),
        X.token_count(t).alias("chunk_token_count"),
    )


def make_chunks(pages: DataFrame, size: int = 10, joiner: str = "") -> DataFrame:
    """One row per group of ``size`` sentences; a chunk never crosses a page."""
    keys = [c for c in pages.columns if c not in ("text", "sentences", "sentence_chunks", "num_chunks", "page_sentence_count")]
    if "sentences" not in pages.columns:
        pages = split_sentences(pages)
    groups = X.grouped(F.col("sentences"), size)
    rows = pages.select(*keys, F.posexplode(groups).alias("chunk_no", "sentence_group"))
    rows = rows.select(*keys, "chunk_no", X.joined_chunk(F.col("sentence_group"), joiner).alias("sentence_chunk"))
    rows = rows.withColumn("chunk_id", F.concat_ws("-", "doc_id", "page_number", "chunk_no"))
    return chunk_stats(rows)


def window_chunks(df: DataFrame, keys: list[str], text: str = "text", size: int = 100, stride: int = 50) -> DataFrame:
    """Overlapping windows of words. Every window adds at least one word the one before lacks."""
    words = F.col("words")
    last = F.greatest(F.lit(1), F.size(words) - (size - stride))
    starts = F.sequence(F.lit(1), last, F.lit(stride))
    texts = F.transform(starts, lambda i: F.array_join(X.piece(words, i, size), " "))
    rows = df.select(*keys, F.split(F.col(text), " ").alias("words")).select(
        *keys, F.posexplode(texts).alias("window_no", "window_text")
    )
    return rows.withColumn("n_words", X.word_count(F.col("window_text")))


def min_token_filter(chunks: DataFrame, min_tokens: float = 30) -> DataFrame:
    """Strictly more than ``min_tokens``; the inspection filter below keeps the exact rest."""
    return chunks.where(F.col("chunk_token_count") > min_tokens)


def short_chunk_sample(chunks: DataFrame, min_tokens: float = 30, k: int = 5, seed: str = "short") -> DataFrame:
    short = chunks.where(F.col("chunk_token_count") <= min_tokens)
    return short.orderBy(X.hash_order(seed, F.col("chunk_id")), "chunk_id").limit(k)
