"""Term statistics, sparse and hybrid retrieval, focus and query rewriting.

A document is one row, so its words are counted where it is, a batch of rows at a time. No text is shuffled; what leaves a task is terms with their counts, or each query's best k.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.functions import text as X
from passagemill.operators.search import DIGITS, ranked
from passagemill.plans.session import cut_lineage
from passagemill.plans.skew import salted_join

K1, B = 1.2, 0.75
#: Words counted at once, or one row's.
COUNTED_WORDS = 1 << 18
FUSION_CONSTANT = 60


def words_of(docs: DataFrame, keep: list, words: Column) -> DataFrame:
    """One row per word. The outer form keeps Spark from cutting the text a second time in an
    inferred filter."""
    return docs.select(*keep, F.explode_outer(words).alias("term")).where(F.col("term").isNotNull())


def term_frequencies(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, doc_len, term, tf), counted where the rows are, an Arrow batch at a time; ``key`` names a row."""
    def counted(keys: pa.Array, lists: pa.Array, size: np.ndarray) -> pa.RecordBatch:
        at, term, terms, tf = _counts(lists, size)
        columns = [keys.take(pa.array(at)), pa.array(size[at].astype(np.int32)), terms.take(pa.array(term)), pa.array(tf)]
        return pa.RecordBatch.from_arrays(columns, names=["key", "doc_len", "term", "tf"])

    return _in_pieces(docs, key, text, counted, "key {}, doc_len int, term string, tf long").withColumnRenamed("key", key)


def term_lists(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, terms, tfs): a row for each row of ``docs``, with its words and how often they occur, also where it has none."""

    def counted(keys: pa.Array, lists: pa.Array, size: np.ndarray) -> pa.RecordBatch:
        at, term, terms, tf = _counts(lists, size)
        ends = pa.array(np.searchsorted(at, np.arange(len(size) + 1)).astype(np.int32))
        columns = [keys, pa.ListArray.from_arrays(ends, terms.take(pa.array(term))), pa.ListArray.from_arrays(ends, pa.array(tf))]
        return pa.RecordBatch.from_arrays(columns, names=["key", "terms", "tfs"])

    return _in_pieces(docs, key, text, counted, "key {}, terms array<string>, tfs array<long>").withColumnRenamed("key", key)


def term_postings(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(term, key, tf, doc_len): ``term_frequencies`` with the rows of a term in arrays, a row for each term of so many words."""

    def counted(keys: pa.Array, lists: pa.Array, size: np.ndarray) -> pa.RecordBatch:
        at, term, terms, tf = _counts(lists, size)
        order = np.argsort(term, kind="stable")
        at, ends = at[order], pa.array(np.searchsorted(term[order], np.arange(len(terms) + 1)).astype(np.int32))
        values = keys.take(pa.array(at)), pa.array(tf[order]), pa.array(size[at].astype(np.int32))
        return pa.RecordBatch.from_arrays([terms, *(pa.ListArray.from_arrays(ends, x) for x in values)], names=["term", "key", "tf", "doc_len"])

    return _in_pieces(docs, key, text, counted, "term string, key array<{}>, tf array<long>, doc_len array<int>").withColumnRenamed("key", key)


def _counts(lists: pa.Array, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Row, number of the term and count of each of a row's terms, by row; and the terms."""
    coded = pc.dictionary_encode(lists.flatten())
    bits = len(coded.dictionary).bit_length()
    row = np.repeat(np.arange(len(size)), size)
    found, tf = np.unique(row << bits | coded.indices.to_numpy(), return_counts=True)
    return found >> bits, found & ((1 << bits) - 1), coded.dictionary, tf.astype(np.int64)


def _in_pieces(docs: DataFrame, key: str, text: str, counted: Callable, schema: str) -> DataFrame:
    """What ``counted`` makes of the keys, word lists and numbers of words of so many rows; ``{}`` in ``schema`` is the key's type."""
    words = docs.select(F.col(key).alias("key"), X.tokens(F.col(text)).alias("words"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, at = np.cumsum(size), 0
            while at < len(size):
                to = max(at + 1, int(np.searchsorted(ends, COUNTED_WORDS + (ends[at - 1] if at else 0), "right")))
                yield counted(batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), size[at:to])
                at = to

    return words.mapInArrow(count, schema.format(words.schema["key"].dataType.simpleString()))


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df): only partial counts are shuffled."""
    words = words_of(docs, [], F.array_distinct(X.tokens(F.col(text))))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def inverted_index(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(term, key, tf, doc_len, df), one row per posting; a common term's postings stay spread."""
    df = cut_lineage(document_frequencies(docs, text), "df")
    return salted_join(term_frequencies(docs, key, text), df, "term", df, "df")


def asked_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))


def asked_frequencies(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """(term, df, words) for the given terms, in one pass; only partial counts are shuffled.

    The row with the empty term stands for the corpus: number of documents and of words.
    """
    cut = docs.select(X.tokens(F.col(text)).alias("cut"))
    each = F.transform(F.array_distinct("cut"), lambda t: F.struct(t.alias("term"), F.lit(0).alias("words")))
    whole = F.array(F.struct(F.lit("").alias("term"), F.size("cut").alias("words")))
    corpus = terms.sparkSession.range(1).select(F.lit("").alias("term"))
    wanted = cut_lineage(terms.select("term").unionByName(corpus).distinct(), "asked")
    found = cut.select(F.inline(F.concat(each, whole))).join(wanted, "term", "left_semi")
    counted = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("words").alias("words"))
    return cut_lineage(counted, "df")


def score_terms(tf: DataFrame, weights: DataFrame, key: str, value: Column) -> DataFrame:
    """Sum of ``value`` over the terms a query and a document share: (query_id, item_id, score).

    ``weights(query_id, term, ...)`` is stored first, so its size is known: a small table is
    broadcast and the sums stay in the documents' layout, a large one is joined by term.
    """
    return (
        tf.join(cut_lineage(weights, "weights"), "term")
        .groupBy(key, "query_id")
        .agg(F.round(F.sum(value), DIGITS).alias("score"))
        .select("query_id", F.col(key).alias("item_id"), "score")
    )


def bm25_scores(queries: DataFrame, docs: DataFrame, key: str, text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """Sparse score of every matching (query, document); idf = ln(1 + (N - df + 0.5) / (df + 0.5)).

    First pass: corpus size and the asked terms' counts. Second pass: scores, document by document.
    """
    asked = asked_terms(queries)
    df = asked_frequencies(docs, asked, text)
    whole = df.where("term = ''")
    n_docs, avg_len = whole.select("df").scalar(), whole.select(F.col("words") / F.col("df")).scalar()
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = asked.join(df, "term").select("query_id", "term", idf.alias("idf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / avg_len))
    return score_terms(term_frequencies(docs, key, text), weights, key, part)


def bm25_search(queries: DataFrame, docs: DataFrame, key: str, k: int = 5, text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    return ranked(bm25_scores(queries, docs, key, text, k1, b), k)


def overlap_scores(queries: DataFrame, docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Number of different words a query and a document share."""
    return score_terms(term_frequencies(docs, key, text), asked_terms(queries), key, F.lit(1.0))


def hard_negatives(queries: DataFrame, docs: DataFrame, positives: DataFrame, key: str, n: int = 5) -> DataFrame:
    """Documents that share the most words with the question yet do not contain its answer."""
    scores = overlap_scores(queries, docs, key)
    return ranked(scores.join(positives.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti"), n)


def fuse(rankings: dict[str, DataFrame], k: int = 5, constant: int = FUSION_CONSTANT, weights: dict[str, float] | None = None) -> DataFrame:
    """Reciprocal-rank fusion of several hit tables in one union and one aggregation."""
    weights = weights or {}
    out = None
    for name, hits in rankings.items():
        part = hits.select("query_id", "item_id", (F.lit(float(weights.get(name, 1.0))) / (constant + F.col("rank"))).alias("part"))
        out = part if out is None else out.unionByName(part)
    return ranked(out.groupBy("query_id", "item_id").agg(F.round(F.sum("part"), DIGITS).alias("score")), k)


def fuse_minmax(rankings: dict[str, DataFrame], weights: dict[str, float], k: int = 5) -> DataFrame:
    """Weighted sum of scores scaled to 0..1 within each query and ranking."""
    out = None
    w = Window.partitionBy("query_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for name, hits in rankings.items():
        low, high = F.min("score").over(w), F.max("score").over(w)
        scaled = F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0)
        part = hits.select("query_id", "item_id", (scaled * float(weights[name])).alias("part"))
        out = part if out is None else out.unionByName(part)
    return ranked(out.groupBy("query_id", "item_id").agg(F.round(F.sum("part"), DIGITS).alias("score")), k)


def hybrid_search(dense: DataFrame, sparse: DataFrame, k: int = 5, weights: dict[str, float] | None = None) -> DataFrame:
    """Dense and sparse hits fused: by reciprocal rank, or by min-max scaled scores when weighted."""
    both = {"dense": dense, "sparse": sparse}
    return fuse_minmax(both, weights, k) if weights else fuse(both, k)


def query_expansion(queries: DataFrame, docs: DataFrame, hits: DataFrame, key: str, m: int = 3, min_length: int = 1, text: str = "text") -> DataFrame:
    """Queries with ``m`` corpus words added: those that occur in most of the query's first hits.

    Co-occurrence is read from the hits alone, at most k documents per query. A word's score is its
    number of hit documents times its idf in the whole corpus.
    """
    mine = cut_lineage(hits.select("query_id", F.col("item_id").alias(key)), "hits").join(docs.select(key, text), key)
    seen = (
        mine.select("query_id", F.explode(F.array_distinct(X.tokens(F.col(text)))).alias("term"))
        .where(F.length("term") >= min_length)
        .groupBy("query_id", "term")
        .agg(F.count(F.lit(1)).alias("together"))
    )
    fresh = cut_lineage(seen.join(asked_terms(queries), ["query_id", "term"], "left_anti"), "terms")
    df = asked_frequencies(docs, fresh, text)
    size = df.where("term = ''").select("df").scalar()
    scored = fresh.join(df, "term").select(
        "query_id", F.col("term").alias("item_id"), F.round(F.col("together") * F.log(size / F.col("df")), DIGITS).alias("score")
    )
    added = ranked(scored, m).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col("item_id").alias("term")))).alias("added")
    )
    extra = F.coalesce(F.array_join(F.col("added.term"), " "), F.lit(""))
    return queries.join(added, "query_id", "left").select(
        "query_id", X.strip(F.concat_ws(" ", F.col("text"), extra)).alias("text"), extra.alias("added_terms")
    )


def focus_sentences(queries: DataFrame, hits: DataFrame, docs: DataFrame, key: str, n: int = 3, text: str = "text") -> DataFrame:
    """Best sentences of the retrieved documents: shared words over the sentence's distinct words."""
    rows = cut_lineage(hits.select("query_id", F.col("item_id").alias(key)), "hits").join(docs.select(key, text), key)
    sentences = rows.select("query_id", F.col(key).alias("doc"), F.posexplode(X.sentences(X.format_text(F.col(text)))).alias("pos", "sentence"))
    asked = queries.select("query_id", F.array_distinct(X.tokens(F.col("text"))).alias("asked"))
    cut = sentences.withColumn("own", F.array_distinct(X.tokens(F.col("sentence")))).where(F.size("own") > 0)
    share = F.size(F.array_intersect("own", "asked")) / F.size("own")
    scored = cut.join(asked, "query_id").withColumn("score", F.round(share, DIGITS))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc", "pos")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("asked", "own")


# Openings that tell a system what to do and are not part of the question.
INSTRUCTIONS = (
    r"^(please )?(answer|explain|summarise|summarize|describe|translate) (the following|this)[^:.]*[:.] *",
    r"^(you are|act as) [^.]*\. *",
)


def content_query(text: Column, rules: tuple[str, ...] = INSTRUCTIONS) -> Column:
    """The prompt without its instruction part."""
    out = X.format_text(text)
    for rule in rules:
        out = F.regexp_replace(out, "(?i)" + rule, "")
    return X.strip(out)
