"""Readers: page tables, raw web pages and evaluation sets that are already in storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions import text as X

# The entities decoded in page text; the ampersand comes last.
ENTITIES = (
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&amp;", "&"),
)
# Parts of a raw page that carry no text.
DROPPED = (
    r"(?is)<script[^>]*>.*?</script>",
    r"(?is)<style[^>]*>.*?</style>",
    r"(?s)<!--.*?-->",
    r"(?s)<[^>]*>",
)


def load_pages(
    df: DataFrame, doc_id: str, text: str, number: str | None = None, page_offset: int = 0
) -> DataFrame:
    """Page table. ``page_offset`` pages of front matter come before page zero."""
    at = F.col(number) if number else F.lit(0)
    return df.select(
        F.col(doc_id).alias("doc_id"),
        (at - page_offset).cast("int").alias("page_number"),
        X.format_text(F.col(text)).alias("text"),
    )


def html_text(html: Column) -> Column:
    out = html
    for pattern in DROPPED:
        out = F.regexp_replace(out, pattern, " ")
    for entity, plain in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return X.strip(F.regexp_replace(out, r"[ \t\n\r\f]+", " "))


def html_page_text(df: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    return df.select(F.col(page_id).alias("page_id"), html_text(F.col(html)).alias("text"))


def load_eval_triple(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, split: str | None = None):
    """Corpus, queries and judgements with checked columns; ``split`` becomes a pushed filter."""
    wanted = {"corpus": {"item_id", "text"}, "queries": {"query_id", "text"}, "qrels": {"query_id", "item_id", "relevance"}}
    parts = {"corpus": corpus, "queries": queries, "qrels": qrels}
    for name, columns in wanted.items():
        missing = columns - set(parts[name].columns)
        if missing:
            raise ValueError(f"{name} lacks {sorted(missing)}")
    if split is not None:
        parts = {n: d.where(F.col("split") == split) if "split" in d.columns else d for n, d in parts.items()}
    return parts["corpus"], parts["queries"], parts["qrels"]


def load_qa_dataset(rows: DataFrame, query_id: str, query: str, item: str, text: str):
    """One row per question; the row's own item is the relevant one, and every item is listed once.

    Rows of one item must agree on its text: an item with two texts is listed with both.
    """
    queries = rows.select(F.col(query_id).alias("query_id"), F.col(query).alias("text"))
    corpus = rows.select(F.col(item).alias("item_id"), F.col(text).alias("text")).distinct()
    qrels = rows.select(
        F.col(query_id).alias("query_id"), F.col(item).alias("item_id"), F.lit(1).alias("relevance")
    ).distinct()
    return corpus, queries, qrels


def load_collection(df: DataFrame, dataset: str) -> DataFrame:
    """All datasets of a collection in one scan, told apart by a column instead of a driver loop."""
    return df.withColumn("dataset", F.col(dataset))
