"""Vector functions, exact search, reranking and prompt assembly over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagemill.catalog.base import block, query, sql, table, vector_block
from passagemill.catalog.text_queries import doc_chunks, doc_pages
from passagemill.functions import vectors as V
from passagemill.operators import chunk, search
from passagemill.plans.session import cut_lineage
from passagemill.sources import corpus

DIM = 64

block("em", "SELECT vec_id AS k, embedding::DOUBLE[] AS vec, label FROM embeddings")
BENCH = vector_block("bq", "benchmark", "item_id", "text")
DOCS = vector_block("dv", "documents", "doc_id", "text")
CHUNKS = vector_block("cv", "big_ch", "chunk_id", "sentence_chunk", ("big_ch",))


def knn_block(name: str, q: str, d: str, k: int, skip_self: bool = False, metric: str = "dot") -> None:
    """Oracle block (query_id, item_id, score, rank)."""
    fn = "list_dot_product" if metric == "dot" else "list_cosine_similarity"
    where = "WHERE q.k <> d.k" if skip_self else ""
    block(
        name,
        f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (
          SELECT q.k AS query_id, d.k AS item_id, round({fn}(q.vec, d.vec), 6) AS score FROM {q} q, {d} d {where}))
          WHERE rank <= {k}""",
        (q, d),
    )


knn_block("self5", "em", "em", 5, skip_self=True)
knn_block("self20", "em", "em", 20, skip_self=True)
knn_block("chunk5", BENCH, CHUNKS, 5)
knn_block("doc5", BENCH, DOCS, 5)
knn_block("doc20", BENCH, DOCS, 20)


def items(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"), "label")


def vec_queries(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))


def bench_vectors(spark, sf):
    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return V.embed_text(rows, "text")


def doc_vectors(spark, sf):
    return V.embed_text(table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text", "source", "lang"), "text")


def big_chunks(spark, sf):
    return chunk.min_token_filter(doc_chunks(spark, sf))


def chunk_vectors(spark, sf):
    rows = big_chunks(spark, sf).select(F.col("chunk_id").alias("item_id"), "sentence_chunk")
    return V.embed_text(rows, "sentence_chunk").select("item_id", "vec")


def chunk_hits(spark, sf, k=5):
    return search.knn_exact(bench_vectors(spark, sf), chunk_vectors(spark, sf), k)


def doc_hits(spark, sf, k=5):
    return search.knn_exact(bench_vectors(spark, sf), doc_vectors(spark, sf), k)


def self_hits(spark, sf, k=5):
    return search.knn_exact(vec_queries(spark, sf), items(spark, sf), k, skip_self=True)


# consecutive pairs of the stored vectors, for the scalar functions
PAIR_SQL = "SELECT a.k AS vec_id, {} FROM em a JOIN em b ON b.k = a.k + 1"


def vector_pairs(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id")


@query("dot_product", sql(PAIR_SQL.format("round(list_dot_product(a.vec, b.vec), 6) AS score"), "em"))
def _(spark, sf):
    score = F.round(V.dot_product(F.col("embedding"), F.col("other")), 6)
    return vector_pairs(spark, sf).select("vec_id", score.alias("score"))


@query("cosine_similarity", sql(PAIR_SQL.format("round(list_cosine_similarity(a.vec, b.vec), 6) AS score"), "em"))
def _(spark, sf):
    score = F.round(V.cosine_similarity(F.col("embedding"), F.col("other")), 6)
    return vector_pairs(spark, sf).select("vec_id", score.alias("score"))


@query(
    "l2_normalize",
    """WITH d AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings),
    n AS (SELECT vec_id, pos, (x + pos) AS x FROM d), l AS (SELECT vec_id, sqrt(sum(x * x)) AS s FROM n GROUP BY vec_id)
    SELECT vec_id, pos, round((x / s)::FLOAT::DOUBLE, 6) AS x FROM n JOIN l USING (vec_id)""",
)
def _(spark, sf):
    shifted = F.transform("embedding", lambda x, i: x.cast("double") + i)
    unit = table(spark, sf, "embeddings").select("vec_id", V.l2_normalize(shifted).alias("vec"))
    return unit.select("vec_id", F.posexplode("vec").alias("pos", "v")).select("vec_id", "pos", F.round(F.col("v").cast("double"), 6).alias("x"))


@query("embed_text", sql(f"SELECT k AS doc_id, unnest(range({DIM})) AS pos, round(unnest(vec), 6) AS x FROM {DOCS}", DOCS))
def _(spark, sf):
    rows = doc_vectors(spark, sf).select(F.col("item_id").alias("doc_id"), F.posexplode("vec").alias("pos", "v"))
    return rows.select("doc_id", "pos", F.round(F.col("v").cast("double"), 6).alias("x"))


@query("knn_exact", sql("SELECT * FROM self5", "self5"))
def _(spark, sf):
    return self_hits(spark, sf)


@query(
    "score_all_pairs",
    sql(f"SELECT q.k AS query_id, d.k AS item_id, round(list_dot_product(q.vec, d.vec), 6) AS score FROM {BENCH} q, {DOCS} d", BENCH, DOCS),
)
def _(spark, sf):
    return search.score_all_pairs(bench_vectors(spark, sf), doc_vectors(spark, sf))


@query(
    "search_report",
    sql(
        """SELECT query_id, rank, item_id, round(score + 1e-9, 4) AS score, page_number, sentence_chunk,
        printf('[%.4f] p. %d: %s', round(score + 1e-9, 4), page_number, sentence_chunk) AS line
        FROM chunk5 JOIN big_ch ON chunk_id = item_id""",
        "chunk5",
    ),
)
def _(spark, sf):
    return search.search_report(chunk_hits(spark, sf), big_chunks(spark, sf))


@query("hits_with_text", sql("SELECT query_id, rank, score, item_id, text, source FROM doc5 JOIN documents ON doc_id = item_id", "doc5"))
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text", "source")
    return search.hits_with_text(doc_hits(spark, sf), docs)


block("tn", "SELECT printf('%020d:%020d', conv_id, turn) AS id, text FROM conversations")
TURN_PAGES = vector_block("tp", "tn", "id", "text", ("tn",))
knn_block("turn5", BENCH, TURN_PAGES, 5)


@query(
    "hit_page_lookup",
    sql(
        """SELECT query_id, rank, conv_id AS doc_id, (turn - 2)::INTEGER AS page_number, turn AS source_page, length(text) AS page_chars
        FROM turn5 JOIN conversations ON printf('%020d:%020d', conv_id, turn) = item_id""",
        "turn5",
    ),
)
def _(spark, sf):
    """Conversations as documents whose first two turns are front matter: page 0 is turn 2."""
    turns = table(spark, sf, "conversations")
    # a key of both numbers at full width: no turn is another conversation's, and keys sort as the pair does
    item = lambda conv, turn: F.format_string("%020d:%020d", conv.cast("long"), turn.cast("long")).alias("item_id")
    pages = corpus.load_pages(turns, "conv_id", "text", "turn", page_offset=2)
    named = pages.select(item(F.col("doc_id"), F.col("page_number") + 2), "doc_id", "page_number")
    vectors = V.embed_text(turns.select(item(F.col("conv_id"), F.col("turn")), "text"), "text").select("item_id", "vec")
    hits = search.hits_with_text(search.knn_exact(bench_vectors(spark, sf), vectors, 5), named)
    stored = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("source_page"), F.length("text").alias("page_chars"))
    found = search.hit_page_lookup(hits, stored, 2).withColumn("source_page", F.col("source_page").cast("long"))
    return found.select("query_id", "rank", "doc_id", "page_number", "source_page", "page_chars")


MATRIX = [[round(((i * 31 + j * 17) % 13 - 6) / 6.0, 4) for j in range(DIM)] for i in range(8)]


@query(
    "project_vectors",
    sql(" UNION ALL ".join(f"SELECT k AS vec_id, {i} AS pos, round(list_dot_product(vec, {row}::DOUBLE[]), 6) AS x FROM em" for i, row in enumerate(MATRIX)), "em"),
)
def _(spark, sf):
    low = table(spark, sf, "embeddings").select("vec_id", V.project(F.col("embedding"), MATRIX).alias("low"))
    return low.select("vec_id", F.posexplode("low").alias("pos", "x")).select("vec_id", "pos", F.round("x", 6).alias("x"))


block(
    "cls",
    f"""SELECT label AS k, list(m ORDER BY pos) AS vec FROM (SELECT label, pos, avg(x)::FLOAT::DOUBLE AS m FROM
      (SELECT label, unnest(vec) AS x, unnest(range({DIM})) AS pos FROM em) GROUP BY label, pos) GROUP BY label""",
    ("em",),
)
knn_block("cls1", "em", "cls", 1, metric="cosine")


@query("zero_shot_label", sql("SELECT query_id AS item_id, item_id AS label, score FROM cls1", "cls1"))
def _(spark, sf):
    e = items(spark, sf)
    return search.zero_shot_label(e.drop("label"), search.class_vectors(e, "label"))


block("even", "SELECT * FROM em WHERE label < 5", ("em",))
block("odd", "SELECT * FROM em WHERE label >= 5", ("em",))
knn_block("cross5", "even", "odd", 5)


@query("cross_modal_knn", sql("SELECT * FROM cross5", "cross5"))
def _(spark, sf):
    """Labels stand for modalities: 0-4 ask, 5-9 are searched."""
    e = items(spark, sf)
    asking = e.where("label < 5").select(F.col("item_id").alias("query_id"), "vec")
    return search.cross_modal_knn(asking, e, F.col("label") >= 5)


block(
    "xq",
    f"""SELECT k, list(m ORDER BY pos) AS vec FROM (SELECT k, pos, avg(x)::FLOAT::DOUBLE AS m FROM
      (SELECT k, unnest(vec) AS x, unnest(range({DIM})) AS pos FROM
        (SELECT k, vec FROM {BENCH} UNION ALL SELECT h.query_id, d.vec FROM doc5 h JOIN {DOCS} d ON d.k = h.item_id))
      GROUP BY k, pos) GROUP BY k""",
    (BENCH, DOCS, "doc5"),
)
knn_block("xq5", "xq", DOCS, 5)


@query("expanded_query_vector", sql("SELECT * FROM xq5", "xq5"))
def _(spark, sf):
    """The first search's documents stand for the supplied draft answers."""
    asked, docs = bench_vectors(spark, sf), cut_lineage(doc_vectors(spark, sf).select("item_id", "vec"), "vectors")
    drafts = cut_lineage(search.knn_exact(asked, docs, 5), "drafts").join(docs, "item_id")
    return search.knn_exact(search.expanded_query_vector(asked, drafts), docs, 5)


block("other", "SELECT k, list_transform(vec, lambda x, i: x * (1 + i % 3)) AS vec FROM em", ("em",))


@query(
    "rerank",
    sql(
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (
        SELECT query_id, item_id, h.rank AS first_rank, round(list_cosine_similarity(q.vec, d.vec), 6) AS score
        FROM self20 h JOIN em q ON q.k = query_id JOIN other d ON d.k = item_id)) WHERE rank <= 5""",
        "self20",
        "other",
    ),
)
def _(spark, sf):
    """Second scorer: cosine against differently weighted stored vectors."""
    weighted = items(spark, sf).select("item_id", F.transform("vec", lambda x, i: x.cast("double") * (1 + (i + 1) % 3)).alias("vec"))
    return search.rerank(self_hits(spark, sf, 20), vec_queries(spark, sf), weighted, 5)


@query(
    "multi_store_search",
    sql(
        f"""SELECT query_id, item_id, score, source, store_rank, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, item_id) AS store_rank FROM (
            SELECT q.k AS query_id, d.k AS item_id, source, round(list_dot_product(q.vec, d.vec), 6) AS score
            FROM {BENCH} q, {DOCS} d JOIN documents ON doc_id = d.k))
        WHERE store_rank <= 3) WHERE rank <= 5""",
        BENCH,
        DOCS,
    ),
)
def _(spark, sf):
    return search.multi_store_search(bench_vectors(spark, sf), doc_vectors(spark, sf), "source", 3, 5)


@query(
    "dynamic_k",
    sql(
        """SELECT query_id, item_id, score, rank FROM (SELECT *, first_value(rank) OVER (PARTITION BY query_id
          ORDER BY drop DESC NULLS LAST, rank) AS cut FROM (SELECT *, round(score - lead(score) OVER (PARTITION BY query_id
          ORDER BY rank), 6) AS drop FROM self20)) WHERE rank <= cut""",
        "self20",
    ),
)
def _(spark, sf):
    return search.dynamic_k(self_hits(spark, sf, 20), "gap")


@query("dynamic_k_mixture")
def _(spark, sf):
    return search.dynamic_k(self_hits(spark, sf, 20))
