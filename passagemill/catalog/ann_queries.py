"""Vector stores, approximate search, late interaction and late chunking over stored vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagemill.catalog.base import block, query, sql, table, vector_block
from passagemill.catalog.vector_queries import BENCH, DIM, items, self_hits, vec_queries
from passagemill.operators import ann, cells, multivec
from passagemill.plans.session import fresh_path
from passagemill.sources import stores

FLAT_SQL = "SELECT vec_id, label, unnest(range(len(embedding))) AS pos, round(unnest(embedding)::DOUBLE, 6) AS x FROM embeddings"


def flat(df):
    rows = df.select("vec_id", "label", F.posexplode("vec").alias("pos", "x"))
    return rows.withColumn("x", F.round(F.col("x").cast("double"), 6))


def stored(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("vec"))


@query("write_vectors_csv", "SELECT vec_id, len(embedding) AS n FROM embeddings")
def _(spark, sf):
    path = fresh_path(spark, "vectors-csv")
    stores.write_vectors_csv(stored(spark, sf), path)
    back = spark.read.schema("vec_id bigint, label int, vec string").csv(path, header=True, quote='"', escape='"')
    return back.select("vec_id", F.size(F.split(F.btrim("vec", F.lit("[]")), " ")).alias("n"))


@query("read_vectors_csv", FLAT_SQL)
def _(spark, sf):
    path = fresh_path(spark, "vectors-csv")
    stores.write_vectors_csv(stored(spark, sf), path)
    return flat(stores.read_vectors_csv(spark, path, "vec_id bigint, label int, vec string"))


@query("write_vectors_parquet", FLAT_SQL)
def _(spark, sf):
    path = fresh_path(spark, "vectors")
    stores.write_vectors_parquet(stored(spark, sf), path, cell="label")
    return flat(spark.read.parquet(path))


@query("save_index", "SELECT vec_id, label, 1 AS version FROM embeddings")
def _(spark, sf):
    """Built once; the second call finds it and keeps the first version."""
    path = fresh_path(spark, "index")
    base = stored(spark, sf).drop("vec")
    stores.save_index(base.withColumn("version", F.lit(1)), path)
    stores.save_index(base.withColumn("version", F.lit(2)), path)
    return spark.read.parquet(path)


# Trained indexes are beyond SQL: tests hold their recall against the exact scan. Every row is a query against all rows in ``knn_ivf`` and
# ``knn_lsh``; ``pq_encode`` and ``maxsim_index`` ask for every 20th row.


def every_20th(spark, sf):
    return vec_queries(spark, sf).where("query_id % 20 = 0")


BRANCH, PROBES = (8, 8), 32


def stored_cells(spark, sf):
    """A tree fitted on the rows, and the rows laid out by its cells."""
    e = items(spark, sf).select("item_id", "vec")
    tree, path = cells.fit_tree(e, BRANCH), fresh_path(spark, "cells")
    cells.store_index(e, tree, path)
    return e, tree, spark.read.parquet(path)


@query("knn_ivf")
def _(spark, sf):
    _, tree, stored = stored_cells(spark, sf)
    return cells.knn_tree(vec_queries(spark, sf), stored, tree, 5, PROBES, skip_self=True)


TABLES, VOTES = 32, 4
block("lsh_n", f"""SELECT bits, least(64, 1 << greatest(0, bits - 3)) AS probes FROM (
    SELECT greatest(1, least({ann.MOST_BITS}, round(log2(greatest(2, count(*)) / 2))))::INT AS bits FROM embeddings)""")  # fmt: skip
block("lsh_d", f"SELECT unnest({ann.planes(TABLES * ann.MOST_BITS, DIM)}::DOUBLE[][]) AS dir, unnest(range({TABLES * ann.MOST_BITS})) AS p")
block("lsh_x", f"SELECT k, p // bits AS t, p % bits AS j, list_dot_product(vec, dir) AS x FROM em, lsh_d, lsh_n WHERE p < {TABLES} * bits", ("em", "lsh_d", "lsh_n"))
block("lsh_c", "SELECT k, t, sum((x > 0)::INT * (1 << j::INT))::INT AS code, list(x * x ORDER BY j) AS far FROM lsh_x GROUP BY k, t", ("lsh_x",))
block(
    "lsh_p",
    """SELECT k, t, xor(code, f) AS cell FROM (SELECT k, t, code, f, row_number() OVER (PARTITION BY k, t ORDER BY list_sum(list_transform(far,
      lambda m, i: CASE WHEN (f >> (i - 1)::INT) & 1 = 1 THEN m ELSE 0 END)), f) AS n FROM lsh_c, (SELECT unnest(range((SELECT 1 << bits FROM lsh_n)))::INT AS f)), lsh_n WHERE n <= probes""",
    ("lsh_c", "lsh_n"),
)


@query(
    "knn_lsh",
    sql(
        f""", c AS (SELECT a.k AS q, b.k AS d FROM lsh_p a JOIN lsh_c b ON a.t = b.t AND a.cell = b.code AND a.k <> b.k GROUP BY ALL HAVING count(*) >= {VOTES})
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (
          SELECT q AS query_id, d AS item_id, round(list_dot_product(x.vec, y.vec), 6) AS score FROM c JOIN em x ON x.k = q JOIN em y ON y.k = d)) WHERE rank <= 5""",
        "lsh_p",
    ),
)
def _(spark, sf):
    e = items(spark, sf).select("item_id", "vec")
    return ann.knn_multiprobe(vec_queries(spark, sf), e, DIM, 5, TABLES, ann.bits_for(e.count()), votes=VOTES, skip_self=True)


@query("pq_encode")
def _(spark, sf):
    """Residual codes inside the cells, laid out by cell; 200 candidates a query are scored by their vectors."""
    e, tree, stored = stored_cells(spark, sf)
    books, path = cells.fit_residual_books(e, tree), fresh_path(spark, "codes")
    cells.residual_codes(stored, tree, books).write.partitionBy("cell").parquet(path)
    return cells.knn_residual(every_20th(spark, sf), spark.read.parquet(path), e, tree, books, 5, PROBES, 40, skip_self=True)


# ---- many vectors per item ------------------------------------------------------------------


@query(
    "maxsim",
    """WITH m AS (SELECT vec_id // 10 AS id, vec_id % 10 AS pos, embedding::DOUBLE[] AS vec FROM embeddings),
    s AS (SELECT query_id, item_id, round(sum(best), 6) AS score FROM (SELECT a.id AS query_id, b.id AS item_id, a.pos, max(list_dot_product(a.vec, b.vec)) AS best
      FROM m a, m b GROUP BY ALL) GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s) WHERE rank <= 5""",
)
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    pos, vec = (F.col("vec_id") % 10).alias("pos"), F.col("embedding").alias("vec")
    group = F.floor(F.col("vec_id") / 10)
    return multivec.maxsim(e.select(group.alias("query_id"), pos, vec), e.select(group.alias("item_id"), pos, vec))


@query("maxsim_index")
def _(spark, sf):
    """Every 20th item against all of them, by centres first and then by the vectors of the candidates."""
    e = table(spark, sf, "embeddings")
    pos, vec = (F.col("vec_id") % 10).alias("pos"), F.col("embedding").alias("vec")
    group = F.floor(F.col("vec_id") / 10)
    many, path = e.select(group.alias("item_id"), pos, vec), fresh_path(spark, "centroids")
    # few vectors a centre, as centres stand for the vectors here
    tree = cells.fit_tree(e.select(F.col("vec_id").alias("item_id"), vec), (16, 32))
    multivec.store_centroids(many, tree, path)
    asked = e.select(group.alias("query_id"), pos, vec).where("query_id % 20 = 0")
    return multivec.maxsim_search(asked, many, spark.read.parquet(path), tree, 5, 32, 24)


@query(
    "maxsim_rerank",
    sql(
        """, m AS (SELECT vec_id // 10 AS id, vec_id % 10 AS pos, embedding::DOUBLE[] AS vec FROM embeddings),
        c AS (SELECT DISTINCT query_id // 10 AS query_id, item_id // 10 AS item_id FROM self20),
        s AS (SELECT query_id, item_id, round(sum(best), 6) AS score FROM (SELECT query_id, item_id, a.pos, max(list_dot_product(a.vec, b.vec)) AS best
          FROM c JOIN m a ON a.id = query_id JOIN m b ON b.id = item_id GROUP BY ALL) GROUP BY ALL)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s) WHERE rank <= 5""",
        "self20",
    ),
)
def _(spark, sf):
    """The items whose single vectors a first search found, in the order of their late-interaction score."""
    e = table(spark, sf, "embeddings")
    pos, vec = (F.col("vec_id") % 10).alias("pos"), F.col("embedding").alias("vec")
    group = F.floor(F.col("vec_id") / 10)
    first = self_hits(spark, sf, 20).select(F.floor(F.col("query_id") / 10).alias("query_id"), F.floor(F.col("item_id") / 10).alias("item_id"))
    return multivec.maxsim_rerank(first, e.select(group.alias("query_id"), pos, vec), e.select(group.alias("item_id"), pos, vec))


TURNS = vector_block("tv", "turns", "id", "text", ("turns",))
block("turns", "SELECT conv_id || ':' || turn AS id, text FROM conversations")


@query(
    "batch_encode",
    sql(
        f"""SELECT 'query' AS kind, CAST(k AS VARCHAR) AS id, unnest(range({DIM})) AS pos, round(unnest(vec), 6) AS x FROM {BENCH}
        UNION ALL SELECT 'passage', k, unnest(range({DIM})), round(unnest(vec), 6) FROM {TURNS}""",
        BENCH,
        TURNS,
    ),
)
def _(spark, sf):
    queries = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text")
    passages = table(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    q = multivec.batch_encode(queries, "id", "text", batch=4).withColumn("kind", F.lit("query"))
    p = multivec.batch_encode(passages, "id", "text", batch=4).withColumn("kind", F.lit("passage"))
    rows = q.unionByName(p).select("kind", "id", F.posexplode("vec").alias("pos", "x"))
    return rows.withColumn("x", F.round(F.col("x").cast("double"), 6))


block(
    "tokv",
    f"SELECT vec_id // 20 AS doc_id, vec_id % 20 AS pos, unnest(embedding)::DOUBLE AS x, unnest(range({DIM})) AS i FROM embeddings",
)
block("spans", "SELECT DISTINCT doc_id, s AS span_no, s * 6 AS start, s * 6 + 7 AS stop FROM tokv CROSS JOIN (SELECT unnest(range(4)) AS s)", ("tokv",))
POOL_SQL = """SELECT doc_id, span_no, i AS pos, round(avg(x)::FLOAT::DOUBLE, 6) AS x FROM {t} t JOIN spans USING (doc_id)
    WHERE t.pos >= start AND t.pos < stop GROUP BY ALL"""


def token_vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 20).alias("doc_id"), (F.col("vec_id") % 20).alias("pos"), F.col("embedding").alias("vec"))


def token_spans(tokens):
    """Four spans per document, neighbours sharing one token."""
    docs = tokens.select("doc_id").distinct()
    return docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("span_no")).select(
        "doc_id", "span_no", (F.col("span_no") * 6).alias("start"), (F.col("span_no") * 6 + 7).alias("stop")
    )


def pooled(df):
    rows = df.select("doc_id", "span_no", F.posexplode("vec").alias("pos", "x"))
    return rows.withColumn("x", F.round(F.col("x").cast("double"), 6))


@query("late_chunk_pool", sql(POOL_SQL.format(t="tokv"), "spans"))
def _(spark, sf):
    tokens = token_vectors(spark, sf)
    return pooled(multivec.late_chunk_pool(tokens, token_spans(tokens)))


block(
    "segv",
    """SELECT doc_id, pos, i, avg(x * (1 + s))::FLOAT::DOUBLE AS x FROM tokv JOIN (SELECT unnest([0, 1]) AS s) ON pos >= s * 8 AND pos < s * 8 + 12 GROUP BY ALL""",
    ("tokv",),
)


@query("late_chunk_long", sql(POOL_SQL.format(t="segv"), "segv", "spans"))
def _(spark, sf):
    """Segments of 12 tokens every 8; a token's vector differs by segment, as with a real encoder."""
    tokens = token_vectors(spark, sf)
    length = tokens.groupBy("doc_id").agg((F.max("pos") + 1).alias("n"))
    starts = length.select("doc_id", F.posexplode(multivec.macro_segments(F.col("n"), 12, 8)).alias("segment", "first"))
    inside = starts.withColumn("pos", F.explode(F.sequence(F.col("first"), F.col("first") + 11)))
    seen = inside.join(tokens, ["doc_id", "pos"]).withColumn("vec", F.transform("vec", lambda x: x.cast("double") * (1 + F.col("segment"))))
    return pooled(multivec.late_chunk_long(seen, token_spans(tokens)))
