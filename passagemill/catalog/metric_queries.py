"""Evaluation over the given tables: rankings of documents for benchmark passages, and answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from passagemill.catalog.base import block, query, sql, table, vector_block
from passagemill.catalog.lexical_queries import W, bm25_hits
from passagemill.catalog.text_queries import ANNOTATIONS_SQL, QRELS_SQL, annotations, doc_pages, eval_triple
from passagemill.catalog.vector_queries import BENCH, DOCS, bench_vectors, doc_hits, doc_vectors
from passagemill.functions import text as X
from passagemill.functions import vectors as V
from passagemill.operators import chunk, metrics, search
from passagemill.plans.session import cut_lineage, fresh_path
from passagemill.sources import stores

block("qr", QRELS_SQL)
block("rel", "SELECT query_id, count(*) AS n_rel, sum(1.0::DOUBLE / log2(r + 1)) FILTER (WHERE r <= 5) AS ideal FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY item_id) AS r FROM qr) GROUP BY query_id", ("qr",))
block(
    "pq",
    """SELECT query_id, coalesce(f, 0) / n_rel::DOUBLE AS recall, coalesce(f, 0) / 5.0::DOUBLE AS precision, coalesce(1.0::DOUBLE / m, 0) AS mrr,
      coalesce(g, 0) / ideal AS ndcg, (coalesce(m, 0) = 1)::INT::DOUBLE AS hit1 FROM rel LEFT JOIN
      (SELECT query_id, count(*) AS f, min(rank) AS m, sum(1.0::DOUBLE / log2(rank + 1)) AS g FROM doc5 JOIN qr USING (query_id, item_id) GROUP BY query_id)
      USING (query_id)""",
    ("rel", "doc5"),
)


def qrels(spark, sf):
    return eval_triple(spark, sf)[2]


for _name, _metric in (("recall_at_k", "recall"), ("precision_at_k", "precision"), ("mrr", "mrr"), ("ndcg_at_k", "ndcg"), ("hit_at_1", "hit1")):

    def _one(spark, sf, name=_name):
        return getattr(metrics, name)(doc_hits(spark, sf), qrels(spark, sf))

    query(_name, sql(f"SELECT count(*) AS n_queries, round(avg({_metric}), 6) AS {_metric} FROM pq", "pq"))(_one)

block(
    "src5",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, item_id) AS rank FROM (
      SELECT q.k AS query_id, d.k AS item_id, source, round(list_dot_product(q.vec, d.vec), 6) AS score
      FROM {BENCH} q, {DOCS} d JOIN documents ON doc_id = d.k)) WHERE rank <= 5""",
    (BENCH, DOCS),
)
block("srel0", "SELECT source, query_id, item_id, row_number() OVER (PARTITION BY source, query_id ORDER BY item_id) AS r FROM qr JOIN documents ON doc_id = item_id", ("qr",))
block("srel", "SELECT source, query_id, count(*) AS n_rel, sum(1.0::DOUBLE / log2(r + 1)) FILTER (WHERE r <= 5) AS ideal FROM srel0 GROUP BY ALL", ("srel0",))
block(
    "evals",
    """SELECT source AS dataset, round(avg(coalesce(f, 0) / n_rel::DOUBLE), 6) AS recall, round(avg(coalesce(f, 0) / 5.0::DOUBLE), 6) AS precision,
      round(avg(coalesce(1.0::DOUBLE / m, 0)), 6) AS mrr, round(avg(coalesce(g, 0) / ideal), 6) AS ndcg, round(avg((coalesce(m, 0) = 1)::INT), 6) AS hit1
      FROM srel LEFT JOIN (SELECT source, query_id, count(*) AS f, min(rank) AS m, sum(1.0::DOUBLE / log2(rank + 1)) AS g
        FROM src5 JOIN srel0 USING (source, query_id, item_id) GROUP BY ALL) USING (source, query_id) GROUP BY source""",
    ("src5", "srel0", "srel"),
)
EVAL_SQL = sql(
    " UNION ALL ".join(f"SELECT dataset, '{m}' AS metric, {m} AS value FROM evals" for m in metrics.METRICS), "evals"
)


def evaluated(spark, sf):
    """Every source is a dataset; one pass ranks all of them."""
    docs = doc_vectors(spark, sf)
    hits = search.knn_exact(bench_vectors(spark, sf), docs, 5, lane="source")
    judged = qrels(spark, sf).join(table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "source"), "item_id")
    return metrics.evaluate_dataset(hits, judged, 5, "source")


@query("evaluate_dataset", EVAL_SQL)
def _(spark, sf):
    return evaluated(spark, sf)


@query("write_metrics_json", EVAL_SQL)
def _(spark, sf):
    """Written as JSON maps, read back in long form."""
    path = fresh_path(spark, "metrics-json")
    stores.write_metrics_json(evaluated(spark, sf), path)
    back = spark.read.schema("dataset string, metrics map<string,double>").json(path)
    return back.select("dataset", F.explode("metrics").alias("metric", "value"))


@query(
    "sweep_eval",
    sql(
        """SELECT k, round(avg(coalesce(f, 0) / n_rel::DOUBLE), 6) AS recall, round(avg(coalesce(1.0::DOUBLE / m, 0)), 6) AS mrr
        FROM rel CROSS JOIN (SELECT unnest([1, 3, 5, 10, 20]) AS k) LEFT JOIN (SELECT k, query_id, count(*) AS f, min(rank) AS m FROM doc20
          JOIN qr USING (query_id, item_id) JOIN (SELECT unnest([1, 3, 5, 10, 20]) AS k) ON rank <= k GROUP BY ALL) USING (k, query_id) GROUP BY k""",
        "rel",
        "doc20",
    ),
)
def _(spark, sf):
    return metrics.sweep_eval(doc_hits(spark, sf, 20), qrels(spark, sf), (1, 3, 5, 10, 20))


SIZES = (5, 10, 20)
block(
    "szc",
    rf"""SELECT chunk_size, doc_id, id, t FROM (SELECT chunk_size, doc_id, chunk_size || '/' || doc_id || '-0-' || i AS id,
      regexp_replace(trim(replace(array_to_string(list_slice(sentences, i * chunk_size + 1, i * chunk_size + chunk_size), ''), '  ', ' '), '{X.BLANKS}'),
        '\.([A-Z0-9])', '. \1', 'g') AS t
      FROM (SELECT chunk_size, doc_id, sentences, unnest(range(0, CAST(ceil(len(sentences) / chunk_size::DOUBLE) AS BIGINT))) AS i
        FROM sn CROSS JOIN (SELECT unnest({list(SIZES)}) AS chunk_size))) WHERE length(t) > 120""",
    ("sn",),
)
SIZED = vector_block("zv", "szc", "id", "t", ("szc",))
block(
    "szh",
    f"""SELECT chunk_size, query_id, doc_id AS item_id, min(r) AS best FROM (SELECT chunk_size, q.k AS query_id, doc_id, row_number() OVER (
      PARTITION BY chunk_size, q.k ORDER BY round(list_dot_product(q.vec, d.vec), 6) DESC, d.k) AS r FROM {BENCH} q, {SIZED} d JOIN szc ON id = d.k)
      WHERE r <= 20 GROUP BY ALL""",
    (BENCH, SIZED, "szc"),
)


@query(
    "sweep_eval_chunk_size",
    sql(
        """, h AS (SELECT *, row_number() OVER (PARTITION BY chunk_size, query_id ORDER BY best) AS rank FROM szh),
        g AS (SELECT unnest([1, 5]) AS k), z AS (SELECT unnest([5, 10, 20]) AS chunk_size)
        SELECT chunk_size, k, round(avg(coalesce(f, 0) / n_rel::DOUBLE), 6) AS recall, round(avg(coalesce(1.0::DOUBLE / m, 0)), 6) AS mrr
        FROM rel CROSS JOIN g CROSS JOIN z LEFT JOIN (SELECT chunk_size, k, query_id, count(*) AS f, min(rank) AS m FROM h JOIN qr USING (query_id, item_id)
          JOIN g ON rank <= k GROUP BY ALL) USING (chunk_size, k, query_id) GROUP BY chunk_size, k""",
        "rel",
        "szh",
    ),
)
def _(spark, sf):
    """Chunk sizes as lanes of one search; a document ranks where its first chunk does."""
    rows, pages = None, cut_lineage(chunk.split_sentences(doc_pages(spark, sf)).select("doc_id", "page_number", "sentences"), "sentences")
    for size in SIZES:
        part = chunk.min_token_filter(chunk.make_chunks(pages, size)).withColumn("chunk_size", F.lit(size))
        rows = part if rows is None else rows.unionByName(part)
    named = rows.select("chunk_size", F.concat_ws("/", "chunk_size", "chunk_id").alias("item_id"), "sentence_chunk")
    hits = search.knn_exact(bench_vectors(spark, sf), V.embed_text(named, "sentence_chunk"), 20, lane="chunk_size")
    doc = F.split_part(F.split_part("item_id", F.lit("/"), F.lit(2)), F.lit("-"), F.lit(1)).cast("long")
    firsts = hits.groupBy("chunk_size", "query_id", doc.alias("item_id")).agg(F.min("rank").alias("best"))
    w = Window.partitionBy("chunk_size", "query_id").orderBy("best")
    ranks = firsts.withColumn("rank", F.row_number().over(w))
    judged = qrels(spark, sf).withColumn("chunk_size", F.explode(F.array(*[F.lit(s) for s in SIZES])))
    return metrics.sweep_eval(ranks, judged, (1, 5), "chunk_size")


@query(
    "context_size_report",
    sql(
        """, h AS (SELECT 'dense' AS method, query_id, item_id, rank FROM doc5 UNION ALL SELECT 'sparse', query_id, item_id, rank FROM bm5),
        t AS (SELECT m.method, rel.query_id, coalesce(sum(n_chars / 4.0::DOUBLE), 0) AS tok, count(qr.item_id) / any_value(n_rel)::DOUBLE AS recall
          FROM rel CROSS JOIN (SELECT unnest(['dense', 'sparse']) AS method) m LEFT JOIN h ON h.method = m.method AND h.query_id = rel.query_id
          LEFT JOIN documents ON doc_id = h.item_id LEFT JOIN qr ON qr.query_id = rel.query_id AND qr.item_id = h.item_id GROUP BY ALL)
        SELECT method, (floor(tok / 200) * 200)::BIGINT AS bucket, count(*) AS n_queries, round(avg(tok), 6) AS avg_tokens, round(avg(recall), 6) AS recall
        FROM t GROUP BY ALL""",
        "rel",
        "doc5",
        "bm5",
    ),
)
def _(spark, sf):
    dense = doc_hits(spark, sf).select(F.lit("dense").alias("method"), "query_id", "item_id", "rank")
    sparse = bm25_hits(spark, sf).select(F.lit("sparse").alias("method"), "query_id", "item_id", "rank")
    sizes = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), X.token_count(F.col("text")).alias("tokens"))
    return metrics.context_size_report(dense.unionByName(sparse), qrels(spark, sf), sizes, ["dense", "sparse"])


# ---- answers: every assistant turn against the one before it ---------------------------------

block(
    "an",
    """SELECT b.conv_id || ':' || b.turn AS answer_id, a.text AS gold, b.text AS got FROM conversations a JOIN conversations b
      ON a.conv_id = b.conv_id AND b.turn = a.turn + 2 WHERE a.role = 'assistant' AND b.role = 'assistant'""",
)


def answers(spark, sf):
    """Keyed by (conversation, turn), so that a very long conversation is many rows of the join."""
    turns = table(spark, sf, "conversations").where("role = 'assistant'")
    before = turns.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("text").alias("gold"))
    joined = turns.select("conv_id", "turn", F.col("text").alias("got")).join(before, ["conv_id", "turn"])
    return joined.select(F.concat_ws(":", "conv_id", "turn").alias("answer_id"), "gold", "got")


def norm_sql(column: str) -> str:
    return f"array_to_string(regexp_extract_all(lower({column}), {W}), ' ')"



@query("exact_accuracy", sql(f"SELECT count(*) AS n, round(avg(({norm_sql('got')} = {norm_sql('gold')})::INT), 6) AS accuracy FROM an", "an"))
def _(spark, sf):
    return metrics.exact_accuracy(answers(spark, sf), "got", "gold")


def gram_sql(n: int, side: str) -> str:
    return f"""SELECT answer_id, {n} AS n, array_to_string(list_slice(w, i, i + {n - 1}), ' ') AS gram FROM (SELECT answer_id, w,
      unnest(range(1, len(w) - {n} + 2)) AS i FROM (SELECT answer_id, regexp_extract_all(lower({side}), {W}) AS w FROM an))"""


def match_sql(n: int) -> str:
    return sql(
        f""", a AS (SELECT answer_id, gram, count(*) AS x FROM ({gram_sql(n, 'got')}) GROUP BY ALL),
        b AS (SELECT answer_id, gram, count(*) AS y FROM ({gram_sql(n, 'gold')}) GROUP BY ALL),
        m AS (SELECT an.answer_id, coalesce((SELECT sum(least(x, y)) FROM a JOIN b USING (answer_id, gram) WHERE a.answer_id = an.answer_id), 0)::DOUBLE AS mt,
          coalesce((SELECT sum(x) FROM a WHERE a.answer_id = an.answer_id), 0) AS ta, coalesce((SELECT sum(y) FROM b WHERE b.answer_id = an.answer_id), 0) AS tb FROM an),
        s AS (SELECT answer_id, CASE WHEN ta > 0 THEN mt / ta ELSE 0 END AS p, CASE WHEN tb > 0 THEN mt / tb ELSE 0 END AS r FROM m)
        SELECT answer_id, round(p, 6) AS precision, round(r, 6) AS recall, CASE WHEN p + r > 0 THEN round(2 * p * r / (p + r), 6) ELSE 0 END AS f1 FROM s""",
        "an",
    )


@query("token_f1", match_sql(1))
def _(spark, sf):
    return metrics.token_f1(answers(spark, sf), "answer_id", "got", "gold")


@query("rouge_n", match_sql(2))
def _(spark, sf):
    return metrics.rouge_n(answers(spark, sf), "answer_id", "got", "gold", 2)


@query(
    "bleu",
    sql(
        ", ga AS (" + " UNION ALL ".join(gram_sql(n, "got") for n in range(1, 5)) + "), gb AS (" + " UNION ALL ".join(gram_sql(n, "gold") for n in range(1, 5))
        + f"""), c AS (SELECT n, sum(least(x, coalesce(y, 0))) AS m, sum(x) AS t FROM (SELECT answer_id, n, gram, count(*) AS x FROM ga GROUP BY ALL)
        LEFT JOIN (SELECT answer_id, n, gram, count(*) AS y FROM gb GROUP BY ALL) USING (answer_id, n, gram) GROUP BY n),
        l AS (SELECT sum(len(regexp_extract_all(lower(got), {W})))::BIGINT AS got_len, sum(len(regexp_extract_all(lower(gold), {W})))::BIGINT AS gold_len FROM an)
        SELECT got_len, gold_len, (SELECT CASE WHEN count(*) = 4 AND min(m) > 0 THEN round(exp(avg(CASE WHEN m > 0 THEN ln(m / t::DOUBLE) END)) *
        CASE WHEN got_len >= gold_len THEN 1 ELSE exp(1 - gold_len / got_len::DOUBLE) END, 6) ELSE 0 END FROM c) AS bleu FROM l""",
        "an",
    ),
)
def _(spark, sf):
    return metrics.bleu(answers(spark, sf), "answer_id", "got", "gold")


@query("anls")
def _(spark, sf):
    """Last answer against the earlier ones. The oracle's engine counts edits in bytes, so a test holds this against brute force."""
    turns = table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text")
    last = turns.groupBy("conv_id").agg(F.max_by("text", "turn").alias("got"), F.max("turn").alias("last_turn"))
    golds = turns.join(last.select("conv_id", "last_turn"), "conv_id").where("turn <> last_turn").select("conv_id", F.col("text").alias("gold"))
    return metrics.anls(last, golds, "conv_id", "got", "gold")


@query(
    "depth_accuracy",
    sql(
        """SELECT least(floor((strpos(d.text, b.text) - 1) / length(d.text)::DOUBLE * 5), 4)::INT AS depth, (length(d.text) // 1000) * 1000 AS length,
        count(*) AS n, round(avg((h.rank IS NOT NULL)::INT), 6) AS accuracy FROM qr JOIN documents d ON d.doc_id = qr.item_id
        JOIN benchmark b ON b.item_id = qr.query_id LEFT JOIN doc5 h ON h.query_id = qr.query_id AND h.item_id = qr.item_id GROUP BY ALL""",
        "qr",
        "doc5",
    ),
)
def _(spark, sf):
    needles = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("needle"))
    hay = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text")
    rows = qrels(spark, sf).join(needles, "query_id").join(hay, "item_id")
    rows = rows.join(doc_hits(spark, sf).select("query_id", "item_id", "rank"), ["query_id", "item_id"], "left").select(
        ((F.instr(F.col("text"), F.col("needle")) - 1) / F.length("text")).alias("at"),
        F.length("text").alias("size"),
        F.col("rank").isNotNull().cast("int").alias("correct"),
    )
    return metrics.depth_accuracy(rows, "at", "size", "correct")


@query(
    "human_vs_system",
    f"""WITH {ANNOTATIONS_SQL} SELECT source, count(*) AS n, round(avg((a.answer = quality)::INT), 6) AS human,
    round(avg((b.answer = quality)::INT), 6) AS system FROM labels JOIN documents USING (doc_id) LEFT JOIN a ON a.item_id = doc_id
    LEFT JOIN b ON b.item_id = doc_id GROUP BY source""",
)
def _(spark, sf):
    a, b = annotations(spark, sf)
    rows = (
        table(spark, sf, "labels")
        .join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
        .join(a.select(F.col("item_id").alias("doc_id"), F.col("answer").alias("human")), "doc_id", "left")
        .join(b.select(F.col("item_id").alias("doc_id"), F.col("answer").alias("system")), "doc_id", "left")
    )
    return metrics.human_vs_system(rows, "source", "human", "system", "quality")
