"""Lexical and hybrid retrieval, prompts and answers over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagemill.catalog.base import block, query, sql, table
from passagemill.catalog.text_queries import QRELS_SQL, eval_triple
from passagemill.catalog.vector_queries import BENCH, DOCS, bench_vectors, big_chunks, chunk_hits, doc_hits, doc_vectors
from passagemill.functions.text import BLANKS
from passagemill.operators import lexical, postings, prompt, search
from passagemill.plans.session import fresh_path

W = r"'[\p{L}\p{N}]+'"
block("tf", f"SELECT doc_id, t AS term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), {W})) AS t FROM documents) GROUP BY ALL")
block("dl", "SELECT doc_id, sum(tf)::BIGINT AS doc_len FROM tf GROUP BY doc_id", ("tf",))
block("dfs", "SELECT term, count(*) AS df FROM tf GROUP BY term", ("tf",))
block("cs", f"SELECT count(*) AS n_docs, avg(len(regexp_extract_all(lower(text), {W}))) AS avg_len FROM documents")
block("qt", f"SELECT DISTINCT query_id, t AS term FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), {W})) AS t FROM benchmark)")


def bm25_block(name: str, terms: str) -> None:
    block(
        name,
        f"""SELECT query_id, doc_id AS item_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 /
          (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))), 6) AS score
          FROM {terms} JOIN tf USING (term) JOIN dl USING (doc_id) JOIN dfs USING (term) CROSS JOIN cs GROUP BY ALL""",
        ("tf", "dl", "dfs", "cs", terms),
    )


def rank_block(name: str, scores: str, k: int, needs: tuple[str, ...]) -> None:
    block(
        name,
        f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank
          FROM {scores}) WHERE rank <= {k}""",
        needs,
    )


bm25_block("bm", "qt")
rank_block("bm5", "bm", 5, ("bm",))
rank_block("bm20", "bm", 20, ("bm",))


def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def asked(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25_hits(spark, sf, k=5):
    return lexical.bm25_search(asked(spark, sf), docs(spark, sf), "doc_id", k)


@query("inverted_index", sql("SELECT term, doc_id, tf, doc_len, df FROM tf JOIN dl USING (doc_id) JOIN dfs USING (term)", "tf", "dl", "dfs"))
def _(spark, sf):
    return lexical.inverted_index(docs(spark, sf), "doc_id")


@query("bm25_stored", sql("SELECT * FROM bm5", "bm5"))
def _(spark, sf):
    """The same hits from a stored index: the postings of the terms asked for, and of those only what can matter."""
    path = fresh_path(spark, "postings")
    postings.store_postings(docs(spark, sf), "doc_id", path)
    return postings.search_postings(asked(spark, sf), path, 5)


@query("bm25_search", sql("SELECT * FROM bm5", "bm5"))
def _(spark, sf):
    return bm25_hits(spark, sf)


HYBRID = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (
    SELECT query_id, item_id, round(sum(p), 6) AS score FROM ({}) GROUP BY ALL)) WHERE rank <= 5"""


@query(
    "hybrid_search",
    sql(
        HYBRID.format("SELECT query_id, item_id, 1.0::DOUBLE / (60 + rank) AS p FROM doc20 UNION ALL SELECT query_id, item_id, 1.0::DOUBLE / (60 + rank) FROM bm20"),
        "doc20",
        "bm20",
    ),
)
def _(spark, sf):
    return lexical.hybrid_search(doc_hits(spark, sf, 20), bm25_hits(spark, sf, 20))


SCALED = """SELECT query_id, item_id, {w} * CASE WHEN max(score) OVER w > min(score) OVER w THEN
    (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END AS p FROM {t} WINDOW w AS (PARTITION BY query_id)"""


@query(
    "hybrid_search_weighted",
    sql(HYBRID.format(SCALED.format(w=0.7, t="doc20") + " UNION ALL " + SCALED.format(w=0.3, t="bm20")), "doc20", "bm20"),
)
def _(spark, sf):
    return lexical.hybrid_search(doc_hits(spark, sf, 20), bm25_hits(spark, sf, 20), weights={"dense": 0.7, "sparse": 0.3})


block(
    "xt",
    f"""SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, term) AS r FROM (
      SELECT query_id, term, round(count(*) * ln((SELECT count(*) FROM documents) / any_value(df)), 6) AS s FROM (
        SELECT DISTINCT query_id, item_id, t AS term FROM (SELECT query_id, item_id,
          unnest(regexp_extract_all(lower(text), {W})) AS t FROM bm5 JOIN documents ON doc_id = item_id))
      JOIN dfs USING (term) WHERE (query_id, term) NOT IN (SELECT (query_id, term) FROM qt) GROUP BY query_id, term) QUALIFY r <= 3""",
    ("bm5", "dfs", "qt"),
)
block("qx", "SELECT query_id, term FROM qt UNION SELECT query_id, term FROM xt", ("qt", "xt"))
bm25_block("bmx", "qx")
rank_block("bmx5", "bmx", 5, ("bmx",))


@query("query_expansion", sql("SELECT query_id, item_id, score, rank FROM bmx5", "bmx5"))
def _(spark, sf):
    wider = lexical.query_expansion(asked(spark, sf), docs(spark, sf), bm25_hits(spark, sf), "doc_id")
    return lexical.bm25_search(wider.select("query_id", "text"), docs(spark, sf), "doc_id", 5)


@query(
    "focus_sentences",
    sql(
        rf"""SELECT * FROM (SELECT query_id, item_id AS doc, pos, sentence, score, row_number() OVER (PARTITION BY query_id
          ORDER BY score DESC, item_id, pos) AS rank FROM (SELECT *, round(len(list_intersect(own, a)) / len(own)::DOUBLE, 6) AS score FROM (
          SELECT query_id, s.item_id, pos, sentence, list_distinct(regexp_extract_all(lower(sentence), {W})) AS own,
            list_distinct(regexp_extract_all(lower(text), {W})) AS a FROM (
            SELECT query_id, item_id, unnest(sentences) AS sentence, unnest(range(len(sentences))) AS pos FROM bm5 JOIN sn ON doc_id = item_id) s
            JOIN benchmark b ON b.item_id = query_id) WHERE len(own) > 0)) WHERE rank <= 3""",
        "bm5",
        "sn",
    ),
)
def _(spark, sf):
    return lexical.focus_sentences(asked(spark, sf), bm25_hits(spark, sf), docs(spark, sf), "doc_id")


@query(
    "content_query",
    "SELECT conv_id, turn, trim("
    + "regexp_replace(" * len(lexical.INSTRUCTIONS)
    + f"trim(replace(text, chr(10), ' '), '{BLANKS}')"
    + "".join(f", '(?i){r}', '')" for r in lexical.INSTRUCTIONS)
    + f", '{BLANKS}') AS text FROM conversations WHERE role = 'user'",
)
def _(spark, sf):
    users = table(spark, sf, "conversations").where("role = 'user'")
    return users.select("conv_id", "turn", lexical.content_query(F.col("text")).alias("text"))


@query(
    "hard_negatives",
    sql(
        f"""SELECT * FROM (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (
        SELECT query_id, doc_id AS item_id, count(*)::DOUBLE AS score FROM qt JOIN tf USING (term) GROUP BY ALL) s
        WHERE NOT EXISTS (SELECT 1 FROM ({QRELS_SQL}) p WHERE p.query_id = s.query_id AND p.item_id = s.item_id)) WHERE rank <= 5""",
        "qt",
        "tf",
    ),
)
def _(spark, sf):
    return lexical.hard_negatives(asked(spark, sf), docs(spark, sf), eval_triple(spark, sf)[2], "doc_id")


# ---- prompts --------------------------------------------------------------------------------

block(
    "hits",
    "SELECT query_id, rank, item_id, score, sentence_chunk, chunk_token_count FROM chunk5 JOIN big_ch ON chunk_id = item_id",
    ("chunk5",),
)
block("ctx", "SELECT query_id, string_agg('- ' || sentence_chunk, chr(10) ORDER BY rank) AS context FROM hits GROUP BY query_id", ("hits",))


def text_hits(spark, sf):
    chunks = big_chunks(spark, sf).select(F.col("chunk_id").alias("item_id"), "sentence_chunk", "chunk_token_count")
    return search.hits_with_text(chunk_hits(spark, sf), chunks)


@query("context_block", sql("SELECT * FROM ctx", "ctx"))
def _(spark, sf):
    return prompt.context_block(text_hits(spark, sf))


EXAMPLES = [
    ("Where do rivers start?", "Most start at a spring, a lake or melting ice, and grow as side streams join them."),
    ("Why do leaves change colour?", "Green pigment breaks down in autumn, so the yellow and red ones show."),
]
INSTRUCTION = "Use nothing but the sources below. Say so where they leave the matter open."
HEAD = (INSTRUCTION + "\n" + prompt.examples_text(EXAMPLES) + "\n" + prompt.SOURCES).replace("'", "''")
block(
    "pr",
    f"SELECT query_id, text AS query, context, '{HEAD}' || chr(10) || context || chr(10) || '{prompt.ASKED}' || chr(10) || text || chr(10) || '{prompt.REPLY}' AS prompt FROM ctx JOIN benchmark ON item_id = query_id",
    ("ctx",),
)


@query("build_prompt", sql("SELECT query_id, query, prompt FROM pr", "pr"))
def _(spark, sf):
    return prompt.build_prompt(asked(spark, sf), prompt.context_block(text_hits(spark, sf)), INSTRUCTION, EXAMPLES)


@query(
    "chat_template",
    """WITH c AS (SELECT *, turn // 3 AS segment, max(turn) OVER (PARTITION BY conv_id) // 3 AS final FROM conversations)
    SELECT conv_id, segment, string_agg('<start_of_turn>' || role || chr(10) || text || '<end_of_turn>' || chr(10), '' ORDER BY turn)
    || CASE WHEN segment = any_value(final) THEN '<start_of_turn>model' || chr(10) ELSE '' END AS text FROM c GROUP BY conv_id, segment""",
)
def _(spark, sf):
    """Three turns to a row, so that most conversations have several."""
    return prompt.chat_template(table(spark, sf, "conversations"), segment_turns=3)


@query(
    "strip_answer",
    """SELECT u.conv_id, u.turn, a.text AS answer FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
    WHERE u.role = 'user' AND a.role = 'assistant'""",
)
def _(spark, sf):
    """Echo each prompt in front of its answer with marks, then strip it again."""
    turns = table(spark, sf, "conversations")
    user = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    reply = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    echoed = F.concat(F.lit(prompt.BEGIN), F.col("prompt"), F.col("reply"), F.lit(prompt.END))
    return user.join(reply, ["conv_id", "turn"]).select("conv_id", "turn", prompt.strip_answer(echoed, F.col("prompt")).alias("answer"))


@query(
    "contrastive_examples",
    sql(
        """SELECT query_id, max_by(item_id, -rank) FILTER (WHERE quality = 1) AS good_example,
        max_by(item_id, -rank) FILTER (WHERE quality = 0) AS bad_example FROM (SELECT query_id, item_id, quality, row_number() OVER (
          PARTITION BY query_id, quality ORDER BY score DESC, item_id) AS rank FROM (SELECT q.k AS query_id, d.k AS item_id, quality,
          round(list_dot_product(q.vec, d.vec), 6) AS score FROM """ + BENCH + " q, " + DOCS + """ d JOIN labels ON doc_id = d.k))
        WHERE rank = 1 GROUP BY query_id""",
        BENCH,
        DOCS,
    ),
)
def _(spark, sf):
    """The nearest of either kind in the whole labelled pool."""
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("item_id"), F.col("quality").alias("correct"))
    return prompt.contrastive_examples(bench_vectors(spark, sf), doc_vectors(spark, sf), labels)


@query(
    "context_budget",
    sql(
        """SELECT query_id, rank, item_id, tokens_so_far FROM (SELECT *, sum(chunk_token_count) OVER (PARTITION BY query_id ORDER BY rank) AS tokens_so_far
        FROM hits) WHERE tokens_so_far <= 600""",
        "hits",
    ),
)
def _(spark, sf):
    return prompt.context_budget(text_hits(spark, sf), limit=600).select("query_id", "rank", "item_id", "tokens_so_far")


@query(
    "batch_ask",
    sql(
        rf"""SELECT query_id, query, arg_min(sentence, (s, pos)) AS answer FROM (
        SELECT query_id, query, pos, sentence, round(-len(list_intersect(own, a)) / greatest(len(own), 1)::DOUBLE, 6) AS s FROM (
        SELECT *, list_distinct(regexp_extract_all(lower(sentence), {W})) AS own, list_distinct(regexp_extract_all(lower(query), {W})) AS a FROM (
          SELECT query_id, query, unnest(x) AS sentence, unnest(range(len(x))) AS pos FROM (SELECT query_id, query,
            list_filter(string_split(regexp_replace(replace(regexp_replace(context, '(?m)^- ', '', 'g'), chr(10), ' '),
              '([.!?])[ \t\n\r\f]+', '\1' || chr(1), 'g'), chr(1)), lambda z: z <> '') AS x FROM pr)))) GROUP BY ALL""",
        "pr",
    ),
)
def _(spark, sf):
    return prompt.batch_ask(asked(spark, sf), text_hits(spark, sf), INSTRUCTION, examples=EXAMPLES)
