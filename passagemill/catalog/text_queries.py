"""Sources, text functions, chunking, filters, sampling and corpus statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagemill.catalog.base import query, sql, table
from passagemill.functions import text as X
from passagemill.functions.text import BLANKS
from passagemill.operators import chunk, curate, summary
from passagemill.plans.session import cut_lineage
from passagemill.sources import corpus

CHUNK_COLUMNS = ("doc_id", "page_number", "chunk_no", "sentence_chunk", "chunk_char_count", "chunk_word_count", "chunk_token_count")


def doc_pages(spark, sf):
    return corpus.load_pages(table(spark, sf, "documents"), "doc_id", "text")


def turn_pages(spark, sf):
    return corpus.load_pages(table(spark, sf, "conversations"), "conv_id", "text", "turn")


def doc_chunks(spark, sf):
    return chunk.make_chunks(doc_pages(spark, sf))


# ---- sources --------------------------------------------------------------------------------


@query(
    "load_pages",
    f"""SELECT doc_id, 0 AS page_number, trim(replace(text, chr(10), ' '), '{BLANKS}') AS text FROM documents
    UNION ALL SELECT conv_id, turn - 41, trim(replace(text, chr(10), ' '), '{BLANKS}') FROM conversations""",
)
def _(spark, sf):
    turns = corpus.load_pages(table(spark, sf, "conversations"), "conv_id", "text", "turn", page_offset=41)
    return doc_pages(spark, sf).unionByName(turns)


@query(
    "html_page_text",
    rf"""SELECT page_id, trim(regexp_replace(
      replace(replace(replace(replace(replace(replace(
      regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
        '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'),
        '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
      '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'),
      '[ \t\n\r\f]+', ' ', 'g'), '{BLANKS}') AS text FROM pages""",
)
def _(spark, sf):
    return corpus.html_page_text(table(spark, sf, "pages"))


def eval_triple(spark, sf):
    """Corpus = documents, queries = benchmark passages, judgements = containment."""
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    return corpus.load_eval_triple(
        docs.select(F.col("doc_id").alias("item_id"), "text"),
        bench.select(F.col("item_id").alias("query_id"), "text"),
        cut_lineage(curate.build_qrels(bench, docs), "qrels"),
    )


QRELS_SQL = """SELECT b.item_id AS query_id, d.doc_id AS item_id, 1 AS relevance
    FROM benchmark b JOIN documents d ON contains(d.text, b.text)"""


@query(
    "load_eval_triple",
    f"""WITH qrels AS ({QRELS_SQL}) SELECT 'corpus' AS part, doc_id AS id, length(text) AS n FROM documents
    UNION ALL SELECT 'queries', item_id, length(text) FROM benchmark
    UNION ALL SELECT 'qrels', query_id, count(*) FROM qrels GROUP BY query_id""",
)
def _(spark, sf):
    items, queries, qrels = eval_triple(spark, sf)
    return (
        items.select(F.lit("corpus").alias("part"), F.col("item_id").alias("id"), F.length("text").cast("long").alias("n"))
        .unionByName(queries.select(F.lit("queries").alias("part"), F.col("query_id").alias("id"), F.length("text").cast("long").alias("n")))
        .unionByName(qrels.groupBy(F.lit("qrels").alias("part"), F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("n")))
    )


@query("build_qrels", QRELS_SQL)
def _(spark, sf):
    return eval_triple(spark, sf)[2]


QA_SQL = """WITH qa AS (SELECT u.conv_id || ':' || u.turn AS query_id, u.text AS query, a.conv_id || ':' || a.turn AS item, a.text AS passage
      FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
      WHERE u.role = 'user' AND a.role = 'assistant')"""


def question_answer(spark, sf):
    """User turns with the assistant turn that follows them."""
    turns = table(spark, sf, "conversations")
    user = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    reply = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("passage"))
    return user.join(reply, ["conv_id", "turn"]).select(
        F.concat_ws(":", "conv_id", "turn").alias("query_id"), "query", F.concat_ws(":", F.col("conv_id"), F.col("turn") + 1).alias("item"), "passage"
    )


@query(
    "load_qa_dataset",
    QA_SQL
    + """SELECT 'queries' AS part, query_id AS id, query AS text FROM qa
    UNION ALL SELECT DISTINCT 'corpus', item, passage FROM qa
    UNION ALL SELECT DISTINCT 'qrels', query_id, item FROM qa""",
)
def _(spark, sf):
    items, queries, qrels = corpus.load_qa_dataset(question_answer(spark, sf), "query_id", "query", "item", "passage")
    return (
        queries.select(F.lit("queries").alias("part"), F.col("query_id").alias("id"), "text")
        .unionByName(items.select(F.lit("corpus").alias("part"), F.col("item_id").alias("id"), "text"))
        .unionByName(qrels.select(F.lit("qrels").alias("part"), F.col("query_id").alias("id"), F.col("item_id").alias("text")))
    )


@query("load_collection", "SELECT source AS dataset, count(*) AS n_items, max(n_chars) AS longest FROM documents GROUP BY source")
def _(spark, sf):
    docs = corpus.load_collection(table(spark, sf, "documents"), "source")
    return docs.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_items"), F.max("n_chars").alias("longest"))


# ---- text and chunks ------------------------------------------------------------------------


@query("format_text", sql("SELECT doc_id, text FROM pg", "pg"))
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.format_text(F.col("text")).alias("text"))


@query(
    "page_stats",
    sql(
        """SELECT doc_id, length(text) AS page_char_count, len(string_split(text, ' ')) AS page_word_count,
        len(string_split(text, '. ')) AS page_sentence_count_raw, length(text) / 4.0::DOUBLE AS page_token_count FROM pg""",
        "pg",
    ),
)
def _(spark, sf):
    return chunk.page_stats(doc_pages(spark, sf)).drop("text", "page_number")


@query("split_sentences", sql("SELECT doc_id, len(sentences) AS n_sentences, array_to_string(sentences, '|') AS joined FROM sn", "sn"))
def _(spark, sf):
    out = chunk.split_sentences(doc_pages(spark, sf))
    return out.select("doc_id", F.col("page_sentence_count").alias("n_sentences"), F.array_join("sentences", "|").alias("joined"))


@query(
    "split_paragraphs",
    rf"""SELECT doc_id, unnest(p) AS paragraph, unnest(range(len(p))) AS pos FROM (SELECT doc_id, list_filter(list_transform(
    string_split(regexp_replace(text, '\n+', chr(10), 'g'), chr(10)), lambda x: trim(x, '{BLANKS}')), lambda x: x <> '') AS p
    FROM documents)""",
)
def _(spark, sf):
    out = chunk.split_paragraphs(table(spark, sf, "documents"))
    rows = out.select("doc_id", F.posexplode_outer("paragraphs").alias("pos", "paragraph"))
    return rows.where("paragraph IS NOT NULL")


@query(
    "group_sentences",
    sql("SELECT doc_id, chunk_no, len(list_slice(sentences, chunk_no * 10 + 1, chunk_no * 10 + 10)) AS group_size FROM gr", "gr"),
)
def _(spark, sf):
    out = chunk.group_sentences(chunk.split_sentences(doc_pages(spark, sf)))
    rows = out.select("doc_id", F.posexplode_outer("sentence_chunks").alias("chunk_no", "g")).where("g IS NOT NULL")
    return rows.select("doc_id", "chunk_no", F.size("g").alias("group_size"))


CHUNK_LIST = ", ".join(CHUNK_COLUMNS)


@query("make_chunks", sql(f"SELECT {CHUNK_LIST} FROM ch", "ch"))
def _(spark, sf):
    return doc_chunks(spark, sf).select(*CHUNK_COLUMNS)


@query(
    "window_chunks",
    sql(
        """SELECT doc_id, i // 50 AS window_no, array_to_string(list_slice(w, i + 1, i + 100), ' ') AS window_text,
        len(list_slice(w, i + 1, i + 100)) AS n_words
        FROM (SELECT doc_id, string_split(text, ' ') AS w, unnest(range(0, greatest(1, len(string_split(text, ' ')) - 50), 50)) AS i FROM pg)""",
        "pg",
    ),
)
def _(spark, sf):
    return chunk.window_chunks(doc_pages(spark, sf), ["doc_id"])


@query("min_token_filter", sql(f"SELECT {CHUNK_LIST} FROM big_ch", "big_ch"))
def _(spark, sf):
    return chunk.min_token_filter(doc_chunks(spark, sf)).select(*CHUNK_COLUMNS)


@query(
    "short_chunk_sample",
    sql(
        """SELECT chunk_id, sentence_chunk, chunk_token_count FROM ch WHERE chunk_token_count <= 30
        ORDER BY md5('short|' || chunk_id), chunk_id LIMIT 5""",
        "ch",
    ),
)
def _(spark, sf):
    return chunk.short_chunk_sample(doc_chunks(spark, sf)).select("chunk_id", "sentence_chunk", "chunk_token_count")


# ---- filters --------------------------------------------------------------------------------


@query("caption_filter", "SELECT conv_id, turn, text FROM conversations WHERE len(string_split(text, ' ')) >= 5")
def _(spark, sf):
    return curate.caption_filter(table(spark, sf, "conversations")).select("conv_id", "turn", "text")


@query(
    "image_meta_filter",
    """WITH m AS (SELECT doc_id, n_chars AS width, 1 + (doc_id * 7919) % 1400 AS height FROM documents)
    SELECT * FROM m WHERE least(width, height) >= 224 AND greatest(width, height) <= least(width, height) * 100
    AND width * height <= 10000000""",
)
def _(spark, sf):
    meta = table(spark, sf, "documents").select(
        "doc_id", F.col("n_chars").alias("width"), (1 + (F.col("doc_id") * 7919) % 1400).alias("height")
    )
    return curate.image_meta_filter(meta, max_pixels=10_000_000)


@query(
    "metadata_type_filter",
    "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality IN (1))",
)
def _(spark, sf):
    return curate.metadata_type_filter(
        table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id", "quality", [1]
    ).select("doc_id", "source")


PII_SQL = " OR ".join(f"regexp_matches(text, '{p}')" for p in curate.PRIVATE)


@query("pii_document_filter", f"SELECT doc_id FROM documents WHERE NOT ({PII_SQL})")
def _(spark, sf):
    return curate.pii_document_filter(table(spark, sf, "documents")).select("doc_id")


@query("language_eligibility", "SELECT doc_id, lang FROM documents WHERE lang = 'en' AND len(string_split(text, ' ')) >= 50")
def _(spark, sf):
    return curate.language_eligibility(table(spark, sf, "documents")).select("doc_id", "lang")


@query(
    "low_overlap_filter",
    QA_SQL
    + r""", s AS (SELECT query_id, list_distinct(regexp_extract_all(lower(query), '[\p{L}\p{N}]+')) AS a,
      list_distinct(regexp_extract_all(lower(passage), '[\p{L}\p{N}]+')) AS b FROM qa),
    o AS (SELECT query_id, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE AS overlap FROM s WHERE a IS NOT NULL AND b IS NOT NULL)
    SELECT query_id, round(overlap, 6) AS overlap FROM o WHERE overlap <= 0.1""",
)
def _(spark, sf):
    out = curate.low_overlap_filter(question_answer(spark, sf), "query", "passage")
    return out.select("query_id", F.round("overlap", 6).alias("overlap"))


DEICTIC_SQL = ", ".join(f"'{w}'" for w in curate.DEICTIC)


@query(
    "self_sufficient_filter",
    rf"""SELECT conv_id, turn, text FROM conversations WHERE role = 'user' AND len(string_split(text, ' ')) >= 5
    AND NOT list_has_any(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), [{DEICTIC_SQL}])""",
)
def _(spark, sf):
    users = table(spark, sf, "conversations").where("role = 'user'")
    return curate.self_sufficient_filter(users).select("conv_id", "turn", "text")


# ---- aggregation, sampling, sets ------------------------------------------------------------

STAT_COLUMNS = ["chunk_char_count", "chunk_word_count", "chunk_token_count"]
_STATS = " UNION ALL ".join(
    f"""SELECT '{c}' AS metric, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min,
    quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75, max({c}) AS max FROM ch"""
    for c in STAT_COLUMNS
)


@query(
    "describe_numeric",
    sql(
        "SELECT metric, count, "
        + ", ".join(f"round_even({c}::DOUBLE, 2)::DOUBLE AS {c}" for c in ("mean", "std", "min", "q25", "q50", "q75", "max"))
        + f" FROM ({_STATS})",
        "ch",
    ),
)
def _(spark, sf):
    return summary.describe_numeric(doc_chunks(spark, sf), STAT_COLUMNS)


@query(
    "corpus_counts",
    sql(
        """SELECT 'pages' AS table_name, count(*) AS n FROM pg UNION ALL SELECT 'chunks', count(*) FROM ch
        UNION ALL SELECT 'kept_chunks', count(*) FROM big_ch""",
        "pg",
        "ch",
        "big_ch",
    ),
)
def _(spark, sf):
    chunks = doc_chunks(spark, sf)
    return summary.corpus_counts(pages=doc_pages(spark, sf), chunks=chunks, kept_chunks=chunk.min_token_filter(chunks))


@query(
    "corpus_shape",
    """WITH p AS (SELECT conv_id, sum(len(string_split(text, ' '))) AS w, count(*) AS n FROM conversations GROUP BY conv_id)
    SELECT count(*) AS n_docs, round(avg(w), 6) AS avg_words, round(avg(n), 6) AS avg_pages, max(w)::BIGINT AS max_words, max(n) AS max_pages FROM p""",
)
def _(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", X.word_count(F.col("text")).alias("words"))
    return summary.corpus_shape(turns, "conv_id", "words")


@query("sample_k", "SELECT doc_id, source FROM documents ORDER BY md5('sample|' || doc_id), doc_id LIMIT 3")
def _(spark, sf):
    return curate.sample_k(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", 3)


@query(
    "sample_per_group",
    """SELECT source, doc_id, row_no FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source
    ORDER BY md5('sample|' || doc_id), doc_id) AS row_no FROM documents) WHERE row_no <= 4""",
)
def _(spark, sf):
    return curate.sample_per_group(table(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id", 4)


@query(
    "first_n_per_deck",
    """SELECT conv_id, turn, row_no, deck_parts FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS row_no,
    count(*) OVER (PARTITION BY conv_id) AS deck_parts FROM conversations) WHERE deck_parts > 4 AND row_no <= 4""",
)
def _(spark, sf):
    return curate.first_n_per_deck(table(spark, sf, "conversations").select("conv_id", "turn"), "conv_id", "turn", 4)


@query(
    "max_per_item",
    """SELECT conv_id, turn, row_no FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS row_no
    FROM conversations WHERE role = 'user') WHERE row_no <= 2""",
)
def _(spark, sf):
    users = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn")
    return curate.max_per_item(users, "conv_id", "turn", 2)


@query(
    "group_disjoint_split",
    """SELECT conv_id, turn, CASE WHEN h < 80 THEN 'train' WHEN h < 90 THEN 'dev' ELSE 'test' END AS split
    FROM (SELECT conv_id, turn, ('0x' || substr(md5('split|' || conv_id), 1, 8))::BIGINT % 100 AS h FROM conversations)""",
)
def _(spark, sf):
    return curate.group_disjoint_split(table(spark, sf, "conversations").select("conv_id", "turn"), "conv_id")


@query("head_rows", sql(f"SELECT {CHUNK_LIST} FROM ch ORDER BY doc_id, page_number, chunk_no LIMIT 5", "ch"))
def _(spark, sf):
    return curate.head_rows(doc_chunks(spark, sf), ["doc_id", "page_number", "chunk_no"]).select(*CHUNK_COLUMNS)


@query(
    "union_queries",
    """SELECT 'benchmark' AS source, CAST(item_id AS VARCHAR) AS query_id, text FROM benchmark UNION ALL
    SELECT 'conversations', conv_id || ':' || turn, text FROM conversations WHERE role = 'user'""",
)
def _(spark, sf):
    bench = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    users = table(spark, sf, "conversations").where("role = 'user'")
    return curate.union_queries(benchmark=bench, conversations=users.select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), "text"))


@query(
    "question_type_matrix",
    """SELECT event_type, count(*) FILTER (WHERE size = 'low') AS low, count(*) FILTER (WHERE size = 'mid') AS mid,
    count(*) FILTER (WHERE size = 'high') AS high
    FROM (SELECT event_type, CASE WHEN value < 20 THEN 'low' WHEN value < 80 THEN 'mid' ELSE 'high' END AS size FROM events) GROUP BY event_type""",
)
def _(spark, sf):
    size = F.when(F.col("value") < 20, "low").when(F.col("value") < 80, "mid").otherwise("high")
    events = table(spark, sf, "events").select("event_type", size.alias("size"))
    return summary.question_type_matrix(events, "event_type", "size", ["low", "mid", "high"])


@query(
    "scenario_accuracy",
    """SELECT CASE WHEN grouping(source) = 1 THEN '(all)' ELSE source END AS scenario, count(*) AS n,
    round(avg(quality), 6) AS accuracy FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (source)""",
)
def _(spark, sf):
    joined = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return summary.scenario_accuracy(joined, "source", "quality")


@query(
    "exact_dedup",
    "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
)
def _(spark, sf):
    return curate.exact_dedup(table(spark, sf, "documents"), "doc_id")


# ---- joins ----------------------------------------------------------------------------------


@query(
    "page_neighbours",
    """SELECT conv_id, turn, (p IS NOT NULL)::INT + (n IS NOT NULL)::INT AS n_neighbours,
    concat_ws(chr(10), p, n) AS noise_context FROM (SELECT conv_id, turn, lag(text) OVER w AS p, lead(text) OVER w AS n
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))""",
)
def _(spark, sf):
    return curate.page_neighbours(table(spark, sf, "conversations"), "conv_id", "turn", "text")


@query(
    "bridge_pairs",
    r"""WITH e AS (SELECT DISTINCT conv_id, role, t AS entity FROM (SELECT conv_id, role,
      unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS t FROM conversations)),
    p AS (SELECT a.entity, a.conv_id AS one, q.conv_id AS other FROM e a JOIN e q ON a.entity = q.entity AND a.conv_id <> q.conv_id
      WHERE a.role = 'assistant' AND q.role = 'user')
    SELECT DISTINCT entity, CASE role WHEN 'user' THEN 'question' ELSE 'answer' END AS side, conv_id AS question_id
    FROM e WHERE role IN ('user', 'assistant') AND entity IN (SELECT entity FROM p)""",
)
def _(spark, sf):
    words = (
        table(spark, sf, "conversations")
        .select(F.col("conv_id").alias("question_id"), "role", F.explode(X.tokens(F.col("text"))).alias("entity"))
    )
    return curate.bridge_pairs(words.where("role = 'assistant'"), words.where("role = 'user'"))


ANNOTATIONS_SQL = """a AS (SELECT doc_id AS item_id, quality AS answer FROM labels WHERE toxic = 0 OR quality = 1),
    b AS (SELECT doc_id AS item_id, CASE WHEN md5(CAST(doc_id AS VARCHAR)) LIKE '0%' THEN 1 - quality ELSE quality END AS answer
          FROM labels WHERE toxic = 0 OR quality = 0)"""


def annotations(spark, sf):
    """Annotator A has the label; B flips it for about one document in sixteen; each skips some."""
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "item_id")
    flipped = F.when(F.md5(F.col("item_id").cast("string")).startswith("0"), 1 - F.col("quality")).otherwise(F.col("quality"))
    a = labels.where("toxic = 0 OR quality = 1").select("item_id", F.col("quality").alias("answer"))
    b = labels.where("toxic = 0 OR quality = 0").select("item_id", flipped.alias("answer"))
    return a, b


@query(
    "agreement_join",
    f"""WITH {ANNOTATIONS_SQL} SELECT item_id, CAST(a.answer AS VARCHAR) AS answer_a, CAST(b.answer AS VARCHAR) AS answer_b,
    CASE WHEN a.answer IS NULL OR b.answer IS NULL THEN 'single' WHEN a.answer = b.answer THEN 'agreed' ELSE 'review' END AS status
    FROM a FULL JOIN b USING (item_id)""",
)
def _(spark, sf):
    return curate.agreement_join(*annotations(spark, sf))


TEMPLATES = [
    (1, "Which region does {nation} belong to?"),
    (2, "Is {nation} part of {region}?"),
    (3, "How many customers come from {nation}?"),
    (4, "Name a supplier located in {nation}."),
    (5, "Which nations share the region {region}?"),
]


@query(
    "template_instances",
    " UNION ALL ".join(
        f"""SELECT {i} AS template_id, n_nationkey, replace(replace('{t}', '{{nation}}', n_name), '{{region}}', r_name) AS question
        FROM nation JOIN region ON n_regionkey = r_regionkey"""
        for i, t in TEMPLATES
    ),
)
def _(spark, sf):
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = curate.template_instances(rows, TEMPLATES, {"nation": "n_name", "region": "r_name"})
    return out.select("template_id", "n_nationkey", "question")
