"""Registry: each entry is a query over the given tables and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from passagemill.functions.text import BLANKS
from passagemill.plans.skew import spread_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


# Result columns that are 32-bit in Spark, where the oracle's engine counts in 64 bits.
INTEGER_COLUMNS = {
    "load_pages": "page_number",
    "page_stats": "page_char_count page_word_count page_sentence_count_raw",
    "split_sentences": "n_sentences",
    "split_paragraphs": "pos",
    "group_sentences": "chunk_no group_size",
    "make_chunks": "chunk_no chunk_char_count chunk_word_count",
    "window_chunks": "window_no n_words",
    "min_token_filter": "chunk_no chunk_char_count chunk_word_count",
    "sample_per_group": "row_no",
    "first_n_per_deck": "row_no",
    "max_per_item": "row_no",
    "head_rows": "chunk_no chunk_char_count chunk_word_count",
    "l2_normalize": "pos",
    "embed_text": "pos",
    "knn_exact": "rank",
    "search_report": "rank",
    "hits_with_text": "rank",
    "hit_page_lookup": "rank page_chars",
    "cross_modal_knn": "rank",
    "expanded_query_vector": "rank",
    "rerank": "first_rank rank",
    "multi_store_search": "store_rank rank",
    "dynamic_k": "rank",
    "write_vectors_csv": "n",
    "read_vectors_csv": "pos",
    "write_vectors_parquet": "pos",
    "knn_lsh": "rank",
    "maxsim": "rank",
    "maxsim_rerank": "rank",
    "batch_encode": "pos",
    "late_chunk_pool": "span_no pos",
    "late_chunk_long": "span_no pos",
    "inverted_index": "doc_len",
    "bm25_search": "rank",
    "bm25_stored": "rank",
    "hybrid_search": "rank",
    "hybrid_search_weighted": "rank",
    "query_expansion": "rank",
    "focus_sentences": "pos rank",
    "hard_negatives": "rank",
    "context_budget": "rank",
    "local_search": "rank",
    "global_search": "rank",
    "dual_level_search": "rank",
    "organise_context": "position",
    "prune_paths": "rank position",
    "best_paths": "rank position",
    "graph_vector_search": "rank",
    "stream_chunks": "chunk_no chunk_char_count chunk_word_count",
}


def query(name: str, sql: str | None = None):
    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            casts = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in INTEGER_COLUMNS.get(name, "").split())
            ORACLES[name] = f"SELECT * REPLACE ({casts}) FROM ({sql})" if casts else sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread_out(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


# Named building blocks of the oracle SQL.
BLOCKS: dict[str, str] = {
    # text
    "pg": f"SELECT doc_id, 0 AS page_number, trim(replace(text, chr(10), ' '), '{BLANKS}') AS text FROM documents",
    "sn": r"""SELECT doc_id, page_number, text, list_filter(string_split(regexp_replace(text,
              '([.!?])[ \t\n\r\f]+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS sentences FROM pg""",
    "gr": """SELECT doc_id, page_number, unnest(range(0, CAST(ceil(len(sentences) / 10.0) AS BIGINT))) AS chunk_no,
             sentences FROM sn""",
    "ch0": rf"""SELECT doc_id, page_number, chunk_no, regexp_replace(trim(replace(array_to_string(
              list_slice(sentences, chunk_no * 10 + 1, chunk_no * 10 + 10), ''), '  ', ' '), '{BLANKS}'),
              '\.([A-Z0-9])', '. \1', 'g') AS sentence_chunk FROM gr""",
    "ch": """SELECT doc_id, page_number, chunk_no, sentence_chunk,
             doc_id || '-' || page_number || '-' || chunk_no AS chunk_id,
             length(sentence_chunk) AS chunk_char_count,
             len(string_split(sentence_chunk, ' ')) AS chunk_word_count,
             length(sentence_chunk) / 4.0::DOUBLE AS chunk_token_count FROM ch0""",
    "big_ch": "SELECT * FROM ch WHERE chunk_token_count > 30",
}
NEEDS: dict[str, tuple[str, ...]] = {
    "sn": ("pg",),
    "gr": ("sn",),
    "ch0": ("gr",),
    "ch": ("ch0",),
    "big_ch": ("ch",),
}


def block(name: str, sql: str, needs: tuple[str, ...] = ()) -> None:
    BLOCKS[name] = sql
    NEEDS[name] = needs


def _order(name: str, seen: list[str]) -> None:
    for need in NEEDS.get(name, ()):
        _order(need, seen)
    if name not in seen:
        seen.append(name)


def sql(body: str, *blocks: str, recursive: bool = False) -> str:
    """``body`` preceded by the named blocks and whatever they need, as common table expressions.

    A body that starts with a comma adds expressions of its own.
    """
    seen: list[str] = []
    for name in blocks:
        _order(name, seen)
    if not seen:
        return body
    head = "WITH RECURSIVE " if recursive else "WITH "
    head += ",\n".join(f"{n} AS ({BLOCKS[n]})" for n in seen)
    return head + body if body.startswith(",") else head + "\n" + body


def vector_block(prefix: str, source: str, key: str, text: str, needs: tuple[str, ...] = (), dim: int = 64) -> str:
    """Blocks for the default encoder over ``source``; returns the block holding (key, vec)."""
    block(
        f"{prefix}_b",
        rf"""SELECT k, b, 1 + ln(count(*)) AS w FROM (SELECT k, ('0x' || substr(md5(t), 1, 8))::BIGINT % {dim} AS b
          FROM (SELECT {key} AS k, unnest(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+')) AS t FROM {source}))
          GROUP BY k, b""",
        needs,
    )
    block(f"{prefix}_n", f"SELECT k, sqrt(sum(w * w)) AS nrm FROM {prefix}_b GROUP BY k", (f"{prefix}_b",))
    block(
        f"{prefix}_v",
        f"""SELECT s.{key} AS k, list(coalesce((w / nrm)::FLOAT, 0)::DOUBLE ORDER BY r.b) AS vec
          FROM (SELECT DISTINCT {key} FROM {source}) s CROSS JOIN (SELECT unnest(range(0, {dim})) AS b) r
          LEFT JOIN {prefix}_b x ON x.k = s.{key} AND x.b = r.b LEFT JOIN {prefix}_n n ON n.k = s.{key}
          GROUP BY s.{key}""",
        (f"{prefix}_b", f"{prefix}_n") + needs,
    )
    return f"{prefix}_v"
