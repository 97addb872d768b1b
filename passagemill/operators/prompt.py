"""Prompt assembly and batch answering."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.functions import text as X
from passagemill.operators.search import DIGITS, knn_exact

BEGIN, END = "<bos>", "<eos>"
TURN_START, TURN_STOP = "<start_of_turn>", "<end_of_turn>"
SOURCES, ASKED, REPLY = "### Sources", "### Asked", "### Reply"


def context_block(hits: DataFrame, text: str = "sentence_chunk") -> DataFrame:
    """One bullet list per query in rank order; a query has at most k hits."""
    lines = F.array_sort(F.collect_list(F.struct("rank", F.col(text).alias("line"))))
    return hits.groupBy("query_id").agg(
        F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x["line"])), "\n").alias("context")
    )


def context_budget(hits: DataFrame, tokens: str = "chunk_token_count", limit: float = 200) -> DataFrame:
    """Hits in rank order while the running token sum fits; the window spans one query's k hits."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hits.withColumn("tokens_so_far", F.sum(tokens).over(w)).where(F.col("tokens_so_far") <= limit)


def examples_text(examples: list[tuple[str, str]]) -> str:
    """Solved cases in the layout of the prompt itself, so that the open one ends the same series."""
    return "\n".join(f"{ASKED}\n{q}\n{REPLY}\n{a}" for q, a in examples)


def prompt_text(context: Column, query: Column, instruction: str, examples: list[tuple[str, str]] | None = None) -> Column:
    parts = [F.lit(instruction)]
    if examples:
        parts.append(F.lit(examples_text(examples)))
    parts += [F.lit(SOURCES), context, F.lit(ASKED), query, F.lit(REPLY)]
    return F.concat_ws("\n", *parts)


def build_prompt(
    queries: DataFrame, contexts: DataFrame, instruction: str, examples: list[tuple[str, str]] | None = None
) -> DataFrame:
    """(query_id, query, prompt). The instruction is the caller's; an unanswered query has an empty context."""
    joined = queries.select("query_id", F.col("text").alias("query")).join(contexts, "query_id", "left")
    context = F.coalesce("context", F.lit(""))
    return joined.select("query_id", "query", prompt_text(context, F.col("query"), instruction, examples).alias("prompt"))


def chat_template(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    start: str = TURN_START,
    stop: str = TURN_STOP,
    generation_role: str | None = "model",
    segment_turns: int = 1024,
) -> DataFrame:
    """Messages as one marked-up string per conversation.

    The result has a row for every ``segment_turns`` turns of a conversation, numbered by ``segment``
    (turn div ``segment_turns``), so that no row holds an unbounded text; the segments put together in
    order are the whole string. The generation prefix follows the last turn only.
    """
    message = F.concat(F.lit(start), F.col("role"), F.lit("\n"), F.col("text"), F.lit(stop + "\n"))
    rows = turns.select(conv, F.floor(F.col(turn) / segment_turns).alias("segment"), F.struct(F.col(turn).alias("turn"), message.alias("m")).alias("x"))
    parts = rows.groupBy(conv, "segment").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["m"]), "").alias("text"))
    if generation_role is None:
        return parts
    ends = turns.groupBy(conv).agg(F.floor(F.max(turn) / segment_turns).alias("last_segment"))
    prefix = F.when(F.col("segment") == F.col("last_segment"), F.lit(f"{start}{generation_role}\n")).otherwise("")
    return parts.join(ends, conv).select(conv, "segment", F.concat("text", prefix).alias("text"))


def typed_text(parts: Column, image: str = "<image>") -> Column:
    """Text of a message given as parts, array<struct<type, text>>: texts as they are, a mark for an image."""
    shown = F.transform(parts, lambda p: F.when(p["type"] == "image", F.lit(image)).otherwise(F.coalesce(p["text"], F.lit(""))))
    return F.array_join(shown, "\n")


def as_chat(prompt: Column, role: str = "user", generation_role: str = "model", start: str = TURN_START, stop: str = TURN_STOP) -> Column:
    """A prompt as a conversation of one message that the model is to continue."""
    return F.concat(F.lit(f"{start}{role}\n"), prompt, F.lit(f"{stop}\n{start}{generation_role}\n"))


def strip_answer(output: Column, prompt: Column, marks: tuple[str, ...] = (BEGIN, END)) -> Column:
    """Model output without the echoed prompt and the begin / end marks."""
    out = F.replace(output, prompt, F.lit(""))
    for mark in marks:
        out = F.replace(out, F.lit(mark), F.lit(""))
    return out


def contrastive_examples(queries: DataFrame, pool: DataFrame, labels: DataFrame) -> DataFrame:
    """Per query the nearest correct and the nearest incorrect example of the whole labelled pool.

    ``pool(item_id, vec)``, ``labels(item_id, correct)`` with 1 and 0. One pass over the pool keeps the best of
    either kind; a kind that the pool lacks is NULL.
    """
    marked = pool.select("item_id", "vec").join(labels.where("correct IN (0, 1)").select("item_id", "correct"), "item_id")
    nearest = knn_exact(queries, marked, 1, lane="correct")

    def of(flag: int) -> Column:
        return F.max(F.when(F.col("correct") == flag, F.col("item_id")))

    return nearest.groupBy("query_id").agg(of(1).alias("good_example"), of(0).alias("bad_example"))


# ---- answering ------------------------------------------------------------------------------

Generator = Callable[[pd.Series], list[str]]


def plug_in(load: Callable[[], Generator]) -> Callable[[DataFrame], Column]:
    """Turn a batch text generator into a prompt -> output column; it is loaded once per worker."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        generate = load()
        for part in parts:
            yield pd.Series(generate(part), dtype=object)

    return run


def best_sentence(context: Column, query: Column) -> Column:
    """Default answer: the context sentence sharing the largest part of its words with the query."""
    asked = F.array_distinct(X.tokens(query))
    bullets = F.regexp_replace(context, r"(?m)^- ", "")
    scored = F.transform(
        X.sentences(F.replace(bullets, F.lit("\n"), F.lit(" "))),
        lambda s, i: F.struct(
            F.round(
                -F.size(F.array_intersect(F.array_distinct(X.tokens(s)), asked))
                / F.greatest(F.size(F.array_distinct(X.tokens(s))), F.lit(1)),
                DIGITS,
            ).alias("order"),
            i.alias("pos"),
            s.alias("sentence"),
        ),
    )
    return F.coalesce(F.array_min(scored)["sentence"], F.lit(""))


def batch_ask(
    queries: DataFrame,
    hits: DataFrame,
    instruction: str,
    text: str = "sentence_chunk",
    generate: Callable[[Column], Column] | None = None,
    examples: list[tuple[str, str]] | None = None,
    return_answer_only: bool = True,
    format_answer_text: bool = True,
    chat: bool = True,
) -> DataFrame:
    """Answer a table of queries from their hits.

    A plugged-in generator gets the prompt as a chat (``chat=False``: bare); without one the answer is
    extracted from the context. ``format_answer_text=False`` returns the output as it came, with echo and
    marks. ``return_answer_only=False`` also returns the prompt and the context items with their scores.
    """
    contexts = context_block(hits, text)
    prompts = build_prompt(queries, contexts, instruction, examples).join(contexts, "query_id", "left")
    if chat:
        prompts = prompts.withColumn("prompt", as_chat(F.col("prompt")))
    if generate is None:
        echoed = F.concat(F.lit(BEGIN), F.col("prompt"), best_sentence(F.coalesce("context", F.lit("")), F.col("query")), F.lit(END))
    else:
        echoed = generate(F.col("prompt"))
    answered = prompts.withColumn("answer", strip_answer(echoed, F.col("prompt")) if format_answer_text else echoed)
    if return_answer_only:
        return answered.select("query_id", "query", "answer")
    used = hits.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "item_id", "score", F.col(text).alias("text")))).alias("items")
    )
    return answered.join(used, "query_id", "left").select("query_id", "query", "answer", "prompt", "items")
