import pandas as pd
from pyspark.sql import functions as F

from passagemill.operators import lexical, metrics, prompt


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_ranking_metrics_by_hand(spark):
    hits = frame(spark, [(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 20, 1), (3, 30, 1)], "query_id long, item_id long, rank int")
    qrels = frame(spark, [(1, 11, 1), (1, 99, 1), (2, 20, 1), (4, 40, 1)], "query_id long, item_id long, relevance int")
    rows = {r.query_id: r for r in metrics.per_query(hits, qrels, 3).collect()}
    assert set(rows) == {1, 2, 4}  # query 3 is not judged
    assert rows[1].recall == 0.5 and rows[1].mrr == 0.5 and round(rows[1].precision, 6) == 0.333333
    assert rows[2].ndcg == 1.0 and rows[2].hit1 == 1.0 and rows[4].recall == 0.0 and rows[4].mrr == 0.0
    sweep = {r.k: r.recall for r in metrics.sweep_eval(hits, qrels, (1, 2)).collect()}
    assert sweep == {1: 0.333333, 2: 0.5}


def test_answer_metrics(spark):
    pairs = frame(spark, [(1, "the cat sat", "The cat, sat!"), (2, "", "x"), (3, "a a b", "a b b")], "k long, got string, gold string")
    f1 = {r.k: r.f1 for r in metrics.token_f1(pairs, "k", "got", "gold").collect()}
    assert f1 == {1: 1.0, 2: 0.0, 3: 0.666667}
    assert metrics.exact_accuracy(pairs, "got", "gold").first().accuracy == 0.333333
    same = frame(spark, [(1, "one two three four five", "one two three four five")], "k long, got string, gold string")
    assert metrics.bleu(same, "k", "got", "gold").first().bleu == 1.0
    golds = frame(spark, [(1, "abcd"), (1, "abce"), (2, "zzzz")], "k long, gold string")
    got = frame(spark, [(1, "abcf"), (2, "abcd")], "k long, got string")
    assert metrics.anls(got, golds, "k", "got", "gold").first().anls == 0.375


def test_rank_fusion(spark):
    a = frame(spark, [(1, 5, 0.9, 1), (1, 6, 0.8, 2)], "query_id long, item_id long, score double, rank int")
    b = frame(spark, [(1, 6, 9.0, 1), (1, 7, 3.0, 2)], "query_id long, item_id long, score double, rank int")
    top = lexical.hybrid_search(a, b, 3).orderBy("rank").collect()
    assert [r.item_id for r in top] == [6, 5, 7] and top[0].score == round(1 / 61 + 1 / 62, 6)


def test_bm25_prefers_rare_words(spark):
    docs = frame(spark, [(1, "red apple"), (2, "green apple"), (3, "green pear tree")], "doc_id long, text string")
    asked = frame(spark, [(1, "red apple"), (2, "nothing")], "query_id long, text string")
    hits = lexical.bm25_search(asked, docs, "doc_id", 5).orderBy("rank").collect()
    assert [r.item_id for r in hits] == [1, 2] and {r.query_id for r in hits} == {1}


def test_prompt_and_answer_round_trip(spark):
    hits = frame(spark, [(1, 7, 0.9, 1, "Cats purr. Dogs bark."), (1, 8, 0.5, 2, "Fish swim.")], "query_id long, item_id long, score double, rank int, sentence_chunk string")
    asked = frame(spark, [(1, "what do dogs do"), (2, "no context")], "query_id long, text string")
    out = {r.query_id: r for r in prompt.batch_ask(asked, hits, "Use the sources.", return_answer_only=False).collect()}
    assert out[1].answer == "Dogs bark." and out[2].answer == ""
    assert "- Cats purr. Dogs bark.\n- Fish swim." in out[1].prompt and out[1]["items"][0].score == 0.9

    def load():
        return lambda prompts: [f"{prompt.BEGIN}{p}answer{prompt.END}" for p in prompts]

    plugged = prompt.batch_ask(asked, hits, "Use the sources.", generate=prompt.plug_in(load)).collect()
    assert {r.answer for r in plugged} == {"answer"}


def test_chat_segments_add_up(spark):
    turns = frame(spark, [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(7)], "conv_id long, turn long, role string, text string")
    whole = prompt.chat_template(turns).first().text
    pieces = prompt.chat_template(turns, segment_turns=3).orderBy("segment").collect()
    assert len(pieces) == 3 and "".join(p.text for p in pieces) == whole
    assert whole.endswith("<start_of_turn>model\n") and whole.count("<start_of_turn>") == 8


def test_context_budget_is_a_prefix(spark):
    hits = frame(spark, [(1, r, 50.0) for r in range(1, 6)], "query_id long, rank int, chunk_token_count double")
    assert [r["rank"] for r in prompt.context_budget(hits, limit=120).orderBy("rank").collect()] == [1, 2]


def test_query_words_are_kept(spark):
    df = pd.DataFrame({"query_id": [1], "text": ["alpha"]})
    docs = frame(spark, [(1, "alpha gamma delta"), (2, "alpha gamma"), (3, "omega")], "doc_id long, text string")
    asked = spark.createDataFrame(df)
    hits = lexical.bm25_search(asked, docs, "doc_id", 2)
    wider = lexical.query_expansion(asked, docs, hits, "doc_id", 1).first()
    assert wider.text.startswith("alpha ") and wider.added_terms in ("gamma", "delta")
    assert docs.select(lexical.content_query(F.lit("Answer the following: why"))).first()[0] == "why"
