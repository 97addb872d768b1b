import pytest
from pyspark.sql import functions as F

from passagemill.functions import text as X
from passagemill.operators import chunk, curate, summary
from passagemill.sources import corpus, stores


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_three_sentences(spark):
    text = "Rain fell all night. The river rose! Who closed the gate?"
    assert len(one(spark, text, X.sentences)) == 3


def test_groups_of_ten(spark):
    sizes = one(spark, list(range(25)), lambda c: F.transform(X.grouped(c, 10), F.size), "array<int>")
    assert sizes == [10, 10, 5]
    assert one(spark, [], lambda c: X.grouped(c, 10), "array<int>") == []
    assert one(spark, None, lambda c: X.grouped(c, 10), "array<int>") is None


def test_counts_are_split_counts(spark):
    for text in ("", " ", "a b", "a  b ", "One. Two. ", "x.y", "tail. "):
        assert one(spark, text, X.word_count) == len(text.split(" "))
        assert one(spark, text, X.raw_sentence_count) == len(text.split(". "))
        assert one(spark, text, X.token_count) == len(text) / 4


def test_format_strips_like_python(spark):
    for text in ("\ta\nb\n", " x ", "  ", "\r\nq\x0b", "é\n\nü "):
        assert one(spark, text, X.format_text) == text.replace("\n", " ").strip()


def test_chunk_repair(spark):
    group = ["Pi is 3.14.", "Next one?", "Then  this   here.", "End."]
    got = one(spark, group, lambda c: X.joined_chunk(c), "array<string>")
    assert got == "Pi is 3. 14. Next one?Then this  here. End."
    spaced = one(spark, group, lambda c: X.joined_chunk(c, " "), "array<string>")
    assert spaced == "Pi is 3. 14. Next one? Then this  here. End."


def test_chunks_stay_on_their_page(spark):
    rows = [(1, 0, ". ".join(f"S{i} word" for i in range(25)) + "."), (1, 1, "Only one."), (2, 0, ""), (3, 0, None)]
    pages = spark.createDataFrame(rows, "doc_id long, page_number int, text string")
    got = chunk.make_chunks(pages).groupBy("doc_id", "page_number").count().collect()
    assert {(r[0], r[1]): r[2] for r in got} == {(1, 0): 3, (1, 1): 1}


def test_min_token_filter_partitions_the_table(spark):
    rows = [(i, 0, i, "x" * n, f"{i}", n / 4) for i, n in enumerate((119, 120, 121, 0, 500))]
    chunks = spark.createDataFrame(rows, "doc_id long, page_number int, chunk_no int, sentence_chunk string, chunk_id string, chunk_token_count double")
    kept = {r.doc_id for r in chunk.min_token_filter(chunks).collect()}
    short = {r.doc_id for r in chunk.short_chunk_sample(chunks, k=100).collect()}
    assert kept == {2, 4} and short == {0, 1, 3}


def test_windows_cover_all_words(spark):
    for n in (1, 9, 10, 11, 15, 16, 40):
        words = [f"w{i}" for i in range(n)]
        df = spark.createDataFrame([(1, " ".join(words))], "id long, text string")
        rows = chunk.window_chunks(df, ["id"], size=10, stride=5).orderBy("window_no").collect()
        seen = [r.window_text.split(" ") for r in rows]
        assert sorted({w for s in seen for w in s}) == sorted(words)
        assert all(set(b) - set(a) for a, b in zip(seen, seen[1:]))


def test_html(spark):
    html = "<html><style>p{}</style><!-- no --><p>a &lt;b&gt; &amp;amp; c</p><script>x<y</script>&nbsp;d</html>"
    assert one(spark, html, corpus.html_text) == "a <b> &amp; c d"


def test_page_offset_round_trip(spark):
    df = spark.createDataFrame([(1, 41, " a\n")], "d long, n int, t string")
    row = corpus.load_pages(df, "d", "t", "n", page_offset=41).first()
    assert (row.page_number, row.text) == (0, "a")


def test_describe_matches_pandas(spark):
    values = [1.0, 2.0, 2.0, 3.5, 10.0, 7.25]
    df = spark.createDataFrame([(v,) for v in values], "a double")
    got = summary.describe_numeric(df, ["a"]).first()
    want = df.toPandas()["a"].describe().round(2)
    assert [got[c] for c in ("count", "mean", "std", "min", "q25", "q50", "q75", "max")] == list(want)
    assert summary.describe_numeric(df.repartition(3), ["a"]).first() == got
    near = summary.describe_numeric(df, ["a"], approximate=True).first()
    assert near["count"] == 6 and near["max"] == 10.0


def test_ranged_quartiles_with_a_dominant_value(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") * 1.5).alias("a"), (F.col("id") % 7).alias("b"))
    got = summary.describe_numeric(df, ["a", "b"]).orderBy("metric").collect()
    want = df.toPandas().describe().round(2)
    for r in got:
        assert [r[c] for c in ("count", "mean", "std", "min", "q25", "q50", "q75", "max")] == pytest.approx(list(want[r["metric"]]))


def test_deviation_of_large_values(spark):
    df = spark.range(1000).select((F.col("id") + 1_700_000_000_000).cast("double").alias("a"))
    assert summary.describe_numeric(df, ["a"]).first()["std"] == 288.82


def test_csv_keeps_line_ends(spark, tmp_path):
    rows = [(1, "a\nb\\n\r\\", [1.5, -2.0]), (2, None, [0.25])]
    df = spark.createDataFrame(rows, "id long, t string, vec array<float>")
    stores.write_vectors_csv(df, str(tmp_path / "v"))
    back = stores.read_vectors_csv(spark, str(tmp_path / "v"), "id long, t string, vec string").orderBy("id").collect()
    assert [(r["id"], r["t"], r["vec"]) for r in back] == rows


def test_a_half_written_index_is_built_again(spark, tmp_path):
    path = str(tmp_path / "i")
    spark.range(3).write.parquet(path)
    (tmp_path / "i" / "_SUCCESS").unlink()
    stores.save_index(spark.range(5), path)
    stores.save_index(spark.range(9), path)
    assert spark.read.parquet(path).count() == 5


def test_qrels_include_short_items_and_hot_phrases(spark):
    phrase = "the following text is licensed under"
    items = [(0, "cat"), (1, "b"), (2, "two words"), (3, phrase + " apples"), (4, phrase + " pears"), (5, "a b c d e f g"), (6, "zzz yyy")]
    docs = [(i, f"{phrase} apples and more {i}") for i in range(20)]
    docs += [(100, "concatenate"), (101, "xtwo wordsx"), (102, "qa b c d e f gq"), (103, ""), (104, f"{phrase} pears")]
    got = curate.build_qrels(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"))
    found = sorted((r.query_id, r.item_id) for r in got.collect())
    assert found == sorted((i, d) for i, t in items for d, x in docs if t in x)


def test_bridge_pairs_against_all_pairs(spark):
    questions = [(i, "common") for i in range(30)] + [(40, "rare"), (41, "rare"), (42, "own")]
    answers = [(1, "common"), (50, "common"), (0, "common"), (40, "rare"), (42, "own"), (7, "none")]
    got = curate.bridge_pairs(
        spark.createDataFrame(answers, "question_id long, entity string"), spark.createDataFrame(questions, "question_id long, entity string")
    )
    want = {(a, q, e) for a, e in answers for q, f in questions if f == e and q != a}
    assert {(r.question_id, r.partner_id, r.entity) for r in curate.pairs_of(got).collect()} == want
    assert {r.entity for r in got.collect()} == {"common", "rare"}


def test_split_keeps_groups_together(spark):
    df = spark.range(3000).select((F.col("id") % 300).alias("g"), "id")
    parts = curate.group_disjoint_split(df, "g")
    assert parts.groupBy("g").agg(F.countDistinct("split").alias("n")).where("n > 1").isEmpty()
    assert {r[0] for r in parts.select("split").distinct().collect()} == {"train", "dev", "test"}


def test_sampling_is_independent_of_layout(spark):
    df = spark.range(500).withColumnRenamed("id", "doc_id")
    a = [r.doc_id for r in curate.sample_k(df, "doc_id", 7).collect()]
    b = [r.doc_id for r in curate.sample_k(df.repartition(13), "doc_id", 7).collect()]
    assert a == b and len(set(a)) == 7


def test_neighbours_at_the_ends(spark):
    df = spark.createDataFrame([(1, i, f"p{i}") for i in range(4)], "g long, pos int, t string")
    got = {r.pos: r.noise_context for r in curate.page_neighbours(df, "g", "pos", "t", 2).collect()}
    assert got == {0: "p1\np2", 1: "p0\np2\np3", 2: "p0\np1\np3", 3: "p1\np2"}


def test_a_gap_in_page_numbers_is_a_missing_page(spark):
    df = spark.createDataFrame([("a", 1, "one"), ("a", 2, "two"), ("a", 4, "four")], "g string, p long, t string")
    got = {r.p: (r.n_neighbours, r.noise_context) for r in curate.page_neighbours(df, "g", "p", "t").collect()}
    assert got == {1: (1, "two"), 2: (1, "one"), 4: (0, "")}
    wider = {r.p: r.noise_context for r in curate.page_neighbours(df, "g", "p", "t", reach=2).collect()}
    assert wider[2] == "one\nfour"
