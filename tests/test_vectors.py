import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagemill.functions import vectors as V
from passagemill.operators import ann, multivec, search
from passagemill.plans.session import fresh_path
from passagemill.sources import stores

DIM = 16


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, DIM)).astype(np.float32)
    x[100:200] = x[7]  # a third of all rows are copies
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, vec array<float>").persist()


def best(x, q, k, skip=None):
    scores = np.round(x.astype(float) @ q.astype(float), 6)
    order = [i for i in np.lexsort((np.arange(len(x)), -scores)) if i != skip]
    return order[:k]


def test_small_vectors(spark):
    rows = [([1.0, 2.0, 3.0], [1.0, 2.0, 3.0]), ([1.0, 2.0, 3.0], [4.0, 5.0, 6.0]), ([1.0, 2.0, 3.0], [-1.0, -2.0, -3.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    got = df.select(V.dot_product(F.col("a"), F.col("b")), V.cosine_similarity(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [14.0, 32.0, -14.0]
    assert [round(r[1], 9) for r in got] == [1.0, round(32 / math.sqrt(14 * 77), 9), -1.0]


def test_zero_vector_has_no_cosine(spark, table):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<float>, b array<float>")
    assert df.select(V.cosine_similarity(F.col("a"), F.col("b")).alias("c")).first().c is None
    assert df.select(V.l2_normalize(F.col("a")).alias("c")).first().c is None
    zero = spark.createDataFrame([(1, [0.0] * DIM)], "query_id long, vec array<float>")
    assert search.knn_exact(zero, table[1], 5, "cosine").count() == 0


@pytest.mark.parametrize("query_rows", [4096, 10])
def test_knn_both_routes(spark, table, query_rows):
    x, items = table
    queries = items.where("item_id % 7 = 0").withColumnRenamed("item_id", "query_id")
    got = search.knn_exact(queries, items, 5, query_rows=query_rows, block_rows=16).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append(r.item_id)
    assert found == {q: best(x, x[q], 5) for q in range(0, 300, 7)}


def test_knn_layout_skip_self_and_large_k(spark, table):
    x, items = table
    queries = items.where("item_id < 3").withColumnRenamed("item_id", "query_id")
    a = search.knn_exact(queries, items.repartition(11), 4, skip_self=True).orderBy("query_id", "rank").collect()
    assert [r.item_id for r in a] == [i for q in range(3) for i in best(x, x[q], 4, skip=q)]
    assert search.knn_exact(queries, items.limit(10), 50).groupBy("query_id").count().where("count <> 10").isEmpty()


@pytest.mark.parametrize("query_rows", [4096, 2])
def test_score_matrix_and_threshold(spark, table, query_rows):
    x, items = table
    queries = items.where("item_id < 5").withColumnRenamed("item_id", "query_id")
    all_scores = search.score_all_pairs(queries, items, query_rows=query_rows, block_rows=64)
    assert all_scores.count() == 5 * 300
    got = {(r.query_id, r.item_id): r.score for r in all_scores.collect()}
    assert all(abs(got[q, i] - float(x[q].astype(float) @ x[i].astype(float))) < 1e-5 for q in range(5) for i in range(300))
    above = search.pairs_above(queries, items, 5.0, "dot", query_rows=query_rows, block_rows=64)
    assert {(r.query_id, r.item_id) for r in above.collect()} == {p for p, s in got.items() if s >= 5.0 and p[0] != p[1]}


@pytest.mark.parametrize("query_rows", [4096, 10])
def test_packed_vectors_give_the_same_hits(spark, table, query_rows):
    x, items = table
    path = fresh_path(spark, "packed")
    stores.write_vectors_parquet(items, path, packed="vec")
    stored = spark.read.parquet(path)
    assert stored.withColumn("vec", V.unpack(F.col("vec"))).exceptAll(items).isEmpty()
    queries = stored.where("item_id % 9 = 0").withColumnRenamed("item_id", "query_id")
    got = search.knn_exact(queries, stored, 4, query_rows=query_rows, block_rows=32).orderBy("query_id", "rank").collect()
    assert [r.item_id for r in got] == [i for q in range(0, 300, 9) for i in best(x, x[q], 4)]


def test_lanes(spark, table):
    x, items = table
    laned = items.withColumn("store", F.concat(F.lit("s"), F.col("item_id") % 3))
    queries = items.where("item_id < 4").withColumnRenamed("item_id", "query_id")
    got = search.knn_exact(queries, laned, 2, lane="store").collect()
    assert len(got) == 4 * 3 * 2
    top = search.multi_store_search(queries, laned, "store", 2, 3).where("query_id = 0").orderBy("rank").collect()
    firsts = [i for s in range(3) for i in [j for j in best(x, x[0], 300) if j % 3 == s][:2]]
    scores = {i: round(float(x[0].astype(float) @ x[i].astype(float)), 6) for i in firsts}
    assert [r.item_id for r in top] == sorted(firsts, key=lambda i: (-scores[i], i))[:3]


def test_lanes_may_be_null(spark, table):
    x, items = table
    queries = items.where("item_id < 4").withColumnRenamed("item_id", "query_id")
    for lane in (F.when(F.col("item_id") % 2 == 0, F.lit("None")), F.when(F.col("item_id") % 2 == 0, F.lit(7))):
        got = search.knn_exact(queries, items.withColumn("store", lane), 2, lane="store").where("query_id = 1").orderBy("store", "rank").collect()
        want = [[i for i in best(x, x[1], 300) if i % 2 == side][:2] for side in (1, 0)]
        assert [r.item_id for r in got] == want[0] + want[1] and [r.store is None for r in got] == [True, True, False, False]


def test_vectors_of_different_lengths_are_an_error(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vec array<float>")
    d = spark.createDataFrame([(1, [1.0, 0.0, 2.0]), (2, [1.0])], "item_id long, vec array<float>").coalesce(1)
    with pytest.raises(Exception, match="different lengths"):
        search.knn_exact(q, d, 1).collect()
    with pytest.raises(Exception, match="dimensions"):
        search.knn_exact(q, d.where("item_id = 1"), 1).collect()


def test_rows_without_vector_or_id(spark, table):
    x, items = table
    queries = items.where("item_id < 3").withColumnRenamed("item_id", "query_id")
    odd = items.unionByName(spark.createDataFrame([(500, None), (None, x[0].tolist())], "item_id long, vec array<float>"))
    got = search.knn_exact(queries, odd, 2).orderBy("query_id", "rank").collect()
    assert [r.item_id for r in got] == [i for q in range(3) for i in best(x, x[q], 2)]
    tokens = odd.withColumn("pos", F.lit(0))
    assert multivec.maxsim(queries.withColumn("pos", F.lit(0)), tokens, 1).count() == 3


def test_few_items_for_many_queries(spark, table):
    x, items = table
    many = items.withColumnRenamed("item_id", "query_id")
    few = items.where("item_id < 6")
    a, b = (search.knn_exact(many, few, 2, move_items=m, query_rows=4).orderBy("query_id", "rank").collect() for m in (False, True))
    assert a == b and len(a) == 600


def test_packed_vectors_everywhere(spark, table, tmp_path):
    x, items = table
    stores.write_vectors_parquet(items, str(tmp_path / "p"), packed="vec")
    stored = spark.read.parquet(str(tmp_path / "p"))
    queries = items.where("item_id < 5").withColumnRenamed("item_id", "query_id")
    for search_with in (lambda q, d: ann.knn_lsh(q, d, DIM, 3, 4, 4), lambda q, d: search.rerank(search.knn_exact(q, d, 9), q, d, 3)):
        one, two = (search_with(queries, d).orderBy("query_id", "rank").collect() for d in (items, stored))
        assert [(r.query_id, r.item_id) for r in one] == [(r.query_id, r.item_id) for r in two]
    model = ann.fit_cells(stored, 4)
    assert ann.to_cells(stored, model).count() == 300
    pos = F.lit(0).alias("pos")
    assert multivec.maxsim(queries.select("query_id", pos, "vec"), stored.select("item_id", pos, "vec"), 2).count() == 10


def test_csv_round_trip_and_index(spark, table):
    _, items = table
    path = fresh_path(spark, "csv")
    stores.write_vectors_csv(items, path)
    back = stores.read_vectors_csv(spark, path, "item_id long, vec string")
    assert back.join(items.withColumnRenamed("vec", "v"), "item_id").where("vec <> v").isEmpty() and back.count() == 300
    index = fresh_path(spark, "index")
    for n, over in ((1, False), (2, False), (3, True)):
        stores.save_index(items.select("item_id", F.lit(n).alias("n")), index, over)
        assert spark.read.parquet(index).select("n").distinct().first().n == {1: 1, 2: 1, 3: 3}[n]


def test_approximate_searches(spark, table):
    x, items = table
    queries = items.withColumnRenamed("item_id", "query_id")
    exact = search.knn_exact(queries, items, 5, skip_self=True)
    model = ann.fit_cells(items, 8)
    cells = ann.to_cells(items, model)
    some = ann.knn_ivf(queries, cells, model, 5, 4, skip_self=True)
    everything = ann.knn_ivf(queries, cells, model, 5, 8, skip_self=True)
    assert ann.recall_against(exact, some).first().recall >= 0.6
    assert ann.recall_against(exact, everything).first().recall == 1.0
    lsh = ann.knn_lsh(queries, items, DIM, 5, 8, 4, skip_self=True)
    assert ann.recall_against(exact, lsh).first().recall >= 0.6
    books = ann.fit_codebooks(items, DIM, parts=4, centres=32)
    coded = items.select("item_id", "vec", ann.pq_encode(F.col("vec"), books).alias("codes"))
    error = coded.select(V.norm(F.zip_with("vec", ann.pq_decode(F.col("codes"), books), lambda a, b: a - b)).alias("e"), V.norm(F.col("vec")).alias("n"))
    assert error.agg(F.avg(F.col("e") / F.col("n")).alias("r")).first().r < 0.5


def test_hot_cell_is_cut_into_blocks(spark, table):
    x, items = table
    queries = items.where("item_id < 50").select(F.col("item_id").alias("query_id"), "vec", F.lit(1).alias("cell"))
    got = search.knn_in_cells(queries, items.withColumn("cell", F.lit(1)), 3, block_rows=20).orderBy("query_id", "rank").collect()
    assert [r.item_id for r in got] == [i for q in range(50) for i in best(x, x[q], 3)]


@pytest.mark.parametrize("segment", [256, 8])
def test_maxsim_long_items(spark, table, monkeypatch, segment):
    monkeypatch.setattr(multivec, "RUN", segment)
    x, items = table
    owner = np.array([0] * 150 + list(np.arange(150) // 10 + 1))  # item 0 has half of all vectors
    rows = [(int(owner[i]), i, x[i].tolist()) for i in range(300)]
    d = spark.createDataFrame(rows, "item_id long, pos long, vec array<float>")
    q = spark.createDataFrame([(j // 3, j, x[j * 5].tolist()) for j in range(12)], "query_id long, pos long, vec array<float>")
    got = {(r.query_id, r.item_id): r.score for r in multivec.maxsim(q, d, None, block_runs=2).collect()}
    s = x.astype(float)
    want = {
        (a, b): sum(max(float(s[j * 5] @ s[i]) for i in np.flatnonzero(owner == b)) for j in range(a * 3, a * 3 + 3))
        for a in range(4)
        for b in range(16)
    }
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-5 for p in want)
    few = spark.createDataFrame([(a, b) for a in range(4) for b in (0, 3, 9)], "query_id long, item_id long")
    some = multivec.maxsim_rerank(few, q, d, 2).collect()
    for a in range(4):
        order = sorted((0, 3, 9), key=lambda b: (-round(want[a, b], 6), b))[:2]
        assert [r.item_id for r in sorted(some, key=lambda r: r.rank) if r.query_id == a] == order
    top = multivec.maxsim(q, d, 3, block_runs=2).where("query_id = 1").orderBy("rank").collect()
    assert [r.item_id for r in top] == [b for _, b in sorted((-round(want[1, b], 6), b) for b in range(16))[:3]]


def test_encoder_plug_in(spark):
    def load():
        return lambda texts: [np.array([len(t), 1.0], dtype=np.float32) for t in texts]

    df = spark.createDataFrame([(i, "x" * i) for i in range(100)], "k long, t string").repartition(5)
    got = multivec.batch_encode(df, "k", "t", load, batch=7)
    assert {r.k: list(r.vec) for r in got.collect()} == {i: [float(i), 1.0] for i in range(100)}


def test_mixture_cut_keeps_the_upper_part(spark):
    scores = [0.9, 0.88, 0.87, 0.2, 0.19, 0.18, 0.17]
    hits = spark.createDataFrame([(1, i, s, i + 1) for i, s in enumerate(scores)], "query_id long, item_id long, score double, rank int")
    assert {r.item_id for r in search.dynamic_k(hits).collect()} == {0, 1, 2}
    assert {r.item_id for r in search.dynamic_k(hits, "gap").collect()} == {0, 1, 2}


def test_hit_page_lookup_of_long_conversations(spark, tmp_path):
    from passagemill.catalog import QUERIES

    rows = [(1, 1002, "user", "red apple"), (2, 2, "user", "blue plum"), (2, 1, "user", "green pear")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(7, "red apple")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = QUERIES["hit_page_lookup"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.source_page) for r in found) == [(1, 1002), (2, 1), (2, 2)]
    assert [(r.doc_id, r.source_page) for r in found if r["rank"] == 1] == [(1, 1002)]


def test_many_queries_are_many_tasks(spark):
    """Blocks of queries meet groups of items in tasks of their own, whatever the planner would broadcast."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, vec array<float>").repartition(4)
    asked = df.withColumnRenamed("item_id", "query_id")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(before, ("-1", "false")):
            spark.conf.set(k, v)
        scored = search._scored(asked, df, (3, "dot", True, None), search.QUERY_ROWS, search.BLOCK_ROWS)
        assert scored.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = x.astype(np.float64) @ x.T.astype(np.float64)
    np.fill_diagonal(want, -np.inf)
    got = {(r["query_id"], r["rank"]): r["item_id"] for r in search.knn_exact(asked, df, 3, skip_self=True).collect()}
    assert all([got[i, r + 1] for r in range(3)] == list(np.argsort(-want[i], kind="stable")[:3]) for i in range(3000))


@pytest.mark.parametrize("size", [1.0, 1e25])
def test_scan_of_tiles_against_all_scores(monkeypatch, size):
    """Tiles of 32-bit products leave out nothing: ties, numbers too large for 32 bits, missing numbers, fewer items than hits."""
    monkeypatch.setattr(search, "TILE", (7, 11))
    monkeypatch.setattr(search, "MERGED", 5)
    rng = np.random.default_rng(5)
    items = (rng.integers(-2, 3, (60, 4)) * size).astype(np.float32)
    items[3] = np.nan
    queries, ids = items[:20].astype(np.float64), np.arange(60) // 2
    for k in (1, 4, 100):
        scan, found = search.Scan(np.arange(20), queries, k, "dot", True, None), {}
        for part in (slice(0, 25), slice(25, 60)):
            assert not list(scan.add(ids[part], items[part], np.full(len(ids[part]), "")))
        for q, i, score, _ in scan.rest():
            for row in zip(q, i, score):
                found.setdefault(row[0], []).append((-row[2], row[1]))
        scores = np.round(queries @ items.T.astype(np.float64), 6)
        for q in range(20):
            want = sorted((-s, i) for s, i in zip(scores[q], ids) if i != q and s == s)[:k]
            assert sorted(found.get(q, [])) == want


def test_encoder_holds_few_words_at_once():
    """Long texts are cut into words a few at a time; the vectors are those of one text by itself."""
    texts = [" ".join(f"w{(i * 7919 + j * 31) % 50021}" for j in range(20_000)) for i in range(40)] + [None, ""]
    encode = V.hashing_encoder(64)()
    tracemalloc.start()
    try:
        together = encode(texts)
        assert tracemalloc.get_traced_memory()[1] < 20 << 20
    finally:
        tracemalloc.stop()
    assert len(together) == len(texts) and all((a == V.hashing_encoder(64)()([t])[0]).all() for a, t in zip(together, texts))


def test_searched_texts_are_encoded_once(spark, tmp_path):
    """A filter on the vectors made Spark run the encoder a second time for every text."""
    log = str(tmp_path / "encoded")

    def load():
        def encode(texts):
            with open(log, "a") as out:
                out.write("x" * len(texts))
            return [None if t == "none" else np.zeros(0, np.float32) if t == "empty" else np.array([float(t), 1.0], np.float32) for t in texts]

        return encode

    rows = [(0, "none", "a"), (1, "empty", "a"), (2, "3", "a"), (3, "5", "b"), (4, "7", "a")]
    items = V.embed_text(spark.createDataFrame(rows, "item_id long, text string, part string"), "text", load=load)
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vec array<float>")
    found = search.knn_exact(queries, items, 2, lane="part").collect()
    assert sorted((r["part"], r["item_id"], r["score"]) for r in found) == [("a", 2, 3.0), ("a", 4, 7.0), ("b", 3, 5.0)]
    with open(log) as f:
        assert len(f.read()) == len(rows)
