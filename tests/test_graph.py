import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagemill.operators import chunk, graph, lexical
from passagemill.plans import session
from passagemill.plans.session import fresh_path
from passagemill.plans.skew import salted_join
from passagemill.sources.corpus import load_pages
from passagemill.streaming import ingest


def test_salted_join_equals_plain_join(spark):
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97).alias("k"), "id")
    small = spark.range(97).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        plain, salted = big.join(small, "k", how), salted_join(big, small, "k", how=how)
        assert salted.count() == plain.count() == 3000
        assert salted.exceptAll(plain).isEmpty()
    assert "__salt" in salted_join(big, small, "k")._jdf.queryExecution().toString()


def components(edges):
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {a: find(a) for a in parent}


def test_components_with_a_hub_and_a_chain(spark):
    rng = random.Random(5)
    edges = [(1000, i) for i in range(1001, 1060)] + [(i, i + 1) for i in range(60)]
    edges += [(rng.randrange(2000, 2040), rng.randrange(2000, 2040)) for _ in range(30)]
    got = graph.connected_components(spark.createDataFrame(edges, "src long, dst long"))
    assert {r.node: r.component for r in got.collect()} == components(edges)


def test_communities_of_two_cliques(spark):
    edges = [(a, b, 1.0) for c in (0, 10) for a in range(c, c + 5) for b in range(c, c + 5) if a != b]
    edges += [(4, 10, 0.1), (10, 4, 0.1)]
    labels = {r.node: r.community for r in graph.communities(spark.createDataFrame(edges, "src long, dst long, weight double"), 4).collect()}
    assert {labels[i] for i in range(5)} != {labels[i] for i in range(10, 15)}
    assert len({labels[i] for i in range(5)}) == 1


def test_paths_against_enumeration(spark):
    rng = random.Random(9)
    und = {tuple(sorted(rng.sample(range(14), 2))) for _ in range(30)}
    both = und | {(b, a) for a, b in und}
    seeds = [(1, 0), (1, 3), (1, 7), (2, 2), (2, 5)]
    got = graph.relational_paths(
        spark.createDataFrame(sorted(both), "src long, dst long"), spark.createDataFrame(seeds, "query_id long, node long")
    ).collect()
    want = set()

    def walk(q, path, end):
        if path[-1] == end:
            want.add((q, tuple(path)))
        elif len(path) < 4:
            for a, b in both:
                if a == path[-1] and b not in path:
                    walk(q, [*path, b], end)

    for q, s in seeds:
        for p, t in seeds:
            if q == p and s < t:
                walk(q, [s], t)
    assert sorted((r.query_id, tuple(r.path)) for r in got) == sorted(want)


def test_copies_hang_on_one_item(spark):
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(50, [0.9, 0.1]), (51, [0.0, 1.0])]
    edges = graph.semantic_edges(spark.createDataFrame(rows, "item_id long, vec array<float>"), 0.8).collect()
    assert len(edges) == 39 + 1
    assert {(e.src, e.dst) for e in edges} == {(0, i) for i in range(1, 40)} | {(0, 50)}


def test_k_hop_distances(spark):
    edges = graph.both_ways(spark.createDataFrame([(i, i + 1) for i in range(6)], "src long, dst long"))
    got = graph.k_hop(edges, spark.createDataFrame([(1, 2)], "query_id long, node long"), 3)
    assert {r.node: r.hop for r in got.collect()} == {2: 0, 1: 1, 3: 1, 0: 2, 4: 2, 5: 3}


def documents(spark):
    rng = random.Random(1)
    words = [f"wordnumber{i}" for i in range(60)] + ["and", "of"]
    rows = [(i, ". ".join(" ".join(rng.choices(words, k=12)).capitalize() for _ in range(14)) + ".") for i in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def batch_chunks(docs):
    return chunk.min_token_filter(chunk.make_chunks(load_pages(docs, "doc_id", "text")))


def test_increment_equals_rebuild(spark):
    docs = documents(spark)
    halves = [graph.long_word_entities(batch_chunks(docs.where(f"doc_id % 2 = {i}"))) for i in (0, 1)]
    merged = graph.merge_graph_increment(*[graph.build_edges(h) for h in halves], ["src", "dst"], ["weight"])
    whole = graph.build_edges(graph.long_word_entities(batch_chunks(docs)))
    assert merged.exceptAll(whole).isEmpty() and whole.exceptAll(merged).isEmpty()


def test_streams_equal_batch_and_survive_replay(spark):
    docs = documents(spark)
    folder = fresh_path(spark, "in")
    docs.repartition(4).write.parquet(folder)
    chunks = batch_chunks(docs)
    out, state = fresh_path(spark, "out"), fresh_path(spark, "state")
    stream = ingest.stream_chunks(ingest.arriving(spark, folder, "doc_id long, text string", 2))
    ingest.write_stream(stream, out, state).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == chunks.count() and got.select(*chunks.columns).exceptAll(chunks).isEmpty()

    target = fresh_path(spark, "graph")
    for run in range(2):  # a second run from an empty state replays every batch
        ingest.stream_graph_merge(stream, target, fresh_path(spark, f"state{run}")).awaitTermination()
    nodes, edges = ingest.read_graph(spark, target)
    mentions = graph.long_word_entities(chunks)
    assert edges.exceptAll(graph.build_edges(mentions)).isEmpty() and edges.count() == graph.build_edges(mentions).count()
    assert nodes.exceptAll(graph.build_nodes(mentions)).isEmpty()


def test_steps_are_deleted_with_their_job(spark, tmp_path):
    with session.steps(spark) as folder:
        rows = session.cut_lineage(spark.range(5)).count()
        assert rows == 5 and os.listdir(folder)
    assert not os.path.exists(folder)


def test_best_paths_without_listing_all(spark):
    rng = random.Random(8)
    nodes = range(40)
    pairs = {tuple(sorted(rng.sample(nodes, 2))) for _ in range(110)}
    edges = spark.createDataFrame([e for a, b in pairs for e in ((a, b), (b, a))], "src long, dst long")
    seeds = spark.createDataFrame([(q, n) for q in range(6) for n in rng.sample(nodes, 4)], "query_id long, node long")
    for low in (0.0, -0.5):
        scored = [(q, n, round(rng.uniform(low, 1) ** 3, 6)) for q in range(6) for n in nodes if rng.random() < 0.9]
        scores = spark.createDataFrame(scored, "query_id long, node long, score double")
        counts = []
        got = graph.best_paths(edges, seeds, scores, 4, 4, counts=counts)
        want = graph.prune_paths(graph.relational_paths(edges, seeds, 4), scores, 4)
        key = lambda df: sorted((r["query_id"], r["rank"], r["position"], r["path"], r["hops"], r["score"]) for r in df.collect())
        assert key(got) == key(want)
    assert graph.best_paths(edges, seeds, scores.where("false"), 4, 3).count() == 0
    assert len(counts) == 3 and sum(c[2] for c in counts) <= sum(c[1] for c in counts)


def test_spanning_forest(spark):
    rng = random.Random(3)
    rows = [(q, a, b, rng.randrange(1, 4)) for q in range(5) for a in range(14) for b in range(a + 1, 14) if rng.random() < 0.25 and (q or a < 6 <= b)]
    want = set()
    for q in range(5):
        root = list(range(14))

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for _, a, b, w in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[3], r[1], r[2])):
            if top(a) != top(b):
                root[top(a)] = top(b)
                want.add((q, a, b, w))
    edges = spark.createDataFrame(rows, "query_id long, src long, dst long, weight long")
    assert {tuple(r) for r in graph.spanning_forest(edges).collect()} == want
    assert graph.spanning_forest(edges.where("false")).count() == 0


@pytest.mark.parametrize("name", ["best_paths", "graph_vector_search", "prune_paths"])
def test_one_search_for_graph_and_seeds(spark, tmp_path, monkeypatch, name):
    from passagemill.catalog import QUERIES
    from passagemill.operators import search

    rows = [(i, [float((i * j) % 7 - 3) for j in range(1, 65)], i % 3) for i in range(30)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    scans, scored = [], search._scored
    monkeypatch.setattr(search, "_scored", lambda *a, **b: scans.append(1) or scored(*a, **b))
    assert QUERIES[name](spark, str(tmp_path)).count() > 0
    assert len(scans) == 1


def test_chunk_scores_sum_what_can_reach_the_floor(spark, monkeypatch):
    """Before, every chunk of every entity with any relevance was summed. Same hits, repeated rows, NULL keys and queries without a floor included."""
    rng = np.random.default_rng(5)
    mentions = [(f"c{c}", f"e{e}") for c in range(300) for e in rng.choice(40, 4, replace=False)] + [("c1", "e1"), ("c1", "e1"), (None, "e2")]
    relevance = [(q, f"e{e}", 1.0 if e < 3 else round(float(rng.random()) ** 3 / 2, 3)) for q in (1, 2, None) for e in range(40)] + [(3, "e7", 0.25)]
    m = spark.createDataFrame(mentions, "chunk_id string, entity string")
    r = spark.createDataFrame(relevance, "query_id long, entity string, r double")
    summed = []
    whole = graph._summed
    monkeypatch.setattr(graph, "_summed", lambda met: summed.append(met.select("query_id", "chunk_id").distinct()) or whole(met))
    rows = lambda df: sorted(map(tuple, df.select("query_id", "item_id", "score", "rank").collect()), key=str)
    want = [x for x in rows(graph.chunk_scores(r, m, None)) if x[3] <= 5]
    every = summed[-1].where("query_id = 1").count()
    assert rows(graph.chunk_scores(r, m, 5)) == want and len(want) == 20
    assert summed[-1].where("query_id = 1").count() < 0.6 * every
    few = r.where("query_id = 3").withColumn("entity", F.lit("e1")).limit(1).unionByName(spark.createDataFrame([(3, "nowhere", 1.0)], r.schema))
    assert rows(graph.chunk_scores(few, m, 500)) == rows(graph.chunk_scores(few, m, None))


def test_entities_leave_their_chunk_only_where_they_can_be_among_the_best(spark, monkeypatch):
    """Before, every word of every chunk was moved to its frequency and back. Here few words are known to all tasks; ids repeat and are null."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=rng.randrange(0, 30))) for _ in range(200)] + ["", None, "rare words here", "w1 w1 w1 ab"]
    chunks = spark.createDataFrame([(f"c{i % 190}" if i != 7 else None, t) for i, t in enumerate(texts)], "chunk_id string, sentence_chunk string").repartition(3)
    rows = [(c, t) for c, t in chunks.collect()]
    tf = [(c, w, t.split().count(w)) for c, t in rows if t for w in set(t.split())]
    df = Counter(w for _, w, _ in tf)
    for least in (1, 3):
        by = {}
        for c, w, n in tf:
            if len(w) >= least:
                by.setdefault(c, []).append((-round(n * math.log(len(rows) / df[w]), 6), w))
        want = sorted((str(c), w, -s) for c, mine in by.items() for s, w in sorted(mine)[:5])
        for common in (1 << 17, 10):
            monkeypatch.setattr(graph, "COMMON", common)
            got = sorted((str(r["chunk_id"]), r["entity"], r["score"]) for r in graph.extract_entities(chunks, min_length=least).collect())
            assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(g[2] - w[2]) < 2e-6 for g, w in zip(got, want))
    lists = lexical.term_lists(chunks, "chunk_id", "sentence_chunk")
    assert lists.count() == len(rows)


def test_expansion_keeps_the_best_chunks(spark):
    """Before, every chunk with a linked entity was counted for the ten that stay."""
    rng = random.Random(5)
    rows = [(f"c{i}", f"e{j}") for i in range(150) for j in set(rng.choices(range(40), k=5))] + [(None, "e1"), (None, "e2")]
    mentions = spark.createDataFrame(rows, "chunk_id string, entity string")
    seeds = spark.createDataFrame([(q, f"c{3 * q + j}") for q in range(6) for j in range(2)] + [(None, "c4")], "query_id long, chunk_id string")
    edges = graph.build_edges(mentions)
    score = F.col("shared") + F.col("linked") / 2
    every = graph.expand_by_entities(seeds, mentions, edges).select("query_id", "chunk_id", "shared", "linked", score.alias("score"))
    want = sorted(map(str, graph.best_chunks(every, 4).drop("rank").collect()))
    some = graph.expand_by_entities(seeds, mentions, edges, keep=4).select("query_id", "chunk_id", "shared", "linked", score.alias("score"))
    assert sorted(map(str, some.collect())) == want and len(want) == 28
