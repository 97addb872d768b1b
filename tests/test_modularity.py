import random

from pyspark.sql import functions as F

from passagemill.operators import graph, modularity


def quality(pairs, label):
    m = sum(pairs.values())
    inner, total = {}, {}
    for (a, b), w in pairs.items():
        total[label[a]] = total.get(label[a], 0) + w
        total[label[b]] = total.get(label[b], 0) + w
        if label[a] == label[b]:
            inner[label[a]] = inner.get(label[a], 0) + w
    return sum(inner.get(c, 0) / m - (t / (2 * m)) ** 2 for c, t in total.items())


def partitions(n):
    def grow(prefix, top):
        if len(prefix) == n:
            yield prefix
            return
        for c in range(top + 1):
            yield from grow([*prefix, c], max(top, c + 1))

    yield from grow([], 0)


def table(spark, pairs):
    return graph.both_ways(spark.createDataFrame([(a, b, float(w)) for (a, b), w in sorted(pairs.items())], "src long, dst long, weight double"))


def labels_of(levels, level):
    return {r.node: r.community for r in levels if r.level == level}


def test_the_best_partition_of_a_small_graph(spark):
    pairs = {(a, b): 1.0 for c in ((0, 1, 2, 3), (4, 5, 6)) for a in c for b in c if a < b}
    pairs |= {(3, 4): 0.5, (7, 8): 2.0}
    best = max(quality(pairs, p) for p in partitions(9))
    # a loop alone, a weight of zero and a missing one leave their nodes on their own
    more = spark.createDataFrame([(20, 21, 0.0), (21, 20, 0.0), (22, 22, None)], "src long, dst long, weight double")
    levels = modularity.modular_levels(table(spark, pairs).unionByName(more)).collect()
    top = labels_of(levels, max(r.level for r in levels))
    assert [top.pop(n) for n in (20, 21, 22)] == [20, 21, 22]
    assert abs(quality(pairs, top) - best) < 1e-9
    assert all(min(n for n in top if top[n] == c) == c for c in top.values())


def test_communities_are_connected_nested_and_better_than_spread_labels(spark):
    rng = random.Random(4)
    pairs = {}
    for _ in range(160):
        a, b = rng.sample(range(48), 2)
        if a // 12 == b // 12 or rng.random() < 0.15:
            pairs[min(a, b), max(a, b)] = rng.randrange(1, 4)
    pairs |= {(60, 60 + i): 1 for i in range(1, 15)}  # a hub
    edges = table(spark, pairs).persist()
    found = modularity.modular_levels(edges)
    levels = found.collect()
    last = max(r.level for r in levels)
    for level in range(1, last + 1):
        label = labels_of(levels, level)
        assert set(label) == {n for p in pairs for n in p}
        for c in set(label.values()):
            inside, reach = {n for n in label if label[n] == c}, {c}
            while True:
                wider = reach | {n for a, b in pairs for n in (a, b) if {a, b} <= inside and {a, b} & reach}
                if wider == reach:
                    break
                reach = wider
            assert reach == inside
        if level > 1:
            below = labels_of(levels, level - 1)
            assert all(label[n] == label[below[n]] for n in label)
    spread = {r.node: r.community for r in graph.communities(edges, 3).collect()}
    assert quality(pairs, labels_of(levels, last)) >= quality(pairs, spread)
    rows = modularity.community_quality(edges, found.where(F.col("level") == last).select("node", "community")).collect()
    assert abs(sum(r.modularity for r in rows) - quality(pairs, labels_of(levels, last))) < 1e-6


def test_graphs_without_weight(spark):
    empty = spark.createDataFrame([], "src long, dst long, weight double")
    assert modularity.modular_levels(empty).count() == 0
    none = spark.createDataFrame([(1, 2, 0.0)], "src long, dst long, weight double")
    assert sorted(tuple(r) for r in modularity.modular_levels(none).collect()) == [(1, 1, 1), (1, 2, 2)]
