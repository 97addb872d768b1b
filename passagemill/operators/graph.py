"""Entity and similarity graphs as tables: nodes, edges(src, dst, weight), mentions(chunk_id, entity).

Iterative jobs write every round to the shared folder and stop on an unchanged state. Joins on a
node or entity go through ``salted_join``, because hubs and common entities are the rule here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.functions import text as X
from passagemill.operators import lexical
from passagemill.operators.balls import pairs_by_angle
from passagemill.operators.search import DIGITS, pairs_above, ranked
from passagemill.plans.session import cut_lineage
from passagemill.plans.skew import salted_join

#: Words whose frequencies every task holds.
COMMON = 1 << 17

# ---- extraction -----------------------------------------------------------------------------


def extract_entities(
    chunks: DataFrame, m: int = 5, text: str = "sentence_chunk", min_length: int = 1, extractor: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """(chunk_id, entity, score): a plugged-in extractor, or the chunk's top ``m`` words by tf-idf.

    ``min_length`` leaves out shorter words where a caller wants that. Words are counted once and stored, a row a chunk. The ``COMMON`` most
    frequent words go to every task; a word that is not among them occurs in no more chunks than the last of them, which bounds its score.
    Only words that can be among a chunk's best leave it: the rest of them are looked up by word.
    """
    if extractor is not None:
        return extractor(chunks)
    lists = cut_lineage(lexical.term_lists(chunks.select("chunk_id", text), "chunk_id", text), "terms")
    n_chunks = lists.count()
    df = cut_lineage(lists.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "df")
    common = df.orderBy(F.desc("df"), "term").limit(COMMON).collect()
    rest = common[-1]["df"] if len(common) == COMMON else 1
    known, df_known = pa.array([r["term"] for r in common], pa.string()), np.array([r["df"] for r in common], float)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, terms, tfs = batch.columns
            tf, terms = tfs.flatten().to_numpy(), terms.flatten()
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(tfs).to_numpy())
            place = pc.fill_null(pc.index_in(terms, value_set=known), -1).to_numpy()
            seen = np.where(place < 0, rest, df_known[place])
            low, high = tf * np.log(n_chunks / seen), tf * np.log(n_chunks / np.where(place < 0, 1, seen))
            if min_length > 1:
                low = np.where(pc.utf8_length(terms).to_numpy() >= min_length, low, -np.inf)
            order = np.lexsort((-low, row))
            first = np.searchsorted(row, np.arange(batch.num_rows + 1))
            limit = np.full(batch.num_rows, -np.inf)
            full = np.flatnonzero(np.diff(first) >= m)
            limit[full] = low[order[first[full] + m - 1]]
            # scores are rounded
            at = np.flatnonzero((high >= limit[row] - 1e-5) & (low > -np.inf))
            columns = [keys.take(pa.array(row[at])), terms.take(pa.array(at)), pa.array(tf[at]), pa.array(seen[at].astype(np.int64), mask=place[at] < 0)]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk_id", "term", "tf", "df"])

    kind = lists.schema["chunk_id"].dataType.simpleString()
    near = lists.mapInArrow(best, f"chunk_id {kind}, term string, tf long, df long")
    if len(common) == COMMON:
        near = cut_lineage(near, "near")
        near = near.where("df IS NOT NULL").unionByName(near.where("df IS NULL").drop("df").join(df, "term"))
    scored = near.withColumn("score", F.round(F.col("tf") * F.log(F.lit(n_chunks) / F.col("df")), DIGITS))
    w = Window.partitionBy("chunk_id").orderBy(F.desc("score"), "term")
    top = scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= m)
    return top.select("chunk_id", F.col("term").alias("entity"), "score")


def long_word_entities(chunks: DataFrame, m: int = 5, text: str = "sentence_chunk", min_length: int = 8) -> DataFrame:
    """Extractor that looks at one chunk only, so new documents never change old mentions."""
    words = F.filter(F.array_distinct(X.tokens(F.col(text))), lambda t: F.length(t) >= min_length)
    keyed = F.array_sort(F.transform(words, lambda t: F.struct((-F.length(t)).alias("order"), t.alias("entity"))))
    return chunks.select("chunk_id", F.inline(F.slice(keyed, 1, m))).select("chunk_id", "entity", F.length("entity").cast("double").alias("score"))


def edge_support(mentions: DataFrame) -> DataFrame:
    """(src, dst, chunk_id) with src < dst. The extractor keeps at most m entities of a chunk, so a
    chunk's entities fit a row and pair up inside it: one shuffle, no self-join."""
    sets = mentions.groupBy("chunk_id").agg(F.array_sort(F.collect_set("entity")).alias("e"))
    pairs = F.flatten(
        F.transform("e", lambda a, i: F.transform(F.slice("e", i + 2, F.size("e")), lambda b: F.struct(a.alias("src"), b.alias("dst"))))
    )
    return sets.select("chunk_id", F.inline(pairs))


def build_edges(mentions: DataFrame) -> DataFrame:
    """(src, dst, weight): in how many chunks the two entities meet."""
    return edge_support(mentions).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def build_nodes(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("entity").agg(F.count(F.lit(1)).alias("n_chunks"))


def both_ways(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])
    return edges.unionByName(back)


def merge_entities(mentions: DataFrame, surface: str = "entity", segment: str = "chunk_id") -> DataFrame:
    """Spellings of one entity from different segments under one key. Counted in two levels, so a
    common entity's segments are never gathered."""
    key = X.normalised_key(F.col(surface))
    by_form = mentions.groupBy(key.alias("entity"), F.col(surface).alias("form")).agg(F.count(F.lit(1)).alias("n"))
    forms = by_form.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_forms"), F.sum("n").alias("n_mentions"), F.min("form").alias("first_form")
    )
    by_segment = mentions.select(key.alias("entity"), segment).distinct()
    return forms.join(by_segment.groupBy("entity").agg(F.count(F.lit(1)).alias("n_segments")), "entity")


def entity_profiles(mentions: DataFrame, chunks: DataFrame, n: int = 3, text: str = "sentence_chunk") -> DataFrame:
    """entity -> text for look-up: its ``n`` best chunks, best first."""
    w = Window.partitionBy("entity").orderBy(F.desc("score"), "chunk_id")
    best = mentions.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    rows = cut_lineage(best, "best").join(chunks.select("chunk_id", text), "chunk_id")
    listed = F.array_sort(F.collect_list(F.struct("place", F.col(text).alias("t"))))
    return rows.groupBy("entity").agg(F.array_join(F.transform(listed, lambda x: x["t"]), "\n").alias("profile"))


def semantic_edges(items: DataFrame, low: float, metric: str = "cosine") -> DataFrame:
    """Edges between items scoring at least ``low``; by cosine, pairs of balls that are too far apart are not scored.

    Equal vectors are first reduced to their lowest id: the others hang on it by one edge each of
    score 1, instead of forming all pairs among the copies.
    """
    hashed = items.select("item_id", "vec", F.sha2(F.array_join(F.transform("vec", lambda x: x.cast("string")), ","), 256).alias("h"))
    first = hashed.groupBy("h").agg(F.min("item_id").alias("item_id"), F.min("vec").alias("vec"), F.count(F.lit(1)).alias("n"))
    reps = first.select("item_id", "vec")
    if metric == "cosine":
        found = pairs_by_angle(cut_lineage(reps, "different"), low)
    else:
        found = pairs_above(reps.withColumnRenamed("item_id", "query_id"), reps, low, metric).where("query_id < item_id")
    links = salted_join(hashed.select("item_id", "h"), first.select("h", F.col("item_id").alias("first_id")), "h", first, "n")
    copies = links.where("item_id <> first_id").select(F.col("first_id").alias("src"), F.col("item_id").alias("dst"), F.lit(1.0).alias("weight"))
    return found.select(F.col("query_id").alias("src"), F.col("item_id").alias("dst"), F.col("score").alias("weight")).unionByName(copies)


def mutual_neighbours(hits: DataFrame) -> DataFrame:
    """Both directions of every pair that lists each other. The hits are read twice, so they are stored."""
    hits = cut_lineage(hits.select("query_id", "item_id", "score"), "hits")
    a = hits.select(F.col("query_id").alias("src"), F.col("item_id").alias("dst"), F.col("score").alias("weight"))
    b = hits.select(F.col("item_id").alias("src"), F.col("query_id").alias("dst"))
    return a.join(b, ["src", "dst"])


# ---- components and communities -------------------------------------------------------------


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component): the lowest node of each component, by alternating star contraction.

    Each round links every neighbour to the lowest node seen; the number of rounds grows with the
    logarithm of the component size, not with its diameter, and ``rounds`` limits them only on request. Lowest nodes come from a partial
    aggregation, and a hub's neighbours are spread over tasks by the salted join.
    """
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct()
    lone = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    e, before = cut_lineage(e), None
    for _ in count() if rounds is None else range(rounds):
        around = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut_lineage(around.groupBy("u").agg(F.min(F.least("u", "v")).alias("low"), F.count(F.lit(1)).alias("n")))
        large = salted_join(around, low.select("u", "low"), "u", low).where("v > u")
        e = cut_lineage(large.select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct())
        low = cut_lineage(e.groupBy("u").agg(F.min("v").alias("low"), F.count(F.lit(1)).alias("n")))
        small = salted_join(e, low.select("u", "low"), "u", low).select(F.col("v").alias("u"), F.col("low").alias("v"))
        e = cut_lineage(small.unionByName(low.select("u", F.col("low").alias("v"))).where("u <> v").distinct())
        after = _state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components still moving after {rounds} rounds")
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return lone.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def communities(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """(node, community) by synchronous label propagation over symmetric ``edges``.

    A node takes the label with the largest summed weight among its neighbours, the lowest label on
    ties. Both steps are partial aggregations; a hub's edges are spread by the salted join.
    """
    degree = cut_lineage(edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")), "degree")
    labels = degree.select(F.col("src").alias("node"), F.col("src").alias("community"))
    for _ in range(rounds):
        sent = salted_join(edges, labels.withColumnRenamed("node", "src"), "src", degree)
        votes = sent.groupBy("dst", "community").agg(F.round(F.sum("weight"), DIGITS).cast("double").alias("w"))
        best = votes.groupBy("dst").agg(F.min(F.struct((-F.col("w")).alias("w"), "community")).alias("best"))
        labels = cut_lineage(best.select(F.col("dst").alias("node"), F.col("best.community").alias("community")))
    return labels


def contract(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges between communities, weights summed; inner edges vanish."""
    a = labels.select(F.col("node").alias("src"), F.col("community").alias("c_src"))
    b = labels.select(F.col("node").alias("dst"), F.col("community").alias("c_dst"))
    named = salted_join(salted_join(edges, a, "src"), b, "dst")
    return (
        named.where("c_src <> c_dst")
        .groupBy(F.col("c_src").alias("src"), F.col("c_dst").alias("dst"))
        .agg(F.round(F.sum("weight"), DIGITS).cast("double").alias("weight"))
    )


def community_levels(edges: DataFrame, levels: int = 2, rounds: int = 3) -> DataFrame:
    """(level, node, community): communities of the nodes, then of the contracted graph, and so on."""
    out, current = None, edges
    for level in range(1, levels + 1):
        labels = communities(current, rounds)
        part = labels.select(F.lit(level).alias("level"), "node", "community")
        out = part if out is None else out.unionByName(part)
        if level < levels:
            current = cut_lineage(contract(current, labels))
    return out


def community_summaries(edges: DataFrame, labels: DataFrame, n_terms: int = 3) -> DataFrame:
    """Per community: members, inner edges (each counted once) and its best-connected members."""
    size = labels.groupBy("community").agg(F.count(F.lit(1)).alias("n_members"))
    a = labels.select(F.col("node").alias("src"), F.col("community").alias("c_src"))
    b = labels.select(F.col("node").alias("dst"), F.col("community").alias("c_dst"))
    inner = salted_join(salted_join(edges, a, "src"), b, "dst").where("c_src = c_dst")
    degree = inner.groupBy(F.col("c_src").alias("community"), F.col("src").alias("node")).agg(
        F.count(F.lit(1)).alias("links"), F.sum("weight").alias("strength")
    )
    w = Window.partitionBy("community").orderBy(F.desc("strength"), "node")
    top = degree.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n_terms)
    terms = top.groupBy("community").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "node"))), lambda x: x["node"].cast("string")), " ").alias("top_terms")
    )
    counts = degree.groupBy("community").agg((F.sum("links") / 2).cast("long").alias("inner_edges"))
    return (
        size.join(counts, "community", "left")
        .join(terms, "community", "left")
        .select("community", "n_members", F.coalesce("inner_edges", F.lit(0)).alias("inner_edges"), F.coalesce("top_terms", F.lit("")).alias("top_terms"))
    )


def merge_graph_increment(old: DataFrame, new: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """Union of two node or edge tables, counts added: equal to building from all documents at once."""
    return old.unionByName(new).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])


# ---- subgraphs and paths --------------------------------------------------------------------


def k_hop(edges: DataFrame, seeds: DataFrame, k: int = 2) -> DataFrame:
    """(query_id, node, hop): nodes within ``k`` hops of the query's seeds, at their shortest distance."""
    degree = cut_lineage(edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")), "degree")
    links = edges.select("src", "dst")
    frontier = seeds.select("query_id", "node").distinct()
    seen = frontier.withColumn("hop", F.lit(0))
    for hop in range(1, k + 1):
        reached = salted_join(links, frontier.withColumnRenamed("node", "src"), "src", degree)
        fresh = reached.select("query_id", F.col("dst").alias("node")).distinct().join(seen.select("query_id", "node"), ["query_id", "node"], "left_anti")
        frontier = cut_lineage(fresh)
        seen = seen.unionByName(frontier.withColumn("hop", F.lit(hop)))
    return seen


def soft_prune(subgraph: DataFrame, scores: DataFrame, edges: DataFrame, keep: int) -> DataFrame:
    """Best ``keep`` nodes of each query's subgraph, and the edges that still join two of them."""
    scored = subgraph.join(scores, ["query_id", "node"]).withColumnRenamed("node", "item_id")
    kept = ranked(scored, keep).select("query_id", F.col("item_id").alias("node"), "score")
    links = salted_join(edges.select("src", "dst"), kept.select("query_id", F.col("node").alias("src"), F.col("score").alias("src_score")), "src")
    return links.join(kept.select("query_id", F.col("node").alias("dst"), F.col("score").alias("dst_score")), ["query_id", "dst"])


def relational_paths(edges: DataFrame, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """Paths of one to ``hops`` hops between each pair of a query's seeds, no node twice.

    ``edges`` hold both directions. A path's last step is checked against the edge table by both of
    its ends, so the rows handled for a pair stay below the number of edges, hubs included.
    """
    links = edges.select("src", "dst").distinct()
    degree = cut_lineage(links.groupBy("src").agg(F.count(F.lit(1)).alias("n")), "degree")
    s = seeds.select("query_id", F.col("node").alias("s")).distinct()
    pairs = s.join(s.select("query_id", F.col("s").alias("t")), "query_id").where("s < t")

    paths, rows = None, pairs.select("query_id", F.col("s").alias("at"), "t", F.array("s").alias("path"))
    for hop in range(hops):
        if hop:
            onward = links.select(F.col("src").alias("at"), F.col("dst").alias("to"))
            rows = salted_join(onward, rows, "at", degree.withColumnRenamed("src", "at"))
            rows = rows.where((F.col("to") != F.col("t")) & ~F.array_contains("path", F.col("to")))
            rows = rows.select("query_id", F.col("to").alias("at"), "t", F.array_append("path", F.col("to")).alias("path"))
        done = rows.join(links.select(F.col("src").alias("at"), F.col("dst").alias("t")), ["at", "t"])
        done = done.select("query_id", F.array_append("path", F.col("t")).alias("path"))
        paths = done if paths is None else paths.unionByName(done)
    return paths


def prune_paths(paths: DataFrame, scores: DataFrame, m: int = 5, alpha: float = 0.8) -> DataFrame:
    """Best ``m`` paths per query by alpha^(hops - 1) x mean node score, then listed short ones first."""
    named = paths.withColumn("name", F.array_join(F.transform("path", lambda x: x.cast("string")), "-"))
    nodes = named.select("query_id", "name", F.size("path").alias("size"), F.explode("path").alias("node"))
    mean = nodes.join(scores, ["query_id", "node"]).groupBy("query_id", "name", "size").agg(F.avg("score").alias("mean"))
    hops = F.col("size") - 1
    rows = mean.select("query_id", F.col("name").alias("item_id"), hops.alias("hops"), F.round(F.pow(F.lit(alpha), hops - 1) * F.col("mean"), DIGITS).alias("score"))
    kept = ranked(rows, m)
    w = Window.partitionBy("query_id").orderBy("hops", F.desc("score"), "item_id")
    return kept.withColumn("position", F.row_number().over(w)).withColumnRenamed("item_id", "path")


def best_paths(edges: DataFrame, seeds: DataFrame, scores: DataFrame, m: int = 5, hops: int = 3, alpha: float = 0.8, counts: list | None = None) -> DataFrame:
    """What ``prune_paths`` keeps of all ``relational_paths``, without listing them all.

    Short paths come first, and the m-th best score among a query's finished ones is its floor. An unfinished path goes on only if
    some length could still lift it to the floor: its nodes' scores so far, the target's, and the best of the query's
    node scores for every step between. Nodes without a score leave their paths' means, as in ``prune_paths``. ``counts`` takes the
    unfinished paths before and after each cut.
    """
    links = edges.select("src", "dst").distinct()
    degree = cut_lineage(links.groupBy("src").agg(F.count(F.lit(1)).alias("n")), "degree").withColumnRenamed("src", "at")
    value = cut_lineage(scores.groupBy("query_id", "node").agg(F.max("score").alias("score")), "scores")
    top = value.groupBy("query_id").agg(F.max("score").alias("top"))
    of = lambda node, name: value.select("query_id", F.col("node").alias(node), F.col("score").alias(name))
    s = seeds.select("query_id", F.col("node").alias("s")).distinct()
    pairs = s.join(s.select("query_id", F.col("s").alias("t")), "query_id").where("s < t")
    rows = pairs.join(of("s", "a"), ["query_id", "s"], "left").join(of("t", "last"), ["query_id", "t"], "left")
    rows = rows.join(top, "query_id", "left").select(
        "query_id", F.col("s").alias("at"), "t", F.array("s").alias("path"), F.coalesce("a", F.lit(0.0)).alias("sum"), F.col("a").isNotNull().cast("int").alias("n"),
        F.coalesce("last", F.lit(0.0)).alias("last"), F.col("last").isNotNull().cast("int").alias("n_last"), F.coalesce("top", F.lit(0.0)).alias("top"),
    )
    kept = None
    for hop in range(1, hops + 1):
        if hop > 1:
            onward = links.select(F.col("src").alias("at"), F.col("dst").alias("to"))
            rows = salted_join(onward, rows, "at", degree).where((F.col("to") != F.col("t")) & ~F.array_contains("path", F.col("to")))
            rows = rows.join(of("to", "score"), ["query_id", "to"], "left").select(
                "query_id", F.col("to").alias("at"), "t", F.array_append("path", F.col("to")).alias("path"), (F.col("sum") + F.coalesce("score", F.lit(0.0))).alias("sum"),
                (F.col("n") + F.col("score").isNotNull().cast("int")).alias("n"), "last", "n_last", "top",
            )
        rows = cut_lineage(rows, "paths")
        done = rows.join(links.select(F.col("src").alias("at"), F.col("dst").alias("t")), ["at", "t"])
        score = F.pow(F.lit(alpha), F.lit(hop - 1)) * (F.col("sum") + F.col("last")) / (F.col("n") + F.col("n_last"))
        name = F.array_join(F.transform(F.array_append("path", F.col("t")), lambda x: x.cast("string")), "-")
        found = done.where(F.col("n") + F.col("n_last") > 0).select("query_id", name.alias("item_id"), F.lit(hop).alias("hops"), F.round(score, DIGITS).alias("score"))
        kept = cut_lineage(ranked(found if kept is None else kept.unionByName(found), m).drop("rank"), "kept")
        if hop == hops:
            break
        full = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("k"), F.min("score").alias("floor")).where(F.col("k") >= m)
        # with j nodes to come between, the mean is highest when all of them have the best score, or none has any
        may = [
            F.pow(F.lit(alpha), F.lit(hop + j - 1)) * (F.col("sum") + F.col("last") + j * F.col("top")) / F.greatest(F.col("n") + F.col("n_last") + j, F.lit(1))
            for j in range(1, hops - hop + 1)
        ]
        may += [F.pow(F.lit(alpha), F.lit(hop)) * (F.col("sum") + F.col("last")) / F.greatest(F.col("n") + F.col("n_last"), F.lit(1))]
        open_ = rows.join(full.select("query_id", "floor"), "query_id", "left").where(F.greatest(*may, F.lit(0.0)) + 1e-5 >= F.coalesce("floor", F.lit(0.0)))
        open_ = cut_lineage(open_.drop("floor"), "open")
        if counts is not None:
            counts.append((hop, rows.count(), open_.count()))
        rows = open_
    w = Window.partitionBy("query_id").orderBy("hops", F.desc("score"), "item_id")
    return ranked(kept, m).withColumn("position", F.row_number().over(w)).withColumnRenamed("item_id", "path")


def _rooted(best: DataFrame) -> DataFrame:
    """(query_id, tree, root) where each tree points to another by its best edge: two that point to each other end the way, at the lower one."""
    point = lambda df, tree, to: df.select("query_id", F.col("tree").alias(tree), F.col("to").alias(to))
    ends = best.join(point(best, "to", "back"), ["query_id", "to"])
    up = cut_lineage(ends.select("query_id", "tree", F.when((F.col("back") == F.col("tree")) & (F.col("tree") < F.col("to")), F.col("tree")).otherwise(F.col("to")).alias("to")), "up")
    while True:  # the ways halve with every step
        further = cut_lineage(up.join(point(up, "to", "far"), ["query_id", "to"]), "further")
        up = further.select("query_id", "tree", F.col("far").alias("to"))
        if further.where("far <> to").isEmpty():
            return up.withColumnRenamed("to", "root")


def forest_and_trees(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The maximum spanning forest (query_id, src, dst, weight) and the tree of each node with an edge (query_id, node, tree)."""
    left = cut_lineage(edges.where("src <> dst").select("query_id", "src", "dst", "weight"), "edges")
    trees = left.select("query_id", F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("tree", F.col("node"))
    forest, left = left.where("false"), left.withColumns({"t_src": F.col("src"), "t_dst": F.col("dst")})
    while True:
        place = F.struct((-F.col("weight")).alias("w"), "src", "dst", "t_src", "t_dst")
        out = left.select("query_id", F.explode(F.array("t_src", "t_dst")).alias("tree"), place.alias("e"))
        best = cut_lineage(out.groupBy("query_id", "tree").agg(F.min("e").alias("e")).select("query_id", "tree", "e.*"), "best")
        if best.isEmpty():
            return forest, trees
        forest = forest.unionByName(best.select("query_id", "src", "dst", (-F.col("w")).alias("weight")).distinct())
        other = F.when(F.col("tree") == F.col("t_src"), F.col("t_dst")).otherwise(F.col("t_src"))
        roots = cut_lineage(_rooted(best.select("query_id", "tree", other.alias("to"))), "roots")
        trees = cut_lineage(trees.join(roots, ["query_id", "tree"], "left").select("query_id", "node", F.coalesce("root", "tree").alias("tree")), "trees")
        to = lambda end: roots.select("query_id", F.col("tree").alias(end), F.col("root").alias(f"{end}_root"))
        met = left.join(to("t_src"), ["query_id", "t_src"]).join(to("t_dst"), ["query_id", "t_dst"]).where("t_src_root <> t_dst_root")
        left = cut_lineage(met.select("query_id", "src", "dst", "weight", F.col("t_src_root").alias("t_src"), F.col("t_dst_root").alias("t_dst")), "edges")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(query_id, src, dst, weight): the maximum spanning forest of every query's graph, by Borůvka rounds for all queries at once.

    ``edges(query_id, src, dst, weight)`` hold a pair once, src < dst. Heavier edges come first, then lower src and dst, so
    that the forest is one and only. Each round every tree takes its best edge to another tree, and trees that touch are joined;
    their number halves at least.
    """
    return forest_and_trees(edges)[0]


# ---- search over graphs ---------------------------------------------------------------------


def asked_entities(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, entity): words of the query that are nodes of the graph."""
    words = queries.select("query_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("entity"))
    return words.join(nodes.select("entity"), "entity", "left_semi")


def chunk_scores(relevance: DataFrame, mentions: DataFrame, k: int | None) -> DataFrame:
    """Chunks ranked by the summed relevance (query_id, entity, r) of the entities they mention; no ``r`` is below 0.

    With ``k`` not every sum is formed. A query's most relevant entities alone give scores that its full ones reach at least, and the k-th of these
    is its floor. A chunk at or above it has an entity with its even share of the floor or more (chunks have at most ``most`` mentions), so only
    chunks of such entities are summed, over all their entities. A query without k such chunks has no floor and all its chunks are summed.
    """
    named = mentions.select("entity", "chunk_id")
    if k is None:
        return ranked(_summed(salted_join(named, relevance, "entity")), k)
    relevance = cut_lineage(relevance.select("query_id", "entity", "r"), "relevance")
    sizes = cut_lineage(named.groupBy("entity").agg(F.count(F.lit(1)).alias("n")), "sizes")
    most = named.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).scalar()
    top = relevance.groupBy("query_id").agg(F.max("r").alias("top"))
    lead = relevance.alias("a").join(top.alias("b"), F.col("a.query_id").eqNullSafe(F.col("b.query_id")) & (F.col("r") == F.col("top"))).select("a.query_id", "entity", "r")
    first = ranked(_summed(salted_join(named, lead, "entity", sizes)), k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor"))
    floor = cut_lineage(first.where(F.col("n") >= k).select(F.col("query_id").alias("of"), "floor"), "floor")
    # sums of doubles and the rounding of scores may differ by less than this
    share = (F.coalesce("floor", F.lit(0.0)) - 1e-5) / F.lit(most)
    strong = relevance.join(floor, F.col("query_id").eqNullSafe(F.col("of")), "left").where(F.col("r") >= share).select("query_id", "entity")
    asked = salted_join(named, cut_lineage(strong, "strong"), "entity", sizes).select("query_id", F.col("chunk_id").alias("item_id")).distinct()
    every = cut_lineage(asked, "asked").join(named, F.col("item_id").eqNullSafe(F.col("chunk_id"))).select("query_id", "chunk_id", F.col("entity").alias("named"))
    by_query = relevance.withColumnRenamed("query_id", "of")
    return ranked(_summed(every.join(by_query, F.col("query_id").eqNullSafe(F.col("of")) & (F.col("named") == F.col("entity")))), k)


def _summed(met: DataFrame) -> DataFrame:
    return met.groupBy("query_id", F.col("chunk_id").alias("item_id")).agg(F.round(F.sum("r"), DIGITS).alias("score"))


def local_search(queries: DataFrame, mentions: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """Entities named in the query count 1, their direct neighbours up to 0.5 by relative edge weight."""
    sym = both_ways(edges)
    direct = asked_entities(queries, build_nodes(mentions))
    strongest = sym.groupBy("src").agg(F.max("weight").alias("top"), F.count(F.lit(1)).alias("n"))
    rows = direct.withColumnRenamed("entity", "src").join(strongest.select("src", "top"), "src")
    near = salted_join(sym, rows, "src", strongest).select("query_id", F.col("dst").alias("entity"), (F.col("weight") / F.col("top") / 2).alias("r"))
    both = direct.withColumn("r", F.lit(1.0)).unionByName(near)
    return chunk_scores(both.groupBy("query_id", "entity").agg(F.max("r").alias("r")), mentions, k)


def global_search(queries: DataFrame, mentions: DataFrame, labels: DataFrame, n_communities: int = 3, per_community: int = 3, k: int = 5) -> DataFrame:
    """Communities scored by how many query words they hold; their best chunks are partial results,
    reduced to one ranking by community score times the chunk's member entities."""
    member = labels.select(F.col("node").alias("entity"), "community")
    asked = asked_entities(queries, member)
    matched = asked.join(member, "entity").groupBy("query_id", F.col("community").alias("item_id")).agg(F.count(F.lit(1)).cast("double").alias("score"))
    chosen = ranked(matched, n_communities).select("query_id", F.col("item_id").alias("community"), F.col("score").alias("c_score"))
    named = salted_join(mentions.select("entity", "chunk_id"), member, "entity")
    inside = named.groupBy("community", F.col("chunk_id").alias("item_id")).agg(F.count(F.lit(1)).cast("double").alias("score"))
    partial = ranked(inside, per_community, "community").select("community", "item_id", F.col("score").alias("members"))
    reduced = chosen.join(partial, "community").groupBy("query_id", "item_id").agg(F.sum(F.col("c_score") * F.col("members")).alias("score"))
    return ranked(reduced, k)


def dual_level_search(local: DataFrame, broad: DataFrame, k: int = 5) -> DataFrame:
    return lexical.fuse({"local": local, "global": broad}, k)


def expand_by_entities(seeds: DataFrame, mentions: DataFrame, edges: DataFrame, min_weight: int = 2, keep: int | None = None) -> DataFrame:
    """Chunks that share entities with the seed chunks, or hold entities linked to theirs.

    ``seeds(query_id, chunk_id)``; links below ``min_weight`` are chance meetings. The result has
    the number of shared and of linked entities per (query, chunk). With ``keep`` only the best chunks of a query by shared + linked / 2
    are returned, and only chunks that can be among them are counted.
    """
    owned = seeds.join(mentions, "chunk_id").select("query_id", "entity").distinct()
    strong = both_ways(edges.where(F.col("weight") >= min_weight))
    linked = salted_join(strong.select("src", "dst"), owned.withColumnRenamed("entity", "src"), "src").select("query_id", F.col("dst").alias("entity")).distinct()
    marked = owned.withColumn("shared", F.lit(1)).unionByName(
        linked.join(owned, ["query_id", "entity"], "left_anti").withColumn("shared", F.lit(0))
    )
    if keep is None:
        met = salted_join(mentions.select("entity", "chunk_id"), marked, "entity")
    else:
        marked = cut_lineage(marked, "marked")
        worth = marked.groupBy("query_id", "entity").agg(F.sum((1 + F.col("shared")) / 2).alias("r"))
        best = cut_lineage(chunk_scores(worth, mentions, keep).select(F.col("query_id").alias("of"), "item_id"), "best")
        named = best.join(mentions.select(F.col("entity").alias("named"), "chunk_id"), F.col("item_id").eqNullSafe(F.col("chunk_id")))
        met = named.join(marked, F.col("of").eqNullSafe(F.col("query_id")) & (F.col("named") == F.col("entity")))
    return met.groupBy("query_id", "chunk_id").agg(F.sum("shared").alias("shared"), F.sum(1 - F.col("shared")).alias("linked"))


def shared_entities(kept: DataFrame, mentions: DataFrame) -> DataFrame:
    """(query_id, src, dst, weight): how many entities two of a query's chunks share; each pair once. ``kept`` holds few chunks a query."""
    terms = kept.select("query_id", "chunk_id").join(mentions, "chunk_id").groupBy("query_id", "chunk_id").agg(F.collect_set("entity").alias("e"))
    # at most keep chunks per query: their pairs are bounded by keep squared
    other = terms.select("query_id", F.col("chunk_id").alias("dst"), F.col("e").alias("f"))
    pairs = terms.withColumnRenamed("chunk_id", "src").join(other, "query_id").where("src < dst")
    return pairs.select("query_id", "src", "dst", F.size(F.array_intersect("e", "f")).cast("long").alias("weight")).where("weight > 0")


def best_chunks(expanded: DataFrame, keep: int = 10) -> DataFrame:
    return ranked(expanded.withColumnRenamed("chunk_id", "item_id"), keep).withColumnRenamed("item_id", "chunk_id")


def organise_context(expanded: DataFrame, mentions: DataFrame, keep: int = 10) -> DataFrame:
    """Expanded chunks filtered, linked and arranged: (query_id, chunk_id, component, position).

    ``expanded(query_id, chunk_id, score)``. The ``keep`` best chunks of a query stay. Links by shared entities are thinned to the
    maximum spanning forest, which holds every chunk by its strongest links and leaves out the redundant ones. Trees are put
    together, the one with the best chunk first.
    """
    kept = cut_lineage(best_chunks(expanded, keep))
    _, trees = forest_and_trees(shared_entities(kept, mentions))
    lowest = F.min("node").over(Window.partitionBy("query_id", "tree"))
    parts = trees.select("query_id", F.col("node").alias("chunk_id"), lowest.alias("low"))
    named = kept.join(parts, ["query_id", "chunk_id"], "left").withColumn("component", F.concat_ws("|", "query_id", F.coalesce("low", "chunk_id")))
    lead = F.min("rank").over(Window.partitionBy("query_id", "component"))
    order = Window.partitionBy("query_id").orderBy("lead", "component", "chunk_id")
    return named.withColumn("lead", lead).withColumn("position", F.row_number().over(order)).select("query_id", "chunk_id", "component", "score", "position")


def graph_vector_search(hits: DataFrame, edges: DataFrame, hops: int = 1, k: int = 10, vector_share: float = 0.7) -> DataFrame:
    """Similarity hits and their graph neighbours in one ranking."""
    hits = cut_lineage(hits.select("query_id", "item_id", "score"), "hits")
    near = k_hop(edges, hits.select("query_id", F.col("item_id").alias("node")), hops).withColumnRenamed("node", "item_id")
    both = near.join(hits.select("query_id", "item_id", F.col("score").alias("s")), ["query_id", "item_id"], "left")
    score = vector_share * F.coalesce("s", F.lit(0.0)) + (1 - vector_share) / (1 + F.col("hop"))
    return ranked(both.select("query_id", "item_id", "hop", F.round(score, DIGITS + 2).alias("score")), k)


def node_scores(queries: DataFrame, items: DataFrame, wanted: DataFrame, scorer: Callable[[Column, Column], Column]) -> DataFrame:
    """(query_id, node, score) for the wanted (query_id, node) pairs only."""
    pairs = wanted.select("query_id", "node").distinct()
    q = queries.select("query_id", F.col("vec").alias("q_vec"))
    d = items.select(F.col("item_id").alias("node"), F.col("vec").alias("d_vec"))
    return pairs.join(q, "query_id").join(d, "node").select("query_id", "node", F.round(scorer(F.col("q_vec"), F.col("d_vec")), DIGITS).alias("score"))


