"""Entity graph over document chunks, and neighbour graphs over the stored vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagemill.catalog.base import block, query, sql, table
from passagemill.catalog.lexical_queries import W, asked
from passagemill.catalog.text_queries import doc_chunks
from passagemill.catalog.vector_queries import chunk_hits, items, self_hits, vec_queries
from passagemill.functions import vectors as V
from passagemill.operators import graph, modularity
from passagemill.plans.session import cut_lineage

# ---- text graph -----------------------------------------------------------------------------

block("ctf", f"SELECT chunk_id, t AS term, count(*) AS tf FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(sentence_chunk), {W})) AS t FROM ch) GROUP BY ALL", ("ch",))
block("cdf", "SELECT term, count(*) AS df FROM ctf GROUP BY term", ("ctf",))
block(
    "ment",
    """SELECT chunk_id, term AS entity, score FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, term) AS place FROM (
      SELECT chunk_id, term, round(tf * ln((SELECT count(*) FROM ch) / df), 6) AS score FROM ctf JOIN cdf USING (term))) WHERE place <= 5""",
    ("ctf", "cdf", "ch"),
)
block("edg", "SELECT a.entity AS src, b.entity AS dst, count(*) AS weight FROM ment a JOIN ment b ON a.chunk_id = b.chunk_id AND a.entity < b.entity GROUP BY ALL", ("ment",))
block("sym", "SELECT src, dst, weight FROM edg UNION ALL SELECT dst, src, weight FROM edg", ("edg",))


def label_blocks(prefix: str, edges: str, rounds: int) -> str:
    """Unrolled label propagation; returns the block with (node, community)."""
    block(f"{prefix}0", f"SELECT DISTINCT src AS node, src AS community FROM {edges}", (edges,))
    for i in range(1, rounds + 1):
        block(
            f"{prefix}{i}",
            f"""SELECT node, community FROM (SELECT dst AS node, community, row_number() OVER (PARTITION BY dst ORDER BY w DESC, community) AS r FROM (
              SELECT dst, community, round(sum(weight), 6)::DOUBLE AS w FROM {edges} JOIN {prefix}{i - 1} ON node = src GROUP BY ALL)) WHERE r = 1""",
            (edges, f"{prefix}{i - 1}"),
        )
    return f"{prefix}{rounds}"


TEXT_LABELS = label_blocks("tl", "sym", 2)


def mentions(spark, sf):
    """Extracted once and kept in the shared folder: every graph step reads them several times."""
    return cut_lineage(graph.extract_entities(doc_chunks(spark, sf).select("chunk_id", "sentence_chunk")))


def text_edges(m):
    return cut_lineage(graph.build_edges(m))


def text_labels(edges):
    return graph.communities(graph.both_ways(edges), 2)


@query("extract_entities", sql("SELECT * FROM ment", "ment"))
def _(spark, sf):
    return graph.extract_entities(doc_chunks(spark, sf).select("chunk_id", "sentence_chunk"))


@query("build_edges", sql("SELECT * FROM edg", "edg"))
def _(spark, sf):
    return graph.build_edges(mentions(spark, sf))


@query(
    "merge_entities",
    r"""WITH m AS (SELECT conv_id || ':' || turn AS chunk_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS f FROM conversations),
    w AS (SELECT chunk_id, f, lower(f) AS entity FROM m)
    SELECT entity, count(DISTINCT f) AS n_forms, count(*) AS n_mentions, min(f) AS first_form, count(DISTINCT chunk_id) AS n_segments FROM w GROUP BY entity""",
)
def _(spark, sf):
    words = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    rows = table(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("chunk_id"), F.explode(words).alias("entity"))
    return graph.merge_entities(rows)


@query(
    "entity_profiles",
    sql(
        """SELECT entity, string_agg(sentence_chunk, chr(10) ORDER BY place) AS profile FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score DESC, chunk_id) AS place
        FROM ment) JOIN ch USING (chunk_id) WHERE place <= 3 GROUP BY entity""",
        "ment",
    ),
)
def _(spark, sf):
    return graph.entity_profiles(mentions(spark, sf), doc_chunks(spark, sf))


@query(
    "community_summaries",
    sql(
        f""", i AS (SELECT a.community, src, weight FROM sym JOIN {TEXT_LABELS} a ON a.node = src JOIN {TEXT_LABELS} b ON b.node = dst WHERE a.community = b.community),
        d AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY strength DESC, src) AS place FROM (
          SELECT community, src, count(*) AS links, sum(weight) AS strength FROM i GROUP BY ALL)),
        t AS (SELECT community, sum(links) // 2 AS inner_edges, string_agg(src, ' ' ORDER BY place) FILTER (WHERE place <= 3) AS top_terms FROM d GROUP BY community)
        SELECT community, n_members, coalesce(inner_edges, 0)::BIGINT AS inner_edges, coalesce(top_terms, '') AS top_terms
        FROM (SELECT community, count(*) AS n_members FROM {TEXT_LABELS} GROUP BY community) LEFT JOIN t USING (community)""",
        "sym",
        TEXT_LABELS,
    ),
)
def _(spark, sf):
    edges = text_edges(mentions(spark, sf))
    return graph.community_summaries(graph.both_ways(edges), text_labels(edges))


RANKED = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM ({})) WHERE rank <= {}"""
block("qe", f"SELECT DISTINCT query_id, entity FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), {W})) AS entity FROM benchmark) WHERE entity IN (SELECT entity FROM ment)", ("ment",))
block(
    "loc",
    RANKED.format(
        """SELECT query_id, chunk_id AS item_id, round(sum(r), 6) AS score FROM ment JOIN (SELECT query_id, entity, max(r) AS r FROM (
      SELECT query_id, entity, 1.0::DOUBLE AS r FROM qe UNION ALL SELECT query_id, dst, weight / top::DOUBLE / 2 FROM sym JOIN (SELECT src, max(weight) AS top FROM sym GROUP BY src) USING (src)
      JOIN qe ON qe.entity = src) GROUP BY ALL) USING (entity) GROUP BY ALL""",
        5,
    ),
    ("qe", "sym", "ment"),
)
block(
    "glo",
    RANKED.format(
        f"""SELECT query_id, item_id, sum(c_score * members) AS score FROM (
      SELECT query_id, community, c_score FROM (SELECT query_id, community, count(*)::DOUBLE AS c_score, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, community) AS r
        FROM qe JOIN {TEXT_LABELS} ON node = entity GROUP BY query_id, community) WHERE r <= 3)
      JOIN (SELECT community, chunk_id AS item_id, count(*)::DOUBLE AS members, row_number() OVER (PARTITION BY community ORDER BY count(*) DESC, chunk_id) AS r
        FROM ment JOIN {TEXT_LABELS} ON node = entity GROUP BY community, chunk_id) USING (community) WHERE r <= 3 GROUP BY query_id, item_id""",
        5,
    ),
    ("qe", "ment", TEXT_LABELS),
)


def text_local(spark, sf, m, edges):
    return graph.local_search(asked(spark, sf), m, edges)


def text_global(spark, sf, m, edges):
    return graph.global_search(asked(spark, sf), m, text_labels(edges))


@query("local_search", sql("SELECT * FROM loc", "loc"))
def _(spark, sf):
    m = mentions(spark, sf)
    return text_local(spark, sf, m, text_edges(m))


@query("global_search", sql("SELECT * FROM glo", "glo"))
def _(spark, sf):
    m = mentions(spark, sf)
    return text_global(spark, sf, m, text_edges(m))


@query(
    "dual_level_search",
    sql(
        RANKED.format(
            """SELECT query_id, item_id, round(sum(p), 6) AS score FROM (SELECT query_id, item_id, 1.0::DOUBLE / (60 + rank) AS p FROM loc
        UNION ALL SELECT query_id, item_id, 1.0::DOUBLE / (60 + rank) FROM glo) GROUP BY ALL""",
            5,
        ),
        "loc",
        "glo",
    ),
)
def _(spark, sf):
    m = mentions(spark, sf)
    edges = text_edges(m)
    return graph.dual_level_search(text_local(spark, sf, m, edges), text_global(spark, sf, m, edges))


LONG_SQL = f"""SELECT chunk_id, unnest(list_slice(list_sort(list_transform(list_filter(list_distinct(regexp_extract_all(lower(sentence_chunk), {W})), lambda t: length(t) >= 8),
    lambda t: struct_pack(o := -length(t), entity := t))), 1, 5)).entity AS entity FROM ch"""


@query(
    "merge_graph_increment",
    sql(
        f""", m AS ({LONG_SQL}) SELECT 'node' AS part, entity AS src, '' AS dst, count(*)::BIGINT AS n FROM m GROUP BY entity
        UNION ALL SELECT 'edge', a.entity, b.entity, count(*) FROM m a JOIN m b ON a.chunk_id = b.chunk_id AND a.entity < b.entity GROUP BY ALL""",
        "ch",
    ),
)
def _(spark, sf):
    """Documents with even ids first, odd ids added later; the oracle builds from all at once."""
    chunks = doc_chunks(spark, sf)
    halves = [graph.long_word_entities(chunks.where(F.col("doc_id") % 2 == i)) for i in (0, 1)]
    nodes = graph.merge_graph_increment(*[graph.build_nodes(h) for h in halves], ["entity"], ["n_chunks"])
    edges = graph.merge_graph_increment(*[graph.build_edges(h) for h in halves], ["src", "dst"], ["weight"])
    return nodes.select(F.lit("node").alias("part"), F.col("entity").alias("src"), F.lit("").alias("dst"), F.col("n_chunks").alias("n")).unionByName(
        edges.select(F.lit("edge").alias("part"), "src", "dst", F.col("weight").alias("n"))
    )


block(
    "exp",
    """SELECT query_id, m.chunk_id, sum(shared)::BIGINT AS shared, sum(1 - shared)::BIGINT AS linked FROM ment m JOIN (
      SELECT query_id, entity, max(shared) AS shared FROM (SELECT query_id, entity, 1 AS shared FROM chunk5 JOIN ment ON chunk_id = item_id
        UNION SELECT query_id, dst, 0 FROM chunk5 JOIN ment ON chunk_id = item_id JOIN sym ON src = entity WHERE weight >= 2) GROUP BY ALL) USING (entity) GROUP BY ALL""",
    ("chunk5", "ment", "sym"),
)


def expanded(spark, sf, m, keep=None):
    seeds = cut_lineage(chunk_hits(spark, sf).select("query_id", F.col("item_id").alias("chunk_id")))
    return graph.expand_by_entities(seeds, m, text_edges(m), keep=keep)


@query("expand_by_entities", sql("SELECT * FROM exp", "exp"))
def _(spark, sf):
    return expanded(spark, sf, mentions(spark, sf))


block(
    "kp",
    """SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
      SELECT query_id, chunk_id, shared + linked / 2::DOUBLE AS score FROM exp)) WHERE rank <= 10""",
    ("exp",),
)
block("ke", "SELECT query_id, chunk_id, list(entity) AS e FROM kp JOIN ment USING (chunk_id) GROUP BY ALL", ("kp", "ment"))
block(
    "kl",
    """SELECT a.query_id, a.chunk_id, b.chunk_id AS other, len(list_intersect(a.e, b.e)) AS n FROM ke a JOIN ke b ON a.query_id = b.query_id AND a.chunk_id <> b.chunk_id
      WHERE len(list_intersect(a.e, b.e)) > 0""",
    ("ke",),
)
block("ks", "SELECT query_id, chunk_id AS a, other AS b FROM kl UNION SELECT query_id, other, chunk_id FROM kl", ("kl",))
block(
    "reach",
    "SELECT query_id, chunk_id AS a, chunk_id AS b FROM kp UNION SELECT r.query_id, r.a, s.b FROM reach r JOIN ks s ON s.query_id = r.query_id AND s.a = r.b",
    ("kp", "ks"),
)


@query(
    "organise_context",
    sql(
        """SELECT query_id, chunk_id, query_id || '|' || low AS component, score, row_number() OVER (PARTITION BY query_id ORDER BY lead, low, chunk_id) AS position
        FROM (SELECT *, min(rank) OVER (PARTITION BY query_id, low) AS lead FROM kp JOIN (SELECT query_id, a AS chunk_id, min(b) AS low FROM reach GROUP BY ALL) USING (query_id, chunk_id))""",
        "reach",
        recursive=True,
    ),
)
def _(spark, sf):
    m = mentions(spark, sf)
    scored = expanded(spark, sf, m, 10).select("query_id", "chunk_id", (F.col("shared") + F.col("linked") / 2).alias("score"))
    return graph.organise_context(scored, m, 10)


@query(
    "context_forest",
    sql(
        """, e AS (SELECT query_id, chunk_id AS src, other AS dst, n AS weight, row_number() OVER (PARTITION BY query_id ORDER BY n, chunk_id DESC, other DESC) AS r
          FROM kl WHERE chunk_id < other),
        s AS (SELECT query_id, src AS a, dst AS b, r FROM e UNION ALL SELECT query_id, dst, src, r FROM e),
        w AS (SELECT query_id, a, b, r FROM s UNION SELECT w.query_id, w.a, s.b, least(w.r, s.r) FROM w JOIN s ON s.query_id = w.query_id AND s.a = w.b AND s.b <> w.a)
        SELECT query_id, src, dst, weight FROM e WHERE r = (SELECT max(w.r) FROM w WHERE w.query_id = e.query_id AND w.a = e.src AND w.b = e.dst)""",
        "kl",
        recursive=True,
    ),
)
def _(spark, sf):
    """The skeleton of each query's best chunks. In SQL an edge is in it if no way between its ends has better edges only."""
    m = mentions(spark, sf)
    scored = expanded(spark, sf, m).select("query_id", "chunk_id", (F.col("shared") + F.col("linked") / 2).alias("score"))
    kept = cut_lineage(graph.best_chunks(scored))
    return graph.spanning_forest(graph.shared_entities(kept, m))


# ---- vector graph ---------------------------------------------------------------------------

block("vg", "SELECT a.query_id AS src, a.item_id AS dst, a.score AS weight FROM self5 a JOIN self5 b ON a.query_id = b.item_id AND a.item_id = b.query_id", ("self5",))
block("sg", "SELECT query_id AS src, item_id AS dst FROM self5 WHERE rank = 1", ("self5",))


def stored_hits(spark, sf):
    """Searched once: the graph, its seeds and the rankings over it read the same hits."""
    return cut_lineage(self_hits(spark, sf), "hits")


def vector_graph(spark, sf, hits=None):
    return cut_lineage(graph.mutual_neighbours(self_hits(spark, sf) if hits is None else hits))


def sparse_graph(spark, sf):
    return self_hits(spark, sf, 1).select(F.col("query_id").alias("src"), F.col("item_id").alias("dst"), F.col("score").alias("weight"))


@query(
    "semantic_edges",
    sql(
        """, r AS (SELECT min(k) AS k, vec FROM em GROUP BY vec)
        SELECT * FROM (SELECT a.k AS src, b.k AS dst, round(list_cosine_similarity(a.vec, b.vec), 6) AS weight FROM r a, r b WHERE a.k < b.k) WHERE weight >= 0.3
        UNION ALL SELECT r.k, em.k, 1.0 FROM em JOIN r USING (vec) WHERE em.k <> r.k""",
        "em",
    ),
)
def _(spark, sf):
    return graph.semantic_edges(items(spark, sf), 0.3)


@query(
    "connected_components",
    sql(
        """, b AS (SELECT src, dst FROM sg UNION SELECT dst, src FROM sg), r AS (SELECT DISTINCT src AS node, src AS seen FROM b UNION SELECT r.node, b.dst FROM r JOIN b ON b.src = r.seen)
        SELECT node, min(seen) AS component FROM r GROUP BY node""",
        "sg",
        recursive=True,
    ),
)
def _(spark, sf):
    return graph.connected_components(sparse_graph(spark, sf))


VEC_LABELS = label_blocks("vl", "vg", 3)


@query("communities", sql(f"SELECT * FROM {VEC_LABELS}", VEC_LABELS))
def _(spark, sf):
    return graph.communities(vector_graph(spark, sf), 3)


L1 = label_blocks("va", "vg", 2)
block("vc", f"SELECT a.community AS src, b.community AS dst, round(sum(weight), 6) AS weight FROM vg JOIN {L1} a ON a.node = src JOIN {L1} b ON b.node = dst WHERE a.community <> b.community GROUP BY ALL", ("vg", L1))
L2 = label_blocks("vb", "vc", 2)


@query("community_levels", sql(f"SELECT 1 AS level, node, community FROM {L1} UNION ALL SELECT 2, node, community FROM {L2}", L1, L2))
def _(spark, sf):
    return graph.community_levels(vector_graph(spark, sf), 2, 2)


@query(
    "community_quality",
    sql(
        f""", e AS (SELECT src, dst, round(weight * 1000000)::BIGINT AS w FROM vg),
        l AS (SELECT a.community, sum(w) FILTER (WHERE a.community = b.community) AS i, sum(w) AS t FROM e JOIN {VEC_LABELS} a ON a.node = src JOIN {VEC_LABELS} b ON b.node = dst GROUP BY a.community)
        SELECT community, n_members, coalesce(i, 0)::DOUBLE / 1000000 AS inner_weight, t::DOUBLE / 1000000 AS total_weight,
          round(coalesce(i, 0)::DOUBLE / m - pow(t::DOUBLE / m, 2), 9) AS modularity
        FROM (SELECT community, count(*) AS n_members FROM {VEC_LABELS} GROUP BY community) JOIN l USING (community), (SELECT sum(w)::DOUBLE AS m FROM e)""",
        "vg",
        VEC_LABELS,
    ),
)
def _(spark, sf):
    edges = vector_graph(spark, sf)
    return modularity.community_quality(edges, graph.communities(edges, 3))


@query("modular_levels")
def _(spark, sf):
    """Communities by local moves and refinement; tests hold them against the best partition and label propagation."""
    return modularity.modular_levels(vector_graph(spark, sf))


block(
    "hop2",
    """SELECT query_id, node, min(hop) AS hop FROM (SELECT DISTINCT src AS query_id, src AS node, 0 AS hop FROM vg
      UNION ALL SELECT src, dst, 1 FROM vg UNION ALL SELECT a.src, b.dst, 2 FROM vg a JOIN vg b ON b.src = a.dst) GROUP BY ALL""",
    ("vg",),
)


def own_seeds(edges):
    """Every node asks for its own surroundings."""
    return edges.select(F.col("src").alias("query_id"), F.col("src").alias("node")).distinct()


@query("k_hop", sql("SELECT * FROM hop2", "hop2"))
def _(spark, sf):
    edges = vector_graph(spark, sf)
    return graph.k_hop(edges, own_seeds(edges), 2)


@query(
    "soft_prune",
    sql(
        """, s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) AS r FROM (
          SELECT query_id, node, round(list_dot_product(a.vec, b.vec), 6) AS score FROM hop2 JOIN em a ON a.k = query_id JOIN em b ON b.k = node)),
        p AS (SELECT * FROM s WHERE r <= 6)
        SELECT a.query_id, src, dst, a.score AS src_score, b.score AS dst_score FROM vg JOIN p a ON a.node = src JOIN p b ON b.node = dst AND b.query_id = a.query_id""",
        "hop2",
        "em",
    ),
)
def _(spark, sf):
    edges = vector_graph(spark, sf)
    around = graph.k_hop(edges, own_seeds(edges), 2)
    scores = graph.node_scores(vec_queries(spark, sf), items(spark, sf), around, V.dot_product)
    return graph.soft_prune(around, scores, edges, 6)


block("prs", "SELECT a.query_id, a.item_id AS s, b.item_id AS t FROM self5 a JOIN self5 b ON a.query_id = b.query_id AND a.item_id < b.item_id WHERE a.rank <= 4 AND b.rank <= 4", ("self5",))
block(
    "pth",
    """SELECT query_id, [s, t] AS path FROM prs JOIN vg ON src = s AND dst = t
      UNION ALL SELECT query_id, [s, x.dst, t] FROM prs JOIN vg x ON x.src = s JOIN vg y ON y.src = x.dst AND y.dst = t WHERE x.dst <> t AND x.dst <> s
      UNION ALL SELECT query_id, [s, x.dst, y.dst, t] FROM prs JOIN vg x ON x.src = s JOIN vg y ON y.src = x.dst JOIN vg z ON z.src = y.dst AND z.dst = t
        WHERE x.dst <> t AND y.dst <> s AND y.dst <> t""",
    ("prs", "vg"),
)


def seed_nodes(hits):
    return hits.where("rank <= 4").select("query_id", F.col("item_id").alias("node"))


@query("relational_paths", sql("SELECT query_id, array_to_string(path, '-') AS path FROM pth", "pth"))
def _(spark, sf):
    hits = stored_hits(spark, sf)
    paths = graph.relational_paths(vector_graph(spark, sf, hits), seed_nodes(hits))
    return paths.select("query_id", F.array_join(F.transform("path", lambda x: x.cast("string")), "-").alias("path"))


PRUNED_SQL = sql(
        """, n AS (SELECT query_id, path AS p, unnest(path) AS node FROM pth), m AS (SELECT query_id, p, avg(round(list_dot_product(a.vec, b.vec), 6)) AS mean
          FROM n JOIN em a ON a.k = query_id JOIN em b ON b.k = node GROUP BY ALL),
        s AS (SELECT query_id, array_to_string(p, '-') AS path, (len(p) - 1)::INT AS hops, round(pow(0.8::DOUBLE, len(p) - 2) * mean, 6) AS score FROM m),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM s)
        SELECT query_id, path, hops, score, rank, row_number() OVER (PARTITION BY query_id ORDER BY hops, score DESC, path) AS position FROM r WHERE rank <= 5""",
        "pth",
        "em",
)


@query("prune_paths", PRUNED_SQL)
def _(spark, sf):
    hits = stored_hits(spark, sf)
    paths = graph.relational_paths(vector_graph(spark, sf, hits), seed_nodes(hits))
    on_paths = paths.select("query_id", F.explode("path").alias("node"))
    scores = graph.node_scores(vec_queries(spark, sf), items(spark, sf), on_paths, V.dot_product)
    return graph.prune_paths(paths, scores)


@query("best_paths", PRUNED_SQL)
def _(spark, sf):
    """The same paths, found without listing all of them."""
    hits = stored_hits(spark, sf)
    links, seeds = vector_graph(spark, sf, hits), seed_nodes(hits)
    near = graph.k_hop(links, seeds, 3).select("query_id", "node")
    scores = graph.node_scores(vec_queries(spark, sf), items(spark, sf), near, V.dot_product)
    return graph.best_paths(links, seeds, scores)


@query(
    "graph_vector_search",
    sql(
        RANKED.format(
            """SELECT query_id, item_id, hop, round(0.7::DOUBLE * coalesce(h.score, 0) + 0.3::DOUBLE / (1 + hop), 8) AS score FROM (SELECT query_id, node AS item_id, min(hop) AS hop FROM (
        SELECT query_id, item_id AS node, 0 AS hop FROM self5 UNION ALL SELECT query_id, dst, 1 FROM self5 JOIN vg ON src = item_id) GROUP BY ALL) LEFT JOIN self5 h USING (query_id, item_id)""",
            10,
        ),
        "vg",
    ),
)
def _(spark, sf):
    hits = stored_hits(spark, sf)
    return graph.graph_vector_search(hits, vector_graph(spark, sf, hits))
