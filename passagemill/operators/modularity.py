"""Communities by modularity: local moves, a refinement into connected parts, and the graph of the parts, level by level.

Edges are symmetric (src, dst, weight). Weights become whole millionths, so sums do not depend on their order; edges without
a positive weight count as absent. Every round is a written table; joins on a node go through ``salted_join``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.operators.graph import connected_components
from passagemill.operators.search import DIGITS
from passagemill.plans.session import cut_lineage
from passagemill.plans.skew import salted_join


def whole_weights(edges: DataFrame) -> DataFrame:
    """(src, dst, w) with one row per ordered pair."""
    w = F.round(F.col("weight") * 10**DIGITS).cast("long")
    return edges.select("src", "dst", w.alias("w")).where("w > 0").groupBy("src", "dst").agg(F.sum("w").alias("w"))


def community_quality(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(community, n_members, inner_weight, total_weight, modularity): what each community adds to the modularity.

    Weights count in both directions, so ``inner_weight`` is twice that of the edges inside. An empty graph has no rows.
    """
    links = cut_lineage(whole_weights(edges), "links")
    all_weight = links.agg(F.sum("w")).first()[0] or 0
    ends = salted_join(salted_join(links, labels.toDF("src", "c_src"), "src"), labels.toDF("dst", "c_dst"), "dst")
    sums = ends.groupBy(F.col("c_src").alias("community")).agg(
        F.sum(F.when(F.col("c_src") == F.col("c_dst"), F.col("w")).otherwise(0)).alias("inner"), F.sum("w").alias("total")
    )
    sizes = labels.groupBy("community").agg(F.count(F.lit(1)).alias("n_members"))
    inner, total = F.coalesce("inner", F.lit(0)), F.coalesce("total", F.lit(0))
    share = inner / F.lit(float(all_weight or 1)) - resolution * F.pow(total / F.lit(float(all_weight or 1)), F.lit(2.0))
    return sizes.join(sums, "community", "left").select(
        "community", "n_members", (inner / 10**DIGITS).alias("inner_weight"), (total / 10**DIGITS).alias("total_weight"), F.round(share, 9).alias("modularity")
    )


def _one_in(n: int, column: str, turn: int) -> Column:
    return F.pmod(F.xxhash64(column, F.lit(turn)), F.lit(n)) == 0


def _labelled(state: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """(``label``, tot, size), and ``state`` with these of its label in each row; a label may hold a third of all nodes."""
    totals = cut_lineage(state.groupBy(label).agg(F.sum("k").alias("tot"), F.count(F.lit(1)).alias("size")), "totals")
    return totals, cut_lineage(salted_join(state, totals, label, totals, "size"), "state")


def _ties(links: DataFrame, wide: DataFrame, degrees: DataFrame, label: str) -> DataFrame:
    """(node, label, w, tot, size): how strongly a node is tied to each neighbouring community, from partial sums."""
    there = wide.select(F.col("node").alias("dst"), label, "tot", "size")
    sums = salted_join(links, there, "dst", degrees).groupBy(F.col("src").alias("node"), label)
    return sums.agg(F.sum("w").alias("w"), F.max("tot").alias("tot"), F.max("size").alias("size"))


def _offers(links: DataFrame, state: DataFrame, degrees: DataFrame, sums: tuple[int, int], resolution: float) -> tuple[DataFrame, DataFrame, float]:
    """The state stored, each node's best move with a gain, and the modularity of the state; ``sums``: all weights, those of loops.

    The gain is exact for a node that moves alone: 2m (ties there - ties here) - resolution x degree x (total there - total here + degree).
    """
    whole = float(sums[0])
    totals, wide = _labelled(state, "community")
    own = wide.select("node", "k", F.col("community").alias("home"), F.col("tot").alias("tot_home"), F.col("size").alias("size_home"))
    seen = cut_lineage(_ties(links, wide, degrees, "community").join(own, "node"), "ties")
    inside = seen.where("community = home").select("node", F.col("w").alias("w_home"))
    squares = totals.select((F.pow(F.col("tot") / F.lit(whole), F.lit(2.0)) * -resolution).alias("q"))
    q = squares.unionByName(inside.select((F.col("w_home") / F.lit(whole)).alias("q"))).agg(F.sum("q")).first()[0] or 0.0
    gain = F.lit(whole) * (F.col("w") - F.coalesce("w_home", F.lit(0))) - resolution * F.col("k").cast("double") * (F.col("tot") - F.col("tot_home") + F.col("k"))
    # two lone nodes would swap for ever: the one with the higher label moves
    apart = ~((F.col("size") == 1) & (F.col("size_home") == 1) & (F.col("community") > F.col("home")))
    rated = seen.where("community <> home").join(inside, "node", "left").withColumn("gain", gain).where((F.col("gain") > 0) & apart)
    best = rated.groupBy("node", "home").agg(F.min(F.struct((-F.col("gain")).alias("loss"), F.col("community").alias("to"))).alias("b"))
    return wide.drop("tot", "size"), cut_lineage(best.select("node", "home", "b.to", "b.loss"), "offers"), q + sums[1] / whole


def _apart(offers: DataFrame) -> DataFrame:
    """Offers of which no two touch the same community, each the best of both its ends: their gains add up exactly."""
    order = F.struct("loss", "node")
    ends = offers.select(F.explode(F.array("home", "to")).alias("end"), order.alias("o"))
    first = ends.groupBy("end").agg(F.min("o").alias("o")).select(F.col("o.node").alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    return offers.join(first.where("n = 2"), "node").drop("n")


def local_moves(
    links: DataFrame, state: DataFrame, all_weight: int, resolution: float = 1.0, tolerance: float = 1e-3, rounds: int = 4
) -> tuple[DataFrame, float, float]:
    """Move nodes to the neighbouring community with the largest gain; returns the state, its modularity and that before.

    In a round all nodes with a gain move at once. When that first lowers the modularity, the round is taken back and from then on the
    half that a hash names moves; when that lowers it too, moves that share no community, which can only raise it. Ends when a
    round raises it by less than ``tolerance``, when no move gains, or after ``rounds``.
    """
    degrees = cut_lineage(links.groupBy("dst").agg(F.count(F.lit(1)).alias("n")), "degrees")
    sums = all_weight, state.agg(F.sum("loops")).first()[0] or 0
    state, offers, q = _offers(links, state, degrees, sums, resolution)
    start, mode = q, 0
    for turn in range(rounds):
        if offers.isEmpty():
            break
        gained = -1.0
        while gained < 0 and mode < 3:
            chosen = (offers, offers.where(_one_in(2, "node", turn)), _apart(offers))[mode]
            moved = state.join(chosen.select("node", "to"), "node", "left").withColumn("community", F.coalesce("to", "community")).drop("to")
            tried = _offers(links, moved, degrees, sums, resolution)
            gained = tried[2] - q
            mode += gained < 0
        if gained < 0:
            break  # rounding alone can bring it here
        state, offers, q = tried
        if gained < tolerance:
            break
    return state, q, start


def refine(links: DataFrame, state: DataFrame, all_weight: int, resolution: float = 1.0, rounds: int = 2) -> DataFrame:
    """(node, k, loops, community, part): communities cut into parts, every part connected.

    All nodes begin alone. In a round a hash names the quarter of the parts that stay; a node still alone among the others joins the staying part it gains most with, to which it has an edge, so parts grow connected and never break.
    """
    parts, c = state.withColumn("part", F.col("node")), state.select("node", "community")
    inside = salted_join(salted_join(links, c.toDF("src", "c_src"), "src"), c.toDF("dst", "c_dst"), "dst").where("c_src = c_dst").select("src", "dst", "w")
    inside = cut_lineage(inside, "inside")
    degrees = cut_lineage(inside.groupBy("dst").agg(F.count(F.lit(1)).alias("n")), "degrees")
    for turn in range(rounds):
        _, wide = _labelled(parts, "part")
        alone = wide.where((F.col("size") == 1) & ~_one_in(4, "part", turn)).select("node", "k")
        ties = _ties(inside, wide, degrees, "part").where(_one_in(4, "part", turn)).join(alone, "node")
        gain = F.lit(float(all_weight)) * F.col("w") - resolution * F.col("k").cast("double") * F.col("tot")
        best = ties.withColumn("gain", gain).where("gain > 0").groupBy("node").agg(F.min(F.struct((-F.col("gain")).alias("loss"), F.col("part").alias("to"))).alias("b"))
        joined = wide.drop("tot", "size").join(best.select("node", "b.to"), "node", "left")
        parts = joined.withColumn("part", F.coalesce("to", "part")).drop("to")
    return cut_lineage(parts, "parts")


def _contract(links: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph of the parts: links between them, and a state that begins with the communities found so far."""
    p = parts.select("node", "part")
    named = salted_join(salted_join(links, p.toDF("src", "p_src"), "src"), p.toDF("dst", "p_dst"), "dst")
    between = cut_lineage(named.groupBy(F.col("p_src").alias("src"), F.col("p_dst").alias("dst")).agg(F.sum("w").alias("w")), "contracted")
    loops = between.where("src = dst").select(F.col("src").alias("node"), F.col("w").alias("inner"))
    sums = parts.groupBy(F.col("part").alias("node")).agg(F.sum("k").alias("k"), F.sum("loops").alias("loops"), F.min("community").alias("community"))
    state = sums.join(loops, "node", "left").select("node", "k", (F.col("loops") + F.coalesce("inner", F.lit(0))).alias("loops"), "community")
    return between.where("src <> dst"), cut_lineage(state, "state")


def modular_levels(edges: DataFrame, resolution: float = 1.0, tolerance: float = 1e-3, levels: int = 32, rounds: int = 4) -> DataFrame:
    """(level, node, community), nested, finest first; the last level holds the communities, all of them connected.

    Each level is local moves, a refinement, and the graph of the refined parts, until a level's moves raise the modularity by less than
    ``tolerance`` (at most ``levels``). At the end communities fall into their connected pieces, which can only raise it. A community is
    named after its lowest node. Nodes are those of ``edges``; one without a positive weight, or with a loop alone, is its own community.
    """
    both = cut_lineage(whole_weights(edges), "links")
    named = cut_lineage(edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).where("node IS NOT NULL").distinct(), "nodes")
    all_weight = both.agg(F.sum("w")).first()[0]
    if not all_weight:
        return named.select(F.lit(1).alias("level"), "node", F.col("node").alias("community"))
    sums = both.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("w")).otherwise(0)).alias("loops"))
    state = named.join(sums, "node", "left").select(
        "node", F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("loops", F.lit(0)).alias("loops"), F.col("node").alias("community")
    )
    links, state = cut_lineage(both.where("src <> dst"), "links"), cut_lineage(state, "state")
    member, found = named.withColumn("at", F.col("node")), []
    first = links
    for _ in range(levels):
        state, reached, before = local_moves(links, state, all_weight, resolution, tolerance, rounds)
        if found and reached - before < tolerance:
            break
        parts = refine(links, state, all_weight, resolution)
        member = cut_lineage(member.withColumnRenamed("at", "was").join(parts.select(F.col("node").alias("was"), "part"), "was").select("node", F.col("part").alias("at")), "member")
        found.append(member)
        links, state = _contract(links, parts)
    last = cut_lineage(member.join(state.select(F.col("node").alias("at"), "community"), "at").select("node", "community"), "last")
    inner = salted_join(salted_join(first, last.toDF("src", "c_src"), "src"), last.toDF("dst", "c_dst"), "dst").where("c_src = c_dst")
    pieces = connected_components(inner.select("src", "dst"))
    whole = named.join(pieces, "node", "left").select("node", F.coalesce("component", "node").alias("community"))
    out = None
    for level, each in enumerate(found, 1):
        low = each.groupBy("at").agg(F.min("node").alias("community"))
        part = each.join(low, "at").select(F.lit(level).alias("level"), "node", "community")
        out = part if out is None else out.unionByName(part)
    return cut_lineage(out.unionByName(whole.select(F.lit(len(found) + 1).alias("level"), "node", "community")), "levels")


def modular_communities(edges: DataFrame, resolution: float = 1.0, tolerance: float = 1e-3) -> DataFrame:
    """(node, community): the last level of ``modular_levels``."""
    found = modular_levels(edges, resolution, tolerance)
    top = found.agg(F.max("level")).first()[0]
    return found.where(F.col("level") == F.lit(top)).select("node", "community")
