"""Sharding by balanced label propagation: documents with equal texts come together, shards stay even.

All documents are dealt to the shards evenly. In each round every group of equal texts (its documents are linked with
each other) looks at where its documents are; those outside the shard that has most of them want to go there. Moves are
granted under quotas: between two shards, or round a ring of shards, as many may leave each as come in, by documents that
want to go or by free ones, those without a link, which do not mind. So each round leaves the sizes as they were. Rounds go on until none can move.
The law is ``rows``: shard sizes differ by one document at most.

A group that no shard can hold claims as few shards as hold it, whole ones but for the last, and its documents want to go
there; there are fewer such groups than shards. Other groups gather in shards that are not claimed whole, for which the
large ones' documents make room like free ones, and after that the large groups go where they claim.

At scale a group is handled as at most one row a shard with a count, however many documents it has, and the quotas come
from a table of shards by shards. Ranks that spread over a large group or a shard are taken block by block. Only
ids, sizes and hashes are shuffled, never texts.

Defined results: a null text has no bytes, checksum 0 and belongs with the empty texts; null ids come first; rows that
repeat are documents of their own; an empty table gives no rows; a table of fewer rows than shards stays as it is dealt; a
text of any length counts as its hash and its size; columns other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemill.llm.common import id_or_lowest, ranked
from passagemill.plans.session import cut_lineage

SHARDS = 16


def _documents(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long"),
        id_or_lowest("doc_id").alias("_doc"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        # 128 bits name a group; the text itself is not needed after this
        F.md5(text).alias("_group"),
    )


def _running(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``name``: the sum of ``n`` over the rows of the key before this one. Blocked like ``ranked``."""
    parts = max(8, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocked = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    sums = blocked.groupBy(*keys, "_block").agg(F.sum("n").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = blocked.withColumn("_own", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return placed.join(sums, [*keys, "_block"]).withColumn(name, F.col("_own") + F.col("_base")).drop("_block", "_own", "_base")


def _quotas(wishes: list, shards: int) -> tuple[dict, dict]:
    """How many may go from s to t, and how many free documents of t make room in return.

    ``wishes`` has (from, to, n) of those that want to go, and (shard, None, n) of the free ones: at most
    ``shards`` squared rows.
    """
    want = {(r["shard"], r["best"]): r["n"] for r in wishes if r["best"] is not None}
    free = {r["shard"]: r["n"] for r in wishes if r["best"] is None}
    go: dict[tuple[int, int], int] = {}
    back: dict[tuple[int, int], int] = {}
    for s in range(shards):
        for t in range(s):
            both = min(want.get((s, t), 0), want.get((t, s), 0))
            go[s, t] = go[t, s] = both
    for (s, t), n in sorted(want.items()):
        extra = min(n - go[s, t], free.get(t, 0))
        if extra > 0:
            free[t] -= extra
            go[s, t] += extra
            back[t, s] = extra
    left = {k: n - go[k] for k, n in want.items() if n > go[k]}
    for s in range(shards):
        while ring := _ring(left, free, s):
            steps = list(zip(ring, ring[1:]))
            last = ring[-1]
            closing = left.get((last, s), 0) or free[last]
            n = min(closing, *(left[step] for step in steps))
            if left.get((last, s), 0):
                steps.append((last, s))
            else:
                free[last] -= n
                back[last, s] = back.get((last, s), 0) + n
            for step in steps:
                go[step] = go.get(step, 0) + n
                left[step] -= n
    return {k: v for k, v in go.items() if v}, back


def _ring(left: dict[tuple[int, int], int], free: dict[int, int], s: int) -> list[int]:
    """Shards from ``s`` on by wishes not granted, to the nearest from which a wish leads back to ``s`` or a free document can."""
    came, line = {s: s}, [s]
    for at in line:
        for (a, b), n in sorted(left.items()):
            if a != at or not n or b in came:
                continue
            came[b] = at
            line.append(b)
            if left.get((b, s), 0) or free.get(b, 0):
                ring = [b]
                while ring[-1] != s:
                    ring.append(came[ring[-1]])
                return ring[::-1]
    return []


def _granted(spark, moves: dict, what: str) -> DataFrame:
    rows = [(int(s), int(t), int(n)) for (s, t), n in moves.items()] or [(-1, -1, 0)]
    return F.broadcast(spark.createDataFrame(rows, f"shard int, {what} int, quota long"))


def _claims(large: list, shards: int, room: int) -> dict[str, dict[int, int]]:
    """How many documents each group that no shard can hold wants in which shard; ``large`` has (_group, shard, n).

    Larger groups choose first, where most of their documents are, among what the others left of ``room``.
    """
    have: dict[str, dict[int, int]] = {}
    for r in large:
        have.setdefault(r["_group"], {})[r["shard"]] = r["n"]
    left, claims = dict.fromkeys(range(shards), room), {}
    for group, parts in sorted(have.items(), key=lambda x: (-sum(x[1].values()), x[0])):
        need, claims[group] = sum(parts.values()), {}
        for s in sorted(left, key=lambda t: (-left[t], -parts.get(t, 0), t)):
            taken = min(need, left[s])
            if taken:
                claims[group][s] = taken
                left[s] -= taken
                need -= taken
    return claims


def _flows(large: list, claims: dict[str, dict[int, int]]) -> list[tuple]:
    """(_group, shard, n, best) of the large groups: what stays, what goes where, and what no claim has a place for."""
    have: dict[str, dict[int, int]] = {}
    for r in large:
        have.setdefault(r["_group"], {})[r["shard"]] = r["n"]
    rows = []
    for group, parts in sorted(have.items()):
        claim = claims[group]
        short = [[t, claim[t] - parts.get(t, 0)] for t in sorted(claim) if claim[t] > parts.get(t, 0)]
        for s, n in sorted(parts.items()):
            stays = min(n, claim.get(s, 0))
            n -= stays
            if stays:
                rows.append((group, s, stays, s))
            while n and short:
                part = min(n, short[0][1])
                rows.append((group, s, part, short[0][0]))
                n -= part
                short[0][1] -= part
                if not short[0][1]:
                    short.pop(0)
            if n:
                rows.append((group, s, n, None))
    return rows


def _wishes(state: DataFrame, claims: dict[str, dict[int, int]], settle: bool, shards: int, room: int) -> DataFrame:
    """``state`` with ``best``, where the documents want to be; null for free ones. Large groups are free until they ``settle``."""
    claimed = [s for s in range(shards) if claims and sum(c.get(s, 0) for c in claims.values()) >= room]
    open_ = [s for s in range(shards) if s not in claimed] or list(range(shards))
    # ties fall either way, so that moves have countermoves
    of_group = Window.partitionBy("_group").orderBy(
        F.col("shard").isin(open_).cast("int").desc(), F.desc("n"), F.xxhash64("_group", "shard"), "shard"
    )
    first = F.first("shard").over(of_group)
    other = F.array(*[F.lit(s) for s in open_])[F.pmod(F.xxhash64("_group"), F.lit(len(open_))).cast("int")]
    best = F.when(F.col("whole") > 1, F.when(first.isin(open_), first).otherwise(other))
    best = best if settle else F.when(F.col("whole") <= room, best)
    wish = state.withColumn("best", best)
    if claims and settle:
        wish = wish.where(F.col("whole") <= room)
        large = state.where(F.col("whole") > room).collect()  # fewer groups than shards
        whole = {r["_group"]: r["whole"] for r in large}
        rows = [(g, s, n, whole[g], b) for g, s, n, b in _flows(large, claims)]
        schema = "_group string, shard int, n long, whole long, best int"
        wish = wish.unionByName(state.sparkSession.createDataFrame(rows, schema))
    return cut_lineage(wish, "wishes")


def _round(state: DataFrame, claims: dict[str, dict[int, int]], settle: bool, shards: int, room: int) -> tuple[DataFrame, int]:
    """``state``: (_group, shard, n, whole) with ``whole`` the documents of the group, ``room`` what a shard holds.

    Returns the next state, and how many moved.
    """
    spark = state.sparkSession
    wish = _wishes(state, claims, settle, shards, room)
    asked = wish.where("best IS NULL OR best <> shard").groupBy("shard", "best").agg(F.sum("n").alias("n")).collect()
    go, back = _quotas(asked, shards)
    if not go:
        return state, 0
    movers = wish.where("best IS NOT NULL AND best <> shard").join(_granted(spark, go, "best"), ["shard", "best"])
    placed = _running(movers, ["shard", "best"], ["_group"], "_before")
    taken = F.least(F.greatest(F.col("quota") - F.col("_before"), F.lit(0)), F.col("n"))
    placed = placed.withColumn("_gone", taken)
    gone = placed.where("_gone > 0").select("_group", F.col("best").alias("shard"), F.col("_gone").alias("n"), "whole")
    stay = placed.where("_gone < n").select("_group", "shard", (F.col("n") - F.col("_gone")).alias("n"), "whole")
    asking = _granted(spark, dict.fromkeys(go, 0), "best").drop("quota")
    refused = wish.where("best IS NOT NULL AND best <> shard").join(asking, ["shard", "best"], "left_anti")
    rest = wish.where("best IS NOT NULL AND best = shard").unionByName(refused)
    # the first free documents of a shard, in order, go where more came from than went
    intervals, start = [], dict.fromkeys(range(shards), 0)
    for (s, t), n in sorted(back.items()):
        intervals.append((s, start[s], start[s] + n, t))
        start[s] += n
    spans = F.broadcast(spark.createDataFrame(intervals or [(-1, 0, 0, 0)], "shard int, _from long, _to long, _target int"))
    limits = F.broadcast(spark.createDataFrame(list(start.items()), "shard int, _limit long"))
    free = _running(wish.where("best IS NULL"), ["shard"], ["_group"], "_before").withColumn("_end", F.col("_before") + F.col("n"))
    met = free.join(spans, "shard").where("_before < _to AND _end > _from")
    part = F.least("_end", "_to") - F.greatest("_before", "_from")
    sent = met.select("_group", F.col("_target").alias("shard"), part.alias("n"), "whole")
    beyond = F.col("_end") - F.greatest("_before", "_limit")
    stayed = free.join(limits, "shard").select("_group", "shard", beyond.alias("n"), "whole").where("n > 0")
    columns = ["_group", "shard", "n", "whole"]
    moved = gone.unionByName(stay).unionByName(rest.select(*columns)).unionByName(sent).unionByName(stayed)
    together = moved.groupBy("_group", "shard").agg(F.sum("n").alias("n"), F.first("whole").alias("whole"))
    return cut_lineage(together, "shards"), sum(go.values())


def propagate(state: DataFrame, shards: int = SHARDS, rounds: int | None = None) -> DataFrame:
    """(_group, shard, n): how many documents of each group go to each shard, from the same before any move.

    Rounds end when none can move, which happens: documents only leave shards that others claim whole, come nearer to what
    their group claims, or join more of their group. ``rounds`` ends them earlier.
    """
    whole = F.sum("n").over(Window.partitionBy("_group"))
    state = cut_lineage(state.withColumn("whole", whole), "shards")
    room = (state.agg(F.sum("n")).first()[0] or 0) // shards
    claims = _claims(state.where(F.col("whole") > room).collect(), shards, room) if room else {}
    done = 0
    for settle in [False, True] if claims else [True]:
        moved = room
        while moved and done != rounds:
            state, moved = _round(state, claims, settle, shards, room)
            done += 1
    return state.select("_group", "shard", "n")


def kept_links(state: DataFrame) -> float:
    """Share of the links whose ends are in one shard; ``state``: (_group, shard, n)."""
    inside = F.col("n") * (F.col("n") - 1) / 2
    groups = state.groupBy("_group").agg(F.sum(inside).alias("kept"), F.sum("n").alias("n"))
    kept, links = groups.agg(F.sum("kept"), F.sum(inside)).first()
    return kept / links if links else 1.0


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row; the law is ``rows``."""
    order = ["_doc", "_group"]
    rows = cut_lineage(_documents(docs), "documents")
    dealt = ranked(rows.select(*order).withColumn("_all", F.lit(0)), "_all", order, "_rank")
    start = dealt.groupBy("_group", (F.col("_rank") % shards).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    # at most one part a shard: (shard, end), where end counts the group's documents up to there
    upto = F.sum("n").over(Window.partitionBy("_group").orderBy("shard"))
    parts = propagate(start, shards, rounds).withColumn("end", upto).groupBy("_group")
    parts = cut_lineage(parts.agg(F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("parts")), "allotted")
    # documents of a large group may be most of one side; between two stored tables adaptive execution splits such a join
    joined = cut_lineage(rows.join(parts, "_group"), "parts")
    one = joined.where(F.size("parts") == 1).withColumn("shard", F.col("parts")[0]["shard"])
    many = ranked(joined.where(F.size("parts") > 1), "_group", order, "_rank")
    many = many.withColumn("shard", F.filter("parts", lambda x: x["end"] > F.col("_rank"))[0]["shard"]).drop("_rank")
    placed = cut_lineage(one.unionByName(many).drop("parts"), "placed")
    return ranked(placed, "shard", order, "slot").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard")
    )
