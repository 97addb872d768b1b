"""Retrieval and answer metrics. Means run over judged queries only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.functions import text as X
from passagemill.operators.search import DIGITS
from passagemill.plans.skew import salted_join

K = 5
ANLS_THRESHOLD = 0.5  # fixed value of the published measure


def judged_hits(hits: DataFrame, qrels: DataFrame, *by: str) -> DataFrame:
    """One row per hit of a judged query, with its relevance (0 when not judged relevant)."""
    keys = [*by, "query_id", "item_id"]
    judged = qrels.select(*by, "query_id").distinct()
    rel = qrels.groupBy(*keys).agg(F.max("relevance").alias("relevance"))
    return (
        hits.select(*keys, "rank")
        .join(judged, [*by, "query_id"], "left_semi")
        .join(rel, keys, "left")
        .withColumn("relevance", F.coalesce("relevance", F.lit(0)))
    )


def ideal_gain(qrels: DataFrame, k: int, *by: str) -> DataFrame:
    """Per query: number of relevant items and the best reachable discounted gain at ``k``."""
    keys = [*by, "query_id"]
    rel = qrels.where("relevance > 0").groupBy(*keys, "item_id").agg(F.max("relevance").alias("relevance"))
    w = Window.partitionBy(*keys).orderBy(F.desc("relevance"), "item_id")
    best = rel.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    gain = best.groupBy(*keys).agg(F.sum(F.col("relevance") / F.log2(F.col("r") + 1.0)).alias("ideal"))
    return rel.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_relevant")).join(gain, keys)


def per_query(hits: DataFrame, qrels: DataFrame, k: int = K, *by: str) -> DataFrame:
    """recall, precision, reciprocal rank, nDCG and hit@1 of every judged query; a query without
    relevant hits scores zero."""
    keys = [*by, "query_id"]
    found = judged_hits(hits, qrels, *by).where((F.col("rank") <= k) & (F.col("relevance") > 0))
    sums = found.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_found"),
        F.min("rank").alias("first_rank"),
        F.sum(F.col("relevance") / F.log2(F.col("rank") + 1.0)).alias("gain"),
    )
    joined = ideal_gain(qrels, k, *by).join(sums, keys, "left")
    n_found = F.coalesce("n_found", F.lit(0))
    return joined.select(
        *keys,
        (n_found / F.col("n_relevant")).alias("recall"),
        (n_found / F.lit(k)).alias("precision"),
        F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("mrr"),
        (F.coalesce("gain", F.lit(0.0)) / F.col("ideal")).alias("ndcg"),
        (F.coalesce("first_rank", F.lit(0)) == 1).cast("double").alias("hit1"),
    )


METRICS = ("recall", "precision", "mrr", "ndcg", "hit1")


def evaluate_dataset(hits: DataFrame, qrels: DataFrame, k: int = K, dataset: str | None = None) -> DataFrame:
    """(dataset, metric, value) for all metrics in one pass; many datasets are grouped, not looped."""
    by = [dataset] if dataset else []
    means = per_query(hits, qrels, k, *by).groupBy(*by).agg(*[F.round(F.avg(m), DIGITS).alias(m) for m in METRICS])
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])
    name = F.col(dataset) if dataset else F.lit("all")
    return means.select(name.alias("dataset"), F.inline(pairs)).where(F.col("value").isNotNull())


def mean_of(hits: DataFrame, qrels: DataFrame, metric: str, k: int = K) -> DataFrame:
    rows = per_query(hits, qrels, k)
    return rows.agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg(metric), DIGITS).alias(metric))


def recall_at_k(hits: DataFrame, qrels: DataFrame, k: int = K) -> DataFrame:
    return mean_of(hits, qrels, "recall", k)


def precision_at_k(hits: DataFrame, qrels: DataFrame, k: int = K) -> DataFrame:
    return mean_of(hits, qrels, "precision", k)


def mrr(hits: DataFrame, qrels: DataFrame, k: int = K) -> DataFrame:
    return mean_of(hits, qrels, "mrr", k)


def ndcg_at_k(hits: DataFrame, qrels: DataFrame, k: int = K) -> DataFrame:
    return mean_of(hits, qrels, "ndcg", k)


def hit_at_1(hits: DataFrame, qrels: DataFrame) -> DataFrame:
    return mean_of(hits, qrels, "hit1", 1)


def sweep_eval(hits: DataFrame, qrels: DataFrame, ks: tuple[int, ...], *by: str) -> DataFrame:
    """The evaluation at several cut-offs from one ranking: each hit counts for every k that admits it."""
    listed = F.array(*[F.lit(k) for k in ks])
    many_hits = hits.select(*by, "query_id", "item_id", "rank", F.explode(F.filter(listed, lambda k: k >= F.col("rank"))).alias("k"))
    found = judged_hits(many_hits, qrels.select(*by, "query_id", "item_id", "relevance", F.explode(listed).alias("k")), "k", *by)
    sums = found.where("relevance > 0").groupBy("k", *by, "query_id").agg(
        F.count(F.lit(1)).alias("n_found"), F.min("rank").alias("first_rank")
    )
    relevant = qrels.where("relevance > 0").groupBy(*by, "query_id").agg(F.countDistinct("item_id").alias("n_relevant"))
    base = relevant.select("*", F.explode(listed).alias("k"))
    joined = base.join(sums, ["k", *by, "query_id"], "left")
    return joined.groupBy(*by, "k").agg(
        F.round(F.avg(F.coalesce("n_found", F.lit(0)) / F.col("n_relevant")), DIGITS).alias("recall"),
        F.round(F.avg(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))), DIGITS).alias("mrr"),
    )


def context_size_report(hits: DataFrame, qrels: DataFrame, sizes: DataFrame, methods: list[str], bucket: int = 200) -> DataFrame:
    """Context length against quality: hits(method, ...), sizes(item_id, tokens).

    Every judged query counts for every method; one for which a method found nothing has an empty context.
    """
    total = hits.join(sizes, "item_id").groupBy("method", "query_id").agg(F.sum("tokens").alias("context_tokens"))
    by_method = qrels.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
    quality = per_query(hits, by_method, K, "method")
    return (
        quality.join(total, ["method", "query_id"], "left")
        .withColumn("context_tokens", F.coalesce("context_tokens", F.lit(0.0)))
        .withColumn("bucket", (F.floor(F.col("context_tokens") / bucket) * bucket).cast("long"))
        .groupBy("method", "bucket")
        .agg(
            F.count(F.lit(1)).alias("n_queries"),
            F.round(F.avg("context_tokens"), DIGITS).alias("avg_tokens"),
            F.round(F.avg("recall"), DIGITS).alias("recall"),
        )
    )


# ---- answers --------------------------------------------------------------------------------


def normalised(text: Column) -> Column:
    """Lower-case words joined by single blanks."""
    return F.array_join(X.tokens(text), " ")


def exact_accuracy(pairs: DataFrame, got: str, gold: str) -> DataFrame:
    same = normalised(F.col(got)) == normalised(F.col(gold))
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(same.cast("double")), DIGITS).alias("accuracy"))


def gram_counts(pairs: DataFrame, key: str, got: str, gold: str, sizes: list[int]) -> DataFrame:
    """(key, n, gram, n_got, n_gold) of both texts of a pair in one pass.

    Pairs are laid out by key before they are cut, so counting and the sums per pair need no further
    shuffle. A pair without any n-gram keeps one row with an empty gram.
    """
    laid_out = pairs.select(key, got, gold).repartition(key)
    words = laid_out.select(key, X.tokens(F.col(got)).alias("w_got"), X.tokens(F.col(gold)).alias("w_gold"))

    def cut(side: str, n: int) -> Column:
        w = f"w_{side}"

        def at(i: Column) -> Column:
            gram = F.concat_ws(" ", *[F.get(w, i + j) for j in range(n)])
            return F.struct(F.lit(n).alias("n"), gram.alias("gram"), F.lit(int(side == "got")).alias("is_got"))

        starts = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n))
        return F.coalesce(F.transform(starts, at), F.array().cast("array<struct<n:int,gram:string,is_got:int>>"))

    cuts = F.concat(*[cut(side, n) for n in sizes for side in ("got", "gold")])
    rows = words.select(key, F.inline_outer(cuts))
    n_got = F.sum(F.coalesce("is_got", F.lit(0)))
    n_gold = F.sum(1 - F.coalesce("is_got", F.lit(1)))
    return rows.groupBy(key, "n", "gram").agg(n_got.alias("n_got"), n_gold.alias("n_gold"))


def gram_match(pairs: DataFrame, key: str, got: str, gold: str, n: int) -> DataFrame:
    """Per pair: matched n-grams (clipped counts) and the totals on both sides."""
    return gram_counts(pairs, key, got, gold, [n]).groupBy(key).agg(
        F.sum(F.least("n_got", "n_gold")).alias("matched"),
        F.sum("n_got").alias("total_got"),
        F.sum("n_gold").alias("total_gold"),
    )


def with_f(matches: DataFrame) -> DataFrame:
    """precision, recall and their harmonic mean."""
    p = F.when(F.col("total_got") > 0, F.col("matched") / F.col("total_got")).otherwise(0.0)
    r = F.when(F.col("total_gold") > 0, F.col("matched") / F.col("total_gold")).otherwise(0.0)
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return matches.withColumns({"precision": F.round(p, DIGITS), "recall": F.round(r, DIGITS), "f1": F.round(f, DIGITS)})


def token_f1(pairs: DataFrame, key: str, got: str, gold: str) -> DataFrame:
    return with_f(gram_match(pairs, key, got, gold, 1)).select(key, "precision", "recall", "f1")


def rouge_n(pairs: DataFrame, key: str, got: str, gold: str, n: int = 2) -> DataFrame:
    return with_f(gram_match(pairs, key, got, gold, n)).select(key, "precision", "recall", "f1")


def bleu(pairs: DataFrame, key: str, got: str, gold: str, longest: int = 4) -> DataFrame:
    """Corpus score: geometric mean of clipped precisions times the brevity penalty."""
    counts = gram_counts(pairs, key, got, gold, list(range(1, longest + 1)))
    levels = (
        counts.where("n IS NOT NULL")
        .groupBy("n")
        .agg(F.sum(F.least("n_got", "n_gold")).alias("matched"), F.sum("n_got").alias("total"), F.sum("n_gold").alias("gold"))
    )
    asked = F.col("total") > 0
    both_rows = levels.agg(
        F.count(F.when(asked, 1)).alias("levels"),
        F.min(F.when(asked, F.col("matched"))).alias("least_matched"),
        F.avg(F.when(asked & (F.col("matched") > 0), F.log(F.col("matched") / F.col("total")))).alias("mean_log"),
        F.coalesce(F.sum(F.when(F.col("n") == 1, F.col("total"))), F.lit(0)).alias("got_len"),
        F.coalesce(F.sum(F.when(F.col("n") == 1, F.col("gold"))), F.lit(0)).alias("gold_len"),
    )
    brevity = F.when(F.col("got_len") >= F.col("gold_len"), 1.0).otherwise(F.exp(1 - F.col("gold_len") / F.col("got_len")))
    score = F.when((F.col("levels") == longest) & (F.col("least_matched") > 0), brevity * F.exp("mean_log")).otherwise(0.0)
    return both_rows.select("got_len", "gold_len", F.round(score, DIGITS).alias("bleu"))


def anls(answers: DataFrame, golds: DataFrame, key: str, got: str, gold: str) -> DataFrame:
    """Mean over questions of the best edit similarity to any gold answer; under 0.5 counts as zero."""
    a, b = X.normalised_key(F.col(got)), X.normalised_key(F.col(gold))
    longest = F.greatest(F.length(a), F.length(b))
    near = F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(1.0)
    best = salted_join(golds.select(key, gold), answers.select(key, got), key).groupBy(key).agg(F.max(near).alias("s"))
    score = F.when(F.col("s") >= ANLS_THRESHOLD, F.col("s")).otherwise(0.0)
    return best.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), DIGITS).alias("anls"))


def depth_accuracy(found: DataFrame, depth: str, length: str, correct: str, depths: int = 5, length_bucket: int = 1000) -> DataFrame:
    """Accuracy by where the needle lies (share of the context) and by how long the context is."""
    d = F.least(F.floor(F.col(depth) * depths), F.lit(depths - 1)).cast("int")
    size = (F.floor(F.col(length) / length_bucket) * length_bucket).cast("long")
    return found.groupBy(d.alias("depth"), size.alias("length")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col(correct).cast("double")), DIGITS).alias("accuracy")
    )


def human_vs_system(df: DataFrame, kind: str, human: str, system: str, gold: str) -> DataFrame:
    """Accuracy of annotators and of the system by question type."""
    return df.groupBy(kind).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg((F.col(human) == F.col(gold)).cast("double")), DIGITS).alias("human"),
        F.round(F.avg((F.col(system) == F.col(gold)).cast("double")), DIGITS).alias("system"),
    )
