"""Filters, sampling, splits and pair building used to assemble evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagemill.functions import text as X
from passagemill.plans.session import cut_lineage
from passagemill.plans.skew import salted_join

LONGEST_RUN, LONGEST_CHARS = 5, 3

# Patterns that mark private information.
PRIVATE = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    r"\+?[0-9]{1,3}[ .-]\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-]?[0-9]{2,4}",
    r"AKIA[0-9A-Z]{16}",
    r"sk-[A-Za-z0-9]{20,}",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
)
# Words that point outside the question.
DEICTIC = ("this", "these", "those", "here", "above", "below", "following", "previous", "shown", "figure", "page")


# ---- filters --------------------------------------------------------------------------------


def caption_filter(df: DataFrame, text: str = "text", min_words: int = 5) -> DataFrame:
    return df.where(X.word_count(F.col(text)) >= min_words)


def image_meta_filter(
    df: DataFrame, max_ratio: float = 100, min_edge: int = 224, max_pixels: int = 100_000_000
) -> DataFrame:
    """Shape rules on width and height; pixels are never read."""
    w, h = F.col("width"), F.col("height")
    short, long = F.least(w, h), F.greatest(w, h)
    return df.where(
        (short >= min_edge) & (long <= short * max_ratio) & (w.cast("long") * h.cast("long") <= max_pixels)
    )


def metadata_type_filter(items: DataFrame, metadata: DataFrame, key: str, kind: str, allowed: list) -> DataFrame:
    keep = metadata.where(F.col(kind).isin(allowed)).select(key)
    return items.join(keep, key, "left_semi")


def has_private_data(text: Column) -> Column:
    flag = F.lit(False)
    for pattern in PRIVATE:
        flag = flag | text.rlike(pattern)
    return flag


def pii_document_filter(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(~has_private_data(F.col(text)))


def language_eligibility(df: DataFrame, lang: str = "en", min_words: int = 50, text: str = "text") -> DataFrame:
    return df.where((F.col("lang") == lang) & (X.word_count(F.col(text)) >= min_words))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard overlap of two token sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)


def low_overlap_filter(pairs: DataFrame, question: str, passage: str, limit: float = 0.1) -> DataFrame:
    """Pairs whose question and passage share few words; the overlap is computed inside the row."""
    cut = pairs.withColumns({"__a": X.tokens(F.col(question)), "__b": X.tokens(F.col(passage))})
    return cut.withColumn("overlap", overlap(F.col("__a"), F.col("__b"))).where(F.col("overlap") <= limit).drop("__a", "__b")


def self_sufficient_filter(
    df: DataFrame, text: str = "text", words: tuple[str, ...] = DEICTIC, min_words: int = 5
) -> DataFrame:
    points_away = F.arrays_overlap(X.tokens(F.col(text)), F.array(*[F.lit(w) for w in words]))
    return df.where(~points_away & (X.word_count(F.col(text)) >= min_words))


# ---- sampling, caps and splits --------------------------------------------------------------


def sample_k(df: DataFrame, key: str, k: int, seed: str = "sample") -> DataFrame:
    return df.orderBy(X.hash_order(seed, F.col(key)), key).limit(k)


def head_rows(df: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(*keys).limit(n)


def first_per_group(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """First ``n`` rows by group. Each task keeps its own first ``n`` before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("row_no", F.row_number().over(w)).where(F.col("row_no") <= n)


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: str = "sample") -> DataFrame:
    return first_per_group(df, [group], [X.hash_order(seed, F.col(key)), F.col(key)], n)


def first_n_per_deck(df: DataFrame, deck: str, position: str, n: int) -> DataFrame:
    """Decks with more than ``n`` parts only, and of those the first ``n``.

    Counting is a partial aggregation and ranking a partial top-n, so no task sees a whole deck.
    """
    long_decks = df.groupBy(deck).agg(F.count(F.lit(1)).alias("deck_parts")).where(F.col("deck_parts") > n)
    return first_per_group(df, [deck], [F.col(position)], n).join(long_decks, deck)


def max_per_item(df: DataFrame, item: str, key: str, n: int) -> DataFrame:
    return first_per_group(df, [item], [F.col(key)], n)


def group_disjoint_split(
    df: DataFrame, group: str, shares: tuple[int, int] = (80, 10), seed: str = "split"
) -> DataFrame:
    """train / dev / test by the group's hash out of one hundred, so a group has one label."""
    at = F.conv(F.substring(X.hash_order(seed, F.col(group)), 1, 8), 16, 10).cast("long") % 100
    label = F.when(at < shares[0], "train").when(at < shares[0] + shares[1], "dev").otherwise("test")
    return df.withColumn("split", label)


def exact_dedup(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per content hash: the lowest id stays, with the number of copies it stands for."""
    return df.groupBy(F.sha2(F.col(text), 256).alias("content_hash")).agg(
        F.min(key).alias(key), F.count(F.lit(1)).alias("copies")
    )


def union_queries(**sources: DataFrame) -> DataFrame:
    out = None
    for name, df in sources.items():
        part = df.select(F.lit(name).alias("source"), F.col("query_id").cast("string").alias("query_id"), "text")
        out = part if out is None else out.unionByName(part)
    return out


# ---- joins ----------------------------------------------------------------------------------




def build_qrels(
    items: DataFrame, documents: DataFrame, item_id: str = "item_id", doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Judgements from known passages: the item's text occurs in the document.

    An occurrence repeats the item's inner words as whole words, so a match has every run of them;
    items of one or two words give runs of characters instead. Each item is looked up by the run
    that the fewest documents have, so a stock phrase shared by many does not make candidates, and
    ``contains`` then decides.
    """
    items = items.where(F.length(text) > 0).select(F.col(item_id).alias("query_id"), F.col(text).alias("item_text"))
    cut = items.withColumn("words", F.split("item_text", " ")).withColumn("n_inner", F.greatest(F.size("words") - 2, F.lit(0)))
    cut = cut.select(
        "query_id",
        F.slice("words", 2, F.col("n_inner")).alias("words"),
        F.col("item_text").alias("chars"),
        F.when(F.col("n_inner") > 0, F.least("n_inner", F.lit(LONGEST_RUN)))
        .otherwise(-F.least(F.length("item_text"), F.lit(LONGEST_CHARS)))
        .alias("size"),
    )
    asked = cut.select("query_id", F.explode(F.array_distinct(_runs(F.array("size")))).alias("run"))
    sizes = cut.agg(F.collect_set("size")).scalar()  # at most eight numbers: only these lengths are cut
    docs = documents.select(F.col(doc_id).alias("item_id"), F.col(text).alias("chars"), F.split(text, " ").alias("words"))
    # the outer form keeps Spark from cutting the text a second time in an inferred filter
    doc_runs = docs.withColumn("sizes", sizes).select("item_id", F.explode_outer(_runs(F.col("sizes"))).alias("run"))
    met = cut_lineage(doc_runs.join(asked.select("run").distinct(), "run", "left_semi").distinct(), "runs")

    df = met.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        asked.join(df, "run", "left")
        .groupBy("query_id")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("best"))
        .select("query_id", F.col("best.run").alias("run"))
    )
    found = salted_join(met, rarest, "run", df).select("query_id", "item_id").distinct()
    named = cut_lineage(found.join(items, "query_id"), "candidates")
    return (
        named.join(documents.select(F.col(doc_id).alias("item_id"), F.col(text).alias("doc_text")), "item_id")
        .where(F.contains("doc_text", "item_text"))
        .select("query_id", "item_id", F.lit(1).alias("relevance"))
    )


def _runs(sizes: Column) -> Column:
    """Hashes of all runs of ``words`` (positive sizes) and ``chars`` (negative sizes) of the given lengths."""

    def places(length: Column, n: int) -> Column:
        return F.when(length >= n, F.sequence(F.lit(0), length - n))

    def word_runs(n: int) -> Column:
        def at(i: Column) -> Column:
            return F.xxhash64(F.lit("w"), F.concat_ws(" ", *[F.get("words", i + j) for j in range(n)]))

        return F.when(F.array_contains(sizes, n), F.transform(places(F.size("words"), n), at))

    def char_runs(n: int) -> Column:
        def at(i: Column) -> Column:
            return F.xxhash64(F.lit("c"), F.substring(F.col("chars"), i + 1, F.lit(n)))

        return F.when(F.array_contains(sizes, -n), F.transform(places(F.length("chars"), n), at))

    none = F.array().cast("array<bigint>")
    cuts = [word_runs(n) for n in range(1, LONGEST_RUN + 1)] + [char_runs(n) for n in range(1, LONGEST_CHARS + 1)]
    return F.concat(*[F.coalesce(c, none) for c in cuts])


def page_neighbours(df: DataFrame, group: str, position: str, text: str, reach: int = 1) -> DataFrame:
    """Each page with the texts of the pages around it: those whose number is at most ``reach`` away.

    Where numbers have a gap the page beside it is missing, and a page beyond the gap is no neighbour.

    Every page sends itself to the positions it neighbours; the key is (group, position), so a
    very long document is spread like any other. A page receives at most 2 * reach texts; pages
    without text send nothing.
    """
    sent = df.where(F.col(text).isNotNull()).select(
        group,
        F.explode(F.array(*[F.lit(d) for d in range(-reach, reach + 1) if d != 0])).alias("step"),
        F.col(position).alias("from_position"),
        F.col(text).alias("neighbour_text"),
    ).withColumn(position, F.col("from_position") + F.col("step"))
    around = sent.groupBy(group, position).agg(
        F.array_sort(F.collect_list(F.struct("from_position", "neighbour_text"))).alias("around")
    )
    joined = df.join(around, [group, position], "left")
    return joined.select(
        group,
        position,
        F.coalesce(F.size("around"), F.lit(0)).alias("n_neighbours"),
        F.coalesce(F.array_join(F.col("around.neighbour_text"), "\n"), F.lit("")).alias("noise_context"),
    )


def bridge_pairs(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """(entity, side, question_id): who has an entity in its answer and who in its question, for entities that bridge.

    ``answers(question_id, entity)`` and ``questions(question_id, entity)``. An entity bridges when an answer and the
    question of another have it. All pairs of a common entity would be quadratic, so they stay factored: every
    'answer' row of an entity pairs with every 'question' row of it that has another id, see ``pairs_of``.
    """
    sides = answers.select("entity", F.lit("answer").alias("side"), "question_id").unionByName(
        questions.select("entity", F.lit("question").alias("side"), "question_id")
    )
    sides = cut_lineage(sides.where("entity IS NOT NULL").distinct(), "sides")

    def of(side: str, how):
        return how(F.when(F.col("side") == side, F.col("question_id")))

    per_entity = sides.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"),
        of("answer", F.min).alias("a_low"), of("answer", F.max).alias("a_high"),
        of("question", F.min).alias("q_low"), of("question", F.max).alias("q_high"),
    )
    # without a pair both sides are one and the same question, or one side is empty
    bridging = cut_lineage(per_entity.where("a_low IS NOT NULL AND q_low IS NOT NULL AND (a_low <> q_low OR a_high <> q_high OR a_low <> a_high)"), "bridging")
    return salted_join(sides, bridging.select("entity"), "entity", bridging, "n")


def pairs_of(bridges: DataFrame) -> DataFrame:
    """(question_id, partner_id, entity): the pairs that ``bridge_pairs`` holds, for callers that want them listed."""
    asked = bridges.where("side = 'question'").select("entity", F.col("question_id").alias("partner_id"))
    return bridges.where("side = 'answer'").select("entity", "question_id").join(asked, "entity").where("question_id <> partner_id")


def agreement_join(a: DataFrame, b: DataFrame, key: str = "item_id", answer: str = "answer") -> DataFrame:
    """Two annotators side by side: agreed, disputed, or seen by one only (the last two go to review)."""
    left = a.select(key, X.normalised_key(F.col(answer).cast("string")).alias("answer_a"))
    right = b.select(key, X.normalised_key(F.col(answer).cast("string")).alias("answer_b"))
    status = (
        F.when(F.col("answer_a").isNull() | F.col("answer_b").isNull(), "single")
        .when(F.col("answer_a") == F.col("answer_b"), "agreed")
        .otherwise("review")
    )
    return left.join(right, key, "full").withColumn("status", status)


def template_instances(rows: DataFrame, templates: list[tuple[int, str]], slots: dict[str, str]) -> DataFrame:
    """Every row fills every template. The list is a parameter, so it is exploded inside the row."""
    listed = F.array(
        *[F.struct(F.lit(i).alias("template_id"), F.lit(t).alias("question")) for i, t in templates]
    )
    out = rows.select("*", F.inline(listed))
    text = F.col("question")
    for slot, column in slots.items():
        text = F.replace(text, F.lit("{" + slot + "}"), F.col(column).cast("string"))
    return out.withColumn("question", text)
