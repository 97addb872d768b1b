"""Quality rules as a short-circuit cascade of column expressions.

Every rule is a column that is true where it rejects a text. A sample tells what each rule costs and how much it
rejects; the rules are then joined by OR in the order of rejection per cost, and OR stops at the first that is true. The
verdict does not depend on the order, so the sample decides about time alone.

Words are runs of anything but ``[\\x20\\x09-\\x0D]``, lines what ``\\n`` separates. All work on a text happens inside its row:
nothing is shuffled, and repeated windows are found by sorting their hashes.

Defined results: a null text has no words and fails, as an empty one does; repeated rows are judged one by one; an empty
table gives no rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.plans.session import cut_lineage

_BLANKS = " \t\n\x0b\f\r"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SAMPLE_ROWS = 500
#: Longer texts, and all but one row in so many by the hash of the text, are not in the sample.
_SAMPLE_BYTES = 100_000
_SAMPLE_SHARE = 16


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(_BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def n_words(w: Column) -> Column:
    return F.size(w).cast("long")


def word_chars(w: Column) -> Column:
    return F.length(F.array_join(w, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long")


def full_lines(text: Column) -> Column:
    """Lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(_BLANKS)) != "")


def n_dup_lines(text: Column) -> Column:
    return let(full_lines(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_repeat_words(w: Column, width: int = 5) -> Column:
    """Words in windows of ``width`` that the text has at least twice, the first one included."""

    def windows(ws: Column) -> Column:
        hashes = F.transform(ws, lambda _, i: F.xxhash64(*[F.get(ws, i + k) for k in range(width)]))
        return F.slice(hashes, 1, F.greatest(F.size(ws) - (width - 1), F.lit(0)))

    def covered(places: Column) -> Column:
        # a window covers its words up to where the next repeated one starts
        parts = F.transform(places, lambda p, k: F.least(F.coalesce(F.get(places, k + 1) - p, F.lit(width)), F.lit(width)))
        return F.aggregate(parts, F.lit(0), lambda a, b: a + b)

    def repeated(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def counted(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        found = let(ordered, lambda s: let(repeated(s), covered))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(found)

    return let(w, lambda ws: let(windows(ws), counted)).cast("long")


def few_words(text: Column, w: Column) -> Column:
    return n_words(w) < MIN_WORDS


def repeating(text: Column, w: Column) -> Column:
    return n_repeat_words(w) * 100 > n_words(w) * MAX_REPEAT_PERCENT


def symbols(text: Column, w: Column) -> Column:
    """More than one symbol to ten words."""
    return n_symbols(text) * 10 > n_words(w)


def word_length(text: Column, w: Column) -> Column:
    """Words shorter than 2 or longer than 20 letters on average."""
    return let(word_chars(w), lambda c: (c < n_words(w) * 2) | (c > n_words(w) * 20))


def same_lines(text: Column, w: Column) -> Column:
    """More than 30 % of the lines are there already."""
    return let(full_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))) * 100 > F.size(x) * 30)


def capitals(text: Column, w: Column) -> Column:
    """More capitals than small letters among A-Z and a-z."""
    return F.regexp_count(text, F.lit("[A-Z]")) > F.regexp_count(text, F.lit("[a-z]"))


def no_letters(text: Column, w: Column) -> Column:
    """More than 30 % of the words have no letter."""
    return F.size(F.filter(w, lambda x: ~F.rlike(x, F.lit("\\p{L}")))) * 100 > F.size(w) * 30


def broken_off(text: Column, w: Column) -> Column:
    """More than 30 % of the lines end in three dots."""
    lines = full_lines(text)
    return let(lines, lambda x: F.size(F.filter(x, lambda s: s.endswith("...") | s.endswith("…"))) * 100 > F.size(x) * 30)


Rule = Callable[[Column, Column], Column]
BASE: dict[str, Rule] = {"few_words": few_words, "repeating": repeating}
MORE: dict[str, Rule] = {
    "symbols": symbols,
    "word_length": word_length,
    "same_lines": same_lines,
    "capitals": capitals,
    "no_letters": no_letters,
    "broken_off": broken_off,
}


def _prepared(docs: DataFrame) -> DataFrame:
    """``docs`` with the text (``_text``, never null) and its words (``_words``), cut once for all rules."""
    return docs.withColumn("_text", F.coalesce("text", F.lit(""))).withColumn("_words", words(F.col("_text")))


def ordered(docs: DataFrame, rules: dict[str, Rule]) -> list[tuple[str, float, float]]:
    """(rule, rejected share, seconds) by rejection per cost, measured on a sample of at most ``SAMPLE_ROWS`` rows.

    Taking rows stops reading as soon as there are enough, so a large table is not scanned for its sample.
    """
    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(_SAMPLE_SHARE)) == 0).where(F.octet_length("text") <= _SAMPLE_BYTES)
    rows = docs.sparkSession.createDataFrame(some.take(SAMPLE_ROWS), "text string")
    sample = cut_lineage(_prepared(rows).select("_text", "_words"), "sample")

    def timed(rejects: Column) -> tuple[float, float]:
        start = time.perf_counter()
        n, hit = sample.agg(F.count(F.lit(1)), F.sum(rejects.cast("int"))).first()
        return (hit or 0) / max(n, 1), time.perf_counter() - start

    reading = F.size("_words") + F.length("_text") < 0
    timed(reading)
    idle = timed(reading)[1]
    found = []
    for name, rule in rules.items():
        share, seconds = timed(rule(F.col("_text"), F.col("_words")))
        found.append((name, share, max(seconds - idle, 1e-3)))
    return sorted(found, key=lambda x: -x[1] / x[2])


def rejects(rules: dict[str, Rule], order: list[tuple[str, float, float]], text: Column, w: Column) -> Column:
    """True where any rule rejects; the rules after it are not worked out."""
    chain = F.lit(False)
    for name, _, _ in reversed(order):
        chain = F.when(rules[name](text, w), F.lit(True)).otherwise(chain)
    return chain


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row."""
    order = ordered(docs, MORE)
    t, w = F.col("_text"), F.col("_words")
    counted = _prepared(docs.select(F.col("doc_id").cast("long"), "text")).select(
        "doc_id",
        "_text",
        "_words",
        n_words(w).alias("n_words"),
        word_chars(w).alias("word_chars"),
        n_symbols(t).alias("n_symbols"),
        n_dup_lines(t).alias("n_dup_lines"),
        n_repeat_words(w).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    judged = counted.withColumn("base_failed", failed)
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(~rejects(MORE, order, t, w))
    return judged.withColumn("kept", kept).drop("_text", "_words")


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that any rule rejects."""
    rules = BASE | MORE
    order, text = ordered(docs, rules), F.coalesce("text", F.lit(""))
    # bound inside the expression: a filter on a column of words would be pushed down and cut them for every rule
    return docs.where(~let(words(text), lambda w: rejects(rules, order, text, w)))
