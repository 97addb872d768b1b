"""Language identification as a mixture of languages.

From the learning documents come counts of hashed letter n-grams by language. A word's likelihood in a language is
that of its n-grams; a text is a mixture in which every word is of one language. Expectation-maximisation finds
the proportions; then the set of languages is chosen by penalised likelihood: languages are added in the order
of their share while the log likelihood grows by more than ``PENALTY * log(words + 1)`` for each.

Counts are summed in Spark; the model has one row of ``BUCKETS`` numbers a language. All texts of an Arrow slice
are fitted together, so work is proportional to the words, and nothing but counts is shuffled.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is everything when nothing was learned;
a null id counts as the empty text in the fold; ties go to the first language in alphabetical order; repeated rows
are judged one by one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import column, slices, texts, words

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
ROUNDS = 8
PENALTY = 2.0
FOLDS = 5
_SLICE = 3 << 20


def remainder(name: str, folds: int) -> Column:
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit(""))) % folds


def grams(vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every letter n-gram of distinct words, in the order of the words; a blank stands for an edge."""
    low = pc.replace_substring_regex(pc.utf8_lower(vocabulary), r"[^\p{L}]+", " ")
    line = " " + "\n".join(low.to_pylist()).replace("\n", " \n ") + " "
    code = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    word = np.cumsum(code == 10)
    letter = (code != 32) & (code != 10)
    found_word, found_bucket = [], []
    for n in ORDERS:
        size = len(code) - n + 1
        if size <= 0:
            continue
        h = np.full(size, n, np.uint64)
        inner = np.ones(size, bool)
        some = np.zeros(size, bool)
        for j in range(n):
            part = slice(j, j + size)
            h = (h ^ code[part]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
            some |= letter[part]
            if 0 < j < n - 1 or n == 1:
                inner &= letter[part]
            elif n > 1:
                inner &= code[part] != 10
        at = np.flatnonzero(inner & some)
        found_word.append(word[at])
        found_bucket.append((h[at] >> np.uint64(65 - BUCKETS.bit_length())).astype(np.int64))
    w, b = np.concatenate(found_word), np.concatenate(found_bucket)
    order = np.argsort(w, kind="stable")
    return w[order], b[order]


# ---- learning -------------------------------------------------------------------------------


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}  # one row of BUCKETS a language
    for batch in slices(batches, "text", _SLICE):
        coded, counts = words(texts(batch))
        if not len(coded):
            continue
        word, bucket = grams(coded.dictionary)
        lang = pc.dictionary_encode(column(batch, "lang"))
        of_token = np.repeat(lang.indices.to_numpy(), counts)
        at = coded.indices.to_numpy()
        for i, name in enumerate(lang.dictionary.to_pylist()):
            uses = np.bincount(at[of_token == i], minlength=len(coded.dictionary))
            sums = np.bincount(bucket, weights=uses[word], minlength=BUCKETS).astype(np.int64)
            totals[name] = totals.get(name, 0) + sums
    for name, sums in totals.items():
        full = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(full), pa.string()), pa.array(full), pa.array(sums[full])], ["lang", "bucket", "n"]
        )


def _row_of_language(rows: pd.DataFrame) -> pd.DataFrame:
    counts = np.zeros(BUCKETS, np.float32)
    counts[rows["bucket"]] = rows["n"]
    return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "counts": [counts.tobytes()]})


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log probabilities (bucket, language). ``docs``: (text, lang)."""
    sums = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang").mapInArrow(_counted, "lang string, bucket long, n long")
    by_language = sums.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).groupBy("lang")
    # a row of BUCKETS numbers for each language
    rows = sorted(by_language.applyInPandas(_row_of_language, "lang string, counts binary").collect(), key=lambda r: r["lang"])
    if not rows:
        return [], np.zeros((BUCKETS, 0), np.float32)
    counts = np.stack([np.frombuffer(r["counts"], np.float32) for r in rows], axis=1).astype(np.float64)
    smooth = counts + 0.1
    return [r["lang"] for r in rows], (np.log(smooth / smooth.sum(axis=0)) / len(ORDERS)).astype(np.float32)


# ---- inference ------------------------------------------------------------------------------


def _likelihoods(vocabulary: pa.Array, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood of each distinct word in each language, and whether it has a letter."""
    word, bucket = grams(vocabulary)
    out = np.zeros((len(vocabulary), model.shape[1]), np.float32)
    if len(word):
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        out[word[first]] = np.add.reduceat(model[bucket], first)
    full = np.zeros(len(vocabulary), bool)
    full[word] = True
    return out, full


def mixture(log_p: np.ndarray, counts: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the allowed languages in each text, and its log likelihood. No text is without words."""
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    top = log_p.max(axis=1, keepdims=True)
    p = np.exp(log_p - top)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    share = share.astype(np.float32)
    tiny = np.float32(1e-30)
    for _ in range(rounds):
        part = p * np.repeat(share, counts, axis=0)
        part /= np.maximum(part.sum(axis=1, keepdims=True), tiny)
        share = np.add.reduceat(part, first, axis=0) / counts[:, None].astype(np.float32)
    mixed = np.log(np.maximum((p * np.repeat(share, counts, axis=0)).sum(axis=1), tiny)) + top[:, 0]
    return share, np.add.reduceat(mixed.astype(np.float64), first)


def choose(log_p: np.ndarray, counts: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: its main language, the share of that, and which languages it has."""
    texts_, languages = len(counts), log_p.shape[1]
    full, best = mixture(log_p, counts, np.ones((texts_, languages), bool))
    order = np.argsort(-full, axis=1, kind="stable")
    price = penalty * np.log(counts + 1.0)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    single = log_p[np.arange(len(log_p)), np.repeat(order[:, 0], counts)]
    value = np.add.reduceat(single.astype(np.float64), first)
    chosen = np.zeros((texts_, languages), bool)
    chosen[np.arange(texts_), order[:, 0]] = True
    main = order[:, 0].copy()
    # no set does better than all languages together: texts for which even that gains too little are done
    rest = np.flatnonzero(best - value > price)
    for k in range(2, languages + 1):
        if not len(rest):
            break
        allowed = np.zeros((len(rest), languages), bool)
        np.put_along_axis(allowed, order[rest, :k], True, axis=1)
        rows = np.isin(np.repeat(np.arange(texts_), counts), rest)
        share, found = mixture(log_p[rows], counts[rest], allowed)
        gains = found - value[rest] > price[rest]
        value[rest[gains]] = found[gains]
        chosen[rest[gains]] = allowed[gains]
        main[rest[gains]] = share[gains].argmax(axis=1)
        rest = rest[gains]
    return main, full[np.arange(texts_), main], chosen


def _predicted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, model = shared.value
        for batch in slices(batches, "text", _SLICE):
            n = batch.num_rows
            pred, score = np.full(n, "und", object), np.zeros(n)
            sets: list[list[str]] = [[] for _ in range(n)]
            coded, counts = words(texts(batch))
            if names and len(coded):
                likely, full = _likelihoods(coded.dictionary, model)
                at = coded.indices.to_numpy()
                there = full[at]
                rows = np.repeat(np.arange(n), counts)[there]
                used = np.bincount(rows, minlength=n)
                some = np.flatnonzero(used)
                if len(some):
                    main, share, chosen = choose(likely[at[there]], used[some])
                    pred[some] = np.array(names, object)[main]
                    score[some] = np.clip(share, 0, 1)
                    for i, row in zip(some.tolist(), chosen):
                        sets[i] = [names[j] for j in np.flatnonzero(row)]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "held_out"), pa.array(pred, pa.string()), pa.array(score), pa.array(sets, pa.list_(pa.string()))],
                ["doc_id", "held_out", "lang_pred", "score", "languages"],
            )

    return run


def identify(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages) of every row; learned from the rows that are not held out."""
    marked = docs.select(F.col("doc_id").cast("long"), "text", "lang", (remainder("doc_id", folds) == 0).alias("held_out"))
    model = learn(marked.where("NOT held_out"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, held_out boolean, lang_pred string, score double, languages array<string>"
    return marked.drop("lang").mapInArrow(_predicted(shared), schema)
