"""Every operator of the folder against brute force, and its defined results on odd rows."""

import hashlib
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from passagemill.llm import (
    decontaminate,
    language,
    line_dedup,
    packing,
    quality_model,
    quality_rules,
    queries,
    sharding,
    simhash,
    token_counts,
    tokens,
    url_filter,
)

SMALL = "/root/testdata/sf0.001"
WORDS = [a + b for a in "ba ke li mo nu so ta vi we xo ze ru".split() for b in "rin tal dos mep gul fan his".split()]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("doc", "score", "shard", "n", "hi", "bits", "key", "kept", "entry", "root", "size", "length", "_map_doc", "_map_text", "_keep_bits",
        "_group_doc", "_group_text", "_found_doc", "_found_text", "_text", "_words")]
)


def said(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_rows():
    shared = "this very line is in many of the documents"
    long = "\n".join(said(12, i) for i in range(4000))
    texts = [None, "", " \n\t ", "ß", "É" * 30, shared, shared.upper(), f"  {shared}\t\nown {said(15, 1)}", f"{shared}\n{shared}\n{said(30, 2)}"]
    texts += [said(40, 3), said(40, 3), said(40, 3), said(40, 3) + " end", long, "x", "a\nb\nc", "\n\n", "東京都 に 行き ます", "*** $$$ ###", said(9, 4), said(10, 4)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(5, shared), (9, said(40, 3)), (None, shared), (None, "without a number"), (None, None), (77, said(25, 9)), (77, said(25, 10))]
    return [(i, t, "en" if n % 3 else None, None, None, *["clash"] * 21) for n, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None, *[None] * 21) for i, t in enumerate(texts)], SCHEMA)


# ---- line dedup -----------------------------------------------------------------------------


def brute_lines(rows):
    blank = " \t\n\x0b\f\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda s: s.strip(blank).translate(lower)
    real = lambda i: -(1 << 63) if i is None else i
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(real(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == real(i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_lines(spark, odd, none):
    rows = [(r[0], r[1]) for r in odd_rows()]
    assert as_rows(line_dedup.line_digests(odd)) == sorted(brute_lines(rows), key=str)
    assert line_dedup.line_digests(none).count() == 0
    out = line_dedup.drop_lines(odd)
    assert out.columns == odd.columns and out.count() == len(rows)


def test_a_line_in_most_documents_is_cut_by_range_ends(spark):
    texts = [f"the line that a great many documents have\n{said(8, i)}\n{said(8, i % 40)}" for i in range(3000)]
    df = docs_of(spark, texts).repartition(6)
    assert as_rows(line_dedup.line_digests(df)) == sorted(brute_lines(list(enumerate(texts))), key=str)


def test_bitmaps(spark, odd):
    for r in line_dedup.keep_bitmaps(odd).collect():
        assert len(line_dedup.kept_lines(r["keep_bits"], r["n_lines"])) == r["n_lines"] - r["n_dropped"]


# ---- decontamination ------------------------------------------------------------------------


def test_contamination(spark, odd, none):
    rng = random.Random(5)
    items = [said(n, 100 + n) for n in (14, 20, 33, 59)] + [said(6, 200)]
    texts, want = [], set()
    for i in range(60):
        body = said(80, 1000 + i).split()
        if i % 3 == 0:
            k = i // 3 % len(items)
            part = items[k].split()
            for at in rng.sample(range(len(part)), len(part) // 12 if len(part) > 12 else 0):
                part[at] = "changed"
            body[30:30] = [w.upper() + "," for w in part]
            want.add((i, k))
        texts.append(" ".join(body))
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(9, items[0].upper()), (10, None), (None, "")], "item_id long, text string")
    found = decontaminate.contaminated(docs_of(spark, texts), benchmark)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want
    clean = decontaminate.keep_clean(docs_of(spark, texts), benchmark)
    assert {r["doc_id"] for r in clean.collect()} == set(range(60)) - {i for i, _ in want}
    assert decontaminate.contaminated(none, benchmark).count() == 0
    empty = benchmark.where("false")
    assert decontaminate.contaminated(odd, empty).count() == 0 and decontaminate.keep_clean(odd, empty).count() == odd.count()
    assert decontaminate.keep_clean(odd, benchmark).columns == odd.columns


def test_a_small_filter_changes_nothing(spark):
    items = spark.createDataFrame([(0, said(30, 1)), (1, said(30, 2))], "item_id long, text string")
    docs = docs_of(spark, [said(50, 7) + " " + said(30, 1), said(400, 8)])
    wide, narrow = (sorted(map(tuple, decontaminate.contaminated(docs, items, filter_bytes=b).collect())) for b in (1 << 20, 8))
    assert wide == narrow and [r[:2] for r in wide] == [(0, 0)]


def test_masks_tolerate_substitutions():
    base = np.arange(1, 40, dtype=np.uint64)
    other = base.copy()
    other[::7] = 99
    found = [np.isin(decontaminate.seed_hashes(other, s, i), decontaminate.seed_hashes(base, s, i)).any()
             for i, s in enumerate(decontaminate.seeds(decontaminate.MASKS, []))]
    assert any(found)


# ---- quality --------------------------------------------------------------------------------


def oracle(name, **tables):
    con = duckdb.connect()
    for table, pdf in tables.items():
        con.register(table, pdf)
    return con.execute(queries.ORACLES[name]).df()


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    rows = [sorted(map(str, x[columns].astype(object).where(x[columns].notna(), None).values.tolist())) for x in (a, b)]
    assert rows[0] == rows[1]


def test_rules_match_sql(spark, odd, none):
    pdf = pd.DataFrame({"doc_id": [0] * len(odd_rows()), "text": [r[1] for r in odd_rows()]})
    got = quality_rules.report(odd).toPandas()
    got["doc_id"] = 0
    same(got, oracle("op4_quality_rules", documents=pdf))
    assert quality_rules.report(none).count() == 0
    assert quality_rules.keep_good(none).count() == 0 and quality_rules.keep_good(odd).columns == odd.columns


def test_repeated_windows(spark):
    texts = ["a b c d e a b c d e", "a a a a a a a", "a b c d e f a b c d e x", said(30, 1), "a b c d"]
    want = []
    for t in texts:
        w = t.split()
        win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        twice = {x for x, n in Counter(win).items() if n > 1}
        want.append(len({i + j for i, x in enumerate(win) if x in twice for j in range(5)}))
    got = quality_rules.report(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [r["n_repeat_words"] for r in got] == want and want[:3] == [10, 7, 10]


def test_cascade_order_does_not_matter(spark, odd):
    rules = quality_rules.BASE | quality_rules.MORE
    ready = quality_rules._prepared(odd)
    order = [(n, 0.0, 1.0) for n in rules]
    one, two = (ready.where(~quality_rules.rejects(rules, o, F.col("_text"), F.col("_words"))).count() for o in (order, order[::-1]))
    assert one == two == quality_rules.keep_good(odd).count()


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")
def test_classifier(spark, odd, none):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_model.score(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() >= 0.9
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) == h for i, h in zip(got.doc_id, got.held_out))
    flipped = labels.withColumn("quality", labels.quality)
    both = quality_model.score(odd, flipped).toPandas()
    assert len(both) == odd.count() and both.score.between(0, 1).all()
    assert quality_model.score(none, labels).count() == 0
    assert set(quality_model.score(odd, labels.where("false")).toPandas().score) == {0.5}


# ---- sharding -------------------------------------------------------------------------------


def lawful(got, rows):
    sizes = got.groupby("shard").size().reindex(range(16), fill_value=0)
    assert len(got) == len(rows) and sizes.max() - sizes.min() <= 1
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert got.grown_shard.isna().all() and (got.law == "rows").all()
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sorted(zip(got["size"], got.text_crc32)) == want


def test_shards(spark, odd, none):
    lawful(sharding.shard(odd).toPandas(), [(r[0], r[1]) for r in odd_rows()])
    assert sharding.shard(none).count() == 0
    texts = ["the same"] * 300 + [said(5, i // 3) for i in range(600)]
    got = sharding.shard(docs_of(spark, texts)).toPandas()
    lawful(got, list(enumerate(texts)))
    got["text"] = [texts[i] for i in got.doc_id]
    parts = got[got.text != "the same"].groupby("text").shard.nunique()
    assert (parts == 1).mean() > 0.9  # one text fills more than its shard, the others give way for each other
    # a claim is a whole shard, but for the last one
    hot = sorted(got[got.text == "the same"].groupby("shard").size(), reverse=True)
    assert sum(n * (n - 1) for n in hot) >= 0.75 * (5 * 56 * 55 + 20 * 19)
    texts = ["the same"] * 300 + [said(5, i) for i in range(600)]
    got = sharding.shard(docs_of(spark, texts)).toPandas()
    lawful(got, list(enumerate(texts)))
    hot = sorted(got[got.doc_id < 300].groupby("shard").size(), reverse=True)
    assert hot == [56, 56, 56, 56, 56, 20]
    texts = [said(5, i if i % 4 else i // 40) for i in range(800)]
    got = sharding.shard(docs_of(spark, texts)).toPandas()
    lawful(got, list(enumerate(texts)))
    got["text"] = [texts[i] for i in got.doc_id]
    assert (got.groupby("text").shard.nunique() == 1).all()


def test_quotas_keep_sizes():
    rng = random.Random(5)
    for _ in range(300):
        rows = [{"shard": s, "best": t, "n": rng.randrange(1, 9)} for s in range(6) for t in [*range(6), None] if s != t and rng.random() < 0.3]
        go, back = sharding._quotas(rows, 6)
        want = {(r["shard"], r["best"]): r["n"] for r in rows}
        assert all(n <= want[k] for k, n in go.items())
        for s in range(6):
            assert sum(n for (a, _), n in back.items() if a == s) <= want.get((s, None), 0)
            moves = [*go.items(), *back.items()]
            assert sum(n for (a, _), n in moves if a == s) == sum(n for (_, b), n in moves if b == s)
    ring = [{"shard": s, "best": (s + 1) % 3, "n": 4} for s in range(3)]
    assert sharding._quotas(ring, 3)[0] == {(0, 1): 4, (1, 2): 4, (2, 0): 4}


def test_shards_against_the_best_there_is(spark):
    """Every way to put eight documents in two shards of four, by how many links it keeps."""
    links = lambda sizes: sum(n * (n - 1) // 2 for n in sizes)
    for names in ("aaaabcde", "aabbcdef", "aaabcdef", "aaaaabcd", "abcdefgh", "aabbccde"):
        best = 0
        for chosen in combinations(range(8), 4):
            sides = [[names[i] for i in range(8) if (i in chosen) == here] for here in (True, False)]
            best = max(best, sum(links([side.count(x) for x in set(side)]) for side in sides))
        got = sharding.shard(docs_of(spark, list(names)), 2).collect()
        counts = {}
        for r in got:
            counts[names[r.doc_id], r.shard] = counts.get((names[r.doc_id], r.shard), 0) + 1
        assert links(counts.values()) == best, names


# ---- urls -----------------------------------------------------------------------------------


URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7x?q=/en/", "http://example.com/en/8#/en/7", "x://com/en/", "x://xcom/en/",
        "http://www.example.net/de/81", "http://example.net/de/9", "http://a.net", "http://b.org/es/?x", "http://b.org?/es/", "a://b://c/en/",
        "http://EXAMPLE.org/ES/", "http://com/en", "http://é.com/en/é"]


def test_urls(spark):
    rows = [(i, u) for i, u in enumerate(URLS + URLS[:3])] + [(None, "http://x.com/en/")]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, host string, rule string")
    want = oracle("op6_url_filter", pages=pd.DataFrame(rows, columns=["page_id", "url"]).astype({"page_id": "Int64"}))
    for room in (url_filter.MAX_BYTES, 8, 0):  # without room, keys are told apart by the join
        same(url_filter.judge(pages, max_bytes=room).toPandas().astype({"page_id": "Int64"}), want.astype({"page_id": "Int64"}))
    assert url_filter.judge(pages.where("false")).count() == 0


def test_cascade_is_exact(spark):
    keys = [f"host{i}.example" for i in range(4000)]
    listed = set(keys[::7])
    cascade = url_filter.build(spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame([(k,) for k in listed], "key string"))
    assert cascade.rest is None and len(cascade.levels) > 1
    assert {k for k in keys if url_filter.Cascade.answer(cascade.levels, k)} == listed


# ---- near-duplicates ------------------------------------------------------------------------


def brute_print(text, width=4):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    runs = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_groups(spark, odd, none):
    got = simhash.near_duplicate_classes(odd).toPandas()
    want = Counter((r[0], f"{brute_print(r[1]):016x}") for r in odd_rows())
    assert Counter((None if pd.isna(i) else int(i), f) for i, f in zip(got.doc_id, got.fingerprint)) == want
    assert simhash.near_duplicate_classes(none).count() == 0


@pytest.mark.parametrize("max_bits, chunk, bucket", [(4, 1 << 17, 1024), (4, 64, 1024), (4, 200, 0), (2, 100, 1024)])
def test_index_finds_all_links(spark, monkeypatch, max_bits, chunk, bucket):
    monkeypatch.setattr(simhash, "_CHUNK", chunk)
    monkeypatch.setattr(simhash, "_BUCKET", bucket)
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = [0, 1]
    for i in range(1500):
        x = int(centres[i % 40 if i % 2 else 0])
        for b in rng.choice(64, rng.integers(0, 9), replace=False):
            x ^= 1 << int(b)
        prints.append(x)
    prints = np.unique(np.array(prints, np.uint64))
    rows = [(int(p.view(np.int64)), p.tobytes()) for p in prints]
    found = simhash.links(spark.createDataFrame(rows, "entry long, prints binary").repartition(4), 1, max_bits).collect()
    at = {int(e): i for i, (e, _) in enumerate(rows)}
    a, b = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= max_bits)
    want = simhash._join_roots(np.arange(len(prints)), a, b)
    u, v = (np.array([at[r[c]] for r in found], np.int64) for c in ("u", "v"))
    assert (np.bitwise_count(prints[u] ^ prints[v]) <= max_bits).all()
    assert (simhash._join_roots(np.arange(len(prints)), u, v) == want).all()


def template_family(n, pairs):
    """Texts from one template, about 0.7 alike, the first ``pairs`` of them with a near copy."""
    rng = random.Random(11)
    base = said(400, 77).split()
    family = []
    for _ in range(n):
        words = list(base)
        for at in rng.sample(range(400), 7):
            words[at] = f"own{rng.random()}"
        family.append(words)
    copies = [[f"copy{i}" if at % 50 == 25 else w for at, w in enumerate(words)] for i, words in enumerate(family[:pairs])]
    return [" ".join(words) for words in family + copies]


@pytest.mark.parametrize("chunk", [1 << 17, 500])
def test_similar_links_inside_a_template_family(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "_CHUNK", chunk)
    texts, families = template_family(600, 60), 32
    prints = np.stack([simhash.fingerprints_of(simhash.shingle_hashes(t, 5), families) for t in texts])
    rows = [(i, p.tobytes()) for i, p in enumerate(prints)]
    entries = spark.createDataFrame(rows, "entry long, prints binary").repartition(4)
    bits = np.bitwise_count(prints[:, None] ^ prints[None, :])
    cosine = np.cos(np.pi * bits.sum(axis=2) / (64 * families))
    alike = (bits.min(axis=2) <= simhash.NEAR_BITS) & (cosine / (2 - cosine) >= 0.8 - simhash.MARGIN)
    found = simhash.similar_links(entries, families, simhash.NEAR_BITS, 0.8).collect()
    u, v = (np.array([r[c] for r in found], np.int64) for c in ("u", "v"))
    assert alike[u, v].all() and alike[np.arange(60), np.arange(600, 660)].sum() > 50
    none = np.arange(len(texts))
    assert (simhash._join_roots(none, u, v) == simhash._join_roots(none, *np.nonzero(alike))).all()


def test_one_of_each_group_stays(spark, odd):
    texts = [said(120, i) for i in range(30)]
    copies = [t.replace(t.split()[50], "another", 1) for t in texts[:10]] + texts[10:15] + texts[10:15]
    out = simhash.keep_one(docs_of(spark, texts + copies + [None, "", " "]))
    assert sorted(r["doc_id"] for r in out.collect()) == [*range(30), 50]
    left = simhash.keep_one(odd)
    assert left.columns == odd.columns
    kept = Counter((r["doc_id"], r["text"]) for r in left.collect())
    assert max(kept.values()) == 1 and (77, said(25, 9)) in kept and (77, said(25, 10)) in kept


# ---- packing and counts ---------------------------------------------------------------------


def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer())


def test_ids_are_those_of_the_plain_call():
    import pyarrow as pa

    odd_texts = ["", " ", "It's a I'LL don't ''s 's", "<|endoftext|> a<|startoftext|>b<|ENDOFTEXT|>", "ΑΣ ΣΑΣ İstanbul K", "é é ǅ ŉ ª²½", "日本語 テスト _a__b 12345 a1b2",
                 "\x1cA\x1fB \x00", "…—‘’ ́a ẖ H̱", "a\u0085b ﬁ Ⅷ", "(Word) word! WORD?!", said(500, 3)]
    encoder, real = tokens.Encoder(tokens.default_tokenizer()), plain()
    ids, counts = encoder.ids(pa.array(odd_texts))
    want = [real.encode(t, add_special_tokens=False).ids for t in odd_texts]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
    assert encoder.counts(pa.array(odd_texts)).tolist() == counts.tolist()


def test_packing(spark, odd, none):
    capacity = 64
    texts = [r[1] for r in odd_rows()] + [said(i % 50, i) for i in range(300)]
    got = packing.pack(docs_of(spark, texts), capacity=capacity).toPandas()
    real = plain()
    want = set()
    for i, t in enumerate(texts):
        ids = real.encode(t or "", add_special_tokens=False).ids + [1]
        for s in range(0, len(ids), capacity):
            part = np.array(ids[s : s + capacity], "<u4")
            want.add((i, s // capacity, s, len(part), zlib.crc32(part.tobytes())))
    assert set(zip(got.doc_id, got.piece, got.start, got.length, got.ids_crc32)) == want and len(got) == len(want)
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == (part.length.cumsum() - part.length).tolist() and part.length.sum() <= capacity
    assert got.sequence_id.nunique() <= got.length.sum() / capacity * 1.02 + 1
    assert packing.pack(none).count() == 0 and packing.pack(odd).count() >= odd.count()


@pytest.mark.parametrize("seed", range(4))
def test_plans(seed):
    rng = np.random.default_rng(seed)
    shape = [np.minimum(4096, rng.lognormal(6.5, 1, 20_000)), rng.integers(1, 4097, 5000), np.full(900, 1365), rng.integers(1500, 1700, 700)][seed]
    hist = Counter(np.maximum(1, shape.astype(int)).tolist())
    plan = packing.Plan(hist)
    load, seen = np.zeros(plan.sequences, np.int64), Counter()
    for length, rank, n, first, copies, offset in plan.steps:
        assert seen[length] == rank and n % copies == 0
        seen[length] += n
        load[first : first + n // copies] += length * copies
    assert seen == hist and load.max() <= 4096 and load.min() > 0
    assert plan.sequences <= [1.01, 1.05, 1.01, 1.6][seed] * sum(k * v for k, v in hist.items()) / 4096 + 1


def test_least_squares():
    rng = np.random.default_rng(1)
    a, x = rng.random((12, 20)), np.maximum(0, rng.normal(0, 1, 20))
    found = packing.non_negative_least_squares(a, a @ x)
    assert (found >= 0).all() and np.abs(a @ found - a @ x).max() < 1e-6


def test_counts(spark, odd, none):
    real = plain()
    lengths = sorted(len(real.encode(r[1] or "", add_special_tokens=False).ids) for r in odd_rows())
    sums = token_counts.suffix_sums(token_counts.histogram(odd))
    for r in sums.collect():
        n = r["length"]
        assert r["n_docs"] == lengths.count(n) and r["docs_at_least"] == sum(x >= n for x in lengths)
        assert r["tokens_at_least"] == sum(x for x in lengths if x >= n) and r["truncated_total"] == sum(min(x, n) for x in lengths)
    limits, shares = [0, 1, 7, 100, 10**6], [0.1, 0.5, 1.0]
    got = token_counts.answers(sums, limits, shares).first()
    assert [got[f"cut_{k}"] for k in limits] == [sum(min(x, k) for x in lengths) for k in limits]
    assert [got[f"q_{i}"] for i in range(3)] == [lengths[int(np.ceil(q * len(lengths))) - 1] for q in shares]
    assert token_counts.suffix_sums(token_counts.histogram(none)).count() == 0


# ---- language -------------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")
def test_language(spark, odd, none):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = language.identify(docs).toPandas().merge(docs.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() >= 0.95
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == h for i, h in zip(got.doc_id, got.held_out))
    two = got[(got.lang == "de") | (got.lang == "fr")].groupby("lang").text.first()
    mixed = docs.select("doc_id", "text", "lang").unionByName(
        spark.createDataFrame([(10**9, two["de"] + "\n" + two["fr"], None)], "doc_id long, text string, lang string")
    )
    found = language.identify(mixed).where("doc_id = 1000000000").first()
    assert {"de", "fr"} <= set(found["languages"])
    rows = {r["doc_id"]: r for r in language.identify(odd).collect() if r["doc_id"] is not None}
    assert rows[0]["lang_pred"] == rows[18]["lang_pred"] == "und" and rows[0]["score"] == 0
    assert language.identify(none).count() == 0


# ---- pipeline -------------------------------------------------------------------------------


def test_pipeline_on_odd_rows(spark, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SMALL)
            assert docs.columns == odd.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() >= 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")
def test_pipeline_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = spark.createDataFrame(stage(spark, left, SMALL).toPandas(), docs.schema)
    bad = {r["doc_id"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 0").collect()}
    kept = {r["doc_id"] for r in left.collect()}
    assert not kept & bad and len(kept) > 0.6 * docs.count()
    got = corpus_pipeline.run(spark, SMALL).toPandas()
    assert set(got.doc_id) == kept


# ---- workers without the package ------------------------------------------------------------

ALONE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from passagemill.llm import queries
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
for name in {names!r}:
    print(name, queries.QUERIES[name](spark, {folder!r}).count())
"""


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")
def test_workers_need_no_package(tmp_path):
    """The driver finds the package through its own path only; workers start in a folder without it."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    names = ["op3_quality_classifier", "op6_url_filter", "op8_pattern_packing", "op10_language_mixture", "op11_square_runs", "op12_token_alignment"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", ALONE.format(repo=repo, names=names, folder=SMALL)], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr[-2000:]
    assert [x.split()[0] for x in run.stdout.split("\n") if x.startswith("op")] == names
