"""Periodic runs, aligned tokens and secrets against brute force, and their defined results on odd rows."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from passagemill.llm import alignment, queries, runs, secrets

NAMES = "n_words runs collapsed block place groups pairs n_docs docs pair times n best at spans start end rank value asking".split()
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())] + [T.StructField(c, T.StringType()) for c in NAMES])


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * len(NAMES)) for r in rows], SCHEMA).repartition(3)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ---- runs -----------------------------------------------------------------------------------


def brute_runs(w, min_length=6, min_periods=4):
    out = []
    for q in range(1, len(w) // min_periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(min_length, min_periods * q):
                if not any(q % p == 0 and w[i : i + q - p] == w[i + p : i + q] for p in range(1, q)):
                    out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out)


def random_sequence(rng):
    letters, w = rng.choice([1, 2, 2, 3, 5]), []
    while len(w) < rng.choice([5, 30, 90, 200]):
        x = rng.random()
        if x < 0.4:
            w += [rng.randrange(letters) for _ in range(rng.randrange(1, 8))]
        elif x < 0.8:
            u = [rng.randrange(letters) for _ in range(rng.randrange(1, 12))]
            w += (u * 9)[: rng.randrange(1, 9 * len(u))]
        else:
            w += w[-rng.randrange(1, 30) :]
    return w


@pytest.mark.parametrize("step", [1, 7, 10**6])
def test_catchers_find_all_runs_however_words_come(step):
    rng = random.Random(step)
    for _ in range(250):
        length, periods = rng.choice([(6, 4), (6, 4), (2, 2), (10, 3), (40, 2)])
        w = random_sequence(rng)
        catchers = runs.SquareCatchers(len(w) // periods, length, periods)
        for at in range(0, len(w), step):
            catchers.append(np.array(w[at : at + step]))
            if step == 7:
                assert catchers.runs() == brute_runs(w[: at + step], length, periods)
        assert catchers.runs() == brute_runs(w, length, periods)


def test_long_texts_are_appended_in_parts(monkeypatch):
    monkeypatch.setattr(runs, "PART", 1000)
    rng = random.Random(2)
    u = [rng.randrange(50) for _ in range(700)]
    w = [rng.randrange(50) for _ in range(333)] + u * 6 + [3] * 5000 + u[:90]
    got = runs.runs_of(np.array([*w, *u, *u], np.int64), np.array([len(w), 700, 0, 700]))
    assert {tuple(r[1:]) for r in got.tolist()} == set(brute_runs(w))


def loop(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if doc_id is None or h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def run_digest(doc_id, text):
    w = loop(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    found = brute_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (r[1] * 10**9 // r[2], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    left = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *told, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(left))


def test_run_query(spark):
    rng = random.Random(6)
    texts = [None, "", " \n\t ", "a a a a a a", "a a a a a", "x " * 5000, "é ü " * 7 + "\x0b é", "no run at all here"]
    texts += [rng.choice([" ", "\n", " \t"]).join(f"w{x}" for x in random_sequence(rng)) for _ in range(150)]
    texts += [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 300))) for _ in range(200)]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "b b b b b b b"), (None, None)]
    df = docs_of(spark, rows)
    got = rows_of(runs.digests(runs.find_runs(runs.with_loops(df))))
    assert got == sorted((run_digest(*r) for r in rows), key=str)
    assert runs.digests(runs.find_runs(runs.with_loops(df.where("false")))).count() == 0


# ---- alignment ------------------------------------------------------------------------------


def brute_links(rows):
    pair, real = alignment.Pair(*alignment.default_files()), Tokenizer.from_file(alignment.default_files()[0])
    real.encode_special_tokens = True
    docs, count = [], Counter()
    for _, t in rows:
        raw, a, b = f" {t}".encode(), [], []
        if t:
            a, b = real.encode(f" {t}", add_special_tokens=False).ids, pair.b.encode(t)
            if not raw == b"".join(pair.a_bytes[i] for i in a) == b"".join(pair.b_bytes[i] for i in b):
                a, b = [], []
        ends = [np.cumsum([len(table[i]) for i in ids]).tolist() for ids, table in ((a, pair.a_bytes), (b, pair.b_bytes))]
        groups, i, j = [], 0, 0
        for c in sorted(set(ends[0]) & set(ends[1])):
            i2, j2 = ends[0].index(c) + 1, ends[1].index(c) + 1
            groups.append((a[i:i2], b[j:j2]))
            i, j = i2, j2
        docs.append((a, b, groups))
        count.update({(x, y) for g in groups for x in g[0] for y in g[1]})
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    for (i, _), (a, b, groups) in zip(rows, docs):
        links = [(x, y) for u, v in groups for x in u for y in v]
        said = ";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in groups)
        digest = hashlib.sha256(said.encode()).hexdigest() if said else ""
        yield i, len(a), len(b), len(groups), len(links), digest, sum(count[x] == top[x[0]] for x in links), sum(count[x] for x in links)


def odd_texts():
    rng = random.Random(4)
    parts = [*"abcde  \n\t.,é東京’“  　\u0085 \x1c\U0001f600ß1234==--__<s>", "</s>", "<|endoftext|>", "<0x41>", " the ", " token", "'s", "́", "ﬁ"]
    texts = [None, "", " ", "  ", "a", "\n", " a", "a ", "=" * 500, "é" * 300, " " * 77, "ab " * 400, "\x00a", "▁ a", "a▁b ▁▁ c", "東" * 2000, "=-" * 3000]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 120))) for _ in range(300)]
    return texts + ["the very same text here"] * 20 + [" ".join(rng.choice(["hola", "señor", "straße", "the", "x1"]) for _ in range(9000))]


@pytest.mark.parametrize("word_wise, slice_bytes", [(True, 6 << 20), (True, 3000), (False, 6 << 20)])
def test_links(spark, monkeypatch, word_wise, slice_bytes):
    if not word_wise:
        monkeypatch.setattr(alignment, "_PROBE", "")  # texts are then one unit each
        assert not alignment.Pair(*alignment.default_files()).word_wise
    monkeypatch.setattr(alignment, "_BLOCK_BYTES", slice_bytes)
    rows = list(enumerate(odd_texts())) + [(3, "a"), (None, "a b"), (None, None)]
    df = docs_of(spark, rows)
    order = "doc_id n_a n_b n_groups n_links groups_sha256 n_best count_sum".split()
    assert rows_of(alignment.digests(df).select(order)) == sorted(brute_links(rows), key=str)
    if word_wise:
        assert alignment.digests(df.where("false")).count() == 0 and alignment.align(df.where("text is null")).count() == 2
        assert alignment.align(df).where("doc_id = 4").first()["groups"] == "257|264"


def test_wide_groups_count_different_ids(spark, monkeypatch):
    rows = list(enumerate(odd_texts()))
    wide = rows_of(alignment.digests(docs_of(spark, rows)))
    monkeypatch.setattr(alignment, "_WIDE", 0)
    assert rows_of(alignment.digests(docs_of(spark, rows))) == wide


def test_shared_cuts_are_the_common_ends():
    rng = np.random.default_rng(3)
    for density in (0.02, 0.3, 0.9):
        a, b = (np.flatnonzero(rng.random(5000) < density) for _ in range(2))
        a, b = (np.unique(np.concatenate((x, [999, 5001]))) for x in (a, b))
        last = [np.searchsorted(x, [999, 5001]) for x in (a, b)]
        cut_a, cut_b = alignment.shared_cuts(a, b, *last)
        assert a[cut_a].tolist() == b[cut_b].tolist() == np.intersect1d(a, b).tolist()


# ---- secrets --------------------------------------------------------------------------------

KEYWORD = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = re.compile(KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_secrets(t):
    t = t or ""
    base = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    more = []
    for m in re.finditer(f"(?:{ASSIGN.pattern})|[A-Za-z0-9+/_-]{{20,}}", t):
        v = m[0]
        if any(re.fullmatch(p, v) for p in (secrets.ASSIGN, secrets.ACCESS, secrets.HEX, *secrets.ALLOWED)) or set(v) - set(secrets.ALPHABETS[-1].letters):
            continue
        rank, kind = next((r, a) for r, a in enumerate(secrets.ALPHABETS, 3) if set(v) <= set(a.letters))
        bits = [-sum(n / 20 * math.log2(n / 20) for n in Counter(v[i : i + 20]).values()) for i in range(len(v) - 19)]
        hot = [i for i, x in enumerate(bits) if x >= kind.bits]
        if hot:
            more.append((m.start() + hot[0], rank, m.start() + hot[-1] + 20, kind.name))
    say = lambda x: ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(x))
    return *[sum(b[1] == r for b in base) for r in range(3)], hashlib.sha256(say(base).encode()).hexdigest(), say(base + more)


def secret_texts():
    rng = random.Random(3)
    pick = lambda a, n: "".join(rng.choice(a) for _ in range(n))

    def piece():
        x = rng.random()
        word = rng.choice("password PassWD secret token api_key APIKEY tokenpassword mytoken".split())
        if x < 0.25:
            mark = rng.choice(["", '"', "'"]) + rng.choice(["", " ", "  "]) + rng.choice([":", "=", "==", "x"]) + rng.choice(["", " "])
            return word + mark + rng.choice(["", '"', "'"]) + pick("abcXYZ09+/_.=-", rng.randrange(0, 12))
        if x < 0.35:
            return "AKIA" + pick(string.ascii_uppercase + string.digits, rng.randrange(0, 20))
        if x < 0.6:
            return pick(rng.choice(["0123456789abcdef", "0123456789ABCDEF"]), rng.randrange(10, 60))
        if x < 0.75:
            return pick(string.ascii_letters + string.digits + rng.choice(["", "+/", "_-"]), rng.randrange(15, 70))
        if x < 0.8:
            return "123e4567-e89b-12d3-a456-426614174000"
        return rng.choice(["é", "\U0001f600", "ſecret=abcdefgh", "toKen=abcdefghij", "\n", "hello world", "=", "example", "2024-01-01/2025-02-02", pick("ab1", 30)])

    texts = [None, "", " "] + [rng.choice(["", " ", "é "]).join(piece() for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    return texts + [" ".join(f"token=abcdef{i}" for i in range(2000)), pick(string.ascii_letters + string.digits, 5000)]


def test_secrets(spark):
    rows = list(enumerate(secret_texts())) + [(7, "token=abcdefgh"), (None, "token=abcdefgh"), (None, None)]
    df = docs_of(spark, rows)
    got = rows_of(secrets.digests(secrets.find_secrets(df)))
    assert got == sorted(((i, *brute_secrets(t)) for i, t in rows), key=str)
    assert all(sum(kind in r[-1] for r in got) > 50 for kind in ("hexadecimal", "alphanumeric", "base64"))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    assert sorted(con.execute(queries.ORACLES["op13_secret_scans"]).fetchall(), key=str) == got
    assert secrets.digests(secrets.find_secrets(df.where("false"))).count() == 0


def test_an_allow_list_spares_known_forms(spark):
    key = "hG7kQ2mZ9xW4vB8nL3pR6tYc"
    df = docs_of(spark, [(0, f"see {key} here"), (1, f"token={key}")])
    kinds = lambda allowed: [[s["kind"] for s in r["spans"]] for r in secrets.find_secrets(df, allowed).orderBy("doc_id").collect()]
    assert kinds(secrets.ALLOWED) == [["alphanumeric"], ["assign"]] and kinds((*secrets.ALLOWED, "hG7.*")) == [[], ["assign"]]


def test_secret_plan_is_native(spark):
    plan = secrets.digests(secrets.find_secrets(docs_of(spark, [(0, "x")])))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan.split("Scan ExistingRDD")[0])
